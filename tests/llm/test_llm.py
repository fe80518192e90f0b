"""Each operator against a brute-force version, an exact round trip or held-out accuracy, and on odd inputs."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quernstone.llm import decontamination, language_id, near_dedup, packing, quality_classifier, quality_rules, registry, substring_dedup, token_counts, toxicity, warc
from quernstone.llm.textarrays import blocks
from quernstone.session import table

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, score string, __text string, kept string, n long, label int"
ODD = [None, "", "   \n\t", "word", "two words", "a " * 60, "é ü ß 日本 😀", "\x00nul", "x" * 5000]


def docs_of(spark, texts):
    """Texts with their places as ids, repeated rows, a null id and columns whose names clash."""
    rows = [(i, t, "s", "t", "k", 1, 0) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[0], (None, "a null id has this text", "s", "t", "k", 1, 0)], DOCS)


def labels_of(spark, n):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(n)] + [(0, 1, 1), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


def words_like(rng, n, size=300):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


@pytest.mark.parametrize(("module", "op", "label"), [(quality_classifier, "op1", "quality"), (toxicity, "op3", "toxic")])
def test_classifiers_hold_out(spark, module, op, label):
    out = getattr(module, op)(table(spark, SF, "documents"), table(spark, SF, "labels")).toPandas()
    assert len(out) == table(spark, SF, "documents").count() and out.score.between(0, 1).all()
    folds, rest = (5, 0) if op == "op1" else (3, 1)
    assert all(h == (zlib.crc32(str(i).encode()) % folds == rest) for i, h in zip(out.doc_id, out.held_out, strict=True))
    got = out.merge(table(spark, SF, "labels").toPandas(), on="doc_id")
    got = got[got.held_out] if op == "op1" else got
    assert (got[label] == got.predicted).mean() > 0.9


@pytest.mark.parametrize(("module", "op"), [(quality_classifier, "op1"), (toxicity, "op3"), (quality_rules, "op7")])
def test_classifiers_on_odd_inputs(spark, module, op):
    docs = docs_of(spark, ODD)
    for labels in (labels_of(spark, len(ODD)), labels_of(spark, 0).limit(0)):
        out = getattr(module, op)(docs, labels)
        assert out.count() == len(ODD) + 2
    assert getattr(module, op)(docs.limit(0), labels_of(spark, 3)).count() == 0
    model = module.fit(docs, labels_of(spark, len(ODD)))
    assert module.score(docs, model).columns.count("score") == 1


def test_quality_rules_against_brute_force(spark):
    rng = random.Random(3)
    texts = [*ODD, "a b c a b c", "l1\nl1\n\n \nl2\nl1", "#tag * | x", *[" ".join(words_like(rng, 80, k)) for k in (3, 10, 200)], "x y\r\nx y\r\nx y"]
    out = {r.doc_id: r for r in quality_rules.op7(docs_of(spark, texts), labels_of(spark, len(texts))).collect() if r.doc_id is not None}
    for i, t in enumerate(texts):
        t = t or ""
        w = WORD.findall(t)
        grams = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
        covered = {j + k for j, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
        r = out[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, (i, t[:40])
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r.kept)


def test_substring_dedup_against_brute_force(spark):
    rng = random.Random(5)
    base = words_like(rng, 400)
    texts = [" ".join(words_like(rng, 200)), None, "", " ".join(base)]
    for _ in range(14):
        a, b = sorted(rng.sample(range(400), 2))
        w = words_like(rng, rng.randrange(40)) + base[a:b] + words_like(rng, rng.randrange(40))
        if rng.random() < 0.5 and w:
            w[rng.randrange(len(w))] = "edit"
        texts.append("  ".join(w + (w if rng.random() < 0.3 else [])))
    texts += [texts[3], " ".join(base[:49]), " ".join(base[:50]), "r " * 130, "r " * 120, " ".join(["a", "b"] * 80)]
    docs = docs_of(spark, texts)
    got = {r.doc_id: r for r in substring_dedup.op2(docs).collect()}
    seen: dict[tuple, int] = {}
    text_of = {r.doc_id: r.text for r in substring_dedup.without_duplicates(docs).collect()}
    for i, t in enumerate(texts):
        w = WORD.findall(t or "")
        hit = np.zeros(len(w), bool)
        for j in range(len(w) - 49):
            if tuple(w[j : j + 50]) in seen:
                hit[j : j + 50] = True
        for j in range(len(w) - 49):
            seen.setdefault(tuple(w[j : j + 50]), i)
        kept = [x for x, h in zip(w, hit, strict=True) if not h]
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), int(hit.sum()), hashlib.sha256(" ".join(kept).encode()).hexdigest()), i
        assert WORD.findall(text_of[i] or "") == kept and (hit.any() or text_of[i] == t)
    assert got[None].n_removed == 0
    assert substring_dedup.op2(docs.limit(0)).count() == 0


def brute_components(texts, size, percent):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(low))
        sets.append({tuple(w[j : j + size]) for j in range(max(1, len(w) - size + 1))} if w else set())
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return sets, root


def near_texts():
    rng = random.Random(11)
    texts = [t for t in ODD]
    for length in (30, 120, 300):
        base = words_like(rng, length, 10000)
        for k in range(14):
            w = list(base)
            for _ in range(k * length // 200 + (k > 0)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    texts += ["A B C D", "a b c d", "a b c", "A b C", "a b c d e"]
    return texts


def test_near_dedup_against_brute_force(spark):
    texts = near_texts()
    docs = docs_of(spark, texts)
    for size in (4, 5):
        sets, root = brute_components(texts, size, 80)
        got = {r.doc_id: r for r in near_dedup.near_duplicates(docs, size, 80).collect()}
        assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
        assert [got[i].component_id for i in range(len(texts))] == root
        assert got[None].component_id is None
    kept = {r.doc_id for r in near_dedup.deduplicated(docs, 5).collect()}
    assert kept == {i for i, r in enumerate(root) if i == r} | {None}
    assert near_dedup.op4(docs.limit(0)).count() == 0


def test_prefix_join_finds_every_pair(spark):
    texts = near_texts()
    sets, _ = brute_components(texts, 4, 80)
    labels = spark.createDataFrame([(i, i) for i in range(len(texts))], "doc_id long, label long")
    docs = docs_of(spark, texts).select("doc_id", "text").where("doc_id is not null")
    got = {tuple(r) for r in near_dedup.prefix_pairs(labels, docs, 4, 80).collect()}
    want = {(j, i) for i in range(len(texts)) for j in range(i) if sets[i] & sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert want <= got


def test_posterior_bounds_keep_similar_pairs():
    rng = np.random.default_rng(1)
    looks = near_dedup.least_matches(0.8, 1e-6)
    matches = (rng.random((20000, near_dedup.HASHES)) < 0.8).cumsum(1)
    assert all((matches[:, n - 1] >= least).mean() > 0.9999 for n, least in looks)
    low = (rng.random((1000, near_dedup.HASHES)) < 0.4).cumsum(1)
    assert (low[:, looks[-1][0] - 1] < looks[-1][1]).all()


def test_packing_and_round_trip(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    rng = random.Random(2)
    texts = [*ODD, "It's DON'T “quoted”. é., İstanbul! EVDEKİ. a×. b÷, ſ. J̌ x y", "<|endoftext|> 12.5%", "a<|endoftext|>b. <|ENDOFTEXT|> x<|endoftext|>,", *[" ".join(words_like(rng, n)) for n in (5, 900, 5000, 9000)]]
    docs = docs_of(spark, texts)
    out = packing.packed(docs, group=7).toPandas()
    for i, text in enumerate(texts):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        own = out[out.doc_id == i].sort_values("start")
        own = own.drop_duplicates("start")
        assert own.length.sum() == len(ids) == own.doc_tokens.iloc[0]
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == c for s, n, c in zip(own.start, own.length, own.ids_crc32, strict=True))
    for _, seq in out.sort_values("offset").groupby("sequence_id"):
        assert seq.length.sum() <= 4096 and list(seq.offset) == [0, *seq.length.cumsum()[:-1]]
    assert packing.op6(docs.limit(0)).count() == 0
    lengths = np.array([rng.randrange(1, 4097) for _ in range(2000)])
    window, offset = packing.best_fit_decreasing(lengths, 4096)
    use = np.bincount(window, lengths)
    assert use.max() <= 4096 and 1 - lengths.sum() / (len(use) * 4096) < 0.02
    assert (np.bincount(window, offset) >= 0).all()


def test_best_fit_takes_the_tightest_window():
    window, _ = packing.best_fit_decreasing(np.array([70, 60, 35, 30]), 100)
    assert window.tolist() == [0, 1, 1, 0]


def test_token_counts(spark):
    coder = token_counts.encoding(token_counts.tokenizer_path())[0]
    texts = [*ODD, "one line\nsecond line\n\n\nlast é", "\n\nstart", "end\n\n", "a\n b"]
    docs = docs_of(spark, texts)
    out = token_counts.op5(docs).toPandas()
    for i, t in enumerate(texts):
        t = t or ""
        own = out[out.doc_id == i].sort_values("section").drop_duplicates("section")
        assert own.n_tokens.sum() == len(coder.encode_ordinary(t)) and own.n_chars.sum() == len(t) and len(own) == t.count("\n") + 1
        assert list(own.start) == [0, *[k + 1 for k, c in enumerate(t) if c == "\n"]]
        # brute force: the section of each token's first character that is no line feed
        want, at = [0] * len(own), 0
        for tok in coder.encode_ordinary(t):
            raw = coder.decode_single_token_bytes(tok)
            place = at + (len(raw) - len(raw.lstrip(b"\n")) if raw.strip(b"\n") else 0)
            want[t.encode()[:place].count(b"\n")] += 1
            at += len(raw)
        assert list(own.n_tokens) == want
    assert token_counts.op5(docs.limit(0)).count() == 0


def test_language_id(spark):
    docs = table(spark, SF, "documents")
    out = language_id.op8(docs).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    assert (out[out.held_out].lang == out[out.held_out].lang_pred).mean() > 0.97 and out.score.between(0, 1).all()
    odd = spark.createDataFrame([(i, t, ["en", "fr", None][i % 3]) for i, t in enumerate([*ODD, "123 !!", "ordinary words", "ordinary words"])] + [(None, "x", "en")], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language_id.op8(odd).collect()}
    assert got[0] == got[1] == got[2] == got[len(ODD)] == "und" and got[3] in ("en", "fr")
    assert {r.lang_pred for r in language_id.op8(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language_id.op8(odd.limit(0)).count() == 0


def test_warc(spark):
    big = "<html>" + "payload é " * 200
    html = [None, "", "small", "small", big, big, "x" * 999, "x" * 999, "y" * 1000, "y" * 1000, big + "!", "\r\n\r\nWARC/1.1"]
    pages = spark.createDataFrame([(i, None if i == 3 else f"http://h/{i} é\n", h, "c") for i, h in enumerate(html)] + [(None, None, big, "c")], "page_id long, url string, html string, record_type string")
    got = {r.page_id: r for r in warc.op9(pages).collect()}
    for i, h in enumerate(html):
        raw = (h or "").encode()
        last = max(j for j, x in enumerate(html) if (x or "") == (h or ""))
        revisit = len(raw) >= 1000 and i < last
        assert (got[i].payload_bytes, got[i].payload_digest, got[i].record_type, got[i].refers_to) == (len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", last if revisit else None)
    assert got[None].record_type == "response"
    assert warc.op9(pages.limit(0)).count() == 0


def test_warc_archives_hold_their_dictionary(spark, tmp_path):
    import struct

    pages = table(spark, SF, "pages")
    raw = warc.trained(pages)
    assert raw
    warc.archives(warc.planned(pages).coalesce(1), raw, str(tmp_path / "w"))
    (file,) = (tmp_path / "w").glob("part-*")
    content = file.read_bytes()
    assert struct.unpack_from("<II", content) == (warc.DICTIONARY_FRAME, len(raw)) and content[8 : 8 + len(raw)] == raw
    back = {r.page_id: bytes(r.payload).decode() for r in warc.read_archives(spark, str(tmp_path / "w")).where("record_type = 'response'").collect()}
    want = {r.page_id: r.html for r in pages.collect()}
    assert all(back[k] == want[k] for k in back) and len(back) > 100


def test_warc_archives_are_rolled(spark, tmp_path):
    """With a tiny limit one partition makes many archives, each with the dictionary, and all records come back."""
    import struct

    pages = table(spark, SF, "pages")
    raw, plan = warc.trained(pages), warc.planned(pages)
    warc.archives(plan.coalesce(1), raw, str(tmp_path / "w"), 20_000)
    files = [f for f in (tmp_path / "w").glob("part-*") if f.stat().st_size]
    largest = max(len(r.html or "") for r in pages.select("html").collect())
    assert len(files) > 5
    for f in files:
        content = f.read_bytes()
        assert struct.unpack_from("<II", content) == (warc.DICTIONARY_FRAME, len(raw)) and content[8 : 8 + len(raw)] == raw
        assert len(content) < len(raw) + 20_000 + largest + 1000
    got = warc.read_archives(spark, str(tmp_path / "w")).drop("payload")
    assert sorted(map(str, got.collect())) == sorted(map(str, warc.op9(pages).collect())) and got.count() == pages.count()


def test_warc_dictionary_of_few_records(spark, tmp_path):
    """A table too small to train on still has a dictionary in its archives."""
    pages = spark.createDataFrame([(1, "u", "few words"), (2, "u", None)], "page_id long, url string, html string")
    raw = warc.trained(pages)
    assert raw.endswith(b"Content-Length: 1\r\n\r\n") and b"few words" in raw
    assert warc.trained(pages.limit(0))
    warc.archives(warc.planned(pages), raw, str(tmp_path / "w"))
    assert {(r.page_id, bytes(r.payload)) for r in warc.read_archives(spark, str(tmp_path / "w")).collect()} == {(1, b"few words"), (2, b"")}


def test_decontamination(spark):
    docs, bench = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    got = {(r.doc_id, r.item_id) for r in decontamination.op10(docs, bench).collect()}
    items = {r.item_id: f" {' '.join(r.text.split())} " for r in bench.collect()}
    want = {(r.doc_id, k) for r in docs.collect() for k, t in items.items() if t in f" {' '.join((r.text or '').split())} "}
    assert len(want & got) >= 0.99 * len(want)
    rng = random.Random(4)
    item = words_like(rng, 24, 10**6) + ["End."] + words_like(rng, 6, 10**6)
    para = list(item)
    for k in (2, 7, 11, 15, 20, 22, 9):
        para[k] = "other"
    noise = [" ".join(words_like(rng, 200, 10**6)) for _ in range(3)]
    texts = [None, "", " ".join(item), noise[0] + " " + " ".join(item) + " " + noise[1], noise[2] + " " + " ".join(para), noise[0], " ".join(item[:10]), " ".join(item).upper()]
    odd = docs_of(spark, texts)
    b = spark.createDataFrame([(1, " ".join(item)), (1, " ".join(item)), (2, None), (3, ""), (None, "x")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.op10(odd, b).collect()} == {(i, 1) for i in (2, 3, 4, 7)}
    assert {r.doc_id for r in decontamination.decontaminated(odd, b).collect()} == {0, 1, 5, 6, None}
    assert decontamination.op10(odd.limit(0), b).count() == 0 and decontamination.op10(odd, b.limit(0)).count() == 0


def test_longest_common_subsequence():
    rng = random.Random(6)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(1, 12))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        assert decontamination.common_subsequence(decontamination.bits_of(a), len(a), b) == row[-1]


def test_blocks_keep_whole_rows():
    texts = ["a" * 10, None, "é" * (3 << 20), "", "b"]
    got = [(lo, hi, offs.tolist()) for lo, hi, _, offs in blocks(pa.array(texts))]
    assert got[0][0] == 0 and got[-1][1] == len(texts) and all(a[1] == b[0] for a, b in zip(got, got[1:], strict=False))


def test_pipeline_stages(spark):
    import corpus_pipeline as C

    docs = table(spark, SF, "documents")
    sizes = [docs.count()]
    for _, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        from quernstone.session import written

        docs = written(docs, "stage")
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] == sizes[3] > sizes[4] > 0.5 * sizes[0]
    out = C.STAGES[-1][1](spark, docs, SF)
    assert out.select("doc_id").distinct().count() == sizes[4]
    texts = {r.doc_id: r.text for r in docs.collect()}
    _, root = brute_components([texts[k] for k in sorted(texts)][:150], 5, 80)
    assert len(set(root)) >= 148


def test_registry_names():
    assert {q.split("_")[0] for q in registry.QUERIES} == {f"op{n}" for n in range(1, 14)}

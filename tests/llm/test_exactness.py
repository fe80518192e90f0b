"""Words, texts and ids that simple hashes and joins by id confuse, and what the models find on held-out rows."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quernstone.llm import decontamination, language_id, near_dedup, packing, quality_classifier, quality_rules, registry, substring_dedup, toxicity, warc
from quernstone.llm.textarrays import BLOCK_BYTES, Words, blocks, byte_hashes, runs
from quernstone.session import table

SF = "/root/testdata/sf0.01"
SWAPPED = "a" + "x" * 4095 + "b", "b" + "x" * 4095 + "a"


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def thue_morse(n):
    return ["ab"[bin(i).count("1") % 2] for i in range(n)]


def test_hashes_tell_swaps_and_thue_morse_apart():
    flip = {"a": "b", "b": "a"}
    pairs = [SWAPPED, ("".join(thue_morse(4096)), "".join(flip[c] for c in thue_morse(4096)))]
    pairs += [(a[:400], b[:400]) for a, b in pairs]
    for pair in pairs:
        raw = np.frombuffer("".join(pair).encode(), np.uint8)
        n = len(pair[0])
        one, two = byte_hashes(raw, np.array([0, n]), np.array([n, 2 * n]))
        assert one != two
    word = {"a": 3, "b": 5}
    one, two = (np.array([word[c] for c in t], np.uint64) for t in (thue_morse(2048), [flip[c] for c in thue_morse(2048)]))
    for size in (2, 3, 5, 50, 1024, 2048):
        assert runs(one, size)[0] != runs(two, size)[0] and len(runs(one, size)) == 2048 - size + 1
    h = np.arange(1, 40, dtype=np.uint64) % np.uint64(7)
    for size in range(1, 12):
        got, by = runs(h, size), {}
        for i, x in enumerate(got.tolist()):
            assert by.setdefault(tuple(h[i : i + size].tolist()), x) == x
        assert len(set(by.values())) == len(by)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_queries_equal_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(registry.ORACLES[name])
    columns = [c[0] for c in want.description]
    got = registry.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(*columns).collect()), key=str) == sorted(want.fetchall(), key=str)


def test_long_words_in_every_operator(spark):
    a, b = (" ".join([w, *(f"c{i}" for i in range(60))]) for w in SWAPPED)
    d = docs(spark, [(1, a), (2, b)])
    assert {r.component_id for r in near_dedup.op4(docs(spark, [(1, SWAPPED[0]), (2, SWAPPED[1])])).collect()} == {1, 2}
    got = {r.doc_id: r.n_removed for r in substring_dedup.op2(d).collect()}
    assert got == {1: 0, 2: 60}  # all but the word that differs
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    out = {r.doc_id: r.ids_crc32 for r in packing.packed(d, capacity=1 << 14).collect()}
    for i, text in ((1, a), (2, b)):
        assert out[i] == zlib.crc32(np.array([*t.encode(text, add_special_tokens=False).ids, 2], "<u4").tobytes())


def test_pieces_that_share_a_hash_are_encoded_apart(monkeypatch):
    from quernstone.llm import tokens

    monkeypatch.setattr(tokens, "mix", lambda h: h & np.uint64(0))
    one = tokens.WordTable(packing.tokenizer_path())
    for texts in (["alpha beta gamma alpha", "beta delta"], ["delta alpha"]):
        (lo, hi, buf, offs), = blocks(pa.array(texts))
        ids, ends = one.encode(buf, offs, 2)
        for k, text in enumerate(texts):
            assert ids[ends[k] : ends[k + 1]].tolist() == [*one.tokenizer.encode(text, add_special_tokens=False).ids, 2]


def test_ids_of_random_texts_equal_the_tokenizer():
    """60,000 short texts over letters, marks, punctuation, spaces of all kinds, emoji and the tokenizer's own tokens."""
    from quernstone.llm import tokens

    rng = random.Random(41)
    kinds = ["abcXYZ019", "éÀßÿİıŉſŁǅ", "αΩςЖя", "中文한", "\u0300\u0307\u0327\u0338", ".,;:!?'\"()<>=|#%&*-_", " \t\n\u00a0\u2003\u3000\u0085", "😀👍🏽\u200d", ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "'s", "'LL"]]
    texts = ["".join(rng.choice(rng.choice(kinds)) for _ in range(rng.randrange(1, 14))) for _ in range(60_000)]
    one = tokens.WordTable(packing.tokenizer_path())
    want = one.tokenizer.encode_batch(texts, add_special_tokens=False)
    for lo, _, buf, offs in blocks(pa.array(texts)):
        ids, ends = one.encode(buf, offs, 2)
        for k in range(len(ends) - 1):
            assert ids[ends[k] : ends[k + 1]].tolist() == [*want[lo + k].ids, 2], texts[lo + k]


def test_texts_over_the_block_limit(spark):
    rng = random.Random(8)
    words = [f"w{rng.randrange(10**6)}" for _ in range(BLOCK_BYTES // 6)]
    big = " ".join(words)
    assert len(big) > BLOCK_BYTES
    d = docs(spark, [(1, " ".join(words[1000:1100])), (2, big), (3, big), (4, "short text")])
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.op2(d).collect()}
    assert got == {1: (100, 0), 2: (len(words), 100), 3: (len(words), len(words)), 4: (2, 0)}
    assert {r.doc_id: r.component_id for r in near_dedup.op4(d).collect()} == {1: 1, 2: 2, 3: 2, 4: 4}
    pieces = packing.op6(d).where("doc_id = 2").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all")).first()
    assert pieces.n == pieces["all"]


def test_segments_of_a_long_text_lose_no_window(spark, monkeypatch):
    rng = random.Random(9)
    words = [f"w{rng.randrange(10**6)}" for _ in range(700)]
    monkeypatch.setattr(substring_dedup, "SEGMENT", 64)
    d = docs(spark, [(1, " ".join(words[37:400])), (2, " ".join(words))])
    raw = np.frombuffer(" ".join(words).encode(), np.uint8)
    parts = list(substring_dedup.cut(Words(raw, np.array([0, len(raw)])), 50))
    assert sum(int(n.sum()) for _, _, n, _ in parts) == 700 - 49 and len(parts) > 5
    assert {r.doc_id: r.n_removed for r in substring_dedup.op2(d).collect()} == {1: 0, 2: 363}


def test_rows_that_repeat_an_id_keep_their_own_words(spark):
    w = [f"w{i}" for i in range(100)]
    other = [f"u{i}" for i in range(100)]
    d = docs(spark, [(1, " ".join(w)), (5, " ".join(w)), (5, " ".join(other)), (5, "one two"), (5, " ".join(w))])
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.op2(d).collect())
    assert got == [(1, 100, 0), (5, 2, 0), (5, 100, 0), (5, 100, 100), (5, 100, 100)]
    assert sorted(r.text for r in substring_dedup.without_duplicates(d).where("doc_id = 5").collect()) == ["", "", "one two", " ".join(other)]


def test_factors_hold_the_words_of_their_reference(spark):
    rng = random.Random(12)
    base = [f"w{rng.randrange(10**6)}" for _ in range(600)]
    texts = {1: base, 2: base[100:300] + ["x"] + base[300:500], 3: ["y"] * 3 + base[50:260] + base[400:600], 4: base}
    d = docs(spark, [(k, " ".join(v)) for k, v in texts.items()])
    found = substring_dedup.parsed(d).collect()
    for r in found:
        assert r.ref < r.doc_id and r.end - r.start >= 50
        assert texts[r.doc_id][r.start : r.end] == texts[r.ref][r.ref_start : r.ref_start + r.end - r.start]
    assert [(r.start, r.end, r.ref, r.ref_start) for r in found if r.doc_id == 4] == [(0, 600, 1, 0)]  # one factor, not a list of blocks
    assert sorted((r.start, r.end) for r in found if r.doc_id == 2) == [(0, 200), (201, 401)]


def test_near_dedup_finds_the_links_of_a_table(spark):
    """Every pair at 0.8 or more of the given documents, by an inverted index, is in one component."""
    d = table(spark, SF, "documents").select("doc_id", "text")
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets, holders = {}, {}
    for r in d.collect():
        w = (r.text or "").translate(low).encode().split()
        sets[r.doc_id] = {tuple(w[j : j + 4]) for j in range(max(1, len(w) - 3))} if w else set()
        for g in sets[r.doc_id]:
            holders.setdefault(g, []).append(r.doc_id)
    both: dict[tuple, int] = {}
    for ids in holders.values():
        for i, a in enumerate(ids):
            for b in ids[i + 1 :]:
                both[a, b] = both.get((a, b), 0) + 1
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for (a, b), n in both.items():
        if 100 * n >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.doc_id: r.component_id for r in near_dedup.op4(d).collect()}
    assert got == {k: find(k) for k in sets} and len(set(got.values())) < len(got)


@pytest.mark.parametrize(("module", "op", "label", "folds", "rest", "sf", "recall"), [(quality_classifier, "op1", "quality", 5, 0, SF, 0.85), (toxicity, "op3", "toxic", 3, 1, "/root/testdata/sf0.1", 0.82)])
def test_held_out_recall_and_precision(spark, module, op, label, folds, rest, sf, recall):
    out = getattr(module, op)(table(spark, sf, "documents"), table(spark, sf, "labels")).where("held_out").toPandas()
    assert all(zlib.crc32(str(i).encode()) % folds == rest for i in out.doc_id)
    got = out.merge(table(spark, sf, "labels").toPandas(), on="doc_id")
    hit = ((got[label] == 1) & (got.predicted == 1)).sum()
    assert hit / (got[label] == 1).sum() > recall and hit / (got.predicted == 1).sum() > 0.85


def test_language_id_rejects_what_is_in_no_learned_language(spark):
    d = table(spark, SF, "documents")
    model = language_id.fit(d, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1)
    assert all(0.3 < r < 1 for r in model.reach)
    rng = random.Random(3)
    strange = [
        "今天天气很好，我们一起去公园散步吧。" * 5, "Сегодня хорошая погода, пойдём гулять в парк вместе. " * 5, "SGVsbG8gV29ybGQhIFRoaXMgaXMgYmFzZTY0IGVuY29kZWQ" * 10,
        "deadbeef0123456789abcdef cafebabe feedface " * 10, '{"a_key": [1,2,3], "b": {"c": null, "d": true}} ' * 10, "Tänään on hyvä sää, lähdetään yhdessä kävelylle puistoon ja syömään jäätelöä. " * 4,
        " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(80)),
    ]
    got = language_id.predict(docs(spark, list(enumerate(strange))), model).orderBy("doc_id").collect()
    assert [r.rejected for r in got] == [True] * len(strange)
    own = language_id.predict(d, model).toPandas()
    held = own[[zlib.crc32(str(i).encode()) % 3 == 1 for i in own.doc_id]]
    assert (held.lang == held.lang_pred).mean() > 0.99 and held.rejected.mean() < 0.03


def test_language_id_against_plain_dictionaries(spark):
    """Predictions of a fitted model, from n-grams counted one by one."""
    import math

    from quernstone.llm.textarrays import gram_ids

    d = table(spark, SF, "documents")
    model = language_id.fit(d)
    rows = d.where("n_chars < 1500").orderBy("doc_id").limit(60).select("doc_id", "text").collect()
    got = {r.doc_id: r for r in language_id.predict(docs(spark, rows), model).collect()}
    bucket = {}
    for i, text in rows:
        points = [ord(c.lower()) if c.isalpha() and len(c.lower()) == 1 else ord(c) if c.isalpha() else 32 for c in text]
        tf: dict[int, int] = {}
        for n in language_id.GRAMS:
            for j in range(len(points) - n + 1):
                g = tuple(points[j : j + n])
                if g not in bucket:
                    bucket[g] = int(gram_ids(np.array(g, np.uint32), np.array([0, n]), (n,), language_id.BITS, lower=True)[0][0])
                tf[bucket[g]] = tf.get(bucket[g], 0) + 1
        v = {b: math.sqrt(c) * float(model.idf[b]) for b, c in tf.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        cos = [sum(x * float(c[b]) for b, x in v.items()) / norm for c in model.centroids]
        best = max(range(len(cos)), key=cos.__getitem__)
        assert got[i].lang_pred == model.langs[model.owner[best]] and abs(got[i].score - cos[best]) < 1e-4
        assert got[i].rejected == (1 - got[i].score > model.reach[model.owner[best]])


def test_best_cut_parts_own_from_strangers():
    assert 0.3 < language_id.best_cut(np.array([0.1, 0.2, 0.3]), np.array([0.8, 0.9])) < 0.8
    assert language_id.best_cut(np.array([0.1, 0.2]), np.array([])) < 1 and language_id.best_cut(np.array([]), np.array([])) < 1
    own, strangers = np.linspace(0.1, 0.6, 100), np.linspace(0.5, 0.9, 100)
    cut = language_id.best_cut(own, strangers)
    assert 0.49 < cut < 0.61


def test_toxicity_cut():
    rng = np.random.default_rng(1)
    odds, y = np.r_[rng.normal(2, 1, 200), rng.normal(-2, 1, 400)], np.r_[np.ones(200), np.zeros(400)]
    cut = toxicity.best_cut(odds, y, 5.0)

    def f(c):
        tp, fp = (odds[y > 0] >= c).sum(), 5.0 * (odds[y == 0] >= c).sum()
        return 2 * tp / (tp + fp + 200)

    best = max(f(c) for c in odds)
    near = [c for c in odds if f(c) >= 0.98 * best]
    assert f(cut) >= 0.97 * best and abs(cut - (min(near) + max(near)) / 2) < 1e-9
    assert toxicity.best_cut(np.zeros(4), np.ones(4), 1.0) == np.inf and toxicity.best_cut(np.zeros(4), np.array([1, 0, 1, 0]), 1.0) == 0.0


def test_quality_rules_verdict_on_rows_not_learned_from(spark):
    d, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = quality_rules.fit(d, labels, held_out=F.col("doc_id") % 3 == 0)
    got = quality_rules.score(d.where("doc_id % 3 = 0").select("doc_id", "text"), model).join(labels, "doc_id").toPandas()
    got = got[~got.base_failed]
    assert (got.kept == (got.quality == 1)).mean() > 0.85 and (got.kept == (got.score >= quality_rules.KEEP_AT)).all()


def test_models_do_not_depend_on_the_order_of_repeated_rows(spark):
    rows = [(i % 40, f"text {i} {'good words here' if i % 2 else 'bad bad bad'}", "en" if i % 2 else "fr") for i in range(120)]
    labels = spark.createDataFrame([(i, 7 * (i % 2), i % 3) for i in range(40)], "doc_id long, quality int, toxic int")
    probe = docs(spark, [(0, "good words here"), (1, "bad bad text")])
    scores = set()
    for seed in (1, 2):
        shuffled = random.Random(seed).sample(rows, len(rows))
        d = spark.createDataFrame(shuffled, "doc_id long, text string, lang string").repartition(seed + 1)
        found = [round(r.score, 9) for m in (quality_classifier, toxicity, quality_rules) for r in m.score(probe, m.fit(d, labels)).orderBy("doc_id").collect()]
        found += [(r.lang_pred, round(r.score, 6)) for r in language_id.predict(probe, language_id.fit(d)).orderBy("doc_id").collect()]
        scores.add(str(found))
    assert len(scores) == 1


def test_warc_ids_below_zero(spark):
    big = "z" * 1200
    pages = spark.createDataFrame([(-5, "u", big), (-1, "u", big), (-7, None, "s"), (None, "u", big)], "page_id long, url string, html string")
    got = sorted(((r.page_id, r.record_type, r.refers_to) for r in warc.op9(pages).collect()), key=str)
    assert got == sorted([(-7, "response", None), (-5, "revisit", -1), (-1, "response", None), (None, "response", None)], key=str)


def test_large_payloads_come_back(spark):
    rng = random.Random(4)
    html = "".join(rng.choice("abcdefgh ") for _ in range(3 << 20))
    got = warc.op9(spark.createDataFrame([(1, "u", html), (2, "u", html + "!")], "page_id long, url string, html string")).collect()
    assert {r.page_id: (r.payload_bytes, r.payload_digest) for r in got} == {1: (len(html), hashlib.sha1(html.encode()).hexdigest()), 2: (len(html) + 1, hashlib.sha1((html + "!").encode()).hexdigest())}


def test_paraphrases_are_found(spark):
    """Items in three hosts each, with 15 and 30 % of their words replaced: of those that the check at every half of
    the document holds for contaminated, at least nine in ten are found."""
    rng = random.Random(21)
    items = {r.item_id: r.text for r in table(spark, SF, "benchmark").collect()}
    hosts = [r.text.split() for r in table(spark, SF, "documents").where("length(text) between 500 and 3000").orderBy("doc_id").limit(60).collect()]
    words = {k: decontamination.words_of(t) for k, t in items.items()}
    checker = object.__new__(decontamination.Items)
    keys = list(items)
    checker.words = [words[k] for k in keys]
    checker.bits = [decontamination.bits_of(w) for w in checker.words]
    checker.answers = [decontamination.answer_of(w) for w in checker.words]
    checker.answer_bits = [decontamination.bits_of(w) for w in checker.answers]
    rows, want = [], set()
    for share in (0.15, 0.3):
        for j, k in enumerate(keys):
            for _ in range(2):
                host = rng.choice(hosts)
                cut = rng.randrange(len(host))
                para = [w if rng.random() >= share else f"q{rng.randrange(10**6)}" for w in items[k].split()]
                text = [*host[:cut], *para, *host[cut:]]
                low, n = decontamination.words_of(" ".join(text)), len(words[k])
                if any(checker.check(j, low[max(0, p - n) : p + 32 + n])[2] for p in range(0, len(low), 16)):
                    want.add((len(rows), k))
                rows.append((len(rows), " ".join(text)))
    got = {(r.doc_id, r.item_id) for r in decontamination.op10(docs(spark, rows), table(spark, SF, "benchmark")).collect()}
    assert len(want) > 100 and len(want & got) >= 0.9 * len(want)


def test_items_are_found_among_spaces_of_any_kind(spark):
    rng = random.Random(33)
    item = [f"i{rng.randrange(10**6)}" for _ in range(30)]
    noise = [f"n{rng.randrange(10**6)}" for _ in range(2000)]
    rows = [" ".join(noise)]
    for space in (" ", "\u00a0", "\u0085", "\u2003", "\u3000", "\x1c"):
        rows += [space.join(noise) + " " + " ".join(item), " ".join(noise) + " " + space.join(item) + " end", space.join([*noise, *item]).upper()]
    rows += ["İ É ÀÇ " * 700 + " ".join(item).upper()]
    b = spark.createDataFrame([(1, "\u00a0".join(item)), (2, "\u3000"), (3, " ".join(["étude", "Überall", *noise[:20]]).upper())], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in decontamination.op10(docs(spark, list(enumerate(rows))), b).collect())
    assert [i for i, k in got if k == 1] == list(range(1, len(rows)))
    for text in rows:
        for _, _, buf, offs in decontamination.plain(pa.array([text])):
            assert len(Words(buf, offs)) == len(decontamination.words_of(text))
    assert [len(Words(*x[2:])) for x in decontamination.plain(pa.array(["a\u2028b\u205fc\u1680d\u202fe", "\x1f"]))] == [5]


def test_long_items_are_checked_in_shared_windows(spark):
    rng = random.Random(31)
    item = [f"i{rng.randrange(10**6)}" for _ in range(3000)]
    noise = [f"n{rng.randrange(10**6)}" for _ in range(4000)]
    d = docs(spark, [(1, " ".join(noise[:2000] + item + noise[2000:])), (2, " ".join(noise)), (3, " ".join(item[:1500]))])
    b = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontamination.op10(d, b).collect()] == [(1, 1)]


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline as C

    sf = "/root/testdata/sf0.001"
    d = table(spark, sf, "documents")
    for name, stage in C.STAGES[:-1]:
        before = {r.doc_id: r.text for r in d.collect()}
        from quernstone.session import written

        d = written(stage(spark, d, sf), "stage")
        after = {r.doc_id: r.text for r in d.collect()}
        if name == "substring dedup":
            seen: dict[tuple, int] = {}
            for i in sorted(before):
                w = (before[i] or "").encode().split()
                hit = np.zeros(len(w), bool)
                for j in range(len(w) - 49):
                    if tuple(w[j : j + 50]) in seen:
                        hit[j : j + 50] = True
                for j in range(len(w) - 49):
                    seen.setdefault(tuple(w[j : j + 50]), i)
                assert (after[i] or "").encode().split() == [x for x, h in zip(w, hit, strict=True) if not h]
        else:
            assert all(after[i] == before[i] for i in after) and len(after) <= len(before)
    pieces = C.STAGES[-1][1](spark, d, sf).toPandas()
    assert set(pieces.doc_id) == set(after) and (pieces.groupby("doc_id").length.sum() == pieces.groupby("doc_id").doc_tokens.max()).all()


def test_pipeline_stages_keep_the_callers_columns(spark):
    """Columns that bear the names of the stages' own ones, null ids and texts, repeated rows and an empty table."""
    import corpus_pipeline as C

    sf = "/root/testdata/sf0.001"
    own = ["score", "N_words", "n_removed", "kept_sha256", "__text", "__aside", "component_id", "sequence_id"]
    d = table(spark, sf, "documents")
    some = d.limit(60).withColumns({c: F.concat(F.lit(c + ":"), F.col("doc_id").cast("string")) for c in own})
    odd = some.limit(1).withColumn("doc_id", F.lit(None).cast("long")).unionByName(some.limit(1).withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.lit(10**9))).unionByName(some.limit(2))
    some = some.unionByName(odd)
    for _, stage in C.STAGES[:-1]:
        out = stage(spark, some, sf)
        assert out.columns == some.columns and stage(spark, some.limit(0), sf).count() == 0
        for r in out.where("doc_id < 1000000000").collect():
            assert all(r[c] == f"{c}:{r.doc_id}" for c in own)
    assert C.STAGES[-1][1](spark, some, sf).count() >= some.count()

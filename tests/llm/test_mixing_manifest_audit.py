"""Mixing, manifest and filter audit against brute-force versions, on small and odd tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from itertools import permutations

import numpy as np
import pytest

from quernstone.llm import filter_audit, manifest, mixing
from quernstone.session import table

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, rank string, digest string, fails string, target string, part string"


def docs_of(spark, rows):
    """(doc_id, text, lang, source, n_chars) rows with columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, "s", "r", "d", "f", "t", "p") for r in rows], SCHEMA)


def odd_rows(seed=1):
    rng = random.Random(seed)
    rows = [(None, None, None, None, None), (None, "", "en", "b", 0), (None, "Null id", None, "b", 7), (5, "A long TEXT " * 300, "en", "b", 3600), (5, "A long TEXT " * 300, "en", "b", 3600)]
    rows += [(-3, "É ü ß 日本 😀 ABC", "", "é", 16), (8, " \t\n", "en", "Z", 3), (9, None, "fr", "a", None), (2**62, "x" * 5000, "en", "a", 5000)]
    rows += [(10 + i, " ".join(f"w{rng.randrange(30)}" for _ in range(rng.randrange(1, 400))), rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", None, "😀", "ﬀ"]), i) for i in range(60)]
    rows += [(100 + i, "same text of Many", "de", "hot", 5) for i in range(25)] + [(200, "same text of Many", "de", "a", 5)] * 3
    return rows


def level(total, sizes, weights, passes=3):
    """Targets by plain rounds: share what is left by weight until no share is above its cap."""
    fixed: dict = {}
    while True:
        left, w = total - sum(fixed.values()), sum(weights[s] for s in sizes if s not in fixed)
        over = [s for s in sizes if s not in fixed and passes * sizes[s] < weights[s] * left / w]
        if not over:
            return fixed | {s: weights[s] * left / w for s in sizes if s not in fixed}
        fixed |= {s: float(passes * sizes[s]) for s in over}


def check_mix(spark, rows, block):
    each, parts = mixing.mixed(docs_of(spark, rows), block=block)
    assert sorted(((r.doc_id, r.size) for r in each.collect()), key=str) == sorted(((r[0], len(WORD.findall(r[1] or ""))) for r in rows), key=str)
    each, parts = each.toPandas(), parts.toPandas()
    sizes: dict = {}
    for _, t, _, source, _ in rows:
        sizes[source] = sizes.get(source, 0) + len(WORD.findall(t or ""))
    order = sorted(sizes, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    targets = level(sum(sizes.values()), sizes, {s: k % 3 + 1 for k, s in enumerate(order)})
    for k, s in enumerate(order):
        own = each[each["rank"] == k]
        assert (own.source_size == sizes[s]).all() and np.allclose(own.target, targets[s])
        taken = parts[parts["rank"] == k]
        assert taken.words.sum() == int(targets[s] + 0.5)
        # every word of a document is taken by whole passes, and in the last pass by the stream's beginning
        per = taken.groupby("start").words.sum()
        some = own[own["size"] > 0].set_index("start")
        assert not some.index.duplicated().any() and (per <= 3 * some["size"].reindex(per.index)).all()
        assert sorted(some.index) == list(np.cumsum([0, *some.sort_index()["size"]])[:-1])
    return each, parts, targets, order


@pytest.mark.parametrize("block", [1, 7, 64, 1024])
def test_mix_meets_its_targets(spark, block):
    each, parts, targets, order = check_mix(spark, odd_rows(), block)
    # a slot takes one block of one source and pass, at most ``block`` words of it
    per = parts.groupby("slot")
    assert (per["rank"].nunique() == 1).all() and (per["pass"].nunique() == 1).all() and per.words.sum().max() <= block
    # no word is taken twice in a pass
    spans = parts.sort_values(["rank", "pass", "start", "at"])
    same = (spans["rank"].diff() == 0) & (spans["pass"].diff() == 0) & (spans["start"].diff() == 0)
    assert (spans["at"][same] >= (spans["at"] + spans["words"]).shift()[same]).all()


def test_schedule_is_even(spark):
    """After any number of slots each source has had its share to within a few blocks."""
    rng = random.Random(4)
    rows = [(i, "w " * rng.randrange(1, 200), "en", f"s{i % 7}", 1) for i in range(700)]
    _, parts, targets, order = check_mix(spark, rows, 16)
    slots = parts.drop_duplicates("slot").sort_values("slot")
    ranks, total = slots["rank"].to_numpy(), sum(targets.values())
    for k, s in enumerate(order):
        served = np.cumsum(ranks == k)
        assert np.abs(served - np.arange(1, len(ranks) + 1) * targets[s] / total).max() < 6


def test_mix_does_not_depend_on_partitions_and_splits_hot_sources(spark, monkeypatch):
    rows = odd_rows() + [(1000 + i, f"hot {i} words", "en", "hot", 1) for i in range(300)]
    d = docs_of(spark, rows)
    seen = {str(sorted(map(str, mixing.op11(d.repartition(n)).collect()))) for n in (1, 5)}
    monkeypatch.setattr(mixing, "BUCKET", 16)
    small = mixing.op11(d).toPandas()
    assert len(seen) == 1 and len(small) == len(rows)
    assert str(sorted(map(str, mixing.op11(d).collect()))) in seen  # buckets keep the order
    assert mixing.op11(d.limit(0)).count() == 0
    empty = mixing.op11(docs_of(spark, [(1, None, "en", "a", 1), (2, " ", "en", None, 1)])).collect()
    assert sorted((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in empty) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    one = mixing.op11(docs_of(spark, [(1, "a b c", "en", "a", 1)])).first()
    assert (one.target, one.taken) == (3.0, 3)


def test_mix_uses_no_python_in_its_plan(spark):
    plan = mixing.op11(table(spark, SF, "documents"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def brute_manifest(rows, arity):
    def leaf(r, low=False):
        i, text, lang, source, n = r
        if low and text is not None:
            text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        return digest("".join(field(x) for x in (i, source, lang, n, text)))

    def tree(nodes):
        out = [nodes]
        while len(nodes) > 1:
            nodes = [digest("".join(nodes[i : i + arity])) for i in range(0, len(nodes), arity)]
            out.append(nodes)
        return out

    def others(levels, i):
        out = []
        for nodes in levels[:-1]:
            run = i // arity * arity
            out.append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + arity])))
            i //= arity
        return out

    by: dict = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = tree([leaf(r) for r in by[s]])
    top = tree([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for i, r in enumerate(by[s]):
            around = others(trees[s], i) + others(top, k)
            now = leaf(r, r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0)
            for a, b in around:
                now = digest(a + now + b)
            out.append((r[0], leaf(r), trees[s][-1][0], top[-1][0], digest("".join(a + b for a, b in around)), now, now == top[-1][0]))
    return out


@pytest.mark.parametrize(("arity", "levels"), [(2, 1), (3, 2), (16, 1), (16, 3)])
def test_manifest_against_brute_force(spark, arity, levels):
    rows = odd_rows(3)
    got = [tuple(r) for r in manifest.manifest(docs_of(spark, rows).repartition(3), arity, levels).collect()]
    assert sorted(got, key=str) == sorted(brute_manifest(rows, arity), key=str)
    assert {True, False} == {r[-1] for r in got}


def test_manifest_of_the_table_and_of_one_row(spark):
    d = table(spark, SF, "documents")
    got = [tuple(r) for r in manifest.op12(d).collect()]
    assert sorted(got) == sorted(brute_manifest([(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in d.collect()], 16))
    (one,) = manifest.op12(docs_of(spark, [(7, "Text", "en", "a", 4)])).collect()
    assert one.leaf == one.subroot == one.root == digest("1:71:a2:en1:44:Text") and one.proof_sha256 == digest("")
    assert manifest.op12(d.limit(0)).count() == 0


def brute_audit(rows, labels):
    first: dict = {}
    for i, text, *_ in rows:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    fails = []
    for i, text, lang, *_ in rows:
        text = text or ""
        w = WORD.findall(text)
        bad = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and first[text] < i}
        fails.append((lang or "", {k for k, v in bad.items() if v}, i in good, i in toxic))
    out, total = {}, {}
    for part in {f[0] for f in fails}:
        own = [f for f in fails if f[0] == part]
        for order in map("".join, permutations("ABCDE")):
            alive = list(own)
            for step, x in enumerate(order, 1):
                here = [f for f in alive if x in f[1]]
                gone = [f for f in own if f[1] & set(order[: step - 1])]
                alive = [f for f in alive if x not in f[1]]
                out[part, order, step] = [len(alive), len(here), sum(x in f[1] for f in gone), sum(f[1] == {x} for f in own), sum(f[2] for f in here), sum(f[3] for f in here)]
                total[part, x] = total.get((part, x), 0) + len(here)
    return {(p, o, s, *v, total[p, o[s - 1]]) for (p, o, s), v in out.items()}


def test_audit_against_brute_force(spark):
    rows = odd_rows(5) + [(300, "loud WORDS # " * 60, "en", "a", 1), (301, " ".join(f"v{i}" for i in range(150)), "en", "a", 1), (302, None, "en", "a", 0), (303, "SHOUT " + " ".join(f"v{i}" for i in range(100)), "xx", "a", 0)]
    labels = [(r[0], (r[0] or 0) % 2, (r[0] or 0) % 3 % 2) for r in rows if r[0] is not None and r[0] % 5] + [(None, 1, 1), (300, 1, 1), (300, 0, None), (301, None, 1)]
    d, marks = docs_of(spark, rows), spark.createDataFrame([(*r, "p") for r in labels], "doc_id long, quality int, toxic int, part string")
    got = {tuple(r) for r in filter_audit.op13(d, marks).collect()}
    assert got == brute_audit(rows, labels)
    assert filter_audit.op13(d.limit(0), marks).count() == 0
    assert filter_audit.op13(d, marks.limit(0)).where("good_lost > 0 or toxic_lost > 0").count() == 0


def test_words_that_share_a_hash_stay_apart(spark):
    def collide(buf, starts, ends):
        return (ends - starts).astype(np.uint64) % np.uint64(3)

    rows = [(i, t, "en", "a", 1) for i, t in enumerate(["aa bb aa cc", "aa dddd ee bb", "x y z x y z wwww", "", None, "tt " * 40, "é è é"])]
    d = docs_of(spark, rows).select("doc_id", "text")
    words = {bytes(r.word).decode() for r in filter_audit.dictionary(d, collide).collect()}
    assert words == {w for r in rows for w in WORD.findall(r[1] or "")}
    special = filter_audit.exceptions(filter_audit.dictionary(d, collide))
    assert len(special) == len(set(special.values())) == len(words) - 2 and filter_audit.exceptions(filter_audit.dictionary(d)) == {}
    got = {r.doc_id: (r.n_words, r.n_distinct) for r in filter_audit.flagged(d, collide).collect()}
    assert got == {i: (len(WORD.findall(t or "")), len(set(WORD.findall(t or "")))) for i, t, *_ in rows}


def test_csr_shard():
    from quernstone.llm.textarrays import Words

    raw = np.frombuffer(b"a b a  c", np.uint8)
    words = Words(raw, np.array([0, 5, 5, 8]))
    pointers, codes, counts = filter_audit.shard(raw, words, np.array([7, 9, 7, 4], np.uint64))
    assert pointers.tolist() == [0, 2, 2, 3] and codes.tolist() == [7, 9, 4] and counts.tolist() == [2, 1, 1]

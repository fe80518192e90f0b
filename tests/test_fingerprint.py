from __future__ import annotations

import hashlib
import random

from quernstone.sources.fingerprint import file_trees, tree_fingerprint, tree_hashes


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(data: bytes, fanout: int) -> str:
    lines = data.split(b"\n")
    lines = lines[:-1] if lines[-1] == b"" else lines
    nodes = [hashlib.sha256(x).hexdigest() for x in lines]
    while len(nodes) > 1:
        nodes = [sha("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]
    return sha(f"{len(data)}:{nodes[0]}")


def test_splits_do_not_matter(spark, tmp_path):
    rng = random.Random(5)
    sizes = {"many": 900, "few": 3, "one": 1, "exact": 64}
    for name, n in sizes.items():
        body = b"\n".join(bytes(rng.choice(b"ab\r\xff\xc3\x00 ") for _ in range(rng.randrange(0, 40))) for _ in range(n))
        (tmp_path / name).write_bytes(body + b"x\n")
    (tmp_path / "open").write_bytes(b"no\nline feed")
    (tmp_path / "empty").write_bytes(b"")
    (tmp_path / "blank").write_bytes(b"\n\n\n")
    names = [*sizes, "open", "empty", "blank"]
    files = {n: str(tmp_path / n) for n in names}
    want = {n: brute((tmp_path / n).read_bytes(), 8) for n in names if n != "empty"}
    seen = set()
    for cut in ("134217728", "3000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", cut)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            got = file_trees(spark, files, 8).collect()
            seen.add(spark.read.text(files["many"]).rdd.getNumPartitions())
            assert {r.role: r.hash for r in got} == want
            assert {r.role: r.lines for r in got}["blank"] == 3 and {r.role: r.lines for r in got}["open"] == 2
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(seen) > 1


def test_roles_and_changes(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "1.txt").write_text("a\nb\n")
    (tmp_path / "d" / "2.txt").write_text("c\n")
    (tmp_path / "e.txt").write_text("a\nb")
    files = {"d": str(tmp_path / "d"), "e": str(tmp_path / "e.txt")}
    got = {r.role: (r.lines, r.hash) for r in tree_hashes(spark, files).collect()}
    assert got["d"] == (3, sha(brute(b"a\nb\n", 1024) + brute(b"c\n", 1024)))
    one = tree_fingerprint(spark, files)
    assert one == tree_fingerprint(spark, dict(reversed(files.items()))) == sha("".join(f"{r}:{got[r][1]}\n" for r in "de"))
    (tmp_path / "e.txt").write_text("a\nb\n")  # a line feed more is another file
    assert tree_fingerprint(spark, files) != one

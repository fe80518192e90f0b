"""Records of quoted files that are read in splits, against a reader that goes through a file character by character."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quernstone.operators.validate import GateClosed
from quernstone.sources import delimited as D
from quernstone.sources import records as R


@pytest.fixture
def cut(spark):
    """Sets the size of splits for one test."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")

    def to(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))

    yield to
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def read(text, sep):
    """(line, text, bad) of each record."""
    out, line, at = [], 1, 0
    while at < len(text):
        begin, first, bad, state = at, line, False, "start"
        while at < len(text):
            c = text[at]
            if c == "\n" and state != "quoted":
                break
            line += c == "\n"
            if state == "quoted":
                state = "closed" if c == '"' else "quoted"
            elif c == sep:
                state = "start"
            elif c == '"':
                opens = state in ("start", "closed")
                bad |= not opens
                state = "quoted" if opens else "plain"
            elif not (c == "\r" and text[at + 1 : at + 2] in ("\n", "")):
                bad |= state == "closed"
                state = "plain"
            at += 1
        lost = state == "quoted"
        own = text[begin:at]
        own = own[:-1] if own.endswith("\r") else own
        at, line = at + 1, line + 1
        if own:
            out.append((first, None if lost else own, bad or lost))
    return out


@pytest.mark.parametrize("size", [40, 900, 1 << 20])
def test_records_of_random_text(spark, tmp_path, cut, size):
    """Any text: quotes where none belong, records over several splits, and a last one that is never closed."""
    rng = random.Random(size)
    texts = ["".join(rng.choice(['a', 'b', '"', '"', "\t", "\t", "\n", "\r\n", " ", "é"]) for _ in range(1500)) for _ in range(3)]
    texts += ["h\n" + "\n".join(f'{i}\t"one ""{i}""\nmore\t\n"\tz' for i in range(60)), 'h\n"open\n' + "rest\n" * 200, "\n\n\n", 'x\n"a"\n"b"']
    cut(size)
    for i, text in enumerate(texts):
        (tmp_path / f"t{i}").write_text(text, encoding="utf-8", newline="")
        got = [(r.row, r.value, r.bad) for r in R.records(spark, str(tmp_path / f"t{i}"), "\t").collect()]
        want = [(a, v, b) for a, v, b in read(text, "\t")]
        assert sorted(r[0] for r in got) == [r[0] for r in want], i
        # malformed records keep their place and their mark; what they hold does not matter
        assert sorted((r for r in got if not r[2]), key=str) == sorted((r for r in want if not r[2]), key=str)
        assert {r[0] for r in got if r[2]} == {r[0] for r in want if r[2]}


def test_taxonomy_in_splits(spark, tmp_path, cut):
    """Rows and issues of a file of many splits are those of one split, and the plan reads it by more than one task."""
    rng = random.Random(7)
    head = "\t".join(D.TAXONOMY_COLUMNS)
    lines = []
    for i in range(300):
        name = rng.choice(['plain', '"quoted\ttab"', '"two\nlines"', '"say ""x"""', ""])
        lines.append("\t".join({"taxonID": f"t{i}", "scientificName": name, "created": rng.choice(["2020-01-02", "no", ""])}.get(c, "") for c in D.TAXONOMY_COLUMNS))
    lines[50], lines[60] = "too\tfew", lines[60].replace("t60", 't6"0')
    path = tmp_path / "c.tsv"
    path.write_text("﻿" + "\n".join([head, *lines]) + "\n", encoding="utf-8")
    seen = []
    for size in (1 << 20, len(path.read_bytes()) // 12):
        cut(size)
        tasks = spark.read.text(str(path), lineSep="\n").rdd.getNumPartitions()
        good, issues = D.scan_taxonomy_tsv(spark, str(path))
        seen.append((sorted(map(str, good.collect())), sorted(map(str, issues.collect()))))
    assert tasks >= 8 and seen[0] == seen[1]
    at, line = {}, 2
    for i, text in enumerate(lines):
        at[i], line = line, line + 1 + text.count("\n")
    broken = sorted(r.row for r in issues.where("kind = 'record'").collect())
    assert broken == [at[50], at[60]]
    assert sorted(r.row for r in issues.where("kind = 'date'").collect()) == sorted(at[i] for i, t in enumerate(lines) if "\tno\t" in t)


def test_rows_in_messages(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text('ipni_id,wfo_id\n"1-1",wfo-0000000001\n"2\n-1",nope\n')
    with pytest.raises(GateClosed, match="1 bad rows, the first at 3"):
        D.scan_supplemental_csv(spark, str(path), "ipni")
    path.write_text("type_uri,key,label,value_kind,notes\nu1,ok,L,coded,\"a\nb\"\nu2,Bad Key,L,coded,\n")
    with pytest.raises(GateClosed, match="m.csv:4"):
        D.scan_seed_csv(spark, str(path), "trait_type")


def test_numbered_lines(spark, tmp_path, cut):
    (tmp_path / "a").mkdir()
    text = {n: [f"{n}{i}" * (i % 5) for i in range(200)] for n in ("x", "y")}
    for n, rows in text.items():
        (tmp_path / "a" / n).write_text("\n".join(rows) + "\n")
    cut(100)
    got = R.numbered_lines(spark, str(tmp_path / "a")).withColumn("file", F.substring_index("file", "/", -1)).collect()
    assert sorted((r.file, r.row, r.value) for r in got) == sorted((n, i, v) for n, rows in text.items() for i, v in enumerate(rows, 1))

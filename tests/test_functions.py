from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quernstone.functions import text as T


def one(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_normalize_name(spark):
    cases = {"ﬁg": "fig", "Ａｃｅｒ": "acer", "Straße": "straße", "İris": "iris", "  Red \t Maple ": "red maple", "Yacón": "yacon", "Victoria’s": "victoria's", "ΣΑΣ": "σασ", "": "", "a b": "a b"}
    assert one(spark, list(cases), T.normalize_name) == list(cases.values())
    assert one(spark, [None], T.normalize_name) == [None]
    assert one(spark, ["black-eyed susan"], T.compact_name) == ["blackeyedsusan"]


@pytest.mark.parametrize(
    ("name", "rank", "want"),
    [
        ("Acer rubrum Linné", "species", "Acer rubrum"),
        ("Acer rubrum L. var. trilobum (K.) Torr.", "variety", "Acer rubrum var. trilobum"),
        ("Salix ×sepulcralis Simonk.", "species", "Salix × sepulcralis"),
        ("Salix x sepulcralis Simonk.", "species", "Salix × sepulcralis"),
        ("Rosa L.", "genus", "Rosa"),
        ("×Festulolium Asch.", "genus", "× Festulolium"),
        ("Viola adunca Sm. ssp. adunca", "subspecies", "Viola adunca subsp. adunca"),
        ("Viola adunca Sm. ssp. ×bella (Gr.) Clausen", "subspecies", "Viola adunca subsp. bella"),
        ("Viola adunca Hook. f. var. adunca f. alba Mor.", "form", "Viola adunca f. alba"),
        ("Carex st.-helensii Hook.", "species", "Carex st-helensii"),
        ("Acer rubrum", "section", None),
        ("acer rubrum", "species", None),
        ("Acer", "species", None),
        ("Acer ex Mill.", "species", None),
        ("Acer rubrum ×trilobum", "variety", None),
    ],
)
def test_canonical_name(spark, name, rank, want):
    df = spark.createDataFrame([(name, rank)], "n string, r string")
    assert df.select(T.canonical_name(F.col("n"), F.col("r"))).first()[0] == want


def test_values(spark):
    assert one(spark, ["8.199999999999999", "+5", "-1e2", ".5", "5.", " 5", "5\n", "1,000", "", None], lambda c: T.parse_decimal(c).cast("double")) == [8.199999999999999, 5, -100, 0.5, 5, None, None, None, None, None]
    assert one(spark, ["2022-04-06", "2022-4-6", "2022", "2025-02-30", "2022-04-06\n"], lambda c: T.parse_iso_date(c).cast("string")) == ["2022-04-06", None, None, None, None]
    assert one(spark, ["http://a/b#c/d", "https://x/9", "plain", "a/b"], T.value_code) == ["d", "9", "plain", "a/b"]
    assert [r.place_id for r in one(spark, ["http://g/123", "http://w/Q5", "Peru"], T.classify_place)] == ["123", "Q5", None]
    assert one(spark, ["Q1", "Q01", "Q1\n", "q1"], T.is_qid) == [True, False, False, False]
    assert one(spark, ["Source term: tall. More", "Source term: a\\b.", "x"], T.source_term) == ["tall", None, None]
    assert one(spark, [" URN:lsid:ipni.org:names:30-1 ", "7-2"], T.normalize_ext_id) == ["30-1", "7-2"]


def test_titles_and_ranks(spark):
    assert one(spark, ["Musa × p (plant)", "AC/DC", "C++", "Who?", "a~b"], T.article_url) == [f"https://en.wikipedia.org/wiki/{p}" for p in ("Musa_%C3%97_p_(plant)", "AC/DC", "C%2B%2B", "Who%3F", "a~b")]
    assert one(spark, ["ok", " ", "a|b", "a\x01", None], T.is_requestable_title) == [True, False, False, False, False]
    assert one(spark, ["Species", "nothospecies", "unranked", None], T.rank_depth) == [20, 20, 1000, 1000]
    assert one(spark, ["species", "convar", "tribe", None], T.rank_bucket) == ["species", "infraspecific", "other", "unlinked"]
    assert one(spark, ["Slow (rare) ", "Slow"], T.comparable_label) == ["Slow", "Slow"]
    assert one(spark, ["x" * 81, "x"], T.shortened) == ["x" * 80 + "…", "x"]
    assert one(spark, ["abcd", "ab", None], T.trigrams) == [["abc", "bcd"], [], []]
    assert one(spark, ["en", "en-gb", "eng", "fr"], T.is_english) == [True, True, False, False]


def test_match_tier_is_literal(spark):
    df = spark.createDataFrame([("Acer", "acer"), ("Acer rubrum", "ACER"), ("red-maple", "maple"), ("xmaple", "maple"), ("a%b", "%"), ("ab", "%"), ("a_b", "_")], "t string, q string")
    assert [r[0] for r in df.select(T.match_tier(F.col("t"), F.col("q"))).collect()] == [10, 20, 30, 40, 40, None, 40]


def test_lead_status_and_stubs(spark):
    rows = [(True, False, "Q1", ["Q1"], "x"), (False, True, "Q1", ["Q1"], "x"), (False, False, None, ["Q1"], "x"), (False, False, "Q2", ["Q1"], "x"), (False, False, "Q1", ["Q1"], " "), (False, False, "Q1", ["Q1"], "x")]
    df = spark.createDataFrame(rows, "m boolean, d boolean, i string, r array<string>, l string")
    got = [r[0] for r in df.select(T.lead_status(*[F.col(c) for c in "mdirl"])).collect()]
    assert got == ["Missing", "Disambiguation", "ItemMismatch", "ItemMismatch", "EmptyLead", "Ok"]
    flags = one(spark, ["Acer is a genus of trees", "Acer is a genus of trees. " + "It grows. " * 40], T.stub_flags)
    assert [(f.short, f.single, f.stub) for f in flags] == [(True, True, True), (False, False, False)]

"""Shade scores, translated values and the promotion rule's traits."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernstone.operators import facts


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_shade_is_scored_under_both_hypotheses(spark):
    ours = spark.createDataFrame([("a", "sh", "lo"), ("b", "sh", "hi"), ("c", "sh", "mid"), ("d", "sh", "lo"), ("d", "sh", "hi"), ("e", "sh", "zz"), ("f", "other", "lo")], "symbol string, key string, code string")
    theirs = spark.createDataFrame([(s, "SHADE", v) for s, v in (("a", "low"), ("b", "Low"), ("c", "Medium"), ("d", "Low"), ("e", "Low"), ("f", "Low"))], "symbol string, field string, value string")
    mapping = spark.createDataFrame([("Shade", "sh", "Shade")], "field string, key string, mode string")
    tolerance = spark.createDataFrame([("lo", "Low (tolerance)"), ("hi", "High"), ("mid", "Medium")], "code string, label string")
    seen = facts.shade_observations(ours, theirs, mapping, tolerance)
    assert rows(seen.select("symbol", "code", "direct", "inverted")) == [("a", "lo", "Low", "High"), ("b", "hi", "High", "Low"), ("c", "mid", "Medium", "Medium")]
    assert rows(facts.shade_score(seen)) == [("sh", "Shade", 3, 2, 2)]


def test_translated_values_agree(spark):
    ours = spark.createDataFrame([("s", "leaf", "Evergreen", "verified"), ("t", "leaf", "Deciduous", "verified"), ("u", "leaf", "Yes", "verified")], "symbol string, key string, label string, confidence string")
    ours = ours.withColumn("present", F.lit(True)).withColumn("numeric", F.lit(None).cast("decimal(38,15)")).withColumn("statistic", F.lit(None).cast("string"))
    theirs = spark.createDataFrame([(s, "Leaf", "YES") for s in "stu"], "symbol string, field string, value string")
    mapping = spark.createDataFrame([("leaf", "leaf", "Label", None)], "field string, key string, mode string, statistic string")
    words = spark.createDataFrame([("LEAF", "Yes", "Evergreen"), ("leaf", "No", "Deciduous")], "field string, value string, expected string")
    assert rows(facts.compare_facts(ours, theirs, mapping, words).select("symbol", "outcome")) == [("s", "Agree"), ("t", "Disagree"), ("u", "Disagree")]


def test_only_tolerance_traits_promote(spark):
    out = spark.createDataFrame([(s, k, "Agree") for s in "abc" for k in ("fire_tolerance", "bloat")], "symbol string, key string, outcome string")
    ours = spark.createDataFrame([(s, k, c) for s in "abc" for k, c in (("fire_tolerance", "x"), ("fire_tolerance", "y"), ("bloat", "y"))], "symbol string, key string, code string")
    tally = facts.tally_codes(out, ours.withColumns({"label_type": F.lit(None).cast("string"), "confidence": F.lit("inferred")}))
    assert rows(tally.select("code", "keys")) == [("x", ["fire_tolerance"]), ("y", ["bloat", "fire_tolerance"])]
    assert rows(facts.promoted(tally).select("code")) == [("x",)]


def test_flags_sets_and_numbers_are_tallied_by_fact(spark):
    ours = spark.createDataFrame(
        [("s", "tol", "F1", "Fire: Yes"), ("s", "tol", "C0", "Cold: No"), ("s", "use", "A", "Food"), ("s", "use", "B", "Fuel"), ("s", "high", "N", None)], "symbol string, key string, code string, label string"
    ).selectExpr("*", "CASE WHEN code = 'N' THEN NULL ELSE 'verified' END AS confidence", "CAST(NULL AS STRING) AS label_type", "CAST(CASE WHEN code = 'N' THEN 2 END AS DECIMAL(38,15)) AS numeric", "CAST(NULL AS STRING) AS statistic")
    theirs = spark.createDataFrame([("s", "fire", "yes"), ("s", "Uses", "Food"), ("s", "Uses", "Fodder"), ("s", "Height", "2"), ("s", "Height", "3")], "symbol string, field string, value string")
    mapping = spark.createDataFrame([("Fire", "tol", "Flag", None), ("Uses", "use", "Set", None), ("Height", "high", "Only", None)], "field string, key string, mode string, statistic string")
    outcomes = facts.compare_facts(ours, theirs, mapping)
    assert sorted((r.field, r.value, r.outcome) for r in outcomes.collect() if r.field != "Uses") == [("Fire", "yes", "Agree"), ("Height", "2", "Agree"), ("Height", "3", "Disagree")]
    tally = {r.code: (r.agree, r.disagree, r.verdict) for r in facts.tally_codes(outcomes, ours).collect()}
    assert tally == {"F1": (1, 0, None), "A": (1, 0, None), "B": (0, 1, "contradicted")}
    assert facts.passed(facts.tally_codes(outcomes, ours)).first().passed is False
    bare = ours.withColumn("label", F.lit(None).cast("string")).withColumn("confidence", F.lit(None).cast("string"))
    got = facts.unmapped_observations(facts.compare_facts(bare, theirs, mapping), bare)
    assert [(r.key, r.code, r.value, r.n) for r in got.collect()] == [("use", "A", "fodder | food", 1)]

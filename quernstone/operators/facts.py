"""Coded facts: attribution, labels with overrides, and comparison with an independent source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions.text import comparable_label, distribution_kind, parse_decimal, value_code

TOLERANCE = 1e-6
TAXA_REQUIRED = 3
# The tolerance traits.
TOLERANCE_KEYS = ("fire_tolerance", "drought_tolerance", "caco3_tolerance", "anaerobic_tolerance", "salinity_tolerance", "hedge_tolerance")


def attribute_facts(facts: DataFrame, occ: DataFrame, taxa: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts of current taxa with code, number and remark; and the distribution rows among them.

    ``facts`` (occurrence_id, type_uri, value_raw, remark_sha), ``occ`` (occurrence_id, symbol), ``texts`` (sha256, text).
    """
    known = taxa.where("is_current").select("symbol")
    rows = facts.join(occ.select("occurrence_id", "symbol"), "occurrence_id").join(known, "symbol")
    rows = rows.join(texts.select(F.col("sha256").alias("remark_sha"), F.col("text").alias("remark")), "remark_sha", "left")
    raw = F.coalesce("value_raw", F.lit(""))
    rows = rows.withColumns({"value_raw": raw, "code": value_code(raw), "value_numeric": parse_decimal(raw), "kind": distribution_kind(F.col("type_uri"))})
    return rows.where("kind is null").drop("kind"), rows.where("kind is not null")


def label_facts(facts: DataFrame, types: DataFrame, labels: DataFrame) -> DataFrame:
    """Facts with key, value kind, label, confidence, label_type and display.

    A label row for the fact's own type replaces the generic one entirely, even if it has no label. ``facts`` (symbol,
    type_uri, code, value_raw); ``types`` (type_uri, key, value_kind); ``labels`` (code, type_uri or null, label,
    confidence). The seeds are reviewed by hand and small; Spark broadcasts them by their measured size.
    """
    own = labels.where("type_uri is not null").select("code", "type_uri", F.lit(True).alias("o"), F.col("label").alias("ol"), F.col("confidence").alias("oc"))
    generic = labels.where("type_uri is null").select("code", F.lit(True).alias("g"), F.col("label").alias("gl"), F.col("confidence").alias("gc"))
    rows = facts.join(types, "type_uri", "left").join(own, ["code", "type_uri"], "left").join(generic, "code", "left")
    label = F.when(F.col("o"), F.col("ol")).otherwise(F.col("gl"))
    confidence = F.when(F.col("o"), F.col("oc")).otherwise(F.col("gc"))
    display = (
        F.when(F.col("value_kind") == "numeric", F.col("value_raw"))
        .when(F.col("o") & F.col("ol").isNull(), F.concat("code", F.lit(" ("), "oc", F.lit(")")))
        .when(F.col("o"), F.col("ol"))
        .when(F.col("gl").isNotNull(), F.col("gl"))
        .otherwise(F.concat("code", F.lit(" (unmapped)")))
    )
    kept = [c for c in facts.columns if c not in ("code", "type_uri")]
    return rows.select("code", "type_uri", *kept, "key", "value_kind", label.alias("label"), confidence.alias("confidence"), F.when(F.col("o"), F.col("type_uri")).alias("label_type"), display.alias("display"))


def compare_facts(ours: DataFrame, theirs: DataFrame, mapping: DataFrame, translate: DataFrame | None = None) -> DataFrame:
    """(symbol, key, field, mode, value, they, outcome): Agree, Disagree, Missing, Unmapped or Unresolved.

    ``ours`` (symbol, key, label, confidence, numeric, statistic); ``theirs`` (symbol, field, value); ``mapping`` (field,
    key, mode, statistic) with mode Label, Flag, Set, Min, Max, Only, Statistic or Shade. Fields match whatever their
    case. The values of a Set field are compared together, as ``they``; of any other field each value by itself, as
    ``value``. ``translate`` (field, value, expected) gives the label that a value of a Label field stands for,
    whatever the case.
    """
    chosen = mapping.select(F.lower("field").alias("f"), "field", "key", "mode", F.col("statistic").alias("want_stat"))
    want = theirs.select("symbol", F.lower("field").alias("f"), "value").join(chosen, "f")
    each = F.when(F.col("mode") != "Set", F.col("value")).alias("value")
    # values move once, to where their facts will be
    want = want.repartition("symbol", "key").groupBy("symbol", "field", "key", "mode", "want_stat", each).agg(F.array_sort(F.collect_set(F.lower("value"))).alias("they"))
    want = want.withColumn("expected", F.lower("value"))
    if translate is not None:
        words = translate.select(F.lower("field").alias("__f"), F.lower("value").alias("__v"), F.lower("expected").alias("__e"))
        on = (F.lower("field") == F.col("__f")) & (F.lower("value") == F.col("__v")) & (F.col("mode") == "Label")
        want = want.join(words, on, "left").withColumn("expected", F.coalesce("__e", "expected")).drop("__f", "__v", "__e")
    label = F.lower(comparable_label(F.col("label")))
    mine = ours.select("symbol", "key", "label", "confidence", "numeric", "statistic", F.lit(True).alias("found"))
    rows = want.join(mine, ["symbol", "key"], "left")
    has = F.col("found").isNotNull()
    counted = F.col("numeric").isNotNull() & (F.col("want_stat").isNull() | (F.col("statistic") == F.col("want_stat")))
    flag = is_flag(F.col("label"), F.col("field"))
    per = rows.groupBy("symbol", "field", "key", "mode", "value", "expected", "they").agg(
        F.count_if(has).alias("n"),
        F.count_if(has & F.col("label").isNull() & F.col("confidence").isNull()).alias("unmapped"),
        F.count_if(has & F.col("label").isNull()).alias("unlabelled"),
        F.array_sort(F.collect_set(label)).alias("we"),
        F.count_if(flag).alias("flags"),
        F.min(F.when(flag, F.lower("label"))).alias("flag"),
        F.count_if(counted).alias("numbers"),
        F.min(F.when(counted, F.col("numeric"))).alias("lo"),
        F.max(F.when(counted, F.col("numeric"))).alias("hi"),
    )
    number = parse_decimal(F.col("value"))
    numeric = F.col("mode").isin("Min", "Max", "Only", "Statistic")
    one = F.when(F.col("mode") == "Min", F.col("lo")).when(F.col("mode") == "Max", F.col("hi")).when(F.col("lo") == F.col("hi"), F.col("lo"))
    agree = (
        F.when(numeric, F.coalesce(F.abs(one - number) <= TOLERANCE, F.lit(False)))
        .when(F.col("mode") == "Flag", (F.col("flags") == 1) & (F.col("flag") == F.concat(F.lower("field"), F.lit(": "), F.lower("value"))))
        .when(F.col("mode") == "Set", F.col("we") == F.col("they"))
        .otherwise((F.size("we") == 1) & (F.col("we")[0] == F.col("expected")))
    )
    outcome = (
        F.when(F.col("n") == 0, "Missing")
        .when(F.col("mode") == "Shade", "Unresolved")
        .when(numeric & (F.col("numbers") == 0), "Missing")
        .when(~numeric & (F.col("mode") != "Flag") & (F.col("unmapped") > 0), "Unmapped")
        .when(~numeric & (F.col("mode") != "Flag") & (F.col("unlabelled") > 0), "Unresolved")
        .when((F.col("mode") == "Flag") & (F.col("flags") == 0), "Missing")
        .when(F.coalesce(agree, F.lit(False)), "Agree")
        .otherwise("Disagree")
    )
    return per.select("symbol", "key", "field", "mode", "value", "they", outcome.alias("outcome"))


def is_flag(label: Column, field: Column) -> Column:
    """Whether a label is one of a Flag field: it starts with the field's name and a colon."""
    return F.startswith(F.lower(label), F.concat(F.lower(field), F.lit(":")))


def trait_tally(outcomes: DataFrame) -> DataFrame:
    """(key, field, agree, disagree, missing, unmapped, unresolved) of each compared field."""
    names = ["Agree", "Disagree", "Missing", "Unmapped", "Unresolved"]
    return outcomes.groupBy("key", "field").agg(*[F.count_if(F.col("outcome") == n).alias(n.lower()) for n in names])


def unmapped_observations(outcomes: DataFrame, ours: DataFrame) -> DataFrame:
    """(key, code, value, n): what the other source says where a code of ours has no label row at all.

    For a Set the value is the whole set. ``ours`` has the code.
    """
    codes = ours.where("label is null and confidence is null").groupBy("symbol", "key").agg(F.min("code").alias("code"))
    rows = outcomes.where("outcome = 'Unmapped'").join(codes, ["symbol", "key"])
    value = F.coalesce("value", F.array_join("they", " | "))
    return rows.groupBy("key", "code", value.alias("value")).agg(F.count("*").alias("n"))


def passed(tally: DataFrame) -> DataFrame:
    """(passed, contradicted): the verdict over all codes; verified ones must never disagree."""
    bad = F.count_if(F.coalesce(F.col("verdict") == "contradicted", F.lit(False)))
    return tally.agg((bad == 0).alias("passed"), bad.alias("contradicted"))


def shade_observations(ours: DataFrame, theirs: DataFrame, mapping: DataFrame, tolerance: DataFrame) -> DataFrame:
    """(symbol, key, field, code, value, direct, inverted) of Shade rows with exactly one fact, of a tolerance code.

    Direct: the code means what it means in the other tolerance traits; inverted: Low and High swap. ``tolerance``
    (code, label); ``ours`` (symbol, key, code).
    """
    shade = mapping.where("mode = 'Shade'").select(F.lower("field").alias("f"), "field", "key")
    want = theirs.select("symbol", F.lower("field").alias("f"), "value").join(shade, "f")
    want = want.groupBy("symbol", "field", "key").agg(F.min("value").alias("value"))
    one = ours.groupBy("symbol", "key").agg(F.count("*").alias("n"), F.min("code").alias("code")).where("n = 1").drop("n")
    direct = comparable_label(F.col("label"))
    rows = want.join(one, ["symbol", "key"]).join(tolerance.where("label is not null").select("code", direct.alias("direct")), "code")
    inverted = F.when(F.lower("direct") == "low", "High").when(F.lower("direct") == "high", "Low").otherwise(F.col("direct"))
    return rows.select("symbol", "key", "field", "code", "value", "direct", inverted.alias("inverted"))


def shade_score(observations: DataFrame) -> DataFrame:
    """(key, field, compared, direct_agreements, inverted_agreements) of Shade observations."""
    same = {c: F.lower(c) == F.lower("value") for c in ("direct", "inverted")}
    return observations.groupBy("key", "field").agg(F.count("*").alias("compared"), *[F.count_if(ok).alias(f"{c}_agreements") for c, ok in same.items()])


def tally_codes(outcomes: DataFrame, ours: DataFrame) -> DataFrame:
    """(code, label_type, confidence, agree, disagree, agreeing_taxa, keys, verdict) over the facts behind Agree and Disagree.

    Only facts that were compared count: in a Flag field those whose label is one of the field, in a Set field each
    by whether the other source's set has it, in a Label field all of the trait; numbers and shade count no code.
    ``outcomes`` come from :func:`compare_facts`; ``keys`` are those of the facts that agree.

    Verdict: confirmed for an inferred code that only agrees, contradicted for a verified one that ever disagrees.
    """
    if "mode" not in outcomes.columns:  # outcomes of Label fields alone
        ours = ours if "label" in ours.columns else ours.withColumn("label", F.lit(None).cast("string"))
        outcomes = outcomes.withColumns({"mode": F.lit("Label"), "field": F.lit(""), "they": F.array().cast("array<string>")})
    rows = outcomes.where("outcome in ('Agree', 'Disagree') and mode in ('Label', 'Flag', 'Set')").join(ours, ["symbol", "key"])
    rows = rows.where((F.col("mode") != "Flag") | is_flag(F.col("label"), F.col("field")))
    member = F.array_contains("they", F.lower(comparable_label(F.col("label"))))
    ok = F.when(F.col("mode") == "Set", F.coalesce(member, F.lit(False))).otherwise(F.col("outcome") == "Agree")
    per = rows.groupBy("code", "label_type", "confidence").agg(F.count_if(ok).alias("agree"), F.count_if(~ok).alias("disagree"), F.countDistinct(F.when(ok, F.col("symbol"))).alias("agreeing_taxa"), F.array_sort(F.collect_set(F.when(ok, F.col("key")))).alias("keys"))
    verdict = F.when((F.col("confidence") == "inferred") & (F.col("agree") > 0) & (F.col("disagree") == 0), "confirmed").when((F.col("confidence") == "verified") & (F.col("disagree") > 0), "contradicted")
    return per.withColumn("verdict", verdict)


def promoted(tally: DataFrame, required: int = TAXA_REQUIRED, keys: tuple[str, ...] = TOLERANCE_KEYS) -> DataFrame:
    """Codes that enough taxa agree on and nothing contradicts, if they agree in traits of ``keys`` only."""
    inside = F.size(F.array_except("keys", F.array(*[F.lit(k) for k in keys]))) == 0
    return tally.where((F.col("disagree") == 0) & (F.col("agreeing_taxa") >= required) & inside)

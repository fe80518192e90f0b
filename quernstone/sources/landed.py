"""Readers of landed JSON responses: query results, entities, pages, profiles and identifications."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.functions.text import is_qid, statement_rank
from quernstone.session import written

SPARQL = "results struct<bindings:array<struct<item:struct<value:string>,wfo:struct<value:string>,rank:struct<value:string>>>>"
ENTITIES = """entities map<string,struct<id:string,missing:string,lastrevid:bigint,redirects:struct<`from`:string,`to`:string>,
labels:map<string,struct<value:string>>,sitelinks:map<string,struct<title:string>>,
claims:map<string,array<struct<rank:string,mainsnak:struct<snaktype:string,datavalue:struct<value:string>>>>>>>"""
EDGE = "array<struct<`from`:string,`to`:string,fromencoded:boolean>>"
PAGES = f"""query struct<normalized:{EDGE},converted:{EDGE},redirects:{EDGE},pages:array<struct<title:string,missing:boolean,invalid:boolean,
pageid:bigint,lastrevid:bigint,extract:string,pageprops:struct<wikibase_item:string,`wikibase-shortdesc`:string,disambiguation:string>>>>"""
EXTERNAL_IDS = ["P846", "P961", "P1772", "P5037"]  # fixed values
MAX_HOPS = 10
# The organs that a predicted one must be among.
ORGANS = ["auto", "leaf", "flower", "fruit", "bark", "habit", "scan", "branch", "sheet", "other", "drawing", "seed", "bud", "anatomy", "aerial"]
ENTITY = "http://www.wikidata.org/entity/"  # fixed value


def scan_sparql_results(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(qid, ext_id, statement_rank) and issues. Deprecated statements are counted as issues and dropped.

    A truncated document is an error.
    """
    rows = spark.read.schema(SPARQL).json(path, multiLine=True, mode="FAILFAST").select(F.explode("results.bindings").alias("b"))
    qid = F.regexp_extract("b.item.value", rf"\A\Q{ENTITY}\E(Q[1-9][0-9]*)\z", 1)
    rows = rows.select(F.nullif(qid, F.lit("")).alias("qid"), F.col("b.wfo.value").alias("ext_id"), statement_rank(F.col("b.rank.value")).alias("statement_rank"), F.col("b.item.value").alias("item"))
    ok = F.col("qid").isNotNull() & F.col("ext_id").isNotNull() & F.col("statement_rank").isin("preferred", "normal")
    kind = F.when(F.col("statement_rank") == "deprecated", "deprecated").when(F.col("qid").isNull(), "item").when(F.col("ext_id").isNull(), "value").otherwise("rank")
    good = F.coalesce(ok, F.lit(False))
    return rows.where(good).drop("item"), rows.where(~good).select(F.lit("warning").alias("severity"), kind.alias("kind"), F.col("item").alias("message"))


def scan_entities_json(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """item, item_name, item_external_id, item_taxon_id, redirect, missing and issues of landed entities.

    Claims count with rank preferred or normal and a value; preferred ones first, then in the order of the statements.
    """
    return entity_tables(entity_rows(spark.read.schema(ENTITIES).json(path, multiLine=True, mode="FAILFAST")))


def entity_rows(documents: DataFrame) -> DataFrame:
    """(key, requested, qid, missing, lastrevid, taxon_name, rank_qid, image, label, title, names, external_ids,
    taxon_ids) of each entity of parsed documents.

    Claims are looked at here, once; the last three are arrays of an entity's own distinct values.
    """
    e = documents.select(F.explode("entities").alias("key", "e"))

    def values(prop: str):
        every = F.col("e.claims")[prop]
        usable = F.filter(every, lambda c: c["rank"].isin("preferred", "normal") & (c.mainsnak.snaktype == "value"))
        ordered = F.array_sort(F.transform(usable, lambda c, i: F.struct((c["rank"] != "preferred").alias("after"), i.alias("place"), c.mainsnak.datavalue.value.alias("v"))))
        return F.when(every.isNotNull(), F.transform(ordered, lambda s: s.v))

    def listed(values):
        return F.when(values.isNotNull(), F.array_distinct(values)).otherwise(F.array())

    def item_id(value):
        return F.coalesce(F.get_json_object(value, "$.id"), F.concat(F.lit("Q"), F.get_json_object(value, "$.numeric-id")))

    def named(prop: str):
        return F.when(F.col("e.claims")[prop].isNotNull(), F.transform(values(prop), lambda v: F.struct(F.lit(prop).alias("property"), v.alias("value"))))

    told = F.transform(values("P1843"), lambda v: F.struct(F.get_json_object(v, "$.language").alias("language"), F.get_json_object(v, "$.text").alias("name")))
    ids = F.flatten(F.array_compact(F.array(*map(named, EXTERNAL_IDS))))
    return e.select(
        "key", F.coalesce("e.redirects.from", "key").alias("requested"), F.coalesce("e.id", "key").alias("qid"), F.col("e.missing").isNotNull().alias("missing"), "e.lastrevid",
        F.get(values("P225"), F.lit(0)).alias("taxon_name"), item_id(F.get(values("P105"), F.lit(0))).alias("rank_qid"), F.get(values("P18"), F.lit(0)).alias("image"),
        F.col("e.labels")["en"]["value"].alias("label"), F.col("e.sitelinks")["enwiki"]["title"].alias("title"),
        listed(F.filter(told, lambda n: n["language"].isNotNull() & n["name"].isNotNull())).alias("names"), F.array_distinct(ids).alias("external_ids"), listed(values("P7715")).alias("taxon_ids"),
    )


def entity_tables(e: DataFrame, unique: bool = False) -> dict[str, DataFrame]:
    """The tables of :func:`scan_entities_json` from entity rows; ``unique``: no two of them have one qid."""
    missing = e.where("missing").select(F.col("requested").alias("qid"))
    known = F.coalesce(is_qid(F.col("qid")), F.lit(False))
    live = e.where("not missing").where(known)
    issues = e.where("not missing").where(~known).select(F.lit("warning").alias("severity"), F.lit("qid").alias("kind"), F.coalesce("qid", F.lit("")).alias("message"))
    item = live.select("qid", "taxon_name", "rank_qid", "image", "label", "title", F.col("lastrevid").alias("last_rev_id"))
    lists = {"item_name": live.select("qid", F.inline("names")), "item_external_id": live.select("qid", F.inline("external_ids")), "item_taxon_id": live.select("qid", F.explode("taxon_ids").alias("taxon_id_raw"))}
    redirect = live.where("requested <> qid").select("requested", F.col("qid").alias("actual"))
    return {"item": item, **{name: rows if unique else rows.distinct() for name, rows in lists.items()}, "redirect": redirect, "missing": missing, "issues": issues}


STEPS = ("normalized", "converted", "redirects")


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("start", T.StringType()), T.StructField("end", T.StringType())])))
def ends_of(starts: pa.Array, normal: pa.Array, normal_to: pa.Array, convert: pa.Array, convert_to: pa.Array, redirect: pa.Array, redirect_to: pa.Array) -> pa.Array:
    """Where each of a row's ``starts`` leads along the row's own edges, given as lists of sources and targets."""
    begun, ended, upto = [], [], [0]
    columns = zip(*[c.to_pylist() for c in (starts, normal, normal_to, convert, convert_to, redirect, redirect_to)], strict=True)
    for own, *edges in columns:
        steps = []
        for sources, targets in zip(edges[::2], edges[1::2], strict=True):
            leads = {}
            for f, t in zip(sources, targets, strict=True):
                if f is not None and t is not None and f != t:  # edges have no order: of several the smallest target counts
                    leads[f] = min(leads.get(f, t), t)
            steps.append(leads)
        for start in dict.fromkeys(own):
            if start is None:
                continue
            at = steps[0].get(start, start)
            at = steps[1].get(at, at)
            for _ in range(MAX_HOPS):
                if at not in steps[2]:
                    break
                at = steps[2][at]
            begun.append(start)
            ended.append(at)
        upto.append(len(begun))
    pairs = pa.StructArray.from_arrays([pa.array(begun, pa.string()), pa.array(ended, pa.string())], ["start", "end"])
    return pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pairs)


def walks(responses: DataFrame) -> DataFrame:
    """``responses`` (with query) with ``walked``, array<struct<start, end>>: where each title that a response names
    leads within it.

    A title goes through normalisation and conversion, then along at most MAX_HOPS redirects; it stays at a title that
    nothing leads on from, or that leads to itself. All of it happens inside the response's row, by look-ups in hashed
    maps of its own, so a response's work grows with its edges.
    """
    nothing = F.array().cast("array<string>")
    linked = F.greatest(*[F.coalesce(F.size(f"query.{name}"), F.lit(0)) for name in STEPS]) > 0
    titles = F.coalesce(F.transform("query.pages", lambda p: p["title"]), nothing)
    froms = [F.coalesce(F.transform(f"query.{name}", lambda e: F.when(F.coalesce(e["fromencoded"], F.lit(False)), F.url_decode(e["from"])).otherwise(e["from"])), nothing) for name in STEPS]
    to = [F.coalesce(F.transform(f"query.{name}", lambda e: e["to"]), nothing) for name in STEPS]
    own = F.array_distinct(F.filter(titles, lambda t: t.isNotNull()))
    # without an edge each title stays where it is, and Python is handed nothing
    ends = ends_of(F.when(linked, F.flatten(F.array(titles, *froms))).otherwise(nothing), *[F.when(linked, c).otherwise(nothing) for pair in zip(froms, to, strict=True) for c in pair])
    return responses.withColumn("walked", F.when(linked, ends).otherwise(F.transform(own, lambda t: F.struct(t.alias("start"), t.alias("end")))))


def scan_pages_json(spark: SparkSession, path: str, requested: DataFrame) -> DataFrame:
    """(requested_title, title, missing, page_id, rev, item, short_description, disambiguation, extract).

    Titles go through normalisation, conversion and at most ten redirects, each within its response; the place of a page in a response means
    nothing. Continued responses merge: the first non-null value of each field, in order of file name.
    """
    raw = spark.read.schema(PAGES).json(path, multiLine=True, mode="FAILFAST").select(F.input_file_name().alias("file"), "query")
    raw = written(walks(raw).select("file", "walked", F.col("query.pages").alias("pages")), "responses")
    walked = raw.select("file", F.inline("walked"))
    # merge: sizes of compressed files tell little, and a table of titles must not be sent to the driver and all tasks
    at = requested.select(F.col("title").alias("requested_title")).join(walked.hint("merge"), F.col("requested_title") == F.col("start"), "left")
    at = at.groupBy("requested_title").agg(F.min_by("end", F.struct(F.col("file").isNull().alias("n"), F.col("file"))).alias("at"))
    at = at.withColumn("at", F.coalesce("at", "requested_title"))
    p = raw.select("file", F.explode("pages").alias("p")).select("file", "p.*")
    values = {"page_id": F.col("pageid"), "rev": F.col("lastrevid"), "item": F.col("pageprops.wikibase_item"), "short_description": F.col("pageprops.wikibase-shortdesc"), "extract": F.col("extract")}
    p = p.select(
        "title", "file", (F.coalesce("missing", F.lit(False)) | F.coalesce("invalid", F.lit(False))).alias("absent"),
        F.col("pageprops.disambiguation").isNotNull().alias("disambiguation"), *[c.alias(name) for name, c in values.items()],
    )

    def first(name):
        return F.min_by(name, F.when(F.col(name).isNotNull(), F.col("file"))).alias(name)

    # a title seldom comes twice: rows move as they are and are sorted once, where sums before the move would be sorted too
    pages = p.where("title is not null").repartition("title").groupBy("title").agg(F.max("absent").alias("absent"), F.max("disambiguation").alias("disambiguation"), *map(first, values))
    out = at.join(pages.hint("merge"), at["at"] == pages.title, "left")
    return out.select("requested_title", F.coalesce("title", "at").alias("title"), F.coalesce("absent", F.lit(True)).alias("missing"), "page_id", "rev", "item", "short_description", F.coalesce("disambiguation", F.lit(False)).alias("disambiguation"), "extract")


def scan_characteristics_json(spark: SparkSession, path: str) -> DataFrame:
    """(file, field, value): named values that are not of a cultivar."""
    schema = "PlantCharacteristicName string, PlantCharacteristicValue string, PlantCharacteristicCategory string, CultivarName string, SynonymName string"
    rows = spark.read.schema(schema).json(path, multiLine=True)
    rows = rows.where("coalesce(trim(CultivarName), '') = ''").select(F.input_file_name().alias("file"), F.btrim("PlantCharacteristicName").alias("field"), F.btrim("PlantCharacteristicValue").alias("value"))
    return rows.where("field <> '' and value <> ''")


def scan_profile_json(spark: SparkSession, path: str) -> DataFrame:
    """(id, symbol, has_characteristics, durations, growth_habits) of the profiles that were found."""
    schema = "Id bigint, Symbol string, HasCharacteristics boolean, Durations array<string>, GrowthHabits array<string>"
    rows = spark.read.schema(schema).json(path, multiLine=True).where("Id <> 0 and trim(Symbol) <> ''")
    return rows.select(F.col("Id").alias("id"), F.btrim("Symbol").alias("symbol"), F.coalesce("HasCharacteristics", F.lit(False)).alias("has_characteristics"), F.coalesce("Durations", F.array().cast("array<string>")).alias("durations"), F.coalesce("GrowthHabits", F.array().cast("array<string>")).alias("growth_habits"))


IDENTIFICATIONS = """results array<struct<score:double,species:struct<scientificName:string,scientificNameWithoutAuthor:string,genus:struct<scientificNameWithoutAuthor:string>,
family:struct<scientificNameWithoutAuthor:string>,commonNames:array<string>>,images:array<struct<organ:string,url:struct<o:string,m:string,s:string>>>,gbif:struct<id:bigint>,powo:struct<id:string>>>,
predictedOrgans array<struct<filename:string,organ:string,score:double>>"""


def flatten_identifications(spark: SparkSession, path: str, uploads: DataFrame | None = None) -> dict[str, DataFrame]:
    """matches, reference_images and predicted_organs of landed identification responses.

    ``uploads`` (filename, image) are the photos that were sent, with their places; organs of other files are dropped.
    """
    raw = spark.read.schema(IDENTIFICATIONS).json(path, multiLine=True).select(F.input_file_name().alias("file"), "results", "predictedOrgans")
    r = raw.select("file", F.posexplode("results").alias("place", "r")).select("file", "place", "r.*")
    # a match needs the full name; the one without author is shown where it is given
    r = r.where("score is not null and species.scientificName <> ''")
    r = r.withColumn("name", F.coalesce(F.nullif(F.col("species.scientificNameWithoutAuthor"), F.lit("")), F.col("species.scientificName")))
    common = F.filter(F.coalesce("species.commonNames", F.array().cast("array<string>")), lambda c: F.btrim(c) != "")
    matches = r.select("file", "place", "score", "name", F.col("species.genus.scientificNameWithoutAuthor").alias("genus"), F.col("species.family.scientificNameWithoutAuthor").alias("family"), common.alias("common_names"), F.when(F.col("gbif.id") > 0, F.col("gbif.id")).alias("gbif_id"), F.nullif(F.btrim("powo.id"), F.lit("")).alias("powo_id"))
    image = r.select("file", "place", F.posexplode("images").alias("image", "i")).select("file", "place", "image", F.col("i.organ").alias("organ"), "i.url.*")

    def secure(c):
        return F.when(F.col(c).rlike("^https://"), F.col(c))

    image = image.select("file", "place", "image", "organ", F.coalesce(*map(secure, "smo")).alias("small"), F.coalesce(*map(secure, "mos")).alias("medium"), F.coalesce(*map(secure, "osm")).alias("original")).where("small is not null")
    organs = raw.select("file", F.explode("predictedOrgans").alias("o")).select("file", "o.*").where(F.col("organ").isin(*ORGANS) & F.col("score").isNotNull())
    if uploads is not None:
        organs = organs.join(uploads.select("filename", "image"), "filename")
    return {"matches": matches, "reference_images": image, "predicted_organs": organs}

"""Readers of delimited snapshots. Each checks its header exactly and returns rows and an issues table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions.text import DISTRIBUTION_KINDS, is_blank, is_snake_key, normalize_ext_id, parse_iso_date
from quernstone.operators.validate import GateClosed, check_rules, issue, split_valid
from quernstone.sources import records

# The columns of the taxonomy snapshot, in order.
TAXONOMY_COLUMNS = [
    "taxonID", "scientificNameID", "localID", "scientificName", "taxonRank", "parentNameUsageID", "scientificNameAuthorship",
    "family", "subfamily", "tribe", "subtribe", "genus", "subgenus", "specificEpithet", "infraspecificEpithet", "verbatimTaxonRank",
    "nomenclaturalStatus", "namePublishedIn", "taxonomicStatus", "acceptedNameUsageID", "originalNameUsageID", "nameAccordingToID",
    "taxonRemarks", "created", "modified", "references", "source", "majorGroup", "tplID",
]
TAXONOMY_IDENTIFIERS = ["taxonID", "scientificNameID", "localID", "parentNameUsageID", "acceptedNameUsageID", "originalNameUsageID", "nameAccordingToID", "tplID"]

SUPPLEMENTAL = {  # fixed values: header names of each kind
    "ipni": ["ipni_id", "wfo_id"],
    "deprecated": ["wfo_id", "name_canonical", "authors_string", "rank", "nomenclatural_status"],
    "deduplicated": ["wfo_id", "replacement_wfo_id", "name_canonical", "authors_string", "rank", "nomenclatural_status"],
}

SEEDS = {  # fixed values
    "trait_type": ["type_uri", "key", "label", "value_kind", "notes"],
    "code_label": ["code", "type_uri", "label", "ordinal", "confidence", "evidence"],
    "place_label": ["scheme", "place_id", "name", "kind", "country_code", "admin_code"],
}


class BadHeader(ValueError):
    """A file's header is not the expected one."""


def scan_taxonomy_tsv(spark: SparkSession, path: str, parts: bool = False) -> tuple[DataFrame, DataFrame]:
    """Quoted tab-separated taxonomy rows with dates parsed, and the issues with the row at which each record begins.

    Quoted fields may hold tabs and line breaks; files are read in splits all the same. A record with malformed quoting
    or another number of fields is rejected. With ``parts`` the files below ``path`` are one, in order of their paths.
    """
    found = records.records(spark, path, "\t", parts=parts)
    if {tuple(h.split("\t")) for h in records.heads(found)} != {tuple(TAXONOMY_COLUMNS)}:
        raise BadHeader(path)
    rows = records.fields(found, TAXONOMY_COLUMNS, "\t").drop("file")
    dates = [issue("warning", "date", c, F.col(c).isNotNull() & parse_iso_date(F.col(c)).isNull(), F.col(c)) for c in ("created", "modified")]
    broken = issue("error", "record", "_corrupt", F.col("_corrupt").isNotNull())
    good, issues = split_valid(rows, ["taxonID", "scientificName"], TAXONOMY_IDENTIFIERS, "classification", "taxonID", [broken, *dates], row="row")
    return good.drop("_corrupt", "row").withColumns({c: parse_iso_date(F.col(c)) for c in ("created", "modified")}), issues


def scan_supplemental_csv(spark: SparkSession, path: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """Rows of an id mapping, deprecated names or replacements, and the warnings; any bad row refuses the file.

    Replacements may come with the five names of deprecated ones over six fields: the second is the replacement. The
    refusal names the first bad rows.
    """
    names = SUPPLEMENTAL[kind]
    if not spark.read.text(path).where(~F.is_valid_utf8("value")).isEmpty():
        raise GateClosed(f"{path}: invalid UTF-8")
    found = records.records(spark, path, ",")
    headers = {tuple(h.replace('"', "").split(",")) for h in records.heads(found)}
    quirk = kind == "deduplicated" and headers == {tuple(SUPPLEMENTAL["deprecated"])}
    if headers != {tuple(names)} and not quirk:
        raise BadHeader(path)
    rows = records.fields(found, names, ",")
    ids = [c for c in names if c in ("wfo_id", "replacement_wfo_id")]
    wrong = F.col("_corrupt").isNotNull()
    for c in ids:
        wrong = wrong | ~F.coalesce(F.col(c).rlike(r"(?U)\Awfo-\S+\z") & ~F.contains(F.col(c), F.lit("�")), F.lit(False))
    for c in names:
        wrong = wrong | F.coalesce(F.contains(F.col(c), F.lit("\x00")), F.lit(False))
    if kind == "ipni":
        rows = rows.withColumn("normalized_id", normalize_ext_id(F.col("ipni_id")))
        wrong = wrong | is_blank(F.col("normalized_id")) | F.coalesce(F.contains(F.col("ipni_id"), F.lit("�")), F.lit(False))
    bad = rows.where(wrong).agg(F.count("*").alias("n"), F.min("row").alias("first")).first()
    if bad.n:
        raise GateClosed(f"{path}: {bad.n} bad rows, the first at {bad.first}")
    note = [(path, "warning", "header", "the second field is the replacement id")] if quirk else []
    issues = spark.createDataFrame(note, "file string, severity string, kind string, message string")
    return rows.drop("_corrupt", "file", "row"), issues


def _declared(spark: SparkSession, folder: str) -> dict[str, list[tuple[dict, list[dict]]]]:
    """Row type to the tables that an archive's descriptor declares, each with its fields in order."""
    tables: dict[str, list] = {}
    for tag in ("core", "extension", "table"):
        found = spark.read.format("xml").option("rowTag", tag).load(f"{folder}/meta.xml")
        if found.columns:
            for row in found.collect():  # a descriptor has a handful of tables
                d = row.asDict(recursive=True)
                fields = d.get("field") or []
                fields = sorted([fields] if isinstance(fields, dict) else fields, key=lambda f: int(f["_index"]))
                tables.setdefault(d.get("_rowType"), []).append((d, fields))
    return tables


def _location(table: dict) -> str | None:
    file = (table.get("files") or {}).get("location")
    return file[0] if isinstance(file, list) else file


# What each table's declaration must say.
DECLARATION = {"_encoding": "UTF-8", "_fieldsTerminatedBy": "\\t", "_linesTerminatedBy": "\\n", "_ignoreHeaderLines": "1"}


def ignored_tables(spark: SparkSession, folder: str, expected: dict[str, tuple[str, list[str]]]) -> list[tuple[str | None, str]]:
    """(file, row type) of the declared tables that are not read."""
    known = {row_type for row_type, _ in expected.values()}
    return [(_location(d), t) for t, of in _declared(spark, folder).items() if t is not None and t not in known for d, _ in of]


def scan_dwca_tsv(spark: SparkSession, folder: str, expected: dict[str, tuple[str, list[str]]], row: str | None = None, parts: bool = False) -> dict[str, tuple[DataFrame, DataFrame]]:
    """Tables of a Darwin Core Archive by name: rows, with their line numbers under the name ``row`` if that is given,
    and issues with theirs.

    ``expected`` maps our name to (row type, terms in order). The descriptor must declare exactly one table of each
    row type, UTF-8, tab and line feed, one header line, unquoted, and those terms under the indexes from 0 on. Lines
    are split as they are: quotes and backslashes are data, the first line of a file is its header, an empty line is
    skipped, a line of another width is rejected. An empty field is an empty text. With
    ``parts`` the files below a table's location are one, in order of their paths.
    """
    tables, out = _declared(spark, folder), {}
    for name, (row_type, terms) in expected.items():
        of = tables.get(row_type, [])
        if len(of) != 1:
            raise BadHeader(f"{row_type}: {len(of)} tables")
        d, fields = of[0]
        said = all(str(d.get(k)).upper() == v.upper() for k, v in DECLARATION.items()) and not d.get("_fieldsEnclosedBy")
        if not said or [int(f["_index"]) for f in fields] != list(range(len(terms))) or [f["_term"] for f in fields] != terms:
            raise BadHeader(row_type)
        file = _location(d)
        if not file or "/" in file or "\\" in file:
            raise BadHeader(f"{row_type}: {file}")
        short = [t.rsplit("/", 1)[-1].rsplit("#", 1)[-1] for t in terms]
        lines = records.numbered_lines(spark, f"{folder}/{file}", parts).where("row > 1 and value <> ''")
        lines = lines.withColumn("f", F.split("value", "\t", -1)).withColumn("fits", F.size("f") == len(short))
        number = [F.col("row").alias(row)] if row else []
        rows = lines.where("fits").select(*[F.get("f", F.lit(i)).alias(c) for i, c in enumerate(short)], *number)
        issues = lines.where("not fits").select(F.lit(file).alias("file"), F.get("f", F.lit(0)).alias("key"), "row", F.lit("error").alias("severity"), F.lit("width").alias("kind"), F.lit(None).cast("string").alias("field"), F.size("f").cast("string").alias("message"))
        out[name] = rows, issues
    return out


def seed_rules(kind: str) -> dict:
    """Named conditions that every row of a seed must meet."""
    filled = {c: ~is_blank(F.col(c)) for c in SEEDS[kind]}
    if kind == "trait_type":
        return {"type_uri": filled["type_uri"], "key": is_snake_key(F.col("key")), "label": filled["label"], "value_kind": F.col("value_kind").isin("coded", "numeric", "literal", "multi"), "distribution types are not traits": ~F.coalesce(F.col("type_uri").isin(*DISTRIBUTION_KINDS), F.lit(False))}
    if kind == "code_label":
        known = F.col("confidence").isin("verified", "inferred", "unresolved")
        return {"code": filled["code"], "confidence": known, "label": filled["label"] == (F.col("confidence") != "unresolved"), "ordinal": F.col("ordinal").isNull() | F.col("ordinal").rlike(r"^-?[0-9]+\z")}
    return {"scheme": F.col("scheme").isin("geonames", "wikidata"), "place_id": filled["place_id"], "name": filled["name"], "kind": F.col("kind").isin("state", "province", "territory", "country", "region")}


def scan_seed_csv(spark: SparkSession, path: str, kind: str, types: DataFrame | None = None) -> DataFrame:
    """A checked seed. All failures are gathered, each with file and row; the error shows the first twenty.

    Every record must have the header's width, keys must be unique (those of trait types by themselves as well), and
    overrides must name a known type.
    """
    names = SEEDS[kind]
    found = records.records(spark, path, ",")
    if {tuple(h.replace('"', "").split(",")) for h in records.heads(found)} != {tuple(names)}:
        raise BadHeader(path)
    rows = records.fields(found, names, ",")
    rows = rows.withColumn("_at", F.concat(F.lit(path.rsplit("/", 1)[-1] + ":"), F.col("row").cast("string"))).drop("file", "row")
    unique = {"trait_type": [["type_uri"], ["key"]], "code_label": [["code", "type_uri"]], "place_label": [["scheme", "place_id"]]}[kind]
    rules = {"width": F.col("_corrupt").isNull(), **seed_rules(kind)}
    broken = check_rules(rows, rules, F.concat_ws(" ", "_at", *unique[0])).orderBy("rule").collect()
    messages = [f"{r.rule}: {r.examples}" for r in broken]
    for key in unique:
        again = rows.groupBy(*key).agg(F.count("*").alias("n"), F.max("_at").alias("at")).where("n > 1").orderBy("at").limit(20).collect()
        messages += [f"{r.at}: duplicate {', '.join(key)}" for r in again]
    if kind == "code_label" and types is not None:
        lost = rows.where("type_uri is not null").join(types.select("type_uri"), "type_uri", "left_anti").orderBy("_at").limit(20).collect()
        messages += [f"{r['_at']}: {r.type_uri} is not a trait type" for r in lost]
    if messages:
        raise GateClosed("; ".join(messages[:20]) + (f" and {len(messages) - 20} more" if len(messages) > 20 else ""))
    rows = rows.drop("_corrupt", "_at")
    return rows.withColumn("ordinal", F.col("ordinal").cast("int")) if kind == "code_label" else rows


def build_place_dimension(admin1: DataFrame, countries: DataFrame, used: DataFrame, territories: list[str], extra: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The place dimension and the used ids without a label.

    ``admin1`` (place_id, name, country_code, admin_code): all divisions of the US and Canada; ``countries`` (place_id,
    name, country_code): those that facts use; ``used`` (place_id). Country codes in ``territories`` and the Canadian
    territories are of kind territory; ``extra`` rows are added as they are.
    """
    canadian = F.col("admin_code").isin("12", "13", "14")  # fixed values: the three territories
    kind = F.when(F.col("country_code") == "US", "state").when(canadian, "territory").otherwise("province")
    states = admin1.where(F.col("country_code").isin("US", "CA")).select(F.lit("geonames").alias("scheme"), "place_id", "name", kind.alias("kind"), "country_code", "admin_code")
    lands = countries.join(used.select("place_id").distinct(), "place_id", "left_semi")
    lands = lands.select(F.lit("geonames").alias("scheme"), "place_id", "name", F.when(F.col("country_code").isin(*territories), "territory").otherwise("country").alias("kind"), "country_code", F.lit(None).cast("string").alias("admin_code"))
    places = states.unionByName(lands)
    places = (places if extra is None else places.unionByName(extra)).dropDuplicates(["scheme", "place_id"])
    return places, used.select("place_id").distinct().join(places.select("place_id"), "place_id", "left_anti")


def rows_fingerprint(df: DataFrame) -> DataFrame:
    """(rows, checksum): does not depend on the order of rows.

    Each row is a line of its values as text, parted by U+001F, null as U+001E; the checksum is the sum of the first
    eight hexadecimal digits of the lines' MD5.
    """
    line = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x1e")) for c in df.columns])
    digits = F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("long")
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(digits), F.lit(0)).alias("checksum"))


def files_fingerprint(spark: SparkSession, files: dict[str, str]) -> str:
    """A hash over the SHA-256 of each small file, in order of role; each file is hashed by Spark."""
    import hashlib

    lines = []
    for role in sorted(files):
        row = spark.read.format("binaryFile").load(files[role]).select(F.sha2("content", 256).alias("h")).first()
        lines.append(f"{role}:{row.h}\n")
    return hashlib.sha256("".join(lines).encode()).hexdigest()

"""Column functions for names, codes, identifiers and titles. All but ``normalize_name`` are built-in expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Ranks from the highest to the lowest, for ordering search results.
RANKS = [
    "kingdom", "subkingdom", "phylum", "subphylum", "class", "subclass", "superorder", "order", "suborder",
    "family", "subfamily", "supertribe", "tribe", "subtribe", "genus", "subgenus", "section", "subsection", "series", "subseries",
    "species", "subspecies", "prole", "convar", "variety", "subvariety", "form", "subform", "lusus",
]
# Infraspecific ranks, words that are no epithets, and what article addresses leave as it is.
INFRASPECIFIC = ["subspecies", "variety", "subvariety", "form", "subform", "prole", "lusus", "convar"]
NOT_EPITHETS = ["ex", "in", "et", "and"]
UNRESERVED = [";", "@", "$", "!", "*", "(", ")", ",", "/", ":", "~"]

ONTOLOGY = "http://wikiba.se/ontology#"  # fixed value

_SPACES = {"\t", "\n", "\x0b", "\x0c", "\r", "\x85"}


def _normalized(text: str | None) -> str | None:
    if text is None:
        return None
    kept = (c for c in unicodedata.normalize("NFKD", text) if unicodedata.category(c) not in ("Mn", "Mc", "Me"))
    spaced = "".join(" " if c in _SPACES or unicodedata.category(c)[0] == "Z" else c for c in kept)
    one = " ".join(p for p in spaced.split(" ") if p)
    # character by character: a whole string would turn a final sigma into another letter
    return "".join(c.lower() if len(c.lower()) == 1 else c for c in one.replace("’", "'").replace("‘", "'"))


@F.pandas_udf(T.StringType())
def _normalize_any(names: pd.Series) -> pd.Series:
    return names.map(_normalized, na_action="ignore")


def normalize_ascii(c: Column) -> Column:
    return F.lower(F.btrim(F.regexp_replace(c, r"[ \t\n\x0B\f\r]+", " ")))


def is_ascii(c: Column) -> Column:
    return c.rlike(r"\A[\x00-\x7F]*\z")


def is_blank(c: Column) -> Column:
    """Null, empty, or white space of any kind."""
    return F.coalesce(c.rlike(r"(?U)\A\s*\z"), F.lit(True))


def with_normalized(df: DataFrame, source: str, target: str) -> DataFrame:
    """``df`` with the normalised ``source`` as ``target``; only rows that are not ASCII are handed to Python.

    Null names stay null. The input is read twice, each time for its share of the rows.
    """
    plain = F.coalesce(is_ascii(F.col(source)), F.lit(True))
    rest = df.where(~plain).withColumn(target, _normalize_any(F.col(source)))
    return df.where(plain).withColumn(target, normalize_ascii(F.col(source))).unionByName(rest)


def normalize_name(c: Column) -> Column:
    """NFKD without marks, single spaces, straight apostrophes, lower case.

    Spark has no Unicode normalisation, so names that are not ASCII are normalised in Python; all rows pass through
    Arrow, the ASCII ones as nulls. ``with_normalized`` keeps those out of it.
    """
    ascii_ = is_ascii(c)
    return F.when(ascii_, normalize_ascii(c)).otherwise(_normalize_any(F.when(~ascii_, c)))


def compact_name(normalized: Column) -> Column:
    return F.replace(F.replace(normalized, F.lit(" "), F.lit("")), F.lit("-"), F.lit(""))


def canonical_name(name: Column, rank: Column) -> Column:
    """The name without authorship, for genera, species and three infraspecific ranks; else null."""
    genus, epithet = r"^\p{Lu}\p{Ll}+(-\p{Ll}+)*\z", r"^\p{Ll}+(\.?-\p{Ll}+)*\z"
    parts = F.filter(F.split(name, " "), lambda p: p != "")

    def at(i):
        return F.get(parts, i)

    def is_sign(i):
        return F.coalesce(at(i).isin("×", "x", "X"), F.lit(False))

    def bare(c):
        return F.regexp_replace(c, "^×", "")

    def crossed(i, place):  # a sign of its own before the word or one attached to it
        return F.when(is_sign(i) | at(place).startswith("×"), F.lit("× ")).otherwise(F.lit(""))

    def dotless(c):
        return F.replace(c, F.lit("."), F.lit(""))

    g = F.when(is_sign(F.lit(0)), F.lit(1)).otherwise(F.lit(0))
    second = g + 1
    e = F.when(is_sign(second), second + 1).otherwise(second)
    genus_part = F.when(bare(at(g)).rlike(genus), F.concat(crossed(F.lit(0), g), bare(at(g))))
    word = bare(at(e))
    species = F.when(word.rlike(epithet) & ~word.isin(*NOT_EPITHETS), F.concat(genus_part, F.lit(" "), crossed(second, e), dotless(word)))
    out = F.when(rank == "genus", genus_part).when(rank == "species", species)
    places = F.sequence(F.lit(0), F.greatest(F.size(parts) - 2, F.lit(0)))
    for kind, marks in {"variety": ["var."], "subspecies": ["subsp.", "ssp."], "form": ["f.", "fo.", "forma"]}.items():
        # the last marker that an epithet follows: authors before it can hold the same word
        def follows(words):
            def fits(i):
                last = F.regexp_replace(at(i + 1), "^×+", "")
                return (i > e) & at(i).isin(*words) & last.rlike(epithet) & ~last.isin(*NOT_EPITHETS)

            return fits

        hit = F.array_max(F.filter(places, follows(marks)))
        out = out.when(rank == kind, F.concat(species, F.lit(f" {marks[0]} "), dotless(F.regexp_replace(at(hit + 1), "^×+", ""))))
    return out


def value_code(c: Column) -> Column:
    """Of a web address what follows the last slash or hash, else the text itself."""
    return F.when(c.rlike("^https?://"), F.regexp_replace(c, r"(?s)^.*[/#]", "")).otherwise(c)


def is_qid(c: Column) -> Column:
    return c.rlike(r"^Q[1-9][0-9]*\z")


def is_taxon_id(c: Column) -> Column:
    return c.rlike(r"^wfo-[0-9]{10}\z")


def is_symbol(c: Column) -> Column:
    return c.rlike(r"^[A-Z0-9]{1,16}\z")


def is_snake_key(c: Column) -> Column:
    return c.rlike(r"^[a-z][a-z0-9_]*\z")


def classify_place(c: Column) -> Column:
    code = value_code(c)
    scheme = F.when(code.rlike(r"^[0-9]+\z"), "geonames").when(is_qid(code), "wikidata").otherwise("literal")
    return F.struct(scheme.alias("scheme"), F.when(scheme != "literal", code).alias("place_id"))


DISTRIBUTION_KINDS = {  # fixed values
    "http://eol.org/schema/terms/Present": "Present",
    "http://eol.org/schema/terms/NativeRange": "Native",
    "http://eol.org/schema/terms/IntroducedRange": "Introduced",
}


def distribution_kind(type_uri: Column) -> Column:
    out = F.lit(None).cast("string")
    for uri, kind in DISTRIBUTION_KINDS.items():
        out = F.when(type_uri == uri, kind).otherwise(out)
    return out


def source_term(remark: Column) -> Column:
    return F.nullif(F.regexp_extract(remark, r"^Source term: ([^.\\]+)\.", 1), F.lit(""))


def parse_decimal(c: Column) -> Column:
    """Sign, decimal point and exponent only; the pattern keeps out what a cast would trim."""
    shaped = c.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z")
    return F.when(shaped, c.try_cast("decimal(38,15)"))


def parse_iso_date(c: Column) -> Column:
    return F.when(c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), c.try_cast("date"))


def normalize_ext_id(c: Column) -> Column:
    return F.regexp_replace(F.btrim(c), r"(?i)^urn:lsid:ipni\.org:names:", "")


def is_requestable_title(c: Column) -> Column:
    return ~is_blank(c) & ~c.rlike(r"[|\p{Cc}]")


def article_url(title: Column, base: str = "https://en.wikipedia.org/wiki/") -> Column:
    out = F.url_encode(F.replace(title, F.lit(" "), F.lit("_")))
    for c in UNRESERVED:
        out = F.replace(out, F.lit(f"%{ord(c):02X}"), F.lit(c))
    return F.concat(F.lit(base), out)


def lead_status(missing: Column, disambiguation: Column, item: Column, requesting: Column, lead: Column) -> Column:
    return (
        F.when(missing, "Missing")
        .when(disambiguation, "Disambiguation")
        .when(item.isNull() | ~F.coalesce(F.array_contains(requesting, item), F.lit(False)), "ItemMismatch")
        .when(is_blank(lead), "EmptyLead")
        .otherwise("Ok")
    )


def stub_flags(lead: Column) -> Column:
    short = F.length(lead) < 200
    single = lead.rlike("^[^.]+ is a (species|genus) of") & ~lead.rlike(r"[.!?]\s+\S")
    return F.struct(short.alias("short"), single.alias("single"), (short | single).alias("stub"))


def _plain_rank(rank: Column) -> Column:
    return F.regexp_replace(F.lower(rank), "^notho", "")


def rank_depth(rank: Column) -> Column:
    place = F.array_position(F.array(*[F.lit(r) for r in RANKS]), _plain_rank(rank))
    return F.coalesce(F.nullif(place, F.lit(0)) - 1, F.lit(1000)).cast("int")


def rank_bucket(rank: Column) -> Column:
    r = F.lower(rank)
    return F.when(r.isNull(), "unlinked").when(r.isin("species", "genus"), r).when(r.isin(*INFRASPECIFIC), "infraspecific").otherwise("other")


def comparable_label(c: Column) -> Column:
    return F.btrim(F.regexp_replace(c, r"\s*\([^)]*\)\s*\z", ""))


def match_tier(text: Column, query: Column) -> Column:
    """10 equal, 20 prefix, 30 after a space or hyphen, 40 elsewhere, else null; the query is no pattern."""
    t, q = F.lower(text), F.lower(query)
    after = F.contains(t, F.concat(F.lit(" "), q)) | F.contains(t, F.concat(F.lit("-"), q))
    return F.when(t == q, 10).when(F.startswith(t, q), 20).when(after, 30).when(F.contains(t, q), 40)


def empty_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def statement_rank(uri: Column) -> Column:
    out = F.lit(None).cast("string")
    for name in ("preferred", "normal", "deprecated"):
        out = F.when(uri == f"{ONTOLOGY}{name.capitalize()}Rank", name).otherwise(out)
    return out


def is_english(lang: Column) -> Column:
    return (lang == "en") | lang.startswith("en-")


def trigrams(c: Column) -> Column:
    """The distinct three-character pieces; an empty array for shorter texts."""
    n = F.length(c)
    pieces = F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substr(c, i, F.lit(3)))
    return F.when(n >= 3, F.array_distinct(pieces)).otherwise(F.array().cast("array<string>"))


def shortened(c: Column, limit: int = 80) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("…"))).otherwise(c)

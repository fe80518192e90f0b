"""A corpus pipeline of five stages: quality, near-dedup, substring dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next one's docs. All but the last return the columns of ``documents``. The quality model is trained and the benchmark
is read from the tables in ``sf_dir``; everything else is computed over all documents that reach the stage.

Every stage takes whole texts of any length, gives an empty table for an empty one, and keeps further columns as they
are, whatever their names. What null ids, null texts and repeated rows come to is said at each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm import decontamination, near_dedup, packing, quality_classifier, substring_dedup
from quernstone.llm.textarrays import free_name
from quernstone.session import table, written

QUALITY_AT = 0.3  # documents scored below go
SHINGLE = 5
SIMILARITY = 80  # per cent


def set_aside(docs: DataFrame, names: list[str]) -> tuple[DataFrame, list]:
    """``docs`` with columns that bear one of ``names`` under free names, and the selection that gives ``docs`` back."""
    moved: dict[str, str] = {}
    for c in docs.columns:
        if c.lower() in names:
            moved[c] = free_name("__aside", [*docs.columns, *moved.values()])
    return docs.withColumnsRenamed(moved), [F.col(f"`{moved.get(c, c)}`").alias(c) for c in docs.columns]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches QUALITY_AT.

    Rows are judged one by one, by their text alone, so repeated rows stay or go together. A null or empty text has the
    score of no features at all; a null id does not matter.
    """
    model = quality_classifier.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    held, back = set_aside(docs, ["score"])
    return quality_classifier.score(held, model).where(F.col("score") >= QUALITY_AT).select(*back)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the document with the smallest id.

    Rows with a null id stay, and so do texts without a word, which are like nothing. Rows that repeat an id are one
    document.
    """
    return near_dedup.deduplicated(docs, SHINGLE, SIMILARITY)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-word passages that an earlier document holds; n_chars follows the text.

    A document that loses all its words stays, with an empty text. Null ids and null texts stay as they are; rows that
    repeat an id are not earlier than one another.
    """
    held, back = set_aside(docs, ["n_words", "n_removed", "kept_sha256"])
    out = substring_dedup.without_duplicates(held)
    out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long"))
    return out.select(*back)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage.

    Rows with a null id stay, as do null and empty texts, which hold nothing. Of rows that repeat an id, all go if one
    holds a passage.
    """
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of tokenised documents and their places in training sequences.

    A null or empty text is the end id alone; rows that repeat are packed as often as they occur, null ids as well. A
    document longer than a sequence is cut into full ones and a rest.
    """
    return packing.packed(docs.select("doc_id", "text"))


STAGES = [
    ("quality classifier", quality),
    ("near-dedup", one_of_each_group),
    ("substring dedup", without_repeats),
    ("decontamination", without_benchmark),
    ("packing", sequences),
]

# SQL can express neither the classifier nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)

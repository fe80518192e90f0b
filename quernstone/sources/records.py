"""Records and lines of delimited text files, read in splits, with the line at which each begins.

Quoted fields may hold line feeds, so whether a line begins a record depends on all lines before it. At the end of a
line a reader is in one of two states: between records, or inside a quoted field. Each task therefore follows its range
of a file from both states and notes for every line, under either, at which line of the range its record began. One row
a range says how the range takes either state to its last line; composing these in the order of the ranges tells each
range its true state, its first line's number, and the record that is open where it begins. Lines that are a record by
themselves stay where they are; only the lines of the others meet, by record, wherever their ranges are cut.

A file may come in parts, as a task a range writes it: then its ranges are those of all parts in order of their paths.
Each part but the last ends with a line feed.

The lines are written once, so that the ranges are the same for all steps, however Spark would cut the files again.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.session import written

# states of the automaton inside a line
BETWEEN, PLAIN, QUOTED, CLOSED = range(4)


def line_end(pieces: list[str], inside: bool, sep: str) -> tuple[bool, bool]:
    """Whether a line, split at its quotes, ends inside a quoted field, and whether its quoting is malformed.

    A quote opens a field only where the field begins. Inside, two quotes are one; after the closing one the field must
    end. Quotes elsewhere are malformed and open nothing.
    """
    state, bad = (QUOTED if inside else BETWEEN), False
    for piece in pieces[:-1]:  # each is followed by a quote
        if state == QUOTED:
            state = CLOSED
        elif state == CLOSED and piece == "":
            state = QUOTED
        else:
            bad |= state == CLOSED and not piece.startswith(sep)
            opens = piece.endswith(sep) or (state == BETWEEN and piece == "")
            bad |= not opens
            state = QUOTED if opens else PLAIN
    rest = pieces[-1].rstrip("\r")
    return state == QUOTED, bad or (state == CLOSED and rest != "" and not rest.startswith(sep))


LINES = "file string, block long, k int, value string, at0 int, at1 int, more0 boolean, more1 boolean, bad0 boolean, bad1 boolean"


def annotated(spark: SparkSession, path: str, sep: str, quote: str = '"') -> DataFrame:
    """LINES: each line with its range (file, block) and its place ``k`` there, and for either state of the range's
    begin the place where its record began (-1: before the range), whether it ends inside a quoted field, and whether
    its quoting is malformed. A byte order mark is dropped."""
    text = spark.read.option("lineSep", "\n").text(path)
    mark = (F.col("_metadata.file_block_start") == 0) & F.startswith("value", F.lit("\ufeff"))
    value = F.when(mark, F.substring("value", 2, 2**31 - 1)).otherwise(F.col("value"))
    source = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), value.alias("value"))

    def run(batches):
        here, k, inside, opened = None, 0, [False, True], [-1, -1]
        for batch in batches:
            files, starts = batch.column(0), batch.column(1).to_numpy()
            new = np.ones(len(starts) + 1, bool)  # a task may read several ranges, one after the other
            if len(starts):
                new[1:-1] = (starts[1:] != starts[:-1]) | pc.not_equal(files.slice(1), files.slice(0, len(files) - 1)).to_numpy(zero_copy_only=False).astype(bool)
            edges = np.flatnonzero(new).tolist()
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                key = files[lo].as_py(), int(starts[lo])
                if key != here:
                    here, k, inside, opened = key, 0, [False, True], [-1, -1]
                part, n = batch.slice(lo, hi - lo), hi - lo
                value = part.column(2)
                quoted = np.flatnonzero(pc.match_substring(value, quote).to_numpy(zero_copy_only=False).astype(bool)).tolist()
                split = [value[i].as_py().split(quote) for i in quoted]
                columns = [part.column(0), part.column(1), pa.array(np.arange(k, k + n, dtype=np.int32)), value]
                found = []
                for s in (0, 1):
                    at, more, bad, done = np.arange(k, k + n, dtype=np.int32), np.zeros(n, bool), np.zeros(n, bool), 0
                    for i, pieces in zip([*quoted, n], [*split, None], strict=True):
                        if inside[s]:  # the lines before this one have no quote
                            at[done:i], more[done:i] = opened[s], True
                        if pieces is None:
                            break
                        if inside[s]:
                            at[i] = opened[s]
                        else:
                            opened[s] = k + i
                        inside[s], bad[i] = line_end(pieces, inside[s], sep)
                        more[i], done = inside[s], i + 1
                    found.append((at, more, bad))
                columns += [pa.array(found[s][c]) for c in range(3) for s in (0, 1)]
                yield pa.RecordBatch.from_arrays(columns, names=["file", "block", "k", "value", "at0", "at1", "more0", "more1", "bad0", "bad1"])
                k += n

    return written(source.mapInArrow(run, LINES), "lines")


STARTS = "file string, block long, inside boolean, first long, opened long, lost long"


def begun(lines: DataFrame, parts: bool = False) -> DataFrame:
    """STARTS of each range: its true state, the number of its first line, the first line of the record that is open
    there, and that of a record which the file never closes (else -1).

    The ranges of one file, or with ``parts`` of all of them, are composed in one task, from a row each.
    """
    per = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.max_by(F.struct("at0", "at1", "more0", "more1"), "k").alias("last")).select("file", "block", "n", "last.*")

    def compose(table: pd.DataFrame) -> pd.DataFrame:
        inside, first, opened, out = False, 1, -1, []
        for r in table.sort_values(["file", "block"]).itertuples():
            out.append((r.file, r.block, inside, first, opened))
            at, more = (r.at1, r.more1) if inside else (r.at0, r.more0)
            opened = opened if at < 0 else first + at
            inside, first = bool(more), first + r.n
        return pd.DataFrame(out, columns=["file", "block", "inside", "first", "opened"]).assign(lost=opened if inside else -1)

    return written(per.groupBy(*([] if parts else ["file"])).applyInPandas(compose, STARTS), "starts")


def records(spark: SparkSession, path: str, sep: str, quote: str = '"', parts: bool = False) -> DataFrame:
    """(file, row, value, bad): every record of the files under ``path``, the header included, with the number of the
    line at which it begins (from 1), its text, and whether its quoting is malformed.

    Empty lines between records are none. A carriage return at a record's end is dropped. A record that its file never
    closes is malformed and has no text: it may be all the rest of the file, which is not gathered. With ``parts`` the
    files are one, in order of their paths, and ``file`` is ``path``.
    """
    lines = annotated(spark, path, sep, quote)
    starts = begun(lines, parts)
    of = F.col("inside")
    file = F.lit(path).alias("file") if parts else F.col("file")
    rows = lines.join(starts, ["file", "block"]).withColumns({c: F.when(of, F.col(f"{c}1")).otherwise(F.col(f"{c}0")) for c in ("at", "more", "bad")})
    rows = rows.select(file, F.when(F.col("at") < 0, F.col("opened")).otherwise(F.col("first") + F.col("at")).alias("row"), (F.col("first") + F.col("k")).alias("line"), "value", "bad", ((F.col("at") == F.col("k")) & ~F.col("more")).alias("whole"), "lost")
    plain = F.regexp_replace("value", "\r$", "")
    single = rows.where("whole").select("file", "row", F.when(F.endswith("value", F.lit("\r")), plain).otherwise(F.col("value")).alias("value"), "bad").where("value <> ''")
    cut = rows.where("not whole and row <> lost").groupBy("file", "row").agg(F.array_sort(F.collect_list(F.struct("line", "value"))).alias("l"), F.max("bad").alias("bad"))
    several = cut.select("file", "row", F.regexp_replace(F.array_join("l.value", "\n"), "\r$", "").alias("value"), "bad")
    lost = starts.where("lost >= 0").select(file, F.col("lost").alias("row"), F.lit(None).cast("string").alias("value"), F.lit(True).alias("bad")).distinct()
    return single.unionByName(several).unionByName(lost)


def heads(found: DataFrame) -> list[str]:
    """The distinct header records of all files: each begins with one."""
    return [r.value or "" for r in found.where("row = 1").select("value").distinct().limit(20).collect()]


def fields(found: DataFrame, names: list[str], sep: str, quote: str = '"', corrupt: str = "_corrupt") -> DataFrame:
    """``found`` without the headers as columns ``names``, with file, row and ``corrupt``: the text of a record that is
    malformed or has another number of fields, else null. An empty field is null."""
    schema = ", ".join(f"`{n}` string" for n in [*names, corrupt])
    options = {"sep": sep, "quote": quote, "escape": quote, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt, "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    # written, as filters on the fields would else parse a record again for each field that they name
    rows = written(found.where("row > 1").withColumn("__f", F.from_csv("value", schema, options)), "fields")
    broken = F.when(F.col("bad"), F.coalesce("value", F.lit(""))).otherwise(F.col(f"__f.{corrupt}"))
    return rows.select("file", "row", *[F.nullif(F.col(f"__f.`{n}`"), F.lit("")).alias(n) for n in names], broken.alias(corrupt))


def numbered_lines(spark: SparkSession, path: str, parts: bool = False) -> DataFrame:
    """(file, row, value): every line of the files under ``path`` with its number from 1; read in splits. With ``parts``
    the files are one, in order of their paths, and their lines are numbered through.

    Lines are written with their places in the order in which tasks read them; one row a range tells how many lines
    come before it in its file.
    """
    text = spark.read.option("lineSep", "\n").text(path)
    lines = written(text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value"), "lines")
    per = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    upto = Window.partitionBy(*([] if parts else ["file"])).orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(per.select("file", "block", (F.coalesce(F.sum("n").over(upto), F.lit(0)) - F.col("least") + 1).alias("shift")), "starts")
    return lines.join(starts, ["file", "block"]).select("file", (F.col("id") + F.col("shift")).alias("row"), "value")

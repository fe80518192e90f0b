"""Packing tokenised documents into training sequences by best-fit decreasing.

A document longer than a sequence is first cut into full windows, each a sequence of its own. What remains is sorted
by falling length and each piece goes into the open window with the least remaining capacity that holds it, found in
a segment tree over capacities. Pieces are dealt by a hash into groups of a bounded number, packed apart.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.textarrays import blocks
from quernstone.llm.tokens import WordTable
from quernstone.session import written

CAPACITY = 4096
END_ID = 2
GROUP = 10_000  # pieces packed together
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_TABLES: dict[str, WordTable] = {}


def cut(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): every document's ids, closed by ``end_id``, in pieces.

    A null or empty text is the end id alone.
    """

    def run(batches):
        if path not in _TABLES:  # a Python worker serves many tasks
            _TABLES[path] = WordTable(path)
        for batch in batches:
            for lo, hi, buf, offs in blocks(batch.column(1)):
                ids, ends = _TABLES[path].encode(buf, offs, end_id)
                n = np.diff(ends)
                parts = -(-n // capacity)
                row = np.repeat(np.arange(hi - lo), parts)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)) * capacity
                length = np.minimum(n[row] - start, capacity)
                raw = memoryview(ids).cast("B")
                at = (ends[:-1][row] + start) * 4
                crc = [zlib.crc32(raw[a : a + k]) for a, k in zip(at.tolist(), (length * 4).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + lo)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(n[row])], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


class Capacities:
    """A segment tree over remaining capacities: how many open windows have each, and the tightest that fits."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.size)
        self.open: dict[int, list[int]] = {}

    def put(self, room: int, window: int) -> None:
        self.open.setdefault(room, []).append(window)
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """The window with the least room of at least ``need``, as (room, window); it is no longer open."""
        tree, at = self.tree, need + self.size
        while not tree[at]:
            while at & 1:  # a right child: all to its right is under a right sibling of an ancestor
                at >>= 1
            if at == 0:
                return None
            at += 1
        while at < self.size:
            at = 2 * at if tree[2 * at] else 2 * at + 1
        room = at - self.size
        self._add(room, -1)
        return room, self.open[room].pop()

    def _add(self, room: int, n: int) -> None:
        at = room + self.size
        while at:
            self.tree[at] += n
            at >>= 1


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The window and the offset in it of each piece."""
    window, offset = np.empty(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    rooms, opened = Capacities(capacity), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        got = rooms.take(n)
        if got is None:
            got, opened = (capacity, opened), opened + 1
        room, window[i] = got
        offset[i] = capacity - room
        if room > n:
            rooms.put(room - n, int(window[i]))
    return window, offset


def packed(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, group: int = GROUP) -> DataFrame:
    """The pieces of :func:`cut` with sequence_id and offset.

    Repeated rows are packed as often as they occur. Sequence ids are unique but have gaps.
    """
    pieces = written(cut(docs, path or tokenizer_path(), capacity, end_id), "pieces")
    groups = max(1, -(-pieces.count() // group))

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
        window, offset = best_fit_decreasing(table.column("length").to_numpy(), capacity)
        lot = table.column("lot").to_numpy() << 32
        return table.drop_columns(["lot"]).append_column("sequence_id", pa.array(lot + window)).append_column("offset", pa.array(offset))

    # the row number parts rows that repeat; it is the same whenever a task reads its share of the written table again
    dealt = pieces.withColumn("lot", F.pmod(F.xxhash64("doc_id", "start", F.monotonically_increasing_id()), F.lit(groups)).cast("long"))
    fields = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    return dealt.groupBy("lot").applyInArrow(pack, f"{fields}, sequence_id long, offset long")


def op6(docs: DataFrame) -> DataFrame:
    """The pieces of every document and where they lie; see the contract of this operator."""
    return packed(docs.select("doc_id", "text"))

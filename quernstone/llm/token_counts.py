"""Token counts by offset-mapped attribution.

A whole document is encoded once. The tokenizer is byte-level and loses nothing, so running sums of the tokens' byte
lengths are their offsets, which are mapped to characters. The tokens' character spans are then joined with the
spans of the document's sections (its lines) in order, and a token that crosses a boundary is given to the section
that holds its first character that is no line feed; a token of line feeds alone goes to the section before it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quernstone.llm.textarrays import blocks

TOKENIZER = "byte_bpe_50k.tiktoken"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_ENCODINGS: dict[str, tuple] = {}


def encoding(path: str):
    """The tokenizer and the byte length of each id; a Python worker makes them once."""
    if path not in _ENCODINGS:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for piece, rank in ranks.items():
            lengths[rank] = len(piece)
        newline = np.array([False] * len(lengths))
        lead = np.zeros(len(lengths), np.int64)  # line feeds at the start of each token
        for piece, rank in ranks.items():
            lead[rank] = len(piece) - len(piece.lstrip(b"\n"))
            newline[rank] = lead[rank] == len(piece)
        _ENCODINGS[path] = tiktoken.Encoding("whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths, lead, newline
    return _ENCODINGS[path]


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, section, start, n_chars, n_tokens): a row a line of each text, in characters.

    The counts of a document's sections add up to its number of tokens. A null or empty text has one empty section
    without tokens. Repeated rows give repeated rows.
    """
    path = path or tokenizer_path()

    def run(batches):
        coder, lengths, lead, newline = encoding(path)
        for batch in batches:
            for lo, hi, buf, offs in blocks(batch.column(1)):
                rows, section, start, chars, tokens = [], [], [], [], []
                for r in range(hi - lo):
                    raw = buf[offs[r] : offs[r + 1]]
                    text = raw.tobytes().decode("utf-8", "replace")
                    raw = np.frombuffer(text.encode(), np.uint8)
                    ids = np.array(coder.encode_ordinary(text), np.int64)
                    place = np.zeros(len(raw) + 1, np.int64)  # byte offset to character offset
                    np.cumsum((raw & 0xC0) != 0x80, out=place[1:])
                    begins = np.r_[0, np.flatnonzero(raw == 10) + 1]
                    first = np.cumsum(lengths[ids]) - lengths[ids]
                    owned = place[np.where(newline[ids], first, first + lead[ids])]
                    at = np.searchsorted(place[begins], owned, "right") - 1
                    rows += [lo + r] * len(begins)
                    section.append(np.arange(len(begins)))
                    start.append(place[begins])
                    chars.append(np.diff(place[np.r_[begins, len(raw)]]))
                    tokens.append(np.bincount(at, minlength=len(begins)))
                parts = [pa.array(np.concatenate(x).astype(np.int64)) for x in (section, start, chars, tokens)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), *parts], names=["doc_id", "section", "start", "n_chars", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, section long, start long, n_chars long, n_tokens long")


def op5(docs: DataFrame) -> DataFrame:
    """The tokens of each line of every document."""
    return token_counts(docs)

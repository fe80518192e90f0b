"""Token ids of whole texts with a word-end BPE tokenizer, one encoding a distinct word.

The tokenizer lower-cases, drops white space and never joins what white space parts; between a letter or digit and
a run of ASCII punctuation it always parts as well. So a text's ids are its pieces' ids in order, and each task
encodes a distinct piece once and keeps it. Pieces are told apart by all their bytes. A worker's table is dropped when
it has grown to ``MOST`` pieces; that costs time only. A word that holds one of the tokenizer's own added tokens is
one piece, is encoded as it is written and is not kept.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np

from quernstone.llm.textarrays import LOW_BYTES, Words, eights, folded, mix

MOST = 1_000_000  # pieces that a worker keeps, in about 40 bytes each
SHORT = 16  # bytes up to which a piece is compared as two numbers; longer ones are looked up as they are

_PUNCT = np.zeros(256, bool)
_PUNCT[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) != "'"]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[c for c in range(0x80) if chr(c).isalnum()]] = True
# letters of two bytes from U+00C0 to U+017F by code point: those whose lower case is one letter
_LATIN = np.zeros(1 << 11, bool)
_LATIN[[c for c in range(0xC0, 0x180) if chr(c).isalpha() and len(chr(c).lower()) == 1 and chr(c).lower().isalpha()]] = True


class WordTable:
    """Ids of pieces: short ones by a hash that their bytes confirm, long ones by their bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.small = self.tokenizer.get_vocab_size() <= 1 << 16
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # sorted
        self.low, self.high, self.begin, self.count = self.keys, self.keys, np.zeros(0, np.int32), np.zeros(0, np.uint8)
        self.flat = np.zeros(0, np.uint16)

    def ids_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and their number for each."""
        out, count = [], np.empty(len(texts), np.int64)
        for lo in range(0, len(texts), 4096):
            got = [e.ids for e in self.tokenizer.encode_batch_fast(texts[lo : lo + 4096], add_special_tokens=False)]
            count[lo : lo + len(got)] = [len(i) for i in got]
            out.append(np.fromiter(chain.from_iterable(got), np.int32))
        ids = np.concatenate([np.zeros(0, np.int32), *out])
        return ids.astype(np.uint16) if self.small else ids, count

    def encode(self, buf: np.ndarray, offs: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, each closed by ``end_id``, and the offset of each row in them."""
        words, first, special = pieces(buf, offs, self.added)
        same = comparable(words)
        n = words.ends - words.starts
        short = (n <= SHORT) & ~special
        view = eights(same)
        low = view[words.starts] & LOW_BYTES[np.minimum(n, 8)]
        high = view[np.minimum(words.starts + 8, len(buf))] & LOW_BYTES[np.clip(n - 8, 0, 8)]
        key = mix(mix(low + n.astype(np.uint64)) ^ high)
        key[~short] = 0  # none of these is looked up by its hash
        if len(self.keys) > MOST:
            self.clear()
        some, at, back = np.unique(key, return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, some)
        inside = place < len(self.keys)
        known = np.zeros(len(some), bool)
        known[inside] = self.keys[place[inside]] == some[inside]
        new = at[~known & short[at]]
        if len(new):
            self.add(key[new], low[new], high[new], _texts(buf, words, new))
            place = np.searchsorted(self.keys, some)
        found = np.minimum(place, max(len(self.keys) - 1, 0))[back]
        if len(self.keys):
            count, begin = self.count[found].astype(np.int64), self.begin[found].astype(np.int64)
            sure = short & (self.low[found] == low) & (self.high[found] == high)
        else:
            count, begin, sure = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64), np.zeros(len(n), bool)
        flat, rest = self.flat, np.flatnonzero(~sure)
        if len(rest):  # long pieces, and a short one whose hash another one has
            raw, own, first_of, which = (same.tobytes(), buf.tobytes()), {}, [], np.empty(len(rest), np.int64)
            for j, i in enumerate(rest.tolist()):
                piece = raw[int(special[i])][words.starts[i] : words.ends[i]]
                k = own.setdefault((bool(special[i]), piece), len(own))
                if k == len(first_of):
                    first_of.append(i)
                which[j] = k
            ids, c = self.ids_of(_texts(buf, words, first_of))
            count[rest], begin[rest] = c[which], (len(flat) + np.cumsum(c) - c)[which]
            flat = np.concatenate([flat, ids])
        upto = np.zeros(len(count) + 1, np.int64)
        np.cumsum(count, out=upto[1:])
        rows = len(offs) - 1
        ends = upto[first] + np.arange(rows + 1)
        out = np.full(upto[-1] + rows, end_id, "<u4")
        source = np.arange(upto[-1]) + np.repeat(begin - upto[:-1], count)
        out[np.arange(upto[-1]) + np.repeat(np.arange(rows), np.diff(upto[first]))] = flat[source]
        return out, ends

    def add(self, keys: np.ndarray, low: np.ndarray, high: np.ndarray, texts: list[str]) -> None:
        ids, count = self.ids_of(texts)
        begin = len(self.flat) + np.cumsum(count) - count
        self.flat = np.concatenate([self.flat.astype(ids.dtype), ids])
        at = np.searchsorted(self.keys, keys)
        for name, more in (("low", low), ("high", high), ("begin", begin), ("count", count), ("keys", keys)):
            setattr(self, name, np.insert(getattr(self, name), at, more))


def _texts(buf: np.ndarray, words: Words, which) -> list[str]:
    raw = buf.tobytes()
    return [raw[a:b].decode("utf-8", "replace") for a, b in zip(words.starts[which].tolist(), words.ends[which].tolist(), strict=True)]


def pieces(buf: np.ndarray, offs: np.ndarray, added: list[bytes]) -> tuple[Words, np.ndarray, np.ndarray]:
    """The words of a block with punctuation at their end as pieces of its own, the offset of each row in them, and
    which pieces hold one of the texts ``added``.

    The part before must end in an ASCII letter or digit or in a letter of U+00C0 to U+017F whose lower case is one
    letter, which the tokenizer never keeps together with punctuation; else the word stays whole, and so does one that
    holds an added text. (The lower case of U+0130 ends in a mark, which goes with the punctuation.)
    """
    words = Words(buf, offs)
    if not len(words):
        return words, words.first, np.zeros(0, bool)
    special = holding(words, added)
    last = np.where(_PUNCT[buf], -1, np.arange(len(buf)))
    cut = np.maximum(np.maximum.accumulate(last)[words.ends - 1] + 1, words.starts)
    before, lead = buf[np.maximum(cut - 1, 0)], buf[np.maximum(cut - 2, 0)]
    point = ((lead & 0x1F).astype(np.int64) << 6) | (before & 0x3F)
    latin = (before & 0xC0 == 0x80) & (lead & 0xE0 == 0xC0) & _LATIN[point]
    two = (cut > words.starts) & (cut < words.ends) & (_ALNUM[before] | latin) & ~special
    count = 1 + two
    first = np.zeros(len(count) + 1, np.int64)
    np.cumsum(count, out=first[1:])
    starts, ends = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
    starts[first[:-1]], ends[first[1:] - 1] = words.starts, words.ends
    starts[first[:-1][two] + 1] = cut[two]
    ends[first[:-1][two]] = cut[two]
    rows = first[words.first]
    words.starts, words.ends, words.first = starts, ends, rows
    return words, rows, np.repeat(special, count)


def holding(words: Words, texts: list[bytes]) -> np.ndarray:
    """Which words hold one of ``texts``, none of which has a separator."""
    out, raw = np.zeros(len(words), bool), words.buf.tobytes()
    for text in texts:
        at = raw.find(text)
        while at >= 0:
            k = int(np.searchsorted(words.starts, at, "right")) - 1
            if k >= 0 and at + len(text) <= words.ends[k]:  # else it lies across two rows
                out[k] = True
            at = raw.find(text, at + 1)
    return out


def comparable(words: Words) -> np.ndarray:
    """The bytes with A-Z as a-z, but not in pieces with characters beyond U+017F.

    There a combining mark could compose with one case of a letter only.
    """
    low = folded(words.buf)
    if (words.buf >= 0xC6).any():
        high = np.zeros(len(words.buf) + 1, np.int64)
        np.cumsum(words.buf >= 0xC6, out=high[1:])
        for i in np.flatnonzero(high[words.ends] > high[words.starts]).tolist():
            low[words.starts[i] : words.ends[i]] = words.buf[words.starts[i] : words.ends[i]]
    return low

"""Vectorised word and shingle hashing over the UTF-8 bytes of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: The bytes that separate words: space and \t \n \v \f \r.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
WHITE = b" \t\n\x0b\x0c\r"
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Texts are hashed in groups of about so many bytes, which bounds the arrays at about 100 bytes for each of them.
GROUP_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the words in `buf`."""
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = ~SPACE[buf]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: polynomial over its bytes, finalised."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    power = np.full(int(lengths.max()), _BASE | np.uint64(1))
    power[0] = 1
    power = np.multiply.accumulate(power)
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    inside = ~SPACE[buf]
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    term = (buf[inside].astype(np.uint64) + np.uint64(1)) * power[place]
    return mix(np.add.reduceat(term, first) + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Words:
    """The words of a group of texts: offsets in one buffer, hashes, and where each text's words begin."""

    def __init__(self, texts: list[bytes]):
        self.data = b" ".join(texts)
        buf = np.frombuffer(self.data, np.uint8)
        self.starts, self.ends = word_spans(buf)
        self.hash = word_hashes(buf, self.starts, self.ends)
        edge = np.cumsum([0] + [len(t) + 1 for t in texts])
        self.bounds = np.searchsorted(self.starts, edge)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of `n` words, and which of them stay within one text (by position of the first word)."""
        total = max(0, len(self.hash) - n + 1)
        out = np.zeros(total, np.uint64)
        for j in range(n):
            out += self.hash[j : j + total] * np.uint64(pow(0xA0761D6478BD642F, j, 1 << 64))
        owner = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))
        whole = owner[: total] == owner[n - 1 : n - 1 + total] if total else np.zeros(0, bool)
        return mix(out), whole


def utf8(column: pa.Array) -> list[bytes]:
    """The column's texts as bytes, null as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def groups(batch: pa.RecordBatch, name: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of `batch` with about GROUP_BYTES of text each, and the texts; a longer text comes alone."""
    begin, size, texts = 0, 0, []
    every = utf8(batch.column(name))
    for i, t in enumerate(every):
        if texts and size + len(t) > GROUP_BYTES:
            yield batch.slice(begin, i - begin), texts
            begin, size, texts = i, 0, []
        texts.append(t)
        size += len(t)
    if texts:
        yield batch.slice(begin), texts

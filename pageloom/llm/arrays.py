"""Text primitives over Arrow columns: words, lines, and hashes of both, without a loop per row.

A column's texts lie one after the other in one buffer of UTF-8 bytes, so a
batch of texts is one numpy array with a list of borders. :func:`slices` cuts
batches into pieces of about :data:`PIECE` bytes; only a text longer than that
makes a larger piece, which takes some forty bytes of memory per byte of text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE = 1 << 19
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64

# Bytes of a word, with A-Z lowered; 0 where a byte is not of a word.
WORD = np.zeros(256, np.uint8)
WORD[0x30:0x3A] = np.arange(0x30, 0x3A)
WORD[0x61:0x7B] = np.arange(0x61, 0x7B)
WORD[0x41:0x5B] = np.arange(0x61, 0x7B)
WORD[0x80:] = np.arange(0x80, 0x100)

_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _grow(n: int) -> None:
    global _powers, _inverse
    if len(_powers) < n:
        with np.errstate(over="ignore"):
            _powers = np.concatenate([[np.uint64(1)], np.full(n, _BASE, np.uint64)]).cumprod(dtype=np.uint64)
            _inverse = np.concatenate([[np.uint64(1)], np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)]).cumprod(dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def slices(batch: pa.RecordBatch, column: str, piece: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts hold about ``piece`` bytes."""
    ends = np.cumsum(_lengths(batch.column(column)))
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + piece, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def _lengths(texts: pa.Array) -> np.ndarray:
    return np.diff(text_buffer(texts)[1])


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the border of each; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if pa.types.is_null(texts.type):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, borders, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    borders = np.frombuffer(borders, np.int64 if wide else np.int32)[texts.offset: texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[borders[0]: borders[-1]], borders - borders[0]


@dataclass
class Spans:
    """Words or lines of many texts: byte ranges, hashes, and the first span of each text."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # one more than there are texts

    @property
    def text(self) -> np.ndarray:
        """The number of the text each span is of."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def _hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _grow(len(values) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values.astype(np.uint64) * _powers[: len(values)], out=sums[1:])
        return mix((sums[end] - sums[start]) * _inverse[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words(buffer: np.ndarray, borders: np.ndarray) -> tuple[Spans, np.ndarray]:
    """Words of each text (runs of digits, letters and bytes beyond ASCII), and the lowered bytes."""
    low = WORD[buffer]
    inside = low != 0
    begins, ends = inside.copy(), inside.copy()
    if len(buffer):
        fresh = np.zeros(len(buffer), bool)
        fresh[borders[:-1][borders[:-1] < len(buffer)]] = True
        begins[1:] &= ~inside[:-1] | fresh[1:]
        ends[:-1] &= ~inside[1:] | fresh[1:]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Spans(start, end, _hashes(low, start, end), np.searchsorted(start, borders)), low


def lines(buffer: np.ndarray, borders: np.ndarray) -> Spans:
    """Lines of each text without their line feeds; an empty text has one empty line."""
    breaks = np.flatnonzero(buffer == 10)
    start = np.sort(np.concatenate([borders[:-1], breaks + 1]), kind="stable")
    end = np.sort(np.concatenate([breaks, borders[1:]]), kind="stable")
    # A line feed that ends a text begins an empty line at the border, before the next text's first.
    first = np.concatenate([[0], np.cumsum(1 + np.diff(np.searchsorted(breaks, borders)))])
    return Spans(start, end, _hashes(buffer.astype(np.uint16) + 1, start, end), first)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each ``k`` neighbours; the last ``k - 1`` positions have none and are cut."""
    n = max(0, len(hashes) - k + 1)
    with np.errstate(over="ignore"):
        out = hashes[:n].copy()
        for j in range(1, k):
            out *= np.uint64(0xC2B2AE3D27D4EB4F)
            out += hashes[j: j + n]
        return mix(out + np.uint64(k))


def shingles(spans: Spans, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct word ``k``-shingles of each text: (number of the text, hash), sorted by both.

    A text of fewer words, but not none, has its words in order as its one shingle.
    """
    of, count = spans.text, np.diff(spans.first)
    whole = grams(spans.hash, k)
    inside = np.arange(len(whole)) + k <= spans.first[1:][of[: len(whole)]]
    text, value = [of[: len(whole)][inside]], [whole[inside]]
    for m in range(1, k):
        short = np.flatnonzero(count == m)
        if len(short):
            text.append(short)
            value.append(grams(spans.hash, m)[spans.first[short]])
    text, value = np.concatenate(text), np.concatenate(value)
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    return text[new], value[new]

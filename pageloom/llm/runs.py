"""Periodic runs of words, found online by diagonals.

A text is read word by word. A *diagonal* is a lag ``q`` at which the words
agree with those ``q`` before them; its length grows by one with each word that
agrees, and it ends with the first that does not. A diagonal that ends with at
least ``q`` agreeing words, and ``shortest - q`` of them, has passed a run of
period ``q``, which is emitted there and then.

Only few diagonals are ever opened. A run of period ``q`` has ``q`` agreeing
words in a row, so the last ``k <= q`` of them are a word sequence that stands
``q`` words earlier too. Lags are taken in octaves ``k .. 2k-1``, and a
diagonal of an octave opens where the ``k`` words ending at a word have an earlier
occurrence at such a lag; occurrences are exact names of sequences, doubled from
octave to octave, and an octave without repeated sequences ends the search. A
text that repeats nothing opens nothing. Two facts keep texts that repeat a lot
from opening a diagonal for every pair of occurrences:

* While a diagonal of lag ``p`` has agreed for ``m > p`` words, a lag ``q``
  between ``p`` and ``m`` cannot be the smallest period of a run that has begun
  before; if a run of period ``q`` has begun inside the other one, fewer than
  ``p`` of its words have agreed so far and it is found after the other's end.
* If the ``k`` words have a period ``r <= k/2`` themselves, what agrees at a
  greater lag ends where one of the two stretches of period ``r`` does. Such
  lags are looked up at these ends only.

The memory of a text is a few numbers for each word and octave.

Defined results: a null or empty text has no words, no runs and an empty
collapsed text. Rows repeated or with a null key are texts of their own. Extra
columns are not read.
"""

from __future__ import annotations

from array import array
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pageloom.llm.arrays import slices
from pageloom.llm.tables import bare

SHORTEST = 12  # words of a run at least


def _named(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Numbers of pairs: equal where both parts are equal."""
    return np.unique(left * (int(right.max()) + 1) + right, return_inverse=True)[1]


def _lengthened(names: np.ndarray, length: int, words: np.ndarray, more: int) -> np.ndarray:
    """Names of sequences of ``length`` words to names of those of ``length + more``."""
    for j in range(more):
        names = _named(names[:-1], words[length + j:])
    return names


class _Octave:
    """Where the sequences of ``k`` words that end at each word stand, for lags ``low .. high``."""

    def __init__(self, k: int, low: int, high: int, names: np.ndarray):
        self.k, self.low, self.high = k, low, high
        order = np.argsort(names, kind="stable")
        fresh = np.ones(len(order), bool)
        fresh[1:] = names[order[1:]] != names[order[:-1]]
        places = order + (k - 1)  # the words that sequences end at
        near = ~fresh
        near[1:] &= places[1:] - places[:-1] <= high
        self.repeats = not fresh.all()
        self.wanted = places[near]
        if len(self.wanted):
            rank = np.full(len(names) + k - 1, -1, np.int32)
            rank[self.wanted] = np.flatnonzero(near)
            first = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
            self.places, self.rank, self.first = (array("i", x.astype(np.int32).tobytes()) for x in (places, rank, first))

    def lags(self, i: int, least: int) -> list[int]:
        """The lags, from ``least`` on, at which the words ending at ``i`` stand earlier; ascending."""
        rank, places, out = self.rank[i], self.places, []
        first = self.first[rank]
        at = bisect_right(places, i - least, first, rank) - 1
        while at >= first and i - places[at] <= self.high:
            out.append(i - places[at])
            at -= 1
        return out


def _octaves(words: np.ndarray, shortest: int) -> list[_Octave]:
    n, k, low = len(words), (shortest + 1) // 2, 1
    names = _lengthened(words, 1, words, k - 1)
    out = []
    while True:
        octave = _Octave(k, low, 2 * k - 1, names)
        if len(octave.wanted):
            out.append(octave)
        low = 2 * k
        if not octave.repeats or 2 * low > n:
            return out
        names, k = _named(names[:-k], names[k:]), low


def _agreed(words: np.ndarray, i: int, q: int, known: int = 0) -> int:
    """How many words in a row, back from ``i``, agree with those ``q`` before them, ``known`` of them being known to."""
    step = 16
    while known <= i - q:
        low, high = max(q, i - known - step + 1), i - known + 1
        differ = np.flatnonzero(words[low:high] != words[low - q: high - q])
        if len(differ):
            return known + high - low - 1 - int(differ[-1])
        known, step = known + high - low, 2 * step
    return known


def runs(words: np.ndarray, shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of every run of a text whose words are numbers, in order of start and period."""
    n = len(words)
    octaves = _octaves(words, shortest) if n >= shortest else []
    if not octaves:
        return []
    calls = np.unique(np.concatenate([o.wanted for o in octaves])).tolist()
    ids = array("q", words.astype(np.int64).tobytes())
    found: list[tuple[int, int, int]] = []
    active: dict[int, int] = {}  # lag -> words agreed
    ends: dict[int, list[int]] = {}  # lag -> where its stretches ended
    at, i = 0, -1
    while True:
        if active:
            i += 1
        else:
            at = bisect_right(calls, i, at)
            if at == len(calls):
                break
            i = calls[at]
        for q in list(active):
            if i < n and ids[i] == ids[i - q]:
                active[q] += 1
                continue
            agreed = active.pop(q)
            if agreed >= q:
                ends.setdefault(q, []).append(i - 1)
                if agreed + q >= shortest:
                    found.append((i - agreed - q, agreed + q, q))
        if i >= n:
            break
        squares = sorted((p, m) for p, m in active.items() if m >= p)
        for octave in octaves:
            if i >= len(octave.rank) or octave.rank[i] < 0:
                continue
            k, least, own = octave.k, octave.low, 0
            for p, m in squares:
                if p < least < m:
                    least = m
                if k >= shortest and not own and 2 * p <= k <= m + p:
                    own = p  # the period of the k words, where it is short
            if least > octave.high:
                continue
            if own and i + 1 < n and ids[i + 1] == ids[i + 1 - own]:
                lags = []
                for end in reversed(ends.get(own, ())):
                    if i - end > octave.high:
                        break
                    if i - end >= least and _agreed(words, i, i - end) >= k:
                        lags.append(i - end)
            else:
                lags = octave.lags(i, least)
            for q in lags:
                if q in active or any(p < q < m for p, m in squares):
                    continue
                active[q] = m = _agreed(words, i, q, k)
                if m >= q:
                    squares = sorted([*squares, (q, m)])
        if len(active) > 1:
            for q in [q for q, agreed in active.items() if any(p < q < m and agreed >= p for p, m in squares)]:
                del active[q]
    return sorted(found, key=lambda r: (r[0], r[2]))


def _scanned(batches: Iterator[pa.RecordBatch], shortest: int) -> Iterator[pa.RecordBatch]:
    shape = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for batch in batches:
        for part in slices(batch, "text"):
            counts, every, collapsed = [], [], []
            for text in part.column("text").to_pylist():
                words = text.split() if text else []  # bytes part at ASCII white space only
                numbers = {w: j for j, w in enumerate(dict.fromkeys(words))}
                here = runs(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)), shortest) if len(numbers) < len(words) else []
                counts.append(len(words))
                every.append([{"start": s, "length": m, "period": q} for s, m, q in here])
                if here:
                    keep = np.ones(len(words), bool)
                    for s, m, q in here:
                        keep[s + q: s + m] = False
                    words = [words[j] for j in np.flatnonzero(keep).tolist()]
                collapsed.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [part.column("key"), pa.array(counts, pa.int64()), pa.array(every, shape), pa.array(collapsed, pa.binary()).cast(pa.string())],
                names=["key", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """For each text its ``n_words``, ``runs`` (start and length in words, smallest period) and ``collapsed``.

    A run is a stretch of at least ``shortest`` words, and twice its period, that
    no neighbouring word extends. ``collapsed`` has the words outside runs and the
    first period of each run, joined by single spaces. Texts are read where they
    lie; nothing is shuffled.
    """
    read = bare(docs, key, text).toDF("key", "text")
    read = read.select("key", read["text"].cast("binary").alias("text"))
    shape = f"key {docs.schema[key].dataType.simpleString()}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return read.mapInArrow(lambda it: _scanned(it, shortest), shape).withColumnRenamed("key", key)

"""Sharding by size: indivisible groups of documents in the fewest shards of one capacity.

Documents with equal texts form a group and stay together. Groups are taken from
the largest to the smallest; each enters the shard with the least remaining
capacity that still holds it, which a balanced tree of remaining capacities
gives, and a new shard is opened where there is none (best-fit decreasing).

Groups of one size are interchangeable, so the packing works on sizes and how
many groups have each: the tightest shard takes as many groups of a size as it
holds, which is what placing them one by one does. Sizes are rounded up to
``BITS`` significant bits (by less than a thousandth), so there are fewer than
2 ** ``BITS`` of them for each power of two, some fifty thousand for any corpus, and
only these reach the driver. Which groups go where is then a numbering of the
groups of a size, and the groups carry their shard to their documents.

Defined results: a null text has no bytes and is in one group with empty texts.
A group larger than the capacity has a shard of its own. Rows repeated or with a
null key are documents of their own; extra columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.skew import join_by_group, number_within
from pageloom.llm.tables import bare
from pageloom.session import Scratch, materialize

ROW_BYTES = 16  # of a document besides its text
BITS = 11
LEAF = 512  # entries of a leaf of the tree before it is parted


class Tree:
    """A balanced tree of two levels: sorted leaves of bounded size under their largest entries."""

    def __init__(self):
        self.leaves: list[list[tuple[int, int]]] = []
        self.tops: list[tuple[int, int]] = []

    def add(self, entry: tuple[int, int]) -> None:
        if not self.leaves:
            self.leaves, self.tops = [[entry]], [entry]
            return
        at = min(bisect_left(self.tops, entry), len(self.tops) - 1)
        leaf = self.leaves[at]
        insort(leaf, entry)
        if len(leaf) > LEAF:
            self.leaves[at: at + 1] = [leaf[: LEAF // 2], leaf[LEAF // 2:]]
            self.tops[at: at + 1] = [leaf[LEAF // 2 - 1], leaf[-1]]
        else:
            self.tops[at] = leaf[-1]

    def take(self, least: int) -> tuple[int, int] | None:
        """Remove and return the smallest entry that begins with ``least`` or more."""
        at = bisect_left(self.tops, (least, -1))
        if at == len(self.tops):
            return None
        leaf = self.leaves[at]
        entry = leaf.pop(bisect_left(leaf, (least, -1)))
        if leaf:
            self.tops[at] = leaf[-1]
        else:
            del self.leaves[at], self.tops[at]
        return entry


def best_fit_decreasing(sizes: list[tuple[int, int]], capacity: int, first: int = 0, most: int | None = None) -> list[tuple[int, int, int]] | None:
    """``(size, groups, shard)`` for sizes given as ``(size, groups)``; shards are numbered from ``first``.

    ``None`` where more than ``most`` shards would be opened.
    """
    tree, placed, opened = Tree(), [], 0
    for size, count in sorted(sizes, reverse=True):
        while count:
            hit = tree.take(size)
            if hit is None:
                if opened == most:
                    return None
                hit, opened = (max(capacity, size), first + opened), opened + 1
            room, shard = hit
            fit = min(count, room // size)
            count -= fit
            placed.append((size, fit, shard))
            if room - fit * size:
                tree.add((room - fit * size, shard))
    return placed


def into_shards(sizes: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int]]:
    """Sizes placed in at most ``shards`` shards of the smallest capacity that a bisection finds.

    Groups larger than an equal share of what is left have shards of their own.
    """
    left, total, free = [], sum(s * n for s, n in sizes), shards
    alone: list[tuple[int, int, int]] = []
    for size, count in sorted(sizes, reverse=True):
        while count and free > 1 and size * free > total:
            alone.append((size, 1, shards - free))
            count, free, total = count - 1, free - 1, total - size
        if count:
            left.append((size, count))
    if not left:
        return alone
    # With a shard's share and one group more, no shard can be missing: all would hold their share.
    low, high = max(-(-total // free), left[0][0]), -(-total // free) + left[0][0]
    best = best_fit_decreasing(left, high, shards - free, free)
    while low < high:
        middle = (low + high) // 2
        found = best_fit_decreasing(left, middle, shards - free, free)
        if found is None:
            low = middle + 1
        else:
            best, high = found, middle
    return alone + best


def rounded(size: str) -> Column:
    """A size (the name of a column) rounded up to its first ``BITS`` bits."""
    step = F.expr(f"shiftleft(1L, greatest(length(bin({size})) - {BITS}, 0))")
    return F.expr(f"({size} - 1) div shiftleft(1L, greatest(length(bin({size})) - {BITS}, 0)) + 1") * step


def _lookup(batches: Iterator[pa.RecordBatch], sizes: np.ndarray, bases: np.ndarray, ends: np.ndarray, shards: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size, rank = (batch.column(c).to_numpy() for c in ("size_class", "rank"))
        place = bases[np.searchsorted(sizes, size)] + rank
        found = shards[np.searchsorted(ends, place, "right")] if len(ends) else np.zeros(0, np.int32)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("group", "n")), pa.array(found, pa.int32())], names=["group", "n", "shard"])


def shard_by_size(docs: DataFrame, shards: int | None = None, capacity: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each document its ``size``, ``text_crc32``, ``shard`` and ``slot``, gapless from 0 within the shard.

    With ``capacity`` (bytes of a shard) as few shards as best-fit decreasing
    opens; with ``shards`` at most so many, of sizes as near equal as the groups allow.
    """
    if (shards is None) == (capacity is None):
        raise ValueError("give either shards or capacity")
    with Scratch(docs.sparkSession) as scratch:
        read = bare(docs, key, text).toDF("key", "text").withColumn("text", F.coalesce("text", F.lit("")))
        # Numbered where they lie and then written, so that a row keeps its number.
        rows = scratch.keep(read.select(
            "key", (F.octet_length("text").cast("bigint") + ROW_BYTES).alias("size"), F.crc32("text").alias("text_crc32"),
            F.unhex(F.sha2("text", 256)).alias("group"), F.monotonically_increasing_id().alias("row")), "rows")
        groups = rows.groupBy("group").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
        groups = scratch.keep(groups.select("group", "n", rounded("bytes").alias("size_class")), "groups")
        found = groups.groupBy("size_class").agg(F.count("*").alias("groups"), F.sum("n").alias("n")).collect()  # bounded by the rounding
        sizes = [(r["size_class"], r["groups"]) for r in found]
        placed = into_shards(sizes, shards) if shards is not None else best_fit_decreasing(sizes, capacity)
        placed.sort(key=lambda p: p[0])
        known, counts = np.array(sorted(sizes), np.int64).reshape(-1, 2).T
        bases = np.cumsum(counts) - counts
        ends, where = np.cumsum(np.array([n for _, n, _ in placed], np.int64)), np.array([s for _, _, s in placed], np.int32)
        ranked = number_within(groups, "size_class", "group", sum(n for _, n in sizes), "rank")
        placed_groups = ranked.select("group", "n", "size_class", F.col("rank").cast("bigint").alias("rank")).mapInArrow(
            lambda it: _lookup(it, known, bases, ends, where), "group binary, n long, shard int")
        total = sum(r["n"] for r in found)
        at = scratch.keep(join_by_group(rows, scratch.keep(placed_groups, "placed"), "group", "n", total), "at")
        out = number_within(at, "shard", "row", total, "slot")
        return materialize(out.select(F.col("key").alias(key), "size", "text_crc32", "shard", F.col("slot").cast("bigint").alias("slot")), "sharded")

"""Best-fit packing by a grouping genetic algorithm on islands.

Documents become pieces of at most ``SEQUENCE`` tokens; a piece that long is a
sequence by itself, the others are packed. Pieces are dealt out by hash into
blocks of about ``BLOCK``. Each block is evolved on ``ISLANDS`` islands, rows
that Spark spreads over its tasks. A chromosome is a set of bins. Crossover
takes some of one parent's best-filled bins whole, removes the other parent's
bins that hold the same pieces, and best-fits the pieces this displaces.
Between epochs each island's best one migrates to the next island. Then the
block's best solution counts: its well-filled bins are final, the pieces of the
others are dealt out anew, together with other blocks'. So what is lost at the
borders of blocks shrinks from round to round, and the last round takes all.

A block has a bounded number of pieces, so no task grows with the input.

Defined results: a null text is an empty document and has its end token only.
The first piece of a document is the short one. Rows repeated or with a null key
are documents of their own. An empty table gives no rows.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.arrays import slices
from pageloom.llm.tables import bare
from pageloom.llm.tokens import TOGETHER, Encoder
from pageloom.session import Scratch, materialize

SEQUENCE = 2048
END = 0
BLOCK = 2000  # pieces
ISLANDS = 2
EPOCHS = 2
OFFSPRING = 16  # of an island in an epoch
POPULATION = 6
WELL_FILLED = 0.998
ROUNDS = 4


def _pieces(batches: Iterator[pa.RecordBatch], path: str, end: int, size: int) -> Iterator[pa.RecordBatch]:
    encoder, closing = Encoder.of(path), np.array([end], "<u4").tobytes()
    for batch in (part for batch in batches for part in slices(batch, "text", TOGETHER)):
        row, piece, start, length, ids = [], [], [], [], []
        for i, raw in enumerate(encoder.encode([t or "" for t in batch.column("text").to_pylist()])):
            raw += closing
            n = len(raw) // 4
            cuts = [0, *range(n % size or size, n + 1, size)]
            for k, (low, high) in enumerate(zip(cuts[:-1], cuts[1:])):
                row.append(i), piece.append(k), start.append(low), length.append(high - low), ids.append(raw[4 * low: 4 * high])
        yield pa.RecordBatch.from_arrays(
            [batch.column("key").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
             pa.array(ids, pa.binary())], names=["key", "piece", "start", "length", "ids"])


class Bins:
    """A chromosome: lists of pieces, and what is left in each."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.bins: list[list[int]] = []
        self.space: list[int] = []

    def best_fit(self, items: list[int], length: list[int]) -> None:
        """Put each item, in order, where it leaves the least space; a new bin where it fits nowhere."""
        order = sorted((s, b) for b, s in enumerate(self.space) if s)
        for item in items:
            at = bisect.bisect_left(order, (length[item], -1))
            if at < len(order):
                space, b = order.pop(at)
                self.bins[b].append(item)
                space -= length[item]
            else:
                b, space = len(self.bins), self.capacity - length[item]
                self.bins.append([item])
                self.space.append(space)
            self.space[b] = space
            if space:
                bisect.insort(order, (space, b))

    def fitness(self) -> float:
        """Fewer bins are better; among as many, fuller ones besides emptier ones."""
        return -len(self.bins) + sum((1 - s / self.capacity) ** 2 for s in self.space) / max(1, len(self.bins) + 1)

    def numbers(self, n: int) -> list[int]:
        out = [0] * n
        for b, items in enumerate(self.bins):
            for item in items:
                out[item] = b
        return out

    @classmethod
    def of(cls, numbers: list[int], length: list[int], capacity: int) -> Bins:
        out = cls(capacity)
        out.bins = [[] for _ in range(max(numbers, default=-1) + 1)]
        out.space = [capacity] * len(out.bins)
        for item, b in enumerate(numbers):
            out.bins[b].append(item)
            out.space[b] -= length[item]
        return out


def crossed(giver: Bins, taker: Bins, length: list[int], rng: np.random.Generator) -> Bins:
    """Some of the giver's best-filled bins, the taker's others, and what that displaces best-fitted."""
    n = max(1, len(giver.bins) // 3)
    ranked = sorted(range(len(giver.bins)), key=giver.space.__getitem__)[: 2 * n]
    injected = [ranked[i] for i in rng.permutation(len(ranked))[:n]]
    inside = {item for b in injected for item in giver.bins[b]}
    child, displaced = Bins(giver.capacity), []
    for b in injected:
        child.bins.append(list(giver.bins[b]))
        child.space.append(giver.space[b])
    worst = set(sorted(range(len(taker.bins)), key=taker.space.__getitem__)[-max(1, len(taker.bins) // 50):])  # mutation: these are emptied, too
    for b, items in enumerate(taker.bins):
        if b in worst or not inside.isdisjoint(items):
            displaced += [i for i in items if i not in inside]
        else:
            child.bins.append(list(items))
            child.space.append(taker.space[b])
    child.best_fit(sorted(displaced, key=lambda i: -length[i]), length)
    return child


def evolved(length: list[int], population: list[list[int]], capacity: int, seed: int) -> list[list[int]]:
    """A population some generations later, best first; from nothing, one of noisy best-fit-decreasing packings."""
    rng = np.random.default_rng(seed)
    own = [Bins.of(p, length, capacity) for p in population]
    while len(own) < POPULATION:
        noise = rng.normal(0, 0 if not own else 60, len(length))
        fresh = Bins(capacity)
        fresh.best_fit(np.argsort(-(np.array(length) + noise), kind="stable").tolist(), length)
        own.append(fresh)
    best_possible = -(-sum(length) // capacity)
    scored = sorted(((b.fitness(), i, b) for i, b in enumerate(own)), reverse=True)
    for k in range(OFFSPRING):
        if len(scored[0][2].bins) <= best_possible:
            break
        a, b = (min(rng.integers(len(scored), size=2)) for _ in range(2))  # tournaments
        child = crossed(scored[a][2], scored[b][2], length, rng)
        scored = sorted([*scored, (child.fitness(), len(own) + k, child)], reverse=True)[:POPULATION]
    return [b.numbers(len(length)) for _, _, b in scored]


def _evolve(frames: Iterator[pd.DataFrame], capacity: int, turn: int) -> Iterator[pd.DataFrame]:
    for frame in frames:
        bests, populations, bins = [], [], []
        for block, island, length, population, immigrant in zip(frame.block, frame.island, frame.length, frame.population, frame.immigrant):
            length = [int(x) for x in length]
            start = [[int(x) for x in p] for p in population]
            if immigrant is not None and len(immigrant):
                start = [*start[: POPULATION - 1], [int(x) for x in immigrant]]
            after = evolved(length, start, capacity, hash((int(block), int(island), turn)) % (1 << 32))
            populations.append(after)
            bests.append(after[0])
            bins.append(max(after[0], default=-1) + 1)
        yield frame.assign(population=populations, best=bests, bins=bins).drop(columns="immigrant")


def _solved(items: DataFrame, n: int, turn: int, size: int, scratch: Scratch) -> DataFrame:
    """``pid``, ``length``, ``block``, ``bin`` of the best solution of every block."""
    blocks = max(1, -(-n // BLOCK))
    tasks = min(blocks * ISLANDS, 4 * items.sparkSession.sparkContext.defaultParallelism + blocks // 64)
    dealt = items.groupBy(F.pmod(F.xxhash64("pid", F.lit(turn)), F.lit(blocks)).alias("block")).agg(F.array_sort(F.collect_list(F.struct("length", "pid"))).alias("items"))
    islands = F.sequence(F.lit(0), F.lit(ISLANDS - 1))
    state = dealt.select(
        "block", F.explode(islands).alias("island"), F.col("items.pid").alias("pid"), F.col("items.length").alias("length"),
        F.array().cast("array<array<int>>").alias("population"), F.lit(None).cast("array<int>").alias("immigrant"))
    shape = "block long, island int, pid array<long>, length array<long>, population array<array<int>>, best array<int>, bins int"
    columns = ["block", "island", "pid", "length", "population", "immigrant"]
    for epoch in range(EPOCHS):
        state = state.select(*columns).repartition(tasks).mapInPandas(lambda it, epoch=epoch: _evolve(it, size, 100 * turn + epoch), shape)
        state = scratch.keep(state, f"epoch-{turn}-{epoch}")
        guests = state.select("block", ((F.col("island") + 1) % ISLANDS).alias("island"), F.col("best").alias("immigrant"))
        arrived, state = state.join(guests, ["block", "island"]), state
        if epoch < EPOCHS - 1:
            state = arrived
    won = state.groupBy("block").agg(F.min_by(F.struct("pid", "length", "best"), F.struct("bins", "island")).alias("w"))
    return won.select("block", F.explode(F.arrays_zip(F.col("w.pid").alias("pid"), F.col("w.length").alias("length"), F.col("w.best").alias("bin"))).alias("x")).select(
        "block", "x.pid", "x.length", "x.bin")


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", size: int = SEQUENCE, end: int = END,
         keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """Pieces of documents and their places: the key, ``piece``, ``start``, ``length``, ``ids``, ``sequence_id``, ``offset``.

    ``ids`` are little-endian 32-bit bytes, or what ``keep`` makes of them.
    """
    read = bare(docs, key, text).toDF("key", "text")
    shape = f"key {docs.schema[key].dataType.simpleString()}, piece int, start long, length long, ids binary"
    with Scratch(docs.sparkSession) as scratch:
        cut = read.mapInArrow(lambda it: _pieces(it, tokenizer, end, size), shape)
        cut = scratch.keep(cut.withColumn("ids", keep(F.col("ids")) if keep else F.col("ids")).withColumn("pid", F.monotonically_increasing_id()), "pieces")
        open_items, placed = cut.filter(F.col("length") < size).select("pid", "length"), None
        for turn in range(ROUNDS):
            n = open_items.count()
            if not n:
                break
            solved = scratch.keep(_solved(open_items, n, turn, size, scratch), f"solved-{turn}")
            filled = solved.groupBy("block", "bin").agg(F.sum("length").alias("fill"), F.min("pid").alias("sequence_id"))
            joined = solved.join(filled, ["block", "bin"])
            final = F.lit(True) if turn == ROUNDS - 1 or n <= BLOCK else F.col("fill") >= WELL_FILLED * size
            done = joined.filter(final).select("pid", "length", "sequence_id")
            placed = done if placed is None else placed.union(done)
            open_items = scratch.keep(joined.filter(~final).select("pid", "length"), f"open-{turn}")
        full = cut.filter(F.col("length") == size).select("pid", "length", F.col("pid").alias("sequence_id"))
        members = (full if placed is None else placed.union(full)).groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("pid", "length"))).alias("m"))
        places = members.select("sequence_id", F.posexplode("m").alias("i", "x"), "m").select(
            F.col("x.pid").alias("pid"), "sequence_id",
            F.aggregate(F.slice("m", F.lit(1), F.col("i")), F.lit(0).cast("long"), lambda s, x: s + x["length"]).alias("offset"))
        out = cut.join(places, "pid").select(F.col("key").alias(key), "piece", "start", "length", "ids", "sequence_id", "offset")
        return materialize(out, "packed")

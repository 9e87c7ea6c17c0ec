"""Shared shapes: first per key, newest k per group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 64


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One whole row per key: the least by ``order``.

    An aggregate, not a window: rows combine before the shuffle, so a key that
    holds a third of the table reaches its task as one row per map task.
    """
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*rest) if rest else F.struct(F.lit(1))
    picked = df.groupBy(*keys).agg(F.min_by(row, F.struct(*order)).alias("_row"))
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int, spread: list[str]) -> DataFrame:
    """The first ``n`` rows of each group, exactly, without one task per group.

    Groups are cut into ``SALTS`` slices by a hash of ``spread``; each slice
    keeps its own first ``n`` and only those meet. A group's last step sees at
    most ``SALTS * n`` rows however large the group is.
    """
    slices = Window.partitionBy(*keys, "_slice").orderBy(*order)
    whole = Window.partitionBy(*keys).orderBy(*order)
    cut = df.withColumn("_slice", F.pmod(F.xxhash64(*spread), F.lit(SALTS)))
    cut = cut.withColumn("_rank", F.row_number().over(slices)).filter(F.col("_rank") <= n).drop("_slice")
    return cut.withColumn("_rank", F.row_number().over(whole)).filter(F.col("_rank") <= n)


HEAVY_SHARE = 500  # a key with more than one row in so many is heavy, so there are fewer heavy keys than this
SPLITS = 32  # parts the rows of a heavy key are dealt over


def join_skewed(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` (inner or left) where some keys may hold most of ``left``.

    The keys of ``left`` are counted; the rows of the few heavy ones are dealt over
    ``SPLITS`` parts by a hash of the whole row, and their partners in ``right`` are
    repeated for each part. All other rows join as they are. Which keys are heavy is
    a table of fewer than ``HEAVY_SHARE`` rows, found while the join runs.
    """
    counts = left.groupBy(*on).agg(F.count("*").alias("_n"))
    rows_of_all = left.agg(F.count("*").alias("_all"))
    heavy = counts.join(F.broadcast(rows_of_all), F.col("_n") * HEAVY_SHARE > F.col("_all")).select(*on, F.lit(SPLITS).alias("_parts"))
    dealt = left.join(F.broadcast(heavy), on, "left").withColumn(
        "_part", F.when(F.col("_parts").isNotNull(), F.pmod(F.xxhash64(*left.columns), F.lit(SPLITS))).otherwise(0).cast("int")).drop("_parts")
    repeated = right.join(F.broadcast(heavy), on, "left").withColumn(
        "_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return dealt.join(repeated, [*on, "_part"], how).drop("_part")


def contains_any(columns: list[str], text: str) -> Column:
    """Case-insensitive contains over several columns; empty text matches all."""
    needle = text.strip().lower()
    if not needle:
        return F.lit(True)
    hits = [F.coalesce(F.lower(F.col(c)).contains(needle), F.lit(False)) for c in columns]
    return reduce(lambda a, b: a | b, hits)

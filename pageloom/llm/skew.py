"""Joins and numberings in which one key may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm.tables import slot

HOT_SHARE = 1000  # a key with more than one row in so many is hot, so there are fewer hot keys than this
SLICES = 64  # parts of a key's rows at least
SLICE_ROWS = 1 << 20  # rows of a slice, if a single key had all rows


def join_by_group(rows: DataFrame, groups: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """``rows`` with the columns of ``groups`` (one row for each non-null ``key``, which ``count`` rows of ``rows`` have).

    ``total`` is the number of all rows. Fewer than :data:`HOT_SHARE` keys can hold
    more than that share of them each; their groups are broadcast, so the rows of a
    hot key stay where they are. All other rows meet their groups in a shuffle in
    which no key has more than that share.
    """
    is_hot = F.col(count) * HOT_SHARE > total
    hot, rest = F.broadcast(groups.filter(is_hot).drop(count)), groups.filter(~is_hot).drop(count)
    here = rows.join(hot, key)
    far = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest.hint("merge"), key)
    return here.unionByName(far)


def number_within(df: DataFrame, by: str, unique: str, total: int, name: str) -> DataFrame:
    """``df`` with ``name``: gapless numbers from 0 within each value of ``by``.

    ``df`` is read twice and must give the same rows both times; ``unique`` is
    distinct within a value. The rows of a value are numbered in slices, as many as
    keep a slice small even if one value had all ``total`` rows, and a slice's
    numbers begin where those of the slices before it end.
    """
    n = max(SLICES, -(-total // SLICE_ROWS))
    sliced = df.withColumn("__slice", slot(F.col(unique), n))
    before = F.sum("__n").over(Window.partitionBy(by).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1))
    starts = sliced.groupBy(by, "__slice").agg(F.count("*").alias("__n")).select(by, "__slice", F.coalesce(before, F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy(by, "__slice").orderBy(unique)) - 1
    numbered = sliced.withColumn("__inside", inside).join(starts, [by, "__slice"])
    return numbered.withColumn(name, F.col("__start") + F.col("__inside")).drop("__slice", "__start", "__inside")

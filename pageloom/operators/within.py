"""Containment of elements as an interval join.

An element holds the node numbers from its own to its last descendant's. Node
numbers are cut into blocks: an outer element is a row for each block that it reaches
into, an inner one is in a single block. So both meet in an equality join on page and
block, and the interval decides inside the block. Nothing is kept about an
element's ancestors, however deep a page nests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 64  # node numbers; most elements of a page lie in one or two blocks


def block_of(node: Column | str) -> Column:
    node = F.col(node) if isinstance(node, str) else node
    return F.floor(node / BLOCK).cast("int")


def reaching(outer: DataFrame, first: str, last: str) -> DataFrame:
    """``outer`` once for each block that its elements reach into, as ``_block``."""
    return outer.withColumn("_block", F.explode(F.sequence(block_of(first), block_of(last))))


def inside(outer: DataFrame, inner: DataFrame, on: list[str], first: str, last: str, at: str, how: str = "inner", itself: bool = True) -> DataFrame:
    """``inner`` rows with the ``outer`` rows they lie in; ``itself`` says whether an element lies in itself.

    ``first`` and ``last`` (of ``outer``) and ``at`` (of ``inner``) are node numbers. With ``how`` a semi join,
    the inner rows that lie in any outer one.
    """
    low = F.col(first) <= F.col(at) if itself else F.col(first) < F.col(at)
    held = low & (F.col(at) <= F.col(last))
    i, o = inner.withColumn("_block", block_of(at)), reaching(outer, first, last)
    keys = [*on, "_block"]
    if how == "inner":
        return i.join(o, keys).filter(held).drop("_block")
    renamed = o.select(*[F.col(k).alias(f"_o_{k}") for k in keys], first, last)
    same = held
    for k in keys:
        same = same & (F.col(k) == F.col(f"_o_{k}"))
    return i.join(renamed, same, how).drop("_block")

"""Small helpers for the operators' tables."""

from __future__ import annotations

import pickle
from typing import Any

from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def bare(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, in this order; extra columns of the caller's never clash with an operator's own."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def parts(df: DataFrame) -> int:
    """How many parts a shuffle of ``df`` makes, as its session says."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def slot(value: Column, n: int | Column) -> Column:
    """A number from 0 to ``n - 1`` by the hash of a value."""
    return F.pmod(F.xxhash64(value), F.lit(n) if isinstance(n, int) else n)


def packed(spark: SparkSession, value: Any) -> Broadcast:
    """A broadcast of an object of this package's classes; their code goes with it, as executors need not have the package."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def unpacked(shared: Broadcast) -> Any:
    return pickle.loads(shared.value)

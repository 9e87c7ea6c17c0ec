"""Indented JSON: the one text function that no built-in expression gives."""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# The function travels with the plan, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _indented(texts: pd.Series) -> pd.Series:
    import json

    return texts.map(lambda t: None if t is None else json.dumps(json.loads(t), indent=2, ensure_ascii=False), na_action="ignore")


def indented(json_text: Column) -> Column:
    """A JSON text over several lines, two blanks a level; only rows that are not null are looked at."""
    return F.pandas_udf(_indented, "string")(json_text)

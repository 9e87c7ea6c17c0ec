"""Rule functions supplied by users, run on Arrow batches.

Script rules are recognised and reported but not run. Who needs one supplies it
as a function over a pandas Series of strings instead.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_FUNCTIONS: dict[str, Callable] = {}


def register_rule_function(name: str, fn: Callable) -> None:
    """Make ``fn(values: Series) -> Series`` known to rules as ``name``."""
    _FUNCTIONS[name] = fn


def rule_function(name: str, value: Column) -> Column:
    """The registered function over the values a rule selected."""
    if name not in _FUNCTIONS:
        raise KeyError(f"no rule function {name!r}; known: {sorted(_FUNCTIONS)}")
    fn = _FUNCTIONS[name]

    def run(values: pd.Series) -> pd.Series:
        return fn(values)

    return F.coalesce(F.pandas_udf(run, "string")(value), F.lit(""))

"""Sequence similarity 2M/T of difflib, as an Arrow-batched function.

The order of the arguments matters, as matching blocks are sought in it; its
junk rule for texts of 200 characters or more holds as well.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: str | None, b: str | None) -> float | None:
    return None if a is None or b is None else SequenceMatcher(None, a, b).ratio()


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def similarity(a: Column | str, b: Column | str) -> Column:
    return F.pandas_udf(_ratios, "double")(a, b)


def length_bound(a: Column, b: Column, threshold: float) -> Column:
    """A cheap necessary condition: 2 min(len) / (len + len) reaches the threshold."""
    return 2 * F.least(F.length(a), F.length(b)) >= threshold * (F.length(a) + F.length(b))

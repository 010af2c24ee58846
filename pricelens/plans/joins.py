"""Join helpers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join in which null keys match each other; key columns of the left stay."""
    renamed = right.withColumnsRenamed({c: f"__r_{c}" for c in on})
    test = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in on])
    joined = left.join(renamed, test, how)
    return joined.drop(*[f"__r_{c}" for c in on])

"""Query registry and the small SQL pieces the checks share."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, check: str | None = None):
    """Register a query and, where SQL can express it, its check."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if check is not None:
            ORACLES[name] = check
        return fn

    return add


def rnd(expr: str, digits: int = 2) -> str:
    """Half-up rounding, as in ``numbers.half_up``."""
    scale = 10**digits
    return f"(floor(({expr}) * {scale}.0e0 + 0.5e0) / {scale}.0e0)"


def avg(expr: str) -> str:
    """Order-independent mean, as in ``numbers.exact_avg``."""
    return f"(sum(cast(floor(({expr}) * 10000.0e0 + 0.5e0) as bigint)) / count({expr}) / 10000.0e0)"


def quoted(values: Iterable[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def has_any(expr: str, terms: Iterable[str]) -> str:
    return "(" + " OR ".join(f"contains({expr}, '" + t.replace("'", "''") + "')" for t in terms) + ")"


def has_word(expr: str, terms: Iterable[str]) -> str:
    """Whole-word test with Unicode word boundaries spelled out."""
    import re

    alternatives = "|".join(re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", t) for t in terms).replace("'", "''")
    return rf"regexp_matches({expr}, '(^|[^\p{{L}}\p{{N}}_])({alternatives})($|[^\p{{L}}\p{{N}}_])')"

"""Exact ranks, running totals and medians that survive hot groups.

A window over one hot key would sort that whole key in a single task.  Here a
key's rows are first counted per value, and running totals are built level by
level: totals of coarse slices first, then inside each slice.  Every window
only sees the counted children of one slice, never the raw rows of a key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelens.plans.joins import null_safe_join
from pricelens.session import cut_lineage

# copies of one row are numbered in chunks of this size
CHUNK = 100_000


def _some(keys: Sequence[str]) -> list[str]:
    """Without a key the whole table would be one window."""
    if not keys:
        raise ValueError("at least one key is needed")
    return list(keys)


def running_counts(
    counted: DataFrame, keys: Sequence[str], value: str, weight: str = "n", width: float = 1.0
) -> DataFrame:
    """Add ``n_lt`` and ``n_le``: weight below and up to each value of a key.

    ``counted`` has one row per (keys, value).  Slices of ``width`` value units
    are summed first, so a hot key is spread over its slices.
    """
    keys = _some(keys)
    sliced = counted.withColumn("_slice", F.floor(F.col(value) / F.lit(float(width))))
    totals = sliced.groupBy(*keys, "_slice").agg(F.sum(weight).alias("_w"))
    before = Window.partitionBy(*keys).orderBy("_slice")
    base = totals.withColumn("_base", F.sum("_w").over(before) - F.col("_w")).drop("_w")
    inside = Window.partitionBy(*keys, "_slice").orderBy(value)
    return (
        null_safe_join(sliced, base, [*keys, "_slice"])
        .withColumn("n_le", F.col("_base") + F.sum(weight).over(inside))
        .withColumn("n_lt", F.col("n_le") - F.col(weight))
        .drop("_slice", "_base")
    )


def rank_probes(
    counted: DataFrame, probes: DataFrame, keys: Sequence[str], value: str, weight: str = "n", width: float = 1.0
) -> DataFrame:
    """(keys, value, n_lt, n_le) of each probe value within its key's counted values.

    Both sides have one row per (keys, value); null keys and values have no rank.  Totals
    of value slices give the count below a probe's slice, and running totals over values
    and probes together the count inside it, so no probe is paired with the values.
    """
    keys = _some(keys)
    sides = counted.select(*keys, value, F.col(weight).alias("_w"), F.lit(False).alias("_asked")).unionByName(
        probes.select(*keys, value, F.lit(0).cast("bigint").alias("_w"), F.lit(True).alias("_asked"))
    )
    merged = (
        sides.dropna(subset=[*keys, value]).withColumn("_slice", F.floor(F.col(value) / F.lit(float(width))))
        .groupBy(*keys, "_slice", value).agg(F.sum("_w").alias("_w"), F.max("_asked").alias("_asked"))
    )
    totals = merged.groupBy(*keys, "_slice").agg(F.sum("_w").alias("_t"))
    before = Window.partitionBy(*keys).orderBy("_slice")
    base = totals.select(*keys, "_slice", (F.sum("_t").over(before) - F.col("_t")).alias("_base"))
    inside = Window.partitionBy(*keys, "_slice").orderBy(value)
    return (
        merged.withColumn("_le", F.sum("_w").over(inside)).where("_asked")
        .join(base, [*keys, "_slice"])
        .select(
            *keys, value, (F.col("_base") + F.col("_le") - F.col("_w")).alias("n_lt"),
            (F.col("_base") + F.col("_le")).alias("n_le"),
        )
    )


def dealt_by_range(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """The rows cut into stretches of the order, of about equal size, and written once.

    ``_range`` numbers the stretches.  The cuts come from a sample of all ``order``
    columns, so rows that agree in the first of them still spread over several
    stretches; only rows equal in all of them share one.
    """
    return cut_lineage(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))


def positions(df: DataFrame, keys: Sequence[str], levels: Sequence[tuple[str, Column]], out: str = "pos") -> DataFrame:
    """Number the rows of each key 1..n in the order of ``levels``, then of the other columns.

    ``levels`` are (name, expression) pairs; one that is a column of ``df`` is not copied.
    Rows equal in all columns are interchangeable: they are counted once and expanded
    again at the end, in chunks.  The others are dealt by range and numbered inside a
    stretch, so no key, price or store is sorted in one task.  The count of the stretches
    before comes first in a stretch as a row of its own, so the rows are not dealt out
    once more for a join.  The result has the columns of ``df`` plus ``out``.
    """
    keys, cols = _some(keys), df.columns
    own = {str(F.col(c)): c for c in cols}
    names = [own.get(str(expr), f"_l{i}") for i, (_, expr) in enumerate(levels)]
    rest = [c for c in cols if c not in keys and c not in names]
    made = {n: expr for n, (_, expr) in zip(names, levels) if n not in cols}
    leaf = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n")).withColumns(made)
    dealt = dealt_by_range(leaf, [*keys, *names, *rest])
    # one row per key and stretch it reaches into
    counts = dealt.groupBy(*keys, "_range").agg(F.sum("_n").alias("_w"))
    before = Window.partitionBy(*keys).orderBy("_range")
    starts = counts.select(*keys, "_range", (F.sum("_w").over(before) - F.col("_w")).alias("_n"), F.lit(False).alias("_is_row"))
    both = dealt.withColumn("_is_row", F.lit(True)).unionByName(starts, allowMissingColumns=True)
    inside = Window.partitionBy("_range", *keys).orderBy("_is_row", *names, *rest).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = both.withColumn("_from", F.sum("_n").over(inside) - F.col("_n")).where("_is_row")
    # the copies of one row are numbered in chunks, so no array grows with the data
    chunked = placed.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / CHUNK))))
    size = F.least(F.lit(CHUNK), F.col("_n") - F.col("_chunk") * CHUNK).cast("int")
    return chunked.select(
        *cols, (F.col("_from") + F.col("_chunk") * CHUNK).alias("_from"),
        F.explode(F.sequence(F.lit(1), size)).alias("_k"),
    ).select(*cols, (F.col("_from") + F.col("_k")).cast("bigint").alias(out))


def exact_median(
    df: DataFrame, keys: Sequence[str], value: str, width: float = 1.0, out: str = "median", weight: str | None = None
) -> DataFrame:
    """Median of a value per key from counted values; a row counts ``weight`` times if that names a column."""
    keys = list(keys)
    times = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(times.alias("n"))
    total = counted.groupBy(*keys).agg(F.sum("n").alias("_total"))
    ranked = null_safe_join(running_counts(counted, keys, value, "n", width), total, keys)
    low = F.floor((F.col("_total") + 1) / 2)
    high = F.floor(F.col("_total") / 2) + 1
    return ranked.groupBy(*keys).agg(
        (
            (
                F.max(F.when((F.col("n_lt") < low) & (low <= F.col("n_le")), F.col(value)))
                + F.max(F.when((F.col("n_lt") < high) & (high <= F.col("n_le")), F.col(value)))
            )
            / 2
        ).alias(out)
    )


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, out: str = "rank") -> DataFrame:
    """First ``k`` rows per key.  Map tasks already drop rows beyond ``k``."""
    by = Window.partitionBy(*[F.col(c) for c in keys]).orderBy(*order)
    return df.withColumn(out, F.row_number().over(by)).where(F.col(out) <= k)

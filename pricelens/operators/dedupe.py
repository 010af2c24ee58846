"""Duplicate removal, key differences and unions of drifting tables."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelens.plans.joins import null_safe_join


def dedupe(
    df: DataFrame, keys: Mapping[str, Column] | Sequence[str], order: Sequence[Column], keep: str = "first"
) -> DataFrame:
    """One row per key: the first or last in ``order``.

    ``keys`` may be expressions (a normalised text, say); the stored columns
    are untouched.  Map tasks keep one row per key before the shuffle, so a
    hot key costs one row per task.
    """
    exprs = keys.values() if isinstance(keys, Mapping) else [F.col(c) for c in keys]
    by = list(order) if keep == "first" else [_reversed(o) for o in order]
    # plain columns are keys as they are: copies of them would be sorted and shuffled, too
    spot = Window.partitionBy(*exprs).orderBy(*by)
    return df.withColumn("_spot", F.row_number().over(spot)).where(F.col("_spot") == 1).drop("_spot")


def _reversed(order: Column) -> Column:
    """Last in an ascending order (nulls first).  A column that carries an order of its
    own cannot be turned round and is refused by the analyzer."""
    if re.search(r"\b(ASC|DESC) NULLS (FIRST|LAST)", str(order)):
        raise ValueError('keep="last" takes plain ascending columns; state the reversed order with keep="first"')
    return order.desc_nulls_last()


def item_key(item: Column) -> Column:
    """Case- and blank-insensitive item key."""
    return F.lower(F.trim(item))


def archive_keys() -> dict[str, Column]:
    """Same day, store, item text (normalised) and numeric price."""
    return {
        "obs_date": F.col("obs_date"),
        "store": F.col("store"),
        "item": item_key(F.col("item")),
        "price": F.col("price"),
    }


def both_counts(before: DataFrame, after: DataFrame, names: tuple[str, str]) -> DataFrame:
    """One row with the row counts of two tables, from one aggregation."""
    sides = before.select(F.lit(1).alias("b"), F.lit(0).alias("a")).unionAll(after.select(F.lit(0), F.lit(1)))
    return sides.agg(
        F.coalesce(F.sum("b"), F.lit(0)).alias(names[0]), F.coalesce(F.sum("a"), F.lit(0)).alias(names[1])
    )


def removed_rows(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: how many rows a deduplication removed."""
    return both_counts(before, after, ("total", "kept")).withColumn("removed", F.col("total") - F.col("kept"))


def known_rows(new: DataFrame, archive: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` whose key the archive already has (null keys match)."""
    return null_safe_join(new, archive.select(*keys).distinct(), keys, "left_semi")


def unknown_rows(new: DataFrame, archive: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` whose key the archive lacks (null keys match)."""
    return null_safe_join(new, archive.select(*keys).distinct(), keys, "left_anti")


def concat_tables(*tables: DataFrame) -> DataFrame:
    """Union by name; a column one table lacks becomes null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def append_to_archive(
    archive: DataFrame, current: DataFrame, observed: Column, arrival: Sequence[Column]
) -> DataFrame:
    """Archive after taking in the current rows.

    New rows get the observation day and default validity, then rows with the
    same day, store, normalised item and price collapse to the last arrival.
    """
    fresh = current.withColumn("obs_date", observed)
    if "valid_from" in fresh.columns:
        fresh = fresh.withColumn("valid_from", F.coalesce("valid_from", "obs_date"))
        if "valid_until" in fresh.columns:
            fresh = fresh.withColumn("valid_until", F.coalesce("valid_until", F.date_add("valid_from", 7)))
    both = concat_tables(
        archive.withColumn("_arrival", F.lit(0)), fresh.withColumn("_arrival", F.lit(1))
    )
    return dedupe(both, archive_keys(), [F.col("_arrival"), *arrival], keep="last").drop("_arrival")

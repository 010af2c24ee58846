"""Enrichment of offers: rule path, reuse of known results, attachments."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelens.functions.numbers import half_up
from pricelens.functions.rules import keyword_category
from pricelens.functions.score import context_score, explanation, rating
from pricelens.operators.dedupe import concat_tables, dedupe
from pricelens.operators.history import prefix_stats
from pricelens.operators.market import cross_store_context
from pricelens.plans.joins import null_safe_join
from pricelens.session import cut_lineage

ENRICHED = ["ai_score", "ai_rating", "ai_explanation", "ai_category", "ai_sub_category", "ai_name", "ai_confidence"]


def enrich_by_rules(current: DataFrame, history: DataFrame, prefix: int = 30) -> DataFrame:
    """Score, rating, explanation and category from statistics alone."""
    stats = prefix_stats(current, history, prefix).select(
        "item", half_up(F.col("avg_price"), 2).alias("_avg"), half_up(F.col("min_price"), 2).alias("_low")
    )
    rows = cross_store_context(current, prefix).join(stats, "item", "left")
    price, avg, low = F.col("price"), F.col("_avg"), F.col("_low")
    best, shops = F.col("best_price"), F.col("n_stores")
    scored = rows.withColumn("ai_score", context_score(price, avg, low, best, shops, F.col("store_rank")))
    return scored.withColumns(
        {
            "ai_rating": rating(F.col("ai_score")),
            "ai_explanation": explanation(price, avg, low, best, F.col("best_store"), shops),
            "ai_category": keyword_category(F.col("item")),
            "ai_sub_category": F.lit("General"),
            "ai_name": F.col("item"),
            "ai_confidence": F.lit("statistical"),
        }
    ).select(*[c for c in current.columns if c not in ENRICHED], *ENRICHED)


def attach_known(
    rows: DataFrame, archive: DataFrame, keys: Sequence[str], columns: Sequence[str], order: Sequence[Column]
) -> DataFrame:
    """Left join of the archive's last result per key; repeats do not fan out."""
    last = dedupe(archive, keys, order, keep="last").select(*keys, *columns)
    return null_safe_join(rows, last, keys, "left")


def enrich_new_only(
    current: DataFrame, archive: DataFrame, keys: Sequence[str], columns: Sequence[str],
    order: Sequence[Column], enrich: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """Enrich rows the archive does not know, reuse its results for the others."""
    known = dedupe(archive, keys, order, keep="last").select(*keys, *columns, F.lit(True).alias("_known"))
    rows = cut_lineage(null_safe_join(current, known, keys, "left"))  # the archive is read once
    fresh = enrich(rows.where(F.col("_known").isNull()).select(*current.columns))
    return concat_tables(fresh, rows.where("_known").drop("_known"))


def merge_results(
    rows: DataFrame, results: DataFrame, key: str, defaults: Mapping[str, object], order: Sequence[Column]
) -> DataFrame:
    """Attach external results by item and fill what is missing; of several results
    of one item the last in ``order`` counts."""
    one = dedupe(results, [key], order, keep="last")
    return rows.join(one, key, "left").na.fill(dict(defaults))


def backfill(rows: DataFrame, keys: Sequence[str], enrich: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Enrich each distinct key once and give the result to all its rows."""
    distinct = rows.select(*keys).distinct()
    return null_safe_join(rows, enrich(distinct), keys, "left")


def reuse_names(rows: DataFrame, known: DataFrame, key: str, columns: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Cached attributes per original name, and whether the name was known."""
    cache = dedupe(known, [key], order).select(key, *columns, F.lit(True).alias("_known"))
    return rows.join(cache, key, "left").withColumn("is_known", F.coalesce("_known", F.lit(False))).drop("_known")

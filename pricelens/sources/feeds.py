"""Landed feed documents to offer rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelens.functions.dates import blank_to_null, lenient_date
from pricelens.functions.price import PRICE_KEYS, add_unit_prices, first_filled, parse_prices
from pricelens.operators.filters import valid_items
from pricelens.schema import FEED


def read_feeds(spark: SparkSession, path: str) -> DataFrame:
    """JSON feed documents with the explicit feed schema."""
    return spark.read.schema(FEED).json(path)


def _filled(items: Column) -> Column:
    return F.when(F.size(items) > 0, items)


def flatten_feeds(feeds: DataFrame) -> DataFrame:
    """One row per feed item, in feed order.

    Items come from the first non-empty of the three arrays, the price text
    from the first filled price key, the last day from the item or the feed.
    """
    items = F.coalesce(*[_filled(F.col(c)) for c in ("items", "spread_items", "products")])
    rows = feeds.select(
        F.col("id").alias("feed_id"), F.col("merchant").alias("store"),
        F.col("valid_from").alias("_from"), F.col("valid_to").alias("_to"),
        F.posexplode(items).alias("feed_order", "_item"),
    )
    return rows.select(
        "feed_id", "store", "feed_order",
        F.trim("_item.name").alias("item"),
        first_filled(*[F.col(f"_item.{k}") for k in PRICE_KEYS]).alias("raw_price"),
        lenient_date(F.col("_from")).alias("valid_from"),
        lenient_date(F.coalesce(blank_to_null(F.col("_item.valid_to")), F.col("_to"))).alias("valid_until"),
    )


def offers(feeds: DataFrame) -> DataFrame:
    """Typed offers: parsed price, unit price, only valid items."""
    return add_unit_prices(valid_items(parse_prices(flatten_feeds(feeds)))).drop("raw_price")

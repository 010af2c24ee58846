"""Clean-up jobs for tables written by earlier versions."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelens.functions import vocab
from pricelens.functions.dates import blank_to_null, repaired_day, repaired_end
from pricelens.functions.numbers import half_up
from pricelens.functions.price import savings_pct
from pricelens.functions.rules import display_category
from pricelens.operators.dedupe import dedupe
from pricelens.operators.filters import without_merchants

RENAMED = {
    "Item": "item", "Store": "store", "Category": "category", "Price_Value": "price", "Date": "obs_date",
    "Sub_Category": "sub_category", "Original_Price": "original_price", "Valid_Until": "valid_until",
}


def clean_archive_rows(archive: DataFrame, arrival: Sequence[Column]) -> DataFrame:
    """Archive without beverage merchants and without repeated offers."""
    kept = without_merchants(archive, vocab.ARCHIVE_EXCLUSIONS)
    return dedupe(kept, ["store", "item", "price_text", "valid_until"], arrival)


def clean_table(history: DataFrame, as_of: date, missing_days: int = 7) -> DataFrame:
    """Display table: standard names, display category, savings, repaired dates."""
    rows = history.withColumnsRenamed(RENAMED)
    sub = F.initcap(F.coalesce(blank_to_null(F.col("sub_category")), F.lit("General")))
    return rows.withColumns(
        {
            "item": F.initcap("item"),
            "display_category": display_category(F.col("category")),
            "sub_category": sub,
            "savings_pct": half_up(savings_pct(F.col("price"), F.col("original_price")), 2),
            "valid_until": repaired_end(F.col("valid_until"), F.col("obs_date"), missing_days),
            "obs_date": repaired_day(F.col("obs_date"), F.lit(as_of)),
        }
    )

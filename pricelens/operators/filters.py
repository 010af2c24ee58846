"""Row filters and predicates of the item and deal tables."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelens.functions import vocab
from pricelens.functions.numbers import half_up
from pricelens.functions.rules import (
    food_verdict, is_counter_price, is_excluded_drink, is_raw_protein, names_any,
)
from pricelens.functions.text import is_blank


def valid_items(df: DataFrame) -> DataFrame:
    """Rows with a name and a positive price."""
    return df.where(~is_blank(F.col("item")) & (F.col("price") > 0))


def without_drinks(df: DataFrame) -> DataFrame:
    return df.where(~is_excluded_drink(F.col("item")))


def without_merchants(df: DataFrame, terms=vocab.EXCLUDED_MERCHANTS, store: str = "store") -> DataFrame:
    return df.where(~names_any(F.col(store), terms))


def without_item_words(df: DataFrame, terms=vocab.EXCLUDED_ITEM_WORDS) -> DataFrame:
    return df.where(~names_any(F.col("item"), terms))


def raw_proteins(df: DataFrame) -> DataFrame:
    return df.where(is_raw_protein(F.col("item"), F.col("category")))


def grocery_deals(df: DataFrame, min_score: float = 75, score: str = "ai_score") -> DataFrame:
    """Food rows with a high score."""
    return df.where(food_verdict(F.col("item"), F.col("category")).getField("is_food") & (F.col(score) >= min_score))


def name_matches(df: DataFrame, words: list[str]) -> DataFrame:
    """Items that name any of the words, case-blind."""
    return df.where(names_any(F.col("item"), words))


def best_proteins(df: DataFrame, words: list[str], k: int = 10, ties=(), score: str = "ai_score") -> DataFrame:
    """The ``k`` best-scored rows that name any of the words; unscored rows stay out."""
    by = [F.col(score).desc(), *[F.col(t).asc_nulls_last() for t in ties]]
    return name_matches(df.where(F.col(score) > 0), words).orderBy(*by).limit(k)


def with_filled_subcategory(df: DataFrame, fallback: str = "category") -> DataFrame:
    """A blank subcategory takes the category's name."""
    blank = is_blank(F.col("sub_category"))
    return df.withColumn("sub_category", F.when(blank, F.col(fallback)).otherwise(F.col("sub_category")))


def presets() -> dict[str, Column]:
    """Named one-click filters of the deal list."""
    return {
        "lowest_ever": F.col("is_lowest"),
        "hot_deals": F.col("deal_score") >= 80,
        "best_protein": F.col("category").isin(vocab.PROTEIN_CATEGORIES),
        "under_5": F.col("price") < 5,
        "staples": F.col("is_key"),
    }


def preset(df: DataFrame, name: str) -> DataFrame:
    """Apply a preset; an unknown name filters nothing."""
    test = presets().get(name)
    return df if test is None else df.where(test)


def search(df: DataFrame, term: str, columns=("item", "norm_name", "brand"), mode: str = "literal") -> DataFrame:
    """Rows in which any of the columns has the term (literal text or regex)."""
    hit = F.lit(False)
    for c in columns:
        # case is ignored by the flag: lower-casing a pattern would turn \\D into \\d
        found = F.col(c).rlike(f"(?iu){term}") if mode == "regex" else F.lower(F.col(c)).contains(term.lower())
        hit = hit | F.coalesce(found, F.lit(False))
    return df.where(hit)


def filter_stack(
    df: DataFrame, term: str | None = None, store: str | None = None, category: str | None = None,
    sub_category: str | None = None, low: float | None = None, high: float | None = None,
    top_only: bool = False, min_score: float = 0, score: str = "ai_score",
) -> DataFrame:
    """The sidebar filters, applied together; a subcategory needs its category."""
    if term:
        df = search(df, term, ("item",))
    if store:
        df = df.where(F.col("store") == store)
    if category:
        df = df.where(F.col("category") == category)
        if sub_category:
            df = df.where(F.col("sub_category") == sub_category)
    if low is not None:
        df = df.where(F.col("price") >= low)
    if high is not None:
        df = df.where(F.col("price") <= high)
    if top_only:
        df = df.where(F.col(score) >= 70)
    return df.where(F.col(score) >= min_score)


def subcategories(df: DataFrame) -> DataFrame:
    """Distinct non-blank subcategories of every category, sorted."""
    return (
        df.where(~is_blank(F.col("sub_category")))
        .select("category", "sub_category").distinct().orderBy("category", "sub_category")
    )


def within_days(df: DataFrame, as_of: date, days: int, day: str = "obs_date", month: str = "obs_month") -> DataFrame:
    """Rows observed within ``days`` before ``as_of`` (the first day included).  A
    table partitioned by ``month`` (yyyy-MM) reads only the months that can hold them."""
    first = as_of - timedelta(days=days)
    if month in df.columns:
        df = df.where(F.col(month) >= F.lit(f"{first:%Y-%m}"))
    return df.where(F.col(day) >= F.lit(first))


def dated(df: DataFrame, day: str = "obs_date") -> DataFrame:
    """Rows whose date could be read."""
    return df.where(F.col(day).isNotNull())


def equal_to(df: DataFrame, **values: object) -> DataFrame:
    """Rows that equal every given value; None leaves its column open."""
    for column, value in values.items():
        if value is not None:
            df = df.where(F.col(column) == F.lit(value))
    return df


def expired(df: DataFrame, as_of: date) -> DataFrame:
    return df.where(F.col("valid_until") < F.lit(as_of))


def unscored(df: DataFrame, score: str = "ai_score") -> DataFrame:
    """Rows enrichment still has to score: no score yet, or zero."""
    return df.where(F.col(score).isNull() | (F.col(score) == 0))


def with_review_flags(df: DataFrame) -> DataFrame:
    """Add ``validation_issues`` and ``needs_review`` to extracted items."""
    issues = F.array(
        F.when(
            F.coalesce("confidence", F.lit(0.5)) < 0.8,
            F.format_string("Low AI confidence (%.2f)", F.coalesce("confidence", F.lit(0.5))),
        ),
        F.when(F.col("price") > 100, F.format_string("Unusually high price ($%.2f)", "price"))
        .when((F.col("price") < 0.1) & (F.col("price") > 0), F.format_string("Unusually low price ($%.2f)", "price")),
        F.when(F.col("item").isNull() | (F.col("item") == ""), F.lit("Missing product name")),
    )
    return df.withColumn("validation_issues", F.filter(issues, lambda i: i.isNotNull())).withColumn(
        "needs_review", F.size("validation_issues") > 0
    )


def with_counter_fix(df: DataFrame) -> DataFrame:
    """Relabel counter prices as per 100 g and restate their unit price."""
    price = F.coalesce("price", F.lit(0.0))
    hit = is_counter_price(F.col("store"), F.col("item"), price, F.col("price_basis"))
    flagged = df.withColumn("per_100g_corrected", hit)
    fixed = F.col("per_100g_corrected")
    return flagged.withColumns(
        {
            "price_basis": F.when(fixed, F.lit("per_100g")).otherwise(F.col("price_basis")),
            "unit_price": F.when(fixed, half_up(price * 10, 2)).otherwise(F.col("unit_price")),
            "unit_type": F.when(fixed, F.lit("$/kg")).otherwise(F.col("unit_type")),
        }
    )

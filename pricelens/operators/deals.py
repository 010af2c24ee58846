"""The published deal table: rows for display, sorting, paging, top lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelens.functions.score import tags
from pricelens.plans.blocking import substring_links
from pricelens.plans.ranking import positions, top_rows


def coerced(df: DataFrame, numbers: Sequence[str], flags: Sequence[str]) -> DataFrame:
    """Typed columns of a drifting text table: bad numbers are null, missing
    flags false, a missing category Other, a missing score zero."""
    casts = {c: F.col(c).try_cast("double") for c in numbers if c in df.columns}
    casts |= {c: F.coalesce(F.col(c).try_cast("boolean"), F.lit(False)) for c in flags if c in df.columns}
    if "category" in df.columns:
        casts["category"] = F.coalesce("category", F.lit("Other"))
    if "deal_score" in df.columns:
        casts["deal_score"] = F.coalesce(F.col("deal_score").try_cast("double"), F.lit(0.0))
    return df.withColumns(casts)


def with_missing_columns(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Add absent columns (name -> type) as nulls."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in wanted.items() if c not in df.columns})


# output column -> (source column, default of a missing value)
VIEW = {
    "item": ("item", ""), "store": ("store", ""), "price": ("price", 0.0), "price_text": ("price_text", ""),
    "price_basis": ("price_basis", "each"), "unit_price": ("unit_price", None), "unit_type": ("unit_type", None),
    "deal_score": ("deal_score", 0.0), "ai_deal_score": ("ai_score", 0.0), "ai_deal_rating": ("rating", ""),
    "ai_explanation": ("explanation", ""), "category": ("category", "Other"),
    "sub_category": ("sub_category", ""), "brand": ("brand", None), "normalized_name": ("norm_name", ""),
    "is_lowest_historical": ("is_lowest", False), "pct_below_avg": ("pct_below_avg", 0.0),
    "historical_min": ("historical_min", None), "historical_max": ("historical_max", None),
    "historical_avg": ("historical_avg", None), "historical_count": ("historical_count", 0),
    "price_percentile": ("price_percentile", None), "cross_store_rank": ("cross_store_rank", None),
    "cross_store_count": ("cross_store_count", 0), "is_kvi": ("is_key", False),
}


def deal_view(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Deal rows as shown to clients: defaults filled in, tags attached."""
    cols = []
    for out, (source, default) in VIEW.items():
        if source in df.columns:
            value = F.col(source) if default is None else F.coalesce(F.col(source), F.lit(default))
        else:
            value = F.lit(default)
        cols.append(value.alias(out))
    label = tags(
        F.col("is_lowest"), F.col("pct_below_avg"), F.col("cross_store_rank"), F.col("cross_store_count"),
        F.col("is_key"), F.col("deal_score"),
    )
    return df.select(*keep, *cols, label.alias("tags"))


def sort_order(name: str, ties: Sequence[str] = ()) -> list[Column]:
    """Named sort of the deal list, nulls last; unknown names sort by score."""
    known = {
        "score_desc": F.col("deal_score").desc_nulls_last(),
        "score_asc": F.col("deal_score").asc_nulls_last(),
        "price_asc": F.col("price").asc_nulls_last(),
        "price_desc": F.col("price").desc_nulls_last(),
        "pct_below_desc": F.col("pct_below_avg").desc_nulls_last(),
        "name_asc": F.col("item").asc_nulls_last(),
        "name_store": F.col("item").asc_nulls_last(),
    }
    first = known.get(name, known["score_desc"])
    extra = [F.col("store").asc_nulls_last()] if name == "name_store" else []
    return [first, *extra, *[F.col(t).asc_nulls_last() for t in ties]]


def page(df: DataFrame, order: Sequence[Column], offset: int = 0, limit: int = 50, most: int | None = None) -> DataFrame:
    """One page of a sorted list: the rows asked for.  A caller that wants a bound
    names it in ``most`` and gets an error beyond it.  All rows up to the page pass
    through one task; ``page_after`` reads deep pages without that."""
    if most is not None and limit > most:
        raise ValueError(f"a page of {limit} rows is more than {most}")
    return df.orderBy(*order).offset(offset).limit(limit)


def page_after(df: DataFrame, order: Sequence[tuple[str, bool]], last: Mapping[str, object] | None, limit: int = 50) -> DataFrame:
    """The page that follows the row ``last`` (None: the first page).

    ``order`` lists (column, ascending) and ends with columns that make rows
    distinct; nulls come last.  Rows up to ``last`` are filtered in the scan, so each
    task keeps ``limit`` rows however deep the page is.
    """
    by = [F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_last() for c, up in order]
    if last is not None:
        later, equal = F.lit(False), F.lit(True)
        for c, up in order:
            if last[c] is not None:
                beyond = F.col(c) > F.lit(last[c]) if up else F.col(c) < F.lit(last[c])
                later = later | (equal & (F.coalesce(beyond, F.lit(False)) | F.col(c).isNull()))
            equal = equal & F.col(c).eqNullSafe(F.lit(last[c]))
        df = df.where(later)
    return df.orderBy(*by).limit(limit)


def total_rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"))


def top(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def top_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    return top_rows(df, keys, order, k)


def newest_per_store(feeds: DataFrame, key: str = "store") -> DataFrame:
    """Latest-starting feed per store; the first listed wins ties."""
    return top_rows(feeds, [key], [F.col("valid_from").desc_nulls_last(), F.col("feed_pos").asc()], 1, "_r").drop("_r")


def latest_ending_per_store(feeds: DataFrame, key: str = "store") -> DataFrame:
    """Feed that ends last per store."""
    return top_rows(feeds, [key], [F.col("valid_until").desc_nulls_last(), F.col("feed_pos").asc()], 1, "_r").drop("_r")


def weekly_per_store(feeds: DataFrame, key: str = "store") -> DataFrame:
    """First feed named weekly per store, else the first feed."""
    weekly = F.lower("name").contains("weekly")
    return top_rows(feeds, [key], [F.when(weekly, 0).otherwise(1), F.col("feed_pos").asc()], 1, "_r").drop("_r")


def recent_sightings(
    items: DataFrame, history: DataFrame, key: str = "item", k: int = 10, ties: Sequence[str] = ("price",)
) -> DataFrame:
    """Last ``k`` dated sightings of every item: history rows whose name holds the
    item's name, case-blind, for items seen at least twice.

    Names are linked, not rows: each history name keeps its last ``k`` rows before
    they meet the links.  Columns: sought (the item in lower case), those of the
    history, rank.
    """
    dated = history.where(F.col("obs_date").isNotNull()).withColumn("_name", F.lower(key))
    counts = dated.groupBy("_name").agg(F.count(F.lit(1)).alias("_n"))
    sought = items.select(F.lower(key).alias("sought")).distinct()
    links = substring_links(sought, "sought", counts, "_name")
    often = links.join(counts, "_name").groupBy("sought").agg(F.sum("_n").alias("_n")).where("_n >= 2").select("sought")
    order = [F.col("obs_date").desc(), *[F.col(t).asc() for t in ties]]
    last = top_rows(dated, ["_name"], order, k, "_r").drop("_r")
    rows = links.join(often, "sought", "left_semi").join(last, "_name").drop("_name")
    return top_rows(rows, ["sought"], order, k)


def price_history(history: DataFrame, key: str) -> DataFrame:
    """Ordered price history per item as numbered rows, oldest first.

    Rows instead of one array per item, so the history of a hot item stays
    spread over tasks.
    """
    rows = history.select(key, "obs_date", "store", "price")
    return positions(
        rows, [key],
        [("month", F.trunc("obs_date", "month")), ("day", F.col("obs_date")), ("store", F.col("store"))],
    )


def first_items_json(df: DataFrame, key: str, order: Sequence[Column], k: int = 10) -> DataFrame:
    """First ``k`` flagged items per store as one JSON value."""
    head = top_rows(df, [key], order, k, "_pos")
    entry = F.struct("_pos", F.struct(F.col("item").alias("name"), F.col("price_text").alias("price")).alias("e"))
    return head.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_items"),
        F.to_json(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x.getField("e"))).alias("items_json"),
    )

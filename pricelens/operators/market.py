"""The same product at other stores: ranks, best prices, ladders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelens.functions.text import is_blank
from pricelens.plans.blocking import substring_links
from pricelens.plans.ranking import positions, rank_probes
from pricelens.session import cut_lineage


def cross_store_rank(df: DataFrame, name: str = "norm_name") -> DataFrame:
    """Add rank, count, best price and best store per product name.

    Only names sold by several stores take part.  When exactly one unit type
    occurs on at least two rows, only those rows are ranked, by unit price;
    otherwise all rows by shelf price.  Ranks are positional: equal prices get
    consecutive ranks, ordered by store and the remaining columns.  Rows that
    are not ranked have a null rank and a count of one.  Where shelf prices are
    ranked, the count is that of all rows of the name: a row without a price has no
    rank but is among those counted.
    """
    has_unit = F.col("unit_price").isNotNull() & F.col("unit_type").isNotNull()

    def first(test: Column, value: str) -> Column:
        return F.min(F.when(test, F.struct(F.col(value).alias("v"), F.col("store").alias("s"))))

    facts = (
        df.where(~is_blank(F.col(name)))
        .groupBy(name)
        .agg(
            F.min("store").alias("_s1"), F.max("store").alias("_s2"),
            F.min(F.when(has_unit, F.col("unit_type"))).alias("_t1"),
            F.max(F.when(has_unit, F.col("unit_type"))).alias("_t2"),
            F.count_if(has_unit).alias("_units"), F.count(F.lit(1)).alias("_rows"),
            first(has_unit, "unit_price").alias("_best_unit"), first(F.col("price").isNotNull(), "price").alias("_best_shelf"),
        )
        .where("_s1 <> _s2")
        .select(
            name,
            ((F.col("_t1") == F.col("_t2")) & (F.col("_units") >= 2)).alias("_one"),
            F.col("_units"), F.col("_rows"), "_best_unit", "_best_shelf",
        )
        .withColumn("_by_unit", F.coalesce("_one", F.lit(False)))
        .withColumn("_best", F.when(F.col("_by_unit"), F.col("_best_unit")).otherwise(F.col("_best_shelf")))
        .select(
            name, "_by_unit", F.when(F.col("_by_unit"), F.col("_units")).otherwise(F.col("_rows")).alias("_size"),
            F.col("_best.v").alias("cross_store_best_price"), F.col("_best.s").alias("cross_store_best_store"),
        )
    )
    marked = df.join(facts, name, "left")
    value = F.when(F.col("_by_unit"), F.col("unit_price")).otherwise(F.col("price"))
    in_rank = F.col("_size").isNotNull() & (~F.col("_by_unit") | has_unit)
    marked = marked.withColumn("_cmp", F.when(in_rank, value))
    # the best price comes with the other facts of a name: ranked rows are not dealt out again for it
    ranked = marked.where("_cmp is not null").withColumn("cross_store_count", F.col("_size")).drop("_by_unit", "_size")
    placed = positions(
        ranked, [name],
        [("slice", F.floor("_cmp")), ("value", F.col("_cmp")), ("store", F.col("store"))],
        "cross_store_rank",
    )
    plain = marked.where("_cmp is null").withColumns(
        {
            "cross_store_rank": F.lit(None).cast("bigint"),
            "cross_store_best_price": F.lit(None).cast("double"),
            "cross_store_best_store": F.lit(None).cast("string"),
            "cross_store_count": F.lit(1).cast("bigint"),
        }
    )
    return placed.drop("_cmp").unionByName(plain.drop("_by_unit", "_size", "_cmp"))


def store_minima(df: DataFrame, key: str) -> DataFrame:
    """Lowest price per (key, store)."""
    return df.where(~is_blank(F.col(key))).groupBy(key, "store").agg(F.min("price").alias("price"))


def best_store(df: DataFrame, key: str) -> DataFrame:
    """Best price, its store (first by name on ties) and store count per key."""
    return (
        store_minima(df, key)
        .groupBy(key)
        .agg(F.min(F.struct("price", "store")).alias("b"), F.count(F.lit(1)).alias("n_stores"))
        .select(key, F.col("b.price").alias("best_price"), F.col("b.store").alias("best_store"), "n_stores")
    )


def price_ladder(df: DataFrame, key: str) -> DataFrame:
    """Stores of a product ordered by their lowest price, numbered from one."""
    return positions(
        store_minima(df, key), [key], [("slice", F.floor("price")), ("value", F.col("price"))], "rank"
    )


def prefix_market(current: DataFrame, patterns: DataFrame) -> DataFrame:
    """Rows and lowest prices among the current items that hold a prefix (``pat``)."""
    unit = F.when(F.col("unit_price") > 0, F.col("unit_price"))
    items = current.groupBy(F.lower("item").alias("mid")).agg(
        F.count(F.lit(1)).alias("rows"), F.min("price").alias("best_price"),
        F.count(unit).alias("unit_rows"), F.min(unit).alias("best_unit"),
    )
    links = substring_links(patterns, "pat", items, "mid")
    return links.join(items, "mid").groupBy("pat").agg(
        F.sum("rows").alias("rows"), F.min("best_price").alias("best_price"),
        F.sum("unit_rows").alias("unit_rows"), F.min("best_unit").alias("best_unit"),
    )


def _store_context(minima: DataFrame, probes: DataFrame, key: str) -> DataFrame:
    """Best store, store count and place of each probe price among store minima."""
    best = (
        minima.groupBy(key)
        .agg(F.min(F.struct("price", "store")).alias("b"), F.count(F.lit(1)).alias("n_stores"))
        .where("n_stores >= 2")
        .select(key, F.col("b.price").alias("best_price"), F.col("b.store").alias("best_store"), "n_stores")
    )
    counted = minima.groupBy(key, "price").agg(F.count(F.lit(1)).alias("n"))
    places = rank_probes(counted, probes, [key], "price")
    # a price that is no store minimum takes the last place
    place = F.when(F.col("n_le") > F.col("n_lt"), F.col("n_lt") + 1).otherwise(F.col("n_stores"))
    return probes.join(best, key).join(places, [key, "price"]).select(
        key, "price", "best_price", "best_store", "n_stores", place.alias("store_rank")
    )


def cross_store_context(df: DataFrame, prefix: int = 30) -> DataFrame:
    """Add best price, best store, store count and store rank to current rows.

    By normalised name when at least two stores sell it, else by the item's
    prefix inside other current items.
    """
    facts = ["best_price", "best_store", "n_stores", "store_rank"]
    by_name = _store_context(
        store_minima(df, "norm_name"),
        df.where(~is_blank(F.col("norm_name"))).select("norm_name", "price").distinct(), "norm_name",
    )
    named = df.join(by_name, ["norm_name", "price"], "left")
    rest = cut_lineage(
        named.where("n_stores is null").select("item", "price").distinct()
        .withColumn("pat", F.lower(F.substring("item", 1, prefix)))
    )
    by_item = df.groupBy(F.lower("item").alias("mid"), "store").agg(F.min("price").alias("price"))
    links = substring_links(rest, "pat", by_item, "mid")
    minima = cut_lineage(links.join(by_item, "mid").groupBy("pat", "store").agg(F.min("price").alias("price")))
    context = _store_context(minima, rest.select("pat", "price").distinct(), "pat")
    by_prefix = rest.join(context, ["pat", "price"]).drop("pat")
    by_prefix = by_prefix.withColumnsRenamed({f: f"_p_{f}" for f in facts})
    return (
        named.join(by_prefix, ["item", "price"], "left")
        .withColumns({f: F.coalesce(f, f"_p_{f}") for f in facts})
        .drop(*[f"_p_{f}" for f in facts])
        .select(*df.columns, *facts)
    )


"""Summaries of the current table: stores, categories, bands, checks."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelens.functions import vocab
from pricelens.functions.dates import weeks_since
from pricelens.functions.numbers import MONEY_STEPS, as_steps, exact_avg, half_up
from pricelens.functions.text import first_rule
from pricelens.plans.ranking import top_rows


def _one() -> Column:
    return F.count(F.lit(1))


def store_summary(df: DataFrame, hot: float = 80) -> DataFrame:
    """Deals, mean score, hot and lowest counts and mean saving per store."""
    saving = F.when(F.col("pct_below_avg") > 0, F.col("pct_below_avg"))
    return (
        df.groupBy("store")
        .agg(
            _one().alias("deal_count"),
            half_up(exact_avg(F.col("deal_score")), 1).alias("avg_score"),
            F.count_if(F.col("deal_score") >= hot).alias("hot_deals"),
            F.count_if("is_lowest").alias("lowest_ever"),
            F.coalesce(half_up(exact_avg(saving), 1), F.lit(0.0)).alias("avg_savings"),
        )
        .orderBy(F.desc("avg_score"), "store")
    )


def category_summary(df: DataFrame) -> DataFrame:
    return (
        df.groupBy("category")
        .agg(_one().alias("deal_count"), half_up(exact_avg(F.col("deal_score")), 1).alias("avg_score"))
        .orderBy(F.desc("deal_count"), "category")
    )


def insights(df: DataFrame, hot: float = 80) -> DataFrame:
    """One row of headline figures, rolled up from one row per store."""
    stores = df.groupBy("store").agg(
        _one().alias("n"), F.count_if("is_lowest").alias("low"), F.count_if(F.col("deal_score") >= hot).alias("hot"),
        F.count_if("is_key").alias("key"), F.sum(as_steps(F.col("deal_score"))).alias("s"),
        F.count("deal_score").alias("k"), exact_avg(F.col("deal_score")).alias("m"),
        F.min("valid_from").alias("f"), F.max("valid_until").alias("u"),
    )
    best = F.max_by(F.struct("store", "m", "n"), F.struct("m", "n"))
    return stores.agg(
        F.sum("n").alias("total_deals"), F.sum("low").alias("lowest_ever_count"), F.sum("hot").alias("hot_deal_count"),
        F.sum("key").alias("kvi_on_sale"),
        half_up(F.sum("s") / F.nullif(F.sum("k"), F.lit(0)) / F.lit(float(MONEY_STEPS)), 1).alias("avg_score"),
        F.min("f").alias("valid_from"), F.max("u").alias("valid_until"), best.alias("b"),
    ).select(
        "total_deals", "lowest_ever_count", "hot_deal_count", "kvi_on_sale", "avg_score", "valid_from", "valid_until",
        F.col("b.store").alias("best_store"), half_up(F.col("b.m"), 1).alias("best_store_score"),
        F.col("b.n").alias("best_store_deals"),
    )


def insight_lists(df: DataFrame, order: list[Column], k: int = 5) -> DataFrame:
    """Rows beside the headline figures: deals per category, deals per store and the
    ``k`` best deals in ``order``.  Columns: section, name, n, store, price, deal_score, rank."""
    none = {"store": "string", "price": "double", "deal_score": "double", "rank": "bigint"}
    blank = [F.lit(None).cast(t).alias(c) for c, t in none.items()]
    counts = [
        df.groupBy(F.col(c).alias("name")).agg(_one().alias("n")).select(F.lit(c).alias("section"), "name", "n", *blank)
        for c in ("category", "store")
    ]
    best = df.orderBy(*order).limit(k).select(
        F.lit("top").alias("section"), F.col("item").alias("name"), F.lit(1).cast("bigint").alias("n"), "store", "price",
        "deal_score", F.row_number().over(Window.orderBy(*order)).cast("bigint").alias("rank"),  # k rows
    )
    return counts[0].unionAll(counts[1]).unionAll(best)


def frequency(df: DataFrame, column: str, head: int | None = None) -> DataFrame:
    """Rows per value, most frequent first."""
    counts = df.groupBy(column).agg(_one().alias("n")).orderBy(F.desc("n"), column)
    return counts if head is None else counts.limit(head)


def score_bands(df: DataFrame, score: str = "deal_score") -> DataFrame:
    """Counts in the three band systems in use."""
    s = F.col(score)

    def between(low: float | None, high: float | None) -> Column:
        test = F.lit(True)
        if low is not None:
            test = test & (s >= low)
        if high is not None:
            test = test & (s < high)
        return F.count_if(test)

    return df.agg(
        between(85, None).alias("hot"), between(70, 85).alias("good"), between(50, 70).alias("fair"),
        between(30, 50).alias("below"), between(None, 30).alias("poor"),
        between(90, None).alias("exceptional"), between(75, 90).alias("great"), between(60, 75).alias("solid"),
        F.count_if(s <= 20).alias("band_0_20"), F.count_if((s > 20) & (s <= 40)).alias("band_21_40"),
        F.count_if((s > 40) & (s <= 60)).alias("band_41_60"), F.count_if((s > 60) & (s <= 80)).alias("band_61_80"),
        F.count_if(s > 80).alias("band_81_100"),
        F.min(s).alias("lowest"), F.max(s).alias("highest"), half_up(exact_avg(s), 1).alias("mean"),
    )


def distinct_counts(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """One row of distinct counts.  Exact counts read each column on its own and
    group it once, so rows are not multiplied by the columns."""
    if approximate:
        return df.agg(*[F.approx_count_distinct(c).alias(f"n_{c}") for c in columns])
    parts = None
    for c in columns:
        one = df.select(F.col(c).alias("v")).where("v is not null").distinct().agg(F.count("v").alias("n"))
        row = one.select(*[F.when(F.lit(c == o), F.col("n")).alias(f"n_{o}") for o in columns])
        parts = row if parts is None else parts.unionAll(row)
    return parts.agg(*[F.max(f"n_{c}").alias(f"n_{c}") for c in columns])


def coverage(df: DataFrame) -> DataFrame:
    """How much of the table has unit prices, weight prices, history, rivals."""
    basis = F.col("price_basis")
    return df.agg(
        _one().alias("n_rows"),
        F.count("unit_price").alias("with_unit_price"),
        half_up(F.count("unit_price") / _one() * 100, 1).alias("unit_price_share"),
        F.count_if(basis.isin("per_lb", "per_kg", "per_100g")).alias("per_weight"),
        F.count_if(basis == "multi_buy").alias("multi_buy"),
        F.count_if(basis == "each").alias("each"),
        F.count_if(F.col("historical_count") > 0).alias("with_history"),
        F.count_if(F.col("cross_store_count") > 1).alias("multi_store"),
        F.count_if(F.col("price") > 0).alias("priced"),
        F.count_if(F.col("price") == 0).alias("unpriced"),
        half_up(exact_avg(F.when(F.col("price") > 0, F.col("price"))), 2).alias("avg_price"),
    )


def expiry_table(df: DataFrame, as_of: date) -> DataFrame:
    """Rows per last day, days left and whether it has passed."""
    day = F.lit(as_of)
    return (
        df.groupBy("valid_until").agg(_one().alias("n"))
        .withColumns(
            {"days_left": F.datediff("valid_until", day).cast("bigint"), "is_expired": F.col("valid_until") < day}
        )
        .orderBy("valid_until")
    )


def fallback_rate(df: DataFrame, alert_above: float = 10) -> DataFrame:
    """Share of rows scored by the rule path, and whether it is alarming."""
    share = F.count_if(F.col("confidence") == "statistical") / F.count(F.lit(1)) * 100
    return df.agg(
        _one().alias("total"), F.count_if(F.col("confidence") == "statistical").alias("fallback"),
        half_up(share, 1).alias("fallback_pct"), (share > alert_above).alias("alert"),
    )


def enrichment_checks(df: DataFrame) -> DataFrame:
    """Quality of an enrichment result as one row per check."""
    facts = df.agg(
        half_up(F.count_if(F.col("category") == "Other") / _one() * 100, 1).alias("other_pct"),
        F.count_distinct("rating").alias("n_ratings"),
        half_up(F.count_if(F.col("sub_category") != "") / _one() * 100, 1).alias("sub_pct"),
    )
    checks = F.array(
        F.struct(F.lit("other_category").alias("check"), F.col("other_pct").alias("value"),
                 (F.col("other_pct") <= 80).alias("passed")),
        F.struct(F.lit("rating_variety").alias("check"), F.col("n_ratings").cast("double").alias("value"),
                 (F.col("n_ratings") >= 3).alias("passed")),
        F.struct(F.lit("sub_category").alias("check"), F.col("sub_pct").alias("value"),
                 (F.col("sub_pct") > 0).alias("passed")),
    )
    return facts.select(F.inline(checks))


def sale_frequency(history: DataFrame, key: str) -> DataFrame:
    """Sightings per month of items seen at least twice; short spans count as one."""
    days = F.datediff(F.max("obs_date"), F.min("obs_date"))
    return (
        history.groupBy(key)
        .agg(_one().alias("n_seen"), days.alias("_days"))
        .where("n_seen >= 2")
        .select(key, "n_seen", half_up(F.col("n_seen") / F.greatest(F.col("_days") / 30, F.lit(1.0)), 1).alias("per_month"))
    )


def last_sale_before(history: DataFrame, key: str, as_of: date) -> DataFrame:
    """Last sighting before a day: date, price, store and days since."""
    past = history.where(F.col("obs_date") < F.lit(as_of))
    last = past.groupBy(key).agg(F.max(F.struct("obs_date", "price", "store")).alias("s"))
    return last.select(
        key, F.col("s.obs_date").alias("last_date"), F.col("s.price").alias("last_price"),
        F.col("s.store").alias("last_store"), F.datediff(F.lit(as_of), "s.obs_date").cast("bigint").alias("days_ago"),
    )


def weeks_since_seen(history: DataFrame, as_of: date, notable: int = 6) -> DataFrame:
    """Weeks since the second latest sighting of an item, and whether that is long."""
    seen = history.where("price > 0").select(F.lower("item").alias("item_key"), "obs_date")
    second = top_rows(seen, ["item_key"], [F.col("obs_date").desc()], 2, "_r").where("_r = 2")
    weeks = weeks_since(F.lit(as_of), F.col("obs_date"))
    return second.select("item_key", weeks.alias("weeks_absent"), (weeks >= notable).alias("is_notable"))


def confidence_bands(df: DataFrame) -> DataFrame:
    c = F.coalesce("confidence", F.lit(0.5))
    n = F.count(F.lit(1))
    high, low = F.count_if(c >= 0.9), F.count_if(c < 0.7)
    return df.agg(
        n.alias("total"), high.alias("high"), F.count_if((c >= 0.7) & (c < 0.9)).alias("medium"), low.alias("low"),
        F.count_if("needs_review").alias("needs_review"),
        half_up(high / n * 100, 1).alias("high_pct"),
        half_up(F.count_if("needs_review") / n * 100, 1).alias("review_pct"),
    )


def list_metrics(df: DataFrame, score: str = "ai_score") -> DataFrame:
    """Figures above a filtered list.  Rows are counted per (item, store) once, and the
    distinct counts come from those counts, so rows are not multiplied by the columns."""
    steps = lambda c: F.sum(as_steps(F.col(c)))
    pairs = df.groupBy("item", "store").agg(
        _one().alias("n"), F.count_if(F.col(score) >= 70).alias("top"),
        *(f(c).alias(f"{name}_{c}") for c in ("price", score) for name, f in (("sum", steps), ("count", F.count))),
    )
    items = pairs.groupBy("item").agg(*(F.sum(c).alias(c) for c in pairs.columns if c not in ("item", "store")))
    mean = lambda c: F.sum(f"sum_{c}") / F.nullif(F.sum(f"count_{c}"), F.lit(0)) / F.lit(float(MONEY_STEPS))
    figures = items.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_deals"), half_up(mean("price"), 2).alias("avg_price"),
        F.coalesce(F.sum("top"), F.lit(0)).alias("top_deals"), half_up(mean(score), 0).alias("avg_score"),
        F.count("item").alias("n_items"),
    )
    stores = pairs.select("store").distinct().agg(F.count("store").alias("n_stores"))
    # one row each, put together without a join
    both = figures.unionByName(stores, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def savings_summary(df: DataFrame) -> DataFrame:
    """Rows with an advertised saving and their mean."""
    s = F.when(F.col("savings_pct") > 0, F.col("savings_pct"))
    return df.agg(_one().alias("n_rows"), F.count(s).alias("n_saving"), half_up(exact_avg(s), 1).alias("avg_saving"))


def describe_price(df: DataFrame, column: str = "price") -> DataFrame:
    """Count, mean, deviation and range of a price column."""
    c = F.col(column)
    return df.agg(
        F.count(c).alias("count"), half_up(exact_avg(c), 4).alias("mean"),
        half_up(F.stddev_samp(c), 4).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"),
    )


def week_overview(df: DataFrame, score: str = "ai_score") -> DataFrame:
    """Deal, store and member counts of the week."""
    return df.agg(
        _one().alias("n_deals"), F.count_distinct("store").alias("n_stores"),
        F.count_if(F.col(score) >= 85).alias("great"), F.count_if(F.col(score) >= 90).alias("exceptional"),
        F.count_if("member").alias("member_deals"),
    )


def best_group(df: DataFrame, key: str, score: str = "deal_score", hot: float = 85) -> DataFrame:
    """Group with the best mean score and group with the most hot rows."""
    groups = df.groupBy(key).agg(exact_avg(F.col(score)).alias("m"), F.count_if(F.col(score) >= hot).alias("h"))
    pick = lambda value: F.min(F.struct((-F.col(value)).alias("v"), F.col(key).alias("k")))
    return groups.agg(pick("m").alias("a"), pick("h").alias("b")).select(
        F.col("a.k").alias("best_mean"), half_up(-F.col("a.v"), 1).alias("mean_score"),
        F.col("b.k").alias("most_hot"), (-F.col("b.v")).alias("hot_rows"),
    )


def priority_group(category: Column) -> Column:
    """Shopping group of a category; null for the rest."""
    return first_rule(
        [(category.isin(members), F.lit(name)) for name, members in vocab.PRIORITY_CATEGORIES.items()],
        F.lit(None).cast("string"),
    )

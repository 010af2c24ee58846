"""Report rollups, report lines and quarterly tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelens.functions import vocab
from pricelens.functions.numbers import MONEY_STEPS, as_steps, exact_avg, half_up, money
from pricelens.functions.rules import is_raw_protein, short_store
from pricelens.functions.score import notable_line
from pricelens.functions.text import first_rule
from pricelens.operators.summary import priority_group
from pricelens.plans.ranking import exact_median, top_rows

FOOD = vocab.REPORT_PROTEINS + vocab.REPORT_OTHERS


def report_rows(df: DataFrame) -> DataFrame:
    """Rows that count in category sections: food, proteins only when raw."""
    raw = ~F.col("category").isin(vocab.REPORT_PROTEINS) | is_raw_protein(F.col("item"), F.col("category"))
    return df.where(F.col("category").isin(FOOD)).withColumn("in_section", raw)


def report_rollup(df: DataFrame, score: str = "deal_score") -> DataFrame:
    """Counts and whole mean scores per category, store and (store, category).

    One pass over the rows counts (store, category, raw); the three sections
    are sums of those few counts.
    """
    base = report_rows(df).groupBy("store", "category", "in_section").agg(
        F.count(F.lit(1)).alias("n"), F.sum(as_steps(F.col(score))).alias("s"), F.count(score).alias("k")
    )
    mean = F.coalesce(
        half_up(F.sum("s") / F.nullif(F.sum("k"), F.lit(0)) / F.lit(float(MONEY_STEPS)), 0), F.lit(50.0)
    ).alias("avg_score")
    count = F.sum("n").alias("n_deals")
    nothing = F.lit(None).cast("string")
    kept = base.where("in_section")
    kind = F.when(F.col("category").isin(vocab.REPORT_PROTEINS), "protein").otherwise("category")
    cats = kept.groupBy("category").agg(count, mean).select(
        kind.alias("section"), nothing.alias("store"), "category", "n_deals", "avg_score"
    )
    stores = base.groupBy("store").agg(count, mean).select(
        F.lit("store").alias("section"), "store", nothing.alias("category"), "n_deals", "avg_score"
    )
    both = kept.groupBy("store", "category").agg(count, mean).select(
        F.lit("store_category").alias("section"), "store", "category", "n_deals", "avg_score"
    )
    return cats.unionByName(stores).unionByName(both)


def report_picks(df: DataFrame, ties: Sequence[str], per_store: int = 3, per_category: int = 10) -> DataFrame:
    """Top rows of every report section: (section, store, category, rank, ...)."""
    rows = report_rows(df).where("in_section")
    order = [F.col("deal_score").desc_nulls_last(), *[F.col(t) for t in ties]]
    by_store = top_rows(rows, ["store", "category"], order, per_store).withColumn("section", F.lit("store"))
    by_cat = top_rows(rows, ["category"], order, per_category).withColumn("section", F.lit("category"))
    return by_store.unionByName(by_cat)


def _verdict(avg: Column, bands: Sequence[tuple[float, str]], last: str) -> Column:
    return first_rule([(avg >= floor, F.lit(text)) for floor, text in bands], F.lit(last))


def _category_pos(names: Sequence[str]) -> Column:
    return F.array_position(F.array(*[F.lit(n) for n in names]), F.col("category")).cast("int")


def _deal_text(width: int) -> Column:
    """Price, item and context of a pick; counter goods show their pound price."""
    context = F.when(F.col("context_text") != "", F.concat(F.lit(" - "), F.col("context_text"))).otherwise(F.lit(""))
    return F.when(
        F.col("price_note") != "",
        F.concat(F.substring("item", 1, width), F.lit(" "), F.col("price_note")),
    ).otherwise(F.concat(money(F.col("price")), F.lit(" "), F.substring("item", 1, width), context))


def price_note(price: Column, unit_price: Column, corrected: Column) -> Column:
    """Note that restates a corrected counter price per pound."""
    per_lb = unit_price * vocab.KG_PER_LB
    return F.when(
        corrected & (unit_price > 0),
        F.concat(F.lit("("), money(price), F.lit("/100g = "), money(per_lb), F.lit("/lb)")),
    ).otherwise(F.lit(""))


def store_report(rollup: DataFrame, picks: DataFrame) -> DataFrame:
    """Line rows of the store report, ordered by (block, line_no).

    ``picks`` come from ``report_picks`` with ``context_text`` and
    ``price_note`` attached.  Stores are ordered by mean score.
    """
    heads = rollup.where("section = 'store'").select(
        "store", F.col("avg_score"), "n_deals",
        F.format_string("%05.1f", 1000 - F.col("avg_score")).alias("store_key"),
    )
    verdict = _verdict(F.col("avg_score"), [(75, vocab.STORE_HEAD["hot"]), (65, vocab.STORE_HEAD["solid"])], vocab.STORE_HEAD["average"])
    title = heads.select(
        "store_key", "store", F.lit(0).alias("part"), F.lit(0).alias("line"),
        F.concat(F.lit("📍 "), F.upper(short_store(F.col("store")))).alias("text"),
    )
    total = heads.select(
        "store_key", "store", F.lit(0).alias("part"), F.lit(1).alias("line"),
        F.concat(F.col("n_deals").cast("string"), F.lit(" deals | "), verdict).alias("text"),
    )
    own = picks.where("section = 'store'").join(heads.select("store", "store_key"), "store")
    is_protein = F.col("category").isin(vocab.REPORT_PROTEINS)
    chosen = own.where((is_protein & (F.col("rank") <= 2)) | (~is_protein & (F.col("rank") == 1)))
    lines = chosen.select(
        "store_key", "store", _category_pos(FOOD).alias("part"), (2 * F.col("rank")).alias("line"),
        F.when(is_protein, F.concat(F.upper("category"), F.lit(": "), _deal_text(30)))
        .otherwise(F.concat(F.col("category"), F.lit(": "), _deal_text(25))).alias("text"),
    )
    # a counter protein shows its pound price; what the pick is compared with follows below
    below = chosen.where(is_protein & (F.col("price_note") != "") & (F.col("context_text") != "")).select(
        "store_key", "store", _category_pos(FOOD).alias("part"), (2 * F.col("rank") + 1).alias("line"),
        F.concat(F.lit("    ↳ - "), F.col("context_text")).alias("text"),
    )
    return title.unionByName(total).unionByName(lines).unionByName(below).orderBy("store_key", "store", "part", "line")


def category_report(rollup: DataFrame, picks: DataFrame) -> DataFrame:
    """Line rows of the category report: heads, top deals and the two winners."""
    cats = rollup.where("section in ('protein', 'category')")
    verdict = _verdict(
        F.col("avg_score"), [(80, vocab.CATEGORY_HEAD["great"]), (70, vocab.CATEGORY_HEAD["decent"])], vocab.CATEGORY_HEAD["average"]
    )
    heads = cats.select(
        _category_pos(FOOD).alias("part"), F.lit(0).alias("line"),
        F.when(F.col("section") == "protein", F.concat(F.upper("category"), F.lit(" - "), verdict))
        .otherwise(F.concat(F.upper("category"), F.lit(":"))).alias("text"),
    )
    is_protein = F.col("category").isin(vocab.REPORT_PROTEINS)
    own = picks.where("section = 'category'").where(F.col("rank") <= F.when(is_protein, 3).otherwise(2))
    lines = own.select(
        _category_pos(FOOD).alias("part"), F.col("rank").alias("line"),
        F.concat(F.lit("• "), _deal_text(30), F.lit(" @ "), short_store(F.col("store"))).alias("text"),
    )
    first = F.struct((-F.col("avg_score")).alias("s"), _category_pos(FOOD).alias("p"), F.col("category").alias("c"))
    best = cats.agg(
        F.min(F.when(F.col("section") == "protein", first)).getField("c").alias("protein"), F.min(first).getField("c").alias("any")
    )
    winners = best.select(
        F.inline(
            F.array(
                F.struct(F.lit(99).alias("part"), F.lit(0).alias("line"),
                         F.concat(F.lit("🥩 Stock up on: "), F.col("protein")).alias("text")),
                F.struct(F.lit(99).alias("part"), F.lit(1).alias("line"),
                         F.concat(F.lit("🏆 Best value: "), F.col("any")).alias("text")),
            )
        )
    ).where("text is not null")
    return heads.unionByName(lines).unionByName(winners).orderBy("part", "line")


def weekly_summary(df: DataFrame, ties: Sequence[str], k: int = 5, floor: float = 85) -> DataFrame:
    """Summary rows per shopping group: best of week first, then the next deals.

    ``df`` carries hist_avg and weeks_absent.
    """
    rows = df.withColumn("shop_group", priority_group(F.col("category"))).where(
        F.col("shop_group").isNotNull() & (F.col("ai_score") >= floor)
    )
    saving = F.when(F.col("hist_avg") > 0, (F.col("hist_avg") - F.col("price")) / F.col("hist_avg"))
    rows = rows.withColumn("saving", half_up(saving, 6))
    order = [F.desc("ai_score"), F.coalesce("saving", F.lit(0.0)).desc(), *[F.col(t) for t in ties]]
    top = top_rows(rows, ["shop_group"], order, k)
    absent = F.when(F.col("weeks_absent") >= 6, F.col("weeks_absent"))
    text = notable_line(
        F.col("item"), F.col("price_text"), F.col("store"), F.col("saving"), F.col("ai_score"), absent,
        F.col("member"), F.col("featured"), F.col("explanation"),
    )
    head = F.when((F.col("rank") == 1) & (F.col("ai_score") >= 90), F.lit("BEST OF WEEK"))
    return top.select("shop_group", "rank", head.alias("head"), text.alias("text"))


def budget_impact(df: DataFrame, order: Sequence[Column], k: int = 5, floor: float = 85) -> DataFrame:
    """Saving of the top deals against their mean price, per week and year."""
    top = df.where(F.col("ai_score") >= floor).orderBy(*order).limit(k)
    gain = F.when(F.col("hist_avg") > F.col("price"), F.col("hist_avg") - F.col("price"))
    total = F.coalesce(F.sum(as_steps(gain)), F.lit(0)) / F.lit(float(MONEY_STEPS))
    return top.agg(
        F.count(gain).alias("n_deals"), half_up(total, 2).alias("weekly_saving"), half_up(total * 52, 0).alias("yearly_saving")
    )


def quarterly_stores(df: DataFrame, day: str = "obs_date") -> DataFrame:
    """Deals, mean and median per store and quarter with the change to the quarter before."""
    rows = df.withColumn("quarter", F.concat(F.year(day), F.lit("-Q"), F.quarter(day)))
    rows = rows.withColumn("q_no", F.year(day) * 4 + F.quarter(day))
    facts = rows.groupBy("store", "quarter", "q_no").agg(
        F.count(F.lit(1)).alias("n_deals"), exact_avg(F.col("price")).alias("m")
    )
    median = exact_median(rows, ["store", "quarter"], "price")
    by = Window.partitionBy("store").orderBy("q_no")
    follows = F.lag("q_no").over(by) == F.col("q_no") - 1
    return facts.join(median, ["store", "quarter"]).withColumns(
        {"_m": F.when(follows, F.lag("m").over(by)), "_n": F.when(follows, F.lag("n_deals").over(by))}
    ).select(
        "store", "quarter", "n_deals", half_up(F.col("m"), 2).alias("avg_price"), half_up(F.col("median"), 2).alias("median_price"),
        half_up((F.col("m") - F.col("_m")) / F.col("_m") * 100, 1).alias("price_change_pct"),
        half_up((F.col("n_deals") - F.col("_n")) / F.col("_n") * 100, 1).alias("volume_change_pct"),
    )


def quarterly_winners(df: DataFrame, day: str = "obs_date") -> DataFrame:
    """Cheapest and second cheapest store per category and quarter."""
    rows = df.withColumn("quarter", F.concat(F.year(day), F.lit("-Q"), F.quarter(day)))
    means = rows.groupBy("quarter", "category", "store").agg(half_up(exact_avg(F.col("price")), 2).alias("m"))
    top = top_rows(means, ["quarter", "category"], [F.col("m"), F.col("store")], 2)
    first = F.col("rank") == 1
    return top.groupBy("quarter", "category").agg(
        F.max(F.when(first, F.col("store"))).alias("winner"), F.max(F.when(first, F.col("m"))).alias("winner_avg"),
        F.max(F.when(~first, F.col("store"))).alias("runner_up"), F.max(F.when(~first, F.col("m"))).alias("runner_up_avg"),
    )


def quarter_shift(df: DataFrame, before: str, after: str, day: str = "obs_date") -> DataFrame:
    """Mean price per category in two quarters (such as 2001-Q3) side by side, and the
    change.  Only the two quarters' days are read."""

    def days(quarter: str) -> Column:
        year, number = quarter.split("-Q")
        first = F.make_date(F.lit(int(year)), F.lit(3 * int(number) - 2), F.lit(1))
        return (F.col(day) >= first) & (F.col(day) < F.add_months(first, 3))

    rows = df.where(days(before) | days(after))
    rows = rows.withColumn("quarter", F.concat(F.year(day), F.lit("-Q"), F.quarter(day)))
    wide = rows.groupBy("category").pivot("quarter", [before, after]).agg(exact_avg(F.col("price")))
    a, b = F.col(f"`{before}`"), F.col(f"`{after}`")
    return wide.select(
        "category", half_up(a, 2).alias("before_avg"), half_up(b, 2).alias("after_avg"),
        half_up((b - a) / a * 100, 1).alias("change_pct"),
    )


def store_category_means(df: DataFrame) -> DataFrame:
    """Mean price of each store in each category."""
    return df.groupBy("store", "category").agg(
        F.count(F.lit(1)).alias("n_deals"), half_up(exact_avg(F.col("price")), 2).alias("avg_price")
    )

"""Deal scores, labels, tags and the sentences that explain them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricelens.functions import vocab
from pricelens.functions.numbers import clamp, half_up, money, whole
from pricelens.functions.text import first_rule


def _price_points(pct_below: Column) -> Column:
    # greatest() skips nulls, so an unknown percentage has to be ruled out first
    return (
        F.when(pct_below.isNull(), F.lit(0.0))
        .when(pct_below > 0, F.least(F.lit(35.0), pct_below * 0.7))
        .otherwise(F.greatest(F.lit(-25.0), pct_below * 0.5))
    )


def _bonus(test: Column, points: float) -> Column:
    return F.when(test, F.lit(float(points))).otherwise(F.lit(0.0))


def deal_score(
    pct_below_avg: Column, is_lowest: Column, rank: Column, rank_count: Column,
    unit_price: Column, is_key: Column,
) -> Column:
    """0-100 around a neutral 40 from history, other stores and data quality."""
    position = (
        F.when(rank.isNull() | ~(rank_count > 1), 0.0)
        .when(rank == 1, 20.0)
        .when(rank == 2, 10.0)
        .when(rank == 3, 5.0)
        .otherwise(-10.0)
    )
    total = (
        F.lit(40.0)
        + _price_points(pct_below_avg)
        + _bonus(is_lowest, 10)
        + F.coalesce(position, F.lit(0.0))
        + _bonus(unit_price.isNotNull(), 5)
        + _bonus(is_key, 5)
    )
    return half_up(clamp(total, 0, 100), 1)


def context_score(
    price: Column, avg: Column, low: Column, best: Column, n_stores: Column, store_rank: Column
) -> Column:
    """Whole-number score of the rule path; null statistics add nothing.

    ``store_rank`` is the place of the price among the store minima and the
    number of stores when the price is none of them.
    """
    pct = (avg - price) / F.nullif(avg, F.lit(0.0)) * 100
    market = (
        F.when(best.isNull(), 0.0)
        .when(price <= best, 20.0)
        .when(~(n_stores > 1), 0.0)
        .when(store_rank == 2, 10.0)
        .when(store_rank == 3, 5.0)
        .otherwise(-10.0)
    )
    total = (
        F.lit(40.0) + F.when(avg > 0, _price_points(pct)).otherwise(0.0)
        + _bonus(price <= low, 10) + F.coalesce(market, F.lit(0.0))
    )
    return clamp(F.floor(total).cast("double"), 0, 100).cast("bigint")


def rating(score: Column) -> Column:
    return first_rule(
        [(score >= floor, F.lit(label)) for floor, label in vocab.RATING_BANDS],
        F.lit(vocab.LOWEST_RATING),
    )


def badge(score: Column) -> Column:
    """Card badge by score band."""
    return first_rule([(score >= 80, F.lit("🌟")), (score >= 60, F.lit("✅"))], F.lit("⚪"))


def tone(score: Column) -> Column:
    """Colour band of a score."""
    return first_rule(
        [(score >= 80, F.lit("success")), (score >= 60, F.lit("info")), (score >= 40, F.lit("warning"))],
        F.lit("error"),
    )


def explanation(
    price: Column, avg: Column, low: Column, best: Column, best_store: Column, n_stores: Column
) -> Column:
    """Why a price is (not) a deal, in numbers."""
    pct = (avg - price) / F.nullif(avg, F.lit(0.0)) * 100
    history = first_rule(
        [
            (price <= low, F.concat(F.lit("LOWEST PRICE in 6 months (usually "), money(avg), F.lit(")"))),
            (pct > 15, F.concat(whole(pct), F.lit("% below 6-month avg of "), money(avg))),
            (pct > 0, F.concat(F.lit("Slightly below avg ("), money(avg), F.lit(")"))),
            (pct > -10, F.concat(F.lit("Near average ("), money(avg), F.lit(")"))),
            (pct.isNotNull(), F.concat(F.lit("Above average (usually "), money(avg), F.lit(")"))),
        ],
        F.lit(None).cast("string"),
    )
    market = first_rule(
        [
            (price <= best, F.concat(F.lit("Best price across "), n_stores.cast("string"), F.lit(" stores"))),
            (best.isNotNull(), F.concat(money(best), F.lit(" at "), best_store)),
        ],
        F.lit(None).cast("string"),
    )
    joined = F.concat_ws(". ", history, market)
    return F.when(joined == "", F.lit("Standard pricing (no historical data)")).otherwise(joined)


def tags(
    is_lowest: Column, pct_below_avg: Column, rank: Column, rank_count: Column,
    is_key: Column, score: Column,
) -> Column:
    """Up to five short labels of a deal."""
    labels = F.array(
        F.when(is_lowest, F.lit("LOWEST EVER")),
        F.when(pct_below_avg > 10, F.concat(F.floor(pct_below_avg).cast("string"), F.lit("% below avg"))),
        F.when(
            (rank == 1) & (rank_count > 1),
            F.concat(F.lit("Best of "), rank_count.cast("bigint").cast("string"), F.lit(" stores")),
        ),
        F.when(is_key, F.lit("Staple")),
        F.when(score >= 80, F.lit("Hot Deal")),
    )
    return F.filter(labels, lambda t: t.isNotNull())


def deal_context_text(
    is_counter: Column, unit_price: Column, is_lowest: Column, months: Column,
    pct: Column, avg: Column, best: Column,
) -> Column:
    """One line of report context, parts joined by a bar."""
    counter = F.when(
        is_counter & (unit_price > 0),
        F.concat(
            F.lit("Price is per 100g → real price "), money(unit_price * vocab.KG_PER_LB),
            F.lit("/lb ("), money(unit_price), F.lit("/kg)"),
        ),
    )
    history = first_rule(
        [
            (is_lowest & (months > 1), F.concat(F.lit("LOWEST in "), whole(months), F.lit(" months!"))),
            (is_lowest, F.lit("LOWEST PRICE!")),
            (pct > 5, F.concat(whole(pct), F.lit("% below avg "), money(avg))),
            (pct < -5, F.concat(F.lit("Above avg (usually "), money(avg), F.lit(")"))),
        ],
        F.lit(None).cast("string"),
    )
    market = F.when(best & ~is_counter, F.lit("Best price across stores"))
    return F.concat_ws(" | ", counter, history, market)


def history_sentence(
    price: Column, low: Column, high: Column, avg: Column, trend: Column, times: Column, weeks: Column
) -> Column:
    """Range, position, trend and frequency of an item; a fixed text when new."""
    now = F.concat(F.lit("Current "), money(price), F.lit(" is "))
    position = first_rule(
        [
            (price <= low * 1.02, F.concat(now, F.lit("at/near MINIMUM (best price seen!)"))),
            (price >= high * 0.98, F.concat(now, F.lit("at/near MAXIMUM (highest price)"))),
            (price <= avg * 0.9, F.concat(now, F.lit("BELOW average (good deal)"))),
            (price >= avg * 1.1, F.concat(now, F.lit("ABOVE average (expensive)"))),
        ],
        F.concat(now, F.lit("near average")),
    )
    direction = first_rule(
        [
            (trend == "DECREASING", F.lit("Price trend: DECREASING (getting cheaper)")),
            (trend == "INCREASING", F.lit("Price trend: INCREASING (getting more expensive)")),
        ],
        F.lit("Price trend: STABLE"),
    )
    text = F.concat_ws(
        " | ",
        F.concat(
            F.lit("Historical price range: "), money(low), F.lit(" - "), money(high),
            F.lit(" (avg: "), money(avg), F.lit(")"),
        ),
        position,
        direction,
        F.concat(F.lit("Seen "), times.cast("string"), F.lit(" times over "), weeks.cast("string"), F.lit(" weeks")),
    )
    return F.when(avg.isNull(), F.lit("No historical data available (new item).")).otherwise(text)


def calibration_sentence(member: Column, featured: Column, page: Column, validated: Column) -> Column:
    """Document-side signals of an item; null when there are none."""
    text = F.concat_ws(
        " | ",
        F.when(member, F.lit("⭐ MEMBER EXCLUSIVE (requires membership)")),
        F.when(
            featured,
            F.concat(
                F.lit("🎯 FEATURED ITEM (page "), F.coalesce(page.cast("string"), F.lit("unknown")),
                F.lit(", high visual prominence)"),
            ),
        ),
        F.when(validated, F.lit("✅ Price validated against PDF")),
    )
    return F.nullif(text, F.lit(""))


def notable_line(
    item: Column, price_text: Column, store: Column, saving: Column, score: Column,
    weeks_absent: Column, member: Column, featured: Column, why: Column,
) -> Column:
    """Summary line of a deal: head, context and a shortened explanation."""
    context = F.concat_ws(
        " | ",
        F.when(saving >= 0.20, F.concat(whole(saving * 100), F.lit("% below 12-week avg"))),
        F.when(score >= 90, F.lit("BEST PRICE")),
        F.when(weeks_absent >= 6, F.concat(F.lit("First time in "), weeks_absent.cast("string"), F.lit(" weeks"))),
        F.when(member, F.lit("Member Exclusive")),
        F.when(featured, F.lit("Featured Deal")),
    )
    told = (why != "") & ~F.lower(why).contains("unavailable")
    short = F.when(F.length(why) > 120, F.concat(F.substring(why, 1, 117), F.lit("..."))).otherwise(why)
    return F.concat_ws(
        "\n",
        F.concat(F.lit("**"), item, F.lit(" - "), price_text, F.lit("** ("), store, F.lit(")")),
        F.when(context != "", F.concat(F.lit("   → "), context)),
        F.when(told, F.concat(F.lit("   💡 "), short)),
    )


def against_average(price: Column, avg: Column) -> Column:
    return first_rule(
        [
            (price < avg, F.concat(money(avg - price), F.lit(" below avg"))),
            (price > avg, F.concat(money(price - avg), F.lit(" above avg"))),
        ],
        F.lit("At average"),
    )


def against_range(price: Column, low: Column, high: Column) -> Column:
    return F.when(price == low, F.lit("Lowest ever!")).when(price == high, F.lit("Highest seen"))

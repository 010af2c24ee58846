"""Historical statistics: matching tiers, like-for-like prices, trends."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelens.functions import vocab
from pricelens.functions.numbers import MONEY_STEPS, as_steps, half_up, weighted_avg
from pricelens.functions.text import is_blank, keywords, lower_or_blank, needed_hits
from pricelens.operators.filters import within_days
from pricelens.operators.market import prefix_market
from pricelens.plans.blocking import keyword_hits, keyword_links, substring_links
from pricelens.plans.joins import null_safe_join
from pricelens.plans.ranking import exact_median, positions, rank_probes, top_rows
from pricelens.session import cut_lineage, kept_partitions

NAME = ["item", "norm_name"]
# parts the history's values are dealt into when they meet the match keys
VALUE_PARTS = 64


def search_text(df: DataFrame) -> Column:
    """Text a keyword is looked up in: item and normalised name, lower case."""
    return F.concat_ws(" ", lower_or_blank(F.col("item")), lower_or_blank(F.col("norm_name")))


def counted_history(history: DataFrame) -> DataFrame:
    """History reduced to counted distinct prices per name; everything later
    joins these counts instead of raw rows.  Written once, read by all tiers."""
    return cut_lineage(
        history.groupBy(*NAME, "unit_type", "unit_price", "price").agg(F.count(F.lit(1)).alias("n"))
    )


def _keyword_key(names: DataFrame, skip: Sequence[str]) -> DataFrame:
    return names.withColumn("kws", F.array_sort(keywords(search_text(names), skip)))


def _keyword_matches(keyed: DataFrame, counted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Keyword links (mkey, mid), the hit set of each text (txt, mid), rows per mid."""
    texts = counted.withColumn("txt", search_text(counted)).groupBy("txt").agg(F.sum("n").alias("rows"))
    hits = keyword_hits(keyed, "kws", texts, "txt")
    sets = hits.select("txt", F.array_join("hits", " ").alias("mid"))
    rows = texts.join(sets, "txt").groupBy("mid").agg(F.sum("rows").alias("rows"))
    # the links are read several times: write them once
    links = cut_lineage(
        keyword_links(keyed, "kws", hits, needed_hits).select(
            F.array_join("kws", " ").alias("mkey"), F.array_join("hits", " ").alias("mid")
        )
    )
    return links, sets, rows


def assign_tiers(
    current: DataFrame, counted: DataFrame, prefix: int = 30, skip: Sequence[str] = vocab.MATCH_SKIP_WORDS
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Matching tier per distinct current name, and the history texts behind it.

    Tier 1: same normalised name, at least 3 history rows.  Tier 2: keyword
    overlap, at least 2 rows.  Tier 3: item prefix inside the history item.
    The first tier that passes wins.  Returns (item, norm_name, tier, kid),
    the links (tier, kid, mid) and, for tier 2, the hit set ``mid`` of each
    history text.  In the other tiers ``mid`` is the normalised name or the
    item text.  Names share match keys, and keys that link the same texts share a
    ``kid``, so statistics are computed once per set of texts and not once per
    current row.
    """
    names = current.select(*NAME).distinct()
    # tier 1
    by_norm = counted.where(~is_blank(F.col("norm_name"))).groupBy("norm_name").agg(F.sum("n").alias("rows"))
    exact = by_norm.where("rows >= 3").select("norm_name")
    one = names.join(exact, "norm_name", "left_semi").select(
        *NAME, F.lit(1).alias("tier"), F.col("norm_name").alias("mkey")
    )
    left = names.join(exact, "norm_name", "left_anti")
    # tier 2
    keyed = _keyword_key(left, skip)
    two_links, sets, rows = _keyword_matches(keyed, counted)
    enough = (
        two_links.join(rows, "mid").groupBy("mkey").agg(F.sum("rows").alias("rows")).where("rows >= 2").select("mkey")
    )
    keyed = keyed.withColumn("mkey", F.array_join("kws", " "))
    two = keyed.join(enough, "mkey", "left_semi").select(*NAME, F.lit(2).alias("tier"), "mkey")
    # tier 3
    rest = keyed.join(enough, "mkey", "left_anti").select(
        *NAME, F.lower(F.substring("item", 1, prefix)).alias("mkey")
    )
    items = counted.select(F.lower("item").alias("mid")).distinct()
    three_links = cut_lineage(substring_links(rest, "mkey", items, "mid"))
    three = rest.join(three_links.select("mkey").distinct(), "mkey", "left_semi").select(
        *NAME, F.lit(3).alias("tier"), "mkey"
    )
    matched = cut_lineage(one.unionByName(two).unionByName(three))
    links_all = (
        matched.where("tier = 1").select("tier", "mkey", F.col("mkey").alias("mid")).distinct()
        .unionByName(two_links.join(enough, "mkey", "left_semi").select(F.lit(2).alias("tier"), "mkey", "mid"))
        .unionByName(three_links.select(F.lit(3).alias("tier"), "mkey", "mid"))
    )
    # a long id per set of texts keeps the later shuffles narrow; written once, so it is fixed
    ids = cut_lineage(
        links_all.groupBy("tier", "mkey").agg(F.sort_array(F.collect_set("mid")).alias("mids"))
        .groupBy("tier", "mids").agg(F.collect_list("mkey").alias("mkeys"))
        .withColumn("kid", F.monotonically_increasing_id())
    )
    links = ids.select("tier", "kid", F.explode("mids").alias("mid"))
    keys = ids.select("tier", "kid", F.explode("mkeys").alias("mkey"))
    return matched.join(keys, ["tier", "mkey"]).select(*NAME, "tier", "kid"), links, sets


def _by_basis(counted: DataFrame) -> DataFrame:
    """Counted comparable values per name: shelf prices and unit prices by type."""
    shelf = counted.where("price is not null").select(
        *NAME, F.lit("shelf").alias("basis"), F.col("price").alias("value"), "n"
    )
    units = counted.where("unit_price is not null and unit_type is not null").select(
        *NAME, F.col("unit_type").alias("basis"), F.col("unit_price").alias("value"), "n"
    )
    return shelf.unionByName(units)


def key_values(links: DataFrame, sets: DataFrame, counted: DataFrame) -> DataFrame:
    """Counted values per match key: (kid, basis, value, n), written once."""
    values = _by_basis(counted)

    def side(tier: int, named: DataFrame) -> DataFrame:
        rows = named.groupBy("mid", "basis", "value").agg(F.sum("n").alias("n"))
        return rows.select(F.lit(tier).alias("tier"), "mid", "basis", "value", "n")

    sides = (
        side(1, values.withColumn("mid", F.col("norm_name")))
        .unionByName(side(2, values.withColumn("txt", search_text(values)).join(sets, "txt")))
        .unionByName(side(3, values.withColumn("mid", F.lower("item"))))
    )
    # a key's texts share most values: with each value in one part, and the links repeated
    # per part, a part adds them up itself and only sums leave it, not every (link, value)
    part = F.pmod(F.xxhash64("basis", "value"), F.lit(VALUE_PARTS)).cast("int")
    dealt = sides.join(links.select("tier", "mid").distinct(), ["tier", "mid"], "left_semi").withColumn("_part", part)
    spread = links.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(VALUE_PARTS - 1))))
    sums = (
        spread.repartition(VALUE_PARTS, "_part").join(dealt.repartition(VALUE_PARTS, "_part"), ["_part", "tier", "mid"])
        .groupBy("_part", "kid", "basis", "value").agg(F.sum("n").alias("n")).drop("_part")
    )
    with kept_partitions(links.sparkSession):
        return cut_lineage(sums)


def probe_stats(probes: DataFrame, values: DataFrame, method: str = "rank") -> DataFrame:
    """Like-for-like statistics of each probe against its match key's values.

    ``probes`` are distinct (kid, price, unit_price, unit_type).  Unit
    prices are compared when the probe has one and at least two matches share
    its unit type, shelf prices otherwise.  Fewer than two positive prices
    give null statistics.
    """
    group = ["kid", "basis"]
    facts = values.groupBy(*group).agg(
        F.sum("n").alias("all_rows"),
        F.min(F.when(F.col("value") > 0, F.col("value"))).alias("low"),
        F.max(F.when(F.col("value") > 0, F.col("value"))).alias("high"),
        weighted_avg(F.when(F.col("value") > 0, F.col("value")), F.col("n")).alias("avg"),
        F.coalesce(F.sum(F.when(F.col("value") > 0, F.col("n"))), F.lit(0)).alias("cnt"),
    )
    gate = facts.where("basis <> 'shelf' and all_rows >= 2").select(
        "kid", F.col("basis").alias("unit_type"), F.lit(True).alias("_like")
    )
    based = (
        probes.join(gate, ["kid", "unit_type"], "left")
        .withColumn(
            "basis",
            F.when(F.col("_like") & F.col("unit_price").isNotNull(), F.col("unit_type")).otherwise(F.lit("shelf")),
        )
        .withColumn("value", F.when(F.col("basis") == "shelf", F.col("price")).otherwise(F.col("unit_price")))
        .drop("_like")
    )
    ranked = rank_probes(values.where("value > 0"), based.select(*group, "value").distinct(), group, "value")
    joined = based.join(facts.where("cnt >= 2"), group, "left").join(ranked, [*group, "value"], "left")
    now = F.col("value")
    if method == "rank":
        tied = F.when(F.col("n_lt") < F.col("n_le"), 1).otherwise(0)
        pct = 100 - (F.col("n_lt") + F.col("n_le") + tied) * 50.0 / F.col("cnt")
    else:
        pct = F.col("n_lt") / F.col("cnt") * 100
    return joined.select(
        *probes.columns,
        half_up(F.col("low"), 2).alias("historical_min"),
        half_up(F.col("high"), 2).alias("historical_max"),
        half_up(F.col("avg"), 2).alias("historical_avg"),
        F.coalesce("cnt", F.lit(0)).alias("historical_count"),
        F.when(F.col("cnt").isNotNull(), half_up(pct, 1)).alias("price_percentile"),
        F.coalesce(now <= F.col("low"), F.lit(False)).alias("is_lowest"),
        half_up((F.col("avg") - now) / F.col("avg") * 100, 1).alias("pct_below_avg"),
    )


STATS = [
    "historical_min", "historical_max", "historical_avg", "historical_count",
    "price_percentile", "is_lowest", "pct_below_avg",
]


def historical_stats(
    current: DataFrame, history: DataFrame, method: str = "rank", prefix: int = 30
) -> DataFrame:
    """Current rows with the statistics of their best matching tier.

    The caller filters the history to its lookback window.  Work runs on
    distinct names, then on distinct probes (name, price, unit price); current
    rows only take part in the last join.
    """
    counted = counted_history(history)
    tiers, links, sets = assign_tiers(current, counted, prefix)
    probe = [*NAME, "price", "unit_price", "unit_type"]
    probes = cut_lineage(null_safe_join(current.select(*probe).distinct(), tiers, NAME))
    keyed = ["kid", "price", "unit_price", "unit_type"]
    stats = probe_stats(probes.select(*keyed).distinct(), key_values(links, sets, counted), method)
    found = null_safe_join(probes, stats, keyed).drop("tier", "kid")
    return null_safe_join(current, found, probe, "left").withColumns(
        {
            "historical_count": F.coalesce("historical_count", F.lit(0)),
            "is_lowest": F.coalesce("is_lowest", F.lit(False)),
        }
    )


def tier_matches(current: DataFrame, history: DataFrame, prefix: int = 30) -> DataFrame:
    """Tier and number of matched history rows of every distinct current name."""
    counted = counted_history(history)
    tiers, links, sets = assign_tiers(current, counted, prefix)
    sized = (
        counted.select(F.lit(1).alias("tier"), F.col("norm_name").alias("mid"), "n")
        .unionByName(counted.withColumn("txt", search_text(counted)).join(sets, "txt").select(F.lit(2).alias("tier"), "mid", "n"))
        .unionByName(counted.select(F.lit(3).alias("tier"), F.lower("item").alias("mid"), "n"))
        .groupBy("tier", "mid").agg(F.sum("n").alias("n"))
    )
    rows = links.join(sized, ["tier", "mid"]).groupBy("kid").agg(F.sum("n").alias("matched_rows"))
    return tiers.join(rows, "kid").select(*NAME, "tier", "matched_rows")


def detail_matches(current: DataFrame, history: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Detail-view matching: (item, norm_name, how, mkey, matched_rows), its links and hit sets.

    The exact name is used from three rows on; with fewer, keyword overlap
    replaces it when it finds more rows.
    """
    counted = counted_history(history)
    names = current.select(*NAME).distinct()
    by_norm = (
        counted.where(~is_blank(F.col("norm_name"))).groupBy("norm_name").agg(F.sum("n").alias("exact_rows"))
    )
    base = names.join(by_norm, "norm_name", "left").withColumn("exact_rows", F.coalesce("exact_rows", F.lit(0)))
    few = _keyword_key(base.where("exact_rows < 3"), vocab.DETAIL_SKIP_WORDS)
    links, sets, rows = _keyword_matches(few, counted)
    fuzzy = links.join(rows, "mid").groupBy("mkey").agg(F.sum("rows").alias("fuzzy_rows"))
    few = few.withColumn("mkey", F.array_join("kws", " ")).join(fuzzy, "mkey", "left")
    wins = F.coalesce("fuzzy_rows", F.lit(0)) > F.col("exact_rows")
    picked = few.select(
        *NAME,
        F.when(wins, "keywords").when(F.col("exact_rows") > 0, "exact").alias("how"),
        F.when(wins, F.col("mkey")).when(F.col("exact_rows") > 0, F.col("norm_name")).alias("mkey"),
        F.greatest("exact_rows", F.coalesce("fuzzy_rows", F.lit(0))).alias("matched_rows"),
    ).where("how is not null")
    sure = base.where("exact_rows >= 3").select(
        *NAME, F.lit("exact").alias("how"), F.col("norm_name").alias("mkey"), F.col("exact_rows").alias("matched_rows")
    )
    return sure.unionByName(picked), links, sets


def item_detail(current: DataFrame, history: DataFrame) -> DataFrame:
    """Matched rows, first and last day, lowest price with and without the current
    offers, and frequency per current name."""
    picked, links, sets = detail_matches(current, history)
    offered = current.groupBy(*NAME).agg(F.min("price").alias("_now"))
    dated = history.groupBy(*NAME).agg(
        F.min("obs_date").alias("d1"), F.max("obs_date").alias("d2"), F.min("price").alias("lo")
    )
    facts = [F.min("d1").alias("first_seen"), F.max("d2").alias("last_seen"), F.min("lo").alias("historical_min")]
    exact = dated.where(F.col("norm_name").isNotNull()).groupBy(F.col("norm_name").alias("mkey")).agg(*facts)
    per_set = (
        dated.withColumn("txt", search_text(dated)).join(sets, "txt").groupBy("mid")
        .agg(F.min("d1").alias("d1"), F.max("d2").alias("d2"), F.min("lo").alias("lo"))
    )
    fuzzy = links.join(per_set, "mid").groupBy("mkey").agg(*facts)
    found = exact.withColumn("how", F.lit("exact")).unionByName(fuzzy.withColumn("how", F.lit("keywords")))
    days = F.datediff("last_seen", "first_seen") / 30
    per_month = half_up(F.col("matched_rows") / F.greatest(days, F.lit(1.0)), 1)
    return null_safe_join(picked.join(found, ["how", "mkey"]), offered, NAME).select(
        *NAME, "how", "matched_rows", "first_seen", "last_seen", "historical_min",
        F.least("historical_min", "_now").alias("lowest_price"),
        F.when(F.col("matched_rows") >= 2, per_month).alias("per_month"),
    )


def matched_history(current: DataFrame, history: DataFrame) -> DataFrame:
    """The history behind every current name's detail view: item, norm_name, how,
    obs_date, store, price, n (equal sightings) and pos, from 1 by day, price and store.

    Rows are as many as each name's match has, so callers pass the names they show.
    """
    picked, links, sets = detail_matches(current, history)
    sightings = history.groupBy(*NAME, "obs_date", "store", "price").agg(F.count(F.lit(1)).alias("n"))
    facts = ["obs_date", "store", "price", "n"]
    exact = picked.where("how = 'exact'").select(*NAME, "how", "mkey").join(
        sightings.where(F.col("norm_name").isNotNull()).select(F.col("norm_name").alias("mkey"), *facts), "mkey")
    by_set = sightings.withColumn("txt", search_text(sightings)).join(sets, "txt").select("mid", *facts)
    fuzzy = picked.where("how = 'keywords'").select(*NAME, "how", "mkey").join(links, "mkey").join(by_set, "mid").drop("mid")
    rows = exact.unionByName(fuzzy).groupBy(*NAME, "how", "obs_date", "store", "price").agg(F.sum("n").alias("n"))
    return positions(rows, NAME, [(c, F.col(c)) for c in ("obs_date", "price", "store")])


def last_matched_sale(current: DataFrame, history: DataFrame, as_of: date) -> DataFrame:
    """Last sighting before a day in every current name's matched set: date, price,
    store and days since.  Sets bring their last sighting only, not their rows."""
    picked, links, sets = detail_matches(current, history)
    last = F.max("s").alias("s")
    past = history.where(F.col("obs_date") < F.lit(as_of)).groupBy(*NAME).agg(F.max(F.struct("obs_date", "price", "store")).alias("s"))
    exact = past.where(F.col("norm_name").isNotNull()).groupBy(F.col("norm_name").alias("mkey")).agg(last)
    per_set = past.withColumn("txt", search_text(past)).join(sets, "txt").groupBy("mid").agg(last)
    fuzzy = links.join(per_set, "mid").groupBy("mkey").agg(last)
    found = exact.withColumn("how", F.lit("exact")).unionByName(fuzzy.withColumn("how", F.lit("keywords")))
    return picked.join(found, ["how", "mkey"]).select(
        *NAME, "how", F.col("s.obs_date").alias("last_date"), F.col("s.price").alias("last_price"), F.col("s.store").alias("last_store"),
        F.datediff(F.lit(as_of), "s.obs_date").cast("bigint").alias("days_ago"),
    )


def prefix_stats(
    current: DataFrame, history: DataFrame, prefix: int = 30, min_rows: int = 2
) -> DataFrame:
    """Mean, lowest, highest and count of history prices of items that hold the
    current item's prefix; null below ``min_rows`` positive prices."""
    counted = history.groupBy(F.lower("item").alias("mid"), "price").agg(F.count(F.lit(1)).alias("n"))
    names = current.select("item").distinct().withColumn("pat", F.lower(F.substring("item", 1, prefix)))
    links = substring_links(names, "pat", counted, "mid")
    prices = links.join(counted, "mid").where("price > 0").groupBy("pat", "price").agg(F.sum("n").alias("n"))
    stats = prices.groupBy("pat").agg(
        (F.sum(as_steps(F.col("price")) * F.col("n")) / F.sum("n") / F.lit(float(MONEY_STEPS))).alias("avg_price"),
        F.min("price").alias("min_price"), F.max("price").alias("max_price"), F.sum("n").alias("n_prices"),
    ).where(F.col("n_prices") >= min_rows)
    return names.join(stats, "pat").drop("pat")


def sighting_cube(history: DataFrame) -> DataFrame:
    """(item_key, store, obs_date, price, n): equal sightings counted per item and
    store, and with store null per item.

    The history is read once; the item level adds up the counts, so no row of the
    history is repeated.  Sightings without a store count on the item level only.
    """
    facts = ["item_key", "store", "obs_date", "price"]
    counts = cut_lineage(
        history.select(F.lower("item").alias("item_key"), "store", "obs_date", "price").groupBy(*facts).agg(F.count(F.lit(1)).alias("n")))
    overall = counts.groupBy("item_key", "obs_date", "price").agg(F.sum("n").alias("n"))
    return cut_lineage(counts.where("store is not null").unionByName(overall.withColumn("store", F.lit(None).cast("string"))))


def item_store_stats(history: DataFrame) -> DataFrame:
    """Full statistics per lower-case item and store.

    Price range, mean, median, frequency, tracked weeks, trend of the latest
    three against the earliest three sightings, and the last sighting.  The
    store null row of an item holds its statistics over all stores, the
    fallback for stores without history of their own.
    """
    cube, keys = sighting_cube(history), ["item_key", "store"]
    paid = F.when(F.col("price") > 0, F.col("n"))
    facts = cube.groupBy(*keys).agg(
        F.min(F.when(F.col("price") > 0, F.col("price"))).alias("min_price"),
        F.max(F.when(F.col("price") > 0, F.col("price"))).alias("max_price"),
        (F.sum(as_steps(F.col("price")) * paid) / F.nullif(F.sum(paid), F.lit(0)) / F.lit(float(MONEY_STEPS))).alias("avg_price"),
        F.sum("n").alias("frequency"),
        # one bit a week of the year, so distinct weeks merge like any sum
        F.bit_count(F.bit_or(F.expr("shiftleft(1L, weekofyear(obs_date))"))).cast("bigint").alias("weeks_tracked"),
    ).where("min_price is not null").withColumn("weeks_tracked", F.coalesce("weeks_tracked", F.lit(0)))
    medians = exact_median(cube.where("price > 0"), keys, "price", out="median_price", weight="n")
    trend = price_trend(cube, keys, weight="n")
    return null_safe_join(null_safe_join(facts, medians, keys), trend, keys)


def _first_sightings(counted: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First ``k`` sightings per key, ``_times`` of each counted row; ``spot`` 1 is the first row."""
    by = Window.partitionBy(*[F.col(c) for c in keys]).orderBy(*order)
    before = F.coalesce(F.sum("_n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return top_rows(counted, keys, order, k, "spot").withColumn("_times", F.least("_n", k - before)).where("_times > 0")


def price_trend(history: DataFrame, keys: Sequence[str], weight: str | None = None) -> DataFrame:
    """Trend and last sighting per key; ties on a day go by price.  A row stands for
    ``weight`` equal sightings if that names a column."""
    keys = list(keys)
    counted = history.withColumn("_n", F.lit(1).cast("bigint") if weight is None else F.col(weight))
    late = _first_sightings(counted, keys, [F.col("obs_date").desc(), F.col("price").asc()], 3)
    early = _first_sightings(counted, keys, [F.col("obs_date").asc(), F.col("price").asc()], 3)
    priced = F.when(F.col("price").isNotNull(), F.col("_times"))
    mean = F.sum(as_steps(F.col("price")) * priced) / F.nullif(F.sum(priced), F.lit(0)) / F.lit(float(MONEY_STEPS))
    latest = late.groupBy(*keys).agg(
        mean.alias("_late"), F.sum("_times").alias("_n"),
        F.max(F.when(F.col("spot") == 1, F.col("price"))).alias("last_price"),
        F.max(F.when(F.col("spot") == 1, F.col("obs_date"))).alias("last_date"),
    )
    first = early.groupBy(*keys).agg(mean.alias("_early"))
    return null_safe_join(latest, first, keys).select(
        *keys,
        F.when(F.col("_n") < 2, "UNKNOWN")
        .when(F.col("_late") < F.col("_early") * 0.95, "DECREASING")
        .when(F.col("_late") > F.col("_early") * 1.05, "INCREASING")
        .otherwise("STABLE").alias("price_trend"),
        "last_price", "last_date",
    )


def with_item_store_stats(current: DataFrame, history: DataFrame) -> DataFrame:
    """Current rows with their store's statistics, else the item's."""
    stats = item_store_stats(history)
    own = stats.where("store is not null").withColumn("_own", F.lit(True))
    overall = stats.where("store is null").drop("store")
    facts = [c for c in overall.columns if c != "item_key"]
    keyed = current.withColumn("item_key", F.lower("item"))
    joined = keyed.join(own, ["item_key", "store"], "left").join(
        overall.withColumnsRenamed({c: f"_all_{c}" for c in facts}), "item_key", "left"
    )
    return joined.select(
        *current.columns,
        *[F.when(F.col("_own"), F.col(c)).otherwise(F.col(f"_all_{c}")).alias(c) for c in facts],
        F.when(F.col("_own"), "store").when(F.col("_all_frequency").isNotNull(), "item").alias("scope"),
    )


def item_average(current: DataFrame, history: DataFrame, as_of: date | None = None, weeks: int = 12) -> DataFrame:
    """Current rows with the mean positive history price of the same item, over the
    ``weeks`` before ``as_of`` or, without it, over all time."""
    if as_of is not None:
        history = within_days(history, as_of, 7 * weeks)
    means = history.where("price > 0").groupBy(F.lower("item").alias("item_key")).agg(
        (F.sum(as_steps(F.col("price"))) / F.count("price") / F.lit(float(MONEY_STEPS))).alias("hist_avg")
    )
    return current.withColumn("item_key", F.lower("item")).join(means, "item_key", "left").drop("item_key")


def deal_context(current: DataFrame, history: DataFrame, as_of: Column, prefix: int = 25) -> DataFrame:
    """Report context of every distinct (item, price, counter flag, unit price).

    Prefix matches in the whole history, at least three prices.  Corrected
    counter prices are compared per kilo, against counter history only.
    """
    probe = ["item", "price", "per_100g_corrected", "unit_price"]
    probes = current.select(*probe).distinct().withColumns(
        {
            "pat": F.lower(F.substring("item", 1, prefix)),
            "counter": F.coalesce("per_100g_corrected", F.lit(False)),
        }
    ).withColumn("now", F.when(F.col("counter") & (F.col("unit_price") > 0), F.col("unit_price")).otherwise(F.col("price")))
    day = history.withColumn("mid", F.lower("item"))
    rows = day.where("price > 0").select("mid", F.lit(False).alias("counter"), F.col("price").alias("value"), "obs_date")
    rows = rows.unionByName(
        day.where("price_basis = 'per_100g' and unit_price > 0").select(
            "mid", F.lit(True).alias("counter"), F.col("unit_price").alias("value"), "obs_date"
        )
    )
    seen = rows.groupBy("mid", "counter", "value").agg(F.count(F.lit(1)).alias("n"), F.max("obs_date").alias("last"))
    links = substring_links(probes, "pat", seen, "mid")
    prices = links.join(seen, "mid").groupBy("pat", "counter", "value").agg(
        F.sum("n").alias("n"), F.max("last").alias("last")
    )
    stats = prices.groupBy("pat", "counter").agg(
        (F.sum(as_steps(F.col("value")) * F.col("n")) / F.sum("n") / F.lit(float(MONEY_STEPS))).alias("avg"),
        F.min("value").alias("low"), F.sum("n").alias("cnt"),
    ).where("cnt >= 3")
    # the last day within a cent of the low
    low_days = (
        prices.join(stats.select("pat", "counter", "low"), ["pat", "counter"])
        .where(F.col("value") <= F.col("low") + 0.01)
        .groupBy("pat", "counter").agg(F.max("last").alias("last_low"))
    )
    market = prefix_market(current, probes.select("pat").distinct())
    joined = (
        probes.join(stats.join(low_days, ["pat", "counter"]), ["pat", "counter"], "left").join(market, "pat", "left")
    )
    lowest = F.coalesce(F.col("now") <= F.col("low"), F.lit(False))
    best = F.when(F.col("counter"), F.when(F.col("unit_rows") > 1, F.col("best_unit"))).otherwise(
        F.when(F.col("rows") > 1, F.col("best_price"))
    )
    return joined.select(
        *probe,
        half_up(F.col("avg"), 2).alias("historical_avg"),
        half_up(F.col("low"), 2).alias("historical_min"),
        half_up((F.col("avg") - F.col("now")) / F.col("avg") * 100, 1).alias("pct_below_avg"),
        lowest.alias("is_lowest"),
        F.when(lowest, half_up(F.datediff(as_of, "last_low") / 30, 1)).alias("months_since_low"),
        F.coalesce(F.col("now") <= best, F.lit(False)).alias("cross_store_best"),
        F.when(F.col("now") > best, half_up(F.col("now") - best, 2)).alias("cross_store_savings"),
    )

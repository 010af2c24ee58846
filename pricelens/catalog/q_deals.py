"""Queries: the published deal table (filters, sorts, pages, summaries)."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from pricelens.catalog.registry import avg, has_any, query, quoted, rnd
from pricelens.catalog.tables import AS_OF, TIE, observations, with_obs
from pricelens.functions import vocab
from pricelens.functions.score import badge, rating, tone
from pricelens.operators import deals as D
from pricelens.operators import filters as P
from pricelens.operators import summary as S

KEY = ["order_no", "line_no", "part_no", "supp_no"]
ROW = KEY + ["store", "item", "price", "deal_score"]
TIES = ", ".join(TIE)
LAST_DAY = date.fromisoformat(AS_OF)


def _rows(df, cols=ROW):
    return df.select(*cols)


def _check(where: str, cols=ROW) -> str:
    return with_obs(f"SELECT {', '.join(cols)} FROM obs WHERE {where}")


for _name, _where in {
    "lowest_ever": "is_lowest",
    "hot_deals": "deal_score >= 80",
    "best_protein": "category IN ('Beef', 'Pork', 'Poultry', 'Lamb', 'Seafood')",
    "under_5": "price < 5",
    "staples": "is_key",
}.items():
    query(f"preset_{_name}", _check(_where))(
        lambda spark, sf, n=_name: _rows(P.preset(observations(spark, sf), n))
    )


@query("equality_filters", _check("category = 'Seafood' AND store = 'Safeway' AND deal_score >= 40"))
def equality_filters(spark, sf):
    df = observations(spark, sf)
    return _rows(df.where((F.col("category") == "Seafood") & (F.col("store") == "Safeway") & (F.col("deal_score") >= 40)))


@query(
    "search_literal",
    _check("contains(lower(item), 'salmon') OR contains(lower(norm_name), 'salmon') OR contains(lower(brand), 'salmon')"
           " OR contains(lower(item), 'brand#1') OR contains(lower(norm_name), 'brand#1') OR contains(lower(brand), 'brand#1')"),
)
def search_literal(spark, sf):
    df = observations(spark, sf)
    salmon, brand = P.search(df, "Salmon"), P.search(df, "brand#1")
    return _rows(salmon.unionByName(brand.join(salmon.select(*KEY), KEY, "left_anti")))


@query(
    "search_regex",
    _check("regexp_matches(lower(item), 'beef|gin [0-9]+ kg') OR coalesce(regexp_matches(lower(norm_name), 'beef|gin [0-9]+ kg'), false)"
           " OR regexp_matches(lower(brand), 'beef|gin [0-9]+ kg')"),
)
def search_regex(spark, sf):
    return _rows(P.search(observations(spark, sf), "beef|gin [0-9]+ kg", mode="regex"))


@query(
    "filter_stack",
    _check("contains(lower(item), 'fresh') AND store = 'Sobeys' AND category = 'Poultry' AND sub_category = 'ECONOMY'"
           " AND price >= 2 AND price <= 18 AND ai_score >= 70 AND ai_score >= 50"),
)
def filter_stack(spark, sf):
    return _rows(
        P.filter_stack(observations(spark, sf), "fresh", "Sobeys", "Poultry", "ECONOMY", 2, 18, True, 50)
    )


@query(
    "subcategory_list",
    with_obs("SELECT DISTINCT category, sub_category FROM obs WHERE trim(sub_category) <> ''"),
)
def subcategory_list(spark, sf):
    return P.subcategories(observations(spark, sf))


@query(
    "lookback_window",
    with_obs(f"SELECT category, count(*) AS n, count(*) FILTER (obs_date >= DATE '{AS_OF}' - 180) AS n_180,"
             f" count(*) FILTER (obs_date >= DATE '{AS_OF}' - 84) AS n_84 FROM obs GROUP BY category"),
)
def lookback_window(spark, sf):
    df = observations(spark, sf)
    counts = df.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    for days in (180, 84):
        part = P.within_days(df, LAST_DAY, days).groupBy("category").agg(F.count(F.lit(1)).alias(f"n_{days}"))
        counts = counts.join(part, "category", "left").withColumn(f"n_{days}", F.coalesce(f"n_{days}", F.lit(0)))
    return counts


@query("expired_deals", _check(f"valid_until < DATE '{AS_OF}'"))
def expired_deals(spark, sf):
    return _rows(P.expired(observations(spark, sf), LAST_DAY))


@query("unscored_rows", _check("ai_score IS NULL OR ai_score = 0"))
def unscored_rows(spark, sf):
    return _rows(P.unscored(observations(spark, sf)))


@query(
    "deal_view",
    with_obs(
        "SELECT order_no, line_no, part_no, supp_no, coalesce(item, '') AS item, store, price, price_text, price_basis,"
        " unit_price, unit_type, deal_score, ai_score AS ai_deal_score, '' AS ai_deal_rating, '' AS ai_explanation,"
        " category, sub_category, brand, coalesce(norm_name, '') AS normalized_name, is_lowest AS is_lowest_historical,"
        " coalesce(pct_below_avg, 0) AS pct_below_avg, cross_store_rank, cross_store_count, is_key AS is_kvi,"
        " concat_ws('|', CASE WHEN is_lowest THEN 'LOWEST EVER' END,"
        " CASE WHEN pct_below_avg > 10 THEN concat(cast(floor(pct_below_avg) as bigint), '% below avg') END,"
        " CASE WHEN cross_store_rank = 1 AND cross_store_count > 1 THEN concat('Best of ', cross_store_count, ' stores') END,"
        " CASE WHEN is_key THEN 'Staple' END, CASE WHEN deal_score >= 80 THEN 'Hot Deal' END) AS tags FROM obs"
    ),
)
def deal_view(spark, sf):
    shown = D.deal_view(observations(spark, sf), KEY).withColumn("tags", F.array_join("tags", "|"))
    return shown.drop("historical_min", "historical_max", "historical_avg", "historical_count", "price_percentile")


@query(
    "point_lookup",
    with_obs("SELECT p.part_no AS wanted, o.order_no, o.line_no, o.supp_no, o.item, o.price FROM"
             " (SELECT p_partkey AS part_no FROM part) p LEFT JOIN obs o ON o.part_no = p.part_no"),
)
def point_lookup(spark, sf):
    """Every part number looked up in the deal table; unknown ids give nulls."""
    from pricelens.catalog.tables import table

    wanted = table(spark, sf, "part").select(F.col("p_partkey").alias("wanted"))
    cols = ["part_no", "order_no", "line_no", "supp_no", "item", "price"]
    found = observations(spark, sf, cols).select(*cols)
    return wanted.join(found, F.col("wanted") == F.col("part_no"), "left").drop("part_no")


for _name, _order in {
    "score_desc": "deal_score DESC NULLS LAST",
    "score_asc": "deal_score NULLS LAST",
    "price_asc": "price NULLS LAST",
    "price_desc": "price DESC NULLS LAST",
    "pct_below_desc": "pct_below_avg DESC NULLS LAST",
    "name_asc": "item NULLS LAST",
    "name_store": "item NULLS LAST, store NULLS LAST",
}.items():
    query(
        f"deals_page_{_name}",
        with_obs(f"SELECT {', '.join(ROW)}, pct_below_avg FROM obs ORDER BY {_order}, {TIES} LIMIT 50 OFFSET 50"),
    )(
        lambda spark, sf, n=_name: D.page(
            observations(spark, sf).select(*ROW, "pct_below_avg", "obs_date"), D.sort_order(n, TIE), 50, 50
        ).drop("obs_date")
    )


@query(
    "deals_page_filtered",
    with_obs(f"WITH f AS (SELECT * FROM obs WHERE is_key AND deal_score >= 60 AND category = 'Beef')"
             f" SELECT {', '.join(ROW)} FROM f"
             f" ORDER BY price NULLS LAST, {TIES} LIMIT 500"),
)
def deals_page_filtered(spark, sf):
    """A page over a filter stack: all 500 rows asked for."""
    df = P.preset(observations(spark, sf), "staples").where((F.col("deal_score") >= 60) & (F.col("category") == "Beef"))
    rows = D.page(df.select(*ROW, "obs_date"), D.sort_order("price_asc", TIE), 0, 500)
    return rows.drop("obs_date")


@query("deals_total", with_obs("SELECT count(*) AS total FROM obs WHERE is_key AND deal_score >= 60 AND category = 'Beef'"))
def deals_total(spark, sf):
    """The total before paging."""
    df = P.preset(observations(spark, sf), "staples")
    return D.total_rows(df.where((F.col("deal_score") >= 60) & (F.col("category") == "Beef")))


@query("top_deals", with_obs(f"SELECT {', '.join(ROW)} FROM obs ORDER BY deal_score DESC, {TIES} LIMIT 20"))
def top_deals(spark, sf):
    return D.top(observations(spark, sf).select(*ROW, "obs_date"), D.sort_order("score_desc", TIE), 20).drop("obs_date")


def _topk(name: str, keys: list[str], order: str, k: int):
    sql = with_obs(
        f"SELECT {', '.join(ROW)}, category, rank FROM (SELECT *, row_number() OVER (PARTITION BY {', '.join(keys)}"
        f" ORDER BY {order}, {TIES}) AS rank FROM obs) WHERE rank <= {k}"
    )

    def run(spark, sf):
        by = [F.expr(order.split()[0]).desc_nulls_last() if "DESC" in order else F.col(order.split()[0]).asc_nulls_last()]
        rows = D.top_per(observations(spark, sf).select(*ROW, "category", "obs_date"), keys, by + [F.col(t) for t in TIE], k)
        return rows.drop("obs_date").withColumn("rank", F.col("rank").cast("bigint"))

    query(name, sql)(run)


_topk("topk_per_store", ["store"], "deal_score DESC NULLS LAST", 10)
_topk("topk_per_category", ["category"], "deal_score DESC NULLS LAST", 10)
_topk("topk_per_store_category", ["store", "category"], "deal_score DESC NULLS LAST", 3)
_topk("cheapest_per_store", ["store"], "price NULLS LAST", 5)

# feed headers: one per order; the customer's segment stands for the store
FEEDS = (
    "feeds AS (SELECT c_mktsegment AS store, o_orderkey AS feed_pos, cast(o_orderdate as date) AS valid_from,"
    " cast(cast(o_orderdate as date) + INTERVAL 7 DAYS as date) AS valid_until,"
    " concat(CASE WHEN o_orderstatus = 'P' THEN 'Weekly ' ELSE 'Special ' END, o_orderpriority) AS name"
    " FROM orders JOIN customer ON o_custkey = c_custkey)"
)


def feeds(spark, sf):
    from pricelens.catalog.tables import table

    return (
        table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.col("c_mktsegment").alias("store"), F.col("o_orderkey").alias("feed_pos"),
            F.to_date("o_orderdate").alias("valid_from"),
            F.date_add(F.to_date("o_orderdate"), 7).alias("valid_until"),
            F.concat(
                F.when(F.col("o_orderstatus") == "P", F.lit("Weekly ")).otherwise(F.lit("Special ")),
                F.col("o_orderpriority"),
            ).alias("name"),
        )
    )


def _feed_query(name: str, order: str, fn):
    cols = "store, feed_pos, name, cast(valid_from as varchar) AS valid_from, cast(valid_until as varchar) AS valid_until"
    sql = (
        f"WITH {FEEDS} SELECT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY store ORDER BY {order}) AS r"
        " FROM feeds) WHERE r = 1"
    )
    query(name, sql)(
        lambda spark, sf: fn(feeds(spark, sf)).withColumns(
            {"valid_from": F.col("valid_from").cast("string"), "valid_until": F.col("valid_until").cast("string")}
        )
    )


_feed_query("newest_feed_per_store", "valid_from DESC, feed_pos", D.newest_per_store)
_feed_query("latest_ending_feed", "valid_until DESC, feed_pos", D.latest_ending_per_store)
_feed_query(
    "weekly_feed_per_store", "CASE WHEN contains(lower(name), 'weekly') THEN 0 ELSE 1 END, feed_pos", D.weekly_per_store
)


@query(
    "recent_sightings",
    with_obs("WITH n AS (SELECT lower(item) AS name, list({'item': item, 'store': store, 'price': price, 'order_no': order_no,"
             " 'obs_date': obs_date, 'line_no': line_no}) AS l, count(*) AS c FROM obs GROUP BY 1),"
             " s AS (SELECT DISTINCT lower(item) AS sought FROM obs WHERE status = 'O'),"
             " j AS (SELECT sought, unnest(l) AS r, sum(c) OVER (PARTITION BY sought) AS c FROM s JOIN n ON contains(name, sought))"
             " SELECT * FROM (SELECT sought, r.item AS item, r.store AS store, r.price AS price, r.order_no AS order_no,"
             " cast(r.obs_date as varchar) AS obs_date, row_number() OVER"
             " (PARTITION BY sought ORDER BY r.obs_date DESC, r.price, r.store, r.order_no, r.line_no) AS rank FROM j WHERE c >= 2)"
             " WHERE rank <= 10"),
)
def recent_sightings(spark, sf):
    """Last ten sightings of every current item, by part of the name."""
    rows = observations(spark, sf)
    sought = rows.where("status = 'O'").select("item")
    seen = rows.select("item", "store", "price", "order_no", "line_no", "obs_date")
    out = D.recent_sightings(sought, seen, "item", 10, ("price", "store", "order_no", "line_no"))
    return out.drop("line_no").withColumns(
        {"obs_date": F.col("obs_date").cast("string"), "rank": F.col("rank").cast("bigint")}
    )


@query(
    "price_history",
    with_obs("SELECT item, store, price, cast(obs_date as varchar) AS obs_date, row_number() OVER"
             " (PARTITION BY item ORDER BY obs_date, store, price) AS pos FROM obs"),
)
def price_history(spark, sf):
    return D.price_history(observations(spark, sf), "item").withColumn("obs_date", F.col("obs_date").cast("string"))


@query(
    "member_items_json",
    with_obs("""WITH m AS (SELECT store, item, price_text, row_number() OVER (PARTITION BY store
        ORDER BY obs_date, order_no, line_no, part_no, supp_no, price) AS r FROM obs WHERE member)
        SELECT store, count(*) AS n_items, concat('[', string_agg(concat('{"name":"', item, '","price":"', price_text, '"}'), ','
        ORDER BY r), ']') AS items_json FROM m WHERE r <= 10 GROUP BY store"""),
)
def member_items_json(spark, sf):
    rows = observations(spark, sf).where("member").select("store", "item", "price_text", *TIE)
    return D.first_items_json(rows, "store", [F.col(t) for t in TIE])


# --- summaries -------------------------------------------------------------------


@query(
    "store_summary",
    with_obs(f"SELECT store, count(*) AS deal_count, {rnd(avg('deal_score'), 1)} AS avg_score,"
             " count(*) FILTER (deal_score >= 80) AS hot_deals, count(*) FILTER (is_lowest) AS lowest_ever,"
             f" coalesce({rnd(avg('CASE WHEN pct_below_avg > 0 THEN pct_below_avg END'), 1)}, 0) AS avg_savings"
             " FROM obs GROUP BY store"),
)
def store_summary(spark, sf):
    return S.store_summary(observations(spark, sf))


@query(
    "category_summary",
    with_obs(f"SELECT category, count(*) AS deal_count, {rnd(avg('deal_score'), 1)} AS avg_score FROM obs GROUP BY category"),
)
def category_summary(spark, sf):
    return S.category_summary(observations(spark, sf))


@query(
    "insights",
    with_obs(f"""WITH s AS (SELECT store, {avg('deal_score')} AS m, count(*) AS n FROM obs GROUP BY store),
        b AS (SELECT store, m, n FROM s ORDER BY m DESC, n DESC LIMIT 1)
        SELECT count(*) AS total_deals, count(*) FILTER (is_lowest) AS lowest_ever_count,
        count(*) FILTER (deal_score >= 80) AS hot_deal_count, count(*) FILTER (is_key) AS kvi_on_sale,
        {rnd(avg('deal_score'), 1)} AS avg_score, cast(min(valid_from) as varchar) AS valid_from,
        cast(max(valid_until) as varchar) AS valid_until, (SELECT store FROM b) AS best_store,
        (SELECT {rnd('m', 1)} FROM b) AS best_store_score, (SELECT n FROM b) AS best_store_deals FROM obs"""),
)
def insights(spark, sf):
    return S.insights(observations(spark, sf)).withColumns(
        {"valid_from": F.col("valid_from").cast("string"), "valid_until": F.col("valid_until").cast("string")}
    )


@query(
    "insight_lists",
    with_obs(f"""SELECT 'category' AS section, category AS name, count(*) AS n, NULL::varchar AS store, NULL::double AS price,
        NULL::double AS deal_score, NULL::bigint AS rank FROM obs GROUP BY category
        UNION ALL SELECT 'store', store, count(*), NULL, NULL, NULL, NULL FROM obs GROUP BY store
        UNION ALL SELECT 'top', item, 1, store, price, deal_score, r FROM (SELECT *, row_number() OVER (ORDER BY deal_score DESC, {TIES}) AS r
          FROM obs) WHERE r <= 5"""),
)
def insight_lists(spark, sf):
    """Deals per category and store, and the five best."""
    return S.insight_lists(observations(spark, sf), D.sort_order("score_desc", TIE))


_top_proteins = with_obs(
    f"SELECT item, store, price_text, ai_score FROM obs WHERE ai_score > 0 AND {has_any('lower(item)', vocab.PROTEIN_WORDS)}"
    f" ORDER BY ai_score DESC, {TIES} LIMIT 10"
)


@query("protein_top_ten", _top_proteins)
def protein_top_ten(spark, sf):
    rows = P.best_proteins(observations(spark, sf), vocab.PROTEIN_WORDS, 10, TIE)
    return rows.select("item", "store", "price_text", "ai_score")


_after = with_obs(f"SELECT {', '.join(ROW)} FROM obs ORDER BY deal_score DESC NULLS LAST, {TIES} LIMIT 50 OFFSET 50")


@query("deals_page_after", _after)
def deals_page_after(spark, sf):
    """The second page, read from behind the first one's last row."""
    order = [("deal_score", False), *[(t, True) for t in TIE]]
    rows = observations(spark, sf).select(*dict.fromkeys([*ROW, "deal_score", *TIE]))
    first = D.page_after(rows, order, None, 50).collect()
    return D.page_after(rows, order, first[-1].asDict(), 50).select(*ROW)


@query("category_frequency", with_obs("SELECT category, count(*) AS n FROM obs GROUP BY category"))
def category_frequency(spark, sf):
    return S.frequency(observations(spark, sf), "category")


@query("item_frequency_head", with_obs("SELECT item, count(*) AS n FROM obs GROUP BY item ORDER BY n DESC, item LIMIT 10"))
def item_frequency_head(spark, sf):
    return S.frequency(observations(spark, sf), "item", 10)


def _bands() -> str:
    s = "deal_score"
    parts = {
        "hot": f"{s} >= 85", "good": f"{s} >= 70 AND {s} < 85", "fair": f"{s} >= 50 AND {s} < 70",
        "below": f"{s} >= 30 AND {s} < 50", "poor": f"{s} < 30", "exceptional": f"{s} >= 90",
        "great": f"{s} >= 75 AND {s} < 90", "solid": f"{s} >= 60 AND {s} < 75", "band_0_20": f"{s} <= 20",
        "band_21_40": f"{s} > 20 AND {s} <= 40", "band_41_60": f"{s} > 40 AND {s} <= 60",
        "band_61_80": f"{s} > 60 AND {s} <= 80", "band_81_100": f"{s} > 80",
    }
    counts = ", ".join(f"count(*) FILTER ({t}) AS {n}" for n, t in parts.items())
    return f"SELECT {counts}, min({s}) AS lowest, max({s}) AS highest, {rnd(avg(s), 1)} AS mean FROM obs"


@query("score_bands", with_obs(_bands()))
def score_bands(spark, sf):
    return S.score_bands(observations(spark, sf))


@query(
    "score_labels",
    with_obs("""SELECT order_no, line_no, part_no, supp_no,
        CASE WHEN deal_score >= 85 THEN '🔥 Hot Deal' WHEN deal_score >= 70 THEN '✅ Good Buy'
         WHEN deal_score >= 50 THEN '😐 Fair' WHEN deal_score >= 30 THEN '⚠️ Below Average' ELSE '❌ Poor Value' END AS rating,
        CASE WHEN deal_score >= 80 THEN '🌟' WHEN deal_score >= 60 THEN '✅' ELSE '⚪' END AS badge,
        CASE WHEN deal_score >= 80 THEN 'success' WHEN deal_score >= 60 THEN 'info' WHEN deal_score >= 40 THEN 'warning'
         ELSE 'error' END AS tone FROM obs"""),
)
def score_labels(spark, sf):
    s = F.col("deal_score")
    return observations(spark, sf).select(*KEY, rating(s).alias("rating"), badge(s).alias("badge"), tone(s).alias("tone"))


@query(
    "distinct_counts",
    with_obs("SELECT count(DISTINCT store) AS n_store, count(DISTINCT item) AS n_item,"
             " count(DISTINCT norm_name) AS n_norm_name, count(DISTINCT category) AS n_category FROM obs"),
)
def distinct_counts(spark, sf):
    return S.distinct_counts(observations(spark, sf), ["store", "item", "norm_name", "category"])


@query(
    "coverage",
    with_obs(f"""SELECT count(*) AS n_rows, count(unit_price) AS with_unit_price,
        {rnd('count(unit_price) / count(*) * 100', 1)} AS unit_price_share,
        count(*) FILTER (price_basis IN ('per_lb', 'per_kg', 'per_100g')) AS per_weight,
        count(*) FILTER (price_basis = 'multi_buy') AS multi_buy, count(*) FILTER (price_basis = 'each') AS each,
        count(*) FILTER (pct_below_avg IS NOT NULL) AS with_history, count(*) FILTER (cross_store_count > 1) AS multi_store,
        count(*) FILTER (price > 0) AS priced, count(*) FILTER (price = 0) AS unpriced,
        {rnd(avg('CASE WHEN price > 0 THEN price END'))} AS avg_price FROM obs"""),
)
def coverage(spark, sf):
    df = observations(spark, sf).withColumn("historical_count", F.col("pct_below_avg").isNotNull().cast("int"))
    return S.coverage(df)


@query(
    "expiry_table",
    with_obs(f"SELECT cast(valid_until as varchar) AS valid_until, count(*) AS n,"
             f" cast(valid_until - DATE '{AS_OF}' as bigint) AS days_left, valid_until < DATE '{AS_OF}' AS is_expired"
             " FROM obs GROUP BY valid_until"),
)
def expiry_table(spark, sf):
    return S.expiry_table(observations(spark, sf), LAST_DAY).withColumn("valid_until", F.col("valid_until").cast("string"))


@query(
    "fallback_rate",
    f"""WITH e AS (SELECT d.doc_id, CASE WHEN l.quality IS NULL THEN 'statistical' ELSE 'model' END AS confidence
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
        SELECT count(*) AS total, count(*) FILTER (confidence = 'statistical') AS fallback,
        {rnd("count(*) FILTER (confidence = 'statistical') / count(*) * 100", 1)} AS fallback_pct,
        count(*) FILTER (confidence = 'statistical') / count(*) * 100 > 10 AS alert FROM e""",
)
def fallback_rate(spark, sf):
    from pricelens.catalog.tables import table

    docs = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    return S.fallback_rate(
        docs.select(F.when(F.col("quality").isNull(), "statistical").otherwise("model").alias("confidence"))
    )


@query(
    "enrichment_checks",
    with_obs(f"""WITH f AS (SELECT {rnd("count(*) FILTER (category = 'Other') / count(*) * 100", 1)} AS o,
        count(DISTINCT CASE WHEN deal_score >= 85 THEN 5 WHEN deal_score >= 70 THEN 4 WHEN deal_score >= 50 THEN 3
         WHEN deal_score >= 30 THEN 2 ELSE 1 END) AS r,
        {rnd("count(*) FILTER (sub_category <> '') / count(*) * 100", 1)} AS s FROM obs)
        SELECT 'other_category' AS "check", o AS value, o <= 80 AS passed FROM f
        UNION ALL SELECT 'rating_variety', cast(r as double), r >= 3 FROM f
        UNION ALL SELECT 'sub_category', s, s > 0 FROM f"""),
)
def enrichment_checks(spark, sf):
    return S.enrichment_checks(observations(spark, sf).withColumn("rating", rating(F.col("deal_score"))))


@query(
    "sale_frequency",
    with_obs(f"SELECT item, n_seen, {rnd('n_seen / greatest(days / 30.0e0, 1.0e0)', 1)} AS per_month FROM"
             " (SELECT item, count(*) AS n_seen, max(obs_date) - min(obs_date) AS days FROM obs GROUP BY item)"
             " WHERE n_seen >= 2"),
)
def sale_frequency(spark, sf):
    return S.sale_frequency(observations(spark, sf), "item")


@query(
    "last_sale_before",
    with_obs(f"""SELECT item, cast(obs_date as varchar) AS last_date, price AS last_price, store AS last_store,
        cast(DATE '{AS_OF}' - obs_date as bigint) AS days_ago FROM (SELECT *, row_number() OVER (PARTITION BY item
        ORDER BY obs_date DESC, price DESC, store DESC) AS r FROM obs WHERE obs_date < DATE '{AS_OF}') WHERE r = 1"""),
)
def last_sale_before(spark, sf):
    return S.last_sale_before(observations(spark, sf), "item", LAST_DAY).withColumn(
        "last_date", F.col("last_date").cast("string")
    )


@query(
    "weeks_since_seen",
    with_obs(f"""SELECT item_key, cast(floor((DATE '{AS_OF}' - obs_date) / 7) as bigint) AS weeks_absent,
        floor((DATE '{AS_OF}' - obs_date) / 7) >= 6 AS is_notable FROM (SELECT lower(item) AS item_key, obs_date, row_number()
        OVER (PARTITION BY lower(item) ORDER BY obs_date DESC) AS r FROM obs WHERE price > 0) WHERE r = 2"""),
)
def weeks_since_seen(spark, sf):
    return S.weeks_since_seen(observations(spark, sf), LAST_DAY)


_REVIEW = """r AS (SELECT doc_id, CASE WHEN n_chars % 97 = 0 THEN cast(null as varchar) ELSE source END AS item,
    CASE WHEN n_chars % 13 = 0 THEN cast(null as double) ELSE (n_chars % 100) / 100.0e0 END AS confidence,
    (n_chars % 2400) / 20.0e0 AS price FROM documents)"""


def _review_rows(spark, sf):
    from pricelens.catalog.tables import table

    n = F.col("n_chars")
    return table(spark, sf, "documents").select(
        "doc_id",
        F.when(n % 97 != 0, F.col("source")).alias("item"),
        F.when(n % 13 != 0, (n % 100) / 100.0).alias("confidence"),
        ((n % 2400) / 20.0).alias("price"),
    )


@query(
    "review_flags",
    f"""WITH {_REVIEW} SELECT doc_id, concat_ws('; ',
        CASE WHEN coalesce(confidence, 0.5) < 0.8 THEN printf('Low AI confidence (%.2f)', coalesce(confidence, 0.5)) END,
        CASE WHEN price > 100 THEN printf('Unusually high price ($%.2f)', price)
         WHEN price > 0 AND price < 0.1 THEN printf('Unusually low price ($%.2f)', price) END,
        CASE WHEN coalesce(item, '') = '' THEN 'Missing product name' END) AS issues,
        coalesce(confidence, 0.5) < 0.8 OR price > 100 OR (price > 0 AND price < 0.1) OR coalesce(item, '') = ''
         AS needs_review FROM r""",
)
def review_flags(spark, sf):
    return P.with_review_flags(_review_rows(spark, sf)).select(
        "doc_id", F.array_join("validation_issues", "; ").alias("issues"), "needs_review"
    )


@query(
    "confidence_bands",
    f"""WITH {_REVIEW}, c AS (SELECT coalesce(confidence, 0.5) AS c, coalesce(confidence, 0.5) < 0.8 OR price > 100
         OR (price > 0 AND price < 0.1) OR coalesce(item, '') = '' AS rev FROM r)
        SELECT count(*) AS total, count(*) FILTER (c >= 0.9) AS high, count(*) FILTER (c >= 0.7 AND c < 0.9) AS medium,
        count(*) FILTER (c < 0.7) AS low, count(*) FILTER (rev) AS needs_review,
        {rnd('count(*) FILTER (c >= 0.9) / count(*) * 100', 1)} AS high_pct,
        {rnd('count(*) FILTER (rev) / count(*) * 100', 1)} AS review_pct FROM c""",
)
def confidence_bands(spark, sf):
    return S.confidence_bands(P.with_review_flags(_review_rows(spark, sf)))


@query(
    "list_metrics",
    with_obs(f"SELECT count(*) AS n_deals, {rnd(avg('price'))} AS avg_price, count(*) FILTER (ai_score >= 70) AS top_deals,"
             f" {rnd(avg('ai_score'), 0)} AS avg_score, count(DISTINCT item) AS n_items, count(DISTINCT store) AS n_stores"
             " FROM obs WHERE price >= 2 AND price <= 20 AND ai_score >= 10"),
)
def list_metrics(spark, sf):
    return S.list_metrics(P.filter_stack(observations(spark, sf), low=2, high=20, min_score=10))


@query(
    "price_describe",
    with_obs(f"SELECT count(price) AS count, {rnd(avg('price'), 4)} AS mean, {rnd('stddev_samp(price)', 4)} AS std,"
             " min(price) AS min, max(price) AS max FROM obs"),
)
def price_describe(spark, sf):
    return S.describe_price(observations(spark, sf))


@query(
    "week_overview",
    with_obs("SELECT count(*) AS n_deals, count(DISTINCT store) AS n_stores, count(*) FILTER (ai_score >= 85) AS great,"
             " count(*) FILTER (ai_score >= 90) AS exceptional, count(*) FILTER (member) AS member_deals FROM obs"),
)
def week_overview(spark, sf):
    return S.week_overview(observations(spark, sf))


@query(
    "best_category",
    with_obs(f"""WITH g AS (SELECT category, {avg('deal_score')} AS m, count(*) FILTER (deal_score >= 85) AS h FROM obs GROUP BY 1)
        SELECT (SELECT category FROM g ORDER BY m DESC, category LIMIT 1) AS best_mean,
        (SELECT {rnd('m', 1)} FROM g ORDER BY m DESC, category LIMIT 1) AS mean_score,
        (SELECT category FROM g ORDER BY h DESC, category LIMIT 1) AS most_hot,
        (SELECT h FROM g ORDER BY h DESC, category LIMIT 1) AS hot_rows"""),
)
def best_category(spark, sf):
    return S.best_group(observations(spark, sf), "category")


@query(
    "savings_summary",
    with_obs(f"""WITH s AS (SELECT coalesce((original_price - price) / nullif(original_price, 0) * 100, 0) AS p FROM obs)
        SELECT count(*) AS n_rows, count(*) FILTER (p > 0) AS n_saving,
        {rnd(avg('CASE WHEN p > 0 THEN p END'), 1)} AS avg_saving FROM s"""),
)
def savings_summary(spark, sf):
    from pricelens.functions.price import savings_pct

    df = observations(spark, sf)
    return S.savings_summary(df.select(savings_pct(F.col("price"), F.col("original_price")).alias("savings_pct")))


@query(
    "top_savings",
    with_obs(f"""SELECT order_no, line_no, part_no, supp_no, item, price, original_price,
        {rnd('(original_price - price) / original_price * 100', 1)} AS savings_pct FROM obs
        ORDER BY {rnd('(original_price - price) / original_price * 100', 1)} DESC, {TIES} LIMIT 5"""),
)
def top_savings(spark, sf):
    from pricelens.functions.numbers import half_up
    from pricelens.functions.price import savings_pct

    df = observations(spark, sf).select(
        *KEY, "item", "price", "original_price", "obs_date",
        half_up(savings_pct(F.col("price"), F.col("original_price")), 1).alias("savings_pct"),
    )
    return D.top(df, [F.desc("savings_pct"), *[F.col(t) for t in TIE]], 5).drop("obs_date")


@query(
    "protein_subset",
    with_obs(f"""WITH p AS (SELECT * FROM obs WHERE ai_score > 0 AND {has_any('lower(item)', vocab.PROTEIN_WORDS)})
        SELECT category, count(*) AS n, {rnd(avg('ai_score'), 1)} AS avg_score,
        count(*) FILTER ({has_any('lower(item)', vocab.PREMIUM_WORDS)}) AS n_premium FROM p GROUP BY category"""),
)
def protein_subset(spark, sf):
    from pricelens.functions.numbers import exact_avg, half_up
    from pricelens.functions.rules import names_any

    scored = observations(spark, sf).where("ai_score > 0")
    return P.name_matches(scored, vocab.PROTEIN_WORDS).groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), half_up(exact_avg(F.col("ai_score")), 1).alias("avg_score"),
        F.count_if(names_any(F.col("item"), vocab.PREMIUM_WORDS)).alias("n_premium"),
    )

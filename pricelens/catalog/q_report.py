"""Queries: the weekly job, item statistics, reports and quarters."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from pricelens.catalog.q_history import STATS, _TXT, _kws
from pricelens.catalog.q_market import RANKED
from pricelens.catalog.q_match import CURHIST
from pricelens.catalog.q_parse import COUNTER, _DRINK
from pricelens.catalog.registry import avg, has_any, query, quoted, rnd
from pricelens.catalog.tables import AS_OF, TIE, current_and_history, observations, with_obs
from pricelens.functions import score as SC
from pricelens.functions import vocab
from pricelens.functions.numbers import half_up
from pricelens.operators import deals as D
from pricelens.operators import history as H
from pricelens.operators import market as M
from pricelens.operators import report as R
from pricelens.operators import summary as S
from pricelens.plans import weekly as W
from pricelens.plans.joins import null_safe_join
from pricelens.session import cut_lineage

KEY = ["order_no", "line_no", "part_no", "supp_no"]
TIES = ", ".join(TIE)
LAST_DAY = date.fromisoformat(AS_OF)

# --- the weekly job --------------------------------------------------------------
_CLEAN = f"""dd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY store, item, price ORDER BY {TIES}) AS r FROM obs
      WHERE status = 'O' AND trim(item) <> '' AND price > 0) WHERE r = 1),
    fx AS (SELECT *, {COUNTER} AS fixed FROM dd WHERE NOT ({_DRINK.replace('lower(t)', 'lower(item)')})),
    cur AS (SELECT * REPLACE (CASE WHEN fixed THEN 'per_100g' ELSE price_basis END AS price_basis,
      CASE WHEN fixed THEN {rnd('price * 10')} ELSE unit_price END AS unit_price,
      CASE WHEN fixed THEN '$/kg' ELSE unit_type END AS unit_type) FROM fx),
    hf AS (SELECT *, {COUNTER} AS fixed FROM obs WHERE status = 'F'),
    hist AS (SELECT * REPLACE (CASE WHEN fixed THEN {rnd('price * 10')} ELSE unit_price END AS unit_price,
      CASE WHEN fixed THEN '$/kg' ELSE unit_type END AS unit_type) FROM hf)"""
_HEAD = "cur AS (SELECT * FROM obs WHERE status = 'O'),\nhist AS (SELECT * FROM obs WHERE status = 'F')"
assert _HEAD in STATS
_WEEK = f"""WITH {STATS.replace(_HEAD, _CLEAN)}, src AS (SELECT * FROM scored), {RANKED},
    fin AS (SELECT *, {has_any('lower(item)', vocab.KEY_ITEMS)} AS kvi FROM ranked),
    pts AS (SELECT *, 40.0e0 + CASE WHEN pct_below_avg IS NULL THEN 0.0e0 WHEN pct_below_avg > 0
       THEN least(35.0e0, pct_below_avg * 0.7e0) ELSE greatest(-25.0e0, pct_below_avg * 0.5e0) END
      + CASE WHEN is_lowest THEN 10.0e0 ELSE 0.0e0 END
      + CASE WHEN rk IS NULL OR rk_count <= 1 THEN 0.0e0 WHEN rk = 1 THEN 20.0e0 WHEN rk = 2 THEN 10.0e0 WHEN rk = 3 THEN 5.0e0
         ELSE -10.0e0 END + CASE WHEN unit_price IS NOT NULL THEN 5.0e0 ELSE 0.0e0 END + CASE WHEN kvi THEN 5.0e0 ELSE 0.0e0 END AS raw
      FROM fin)
    SELECT {', '.join(KEY)}, store, item, price, unit_price, historical_min, historical_avg, historical_count, price_percentile,
      is_lowest, pct_below_avg, cast(rk as double) AS cross_store_rank, cast(rk_count as bigint) AS cross_store_count,
      best_store AS cross_store_best_store, kvi AS is_key,
      {rnd('least(100.0e0, greatest(0.0e0, raw))', 1)} AS deal_score FROM pts"""


_WEEK_COLS = [*KEY, "store", "item", "norm_name", "price", "price_basis", "unit_price", "unit_type", "obs_date"]


@query("current_week", with_obs(_WEEK))
def current_week(spark, sf):
    """The scored current table, from landed offers and the whole archive."""
    offers, archive = current_and_history(spark, sf, _WEEK_COLS)
    week = W.score_week(offers.select(*_WEEK_COLS), archive.select(*_WEEK_COLS), [F.col(t) for t in TIE])
    return week.select(
        *KEY, "store", "item", "price", "unit_price", "historical_min", "historical_avg", "historical_count",
        "price_percentile", "is_lowest", "pct_below_avg", F.col("cross_store_rank").cast("double").alias("cross_store_rank"),
        "cross_store_count", "cross_store_best_store", "is_key", "deal_score",
    )


_LOOKBACK = "WHERE status = 'F' AND obs_date >= DATE '2001-05-08'"  # 180 days before the reference date


def _run_week(spark, sf):
    offers, archive = current_and_history(spark, sf, _WEEK_COLS)
    return W.run_week(offers.select(*_WEEK_COLS), archive.select(*_WEEK_COLS), [F.col(t) for t in TIE], LAST_DAY, 180)


_LATE_WEEK = with_obs(_WEEK).replace("WHERE status = 'F'", _LOOKBACK)
_SCORES = ["historical_min", "historical_avg", "historical_count", "price_percentile", "is_lowest", "pct_below_avg", "deal_score"]


@query(
    "weekly_run_scores",
    f"SELECT {', '.join(KEY + _SCORES)} FROM ({_LATE_WEEK})",
)
def weekly_run_scores(spark, sf):
    """Scored current table; statistics over the 180 days before the reference date."""
    return _run_week(spark, sf)[0].select(*KEY, *_SCORES)


@query(
    "weekly_run_archive",
    with_obs(f"""WITH {_CLEAN}, b AS (
        SELECT 0 AS a, obs_date AS day, CASE WHEN fixed THEN 'per_100g' ELSE price_basis END AS basis, * EXCLUDE (price_basis) FROM hist
        UNION ALL BY NAME SELECT 1 AS a, DATE '{AS_OF}' AS day, price_basis AS basis, * EXCLUDE (price_basis) FROM cur)
      SELECT {', '.join(KEY)}, cast(day as varchar) AS obs_date, store, item, price, basis AS price_basis, unit_price, unit_type FROM
       (SELECT *, row_number() OVER (PARTITION BY day, store, lower(trim(item)), price ORDER BY a DESC, day DESC,
         {', '.join(t + ' DESC' for t in TIE if t != 'obs_date')}) AS nth FROM b) WHERE nth = 1"""),
)
def weekly_run_archive(spark, sf):
    """The whole archive after the weekly run: no row is lost to the lookback window."""
    held = _run_week(spark, sf)[1].drop("norm_name")
    return held.withColumn("obs_date", F.col("obs_date").cast("string"))


# --- item statistics -------------------------------------------------------------
_ITEM_STATS = f"""{CURHIST}, b AS (SELECT lower(item) AS k, store, obs_date, price FROM hist
      UNION ALL SELECT lower(item), NULL, obs_date, price FROM hist),
    f AS (SELECT k, store, min(price) AS lo, max(price) AS hi, {avg('price')} AS av, median(price) AS med, count(*) AS n,
      count(DISTINCT weekofyear(obs_date)) AS w FROM b GROUP BY k, store),
    t AS (SELECT k, store, {avg('CASE WHEN d <= 3 THEN price END')} AS late, {avg('CASE WHEN u <= 3 THEN price END')} AS early,
      count(*) AS m, max(CASE WHEN d = 1 THEN price END) AS lp, max(CASE WHEN d = 1 THEN obs_date END) AS ld
      FROM (SELECT *, row_number() OVER (PARTITION BY k, store ORDER BY obs_date DESC, price) AS d,
       row_number() OVER (PARTITION BY k, store ORDER BY obs_date, price) AS u FROM b) GROUP BY k, store),
    s AS (SELECT f.*, CASE WHEN m < 2 THEN 'UNKNOWN' WHEN late < early * 0.95e0 THEN 'DECREASING' WHEN late > early * 1.05e0
      THEN 'INCREASING' ELSE 'STABLE' END AS tr, lp, ld FROM f JOIN t ON t.k = f.k AND t.store IS NOT DISTINCT FROM f.store)"""


@query(
    "item_store_stats",
    with_obs(f"""WITH {_ITEM_STATS} SELECT k AS item_key, store, lo AS min_price, hi AS max_price, {rnd('av')} AS avg_price,
        {rnd('med', 4)} AS median_price, n AS frequency, w AS weeks_tracked, tr AS price_trend, lp AS last_price,
        cast(ld as varchar) AS last_date FROM s"""),
)
def item_store_stats(spark, sf):
    _, history = current_and_history(spark, sf)
    return H.item_store_stats(history).withColumns(
        {
            "avg_price": half_up(F.col("avg_price"), 2), "median_price": half_up(F.col("median_price"), 4),
            "last_date": F.col("last_date").cast("string"),
        }
    )


@query(
    "history_sentence",
    with_obs(f"""WITH {_ITEM_STATS}, j AS (SELECT c.order_no, c.line_no, c.part_no, c.supp_no, c.price, coalesce(o.k, a.k) AS hit,
        CASE WHEN o.k IS NOT NULL THEN o.lo ELSE a.lo END AS lo, CASE WHEN o.k IS NOT NULL THEN o.hi ELSE a.hi END AS hi,
        CASE WHEN o.k IS NOT NULL THEN o.av ELSE a.av END AS av, CASE WHEN o.k IS NOT NULL THEN o.tr ELSE a.tr END AS tr,
        CASE WHEN o.k IS NOT NULL THEN o.n ELSE a.n END AS n, CASE WHEN o.k IS NOT NULL THEN o.w ELSE a.w END AS w,
        CASE WHEN o.k IS NOT NULL THEN 'store' WHEN a.k IS NOT NULL THEN 'item' END AS scope FROM cur c
        LEFT JOIN s o ON o.k = lower(c.item) AND o.store = c.store LEFT JOIN s a ON a.k = lower(c.item) AND a.store IS NULL)
        SELECT {', '.join(KEY)}, scope, CASE WHEN hit IS NULL THEN 'No historical data available (new item).' ELSE concat_ws(' | ',
        concat('Historical price range: $', printf('%.2f', lo), ' - $', printf('%.2f', hi), ' (avg: $', printf('%.2f', {rnd('av')}), ')'),
        concat('Current $', printf('%.2f', price), ' is ', CASE WHEN price <= lo * 1.02e0 THEN 'at/near MINIMUM (best price seen!)'
         WHEN price >= hi * 0.98e0 THEN 'at/near MAXIMUM (highest price)' WHEN price <= av * 0.9e0 THEN 'BELOW average (good deal)'
         WHEN price >= av * 1.1e0 THEN 'ABOVE average (expensive)' ELSE 'near average' END),
        CASE tr WHEN 'DECREASING' THEN 'Price trend: DECREASING (getting cheaper)' WHEN 'INCREASING'
         THEN 'Price trend: INCREASING (getting more expensive)' ELSE 'Price trend: STABLE' END,
        concat('Seen ', n, ' times over ', w, ' weeks')) END AS sentence FROM j"""),
)
def history_sentence(spark, sf):
    current, history = current_and_history(spark, sf)
    rows = H.with_item_store_stats(current.select(*KEY, "store", "item", "price"), history)
    text = SC.history_sentence(
        *[F.col(c) for c in ("price", "min_price", "max_price", "avg_price", "price_trend", "frequency", "weeks_tracked")]
    )
    return rows.select(*KEY, "scope", text.alias("sentence"))


@query(
    "price_trend",
    with_obs(f"""WITH t AS (SELECT category, store, {avg('CASE WHEN d <= 3 THEN price END')} AS late, {avg('CASE WHEN u <= 3 THEN price END')}
        AS early, count(*) AS m, max(CASE WHEN d = 1 THEN price END) AS lp, max(CASE WHEN d = 1 THEN obs_date END) AS ld
        FROM (SELECT *, row_number() OVER (PARTITION BY category, store ORDER BY obs_date DESC, price) AS d,
        row_number() OVER (PARTITION BY category, store ORDER BY obs_date, price) AS u FROM obs) GROUP BY ALL)
        SELECT category, store, CASE WHEN m < 2 THEN 'UNKNOWN' WHEN late < early * 0.95e0 THEN 'DECREASING'
        WHEN late > early * 1.05e0 THEN 'INCREASING' ELSE 'STABLE' END AS price_trend, lp AS last_price,
        cast(ld as varchar) AS last_date FROM t"""),
)
def price_trend(spark, sf):
    rows = observations(spark, sf).select("category", "store", "obs_date", "price")
    return H.price_trend(rows, ["category", "store"]).withColumn("last_date", F.col("last_date").cast("string"))


_ITEM_AVG = f"""{CURHIST}, m AS (SELECT lower(item) AS k, {avg('price')} AS hist_avg FROM hist WHERE price > 0 GROUP BY 1),
    av AS (SELECT c.*, m.hist_avg FROM cur c LEFT JOIN m ON m.k = lower(c.item))"""


@query(
    "item_average",
    with_obs(f"WITH {_ITEM_AVG} SELECT {', '.join(KEY)}, {rnd('hist_avg', 4)} AS hist_avg FROM av"),
)
def item_average(spark, sf):
    current, history = current_and_history(spark, sf)
    return H.item_average(current.select(*KEY, "item"), history).select(*KEY, half_up(F.col("hist_avg"), 4).alias("hist_avg"))


_SINCE = "DATE '2001-08-12'"  # 84 days before the reference date


@query(
    "item_average_12_weeks",
    with_obs(f"WITH {_ITEM_AVG} SELECT {', '.join(KEY)}, {rnd('hist_avg', 4)} AS hist_avg FROM av").replace(
        "WHERE status = 'F'", f"WHERE status = 'F' AND obs_date >= {_SINCE}"),
)
def item_average_12_weeks(spark, sf):
    """The same item's mean price over the twelve weeks before the reference date."""
    current, history = current_and_history(spark, sf)
    rows = H.item_average(current.select(*KEY, "item"), history, date.fromisoformat(AS_OF), 12)
    return rows.select(*KEY, half_up(F.col("hist_avg"), 4).alias("hist_avg"))


@query(
    "budget_impact",
    with_obs(f"""WITH {_ITEM_AVG}, top AS (SELECT * FROM av WHERE ai_score >= 85 ORDER BY ai_score DESC, {TIES} LIMIT 5),
        g AS (SELECT CASE WHEN hist_avg > price THEN hist_avg - price END AS gain FROM top),
        s AS (SELECT count(gain) AS n, coalesce(sum(cast(floor(gain * 10000.0e0 + 0.5e0) as bigint)), 0) / 10000.0e0 AS t FROM g)
        SELECT n AS n_deals, {rnd('t')} AS weekly_saving, {rnd('t * 52', 0)} AS yearly_saving FROM s"""),
)
def budget_impact(spark, sf):
    current, history = current_and_history(spark, sf)
    rows = H.item_average(current, history)
    return R.budget_impact(rows, [F.desc("ai_score"), *[F.col(t) for t in TIE]])


@query(
    "history_comparison",
    with_obs(f"""WITH {CURHIST}, h AS (SELECT lower(item) AS k, {avg('price')} AS av, min(price) AS lo, max(price) AS hi, count(*) AS n
        FROM hist GROUP BY 1 HAVING count(*) >= 2)
        SELECT {', '.join(KEY)}, n AS times_seen, CASE WHEN price < av THEN concat('$', printf('%.2f', {rnd('av - price')}), ' below avg')
        WHEN price > av THEN concat('$', printf('%.2f', {rnd('price - av')}), ' above avg') ELSE 'At average' END AS against_avg,
        CASE WHEN price = lo THEN 'Lowest ever!' WHEN price = hi THEN 'Highest seen' END AS against_range
        FROM cur JOIN h ON h.k = lower(cur.item)"""),
)
def history_comparison(spark, sf):
    from pricelens.functions.numbers import exact_avg

    current, history = current_and_history(spark, sf)
    facts = history.groupBy(F.lower("item").alias("k")).agg(
        exact_avg(F.col("price")).alias("av"), F.min("price").alias("lo"), F.max("price").alias("hi"),
        F.count(F.lit(1)).alias("times_seen"),
    ).where("times_seen >= 2")
    rows = current.select(*KEY, "item", "price").withColumn("k", F.lower("item")).join(facts, "k")
    return rows.select(
        *KEY, "times_seen", SC.against_average(F.col("price"), F.col("av")).alias("against_avg"),
        SC.against_range(F.col("price"), F.col("lo"), F.col("hi")).alias("against_range"),
    )


# --- item detail -----------------------------------------------------------------
@query(
    "price_ladder",
    with_obs("""WITH m AS (SELECT norm_name, store, min(price) AS price FROM obs WHERE trim(norm_name) <> '' GROUP BY ALL)
        SELECT norm_name, store, price, row_number() OVER (PARTITION BY norm_name ORDER BY price, store) AS rank FROM m"""),
)
def price_ladder(spark, sf):
    return M.price_ladder(observations(spark, sf), "norm_name")


@query(
    "best_store_per_name",
    with_obs("""WITH m AS (SELECT norm_name, store, min(price) AS p FROM obs WHERE trim(norm_name) <> '' GROUP BY ALL)
        SELECT norm_name, min(p) AS best_price, arg_min(store, (p, store)) AS best_store, count(*) AS n_stores FROM m GROUP BY 1"""),
)
def best_store_per_name(spark, sf):
    return M.best_store(observations(spark, sf), "norm_name")


_SKIP8 = _kws(vocab.DETAIL_SKIP_WORDS).replace("lower(item)", "lower(a.item)").replace("lower(norm_name)", "lower(a.norm_name)")
_DETAIL = f"""{CURHIST}, names AS (SELECT DISTINCT item, norm_name FROM cur),
    ht AS (SELECT {_TXT} AS txt, norm_name, count(*) AS n, min(obs_date) AS d1, max(obs_date) AS d2, min(price) AS lo FROM hist GROUP BY ALL),
    e AS (SELECT norm_name, sum(n) AS n, min(d1) AS d1, max(d2) AS d2, min(lo) AS lo FROM ht WHERE trim(norm_name) <> '' GROUP BY 1),
    b AS (SELECT a.item, a.norm_name, coalesce(e.n, 0) AS en, e.d1, e.d2, e.lo, {_SKIP8} AS kws FROM names a
      LEFT JOIN e ON e.norm_name = a.norm_name),
    fz AS (SELECT b.item, b.norm_name, sum(ht.n) AS n, min(ht.d1) AS d1, max(ht.d2) AS d2, min(ht.lo) AS lo FROM b JOIN ht
      ON b.en < 3 AND len(list_filter(b.kws, lambda x: contains(ht.txt, x))) >= greatest(2, cast(floor(len(b.kws) * 0.6e0) as int))
      GROUP BY ALL),
    dt AS (SELECT b.item, b.norm_name, CASE WHEN fz.n > b.en THEN 'keywords' ELSE 'exact' END AS how,
      cast(greatest(b.en, coalesce(fz.n, 0)) as bigint) AS matched_rows, CASE WHEN fz.n > b.en THEN fz.d1 ELSE b.d1 END AS d1,
      CASE WHEN fz.n > b.en THEN fz.d2 ELSE b.d2 END AS d2, CASE WHEN fz.n > b.en THEN fz.lo ELSE b.lo END AS lo
      FROM b LEFT JOIN fz ON fz.item = b.item AND fz.norm_name IS NOT DISTINCT FROM b.norm_name WHERE b.en > 0 OR fz.n > 0)"""


@query(
    "item_detail",
    with_obs(f"""WITH {_DETAIL} SELECT item, norm_name, how, matched_rows, cast(d1 as varchar) AS first_seen,
        cast(d2 as varchar) AS last_seen, lo AS historical_min,
        least(lo, (SELECT min(price) FROM obs c WHERE c.status = 'O' AND c.item = dt.item AND c.norm_name IS NOT DISTINCT FROM dt.norm_name))
          AS lowest_price,
        CASE WHEN matched_rows >= 2 THEN {rnd('matched_rows / greatest((d2 - d1) / 30.0e0, 1.0e0)', 1)} END AS per_month FROM dt"""),
)
def item_detail(spark, sf):
    """Detail statistics of every distinct current name, in one batch."""
    current, history = current_and_history(spark, sf)
    return H.item_detail(current, history).withColumns(
        {c: F.col(c).cast("string") for c in ("first_seen", "last_seen")}
    )


_MATCHED = """dt.how = 'exact' AND h.norm_name = dt.norm_name
      OR dt.how = 'keywords' AND len(list_filter(b.kws, lambda x: contains(h.txt, x))) >= greatest(2, cast(floor(len(b.kws) * 0.6e0) as int))"""
_SHOWN = f"b.item = dt.item AND b.norm_name IS NOT DISTINCT FROM dt.norm_name JOIN h ON ({_MATCHED})"


@query(
    "detail_last_sale",
    with_obs(f"""WITH {_DETAIL}, h AS (SELECT {_TXT} AS txt, norm_name, max({{'d': obs_date, 'p': price, 's': store}}) AS s FROM hist
        WHERE obs_date < DATE '{AS_OF}' GROUP BY ALL),
        m AS (SELECT dt.item, dt.norm_name, dt.how, max(h.s) AS s FROM dt JOIN b ON {_SHOWN} GROUP BY ALL)
        SELECT item, norm_name, how, cast(s.d as varchar) AS last_date, s.p AS last_price, s.s AS last_store,
        cast(DATE '{AS_OF}' - s.d as bigint) AS days_ago FROM m"""),
)
def detail_last_sale(spark, sf):
    """Last sighting in the matched set of every current name."""
    current, history = current_and_history(spark, sf)
    return H.last_matched_sale(current, history, LAST_DAY).withColumn("last_date", F.col("last_date").cast("string"))


@query(
    "detail_history",
    with_obs(f"""WITH {_DETAIL}, t AS (SELECT DISTINCT item, norm_name FROM (SELECT * FROM cur ORDER BY deal_score DESC, {TIES} LIMIT 20)),
        h AS (SELECT {_TXT} AS txt, norm_name, obs_date, store, price, count(*) AS n FROM hist GROUP BY ALL),
        m AS (SELECT dt.item, dt.norm_name, dt.how, h.obs_date, h.store, h.price, cast(sum(h.n) as bigint) AS n FROM dt
          JOIN t ON t.item = dt.item AND t.norm_name IS NOT DISTINCT FROM dt.norm_name JOIN b ON {_SHOWN} GROUP BY ALL)
        SELECT item, norm_name, how, cast(obs_date as varchar) AS obs_date, store, price, n,
        row_number() OVER (PARTITION BY item, norm_name ORDER BY obs_date, price, store) AS pos FROM m"""),
)
def detail_history(spark, sf):
    """Price history behind the twenty best current offers, the ones a list's first page opens."""
    current, history = current_and_history(spark, sf)
    shown = D.top(current, D.sort_order("score_desc", TIE), 20)
    return H.matched_history(shown, history).withColumn("obs_date", F.col("obs_date").cast("string"))


@query(
    "detail_ladder",
    with_obs(f"""WITH {CURHIST}, m AS (SELECT norm_name, store, min(price) AS price FROM cur WHERE trim(norm_name) <> '' GROUP BY ALL)
        SELECT norm_name, store, price, row_number() OVER (PARTITION BY norm_name ORDER BY price, store) AS rank FROM m"""),
)
def detail_ladder(spark, sf):
    """This week's stores of every current name by their lowest price."""
    return M.price_ladder(current_and_history(spark, sf)[0], "norm_name")


# --- report context and reports --------------------------------------------------
_CTX_PROBE = ["item", "price", "per_100g_corrected", "unit_price"]
_CONTEXT = f"""cx AS (SELECT *, {COUNTER} AS per_100g_corrected FROM obs WHERE status = 'O'),
    cur AS (SELECT * REPLACE (CASE WHEN per_100g_corrected THEN {rnd('price * 10')} ELSE unit_price END AS unit_price) FROM cx),
    hx AS (SELECT *, {COUNTER} AS fixed FROM obs WHERE status = 'F'),
    hist AS (SELECT * REPLACE (CASE WHEN fixed THEN 'per_100g' ELSE price_basis END AS price_basis,
       CASE WHEN fixed THEN {rnd('price * 10')} ELSE unit_price END AS unit_price) FROM hx),
    pr AS (SELECT DISTINCT item, price, per_100g_corrected, unit_price, lower(substring(item, 1, 25)) AS pat,
       CASE WHEN per_100g_corrected AND unit_price > 0 THEN unit_price ELSE price END AS now FROM cur),
    hr AS (SELECT lower(item) AS t, false AS counter, price AS v, count(*) AS n, max(obs_date) AS d FROM hist WHERE price > 0 GROUP BY ALL
       UNION ALL SELECT lower(item), true, unit_price, count(*), max(obs_date) FROM hist
       WHERE price_basis = 'per_100g' AND unit_price > 0 GROUP BY ALL),
    pp AS (SELECT DISTINCT pat FROM pr),
    pv AS (SELECT pat, counter, v, sum(n) AS n, max(d) AS d FROM pp JOIN hr ON contains(hr.t, pp.pat) GROUP BY ALL),
    ps AS (SELECT pat, counter, sum(cast(floor(v * 10000.0e0 + 0.5e0) as bigint) * n) / sum(n) / 10000.0e0 AS av, min(v) AS low
       FROM pv GROUP BY ALL HAVING sum(n) >= 3),
    pl AS (SELECT ps.*, (SELECT max(pv.d) FROM pv WHERE pv.pat = ps.pat AND pv.counter = ps.counter AND pv.v <= ps.low + 0.01e0) AS ld FROM ps),
    ci AS (SELECT lower(item) AS t, count(*) AS n, min(price) AS p, count(CASE WHEN unit_price > 0 THEN 1 END) AS un,
       min(CASE WHEN unit_price > 0 THEN unit_price END) AS u FROM cur GROUP BY 1),
    pm AS (SELECT pat, sum(n) AS n, min(p) AS p, sum(un) AS un, min(u) AS u FROM pp JOIN ci ON contains(ci.t, pp.pat) GROUP BY 1),
    cj AS (SELECT pr.*, pl.av, pl.low, pl.ld, CASE WHEN pr.per_100g_corrected THEN CASE WHEN pm.un > 1 THEN pm.u END
        ELSE CASE WHEN pm.n > 1 THEN pm.p END END AS best FROM pr
       LEFT JOIN pl ON pl.pat = pr.pat AND pl.counter = pr.per_100g_corrected LEFT JOIN pm ON pm.pat = pr.pat),
    ctx AS (SELECT item, price, per_100g_corrected, unit_price, {rnd('av')} AS historical_avg, {rnd('low')} AS historical_min,
       {rnd('(av - now) / av * 100', 1)} AS pct_below, coalesce(now <= low, false) AS lowest,
       CASE WHEN now <= low THEN {rnd(f"(DATE '{AS_OF}' - ld) / 30", 1)} END AS months_since_low,
       coalesce(now <= best, false) AS cross_store_best, CASE WHEN now > best THEN {rnd('now - best')} END AS cross_store_savings FROM cj),
    ctt AS (SELECT *, concat_ws(' | ', CASE WHEN per_100g_corrected AND unit_price > 0 THEN concat('Price is per 100g → real price $',
        printf('%.2f', {rnd('unit_price * 0.453592e0')}), '/lb ($', printf('%.2f', unit_price), '/kg)') END,
       CASE WHEN lowest AND months_since_low > 1 THEN concat('LOWEST in ', cast(floor(months_since_low + 0.5e0) as bigint), ' months!')
        WHEN lowest THEN 'LOWEST PRICE!' WHEN pct_below > 5 THEN concat(cast(floor(pct_below + 0.5e0) as bigint), '% below avg $',
         printf('%.2f', historical_avg)) WHEN pct_below < -5 THEN concat('Above avg (usually $', printf('%.2f', historical_avg), ')') END,
       CASE WHEN cross_store_best AND NOT per_100g_corrected THEN 'Best price across stores' END) AS context_text FROM ctx)"""


def _context(spark, sf, columns=None):
    current, history = current_and_history(spark, sf, columns)
    # the corrected tables are read by several parts of the report: write them once, the archive as far as it is read
    fixed = cut_lineage(W.with_counter_fix(current))
    archive = cut_lineage(W.clean_archive(history).select("item", "price", "price_basis", "unit_price", "obs_date"))
    facts = H.deal_context(fixed, archive, F.lit(LAST_DAY))
    text = SC.deal_context_text(
        F.coalesce("per_100g_corrected", F.lit(False)), F.col("unit_price"), F.col("is_lowest"), F.col("months_since_low"),
        F.col("pct_below_avg"), F.col("historical_avg"), F.col("cross_store_best"),
    )
    return fixed, facts.withColumn("context_text", text)


@query(
    "deal_context",
    with_obs(f"WITH {_CONTEXT} SELECT * EXCLUDE (pct_below, lowest), pct_below AS pct_below_avg, lowest AS is_lowest FROM ctt"),
)
def deal_context(spark, sf):
    return _context(spark, sf, ["store", "item", "price", "price_basis", "unit_price", "unit_type", "obs_date"])[1]


_REPORT_ROWS = f"""rr AS (SELECT *, category NOT IN ({quoted(vocab.REPORT_PROTEINS)})
    OR NOT {has_any('lower(item)', vocab.PREPARED_WORDS)} AS ok FROM obs WHERE category IN ({quoted(R.FOOD)}))"""
_MEAN = f"coalesce({rnd(avg('deal_score'), 0)}, 50)"
_ROLLUP = f"""{_REPORT_ROWS}, ru AS (SELECT CASE WHEN category IN ({quoted(vocab.REPORT_PROTEINS)}) THEN 'protein' ELSE 'category' END AS section,
     cast(null as varchar) AS store, category, count(*) AS n_deals, {_MEAN} AS avg_score FROM rr WHERE ok GROUP BY category
    UNION ALL SELECT 'store', store, NULL, count(*), {_MEAN} FROM rr GROUP BY store
    UNION ALL SELECT 'store_category', store, category, count(*), {_MEAN} FROM rr WHERE ok GROUP BY store, category)"""


@query("report_rollup", with_obs(f"WITH {_ROLLUP} SELECT * FROM ru"))
def report_rollup(spark, sf):
    return R.report_rollup(observations(spark, sf))


_PICKS = f"""{_CONTEXT}, pk AS (SELECT cur.*, ctt.context_text, CASE WHEN cur.per_100g_corrected AND cur.unit_price > 0 THEN concat('($',
      printf('%.2f', cur.price), '/100g = $', printf('%.2f', {rnd('cur.unit_price * 0.453592e0')}), '/lb)') ELSE '' END AS price_note
     FROM cur JOIN ctt ON ctt.item = cur.item AND ctt.price = cur.price AND ctt.per_100g_corrected = cur.per_100g_corrected
      AND ctt.unit_price IS NOT DISTINCT FROM cur.unit_price),
    {_REPORT_ROWS.replace('FROM obs', 'FROM pk')},
    ru AS (SELECT CASE WHEN category IN ({quoted(vocab.REPORT_PROTEINS)}) THEN 'protein' ELSE 'category' END AS section,
      cast(null as varchar) AS store, category, count(*) AS n_deals, {_MEAN} AS avg_score FROM rr WHERE ok GROUP BY category
     UNION ALL SELECT 'store', store, NULL, count(*), {_MEAN} FROM rr GROUP BY store),
    ps1 AS (SELECT *, row_number() OVER (PARTITION BY store, category ORDER BY deal_score DESC, {TIES}) AS rank FROM rr WHERE ok),
    pc1 AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY deal_score DESC, {TIES}) AS rank FROM rr WHERE ok),
    cp AS (SELECT unnest([{quoted(R.FOOD)}]) AS category, generate_subscripts([{quoted(R.FOOD)}], 1) AS pos)"""


def _deal_sql(width: int) -> str:
    return (
        f"CASE WHEN price_note <> '' THEN concat(substring(item, 1, {width}), ' ', price_note) ELSE concat('$', printf('%.2f', price),"
        f" ' ', substring(item, 1, {width}), CASE WHEN context_text <> '' THEN concat(' - ', context_text) ELSE '' END) END"
    )


_SHORT = """CASE store WHEN 'Real Canadian Superstore' THEN 'Superstore' WHEN 'Save-On-Foods' THEN 'Save-On'
    WHEN 'Calgary Co-op' THEN 'Co-op' ELSE store END"""


_REPORT_COLS = [*TIE, "store", "item", "category", "deal_score", "price_basis", "unit_price", "unit_type"]


def _picks(spark, sf):
    fixed, facts = _context(spark, sf, _REPORT_COLS)
    # every row has one context, so only the rows picked meet theirs
    picks = null_safe_join(R.report_picks(fixed, TIE), facts.select(*_CTX_PROBE, "context_text"), _CTX_PROBE)
    note = R.price_note(F.col("price"), F.col("unit_price"), F.col("per_100g_corrected"))
    return R.report_rollup(fixed), picks.withColumn("price_note", note)


@query(
    "store_report",
    with_obs(f"""WITH {_PICKS}, hd AS (SELECT * FROM ru WHERE section = 'store')
        SELECT store, 0 AS part, 0 AS line, concat('📍 ', upper({_SHORT})) AS text FROM hd
        UNION ALL SELECT store, 0, 1, concat(n_deals, ' deals | ', CASE WHEN avg_score >= 75 THEN '🔥 Hot this week!'
          WHEN avg_score >= 65 THEN '✓ Solid deals' ELSE '😐 Average week' END) FROM hd
        UNION ALL SELECT store, cp.pos, 2 * rank, CASE WHEN category IN ({quoted(vocab.REPORT_PROTEINS)})
          THEN concat(upper(category), ': ', {_deal_sql(30)}) ELSE concat(category, ': ', {_deal_sql(25)}) END
          FROM ps1 JOIN cp USING (category) WHERE rank <= CASE WHEN category IN ({quoted(vocab.REPORT_PROTEINS)}) THEN 2 ELSE 1 END
        UNION ALL SELECT store, cp.pos, 2 * rank + 1, concat('    ↳ - ', context_text) FROM ps1 JOIN cp USING (category)
          WHERE rank <= 2 AND category IN ({quoted(vocab.REPORT_PROTEINS)}) AND price_note <> '' AND context_text <> ''"""),
)
def store_report(spark, sf):
    return R.store_report(*_picks(spark, sf)).select(
        "store", F.col("part").cast("bigint").alias("part"), F.col("line").cast("bigint").alias("line"), "text"
    )


@query(
    "category_report",
    with_obs(f"""WITH {_PICKS}, ct AS (SELECT ru.*, cp.pos FROM ru JOIN cp USING (category))
        SELECT pos AS part, 0 AS line, CASE WHEN section = 'protein' THEN concat(upper(category), ' - ', CASE WHEN avg_score >= 80
          THEN '🔥 Great week!' WHEN avg_score >= 70 THEN '✓ Decent' ELSE '😐 Average' END) ELSE concat(upper(category), ':') END AS text FROM ct
        UNION ALL SELECT cp.pos, rank, concat('• ', {_deal_sql(30)}, ' @ ', {_SHORT}) FROM pc1 JOIN cp USING (category)
          WHERE rank <= CASE WHEN category IN ({quoted(vocab.REPORT_PROTEINS)}) THEN 3 ELSE 2 END
        UNION ALL SELECT 99, 0, concat('🥩 Stock up on: ', (SELECT category FROM ct WHERE section = 'protein' ORDER BY avg_score DESC, pos LIMIT 1))
        UNION ALL SELECT 99, 1, concat('🏆 Best value: ', (SELECT category FROM ct ORDER BY avg_score DESC, pos LIMIT 1))"""),
)
def category_report(spark, sf):
    return R.category_report(*_picks(spark, sf)).select(
        F.col("part").cast("bigint").alias("part"), F.col("line").cast("bigint").alias("line"), "text"
    )


_GROUPED = "CASE WHEN category IN ('Poultry', 'Beef', 'Seafood') THEN 'Meat & Seafood' WHEN category = 'Snacks' THEN 'Pantry' ELSE category END"
_SHOP = "CASE " + " ".join(
    f"WHEN category IN ({quoted(m)}) THEN '{n}'" for n, m in vocab.PRIORITY_CATEGORIES.items()
) + " END"


@query(
    "weekly_summary",
    with_obs(f"""WITH {_ITEM_AVG}, sw AS (SELECT lower(item) AS k, cast(floor((DATE '{AS_OF}' - obs_date) / 7) as bigint) AS w FROM
         (SELECT item, obs_date, row_number() OVER (PARTITION BY lower(item) ORDER BY obs_date DESC) AS r FROM hist) WHERE r = 2),
        g AS (SELECT av.* EXCLUDE (category), {_GROUPED} AS category, sw.w, CASE WHEN line_no = 5 THEN 'Analysis unavailable' ELSE
          concat(item, ' at ', store, ' ', price_text, ' is a price to remember for the next weeks because it rarely gets any better, so stock up while it lasts')
          END AS why FROM av LEFT JOIN sw ON sw.k = lower(av.item)),
        h AS (SELECT *, {_SHOP} AS shop_group, {rnd('(hist_avg - price) / hist_avg', 6)} AS saving FROM g WHERE ai_score >= 85),
        t AS (SELECT *, row_number() OVER (PARTITION BY shop_group ORDER BY ai_score DESC, coalesce(saving, 0) DESC, {TIES}) AS rank FROM h
          WHERE shop_group IS NOT NULL),
        c AS (SELECT *, concat_ws(' | ', CASE WHEN saving >= 0.2e0 THEN concat(cast(floor(saving * 100 + 0.5e0) as bigint), '% below 12-week avg') END,
          CASE WHEN ai_score >= 90 THEN 'BEST PRICE' END, CASE WHEN w >= 6 THEN concat('First time in ', w, ' weeks') END,
          CASE WHEN member THEN 'Member Exclusive' END, CASE WHEN featured THEN 'Featured Deal' END) AS cx FROM t WHERE rank <= 5)
        SELECT shop_group, rank, CASE WHEN rank = 1 AND ai_score >= 90 THEN 'BEST OF WEEK' END AS head, concat_ws(chr(10),
          concat('**', item, ' - ', price_text, '** (', store, ')'), CASE WHEN cx <> '' THEN concat('   → ', cx) END,
          CASE WHEN NOT contains(lower(why), 'unavailable') THEN concat('   💡 ', CASE WHEN length(why) > 120
           THEN concat(substring(why, 1, 117), '...') ELSE why END) END) AS text FROM c"""),
)
def weekly_summary(spark, sf):
    current, history = current_and_history(spark, sf)
    why = F.when(F.col("line_no") == 5, F.lit("Analysis unavailable")).otherwise(
        F.concat(
            "item", F.lit(" at "), "store", F.lit(" "), "price_text",
            F.lit(" is a price to remember for the next weeks because it rarely gets any better, so stock up while it lasts"),
        )
    )
    rows = H.item_average(current, history).withColumns({"category": F.expr(_GROUPED), "explanation": why})
    absent = S.weeks_since_seen(history, LAST_DAY)
    rows = rows.withColumn("item_key", F.lower("item")).join(absent, "item_key", "left")
    return R.weekly_summary(rows, TIE).withColumn("rank", F.col("rank").cast("bigint"))


# --- quarters --------------------------------------------------------------------
_Q = "concat(year(obs_date), '-Q', quarter(obs_date))"


@query(
    "quarterly_rollup",
    with_obs(f"""WITH q AS (SELECT store, {_Q} AS quarter, year(obs_date) * 4 + quarter(obs_date) AS qn, count(*) AS n, {avg('price')} AS m,
        median(price) AS med FROM obs GROUP BY ALL),
        l AS (SELECT *, CASE WHEN lag(qn) OVER w = qn - 1 THEN lag(m) OVER w END AS pm, CASE WHEN lag(qn) OVER w = qn - 1 THEN lag(n) OVER w END AS pn
        FROM q WINDOW w AS (PARTITION BY store ORDER BY qn))
        SELECT store, quarter, n AS n_deals, {rnd('m')} AS avg_price, {rnd('med')} AS median_price,
        {rnd('(m - pm) / pm * 100', 1)} AS price_change_pct, {rnd('(n - pn) / pn * 100', 1)} AS volume_change_pct FROM l"""),
)
def quarterly_rollup(spark, sf):
    return R.quarterly_stores(observations(spark, sf))


@query(
    "quarterly_winners",
    with_obs(f"""WITH m AS (SELECT {_Q} AS quarter, category, store, {rnd(avg('price'))} AS m FROM obs GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY quarter, category ORDER BY m, store) AS k FROM m)
        SELECT quarter, category, max(store) FILTER (k = 1) AS winner, max(m) FILTER (k = 1) AS winner_avg,
        max(store) FILTER (k = 2) AS runner_up, max(m) FILTER (k = 2) AS runner_up_avg FROM r WHERE k <= 2 GROUP BY ALL"""),
)
def quarterly_winners(spark, sf):
    return R.quarterly_winners(observations(spark, sf))


@query(
    "quarter_change",
    with_obs(f"""WITH m AS (SELECT category, {avg("CASE WHEN year(obs_date) = 1997 AND quarter(obs_date) = 4 THEN price END")} AS a,
        {avg("CASE WHEN year(obs_date) = 1998 AND quarter(obs_date) = 1 THEN price END")} AS b FROM obs GROUP BY category)
        SELECT category, {rnd('a')} AS before_avg, {rnd('b')} AS after_avg, {rnd('(b - a) / a * 100', 1)} AS change_pct FROM m"""),
)
def quarter_change(spark, sf):
    return R.quarter_shift(observations(spark, sf), "1997-Q4", "1998-Q1")


@query(
    "store_category_means",
    with_obs(f"SELECT store, category, count(*) AS n_deals, {rnd(avg('price'))} AS avg_price FROM obs GROUP BY ALL"),
)
def store_category_means(spark, sf):
    return R.store_category_means(observations(spark, sf))

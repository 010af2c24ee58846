"""Queries: historical statistics and matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricelens.catalog.registry import avg, query, quoted, rnd
from pricelens.catalog.tables import AS_OF, TIE, current_and_history, observations, with_obs
from pricelens.functions import vocab
from pricelens.operators import history as H

KEY = ["order_no", "line_no", "part_no", "supp_no"]
_TXT = "concat(lower(item), ' ', coalesce(lower(norm_name), ''))"


def _kws(skip) -> str:
    return (
        f"list_distinct(list_filter(regexp_split_to_array({_TXT}, '\\s+'),"
        f" lambda x: length(x) >= 3 AND NOT list_contains([{quoted(skip)}], x)))"
    )


# matched (current name, history name) pairs of the winning tier
TIERS = f"""
cur AS (SELECT * FROM obs WHERE status = 'O'),
hist AS (SELECT * FROM obs WHERE status = 'F'),
names AS (SELECT DISTINCT item, norm_name FROM cur),
hn AS (SELECT item, norm_name, {_TXT} AS txt, count(*) AS n FROM hist GROUP BY item, norm_name),
n1 AS (SELECT norm_name FROM hist WHERE trim(norm_name) <> '' GROUP BY norm_name HAVING count(*) >= 3),
m1 AS (SELECT a.item, a.norm_name, 1 AS tier, h.item AS h_item, h.norm_name AS h_norm, h.n
       FROM names a JOIN n1 USING (norm_name) JOIN hn h ON h.norm_name = a.norm_name),
k2 AS (SELECT item, norm_name, {_kws(vocab.MATCH_SKIP_WORDS)} AS kws FROM names
       WHERE norm_name IS NULL OR norm_name NOT IN (SELECT norm_name FROM n1)),
p2 AS (SELECT a.item, a.norm_name, 2 AS tier, h.item AS h_item, h.norm_name AS h_norm, h.n
       FROM k2 a JOIN hn h
       ON len(list_filter(a.kws, lambda x: contains(h.txt, x))) >= greatest(2, cast(floor(len(a.kws) * 0.6e0) as int))),
g2 AS (SELECT item, norm_name FROM p2 GROUP BY item, norm_name HAVING sum(n) >= 2),
m2 AS (SELECT p2.* FROM p2 JOIN g2 ON p2.item = g2.item AND p2.norm_name IS NOT DISTINCT FROM g2.norm_name),
k3 AS (SELECT k2.item, k2.norm_name FROM k2 LEFT JOIN g2
       ON k2.item = g2.item AND k2.norm_name IS NOT DISTINCT FROM g2.norm_name WHERE g2.item IS NULL),
m3 AS (SELECT a.item, a.norm_name, 3 AS tier, h.item AS h_item, h.norm_name AS h_norm, h.n
       FROM k3 a JOIN hn h ON contains(lower(h.item), lower(substring(a.item, 1, 30)))),
matched AS (SELECT * FROM m1 UNION ALL SELECT * FROM m2 UNION ALL SELECT * FROM m3)
"""

# statistics per distinct probe (name, price, unit price, unit type)
STATS = f"""{TIERS},
probes AS (SELECT DISTINCT item, norm_name, price, unit_price, unit_type FROM cur),
hp AS (SELECT item, norm_name, unit_type, unit_price, price, count(*) AS n FROM hist GROUP BY ALL),
mp AS (SELECT m.item, m.norm_name, hp.unit_type, hp.unit_price, hp.price, sum(hp.n) AS n
       FROM matched m JOIN hp ON hp.item = m.h_item AND hp.norm_name IS NOT DISTINCT FROM m.h_norm GROUP BY ALL),
gate AS (SELECT item, norm_name, unit_type, sum(n) AS u FROM mp
         WHERE unit_price IS NOT NULL AND unit_type IS NOT NULL GROUP BY ALL HAVING sum(n) >= 2),
based AS (SELECT p.*, g.u IS NOT NULL AND p.unit_price IS NOT NULL AS by_unit FROM probes p LEFT JOIN gate g
          ON g.item = p.item AND g.norm_name IS NOT DISTINCT FROM p.norm_name AND g.unit_type = p.unit_type),
pairs AS (SELECT b.item, b.norm_name, b.price, b.unit_price, b.unit_type,
            CASE WHEN by_unit THEN b.unit_price ELSE b.price END AS now,
            CASE WHEN by_unit THEN mp.unit_price ELSE mp.price END AS v, mp.n
          FROM based b JOIN mp ON mp.item = b.item AND mp.norm_name IS NOT DISTINCT FROM b.norm_name
           AND (NOT by_unit OR (mp.unit_type = b.unit_type AND mp.unit_price IS NOT NULL))),
st AS (SELECT item, norm_name, price, unit_price, unit_type, any_value(now) AS now, min(v) AS low, max(v) AS high,
         sum(cast(floor(v * 10000.0e0 + 0.5e0) as bigint) * n) / sum(n) / 10000.0e0 AS av, sum(n) AS cnt,
         coalesce(sum(n) FILTER (v < now), 0) AS n_lt, coalesce(sum(n) FILTER (v <= now), 0) AS n_le
       FROM pairs WHERE v > 0 GROUP BY item, norm_name, price, unit_price, unit_type HAVING sum(n) >= 2),
stats AS (SELECT item, norm_name, price, unit_price, unit_type,
  {rnd('low')} AS historical_min, {rnd('high')} AS historical_max, {rnd('av')} AS historical_avg,
  cast(cnt as bigint) AS historical_count,
  {rnd('100 - (n_lt + n_le + CASE WHEN n_lt < n_le THEN 1 ELSE 0 END) * 50.0e0 / cnt', 1)} AS price_percentile,
  {rnd('n_lt / cnt * 100', 1)} AS share_below,
  now <= low AS is_lowest_h, {rnd('(av - now) / av * 100', 1)} AS pct_below_h FROM st),
scored AS (SELECT c.order_no, c.line_no, c.part_no, c.supp_no, c.store, c.item, c.norm_name, c.price, c.unit_price,
  c.unit_type, c.is_key, c.obs_date, s.historical_min, s.historical_max, s.historical_avg,
  coalesce(s.historical_count, 0) AS historical_count, s.price_percentile, s.share_below,
  coalesce(s.is_lowest_h, false) AS is_lowest, s.pct_below_h AS pct_below_avg
  FROM cur c LEFT JOIN stats s ON s.item = c.item AND s.norm_name IS NOT DISTINCT FROM c.norm_name
   AND s.price = c.price AND s.unit_price IS NOT DISTINCT FROM c.unit_price
   AND s.unit_type IS NOT DISTINCT FROM c.unit_type)
"""


def _plain(spark, sf):
    current, history = current_and_history(spark, sf, [*KEY, *H.NAME, "price", "unit_price", "unit_type"])
    return current.drop("status"), history


@query(
    "historical_stats",
    with_obs(f"WITH {STATS} SELECT {', '.join(KEY)}, historical_min, historical_max, historical_avg,"
             " historical_count, price_percentile, is_lowest, pct_below_avg FROM scored"),
)
def historical_stats(spark, sf):
    return H.historical_stats(*_plain(spark, sf)).select(*KEY, *H.STATS)


@query(
    "price_percentile_share",
    with_obs(f"WITH {STATS} SELECT {', '.join(KEY)}, share_below AS price_percentile FROM scored"),
)
def price_percentile_share(spark, sf):
    return H.historical_stats(*_plain(spark, sf), method="share_below").select(*KEY, "price_percentile")


@query(
    "tiered_match",
    with_obs(f"WITH {TIERS} SELECT item, norm_name, cast(tier as bigint) AS tier, cast(sum(n) as bigint) AS matched_rows"
             " FROM matched GROUP BY item, norm_name, tier"),
)
def tiered_match(spark, sf):
    return H.tier_matches(*current_and_history(spark, sf)).withColumn("tier", F.col("tier").cast("bigint"))

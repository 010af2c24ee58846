"""Queries: clean-up jobs of earlier table versions, latest reports."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from pricelens.catalog.registry import has_any, query, rnd
from pricelens.catalog.tables import TIE, observations, table, with_obs
from pricelens.functions import vocab
from pricelens.operators import deals as D
from pricelens.plans import legacy as L

KEY = ["order_no", "line_no", "part_no", "supp_no"]


@query(
    "legacy_archive_cleaning",
    with_obs(f"""SELECT {', '.join(KEY)}, store, item FROM (SELECT *, row_number() OVER (PARTITION BY store, item, price_text, valid_until
        ORDER BY {', '.join(TIE)}) AS r FROM obs WHERE NOT {has_any('lower(store)', vocab.ARCHIVE_EXCLUSIONS)}) WHERE r = 1"""),
)
def legacy_archive_cleaning(spark, sf):
    return L.clean_archive_rows(observations(spark, sf), [F.col(t) for t in TIE]).select(*KEY, "store", "item")


@query(
    "clean_table",
    with_obs(f"""SELECT {', '.join(KEY)},
        array_to_string(list_transform(string_split(lower(item), ' '), lambda w: concat(upper(w[1]), w[2:])), ' ') AS item,
        CASE WHEN category = 'Seafood' THEN 'Meat & Protein' WHEN category = 'Dairy & Eggs' THEN 'Dairy & Fridge'
         WHEN category IN ('Snacks', 'Beverages') THEN 'Snacks & Treats' ELSE 'Other' END AS display_category,
        CASE WHEN trim(sub_category) = '' THEN 'General' ELSE concat(upper(sub_category[1]), lower(sub_category[2:])) END AS sub_category,
        {rnd('coalesce((original_price - price) / nullif(original_price, 0) * 100, 0)')} AS savings_pct,
        cast(CASE WHEN valid_until < obs_date THEN obs_date + 7 WHEN valid_until IS NULL THEN obs_date + 7 ELSE valid_until END as varchar) AS valid_until,
        cast(least(obs_date, DATE '2000-06-30') as varchar) AS obs_date FROM obs"""),
)
def clean_table(spark, sf):
    old = {new: was for was, new in L.RENAMED.items()}
    rows = observations(spark, sf).select(
        *KEY, "item", "category", "price", "original_price", "sub_category", "valid_until", "obs_date"
    ).withColumnsRenamed(old)
    out = L.clean_table(rows, date(2000, 6, 30))
    return out.select(
        *KEY, "item", "display_category", "sub_category", "savings_pct",
        F.col("valid_until").cast("string").alias("valid_until"), F.col("obs_date").cast("string").alias("obs_date"),
    )


@query(
    "recent_reports",
    "SELECT event_id, cast(user_id as varchar) AS product_name, value AS price, event_type AS store_name FROM events"
    " ORDER BY ts DESC, event_id DESC LIMIT 5",
)
def recent_reports(spark, sf):
    """The five latest price reports."""
    rows = table(spark, sf, "events").select(
        "event_id", F.col("user_id").cast("string").alias("product_name"), F.col("value").alias("price"),
        F.col("event_type").alias("store_name"), "ts",
    )
    return D.top(rows, [F.desc("ts"), F.desc("event_id")], 5).drop("ts")

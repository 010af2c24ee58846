"""Queries: landed feeds and texts, table publishing, streams."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from pricelens.catalog.q_parse import _DRINK
from pricelens.catalog.registry import avg, query, rnd
from pricelens.catalog.tables import AS_OF, TIE, current_and_history, observations, table, with_obs
from pricelens.functions.numbers import half_up
from pricelens.operators import deals as D
from pricelens.plans import weekly as W
from pricelens.schema import FEED
from pricelens.session import new_path
from pricelens.sources import feeds as FE
from pricelens.sources import landed_text as LT
from pricelens.sources import tables as TB
from pricelens.streaming import jobs as ST

KEY = ["order_no", "line_no", "part_no", "supp_no"]

# --- feeds -----------------------------------------------------------------------


_FEED_COLS = ["order_no", "line_no", "store", "item", "price_text", "obs_date", "status"]


def _feed_documents(spark, sf, which="true"):
    """One landed feed per observation, two items each, in drifting shapes."""
    obs = observations(spark, sf, _FEED_COLS).where(which)
    none = F.lit(None).cast("string")
    even = F.col("line_no") % 2 == 0

    def item(name, price, current, sale, until):
        values = {
            "name": name, "price": price, "current_price": current, "price_text": none, "sale_price": sale,
            "original_price": none, "valid_to": until, "image_url": none,
        }
        return F.struct(*[v.alias(k) for k, v in values.items()])

    own = item(
        F.concat(F.lit(" "), "item", F.lit(" ")), F.when(even, F.col("price_text")), F.lit("0"),
        F.when(~even, F.col("price_text")), F.when(F.col("line_no") == 3, F.lit("1999-01-31")),
    )
    blank = item(F.lit("  "), F.lit("$1.00"), none, none, none)
    items, k = F.array(own, blank), F.col("line_no") % 4
    return obs.select(
        F.col("order_no").alias("id"), F.col("store").alias("merchant"), F.lit("Weekly").alias("name"),
        F.date_format("obs_date", "yyyy-MM-dd'T'00:00:00").alias("valid_from"),
        F.date_format(F.date_add("obs_date", 7), "yyyy-MM-dd").alias("valid_to"),
        F.when(k == 0, items).alias("items"),
        F.when(k == 1, items).otherwise(F.array().cast(FEED["items"].dataType)).alias("spread_items"),
        F.when(k >= 2, items).alias("products"),
    )


@query(
    "feed_flatten",
    with_obs("""SELECT order_no AS feed_id, store, item, price_text, price, price_basis, count(*) AS n,
        cast(obs_date as varchar) AS valid_from, CASE WHEN line_no = 3 THEN '1999-01-31' ELSE cast(obs_date + 7 as varchar) END AS valid_until
        FROM obs GROUP BY ALL"""),
)
def feed_flatten(spark, sf):
    rows = FE.offers(_feed_documents(spark, sf))
    return rows.groupBy(
        "feed_id", "store", "item", "price_text", "price", "price_basis",
        F.col("valid_from").cast("string").alias("valid_from"), F.col("valid_until").cast("string").alias("valid_until"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "feed_json_files",
    with_obs(f"""SELECT store, count(*) AS n, {rnd('sum(cast(floor(price * 10000.0e0 + 0.5e0) as bigint)) / 10000.0e0')} AS total FROM obs GROUP BY store"""),
)
def feed_json_files(spark, sf):
    """Feeds written as JSON lines, packed, and read back with the feed schema."""
    from pricelens.functions.numbers import exact_sum

    path = new_path(spark, "feeds")
    _feed_documents(spark, sf).write.json(path, compression="gzip")
    return FE.offers(FE.read_feeds(spark, path)).groupBy("store").agg(
        F.count(F.lit(1)).alias("n"), half_up(exact_sum(F.col("price")), 2).alias("total")
    )


@query(
    "feed_items_in_order",
    with_obs("""SELECT order_no AS feed_id, store, o AS feed_order, CASE o WHEN 0 THEN item ELSE '' END AS item, count(*) AS n
        FROM obs, (SELECT unnest([0, 1]) AS o) GROUP BY ALL"""),
)
def feed_items_in_order(spark, sf):
    """Flattened feed items with their place in the feed, blank names included."""
    rows = FE.flatten_feeds(_feed_documents(spark, sf))
    return rows.groupBy("feed_id", "store", F.col("feed_order").cast("bigint").alias("feed_order"), "item").agg(
        F.count(F.lit(1)).alias("n"))


_WEEK_FROM_FEEDS = with_obs(f"""WITH dd AS (SELECT *, row_number() OVER (PARTITION BY store, item, price ORDER BY order_no) AS nth FROM obs
      WHERE status = 'O' AND trim(item) <> '' AND price > 0),
    cur AS (SELECT * FROM dd WHERE nth = 1 AND NOT ({_DRINK.replace('lower(t)', 'lower(item)')})),
    b AS (SELECT obs_date AS day, store, item, price FROM obs WHERE status = 'F' UNION ALL SELECT DATE '{AS_OF}', store, item, price FROM cur)
    SELECT DISTINCT cast(day as varchar) AS obs_date, store, lower(trim(item)) AS item, price FROM b""")


@query("weekly_run_from_feeds", _WEEK_FROM_FEEDS)
def weekly_run_from_feeds(spark, sf):
    """Feeds of the open offers through the whole weekly job; the keys of the archive it leaves."""
    cols = ["obs_date", "store", "item", "norm_name", "price", "price_basis", "unit_price", "unit_type", "valid_from", "valid_until"]
    _, history = current_and_history(spark, sf, [*cols, *_FEED_COLS])  # one table for the archive and the feeds
    feeds = _feed_documents(spark, sf, "status = 'O'")
    _, archive = W.run_from_feeds(feeds, history.select(*cols), date.fromisoformat(AS_OF))
    return archive.select(F.col("obs_date").cast("string").alias("obs_date"), "store", F.lower(F.trim("item")).alias("item"), "price")


# --- landed texts ----------------------------------------------------------------
_LINES = (
    "concat('ProductName | Price/Discount | MEMBER or REGULAR', chr(10), p_name, ' | $', cast(p_size as varchar(10)), '.49 | ',"
    " CASE p_partkey % 4 WHEN 0 THEN 'Member' WHEN 1 THEN 'club member' WHEN 2 THEN 'MyOffers Member' ELSE 'regular' END,"
    " chr(10), p_type, ' | 2/$', cast(p_size as varchar(10)), ' | regular', chr(10), p_brand, ' | $4/lb | regular', chr(10),"
    " 'no bars here', chr(10), ' | $3 | regular', chr(10), p_name, ' | 1,299 | member | x')"
)


@query(
    "parse_delimited",
    """WITH p AS (SELECT p_partkey, p_size % 9 + 1 AS page, p_name, p_type, p_brand, p_size, p_partkey % 4 AS k FROM part),
        l AS (SELECT p_partkey, page, 1 AS line_no, p_name AS name, concat('$', p_size, '.49') AS price_text, p_size + 0.49e0 AS price_value,
           k < 3 AS is_member, CASE k WHEN 0 THEN 'Member Price' WHEN 1 THEN 'Club Price' WHEN 2 THEN 'MyOffers' END AS member_indicator FROM p
         UNION ALL SELECT p_partkey, page, 2, p_type, concat('2/$', p_size), p_size / 2.0e0, false, NULL FROM p
         UNION ALL SELECT p_partkey, page, 3, p_brand, '$4/lb', 0.0e0, false, NULL FROM p
         UNION ALL SELECT p_partkey, page, 6, p_name, '1,299', 1299.0e0, true, 'Member Price' FROM p)
        SELECT p_partkey, page, line_no, name, price_text, round(price_value, 4) AS price_value, CASE WHEN page = 1 THEN 'top' WHEN page <= 4 THEN 'middle'
         ELSE 'bottom' END AS position, is_member, member_indicator FROM l""",
)
def parse_delimited(spark, sf):
    pages = table(spark, sf, "part").select(
        "p_partkey", (F.col("p_size") % 9 + 1).alias("page"), F.lit(9).alias("n_pages"), F.expr(_LINES).alias("text")
    )
    return LT.parse_delimited(pages, ["p_partkey"]).withColumn("price_value", F.round("price_value", 4))


@query(
    "parse_json_reply",
    """WITH r AS (SELECT p_partkey, p_name, p_type, p_size, p_partkey % 5 AS k FROM part)
        SELECT p_partkey, cast(0 as double) AS pos, false AS fallback, p_type AS category, 'General' AS sub_category, p_name AS norm_name,
         cast(p_size as double) AS score, '😐 Fair' AS rating, '' AS explanation FROM r WHERE k < 3
        UNION ALL SELECT p_partkey, 1, false, 'Other', 'Sub', '', 50.0, 'ok', 'why' FROM r WHERE k < 3
        UNION ALL SELECT p_partkey, NULL, true, NULL, NULL, NULL, NULL, NULL, NULL FROM r WHERE k >= 3""",
)
def parse_json_reply(spark, sf):
    body = F.concat(
        F.lit('[{"category":"'), "p_type", F.lit('","normalized_name":"'), "p_name", F.lit('","score":'),
        F.col("p_size").cast("string"), F.lit('},{"subcategory":"Sub","rating":"ok","explanation":"why"}]'),
    )
    k = F.col("p_partkey") % 5
    text = (
        F.when(k == 0, body)
        .when(k == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(k == 2, F.concat(F.lit("  "), body, F.lit("\n")))
        .when(k == 3, F.lit("Sorry, no list today"))
        .otherwise(F.lit('[{"category":"Beef"}]'))
    )
    replies = table(spark, sf, "part").select("p_partkey", text.alias("text"), F.lit(2).alias("expected"))
    return LT.parse_json_reply(replies, ["p_partkey"]).withColumn("pos", F.col("pos").cast("double"))


_SECTIONS = (
    "concat('intro', chr(10), 'Member Items', chr(10), '1 ', p_name, chr(10), 'page: 2 member', chr(10), p_brand, chr(10),"
    " 'FEATURED list', chr(10), '2 ', p_type, chr(10), 'spot checks', chr(10), p_name)"
)


@query(
    "section_slice",
    "SELECT p_partkey, concat('1 ', p_name, chr(10), 'page: 2 member', chr(10), p_brand) AS member_part,"
    " concat('2 ', p_type) AS featured_part, '' AS missing_part FROM part",
)
def section_slice(spark, sf):
    text = F.expr(_SECTIONS)
    return table(spark, sf, "part").select(
        "p_partkey",
        LT.section_after(text, "MEMBER ITEMS").alias("member_part"),
        LT.section_after(text, "FEATURED").alias("featured_part"),
        LT.section_after(text, "NO SUCH HEADER").alias("missing_part"),
    )


# --- tables ----------------------------------------------------------------------
@query(
    "coerced_table",
    with_obs("""SELECT order_no, line_no, part_no, supp_no, CASE WHEN line_no % 3 = 0 THEN NULL ELSE price END AS price,
        CASE WHEN line_no % 2 = 0 THEN 0 ELSE deal_score END AS deal_score, coalesce(CASE WHEN line_no % 5 > 0 THEN is_lowest END, false) AS is_lowest,
        CASE WHEN line_no = 7 THEN 'Other' ELSE category END AS category, cast(null as double) AS historical_min FROM obs"""),
)
def coerced_table(spark, sf):
    n = F.col("line_no")
    drifting = observations(spark, sf, [*KEY, "price", "deal_score", "is_lowest", "category"]).select(
        *KEY,
        F.when(n % 3 == 0, F.lit("n/a")).otherwise(F.col("price").cast("string")).alias("price"),
        F.when(n % 2 != 0, F.col("deal_score").cast("string")).alias("deal_score"),
        F.when(n % 5 > 0, F.col("is_lowest").cast("string")).alias("is_lowest"),
        F.when(n != 7, F.col("category")).alias("category"),
    )
    typed = D.coerced(drifting, ["price", "deal_score"], ["is_lowest"])
    return D.with_missing_columns(typed, {"historical_min": "double", "price": "double"})


@query(
    "published_table",
    with_obs("SELECT 2 AS version, count(*) AS n, count(DISTINCT store) AS n_stores FROM obs WHERE status = 'O'"),
)
def published_table(spark, sf):
    """Two versions published, the second one read back; an empty third is refused."""
    current, history = current_and_history(spark, sf)
    path = new_path(spark, "published")
    TB.publish(history.select("store", "item", "price"), path)
    number = TB.publish(current.select("store", "item", "price"), path)
    try:
        TB.publish(current.select("store", "item", "price").where("price < 0"), path)
        raise AssertionError("an empty table replaced a filled one")
    except ValueError:
        pass
    return TB.read_published(spark, path).agg(
        F.lit(number).cast("int").alias("version"), F.count(F.lit(1)).alias("n"), F.count_distinct("store").alias("n_stores")
    )


@query(
    "row_count_guard",
    with_obs("SELECT count(*) AS rows_before, count(*) AS rows_after, true AS unchanged FROM obs WHERE status = 'F'"),
)
def row_count_guard(spark, sf):
    _, history = current_and_history(spark, sf)
    return TB.same_row_count(history, W.clean_archive(history))


@query(
    "archive_table_append",
    with_obs("""SELECT strftime(obs_date, '%Y-%m') AS obs_month, count(DISTINCT (obs_date, store, lower(trim(item)), price)) AS n
        FROM obs GROUP BY 1"""),
)
def archive_table_append(spark, sf):
    """Archive written, open rows taken in, and taken in again: the second time changes nothing."""
    cols = ["obs_date", "store", "item", "price", "order_no"]
    current, history = current_and_history(spark, sf, cols)
    path = new_path(spark, "archive")
    arrival = [F.col("order_no")]
    for batch in (history, current, current):
        TB.append_archive_table(spark, path, batch.select(*cols), arrival)
    return spark.read.parquet(path).groupBy(F.col("obs_month").cast("string").alias("obs_month")).agg(F.count(F.lit(1)).alias("n"))


_TEXTS = ["store", "item", "price_text", "price"]


@query("csv_table", with_obs("SELECT store, count(*) AS n, count(DISTINCT item) AS n_items, min(price) AS low FROM obs GROUP BY store"))
def csv_table(spark, sf):
    """The table written as CSV and read back with its schema."""
    path = new_path(spark, "csv")
    rows = observations(spark, sf).select(*_TEXTS)
    rows.write.option("header", True).csv(path)
    back = TB.read_observations(spark, path, rows.schema, "csv")
    return back.groupBy("store").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("item").alias("n_items"), F.min("price").alias("low"))


@query("first_available_table", with_obs("SELECT store, count(*) AS n FROM obs GROUP BY store"))
def first_available_table(spark, sf):
    """The first of several places that exists is read; the others are missing."""
    path = new_path(spark, "second")
    rows = observations(spark, sf).select(*_TEXTS)
    rows.write.parquet(path)
    found = TB.first_available(spark, [new_path(spark, "first"), path], rows.schema)
    return found.groupBy("store").agg(F.count(F.lit(1)).alias("n"))


@query("report_lines_file", with_obs("SELECT concat(store, ': ', count(*), ' deals') AS value FROM obs GROUP BY store"))
def report_lines_file(spark, sf):
    """Report lines written as text and read back."""
    path = new_path(spark, "lines")
    counts = observations(spark, sf).groupBy("store").agg(F.count(F.lit(1)).alias("n"))
    TB.write_lines(counts.select("store", F.concat("store", F.lit(": "), "n", F.lit(" deals")).alias("text")), path, ["store"])
    return spark.read.text(path)


@query(
    "member_extract",
    with_obs("SELECT store, item, price_text, price FROM obs WHERE member"),
)
def member_extract(spark, sf):
    path = new_path(spark, "extract")
    TB.extract(observations(spark, sf), "member", ["store", "item", "price_text", "price"], path)
    return spark.read.parquet(path)


@query(
    "price_reports",
    with_obs("SELECT item AS product_name, price, cast(obs_date as varchar) AS recorded_at FROM obs WHERE price IS NOT NULL"),
)
def price_reports(spark, sf):
    return TB.price_reports(observations(spark, sf)).withColumn("recorded_at", F.col("recorded_at").cast("string"))


# --- streams ---------------------------------------------------------------------
_EV = "ev AS (SELECT *, event_type AS store, cast(user_id as varchar) AS item, value AS price, cast(ts as date) AS obs_date FROM events)"


def _event_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    raw = ST.read_stream(spark, sf, schema, "events.parquet")
    return _event_rows(raw)


def _event_rows(df):
    return df.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("store"),
        F.col("user_id").cast("string").alias("item"), F.col("value").alias("price"), F.to_date("ts").alias("obs_date"),
    )


@query(
    "stream_ingest",
    f"""WITH {_EV}, k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY obs_date, store, item, price ORDER BY event_id DESC) AS r
        FROM ev) WHERE r = 1) SELECT event_id, store, item, price, cast(obs_date as varchar) AS obs_date FROM k""",
)
def stream_ingest(spark, sf):
    archive = ST.ingest(_event_stream(spark, sf), new_path(spark, "archive"), [F.col("event_id")])
    return archive.select("event_id", "store", "item", "price", F.col("obs_date").cast("string").alias("obs_date"))


def _event_files(spark, sf):
    """The events landed in eight files, three a micro-batch."""
    folder = new_path(spark, "landed")
    events = table(spark, sf, "events")
    events.repartition(8, "event_id").write.parquet(folder)
    return _event_rows(ST.read_stream(spark, folder, events.schema, files_per_batch=3))


@query(
    "stream_ingest_files",
    f"WITH {_EV} SELECT DISTINCT cast(obs_date as varchar) AS obs_date, store, item, price FROM ev",
)
def stream_ingest_files(spark, sf):
    """The events in eight files, three a micro-batch; what the archive holds does not depend on that."""
    archive = ST.ingest(_event_files(spark, sf), new_path(spark, "archive"), [F.col("event_id")])
    return archive.select(F.col("obs_date").cast("string").alias("obs_date"), "store", "item", "price")


@query(
    "stream_dedup",
    f"WITH {_EV} SELECT DISTINCT cast(obs_date as varchar) AS obs_date, store, item FROM ev",
)
def stream_dedup(spark, sf):
    rows = ST.deduplicated(_event_stream(spark, sf), ["obs_date", "store", "item"], None)
    kept = ST.appended_rows(rows.select("obs_date", "store", "item"))
    return kept.withColumn("obs_date", F.col("obs_date").cast("string"))


@query(
    "stream_dedup_files",
    f"WITH {_EV} SELECT DISTINCT cast(obs_date as varchar) AS obs_date, store, item FROM ev",
)
def stream_dedup_files(spark, sf):
    """As stream_dedup over several micro-batches, so the state of earlier ones decides."""
    rows = ST.deduplicated(_event_files(spark, sf), ["obs_date", "store", "item"], None)
    kept = ST.appended_rows(rows.select("obs_date", "store", "item"))
    return kept.withColumn("obs_date", F.col("obs_date").cast("string"))


def _window_sql(length: int, slide: int) -> str:
    """Windows start at multiples of the slide since the epoch."""
    n = length // slide
    return f"""WITH {_EV}, w AS (SELECT store, price, (cast(floor(epoch(ts) / {slide * 86400}) as bigint) - k) * {slide * 86400} AS s
        FROM ev, (SELECT unnest(range({n + 1})) AS k) WHERE (cast(floor(epoch(ts) / {slide * 86400}) as bigint) - k) * {slide * 86400}
         + {length * 86400} > epoch(ts))
        SELECT store, strftime(make_timestamp(s * 1000000), '%Y-%m-%d') AS window_start, count(*) AS n, min(price) AS min_price,
        max(price) AS max_price, {rnd(avg('price'))} AS avg_price FROM w GROUP BY ALL"""


def _window_rows(spark, sf, length, slide=None):
    stats = ST.window_stats(_event_stream(spark, sf), ["store"], length, None, slide)
    rows = ST.upserted_rows(stats, ["store", "window_start"])
    return rows.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd"))


@query("stream_weekly_stats", _window_sql(7, 7))
def stream_weekly_stats(spark, sf):
    return _window_rows(spark, sf, "7 days")


@query("stream_lookback_stats", _window_sql(180, 7))
def stream_lookback_stats(spark, sf):
    """180 days every week: the stream keeps panes, the windows are put together from them."""
    panes = ST.upserted_rows(ST.pane_stats(_event_files(spark, sf), ["store"], 180, 7, None), ["store", "slide_start", "tail"])
    return ST.merge_panes(panes, ["store"], 180, 7).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd"))


@query(
    "stream_latest_price",
    f"""WITH {_EV} SELECT store, item, arg_max(price, (ts, price)) AS last_price, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen,
        count(*) AS n_seen FROM ev GROUP BY store, item""",
)
def stream_latest_price(spark, sf):
    rows = ST.upserted_rows(ST.latest_price(_event_stream(spark, sf), ["store", "item"]), ["store", "item"])
    return rows.withColumn("last_seen", F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss"))


@query(
    "stream_price_table",
    f"""WITH {_EV} SELECT store, item, arg_max(price, (ts, price)) AS last_price, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen,
        count(*) AS n_seen FROM ev GROUP BY store, item""",
)
def stream_price_table(spark, sf):
    path, keys, events = new_path(spark, "state"), ["store", "item"], _event_stream(spark, sf)
    ST.keep_latest_prices(events, path, keys, "14 days")
    rows = ST.latest_prices(spark, path, keys, events)
    return rows.withColumn("last_seen", F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss"))


@query(
    "stream_static_match",
    f"""WITH {_EV}, h AS (SELECT item, {rnd(avg('price'))} AS avg_price, min(price) AS min_price FROM ev GROUP BY item)
        SELECT event_id, {rnd('(avg_price - price) / nullif(avg_price, 0) * 100', 1)} AS pct_below_avg, price <= min_price AS is_lowest
        FROM ev JOIN h USING (item)""",
)
def stream_static_match(spark, sf):
    from pricelens.functions.numbers import exact_avg

    history = _event_rows(table(spark, sf, "events"))
    stats = history.groupBy("item").agg(
        half_up(exact_avg(F.col("price")), 2).alias("avg_price"), F.min("price").alias("min_price")
    )
    return ST.appended_rows(
        ST.against_history(_event_stream(spark, sf), stats, "item").select("event_id", "pct_below_avg", "is_lowest")
    )

"""Queries: parsing, rule classification, labels and sentences."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from pricelens.catalog.registry import has_any, has_word, query, quoted, rnd
from pricelens.catalog.tables import AS_OF, observations, table, with_obs
from pricelens.functions import dates, price as PR, rules as R, score as SC, text as TX, vocab
from pricelens.operators import filters as P

KEY = ["order_no", "line_no", "part_no", "supp_no"]
LAST_DAY = date.fromisoformat(AS_OF)

# price texts in all shapes, spelled out from the same columns in both engines
RAW = (
    "CASE (order_no + line_no) % 11 WHEN 0 THEN concat('  ', price_text, ' ') WHEN 1 THEN upper(price_text)"
    " WHEN 2 THEN replace(price_text, '$', '') WHEN 3 THEN concat(price_text, ' or best offer')"
    " WHEN 4 THEN 'see store' WHEN 5 THEN concat('0 for ', price_text) WHEN 6 THEN concat('99¢ (', price_text, ')')"
    " WHEN 7 THEN '1,299.00' WHEN 8 THEN concat(price_text, 'ml') WHEN 9 THEN concat('-', price_text)"
    " ELSE price_text END"
)


def _num(expr: str, pattern: str, group: int = 1) -> str:
    p = pattern.replace("'", "''")
    return f"try_cast(nullif(regexp_extract({expr}, '{p}', {group}), '') as double)"


_T = "lower(trim(raw_price))"
PARSED = f"""
raw AS (SELECT *, {RAW} AS raw_price FROM obs),
cap AS (SELECT *, {_num(_T, PR.PER_LB)} AS lb, {_num(_T, PR.PER_KG)} AS kg, {_num(_T, PR.PER_100G)} AS hg,
  {_num(_T, PR.MULTI_BUY, 1)} AS q, {_num(_T, PR.MULTI_BUY, 2)} AS t, {_num(_T, PR.SIGNED_NUMBER)} AS num FROM raw),
parsed AS (SELECT *, CASE WHEN lb IS NOT NULL THEN lb WHEN kg IS NOT NULL THEN kg WHEN hg IS NOT NULL THEN hg
   WHEN q > 0 THEN {rnd('t / q')} ELSE num END AS p_price,
  CASE WHEN lb IS NOT NULL THEN 'per_lb' WHEN kg IS NOT NULL THEN 'per_kg' WHEN hg IS NOT NULL THEN 'per_100g'
   WHEN q > 0 THEN 'multi_buy' WHEN num IS NOT NULL THEN 'each' END AS p_basis FROM cap)
"""


def _raw(spark, sf):
    return observations(spark, sf).withColumn("raw_price", F.expr(RAW))


@query(
    "price_parse",
    with_obs(f"WITH {PARSED} SELECT {', '.join(KEY)}, raw_price, p_price AS price, p_basis AS price_basis FROM parsed"),
)
def price_parse(spark, sf):
    return PR.parse_prices(_raw(spark, sf).select(*KEY, "raw_price")).drop("price_text")


@query(
    "price_parse_legacy",
    with_obs(f"""WITH raw AS (SELECT *, {RAW} AS raw_price FROM obs),
        c AS (SELECT *, trim(lower(translate(raw_price, '$¢', ''))) AS t FROM raw),
        cap AS (SELECT *, {_num('t', PR.LEGACY_WEIGHT)} AS w, regexp_extract(t, '{PR.LEGACY_WEIGHT}', 2) AS u,
          {_num('t', PR.LEGACY_MULTI, 1)} AS q, {_num('t', PR.LEGACY_MULTI, 2)} AS tot, {_num('t', PR.SIGNED_NUMBER)} AS num FROM c),
        k AS (SELECT *, {rnd("w * CASE u WHEN 'lb' THEN 2.20462e0 WHEN '100g' THEN 10.0e0 WHEN 'g' THEN 1000.0e0 ELSE 1.0e0 END")}
          AS per_kg FROM cap)
        SELECT {', '.join(KEY)}, CASE WHEN w IS NOT NULL THEN w WHEN q > 0 THEN tot / q ELSE num END AS price, per_kg,
        CASE WHEN per_kg IS NOT NULL THEN concat('$', printf('%.2f', per_kg), '/kg') END AS per_kg_text FROM k"""),
)
def price_parse_legacy(spark, sf):
    return PR.parse_prices_legacy(_raw(spark, sf).select(*KEY, "raw_price")).drop("raw_price")


_CAPS = {
    "n1": (PR.PACKS, 1), "n2": (PR.PACKS, 2), "kg": (PR.KILOS, 1), "g": (PR.GRAMS, 1), "lb": (PR.POUNDS, 1),
    "oz": (PR.OUNCES, 1), "l": (PR.LITRES, 1), "ml": (PR.MILLILITRES, 1), "ct": (PR.COUNTS, 1),
}
_SIZES = ", ".join(f"{_num('lower(item)', p, g)} AS {n}" for n, (p, g) in _CAPS.items()) + (
    f", regexp_extract(lower(item), '{PR.PACKS}', 3) AS pu"
)


@query(
    "unit_price",
    with_obs(f"""WITH {PARSED}, z AS (SELECT * EXCLUDE (lb, kg), {_SIZES}, lower(trim(raw_price)) AS m FROM parsed),
        k AS (SELECT *, CASE p_basis WHEN 'per_lb' THEN p_price / 0.453592e0 WHEN 'per_kg' THEN p_price
           WHEN 'per_100g' THEN p_price * 10 ELSE CASE WHEN contains(m, '/lb') OR contains(m, 'per lb') THEN p_price / 0.453592e0
           WHEN contains(m, '/kg') OR contains(m, 'per kg') THEN p_price
           WHEN contains(m, '/100') AND contains(m, 'g') THEN p_price * 10 END END AS pk FROM z),
        s AS (SELECT *, CASE
           WHEN n1 * n2 > 0 THEN CASE pu WHEN 'g' THEN n1 * n2 / 1000 WHEN 'ml' THEN n1 * n2 / 1000 WHEN 'l' THEN n1 * n2
             ELSE n1 * n2 * 28.3495e0 / 1000 END
           WHEN kg > 0 THEN kg WHEN g > 0 THEN g / 1000 WHEN lb > 0 THEN lb * 0.453592e0 WHEN oz > 0 THEN oz * 28.3495e0 / 1000
           WHEN l > 0 THEN l WHEN ml > 0 THEN ml / 1000 WHEN ct >= 2 THEN ct END AS sz,
          CASE WHEN n1 * n2 > 0 THEN CASE WHEN pu IN ('ml', 'l') THEN '$/L' ELSE '$/kg' END
           WHEN kg > 0 OR g > 0 OR lb > 0 OR oz > 0 THEN '$/kg' WHEN l > 0 OR ml > 0 THEN '$/L' WHEN ct >= 2 THEN '$/each' END AS ut,
          CASE WHEN n1 * n2 > 0 THEN CASE pu WHEN 'l' THEN n1 * n2 * 1000 WHEN 'oz' THEN n1 * n2 * 28.3495e0 ELSE n1 * n2 END
           WHEN kg > 0 THEN kg * 1000 WHEN g > 0 THEN g WHEN lb > 0 THEN lb * 0.453592e0 * 1000 WHEN oz > 0 THEN oz * 28.3495e0
           WHEN l > 0 THEN l * 1000 WHEN ml > 0 THEN ml WHEN ct >= 2 THEN ct END AS qt FROM k)
        SELECT {', '.join(KEY)}, CASE WHEN p_price > 0 THEN {rnd('coalesce(pk, p_price / sz)')} END AS unit_price,
         CASE WHEN p_price > 0 THEN CASE WHEN pk IS NOT NULL THEN '$/kg' ELSE ut END END AS unit_type,
         {rnd('CASE WHEN p_price > 0 AND pk IS NULL THEN qt END', 4)} AS qty_equiv FROM s"""),
)
def unit_price(spark, sf):
    from pricelens.functions.numbers import half_up

    rows = PR.parse_prices(_raw(spark, sf).select(*KEY, "item", "raw_price"))
    return PR.add_unit_prices(rows).select(
        *KEY, "unit_price", "unit_type", half_up(F.col("qty_equiv"), 4).alias("qty_equiv")
    )


_SIZED = f"""z AS (SELECT *, {_SIZES} FROM obs),
    sz AS (SELECT *, CASE WHEN n1 IS NOT NULL THEN n1 * n2 ELSE coalesce(kg, g, l, ml) END AS quantity_value,
      CASE WHEN n1 IS NOT NULL THEN pu WHEN kg IS NOT NULL THEN 'kg' WHEN g IS NOT NULL THEN 'g' WHEN l IS NOT NULL THEN 'L'
       WHEN ml IS NOT NULL THEN 'ml' END AS quantity_unit,
      CASE WHEN n1 IS NOT NULL THEN n1 * n2 * CASE pu WHEN 'l' THEN 1000.0e0 WHEN 'oz' THEN 28.35e0 ELSE 1.0e0 END
       ELSE coalesce(kg * 1000, g, l * 1000, ml) END AS grams,
      n1 IS NOT NULL AS is_multipack, cast(coalesce(n1, 1) as bigint) AS pack_count FROM z),
    pt AS (SELECT *, CASE WHEN {has_any('lower(item)', vocab.SNACK_WORDS)} THEN 'snack'
      WHEN {has_any('lower(item)', vocab.FAMILY_WORDS)} THEN 'family'
      WHEN is_multipack AND grams <> 0 AND grams / pack_count <= 150 THEN 'snack' WHEN is_multipack THEN 'family'
      WHEN grams IS NULL THEN 'unknown' WHEN grams <= 200 THEN 'snack' WHEN grams <= 500 THEN 'single_serve'
      WHEN grams <= 1500 THEN 'family' ELSE 'bulk' END AS product_type FROM sz)"""


@query(
    "product_size",
    with_obs(f"""WITH {_SIZED} SELECT {', '.join(KEY)}, quantity_value, quantity_unit, {rnd('grams', 4)} AS grams, is_multipack,
        pack_count, {rnd('CASE WHEN grams > 0 THEN price / (grams / 1000) END', 4)} AS size_price FROM pt"""),
)
def product_size(spark, sf):
    from pricelens.functions.numbers import half_up

    rows = PR.add_sizes(observations(spark, sf).select(*KEY, "item", "price")).drop("item", "price")
    return rows.withColumns({c: half_up(F.col(c), 4) for c in ("grams", "size_price")})


def _food(text: str, category: str) -> str:
    """Reason text of the food rules; the flag follows from the reason."""
    parts = [
        f"WHEN {has_any(f'lower({category})', vocab.NON_FOOD_CATEGORY_WORDS)} THEN CASE WHEN"
        f" {has_any(text, vocab.BABY_FOOD_WORDS)} THEN 'baby_food' ELSE concat('category:', {category}) END"
    ]
    for brand, other, food in vocab.AMBIGUOUS_BRANDS:
        parts.append(
            f"WHEN {has_word(text, [brand])} THEN CASE WHEN {has_any(text, other)} THEN 'ambiguous_brand:{brand}->nonfood'"
            f" WHEN {has_any(text, food)} THEN 'ambiguous_brand:{brand}->food' ELSE 'ambiguous_brand:{brand}->default' END"
        )
    for kind, brands in vocab.NON_FOOD_BRANDS.items():
        parts += [f"WHEN {has_word(text, [b])} THEN 'brand:{b}->{kind}'" for b in brands]
    parts += [f"WHEN contains({text}, '{w}') THEN 'keyword:{w}'" for w in vocab.NON_FOOD_WORDS]
    return f"CASE {' '.join(parts)} ELSE 'default:food' END"


_IS_FOOD = "(reason IN ('baby_food', 'default:food') OR reason LIKE '%->food' OR reason LIKE '%->baby_food')"


@query(
    "food_filter",
    with_obs(f"""WITH i AS (SELECT DISTINCT item, category FROM obs), f AS (SELECT *, {_food('lower(item)', 'category')}
        AS reason FROM i) SELECT item, category, {_IS_FOOD} AS is_food, reason FROM f"""),
)
def food_filter(spark, sf):
    """Food verdict of every distinct item; names repeat, so rules run once per name."""
    items = observations(spark, sf).select("item", "category").distinct()
    return items.select("item", "category", R.food_verdict(F.col("item"), F.col("category")).alias("v")).select(
        "item", "category", "v.is_food", "v.reason"
    )


@query(
    "food_filter_documents",
    f"""WITH f AS (SELECT doc_id, {_food('lower(text)', 'source')} AS reason FROM documents)
        SELECT doc_id, {_IS_FOOD} AS is_food, reason FROM f""",
)
def food_filter_documents(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", R.food_verdict(F.col("text"), F.col("source")).alias("v")).select(
        "doc_id", "v.is_food", "v.reason"
    )


@query(
    "grocery_deals",
    with_obs(f"""WITH i AS (SELECT DISTINCT item, category FROM obs), f AS (SELECT *, {_food('lower(item)', 'category')}
        AS reason FROM i) SELECT o.order_no, o.line_no, o.part_no, o.supp_no, o.item, o.ai_score FROM obs o JOIN f
        ON f.item = o.item AND f.category = o.category WHERE o.ai_score >= 75 AND {_IS_FOOD}"""),
)
def grocery_deals(spark, sf):
    return P.grocery_deals(observations(spark, sf)).select(*KEY, "item", "ai_score")


@query(
    "product_type",
    with_obs(f"""WITH {_SIZED}, f AS (SELECT *, {_food('lower(item)', 'category')} AS reason FROM pt)
        SELECT {', '.join(KEY)}, product_type, concat(category, '/', product_type) AS comparison_group,
        {_IS_FOOD} AND product_type <> 'unknown' AND grams IS NOT NULL AS can_compare FROM f"""),
)
def product_type(spark, sf):
    cols = [*KEY, "item", "category", "price"]
    rows = PR.add_sizes(observations(spark, sf, cols).select(*cols))
    kind = R.product_type(F.col("item"), F.col("grams"), F.col("is_multipack"), F.col("pack_count"))
    food = R.food_verdict(F.col("item"), F.col("category")).getField("is_food")
    rows = rows.withColumns({"product_type": kind, "is_food": food})
    return rows.select(
        *KEY, "product_type", F.concat_ws("/", "category", "product_type").alias("comparison_group"),
        (F.col("is_food") & (F.col("product_type") != "unknown") & F.col("grams").isNotNull()).alias("can_compare"),
    )


_DRINK = (
    f"NOT {has_any('lower(t)', vocab.DRINK_WHITELIST)} AND ({has_word('lower(t)', vocab.DRINK_KEYWORDS)}"
    f" OR {has_any('lower(t)', vocab.DRINK_PHRASES)})"
)


@query(
    "drink_exclusion",
    with_obs(f"WITH i AS (SELECT item AS t, count(*) AS n FROM obs GROUP BY item) SELECT t AS item, n, {_DRINK} AS excluded FROM i"),
)
def drink_exclusion(spark, sf):
    items = observations(spark, sf).groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    return items.withColumn("excluded", R.is_excluded_drink(F.col("item")))


@query("drink_exclusion_documents", f"WITH i AS (SELECT doc_id, text AS t FROM documents) SELECT doc_id, {_DRINK} AS excluded FROM i")
def drink_exclusion_documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", R.is_excluded_drink(F.col("text")).alias("excluded"))


@query(
    "merchant_exclusion",
    with_obs(f"SELECT store, count(*) AS n FROM obs WHERE NOT {has_any('lower(store)', vocab.EXCLUDED_MERCHANTS)} GROUP BY store"),
)
def merchant_exclusion(spark, sf):
    return P.without_merchants(observations(spark, sf)).groupBy("store").agg(F.count(F.lit(1)).alias("n"))


@query(
    "item_word_exclusion",
    f"SELECT page_id FROM pages WHERE NOT {has_any('lower(html)', vocab.EXCLUDED_ITEM_WORDS)}",
)
def item_word_exclusion(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", F.col("html").alias("item"))
    return P.without_item_words(pages).select("page_id")


@query(
    "key_item_flag",
    with_obs(f"SELECT item, {has_any('lower(item)', vocab.KEY_ITEMS)} AS is_key, count(*) AS n FROM obs GROUP BY item"),
)
def key_item_flag(spark, sf):
    items = observations(spark, sf, ["item"]).groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    return items.withColumn("is_key", R.is_key_item(F.col("item")))


@query(
    "raw_protein",
    with_obs(f"""SELECT {', '.join(KEY)}, item FROM obs WHERE category IN ({quoted(vocab.REPORT_PROTEINS)})
        AND NOT {has_any('lower(item)', vocab.PREPARED_WORDS)}"""),
)
def raw_protein(spark, sf):
    return P.raw_proteins(observations(spark, sf)).select(*KEY, "item")


def _category(text: str) -> str:
    words = " ".join(f"WHEN {has_word(text, w)} THEN '{c}'" for c, w in vocab.CATEGORY_WORDS.items())
    return (
        f"CASE WHEN {has_any(text, vocab.POULTRY_SAUSAGE)} THEN 'Poultry' WHEN {has_any(text, vocab.PORK_SAUSAGE)}"
        f" OR contains({text}, 'sausage') THEN 'Pork' {words} ELSE 'Other' END"
    )


@query(
    "keyword_category",
    with_obs(f"SELECT item, {_category('lower(item)')} AS category, count(*) AS n FROM obs GROUP BY item"),
)
def keyword_category(spark, sf):
    items = observations(spark, sf).groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    return items.withColumn("category", R.keyword_category(F.col("item")))


@query("keyword_category_documents", f"SELECT doc_id, {_category('lower(text)')} AS category FROM documents")
def keyword_category_documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", R.keyword_category(F.col("text")).alias("category"))


def _caps() -> str:
    return " OR ".join(
        f"(regexp_matches(lower(trim(item)), '{p}') AND price BETWEEN 0.30 AND {c})" for p, c in vocab.COUNTER_PATTERNS
    )


COUNTER = (
    f"(store IN ({quoted(vocab.COUNTER_STORES)}) AND coalesce(price_basis, '') IN ('', 'each')"
    f" AND NOT {has_any('lower(trim(item))', vocab.COUNTER_BRANDS)} AND NOT {has_any('lower(trim(item))', vocab.COUNTER_TERMS)}"
    f" AND NOT regexp_matches(lower(trim(item)), '{vocab.PACKAGE_WEIGHT}') AND ({_caps()}))"
)
_FIXED = f"""SELECT {', '.join(KEY)}, {COUNTER} AS per_100g_corrected,
    CASE WHEN {COUNTER} THEN 'per_100g' ELSE price_basis END AS price_basis,
    CASE WHEN {COUNTER} THEN {rnd('price * 10')} ELSE unit_price END AS unit_price,
    CASE WHEN {COUNTER} THEN '$/kg' ELSE unit_type END AS unit_type FROM obs"""


@query("counter_price_fix", with_obs(_FIXED))
def counter_price_fix(spark, sf):
    return P.with_counter_fix(observations(spark, sf)).select(
        *KEY, "per_100g_corrected", "price_basis", "unit_price", "unit_type"
    )


@query(
    "counter_price_fix_archive",
    with_obs(f"WITH f AS ({_FIXED.replace('FROM obs', 'FROM obs WHERE status = ' + chr(39) + 'F' + chr(39))})"
             " SELECT count(*) AS n_rows, count(*) FILTER (per_100g_corrected) AS n_fixed,"
             " cast(round(sum(CASE WHEN per_100g_corrected THEN unit_price * 100 END)) as bigint) AS fixed_cents FROM f"),
)
def counter_price_fix_archive(spark, sf):
    """The archive after the same correction: row count kept, rows corrected."""
    fixed = P.with_counter_fix(observations(spark, sf).where("status = 'F'"))
    cents = F.sum(F.when(F.col("per_100g_corrected"), F.round(F.col("unit_price") * 100).cast("bigint")))
    return fixed.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if("per_100g_corrected").alias("n_fixed"), cents.alias("fixed_cents")
    )


@query(
    "name_tokens",
    with_obs(f"""WITH i AS (SELECT DISTINCT item FROM obs) SELECT item, array_to_string(list_sort(list_distinct(list_filter(
        regexp_split_to_array(translate(lower(item), '(),', '   '), '\\s+'),
        lambda w: length(w) >= 3 AND NOT list_contains([{quoted(vocab.NAME_SKIP_WORDS)}], w)))), ' ') AS tokens FROM i"""),
)
def name_tokens(spark, sf):
    items = observations(spark, sf).select("item").distinct()
    return items.select("item", F.array_join(F.array_sort(TX.name_tokens(F.col("item"))), " ").alias("tokens"))


@query(
    "document_key_words",
    f"""SELECT doc_id, len(list_filter([{quoted(vocab.PROTEIN_WORDS)}], lambda w: contains(lower(text), w))) AS hits,
        len(list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: length(w) >= 4))) AS n_words
        FROM documents""",
)
def document_key_words(spark, sf):
    """Keyword hits and distinct long words of whole texts."""
    text = F.lower("text")
    terms = F.array(*[F.lit(w) for w in vocab.PROTEIN_WORDS])
    return table(spark, sf, "documents").select(
        "doc_id", TX.hits(terms, text).cast("bigint").alias("hits"), F.size(TX.words(text, 4)).cast("bigint").alias("n_words")
    )


@query(
    "display_category",
    with_obs("SELECT category, CASE WHEN trim(category) IN ('Meat', 'Meat & Seafood', 'Deli', 'Prepared Meals', 'Seafood', 'Fish')"
             " THEN 'Meat & Protein' WHEN trim(category) IN ('Dairy', 'Dairy & Eggs', 'Yogurt', 'Cheese', 'Milk', 'Butter', 'Frozen')"
             " THEN 'Dairy & Fridge' WHEN trim(category) IN ('Produce', 'Fruit', 'Vegetables') THEN 'Produce'"
             " WHEN trim(category) IN ('Snacks', 'Candy', 'Sweets', 'Confectionery', 'Desserts', 'Beverages', 'Chips', 'Cookies')"
             " THEN 'Snacks & Treats' ELSE 'Other' END AS shown,"
             f" CASE WHEN category IN ({quoted(vocab.TAXONOMY)}) THEN category ELSE 'Other' END AS known, count(*) AS n"
             " FROM obs GROUP BY category"),
)
def display_category(spark, sf):
    rows = observations(spark, sf).groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumns(
        {"shown": R.display_category(F.col("category")), "known": R.known_category(F.col("category"))}
    )


@query(
    "store_names",
    with_obs("""SELECT store, CASE store WHEN 'Real Canadian Superstore' THEN 'Superstore' WHEN 'Save-On-Foods' THEN 'Save-On'
        WHEN 'Calgary Co-op' THEN 'Co-op' ELSE store END AS short,
        CASE store WHEN 'Corner Liquor' THEN cast(null as varchar) WHEN 'Walmart' THEN cast(null as varchar) ELSE store END AS of_file,
        count(*) AS n FROM obs GROUP BY store"""),
)
def store_names(spark, sf):
    rows = observations(spark, sf).groupBy("store").agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumns(
        {
            "short": R.short_store(F.col("store")),
            "of_file": R.store_of_file(F.concat(F.col("store"), F.lit(" week 12.pdf"))),
        }
    )


@query(
    "validity_defaults",
    with_obs("""SELECT order_no, line_no, part_no, supp_no, cast(coalesce(valid_from, obs_date) as varchar) AS valid_from,
        cast(coalesce(valid_until, coalesce(valid_from, obs_date) + 7) as varchar) AS valid_until FROM obs"""),
)
def validity_defaults(spark, sf):
    start = dates.valid_from(F.col("valid_from"), F.col("obs_date"))
    return observations(spark, sf).select(
        *KEY, start.cast("string").alias("valid_from"),
        dates.valid_until(F.col("valid_until"), start).cast("string").alias("valid_until"),
    )


_ENDS = "CASE WHEN l_returnflag = 'N' THEN NULL WHEN l_linenumber % 2 = 0 THEN s - 9 ELSE s + 5 END"


@query(
    "date_repair",
    f"""WITH d AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_shipdate as date) AS s, l_returnflag FROM lineitem),
        e AS (SELECT *, {_ENDS} AS u FROM d)
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
        cast(CASE WHEN u < s THEN s + 7 WHEN u IS NULL THEN s + 7 ELSE u END as varchar) AS until_v1,
        cast(CASE WHEN u < s THEN s + 7 WHEN u IS NULL THEN s + 3 ELSE u END as varchar) AS until_v2,
        cast(least(s, DATE '2000-06-30') as varchar) AS seen FROM e""",
)
def date_repair(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.to_date("l_shipdate").alias("s"), "l_returnflag"
    )
    end = (
        F.when(F.col("l_returnflag") == "N", None)
        .when(F.col("l_linenumber") % 2 == 0, F.date_sub("s", 9))
        .otherwise(F.date_add("s", 5))
    )
    rows = rows.withColumn("u", end)
    u, s = F.col("u"), F.col("s")
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        dates.repaired_end(u, s, 7).cast("string").alias("until_v1"),
        dates.repaired_end(u, s, 3).cast("string").alias("until_v2"),
        dates.repaired_day(s, F.lit(date(2000, 6, 30))).cast("string").alias("seen"),
    )


@query(
    "lenient_dates",
    """WITH t AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d')
        WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') WHEN 2 THEN strftime(o_orderdate, '%m/%d/%Y')
        WHEN 3 THEN 'not a date' ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') END AS s, o_orderdate FROM orders)
        SELECT o_orderkey, s, CASE WHEN s <> 'not a date' THEN strftime(o_orderdate, '%Y-%m-%d') END AS parsed FROM t""",
)
def lenient_dates(spark, sf):
    d = F.col("o_orderdate")
    k = F.col("o_orderkey") % 5
    text = (
        F.when(k == 0, F.date_format(d, "yyyy-MM-dd"))
        .when(k == 1, F.date_format(d, "yyyy-MM-dd HH:mm:ss"))
        .when(k == 2, F.date_format(d, "MM/dd/yyyy"))
        .when(k == 3, F.lit("not a date"))
        .otherwise(F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss"))
    )
    rows = table(spark, sf, "orders").select("o_orderkey", text.alias("s"))
    return rows.withColumn("parsed", dates.lenient_date(F.col("s")).cast("string"))


@query(
    "dated_rows_only",
    """SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderkey % 5 <> 3 GROUP BY o_orderstatus""",
)
def dated_rows_only(spark, sf):
    """Rows whose date text cannot be read are dropped."""
    text = F.when(F.col("o_orderkey") % 5 == 3, F.lit("n/a")).otherwise(F.date_format("o_orderdate", "yyyy/MM/dd"))
    rows = table(spark, sf, "orders").withColumn("day", dates.lenient_date(text))
    return rows.na.drop(subset=["day"]).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query(
    "price_display",
    with_obs(f"""SELECT {', '.join(KEY)}, CASE WHEN price / 4 < 1 THEN concat(cast(floor(price / 4 * 100 + 0.5e0) as bigint), '¢')
        ELSE concat('$', printf('%.2f', {rnd('price / 4')})) END AS tag, {rnd('unit_price * 0.453592e0')} AS per_lb,
        CASE WHEN line_no = 4 THEN {rnd('price / 2.20462e0')} ELSE price END AS named_price,
        {rnd('coalesce((original_price - price) / nullif(original_price, 0) * 100, 0)')} AS savings_pct FROM obs"""),
)
def price_display(spark, sf):
    from pricelens.functions.numbers import half_up

    name = F.when(F.col("line_no") == 4, F.concat("item", F.lit(" per kg"))).otherwise(F.col("item"))
    return observations(spark, sf).select(
        *KEY, PR.price_tag(F.col("price") / 4).alias("tag"),
        half_up(PR.per_lb_of(F.col("unit_price")), 2).alias("per_lb"),
        PR.kilo_name_to_lb(F.col("price"), name).alias("named_price"),
        half_up(PR.savings_pct(F.col("price"), F.col("original_price")), 2).alias("savings_pct"),
    )


@query(
    "first_number",
    "SELECT page_id, try_cast(nullif(regexp_extract(replace(html, '$', ''), '(\\d+\\.?\\d*)', 1), '') as double) AS number FROM pages",
)
def first_number(spark, sf):
    return table(spark, sf, "pages").select("page_id", PR.first_number(F.col("html")).alias("number"))


@query(
    "deal_score",
    with_obs(f"""WITH s AS (SELECT *, 40.0e0 + CASE WHEN pct_below_avg IS NULL THEN 0 WHEN pct_below_avg > 0
          THEN least(35.0e0, pct_below_avg * 0.7e0) ELSE greatest(-25.0e0, pct_below_avg * 0.5e0) END
         + CASE WHEN is_lowest THEN 10 ELSE 0 END
         + CASE WHEN cross_store_rank IS NULL OR cross_store_count <= 1 THEN 0 WHEN cross_store_rank = 1 THEN 20
            WHEN cross_store_rank = 2 THEN 10 WHEN cross_store_rank = 3 THEN 5 ELSE -10 END
         + CASE WHEN unit_price IS NOT NULL THEN 5 ELSE 0 END + CASE WHEN is_key THEN 5 ELSE 0 END AS raw FROM obs)
        SELECT {', '.join(KEY)}, {rnd('least(100.0e0, greatest(0.0e0, raw))', 1)} AS score FROM s"""),
)
def deal_score(spark, sf):
    names = ("pct_below_avg", "is_lowest", "cross_store_rank", "cross_store_count", "unit_price", "is_key")
    return observations(spark, sf).select(*KEY, SC.deal_score(*[F.col(n) for n in names]).alias("score"))


@query(
    "tag_array",
    with_obs("""WITH t AS (SELECT list_filter([CASE WHEN is_lowest THEN 'LOWEST EVER' END,
        CASE WHEN pct_below_avg > 10 THEN concat(cast(floor(pct_below_avg) as bigint), '% below avg') END,
        CASE WHEN cross_store_rank = 1 AND cross_store_count > 1 THEN concat('Best of ', cross_store_count, ' stores') END,
        CASE WHEN is_key THEN 'Staple' END, CASE WHEN deal_score >= 80 THEN 'Hot Deal' END], lambda x: x IS NOT NULL) AS tags FROM obs),
        u AS (SELECT unnest(tags) AS tag, len(tags) AS n_tags FROM t)
        SELECT tag, cast(n_tags as bigint) AS n_tags, count(*) AS n FROM u GROUP BY tag, n_tags"""),
)
def tag_array(spark, sf):
    names = ("is_lowest", "pct_below_avg", "cross_store_rank", "cross_store_count", "is_key", "deal_score")
    tags = observations(spark, sf).select(SC.tags(*[F.col(n) for n in names]).alias("tags"))
    return (
        tags.select(F.explode("tags").alias("tag"), F.size("tags").cast("bigint").alias("n_tags"))
        .groupBy("tag", "n_tags").agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "calibration_sentence",
    with_obs("""SELECT order_no, line_no, part_no, supp_no, nullif(concat_ws(' | ',
        CASE WHEN member THEN '⭐ MEMBER EXCLUSIVE (requires membership)' END,
        CASE WHEN featured THEN concat('🎯 FEATURED ITEM (page ', coalesce(cast(nullif(line_no, 3) as varchar), 'unknown'),
         ', high visual prominence)') END,
        CASE WHEN is_lowest THEN '✅ Price validated against PDF' END), '') AS sentence FROM obs"""),
)
def calibration_sentence(spark, sf):
    page = F.nullif(F.col("line_no"), F.lit(3).cast("bigint"))
    return observations(spark, sf).select(
        *KEY, SC.calibration_sentence(F.col("member"), F.col("featured"), page, F.col("is_lowest")).alias("sentence")
    )


@query(
    "subcategory_fill",
    with_obs("SELECT category, coalesce(nullif(trim(sub_category), ''), category, 'Other') AS sub_category, count(*) AS n"
             " FROM obs GROUP BY ALL"),
)
def subcategory_fill(spark, sf):
    sub = F.coalesce(dates.blank_to_null(F.col("sub_category")), F.col("category"), F.lit("Other"))
    return observations(spark, sf).groupBy("category", sub.alias("sub_category")).agg(F.count(F.lit(1)).alias("n"))

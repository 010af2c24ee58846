"""Queries: similarity joins, clusters, enrichment and reuse of known rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricelens.catalog.q_history import TIERS, _TXT, _kws
from pricelens.catalog.q_parse import _category
from pricelens.catalog.registry import avg, has_any, query, quoted, rnd
from pricelens.catalog.tables import TIE, current_and_history, observations, table, with_obs
from pricelens.functions import vocab
from pricelens.functions.numbers import half_up
from pricelens.functions.text import keywords, needed_hits
from pricelens.operators import cluster as C
from pricelens.operators import dedupe as U
from pricelens.operators import enrich as E
from pricelens.operators import history as H
from pricelens.operators import market as M
from pricelens.operators import matching as X
from pricelens.plans.blocking import keyword_hits, keyword_links
from pricelens.plans.spelling import edit_links

KEY = ["order_no", "line_no", "part_no", "supp_no"]
CURHIST = "cur AS (SELECT * FROM obs WHERE status = 'O'), hist AS (SELECT * FROM obs WHERE status = 'F')"


@query(
    "keyword_overlap_match",
    with_obs(f"""WITH {CURHIST}, names AS (SELECT DISTINCT item, norm_name FROM cur),
        texts AS (SELECT {_TXT} AS txt, count(*) AS n FROM hist GROUP BY 1),
        k AS (SELECT DISTINCT list_sort({_kws(vocab.MATCH_SKIP_WORDS)}) AS kws FROM names)
        SELECT array_to_string(kws, ' ') AS keywords, count(*) AS n_texts, cast(sum(n) as bigint) AS n_rows FROM k JOIN texts
        ON len(list_filter(kws, lambda x: contains(txt, x))) >= greatest(2, cast(floor(len(kws) * 0.6e0) as int)) GROUP BY 1"""),
)
def keyword_overlap_match(spark, sf):
    """Matched history texts and rows of every distinct keyword set."""
    current, history = current_and_history(spark, sf, ["item", "norm_name"])
    names = current.select("item", "norm_name").distinct()
    keyed = names.select(F.array_sort(keywords(H.search_text(names))).alias("kws")).distinct()
    texts = history.groupBy(H.search_text(history).alias("txt")).agg(F.count(F.lit(1)).alias("n"))
    hits = keyword_hits(keyed, "kws", texts, "txt")
    # texts with equal hits match alike: count them before the join
    sets = texts.join(hits, "txt").groupBy("hits").agg(F.count(F.lit(1)).alias("t"), F.sum("n").alias("n"))
    links = keyword_links(keyed, "kws", hits, needed_hits)
    return links.join(sets, "hits").groupBy(F.array_join("kws", " ").alias("keywords")).agg(
        F.sum("t").alias("n_texts"), F.sum("n").alias("n_rows")
    )


@query(
    "prefix_match",
    with_obs(f"""WITH {CURHIST}, names AS (SELECT DISTINCT item FROM cur),
        h AS (SELECT lower(item) AS t, price, count(*) AS n FROM hist GROUP BY ALL),
        p AS (SELECT a.item, h.price, h.n FROM names a JOIN h ON contains(h.t, lower(substring(a.item, 1, 30))) WHERE h.price > 0)
        SELECT item, {rnd('sum(cast(floor(price * 10000.0e0 + 0.5e0) as bigint) * n) / sum(n) / 10000.0e0')} AS avg_price,
        min(price) AS min_price, max(price) AS max_price, cast(sum(n) as bigint) AS n_prices FROM p GROUP BY item HAVING sum(n) >= 2"""),
)
def prefix_match(spark, sf):
    return H.prefix_stats(*current_and_history(spark, sf)).withColumn("avg_price", half_up(F.col("avg_price"), 2))


@query(
    "exact_name_match",
    with_obs(f"""WITH {CURHIST}, h AS (SELECT norm_name, count(*) AS n FROM hist WHERE trim(norm_name) <> '' GROUP BY 1 HAVING count(*) >= 3)
        SELECT order_no, line_no, part_no, supp_no, n AS history_rows FROM cur JOIN h USING (norm_name)"""),
)
def exact_name_match(spark, sf):
    current, history = current_and_history(spark, sf)
    rows = history.groupBy("norm_name").agg(F.count(F.lit(1)).alias("history_rows")).where("history_rows >= 3")
    return current.join(rows.where("trim(norm_name) <> ''"), "norm_name").select(*KEY, "history_rows")


@query(
    "document_word_match",
    f"""SELECT w, count(*) AS n FROM (SELECT unnest([{quoted(vocab.PROTEIN_WORDS + ['the', 'en', 'q'])}]) AS w) JOIN documents
        ON contains(lower(text), w) GROUP BY w""",
)
def document_word_match(spark, sf):
    """Documents that hold each search word, over whole texts and short words too."""
    docs = table(spark, sf, "documents").select("doc_id", F.lower("text").alias("t"))
    words = spark.range(1).select(F.array(*[F.lit(w) for w in vocab.PROTEIN_WORDS + ["the", "en", "q"]]).alias("kws"))
    hits = keyword_hits(words, "kws", docs, "t", "doc_id")
    return hits.select(F.explode("hits").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))


_STORE_CONTEXT = f"""{CURHIST},
    nm AS (SELECT norm_name, store, min(price) AS p FROM cur WHERE trim(norm_name) <> '' GROUP BY ALL),
    nb AS (SELECT norm_name, min(p) AS best_price, arg_min(store, (p, store)) AS best_store, count(*) AS n_stores
       FROM nm GROUP BY 1 HAVING count(*) >= 2),
    probes AS (SELECT DISTINCT item, norm_name, price FROM cur),
    byn AS (SELECT q.*, b.best_price, b.best_store, b.n_stores,
       (SELECT CASE WHEN bool_or(m.p = q.price) THEN 1 + count(*) FILTER (m.p < q.price) END FROM nm m
        WHERE m.norm_name = q.norm_name) AS place FROM probes q JOIN nb b ON b.norm_name = q.norm_name),
    rest AS (SELECT DISTINCT p.item, p.price FROM probes p LEFT JOIN nb USING (norm_name) WHERE nb.norm_name IS NULL),
    im AS (SELECT lower(item) AS t, store, min(price) AS p FROM cur GROUP BY ALL),
    rp AS (SELECT DISTINCT lower(substring(item, 1, 30)) AS pat FROM rest),
    pm AS (SELECT pat, store, min(p) AS p FROM rp JOIN im ON contains(im.t, rp.pat) GROUP BY ALL),
    pb AS (SELECT pat, min(p) AS best_price, arg_min(store, (p, store)) AS best_store, count(*) AS n_stores
       FROM pm GROUP BY 1 HAVING count(*) >= 2),
    byp AS (SELECT r.item, r.price, b.best_price, b.best_store, b.n_stores,
       (SELECT CASE WHEN bool_or(m.p = r.price) THEN 1 + count(*) FILTER (m.p < r.price) END FROM pm m
        WHERE m.pat = b.pat) AS place FROM rest r JOIN pb b ON b.pat = lower(substring(r.item, 1, 30))),
    ctx AS (SELECT c.*, coalesce(byn.best_price, byp.best_price) AS best_price, coalesce(byn.best_store, byp.best_store) AS best_store,
       coalesce(byn.n_stores, byp.n_stores) AS n_stores, coalesce(byn.place, byn.n_stores, byp.place, byp.n_stores) AS store_rank FROM cur c
       LEFT JOIN byn ON byn.item = c.item AND byn.norm_name = c.norm_name AND byn.price = c.price
       LEFT JOIN byp ON byn.item IS NULL AND byp.item = c.item AND byp.price = c.price)"""


@query(
    "cross_store_context",
    with_obs(f"WITH {_STORE_CONTEXT} SELECT {', '.join(KEY)}, best_price, best_store, cast(n_stores as double) AS n_stores,"
             " cast(store_rank as double) AS store_rank FROM ctx"),
)
def cross_store_context(spark, sf):
    current, _ = current_and_history(spark, sf)
    rows = M.cross_store_context(current.select(*KEY, "store", "item", "norm_name", "price"))
    return rows.select(
        *KEY, "best_price", "best_store", *[F.col(c).cast("double").alias(c) for c in ("n_stores", "store_rank")]
    )


_RULES = f"""{_STORE_CONTEXT},
    hh AS (SELECT lower(item) AS t, price, count(*) AS n FROM hist WHERE price > 0 GROUP BY ALL),
    np AS (SELECT DISTINCT item FROM cur),
    hs AS (SELECT item, {rnd('sum(cast(floor(price * 10000.0e0 + 0.5e0) as bigint) * n) / sum(n) / 10000.0e0')} AS av,
       {rnd('min(price)')} AS low FROM np JOIN hh ON contains(hh.t, lower(substring(item, 1, 30))) GROUP BY item HAVING sum(n) >= 2),
    sc AS (SELECT c.*, s.av, s.low, (s.av - c.price) / s.av * 100 AS pct FROM ctx c LEFT JOIN hs s ON s.item = c.item),
    pt AS (SELECT * EXCLUDE (ai_score), cast(least(100, greatest(0, floor(40.0e0
       + CASE WHEN pct IS NULL THEN 0.0e0 WHEN pct > 0 THEN least(35.0e0, pct * 0.7e0) ELSE greatest(-25.0e0, pct * 0.5e0) END
       + CASE WHEN price <= low THEN 10.0e0 ELSE 0.0e0 END
       + CASE WHEN best_price IS NULL THEN 0.0e0 WHEN price <= best_price THEN 20.0e0 WHEN n_stores <= 1 THEN 0.0e0
          WHEN store_rank = 2 THEN 10.0e0 WHEN store_rank = 3 THEN 5.0e0 ELSE -10.0e0 END))) as bigint) AS ai_score FROM sc),
    ex AS (SELECT *, concat_ws('. ',
       CASE WHEN price <= low THEN concat('LOWEST PRICE in 6 months (usually $', printf('%.2f', av), ')')
        WHEN pct > 15 THEN concat(cast(floor(pct + 0.5e0) as bigint), '% below 6-month avg of $', printf('%.2f', av))
        WHEN pct > 0 THEN concat('Slightly below avg ($', printf('%.2f', av), ')')
        WHEN pct > -10 THEN concat('Near average ($', printf('%.2f', av), ')')
        WHEN pct IS NOT NULL THEN concat('Above average (usually $', printf('%.2f', av), ')') END,
       CASE WHEN price <= best_price THEN concat('Best price across ', n_stores, ' stores')
        WHEN best_price IS NOT NULL THEN concat('$', printf('%.2f', best_price), ' at ', best_store) END) AS why FROM pt)"""


@query(
    "enrich_by_rules",
    with_obs(f"""WITH {_RULES} SELECT {', '.join(KEY)}, ai_score,
        CASE WHEN ai_score >= 85 THEN '🔥 Hot Deal' WHEN ai_score >= 70 THEN '✅ Good Buy' WHEN ai_score >= 50 THEN '😐 Fair'
         WHEN ai_score >= 30 THEN '⚠️ Below Average' ELSE '❌ Poor Value' END AS ai_rating,
        CASE WHEN why = '' THEN 'Standard pricing (no historical data)' ELSE why END AS ai_explanation,
        {_category('lower(item)')} AS ai_category FROM ex"""),
)
def enrich_by_rules(spark, sf):
    cols = [*KEY, "store", "item", "norm_name", "price"]
    current, history = current_and_history(spark, sf, cols)
    rows = current.select(*cols)
    return E.enrich_by_rules(rows, history).select(*KEY, "ai_score", "ai_rating", "ai_explanation", "ai_category")


# --- known and new rows ----------------------------------------------------------
REUSE = ["store", "item", "price_text", "valid_until"]


@query(
    "new_vs_known",
    with_obs(f"""WITH {CURHIST}, k AS (SELECT DISTINCT store, item, price_text, valid_until FROM hist),
        m AS (SELECT c.*, k.item IS NOT NULL AS known FROM cur c LEFT JOIN k ON k.store = c.store AND k.item = c.item
        AND k.price_text = c.price_text AND k.valid_until IS NOT DISTINCT FROM c.valid_until)
        SELECT {', '.join(KEY)}, known FROM m"""),
)
def new_vs_known(spark, sf):
    current, history = current_and_history(spark, sf)
    known = U.known_rows(current, history, REUSE).select(*KEY, F.lit(True).alias("known"))
    return known.unionByName(U.unknown_rows(current, history, REUSE).select(*KEY, F.lit(False).alias("known")))


_LAST = f"""l AS (SELECT * FROM (SELECT store, item, price_text, valid_until, ai_score, category, row_number() OVER
    (PARTITION BY store, item, price_text, valid_until ORDER BY {', '.join(t + ' DESC' for t in TIE)}) AS r FROM hist) WHERE r = 1)"""


@query(
    "attach_known",
    with_obs(f"""WITH {CURHIST}, {_LAST} SELECT c.order_no, c.line_no, c.part_no, c.supp_no, l.ai_score AS known_score,
        l.category AS known_category FROM cur c LEFT JOIN l ON l.store = c.store AND l.item = c.item
        AND l.price_text = c.price_text AND l.valid_until IS NOT DISTINCT FROM c.valid_until"""),
)
def attach_known(spark, sf):
    current, history = current_and_history(spark, sf)
    archive = history.withColumnsRenamed({"ai_score": "known_score", "category": "known_category"})
    rows = current.select(*KEY, *REUSE)
    out = E.attach_known(rows, archive, REUSE, ["known_score", "known_category"], [F.col(t) for t in TIE])
    return out.select(*KEY, "known_score", "known_category")


@query(
    "incremental_enrichment",
    with_obs(f"""WITH {CURHIST}, {_LAST} SELECT c.order_no, c.line_no, c.part_no, c.supp_no,
        CASE WHEN l.item IS NOT NULL THEN l.category ELSE {_category('lower(c.item)')} END AS ai_category,
        CASE WHEN l.item IS NOT NULL THEN 'reused' ELSE 'new' END AS origin FROM cur c LEFT JOIN l ON l.store = c.store
        AND l.item = c.item AND l.price_text = c.price_text AND l.valid_until IS NOT DISTINCT FROM c.valid_until"""),
)
def incremental_enrichment(spark, sf):
    from pricelens.functions.rules import keyword_category

    current, history = current_and_history(spark, sf)
    archive = history.select(*REUSE, F.col("category").alias("ai_category"), F.lit("reused").alias("origin"),
                             *[F.col(t) for t in TIE if t not in REUSE])
    rows = current.select(*KEY, *REUSE)

    def enrich(new):
        return new.withColumns({"ai_category": keyword_category(F.col("item")), "origin": F.lit("new")})

    out = E.enrich_new_only(rows, archive, REUSE, ["ai_category", "origin"], [F.col(t) for t in TIE], enrich)
    return out.select(*KEY, "ai_category", "origin")


@query(
    "merge_results",
    """WITH r AS (SELECT doc_id, quality, toxic FROM labels QUALIFY row_number() OVER (PARTITION BY doc_id) = 1)
        SELECT d.doc_id, coalesce(r.quality, 50) AS quality, coalesce(r.toxic, -1) AS toxic FROM documents d
        LEFT JOIN r ON r.doc_id = d.doc_id""",
)
def merge_results(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    return E.merge_results(docs, table(spark, sf, "labels"), "doc_id", {"quality": 50, "toxic": -1}, [F.col("quality"), F.col("toxic")])


@query(
    "backfill_items",
    with_obs(f"SELECT {', '.join(KEY)}, {_category('lower(item)')} AS ai_category FROM obs"),
)
def backfill_items(spark, sf):
    from pricelens.functions.rules import keyword_category

    rows = observations(spark, sf).select(*KEY, "item")
    enriched = E.backfill(rows, ["item"], lambda d: d.withColumn("ai_category", keyword_category(F.col("item"))))
    return enriched.select(*KEY, "ai_category")


@query(
    "name_cache_reuse",
    with_obs(f"""WITH {CURHIST}, k AS (SELECT item, category, brand FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY
        {', '.join(TIE)}) AS r FROM hist) WHERE r = 1), n AS (SELECT DISTINCT item FROM cur)
        SELECT n.item, k.category, k.brand, k.item IS NOT NULL AS is_known FROM n LEFT JOIN k ON k.item = n.item"""),
)
def name_cache_reuse(spark, sf):
    current, history = current_and_history(spark, sf)
    names = current.select("item").distinct()
    return E.reuse_names(names, history, "item", ["category", "brand"], [F.col(t) for t in TIE])


@query(
    "unknown_names",
    with_obs(f"WITH {CURHIST} SELECT DISTINCT norm_name FROM cur WHERE norm_name NOT IN"
             " (SELECT norm_name FROM hist WHERE norm_name IS NOT NULL)"),
)
def unknown_names(spark, sf):
    current, history = current_and_history(spark, sf)
    return U.unknown_rows(current.select("norm_name").distinct(), history, ["norm_name"]).where("norm_name is not null")


@query(
    "latest_attribute",
    with_obs("""SELECT item, norm_name FROM (SELECT item, norm_name, row_number() OVER (PARTITION BY item
        ORDER BY obs_date DESC, norm_name) AS r FROM obs WHERE norm_name IS NOT NULL) WHERE r = 1"""),
)
def latest_attribute(spark, sf):
    return C.latest_value(observations(spark, sf), "item", "norm_name")


# --- document matching -----------------------------------------------------------
_DOC_NAME = (
    "CASE line_no % 3 WHEN 0 THEN item WHEN 1 THEN coalesce(norm_name, item) ELSE concat('Sale ', item) END"
)
_PAIRS = """ln AS (SELECT DISTINCT lower(item) AS l FROM cur),
    rn AS (SELECT DISTINCT lower(name) AS r FROM doc),
    lw AS (SELECT l, list_distinct(list_filter(regexp_split_to_array(l, '\\s+'), lambda w: length(w) > 3)) AS lw FROM ln),
    rw AS (SELECT r, list_distinct(list_filter(regexp_split_to_array(r, '\\s+'), lambda w: length(w) > 3)) AS rw FROM rn),
    pj AS (SELECT l, r, contains(l, r) OR contains(r, l) AS holds, len(list_intersect(lw, rw)) AS c, len(lw) AS a, len(rw) AS b
       FROM lw, rw),
    pairs AS (SELECT l, r, holds, a, b, CASE WHEN a > 0 AND b > 0 THEN c / (a + b - c) ELSE 0.0e0 END AS jac FROM pj)"""


def _best(doc_rows: str = "WHERE member", extra: dict[str, str] | None = None) -> str:
    """The match in SQL; ``extra`` are further columns of the document entries."""
    extra = extra or {}
    made = "".join(f", {e} AS {n}" for n, e in extra.items())
    own, entry, found = ("".join(f", {t}{n}" for n in extra) for t in ("", "d.", "b."))
    return f"""{CURHIST}, doc AS (SELECT store, {_DOC_NAME} AS name, price AS doc_price, order_no * 100 + line_no AS pos{made}
       FROM hist {doc_rows}), {_PAIRS},
    near AS (SELECT l, r, CASE WHEN holds THEN 0.8e0 ELSE jac * 0.6e0 END AS base FROM pairs WHERE holds OR jac >= 0.5),
    off AS (SELECT DISTINCT store, item, price FROM cur),
    d1 AS (SELECT DISTINCT store, lower(name) AS r, name, doc_price, pos{own} FROM doc),
    sc AS (SELECT o.store, o.item, o.price, d.name, d.doc_price, d.pos{entry},
       n.base + CASE WHEN o.price > 0 AND d.doc_price > 0 AND abs(o.price - d.doc_price) / o.price < 0.1 THEN 0.2e0 ELSE 0.0e0 END AS s
       FROM off o JOIN near n ON n.l = lower(o.item) JOIN d1 d ON d.store = o.store AND d.r = n.r),
    bs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY store, item, price ORDER BY s DESC, pos, name, doc_price{own}) AS k
       FROM sc WHERE s > 0.5) WHERE k = 1),
    fin AS (SELECT o.store, o.item, o.price, b.name AS doc_name, b.doc_price, {rnd('b.s')} AS confidence,
       {rnd('o.price - b.doc_price')} AS price_difference, CASE WHEN b.item IS NULL THEN 'not_in_pdf'
        WHEN abs({rnd('o.price - b.doc_price', 4)}) < 0.10 THEN 'verified' ELSE 'price_mismatch' END AS validation_status{found}
       FROM off o LEFT JOIN bs b ON b.store = o.store AND b.item = o.item AND b.price = o.price)"""


_BEST = _best()
_ENTRY = {
    "pos_in_doc": "order_no * 100 + line_no", "page": "line_no", "is_member": "member",
    "indicator": "CASE WHEN member THEN 'member price' ELSE '' END",
}


def _document_match(spark, sf):
    current, history = current_and_history(spark, sf)
    doc = history.where("member").select(
        "store", F.expr(_DOC_NAME).alias("name"), F.col("price").alias("doc_price"),
        (F.col("order_no") * 100 + F.col("line_no")).alias("pos"),
    )
    return X.best_document_match(current, doc)


@query("best_fuzzy_match", with_obs(f"WITH {_BEST} SELECT * FROM fin"))
def best_fuzzy_match(spark, sf):
    return _document_match(spark, sf)


@query("best_fuzzy_match_entry", with_obs(f"WITH {_best('', _ENTRY)} SELECT * FROM fin"))
def best_fuzzy_match_entry(spark, sf):
    """The whole history as the document; the entry's place, page and member flag come along."""
    current, history = current_and_history(spark, sf)
    doc = history.select(
        "store", F.expr(_DOC_NAME).alias("name"), F.col("price").alias("doc_price"),
        (F.col("order_no") * 100 + F.col("line_no")).alias("pos"), *[F.expr(e).alias(n) for n, e in _ENTRY.items()],
    )
    return X.best_document_match(current, doc, list(_ENTRY))


@query("match_status_counts", with_obs(f"WITH {_BEST} SELECT validation_status, count(*) AS n FROM fin GROUP BY 1"))
def match_status_counts(spark, sf):
    return X.match_status_counts(_document_match(spark, sf))


def _calibrated(words_only: bool) -> str:
    keep = (
        "CASE WHEN a = 0 OR b = 0 THEN holds ELSE jac >= 0.6 END" if words_only else "holds OR jac >= 0.5"
    )
    return f"""{CURHIST}, doc AS (SELECT store, CASE WHEN member THEN 'member' WHEN line_no % 2 = 0 THEN 'featured' ELSE 'spot' END
         AS kind, {_DOC_NAME} AS name, line_no AS page, order_no * 100 + line_no AS pos, price AS spot_price FROM hist), {_PAIRS},
      near AS (SELECT l, r FROM pairs WHERE {keep}),
      e AS (SELECT store, kind, lower(name) AS r, min((pos, page, spot_price)) AS e FROM doc GROUP BY ALL),
      o1 AS (SELECT DISTINCT store, item FROM cur),
      f AS (SELECT o.store, o.item, e.kind, min(e.e) AS e FROM o1 o JOIN near n ON n.l = lower(o.item)
         JOIN e ON e.store = o.store AND e.r = n.r GROUP BY ALL),
      g AS (SELECT store, item, max(e) FILTER (kind = 'member') AS m, max(e) FILTER (kind = 'featured') AS f,
         max(e) FILTER (kind = 'spot') AS s FROM f GROUP BY ALL),
      off AS (SELECT DISTINCT store, item, price FROM cur)
      SELECT o.store, o.item, o.price, g.m IS NOT NULL AS is_member, g.f IS NOT NULL AS is_featured,
        cast(coalesce(g.m[2], g.f[2]) as double) AS page,
        coalesce({rnd('abs(o.price - g.s[3])', 4)} < 0.10, false) AS price_validated,
        coalesce({rnd('abs(o.price - g.s[3])', 4)} > 1.00, false) AS price_mismatch
      FROM off o LEFT JOIN g ON g.store = o.store AND g.item = o.item"""


def _calibrate(spark, sf, words_only):
    current, history = current_and_history(spark, sf)
    kind = F.when(F.col("member"), "member").when(F.col("line_no") % 2 == 0, "featured").otherwise("spot")
    signals = history.select(
        "store", kind.alias("kind"), F.expr(_DOC_NAME).alias("name"), F.col("line_no").alias("page"),
        (F.col("order_no") * 100 + F.col("line_no")).alias("pos"), F.col("price").alias("spot_price"),
    )
    return X.calibrate(current, signals, words_only).withColumn("page", F.col("page").cast("double"))


@query("calibrate_signals", with_obs(f"WITH {_calibrated(False)}"))
def calibrate_signals(spark, sf):
    return _calibrate(spark, sf, False)


@query("calibrate_signals_words", with_obs(f"WITH {_calibrated(True)}"))
def calibrate_signals_words(spark, sf):
    return _calibrate(spark, sf, True)


@query(
    "name_lookup",
    with_obs(f"""WITH {CURHIST}, w AS (SELECT DISTINCT item AS l FROM cur), k AS (SELECT DISTINCT norm_name AS r FROM hist WHERE norm_name IS NOT NULL),
        lt AS (SELECT l, list_distinct(regexp_split_to_array(lower(l), '\\s+')) AS lt FROM w),
        rt AS (SELECT r, list_distinct(regexp_split_to_array(lower(r), '\\s+')) AS rt FROM k),
        s AS (SELECT l, r, length(array_to_string(list_intersect(lt, rt), '')) AS c, length(array_to_string(lt, '')) AS a,
          length(array_to_string(rt, '')) AS b FROM lt, rt),
        z AS (SELECT l, r, 100.0e0 * greatest(2 * c / (c + a), 2 * c / (c + b)) AS score FROM s WHERE c > 0)
        SELECT l AS name, r AS known_name, {rnd('score', 1)} AS score FROM (SELECT *, row_number() OVER (PARTITION BY l
        ORDER BY score DESC, r) AS k FROM z WHERE score > 60) WHERE k = 1"""),
)
def name_lookup(spark, sf):
    current, history = current_and_history(spark, sf)
    known = history.where("norm_name is not null").select(F.col("norm_name").alias("name"))
    return X.lookup_names(current.select(F.col("item").alias("name")), known)


# current names with one letter left out and one typed twice, as both engines write it
_ONCE = "concat(substr(item, 1, 1 + ascii(item) % greatest(length(item) - 2, 1)), substr(item, 3 + ascii(item) % greatest(length(item) - 2, 1)))"
_MISSPELT = "concat(substr(once, 1, 1 + length(once) % 7), substr(once, 1 + length(once) % 7))"
_TYPED = f"""t AS (SELECT DISTINCT {_MISSPELT} AS l FROM (SELECT {_ONCE} AS once FROM cur)),
        k AS (SELECT DISTINCT norm_name AS r FROM hist WHERE norm_name IS NOT NULL)"""
_LOOKED_UP = f"""{_TYPED},
        lw AS (SELECT DISTINCT l, unnest(regexp_split_to_array(lower(l), '\\s+')) AS w FROM t),
        rw AS (SELECT DISTINCT r, unnest(regexp_split_to_array(lower(r), '\\s+')) AS w FROM k),
        v AS (SELECT DISTINCT w FROM rw WHERE w <> ''), x AS (SELECT DISTINCT w FROM lw WHERE w <> '' AND w NOT IN (SELECT w FROM v)),
        y AS (SELECT x.w, v.w AS fixed, levenshtein(x.w, v.w) AS e, greatest(length(x.w), length(v.w)) AS m FROM x, v),
        f AS (SELECT w, fixed, e FROM y WHERE e <= floor(m * 0.25e0 + 1e-9)
         QUALIFY row_number() OVER (PARTITION BY w ORDER BY 1 - e / m DESC, fixed) = 1),
        c AS (SELECT l, coalesce(fixed, lw.w) AS w, min(coalesce(e, 0)) AS e FROM lw LEFT JOIN f USING (w) WHERE lw.w <> '' GROUP BY ALL),
        a AS (SELECT l, sum(length(w)) AS a FROM c GROUP BY l), b AS (SELECT r, sum(length(w)) AS b FROM rw GROUP BY r),
        s AS (SELECT l, r, sum(length(c.w) - e) AS c FROM c JOIN rw USING (w) GROUP BY l, r),
        z AS (SELECT l, r, 100.0e0 * greatest(2 * c / (c + a), 2 * c / (c + b)) AS score FROM s JOIN a USING (l) JOIN b USING (r)),
        found AS (SELECT l AS name, r AS known_name, {rnd('score', 1)} AS score FROM z WHERE score > 60
         QUALIFY row_number() OVER (PARTITION BY l ORDER BY score DESC, r) = 1)"""


def _misspelt(current):
    return current.select(F.expr(_ONCE).alias("once")).select(F.expr(_MISSPELT).alias("name"))


def _known(history):
    return history.where("norm_name is not null").select(F.col("norm_name").alias("name"))


@query("name_lookup_typos", with_obs(f"WITH {CURHIST}, {_LOOKED_UP} SELECT * FROM found"))
def name_lookup_typos(spark, sf):
    """Names with two typing errors each, found over the corrected words."""
    current, history = current_and_history(spark, sf)
    return X.lookup_names(_misspelt(current), _known(history), spelling=0.75)


@query(
    "price_seen_typos",
    with_obs(f"""WITH {CURHIST}, {_LOOKED_UP},
        p AS (SELECT norm_name AS known_name, count(*) AS times_seen, min(price) AS cheapest, {rnd(avg('price'))} AS avg_price FROM hist GROUP BY norm_name)
        SELECT name, known_name, score, times_seen, cheapest, avg_price FROM found JOIN p USING (known_name)"""),
)
def price_seen_typos(spark, sf):
    """Cheapest and mean price seen for the known name nearest to a misspelt one."""
    current, history = current_and_history(spark, sf)
    return X.seen_prices(X.lookup_names(_misspelt(current), _known(history), spelling=0.75), history)


@query(
    "name_spellings",
    with_obs(f"""WITH {CURHIST}, {_TYPED},
        y AS (SELECT l, r, levenshtein(l, r) AS e, greatest(length(l), length(r)) AS m FROM t, k
         WHERE l <> '' AND r <> '' AND abs(length(l) - length(r)) <= floor(greatest(length(l), length(r)) * (1.0e0 - 0.85e0) + 1e-9))
        SELECT l AS name, r AS known_name, e AS edits, 1 - e / m AS similarity FROM y WHERE e <= floor(m * (1.0e0 - 0.85e0) + 1e-9)"""),
)
def name_spellings(spark, sf):
    """All known names that a misspelt one may stand for, by edit similarity of the whole names."""
    current, history = current_and_history(spark, sf)
    known = _known(history).withColumnRenamed("name", "known_name")
    return edit_links(_misspelt(current), "name", known, "known_name", 0.85)


@query(
    "price_seen",
    with_obs(f"""WITH {CURHIST} SELECT norm_name, min(price) AS cheapest, {rnd(avg('price'))} AS avg_price FROM hist
        WHERE norm_name IN (SELECT norm_name FROM cur) GROUP BY norm_name"""),
)
def price_seen(spark, sf):
    """Cheapest and mean price seen for every current name."""
    from pricelens.functions.numbers import exact_avg

    current, history = current_and_history(spark, sf)
    seen = U.known_rows(history.select("norm_name", "price"), current, ["norm_name"]).where("norm_name is not null")
    return seen.groupBy("norm_name").agg(
        F.min("price").alias("cheapest"), half_up(exact_avg(F.col("price")), 2).alias("avg_price")
    )


_PAGES = {
    "feed": "p_partkey % 50", "page_pos": "p_partkey", "page": "cast(p_size as bigint)",
    "left": "cast((p_partkey * 37) % 900 as double)", "right": "cast((p_partkey * 37) % 900 + 150 + p_size as double)",
    "bottom": "cast((p_partkey * 53) % 1900 as double)", "top": "cast((p_partkey * 53) % 1900 + 200 + p_size as double)",
}
_ITEMS = {
    "feed": "l_suppkey % 50", "item_id": "concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey)",
    "left": "cast((l_orderkey * 7) % 1000 as double)", "right": "cast((l_orderkey * 7) % 1000 + 21 as double)",
    "bottom": "cast((l_partkey * 11) % 2000 as double)", "top": "cast((l_partkey * 11) % 2000 + 10 as double)",
}


def _quoted_cols(cols: dict[str, str]) -> str:
    return ", ".join(f'{e} AS "{n}"' for n, e in cols.items())


@query(
    "page_region_join",
    f"""WITH p AS (SELECT {_quoted_cols(_PAGES)} FROM part), i AS (SELECT {_quoted_cols(_ITEMS)} FROM lineitem),
        h AS (SELECT i.feed, i.item_id, arg_min(p.page, p.page_pos) AS page FROM i JOIN p ON p.feed = i.feed
         AND (i."left" + i."right") / 2 BETWEEN p."left" AND p."right" AND (i."top" + i."bottom") / 2 BETWEEN p."bottom" AND p."top" GROUP BY ALL)
        SELECT i.feed, i.item_id, cast(h.page as double) AS page FROM i LEFT JOIN h ON h.feed = i.feed AND h.item_id = i.item_id""",
)
def page_region_join(spark, sf):
    pages = table(spark, sf, "part").select(*[F.expr(e).alias(n) for n, e in _PAGES.items()])
    items = table(spark, sf, "lineitem").select(*[F.expr(e).alias(n) for n, e in _ITEMS.items()])
    return X.place_on_pages(items, pages).select("feed", "item_id", F.col("page").cast("double").alias("page"))


_MERCHANT = (
    "CASE o_custkey % 9 WHEN 0 THEN 'Sobeys Liquor' WHEN 1 THEN 'SOBEYS' WHEN 2 THEN 'Safeway Calgary' WHEN 3 THEN 'Superstore'"
    " WHEN 4 THEN 'Walmart' WHEN 5 THEN 'Corner Shop' WHEN 6 THEN 'No Frills' WHEN 7 THEN 'Co-op' ELSE 'Save-On-Foods' END"
)
_FEED_NAME = "CASE o_orderstatus WHEN 'P' THEN 'Pharmacy Flyer' ELSE concat('Weekly ', o_orderpriority) END"


@query(
    "feed_selection",
    f"""WITH f AS (SELECT o_orderkey AS feed_pos, {_MERCHANT} AS merchant, {_FEED_NAME} AS name, cast(o_orderdate as date) AS d FROM orders),
        t AS (SELECT *, CASE {' '.join(f"WHEN contains(lower(merchant), '{s.lower()}') OR contains('{s.lower()}', lower(merchant)) THEN '{s}'"
        for s in vocab.TARGET_STORES)} END AS store FROM f WHERE NOT {has_any('lower(name)', vocab.FEED_EXCLUSIONS)}
        AND NOT {has_any('lower(merchant)', vocab.FEED_EXCLUSIONS)})
        SELECT store, merchant, name, feed_pos, cast(d as varchar) AS valid_from FROM (SELECT *, row_number() OVER (PARTITION BY store
        ORDER BY d DESC, feed_pos) AS r FROM t WHERE store IS NOT NULL) WHERE r = 1""",
)
def feed_selection(spark, sf):
    heads = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("feed_pos"), F.expr(_MERCHANT).alias("merchant"), F.expr(_FEED_NAME).alias("name"),
        F.to_date("o_orderdate").alias("valid_from"),
    )
    return X.select_feeds(heads, vocab.TARGET_STORES, vocab.FEED_EXCLUSIONS).withColumn(
        "valid_from", F.col("valid_from").cast("string")
    )


# --- clusters --------------------------------------------------------------------
_VARIANT = (
    "CASE p_partkey % 4 WHEN 0 THEN concat(p_name, ' ', p_type, ' ', p_brand)"
    " WHEN 1 THEN concat(split_part(p_name, ' ', 2), ' (', split_part(p_name, ' ', 1), ') ', p_type, ', ', p_brand)"
    " WHEN 2 THEN concat('Fresh ', p_brand, ' ', p_type, ' ', p_name, ' pack')"
    " ELSE concat(p_name, ' ', p_type, ' ', p_brand, ' size', cast(p_size as varchar(10))) END"
)


def _clusters(names: str) -> str:
    """Connected groups of similar names by recursion over token-set links."""
    return f"""nm AS ({names}),
      tk AS (SELECT name, n, list_sort(list_distinct(list_filter(regexp_split_to_array(translate(lower(name), '(),', '   '), '\\s+'),
         lambda w: length(w) >= 3 AND NOT list_contains([{quoted(vocab.NAME_SKIP_WORDS)}], w)))) AS toks FROM nm),
      ks AS (SELECT DISTINCT array_to_string(toks, ' ') AS k, toks FROM tk WHERE len(toks) >= 2),
      ex AS (SELECT k, unnest(toks) AS w, len(toks) AS s FROM ks),
      ed AS (SELECT a.k AS u, b.k AS v FROM ex a JOIN ex b ON a.w = b.w AND a.k <> b.k GROUP BY a.k, b.k, a.s, b.s
         HAVING count(*) >= 2 AND count(*) / (a.s + b.s - count(*)) >= 0.75),
      reach AS (SELECT k AS node, k AS r FROM ks UNION SELECT e.v, reach.r FROM reach JOIN ed e ON e.u = reach.node),
      roots AS (SELECT node, min(r) AS root FROM reach GROUP BY node),
      cl AS (SELECT tk.name, tk.n, coalesce(roots.root, concat(chr(9), tk.name)) AS root FROM tk
         LEFT JOIN roots ON roots.node = array_to_string(tk.toks, ' ') AND len(tk.toks) >= 2),
      canon AS (SELECT name, first_value(name) OVER (PARTITION BY root ORDER BY n DESC, name) AS canonical FROM cl)"""


_VARIANTS = f"SELECT {_VARIANT} AS name, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1"


def _variant_names(spark, sf):
    lines = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    parts = table(spark, sf, "part")
    named = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return named.groupBy(F.expr(_VARIANT).alias("name")).agg(F.sum("n").alias("n"))


@query("name_clusters", f"WITH RECURSIVE {_clusters(_VARIANTS)} SELECT name, n, root AS cluster FROM cl")
def name_clusters(spark, sf):
    return C.name_clusters(_variant_names(spark, sf))


@query("canonical_name", f"WITH RECURSIVE {_clusters(_VARIANTS)} SELECT name, canonical FROM canon")
def canonical_name(spark, sf):
    return C.canonical_names(_variant_names(spark, sf))


_ONE = "SELECT item, arg_min({c}, (-epoch(obs_date), {c})) AS {c} FROM obs WHERE {c} IS NOT NULL GROUP BY item"


@query(
    "normalize_archive",
    with_obs(f"""WITH ln AS ({_ONE.format(c='norm_name')}), lc AS ({_ONE.format(c='category')}), ls AS ({_ONE.format(c='sub_category')}),
        ev AS (SELECT o.item, coalesce(ln.norm_name, o.norm_name) AS norm_name, lc.category, ls.sub_category FROM obs o
         LEFT JOIN ln ON ln.item = o.item LEFT JOIN lc ON lc.item = o.item LEFT JOIN ls ON ls.item = o.item),
        {_clusters('SELECT norm_name AS name, count(*) AS n FROM ev WHERE norm_name IS NOT NULL GROUP BY 1')}
        SELECT coalesce(c.canonical, ev.norm_name) AS norm_name, ev.category, ev.sub_category, count(*) AS n FROM ev
        LEFT JOIN canon c ON c.name = ev.norm_name GROUP BY ALL""").replace("WITH obs", "WITH RECURSIVE obs", 1),
)
def normalize_archive(spark, sf):
    rows = observations(spark, sf).select("item", "norm_name", "category", "sub_category", "obs_date")
    return C.normalize_archive(rows).groupBy("norm_name", "category", "sub_category").agg(F.count(F.lit(1)).alias("n"))


# --- set operations --------------------------------------------------------------
def _dedupe_sql(keys: str, order: str) -> str:
    return with_obs(
        f"SELECT {', '.join(KEY)}, item, price FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS r"
        " FROM obs) WHERE r = 1"
    )


_UP, _DOWN = ", ".join(TIE), ", ".join(f"{t} DESC" for t in TIE)
_OUT = [*KEY, "item", "price"]


@query("dedupe_keep_first", _dedupe_sql("store, item, price", _UP))
def dedupe_keep_first(spark, sf):
    return U.dedupe(observations(spark, sf).select(*_OUT, "store", "obs_date"), ["store", "item", "price"], [F.col(t) for t in TIE]).select(*_OUT)


@query("dedupe_keep_last", _dedupe_sql("obs_date, store, lower(trim(item)), price", _DOWN))
def dedupe_keep_last(spark, sf):
    rows = observations(spark, sf).select(*_OUT, "store", "obs_date")
    return U.dedupe(rows, U.archive_keys(), [F.col(t) for t in TIE], keep="last").select(*_OUT)


@query("dedupe_by_text", _dedupe_sql("store, item, price_text, valid_until", _UP))
def dedupe_by_text(spark, sf):
    rows = observations(spark, sf).select(*_OUT, *[c for c in REUSE if c not in _OUT], "obs_date")
    return U.dedupe(rows, REUSE, [F.col(t) for t in TIE]).select(*_OUT)


@query("dedupe_prefer_filled", _dedupe_sql("obs_date, store, item, price", f"norm_name NULLS LAST, {_UP}"))
def dedupe_prefer_filled(spark, sf):
    rows = observations(spark, sf).select(*_OUT, "store", "obs_date", "norm_name")
    order = [F.col("norm_name").asc_nulls_last(), *[F.col(t) for t in TIE]]
    return U.dedupe(rows, ["obs_date", "store", "item", "price"], order).select(*_OUT)


@query("dedupe_store_day", _dedupe_sql("store, item, obs_date", _DOWN))
def dedupe_store_day(spark, sf):
    rows = observations(spark, sf).select(*_OUT, "store", "obs_date")
    return U.dedupe(rows, ["store", "item", "obs_date"], [F.col(t) for t in TIE], keep="last").select(*_OUT)


@query(
    "removed_by_dedupe",
    with_obs("SELECT count(*) AS total, count(DISTINCT (store, item, price)) AS kept,"
             " count(*) - count(DISTINCT (store, item, price)) AS removed FROM obs"),
)
def removed_by_dedupe(spark, sf):
    df = observations(spark, sf).select("store", "item", "price", "order_no")
    return U.removed_rows(df, U.dedupe(df, ["store", "item", "price"], [F.col("order_no")]))


@query(
    "archive_append",
    with_obs(f"""WITH {CURHIST}, b AS (SELECT 0 AS a, obs_date, store, item, price, valid_from, valid_until, order_no, line_no, part_no,
         supp_no FROM hist UNION ALL SELECT 1, obs_date, store, item, price, coalesce(valid_from, obs_date),
         coalesce(valid_until, coalesce(valid_from, obs_date) + 7), order_no, line_no, part_no, supp_no FROM cur)
        SELECT {', '.join(KEY)}, cast(obs_date as varchar) AS obs_date, store, item, price, cast(valid_from as varchar) AS valid_from,
        cast(valid_until as varchar) AS valid_until FROM (SELECT *, row_number() OVER (PARTITION BY obs_date, store, lower(trim(item)),
        price ORDER BY a DESC, {', '.join(t + ' DESC' for t in KEY)}) AS r FROM b) WHERE r = 1"""),
)
def archive_append(spark, sf):
    cols = [*KEY, "obs_date", "store", "item", "price", "valid_from", "valid_until"]
    current, history = current_and_history(spark, sf)
    out = U.append_to_archive(history.select(*cols), current.select(*cols), F.col("obs_date"), [F.col(k) for k in KEY])
    return out.withColumns({c: F.col(c).cast("string") for c in ("obs_date", "valid_from", "valid_until")})


@query(
    "union_with_missing",
    with_obs(f"""WITH {CURHIST} SELECT category, brand, count(*) AS n FROM (SELECT category, brand FROM cur UNION ALL
        SELECT category, NULL FROM hist) GROUP BY ALL"""),
)
def union_with_missing(spark, sf):
    current, history = current_and_history(spark, sf)
    both = U.concat_tables(current.select("category", "brand"), history.select("category"))
    return both.groupBy("category", "brand").agg(F.count(F.lit(1)).alias("n"))

"""Exact candidate joins for substring and word-overlap matching.

Both joins work on distinct texts, never on rows, and avoid comparing all
pairs: a pair is only looked at when it shares a rare key that every true
match must share.  Keys with many texts are salted: the pattern side is
repeated once per salt and the text side is split over the salts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelens.session import cut_lineage

# a blocking key with more texts than this is split over several tasks
SPLIT = 20_000


def salts(freq: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(freq / SPLIT)).cast("int")


def salt_of(text: Column, salts: Column) -> Column:
    return F.pmod(F.xxhash64(text), salts).cast("int")


def _grams(text: Column, n: int) -> Column:
    spots = F.sequence(F.lit(1), F.length(text) - (n - 1))
    return F.when(
        F.length(text) >= n,
        F.array_distinct(F.transform(spots, lambda i: F.substring(text, i, F.lit(n)))),
    ).otherwise(F.array().cast("array<string>"))


def substring_links(
    patterns: DataFrame, pattern: str, texts: DataFrame, text: str, min_len: int = 1, within: list[str] | None = None
) -> DataFrame:
    """Distinct (within, pattern, text) rows in which the text holds the pattern.

    A text that holds a pattern holds each of its trigrams, so looking only at
    the texts with the pattern's rarest trigram loses nothing.  Patterns of one
    or two characters are their own gram (skipped when ``min_len`` is 3).
    ``within`` names columns of both sides that must agree and not be null: grams
    are counted and joined inside them, so no pair across them is ever looked at.
    """
    within = list(within or [])
    p = patterns.select(*within, F.col(pattern).alias("_p")).where(F.length("_p") >= min_len).distinct()
    t = texts.select(*within, F.col(text).alias("_t")).where(F.length("_t") > 0).distinct()
    own = F.when(F.length("_p") >= 3, _grams(F.col("_p"), 3)).otherwise(F.array("_p"))
    pattern_grams = p.select(*within, "_p", F.explode(own).alias("_g"))
    sizes = [3] if min_len >= 3 else [1, 2, 3]
    gram = [*within, "_g"]
    text_grams = t.select(*within, "_t", F.explode(F.concat(*[_grams(F.col("_t"), n) for n in sizes])).alias("_g"))
    text_grams = text_grams.join(pattern_grams.select(*gram).distinct(), gram, "left_semi")
    freq = text_grams.groupBy(*gram).agg(F.count(F.lit(1)).alias("_f"))
    # a gram no text has rules its pattern out: it is absent from freq;
    # written once, so the frequency pass is not repeated per use
    chosen = cut_lineage(
        pattern_grams.join(freq, gram, "left")
        .groupBy(*within, "_p")
        .agg(F.min(F.struct(F.coalesce("_f", F.lit(0)).alias("f"), F.col("_g").alias("g"))).alias("c"))
        .where("c.f > 0")
        .select(*within, "_p", F.col("c.g").alias("_g"), salts(F.col("c.f")).alias("_s"))
    )
    needed = chosen.select(*gram, "_s").distinct()
    left = chosen.select(*gram, "_p", F.explode(F.sequence(F.lit(0), F.col("_s") - 1)).alias("_salt"))
    right = text_grams.join(needed, gram).select(*gram, "_t", salt_of(F.col("_t"), F.col("_s")).alias("_salt"))
    return (
        left.join(right, [*gram, "_salt"])
        .where(F.contains("_t", "_p"))
        .select(*within, F.col("_p").alias(pattern), F.col("_t").alias(text))
    )


def keyword_hits(left: DataFrame, terms: str, texts: DataFrame, text: str, key: str | None = None) -> DataFrame:
    """(key, hits): the distinct terms of the left side each text holds.

    Terms hold no blank, so a term occurs in a text exactly when it occurs in
    one of the text's words: substring search runs on the two vocabularies
    only.  Texts without a hit are left out.  ``key`` names a unique column of
    ``texts``; short texts may be their own key, long ones should not, because
    the key travels with every word.  Written once, because the result feeds
    term frequencies, links and the collapse of texts with equal hits.
    """
    key = key or text
    wanted = left.select(F.explode(terms).alias("_w"))
    own = F.array_distinct(F.filter(F.split(text, r"\s+"), lambda w: F.length(w) > 0))
    rows = texts.select(key).distinct() if key == text else texts
    words = rows.select(F.col(key).alias("_key"), F.explode(own).alias("_x"))
    vocabulary = substring_links(wanted, "_w", words.select("_x"), "_x")
    return cut_lineage(
        words.join(vocabulary, "_x").groupBy(F.col("_key").alias(key)).agg(F.array_sort(F.collect_set("_w")).alias("hits"))
    )


def keyword_links(left: DataFrame, terms: str, hits: DataFrame, needed: Callable[[Column], Column]) -> DataFrame:
    """Distinct (terms, hits) pairs that share at least ``needed`` terms.

    A pair that shares ``needed`` of n terms shares one of the n - needed + 1
    rarest terms, so only those are joined, and the pair is emitted at its
    first common one.  Texts with equal hits are one hit set here.  ``needed``
    maps the terms column (a sorted, distinct array) to the hits a match takes.
    """
    sets = hits.select("hits").distinct()
    sized = (
        left.select(F.col(terms).alias("_k")).distinct()
        .withColumn("_need", needed(F.col("_k"))).where(F.col("_need") <= F.size("_k"))
    )
    posted = sets.select("hits", F.explode("hits").alias("_w"))
    freq = posted.groupBy("_w").agg(F.count(F.lit(1)).alias("_f"))
    # terms ordered by rarity; terms no text has come first
    ordered = (
        sized.select("_k", "_need", F.explode("_k").alias("_w")).join(freq, "_w", "left")
        .groupBy("_k", "_need")
        .agg(
            F.array_sort(
                F.collect_list(F.struct(F.coalesce("_f", F.lit(0)).alias("f"), F.col("_w").alias("w")))
            ).alias("o")
        )
    )
    prefixes = ordered.select("_k", "_need", F.slice("o", F.lit(1), F.size("o") - F.col("_need") + 1).alias("p"))
    keyed = cut_lineage(
        prefixes.select("_k", "_need", F.col("p.w").alias("_prefix"), F.explode("p").alias("e"))
        .where("e.f > 0")
        .select("_k", "_need", "_prefix", F.col("e.w").alias("_w"), salts(F.col("e.f")).alias("_s"))
    )
    spread = keyed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_s") - 1))).drop("_s")
    right = (
        posted.join(keyed.select("_w", "_s").distinct(), "_w")
        .select("hits", "_w", F.pmod(F.xxhash64("hits"), "_s").cast("int").alias("_salt"))
    )
    return (
        spread.join(right, ["_w", "_salt"])
        .where(F.size(F.array_intersect("_k", "hits")) >= F.col("_need"))
        .where(F.get(F.array_intersect("_prefix", "hits"), F.lit(0)) == F.col("_w"))
        .select(F.col("_k").alias(terms), "hits")
    )


def overlap_links(
    left: DataFrame, right: DataFrame, threshold: float, within: list[str] | None = None,
    min_shared: int = 1, mirrored: bool = False,
) -> DataFrame:
    """Pairs of token sets with Jaccard similarity of at least ``threshold``.

    Both sides have columns ``id`` and ``tokens`` (distinct array) plus the
    ``within`` columns that must agree.  With tokens ordered by rarity, two
    sets that reach the threshold share a token among their first
    n - ceil(threshold * n) + 1, so only these prefixes are joined.  Sizes and
    places of the token in both sets are part of the key: two sets whose first
    common token lies too late to leave enough others are never paired, and sets
    that must be equal meet by all their tokens.
    ``mirrored`` keeps one of the two orders of a self join (id < id).
    """
    within = list(within or [])
    l = left.select(*within, F.col("id").alias("l_id"), F.col("tokens").alias("l_tokens")).where(F.size("l_tokens") > 0)
    r = right.select(*within, F.col("id").alias("r_id"), F.col("tokens").alias("r_tokens")).where(F.size("r_tokens") > 0)
    freq = (
        r.select(*within, F.explode("r_tokens").alias("tok"))
        .groupBy(*within, "tok")
        .agg(F.count(F.lit(1)).alias("f"))
    )
    # the small slack keeps a product such as 0.75 * 4 from rounding up
    slack = F.lit(1e-9)

    def kept(n: Column) -> Column:
        return F.least(n - F.ceil(n * F.lit(threshold) - slack).cast("int") + 1, n)

    def needed(n: Column, m: Column) -> Column:
        """Tokens sets of these sizes must share."""
        return F.greatest(
            F.lit(min_shared), F.ceil((n + m) * F.lit(threshold / (1 + threshold)) - slack).cast("int"), F.lit(1)
        )

    def prefixed(side: DataFrame, p: str) -> DataFrame:
        """A row per set and place in its prefix, and one at place 0 for all its tokens."""
        ranked = (
            side.select("*", F.explode(f"{p}_tokens").alias("tok"))
            .join(freq, [*within, "tok"], "left")
            .groupBy(*within, f"{p}_id", f"{p}_tokens")
            .agg(F.array_sort(F.collect_list(F.struct(F.coalesce("f", F.lit(0)).alias("f"), "tok"))).alias("o"))
        )
        whole = F.struct(F.lit(0).cast("bigint").alias("f"), F.to_json("o.tok").alias("tok"))
        pre = F.slice("o", F.lit(1), kept(F.size("o")))
        return ranked.select(
            *within, f"{p}_id", f"{p}_tokens", pre.getField("tok").alias(f"{p}_pre"), F.size("o").alias(f"{p}_n"),
            F.posexplode(F.concat(F.array(whole), pre)).alias(f"{p}_at", "e"),
        ).select(
            *within, f"{p}_id", f"{p}_tokens", f"{p}_pre", f"{p}_n", f"{p}_at", F.col("e.tok").alias("tok"), salts(F.col("e.f")).alias("_s"),
        )

    n, at, m = F.col("l_n"), F.col("l_at"), F.col("r_n")
    least, most = F.ceil(n * F.lit(threshold) - slack).cast("int"), F.floor(n / F.lit(threshold) + slack).cast("int")
    sized = prefixed(l, "l").withColumn("r_n", F.explode(F.sequence(F.greatest(least, F.lit(1)), most)))
    need = needed(n, m)
    equal = (m == n) & (need == n)
    # the last place in the other set that leaves enough tokens behind it
    last = F.least(kept(m), m - need + 1)
    spots = F.when(equal, F.when(at == 0, F.array(F.lit(0)))).when(
        (at > 0) & (n - at + 1 >= need) & (last >= 1), F.sequence(F.lit(1), last)
    )
    lp = sized.withColumn("r_at", F.explode(spots))
    lp = lp.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_s") - 1))).drop("_s")
    rp = prefixed(r, "r").withColumn("_salt", salt_of(F.col("r_id"), F.col("_s"))).drop("_s")
    shared = F.size(F.array_intersect("l_tokens", "r_tokens"))
    ratio = shared / (F.size("l_tokens") + F.size("r_tokens") - shared)
    # few bytes make many pairs: the number of parts is stated, or adaptive execution would join them in one task
    key = [*within, "tok", "r_n", "r_at", "_salt"]
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = lp.repartition(parts, *key).join(rp.repartition(parts, *key), key)
    if mirrored:
        pairs = pairs.where(F.col("l_id") < F.col("r_id"))
    return (
        pairs.where((shared >= min_shared) & (ratio >= F.lit(threshold)))
        .where((F.col("l_at") == 0) | (F.get(F.array_intersect("l_pre", "r_pre"), F.lit(0)) == F.col("tok")))
        .select(*within, "l_id", "r_id", ratio.alias("jaccard"))
    )

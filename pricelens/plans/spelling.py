"""Joins by edit similarity.

The similarity of two texts is 1 - d / m with their edit distance d and the length m
of the longer one.  A pair that reaches the threshold differs in at most
k = (1 - threshold) m edits, each of which touches at most q of the padded q-grams.
With grams ordered by rarity, the first gram an alignment keeps is hence among the
first q k + 1 of both texts, and its places differ by k at most.  Only those grams
are joined; lengths and places cut the pairs before the distance is computed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelens.plans.blocking import salt_of, salts
from pricelens.session import cut_lineage

# the slack keeps a product such as 0.2 * 5 from falling below the whole number
_SLACK = 1e-9


def allowed_edits(length: Column, threshold: float) -> Column:
    """Edits a pair may differ in, from the longer text's length."""
    return F.floor(length * F.lit(1.0 - threshold) + F.lit(_SLACK)).cast("int")


def _padded_grams(text: Column, q: int) -> Column:
    padded = F.concat(F.lit("\x01" * (q - 1)), text, F.lit("\x02" * (q - 1)))
    return F.transform(
        F.sequence(F.lit(1), F.length(text) + (q - 1)),
        lambda i: F.struct(F.substring(padded, i, F.lit(q)).alias("gram"), i.alias("at")),
    )


def edit_links(
    left: DataFrame, l_text: str, right: DataFrame, r_text: str, threshold: float, q: int = 3
) -> DataFrame:
    """Distinct (l_text, r_text, edits, similarity) of all pairs that reach ``threshold``.

    Exact for every length if threshold > 1 - 1 / q.  Null and empty texts match
    nothing; equal texts match with 0 edits.  Made for names and words: a text's
    grams lie in one array.  Grams many texts share are salted.
    """
    if not 1.0 - 1.0 / q < threshold <= 1.0:
        raise ValueError(f"the threshold must be above {1.0 - 1.0 / q:.3f} for q = {q}")
    l = left.select(F.col(l_text).alias("l")).where("length(l) > 0").distinct()
    r = right.select(F.col(r_text).alias("r")).where("length(r) > 0").distinct()
    freq = cut_lineage(
        r.select(F.explode(_padded_grams(F.col("r"), q)).alias("e")).groupBy(F.col("e.gram").alias("gram")).agg(F.count(F.lit(1)).alias("f"))
    )

    def prefixed(side: DataFrame, name: str) -> DataFrame:
        """The texts' first grams by rarity: name, n, gram, at, and the gram's salts."""
        # the partner may be longer, by what the threshold leaves
        edits = F.floor(F.length(name) * F.lit((1.0 - threshold) / threshold) + F.lit(_SLACK)).cast("int")
        ordered = (
            side.select(name, F.explode(_padded_grams(F.col(name), q)).alias("e"))
            .select(name, F.col("e.gram").alias("gram"), F.col("e.at").alias("at")).join(freq, "gram", "left")
            .groupBy(name)
            .agg(F.array_sort(F.collect_list(F.struct(F.coalesce("f", F.lit(0)).alias("f"), "gram", "at"))).alias("o"))
        )
        return (
            ordered.select(name, F.length(name).alias(f"{name}_n"), F.explode(F.slice("o", F.lit(1), edits * q + 1)).alias("e"))
            .where("e.f > 0")
            .select(name, f"{name}_n", F.col("e.gram").alias("gram"), F.col("e.at").alias(f"{name}_at"), salts(F.col("e.f")).alias("_s"))
        )

    lp = prefixed(l, "l").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_s") - 1))).drop("_s")
    rp = prefixed(r, "r").withColumn("_salt", salt_of(F.col("r"), F.col("_s"))).drop("_s")
    most = allowed_edits(F.greatest("l_n", "r_n"), threshold)
    near = (F.abs(F.col("l_n") - F.col("r_n")) <= most) & (F.abs(F.col("l_at") - F.col("r_at")) <= most)
    edits = F.call_function("levenshtein", F.col("l"), F.col("r"), most)
    pairs = lp.join(rp, ["gram", "_salt"]).where(near).withColumn("edits", edits).where("edits >= 0")
    return pairs.select("l", "r", "edits", (1.0 - F.col("edits") / F.greatest("l_n", "r_n")).alias("similarity")).distinct().select(
        F.col("l").alias(l_text), F.col("r").alias(r_text), "edits", "similarity"
    )


def best_spelling(links: DataFrame, text: str, known: str) -> DataFrame:
    """The most similar known text per text; ties go to the first in order."""
    first = F.min(F.struct((-F.col("similarity")).alias("s"), F.col(known).alias("k"), F.col("edits").alias("e")))
    return links.groupBy(text).agg(first.alias("b")).select(
        text, F.col("b.k").alias(known), F.col("b.e").alias("edits"), (-F.col("b.s")).alias("similarity")
    )

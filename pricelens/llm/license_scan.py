"""License scan by diagonal voting.

Every rolling pair of words of every document is joined by hash with the
positions of the templates' word pairs.  A hit at word ``pos`` of a document and
word ``tpos`` of a template votes for the diagonal ``pos - tpos``.  A template
that stands in the document unchanged has all its votes on one diagonal; inserted
or missing words move the rest to neighbouring diagonals, which are merged and
verified by coverage and length.

The templates are a parameter of bounded size, so they are broadcast; their
words are compared with the document's in the join, so no hash collision counts.
Documents are read twice (words and hits), and only hits and one narrow row a
document are shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricelens.llm.common import ALNUM, ascii_lower, same, text_key, words
from pricelens.session import cut_lineage

#: beyond this many template words the join is left to the optimizer
BROADCAST_WORDS = 50_000


@dataclass(frozen=True)
class Template:
    """Words to look for.  ``exact`` ones must stand word by word."""

    label: str
    text: str
    exact: bool = False

    def words(self) -> list[str]:
        return self.text.split()


#: Phrases whose places are counted.
PHRASES = (
    Template("mit", "mit license", True),
    Template("apache", "apache license", True),
    Template("gpl", "general public license", True),
)

# Opening words of public license notices.
NOTICES = (
    Template("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Template("mit-notice", "released under the mit license"),
    Template("apache-2.0", "licensed under the apache license version 2 0"),
    Template("gpl-3.0", "licensed under the gnu general public license version 3"),
    Template("gpl-text", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    Template("bsd-text", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    Template("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("reserved", "all rights reserved no part of this publication may be reproduced"),
)


def template_grams(spark: SparkSession, templates: tuple[Template, ...]) -> DataFrame:
    """One row per word pair of each template: template, n_grams, exact, tpos, first, second, gram."""
    rows = []
    for i, t in enumerate(templates):
        w = t.words()
        if len(w) < 2:
            raise ValueError(f"template {t.label!r} needs two words at least")
        rows += [(i, t.label, len(w) - 1, t.exact, p, w[p], w[p + 1]) for p in range(len(w) - 1)]
    names = ("template", "label", "n_grams", "exact", "tpos", "first", "second")
    literal = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r)]) for r in rows])
    grams = spark.range(1).select(F.inline(literal)).withColumn("gram", F.xxhash64("first", "second"))
    return F.broadcast(grams) if len(rows) <= BROADCAST_WORDS else grams


def diagonals(docs: DataFrame, templates: tuple[Template, ...], id_col: str, text_col: str) -> DataFrame:
    """Votes per document, template and diagonal: doc, text_key, template, label,
    n_grams, exact, diagonal, tposes."""
    tokens = docs.select(
        F.col(id_col).alias("doc"), text_key(F.col(text_col)).alias("text_key"),
        words(ascii_lower(F.col(text_col)), ALNUM).alias("words"),
    ).select("doc", "text_key", "words", F.posexplode("words").alias("pos", "word"))
    pairs = tokens.select("doc", "text_key", "pos", "word", F.get("words", F.col("pos") + 1).alias("next"))
    pairs = pairs.withColumn("gram", F.xxhash64("word", "next"))
    grams = template_grams(docs.sparkSession, templates)
    hits = pairs.join(
        grams, (pairs["gram"] == grams["gram"]) & (pairs["word"] == grams["first"]) & (pairs["next"] == grams["second"])
    )
    return (
        hits.withColumn("diagonal", F.col("pos") - F.col("tpos"))
        .groupBy("doc", "text_key", "template", "label", "n_grams", "exact", "diagonal")
        .agg(F.collect_set("tpos").alias("tposes"))
    )


def license_spans(
    docs: DataFrame, templates: tuple[Template, ...], id_col: str = "doc_id", text_col: str = "text",
    min_coverage: float = 0.6, max_shift: int = 2, max_stretch: float = 1.5,
) -> DataFrame:
    """Verified spans: doc, text_key, label, exact, first_word, last_word, coverage.

    ``first_word`` and ``last_word`` count words from 0; an exact template's span
    starts on its diagonal.  Other templates merge diagonals at most ``max_shift``
    apart and need ``min_coverage`` of their word pairs inside a span of at most
    ``max_stretch`` times their length.  A diagonal with one vote is noise for a
    template of four pairs or more.

    Null and empty texts and texts of one word have no spans.  Repeated rows (same
    id and text) give their spans once.  Columns besides the two named are ignored.
    """
    # written once: both kinds of template read the votes
    votes = cut_lineage(diagonals(docs, templates, id_col, text_col).withColumn("votes", F.size("tposes")))
    exact = votes.where(F.col("exact") & (F.col("votes") == F.col("n_grams"))).select(
        "doc", "text_key", "label", "exact", F.col("diagonal").alias("first_word"),
        (F.col("diagonal") + F.col("n_grams")).alias("last_word"), F.lit(1.0).alias("coverage"),
    )
    loose = votes.where(~F.col("exact") & ((F.col("votes") > 1) | (F.col("n_grams") < 4)))
    line = Window.partitionBy("doc", "text_key", "template").orderBy("diagonal")
    merged = (
        loose.withColumn("gap", F.col("diagonal") - F.lag("diagonal").over(line))
        .withColumn("run", F.sum(F.when(F.col("gap") <= max_shift, 0).otherwise(1)).over(line))
        .groupBy("doc", "text_key", "template", "label", "n_grams", "exact", "run")
        .agg(
            F.size(F.array_distinct(F.flatten(F.collect_list("tposes")))).alias("seen"),
            F.min(F.col("diagonal") + F.array_min("tposes")).alias("first_word"),
            F.max(F.col("diagonal") + F.array_max("tposes") + 1).alias("last_word"),
        )
        .withColumn("coverage", F.col("seen") / F.col("n_grams"))
        .where((F.col("coverage") >= min_coverage)
               & (F.col("last_word") - F.col("first_word") < max_stretch * (F.col("n_grams") + 1)))
    )
    return exact.unionByName(merged.select(exact.columns))


def scan_licenses(
    docs: DataFrame, phrases: tuple[Template, ...] = PHRASES, notices: tuple[Template, ...] = NOTICES,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per input row: id, n_words, n_base, first_word, last_word,
    base_labels, labels, score.

    ``n_base`` counts the places of the phrases, ``first_word`` and ``last_word``
    are their smallest and largest start (null without any).  ``labels`` adds the
    notices' labels; ``score`` is the best coverage of any template, 0 if none.
    Null texts count as empty: no words, no labels.  Rows with a null id and
    repeated rows are kept, each with its own text's result.
    """
    spans = license_spans(docs, phrases + notices, id_col, text_col)
    per_doc = spans.groupBy("doc", "text_key").agg(
        F.count(F.when(F.col("exact"), 1)).alias("n_base"),
        F.min(F.when(F.col("exact"), F.col("first_word"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("exact"), F.col("first_word"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("exact"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("coverage").alias("score"),
    )
    counted = docs.select(
        F.col(id_col).alias("doc"), text_key(F.col(text_col)).alias("text_key"),
        F.size(words(ascii_lower(F.col(text_col)), ALNUM)).cast("long").alias("n_words"),
    )
    return counted.join(per_doc, same(counted, per_doc, ["doc", "text_key"]), "left").select(
        counted["doc"].alias(id_col), "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )

"""Text predicates and token sets, all as native expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricelens.functions import vocab


def _literal(term: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", term)


def contains_any(text: Column, terms: Iterable[str]) -> Column:
    """Any of the terms occurs as a substring (the caller lowers the text).

    One pattern, so the text expression appears once in the plan.
    """
    return text.rlike("|".join(_literal(t) for t in terms))


def _with(value: Column, use) -> Column:
    """``use(value)`` with the value computed once per row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _whole_words(terms: Iterable[str]) -> str:
    return r"(?U)\b(" + "|".join(_literal(t) for t in terms) + r")\b"


def word_any(text: Column, terms: Iterable[str]) -> Column:
    """Any of the terms occurs between word boundaries (Unicode letters count)."""
    return text.rlike(_whole_words(terms))


def first_word_of(text: Column, terms: Sequence[str]) -> Column:
    """First term, in list order, that occurs as a whole word; null if none.

    The terms must not overlap each other, as one scan collects them all.
    """
    found = F.regexp_extract_all(text, F.lit(_whole_words(terms)), F.lit(1))
    return F.get(F.array_intersect(F.array(*[F.lit(t) for t in terms]), found), F.lit(0))


def first_part_of(text: Column, terms: Sequence[str]) -> Column:
    """First term, in list order, that occurs as a substring; null if none."""
    listed = F.array(*[F.lit(t) for t in terms])
    return _with(text, lambda x: F.get(F.filter(listed, lambda t: F.contains(x, t)), F.lit(0)))


def word(text: Column, term: str) -> Column:
    return word_any(text, [term])


def first_rule(rules: Sequence[tuple[Column, Column]], default: Column) -> Column:
    """The value of the first rule that holds; rule order is list order."""
    chain = None
    for test, value in rules:
        chain = F.when(test, value) if chain is None else chain.when(test, value)
    return default if chain is None else chain.otherwise(default)


def lower_or_blank(value: Column) -> Column:
    return F.coalesce(F.lower(value), F.lit(""))


def is_blank(value: Column) -> Column:
    return value.isNull() | (F.trim(value) == "")


def words(text: Column, min_len: int) -> Column:
    """Distinct whitespace-separated words of at least ``min_len`` characters."""
    return F.array_distinct(F.filter(F.split(text, r"\s+"), lambda w: F.length(w) >= min_len))


def keywords(text: Column, skip: Sequence[str] = vocab.MATCH_SKIP_WORDS) -> Column:
    """Matching keywords of a text: words of 3+ characters minus filler words."""
    return F.array_except(words(F.lower(text), 3), F.array(*[F.lit(s) for s in skip]))


def name_tokens(name: Column) -> Column:
    """Token set of a product name: brackets and commas are blanks, filler is dropped."""
    return keywords(F.translate(F.lower(name), "(),", "   "), vocab.NAME_SKIP_WORDS)


def jaccard(a: Column, b: Column) -> Column:
    """Set similarity; zero as soon as one side is empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when(
        (F.size(a) > 0) & (F.size(b) > 0), shared / (F.size(a) + F.size(b) - shared)
    ).otherwise(F.lit(0.0))


def hits(terms: Column, text: Column) -> Column:
    """How many of the terms occur in the text as substrings."""
    return _with(text, lambda x: F.size(F.filter(terms, lambda t: F.contains(x, t))))


def needed_hits(terms: Column) -> Column:
    """Keyword hits a match needs: 60 % of the keywords, never fewer than two."""
    return F.greatest(F.lit(2), F.floor(F.size(terms) * F.lit(0.6)).cast("int"))


def alike(a: Column, b: Column, threshold: float = 0.5) -> Column:
    """One text holds the other, or their long words overlap enough."""
    return (
        F.contains(a, b)
        | F.contains(b, a)
        | (jaccard(words(a, 4), words(b, 4)) >= F.lit(threshold))
    )


def alike_by_words(a: Column, b: Column, threshold: float = 0.6) -> Column:
    """Word overlap decides; containment only when one side has no long word."""
    wa, wb = words(a, 4), words(b, 4)
    return F.when(
        (F.size(wa) == 0) | (F.size(wb) == 0), F.contains(a, b) | F.contains(b, a)
    ).otherwise(jaccard(wa, wb) >= F.lit(threshold))

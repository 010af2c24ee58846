"""Quality rules as a learned decision list.

The features are Column expressions.  Labelled rows are cut into a fixed grid of
feature levels and counted per cell and class, so what reaches the driver is
bounded by the grid (``levels`` to the power of the features used), not by the
rows.  Sequential covering works on these counts: grow a conjunction of threshold
tests that separates one class, prune it, remove the cells it covers, repeat.  The
list is applied as one ordered Spark conditional expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelens.llm.common import SPACED, text_key, words

_SYMBOLS = r"[#*$%&|<>]"


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """q_row (the input row as a struct, so no column name can clash), q_n_words,
    q_word_chars, q_n_symbols, q_n_dup_lines, q_n_repeat_words, q_upper and q_marks
    (all long), one row per input row.

    q_n_repeat_words counts words in three-word windows found twice or more.  The
    windows are hashed; only a text with equal hashes sorts them together with
    their places, marks the places of equal ones and adds up the words covered.
    A null text has no words: all statistics are 0.
    """
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("q_row"), F.col(text_col).alias("q_text"))
    text = F.coalesce(F.col("q_text"), F.lit(""))
    staged = rows.select(
        "*", words(F.col("q_text"), SPACED).alias("q_words"),
        F.filter(F.split(text, "\n", -1), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]"))).alias("q_lines"),
    ).select("*", F.size("q_words").alias("q_n"))
    hashes = F.transform(
        F.sequence(F.lit(0), F.col("q_n") - 3),
        lambda i: F.xxhash64(F.get(F.col("q_words"), i), F.get(F.col("q_words"), i + 1), F.get(F.col("q_words"), i + 2)),
    )
    staged = staged.select("*", F.when(F.col("q_n") >= 4, hashes).otherwise(F.array().cast("array<long>")).alias("q_hashes"))
    staged = staged.select("*", (F.size(F.array_distinct("q_hashes")) < F.size("q_hashes")).alias("q_twice"))
    placed = F.sort_array(F.transform("q_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    staged = staged.select("*", F.when(F.col("q_twice"), placed).alias("q_placed"))
    marked = F.filter(
        F.transform("q_placed", lambda x, i: F.when(
            (x["h"] == F.get(F.col("q_placed"), i - 1)["h"]) | (x["h"] == F.get(F.col("q_placed"), i + 1)["h"]), x["p"])),
        lambda p: p.isNotNull(),
    )
    covered = F.aggregate(
        F.sort_array(marked), F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("sum")),
        lambda a, p: F.struct(p.alias("last"), (a["sum"] + F.least(F.lit(3), p - a["last"])).alias("sum")),
        lambda a: a["sum"],
    )
    statistics = F.struct(
        F.col("q_n").cast("long").alias("q_n_words"),
        F.length(F.array_join("q_words", "")).cast("long").alias("q_word_chars"),
        F.regexp_count(text, F.lit(_SYMBOLS)).cast("long").alias("q_n_symbols"),
        (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long").alias("q_n_dup_lines"),
        F.when(F.col("q_twice"), covered).otherwise(F.lit(0)).cast("long").alias("q_n_repeat_words"),
        F.regexp_count(text, F.lit(r"[A-Z]")).cast("long").alias("q_upper"),
        F.regexp_count(text, F.lit(r"[!?]")).cast("long").alias("q_marks"),
    )
    # generated rather than projected: a later filter would else be pushed below and evaluate everything once more
    return staged.select("q_row", F.inline_outer(F.array(statistics)))


def base_failed(n_words: str = "q_n_words", repeated: str = "q_n_repeat_words") -> Column:
    return (F.col(n_words) < 50) | (100 * F.col(repeated) > 50 * F.col(n_words))


#: Level bounds per feature; level k holds values above bound k-1 up to bound k.
GRID: dict[str, tuple[float, ...]] = {
    "symbol_share": (0.005, 0.02, 0.05, 0.1, 0.2),
    "repeat_share": (0.02, 0.05, 0.1, 0.2, 0.3, 0.5),
    "upper_share": (0.02, 0.05, 0.1, 0.2, 0.4),
    "mark_share": (0.002, 0.01, 0.05, 0.1),
    "dup_line_share": (0.01, 0.05, 0.1, 0.3),
    "word_length": (2.0, 3.0, 4.0, 6.0, 8.0, 12.0),
}


def features() -> dict[str, Column]:
    """Ratios of the statistics; 0 where a text has no words."""
    chars, n = F.greatest(F.col("q_word_chars"), F.lit(1)), F.greatest(F.col("q_n_words"), F.lit(1))
    return {
        "symbol_share": F.col("q_n_symbols") / chars, "repeat_share": F.col("q_n_repeat_words") / n,
        "upper_share": F.col("q_upper") / chars, "mark_share": F.col("q_marks") / chars,
        "dup_line_share": F.col("q_n_dup_lines") / n, "word_length": F.col("q_word_chars") / n,
    }


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    bound: float

    def column(self) -> Column:
        value = features()[self.feature]
        return value > self.bound if self.above else value <= self.bound

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.bound:g}"


@dataclass(frozen=True)
class Rule:
    """All tests hold: the row is ``keep``."""

    tests: tuple[Test, ...]
    keep: bool
    wrong: int
    right: int

    def column(self) -> Column:
        found = F.lit(True)
        for t in self.tests:
            found = found & t.column()
        return found

    def __str__(self) -> str:
        return f"{'keep' if self.keep else 'drop'} if {' and '.join(map(str, self.tests))} ({self.right} right, {self.wrong} wrong)"


def cell_counts(labelled: DataFrame, label_col: str, grid: dict[str, tuple[float, ...]] = GRID, held: Column | None = None) -> DataFrame:
    """Rows per grid cell and class: one level column a feature, good, bad, and of
    these the rows held back for pruning (``held`` is true): held_good, held_bad."""
    value = features()
    levels = [
        sum(((value[f] > b).cast("int") for b in bounds), F.lit(0)).alias(f) for f, bounds in grid.items()
    ]
    back = F.lit(False) if held is None else held
    good, bad = F.col("label") == 1, F.col("label") == 0
    return labelled.select(F.col(label_col).alias("label"), back.alias("held"), *levels).groupBy(*grid).agg(
        F.count_if(good).alias("good"), F.count_if(bad).alias("bad"),
        F.count_if(good & F.col("held")).alias("held_good"), F.count_if(bad & F.col("held")).alias("held_bad"),
    )


def learn(
    cells: list[dict], grid: dict[str, tuple[float, ...]] = GRID, max_rules: int = 8, max_tests: int = 3,
    min_rows: int = 5, min_precision: float = 0.9,
) -> list[Rule]:
    """Decision list by sequential covering over counted cells; pure counting, so
    it depends on the labelled rows only, not on their order or number of tasks.

    Each turn looks for a rule that rejects: it is grown on the rows not held back
    and pruned on those that are (without any, on all).  Where none reaches
    ``min_precision`` on all its rows, a rule that keeps is sought instead, so that
    the exceptions it takes out let a later rule reject the rest; the order of the
    list matters.  What no rule covers is kept, so rules that keep are left out at
    the end.  Without any bad row the list is empty.  Ties go to the test named
    first in the grid, lower bounds first.
    """
    names = list(grid)
    tests = [Test(f, above, b) for f in names for b in grid[f] for above in (True, False)]
    level = {(f, b): k for f in names for k, b in enumerate(grid[f])}
    some_held = any(c.get("held_good") or c.get("held_bad") for c in cells)

    def holds(t: Test, cell: dict) -> bool:
        return (cell[t.feature] > level[t.feature, t.bound]) == t.above

    def counted(rows: list[dict], keep: bool, part: str = "all") -> tuple[int, int]:
        """Rows of the rule's class and others: all, those held back, or those to grow on."""
        out = {}
        for name in ("good", "bad"):
            whole, held = sum(c[name] for c in rows), sum(c.get("held_" + name, 0) for c in rows)
            out[name] = {"all": whole, "held": held if some_held else whole, "grow": whole - held}[part]
        return (out["good"], out["bad"]) if keep else (out["bad"], out["good"])

    def precision(hits: int, others: int) -> float:
        return (hits + 1) / (hits + others + 2)

    def grow(rest: list[dict], keep: bool) -> list[Test]:
        picked, inside = [], rest
        while len(picked) < max_tests:
            hits, others = counted(inside, keep, "grow")
            if not hits or not others:
                break
            before = math.log2(hits / (hits + others))
            best, gain = None, 1e-9
            for t in tests:
                h, o = counted([c for c in inside if holds(t, c)], keep, "grow")
                if h >= min_rows and (now := h * (math.log2(h / (h + o)) - before)) > gain:
                    best, gain = t, now
            if best is None:
                break
            picked.append(best)
            inside = [c for c in inside if holds(best, c)]
        return picked

    def prune(rest: list[dict], keep: bool, picked: list[Test]) -> list[Test]:
        """Leave out every test without which the rule is as precise on the rows held
        back and still precise enough on all."""
        inside = [c for c in rest if all(holds(t, c) for t in picked)]
        for t in list(picked):
            fewer = [x for x in picked if x != t]
            if not fewer:
                continue
            wide = [c for c in rest if all(holds(x, c) for x in fewer)]
            if precision(*counted(wide, keep)) >= min_precision and (
                precision(*counted(wide, keep, "held")) >= precision(*counted(inside, keep, "held"))
            ):
                picked, inside = fewer, wide
        return picked

    def next_rule(rest: list[dict], keep: bool) -> Rule | None:
        picked = prune(rest, keep, grow(rest, keep))
        hits, others = counted([c for c in rest if all(holds(t, c) for t in picked)], keep)
        if not picked or hits < min_rows or precision(hits, others) < min_precision:
            return None
        return Rule(tuple(picked), keep, others, hits)

    rest, rules = sorted(cells, key=lambda c: tuple(c[f] for f in names)), []
    while len(rules) < max_rules and any(c["bad"] for c in rest):
        rule = next_rule(rest, False) or next_rule(rest, True)
        if rule is None:
            break
        rules.append(rule)
        rest = [c for c in rest if not all(holds(t, c) for t in rule.tests)]
    while rules and rules[-1].keep:
        rules.pop()
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The list as one ordered conditional expression over the statistics."""
    out = F.lit(True)
    for r in reversed(rules):
        out = F.when(r.column(), F.lit(r.keep)).otherwise(out)
    return out


def fit_rules(assessed: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", **how) -> list[Rule]:
    """Learn from all labelled rows, a third of the ids (by their hash) held back for
    pruning.  ``assessed`` has the statistics; rows that the fixed limits reject
    anyway take no part.  Labels other than 0 and 1, null ids
    and ids without a document are left out; a document labelled twice counts twice."""
    known = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("q_id"), F.col(label_col).alias("q_label"))
    rows = assessed.where(~base_failed()).join(known, assessed[id_col] == known["q_id"])
    held = F.pmod(F.xxhash64("q_id"), F.lit(3)) == 0
    return learn([r.asDict() for r in cell_counts(rows, "q_label", held=held).collect()], **how)


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Narrow statistics: id, text_key and the q_ columns, one row per input row."""
    only = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    stats = with_statistics(only, "text")
    return stats.select(F.col("q_row.id").alias(id_col), text_key(F.col("q_row.text")).alias("text_key"), *(c for c in stats.columns if c != "q_row"))


def keep_good(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """Rows that pass the fixed limits and the decision list, with their columns unchanged."""
    return with_statistics(docs, text_col).where(~base_failed() & verdict(rules)).select("q_row.*")

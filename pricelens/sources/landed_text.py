"""Rows from landed text: delimited lines, JSON replies, sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelens.functions.text import first_rule
from pricelens.schema import REPLY

# fixed values: words of header lines and of section heads
HEADER_WORDS = ["ProductName", "Price/Discount", "MEMBER or REGULAR"]
SECTION_WORDS = ["MEMBER", "FEATURED", "SPOT"]


def _line_price(text: Column) -> Column:
    """Price of a line: ``q/total`` is divided, otherwise the first number."""
    clean = F.trim(F.translate(text, "$,", ""))
    parts = F.split(clean, "/")
    qty, total = (F.trim(F.get(parts, F.lit(i))) for i in (0, 1))
    count = F.when(qty.rlike(r"^[\d.]*\d[\d.]*$"), qty.try_cast("double"))
    whole = F.when(total.rlike(r"^[\d.]*\d[\d.]*$"), total.try_cast("double"))
    split = F.when((F.size(parts) == 2) & (count > 0), F.coalesce(whole, F.lit(0.0)) / F.when(count > 0, count))
    plain = F.regexp_extract(clean, r"(\d+\.?\d*)", 1).try_cast("double")
    return F.coalesce(F.when(F.contains(clean, F.lit("/")), split).otherwise(plain), F.lit(0.0))


def parse_delimited(pages: DataFrame, keep: list[str]) -> DataFrame:
    """Items of ``name | price | status`` lines.

    ``pages`` has text, page and n_pages plus the ``keep`` columns.  Header
    lines, short lines and lines without a name or price are skipped.
    """
    lines = pages.select(*keep, "page", "n_pages", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    header = F.col("line").rlike("|".join(HEADER_WORDS))
    parts = F.transform(F.split(F.trim("line"), r"\|"), lambda p: F.trim(p))
    rows = lines.where(~header).withColumn("p", parts).where(F.size("p") >= 3).select(
        *keep, "page", "n_pages", "line_no",
        F.get("p", F.lit(0)).alias("name"), F.get("p", F.lit(1)).alias("price_text"),
        F.upper(F.get("p", F.lit(2))).alias("status"),
    ).where((F.col("name") != "") & (F.col("price_text") != ""))
    member = F.contains("status", F.lit("MEMBER"))
    label = first_rule(
        [(F.contains("status", F.lit("CLUB")), F.lit("Club Price")), (F.contains("status", F.lit("MYOFFER")), F.lit("MyOffers"))],
        F.lit("Member Price"),
    )
    third = first_rule(
        [(F.col("page") == 1, F.lit("top")), (F.col("page") <= F.floor(F.col("n_pages") / 2), F.lit("middle"))],
        F.lit("bottom"),
    )
    return rows.select(
        *keep, "page", "line_no", "name", "price_text", _line_price(F.col("price_text")).alias("price_value"),
        third.alias("position"), member.alias("is_member"), F.when(member, label).alias("member_indicator"),
    )


def parse_json_reply(replies: DataFrame, keep: list[str]) -> DataFrame:
    """Rows of a JSON array reply, with or without code fences.

    ``replies`` has text and expected (item count).  A reply that cannot be
    read or has another number of entries gives one row flagged as fallback.
    """
    text = F.trim("text")
    bare = F.when(
        text.startswith("```"),
        F.regexp_replace(F.regexp_replace(text, r"^```json?\n?", ""), r"\n?```$", ""),
    ).otherwise(text)
    parsed = F.from_json(bare, REPLY)
    rows = replies.select(*keep, "expected", parsed.alias("a")).withColumn(
        "a", F.when(F.size("a") == F.col("expected"), F.col("a"))
    )
    out = rows.select(*keep, F.posexplode_outer("a").alias("pos", "r"))
    ok = F.col("r").isNotNull()

    def field(name: str, default) -> Column:
        return F.when(ok, F.coalesce(F.col(f"r.{name}"), F.lit(default)))

    return out.select(
        *keep, "pos", (~ok).alias("fallback"),
        field("category", "Other").alias("category"), field("subcategory", "General").alias("sub_category"),
        field("normalized_name", "").alias("norm_name"), field("score", 50.0).alias("score"),
        field("rating", "😐 Fair").alias("rating"), field("explanation", "").alias("explanation"),
    )


def section_after(text: Column, header: str) -> Column:
    """Lines after a header line up to the next section head, header lines left out."""
    lines = F.split(text, "\n")
    is_head = lambda line: F.contains(F.upper(line), F.lit(header))
    other_head = lambda line: (
        (F.trim(line) != "") & ~line.rlike(r"^\d") & ~F.contains(line, F.lit(":"))
        & F.upper(line).rlike("|".join(SECTION_WORDS)) & ~is_head(line)
    )
    spots = lambda test: F.filter(
        F.transform(lines, lambda line, i: F.when(test(line), i)), lambda i: i.isNotNull()
    )
    first = F.get(spots(is_head), F.lit(0))
    last = F.coalesce(
        F.get(F.filter(spots(other_head), lambda i: i > first), F.lit(0)), F.size(lines)
    )
    inside = F.filter(lines, lambda line, i: (i > first) & (i < last) & ~is_head(line))
    return F.when(first.isNotNull(), F.array_join(inside, "\n")).otherwise(F.lit(""))

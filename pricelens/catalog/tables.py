"""The driver tables seen as price observations.

Every order line is one observation: the supplier's country stands for the
store, the part for the product, the ship date for the day it was seen.  Price
texts and item texts are spelled out from the columns by expressions that read
the same in both engines, so the query and its check start from equal rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelens.session import configure, new_path

AS_OF = "2001-11-04"

_CENTS = (
    "(199 + (p_partkey * 37) % 1800 - cast(round(l_discount * 100) as bigint) * 5"
    " + l_linenumber * 3 + cast(l_quantity as bigint))"
)
_FIRST = "split_part(p_name, ' ', 1)"
_LAST = "split_part(p_name, ' ', 2)"
_ADJ = (
    f"CASE {_FIRST} WHEN 'red' THEN 'Fresh' WHEN 'old' THEN 'Non-Alcoholic' WHEN 'cold' THEN 'Frozen'"
    " WHEN 'hot' THEN 'Smoked' WHEN 'blue' THEN 'Blue Label' WHEN 'new' THEN 'New'"
    " WHEN 'small' THEN 'Mini' ELSE 'Family Size' END"
)
_NOUN = (
    f"CASE {_LAST} WHEN 'widget' THEN 'Chicken Breast' WHEN 'bolt' THEN 'Atlantic Salmon Fillet'"
    " WHEN 'gear' THEN 'Ground Beef' WHEN 'ring' THEN 'Cheddar Cheese'"
    " WHEN 'gizmo' THEN 'Dove Chocolate Bar' WHEN 'anvil' THEN 'Banana Bread'"
    " WHEN 'rod' THEN 'London Dry Gin' ELSE 'Paper Towel' END"
)
_SIZE = (
    "CASE p_partkey % 8 WHEN 0 THEN concat(' ', cast(p_size * 25 as varchar(20)), ' g')"
    " WHEN 1 THEN concat(' ', cast(p_size as varchar(20)), ' kg')"
    " WHEN 2 THEN concat(' ', cast(p_size as varchar(20)), ' x 355 ml')"
    " WHEN 3 THEN concat(' ', cast(p_size * 10 as varchar(20)), ' ml')"
    " WHEN 4 THEN concat(' ', cast(p_size as varchar(20)), ' lb')"
    " WHEN 5 THEN concat(' ', cast(p_size as varchar(20)), ' pack')"
    " WHEN 6 THEN '' ELSE concat(' ', cast(p_size as varchar(20)), ' oz') END"
)


def _amount(cents: str) -> str:
    return (
        f"concat('$', cast(({cents} - {cents} % 100) / 100 as bigint), '.',"
        f" lpad(cast({cents} % 100 as varchar(20)), 2, '0'))"
    )


_STORE = (
    "CASE n_nationkey % 8 WHEN 0 THEN 'Sobeys' WHEN 1 THEN 'Safeway' WHEN 2 THEN 'Calgary Co-op'"
    " WHEN 3 THEN 'Save-On-Foods' WHEN 4 THEN 'No Frills' WHEN 5 THEN 'Real Canadian Superstore'"
    " WHEN 6 THEN 'Walmart' ELSE 'Corner Liquor' END"
)
_CATEGORY = (
    f"CASE {_LAST} WHEN 'widget' THEN 'Poultry' WHEN 'bolt' THEN 'Seafood' WHEN 'gear' THEN 'Beef'"
    " WHEN 'ring' THEN 'Dairy & Eggs' WHEN 'gizmo' THEN 'Snacks' WHEN 'anvil' THEN 'Bakery'"
    " WHEN 'rod' THEN 'Beverages' ELSE 'Household & Personal' END"
)
_TEXT = (
    f"CASE l_linenumber % 5 WHEN 1 THEN concat({_amount(_CENTS)}, '/lb')"
    f" WHEN 2 THEN concat('2 for ', {_amount(f'({_CENTS} * 2)')})"
    f" WHEN 3 THEN concat({_amount(_CENTS)}, '/100g')"
    f" WHEN 4 THEN concat({_amount(_CENTS)}, '/kg') ELSE {_amount(_CENTS)} END"
)
_PRICE = f"({_CENTS} / 100.0e0)"
_SHELF_UNIT = (
    f"CASE p_partkey % 8 WHEN 0 THEN {_PRICE} / (p_size * 25 / 1000.0e0) WHEN 1 THEN {_PRICE} / p_size"
    f" WHEN 2 THEN {_PRICE} / (p_size * 355 / 1000.0e0) WHEN 3 THEN {_PRICE} / (p_size * 10 / 1000.0e0)"
    f" WHEN 4 THEN {_PRICE} / (p_size * 0.453592e0) WHEN 5 THEN CASE WHEN p_size >= 2 THEN {_PRICE} / p_size END"
    f" WHEN 7 THEN {_PRICE} / (p_size * 28.3495e0 / 1000.0e0) END"
)
_RAW_UNIT = (
    f"CASE l_linenumber % 5 WHEN 1 THEN {_PRICE} / 0.453592e0 WHEN 3 THEN {_PRICE} * 10 WHEN 4 THEN {_PRICE}"
    f" ELSE {_SHELF_UNIT} END"
)

# column name -> expression valid in both engines
OBS = {
    "order_no": "l_orderkey",
    "line_no": "cast(l_linenumber as bigint)",
    "part_no": "l_partkey",
    "supp_no": "l_suppkey",
    "store": _STORE,
    "item": f"concat({_ADJ}, ' ', {_NOUN}, {_SIZE})",
    "norm_name": (
        f"CASE p_type WHEN 'PROMO' THEN cast(null as varchar(100))"
        f" WHEN 'SMALL' THEN concat({_NOUN}, ' ', {_ADJ}, CASE l_linestatus WHEN 'O' THEN ' now' ELSE ' then' END)"
        f" WHEN 'LARGE' THEN concat({_NOUN}, ' ', p_brand)"
        f" ELSE concat({_NOUN}, ' ', {_ADJ}) END"
    ),
    "brand": "p_brand",
    "category": _CATEGORY,
    "sub_category": "CASE WHEN p_type = 'MEDIUM' THEN '' ELSE p_type END",
    "price": _PRICE,
    "price_text": _TEXT,
    "price_basis": (
        "CASE l_linenumber % 5 WHEN 1 THEN 'per_lb' WHEN 2 THEN 'multi_buy' WHEN 3 THEN 'per_100g'"
        " WHEN 4 THEN 'per_kg' ELSE 'each' END"
    ),
    "unit_price": f"floor(({_RAW_UNIT}) * 100.0e0 + 0.5e0) / 100.0e0",
    "unit_type": (
        "CASE WHEN l_linenumber % 5 IN (1, 3, 4) THEN '$/kg' WHEN p_partkey % 8 IN (0, 1, 4, 7) THEN '$/kg'"
        " WHEN p_partkey % 8 IN (2, 3) THEN '$/L' WHEN p_partkey % 8 = 5 AND p_size >= 2 THEN '$/each' END"
    ),
    "obs_date": "cast(l_shipdate as date)",
    "valid_from": "CASE WHEN l_returnflag = 'N' THEN cast(null as date) ELSE cast(l_shipdate as date) END",
    "valid_until": (
        "CASE l_returnflag WHEN 'A' THEN cast(cast(l_shipdate as date) + INTERVAL 7 DAYS as date)"
        " WHEN 'R' THEN cast(cast(l_shipdate as date) + INTERVAL 3 DAYS as date) ELSE cast(null as date) END"
    ),
    "status": "l_linestatus",
    # published scores of a current table
    "deal_score": "((l_orderkey * 7 + l_partkey * 13 + l_linenumber * 29 + l_suppkey * 3) % 1001) / 10.0e0",
    "ai_score": "cast((l_orderkey * 11 + l_partkey * 5 + l_linenumber * 17) % 101 as double)",
    "pct_below_avg": (
        "CASE WHEN l_returnflag = 'N' THEN cast(null as double)"
        " ELSE ((l_orderkey * 3 + l_partkey * 31 + l_suppkey * 17) % 1201 - 600) / 10.0e0 END"
    ),
    "is_lowest": "l_discount >= 0.09e0",
    "is_key": f"{_LAST} IN ('widget', 'gear', 'ring', 'anvil')",
    "cross_store_rank": "CASE WHEN l_tax < 0.015e0 THEN cast(null as bigint) ELSE 1 + l_partkey % 5 END",
    "cross_store_count": "CASE WHEN l_tax < 0.015e0 THEN cast(1 as bigint) ELSE 5 + l_suppkey % 3 END",
    "original_price": f"({_CENTS} + (l_orderkey % 7) * 50) / 100.0e0",
    "member": "l_returnflag = 'R'",
    "featured": "l_tax >= 0.07e0",
}
FROM_SQL = (
    "FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey"
    " JOIN nation ON s_nationkey = n_nationkey"
)
OBS_SQL = "obs AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in OBS.items()) + f" {FROM_SQL})"

# natural columns that order ties; equal rows are interchangeable
TIE = ["obs_date", "order_no", "line_no", "part_no", "supp_no", "price"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# texts that only a part or a supplier decides, and the cents most price columns start from:
# spelled out once under a name, so that no column repeats them
_OF_PART = {"_item": OBS["item"], "_category": _CATEGORY, "_noun": _NOUN, "_adj": _ADJ, "_last": _LAST}
_OF_LINE = {"_cents": _CENTS}


def _named(expr: str, staged: dict[str, str]) -> str:
    for name, text in staged.items():
        expr = expr.replace(text, name)
    return expr


def derive_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All observations.  Joins are left to the optimizer: it broadcasts a
    side only below the session's size threshold."""
    lines, parts, suppliers, nations = (
        table(spark, sf_dir, t) for t in ("lineitem", "part", "supplier", "nation")
    )
    cores = spark.sparkContext.defaultParallelism
    if lines.rdd.getNumPartitions() < 2 * cores:  # a small input in few files: use all cores
        lines = lines.repartition(2 * cores)
    parts = parts.select("*", *[F.expr(e).alias(n) for n, e in _OF_PART.items()])
    shops = suppliers.join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select(
        "s_suppkey", F.expr(_STORE).alias("_store")
    )
    # the store's short name first: a part's long texts are not dealt out once more with every line
    rows = lines.join(shops, F.col("l_suppkey") == F.col("s_suppkey")).join(
        parts, F.col("l_partkey") == F.col("p_partkey")
    )
    staged = {"_store": _STORE, **_OF_PART, **_OF_LINE}
    return rows.withColumns({n: F.expr(e) for n, e in _OF_LINE.items()}).select(
        *[F.expr(_named(e, staged)).alias(n) for n, e in OBS.items()]
    )


# folders of a session's landed tables, by the columns they hold
_landed: dict[tuple[str, str], dict[tuple[str, ...], str]] = {}


def observations(spark: SparkSession, sf_dir: str, columns: Sequence[str] | None = None) -> DataFrame:
    """The observation table, landed once per session.

    The operators expect a table with real columns.  Landing the spelled-out
    view gives them one: filters and column lists reach the scan, and the long
    text expressions are not copied into every rule that refers to a column.
    A query that names its ``columns`` lands only these, unless a landed table
    holds them already; every row is there in any case.
    """
    configure(spark)
    wanted = [c for c in OBS if columns is None or c in columns]
    if columns is not None and len(wanted) < len(set(columns)):
        raise ValueError(f"no observation columns: {sorted(set(columns) - set(wanted))}")
    tables = _landed.setdefault((spark.sparkContext.applicationId, sf_dir), {})
    for held in sorted(tables, key=len):
        if set(wanted) <= set(held):
            try:
                return spark.read.parquet(tables[held]).select(*wanted)
            except AnalysisException:  # the folder was cleared meanwhile
                del tables[held]
    path = new_path(spark, "observations")
    derive_observations(spark, sf_dir).select(*wanted).write.parquet(path)
    tables[tuple(wanted)] = path
    return spark.read.parquet(path)


def current_and_history(
    spark: SparkSession, sf_dir: str, columns: Sequence[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Open lines are the current offers, finished lines the archive."""
    obs = observations(spark, sf_dir, None if columns is None else [*columns, "status"])
    return obs.where("status = 'O'"), obs.where("status = 'F'")


def with_obs(sql: str) -> str:
    """Put the observation view in front of a check query."""
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {OBS_SQL}, {body[5:]}"
    return f"WITH {OBS_SQL} {body}"

"""Price text and package size parsing as staged projections.

Each parser first projects its regex captures and then the typed result, so a
capture is computed once per row however often the result refers to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelens.functions.numbers import half_up, money, whole
from pricelens.functions.vocab import GRAMS_PER_OZ, GRAMS_PER_OZ_SHORT, KG_PER_LB, LB_PER_KG

# fixed values: price and size patterns
AMOUNT = r"(\d+\.?\d*)"
SIZE = r"(\d+(?:\.\d+)?)"
PER_LB = r"\$?" + AMOUNT + r"\s*/\s*lb"
PER_KG = r"\$?" + AMOUNT + r"\s*/\s*kg"
PER_100G = r"\$?" + AMOUNT + r"\s*/\s*100\s*g"
MULTI_BUY = r"(\d+)\s*(?:for|/)\s*\$?" + AMOUNT
SIGNED_NUMBER = r"([-+]?(?:\d*\.\d+|\d+))"
LEGACY_WEIGHT = SIZE + r"\s*(?:/|per)\s*(lb|lbs|kg|100g|g)"
LEGACY_MULTI = r"(\d+)\s*(?:/|for)\s*\$?" + SIZE
PACKS = r"(\d+)\s*x\s*" + SIZE + r"\s*(g|ml|l|oz)\b"
KILOS = SIZE + r"\s*kg\b"
GRAMS = SIZE + r"\s*g\b"
POUNDS = SIZE + r"\s*(?:lb|lbs)\b"
OUNCES = SIZE + r"\s*oz\b"
LITRES = SIZE + r"\s*l\b"
MILLILITRES = SIZE + r"\s*ml\b"
COUNTS = r"(\d+)\s*(?:'s|-pack|pack|count|ct|pk)\b"
# signs and letters that no text of a numeric zero has: such a text is not cast, a failed cast is slow
NO_ZERO = r"[$/¢%,:;g-oq-wyzG-OQ-WYZ]"
PRICE_KEYS = ["price", "current_price", "price_text", "sale_price", "original_price"]


def number_in(text: Column, pattern: str, group: int = 1) -> Column:
    """A captured number as DOUBLE, null when the pattern does not occur."""
    # without an occurrence there is no text to cast: a failed cast costs more than the search
    return F.get(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(0)).try_cast("double")


def first_filled(*candidates: Column) -> Column:
    """First candidate that is neither null, empty nor a numeric zero."""
    return F.coalesce(
        *[
            F.when((c != "") & (c.rlike(NO_ZERO) | ~F.coalesce(c.try_cast("double") == 0, F.lit(False))), c)
            for c in candidates
        ]
    )


def first_number(text: Column) -> Column:
    """First unsigned number of a text without its dollar signs."""
    # texts may be long pages: the search ends at the first number
    return F.regexp_extract(F.replace(text, F.lit("$"), F.lit("")), AMOUNT, 1).try_cast("double")


def parse_prices(df: DataFrame, raw: str = "raw_price") -> DataFrame:
    """Add ``price``, ``price_text`` and ``price_basis`` parsed from a price text.

    Rules in order: per pound, per kilo, per 100 g, multi-buy, first signed
    number.  A text without digits keeps its text and gets a null price.
    """
    text = F.lower(F.trim(F.col(raw)))
    staged = df.withColumns(
        {
            "_lb": number_in(text, PER_LB),
            "_kg": number_in(text, PER_KG),
            "_hg": number_in(text, PER_100G),
            "_qty": number_in(text, MULTI_BUY, 1),
            "_total": number_in(text, MULTI_BUY, 2),
            "_any": number_in(text, SIGNED_NUMBER),
        }
    )
    bought = F.col("_qty") > 0
    rules = [
        (F.col("_lb").isNotNull(), F.col("_lb"), "per_lb"),
        (F.col("_kg").isNotNull(), F.col("_kg"), "per_kg"),
        (F.col("_hg").isNotNull(), F.col("_hg"), "per_100g"),
        (bought, half_up(F.col("_total") / F.when(bought, F.col("_qty")), 2), "multi_buy"),
        (F.col("_any").isNotNull(), F.col("_any"), "each"),
    ]
    parsed = F.struct(
        F.coalesce(*[F.when(test, value) for test, value, _ in rules]).alias("price"),
        F.when(F.col(raw) != "", F.col(raw)).alias("price_text"),
        F.coalesce(*[F.when(test, F.lit(basis)) for test, _, basis in rules]).alias("price_basis"),
    )
    # generated columns: a filter on the price stays above the parser instead of repeating its patterns
    return staged.select(*df.columns, F.inline(F.array(parsed)))


def parse_prices_legacy(df: DataFrame, raw: str = "raw_price") -> DataFrame:
    """Older price rules: add ``price``, ``per_kg`` and ``per_kg_text``.

    Weight prices are normalised to a kilo, multi-buys are not rounded.
    """
    text = F.trim(F.lower(F.translate(F.col(raw), "$¢", "")))
    staged = df.withColumns(
        {
            "_weight": number_in(text, LEGACY_WEIGHT),
            "_unit": F.regexp_extract(text, LEGACY_WEIGHT, 2),
            "_qty": number_in(text, LEGACY_MULTI, 1),
            "_total": number_in(text, LEGACY_MULTI, 2),
            "_any": number_in(text, SIGNED_NUMBER),
        }
    )
    factor = (
        F.when(F.col("_unit") == "lb", F.lit(LB_PER_KG))
        .when(F.col("_unit") == "100g", F.lit(10.0))
        .when(F.col("_unit") == "g", F.lit(1000.0))
        .otherwise(F.lit(1.0))
    )
    bought = F.col("_qty") > 0
    price = F.coalesce(
        F.col("_weight"), F.when(bought, F.col("_total") / F.when(bought, F.col("_qty"))), F.col("_any")
    )
    per_kg = F.when(F.col("_weight").isNotNull(), half_up(F.col("_weight") * factor, 2))
    return staged.select(
        *df.columns,
        price.alias("price"),
        per_kg.alias("per_kg"),
        F.concat(money(per_kg), F.lit("/kg")).alias("per_kg_text"),
    )


def _size_captures(text: Column) -> dict[str, Column]:
    return {
        "_packs": number_in(text, PACKS, 1),
        "_each": number_in(text, PACKS, 2),
        "_pack_unit": F.regexp_extract(text, PACKS, 3),
        "_kg": number_in(text, KILOS),
        "_g": number_in(text, GRAMS),
        "_lb": number_in(text, POUNDS),
        "_oz": number_in(text, OUNCES),
        "_l": number_in(text, LITRES),
        "_ml": number_in(text, MILLILITRES),
        "_n": number_in(text, COUNTS),
    }


def _amount(test: Column, size: Column, unit: str, base: Column) -> Column:
    """One size rule: comparable size, unit label and base-unit amount."""
    return F.when(
        test,
        F.struct(size.alias("size"), F.lit(unit).alias("unit_type"), base.alias("qty")),
    )


def add_unit_prices(
    df: DataFrame, item: str = "item", price: str = "price",
    price_text: str = "price_text", basis: str = "price_basis",
) -> DataFrame:
    """Add ``unit_price``, ``unit_type`` and ``qty_equiv``.

    The parsed basis decides first, then weight marks in the price text, then
    the package size in the item text.  A size of zero falls to the next rule.
    """
    text = F.lower(F.col(item))
    mark = F.lower(F.trim(F.col(price_text)))
    staged = df.withColumns({**_size_captures(text), "_mark": mark})
    total = F.col("_packs") * F.col("_each")
    packed = total > 0
    unit = F.col("_pack_unit")
    kilo, litre, piece = "$/kg", "$/L", "$/each"
    sizes = F.coalesce(
        _amount(packed & (unit == "g"), total / 1000, kilo, total),
        _amount(packed & (unit == "ml"), total / 1000, litre, total),
        _amount(packed & (unit == "l"), total, litre, total * 1000),
        _amount(packed & (unit == "oz"), total * GRAMS_PER_OZ / 1000, kilo, total * GRAMS_PER_OZ),
        _amount(F.col("_kg") > 0, F.col("_kg"), kilo, F.col("_kg") * 1000),
        _amount(F.col("_g") > 0, F.col("_g") / 1000, kilo, F.col("_g")),
        _amount(F.col("_lb") > 0, F.col("_lb") * KG_PER_LB, kilo, F.col("_lb") * KG_PER_LB * 1000),
        _amount(F.col("_oz") > 0, F.col("_oz") * GRAMS_PER_OZ / 1000, kilo, F.col("_oz") * GRAMS_PER_OZ),
        _amount(F.col("_l") > 0, F.col("_l"), litre, F.col("_l") * 1000),
        _amount(F.col("_ml") > 0, F.col("_ml") / 1000, litre, F.col("_ml")),
        _amount(F.col("_n") >= 2, F.col("_n"), piece, F.col("_n")),
    )
    p, b, m = F.col(price), F.col(basis), F.col("_mark")
    per_kg = F.coalesce(
        F.when(b == "per_lb", p / KG_PER_LB),
        F.when(b == "per_kg", p),
        F.when(b == "per_100g", p * 10),
        F.when(m.contains("/lb") | m.contains("per lb"), p / KG_PER_LB),
        F.when(m.contains("/kg") | m.contains("per kg"), p),
        F.when(m.contains("/100") & m.contains("g"), p * 10),
    )
    staged = staged.withColumns({"_per_kg": per_kg, "_size": sizes})
    by_size = F.col("_per_kg").isNull() & (p > 0)
    return staged.select(
        *df.columns,
        F.when(p > 0, half_up(F.coalesce(F.col("_per_kg"), p / F.col("_size.size")), 2)).alias("unit_price"),
        F.when(p > 0, F.coalesce(F.when(F.col("_per_kg").isNotNull(), F.lit(kilo)), F.col("_size.unit_type")))
        .alias("unit_type"),
        F.when(by_size, F.col("_size.qty")).alias("qty_equiv"),
    )


def add_sizes(df: DataFrame, item: str = "item", price: str = "price") -> DataFrame:
    """Add package size columns: quantity, unit, grams, multipack and size price."""
    staged = df.withColumns(_size_captures(F.lower(F.col(item))))
    total = F.col("_packs") * F.col("_each")
    pack = F.col("_packs").isNotNull()
    unit = F.col("_pack_unit")
    pack_grams = (
        F.when(unit.isin("g", "ml"), total)
        .when(unit == "l", total * 1000)
        .otherwise(total * GRAMS_PER_OZ_SHORT)
    )
    kg, g, litre, ml = (F.col(c) for c in ("_kg", "_g", "_l", "_ml"))
    value = F.when(pack, total).otherwise(F.coalesce(kg, g, litre, ml))
    label = F.when(pack, unit).otherwise(
        F.coalesce(*[F.when(c.isNotNull(), F.lit(n)) for c, n in ((kg, "kg"), (g, "g"), (litre, "L"), (ml, "ml"))])
    )
    grams = F.when(pack, pack_grams).otherwise(F.coalesce(kg * 1000, g, litre * 1000, ml))
    sized = staged.select(
        *df.columns,
        value.alias("quantity_value"),
        label.alias("quantity_unit"),
        grams.alias("grams"),
        pack.alias("is_multipack"),
        F.when(pack, F.col("_packs").cast("bigint")).otherwise(F.lit(1).cast("bigint")).alias("pack_count"),
    )
    priced = (F.col(price) != 0) & (F.col("grams") > 0)
    return sized.withColumn(
        "size_price", F.when(priced, F.col(price) / (F.when(F.col("grams") > 0, F.col("grams")) / 1000))
    )


def per_lb_of(unit_price_per_kg: Column) -> Column:
    return unit_price_per_kg * KG_PER_LB


def kilo_name_to_lb(price: Column, name: Column) -> Column:
    """Prices of items named per kilo are shown per pound."""
    lowered = F.lower(name)
    return F.when(
        lowered.contains("/kg") | lowered.contains("per kg"), half_up(price / LB_PER_KG, 2)
    ).otherwise(price)


def savings_pct(price: Column, original: Column) -> Column:
    """Discount against the original price in percent, zero when unknown."""
    pct = (original - price) / F.nullif(original, F.lit(0.0)) * 100
    return F.coalesce(pct, F.lit(0.0))


def price_tag(price: Column) -> Column:
    """Shelf text: cents below a dollar, dollars otherwise."""
    return F.when(price < 1, F.concat(whole(price * 100), F.lit("¢"))).otherwise(money(price))

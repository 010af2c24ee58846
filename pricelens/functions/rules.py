"""Rule classifiers over item texts; list order is rule priority."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricelens.functions import vocab
from pricelens.functions.text import contains_any, first_part_of, first_rule, first_word_of, word, word_any


def is_excluded_drink(item: Column) -> Column:
    """Alcoholic drink: whitelisted texts pass, then whole words, then phrases."""
    text = F.lower(item)
    return ~contains_any(text, vocab.DRINK_WHITELIST) & (
        word_any(text, vocab.DRINK_KEYWORDS) | contains_any(text, vocab.DRINK_PHRASES)
    )


def names_any(value: Column, terms) -> Column:
    """Null-safe, case-blind substring test (merchant and feed exclusions)."""
    return F.coalesce(contains_any(F.lower(value), terms), F.lit(False))


def is_key_item(item: Column) -> Column:
    return names_any(item, vocab.KEY_ITEMS)


def is_raw_protein(item: Column, category: Column) -> Column:
    """Protein category and no word of prepared meat."""
    return F.coalesce(
        category.isin(vocab.REPORT_PROTEINS) & ~contains_any(F.lower(item), vocab.PREPARED_WORDS),
        F.lit(False),
    )


def food_verdict(item: Column, category: Column) -> Column:
    """Struct (is_food, reason): category, ambiguous brand, brand, keyword, food."""
    text, group = F.lower(item), F.lower(category)

    def verdict(food: bool, reason) -> Column:
        why = reason if isinstance(reason, Column) else F.lit(reason)
        return F.struct(F.lit(food).alias("is_food"), why.alias("reason"))

    non_food_group = F.coalesce(contains_any(group, vocab.NON_FOOD_CATEGORY_WORDS), F.lit(False))
    rules = [
        (non_food_group & contains_any(text, vocab.BABY_FOOD_WORDS), verdict(True, "baby_food")),
        (non_food_group, verdict(False, F.concat(F.lit("category:"), category))),
    ]
    for brand, other, food in vocab.AMBIGUOUS_BRANDS:
        named = word(text, brand)
        rules += [
            (named & contains_any(text, other), verdict(False, f"ambiguous_brand:{brand}->nonfood")),
            (named & contains_any(text, food), verdict(True, f"ambiguous_brand:{brand}->food")),
            (named, verdict(False, f"ambiguous_brand:{brand}->default")),
        ]
    kinds = {b: kind for kind, brands in vocab.NON_FOOD_BRANDS.items() for b in brands}
    kind_of = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    brand, part = first_word_of(text, list(kinds)), first_part_of(text, vocab.NON_FOOD_WORDS)
    kind = kind_of[brand]
    rules += [
        (
            brand.isNotNull(),
            F.struct(
                (kind == "baby_food").alias("is_food"),
                F.concat(F.lit("brand:"), brand, F.lit("->"), kind).alias("reason"),
            ),
        ),
        (part.isNotNull(), verdict(False, F.concat(F.lit("keyword:"), part))),
    ]
    return first_rule(rules, verdict(True, "default:food"))


def keyword_category(item: Column) -> Column:
    """Category by keyword: sausages first, then the categories in fixed order."""
    text = F.lower(item)
    rules = [
        (contains_any(text, vocab.POULTRY_SAUSAGE), F.lit("Poultry")),
        (contains_any(text, vocab.PORK_SAUSAGE) | text.contains("sausage"), F.lit("Pork")),
    ]
    rules += [(word_any(text, terms), F.lit(name)) for name, terms in vocab.CATEGORY_WORDS.items()]
    return first_rule(rules, F.lit("Other"))


def is_counter_price(store: Column, item: Column, price: Column, basis: Column) -> Column:
    """A bare counter price that is really a price per 100 g."""
    text = F.lower(F.trim(item))
    in_range = F.lit(False)
    # one expression per price cap
    for cap in sorted({c for _, c in vocab.COUNTER_PATTERNS}):
        any_of = "|".join(f"(?:{p})" for p, c in vocab.COUNTER_PATTERNS if c == cap)
        in_range = in_range | (text.rlike(any_of) & price.between(vocab.COUNTER_MIN_PRICE, cap))
    bare = ~(
        contains_any(text, vocab.COUNTER_BRANDS)
        | contains_any(text, vocab.COUNTER_TERMS)
        | text.rlike(vocab.PACKAGE_WEIGHT)
    )
    unlabelled = basis.isNull() | basis.isin("", "each")
    return F.coalesce(store.isin(vocab.COUNTER_STORES) & unlabelled & bare & in_range, F.lit(False))


def product_type(item: Column, grams: Column, is_multipack: Column, pack_count: Column) -> Column:
    """snack, single_serve, family, bulk or unknown by words, pack and size."""
    text = F.lower(item)
    per_pack = grams / F.nullif(pack_count, F.lit(0))
    rules = [
        (contains_any(text, vocab.SNACK_WORDS), F.lit("snack")),
        (contains_any(text, vocab.FAMILY_WORDS), F.lit("family")),
        (is_multipack & (grams != 0) & (per_pack <= 150), F.lit("snack")),
        (is_multipack, F.lit("family")),
        (grams.isNull(), F.lit("unknown")),
    ]
    rules += [(grams <= top, F.lit(label)) for top, label in vocab.SIZE_BANDS]
    return first_rule(rules, F.lit("bulk"))


def display_category(category: Column) -> Column:
    """Coarse shopper category of a source category, else Other."""
    trimmed = F.trim(category)
    return first_rule(
        [(trimmed.isin(names), F.lit(shown)) for shown, names in vocab.DISPLAY_CATEGORIES.items()],
        F.lit("Other"),
    )


def known_category(category: Column) -> Column:
    """Clamp a category to the closed taxonomy."""
    return F.when(category.isin(list(vocab.TAXONOMY)), category).otherwise(F.lit("Other"))


def short_store(store: Column) -> Column:
    return first_rule(
        [(store == name, F.lit(short)) for name, short in vocab.STORE_SHORT_NAMES.items()], store
    )


def store_of_file(file_name: Column) -> Column:
    """Store named by a document file name; the first pattern that occurs wins."""
    text = F.lower(file_name)
    return first_rule(
        [(text.contains(p), F.lit(s)) for p, s in vocab.FILE_NAME_STORES], F.lit(None).cast("string")
    )

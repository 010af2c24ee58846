"""Schemas of landed feeds and of the observation tables."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _D, _DAY = T.StringType(), T.DoubleType(), T.DateType()


def _fields(spec: dict[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in spec.items()])


# prices land as string or number: read both as text
FEED_ITEM = _fields(
    {
        "name": _S, "price": _S, "current_price": _S, "price_text": _S, "sale_price": _S, "original_price": _S,
        "valid_to": _S, "image_url": _S,
    }
)
FEED = _fields(
    {
        "id": T.LongType(), "merchant": _S, "name": _S, "valid_from": _S, "valid_to": _S,
        "items": T.ArrayType(FEED_ITEM), "spread_items": T.ArrayType(FEED_ITEM), "products": T.ArrayType(FEED_ITEM),
    }
)
OBSERVATION = _fields(
    {
        "obs_date": _DAY, "store": _S, "item": _S, "price": _D, "price_text": _S, "price_basis": _S, "unit_price": _D,
        "unit_type": _S, "valid_from": _DAY, "valid_until": _DAY, "norm_name": _S, "category": _S, "sub_category": _S,
    }
)
REPLY = T.ArrayType(
    _fields(
        {"category": _S, "subcategory": _S, "normalized_name": _S, "score": _D, "rating": _S, "explanation": _S}
    )
)

"""Record id rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the id rules.
OFFSET = 50_000_000
SMALL_ID_LIMIT = 1_000_000
ID_DIGITS = 8
PAD_DIGIT = "5"
SCALAR_LIMIT = 1000


def normalize_id(raw: Column, rule: str = "threshold", from_template: Column | None = None) -> Column:
    raw = raw.cast("bigint")
    if rule == "threshold":
        return F.when(raw < SMALL_ID_LIMIT, raw + OFFSET).otherwise(raw)
    if rule == "envelope":
        return F.when(from_template, raw + OFFSET).otherwise(raw)
    raise ValueError(f"unknown id rule {rule!r}")


def pad_id_8(raw: Column, guard: bool = True) -> Column:
    """Prefix short ids with 5 and zeros up to eight digits."""
    text = raw.cast("string")
    zeros = F.greatest(F.lit(ID_DIGITS - 1) - F.length(text), F.lit(0))
    padded = F.concat(F.lit(PAD_DIGIT), F.repeat(F.lit("0"), zeros), text).cast("bigint")
    return F.when(F.length(text) < ID_DIGITS, padded).otherwise(raw.cast("bigint")) if guard else padded


def fix_id(raw: Column) -> Column:
    """Strip leading 5s of over-long ids until eight digits remain."""
    text = raw.cast("string")
    leading = F.length(F.regexp_extract(text, f"^({PAD_DIGIT}*)", 1))
    strip = F.greatest(F.least(leading, F.length(text) - ID_DIGITS), F.lit(0))
    return F.substr(text, strip + 1).cast("bigint")


def is_entity_id(value: Column, limit: int = SCALAR_LIMIT) -> Column:
    """Ids up to ``limit`` in a result list are stray scalars."""
    return value > limit

"""Numeric views of text values and value tests, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The numeric view of a text value and the pattern of a leading number.
NUMERIC_TYPE = "decimal(30,15)"
LEADING_NUMBER = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"
TOLERANCE = 1e-3


def to_decimal(value: Column, mode: str = "strict") -> Column:
    """``strict``: whole text must be a number, else NULL.  ``prefix``: leading
    number, else NULL.  ``mysql``: leading number, else 0 for any non-null text."""
    if mode == "strict":
        return value.try_cast(NUMERIC_TYPE)
    prefix = F.nullif(F.regexp_extract(value, LEADING_NUMBER, 1), F.lit("")).try_cast(NUMERIC_TYPE)
    if mode == "prefix":
        return prefix
    if mode == "mysql":
        return F.when(value.isNotNull(), F.coalesce(prefix, F.lit(0).cast(NUMERIC_TYPE)))
    raise ValueError(f"unknown numeric mode {mode!r}")


def any_part(value: Column, test) -> Column:
    """Test every part of a ``a|b`` merged value; true when one part passes."""
    return F.exists(F.split(value, r"\|"), test)


def compare(left: Column, op: Column | str, right: Column) -> Column:
    """Comparison whose operator may itself be a column."""
    if isinstance(op, str):
        return {
            ">": left > right, ">=": left >= right, "<": left < right, "<=": left <= right,
            "=": left == right, "!=": left != right, "<>": left != right,
        }[op]
    return (
        F.when(op == ">", left > right)
        .when(op == ">=", left >= right)
        .when(op == "<", left < right)
        .when(op == "<=", left <= right)
        .when(op == "=", left == right)
        .when(op.isin("!=", "<>"), left != right)
    )


def non_empty(value: Column) -> Column:
    return value.isNotNull() & (value != "")


LIST_MARK = "\x1f"  # between the items of an IN list

# value test per condition kind; ``num`` is the numeric view of CAST conditions, ``bare``
# the one used where text is compared with a number without CAST
TESTS = {
    "num": lambda value, num, bare, op, lo, hi, text: compare(num(), op, lo),
    "between": lambda value, num, bare, op, lo, hi, text: num().between(lo, hi),
    "str": lambda value, num, bare, op, lo, hi, text: compare(value, op, text),
    "like": lambda value, num, bare, op, lo, hi, text: F.like(value, text),
    "not_like": lambda value, num, bare, op, lo, hi, text: ~F.like(value, text),
    "bare": lambda value, num, bare, op, lo, hi, text: compare(bare(), op, lo),
    "bare_between": lambda value, num, bare, op, lo, hi, text: bare().between(lo, hi),
    "non_empty": lambda value, num, bare, op, lo, hi, text: value != "",
    "not_null": lambda value, num, bare, op, lo, hi, text: value.isNotNull(),
    "empty": lambda value, num, bare, op, lo, hi, text: value == "",
    "is_null": lambda value, num, bare, op, lo, hi, text: value.isNull(),
    "not_between": lambda value, num, bare, op, lo, hi, text: ~num().between(lo, hi),
    "not_bare_between": lambda value, num, bare, op, lo, hi, text: ~bare().between(lo, hi),
    "in": lambda value, num, bare, op, lo, hi, text: F.array_contains(F.split(text, LIST_MARK), value),
    "not_in": lambda value, num, bare, op, lo, hi, text: ~F.array_contains(F.split(text, LIST_MARK), value),
    "any": lambda value, num, bare, op, lo, hi, text: F.lit(True),
}


def condition_holds(value: Column, kind: Column | str, op: Column | str, lo: Column, hi: Column, text: Column,
                    mode: str = "strict", bare_mode: str = "mysql", numbers: tuple[Column, Column] | None = None) -> Column:
    """Does one condition hold for one value?  A literal ``kind`` gives its test
    alone; a column of kinds chooses among the same tests per row, and only the
    chosen test reads the value as a number.  ``numbers`` are the two views where they are read already."""
    num, bare = (lambda: numbers[0] if numbers else to_decimal(value, mode)), (lambda: numbers[1] if numbers else to_decimal(value, bare_mode))
    arguments = (value, num, bare, op, lo, hi, text)
    if isinstance(kind, str):
        return F.coalesce(TESTS[kind](*arguments), F.lit(False))
    chosen = None
    for name, build in TESTS.items():
        chosen = F.when(kind == name, build(*arguments)) if chosen is None else chosen.when(kind == name, build(*arguments))
    return F.coalesce(chosen, F.lit(False))


def near(a: Column, b: Column, tol: float = TOLERANCE) -> Column:
    """Numeric equality within a tolerance; exact text equality where either
    side is not a number."""
    x, y = a.cast("string").try_cast("double"), b.cast("string").try_cast("double")
    return F.coalesce(F.abs(x - y) < tol, a.cast("string") == b.cast("string"))


def satisfies(value: Column, op: Column, a: Column, b: Column, tol: float = TOLERANCE) -> Column:
    """true / false, or NULL where the value is not a number."""
    v = value.try_cast("double")
    return (
        F.when(v.isNull(), F.lit(None).cast("boolean"))
        .when(op == "BETWEEN", (v >= a) & (v <= b))
        .when(op == ">", v > a)
        .when(op == "<", v < a)
        .when(op == ">=", v >= a)
        .when(op == "<=", v <= a)
        .when(op == "=", F.abs(v - a) < tol)
        .when(op == "!=", F.abs(v - a) > tol)
    )


def num_or_text(value: Column) -> tuple[Column, Column]:
    """(number, text): exactly one is set; NULL input gives an empty text."""
    number = value.try_cast("double")
    return number, F.when(number.isNull(), F.coalesce(value, F.lit("")))


def json_scalar(value: Column, kind: str) -> Column:
    """Text of one result scalar as it appears in a JSON result list."""
    if kind == "decimal":
        whole = value == F.floor(value)
        return F.when(whole, value.cast("decimal(38,0)").cast("string")).otherwise(
            value.cast("double").cast("string"))
    if kind == "bytes":
        return F.decode(value, "UTF-8")
    if kind == "datetime":
        has_fraction = F.date_format(value, "SSSSSS") != "000000"
        return F.when(has_fraction, F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).otherwise(
            F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss"))
    return value.cast("string")


def flatten_result(columns: list[Column]) -> Column:
    """One result column stays as it is, as text; several become the text of a list."""
    texts = [c.cast("string") for c in columns]
    return texts[0] if len(texts) == 1 else F.concat(F.lit("["), F.concat_ws(",", *[F.coalesce(t, F.lit("null")) for t in texts]), F.lit("]"))


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.when(whole > 0, F.format_string(f"%.{digits}f%%", part * 100.0 / whole)).otherwise(F.lit("N/A"))

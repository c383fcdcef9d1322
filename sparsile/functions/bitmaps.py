"""Property-id bitmaps as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: width of the property bitmap.
WIDTH = 1024


def _marks(ids: Column, done) -> Column:
    """Text that ends at the highest id: each id adds the zeros up to it and a '1',
    so the text length is the next free position."""
    return F.aggregate(F.sort_array(F.array_distinct(ids)), F.lit(""),
                       lambda text, i: F.concat(text, F.repeat(F.lit("0"), i - F.octet_length(text)), F.lit("1")), done)


def bitmap(ids: Column, width: int = WIDTH) -> Column:
    """'0/1' text, character i is '1' when id i is present; other ids ignored."""
    return _marks(F.filter(ids, lambda i: (i >= 0) & (i < width)), lambda text: F.concat(text, F.repeat(F.lit("0"), width - F.octet_length(text))))


def legacy_bitmap(ids: Column, empty: str = "0") -> Column:
    """Variable length, highest id first."""
    return F.when(F.size(ids) == 0, F.lit(empty)).otherwise(_marks(ids, F.reverse))


def ids_to_bitmap(text: Column, width: int = WIDTH) -> Column:
    ids = F.transform(F.regexp_extract_all(text, F.lit(r"(\d+)"), 1), lambda x: x.try_cast("int"))
    return bitmap(ids, width)


def bitmap_to_ids(bits: Column, width: int = WIDTH) -> Column:
    return F.filter(F.sequence(F.lit(0), F.lit(width - 1)),
                    lambda i: F.substring(bits, i + 1, F.lit(1)) == "1")

"""From leaves to the entity and value tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparsile.functions.bitmaps import WIDTH, bitmap, legacy_bitmap
from sparsile.operators.leaves import LOWER, UPPER, _entries

# Column widths of the relational store, for callers that cut.
VALUE_WIDTH, TITLE_WIDTH, PARTY_WIDTH = 2000, 200, 100
DEFAULT_ROLE = "result"


def cut(text: Column, width: int | None) -> Column:
    return text if width is None else F.substring(text, 1, width)


def property_name(name: Column, property_id: Column) -> Column:
    return F.coalesce(name, property_id.cast("string"))


def map_fields(leaves: DataFrame, dictionary: DataFrame, properties: DataFrame, width: int | None = None) -> DataFrame:
    """Attach property id and name; fields without an id are dropped.

    The dictionaries carry no broadcast hint: Catalyst and AQE broadcast them
    while they are under the size threshold and shuffle otherwise.
    """
    known = leaves.join(dictionary.filter("property_id IS NOT NULL"), "field")
    named = known.join(properties.select("property_id", F.col("property_name").alias("_name")), "property_id", "left")
    return named.withColumn("property_name", property_name(F.col("_name"), F.col("property_id"))).withColumn(
        "value", cut(F.col("value"), width)).drop("_name")


def classify_roles(values: DataFrame, roles: DataFrame) -> DataFrame:
    """Role of each (title, property); ``result`` where none is given."""
    return values.join(roles, ["title", "property_id"], "left").withColumn(
        "role", F.coalesce("role", F.lit(DEFAULT_ROLE)))


def role_bitmap(values: DataFrame, layout: str = "fixed", keys: list[str] | None = None) -> DataFrame:
    """object / operate / result bitmaps per entity, in one aggregate.  The id
    sets are bounded by the property dimension."""
    keys = keys or ["data_id"]
    sets = [F.collect_set(F.when(F.col("role") == r, F.col("property_id"))).alias(r) for r in ("object", "operate", "result")]
    ids = values.groupBy(*keys).agg(*sets)
    draw = {"fixed": bitmap, "legacy": legacy_bitmap, "legacy_blank": lambda c: legacy_bitmap(c, "")}[layout]
    return ids.select(*keys, *[draw(F.col(r)).alias(r) for r in ("object", "operate", "result")])


def ids_outside_bitmap(values: DataFrame, width: int = WIDTH) -> DataFrame:
    """(property_id, n) of value rows whose id the fixed bitmap cannot hold."""
    return values.filter((F.col("property_id") < 0) | (F.col("property_id") >= width)).groupBy("property_id").agg(F.count(F.lit(1)).alias("n"))


def merge_values(values: DataFrame, keys: list[str], sep: str = "|", order: str = "leaf_pos") -> DataFrame:
    """Values of one (record, property) joined in encounter order, first name
    kept.  A group is part of one source record."""
    parts = F.array_sort(F.collect_list(F.struct(order, "value")))
    return values.groupBy(*keys, "property_id").agg(
        F.min_by("property_name", order).alias("property_name"),
        F.array_join(F.transform(parts, lambda p: p["value"]), sep).alias("value"))


def split_merged(value: Column) -> Column:
    return F.split(value, r"\|")


def entities_with_values(records: DataFrame, values: DataFrame, key: str) -> DataFrame:
    return records.join(values.select(key), key, "left_semi")


def split_null_ids(records: DataFrame, id_col: str = "raw_id") -> tuple[DataFrame, DataFrame]:
    """Records with an id, and the count of those without."""
    return (records.filter(F.col(id_col).isNotNull()),
            records.agg(F.count_if(F.col(id_col).isNull()).alias("skipped")))


def range_rows(records: DataFrame, dictionary: DataFrame, properties: DataFrame, keys: list[str],
               json_col: str = "data", width: int | None = None) -> DataFrame:
    """Alternative load: range bounds become rows named ``name_lb`` / ``name_ub``;
    other objects and lists stay as JSON text."""
    entries = records.select(*keys, F.explode_outer(F.expr(_entries(f"`{json_col}`"))).alias("e")).select(
        *keys, F.col("e.k").alias("field"), F.col("e.v").alias("text"), F.col("e.t").alias("kind")).filter("kind != 'n'")
    bound = lambda b: F.struct(F.lit(f"_{b}").alias("suffix"), F.get_json_object("text", f"$.{b}").alias("value"))
    names = F.map_keys(F.from_json("text", "map<string,string>"))
    is_range = (F.col("kind") == "o") & F.arrays_overlap(names, F.array(F.lit(LOWER), F.lit(UPPER)))
    pieces = F.when(is_range, F.filter(F.array(bound(LOWER), bound(UPPER)), lambda p: p["value"].isNotNull())).otherwise(
        F.array(F.struct(F.lit("").alias("suffix"), F.col("text").alias("value"))))
    rows = entries.select(*keys, "field", F.explode(pieces).alias("p"))
    known = rows.join(dictionary, "field").join(properties, "property_id", "left")
    return known.select(*keys, "property_id",
                        F.concat(property_name(F.col("property_name"), F.col("property_id")), F.col("p.suffix")).alias("property_name"),
                        cut(F.col("p.value"), width).alias("value"))


def unpivot_to_eav(wide: DataFrame, data_id: Column, columns: dict[int, tuple[str, Column]]) -> DataFrame:
    """Wide rows to value rows; NULL cells produce no row.  One scan, no shuffle."""
    cells = F.array(*[F.struct(F.lit(pid).alias("property_id"), F.lit(name).alias("property_name"),
                               cell.cast("string").alias("value")) for pid, (name, cell) in columns.items()])
    return wide.select(data_id.cast("bigint").alias("data_id"), F.explode(cells).alias("c")).select(
        "data_id", "c.*").filter("value IS NOT NULL")


def pivot_wide(values: DataFrame, property_ids: list[int]) -> DataFrame:
    """Sparse matrix: one row per entity, one column per listed property."""
    return values.filter(F.col("property_id").isin(property_ids)).groupBy("data_id").pivot(
        "property_id", property_ids).agg(F.max("value"))


def refresh_denormalized(values: DataFrame, properties: DataFrame) -> DataFrame:
    """Value rows whose copied property name is stale, with the current name."""
    current = properties.select("property_id", F.col("property_name").alias("_current"))
    joined = values.join(current, "property_id", "left")
    return joined.withColumn("changed", ~F.col("property_name").eqNullSafe(F.coalesce("_current", "property_name"))).withColumn(
        "property_name", F.coalesce("_current", "property_name")).drop("_current")

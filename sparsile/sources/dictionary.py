"""Field, role and term dictionaries kept as JSON objects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROLES = ("object", "operate", "result")


def dictionary_rows(texts: DataFrame, column: str = "value") -> DataFrame:
    """JSON objects ``{name: id|null}`` to (field, property_id), nulls dropped.
    Field names keep their blanks, since they must match the documents."""
    return texts.select(F.explode(F.from_json(column, "map<string,string>")).alias("field", "raw")).select(
        "field", F.col("raw").try_cast("int").alias("property_id")).filter("property_id IS NOT NULL")


def load_dictionary(spark: SparkSession, path: str) -> DataFrame:
    return dictionary_rows(spark.read.text(path, wholetext=True))


def dict_override(base: DataFrame, extra: DataFrame) -> DataFrame:
    """Late additions win over the base dictionary."""
    return base.alias("b").join(extra.alias("x"), "field", "full_outer").select(
        "field", F.coalesce("x.property_id", "b.property_id").alias("property_id"))


def role_rows(texts: DataFrame, column: str = "value") -> DataFrame:
    """``{title: {object:[ids], operate:[ids], result:[ids]}}`` to rows; where a
    title lists a property under several roles the later role wins."""
    entry = "struct<object:array<int>,operate:array<int>,result:array<int>>"
    titles = texts.select(F.explode(F.from_json(column, f"map<string,{entry}>")).alias("title", "entry"))

    def listed(rank: int, role: str):
        ids = F.coalesce(F.col(f"entry.{role}"), F.array().cast("array<int>"))
        return F.transform(ids, lambda p: F.struct(p.alias("property_id"), F.lit(rank).alias("rank"), F.lit(role).alias("role")))

    lists = F.concat(*[listed(i, r) for i, r in enumerate(ROLES)])
    rows = titles.select("title", F.explode(lists).alias("r")).select("title", "r.*")
    return rows.groupBy("title", "property_id").agg(F.max_by("role", "rank").alias("role"))


def load_roles(spark: SparkSession, path: str) -> DataFrame:
    return role_rows(spark.read.text(path, wholetext=True))

"""Attach source records to result ids; overrides and snapshots by key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparsile.functions.numeric import num_or_text


def needed_ids(results: DataFrame) -> DataFrame:
    """Distinct ids needed by any sample."""
    return results.select("data_id").distinct()


def needed_records(records: DataFrame, results: DataFrame, key: str = "data_id") -> DataFrame:
    return records.join(needed_ids(results).select(F.col("data_id").alias(key)), key, "left_semi")


def missing_ids(results: DataFrame, records: DataFrame, key: str = "data_id") -> DataFrame:
    return needed_ids(results).join(records.select(F.col(key).alias("data_id")), "data_id", "left_anti").orderBy("data_id")


def found_ids(needed: DataFrame, records: DataFrame) -> DataFrame:
    return needed.select("data_id").intersect(records.select("data_id"))


def except_ids(needed: DataFrame, records: DataFrame) -> DataFrame:
    return needed.select("data_id").subtract(records.select("data_id"))


def attach_records(results: DataFrame, records: DataFrame, missing: str = "null") -> DataFrame:
    """(sample_id, pos, data_id) with the record columns of each id, in result
    order.  The output stays one row per result id: a sample of any size is never
    gathered in one task, and AQE splits an id that many samples share."""
    return results.join(records, "data_id", {"null": "left", "skip": "inner"}[missing])


def tiered_lookup(needed: DataFrame, tiers: list[tuple[str, DataFrame]], record: str = "record") -> DataFrame:
    """First tier that holds an id wins: (data_id, tier, record).

    Every tier is cut to the needed ids, then the lowest rank is taken by an
    aggregate, so tiers are read once and nothing is looked up per id."""
    ids = needed.select("data_id").distinct()
    ranked = [t.select("data_id", F.lit(i).alias("_rank"), F.lit(name).alias("tier"), record).join(ids, "data_id", "left_semi")
              for i, (name, t) in enumerate(tiers)]
    union = reduce(DataFrame.unionByName, ranked)
    best = F.min_by(F.struct("tier", record), F.col("_rank")).alias("_best")
    return union.groupBy("data_id").agg(best).select("data_id", "_best.*")


def overlay(tables: list[DataFrame], key: str) -> DataFrame:
    """Union of lookups where a later table wins."""
    ranked = [t.withColumn("_rank", F.lit(i)) for i, t in enumerate(tables)]
    rest = [c for c in tables[0].columns if c != key]
    return reduce(DataFrame.unionByName, ranked).groupBy(key).agg(
        F.max_by(F.struct(*rest), "_rank").alias("_row")).select(key, "_row.*")


def first_wins(records: DataFrame, key: str, order: list[str]) -> DataFrame:
    rest = [c for c in records.columns if c != key]
    return records.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(key, "_row.*")


def last_wins(records: DataFrame, key: str, order: list[str]) -> DataFrame:
    rest = [c for c in records.columns if c != key]
    return records.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(key, "_row.*")


def override_samples(base: DataFrame, patch: DataFrame, columns: list[str], key: str = "sample_id") -> DataFrame:
    """Patched columns replace the base where the patch has a value."""
    renamed = patch.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = base.join(renamed, key, "left")
    for c in columns:
        joined = joined.withColumn(c, F.coalesce(f"_new_{c}", c)).drop(f"_new_{c}")
    return joined


def unknown_patches(base: DataFrame, patch: DataFrame, key: str = "sample_id") -> DataFrame:
    return patch.join(base.select(key), key, "left_anti")


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys of both versions with an ``unchanged`` flag; one-sided keys are skipped."""
    same = reduce(lambda a, b: a & b, [F.trim(F.col(f"o.{c}")).eqNullSafe(F.trim(F.col(f"n.{c}"))) for c in columns])
    return old.alias("o").join(new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}")).select(
        F.col(f"o.{key}").alias(key), same.alias("unchanged"))


def entity_records(entities: DataFrame, values: DataFrame) -> DataFrame:
    """{data_id, title, data: map(property name → number or text)} per entity.

    Names are made unique per entity first (last row wins), which also bounds a
    map by the property dimension.  Values keep both views: ``number`` where the
    text parses, ``text`` otherwise."""
    order = [c for c in ("value_id", "property_id") if c in values.columns]
    unique = values.groupBy("data_id", "property_name").agg(F.max_by(F.coalesce("value", F.lit("")), F.struct(*order)).alias("value"))
    number, text = num_or_text(F.col("value"))
    maps = unique.groupBy("data_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(
        F.col("property_name").alias("key"), F.struct(number.alias("number"), text.alias("text")).alias("value"))))).alias("data"))
    return entities.select("data_id", "title").join(maps, "data_id")


def result_positions(results: DataFrame, n: int) -> DataFrame:
    """First ``n`` ids of every sample in ascending order: a per-sample top-n
    (the window keeps n rows per group and task before the shuffle)."""
    from pyspark.sql import Window as W

    return results.withColumn("pos", F.row_number().over(W.partitionBy("sample_id").orderBy("data_id"))).filter(F.col("pos") <= n)


def attach_status(sizes: DataFrame, attached: DataFrame) -> DataFrame:
    """full / partial / empty per sample from attached rows with a ``found`` flag."""
    per = attached.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("found").alias("n_found"))
    joined = sizes.select("sample_id").join(per, "sample_id", "left")
    status = F.when(F.coalesce("n", F.lit(0)) == 0, "empty").when(F.col("n") == F.col("n_found"), "full").otherwise("partial")
    return joined.select("sample_id", status.alias("status"))

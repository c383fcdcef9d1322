"""The full sparsity profile as one long report (section, name, value)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparsile.functions.sqltext import property_ids
from sparsile.operators import aggregates as A
from sparsile.operators.retrieval import result_sizes
from sparsile.session import durable
from sparsile.sizing import local_copy


def _long(df: DataFrame, section: str, columns: list[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(F.lit(section).alias("section"), F.explode(cells).alias("c")).select("section", "c.*")


def _histogram(df: DataFrame, col: str, bins: str, section: str, weight: str | None = None) -> DataFrame:
    return A.histogram(df, col, bins, weight).select(F.lit(section).alias("section"), F.col("bin").alias("name"), F.col("n").cast("double").alias("value"))


def sparsity_report(entities: DataFrame, properties: DataFrame, values: DataFrame, samples: DataFrame,
                    results: DataFrame) -> DataFrame:
    """Counts, density, distributions, histograms, low coverage, workload coverage
    and result sizes.  Values are read once; the profile they leave behind has one
    row per property and per property count."""
    stats = ["mean", "median", "min", "max"]
    profile = A.profile_counts(values)
    profile = local_copy(profile) or durable(profile, "profile")
    per_entity = profile.filter("kind = 'entity'")
    covered = profile.filter("kind = 'property'").select(F.col("key").cast("int").alias("property_id"), F.col("n").alias("entity_count"))
    coverage = properties.select("property_id").distinct().join(covered, "property_id", "left").select(
        "property_id", F.coalesce("entity_count", F.lit(0)).cast("bigint").alias("entity_count"))
    n_entities = entities.agg(F.count_distinct("data_id")).scalar()
    cells = F.col("num_entities") * F.col("num_properties")
    counts = coverage.agg(F.count(F.lit(1)).cast("double").alias("num_properties"), F.sum("entity_count").cast("double").alias("num_pairs")).withColumn(
        "num_entities", n_entities.cast("double")).withColumn("density", F.when(cells > 0, F.col("num_pairs") / cells).otherwise(0.0))
    sizes = durable(result_sizes(samples, results).groupBy("n_result").agg(F.count(F.lit(1)).alias("n")), "sizes")
    used = samples.select(F.explode(property_ids(F.col("sql"), with_in=False)).alias("property_id"))
    parts = [
        _long(counts, "counts", ["num_entities", "num_properties", "num_pairs", "density"]),
        _long(A.weighted_summary(per_entity), "properties_per_entity", stats),
        _histogram(per_entity, "key", "properties_per_entity", "properties_per_entity_histogram", "n"),
        _long(A.summary(coverage, "entity_count"), "entities_per_property", stats),
        _long(A.summary(coverage.filter("entity_count > 0"), "entity_count"), "covered_entities_per_property", stats),
        _histogram(coverage, "entity_count", "entities_per_property", "entities_per_property_histogram"),
        _long(coverage.agg(*[F.count_if(F.col("entity_count") <= t).alias(f"<={t}") for t in A.LOW_COVERAGE]), "low_coverage",
              [f"<={t}" for t in A.LOW_COVERAGE]),
        A.query_property_coverage(used, coverage).select(
            F.lit("query_property_coverage").alias("section"), F.col("property_id").cast("string").alias("name"), F.col("entity_count").cast("double").alias("value")),
        _long(A.weighted_summary(sizes, "n_result"), "result_size", stats),
        _histogram(sizes, "n_result", "result_size", "result_size_histogram", "n"),
    ]
    return reduce(DataFrame.unionByName, parts)

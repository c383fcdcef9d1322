"""Sparsity and coverage aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparsile.operators.nulls import join_null_safe
from sparsile.operators.numbering import exact_percentiles

# The published bin sets, as (name, lowest, highest) of whole numbers.
TOP = (1 << 62)
BINS = {
    "properties_per_entity": (("0", 0, 0), ("1-2", 1, 2), ("3-5", 3, 5), ("6-10", 6, 10), (">10", 11, TOP)),
    "entities_per_property": (("0", 0, 0), ("1", 1, 1), ("2-5", 2, 5), ("6-20", 6, 20), ("21-100", 21, 100), (">100", 101, TOP)),
    "result_size": (("0", 0, 0), ("1", 1, 1), ("2-5", 2, 5), ("6-20", 6, 20), ("21-100", 21, 100), (">100", 101, TOP)),
    "quality": (("0", 0, 0), ("1-5", 1, 5), ("6-50", 6, 50), ("51-200", 51, 200), ("201-500", 201, 500), ("500+", 501, TOP)),
    "workload": (("0", 0, 0), ("1", 1, 1), ("2-5", 2, 5), ("6-10", 6, 10), ("11-50", 11, 50), ("51-200", 51, 200), ("201+", 201, TOP)),
}
LOW_COVERAGE = (1, 5, 10)


def distinct_pairs(values: DataFrame) -> DataFrame:
    return values.select("data_id", "property_id").distinct()


def distinct_counts(values: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct entities, properties and pairs.  The exact form makes pairs
    distinct once and sums them per entity, instead of expanding every row three times."""
    if approximate:
        return values.agg(F.approx_count_distinct("data_id").alias("entities"), F.approx_count_distinct("property_id").alias("properties"),
                          F.approx_count_distinct(F.struct("data_id", "property_id")).alias("pairs"))
    properties = values.agg(F.count_distinct("property_id")).scalar()
    per_entity = distinct_pairs(values).groupBy("data_id").agg(F.count(F.lit(1)).alias("n"))
    return per_entity.agg(F.count(F.lit(1)).alias("entities"), F.coalesce(F.sum("n"), F.lit(0)).alias("pairs")).select(
        "entities", properties.alias("properties"), "pairs")


def properties_per_entity(values: DataFrame) -> DataFrame:
    return values.groupBy("data_id").agg(F.count_distinct("property_id").alias("property_count"))


def property_coverage(properties: DataFrame, values: DataFrame) -> DataFrame:
    """Distinct entities per property; properties without values show 0.

    Pairs are made distinct on both keys first (even partitions), then counted
    per property with map-side partial counts, so a hot property stays cheap."""
    counts = distinct_pairs(values).groupBy("property_id").agg(F.count(F.lit(1)).alias("entity_count"))
    return properties.select("property_id").distinct().join(counts, "property_id", "left").select(
        "property_id", F.coalesce("entity_count", F.lit(0)).cast("bigint").alias("entity_count"))


def by_coverage(coverage: DataFrame) -> DataFrame:
    return coverage.orderBy(F.desc("entity_count"), "property_id")


def density(entities: DataFrame, properties: DataFrame, values: DataFrame) -> DataFrame:
    pairs = distinct_pairs(values).agg(F.count(F.lit(1))).scalar()
    n_properties = properties.agg(F.count_distinct("property_id")).scalar()
    base = entities.agg(F.count_distinct("data_id").alias("num_entities")).select(
        "num_entities", n_properties.alias("num_properties"), pairs.alias("num_pairs"))
    cells = F.col("num_entities").cast("double") * F.col("num_properties")
    return base.withColumn("density", F.when(cells > 0, F.col("num_pairs") / cells).otherwise(F.lit(0.0)))


def profile_counts(values: DataFrame) -> DataFrame:
    """Both sparsity distributions in one pass: (kind, key, n).

    ``entity``: n entities have key properties.  ``property``: n entities have
    property key.  Values are shuffled once by entity into property-id sets
    (bounded by the property dimension, combined map-side); what follows is as
    small as the property dimension.
    """
    sets = values.groupBy("data_id").agg(F.collect_set("property_id").alias("ids"))
    cell = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.cast("bigint").alias("key"))
    cells = F.concat(F.array(cell("entity", F.size("ids"))), F.transform("ids", lambda p: cell("property", p)))
    return sets.select(F.explode(cells).alias("c")).groupBy("c.kind", "c.key").agg(F.count(F.lit(1)).alias("n"))


def weighted_summary(counts: DataFrame, key: str = "key", n: str = "n") -> DataFrame:
    """Mean, median, min and max of a value that occurs n times; 0 when empty."""
    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    return counts.agg(zero(F.sum(F.col(key) * F.col(n)) / F.sum(n)).alias("mean"), zero(F.percentile(key, F.lit(0.5), F.col(n))).alias("median"),
                      zero(F.min(key)).alias("min"), zero(F.max(key)).alias("max"))


def summary(df: DataFrame, col: str, by: list[str] | None = None) -> DataFrame:
    """Mean, median, min and max, 0 for an empty input."""
    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    return df.groupBy(*(by or [])).agg(
        zero(F.avg(col)).alias("mean"), zero(F.median(col)).alias("median"), zero(F.min(col)).alias("min"), zero(F.max(col)).alias("max"))


def runtime_summary(df: DataFrame, col: str, by: list[str], max_below: int = 0) -> DataFrame:
    """Count, mean, median, min, max, p95 (continuous percentile; the maximum for groups of fewer than
    ``max_below`` values, off by default)."""
    middle = exact_percentiles(df.withColumn(col, F.col(col).cast("double")), col, by, {"median_ms": 0.5, "_p95": 0.95})
    rest = df.groupBy(*by).agg(F.count(col).alias("n"), F.avg(col).alias("mean_ms"), F.min(col).alias("min_ms"), F.max(col).alias("max_ms"))
    return join_null_safe(rest, middle, by, "left").select(*by, "n", "mean_ms", "median_ms", "min_ms", "max_ms", F.when(F.col("n") < max_below, F.col("max_ms")).otherwise(F.col("_p95")).alias("p95_ms"))


def histogram(df: DataFrame, col: str, bins: str, weight: str | None = None) -> DataFrame:
    """Counts (or summed weights) per named bin; empty bins show 0."""
    spec = BINS[bins]
    label: Column | None = None
    for name, lo, hi in spec:
        test = F.col(col).between(lo, hi)
        label = F.when(test, name) if label is None else label.when(test, name)
    counts = df.groupBy(label.alias("bin")).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("n"))
    rows = ", ".join(f"({i}, '{name}')" for i, (name, _, _) in enumerate(spec))
    names = df.sparkSession.sql(f"SELECT * FROM VALUES {rows} AS b(ord, bin)")
    return names.join(counts, "bin", "left").select("ord", "bin", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def low_coverage(coverage: DataFrame, thresholds=LOW_COVERAGE) -> DataFrame:
    """Ids covered at most t times, per threshold.  Bounded by the property dimension."""
    tests = F.array(*[F.when(F.col("entity_count") <= t, F.lit(t)) for t in thresholds])
    rows = coverage.select("property_id", F.explode(F.array_compact(tests)).alias("threshold"))
    return rows.groupBy("threshold").agg(F.array_sort(F.collect_list("property_id")).alias("property_ids"))


def query_property_coverage(query_properties: DataFrame, coverage: DataFrame) -> DataFrame:
    return query_properties.select("property_id").distinct().join(coverage, "property_id", "left").select(
        "property_id", F.coalesce("entity_count", F.lit(0)).cast("bigint").alias("entity_count"))


def pass_fail(checks: DataFrame, by: str) -> DataFrame:
    """Passed, failed, total, pass rate and result-count range per group."""
    return checks.groupBy(by).agg(
        F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), F.count(F.lit(1)).alias("total"),
        F.min("scan_count").alias("min_count"), F.avg("scan_count").alias("avg_count"), F.max("scan_count").alias("max_count"),
    ).withColumn("pass_rate", F.col("passed") / F.col("total"))


def crosstab(df: DataFrame, rows: str, columns: str, names: list[str]) -> DataFrame:
    """Counts by two keys, one column per name of the closed list ``names``."""
    return df.groupBy(rows).agg(*[F.count_if(F.col(columns) == n).alias(n) for n in names])


def audit(values: DataFrame, id_col: str, nullable: str) -> DataFrame:
    return values.agg(F.count(F.lit(1)).alias("n_rows"), F.min(id_col).alias("min_id"), F.max(id_col).alias("max_id"),
                      F.count_if(F.col(nullable).isNull()).alias("n_null"))


def top_k_sources(records: DataFrame, source: str, k: int) -> DataFrame:
    return records.groupBy(source).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), source).limit(k)


def head(df: DataFrame, n: int, *order: str) -> DataFrame:
    return df.orderBy(*order).limit(n)

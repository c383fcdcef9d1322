"""Score predicted results against reference results, both in long form.

``gold`` and ``predicted`` are (sample_id, value); ``samples`` lists every
sample with ``kind`` ('ids' or 'scalar'); ``failed`` marks failed predictions.
Nothing is gathered per sample: sets are compared by counting matches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALAR_TOLERANCE = 1e-6


def _set_counts(samples: DataFrame, gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Per sample: distinct gold values, distinct predicted values, both, and whether a single value on either
    side lies within the tolerance.  Values may be ids or texts of numbers; one pass over both sides."""
    sides = gold.select("sample_id", "value", F.lit(1).alias("g"), F.lit(0).alias("p")).unionByName(
        predicted.select("sample_id", "value", F.lit(0).alias("g"), F.lit(1).alias("p")))
    per_value = sides.groupBy("sample_id", "value").agg(F.max("g").alias("g"), F.max("p").alias("p"))
    only = lambda side: F.max(F.when(F.col(side) == 1, F.col("value"))).cast("double")  # noqa: E731  the value itself where there is one
    close = (F.sum("g") == 1) & (F.sum("p") == 1) & (F.abs(only("g") - only("p")) <= SCALAR_TOLERANCE)
    counts = per_value.groupBy("sample_id").agg(F.sum("g").alias("n_gold"), F.sum("p").alias("n_pred"), F.sum(F.col("g") * F.col("p")).alias("n_both"), close.alias("close"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return samples.join(counts, "sample_id", "left").select(*samples.columns, zero("n_gold"), zero("n_pred"), zero("n_both"), F.coalesce("close", F.lit(False)).alias("close"))


def execution_accuracy(samples: DataFrame, gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(sample_id, ex): order-free, duplicate-free set equality; scalars within 1e-6; failures 0."""
    scored = _set_counts(samples, gold, predicted)
    same = (F.col("n_gold") == F.col("n_both")) & (F.col("n_pred") == F.col("n_both"))
    hit = F.when(F.col("kind") == "scalar", F.col("close")).otherwise(same)
    return scored.select("sample_id", F.when(F.col("failed"), 0).otherwise(hit.cast("int")).alias("ex"))


def recall_counts(samples: DataFrame, gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(sample_id, hits, wanted); samples without gold values are left out."""
    scored = _set_counts(samples, gold, predicted)
    hits = F.when(F.col("failed"), 0).when(F.col("kind") == "scalar", F.col("close").cast("int")).otherwise(F.col("n_both"))
    wanted = F.when(F.col("kind") == "scalar", 1).otherwise(F.col("n_gold"))
    return scored.filter("n_gold > 0").select("sample_id", hits.cast("bigint").alias("hits"), wanted.cast("bigint").alias("wanted"))


def macro_recall(counts: DataFrame) -> DataFrame:
    return counts.agg(F.avg(F.col("hits") / F.col("wanted")).alias("macro_recall"))


def micro_recall(counts: DataFrame) -> DataFrame:
    return counts.agg((F.sum("hits") / F.sum("wanted")).alias("micro_recall"))


def result_equivalence(samples: DataFrame, a: DataFrame, b: DataFrame, digits: int = 6) -> DataFrame:
    """Same values from two engines per sample, after rounding and ignoring order."""
    rounded = lambda df: df.select("sample_id", F.round("value", digits).alias("value"))
    counts = _set_counts(samples.select("sample_id"), rounded(a), rounded(b))
    return counts.select("sample_id", ((F.col("n_gold") == F.col("n_both")) & (F.col("n_pred") == F.col("n_both"))).alias("equivalent"))

"""Row numbering that never sorts a whole table in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparsile.operators.nulls import join_null_safe
from sparsile.session import durable

DIGIT_BITS = 12


def running_total(df: DataFrame, key: str, name: str, weight: str | None = None, order_within: list[str] | None = None,
                  partition_by: list[str] | None = None, key_bits: int = 48) -> DataFrame:
    """Running sum of ``weight`` (1 per row if None) in order of an integer ``key``,
    ties by ``order_within``; the current row is included.

    Keys are read as 12-bit digits.  Rows are summed inside their lowest digit's
    bucket, and each bucket starts where the one before it ends; bucket starts come
    from totals, summed digit by digit.  Every window therefore sees at most 4096
    siblings (times the rows that share one key).  Null keys come first, as one key; null groups are groups.
    """
    group = partition_by or []
    bucket = "_b1"
    amount = F.lit(1) if weight is None else F.col(weight)
    rows = df.withColumn(bucket, F.shiftright(F.col(key).cast("bigint"), DIGIT_BITS))
    level_totals = [rows.groupBy(*group, bucket).agg(F.sum(amount).alias("_n"))]
    levels = max(1, -(-key_bits // DIGIT_BITS) - 1)
    for depth in range(2, levels + 1):
        parent = f"_b{depth}"
        totals = level_totals[-1].withColumn(parent, F.shiftright(F.col(f"_b{depth - 1}"), DIGIT_BITS))
        level_totals[-1] = totals
        level_totals.append(totals.groupBy(*group, parent).agg(F.sum("_n").alias("_n")))
    starts = None
    for depth in range(levels, 0, -1):
        totals, own = level_totals[depth - 1], f"_b{depth}"
        siblings = [*group, f"_b{depth + 1}"] if depth < levels else group
        before = W.partitionBy(*siblings).orderBy(own).rowsBetween(W.unboundedPreceding, -1)
        local = totals.withColumn("_local", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        if starts is None:
            starts = local.select(*group, own, F.col("_local").alias("_start"))
        else:
            starts = join_null_safe(local, starts, siblings).select(*group, own, (F.col("_local") + F.col("_start")).alias("_start"))
    inside = W.partitionBy(*group, bucket).orderBy(key, *(order_within or [])).rowsBetween(W.unboundedPreceding, 0)
    summed = join_null_safe(rows.withColumn("_in", F.sum(amount).over(inside)), starts, [*group, bucket])
    return summed.withColumn(name, (F.col("_in") + F.col("_start")).cast("bigint")).drop(bucket, "_in", "_start")


def dense_number(df: DataFrame, key: str, name: str, order_within: list[str] | None = None,
                 partition_by: list[str] | None = None, key_bits: int = 48) -> DataFrame:
    """Number rows 1..n by an integer ``key``, ties by ``order_within``."""
    return running_total(df, key, name, None, order_within, partition_by, key_bits)


def number_pairs(df: DataFrame, first: str, second: str, name: str) -> DataFrame:
    """Number rows 1..n by a unique pair of integers, such as (document, position).  Rows are numbered inside their
    ``first`` by buckets of 4,096 positions, and each ``first`` starts where the one before it ends, so one huge
    ``first`` is cut like many small ones.  Bucket totals of one ``first`` meet in one window."""
    inside = dense_number(df, second, "_inside", partition_by=[first], key_bits=2 * DIGIT_BITS)
    totals = df.groupBy(first).agg(F.count(F.lit(1)).alias("_n"))
    starts = running_total(totals, first, "_upto", "_n").select(first, (F.col("_upto") - F.col("_n")).alias("_before"))
    return join_null_safe(inside, starts, [first]).withColumn(name, (F.col("_inside") + F.col("_before")).cast("bigint")).drop("_inside", "_before")


def ranged_total(df: DataFrame, order: str, name: str, weight: str | None = None, partition_by: list[str] | None = None) -> DataFrame:
    """Running sum of ``weight`` (1 per row if None) in order of any sortable column without ties, the row included.

    Rows are cut into ranges of equal count (Spark samples the cuts; they only place the rows, the sums are exact) and
    written once, so that each row keeps its range.  Totals per range, one row each, give every range its start.
    """
    group = partition_by or []
    amount = F.lit(1) if weight is None else F.col(weight)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = durable(df.repartitionByRange(parts, *group, order).withColumn("_part", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy(*group, "_part").agg(F.sum(amount).alias("_n"))
    earlier = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(*group, "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    inside = W.partitionBy(*group, "_part").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    summed = ranged.withColumn("_in", F.sum(amount).over(inside)).alias("r").join(
        starts.alias("s"), reduce(lambda a, c: a & F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")), group, F.col("r._part") == F.col("s._part")))
    return summed.select(*[F.col(f"r.{c}") for c in df.columns], (F.col("_in") + F.col("_start")).cast("bigint").alias(name))


def exact_percentiles(df: DataFrame, col: str, by: list[str], shares: dict[str, float]) -> DataFrame:
    """Continuous percentiles of a double column per group, for inputs of any size and any spread of values.

    Equal values are counted first; a running total of counts over value ranges gives each value its ranks, and a percentile is
    read from the values at the two ranks around it.  Null values do not count; a null group is a group.
    """
    counts = durable(df.filter(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count(F.lit(1)).alias("_c")), "counts")
    totals = counts.groupBy(*by).agg(F.sum("_c").alias("_total"))
    ranked = join_null_safe(ranged_total(counts, col, "_upto", "_c", by), totals, by)
    aggregates = []
    for name, share in shares.items():
        target = (F.col("_total") - 1) * share
        holds = lambda rank: (F.col("_upto") - F.col("_c") <= rank) & (rank < F.col("_upto"))
        low, high = F.floor(target), F.ceil(target)
        aggregates += [F.max(F.when(holds(low), F.col(col))).alias(f"_l_{name}"), F.max(F.when(holds(high), F.col(col))).alias(f"_h_{name}"),
                       F.max(target - low).alias(f"_f_{name}")]
    found = ranked.groupBy(*by).agg(*aggregates)
    return found.select(*by, *[(F.col(f"_l_{n}") + (F.col(f"_h_{n}") - F.col(f"_l_{n}")) * F.col(f"_f_{n}")).alias(n) for n in shares])


def assign_dataset_id(entities: DataFrame) -> DataFrame:
    """Same title, same id of four or more digits, numbered by title; distinct titles are numbered range by range."""
    titles = entities.select("title").filter("title IS NOT NULL").distinct()
    ids = ranged_total(titles, "title", "_n").select("title", F.format_string("%04d", "_n").alias("dataset_id"))
    return entities.drop("dataset_id").join(ids, "title", "left")


def collision_changes(ids: DataFrame, id_col: str, order: list[str]) -> DataFrame:
    """(order…, new_id) of every record whose id was taken before it.

    ``order`` is the load order: a unique pair of integers (document, position) or
    one unique integer.  New ids are max(id) + 1, 2, … in load order.  First
    records are found by an aggregate and matched back on their unique place, so
    one id held by a third of all records still spreads evenly.
    """
    firsts = ids.groupBy(id_col).agg(F.min(F.struct(*order)).alias("_at")).select("_at.*")
    later = ids.select(*order).join(firsts, order, "left_anti")
    top = ids.agg(F.max(id_col)).scalar()
    numbered = number_pairs(later, *order, "_extra") if len(order) == 2 else dense_number(later, order[0], "_extra")
    return numbered.select(*order, (F.col("_extra") + top).alias("new_id"))


def resolve_id_collisions(records: DataFrame, id_col: str, order: list[str]) -> DataFrame:
    """The first record of an id keeps it, every later one gets an unused id.
    Ids are read once into the shared folder; only changed ids are joined back, so
    while they are few, records stay in place."""
    changes = collision_changes(durable(records.select(*order, id_col), "ids"), id_col, order)
    return records.join(changes, order, "left").withColumn(id_col, F.coalesce("new_id", id_col)).drop("new_id")


def reindex(samples: DataFrame, key: str = "sample_id") -> DataFrame:
    """Renumber ``key`` as 1..n in its own order."""
    return dense_number(samples, key, "_new").withColumn(key, F.col("_new")).drop("_new")


def surrogate_value_id(values: DataFrame) -> DataFrame:
    return dense_number(values, "data_id", "value_id", order_within=["property_id"])


def rank_frequency(coverage: DataFrame) -> DataFrame:
    """Covered properties by descending coverage.  ``coverage`` has one row per
    property, so its window is bounded by the property dimension."""
    return coverage.filter("entity_count > 0").withColumn(
        "rank", F.row_number().over(W.orderBy(F.desc("entity_count"), "property_id")))


def cdf(counts: DataFrame, value: str) -> DataFrame:
    """Share of rows at or below each value.  Rows are counted per distinct
    value before the running sum, which goes range by range."""
    per_value = counts.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    total = counts.count()
    upto = F.col("_upto")
    return ranged_total(per_value, value, "_upto", "n").select(value, "n", ((upto - F.col("n") + 1) / total).alias("cdf_first"), (upto / total).alias("cdf"))


def cdf_rows(counts: DataFrame, value: str, key: str) -> DataFrame:
    """i/n per row in value order; tied rows (ordered by ``key``) get different shares, null values come first."""
    total = counts.count()
    per_value = counts.groupBy(value).agg(F.count(F.lit(1)).alias("_c"))
    starts = ranged_total(per_value, value, "_upto", "_c").select(value, (F.col("_upto") - F.col("_c")).alias("_before"))
    numbered = dense_number(counts, key, "_i", partition_by=[value])
    numbered = join_null_safe(numbered, starts, [value])
    return numbered.withColumn("cdf", (F.col("_before") + F.col("_i")) / total).drop("_i", "_before")

"""Mixing sources to target weights by Pareto order sampling, in built-in functions only.

Sources share the size of the whole corpus by weight; a source's target stops at ``most`` times its
own size and the excess goes to the others by weight (water filling, in closed form).  Every document of a
source with target t and size s gets the whole copies floor(t / s) for certain; the words still owed are sampled.

One more copy goes to a sample with unequal inclusion odds: a document's chance p is proportional to its size, p = c * size, with c such
that the expected words are those owed.  Documents for which that reaches 1 are certain and taken whole, and c is found again
for the others until all are below 1 (in closed form, over the distinct sizes of a source).  The others get the rank
(u / (1 - u)) / (p / (1 - p)), their random odds over their inclusion odds, and documents are taken in the order of rank until the
owed words are met: the sample's size is fixed, in words, to within half a document.

u is a hash of the document's key, text, source and, for rows equal in all three, the row's ordinal among them, so reruns agree and
repeated rows are drawn one by one.  Ordinals come from counts per (row, part of the table), so no task holds all repeats.
Ranks are cut into buckets; running sums of bucket sizes find the bucket in which a source's quota ends, and a
highest rank per source then decides every row where it stands.

Defined results: null or blank texts have size 0 and take 0 words; null is the last source; an empty table
gives an empty result; a source of size 0 has target 0.  Very long texts are certain ones where their size makes them so.
Different rows of one rank share their fate.  Of rows equal in key, text and source the number that is taken is fixed, which of
them is not.  Other columns may have any names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparsile.session import durable
from sparsile.sizing import local_copy

WEIGHTS = (5, 2, 1)
MOST = 3
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def identity(key: Column, text: Column, source: Column) -> Column:
    return F.md5(F.concat_ws("|", key.cast("string"), F.md5(text.cast("binary")), source.cast("string")).cast("binary"))


def draw(digest: Column, ordinal: Column) -> Column:
    """A uniform number in (0, 1) fixed by a row's identity and its ordinal among equal rows: 52 bits of an MD5."""
    hashed = F.md5(F.concat_ws("#", digest, ordinal.cast("string")).cast("binary"))
    return (F.conv(F.substring(hashed, 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target): one row per source.  The level at which all sources fill up is the
    highest of the levels that come from capping the first k sources in order of cap / weight."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int"))
    capped = totals.withColumn("w", weight).withColumn("cap", F.lit(most) * F.col("source_size"))
    earlier = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    owed = F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(earlier), F.lit(0))
    shares = F.sum("w").over(whole) - F.coalesce(F.sum("w").over(earlier), F.lit(0))
    levels = capped.withColumn("level", owed / shares)
    return levels.select("source", "source_size", F.least(F.col("cap").cast("double"), F.max("level").over(whole) * F.col("w")).alias("target"))


def inclusion_factors(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """(source, factor) of the sources that owe words: a document's chance is factor * size, 1 where that is more.  Going down a
    source's distinct sizes, the first one that is not certain given that all larger ones are fixes the factor.  A window holds one source's
    distinct sizes, fewer than the longest text has words."""
    exact = lambda c: c.cast("decimal(38,0)")
    size = F.col("size")
    tally = sizes.filter("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("rows"))
    sums = tally.select("source", "size", exact(F.col("rows") * size).alias("words"), (exact(F.col("rows")) * (size * size).cast("decimal(20,0)")).cast("decimal(38,0)").alias("squares"))
    own = plan.filter("owed > 0").select(F.col("source").alias("s"), "owed")
    owing = _by_source(sums, own, F.col("source").eqNullSafe(F.col("s")))
    larger = W.partitionBy("s").orderBy(F.desc("size")).rowsBetween(W.unboundedPreceding, -1)
    others = W.partitionBy("s").orderBy("size").rowsBetween(W.unboundedPreceding, 0)
    left = F.col("owed") - F.coalesce(F.sum("words").over(larger), exact(F.lit(0))).cast("double")
    tried = owing.withColumn("factor", left / F.sum("squares").over(others).cast("double"))
    return tried.filter(F.col("factor") * size < 1).groupBy("s").agg(F.max_by("factor", "size").alias("factor"))


def order_rank(u: Column, size: Column, factor: Column) -> Column:
    """Random odds over inclusion odds; 0 for certain documents, null for those that cannot be drawn."""
    p = factor * size
    return F.when(p >= 1, 0.0).when(p > 0, (u / (1 - u)) / (p / (1 - p)))


def sampling_cuts(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, source_size, target, copies, factor, cut): whole copies of every document of a source, the factor of its
    inclusion odds, and the highest rank that gets one more."""
    buckets = max(1, math.isqrt(sizes.count()))  # as many buckets as rows in one
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = durable(targets.withColumn("copies", F.floor(share)).withColumn("owed", F.col("target") - F.col("copies") * F.col("source_size")), "plan")
    factors = inclusion_factors(sizes, plan)
    same = F.col("source").eqNullSafe(F.col("s"))
    # a source whose every document is certain owes as much as it holds: any factor that makes the least size certain will do
    plan = durable(plan.join(factors, same, "left").withColumn("factor", F.coalesce("factor", F.when(F.col("owed") > 0, 1.0))).drop("s"), "odds")
    own = plan.filter("owed > 0").select(F.col("source").alias("s"), "owed", "factor")
    ranked = _by_source(sizes, own.select("s", "factor"), same).withColumn("rank", order_rank(F.col("u"), F.col("size"), F.col("factor"))).filter("rank IS NOT NULL")
    draws = ranked.groupBy("s", "rank").agg(F.sum("size").alias("size")).withColumn("bucket", F.floor(F.col("rank") / (1 + F.col("rank")) * buckets))
    sums = draws.groupBy("s", "bucket").agg(F.sum("size").alias("n"), F.max("rank").alias("top"))
    earlier = W.partitionBy("s").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).withColumn("below", F.max("top").over(earlier)).withColumnRenamed("s", "source")
    # the bucket in which a quota ends; all buckets before it are taken whole
    ends = _by_source(starts, own, same).filter(F.col("before") < F.col("owed")).groupBy("s").agg(F.max(F.struct("bucket", "before", "below", "owed")).alias("e")).select(
        "s", F.col("e.bucket").alias("b"), "e.before", "e.below", "e.owed")
    inside = W.partitionBy("source").orderBy("rank").rowsBetween(W.unboundedPreceding, -1)
    last = (_by_source(draws.withColumnRenamed("s", "source"), ends.select("s", "b", "before", "owed"), same & (F.col("bucket") == F.col("b")))
            .withColumn("upto", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)) + F.col("size") / 2)
            .filter(F.col("upto") <= F.col("owed")).groupBy("s").agg(F.max("rank").alias("last")))
    cuts = ends.select("s", "below").join(last.withColumnRenamed("s", "t"), F.col("s").eqNullSafe(F.col("t")), "left").select("s", F.greatest("last", "below").alias("cut"))
    return durable(plan.join(cuts, same, "left").select("source", "source_size", "target", "copies", "factor", F.coalesce("cut", F.lit(-1.0)).alias("cut")), "cuts")


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows (a written table with ``digest`` and ``part``) with their ordinal among rows of one digest.  Only repeated rows are numbered:
    inside their part of the table, on top of the counts of the parts before."""
    tally = durable(rows.groupBy("digest", "part").agg(F.count(F.lit(1)).alias("c")), "tally")
    repeated = tally.groupBy("digest").agg(F.sum("c").alias("all")).filter("all > 1").select("digest")
    if repeated.isEmpty():
        return rows.withColumn("ordinal", F.lit(1).cast("long"))
    earlier = W.partitionBy("digest").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = tally.join(repeated, "digest", "left_semi").select("digest", "part", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("start"))
    inside = W.partitionBy("digest", "part").orderBy(F.lit(1))
    counted = rows.join(repeated, "digest", "left_semi").withColumn("place", F.row_number().over(inside))
    numbered = counted.join(starts, ["digest", "part"]).withColumn("ordinal", (F.col("start") + F.col("place")).cast("long")).select(*rows.columns, "ordinal")
    return rows.join(repeated, "digest", "left_anti").select(*rows.columns, F.lit(1).cast("long").alias("ordinal")).unionByName(numbered)


def _by_source(rows: DataFrame, table: DataFrame, match: Column) -> DataFrame:
    """Join a table of one row per source; it is broadcast once it has proved small, so hot sources stay spread."""
    small = local_copy(table)
    return rows.join(table if small is None else F.broadcast(small), match)


def _measured(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """(key, source, size, u) of every row, as a written table."""
    rows = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"),
                       identity(F.col(key), F.col(text), F.col(source)).alias("digest"), F.spark_partition_id().alias("part"))
    return durable(_numbered(durable(rows, "rows")).select("key", "source", "size", draw(F.col("digest"), F.col("ordinal")).alias("u"), "digest", "ordinal"), "sizes")


def _copies() -> Column:
    return F.col("copies") + F.coalesce(order_rank(F.col("u"), F.col("size"), F.col("factor")) <= F.col("cut"), F.lit(False)).cast("int")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, size, source_size, target, taken) of every document."""
    sizes = _measured(docs, key, text, source)
    cuts = sampling_cuts(sizes, source_targets(sizes, weights, most)).withColumnRenamed("source", "s")
    return _by_source(sizes, cuts, F.col("source").eqNullSafe(F.col("s"))).select(
        F.col("key").alias(key), "size", "source_size", "target", (F.col("size") * _copies()).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The documents of the mix, each as often as the mix takes it.  Only the table of cuts, one row per
    source, is joined to the texts; rows that are repeated are written apart and numbered there.  Documents without words are in no source's quota and go."""
    sizes = _measured(docs, key, text, source)
    cuts = sampling_cuts(sizes, source_targets(sizes, weights, most)).select(F.col("source").alias("s"), "copies", "factor", "cut")
    packed = docs.select(F.struct("*").alias("row"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"),  # other columns may have any names
                         identity(F.col(key), F.col(text), F.col(source)).alias("digest")).filter("size > 0")
    repeated = sizes.filter("ordinal = 2").select("digest").distinct()
    rows = packed.withColumn("ordinal", F.lit(1).cast("long"))
    if not repeated.isEmpty():
        apart = durable(packed.join(repeated, "digest", "left_semi").withColumn("part", F.spark_partition_id()), "repeated")
        rows = rows.join(repeated, "digest", "left_anti").unionByName(_numbered(apart).drop("part"))
    rows = rows.withColumn("u", draw(F.col("digest"), F.col("ordinal")))
    times = _by_source(rows, cuts, F.col("source").eqNullSafe(F.col("s"))).select("row", _copies().cast("int").alias("times")).filter("times > 0")
    return times.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")

"""Workload classification, statistics, timing and curation."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparsile.functions import phrases, sqltext
from sparsile.operators import aggregates as A
from sparsile.operators.aggregate_queries import aggregate_reasons, evaluate_aggregates
from sparsile.operators.matching import extract_conditions
from sparsile.operators.numbering import dense_number, reindex
from sparsile.operators.retrieval import evaluate_predicates
from sparsile.session import durable
from sparsile.sizing import spread
from sparsile.sources.reports import CHUNK

# Points per match of the two scoring rules (number, range or operator word, literal).
POINTS = {1: (5, 3, 5), 2: (3, 2, 5)}
SCORE_WORDS = {">": ("大于", "超过", "以上", "高于"), "<": ("小于", "低于", "不到", "以下"), "=": ("等于", "刚好", "为", "是")}


def features(samples: DataFrame, variant: str = "a") -> DataFrame:
    """Structure features per sample, in one projection."""
    sql = F.col("sql")
    return samples.withColumns({
        "category": sqltext.classify_query(sql, variant),
        "n_joins": sqltext.count_joins(sql), "n_where": sqltext.count_where(sql),
        "n_where_conditions": sqltext.count_where_conditions(sql), "n_filters": sqltext.filter_condition_count(sql),
        "props": sqltext.property_ids(sql, with_in=False), "has_agg": sqltext.is_aggregation(sql),
    })


def function_counts(samples: DataFrame) -> DataFrame:
    return samples.agg(*[F.count_if(sqltext.uses_function(F.col("sql"), f)).alias(f.lower()) for f in sqltext.AGGREGATE_NAMES])


def workload_stats(samples: DataFrame, sizes: DataFrame, by: str = "category") -> DataFrame:
    """Structure statistics per class."""
    rows = features(samples).join(sizes, "sample_id").withColumn("n_props", F.size("props"))
    stats = rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("samples"), F.avg("n_joins").alias("avg_joins"), F.min("n_joins").alias("min_joins"), F.max("n_joins").alias("max_joins"),
        F.avg("n_where").alias("avg_where"), F.avg("n_filters").alias("avg_filters"), F.min("n_filters").alias("min_filters"), F.max("n_filters").alias("max_filters"),
        F.avg("n_props").alias("avg_props"), F.median("n_result").alias("median_result"))
    distinct = features(samples).select(by, F.explode("props").alias("p")).groupBy(by).agg(F.count_distinct("p").alias("distinct_props"))
    return stats.join(distinct, by, "left").withColumn("distinct_props", F.coalesce("distinct_props", F.lit(0)).cast("bigint"))


def keyword_agreement(samples: DataFrame, text: str = "natural_language") -> DataFrame:
    flags = features(samples).select("category", phrases.has_any(F.col(text), phrases.CLASS_AGGREGATE_WORDS).cast("int").alias("a"),
                                     phrases.has_any(F.col(text), phrases.CLASS_MULTI_WORDS).cast("int").alias("m"))
    return flags.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.avg("a").alias("agg_share"), F.avg("m").alias("multi_share"))


def operator_class_counts(samples: DataFrame) -> DataFrame:
    return samples.groupBy(sqltext.operator_class(F.col("sql")).alias("operator_class")).agg(F.count(F.lit(1)).alias("n"))


def duplicate_groups(samples: DataFrame) -> DataFrame:
    """Whitespace-normalised texts used more than once; counted map-side, so a
    text that makes up a third of the samples is one partial count per task."""
    return samples.groupBy(sqltext.normalize_space(F.col("sql")).alias("norm_sql")).agg(
        F.count(F.lit(1)).alias("n"), F.min("sample_id").alias("first_id")).filter("n > 1")


def match_score(samples: DataFrame, version: int = 1, text: str = "natural_language") -> DataFrame:
    """Points for thresholds, operator words and string literal found in the question.  Few bytes are read and much is done for each text."""
    score = sqltext.let(sqltext.normalize_space(F.col("sql")), lambda sql: _points(sql, F.col(text), version))
    return spread(samples).withColumn("score", score)


def _points(sql: Column, nl: Column, version: int) -> Column:
    number_points, word_points, literal_points = POINTS[version]
    in_text = lambda n, forms: F.aggregate(
        F.transform(forms(n), lambda f: F.contains(nl, f)), F.lit(False), lambda a, b: a | b)
    whole = lambda n: n == F.floor(n)
    fixed = lambda n, digits: n.cast(f"decimal(30,{digits})").cast("string")
    said = F.when(F.contains(F.upper(sql), F.lit("BETWEEN")), phrases.has_any(nl, phrases.RANGE_WORDS))
    literal = F.regexp_extract(sql, r"\w+\.value\s*=\s*'([^']+)'", 1)
    quoted = ((literal != "") & F.contains(nl, literal)).cast("int") * literal_points
    total = lambda numbers, forms, said: (
        F.size(F.filter(numbers, lambda n: in_text(n, forms))) * number_points + F.coalesce(said, F.lit(False)).cast("int") * word_points + quoted).cast("int")
    if version == 2:
        raw = F.transform(F.regexp_extract_all(sql, F.lit(r"(\d+\.?\d*)"), 1), lambda x: x.try_cast("decimal(30,15)"))
        numbers = F.array_distinct(F.filter(raw, lambda n: (n > 0.01) & (n < 1000000)))
        return total(numbers, lambda n: F.array(F.when(whole(n), sqltext.plain(n)).when(n == F.round(n, 1), fixed(n, 1)).otherwise(fixed(n, 2))), said)

    def first(conditions):
        numbers = F.filter(F.flatten(F.transform(conditions, lambda c: F.array(c["lo"], c["hi"]))), lambda n: n.isNotNull())
        ops = F.transform(conditions, lambda c: c["op"])
        worded = said
        for op, words in SCORE_WORDS.items():
            worded = worded.when(F.array_contains(ops, op), phrases.has_any(nl, words))
        return total(numbers, lambda n: F.array(sqltext.plain(n), fixed(n, 1), fixed(n, 2)), worded)

    return sqltext.let(F.filter(sqltext.alias_conditions(sql), lambda c: c["kind"].isin("num", "between")), first)


def best_of_group(scored: DataFrame, version: int = 1) -> DataFrame:
    """Samples that survive their duplicate group: every sample with the top
    score; in version 2 a group whose top score is 0 keeps its highest id only.
    The group's best is an aggregate joined back, so a huge group is not sorted."""
    keyed = scored.withColumn("_text", F.md5(sqltext.normalize_space(F.col("sql")).cast("binary")))  # 128 bits stand for the text
    best = keyed.select("_text", "score", "sample_id").groupBy("_text").agg(F.max("score").alias("_top"), F.max("sample_id").alias("_last"))
    joined = keyed.join(best, "_text")
    keep = F.col("score") == F.col("_top")
    if version == 2:
        keep = keep & ((F.col("_top") > 0) | (F.col("sample_id") == F.col("_last")))
    return joined.filter(keep).drop("_text", "_top", "_last")


def curate_samples(samples: DataFrame, version: int = 2, threshold: str = "0.1") -> DataFrame:
    """Drop weaker duplicates, renumber, lift zero thresholds; :func:`rerun_curated` answers the texts again."""
    scored = durable(match_score(samples, version), "scored")  # read by every step of the choice and of the numbering
    kept = reindex(durable(best_of_group(scored, version).drop("score"), "kept"))
    return kept.withColumn("sql", sqltext.rewrite_zero_threshold(F.col("sql"), threshold))


def rerun_curated(samples: DataFrame, values: DataFrame, entities: DataFrame, version: int = 2, threshold: str = "0.1", mode: str = "strict") -> tuple[DataFrame, DataFrame]:
    """Curated samples, and the (sample_id, data_id) that their lifted texts find: ids of all id queries in one job, under the new numbers.
    Curated texts are written once, so that both results carry the same numbers."""
    curated = durable(curate_samples(samples, version, threshold), "curated")
    asked = curated.filter(~sqltext.is_aggregation(F.col("sql")))
    return curated, evaluate_predicates(values, extract_conditions(asked), entities, mode)


def evaluate_aggregate_texts(samples: DataFrame, values: DataFrame, mode: str = "strict", entities: DataFrame | None = None) -> DataFrame:
    """(sample_id, call, fn, value, text) of every aggregate call of the samples' query texts, in one job.  Texts that cannot be
    answered in full give no rows; :func:`unread_aggregates` names them."""
    asked = samples.filter(sqltext.is_aggregation(F.col("sql")))
    read = durable(aggregate_reasons(asked), "aggregates").filter("reason IS NULL")
    calls = read.select("sample_id", F.explode("calls").alias("c")).select("sample_id", "c.*")
    return evaluate_aggregates(values, calls, extract_conditions(asked.join(read.select("sample_id"), "sample_id", "left_semi")), entities, mode)


def unread_aggregates(samples: DataFrame) -> DataFrame:
    """(sample_id, reason) of aggregate query texts that :func:`evaluate_aggregate_texts` does not answer."""
    return aggregate_reasons(samples.filter(sqltext.is_aggregation(F.col("sql")))).filter("reason IS NOT NULL").select("sample_id", "reason")


def gold_results(samples: DataFrame, values: DataFrame, entities: DataFrame, records: DataFrame, missing: str = "null", chunk: int = CHUNK) -> DataFrame:
    """(sample_id, chunk, result, result_data): ids of every id query in order, each with its record, in chunks of
    bounded size; a sample without a hit has one empty chunk.  ``missing`` keeps ids without a record (``null``) or skips them in ``result_data`` (``skip``)."""
    asked = samples.filter(~sqltext.is_aggregation(F.col("sql")))
    hits = durable(evaluate_predicates(values, extract_conditions(asked), entities), "hits")
    numbered = dense_number(hits, "data_id", "_n", partition_by=["sample_id"])
    rows = numbered.join(records.withColumn("_known", F.lit(True)), "data_id", "left").withColumn("chunk", F.floor((F.col("_n") - 1) / chunk))
    record = F.struct(*[c for c in records.columns if c != "data_id"])
    listed = F.array_sort(F.collect_list(F.struct("_n", "data_id", record.alias("record"), "_known")))
    packed = rows.groupBy("sample_id", "chunk").agg(listed.alias("_rows"))
    kept = F.col("_rows") if missing == "null" else F.filter("_rows", lambda r: F.coalesce(r["_known"], F.lit(False)))
    data = F.transform(kept, lambda r: F.when(r["_known"], r["record"]))
    chunks = packed.select("sample_id", "chunk", F.transform("_rows", lambda r: r["data_id"]).alias("result"), data.alias("result_data"))
    return asked.select("sample_id").join(chunks, "sample_id", "left").withColumns({
        "chunk": F.coalesce("chunk", F.lit(0)), "result": F.coalesce("result", F.array().cast("array<bigint>")), "result_data": F.coalesce("result_data", F.array().cast(chunks.schema["result_data"].dataType))})


def workload_report(samples: DataFrame, sizes: DataFrame) -> DataFrame:
    return workload_stats(samples, sizes).join(keyword_agreement(samples).drop("n"), "category")


def time_workload(spark: SparkSession, queries: list[tuple[int, str, str]]) -> tuple[DataFrame, DataFrame]:
    """Wall time of each (sample_id, category, sql): summary per class and
    failures.  Results are counted on the executors, never fetched."""
    timings, failures = [], []
    for sample_id, category, text in queries:
        start = time.perf_counter()
        try:
            rows = spark.sql(text).count()
            timings.append((sample_id, category, (time.perf_counter() - start) * 1000, rows))
        except Exception as exc:
            failures.append((sample_id, category, type(exc).__name__))
    measured = spark.createDataFrame(timings, "sample_id bigint, category string, ms double, n_rows bigint")
    failed = spark.createDataFrame(failures, "sample_id bigint, category string, error string")
    return A.runtime_summary(measured, "ms", ["category"], max_below=20), failed

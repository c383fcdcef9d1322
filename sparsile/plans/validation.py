"""Validation of queries and stored results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparsile.functions import phrases, sqltext
from sparsile.functions.numeric import condition_holds
from sparsile.operators import aggregates as A
from sparsile.operators.matching import extract_conditions, lookup_ci, match_conditions, opposite, unparsed
from sparsile.operators.retrieval import evaluate_predicates, result_sizes
from sparsile.sizing import join_control

# Thresholds of the heuristic review.
FEW_CONDITIONS = 2
MANY_PROPERTIES, MANY_RESULTS = 3, 500
BOUNDARY_KINDS = ("greater", "greater_equal", "less", "less_equal", "range")


def boundary_checks(samples: DataFrame, values: DataFrame, entities: DataFrame, stored: DataFrame,
                    mode: str = "strict") -> DataFrame:
    """One row per (sample, boundary kind): independent recount against the
    stored result size.  All recounts run as one workload job."""
    kinds = samples.select("sample_id", sqltext.classify_query(F.col("sql"), "b").alias("category"),
                           F.explode(sqltext.boundary_types(F.col("sql"))).alias("boundary"))
    recount = result_sizes(samples, evaluate_predicates(values, extract_conditions(samples), entities, mode))
    gold = result_sizes(samples, stored).withColumnRenamed("n_result", "gold_count")
    return kinds.join(recount, "sample_id").join(gold, "sample_id").select(
        "sample_id", "category", "boundary", F.col("n_result").alias("scan_count"), "gold_count",
        (F.col("n_result") == F.col("gold_count")).alias("passed"))


def boundary_report(checks: DataFrame, by: str = "boundary") -> DataFrame:
    return A.pass_fail(checks, by)


def boundary_properties(samples: DataFrame) -> DataFrame:
    """Distinct properties per boundary kind."""
    kinds = samples.select("sample_id", F.explode(sqltext.boundary_types(F.col("sql"))).alias("boundary"))
    props = extract_conditions(samples).select("sample_id", "property_id").distinct()
    return kinds.join(props, "sample_id").groupBy("boundary").agg(F.count_distinct("property_id").alias("n_properties"))


def said_conditions(samples: DataFrame, text: str = "natural_language") -> DataFrame:
    return samples.select("sample_id", F.explode(phrases.phrase_conditions(F.col(text))).alias("p")).select("sample_id", "p.*")


def asked_conditions(samples: DataFrame) -> DataFrame:
    return extract_conditions(samples).filter("kind = 'num'").select("sample_id", "op", "lo")


def operator_direction(samples: DataFrame, text: str = "natural_language") -> DataFrame:
    """A greater word paired with '<', or the reverse, on the same number."""
    pairs = match_conditions(said_conditions(samples, text), asked_conditions(samples))
    return pairs.filter(opposite(F.col("op"), F.col("query_op"))).select("sample_id", "word", "value", "query_op").distinct()


def review_queries(samples: DataFrame, sizes: DataFrame, text: str = "natural_language") -> DataFrame:
    """(sample_id, issue): operator mismatch, suspicious empty result, duplicate
    property, cast on a wrong column, missing FROM, missing SQL."""
    sql = F.col("sql")
    rows = samples.join(sizes, "sample_id")
    n_said = F.size(phrases.phrase_conditions(F.col(text)))
    ids = F.regexp_extract_all(sql, F.lit(sqltext.PROPERTY_EQUALS), 1)
    casts = F.regexp_extract_all(sql, F.lit(r"CAST\(\s*([\w.]+) AS DECIMAL"), 1)
    missing = F.trim(sql) == ""
    tests = {
        "missing_sql": missing,
        "empty_suspicious": ~missing & (F.col("n_result") == 0) & (n_said <= FEW_CONDITIONS),
        "duplicate_property": ~missing & (F.size(ids) != F.size(F.array_distinct(ids))),
        "missing_from": ~missing & ~F.contains(F.upper(sql), F.lit("FROM")),
        "bad_cast": ~missing & F.exists(casts, lambda c: ~F.rlike(c, F.lit(r"(?:^|\.)value$"))),
    }
    flags = F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()]))
    structural = rows.select("sample_id", F.explode(flags).alias("issue"))
    pairs = match_conditions(said_conditions(samples, text), asked_conditions(samples))
    mismatched = pairs.filter("op != query_op").select("sample_id", F.lit("op_mismatch").alias("issue")).distinct()
    return structural.unionByName(mismatched)


def verify_results(samples: DataFrame, stored: DataFrame, values: DataFrame, declared: DataFrame | None = None, mode: str = "strict") -> DataFrame:
    """(sample_id, issue, n): stored rows that violate their query, stored ids without values, queries without
    conditions or rows, texts that cannot be read and, where ``declared`` (sample_id, n) is given, result counts that differ from the stored rows.

    A row is in order if any clause of its query holds; a clause holds if every alias whose property the entity
    has finds a value that passes all its tests, numeric or text.  Every stored row is checked, through joins on
    (data_id, property_id)."""
    plain = samples.filter(~sqltext.is_aggregation(F.col("sql")))
    conditions = extract_conditions(plain)
    tests = conditions.groupBy("sample_id", "clause", "alias", "property_id").agg(F.collect_list(F.struct("kind", "op", "lo", "hi", "text")).alias("tests"))
    checked = join_control(stored, tests, "sample_id", spread="data_id").join(values.select("data_id", "property_id", "value"), ["data_id", "property_id"])
    value = F.col("value")
    holds = F.forall("tests", lambda c: F.coalesce(condition_holds(value, c["kind"], c["op"], c["lo"], c["hi"], c["text"], mode), F.lit(False)))
    aliases = checked.groupBy("sample_id", "data_id", "clause", "alias").agg(F.max(holds).alias("ok"))
    rows = aliases.groupBy("sample_id", "data_id", "clause").agg(F.min("ok").alias("ok")).groupBy("sample_id", "data_id").agg(F.max("ok").alias("ok"))
    bad = rows.filter(~F.col("ok"))
    unknown = stored.join(values.select("data_id"), "data_id", "left_anti")
    issue = lambda df, name: df.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n")).select("sample_id", F.lit(name).alias("issue"), "n")
    unread = unparsed(plain).filter("reason <> 'empty'")
    none = plain.join(conditions.select("sample_id"), "sample_id", "left_anti").join(unread, "sample_id", "left_anti")
    empty = plain.join(stored.select("sample_id").distinct(), "sample_id", "left_anti")
    found = [issue(bad, "value_violation"), issue(unknown, "no_record"), issue(none, "no_conditions"), issue(empty, "empty_data"), issue(unread, "unparsed")]
    if declared is not None:
        sizes = result_sizes(declared, stored).join(declared, "sample_id").filter(F.col("n_result") != F.col("n"))
        found.append(sizes.select("sample_id", F.lit("count_mismatch").alias("issue"), F.abs(F.col("n_result") - F.col("n")).alias("n")))
    return reduce(DataFrame.unionByName, found)


def value_by_name(wanted: DataFrame, values: DataFrame) -> DataFrame:
    """Value of each wanted (data_id, property_name), exact name before any case."""
    return lookup_ci(wanted, values, ["data_id"], "property_name", "value")


def quality_overview(samples: DataFrame, sizes: DataFrame, text: str = "natural_language") -> DataFrame:
    """(name, value): size bins, mean size, missing aggregates, unselective queries, score band."""
    sql = F.col("sql")
    rows = samples.join(sizes, "sample_id")
    calls = F.rlike(F.upper(sql), F.lit(r"(?:MAX|MIN|AVG|SUM|COUNT)\("))
    flags = rows.agg(
        F.coalesce(F.avg("n_result"), F.lit(0.0)).alias("mean_size"),
        F.count_if(phrases.has_any(F.col(text), phrases.AGGREGATE_WORDS) & ~calls).alias("missing_aggregate"),
        F.count_if((F.size(sqltext.property_ids(sql, with_in=False)) >= MANY_PROPERTIES) & (F.col("n_result") > MANY_RESULTS)).alias("unselective"))
    issues = F.col("missing_aggregate") + F.col("unselective")
    stars = F.when(issues == 0, 5).when(issues <= 10, 4).when(issues <= 30, 3).otherwise(2)
    named = flags.withColumn("stars", stars)
    long = named.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in named.columns])).alias("c")).select("c.*")
    bins = A.histogram(sizes, "n_result", "quality").select(F.concat(F.lit("size "), "bin").alias("name"), F.col("n").cast("double").alias("value"))
    return long.unionByName(bins)

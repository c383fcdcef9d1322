"""Aggregations, numbering, sorts and limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparsile.catalog.registry import register
from sparsile.functions import sqltext
from sparsile.operators import aggregates as A
from sparsile.operators import enrich, numbering, retrieval, shaping
from sparsile.operators.retrieval import Condition
from sparsile.plans import sparsity, validation, workload

V = "TRY_CAST(value AS DECIMAL(30,15))"
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def coverage(t):
    return A.property_coverage(t.eav_property, t.eav_value)


def per_entity(t):
    return A.properties_per_entity(t.eav_value)


def sizes(t):
    return retrieval.result_sizes(t.samples, t.sample_result)


def rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


for _fn in ("avg", "max", "min", "sum", "count"):
    @register(f"a1_eav_{_fn}", f"SELECT round(CAST({_fn}({V}) AS DOUBLE), 4) AS value FROM eav_value WHERE property_id = 23 AND value <> ''")
    def _(t, fn=_fn):
        return rounded(retrieval.eav_agg(t.eav_value, 23, fn), "value", digits=4)


@register("a1_eav_agg_conditional", f"SELECT round(CAST(avg({V}) AS DOUBLE), 4) AS value FROM eav_value WHERE property_id = 32 AND data_id IN (SELECT data_id FROM eav_value WHERE property_id = 31 AND value = 'F')")
def _(t):
    return rounded(retrieval.eav_agg(t.eav_value, 32, "avg", [Condition(31, "str", "=", text="F")]), "value", digits=4)


@register("a1_eav_agg_all", f"SELECT property_id, round(CAST(avg({V}) AS DOUBLE), 4) AS avg, CAST(max({V}) AS DOUBLE) AS max, CAST(min({V}) AS DOUBLE) AS min, round(CAST(sum({V}) AS DOUBLE), 2) AS sum, CAST(count({V}) AS DOUBLE) AS count FROM eav_value WHERE property_id IN (4, 5, 13, 23, 32) AND value <> '' GROUP BY 1")
def _(t):
    return rounded(rounded(retrieval.eav_agg_all(t.eav_value, [4, 5, 13, 23, 32]), "avg", digits=4), "sum", digits=2)


@register("a2_count_distinct", "SELECT COUNT(DISTINCT data_id) AS entities, COUNT(DISTINCT property_id) AS properties, COUNT(DISTINCT (data_id, property_id))::BIGINT AS pairs FROM eav_value")
def _(t):
    return A.distinct_counts(t.eav_value)


@register("a3_density", """SELECT (SELECT COUNT(*) FROM eav_entity) AS num_entities, (SELECT COUNT(*) FROM eav_property) AS num_properties, COUNT(*) AS num_pairs,
round(COUNT(*) / ((SELECT COUNT(*) FROM eav_entity) * CAST((SELECT COUNT(*) FROM eav_property) AS DOUBLE)), 9) AS density FROM eav_value""")
def _(t):
    return rounded(A.density(t.eav_entity, t.eav_property, t.eav_value), "density", digits=9)


@register("a4_properties_per_entity", "SELECT data_id, property_count FROM x_per_entity")
def _(t):
    return per_entity(t)


@register("a4_entities_per_property", "SELECT property_id, entity_count FROM x_coverage")
def _(t):
    return coverage(t)


SUMMARY = "round(avg({0}), 6) AS mean, CAST(median({0}) AS DOUBLE) AS median, CAST(min({0}) AS DOUBLE) AS min, CAST(max({0}) AS DOUBLE) AS max"


@register("a5_summary_all", f"SELECT {SUMMARY.format('entity_count')} FROM x_coverage")
def _(t):
    return rounded(A.summary(coverage(t), "entity_count"), "mean")


@register("a5_summary_covered", f"SELECT {SUMMARY.format('entity_count')} FROM x_coverage WHERE entity_count > 0")
def _(t):
    return rounded(A.summary(coverage(t).filter("entity_count > 0"), "entity_count"), "mean")


@register("a5_summary_per_entity", f"SELECT {SUMMARY.format('property_count')} FROM x_per_entity")
def _(t):
    return rounded(A.summary(per_entity(t), "property_count"), "mean")


@register("a6_runtime_summary", "SELECT event_type, COUNT(value) AS n, round(avg(value), 6) AS mean_ms, round(median(value), 6) AS median_ms, min(value) AS min_ms, max(value) AS max_ms, round(CASE WHEN COUNT(value) < 20 THEN max(value) ELSE quantile_cont(value, 0.95) END, 6) AS p95_ms FROM events GROUP BY 1")
def _(t):
    return rounded(A.runtime_summary(t.events, "value", ["event_type"], max_below=20), "mean_ms", "median_ms", "p95_ms")


@register("a6_exact_percentiles", "SELECT l_returnflag, round(median(l_extendedprice), 6) AS p50, round(quantile_cont(l_extendedprice, 0.95), 6) AS p95 FROM lineitem GROUP BY 1")
def _(t):
    return rounded(numbering.exact_percentiles(t.lineitem, "l_extendedprice", ["l_returnflag"], {"p50": 0.5, "p95": 0.95}), "p50", "p95")


def _histogram_check(bins: str, source: str, col: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {i} AS ord, '{name}' AS bin, (SELECT COUNT(*) FROM {source} WHERE {col} BETWEEN {lo} AND {hi}) AS n" for i, (name, lo, hi) in enumerate(A.BINS[bins]))


for _bins, _source, _col, _build in (("properties_per_entity", "x_per_entity", "property_count", per_entity), ("entities_per_property", "x_coverage", "entity_count", coverage),
                                     ("result_size", "x_size", "n_result", sizes), ("quality", "x_size", "n_result", sizes), ("workload", "x_size", "n_result", sizes)):
    @register(f"a7_histogram_{_bins}", _histogram_check(_bins, _source, _col))
    def _(t, bins=_bins, col=_col, build=_build):
        return A.histogram(build(t), col, bins)


@register("a8_low_coverage", " UNION ALL ".join(f"SELECT {k} AS threshold, string_agg(CAST(property_id AS VARCHAR), ',' ORDER BY property_id) AS property_ids FROM x_coverage WHERE entity_count <= {k}" for k in A.LOW_COVERAGE))
def _(t):
    return A.low_coverage(coverage(t)).select("threshold", F.array_join(F.col("property_ids").cast("array<string>"), ",").alias("property_ids"))


@register("a9_query_property_coverage", r"SELECT DISTINCT CAST(u.p AS INTEGER) AS property_id, COALESCE(c.entity_count, 0) AS entity_count FROM (SELECT unnest(regexp_extract_all(sql, 'property_id\s*=\s*(\d+)', 1)) AS p FROM samples) u LEFT JOIN x_coverage c ON c.property_id = CAST(u.p AS INTEGER)")
def _(t):
    used = t.samples.select(F.explode(sqltext.property_ids(F.col("sql"), with_in=False)).alias("property_id"))
    return A.query_property_coverage(used, coverage(t))


@register("a10_first_wins", "SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS o_orderpriority, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def _(t):
    return enrich.first_wins(t.orders.select("o_custkey", "o_orderkey", "o_orderpriority"), "o_custkey", ["o_orderkey"])


@register("a10_last_wins", "SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS o_orderpriority, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def _(t):
    return enrich.last_wins(t.orders.select("o_custkey", "o_orderkey", "o_orderpriority"), "o_custkey", ["o_orderkey"])


@register("a11_entity_record", """SELECT data_id, title, string_agg(property_name || '=' || COALESCE('n' || CAST(CAST(round(TRY_CAST(value AS DOUBLE) * 100) AS BIGINT) AS VARCHAR), 't' || value), ';' ORDER BY property_name) AS data
FROM eav_entity JOIN eav_value USING (data_id) GROUP BY 1, 2""")
def _(t):
    records = enrich.entity_records(t.eav_entity, t.eav_value)
    pairs = F.transform(F.map_entries("data"), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(
        F.concat(F.lit("n"), F.round(e["value"]["number"] * 100).cast("bigint").cast("string")), F.concat(F.lit("t"), e["value"]["text"]))))
    return records.select("data_id", "title", F.array_join(F.array_sort(pairs), ";").alias("data"))


@register("a12_pivot_wide", """SELECT data_id, max(CASE WHEN property_id = 2 THEN value END) AS "2", max(CASE WHEN property_id = 4 THEN value END) AS "4", max(CASE WHEN property_id = 5 THEN value END) AS "5"
FROM eav_value WHERE property_id IN (2, 4, 5) GROUP BY 1""")
def _(t):
    return shaping.pivot_wide(t.eav_value, [2, 4, 5])


def checks(t):
    return validation.boundary_checks(t.nation_samples, t.eav_value, t.eav_entity, t.nation_result)


CHECKS = """(SELECT CAST(n_nationkey AS BIGINT) AS sample_id, 'complex' AS category, CASE n_nationkey % 5 WHEN 0 THEN 'greater' WHEN 1 THEN 'greater_equal' WHEN 2 THEN 'less' WHEN 3 THEN 'less_equal' ELSE 'range' END AS boundary,
(SELECT COUNT(*) FROM customer WHERE c_acctbal >= 0 AND c_nationkey = n_nationkey AND CASE n_nationkey % 5 WHEN 0 THEN c_acctbal > 100 * n_nationkey WHEN 1 THEN c_acctbal >= 100 * n_nationkey
WHEN 2 THEN c_acctbal < 100 * n_nationkey WHEN 3 THEN c_acctbal <= 100 * n_nationkey ELSE c_acctbal BETWEEN 100 * n_nationkey AND 100 * n_nationkey + 5000 END) AS scan_count,
(SELECT COUNT(*) FROM nation_result r WHERE r.sample_id = n_nationkey) AS gold_count FROM nation)"""
PASS_FAIL = ("CAST(SUM(CASE WHEN scan_count = gold_count THEN 1 ELSE 0 END) AS BIGINT) AS passed, CAST(SUM(CASE WHEN scan_count <> gold_count THEN 1 ELSE 0 END) AS BIGINT) AS failed, COUNT(*) AS total, "
             "min(scan_count) AS min_count, round(avg(scan_count), 6) AS avg_count, max(scan_count) AS max_count, round(avg(CASE WHEN scan_count = gold_count THEN 1.0 ELSE 0.0 END), 6) AS pass_rate")


@register("a13_pass_fail", f"SELECT category, {PASS_FAIL} FROM {CHECKS} q GROUP BY 1")
def _(t):
    return rounded(A.pass_fail(checks(t), "category"), "avg_count", "pass_rate")


@register("a14_crosstab", "SELECT o_orderstatus, " + ", ".join(f"CAST(SUM(CASE WHEN o_orderpriority = '{p}' THEN 1 ELSE 0 END) AS BIGINT) AS \"{p}\"" for p in PRIORITIES) + " FROM orders GROUP BY 1")
def _(t):
    return A.crosstab(t.orders, "o_orderstatus", "o_orderpriority", PRIORITIES)


@register("a15_audit", "SELECT COUNT(*) AS n_rows, min(data_id) AS min_id, max(data_id) AS max_id, COUNT(*) - COUNT(value) AS n_null FROM eav_value_dirty")
def _(t):
    return A.audit(t.eav_value_dirty, "data_id", "value")


@register("a16_duplicate_groups", r"SELECT trim(regexp_replace(sql, '\s+', ' ', 'g')) AS norm_sql, COUNT(*) AS n, min(sample_id) AS first_id FROM samples GROUP BY 1 HAVING COUNT(*) > 1")
def _(t):
    return workload.duplicate_groups(t.samples)


@register("a16_duplicate_documents", r"SELECT md5(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ')) AS norm_md5, COUNT(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ') HAVING COUNT(*) > 1")
def _(t):
    texts = t.documents.select(F.col("doc_id").alias("sample_id"), F.col("text").alias("sql"))
    return workload.duplicate_groups(texts).select(F.md5("norm_sql").alias("norm_md5"), "n", "first_id")


@register("a17_function_counts", "SELECT " + ", ".join(f"CAST(SUM(CASE WHEN regexp_matches(sql, '(?i)\\b{f}\\s*\\(') THEN 1 ELSE 0 END) AS BIGINT) AS {f.lower()}" for f in ("COUNT", "SUM", "AVG", "MAX", "MIN")) + " FROM samples")
def _(t):
    return workload.function_counts(t.samples)


TIDS = "(SELECT sample_id, COUNT(DISTINCT record) AS n FROM order_result JOIN part_record USING (data_id) GROUP BY 1)"


@register("a20_source_count", f"SELECT sample_id, n AS n_sources FROM {TIDS} q")
def _(t):
    attached = enrich.attach_records(t.order_result, t.part_record, "skip")
    return attached.groupBy("sample_id").agg(F.count_distinct("record").alias("n_sources"))


@register("a21_attach_status", "SELECT o_orderkey AS sample_id, CASE WHEN n IS NULL THEN 'empty' WHEN n = f THEN 'full' ELSE 'partial' END AS status FROM orders LEFT JOIN (SELECT sample_id, COUNT(*) AS n, COUNT(record) AS f FROM order_result LEFT JOIN part_record USING (data_id) GROUP BY 1) q ON q.sample_id = o_orderkey")
def _(t):
    attached = enrich.attach_records(t.order_result, t.part_record).select("sample_id", F.col("record").isNotNull().alias("found"))
    return enrich.attach_status(t.orders.select(F.col("o_orderkey").alias("sample_id")), attached)


# ---- numbering, order, limits ----------------------------------------------

@register("w1_dataset_id", "SELECT data_id, title, printf('%04d', dense_rank() OVER (ORDER BY title)) AS dataset_id FROM eav_entity")
def _(t):
    return numbering.assign_dataset_id(t.eav_entity).select("data_id", "title", "dataset_id")


@register("w2_id_collision", """SELECT l_orderkey, rank_no, CASE WHEN d = 1 THEN k ELSE (SELECT max(l_partkey) FROM lineitem) + row_number() OVER (PARTITION BY d > 1 ORDER BY o) END AS data_id FROM (
SELECT *, row_number() OVER (PARTITION BY k ORDER BY o) AS d FROM (SELECT l_orderkey, l_partkey AS k, rank_no, l_orderkey * 1000000 + rank_no AS o FROM (
SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rank_no FROM lineitem) a) b) c""")
def _(t):
    rows = t.order_result.select(F.col("sample_id").alias("l_orderkey"), F.col("pos").cast("bigint").alias("rank_no"), ((F.col("data_id") - 1000000) / 4).cast("bigint").alias("data_id"))
    return numbering.resolve_id_collisions(rows, "data_id", ["l_orderkey", "rank_no"]).select("l_orderkey", "rank_no", "data_id")


def scored(t):
    return t.samples.withColumn("score", F.when(F.contains("natural_language", F.lit("Brand")), 5).otherwise(F.length("natural_language") % 3))


SCORED = "(SELECT sample_id, trim(regexp_replace(sql, '\\s+', ' ', 'g')) AS q, CASE WHEN contains(natural_language, 'Brand') THEN 5 ELSE length(natural_language) % 3 END AS score FROM samples)"


@register("w3_best_of_group", f"SELECT sample_id FROM (SELECT *, rank() OVER (PARTITION BY q ORDER BY score DESC) AS r FROM {SCORED} a) b WHERE r = 1")
def _(t):
    return workload.best_of_group(scored(t)).select("sample_id")


@register("w3_best_of_group_v2", f"SELECT sample_id FROM (SELECT *, rank() OVER (PARTITION BY q ORDER BY score DESC) AS r, row_number() OVER (PARTITION BY q ORDER BY score DESC, sample_id DESC) AS n FROM {SCORED} a) b WHERE r = 1 AND (score > 0 OR n = 1)")
def _(t):
    return workload.best_of_group(scored(t), 2).select("sample_id")


@register("w4_reindex", "SELECT row_number() OVER (ORDER BY sample_id) AS sample_id, md5(natural_language) AS nl FROM samples WHERE sql <> ''")
def _(t):
    return numbering.reindex(t.samples.filter("sql != ''")).select("sample_id", F.md5("natural_language").alias("nl"))


@register("w5_rank_frequency", "SELECT property_id, entity_count, CAST(row_number() OVER (ORDER BY entity_count DESC, property_id) AS INTEGER) AS rank FROM x_coverage WHERE entity_count > 0")
def _(t):
    return numbering.rank_frequency(coverage(t))


@register("w6_cdf", "SELECT property_count, COUNT(*) AS n, round((SUM(COUNT(*)) OVER (ORDER BY property_count) - COUNT(*) + 1) / SUM(COUNT(*)) OVER (), 9) AS cdf_first, round(CAST(SUM(COUNT(*)) OVER (ORDER BY property_count) AS DOUBLE) / SUM(COUNT(*)) OVER (), 9) AS cdf FROM x_per_entity GROUP BY 1")
def _(t):
    return rounded(numbering.cdf(per_entity(t), "property_count"), "cdf_first", "cdf", digits=9)


@register("w6_cdf_rows", "SELECT data_id, property_count, round(CAST(row_number() OVER (ORDER BY property_count, data_id) AS DOUBLE) / COUNT(*) OVER (), 9) AS cdf FROM x_per_entity")
def _(t):
    return rounded(numbering.cdf_rows(per_entity(t), "property_count", "data_id"), "cdf", digits=9)


@register("w7_value_id", "SELECT data_id, property_id, row_number() OVER (ORDER BY data_id, property_id) AS value_id FROM eav_value")
def _(t):
    return numbering.surrogate_value_id(t.eav_value).select("data_id", "property_id", "value_id")


@register("o1_sort_ids", "SELECT data_id FROM eav_value WHERE property_id = 13 ORDER BY 1")
def _(t):
    return retrieval.sort_ids(retrieval.has_property(t.eav_value, 13).select("data_id"))


@register("o2_by_coverage", "SELECT property_id, entity_count FROM x_coverage ORDER BY entity_count DESC, property_id")
def _(t):
    return A.by_coverage(coverage(t))


@register("o3_top_k_sources", "SELECT source, COUNT(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, source LIMIT 10")
def _(t):
    return A.top_k_sources(t.documents, "source", 10)


@register("o4_head", "SELECT data_id, value FROM eav_value WHERE property_id = 32 ORDER BY data_id LIMIT 10")
def _(t):
    return A.head(retrieval.has_property(t.eav_value, 32).select("data_id", "value"), 10, "data_id")


TOP_N = "SELECT sample_id, data_id, CAST(pos AS INTEGER) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY data_id) AS pos FROM sample_result) q WHERE pos <= {}"


@register("o5_top_n_per_sample", TOP_N.format(50))
def _(t):
    return enrich.result_positions(t.sample_result, 50)


@register("o6_check_first", TOP_N.format(5))
def _(t):
    return enrich.result_positions(t.sample_result, 5)


@register("o7_first_missing", "SELECT DISTINCT data_id FROM order_result WHERE data_id NOT IN (SELECT data_id FROM part_record) ORDER BY 1 LIMIT 20")
def _(t):
    return enrich.missing_ids(t.order_result, t.part_record).limit(20)


# ---- reports ---------------------------------------------------------------

_STAT = "SELECT '{s}' AS section, unnest(['mean', 'median', 'min', 'max']) AS name, unnest([round(avg({c}), 6), CAST(median({c}) AS DOUBLE), CAST(min({c}) AS DOUBLE), CAST(max({c}) AS DOUBLE)]) AS value FROM {t}"
_BIN = lambda section, bins, source, col: " UNION ALL ".join(f"SELECT '{section}', '{n}', CAST(COUNT(*) AS DOUBLE) FROM {source} WHERE {col} BETWEEN {lo} AND {hi}" for n, lo, hi in A.BINS[bins])


@register("v6_sparsity_report", " UNION ALL ".join([
    "SELECT 'counts' AS section, unnest(['num_entities', 'num_properties', 'num_pairs', 'density']) AS name, unnest([e, p, v, round(v / (e * p), 6)]) AS value FROM (SELECT CAST((SELECT COUNT(*) FROM eav_entity) AS DOUBLE) AS e, CAST((SELECT COUNT(*) FROM eav_property) AS DOUBLE) AS p, CAST((SELECT COUNT(*) FROM eav_value) AS DOUBLE) AS v) q",
    _STAT.format(s="properties_per_entity", c="property_count", t="x_per_entity"),
    _BIN("properties_per_entity_histogram", "properties_per_entity", "x_per_entity", "property_count"),
    _STAT.format(s="entities_per_property", c="entity_count", t="x_coverage"),
    _STAT.format(s="covered_entities_per_property", c="entity_count", t="x_coverage WHERE entity_count > 0"),
    _BIN("entities_per_property_histogram", "entities_per_property", "x_coverage", "entity_count"),
    *[f"SELECT 'low_coverage', '<={k}', CAST(COUNT(*) AS DOUBLE) FROM x_coverage WHERE entity_count <= {k}" for k in A.LOW_COVERAGE],
    r"SELECT 'query_property_coverage', CAST(property_id AS VARCHAR), CAST(entity_count AS DOUBLE) FROM x_coverage WHERE property_id IN (SELECT CAST(unnest(regexp_extract_all(sql, 'property_id\s*=\s*(\d+)', 1)) AS INTEGER) FROM samples)",
    _STAT.format(s="result_size", c="n_result", t="x_size"),
    _BIN("result_size_histogram", "result_size", "x_size", "n_result")]))
def _(t):
    return rounded(sparsity.sparsity_report(t.eav_entity, t.eav_property, t.eav_value, t.samples, t.sample_result), "value")


@register("v1_boundary_report", f"SELECT boundary, {PASS_FAIL} FROM {CHECKS} q GROUP BY 1")
def _(t):
    return rounded(validation.boundary_report(checks(t)), "avg_count", "pass_rate")


@register("v1_boundary_failures", f"SELECT sample_id, category, boundary, scan_count, gold_count FROM {CHECKS} q WHERE scan_count <> gold_count")
def _(t):
    return checks(t).filter(~F.col("passed")).drop("passed")

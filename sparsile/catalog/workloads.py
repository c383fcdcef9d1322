"""Query and text features, validation, scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparsile.catalog.registry import register
from sparsile.catalog.retrieving import MYSQL, PREFIX, region_queries
from sparsile.functions import numeric, phrases, sqltext
from sparsile.operators import matching, retrieval, scoring
from sparsile.plans import validation, workload

AGG = r"(?i)\b(AVG|MAX|MIN|SUM|COUNT)\s*\("


def rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def sizes(t):
    return retrieval.result_sizes(t.samples, t.sample_result)


def count_of(pattern: str, column: str = "sql") -> str:
    return f"CAST(len(regexp_extract_all({column}, '{pattern}')) AS INTEGER)"


# ---- values ----------------------------------------------------------------

@register("t1_to_decimal", f"""SELECT data_id, property_id, round(CAST(TRY_CAST(value AS DECIMAL(30,15)) AS DOUBLE), 6) AS strict,
round(CAST({PREFIX.format('value')} AS DOUBLE), 6) AS prefix, round(CAST({MYSQL.format('value')} AS DOUBLE), 6) AS mysql FROM eav_value_dirty""")
def _(t):
    return t.eav_value_dirty.select("data_id", "property_id", *[F.round(numeric.to_decimal(F.col("value"), m).cast("double"), 6).alias(m) for m in ("strict", "prefix", "mysql")])


@register("t1_any_value", f"SELECT data_id FROM eav_value_dirty WHERE property_id = 5 AND EXISTS (SELECT 1 FROM (SELECT unnest(string_split(value, '|')) AS p) u WHERE {PREFIX.format('p')} > 12.5)")
def _(t):
    return retrieval.any_value(t.eav_value_dirty, 5, ">", 12.5).select("data_id")


@register("t2_json_scalar", """SELECT o_orderkey, CAST(CAST(CASE WHEN o_orderkey % 2 = 0 THEN floor(o_totalprice) ELSE floor(o_totalprice) + 0.5 END AS DECIMAL(18,1)) AS VARCHAR) LIKE '%.0' AS whole,
CASE WHEN o_orderkey % 2 = 0 THEN CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || '.5' END AS number,
o_orderpriority AS bytes, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS stamp FROM orders""")
def _(t):
    exact = (F.floor("o_totalprice") + F.when(F.col("o_orderkey") % 2 == 0, 0.0).otherwise(0.5)).cast("decimal(18,1)")
    return t.orders.select("o_orderkey", (exact == F.floor(exact)).alias("whole"), numeric.json_scalar(exact, "decimal").alias("number"),
                           numeric.json_scalar(F.encode("o_orderpriority", "UTF-8"), "bytes").alias("bytes"), numeric.json_scalar(F.col("o_orderdate"), "datetime").alias("stamp"))


@register("t3_num_or_text", "SELECT data_id, property_id, TRY_CAST(value AS DOUBLE) AS number, CASE WHEN TRY_CAST(value AS DOUBLE) IS NULL THEN COALESCE(value, '') END AS text FROM eav_value_dirty")
def _(t):
    number, text = numeric.num_or_text(F.col("value"))
    return t.eav_value_dirty.select("data_id", "property_id", number.alias("number"), text.alias("text"))


@register("t4_flatten_result", "SELECT sample_id, CAST(pos AS INTEGER) AS pos, '[' || data_id || ',' || pos || ']' AS item, CAST(data_id AS VARCHAR) AS single FROM order_result")
def _(t):
    return t.order_result.select("sample_id", F.col("pos").cast("int").alias("pos"), numeric.flatten_result([F.col("data_id"), F.col("pos")]).alias("item"), numeric.flatten_result([F.col("data_id")]).alias("single"))


@register("t17_satisfies", f"SELECT data_id, property_id, op, CASE WHEN TRY_CAST(value AS DOUBLE) IS NULL THEN NULL WHEN op = '>' THEN TRY_CAST(value AS DOUBLE) > 950 WHEN op = 'BETWEEN' THEN TRY_CAST(value AS DOUBLE) BETWEEN 910 AND 920 WHEN op = '=' THEN abs(TRY_CAST(value AS DOUBLE) - 910) < 1e-3 ELSE abs(TRY_CAST(value AS DOUBLE) - 910) > 1e-3 END AS ok FROM eav_value_dirty, (VALUES ('>'), ('BETWEEN'), ('='), ('!=')) o(op)")
def _(t):
    rows = t.eav_value_dirty.withColumn("op", F.explode(F.array(*map(F.lit, (">", "BETWEEN", "=", "!=")))))
    a = F.when(F.col("op") == ">", 950.0).otherwise(910.0)
    return rows.select("data_id", "property_id", "op", numeric.satisfies(F.col("value"), F.col("op"), a, F.lit(920.0)).alias("ok"))


@register("t20_percent", "SELECT l_returnflag, printf('%.1f%%', 100.0 * CAST(SUM(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*)) AS share FROM lineitem GROUP BY 1")
def _(t):
    counts = t.lineitem.groupBy("l_returnflag").agg(F.count_if(F.col("l_quantity") > 25).alias("p"), F.count(F.lit(1)).alias("n"))
    return counts.select("l_returnflag", numeric.percent(F.col("p"), F.col("n")).alias("share"))


# ---- query text ------------------------------------------------------------

@register("t5_repair_sql", "SELECT sample_id, regexp_replace(rtrim(replace(replace(replace(replace(sql, '< =', '<='), '> =', '>='), '! =', '!='), 'eav.', 'lake.'), ' '), ';+$', '') AS sql FROM samples")
def _(t):
    return t.samples.select("sample_id", sqltext.repair_sql(F.col("sql"), {"eav.": "lake."}).alias("sql"))


@register("t6_is_aggregation", f"SELECT sample_id, regexp_matches(sql, '{AGG}') AS is_agg FROM samples")
def _(t):
    return t.samples.select("sample_id", sqltext.is_aggregation(F.col("sql")).alias("is_agg"))


PIDS = r"list_distinct(regexp_extract_all(sql, 'property_id\s*=\s*(\d+)', 1))"
VJOINS = r"len(regexp_extract_all(sql, '(?i)JOIN\s+[\w.]+\.value_table'))"
CLASS_A = rf"CASE WHEN regexp_matches(sql, '(?i)\b(AVG|MAX|MIN)\s*\(') THEN 'aggregated' WHEN {VJOINS} >= 2 OR len({PIDS}) >= 2 OR regexp_matches(sql, '(?i)\(\s*SELECT\b') THEN 'complex' ELSE 'simple' END"


@register("t7_classify_query", rf"SELECT sample_id, {CLASS_A} AS a, CASE WHEN regexp_matches(sql, '{AGG}') THEN 'aggregated' WHEN {VJOINS} >= 2 OR len({PIDS}) >= 2 THEN 'complex' ELSE 'simple' END AS b, CASE WHEN regexp_matches(sql, '(?i)(AVG|MAX|MIN|SUM|COUNT)\(') THEN 'aggregated' WHEN len(regexp_extract_all(sql, '(?i)property_id\s*=')) = 1 AND n_result <= 1 THEN 'simple' ELSE 'complex' END AS c FROM samples JOIN x_size USING (sample_id)")
def _(t):
    sql = F.col("sql")
    return t.samples.join(sizes(t), "sample_id").select("sample_id", sqltext.classify_query(sql, "a").alias("a"), sqltext.classify_query(sql, "b").alias("b"),
                                                         sqltext.classify_query(sql, "c", F.col("n_result")).alias("c"))


@register("t8_keyword_counts", rf"SELECT sample_id, {count_of(r'(?i)\bJOIN\b')} AS n_joins, {count_of(r'(?i)\bWHERE\b')} AS n_where FROM samples")
def _(t):
    return t.samples.select("sample_id", sqltext.count_joins(F.col("sql")).alias("n_joins"), sqltext.count_where(F.col("sql")).alias("n_where"))


@register("t9_property_ids", r"""SELECT sample_id, array_to_string(list_sort(list_distinct([CAST(x AS INTEGER) FOR x IN list_concat(regexp_extract_all(sql, 'property_id\s*=\s*(\d+)', 1),
regexp_extract_all(array_to_string(regexp_extract_all(sql, '(?i)property_id\s+IN\s*\(([^)]+)\)', 1), ','), '(\d+)', 1))])), ',') AS ids FROM samples""")
def _(t):
    return t.samples.select("sample_id", F.array_join(sqltext.property_ids(F.col("sql")).cast("array<string>"), ",").alias("ids"))


@register("t10_has_subquery", r"SELECT sample_id, regexp_matches(sql, '(?i)\(\s*SELECT\b') AS has_subquery FROM samples")
def _(t):
    return t.samples.select("sample_id", sqltext.has_subquery(F.col("sql")).alias("has_subquery"))


WHERE = r"regexp_extract(sql, '(?is)WHERE(.*?)(ORDER BY|GROUP BY|LIMIT|;|$)', 1)"


@register("t11_where_conditions", rf"SELECT sample_id, CASE WHEN trim({WHERE}) = '' THEN 0 ELSE 1 + len(regexp_extract_all(regexp_replace({WHERE}, '''[^'']*''', '', 'g'), '(?i)\b(AND|OR)\b')) END::INTEGER AS n FROM samples")
def _(t):
    return t.samples.select("sample_id", sqltext.count_where_conditions(F.col("sql")).alias("n"))


# expected predicate counts by query form
FILTERS = r"""CAST(CASE WHEN sql = '' THEN 0 WHEN contains(sql, 'MAX(') THEN 1 WHEN contains(sql, 'AVG(') THEN 2 WHEN contains(sql, 'BETWEEN') THEN 8 WHEN contains(sql, 'NOT LIKE') THEN 4
WHEN contains(sql, '( SELECT') THEN 2 WHEN contains(sql, ' OR ') THEN 2 WHEN contains(sql, ' IN (4') THEN 2 WHEN contains(sql, 'v.property_id = 2 ') THEN 2 WHEN contains(sql, 'v2.') THEN 8 ELSE 4 END AS INTEGER)"""


@register("t12_filter_conditions", f"SELECT sample_id, {FILTERS} AS n FROM samples")
def _(t):
    return t.samples.select("sample_id", sqltext.filter_condition_count(F.col("sql")).alias("n"))


@register("t13_boundary_types", r"""SELECT sample_id, array_to_string(list_concat(CASE WHEN regexp_matches(sql, 'BETWEEN\s+[0-9.]+\s+AND') THEN ['range'] ELSE [] END,
[CASE x WHEN '>' THEN 'greater' WHEN '>=' THEN 'greater_equal' WHEN '<' THEN 'less' ELSE 'less_equal' END FOR x IN list_distinct(regexp_extract_all(CASE WHEN contains(sql, 'DECIMAL') THEN replace(sql, '<>', '!=') ELSE '' END, '(>=|<=|>|<)\s*[0-9]', 1))]), ',') AS kinds FROM nation_samples""")
def _(t):
    return t.nation_samples.select("sample_id", F.array_join(sqltext.boundary_types(F.col("sql")), ",").alias("kinds"))


@register("t13_boundary_flags", r"""SELECT sample_id, contains(sql, 'DECIMAL') AND regexp_matches(replace(sql, '<>', '!='), '>\s*[0-9]') AS greater, contains(sql, 'DECIMAL') AND regexp_matches(replace(sql, '<>', '!='), '<\s*[0-9]') AS less FROM samples""")
def _(t):
    kinds = sqltext.boundary_types(F.col("sql"))
    return t.samples.select("sample_id", F.array_contains(kinds, "greater").alias("greater"), F.array_contains(kinds, "less").alias("less"))


@register("t14_extract_conditions", """
SELECT sample_id, 'v' AS alias, 22 AS property_id, 'str' AS kind, '=' AS op, CAST(NULL AS DOUBLE) AS lo, CAST(NULL AS DOUBLE) AS hi, CAST(sample_id AS VARCHAR) AS text FROM nation_samples
UNION ALL SELECT sample_id, 'v2', 23, 'non_empty', NULL, NULL, NULL, NULL FROM nation_samples
UNION ALL SELECT sample_id, 'v2', 23, 'not_null', NULL, NULL, NULL, NULL FROM nation_samples
UNION ALL SELECT sample_id, 'v2', 23, CASE sample_id % 5 WHEN 4 THEN 'between' ELSE 'num' END, CASE sample_id % 5 WHEN 0 THEN '>' WHEN 1 THEN '>=' WHEN 2 THEN '<' WHEN 3 THEN '<=' END,
CAST(100 * sample_id AS DOUBLE), CASE sample_id % 5 WHEN 4 THEN CAST(100 * sample_id + 5000 AS DOUBLE) END, NULL FROM nation_samples""")
def _(t):
    rows = matching.extract_conditions(t.nation_samples)
    return rows.select("sample_id", "alias", "property_id", "kind", "op", F.col("lo").cast("double").alias("lo"), F.col("hi").cast("double").alias("hi"), "text")


@register("t14_condition_kinds", """SELECT sample_id, array_to_string(r, ',') AS r FROM (SELECT p_partkey AS sample_id, unnest(CASE WHEN p_size <= 5 THEN [[0,5,1],[0,5,2],[0,5,3]] WHEN p_size <= 10 THEN [[0,4,1],[0,4,2],[0,4,4],[0,5,1],[0,5,2],[0,5,3]] WHEN p_size <= 14 THEN [[0,5,3]] WHEN p_size <= 17 THEN [[0,4,5]]
WHEN p_size <= 21 THEN [[0,2,6]] WHEN p_size <= 24 THEN [[0,5,1],[0,5,2],[0,5,3]] WHEN p_size <= 27 THEN [[0,5,1],[0,5,2],[0,5,3]] WHEN p_size <= 30 THEN [[0,3,6],[0,2,7]] WHEN p_size <= 33 THEN [[0,1,5],[0,4,8]]
WHEN p_size <= 36 THEN [[0,4,8],[0,5,8]] WHEN p_size <= 40 THEN [[0,5,3],[1,5,3]] WHEN p_size <= 44 THEN [[0,5,1],[0,5,2],[0,5,3]] WHEN p_size <= 46 THEN [] ELSE [[0,5,1],[0,5,2],[0,5,3],[0,5,1],[0,5,2],[0,5,3]] END) AS r FROM part) q""")
def _(t):
    repaired = t.samples.withColumn("sql", sqltext.repair_sql(F.col("sql")))
    code = F.create_map(*[F.lit(x) for kv in {"non_empty": 1, "not_null": 2, "num": 3, "between": 4, "any": 5, "str": 6, "not_like": 7, "bare": 8}.items() for x in kv])
    return matching.extract_conditions(repaired).select("sample_id", F.concat_ws(",", F.array(F.col("clause"), F.col("property_id"), F.element_at(code, F.col("kind"))).cast("array<string>")).alias("r"))


# ---- question text ---------------------------------------------------------

@register("t15_text_conditions", """SELECT p_partkey AS sample_id, u.property_id, u.op, u.lo, u.hi, u.text FROM (SELECT *, CAST(round(p_retailprice, 2) AS DOUBLE) AS r, CAST(p_size AS DOUBLE) AS s FROM part) q, LATERAL (SELECT unnest(CASE
WHEN p_size <= 5 THEN [{'property_id': 5, 'op': '>', 'lo': r, 'hi': NULL, 'text': NULL}]
WHEN p_size <= 10 THEN [{'property_id': 4, 'op': 'BETWEEN', 'lo': s, 'hi': s + 10, 'text': NULL}, {'property_id': 5, 'op': '>=', 'lo': r, 'hi': NULL, 'text': NULL}]
WHEN p_size <= 14 THEN [{'property_id': 5, 'op': '<', 'lo': r, 'hi': NULL, 'text': NULL}] WHEN p_size <= 17 THEN []
WHEN p_size <= 21 THEN [{'property_id': 2, 'op': '=', 'lo': NULL, 'hi': NULL, 'text': CASE WHEN p_retailprice > 950 THEN p_brand ELSE 'other' END}]
WHEN p_size <= 24 THEN [{'property_id': 5, 'op': '>', 'lo': 0.0, 'hi': NULL, 'text': NULL}] WHEN p_size <= 27 THEN [{'property_id': 5, 'op': '<=', 'lo': r, 'hi': NULL, 'text': NULL}]
WHEN p_size <= 30 THEN [] WHEN p_size <= 33 THEN [{'property_id': 4, 'op': '>', 'lo': s, 'hi': NULL, 'text': NULL}] WHEN p_size <= 36 THEN [] WHEN p_size <= 40 THEN [{'property_id': 5, 'op': '>', 'lo': r, 'hi': NULL, 'text': NULL}]
WHEN p_size <= 44 THEN [{'property_id': 5, 'op': '>', 'lo': r, 'hi': NULL, 'text': NULL}] WHEN p_size <= 46 THEN []
ELSE [{'property_id': 5, 'op': '>', 'lo': 910.0, 'hi': NULL, 'text': NULL}, {'property_id': 5, 'op': '<', 'lo': r, 'hi': NULL, 'text': NULL}] END, recursive := true)) u""")
def _(t):
    found = matching.text_conditions(t.samples, t.terms, text="natural_language")
    return found.select("sample_id", "property_id", "op", F.col("lo").cast("double").alias("lo"), F.col("hi").cast("double").alias("hi"), "text")


@register("t15_dataset_override", """SELECT CAST(n_nationkey AS BIGINT) AS sample_id, 23 AS property_id, CASE n_nationkey % 5 WHEN 0 THEN '>' WHEN 1 THEN '>=' WHEN 2 THEN '>' WHEN 3 THEN '<=' ELSE 'BETWEEN' END AS op, CAST(100 * n_nationkey AS DOUBLE) AS lo FROM nation
UNION ALL SELECT CAST(n_nationkey AS BIGINT), 22, '=', n_nationkey FROM nation""")
def _(t):
    found = matching.text_conditions(t.nation_samples, t.terms, text="natural_language")
    return found.select("sample_id", "property_id", "op", F.col("lo").cast("double").alias("lo"))


@register("t15_condition_results", """SELECT n.sample_id, COUNT(v.data_id) AS n_result FROM nation_samples n LEFT JOIN (SELECT c_nationkey, c_custkey AS data_id, c_acctbal AS b FROM customer WHERE c_acctbal >= 0) v ON v.c_nationkey = n.sample_id AND
CASE n.sample_id % 5 WHEN 0 THEN b > 100 * n.sample_id WHEN 1 THEN b >= 100 * n.sample_id WHEN 2 THEN b > 100 * n.sample_id WHEN 3 THEN b <= 100 * n.sample_id ELSE b BETWEEN 100 * n.sample_id AND 100 * n.sample_id + 5000 END GROUP BY 1""")
def _(t):
    found = matching.text_conditions(t.nation_samples, t.terms, text="natural_language")
    predicates = matching.as_predicates(found)
    return retrieval.result_sizes(t.nation_samples, retrieval.evaluate_predicates(t.eav_value, predicates, t.eav_entity))


@register("t16_op_words", "SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN '>=' WHEN 1 THEN '>' WHEN 2 THEN '<=' WHEN 3 THEN '<' WHEN 4 THEN '=' ELSE '>' END AS op FROM part")
def _(t):
    word = F.element_at(F.array(*map(F.lit, ("不小于", "超出", "不超过", "少于", "等于", "大于"))), F.col("p_size") % 6 + 1)
    return t.part.select("p_partkey", phrases.op_word_to_op(word).alias("op"))


@register("t18_zero_threshold", r"SELECT sample_id, regexp_replace(sql, '(DECIMAL\(30, 15\)\) >) 0\.0', '\1 0.1') AS sql, replace(natural_language, '大于0的', '大于0.1的') AS natural_language FROM samples")  # 大于0.5 stays
def _(t):
    nl = F.col("natural_language")
    return t.samples.select("sample_id", sqltext.rewrite_zero_threshold(F.col("sql")).alias("sql"),
                            sqltext.rewrite_zero_phrase(nl).alias("natural_language"))


@register("t19_match_score", r"""SELECT sample_id, CAST(CASE WHEN p_size <= 5 THEN 8 WHEN p_size <= 10 THEN 18 WHEN p_size <= 14 THEN 8 WHEN p_size <= 17 THEN 0 WHEN p_size <= 21 THEN CASE WHEN p_retailprice > 950 THEN 5 ELSE 0 END
WHEN p_size <= 24 THEN 8 WHEN p_size <= 30 THEN 0 WHEN p_size <= 33 THEN 0 WHEN p_size <= 36 THEN 0 WHEN p_size <= 40 THEN 13 WHEN p_size <= 44 THEN 5 WHEN p_size <= 46 THEN 0 ELSE 13 END AS INTEGER) AS score
FROM samples JOIN part ON p_partkey = sample_id""")
def _(t):
    return workload.match_score(t.samples).select("sample_id", "score")


@register("t21_count_numbers", rf"SELECT sample_id, {count_of(r'\d+\.?\d*', 'natural_language')} AS n FROM samples")
def _(t):
    return t.samples.select("sample_id", phrases.count_numbers(F.col("natural_language")).alias("n"))


@register("t22_condition_to_sql", """SELECT sample_id, 'SELECT DISTINCT e.data_id FROM eav.entity_table e JOIN eav.value_table v ON v.data_id = e.data_id JOIN eav.value_table v2 ON v2.data_id = e.data_id WHERE v.property_id = 22 AND v.value != '''' AND v.value IS NOT NULL AND CAST(v.value AS DECIMAL(30, 15)) = ' || sample_id ||
' AND v2.property_id = 23 AND v2.value != '''' AND v2.value IS NOT NULL AND CAST(v2.value AS DECIMAL(30, 15)) ' || CASE sample_id % 5 WHEN 0 THEN '> ' WHEN 1 THEN '>= ' WHEN 2 THEN '> ' WHEN 3 THEN '<= ' ELSE 'BETWEEN ' END || 100 * sample_id || CASE sample_id % 5 WHEN 4 THEN ' AND ' || (100 * sample_id + 5000) ELSE '' END || ' ORDER BY e.data_id ASC' AS sql FROM nation_samples""")
def _(t):
    return matching.conditions_to_sql(matching.text_conditions(t.nation_samples, t.terms, text="natural_language"), "eav")


# ---- workload reports ------------------------------------------------------

STATS = rf"""SELECT {CLASS_A} AS category, COUNT(*) AS samples, round(avg({count_of(r'(?i)\bJOIN\b')}), 6) AS avg_joins, min({count_of(r'(?i)\bJOIN\b')}) AS min_joins, max({count_of(r'(?i)\bJOIN\b')}) AS max_joins,
round(avg({count_of(r'(?i)\bWHERE\b')}), 6) AS avg_where, round(avg({FILTERS}), 6) AS avg_filters, min({FILTERS}) AS min_filters, max({FILTERS}) AS max_filters, round(avg(len({PIDS})), 6) AS avg_props, CAST(median(n_result) AS DOUBLE) AS median_result,
COALESCE(CAST(len(list_distinct(flatten(list({PIDS})))) AS BIGINT), 0) AS distinct_props FROM samples JOIN x_size USING (sample_id) GROUP BY 1"""


@register("a18_workload_stats", STATS)
def _(t):
    return rounded(workload.workload_stats(t.samples, sizes(t)), "avg_joins", "avg_where", "avg_filters", "avg_props")


AGREE = rf"SELECT {CLASS_A} AS category, COUNT(*) AS n, round(avg(CASE WHEN regexp_matches(natural_language, '平均|最大|最小|统计') THEN 1.0 ELSE 0.0 END), 6) AS agg_share, round(avg(CASE WHEN regexp_matches(natural_language, '且|同时|并且|以及|都|分别') THEN 1.0 ELSE 0.0 END), 6) AS multi_share FROM samples GROUP BY 1"


@register("a19_keyword_agreement", AGREE)
def _(t):
    return rounded(workload.keyword_agreement(t.samples), "agg_share", "multi_share")


@register("a22_operator_class", r"SELECT CASE WHEN regexp_matches(sql, '(?i)COUNT|SUM|AVG|MAX|MIN|GROUP BY|HAVING') THEN 'aggregate' WHEN regexp_matches(regexp_replace(sql, '''[^'']*''', '', 'g'), '[<>]|BETWEEN') THEN 'other' ELSE 'equality_only' END AS operator_class, COUNT(*) AS n FROM samples GROUP BY 1")
def _(t):
    return workload.operator_class_counts(t.samples)


@register("v2_review_queries", rf"""
SELECT sample_id, 'missing_sql' AS issue FROM samples WHERE sql = ''
UNION ALL SELECT sample_id, 'empty_suspicious' FROM samples JOIN x_size USING (sample_id) WHERE sql <> '' AND n_result = 0
UNION ALL SELECT sample_id, 'duplicate_property' FROM samples WHERE len(regexp_extract_all(sql, 'property_id\s*=\s*(\d+)', 1)) <> len({PIDS})
UNION ALL SELECT sample_id, 'op_mismatch' FROM samples JOIN part ON p_partkey = sample_id WHERE p_size BETWEEN 41 AND 44 OR (p_size > 46 AND p_retailprice = 910)""")
def _(t):
    return validation.review_queries(t.samples, sizes(t))


@register("v3_operator_direction", """SELECT p_partkey AS sample_id, '大于' AS word, CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR) AS value, '<' AS query_op FROM part WHERE p_size BETWEEN 41 AND 44
""" + "UNION ALL SELECT p_partkey, '低于', CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR), '>' FROM part WHERE p_size > 46 AND p_retailprice = 910")
def _(t):
    return validation.operator_direction(t.samples)


# stored rows of the customers of another nation: some break the balance test
SHIFTED = "SELECT CAST(n_nationkey AS BIGINT) AS sample_id, 1000002 + 4 * c_custkey AS data_id FROM {nation} JOIN {customer} ON c_nationkey = n_nationkey WHERE n_regionkey <> 2"
TEST = "CASE n_nationkey % 5 WHEN 0 THEN b > t WHEN 1 THEN b >= t WHEN 2 THEN b < t WHEN 3 THEN b <= t ELSE b BETWEEN t AND t + 5000 END"


@register("v4_verify_results", f"""SELECT CAST(n_nationkey AS BIGINT) AS sample_id, 'value_violation' AS issue, COUNT(*) AS n FROM (SELECT n_nationkey, 100 * n_nationkey AS t, c_acctbal AS b FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_regionkey <> 2 AND c_acctbal >= 0) q WHERE NOT {TEST} GROUP BY 1
UNION ALL SELECT CAST(n_nationkey AS BIGINT), 'empty_data', 1 FROM nation WHERE n_regionkey = 2 OR n_nationkey NOT IN (SELECT c_nationkey FROM customer)""")
def _(t):
    return validation.verify_results(t.nation_samples, t.sql(SHIFTED), t.eav_value)


# stored customers of each nation against a balance outside a band, and a text that cannot be read
BANDS = """SELECT CAST(n_nationkey AS BIGINT) AS sample_id, CASE WHEN n_nationkey = 24 THEN 'SELECT v.data_id FROM eav.value_table v WHERE v.property_id = 23 AND floor(v.value) = 1' ELSE
'SELECT v.data_id FROM eav.value_table v JOIN eav.value_table v2 ON v2.data_id = v.data_id WHERE v.property_id = 24 AND v.value <> ''BUILDING'' AND v2.property_id = 23 AND (v2.value > 6000 OR v2.value < 2000)' END AS sql FROM {nation}"""


@register("v4_clauses_and_texts", """SELECT CAST(c_nationkey AS BIGINT) AS sample_id, 'value_violation' AS issue, COUNT(*) AS n FROM customer WHERE c_nationkey < 24 AND (c_mktsegment = 'BUILDING' OR c_acctbal BETWEEN 2000 AND 6000) GROUP BY 1
UNION ALL SELECT 24, 'unparsed', 1
UNION ALL SELECT CAST(n_nationkey AS BIGINT), 'empty_data', 1 FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer)
UNION ALL SELECT CAST(n_nationkey AS BIGINT), 'count_mismatch', 3 FROM nation WHERE n_regionkey = 1""")
def _(t):
    stored = t.customer.select(F.col("c_nationkey").cast("bigint").alias("sample_id"), (1000002 + 4 * F.col("c_custkey")).alias("data_id"))
    counts = t.nation.join(stored, F.col("sample_id") == F.col("n_nationkey"), "left").groupBy("n_nationkey", "n_regionkey").agg(F.count("data_id").alias("n"))
    declared = counts.select(F.col("n_nationkey").cast("bigint").alias("sample_id"), (F.col("n") + F.when(F.col("n_regionkey") == 1, 3).otherwise(0)).alias("n"))
    return validation.verify_results(t.sql(BANDS), stored, t.eav_value, declared)


@register("v5_quality_overview", r"""SELECT unnest(['mean_size', 'missing_aggregate', 'unselective', 'stars']) AS name, unnest([round(m, 6), CAST(a AS DOUBLE), CAST(u AS DOUBLE), CASE WHEN a + u = 0 THEN 5.0 WHEN a + u <= 10 THEN 4.0 WHEN a + u <= 30 THEN 3.0 ELSE 2.0 END]) AS value FROM (
SELECT avg(n_result) AS m, SUM(CASE WHEN regexp_matches(natural_language, '最大|最小|平均|最高|最低|总和|统计') AND NOT regexp_matches(sql, '(?i)(MAX|MIN|AVG|SUM|COUNT)\(') THEN 1 ELSE 0 END) AS a, 0 AS u FROM samples JOIN x_size USING (sample_id)) q
UNION ALL SELECT 'size ' || bin, CAST((SELECT COUNT(*) FROM x_size WHERE n_result BETWEEN lo AND hi) AS DOUBLE) FROM (VALUES ('0', 0, 0), ('1-5', 1, 5), ('6-50', 6, 50), ('51-200', 51, 200), ('201-500', 201, 500), ('500+', 501, 999999999)) b(bin, lo, hi)""")
def _(t):
    return rounded(validation.quality_overview(t.samples, sizes(t)), "value")


@register("v7_workload_report", f"SELECT s.*, a.agg_share, a.multi_share FROM ({STATS}) s JOIN ({AGREE}) a ON a.category = s.category")
def _(t):
    return rounded(workload.workload_report(t.samples, sizes(t)), "avg_joins", "avg_where", "avg_filters", "avg_props", "agg_share", "multi_share")


# texts with one fault each, by customer
BROKEN = """SELECT CAST(c_custkey AS BIGINT) AS sample_id, '' AS natural_language, CAST(c_custkey % 2 AS BIGINT) AS n_result, CASE c_custkey % 5
WHEN 0 THEN 'SELECT DISTINCT v.data_id WHERE v.property_id = 22' WHEN 1 THEN 'SELECT v.data_id FROM eav.value_table v WHERE v.property_id = 23 AND CAST(v.data_id AS DECIMAL(30, 15)) > 5'
WHEN 2 THEN 'SELECT v.data_id FROM eav.value_table v JOIN eav.value_table v2 ON v2.data_id = v.data_id WHERE v.property_id = 22 AND v2.property_id = 22'
WHEN 3 THEN '' ELSE 'SELECT v.data_id FROM eav.value_table v WHERE v.property_id = 22' END AS sql FROM {customer}"""


@register("v2_every_issue", """SELECT CAST(c_custkey AS BIGINT) AS sample_id, CASE c_custkey % 5 WHEN 0 THEN 'missing_from' WHEN 1 THEN 'bad_cast' WHEN 2 THEN 'duplicate_property' ELSE 'missing_sql' END AS issue FROM customer WHERE c_custkey % 5 < 4
UNION ALL SELECT CAST(c_custkey AS BIGINT), 'empty_suspicious' FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 5 <> 3""")
def _(t):
    broken = t.sql(BROKEN)
    return validation.review_queries(broken.drop("n_result"), broken.select("sample_id", "n_result"))


# three properties and 400 to 880 rows; a third of the questions ask for an aggregate that the text lacks
WIDE = """SELECT CAST(c_custkey AS BIGINT) AS sample_id, CASE WHEN c_custkey % 3 = 0 THEN '最大的' ELSE '' END AS natural_language, CAST(400 + 20 * (c_custkey % 25) AS BIGINT) AS n_result,
'SELECT v.data_id FROM eav.value_table v WHERE v.property_id = 21 AND w.property_id = 22 AND x.property_id = 23' AS sql FROM {customer}"""


@register("v5_every_count", """SELECT name, value FROM (SELECT unnest(['mean_size', 'missing_aggregate', 'unselective', 'stars']) AS name, unnest([round(avg(m), 6), CAST(SUM(a) AS DOUBLE), CAST(SUM(u) AS DOUBLE), CASE WHEN SUM(a) + SUM(u) = 0 THEN 5.0 WHEN SUM(a) + SUM(u) <= 10 THEN 4.0 WHEN SUM(a) + SUM(u) <= 30 THEN 3.0 ELSE 2.0 END]) AS value
FROM (SELECT 400 + 20 * (c_custkey % 25) AS m, CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS a, CASE WHEN 400 + 20 * (c_custkey % 25) > 500 THEN 1 ELSE 0 END AS u FROM customer) q) r
UNION ALL SELECT 'size ' || bin, CAST((SELECT COUNT(*) FROM customer WHERE 400 + 20 * (c_custkey % 25) BETWEEN lo AND hi) AS DOUBLE) FROM (VALUES ('0', 0, 0), ('1-5', 1, 5), ('6-50', 6, 50), ('51-200', 51, 200), ('201-500', 201, 500), ('500+', 501, 999999999)) b(bin, lo, hi)""")
def _(t):
    wide = t.sql(WIDE)
    return rounded(validation.quality_overview(wide.drop("n_result"), wide.select("sample_id", "n_result")), "value")


# class, count and failures are fixed; the times are not
@register("v8_time_workload", "SELECT * FROM (VALUES ('aggregated', CAST(5 AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS VARCHAR)), ('simple', 5, 1, 'AnalysisException')) v(category, n, failed, error)")
def _(t):
    times, failures = workload.time_workload(t.spark, region_queries(t, "v8"))
    failed = failures.groupBy("category").agg(F.count(F.lit(1)).alias("failed"), F.max("error").alias("error"))
    sound = F.col("min_ms").between(0, F.col("max_ms"))
    return times.filter(sound).select("category", "n").join(failed, "category", "left").select("category", "n", F.coalesce("failed", F.lit(0)).alias("failed"), "error")


# the nation samples with a zero threshold and a duplicate text without a question, curated and answered again
RERUN = """SELECT sample_id, regexp_replace(sql, '> 0(?![0-9.])', '> 0.0') AS sql, natural_language FROM nation_samples
UNION ALL SELECT sample_id + 1000, regexp_replace(sql, '> 0(?![0-9.])', '> 0.0'), '' FROM nation_samples"""


@register("v9_rerun_curated", """SELECT CAST(n_nationkey + 1 AS BIGINT) AS sample_id, COUNT(c_custkey) AS n_result, SUM(1000002 + 4 * c_custkey)::BIGINT AS ids FROM nation LEFT JOIN (SELECT * FROM customer WHERE c_acctbal >= 0) c ON c_nationkey = n_nationkey AND
CASE n_nationkey % 5 WHEN 0 THEN c_acctbal > CASE WHEN n_nationkey = 0 THEN 0.1 ELSE 100 * n_nationkey END WHEN 1 THEN c_acctbal >= 100 * n_nationkey WHEN 2 THEN c_acctbal < 100 * n_nationkey
WHEN 3 THEN c_acctbal <= 100 * n_nationkey ELSE c_acctbal BETWEEN 100 * n_nationkey AND 100 * n_nationkey + 5000 END GROUP BY n_nationkey""")
def _(t):
    t.nation_samples.createOrReplaceTempView("nation_samples")
    curated, hits = workload.rerun_curated(t.spark.sql(RERUN), t.eav_value, t.eav_entity)
    found = hits.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), F.sum("data_id").alias("ids"))
    return curated.select("sample_id").join(found, "sample_id", "left").select("sample_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_result"), "ids")


# the aggregate questions of the samples
@register("a1_workload", f"""SELECT sample_id, call, fn, round(value, 4) AS value, text FROM (
SELECT sample_id, 0 AS call, 'avg' AS fn, (SELECT CAST(avg(TRY_CAST(value AS DECIMAL(30,15))) AS DOUBLE) FROM eav_value WHERE property_id = 5 AND TRY_CAST(value AS DECIMAL(30,15)) < CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS DECIMAL(30,15))) AS value, CAST(NULL AS VARCHAR) AS text
FROM samples JOIN part ON p_partkey = sample_id WHERE p_size > 10 AND p_size <= 14
UNION ALL SELECT sample_id, 0, 'max', NULL, (SELECT max(value) FROM eav_value WHERE property_id = 4) FROM samples JOIN part ON p_partkey = sample_id WHERE p_size > 14 AND p_size <= 17
UNION ALL SELECT sample_id, 1, 'count', (SELECT CAST(count(value) AS DOUBLE) FROM eav_value WHERE property_id = 4), NULL FROM samples JOIN part ON p_partkey = sample_id WHERE p_size > 14 AND p_size <= 17) q""")
def _(t):
    return rounded(workload.evaluate_aggregate_texts(t.samples, t.eav_value), "value", digits=4)


# every form of call over a join of two value tables with OR across them, NOT and a nested query, one text per nation
CALL_FORMS = """SELECT CAST(n_nationkey AS BIGINT) AS sample_id, 'SELECT COUNT(*), COUNT(e.data_id), COUNT(DISTINCT e.data_id), COUNT(DISTINCT w.value), SUM(CAST(v.value AS DECIMAL(30, 15))), AVG(DISTINCT CAST(v.value AS DECIMAL(30, 15))), MIN(w.value)
FROM eav.entity_table e JOIN eav.value_table v ON v.data_id = e.data_id JOIN eav.value_table w ON w.data_id = e.data_id WHERE v.property_id = 23 AND w.property_id IN (22, 24) AND (CAST(v.value AS DECIMAL(30, 15)) > ' || (4000 + 200 * n_nationkey) ||
' OR NOT w.value <> ''BUILDING'') AND e.data_id NOT IN (SELECT x.data_id FROM eav.value_table x WHERE x.property_id = 22 AND x.value = ''' || n_nationkey || ''')' AS sql FROM {nation}"""
_FORMS_JOINED = """SELECT n_nationkey, c_custkey, b.n, w.value AS text FROM nation JOIN (SELECT *, 1000002 + 4 * c_custkey AS id FROM customer) c ON c_nationkey <> n_nationkey
JOIN (SELECT data_id, TRY_CAST(value AS DECIMAL(30,15)) AS n FROM eav_value WHERE property_id = 23) b ON b.data_id = c.id JOIN (SELECT data_id, value FROM eav_value WHERE property_id IN (22, 24)) w ON w.data_id = c.id
WHERE b.n > 4000 + 200 * n_nationkey OR w.value = 'BUILDING'"""
_FORMS = (("count", "COUNT(*)"), ("count", "COUNT(c_custkey)"), ("count", "COUNT(DISTINCT c_custkey)"), ("count", "COUNT(DISTINCT text)"), ("sum", "SUM(n)"), ("avg", "AVG(DISTINCT n)"))


@register("a1_call_forms", f"""SELECT sample_id, call, fn, round(value, 4) AS value, text FROM (SELECT CAST(n_nationkey AS BIGINT) AS sample_id, unnest(range(7))::INTEGER AS call, unnest([{', '.join(f"'{fn}'" for fn, _ in _FORMS)}, 'min']) AS fn,
unnest([{', '.join(f"CAST({form} AS DOUBLE)" for _, form in _FORMS)}, NULL]) AS value, unnest([{'NULL, ' * len(_FORMS)}MIN(text)]) AS text FROM ({_FORMS_JOINED}) j GROUP BY n_nationkey) q""")
def _(t):
    return rounded(workload.evaluate_aggregate_texts(t.sql(CALL_FORMS), t.eav_value, entities=t.eav_entity), "value", digits=4)


@register("a1_unread", "SELECT CAST(c_custkey AS BIGINT) AS sample_id, CASE c_custkey % 5 WHEN 0 THEN 'group_by' WHEN 1 THEN 'call' WHEN 2 THEN 'free_alias' ELSE 'alias' END AS reason FROM customer WHERE c_custkey % 5 < 4")
def _(t):
    return workload.unread_aggregates(t.sql("""SELECT CAST(c_custkey AS BIGINT) AS sample_id, 'SELECT ' || CASE c_custkey % 5 WHEN 1 THEN 'AVG(v.value + 1)' WHEN 3 THEN 'MAX(w.value)' ELSE 'COUNT(*)' END || ' FROM eav.value_table v'
    || CASE c_custkey % 5 WHEN 2 THEN ' JOIN eav.value_table w ON w.data_id = v.data_id' ELSE '' END || ' WHERE v.property_id = ' || c_custkey || CASE c_custkey % 5 WHEN 0 THEN ' GROUP BY v.value' ELSE '' END AS sql FROM {customer}"""))


GOLD_ROWS = f"""SELECT n.sample_id, c.c_custkey, 1000002 + 4 * c.c_custkey AS data_id, c.c_name AS name FROM nation_samples n JOIN customer c ON c.c_nationkey = n.sample_id AND c_acctbal >= 0 AND
CASE n.sample_id % 5 WHEN 0 THEN c_acctbal > 100 * n.sample_id WHEN 1 THEN c_acctbal >= 100 * n.sample_id WHEN 2 THEN c_acctbal < 100 * n.sample_id WHEN 3 THEN c_acctbal <= 100 * n.sample_id ELSE c_acctbal BETWEEN 100 * n.sample_id AND 100 * n.sample_id + 5000 END"""
for _missing, _keep in (("null", "true"), ("skip", "c_custkey % 3 > 0")):
    @register(f"gold_results_{_missing}", f"""SELECT n.sample_id, COALESCE(chunk, 0) AS chunk, COALESCE(result, '') AS result, COALESCE(names, '') AS names FROM nation_samples n LEFT JOIN (
SELECT sample_id, CAST((k - 1) // 50 AS BIGINT) AS chunk, string_agg(CAST(data_id AS VARCHAR), ',' ORDER BY data_id) AS result, string_agg(CASE WHEN c_custkey % 3 > 0 THEN name ELSE '-' END, ',' ORDER BY data_id) FILTER (WHERE {_keep}) AS names
FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY data_id) AS k FROM ({GOLD_ROWS}) g) r GROUP BY 1, 2) x ON x.sample_id = n.sample_id""")
    def _(t, missing=_missing):
        records = t.customer.filter("c_custkey % 3 > 0").select((1000002 + 4 * F.col("c_custkey")).alias("data_id"), F.col("c_name").alias("name"))
        found = workload.gold_results(t.nation_samples, t.eav_value, t.eav_entity, records, missing, chunk=50)
        names = F.array_join(F.transform("result_data", lambda r: F.coalesce(r["name"], F.lit("-"))), ",")
        return found.select("sample_id", "chunk", F.array_join(F.col("result").cast("array<string>"), ",").alias("result"), names.alias("names"))


# version 2 of the score: numbers of the query found in the question, range words, the literal
_NUMBER_TEXT = "CASE WHEN n = floor(n) THEN CAST(CAST(n AS BIGINT) AS VARCHAR) WHEN n = round(n, 1) THEN printf('%.1f', n) ELSE printf('%.2f', n) END"
SCORED_V2 = rf"""(SELECT sample_id, q, sql, natural_language, CAST(3 * (SELECT COUNT(*) FROM (SELECT DISTINCT CAST(unnest(regexp_extract_all(q, '(\d+\.?\d*)', 1)) AS DOUBLE) AS n) u WHERE n > 0.01 AND n < 1000000 AND contains(natural_language, {_NUMBER_TEXT}))
+ CASE WHEN contains(upper(q), 'BETWEEN') AND regexp_matches(natural_language, '之间|到') THEN 2 ELSE 0 END
+ CASE WHEN regexp_extract(q, '\w+\.value\s*=\s*''([^'']+)''', 1) <> '' AND contains(natural_language, regexp_extract(q, '\w+\.value\s*=\s*''([^'']+)''', 1)) THEN 5 ELSE 0 END AS INTEGER) AS score
FROM (SELECT *, trim(regexp_replace(sql, '\s+', ' ', 'g')) AS q FROM samples) s)"""


@register("t19_match_score_v2", f"SELECT sample_id, score FROM {SCORED_V2} x")
def _(t):
    return workload.match_score(t.samples, 2).select("sample_id", "score")


@register("v9_curate_samples", rf"""SELECT row_number() OVER (ORDER BY sample_id) AS sample_id, regexp_replace(sql, '(DECIMAL\(30, 15\)\) >) 0\.0', '\1 0.1') AS sql, natural_language FROM (
SELECT *, max(score) OVER (PARTITION BY q) AS top, max(sample_id) OVER (PARTITION BY q) AS last FROM {SCORED_V2} x) y WHERE score = top AND (top > 0 OR sample_id = last)""")
def _(t):
    return workload.curate_samples(t.samples).select("sample_id", "sql", "natural_language")


# ---- scoring ---------------------------------------------------------------

# per order: the gold list is its parts; the prediction depends on the priority
SCORE_SAMPLES = """SELECT o_orderkey AS sample_id, CASE WHEN o_orderpriority = '5-LOW' THEN 'scalar' ELSE 'ids' END AS kind, o_orderpriority = '3-MEDIUM' AS failed FROM {orders}"""
GOLD = """SELECT sample_id, CAST(data_id AS DOUBLE) AS value FROM {order_result} JOIN {orders} ON o_orderkey = sample_id WHERE o_orderpriority <> '5-LOW'
UNION ALL SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_orderpriority = '5-LOW'"""
PREDICTED = """SELECT sample_id, CAST(data_id AS DOUBLE) AS value FROM {order_result} JOIN {orders} ON o_orderkey = sample_id WHERE o_orderpriority IN ('1-URGENT', '3-MEDIUM')
UNION ALL SELECT sample_id, CAST(data_id AS DOUBLE) FROM {order_result} JOIN {orders} ON o_orderkey = sample_id WHERE o_orderpriority = '1-URGENT'
UNION ALL SELECT sample_id, CAST(data_id AS DOUBLE) FROM {order_result} JOIN {orders} ON o_orderkey = sample_id WHERE o_orderpriority = '2-HIGH' AND pos > 1
UNION ALL SELECT o_orderkey, o_totalprice + CASE WHEN o_orderstatus = 'F' THEN 5e-7 WHEN o_orderstatus = 'O' THEN 5e-6 ELSE 1 END FROM {orders} WHERE o_orderpriority = '5-LOW'"""


def scoring_inputs(t):
    return t.sql(SCORE_SAMPLES), t.sql(GOLD), t.sql(PREDICTED)


_plain = lambda text: text.replace("{", "").replace("}", "")
SCORE_CHECK = f"""(SELECT s.sample_id, kind, failed, COALESCE(g.v, []) AS g, COALESCE(p.v, []) AS p FROM ({_plain(SCORE_SAMPLES)}) s
LEFT JOIN (SELECT sample_id, list_sort(list_distinct(list(value))) AS v FROM ({_plain(GOLD)}) a GROUP BY 1) g USING (sample_id)
LEFT JOIN (SELECT sample_id, list_sort(list_distinct(list(value))) AS v FROM ({_plain(PREDICTED)}) a GROUP BY 1) p USING (sample_id))"""
EX = "CAST(CASE WHEN failed THEN 0 WHEN kind = 'scalar' THEN CASE WHEN len(p) = 1 AND abs(g[1] - p[1]) <= 1e-6 THEN 1 ELSE 0 END WHEN g = p THEN 1 ELSE 0 END AS INTEGER)"
HITS = "CASE WHEN failed THEN 0 WHEN kind = 'scalar' THEN CASE WHEN len(p) = 1 AND abs(g[1] - p[1]) <= 1e-6 THEN 1 ELSE 0 END ELSE len(list_intersect(g, p)) END"


@register("v10_execution_accuracy", f"SELECT sample_id, {EX} AS ex FROM {SCORE_CHECK} q")
def _(t):
    return scoring.execution_accuracy(*scoring_inputs(t))


@register("v11_macro_recall", f"SELECT round(avg(CAST({HITS} AS DOUBLE) / len(g)), 9) AS macro_recall FROM {SCORE_CHECK} q WHERE len(g) > 0")
def _(t):
    return rounded(scoring.macro_recall(scoring.recall_counts(*scoring_inputs(t))), "macro_recall", digits=9)


@register("v11_micro_recall", f"SELECT round(CAST(SUM({HITS}) AS DOUBLE) / SUM(len(g)), 9) AS micro_recall FROM {SCORE_CHECK} q WHERE len(g) > 0")
def _(t):
    return rounded(scoring.micro_recall(scoring.recall_counts(*scoring_inputs(t))), "micro_recall", digits=9)


@register("v12_result_equivalence", f"SELECT sample_id, [round(x, 4) FOR x IN g] = [round(x, 4) FOR x IN p] AS equivalent FROM {SCORE_CHECK} q")
def _(t):
    samples, gold, predicted = scoring_inputs(t)
    return scoring.result_equivalence(samples, gold, predicted, digits=4)

"""Predicates, retrieval, joins and enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparsile.catalog.registry import register
from sparsile.functions import ids, sqltext
from sparsile.functions.numeric import compare, near, non_empty, to_decimal
from sparsile.operators import enrich, matching, retrieval
from sparsile.operators.retrieval import Condition
from sparsile.plans import validation

NUM = "TRY_CAST({} AS DECIMAL(30,15))"
PREFIX = r"TRY_CAST(NULLIF(regexp_extract({0}, '^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)', 1), '') AS DECIMAL(30,15))"
MYSQL = "CASE WHEN {0} IS NOT NULL THEN COALESCE(" + PREFIX + ", 0) END"
V = NUM.format("value")


def value_filter(name: str, condition: Condition, check: str, source: str = "eav_value"):
    @register(name, f"SELECT data_id, value FROM {source} WHERE {check}")
    def _(t):
        return retrieval.matching_values(getattr(t, source), condition).select("data_id", "value")


@register("f1_has_property", "SELECT data_id, value FROM eav_value WHERE property_id = 5")
def _(t):
    return retrieval.has_property(t.eav_value, 5).select("data_id", "value")


OPS = [">", ">=", "<", "<=", "=", "!=", "<>"]


@register("f2_num_cmp", " UNION ALL ".join(f"SELECT '{op}' AS op, data_id FROM eav_value WHERE property_id = 5 AND {V} {op} 950" for op in OPS))
def _(t):
    prices = retrieval.has_property(t.eav_value, 5).select("data_id", to_decimal(F.col("value")).alias("n"))
    passing = F.array_compact(F.array(*[F.when(compare(F.col("n"), op, F.lit(950)), F.lit(op)) for op in OPS]))
    return prices.select(F.explode(passing).alias("op"), "data_id")


value_filter("f3_num_between", Condition(5, "between", lo=910, hi=920.5), f"property_id = 5 AND {V} BETWEEN 910 AND 920.5")
value_filter("f4_str_eq", Condition(2, "str", "=", text="Brand#2"), "property_id = 2 AND value = 'Brand#2'")
value_filter("f4_str_ne", Condition(3, "str", "!=", text="PROMO"), "property_id = 3 AND value <> 'PROMO'")
value_filter("f5_like", Condition(1, "like", text="%ring%"), "property_id = 1 AND value LIKE '%ring%'")
value_filter("f5_not_like", Condition(1, "not_like", text="small%"), "property_id = 1 AND value NOT LIKE 'small%'")


@register("f6_non_empty", "SELECT data_id, property_id, value FROM eav_value_dirty WHERE value <> '' AND value IS NOT NULL")
def _(t):
    return t.eav_value_dirty.filter(non_empty(F.col("value"))).select("data_id", "property_id", "value")


value_filter("f7_bare_cmp", Condition(5, "bare", "<", lo=905), f"property_id = 5 AND {MYSQL.format('value')} < 905", "eav_value_dirty")
value_filter("f7_bare_between", Condition(5, "bare_between", lo=0, hi=901), f"property_id = 5 AND {MYSQL.format('value')} BETWEEN 0 AND 901", "eav_value_dirty")

SIZE_AND_PRICE = [Condition(4, "between", lo=10, hi=20), Condition(5, "num", ">", lo=905)]  # hits at every size of the tables
TWO_ALIASES = """SELECT DISTINCT e.data_id FROM eav_entity e JOIN eav_value v ON v.data_id = e.data_id JOIN eav_value v2 ON v2.data_id = e.data_id
WHERE v.property_id = 4 AND TRY_CAST(v.value AS DECIMAL(30,15)) BETWEEN 10 AND 20 AND v2.property_id = 5 AND TRY_CAST(v2.value AS DECIMAL(30,15)) > 905 ORDER BY 1"""


@register("f8_conjunction", "SELECT DISTINCT a.data_id FROM eav_value a JOIN eav_value b ON a.data_id = b.data_id JOIN eav_value c ON c.data_id = a.data_id WHERE a.property_id = 31 AND a.value = 'F' AND b.property_id = 32 AND TRY_CAST(b.value AS DECIMAL(30,15)) > 250000 AND c.property_id = 33 AND c.value LIKE '1%'")
def _(t):
    return retrieval.matching_ids(t.eav_value, [[Condition(31, "str", "=", text="F"), Condition(32, "num", ">", lo=250000), Condition(33, "like", text="1%")]])


@register("f9_disjunction", f"SELECT DISTINCT data_id FROM eav_value WHERE (property_id = 4 AND {V} = 7) OR (property_id = 2 AND value = 'Brand#3') OR (property_id = 13 AND {V} < 0)")
def _(t):
    return retrieval.retrieve_any(t.eav_entity, t.eav_value, [[Condition(4, "num", "=", lo=7)], [Condition(2, "str", "=", text="Brand#3")], [Condition(13, "num", "<", lo=0)]])


@register("f10_property_in", "SELECT property_id, COUNT(*) AS n FROM eav_value WHERE property_id IN (2, 5, 24, 44) GROUP BY 1")
def _(t):
    return retrieval.property_in(t.eav_value, [2, 5, 24, 44]).groupBy("property_id").agg(F.count(F.lit(1)).alias("n"))


@register("f11_near", "SELECT p_partkey, COALESCE(abs(p_retailprice - 950.0005) < 1e-3, false) AS price_near, p_brand = 'Brand#2' AS brand_near FROM part")
def _(t):
    return t.part.select("p_partkey", near(F.col("p_retailprice"), F.lit(950.0005)).alias("price_near"), near(F.col("p_brand"), F.lit("Brand#2")).alias("brand_near"))


@register("f12_empty_results", "SELECT sample_id FROM x_size WHERE n_result = 0")
def _(t):
    return retrieval.result_sizes(t.samples, t.sample_result).filter("n_result = 0").select("sample_id")


@register("f13_only_ids", "SELECT s.sample_id FROM samples s JOIN x_size z USING (sample_id) WHERE z.n_result = 0 AND s.sample_id IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def _(t):
    wanted = t.lineitem.filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("sample_id"))
    empty = retrieval.result_sizes(t.samples, t.sample_result).filter("n_result = 0")
    return t.samples.join(empty, "sample_id", "left_semi").join(wanted, "sample_id", "left_semi").select("sample_id")


@register("f14_scalar_guard", "SELECT o_orderkey, o_custkey * 3 AS v FROM orders WHERE o_custkey * 3 > 1000")
def _(t):
    return t.orders.select("o_orderkey", (F.col("o_custkey") * 3).alias("v")).filter(ids.is_entity_id(F.col("v")))


@register("f15_skip_empty_sql", "SELECT sample_id, CASE WHEN sql = '' THEN 'error' ELSE 'ready' END AS status FROM samples")
def _(t):
    return t.samples.select("sample_id", F.when(F.trim("sql") == "", "error").otherwise("ready").alias("status"))


# ---- retrieval -------------------------------------------------------------

@register("r1_retrieve", f"SELECT DISTINCT e.data_id FROM eav_entity e JOIN eav_value v ON v.data_id = e.data_id WHERE v.property_id = 32 AND v.value <> '' AND v.value IS NOT NULL AND TRY_CAST(v.value AS DECIMAL(30,15)) > 400000 ORDER BY 1")
def _(t):
    return retrieval.retrieve(t.eav_entity, t.eav_value, [Condition(32, "num", ">", lo=400000)])


@register("r2_multi_condition", TWO_ALIASES)
def _(t):
    return retrieval.retrieve(t.eav_entity, t.eav_value, SIZE_AND_PRICE)


@register("r2_same_property_twice", "SELECT DISTINCT e.data_id FROM eav_entity e JOIN eav_value v ON v.data_id = e.data_id JOIN eav_value v2 ON v2.data_id = e.data_id WHERE v.property_id = 5 AND TRY_CAST(v.value AS DECIMAL(30,15)) > 910 AND v2.property_id = 5 AND TRY_CAST(v2.value AS DECIMAL(30,15)) < 930")
def _(t):
    return retrieval.retrieve(t.eav_entity, t.eav_value, [Condition(5, "num", ">", lo=910), Condition(5, "num", "<", lo=930)])


WORKLOAD_CHECK = f"""
SELECT 1 AS sample_id, data_id FROM eav_value a WHERE property_id = 4 AND {V} BETWEEN 10 AND 20 AND data_id IN (SELECT data_id FROM eav_value WHERE property_id = 5 AND {V} > 905)
UNION ALL SELECT 2, data_id FROM eav_value WHERE property_id = 5 AND {V} >= 950 AND {V} < 960
UNION ALL SELECT DISTINCT 3, data_id FROM eav_value WHERE (property_id = 2 AND value = 'Brand#2') OR (property_id = 4 AND {V} = 7)
UNION ALL SELECT 4, data_id FROM eav_value WHERE property_id = 3 AND value LIKE 'S%' AND data_id IN (SELECT data_id FROM eav_value WHERE property_id = 1 AND value NOT LIKE '%red%')
UNION ALL SELECT 5, data_id FROM eav_value WHERE property_id = 13 AND {V} > 5000 AND data_id IN (SELECT data_id FROM eav_value WHERE property_id = 12 AND value <> '3')
UNION ALL SELECT 6, data_id FROM eav_value WHERE property_id = 23 AND {V} <= 100
UNION ALL SELECT 7, data_id FROM eav_value WHERE property_id = 32 AND {V} <> 1 AND data_id IN (SELECT data_id FROM eav_value WHERE property_id = 33 AND value = '1-URGENT')
UNION ALL SELECT 9, data_id FROM eav_value WHERE property_id = 22 AND {V} BETWEEN 3 AND 5 AND data_id IN (SELECT data_id FROM eav_value WHERE property_id = 24)"""


@register("r3_evaluate_predicates", f"SELECT CAST(sample_id AS BIGINT) AS sample_id, data_id FROM ({WORKLOAD_CHECK}) q")
def _(t):
    return retrieval.evaluate_predicates(t.eav_value, t.predicates, t.eav_entity)


@register("r3_result_sizes", f"SELECT s.sample_id, COUNT(q.data_id) AS n_result FROM (SELECT DISTINCT sample_id FROM predicates) s LEFT JOIN ({WORKLOAD_CHECK}) q ON q.sample_id = s.sample_id GROUP BY 1")
def _(t):
    hits = retrieval.evaluate_predicates(t.eav_value, t.predicates, t.eav_entity)
    return retrieval.result_sizes(t.predicates.select("sample_id").distinct(), hits)


@register("r3_text_workload", """SELECT sample_id, COUNT(data_id) AS n_result FROM (
SELECT CAST(n_nationkey AS BIGINT) AS sample_id, c.c_custkey AS data_id FROM nation LEFT JOIN (SELECT * FROM customer WHERE c_acctbal >= 0) c ON c_nationkey = n_nationkey AND
CASE n_nationkey % 5 WHEN 0 THEN c_acctbal > 100 * n_nationkey WHEN 1 THEN c_acctbal >= 100 * n_nationkey WHEN 2 THEN c_acctbal < 100 * n_nationkey
WHEN 3 THEN c_acctbal <= 100 * n_nationkey ELSE c_acctbal BETWEEN 100 * n_nationkey AND 100 * n_nationkey + 5000 END) q GROUP BY 1""")
def _(t):
    hits = retrieval.evaluate_predicates(t.eav_value, matching.extract_conditions(t.nation_samples), t.eav_entity)
    return retrieval.result_sizes(t.nation_samples, hits)


@register("r3_many_aliases", f"SELECT CAST(1 AS BIGINT) AS sample_id, data_id FROM eav_value WHERE property_id = 32 AND {V} > 1490 UNION ALL SELECT 2, data_id FROM eav_value WHERE property_id = 23 AND {V} > 620")
def _(t):
    aliases = [(1, f"v{i}", 32, 10 * i) for i in range(150)] + [(2, f"v{i}", 23, 10 * i) for i in range(63)]
    rows = t.spark.createDataFrame(aliases, "sample_id bigint, alias string, property_id int, lo int").withColumn("lo", F.col("lo").cast("decimal(30,15)"))
    none = [F.lit(None).cast(k).alias(n) for n, k in (("hi", "decimal(30,15)"), ("text", "string"))]
    predicates = rows.select("sample_id", F.lit(0).alias("clause"), "alias", "property_id", F.lit("num").alias("kind"), F.lit(">").alias("op"), "lo", *none)
    return retrieval.evaluate_predicates(t.eav_value, predicates, t.eav_entity)


# an IN list, two bracketed OR groups and another precision, one query per region
IN_AND_OR = """SELECT CAST(r_regionkey AS BIGINT) AS sample_id, 'SELECT DISTINCT e.data_id FROM eav.entity_table e JOIN eav.value_table v ON v.data_id = e.data_id JOIN eav.value_table v2 ON v2.data_id = e.data_id
WHERE v.property_id IN (12, 22) AND (v.value = ''' || r_regionkey || ''' OR v.value = ''' || (r_regionkey + 5) || ''') AND v2.property_id IN (13, 23) AND (CAST(v2.value AS DECIMAL(20, 5)) < 100 OR CAST(v2.value AS DECIMAL(20, 5)) > ' || (5000 + r_regionkey) || ')' AS sql FROM {region}"""


@register("r3_in_and_or", f"""SELECT DISTINCT CAST(r_regionkey AS BIGINT) AS sample_id, a.data_id FROM region JOIN eav_value a ON a.property_id IN (12, 22) AND a.value IN (CAST(r_regionkey AS VARCHAR), CAST(r_regionkey + 5 AS VARCHAR))
JOIN eav_value b ON b.data_id = a.data_id AND b.property_id IN (13, 23) AND (TRY_CAST(b.value AS DECIMAL(30,15)) < 100 OR TRY_CAST(b.value AS DECIMAL(30,15)) > 5000 + r_regionkey)""")
def _(t):
    return retrieval.evaluate_predicates(t.eav_value, matching.extract_conditions(t.sql(IN_AND_OR)), t.eav_entity)


# negated groups and a test of the entity, one query per region
_JOINED = "SELECT DISTINCT e.data_id FROM eav.entity_table e JOIN eav.value_table v ON v.data_id = e.data_id"
NEGATED = f"""SELECT CAST(r_regionkey AS BIGINT) AS sample_id, '{_JOINED} JOIN eav.value_table v2 ON v2.data_id = e.data_id WHERE v.property_id = 24 AND NOT (v.value = ''BUILDING'' OR v.value LIKE ''A%'')
AND v2.property_id = 23 AND NOT (NOT (CAST(v2.value AS DECIMAL(30, 15)) <= ' || (2000 + 1000 * r_regionkey) || ') OR CAST(v2.value AS DECIMAL(30, 15)) BETWEEN 100 AND 200) AND e.title = ''customer'' ORDER BY e.data_id ASC' AS sql FROM {{region}}"""


@register("r3_not", """SELECT CAST(r_regionkey AS BIGINT) AS sample_id, 1000002 + 4 * c_custkey AS data_id FROM region, customer
WHERE c_acctbal >= 0 AND c_mktsegment <> 'BUILDING' AND c_mktsegment NOT LIKE 'A%' AND c_acctbal <= 2000 + 1000 * r_regionkey AND c_acctbal NOT BETWEEN 100 AND 200""")
def _(t):
    return retrieval.evaluate_predicates(t.eav_value, matching.extract_conditions(t.sql(NEGATED)), t.eav_entity)


# what must not exist, and what must exist elsewhere
NESTED = f"""SELECT CAST(r_regionkey AS BIGINT) AS sample_id, '{_JOINED} WHERE v.property_id = 24 AND e.data_id NOT IN (SELECT x.data_id FROM eav.value_table x WHERE x.property_id = 23 AND
(CAST(x.value AS DECIMAL(30, 15)) > 3000 OR CAST(x.value AS DECIMAL(30, 15)) < 500)) AND EXISTS (SELECT 1 FROM eav.value_table y WHERE y.data_id = e.data_id AND y.property_id = 22 AND NOT y.value <> ''' || r_regionkey || ''')' AS sql FROM {{region}}
UNION ALL SELECT CAST(r_regionkey + 10 AS BIGINT), 'SELECT e.data_id FROM eav.entity_table e WHERE e.title <> ''orders'' AND NOT EXISTS (SELECT 1 FROM eav.value_table x WHERE x.data_id = e.data_id AND x.property_id IN (4, 13, 23))
AND NOT (e.data_id < ' || (1000000 + 100 * r_regionkey) || ')' FROM {{region}}"""


@register("r3_nested", """SELECT CAST(r_regionkey AS BIGINT) AS sample_id, 1000002 + 4 * c_custkey AS data_id FROM region JOIN customer ON c_nationkey = r_regionkey WHERE NOT (c_acctbal > 3000 OR (c_acctbal >= 0 AND c_acctbal < 500))
UNION ALL SELECT CAST(r_regionkey + 10 AS BIGINT), data_id FROM region JOIN eav_entity ON data_id >= 1000000 + 100 * r_regionkey WHERE title <> 'orders' AND data_id NOT IN (SELECT data_id FROM eav_value WHERE property_id IN (4, 13, 23))""")
def _(t):
    return retrieval.evaluate_predicates(t.eav_value, matching.extract_conditions(t.sql(NESTED)), t.eav_entity)


# texts with a part that is not read, by customer
UNREAD = """SELECT CAST(c_custkey AS BIGINT) AS sample_id, 'SELECT v.data_id FROM eav.value_table v WHERE v.property_id = ' || CASE c_custkey % 6 WHEN 0 THEN '23 AND v.value > (SELECT AVG(w.value) FROM eav.value_table w WHERE w.property_id = 23)'
WHEN 1 THEN '23 AND floor(v.value) = 1' WHEN 2 THEN '23 AND NOT (v.property_id = 22)' WHEN 3 THEN '23 AND (v.value = ''x''' WHEN 4 THEN '24 LIMIT 5' ELSE '24 AND (v.value = ''(a OR'' OR NOT v.value = ''b'')' END AS sql FROM {customer}"""


@register("t14_unparsed", "SELECT CAST(c_custkey AS BIGINT) AS sample_id, CASE c_custkey % 6 WHEN 0 THEN 'subquery' WHEN 1 THEN 'value_test' WHEN 2 THEN 'property' WHEN 3 THEN 'structure' ELSE 'other' END AS reason FROM customer WHERE c_custkey % 6 < 5")
def _(t):
    return matching.unparsed(t.sql(UNREAD))


def region_queries(t, suffix: str):
    """One aggregate and one id query per region, over views of the whole tables."""
    t.eav_value.createOrReplaceTempView(f"value_table_{suffix}")
    t.eav_entity.createOrReplaceTempView(f"entity_table_{suffix}")
    out = []
    for region in range(5):
        out.append((region, "aggregated", f"SELECT MAX(TRY_CAST(v.value AS DECIMAL(30,15))) FROM value_table_{suffix} v WHERE v.property_id = {(4, 5, 13, 23, 32)[region]}"))
        out.append((region + 10, "simple", f"SELECT DISTINCT e.data_id FROM entity_table_{suffix} e JOIN value_table_{suffix} v ON v.data_id = e.data_id WHERE v.property_id = 22 AND v.value = '{region}'"))
    out.append((20, "simple", f"SELECT missing_column FROM value_table_{suffix}"))
    return out


REGION_MAXIMA = " UNION ALL ".join(f"SELECT CAST({k} AS BIGINT) AS sample_id, CAST(MAX({V}) AS VARCHAR) AS value, CAST(NULL AS VARCHAR) AS error FROM eav_value WHERE property_id = {p}" for k, p in enumerate((4, 5, 13, 23, 32)))


@register("r4_run_queries", f"""{REGION_MAXIMA}
UNION ALL SELECT CAST(value AS BIGINT) + 10, CAST(data_id AS VARCHAR), NULL FROM eav_value WHERE property_id = 22 AND value IN ('0', '1', '2', '3', '4')
UNION ALL SELECT 20, NULL, 'UNRESOLVED_COLUMN.WITH_SUGGESTION'""")
def _(t):
    return retrieval.run_queries(t.spark, [(i, q) for i, _, q in region_queries(t, "r4")])


# ---- joins and enrichment --------------------------------------------------

@register("j1_join_entity_value", "SELECT title, property_id, COUNT(*) AS n FROM eav_entity JOIN eav_value USING (data_id) GROUP BY 1, 2")
def _(t):
    return retrieval.join_entity_value(t.eav_entity, t.eav_value).groupBy("title", "property_id").agg(F.count(F.lit(1)).alias("n"))


@register("j2_property_coverage", "SELECT property_id, entity_count FROM x_coverage")
def _(t):
    from sparsile.operators.aggregates import property_coverage

    return property_coverage(t.eav_property, t.eav_value)


@register("j3_dictionary_lookup", "SELECT v.property_id, COALESCE(p.property_name, 'pid_' || v.property_id) AS name, COUNT(*) AS n FROM eav_value v LEFT JOIN ingest_property p ON p.property_id = v.property_id GROUP BY 1, 2")
def _(t):
    names = t.eav_value.select("property_id").join(t.ingest_property, "property_id", "left")
    label = F.coalesce("property_name", F.concat(F.lit("pid_"), F.col("property_id").cast("string")))
    return names.groupBy("property_id", label.alias("name")).agg(F.count(F.lit(1)).alias("n"))


@register("j4_needed_records", "SELECT data_id, record FROM part_record WHERE data_id IN (SELECT data_id FROM order_result)")
def _(t):
    return enrich.needed_records(t.part_record, t.order_result)


@register("j5_attach_records_null", "SELECT o.sample_id, CAST(o.pos AS INTEGER) AS pos, o.data_id, r.record FROM order_result o LEFT JOIN part_record r USING (data_id)")
def _(t):
    return enrich.attach_records(t.order_result, t.part_record, "null").select("sample_id", F.col("pos").cast("int").alias("pos"), "data_id", "record")


@register("j5_attach_records_skip", "SELECT o.sample_id, CAST(o.pos AS INTEGER) AS pos, o.data_id, r.record FROM order_result o JOIN part_record r USING (data_id)")
def _(t):
    return enrich.attach_records(t.order_result, t.part_record, "skip").select("sample_id", F.col("pos").cast("int").alias("pos"), "data_id", "record")


def tiers(t):
    small = t.part.select((F.col("p_partkey") * 4 + 1000000).alias("data_id"), F.concat(F.lit("t1 "), "p_name").alias("record"), "p_size")
    return [("files", small.filter("p_size < 10").drop("p_size")), ("backup", small.filter("p_size < 25").drop("p_size")), ("store", t.part_record)]


TIERED = """SELECT DISTINCT r.data_id, CASE WHEN p_size < 10 THEN 'files' WHEN p_size < 25 THEN 'backup' ELSE 'store' END AS tier,
CASE WHEN p_size < 25 THEN 't1 ' || p_name ELSE p_name || '/' || p_brand END AS record FROM order_result r JOIN part ON r.data_id = 1000000 + 4 * p_partkey WHERE p_size <= 40"""


@register("j6_tiered_lookup", TIERED)
def _(t):
    return enrich.tiered_lookup(t.order_result, tiers(t))


@register("j6_tier_hits", f"SELECT tier, COUNT(*) AS n FROM ({TIERED}) q GROUP BY 1")
def _(t):
    return enrich.tiered_lookup(t.order_result, tiers(t)).groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


@register("j7_missing_ids", "SELECT DISTINCT data_id FROM order_result WHERE data_id NOT IN (SELECT data_id FROM part_record) ORDER BY 1")
def _(t):
    return enrich.missing_ids(t.order_result, t.part_record)


def patches(t):
    return t.supplier.select((F.col("s_suppkey") * 3).alias("sample_id"), F.concat(F.lit("SELECT "), F.col("s_nationkey").cast("string")).alias("sql"), F.lit(None).cast("string").alias("natural_language"))


@register("j8_override_samples", "SELECT s.sample_id, COALESCE('SELECT ' || p.s_nationkey, s.sql) AS sql, s.natural_language FROM samples s LEFT JOIN supplier p ON p.s_suppkey * 3 = s.sample_id")
def _(t):
    return enrich.override_samples(t.samples.drop("title"), patches(t), ["sql", "natural_language"])


@register("j8_unknown_patches", "SELECT s_suppkey * 3 * 1000 AS sample_id FROM supplier WHERE s_suppkey * 3 * 1000 NOT IN (SELECT p_partkey FROM part)")
def _(t):
    far = patches(t).withColumn("sample_id", F.col("sample_id") * 1000)
    return enrich.unknown_patches(t.samples, far).select("sample_id")


WORDS = "(VALUES ('the'), ('on'), ('ing'), ('ouè'), ('zzzz'), ('en er')) AS w(term)"


@register("j9_terms_in_text", f"SELECT doc_id, term FROM documents, {WORDS} WHERE contains(text, term)")
def _(t):
    terms = t.spark.sql(f"SELECT * FROM {WORDS}")
    return matching.terms_in_text(t.documents.select("doc_id", "text"), terms).select("doc_id", "term")


@register("j9_terms_by_seed", f"SELECT doc_id, term FROM documents, {WORDS} WHERE contains(text, term)")
def _(t):
    terms = t.spark.sql(f"SELECT * FROM {WORDS}")
    return matching.terms_in_text(t.documents.select("doc_id", "text"), terms, max_inline=0).select("doc_id", "term")


@register("j9_term_usage", f"SELECT term, COUNT(doc_id) AS n_texts FROM {WORDS} LEFT JOIN documents ON contains(text, term) GROUP BY 1")
def _(t):
    terms = t.spark.sql(f"SELECT * FROM {WORDS}")
    return matching.term_usage(terms, matching.terms_in_text(t.documents.select("doc_id", "text"), terms))


SAID = r"""(SELECT sample_id, unnest(regexp_extract_all(natural_language, '(不超过|不低于|大于|小于|高于|低于|超过)\s*(\d[\d.]*)', 1)) AS word,
unnest(regexp_extract_all(natural_language, '(不超过|不低于|大于|小于|高于|低于|超过)\s*(\d[\d.]*)', 2)) AS said FROM {0})"""
ASKED = r"""(SELECT sample_id, unnest(regexp_extract_all(sql, 'DECIMAL\(30, 15\)\) (>=|<=|>|<|=) ([0-9.]+)', 1)) AS query_op,
unnest(regexp_extract_all(sql, 'DECIMAL\(30, 15\)\) (>=|<=|>|<|=) ([0-9.]+)', 2)) AS asked FROM {0})"""
WORD_OP = "CASE word WHEN '不超过' THEN '<=' WHEN '不低于' THEN '>=' WHEN '大于' THEN '>' WHEN '高于' THEN '>' WHEN '超过' THEN '>' ELSE '<' END"


@register("j10_match_conditions", f"SELECT DISTINCT s.sample_id, word, {WORD_OP} AS op, query_op FROM {SAID.format('samples')} s JOIN {ASKED.format('samples')} a ON a.sample_id = s.sample_id AND abs(CAST(said AS DOUBLE) - CAST(asked AS DOUBLE)) < 1e-3")
def _(t):
    pairs = matching.match_conditions(validation.said_conditions(t.samples), validation.asked_conditions(t.samples))
    return pairs.select("sample_id", "word", "op", "query_op").distinct()


@register("j11_lookup_ci", """SELECT p_partkey + 0 AS data_id, CASE WHEN p_size > 25 THEN 'P_BRAND' ELSE 'p_brand' END AS property_name, p_brand AS value FROM part""")
def _(t):
    wanted = t.part.select(F.col("p_partkey").alias("data_id"), F.when(F.col("p_size") > 25, "P_BRAND").otherwise("p_brand").alias("property_name"))
    mine = t.part.select(F.col("p_partkey").alias("data_id"), F.explode(F.array(
        F.struct(F.lit("p_brand").alias("property_name"), F.col("p_brand").alias("value")),
        F.struct(F.when(F.col("p_size") <= 25, "P_Brand").otherwise("q_brand").alias("property_name"), F.col("p_type").alias("value")))).alias("c")).select("data_id", "c.*")
    return validation.value_by_name(wanted, mine)


@register("j12_snapshot_diff", "SELECT o_orderkey, o_orderstatus <> 'P' AND o_totalprice >= 100000 AS unchanged FROM orders WHERE o_orderpriority <> '5-LOW'")
def _(t):
    old = t.orders.select("o_orderkey", "o_orderstatus", F.when(F.col("o_totalprice") >= 100000, F.lit(None)).otherwise(F.lit("x")).cast("string").alias("note"))
    new = t.orders.filter("o_orderpriority <> '5-LOW'").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "P", "Q").otherwise(F.concat(F.lit(" "), "o_orderstatus")).alias("o_orderstatus"), F.lit(None).cast("string").alias("note"))
    return enrich.snapshot_diff(old, new, "o_orderkey", ["o_orderstatus", "note"])


@register("x1_distinct_ids", "SELECT DISTINCT data_id FROM order_result")
def _(t):
    return enrich.needed_ids(t.order_result)


CUSTOMERS = "SELECT c_custkey FROM customer WHERE c_acctbal >= 0"


@register("x2_found_ids", f"SELECT DISTINCT o_custkey AS data_id FROM orders WHERE o_custkey IN ({CUSTOMERS})")
def _(t):
    return enrich.found_ids(t.orders.select(F.col("o_custkey").alias("data_id")), t.customer.filter("c_acctbal >= 0").select(F.col("c_custkey").alias("data_id")))


@register("x3_except_ids", f"SELECT DISTINCT o_custkey AS data_id FROM orders WHERE o_custkey NOT IN ({CUSTOMERS})")
def _(t):
    return enrich.except_ids(t.orders.select(F.col("o_custkey").alias("data_id")), t.customer.filter("c_acctbal >= 0").select(F.col("c_custkey").alias("data_id")))


@register("x4_overlay", "SELECT COALESCE(c_custkey, s_suppkey) AS k, COALESCE(s_name, c_name) AS v FROM customer FULL OUTER JOIN supplier ON c_custkey = s_suppkey")
def _(t):
    return enrich.overlay([t.customer.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v")), t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("v"))], "k")


@register("x5_union_properties", "SELECT CASE n_nationkey % 5 WHEN 0 THEN 'greater' WHEN 1 THEN 'greater_equal' WHEN 2 THEN 'less' WHEN 3 THEN 'less_equal' ELSE 'range' END AS boundary, COUNT(DISTINCT p) AS n_properties FROM nation, (VALUES (22), (23)) v(p) GROUP BY 1")
def _(t):
    return validation.boundary_properties(t.nation_samples)


@register("x6_all_needed_ids", r"SELECT DISTINCT data_id FROM sample_result JOIN samples USING (sample_id) WHERE NOT regexp_matches(sql, '(?i)\b(AVG|MAX|MIN|SUM|COUNT)\s*\(')")
def _(t):
    plain = t.samples.filter(~sqltext.is_aggregation(F.col("sql"))).select("sample_id")
    return enrich.needed_ids(t.sample_result.join(plain, "sample_id", "left_semi"))

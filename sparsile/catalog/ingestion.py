"""Sources, sinks and ingestion shaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparsile.catalog.registry import register
from sparsile.catalog.tables import Tables
from sparsile.functions import bitmaps, ids
from sparsile.operators import leaves, numbering, shaping
from sparsile.plans import ingest
from sparsile.session import fresh_path
from sparsile.sources import dictionary, eav_store, json_docs, reports

RULES = leaves.LeafRules()


def keyed_records(t: Tables):
    """Envelope A records of the order documents."""
    return json_docs.explode_array_envelope(t.docs_array)


# ---- sources and sinks -----------------------------------------------------

@register("s1_read_json_datasets", "SELECT md5(value) AS doc_md5, CAST(strlen(value) AS BIGINT) AS n_bytes FROM docs_array")
def _(t):
    path = fresh_path(t.spark, "docs")
    t.docs_array.select("value").write.text(path)
    docs = json_docs.read_json_datasets(t.spark, path, lines=True, pattern="*.txt")
    return docs.select(F.md5("value").alias("doc_md5"), F.octet_length("value").cast("bigint").alias("n_bytes"))


@register("s2_explode_array_envelope", "SELECT doc_no, CAST(pos AS BIGINT) AS pos, raw_id, title FROM x_record")
def _(t):
    return keyed_records(t).select("doc_no", "pos", "raw_id", "title")


@register("s3_explode_template_envelope", """
SELECT c_custkey AS doc_no, CAST(0 AS BIGINT) AS pos, c_custkey AS raw_id, 'K' AS title, c_name AS uploader, c_mktsegment AS seg FROM customer
UNION ALL SELECT c_custkey, 2, c_custkey, 'K', c_name, 'second' FROM customer
UNION ALL SELECT c_custkey, 2147483648, c_custkey + 1000000, 'K', NULL, 'single' FROM customer""")
def _(t):
    return json_docs.explode_template_envelope(t.docs_template).select(
        "doc_no", "pos", "raw_id", "title", "uploader", F.get_json_object("data", "$.seg").alias("seg"))


MIXED = """SELECT o_orderkey AS doc_no, CASE WHEN o_orderpriority = '5-LOW' THEN '[{{"_meta_id": ' WHEN o_orderpriority = '2-HIGH' THEN '{{"other": 1}}'
WHEN o_orderpriority = '3-MEDIUM' THEN '{{"template": {{"K": 1}}, "data": []}}' ELSE '[]' END AS value FROM {orders}"""


@register("s4_split_corrupt", """
SELECT 'unreadable' AS reason, COUNT(*) AS n FROM orders WHERE o_orderpriority = '5-LOW'
UNION ALL SELECT 'unknown format', COUNT(*) FROM orders WHERE o_orderpriority = '2-HIGH'
UNION ALL SELECT 'good', COUNT(*) FROM orders WHERE o_orderpriority NOT IN ('5-LOW', '2-HIGH')""")
def _(t):
    good, bad = json_docs.split_corrupt(t.sql(MIXED))
    both = good.select(F.lit("good").alias("reason")).unionAll(bad.select("reason"))
    return both.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def stored(t: Tables):
    path = fresh_path(t.spark, "eav")
    eav_store.overwrite_eav(t.eav_value, f"{path}/{eav_store.VALUE}")
    eav_store.overwrite_table(t.eav_entity, f"{path}/{eav_store.ENTITY}")
    eav_store.overwrite_table(t.eav_property, f"{path}/{eav_store.PROPERTY}")
    return path


@register("s5_read_eav", "SELECT v.property_id, p.property_name, COUNT(*) AS n FROM eav_value v JOIN eav_property p USING (property_id) JOIN eav_entity e USING (data_id) GROUP BY 1, 2")
def _(t):
    eav = eav_store.read_eav(t.spark, stored(t))
    joined = eav[eav_store.VALUE].drop("property_name").join(eav[eav_store.PROPERTY], "property_id").join(eav[eav_store.ENTITY], "data_id")
    return joined.groupBy("property_id", "property_name").agg(F.count(F.lit(1)).alias("n"))


DICT = """SELECT '{{"' || p_name || '": 1, " ' || p_brand || '": ' || p_size || ', "none": null}}' AS value FROM {part}"""


@register("s6_load_dictionary", "SELECT field, CAST(property_id AS INTEGER) AS property_id, COUNT(*) AS n FROM (SELECT p_name AS field, 1 AS property_id FROM part UNION ALL SELECT ' ' || p_brand, p_size FROM part) q GROUP BY 1, 2")
def _(t):
    return dictionary.dictionary_rows(t.sql(DICT)).groupBy("field", "property_id").agg(F.count(F.lit(1)).alias("n"))


@register("s7_overwrite_eav", "SELECT data_id, property_id, value FROM eav_value")
def _(t):
    path = fresh_path(t.spark, "values")
    eav_store.overwrite_eav(t.eav_value, path)
    return t.spark.read.schema("data_id bigint, property_name string, value string, property_id int").parquet(path).select("data_id", "property_id", "value")


@register("s8_upsert", """
SELECT c.c_custkey AS k, COALESCE(u.v, c.c_mktsegment) AS v FROM customer c LEFT JOIN (
  SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS v FROM orders GROUP BY 1) u ON u.o_custkey = c.c_custkey
UNION ALL SELECT DISTINCT o_custkey, arg_max(o_orderpriority, o_orderkey) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) GROUP BY 1""")
def _(t):
    target = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"))
    updates = t.orders.select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("v"), "o_orderkey")
    return eav_store.upsert(target, updates, ["k"], "o_orderkey")


@register("s9_write_samples_json", "SELECT sample_id, md5(natural_language) AS nl_md5, CAST(length(sql) AS BIGINT) AS n_sql FROM samples")
def _(t):
    path = fresh_path(t.spark, "samples")
    reports.write_samples_json(t.samples, path)
    back = t.spark.read.schema("sample_id bigint, sql string, natural_language string").json(path)
    return back.select("sample_id", F.md5("natural_language").alias("nl_md5"), F.length("sql").cast("bigint").alias("n_sql"))


@register("s9_pack_results", "SELECT sample_id, CAST(list_sum([1 FOR x IN r]) AS BIGINT) AS n, array_to_string(r, ',') AS ids FROM (SELECT sample_id, list(data_id ORDER BY data_id) AS r FROM sample_result GROUP BY 1) q")
def _(t):
    packed = reports.pack_results(t.sample_result)
    return packed.select("sample_id", F.size("result").cast("bigint").alias("n"), F.array_join("result", ",").alias("ids"))


@register("s10_write_csv_report", "SELECT property_id, entity_count FROM x_coverage")
def _(t):
    from sparsile.operators.aggregates import property_coverage

    path = fresh_path(t.spark, "coverage")
    reports.write_csv_report(property_coverage(t.eav_property, t.eav_value), path)
    return t.spark.read.option("header", True).schema("property_id int, entity_count bigint").csv(path)


@register("s11_snapshot", "SELECT title, COUNT(*) AS n FROM eav_entity GROUP BY 1")
def _(t):
    path = eav_store.snapshot(t.eav_entity, fresh_path(t.spark, "snap"), "20240101T000000")
    return t.spark.read.schema(t.eav_entity.schema).parquet(path).groupBy("title").agg(F.count(F.lit(1)).alias("n"))


REVIEW = """SELECT 'notes' || chr(10) || '[' || p_partkey || '] looks wrong' || chr(10) || '修正后的SQL: SELECT ' || p_size || chr(10) || ' FROM t' || chr(10) || chr(10) ||
'[' || (p_partkey + 1000000000) || '] again' || chr(10) || '修正后的SQL:  SELECT ''' || p_brand || '''' || chr(10) || '---' || chr(10) || 'rest' AS value FROM {part}"""


@register("s12_read_patch_blocks", "SELECT p_partkey AS sample_id, 'SELECT ' || p_size || chr(10) || ' FROM t' AS sql FROM part UNION ALL SELECT p_partkey + 1000000000, 'SELECT ''' || p_brand || '''' FROM part")
def _(t):
    return json_docs.read_patch_blocks(t.sql(REVIEW))


# ---- leaves ----------------------------------------------------------------

def order_leaves(t: Tables):
    return leaves.extract_leaves(keyed_records(t).select("doc_no", F.col("pos").alias("rec"), "data"), ["doc_no", "rec"])


@register("n1_extract_leaves", "SELECT doc_no, CAST(pos AS BIGINT) AS rec, field, value FROM x_leaf")
def _(t):
    return order_leaves(t).select("doc_no", "rec", "field", "value")


@register("n2_scalar_leaf", "SELECT event_id, 'k' AS field, regexp_extract(props, '\"k\": (-?[0-9.]+)', 1) AS value FROM events WHERE props LIKE '%\"k\"%'")
def _(t):
    records = t.events.select("event_id", F.col("props").alias("data"))
    return leaves.extract_leaves(records, ["event_id"]).filter("field = 'k'").select("event_id", "field", "value")


def _leaf_query(name: str, fields: list[str]):
    quoted = ", ".join(f"'{f}'" for f in fields)

    @register(name, f"SELECT doc_no, CAST(pos AS BIGINT) AS pos, field, value FROM x_leaf WHERE field IN ({quoted})")
    def _(t):
        return order_leaves(t).filter(F.col("field").isin(fields)).select("doc_no", F.col("rec").cast("bigint").alias("pos"), "field", "value")


_leaf_query("n3_range_leaf", ["price_lb", "price_ub"])
_leaf_query("n4_nested_dict_leaf", ["flag", "x"])
_leaf_query("n5_list_of_dict_leaf", ["温度"])
_leaf_query("n6_name_content_pivot", ["Co", "Ni"])
_leaf_query("n7_phase_pivot", ["γ"])
_leaf_query("n8_context_rename", ["纳米压痕硬度(GPa)", "硬度"])


@register("n5_prefixed_nested_leaf", "SELECT o_orderkey AS doc_no, '条件_温度' AS field, CAST(CAST(FLOOR(o_totalprice) AS BIGINT) % 73 AS VARCHAR) AS value FROM orders")
def _(t):
    rules = leaves.LeafRules(pivots=False, prefix_nested=True, renames={})
    return leaves.extract_leaves(keyed_records(t).select("doc_no", F.col("pos").alias("rec"), "data"), ["doc_no", "rec"], rules=rules).filter("field = '条件_温度'").select("doc_no", "field", "value")


@register("n9_last_write_wins", "SELECT l_orderkey AS rec, l_returnflag AS field, CAST(arg_max(l_partkey, l_linenumber * 1000000000000 + l_partkey) AS VARCHAR) AS value FROM lineitem GROUP BY 1, 2")
def _(t):
    rows = t.lineitem.select(F.col("l_orderkey").alias("rec"), F.col("l_returnflag").alias("field"), F.col("l_partkey").cast("string").alias("value"),
                             (F.col("l_linenumber").cast("bigint") * 1000000000000 + F.col("l_partkey")).alias("leaf_pos"))
    return leaves.last_write_wins(rows, ["rec"]).select("rec", "field", "value")


@register("n10_field_skip", "SELECT field, COUNT(*) AS n FROM x_leaf GROUP BY 1")
def _(t):
    return order_leaves(t).groupBy("field").agg(F.count(F.lit(1)).alias("n"))


@register("n11_metadata_projection", """
SELECT doc_no, CAST(pos AS BIGINT) AS pos, left(title, 200) AS title, producer AS data_producers, '' AS data_organizations FROM x_record
UNION ALL SELECT -1 - c_custkey, p, 'K', u, '' FROM (SELECT c_custkey, unnest([0, 2, 2147483648]) AS p, unnest([c_name, c_name, '']) AS u FROM customer) q""")
def _(t):
    docs = t.docs_array.unionAll(t.docs_template.select((-1 - F.col("doc_no")).alias("doc_no"), "value"))
    return ingest.records_of(docs, RULES).select("doc_no", "pos", F.substring("title", 1, 200).alias("title"), "data_producers", "data_organizations")


@register("n11_truncate", "SELECT doc_id, left(text, 100) AS producer, left(text, 200) AS title, md5(left(text, 2000)) AS value_md5 FROM documents")
def _(t):
    text = F.col("text")
    return t.documents.select("doc_id", F.substring(text, 1, shaping.PARTY_WIDTH).alias("producer"), F.substring(text, 1, shaping.TITLE_WIDTH).alias("title"),
                              F.md5(F.substring(text, 1, shaping.VALUE_WIDTH)).alias("value_md5"))


def mapped(t: Tables):
    return shaping.map_fields(order_leaves(t), t.field_dict, t.ingest_property)


@register("n12_map_fields", """SELECT l.doc_no, CAST(l.pos AS BIGINT) AS rec, l.field, d.property_id, COALESCE(p.property_name, CAST(d.property_id AS VARCHAR)) AS property_name, l.value
FROM x_leaf l JOIN field_dict d USING (field) LEFT JOIN ingest_property p ON p.property_id = d.property_id WHERE d.property_id IS NOT NULL""")
def _(t):
    return mapped(t).select("doc_no", "rec", "field", "property_id", "property_name", "value")


@register("n13_dict_override", "SELECT field, CASE WHEN x.pid IS NOT NULL THEN x.pid ELSE b.property_id END AS property_id FROM field_dict b FULL OUTER JOIN (SELECT p_name AS field, MAX(p_size) AS pid FROM part GROUP BY 1 UNION ALL SELECT 'status', 99) x USING (field)")
def _(t):
    extra = t.part.groupBy(F.col("p_name").alias("field")).agg(F.max("p_size").alias("property_id"))
    late = t.spark.sql("SELECT 'status' AS field, 99 AS property_id")
    return dictionary.dict_override(t.field_dict, extra.unionAll(late))


@register("n14_classify_roles", "SELECT v.title, v.property_id, COALESCE(r.role, 'result') AS role, COUNT(*) AS n FROM x_value v LEFT JOIN role_dict r ON r.title = v.title AND r.property_id = v.property_id GROUP BY 1, 2, 3")
def _(t):
    titles = keyed_records(t).filter("raw_id IS NOT NULL").select("doc_no", F.col("pos").alias("rec"), "title")
    rows = mapped(t).join(titles, ["doc_no", "rec"])
    return shaping.classify_roles(rows, t.role_dict).groupBy("title", "property_id", "role").agg(F.count(F.lit(1)).alias("n"))


def roled_values(t: Tables):
    """Value rows with a role that depends on the property."""
    role = F.when(F.col("property_id").isin(1, 11, 21), "object").when(F.col("property_id").isin(4, 5, 32), "operate").otherwise("result")
    return t.eav_value.withColumn("role", role)


ROLE_SQL = "CASE WHEN property_id IN (1, 11, 21) THEN 'object' WHEN property_id IN (4, 5, 32) THEN 'operate' ELSE 'result' END"


@register("n15_role_bitmap", f"""
SELECT data_id, rpad(array_to_string([CASE WHEN list_contains(object, i) THEN '1' ELSE '0' END FOR i IN range(0, 64)], ''), 1024, '0') AS object,
rpad(array_to_string([CASE WHEN list_contains(operate, i) THEN '1' ELSE '0' END FOR i IN range(0, 64)], ''), 1024, '0') AS operate,
rpad(array_to_string([CASE WHEN list_contains(result, i) THEN '1' ELSE '0' END FOR i IN range(0, 64)], ''), 1024, '0') AS result
FROM (SELECT data_id, COALESCE(list(property_id) FILTER (role = 'object'), []) AS object, COALESCE(list(property_id) FILTER (role = 'operate'), []) AS operate,
COALESCE(list(property_id) FILTER (role = 'result'), []) AS result FROM (SELECT data_id, property_id, {ROLE_SQL} AS role FROM eav_value) q GROUP BY 1) s""")
def _(t):
    return shaping.role_bitmap(roled_values(t))


@register("n15_legacy_bitmap", f"""
SELECT data_id, CASE WHEN len(ids) = 0 THEN '0' ELSE reverse(array_to_string([CASE WHEN list_contains(ids, i) THEN '1' ELSE '0' END FOR i IN range(0, list_max(ids) + 1)], '')) END AS object
FROM (SELECT data_id, COALESCE(list(property_id) FILTER ({ROLE_SQL} = 'object'), []) AS ids FROM eav_value GROUP BY 1) q""")
def _(t):
    return shaping.role_bitmap(roled_values(t), "legacy").select("data_id", "object")


@register("n16_ids_to_bitmap", "SELECT p_partkey, rpad(array_to_string([CASE WHEN i = p_size OR i = 60 THEN '1' ELSE '0' END FOR i IN range(0, 64)], ''), 1024, '0') AS bits FROM part")
def _(t):
    text = F.concat(F.lit("ids: "), F.col("p_size").cast("string"), F.lit(", 60; 5000"))
    return t.part.select("p_partkey", bitmaps.ids_to_bitmap(text).alias("bits"))


@register("n17_merge_values", """SELECT l_orderkey AS rec, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS property_id,
string_agg(CAST(l_partkey AS VARCHAR), '|' ORDER BY l_linenumber, l_partkey) AS value FROM lineitem GROUP BY 1, 2""")
def _(t):
    pid = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3)
    rows = t.lineitem.select(F.col("l_orderkey").alias("rec"), pid.alias("property_id"), F.col("l_returnflag").alias("property_name"),
                             F.col("l_partkey").cast("string").alias("value"), F.struct("l_linenumber", "l_partkey").alias("leaf_pos"))
    return shaping.merge_values(rows, ["rec"]).select("rec", "property_id", "value")


@register("n18_drop_empty_entities", "SELECT c_custkey AS data_id FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def _(t):
    values = t.orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("data_id"))
    return shaping.entities_with_values(t.customer.select(F.col("c_custkey").alias("data_id")), values, "data_id")


@register("n19_drop_null_ids", "SELECT COUNT(*) AS skipped FROM x_record WHERE raw_id IS NULL")
def _(t):
    return shaping.split_null_ids(keyed_records(t))[1]


@register("n20_normalize_id", "SELECT o_orderkey, CASE WHEN k < 1000000 THEN k + 50000000 ELSE k END AS by_threshold, CASE WHEN o_orderstatus = 'F' THEN k + 50000000 ELSE k END AS by_envelope FROM (SELECT *, o_orderkey * 997 AS k FROM orders) q")
def _(t):
    k = F.col("o_orderkey") * 997
    return t.orders.select("o_orderkey", ids.normalize_id(k).alias("by_threshold"), ids.normalize_id(k, "envelope", F.col("o_orderstatus") == "F").alias("by_envelope"))


@register("n21_pad_id_8", "SELECT o_orderkey, CASE WHEN length(CAST(k AS VARCHAR)) < 8 THEN CAST('5' || lpad(CAST(k AS VARCHAR), 7, '0') AS BIGINT) ELSE k END AS padded, CAST('5' || CASE WHEN length(CAST(k AS VARCHAR)) < 7 THEN lpad(CAST(k AS VARCHAR), 7, '0') ELSE CAST(k AS VARCHAR) END AS BIGINT) AS unguarded FROM (SELECT *, o_orderkey * o_custkey AS k FROM orders) q")
def _(t):
    k = F.col("o_orderkey") * F.col("o_custkey")
    return t.orders.select("o_orderkey", ids.pad_id_8(k).alias("padded"), ids.pad_id_8(k, guard=False).alias("unguarded"))


@register("n22_fix_id", """SELECT o_orderkey, CAST(substr(s, 1 + greatest(0, least(length(regexp_extract(s, '^(5*)', 1)), length(s) - 8))) AS BIGINT) AS fixed
FROM (SELECT o_orderkey, '555' || lpad(CAST(o_orderkey * 55 AS VARCHAR), 7, '5') AS s FROM orders) q""")
def _(t):
    s = F.concat(F.lit("555"), F.lpad((F.col("o_orderkey") * 55).cast("string"), 7, "5"))
    return t.orders.select("o_orderkey", ids.fix_id(s).alias("fixed"))


def resolved(t: Tables):
    raw = keyed_records(t).filter("raw_id IS NOT NULL").select(
        "doc_no", "pos", ids.normalize_id(F.col("raw_id")).alias("data_id"))
    return numbering.resolve_id_collisions(raw, "data_id", ["doc_no", "pos"])


@register("n23_resolve_id_collisions", "SELECT doc_no, CAST(pos AS BIGINT) AS pos, data_id FROM x_resolved")
def _(t):
    return resolved(t).select("doc_no", "pos", "data_id")


RANGE_DICT = "SELECT * FROM VALUES ('price', 32), ('ship', 33), ('status', 31), ('tags', 57) AS t(field, property_id)"


@register("n24_range_rows", """
SELECT doc_no, 32 AS property_id, 'o_totalprice_lb' AS property_name, CAST(t AS VARCHAR) AS value FROM x_record WHERE pos = 0
UNION ALL SELECT doc_no, 32, 'o_totalprice_ub', CAST(t + 100 AS VARCHAR) FROM x_record WHERE pos = 0
UNION ALL SELECT doc_no, 33, 'o_orderpriority', '{"flag":"' || title || '","deep":{"x":1}}' FROM x_record WHERE pos = 0
UNION ALL SELECT doc_no, 57, '57', '[1,2]' FROM x_record WHERE pos = 0
UNION ALL SELECT doc_no, 31, 'o_orderstatus', o_orderstatus FROM x_record WHERE pos = 0
UNION ALL SELECT doc_no, 31, 'o_orderstatus', 'late' FROM x_record WHERE pos = 0 AND title = '1-URGENT'""")
def _(t):
    records = keyed_records(t).filter(F.col("pos") == 0).select("doc_no", "data")
    return shaping.range_rows(records, t.spark.sql(RANGE_DICT), t.ingest_property, ["doc_no"])


@register("n25_assign_dataset_id", "SELECT o_orderkey, printf('%04d', dense_rank() OVER (ORDER BY o_orderpriority)) AS dataset_id FROM orders")
def _(t):
    return numbering.assign_dataset_id(t.orders.select("o_orderkey", F.col("o_orderpriority").alias("title"))).select("o_orderkey", "dataset_id")


@register("n26_unpivot_to_eav", "SELECT data_id, property_id, property_name, value FROM eav_value")
def _(t):
    return t.eav_value


@register("ingest_values", """SELECT data_id, property_id, arg_min(property_name, ord) AS property_name, string_agg(value, '|' ORDER BY ord) AS value FROM x_value GROUP BY 1, 2""")
def _(t):
    return load(t).values


@register("ingest_entities", """
SELECT r.data_id, left(r.title, 200) AS title, r.producer AS data_producers, b.n_object, b.n_operate, b.n_result FROM x_resolved r JOIN (
  SELECT v.data_id, COUNT(DISTINCT CASE WHEN role = 'object' THEN v.property_id END) AS n_object, COUNT(DISTINCT CASE WHEN role = 'operate' THEN v.property_id END) AS n_operate,
  COUNT(DISTINCT CASE WHEN role IS NULL THEN v.property_id END) AS n_result
  FROM x_value v LEFT JOIN role_dict r ON r.title = v.title AND r.property_id = v.property_id GROUP BY 1) b USING (data_id)""")
def _(t):
    ones = lambda c: (F.octet_length(c) - F.octet_length(F.replace(F.col(c), F.lit("1"), F.lit("")))).cast("bigint").alias(f"n_{c}")
    return load(t).entities.select("data_id", "title", "data_producers", ones("object"), ones("operate"), ones("result"))


def load(t: Tables):
    return ingest.load(t.docs_array, "doc_no", t.field_dict, t.ingest_property, t.role_dict)


@register("v13_refresh_denormalized", "SELECT v.property_id, CASE WHEN v.property_id = 5 THEN 'price' ELSE v.property_name END AS property_name, COUNT(*) AS n, SUM(CASE WHEN v.property_id = 5 THEN 1 ELSE 0 END)::BIGINT AS n_changed FROM eav_value v GROUP BY 1, 2")
def _(t):
    renamed = t.eav_property.withColumn("property_name", F.when(F.col("property_id") == 5, "price").otherwise(F.col("property_name")))
    return shaping.refresh_denormalized(t.eav_value, renamed).groupBy("property_id", "property_name").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("changed").alias("n_changed"))

"""Test tables and the fixtures derived from them.

A fixture is one SELECT that Spark and DuckDB both read; ``{name}`` stands for a
table or another fixture.  Fixtures only restate the given tables as EAV rows,
JSON documents, sample queries and stored results; all of them grow with the tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparsile.operators.shaping import unpivot_to_eav
from sparsile.sizing import spread

SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
                "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def _money(column: str) -> str:
    return f"CAST(CAST({column} AS DECIMAL(18,2)) AS STRING)"


# data_id = 1,000,000 + 4 * key + table code, so ids of the four tables never meet
PART_ID, SUPPLIER_ID, CUSTOMER_ID, ORDER_ID = (
    "1000000 + 4 * p_partkey", "1000001 + 4 * s_suppkey", "1000002 + 4 * c_custkey", "1000003 + 4 * o_orderkey")

PROPERTIES = {
    "part": (PART_ID, {1: ("p_name", "p_name"), 2: ("p_brand", "p_brand"), 3: ("p_type", "p_type"),
                       4: ("p_size", "CASE WHEN p_size <= 40 THEN CAST(p_size AS STRING) END"), 5: ("p_retailprice", _money("p_retailprice"))}),
    "supplier": (SUPPLIER_ID, {11: ("s_name", "s_name"), 12: ("s_nationkey", "CAST(s_nationkey AS STRING)"), 13: ("s_acctbal", _money("s_acctbal"))}),
    "customer": (CUSTOMER_ID, {21: ("c_name", "c_name"), 22: ("c_nationkey", "CAST(c_nationkey AS STRING)"),
                               23: ("c_acctbal", f"CASE WHEN c_acctbal >= 0 THEN {_money('c_acctbal')} END"), 24: ("c_mktsegment", "c_mktsegment")}),
    "orders": (ORDER_ID, {31: ("o_orderstatus", "o_orderstatus"), 32: ("o_totalprice", _money("o_totalprice")),
                          33: ("o_orderpriority", "CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderpriority END")}),
}

_VALUE_SELECTS = " UNION ALL ".join(
    f"SELECT {data_id} AS data_id, {pid} AS property_id, '{name}' AS property_name, {cell} AS value FROM {{{table}}}"
    for table, (data_id, cells) in PROPERTIES.items() for pid, (name, cell) in cells.items())
_PROPERTY_ROWS = [(pid, name) for _, cells in PROPERTIES.values() for pid, (name, _) in cells.items()] + [
    (pid, f"unused_{pid}") for pid in range(40, 45)]

# edge texts of the numeric views, one entity each, appended to the real values
EDGE_TEXTS = ["", None, "abc", "0.6~1.2", "12|13", "16%", " 7 ", "1e3", "-.5", ">=27", "1234567890123456789"]
_EDGE_ROWS = ", ".join(f"({-1 - i}, {'NULL' if t is None else chr(39) + t + chr(39)})" for i, t in enumerate(EDGE_TEXTS))



def _num(alias: str) -> str:
    return f"{alias}.value != '''' AND {alias}.value IS NOT NULL AND CAST({alias}.value AS DECIMAL(30, 15))"


_FROM = "FROM eav.entity_table e JOIN eav.value_table v ON v.data_id = e.data_id"
_FROM2 = f"{_FROM} JOIN eav.value_table v2 ON v2.data_id = e.data_id"
_HEAD = "SELECT DISTINCT e.data_id"
_TAIL = " ORDER BY e.data_id ASC"

# one question and one query text per part, the form chosen by the part's size
_SAMPLE_CASES = [
    ("p_size <= 5", f"'{_HEAD} {_FROM} WHERE v.property_id = 5 AND {_num('v')} > ' || r || '{_TAIL}'", "'p_retailprice大于' || r || '的有哪些'"),
    ("p_size <= 10", f"'{_HEAD} {_FROM2} WHERE v.property_id = 4 AND {_num('v')} BETWEEN ' || s || ' AND ' || s10 || ' AND v2.property_id = 5 AND {_num('v2')} >= ' || r || '{_TAIL}'",
     "'p_size在' || s || '到' || s10 || '之间且p_retailprice不低于' || r"),
    ("p_size <= 14", f"'SELECT AVG(CAST(v.value AS DECIMAL(30, 15))) FROM eav.value_table v WHERE v.property_id = 5 AND CAST(v.value AS DECIMAL(30, 15)) < ' || r",
     "'p_retailprice小于' || r || '的平均值'"),
    ("p_size <= 17", "'SELECT MAX(v.value), COUNT (v.value) FROM eav.value_table v WHERE v.property_id = 4'", "'p_size最大是多少'"),
    ("p_size <= 21", f"'{_HEAD} {_FROM} WHERE v.property_id = 2 AND v.value = ''' || p_brand || '''' || CASE WHEN p_type = 'PROMO' THEN '  ' ELSE ' ' END || '{_TAIL}'",
     "'p_brand为 ' || CASE WHEN p_retailprice > 950 THEN p_brand ELSE 'other' END || ' 的都有哪些'"),
    ("p_size <= 24", f"'{_HEAD} {_FROM} WHERE v.property_id = 5 AND {_num('v')} > 0.0;'", "'p_retailprice大于0的有哪些'"),
    ("p_size <= 27", f"'{_HEAD} {_FROM} WHERE v.property_id = 5 AND {_num('v')} < = ' || r", "'p_retailprice不超过' || r"),
    ("p_size <= 30", f"'{_HEAD} {_FROM2} WHERE v.property_id = 3 AND v.value <> ''' || p_type || ''' AND v2.property_id = 2 AND v2.value NOT LIKE ''%' || s || ''''",
     "'p_type不是' || p_type"),
    ("p_size <= 33", f"'{_HEAD} {_FROM} WHERE v.property_id = 1 AND e.data_id IN ( SELECT x.data_id FROM eav.value_table x WHERE x.property_id = 4 AND x.value > ' || s || ')'",
     "'p_size高于' || s || '的p_name'"),
    ("p_size <= 36", f"'{_HEAD} {_FROM} WHERE v.property_id IN (4, 5) AND v.value > ' || r", "'超过' || r"),
    ("p_size <= 40", f"'{_HEAD} {_FROM} WHERE v.property_id = 5 AND (CAST(v.value AS DECIMAL(30, 15)) > ' || r || ' OR CAST(v.value AS DECIMAL(30, 15)) < 910)'",
     "'p_retailprice大于' || r || '或小于910'"),
    ("p_size <= 44", f"'{_HEAD} {_FROM} WHERE v.property_id = 5 AND {_num('v')} < ' || r", "'p_retailprice大于' || r || '的统计'"),
    ("p_size <= 46", "''", "'没有查询'"),
]
_SAMPLE_ELSE = (f"'{_HEAD} {_FROM2} WHERE v.property_id = 5 AND {_num('v')} > 910 AND v2.property_id = 5 AND {_num('v2')} < ' || r",
                "'p_retailprice在910以上，p_retailprice低于' || r")


def _cases(i: int) -> str:
    whens = " ".join(f"WHEN {c[0]} THEN {c[i]}" for c in _SAMPLE_CASES)
    return f"CASE {whens} ELSE {_SAMPLE_ELSE[i - 1]} END"


_T = "CAST(FLOOR(o_totalprice) AS BIGINT)"
_REC1 = (
    "'{{\"_meta_id\": ' || o_orderkey || ', \"title\": \"' || o_orderpriority || '\", \"data\": {{\"META_数据生产者\": \"clerk ' || o_custkey || "
    "'\", \"status\": \"' || o_orderstatus || '\", \"price\": {{\"lb\": ' || t || ', \"ub\": ' || (t + 100) || "
    "'}}, \"ship\": {{\"flag\": \"' || o_orderpriority || '\", \"deep\": {{\"x\": 1}}}}, \"items\": [{{\"元素\": \" Co \", \"含量\": ' || (t % 97) || "
    "'}}, {{\"成分\": \"Ni\", \"含量(wt%)\": \"' || (t % 89) || '\"}}], \"phases\": [{{\"相名称\": \"γ\", \"含量值\": ' || (t % 83) || "
    "'}}], \"纳米压痕硬度(GPa)\": [{{\"硬度\": ' || (t % 79) || ', \"条件\": {{\"温度\": ' || (t % 73) || "
    "'}}}}], \"tags\": [1, 2], \"nothing\": null, \"化学结构式\": \"skip\", \"note\": \"\"' || "
    "CASE WHEN o_orderpriority = '1-URGENT' THEN ', \"status\": \"late\"' ELSE '' END || '}}}}'")
_REC2 = ("'{{\"_meta_id\": ' || CASE WHEN o_orderstatus = 'P' THEN 'null' ELSE CAST(o_custkey AS STRING) END || "
         "', \"title\": \"' || o_orderpriority || '\", \"data\": {{\"status\": \"' || o_orderstatus || '\"}}}}'")
_TEMPLATE = ("'{{\"template\": {{\"_v\": 1, \"K\": {{}}}}, \"data\": [{{\"meta\": {{\"数据ID\": ' || c_custkey || ', \"上传人\": \"' || c_name || "
             "'\"}}, \"content\": {{\"K\": [{{\"seg\": \"' || c_mktsegment || '\"}}, 5, {{\"seg\": \"second\", \"bal\": ' || CAST(FLOOR(c_acctbal) AS BIGINT) || "
             "'}}]}}}}, {{\"meta\": {{\"数据ID\": ' || (c_custkey + 1000000) || '}}, \"content\": {{\"K\": {{\"seg\": \"single\"}}}}}}]}}'")

# five operators over the nations, so that every boundary kind occurs
_NATION_OP = "CASE n_nationkey % 5 WHEN 0 THEN '> ' || t WHEN 1 THEN '>= ' || t WHEN 2 THEN '< ' || t WHEN 3 THEN '<= ' || t ELSE 'BETWEEN ' || t || ' AND ' || (t + 5000) END"
_NATION_TEST = ("CASE n_nationkey % 5 WHEN 0 THEN b > t WHEN 1 THEN b >= t WHEN 2 THEN b < t WHEN 3 THEN b <= t ELSE b BETWEEN t AND t + 5000 END")

FIXTURES: dict[str, str] = {
    "eav_property": f"SELECT * FROM (VALUES {', '.join(str(r) for r in _PROPERTY_ROWS)}) AS t(property_id, property_name)",
    "eav_entity": " UNION ALL ".join(f"SELECT {i} AS data_id, '{t}' AS title FROM {{{t}}}" for t, (i, _) in PROPERTIES.items()),
    "eav_value": f"SELECT * FROM ({_VALUE_SELECTS}) u WHERE value IS NOT NULL",
    "eav_value_dirty": f"SELECT data_id, property_id, value FROM {{eav_value}} UNION ALL SELECT CAST(i AS BIGINT), 5, x FROM (VALUES {_EDGE_ROWS}) AS t(i, x)",
    "samples": ("SELECT p_partkey AS sample_id, 'part' AS title, " + _cases(1) + " AS sql, " + _cases(2) + " AS natural_language "
                "FROM (SELECT *, CAST(p_size AS STRING) AS s, CAST(p_size + 10 AS STRING) AS s10, " + _money("p_retailprice") + " AS r FROM {part}) q"),
    # stored results of the samples: orders that bought the part in small quantities
    "sample_result": ("SELECT DISTINCT l_partkey AS sample_id, 1000003 + 4 * l_orderkey AS data_id FROM {lineitem} JOIN {part} ON l_partkey = p_partkey "
                      "WHERE l_quantity <= p_size"),
    # a boundary workload: customers of one nation by balance
    "nation_samples": (
        "SELECT CAST(n_nationkey AS BIGINT) AS sample_id, 'customer' AS title, "
        f"'{_HEAD} {_FROM2} WHERE v.property_id = 22 AND v.value = ''' || n_nationkey || ''' AND v2.property_id = 23 AND {_num('v2')} ' || {_NATION_OP} || '{_TAIL}' AS sql, "
        "'c_nationkey为 ' || n_nationkey || '且c_acctbal' || CASE n_nationkey % 5 WHEN 0 THEN '大于' || t WHEN 1 THEN '不低于' || t WHEN 2 THEN '超过' || t "
        "WHEN 3 THEN '不超过' || t ELSE '在' || t || '到' || (t + 5000) || '之间' END AS natural_language FROM (SELECT *, 100 * n_nationkey AS t FROM {nation}) q"),
    # their stored results; those of region 4 have lost the AUTOMOBILE customers
    "nation_result": (
        "SELECT CAST(n_nationkey AS BIGINT) AS sample_id, data_id FROM (SELECT n_nationkey, n_regionkey, 100 * n_nationkey AS t, c_acctbal AS b, c_mktsegment, "
        f"{CUSTOMER_ID} AS data_id FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey WHERE c_acctbal >= 0) q "
        f"WHERE {_NATION_TEST} AND NOT (n_regionkey = 4 AND c_mktsegment = 'AUTOMOBILE')"),
    # parts of an order as a result list with repeats, in line order
    "order_result": (
        "SELECT l_orderkey AS sample_id, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos, "
        "1000000 + 4 * l_partkey AS data_id FROM {lineitem}"),
    "part_record": f"SELECT {PART_ID} AS data_id, p_name || '/' || p_brand AS record FROM {{part}} WHERE p_size <= 40",
    "predicates": (
        "SELECT CAST(sample_id AS BIGINT) AS sample_id, clause, alias, property_id, kind, op, CAST(lo AS DECIMAL(30,15)) AS lo, CAST(hi AS DECIMAL(30,15)) AS hi, text FROM (VALUES "
        "(1, 0, 'v', 4, 'between', NULL, '10', '20', NULL), (1, 0, 'v2', 5, 'num', '>', '905', NULL, NULL), "
        "(2, 0, 'v', 5, 'num', '>=', '950', NULL, NULL), (2, 0, 'v', 5, 'num', '<', '960', NULL, NULL), "
        "(3, 0, 'v', 2, 'str', '=', NULL, NULL, 'Brand#2'), (3, 1, 'v', 4, 'num', '=', '7', NULL, NULL), "
        "(4, 0, 'v', 3, 'like', NULL, NULL, NULL, 'S%'), (4, 0, 'v2', 1, 'not_like', NULL, NULL, NULL, '%red%'), "
        "(5, 0, 'v', 13, 'bare', '>', '5000', NULL, NULL), (5, 0, 'v2', 12, 'str', '!=', NULL, NULL, '3'), "
        "(6, 0, 'v', 23, 'num', '<=', '100', NULL, NULL), (6, 0, 'v2', 23, 'non_empty', NULL, NULL, NULL, NULL), "
        "(7, 0, 'v', 32, 'num', '!=', '1', NULL, NULL), (7, 0, 'v2', 33, 'str', '=', NULL, NULL, '1-URGENT'), "
        "(8, 0, 'v', 5, 'num', '>', '5000', NULL, NULL), "
        "(9, 0, 'v', 22, 'bare_between', NULL, '3', '5', NULL), (9, 0, 'v2', 24, 'any', NULL, NULL, NULL, NULL)"
        ") AS t(sample_id, clause, alias, property_id, kind, op, lo, hi, text)"),
    "docs_array": f"SELECT o_orderkey AS doc_no, '[' || {_REC1} || ', ' || {_REC2} || ', {{{{\"_meta_id\": 7, \"title\": \"no data\"}}}}]' AS value FROM (SELECT *, {_T} AS t FROM {{orders}}) q",
    "docs_template": f"SELECT c_custkey AS doc_no, {_TEMPLATE} AS value FROM {{customer}}",
    "field_dict": ("SELECT * FROM (VALUES ('status', 31), ('price_lb', 32), ('price_ub', 32), ('flag', 33), ('Co', 51), ('Ni', 52), ('γ', 53), "
                   "('纳米压痕硬度(GPa)', 54), ('温度', 55), ('note', 56), ('seg', 24), ('bal', 23), ('x', CAST(NULL AS INT))) AS t(field, property_id)"),
    "ingest_property": ("SELECT * FROM (VALUES (31, 'o_orderstatus'), (32, 'o_totalprice'), (33, 'o_orderpriority'), (51, 'cobalt'), (52, 'nickel'), "
                        "(53, 'gamma'), (54, 'hardness'), (55, 'temperature'), (24, 'c_mktsegment'), (23, 'c_acctbal')) AS t(property_id, property_name)"),
    "role_dict": ("SELECT * FROM (VALUES ('1-URGENT', 31, 'object'), ('1-URGENT', 32, 'operate'), ('5-LOW', 31, 'operate'), ('2-HIGH', 51, 'object'), "
                  "('K', 24, 'object')) AS t(title, property_id, role)"),
    "terms": ("SELECT * FROM (VALUES ('p_retailprice', 5, CAST(NULL AS STRING)), ('price', 32, NULL), ('p_size', 4, NULL), ('size', 4, 'orders'), "
              "('p_brand', 2, NULL), ('p_type', 3, NULL), ('p_name', 1, NULL), ('c_acctbal', 13, NULL), ('c_acctbal', 23, 'customer'), "
              "('c_nationkey', 22, NULL), ('unheard_of', 44, NULL)) AS t(term, property_id, title)"),
}

# Expected intermediate results, used by the check SQL only.
EXPECTED: dict[str, str] = {
    "x_record": (
        "SELECT *, CASE WHEN raw_id < 1000000 THEN raw_id + 50000000 ELSE raw_id END AS norm_id FROM ("
        f"SELECT o_orderkey AS doc_no, 0 AS pos, o_orderkey AS raw_id, o_orderpriority AS title, 'clerk ' || o_custkey AS producer, o_orderstatus, {_T} AS t, o_custkey FROM {{orders}} UNION ALL "
        f"SELECT o_orderkey, 1, CASE WHEN o_orderstatus <> 'P' THEN o_custkey END, o_orderpriority, '', o_orderstatus, {_T}, o_custkey FROM {{orders}}) q"),
    "x_resolved": (
        "SELECT * EXCLUDE (dup, extra), CASE WHEN dup = 1 THEN norm_id ELSE (SELECT MAX(norm_id) FROM {x_record} WHERE raw_id IS NOT NULL) + extra END AS data_id FROM ("
        "SELECT *, ROW_NUMBER() OVER (PARTITION BY dup > 1 ORDER BY doc_no, pos) AS extra FROM ("
        "SELECT *, ROW_NUMBER() OVER (PARTITION BY norm_id ORDER BY doc_no, pos) AS dup FROM {x_record} WHERE raw_id IS NOT NULL) a) b"),
    "x_leaf": (
        "SELECT doc_no, pos, unnest([{{'ord': 1, 'field': 'status', 'value': CASE WHEN title = '1-URGENT' AND pos = 0 THEN 'late' ELSE o_orderstatus END}}, "
        "{{'ord': 2, 'field': 'price_lb', 'value': CAST(t AS VARCHAR)}}, {{'ord': 3, 'field': 'price_ub', 'value': CAST(t + 100 AS VARCHAR)}}, "
        "{{'ord': 4, 'field': 'flag', 'value': title}}, {{'ord': 5, 'field': 'Co', 'value': CAST(t % 97 AS VARCHAR)}}, {{'ord': 6, 'field': 'Ni', 'value': CAST(t % 89 AS VARCHAR)}}, "
        "{{'ord': 7, 'field': 'γ', 'value': CAST(t % 83 AS VARCHAR)}}, {{'ord': 8, 'field': '纳米压痕硬度(GPa)', 'value': CAST(t % 79 AS VARCHAR)}}, "
        "{{'ord': 9, 'field': '温度', 'value': CAST(t % 73 AS VARCHAR)}}, {{'ord': 10, 'field': 'note', 'value': ''}}], recursive := true) FROM {x_record} WHERE pos = 0 "
        "UNION ALL SELECT doc_no, pos, 1, 'status', o_orderstatus FROM {x_record} WHERE pos = 1"),
    "x_value": (
        "SELECT r.data_id, r.title, d.property_id, COALESCE(p.property_name, CAST(d.property_id AS VARCHAR)) AS property_name, l.ord, l.value FROM {x_leaf} l "
        "JOIN {x_resolved} r USING (doc_no, pos) JOIN {field_dict} d USING (field) LEFT JOIN {ingest_property} p ON p.property_id = d.property_id WHERE d.property_id IS NOT NULL"),
    "x_coverage": ("SELECT p.property_id, COUNT(DISTINCT v.data_id) AS entity_count FROM {eav_property} p LEFT JOIN {eav_value} v ON v.property_id = p.property_id GROUP BY 1"),
    "x_per_entity": "SELECT data_id, COUNT(DISTINCT property_id) AS property_count FROM {eav_value} GROUP BY 1",
    "x_size": "SELECT s.sample_id, COUNT(r.data_id) AS n_result FROM {samples} s LEFT JOIN {sample_result} r USING (sample_id) GROUP BY 1",
}

_HOLE = re.compile(r"(?<!\{)\{(\w+)\}(?!\})")


class Tables:
    """Given tables and fixtures of one data folder, as lazy DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._made = spark, folder.rstrip("/"), {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            self._made[name] = self._make(name)
        return self._made[name]

    def _make(self, name: str) -> DataFrame:
        if name in SCHEMAS:
            return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{name}.parquet")
        if name == "eav_value":
            return self._eav_value()
        if name in ("docs_array", "docs_template"):
            return self._documents(name)
        return self.sql(FIXTURES[name])

    def _documents(self, name: str) -> DataFrame:
        """Documents over all tasks, as the scan of a document folder would give
        them; the narrow source rows are spread before the JSON text is built."""
        source = "orders" if name == "docs_array" else "customer"
        return self.spark.sql(FIXTURES[name], **{source: spread(getattr(self, source))})

    def _eav_value(self) -> DataFrame:
        frames = [unpivot_to_eav(getattr(self, t), F.expr(data_id), {p: (n, F.expr(c)) for p, (n, c) in cells.items()})
                  for t, (data_id, cells) in PROPERTIES.items()]
        out = frames[0]
        for frame in frames[1:]:
            out = out.unionAll(frame)
        return out

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text, **{n: getattr(self, n) for n in set(_HOLE.findall(text))})


def with_fixtures(body: str) -> str:
    """Check SQL with every fixture it names put in front as a CTE."""
    known = {**FIXTURES, **EXPECTED}
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dep in _HOLE.findall(known[name]):
            if dep in known:
                visit(dep)
        order.append(name)

    for word in re.findall(r"\b\w+\b", body):
        if word in known:
            visit(word)
    if not order:
        return body
    plain = lambda text: _HOLE.sub(r"\1", text).replace("{{", "{").replace("}}", "}")
    return "WITH " + ", ".join(f"{n} AS ({plain(known[n])})" for n in order) + " " + body

"""Small fixtures, edge cases and equivalences."""

import json
import os
import random
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparsile.catalog.tables import EDGE_TEXTS
from sparsile.functions import bitmaps, ids, numeric, phrases, sqltext
from sparsile.operators import aggregate_queries, aggregates, leaves, matching, numbering, retrieval, scoring, shaping, stabbing
from sparsile.operators.retrieval import Condition
from sparsile.plans import ingest, validation, workload
from sparsile.session import fresh_path
from sparsile.sources import dictionary, eav_store, json_docs, reports


def test_numeric_modes_on_edge_texts(spark):
    expected = {"": (None, None, 0), None: (None, None, None), "abc": (None, None, 0), "0.6~1.2": (None, 0.6, 0.6), "12|13": (None, 12, 12),
                "16%": (None, 16, 16), " 7 ": (7, 7, 7), "1e3": (1000, 1000, 1000), "-.5": (-0.5, -0.5, -0.5), ">=27": (None, None, 0),
                "1234567890123456789": (None, None, 0)}
    frame = spark.createDataFrame([(t,) for t in EDGE_TEXTS], "v string")
    rows = frame.select("v", *[numeric.to_decimal(F.col("v"), m).cast("double").alias(m) for m in ("strict", "prefix", "mysql")]).collect()
    assert {r.v: (r.strict, r.prefix, r.mysql) for r in rows} == expected


def test_retrieval_equals_self_join(spark, tables):
    conditions = [Condition(4, "between", lo=10, hi=20), Condition(5, "num", ">", lo=905)]
    ours = [r.data_id for r in retrieval.retrieve(tables.eav_entity, tables.eav_value, conditions).collect()]
    v = tables.eav_value.withColumn("n", F.col("value").try_cast("decimal(30,15)"))
    a = v.filter("property_id = 4 AND n BETWEEN 10 AND 20").select("data_id")
    b = v.filter("property_id = 5 AND n > 905").select("data_id")
    assert ours == sorted(r.data_id for r in a.join(b, "data_id").distinct().collect()) and ours


def test_workload_equals_single_retrievals_and_salted_plan(spark, tables):
    broadcast = retrieval.evaluate_predicates(tables.eav_value, tables.predicates, tables.eav_entity)
    salted = retrieval.evaluate_predicates(tables.eav_value, tables.predicates, tables.eav_entity, max_predicates=0)
    pairs = lambda df: sorted((r.sample_id, r.data_id) for r in df.collect())
    assert pairs(broadcast) == pairs(salted)
    single = retrieval.retrieve(tables.eav_entity, tables.eav_value, [Condition(4, "between", lo=10, hi=20), Condition(5, "num", ">", lo=905)])
    assert [d for s, d in pairs(broadcast) if s == 1] == [r.data_id for r in single.collect()]


def test_run_queries_policies(spark):
    good, bad = (1, "SELECT 5 AS x"), (2, "SELECT nothing FROM nowhere")
    kept = retrieval.run_queries(spark, [good, bad]).collect()
    assert {r.sample_id: (r.value, r.error is not None) for r in kept} == {1: ("5", False), 2: (None, True)}
    assert retrieval.run_queries(spark, [good, bad], "empty").count() == 1
    with pytest.raises(Exception):
        retrieval.run_queries(spark, [bad], "raise")


def test_any_part_of_merged_value(spark):
    v = spark.createDataFrame([(1, 7, "12|13"), (2, 7, "1|2"), (3, 7, "x|20%"), (4, 8, "99")], "data_id long, property_id int, value string")
    assert [r.data_id for r in retrieval.any_value(v, 7, ">=", 13).orderBy("data_id").collect()] == [1, 3]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(min_value=0, max_value=10**9), min_size=1, max_size=20))
def test_padding_is_idempotent(spark, keys):
    frame = spark.createDataFrame([(k,) for k in keys], "k long")
    once = ids.pad_id_8(F.col("k"))
    assert all(r.a == r.b for r in frame.select(once.alias("a"), ids.pad_id_8(once).alias("b")).collect())


def test_fix_id(spark):
    rows = {55550331752: 50331752, 12345678: 12345678, 123456789: 123456789, 5555555555: 55555555, 550: 550}
    frame = spark.createDataFrame([(k,) for k in rows], "k long").select("k", ids.fix_id(F.col("k")).alias("f"))
    assert {r.k: r.f for r in frame.collect()} == rows


@settings(max_examples=10, deadline=None)
@given(st.sets(st.integers(min_value=0, max_value=1023), max_size=40))
def test_bitmap_round_trip(spark, members):
    frame = spark.createDataFrame([(sorted(members) + [4000, -1],)], "ids array<int>")
    row = frame.select(bitmaps.bitmap(F.col("ids")).alias("b")).select("b", bitmaps.bitmap_to_ids(F.col("b")).alias("back")).first()
    assert len(row.b) == 1024 and row.back == sorted(members)


def test_legacy_bitmaps(spark):
    frame = spark.createDataFrame([([0, 3],), ([],)], "ids array<int>")
    rows = frame.select(bitmaps.legacy_bitmap(F.col("ids")).alias("a"), bitmaps.legacy_bitmap(F.col("ids"), "").alias("b")).collect()
    assert [(r.a, r.b) for r in rows] == [("1001", "1001"), ("0", "")]


def test_leaf_rules(spark):
    record = {"a": "{x", "META_q": 1, "n": None, "t": True, "o": {"z": 1, "w": "k", "deep": {"p": 1}}, "r": {"lb": 2.5, "ub": None},
              "l": [{"y": "4", "m": {"q": 1}}, 5, {"元素": " Co ", "含量": 4.5}, {"相名称": "p1", "含量值": 7}, {"元素": "", "含量(wt%)": 1}],
              "s": [1, 2], "e": "", "q": [{"u": "[1]"}, "text"], "纳米压痕硬度(GPa)": [{"硬度": 3}], "y": "last"}
    frame = spark.createDataFrame([(1, json.dumps(record, ensure_ascii=False))], "id long, data string")
    found = {r.field: r.value for r in leaves.extract_leaves(frame, ["id"]).collect()}
    assert found == {"a": "{x", "t": "true", "z": "1", "w": "k", "r_lb": "2.5", "y": "last", "q": "1", "Co": "4.5", "p1": "7", "e": "",
                     "u": "[1]", "纳米压痕硬度(GPa)": "3"}


def test_leaves_survive_repeated_nested_keys(spark):
    frame = spark.createDataFrame([(1, '{"o": {"x": 1, "x": 2}, "k": "v"}')], "id long, data string")
    assert {r.field: r.value for r in leaves.extract_leaves(frame, ["id"]).collect()} == {"x": "2", "k": "v"}


def test_document_folder(spark):
    path = fresh_path(spark, "folder")
    os.makedirs(path)
    envelope = [{"_meta_id": 1, "data": {"f": 1}}, {"_meta_id": None, "data": {"f": 2}}, {"_meta_id": 3, "title": "no data"}]
    files = {"b.json": json.dumps(envelope, indent=2), "c.json": '{"template": {"_v": 1, "K": {}}, "data": [{"meta": {"数据ID": 9}, "content": {"K": {"f": 3}}}]}',
             "d.json": '{"other": 1}', "e.json": "[1, ", "b.json.bak": "[]"}
    for name, text in files.items():
        with open(f"{path}/{name}", "w", encoding="utf-8") as out:
            out.write(text)
    docs = json_docs.read_json_datasets(spark, path)
    assert sorted(r.file_name for r in docs.collect()) == ["b.json", "c.json", "d.json", "e.json"]
    good, bad = json_docs.split_corrupt(docs)
    assert {r.file_name: r.reason for r in bad.collect()} == {"d.json": "unknown format", "e.json": "unreadable"}
    first = json_docs.explode_array_envelope(good).orderBy("pos").collect()
    assert [(r.raw_id, r.title) for r in first] == [(1, "b.json"), (None, "b.json")]
    assert [(r.raw_id, r.title) for r in json_docs.explode_template_envelope(good).collect()] == [(9, "K")]


def test_dense_number_matches_row_number(spark):
    rng = random.Random(7)
    keys = [rng.choice([rng.randrange(1 << 44), rng.randrange(5000), 77]) for _ in range(3000)]
    frame = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, i long")
    got = {r.i: r.n for r in numbering.dense_number(frame, "k", "n", order_within=["i"]).collect()}
    expected = {i: n for n, (k, i) in enumerate(sorted((k, i) for i, k in enumerate(keys)), 1)}
    assert got == expected


def test_collisions_with_one_hot_id(spark):
    rows = [(10 if i % 3 == 0 else i + 100, i) for i in range(3000)]
    out = numbering.resolve_id_collisions(spark.createDataFrame(rows, "id long, o long"), "id", ["o"]).collect()
    assert len({r.id for r in out}) == 3000 and {r.o: r.id for r in out}[0] == 10
    moved = sorted((r.o, r.id) for r in out if r.o % 3 == 0 and r.o)
    top = max(i for i, _ in rows)
    assert [i for _, i in moved] == list(range(top + 1, top + 1 + len(moved)))


def test_exact_percentiles_with_one_hot_value(spark):
    rows = [("a", 5.0)] * 500 + [("a", float(i) / 7) for i in range(1000)] + [("b", 3.5)]
    frame = spark.createDataFrame(rows, "g string, v double")
    ours = {r.g: (r.p50, r.p95) for r in numbering.exact_percentiles(frame, "v", ["g"], {"p50": 0.5, "p95": 0.95}).collect()}
    theirs = {r.g: (r.p50, r.p95) for r in frame.groupBy("g").agg(F.median("v").alias("p50"), F.percentile("v", F.lit(0.95)).alias("p95")).collect()}
    assert ours == {g: pytest.approx(v) for g, v in theirs.items()}


def test_packed_results_keep_every_id(spark):
    results = spark.range(10000).select(F.lit(1).cast("long").alias("sample_id"), (F.col("id") * 3).alias("data_id"))
    packed = reports.pack_results(results, chunk=1000).orderBy("chunk").collect()
    assert [len(r.result) for r in packed] == [1000] * 10 and [x for r in packed for x in r.result] == [3 * i for i in range(10000)]


def test_upsert_takes_newest(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    updates = spark.createDataFrame([(2, "old", 1), (2, "new", 5), (3, "c", 2), (1, None, 9)], "k long, v string, seq long")
    assert {r.k: r.v for r in eav_store.upsert(target, updates, ["k"], "seq").collect()} == {1: None, 2: "new", 3: "c"}


def test_dictionaries(spark):
    fields = dictionary.dictionary_rows(spark.createDataFrame([('{" a": 3, "b": null, "c": "7"}',)], "value string"))
    assert {r.field: r.property_id for r in fields.collect()} == {" a": 3, "c": 7}
    roles = dictionary.role_rows(spark.createDataFrame([('{"T": {"dataset_index": 1, "object": [1, 2], "operate": [2], "result": []}}',)], "value string"))
    assert {(r.property_id, r.role) for r in roles.collect()} == {(1, "object"), (2, "operate")}


def tail(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(phrases.tail_condition(F.col("t")).alias("c")).first().c
    return row and (row.op, None if row.lo is None else float(row.lo), None if row.hi is None else float(row.hi), row.text)


@pytest.mark.parametrize("text, expected", [
    ("大于等于5", (">=", 5, None, None)), ("不超过 3.5的", ("<=", 3.5, None, None)), ("大于1.5万", (">", 15000, None, None)), ("在20以上", (">", 20, None, None)),
    ("在-3以下", ("<", -3, None, None)), ("为 1.74 和 1.75 之间", ("BETWEEN", 1.74, 1.75, None)), ("在1到2之间", ("BETWEEN", 1, 2, None)),
    ("为7", ("=", 7, None, None)), ("是 IN718 的", ("=", None, None, "IN718")), ("很高", None)])
def test_phrases(spark, text, expected):
    assert tail(spark, text) == expected


def test_separator_does_not_fuse_numbers(spark):
    assert tail(spark, "大于5、6") == (">", 5, None, None)


def test_longest_term_wins(spark):
    questions = spark.createDataFrame([(1, "d", "抗拉强度大于5且强度小于3，上抗拉强度为 9")], "sample_id long, title string, text string")
    terms = spark.createDataFrame([("强度", 1, None), ("抗拉强度", 2, None), ("上抗拉强度", 3, None), ("强度", 8, "other")], "term string, property_id int, title string")
    rows = matching.text_conditions(questions, terms).orderBy("start").collect()
    assert [(r.property_id, r.op, float(r.lo)) for r in rows] == [(2, ">", 5), (1, "<", 3), (3, "=", 9)]


def test_seed_join_finds_what_inline_finds(spark, tables):
    terms = spark.createDataFrame([("the",), ("a",), ("\n",), ("è la",), ("nope!",)], "term string")
    docs = tables.documents.select("doc_id", "text")
    pairs = lambda df: sorted((r.doc_id, r.term) for r in df.select("doc_id", "term").collect())
    expected = sorted((r.doc_id, t) for r in docs.collect() for t in ("the", "a", "\n", "è la", "nope!") if t in r.text)
    assert pairs(matching.terms_in_text(docs, terms)) == expected == pairs(matching.terms_in_text(docs, terms, max_inline=0))


def conditions_of(spark, sql):
    frame = spark.createDataFrame([(1, sql)], "sample_id long, sql string")
    return sorted((r.clause, r.alias, r.property_id, r.kind, r.op, None if r.lo is None else float(r.lo), None if r.hi is None else float(r.hi), r.text)
                  for r in matching.extract_conditions(frame).collect())


def test_extraction_keeps_polarity_alias_and_quotes(spark):
    sql = ("SELECT 1 FROM t WHERE tab7.property_id = 3 AND tab7.value NOT LIKE '%x''y%' AND v2.property_id = 4 AND CAST(v2.value AS DECIMAL(30, 15)) BETWEEN 1.05AND 1.1 "
           "AND v3.property_id = 5 AND v3.value <> 'a' AND v4.property_id = 6 AND v4.value >= -2.5 AND v5.property_id = 7 AND v5.value != ''")
    assert conditions_of(spark, sql) == [(0, "tab7", 3, "not_like", None, None, None, "%x'y%"), (0, "v2", 4, "between", None, 1.05, 1.1, None),
                                         (0, "v3", 5, "str", "!=", None, None, "a"), (0, "v4", 6, "bare", ">=", -2.5, None, None), (0, "v5", 7, "non_empty", None, None, None, None)]


def test_extraction_of_alternatives(spark):
    sql = "SELECT 1 FROM t WHERE v.property_id = 5 AND (CAST(v.value AS DECIMAL(30, 15)) > 9 OR v.value = 'A OR B')"
    assert conditions_of(spark, sql) == [(0, "v", 5, "num", ">", 9, None, None), (1, "v", 5, "str", "=", None, None, "A OR B")]


def test_unequal_is_no_boundary(spark):
    kinds = lambda sql: spark.createDataFrame([(sql,)], "s string").select(sqltext.boundary_types(F.col("s")).alias("k")).first().k
    assert kinds("CAST(v.value AS DECIMAL(30, 15)) <> 5") == []
    assert kinds("CAST(v.value AS DECIMAL(30,15)) BETWEEN 1.05AND 2 AND CAST(w.value AS DECIMAL(30,15)) >= 3") == ["range", "greater_equal"]
    assert kinds("v.value > 5") == []


def test_filter_count_examples(spark):
    count = lambda sql: spark.createDataFrame([(sql,)], "s string").select(sqltext.filter_condition_count(F.col("s")).alias("n")).first().n
    joined = "SELECT DISTINCT e.data_id FROM d.entity_table e JOIN d.value_table v ON v.data_id = e.data_id "
    assert count(joined + "WHERE v.property_id = 5 AND CAST(v.value AS DECIMAL(30, 15)) BETWEEN 1 AND 2 ORDER BY e.data_id") == 2
    assert count(joined + "AND v.property_id = 5 AND v.value = 'x'") == 2
    assert count("SELECT AVG(value) FROM d.value_table WHERE property_id = 5") == 1
    assert count("SELECT 1") == 0


def test_match_score_versions(spark):
    sql = "SELECT e.data_id WHERE v.property_id = 5 AND CAST(v.value AS DECIMAL(30, 15)) > 12.50 AND w.value = 'IN718'"
    frame = spark.createDataFrame([(1, sql, "密度大于12.5的IN718"), (2, sql, "什么")], "sample_id long, sql string, natural_language string")
    assert [r.score for r in workload.match_score(frame).orderBy("sample_id").collect()] == [13, 0]


def test_profile_counts_agree_with_direct_counts(spark, tables):
    profile = {(r.kind, r.key): r.n for r in aggregates.profile_counts(tables.eav_value).collect()}
    coverage = {r.property_id: r.entity_count for r in aggregates.property_coverage(tables.eav_property, tables.eav_value).collect()}
    assert {k: n for (kind, k), n in profile.items() if kind == "property"} == {p: n for p, n in coverage.items() if n}


def test_scores(spark):
    samples = spark.createDataFrame([(1, "ids", False), (2, "ids", False), (3, "scalar", False), (4, "scalar", False), (5, "ids", True), (6, "ids", False)],
                                    "sample_id long, kind string, failed boolean")
    gold = spark.createDataFrame([(1, 5.0), (1, 6.0), (2, 5.0), (2, 6.0), (3, 1.0), (4, 1.0), (5, 5.0)], "sample_id long, value double")
    pred = spark.createDataFrame([(1, 6.0), (1, 5.0), (1, 5.0), (2, 5.0), (3, 1.0 + 5e-7), (4, 1.0 + 5e-6), (5, 5.0)], "sample_id long, value double")
    assert [r.ex for r in scoring.execution_accuracy(samples, gold, pred).orderBy("sample_id").collect()] == [1, 0, 1, 0, 0, 1]
    counts = scoring.recall_counts(samples, gold, pred)
    assert scoring.macro_recall(counts).first()[0] == pytest.approx((1 + 0.5 + 1 + 0 + 0) / 5)
    assert scoring.micro_recall(counts).first()[0] == pytest.approx((2 + 1 + 1) / (2 + 2 + 1 + 1 + 1))


@pytest.mark.parametrize("n", [62, 63, 64, 65, 130])
def test_any_number_of_aliases(spark, n):
    values = spark.createDataFrame([(e, p, str(e)) for e in range(4) for p in range(n) if (e, p) != (1, n - 1)], "data_id long, property_id int, value string")
    conditions = [Condition(p, "num", "<=", lo=2) for p in range(n)]
    rows = retrieval._as_predicates(spark, [conditions])
    expected = [0, 2]
    assert sorted(r.data_id for r in retrieval.evaluate_predicates(values, rows).collect()) == expected
    assert sorted(r.data_id for r in retrieval.matching_ids(values, [conditions]).collect()) == expected


def test_query_text_reader(spark):
    texts = [
        (1, "SELECT 1 FROM t WHERE v.property_id = 5 AND (v.value = 'a' OR v.value = 'b (c)') AND w.property_id = 6 AND (w.value > 3 OR CAST(w.value AS DECIMAL(20, 5)) < 1)"),
        (2, "SELECT 1 FROM t WHERE v.property_id IN (5, 6) AND v.value = 'z'"),
        (3, "SELECT 1 FROM t WHERE v.property_id = 3 AND length(v.value) > 3"),
        (4, ""),
    ]
    samples = spark.createDataFrame(texts, "sample_id long, sql string")
    found = {}
    for r in matching.extract_conditions(samples).collect():
        found.setdefault(r.sample_id, set()).add((r.clause, r.alias, r.property_id, r.kind, None if r.lo is None else float(r.lo), r.text))
    first = [("v", 5, "str", None, "a"), ("v", 5, "str", None, "b (c)")]
    second = [("w", 6, "bare", 3.0, None), ("w", 6, "num", 1.0, None)]
    assert {c for c, *_ in found[1]} == {0, 1, 2, 3}
    by_clause = {frozenset(x[1:] for x in found[1] if x[0] == c) for c in range(4)}
    assert by_clause == {frozenset((a, b)) for a in first for b in second}
    assert found[2] == {(0, "v", 5, "str", None, "z"), (0, "v", 6, "str", None, "z")}
    assert set(found) == {1, 2} and {r.sample_id: r.reason for r in matching.unparsed(samples).collect()} == {3: "value_test", 4: "empty"}


def test_in_list_is_one_alias(spark):
    values = spark.createDataFrame([(1, 5, "z"), (2, 6, "z"), (2, 5, "y"), (3, 5, "y"), (3, 6, "y")], "data_id long, property_id int, value string")
    samples = spark.createDataFrame([(1, "SELECT 1 FROM t WHERE v.property_id IN (5, 6) AND v.value = 'z'")], "sample_id long, sql string")
    assert sorted(r.data_id for r in retrieval.evaluate_predicates(values, matching.extract_conditions(samples)).collect()) == [1, 2]


def test_terms_answer_alike_for_any_vocabulary_size(spark):
    texts = spark.createDataFrame([(1, "red apple"), (1, "green apple"), (2, "apple"), (2, "apple")], "k long, text string")
    terms = spark.createDataFrame([("apple",), ("red",), ("pear",)], "term string")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(matching.terms_in_text(texts, terms)) == rows(matching.terms_in_text(texts, terms, max_inline=1))


def test_documents_with_leading_marks_and_fractional_ids(spark):
    docs = spark.createDataFrame([(1, '﻿\n [{"_meta_id": 1.0, "title": "t", "data": {"a": "1"}}]'), (2, '\t\n{"template": {"K": {}}, "data": [{"meta": {"数据ID": 7.0}, "content": {"K": {"a": "1"}}}]}')], "no long, value string")
    assert [r.raw_id for r in json_docs.explode_array_envelope(docs).collect()] == [1]
    assert [r.raw_id for r in json_docs.explode_template_envelope(docs).collect()] == [7]
    good, bad = json_docs.split_corrupt(docs)
    assert (good.count(), bad.count()) == (2, 0)


def test_long_titles_keep_their_roles_and_values_their_length(spark):
    title, text = "t" * 250, "v" * 3000
    docs = spark.createDataFrame([(1, '[{"_meta_id": 5, "title": "%s", "data": {"a": "%s"}}]' % (title, text))], "no long, value string")
    dictionary = spark.createDataFrame([("a", 3)], "field string, property_id int")
    properties = spark.createDataFrame([(3, "a")], "property_id int, property_name string")
    roles = spark.createDataFrame([(title, 3, "object")], "title string, property_id int, role string")
    whole = ingest.load(docs, "no", dictionary, properties, roles)
    assert whole.values.first().value == text and whole.entities.first().object[3] == "1" and whole.entities.first().title == title
    cut = ingest.load(docs, "no", dictionary, properties, roles, value_width=2000, title_width=200)
    assert len(cut.values.first().value) == 2000 and cut.entities.first().title == title[:200] and cut.entities.first().object[3] == "1"


def test_pairs_are_numbered_inside_and_across_documents(spark):
    pairs = [(d, p) for d in (3, 1, 2) for p in range(0, 9000, 7)]
    found = numbering.number_pairs(spark.createDataFrame(pairs, "d long, p long"), "d", "p", "n").collect()
    assert {(r.d, r.p): r.n for r in found} == {pair: i + 1 for i, pair in enumerate(sorted(pairs))}


def test_only_a_whole_zero_is_lifted(spark):
    texts = spark.createDataFrame([("大于0的",), ("大于0.5的",), ("大于05",), ("小于0",)], "t string")
    assert [r[0] for r in texts.select(sqltext.rewrite_zero_phrase(F.col("t"))).collect()] == ["大于0.1的", "大于0.5的", "大于05", "小于0.1"]


def test_verification_reads_every_clause_and_text_tests(spark):
    samples = spark.createDataFrame([(1, "SELECT 1 FROM t WHERE v.property_id = 5 AND (v.value > 8 OR v.value < 2)"), (2, "SELECT 1 FROM t WHERE v.property_id = 6 AND v.value = 'x'"),
                                     (3, "SELECT 1 FROM t WHERE v.property_id = 6 AND f(v.value) = 1")], "sample_id long, sql string")
    values = spark.createDataFrame([(1, 5, "9"), (2, 5, "1"), (3, 5, "5"), (4, 6, "x"), (5, 6, "y")], "data_id long, property_id int, value string")
    stored = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 4), (2, 5), (3, 4)], "sample_id long, data_id long")
    declared = spark.createDataFrame([(1, 3), (2, 9), (3, 1)], "sample_id long, n long")
    found = {(r.sample_id, r.issue, r.n) for r in validation.verify_results(samples, stored, values, declared).collect()}
    assert found == {(1, "value_violation", 1), (2, "value_violation", 1), (3, "unparsed", 1), (2, "count_mismatch", 7)}


def test_ids_beyond_the_bitmap_are_reported(spark):
    values = spark.createDataFrame([(1, 3), (1, 1024), (2, 1024)], "data_id long, property_id int")
    assert [tuple(r) for r in shaping.ids_outside_bitmap(values).collect()] == [(1024, 2)]


def test_percentiles_with_an_outlier(spark):
    rows = [("a", float(i)) for i in range(2001)] + [("a", 1e18)] + [("b", 5.0)] * 10
    found = numbering.exact_percentiles(spark.createDataFrame(rows, "g string, x double"), "x", ["g"], {"p50": 0.5, "p0": 0.0, "p100": 1.0})
    assert {r.g: (r.p50, r.p0, r.p100) for r in found.collect()} == {"a": (1000.5, 0.0, 1e18), "b": (5.0, 5.0, 5.0)}


def test_many_titles_are_numbered_in_order(spark):
    titles = spark.range(20_000).select(F.concat(F.lit("t"), F.format_string("%06d", (F.col("id") * 7919) % 20_000)).alias("title"))
    found = numbering.assign_dataset_id(titles.union(titles)).distinct().collect()
    assert len(found) == 20_000 and all(int(r.dataset_id) == int(r.title[1:]) + 1 for r in found)


def test_boolean_queries_equal_sql(spark):
    """Generated conditions (brackets, NOT, nested queries, entity tests) against DuckDB on the same rows."""
    import duckdb

    rng = random.Random(11)
    values = [(e, p, rng.choice(["a", "b", "ab", "1", "7", "10", "-3"])) for e in range(1, 41) for p in (4, 5, 6) if rng.random() < 0.7]
    entities = [(e, rng.choice(["x", "y"])) for e in range(1, 41)]
    number = "CAST({0}.value AS DECIMAL(30, 15))"

    def test_of(alias):
        return rng.choice([f"{alias}.value = 'a'", f"{alias}.value <> 'b'", f"{alias}.value LIKE '%a%'", f"{alias}.value NOT LIKE 'a%'", f"{alias}.value IN ('a', '7')", f"{alias}.value NOT IN ('1')",
                           f"{number.format(alias)} > 2", f"{number.format(alias)} BETWEEN 1 AND 8", f"{number.format(alias)} NOT BETWEEN 2 AND 8", f"{number.format(alias)} <= -3"])

    def tree(alias, depth):
        kind = rng.choice(["test", "and", "or", "not"]) if depth else "test"
        if kind == "test":
            return test_of(alias)
        if kind == "not":
            return f"NOT ({tree(alias, depth - 1)})"
        return f"({tree(alias, depth - 1)} {kind.upper()} {tree(alias, depth - 1)})"

    def nested(k):
        inner = f"x{k}.property_id = {rng.choice([4, 5, 6])} AND ({tree(f'x{k}', 2)})"
        if rng.random() < 0.5:
            return f"e.data_id {rng.choice(['', 'NOT '])}IN (SELECT x{k}.data_id FROM d.value_table x{k} WHERE {inner})"
        return f"{rng.choice(['', 'NOT '])}EXISTS (SELECT 1 FROM d.value_table x{k} WHERE x{k}.data_id = e.data_id AND {inner})"

    texts = []
    for i in range(60):
        parts = [f"v.property_id = {rng.choice([4, 5])}", tree("v", 3)]
        parts += [rng.choice([nested(i), f"({nested(i)} OR {nested(1000 + i)})", f"NOT ({nested(i)} AND {nested(1000 + i)})"])] if i % 2 else []
        parts += [rng.choice(["e.title = 'x'", "NOT e.title = 'x'", "e.data_id > 20", "e.data_id NOT IN (3, 5, 8)"])] if i % 3 else []
        texts.append((i, "SELECT DISTINCT e.data_id FROM d.entity_table e JOIN d.value_table v ON v.data_id = e.data_id WHERE " + " AND ".join(parts) + " ORDER BY e.data_id"))
    con = duckdb.connect()
    con.sql("CREATE SCHEMA d")
    con.sql("CREATE TABLE d.value_table (data_id BIGINT, property_id INT, value VARCHAR)")
    con.sql("CREATE TABLE d.entity_table (data_id BIGINT, title VARCHAR)")
    con.executemany("INSERT INTO d.value_table VALUES (?, ?, ?)", values)
    con.executemany("INSERT INTO d.entity_table VALUES (?, ?)", entities)
    want = {(i, r[0]) for i, text in texts for r in con.sql(text.replace("CAST(", "TRY_CAST(")).fetchall()}
    samples = spark.createDataFrame(texts, "sample_id long, sql string")
    assert matching.unparsed(samples).collect() == []
    found = retrieval.evaluate_predicates(spark.createDataFrame(values, "data_id long, property_id int, value string"), matching.extract_conditions(samples),
                                          spark.createDataFrame(entities, "data_id long, title string"))
    assert {(r.sample_id, r.data_id) for r in found.collect()} == want and len(want) > 100


def test_foreign_aliases_in_nested_queries_are_not_read(spark):
    texts = [(1, "SELECT e.data_id FROM t e WHERE EXISTS (SELECT 1 FROM t x WHERE x.property_id = 4)"),
             (2, "SELECT e.data_id FROM t e JOIN t v ON v.data_id = e.data_id WHERE v.property_id = 4 AND EXISTS (SELECT 1 FROM t x WHERE x.data_id = e.data_id AND x.property_id = 5 AND v.value = 'a')"),
             (3, "SELECT e.data_id FROM t e WHERE e.data_id IN (SELECT x.data_id FROM t x WHERE x.value = 'a')")]
    samples = spark.createDataFrame(texts, "sample_id long, sql string")
    assert {r.sample_id: r.reason for r in matching.unparsed(samples).collect()} == {1: "nested", 2: "property", 3: "property"}
    assert matching.extract_conditions(samples).collect() == []


def _aggregate_texts(seed: int, n: int):
    """Random aggregate texts over up to two joined value tables, with OR across aliases, NOT, nested queries and entity tests."""
    rnd = random.Random(seed)
    calls = ["COUNT(*)", "COUNT(1)", "COUNT(e.data_id)", "COUNT(DISTINCT e.data_id)", "COUNT(DISTINCT v.value)", "COUNT(v.value)", "AVG(CAST(v.value AS DECIMAL(30, 15)))",
             "SUM(DISTINCT CAST(v.value AS DECIMAL(30, 15)))", "SUM(CAST(v.value AS DECIMAL(30, 15)))", "MAX(CAST(v.value AS DECIMAL(30, 15)))", "MIN(v.value)", "MAX(e.data_id)"]
    for k in range(n):
        number = lambda a: f"CAST({a}.value AS DECIMAL(30, 15)) {rnd.choice(['>', '<=', '='])} {rnd.randint(0, 6)}"
        two = rnd.random() < 0.6
        group = lambda: f"({number('v')} {rnd.choice(['OR', 'AND'])} {'NOT ' if rnd.random() < 0.4 else ''}{number('v2' if two else 'v')})"
        parts = [f"v.property_id = {rnd.randint(1, 2)}", group()]
        if two:
            parts += ["v2.property_id IN (2, 3)", group()]
        if rnd.random() < 0.3:
            parts.append(f"e.data_id {rnd.choice(['', 'NOT '])}IN (SELECT x.data_id FROM eav.value_table x WHERE x.property_id = 3 AND {number('x')})")
        if rnd.random() < 0.3:
            parts.append("(e.title = 'a' OR " + number("v") + ")")
        joins = "JOIN eav.value_table v ON v.data_id = e.data_id" + (" JOIN eav.value_table v2 ON v2.data_id = e.data_id" if two else "")
        yield k, f"SELECT {', '.join(rnd.sample(calls, 3))} FROM eav.entity_table e {joins} WHERE {' AND '.join(parts)}"


def _aggregate_store(spark, rows, titles):
    values = spark.createDataFrame(rows, "data_id bigint, property_id int, value string")
    return values, spark.createDataFrame(titles, "data_id bigint, title string")


@pytest.mark.parametrize("max_predicates", [50_000, 0])
def test_aggregate_texts_equal_their_joins(spark, max_predicates):
    import duckdb

    rnd = random.Random(5)
    rows = [(rnd.randint(1, 12), rnd.randint(1, 3), rnd.choice("0123456")) for _ in range(90)]  # several values of a property, repeated rows
    titles = [(i, "ab"[i % 2]) for i in range(1, 12)]  # entity 12 is not in the entity table
    con = duckdb.connect()
    con.sql("CREATE SCHEMA eav; CREATE TABLE eav.value_table(data_id BIGINT, property_id INT, value VARCHAR); CREATE TABLE eav.entity_table(data_id BIGINT, title VARCHAR)")
    con.executemany("INSERT INTO eav.value_table VALUES (?, ?, ?)", rows)
    con.executemany("INSERT INTO eav.entity_table VALUES (?, ?)", titles)
    texts = list(_aggregate_texts(17, 60 if max_predicates else 12))
    samples = spark.createDataFrame(texts, "sample_id bigint, sql string")
    values, entities = _aggregate_store(spark, rows, titles)
    assert workload.unread_aggregates(samples).count() == 0
    calls = samples.select("sample_id", F.explode(sqltext.aggregate_calls(F.col("sql"))).alias("c")).select("sample_id", "c.*")
    found = aggregate_queries.evaluate_aggregates(values, calls, matching.extract_conditions(samples), entities, max_predicates=max_predicates).collect()
    ours = {(r.sample_id, r.call): r.value if r.text is None else r.text for r in found}
    assert len(found) == 3 * len(texts)
    for k, text in texts:
        for i, x in enumerate(con.sql(text).fetchall()[0]):
            want = x if x is None or isinstance(x, str) else pytest.approx(float(x))
            assert ours[k, i] == want, (text, i)


def test_aggregate_texts_that_are_not_read(spark):
    base = "FROM eav.entity_table e JOIN eav.value_table v ON v.data_id = e.data_id"
    texts = {1: (f"SELECT COUNT(*) {base} WHERE v.property_id = 1 GROUP BY v.value", "group_by"), 2: (f"SELECT AVG(v.value + 1) {base} WHERE v.property_id = 1", "call"),
             3: (f"SELECT COUNT(*) {base} JOIN eav.value_table v2 ON v2.data_id = e.data_id WHERE v.property_id = 1", "free_alias"), 4: ("SELECT COUNT(*) FROM eav.entity_table e", "no_condition"),
             5: (f"SELECT COUNT(*) {base} JOIN eav.value_table v2 ON v2.data_id = e.data_id WHERE v.property_id = 1 OR v2.property_id = 2", "free_alias"),
             6: (f"SELECT MAX(w.value) {base} WHERE v.property_id = 1", "alias"), 7: (f"SELECT COUNT(*) {base} WHERE v.property_id = 1 AND v.value = 'x'", None),
             8: (f"SELECT COUNT(*), COUNT(DISTINCT *) {base} WHERE v.property_id = 1", "call"), 9: (f"SELECT SUM(v.value) {base} WHERE v.property_id = 9", None)}
    samples = spark.createDataFrame([(k, t) for k, (t, _) in texts.items()], "sample_id bigint, sql string")
    assert {r.sample_id: r.reason for r in workload.unread_aggregates(samples).collect()} == {k: r for k, (_, r) in texts.items() if r}
    values, entities = _aggregate_store(spark, [(1, 1, "x"), (1, 1, "x"), (2, 1, None), (None, 1, "x")], [(1, "a"), (2, None)])
    found = {(r.sample_id, r.call): r.value for r in workload.evaluate_aggregate_texts(samples, values, entities=entities).collect()}
    assert found == {(7, 0): 2.0, (9, 0): None}
    assert workload.evaluate_aggregate_texts(samples.limit(0), values.limit(0), entities=entities).count() == 0


def test_one_entity_with_many_rows_is_summed_before_it_meets_others(spark):
    values = spark.range(3000).select(F.lit(7).cast("bigint").alias("data_id"), (F.col("id") % 2 + 1).cast("int").alias("property_id"), (F.col("id") % 10).cast("string").alias("value"))
    text = "SELECT COUNT(*), COUNT(DISTINCT v2.data_id), SUM(CAST(v.value AS DECIMAL(30, 15))) FROM eav.value_table v JOIN eav.value_table v2 ON v2.data_id = v.data_id WHERE v.property_id = 1 AND v2.property_id = 2"
    found = workload.evaluate_aggregate_texts(spark.createDataFrame([(1, text)], "sample_id bigint, sql string"), values)
    assert [r.value for r in found.orderBy("call").collect()] == [1500.0 * 1500, 1.0, 1500.0 * 1500 * 4]


def test_numbering_keeps_null_keys_and_groups(spark):
    rows = [(None, None, 1), (None, 5, 2), ("a", None, 3), ("a", 9000, 4), ("a", 2, 5), (None, None, 6), ("b", None, 7)]
    frame = spark.createDataFrame(rows, "g string, k long, i long")
    numbered = {r.i: r.n for r in numbering.dense_number(frame, "k", "n", order_within=["i"]).collect()}
    assert numbered == {1: 1, 3: 2, 6: 3, 7: 4, 5: 5, 2: 6, 4: 7}
    grouped = {r.i: r.n for r in numbering.dense_number(frame, "k", "n", order_within=["i"], partition_by=["g"]).collect()}
    assert grouped == {1: 1, 6: 2, 2: 3, 3: 1, 5: 2, 4: 3, 7: 1}
    shares = {r.i: r.cdf for r in numbering.cdf_rows(frame, "k", "i").collect()}
    assert shares == pytest.approx({1: 1 / 7, 3: 2 / 7, 6: 3 / 7, 7: 4 / 7, 5: 5 / 7, 2: 6 / 7, 4: 1.0})
    values = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0), ("a", None)], "g string, x double")
    assert {r.g: r.p50 for r in numbering.exact_percentiles(values, "x", ["g"], {"p50": 0.5}).collect()} == {None: 2.0, "a": 5.0}
    assert {r.g: (r.n, r.median_ms) for r in aggregates.runtime_summary(values, "x", ["g"]).collect()} == {None: (2, 2.0), "a": (1, 5.0)}


def test_null_keys_find_the_same_terms_inline_and_by_seed(spark):
    texts = spark.createDataFrame([(None, "red blue"), (1, "blue"), (None, "red blue"), (2, None)], "sample_id long, text string")
    terms = spark.createDataFrame([("red",), ("blue",)], "term string")
    found = lambda n: sorted((r.sample_id or 0, r.term) for r in matching.terms_in_text(texts, terms, "text", "sample_id", n).collect())
    assert found(2000) == found(0) == [(0, "blue"), (0, "blue"), (0, "red"), (0, "red"), (1, "blue")]


def _interval_predicates(n):
    """Tests of all numeric kinds on one property, several on some aliases, and a few on another."""
    rows = []
    for i in range(n):
        lo, hi = Decimal(i * 7 % n), Decimal(i * 7 % n + i % 5)
        kind, op = [("between", None), ("num", ">"), ("num", "<="), ("bare", ">="), ("bare_between", None), ("num", "="), ("num", "!="), ("bare", "<"), ("str", "=")][i % 9]
        rows.append((i, 0, "v", 5, kind, op, lo, hi, str(lo)))
        if i % 4 == 0:
            rows.append((i, 0, "v", 5, "num", "<", hi + 3, None, None))
        if i % 6 == 0:
            rows.append((i, 0, "w", 6, "num", ">", Decimal(i % 3), None, None))
    return rows


PREDICATES = "sample_id bigint, clause int, alias string, property_id int, kind string, op string, lo decimal(30,15), hi decimal(30,15), text string"


def test_stabbing_index_answers_like_plain_tests(spark, monkeypatch):
    values = [(d, 5, t) for d, t in enumerate([None, "", "abc", "-3", "0", "1", "1.5", "2", "17", "17.000", " 40", "40x", "99", "150", "1e2", "299.5", "1000", "9" * 40])] + [(d, 6, str(d)) for d in range(18)]
    rows = spark.createDataFrame(values, "data_id long, property_id int, value string")
    asked = spark.createDataFrame(_interval_predicates(300), PREDICATES)
    pairs = lambda **k: sorted((r.sample_id, r.data_id) for r in retrieval.evaluate_predicates(rows, asked, **k).collect())
    expected = pairs(plain=10**6)
    assert len(expected) > 500
    assert pairs() == expected and pairs(max_predicates=0) == expected
    monkeypatch.setattr(stabbing, "TREE_ENDS", 7)  # several ends in a cell
    assert pairs() == expected


def test_candidates_grow_with_hits(spark):
    n = 10_000
    rows = spark.range(2_000).select(F.col("id").alias("data_id"), F.lit(5).alias("property_id"), (F.col("id") * 5 + 0.25).cast("string").alias("value"))
    for width in (0.5, 20):
        asked = spark.range(n).select(F.col("id").alias("sample_id"), F.lit(0).alias("clause"), F.lit("v").alias("alias"), F.lit(5).alias("property_id"), F.lit("between").alias("kind"), F.lit(None).cast("string").alias("op"),
                                      F.col("id").cast("decimal(30,15)").alias("lo"), (F.col("id") + width).cast("decimal(30,15)").alias("hi"), F.lit(None).cast("string").alias("text"))
        groups = retrieval.predicate_groups(asked)
        trees = stabbing.plant(groups)
        assert len(trees) == 1 and len(trees[0].ends) <= stabbing.TREE_ENDS
        met = stabbing.candidates(rows, groups, trees)
        hits = retrieval.evaluate_predicates(rows, asked).count()
        assert hits == sum(1 for d in range(2_000) for i in range(max(0, d * 5 - 21), min(n, d * 5 + 1)) if i <= d * 5 + 0.25 <= i + width)
        # beyond the hits a value meets the intervals that begin or end in its cell: 20,000 ends in 4,096 cells
        assert hits <= met.count() <= hits + 2_000 * 10
        assert met.select("sample_id", "data_id").distinct().count() == met.count()


TRICKY = [
    '{"a": "{x", "b": {"c": 1}, "l": [{"p": 1}]}', '{"a": "\\u007bx}", "b": {"c": "\\u005b1]"}}', "{'a': '{x}', 'b': {'c': 2}}",
    '{"l": [{"p": 1}, 5, null, {"q": {"r": 2, "s": [1]}}, "{t}"], "n": [{"p": null, "q": 1.50}, {}]}', '{"l": [{"p": 1}, [2], {"p": 3}]}',
    '{"o": {"x": 1, "x": 2, "y": {"z": 1}}, "k": 1, "k": 2, "o": {"lb": null, "ub": 3}}', '{"l": [{"元素": " Co ", "含量": {"v": 1}}, {"元素": "", "含量": 2}, {"相名称": "γ", "u": 1}]}',
    '{}', 'not json', '[1]', None, '{"META_x": "{", "化学结构式": {"a": 1}, "e": "say \\"{\\"", "f": 1e3}',
]


def test_leaves_read_by_text_equal_leaves_read_by_kind(spark):
    frame = spark.createDataFrame(list(enumerate(TRICKY)), "id long, data string")
    for rules in (leaves.LeafRules(), leaves.LeafRules(pivots=False, prefix_nested=True, renames={})):
        read = frame.select("data", F.expr(leaves.record_leaves("data", rules)).alias("fast"))
        sure, leaves._sure = leaves._sure, lambda json: "false"
        try:
            read = read.withColumn("slow", F.expr(leaves.record_leaves("data", rules)))
        finally:
            leaves._sure = sure
        assert [r.data for r in read.collect() if r.fast != r.slow] == []


def test_records_settle_their_repeated_fields_without_a_shuffle(spark):
    wide = json.dumps({f"f{i}": i for i in range(3000)})[:-1] + ', "f7": "late", "f7": "later"}'
    rows = [(1, '{"a": 1, "b": 2, "a": 3}'), (2, wide), (3, '{"a": 1, "b": 2}'), (3, '{"c": 0, "d": 1, "b": 5}'), (None, '{"a": 1}'), (None, '{"a": 1, "x": 9, "a": 4}'), (4, "{}")]
    frame = spark.createDataFrame(rows, "id long, data string")
    found = leaves.extract_leaves(frame, ["id"])
    raw = leaves.unpack_leaves(frame.select("id", F.expr(leaves.record_leaves("data", leaves.LeafRules())).alias("leaves")))
    as_set = lambda df: {(r.id, r.field, r.leaf_pos, r.value) for r in df.select("id", "field", "leaf_pos", "value").collect()}
    expected = as_set(leaves.last_write_wins(raw, ["id"]))
    assert as_set(found) == expected and found.count() == len(expected)
    unique = leaves.extract_leaves(frame.filter("id IN (1, 2, 4)"), ["id"])
    assert "Exchange" not in unique._jdf.queryExecution().executedPlan().toString()


def test_load_keeps_records_whose_orders_repeat(spark):
    doc = lambda i, f: json.dumps([{"_meta_id": i, "title": "t", "data": {"META_数据生产者": "p", **f}}])
    rows = [(1, doc(5, {"f": 1, "g": "x"})), (1, doc(5, {"g": "y", "f": 2})), (2, doc(5, {"f": 3})), (3, doc(6, {"f": {"lb": 1}}))]
    docs = spark.createDataFrame(rows, "no long, value string")
    dictionary = spark.createDataFrame([("f", 1), ("g", 2000), ("f_lb", 3)], "field string, property_id int")
    properties = spark.createDataFrame([(1, "eff")], "property_id int, property_name string")
    roles = spark.createDataFrame([("t", 1, "object")], "title string, property_id int, role string")
    loaded = ingest.load(docs, "no", dictionary, properties, roles)
    values = {(r.data_id, r.property_id): (r.property_name, r.value) for r in loaded.values.collect()}
    assert values == {(50000005, 1): ("eff", "2"), (50000005, 2000): ("2000", "x"), (50000006, 3): ("3", "1"), (50000007, 1): ("eff", "3")}
    bits = {r.data_id: (r.object.count("1"), r.result.count("1"), len(r.object), r.data_producers) for r in loaded.entities.collect()}
    assert bits == {50000005: (1, 0, 1024, "p"), 50000006: (0, 1, 1024, "p"), 50000007: (1, 0, 1024, "p")}

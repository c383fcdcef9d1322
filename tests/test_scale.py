"""Work and memory of single tasks, however few files the rows come from."""

import re

import pytest
from pyspark.sql import functions as F

from sparsile.operators import retrieval
from sparsile.session import fresh_path
from sparsile.sources import eav_store
from test_plans import plan_of

PREDICATE = "sample_id bigint, clause int, alias string, property_id int, kind string, op string, lo decimal(30,15), hi decimal(30,15), text string"


def num(sample, alias, prop, op, lo, clause=0):
    from decimal import Decimal

    return (sample, clause, alias, prop, "num", op, Decimal(lo), None, None)


def test_pairs_of_one_file_are_made_over_all_tasks(spark):
    values = spark.range(3000).select((F.col("id") % 1000).alias("data_id"), (F.col("id") % 3).cast("int").alias("property_id"), F.col("id").cast("string").alias("value")).coalesce(1)
    predicates = spark.createDataFrame([num(s, a, p, ">", 100 * s) for s in range(20) for a, p in (("v", 1), ("w", 2))], PREDICATE)
    found = retrieval.evaluate_predicates(values, predicates)
    plan = plan_of(found)
    moved, paired = plan.index("Exchange hashpartitioning(data_id"), plan.index("BroadcastHashJoin [property_id#")
    assert paired < moved and "Exchange hashpartitioning(sample_id" not in plan  # printed from the last step to the first
    want = {(s, d) for s in range(20) for d in range(1000) if any(x % 1000 == d and x % 3 == 1 and x > 100 * s for x in range(3000)) and any(x % 1000 == d and x % 3 == 2 and x > 100 * s for x in range(3000))}
    assert {tuple(r) for r in found.collect()} == want


def test_store_cuts_a_property_that_comes_from_one_task(spark):
    hot = spark.range(40000).select(F.col("id").alias("data_id"), F.when(F.col("id") < 39000, 1).otherwise(2).alias("property_id"), F.lit("p").alias("property_name"), F.col("id").cast("string").alias("value"))
    path = fresh_path(spark, "hot")
    eav_store.overwrite_eav(hot.coalesce(1), path)
    back = spark.read.parquet(path)
    per_file = back.filter("property_id = 1").groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0]
    assert per_file < 39000 / 8 and back.count() == 40000


def test_intervals_of_many_queries_meet_no_single_rows(spark, monkeypatch):
    """Sums of each interval against a plain loop; what stays to be paired are tests that open no interval."""
    from decimal import Decimal

    from sparsile.operators import aggregate_queries as Q

    paired, join = [], Q.join_control
    monkeypatch.setattr(Q, "join_control", lambda facts, control, *a, **k: paired.append(control) or join(facts, control, *a, **k))
    texts = [None, "", "x", "5", "5.0", "7", "-1", "12", "12", "3.5", "9", "0"]
    rows = [(i, 1, x) for i, x in enumerate(texts)] + [(50, 1, "8"), (50, 2, "4"), (None, 1, "6")]
    values = spark.createDataFrame(rows, "data_id bigint, property_id int, value string")
    tests = [(op, Decimal(b)) for op in (">", ">=", "<", "<=", "=", "!=") for b in ("-2", "-1", "3.5", "5", "8.5", "12", "13")]
    predicates = spark.createDataFrame([num(s, "v", 1, op, lo) for s, (op, lo) in enumerate(tests)] + [num(90, "v", 1, ">", 3), num(90, "v", 1, "<=", 9), num(91, "v", 1, "<", 0), num(91, "v", 1, ">=", 12, 1)], PREDICATE)
    calls = spark.createDataFrame([(s, c, fn, "v", True, False, "value") for s in [*range(len(tests)), 90, 91] for c, fn in enumerate(("count", "sum", "max", "min"))],
                                  "sample_id bigint, call int, fn string, alias string, as_number boolean, distinct boolean, of string")
    found = {}
    for r in Q.evaluate_aggregates(values, calls, predicates).collect():
        found[r["sample_id"], r["fn"]] = r["value"]
    holds = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "=": lambda a, b: a == b, "!=": lambda a, b: a != b}
    numbers = [Decimal(x) for i, p, x in rows if p == 1 and i is not None and x not in (None, "", "x")]
    wanted = {s: [x for x in numbers if holds[op](x, lo)] for s, (op, lo) in enumerate(tests)} | {90: [x for x in numbers if 3 < x <= 9], 91: [x for x in numbers if x < 0 or x >= 12]}
    for s, xs in wanted.items():
        assert [found[s, f] for f in ("count", "sum", "max", "min")] == [float(len(xs)), *([float(f(xs)) for f in (sum, max, min)] if xs else [None] * 3)], s
    assert [c.count() for c in paired] == [7 + 1]  # the tests with != and the one with two clauses


def test_scores_read_each_text_once_and_over_all_tasks(spark):
    from sparsile.plans import workload

    samples = spark.createDataFrame([(1, "SELECT 1 WHERE CAST(v.value AS DECIMAL(30, 15)) > 5", "大于5"), (2, None, None), (3, "", "")], "sample_id bigint, sql string, natural_language string").coalesce(1)
    scored = workload.match_score(samples)
    plan = plan_of(scored)
    assert plan.count("$1.#filled") == 1 and "RoundRobin" in plan
    assert {r["sample_id"]: r["score"] for r in scored.collect()}[1] == 8
    assert "regexp_extract_all" not in plan_of(workload.curate_samples(samples))


def test_call_over_joined_aliases_moves_rows_before_pairs(spark, tables):
    from sparsile.catalog.workloads import CALL_FORMS
    from sparsile.plans import workload

    plan = plan_of(workload.evaluate_aggregate_texts(tables.sql(CALL_FORMS), tables.eav_value, entities=tables.eav_entity))
    assert not re.search(r"hashpartitioning\(sample_id#\d+L, data_id#\d+L, alias#\d+, anti#", plan)


def test_seeds_hold_newlines_and_characters_beyond_the_plane(spark):
    from sparsile.operators import matching

    texts = spark.createDataFrame([(1, "a\nbcd \U0001F600x"), (2, ""), (3, None), (4, "ab")], "k bigint, text string").coalesce(1)
    terms = spark.createDataFrame([("\U0001F600x",), ("a\nbcd",), ("ab",), ("x",)], "term string")
    found = {tuple(r) for r in matching.terms_in_text(texts, terms, max_inline=0).select("k", "term").collect()}
    assert found == {(1, "\U0001F600x"), (1, "a\nbcd"), (1, "x"), (4, "ab")}


def test_rows_of_joined_aliases_are_tested_once_for_all_samples(spark, tables, monkeypatch):
    """Value rows meet one row per property, not one per sample and alias; what is worked out per sample are patterns of entities."""
    from sparsile.catalog.workloads import CALL_FORMS
    from sparsile.operators import aggregate_queries as Q
    from sparsile.plans import workload

    sizes, join = {}, Q.join_control
    monkeypatch.setattr(Q, "join_control", lambda facts, control, *a, **k: sizes.update({frozenset(facts.columns): (facts.count(), control.count())}) or join(facts, control, *a, **k))
    # many entities of few kinds: equal but for their number, so patterns do not grow with them
    values = spark.range(4000).selectExpr("id AS data_id", "explode(map(23, CAST(id % 7 * 1500 AS STRING), 22, CAST(id % 5 AS STRING), 24, IF(id % 2 = 0, 'BUILDING', 'x'))) AS (property_id, value)")
    found = workload.evaluate_aggregate_texts(tables.sql(CALL_FORMS), values, entities=spark.range(4000).withColumnRenamed("id", "data_id"))
    ours = {(r["sample_id"], r["call"]): r["value"] if r["text"] is None else r["text"] for r in found.collect()}
    assert len(ours) == 25 * 7 and [control for names, (_, control) in sizes.items() if "value" in names and control] == [3]
    assert [n for names, (n, _) in sizes.items() if "_g" in names] and all(n <= 25 * 70 for names, (n, _) in sizes.items() if "_g" in names)
    for n in range(25):
        rows = [(i, i % 7 * 1500, w) for i in range(4000) if i % 5 != n for w in (str(i % 5), "BUILDING" if i % 2 == 0 else "x") if i % 7 * 1500 > 4000 + 200 * n or w == "BUILDING"]
        ids, numbers, texts = {r[0] for r in rows}, {r[1] for r in rows}, {r[2] for r in rows}
        assert [ours[n, c] for c in range(7)] == [len(rows), len(rows), len(ids), len(texts), sum(r[1] for r in rows), round(sum(numbers) / len(numbers), 4) if numbers else None, min(texts)], n


@pytest.mark.parametrize("together", [3, 100])
def test_batches_of_samples_and_words_of_tests_equal_their_joins(spark, monkeypatch, together):
    """More tests of a property, and more DISTINCT calls, than a word has bits, in one batch and in several."""
    import random

    import duckdb

    from sparsile.functions import sqltext
    from sparsile.operators import aggregate_queries as Q
    from sparsile.operators import matching
    from test_operators import _aggregate_store, _aggregate_texts

    monkeypatch.setattr(Q, "TOGETHER", together)
    rnd = random.Random(3)
    rows = [(rnd.randint(1, 30), rnd.randint(1, 3), rnd.choice(["0", "1", "2", "3", "4", "5", "5.0", "6", None])) for _ in range(220)]
    titles = [(i, "ab"[i % 2]) for i in range(1, 30)]
    values, entities = _aggregate_store(spark, rows, titles)
    pairs = " OR ".join(f"(v.value = '{k}' AND CAST(w.value AS DECIMAL(30, 15)) > {k / 10})" for k in range(40))
    two = "FROM eav.entity_table e JOIN eav.value_table v ON v.data_id = e.data_id JOIN eav.value_table w ON w.data_id = e.data_id"
    texts = [(100, f"SELECT COUNT(*), SUM(CAST(w.value AS DECIMAL(30, 15))), COUNT(DISTINCT v.value), SUM(e.data_id), MAX(v.value) {two} WHERE v.property_id = 1 AND w.property_id = 1 AND ({pairs})")]
    texts += [(200 + k, f"SELECT COUNT(DISTINCT v.value), AVG(DISTINCT CAST(v.value AS DECIMAL(30, 15))), COUNT(DISTINCT w.value) {two} WHERE v.property_id = 1 AND w.property_id IN (2, 3) AND CAST(w.value AS DECIMAL(30, 15)) > {k / 10}") for k in range(40 if together > 3 else 4)]
    texts += list(_aggregate_texts(29, 12))
    con = duckdb.connect()
    con.sql("CREATE SCHEMA eav; CREATE TABLE eav.value_table(data_id BIGINT, property_id INT, value VARCHAR); CREATE TABLE eav.entity_table(data_id BIGINT, title VARCHAR)")
    con.executemany("INSERT INTO eav.value_table VALUES (?, ?, ?)", rows)
    con.executemany("INSERT INTO eav.entity_table VALUES (?, ?)", titles)
    samples = spark.createDataFrame(texts, "sample_id bigint, sql string")
    calls = samples.select("sample_id", F.explode(sqltext.aggregate_calls(F.col("sql"))).alias("c")).select("sample_id", "c.*")
    wide = [row for k in range(40) for row in ((100, k, "v", 1, "str", "=", None, None, str(k)), num(100, "w", 1, ">", f"{k / 10}", k))]
    predicates = matching.extract_conditions(samples.filter("sample_id <> 100")).unionByName(spark.createDataFrame(wide, PREDICATE).withColumn("anti", F.lit(False)))
    found = Q.evaluate_aggregates(values, calls, predicates, entities)
    ours = {(r["sample_id"], r["call"]): r["value"] if r["text"] is None else r["text"] for r in found.collect()}
    for k, text in texts:
        for i, x in enumerate(con.sql(text).fetchall()[0]):
            assert ours[k, i] == (x if x is None or isinstance(x, str) else pytest.approx(float(x))), (text, i)

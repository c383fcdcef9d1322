"""Physical plans: what must and what must not appear."""

import os
import re

from conftest import FOLDER

import __spark_entry__  # noqa: F401  (registration)
from sparsile.catalog.registry import QUERIES
from sparsile.operators import retrieval
from sparsile.operators.retrieval import Condition
from sparsile.session import fresh_path
from sparsile.sources import eav_store


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_cross_products_and_no_python_stages(spark):
    bad = re.compile(r"CartesianProduct|BroadcastNestedLoopJoin|ArrowEvalPython|BatchEvalPython|MapInPandas|FlatMapGroups")
    found = {n: bad.search(plan_of(q(spark, FOLDER))) for n, q in QUERIES.items()}
    assert {n: m.group(0) for n, m in found.items() if m} == {}


def test_property_filters_prune_the_store(spark, tables):
    path = fresh_path(spark, "pruned")
    eav_store.overwrite_eav(tables.eav_value, path)
    values = spark.read.parquet(path)
    plans = {
        "one": retrieval.matching_ids(values, [[Condition(4, "between", lo=10, hi=20)]]),
        "many": retrieval.matching_ids(values, [[Condition(4, "between", lo=10, hi=20), Condition(5, "num", ">", lo=905)]]),
        "aggregate": retrieval.eav_agg(values, 23, "avg"),
        "workload": retrieval.evaluate_predicates(values, tables.predicates),
    }
    for name, frame in plans.items():
        filters = re.search(r"PartitionFilters: \[([^\]]*)", plan_of(frame)).group(1)
        assert "property_id" in filters, (name, filters)


def test_scratch_is_removed_on_demand(spark):
    from sparsile.session import clear_scratch, durable, scratch_folder

    durable(spark.range(3))
    assert os.listdir(scratch_folder(spark).removeprefix("file:"))
    clear_scratch(spark)
    assert not os.path.exists(scratch_folder(spark).removeprefix("file:"))


def test_many_conditions_shuffle_once(spark, tables):
    conditions = [Condition(4, "between", lo=10, hi=20), Condition(5, "num", ">", lo=920), Condition(2, "like", text="Brand%")]
    plan = plan_of(retrieval.matching_ids(tables.eav_value, [conditions]))
    assert plan.count("Exchange hashpartitioning") == 1


def test_workload_moves_no_values_before_filtering(spark, tables):
    plan = plan_of(retrieval.evaluate_predicates(tables.eav_value, tables.predicates))
    assert "BroadcastHashJoin [property_id" in plan and "SortMergeJoin" not in plan

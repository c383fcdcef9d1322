"""Attribute retrieval over the value table: one condition, many, whole workloads."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparsile.functions.numeric import any_part, compare, condition_holds, non_empty, to_decimal
from sparsile.functions.sqltext import ENTITY_ID, TITLE
from sparsile.operators import stabbing
from sparsile.session import durable
from sparsile.sizing import BROADCAST_ROWS, join_control, local_copy, spread

# Conditions are noted as bits of 64-bit words; this many fit into one.
WORD_BITS = 62
# Up to this many tested properties are named in a filter of the value rows.
LISTED = 1_000


@dataclass(frozen=True)
class Condition:
    """One test on one property.  Conditions of one alias hold on the same value row."""

    property_id: int
    kind: str = "num"
    op: str | None = None
    lo: str | float | None = None
    hi: str | float | None = None
    text: str | None = None


def _number(x) -> Column:
    return F.lit(None if x is None else Decimal(str(x))).cast("decimal(30,15)")


def test(value: Column, c: Condition, mode: str = "strict", bare_mode: str = "mysql") -> Column:
    """The value test of one literal condition."""
    return condition_holds(value, c.kind, c.op, _number(c.lo), _number(c.hi), F.lit(c.text), mode, bare_mode)


def has_property(values: DataFrame, property_id: int) -> DataFrame:
    return values.filter(F.col("property_id") == property_id)


def property_in(values: DataFrame, property_ids: list[int]) -> DataFrame:
    return values.filter(F.col("property_id").isin(property_ids))


def matching_values(values: DataFrame, c: Condition, mode: str = "strict", bare_mode: str = "mysql") -> DataFrame:
    return values.filter((F.col("property_id") == c.property_id) & test(F.col("value"), c, mode, bare_mode))


def any_value(values: DataFrame, property_id: int, op: str, x, mode: str = "prefix") -> DataFrame:
    """Numeric comparison against every part of merged ``a|b`` values."""
    passes = any_part(F.col("value"), lambda p: F.coalesce(compare(to_decimal(p, mode), op, _number(x)), F.lit(False)))
    return values.filter((F.col("property_id") == property_id) & passes)


def matching_ids(values: DataFrame, clauses: list[list[Condition]], mode: str = "strict") -> DataFrame:
    """Ids that satisfy every condition of at least one clause (each condition an
    existence test over the entity's rows, as in a self-join per alias).

    One pass: rows are filtered to those that satisfy anything, each becomes a bit
    mask of satisfied conditions, masks are or-ed per entity (map-side first).  More conditions
    than fit into one mask are evaluated as a table of predicates.
    """
    flat = list(dict.fromkeys(c for clause in clauses for c in clause))
    if len(flat) == 1:
        return matching_values(values, flat[0], mode).select("data_id").distinct()
    if len(flat) > WORD_BITS:
        return evaluate_predicates(values, _as_predicates(values.sparkSession, clauses), mode=mode).select("data_id")
    bits = {c: 1 << i for i, c in enumerate(flat)}
    tests = {c: (F.col("property_id") == c.property_id) & test(F.col("value"), c, mode) for c in flat}
    wanted = F.col("property_id").isin(sorted({c.property_id for c in flat}))
    mask = reduce(lambda a, b: a + b, [F.when(tests[c], F.lit(bits[c]).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for c in flat])
    hits = values.filter(wanted).select("data_id", mask.alias("_mask")).filter("_mask != 0")
    seen = hits.groupBy("data_id").agg(F.bit_or("_mask").alias("_mask"))
    full = [sum(bits[c] for c in set(clause)) for clause in clauses]
    passes = reduce(lambda a, b: a | b, [F.col("_mask").bitwiseAND(F.lit(m).cast("bigint")) == m for m in full])
    return seen.filter(passes).select("data_id")


def _as_predicates(spark: SparkSession, clauses: list[list[Condition]]) -> DataFrame:
    """Literal conditions as predicate rows of one sample, an alias for each."""
    decimal = lambda x: None if x is None else Decimal(str(x))
    rows = [(1, k, f"v{i}", c.property_id, c.kind, c.op, decimal(c.lo), decimal(c.hi), c.text) for k, clause in enumerate(clauses) for i, c in enumerate(dict.fromkeys(clause))]
    return spark.createDataFrame(rows, "sample_id bigint, clause int, alias string, property_id int, kind string, op string, lo decimal(30,15), hi decimal(30,15), text string")


def retrieve(entities: DataFrame, values: DataFrame, conditions: list[Condition], mode: str = "strict") -> DataFrame:
    """Sorted ids of entities that satisfy all conditions."""
    return retrieve_any(entities, values, [conditions], mode)


def retrieve_any(entities: DataFrame, values: DataFrame, clauses: list[list[Condition]], mode: str = "strict") -> DataFrame:
    return sort_ids(matching_ids(values, clauses, mode).join(entities.select("data_id"), "data_id", "left_semi"))


def sort_ids(ids: DataFrame) -> DataFrame:
    return ids.orderBy("data_id")


def join_entity_value(entities: DataFrame, values: DataFrame) -> DataFrame:
    return entities.join(values, "data_id")


# ---- whole workloads -------------------------------------------------------

def predicate_groups(predicates: DataFrame) -> DataFrame:
    """One row per (sample, clause, alias, property): its conditions, the alias's word and bit, and the number of
    aliases of the clause that must exist.  An alias that may take several properties (an IN list) has a row for each, under one bit;
    an anti alias, which must not exist, counts no bit.  A control table, bounded by the workload."""
    struct = F.struct("kind", "op", "lo", "hi", "text")
    marked = predicates if "anti" in predicates.columns else predicates.withColumn("anti", F.lit(False))
    groups = marked.groupBy("sample_id", "clause", "alias", "property_id", F.col("anti").alias("_anti")).agg(F.collect_list(struct).alias("conditions"))
    ordinal = F.dense_rank().over(W.partitionBy("sample_id", "clause", "_anti").orderBy("alias")) - 1
    ranked = groups.withColumn("_ord", ordinal)
    last = F.max(F.when(~F.col("_anti"), F.col("_ord"))).over(W.partitionBy("sample_id", "clause"))
    return ranked.select("sample_id", "clause", "property_id", "conditions", "_anti", F.floor(F.col("_ord") / WORD_BITS).cast("int").alias("_word"),
                         F.expr(f"shiftleft(1L, CAST(_ord % {WORD_BITS} AS INT))").alias("_bit"), (last + 1).alias("_size"))


def with_entity_rows(values: DataFrame, groups: DataFrame, entities: DataFrame | None) -> DataFrame:
    """The value rows, with an entity's title and id as values of the properties that stand for them where ``groups`` tests those."""
    rows = values.select("data_id", "property_id", "value")
    tested = {r[0] for r in groups.filter("property_id < 0").select("property_id").distinct().collect()}  # two rows at most
    if not tested:
        return rows
    if entities is None:
        raise ValueError("tests of entities need the entity table")
    for number, value in ((TITLE, "title"), (ENTITY_ID, "data_id")):
        if number in tested:
            rows = rows.unionByName(entities.select("data_id", F.lit(number).alias("property_id"), F.col(value).cast("string").alias("value")).distinct())
    return rows


def tested_rows(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows whose property is tested; all rows where more than ``LISTED`` properties are."""
    listed = [r[0] for r in groups.select("property_id").distinct().limit(LISTED + 1).collect()]
    return rows.filter(F.col("property_id").isin(listed)) if len(listed) <= LISTED else rows


def evaluate_predicates(values: DataFrame, predicates: DataFrame, entities: DataFrame | None = None,
                        mode: str = "strict", bare_mode: str = "mysql", max_predicates: int = BROADCAST_ROWS, plain: int = stabbing.PLAIN) -> DataFrame:
    """All queries of a workload in one job: distinct (sample_id, data_id).

    Value rows meet the predicates of their property (where it has more than ``plain`` bounded ones: those
    whose interval the value stabs), failing pairs are dropped at once, and the only wide shuffle is by entity: with few predicates the tested
    rows move before they are paired, otherwise passing pairs do; their groups hold a few words of bits.  A clause may have any number of aliases; one
    that must not exist (``anti``) rules an entity out as soon as a value passes its tests.
    """
    groups = predicate_groups(predicates)
    small = local_copy(groups, max_predicates)
    groups = durable(groups, "predicates") if small is None else small
    last_word, n_groups = groups.agg(F.max("_word"), F.count(F.lit(1))).first()
    n_words = 1 + (last_word or 0)
    # numeric views are read inside the test, so text that only meets text tests is never parsed
    value = F.col("value")
    rows = with_entity_rows(values, groups, entities)
    if small is not None:  # pairs are many more than rows: an entity's rows meet in one task before they are paired, and its pairs stay there
        rows = spread(tested_rows(rows, groups), "data_id")
    trees = stabbing.plant(groups, plain) if n_groups > plain else []
    paired = stabbing.candidates(rows, groups, trees, mode, bare_mode, max_predicates) if trees else join_control(rows, groups, "property_id", spread="data_id", max_rows=max_predicates)
    met = paired.filter(F.forall(
        "conditions", lambda c: condition_holds(value, c["kind"], c["op"], c["lo"], c["hi"], c["text"], mode, bare_mode)))
    words = [F.bit_or(F.when((F.col("_word") == w) & ~F.col("_anti"), F.col("_bit")).otherwise(F.lit(0).cast("bigint"))).alias(f"_m{w}") for w in range(n_words)]
    held = reduce(lambda a, b: a + b, [F.bit_count(f"_m{w}") for w in range(n_words)])
    full = met.groupBy("sample_id", "clause", "data_id").agg(*words, F.first("_size").alias("_size"), F.max("_anti").alias("_out")).filter((held == F.col("_size")) & ~F.col("_out"))
    hits = full.select("sample_id", "data_id").distinct()
    return hits if entities is None else hits.join(entities.select("data_id"), "data_id", "left_semi").select("sample_id", "data_id")


def result_sizes(samples: DataFrame, results: DataFrame) -> DataFrame:
    """Rows per sample; samples without a hit stay, with 0."""
    counts = results.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_result"))
    return samples.select("sample_id").join(counts, "sample_id", "left").select(
        "sample_id", F.coalesce("n_result", F.lit(0)).cast("bigint").alias("n_result"))


def run_queries(spark: SparkSession, queries: list[tuple[int, str]], on_error: str = "keep") -> DataFrame:
    """Free SQL texts against registered views: (sample_id, value, error).

    For a bounded list of texts; the loop only builds plans.  An unanalysable
    text is reported as an error row (``keep``), leaves no row (``empty``) or
    raises.  Large workloads belong in :func:`evaluate_predicates`.
    """
    parts = []
    for sample_id, text in queries:
        try:
            frame = spark.sql(text)
            first = frame.columns[0]
            parts.append(frame.select(F.lit(sample_id).cast("bigint").alias("sample_id"), F.col(f"`{first}`").cast("string").alias("value"),
                                      F.lit(None).cast("string").alias("error")))
        except Exception as exc:  # analysis errors only; nothing has run yet
            if on_error == "raise":
                raise
            if on_error == "keep":
                condition = getattr(exc, "getCondition", lambda: None)() or type(exc).__name__
                parts.append(spark.range(1).select(F.lit(sample_id).cast("bigint").alias("sample_id"), F.lit(None).cast("string").alias("value"),
                                                   F.lit(condition).alias("error")))
    if not parts:
        return spark.createDataFrame([], "sample_id bigint, value string, error string")
    return reduce(DataFrame.unionAll, parts)


# ---- aggregate queries -----------------------------------------------------

AGGREGATES = {"avg": F.avg, "max": F.max, "min": F.min, "sum": F.sum, "count": F.count}


def eav_agg(values: DataFrame, property_id: int, fn: str, conditions: list[Condition] | None = None,
            mode: str = "strict") -> DataFrame:
    """Scalar aggregate of one property's numbers, optionally only over entities
    that satisfy further conditions."""
    rows = has_property(values, property_id).filter(non_empty(F.col("value")))
    if conditions:
        rows = rows.join(matching_ids(values, [conditions], mode), "data_id", "left_semi")
    number = to_decimal(F.col("value"), mode)
    return rows.agg(AGGREGATES[fn](number).cast("double").alias("value"))


def eav_agg_all(values: DataFrame, property_ids: list[int], mode: str = "strict") -> DataFrame:
    """All five aggregates of several properties in one pass."""
    number = to_decimal(F.col("value"), mode)
    rows = property_in(values, property_ids).filter(non_empty(F.col("value"))).select("property_id", number.alias("n"))
    return rows.groupBy("property_id").agg(*[f("n").cast("double").alias(k) for k, f in AGGREGATES.items()])

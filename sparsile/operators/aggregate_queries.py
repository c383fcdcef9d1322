"""Aggregate queries of a workload, with the row multiplicities that their joins have."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparsile.functions import sqltext
from sparsile.functions.numeric import condition_holds, to_decimal
from sparsile.operators.numbering import ranged_total
from sparsile.operators.retrieval import WORD_BITS, tested_rows, with_entity_rows
from sparsile.session import durable
from sparsile.sizing import BROADCAST_ROWS, join_control, local_copy, spread, tasks

_PLAIN = "NOT rlike({}, '[#@]')"
# Samples over joined aliases that are answered together: a value row is tested and written down once for all of them.
TOGETHER = 32


def aggregate_reasons(samples: DataFrame, sql: str = "sql", key: str = "sample_id") -> DataFrame:
    """(key, calls, reason) of aggregate query texts; ``reason`` says why a text cannot be answered in full, or is null.

    Besides what :func:`sqltext.read_queries` does not read: groups (``group_by``), a call of another form (``call``), a text
    without conditions (``no_condition``), a table that some clause does not test, so that any row of it counts (``free_alias``), a call on an
    alias without tests (``alias``), more clauses than a mask has bits (``too_many_clauses``)."""
    read = sqltext.read_queries(samples, sql, key)
    texts = samples.select(key, F.col(sql).alias("_sql"), sqltext.aggregate_calls(F.col(sql)).alias("calls"), sqltext.call_count(F.col(sql)).alias("_asked"))
    names = "transform(filter(c, k -> abs(k) < {0} AND {1}), k -> atoms[abs(k) - 1].name)".format(sqltext._ANTI, _PLAIN.format("atoms[abs(k) - 1].name"))
    full = texts.join(read, key).withColumn("_names", F.expr(f"transform(clauses, c -> array_sort(array_distinct({names})))"))
    tables = "regexp_count(_sql, '" + r"(?i)(?:\\b(?:FROM|JOIN)|,)\\s+[\\w.]*value_table\\b" + "')"
    named = "size(array_distinct(transform(filter(atoms, a -> a.name NOT LIKE '#%'), a -> a.name)))"
    reason = f"""CASE WHEN reason IS NOT NULL THEN reason WHEN rlike(_sql, '(?i)\\\\bGROUP\\\\s+BY\\\\b') THEN 'group_by' WHEN _asked = 0 OR _asked <> size(calls) THEN 'call'
        WHEN size(clauses) = 0 OR exists(clauses, c -> NOT exists(c, k -> atoms[abs(k) % {sqltext._ANTI} - 1].kind <> 'join')) THEN 'no_condition'
        WHEN size(clauses) > {WORD_BITS} THEN 'too_many_clauses' WHEN {tables} <> {named} OR exists(_names, n -> n <> _names[0]) THEN 'free_alias'
        WHEN exists(calls, c -> c.of = 'value' AND NOT array_contains(_names[0], c.alias)) THEN 'alias' END"""
    return full.select(key, "calls", F.expr(reason).alias("reason"))


def _control(asked: DataFrame, calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What value rows are tested against, and what is known of each sample: both bounded by the workload."""
    nth = F.dense_rank().over(W.partitionBy("sample_id").orderBy("clause")) - 1
    bit = F.when(F.col("_nth") < WORD_BITS, F.expr("shiftleft(1L, _nth)")).otherwise(F.raise_error("more clauses than a mask has bits").cast("bigint"))
    tests = asked.withColumn("_nth", nth).withColumn("_bit", bit)
    parts = tests.groupBy("sample_id", "alias", "anti", "property_id", "_bit").agg(F.collect_list(F.struct("kind", "op", "lo", "hi", "text")).alias("tests"))
    parts = parts.groupBy("sample_id", "alias", "anti", "property_id").agg(F.collect_list(F.struct(F.col("_bit").alias("bit"), "tests")).alias("clauses"))
    flags = calls.filter("of = 'value'").groupBy("sample_id", "alias").agg(
        F.max("as_number").alias("_number"), F.max(~F.col("as_number") & F.col("fn").isin("avg", "sum")).alias("_bare"),
        F.max(F.col("_set") | ~F.col("as_number") & F.col("fn").isin("max", "min")).alias("_valued"))
    parts = parts.join(flags, ["sample_id", "alias"], "left").fillna(False, ["_number", "_bare", "_valued"])
    role = F.when(F.col("anti"), "anti").when(F.rlike("alias", F.lit("[#@]")), "exists").otherwise("row")
    names = tests.groupBy("sample_id", "alias", role.alias("_role")).agg(F.bit_or("_bit").alias("bits"))
    info = names.groupBy("sample_id").agg(F.bit_or("bits").alias("_all"), F.max(F.col("_role") == "anti").alias("_anti"), F.collect_list(F.when(F.col("_role") == "row", F.col("alias"))).alias("_plain"),
                                          F.collect_list(F.when(F.col("_role") == "exists", F.struct("alias", "bits"))).alias("_exists"))
    # one alias and nothing else: each of its rows is a row of the query, so its sums need no entities
    solo = (F.size("_plain") == 1) & (F.size("_exists") == 0) & ~F.col("_anti")
    parts = parts.join(info.select("sample_id", solo.alias("_solo")), "sample_id")
    return parts, info


def _weighted(patterns: DataFrame) -> DataFrame:
    """One row per (sample, pattern of entities, call, class of its rows): how many joined rows each of them stands in.

    Clauses are bits, so a joined row counts where the masks of its parts share one: the masks of the other aliases are
    multiplied out, equal ones united after each, and a row of the called alias meets those that share a bit with it."""
    held = "aggregate(filter(_g, r -> r.alias = x.alias), 0L, (b, r) -> b | r.mask)"
    may = f"aggregate(_exists, _all, (a, x) -> a & ((_all & ~x.bits) | {held})) & ~aggregate(filter(_g, r -> r.anti), 0L, (b, r) -> b | r.mask)"
    product = "flatten(transform(cur, c -> transform(filter(_g, r -> r.alias = p), r -> named_struct('m', c.m & r.mask, 'n', c.n * r.n))))"
    united = "transform(filter(array_distinct(transform(y, z -> z.m)), m -> m <> 0), m -> named_struct('m', m, 'n', aggregate(filter(y, z -> z.m = m), 0L, (s, z) -> s + z.n)))"
    combos = f"aggregate(filter(_plain, p -> _call.of <> 'value' OR p <> _call.alias), array(named_struct('m', _may, 'n', 1L)), (cur, p) -> get(transform(array({product}), y -> {united}), 0))"
    share = "aggregate(filter(_combos, c -> (c.m & r.mask) <> 0), 0L, (s, c) -> s + c.n)"
    total = "aggregate(filter(_combos, c -> c.m <> 0), 0L, (s, c) -> s + c.n)"
    counted = f"""CASE WHEN _call.of = 'value' THEN transform(filter(_g, r -> NOT r.anti AND r.alias = _call.alias), r -> named_struct('r', r, 'w', {share}))
        ELSE array(named_struct('r', get(filter(_g, r -> false), 0), 'w', {total})) END"""
    rows = patterns.withColumn("_may", F.expr(may)).withColumn("_call", F.explode("_calls")).withColumn("_combos", F.expr(combos))
    known = rows.withColumn("_e", F.expr("transform(slice(_g, 1, 1), r -> named_struct('ne', r.ne, 'si', r.si, 'hi', r.hi, 'li', r.li))[0]"))  # each class knows all entities of its pattern
    return known.select("sample_id", "_pattern", "_e", "_call", F.explode(F.expr(counted)).alias("_part")).select("sample_id", "_pattern", "_e", "_call.*", "_part.*").filter("w > 0")


def evaluate_aggregates(values: DataFrame, calls: DataFrame, predicates: DataFrame, entities: DataFrame | None = None, mode: str = "strict", bare_mode: str = "mysql",
                        max_predicates: int = BROADCAST_ROWS) -> DataFrame:
    """All aggregate queries of a workload in one job: (sample_id, call, fn, value, text).

    ``calls`` is (sample_id, call, fn, alias, as_number, distinct, of): ``of`` is ``value`` (of the alias), ``entity`` (its id) or ``row``
    (``COUNT(*)``); ``predicates`` are the conditions of the same samples.  A call sees the rows of the query's join: one for each choice of a row per
    alias that passes some clause (OR) whole; nested queries only have to exist, ``anti`` ones must not.  Rows of one entity are
    counted by the tests they pass before they meet, so an entity with very many rows stays small, and entities with equal counts are joined once (:func:`_joined`).  DISTINCT unites equal values of a sample, or entities.
    COUNT counts any value that is not null; a called value that is not cast is compared as text by MAX and MIN (``text``)
    and read as a number by AVG and SUM.  No rows: COUNT 0, others null.  Rows without an id never count; with ``entities``, only theirs do."""
    collected = F.col("distinct") & (F.col("of") == "value") & F.col("fn").isin("count", "sum", "avg")
    calls = durable(calls.withColumn("_set", collected), "calls")
    marked = predicates if "anti" in predicates.columns else predicates.withColumn("anti", F.lit(False))
    asked = durable(marked.join(calls.select("sample_id").distinct(), "sample_id", "left_semi"), "asked")
    parts, info = _control(asked, calls)
    value = F.col("value")
    passes = lambda t: condition_holds(value, t["kind"], t["op"], t["lo"], t["hi"], t["text"], mode, bare_mode)
    stored = with_entity_rows(values, asked, entities)
    tested = stored.join(asked.select("property_id").distinct(), "property_id", "left_semi")
    if entities is not None:
        tested = tested.join(entities.select("data_id"), "data_id", "left_semi")
    sums = [F.count(F.lit(1)).alias("n"), F.count("value").alias("c"), F.sum("_x").alias("sx"), F.count("_x").alias("cx"), F.max("_x").alias("hx"), F.min("_x").alias("lx"),
            F.sum("_y").alias("sy"), F.count("_y").alias("cy"), F.max("value").alias("ht"), F.min("value").alias("lt")]
    # DISTINCT needs entities and values; every other call of a query over one alias is a sum over its rows
    apart = ~F.col("distinct") | F.col("fn").isin("max", "min")
    solo = parts.filter("_solo").select("sample_id").distinct()
    direct, joined = calls.filter(apart).join(solo, "sample_id", "left_semi"), calls.join(solo.join(calls.filter(apart), "sample_id").select("sample_id", "call"), ["sample_id", "call"], "left_anti")
    direct, joined = durable(direct, "direct"), durable(joined, "joined")
    numbered = tested.filter("data_id IS NOT NULL").withColumn("_x", to_decimal(value, mode)).withColumn("_y", to_decimal(value, bare_mode))
    found = _direct(_totals(numbered, sums, parts.join(direct.select("sample_id"), "sample_id", "left_semi"), passes, max_predicates, mode), direct)
    if not joined.isEmpty():
        found = found.unionByName(_joined(stored, entities, joined, parts.join(joined.select("sample_id"), "sample_id", "left_semi"), info, max_predicates, mode, bare_mode), allowMissingColumns=True)
    textual = ~F.col("as_number") & (F.col("of") == "value") & F.col("fn").isin("max", "min")
    numeric = (F.when(F.col("fn") == "count", F.coalesce(F.col("_count").cast("double"), F.lit(0.0))).when(textual, None).when(F.col("fn") == "avg", F.try_divide("_sum", F.col("_of")).cast("double"))
               .when(F.col("fn") == "sum", F.when(F.col("_of") > 0, F.col("_sum").cast("double"))).when(F.col("fn") == "max", F.col("_max").cast("double")).otherwise(F.col("_min").cast("double")))
    return calls.join(found, ["sample_id", "call"], "left").select("sample_id", "call", "fn", numeric.alias("value"), F.when(textual, F.when(F.col("fn") == "max", F.col("_max_text")).otherwise(F.col("_min_text"))).alias("text"))


# how sums of parts become sums of the whole
_MERGED = {"n": F.sum, "c": F.sum, "sx": F.sum, "cx": F.sum, "hx": F.max, "lx": F.min, "sy": F.sum, "cy": F.sum, "ht": F.max, "lt": F.min, "si": F.sum, "hi": F.max, "li": F.min}


def _merge(*names: str) -> list:
    return [f(name).alias(name) for name, f in _MERGED.items() if not names or name in names]


def _totals(rows: DataFrame, sums: list, parts: DataFrame, passes, max_predicates: int, mode: str) -> DataFrame:
    """Sums of the rows that pass some clause of each sample's only alias.

    Equal tests of one property are answered once, whatever the number of samples.  Tests that leave an interval of numbers
    open never meet single rows: see :func:`_interval_sums`.  Others meet each row of their property."""
    id_key = F.col("data_id").cast("decimal(38,15)")
    sums = [*sums, F.sum(id_key).alias("si"), F.max(id_key).alias("hi"), F.min(id_key).alias("li")]
    tests = F.sort_array(F.transform("clauses", lambda c: F.sort_array(c["tests"])))
    named = parts.select("sample_id", "property_id", tests.alias("tests")).withColumn("_key", F.to_json(F.struct("property_id", "tests")))
    named = durable(named, "named")
    bounded = _bounds(named.groupBy("_key").agg(F.first("property_id").alias("property_id"), F.first("tests").alias("tests")), mode)
    bounded = durable(bounded, "bounded")
    others = bounded.filter("NOT _interval").select("_key", "property_id", "tests")
    met = join_control(rows, others, "property_id", spread="data_id", max_rows=max_predicates).filter(F.exists("tests", lambda clause: F.forall(clause, passes)))
    found = met.groupBy("_key").agg(*sums)
    intervals = bounded.filter("_interval").select("_key", "property_id", "_low", "_high")
    if not intervals.isEmpty():
        found = found.unionByName(_interval_sums(rows.filter("_x IS NOT NULL"), sums, intervals))
    return named.join(found, "_key").groupBy("sample_id").agg(*_merge())


def _bounds(tests: DataFrame, mode: str) -> DataFrame:
    """``tests`` with ``_interval``: one clause that a number passes exactly when it lies above ``_low`` (at, open) and below
    ``_high`` (at, closed); null where unbounded.  Tests that any number passes in this view may stand beside."""
    passed = "'any', 'not_null'" + ("" if mode == "mysql" else ", 'non_empty'")
    number = "(c.kind = 'between' AND c.lo IS NOT NULL AND c.hi IS NOT NULL OR c.kind = 'num' AND c.lo IS NOT NULL AND c.op IN ('>', '>=', '<', '<=', '='))"
    interval = f"size(tests) = 1 AND forall(tests[0], c -> c.kind IN ({passed}) OR coalesce({number}, false)) AND exists(tests[0], c -> c.kind IN ('num', 'between'))"
    low = "array_max(transform(filter(tests[0], c -> c.kind = 'between' OR c.kind = 'num' AND c.op IN ('>', '>=', '=')), c -> named_struct('at', c.lo, 'open', c.kind = 'num' AND c.op = '>')))"
    high = "array_min(transform(filter(tests[0], c -> c.kind = 'between' OR c.kind = 'num' AND c.op IN ('<', '<=', '=')), c -> named_struct('at', IF(c.kind = 'between', c.hi, c.lo), 'closed', c.kind = 'between' OR c.op <> '<')))"
    return tests.withColumn("_interval", F.expr(f"coalesce({interval}, false)")).withColumn("_low", F.expr(f"CASE WHEN _interval THEN {low} END")).withColumn("_high", F.expr(f"CASE WHEN _interval THEN {high} END"))


def _interval_sums(rows: DataFrame, sums: list, intervals: DataFrame) -> DataFrame:
    """Sums of the rows whose number ``_x`` lies in each interval of its property, exactly, without pairs of rows and intervals.

    The ends of the intervals cut a property's numbers into cells: the i-th end is cell 2i - 1, what lies between it and the next is
    cell 2i.  Rows are summed by cell, cells by the nodes of a binary tree, and an interval is the sum of the few nodes that tile it."""
    at = ["property_id", "_x"]
    per_number = rows.groupBy(*at).agg(*sums)
    ends = intervals.select("property_id", F.explode(F.array("_low.at", "_high.at")).alias("_x")).filter("_x IS NOT NULL").distinct().withColumn("_e", F.lit(1).cast("bigint"))
    tested = per_number.join(intervals.select("property_id").distinct(), "property_id", "left_semi")
    both = tested.join(ends, at, "full_outer").withColumn("_e", F.coalesce("_e", F.lit(0).cast("bigint")))
    placed = durable(ranged_total(both, "_x", "_upto", "_e", ["property_id"]), "placed")
    levels = int(2 * placed.agg(F.max("_upto")).first()[0] + 1).bit_length()
    cells = placed.filter("n IS NOT NULL").groupBy("property_id", (2 * F.col("_upto") - F.col("_e")).alias("_cell")).agg(*_merge())
    above = cells.withColumn("_h", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    nodes = above.groupBy("property_id", "_h", F.expr("shiftright(_cell, _h)").alias("_p")).agg(*_merge())
    numbers = lambda name: placed.filter("_e = 1").select("property_id", F.col("_x").alias(f"_{name}_at"), F.col("_upto").alias(f"_{name}_n"))
    known = intervals.select("_key", "property_id", F.col("_low.at").alias("_low_at"), F.col("_low.open").alias("_open"), F.col("_high.at").alias("_high_at"), F.col("_high.closed").alias("_closed"))
    known = known.join(numbers("low"), ["property_id", "_low_at"], "left").join(numbers("high"), ["property_id", "_high_at"], "left")
    ranges = known.select("_key", "property_id", F.expr("coalesce(2 * _low_n - IF(_open, 0, 1), 0L)").alias("_from"), F.expr(f"coalesce(2 * _high_n - IF(_closed, 1, 2), {(1 << levels) - 1}L)").alias("_to"))
    low, high = "shiftright(_from + shiftleft(1L, h) - 1, h)", "shiftright(_to + 1, h)"
    tile = lambda on, place: f"CASE WHEN {low} < {high} AND {on} % 2 = 1 THEN array(named_struct('_h', h, '_p', {place})) ELSE array() END"
    tiles = ranges.filter("_from <= _to").select("_key", "property_id", F.expr(f"explode(flatten(transform(sequence(0, {levels}), h -> concat({tile(low, low)}, {tile(high, high + ' - 1')}))))").alias("_tile"))
    return tiles.select("_key", "property_id", "_tile.*").join(nodes, ["property_id", "_h", "_p"]).groupBy("_key").agg(*_merge())


def _direct(totals: DataFrame, calls: DataFrame) -> DataFrame:
    """Calls of queries over one alias, from the sums of its rows."""
    of_id, number = F.col("of") == "entity", F.col("as_number")
    pick = lambda i, x, y: F.when(of_id, F.col(i)).when(number, F.col(x)).otherwise(F.col(y))
    return calls.join(totals, "sample_id").select("sample_id", "call", F.when(F.col("of") == "value", F.col("c")).otherwise(F.col("n")).alias("_count"), pick("si", "sx", "sy").alias("_sum"),
                                                  pick("n", "cx", "cy").alias("_of"), F.when(of_id, F.col("hi")).otherwise(F.col("hx")).alias("_max"), F.when(of_id, F.col("li")).otherwise(F.col("lx")).alias("_min"),
                                                  F.col("ht").alias("_max_text"), F.col("lt").alias("_min_text"))


def _units(parts: DataFrame, batches: int) -> DataFrame:
    """What a clause asks of a row of an alias, numbered as bits of words within (batch of samples, property): equal tests have one number."""
    tests = F.array_sort(F.array_distinct(F.filter("c.tests", lambda t: t["kind"] != "any")))
    each = parts.withColumn("_batch", _batch(batches)).withColumn("c", F.explode("clauses")).withColumn("tests", tests).withColumn("bit", F.col("c.bit"))
    kinds = lambda *names: F.exists("tests", lambda t: t["kind"].isin(*names))
    number = F.dense_rank().over(W.partitionBy("_batch", "property_id").orderBy("tests")) - 1
    return each.select("_batch", "sample_id", "alias", "anti", "property_id", "bit", "tests", F.floor(number / WORD_BITS).cast("int").alias("_word"),
                       number.alias("_k"), (F.col("_number") | kinds("num", "between", "not_between")).alias("_number"),
                       (F.col("_bare") | kinds("bare", "bare_between", "not_bare_between")).alias("_bare"), "_valued").withColumn(
        "_unit", F.expr(f"shiftleft(1L, CAST(_k % {WORD_BITS} AS INT))")).drop("_k")


def _batch(batches: int):
    """The batch of a sample."""
    return F.pmod(F.xxhash64("sample_id"), F.lit(batches)).cast("int")


def _patterns(stored: DataFrame, entities: DataFrame | None, units: DataFrame, max_predicates: int, mode: str, bare_mode: str) -> DataFrame:
    """Value rows summed by (batch, pattern, property, class, value): no row is written down once per sample.

    A row's class says which tests of its property it passes; an entity's pattern, how many rows of each class it has.  Entities
    of one pattern give the same joined rows in every sample of the batch.  The value is a key only where a call needs it."""
    flags = ["_number", "_bare", "_valued"]
    known = units.groupBy("_batch", "property_id", "_word", "_unit").agg(F.first("tests").alias("tests"), *[F.max(f).alias(f) for f in flags])
    words = known.groupBy("_batch", "property_id", "_word").agg(F.collect_list(F.struct("_unit", "tests")).alias("_tests"), *[F.max(f).alias(f) for f in flags])
    control = words.groupBy("_batch", "property_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_word", "_tests"))), lambda w: w["_tests"]).alias("_words"), *[F.max(f).alias(f) for f in flags])
    small = local_copy(control, max_predicates)
    rows = tested_rows(stored.filter("data_id IS NOT NULL"), control if small is None else small)
    if entities is not None:
        rows = rows.join(entities.select("data_id"), "data_id", "left_semi")
    if small is not None:  # an entity's rows meet in one task before they are tested, and stay there
        # one more than the join above has: the same partitioning again would be left out of the plan, and few large tasks would test and sort all rows
        control, rows = small, rows.repartition(tasks(rows.sparkSession) + 1, "data_id")
    value, nothing = F.col("value"), F.lit(0).cast("bigint")
    met = join_control(rows, control, "property_id", spread="data_id", max_rows=max_predicates)
    read = met.withColumn("_x", F.when(F.col("_number"), to_decimal(value, mode))).withColumn("_y", F.when(F.col("_bare"), to_decimal(value, bare_mode)))
    passes = lambda t: condition_holds(value, t["kind"], t["op"], t["lo"], t["hi"], t["text"], mode, bare_mode, (F.col("_x"), F.col("_y")))
    passed = F.transform("_words", lambda w: F.aggregate(w, nothing, lambda m, t: m.bitwiseOR(F.when(F.forall(t["tests"], passes), t["_unit"]).otherwise(nothing))))
    # exploded, so that the tests are made once: a filter would be pushed down and repeat them
    classed = read.withColumn("_class", F.explode(F.filter(F.array(passed), lambda c: F.exists(c, lambda m: m != 0)))).withColumn("_v", F.when(F.col("_valued"), value))
    if small is None:
        classed = spread(classed.drop("_words"), "data_id")
    at = ["data_id", "_batch", "property_id", "_class"]
    summed = classed.groupBy(*at, "_v").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("c"), F.sum("_x").alias("sx"), F.count("_x").alias("cx"), F.max("_x").alias("hx"), F.min("_x").alias("lx"),
                                            F.sum("_y").alias("sy"), F.count("_y").alias("cy"))
    of_class = W.partitionBy(*at).orderBy("property_id")
    counted = summed.withColumn("_first", F.row_number().over(of_class) == 1).withColumn("n", F.sum("n").over(of_class.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    item = F.concat(F.array(F.col("property_id").cast("bigint")), "_class", F.array("n"))
    patterned = counted.withColumn("_item", item).withColumn("_pattern", F.sort_array(F.collect_set("_item").over(W.partitionBy("data_id", "_batch"))))
    key = F.col("data_id").cast("decimal(38,15)")
    return patterned.groupBy("_batch", "_pattern", "property_id", "_class", "n", "_v").agg(
        *_merge("c", "sx", "cx", "hx", "lx", "sy", "cy"), F.count_if("_first").alias("ne"), F.sum(F.when(F.col("_first"), key)).alias("si"), F.max(key).alias("hi"), F.min(key).alias("li"))


def _joined(stored: DataFrame, entities: DataFrame | None, calls: DataFrame, parts: DataFrame, info: DataFrame, max_predicates: int, mode: str, bare_mode: str) -> DataFrame:
    """Calls of queries over several aliases, and those over distinct entities or values.

    Samples are taken in batches.  Rows and entities are reduced to few classes and patterns of them, and the joins of each sample are
    worked out for patterns, not for entities: at most as many as there are entities, usually a small part."""
    batches = -(-calls.select("sample_id").distinct().count() // TOGETHER)
    units = durable(_units(parts, batches), "units")
    summed = durable(_patterns(stored, entities, units, max_predicates, mode, bare_mode), "patterns")
    at = ["_batch", "property_id", "_class"]
    items = durable(summed.groupBy(*at, "_pattern", "n").agg(*_merge("c", "sx", "cx", "hx", "lx", "sy", "cy", "si", "hi", "li"), F.sum("ne").alias("ne"), F.max("_v").alias("ht"), F.min("_v").alias("lt")), "items")
    passed = join_control(items.select(*at).distinct(), units, ["_batch", "property_id"], spread="_class", max_rows=max_predicates).filter("(get(_class, _word) & _unit) <> 0")
    masks = passed.groupBy(*at, "sample_id", "alias", "anti").agg(F.bit_or("bit").alias("mask"))
    met = join_control(items, masks, at, spread="_pattern", max_rows=max_predicates)
    per_pattern = met.groupBy("sample_id", "_pattern").agg(F.collect_list(F.struct(*[c for c in met.columns if c not in ("_batch", "_pattern", "sample_id")])).alias("_g"))
    asked = calls.groupBy("sample_id").agg(F.collect_list(F.struct("call", "fn", "alias", "as_number", "of", "_set", (F.col("distinct") & (F.col("of") == "entity")).alias("once"))).alias("_calls"))
    weighted = _weighted(join_control(per_pattern, info.join(asked, "sample_id"), "sample_id", spread="_pattern", max_rows=max_predicates))
    collects = not calls.filter("_set").isEmpty()
    if collects:
        weighted = durable(weighted, "weighted")
    number, of_id, of_value = F.col("as_number"), F.col("of") == "entity", F.col("of") == "value"
    rows = weighted.filter("NOT _set").withColumn("w", F.when(F.col("once"), F.lit(1).cast("bigint")).otherwise(F.col("w")))
    # a sum that counts once keeps all its digits
    times = lambda s: F.when(F.col("w") == 1, s).otherwise((s * F.col("w")).cast("decimal(38,15)"))
    found = rows.groupBy("sample_id", "call").agg(
        F.sum(F.when(of_value, F.col("r.c")).otherwise(F.col("_e.ne")) * F.col("w")).alias("_count"),
        F.sum(times(F.when(of_id, F.col("_e.si")).when(number, F.col("r.sx")).otherwise(F.col("r.sy")))).alias("_sum"),
        F.sum(F.when(of_id, F.col("_e.ne")).when(number, F.col("r.cx")).otherwise(F.col("r.cy")) * F.col("w")).alias("_of"),
        F.max(F.when(of_id, F.col("_e.hi")).otherwise(F.col("r.hx"))).alias("_max"), F.min(F.when(of_id, F.col("_e.li")).otherwise(F.col("r.lx"))).alias("_min"), F.max("r.ht").alias("_max_text"), F.min("r.lt").alias("_min_text"))
    if not collects:
        return found
    return found.unionByName(_distinct_values(summed, weighted, calls.withColumn("_batch", _batch(batches)), mode, bare_mode), allowMissingColumns=True)


def _distinct_values(summed: DataFrame, weighted: DataFrame, calls: DataFrame, mode: str, bare_mode: str) -> DataFrame:
    """Calls over distinct values: values whose pattern and class count, each once per call.

    Calls are bits of words: a value notes the calls that count it, values with equal notes are summed before the calls are told apart."""
    kind = F.when((F.col("fn") == "count") & ~F.col("as_number"), "text").when(F.col("as_number"), "number").otherwise("bare")
    numbered = calls.filter("_set").select("_batch", kind.alias("_kind"), "sample_id", "call").distinct().withColumn("_k", F.dense_rank().over(W.partitionBy("_batch", "_kind").orderBy("sample_id", "call")) - 1)
    asked = numbered.withColumn("_word", F.floor(F.col("_k") / WORD_BITS).cast("int")).withColumn("_bit", F.expr(f"shiftleft(1L, CAST(_k % {WORD_BITS} AS INT))")).drop("_k")
    at = ["_batch", "_pattern", "property_id", "_class"]
    counted = weighted.filter("_set").select("sample_id", "call", "_pattern", "r.property_id", "r._class").join(asked, ["sample_id", "call"]).groupBy(*at, "_kind", "_word").agg(F.bit_or("_bit").alias("_bits"))
    values = summed.filter("_v IS NOT NULL").select(*at, "_v").join(counted, at)
    number = F.when(F.col("_kind") == "number", to_decimal(F.col("_v"), mode)).when(F.col("_kind") == "bare", to_decimal(F.col("_v"), bare_mode))
    each = values.select("_batch", "_kind", "_word", "_bits", F.when(F.col("_kind") == "text", F.col("_v")).alias("_t"), number.alias("_x")).filter("_t IS NOT NULL OR _x IS NOT NULL")
    noted = each.groupBy("_batch", "_kind", "_word", "_t", "_x").agg(F.bit_or("_bits").alias("_bits"))
    alike = noted.groupBy("_batch", "_kind", "_word", "_bits").agg(F.count(F.lit(1)).alias("n"), F.sum("_x").alias("sx"), F.count("_x").alias("cx"))
    return alike.join(asked, ["_batch", "_kind", "_word"]).filter("(_bits & _bit) <> 0").groupBy("sample_id", "call").agg(
        F.sum("n").alias("_count"), F.sum("sx").cast("decimal(38,15)").alias("_sum"), F.sum("cx").alias("_of"))

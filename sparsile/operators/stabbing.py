"""Predicates found by value: a stabbing index over the intervals that numeric tests leave open.

A property with many numeric predicates would let each of its values meet each of them.  Here the ends of their intervals
cut the number line into cells, a binary tree stands over the cells, and an interval is written under the few nodes that
tile it.  A value looks up its cell by binary search and carries the nodes above it, so it meets the predicates whose
interval holds it, and those that end inside its cell.  These are candidates: the whole test is made afterwards, so
rounding of ends, open bounds and cells of several ends never change an answer.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparsile.functions.numeric import to_decimal
from sparsile.session import durable
from sparsile.sizing import BROADCAST_ROWS, join_control, local_copy

# A property is indexed beyond this many bounded predicates; fewer are simply tested one by one.
PLAIN = 64
# Bounds of what the plan carries: trees, ends of one tree, ends of all.  Beyond them cells hold several ends, and the least tested properties are not indexed.
TREES, TREE_ENDS, ALL_ENDS = 256, 4_096, 65_536
_VIEWS = {"num": ("num", "between"), "bare": ("bare", "bare_between")}


@dataclass(frozen=True)
class Tree:
    """The cells of one property in one numeric view."""

    number: int
    property_id: int
    view: str
    ends: tuple[float, ...]

    @property
    def levels(self) -> int:
        return len(self.ends).bit_length()

    def cell_sql(self, x: str) -> str:
        """How many ends are at most ``x``; null for null."""
        listed = f"CAST(split('{','.join(map(repr, self.ends))}', ',') AS ARRAY<DOUBLE>)"
        return (f"CASE WHEN {x} IS NOT NULL THEN aggregate(sequence({self.levels - 1}, 0, -1), 0, (a, b) -> CASE WHEN a + shiftleft(1, b) <= {len(self.ends)} "
                f"AND get({listed}, a + shiftleft(1, b) - 1) <= {x} THEN a + shiftleft(1, b) ELSE a END) END")

    def code_sql(self, level: str, place: str) -> str:
        return f"({self.number}L * {1 << 40} + CAST({level} AS BIGINT) * {1 << 32} + {place})"

    def above_sql(self, cell: str) -> str:
        """The nodes over a cell, none for null."""
        nodes = f"transform(sequence(0, {self.levels}), h -> {self.code_sql('h', 'shiftright(p, h)')})"
        return f"flatten(transform(filter(array({cell}), q -> q IS NOT NULL), p -> {nodes}))"

    def tiles_sql(self, first: str, last: str) -> str:
        """The nodes that tile the cells from ``first`` to ``last``: on each level at most one on either side."""
        low, high = f"shiftright({first} + shiftleft(1, h) - 1, h)", f"shiftright({last} + 1, h)"
        return (f"flatten(transform(sequence(0, {self.levels}), h -> concat("
                f"CASE WHEN {low} < {high} AND {low} % 2 = 1 THEN array({self.code_sql('h', low)}) ELSE array() END, "
                f"CASE WHEN {low} < {high} AND {high} % 2 = 1 THEN array({self.code_sql('h', f'{high} - 1')}) ELSE array() END)))")


def bounded(groups: DataFrame) -> DataFrame:
    """Predicate groups with ``_view``, the numeric view that bounds them (null: none does), and ``_lo``, ``_hi``, the interval outside
    of which they fail (infinite where open).  A group whose ends cross never holds and keeps its ends as they are."""
    def ends(view: str):
        single, double = _VIEWS[view]
        lower = f"transform(filter(conditions, c -> (c.kind = '{single}' AND c.op IN ('>', '>=', '=')) OR c.kind = '{double}'), c -> CAST(c.lo AS DOUBLE))"
        upper = f"transform(filter(conditions, c -> c.kind = '{double}' OR (c.kind = '{single}' AND c.op IN ('<', '<=', '='))), c -> CASE WHEN c.kind = '{double}' THEN CAST(c.hi AS DOUBLE) ELSE CAST(c.lo AS DOUBLE) END)"
        return F.expr(f"array_max({lower})"), F.expr(f"array_min({upper})")

    (num_lo, num_hi), (bare_lo, bare_hi) = ends("num"), ends("bare")
    view = F.when(num_lo.isNotNull() | num_hi.isNotNull(), "num").when(bare_lo.isNotNull() | bare_hi.isNotNull(), "bare")
    infinite = lambda sign: F.lit(f"{sign}Infinity").cast("double")
    return groups.withColumn("_view", view).withColumn("_lo", F.coalesce(F.when(F.col("_view") == "num", num_lo).otherwise(bare_lo), infinite("-"))).withColumn(
        "_hi", F.coalesce(F.when(F.col("_view") == "num", num_hi).otherwise(bare_hi), infinite("")))


def plant(groups: DataFrame, plain: int = PLAIN) -> list[Tree]:
    """The trees of the properties with more than ``plain`` bounded predicates.  What comes to the driver is bounded by ALL_ENDS."""
    named = bounded(groups).filter("_view IS NOT NULL").select("property_id", "_view", "_lo", "_hi")
    tally = named.groupBy("property_id", "_view").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > plain)
    wanted = tally.orderBy(F.desc("n"), "property_id", "_view").limit(TREES).collect()
    if not wanted:
        return []
    share = min(TREE_ENDS, ALL_ENDS // len(wanted))
    chosen = groups.sparkSession.createDataFrame([(r["property_id"], r["_view"]) for r in wanted], "property_id int, _view string")
    finite = named.join(F.broadcast(chosen), ["property_id", "_view"]).select("property_id", "_view", F.explode(F.array("_lo", "_hi")).alias("e")).filter(
        F.abs("e") < float("inf")).distinct()
    part = F.ntile(share).over(W.partitionBy("property_id", "_view").orderBy("e"))
    rows = finite.withColumn("part", part).groupBy("property_id", "_view", "part").agg(F.min("e").alias("e")).collect()
    found: dict[tuple[int, str], list[float]] = {}
    for r in rows:
        found.setdefault((r["property_id"], r["_view"]), []).append(r["e"])
    return [Tree(i, p, v, tuple(sorted(ends))) for i, ((p, v), ends) in enumerate(sorted(found.items()))]


def candidates(rows: DataFrame, groups: DataFrame, trees: list[Tree], mode: str = "strict", bare_mode: str = "mysql", max_predicates: int = BROADCAST_ROWS) -> DataFrame:
    """``rows`` (data_id, property_id, value) joined with the predicate groups that may hold for them, each pair once: groups in a tree
    through its nodes, the others through their property."""
    whole_property = f"(CAST(property_id AS BIGINT) - {1 << 40})"  # below every node of a tree
    in_tree = lambda t: f"property_id = {t.property_id} AND _view = '{t.view}'"
    tiles = " ".join(f"WHEN {in_tree(t)} THEN {t.tiles_sql('_from', '_to')}" for t in trees)
    cells = lambda x: " ".join(f"WHEN {in_tree(t)} THEN {t.cell_sql(x)}" for t in trees)
    # a written table: the lists of ends are then constants of the plan; over local rows the optimizer would build them row by row
    placed = bounded(durable(groups, "tested")).withColumn("_from", F.expr(f"CASE {cells('_lo')} END")).withColumn("_to", F.expr(f"CASE {cells('_hi')} END"))
    control = placed.withColumn("_node", F.explode(F.expr(f"CASE {tiles} ELSE array({whole_property}) END"))).drop("property_id", "_view", "_lo", "_hi", "_from", "_to")

    properties = groups.select("property_id").distinct()
    few = local_copy(properties, max_predicates)
    tested = rows.join(properties if few is None else F.broadcast(few), "property_id", "left_semi")
    views = {v: sorted({t.property_id for t in trees if t.view == v}) for v in _VIEWS}
    number = {"num": to_decimal(F.col("value"), mode), "bare": to_decimal(F.col("value"), bare_mode)}
    for view, ids in views.items():
        tested = tested.withColumn(f"_{view}", F.when(F.col("property_id").isin(ids), number[view].cast("double")) if ids else F.lit(None).cast("double"))
    above = [f"CASE WHEN property_id = {t.property_id} THEN {t.above_sql(t.cell_sql('_' + t.view))} ELSE array() END" for t in trees]
    carried = tested.withColumn("_node", F.explode(F.expr(f"concat(array({whole_property}), {', '.join(above)})"))).drop("_num", "_bare")
    return join_control(carried, control, "_node", spread="data_id", max_rows=max_predicates).drop("_node")

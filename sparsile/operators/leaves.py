"""Flatten one nested JSON record into (field, value) leaves.

Everything happens inside the row with JSON and array functions, "last value of a field wins" too;
only leaves of keys that several records share are shuffled, for the same aggregate.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparsile.operators.nulls import join_null_safe
from sparsile.session import durable

# Item keys that name an element or phase and carry its content.
ELEMENT_KEYS = ("元素", "成分", "元素名称")
CONTENT_MARKS = ("含量", "质量分数", "wt%")
PHASE_NAME, PHASE_CONTENT = "相名称", "含量值"
LOWER, UPPER = "lb", "ub"

# Generic child names that take their parent's name.
CONTEXT_RENAMES = {
    "纳米压痕硬度(GPa)": {"硬度": "纳米压痕硬度(GPa)"},
    "纳米压痕模量(GPa)": {"模量": "纳米压痕模量(GPa)"},
    "纳米压痕硬度（GPa）": {"硬度": "纳米压痕硬度（GPa）"},
    "纳米压痕模量（GPa）": {"模量": "纳米压痕模量（GPa）"},
}


@dataclass(frozen=True)
class LeafRules:
    """How a record is flattened.  ``meta_prefix`` marks metadata fields, which
    depend on the exporting system and are never leaves."""

    meta_prefix: str = "META_"
    skip_fields: tuple[str, ...] = ("化学结构式",)
    renames: dict[str, dict[str, str]] = field(default_factory=lambda: dict(CONTEXT_RENAMES))
    pivots: bool = True
    prefix_nested: bool = False


def _q(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _bind(value: str, name: str, body: str) -> str:
    """SQL: evaluate ``value`` once and use it as ``name`` in an array ``body``."""
    return f"flatten(transform(array({value}), {name} -> {body}))"


def _nested(text: str) -> str:
    return f"(startswith({text}, '{{') OR startswith({text}, '['))"


def _fields(json: str) -> str:
    return f"from_json({json}, 'map<string,string>')"


def _entries(json: str, parsed: str | None = None) -> str:
    """SQL: ordered array of (k, v text, t kind) of a JSON object text; kinds are
    s(calar), o(bject), a(rray), n(ull).  ``parsed`` is its ``map<string,string>`` where that is at hand.

    A text that opens like an object or array may also be a string value.  Only
    rows that hold such a text are parsed again as variants to tell the two apart.
    """
    simple = "named_struct('k', e.key, 'v', e.value, 't', IF(e.value IS NULL, 'n', 's'))"
    kind = (f"CASE WHEN e.value IS NULL THEN 'n' WHEN NOT {_nested('e.value')} THEN 's' "
            "WHEN startswith(e.value, '{') THEN IF(try_variant_get(w.value, '$', 'map<string,variant>') IS NULL, 's', 'o') "
            "ELSE IF(try_variant_get(w.value, '$', 'array<variant>') IS NULL, 's', 'a') END")
    # a document whose nested objects repeat a key has no variant form; there the text decides
    looks = "CASE WHEN e.value IS NULL THEN 'n' WHEN startswith(e.value, '{') THEN 'o' WHEN startswith(e.value, '[') THEN 'a' ELSE 's' END"
    by_text = f"transform(es, e -> named_struct('k', e.key, 'v', e.value, 't', {looks}))"
    return _bind(
        f"map_entries({parsed or _fields(json)})", "es",
        f"IF(exists(es, e -> {_nested('e.value')}), "
        f"coalesce(zip_with(es, map_entries(from_json({json}, 'map<string,variant>')), (e, w) -> named_struct('k', e.key, 'v', e.value, 't', {kind})), {by_text}), "
        f"transform(es, e -> {simple}))")


def _items(json: str) -> str:
    """SQL: the object texts of a JSON array whose first item is an object.

    Array texts are compact here, so they equal their joined items exactly when no
    item is a string; only otherwise are item kinds looked up.
    """
    strings = f"transform(from_json({json}, 'array<variant>'), w -> startswith(to_json(w), '\"'))"
    return (f"IF(startswith({json}, '[{{'), " + _bind(
        f"from_json({json}, 'array<string>')", "xs",
        f"IF(concat('[', array_join(xs, ',', 'null'), ']') = {json}, filter(xs, x -> startswith(x, '{{')), "
        f"filter(zip_with(xs, {strings}, (x, q) -> IF(q OR NOT startswith(x, '{{'), NULL, x)), x -> x IS NOT NULL))") + ", array())")


def _sure(json: str) -> str:
    """SQL: no string in a JSON text opens like an object or array, so the text of a value tells its kind, at every depth.
    A string that does would show a quote before the bracket, or an escape in its place."""
    marks = [f"contains({json}, {_q(quote + bracket)})" for quote in "\"'" for bracket in "{["]
    return f"NOT ({' OR '.join(marks)} OR contains({json}, {_q(chr(92) + 'u00')}))"


class _ByKind:
    """Entries of any JSON object, their kinds looked up (see ``_entries``)."""

    key, value = "k", "v"

    def entries(self, json: str, parsed: str | None = None) -> str:
        return _entries(json, parsed)

    def has_kind(self, e: str, kind: str) -> str:
        return f"{e}.t = '{kind}'"

    def each_item(self, json: str, body: str) -> str:
        return f"flatten(transform({_items(json)}, i -> {_bind(_entries('i'), 'c', body)}))"


class _ByText(_ByKind):
    """Entries of a JSON object whose value texts tell their kinds (see ``_sure``): no second parse, no copies of entries,
    and a list of nothing but objects is parsed in one go."""

    key, value = "key", "value"

    def entries(self, json: str, parsed: str | None = None) -> str:
        return f"map_entries({parsed or _fields(json)})"

    def has_kind(self, e: str, kind: str) -> str:
        nested = {"o": f"startswith({e}.value, '{{')", "a": f"startswith({e}.value, '[')"}
        return nested.get(kind) or f"NOT {_nested(f'{e}.value')}"

    def each_item(self, json: str, body: str) -> str:
        one_go = _bind("map_entries(m)", "c", body)
        singly = _bind(self.entries("i"), "c", body)
        return (f"IF(startswith({json}, '[{{'), " + _bind(
            f"from_json({json}, 'array<map<string,string>>')", "ms",
            f"IF(ms IS NOT NULL AND NOT exists(ms, m -> m IS NULL), flatten(transform(ms, m -> {one_go})), "
            f"flatten(transform({_items(json)}, i -> {singly})))") + ", array())")


def _scalars(form: _ByKind, entries: str, name: str | None = None) -> str:
    return f"transform(filter({entries}, g -> {form.has_kind('g', 's')}), g -> named_struct('field', {name or f'g.{form.key}'}, 'value', g.{form.value}))"


def _object_leaves(form: _ByKind, e: str) -> str:
    k, v = form.key, form.value
    bounds = ", ".join(
        f"named_struct('field', concat({e}.{k}, '_{b}'), 'value', get(filter(c, x -> x.{k} = '{b}'), 0).{v})" for b in (LOWER, UPPER))
    return _bind(form.entries(f"{e}.{v}"), "c",
                 f"IF(exists(c, x -> x.{k} IN ('{LOWER}', '{UPPER}')), filter(array({bounds}), b -> b.value IS NOT NULL), {_scalars(form, 'c')})")


def _item_leaves(form: _ByKind, parent: str, rules: LeafRules) -> str:
    """SQL: leaves of the entries ``c`` of one item."""
    k, v = form.key, form.value
    pairs = [(p, child, new) for p, kids in rules.renames.items() for child, new in kids.items()]
    name = f"x.{k}"
    if pairs:
        table = ", ".join(f"{_q(p + chr(1) + child)}, {_q(new)}" for p, child, new in pairs)
        parents = ", ".join(_q(p) for p in rules.renames)
        name = f"IF({parent} IN ({parents}), coalesce(element_at(map({table}), concat({parent}, {_q(chr(1))}, x.{k})), x.{k}), x.{k})"
    grand = f"concat(x.{k}, '_', g.{form.key})" if rules.prefix_nested else None
    general = (f"flatten(transform(c, x -> CASE WHEN {form.has_kind('x', 'o')} THEN {_scalars(form, form.entries(f'x.{v}'), grand)} "
               f"WHEN {form.has_kind('x', 's')} THEN array(named_struct('field', {name}, 'value', x.{v})) ELSE array() END))")
    if not rules.pivots:
        return general
    elements = ", ".join(map(_q, ELEMENT_KEYS))
    first = lambda test: f"get(filter(c, x -> {test}), 0)"
    found = (f"named_struct('el', {first(f'x.{k} IN ({elements})')}, "
             f"'ct', {first(' OR '.join(f'contains(x.{k}, {_q(m)})' for m in CONTENT_MARKS))}, "
             f"'ph', {first(f'x.{k} = {_q(PHASE_NAME)}')}, 'am', {first(f'x.{k} = {_q(PHASE_CONTENT)}')})")
    pivot = lambda n, w: (f"IF(trim(m.{n}.{v}) != '' AND m.{w}.{v} IS NOT NULL, "
                          f"array(named_struct('field', trim(m.{n}.{v}), 'value', m.{w}.{v})), array())")
    named = _bind(found, "m", (
        f"CASE WHEN m.el.{k} IS NOT NULL AND m.ct.{k} IS NOT NULL THEN {pivot('el', 'ct')} "
        f"WHEN m.ph.{k} IS NOT NULL AND m.am.{k} IS NOT NULL THEN {pivot('ph', 'am')} ELSE {general} END"))
    return f"IF(exists(c, x -> x.{k} IN ({elements}, {_q(PHASE_NAME)})), {named}, {general})"


def record_leaves(json: str, rules: LeafRules, parsed: str | None = None) -> str:
    """SQL: array of (field, value) of one record, in document order; ``parsed`` as in ``_entries``."""
    skip = ", ".join(map(_q, rules.skip_fields)) or "''"

    def leaves_of(form: _ByKind) -> str:
        k, v = form.key, form.value
        return (f"flatten(transform({form.entries(json, parsed)}, e -> CASE WHEN e.{k} IN ({skip}) OR startswith(e.{k}, {_q(rules.meta_prefix)}) THEN array() "
                f"WHEN {form.has_kind('e', 'o')} THEN {_object_leaves(form, 'e')} "
                f"WHEN {form.has_kind('e', 'a')} THEN {form.each_item(f'e.{v}', _item_leaves(form, f'e.{k}', rules))} "
                f"WHEN {form.has_kind('e', 's')} THEN array(named_struct('field', e.{k}, 'value', e.{v})) ELSE array() END))")

    return f"IF({_sure(json)}, {leaves_of(_ByText())}, {leaves_of(_ByKind())})"


def unpack_leaves(records: DataFrame, column: str = "leaves") -> DataFrame:
    """One row per leaf of records that hold their leaves as an array (see ``record_leaves``)."""
    keep = [c for c in records.columns if c != column]
    return records.select(*keep, F.posexplode_outer(column).alias("leaf_pos", "leaf")).filter("leaf_pos IS NOT NULL").select(*keep, "leaf_pos", "leaf.field", "leaf.value")


def last_write_wins(leaves: DataFrame, record_keys: list[str]) -> DataFrame:
    """A field repeated inside one record keeps its last value but its first place."""
    carried = [c for c in leaves.columns if c not in (*record_keys, "field", "leaf_pos", "value")]
    return leaves.groupBy(*record_keys, "field").agg(
        F.min("leaf_pos").alias("leaf_pos"), F.max_by("value", "leaf_pos").alias("value"),
        *[F.first(c).alias(c) for c in carried])


def settle_leaves(leaves: str) -> str:
    """SQL: array of (leaf_pos, field, value) of one record's (field, value) leaves, where a repeated field keeps its
    last value but its first place.  Only arrays that repeat a field are sorted."""
    placed = lambda *order: f"transform({leaves}, (l, i) -> named_struct({', '.join(order)}))"
    place, name, value = "'leaf_pos', i", "'field', l.field", "'value', l.value"
    runs = _bind(f"sort_array({placed(name, place, value)})", "s", (
        "zip_with(filter(s, (x, i) -> i = 0 OR get(s, i - 1).field != x.field), filter(s, (x, i) -> i = size(s) - 1 OR get(s, i + 1).field != x.field), "
        "(a, b) -> named_struct('leaf_pos', a.leaf_pos, 'field', a.field, 'value', b.value))"))
    return f"IF(size(array_distinct({leaves}.field)) = size({leaves}), {placed(place, name, value)}, {runs})"


def settled_leaves(records: DataFrame, column: str = "leaves") -> DataFrame:
    """``last_write_wins`` of records that no other record shares its keys with: decided inside the row, nothing is shuffled."""
    keep = [c for c in records.columns if c != column]
    rows = records.select(*keep, F.explode_outer(F.expr(settle_leaves(f"`{column}`"))).alias("leaf"))
    return rows.filter("leaf IS NOT NULL").select(*keep, "leaf.field", "leaf.leaf_pos", "leaf.value")


def last_leaves(records: DataFrame, record_keys: list[str], repeated: DataFrame | None, column: str = "leaves") -> DataFrame:
    """Leaves of packed records, the last value of a field winning.  ``repeated`` holds the keys that several records share;
    only their leaves meet in an aggregate.  None: no key is shared."""
    if repeated is None:
        return settled_leaves(records, column)
    alone = settled_leaves(join_null_safe(records, repeated, record_keys, "left_anti"), column)
    shared = unpack_leaves(join_null_safe(records, repeated, record_keys, "left_semi"), column)
    return alone.unionByName(last_write_wins(shared, record_keys))


def repeated_keys(records: DataFrame, record_keys: list[str]) -> DataFrame | None:
    """Keys that several records share, nulls too; None if there are none.  Only the keys are read."""
    counted = records.groupBy(*record_keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(*record_keys)
    repeated = durable(counted, "repeated")
    return None if repeated.isEmpty() else repeated


def extract_leaves(records: DataFrame, record_keys: list[str], json_col: str = "data",
                   rules: LeafRules = LeafRules()) -> DataFrame:
    """One row per field of a record: its last value at its first place.

    Records are parsed once, into one compact row each in the shared folder, and settle their own
    repeated fields; leaves are shuffled only for keys that several records share.
    """
    keep = [c for c in records.columns if c not in (json_col, "pos")]
    packed = durable(records.select(*keep, F.expr(record_leaves(f"`{json_col}`", rules)).alias("leaves")), "leaves")
    return last_leaves(packed, record_keys, repeated_keys(packed, record_keys))


def fields_of(json_col: str) -> Column:
    return F.expr(_fields(f"`{json_col}`"))


def metadata_field(fields: Column, name: str, rules: LeafRules = LeafRules(), width: int = 100) -> Column:
    """A prefixed metadata field of a record's parsed fields (``fields_of``), cut to the column width, '' if absent."""
    return F.substring(F.coalesce(F.element_at(fields, F.lit(rules.meta_prefix + name)), F.lit("")), 1, width)

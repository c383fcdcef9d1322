"""Features of query text, as column expressions over a samples table."""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparsile.functions.numeric import LIST_MARK

# Patterns that decide how a query text is read.
AGGREGATE_CALL = r"(?i)\b(?:AVG|MAX|MIN|SUM|COUNT)\s*\("
EXTREME_CALL = r"(?i)\b(?:AVG|MAX|MIN)\s*\("
AGGREGATE_OF = (r"(?i)\b(AVG|MAX|MIN|SUM|COUNT)\s*\(\s*(DISTINCT\s+)?(?:CAST\s*\(\s*(\w+)\.value\s+AS\s+(?:DECIMAL|DOUBLE|FLOAT)\s*(?:\(\s*\d+\s*(?:,\s*\d+\s*)?\))?\s*\)"
                r"|(\w+)\.(value|data_id)|(\*|\d+))\s*\)")
SELECT_LIST = r"(?is)^\s*SELECT\b(.*?)\bFROM\b"
AGGREGATE_NAMES = ("COUNT", "SUM", "AVG", "MAX", "MIN")
VALUE_JOIN = r"(?i)JOIN\s+[\w.]+\.value_table"
SUBQUERY = r"(?i)\(\s*SELECT\b"
PROPERTY_EQUALS = r"property_id\s*=\s*(\d+)"
PROPERTY_IN = r"(?i)property_id\s+IN\s*\(([^)]+)\)"
ALIAS_PROPERTY = r"(?i)(\w+)\.property_id\s*(?:=\s*(\d+)|IN\s*\(([^)]+)\))"
WHERE_CLAUSE = r"(?is)WHERE(.*?)(?:ORDER BY|GROUP BY|LIMIT|;|$)"
STRING_LITERAL = r"'[^']*'"
CAST_VALUE = r"(?i)CAST\(\s*(\w+)\.value\s+AS\s+DECIMAL\s*(?:\(\s*\d+\s*(?:,\s*\d+\s*)?\))?\s*\)"
NUMBER = r"[0-9.eE+\-]+"
BOUNDARY_NAMES = {">": "greater", ">=": "greater_equal", "<": "less", "<=": "less_equal"}
OPERATOR_SPACING = (("< =", "<="), ("> =", ">="), ("! =", "!="))
QUOTE_FIXES = (("'γ+γ''", "'γ+γ'''"), ("'γ+γ'+TCP'", "'γ+γ''+TCP'"))
ZERO_THRESHOLD = r"(CAST\(\w+\.value\s+AS\s+DECIMAL\(\d+,\s*\d+\)\)\s*[><]=?\s*)-?0\.0\b"
ZERO_PHRASES = (("大于", "大于"), ("小于", "小于"), (">", ">"))
WHOLE_ZERO = r"0(?![0-9.])"

# conditions of one alias: (alias, property_id, kind, op, lo, hi, text)
CONDITION_TYPE = ("array<struct<alias:string,kind:string,op:string,"
                  "lo:decimal(30,15),hi:decimal(30,15),text:string>>")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalize_space(sql: Column) -> Column:
    return F.trim(F.regexp_replace(sql, r"\s+", " "))


def repair_sql(sql: Column, renames: dict[str, str] | None = None) -> Column:
    """Operator spacing, two known quoting slips, trailing semicolons, schema names."""
    pairs = [*QUOTE_FIXES, *OPERATOR_SPACING, *(renames or {}).items()]
    fixed = reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, sql)
    return F.regexp_replace(F.rtrim(fixed), r";+\s*$", "")


def is_aggregation(sql: Column) -> Column:
    return F.rlike(sql, F.lit(AGGREGATE_CALL))


def uses_function(sql: Column, name: str) -> Column:
    return F.rlike(sql, F.lit(rf"(?i)\b{name}\s*\("))


def count_joins(sql: Column) -> Column:
    return F.regexp_count(sql, F.lit(r"(?i)\bJOIN\b"))


def count_where(sql: Column) -> Column:
    return F.regexp_count(sql, F.lit(r"(?i)\bWHERE\b"))


def value_joins(sql: Column) -> Column:
    return F.regexp_count(sql, F.lit(VALUE_JOIN))


def has_subquery(sql: Column) -> Column:
    return F.rlike(sql, F.lit(SUBQUERY))


def property_ids(sql: Column, with_in: bool = True) -> Column:
    """Sorted distinct property ids a query refers to."""
    found = F.regexp_extract_all(sql, F.lit(PROPERTY_EQUALS), 1)
    if with_in:
        lists = F.regexp_extract_all(sql, F.lit(PROPERTY_IN), 1)
        found = F.concat(found, F.regexp_extract_all(F.array_join(lists, ","), F.lit(r"(\d+)"), 1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: x.cast("int"))))


def count_where_conditions(sql: Column) -> Column:
    where = F.regexp_extract(sql, WHERE_CLAUSE, 1)
    bare = F.regexp_replace(where, STRING_LITERAL, "")
    return F.when(F.trim(F.regexp_replace(where, r"\s+", " ")) == "", 0).otherwise(
        1 + F.regexp_count(bare, F.lit(r"(?i)\b(?:AND|OR)\b")))


def _outside_brackets(text: Column, mark: str) -> Column:
    """The text with each outermost bracketed part replaced by ``mark``; unmatched closing brackets stay."""
    pieces = F.regexp_extract_all(text, F.lit(r"[()]|[^()]+"), 0)
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("depth"))

    def step(s, p):
        out, depth = s["out"], s["depth"]
        opens, closes = p == "(", (p == ")") & (depth > 0)
        return F.struct(F.when(opens & (depth == 0), F.concat(out, F.lit(mark))).when((depth > 0) | opens, out).otherwise(F.concat(out, p)).alias("out"),
                        (depth + F.when(opens, 1).when(closes, -1).otherwise(0)).alias("depth"))

    return F.aggregate(pieces, start, step)["out"]


def filter_condition_count(sql: Column) -> Column:
    """Predicates in ON/WHERE: BETWEEN is one, join keys are none, a bracketed
    group is one, and a predicate must mention property_id or value."""
    clause = F.regexp_extract(sql, r"(?is)\b(?:ON|WHERE)\b(.*)$", 1)
    clause = F.regexp_replace(clause, r"(?is)\bORDER\s+BY\b.*$", "")
    # everything inside brackets is blanked, however deep, so AND/OR there cannot split
    flat = _outside_brackets(F.regexp_replace(clause, CAST_VALUE, "$1.value"), " value_group ")
    flat = F.regexp_replace(flat, r"(?i)\bBETWEEN\b\s*\S+?\s*\bAND\b", "BETWEEN")
    parts = F.split(flat, r"(?i)\s+(?:AND|OR)\s+")
    kept = F.filter(parts, lambda p: F.rlike(p, F.lit(r"(?i)\bproperty_id\b|\bvalue\b|value_group"))
                    & ~F.rlike(F.trim(p), F.lit(r"(?i)^[\w.]+\.data_id\s*=\s*[\w.]+\.data_id$")))
    return F.size(kept)


def classify_query(sql: Column, variant: str = "a", source_count: Column | None = None) -> Column:
    """aggregated / complex / simple, in the three published variants."""
    if variant == "a":
        aggregated, complex_ = F.rlike(sql, F.lit(EXTREME_CALL)), (
            (value_joins(sql) >= 2) | (F.size(property_ids(sql, with_in=False)) >= 2) | has_subquery(sql))
    elif variant == "b":
        aggregated, complex_ = is_aggregation(sql), (
            (value_joins(sql) >= 2) | (F.size(property_ids(sql, with_in=False)) >= 2))
    elif variant == "c":
        mentions = F.regexp_count(sql, F.lit(r"(?i)property_id\s*="))
        sources = F.lit(0) if source_count is None else source_count
        aggregated = F.rlike(sql, F.lit(r"(?i)(?:MAX|MIN|AVG|SUM|COUNT)\("))
        complex_ = ~((mentions == 1) & (sources <= 1))
    else:
        raise ValueError(f"unknown variant {variant!r}")
    return F.when(aggregated, "aggregated").when(complex_, "complex").otherwise("simple")


def operator_class(sql: Column) -> Column:
    """aggregate / equality_only / other, with string literals blanked first."""
    words = F.rlike(sql, F.lit(r"(?i)COUNT|SUM|AVG|MAX|MIN|GROUP BY|HAVING"))
    bare = F.regexp_replace(sql, STRING_LITERAL, "")
    return F.when(words, "aggregate").when(F.rlike(bare, F.lit(r"[<>]|BETWEEN")), "other").otherwise("equality_only")


def boundary_types(sql: Column) -> Column:
    """Distinct numeric boundary kinds; empty unless a DECIMAL cast is present.
    The '<>' operator is not a boundary."""
    text = F.upper(normalize_space(sql))
    ranged = F.when(F.rlike(text, F.lit(r"BETWEEN\s+[0-9.\-+]+(?:AND|\s+AND)\s+[0-9.\-+]+")),
                    F.array(F.lit("range"))).otherwise(F.array().cast("array<string>"))
    ops = F.regexp_extract_all(F.replace(text, F.lit("<>"), F.lit("!=")), F.lit(rf"(>=|<=|>|<)\s*{NUMBER}"), 1)
    named = F.transform(ops, lambda o: reduce(
        lambda acc, kv: acc.when(o == kv[0], kv[1]), list(BOUNDARY_NAMES.items())[1:],
        F.when(o == ">", BOUNDARY_NAMES[">"])))
    return F.when(F.contains(text, F.lit("DECIMAL")), F.array_distinct(F.concat(ranged, named))).otherwise(
        F.array().cast("array<string>"))


def rewrite_zero_threshold(sql: Column, threshold: str = "0.1") -> Column:
    return F.regexp_replace(sql, ZERO_THRESHOLD, "$1" + threshold)


def rewrite_zero_phrase(text: Column, threshold: str = "0.1") -> Column:
    """The first phrase with a whole number zero takes the new threshold; 0.5 or 05 is another number."""
    branches = None
    for old, word in ZERO_PHRASES:
        hit, new = F.rlike(text, F.lit(old + WHOLE_ZERO)), F.regexp_replace(text, old + WHOLE_ZERO, word + threshold)
        branches = F.when(hit, new) if branches is None else branches.when(hit, new)
    return branches.otherwise(text)


def _matches(sql: Column, pattern: str, build, groups: int) -> Column:
    found = [F.regexp_extract_all(sql, F.lit(pattern), g + 1) for g in range(groups)]
    if groups == 1:
        return F.transform(found[0], build)
    zipped = F.arrays_zip(*[f.alias(f"g{i}") for i, f in enumerate(found)])
    return F.transform(zipped, lambda m: build(*[m[f"g{i}"] for i in range(groups)]))


def _condition(alias: Column, kind, op=None, lo=None, hi=None, text=None) -> Column:
    number = lambda c: (F.lit(None) if c is None else c).try_cast("decimal(30,15)")
    word = lambda c: (F.lit(None) if c is None else c).cast("string")
    return F.struct(alias.alias("alias"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"),
                    word(op).alias("op"), number(lo).alias("lo"), number(hi).alias("hi"),
                    word(text).alias("text"))


def alias_properties(sql: Column) -> Column:
    """array of (alias, property_ids) in text order; an IN list names several."""
    return _matches(sql, rf"{ALIAS_PROPERTY}",
                    lambda a, one, several: F.struct(a.alias("alias"), F.transform(F.regexp_extract_all(F.concat(one, several), F.lit(r"(\d+)"), 1), lambda x: x.cast("int")).alias("property_ids")), 3)


def alias_conditions(sql: Column) -> Column:
    """array of conditions on ``alias.value``, any alias, polarity of LIKE kept."""
    op, compare_op = r"(=|!=|<>)", r"(>=|<=|<>|!=|>|<|=)"
    literal = r"'((?:[^']|'')*)'"
    unquote = lambda t: F.replace(t, F.lit("''"), F.lit("'"))
    canonical = lambda o: F.when(o == "<>", "!=").otherwise(o)
    # a cast column becomes ``alias.#num``, so that bare patterns cannot match it
    text = F.regexp_replace(sql, CAST_VALUE, "$1.#num")
    # an equality with an empty literal is the cleaning predicate, not a text test
    once = F.regexp_replace(text, r"(\w+)\.value\s*(?:!=|<>)\s*''(?!')", "$1.#filled")
    parts = lambda cleaned: [
        _matches(cleaned, rf"(\w+)\.#num\s*{compare_op}\s*({NUMBER})", lambda a, o, v: _condition(a, "num", canonical(o), v), 3),
        _matches(cleaned, rf"(?i)(\w+)\.#num\s*BETWEEN\s*({NUMBER}?)\s*AND\s*({NUMBER})",
                 lambda a, lo, hi: _condition(a, "between", None, lo, hi), 3),
        _matches(cleaned, rf"(\w+)\.value\s*{op}\s*{literal}", lambda a, o, t: _condition(a, "str", canonical(o), text=unquote(t)), 3),
        _matches(cleaned, rf"(?i)(\w+)\.value\s+(NOT\s+)?LIKE\s+{literal}",
                 lambda a, n, t: _condition(a, F.when(n == "", "like").otherwise("not_like"), text=unquote(t)), 3),
        _matches(cleaned, rf"(\w+)\.value\s*{compare_op}\s*({NUMBER})", lambda a, o, v: _condition(a, "bare", canonical(o), v), 3),
        _matches(cleaned, rf"(?i)(\w+)\.value\s*BETWEEN\s*({NUMBER}?)\s*AND\s*({NUMBER})",
                 lambda a, lo, hi: _condition(a, "bare_between", None, lo, hi), 3),
        _matches(cleaned, r"(\w+)\.#filled", lambda a: _condition(a, "non_empty"), 1),
        _matches(cleaned, r"(?i)(\w+)\.value\s+IS\s+NOT\s+NULL", lambda a: _condition(a, "not_null"), 1),
    ]
    return let(once, lambda cleaned: F.concat(*[p.cast(CONDITION_TYPE) for p in parts(cleaned)]))


def aggregate_calls(sql: Column) -> Column:
    """array of (call, fn, alias, as_number, distinct, of) of the aggregate calls in the select list, in text order: ``of`` a ``value``, an ``entity`` (its id)
    or, for ``COUNT(*)``, a ``row``.  Calls of other forms are left out; :func:`call_count` counts them too."""
    listed = F.regexp_extract(sql, SELECT_LIST, 1)
    found = _matches(listed, AGGREGATE_OF, lambda fn, distinct, cast, alias, column, row: F.struct(
        F.lower(fn).alias("fn"), F.when(row == "", F.concat(cast, alias)).alias("alias"), (cast != "").alias("as_number"), (distinct != "").alias("distinct"),
        F.when(row != "", "row").when(F.lower(column) == "data_id", "entity").otherwise("value").alias("of")), 6)
    known = F.filter(found, lambda c: (c["of"] != "row") | ((c["fn"] == "count") & ~c["distinct"]))
    return F.transform(known, lambda c, i: F.struct(i.alias("call"), *[c[n].alias(n) for n in ("fn", "alias", "as_number", "distinct", "of")]))


def call_count(sql: Column) -> Column:
    """Aggregate calls of any form in the select list."""
    return F.regexp_count(F.regexp_extract(sql, SELECT_LIST, 1), F.lit(AGGREGATE_CALL))


# ---- conditions of a whole query text ---------------------------------------

# The parts of a condition that are read, over a text whose literals are numbered ('0', '1', …) and whose
# casts are written ``alias.#num``.
_AMOUNT = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
_COMPARE = r"(?:>=|<=|<>|!=|>|<|=)"
_ITEM = rf"(?:'\d+'|{_AMOUNT})"
_COLUMN = r"\w+\.(?:value|#num|title|data_id)"
_TABLE = r"[\w.]+(?:(?:\s+AS)?\s+(?!(?:WHERE|JOIN|INNER|LEFT|RIGHT|FULL|CROSS|ORDER|GROUP|LIMIT|UNION|ON)\b)\w+)?"
_PARTS = {
    "join": r"\w+\.data_id\s*=\s*\w+\.data_id\b",
    "nested": rf"(?:\w+\.data_id\s+(?:NOT\s+)?IN\s*\(\s*SELECT\s+(?:DISTINCT\s+)?\w+\.data_id|EXISTS\s*\(\s*SELECT\s+(?:DISTINCT\s+)?(?:\w+\.data_id|\d+|\*))\s+FROM\s+{_TABLE}",
    "property": r"\w+\.property_id\s*(?:=\s*\d+(?![\w.])|IN\s*\(\s*\d+(?:\s*,\s*\d+)*\s*\))",
    "between": rf"{_COLUMN}\s*(?:NOT\s+)?BETWEEN\s*{_AMOUNT}\s*AND\s*{_AMOUNT}(?![\w.])",
    "like": rf"\w+\.(?:value|title)\s+(?:NOT\s+)?LIKE\s*'\d+'",
    "in": rf"{_COLUMN}\s+(?:NOT\s+)?IN\s*\(\s*{_ITEM}(?:\s*,\s*{_ITEM})*\s*\)",
    "null": r"\w+\.value\s+IS\s+(?:NOT\s+)?NULL\b",
    "number": rf"\w+\.(?:value|#num|data_id)\s*{_COMPARE}\s*{_AMOUNT}(?![\w.])",
    "literal": r"\w+\.(?:value|title)\s*(?:=|!=|<>)\s*'\d+'",
    "where": rf"WHERE\b|(?:INNER\s+)?JOIN\s+{_TABLE}\s+ON\b",
    "from": rf"FROM\s+{_TABLE}(?:\s*,\s*{_TABLE})*",
    "word": r"(?:AND|OR|NOT)\b|[()]",
}
_READ = "|".join(_PARTS.values())
_INVERSE = {">": "<=", ">=": "<", "<": ">=", "<=": ">", "=": "!=", "!=": "="}
_OPPOSITE = {"between": "not_between", "bare_between": "not_bare_between", "like": "not_like", "in": "not_in", "not_null": "is_null", "non_empty": "empty"}
TITLE, ENTITY_ID = -1, -2  # properties that stand for an entity's own title and id
MOST_CLAUSES = 4096
_ANTI = 1 << 20  # from here on a literal belongs to something that must not exist


_fresh = itertools.count()


def _let(value: str, body) -> str:
    """``body`` of a name that stands for ``value``, so that it is computed once."""
    name = f"x{next(_fresh)}"
    return f"get(transform(array({value}), {name} -> {body(name)}), 0)"


def _map(items: str, body, of: str = "transform") -> str:
    name = f"x{next(_fresh)}"
    return f"{of}({items}, {name} -> {body(name)})"


def _pattern(text: str, whole: bool = False) -> str:
    return 'r"(?is)' + (f"^(?:{text})$" if whole else text) + '"'


def _is(token: str, *parts: str) -> str:
    return f"rlike({token}, {_pattern('|'.join(_PARTS[p] for p in parts), True)})"


_CAST = 'r"' + CAST_VALUE + '"'
_LITERAL = 'r"' + "'((?:[^']|'')*)'" + '"'
_NONE, _TRUE = "CAST(array() AS array<array<int>>)", "array(CAST(array() AS array<int>))"
_TESTS = ("join", "property", "between", "like", "in", "null", "number", "literal")


def _text_sql(sql: str) -> str:
    """The text from FROM on, with numbered literals, marked casts and without its order."""
    numbered = _let(f"split({sql}, {_LITERAL}, -1)", lambda ps: f"array_join(transform({ps}, (p, i) -> concat(p, CASE WHEN i < size({ps}) - 1 THEN concat(\"'\", i, \"'\") ELSE '' END)), '')")
    head = _pattern(r"^\s*SELECT\b.*?(?=\bFROM\b|\bWHERE\b)")
    tail = _pattern(r"\s*\b(?:GROUP\s+BY\s+[\w.,\s]+?)?(?:ORDER\s+BY\s+[\w.,\s]+)?;?\s*$")
    return f"regexp_replace(regexp_replace(regexp_replace({numbered}, {_CAST}, '$1.#num'), {head}, ''), {tail}, '')"


def _typed_sql(tokens: str) -> str:
    """array of (token, type, scope): what kind of part each is, and the number of the nested query it stands in (0 outside)."""
    kinds = _map(tokens, lambda p: f"""named_struct('token', {p}, 'type', CASE WHEN upper({p}) IN ('AND', 'OR', 'NOT', '(', ')') THEN upper({p}) WHEN {_is(p, 'nested')} THEN 'nested'
        WHEN {_is(p, 'where')} THEN 'where' WHEN {_is(p, 'from')} THEN 'from' WHEN {_is(p, *_TESTS)} THEN 'test' ELSE '?' END)""")
    return f"""aggregate({kinds}, named_struct('out', CAST(array() AS array<struct<token:string,type:string,scope:int>>), 'open', array(0), 'last', 0), (s, p) -> {_let(
        "CASE WHEN p.type = 'nested' THEN s.last + 1 ELSE element_at(s.open, -1) END", lambda scope: f'''named_struct(
            'out', concat(s.out, array(named_struct('token', p.token, 'type', p.type, 'scope', {scope}))),
            'open', CASE WHEN p.type IN ('nested', '(') THEN concat(s.open, array({scope})) WHEN p.type = ')' THEN slice(s.open, 1, greatest(size(s.open) - 1, 1)) ELSE s.open END,
            'last', s.last + CAST(p.type = 'nested' AS INT))''')}, s -> s.out)"""


def _atoms_sql(typed: str, literals: str) -> str:
    """What each test tests: (name of what must exist, kind, op, lo, hi, text, property_ids, negated)."""
    head = r"^(\w+)\.(value|#num|title|data_id|property_id)"
    whole = lambda t, i: f"regexp_extract({t}.token, {_pattern(head)}, {i})"
    first = _map(f"filter({typed}, t -> t.type = 'test')", lambda t: f"named_struct('token', {t}.token, 'scope', {t}.scope, 'alias', {whole(t, 1)}, 'col', lower({whole(t, 2)}), 'rest', regexp_replace({t}.token, {_pattern(head)}, ''))")
    amounts = lambda t: "regexp_extract_all(regexp_replace(" + t + ".rest, r\"'\\d+'\", ' '), r\"(" + _AMOUNT + ")\", 1)"
    texts = lambda t: "transform(regexp_extract_all(" + t + ".rest, r\"'(\\d+)'\", 1), i -> get(" + literals + ", CAST(i AS INT)))"
    second = _map(first, lambda t: f"""named_struct('token', {t}.token, 'scope', {t}.scope, 'alias', {t}.alias, 'col', {t}.col, 'amounts', {amounts(t)}, 'texts', {texts(t)},
        'op', replace(regexp_extract({t}.rest, r"^\\s*({_COMPARE})", 1), '<>', '!='), 'negated', rlike({t}.rest, {_pattern(r'^\s*(?:NOT\b|IS\s+NULL)')}))""".replace("\\\\s", "\\s"))
    third = _map(second, lambda t: f"""named_struct('t', {t}, 'kind', CASE WHEN {_is(t + '.token', 'join')} THEN 'join' WHEN {t}.col = 'property_id' THEN 'property'
        WHEN {_is(t + '.token', 'between')} THEN CASE WHEN {t}.col = 'value' THEN 'bare_between' WHEN {t}.col IN ('#num', 'data_id') THEN 'between' END
        WHEN {_is(t + '.token', 'like')} THEN 'like' WHEN {_is(t + '.token', 'null')} THEN 'not_null'
        WHEN {_is(t + '.token', 'in')} THEN CASE WHEN {t}.col IN ('value', 'title') AND size({t}.amounts) = 0 OR {t}.col = 'data_id' AND size({t}.texts) = 0 THEN 'in' END
        WHEN {_is(t + '.token', 'number')} THEN CASE WHEN {t}.col = 'value' THEN 'bare' ELSE 'num' END
        WHEN {t}.col = 'value' AND {t}.op = '!=' AND get({t}.texts, 0) = '' THEN 'non_empty' ELSE 'str' END)""")
    number = lambda k, i: f"TRY_CAST(get({k}.t.amounts, {i}) AS DECIMAL(30,15))"
    return _map(third, lambda k: f"""named_struct(
        'name', concat(CASE WHEN {k}.kind = 'join' THEN '#join' WHEN {k}.t.col IN ('title', 'data_id') THEN concat('#', {k}.t.col) ELSE {k}.t.alias END, CASE WHEN {k}.t.scope > 0 THEN concat('@', {k}.t.scope) ELSE '' END),
        'kind', {k}.kind, 'op', CASE WHEN {k}.kind IN ('num', 'bare', 'str') THEN {k}.t.op END,
        'lo', CASE WHEN {k}.kind IN ('num', 'bare', 'between', 'bare_between') THEN {number(k, 0)} END, 'hi', CASE WHEN {k}.kind IN ('between', 'bare_between') THEN {number(k, 1)} END,
        'text', CASE WHEN {k}.kind = 'in' THEN array_join(CASE WHEN {k}.t.col = 'data_id' THEN transform({k}.t.amounts, x -> CAST(TRY_CAST(x AS BIGINT) AS STRING)) ELSE {k}.t.texts END, '{LIST_MARK}')
            WHEN {k}.kind IN ('str', 'like') THEN get({k}.t.texts, 0) END,
        'property_ids', CASE WHEN {k}.kind = 'property' THEN transform({k}.t.amounts, x -> CAST(x AS INT)) WHEN {k}.t.col = 'title' THEN array({TITLE}) WHEN {k}.t.col = 'data_id' THEN array({ENTITY_ID}) END,
        'negated', {k}.t.negated)""")


def _test_of(code: str) -> str:
    return f"get(_atoms, abs({code}) % {_ANTI} - 1)"


def _name_of(code: str) -> str:
    return f"concat_ws('!', {_test_of(code)}.name, abs({code}) div {_ANTI})"


def _joins(code: str) -> str:
    return f"{_test_of(code)}.kind = 'join'"


def _both(left: str, right: str) -> str:
    """Every clause of one side with every clause of the other."""
    pairs = _map(left, lambda a: _map(right, lambda b: f"array_distinct(concat({a}, {b}))"))
    return f"CASE WHEN CAST(size({left}) AS BIGINT) * size({right}) <= {MOST_CLAUSES} THEN flatten({pairs}) END"


def _absent(clauses: str) -> str:
    """Clauses that hold where none of the given ones does.  What a clause asks to exist are its names; it fails
    where one of them does not exist."""
    turned = lambda c, i: f"CASE WHEN abs({c}) >= {_ANTI} THEN CAST(sign({c}) AS INT) * (abs({c}) % {_ANTI}) ELSE CAST(sign({c}) AS INT) * (abs({c}) + ({i} + 1) * {_ANTI}) END"
    tests = "filter(clause, c -> NOT " + _joins("c") + ")"
    fails = _let(tests, lambda ts: _map(f"array_distinct({_map(ts, _name_of)})", lambda n: f"transform(filter({ts}, c -> {_name_of('c')} = {n}), c -> {turned('c', 'nth')})"))
    return f"aggregate(transform({clauses}, (clause, nth) -> {fails}), {_TRUE}, (sofar, part) -> {_both('sofar', 'part')})"


def _fold_sql(typed: str) -> str:
    """The fold: a stack of operands (clauses under which each is true, and false) and one of operators."""
    top, popped = lambda a: f"try_element_at({a}, -1)", lambda a: f"slice({a}, 1, greatest(size({a}) - 1, 0))"
    side = lambda pos, neg: f"named_struct('pos', {pos}, 'neg', {neg})"
    state = lambda s, **new: "named_struct(" + ", ".join(f"'{k}', {new.get(k, f'{s}.{k}')}" for k in ("vals", "ops", "used", "bad")) + ")"
    put = lambda s, *values: f"concat({s}, array({', '.join(values)}))"

    def combined(s: str, op: str) -> str:
        """The two upper operands as one, if ``op`` is the upper operator."""
        pair = lambda x: {"AND": side(_both(f"{x}.a.pos", f"{x}.b.pos"), f"concat({x}.a.neg, {x}.b.neg)"), "OR": side(f"concat({x}.a.pos, {x}.b.pos)", _both(f"{x}.a.neg", f"{x}.b.neg"))}[op]
        one = _let(f"named_struct('a', try_element_at({s}.vals, -2), 'b', {top(s + '.vals')})", pair)
        return f"CASE WHEN {top(s + '.ops')} = '{op}' AND size({s}.vals) >= 2 THEN {state(s, vals=put(popped(popped(s + '.vals')), one), ops=popped(s + '.ops'))} ELSE {s} END"

    def complete(s: str) -> str:
        """After an operand: NOT applies, then AND."""
        turned = state(s, vals=put(popped(s + ".vals"), side(top(s + ".vals") + ".neg", top(s + ".vals") + ".pos")), ops=popped(s + ".ops"))
        return _let(f"CASE WHEN {top(s + '.ops')} = 'NOT' THEN {turned} ELSE {s} END", lambda x: combined(x, "AND"))

    def closed(s: str, mark: str) -> str:
        """Up to the opening ``mark``, if it is the upper one once OR is applied; its value is an operand."""
        def close(x: str) -> str:
            pos, more = top(x + ".vals") + ".pos", {}
            if mark == "nested":
                grounded = f"forall({pos}, clause -> exists(clause, c -> NOT {_joins('c')}))"
                more = {"vals": put(popped(x + ".vals"), side(pos, _absent(pos))), "bad": f"{x}.bad OR NOT coalesce({grounded}, false)"}
            return f"CASE WHEN {top(x + '.ops')} = '{mark}' THEN {_let(state(x, ops=popped(x + '.ops'), **more), complete)} ELSE {x} END"
        return _let(combined(s, "OR"), close)

    operand = _let("get(_atoms, s.used).negated", lambda no: side(f"array(array(CASE WHEN {no} THEN -1 ELSE 1 END * (s.used + 1)))", f"array(array(CASE WHEN {no} THEN 1 ELSE -1 END * (s.used + 1)))"))
    not_in = "rlike(t.token, " + _pattern(r"^\w+\.data_id\s+NOT\b") + ")"
    opened = state("s", vals=put("s.vals", side(_TRUE, _NONE)), ops=f"concat(s.ops, CASE WHEN {not_in} THEN array('NOT', 'nested') ELSE array('nested') END)")
    step = f"""CASE t.type WHEN 'test' THEN {_let(state('s', vals=put('s.vals', operand), used='s.used + 1'), complete)}
        WHEN 'AND' THEN {state('s', ops=put('s.ops', "'AND'"))} WHEN 'OR' THEN {_let(combined('s', 'OR'), lambda x: state(x, ops=put(x + '.ops', "'OR'")))}
        WHEN 'NOT' THEN {state('s', ops=f"CASE WHEN {top('s.ops')} = 'NOT' THEN {popped('s.ops')} ELSE {put('s.ops', chr(39) + 'NOT' + chr(39))} END")}
        WHEN '(' THEN {state('s', ops=put('s.ops', "'('"))} WHEN 'nested' THEN {opened}
        WHEN 'where' THEN {_let(closed('s', '['), lambda x: state(x, ops=put(x + '.ops', "'AND'", "'['")))}
        WHEN ')' THEN {_let(closed('s', '['), lambda x: _let(closed(x, '('), lambda y: f"CASE WHEN size({y}.ops) < size({x}.ops) THEN {y} ELSE {closed(y, 'nested')} END"))}
        WHEN 'from' THEN s ELSE {state('s', bad='true')} END"""
    start = f"named_struct('vals', array({side(_TRUE, _NONE)}), 'ops', array('('), 'used', 0, 'bad', false)"
    return f"aggregate({typed}, {start}, (s, t) -> {step})"


def _reason_sql() -> str:
    """Why a text is not read in full, over the columns of :func:`read_queries`."""
    left = f"regexp_replace(_text, {_pattern(_READ)}, ' ')"
    clauses = "_state.vals[0].pos"
    ungrounded = f"exists({clauses}, c -> exists(c, k -> {_test_of('k')}.property_ids IS NULL AND NOT {_joins('k')} AND NOT exists(c, o -> {_name_of('o')} = {_name_of('k')} AND {_test_of('o')}.kind = 'property')))"
    turned = f"exists({clauses}, c -> exists(c, k -> k < 0 AND {_test_of('k')}.kind IN ('property', 'join')))"
    at = lambda t: f"transform(regexp_extract_all({t}.token, {_pattern(r'(\w+)\.(?:value|#num|title|data_id|property_id)')}, 1), a -> concat_ws('@', a, {t}.scope))"
    declared = f"flatten(transform(filter(_ts, t -> t.scope > 0 AND t.type IN ('nested', 'where')), t -> transform(regexp_extract_all(t.token, {_pattern(r'\b(?:FROM|JOIN)\s+[\w.]+(?:\s+AS)?\s+(\w+)')}, 1), a -> concat_ws('@', a, t.scope))))"
    inner = "filter(_ts, t -> t.scope > 0 AND t.type = 'test')"
    strange = lambda t, d: f"exists({at(t)}, a -> NOT array_contains({d}, a))"
    foreign = _let(declared, lambda d: f"exists({inner}, t -> NOT {_is('t.token', 'join')} AND {strange('t', d)})")
    linked = _let(declared, lambda d: f"transform(filter({inner}, t -> {_is('t.token', 'join')} AND {strange('t', d)}), t -> t.scope)")
    loose = _let(linked, lambda n: f"exists(_ts, t -> t.type = 'nested' AND rlike(t.token, {_pattern('^EXISTS')}) AND NOT array_contains({n}, t.scope))")
    nested = "exists(_ts, t -> t.type = 'nested')"
    return f"""CASE WHEN trim(_sql) = '' THEN 'empty' WHEN rlike({left}, {_pattern(r'\bSELECT\b')}) THEN 'subquery'
        WHEN rlike({left}, {_pattern('property_id')}) OR {turned} OR {ungrounded} THEN 'property'
        WHEN rlike({left}, {_pattern(r'\w+\.(?:value|#num|title|data_id)\b')}) OR exists(_atoms, a -> a.kind IS NULL) THEN 'value_test'
        WHEN {nested} AND ({foreign} OR {loose}) THEN 'nested' WHEN exists(_ts, t -> t.type = '?') THEN 'other' WHEN {clauses} IS NULL THEN 'too_many_clauses'
        WHEN _state.bad OR size(_state.vals) <> 1 OR size(_state.ops) <> 0 THEN 'structure' END"""


def read_queries(samples: DataFrame, sql: str = "sql", key: str = "sample_id") -> DataFrame:
    """Query texts as (key, clauses, atoms, reason).

    The condition is folded over its parts with a stack of operands and one of operators: NOT before AND before OR, brackets and
    nested queries of any depth.  An operand holds the clauses under which it is true and those under which it is
    false, so NOT swaps them and reaches the single tests.  A clause is an array of tests: number k + 1 of the atoms,
    negative where negated; from ``_ANTI`` on, tests of something that must not exist (a nested query that is negated).
    ``reason`` says why the text cannot be read in full, or is null: no text, a nested query of no known form, a property
    or a value test of no known form, other words, brackets that do not match, or more than ``MOST_CLAUSES`` clauses."""
    texts = samples.select(F.col(key), F.col(sql).alias("_sql")).repartition(samples.sparkSession.sparkContext.defaultParallelism)  # few bytes, much to do for each
    prepared = texts.select(
        key, "_sql", F.expr(_text_sql("_sql")).alias("_text"), F.expr(f"transform(regexp_extract_all(_sql, {_LITERAL}, 1), t -> replace(t, \"''\", \"'\"))").alias("_literals"))
    tokens = "concat(regexp_extract_all(_text, " + _pattern(_READ + r"|\S") + ", 0), array(')'))"
    typed = prepared.select("*", F.expr(_typed_sql(tokens)).alias("_ts"))
    tested = typed.select("*", F.expr(_atoms_sql("_ts", "_literals")).alias("_atoms"))
    folded = tested.select("*", F.expr(_fold_sql("_ts")).alias("_state"))
    return folded.select(key, F.expr("_state.vals[0].pos").alias("clauses"), F.col("_atoms").alias("atoms"), F.expr(_reason_sql()).alias("reason"))


def signed_sql(test: str) -> str:
    """The condition (kind, op, lo, hi, text) of a test, negated where it is ``negative``."""
    pick = lambda of, table: f"CASE {of} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"
    kind, op = f"{test}.atom.kind", f"{test}.atom.op"
    return (f"named_struct('kind', CASE WHEN {test}.negative THEN coalesce({pick(kind, _OPPOSITE)}, {kind}) ELSE {kind} END, "
            f"'op', CASE WHEN {test}.negative THEN {pick(op, _INVERSE)} ELSE {op} END, 'lo', {test}.atom.lo, 'hi', {test}.atom.hi, 'text', {test}.atom.text)")


def condition_to_sql(conditions: Column, schema: str) -> Column:
    """Query text of an ordered array of (property_id, op, lo, hi, text)."""
    lines = F.transform(conditions, lambda c, i: F.concat(
        F.lit("JOIN " + schema + ".value_table "), _alias(i), F.lit(" ON "), _alias(i), F.lit(".data_id = e.data_id")))
    tests = F.transform(conditions, lambda c, i: F.concat(
        _alias(i), F.lit(".property_id = "), c["property_id"].cast("string"), F.lit(" AND "), _test_sql(c, _alias(i))))
    return F.concat(F.lit(f"SELECT DISTINCT e.data_id FROM {schema}.entity_table e "), F.array_join(lines, " "),
                    F.lit(" WHERE "), F.array_join(tests, " AND "), F.lit(" ORDER BY e.data_id ASC"))


def _alias(i: Column) -> Column:
    return F.when(i == 0, "v").otherwise(F.concat(F.lit("v"), (i + 1).cast("string")))


def _test_sql(c: Column, alias: Column) -> Column:
    guard = F.concat(alias, F.lit(".value != '' AND "), alias, F.lit(".value IS NOT NULL AND CAST("), alias,
                     F.lit(".value AS DECIMAL(30, 15)) "))
    return (
        F.when(c["text"].isNotNull(), F.concat(alias, F.lit(".value = '"), F.replace(c["text"], F.lit("'"), F.lit("''")), F.lit("'")))
        .when(c["op"] == "BETWEEN", F.concat(guard, F.lit("BETWEEN "), plain(c["lo"]), F.lit(" AND "), plain(c["hi"])))
        .otherwise(F.concat(guard, c["op"], F.lit(" "), plain(c["lo"])))
    )


def plain(number: Column) -> Column:
    """Decimal text without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(number.cast("decimal(30,15)").cast("string"), r"0+$", ""), r"\.$", "")

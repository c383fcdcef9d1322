"""Match terms, phrases and conditions between texts and queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparsile.functions import phrases, sqltext
from sparsile.functions.numeric import near
from sparsile.operators.nulls import join_null_safe
from sparsile.sizing import local_copy, spread

# Up to this many terms are tested in the row; more go through the seed join.
INLINE_TERMS = 2_000
SEED_LENGTH = 4


def terms_in_text(texts: DataFrame, terms: DataFrame, text: str = "text", key: str | None = None,
                  max_inline: int = INLINE_TERMS) -> DataFrame:
    """Every (text row, term) where the term occurs in the text.

    A vocabulary within the checked bound is carried to the rows as a literal array, so
    texts never move.  A larger one is joined on seeds: each text gives its distinct
    pieces of up to four characters, each term its first four (or all) characters.  Only
    (key, piece) pairs are joined; the texts of matching pairs are then fetched by
    ``key`` (the first column by default) and a hash of the text, and the pair is verified on the whole text.  A null key is a key.
    """
    vocabulary = terms.select("term").filter("term != ''").distinct()
    few = vocabulary.limit(max_inline + 1).collect()
    if len(few) <= max_inline:
        listed = F.array(*[F.lit(r["term"]) for r in few]).cast("array<string>")
        return texts.select(*texts.columns, F.explode(F.filter(listed, lambda t: F.contains(F.col(text), t))).alias("term"))
    key = key or texts.columns[0]
    length = F.least(F.length("term"), F.lit(SEED_LENGTH))
    seeds = vocabulary.select("term", F.substr("term", F.lit(1), length).alias("_seed"))
    used = [r["k"] for r in vocabulary.select(length.alias("k")).distinct().collect()]  # at most SEED_LENGTH rows
    marked = texts.withColumn("_text", F.xxhash64(text))  # rows of one key may hold different texts
    pieces = [F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{k}}}))"), 1) for k in used]
    seeded = spread(marked.select(key, "_text", text)).select(key, "_text", F.explode(F.array_distinct(F.concat(*pieces)) if used else F.array().cast("array<string>")).alias("_seed"))
    few_seeds = local_copy(seeds)  # within the checked bound, pieces are dropped where they are cut
    candidates = seeded.join(seeds if few_seeds is None else F.broadcast(few_seeds), "_seed").select(key, "_text", "term").distinct()
    return join_null_safe(marked, candidates, [key, "_text"]).filter(F.contains(F.col(text), F.col("term"))).select(*texts.columns, "term")


def term_usage(terms: DataFrame, found: DataFrame) -> DataFrame:
    """Texts per term; unmatched terms show 0."""
    counts = found.groupBy("term").agg(F.count(F.lit(1)).alias("n_texts"))
    return terms.select("term").distinct().join(counts, "term", "left").select(
        "term", F.coalesce("n_texts", F.lit(0)).cast("bigint").alias("n_texts"))


def term_spans(found: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Positions (0-based start, end) of every occurrence, contained spans removed.

    Occurrences come from splitting at the term; a span lies inside a longer one
    when an earlier-starting (or equally starting, longer) span reaches its end,
    which is a running maximum over the spans of one text.
    """
    pieces = F.split(F.col(text), F.concat(F.lit(r"\Q"), F.col("term"), F.lit(r"\E")), -1)
    lengths = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), F.length)
    starts = F.aggregate(
        lengths, F.array().cast("array<int>"),
        lambda acc, n: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)) + F.length("term"), F.lit(0)) + n)))
    starts = F.when(F.size(pieces) > 1, starts).otherwise(F.array().cast("array<int>"))
    spans = found.select(*found.columns, F.explode(starts).alias("start")).withColumn("end", F.col("start") + F.length("term"))
    before = W.partitionBy(key).orderBy("start", F.desc("end")).rowsBetween(W.unboundedPreceding, -1)
    tail = F.substr(F.col(text), F.col("end") + 1)
    read = spans.withColumn("condition", phrases.tail_condition(tail)).drop(text)
    return read.withColumn("_reach", F.max("end").over(before)).filter("_reach IS NULL OR _reach < end").drop("_reach")


def text_conditions(questions: DataFrame, terms: DataFrame, key: str = "sample_id", text: str = "text",
                    title: str = "title") -> DataFrame:
    """Questions to (key, start, property_id, op, lo, hi, text).

    ``terms`` is (term, property_id, title); a row with a title overrides the
    global row of the same term for questions of that dataset.
    """
    usable = questions.select(key, title, text)
    spans = term_spans(terms_in_text(usable, terms, text, key), key, text).filter("condition IS NOT NULL")
    general = terms.filter("title IS NULL").select("term", F.col("property_id").alias("_general"))
    special = terms.filter("title IS NOT NULL").select("term", F.col("title").alias(title), F.col("property_id").alias("_special"))
    return spans.join(general, "term", "left").join(special, ["term", title], "left").select(
        key, "start", F.coalesce("_special", "_general").alias("property_id"), "condition.*").filter("property_id IS NOT NULL")


def extract_conditions(samples: DataFrame, sql: str = "sql", key: str = "sample_id") -> DataFrame:
    """Query texts to predicate rows (key, clause, alias, property_id, kind, op, lo, hi, text, anti).

    An alias with an IN list of properties has its conditions once for each.  Tests of the entity itself have the properties
    ``sqltext.TITLE`` and ``ENTITY_ID``.  Nested queries (IN, EXISTS) are aliases of their own, ``name@number``; negated ones are
    ``anti``: no value may pass all tests of such an alias.  A clause of anti aliases alone starts from all entities.  A text
    with a part that is not understood gives no rows, rather than fewer conditions; :func:`unparsed` names it."""
    read = sqltext.read_queries(samples, sql, key)
    clauses = read.select(key, "atoms", F.expr("posexplode(CASE WHEN reason IS NULL THEN clauses END)").alias("clause", "codes"))
    mark = sqltext._ANTI
    tests = clauses.select(key, "clause", F.expr(f"""transform(filter(codes, c -> get(atoms, abs(c) % {mark} - 1).kind <> 'join'), c -> named_struct(
        'alias', concat(get(atoms, abs(c) % {mark} - 1).name, CASE WHEN abs(c) >= {mark} THEN concat('!', abs(c) div {mark}) ELSE '' END),
        'anti', abs(c) >= {mark}, 'negative', c < 0, 'atom', get(atoms, abs(c) % {mark} - 1)))""").alias("tests"))
    # an alias with a property but no value test still requires the property to exist
    valued = tests.select("*", F.expr("transform(filter(tests, t -> t.atom.kind <> 'property'), t -> t.alias)").alias("valued"))
    anything = "named_struct('kind', 'any', 'op', CAST(NULL AS STRING), 'lo', CAST(NULL AS DECIMAL(30,15)), 'hi', CAST(NULL AS DECIMAL(30,15)), 'text', CAST(NULL AS STRING))"
    wanted = f"""transform(filter(tests, t -> t.atom.kind <> 'property' OR NOT array_contains(valued, t.alias)), t -> named_struct(
        'alias', t.alias, 'anti', t.anti, 'c', CASE WHEN t.atom.kind = 'property' THEN {anything} ELSE {sqltext.signed_sql('t')} END))"""
    # where everything named must not exist, the entities are what is left to choose from
    everything = f"CASE WHEN size(tests) > 0 AND forall(tests, t -> t.anti) THEN array(named_struct('alias', '#data_id', 'anti', false, 'c', {anything})) ELSE array() END"
    rows = valued.select(key, "clause", "tests", F.expr(f"explode(array_distinct(concat({wanted}, {everything})))").alias("t"))
    # several property tests of one alias hold on the same row
    lists = "transform(filter(tests, x -> x.alias = t.alias AND x.atom.property_ids IS NOT NULL), x -> x.atom.property_ids)"
    common = f"aggregate({lists}, CAST(NULL AS ARRAY<INT>), (a, x) -> CASE WHEN a IS NULL THEN x ELSE array_intersect(a, x) END)"
    return rows.select(key, "clause", F.expr("t.alias").alias("alias"), F.expr(f"explode(coalesce({common}, array({sqltext.ENTITY_ID})))").alias("property_id"), "t.c.*", F.expr("t.anti").alias("anti"))


def unparsed(samples: DataFrame, sql: str = "sql", key: str = "sample_id") -> DataFrame:
    """(key, reason) of query texts that :func:`extract_conditions` does not read in full."""
    return sqltext.read_queries(samples, sql, key).select(key, F.expr("explode(filter(array(reason), r -> r IS NOT NULL))").alias("reason"))


def match_conditions(said: DataFrame, asked: DataFrame, key: str = "sample_id") -> DataFrame:
    """Pair text conditions with query conditions of nearly equal value.

    Both sides meet on (sample, value rounded to the tolerance); the text side is
    listed under the two neighbouring cells as well, so no near pair is missed.
    """
    cell = lambda v: F.floor(v.try_cast("double") * 1000)
    left = said.withColumn("_cell", F.explode(F.array(*[cell(F.col("value")) + d for d in (-1, 0, 1)])))
    right = asked.select(key, F.col("op").alias("query_op"), F.col("lo").cast("string").alias("query_value"), cell(F.col("lo").cast("string")).alias("_cell"))
    return left.join(right, [key, "_cell"]).filter(near(F.col("value"), F.col("query_value"))).drop("_cell")


def opposite(op: Column, query_op: Column) -> Column:
    """A greater word answered with a less operator, or the reverse."""
    return (op.isin(">", ">=") & query_op.isin("<", "<=")) | (op.isin("<", "<=") & query_op.isin(">", ">="))


def lookup_ci(wanted: DataFrame, table: DataFrame, by: list[str], name: str, value: str) -> DataFrame:
    """Exact name first, else any case: (by…, name, value)."""
    t = table.select(*by, F.col(name).alias("_name"), F.col(value).alias("_value"), F.lower(name).alias("_low"))
    joined = wanted.withColumn("_low", F.lower(name)).join(t, [*by, "_low"])
    return joined.groupBy(*wanted.columns).agg(
        F.min_by("_value", F.struct((F.col("_name") != F.col(name)).alias("other"), F.col("_name"))).alias(value))


def as_predicates(found: DataFrame, key: str = "sample_id") -> DataFrame:
    """Text conditions as predicate rows, one alias per condition."""
    kind = F.when(F.col("text").isNotNull(), "str").when(F.col("op") == "BETWEEN", "between").otherwise("num")
    return found.select(key, F.lit(0).alias("clause"), F.concat(F.lit("v"), F.col("start").cast("string")).alias("alias"),
                        "property_id", kind.alias("kind"), F.when(F.col("op") != "BETWEEN", F.col("op")).alias("op"), "lo", "hi", "text")


def conditions_to_sql(found: DataFrame, schema: str, key: str = "sample_id") -> DataFrame:
    """Query text per question, conditions in text order (a question holds few)."""
    listed = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "property_id", "op", "lo", "hi", "text"))).alias("c"))
    return listed.select(key, sqltext.condition_to_sql(F.col("c"), schema).alias("sql"))

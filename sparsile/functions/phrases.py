"""Comparison phrases of natural-language questions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Operator words and the operator each stands for, negated forms first.
GREATER_WORDS = {
    "不小于": ">=", "不低于": ">=", "不少于": ">=", "大于等于": ">=",
    "大于": ">", "高于": ">", "超过": ">", "超出": ">", "高出": ">", "突破": ">",
}
LESS_WORDS = {
    "不大于": "<=", "不超过": "<=", "不高于": "<=", "小于等于": "<=",
    "小于": "<", "低于": "<", "不到": "<", "不足": "<", "少于": "<", "控制在": "<=",
}
REACH_WORDS = {"达到": ">="}
EQUAL_WORDS = {"等于": "=", "为": "=", "是": "="}
AGGREGATE_WORDS = ("最大", "最小", "平均", "最高", "最低", "总和", "统计")
CLASS_AGGREGATE_WORDS = ("平均", "最大", "最小", "统计")
CLASS_MULTI_WORDS = ("且", "同时", "并且", "以及", "都", "分别")
RANGE_WORDS = ("之间", "到")
TEN_THOUSAND = "万"

COMPARISON_WORDS = {**GREATER_WORDS, **LESS_WORDS, **REACH_WORDS}


def alternation(words) -> str:
    """Longest word first, so that a negated form is never read as its stem."""
    return "|".join(sorted(words, key=lambda w: (-len(w), w)))


def op_word_to_op(word: Column, words: dict[str, str] | None = None) -> Column:
    table = words or {**COMPARISON_WORDS, **EQUAL_WORDS}
    by_op: dict[str, list[str]] = {}
    for w, op in table.items():
        by_op.setdefault(op, []).append(w)
    out = None
    for op, ws in by_op.items():
        out = F.when(word.isin(ws), op) if out is None else out.when(word.isin(ws), op)
    return out


def has_any(text: Column, words) -> Column:
    return F.rlike(text, F.lit(alternation(words)))


def count_numbers(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\d+\.?\d*"))


def number_value(text: Column) -> Column:
    """Number text, where a trailing 万 multiplies by ten thousand."""
    base = F.regexp_replace(text, TEN_THOUSAND, "").try_cast("decimal(30,15)")
    return F.when(F.endswith(text, F.lit(TEN_THOUSAND)), (base * 10000).cast("decimal(30,15)")).otherwise(base)


def tail_condition(tail: Column) -> Column:
    """struct(op, lo, hi, text) read from what follows a term, NULL when nothing
    matches.  Ranges are tried before equality; 以上 / 以下 are exclusive."""
    num = r"(-?\d[\d.]*万?)"
    comparison = rf"^\s*({alternation(COMPARISON_WORDS)})\s*{num}"
    above, below = rf"^\s*在\s*{num}\s*以上", rf"^\s*在\s*{num}\s*以下"
    between = rf"^\s*(?:在|为|介于|处于)\s*{num}\s*(?:到|和|至|~)\s*{num}"
    equal_num = rf"^\s*(?:{alternation(EQUAL_WORDS)})\s*{num}"
    equal_text = rf"^\s*(?:{alternation(EQUAL_WORDS)})\s+([^\s一-鿿，、。]+)"
    pick = lambda pattern, g: F.regexp_extract(tail, pattern, g)
    make = lambda op, lo=None, hi=None, text=None: F.struct(
        op.cast("string").alias("op"),
        (F.lit(None) if lo is None else number_value(lo)).cast("decimal(30,15)").alias("lo"),
        (F.lit(None) if hi is None else number_value(hi)).cast("decimal(30,15)").alias("hi"),
        (F.lit(None) if text is None else text).cast("string").alias("text"))
    hit = lambda pattern: F.rlike(tail, F.lit(pattern))
    return (
        F.when(hit(comparison), make(op_word_to_op(pick(comparison, 1)), pick(comparison, 2)))
        .when(hit(above), make(F.lit(">"), pick(above, 1)))
        .when(hit(below), make(F.lit("<"), pick(below, 1)))
        .when(hit(between), make(F.lit("BETWEEN"), pick(between, 1), pick(between, 2)))
        .when(hit(equal_num), make(F.lit("="), pick(equal_num, 1)))
        .when(hit(equal_text), make(F.lit("="), text=pick(equal_text, 1)))
    )


def phrase_conditions(text: Column) -> Column:
    """array of (word, op, value) for every operator word followed by a number."""
    pattern = rf"({alternation(COMPARISON_WORDS)})\s*(\d[\d.]*)"
    words, values = (F.regexp_extract_all(text, F.lit(pattern), g) for g in (1, 2))
    return F.transform(F.arrays_zip(words.alias("word"), values.alias("value")), lambda m: F.struct(
        m["word"].alias("word"), op_word_to_op(m["word"], COMPARISON_WORDS).alias("op"), m["value"].alias("value")))

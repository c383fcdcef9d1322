"""Nested JSON documents: scan, envelope unpacking, corrupt-document split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names used inside source documents.
ARRAY_TYPE = "array<struct<_meta_id:string,title:string,data:string>>"
TEMPLATE_TYPE = ("struct<template:map<string,string>,"
                 "data:array<struct<meta:map<string,string>,content:map<string,string>>>>")
ID_KEY, UPLOADER_KEY = "数据ID", "上传人"
PATCH_LABEL = "修正后的SQL"
# white space of JSON, and a byte order mark
LEADING = "\ufeff \t\r\n"


def bare(text: Column) -> Column:
    """The document without leading blanks or byte order mark."""
    return F.ltrim(text, F.lit(LEADING))


def whole_id(raw: Column) -> Column:
    """The integer part of a numeric id; other texts have none."""
    return raw.try_cast("decimal(38,10)").cast("bigint")


def read_json_datasets(spark: SparkSession, path: str, lines: bool = False, pattern: str = "*.json") -> DataFrame:
    """(file_name, value) per document.  Whole-file mode reads one document per
    matching file (other files, such as ``.bak``, are skipped); line mode reads one document per line and splits big files."""
    reader = spark.read.format("text").option("pathGlobFilter", pattern)
    raw = reader.option("wholetext", not lines).load(path)
    return raw.select(F.col("_metadata.file_name").alias("file_name"), "value")


def split_corrupt(docs: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Readable documents of a known envelope, and the rest with a reason."""
    text = bare(F.col(value))
    known = F.json_array_length(text).isNotNull() | F.array_contains(F.json_object_keys(text), "template")
    reason = F.when(F.get_json_object(text, "$").isNull(), "unreadable").when(~F.coalesce(known, F.lit(False)), "unknown format")
    marked = docs.withColumn("reason", reason)
    return marked.filter(F.col("reason").isNull()).drop("reason"), marked.filter(F.col("reason").isNotNull())


def explode_array_envelope(docs: DataFrame, value: str = "value") -> DataFrame:
    """``[{_meta_id, title, data}]`` to one row per record that has data."""
    items = docs.filter(F.startswith(bare(F.col(value)), F.lit("["))).select(
        *[c for c in docs.columns if c != value], F.posexplode_outer(F.from_json(bare(F.col(value)), ARRAY_TYPE)).alias("pos", "item"))
    keep = [c for c in docs.columns if c != value]
    title = F.col("item.title") if "file_name" not in keep else F.coalesce("item.title", "file_name")
    return items.filter(F.col("item.data").isNotNull()).select(
        *keep, F.col("pos").cast("bigint").alias("pos"), whole_id(F.col("item._meta_id")).alias("raw_id"), title.alias("title"), F.col("item.data").alias("data"),
        F.lit(None).cast("string").alias("uploader"), F.lit(False).alias("from_template"))


def template_key(template: Column) -> Column:
    return F.element_at(F.filter(F.map_keys(template), lambda k: ~F.startswith(k, F.lit("_"))), 1)


def explode_template_envelope(docs: DataFrame, value: str = "value") -> DataFrame:
    """``{template, data:[{meta, content}]}`` to one row per content object."""
    keep = [c for c in docs.columns if c != value]
    parsed = docs.filter(F.startswith(bare(F.col(value)), F.lit("{"))).select(
        *keep, F.from_json(bare(F.col(value)), TEMPLATE_TYPE).alias("doc"))
    items = parsed.filter(F.col("doc.template").isNotNull()).select(
        *keep, template_key(F.col("doc.template")).alias("title"), F.posexplode_outer("doc.data").alias("outer_pos", "item"))
    content = F.element_at(F.col("item.content"), F.col("title"))
    listed = F.when(F.startswith(content, F.lit("[")), content).otherwise(
        F.concat(F.lit("["), content, F.lit("]")))
    texts = F.from_json(listed, "array<string>").alias("text")
    objects = F.transform(F.from_json(listed, "array<variant>"), lambda w: F.try_variant_get(w, "$", "map<string,variant>").isNotNull()).alias("is_object")
    rows = items.select(*keep, "title", "outer_pos", F.col("item.meta").alias("meta"),
                        F.posexplode_outer(F.arrays_zip(texts, objects)).alias("inner_pos", "sub"))
    return rows.filter("sub.is_object").select(
        *keep, (F.shiftleft(F.col("outer_pos").cast("bigint"), 31) + F.col("inner_pos")).alias("pos"),
        whole_id(F.element_at("meta", F.lit(ID_KEY))).alias("raw_id"), "title",
        F.col("sub.text").alias("data"), F.element_at("meta", F.lit(UPLOADER_KEY)).alias("uploader"),
        F.lit(True).alias("from_template"))


def read_patch_blocks(texts: DataFrame, column: str = "value", label: str = PATCH_LABEL) -> DataFrame:
    """``[id] … <label>: <sql>`` blocks of review files; a block ends at an empty
    line, a dashed line or the end of the text."""
    pattern = rf"\[(\d+)\][\s\S]*?{label}:\s*([\s\S]*?)(?:\n\n|\n---|\n?$(?![\s\S]))"
    ids, sqls = (F.regexp_extract_all(column, F.lit(pattern), g) for g in (1, 2))
    return texts.select(F.explode(F.arrays_zip(ids.alias("id"), sqls.alias("sql"))).alias("b")).select(
        F.col("b.id").cast("bigint").alias("sample_id"), F.trim(F.col("b.sql")).alias("sql"))

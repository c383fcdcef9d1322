"""Nested documents to the entity and value tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparsile.functions.ids import normalize_id
from sparsile.operators import leaves, numbering, shaping
from sparsile.session import durable
from sparsile.sources import json_docs


@dataclass
class Loaded:
    entities: DataFrame
    values: DataFrame


def _described(docs: DataFrame, rules: leaves.LeafRules) -> DataFrame:
    """``records_of`` with the parsed ``fields`` of each record."""
    both = json_docs.explode_array_envelope(docs).unionByName(json_docs.explode_template_envelope(docs))
    read = both.withColumn("fields", leaves.fields_of("data"))
    producer, organisation = (leaves.metadata_field(F.col("fields"), name, rules) for name in ("数据生产者", "数据生产机构"))
    return read.select(
        *[c for c in docs.columns if c != "value"], "pos", "raw_id", "from_template", "title", "data",
        F.when(F.col("from_template"), F.coalesce("uploader", F.lit(""))).otherwise(producer).alias("data_producers"),
        F.when(F.col("from_template"), F.lit("")).otherwise(organisation).alias("data_organizations"), "fields")


def records_of(docs: DataFrame, rules: leaves.LeafRules = leaves.LeafRules()) -> DataFrame:
    """Records of both envelopes with producer, organisation and raw id."""
    return _described(docs, rules).drop("fields")


def load(docs: DataFrame, order_key: str, dictionary: DataFrame, properties: DataFrame, roles: DataFrame,
         rules: leaves.LeafRules = leaves.LeafRules(), id_rule: str = "threshold", value_width: int | None = None, title_width: int | None = None) -> Loaded:
    """``docs`` is (order_key, value [, file_name]); ``order_key`` is a unique
    integer giving the load order of documents.

    Documents are read and parsed once, into one compact row per record (id, title, leaves) in the shared
    folder; id collisions are settled on its ids and joined back to it.  Records are shuffled by id while they are
    compact; each settles its own repeated fields, and the merge and the bitmaps reuse that partitioning.  Records that
    still share an id (load orders that repeat or are null) meet in the last-write aggregate.  Roles are
    looked up by the whole title; widths cut what is stored, if given.
    """
    keyed = _described(docs, rules).filter("raw_id IS NOT NULL").withColumn(
        "data_id", normalize_id(F.col("raw_id"), id_rule, F.col("from_template")))
    order = [order_key, "pos"]
    packed = durable(keyed.select(*order, "data_id", "title", "data_producers", "data_organizations",
                                  F.expr(leaves.record_leaves("`data`", rules, "fields")).alias("leaves")), "records")
    changes = durable(numbering.collision_changes(packed.select(*order, "data_id"), "data_id", order), "changes")
    joined = packed.join(changes, order, "left").withColumn("data_id", F.coalesce("new_id", "data_id"))
    records = joined.select("data_id", "title", "data_producers", "data_organizations", "leaves")
    flat = leaves.last_leaves(records.repartition("data_id"), ["data_id"], _shared_ids(packed, records, order))
    named = shaping.classify_roles(shaping.map_fields(flat, dictionary, properties, value_width), roles)
    mapped = named.withColumn("title", shaping.cut(F.col("title"), title_width))
    values = shaping.merge_values(mapped, ["data_id"])
    entities = shaping.role_bitmap(mapped, keys=["data_id", "title", "data_producers", "data_organizations"])
    return Loaded(entities, values)


def _shared_ids(packed: DataFrame, records: DataFrame, order: list[str]) -> DataFrame | None:
    """Ids that several records still hold.  Settled ids are unique unless a load order repeats or is null, so
    orders are checked first."""
    places = packed.groupBy(*order).agg(F.count(F.lit(1)).alias("_n"))
    unclear = places.filter(" OR ".join(["_n > 1", *[f"{c} IS NULL" for c in order]]))
    return None if unclear.isEmpty() else leaves.repeated_keys(records, ["data_id"])

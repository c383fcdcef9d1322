"""The three-table store: read, overwrite, upsert, snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparsile.sizing import tasks

ENTITY, PROPERTY, VALUE = "entity_table", "property_table", "value_table"


def read_eav(spark: SparkSession, path: str | None = None, jdbc: dict | None = None) -> dict[str, DataFrame]:
    """Tables by name, from parquet folders below ``path`` or over JDBC.

    ``jdbc`` holds the reader options; add ``partitionColumn``, ``lowerBound``,
    ``upperBound`` and ``numPartitions`` for a split read of the value table.
    """
    if jdbc is None:
        return {t: spark.read.parquet(f"{path}/{t}") for t in (ENTITY, PROPERTY, VALUE)}
    split = ("partitionColumn", "lowerBound", "upperBound", "numPartitions")
    plain = {k: v for k, v in jdbc.items() if k not in split}
    return {t: spark.read.format("jdbc").options(**(jdbc if t == VALUE else plain), dbtable=t).load()
            for t in (ENTITY, PROPERTY, VALUE)}


def overwrite_eav(values: DataFrame, path: str) -> None:
    """Replace the value table, one folder per property.

    Ranges of (property, id) of equal size cut a hot property into several files, however few tasks
    its rows come from, and keep rare ones together; a file's min/max ranges of ids are narrow.
    """
    (values.repartitionByRange(tasks(values.sparkSession), "property_id", "data_id").sortWithinPartitions("property_id", "data_id")
     .write.mode("overwrite").partitionBy("property_id").parquet(path))


def overwrite_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], seq: Column | str) -> DataFrame:
    """Insert, or on a key clash take the newest update.  ``seq`` orders updates
    of one key; rows of ``target`` are older than all of them.  The newest row is
    an aggregate, so a hot key is combined before the shuffle."""
    seq = F.col(seq) if isinstance(seq, str) else seq
    columns = target.columns
    rest = [c for c in columns if c not in keys]
    old = target.select(*columns, F.lit(0).alias("_gen"), F.lit(None).cast("bigint").alias("_seq"))
    new = updates.select(*columns, F.lit(1).alias("_gen"), seq.cast("bigint").alias("_seq"))
    newest = F.max_by(F.struct(*rest), F.struct("_gen", "_seq")).alias("_row")
    return old.unionByName(new).groupBy(*keys).agg(newest).select(*keys, "_row.*").select(*columns)


def snapshot(df: DataFrame, path: str, stamp: str) -> str:
    target = f"{path}/ts={stamp}"
    df.write.mode("errorifexists").parquet(target)
    return target

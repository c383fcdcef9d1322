"""Size checks that decide between broadcast and shuffle plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A control table (predicates, terms) may be broadcast up to this many rows.
BROADCAST_ROWS = 50_000
BROADCAST_BYTES = 64 << 20


def local_copy(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame | None:
    """``df`` as local rows when it has at most ``max_rows`` of them and ``max_bytes``, else None.
    Never more than ``max_rows`` + 1 rows reach the driver, and the plan behind a
    control table runs once instead of once per use."""
    table = df.limit(max_rows + 1).toArrow()
    if table.num_rows > max_rows or table.nbytes > max_bytes:
        return None
    return df.sparkSession.createDataFrame(table, schema=df.schema)


def tasks(spark: SparkSession) -> int:
    """Tasks of a stage whose rows must be spread: the shuffle partitions, four a core at least."""
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows over all tasks, by their keys if given, however few files they come from: what a task then does and keeps
    is a small part of the whole."""
    return df.repartition(tasks(df.sparkSession), *keys)


def join_control(facts: DataFrame, control: DataFrame, key: str | list[str], spread: str,
                 max_rows: int = BROADCAST_ROWS, salts: int = 64) -> DataFrame:
    """Inner join of a fact table with a control table on a possibly hot key.

    A control table within the checked bound is broadcast, so facts do not
    move.  A larger one is replicated over ``salts`` salt values, and each fact
    row takes the salt of its ``spread`` column: one hot key is then shared by
    ``salts`` tasks and every pair still meets exactly once.
    """
    small = local_copy(control, max_rows)
    if small is not None:
        return facts.join(F.broadcast(small), key)
    salted_facts = facts.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    salted_control = control.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted_facts.join(salted_control, [*([key] if isinstance(key, str) else key), "_salt"]).drop("_salt")

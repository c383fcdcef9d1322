"""JSON and CSV outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparsile.operators.numbering import dense_number

# Most ids in one output line; a longer result continues in the next chunk.
CHUNK = 4096


def pack_results(results: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(sample_id, data_id) to ordered id lists (sample_id, chunk, result).

    A result of any length is kept whole: it is cut into chunks of bounded size,
    so no task ever holds one sample's complete list.
    """
    numbered = dense_number(results, "data_id", "_n", partition_by=["sample_id"])
    chunked = numbered.withColumn("chunk", ((F.col("_n") - 1) / chunk).cast("bigint"))
    return chunked.groupBy("sample_id", "chunk").agg(F.array_sort(F.collect_list("data_id")).alias("result"))


def write_samples_json(samples: DataFrame, path: str) -> None:
    """One JSON object per line; non-ASCII text is written as is."""
    samples.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_csv_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)

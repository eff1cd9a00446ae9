"""Sinks: partitioned tables, delimited text, JSON documents, and what is still to be written.

Spark's commit protocol makes each write atomic; nothing is renamed by hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Blanks are kept, NULL and the empty string stay apart.
_TEXT = {"nullValue": "\\N", "emptyValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def write_partitioned(df: DataFrame, path: str, by: list[str], overwrite: str = "dynamic") -> None:
    """A table with a folder per value of ``by``; only the partitions in ``df`` are replaced.

    Rows are spread over tasks by the partition columns and a few lots, so that
    neither one partition is one task nor every task writes every partition.
    """
    lots = F.pmod(F.xxhash64(*[c for c in df.columns if c not in by]), F.lit(4))
    df.repartition(*by, lots).write.mode("overwrite").option("partitionOverwriteMode", overwrite).partitionBy(*by).parquet(path)


def write_text(df: DataFrame, path: str, header: bool = True) -> None:
    """Delimited text; doubles are written so that they are read back exactly."""
    df.write.mode("overwrite").option("header", header).options(**_TEXT).csv(path)


def read_text(df_schema, spark, path: str, header: bool = True) -> DataFrame:
    """What ``write_text`` wrote, with the given schema, never inferred."""
    return spark.read.schema(df_schema).option("header", header).options(**_TEXT).csv(path)


def write_documents(df: DataFrame, path: str) -> None:
    """One JSON document a line."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def read_documents(df_schema, spark, path: str) -> DataFrame:
    """What ``write_documents`` wrote, with the given schema, never inferred."""
    return spark.read.schema(df_schema).json(path)


def pending(planned: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Planned work that isn't done yet, by its keys."""
    return planned.join(done.select(*keys).distinct(), keys, "left_anti")

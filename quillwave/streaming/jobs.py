"""Structured streaming over tables that keep growing: every run takes in what is new.

The state and the offsets are kept in a checkpoint folder, so a query that is
started again goes on where the last one ended.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwave.semantics import millis, normal, prob_units
from quillwave.session import scratch_path


def source(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """The Parquet table at ``path``, a folder or a single file, as a stream."""
    schema = spark.read.parquet(path).schema
    either = f"{path[:-1]}[{path[-1]}]"  # as a pattern: the source takes a plain path for a folder
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(either)


def drain(stream: DataFrame, keys: list[str], checkpoint: str | None = None, mode: str = "update") -> DataFrame:
    """Run an aggregating stream over all that is there and return its result table.

    Each batch is put in a folder of its epoch, so that one that is repeated
    after a failure writes the same folder again.  In ``update`` mode a batch
    has the keys it changed, and the last epoch of each key counts; state older
    than the watermark is given up.  Sessions can't be updated in place, they
    need ``complete``: each batch has all of them.
    """
    spark = stream.sparkSession
    root = scratch_path(spark, "stream")

    def put(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/epoch={epoch:012d}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint or f"{root}-state").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    found = spark.read.parquet(root)
    rest = [c for c in stream.columns if c not in keys]
    if mode == "update":
        newest = found.groupBy(*keys).agg(F.max_by(F.struct(*rest), "epoch").alias("_v"))
        return newest.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in rest])
    last = found.agg(F.max("epoch").alias("e"))
    return found.join(F.broadcast(last), found["epoch"] == last["e"]).select(*keys, *rest)  # one row


def windowed_scores(predictions: DataFrame, width: str = "7 days", late: str = "30 days") -> DataFrame:
    """(run_id, week_start, n, n_usable, units): scores written in each tumbling window of time, late rows included."""
    rows = predictions.where("written_at IS NOT NULL").select("run_id", F.col("written_at").cast("timestamp").alias("at"), prob_units("prob").alias("units"))
    grouped = rows.withWatermark("at", late).groupBy("run_id", F.window("at", width).alias("w"))
    agg = grouped.agg(F.count(F.lit(1)).alias("n"), F.count("units").alias("n_usable"), F.sum("units").alias("units"))
    return agg.select("run_id", F.unix_seconds("w.start").alias("week_start"), "n", "n_usable", "units")


def positive_sessions(predictions: DataFrame, units: int, gap_ms: int) -> DataFrame:
    """(run_id, filename, start_ms, end_ms): sessions of flagged windows in signal time, merged as rows arrive."""
    rows = predictions.select("run_id", normal("filename").alias("filename"), millis("window_start_sec").alias("start_ms"), prob_units("prob").alias("units"))
    flagged = rows.where((F.col("units") >= units) & F.col("start_ms").isNotNull() & F.col("filename").isNotNull())
    session = F.session_window(F.timestamp_millis("start_ms"), f"{gap_ms + 4000} milliseconds").alias("s")
    found = flagged.groupBy("run_id", "filename", session).agg(F.count(F.lit(1)).alias("n_rows"))
    return found.select("run_id", "filename", F.unix_millis("s.start").alias("start_ms"), (F.unix_millis("s.end") - gap_ms).alias("end_ms"), "n_rows")

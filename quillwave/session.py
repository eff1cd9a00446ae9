"""Sessions, the shared scratch folder, and cutting lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "quillwave", cores: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the library expects; on a cluster, bring your own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; on a local master, one of our own where it is unset."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Copies written by this process that nobody has dropped yet.
_COPIES: set[str] = set()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    _COPIES.add(path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    _COPIES.discard(path)


def materialise(df: DataFrame, name: str, **metrics) -> DataFrame | tuple[DataFrame, dict]:
    """Write ``df`` as a table in the shared folder and read it back, which cuts its lineage.

    The copy survives the loss of any executor.  ``metrics`` are aggregates
    over what was written, read from the copy, so that neither a repeated task
    nor an input that changes can falsify them; with any, a pair of table and
    metrics is returned.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch = path
    if not metrics:
        return table
    return table, table.agg(*[c.alias(k) for k, c in metrics.items()]).first().asDict()


def superseded(table: DataFrame) -> None:
    """Delete the copy behind a table of ``materialise`` that nothing will read again."""
    path = table.__dict__.get("scratch")
    if path:
        _delete(table.sparkSession, path)


def clear_scratch(spark: SparkSession) -> int:
    """Delete all copies written so far; call it once the results that read them are written. Returns how many."""
    paths = sorted(_COPIES)
    for path in paths:
        _delete(spark, path)
    return len(paths)


def release(spark: SparkSession) -> None:
    """Let Spark drop the broadcasts and results of finished jobs, which it keeps until the driver collects its garbage; for steps of many jobs."""
    spark.sparkContext._jvm.System.gc()


def spread(df: DataFrame) -> DataFrame:
    """``df``, a table as it was read, over all cores where it is fewer files than there are cores; for steps that compute much on each row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df

"""Consolidating very many tiny files into few well-sized ones.

1. The file manifest is listed and frozen as a table, with sizes and checksums,
   and the complete lines of the files are parsed, once.
2. Recordings are bin-packed by size with first-fit decreasing.  A recording
   larger than a bin is cut by the hash of its starts into pieces that fill
   one bin each; the others are packed whole, in blocks of bounded length that
   are packed side by side (each block leaves at most one bin badly filled).
3. Every bin is rewritten by one task, into one file, sorted.  Because a
   record's bin depends on the record alone, all its versions meet there and
   only the last one is kept, with the number of versions.
4. The rewritten files are read again: the versions in them have to number the
   parsed lines, so none is lost or doubled; and the source's checksums have to
   be those of the frozen manifest still.
5. A commit file naming the data is renamed into place.  Readers follow commit
   files only, so a job that dies leaves nothing visible.
"""

from __future__ import annotations

import json
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillwave.semantics import millis, normal
from quillwave.session import materialise, scratch_path, superseded
from quillwave.sources.layouts import explode_records

#: The most recordings one task packs, the least and most text bytes in a bin, the bins wanted at least where that allows, and at most.
BLOCK_ITEMS, LEAST_BYTES, MOST_BYTES, LEAST_BINS, MOST_BINS = 100_000, 1 << 20, 256 << 20, 64, 1 << 15

RECORD = "bin int, filename string, start_ms long, label int, value double, versions int"


class CompactionError(RuntimeError):
    """Rows or checksums differ from the manifest; nothing was committed."""


def _sealed(files: DataFrame) -> DataFrame:
    """The files that belong to a recording, with a checksum of all that is used of them."""
    named = files.withColumn("filename", normal("filename")).where("filename IS NOT NULL")
    return named.withColumn("checksum", F.xxhash64("part_id", "filename", "body", "written_at", "attempt"))


def manifest(files: DataFrame) -> DataFrame:
    """part_id, checksum, filename, bytes, order of writing: what will be consolidated. Copies of a row are one file."""
    size = F.coalesce(F.octet_length("body"), F.lit(0)).cast("long").alias("bytes")
    return _sealed(files).select("part_id", "checksum", "filename", size, "written_at", "attempt").distinct()


def _records(files: DataFrame, carry: list[str]) -> DataFrame:
    """The complete lines of the bodies with their start in milliseconds."""
    return explode_records(files, "body", carry).withColumn("start_ms", millis("start_sec")).where("start_ms IS NOT NULL")


def target_bytes(total: int) -> int:
    """Text bytes in a bin: a part of the whole, so that many tasks write, within limits that keep files well-sized and bins few."""
    return max(LEAST_BYTES, min(MOST_BYTES, -(-total // LEAST_BINS)), -(-total // MOST_BINS))


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each item: descending, into the first bin with room. O(n log n)."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    width = 1
    while width < max(1, len(sizes)):
        width *= 2
    room, used, out = [capacity] * (2 * width), 0, [0] * len(sizes)  # a tree of the most room below each node
    for i in order:
        node = 1
        while node < width:
            node *= 2
            if room[node] < sizes[i]:
                node += 1
        out[i] = node - width
        room[node] -= sizes[i]
        while node > 1:
            node //= 2
            room[node] = max(room[2 * node], room[2 * node + 1])
    return out


def bins(frozen: DataFrame, target: int, block_items: int = BLOCK_ITEMS) -> tuple[DataFrame, int]:
    """((filename, pieces, bin) of each recording, number of bins); pieces have the numbers from ``bin`` on."""
    sized = frozen.groupBy("filename").agg(F.sum("bytes").alias("bytes"))
    sized = materialise(sized.withColumn("pieces", F.greatest(F.lit(1), F.ceil(F.col("bytes") / target)).cast("long")), "sizes")
    large = sized.where("pieces > 1").select("filename", "pieces", F.col("filename").alias("unit"))
    small = sized.where("pieces = 1")
    blocks = max(1, -(-small.count() // block_items))

    def pack(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["bytes", "filename"], ascending=[False, True])
        found = first_fit_decreasing([min(int(b), target) for b in block["bytes"]], target)
        # no filename has a tab, so a block's units are none of the large recordings
        names = [f"\t{n}-{b}" for n, b in zip(block["block"], found, strict=True)]
        return pd.DataFrame({"filename": block["filename"].to_numpy(), "pieces": 1, "unit": names})

    packed = (
        small.select("filename", "bytes", F.pmod(F.xxhash64("filename"), F.lit(blocks)).alias("block"))
        .groupBy("block").applyInPandas(pack, "filename string, pieces long, unit string")
    )
    units = materialise(large.unionByName(packed), "units")
    # one row per bin or large recording: their number is bounded by that of the bins
    each = units.groupBy("unit").agg(F.max("pieces").alias("width"))
    numbered = each.withColumn("bin", (F.sum("width").over(Window.orderBy("unit")) - F.col("width")).cast("int"))
    placed, seen = materialise(units.join(numbered.select("unit", "bin"), "unit").drop("unit"), "bins", n=F.max(F.col("bin") + F.col("pieces")))
    return placed, int(seen["n"] or 0)


def _rename(spark: SparkSession, source: str, target: str) -> None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.rename(path(source), path(target)):
        raise CompactionError(f"{target} can't be committed")


def _put(spark: SparkSession, target: str, text: str) -> None:
    """Write a small file under another name and rename it into place."""
    jvm = spark.sparkContext._jvm
    staged = f"{target}.{uuid.uuid4().hex}"
    path = jvm.org.apache.hadoop.fs.Path(staged)
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, False)
    out.write(bytearray(text.encode()))
    out.close()
    _rename(spark, staged, target)


def _route(lines: DataFrame, plan: DataFrame) -> DataFrame:
    """The lines with the number of their bin, by recording and, in a large one, by the hash of the start."""
    piece = F.pmod(F.xxhash64("start_ms"), F.col("pieces"))
    return lines.join(plan, "filename").withColumn("bin", (F.col("bin") + piece).cast("int")).drop("pieces")


def compact(files: DataFrame, root: str | None = None, target: int | None = None, block_items: int = BLOCK_ITEMS) -> str:
    """Consolidate ``files`` below ``root`` and return the path of the commit file.

    Each record (filename, start) is kept once, from the file written last;
    files equal in that are decided by attempt, then part_id.  Files without a
    filename belong to no recording and are left out; empty and NULL bodies
    hold no records; an empty table commits an empty consolidation.  Further
    columns are ignored.  ``target`` is the text bytes in a bin, by default
    ``target_bytes`` of the whole.
    """
    spark = files.sparkSession
    root = root or scratch_path(spark, "compacted")
    files = files.select("part_id", "filename", "body", "written_at", "attempt")
    seal = {"files": F.count(F.lit(1)), "bytes": F.sum("bytes"), "hash": F.sum(F.col("checksum").cast("decimal(38,0)"))}
    frozen, sealed = materialise(manifest(files), "manifest", **seal)
    carried = ["filename", "written_at", "attempt", "part_id"]
    lines, parsed = materialise(_records(_sealed(files), carried).drop("start_sec"), "lines", n=F.count(F.lit(1)))
    plan, n_bins = bins(frozen, target or target_bytes(sealed["bytes"] or 0), block_items)

    rows = _route(lines, plan)
    version = F.max(F.struct("written_at", "attempt", "part_id", "label", "value")).alias("v")
    # the bin's number is the number of its task, which writes one file
    kept = rows.repartitionById(max(1, n_bins), "bin").groupBy("bin", "filename", "start_ms").agg(version, F.count(F.lit(1)).cast("int").alias("versions"))
    kept = kept.select("bin", "filename", "start_ms", "v.label", "v.value", "versions")
    data = f"{root}/data-{uuid.uuid4().hex}"
    kept.sortWithinPartitions("filename", "start_ms").write.option("maxRecordsPerFile", 0).parquet(data)

    again = spark.read.schema(RECORD).parquet(data)
    parts = F.xxhash64("filename", "start_ms", "label", "value").cast("decimal(38,0)")
    wrote = again.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("versions"), F.lit(0)).alias("versions"), F.sum(parts).alias("hash")).first()
    if wrote["versions"] != parsed["n"]:
        raise CompactionError(f"{parsed['n']} lines in {sealed['files']} files, {wrote['versions']} in the rewritten ones")
    if manifest(files).agg(*[c.alias(k) for k, c in seal.items()]).first().asDict() != sealed:
        raise CompactionError(f"the files changed since the manifest: {sealed}")
    superseded(lines)
    entry = {"data": data, "files": sealed["files"], "source_checksum": str(sealed["hash"]), "bins": n_bins, "rows": wrote["n"], "checksum": str(wrote["hash"])}
    commit = f"{root}/commit-{uuid.uuid4().hex}.json"
    _put(spark, commit, json.dumps(entry))
    return commit


def committed(spark: SparkSession, commit: str) -> DataFrame:
    """The consolidated records of a commit: bin, filename, start_ms, label, value, versions."""
    entry = json.loads("".join(r.value for r in spark.read.text(commit).collect()))
    if not entry["rows"]:
        return spark.createDataFrame([], RECORD)
    return spark.read.schema(RECORD).parquet(entry["data"])

"""Records in the text layouts that small files are written in.

A body holds one record per line with the fields start, label and value:
separated by commas or semicolons below a header, or as one JSON object.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwave.semantics import finite

FIELDS = ("window_start_sec", "label", "fp1_f7__mean")
_NUMBER = r"[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?"


def _fields(line: Column) -> Column:
    """The line's three fields as strings, NULL if it has no three or breaks off."""
    start, label, value = FIELDS
    keys = F.json_object_keys(line)
    as_json = F.when(
        line.startswith("{") & line.endswith("}") & F.array_contains(keys, start) & F.array_contains(keys, label) & F.array_contains(keys, value),
        F.array(*[F.get_json_object(line, f"$.{f}") for f in FIELDS]),
    )
    parts = F.split(line, "[,;]", -1)
    as_text = F.when(F.size(parts) == 3, F.transform(parts, lambda x: F.btrim(x)))
    return F.when(line.startswith("{"), as_json).otherwise(as_text)


def explode_records(files: DataFrame, body: str, carry: list[str]) -> DataFrame:
    """One row per complete line of ``body``: ``carry`` columns, start_sec, label, value.

    Headers, blank lines and lines that break off are no records: a record has
    a numeric start, a label, and a value that is a number, empty or null.
    NULL and empty bodies have none.  A repeated line is repeated here.
    """
    lines = files.select(*carry, F.explode(F.split(F.col(body), "\r\n|\n|\r", -1)).alias("_line"))
    parsed = lines.select(*carry, _fields(F.btrim(F.col("_line"), F.lit(" \t\ufeff"))).alias("_f")).where("_f IS NOT NULL")
    start, label, value = (F.col("_f")[i] for i in range(3))
    fields = parsed.where(start.rlike(f"^{_NUMBER}$") & (F.length(label) > 0) & (value.isNull() | value.rlike(f"^({_NUMBER})?$")))
    return fields.select(
        *carry, finite(start.try_cast("double")).alias("start_sec"), label.try_cast("double").cast("int").alias("label"), F.nullif(value, F.lit("")).try_cast("double").alias("value")
    ).where("start_sec IS NOT NULL")

"""European Data Format recordings: headers and signals, by the public specification.

Files are read with Spark's ``binaryFile`` source, so any file system works.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER = "path string, labels array<string>, n_records int, record_sec double, n_samples array<int>, duration_sec double, rates array<double>, error string"
SIGNAL = "path string, channel string, rate double, samples array<double>, error string"
#: Bytes of a header before the part that each signal has, and in it.
FIXED, EACH = 256, 256
# Widths of the fields each signal has in the header, in order.
WIDTHS = [("label", 16), ("transducer", 80), ("unit", 8), ("pmin", 8), ("pmax", 8), ("dmin", 8), ("dmax", 8), ("filter", 80), ("samples", 8), ("reserved", 32)]


def _fields(data: bytes) -> dict:
    ns = int(data[252:256])
    out, at = {"records": int(data[236:244]), "record_sec": float(data[244:252]), "ns": ns, "size": int(data[184:192])}, FIXED
    for name, width in WIDTHS:
        out[name] = [data[at + i * width : at + (i + 1) * width].decode("ascii").strip() for i in range(ns)]
        at += ns * width
    return out


def parse_header(data: bytes) -> dict:
    """Labels, lengths and rates; a rate is NULL where records have no duration."""
    h = _fields(data)
    n = [int(x) for x in h["samples"]]
    rates = [x / h["record_sec"] if h["record_sec"] > 0 else None for x in n]
    return {"labels": h["label"], "n_records": h["records"], "record_sec": h["record_sec"], "n_samples": n, "duration_sec": h["records"] * h["record_sec"], "rates": rates}


def parse_signals(data: bytes) -> list[tuple[str, float | None, np.ndarray]]:
    """(label, rate, physical samples) of every signal; a last record that breaks off is dropped."""
    h = _fields(data)
    n = [int(x) for x in h["samples"]]
    raw = np.frombuffer(data[h["size"] :], "<i2")
    raw = raw[: len(raw) // max(1, sum(n)) * sum(n)].reshape(-1, max(1, sum(n)))
    out, at = [], 0
    for i in range(h["ns"]):
        dmin, dmax, pmin, pmax = (float(h[k][i]) for k in ("dmin", "dmax", "pmin", "pmax"))
        values = (raw[:, at : at + n[i]].reshape(-1) - dmin) * (pmax - pmin) / (dmax - dmin) + pmin
        out.append((h["label"][i], n[i] / h["record_sec"] if h["record_sec"] > 0 else None, values))
        at += n[i]
    return out


def encode(channels: dict[str, np.ndarray], rate: int, unit: str = "uV") -> bytes:
    """A file of records of one second; samples beyond the last whole second are dropped."""
    names, seconds = list(channels), min(len(x) for x in channels.values()) // rate
    low = [float(np.floor(x.min())) if len(x) else -1.0 for x in channels.values()]
    high = [max(float(np.ceil(x.max())), a + 1) if len(x) else 1.0 for x, a in zip(channels.values(), low, strict=True)]
    values = {"label": names, "transducer": [""] * len(names), "unit": [unit] * len(names), "pmin": [f"{v:.8g}"[:8] for v in low], "pmax": [f"{v:.8g}"[:8] for v in high], "dmin": ["-32768"] * len(names), "dmax": ["32767"] * len(names), "filter": [""] * len(names), "samples": [str(rate)] * len(names), "reserved": [""] * len(names)}
    size = FIXED + EACH * len(names)
    head = f"{'0':<8}{'':<80}{'':<80}{'01.01.00':<8}{'00.00.00':<8}{size:<8}{'':<44}{seconds:<8}{1:<8}{len(names):<4}"
    head += "".join(f"{v:<{w}}" for name, w in WIDTHS for v in values[name])
    digital = [np.clip(np.round((x[: seconds * rate] - a) / (b - a) * 65535 - 32768), -32768, 32767).astype("<i2").reshape(seconds, rate) for x, a, b in zip(channels.values(), low, high, strict=True)]
    return head.encode("ascii") + np.concatenate(digital, 1).tobytes()


def headers(files: DataFrame) -> DataFrame:
    """One row per file (path, content); a file that can't be read gives its error, and the others go on."""
    empty = {c.split()[0]: None for c in HEADER.split(", ")}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    rows.append({**empty, "path": path, **parse_header(bytes(content))})
                except (ValueError, UnicodeDecodeError, TypeError) as e:
                    rows.append({**empty, "path": path, "error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(rows, columns=list(empty))

    return files.select("path", "content").mapInPandas(run, HEADER)


def resolve(labels: list[str], wanted: list[str]) -> dict[str, str | None]:
    """The label that stands for each wanted channel: its own, or its first copy (``T8-P8-0``) where that is missing."""
    have = [x.strip().upper() for x in labels]
    return {c: next((labels[have.index(x)] for x in (c.upper(), f"{c.upper()}-0") if x in have), None) for c in wanted}


def signals(files: DataFrame, channels: list[str] | None = None, rate: float | None = None) -> DataFrame:
    """One row per file and channel, physical values; errors as in ``headers``.

    With ``channels`` only these come out, under their wanted names, and a
    missing one is a row with an error and NULL samples; with ``rate`` so is one
    sampled otherwise.  The other channels of the file go on.
    """

    def rows_of(path: str, content: bytes) -> list[tuple]:
        found = parse_signals(content)
        if channels is None:
            named = [(c, c, r, x) for c, r, x in found]
        else:
            by = {c: (r, x) for c, r, x in reversed(found)}
            named = [(c, label, *by.get(label, (None, None))) for c, label in resolve([c for c, *_ in found], channels).items()]
        out = []
        for name, label, r, x in named:
            fault = "missing channel" if label is None else f"sampled at {r}, not at {rate}" if rate is not None and r != rate else None
            out.append((path, name, r, None if fault else x.tolist(), fault))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    rows = rows_of(path, bytes(content))
                except (ValueError, UnicodeDecodeError, TypeError) as e:
                    rows = [(path, None, None, None, f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in SIGNAL.split(", ")])

    return files.select("path", "content").mapInPandas(run, SIGNAL)


def read(spark: SparkSession, path: str, pattern: str = "*.edf") -> DataFrame:
    """The files below ``path`` as (path, content), for ``headers`` and ``signals``."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select(F.col("path"), "content")

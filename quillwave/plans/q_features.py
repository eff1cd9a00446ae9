"""Window feature, signal and learning queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwave.functions import arrays as A
from quillwave.functions import contract, kernels
from quillwave.operators import learn
from quillwave.operators.records import positions
from quillwave.plans.q_catalog import FEATURES, _features
from quillwave.session import materialise, spread
from quillwave.tables import table

#: Samples in a window of the series, their nominal rate and the spectrum's segment.
LENGTH, RATE, SEGMENT = 256, 256.0, 128
#: Samples in a recording at most: over an hour at the nominal rate.
LONGEST = 1 << 20
BANDS = contract.BANDS
# Names of the first channels.
CHANNELS = ["fp1_f7", "f7_t7", "t7_p7", "p7_o1", "fp1_f3", "f3_c3", "c3_p3"]


def _x(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"))


def _rounded(df: DataFrame, key: str, columns: dict, digits: int = 6) -> DataFrame:
    return df.select(key, *[F.round(c, digits).alias(k) for k, c in columns.items()])


def feat_moments(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_x(spark, d), "vec_id", A.moments(F.col("x")))


def feat_linear(spark: SparkSession, d: str) -> DataFrame:
    """Sign changes, sign ratio, mean absolute value and line length."""
    x = F.col("x")
    return _x(spark, d).select("vec_id", A.sign_changes(x).alias("zero_crossings"), F.round(A.positive_ratio(x), 6).alias("sign_ratio"), F.round(A.mean_absolute(x), 6).alias("mean_abs"), F.round(A.line_length(x), 6).alias("line_length"))


def feat_entropy_exact(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("x")
    return _rounded(_x(spark, d), "vec_id", {"shannon": A.shannon(F.transform(x, lambda v: F.round(v, 1))), "renyi": A.renyi(F.transform(x, lambda v: 3 * v))})


def feat_hjorth(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("x")
    return _rounded(_x(spark, d), "vec_id", {"mobility": A.mobility(x), "complexity": A.complexity(x)})


def feat_fractal(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("x")
    return _rounded(_x(spark, d), "vec_id", {"petrosian": A.petrosian(x), "katz": A.katz(x), "fisher": A.fisher(x)})


def feat_entropy_pairs(spark: SparkSession, d: str) -> DataFrame:
    e = spread(_x(spark, d)).select("vec_id", kernels.entropies(F.col("x")).alias("e"))
    return _rounded(e, "vec_id", {n: F.get("e", i) for i, n in enumerate(["approximate", "fuzzy", "distribution", "permutation", "singular_value"])})


def feat_entropy_profile(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of the sample entropy profile, the optional features."""
    e = spread(_x(spark, d)).select("vec_id", kernels.profiles(F.col("x")).alias("e"))
    names = ["total", "average", "maximum", "minimum", "median", "standardDeviation", "variance", "kurtosis", "skewness"]
    return _rounded(e, "vec_id", {n: F.get("e", i) for i, n in enumerate(names)})


def feat_complexity(spark: SparkSession, d: str) -> DataFrame:
    scaled = F.transform("x", lambda v: F.round(v * 100))
    e = spread(_x(spark, d)).select("vec_id", kernels.complexities(scaled).alias("e"))
    return _rounded(e, "vec_id", {n: F.get("e", i) for i, n in enumerate(["phrases", "higuchi", "fluctuation"])})


def _samples(spark: SparkSession, d: str, keys: dict[str, Column]) -> DataFrame:
    """(keys, pos, v): prices in line order, numbered within each key; no key is a task."""
    rows = table(spark, d, "lineitem").select(*[c.alias(k) for k, c in keys.items()], "l_orderkey", "l_linenumber", (F.col("l_extendedprice").cast("double") / 100).alias("v"))
    return positions(rows, list(keys), ["l_orderkey", "l_linenumber", "v"], F.floor(F.col("l_orderkey") / 65_536)).drop("l_orderkey", "l_linenumber")


def _cut(samples: DataFrame, keys: list[str], length: int) -> DataFrame:
    """(keys, i, x): stretches of ``length`` samples, the last one of a key may be shorter."""
    stretch = samples.groupBy(*keys, F.floor(F.col("pos") / length).cast("int").alias("i"))
    return stretch.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda p: p["v"]).alias("x"))


def whole_series(spark: SparkSession, d: str) -> DataFrame:
    """(file, part, s): each supplier's prices in line order as a recording; one longer than ``LONGEST`` is several."""
    return _cut(_samples(spark, d, {"file": F.col("l_suppkey")}), ["file"], LONGEST).withColumnsRenamed({"i": "part", "x": "s"})


def series_windows(spark: SparkSession, d: str) -> DataFrame:
    """(file, start, x): the series cut into whole windows."""
    cut = _cut(_samples(spark, d, {"file": F.col("l_suppkey")}), ["file"], LENGTH).where(F.size("x") == LENGTH)
    return cut.select("file", (F.col("i") * LENGTH).alias("start"), "x")


def channel_windows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """((recording, i, channel) that there should be, (recording, i, channel, x) that there are): windows of recordings with channels by line number.

    A recording is a group of suppliers with four channels; those with fewer samples lack the later windows, and three are missing altogether.
    """
    keys = {"recording": F.floor(F.col("l_suppkey") / 20).cast("int"), "line": (F.pmod(F.col("l_linenumber") - 1, F.lit(4)) + 1).cast("int")}
    rows = table(spark, d, "lineitem").select(*[c.alias(k) for k, c in keys.items()], "l_orderkey", (F.col("l_extendedprice").cast("double") / 100 - 300).alias("v"))
    samples = positions(rows, list(keys), ["l_orderkey", "v"], F.floor(F.col("l_orderkey") / 65_536))
    name = F.element_at(F.array(*[F.lit(c) for c in CHANNELS]), F.col("line"))
    cut = _cut(samples, list(keys), contract.WINDOW).where(F.size("x") == contract.WINDOW)
    there = materialise(cut.select("recording", "i", name.alias("channel"), "x"), "windows")
    every = there.select("recording", "i").distinct().withColumn("channel", F.explode(F.array(*[F.lit(c) for c in CHANNELS])))
    return every, there


def feature_contract(spark: SparkSession, d: str) -> DataFrame:
    """All 89 features of every channel's window, by name; NULL where the channel is missing."""
    every, there = channel_windows(spark, d)
    found = contract.with_features(spread(there), "x")
    return every.join(found, ["recording", "i", "channel"], "left").select("recording", "i", "channel", *[F.round(c, 6).alias(c) for c in contract.names()])


def feature_wide(spark: SparkSession, d: str) -> DataFrame:
    """One record per window with a column for each channel and statistic, NULL where the channel is missing."""
    x = F.col("x")
    values = {"maximum": F.array_max(x), "minimum": F.array_min(x), "mean": A.mean(x), "meanAbsoluteValue": A.mean_absolute(x), "numberOfZeroCrossing": A.sign_changes(x)}
    long = channel_windows(spark, d)[1].select("recording", "i", "channel", *[F.round(c, 6).alias(k) for k, c in values.items()])
    return contract.wide(long, ["recording", "i"], "channel", CHANNELS, list(values))


def feat_spectrum(spark: SparkSession, d: str) -> DataFrame:
    """Statistics and power of the spectrum and of its bands."""
    p = series_windows(spark, d).select("file", "start", kernels.power_density(F.col("x"), RATE, SEGMENT).alias("p"))
    step = RATE / SEGMENT
    out = {f"fd_{k}": c for k, c in A.moments(F.col("p")).items()} | {"fd_entropy": A.spectral_entropy(F.col("p"))}
    for name, (low, high) in BANDS.items():
        part = A.band(F.col("p"), low, high, step)
        out |= {f"fd_mean_{name}": A.mean(part), f"fd_maximum_{name}": F.array_max(part), f"fd_power_{name}": A.integral(part, int(-(-high // step)) - int(-(-low // step)), step)}
    return p.select("file", "start", *[F.round(c, 6).alias(k) for k, c in out.items()])


def feat_crossings(spark: SparkSession, d: str) -> DataFrame:
    """Sign changes of the centred series after line simplification at growing tolerances."""
    w = series_windows(spark, d)
    c = w.select("file", "start", kernels.crossings(F.col("x"), (16.0, 32.0, 64.0, 128.0, 256.0)).alias("c"))
    return c.select("file", "start", *[F.get("c", i).cast("int").alias(f"azc_{t}") for i, t in enumerate((16, 32, 64, 128, 256))])


def filtered_series(spark: SparkSession, d: str) -> DataFrame:
    """Power of each window before and after zero-phase band-pass and notch of its whole series; the last window may be short."""
    import pandas as pd

    def run(batches):
        import numpy as np

        from quillwave.functions.signal import bandpass_sections, notch_section, zero_phase

        sections = np.concatenate([bandpass_sections(0.5, 40.0, RATE), notch_section(60.0, 30.0, RATE)])
        for b in batches:
            rows = []
            for file, part, s in zip(b["file"], b["part"], b["s"], strict=True):
                x = np.asarray(s, float)
                y = zero_phase(sections, x)
                for i in range(0, len(x), LENGTH):
                    p, q = x[i : i + LENGTH], y[i : i + LENGTH]
                    rows.append((file, part * LONGEST + i, len(p), float(p.var()), float(q.var()), float(q.mean())))
            yield pd.DataFrame(rows, columns=["file", "start", "n_samples", "before", "after", "mean_after"])

    out = whole_series(spark, d).mapInPandas(run, "file long, start long, n_samples int, before double, after double, mean_after double")
    return out.select("file", "start", "n_samples", *[F.round(c, 6).alias(c) for c in ("before", "after", "mean_after")])


def edf_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Each whole series written as a recording and read back: header, and the worst error in digital steps.

    The last record is filled up with the last sample.
    """
    import pandas as pd

    from quillwave.sources import edf

    def write(batches):
        import numpy as np

        for b in batches:
            full = [np.pad(np.asarray(s, float), (0, -len(s) % 64), "edge") for s in b["s"]]
            yield pd.DataFrame({"path": [f"{f}-{i}.edf" if i else f"{f}.edf" for f, i in zip(b["file"], b["part"], strict=True)], "content": [edf.encode({"FP1-F7": x, "F7-T7": -x}, 64) for x in full], "x": b["s"]})

    # encoded once: headers, samples and the comparison read the same files
    files = materialise(whole_series(spark, d).mapInPandas(write, "path string, content binary, x array<double>"), "recordings")
    heads = edf.headers(files).select("path", F.array_join("labels", ";").alias("labels"), "duration_sec", F.get("rates", 0).alias("rate"))
    samples = edf.signals(files).where("channel = 'FP1-F7'").select("path", F.col("samples").alias("_s"))
    back = files.join(samples, "path").withColumn("samples", F.slice("_s", F.lit(1), F.size("x")))
    error = F.array_max(F.zip_with("x", "samples", lambda a, b: F.abs(a - b)))
    exact = (F.size("samples") == F.size("x")) & (error <= (F.array_max("x") - F.array_min("x") + 2) / 65535)
    return heads.join(back.select("path", F.size("x").alias("n_samples"), exact.alias("exact")), "path")


def rf_channel_rank(spark: SparkSession, d: str) -> DataFrame:
    """Channels by the summed importances of a random forest."""
    return learn.channel_ranks(_features(spark, d), FEATURES, "label")


def model_scores(spark: SparkSession, d: str) -> DataFrame:
    """Held-out area under the curve of the three learners, subjects split by fold."""
    return learn.held_out_auc(_features(spark, d).where("subject IS NOT NULL"), FEATURES, "label", "subject")


QUERIES = {q.__name__: q for q in (feat_moments, feat_linear, feat_entropy_exact, feat_hjorth, feat_fractal, feat_entropy_pairs, feat_entropy_profile, feat_complexity, feat_spectrum, feat_crossings, feature_contract, feature_wide, filtered_series, edf_roundtrip, rf_channel_rank, model_scores)}

_X = "x AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings)"
_D = "d AS (SELECT vec_id, x, list_transform(range(2, len(x) + 1), lambda i: x[i] - x[i - 1]) AS d FROM x), e AS (SELECT *, list_transform(range(2, len(d) + 1), lambda i: d[i] - d[i - 1]) AS e FROM d)"
_CHANNEL_VALUES = {"maximum": "max(v)", "minimum": "min(v)", "mean": "round(avg(v), 6)", "meanAbsoluteValue": "round(avg(abs(v)), 6)", "numberOfZeroCrossing": "CAST(count(*) FILTER (c) AS INTEGER)"}
SQL = {
    "feature_wide": f"""WITH p AS (
  SELECT l_suppkey // 20 AS recording, (l_linenumber - 1) % 4 + 1 AS line, row_number() OVER (PARTITION BY l_suppkey // 20, (l_linenumber - 1) % 4 ORDER BY l_orderkey, l_extendedprice) - 1 AS pos, CAST(l_extendedprice AS DOUBLE) / 100 - 300 AS v FROM lineitem),
w AS (SELECT *, pos // 1024 AS i, (v < 0) <> lag(v < 0) OVER (PARTITION BY recording, line, pos // 1024 ORDER BY pos) AS c FROM p),
s AS (SELECT recording, line, CAST(i AS INTEGER) AS i, {", ".join(f'{e} AS "{k}"' for k, e in _CHANNEL_VALUES.items())} FROM w GROUP BY recording, line, i HAVING count(*) = 1024)
SELECT CAST(recording AS INTEGER) AS recording, i, {", ".join(f'round(max("{v}") FILTER (line = {n + 1}), 6) AS "{c}__{v}"' if v in ("maximum", "minimum") else f'max("{v}") FILTER (line = {n + 1}) AS "{c}__{v}"' for n, c in enumerate(CHANNELS) for v in _CHANNEL_VALUES)} FROM s GROUP BY recording, i""",
    "feat_moments": f"""WITH {_X}, m AS (SELECT vec_id, x, list_avg(x) AS m, list_var_pop(x) AS v FROM x)
SELECT vec_id, round(list_max(x), 6) AS maximum, round(list_min(x), 6) AS minimum, round(m, 6) AS mean, round(list_median(x), 6) AS median, round(sqrt(v), 6) AS "standardDeviation", round(v, 6) AS variance,
  round(list_kurtosis_pop(x), 6) AS kurtosis, round(list_avg(list_transform(x, lambda a: (a - m) ** 3)) / v ** 1.5, 6) AS skewness FROM m""",
    "feat_linear": f"""WITH {_X}, {_D} SELECT vec_id, CAST(len(list_filter(range(2, len(x) + 1), lambda i: (x[i] < 0) <> (x[i - 1] < 0))) AS INTEGER) AS zero_crossings,
  round(len(list_filter(x, lambda v: v >= 0)) / nullif(len(list_filter(x, lambda v: v < 0)), 0), 6) AS sign_ratio, round(list_avg(list_transform(x, lambda v: abs(v))), 6) AS mean_abs,
  round(list_sum(list_transform(d, lambda v: abs(v))), 6) AS line_length FROM e""",
    "feat_entropy_exact": f"""WITH {_X}, c AS (SELECT vec_id, round(v, 1) AS r, count(*) AS c FROM (SELECT vec_id, unnest(x) AS v FROM x) GROUP BY ALL),
s AS (SELECT vec_id, sum(-c / n * log2(c / n)) AS shannon FROM (SELECT *, sum(c) OVER (PARTITION BY vec_id) AS n FROM c) GROUP BY vec_id)
SELECT vec_id, round(shannon, 6) AS shannon, round(-log2(list_sum(list_transform(x, lambda v: v * v * 9))), 6) AS renyi FROM x JOIN s USING (vec_id)""",
    "feat_hjorth": f"""WITH {_X}, {_D}, v AS (SELECT vec_id, list_var_pop(x) AS a, list_var_pop(d) AS b, list_var_pop(e) AS c FROM e)
SELECT vec_id, round(sqrt(b / a), 6) AS mobility, round(sqrt(c / b) / sqrt(b / a), 6) AS complexity FROM v""",
    "feat_fractal": f"""WITH {_X}, {_D}, g AS (SELECT vec_id, x, d, len(x) AS n, len(list_filter(range(2, len(d) + 1), lambda i: (d[i] < 0) <> (d[i - 1] < 0))) AS nd, list_sum(list_transform(d, lambda v: abs(v))) AS l,
  list_max(list_transform(x, lambda v: abs(v - x[1]))) AS far, list_sum(list_transform(range(1, len(x)), lambda i: x[i] * x[i])) AS aa, list_sum(list_transform(range(2, len(x) + 1), lambda i: x[i] * x[i])) AS bb,
  list_sum(list_transform(range(1, len(x)), lambda i: x[i] * x[i + 1])) AS ab FROM e),
s AS (SELECT *, sqrt((aa + bb) / 2 + sqrt(greatest(((aa + bb) / 2) ** 2 - (aa * bb - ab * ab), 0))) AS s1, sqrt(greatest((aa + bb) / 2 - sqrt(greatest(((aa + bb) / 2) ** 2 - (aa * bb - ab * ab), 0)), 0)) AS s2 FROM g)
SELECT vec_id, round(log10(n) / (log10(n) + log10(n / (n + 0.4 * nd))), 6) AS petrosian, round(log10(n - 1) / (log10(n - 1) + log10(far / l)), 6) AS katz,
  round(-(s1 / (s1 + s2)) * ln(s1 / (s1 + s2)) - (s2 / (s1 + s2)) * ln(s2 / (s1 + s2)), 6) AS fisher FROM s""",
}

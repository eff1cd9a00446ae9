"""The features of one channel's window, by their contractual names and in their order.

Statistics, shapes and everything taken of a spectrum are column expressions;
pairwise entropies, complexities, spectra and simplification come from the
kernels.  A NULL window, as of a channel that a recording lacks, gives NULL for
every feature, also for the constant ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwave.functions import arrays as A
from quillwave.functions import kernels

#: Samples in a window, their rate, and samples in a segment of the spectrum.
WINDOW, RATE, SEGMENT = 1024, 256.0, 512
# The frequency bands, in Hz, and the tolerances of line simplification.
BANDS = {"alpha": (8, 13), "beta": (13, 30), "delta": (1, 4), "theta": (4, 8), "other": (30, 128)}
TOLERANCES = (0, 16, 32, 64, 128, 256)
# The names of the statistics, and of what describes the shape of a window.
STATISTICS = ("maximum", "minimum", "mean", "median", "standardDeviation", "variance", "kurtosis", "skewness")
SHAPES = (
    "numberOfZeroCrossing", "positiveToNegativeSampleRatio", "positiveToNegativePeakRatio", "meanAbsoluteValue", "approximateEntropy", "sampleEntropy", "permutationEntropy",
    "singularValueDecompositionEntropy", "fuzzyEntropy", "distributionEntropy", "shannonEntropy", "renyiEntropy", "lempelZivComplexity", "hjorthMobility", "hjorthComplexity",
    "fisherInfo", "petrosianFd", "katzFd", "higuchiFd", "detrendedFluctuation",
)


def names() -> list[str]:
    """All feature names in order."""
    bands = [f"fd_{k}_{b}" for b in BANDS for k in (*STATISTICS, "bandPower")]
    return [*STATISTICS, *SHAPES, *(f"fd_{k}" for k in STATISTICS), *bands, "fd_bandPower", "spectralEntropy", *(f"azc_{t}" for t in TOLERANCES)]


def with_features(windows: DataFrame, x: str) -> DataFrame:
    """``windows`` with a column for each feature of the array of samples ``x``, which goes."""
    w, step = F.col(x), RATE / SEGMENT
    sampled = windows.withColumn("_e", kernels.entropies(w)).withColumn("_c", kernels.complexities(w)).withColumn("_p", kernels.power_density(w, RATE, SEGMENT)).withColumn("_z", kernels.crossings(w, TOLERANCES))
    e, c, p = F.col("_e"), F.col("_c"), F.col("_p")
    shape = {
        "numberOfZeroCrossing": A.sign_changes(w), "positiveToNegativeSampleRatio": A.positive_ratio(w),
        # constant by the contract: peaks aren't counted, and windows are too short for sample entropy
        "positiveToNegativePeakRatio": F.lit(1.0), "sampleEntropy": F.lit(0.0),
        "meanAbsoluteValue": A.mean_absolute(w), "approximateEntropy": F.get(e, 0), "fuzzyEntropy": F.get(e, 1), "distributionEntropy": F.get(e, 2), "permutationEntropy": F.get(e, 3),
        "singularValueDecompositionEntropy": F.get(e, 4), "shannonEntropy": F.get(e, 5), "renyiEntropy": A.renyi(w), "lempelZivComplexity": F.get(c, 0), "hjorthMobility": A.mobility(w), "hjorthComplexity": A.complexity(w),
        "fisherInfo": A.fisher(w), "petrosianFd": A.petrosian(w), "katzFd": A.katz(w), "higuchiFd": F.get(c, 1), "detrendedFluctuation": F.get(c, 2),
    }
    out: dict[str, Column] = {**A.moments(w), **shape, **{f"fd_{k}": v for k, v in A.moments(p).items()}}
    for name, (low, high) in BANDS.items():
        part = A.band(p, low, high, step)
        # the bands reach up to, not into, their upper edge
        size = int(-(-high // step)) - int(-(-low // step))
        out |= {f"fd_{k}_{name}": v for k, v in A.moments(part).items()} | {f"fd_bandPower_{name}": A.integral(part, size, step)}
    out |= {"fd_bandPower": A.integral(p, SEGMENT // 2 + 1, step), "spectralEntropy": A.spectral_entropy(p)}
    out |= {f"azc_{t}": F.get("_z", i) for i, t in enumerate(TOLERANCES)}
    return sampled.select("*", *[F.when(w.isNotNull(), out[k].cast("double")).alias(k) for k in names()]).drop("_e", "_c", "_p", "_z", x)


def wide(features: DataFrame, keys: list[str], channel: str, channels: list[str], values: list[str]) -> DataFrame:
    """One row per window: a column ``{channel}__{feature}`` for every listed channel and value, NULL where the channel is missing."""
    picked = features.groupBy(*keys).pivot(channel, channels).agg(F.first(F.struct(*values)))
    return picked.select(*keys, *[F.col(f"`{c}`.{v}").alias(f"{c}__{v}") for c in channels for v in values])

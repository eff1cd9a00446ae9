"""Features of a window as column expressions over an array of doubles.

All stay in the JVM.  Undefined is NULL: no samples, zero variance, no
denominator, or a result that isn't finite.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillwave.semantics import finite, ratio


def total(x: Column, f=lambda v: v) -> Column:
    """Sum of f over the array, 0 if it is empty."""
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + f(v))


def mean(x: Column) -> Column:
    return ratio(total(x), F.size(x))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, not for every element a lambda in the body visits."""
    return F.get(F.transform(F.array(value), body), 0)


def central(x: Column, k: int) -> Column:
    """The k-th central moment of the population."""
    power = lambda d: d * d if k == 2 else F.pow(d, F.lit(float(k)))
    return let(mean(x), lambda m: ratio(total(x, lambda v: power(v - m)), F.size(x)))


def variance(x: Column) -> Column:
    return central(x, 2)


def deviation(x: Column) -> Column:
    return F.sqrt(variance(x))


def kurtosis(x: Column) -> Column:
    """Excess, of the population."""
    return finite(ratio(central(x, 4), variance(x) * variance(x)) - 3)


def skewness(x: Column) -> Column:
    return finite(ratio(central(x, 3), F.pow(variance(x), F.lit(1.5))))


def median(x: Column) -> Column:
    n = F.size(x)
    return let(F.array_sort(x), lambda s: (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)


def moments(x: Column) -> dict[str, Column]:
    """The eight statistics that are also taken of spectra."""
    return {
        "maximum": F.array_max(x), "minimum": F.array_min(x), "mean": mean(x), "median": median(x),
        "standardDeviation": deviation(x), "variance": variance(x), "kurtosis": kurtosis(x), "skewness": skewness(x),
    }


def differences(x: Column) -> Column:
    """x[i + 1] - x[i]; empty for fewer than two samples."""
    n = F.size(x)
    return F.when(n > 1, F.zip_with(F.slice(x, F.lit(2), F.greatest(n - 1, F.lit(1))), F.slice(x, F.lit(1), F.greatest(n - 1, F.lit(1))), lambda b, a: b - a)).otherwise(F.array().cast("array<double>"))


def sign_changes(x: Column) -> Column:
    """Neighbours of which one is below 0 and the other isn't."""
    below = F.transform(x, lambda v: F.when(v < 0, 1.0).otherwise(0.0))
    return total(differences(below), F.abs).cast("int")


def positive_ratio(x: Column) -> Column:
    """Samples at or above 0 to samples below."""
    return ratio(F.size(F.filter(x, lambda v: v >= 0)), F.size(F.filter(x, lambda v: v < 0)))


def mean_absolute(x: Column) -> Column:
    return ratio(total(x, F.abs), F.size(x))


def line_length(x: Column) -> Column:
    return total(differences(x), F.abs)


def renyi(x: Column) -> Column:
    """-log2 of the sum of squares."""
    return finite(-F.try_divide(F.ln(total(x, lambda v: v * v)), F.lit(0.6931471805599453)))


def shannon(x: Column) -> Column:
    """Entropy in bits of the frequencies of exact values."""
    n = F.size(x)
    counts = F.transform(F.array_distinct(x), lambda v: F.size(F.filter(x, lambda w: w == v)).cast("double"))
    return total(counts, lambda c: -c / n * F.log2(c / n))


def mobility(x: Column) -> Column:
    return let(differences(x), lambda d: F.sqrt(ratio(variance(d), variance(x))))


def complexity(x: Column) -> Column:
    return let(differences(x), lambda d: ratio(mobility(d), mobility(x)))


def fisher(x: Column) -> Column:
    """-sum w ln w over the normalised singular values of the embedding with delay 1 and dimension 2."""
    n = F.size(x)
    a, b = F.slice(x, F.lit(1), F.greatest(n - 1, F.lit(1))), F.slice(x, F.lit(2), F.greatest(n - 1, F.lit(1)))
    aa, bb, ab = total(a, lambda v: v * v), total(b, lambda v: v * v), F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    half, det = (aa + bb) / 2, aa * bb - ab * ab
    root = F.sqrt(F.greatest(half * half - det, F.lit(0.0)))
    s1, s2 = F.sqrt(half + root), F.sqrt(F.greatest(half - root, F.lit(0.0)))
    term = lambda w: F.when(w > 0, -w * F.ln(w)).otherwise(0.0)
    return F.when(n > 1, term(ratio(s1, s1 + s2)) + term(ratio(s2, s1 + s2)))


def petrosian(x: Column) -> Column:
    n, d = F.size(x).cast("double"), sign_changes(differences(x))
    return F.log10(n) / (F.log10(n) + F.log10(n / (n + 0.4 * d)))


def katz(x: Column) -> Column:
    """log n / (log n + log(d / L)), with L the line length, n = L / mean step, d the farthest from the first sample."""
    steps = F.size(x) - 1
    far = F.array_max(F.transform(x, lambda v: F.abs(v - F.get(x, 0))))
    n = F.log10(steps.cast("double"))
    return F.when(line_length(x) > 0, ratio(n, n + F.log10(ratio(far, line_length(x)))))


def spectral_entropy(psd: Column) -> Column:
    return let(total(psd), lambda s: F.when(s > 0, total(F.filter(psd, lambda v: v > 0), lambda v: -v / s * F.log2(v / s))))


def band(psd: Column, low: float, high: float, resolution: float) -> Column:
    """The bins of a spectrum whose frequency is in [low, high)."""
    first, end = int(-(-low // resolution)), int(-(-high // resolution))
    return F.slice(psd, first + 1, end - first)


def integral(y: Column, size: int, step: float) -> Column:
    """Simpson's rule over an array of ``size`` values, as the sum of the values by their weights."""
    import numpy as np

    from quillwave.functions.kernels import simpson

    weights = F.array(*[F.lit(simpson(unit, step)) for unit in np.eye(size)])
    return F.when(F.size(y) == size, F.aggregate(F.zip_with(y, weights, lambda v, w: v * w), F.lit(0.0), lambda s, v: s + v))

"""Statistics of time series kept as dense arrays, one value a bin, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, places: int) -> Column:
    """x times a power of ten to the nearest whole number, halves away from zero, over that power.

    Spark's round goes by the shortest decimal that stands for x, which makes halves of numbers that lie beside one.
    """
    scaled = x * F.lit(10.0**places)
    near = F.rint(scaled)
    return F.when(F.abs(scaled - near) == 0.5, scaled + 0.5 * F.signum(scaled)).otherwise(near) / F.lit(10.0**places)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda x, y: x + y)


def dense(entries: Column, bins: int) -> Column:
    """array<struct(bin, x)> -> array<double> of all bins, 0 where there is none."""
    each = F.sequence(F.lit(0), F.lit(bins - 1))
    # an array of one map, so that the map is built once instead of for each bin
    return F.get(F.transform(F.array(F.map_from_entries(entries)), lambda by_bin: F.transform(each, lambda b: F.coalesce(F.try_element_at(by_bin, b), F.lit(0.0)))), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def mean(a: Column) -> Column:
    return total(a) / F.size(a)


def normalise(a: Column, sum_: Column) -> Column:
    return F.transform(a, lambda x: F.when(sum_ != 0, x / sum_).otherwise(0.0))


def _spread(a: Column) -> Column:
    return dot(a, a) - total(a) * total(a) / F.size(a)


def acf(a: Column, k: int) -> Column:
    """Autocorrelation at lag k; 0 for a constant series."""
    n, m = F.size(a), mean(a)
    head, tail = F.slice(a, F.lit(1), F.greatest(n - k, F.lit(0))), F.slice(a, F.lit(1 + k), F.greatest(n - k, F.lit(0)))
    top = dot(head, tail) - m * (total(head) + total(tail)) + (n - k) * m * m
    return F.when(_spread(a) > 1e-12, top / _spread(a)).otherwise(0.0)


def pacf2(a: Column) -> Column:
    r1, r2 = acf(a, 1), acf(a, 2)
    return F.when(F.abs(1 - r1 * r1) > 1e-12, (r2 - r1 * r1) / (1 - r1 * r1)).otherwise(0.0)


def ccf(a: Column, b: Column, k: int = 0) -> Column:
    """Cross-correlation of a with b shifted by k; at lag 0 Pearson's."""
    n = F.size(a)
    head, tail = F.slice(a, F.lit(1), F.greatest(n - k, F.lit(0))), F.slice(b, F.lit(1 + k), F.greatest(n - k, F.lit(0)))
    ma, mb = mean(a), mean(b)
    top = dot(head, tail) - mb * total(head) - ma * total(tail) + (n - k) * ma * mb
    return F.when((_spread(a) > 1e-12) & (_spread(b) > 1e-12), top / F.sqrt(_spread(a) * _spread(b))).otherwise(0.0)


def sma(a: Column, n: int) -> Column:
    """Trailing moving average; the first n - 1 values are 0."""
    return F.transform(a, lambda _, i: F.when(i >= n - 1, total(F.slice(a, F.greatest(i - n + 2, F.lit(1)), F.lit(n))) / n).otherwise(0.0))


def centred_average(a: Column, window: int) -> Column:
    """x[t], plus for i < window x[t-i] if t > i and x[t+i] if t + i < size, over window + 1."""
    n = F.size(a)

    def at(t: Column) -> Column:
        out = F.get(a, t)
        for i in range(window):
            out = out + F.when(t > i, F.get(a, t - i)).otherwise(0.0) + F.when(t < n - i, F.get(a, t + i)).otherwise(0.0)
        return out / (window + 1)

    return F.transform(F.sequence(F.lit(0), n - 1), at)


def entropy(p: Column) -> Column:
    return total(F.transform(p, lambda x: F.when(x > 0, -x * F.ln(x)).otherwise(0.0)))


def kl(p: Column, q: Column) -> Column:
    """Over bins where both are positive."""
    return total(F.zip_with(p, q, lambda x, y: F.when((x > 0) & (y > 0), x * F.ln(x / y)).otherwise(0.0)))


def share_positive(a: Column) -> Column:
    return total(F.transform(a, lambda x: F.when(x > 0, 1.0).otherwise(0.0))) / F.size(a)


def spectrum(a: Column) -> Column:
    """Periodogram at the frequencies k / n, k = 1 to n div 2: 2 |F|^2 / n, half at the Nyquist frequency; rounded, so that equal peaks tie."""
    n = F.size(a)
    at = F.sequence(F.lit(0), n - 1)

    def power(k: Column) -> Column:
        def part(f) -> Column:
            return total(F.zip_with(a, at, lambda x, i: x * f(2 * F.pi() * k * i / n)))

        half = F.when(2 * k == n, 0.5).otherwise(1.0)
        return rounded(half * 2 * (F.pow(part(F.cos), F.lit(2)) + F.pow(part(F.sin), F.lit(2))) / n, 9)

    return F.transform(F.sequence(F.lit(1), (n / 2).cast("int")), power)


def peak(spec: Column) -> Column:
    return F.array_max(spec)


def period(a: Column, spec: Column) -> Column:
    """Bins of one cycle at the first highest peak."""
    return F.size(a) / F.array_position(spec, F.array_max(spec)).cast("double")


def moment(a: Column, m: Column, k: int) -> Column:
    return total(F.transform(a, lambda x: F.pow(x - m, F.lit(k)))) / F.size(a)


def skewness(a: Column, m: Column) -> Column:
    return F.when(moment(a, m, 2) > 1e-12, moment(a, m, 3) / F.pow(moment(a, m, 2), F.lit(1.5))).otherwise(0.0)


def kurtosis(a: Column, m: Column) -> Column:
    return F.when(moment(a, m, 2) > 1e-12, moment(a, m, 4) / F.pow(moment(a, m, 2), F.lit(2))).otherwise(0.0)


def mutual_information(a: Column, k: int, levels: int = 4) -> Column:
    """Of x[t] and x[t+k], each in `levels` classes of equal width."""
    low, width = F.array_min(a), (F.array_max(a) - F.array_min(a)) / levels
    cls = F.transform(a, lambda x: F.when(width > 0, F.least(F.floor((x - low) / width), F.lit(levels - 1))).otherwise(0).cast("int"))
    n = F.size(a) - k
    head, tail = F.slice(cls, F.lit(1), n), F.slice(cls, F.lit(1 + k), n)
    both = F.zip_with(head, tail, lambda x, y: x * levels + y)
    out = F.lit(0.0)
    for i in range(levels):
        px = F.size(_equal(head, i)) / n
        for j in range(levels):
            py, pxy = F.size(_equal(tail, j)) / n, F.size(_equal(both, i * levels + j)) / n
            out = out + F.when(pxy > 0, pxy * F.ln(pxy / (px * py))).otherwise(0.0)
    return out


def _equal(a: Column, value: int) -> Column:
    return F.filter(a, lambda x: x == value)

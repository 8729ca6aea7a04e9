"""Column expressions reused by many operators. All stay JVM-side."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

DAY_SECONDS = 86_400


def c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def finite(x: str | Column) -> Column:
    """NULL unless the double is a real number (NaN and infinities become unknown)."""
    x = c(x).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b as double, NULL when b is 0 or NULL."""
    return F.try_divide(c(a).cast("double"), c(b).cast("double"))


def clip(x: str | Column, lo: float, hi: float) -> Column:
    """Clamp, keeping NULL as NULL (greatest/least skip NULLs, so guard)."""
    x = c(x)
    return F.when(x.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), x)))



def epoch(ts: str | Column) -> Column:
    """Microsecond-exact epoch seconds as double."""
    return F.unix_micros(c(ts)) / F.lit(1e6)


def codes(*pairs: tuple[Column, str]) -> Column:
    """Array of the codes whose condition is true, in the given order."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(code)) for cond, code in pairs]))


def mean_known(*parts: Column) -> Column:
    """Mean over the non-NULL parts; NULL when none is known."""
    total = sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0))
    known = sum((p.isNotNull().cast("int") for p in parts), F.lit(0))
    return ratio(total, known)


def trailing(w: WindowSpec, n: int, end: int = 0) -> WindowSpec:
    """The n-row frame ending `end` rows from the current one (0 = current row)."""
    return w.rowsBetween(end - n + 1, end)


def rank_below(values: Column) -> Column:
    """Share of a collected frame strictly below its last element; NULL below 2 elements."""
    last = F.element_at(values, -1)
    return F.when(
        F.size(values) >= 2,
        F.size(F.filter(values, lambda v: v < last)) / F.size(values).cast("double"),
    )


def bind(value: Column, body) -> Column:
    """Evaluate `value` once and use it in `body` (a one-element transform acts as a let)."""
    return F.transform(F.array(value), body)[0]


def uniform_hash(*parts: Column | str) -> Column:
    """A whole number from 0 to 2^32 - 1 from the md5 of the parts joined by '|'; other engines compute the same."""
    text = F.concat_ws("|", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def array_median(values: Column) -> Column:
    """Median of an array of doubles, mean of the middle pair when even."""

    def middle(s: Column) -> Column:
        n = F.size(s)
        lo = F.try_element_at(s, ((n + 1) / 2).cast("int"))
        hi = F.try_element_at(s, (n / 2 + 1).cast("int"))
        return F.when(n > 0, (lo + hi) / 2.0)

    return bind(F.sort_array(values), middle)



def decayed_sum(x: Column, idx: Column, q: float, w: WindowSpec) -> Column:
    """sum over i<=t of q^(t-i) * x_i as one running window sum.

    Weights are rescaled by q^-idx, so callers keep idx small (group rows are bounded by the caller) and the
    geometric weights never overflow a double.
    """
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    scaled = F.sum(x * F.pow(F.lit(1.0 / q), idx)).over(running)
    return scaled * F.pow(F.lit(q), idx)


def wilder(x: Column, idx: Column, period: int, w: WindowSpec) -> Column:
    """Wilder running average of x over rows with idx = 0,1,2,…; seeded with the mean of the first `period`.

    Rows with idx < 0 carry no sample. NULL until `period` samples exist.
    """
    p = float(period)
    q = (p - 1.0) / p
    # every seed sample enters with the weight it would have at position period-1
    pos = F.greatest(idx, F.lit(period - 1))
    weight = F.pow(F.lit(1.0 / q), pos)
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(F.when(idx >= 0, x / p * weight)).over(running)
    return F.when(idx >= period - 1, total * F.pow(F.lit(q), idx))


def ema(x: Column, idx: Column, period: int, w: WindowSpec) -> Column:
    """Exponential moving average with k = 2/(period+1), seeded with the first sample."""
    k = 2.0 / (period + 1.0)
    return decayed_sum(F.when(idx == 0, x).otherwise(x * k), idx, 1.0 - k, w)


def norm_cdf(x: Column) -> Column:
    """Standard normal distribution function from elementary functions.

    Spark has no erf. Rational approximation 26.2.17 of Abramowitz & Stegun, absolute error below 7.5e-8.
    """
    # fixed values: published polynomial coefficients
    b1, b2, b3, b4, b5 = 0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429
    p, inv_sqrt_2pi = 0.2316419, 0.3989422804014327
    a = F.abs(x)
    t = 1.0 / (1.0 + p * a)
    tail = inv_sqrt_2pi * F.exp(-a * a / 2.0) * t * (b1 + t * (b2 + t * (b3 + t * (b4 + t * b5))))
    return F.when(x >= 0, 1.0 - tail).otherwise(tail)


def norm_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2.0) * 0.3989422804014327



def r6(x: str | Column, name: str | None = None) -> Column:
    """Six decimals, halves of the binary product away from zero, as SQL engines round doubles (Spark's round takes the
    shortest decimal text of the double, which differs at halves)."""
    out = F.round(c(x).cast("double") * 1e6) / 1e6
    return out.alias(name) if name else out

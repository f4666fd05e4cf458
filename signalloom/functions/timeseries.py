"""Rolling time-series functions as Columns.

Order is always explicit.  A window function gives NULL until its frame is full of
values; NULL stands for every missing value, NaN and infinity included.  ``rank``,
``scale`` and ``winsorize`` see the whole series and are not causal; all others look
back only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

FUNCTIONS: dict[str, Callable[..., Column]] = {}
PLAIN: dict[str, Callable[..., Column]] = {}


class Series:
    """Where a function finds its rows: the keys of a series and its time column."""

    def __init__(self, keys: list[str], time: str):
        self.keys, self.time = list(keys), time
        self.whole = Window.partitionBy(*self.keys)
        self.order = self.whole.orderBy(time)

    def last(self, n: int):
        return self.order.rowsBetween(-(n - 1), 0)

    def full(self, x: Column, n: int, e: Column) -> Column:
        return F.when(F.count(x).over(self.last(n)) == n, e)


def _windowed(f):
    FUNCTIONS[f.__name__] = f
    return f


def _plain(f):
    PLAIN[f.__name__.rstrip("_")] = f
    return f


def clean(x: Column) -> Column:
    """NULL for NaN and infinities."""
    return F.when(F.abs(x) < float("inf"), x)


@_windowed
def ts_delay(s: Series, x: Column, n: int = 1) -> Column:
    return F.lag(x, n).over(s.order)


@_windowed
def last(s: Series, x: Column) -> Column:
    return F.last(x, ignorenulls=True).over(s.order.rowsBetween(Window.unboundedPreceding, -1))


@_windowed
def ts_delta(s: Series, x: Column, n: int = 1) -> Column:
    return x - F.lag(x, n).over(s.order)


@_windowed
def ts_ffill(s: Series, x: Column) -> Column:
    return F.last(x, ignorenulls=True).over(s.order.rowsBetween(Window.unboundedPreceding, 0))


@_windowed
def ts_mean(s: Series, x: Column, n: int) -> Column:
    return s.full(x, n, F.avg(x).over(s.last(n)))


@_windowed
def ts_std(s: Series, x: Column, n: int) -> Column:
    return s.full(x, n, F.stddev_samp(x).over(s.last(n)))


@_windowed
def ts_sum(s: Series, x: Column, n: int) -> Column:
    return s.full(x, n, F.sum(x).over(s.last(n)))


@_windowed
def ts_min(s: Series, x: Column, n: int) -> Column:
    return s.full(x, n, F.min(x).over(s.last(n)))


@_windowed
def ts_max(s: Series, x: Column, n: int) -> Column:
    return s.full(x, n, F.max(x).over(s.last(n)))


@_windowed
def ts_rank(s: Series, x: Column, n: int) -> Column:
    """Average-tie percentile rank of the newest value in its frame."""
    seen = F.collect_list(x).over(s.last(n))
    below, equal = F.size(F.filter(seen, lambda v: v < x)), F.size(F.filter(seen, lambda v: v == x))
    return s.full(x, n, (below + (equal + 1) / 2) / n)


@_windowed
def ts_zscore(s: Series, x: Column, n: int) -> Column:
    sd = F.stddev_samp(x).over(s.last(n))
    return s.full(x, n, F.when(sd != 0, (x - F.avg(x).over(s.last(n))) / sd))


@_windowed
def ts_corr(s: Series, x: Column, y: Column, n: int) -> Column:
    both = F.count(F.when(x.isNotNull() & y.isNotNull(), 1)).over(s.last(n)) == n
    spread = F.stddev_samp(x).over(s.last(n)) * F.stddev_samp(y).over(s.last(n))
    return F.when(both & (spread != 0), F.covar_samp(x, y).over(s.last(n)) / spread)  # corr itself raises on a constant frame


@_windowed
def ts_cov(s: Series, x: Column, y: Column, n: int) -> Column:
    both = F.count(F.when(x.isNotNull() & y.isNotNull(), 1)).over(s.last(n)) == n
    return F.when(both, F.covar_samp(x, y).over(s.last(n)))


@_windowed
def ts_beta(s: Series, x: Column, y: Column, n: int) -> Column:
    spread = F.var_samp(y).over(s.last(n))
    return F.when(spread != 0, ts_cov(s, x, y, n) / spread)


@_windowed
def ts_decay(s: Series, x: Column, n: int) -> Column:
    """Linearly weighted mean, newest heaviest."""
    seen = F.collect_list(x).over(s.last(n))
    weighted = F.transform(seen, lambda v, i: v * (i + 1))
    return s.full(x, n, F.aggregate(weighted, F.lit(0.0), lambda a, v: a + v) / (n * (n + 1) / 2))


@_windowed
def ts_quantile(s: Series, x: Column, n: int, q: float) -> Column:
    return s.full(x, n, F.percentile(x, q).over(s.last(n)))


@_windowed
def ts_skew(s: Series, x: Column, n: int) -> Column:
    """Bias-adjusted; 0 for a constant frame."""
    adjusted = F.skewness(x).over(s.last(n)) * ((n * (n - 1)) ** 0.5 / (n - 2))
    return s.full(x, n, F.when(F.min(x).over(s.last(n)) == F.max(x).over(s.last(n)), 0.0).otherwise(adjusted))


@_windowed
def ts_kurt(s: Series, x: Column, n: int) -> Column:
    """Bias-adjusted excess; 0 for a constant frame."""
    adjusted = ((n + 1) * F.kurtosis(x).over(s.last(n)) + 6) * ((n - 1) / ((n - 2) * (n - 3)))
    return s.full(x, n, F.when(F.min(x).over(s.last(n)) == F.max(x).over(s.last(n)), 0.0).otherwise(adjusted))


@_windowed
def rank(s: Series, x: Column) -> Column:
    """Average-tie percentile rank over the whole series."""
    at = F.rank().over(s.whole.orderBy(x.asc_nulls_last()))
    ties = F.count(x).over(Window.partitionBy(*s.keys, x))
    return F.when(x.isNotNull(), (at + (ties - 1) / 2) / F.count(x).over(s.whole))


@_windowed
def scale(s: Series, x: Column, a: float = 1.0) -> Column:
    total = F.sum(F.abs(x)).over(s.whole)
    return F.when(total != 0, a * x / total)


@_windowed
def winsorize(s: Series, x: Column, lo: float = 0.01, hi: float = 0.99) -> Column:
    return clip(x, F.percentile(x, lo).over(s.whole), F.percentile(x, hi).over(s.whole))


@_plain
def clip(x: Column, lo, hi) -> Column:
    lo, hi = (v if isinstance(v, Column) else F.lit(v) for v in (lo, hi))
    return F.when(x < lo, lo).when(x > hi, hi).otherwise(x)


@_plain
def signed_power(x: Column, a: float) -> Column:
    return F.signum(x) * F.pow(F.abs(x), F.lit(a))


@_plain
def safe_div(x, y) -> Column:
    x, y = (v if isinstance(v, Column) else F.lit(float(v)) for v in (x, y))
    return F.when(y != 0, x / y)


@_plain
def ifcond(c: Column, x, y) -> Column:
    return F.when(F.coalesce(c, F.lit(False)), x).otherwise(y)


@_plain
def abs_(x: Column) -> Column:
    return F.abs(x)


@_plain
def log(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


@_plain
def exp(x: Column) -> Column:
    return clean(F.exp(x))


@_plain
def sqrt(x: Column) -> Column:
    return F.when(x >= 0, F.sqrt(x))


def register_formula(name: str, f: Callable[..., Column], windowed: bool = False) -> None:
    """Make ``f`` callable in formulas; windowed ones get the Series first."""
    (FUNCTIONS if windowed else PLAIN)[name] = f

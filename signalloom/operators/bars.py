"""Bars: resampling and technical indicators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.smoothing import Smoothing, ewm, smooth
from ..functions.timeseries import Series

EPOCH = "timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', {c})"


def time_ms(column: str):
    """Epoch milliseconds of a zone-free timestamp, whatever the session's zone."""
    return F.expr(EPOCH.format(c=column))


def resample_ohlcv(df: DataFrame, step_ms: int, keys: list[str], price: str, volume: str, order: list[str], closed: str = "right") -> DataFrame:
    """OHLCV bars, right-closed and right-labelled by default; one partially aggregated group-by."""
    edge = F.ceil(F.col("time_ms") / step_ms) if closed == "right" else F.floor(F.col("time_ms") / step_ms)
    at = F.struct(*order)
    out = df.groupBy(*keys, (edge * step_ms).alias("bar_ms")).agg(
        F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.sum(volume).alias("volume"),
    )
    return out.where("close is not null").withColumnRenamed("bar_ms", "time_ms")


def _smoothings(period: int, fast: int, slow: int, close: str) -> dict[str, list[Smoothing]]:
    alpha = lambda n: 2 / (n + 1)
    return {
        "rsi": [Smoothing(c, f"{c}_s", 1 / period, period) for c in ("__up", "__down")],
        "macd": [Smoothing(close, "__fast", alpha(fast), fast), Smoothing(close, "__slow", alpha(slow), slow)],
    }


def _moves(df: DataFrame, keys: list[str], close: str) -> DataFrame:
    """What a bar gained or lost against the one before."""
    step = F.col(close) - F.lag(close).over(Window.partitionBy(*keys).orderBy("time_ms"))
    return df.withColumn("__step", step).withColumns({
        "__up": F.when(F.col("__step") > 0, F.col("__step")).when(F.col("__step").isNotNull(), 0.0), "__down": F.when(F.col("__step") < 0, -F.col("__step")).when(F.col("__step").isNotNull(), 0.0),
    }).drop("__step")


def _rsi_of(df: DataFrame, period: int) -> DataFrame:
    value = 100 - 100 / (1 + F.col("__up_s") / F.when(F.col("__down_s") != 0, F.col("__down_s")))
    return df.withColumn(f"rsi_{period}", value).drop("__up", "__down", "__up_s", "__down_s")


def _macd_of(df: DataFrame, keys: list[str], signal: int) -> DataFrame:
    df = df.withColumn("macd", F.col("__fast") - F.col("__slow")).drop("__fast", "__slow")
    df = ewm(df, "macd", "macd_signal", keys, "time_ms", 2 / (signal + 1), signal)
    return df.withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))


def rsi(df: DataFrame, keys: list[str], period: int = 14, close: str = "close") -> DataFrame:
    """Wilder's RSI; NULL where nothing was lost."""
    return _rsi_of(smooth(_moves(df, keys, close), _smoothings(period, 1, 1, close)["rsi"], keys, "time_ms"), period)


def macd(df: DataFrame, keys: list[str], fast: int = 12, slow: int = 26, signal: int = 9, close: str = "close") -> DataFrame:
    return _macd_of(smooth(df, _smoothings(1, fast, slow, close)["macd"], keys, "time_ms"), keys, signal)


def bollinger(df: DataFrame, keys: list[str], n: int = 20, k: float = 2.0, close: str = "close") -> DataFrame:
    s, x = Series(keys, "time_ms"), F.col(close)
    mid, sd = F.avg(x).over(s.last(n)), F.stddev_pop(x).over(s.last(n))
    return df.withColumns({"bb_mid": s.full(x, n, mid), "bb_upper": s.full(x, n, mid + k * sd), "bb_lower": s.full(x, n, mid - k * sd)})


def true_range(df: DataFrame, keys: list[str], n: int = 14) -> DataFrame:
    s = Series(keys, "time_ms")
    before = F.lag("close").over(s.order)
    df = df.withColumn("tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))
    return df.withColumn(f"atr_{n}", s.full(F.col("tr"), n, F.avg("tr").over(s.last(n))))


INDICATORS = ("rsi_14", "macd", "macd_signal", "macd_hist", "bb_mid", "bb_upper", "bb_lower", "tr", "atr_14")


def add_indicators(df: DataFrame, keys: list[str], prefix: str = "") -> DataFrame:
    """The indicator columns, rounded half-even as displayed; columns of their names are replaced.

    Two smoothing passes: gains, losses and both averages share the first.
    """
    names = {c: f"{prefix}{c}" for c in INDICATORS}
    kept = [c for c in df.columns if c not in names.values()]
    made = df.select(*kept)
    both = _smoothings(14, 12, 26, "close")
    made = smooth(_moves(made, keys, "close"), both["rsi"] + both["macd"], keys, "time_ms")
    made = true_range(bollinger(_macd_of(_rsi_of(made, 14), keys, 9), keys), keys)
    return made.select(*kept, *(F.bround(c, 4 if c.startswith("rsi") else 6).alias(n) for c, n in names.items()))

"""Signals to positions to net-of-cost results.

Everything runs on long tables keyed by series and signal, so signals and profiles are
partitions rather than driver loops.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.carried import Carry, carried, lagged
from ..functions.rolling import Rolling, roll
from ..functions.smoothing import ewm


@dataclass(frozen=True)
class BacktestConfig:
    fee_bps: float = 3.0
    slippage_bps: float = 1.0
    clip: float = 2.5
    step: float = 0.1
    deadband: float = 0.0
    deadband_long: float | None = None
    deadband_short: float | None = None
    bars_per_year: float = 8760.0

    @property
    def band(self) -> tuple[float, float]:
        """Least z of a long and of a short entry; one arm alone serves both sides."""
        long_at = self.deadband if self.deadband_long is None else self.deadband_long
        short_at = self.deadband if self.deadband_short is None else self.deadband_short
        if self.deadband == 0 and self.deadband_short is None:
            short_at = long_at
        if self.deadband == 0 and self.deadband_long is None:
            long_at = short_at
        return long_at, short_at

    @property
    def cost(self) -> float:
        return (self.fee_bps + self.slippage_bps) / 10_000


def robust_zscore(df: DataFrame, value: str, out: str, keys: list[str], n: int, chunk: int | None = None, width: int | None = None) -> DataFrame:
    """(x - median) / (1.4826 MAD); each row enters the MAD with its own median.

    With ``chunk`` a series is cut into overlapping parts of so many rows (2 n at least).
    """
    columns = [c for c in df.columns if c != out]
    return roll(df, [Rolling(value, out, "robust_z", n)], keys, "time_ms", chunk, width).select(*columns, out)


def deadband(z: Column, long_at: float, short_at: float) -> Column:
    """Zero inside the band; a missing z is flat when a band is set."""
    if long_at <= 0 and short_at <= 0:
        return z
    return F.when(z >= long_at, z).when(z <= -short_at, z).otherwise(0.0)


def squash(z: Column, c: BacktestConfig, mode: str = "tanh") -> Column:
    """Clipped, banded and squashed into one unit."""
    z = F.when(z > c.clip, c.clip).when(z < -c.clip, -c.clip).otherwise(z)
    z = deadband(z, *c.band)
    return F.signum(z) if mode == "sign" else F.tanh(z / c.clip)


def position(z: Column, c: BacktestConfig, mode: str = "tanh") -> Column:
    """Squashed and laid on the step ladder (half-even)."""
    return F.rint(F.round(squash(z, c, mode) / c.step, 9)) * c.step


def smooth_position(df: DataFrame, column: str, keys: list[str], span: int, c: BacktestConfig) -> DataFrame:
    df = ewm(df, column, "__p", keys, "time_ms", 2 / (span + 1))
    return df.withColumn(column, F.rint(F.round(F.col("__p") / c.step, 9)) * c.step).drop("__p")


def backtest(df: DataFrame, keys: list[str], c: BacktestConfig, pos: str = "position", ret: str = "ret_1", width: int | None = None) -> DataFrame:
    """Trace: the position of the bar before earns the bar's return; the first entry is free.

    With ``width`` the rows before each slice of time are carried into it, so a series runs in many tasks.
    """
    if width:
        return _backtest_slices(df, keys, c, pos, ret, width)
    order = Window.partitionBy(*keys).orderBy("time_ms")
    held = F.coalesce(F.lag(pos).over(order), F.lit(0.0))
    df = df.withColumn("held", held)
    turn = F.coalesce(F.abs(F.col("held") - F.lag("held").over(order)), F.lit(0.0))
    df = df.withColumns({"turnover": turn, "gross_ret": F.col("held") * F.coalesce(ret, F.lit(0.0))})
    df = df.withColumns({"cost_ret": F.col("turnover") * c.cost})
    df = df.withColumn("net_ret", F.col("gross_ret") - F.col("cost_ret"))
    return df.withColumn("equity", F.product(1 + F.col("net_ret")).over(order.rowsBetween(Window.unboundedPreceding, 0)))


def _backtest_slices(df: DataFrame, keys: list[str], c: BacktestConfig, pos: str, ret: str, width: int) -> DataFrame:
    held = lagged(df, F.col(pos), "held", keys, "time_ms", width).withColumn("held", F.coalesce("held", F.lit(0.0)))
    df = lagged(held, F.col("held"), "__h", keys, "time_ms", width)
    df = df.withColumns({"turnover": F.coalesce(F.abs(F.col("held") - F.col("__h")), F.lit(0.0)), "gross_ret": F.col("held") * F.coalesce(ret, F.lit(0.0))}).drop("__h")
    df = df.withColumn("cost_ret", F.col("turnover") * c.cost).withColumn("net_ret", F.col("gross_ret") - F.col("cost_ret"))
    return carried(df, {"equity": Carry("product", 1 + F.col("net_ret"))}, keys, "time_ms", width)


def drawdown(df: DataFrame, keys: list[str], equity: str = "equity", width: int | None = None) -> DataFrame:
    if width:
        top = carried(df, {"__top": Carry("max", F.col(equity))}, keys, "time_ms", width)
        return top.withColumn("drawdown", F.col(equity) / F.col("__top") - 1).drop("__top")
    order = Window.partitionBy(*keys).orderBy("time_ms").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("drawdown", F.col(equity) / F.max(equity).over(order) - 1)


def metrics(trace: DataFrame, by: list[str], c: BacktestConfig) -> DataFrame:
    """Annual return and volatility (ddof 0), Sharpe, Calmar, drawdown, hit rate, profit factor, turnover."""
    ret = F.col("net_ret")
    out = trace.groupBy(*by).agg(
        F.count("*").alias("bars"), (F.avg(ret) * c.bars_per_year).alias("ann_ret"), (F.stddev_pop(ret) * c.bars_per_year**0.5).alias("ann_vol"),
        F.min("drawdown").alias("max_drawdown"), F.avg((ret > 0).cast("double")).alias("hit_rate"),
        F.sum(F.when(ret > 0, ret)).alias("__won"), F.sum(F.when(ret < 0, -ret)).alias("__lost"), F.avg("turnover").alias("avg_turnover"),
    )
    out = out.withColumns({
        "sharpe": F.when(F.col("ann_vol") > 0, F.col("ann_ret") / F.col("ann_vol")),
        "calmar": F.when(F.col("max_drawdown") < 0, F.col("ann_ret") / -F.col("max_drawdown")),
        "profit_factor": F.when(F.col("__lost") > 0, F.col("__won") / F.col("__lost")),
    })
    return out.drop("__won", "__lost")


def split_last(df: DataFrame, keys: list[str], share: float) -> DataFrame:
    """``segment``: the last share of each series is the test part, at least one row on both sides."""
    n, at = F.count("*").over(Window.partitionBy(*keys)), F.row_number().over(Window.partitionBy(*keys).orderBy("time_ms"))
    test = F.greatest(F.lit(1), F.least(F.rint(n * share).cast("long"), n - 1))
    return df.withColumn("segment", F.when(at > n - test, "test").otherwise("train"))


def split_at(df: DataFrame, edge_ms: int) -> DataFrame:
    """``segment``: train before the edge, test from it on."""
    return df.withColumn("segment", F.when(F.col("time_ms") < edge_ms, "train").otherwise("test"))


def sharpe(ret: str, c: BacktestConfig, over=None) -> Column:
    """Annual mean over annual deviation (ddof 0), as an aggregate or over a window."""
    mean, sd = F.avg(ret), F.stddev_pop(ret)
    mean, sd = (mean.over(over), sd.over(over)) if over is not None else (mean, sd)
    return F.when(sd > 0, mean / sd * c.bars_per_year**0.5)


def walk_forward(trace: DataFrame, keys: list[str], folds: int, c: BacktestConfig, base: str | None = None) -> DataFrame:
    """Sharpe over contiguous folds and the robust score of a series.

    The score starts from the column ``base`` (a figure of the whole series), or else from
    the Sharpe of the whole trace.  Missing returns are left out; a series of fewer than
    max(120, 20 a fold) returns has no figures.
    """
    whole, order = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("time_ms")
    n, at = F.count("net_ret").over(whole), F.count("net_ret").over(order.rowsBetween(Window.unboundedPreceding, 0))
    start = F.col(base) if base else sharpe("net_ret", c, whole)
    df = trace.select(*keys, "net_ret", n.alias("__n"), at.alias("__at"), start.cast("double").alias("__base"))
    fold = F.least(F.floor((F.col("__at") - 1) / F.greatest(F.floor(F.col("__n") / folds), F.lit(1))), F.lit(folds - 1))
    enough = F.col("net_ret").isNotNull() & (F.col("__n") >= max(120, 20 * folds))
    per = df.withColumn("__fold", F.when(enough, fold)).groupBy(*keys, "__fold").agg(sharpe("net_ret", c).alias("__s"), F.max("__base").alias("__b"))
    of = F.when(F.col("__fold").isNotNull(), F.col("__s"))
    out = per.groupBy(*keys).agg(F.min(of).alias("wf_min"), F.avg(of).alias("wf_mean"), F.stddev_pop(of).alias("wf_std"), F.max("__b").alias("__base"))
    return out.withColumn("robust_score", F.col("__base") + 0.45 * F.col("wf_min") - 0.25 * F.col("wf_std")).drop("__base")


def ensemble(traces: DataFrame, keys: list[str], weights: dict[str, float]) -> DataFrame:
    """Net return and equity of weighted signals; weights count by their absolute sum, equal ones where that is zero.

    A signal without a row at a time adds nothing.
    """
    total = sum(abs(w) for w in weights.values())
    share = {s: w / total if total > 0 else 1 / len(weights) for s, w in weights.items()}
    by = F.lit(0.0)
    for s, w in share.items():
        by = F.when(F.col("signal") == s, w).otherwise(by)
    out = traces.where(F.col("signal").isin([*share])).groupBy(*keys, "time_ms").agg(F.sum(F.coalesce("net_ret", F.lit(0.0)) * by).alias("net_ret"))
    order = Window.partitionBy(*keys).orderBy("time_ms").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("equity", F.product(1 + F.col("net_ret")).over(order))


def scaled_window(z_window: int, bar_minutes: int, least: int = 16) -> int:
    """A window of one-minute bars in bars of another size."""
    return max(least, round(z_window / bar_minutes))


def frequency_label(bar_minutes: int) -> str:
    return f"{bar_minutes // 60}h" if bar_minutes % 60 == 0 else f"{bar_minutes}m"


def triggers(df: DataFrame, keys: list[str], pos: str = "position") -> DataFrame:
    """Transitions from flat to active per series."""
    order = Window.partitionBy(*keys).orderBy("time_ms")
    active = F.abs(F.coalesce(pos, F.lit(0.0))) > 1e-12
    df = df.withColumn("__a", active).withColumn("__b", F.coalesce(F.lag("__a").over(order), F.lit(False)))
    return df.groupBy(*keys).agg(F.sum((F.col("__a") & ~F.col("__b")).cast("long")).alias("triggers"))


def asof_backward(slow: DataFrame, fast: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The newest value of ``slow`` at or before each row of ``fast``; zero before the first.

    A union and one window: no range join, and skewed series only sort.
    """
    a = slow.select(*keys, "time_ms", F.col(value).alias("__v"), F.lit(0).alias("__own"))
    b = fast.select(*keys, "time_ms", F.lit(None).cast("double").alias("__v"), F.lit(1).alias("__own"))
    order = Window.partitionBy(*keys).orderBy("time_ms", "__own").rowsBetween(Window.unboundedPreceding, 0)
    filled = a.union(b).withColumn("__v", F.last("__v", True).over(order)).where("__own = 1")
    return filled.select(*keys, "time_ms", F.coalesce("__v", F.lit(0.0)).alias(value))


def nearest(points: DataFrame, bars: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The value of the bar nearest in time to each point, the earlier one on a tie."""
    a = bars.select(*keys, "time_ms", F.struct(F.col("time_ms").alias("t"), F.col(value).alias("v")).alias("__s"), F.lit(0).alias("__own"))
    b = points.select(*keys, "time_ms", F.lit(None).cast(a.schema["__s"].dataType).alias("__s"), F.lit(1).alias("__own"))
    back = Window.partitionBy(*keys).orderBy("time_ms", "__own").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys).orderBy(F.desc("time_ms"), F.desc("__own")).rowsBetween(Window.unboundedPreceding, 0)  # running, so linear
    both = a.union(b).withColumns({"__p": F.last("__s", True).over(back), "__q": F.last("__s", True).over(ahead)}).where("__own = 1")
    far = F.col("__p").isNull() | (F.col("__q.t") - F.col("time_ms") < F.col("time_ms") - F.col("__p.t"))
    return both.select(*keys, "time_ms", F.when(far, F.col("__q.v")).otherwise(F.col("__p.v")).alias(value), F.when(far, F.col("__q.t")).otherwise(F.col("__p.t")).alias("bar_ms"))


def select_best(report: DataFrame, by: list[str], score: str, name: str = "signal") -> DataFrame:
    """The best row a key; ties go to the smaller name."""
    order = Window.partitionBy(*by).orderBy(F.col(score).desc_nulls_last(), name)
    return report.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")

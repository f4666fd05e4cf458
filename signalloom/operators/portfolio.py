"""Ensembles, volatility targeting, regimes and diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.carried import run_lengths
from ..functions.timeseries import Series
from .regression import two_stage_ols  # noqa: F401
from .terciles import expanding_regime, vol_regime  # noqa: F401


def equal_weight(df: DataFrame, by: list[str], pos: str = "position") -> DataFrame:
    """Mean position of all signals a time, within one unit."""
    mean = F.avg(pos)
    return df.groupBy(*by).agg(F.when(mean > 1, 1.0).when(mean < -1, -1.0).otherwise(mean).alias(pos), F.count(pos).alias("signals"))


def rolling_ann_vol(df: DataFrame, keys: list[str], n: int, bars: float, ret: str = "net_ret") -> DataFrame:
    """Zero-filled, ddof 0, from max(n / 4, 10) rows on."""
    s = Series(keys, "time_ms")
    x = F.coalesce(ret, F.lit(0.0))
    return df.withColumn("ann_vol", F.when(F.count(x).over(s.last(n)) >= max(n // 4, 10), F.stddev_pop(x).over(s.last(n))) * bars**0.5)


def vol_target(df: DataFrame, keys: list[str], target: float, floor: float = 0.05, cap: float = 3.0, pos: str = "position") -> DataFrame:
    """Position times target over volatility; the warm-up takes the first leverage (looks ahead there)."""
    raw = F.least(F.lit(target) / F.greatest("ann_vol", F.lit(floor)), F.lit(cap))
    df = df.withColumn("__l", F.when(F.col("ann_vol").isNotNull(), raw))
    order = Window.partitionBy(*keys).orderBy("time_ms")
    past, whole = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumn("leverage", F.coalesce(F.last("__l", True).over(past), F.first("__l", True).over(whole), F.lit(1.0))).withColumn("scaled", F.col(pos) * F.col("leverage")).drop("__l")


def inverse_vol_weights(df: DataFrame, by: list[str], eps: float = 1e-9) -> DataFrame:
    """Weights 1 / volatility that add up to one a time; equal where none is known."""
    w = Window.partitionBy(*by)
    raw = 1 / (F.col("ann_vol") + eps)
    total = F.sum(raw).over(w)
    return df.withColumn("weight", F.when(total.isNotNull(), F.coalesce(raw, F.lit(0.0)) / total).otherwise(1 / F.count(F.lit(1)).over(w)))


def regime_summary(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by, "regime").agg(F.count("*").alias("bars"), F.avg("net_ret").alias("mean_ret"), F.stddev_pop("net_ret").alias("sd_ret"), F.avg("turnover").alias("turnover"))


def regime_pivot(df: DataFrame, by: list[str], value: str = "net_ret") -> DataFrame:
    """Mean by regime, one column each; the values are stated so no extra job runs."""
    return df.groupBy(*by).pivot("regime", [0, 1, 2]).agg(F.avg(value)).withColumnsRenamed({str(k): f"regime_{k}" for k in range(3)})


def pnl_decomposition(trace: DataFrame, keys: list[str]) -> DataFrame:
    """Gross result of long, short and flat bars, and fees."""
    side = lambda c: F.sum(F.when(c, F.col("gross_ret")).otherwise(0.0))
    return trace.groupBy(*keys).agg(side(F.col("held") > 0).alias("long_pnl"), side(F.col("held") < 0).alias("short_pnl"), F.sum("cost_ret").alias("fees"), F.sum("net_ret").alias("net"))


def position_stats(trace: DataFrame, keys: list[str], pos: str = "position") -> DataFrame:
    p = F.col(pos)
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return trace.groupBy(*keys).agg(F.avg(p).alias("mean_pos"), F.avg(F.abs(p)).alias("mean_abs"), share(p > 0).alias("long_share"), share(p < 0).alias("short_share"), F.max(F.abs(p)).alias("max_abs"))


def trade_markers(trace: DataFrame, keys: list[str], eps: float = 0.02, pos: str = "position") -> DataFrame:
    """Rows where a position opens, closes or turns."""
    before = F.coalesce(F.lag(pos).over(Window.partitionBy(*keys).orderBy("time_ms")), F.lit(0.0))
    side = lambda c: F.when(c > eps, 1).when(c < -eps, -1).otherwise(0)
    df = trace.withColumn("__a", side(before)).withColumn("__b", side(F.col(pos))).where("__a <> __b")
    kind = F.when(F.col("__a") == 0, F.when(F.col("__b") > 0, "open_long").otherwise("open_short")).when(F.col("__b") == 0, "close").otherwise("flip")
    return df.select(*keys, "time_ms", kind.alias("marker"))


def longest_drawdown(trace: DataFrame, keys: list[str], width: int | None = None) -> DataFrame:
    """Most bars in a row below an earlier peak (gaps and islands, or run lengths carried over slices of time)."""
    if width:
        return run_lengths(trace, F.col("drawdown") < 0, "__n", keys, "time_ms", width).groupBy(*keys).agg(F.max("__n").alias("longest"))
    order = Window.partitionBy(*keys).orderBy("time_ms")
    df = trace.withColumn("__u", (F.col("drawdown") < 0).cast("int")).withColumn("__g", F.sum(1 - F.col("__u")).over(order))
    return df.groupBy(*keys, "__g").agg(F.sum("__u").alias("n")).groupBy(*keys).agg(F.max("n").alias("longest"))


def correlation_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of each pair of columns: one aggregation, then one row a pair."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*(F.corr(a, b).alias(f"c{k}") for k, (a, b) in enumerate(pairs)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{k}").alias("corr")) for k, (a, b) in enumerate(pairs)))).alias("p")).select("p.*")


def risk_parity(traces: DataFrame, keys: list[str], n: int, ret: str = "ret_1", eps: float = 1e-12) -> DataFrame:
    """``keys, time_ms, position``: signals weighted by the inverse volatility of their gross returns, within one unit."""
    gross = rolling_ann_vol(traces.withColumn("__g", F.col("position") * F.coalesce(ret, F.lit(0.0))), [*keys, "signal"], n, 1.0, "__g")
    mixed = inverse_vol_weights(gross, [*keys, "time_ms"], eps).groupBy(*keys, "time_ms").agg(F.sum(F.col("position") * F.col("weight")).alias("p"))
    return mixed.select(*keys, "time_ms", F.when(F.col("p") > 1, 1.0).when(F.col("p") < -1, -1.0).otherwise(F.col("p")).alias("position"))


def allocation_variants(positions: DataFrame, keys: list[str], n: int, c, target: float = 0.12, floor: float = 0.04, cap: float = 2.5, ret: str = "ret_1") -> DataFrame:
    """Traces of three ways to hold the same signals, by ``variant``: equal weights, those at a volatility target, and inverse volatility.

    All positions stay within one unit.
    """
    from .signals import backtest, drawdown

    by = [*keys, "time_ms"]
    returns = positions.groupBy(*by).agg(F.max(ret).alias(ret))
    equal = equal_weight(positions, by).join(returns, by).select(*by, "position", ret)
    risk = rolling_ann_vol(equal.withColumn("__g", F.col("position") * F.coalesce(ret, F.lit(0.0))), keys, n, c.bars_per_year, "__g")
    scaled = F.col("scaled")
    aimed = vol_target(risk, keys, target, floor, cap).select(*by, F.when(scaled > 1, 1.0).when(scaled < -1, -1.0).otherwise(scaled).alias("position"), ret)
    even = risk_parity(positions, keys, n, ret).join(returns, by).select(*by, "position", ret)
    named = [df.withColumn("variant", F.lit(name)) for name, df in (("equal_weight", equal), ("vol_target", aimed), ("risk_parity_inv_vol", even))]
    own = [*keys, "variant"]
    return drawdown(backtest(named[0].unionByName(named[1]).unionByName(named[2]), own, c, ret=ret), own)


def vol_target_leverage(df: DataFrame, keys: list[str], target: float, n: int, least: int, bars: float, pos: str = "position", ret: str = "ret_1") -> DataFrame:
    """Target over the rolling deviation (ddof 1) of position times return, between 0.15 and 6; the last known one, else 1."""
    s = Series(keys, "time_ms")
    x = F.col(pos) * F.col(ret)
    sd = F.when(F.count(x).over(s.last(n)) >= least, F.greatest(F.stddev_samp(x).over(s.last(n)), F.lit(1e-12)))
    df = df.withColumn("__l", target / bars**0.5 / sd)
    df = df.withColumn("__l", F.when(F.col("__l").isNotNull(), F.least(F.greatest("__l", F.lit(0.15)), F.lit(6.0))))
    past = Window.partitionBy(*keys).orderBy("time_ms").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("leverage", F.coalesce(F.last("__l", True).over(past), F.lit(1.0))).drop("__l")


def lift(traces: DataFrame, by: list[str], model: str, base: str, c) -> DataFrame:
    """Annual return and Sharpe of each other model less those of ``base``, in the same group."""
    from .signals import sharpe

    figures = traces.groupBy(*by, model).agg((F.avg("net_ret") * c.bars_per_year).alias("ann_ret"), sharpe("net_ret", c).alias("sharpe"))
    own = figures.where(F.col(model) == base).select(*by, F.col("ann_ret").alias("__r"), F.col("sharpe").alias("__s"))
    both = figures.where(F.col(model) != base).join(own, by)
    return both.select(*by, model, (F.col("ann_ret") - F.col("__r")).alias("ann_ret_lift"), (F.col("sharpe") - F.col("__s")).alias("sharpe_lift"))


def train_scaled(df: DataFrame, columns: list[str], train, most: float = 6.0) -> DataFrame:
    """Columns less the train mean over the train deviation, within ``most``; the figures are one row, so their join is a broadcast."""
    stats = df.where(train).agg(*(f(c).alias(f"__{k}_{c}") for c in columns for k, f in (("m", F.avg), ("s", F.stddev_samp))))
    z = {c: (F.col(c) - F.col(f"__m_{c}")) / F.when(F.col(f"__s_{c}") > 0, F.col(f"__s_{c}")) for c in columns}
    return df.crossJoin(F.broadcast(stats)).select(*(c for c in df.columns if c not in columns), *(F.when(v > most, most).when(v < -most, -most).otherwise(v).alias(c) for c, v in z.items()))

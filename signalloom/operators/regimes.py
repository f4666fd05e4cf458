"""Positions by regime: mapped signals, joint codes, risk multipliers, backtests.

Positions are long tables of ``keys, time_ms, signal, position``, regimes are ``keys,
time_ms, regime``.  Tables are aligned on all times of any of them by one union and one
group-by, so an alignment is one shuffle whatever the number of tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import signals as S


def aligned(keys: list[str], **columns: DataFrame) -> DataFrame:
    """``keys, time_ms`` and one column for each table, named as given; NULL where a table has no row."""
    parts = []
    for name, df in columns.items():
        own = {c: F.col(c) if c == name else F.lit(None).cast(dict(columns[c].dtypes)[c]) for c in columns}
        parts.append(df.select(*keys, "time_ms", *(v.alias(c) for c, v in own.items())))
    return reduce(DataFrame.union, parts).groupBy(*keys, "time_ms").agg(*(F.max(c).alias(c) for c in columns))


def stepped(x: Column, most: float = 1.0, step: float = 0.1) -> Column:
    """Clipped, laid on the step ladder (half-even) and clipped again."""
    within = lambda v: F.when(v > most, most).when(v < -most, -most).otherwise(v)
    return within(F.rint(F.round(within(x) / step, 9)) * step) if step > 0 else within(x)


def position_matrix(traces: DataFrame, keys: list[str], names: list[str], value: str = "position") -> DataFrame:
    """One column a signal, zero where it has no row; the names are stated, so no extra job runs."""
    return traces.where(F.col("signal").isin(names)).groupBy(*keys, "time_ms").pivot("signal", names).agg(F.first(value)).na.fill(0.0, names)


def regime_position(traces: DataFrame, regime: DataFrame, mapping: dict[int, list[str]], names: list[str], keys: list[str], most: float = 1.0, step: float = 0.1) -> DataFrame:
    """Mean position of the signals that are mapped to the regime of each time; zero without one.

    ``names`` are the signals that exist; one that has no row at a time counts as zero.
    """
    used = {r: [s for s in signals if s in names] for r, signals in mapping.items()}
    long = traces.where(F.col("signal").isin(names)).select(*keys, "time_ms", "signal", "position", F.lit(None).cast("int").alias("regime"))
    marks = regime.select(*keys, "time_ms", F.lit(None).cast("string").alias("signal"), F.lit(None).cast("double").alias("position"), F.col("regime").cast("int"))
    sums = [F.sum(F.when(F.col("signal").isin(s), F.col("position"))).alias(f"__r{r}") for r, s in used.items() if s]
    out = long.union(marks).groupBy(*keys, "time_ms").agg(F.max("regime").alias("regime"), *sums)
    mean = F.lit(0.0)
    for r, s in used.items():
        mean = F.when(F.col("regime") == r, F.coalesce(f"__r{r}", F.lit(0.0)) / len(s)).otherwise(mean) if s else mean
    return out.select(*keys, "time_ms", "regime", stepped(mean, most, step).alias("position"))


def joint_code(one: DataFrame, two: DataFrame, keys: list[str], kinds: int = 3) -> DataFrame:
    """``regime``: the first regime times ``kinds`` plus the second, where both are known."""
    both = aligned(keys, __a=one.withColumnRenamed("regime", "__a"), __b=two.withColumnRenamed("regime", "__b"))
    return both.select(*keys, "time_ms", (F.col("__a") * kinds + F.col("__b")).cast("int").alias("regime"))


def with_risk_multiplier(position: DataFrame, code: DataFrame, multipliers: dict[int, float], keys: list[str], most: float = 1.0, step: float = 0.1) -> DataFrame:
    """Positions times the multiplier of their code, one where there is none."""
    both = aligned(keys, position=position, regime=code)
    by = F.lit(1.0)
    for k, m in multipliers.items():
        by = F.when(F.col("regime") == k, m).otherwise(by)
    return both.select(*keys, "time_ms", stepped(F.coalesce("position", F.lit(0.0)) * by, most, step).alias("position"))


def regime_backtest(position: DataFrame, returns: DataFrame, regime: DataFrame, keys: list[str], c: S.BacktestConfig) -> DataFrame:
    """Trace over all times of the three tables; missing positions and returns count as zero."""
    df = aligned(keys, position=position, ret_1=returns, regime=regime)
    df = df.withColumns({x: F.coalesce(x, F.lit(0.0)) for x in ("position", "ret_1")})
    return S.backtest(df, keys, c)


def regime_performance(trace: DataFrame, keys: list[str]) -> DataFrame:
    """Bars, mean, deviation (ddof 0), their ratio and turnover of each known regime."""
    sd = F.stddev_pop("net_ret")
    return trace.where("regime is not null").groupBy(*keys, "regime").agg(
        F.count("*").alias("bars"), F.avg("net_ret").alias("mean_ret"), sd.alias("std_ret"), F.when(sd > 0, F.avg("net_ret") / sd).alias("sharpe_like"), F.avg("turnover").alias("turnover_mean"),
    )


def event_stats(df: DataFrame, by: list[str], count: str, ret: str) -> DataFrame:
    """Event counts of each regime: bars, bars with any, mean, median and p90 over those, maximum, share, mean absolute return in basis points."""
    x = F.col(count)
    some = F.when(x > 0, x)
    return df.groupBy(*by, "regime").agg(
        F.count("*").alias("bars"), F.count(some).alias("active"), F.avg(some).alias("mean_active"), F.percentile(some, 0.5).alias("median_active"), F.percentile(some, 0.9).alias("p90_active"),
        F.max(x).alias("most"), (100 * F.count(some) / F.count("*")).alias("active_pct"), (10_000 * F.avg(F.abs(ret))).alias("abs_ret_bp"),
    )

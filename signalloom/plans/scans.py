"""Registered queries of series that are cut into slices of time; their SQL is that of the plain ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.carried import Carry, carried, run_lengths
from ..functions.compiler import apply_formulas
from ..operators import portfolio as P
from ..operators import signals as S
from .core import CFG, HOUR, K, ORACLE_SQL, OVER, WB, bars, query, rounded, with_position

THREE_DAYS = 72 * HOUR


@query(ORACLE_SQL["ts_ema"])
def sliced_ema(spark, sf):
    return rounded(apply_formulas(bars(spark, sf), {"out": "ts_ema(close, 12)"}, K, width=THREE_DAYS).select("symbol", "time_ms", "out"), "out")


@query(ORACLE_SQL["equity_drawdown"])
def sliced_equity(spark, sf):
    t = S.drawdown(S.backtest(with_position(spark, sf), K, CFG, width=THREE_DAYS), K, width=THREE_DAYS)
    return t.where("equity <> 0").select("symbol", "time_ms", F.round(F.ln(F.abs("equity")), 5).alias("log_equity"), F.round(F.when(F.col("drawdown") > -1000, F.col("drawdown")), 5).alias("drawdown"))


@query(ORACLE_SQL["drawdown_run_length"])
def sliced_drawdown_runs(spark, sf):
    t = S.drawdown(S.backtest(with_position(spark, sf), K, CFG, width=THREE_DAYS), K, width=THREE_DAYS)
    return P.longest_drawdown(t, K, width=THREE_DAYS)


@query(ORACLE_SQL["nested_formula"])
def sliced_formula(spark, sf):
    """Nested bounded frames over overlapping parts that are dealt by carried row numbers."""
    return rounded(apply_formulas(bars(spark, sf), {"out": "ts_zscore(ts_std(close, 10), 10)"}, K, width=THREE_DAYS, chunk=100).select("symbol", "time_ms", "out"), "out")


@query(ORACLE_SQL["robust_zscore"])
def sliced_robust_zscore(spark, sf):
    return rounded(S.robust_zscore(bars(spark, sf), "close", "z", K, 24, 100, THREE_DAYS).select("symbol", "time_ms", "z"), "z")


@query(f"""{WB}, x AS (SELECT symbol, time_ms, close, CASE WHEN (time_ms // {HOUR}) % 5 = 0 THEN close END AS v FROM bars), g AS (SELECT *, sum((close < 50)::INT) OVER o AS s, sum((close >= 50)::INT) OVER o AS g FROM x WINDOW o AS ({OVER}))
SELECT symbol, time_ms, last_value(v IGNORE NULLS) OVER ({OVER}) AS newest, max(v) OVER ({OVER}) AS highest, s::BIGINT AS lows, row_number() OVER (PARTITION BY symbol, g ORDER BY time_ms) - (count(*) FILTER (close >= 50) OVER (PARTITION BY symbol, g)) AS run FROM g""")
def sliced_running_figures(spark, sf):
    """Newest known value, maximum, count and run length up to each bar, carried from slice to slice."""
    df = bars(spark, sf).withColumn("v", F.when(F.floor(F.col("time_ms") / HOUR) % 5 == 0, F.col("close")))
    low = F.col("close") < 50
    out = carried(df, {"newest": Carry("last", F.col("v")), "highest": Carry("max", F.col("v")), "lows": Carry("sum", low.cast("int"))}, K, "time_ms", THREE_DAYS)
    return run_lengths(out, low, "run", K, "time_ms", THREE_DAYS).select("symbol", "time_ms", "newest", "highest", "lows", "run")

"""Registered queries of the engine with their DuckDB equivalents.

The tables stand in for market data: an event's ``value`` is a price, its type a symbol,
its user a wallet.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.compiler import apply_formulas
from ..functions.libraries import FEATURES, flatten, library
from ..operators import bars as B
from ..operators import events as E
from ..operators import portfolio as P
from ..operators import quality as Q
from ..operators import regression as R
from ..operators import signals as S
from ..sources import payloads as L

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
K = ["symbol"]
HOUR = 3_600_000
CFG = S.BacktestConfig(deadband=0.25)


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("time_ms", B.time_ms("ts"))


def bars(spark: SparkSession, sf: str, step: int = HOUR) -> DataFrame:
    ev = events(spark, sf).withColumnRenamed("event_type", "symbol")
    return B.resample_ohlcv(ev, step, K, "value", "value", ["ts", "event_id"])


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


EV = "ev AS (SELECT *, epoch_us(ts) // 1000 AS time_ms FROM events)"


def bars_sql(step: int = HOUR, edge: str = "((time_ms + {s} - 1) // {s}) * {s}") -> str:
    return f"""{EV}, bars AS (
  SELECT event_type AS symbol, {edge.format(s=step)} AS time_ms, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
    arg_max(value, (ts, event_id)) AS close, sum(value) AS volume FROM ev WHERE value IS NOT NULL GROUP BY 1, 2)"""


WB = "WITH RECURSIVE " + bars_sql()
OVER = "PARTITION BY symbol ORDER BY time_ms"
RET = "ret AS (SELECT *, close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY time_ms), 0) - 1 AS ret_1 FROM bars)"


# Bars and formulas ------------------------------------------------------------------


@query(f"WITH {bars_sql(900_000)} SELECT symbol, time_ms, open, high, low, close, round(volume, 6) AS volume FROM bars")
def resample_ohlcv_15m(spark, sf):
    return rounded(bars(spark, sf, 900_000), "volume")


@query(f"WITH {bars_sql(900_000, '(time_ms // {s}) * {s}')} SELECT symbol, time_ms, open, high, low, close, round(volume, 6) AS volume FROM bars")
def resample_left_15m(spark, sf):
    ev = events(spark, sf).withColumnRenamed("event_type", "symbol")
    return rounded(B.resample_ohlcv(ev, 900_000, K, "value", "value", ["ts", "event_id"], closed="left"), "volume")


def formula(name: str, text: str, sql: str, before: str = "") -> None:
    """A query of one formula over the hourly bars, with its SQL expression."""

    def run(spark, sf):
        return rounded(apply_formulas(bars(spark, sf), {"out": text}, K).select("symbol", "time_ms", "out"), "out")

    QUERIES[name] = run
    if sql:
        ORACLE_SQL[name] = f"{WB} {before} SELECT symbol, time_ms, round(({sql})::DOUBLE, 6) AS out FROM bars WINDOW w AS ({OVER} ROWS 9 PRECEDING), o AS ({OVER}), a AS (PARTITION BY symbol)"


def full(e: str, x: str = "close") -> str:
    return f"CASE WHEN count({x}) OVER w = 10 THEN {e} END"


formula("ts_delay", "ts_delay(close, 3)", "lag(close, 3) OVER o")
formula("last", "last(close)", f"last_value(close IGNORE NULLS) OVER ({OVER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
formula("ts_delta", "ts_delta(close, 5)", "close - lag(close, 5) OVER o")
formula("ts_returns", "ts_returns(close, 2)", "close / nullif(lag(close, 2) OVER o, 0) - 1")
for _n, _f in {"mean": "avg", "std": "stddev_samp", "sum": "sum", "min": "min", "max": "max"}.items():
    formula(f"ts_{_n}", f"ts_{_n}(close, 10)", full(f"{_f}(close) OVER w"))
formula("ts_zscore", "ts_zscore(close, 10)", full("(close - avg(close) OVER w) / nullif(stddev_samp(close) OVER w, 0)"))
formula("ts_corr", "ts_corr(close, volume, 10)", full("corr(close, volume) OVER w"))
formula("ts_cov", "ts_cov(close, volume, 10)", full("covar_samp(close, volume) OVER w"))
formula("ts_beta", "ts_beta(close, volume, 10)", full("covar_samp(close, volume) OVER w / nullif(var_samp(volume) OVER w, 0)"))
formula("ts_quantile", "ts_quantile(close, 10, 0.3)", full("quantile_cont(close, 0.3) OVER w"))
formula("ts_skew", "ts_skew(close, 10)", full("skewness(close) OVER w"))
formula("ts_kurt", "ts_kurt(close, 10)", full("kurtosis(close) OVER w"))
formula("ts_rank", "ts_rank(close, 10)", full("(len(list_filter(list(close) OVER w, lambda v: v < close)) + (len(list_filter(list(close) OVER w, lambda v: v = close)) + 1) / 2) / 10"))
formula("ts_decay", "ts_decay(close, 10)", full("list_sum(list_transform(list(close) OVER w, lambda v, i: v * i)) / 55"))
formula("rank_pct", "rank(close)", "(rank() OVER (PARTITION BY symbol ORDER BY close) + (count(*) OVER (PARTITION BY symbol, close) - 1) / 2) / count(close) OVER a")
formula("scale", "scale(close, 2)", "2 * close / nullif(sum(abs(close)) OVER a, 0)")
formula("winsorize", "winsorize(close, 0.05, 0.95)", "least(greatest(close, quantile_cont(close, 0.05) OVER a), quantile_cont(close, 0.95) OVER a)")
formula("signed_power", "signed_power(open - close, 0.5)", "sign(open - close) * sqrt(abs(open - close))")
formula("clip", "clip(close, 10, 50)", "least(greatest(close, 10), 50)")
formula("safe_div", "safe_div(volume, close - low)", "volume / nullif(close - low, 0)")
formula("ifcond", "ifcond(close > open, volume, -volume)", "CASE WHEN close > open THEN volume ELSE -volume END")
formula("plain_functions", "log(volume) + sqrt(close) + abs(open - close) + exp(-close)", "ln(nullif(volume, 0)) + sqrt(close) + abs(open - close) + exp(-close)")
formula("nested_formula", "ts_zscore(ts_std(close, 10), 10)", "CASE WHEN count(s) OVER w = 10 THEN (s - avg(s) OVER w) / nullif(stddev_samp(s) OVER w, 0) END")
ORACLE_SQL["nested_formula"] = ORACLE_SQL["nested_formula"].replace("FROM bars WINDOW", f"FROM (SELECT *, CASE WHEN count(close) OVER v = 10 THEN stddev_samp(close) OVER v END AS s FROM bars WINDOW v AS ({OVER} ROWS 9 PRECEDING)) WINDOW")
EMA = """, n AS (SELECT symbol, time_ms, close AS x, row_number() OVER (PARTITION BY symbol ORDER BY time_ms) AS r FROM bars),
ema AS (SELECT symbol, time_ms, r, x AS e FROM n WHERE r = 1 UNION ALL SELECT n.symbol, n.time_ms, n.r, e + (n.x - e) * 2 / 13.0::DOUBLE FROM ema JOIN n ON n.symbol = ema.symbol AND n.r = ema.r + 1)"""
formula("ts_ema", "ts_ema(close, 12)", "")
ORACLE_SQL["ts_ema"] = f"{WB} {EMA} SELECT symbol, time_ms, round(CASE WHEN r >= 12 THEN e END, 6) AS out FROM ema"


@query(f"{WB} SELECT symbol, time_ms, " + ", ".join(f"round(CASE WHEN count(close) OVER w = 20 THEN {e} END, 6) AS {n}" for n, e in {"bb_mid": "avg(close) OVER w", "bb_upper": "avg(close) OVER w + 2 * stddev_pop(close) OVER w", "bb_lower": "avg(close) OVER w - 2 * stddev_pop(close) OVER w"}.items()) + f" FROM bars WINDOW w AS ({OVER} ROWS 19 PRECEDING)")
def bollinger(spark, sf):
    return rounded(B.bollinger(bars(spark, sf), K).select("symbol", "time_ms", "bb_mid", "bb_upper", "bb_lower"), "bb_mid", "bb_upper", "bb_lower")


@query(f"{WB}, t AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER o), abs(low - lag(close) OVER o)) AS tr FROM bars WINDOW o AS ({OVER})) SELECT symbol, time_ms, round(tr, 6) AS tr, round(CASE WHEN count(tr) OVER w = 14 THEN avg(tr) OVER w END, 6) AS atr_14 FROM t WINDOW w AS ({OVER} ROWS 13 PRECEDING)")
def true_range(spark, sf):
    return rounded(B.true_range(bars(spark, sf), K).select("symbol", "time_ms", "tr", "atr_14"), "tr", "atr_14")


def _smooth(source: str, name: str, alpha: str, x: str) -> str:
    return f"""{name}_n AS (SELECT symbol, time_ms, {x} AS x, row_number() OVER (PARTITION BY symbol ORDER BY time_ms) AS r FROM {source} WHERE {x} IS NOT NULL),
{name} AS (SELECT symbol, time_ms, r, x AS e FROM {name}_n WHERE r = 1 UNION ALL SELECT n.symbol, n.time_ms, n.r, e + (n.x - e) * {alpha} FROM {name} q JOIN {name}_n n ON n.symbol = q.symbol AND n.r = q.r + 1)"""


@query(f"""{WB}, d AS (SELECT symbol, time_ms, close - lag(close) OVER ({OVER}) AS s FROM bars), g AS (SELECT symbol, time_ms, CASE WHEN s > 0 THEN s WHEN s IS NOT NULL THEN 0 END AS up, CASE WHEN s < 0 THEN -s WHEN s IS NOT NULL THEN 0 END AS down FROM d),
{_smooth("g", "u", "(1 / 14.0::DOUBLE)", "up")}, {_smooth("g", "v", "(1 / 14.0::DOUBLE)", "down")}
SELECT b.symbol, b.time_ms, round(CASE WHEN u.r >= 14 THEN 100 - 100 / (1 + u.e / nullif(v.e, 0)) END, 6) AS rsi_14 FROM bars b LEFT JOIN u USING (symbol, time_ms) LEFT JOIN v USING (symbol, time_ms)""")
def rsi(spark, sf):
    return rounded(B.rsi(bars(spark, sf), K).select("symbol", "time_ms", "rsi_14"), "rsi_14")


@query(f"""{WB}, {_smooth("bars", "f", "(2 / 13.0::DOUBLE)", "close")}, {_smooth("bars", "s", "(2 / 27.0::DOUBLE)", "close")},
m AS (SELECT f.symbol, f.time_ms, CASE WHEN s.r >= 26 THEN f.e - s.e END AS macd FROM f JOIN s USING (symbol, time_ms)), {_smooth("m", "g", "(2 / 10.0::DOUBLE)", "macd")}
SELECT m.symbol, m.time_ms, round(macd, 6) AS macd, round(CASE WHEN g.r >= 9 THEN g.e END, 6) AS macd_signal, round(macd - CASE WHEN g.r >= 9 THEN g.e END, 6) AS macd_hist FROM m LEFT JOIN g USING (symbol, time_ms)""")
def macd(spark, sf):
    return rounded(B.macd(bars(spark, sf), K).select("symbol", "time_ms", "macd", "macd_signal", "macd_hist"), "macd", "macd_signal", "macd_hist")


# Signals, backtests -----------------------------------------------------------------

Z = f"z AS (SELECT *, CASE WHEN count(close) OVER w = 24 THEN (close - avg(close) OVER w) / nullif(stddev_samp(close) OVER w, 0) END AS z FROM ret WINDOW w AS ({OVER} ROWS 23 PRECEDING))"
POS = "pos AS (SELECT *, round_even(round(tanh((CASE WHEN c >= 0.25 THEN c WHEN c <= -0.25 THEN c ELSE 0 END) / 2.5) / 0.1, 9), 0) * 0.1::DOUBLE AS position FROM (SELECT *, CASE WHEN z > 2.5 THEN 2.5 WHEN z < -2.5 THEN -2.5 ELSE z END AS c FROM z))"
TRACE = f"""held AS (SELECT *, coalesce(lag(position) OVER ({OVER}), 0) AS held FROM pos),
turn AS (SELECT *, coalesce(abs(held - lag(held) OVER ({OVER})), 0) AS turnover, held * coalesce(ret_1, 0) AS gross_ret FROM held),
net AS (SELECT *, turnover * 0.0004::DOUBLE AS cost_ret, gross_ret - turnover * 0.0004::DOUBLE AS net_ret FROM turn),
eq AS (SELECT *, product(1 + net_ret) OVER ({OVER} ROWS UNBOUNDED PRECEDING) AS equity FROM net),
trace AS (SELECT *, equity / max(equity) OVER ({OVER} ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM eq)"""
WT = f"{WB}, {RET}, {Z}, {POS}, {TRACE}"


def with_position(spark, sf) -> DataFrame:
    df = apply_formulas(bars(spark, sf), {"ret_1": "ts_returns(close, 1)", "z": "ts_zscore(close, 24)"}, K)
    return df.withColumn("position", S.position(F.col("z"), CFG))


def trace(spark, sf) -> DataFrame:
    return S.drawdown(S.backtest(with_position(spark, sf), K, CFG), K)


@query(f"{WB}, {RET}, {Z}, {POS} SELECT symbol, time_ms, round(z, 6) AS z, round(position, 6) AS position FROM pos")
def position_tanh(spark, sf):
    return rounded(with_position(spark, sf).select("symbol", "time_ms", "z", "position"), "z", "position")


@query(f"{WB}, {RET}, {Z} SELECT symbol, time_ms, CASE WHEN z >= 0.25 THEN 1.0::DOUBLE WHEN z <= -0.25 THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS position FROM z")
def position_sign(spark, sf):
    return with_position(spark, sf).select("symbol", "time_ms", S.position(F.col("z"), CFG, "sign").alias("position"))


@query(f"""{WB}, m AS (SELECT *, CASE WHEN count(close) OVER w = 24 THEN median(close) OVER w END AS med FROM bars WINDOW w AS ({OVER} ROWS 23 PRECEDING)), d AS (SELECT *, abs(close - med) AS dev FROM m),
k AS (SELECT *, CASE WHEN count(dev) OVER w = 24 THEN median(dev) OVER w END AS mad FROM d WINDOW w AS ({OVER} ROWS 23 PRECEDING)) SELECT symbol, time_ms, round((close - med) / (1.4826::DOUBLE * nullif(mad, 0)), 6) AS z FROM k""")
def robust_zscore(spark, sf):
    return rounded(S.robust_zscore(bars(spark, sf), "close", "z", K, 24).select("symbol", "time_ms", "z"), "z")


@query(f"{WT} SELECT symbol, time_ms, round(gross_ret, 6) AS gross_ret, round(cost_ret, 6) AS cost_ret, round(net_ret, 6) AS net_ret, round(turnover, 6) AS turnover FROM trace")
def net_return_costs(spark, sf):
    return rounded(trace(spark, sf).select("symbol", "time_ms", "gross_ret", "cost_ret", "net_ret", "turnover"), "gross_ret", "cost_ret", "net_ret", "turnover")


@query(f"{WT} SELECT symbol, time_ms, round(ln(abs(equity)), 5) AS log_equity, round(CASE WHEN drawdown > -1000 THEN drawdown END, 5) AS drawdown FROM trace WHERE equity <> 0")
def equity_drawdown(spark, sf):
    return trace(spark, sf).where("equity <> 0").select("symbol", "time_ms", F.round(F.ln(F.abs("equity")), 5).alias("log_equity"), F.round(F.when(F.col("drawdown") > -1000, F.col("drawdown")), 5).alias("drawdown"))


METRICS_SQL = """count(*) AS bars, round(avg(net_ret) * 8760, 4) AS ann_ret, round(stddev_pop(net_ret) * sqrt(8760), 4) AS ann_vol, round(avg((net_ret > 0)::INT), 6) AS hit_rate,
round(avg(net_ret) * 8760 / nullif(stddev_pop(net_ret) * sqrt(8760), 0), 6) AS sharpe, round(avg(turnover), 6) AS avg_turnover, round(sum(net_ret) FILTER (net_ret > 0) / nullif(-sum(net_ret) FILTER (net_ret < 0), 0), 6) AS profit_factor"""
METRICS = ["bars", "ann_ret", "ann_vol", "hit_rate", "sharpe", "avg_turnover", "profit_factor"]


def shown(m: DataFrame, by: list[str]) -> DataFrame:
    return rounded(rounded(m.select(*by, *METRICS), "ann_ret", "ann_vol", digits=4), "hit_rate", "sharpe", "avg_turnover", "profit_factor")


@query(f"{WT} SELECT symbol, {METRICS_SQL} FROM trace GROUP BY symbol")
def strategy_metrics(spark, sf):
    return shown(S.metrics(trace(spark, sf), K, CFG), K)


@query(f"""{WT}, seg AS (SELECT *, CASE WHEN row_number() OVER ({OVER}) > n - greatest(1, least(round_even(n * 0.2, 0), n - 1)) THEN 'test' ELSE 'train' END AS segment FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM trace))
SELECT symbol, segment, {METRICS_SQL} FROM seg GROUP BY symbol, segment""")
def train_test_metrics(spark, sf):
    return shown(S.metrics(S.split_last(trace(spark, sf), K, 0.2), [*K, "segment"], CFG), [*K, "segment"])


@query(f"""{WT}, f AS (SELECT *, CASE WHEN n >= 120 THEN least((row_number() OVER ({OVER}) - 1) // greatest(n // 6, 1), 5) END AS fold FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM trace)),
s AS (SELECT symbol, fold, avg(net_ret) / nullif(stddev_pop(net_ret), 0) * sqrt(8760) AS s FROM f WHERE fold IS NOT NULL GROUP BY ALL),
b AS (SELECT symbol, avg(net_ret) / nullif(stddev_pop(net_ret), 0) * sqrt(8760) AS base FROM trace GROUP BY symbol), w AS (SELECT symbol, min(s) AS lo, avg(s) AS mid, stddev_pop(s) AS sd FROM s GROUP BY symbol)
SELECT symbol, round(lo, 6) AS wf_min, round(mid, 6) AS wf_mean, round(sd, 6) AS wf_std, round(base + 0.45 * lo - 0.25 * sd, 6) AS robust_score FROM b LEFT JOIN w USING (symbol)""")
def walk_forward_folds(spark, sf):
    return rounded(S.walk_forward(trace(spark, sf), K, 6, CFG), "wf_min", "wf_mean", "wf_std", "robust_score")


@query(f"{WT}, a AS (SELECT symbol, abs(coalesce(position, 0)) > 1e-12 AS a, lag(abs(coalesce(position, 0)) > 1e-12, 1, false) OVER ({OVER}) AS b FROM trace) SELECT symbol, count(*) FILTER (a AND NOT b) AS triggers FROM a GROUP BY symbol")
def trigger_count(spark, sf):
    return S.triggers(with_position(spark, sf), K)


def signal_table(spark, sf) -> DataFrame:
    """All library signals in long form with their positions."""
    wide = apply_formulas(bars(spark, sf), FEATURES | flatten(library()), K)
    names = [*flatten(library())]
    long = wide.unpivot([*K, "time_ms", "ret_1"], names, "signal", "raw")
    return S.robust_zscore(long, "raw", "z", [*K, "signal"], 24).withColumn("position", S.position(F.col("z"), CFG))


@query()
def signal_sweep(spark, sf):
    """Metrics of every library signal; no SQL: the formula families expand to dozens of nested windows."""
    keys = [*K, "signal"]
    tr = S.drawdown(S.backtest(signal_table(spark, sf), keys, CFG), keys)
    return shown(S.metrics(tr, keys, CFG), keys)


@query()
def best_signals(spark, sf):
    """The best signal of each symbol by robust score."""
    keys = [*K, "signal"]
    tr = S.backtest(signal_table(spark, sf), keys, CFG)
    return rounded(S.select_best(S.walk_forward(tr, keys, 6, CFG), K, "robust_score"), "wf_min", "wf_mean", "wf_std", "robust_score")


@query(f"""{WB}, slow AS (SELECT symbol, time_ms, close AS position FROM bars WHERE time_ms % 14400000 = 0), c AS (SELECT b.symbol, b.time_ms, s.position FROM bars b ASOF LEFT JOIN slow s ON b.symbol = s.symbol AND b.time_ms >= s.time_ms)
SELECT symbol, time_ms, coalesce(position, 0) AS position FROM c""")
def asof_upsample(spark, sf):
    fast = bars(spark, sf)
    slow = fast.where(F.col("time_ms") % (4 * HOUR) == 0).select(*K, "time_ms", F.col("close").alias("position"))
    return S.asof_backward(slow, fast, K, "position")


@query(f"""{WB}, p AS (SELECT event_id, event_type AS symbol, time_ms FROM ev),
a AS (SELECT p.*, b.time_ms AS t, b.close AS v FROM p ASOF LEFT JOIN bars b ON p.symbol = b.symbol AND p.time_ms >= b.time_ms), f AS (SELECT a.*, b.time_ms AS t2, b.close AS v2 FROM a ASOF LEFT JOIN bars b ON a.symbol = b.symbol AND a.time_ms <= b.time_ms)
SELECT symbol, time_ms, CASE WHEN t IS NULL OR t2 - time_ms < time_ms - t THEN v2 ELSE v END AS close, CASE WHEN t IS NULL OR t2 - time_ms < time_ms - t THEN t2 ELSE t END AS bar_ms FROM f""")
def nearest_marker(spark, sf):
    points = events(spark, sf).select(F.col("event_type").alias("symbol"), "time_ms")
    return S.nearest(points, bars(spark, sf), K, "close")


# Allocation, regimes, diagnostics ---------------------------------------------------


@query(f"{WT} SELECT time_ms, round(greatest(least(avg(position), 1), -1), 6) AS position, count(position) AS signals FROM trace GROUP BY time_ms")
def equal_weight_ensemble(spark, sf):
    return rounded(P.equal_weight(with_position(spark, sf), ["time_ms"]), "position")


VOL = f"vol AS (SELECT *, CASE WHEN count(*) OVER w >= 12 THEN stddev_pop(net_ret) OVER w * sqrt(8760) END AS ann_vol FROM trace WINDOW w AS ({OVER} ROWS 47 PRECEDING))"


def volatile(spark, sf) -> DataFrame:
    return P.rolling_ann_vol(trace(spark, sf), K, 48, 8760)


@query(f"{WT}, {VOL} SELECT symbol, time_ms, round(ann_vol, 5) AS ann_vol FROM vol")
def rolling_ann_vol(spark, sf):
    return volatile(spark, sf).select("symbol", "time_ms", F.round("ann_vol", 5).alias("ann_vol"))


@query(f"""{WT}, {VOL}, l AS (SELECT *, CASE WHEN ann_vol IS NOT NULL THEN least(0.5 / greatest(ann_vol, 0.05), 3) END AS l FROM vol)
SELECT symbol, time_ms, round(coalesce(last_value(l IGNORE NULLS) OVER p, first_value(l IGNORE NULLS) OVER q, 1), 6) AS leverage, round(position * coalesce(last_value(l IGNORE NULLS) OVER p, first_value(l IGNORE NULLS) OVER q, 1), 6) AS scaled
FROM l WINDOW p AS ({OVER} ROWS UNBOUNDED PRECEDING), q AS ({OVER} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")
def vol_target(spark, sf):
    return rounded(P.vol_target(volatile(spark, sf), K, 0.5).select("symbol", "time_ms", "leverage", "scaled"), "leverage", "scaled")


@query(f"{WT}, {VOL}, r AS (SELECT *, 1 / (ann_vol + 1e-9) AS raw FROM vol) SELECT symbol, time_ms, round(CASE WHEN sum(raw) OVER w IS NOT NULL THEN coalesce(raw, 0) / sum(raw) OVER w ELSE 1 / count(*) OVER w END, 6) AS weight FROM r WINDOW w AS (PARTITION BY time_ms)")
def inverse_vol_weights(spark, sf):
    return rounded(P.inverse_vol_weights(volatile(spark, sf), ["time_ms"]).select("symbol", "time_ms", "weight"), "weight")


REG = f"reg AS (SELECT *, CASE WHEN 3 * (r - 1) < n - 1 THEN 0 WHEN 3 * (r - 1) < 2 * (n - 1) THEN 1 ELSE 2 END AS regime FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY volume, time_ms) AS r, count(*) OVER (PARTITION BY symbol) AS n FROM trace))"


def regimes(spark, sf) -> DataFrame:
    return P.vol_regime(trace(spark, sf), K, "volume")


@query(f"{WT}, {REG} SELECT symbol, time_ms, regime FROM reg")
def vol_regime_qcut(spark, sf):
    return regimes(spark, sf).select("symbol", "time_ms", "regime")


@query(f"{WT}, {REG} SELECT symbol, regime, count(*) AS bars, round(avg(net_ret), 6) AS mean_ret, round(stddev_pop(net_ret), 6) AS sd_ret, round(avg(turnover), 6) AS turnover FROM reg GROUP BY symbol, regime")
def regime_summary(spark, sf):
    return rounded(P.regime_summary(regimes(spark, sf), K), "mean_ret", "sd_ret", "turnover")


@query(f"{WT}, {REG} SELECT symbol, round(avg(net_ret) FILTER (regime = 0), 6) AS regime_0, round(avg(net_ret) FILTER (regime = 1), 6) AS regime_1, round(avg(net_ret) FILTER (regime = 2), 6) AS regime_2 FROM reg GROUP BY symbol")
def regime_pivot(spark, sf):
    return rounded(P.regime_pivot(regimes(spark, sf), K), "regime_0", "regime_1", "regime_2")


@query(f"""{WB}, h AS (SELECT symbol, time_ms, volume, list(volume) OVER ({OVER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM bars)
SELECT symbol, time_ms, CASE WHEN len(seen) >= 30 THEN CASE WHEN volume <= list_aggregate(seen, 'quantile_cont', 1 / 3.0::DOUBLE) THEN 0 WHEN volume <= list_aggregate(seen, 'quantile_cont', 2 / 3.0::DOUBLE) THEN 1 ELSE 2 END END AS regime FROM h""")
def expanding_regime(spark, sf):
    return P.expanding_regime(bars(spark, sf), K, "volume").select("symbol", "time_ms", "regime")


@query(f"{WT} SELECT symbol, round(sum(CASE WHEN held > 0 THEN gross_ret ELSE 0 END), 6) AS long_pnl, round(sum(CASE WHEN held < 0 THEN gross_ret ELSE 0 END), 6) AS short_pnl, round(sum(cost_ret), 6) AS fees, round(sum(net_ret), 6) AS net FROM trace GROUP BY symbol")
def pnl_decomposition(spark, sf):
    return rounded(P.pnl_decomposition(trace(spark, sf), K), "long_pnl", "short_pnl", "fees", "net")


@query(f"{WT} SELECT symbol, round(avg(position), 6) AS mean_pos, round(avg(abs(position)), 6) AS mean_abs, round(avg(CASE WHEN position > 0 THEN 1 ELSE 0 END), 6) AS long_share, round(avg(CASE WHEN position < 0 THEN 1 ELSE 0 END), 6) AS short_share, round(max(abs(position)), 6) AS max_abs FROM trace GROUP BY symbol")
def position_stats(spark, sf):
    return rounded(P.position_stats(with_position(spark, sf), K), "mean_pos", "mean_abs", "long_share", "short_share", "max_abs")


@query(f"""{WT}, m AS (SELECT symbol, time_ms, CASE WHEN b > 0.02 THEN 1 WHEN b < -0.02 THEN -1 ELSE 0 END AS a, CASE WHEN position > 0.02 THEN 1 WHEN position < -0.02 THEN -1 ELSE 0 END AS b FROM (SELECT symbol, time_ms, position, coalesce(lag(position) OVER ({OVER}), 0) AS b FROM trace))
SELECT symbol, time_ms, CASE WHEN a = 0 THEN CASE WHEN b > 0 THEN 'open_long' ELSE 'open_short' END WHEN b = 0 THEN 'close' ELSE 'flip' END AS marker FROM m WHERE a <> b""")
def trade_markers(spark, sf):
    return P.trade_markers(with_position(spark, sf), K)


@query(f"{WT}, g AS (SELECT symbol, (drawdown < 0)::INT AS u, sum(1 - (drawdown < 0)::INT) OVER ({OVER}) AS g FROM trace), n AS (SELECT symbol, g, sum(u) AS n FROM g GROUP BY ALL) SELECT symbol, max(n) AS longest FROM n GROUP BY symbol")
def drawdown_run_length(spark, sf):
    return P.longest_drawdown(trace(spark, sf), K)


@query(f"{WB}, {RET} SELECT * FROM (SELECT 'close' AS a, 'volume' AS b, round(corr(close, volume), 6) AS corr FROM ret UNION ALL SELECT 'close', 'ret_1', round(corr(close, ret_1), 6) FROM ret UNION ALL SELECT 'volume', 'ret_1', round(corr(volume, ret_1), 6) FROM ret)")
def correlation_pairs(spark, sf):
    df = apply_formulas(bars(spark, sf), {"ret_1": "ts_returns(close, 1)"}, K)
    return rounded(P.correlation_pairs(df, ["close", "volume", "ret_1"]), "corr")


def regressed(spark, sf) -> DataFrame:
    df = apply_formulas(bars(spark, sf), {"ret_1": "ts_returns(close, 1)", "z": "ts_zscore(close, 24)", "v": "ts_zscore(volume, 24)"}, K)
    df = df.withColumn("target", F.lead("ret_1").over(Window.partitionBy(*K).orderBy("time_ms")))
    return S.split_last(df, K, 0.3)


SCORED = lambda x: f"CASE WHEN count({x}) OVER w = 24 THEN ({x} - avg({x}) OVER w) / nullif(stddev_samp({x}) OVER w, 0) END"
OLS = f"""{WB}, {RET}, x AS (SELECT symbol, time_ms, {SCORED("close")} AS z, {SCORED("volume")} AS v, lead(ret_1) OVER ({OVER}) AS y, row_number() OVER ({OVER}) AS r, count(*) OVER (PARTITION BY symbol) AS n FROM ret WINDOW w AS ({OVER} ROWS 23 PRECEDING)),
seg AS (SELECT y, z, v, CASE WHEN r > n - greatest(1, least(round_even(n * 0.3, 0), n - 1)) THEN 'test' ELSE 'train' END AS segment FROM x WHERE y IS NOT NULL AND z IS NOT NULL AND v IS NOT NULL),
m AS (SELECT avg(y) AS my, avg(z) AS mz, avg(v) AS mv, count(*) AS tn, covar_pop(y, z) AS cyz, covar_pop(y, v) AS cyv, covar_pop(z, v) AS czv, var_pop(y) AS vy, var_pop(z) AS vz, var_pop(v) AS vv FROM seg WHERE segment = 'train'),
b AS (SELECT *, cyz / vz AS b1, (cyz * vv - cyv * czv) / (vz * vv - czv * czv) AS bz, (cyv * vz - cyz * czv) / (vz * vv - czv * czv) AS bv FROM m),
g AS (SELECT *, (cyv - b1 * czv) / vv AS g, my - b1 * mz AS a1, my - bz * mz - bv * mv AS aj FROM b),
p AS (SELECT seg.*, g.*, a1 + b1 * z AS p1, g * (v - mv) AS p2, aj + bz * z + bv * v AS pj FROM seg, g),
sse AS (SELECT segment, count(*) AS n, sum((y - p1) ** 2) AS e1, sum((y - p1 - p2) ** 2) AS e2, sum((y - pj) ** 2) AS ej, sum((y - my) ** 2) AS tot, var_pop(y) * count(*) AS own, corr(y, p1) AS c1, corr(y, pj) AS cj, any_value(g) AS g, any_value(vv) AS vv FROM p GROUP BY segment),
one AS (SELECT a.*, b.e1 AS t1, b.ej AS tj, b.own AS town, b.c1 AS tc1, b.cj AS tcj, (a.e1 - a.ej) / (a.ej / (a.n - 3)) AS f, a.g / sqrt(a.e2 / (a.n - 2) / (a.n * a.vv)) AS t FROM sse a, sse b WHERE a.segment = 'train' AND b.segment = 'test')"""


def tail_sql(statistic: str, free: str) -> str:
    """Two-sided probability of a t statistic in SQL: the incomplete beta function's continued fraction, from its last term back."""
    a, b, x = "0.5::DOUBLE", f"(({free}) / 2.0::DOUBLE)", f"(({statistic}) ** 2 / (({free}) + ({statistic}) ** 2))"
    term = f"CASE WHEN k % 2 = 0 THEN (k // 2) * ({b} - k // 2) * {x} / (({a} + k - 1) * ({a} + k)) ELSE -({a} + k // 2) * ({a} + {b} + k // 2) * {x} / (({a} + k - 1) * ({a} + k)) END"
    fraction = f"list_reduce(list_prepend(1.0::DOUBLE, list_transform(range(300, 0, -1), lambda k: {term})), lambda acc, d: 1 + d / acc)"
    return f"1 - exp(lgamma({a} + {b}) - lgamma({a}) - lgamma({b}) + {a} * ln({x}) + {b} * ln(1 - {x})) / ({a} * {fraction})"


@query(f"{OLS} SELECT segment, n, round(1 - e1 / tot, 6) AS r2_base, round(1 - e2 / tot, 6) AS r2_two_stage, round(1 - ej / tot, 6) AS r2_joint, CASE WHEN segment = 'train' THEN round((e1 - ej) / (ej / (n - 3)), 6) END AS block_f FROM sse")
def ols_two_stage(spark, sf):
    """Two-stage regression of the next return on one column and then another."""
    return rounded(R.two_stage_ols(regressed(spark, sf), "target", ["z"], ["v"]), "r2_base", "r2_two_stage", "r2_joint", "block_f")


@query(f"{OLS} SELECT 'v' AS signal, round(g, 9) AS coef, round(t, 6) AS t, round({tail_sql('t', 'n - 2')}, 6) AS p FROM one")
def ols_coefficients(spark, sf):
    """t and p of the second stage's column."""
    return rounded(rounded(R.ols_coefficients(regressed(spark, sf), "target", ["z"], ["v"]), "t", "p"), "coef", digits=9)


@query(f"""{OLS}, r AS (SELECT 1 - e1 / tot AS a, 1 - ej / tot AS b, f, {tail_sql('sqrt(f)', 'n - 3')} AS p, 1 - e2 / e1 AS s, 1 - t1 / town AS c, 1 - tj / town AS d, tc1, tcj FROM one)
SELECT unnest(range(0, 11)) AS place, unnest({list(R.SUMMARY)}) AS metric, unnest([round(a, 6), round(b, 6), round(b - a, 6), round(f, 6), round(p, 6), round(s, 6), round(c, 6), round(d, 6), round(d - c, 6), round(tc1, 6), round(tcj, 6)]) AS value FROM r""")
def ols_block_test(spark, sf):
    """R2 in and out of sample, the F test of the added block with its probability, correlations of predictions."""
    return rounded(R.ols_summary(regressed(spark, sf), "target", ["z"], ["v"]), "value")


# Quality, alignment -----------------------------------------------------------------


@query(f"""{WB}, s AS (SELECT *, sum(f) OVER ({OVER}) AS segment FROM (SELECT *, coalesce((time_ms - lag(time_ms) OVER ({OVER}) > {HOUR})::INT, 0) AS f FROM bars))
SELECT symbol, segment, min(time_ms) AS start_ms, max(time_ms) AS end_ms, count(*) AS rows FROM s GROUP BY symbol, segment""")
def gap_segments(spark, sf):
    return Q.segments(bars(spark, sf), K, HOUR)


@query(f"{WB}, n AS (SELECT symbol, time_ms, lead(time_ms) OVER ({OVER}) AS x FROM bars) SELECT symbol, unnest(range(time_ms + {HOUR}, x, {HOUR})) AS time_ms FROM n WHERE x - time_ms > {HOUR}")
def missing_points(spark, sf):
    return Q.missing_points(bars(spark, sf), K, HOUR)


@query(f"""{WB}, g AS (SELECT *, time_ms - lag(time_ms) OVER ({OVER}) AS gap FROM bars), r AS (SELECT symbol, count(*) AS rows, count(time_ms) AS valid_rows, count(time_ms) - count(DISTINCT time_ms) AS duplicates, coalesce(sum(greatest(gap // {HOUR} - 1, 0)), 0)::BIGINT AS missing,
max(gap) AS max_gap_ms, min(time_ms) AS start_ms, max(time_ms) AS end_ms FROM g GROUP BY symbol) SELECT *, round(100.0::DOUBLE * (valid_rows - duplicates) / (valid_rows - duplicates + missing), 4) AS coverage_pct, CASE WHEN valid_rows = 0 THEN 'FAIL' WHEN missing > 0 OR duplicates > 0 THEN 'WARN' ELSE 'OK' END AS status FROM r""")
def validation_report(spark, sf):
    return Q.validation_report(bars(spark, sf), K, HOUR)


@query(f"{WB}, g AS (SELECT symbol, lag(time_ms) OVER ({OVER}) AS a, time_ms AS b FROM bars), k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY a) AS r FROM g WHERE b - a > {HOUR}) SELECT symbol, string_agg(a || '->' || b, ';' ORDER BY a) AS gaps FROM k WHERE r <= 20 GROUP BY symbol")
def gap_text(spark, sf):
    return Q.gap_text(bars(spark, sf), K, HOUR)


@query(f"{WB}, s AS (SELECT *, sum(f) OVER ({OVER}) AS g FROM (SELECT *, coalesce((time_ms - lag(time_ms) OVER ({OVER}) > {3 * HOUR})::INT, 0) AS f FROM bars)) SELECT symbol, time_ms, close FROM s QUALIFY g = max(g) OVER (PARTITION BY symbol)")
def latest_segment(spark, sf):
    return Q.latest_segment(bars(spark, sf), K, 3 * HOUR).select("symbol", "time_ms", "close")


NAMES = ["click", "error", "purchase", "signup", "view"]  # the event types
ALIGN = "al AS (SELECT time_ms, " + ", ".join(f"max(close) FILTER (symbol = '{n}') AS {n}" for n in NAMES) + " FROM bars GROUP BY time_ms)"


EVERY = " AND ".join(f"{n} IS NOT NULL" for n in NAMES)


def aligned(spark, sf) -> DataFrame:
    b = bars(spark, sf)
    tables = {s: b.where(F.col("symbol") == s).select("time_ms", "close") for s in NAMES}
    return Q.align(tables, []).select("time_ms", *(F.col(f"{s}__close").alias(s) for s in NAMES))


@query(f"{WB}, {ALIGN} SELECT * FROM al")
def align_full_outer(spark, sf):
    return aligned(spark, sf)


@query(f"{WB}, {ALIGN}, f AS (SELECT min(time_ms) AS t FROM al WHERE {EVERY}) SELECT al.* FROM al, f WHERE time_ms >= t AND {EVERY}")
def clean_table(spark, sf):
    return Q.clean_table(aligned(spark, sf), [], NAMES, 1000 * HOUR, 72 * HOUR)


def aligned_sql(step: int, freq: str) -> str:
    b = bars_sql(step).split(", bars AS (", 1)[1].removesuffix(")")
    return f"SELECT '{freq}' AS freq, time_ms, " + ", ".join(f"max(close) FILTER (symbol = '{n}') AS {n}" for n in NAMES) + f" FROM ({b}) GROUP BY time_ms"


FREQUENCIES = {"15m": HOUR // 4, "30m": HOUR // 2, "1h": HOUR, "4h": 4 * HOUR}


@query(f"""WITH {EV}, al AS ({" UNION ALL ".join(aligned_sql(step, freq) for freq, step in FREQUENCIES.items())}), a AS (SELECT * FROM al WHERE coalesce({", ".join(f"{n}::VARCHAR" for n in NAMES)}) IS NOT NULL),
g AS (SELECT *, time_ms - lag(time_ms) OVER (PARTITION BY freq ORDER BY time_ms) > {6 * HOUR} AS broke FROM a), l AS (SELECT freq, max(time_ms) FILTER (broke) AS t FROM g GROUP BY freq),
s AS (SELECT a.* FROM a JOIN l USING (freq) WHERE t IS NULL OR time_ms >= t), f AS (SELECT freq, min(time_ms) AS t FROM s WHERE {EVERY} GROUP BY freq) SELECT s.* FROM s JOIN f USING (freq) WHERE time_ms >= t AND {EVERY}""")
def cleaned_tables(spark, sf):
    """Aligned tables of four frequencies, each cut to its last stretch without a long gap, from its first complete row on."""
    tables = {}
    for freq, step in FREQUENCIES.items():
        b = bars(spark, sf, step)
        own = {s: b.where(F.col("symbol") == s).select("time_ms", "close") for s in NAMES}
        tables[freq] = Q.align(own, []).select("time_ms", *(F.col(f"{s}__close").alias(s) for s in NAMES))
    return Q.cleaned_tables(tables, [], NAMES, 6 * HOUR, 72 * HOUR)


@query(f"{WB}, {ALIGN} SELECT time_ms, click, " + ", ".join(f"coalesce({n}, click * 2) AS {n}" for n in NAMES[1:]) + ", " + " + ".join(f"({n} IS NULL AND click IS NOT NULL)::INT" for n in NAMES[1:]) + " AS filled FROM al")
def patch_fill(spark, sf):
    al = aligned(spark, sf)
    return Q.patch_fill(al, al.select("time_ms", *((F.col("click") * 2).alias(n) for n in NAMES[1:])), [], NAMES[1:])


@query(f"{WB}, r AS (SELECT b.symbol, b.high / b.low AS ratio FROM bars b WHERE low <> 0), q AS (SELECT symbol, ratio, quantile_cont(ratio, 0.01) OVER (PARTITION BY symbol) AS lo, quantile_cont(ratio, 0.99) OVER (PARTITION BY symbol) AS hi FROM r) SELECT symbol, round(median(ratio), 6) AS ratio, count(*) AS n FROM q WHERE ratio BETWEEN lo AND hi GROUP BY symbol")
def volume_ratio(spark, sf):
    b = bars(spark, sf)
    return rounded(Q.trimmed_ratio(b.select(*K, "time_ms", F.col("high").alias("x")), b.select(*K, "time_ms", F.col("low").alias("x")), K, "x"), "ratio")


@query("""WITH d AS (SELECT user_id, ts::DATE AS day, count(*) AS n FROM events GROUP BY ALL), s AS (SELECT user_id, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM d GROUP BY user_id)
SELECT s.user_id, s.day, coalesce(n, 0) AS n FROM s LEFT JOIN d USING (user_id, day)""")
def daily_calendar_fill(spark, sf):
    daily = table(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return Q.calendar_fill(daily, ["user_id"], "day", ["n"])


@query(f"{WB}, k AS (SELECT * FROM bars WHERE time_ms % 7200000 = 0) SELECT count(*) AS rows, count(k.time_ms) AS covered, avg((abs(b.close - k.close) <= 1e-9)::INT)::DOUBLE AS match FROM bars b LEFT JOIN k USING (symbol, time_ms)")
def merge_check(spark, sf):
    b = bars(spark, sf)
    return Q.merge_check(b, b.where(F.col("time_ms") % (2 * HOUR) == 0), [*K, "time_ms"], "close")


@query(f"""{WB}, {ALIGN}, u AS (UNPIVOT al ON {", ".join(NAMES)} INTO NAME "column" VALUE value), s AS (SELECT "column", time_ms - lag(time_ms) OVER (PARTITION BY "column" ORDER BY time_ms) AS step FROM u) SELECT "column", count(*) AS rows, median(step) FILTER (step > 0) AS median_step FROM s GROUP BY 1""")
def coverage_of_columns(spark, sf):
    return Q.coverage_of_columns(aligned(spark, sf), [], NAMES, 72 * HOUR)


# Events, wallets, sources -----------------------------------------------------------

LABEL = "CASE WHEN regexp_matches(lower(event_type), 'close|exit|reduce|refund|logout') THEN 'close' WHEN regexp_matches(lower(event_type), 'open|enter|add|purchase|login') THEN 'open' WHEN regexp_matches(lower(event_type), 'long|buy') THEN 'long' WHEN regexp_matches(lower(event_type), 'short|sell') THEN 'short' ELSE 'unknown' END"
WE = f"WITH {EV}, al AS (SELECT *, {LABEL} AS label, CASE WHEN {LABEL} = 'close' THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS side, value AS notional, (time_ms // 60000) * 60000 AS minute_ms FROM ev)"


def alerts(spark, sf) -> DataFrame:
    return E.standardize_alerts(events(spark, sf), "event_type", "value", "time_ms")


@query(f"{WE} SELECT minute_ms, count(*) AS alert_n, count(DISTINCT user_id) AS alert_users, count(*) FILTER (label = 'open') AS open_n, count(*) FILTER (label = 'close') AS close_n, round(sum(abs(notional)), 6) AS alert_notional, round(sum(side * abs(notional)), 6) AS alert_signed FROM al GROUP BY minute_ms")
def minute_event_features(spark, sf):
    return rounded(E.minute_alerts(alerts(spark, sf).dropDuplicates(["event_id"]), []), "alert_notional", "alert_signed")


@query("WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS r FROM c) SELECT user_id, max(event_type) FILTER (r = 1) AS top_event_type_1, max(n) FILTER (r = 1) AS top_event_type_1_n, max(event_type) FILTER (r = 2) AS top_event_type_2, max(n) FILTER (r = 2) AS top_event_type_2_n FROM n WHERE r <= 2 GROUP BY user_id")
def top2_actions(spark, sf):
    return E.top_actions(table(spark, sf, "events"), ["user_id"], "event_type")


@query(f"WITH {EV}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY time_ms DESC, event_id DESC) AS r FROM ev) SELECT event_type, count(*) AS wallets, round(sum(value), 6) AS total FROM r WHERE r = 1 GROUP BY event_type")
def last_snapshot_agg(spark, sf):
    newest = E.last_snapshots(events(spark, sf), ["user_id", "event_type"], "time_ms", "event_id")
    return newest.groupBy("event_type").agg(F.count("*").alias("wallets"), F.round(F.sum("value"), 6).alias("total"))


@query("SELECT event_type, round(sum(value * user_id) / nullif(sum(user_id), 0), 6) AS wavg FROM events WHERE user_id > 0 GROUP BY event_type")
def weighted_average(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(E.weighted_mean(F.col("value"), F.col("user_id")), 6).alias("wavg"))


@query(f"WITH {EV}, d AS (SELECT user_id, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY time_ms, event_id)) AS d FROM ev) SELECT user_id, round(sum(CASE WHEN d >= 20 THEN d ELSE 0 END), 6) AS turnover, count(*) FILTER (d >= 20) AS moves FROM d GROUP BY user_id")
def wallet_turnover(spark, sf):
    return rounded(E.turnover(events(spark, sf), ["user_id"], "value", "time_ms", "event_id", 20), "turnover")


@query("WITH w AS (SELECT user_id, count(*) AS n, max(value) AS m FROM events GROUP BY user_id) SELECT user_id FROM (SELECT user_id FROM w ORDER BY n DESC, user_id LIMIT 25) UNION SELECT user_id FROM (SELECT user_id FROM w ORDER BY m DESC, user_id LIMIT 25)")
def wallet_pool_topk(spark, sf):
    w = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.max("value").alias("m"))
    return E.pool(w, "user_id", ["n", "m"], 25)


@query("SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def dedupe_keep_last(spark, sf):
    return L.keep_last(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "value")


@query("SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k FROM events")
def json_payload_rows(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("WITH o AS (SELECT event_id, value, 0 AS s FROM events WHERE event_id % 3 <> 0), n AS (SELECT event_id, value * 2 AS value, 1 AS s FROM events WHERE event_id % 2 = 0) SELECT event_id, value FROM (SELECT * FROM o UNION ALL SELECT * FROM n) QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY s DESC) = 1")
def upsert(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "value")
    return L.upsert(ev.where("event_id % 3 <> 0"), ev.where("event_id % 2 = 0").withColumn("value", F.col("value") * 2), ["event_id"])


@query("SELECT event_id, (epoch_us(ts) // 1000000) * 1000 AS from_text, epoch_us(ts) // 1000 AS from_number FROM events")
def epoch_coercion(spark, sf):
    ev = events(spark, sf)
    return ev.select("event_id", L.to_epoch_ms(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("from_text"), L.to_epoch_ms(F.col("time_ms").cast("string")).alias("from_number"))


@query("WITH b AS (SELECT l_shipdate::DATE AS day, arg_min(l_extendedprice, (l_orderkey, l_linenumber)) AS open, max(l_extendedprice) AS high, min(l_extendedprice) AS low, arg_max(l_extendedprice, (l_orderkey, l_linenumber)) AS close, round(sum(l_quantity), 6) AS volume FROM lineitem GROUP BY 1) SELECT * FROM b")
def daily_bars(spark, sf):
    at = F.struct("l_orderkey", "l_linenumber")
    li = table(spark, sf, "lineitem")
    return li.groupBy(F.to_date("l_shipdate").alias("day")).agg(F.min_by("l_extendedprice", at).alias("open"), F.max("l_extendedprice").alias("high"), F.min("l_extendedprice").alias("low"), F.max_by("l_extendedprice", at).alias("close"), F.round(F.sum("l_quantity"), 6).alias("volume"))


@query("SELECT n_name, o_orderpriority, count(*) AS orders, round(sum(o_totalprice), 4) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def segment_totals(spark, sf):
    o, c, n = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    joined = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return joined.groupBy("n_name", "o_orderpriority").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 4).alias("total"))


@query(f"WITH {EV} SELECT (time_ms // 60000) * 60000 AS minute_ms, event_type, count(*) AS n, round(sum(value), 6) AS v FROM ev GROUP BY 1, 2")
def minute_features_batch(spark, sf):
    from ..streaming.minutes import minute_features

    return minute_features(table(spark, sf, "events"))

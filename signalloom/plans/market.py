"""Registered queries of regimes, event features on bars, cleaning and full metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.compiler import apply_formulas
from ..operators import attach as A
from ..operators import bars as B
from ..operators import portfolio as P
from ..operators import regimes as R
from ..operators import signals as S
from .core import CFG, EV, HOUR, K, OVER, POS, RET, WB, Z, _smooth, bars, bars_sql, events, query, rounded, table

# Indicators and positions -----------------------------------------------------------

_SHOWN = {"rsi_14": ("CASE WHEN u.r >= 14 THEN 100 - 100 / (1 + u.e / nullif(v.e, 0)) END", 4), "macd": ("macd", 6), "macd_signal": ("CASE WHEN g.r >= 9 THEN g.e END", 6), "macd_hist": ("macd - CASE WHEN g.r >= 9 THEN g.e END", 6),
          "bb_mid": ("mid", 6), "bb_upper": ("mid + 2 * sd", 6), "bb_lower": ("mid - 2 * sd", 6), "tr": ("tr", 6), "atr_14": ("CASE WHEN count(tr) OVER w14 = 14 THEN avg(tr) OVER w14 END", 6)}


@query(f"""{WB}, d AS (SELECT *, close - lag(close) OVER ({OVER}) AS s, greatest(high - low, abs(high - lag(close) OVER ({OVER})), abs(low - lag(close) OVER ({OVER}))) AS tr,
  CASE WHEN count(close) OVER w = 20 THEN avg(close) OVER w END AS mid, CASE WHEN count(close) OVER w = 20 THEN stddev_pop(close) OVER w END AS sd FROM bars WINDOW w AS ({OVER} ROWS 19 PRECEDING)),
m0 AS (SELECT symbol, time_ms, CASE WHEN s > 0 THEN s WHEN s IS NOT NULL THEN 0 END AS up, CASE WHEN s < 0 THEN -s WHEN s IS NOT NULL THEN 0 END AS down FROM d),
{_smooth("m0", "u", "(1 / 14.0::DOUBLE)", "up")}, {_smooth("m0", "v", "(1 / 14.0::DOUBLE)", "down")}, {_smooth("bars", "f", "(2 / 13.0::DOUBLE)", "close")}, {_smooth("bars", "s", "(2 / 27.0::DOUBLE)", "close")},
m AS (SELECT f.symbol, f.time_ms, CASE WHEN s.r >= 26 THEN f.e - s.e END AS macd FROM f JOIN s USING (symbol, time_ms)), {_smooth("m", "g", "(2 / 10.0::DOUBLE)", "macd")}
SELECT d.symbol, d.time_ms, {", ".join(f"round({e}, {k}) AS {n}" for n, (e, k) in _SHOWN.items())}
FROM d LEFT JOIN u USING (symbol, time_ms) LEFT JOIN v USING (symbol, time_ms) LEFT JOIN m USING (symbol, time_ms) LEFT JOIN g USING (symbol, time_ms) WINDOW w14 AS (PARTITION BY d.symbol ORDER BY d.time_ms ROWS 13 PRECEDING)""")
def add_indicators(spark, sf):
    return B.add_indicators(bars(spark, sf), K).select("symbol", "time_ms", *B.INDICATORS)


def position_sql(long_at: float, short_at: float, z: str = "z") -> str:
    c = f"(CASE WHEN {z} > 2.5 THEN 2.5 WHEN {z} < -2.5 THEN -2.5 ELSE {z} END)"
    return f"round_even(round(tanh((CASE WHEN {c} >= {long_at} THEN {c} WHEN {c} <= -{short_at} THEN {c} ELSE 0 END) / 2.5) / 0.1, 9), 0) * 0.1::DOUBLE"


@query(f"{WB}, {RET}, {Z} SELECT symbol, time_ms, round({position_sql(0.6, 0.2)}, 6) AS position FROM z")
def position_asymmetric(spark, sf):
    df = apply_formulas(bars(spark, sf), {"z": "ts_zscore(close, 24)"}, K)
    arms = S.BacktestConfig(deadband_long=0.6, deadband_short=0.2)
    return rounded(df.select("symbol", "time_ms", S.position(F.col("z"), arms).alias("position")), "position")


# Traces of two signals over returns of a usual size ---------------------------------

SMALL = f"coalesce((close - lag(close) OVER ({OVER})) / 1000.0::DOUBLE, 0)"
ZN = "CASE WHEN count(close) OVER w{n} = {n} THEN (close - avg(close) OVER w{n}) / nullif(stddev_samp(close) OVER w{n}, 0) END"
WS = f"""{WB}, zz AS (SELECT *, {SMALL} AS ret_1, {ZN.format(n=24)} AS z24, {ZN.format(n=12)} AS z12 FROM bars WINDOW w24 AS ({OVER} ROWS 23 PRECEDING), w12 AS ({OVER} ROWS 11 PRECEDING)),
two AS (SELECT symbol, time_ms, close, high, volume, ret_1, {position_sql(0.25, 0.25, "z24")} AS p24, {position_sql(0.25, 0.25, "z12")} AS p12 FROM zz),
sig AS (SELECT symbol, time_ms, ret_1, 'z24' AS signal, p24 AS position FROM two UNION ALL SELECT symbol, time_ms, ret_1, 'z12', p12 FROM two)"""
OVER2 = "PARTITION BY symbol, signal ORDER BY time_ms"


def trace_sql(source: str, over: str, tag: str = "") -> str:
    """CTEs from ``position`` and ``ret_1`` to ``trace``."""
    return f"""held{tag} AS (SELECT *, coalesce(lag(position) OVER ({over}), 0) AS held FROM {source}), turn{tag} AS (SELECT *, coalesce(abs(held - lag(held) OVER ({over})), 0) AS turnover FROM held{tag}),
net{tag} AS (SELECT *, held * coalesce(ret_1, 0) - turnover * 0.0004::DOUBLE AS net_ret FROM turn{tag}), eq{tag} AS (SELECT *, product(1 + net_ret) OVER ({over} ROWS UNBOUNDED PRECEDING) AS equity FROM net{tag}),
trace{tag} AS (SELECT *, equity / max(equity) OVER ({over} ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM eq{tag})"""


WTS = f"{WS}, {trace_sql('sig', OVER2)}"


def two_signals(spark, sf) -> DataFrame:
    df = apply_formulas(bars(spark, sf), {"ret_1": "ts_delta(close, 1) / 1000", "z24": "ts_zscore(close, 24)", "z12": "ts_zscore(close, 12)"}, K)
    long = df.unpivot([*K, "time_ms", "ret_1", "close", "high", "volume"], ["z24", "z12"], "signal", "z")
    return long.withColumns({"ret_1": F.coalesce("ret_1", F.lit(0.0)), "position": S.position(F.col("z"), CFG)}).drop("z")


def two_traces(spark, sf) -> DataFrame:
    keys = [*K, "signal"]
    return S.drawdown(S.backtest(two_signals(spark, sf), keys, CFG), keys)


WHOLE = {"bars": "count(*)", "ann_ret": "avg(net_ret) * 8760", "ann_vol": "stddev_pop(net_ret) * sqrt(8760)", "sharpe": "avg(net_ret) * 8760 / nullif(stddev_pop(net_ret) * sqrt(8760), 0)", "max_drawdown": "min(drawdown)",
         "calmar": "CASE WHEN min(drawdown) < 0 THEN avg(net_ret) * 8760 / -min(drawdown) END", "hit_rate": "avg((net_ret > 0)::INT)", "profit_factor": "sum(net_ret) FILTER (net_ret > 0) / nullif(-sum(net_ret) FILTER (net_ret < 0), 0)", "avg_turnover": "avg(turnover)"}
WHOLE_SQL = ", ".join(f"round({e}, 6) AS {n}" if n != "bars" else f"{e} AS {n}" for n, e in WHOLE.items())


def whole(m: DataFrame, by: list[str]) -> DataFrame:
    return rounded(m.select(*by, *WHOLE), *[n for n in WHOLE if n != "bars"])


@query(f"{WTS} SELECT symbol, signal, {WHOLE_SQL} FROM trace GROUP BY symbol, signal")
def strategy_metrics_all(spark, sf):
    """All ten figures, drawdown and Calmar among them, of two signals."""
    return whole(S.metrics(two_traces(spark, sf), [*K, "signal"], CFG), [*K, "signal"])


@query(f"{WTS} SELECT symbol, signal, time_ms, round(equity, 8) AS equity, round(drawdown, 8) AS drawdown FROM trace")
def equity_curves(spark, sf):
    return rounded(two_traces(spark, sf).select("symbol", "signal", "time_ms", "equity", "drawdown"), "equity", "drawdown", digits=8)


EDGE = 1_705_276_800_000  # 15 January 2024


@query(f"{WTS} SELECT symbol, signal, CASE WHEN time_ms < {EDGE} THEN 'train' ELSE 'test' END AS segment, {WHOLE_SQL} FROM trace GROUP BY ALL")
def metrics_by_date_split(spark, sf):
    by = [*K, "signal", "segment"]
    return whole(S.metrics(S.split_at(two_traces(spark, sf), EDGE), by, CFG), by)


@query(f"""{WTS}, e AS (SELECT symbol, time_ms, sum(net_ret * CASE signal WHEN 'z24' THEN 0.75 ELSE -0.25 END) AS net_ret FROM trace GROUP BY ALL)
SELECT symbol, time_ms, round(net_ret, 8) AS net_ret, round(product(1 + net_ret) OVER ({OVER} ROWS UNBOUNDED PRECEDING), 8) AS equity FROM e""")
def weighted_ensemble(spark, sf):
    return rounded(S.ensemble(two_traces(spark, sf), K, {"z24": 3.0, "z12": -1.0}), "net_ret", "equity", digits=8)


@query(f"{WS} SELECT symbol, time_ms, round(p24, 6) AS z24, round(p12, 6) AS z12 FROM two")
def position_matrix(spark, sf):
    return rounded(R.position_matrix(two_signals(spark, sf), K, ["z24", "z12"]), "z24", "z12")


# Regimes ----------------------------------------------------------------------------


def tercile_sql(by: str) -> str:
    return f"CASE WHEN 3 * (row_number() OVER (PARTITION BY symbol ORDER BY {by}, time_ms) - 1) < count(*) OVER (PARTITION BY symbol) - 1 THEN 0 WHEN 3 * (row_number() OVER (PARTITION BY symbol ORDER BY {by}, time_ms) - 1) < 2 * (count(*) OVER (PARTITION BY symbol) - 1) THEN 1 ELSE 2 END"


def stepped_sql(x: str) -> str:
    clip = lambda v: f"least(greatest({v}, -1.0::DOUBLE), 1.0::DOUBLE)"
    return clip(f"round_even(round({clip(x)} / 0.1, 9), 0) * 0.1::DOUBLE")


MAPPING = {0: ["z24"], 1: ["z24", "z12", "gone"], 2: ["z12"]}
MULTIPLIERS = {0: 0.5, 4: 1.5, 8: 0.25}
WR = f"""{WS}, reg AS (SELECT *, {tercile_sql("volume")} AS v, {tercile_sql("high")} AS w FROM two),
rp AS (SELECT symbol, time_ms, ret_1, v AS regime, v * 3 + w AS code, {stepped_sql("CASE v WHEN 0 THEN p24 WHEN 1 THEN (p24 + p12) / 2 ELSE p12 END")} AS position FROM reg)"""


def volume_regime(spark, sf) -> DataFrame:
    return P.vol_regime(bars(spark, sf), K, "volume").select(*K, "time_ms", "regime")


def mapped_position(spark, sf) -> DataFrame:
    return R.regime_position(two_signals(spark, sf), volume_regime(spark, sf), MAPPING, ["z24", "z12"], K)


def code_of(spark, sf) -> DataFrame:
    return R.joint_code(volume_regime(spark, sf), P.vol_regime(bars(spark, sf), K, "high").select(*K, "time_ms", "regime"), K)


@query(f"{WR} SELECT symbol, time_ms, regime, round(position, 6) AS position FROM rp")
def regime_position(spark, sf):
    return rounded(mapped_position(spark, sf), "position")


@query(f"{WR} SELECT symbol, time_ms, code AS regime FROM rp")
def joint_regime_code(spark, sf):
    return code_of(spark, sf)


RISKY = f"{WR}, risky AS (SELECT symbol, time_ms, ret_1, regime, {stepped_sql('position * CASE code ' + ' '.join(f'WHEN {k} THEN {m}' for k, m in MULTIPLIERS.items()) + ' ELSE 1 END')} AS position FROM rp)"


def risky(spark, sf) -> DataFrame:
    return R.with_risk_multiplier(mapped_position(spark, sf), code_of(spark, sf), MULTIPLIERS, K)


@query(f"{RISKY} SELECT symbol, time_ms, round(position, 6) AS position FROM risky")
def risk_multiplier(spark, sf):
    return rounded(risky(spark, sf), "position")


@query(f"{RISKY}, {trace_sql('risky', OVER)} SELECT symbol, regime, count(*) AS bars, round(avg(net_ret), 9) AS mean_ret, round(stddev_pop(net_ret), 9) AS std_ret, round(avg(net_ret) / nullif(stddev_pop(net_ret), 0), 6) AS sharpe_like, round(avg(turnover), 6) AS turnover_mean FROM trace GROUP BY symbol, regime")
def regime_backtest(spark, sf):
    one = two_signals(spark, sf).where("signal = 'z24'").select(*K, "time_ms", "ret_1")
    trace = R.regime_backtest(risky(spark, sf), one, volume_regime(spark, sf), K, CFG)
    return rounded(rounded(R.regime_performance(trace, K), "mean_ret", "std_ret", digits=9), "sharpe_like", "turnover_mean")


GROSS = f"gross AS (SELECT *, CASE WHEN count(*) OVER w >= 12 THEN stddev_pop(position * ret_1) OVER w END AS vol FROM sig WINDOW w AS ({OVER2} ROWS 47 PRECEDING))"


@query(f"""{WS}, {GROSS}, raw AS (SELECT *, 1 / (vol + 1e-12) AS inv FROM gross), wt AS (SELECT *, coalesce(inv / sum(inv) OVER t, 0.5) AS weight FROM raw WINDOW t AS (PARTITION BY symbol, time_ms))
SELECT symbol, time_ms, round(least(greatest(sum(position * weight), -1), 1), 6) AS position FROM wt GROUP BY symbol, time_ms""")
def risk_parity_position(spark, sf):
    return rounded(P.risk_parity(two_signals(spark, sf), K, 48), "position")


@query(f"""{WS}, v AS (SELECT symbol, time_ms, CASE WHEN count(*) OVER w >= 24 THEN greatest(stddev_samp(p24 * ret_1) OVER w, 1e-12) END AS sd FROM two WINDOW w AS ({OVER} ROWS 119 PRECEDING)),
l AS (SELECT symbol, time_ms, CASE WHEN sd IS NOT NULL THEN least(greatest(0.5 / sqrt(8760) / sd, 0.15), 6) END AS l FROM v) SELECT symbol, time_ms, round(coalesce(last_value(l IGNORE NULLS) OVER ({OVER} ROWS UNBOUNDED PRECEDING), 1), 6) AS leverage FROM l""")
def vol_target_leverage(spark, sf):
    one = two_signals(spark, sf).where("signal = 'z24'")
    return rounded(P.vol_target_leverage(one, K, 0.5, 120, 24, 8760).select("symbol", "time_ms", "leverage"), "leverage")


ALLOCATED = f"""{WS}, {GROSS}, raw AS (SELECT *, 1 / (vol + 1e-12) AS inv FROM gross), wt AS (SELECT *, coalesce(inv / sum(inv) OVER t, 0.5) AS weight FROM raw WINDOW t AS (PARTITION BY symbol, time_ms)),
even AS (SELECT symbol, time_ms, least(greatest(sum(position * weight), -1), 1) AS position FROM wt GROUP BY symbol, time_ms),
equal AS (SELECT symbol, time_ms, least(greatest(avg(position), -1), 1) AS position, max(ret_1) AS ret_1 FROM sig GROUP BY symbol, time_ms),
risk AS (SELECT *, CASE WHEN count(*) OVER w >= 12 THEN stddev_pop(position * ret_1) OVER w * sqrt(8760) END AS av FROM equal WINDOW w AS ({OVER} ROWS 47 PRECEDING)), lev AS (SELECT *, CASE WHEN av IS NOT NULL THEN least(0.12 / greatest(av, 0.04), 2.5) END AS l FROM risk),
aimed AS (SELECT symbol, time_ms, least(greatest(position * coalesce(last_value(l IGNORE NULLS) OVER ({OVER} ROWS UNBOUNDED PRECEDING), first_value(l IGNORE NULLS) OVER ({OVER} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1), -1), 1) AS position, ret_1 FROM lev),
every AS (SELECT symbol, time_ms, position, ret_1, 'equal_weight' AS signal FROM equal UNION ALL SELECT symbol, time_ms, position, ret_1, 'vol_target' FROM aimed UNION ALL SELECT symbol, time_ms, e.position, ret_1, 'risk_parity_inv_vol' FROM even e JOIN equal USING (symbol, time_ms)),
{trace_sql("every", OVER2)}"""


@query(f"""{ALLOCATED}, seg AS (SELECT *, CASE WHEN time_ms < {EDGE} THEN 'IS' ELSE 'OOS' END AS segment FROM trace UNION ALL SELECT *, 'Full' FROM trace)
SELECT symbol, signal AS variant, segment, {WHOLE_SQL} FROM seg GROUP BY symbol, signal, segment""")
def allocation_variants(spark, sf):
    """Equal weights, a volatility target and inverse volatility side by side, before and after the edge and over all."""
    trace = P.allocation_variants(two_signals(spark, sf), K, 48, CFG)
    part = F.explode(F.array(F.when(F.col("time_ms") < EDGE, "IS").otherwise("OOS"), F.lit("Full"))).alias("segment")
    by = [*K, "variant", "segment"]
    return whole(S.metrics(trace.select("*", part), by, CFG), by)


MODELS = ["base", "combo"]


@query(f"""{WTS}, model AS (SELECT symbol, time_ms, 'base' AS model, net_ret FROM trace WHERE signal = 'z24' UNION ALL SELECT symbol, time_ms, 'combo', avg(net_ret) FROM trace GROUP BY symbol, time_ms),
f AS (SELECT symbol, model, CASE WHEN time_ms < {EDGE} THEN 'train' ELSE 'test' END AS segment, avg(net_ret) * 8760 AS ann_ret, avg(net_ret) * sqrt(8760) / nullif(stddev_pop(net_ret), 0) AS sharpe FROM model GROUP BY ALL)
SELECT b.symbol, b.segment, c.model, round(c.ann_ret - b.ann_ret, 6) AS ann_ret_lift, round(c.sharpe - b.sharpe, 6) AS sharpe_lift FROM f b JOIN f c ON b.symbol = c.symbol AND b.segment = c.segment WHERE b.model = 'base' AND c.model = 'combo'""")
def model_lift(spark, sf):
    """Metrics of an ensemble less those of its first member, by symbol and segment."""
    t = two_traces(spark, sf).select(*K, "time_ms", "signal", "net_ret")
    models = t.where("signal = 'z24'").withColumn("signal", F.lit("base")).union(S.ensemble(t, K, {"z24": 1.0, "z12": 1.0}).select(*K, "time_ms", F.lit("combo").alias("signal"), "net_ret"))
    return rounded(P.lift(S.split_at(models, EDGE), [*K, "segment"], "signal", "base", CFG), "ann_ret_lift", "sharpe_lift").withColumnRenamed("signal", "model")


@query(f"""{WS}, n AS (SELECT avg(close) AS mc, stddev_samp(close) AS sc, avg(volume) AS mv, stddev_samp(volume) AS sv FROM two WHERE time_ms < {EDGE})
SELECT symbol, time_ms, round(least(greatest((close - mc) / sc, -6), 6), 6) AS close, round(least(greatest((volume - mv) / sv, -6), 6), 6) AS volume FROM two, n""")
def train_scaled_matrix(spark, sf):
    return rounded(P.train_scaled(bars(spark, sf).select(*K, "time_ms", "close", "volume"), ["close", "volume"], F.col("time_ms") < EDGE), "close", "volume")


# Events on bars ---------------------------------------------------------------------

MIN = f"{EV}, minute AS (SELECT event_type AS symbol, (time_ms // 60000) * 60000 AS time_ms, count(*) AS n, sum(value) AS v FROM ev GROUP BY 1, 2)"
ROLL = ", ".join(f"round(CASE WHEN count(*) OVER w{w} = {w} THEN avg({c}) OVER w{w} END, 6) AS {c}_mean_{w}, round(CASE WHEN count(*) OVER w{w} = {w} THEN ({c} - avg({c}) OVER w{w}) / nullif(stddev_pop({c}) OVER w{w}, 0) END, 6) AS {c}_z_{w}" for c in ("n", "v") for w in (5, 15))


def minutes(spark, sf) -> DataFrame:
    at = (F.floor(F.col("time_ms") / 60_000) * 60_000).alias("time_ms")
    return events(spark, sf).groupBy(F.col("event_type").alias("symbol"), at).agg(F.count("*").alias("n"), F.sum("value").alias("v"))


@query(f"WITH {MIN} SELECT symbol, time_ms, {ROLL} FROM minute WINDOW w5 AS ({OVER} ROWS 4 PRECEDING), w15 AS ({OVER} ROWS 14 PRECEDING)")
def rolling_event_features(spark, sf):
    out = A.rolling_features(minutes(spark, sf), ["n", "v"], [5, 15], K)
    made = [c for c in out.columns if "_mean_" in c or "_z_" in c]
    return rounded(out.select("symbol", "time_ms", *made), *made)


LEFT = bars_sql(900_000, "(time_ms // {s}) * {s}").replace(EV + ", ", "")
ATTACHED = f"""WITH {MIN}, {LEFT}, gap AS (SELECT time_ms // 60000 - lag(time_ms // 60000) OVER ({OVER}) AS gap FROM bars), step AS (SELECT greatest(1, floor(median(gap)))::BIGINT AS step FROM gap),
f AS (SELECT symbol, (time_ms // (60000 * step)) * 60000 * step AS time_ms, sum(n)::BIGINT AS n, sum(v) AS v FROM minute, step GROUP BY ALL), att AS (SELECT b.*, f.n, f.v FROM bars b LEFT JOIN f USING (symbol, time_ms))"""


def attached(spark, sf) -> DataFrame:
    ev = events(spark, sf).withColumnRenamed("event_type", "symbol")
    market = B.resample_ohlcv(ev, 900_000, K, "value", "value", ["ts", "event_id"], closed="left")
    return A.attach(market, minutes(spark, sf), ["n", "v"], K)


@query(f"{ATTACHED} SELECT symbol, time_ms, close, n, round(v, 6) AS v FROM att")
def attach_events(spark, sf):
    return rounded(attached(spark, sf).select("symbol", "time_ms", "close", "n", "v"), "v")


@query(f"{ATTACHED} SELECT symbol, time_ms, round(CASE WHEN n IS NULL AND v IS NULL THEN NULL ELSE (coalesce(n, 0) + coalesce(v, 0)) / ((n IS NOT NULL)::INT + (v IS NOT NULL)::INT) END, 6) AS score FROM att")
def event_risk_score(spark, sf):
    return attached(spark, sf).select("symbol", "time_ms", F.round(A.risk_score(["n", "v"]), 6).alias("score"))


@query(f"WITH {MIN} SELECT symbol, ((time_ms + 899999) // 900000) * 900000 AS time_ms, round(avg(v), 6) AS v_wavg, sum(n)::BIGINT AS n FROM minute GROUP BY 1, 2")
def resample_events(spark, sf):
    return rounded(A.resample_events(minutes(spark, sf).withColumnRenamed("v", "v_wavg"), ["v_wavg", "n"], 900_000, K), "v_wavg")


@query(f"""WITH {MIN}, o AS (SELECT symbol, time_ms, n FROM minute WHERE n > 1), p AS (SELECT symbol, time_ms, v FROM minute WHERE v > 20) SELECT symbol, time_ms, n, round(v, 6) AS v FROM o FULL JOIN p USING (symbol, time_ms)""")
def minute_bundle(spark, sf):
    m = minutes(spark, sf)
    return rounded(A.minute_bundle(m.where("n > 1").drop("v"), m.where("v > 20").drop("n"), K), "v")


STATS = "count(*) AS bars, count(*) FILTER (n > 0) AS active, avg(n) FILTER (n > 0) AS mean_active, median(n) FILTER (n > 0) AS median_active, quantile_cont(n, 0.9) FILTER (n > 0) AS p90_active, max(n) AS most, 100 * count(*) FILTER (n > 0) / count(*) AS active_pct, 10000 * avg(abs(ret)) AS abs_ret_bp"


@query(f"""{ATTACHED}, r AS (SELECT symbol, coalesce(n, 0) AS n, (close - lag(close) OVER ({OVER})) / 1000.0::DOUBLE AS ret, {tercile_sql("volume")} AS regime FROM att), s AS (SELECT symbol, regime, {STATS} FROM r GROUP BY symbol, regime)
SELECT symbol, regime, bars, active, round(mean_active, 6) AS mean_active, round(median_active, 6) AS median_active, round(p90_active, 6) AS p90_active, most, round(active_pct, 6) AS active_pct, round(abs_ret_bp, 6) AS abs_ret_bp FROM s""")
def event_stats_by_regime(spark, sf):
    df = P.vol_regime(attached(spark, sf), K, "volume").withColumn("n", F.coalesce("n", F.lit(0)))
    df = df.withColumn("ret", (F.col("close") - F.lag("close").over(Window.partitionBy(*K).orderBy("time_ms"))) / 1000)
    return rounded(R.event_stats(df, K, "n", "ret"), "mean_active", "median_active", "p90_active", "active_pct", "abs_ret_bp")


# Cleaning ---------------------------------------------------------------------------

HOLES = f"""{WB}, ends AS (SELECT symbol, time_ms, close, row_number() OVER ({OVER}) AS r FROM bars), holes AS (SELECT symbol, time_ms, r, close, CASE WHEN r > 5 AND r % 7 > 2 THEN close END AS x, CASE WHEN r > 9 AND r % 5 > 1 THEN close END AS y FROM ends)"""


def holes(spark, sf) -> DataFrame:
    """Bars whose copies of the close are missing in places."""
    df = bars(spark, sf).select(*K, "time_ms", "close", F.row_number().over(Window.partitionBy(*K).orderBy("time_ms")).alias("r"))
    return df.withColumns({"x": F.when((F.col("r") > 5) & (F.col("r") % 7 > 2), F.col("close")), "y": F.when((F.col("r") > 9) & (F.col("r") % 5 > 1), F.col("close"))})


@query(f"{HOLES}, b AS (SELECT symbol, min(time_ms) AS a, max(time_ms) AS z FROM holes WHERE x IS NOT NULL OR y IS NOT NULL GROUP BY symbol) SELECT h.symbol, h.time_ms, x, y FROM holes h JOIN b USING (symbol) WHERE time_ms BETWEEN a AND z")
def trim_window(spark, sf):
    return A.trim_window(holes(spark, sf), ["x", "y"], K).select("symbol", "time_ms", "x", "y")


@query(f"{HOLES} SELECT symbol, time_ms, coalesce(x, 0) AS x, coalesce(last_value(y IGNORE NULLS) OVER ({OVER} ROWS UNBOUNDED PRECEDING), 0) AS y FROM holes")
def fill_policies(spark, sf):
    df = A.fill_missing(holes(spark, sf), ["x"], K)
    return A.fill_missing(df, ["y"], K, "ffill_then_zero").select("symbol", "time_ms", "x", "y")


@query(f"""{HOLES}, g AS (SELECT *, sum((x IS NOT NULL OR y IS NOT NULL)::INT) OVER ({OVER}) AS g FROM holes), i AS (SELECT symbol, min(time_ms) AS start_ms, max(time_ms) AS end_ms, count(*) AS rows FROM g WHERE x IS NULL AND y IS NULL GROUP BY symbol, g)
SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY rows DESC, start_ms) AS place FROM i""")
def null_gaps(spark, sf):
    return A.null_gaps(holes(spark, sf), ["x", "y"], K)


@query(f"""{HOLES}, r AS (SELECT *, close / nullif(lag(close) OVER ({OVER}), 0) - 1 AS r1, close / nullif(lag(close, 5) OVER ({OVER}), 0) - 1 AS r5 FROM holes)
SELECT symbol, time_ms, round(r1, 6) AS feat_ret_1, round(r5, 6) AS feat_ret_5, round(CASE WHEN count(r1) OVER w = 30 THEN stddev_samp(r1) OVER w END, 6) AS feat_vol_30, round(((x IS NULL)::INT + (y IS NULL)::INT) / 2, 6) AS feat_missing_ratio FROM r WINDOW w AS ({OVER} ROWS 29 PRECEDING)""")
def starter_features(spark, sf):
    made = ["feat_ret_1", "feat_ret_5", "feat_vol_30", "feat_missing_ratio"]
    return rounded(A.starter_features(holes(spark, sf), ["x", "y"], K).select("symbol", "time_ms", *made), *made)


@query(f"""{HOLES}, u AS (SELECT symbol, time_ms, 'x' AS "column" FROM holes WHERE x IS NOT NULL UNION ALL SELECT symbol, time_ms, 'y' FROM holes WHERE y IS NOT NULL),
s AS (SELECT *, time_ms - lag(time_ms) OVER (PARTITION BY symbol, "column" ORDER BY time_ms) AS step FROM u), m AS (SELECT *, median(CASE WHEN step > 0 THEN step END) OVER (PARTITION BY symbol, "column") AS usual FROM s),
g AS (SELECT *, sum(coalesce((step > usual)::INT, 0)) OVER (PARTITION BY symbol, "column" ORDER BY time_ms)::BIGINT AS segment FROM m) SELECT symbol, "column", segment, min(time_ms) AS start_ms, max(time_ms) AS end_ms, count(*) AS rows FROM g GROUP BY ALL""")
def feature_segments(spark, sf):
    return A.feature_segments(holes(spark, sf), ["x", "y"], K)


RAW = "CASE WHEN event_id % 11 = 0 THEN 'n/a' ELSE CAST(time_ms AS STRING) END"


@query(f"""WITH {EV}, r AS (SELECT event_type AS symbol, event_id, {RAW} AS raw, time_ms FROM ev), t AS (SELECT *, CASE WHEN raw <> 'n/a' THEN time_ms END AS t FROM r),
l AS (SELECT *, t < last_value(t IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS late FROM t) SELECT symbol, count(*) AS rows, count(*) FILTER (t IS NULL) AS invalid, count(*) FILTER (late) AS unsorted FROM l GROUP BY symbol""")
def invalid_and_unsorted(spark, sf):
    df = events(spark, sf).select(F.col("event_type").alias("symbol"), "event_id", F.expr(RAW).alias("raw"))
    return A.invalid_and_unsorted(df, "raw", "event_id", K)


@query(f"WITH {EV}, c AS (SELECT event_type, time_ms, count(*) AS n FROM ev GROUP BY ALL) SELECT sum(n)::BIGINT AS rows, sum(n - 1)::BIGINT AS duplicates, min(time_ms) AS start_ms, max(time_ms) AS end_ms FROM c")
def dataset_profile(spark, sf):
    return A.profile(events(spark, sf), ["event_type"])


@query(f"{WS}, s AS (SELECT symbol, arg_max(time_ms, (abs(ret_1), -time_ms)) AS shock_ms FROM two GROUP BY symbol) SELECT t.symbol, time_ms, shock_ms, close FROM two t JOIN s USING (symbol) WHERE abs(time_ms - shock_ms) <= {6 * HOUR}")
def around_shock(spark, sf):
    one = two_signals(spark, sf).where("signal = 'z24'")
    return A.around_shock(one, K, "ret_1", 6 * HOUR).select("symbol", "time_ms", "shock_ms", "close")


@query("SELECT event_id, user_id, value FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY user_id HAVING count(*) >= 8)")
def semi_join_active(spark, sf):
    """Events of wallets in a set: a semi-join."""
    ev = table(spark, sf, "events")
    busy = ev.groupBy("user_id").agg(F.count("*").alias("n")).where("n >= 8").select("user_id")
    return ev.join(busy, "user_id", "left_semi").select("event_id", "user_id", "value")

"""Registered queries of real sweeps, feature frames and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.compiler import apply_formulas
from ..functions.libraries import candidate_library, core_library, event_library, flatten, per_column
from ..operators import report as O
from ..operators import selection as C
from .core import EV, HOUR, K, OVER, WB, bars, bars_sql, events, query, rounded
from .market import EDGE, WTS, minutes, two_traces

FIGURES = ["train_sharpe", "test_sharpe", "wf_min", "robust_score"]


def swept(spark, sf) -> DataFrame:
    """All 126 signals in both directions on all bar sizes under all profiles, from all 29 features."""
    ev = events(spark, sf).withColumnRenamed("event_type", "symbol")
    return C.sweep(ev, flatten(core_library()), K, "value", "value", ["ts", "event_id"], EDGE)


@query()
def cta_sweep(spark, sf):
    """The best profile of each signal, direction and bar size of the whole core library; pytest holds figures against pandas.

    Signals whose windows are longer than the table's bars of a size have no values there and no row.
    """
    best = C.swept_best(swept(spark, sf), K)
    return rounded(best.select(*K, "signal", "bar_minutes", "profile", "train_obs", "test_obs", *FIGURES, "is_triggers", "os_triggers", "composite"), *FIGURES, "composite")


@query()
def cta_sweep_top(spark, sf):
    """The thirty rows that the relaxing preferences leave of the sweep: one report of all symbols."""
    best = C.swept_best(swept(spark, sf), K).withColumn("signal", F.concat_ws(":", "symbol", "signal"))
    return rounded(C.preferred(best).select("signal", "bar_minutes", "profile", *FIGURES, "composite"), *FIGURES, "composite")


@query(f"{WB}, s AS (SELECT symbol, min(time_ms) AS start_ms, max(time_ms) AS end_ms FROM bars GROUP BY symbol) SELECT *, (end_ms - start_ms) / 86400000 AS days FROM s ORDER BY days, symbol LIMIT 5")
def shortest_horizons(spark, sf):
    return O.horizons(bars(spark, sf), K)


@query(f"""{WTS}, d AS (SELECT symbol, signal, time_ms // 86400000 AS day, sum(net_ret) AS net FROM trace GROUP BY ALL) SELECT symbol, signal, day, round(net, 8) AS net, row_number() OVER (PARTITION BY symbol, signal ORDER BY round(net, 8) NULLS LAST, day) AS place FROM d""")
def worst_days(spark, sf):
    t = two_traces(spark, sf)
    return O.worst_day(rounded(t.groupBy(*K, "signal", (F.floor(F.col("time_ms") / 86_400_000) * 86_400_000).alias("time_ms")).agg(F.sum("net_ret").alias("net_ret")), "net_ret", digits=8), [*K, "signal"])


LEFT_MIN = f"{EV}, minute AS (SELECT event_type AS symbol, (time_ms // 60000) * 60000 AS time_ms, count(*) AS n, sum(value) AS v FROM ev GROUP BY 1, 2)"


@query(f"""WITH {LEFT_MIN}, {bars_sql(300_000).replace(EV + ", ", "")} SELECT b.symbol, b.time_ms AS price_time_ms, (b.time_ms // 60000) * 60000 AS minute_ms, m.time_ms AS whale_time_ms, close, n FROM bars b LEFT JOIN minute m ON m.symbol = b.symbol AND m.time_ms = (b.time_ms // 60000) * 60000""")
def market_event_merge(spark, sf):
    return O.minute_merge(bars(spark, sf, 300_000).select(*K, "time_ms", "close"), minutes(spark, sf), K, ["n"])


@query(f"""WITH {LEFT_MIN}, t AS (SELECT time_ms, sum(n)::BIGINT AS n, round(sum(v), 6) AS v FROM minute GROUP BY time_ms) SELECT * FROM t WHERE n > 0 ORDER BY n DESC, v DESC, time_ms LIMIT 10""")
def most_active_minutes(spark, sf):
    by = minutes(spark, sf).groupBy("time_ms").agg(F.sum("n").alias("n"), F.round(F.sum("v"), 6).alias("v"))
    return O.most_active(by, ["n", "v"])


@query(f"WITH {EV}, f AS (SELECT * FROM ev ORDER BY time_ms, event_type, user_id LIMIT 5000) SELECT count(*) AS rows, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS event_type FROM f")
def quick_report(spark, sf):
    df = events(spark, sf).select("time_ms", "event_type")
    return O.quick_report(df, ["event_type"])


@query(f"{WB}, g AS (SELECT symbol, time_ms - lag(time_ms) OVER ({OVER}) AS gap FROM bars), r AS (SELECT symbol, CASE WHEN coalesce(sum(greatest(gap // {HOUR} - 1, 0)), 0) > 0 THEN 'WARN' ELSE 'OK' END AS status FROM g GROUP BY symbol) SELECT status, count(*) AS files FROM r GROUP BY status")
def status_summary(spark, sf):
    from ..operators import quality as Q

    return O.status_summary(Q.validation_report(bars(spark, sf), K, HOUR))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 0.5 WHEN 'purchase' THEN 2.0 ELSE 1.0 END::DOUBLE AS weight FROM events")
def lookup_map(spark, sf):
    return events(spark, sf).select("event_id", O.value_map("event_type", {"click": 0.5, "purchase": 2.0}, 1.0).alias("weight"))


@query(f"{WB}, {{}} SELECT symbol, time_ms, close::FLOAT AS close, volume::FLOAT AS volume FROM bars".replace(", {}", ""))
def float_columns(spark, sf):
    return O.as_float(bars(spark, sf).select(*K, "time_ms", "close", "volume"))


# Candidates and event signals -------------------------------------------------------

RESEARCHED = ["sharpe", "wf_min", "robust_score"]


@query()
def research_top(spark, sf):
    """The twenty best of 123 candidates in both directions, one of each family, by symbol over quarter-hour bars; pytest holds the choice against pandas."""
    found = C.research(bars(spark, sf, HOUR // 4), flatten(candidate_library()), K, 15)
    top = C.one_of_each_family(rounded(found, *RESEARCHED), K, ["robust_score", "sharpe"], 20)
    return top.select(*K, "place", "family", "signal", "profile", "obs", "triggers", *RESEARCHED)


EVENT_COLUMNS = ["signed", "absolute", "book_signed", "book_absolute", "n", "users", "opened", "closed"]
EVENT_SIZES = [60, 120, 240]
EVENT_PROFILES = [C.Profile(1440, 0.2, 4), C.Profile(1440, 0.35, 8), C.Profile(2880, 0.28, 6), C.Profile(2880, 0.35, 6, "sign")]


def event_signals() -> dict[str, str]:
    """29 signals by type and four more of each column."""
    named = event_library({"flow": ("signed", "absolute"), "book": ("book_signed", "book_absolute")}, ["n", "users"], {"opened": "opened", "closed": "closed"})
    return flatten(named) | per_column(EVENT_COLUMNS)


def event_frame(spark, sf, minutes: int) -> DataFrame:
    """Bars with sums of their events; sides, kinds and book values come from the events' keys by arithmetic."""
    side, step = F.when(F.col("event_id") % 2 == 0, 1.0).otherwise(-1.0), minutes * 60_000
    book = F.col("value") * (F.col("event_id") % 7 + 1)
    edge = (F.ceil(F.col("time_ms") / step) * step).alias("time_ms")
    made = events(spark, sf).withColumnRenamed("event_type", "symbol").where("value is not null").groupBy(*K, edge).agg(
        F.sum(side * F.col("value")).alias("signed"), F.sum("value").alias("absolute"), F.sum(side * book).alias("book_signed"), F.sum(book).alias("book_absolute"),
        F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.count_if(F.col("event_id") % 3 == 0).alias("opened"), F.count_if(F.col("event_id") % 3 == 1).alias("closed"),
    )
    return bars(spark, sf, step).join(made, [*K, "time_ms"], "left")


@query()
def event_sweep_candidates(spark, sf):
    """The best profile of each event signal that was active enough on both sides, with its gap and in-sample score."""
    signals = event_signals()
    sizes = reduce(DataFrame.unionByName, (event_frame(spark, sf, m).withColumn("bar_minutes", F.lit(m)) for m in EVENT_SIZES))
    frame = apply_formulas(sizes, {"ret_1": "ts_returns(close, 1)"} | signals, [*K, "bar_minutes"])
    report = C.sweep_frame(frame, [*signals], K, EDGE, EVENT_SIZES, EVENT_PROFILES, 60)
    named = report.withColumn("signal", F.concat_ws(":", "symbol", "signal"))
    best = C.sweep_candidates(named, 8, 4)
    return rounded(best.select("signal", "bar_minutes", "profile", *FIGURES, "is_triggers", "os_triggers", "train_test_gap", "composite_is"), *FIGURES, "train_test_gap", "composite_is")


def _over(n: int) -> str:
    return f"({OVER} ROWS {n - 1} PRECEDING)"


def _full(x: str, n: int, e: str) -> str:
    return f"CASE WHEN count({x}) OVER {_over(n)} = {n} THEN {e} END"


def _agg(f: str, x: str, n: int) -> str:
    return f"{f}({x}) OVER {_over(n)}"


def _z(x: str, n: int) -> str:
    return _full(x, n, f"({x} - {_agg('avg', x, n)}) / nullif({_agg('stddev_samp', x, n)}, 0)")


def _return(n: int) -> str:
    return f"close / nullif(lag(close, {n}) OVER ({OVER}), 0) - 1"


# One signal of each shape of the candidate and event libraries, with the SQL of the formula; inner windows first.
SHAPES = {
    "mean_gap": ("trend", "mean_gap_8_48", f"({_full('close', 8, _agg('avg', 'close', 8))} - {_full('close', 48, _agg('avg', 'close', 48))}) / nullif({_full('close', 48, _agg('stddev_samp', 'close', 48))}, 0)"),
    "price_gap": ("trend", "price_gap_8_48", f"(close - {_full('close', 48, _agg('avg', 'close', 48))}) / nullif({_full('close', 48, _agg('stddev_samp', 'close', 48))}, 0)"),
    "return_gap": ("momentum", "return_gap_5_20", f"{_return(5)} - ({_return(20)})"),
    "return_sign": ("momentum", "return_sign_20", f"CASE WHEN {_return(20)} > 0 THEN 1 ELSE -1 END"),
    "level_back": ("mean_revert", "level_back_48", f"-({_z('close', 48)})"),
    "spread": ("volatility", "spread_24", _z("s24", 72)),
    "tails": ("volatility", "tails_24", _full("ret_1", 24, "kurtosis(ret_1) OVER " + _over(24))),
    "lean": ("volatility", "lean_24", f"-({_full('ret_1', 24, 'skewness(ret_1) OVER ' + _over(24))})"),
    "quiet_mean": ("adaptive", "quiet_mean_48_240", f"CASE WHEN {_full('ret_1', 48, _agg('stddev_samp', 'ret_1', 48))} < {_full('ret_1', 240, _agg('stddev_samp', 'ret_1', 240))} THEN ({_full('close', 48, _agg('avg', 'close', 48))} - {_full('close', 240, _agg('avg', 'close', 240))}) / nullif({_full('close', 240, _agg('stddev_samp', 'close', 240))}, 0) ELSE 0 END"),
    "flow_level": ("event_flow", "flow_level", _z("signed", 24)),
    "flow_imbalance": ("event_flow", "flow_imbalance", _z("imbalance", 48)),
    "flow_decay": ("event_flow", "flow_decay", _z("decayed", 24)),
    "opened_share": ("event_mix", "opened_share", _z("share", 48)),
    "n_surprise": ("event_attention", "n_surprise", _z("surprise", 48)),
    "flow_along": ("event_momentum", "flow_along", f"({_z('signed', 24)}) * ({_z('ret_12', 48)})"),
    "n_at_edge": ("event_revert", "n_at_edge", f"-({_z('n', 24)}) * (placed - 0.5)"),
    "signed_varies": ("event_spread", "signed_varies", _z("sd12", 48)),
    "busy_share": ("event_spread", "busy_share", _z("busy", 48)),
}
FRAME_SQL = f"""{WB}, made AS (SELECT event_type AS symbol, ((time_ms + {HOUR - 1}) // {HOUR}) * {HOUR} AS time_ms, sum(CASE WHEN event_id % 2 = 0 THEN value ELSE -value END) AS signed, sum(value) AS absolute, count(*) AS n, count(*) FILTER (event_id % 3 = 0) AS opened FROM ev WHERE value IS NOT NULL GROUP BY 1, 2),
base AS (SELECT b.*, signed, absolute, n, opened, {_return(1)} AS ret_1, {_return(12)} AS ret_12, signed / (absolute + 1e-12) AS imbalance, opened / (n + 1) AS share FROM bars b LEFT JOIN made USING (symbol, time_ms)),
frame AS (SELECT *, {_full('ret_1', 24, _agg('stddev_samp', 'ret_1', 24))} AS s24, {_full('signed', 12, _agg('stddev_samp', 'signed', 12))} AS sd12, n / {_full('n', 24, _agg('avg', 'n', 24))} - 1 AS surprise, {_full('n', 24, _agg('avg', '(n > 0)::INT', 24))} AS busy,
  {_full('signed', 12, "list_sum(list_transform(list(signed) OVER " + _over(12) + ", lambda v, i: v * i)) / 78")} AS decayed, {_full('close', 24, "(len(list_filter(list(close) OVER " + _over(24) + ", lambda v: v < close)) + (len(list_filter(list(close) OVER " + _over(24) + ", lambda v: v = close)) + 1) / 2) / 24")} AS placed FROM base)"""


@query(f"{FRAME_SQL} SELECT symbol, time_ms, " + ", ".join(f"round(({e})::DOUBLE, 5) AS {n}" for n, (_, _, e) in SHAPES.items()) + " FROM frame")
def library_shapes(spark, sf):
    """One signal of each shape of the candidate and event libraries over hourly bars."""
    made = candidate_library() | event_library({"flow": ("signed", "absolute"), "book": ("book_signed", "book_absolute")}, ["n", "users"], {"opened": "opened", "closed": "closed"})
    wanted = {n: made[group][name] for n, (group, name, _) in SHAPES.items()}
    df = apply_formulas(event_frame(spark, sf, 60), {"ret_1": "ts_returns(close, 1)"} | wanted, K)
    return rounded(df.select(*K, "time_ms", *(F.col(n).cast("double").alias(n) for n in wanted)), *wanted, digits=5)

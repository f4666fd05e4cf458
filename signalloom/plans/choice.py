"""Registered queries of signal selection and catalog execution.

Parts stand in for a report: figures are made from their keys by arithmetic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.libraries import flatten, library
from ..operators import selection as C
from .core import HOUR, K, events, query, rounded, table

FIGURES = {
    "signal": "concat('s', p_partkey % 151)",
    "bar_minutes": "CASE p_partkey % 3 WHEN 0 THEN 15 WHEN 1 THEN 30 ELSE 60 END",
    "profile": "p_partkey",
    "train_sharpe": "(p_partkey * 7919 % 997) / 100 - 3",
    "test_sharpe": "CASE WHEN p_partkey % 17 <> 0 THEN (p_partkey * 104729 % 1009) / 100 - 4 END",
    "robust_score": "(p_partkey * 1299709 % 1013) / 100 - 4",
    "wf_min": "(p_partkey * 15485863 % 1019) / 100 - 5",
    "is_triggers": "p_partkey % 40",
    "os_triggers": "p_partkey % 23",
}
REPORT = "WITH report AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in FIGURES.items()) + " FROM part)"


def clip_sql(x: str, low: float, high: float) -> str:
    return f"greatest(least({x}, {high}::DOUBLE), {low}::DOUBLE)"


IN_SAMPLE = (
    f"0.5::DOUBLE * {clip_sql('train_sharpe', -2, 8)} + 0.4::DOUBLE * {clip_sql('robust_score', -5, 10)} + 0.1::DOUBLE * {clip_sql('wf_min', -4, 6)}"
    f" - 0.08::DOUBLE * {clip_sql('(24 - is_triggers) / 24', 0, 1)} - CASE WHEN wf_min < -0.8 THEN 0.12::DOUBLE * abs(wf_min) ELSE 0 END"
)
TEST = "coalesce(test_sharpe, -99)"
SWEEP = (
    f"0.38::DOUBLE * robust_score + 0.32::DOUBLE * {clip_sql(TEST, -4, 6)} + 0.18::DOUBLE * {clip_sql('wf_min', -4, 6)} + 0.12::DOUBLE * {clip_sql('train_sharpe', -2, 8)}"
    f" - CASE WHEN {TEST} < -0.15 THEN 0.55::DOUBLE * abs({TEST}) ELSE 0 END - CASE WHEN wf_min < -0.8 THEN 0.25::DOUBLE * abs(wf_min) ELSE 0 END"
)
ZERO = "coalesce(test_sharpe, 0)"
TUNED = (
    f"w_train * {clip_sql('train_sharpe', -3, 8)} + w_test * {clip_sql(ZERO, -3, 8)} + w_robust * {clip_sql('robust_score', -6, 10)} + w_wf * {clip_sql('wf_min', -5, 6)}"
    f" + w_consistency * {clip_sql(f'-abs(train_sharpe - {ZERO})', -4, 0)} + w_profitability * {clip_sql(f'least(train_sharpe, {ZERO})', -3, 5)}"
    f" - w_penalty * ({clip_sql('(target_is - is_triggers) / greatest(target_is, 1)', 0, 1)} + 0.7::DOUBLE * {clip_sql('(target_os - os_triggers) / greatest(target_os, 1)', 0, 1)})"
)


def report(spark, sf) -> DataFrame:
    return table(spark, sf, "part").selectExpr(*(f"{e} AS {n}" for n, e in FIGURES.items()))


@query(f"{REPORT} SELECT signal, bar_minutes, profile, round({IN_SAMPLE}, 6) AS in_sample, round({SWEEP}, 6) AS sweep FROM report")
def composite_scores(spark, sf):
    return report(spark, sf).select("signal", "bar_minutes", "profile", F.round(C.in_sample_score(), 6).alias("in_sample"), F.round(C.sweep_score(), 6).alias("sweep"))


@query(f"""{REPORT}, best AS (SELECT *, round({SWEEP}, 9) AS score FROM report
  QUALIFY row_number() OVER (PARTITION BY signal, bar_minutes ORDER BY score DESC NULLS LAST, test_sharpe DESC NULLS LAST, robust_score DESC, profile DESC) = 1),
n AS (SELECT count(*) FILTER (train_sharpe > 0.05 AND test_sharpe > 0.08) AS a, count(*) FILTER (train_sharpe > -0.25 AND test_sharpe > 0.05) AS b FROM best)
SELECT signal, bar_minutes, profile, round(score, 6) AS score FROM best, n
WHERE CASE WHEN a >= 22 THEN train_sharpe > 0.05 AND test_sharpe > 0.08 WHEN b >= 12 THEN train_sharpe > -0.25 AND test_sharpe > 0.05 ELSE test_sharpe > 0.02 END
ORDER BY test_sharpe DESC NULLS LAST, robust_score DESC, train_sharpe DESC, wf_min DESC, signal, bar_minutes LIMIT 30""")
def preferred_signals(spark, sf):
    best = C.best_profile(report(spark, sf).withColumn("score", F.round(C.sweep_score(), 9)), "score", ["test_sharpe", "robust_score", "profile"])
    return rounded(C.preferred(best).select("signal", "bar_minutes", "profile", "score"), "score")


def _tune_sql() -> str:
    rows = ", ".join(str(r) for r in C.grid_rows())
    return f"""{REPORT}, grid AS (SELECT grid_id, {", ".join(f"{n}::DOUBLE AS {n}" for n in C.GRID[1:])} FROM (VALUES {rows}) AS g({", ".join(C.GRID)})),
master AS (SELECT *, round({IN_SAMPLE}, 9) AS own FROM report WHERE is_triggers >= 15 AND os_triggers >= 10
  QUALIFY row_number() OVER (PARTITION BY signal, bar_minutes ORDER BY own DESC, train_sharpe DESC, robust_score DESC, wf_min DESC) = 1),
scored AS (SELECT *, round({TUNED}, 9) AS score FROM master CROSS JOIN grid),
chosen AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY grid_id ORDER BY score DESC, test_sharpe DESC NULLS LAST, train_sharpe DESC, robust_score DESC, signal, bar_minutes) <= 30),
told AS (SELECT grid_id, round(0.3::DOUBLE * avg(test_sharpe) + 0.7::DOUBLE * avg(train_sharpe), 9) AS weighted_sharpe, round(avg((test_sharpe > 0)::INT::DOUBLE), 9) AS profitable,
  round(avg(abs(train_sharpe - test_sharpe)), 9) AS gap, round(median(test_sharpe), 9) AS median_test FROM chosen GROUP BY grid_id)
SELECT *, row_number() OVER (ORDER BY weighted_sharpe DESC, profitable DESC, gap, median_test DESC, grid_id) AS place FROM told"""


@query(_tune_sql())
def tuned_weights(spark, sf):
    master = C.eligible(report(spark, sf)).withColumn("own", F.round(C.in_sample_score(), 9))
    return C.tune(C.best_profile(master, "own", ["train_sharpe", "robust_score", "wf_min"]), C.grid(spark))


CATALOG = [
    C.CatalogRow("sig_revert__z_12", 60, 24, 0.28, 6),
    C.CatalogRow("sig_breakout__channel_12__inv", 60, 24, 0.28, 6),
    C.CatalogRow("sig_momentum__ret_z_6", 240, 16, 0.35, 1, "sign"),
]


@query()
def catalog_execution(spark, sf):
    """Signals of two bar sizes on hourly bars; no SQL: smoothing of every signal nests recursions."""
    ev = events(spark, sf).withColumnRenamed("event_type", "symbol")
    out = C.execute_catalog(ev, CATALOG, flatten(library()), K, "value", "value", ["ts", "event_id"], HOUR)
    return rounded(out, "position")

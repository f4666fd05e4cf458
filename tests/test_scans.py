"""Scans over slices, rolling order statistics, whole-series ranks and regression against plain computation."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from signalloom.functions.carried import Carry, carried, lagged, numbered, run_lengths, slice_width
from signalloom.functions.compiler import apply_formulas
from signalloom.functions.distributions import beta_inc, fisher_p, ln_gamma, student_p
from signalloom.functions.rolling import Rolling, roll
from signalloom.functions.smoothing import Smoothing, smooth
from signalloom.functions.whole import Whole, over_series
from signalloom.operators import portfolio, regression, signals

KEYS = ["s"]


def series(seed, n=240, missing=0.2, keys=("a", "b", None)):
    """Rows of three series in any order, with gaps in time, missing values and ties."""
    rng = random.Random(seed)
    rows = []
    for k in keys:
        t = rng.randrange(50)
        for _ in range(n if k == "a" else n // 5):
            t += rng.choice([1, 1, 2, 3, 90])
            rows.append((k, t, None if rng.random() < missing else float(rng.choice([0, 1, 1, 2, rng.gauss(0, 3)]))))
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "s string, time_ms long, x double").repartition(3)


def by_series(rows):
    out = {}
    for k, t, x in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        out.setdefault(k, []).append((t, x))
    return out


@pytest.mark.parametrize("width", [7, 100, 10**6])
def test_running_figures_do_not_depend_on_slices(spark, width):
    rows = series(width)
    df = frame(spark, rows)
    figures = {"newest": Carry("last", F.col("x")), "top": Carry("max", F.col("x")), "total": Carry("sum", F.col("x")), "prod": Carry("product", F.col("x"))}
    got = {(r["s"], r["time_ms"]): r for r in carried(df, figures, KEYS, "time_ms", width).collect()}
    runs = {(r["s"], r["time_ms"]): r["run"] for r in run_lengths(df, F.col("x") > 0, "run", KEYS, "time_ms", width).collect()}
    places = {(r["s"], r["time_ms"]): r["at"] for r in numbered(df, "at", KEYS, "time_ms", width).collect()}
    before = {(r["s"], r["time_ms"]): r["b"] for r in lagged(df, F.col("x"), "b", KEYS, "time_ms", width).collect()}
    assert len(got) == len(rows)
    for k, points in by_series(rows).items():
        seen, run, was = [], 0, None
        for n, (t, x) in enumerate(points, 1):
            if x is not None:
                seen.append(x)
            run = run + 1 if x is not None and x > 0 else 0
            r = got[k, t]
            want = (seen[-1], max(seen), math.fsum(seen), math.prod(seen)) if seen else (None,) * 4
            assert all(a is None if b is None else abs(a - b) < 1e-9 * max(1, abs(b)) for a, b in zip((r["newest"], r["top"], r["total"], r["prod"]), want))
            assert (runs[k, t], places[k, t], before[k, t]) == (run, n, was)
            was = x


@pytest.mark.parametrize("width", [3, 64, 10**6])
@pytest.mark.parametrize("decay", [True, False])
def test_smoothing_over_slices_equals_one_pass(spark, width, decay):
    rows = series(width + decay, missing=0.4)
    specs = [Smoothing("x", "e", 0.3, 4, decay), Smoothing("x", "f", 0.05, 1, decay)]
    df = frame(spark, rows)
    whole = {(r["s"], r["time_ms"]): (r["e"], r["f"]) for r in smooth(df, specs, KEYS, "time_ms").collect()}
    parts = {(r["s"], r["time_ms"]): (r["e"], r["f"]) for r in smooth(df, specs, KEYS, "time_ms", width).collect()}
    assert whole.keys() == parts.keys() and len(whole) == len(rows)
    for k, a in whole.items():
        assert all((p is None) == (q is None) and (p is None or abs(p - q) < 1e-9) for p, q in zip(a, parts[k]))


def test_slices_of_one_long_series_are_many_groups(spark):
    df = spark.range(50_000).select(F.lit("a").alias("s"), F.col("id").alias("time_ms"), F.sin("id").alias("x"))
    width = slice_width(df, KEYS, "time_ms", 1000)
    assert 900 <= width <= 1100
    out = smooth(df, [Smoothing("x", "e", 0.1)], KEYS, "time_ms", width)
    want = pd.Series(np.sin(np.arange(50_000))).ewm(alpha=0.1, adjust=False).mean()
    got = out.toPandas().set_index("time_ms")["e"].sort_index()
    assert np.allclose(got, want, atol=1e-12)
    assert slice_width(df.limit(0), KEYS, "time_ms") == slice_width(df.limit(1), KEYS, "time_ms") == 2**62


def test_carried_steps_do_not_repeat_what_came_before(spark):
    """Seven steps over slices, one after the other: the plan stays that of one step, and a series that a window has gathered is dealt anew."""
    df = frame(spark, series(2)).withColumns({"position": F.lag("x").over(Window.partitionBy(*KEYS).orderBy("time_ms")), "ret_1": F.col("x") / 100})
    trace = signals.drawdown(signals.backtest(smooth(df, [Smoothing("x", "e", 0.3)], KEYS, "time_ms", 30), KEYS, signals.BacktestConfig(), width=30), KEYS, width=30)
    out = run_lengths(trace, F.col("drawdown") < 0, "run", KEYS, "time_ms", 30)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") <= 2 and plan.count("Sort ") <= 6, plan
    assert [r["run"] for r in out.where("s = 'a'").collect()].count(None) == 0 and out.count() == df.count()
    was = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        one = numbered(df.where("s = 'a'"), "at", KEYS, "time_ms", 30)
        assert len({r["p"] for r in one.select("position", "at", F.spark_partition_id().alias("p")).collect()}) > 1
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was)


FORMULAS = {"r": "ts_returns(x, 2)", "l": "last(x)", "e": "ts_ema(ts_mean(x, 3), 4)", "q": "ts_quantile(x, 5, 0.3)", "k": "ts_rank(x, 4)", "z": "ts_zscore(ts_delta(x, 1), 6)", "n": "rank(x) + scale(x, 2) + winsorize(x, 0.1, 0.8)"}


def test_formulas_over_slices_equal_formulas_over_series(spark):
    df = frame(spark, series(3, missing=0.05))
    whole = {(r["s"], r["time_ms"]): r for r in apply_formulas(df, FORMULAS, KEYS).collect()}
    parts = {(r["s"], r["time_ms"]): r for r in apply_formulas(df, FORMULAS, KEYS, width=50, chunk=20).collect()}
    assert whole.keys() == parts.keys()
    for k, a in whole.items():
        for name in FORMULAS:
            p, q = a[name], parts[k][name]
            assert (p is None) == (q is None) and (p is None or abs(p - q) < 1e-9), (k, name, p, q)


def test_backtest_over_slices_equals_one_pass(spark):
    rows = [(k, t, x) for k, t, x in series(11, missing=0.1)]
    df = frame(spark, rows).withColumns({"position": F.round(F.sin("time_ms"), 1), "ret_1": F.col("x") / 100})
    c = signals.BacktestConfig()
    one = signals.drawdown(signals.backtest(df, KEYS, c), KEYS)
    two = signals.drawdown(signals.backtest(df, KEYS, c, width=30), KEYS, width=30)
    a, b = ({(r["s"], r["time_ms"]): r for r in d.collect()} for d in (one, two))
    for k, r in a.items():
        for n in ("held", "turnover", "gross_ret", "net_ret", "equity", "drawdown"):
            assert abs(r[n] - b[k][n]) < 1e-12
    runs = [{r["s"]: r["longest"] for r in d.collect()} for d in (portfolio.longest_drawdown(one, KEYS), portfolio.longest_drawdown(two, KEYS, width=30))]
    assert runs[0] == runs[1]


@pytest.mark.parametrize("chunk", [None, 40])
def test_rolling_figures_equal_pandas(spark, chunk):
    rows = series(5, missing=0.03)
    specs = [Rolling("x", "q", "quantile", 7, 0.3), Rolling("x", "r", "rank", 5), Rolling("x", "z", "robust_z", 6), Rolling("x", "m", "quantile", 1)]
    got = {(r["s"], r["time_ms"]): r for r in roll(frame(spark, rows), specs, KEYS, "time_ms", chunk, 25 if chunk else None).collect()}
    for k, points in by_series(rows).items():
        x = pd.Series([v for _, v in points], dtype=float)
        med = x.rolling(6).median()
        mad = (x - med).abs().rolling(6).median()
        want = {"q": x.rolling(7).quantile(0.3), "r": x.rolling(5).rank(pct=True), "z": ((x - med) / (1.4826 * mad)).where(mad != 0), "m": x}
        for n, (t, _) in enumerate(points):
            for name, w in want.items():
                v = got[k, t][name]
                assert (v is None) == (pd.isna(w[n])) and (v is None or abs(v - w[n]) < 1e-9), (k, t, name)


def test_wide_frames_equal_window_functions(spark, monkeypatch):
    """The same formulas by window functions and by the rolling pass, constant frames and missing values among them."""
    from signalloom.functions import compiler

    df = frame(spark, series(8, missing=0.02)).withColumn("y", F.when(F.col("time_ms") % 400 < 200, F.lit(3.0)).otherwise(F.cos("time_ms") + F.col("x")))
    names = {f"{k}_{v}": f"ts_{k}({v}, 9)" for k in ("mean", "std", "sum", "min", "max", "zscore", "skew", "kurt") for v in "xy"} | {k: f"ts_{k}(x, y, 9)" for k in ("corr", "cov", "beta")}
    plain = {(r["s"], r["time_ms"]): r for r in apply_formulas(df, names, KEYS).collect()}
    monkeypatch.setattr(compiler, "WIDE", 9)
    wide = {(r["s"], r["time_ms"]): r for r in apply_formulas(df, names, KEYS).collect()}
    assert plain.keys() == wide.keys()
    for k, a in plain.items():
        for n in names:
            p, q = a[n], wide[k][n]
            assert (p is None) == (q is None) and (p is None or abs(p - q) < 1e-6 * max(1, abs(p))), (k, n, p, q)


def test_rolling_frames_reach_over_arrow_batches(spark):
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        rows = series(6, missing=0.0)
        got = {(r["s"], r["time_ms"]): r["z"] for r in roll(frame(spark, rows).coalesce(1), [Rolling("x", "z", "robust_z", 20)], KEYS, "time_ms").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    for k, points in by_series(rows).items():
        x = pd.Series([v for _, v in points])
        med = x.rolling(20).median()
        mad = (x - med).abs().rolling(20).median()
        want = ((x - med) / (1.4826 * mad)).where(mad != 0)
        assert all((got[k, t] is None) == pd.isna(w) and (pd.isna(w) or abs(got[k, t] - w) < 1e-9) for (t, _), w in zip(points, want))


@pytest.mark.parametrize("parts", [1, 5, 64])
def test_figures_of_whole_series(spark, parts):
    rows = series(parts, n=300)
    specs = [Whole("x", "r", "rank"), Whole("x", "c", "scale", (2.0,)), Whole("x", "w", "winsorize", (0.1, 0.7))]
    df = over_series(frame(spark, rows), specs, KEYS, parts)
    got = {(r["s"], r["time_ms"]): r for r in df.collect()}
    for k, points in by_series(rows).items():
        x = pd.Series([v for _, v in points], dtype=float)
        want = {"r": x.rank(pct=True), "c": 2 * x / x.abs().sum(), "w": x.clip(x.quantile(0.1), x.quantile(0.7))}
        for n, (t, _) in enumerate(points):
            for name, w in want.items():
                v = got[k, t][name]
                assert (v is None) == pd.isna(w[n]) and (v is None or abs(v - w[n]) < 1e-9)
    assert "Window" not in over_series(frame(spark, rows), specs[1:2], KEYS)._jdf.queryExecution().toString()


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_terciles_of_a_whole_series(spark, seed):
    rows = series(seed, n=200, missing=0.1, keys=("a", "b", "c")) + [("one", 5, 1.0), ("two", 1, 3.0), ("two", 2, 3.0)]
    got = {(r["s"], r["time_ms"]): r["regime"] for r in portfolio.vol_regime(frame(spark, rows), KEYS, "x", parts=seed * 4).collect()}
    want = {}
    for k, points in by_series(rows).items():
        order = sorted((v, t) for t, v in points if v is not None)
        for r, (_, t) in enumerate(order, 1):
            n = len(order)
            want[k, t] = 0 if 3 * (r - 1) < n - 1 else 1 if 3 * (r - 1) < 2 * (n - 1) else 2
    assert got == want


@pytest.mark.parametrize(("width", "parts"), [(40, 6), (10**6, 64), (3, 2), (None, 64)])
def test_terciles_of_a_growing_history(spark, width, parts):
    rows = series(9, n=260, missing=0.1)
    got = {(r["s"], r["time_ms"]): r["regime"] for r in portfolio.expanding_regime(frame(spark, rows), KEYS, "x", 10, width=width, parts=parts).collect()}
    assert len(got) == len(rows)
    for k, points in by_series(rows).items():
        seen = []
        for t, v in points:
            want = None
            if v is not None and len(seen) >= 10:
                lo, hi = np.quantile(seen, [1 / 3, 2 / 3])
                near = min(abs(v - lo), abs(v - hi)) < 1e-12 and v not in seen
                want = 0 if v <= lo else 1 if v <= hi else 2
                if near:
                    want = got[k, t]
            assert got[k, t] == want, (k, t, v)
            if v is not None:
                seen.append(v)


# Tabled values: two-sided 5 % and 1 % points of t, upper 5 % points of F.
T_TABLE = [(1, 12.706, 0.05), (5, 2.571, 0.05), (10, 2.228, 0.05), (10, 3.169, 0.01), (30, 2.042, 0.05), (120, 1.980, 0.05), (100_000, 1.960, 0.05)]
F_TABLE = [(1, 10, 4.965, 0.05), (2, 20, 3.493, 0.05), (5, 5, 5.050, 0.05), (10, 60, 1.993, 0.05), (3, 1000, 2.614, 0.05)]


def test_tail_probabilities_equal_tabled_values(spark):
    t = spark.createDataFrame([(float(n), v, p) for n, v, p in T_TABLE], "free double, t double, p double").select(student_p(F.col("t"), F.col("free")).alias("q"), student_p(-F.col("t"), F.col("free")).alias("m"), "p").collect()
    assert all(abs(r["q"] - r["p"]) < 2e-4 and r["q"] == r["m"] for r in t)
    f = spark.createDataFrame([(float(a), float(b), v, p) for a, b, v, p in F_TABLE], "a double, b double, f double, p double").select(fisher_p(F.col("f"), F.col("a"), F.col("b")).alias("q"), "p").collect()
    assert all(abs(r["q"] - r["p"]) < 2e-4 for r in f)
    g = spark.createDataFrame([(x,) for x in (0.5, 1.0, 3.7, 50.0, 1e5)], "x double").select("x", ln_gamma(F.col("x")).alias("g")).collect()
    assert all(abs(r["g"] - math.lgamma(r["x"])) < 1e-11 * max(1, abs(math.lgamma(r["x"]))) for r in g)
    b = spark.range(1).select(beta_inc(F.lit(2.0), F.lit(3.0), F.lit(0.4)).alias("v"), beta_inc(F.lit(2.0), F.lit(3.0), F.lit(0.0)).alias("z"), beta_inc(F.lit(2.0), F.lit(3.0), F.lit(1.0)).alias("o")).first()
    assert abs(b["v"] - 0.5248) < 1e-12 and (b["z"], b["o"]) == (0.0, 1.0)


def test_regression_equals_least_squares(spark):
    rng = np.random.default_rng(4)
    n = 400
    x = rng.normal(size=(n, 5)) * [1, 10, 0.1, 1, 2] + 3
    y = x @ [0.5, -0.02, 1, 0.2, 0] + rng.normal(size=n)
    names = ["b1", "b2", "e1", "e2", "e3"]
    rows = [(float(y[i]), *map(float, x[i]), "train" if i < 300 else "test") for i in range(n)] + [(None, *[1.0] * 5, "train"), (1.0, None, *[1.0] * 4, "test")]
    df = spark.createDataFrame(rows, "y double, " + ", ".join(f"{c} double" for c in names) + ", segment string").repartition(3)
    one = lambda z: np.column_stack([np.ones(len(z)), z])
    train, test = slice(0, 300), slice(300, n)
    fit = lambda z, t: np.linalg.lstsq(one(z), t, rcond=None)[0]
    b1, bj = fit(x[train, :2], y[train]), fit(x[train], y[train])
    resid = y[train] - one(x[train, :2]) @ b1
    g = fit(x[train, 2:], resid)
    left = resid - one(x[train, 2:]) @ g
    cov = np.linalg.inv(one(x[train, 2:]).T @ one(x[train, 2:])) * (left @ left) / (300 - 4)
    t = g / np.sqrt(np.diag(cov))
    got = {r["signal"]: r for r in regression.ols_coefficients(df, "y", names[:2], names[2:]).collect()}
    for k, name in enumerate(names[2:], 1):
        assert abs(got[name]["coef"] - g[k]) < 1e-9 and abs(got[name]["t"] - t[k]) < 1e-7 and 0 <= got[name]["p"] <= 1
    sse = lambda p, t: float(((t - p) ** 2).sum())
    s1, sj = sse(one(x[train, :2]) @ b1, y[train]), sse(one(x[train]) @ bj, y[train])
    f = ((s1 - sj) / 3) / (sj / (300 - 6))
    tot = lambda v: float(((v - v.mean()) ** 2).sum())
    o1, oj = (1 - sse(p, y[test]) / tot(y[test]) for p in (one(x[test, :2]) @ b1, one(x[test]) @ bj))
    want = {"train_r2_base": 1 - s1 / tot(y[train]), "train_r2_joint": 1 - sj / tot(y[train]), "train_block_f": f, "stage2_residual_r2": 1 - float(left @ left) / s1, "oos_r2_base": o1, "oos_r2_joint": oj, "oos_incremental_r2": oj - o1, "oos_corr_joint": np.corrcoef(y[test], one(x[test]) @ bj)[0, 1]}
    found = {r["metric"]: r["value"] for r in regression.ols_summary(df, "y", names[:2], names[2:]).collect()}
    assert len(found) == 11 and all(abs(found[m] - v) < 1e-8 for m, v in want.items())
    a, b = 3, 294
    grid = np.linspace(f, 400, 4_000_001)
    beta = math.lgamma(a / 2) + math.lgamma(b / 2) - math.lgamma((a + b) / 2)
    density = np.exp(a / 2 * math.log(a / b) + (a / 2 - 1) * np.log(grid) - (a + b) / 2 * np.log1p(a / b * grid) - beta)
    assert abs(found["train_block_f_p"] - np.trapezoid(density, grid)) < 1e-7
    assert regression.ols_summary(df.limit(0), "y", names[:2], names[2:]).count() == 0

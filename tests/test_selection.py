import duckdb
import numpy as np
import pandas as pd
import pytest

from signalloom.operators import selection, signals
from signalloom.functions.libraries import CORE_RULES, candidate_library, core_library, flatten, from_rules, ladder
from signalloom.plans import choice, core, sweeps

SF = "/root/testdata/sf0.001"
# A month of events has too few hourly bars for windows of 2,880: parameters of the rules are divided by 24 here.
SMALL_LIBRARY = flatten(from_rules([r for r in CORE_RULES if r[0] in ("trend", "mean_revert", "volume")], 24))
SMALL_FEATURES = {"ret_1": "ts_returns(close, 1)", "clv": "safe_div(close - low, high - low + 1e-12)", "boll_pos": "safe_div(close - boll_lb, boll_ub - boll_lb)", "vol_log": "log(volume + 1)", "vol_z_60": "ts_zscore(volume, 60)", "range_pct": "safe_div(high - low, close)"}


@pytest.mark.parametrize("name", ["composite_scores", "preferred_signals", "tuned_weights"])
def test_choice_equals_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW part AS SELECT * FROM '{SF}/part.parquet'")
    df, rel = core.QUERIES[name](spark, SF), con.sql(core.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    plain = lambda v: round(float(v), 5) if isinstance(v, float) else v
    rows = lambda found: sorted((tuple(map(plain, r)) for r in found), key=repr)
    got, want = rows(df.select(*rel.columns).collect()), rows(rel.fetchall())
    assert got == want and got


def test_preferences_relax(spark):
    rows = [(f"s{k}", 15, t, 0.06, 0.0, 0.0) for k, t in enumerate([-0.2] * 12 + [-1.0] * 5)]
    df = spark.createDataFrame(rows, "signal string, bar_minutes int, train_sharpe double, test_sharpe double, robust_score double, wf_min double")
    assert selection.preferred(df).count() == 12
    assert selection.preferred(df.where("signal <> 's0'")).count() == 16
    assert selection.preferred(df.limit(0)).count() == 0


def test_catalog_positions_equal_pandas(spark):
    """The hourly signal with smoothing, and its inverse, against pandas."""
    c = signals.BacktestConfig()
    row = selection.CatalogRow("a", 60, 6, 0.3, 4)
    ev = core.events(spark, SF).withColumnRenamed("event_type", "symbol")
    args = ({"a": "ts_delta(close, 2)"}, ["symbol"], "value", "value", ["ts", "event_id"], core.HOUR)
    got = selection.execute_catalog(ev, [row, selection.CatalogRow("a__inv", 60, 6, 0.3, 4)], *args).toPandas()
    bars = core.bars(spark, SF).toPandas().sort_values("time_ms")
    for symbol, b in bars.groupby("symbol"):
        x = b["close"].reset_index(drop=True).diff(2)
        middle = x.rolling(6).median()
        mad = (x - middle).abs().rolling(6).median()
        z = ((x - middle) / (1.4826 * mad.where(mad != 0))).clip(-c.clip, c.clip)
        p = np.tanh(z.where(z.abs() >= 0.3, 0.0).fillna(0.0) / c.clip).ewm(span=4, adjust=False).mean()
        want = (np.rint(np.round(p / c.step, 9)) * c.step).shift(1).fillna(0.0)
        for name, sign in (("a|60min", 1), ("a__inv|60min", -1)):
            own = got[(got["symbol"] == symbol) & (got["signal"] == name)].sort_values("time_ms")["position"].to_numpy()
            assert np.allclose(own, sign * want.to_numpy())
    assert len(got) == 2 * len(bars) and not pd.isna(got["position"]).any()


def test_a_position_holds_until_the_next_slow_bar(spark):
    out = choice.catalog_execution(spark, SF).where("signal = 'sig_momentum__ret_z_6|240min'").toPandas().sort_values(["symbol", "time_ms"])
    block = (out["time_ms"] // (4 * core.HOUR)).rename("block")
    assert (out.groupby(["symbol", block])["position"].nunique() == 1).all()


def test_core_library_is_whole():
    assert {g: len(n) for g, n in core_library().items()} == {"trend": 17, "momentum": 34, "mean_revert": 16, "volatility": 23, "breakout": 24, "volume": 10, "adaptive": 2}
    assert len(flatten(core_library())) == 126


def test_sweep_figures_equal_pandas(spark):
    """One signal, its inverse and both profiles of the sweep, recomputed from the frame."""
    sf = "/root/testdata/sf0.01"
    name, ev = "sig_trend__price_ma_dist_240", core.events(spark, sf).withColumnRenamed("event_type", "symbol")
    one = {name: SMALL_LIBRARY[name]}
    report = selection.sweep(ev, one, ["symbol"], "value", "value", ["ts", "event_id"], sweeps.EDGE, [60], [selection.Profile(720, 0.28, 6), selection.Profile(720, 0.35, 1, "sign")], features=SMALL_FEATURES).toPandas()
    bars = selection.B.resample_ohlcv(ev, core.HOUR, ["symbol"], "value", "value", ["ts", "event_id"])
    frame = selection.feature_frame(bars, ["symbol"], one, SMALL_FEATURES).toPandas()
    assert set(report["signal"]) == {name, name + "__inv"} and len(report) == 5 * 2 * 2
    for symbol, b in frame.groupby("symbol"):
        b = b.sort_values("time_ms").dropna(subset=[name])
        x = b[name].astype(float)
        middle = x.rolling(16).median()
        mad = (x - middle).abs().rolling(16).median()
        z = ((x - middle) / (1.4826 * mad.where(mad != 0))).clip(-2.5, 2.5)
        held = np.sign(z.where(z.abs() >= 0.35, 0.0).fillna(0.0)).shift(1).fillna(0.0)
        net = held * b["ret_1"].fillna(0.0) - held.diff().abs().fillna(0.0) * 0.0004
        for segment, part in (("train", net[b["time_ms"] < sweeps.EDGE]), ("test", net[b["time_ms"] >= sweeps.EDGE])):
            row = report[(report["symbol"] == symbol) & (report["signal"] == name) & (report["profile"] == 1)].iloc[0]
            assert row[f"{segment}_obs"] == len(part) and np.isclose(row[f"{segment}_sharpe"], part.mean() / part.std(ddof=0) * 8760**0.5)


def plain_position(x, n, deadband, span, mode, c):
    """Position of one signal by pandas."""
    middle = x.rolling(n).median()
    mad = (x - middle).abs().rolling(n).median()
    z = ((x - middle) / (1.4826 * mad.where(mad != 0))).clip(-c.clip, c.clip)
    z = z if deadband <= 0 else z.where(z.abs() >= deadband, 0.0)  # a missing z is flat inside a band
    p = np.sign(z) if mode == "sign" else np.tanh(z / c.clip)
    if span > 1:
        p = p.ewm(span=span, adjust=False).mean()
    return np.rint(np.round(p / c.step, 9)) * c.step


def plain_figures(net, bars):
    folds = [net[k * (len(net) // 6) : (k + 1) * (len(net) // 6) if k < 5 else len(net)] for k in range(6)]
    sharpe = lambda v: v.mean() / v.std() * bars**0.5 if v.std() > 0 else np.nan
    s = np.array([sharpe(f) for f in folds])
    low, spread = np.nanmin(s) if (~np.isnan(s)).any() else np.nan, np.nanstd(s) if (~np.isnan(s)).any() else np.nan
    return sharpe(net), low, sharpe(net) + 0.45 * low - 0.25 * spread


PROFILES = [selection.Profile(16, 0.0, 0), selection.Profile(24, 0.2, 5), selection.Profile(16, 0.4, 3, "sign")]


def test_research_chooses_as_pandas(spark):
    """Every signal, direction and profile over a whole sample, then the best of each, then one of each family."""
    rng = np.random.default_rng(2)
    n, names = 400, {"sig_a__one_x_1": "x", "sig_a__one_x_2": "y", "sig_b__two_x": "x * y"}
    rows = [(s, k * 3_600_000, *map(float, (50, 51, 49, 50 + np.cumsum(rng.normal(size=1))[0], 5)), float(rng.normal()), float(rng.integers(0, 5))) for s in "uv" for k in range(n)]
    bars = spark.createDataFrame(rows, "symbol string, time_ms long, open double, high double, low double, close double, volume double, x double, y double")
    c = signals.BacktestConfig(bars_per_year=8760)
    best = {(r["symbol"], r["signal"]): r for r in selection.research(bars, names, ["symbol"], 60, PROFILES, {"ret_1": "ts_returns(close, 1)"}).collect()}
    assert len(best) == 12
    frame = selection.feature_frame(bars, ["symbol"], names, {"ret_1": "ts_returns(close, 1)"}).toPandas().sort_values("time_ms")
    for s, b in frame.groupby("symbol"):
        for name in names:
            own = b.dropna(subset=[name])
            ret = own["ret_1"].fillna(0.0).to_numpy()
            want = {1: [], -1: []}
            for p in PROFILES:
                held = plain_position(own[name].astype(float).reset_index(drop=True), p.z_window, p.deadband, p.smooth_span, p.mode, c).shift(1).fillna(0.0)
                cost = held.diff().abs().fillna(0.0).to_numpy() * c.cost
                for d in (1, -1):
                    want[d].append(plain_figures(d * held.to_numpy() * ret - cost, 8760))
            for d, suffix in ((1, ""), (-1, "__inv")):
                k = max(range(3), key=lambda k: (want[d][k][2], want[d][k][0]))
                got = best[s, name + suffix]
                assert got["profile"] == k and got["obs"] == len(own)
                assert np.allclose([got["sharpe"], got["wf_min"], got["robust_score"]], want[d][k])
    report = spark.createDataFrame([tuple(r) for r in best.values()], ["symbol", "signal", "profile", "obs", "sharpe", "triggers", "wf_min", "robust_score"])
    top = selection.one_of_each_family(report, ["symbol"], ["robust_score", "sharpe"], 2).collect()
    for s in "uv":
        order = sorted((r for k, r in best.items() if k[0] == s), key=lambda r: (-r["robust_score"], -r["sharpe"], r["signal"]))
        taken, want = set(), []
        for r in order:
            key = "_".join(r["signal"].split("__")[-1].split("_")[:2])
            if key not in taken:
                taken.add(key)
                want.append(r["signal"])
        assert [r["signal"] for r in sorted((r for r in top if r["symbol"] == s), key=lambda r: r["place"])] == want[:2]


def test_event_candidates_are_active_and_best(spark):
    rows = [("a", 60, 0, 1.0, 0.5, 1.0, 0.1, 20, 12), ("a", 60, 1, 1.2, 0.1, 1.0, 0.1, 20, 12), ("a", 240, 0, 0.2, 0.2, 0.1, 0.0, 15, 10), ("b", 60, 0, 9.0, 9.0, 9.0, 9.0, 14, 50), ("c", 60, 0, None, 0.3, None, None, 40, 40)]
    report = spark.createDataFrame(rows, "signal string, bar_minutes int, profile int, train_sharpe double, test_sharpe double, robust_score double, wf_min double, is_triggers long, os_triggers long")
    got = {(r["signal"], r["bar_minutes"]): r for r in selection.sweep_candidates(report).collect()}
    assert set(got) == {("a", 60), ("a", 240), ("c", 60)}
    assert got["a", 60]["profile"] == 1 and abs(got["a", 60]["train_test_gap"] - 1.1) < 1e-12 and abs(got["c", 60]["train_test_gap"] - 0.3) < 1e-12


def test_generated_libraries_have_their_sizes():
    assert {g: len(n) for g, n in candidate_library().items()} == {"trend": 21, "momentum": 31, "mean_revert": 16, "volatility": 20, "breakout": 30, "adaptive": 5}
    assert len(sweeps.event_signals()) == 29 + 4 * len(sweeps.EVENT_COLUMNS)
    assert ladder(5, 24, 240) == [24, 43, 76, 135, 240] and ladder(3, 1, 1) == [1, 2, 3]

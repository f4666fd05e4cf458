import math
import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from signalloom.functions.compiler import FormulaError, apply_formulas
from signalloom.functions.smoothing import Smoothing, ewm, smooth
from signalloom import catalog
from signalloom.operators import bars, portfolio, quality, signals, wallets
from signalloom.plans import core, wallet
from signalloom.sources import payloads
from signalloom.streaming import minutes

SF = "/root/testdata/sf0.001"


def series(spark, values, name="x"):
    return spark.createDataFrame([("a", k, v) for k, v in enumerate(values)], f"s string, time_ms long, {name} double")


def column(df, name="out"):
    return [r[name] for r in df.orderBy("time_ms").collect()]


VALUES = [None, 3.0, 1.0, 2.0, 2.0, 2.0, 2.0, 5.0, -1.0, 0.0, 4.0, 4.5]


def near(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b):
        x, y = (None if v is None or pd.isna(v) or math.isinf(v) else v for v in (x, y))
        assert (x is None) == (y is None) and (x is None or abs(x - y) < 1e-9), (a, b)


@pytest.mark.parametrize("name,expected", [
    ("ts_mean(x, 4)", lambda p: p.rolling(4).mean()), ("ts_std(x, 4)", lambda p: p.rolling(4).std()), ("ts_skew(x, 5)", lambda p: p.rolling(5).skew()),
    ("ts_kurt(x, 5)", lambda p: p.rolling(5).kurt()), ("ts_rank(x, 4)", lambda p: p.rolling(4).rank(pct=True)), ("ts_quantile(x, 4, 0.3)", lambda p: p.rolling(4).quantile(0.3)),
    ("ts_ema(x, 3)", lambda p: p.ewm(span=3, adjust=False, min_periods=3).mean()), ("rank(x)", lambda p: p.rank(pct=True)), ("last(x)", lambda p: p.ffill().shift(1)),
    ("ts_returns(x, 2)", lambda p: p.ffill().pct_change(2)), ("ts_sum(ts_delay(x, 1), 3)", lambda p: p.shift(1).rolling(3).sum()), ("-x + 2 * x / 4", lambda p: -p + p / 2),
])
def test_formula_matches_pandas(spark, name, expected):
    near(column(apply_formulas(series(spark, VALUES), {"out": name}, ["s"])), [*expected(pd.Series(VALUES, dtype=float))])


def test_smoothing_over_bucket_edges(spark):
    p = pd.Series([math.sin(k) * 10 + k for k in range(500)])
    near([round(v, 6) for v in column(ewm(series(spark, p.tolist()), "x", "out", ["s"], "time_ms", 0.2))], [round(v, 6) for v in p.ewm(alpha=0.2, adjust=False).mean()])


@pytest.mark.parametrize("bad", ["__import__('os')", "x.y", "nope(x)", "missing + 1", "x if x else 1", "[x]"])
def test_formula_language_is_closed(spark, bad):
    with pytest.raises(FormulaError):
        apply_formulas(series(spark, VALUES), {"out": bad}, ["s"])


@pytest.mark.parametrize("decay", [True, False])
def test_smoothing_with_gaps_in_any_batch(spark, decay):
    """Several series, NULLs at the start and inside, batches that end anywhere, two smoothings at once."""
    rng = __import__("random").Random(3)
    data = {s: [rng.gauss(0, 5) if rng.random() > 0.3 else None for _ in range(n)] for s, n in (("a", 57), ("b", 1), ("c", 23), ("d", 0), ("e", 40))}
    data["c"] = [None] * 23
    df = spark.createDataFrame([(s, k, v) for s, x in data.items() for k, v in enumerate(x)], "s string, time_ms long, x double").repartition(5)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    out = smooth(df, [Smoothing("x", "p", 0.3, 4, decay), Smoothing("x", "q", 0.9, 1, decay)], ["s"], "time_ms").toPandas()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    for s, x in data.items():
        own, p = out[out["s"] == s].sort_values("time_ms"), pd.Series(x, dtype=float)
        near(own["p"].tolist() if len(x) else [], p.ewm(alpha=0.3, adjust=False, ignore_na=not decay, min_periods=4).mean().tolist())
        near(own["q"].tolist() if len(x) else [], p.ewm(alpha=0.9, adjust=False, ignore_na=not decay).mean().tolist())


def test_plans_of_smoothings_stay_small(spark):
    bars_df = core.bars(spark, SF)
    many = apply_formulas(bars_df, {f"e{n}": f"ts_ema(close, {n}) - ts_ema(open, {n})" for n in range(2, 22)}, ["symbol"])
    for df in (many, bars.add_indicators(bars_df, ["symbol"])):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1 and plan.count("Exchange") <= 6, plan


@pytest.mark.parametrize("n", [0, 1, 5, 119, 120, 126])
def test_walk_forward_of_short_series(spark, n):
    ret = [((k * 7919) % 101 - 48) / 1000 for k in range(n)]
    df = spark.createDataFrame([("a", k, v) for k, v in enumerate(ret)] + [("a", 10_000, None)], "s string, time_ms long, net_ret double")
    (row,) = signals.walk_forward(df, ["s"], 6, signals.BacktestConfig()).collect()
    sharpe = lambda x: x.mean() / x.std(ddof=0) * 8760**0.5
    if n < 120:
        assert row["wf_min"] is row["wf_mean"] is row["robust_score"] is None
    else:
        p = pd.Series(ret)
        folds = pd.Series([sharpe(p[k * (n // 6) : (k + 1) * (n // 6) if k < 5 else n]) for k in range(6)])
        near([row["wf_min"], row["wf_mean"], row["wf_std"]], [folds.min(), folds.mean(), folds.std(ddof=0)])
        near([row["robust_score"]], [sharpe(p) + 0.45 * folds.min() - 0.25 * folds.std(ddof=0)])


@pytest.mark.parametrize("chunk", [1, 30, 64])
def test_zscores_in_overlapping_parts_are_the_same(spark, chunk):
    rng = __import__("random").Random(chunk)
    df = spark.createDataFrame([(s, k, rng.gauss(0, 1) if rng.random() > 0.02 else None) for s, n in (("a", 200), ("b", 31), ("c", 3)) for k in range(n)], "s string, time_ms long, x double")
    one, two = (signals.robust_zscore(df, "x", "z", ["s"], 8, c) for c in (None, chunk))
    assert one.columns == two.columns == ["s", "time_ms", "x", "z"]
    assert sorted(map(repr, one.collect())) == sorted(map(repr, two.collect()))


def test_one_arm_of_the_band_serves_both_sides():
    c = signals.BacktestConfig
    assert c(deadband_long=0.5).band == (0.5, 0.5) and c(deadband_short=0.4).band == (0.4, 0.4) and c(deadband=0.2, deadband_long=0.5).band == (0.5, 0.2) and c().band == (0.0, 0.0)
    assert signals.scaled_window(240, 60) == 16 and signals.scaled_window(1440, 15) == 96 and signals.frequency_label(60) == "1h" and signals.frequency_label(15) == "15m"


def test_formulas_see_earlier_ones_and_hide_helpers(spark):
    out = apply_formulas(series(spark, VALUES), {"a": "ts_mean(x, 2)", "b": "ts_delta(a, 1)"}, ["s"])
    assert out.columns == ["s", "time_ms", "x", "a", "b"]


def test_causal(spark):
    changed = VALUES[:-1] + [99.0]
    for f in ("ts_zscore(x, 3)", "ts_decay(x, 3)", "ts_ema(x, 2)"):
        a, b = (column(apply_formulas(series(spark, v), {"out": f}, ["s"])) for v in (VALUES, changed))
        assert a[:-1] == b[:-1]


def test_right_closed_bars(spark):
    df = spark.createDataFrame([("a", k * 60_000, float(k), k) for k in range(12)], "s string, time_ms long, v double, k int")
    out = bars.resample_ohlcv(df, 300_000, ["s"], "v", "v", ["k"]).orderBy("time_ms")
    assert [r["volume"] for r in out.collect()] == [0, 15, 40, 11]


def test_asof_starts_at_zero(spark):
    slow = spark.createDataFrame([("a", 5, 1.0), ("a", 9, 2.0)], "s string, time_ms long, p double")
    fast = spark.createDataFrame([("a", k) for k in range(4, 11)], "s string, time_ms long")
    assert column(signals.asof_backward(slow, fast, ["s"], "p"), "p") == [0, 1, 1, 1, 1, 2, 2]


def test_positions_lie_on_the_ladder(spark):
    c = signals.BacktestConfig(deadband=0.5)
    z = [-9.0, -0.5, -0.49, 0.0, 0.5, 1.3, 9.0, None]
    got = column(series(spark, z, "z").withColumn("out", signals.position(F.col("z"), c)))
    assert all(abs(p) <= 1 and abs(p * 10 - round(p * 10)) < 1e-9 for p in got) and got[2] == got[3] == got[7] == 0 and got[1] == -got[4] != 0


def test_net_is_gross_less_cost(spark):
    df = core.trace(spark, SF)
    assert df.where("abs(gross_ret - cost_ret - net_ret) > 1e-12").count() == 0


def test_gaps_split_only_at_large_breaks(spark):
    day = 86_400_000
    df = spark.createDataFrame([("a", t) for t in (0, 60_000, 240_000, 2 * day + 240_000)], "s string, time_ms long")
    assert quality.latest_segment(df, ["s"], day).count() == 1 and quality.missing_points(df.where("time_ms < 300000"), ["s"], 60_000).count() == 2


def test_archetype_ties_take_the_first(spark):
    rows = [(str(u), *([1.0] * len(wallets.RANKED))) for u in range(4)]
    out = wallets.score_archetypes(spark.createDataFrame(rows, "user string, " + ", ".join(f"{f} double" for f in wallets.RANKED))).collect()
    assert {(r["dominant_archetype"], r["avg_leverage_rank"]) for r in out} == {("high_conviction", 0.625)} or len({r["dominant_archetype"] for r in out}) == 1


@pytest.mark.parametrize("buckets", [1, 4, 200])
def test_global_ranks_are_average_ties(spark, buckets):
    rng = __import__("random").Random(buckets)
    values = [float(rng.choice([1, 1, 1, 2, 3, rng.random() * 9])) for _ in range(300)] + [None] * 5
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 7.0)] * 3, "feature string, value double")
    got = {(r["feature"], r["value"]): (r["upto"] - (r["n"] - 1) / 2) for r in wallets.global_ranks(df, "feature", "value", buckets).collect()}
    want = pd.Series(values, dtype=float).rank()
    assert all(abs(got["a", v] - w) < 1e-9 for v, w in zip(values, want) if v is not None) and got["b", 7.0] == 2


def test_payload_times(spark):
    df = spark.createDataFrame([("1700000000",), ("1700000000000",), ("2023-11-14 22:13:20",), ("x",), (None,)], "t string")
    assert [r[0] for r in df.select(payloads.to_epoch_ms(F.col("t"))).collect()] == [1700000000000] * 3 + [None, None]
    ragged = spark.createDataFrame([([1, 2, 3], ["a"])], "x array<int>, y array<string>")
    assert [tuple(r) for r in payloads.explode_parallel(ragged, ["x", "y"]).collect()] == [(1, "a"), (2, None), (3, None)]
    assert payloads.job_of("open_interest_btcusdt_binance_15m.csv") == ("open_interest", "15m")


def test_stream_equals_batch(spark, tmp_path):
    ev = spark.read.parquet(f"{SF}/events.parquet")
    ev.repartition(3).write.parquet(str(tmp_path / "in"))
    minutes.replay(spark, str(tmp_path / "in"), ev.schema, str(tmp_path / "ck"), "replayed")
    assert sorted(map(tuple, spark.table("replayed").collect())) == sorted(map(tuple, minutes.minute_features(ev).collect()))


def test_two_stage_improves_in_sample(spark):
    rows = {r["segment"]: r for r in core.ols_two_stage(spark, SF).collect()}
    assert rows["train"]["r2_joint"] >= rows["train"]["r2_base"] - 1e-9


def test_empty_series(spark):
    empty = series(spark, [])
    assert apply_formulas(empty, {"out": "ts_ema(ts_zscore(x, 3), 2)"}, ["s"]).count() == 0
    assert portfolio.vol_regime(empty, ["s"], "x").count() == 0


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(v, 4) + 0.0 if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(set(catalog.ORACLE_SQL) - {"composite_scores", "preferred_signals", "tuned_weights"}))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    df = catalog.QUERIES[name](spark, SF)
    rel = con.sql(catalog.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    order = [rel.columns.index(c) for c in df.columns]
    key = lambda rows: sorted([tuple(map(plain, r)) for r in rows], key=repr)
    a, b = key(df.collect()), key([[r[i] for i in order] for r in rel.fetchall()])
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all(p == q or (isinstance(p, float) and isinstance(q, float) and abs(p - q) <= 2e-4) for p, q in zip(x, y)), (x, y)


def test_wallet_minutes_without_exposure_equal_sql(spark, tmp_path):
    """A position of value 0 alone in its minute: the query follows its SQL, the operator has no ratio."""
    con = duckdb.connect()
    con.sql(f"COPY (SELECT * REPLACE (CASE WHEN event_id % 9 = 1 THEN 0 ELSE value END AS value) FROM '{SF}/events.parquet') TO '{tmp_path}/events.parquet'")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    df = catalog.QUERIES["wallet_minute_state"](spark, str(tmp_path))
    rel = con.sql(catalog.ORACLE_SQL["wallet_minute_state"])
    assert df.columns == rel.columns and df.where("abs_exposure = 0").count() > 50
    a, b = (sorted([tuple(map(plain, r)) for r in rows], key=repr) for rows in (df.collect(), rel.fetchall()))
    assert a == b
    states = wallets.wallet_minutes(wallet.traded(spark, str(tmp_path)))
    assert states.where("(net_exposure_ratio is null) <> (abs_exposure = 0)").count() == 0

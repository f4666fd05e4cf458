"""Choosing among evaluated signals and executing the chosen ones.

A report has one row a signal, bar size and profile: ``signal, bar_minutes, train_sharpe,
test_sharpe, robust_score, wf_min, is_triggers, os_triggers``.  Missing figures count as
zero unless stated otherwise.  Scores that see ``test_sharpe`` are selected on the test
part and say nothing about unseen data.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.compiler import apply_formulas
from ..functions.libraries import CORE_FEATURES, FEATURES, INDICATOR_COLUMNS
from ..functions.rolling import Rolling, roll
from ..functions.smoothing import Smoothing, smooth
from ..workspace import Workspace
from . import bars as B
from . import signals as S

KEY = ["signal", "bar_minutes"]

# Weights of the tuning grid, then its trigger penalties and targets.
WEIGHTS = ("w_train", "w_test", "w_robust", "w_wf", "w_consistency", "w_profitability")
WEIGHT_SETS = [
    (0.20, 0.45, 0.15, 0.05, 0.10, 0.05),
    (0.18, 0.48, 0.12, 0.05, 0.10, 0.07),
    (0.22, 0.40, 0.18, 0.05, 0.10, 0.05),
    (0.15, 0.50, 0.12, 0.06, 0.10, 0.07),
    (0.20, 0.42, 0.15, 0.08, 0.10, 0.05),
    (0.15, 0.45, 0.15, 0.05, 0.15, 0.05),
]
TRIGGER_PENALTIES = [0.04, 0.06, 0.08, 0.10]
TARGETS_IN_SAMPLE = [16.0, 24.0, 32.0]
TARGETS_OUT_OF_SAMPLE = [4.0, 8.0, 12.0]
GRID = ("grid_id", *WEIGHTS, "w_penalty", "target_is", "target_os")


def clipped(x: Column, low: float, high: float) -> Column:
    return F.when(x < low, F.lit(low)).when(x > high, F.lit(high)).otherwise(x)


def known(name: str, default: float = 0.0) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(default))


def in_sample_score() -> Column:
    """Train figures only: Sharpe, robustness and worst fold, less a penalty for few triggers."""
    wf = known("wf_min")
    rare = clipped((24.0 - known("is_triggers")) / 24.0, 0.0, 1.0)
    score = 0.5 * clipped(known("train_sharpe"), -2.0, 8.0) + 0.4 * clipped(known("robust_score"), -5.0, 10.0) + 0.1 * clipped(wf, -4.0, 6.0) - 0.08 * rare
    return score - F.when(wf < -0.8, 0.12 * F.abs(wf)).otherwise(0.0)


def sweep_score() -> Column:
    """Robustness first, then test, worst fold and train; a missing test or fold is heavily punished."""
    test, wf = known("test_sharpe", -99.0), known("wf_min", -99.0)
    score = 0.38 * known("robust_score") + 0.32 * clipped(test, -4.0, 6.0) + 0.18 * clipped(wf, -4.0, 6.0) + 0.12 * clipped(known("train_sharpe"), -2.0, 8.0)
    return score - F.when(test < -0.15, 0.55 * F.abs(test)).otherwise(0.0) - F.when(wf < -0.8, 0.25 * F.abs(wf)).otherwise(0.0)


def tuned_score() -> Column:
    """The score under the weights of a grid row, which are columns."""
    train, test = known("train_sharpe"), known("test_sharpe")
    rare = lambda n, target: clipped((F.col(target) - known(n)) / F.greatest(F.col(target), F.lit(1.0)), 0.0, 1.0)
    parts = {
        "w_train": clipped(train, -3.0, 8.0),
        "w_test": clipped(test, -3.0, 8.0),
        "w_robust": clipped(known("robust_score"), -6.0, 10.0),
        "w_wf": clipped(known("wf_min"), -5.0, 6.0),
        "w_consistency": clipped(-F.abs(train - test), -4.0, 0.0),
        "w_profitability": clipped(F.least(train, test), -3.0, 5.0),
    }
    score = sum((F.col(w) * parts[w] for w in WEIGHTS[1:]), F.col("w_train") * parts["w_train"])
    return score - F.col("w_penalty") * (rare("is_triggers", "target_is") + 0.7 * rare("os_triggers", "target_os"))


def grid_rows() -> list[tuple]:
    rest = product(WEIGHT_SETS, TRIGGER_PENALTIES, TARGETS_IN_SAMPLE, TARGETS_OUT_OF_SAMPLE)
    return [(k, *w, p, a, b) for k, (w, p, a, b) in enumerate(rest)]


def grid(spark: SparkSession) -> DataFrame:
    """The 216 weightings, one row each."""
    return spark.createDataFrame(grid_rows(), "grid_id int, " + ", ".join(f"{n} double" for n in GRID[1:]))


def eligible(report: DataFrame, least_is: int = 15, least_os: int = 10) -> DataFrame:
    """Rows with enough triggers in both parts."""
    return report.where((F.col("is_triggers") >= least_is) & (F.col("os_triggers") >= least_os))


def best_profile(report: DataFrame, score: str, then: list[str]) -> DataFrame:
    """The best row of each signal and bar size."""
    order = Window.partitionBy(*KEY).orderBy(F.col(score).desc_nulls_last(), *(F.col(c).desc_nulls_last() for c in then))
    return report.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")


def preferred(report: DataFrame, top: int = 30, enough: tuple[int, int] = (22, 12)) -> DataFrame:
    """The ``top`` rows of the strictest of three tests that leaves enough rows.

    One aggregate counts the rows of each test; nothing is collected.
    """
    train, test = F.col("train_sharpe"), F.col("test_sharpe")
    tests = [(train > 0.05) & (test > 0.08), (train > -0.25) & (test > 0.05), test > 0.02]
    counts = report.agg(F.count_if(tests[0]).alias("__n0"), F.count_if(tests[1]).alias("__n1"))  # one row
    fit = F.when(F.col("__n0") >= enough[0], tests[0]).when(F.col("__n1") >= enough[1], tests[1]).otherwise(tests[2])
    order = [F.col(c).desc_nulls_last() for c in ("test_sharpe", "robust_score", "train_sharpe", "wf_min")]
    return report.crossJoin(F.broadcast(counts)).where(fit).drop("__n0", "__n1").orderBy(*order, *KEY).limit(top)


def tune(report: DataFrame, weights: DataFrame, top: int = 30) -> DataFrame:
    """Objective of each weighting over its ``top`` rows, the best weighting first (``place`` 1).

    ``weights`` is a grid of a stated size, so it is broadcast to the report.
    """
    scored = report.crossJoin(F.broadcast(weights)).withColumn("score", F.round(tuned_score(), 9))
    order = [F.col(c).desc_nulls_last() for c in ("score", "test_sharpe", "train_sharpe", "robust_score")]
    one = scored.withColumn("__r", F.row_number().over(Window.partitionBy("grid_id", *KEY).orderBy(*order))).where("__r = 1")
    chosen = one.withColumn("__r", F.row_number().over(Window.partitionBy("grid_id").orderBy(*order, *KEY))).where(F.col("__r") <= top)
    train, test = F.col("train_sharpe"), F.col("test_sharpe")
    out = chosen.groupBy("grid_id").agg(
        F.round(0.3 * F.avg(test) + 0.7 * F.avg(train), 9).alias("weighted_sharpe"), F.round(F.avg((test > 0).cast("double")), 9).alias("profitable"),
        F.round(F.avg(F.abs(train - test)), 9).alias("gap"), F.round(F.median(test), 9).alias("median_test"),
    )
    best = Window.orderBy(F.desc("weighted_sharpe"), F.desc("profitable"), "gap", F.desc("median_test"), "grid_id")  # a row a weighting
    return out.withColumn("place", F.row_number().over(best))


@dataclass(frozen=True)
class Profile:
    """How a signal becomes a position; ``z_window`` in one-minute bars."""

    z_window: int
    deadband: float
    smooth_span: int
    mode: str = "tanh"


# Bar sizes in minutes and execution profiles of the sweep.
SWEEP_MINUTES = [5, 15, 30, 60]
SWEEP_PROFILES = [Profile(360, 0.28, 6), Profile(480, 0.35, 8), Profile(720, 0.42, 10), Profile(480, 0.35, 8, "sign")]


def feature_frame(bars: DataFrame, keys: list[str], signals: dict[str, str], features: dict[str, str] | None = None) -> DataFrame:
    """Bars with indicators, features and signals, all in single precision as the sweep reads them."""
    columns = bars.columns
    made = B.add_indicators(bars, keys).withColumnsRenamed({v: k for k, v in INDICATOR_COLUMNS.items()}).drop("tr", "atr_14")
    made = apply_formulas(made, {"ma": "ts_mean(close, 20)", "ema": "ts_ema(close, 20)"} | (CORE_FEATURES if features is None else features) | signals, keys)
    return made.select(*columns, "ret_1", *(F.col(s).cast("float").alias(s) for s in signals))


def sweep(df: DataFrame, signals: dict[str, str], keys: list[str], price: str, volume: str, order: list[str], edge_ms: int, minutes: list[int] = SWEEP_MINUTES, profiles: list[Profile] = SWEEP_PROFILES, least: int = 120, features: dict[str, str] | None = None, config: S.BacktestConfig = S.BacktestConfig()) -> DataFrame:
    """One row a series, signal, direction, bar size and profile, with train and test figures.

    Compiled in stages: the frame of all bar sizes is written once, with the size as one more
    key, and all formulas in it share their common parts; profiles with one z window share its scores; all profiles and both
    directions of a signal run side by side as columns of one ordered pass, since a symmetric
    band makes the inverse of a position its negative.  Robustness is that of the train part;
    rows with fewer than ``least`` bars on either side are left out.
    """
    sizes = [B.resample_ohlcv(df, size * 60_000, keys, price, volume, order).withColumn("bar_minutes", F.lit(size)) for size in minutes]
    frame = feature_frame(reduce(DataFrame.unionByName, sizes), [*keys, "bar_minutes"], signals, features)
    return sweep_frame(frame, [*signals], keys, edge_ms, minutes, profiles, least, config)


def sweep_frame(bars: DataFrame, signals: list[str], keys: list[str], edge_ms: int, minutes: list[int], profiles: list[Profile], least: int = 120, config: S.BacktestConfig = S.BacktestConfig()) -> DataFrame:
    """The sweep over a frame that holds ``bar_minutes``, ``ret_1`` and a column a signal."""
    ws, out = Workspace(bars.sparkSession, "sweep"), None
    whole = ws.save(bars.select(*keys, "bar_minutes", "time_ms", "ret_1", *signals))
    for size in minutes:
        frame = whole.where(F.col("bar_minutes") == size).drop("bar_minutes")
        windows = {p.z_window: S.scaled_window(p.z_window, size) for p in profiles}
        train, test = _judged(ws, frame, signals, keys, F.col("time_ms") < edge_ms, profiles, windows, replace(config, bars_per_year=525_600 / size))
        train = train.select(*(F.col(a).alias(b) for a, b in zip(train.columns, [*keys, "signal", "profile", "train_obs", "train_sharpe", "is_triggers", "wf_min", "robust_score"])))
        row = train.join(test.select(*keys, "signal", "profile", F.col("obs").alias("test_obs"), F.col("sharpe").alias("test_sharpe"), F.col("triggers").alias("os_triggers")), [*keys, "signal", "profile"])
        row = row.where((F.col("train_obs") >= least) & (F.col("test_obs") >= least)).withColumn("bar_minutes", F.lit(size))
        out = row if out is None else out.unionByName(row)
    return out


def sweep_candidates(report: DataFrame, least_is: int = 15, least_os: int = 10) -> DataFrame:
    """Rows with enough triggers, with the gap of their Sharpe figures and their in-sample score: the best profile of each signal and bar size."""
    gap = F.abs(known("train_sharpe") - known("test_sharpe"))
    scored = eligible(report, least_is, least_os).withColumns({"train_test_gap": gap, "composite_is": F.round(in_sample_score(), 9)})
    return best_profile(scored, "composite_is", ["train_sharpe", "robust_score", "wf_min"])


# Execution profiles of the research runner; windows in bars.
RESEARCH_PROFILES = [
    Profile(240, 0.0, 0), Profile(360, 0.15, 4), Profile(480, 0.2, 6), Profile(720, 0.3, 12),
    Profile(960, 0.45, 18), Profile(1440, 0.6, 24), Profile(720, 0.45, 12, "sign"), Profile(1440, 0.6, 24, "sign"),
]


def research(bars: DataFrame, signals: dict[str, str], keys: list[str], bar_minutes: int, profiles: list[Profile] = RESEARCH_PROFILES, features: dict[str, str] | None = None, config: S.BacktestConfig = S.BacktestConfig()) -> DataFrame:
    """The best profile of each signal and direction over the whole sample, by robustness and then Sharpe."""
    ws = Workspace(bars.sparkSession, "research")
    frame = ws.save(feature_frame(bars, keys, signals, features).select(*keys, "time_ms", "ret_1", *signals))
    whole, _ = _judged(ws, frame, [*signals], keys, F.lit(True), profiles, {p.z_window: p.z_window for p in profiles}, replace(config, bars_per_year=525_600 / bar_minutes))
    order = Window.partitionBy(*keys, "signal").orderBy(F.col("robust_score").desc_nulls_last(), F.col("sharpe").desc_nulls_last(), "profile")
    return whole.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")


def family(signal: Column) -> Column:
    """The first two words of a signal's last name part; so all inverse signals are one family."""
    return F.array_join(F.slice(F.split(F.element_at(F.split(signal, "__"), -1), "_"), 1, 2), "_")


def one_of_each_family(report: DataFrame, keys: list[str], order: list[str], top: int) -> DataFrame:
    """In the order of figures a row enters if no row of its family has; the first ``top`` of a key.

    That is the first row of each family: kept a family by partial aggregation, so a key
    with any number of rows is never one group.
    """
    rank = F.struct(*(F.coalesce(-F.col(c).cast("double"), F.lit(float("inf"))) for c in order), "signal")
    first = report.groupBy(*keys, family(F.col("signal")).alias("family")).agg(F.min_by(F.struct(*(c for c in report.columns if c not in keys)), rank).alias("row"))
    place = Window.partitionBy(*keys).orderBy(*(F.col(f"row.{c}").desc_nulls_last() for c in order), "row.signal")
    return first.withColumn("place", F.row_number().over(place)).where(F.col("place") <= top).select(*keys, "family", "row.*", "place")


FOLDS = 6


def _judged(ws: Workspace, frame: DataFrame, signals: list[str], keys: list[str], early: Column, profiles: list[Profile], windows: dict[int, int], c: S.BacktestConfig) -> tuple[DataFrame, DataFrame]:
    """Figures of one bar size from its saved frame: of the ``early`` part with its folds, and of the rest."""
    by = [*keys, "signal"]
    long = frame.unpivot([*keys, "time_ms", "ret_1"], signals, "signal", "raw").where("raw is not null").withColumn("raw", F.col("raw").cast("double"))
    long = roll(long, [Rolling("raw", f"z{n}", "robust_z", n) for n in sorted(set(windows.values()))], by, "time_ms")
    shapes = {f"p{k}": (S.squash if p.smooth_span > 1 else S.position)(F.col(f"z{windows[p.z_window]}"), replace(c, deadband=p.deadband), p.mode) for k, p in enumerate(profiles)}
    held = smooth(long.withColumns(shapes).drop("raw"), [Smoothing(f"p{k}", f"p{k}", 2 / (p.smooth_span + 1)) for k, p in enumerate(profiles) if p.smooth_span > 1], by, "time_ms")
    held = held.withColumns({f"p{k}": F.rint(F.round(F.col(f"p{k}") / c.step, 9)) * c.step for k, p in enumerate(profiles) if p.smooth_span > 1})

    order = Window.partitionBy(*by).orderBy("time_ms")
    held = held.withColumns({"train": early, "was_train": F.lag(early).over(order)} | {f"h{k}": F.coalesce(F.lag(f"p{k}").over(order), F.lit(0.0)) for k in range(len(profiles))})
    turns = {f"c{k}": F.coalesce(F.abs(F.col(f"h{k}") - F.lag(f"h{k}").over(order)), F.lit(0.0)) * c.cost for k in range(len(profiles))}
    active = lambda k: F.abs(F.coalesce(f"p{k}", F.lit(0.0))) > 1e-12
    starts = {f"t{k}": (active(k) & ~F.coalesce(F.lag(active(k)).over(order) & (F.col("was_train") == F.col("train")), F.lit(False))).cast("long") for k in range(len(profiles))}
    gross = {f"g{k}": F.col(f"h{k}") * F.coalesce("ret_1", F.lit(0.0)) for k in range(len(profiles))}
    at = F.row_number().over(order)
    n_train = F.count(F.when(F.col("train"), 1)).over(Window.partitionBy(*by))
    fold = F.least(F.floor((at - 1) / F.greatest(F.floor(n_train / FOLDS), F.lit(1))), F.lit(FOLDS - 1))
    trace = held.withColumns(turns | starts | gross | {"fold": F.when(F.col("train"), fold)})

    # one row a fold of the train part and one for the test part; all further figures follow from these
    sides = [(k, d) for k in range(len(profiles)) for d in (1, -1)]
    net = lambda k, d: F.col(f"g{k}") * d - F.col(f"c{k}")
    each = F.array(*(F.struct(F.lit(k).alias("profile"), F.lit(d).alias("side"), F.avg(net(k, d)).alias("mean"), F.var_pop(net(k, d)).alias("var"), F.sum(f"t{k}").alias("triggers")) for k, d in sides))
    parts = ws.save(trace.groupBy(*by, "train", "fold").agg(F.count("*").alias("n"), each.alias("v")).select(*by, "train", "fold", "n", F.explode("v").alias("v")).select(*by, "train", "fold", "n", "v.*"))
    per = [*by, "profile", "side"]
    sharpe = lambda mean, var: F.when(var > 0, mean / F.sqrt(var) * c.bars_per_year**0.5)
    n, mean = F.col("n"), F.col("mean")
    mixed = parts.groupBy(*per, "train").agg(F.sum("n").alias("obs"), (F.sum(n * mean) / F.sum(n)).alias("m"), F.sum("triggers").alias("triggers"), F.min(sharpe(mean, F.col("var"))).alias("low"), F.stddev_pop(sharpe(mean, F.col("var"))).alias("spread"))
    # the variance of whole parts from the folds' variances and the distances of their means, which loses no digits
    around = parts.join(mixed.select(*per, "train", "m"), [*per, "train"]).groupBy(*per, "train").agg((F.sum(n * (F.col("var") + (mean - F.col("m")) ** 2)) / F.sum(n)).alias("var"))
    mixed = mixed.join(around, [*per, "train"])
    enough = F.col("obs") >= max(120, 20 * FOLDS)
    figure = sharpe(F.col("m"), F.col("var"))
    named = F.when(F.col("side") < 0, F.concat("signal", F.lit("__inv"))).otherwise(F.col("signal")).alias("signal")
    shown = [*keys, named, "profile", "obs", figure.alias("sharpe"), "triggers"]
    train = mixed.where("train").select(*shown, F.when(enough, F.col("low")).alias("wf_min"), F.when(enough, figure + 0.45 * F.col("low") - 0.25 * F.col("spread")).alias("robust_score"))
    return train, mixed.where("not train").select(*shown)


def swept_best(report: DataFrame, keys: list[str]) -> DataFrame:
    """The best profile of each signal and bar size by the sweep's score, with that score."""
    scored = report.withColumn("composite", F.round(sweep_score(), 9))
    order = Window.partitionBy(*keys, *KEY).orderBy(*(F.col(c).desc_nulls_last() for c in ("composite", "test_sharpe", "robust_score")), "profile")
    return scored.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")


@dataclass(frozen=True)
class CatalogRow:
    """A signal to execute; ``name__inv`` is the signal ``name`` negated."""

    signal: str
    bar_minutes: int
    z_window: int
    deadband: float = 0.35
    smooth_span: int = 1
    mode: str = "tanh"


def execute_catalog(df: DataFrame, catalog: list[CatalogRow], formulas: dict[str, str], keys: list[str], price: str, volume: str, order: list[str], fast_ms: int, config: S.BacktestConfig = S.BacktestConfig()) -> DataFrame:
    """``keys, time_ms, signal, position``: each row of the catalog computed on its own bars, held on the fast ones.

    All signals of one bar size share a resampling and a compilation; those of one profile
    share a pass.  A position counts from the bar after the one it was computed on, and is
    zero before the first.
    """
    fast = B.resample_ohlcv(df, fast_ms, keys, price, volume, order).select(*keys, "time_ms")
    out = None
    for minutes in sorted({r.bar_minutes for r in catalog}):
        rows = [r for r in catalog if r.bar_minutes == minutes]
        base = {r.signal: r.signal.removesuffix("__inv") for r in rows}
        wide = B.resample_ohlcv(df, minutes * 60_000, keys, price, volume, order)
        wide = apply_formulas(wide, FEATURES | {b: formulas[b] for b in base.values()}, keys)
        for profile in sorted({(r.z_window, r.deadband, r.smooth_span, r.mode) for r in rows}):
            own = [r.signal for r in rows if (r.z_window, r.deadband, r.smooth_span, r.mode) == profile]
            signed = wide.select(*keys, "time_ms", *((-F.col(base[s]) if s != base[s] else F.col(base[s])).alias(s) for s in own))
            long = signed.unpivot([*keys, "time_ms"], own, "signal", "raw")
            held = positions(long, [*keys, "signal"], *profile, config)
            lagged = F.coalesce(F.lag("position").over(Window.partitionBy(*keys, "signal").orderBy("time_ms")), F.lit(0.0))
            held = held.select(*keys, "time_ms", F.concat_ws("|", "signal", F.lit(f"{minutes}min")).alias("signal"), lagged.alias("position"))
            names = F.explode(F.array(*(F.lit(f"{s}|{minutes}min") for s in own)))
            part = S.asof_backward(held, fast.withColumn("signal", names), [*keys, "signal"], "position")
            out = part if out is None else out.union(part)
    return out


def positions(df: DataFrame, keys: list[str], z_window: int, deadband: float, span: int, mode: str, config: S.BacktestConfig) -> DataFrame:
    """``df`` with the position of its ``raw`` signal: z-score, band, squashing, smoothing, ladder."""
    c = replace(config, deadband=deadband)
    df = S.robust_zscore(df, "raw", "z", keys, z_window)
    if span <= 1:
        return df.withColumn("position", S.position(F.col("z"), c, mode))
    return S.smooth_position(df.withColumn("position", S.squash(F.col("z"), c, mode)), "position", keys, span, c)

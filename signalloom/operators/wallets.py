"""Wallet positions: standard columns, minute states, behaviour and archetypes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.whole import PARTS, with_series, cumulative, interpolated
from ..workspace import Workspace
from .events import action_label, pick_col, side_sign, weighted_mean

# Patterns of the source columns, the first that matches counts.
POSITION_COLUMNS = {
    "event_time": ["update_time", "create_time", "ingested_at", "timestamp", "time", "ts"],
    "action": ["position_action", "action", "dir"],
    "user": ["^user$", "wallet", "address", "account", "trader"],
    "symbol": ["^symbol$", "coin", "asset", "pair", "token"],
    "position_size": ["^position_size$", "size", "amount", "qty"],
    "position_value_usd": ["position_value_usd", "notional", "value", "usd"],
    "entry_price": ["entry_price"],
    "mark_price": ["mark_price", "mark", "price"],
    "liq_price": ["liq_price", "liquidation"],
    "leverage": ["leverage"],
    "unrealized_pnl": ["unrealized_pnl", "pnl", "profit"],
}
# What each archetype adds and subtracts of the ranks; a constant, then signs.
ARCHETYPES = {
    "high_conviction": (0, {"avg_abs_exposure": 1, "holding_time_hours": 1, "stability": 1, "turnover_usd": -1}),
    "fast_speculator": (0, {"turnover_usd": 1, "avg_leverage": 1, "abs_net_exposure_ratio": 1, "holding_time_hours": -1}),
    "hedger_like": (0, {"cross_symbol_offset": 1, "stability": 1, "abs_net_exposure_ratio": -1}),
    "fragile": (1, {"median_liq_distance_pct": -1, "avg_leverage": 1, "pnl_volatility": 1}),
    "pnl_swing": (0, {"pnl_volatility": 1, "turnover_usd": 1}),
}
RANKED = sorted({f for _, parts in ARCHETYPES.values() for f in parts})


def standardize_positions(df: DataFrame, tie: str) -> DataFrame:
    """Canonical columns, one row a user, symbol and time: the last by ``tie``.

    A missing value is size times mark price; a close turns the side.
    """
    found = {name: pick_col(df.columns, patterns) for name, patterns in POSITION_COLUMNS.items()}
    number = lambda n: F.col(found[n]).try_cast("double") if found[n] else F.lit(None).cast("double")
    text = lambda n: F.col(found[n]).cast("string") if found[n] else F.lit(None).cast("string")
    amounts = ("position_size", "entry_price", "mark_price", "liq_price", "leverage", "unrealized_pnl")
    out = df.select(
        F.col(found["event_time"]).alias("event_time"), F.coalesce(text("user"), F.lit("unknown_user")).alias("user"), F.upper(text("symbol")).alias("symbol"),
        *(number(n).alias(n) for n in amounts), number("position_value_usd").alias("__value"), action_label(F.coalesce(text("action"), F.lit(""))).alias("__label"), F.col(tie).alias("__tie"),
    )
    out = out.withColumn("position_value_usd", F.coalesce("__value", F.abs("position_size") * F.abs("mark_price")))
    out = out.withColumns({"side_sign": side_sign(F.col("position_size"), F.col("__label")), "abs_position_usd": F.abs("position_value_usd")})
    out = out.withColumns({
        "signed_position_usd": F.coalesce("abs_position_usd", F.lit(0.0)) * F.col("side_sign"),
        "liq_distance_pct": F.abs(F.try_divide(F.col("liq_price") - F.col("mark_price"), F.col("mark_price"))),
        "pnl_pct": F.try_divide("unrealized_pnl", "abs_position_usd"),
    })
    at = Window.partitionBy("user", "symbol", "event_time").orderBy(F.desc("__tie"))
    last = out.where("event_time is not null and symbol is not null").withColumn("__r", F.row_number().over(at)).where("__r = 1")
    return last.drop("__r", "__tie", "__value", "__label")


def with_trades(positions: DataFrame, least: float, minute_ms: int = 60_000) -> DataFrame:
    """Positions with their minute, the change since the one before and whether that is a trade."""
    before = F.lag("signed_position_usd").over(Window.partitionBy("user", "symbol").orderBy("event_time"))
    moved = F.coalesce(F.abs(F.col("signed_position_usd") - before), F.lit(0.0))
    return positions.withColumns({"minute": F.floor(F.col("event_time") / minute_ms) * minute_ms, "moved": moved}).withColumn("trade", F.col("moved") >= least)


def wallet_minutes(traded: DataFrame) -> DataFrame:
    """The state of each wallet in each minute from the last row of every symbol."""
    newest = Window.partitionBy("minute", "user", "symbol").orderBy(F.desc("event_time"))
    own = traded.withColumn("__r", F.row_number().over(newest))
    last, signed, size = F.col("__r") == 1, F.col("signed_position_usd"), F.col("abs_position_usd")
    only = lambda x: F.when(last, x)
    largest = only(F.struct(size.alias("a"), F.col("event_time").alias("t"), F.col("symbol").alias("s")))
    out = own.groupBy("minute", "user").agg(
        F.sum(only(signed)).alias("signed_exposure"), F.sum(only(size)).alias("abs_exposure"), F.sum(only(F.col("unrealized_pnl"))).alias("unrealized_pnl"),
        F.sum(only(F.coalesce("leverage", F.lit(0.0)) * F.coalesce(size, F.lit(0.0)))).alias("__weighted"), F.coalesce(F.bool_or(only(signed > 0)), F.lit(False)).alias("__long"),
        F.coalesce(F.bool_or(only(signed < 0)), F.lit(False)).alias("__short"), F.max_by("symbol", largest).alias("dominant_symbol"), F.max_by("mark_price", largest).alias("dominant_mark_price"),
        F.coalesce(F.bool_or("trade"), F.lit(False)).alias("trade"),
    )
    ratio = F.try_divide("signed_exposure", "abs_exposure")
    return out.select(
        "minute", "user", "signed_exposure", "abs_exposure", "unrealized_pnl", "dominant_symbol", "dominant_mark_price", "trade", F.try_divide("__weighted", "abs_exposure").alias("avg_leverage"),
        (F.col("__long") & F.col("__short")).alias("offset"), F.when(ratio > 1, 1.0).when(ratio < -1, -1.0).otherwise(ratio).alias("net_exposure_ratio"),
    )


def market_minutes(positions: DataFrame, by: tuple[str, ...] = (), minute_ms: int = 60_000) -> DataFrame:
    """Totals of all wallets' positions in each minute (and of each ``by``): rows, sizes, values, result and leverage weighted by value."""
    size, value = F.col("position_size"), F.col("abs_position_usd")
    weighted = F.sum(F.coalesce("leverage", F.lit(0.0)) * F.coalesce(value, F.lit(0.0)))
    return positions.groupBy((F.floor(F.col("event_time") / minute_ms) * minute_ms).alias("minute"), *by).agg(
        F.count("*").alias("pos_rows"), F.countDistinct("user").alias("active_wallets"), F.sum(F.abs(size)).alias("size_abs"), F.sum(size).alias("size_signed"), F.sum(value).alias("notional_abs"),
        F.sum(F.signum(F.coalesce(size, F.lit(0.0))) * F.coalesce(value, F.lit(0.0))).alias("notional_signed"), F.sum("unrealized_pnl").alias("pnl_sum"), F.try_divide(weighted, F.sum(value)).alias("leverage_wavg"),
    )


def wallet_features(traded: DataFrame, minutes: DataFrame) -> DataFrame:
    """Twelve figures of each wallet that was ever active."""
    active = minutes.where("abs_exposure > 0")
    often = Window.partitionBy("user").orderBy(F.desc("n"), "dominant_symbol")
    symbols = active.groupBy("user", "dominant_symbol").agg(F.count("*").alias("n")).withColumn("__r", F.row_number().over(often)).where("__r = 1").select("user", "dominant_symbol")
    by_minute = active.groupBy("user").agg(
        F.avg("abs_exposure").alias("avg_abs_exposure"), weighted_mean(F.col("avg_leverage"), F.col("abs_exposure")).alias("avg_leverage"), F.stddev_samp(F.try_divide("unrealized_pnl", "abs_exposure")).alias("pnl_volatility"),
        F.avg("net_exposure_ratio").alias("net_exposure_ratio"), F.avg(F.col("offset").cast("double")).alias("cross_symbol_offset"), F.count("*").alias("active_minutes"),
    )
    by_row = traded.groupBy("user").agg(
        F.coalesce(F.sum(F.when(F.col("trade"), F.col("moved"))), F.lit(0.0)).alias("turnover_usd"), F.percentile(F.when(F.col("abs_position_usd") > 0, F.col("liq_distance_pct")), 0.5).alias("median_liq_distance_pct"),
        F.countDistinct(F.when(F.col("trade"), F.col("minute"))).alias("trade_minutes"),
    )
    out = by_minute.join(by_row, "user").join(symbols, "user").join(_holding_times(traded), "user", "left")
    stable = 1 - F.col("trade_minutes") / F.col("active_minutes")
    return out.withColumns({"stability": F.when(F.col("trade_minutes") > 0, F.greatest(stable, F.lit(0.0))), "abs_net_exposure_ratio": F.abs("net_exposure_ratio")})


def _holding_times(traded: DataFrame) -> DataFrame:
    """Median hours between the trades of a symbol, else its minutes as hours, weighted by exposure."""
    by = ["user", "symbol"]
    gaps = traded.where("trade").withColumn("__gap", F.col("event_time") - F.lag("event_time").over(Window.partitionBy(*by).orderBy("event_time")))
    between = gaps.groupBy(*by).agg((F.percentile("__gap", 0.5) / 3_600_000).alias("__between"))
    whole = traded.groupBy(*by).agg(F.avg("abs_position_usd").alias("weight"), (F.countDistinct("minute") / 60).alias("__minutes")).where("weight > 0")
    held = whole.join(between, by, "left").withColumn("hours", F.coalesce("__between", "__minutes"))
    return held.groupBy("user").agg(weighted_mean(F.col("hours"), F.col("weight")).alias("holding_time_hours"))


def global_ranks(long: DataFrame, by: str, value: str, parts: int = PARTS) -> DataFrame:
    """``by, value, n, upto, size``: how often each value occurs, and how many rows of its group have it or a smaller one."""
    return cumulative(Workspace(long.sparkSession, "ranks"), long, [by], value, parts)


def score_archetypes(features: DataFrame, user: str = "user", parts: int = PARTS) -> DataFrame:
    """Average-tie percentile ranks (missing values take the median), five scores, the first best label and its margin.

    All features are ranked in one pass over a long table; it and the features are written once.
    """
    ws = Workspace(features.sparkSession, "archetypes")
    features = ws.save(features)
    long = features.select(user, *(F.col(f).cast("double") for f in RANKED)).unpivot([user], RANKED, "feature", "value")
    known = cumulative(ws, long, ["feature"], "value", parts)
    median = known.groupBy("feature").agg(interpolated(0.5, "value").alias("median"))
    filled = ws.save(with_series(long, median, ["feature"]).select(user, "feature", F.coalesce("value", "median").alias("value")))
    ranks = cumulative(ws, filled, ["feature"], "value", parts)
    share = ranks.select("feature", "value", ((F.col("upto") - (F.col("n") - 1) / 2) / F.col("size")).alias("rank"))
    wide = with_series(filled, share, ["feature", "value"]).groupBy(user).agg(*(F.max(F.when(F.col("feature") == f, F.col("rank"))).alias(f"{f}_rank") for f in RANKED))
    score: dict[str, Column] = {}
    for name, (constant, parts) in ARCHETYPES.items():
        score[f"{name}_score"] = F.round(reduce(lambda a, b: a + b, (F.col(f"{f}_rank") * sign for f, sign in parts.items()), F.lit(float(constant))), 9)
    out = features.join(wide, user).withColumns(score)
    order = F.array_sort(F.array(*(F.struct((-F.col(f"{a}_score")).alias("s"), F.lit(i).alias("i"), F.lit(a).alias("a")) for i, a in enumerate(ARCHETYPES))))
    return out.withColumn("__o", order).withColumns({"dominant_archetype": F.col("__o")[0]["a"], "archetype_margin": F.col("__o")[1]["s"] - F.col("__o")[0]["s"]}).drop("__o")


def selected_wallets(scored: DataFrame, wanted: str | list[str], user: str = "user") -> DataFrame:
    """Wallets of the wanted archetypes, or all."""
    if wanted == "all":
        return scored.select(user)
    names = [wanted] if isinstance(wanted, str) else wanted
    if unknown := [n for n in names if n not in ARCHETYPES]:
        raise ValueError(f"unknown archetypes: {unknown}")
    return scored.where(F.col("dominant_archetype").isin(names)).select(user)

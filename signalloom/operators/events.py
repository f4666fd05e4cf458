"""Event features: standardisation, minute aggregates, wallets and archetypes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pick_col(columns: list[str], patterns: list[str]) -> str | None:
    """First column that matches the first pattern that any column matches."""
    return next((c for p in patterns for c in columns if re.search(p, c, re.I)), None)


def action_label(text: Column) -> Column:
    """open, close, long, short or unknown; close wins over open."""
    t = F.lower(text)
    return F.when(t.rlike("close|exit|reduce|refund|logout"), "close").when(t.rlike("open|enter|add|purchase|login"), "open").when(t.rlike("long|buy"), "long").when(t.rlike("short|sell"), "short").otherwise("unknown")


def side_sign(sign: Column, label: Column) -> Column:
    """Direction of an event: its own sign, else its label; a close turns it."""
    base = F.when(sign != 0, F.signum(sign)).when(label == "short", -1.0).otherwise(1.0)
    return F.when(label == "close", -base).otherwise(base)


def standardize_alerts(df: DataFrame, action: str, notional: str, time: str, size: str | None = None) -> DataFrame:
    """``df`` with the label of its action, side, notional and minute of each alert; rows without a time go.

    The side is that of ``size`` where it has one, else of the label.
    """
    df = df.where(F.col(time).isNotNull()).withColumn("label", action_label(F.coalesce(F.col(action).cast("string"), F.lit(""))))
    sign = F.coalesce(F.col(size).try_cast("double"), F.lit(0.0)) if size else F.lit(0.0)
    return df.withColumns({"side": side_sign(sign, F.col("label")), "notional": F.col(notional).try_cast("double"), "minute_ms": F.floor(F.col(time) / 60_000) * 60_000})


def minute_alerts(df: DataFrame, keys: list[str], minute: str = "minute_ms") -> DataFrame:
    """Exact counts and sums a minute over globally distinct events."""
    size = F.abs("notional")
    return df.groupBy(*keys, minute).agg(
        F.count("*").alias("alert_n"), F.countDistinct("user_id").alias("alert_users"), F.sum(F.when(F.col("label") == "open", 1).otherwise(0)).alias("open_n"),
        F.sum(F.when(F.col("label") == "close", 1).otherwise(0)).alias("close_n"), F.sum(size).alias("alert_notional"), F.sum(F.col("side") * size).alias("alert_signed"),
    )


def top_actions(df: DataFrame, keys: list[str], label: str, k: int = 2) -> DataFrame:
    """The most frequent labels a key; ties go to the smaller label."""
    n = df.groupBy(*keys, label).agg(F.count("*").alias("n"))
    at = Window.partitionBy(*keys).orderBy(F.col("n").desc(), label)
    ranked = n.withColumn("r", F.row_number().over(at)).where(F.col("r") <= k)
    pairs = [f(F.when(F.col("r") == i, F.col(c))).alias(f"top_{label}_{i}{s}") for i in range(1, k + 1) for f, c, s in ((F.max, label, ""), (F.max, "n", "_n"))]
    return ranked.groupBy(*keys).agg(*pairs)


def last_snapshots(df: DataFrame, keys: list[str], time: str, tie: str) -> DataFrame:
    """The newest row a key."""
    at = Window.partitionBy(*keys).orderBy(F.col(time).desc(), F.col(tie).desc())
    return df.withColumn("__r", F.row_number().over(at)).where("__r = 1").drop("__r")


def weighted_mean(x: Column, w: Column) -> Column:
    ok = x.isNotNull() & (w > 0)
    total = F.sum(F.when(ok, w))
    return F.when(total > 0, F.sum(F.when(ok, x * w)) / total)


def turnover(df: DataFrame, keys: list[str], value: str, time: str, tie: str, least: float) -> DataFrame:
    """Sum of position changes of at least ``least``."""
    step = F.abs(F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(time, tie)))
    return df.withColumn("__d", step).groupBy(*keys).agg(F.sum(F.when(F.col("__d") >= least, F.col("__d")).otherwise(0.0)).alias("turnover"), F.count(F.when(F.col("__d") >= least, 1)).alias("moves"))


def pool(wallets: DataFrame, name: str, scores: list[str], k: int, snapshots: str | None = None, least: int = 0, otherwise: int = 250) -> DataFrame:
    """Union of the top ``k`` by each score, of those with at least ``least`` snapshots.

    Where none of them has that many, the ``otherwise`` wallets with the most snapshots
    that do.
    """
    out = None
    for s in scores:
        top = wallets.orderBy(F.col(s).desc_nulls_last(), name).limit(k).select(name)
        out = top if out is None else out.union(top)
    out = out.distinct()
    if snapshots is None:
        return out
    fit = wallets.where(F.col(snapshots) >= least).select(name, snapshots)
    first = fit.join(F.broadcast(out), name, "left_semi").select(name)  # at most k a score
    some = first.agg((F.count("*") > 0).alias("__some"))  # one row
    most = fit.orderBy(F.col(snapshots).desc(), name).limit(otherwise).select(name)
    return first.union(most.crossJoin(F.broadcast(some)).where("not __some").select(name))

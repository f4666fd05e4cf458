"""Signal libraries: families of formulas built from rules over their parameters.

A library is ``{group: {name: formula}}``; ``flatten`` names a signal
``sig_{group}__{name}``.
"""

from __future__ import annotations

FEATURES = {
    "ret_1": "ts_returns(close, 1)",
    "ret_5": "ts_returns(close, 5)",
    "ret_20": "ts_returns(close, 20)",
    "vol_20": "ts_std(ret_1, 20)",
    "range_pct": "safe_div(high - low, close)",
    "vwap_gap": "safe_div(close - ts_mean(close, 20), ts_mean(close, 20))",
}


def library() -> dict[str, dict[str, str]]:
    """Six families over windows; one rule each."""
    windows = (6, 12, 24, 48)
    return {
        "trend": {f"ma_gap_{a}_{b}": f"safe_div(ts_mean(close, {a}) - ts_mean(close, {b}), ts_std(close, {b}))" for a in windows for b in windows if a < b},
        "momentum": {f"ret_z_{n}": f"ts_zscore(ts_returns(close, {n}), {4 * n})" for n in windows},
        "revert": {f"z_{n}": f"-ts_zscore(close, {n})" for n in windows},
        "vol": {f"vol_ratio_{n}": f"safe_div(ts_std(ret_1, {n}), ts_std(ret_1, {4 * n})) - 1" for n in windows},
        "breakout": {f"channel_{n}": f"safe_div(close - ts_min(low, {n}), ts_max(high, {n}) - ts_min(low, {n})) - 0.5" for n in windows},
        "volume": {f"volume_z_{n}": f"ts_zscore(volume, {n}) * ts_rank(ret_1, {n})" for n in windows},
    }


# Features of the core library, later ones see earlier ones.  ``rsi``, ``ma``,
# ``ema``, ``macd_hist`` and the bands are columns of the bars (see ``INDICATOR_COLUMNS``).
CORE_FEATURES = {f"ret_{n}": f"ts_returns(close, {n})" for n in (1, 5, 15, 30, 60, 120, 240, 720, 1440, 2880)} | {
    "ret_120ex15": "ret_120 - ret_15",
    "range_pct": "safe_div(high - low, close)",
    "clv": "safe_div(close - low, high - low + 1e-12)",
    "vol_log": "log(volume + 1)",
    "vol_z_60": "ts_zscore(volume, 60)",
    "vol_z_240": "ts_zscore(volume, 240)",
    "vol_chg": "ts_returns(volume, 1)",
    "ret_vol_60_1440": "safe_div(ts_std(ret_1, 60), ts_std(ret_1, 1440) + 1e-12)",
    "rsi_z": "ts_zscore(rsi, 60)",
    "rsi_chg": "rsi - last(rsi)",
    "candle_box": "safe_div(close - open, last(close))",
    "ma_above": "ifcond(close > ma, 1, -1)",
    "ema_above": "ifcond(close > ema, 1, -1)",
    "ma_slope_30": "ma - ts_delay(ma, 30)",
    "ma_curv_15": "ma - 2 * ts_delay(ma, 15) + ts_delay(ma, 30)",
    "boll_pos": "safe_div(close - boll_lb, boll_ub - boll_lb)",
    "band_width": "safe_div(boll_ub - boll_lb, boll_mb)",
    "tr": "safe_div(ts_max(high, 2) - ts_min(low, 2), close)",
    "atr_20": "ts_mean(tr, 20)",
}
# Rules of the core library as group, name, formula and the parameters it is
# built for (``a`` and ``b``, or ``a`` alone).
_PAIRS = [(8, 48), (16, 96), (30, 180), (60, 360), (120, 720), (240, 1440)]
_STEPS = [(15, 120), (30, 240), (60, 360), (120, 720), (240, 1440)]
CORE_RULES = [
    ("trend", "ema_spread_{a}_{b}", "safe_div(ts_ema(close, {a}) - ts_ema(close, {b}), ts_std(close, {b}))", _PAIRS),
    ("trend", "ma_spread_{a}_{b}", "safe_div(ts_mean(close, {a}) - ts_mean(close, {b}), ts_std(close, {b}))", _PAIRS),
    ("trend", "price_ma_dist_{a}", "safe_div(close - ts_mean(close, {a}), ts_std(close, {a}))", [120, 240, 360, 720, 1440]),
    ("momentum", "mom_diff_{a}_{b}", "ts_returns(close, {a}) - ts_returns(close, {b})", [(5, 60), *_STEPS, (720, 2880)]),
    ("momentum", "mom_ratio_{a}_{b}", "safe_div(ts_returns(close, {a}), ts_std(ret_1, {b}) + 1e-12)", [(5, 60), *_STEPS, (720, 2880)]),
    ("momentum", "mom_beta_{a}_{b}", "ts_beta(ts_returns(close, {a}), ts_returns(close, {b}), {b})", _STEPS),
    ("momentum", "mom_sign_{a}", "ifcond(ts_returns(close, {a}) > 0, 1, -1)", [60, 120, 240, 720, 1440]),
    ("momentum", "macd_hist_z_{a}", "ts_zscore(macd_hist, {a})", [48, 96, 168, 240, 480]),
    ("momentum", "rsi_trend_z_{a}", "ts_zscore(rsi - 50, {a})", [48, 96, 168, 240, 480]),
    ("mean_revert", "rev_ret_{a}", "-ts_zscore(ts_returns(close, 1), {a})", [5, 15, 30, 60]),
    ("mean_revert", "rsi_revert_{a}", "-ts_zscore(rsi, {a})", [48, 96, 168, 240]),
    ("mean_revert", "boll_revert_{a}", "-ts_zscore(boll_pos - 0.5, {a})", [48, 96, 168, 240]),
    ("mean_revert", "clv_revert_{a}", "-ts_zscore(clv - 0.5, {a})", [48, 96, 168, 240]),
    ("volatility", "vol_break_{a}", "ts_zscore(ts_std(ret_1, {a}), 3 * {a})", [24, 48, 96, 168, 240]),
    ("volatility", "vol_compress_{a}", "-ts_zscore(band_width, 3 * {a})", [24, 48, 96, 168, 240]),
    ("volatility", "rv_ratio_z_{a}", "ts_zscore(ret_vol_60_1440, 4 * {a})", [24, 48, 96, 168, 240]),
    ("volatility", "tail_risk_{a}", "ts_kurt(ret_1, {a})", [96, 168, 240, 360]),
    ("volatility", "skew_reversal_{a}", "-ts_skew(ret_1, {a})", [96, 168, 240, 360]),
    ("breakout", "donchian_up_{a}", "safe_div(close - ts_max(high, {a}), ts_mean(atr_20, {a}) + 1e-12)", [20, 40, 60, 120, 240, 480, 960, 1440]),
    ("breakout", "donchian_dn_{a}", "safe_div(close - ts_min(low, {a}), ts_mean(atr_20, {a}) + 1e-12)", [20, 40, 60, 120, 240, 480, 960, 1440]),
    ("breakout", "quantile_hi_{a}", "safe_div(close - ts_quantile(close, {a}, 0.8), ts_std(close, {a}) + 1e-12)", [20, 40, 60, 120, 240, 480, 960, 1440]),
    ("volume", "vol_pressure_{a}", "ts_zscore(ts_corr(ret_1, vol_log, {a}), {a})", [30, 60, 120, 240]),
    ("volume", "vol_z_mom_{a}", "ts_zscore(vol_z_60, {a})", [30, 60, 120, 240]),
    ("volume", "vol_spike_{a}", "vol_z_{a}", [60]),
    ("volume", "range_vol_interact", "ts_zscore(range_pct * vol_z_60, {a})", [120]),
    ("adaptive", "trend_low_vol_gate", "ifcond(ts_std(ret_1, 96) < ts_std(ret_1, 480), safe_div(ts_ema(close, {a}) - ts_ema(close, {b}), ts_std(close, {b})), 0)", [(120, 720)]),
    ("adaptive", "mom_vol_target", "safe_div(ts_returns(close, {a}), ts_std(ret_1, {b}) + 1e-12)", [(360, 240)]),
]
INDICATOR_COLUMNS = {"rsi": "rsi_14", "macd_hist": "macd_hist", "boll_mb": "bb_mid", "boll_ub": "bb_upper", "boll_lb": "bb_lower"}


def from_rules(rules: list[tuple[str, str, str, list]], shrink: int = 1) -> dict[str, dict[str, str]]:
    """``{group: {name: formula}}``, one formula for each parameter of each rule.

    ``shrink`` divides all parameters (five at least stay), for bars that are few; names
    keep the parameters of the rule.
    """
    small = lambda n: max(5, n // shrink) if shrink > 1 else n
    out: dict[str, dict[str, str]] = {}
    for group, name, formula, parameters in rules:
        for p in parameters:
            a, b = p if isinstance(p, tuple) else (p, p)
            out.setdefault(group, {})[name.format(a=a, b=b)] = formula.format(a=small(a) if "vol_spike" not in name else a, b=small(b))
    return out


def core_library() -> dict[str, dict[str, str]]:
    """126 signals in seven groups; windows in bars, up to 2,880."""
    return from_rules(CORE_RULES)


def flatten(groups: dict[str, dict[str, str]]) -> dict[str, str]:
    return {f"sig_{g}__{n}": f for g, names in groups.items() for n, f in names.items()}


def with_inverse(formulas: dict[str, str]) -> dict[str, str]:
    return formulas | {f"{n}__inv": f"-({f})" for n, f in formulas.items()}


def per_column(columns: list[str], window: int = 24) -> dict[str, str]:
    """Four signals for each event feature column."""
    shapes = {"z": "ts_zscore({c}, {n})", "delta": "ts_delta({c}, 1)", "rank": "ts_rank({c}, {n})", "surprise": "safe_div({c}, ts_mean({c}, {n})) - 1"}
    return {f"sig_event__{c}_{k}": s.format(c=c, n=window) for c in columns for k, s in shapes.items()}


def ladder(count: int, low: int, high: int) -> list[int]:
    """``count`` windows in equal ratios from ``low`` to ``high``, whole and distinct."""
    out: list[int] = []
    for k in range(count):
        w = round(low * (high / low) ** (k / max(count - 1, 1)))
        out.append(max(w, out[-1] + 1) if out else w)
    return out


def candidate_library() -> dict[str, dict[str, str]]:
    """123 candidates in six groups, each a few shapes over a ladder of windows.

    The adaptive group lets a shape through only in a regime: a quiet market, a trending
    one, or one without a stretched price.
    """
    pairs = [(w, 6 * w) for w in ladder(7, 8, 240)]
    horizons = [(w, 4 * w) for w in ladder(7, 5, 480)]
    gaps = {"ema": "ts_ema(close, {a}) - ts_ema(close, {b})", "mean": "ts_mean(close, {a}) - ts_mean(close, {b})", "price": "close - ts_mean(close, {b})"}
    reverts = {"oscillator": "rsi", "level": "close", "band": "boll_pos", "body": "candle_box"}
    shapes = {
        "spread": "ts_zscore(ts_std(ret_1, {a}), 3 * {a})", "squeeze": "-ts_zscore(band_width, 3 * {a})",
        "tails": "ts_kurt(ret_1, {a})", "lean": "-ts_skew(ret_1, {a})",
    }
    edges = {"top": "close - ts_max(high, {a})", "floor": "close - ts_min(low, {a})", "upper": "close - ts_quantile(close, {a}, 0.8)"}
    scale = {"top": "ts_mean(atr_20, {a})", "floor": "ts_mean(atr_20, {a})", "upper": "ts_std(close, {a})"}
    quiet, stretched = "ts_std(ret_1, {a}) < ts_std(ret_1, {b})", "ts_rank(close, {a}) > 0.9"
    gates = [
        ("quiet_ema", quiet, "safe_div(ts_ema(close, {a}) - ts_ema(close, {b}), ts_std(close, {b}))", 96, 480),
        ("quiet_mean", quiet, "safe_div(ts_mean(close, {a}) - ts_mean(close, {b}), ts_std(close, {b}))", 48, 240),
        ("quiet_floor", quiet, "safe_div(close - ts_min(low, {b}), ts_mean(atr_20, {b}))", 96, 480),
        ("trending_return", "abs(ts_zscore(ts_returns(close, {a}), {b})) > 1", "safe_div(ts_returns(close, {a}), ts_std(ret_1, {b}))", 60, 240),
        ("stretched_return", stretched, "-ts_zscore(ts_returns(close, 1), {b})", 120, 240),
    ]
    return {
        "trend": {f"{n}_gap_{a}_{b}": f"safe_div({g.format(a=a, b=b)}, ts_std(close, {b}))" for n, g in gaps.items() for a, b in pairs},
        "momentum": {f"return_gap_{a}_{b}": f"ts_returns(close, {a}) - ts_returns(close, {b})" for a, b in horizons}
        | {f"return_beta_{a}_{b}": f"ts_beta(ts_returns(close, {a}), ts_returns(close, {b}), {b})" for a, b in horizons}
        | {f"return_sign_{b}": f"ifcond(ts_returns(close, {b}) > 0, 1, -1)" for _, b in horizons}
        | {f"{n}_z_{a}": f"ts_zscore({x}, {a})" for n, x in {"impulse": "macd_hist", "strength": "rsi - 50"}.items() for a in ladder(5, 24, 240)},
        "mean_revert": {f"{n}_back_{a}": f"-ts_zscore({x}, {a})" for n, x in reverts.items() for a in ladder(4, 48, 240)},
        "volatility": {f"{n}_{a}": x.format(a=a) for n, x in shapes.items() for a in ladder(5, 24, 240)},
        "breakout": {f"{n}_break_{a}": f"safe_div({x.format(a=a)}, {scale[n].format(a=a)})" for n, x in edges.items() for a in ladder(10, 20, 1440)},
        "adaptive": {f"{n}_{a}_{b}": f"ifcond({when.format(a=a, b=b)}, {x.format(a=a, b=b)}, 0)" for n, when, x, a, b in gates},
    }


def event_library(amounts: dict[str, tuple[str, str]], counts: list[str], kinds: dict[str, str], window: int = 24) -> dict[str, dict[str, str]]:
    """Signals of event columns by their type.

    ``amounts``: name to its signed and its absolute column; ``counts``: columns of numbers;
    ``kinds``: name to a column that counts one kind of event among ``counts[0]``.  Flows are
    scored as they are, smoothed and as an imbalance; kinds as a share; counts by their
    surprise; then all are crossed with the price: along a move, against a place at the
    edge of its range, and by how much they vary.
    """
    n, slow = window, 2 * window
    z = lambda x, w=n: f"ts_zscore({x}, {w})"
    move = z(f"ts_returns(close, {n // 2})", slow)
    place = f"(ts_rank(close, {n}) - 0.5)"
    signed = {a: s for a, (s, _) in amounts.items()}
    sizes = {a: b for a, (_, b) in amounts.items()}
    return {
        "event_flow": {f"{a}_{k}": f for a in amounts for k, f in {
            "level": z(signed[a]), "slow": z(f"ts_mean({signed[a]}, {n // 2})", slow), "size": z(sizes[a]),
            "imbalance": z(f"safe_div({signed[a]}, {sizes[a]} + 1e-12)", slow), "decay": z(f"ts_decay({signed[a]}, {n // 2})"),
        }.items()},
        "event_mix": {f"{k}_share": z(f"safe_div({c}, {counts[0]} + 1)", slow) for k, c in kinds.items()},
        "event_attention": {f"{c}_surprise": z(f"safe_div({c}, ts_mean({c}, {n})) - 1", slow) for c in counts},
        "event_momentum": {"move": move, "move_over_spread": f"safe_div(ts_returns(close, {n}), ts_std(ret_1, {slow}) + 1e-12)"}
        | {f"{a}_along": f"{z(signed[a])} * {move}" for a in amounts} | {f"{a}_with": f"{z(signed[a])} + {move}" for a in amounts},
        "event_revert": {f"{c}_at_edge": f"-{z(c)} * {place}" for c in [*counts, *sizes.values()]},
        "event_spread": {f"{c}_varies": z(f"ts_std({c}, {n // 2})", slow) for c in [*signed.values(), *sizes.values()]}
        | {"busy_share": z(f"ts_mean(ifcond({counts[0]} > 0, 1.0, 0.0), {n})", slow)},
    }

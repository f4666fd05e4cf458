"""Formulas to Columns.

A formula is Python expression syntax over columns, numbers and the registered
functions; it is parsed and checked node by node and never evaluated.  Equal
subexpressions are computed once.  Window functions become hidden columns, one
``withColumns``, one rolling and one smoothing pass a nesting level, so that plans grow
with the number of levels.
Later formulas see earlier ones.
"""

from __future__ import annotations

import ast
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .carried import Carry, carried, lagged
from .rolling import PAIRED, Rolling, overlapped, roll
from .smoothing import Smoothing, smooth
from .timeseries import FUNCTIONS, PLAIN, Series, safe_div
from .whole import Whole, over_series

OPERATORS = {
    ast.Add: lambda a, b: a + b,
    ast.Sub: lambda a, b: a - b,
    ast.Mult: lambda a, b: a * b,
    ast.Div: lambda a, b: safe_div(a, b),
    ast.Gt: lambda a, b: a > b,
    ast.Lt: lambda a, b: a < b,
    ast.GtE: lambda a, b: a >= b,
    ast.LtE: lambda a, b: a <= b,
}


PASSES = ("ts_ema", "ts_quantile", "ts_rank", "rank", "scale", "winsorize")  # computed by passes of their own, not by a window function


WIDE = 64  # frames of so many rows and more are followed row by row, since a window function reads each anew
ROLLED = ("mean", "std", "sum", "min", "max", "zscore", "skew", "kurt", *PAIRED)


class FormulaError(ValueError):
    """A formula uses something that is not part of the language."""


class _Plan:
    def __init__(self, columns: list[str], series: Series, sliced: bool):
        self.series, self.columns, self.sliced = series, set(columns), sliced
        self.carries: dict[int, dict[str, tuple[str, bool]]] = defaultdict(dict)
        self.reach: dict[int, int] = defaultdict(int)
        self.named: dict[str, tuple[object, int]] = {}
        self.seen: dict[str, tuple[object, int]] = {}
        self.inputs: dict[int, dict[str, Column]] = defaultdict(dict)
        self.windows: dict[int, dict[str, Column]] = defaultdict(dict)
        self.smooth: dict[int, list[Smoothing]] = defaultdict(list)
        self.rolls: dict[int, list[Rolling]] = defaultdict(list)
        self.wholes: dict[int, list[Whole]] = defaultdict(list)
        self.count = 0

    def hidden(self) -> str:
        self.count += 1
        return f"__f{self.count}"

    def visit(self, node: ast.AST) -> tuple[object, int]:
        key = ast.dump(node)
        if key not in self.seen or isinstance(node, ast.Name):
            self.seen[key] = self.build(node)
        return self.seen[key]

    def build(self, node: ast.AST) -> tuple[object, int]:
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)) and not isinstance(node.value, bool):
            return node.value, 0
        if isinstance(node, ast.Name):
            if node.id in self.named:
                return self.named[node.id]
            if node.id not in self.columns:
                raise FormulaError(f"no column {node.id}")
            return F.col(node.id), 0
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
            x, level = self.visit(node.operand)
            return -x, level
        if isinstance(node, ast.BinOp) and type(node.op) in OPERATORS:
            (a, p), (b, q) = self.visit(node.left), self.visit(node.right)
            if not isinstance(a, Column) and not isinstance(b, Column) and not isinstance(node.op, ast.Div):
                return OPERATORS[type(node.op)](a, b), 0  # two numbers, as in a window of 3 * 24
            return OPERATORS[type(node.op)](a, b), max(p, q)
        if isinstance(node, ast.Compare) and len(node.ops) == 1 and type(node.ops[0]) in OPERATORS:
            (a, p), (b, q) = self.visit(node.left), self.visit(node.comparators[0])
            return OPERATORS[type(node.ops[0])](a, b), max(p, q)
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and not node.keywords:
            return self.call(node.func.id, node.args)
        raise FormulaError(f"not part of the language: {ast.unparse(node)}")

    def call(self, name: str, nodes: list[ast.AST]) -> tuple[object, int]:
        args = [self.visit(n) for n in nodes]
        level = max((p for _, p in args), default=0)
        if name in PLAIN:
            return PLAIN[name](*(a for a, _ in args)), level
        if name == "ts_returns":  # fills gaps first, as the language defines it
            filled = self.window("ts_ffill", args[:1], nodes[:1])
            n = args[1][0] if len(args) > 1 else 1
            before = self.window("ts_delay", [filled, (n, 0)], [None, None])
            return safe_div(filled[0], before[0]) - 1, before[1]
        if name not in FUNCTIONS and name not in PASSES:
            raise FormulaError(f"no function {name}")
        return self.window(name, args, nodes)

    def window(self, name: str, args: list[tuple[object, int]], nodes: list[ast.AST | None]) -> tuple[object, int]:
        level = 1 + max(p for _, p in args)
        ready = []
        for (a, _), node in zip(args, nodes):
            if isinstance(a, Column) and node is not None and not (isinstance(node, ast.Name) and node.id not in self.named):
                own = self.hidden()
                self.inputs[level][own] = a
                a = F.col(own)
            ready.append(a)
        out = self.hidden()
        if name in PASSES:
            own = self.hidden()
            self.inputs[level][own] = ready[0]
            if name == "ts_ema":
                self.smooth[level].append(Smoothing(own, out, 2 / (ready[1] + 1), ready[1]))
            elif name.startswith("ts_"):
                self.rolls[level].append(Rolling(own, out, name.removeprefix("ts_"), *ready[1:]))
            else:
                self.wholes[level].append(Whole(own, out, name, tuple(ready[1:])))
        elif name.removeprefix("ts_") in ROLLED and name.startswith("ts_") and isinstance(ready[-1], int) and ready[-1] >= WIDE:
            own = [self.hidden() for _ in ready[:-1]]
            self.inputs[level] |= dict(zip(own, ready[:-1]))
            self.rolls[level].append(Rolling(own[0], out, name.removeprefix("ts_"), ready[-1], other=own[1] if len(own) > 1 else None))
        elif self.sliced and name in ("ts_ffill", "last"):
            own = self.hidden()
            self.inputs[level][own] = ready[0]
            self.carries[level][out] = own, name == "last"
        else:
            self.windows[level][out] = FUNCTIONS[name](self.series, *ready)
            self.reach[level] = max(self.reach[level], 1, *(r for r in ready if isinstance(r, int)))
        return F.col(out), level


def apply_formulas(df: DataFrame, formulas: dict[str, str], keys: list[str], time: str = "time_ms", width: int | None = None, chunk: int = 100_000) -> DataFrame:
    """``df`` with one column a formula; a formula may replace a column of its own name.

    With ``width`` no series is one task: states are carried over slices of time of that
    width, and bounded frames see overlapping parts of ``chunk`` rows.
    """
    plan = _Plan(df.columns, Series([*keys, "__chunk"] if width else keys, time), bool(width))
    for name, text in formulas.items():
        plan.named[name] = plan.visit(ast.parse(text, mode="eval").body)
    for level in range(1, max([0, *plan.windows, *plan.smooth, *plan.rolls, *plan.wholes, *plan.carries]) + 1):
        df = df.withColumns(plan.inputs[level]) if plan.inputs[level] else df
        if plan.carries[level]:
            df = _carry(df, plan.carries[level], keys, time, width)
        if plan.windows[level] and width:
            reach = plan.reach[level]
            parts = overlapped(df, keys, reach, max(chunk, reach), time, width).withColumns(plan.windows[level])
            df = parts.where("not __lead").drop("__lead", "__chunk")
        elif plan.windows[level]:
            df = df.withColumns(plan.windows[level])
        df = over_series(df, plan.wholes[level], keys)
        df = roll(df, plan.rolls[level], keys, time, chunk if width else None, width)
        df = smooth(df, plan.smooth[level], keys, time, width)
    whole = {n: (c if isinstance(c, Column) else F.lit(c)) for n, (c, _) in plan.named.items()}
    hidden = [c for c in df.columns if c.startswith("__f")]
    return df.withColumns(whole).drop(*hidden)


def _carry(df: DataFrame, wanted: dict[str, tuple[str, bool]], keys: list[str], time: str, width: int) -> DataFrame:
    """Newest known values, of the rows before where a figure leaves out its own row."""
    for _, (own, before) in wanted.items():
        if before:
            df = lagged(df, F.col(own), own, keys, time, width)
    return carried(df, {out: Carry("last", F.col(own)) for out, (own, _) in wanted.items()}, keys, time, width)

"""Factor functions written in Python on a (time, symbol) frame.

Only a whitelist of syntax is accepted, look-ahead is refused, and only the fields that the code names are passed to it.
It runs for each symbol, or for each date, if every one of its operations is shown to stay within one: they are
element by element, or on a grouping by that level. Other code needs several symbols and dates at once and runs on the
whole panel in one task, up to ``MOST_WHOLE_ROWS`` rows; beyond it is refused. Python workers are no security boundary:
the whitelist stops mistakes, not attackers.
"""

from __future__ import annotations

import ast
import math
import threading
import uuid
from collections.abc import Callable
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.core import DATE, SYMBOL
from .expression import ExpressionError

#: Names that code may use besides its own.
BUILTINS = {n: __builtins__[n] if isinstance(__builtins__, dict) else getattr(__builtins__, n) for n in ("abs", "all", "any", "bool", "dict", "enumerate", "float", "int", "len", "list", "max", "min", "range", "round", "set", "sorted", "sum", "tuple", "zip")}
_FORBIDDEN = (ast.Import, ast.ImportFrom, ast.Global, ast.Nonlocal, ast.AsyncFunctionDef, ast.Await, ast.Yield, ast.YieldFrom, ast.ClassDef, ast.With, ast.Try, ast.Delete, ast.Raise)
MOST_LINES = 80
#: Rows of a panel that code may run on in one task.
MOST_WHOLE_ROWS = 5_000_000
MODES = ("ohlcv", "fundamental", "hybrid", "any")


def _number(node: ast.AST, names: dict[str, float]) -> float | None:
    if isinstance(node, ast.Constant) and isinstance(node.value, int | float):
        return node.value
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
        inner = _number(node.operand, names)
        return None if inner is None else -inner
    return names.get(node.id) if isinstance(node, ast.Name) else None


def is_code(text: str) -> bool:
    """Whether a factor's text is a function and not an expression."""
    return "def " in text


def functions_of(code: str) -> list[str]:
    return [n.name for n in ast.parse(code).body if isinstance(n, ast.FunctionDef)]


def entry_of(code: str, name: str | None = None) -> str:
    """The named function, else the last one defined."""
    there = functions_of(code)
    if name and name not in there or not there:
        raise ExpressionError("EXEC", f"no function {name or ''} in the code")
    return name or there[-1]


def referenced(code: str) -> set[str]:
    """String subscripts and ``.get("...")`` arguments."""
    out = set()
    for node in ast.walk(ast.parse(code)):
        if isinstance(node, ast.Subscript) and isinstance(node.slice, ast.Constant) and isinstance(node.slice.value, str):
            out.add(node.slice.value)
        elif isinstance(node, ast.Subscript) and isinstance(node.slice, ast.List | ast.Tuple):
            out |= {e.value for e in node.slice.elts if isinstance(e, ast.Constant) and isinstance(e.value, str)}
        elif isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and node.func.attr == "get" and node.args and isinstance(node.args[0], ast.Constant) and isinstance(node.args[0].value, str):
            out.add(node.args[0].value)
    return out


def _computed_fields(tree: ast.Module) -> bool:
    """Whether a function takes a field of its first parameter, the data, by anything but literal text."""
    frames = {f.args.args[0].arg for f in tree.body if isinstance(f, ast.FunctionDef) and f.args.args}
    of_data = lambda x: isinstance(x, ast.Name) and x.id in frames
    for node in ast.walk(tree):
        if isinstance(node, ast.Subscript) and of_data(node.value):
            asked = node.slice.elts if isinstance(node.slice, ast.List | ast.Tuple) else [node.slice]
        elif isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and node.func.attr == "get" and of_data(node.func.value):
            asked = node.args[:1]
        else:
            continue
        if not all(isinstance(x, ast.Constant) and isinstance(x.value, str) for x in asked):
            return True
    return False


def analyse(code: str, allowed: set[str], *, arguments: dict | None = None, mode: str = "any", market: set[str] | None = None) -> tuple[set[str], list[tuple[str, str]]]:
    """Fields that the code reads and its violations (kind, message): EXEC, IMPORT, LINE, KEY, FUTURE."""
    found: list[tuple[str, str]] = []
    try:
        tree = ast.parse(code)
    except SyntaxError as e:
        return set(), [("EXEC", str(e))]
    if code.count("\n") > MOST_LINES:
        found.append(("LINE", f"the code has more than {MOST_LINES} lines"))
    names = {k: v for k, v in (arguments or {}).items() if isinstance(v, int | float)}
    for node in ast.walk(tree):
        if isinstance(node, ast.FunctionDef):
            for arg, value in zip(node.args.args[::-1], node.args.defaults[::-1], strict=False):
                if (v := _number(value, {})) is not None:
                    names.setdefault(arg.arg, v)
    for node in ast.walk(tree):
        if isinstance(node, ast.Import | ast.ImportFrom):
            found.append(("IMPORT", "imports are not allowed"))
        elif isinstance(node, _FORBIDDEN):
            found.append(("EXEC", f"{type(node).__name__} is not allowed"))
        elif isinstance(node, ast.Attribute) and node.attr.startswith("_") or isinstance(node, ast.Name) and node.id.startswith("__"):
            found.append(("EXEC", "private names are not allowed"))
        elif isinstance(node, ast.Attribute) and node.attr in ("bfill", "backfill"):
            found.append(("FUTURE", f"{node.attr} looks ahead"))
        elif isinstance(node, ast.Attribute) and (node.attr.startswith(("read_", "to_")) and node.attr not in ("to_numeric", "to_frame", "to_numpy") or node.attr in ("eval", "query", "pipe")):
            found.append(("EXEC", f"{node.attr} is not allowed"))
        if not isinstance(node, ast.Call):
            continue
        attr = node.func.attr if isinstance(node.func, ast.Attribute) else node.func.id if isinstance(node.func, ast.Name) else ""
        words = {k.arg: k.value for k in node.keywords if k.arg}
        if attr in ("shift", "diff", "pct_change"):
            by = _number(words.get("periods") or (node.args[0] if node.args else ast.Constant(1)), names)
            if by is not None and by < 0:
                found.append(("FUTURE", f"{attr}({by:g}) looks ahead"))
        if attr == "roll":
            by = _number(words.get("shift") or (node.args[1] if len(node.args) > 1 else ast.Constant(1)), names)
            if by is not None and by < 0:
                found.append(("FUTURE", f"roll by {by:g} looks ahead"))
        if attr == "rolling" and isinstance(words.get("center"), ast.Constant) and words["center"].value:
            found.append(("FUTURE", "a centred window looks ahead"))
        how = next((words[k].value for k in ("method", "limit_direction") if isinstance(words.get(k), ast.Constant)), None)
        if attr == "fillna" and how in ("bfill", "backfill") or attr == "interpolate" and how in ("backward", "both"):
            found.append(("FUTURE", f"{attr} looks ahead"))
    if _computed_fields(tree):
        found.append(("KEY", "fields of the data are named by literal text"))
    fields = referenced(code) - {"time", "symbol"}
    if unknown := sorted(fields - allowed):
        found.append(("KEY", f"unknown fields {unknown}"))
    fields &= allowed
    if not fields:
        found.append(("KEY", "the code reads no field"))
    elif mode != "any":
        if mode not in MODES:
            raise ValueError(f"factor mode {mode!r} is none of {MODES}")
        own = market or set()
        has_market, has_other = bool(fields & own), bool(fields - own)
        if mode == "ohlcv" and has_other or mode == "fundamental" and not has_other or mode == "hybrid" and not (has_market and has_other):
            found.append(("KEY", f"the fields {sorted(fields)} don't suit mode {mode}"))
    return fields, [*dict.fromkeys(found)]


def compiled(code: str, entry: str | None = None) -> Callable:
    name = entry_of(code, entry)
    space = {"__builtins__": BUILTINS, "np": np, "pd": pd, "math": math}
    exec(compile(code, "<factor>", "exec"), space)
    return space[name]


def _series(result, index: pd.MultiIndex) -> np.ndarray:
    """float32 values along ``index`` of what a factor returned: a Series, a one-column or a wide frame."""
    if isinstance(result, pd.DataFrame):
        result = result.iloc[:, 0] if result.shape[1] == 1 else result.stack(future_stack=True)
    if not isinstance(result, pd.Series):
        raise TypeError("a factor returns a Series or a frame")
    if result.index.has_duplicates:
        raise ValueError("a factor returned repeated keys")
    if not result.index.equals(index):
        if [*result.index.names] == [SYMBOL, "time"]:
            result = result.reorder_levels(["time", SYMBOL])
        result = result.reindex(index)
    return result.to_numpy("float32")


def _run(panel: DataFrame, code: str, keys: list[str], entry: str | None, arguments: dict | None) -> DataFrame:
    fields, found = analyse(code, set(panel.columns), arguments=arguments)
    if found:
        raise ExpressionError(*found[0])
    columns = sorted(fields)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([DATE, SYMBOL], kind="stable")
        data = pdf.set_index(pd.MultiIndex.from_arrays([pd.to_datetime(pdf[DATE]), pdf[SYMBOL]], names=["time", SYMBOL]))[columns]
        values = _series(compiled(code, entry)(data, **(arguments or {})), data.index)
        return pd.DataFrame({DATE: pdf[DATE].to_numpy(), SYMBOL: pdf[SYMBOL].to_numpy(), "value": np.where(np.isfinite(values), values, np.nan)})

    narrow = panel.select(DATE, SYMBOL, *columns)
    grouped = narrow.groupBy(*keys)
    out = grouped.applyInPandas(run, f"{DATE} date, {SYMBOL} string, value float")
    return out.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def run_per_symbol(panel: DataFrame, code: str, *, entry: str | None = None, arguments: dict | None = None) -> DataFrame:
    """(date, symbol, value) of code that looks along one symbol at a time."""
    return _run(panel, code, [SYMBOL], entry, arguments)


def run_per_date(panel: DataFrame, code: str, *, entry: str | None = None, arguments: dict | None = None) -> DataFrame:
    """(date, symbol, value) of code that looks across one date at a time."""
    return _run(panel, code, [DATE], entry, arguments)


def run_whole(panel: DataFrame, code: str, *, entry: str | None = None, arguments: dict | None = None) -> DataFrame:
    """(date, symbol, value) of code that needs the whole panel, in one task; a panel too large for one is refused."""
    if panel.limit(MOST_WHOLE_ROWS + 1).count() > MOST_WHOLE_ROWS:
        raise ExpressionError("EXEC", f"the code needs the whole panel at once, which has more than {MOST_WHOLE_ROWS} rows")
    return _run(panel, code, [], entry, arguments)


#: Methods that give each row from the same row of their operands, whatever other rows there are.
_BY_ROW = frozenset("abs add sub mul div truediv pow neg clip where mask fillna replace astype copy rename isna notna isnull notnull round between eq ne lt le gt ge get log log1p exp sqrt sign tanh maximum minimum isfinite isnan power".split())
#: Methods of a grouping that keep to its groups.
_OF_GROUPS = frozenset("shift diff pct_change rolling ewm expanding transform cumsum cumprod cummax cummin rank ffill mean std sum max min median var count corr cov apply first last quantile skew kurt".split())
#: Ends of a chain that take the group's level from the index again.
_TIDY = frozenset("reset_index droplevel reorder_levels sort_index".split())


def _level(call: ast.Call) -> str | None:
    """The index level of a ``groupby``; None for any other grouping."""
    asked = next((k.value for k in call.keywords if k.arg == "level"), None) or (call.args[0] if call.args else None)
    if any(k.arg not in ("level", "group_keys", "sort") for k in call.keywords) or not isinstance(asked, ast.Constant):
        return None
    return {0: "time", 1: SYMBOL, "time": "time", SYMBOL: SYMBOL}.get(asked.value)


def within(code: str) -> str | None:
    """The level, ``symbol`` or ``time``, within whose groups every operation of the code is shown to stay; else None.

    Every method call must be one that goes by row, or stand in a chain that begins with a grouping by the one level;
    code without a grouping that only goes by row stays within symbols.
    Functions passed to ``apply`` and ``transform`` see one group only, so that anything is fine in them.
    """
    tree = ast.parse(code)
    groupings = [n for n in ast.walk(tree) if isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute) and n.func.attr == "groupby"]
    levels = {_level(c) for c in groupings} or {SYMBOL}
    if len(levels) != 1 or None in levels or len(functions_of(code)) != 1:
        return None
    inside = {id(x) for n in ast.walk(tree) if isinstance(n, ast.Lambda) for x in ast.walk(n)}

    def grouped(x: ast.AST) -> bool:
        """Whether a chain of calls, attributes and subscripts begins with a grouping."""
        while isinstance(x, ast.Call | ast.Attribute | ast.Subscript):
            if isinstance(x, ast.Call) and isinstance(x.func, ast.Attribute) and x.func.attr == "groupby":
                return True
            x = x.func if isinstance(x, ast.Call) else x.value
        return isinstance(x, ast.Name) and x.id in names

    # names of groupings, like g = close.groupby(level="symbol")
    names: set[str] = set()
    for node in ast.walk(tree):
        if isinstance(node, ast.Assign) and isinstance(node.value, ast.Call) and isinstance(node.value.func, ast.Attribute) and node.value.func.attr == "groupby":
            names |= {t.id for t in node.targets if isinstance(t, ast.Name)}
    plain = {"abs", "float", "int", "round"}
    totals = {"mean", "std", "sum", "max", "min", "median", "var", "count", "first", "last", "quantile", "skew", "kurt", "corr", "cov"}
    direct = lambda x: isinstance(x, ast.Name) and x.id in names or isinstance(x, ast.Call) and isinstance(x.func, ast.Attribute) and x.func.attr == "groupby" or isinstance(x, ast.Subscript) and direct(x.value)
    for node in ast.walk(tree):
        if id(node) in inside:
            continue
        if isinstance(node, ast.Slice | ast.For | ast.While | ast.ListComp | ast.SetComp | ast.DictComp | ast.GeneratorExp):
            return None
        if isinstance(node, ast.Attribute) and node.attr in ("iloc", "loc", "iat", "at", "values", "index", "T", "shape", "size"):
            return None
        if not isinstance(node, ast.Call):
            continue
        if isinstance(node.func, ast.Name):
            if node.func.id not in plain:
                return None
        elif isinstance(node.func, ast.Attribute) and node.func.attr != "groupby":
            if not (node.func.attr in _BY_ROW or node.func.attr in _OF_GROUPS | _TIDY and grouped(node.func.value)):
                return None
            # one number for each group doesn't stand beside rows again
            if node.func.attr in totals and direct(node.func.value):
                return None
    return levels.pop()


def run(panel: DataFrame, code: str, *, entry: str | None = None, arguments: dict | None = None) -> DataFrame:
    """Per symbol or per date where the code is shown to stay within one, else on the whole panel."""
    how = {SYMBOL: run_per_symbol, "time": run_per_date, None: run_whole}[within(code)]
    return how(panel, code, entry=entry, arguments=arguments)


@contextmanager
def job_limit(spark, seconds: float):
    """TimeoutError if the jobs begun inside take longer; they are cancelled."""
    context, group, over = spark.sparkContext, f"limit-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        over.set()
        context.cancelJobGroup(group)

    before = context.getLocalProperty("spark.jobGroup.id")
    context.setJobGroup(group, f"at most {seconds:g} s", interruptOnCancel=True)
    timer = threading.Timer(seconds, stop)
    timer.daemon = True
    timer.start()
    try:
        yield
        if over.is_set():
            raise TimeoutError(f"not done in {seconds:g} s")
    except Exception as e:
        if over.is_set() and not isinstance(e, TimeoutError):
            raise TimeoutError(f"not done in {seconds:g} s") from e
        raise
    finally:
        timer.cancel()
        context.setLocalProperty("spark.jobGroup.id", before)

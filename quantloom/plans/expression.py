"""Factor expressions: text to a checked tree, and a tree to staged columns.

The grammar is a whitelist of Python expressions: field names, numbers, arithmetic, comparisons and calls of the
operators below. Nothing is evaluated. Look-ahead (negative lags) and unknown names are refused before a plan is made.

Windows can't be nested in one column, so every window whose argument holds another is put into a column of its own;
equal subexpressions share it.
"""

from __future__ import annotations

import ast
from collections.abc import Callable
from dataclasses import dataclass
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import core


class ExpressionError(ValueError):
    """``kind`` is EXEC (not an expression), KEY (unknown field or operator) or FUTURE (look-ahead)."""

    def __init__(self, kind: str, message: str):
        super().__init__(f"{kind}: {message}")
        self.kind = kind


@dataclass(frozen=True)
class Field:
    name: str


@dataclass(frozen=True)
class Number:
    value: float


@dataclass(frozen=True)
class Call:
    op: str
    args: tuple["Node", ...]


Node = Field | Number | Call


@dataclass(frozen=True)
class Operator:
    """``args``: x for a column, n for a whole number of rows, v for a number or column; after ``|`` optional."""

    args: str
    build: Callable[..., Column]
    window: bool = False

    @property
    def least(self) -> int:
        return len(self.args.partition("|")[0])

    @property
    def kinds(self) -> str:
        return self.args.replace("|", "")


def _wrap(how: str) -> Callable[..., Column]:
    return lambda x, n, p=None: core.rolling(x, n, how, n if p is None else p)


def _ts(f: Callable[..., Column]) -> Operator:
    return Operator("xn", f, True)


OPERATORS: dict[str, Operator] = {
    # across symbols
    "rank": Operator("x", core.rank, True),
    "zscore": Operator("x", core.zscore, True),
    "scale": Operator("x|v", core.scale, True),
    # along dates
    "delay": _ts(core.delay),
    "delta": _ts(core.delta),
    "returns": Operator("|xn", lambda x=None, n=1: core.pct_change(F.col("close") if x is None else x, n), True),
    "returns_pad": Operator("x|n", lambda x, n=1: core.pct_change(x, n, "pad"), True),
    "adv": Operator("n", lambda n: core.ts_mean(F.col("volume"), n), True),
    "ts_mean": _ts(core.ts_mean),
    "ts_std": _ts(core.ts_std),
    "ts_max": _ts(core.ts_max),
    "ts_min": _ts(core.ts_min),
    "ts_sum": _ts(core.ts_sum),
    "ts_rank": _ts(core.ts_rank),
    "ts_zscore": _ts(core.ts_zscore),
    "ts_argmax": Operator("xn", lambda x, n: core.ts_argmax(x, n, F.col(PLACE)), True),
    "ts_argmin": Operator("xn", lambda x, n: core.ts_argmin(x, n, F.col(PLACE)), True),
    "decay_linear": _ts(core.decay_linear),
    "correlation": Operator("xxn|n", core.correlation, True),
    "covariance": Operator("xxn|n", core.covariance, True),
    # rolling over present rows with a least number of values, the window's length by default
    "mean": Operator("xn|n", _wrap("mean"), True),
    "std": Operator("xn|n", _wrap("std"), True),
    "sum": Operator("xn|n", _wrap("sum"), True),
    "highest": Operator("xn|n", _wrap("max"), True),
    "lowest": Operator("xn|n", _wrap("min"), True),
    "pct_change": Operator("x|n", core.pct_change, True),
    "ewm": Operator("xn", lambda x, n: x, True),
    # element by element
    "sign": Operator("x", core.sign),
    "log": Operator("x", core.log),
    "abs": Operator("x", F.abs),
    "sqrt": Operator("x", lambda x: F.when(x >= 0, F.sqrt(x))),
    "exp": Operator("x", lambda x: core.finite(F.exp(x))),
    "power": Operator("xv", core.power),
    "signed_power": Operator("xv", core.signed_power),
    "min": Operator("vv", core.least),
    "max": Operator("vv", core.greatest),
    "clip": Operator("xvv", core.clip),
    "where": Operator("xv|v", lambda c, x, y=None: F.when(c, x) if y is None else F.when(c, x).when(~c, y)),
    "coalesce": Operator("xv", F.coalesce),
    # written with signs
    "add": Operator("vv", lambda a, b: a + b),
    "sub": Operator("vv", lambda a, b: a - b),
    "mul": Operator("vv", lambda a, b: a * b),
    "div": Operator("vv", core.divide),
    "neg": Operator("v", lambda a: -a),
    "gt": Operator("vv", lambda a, b: a > b),
    "ge": Operator("vv", lambda a, b: a >= b),
    "lt": Operator("vv", lambda a, b: a < b),
    "le": Operator("vv", lambda a, b: a <= b),
    "eq": Operator("vv", lambda a, b: a == b),
    "ne": Operator("vv", lambda a, b: a != b),
    "and": Operator("vv", lambda a, b: a & b),
    "or": Operator("vv", lambda a, b: a | b),
    "not": Operator("v", lambda a: ~a),
}
PLACE = "_place"
_ALIASES = {"open_": "open", "np.log": "log", "np.sqrt": "sqrt", "np.abs": "abs", "np.sign": "sign", "np.exp": "exp", "np.where": "where", "np.maximum": "max", "np.minimum": "min"}
_BINARY = {ast.Add: "add", ast.Sub: "sub", ast.Mult: "mul", ast.Div: "div", ast.Pow: "power", ast.BitAnd: "and", ast.BitOr: "or"}
_COMPARE = {ast.Gt: "gt", ast.GtE: "ge", ast.Lt: "lt", ast.LtE: "le", ast.Eq: "eq", ast.NotEq: "ne"}


def parse(text: str, fields: set[str] | None = None) -> Node:
    """The tree of an expression; ``fields`` are the names that it may use, any by default."""
    try:
        tree = ast.parse(text.strip(), mode="eval").body
    except SyntaxError as e:
        raise ExpressionError("EXEC", str(e)) from None

    def name(x: ast.expr) -> str | None:
        if isinstance(x, ast.Name):
            return x.id
        if isinstance(x, ast.Attribute) and isinstance(x.value, ast.Name):
            return f"{x.value.id}.{x.attr}"
        return None

    def walk(x: ast.expr) -> Node:
        match x:
            case ast.Constant(value=bool()):
                raise ExpressionError("EXEC", "true and false are not values")
            case ast.Constant(value=int() | float() as v):
                return Number(float(v))
            case ast.Name():
                own = _ALIASES.get(x.id, x.id)
                if fields is not None and own not in fields:
                    raise ExpressionError("KEY", f"field {own!r} is not available; there are {', '.join(sorted(fields))}")
                return Field(own)
            case ast.UnaryOp(op=ast.USub(), operand=inner):
                below = walk(inner)
                return Number(-below.value) if isinstance(below, Number) else Call("neg", (below,))
            case ast.UnaryOp(op=ast.UAdd(), operand=inner):
                return walk(inner)
            case ast.UnaryOp(op=ast.Invert(), operand=inner):
                return Call("not", (walk(inner),))
            case ast.BinOp() if type(x.op) in _BINARY:
                return Call(_BINARY[type(x.op)], (walk(x.left), walk(x.right)))
            case ast.Compare(ops=[op], comparators=[right]) if type(op) in _COMPARE:
                return Call(_COMPARE[type(op)], (walk(x.left), walk(right)))
            case ast.Call(keywords=[]):
                op = name(x.func)
                op = _ALIASES.get(op, op)
                if op not in OPERATORS:
                    raise ExpressionError("KEY", f"operator {op!r} is not known")
                return checked(op, tuple(walk(a) for a in x.args))
        raise ExpressionError("EXEC", f"{ast.unparse(x)!r} is not allowed")

    def checked(op: str, args: tuple[Node, ...]) -> Call:
        own = OPERATORS[op]
        if not own.least <= len(args) <= len(own.kinds):
            raise ExpressionError("EXEC", f"{op} takes {own.least} to {len(own.kinds)} arguments, not {len(args)}")
        for kind, arg in zip(own.kinds, args, strict=False):
            if kind == "n":
                if not isinstance(arg, Number) or arg.value != int(arg.value):
                    raise ExpressionError("EXEC", f"{op} takes a whole number of rows")
                if arg.value < 0:
                    raise ExpressionError("FUTURE", f"{op} looks {-int(arg.value)} rows ahead")
                if arg.value < 1 and op not in ("delay", "delta", "returns", "pct_change"):
                    raise ExpressionError("EXEC", f"{op} needs a window of one row at least")
        return Call(op, args)

    return walk(tree)


def fields_of(node: Node) -> set[str]:
    """The fields that a tree reads, those that its operators imply included."""
    if isinstance(node, Field):
        return {node.name}
    if isinstance(node, Number):
        return set()
    own = {"volume"} if node.op == "adv" else {"close"} if node.op == "returns" and not node.args else set()
    return own.union(*map(fields_of, node.args))


def uses(node: Node, op: str) -> bool:
    return isinstance(node, Call) and (node.op == op or any(uses(a, op) for a in node.args))


def longest_look_back(node: Node) -> int:
    """Rows before the current one that a tree can reach."""
    if not isinstance(node, Call):
        return 0
    own = max([int(a.value) for k, a in zip(OPERATORS[node.op].kinds, node.args, strict=False) if k == "n" and isinstance(a, Number)], default=0)
    return own + max(map(longest_look_back, node.args), default=0)


def ewm_mean(frame: DataFrame, value: str, span: int, out: str) -> DataFrame:
    """Exponentially weighted mean along each symbol's rows (weights normalised, gaps keep their distance)."""
    schema = T.StructType([*frame.schema.fields, T.StructField(out, T.DoubleType())])
    names = schema.names

    def run(pdf):
        pdf = pdf.sort_values(core.DATE, kind="stable")
        pdf[out] = pdf[value].astype("float64").ewm(span=span, adjust=True, ignore_na=False).mean()
        return pdf[names]

    return frame.groupBy(core.SYMBOL).applyInPandas(run, schema)


class Stages:
    """Compiles trees onto one frame; columns of windows below windows are staged and shared."""

    def __init__(self, frame: DataFrame, prefix: str = "_e"):
        self.frame, self.prefix = frame, prefix
        self.known: dict[Node, str] = {}
        self.number = count()

    def staged(self, node: Node, column: Column) -> Column:
        name = f"{self.prefix}{next(self.number)}"
        self.frame = self.frame.withColumn(name, column)
        self.known[node] = name
        return F.col(name)

    def column(self, node: Node) -> tuple[Column, bool]:
        """The column of a tree and whether it holds a window."""
        if node in self.known:
            return F.col(self.known[node]), False
        if isinstance(node, Field):
            return F.col(node.name), False
        if isinstance(node, Number):
            return F.lit(node.value), False
        own = OPERATORS[node.op]
        if node.op in ("ts_argmax", "ts_argmin") and PLACE not in self.frame.columns:
            self.frame = self.frame.withColumn(PLACE, core.row_place())
        args, inner = [], False
        for kind, arg in zip(own.kinds, node.args, strict=False):
            if kind == "n":
                args.append(int(arg.value))
                continue
            column, holds = self.column(arg)
            if own.window and (holds or not isinstance(arg, Field | Number) and arg not in self.known):
                column, holds = self.staged(arg, column), False
            args.append(column)
            inner = inner or holds
        if node.op == "ewm":
            if node.args[0] not in self.known:
                self.staged(node.args[0], args[0])
            name = f"{self.prefix}{next(self.number)}"
            self.frame = ewm_mean(self.frame, self.known[node.args[0]], args[1], name)
            self.known[node] = name
            return F.col(name), False
        if node.op in ("correlation", "covariance") and args[2] >= core.LONG:
            pair = [self.staged(Call("centred", (*node.args[:2], Number(i))), c) for i, c in enumerate(core.centred(*args[:2]))]
            return core.long_moments(*pair, args[2], args[3] if len(args) > 3 else 2, correlation=node.op == "correlation"), True
        return own.build(*args), inner or own.window

    def add(self, name: str, node: Node) -> None:
        column, _ = self.column(node)
        if isinstance(node, Number):
            column = column.cast("double")
        self.frame = self.frame.withColumn(name, core.finite(column.cast("double")))


def evaluate(frame: DataFrame, expressions: dict[str, str | Node], fields: set[str] | None = None) -> DataFrame:
    """``frame`` with a column for each expression. Rows of ``frame`` make the time axis: densify it first for dense operators."""
    stages = Stages(frame)
    names = set(frame.columns) if fields is None else fields
    for name, expression in expressions.items():
        stages.add(name, parse(expression, names) if isinstance(expression, str) else expression)
    return stages.frame.select(*frame.columns, *expressions)


__all__ = ["OPERATORS", "Call", "ExpressionError", "Field", "Number", "Stages", "evaluate", "fields_of", "longest_look_back", "parse"]

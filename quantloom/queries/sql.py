"""Expression trees as SQL over a panel ``p``, for the oracle side only."""

from __future__ import annotations

from itertools import count

from ..plans.expression import OPERATORS, Call, Field, Node, Number, parse

_X = "(PARTITION BY date)"
_D = "(PARTITION BY symbol ORDER BY date)"


def _w(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _lag(x: str, n: int) -> str:
    return f"lag({x}, {n}) OVER {_D}"


def _div(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0))"


def _rolling(x: str, n: int, f: str, least: int) -> str:
    return f"CASE WHEN count({x}) OVER {_w(n)} >= {least} THEN {f}({x}) OVER {_w(n)} END"


def _list(x: str, n: int) -> str:
    return f"(list({x}) OVER {_w(n)})"


def _arg(x: str, n: int, best: str) -> str:
    a = _list(x, n)
    return f"CASE WHEN count({x}) OVER {_w(n)} > 0 THEN CAST(len({a}) - coalesce(nullif(list_position(list_transform({a}, lambda v: v IS NULL), true), 0), list_position({a}, {best}({a}))) AS DOUBLE) END"


def _both(x: str, y: str, v: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN {v} END"


def _pair(x: str, y: str, n: int, least: int, corr: bool) -> str:
    a, b = f"({_both(x, y, x)})", f"({_both(x, y, y)})"
    cov = f"covar_samp({a}, {b}) OVER {_w(n)}"
    spread = f"(stddev_samp({a}) OVER {_w(n)} * stddev_samp({b}) OVER {_w(n)})"
    value = f"{cov} / CASE WHEN {spread} > 1e-12 THEN {spread} END" if corr else cov
    return f"CASE WHEN count({a}) OVER {_w(n)} >= {max(2, least)} THEN {value} END"


def _ewm(x: str, span: int) -> str:
    a = f"(list({x}) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"
    keep = 1 - 2 / (span + 1)
    weight = f"pow({keep!r}, len({a}) - i)"
    return f"list_sum(list_transform({a}, lambda v, i: coalesce(v, 0) * {weight})) / nullif(list_sum(list_transform({a}, lambda v, i: CASE WHEN v IS NULL THEN 0 ELSE {weight} END)), 0)"


_BINARY = {"add": "+", "sub": "-", "mul": "*", "gt": ">", "ge": ">=", "lt": "<", "le": "<=", "eq": "=", "ne": "<>", "and": "AND", "or": "OR"}


class Query:
    """CTEs of one expression over panel ``p``; every call gets a column of its own."""

    def __init__(self, ctes: str):
        self.ctes, self.last, self.number = [ctes], "p", count()
        self.known: dict[Node, str] = {}

    def staged(self, node: Node, sql: str) -> str:
        i = next(self.number)
        self.ctes.append(f"s{i} AS (SELECT *, {sql} AS c{i} FROM {self.last})")
        self.last = f"s{i}"
        self.known[node] = f"c{i}"
        return f"c{i}"

    def column(self, node: Node) -> str:
        if isinstance(node, Field):
            return node.name
        if isinstance(node, Number):
            return f"CAST({node.value!r} AS DOUBLE)"
        if node in self.known:
            return self.known[node]
        kinds = OPERATORS[node.op].kinds
        args = [int(a.value) if k == "n" else self.column(a) for k, a in zip(kinds, node.args, strict=False)]
        return self.staged(node, self.sql(node.op, args))

    def sql(self, op: str, a: list) -> str:
        x = a[0] if a else None
        if op in _BINARY:
            return f"({x} {_BINARY[op]} {a[1]})"
        names = {"mean": "avg", "std": "stddev_samp", "sum": "sum", "highest": "max", "lowest": "min"}
        if op in names:
            return _rolling(x, a[1], names[op], a[2] if len(a) > 2 else a[1])
        match op:
            case "rank":
                return f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY date, {x} IS NULL ORDER BY {x}) + (count(*) OVER (PARTITION BY date, {x}) - 1) / 2.0) / count({x}) OVER {_X} END"
            case "zscore":
                return f"({x} - avg({x}) OVER {_X}) / nullif(stddev_samp({x}) OVER {_X}, 0)"
            case "scale":
                return f"{x} / nullif(sum(abs({x})) OVER {_X}, 0) * {a[1] if len(a) > 1 else 1.0}"
            case "delay":
                return _lag(x, a[1])
            case "delta":
                return f"{x} - {_lag(x, a[1])}"
            case "returns" | "pct_change":
                x, n = x or "close", a[1] if len(a) > 1 else 1
                return f"{_div(x, _lag(x, n))} - 1" if n else f"{_div(x, x)} - 1"
            case "adv":
                return _rolling("volume", a[0], "avg", 1)
            case "ts_mean" | "ts_max" | "ts_min" | "ts_sum":
                return _rolling(x, a[1], {"ts_mean": "avg", "ts_max": "max", "ts_min": "min", "ts_sum": "sum"}[op], 1)
            case "ts_std":
                return _rolling(x, a[1], "stddev_samp", 2)
            case "ts_zscore":
                return f"({x} - {_rolling(x, a[1], 'avg', 1)}) / nullif({_rolling(x, a[1], 'stddev_samp', 2)}, 0)"
            case "ts_rank":
                values = f"list_filter({_list(x, a[1])}, lambda v: v IS NOT NULL)"
                own = f"(len(list_filter({values}, lambda v: v < {x})) + (len(list_filter({values}, lambda v: v = {x})) + 1) / 2.0)"
                return f"CASE WHEN {x} IS NOT NULL AND len({values}) >= {max(1, a[1] // 2)} THEN {own} / len({values}) END"
            case "ts_argmax":
                return _arg(x, a[1], "list_max")
            case "ts_argmin":
                return _arg(x, a[1], "list_min")
            case "decay_linear":
                n = a[1]
                return "(" + " + ".join([f"{x} * {n}.0", *(f"{_lag(x, k)} * {n - k}.0" for k in range(1, n))]) + f") / {n * (n + 1) / 2}"
            case "correlation" | "covariance":
                return _pair(x, a[1], a[2], a[3] if len(a) > 3 else 2, op == "correlation")
            case "ewm":
                return _ewm(x, a[1])
            case "sign":
                return f"CAST(sign({x}) AS DOUBLE)"
            case "log":
                return f"CASE WHEN {x} > 0 THEN ln({x}) END"
            case "abs":
                return f"abs({x})"
            case "sqrt":
                return f"CASE WHEN {x} >= 0 THEN sqrt({x}) END"
            case "exp":
                return f"exp({x})"
            case "power":
                return f"CASE WHEN isfinite(pow({x}, {a[1]})) THEN pow({x}, {a[1]}) END"
            case "signed_power":
                return f"sign({x}) * pow(abs({x}), {a[1]})"
            case "min":
                return _both(x, a[1], f"least({x}, {a[1]})")
            case "max":
                return _both(x, a[1], f"greatest({x}, {a[1]})")
            case "clip":
                return f"CASE WHEN {x} IS NOT NULL AND {a[1]} IS NOT NULL AND {a[2]} IS NOT NULL THEN least(greatest({x}, {a[1]}), {a[2]}) END"
            case "where":
                return f"CASE WHEN {x} THEN {a[1]} END" if len(a) < 3 else f"CASE WHEN {x} THEN {a[1]} WHEN NOT {x} THEN {a[2]} END"
            case "coalesce":
                return f"coalesce({x}, {a[1]})"
            case "div":
                return _div(x, a[1])
            case "neg":
                return f"-{x}"
            case "not":
                return f"NOT {x}"
            case "returns_pad":
                filled = f"last_value({x} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
                i = next(self.number)
                self.ctes.append(f"s{i} AS (SELECT *, {filled} AS c{i} FROM {self.last})")
                self.last = f"s{i}"
                return f"{_div(f'c{i}', _lag(f'c{i}', a[1] if len(a) > 1 else 1))} - 1"
        raise ValueError(op)


def expressions_sql(ctes: str, expressions: dict[str, str], digits: int | None = 6) -> str:
    """SELECT of (date, symbol) and each expression, rounded if ``digits`` is given."""
    query = Query(ctes)
    columns = {name: query.column(parse(text)) for name, text in expressions.items()}
    finite = {name: f"CASE WHEN isfinite({c}) THEN {c} END" for name, c in columns.items()}
    out = ", ".join(f"{c} AS {name}" if digits is None else f"round({c}, {digits}) + 0.0 AS {name}" for name, c in finite.items())
    return f"WITH {', '.join(query.ctes)} SELECT date, symbol, {out} FROM {query.last}"

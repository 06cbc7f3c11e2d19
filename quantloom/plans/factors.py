"""The factor library as expressions over the rows that exist for each symbol.

Windows ``mean(x, n, p)`` ask for p values of the last n; without p they ask for n.
"""

from __future__ import annotations

import ast

from pyspark.sql import DataFrame

from .expression import evaluate

#: Guard of the denominators (a fixed value of the formulas).
E = "0.00000001"
_RANGE = "(high - low)"
#: Prices that are not positive and volumes that are negative count as missing.
_CLEAN = {"open": "where(open > 0, open)", "high": "where(high > 0, high)", "low": "where(low > 0, low)", "close": "where(close > 0, close)", "volume": "where(volume >= 0, volume)"}


def _relative_volume(top: int, volume: str = "volume") -> str:
    return f"clip({volume} / (mean({volume}, 20, 6) + {E}), 0, {top})"


_BODY = f"clip(abs(close - open) / ({_RANGE} + {E}), 0, 1)"
_CLV = f"(((close - low) - (high - close)) / ({_RANGE} + {E}))"
_SPREAD = f"({_RANGE} / (abs(close) + {E}))"
_POSITIVE = "where(volume > 0, volume)"

FACTORS: dict[str, str] = {
    "congestion_effort_result": f"mean(mean(1 - {_BODY}, 5, 3) * {_relative_volume(4)} * clip({_RANGE} / (mean({_RANGE}, 10, 5) + {E}), 0, 4), 3, 1)",
    "vwap_dislocation_volume_reversal": f"-mean(close / (vwap + {E}) - 1, 5, 2) * sqrt({_relative_volume(3, _POSITIVE)}) / (mean({_SPREAD}, 10, 5) + {E})",
    "churn_inefficiency": f"-pct_change(where(close > 0, close), 10) * mean(clip({_POSITIVE} / (mean({_POSITIVE}, 20, 6) + {E}), 0, 5) * abs(pct_change(where(close > 0, close), 1)), 10, 5) * (1 - clip(abs(pct_change(where(close > 0, close), 10)) / (sum(abs(pct_change(where(close > 0, close), 1)), 10, 5) + {E}), 0, 1))",
    "gap_rejection_volume": f"mean(-((open - delay(close, 1)) / (delay(close, 1) + {E})) * ((close - open) / (open + {E})), 5, 2) * (0.5 + 0.5 * mean({_relative_volume(4)}, 5, 2))",
    "close_location_volume_pressure": f"mean(mean({_CLV}, 6, 3) * {_relative_volume(4)}, 3, 1)",
    "compressed_breakout_quality": "mean(sign(pct_change(close, 20)) * clip(abs(pct_change(close, 20)) / where(20 * mean(abs(pct_change(close, 1)), 20, 10) > 0.00000001, 20 * mean(abs(pct_change(close, 1)), 20, 10)), 0, 1.5)"
    " * clip(1 / (1 + mean(high - low, 10, 5) / where(abs(close) > 0.00000001, abs(close))), 0, 1) * clip(volume / where(mean(volume, 20, 10) > 0.00000001, mean(volume, 20, 10)), 0, 3), 3, 1)",
    "persistent_range_volume_trend": f"mean(mean(clip({_CLV}, -1, 1), 6, 3) * {_relative_volume(4)} * sign(pct_change(close, 5)), 3, 1)",
    "turnover_displacement_friction": f"mean({_relative_volume(4)} / (1 + clip(abs(pct_change(close, 5)) / (mean({_RANGE}, 10, 5) / (abs(close) + {E}) + {E}), 0, 5)), 3, 1)",
    "intraday_reversal_liquidity": f"mean(-(close / open - 1) * clip(volume / mean(volume, 20, 6), 0, 5) * (1.5 - clip((close - low) / (high - low), 0, 1)), 3, 1) / (std(pct_change(close, 1), 20, 6) + {E})",
    "conviction_instability_turnover": f"mean(std({_BODY}, 10, 5) * {_relative_volume(4)} / (1 + clip({_SPREAD} / (mean({_SPREAD}, 10, 5) + {E}), 0, 4)), 3, 1)",
    "example_close_vwap_gap": f"mean(close / (abs(vwap) + {E}) - 1, 5, 2)",
    "macd": "2 * ((ewm(close, 12) - ewm(close, 26)) - ewm(ewm(close, 12) - ewm(close, 26), 9))",
    "price_volume_correlation": "correlation(close, volume, 100, 100)",
    "volatility": "std(coalesce(pct_change(close, 1), 0), 30, 30)",
    "volume_spike": "volume / mean(volume, 10)",
    "price_drawdown": "(close - highest(close, 60)) / highest(close, 60)",
    "amplitude": "mean((high - low) / low, 10)",
    "dry_run_hybrid_value_momentum": "zscore(fundamental) * pct_change(close, 5)",
    "dry_run_close_to_vwap_gap": f"mean(close / (abs(vwap) + {E}) - 1, 5, 2)",
}
#: Factors whose formula first drops impossible prices.
CLEANED = ("congestion_effort_result", "compressed_breakout_quality", "persistent_range_volume_trend", "turnover_displacement_friction", "conviction_instability_turnover")


def formula(name: str) -> str:
    """The expression of a factor, with its cleaning put in."""
    text = FACTORS[name]
    if name not in CLEANED:
        return text

    class Put(ast.NodeTransformer):
        def visit_Name(self, node):
            return ast.parse(_CLEAN[node.id], mode="eval").body if node.id in _CLEAN else node

    return ast.unparse(Put().visit(ast.parse(text, mode="eval")))


def compute(panel: DataFrame, names: list[str]) -> DataFrame:
    """(date, symbol, one column for each factor); all factors share their windows and stages."""
    out = evaluate(panel, {f"_f_{n}": formula(n) for n in names})
    return out.select("date", "symbol", *(out[f"_f_{n}"].alias(n) for n in names))

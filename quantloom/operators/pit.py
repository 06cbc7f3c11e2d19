"""Point-in-time operators: activation dates, merged statements, snapshots, as-of joins, ratios, coverage.

An event is known from its activation date on, the next trading date after it became available. Nothing is ever
filled backwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import DATE, SYMBOL

STATEMENT_KEY = [SYMBOL, DATE, "quarter", "if_adjusted"]
#: A denominator up to this size makes no ratio.
LEAST_DENOMINATOR = 1e-12


def report_ordinal(quarter: Column) -> Column:
    """Year and quarter as one number: '2026q1' is 8104. NULL for other text."""
    return F.when(quarter.rlike("^[0-9]{4}q[1-4]$"), F.substring(quarter, 1, 4).cast("int") * 4 + F.substring(quarter, 6, 1).cast("int") - 1)


def check_quarters(statements: DataFrame) -> DataFrame:
    bad = statements.where(report_ordinal(F.col("quarter")).isNull()).select("quarter").limit(5).collect()
    if bad:
        raise ValueError(f"quarters that are not like 2026q1: {[r[0] for r in bad]}")
    return statements


def activate(events: DataFrame, calendar: DataFrame, *, strict: bool = True) -> DataFrame:
    """``events`` with ``activation_date``. calendar: nature_date, next_trade_date; one row a day, so it is broadcast."""
    days = calendar.select(F.col("nature_date").alias("_day"), F.col("next_trade_date").alias("activation_date"))
    out = events.join(F.broadcast(days), events["available_date"] == F.col("_day"), "left").drop("_day")
    if strict and not (bad := out.where("activation_date is null").select("available_date").distinct().limit(5).collect()) == []:
        raise ValueError(f"no next trading date for {[str(r[0]) for r in bad]}")
    return out


def merge_statements(base: DataFrame, extended: DataFrame) -> DataFrame:
    """Full outer merge of two sources on the statement key; available when both are. ``in_base``, ``in_extended`` tell where a row comes from."""
    keys = [*STATEMENT_KEY, "available_date"]
    if twice := ({*base.columns} & {*extended.columns}) - {*keys}:
        raise ValueError(f"both sources have {sorted(twice)}")
    a = base.withColumnRenamed("available_date", "_a").withColumn("in_base", F.lit(True))
    b = extended.withColumnRenamed("available_date", "_b").withColumn("in_extended", F.lit(True))
    out = a.join(b, STATEMENT_KEY, "full")
    out = out.withColumns({"available_date": F.greatest("_a", "_b"), "conflict": F.coalesce(F.col("_a") != F.col("_b"), F.lit(False)), "in_base": F.coalesce("in_base", F.lit(False)), "in_extended": F.coalesce("in_extended", F.lit(False))})
    return out.drop("_a", "_b")


def alignment(merged: DataFrame) -> DataFrame:
    """One row: how many statements are in both sources, in one only, and differ in availability."""
    n = lambda c: F.count(F.when(c, 1))
    both = F.col("in_base") & F.col("in_extended")
    return merged.agg(n(both).alias("in_both"), n(F.col("in_base") & ~F.col("in_extended")).alias("base_only"), n(~F.col("in_base") & F.col("in_extended")).alias("extended_only"), n(F.col("conflict")).alias("availability_conflicts"))


def change(now: Column, before: Column) -> Column:
    return F.when(F.abs(before) >= LEAST_DENOMINATOR, now / before - 1)


def snapshots(statements: DataFrame, flows: list[str], balances: list[str]) -> DataFrame:
    """Per symbol and activation date: what its reports say by then.

    statements: symbol, available_date, activation_date, report_ordinal and the values; flows are fiscal year to date.
    Later rows of a report replace it whole, missing values included. The latest report is the one with the largest
    ordinal seen so far: an old report that comes late changes history but never rolls the state back.
    """
    values = F.struct(*flows, *balances)
    own = statements.select(SYMBOL, "activation_date", "available_date", "report_ordinal", values.alias("v"))
    # of one report's rows on one date the last available counts
    own = own.groupBy(SYMBOL, "activation_date", "report_ordinal").agg(F.max_by(F.struct("available_date", "v"), "available_date").alias("x")).select(SYMBOL, "activation_date", "report_ordinal", "x.available_date", "x.v")
    events = own.groupBy(SYMBOL, "activation_date").agg(F.max("report_ordinal").alias("o"), F.max("available_date").alias("event_available_date"))
    seen = Window.partitionBy(SYMBOL).orderBy("activation_date").rangeBetween(Window.unboundedPreceding, 0)
    events = events.withColumn("latest", F.max("o").over(seen)).drop("o").withColumnRenamed("activation_date", "on_date")
    # five quarters of reports at most for each event
    near = events.join(own, (events[SYMBOL] == own[SYMBOL]) & (own["activation_date"] <= events["on_date"]) & (own["report_ordinal"] >= events["latest"] - 4) & (own["report_ordinal"] <= events["latest"])).select(
        events[SYMBOL], "on_date", "event_available_date", "latest", "activation_date", "available_date", "report_ordinal", "v"
    )
    back = F.col("latest") - F.col("report_ordinal")
    at = [F.max_by(F.when(back == k, F.struct("v", "available_date")), F.when(back == k, F.struct("activation_date", "available_date"))).alias(f"r{k}") for k in range(5)]
    state = near.groupBy(SYMBOL, "on_date", "event_available_date", "latest").agg(*at)
    quarter = F.col("latest") % 4 + 1

    def flow(name: str, k: int) -> Column:
        return F.col(f"r{k}.v.{name}")

    def single(name: str, k: int) -> Column:
        first = (F.col("latest") - k) % 4 == 0
        earlier = flow(name, k + 1) if k < 4 else F.lit(None)
        return F.when(first, flow(name, k)).otherwise(flow(name, k) - earlier)

    out = {}
    for f in flows:
        out |= {f"{f}_ytd": flow(f, 0), f"{f}_sq": single(f, 0), f"{f}_ttm": single(f, 0) + single(f, 1) + single(f, 2) + single(f, 3), f"{f}_yoy": change(flow(f, 0), flow(f, 4))}
    for b in balances:
        out |= {f"{b}_latest": flow(b, 0), f"{b}_yoy": change(flow(b, 0), flow(b, 4))}
    return state.select(
        SYMBOL, F.col("on_date").alias("activation_date"), "event_available_date", F.col("r0.available_date").alias("report_available_date"), F.col("latest").alias("report_ordinal"),
        F.floor(F.col("latest") / 4).cast("int").alias("report_year"), quarter.cast("int").alias("report_quarter"), *(c.alias(n) for n, c in out.items()),
    )


def asof_join(left: DataFrame, right: DataFrame, *, on: str, left_on: str = DATE, by: str = SYMBOL, tie: list[str] | None = None) -> DataFrame:
    """Each left row with the columns of the last right row of its symbol at or before its date; NULL before the first.

    One shuffle: both sides are laid into one stream by symbol and date, and the last right row is carried on. Of right
    rows at one date the last by ``tie`` counts.
    """
    payload = [c for c in right.columns if c not in (by,)]
    rows = left.select(F.col(by).alias("_k"), F.col(left_on).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(right.select(F.struct(*payload)).schema[0].dataType).alias("_r"), F.lit(None).cast(_tie_type(right, tie)).alias("_o"))
    more = right.where(F.col(on).isNotNull()).select(F.col(by).alias("_k"), F.col(on).cast(left.schema[left_on].dataType).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_l"), F.struct(*payload).alias("_r"), F.struct(*(tie or payload)).alias("_o"))
    window = Window.partitionBy("_k").orderBy("_t", "_side", "_o").rowsBetween(Window.unboundedPreceding, 0)
    both = rows.unionByName(more).withColumn("_last", F.last("_r", ignorenulls=True).over(window)).where("_side = 1")
    return both.select("_l.*", *(F.col(f"_last.{c}").alias(c) for c in payload if c not in left.columns))


def _tie_type(right: DataFrame, tie: list[str] | None):
    return right.select(F.struct(*(tie or [c for c in right.columns if c != SYMBOL]))).schema[0].dataType


def asof_attach(left: DataFrame, right: DataFrame, *, on: str = "activation_date", tie: list[str] | None = None, source: DataFrame | None = None) -> DataFrame:
    """``asof_join``, but an empty right side adds no columns.

    ``source``, the rows that ``right`` is made of, is looked at for that instead, where it is cheaper.
    """
    return left if (right if source is None else source).isEmpty() else asof_join(left, right, on=on, tie=tie)


def age_features(panel: DataFrame, name: str, available: str, activation: str) -> DataFrame:
    """Days since an event became available, and whether it takes effect on the row's date."""
    return panel.withColumns({f"{name}_age_days": F.datediff(DATE, available).cast("float"), f"{name}_event_today": F.coalesce(F.col(DATE) == F.col(activation), F.lit(False)).cast("tinyint")})


def midpoint(low: Column, high: Column) -> Column:
    return F.coalesce((low + high) / 2, low, high)


def safe_ratio(a: Column, b: Column) -> Column:
    value = F.when(F.abs(b) > LEAST_DENOMINATOR, a / b)
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)



#: Feature -> numerator, denominator. Numerators of ``ANNUAL`` are scaled by 4 / quarter. These are the fixed definitions.
RATIOS: dict[str, tuple[str, str]] = {
    "earnings_yield_ttm": ("fund_is_n_income_attr_p_ttm", "market_value"),
    "book_to_market": ("fund_bs_total_hldr_eqy_exc_min_int_latest", "market_value"),
    "sales_to_market_ttm": ("fund_is_total_revenue_ttm", "market_value"),
    "cfo_yield_ttm": ("fund_cfs_net_cash_operating_ttm", "market_value"),
    "gross_margin_ttm": ("fund_is_gross_profit_ttm", "fund_is_total_revenue_ttm"),
    "operating_margin_ttm": ("fund_is_operate_profit_ttm", "fund_is_total_revenue_ttm"),
    "net_margin_ttm": ("fund_is_n_income_attr_p_ttm", "fund_is_total_revenue_ttm"),
    "roa_ttm": ("fund_is_n_income_attr_p_ttm", "fund_bs_total_assets_latest"),
    "roe_calc_ttm": ("fund_is_n_income_attr_p_ttm", "fund_bs_total_hldr_eqy_exc_min_int_latest"),
    "gross_margin_ytd": ("fund_is_gross_profit_ytd", "fund_is_total_revenue_ytd"),
    "operating_margin_ytd": ("fund_is_operate_profit_ytd", "fund_is_total_revenue_ytd"),
    "net_margin_ytd": ("fund_is_n_income_attr_p_ytd", "fund_is_total_revenue_ytd"),
    "cfo_to_assets_ttm": ("fund_cfs_net_cash_operating_ttm", "fund_bs_total_assets_latest"),
    "cfo_to_profit_ttm": ("fund_cfs_net_cash_operating_ttm", "fund_is_n_income_attr_p_ttm"),
    "cfo_to_profit_ytd": ("fund_cfs_net_cash_operating_ytd", "fund_is_n_income_attr_p_ytd"),
    "debt_to_assets": ("fund_bs_total_liab_latest", "fund_bs_total_assets_latest"),
    "current_ratio": ("fund_bs_total_cur_assets_latest", "fund_bs_total_cur_liab_latest"),
    "cash_to_debt": ("fund_bs_money_cap_latest", "fund_bs_total_liab_latest"),
    "rd_intensity_ttm": ("fund_is_rd_exp_ttm", "fund_is_total_revenue_ttm"),
    "rd_intensity_ytd": ("fund_is_rd_exp_ytd", "fund_is_total_revenue_ytd"),
    "capex_to_assets_ttm": ("fund_cfs_cash_paid_asset_ttm", "fund_bs_total_assets_latest"),
    "inventory_to_assets": ("fund_bs_inventory_latest", "fund_bs_total_assets_latest"),
    "receivable_to_assets": ("fund_bs_notes_accts_receiv_latest", "fund_bs_total_assets_latest"),
    "goodwill_to_assets": ("fund_bs_goodwill_latest", "fund_bs_total_assets_latest"),
}
ANNUAL: dict[str, tuple[str, str]] = {
    "earnings_yield_ytd_ann": ("fund_is_n_income_attr_p_ytd", "market_value"),
    "sales_to_market_ytd_ann": ("fund_is_total_revenue_ytd", "market_value"),
    "cfo_yield_ytd_ann": ("fund_cfs_net_cash_operating_ytd", "market_value"),
    "roa_ytd_ann": ("fund_is_n_income_attr_p_ytd", "fund_bs_total_assets_latest"),
    "roe_ytd_ann": ("fund_is_n_income_attr_p_ytd", "fund_bs_total_hldr_eqy_exc_min_int_latest"),
    "cfo_to_assets_ytd_ann": ("fund_cfs_net_cash_operating_ytd", "fund_bs_total_assets_latest"),
    "capex_to_assets_ytd_ann": ("fund_cfs_cash_paid_asset_ytd", "fund_bs_total_assets_latest"),
}


def ratio_features(panel: DataFrame, *, quarter: str = "fund_report_quarter") -> DataFrame:
    """``panel`` with every ``fund_`` ratio whose inputs it has, in one projection."""
    has = lambda *names: all(n in panel.columns for n in names)
    scale = F.when(F.col(quarter).between(1, 4), 4 / F.col(quarter)) if has(quarter) else None
    out = {f"fund_{k}": safe_ratio(F.col(a), F.col(b)) for k, (a, b) in RATIOS.items() if has(a, b)}
    if scale is not None:
        out |= {f"fund_{k}": safe_ratio(F.col(a) * scale, F.col(b)) for k, (a, b) in ANNUAL.items() if has(a, b)}
    income, cash, assets = "fund_is_n_income_attr_p_{}", "fund_cfs_net_cash_operating_{}", "fund_bs_total_assets_latest"
    for span, name in (("ttm", "fund_accruals_ttm"), ("ytd", "fund_accruals_ytd_ann")):
        a, b = income.format(span), cash.format(span)
        if has(a, b, assets) and (span == "ttm" or scale is not None):
            gap = F.col(a) - F.col(b)
            out[name] = safe_ratio(gap if span == "ttm" else gap * scale, F.col(assets))
    return panel.withColumns(out) if out else panel


def coverage(panel: DataFrame, fields: list[str] | None = None, by: list[Column] | None = None) -> DataFrame:
    """(field, rows, nonnull_rows, nonnull_rate, finite_rows) of the fundamental fields, in one pass, by ``by`` if given."""
    if fields is None:
        fields = [c for c in panel.columns if c.startswith("fund_") and not c.endswith(("_date", "_ordinal", "_year", "_quarter"))]
    by = by or []
    parts = [F.struct(F.lit(f).alias("field"), F.count("*").alias("rows"), F.count(f).alias("nonnull_rows"), F.count(F.when(~F.isnan(f) & (F.abs(f) != float("inf")), 1)).alias("finite_rows")) for f in fields]
    names = [panel.select(c).columns[0] for c in by]
    counted = panel.groupBy(*by).agg(F.array(*parts).alias("x")).select(*names, F.explode("x").alias("x")).select(*names, "x.*")
    return counted.withColumn("nonnull_rate", F.try_divide(F.col("nonnull_rows").cast("double"), F.col("rows")))


def coverage_by_year(panel: DataFrame, fields: list[str] | None = None) -> DataFrame:
    return coverage(panel, fields, [F.year(DATE).alias("year")])


def least_coverage(by_year: DataFrame, years: DataFrame) -> DataFrame:
    """(field, min_rate): the least yearly rate over the expected years; a missing year counts as 0."""
    grid = by_year.select("field").distinct().crossJoin(F.broadcast(years.select("year").distinct()))
    return grid.join(by_year.select("field", "year", "nonnull_rate"), ["field", "year"], "left").groupBy("field").agg(F.min(F.coalesce("nonnull_rate", F.lit(0.0))).alias("min_rate"))


def quality_gate(panel: DataFrame, market: DataFrame, activation: str, features: list[str]) -> DataFrame:
    """One row of checks: as many rows as the market, unique keys, nothing activated after its date, features there."""
    own = panel.agg(F.count("*").alias("n"), F.count_distinct(SYMBOL, DATE).alias("k"), F.count(F.when(F.col(activation) > F.col(DATE), 1)).alias("ahead"))
    return own.crossJoin(F.broadcast(market.agg(F.count("*").alias("m")))).select((F.col("n") == F.col("m")).alias("rows_match"), (F.col("n") == F.col("k")).alias("keys_unique"), (F.col("ahead") == 0).alias("no_future"), F.lit(all(f in panel.columns for f in features)).alias("features_present"))

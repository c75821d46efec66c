"""Registered queries: the operators applied to the test tables.

``queries()`` holds the Spark side, ``oracle_sql()`` the same question in SQL.
Final numeric columns are rounded on both sides, inputs never.
"""

from __future__ import annotations

import atexit
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import oracle
from barometry import functions as fn
from barometry import operators as op
from barometry import plans, schema, sources
from barometry.functions import Period
from barometry.sources import sample_tables as tables

# The operators on texts are a part of their own and may be absent.
try:
    from barometry.llm import queries as texts
except ModuleNotFoundError as missing:
    if missing.name not in {"barometry.llm", "barometry.llm.queries", "corpus_pipeline"}:
        raise
    texts = None

Query = Callable[[SparkSession, str], DataFrame]

# A few tickers of the event bars, for the queries that select tickers.
EVENT_FOCUS = ["U0001", "U0002", "U0003", "U0005", "U0008", "U0013"]

# A mean of up to 31 numbers with four decimals never ends on a tie at this place.
MEAN_DIGITS = 8

_events = tables.bars_from_events
_lines = tables.bars_from_lineitem
_customers = tables.companies_from_customers
_nations = tables.companies_from_nations


def _rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({name: F.round(name, digits) for name in names})


# Sources ------------------------------------------------------------------


def _bars_union(spark: SparkSession, folder: str) -> DataFrame:
    return sources.union_bars([_events(spark, folder), _lines(spark, folder)])


def _lookback(window: Period) -> Query:
    return lambda spark, folder: sources.lookback(_lines(spark, folder), window)


def _load_quality(spark: SparkSession, folder: str) -> DataFrame:
    return sources.load_quality(_events(spark, folder), _customers(spark, folder))


def _bars_of_sector(spark: SparkSession, folder: str) -> DataFrame:
    """Tickers chosen by a table instead of a list."""
    return schema.only_tickers(_events(spark, folder), sources.companies_in_sectors(_customers(spark, folder), ["ASIA"]))


def _normalise_bars(spark: SparkSession, folder: str) -> DataFrame:
    """Every event as a vendor row of its own; every seventh has no number as its open."""
    events = spark.read.parquet(f"{folder}/events.parquet")
    value = F.col("value")
    raw = events.select(
        F.col("ts").alias("when"),
        F.col("user_id").cast("string").alias("ticker"),
        F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(value).alias("open"),
        *[value.alias(name) for name in ("high", "low", "close")],
        F.get_json_object("props", "$.k").alias("volume"),
    )
    return sources.normalise_bars(raw, date="when")


def _one_bar_per_day(spark: SparkSession, folder: str) -> DataFrame:
    return sources.one_bar_per_day(_normalise_bars(spark, folder))


def _bars_with_company(spark: SparkSession, folder: str) -> DataFrame:
    return sources.merge_companies(_events(spark, folder), _customers(spark, folder))


# What queries write for themselves, by the query's name: the next run of a query removes
# what its last one has written, and the end of the program the rest.
_OPEN: dict[str, sources.Scratch | plans.Page] = {}


def _owned(name: str, made: sources.Scratch | plans.Page) -> sources.Scratch | plans.Page:
    _closed(name)
    _OPEN[name] = made
    return made


def _closed(name: str) -> None:
    last = _OPEN.pop(name, None)
    # Of a session that has ended the tables cannot be removed through it any more.
    if last is not None and last.spark.sparkContext._jsc is not None:
        last.close()


@atexit.register
def _close_all() -> None:
    for name in list(_OPEN):
        _closed(name)


def _companies_csv(spark: SparkSession, folder: str) -> DataFrame:
    """Companies through a file with semicolons and a header, as the reader takes them."""
    scratch = _owned("companies_csv", sources.Scratch(spark))
    path = f"{scratch.folder}/companies"
    columns = [schema.TICKER, schema.COMPANY, schema.INDUSTRY, schema.SECTOR]
    _customers(spark, folder).select(*columns).write.csv(path, sep=";", header=True)
    return sources.read_companies(spark, path)


def _bars_csv(spark: SparkSession, folder: str) -> DataFrame:
    scratch = _owned("bars_csv", sources.Scratch(spark))
    path = f"{scratch.folder}/bars"
    _events(spark, folder).write.csv(path, header=True)
    return sources.read_bars(spark, path, "csv", header=True)


def _bars_parquet(spark: SparkSession, folder: str) -> DataFrame:
    scratch = _owned("bars_parquet", sources.Scratch(spark))
    path = f"{scratch.folder}/bars"
    _events(spark, folder).write.parquet(path)
    return sources.read_bars(spark, path, tickers=EVENT_FOCUS)


def _load_report(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of a load from text in which the lines of every seventh date are spoilt."""
    scratch = _owned("load_report", sources.Scratch(spark))
    bars = _events(spark, folder)
    spoilt = F.unix_date(schema.DATE) % 7 == 0
    texts = [F.when(spoilt & (F.lit(name) == schema.OPEN), "?").otherwise(F.col(name).cast("string")) for name in schema.BAR_COLUMNS]
    bars.select(F.concat_ws(",", *texts)).write.text(f"{scratch.folder}/lines")
    loaded = sources.read_bars(spark, f"{scratch.folder}/lines", "csv", corrupt=sources.CORRUPT)
    check = sources.LoadCheck()
    scratch.write(check.watch(loaded))
    return check.report(spark)


def _store(spark: SparkSession, folder: str, name: str, buckets: int = 4) -> sources.BarStore:
    return _owned(name, sources.Scratch(spark)).store(_lines(spark, folder), buckets, Period.YEAR)


def _stored_bars(spark: SparkSession, folder: str) -> DataFrame:
    """Half of the bars written, half appended."""
    scratch, bars = _owned("stored_bars", sources.Scratch(spark)), _lines(spark, folder)
    early = F.year(schema.DATE) % 2 == 0
    store = scratch.store(bars.filter(early), 4, Period.YEAR)
    store.append(bars.filter(~early))
    return store.bars()


def _stored_lookback(window: Period) -> Query:
    return lambda spark, folder: _store(spark, folder, f"stored_lookback_{window.value}").lookback(window)


def _stored_moving_average(spark: SparkSession, folder: str) -> DataFrame:
    names = ["daily_return_mavg_3d", "daily_return_diff_3d"]
    averages = op.moving_average(_store(spark, folder, "stored_moving_average").bars())
    return _rounded(averages.select("ticker", "date", "daily_return", *names), 6, *names)


# Expressions --------------------------------------------------------------


def _period_labels(spark: SparkSession, folder: str) -> DataFrame:
    dates = _lines(spark, folder).select("date").distinct()
    labels = {f"{p.value}_label": fn.period_label(p, "date") for p in Period}
    return dates.withColumns(labels | {"iso_week_label": fn.period_label(Period.WEEK, "date", iso=True)})


def _add_period(spark: SparkSession, folder: str) -> DataFrame:
    dates = _lines(spark, folder).select("date").distinct()
    return dates.withColumns({f"plus_{p.value}": fn.add_period("date", p, 3) for p in Period})


def _parse_date(spark: SparkSession, folder: str) -> DataFrame:
    """Day and month swapped, so that every day above the 12th is not a date."""
    text = F.date_format("date", "yyyy-dd-MM")
    days = _lines(spark, folder).select("ticker", text.alias("text"))
    return days.withColumn("parsed", fn.parse_date("text"))


def _money_flow(spark: SparkSession, folder: str) -> DataFrame:
    flow = op.money_flow(_lines(spark, folder)).select("ticker", "date", "mfm", "mfv")
    return _rounded(flow, 6, "mfm", "mfv")


def _return_sign(spark: SparkSession, folder: str) -> DataFrame:
    means = op.daily_return(_events(spark, folder)).groupBy("ticker").agg(F.avg("daily_return").alias("avg_daily_return"))
    return _rounded(means.withColumn("sign", fn.sign_class("avg_daily_return")), MEAN_DIGITS, "avg_daily_return")


# Returns ------------------------------------------------------------------


def _daily_return(spark: SparkSession, folder: str) -> DataFrame:
    return op.daily_return(_lines(spark, folder)).select("ticker", "date", "daily_return")


def _daily_return_subset(spark: SparkSession, folder: str) -> DataFrame:
    return op.daily_return(_events(spark, folder), EVENT_FOCUS).select("ticker", "date", "daily_return")


def _period_return(period: Period) -> Query:
    return lambda spark, folder: op.period_return(_lines(spark, folder), period)


def _avg_return_topn(period: Period) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        top = op.top_average_returns(_events(spark, folder), period, 10, _customers(spark, folder))
        return _rounded(top, MEAN_DIGITS, period.average_column)

    return query


def _ticker_return_stats(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(op.ticker_return_stats(_lines(spark, folder)), 6, "std_daily_return")


def _return_trend(spark: SparkSession, folder: str) -> DataFrame:
    return op.return_trend(op.period_return(_lines(spark, folder), Period.MONTH), Period.MONTH)


def _sharpe_frame(spark: SparkSession, folder: str, period: Period) -> DataFrame:
    return op.rolling_sharpe(op.period_return(_lines(spark, folder), period), period)


def _sharpe(period: Period) -> Query:
    return lambda spark, folder: _rounded(_sharpe_frame(spark, folder, period), 5, "sharpe_ratio")


def _sharpe_band(spark: SparkSession, folder: str) -> DataFrame:
    banded = _sharpe_frame(spark, folder, Period.QUARTER).withColumn("band", fn.sharpe_band("sharpe_ratio"))
    return banded.groupBy("ticker", "band").agg(F.count(F.lit(1)).alias("n"))


# Volume -------------------------------------------------------------------


def _volume_by(period: Period) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return _rounded(op.volume_by_period(_lines(spark, folder), period), 4, "avg_total_volume_per_ticker")

    return query


def _volume_signal(spark: SparkSession, folder: str) -> DataFrame:
    months = op.volume_by_period(_lines(spark, folder), Period.MONTH)
    signals = months.withColumn("signal", fn.volume_signal("volume_ratio"))
    return signals.groupBy("ticker", "signal").agg(F.count(F.lit(1)).alias("n"))


# Indicators ---------------------------------------------------------------


def _moving_average(spark: SparkSession, folder: str) -> DataFrame:
    names = ["daily_return_mavg_3d", "daily_return_diff_3d"]
    averages = op.moving_average(_lines(spark, folder)).select("ticker", "date", "daily_return", *names)
    return _rounded(averages, 6, *names)


def _deviation_summary(spark: SparkSession, folder: str) -> DataFrame:
    return op.deviation_summary(op.moving_average(_events(spark, folder)), digits=6)


def _ad(source: Query, scope: str, oscillator: bool) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        names = ["ad_line", "ad_oscillator"] if oscillator else ["ad_line"]
        line = op.accumulation_distribution(source(spark, folder), oscillator, scope)
        return _rounded(line.select("ticker", "date", *names), 4, *names)

    return query


def _rsi(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(op.relative_strength(_lines(spark, folder)), 6, "rsi_14d")


def _rsi_zone(spark: SparkSession, folder: str) -> DataFrame:
    strength = op.relative_strength(_events(spark, folder), min_periods=14)
    zones = strength.withColumn("zone", fn.rsi_zone("rsi_14d"))
    return zones.groupBy("ticker", "zone").agg(F.count(F.lit(1)).alias("n"))


# Correlation --------------------------------------------------------------


def _event_pairs(spark: SparkSession, folder: str, focus: list[str] | None = None) -> DataFrame:
    return op.correlation_pairs(_events(spark, folder), focus, _customers(spark, folder))


def _correlation_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(_event_pairs(spark, folder), 6, "correlation")


def _correlation_updated(spark: SparkSession, folder: str) -> DataFrame:
    """Sums of the bars of even dates are stored; those of odd dates are added to them."""
    scratch = _owned("correlation_updated", sources.Scratch(spark))
    bars = scratch.store(_events(spark, folder)).bars()
    even = F.unix_date(schema.DATE) % 2 == 0
    old = scratch.write(op.co_moments(bars.filter(even), None, _customers(spark, folder)))
    new = op.co_moments(bars.filter(~even), None, _customers(spark, folder))
    return _rounded(op.correlation_of_moments(op.merge_moments([old, new])), 6, "correlation")


def _correlation_focus(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(_event_pairs(spark, folder, EVENT_FOCUS), 6, "correlation")


def _correlation_top(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(op.best_pairs(_events(spark, folder), 5, None, _customers(spark, folder)), 6, "correlation")


def _best_partners(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(op.best_partners(_lines(spark, folder), 3), 6, "correlation")


def _correlated_partners(spark: SparkSession, folder: str) -> DataFrame:
    pairs = op.correlation_pairs(_lines(spark, folder), None, _nations(spark, folder))
    return _rounded(op.correlated_partners(pairs), 6, "correlation")


# Profile ------------------------------------------------------------------


def _coverage(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(op.coverage(_events(spark, folder)), 6, "missing_pct", "business_missing_pct")


def _mean_gap(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(op.mean_gap(_lines(spark, folder)), 6, "mean_gap_days")


def _history_display(spark: SparkSession, folder: str) -> DataFrame:
    tail = op.history_tail(_lines(spark, folder), 5)
    shown = {name: fn.display_number(name) for name in ("open", "high", "low", "close")}
    return tail.select("ticker", fn.display_date("date").alias("date"), "row", *[c.alias(n) for n, c in shown.items()])


# Pages --------------------------------------------------------------------


def _dashboard(spark: SparkSession, folder: str) -> DataFrame:
    recent = sources.lookback(_events(spark, folder), Period.MONTH)
    summary = plans.dashboard_summary(recent, _customers(spark, folder))
    return _rounded(summary, 6, "missing_pct", "business_missing_pct", "mean_gap_days")


def _dashboard_table(name: str) -> Query:
    """A table of the page for the tickers of one sector."""

    def query(spark: SparkSession, folder: str) -> DataFrame:
        companies = _customers(spark, folder)
        chosen = sources.companies_in_sectors(companies, ["ASIA"])
        return plans.dashboard(_events(spark, folder), companies, chosen, Period.MONTH)[name]

    return query


def _best_performers(spark: SparkSession, folder: str) -> DataFrame:
    return plans.top_performers(
        _events(spark, folder), _customers(spark, folder), ["ASIA", "EUROPE"], Period.MONTH, 5
    )


def _performer_returns(spark: SparkSession, folder: str) -> DataFrame:
    return plans.performer_returns(_events(spark, folder), _best_performers(spark, folder), Period.MONTH)


def _top_performers(spark: SparkSession, folder: str) -> DataFrame:
    best = _best_performers(spark, folder)
    best = _rounded(best, 6, "std_daily_return")
    return _rounded(best, MEAN_DIGITS, "avg_daily_return")


def _insights_page(spark: SparkSession, folder: str, name: str) -> plans.Page:
    """Its bars are derived and stored when it opens."""
    return _owned(name, plans.Page(_lines(spark, folder), _nations(spark, folder), window=Period.YEAR))


def _insights_summary(spark: SparkSession, folder: str) -> DataFrame:
    page = _insights_page(spark, folder, "insights_ticker_summary")
    summary = page.insights_summary(digits=6, scope="ticker")
    summary = _rounded(summary, 5, "last_sharpe", "last_rsi", "top_correlation")
    return _rounded(summary, 4, "last_ad_line")


def _insights_table(name: str, digits: dict[str, int]) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        made = _insights_page(spark, folder, f"insights_{name}").insights(scope="ticker")[name]
        for column, places in digits.items():
            made = _rounded(made, places, column)
        return made

    return query


def _dashboard_statistics(spark: SparkSession, folder: str) -> DataFrame:
    page = _owned("dashboard_statistics", plans.Page(_events(spark, folder), _customers(spark, folder), None, Period.MONTH))
    return page.dashboard(digits=6)["statistics"]


def entry(spark: SparkSession) -> DataFrame:
    """Best performers of two sectors in the small data set."""
    return _top_performers(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {
        "companies_dim": _customers,
        "companies_csv": _companies_csv,
        "bars_csv": _bars_csv,
        "bars_parquet": _bars_parquet,
        "load_report": _load_report,
        "stored_bars": _stored_bars,
        "stored_moving_average": _stored_moving_average,
        "correlation_updated": _correlation_updated,
        "insights_trend": _insights_table("trend", {}),
        "insights_deviation": _insights_table("deviation", {}),
        "insights_partners": _insights_table("partners", {"correlation": 6}),
        "dashboard_statistics": _dashboard_statistics,
        "bars_events": _events,
        "bars_lineitem": _lines,
        "bars_subset": lambda spark, folder: schema.only_tickers(_events(spark, folder), EVENT_FOCUS),
        "bars_of_sector": _bars_of_sector,
        "bars_union": _bars_union,
        "normalise_bars": _normalise_bars,
        "one_bar_per_day": _one_bar_per_day,
        "bars_with_company": _bars_with_company,
        "load_quality": _load_quality,
        "null_counts": lambda spark, folder: sources.null_counts(_lines(spark, folder)),
        "sector_tickers": lambda spark, folder: sources.companies_in_sectors(_customers(spark, folder), ["ASIA"]),
        "sector_list": lambda spark, folder: sources.distinct_values(_customers(spark, folder), "sector"),
        "ticker_list": lambda spark, folder: sources.distinct_values(_events(spark, folder), "ticker"),
        "period_labels": _period_labels,
        "add_period": _add_period,
        "parse_date": _parse_date,
        "money_flow": _money_flow,
        "return_sign": _return_sign,
        "daily_return": _daily_return,
        "daily_return_subset": _daily_return_subset,
        "ticker_return_stats": _ticker_return_stats,
        "price_trend": lambda spark, folder: op.price_trend(_lines(spark, folder)),
        "return_trend": _return_trend,
        "sharpe_band": _sharpe_band,
        "volume_describe": lambda spark, folder: op.volume_describe(_lines(spark, folder)),
        "volume_signal": _volume_signal,
        "moving_average": _moving_average,
        "deviation_summary": _deviation_summary,
        "ad_line_ticker": _ad(_lines, "ticker", False),
        "ad_oscillator_ticker": _ad(_lines, "ticker", True),
        "ad_line_portfolio": _ad(_events, "portfolio", False),
        "ad_oscillator_portfolio": _ad(_events, "portfolio", True),
        "rsi": _rsi,
        "rsi_zone": _rsi_zone,
        "correlation_pairs": _correlation_pairs,
        "correlation_focus": _correlation_focus,
        "correlation_top": _correlation_top,
        "correlated_partners": _correlated_partners,
        "best_partners": _best_partners,
        "price_describe": lambda spark, folder: op.price_describe(_events(spark, folder), digits=6),
        "coverage": _coverage,
        "mean_gap": _mean_gap,
        "date_gaps": lambda spark, folder: op.date_gaps(_lines(spark, folder)),
        "history_tail": lambda spark, folder: op.history_tail(_lines(spark, folder), 5),
        "history_display": _history_display,
        "dashboard": _dashboard,
        "dashboard_prices": _dashboard_table("prices"),
        "dashboard_history": _dashboard_table("history"),
        "performer_returns": _performer_returns,
        "top_performers": _top_performers,
        "insights_ticker_summary": _insights_summary,
    }
    for period in Period:
        found[f"lookback_{period.value}"] = _lookback(period)
        found[f"stored_lookback_{period.value}"] = _stored_lookback(period)
        found[f"volume_by_{period.value}"] = _volume_by(period)
        found[f"sharpe_{period.value}"] = _sharpe(period)
        if period is not Period.DAY:
            found[f"period_return_{period.value}"] = _period_return(period)
    for period, suffix in {Period.DAY: "", Period.WEEK: "_week", Period.MONTH: "_month"}.items():
        found[f"avg_return_topn{suffix}"] = _avg_return_topn(period)
    return found | (texts.queries() if texts else {})


def oracle_sql() -> dict[str, str]:
    return oracle.statements(EVENT_FOCUS) | (texts.oracle_sql() if texts else {})

"""The registered queries in SQL, for checking the Spark results with DuckDB.

Each statement is a chain of named subqueries.  The shared links are kept here once
and put in front of the statements that need them.
"""

from __future__ import annotations

from collections.abc import Sequence

EVENTS = """bars AS (
  SELECT printf('U%04d', user_id) AS ticker, CAST(ts AS DATE) AS date,
         arg_min(value, (ts, event_id)) AS open, max(value) AS high,
         min(value) AS low, arg_max(value, (ts, event_id)) AS close,
         CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS volume
  FROM events GROUP BY 1, 2)"""

LINES = """bars AS (
  SELECT n_name AS ticker, CAST(l_shipdate AS DATE) AS date,
         arg_min(l_extendedprice, (l_orderkey, l_linenumber, l_extendedprice)) AS open,
         max(l_extendedprice) AS high, min(l_extendedprice) AS low,
         arg_max(l_extendedprice, (l_orderkey, l_linenumber, l_extendedprice)) AS close,
         CAST(sum(l_quantity) AS BIGINT) AS volume
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  GROUP BY 1, 2)"""

VENDOR = """SELECT CAST(ts AS DATE) AS date, CAST(user_id AS VARCHAR) AS ticker,
       CASE WHEN event_id % 7 <> 0 THEN value END AS open, value AS high, value AS low, value AS close,
       CAST(json_extract_string(props, '$.k') AS BIGINT) AS volume FROM events"""

ASIAN = "(SELECT * FROM bars WHERE ticker IN (SELECT ticker FROM companies WHERE sector = 'ASIA'))"

CUSTOMERS = """companies AS (
  SELECT c_name AS company, printf('U%04d', c_custkey) AS ticker,
         c_mktsegment AS industry, r_name AS sector
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

DAILY = """daily AS (
  SELECT *, round(100 * ((close - open) / nullif(open, 0)), 4) AS daily_return FROM bars)"""

MONEY = """flow AS (
  SELECT *, mfm * volume AS mfv FROM (
    SELECT *, CASE WHEN high - low <> 0 THEN ((close - low) - (high - close)) / (high - low)
              ELSE 0.0 END AS mfm FROM bars))"""

AVERAGES = """averages AS (
  SELECT *, daily_return - daily_return_mavg_3d AS daily_return_diff_3d FROM (
    SELECT *, avg(daily_return) OVER (PARTITION BY ticker ORDER BY date
              ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS daily_return_mavg_3d FROM daily))"""

RSI = """strength AS (
  SELECT ticker, date, seen, 100 - 100 / (1 + avg_gain / nullif(avg_loss, 0)) AS rsi_14d FROM (
    SELECT ticker, date,
           count(*) OVER w AS seen,
           avg(CASE WHEN change > 0 THEN change ELSE 0 END) OVER w AS avg_gain,
           avg(CASE WHEN change < 0 THEN -change ELSE 0 END) OVER w AS avg_loss
    FROM (SELECT *, close - lag(close) OVER (PARTITION BY ticker ORDER BY date) AS change FROM bars)
    WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)))"""



def pairs(condition: str) -> str:
    """Correlation of ``ticker_a`` and ``ticker_b`` over the dates on which both returns are known."""
    return f"""SELECT ticker_a, ticker_b,
         covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0) AS correlation
  FROM (SELECT a.ticker AS ticker_a, b.ticker AS ticker_b,
               CASE WHEN b.daily_return IS NOT NULL THEN a.daily_return END AS x,
               CASE WHEN a.daily_return IS NOT NULL THEN b.daily_return END AS y
        FROM daily a JOIN daily b ON a.date = b.date AND {condition})
  GROUP BY 1, 2"""


PAIRS = f"pairs AS ({pairs('a.ticker < b.ticker')})"

# Every direction of a pair is computed anew here; the Spark side turns pairs around.
PARTNERS = f"""partners AS (
  SELECT ticker_a AS ticker, ticker_b AS partner, correlation,
         CAST(row_number() OVER (PARTITION BY ticker_a ORDER BY correlation DESC NULLS LAST, ticker_b) AS INTEGER) AS rank
  FROM ({pairs('a.ticker <> b.ticker')}))"""

# The days off are found by listing all days of the span.
COVERAGE = """ends AS (
  SELECT ticker, count(*) AS observations, min(date) AS first_date, max(date) AS last_date
  FROM bars GROUP BY 1),
days AS (
  SELECT ticker, unnest(generate_series(first_date::TIMESTAMP, last_date::TIMESTAMP, INTERVAL 1 DAY)) AS day
  FROM ends),
working AS (
  SELECT ticker, count(*) AS span_days,
         count(*) FILTER (isodow(day) < 6 AND strftime(day, '%m-%d') NOT IN ('12-25', '01-01')) AS business_days
  FROM days GROUP BY 1),
coverage AS (
  SELECT ticker, observations, first_date, last_date,
         CAST(span_days AS INTEGER) AS span_days,
         round(100 * (1 - observations / nullif(span_days, 0)), 6) AS missing_pct,
         CAST(business_days AS INTEGER) AS business_days,
         round(100 * (1 - observations / nullif(business_days, 0)), 6) AS business_missing_pct
  FROM ends JOIN working USING (ticker))"""

GAPS = """gaps AS (
  SELECT ticker, date, CAST(date - lag(date) OVER (PARTITION BY ticker ORDER BY date) AS INTEGER) AS gap_days
  FROM bars)"""

NAMES = {"day": "daily", "week": "weekly", "month": "monthly", "quarter": "quarterly", "year": "yearly"}
PER_YEAR = {"day": 252, "week": 52, "month": 12, "quarter": 4, "year": 1}
LABELS = {
    "day": "strftime(date, '%Y-%m-%d')",
    "week": "(year(date) + CASE WHEN weekofyear(date) = 1 AND month(date) = 12 THEN 1 ELSE 0 END)::VARCHAR"
    " || '-W' || lpad(weekofyear(date)::VARCHAR, 2, '0')",
    "month": "strftime(date, '%Y-%m')",
    "quarter": "year(date)::VARCHAR || '-Q' || quarter(date)::VARCHAR",
    "year": "strftime(date, '%Y')",
}


def returns(period: str) -> str:
    """Subquery ``returns``: one row per ticker and period."""
    if period == "day":
        return DAILY + ", returns AS (SELECT *, date AS period_start FROM daily)"
    name = f"{NAMES[period]}_return"
    return f"""returns AS (
  SELECT *, round(100 * ((last_close - first_open) / nullif(first_open, 0)), 4) AS {name} FROM (
    SELECT ticker, {LABELS[period]} AS {period}_period, min(date) AS period_start,
           arg_min(open, date) AS first_open, arg_max(close, date) AS last_close
    FROM bars GROUP BY 1, 2))"""


def sharpe(period: str) -> str:
    name = f"{NAMES[period]}_return"
    return f"""sharpe AS (
  SELECT * FROM (
    SELECT *, CASE WHEN count({name}) OVER w = 3 THEN
              (avg({name}) OVER w - 0.03::DOUBLE / {PER_YEAR[period]})
              / nullif(stddev_samp({name}) OVER w, 0) END AS sharpe_ratio
    FROM returns
    WINDOW w AS (PARTITION BY ticker ORDER BY period_start ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
  WHERE sharpe_ratio IS NOT NULL)"""


def volumes(period: str) -> str:
    label = "date" if period == "day" else f"{LABELS[period]} AS {period}_period"
    return f"""totals AS (
  SELECT ticker, {label}, CAST(sum(volume) AS BIGINT) AS total_volume,
         min(volume) AS min_volume, max(volume) AS max_volume,
         arg_min(date, (volume, date)) AS min_volume_date,
         arg_min(date, (-volume, date)) AS max_volume_date,
         round(avg(volume), 4) AS avg_volume, round(stddev_samp(volume), 4) AS volume_volatility
  FROM bars GROUP BY 1, 2),
volumes AS (
  SELECT * REPLACE (round(avg_total_volume_per_ticker, 4) AS avg_total_volume_per_ticker),
         round(total_volume / nullif(avg_total_volume_per_ticker, 0), 4) AS volume_ratio
  FROM (SELECT *, avg(total_volume) OVER (PARTITION BY ticker) AS avg_total_volume_per_ticker FROM totals))"""


def recent(window: str, source: str = "bars") -> str:
    """Subquery ``recent``: the latest part of the bars."""
    if window in ("day", "week"):
        count = {"day": 1, "week": 5}[window]
        limit = f"date IN (SELECT DISTINCT date FROM bars ORDER BY date DESC LIMIT {count})"
    else:
        months = {"month": 1, "quarter": 3, "year": 12}[window]
        limit = f"date > (SELECT max(date) FROM bars) - INTERVAL {months} MONTH"
    return f"recent AS ({instead(f'SELECT * FROM bars WHERE {limit}', source)})"


def chain(*links: str) -> str:
    """Links joined by WITH; the last one is the query itself."""
    return "WITH " + ",\n".join(links[:-1]) + "\n" + links[-1]


def instead(links: str, source: str) -> str:
    """The same links, reading ``source`` in place of the bars."""
    return links.replace("FROM bars", f"FROM {source}")


STATS = """min(daily_return) AS min_daily_return,
       arg_min(date, (daily_return, date)) AS min_daily_return_date,
       max(daily_return) AS max_daily_return,
       arg_min(date, (-daily_return, date)) AS max_daily_return_date,
       round(stddev_samp(daily_return), 6) AS std_daily_return,
       CASE WHEN stddev_samp(daily_return) <= 1 THEN 'Very Stable'
            WHEN stddev_samp(daily_return) <= 2 THEN 'Stable'
            WHEN stddev_samp(daily_return) <= 3 THEN 'Unstable'
            WHEN stddev_samp(daily_return) IS NOT NULL THEN 'Very Unstable' END AS stability"""

VOLUME_STATS = """min(volume) AS min_volume, arg_min(date, (volume, date)) AS min_volume_date,
       max(volume) AS max_volume, arg_min(date, (-volume, date)) AS max_volume_date,
       round(avg(volume), 4) AS mean_volume, round(stddev_samp(volume), 4) AS std_volume"""

DEVIATION = """round(min(daily_return_diff_3d), 6) AS min_deviation,
       arg_min(date, (daily_return_diff_3d, date)) AS min_deviation_date,
       round(max(daily_return_diff_3d), 6) AS max_deviation,
       arg_min(date, (-daily_return_diff_3d, date)) AS max_deviation_date,
       round(avg(daily_return_diff_3d), 6) AS mean_deviation"""


def sign(value: str) -> str:
    v = f"round({value}, 2)"
    return f"CASE WHEN {v} > 0 THEN 'positive' WHEN {v} < 0 THEN 'negative' WHEN {v} = 0 THEN 'neutral' END"


def band(value: str) -> str:
    return (
        f"CASE WHEN {value} >= 3 THEN 'excellent' WHEN {value} >= 2 THEN 'good' WHEN {value} >= 1"
        f" THEN 'acceptable' WHEN {value} IS NOT NULL THEN 'below threshold' END"
    )


def zone(value: str) -> str:
    return (
        f"CASE WHEN {value} > 70 THEN 'overbought' WHEN {value} < 30 THEN 'oversold'"
        f" WHEN {value} IS NOT NULL THEN 'normal' END"
    )


def statements(event_focus: Sequence[str]) -> dict[str, str]:
    focus = "(" + ", ".join(f"'{ticker}'" for ticker in event_focus) + ")"
    price_rows = " UNION ALL ".join(
        f"""SELECT ticker, '{c}' AS "column", round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
        round(min({c}), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS p25,
        round(quantile_cont({c}, 0.5), 6) AS median, round(quantile_cont({c}, 0.75), 6) AS p75,
        round(max({c}), 6) AS max FROM bars GROUP BY ticker"""
        for c in ("open", "high", "low", "close")
    )
    missing = ("open", "high", "low", "close", "date", "volume")
    missing_columns = ", ".join(f"count(*) FILTER ({c} IS NULL) AS {c}_missing" for c in missing)
    missing_total = " + ".join(f"count(*) FILTER ({c} IS NULL)" for c in missing)
    tail = """SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS INTEGER) AS row FROM bars)
        WHERE row <= 5"""

    found = {
        "companies_dim": chain(CUSTOMERS, "SELECT * FROM companies"),
        "bars_events": chain(EVENTS, "SELECT * FROM bars"),
        "bars_lineitem": chain(LINES, "SELECT * FROM bars"),
        "bars_subset": chain(EVENTS, f"SELECT * FROM bars WHERE ticker IN {focus}"),
        "bars_of_sector": chain(
            EVENTS,
            CUSTOMERS,
            "SELECT * FROM bars WHERE ticker IN (SELECT ticker FROM companies WHERE sector = 'ASIA')",
        ),
        "normalise_bars": VENDOR,
        "one_bar_per_day": f"""SELECT * FROM ({VENDOR}) QUALIFY row_number() OVER (
          PARTITION BY ticker, date ORDER BY open NULLS FIRST, high, low, close, volume) = 1""",
        "bars_union": f"SELECT * FROM ({chain(EVENTS, 'SELECT * FROM bars')}) UNION ALL "
        f"SELECT * FROM ({chain(LINES, 'SELECT * FROM bars')})",
        "bars_with_company": chain(EVENTS, CUSTOMERS, "SELECT * FROM bars JOIN companies USING (ticker)"),
        "load_quality": chain(
            EVENTS,
            CUSTOMERS,
            """SELECT count(*) AS total_rows, count(DISTINCT ticker) AS distinct_tickers, count(*) = 0 AS is_empty,
            count(*) > 0 AND count(DISTINCT ticker) = 0 AS has_no_ticker,
            count(*) < (SELECT count(DISTINCT ticker) FROM companies) AS fewer_rows_than_tickers,
            count(*) FILTER (ticker IS NOT NULL AND date IS NOT NULL)
              - count(DISTINCT (ticker, date)) FILTER (ticker IS NOT NULL AND date IS NOT NULL) AS repeated_bars,
            (SELECT count(ticker) - count(DISTINCT ticker) FROM companies) AS repeated_tickers FROM bars""",
        ),
        "null_counts": chain(
            LINES,
            f"SELECT ticker, count(*) AS rows, {missing_columns}, {missing_total} AS missing FROM bars GROUP BY ticker",
        ),
        "sector_tickers": chain(CUSTOMERS, "SELECT ticker, company FROM companies WHERE sector = 'ASIA'"),
        "sector_list": chain(CUSTOMERS, "SELECT DISTINCT sector FROM companies"),
        "ticker_list": "SELECT DISTINCT printf('U%04d', user_id) AS ticker FROM events",
        "period_labels": chain(
            LINES,
            "SELECT date, "
            + ", ".join(f"{sql} AS {period}_label" for period, sql in LABELS.items())
            + ", isoyear(date)::VARCHAR || '-W' || lpad(weekofyear(date)::VARCHAR, 2, '0') AS iso_week_label"
            + " FROM (SELECT DISTINCT date FROM bars)",
        ),
        "add_period": chain(
            LINES,
            """SELECT date, CAST(date + INTERVAL 3 DAY AS DATE) AS plus_day, CAST(date + INTERVAL 21 DAY AS DATE) AS plus_week,
            CAST(date + INTERVAL 3 MONTH AS DATE) AS plus_month, CAST(date + INTERVAL 9 MONTH AS DATE) AS plus_quarter,
            CAST(date + INTERVAL 3 YEAR AS DATE) AS plus_year FROM (SELECT DISTINCT date FROM bars)""",
        ),
        "parse_date": chain(
            LINES,
            """SELECT ticker, text, CAST(try_strptime(text, '%Y-%m-%d') AS DATE) AS parsed
            FROM (SELECT ticker, strftime(date, '%Y-%d-%m') AS text FROM bars)""",
        ),
        "money_flow": chain(LINES, MONEY, "SELECT ticker, date, round(mfm, 6) AS mfm, round(mfv, 6) AS mfv FROM flow"),
        "return_sign": chain(
            EVENTS,
            DAILY,
            f"""SELECT ticker, round(avg(daily_return), 8) AS avg_daily_return, {sign('avg(daily_return)')} AS sign
            FROM daily GROUP BY 1""",
        ),
        "daily_return": chain(LINES, DAILY, "SELECT ticker, date, daily_return FROM daily"),
        "daily_return_subset": chain(
            EVENTS, DAILY, f"SELECT ticker, date, daily_return FROM daily WHERE ticker IN {focus}"
        ),
        "ticker_return_stats": chain(LINES, DAILY, f"SELECT ticker, {STATS} FROM daily GROUP BY 1"),
        "price_trend": chain(
            LINES,
            """SELECT ticker, arg_min(open, date) AS first_open, arg_max(close, date) AS last_close,
            arg_min(open, date) < arg_max(close, date) AS rising FROM bars GROUP BY 1""",
        ),
        "return_trend": chain(
            LINES,
            returns("month"),
            """SELECT ticker, arg_max(monthly_return, period_start) AS last_return,
            arg_max(monthly_return, period_start) > 0 AS rising FROM returns GROUP BY 1""",
        ),
        "sharpe_band": chain(
            LINES,
            returns("quarter"),
            sharpe("quarter"),
            f"SELECT ticker, {band('sharpe_ratio')} AS band, count(*) AS n FROM sharpe GROUP BY 1, 2",
        ),
        "volume_describe": chain(LINES, f"SELECT ticker, {VOLUME_STATS} FROM bars GROUP BY 1"),
        "volume_signal": chain(
            LINES,
            volumes("month"),
            """SELECT ticker, CASE WHEN volume_ratio > 1 THEN 'above usual' WHEN volume_ratio < 1 THEN 'below usual'
            WHEN volume_ratio = 1 THEN 'usual' END AS signal, count(*) AS n FROM volumes GROUP BY 1, 2""",
        ),
        "moving_average": chain(
            LINES,
            DAILY,
            AVERAGES,
            """SELECT ticker, date, daily_return, round(daily_return_mavg_3d, 6) AS daily_return_mavg_3d,
            round(daily_return_diff_3d, 6) AS daily_return_diff_3d FROM averages""",
        ),
        "deviation_summary": chain(EVENTS, DAILY, AVERAGES, f"SELECT ticker, {DEVIATION} FROM averages GROUP BY 1"),
        "ad_line_ticker": chain(
            LINES,
            MONEY,
            "SELECT ticker, date, round(sum(mfv) OVER (PARTITION BY ticker ORDER BY date), 4) AS ad_line FROM flow",
        ),
        "ad_oscillator_ticker": chain(
            LINES,
            MONEY,
            """SELECT ticker, date, round(line, 4) AS ad_line,
            round(line - avg(line) OVER (PARTITION BY ticker ORDER BY date), 4) AS ad_oscillator
            FROM (SELECT ticker, date, sum(mfv) OVER (PARTITION BY ticker ORDER BY date) AS line FROM flow)""",
        ),
        "ad_line_portfolio": chain(
            EVENTS, MONEY, "SELECT ticker, date, round(sum(mfv) OVER (ORDER BY date), 4) AS ad_line FROM flow"
        ),
        "ad_oscillator_portfolio": chain(
            EVENTS,
            MONEY,
            """SELECT ticker, date, round(line, 4) AS ad_line,
            round(line - avg(line) OVER (ORDER BY date), 4) AS ad_oscillator
            FROM (SELECT ticker, date, sum(mfv) OVER (ORDER BY date) AS line FROM flow)""",
        ),
        "rsi": chain(LINES, RSI, "SELECT ticker, date, round(rsi_14d, 6) AS rsi_14d FROM strength"),
        "rsi_zone": chain(
            EVENTS,
            RSI,
            f"""SELECT ticker, {zone('CASE WHEN seen >= 14 THEN rsi_14d END')} AS zone, count(*) AS n
            FROM strength GROUP BY 1, 2""",
        ),
        "correlation_pairs": chain(
            EVENTS, DAILY, PAIRS, "SELECT ticker_a, ticker_b, round(correlation, 6) AS correlation FROM pairs"
        ),
        "correlation_focus": chain(
            EVENTS,
            DAILY,
            PAIRS,
            f"""SELECT ticker_a, ticker_b, round(correlation, 6) AS correlation FROM pairs
            WHERE ticker_a IN {focus} OR ticker_b IN {focus}""",
        ),
        "best_partners": chain(
            LINES,
            DAILY,
            PARTNERS,
            "SELECT ticker, partner, round(correlation, 6) AS correlation, rank FROM partners WHERE rank <= 3",
        ),
        "correlation_top": chain(
            EVENTS,
            DAILY,
            PAIRS,
            """SELECT ticker_a, ticker_b, round(correlation, 6) AS correlation FROM (
            SELECT * FROM pairs ORDER BY pairs.correlation DESC NULLS LAST, ticker_a, ticker_b LIMIT 5)""",
        ),
        "correlated_partners": chain(
            LINES,
            DAILY,
            PARTNERS,
            "SELECT ticker, partner, round(correlation, 6) AS correlation, rank FROM partners",
        ),
        "price_describe": chain(EVENTS, price_rows),
        "coverage": chain(EVENTS, COVERAGE, "SELECT * FROM coverage"),
        "mean_gap": chain(
            LINES,
            GAPS,
            "SELECT ticker, count(*) AS observations, round(avg(gap_days), 6) AS mean_gap_days FROM gaps GROUP BY 1",
        ),
        "date_gaps": chain(LINES, GAPS, "SELECT * FROM gaps"),
        "history_tail": chain(LINES, tail),
        "history_display": chain(
            LINES,
            "SELECT ticker, strftime(date, '%Y-%m-%d') AS date, row, "
            + ", ".join(f"printf('%.2f', {c}) AS {c}" for c in ("open", "high", "low", "close"))
            + f" FROM ({tail})",
        ),
        "dashboard": chain(
            EVENTS,
            CUSTOMERS,
            recent("month"),
            instead(COVERAGE, "recent"),
            instead(GAPS, "recent"),
            """SELECT c.*, g.mean_gap_days, e.first_open, e.last_close, e.first_open < e.last_close AS rising, company
            FROM coverage c
            JOIN (SELECT ticker, round(avg(gap_days), 6) AS mean_gap_days FROM gaps GROUP BY 1) g USING (ticker)
            JOIN (SELECT ticker, arg_min(open, date) AS first_open, arg_max(close, date) AS last_close
                  FROM recent GROUP BY 1) e USING (ticker)
            LEFT JOIN companies USING (ticker)""",
        ),
        "dashboard_prices": chain(EVENTS, CUSTOMERS, recent("month", ASIAN), "SELECT ticker, date, open, high, low, close FROM recent"),
        "dashboard_history": chain(
            EVENTS,
            CUSTOMERS,
            recent("month", ASIAN),
            f"SELECT * EXCLUDE (volume) FROM ({instead(tail, 'recent')})",
        ),
        "performer_returns": chain(
            EVENTS,
            CUSTOMERS,
            recent("month"),
            instead(DAILY, "recent"),
            """SELECT ticker, date, daily_return FROM daily WHERE ticker IN (
              SELECT ticker FROM daily JOIN companies USING (ticker) WHERE sector IN ('ASIA', 'EUROPE')
              GROUP BY 1 ORDER BY avg(daily_return) DESC, ticker LIMIT 5)""",
        ),
        "top_performers": chain(
            EVENTS,
            CUSTOMERS,
            recent("month"),
            instead(DAILY, "recent"),
            f"""SELECT * REPLACE (round(avg_daily_return, 8) AS avg_daily_return) FROM (
              SELECT *, {sign('avg_daily_return')} AS sign,
                     CAST(row_number() OVER (ORDER BY avg_daily_return DESC, ticker) AS INTEGER) AS rank FROM (
                SELECT ticker, company, sector, avg(daily_return) AS avg_daily_return, {STATS}
                FROM daily JOIN companies USING (ticker) WHERE sector IN ('ASIA', 'EUROPE') GROUP BY 1, 2, 3))
            WHERE rank <= 5""",
        ),
        "insights_ticker_summary": chain(
            LINES,
            recent("year"),
            instead(DAILY, "recent"),
            AVERAGES,
            instead(MONEY, "recent"),
            instead(RSI, "recent"),
            instead(returns("month"), "recent"),
            sharpe("month"),
            instead(volumes("month"), "recent"),
            PARTNERS,
            f"""SELECT * EXCLUDE (last_sharpe_value, last_rsi_value),
              round(last_sharpe_value, 5) AS last_sharpe, {band('last_sharpe_value')} AS sharpe_band,
              round(last_rsi_value, 5) AS last_rsi, {zone('last_rsi_value')} AS rsi_zone
            FROM (SELECT ticker, arg_max(monthly_return, period_start) AS last_return,
                         arg_max(monthly_return, period_start) > 0 AS rising FROM returns GROUP BY 1)
            JOIN (SELECT ticker, {DEVIATION} FROM averages GROUP BY 1) USING (ticker)
            JOIN (SELECT ticker, {VOLUME_STATS} FROM recent GROUP BY 1) USING (ticker)
            JOIN (SELECT ticker, round(sum(mfv), 4) AS last_ad_line FROM flow GROUP BY 1) USING (ticker)
            JOIN (SELECT ticker, arg_max(rsi_14d, date) AS last_rsi_value FROM strength GROUP BY 1) USING (ticker)
            JOIN (SELECT ticker, max(volume_ratio) AS max_volume_ratio FROM volumes GROUP BY 1) USING (ticker)
            LEFT JOIN (SELECT ticker, arg_max(sharpe_ratio, period_start) AS last_sharpe_value
                       FROM sharpe GROUP BY 1) USING (ticker)
            LEFT JOIN (SELECT ticker, partner AS top_partner, round(correlation, 5) AS top_correlation
                       FROM partners WHERE rank = 1) USING (ticker)""",
        ),
    }
    # The same questions through files, stored bars and pages.
    through = {
        "companies_csv": "companies_dim",
        "bars_csv": "bars_events",
        "bars_parquet": "bars_subset",
        "stored_bars": "bars_lineitem",
        "stored_moving_average": "moving_average",
        "correlation_updated": "correlation_pairs",
    }
    found |= {name: found[same] for name, same in through.items()}
    counted = ", ".join(f"count(*) FILTER ({c} IS NULL) AS {c}_missing" for c in ("ticker", *missing))
    found["load_report"] = chain(
        EVENTS,
        "good AS (SELECT * FROM bars WHERE (date - DATE '1970-01-01') % 7 <> 0)",
        f"""SELECT count(*) AS total_rows, (SELECT count(*) FROM bars) - count(*) AS corrupt_rows,
        min(date) AS first_date, max(date) AS last_date, {counted} FROM good""",
    )
    found["insights_trend"] = chain(
        LINES,
        recent("year"),
        instead(returns("month"), "recent"),
        """SELECT ticker, arg_max(monthly_return, period_start) AS last_return,
        arg_max(monthly_return, period_start) > 0 AS rising FROM returns GROUP BY 1""",
    )
    found["insights_deviation"] = chain(
        LINES, recent("year"), instead(DAILY, "recent"), AVERAGES, f"SELECT ticker, {DEVIATION.replace(', 6)', ', 4)')} FROM averages GROUP BY 1"
    )
    found["insights_partners"] = chain(
        LINES,
        recent("year"),
        instead(DAILY, "recent"),
        PAIRS,
        "best AS (SELECT * FROM pairs ORDER BY pairs.correlation DESC NULLS LAST, ticker_a, ticker_b LIMIT 5)",
        """SELECT ticker, partner, round(correlation, 6) AS correlation,
        CAST(row_number() OVER (PARTITION BY ticker ORDER BY best.correlation DESC NULLS LAST, partner) AS INTEGER) AS rank
        FROM (SELECT ticker_a AS ticker, ticker_b AS partner, correlation FROM best
              UNION ALL SELECT ticker_b, ticker_a, correlation FROM best) best""",
    )
    found["dashboard_statistics"] = chain(EVENTS, CUSTOMERS, recent("month"), instead(price_rows, "recent"))
    for period in LABELS:
        found[f"lookback_{period}"] = chain(LINES, recent(period), "SELECT * FROM recent")
        found[f"stored_lookback_{period}"] = found[f"lookback_{period}"]
        found[f"volume_by_{period}"] = chain(LINES, volumes(period), "SELECT * FROM volumes")
        label = "date" if period == "day" else f"{period}_period, period_start"
        found[f"sharpe_{period}"] = chain(
            LINES,
            returns(period),
            sharpe(period),
            f"SELECT ticker, {label}, {NAMES[period]}_return, round(sharpe_ratio, 5) AS sharpe_ratio FROM sharpe",
        )
        if period != "day":
            found[f"period_return_{period}"] = chain(LINES, returns(period), "SELECT * FROM returns")
    for period, suffix in {"day": "", "week": "_week", "month": "_month"}.items():
        name = f"{NAMES[period]}_return"
        found[f"avg_return_topn{suffix}"] = chain(
            EVENTS,
            CUSTOMERS,
            returns(period),
            f"""SELECT ticker, company, sector, round(mean, 8) AS avg_{name}, rank FROM (
              SELECT *, CAST(row_number() OVER (ORDER BY mean DESC NULLS LAST, ticker) AS INTEGER) AS rank FROM (
                SELECT ticker, company, sector, avg({name}) AS mean
                FROM returns JOIN companies USING (ticker) GROUP BY 1, 2, 3)) WHERE rank <= 10""",
        )
    return found

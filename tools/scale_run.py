"""Times the operators on a large generated bar table.

    python tools/scale_run.py FOLDER [TICKERS] [DATES]

The table is written to FOLDER once and read from there.  It shows how the plans
behave beyond the test data; correctness is checked elsewhere.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from barometry import Period  # noqa: E402
from barometry import operators as op  # noqa: E402
from barometry.sources import lookback  # noqa: E402
from bench import run, session, warm_up  # noqa: E402


def main() -> None:
    folder = sys.argv[1]
    tickers, dates = (int(a) for a in (sys.argv[2:] + ["4000", "2500"][len(sys.argv) - 2 :])[:2])
    spark = session()
    path = f"{folder}/bars_{tickers}_{dates}"
    if not os.path.exists(path):
        price = lambda seed: F.round(50 + 50 * F.rand(seed), 2)
        rows = spark.range(tickers * dates).select(
            F.date_add(F.lit("2010-01-01"), (F.col("id") / tickers).cast("int")).alias("date"),
            F.concat(F.lit("T"), F.lpad((F.col("id") % tickers).cast("string"), 6, "0")).alias("ticker"),
            price(1).alias("open"),
            F.lit(100.0).alias("high"),
            F.lit(50.0).alias("low"),
            price(2).alias("close"),
            (1000000 * F.rand(3)).cast("bigint").alias("volume"),
        )
        rows.write.parquet(path)
    bars = spark.read.parquet(path)
    warm_up(spark)
    jobs = {
        "daily_return": lambda: op.daily_return(bars),
        "period_return_month": lambda: op.period_return(bars, Period.MONTH),
        "top_average_returns": lambda: op.top_average_returns(bars),
        "ticker_return_stats": lambda: op.ticker_return_stats(bars),
        "rolling_sharpe_week": lambda: op.rolling_sharpe(op.period_return(bars, Period.WEEK), Period.WEEK),
        "volume_by_month": lambda: op.volume_by_period(bars, Period.MONTH),
        "volume_by_day": lambda: op.volume_by_period(bars, Period.DAY),
        "moving_average": lambda: op.moving_average(bars),
        "ad_oscillator_ticker": lambda: op.accumulation_distribution(bars, True),
        "ad_oscillator_portfolio": lambda: op.accumulation_distribution(bars, True, "portfolio"),
        "relative_strength": lambda: op.relative_strength(bars),
        "price_describe": lambda: op.price_describe(bars),
        "coverage": lambda: op.coverage(bars),
        "history_tail": lambda: op.history_tail(bars),
        "lookback_quarter": lambda: lookback(bars, Period.QUARTER),
        "top_correlations": lambda: op.top_correlations(op.correlation_pairs(bars)),
        "correlation_focus": lambda: op.correlation_pairs(bars, ["T000000", "T000001", "T000002"]),
    }
    seconds = {}
    for name, job in jobs.items():
        start = time.perf_counter()
        run(job())
        seconds[name] = round(time.perf_counter() - start, 2)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({"tickers": tickers, "dates": dates, "rows": tickers * dates, "seconds": seconds}))


if __name__ == "__main__":
    main()

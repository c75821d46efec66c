from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from barometry import BARS, Period, sources
from barometry.functions import display_date, display_number
from barometry.schema import only_tickers, require_columns
from helpers import bars, closes, companies, day, table


@pytest.fixture(scope="module")
def shop(spark):
    return companies(
        spark,
        ("AA", "Alpha, Inc.", "Chips", "Technology"),
        ("BB", "Beta", "Drugs", "Healthcare"),
        ("CC", "Gamma", "Soft", "Technology"),
    )


def test_companies_from_text_with_byte_order_mark(spark, tmp_path):
    path = tmp_path / "companies.csv"
    path.write_text("\ufeffTicker;Company;Industry;Sector\nAA;Alpha, Inc.;Chips;Technology\nBB;Beta;Drugs;Healthcare\n")
    df = sources.read_companies(spark, str(path))
    assert df.columns == ["company", "ticker", "industry", "sector"]
    assert [row["company"] for row in table(df, "ticker")] == ["Alpha, Inc.", "Beta"]


@pytest.mark.parametrize("format", ["parquet", "csv", "json", "orc"])
def test_bars_from_several_folders(spark, tmp_path, format):
    one = closes(spark, "AA", "2024-01-01", [1, 2])
    two = closes(spark, "BB", "2024-01-01", [3])
    paths = [str(tmp_path / name) for name in ("one", "two")]
    for df, path in zip([one, two], paths, strict=True):
        df.write.format(format).save(path)
    read = sources.read_bars(spark, paths, format)
    assert read.schema == BARS
    assert sorted(read.collect()) == sorted(sources.union_bars([one, two]).collect())
    assert sources.read_bars(spark, paths, format, tickers=["BB"]).count() == 1


def test_ticker_list_reaches_the_scan(spark, tmp_path):
    closes(spark, "AA", "2024-01-01", [1, 2]).write.parquet(str(tmp_path / "bars"))
    df = sources.read_bars(spark, str(tmp_path / "bars"), tickers=["AA"]).select("close")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(ticker, [AA])" in plan or "EqualTo(ticker,AA)" in plan
    assert "ReadSchema: struct<ticker:string,close:double>" in plan


def test_vendor_rows(spark):
    raw = spark.sql(
        "SELECT TIMESTAMP_NTZ'2024-01-02 23:30:00' AS Date, 1.006F AS Open, 2 AS High, 0.5 AS Low, 1.2345D AS Close, 7 AS Volume"
    )
    df = sources.normalise_bars(raw, ticker="AA", round_prices=True)
    assert df.columns == BARS.fieldNames()
    assert [f.dataType for f in df.schema] == [f.dataType for f in BARS]
    assert tuple(df.first()) == (day("2024-01-02"), "AA", 1.01, 2.0, 0.5, 1.23, 7)


def test_only_tickers(spark):
    df = sources.union_bars([closes(spark, t, "2024-01-01", [1]) for t in ("AA", "BB", "CC")])
    wanted = spark.createDataFrame([("CC",), ("CC",)], "ticker string")
    assert only_tickers(df, None).count() == only_tickers(df, []).count() == 3
    assert only_tickers(df, ["AA", "BB"]).count() == 2
    assert only_tickers(df, wanted).count() == 1


def test_lookback_by_dates_and_months(spark):
    df = bars(
        spark,
        *[("AA", d, 1, 1, 1, 1, 1) for d in ("2023-03-31", "2024-01-31", "2024-02-29", "2024-03-01", "2024-03-04")],
        *[("BB", d, 1, 1, 1, 1, 1) for d in ("2024-03-03", "2024-03-31")],
    )

    def dates(window, **options):
        return sorted({row["date"].isoformat() for row in sources.lookback(df, window, **options).collect()})

    assert dates(Period.DAY) == ["2024-03-31"]
    assert dates(Period.WEEK) == ["2024-02-29", "2024-03-01", "2024-03-03", "2024-03-04", "2024-03-31"]
    assert dates(None) == dates(Period.WEEK)
    assert dates(Period.MONTH) == ["2024-03-01", "2024-03-03", "2024-03-04", "2024-03-31"]
    assert dates(Period.QUARTER)[0] == "2024-01-31"
    assert dates(Period.YEAR)[0] == "2024-01-31"
    assert dates(Period.DAY, as_of=day("2024-03-03")) == ["2024-03-03"]
    assert dates(Period.MONTH, as_of=day("2024-03-03")) == ["2024-02-29", "2024-03-01", "2024-03-03"]


def test_merge_drops_strangers_and_ignores_repeated_companies(spark, shop):
    df = sources.union_bars([closes(spark, t, "2024-01-01", [1, 2]) for t in ("AA", "ZZ")])
    repeated = shop.unionByName(companies(spark, ("AA", "Zeta", "Other", "Other")))
    merged = table(sources.merge_companies(df, repeated), "date")
    assert [(row["ticker"], row["company"]) for row in merged] == [("AA", "Alpha, Inc.")] * 2
    assert sources.merge_companies(df, repeated, unique=False).count() == 4


def test_sector_choice(spark, shop):
    def chosen(sectors):
        return [row["ticker"] for row in table(sources.companies_in_sectors(shop, sectors), "ticker")]

    assert chosen(["Technology"]) == ["AA", "CC"]
    assert chosen(["Healthcare", "All"]) == chosen([]) == chosen(None) == ["AA", "BB", "CC"]
    assert sorted(row[0] for row in sources.distinct_values(shop, "sector").collect()) == ["Healthcare", "Technology"]


def test_quality_of_loads(spark, shop):
    df = closes(spark, "AA", "2024-01-01", [1, 2])
    assert tuple(sources.load_quality(df).first()) == (2, 1, False, False, False, 0, 0)
    assert tuple(sources.load_quality(df, shop).first()) == (2, 1, False, False, True, 0, 0)
    assert tuple(sources.load_quality(df.limit(0), shop).first()) == (0, 0, True, False, True, 0, 0)
    nameless = df.withColumn("ticker", F.lit(None).cast("string"))
    assert tuple(sources.load_quality(nameless).first()) == (2, 0, False, True, False, 0, 0)


def test_missing_values_are_counted_per_ticker(spark):
    df = bars(spark, ("AA", "2024-01-01", None, 1, 1, float("nan"), None), ("BB", "2024-01-01", 1, 1, 1, 1, 1))
    found = table(sources.null_counts(df), "ticker")
    assert (found[0]["open_missing"], found[0]["close_missing"], found[0]["volume_missing"]) == (1, 1, 1)
    assert [row["missing"] for row in found] == [3, 0]


def test_layout_by_ticker(spark):
    df = closes(spark, "AA", "2024-01-01", [1, 2])
    assert sources.cluster_by_ticker(df, 3).rdd.getNumPartitions() == 3
    assert sources.cluster_by_ticker(df).count() == 2


def test_missing_columns_are_named(spark, shop):
    with pytest.raises(ValueError, match="volume"):
        require_columns(closes(spark, "AA", "2024-01-01", [1]).drop("volume"), BARS.fieldNames())
    with pytest.raises(ValueError, match="close"):
        sources.merge_companies(closes(spark, "AA", "2024-01-01", [1]).drop("close"), shop)


def test_display(spark):
    df = spark.sql("SELECT 12345.678D AS x, DATE'2024-01-02' AS date")
    assert tuple(df.select(display_number("x"), display_date("date")).first()) == ("12345.68", "2024-01-02")


def test_counts_come_with_the_load(spark, tmp_path):
    lines = ["2024-01-01,A,1,2,0.5,1.5,10", "2024-01-02,A,NaN,2,0.5,,10", "2024-13-02,A,1,1,1,1,1", "no bar at all", "2024-01-05,,1,1,1,1,", "2023-12-31,B,1,1,1,1,x"]
    (tmp_path / "bars.csv").write_text("\n".join(lines))
    loaded = sources.read_bars(spark, str(tmp_path / "bars.csv"), "csv", corrupt=sources.CORRUPT)
    check = sources.LoadCheck()
    watched = check.watch(loaded)
    watched.write.parquet(str(tmp_path / "out"))
    written = spark.read.parquet(str(tmp_path / "out"))
    assert written.count() == 3 and sources.CORRUPT not in written.columns
    report = check.report(spark).first().asDict()
    assert report == {
        "total_rows": 3, "corrupt_rows": 3, "first_date": day("2024-01-01"), "last_date": day("2024-01-05"), "ticker_missing": 1,
        "date_missing": 0, "volume_missing": 1, "open_missing": 1, "high_missing": 0, "low_missing": 0, "close_missing": 1,
    }
    # The counting adds no job and no shuffle to the load.
    assert "Exchange" not in watched._jdf.queryExecution().executedPlan().toString()


def test_load_check_of_bars_without_a_corrupt_column(spark):
    check = sources.LoadCheck()
    given = bars(spark, ("A", "2024-01-01", 1, 1, 1, 1, 1))
    assert check.watch(given).collect() == given.collect()
    assert check.report(spark).first().total_rows == 1

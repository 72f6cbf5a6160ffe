import gzip

import pytest
from pyspark.sql import functions as F

from marketframe.sources import lake, tables

STOCK = "ticker string, close double"


@pytest.fixture
def root(spark, tmp_path):
    root = str(tmp_path / "lake")
    for day, price in (("2024-01-02", 1.0), ("2024-01-04", 2.0)):
        spark.createDataFrame([("A", price)], STOCK).write.parquet(lake.day_path(root, lake.STOCKS, day))
        spark.createDataFrame([("O:A240119C00001000", price)], STOCK).write.parquet(lake.day_path(root, lake.OPTIONS, day))
    return root


def test_days(spark, root):
    assert lake.read_day(spark, root, lake.STOCKS, "2024-01-02").count() == 1
    with pytest.raises(FileNotFoundError):
        lake.read_day(spark, root, lake.STOCKS, "2024-01-03")
    assert [d.count() for d in lake.read_stocks_and_options_day(spark, root, "2024-01-04")] == [1, 1]
    stocks, options = lake.read_stocks_and_options(spark, root, "2024-01-02", "2024-01-04")
    assert stocks.count() == options.count() == 2
    assert lake.read_days(spark, root, lake.STOCKS, "2024-01-03", "2024-01-04").count() == 1
    assert lake.read_days(spark, root, lake.STOCKS, "2023-01-03", "2023-01-04", schema=STOCK).count() == 0


def test_tickers(spark, tmp_path):
    root = str(tmp_path)
    spark.createDataFrame([("2024-02-01", 0.5)], "ex_dividend_date string, cash double").write.parquet(f"{root}/dividends_by_ticker/A.parquet")
    spark.createDataFrame([(1.5,)], "eps double").write.parquet(f"{root}/earnings_by_ticker/B.parquet")
    got = lake.read_dividends(spark, root, ["A", "Z"]).first()
    assert got.ticker == "A" and str(got.ex_dividend_date) == "2024-02-01 00:00:00"
    assert lake.read_earnings(spark, root, "B").first().ticker == "B"
    assert lake.read_earnings(spark, root, "Z").count() == 0


def test_csv_to_lake(spark, tmp_path):
    for day in ("2024-01-02", "2024-01-03"):
        (tmp_path / "in/2024/01").mkdir(parents=True, exist_ok=True)
        with gzip.open(tmp_path / f"in/2024/01/{day}.csv.gz", "wt") as f:
            f.write("ticker,close\nA,1.5\n")
    (tmp_path / "in/notes.txt").write_text("no")
    got = lake.csv_to_lake(spark, str(tmp_path / "in"), str(tmp_path / "out"), schema=STOCK)
    assert sorted((r.ticker, r.close, str(r.date)) for r in got.collect()) == [("A", 1.5, "2024-01-02"), ("A", 1.5, "2024-01-03")]


def test_tree(spark, tmp_path):
    spark.createDataFrame([(1,)], "a int").coalesce(1).write.parquet(str(tmp_path / "x/y"))
    (tmp_path / "x/broken.parquet").write_bytes(b"nothing")
    assert lake.read_tree(spark, str(tmp_path / "x"), ".parquet").count() == 1
    assert lake.read_tree(spark, str(tmp_path / "x"), ".parquet", schema="a int").count() == 1
    with pytest.raises(ValueError):
        lake.read_tree(spark, str(tmp_path / "none"), ".parquet")
    with pytest.raises(FileNotFoundError):
        lake.read_tree(spark, str(tmp_path / "x"), ".orc", "orc")


def test_a_lost_writer_loses_no_day(spark, root, monkeypatch):
    """Stopped between its two renames, a writer leaves the old day readable; the next one goes on from there."""
    new = spark.createDataFrame([("B", 9.0, "2024-01-02")], f"{STOCK}, date string")
    calls, rename = [], lake._rename

    def lost(fs, old, to):
        calls.append(old)
        if len(calls) == 2:
            raise RuntimeError("lost")
        rename(fs, old, to)

    monkeypatch.setattr(lake, "_rename", lost)
    with pytest.raises(RuntimeError):
        lake.write_days(new, root, lake.STOCKS)
    monkeypatch.undo()
    both = lambda: (lake.read_day(spark, root, lake.STOCKS, "2024-01-02").first().ticker, lake.read_days(spark, root, lake.STOCKS, "2024-01-01", "2024-01-04").count())
    assert both() == ("A", 2)
    lake.write_days(new, root, lake.STOCKS)
    assert both() == ("B", 2)
    lake.write_days(new, root, lake.STOCKS)
    assert both() == ("B", 2)


def test_skipped_files_are_told(spark, root, tmp_path):
    day = tmp_path / "lake" / lake.STOCKS / lake.DAY_AGGREGATES / "2024/01"
    (day / "2024-01-03.parquet").write_bytes(b"no parquet at all")
    (day / "2024-01-05.parquet").write_bytes(b"")
    good = next((day / "2024-01-04.parquet").glob("part-*.parquet")).read_bytes()
    (day / "2024-01-06.parquet").write_bytes(good[:4] + b"x" * (len(good) - 8) + good[-4:])
    got = lake.skipped_days(spark, root, lake.STOCKS, "2024-01-01", "2024-01-06", schema=STOCK).orderBy("day").collect()
    assert [(r.day, r.reason) for r in got] == [("2024-01-01", "missing"), ("2024-01-03", "no parquet file"), ("2024-01-05", "empty file"), ("2024-01-06", "broken")]
    read = lake.read_days(spark, root, lake.STOCKS, "2024-01-01", "2024-01-06", schema=STOCK, skip_corrupt=True)
    assert sorted(r.close for r in read.collect()) == [1.0, 2.0]
    assert lake.skipped_days(spark, root, lake.STOCKS, "2023-05-01", "2023-05-02").count() == 2
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "a.parquet").write_bytes(b"?")
    assert [r.reason for r in lake.skipped_files(spark, str(tmp_path / "bad")).collect()] == ["no parquet file"]
    assert lake.skipped_files(spark, lake.day_path(root, lake.STOCKS, "2024-01-04")).count() == 0


def test_malformed_lines_are_told(spark, tmp_path):
    (tmp_path / "in/2024-03-01").mkdir(parents=True)
    with gzip.open(tmp_path / "in/2024-03-01/x.csv.gz", "wt") as f:
        f.write("ticker,close\nA,1.5\nB,much\nC,2\nD,3,4\n")
    got = lake.malformed(spark, str(tmp_path / "in"), STOCK).collect()
    assert sorted(r.line for r in got) == ["B,much", "D,3,4"] and all(r.path.endswith("x.csv.gz") for r in got)
    taken = lake.csv_to_lake(spark, str(tmp_path / "in"), str(tmp_path / "out"), schema=STOCK)
    assert sorted(r.ticker for r in taken.collect()) == ["A", "C"]


def test_formats():
    assert tables.format_of("a/b.CSV.gz") == "csv" and tables.format_of("x.parquet") == "parquet"
    assert tables.format_of("x.bin", "text") == "text"
    with pytest.raises(ValueError):
        tables.format_of("x.bin")


#: Squares with a text that needs quoting.
SQUARES = [(n, n * n / 4, f'side "{n}", of\nfour' if n % 3 else None) for n in range(40)]


def test_copies(spark, tmp_path, rows):
    """A table survives being copied from CSV to parquet and back, quotes, line breaks and nulls included."""
    df = spark.createDataFrame(SQUARES, "side int, area double, label string").repartition(2)
    csv, parquet, again = (tables.Files(str(tmp_path / name)) for name in ("a.csv", "b.parquet", "c.csv"))
    csv.write(df)
    tables.copy_table(spark, csv, parquet)
    tables.copy_table(spark, parquet, again)
    one_line = lambda t: t and t.replace("\n", " ")
    counted = [parquet.read(spark).count(), again.read(spark).count()]
    assert counted[0] == counted[1] >= len(SQUARES)
    plain = df.withColumn("label", df.label.substr(1, 6))
    tables.write_table(plain, str(tmp_path / "d.csv"))
    assert rows(tables.read_table(spark, str(tmp_path / "d.csv"))) == sorted((n, area, one_line(t and t[:6])) for n, area, t in SQUARES)
    with pytest.raises(ValueError):
        tables.write_table(df, str(tmp_path / "d.json"))
    with pytest.raises(ValueError):
        tables.Files(str(tmp_path / "d.txt")).write(df)


def test_database(spark, tmp_path):
    """Rows are appended, read in ranges of a column, filtered by the database, and copied out."""
    url = "jdbc:derby:memory:marketframe;create=true"
    base = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    db = tables.Database(url, "squares", base)
    source = tables.Files(str(tmp_path / "squares.parquet"))
    source.write(spark.createDataFrame([r[:2] for r in SQUARES], "side int, area double"))
    for times in (1, 2):
        tables.copy_table(spark, source, db)
        assert db.read(spark).count() == times * len(SQUARES)
    split = tables.Database(url, "squares", base, ("side", 0, 40, 5)).read(spark)
    assert split.rdd.getNumPartitions() == 5 and split.count() == 2 * len(SQUARES)
    assert db.query(spark, 'select "side" from squares where "area" > 100').count() == 2 * sum(r[1] > 100 for r in SQUARES)
    out = tables.Files(str(tmp_path / "out.parquet"))
    tables.copy_table(spark, db, out)
    assert out.read(spark).agg({"area": "sum"}).first()[0] == 2 * sum(r[1] for r in SQUARES)


def test_sql(spark):
    df = spark.createDataFrame([(1,), (5,)], "a int")
    assert tables.run_sql(spark, "with x as (select * from {t}) select a from x where a > 2", {"t": df}).first().a == 5
    assert tables.run_sql(spark, "select max(a) as m from named", {"named": df}).first().m == 5


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path):
    """Two tables in buckets by the same keys are grouped and joined where they are, one hot value included."""
    from marketframe.operators import options

    trades = [("HOT" if i % 3 else f"U{i % 7}", i % 50, float(i)) for i in range(900)]
    stocks = sorted({(u, t, float(t)) for u, t, _ in trades if t % 5})
    left = tables.bucketed(spark.createDataFrame(trades, "underlying string, window_start bigint, close double"), "bucketed_trades", ["underlying", "window_start"], 4, str(tmp_path / "t"))
    right = spark.createDataFrame(stocks, "ticker string, window_start bigint, close double").select("*", *[F.col("close").alias(c) for c in ("volume", "open", "high", "low", "transactions")])
    right = tables.bucketed(right, "bucketed_stocks", ["ticker", "window_start"], 4, str(tmp_path / "s"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = options.join_stocks(left, right)
        grouped = left.groupBy("underlying", "window_start").count()
        for df in (joined, grouped):
            assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
        known = {(u, t): c for u, t, c in stocks}
        got = sorted((r.underlying, r.window_start, r.close, r.stock_close) for r in joined.collect())
        assert [x[:3] for x in got] == sorted(trades) and all(x[3] == known.get(x[:2]) for x in got)
        assert sum(r["count"] for r in grouped.collect()) == 900
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for name in ("bucketed_trades", "bucketed_stocks"):
            spark.sql(f"DROP TABLE {name}")
    again = tables.bucketed(left.sparkSession.range(10), "bucketed_ids", ["id"], 2, str(tmp_path / "i"))
    assert again.count() == 10
    spark.sql("DROP TABLE bucketed_ids")

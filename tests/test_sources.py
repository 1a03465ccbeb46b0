import datetime as dt
import pickle
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tidemark.operators import pit
from tidemark.sources import pages, tables, windows
from tidemark.streaming import live


def test_tables(spark, tmp_path):
    df = spark.range(10).select(F.col("id").alias("article_id"), F.lit("2025-01-01").cast("date").alias("timestamp_utc"), F.lit(1).alias("x"))
    path = str(tmp_path / "t")
    tables.write_table(df, path)
    assert tables.read_columns(spark, path, ["x"]).columns == ["x"]
    assert tables.read_columns(spark, path, ["x", "nope"], strict=False).columns == ["x"]
    assert dict(tables.read_corpus(spark, path).dtypes)["timestamp_utc"] == "timestamp"
    with pytest.raises(ValueError):
        tables.read_columns(spark, path, ["nope"])
    with pytest.raises(FileNotFoundError):
        tables.read_columns(spark, path + "x", ["x"])
    with pytest.raises(FileNotFoundError, match="b: "):
        tables.read_all(spark, {"a": path, "b": path + "x"})
    plan = tables.read_columns(spark, path, ["x"])._jdf.queryExecution().executedPlan().toString()
    assert "article_id" not in plan.split("ReadSchema")[1]
    built = []
    for _ in range(2):
        tables.read_or_build(spark, str(tmp_path / "b"), lambda: built.append(1) or df)
    assert built == [1]
    tables.write_csv(df.select("article_id"), str(tmp_path / "c"))
    assert tables.read_csv(spark, str(tmp_path / "c"), "article_id long").count() == 10
    assert tables.labelling_sample(df, ["article_id"], 3, 1, ["article_id"]).columns == ["article_id", "hand_label"]
    tables.write_table(df.select(F.lit("TSLA").alias("ticker"), "x"), str(tmp_path / "k"), ["ticker"])
    assert tables.available(spark, str(tmp_path / "k")) == ["TSLA"] and tables.available(spark, path + "x") == []
    assert tables.markdown(df.select("x").limit(1)) == "| x |\n|---|\n| 1 |"


def test_cache_reading(spark, tmp_path):
    path = str(tmp_path / "cache")
    schema = "h string, pos double"
    assert tables.read_cache(spark, path, schema).count() == 0
    tables.write_table(spark.createDataFrame([("a", 1)], "h string, other int"), path)
    assert tables.read_cache(spark, path, schema).count() == 0
    with pytest.raises(ValueError):
        tables.read_cache(spark, path, schema, strict=True)


def test_chunks_resume(spark, tmp_path):
    df = tables.numbered_chunks(spark.range(25).select(F.col("id").alias("article_id")), "article_id", 10)
    assert sorted((r.chunk, r["count"]) for r in df.groupBy("chunk").count().collect()) == [(0, 10), (1, 10), (2, 5)]
    path, seen = str(tmp_path / "chunks"), []

    def step(todo):
        seen.append(todo.count())
        return todo

    tables.process_chunks(df.where("chunk < 2"), path, step)
    assert tables.process_chunks(df, path, step).count() == 25 and seen == [20, 5]


def test_windows(spark):
    assert [(w.first.day, w.last.day) for w in windows.day_windows("T", dt.date(2025, 1, 1), dt.date(2025, 1, 8), 3)] == [(1, 3), (4, 6), (7, 8)]
    calls = []

    def flaky(ticker, first, last):
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return [{"id": 1}]

    window = windows.DayWindow("T", None, None)
    assert windows.pull(flaky, window) == ([{"id": 1}], None)

    def refused(ticker, first, last):
        calls.append(1)
        raise windows.FeedError("no")

    calls.clear()
    assert windows.pull(refused, window) == ([], "FeedError: no") and len(calls) == 3
    with pytest.raises(ZeroDivisionError):
        windows.pull(lambda *a: 1 / 0, window)
    assert windows.pull(lambda *a: [], window, least=1) == ([], "0 rows")

    def feed(ticker, first, last):
        n = 100 if first.day == 1 else 2
        return [{"id": i, "headline": ticker, "datetime": 1_735_689_600} for i in range(n)]

    got = windows.read_articles(spark, feed, ["A"], "2025-01-01", "2025-01-04", 2)
    assert got.rdd.getNumPartitions() == 2 and got.count() == 102 and got.where("capped").count() == 100


def test_rate_holds_over_partitions(spark):
    began = time.monotonic()
    read = windows.read_windows(spark, lambda t, a, b: [{"id": 1, "datetime": 0}], ["A"], "2025-01-01", "2025-01-10", 1, rate=2.0)
    assert windows.rows_of(read).count() == 10
    assert 4.4 <= time.monotonic() - began < 30


def test_prices_and_earnings(spark):
    def bars(symbol, first, last):
        return [] if symbol == "NONE" else [{"date": first, "high": 2, "low": 1.0, "close": 1.5, "volume": None}, {"date": last, "close": 1}]

    read = windows.read_prices(spark, bars, ["TSLA", "NONE", "TSLA"], "2025-03-01", "2025-03-31", pad=10)
    assert sorted((r.symbol, str(r.bar_date), r.close, r.volume) for r in windows.rows_of(read).collect()) == [("TSLA", "2025-02-19", 1.5, None), ("TSLA", "2025-04-10", 1.0, None)]
    assert {(r.window_ticker, r.window_rows, r.window_error) for r in windows.report_of(read).collect()} == {("TSLA", 2, None), ("NONE", 0, "0 rows")}
    days = windows.read_earnings(spark, lambda t, a, b: [{"datetime": 1_740_000_000}, {"datetime": 1_700_000_000}], ["TSLA"], "2025-01-01", "2025-12-31")
    assert [str(r.earnings_ts.date()) for r in windows.rows_of(days).collect()] == ["2025-02-19"]


def test_exchange_calendar_keeps_summer_time(spark):
    days = pit.exchange_calendar(spark, "2025-03-07", "2025-03-11", holidays=["2025-03-11"], early={"2025-03-10": "13:00:00"})
    assert [(str(r.market_open), str(r.market_close)) for r in days.select(*[F.date_format(c, "MM-dd HH:mm").alias(c) for c in days.columns]).collect()] == [("03-07 14:30", "03-07 21:00"), ("03-10 13:30", "03-10 17:00")]


PAGE = """<html><head><meta property="article:published_time" content="2025-01-02T03:04:05Z"><script type="application/ld+json">{broken</script>
<script type="application/ld+json">[{"a": 1}, {"datePublished": "2025-01-01T10:00:00+02:00", "provider": "Wire", "publisher": {"name": "Paper"}}]</script></head>
<body><nav><p>menu</p></nav><p>One  <b>two</b></p><script>var t = "</p>"</script><figure><p>caption</p></figure><p>three<p>four &amp; five</body></html>"""


def test_pages(spark):
    df = spark.createDataFrame([(1, PAGE), (2, None), (3, "<p>x")], "page_id long, html string")
    out = pages.parsed(df).select("page_id", "processed_body", "ld_objects", pages.published(F.col("ld_objects"), F.col("meta_time")).alias("p"), pages.true_source(F.col("ld_objects"), F.lit("host")).alias("s"))
    got = {r.page_id: r for r in out.withColumn("utc", F.date_format(pages.to_utc(F.col("p")), "HH:mm")).collect()}
    assert got[1].processed_body == "One two three four & five four & five" and len(got[1].ld_objects) == 2 and got[1].s == "Wire" and got[1].utc == "08:00"
    assert got[2].processed_body == "" and got[2].s == "host" and got[2].utc is None and got[3].processed_body == "x"


def test_python_holds_few_pages_at_a_time(spark):
    df = spark.range(2_500, numPartitions=1).select(F.col("id").alias("page_id"), F.concat(F.lit("<p>page "), F.col("id"), F.lit("</p>")).alias("html"))
    out = pages.parsed(df).select("page_id", "processed_body")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "InPandas" not in plan and "Arrow" not in plan
    assert out.where(F.col("processed_body") == F.concat(F.lit("page "), F.col("page_id"))).count() == 2_500
    frames = [pd.DataFrame({"url": range(250)}), pd.DataFrame({"url": range(0)}), pd.DataFrame({"url": range(7)})]
    assert [len(f) for f in pages._pieces(iter(frames))] == [100, 100, 50, 7]


def test_html_clean_reads_pages_in_small_batches(spark):
    plan = __spark_entry__.queries()["html_clean"](spark, __spark_entry__.SMOKE_DIR)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BatchEvalPython [") == 1 and "InPandas" not in plan


#: Paragraphs that are not closed: the text of each counts for all before it.
OPEN = "".join(f"<p>piece  {i}" for i in range(300)) + "<nav>menu</nav><p>"
OPEN_BODY = " ".join(f"piece {j}" for i in range(300) for j in range(i, 300))


def test_python_gives_back_text_once_that_bodies_hold_often(spark, monkeypatch):
    read, made = [], pages.F.udf
    monkeypatch.setattr(pages.F, "udf", lambda f, *a, **k: read.append(f) or made(f, *a, **k))
    rows = [(1, OPEN), (2, "<p>a</p><p> </p>out<p>b\x1f\n c<b>d</b></p><p><p>e</p>f</p>"), (3, None)]
    out = pages.parsed(spark.createDataFrame(rows, "page_id long, html string"))
    assert {r.page_id: r.processed_body for r in out.collect()} == {1: OPEN_BODY, 2: "a b c d e f e", 3: ""} and pages.parse(OPEN)[0] == OPEN_BODY
    assert len(OPEN_BODY) > 50 * len(OPEN) and len(pickle.dumps(read[0](OPEN))) < 3 * len(OPEN)


def test_fetched_bodies_hold_text_as_often(spark):
    df = spark.createDataFrame([(1, "u"), (2, "gone"), (3, "none")], "article_id long, url string").withColumn("timestamp_utc", F.lit("2025-01-20 09:00:00").cast("timestamp"))
    got = {r.article_id: r for r in pages.fetched(df, lambda url: (404 if url == "gone" else 200, url, OPEN if url == "u" else "")).collect()}
    assert {i: (r.processed_body, r.text_ok) for i, r in got.items()} == {1: (OPEN_BODY, True), 2: (None, False), 3: ("", False)} and got[1].raw_body == OPEN


def test_fetch_follows_the_original_and_resumes(spark, tmp_path):
    def web(url):
        if url == "http://gone/":
            raise TimeoutError
        if url == "http://first/":
            return 200, url, '<meta property="article:published_time" content="2025-01-01T09:00:00Z"><p>original</p>'
        link = '<link rel="canonical" href="http://first/">' if "copy" in url else ""
        return (500 if "broken" in url else 200), url, f"{link}<p>{'long body ' * 60}</p>"

    rows = [(1, "http://copy/a"), (2, "http://gone/"), (3, "http://broken/"), (4, "http://plain/"), (5, None)]
    df = spark.createDataFrame(rows, "article_id long, url string").withColumn("timestamp_utc", F.lit("2025-01-20 09:00:00").cast("timestamp"))
    got = {r.article_id: r for r in pages.fetched(df, web).collect()}
    assert (got[1].status, got[1].n_fetch, got[1].time_source, got[1].corrected, got[1].utc.day, got[1].true_source) == ("200", 2, "corrected", True, 1, "copy")
    assert (got[2].status, got[2].n_fetch, got[2].utc, got[2].text_ok) == ("TimeoutError", 0, None, False)
    assert (got[3].status, got[3].raw_body) == ("500", None) and (got[4].time_source, got[4].text_ok, got[4].n_fetch) == ("api", True, 1)
    chunked = tables.numbered_chunks(df, "article_id", 2)
    path, asked = str(tmp_path / "fetched"), []

    def step(todo):
        asked.append(todo.count())
        return pages.fetched(todo, web).join(todo.select("article_id", "chunk"), "article_id")

    tables.process_chunks(chunked.where("chunk < 1"), path, step)
    assert tables.process_chunks(chunked, path, step).count() == 5 and asked == [2, 3]


@pytest.mark.parametrize("text,ok", [("2025-01-01T10:00:00", False), ("2025-01-01T10:00:00Z", True), ("2025-01-01T10:00:00.5+0100", True), ("soon", False), (None, False)])
def test_zoneless_times_are_not_trusted(spark, text, ok):
    row = spark.createDataFrame([(text,)], "t string").select(pages.to_utc(F.col("t")).alias("u")).first()
    assert (row.u is not None) is ok


@pytest.mark.parametrize("seconds,cross,kept", [(6 * 3600, False, True), (6 * 3600 + 1, False, False), (30 * 86400, True, True), (30 * 86400 + 1, True, False), (None, True, False)])
def test_resolved_time(spark, seconds, cross, kept):
    df = spark.range(1).select(F.lit("2025-06-01").cast("timestamp").alias("api"), F.lit(seconds).cast("long").alias("s"), F.lit(cross).alias("x"))
    t, source = pages.resolved_time(F.timestamp_seconds(F.unix_timestamp("api") - F.col("s")), F.col("api"), F.col("x"))
    assert df.select(source).first()[0] == ("corrected" if kept else "api")


def test_accepted_needs_an_open_source_and_a_body(spark):
    a = spark.createDataFrame([(i, "h", "s", src, "u", None) for i, src in enumerate(["Yahoo", "CNBC", "Yahoo", "Yahoo"])], "article_id long, headline string, summary string, source string, url string, timestamp_utc timestamp")
    r = spark.createDataFrame([(0, "Wire", True, None, "", "x" * 500), (1, "Wire", True, None, "", "x" * 900), (2, "Wire", False, None, "", "x" * 499)], "article_id long, true_source string, source_ok boolean, utc timestamp, raw_body string, processed_body string")
    assert [(x.article_id, x.source) for x in pages.accepted(a, r).collect()] == [(0, "Wire")]


def test_stream_equals_batch(spark, tmp_path):
    schedule = pit.weekday_calendar(spark, "2025-01-01", "2025-02-28")
    rows = spark.range(200).select(F.col("id").alias("article_id"), F.lit("T").alias("ticker"), (F.lit("2025-01-10").cast("timestamp") + F.make_dt_interval(F.lit(0), F.col("id").cast("int"))).alias("timestamp_utc"), (F.col("id") / 7.0).alias("score"))
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = live.aligned(live.read_articles(spark, str(tmp_path / "in"), rows.schema, 1), schedule)
    q = live.append_to(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    want = live.aligned(rows, schedule)
    assert got.count() == 200 and got.select(*want.columns).exceptAll(want).count() == 0
    counts = live.session_counts(live.read_articles(spark, str(tmp_path / "in"), rows.schema), schedule)
    q = live.append_to(counts, str(tmp_path / "out2"), str(tmp_path / "cp2"))
    q.awaitTermination(120)
    closed = spark.read.parquet(str(tmp_path / "out2"))
    batch = {r.session_open: r.n for r in want.groupBy("session_open").agg(F.count("*").alias("n")).collect()}
    assert closed.count() > 0 and all(batch[r.session_open] == r.n_articles for r in closed.collect())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert len(queries) > 90 and set(oracles) <= set(queries)

"""Document parsing, price files, sinks and streaming jobs on small fixtures."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from eventide.functions import scalars as S
from eventide.sources import documents as docs
from eventide.sources import tables
from eventide.streaming import incremental as inc

D = dt.date


def _raw(spark, *payloads):
    return spark.createDataFrame([(p if isinstance(p, str) else json.dumps(p),) for p in payloads], "raw string")


def test_company_directory_forms(spark):
    raw = _raw(spark, {"0": {"cik_str": 320, "ticker": "aa", "title": "One"},
                       "1": {"cik_str": 320, "ticker": "AB", "title": "Again"},
                       "2": {"ticker": "zz"}, "3": {"cik": "0000000007", "ticker": "c", "name": "Seven"}})
    rows = {r.cik: r for r in docs.company_directory(raw).collect()}
    assert set(rows) == {"0000000320", "0000000007"}
    assert (rows["0000000320"].ticker, rows["0000000320"].company_name) == ("AA", "One")
    listed = docs.company_directory(_raw(spark, [{"cik": "5", "ticker": "q", "name": "Five"}])).collect()
    assert listed[0].internal_company_id == "COMP0000000005"


def test_event_list_cuts_to_shortest_and_filters(spark):
    arrays = {"accessionNumber": ["a1", "a2", "a3", "a4"], "form": ["10-Q", "8-K", "10-K/A", "10-K"],
              "filingDate": ["2024-01-02"] * 4, "reportDate": ["2023-12-31", "", "x", "2023-12-31"],
              "acceptanceDateTime": ["2024-01-02T16:00:00"] * 4, "primaryDocument": ["d"] * 4,
              "isXBRL": [1, 1, 1], "isInlineXBRL": [0, 0, 0, 0]}
    raw = _raw(spark, {"cik": "42", "filings": {"recent": arrays}}, "{not json", {"cik": "43"})
    assert [r.accession_number for r in docs.event_list(raw).collect()] == ["a1"]
    both = {r.accession_number: r for r in docs.event_list(raw, include_amendments=True).collect()}
    assert set(both) == {"a1", "a3"} and both["a3"].is_amendment and both["a3"].report_period_end_date is None


def test_facts_keep_quarter_and_year_to_date_apart(spark):
    obs = [{"start": "2024-01-01", "end": "2024-06-30", "val": 2.5, "accn": "x", "filed": "2024-07-01"},
           {"start": "2024-04-01", "end": "2024-06-30", "val": 10 ** 25, "accn": "x", "filed": "2024-07-01"},
           {"end": "2024-06-30", "val": "n/a", "accn": "y"}]
    raw = _raw(spark, {"cik": 9, "facts": {"t": {"c": {"units": {"USD": obs}}}}})
    rows = docs.fact_documents(raw).collect()
    assert len({r.fact_id for r in rows}) == 3 and {r.value for r in rows} == {2.5, 1e25, None}
    assert len({r.fact_id for r in docs.fact_documents(raw, id_with_start=False).collect()}) == 2


def test_rebuild_counts_and_dedupes(spark, tmp_path):
    arrays = {k: ["v"] for k in ("filingDate", "reportDate", "acceptanceDateTime", "primaryDocument", "isXBRL", "isInlineXBRL")}
    page = {"cik": "1", "filings": {"recent": {**arrays, "accessionNumber": ["a"], "form": ["10-K"]}}}
    for name, body in (("e/CIK1.json", json.dumps(page)), ("e/CIK1-page.json", json.dumps(page)), ("e/bad.json", "{"),
                       ("f/CIK1.json", json.dumps({"cik": "1", "facts": {"t": {"c": {"units": {"u": [{"end": "2024-01-01", "val": 1}]}}}}}))):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(body)
    counts = docs.rebuild_tables(spark, str(tmp_path / "e"), str(tmp_path / "f"), str(tmp_path / "out"))
    assert counts == {"filings": 1, "facts": 1}
    gone = spark.createDataFrame([("0000000001",)], "cik string")
    assert docs.rebuild_tables(spark, str(tmp_path / "e"), str(tmp_path / "f"), str(tmp_path / "out2"),
                               known_missing=gone) == {"filings": 0, "facts": 0}


def test_csv_prices_from_file_names(spark, tmp_path):
    head = "date,open,high,low,close,adjusted_close,volume\n"
    (tmp_path / "abc.csv").write_text(head + "2024-01-02,1,1,1,1,1.5,10\n2024-02-02,1,1,1,1,2.5,10\n")
    rows = tables.read_prices_csv(spark, str(tmp_path), start="2024-02-01").collect()
    assert [(r.ticker_at_date, r.date, r.adjusted_close) for r in rows] == [("ABC", D(2024, 2, 2), 2.5)]
    bad = tmp_path / "bad"
    bad.mkdir()
    (bad / "x.csv").write_text("date,open\n2024-01-02,1\n")
    with pytest.raises(ValueError, match="adjusted_close"):
        tables.read_prices_csv(spark, str(bad))


def test_constituents_and_scalars(spark):
    df = spark.createDataFrame([("BRK.B", "Berk", "1067983.0", "x")], "Symbol string, Security string, CIK string, Founded string")
    row = docs.constituent_list(df).first()
    assert (row.ticker_yf, row.cik) == ("BRK-B", "0001067983") and "Founded" not in row.asDict()
    s = spark.createDataFrame([("2024-01-02T02:00:00Z",), ("2024-01-02T23:00:00",), ("2024-01-02 junk",), ("zzz",)], "t string")
    got = [r[0] for r in s.select(S.eastern_date("t")).collect()]
    assert got == [D(2024, 1, 1), D(2024, 1, 2), D(2024, 1, 2), None]
    codes = spark.createDataFrame([("7372",), ("100",), ("n/a",), (None,)], "c string")
    assert [r[0] for r in codes.select(S.industry_division("c")).collect()] == ["7", "0", None, None]


def test_cohort_refresh_and_encoder_round_trip(spark, tmp_path):
    scores = spark.createDataFrame([("a", D(2024, 1, 5), 1.0), ("b", D(2024, 4, 5), 2.0)],
                                   "sample_id string, entry_date date, raw_score double")
    path = str(tmp_path / "cohort")
    first, built = tables.refresh_cohort(spark, scores, path)
    again, rebuilt = tables.refresh_cohort(spark, scores, path)
    assert built and not rebuilt and [r.sample_id for r in again.collect()] == ["b"]
    newer = scores.unionByName(spark.createDataFrame([("c", D(2024, 7, 5), 3.0)], scores.schema))
    latest, rebuilt = tables.refresh_cohort(spark, newer, path)
    assert rebuilt and [r.sample_id for r in latest.collect()] == ["c"]
    enc = {"feature_map": scores, "scaler": newer}
    tables.save_encoder(enc, str(tmp_path / "enc"))
    assert tables.load_encoder(spark, str(tmp_path / "enc"), derived=False)["scaler"].count() == 3


def test_stream_marks_move_and_replays_are_harmless(spark, tmp_path):
    src, base = tmp_path / "src", str(tmp_path)
    schema = "entity string, ts timestamp"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))

    def run():
        stream = spark.readStream.schema(schema).parquet(str(src))
        inc.detect_new_events(stream, "entity", "ts", f"{base}/state", f"{base}/out", f"{base}/cp").awaitTermination()

    put([("a", dt.datetime(2024, 1, 1)), ("a", dt.datetime(2024, 1, 3)), ("b", dt.datetime(2024, 1, 2))])
    run()
    put([("a", dt.datetime(2024, 1, 2)), ("b", dt.datetime(2024, 1, 9)), ("c", dt.datetime(2024, 1, 1))])
    run()
    run()  # nothing new
    got = {(r.batch, r.entity): (r.previous, r.current) for r in spark.read.parquet(f"{base}/out").collect()}
    assert got[(0, "a")] == (None, dt.datetime(2024, 1, 3))
    assert {k for k in got if k[0] == 1} == {(1, "b"), (1, "c")}
    assert got[(1, "b")] == (dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 9))


def test_digest_cycles_follow_scores_and_replace_a_replayed_batch(spark, tmp_path):
    src, base = str(tmp_path / "src"), str(tmp_path / "out")
    schema = "entity string, ts timestamp"
    watched = spark.range(3)
    table = [("s1", "a", D(2024, 1, 1), 0.9), ("s2", "a", D(2024, 2, 1), 0.2), ("s3", "b", D(2024, 1, 1), 0.5),
             ("s4", "b", D(2024, 1, 1), 0.7), ("s5", "c", D(2024, 1, 1), -0.1)]
    scores = spark.createDataFrame(table, "sample_id string, entity string, entry_date date, predicted_signal double")

    def cycle(rows, until):
        if rows:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        inc.digest_cycles(spark.readStream.schema(schema).parquet(src), "entity", "ts", base,
                          lambda: inc.newest_scores(scores.where(F.col("entry_date") < F.lit(until)), "entity", "entry_date"),
                          watched, 5).awaitTermination()
        out = {}
        for r in spark.read.parquet(f"{base}/digest").collect():
            out.setdefault(r.batch, {})[r.item] = r.value
        return out

    t = dt.datetime
    cycle([("a", t(2024, 1, 1)), ("b", t(2024, 1, 2)), ("a", t(2024, 1, 1))], D(2024, 1, 15))
    cycle([("a", t(2024, 1, 1)), ("b", t(2024, 1, 9))], D(2024, 3, 1))
    got = cycle([("c", t(2024, 1, 1)), (None, t(2024, 1, 1))], D(2024, 3, 1))
    assert got == {0: {"watched": 3.0, "new_events": 2.0, "s1": 0.9, "s3": 0.5},
                   1: {"watched": 3.0, "new_events": 1.0, "s2": 0.2, "s3": 0.5},
                   2: {"watched": 3.0, "new_events": 2.0, "s2": 0.2, "s3": 0.5}}
    assert cycle([], D(2024, 3, 1)) == got  # nothing arrived: no further cycle
    for mark in ("2", ".2.crc"):  # as if the last batch was cut off before its commit
        (tmp_path / "out" / "checkpoint" / "commits" / mark).unlink()
    assert cycle([], D(2024, 3, 1)) == got


def test_content_change_and_stale_series(spark):
    a = spark.createDataFrame([("k", D(2024, 1, 1))], "k string, date date")
    b = a.unionByName(spark.createDataFrame([("j", D(2024, 1, 20))], a.schema))
    assert inc.content_changed(a, a, "date").first().changed is False
    assert inc.content_changed(a, b, "date").first().changed is True
    assert [r.k for r in inc.stale_series(b, "k", "2024-01-22").collect()] == ["k"]


def test_event_day_is_eastern_in_any_session_zone(spark):
    from pyspark.sql import functions as F

    from eventide.functions import scalars as S
    rows = [("2020-01-03T01:30:00Z", "2020-01-02"), ("2020-01-03T01:30:00", "2020-01-03"), ("2020-07-03T03:59:00+00:00", "2020-07-02"),
            ("2020-07-03T04:00:00Z", "2020-07-03"), ("no time", None)]
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for other in ("UTC", "Asia/Tokyo", "America/Los_Angeles"):
            spark.conf.set("spark.sql.session.timeZone", other)
            df = spark.createDataFrame(rows, "t string, want string").withColumn("at", S.eastern_instant("t"))
            got = df.select("want", S.event_day(df, "at").cast("string").alias("got"), S.event_day(df, "t").cast("string").alias("text")).collect()
            assert [r.got for r in got] == [r.want for r in got]
            assert [r.text for r in got] == [r.want for r in got]
            assert df.where(F.col("at").isNull()).count() == 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_csv_files_are_read_by_their_own_header(spark, tmp_path):
    import pytest

    from eventide.sources import tables
    (tmp_path / "aa.csv").write_text("date,open,high,low,close,adjusted_close,volume\n2020-01-02,1,1,1,1,7,100\n")
    (tmp_path / "bb.csv").write_text("volume,adjusted_close,note,close,low,high,open,date\n300,9,x,2,2,2,2,2020-01-03\n")
    got = {r.ticker_at_date: (str(r.date), r.adjusted_close, r.volume) for r in tables.read_prices_csv(spark, str(tmp_path)).collect()}
    assert got == {"AA": ("2020-01-02", 7.0, 100.0), "BB": ("2020-01-03", 9.0, 300.0)}
    (tmp_path / "cc.csv").write_text("date,open,high,low,close,volume\n2020-01-02,1,1,1,1,100\n")
    with pytest.raises(ValueError, match="adjusted_close"):
        tables.read_prices_csv(spark, str(tmp_path))


def test_cohort_is_rewritten_when_its_source_changes(spark, tmp_path):
    from eventide.sources import tables
    rows = [("a", "2020-05-01", 1.0), ("b", "2020-05-02", 2.0)]
    schema = "sample_id string, entry_date string, raw_score double"
    scores = spark.createDataFrame(rows, schema).selectExpr("sample_id", "date(entry_date) AS entry_date", "raw_score")
    path = str(tmp_path / "cohort")
    assert tables.refresh_cohort(spark, scores, path)[1]
    assert not tables.refresh_cohort(spark, scores, path)[1]
    assert tables.refresh_cohort(spark, scores, path, force=True)[1]
    changed = scores.union(spark.createDataFrame([("c", "2020-05-03", 3.0)], schema).selectExpr("sample_id", "date(entry_date)", "raw_score"))
    held, written = tables.refresh_cohort(spark, changed, path)
    assert written and held.count() == 3


def test_no_local_folder_on_a_cluster():
    import pytest

    from eventide import session

    class Elsewhere:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf = {}  # names no folder
        sparkContext = Elsewhere()

    with pytest.raises(RuntimeError, match="checkpoint"):
        session.shared_dir(Session())

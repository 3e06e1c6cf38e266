"""Manifests, files, sinks and streams on small folders."""

import datetime
import hashlib

from docketry.operators import matters
from docketry.sources import artifacts, manifest
from docketry.streaming import events

HEADER = "record_key,bucket_name,order_date,title,external_record_id,detail_url,pdf_url,local_filename,status,error,first_seen_at,last_seen_at\n"


def test_manifests_are_found_and_rows_checked(spark, tmp_path):
    good = "k1,alpha,2020-01-02,\"Order, one\",,,,a.pdf,downloaded,,2020-01-02T00:00:00+00:00,2020-01-03T00:00:00+05:30\n"
    bad = "k2,beta,2020-13-01,,,,,a.pdf,downloaded,,2020-01-02T00:00:00,2020-01-01T00:00:00Z\n"
    late = "k3,alpha,,T,,,,a.pdf,x,,2020-01-05T00:00:00Z,2020-01-01T00:00:00Z\n"
    (tmp_path / "alpha").mkdir()
    (tmp_path / "deep" / "beta").mkdir(parents=True)
    (tmp_path / "alpha" / "orders_manifest.csv").write_text("﻿" + HEADER + good + bad + late)
    (tmp_path / "deep" / "beta" / "orders_manifest.csv").write_text(HEADER + good.replace("alpha", "beta").replace("k1", "k4"))
    (tmp_path / "alpha" / "other.csv").write_text(HEADER + good)
    rows = {r.record_key: r for r in manifest.read_manifests(spark, str(tmp_path)).collect()}
    assert set(rows) == {"k1", "k2", "k3", "k4"} and rows["k1"].errors == [] and rows["k4"].errors == [] and rows["k1"].title == "Order, one"
    assert rows["k1"].order_day == datetime.date(2020, 1, 2)
    assert rows["k2"].errors == ["title is blank", "order_date is no date", "first_seen_at is no time with an offset", "bucket_name isn't the folder"]
    assert rows["k3"].errors == ["first_seen_at is after last_seen_at"]


def test_the_last_row_of_a_key_stays_and_the_sink_is_sorted(spark, tmp_path):
    (tmp_path / "m.csv").write_text(HEADER + "k1,b,2020-01-01,first,,,,f,s,,2020-01-09T00:00:00Z,2020-01-09T00:00:00Z\n" + "k2,b,2020-01-01,Zed,,,,f,s,,x,y\n" + "k1,b,2020-01-01,second,,,,f,s,,2020-01-01T00:00:00Z,2020-01-01T00:00:00Z\n" + "k3,b,2021-01-01,a,,,,f,s,,x,y\n")
    rows = manifest.last_rows(spark, str(tmp_path / "m.csv"))
    assert {r.record_key: r.title for r in rows.collect()} == {"k1": "second", "k2": "Zed", "k3": "a"}
    manifest.write_manifest(rows.select(*manifest.COLUMNS), str(tmp_path / "out"))
    (part,) = (tmp_path / "out").glob("part-*.csv")
    lines = part.read_text().splitlines()
    assert lines[0] == HEADER.strip() and [x.split(",")[0] for x in lines[1:]] == ["k3", "k2", "k1"]


def test_file_snapshots(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.pdf").write_bytes(b"abc" * 400_000)
    (tmp_path / "b.pdf").write_bytes(b"")
    (tmp_path / "c.txt").write_bytes(b"no")
    got = {r.path.rsplit("/", 1)[1]: (r["size"], r.sha256) for r in manifest.file_snapshots(spark, str(tmp_path), "*.pdf").collect()}
    assert got == {"a.pdf": (1_200_000, hashlib.sha256(b"abc" * 400_000).hexdigest()), "b.pdf": (0, hashlib.sha256(b"").hexdigest())}


def test_a_stream_of_events_is_counted_once(spark, tmp_path):
    day = datetime.datetime(2024, 1, 1)
    rows = [(i % 5, day + datetime.timedelta(minutes=20 * (i % 5)), 1, "view", 1.5, "{}") for i in range(10)]
    spark.createDataFrame(rows, events.EVENTS).repartition(2).write.parquet(str(tmp_path / "in" / "events.parquet"))
    seen = []
    once = events.once(events.read_events(spark, str(tmp_path / "in")))
    running = events.upsert_each(once, lambda df, k: seen.extend((k, r.event_id) for r in df.collect()), str(tmp_path / "check"))
    running.awaitTermination(60)
    assert sorted(i for _, i in seen) == [0, 1, 2, 3, 4]
    table = spark.createDataFrame(rows, events.EVENTS).dropDuplicates(["event_id"])
    assert [tuple(r) for r in events.windowed(table).orderBy("window_start").select("n", "total").collect()] == [(3, 4.5), (2, 3.0)]
    assert [r.n for r in events.sessions(table, "15 minutes").collect()] == [1] * 5 and [r.n for r in events.sessions(table, "30 minutes").collect()] == [5]
    assert events.once(spark.createDataFrame(rows, events.EVENTS)).count() == 5


def test_logs_snapshots_and_reports(spark, tmp_path):
    rows = spark.createDataFrame([(1, "exact_lookup", [3, 4]), (2, "something new", None), (3, None, [])], "session int, route_mode string, cited array<int>")
    for _ in range(2):
        artifacts.append_log(rows, str(tmp_path / "log"))
    got = sorted((r.session, r.route_mode or "", r.router_mode, r.cited or "") for r in spark.read.parquet(str(tmp_path / "log")).collect())
    assert got == sorted([(1, "exact_lookup", "db_search", "[3,4]"), (2, "something new", "abstain", ""), (3, "", "abstain", "[]")] * 2)
    artifacts.write_snapshot({"people": rows.select("session"), "log": rows}, str(tmp_path / "snap"))
    artifacts.write_snapshot({"people": rows.select("session").limit(1)}, str(tmp_path / "snap"))
    assert spark.read.json(str(tmp_path / "snap" / "people")).count() == 1 and spark.read.json(str(tmp_path / "snap" / "log")).count() == 3
    chunks = spark.createDataFrame([("a", 1, ["tiny", "dup"], "x"), ("a", 2, ["dup"], "y"), ("a", 3, [], "z"), ("b", 1, [], "w")], "document string, place int, flags array<string>, preview string")
    artifacts.write_report(chunks, str(tmp_path / "report"), "all", only_flagged=True)
    found = {r.document: r for r in spark.read.json(str(tmp_path / "report")).collect()}
    assert found["a"].chunk_count == 3 and found["a"].flags.asDict() == {"dup": 2, "tiny": 1} and [c.place for c in found["a"].chunks] == [1, 2] and found["b"].chunks is None and found["b"]["scope"] == "all"


def test_scopes_under_locks():
    scope = {"record_key": "r", "bucket_name": "b", "document_ids": [9], "section_keys": ["s"], "section_types": ["t"]}
    assert matters.locked_scope(scope, None) == scope == matters.locked_scope(scope, {"single": True, "record_keys": []})
    assert matters.locked_scope(scope, {"single": True, "record_keys": ["x", "y"]}) == {"record_key": "x", "bucket_name": "b", "document_ids": [], "section_keys": [], "section_types": ["t"]}
    assert matters.locked_scope(scope, {"comparison": True, "document_ids": [4, 4, 5, 6]}) == {"record_key": None, "bucket_name": "b", "document_ids": [4, 5], "section_keys": [], "section_types": ["t"]}
    assert matters.locked_scope(scope, {"comparison": True, "document_ids": [4]}) == scope

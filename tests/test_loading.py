"""Landed files, upserts, stored tables and the file stream."""

import datetime as dt
import json
import random

import fixtures as fx
from pyspark.sql import functions as F

from tallyreel import schemas
from tallyreel.operators import upserts
from tallyreel.sources import landing, store, versions
from tallyreel.streaming import landing_stream

DAILY_HEADERS = [
    "day", "views", "estimatedMinutesWatched", "averageViewDuration", "averageViewPercentage",
    "subscribersGained", "subscribersLost",
]


def pages(spark, page, *objects):
    return landing.parse_landed(fx.column(spark, [json.dumps(o) for o in objects]), page, "x")


def report(headers, rows, video="a", fetched="2024-02-01T00:00:00Z"):
    out = {"video_id": video, "fetched_at": fetched, "columnHeaders": [{"name": h} for h in headers]}
    return out if rows is None else {**out, "rows": rows}


def test_ids_from_all_pages(spark):
    def item(x):
        return {"contentDetails": {"videoId": x}}

    found = landing.video_ids(
        pages(
            spark,
            landing.ID_PAGE,
            {"items": [item("a"), item("b")], "nextPageToken": "t"},
            {"nextPageToken": "u"},
            {"items": []},
            {"items": [item("a")]},
        )
    )
    assert sorted(r["video_id"] for r in found.collect()) == ["a", "a", "b"]


def test_metadata_defaults(spark):
    full = {
        "id": "a",
        "snippet": {
            "channelId": "c", "title": "t", "description": "d" * 1500,
            "publishedAt": "2026-01-18T16:30:17Z", "categoryId": "22",
            "thumbnails": {"high": {"url": "u"}},
        },
        "contentDetails": {"duration": "PT1M1S"},
    }
    bare = {
        "id": "b",
        "snippet": {"channelId": "c", "title": "t", "publishedAt": "2026-01-18T16:30:17Z", "thumbnails": {}},
        "contentDetails": {"duration": "P0D"},
    }
    page = {"fetched_at": "2026-02-01T00:00:00Z", "items": [full, bare]}
    rows = {r["video_id"]: r for r in landing.video_metadata(pages(spark, landing.VIDEO_PAGE, page)).collect()}
    assert len(rows["a"]["description"]) == 1000
    assert rows["a"]["published_at"] == dt.datetime(2026, 1, 18, 16, 30, 17)
    assert (rows["a"]["duration_seconds"], rows["a"]["is_short"]) == (61, 0)
    assert (rows["b"]["description"], rows["b"]["thumbnail_url"], rows["b"]["category_id"]) == ("", "", None)
    assert (rows["b"]["duration_seconds"], rows["b"]["is_short"]) == (0, 1)


def test_report_cells_follow_their_headers(spark):
    values = {"day": "2024-01-05", "views": 12, "estimatedMinutesWatched": 7, "averageViewDuration": 30,
              "averageViewPercentage": 101.5, "subscribersGained": 3, "subscribersLost": 1}
    orders = [DAILY_HEADERS, DAILY_HEADERS[::-1], random.Random(1).sample(DAILY_HEADERS, 7)]
    frame = landing.daily_report(
        pages(spark, landing.REPORT_PAGE, *[report(h, [[values[x] for x in h]]) for h in orders])
    )
    assert frame.distinct().count() == 1
    assert frame.first()["average_view_percentage"] == 101.5


def test_missing_cells_are_zero_and_empty_days_go(spark):
    frame = landing.daily_report(
        pages(
            spark,
            landing.REPORT_PAGE,
            report(["day", "views"], [["2024-01-05", 4], ["2024-01-06", 0]]),
            report(["day", "views", "subscribersLost"], [["2024-01-07", 5]]),
            report(["day", "views"], None),
            report(["day"], [["2024-01-08"]]),
        )
    )
    rows = {r["date"].day: r for r in frame.collect()}
    assert set(rows) == {5, 7}
    assert (rows[7]["subscribers_lost"], rows[5]["estimated_minutes_watched"]) == (0, 0)


def test_traffic_rows_without_views_stay(spark):
    headers = ["insightTrafficSourceType", "views", "estimatedMinutesWatched"]
    frame = landing.traffic_report(pages(spark, landing.REPORT_PAGE, report(headers, [["S", 0, 0], ["T", 2, 1]])))
    assert sorted((r["traffic_source_type"], r["views"]) for r in frame.collect()) == [("S", 0), ("T", 2)]


def test_channel_counts_may_be_absent(spark):
    frame = landing.channel_info(
        pages(spark, landing.CHANNEL_PAGE, {"items": [{"id": "c", "snippet": {"title": "T"}, "statistics": {"viewCount": "5"}}]})
    )
    assert tuple(frame.first()) == ("T", "c", "N/A", "5", "N/A")


def _versions(spark, rows):
    return spark.createDataFrame(
        [("a", "c" + str(n), f"t{n}", dt.datetime(2024, 1, n), dt.datetime(2024, 2, n), dt.datetime(2024, 2, n)) for n in rows],
        "video_id string, channel_id string, title string, published_at timestamp_ntz,"
        " created_at timestamp_ntz, updated_at timestamp_ntz",
    )


def test_video_upsert_keeps_first_identity(spark):
    stored = upserts.upsert_videos(None, _versions(spark, [1]))
    row = upserts.upsert_videos(stored, _versions(spark, [2])).first()
    assert (row["channel_id"], row["published_at"], row["created_at"].day) == ("c1", dt.datetime(2024, 1, 1), 1)
    assert (row["title"], row["updated_at"].day) == ("t2", 2)


def test_upsert_order_and_repeats_do_not_matter(spark):
    batches = [_versions(spark, [n]) for n in (1, 2, 3)]
    answers = set()
    for order in ([0, 1, 2], [2, 1, 0], [1, 1, 0, 2, 0]):
        stored = None
        for i in order:
            stored = upserts.upsert_videos(stored, batches[i])
        answers.add(tuple(stored.first()))
    assert len(answers) == 1


def test_fact_upsert_takes_the_latest_load(spark):
    def load(views, day):
        return fx.daily(spark, ("a", 2, views)).withColumn("fetched_at", F.lit(dt.datetime(2024, 2, day)).cast("timestamp_ntz"))

    keys = schemas.KEYS["daily_metrics"]
    newest_last = upserts.upsert(load(1, 1), load(5, 2), keys)
    newest_first = upserts.upsert(load(5, 2), load(1, 1), keys)
    assert newest_last.first()["views"] == newest_first.first()["views"] == 5


def test_columns_that_are_absent_take_defaults(spark):
    rows = spark.createDataFrame([("a", dt.date(2024, 1, 1), None)], "video_id string, date date, views bigint")
    full = schemas.conform(rows, schemas.DAILY_METRICS, F.lit("2024-02-01 00:00:00")).first()
    assert (full["views"], full["subscribers_lost"], full["average_view_percentage"]) == (None, 0, 0.0)
    assert full["fetched_at"] == dt.datetime(2024, 2, 1)


def stamp(rows, day):
    return rows.withColumn("fetched_at", F.lit(dt.datetime(2024, 3, day)).cast("timestamp_ntz"))


OLD_DAYS = [("a", dt.date(2024, 1, 5), 1), ("a", dt.date(2024, 2, 5), 2), ("b", dt.date(2024, 2, 6), 3)]
NEW_DAYS = [("a", dt.date(2024, 2, 5), 20), ("c", dt.date(2024, 2, 7), 30)]
AFTER_UPSERT = [("a", 1, 1), ("a", 2, 20), ("b", 2, 3), ("c", 2, 30)]


def stored_days(spark, path):
    rows = versions.read_table(spark, path, "daily_metrics").collect()
    return sorted((r["video_id"], r["date"].month, r["views"]) for r in rows)


def test_month_upsert_leaves_other_months_alone(spark, tmp_path):
    path = str(tmp_path)
    versions.write_table(stamp(fx.daily(spark, *OLD_DAYS), 1), path, "daily_metrics")

    def january():
        days = versions.read_days(spark, path, dt.date(2024, 1, 1), dt.date(2024, 1, 31))
        return {r[0] for r in days.select(F.input_file_name()).collect()}

    untouched = january()
    for _ in range(2):
        versions.upsert_stored(spark, path, "daily_metrics", stamp(fx.daily(spark, *NEW_DAYS), 2))
        assert stored_days(spark, path) == AFTER_UPSERT
    assert january() == untouched


def test_an_interrupted_upsert_leaves_the_table_and_can_be_repeated(spark, tmp_path, monkeypatch):
    path, new = str(tmp_path), stamp(fx.daily(spark, *NEW_DAYS), 2)
    versions.write_table(stamp(fx.daily(spark, *OLD_DAYS), 1), path, "daily_metrics")
    before = stored_days(spark, path)

    def die(*args):
        raise OSError("lost")

    for step in ("settle", "stage", "commit"):
        with monkeypatch.context() as patch:
            patch.setattr(versions, step, die)
            try:
                versions.upsert_stored(spark, path, "daily_metrics", new)
                raise AssertionError("the step was not reached")
            except OSError:
                pass
        assert stored_days(spark, path) == before
    versions.upsert_stored(spark, path, "daily_metrics", new)
    assert stored_days(spark, path) == AFTER_UPSERT


def test_two_loads_at_once_both_count(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    versions.write_table(stamp(fx.daily(spark, *OLD_DAYS), 1), path, "daily_metrics")
    real, raced = versions.stage, []

    def race(spark, path, table, rows):
        folders = real(spark, path, table, rows)
        if not raced:  # another load commits while this one has only staged its rows
            raced.append(True)
            other = stamp(fx.daily(spark, ("b", dt.date(2024, 2, 6), 300)), 3)
            versions.upsert_stored(spark, path, "daily_metrics", other)
        return folders

    monkeypatch.setattr(versions, "stage", race)
    versions.upsert_stored(spark, path, "daily_metrics", stamp(fx.daily(spark, *NEW_DAYS), 2))
    assert stored_days(spark, path) == [("a", 1, 1), ("a", 2, 20), ("b", 2, 300), ("c", 2, 30)]


def test_reading_days_opens_only_their_months(spark, tmp_path):
    path = str(tmp_path)
    days = [dt.date(2024, m, d) for m in (1, 2, 3) for d in (1, 15)]
    versions.write_table(stamp(fx.daily(spark, *[("a", d, 1) for d in days]), 1), path, "daily_metrics")
    rows = versions.read_days(spark, path, dt.date(2024, 1, 10), dt.date(2024, 2, 10))
    assert sorted(r["date"] for r in rows.collect()) == [dt.date(2024, 1, 15), dt.date(2024, 2, 1)]
    assert not any("part=2024-03" in f for f in rows.inputFiles())
    assert "GreaterThanOrEqual(date" in rows._jdf.queryExecution().executedPlan().toString()
    one = versions.read_table(spark, path, "daily_metrics").filter("video_id = 'a'")
    assert "EqualTo(video_id,a)" in one._jdf.queryExecution().executedPlan().toString()


def test_pages_and_rows_that_cannot_be_loaded_are_kept_as_rejects(spark, tmp_path):
    good = json.dumps(report(["day", "views"], [["2024-01-05", 4], ["someday", 5], [None, 6]]))
    nobody = json.dumps(report(["day", "views"], [["2024-01-06", 1]], video=None))
    lines = [good, good[:-9], "not json", nobody, "", "   "]
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(f"{tmp_path}/landed")
    read = landing.read_landed(spark, f"{tmp_path}/landed", landing.REPORT_PAGE)
    assert [(r["video_id"], r["views"]) for r in landing.daily_report(read).collect()] == [("a", 4)]
    found = sorted((r["reason"], r["raw"]) for r in landing.daily_rejects(read).collect())
    assert [r for r, _ in found] == ["no day", "no day", "no video id", "page cannot be read", "page cannot be read"]
    assert {raw for r, raw in found if r == "page cannot be read"} == {good[:-9], "not json"}
    traffic = pages(spark, landing.REPORT_PAGE, report(["insightTrafficSourceType", "views"], [[None, 1], ["S", 2]]))
    assert [r["traffic_source_type"] for r in landing.traffic_report(traffic).collect()] == ["S"]
    assert [r["reason"] for r in landing.traffic_rejects(traffic).collect()] == ["no source type"]
    metadata = pages(spark, landing.VIDEO_PAGE, {"items": [{"id": "a"}]})
    assert landing.video_metadata(metadata).collect() == []
    assert [r["reason"] for r in landing.metadata_rejects(metadata).collect()] == ["no channel id"]


def test_one_page_over_many_lines(spark, tmp_path):
    (tmp_path / "page.json").write_text(json.dumps(report(["day", "views"], [["2024-01-05", 4]]), indent=2))
    read = landing.read_landed(spark, str(tmp_path), landing.REPORT_PAGE, one_page_per_file=True)
    assert landing.daily_report(read).count() == 1 and landing.daily_rejects(read).count() == 0


def test_stream_takes_new_files_once(spark):
    root = store.fresh_folder(spark, "test")
    landed, sink, progress = f"{root}/landed", f"{root}/rows", f"{root}/progress"

    def drop(*reports):
        lines = spark.createDataFrame([(json.dumps(r),) for r in reports], "value string")
        lines.write.mode("append").text(landed)
        landing_stream.load_new_files(spark, "daily_metrics", landed, sink, progress)
        rows = landing_stream.current(spark, "daily_metrics", sink).collect()
        return sorted((r["video_id"], r["date"].day, r["views"]) for r in rows)

    headers = ["views", "day"]
    first = report(headers, [[1, "2024-01-05"], [2, "2024-01-06"]])
    later = report(headers, [[10, "2024-01-06"], [3, "2024-01-07"]], fetched="2024-02-02T00:00:00Z")
    assert drop(first) == [("a", 5, 1), ("a", 6, 2)]
    assert drop(later) == [("a", 5, 1), ("a", 6, 10), ("a", 7, 3)]
    # The same files again, and an older load after a newer one, change nothing.
    assert drop(later, first) == [("a", 5, 1), ("a", 6, 10), ("a", 7, 3)]
    landing_stream.load_new_files(spark, "daily_metrics", landed, sink, progress)

    # After compaction older batches are not read; later ones are.
    def read_batches():
        later = landing_stream._later_batches(spark, "daily_metrics", sink)
        return {r["batch"] for r in later.select("batch").distinct().collect()}

    for _ in range(2):
        landing_stream.compact(spark, "daily_metrics", sink)
        assert landing_stream.current(spark, "daily_metrics", sink).count() == 3
        assert read_batches() == set()
    newest = report(headers, [[9, "2024-01-05"]], fetched="2024-02-03T00:00:00Z")
    assert drop(newest) == [("a", 5, 9), ("a", 6, 10), ("a", 7, 3)]
    assert read_batches() == {3}
    plan = landing_stream.current(spark, "daily_metrics", sink)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(batch" in plan


def test_a_bad_page_does_not_stop_the_stream(spark, tmp_path):
    landed, sink, progress = (f"{tmp_path}/{x}" for x in ("landed", "rows", "progress"))
    good = json.dumps(report(["day", "views"], [["2024-01-05", 4], ["2024-13-99", 5]]))
    spark.createDataFrame([(good,), (good[:-5],)], "value string").write.text(landed)
    landing_stream.load_new_files(spark, "daily_metrics", landed, sink, progress)
    assert landing_stream.current(spark, "daily_metrics", sink).count() == 1
    found = landing_stream.rejects(spark, sink).collect()
    assert sorted(r["reason"] for r in found) == ["no day", "page cannot be read"]


def test_stream_of_metadata_and_traffic(spark):
    root = store.fresh_folder(spark, "test")
    item = {"id": "a", "snippet": {"channelId": "c", "title": "t", "publishedAt": "2024-01-01T00:00:00Z", "thumbnails": {}},
            "contentDetails": {"duration": "PT5S"}}
    traffic = report(["views", "insightTrafficSourceType"], [[4, "S"]])
    for table, page in [("videos", {"fetched_at": "2024-02-01T00:00:00Z", "items": [item]}), ("traffic_sources", traffic)]:
        spark.createDataFrame([(json.dumps(page),)], "value string").write.text(f"{root}/{table}/landed")
        places = [f"{root}/{table}/{x}" for x in ("landed", "rows", "progress")]
        landing_stream.load_new_files(spark, table, *places)
        assert landing_stream.current(spark, table, places[1]).count() == 1


def test_shared_folder_is_the_sessions_own(spark):
    named = spark.conf.get(store.SETTING, None)
    if named:
        assert store.fresh_folder(spark, "x").startswith(named.rstrip("/"))

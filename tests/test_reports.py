import datetime as dt

import fixtures as fx
from tallyreel.operators import audits, engagement, ranking, totals, upserts
from tallyreel.plans import charts, context, reports


def at(day, hour=9, minute=0):
    return dt.datetime(2024, 1, day, hour, minute)


def test_equal_hours_keep_the_earlier_one(spark):
    v = fx.videos(spark, {"id": "a", "published": at(1, 15)}, {"id": "b", "published": at(1, 9)})
    row = reports.upload_times(v, fx.daily(spark, ("a", 2, 50), ("b", 2, 50))).first()
    assert (row["best_hour"], row["worst_hour"], row["top_3_hours"]) == (9, 9, [9, 15])


def test_days_without_uploads_stay_empty(spark):
    v = fx.videos(spark, {"id": "a", "published": at(5)}, {"id": "none", "published": at(1)})
    d = fx.daily(spark, ("a", 6, 50))
    row = reports.upload_times(v, d).first()
    assert row["best_day"] == row["worst_day"] == "Friday"
    assert row["day_data"] == {
        "Monday": None, "Tuesday": None, "Wednesday": None, "Thursday": None,
        "Friday": 50.0, "Saturday": None, "Sunday": None,
    }
    spine = {r["day"]: r["mean_views"] for r in totals.mean_views_by_weekday(v, d).collect()}
    assert spine == row["day_data"]
    chart = charts.days_chart(v, d).collect()
    assert [(r["day"], r["views"], r["is_max"]) for r in chart] == [
        ("Mon", 0, False), ("Tue", 0, False), ("Wed", 0, False), ("Thu", 0, False),
        ("Fri", 50, True), ("Sat", 0, False), ("Sun", 0, False),
    ]


def test_videos_without_metrics_are_left_out(spark):
    v = fx.videos(spark, {"id": "a"}, {"id": "b", "title": "x" * 99})
    row = reports.title_patterns(v, fx.daily(spark, ("a", 2, 50))).first()
    assert row["avg_title_length"] == 5.0


def test_no_long_form(spark):
    v = fx.videos(spark, {"id": "a", "short": 1})
    row = reports.video_length(v, fx.daily(spark, ("a", 2, 50))).first()
    assert (row["better_format"], row["multiplier"], row["has_baseline"]) == ("Shorts", 1.0, False)
    assert (row["avg_views_longform"], row["total_longform"]) == (0, 0)


def test_equal_formats_count_as_long_form(spark):
    v = fx.videos(spark, {"id": "a", "short": 1}, {"id": "b"})
    row = reports.video_length(v, fx.daily(spark, ("a", 2, 50), ("b", 2, 50))).first()
    assert (row["better_format"], row["multiplier"]) == ("Long-form", 1.0)


def test_means_are_cut_to_whole_numbers(spark):
    v = fx.videos(spark, {"id": "a"}, {"id": "b"}, {"id": "c"})
    row = reports.video_length(v, fx.daily(spark, ("a", 2, 1), ("b", 2, 2), ("c", 2, 2))).first()
    assert row["avg_views_longform"] == 1


def test_days_with_zero_retention_do_not_count(spark):
    v = fx.videos(spark, {"id": "a"})
    d = fx.daily(spark, ("a", 2, 500, 40), ("a", 3, 50, 0), ("a", 4, 100, 130))
    row = engagement.engagement_by_video(v, d).first()
    assert (row["avg_retention"], row["total_views"]) == (85.0, 600)
    # The shared per-video aggregate gives the same without filtering the rows.
    shared = engagement.engaged_videos(v, totals.video_facts(d)).first()
    assert shared.asDict() == row.asDict()


def test_engagement_needs_more_than_the_least_views(spark):
    v = fx.videos(spark, {"id": "a"}, {"id": "b"})
    d = fx.daily(spark, ("a", 2, 100, 10), ("b", 2, 101, 10))
    assert [r["video_id"] for r in engagement.engagement_by_video(v, d).collect()] == ["b"]


def test_weak_is_strictly_below_the_mean(spark):
    v = fx.videos(spark, *[{"id": x} for x in "abc"])
    d = fx.daily(spark, ("a", 2, 200, 10), ("b", 2, 200, 20), ("c", 2, 200, 30, 5, 2))
    row = reports.weak_engagement(v, d).first()
    assert row["channel_avg_retention"] == 20.0
    assert row["total_weak_count"] == 1
    assert [w.asDict() for w in row["weak_videos"]] == [
        {"video_id": "a", "title": "plain", "avg_retention": 10.0, "total_views": 200,
         "net_subs": 0, "below_avg_by": 10.0}
    ]


def test_equal_retention_is_never_weak(spark):
    # Adding these in doubles gives means that differ in the last digit.
    days = [0.1, 0.2, 0.3, 70.7, 33.3, 66.6]
    rows = [(f"v{i}", 2 + k, 200, r) for i in range(7) for k, r in enumerate(days[i:] + days[:i])]
    v = fx.videos(spark, *[{"id": f"v{i}"} for i in range(7)])
    d = fx.daily(spark, *rows)
    assert reports.weak_engagement(v, d).first()["total_weak_count"] == 0
    assert reports.weak_engagement(v, d, by=["channel_id"]).first()["total_weak_count"] == 0


def test_weak_list_is_ordered_and_cut(spark):
    v = fx.videos(spark, *[{"id": f"v{i}", "title": "t" * 80} for i in range(9)])
    d = fx.daily(spark, *[("v%d" % i, 2, 200, r) for i, r in enumerate([9, 8, 7, 6, 5, 5, 90, 90, 90])])
    row = reports.weak_engagement(v, d, n=3).first()
    assert [w["video_id"] for w in row["weak_videos"]] == ["v4", "v5", "v3"]
    assert row["total_weak_count"] == 6
    assert {len(w["title"]) for w in row["weak_videos"]} == {60}


def test_no_weak_videos_gives_an_empty_answer(spark):
    v = fx.videos(spark, {"id": "a"})
    row = reports.weak_engagement(v, fx.daily(spark, ("a", 2, 200, 10))).first()
    assert (row["total_weak_count"], row["weak_videos"]) == (0, [])
    grouped = reports.weak_engagement(v, fx.daily(spark, ("a", 2, 200, 10)), by=["channel_id"]).first()
    assert grouped["total_weak_count"] == 0 and not grouped["weak_videos"]


def test_null_titles_are_left_out_of_flags_and_buckets(spark):
    v = fx.videos(spark, {"id": "a", "title": None}, {"id": "b", "title": "né!"})
    row = reports.title_patterns(v, fx.daily(spark, ("a", 2, 900), ("b", 2, 50))).first()
    assert (row["avg_views_with_emoji"], row["avg_views_without_emoji"]) == (50, 0)
    assert row["emoji_helps"] is True
    assert row["length_performance"] == {"short": 50}
    assert row["avg_title_length"] == 3.0


def test_question_marks(spark):
    v = fx.videos(spark, {"id": "a", "title": "why?"}, {"id": "b", "title": "so"})
    row = totals.yes_no_means(v, fx.daily(spark, ("a", 2, 10), ("b", 2, 30)), "question").first()
    assert (row["mean_with"], row["mean_without"]) == (10.0, 30.0)


def test_equal_buckets_keep_the_shorter_one(spark):
    v = fx.videos(spark, {"id": "a", "title": "x" * 60}, {"id": "b", "title": "x" * 40})
    row = reports.title_patterns(v, fx.daily(spark, ("a", 2, 10), ("b", 2, 10))).first()
    assert row["best_title_length_bucket"] == "medium"


def test_seven_day_edge(spark):
    v = fx.videos(spark, {"id": "a", "published": at(10, 23, 59)}, {"id": "b"})
    d = fx.daily(spark, ("a", 9, 1), ("a", 10, 10), ("a", 17, 100), ("a", 18, 1000), ("b", 2, 0))
    rows = totals.first_week_views(v, d).collect()
    assert [(r["video_id"], r["views_7d"], r["total_views"]) for r in rows] == [("a", 111, 1111)]


def test_traffic_shares_sum_to_all(spark):
    t = fx.traffic(spark, ("a", "S", 1), ("a", "T", 1), ("b", "S", 1), ("b", "U", 3))
    rows = {r["traffic_source_type"]: r["percentage"] for r in totals.traffic_shares(t).collect()}
    assert rows == {"S": 33.3, "T": 16.7, "U": 50.0}
    row = reports.traffic(t).first()
    assert (row["top_source"], row["top_3_sources"]) == ("U", ["U", "S", "T"])
    assert row["sources"]["T"].asDict() == {"total_views": 1, "percentage": 16.7}


def test_no_traffic_gives_no_row(spark):
    empty = fx.traffic(spark, ("a", "S", 1)).limit(0)
    assert reports.traffic(empty).count() == 0


def test_traffic_without_views_has_no_share(spark):
    assert totals.traffic_shares(fx.traffic(spark, ("a", "S", 0))).first()["percentage"] is None


def test_chart_shows_six_sources_and_their_own_total(spark):
    t = fx.traffic(spark, *[("a", f"s_{i}", 10 - i) for i in range(8)])
    rows = charts.traffic_chart(t).collect()
    assert len(rows) == 6
    assert {r["name"]: r["percent_of_shown"] for r in rows}["S 0"] == 22


def test_one_channel_grouped_equals_global(spark):
    v = fx.videos(spark, *[{"id": f"v{i}", "published": at(1 + i, i), "short": i % 2} for i in range(8)])
    d = fx.daily(spark, *[(f"v{i}", 9, 150 * (i + 1), 10 + i) for i in range(8)])
    t = fx.traffic(spark, *[(f"v{i}", "ST"[i % 2], i + 1) for i in range(8)])
    whole = reports.all_patterns(v, d, t).first().asDict(recursive=True)
    grouped = reports.all_patterns(v, d, t, ["channel_id"]).first().asDict(recursive=True)
    assert grouped.pop("channel_id") == "c"
    assert grouped == whole


def test_format_views_add_up(spark):
    v = fx.videos(spark, *[{"id": f"v{i}", "short": i % 2} for i in range(5)])
    d = fx.daily(spark, *[(f"v{i}", 9, i) for i in range(5)])
    row = reports.video_length(v, d).first()
    assert row["shorts_total_views"] + row["longform_total_views"] == 10


def test_top_videos_break_ties_by_id(spark):
    v = fx.videos(spark, *[{"id": x} for x in "cab"])
    rows = ranking.top_videos(v, fx.daily(spark, ("a", 2, 5), ("b", 2, 5), ("c", 2, 5)), 2).collect()
    assert [r["video_id"] for r in rows] == ["a", "b"]


def test_days_before_the_source_is_final_are_not_planned(spark):
    v = fx.videos(spark, *[{"id": f"d{n}", "published": at(30 - n, 23)} for n in (3, 2, 1)])
    rows = upserts.fetch_plan(v, dt.date(2024, 1, 30)).collect()
    assert {r["video_id"] for r in rows} == {"d3", "d2"}
    assert {r["end_date"] for r in rows} == {dt.date(2024, 1, 28)}


def test_audits_find_one_of_each(spark):
    v = fx.videos(spark, {"id": "a"})
    d = fx.daily(spark, ("a", 2, 1), ("a", 2, 2), ("ghost", 3, 1))
    assert [tuple(r) for r in audits.repeated_keys(d, ["video_id", "date"]).collect()] == [
        ("a", dt.date(2024, 1, 2), 2)
    ]
    assert [r["video_id"] for r in audits.orphans(d, v).collect()] == ["ghost"]
    nulls = {r["column_name"]: r["nulls"] for r in audits.null_counts(d, ["video_id", "fetched_at"]).collect()}
    assert nulls == {"video_id": 0, "fetched_at": 3}


def test_channel_series_weights_averages_by_views(spark):
    d = fx.daily(spark, ("a", 2, 30, 10), ("b", 2, 10, 50), ("a", 3, 0, 10), ("a", 29, 5, 1))
    rows = {r["date"].day: r for r in totals.channel_daily(d, dt.date(2024, 1, 30)).collect()}
    assert set(rows) == {2, 3}
    assert (rows[2]["views"], rows[2]["average_view_percentage"]) == (40, 20.0)
    assert rows[3]["average_view_percentage"] is None


def test_fingerprint_follows_the_statistics_only(spark):
    v = fx.videos(spark, {"id": "a"})
    rows = context.upload_context(v, fx.daily(spark, ("a", 2, 50)))
    changed = context.upload_context(v, fx.daily(spark, ("a", 2, 51)))

    def key(frame, kind="upload"):
        return context.fingerprint(frame, kind, "p", "m").first()["cache_key"]

    assert key(rows) == key(rows.select(*reversed(rows.columns)))
    assert len({key(rows), key(changed), key(rows, "titles")}) == 3
    stored = spark.createDataFrame([(key(rows),)], "cache_key string")
    assert context.unanswered(context.fingerprint(rows, "upload", "p", "m"), stored).count() == 0
    assert context.unanswered(context.fingerprint(changed, "upload", "p", "m"), stored).count() == 1


def test_every_kind_of_reply_has_the_key_that_plain_python_gives_it(spark):
    import hashlib
    import json

    from pyspark.sql import functions as F

    shown = {f"v{i}": {"id": f"v{i}", "channel": f"c{i % 2}", "title": f'"é" {i}\t!'} for i in range(14)}
    v = fx.videos(spark, *shown.values(), {"id": "w", "channel": "quiet"})
    d = fx.daily(spark, *[(n, 2, 150 + 7 * i, 30.0 + i / 3) for i, n in enumerate(shown)], ("w", 2, 5, 40.0))
    t = spark.createDataFrame([("v0", "SEARCH", 30), ("v1", "HOME", 70), ("v2", "HOME", 7)],
                              "video_id string, traffic_source_type string, views long")
    planned = [("c0", "plan"), ("c0", "plan"), ("c1", None), ("nowhere", "ü")]
    candidates = spark.createDataFrame(planned, "channel_id string, title string")
    by = ["channel_id"]

    def key(statistics, kind):
        text = json.dumps(statistics, sort_keys=True, ensure_ascii=False) + kind + "p" + "m"
        return hashlib.md5(text.encode()).hexdigest()

    wanted, patterns, best = [], {}, {}
    for row in reports.all_patterns(v, d, t, by).collect():
        whole = row.asDict(recursive=True)
        g = whole.pop("channel_id")
        views = d.join(v, "video_id").filter(F.col("channel_id") == g).orderBy(F.desc("views"), "video_id")
        best[g] = [r["title"] for r in views.collect()]
        p = patterns[g] = {n: x or {} for n, x in whole.items()}
        some = {n: p[n] for n in ("title_patterns", "video_length")}
        wanted += [
            (g, "upload_strategy", None, key(p["upload_times"], "upload_strategy")),
            (g, "title_ideas_food", None, key(p["title_patterns"], "title_ideas_food")),
            (g, "thumbnail", None, key({**some, "traffic": p["traffic"]}, "thumbnail")),
            (g, "channel_audit", None, key(p, "channel_audit")),
            (g, "next_video_ideas", None, key({**some, "titles": best[g][:15]}, "next_video_ideas")),
        ]
        for w in p["weak_engagement"].get("weak_videos") or []:
            facts = {"title": w["title"], "retention": w["avg_retention"], "views": w["total_views"]}
            wanted.append((g, "weak_video", w["video_id"], key(facts, "weak_video")))
    for g, title in sorted(set(planned), key=str):
        p = patterns.get(g, {})
        facts = {"title": title, "top_titles": best.get(g, [])[:10]}
        facts |= {n: p.get(n, {}) for n in ("traffic", "title_patterns")}
        wanted.append((g, "thumbnail_from_title", title, key(facts, "thumbnail_from_title")))
    found = context.fingerprints(v, d, t, candidates, "p", "m", "food", by).collect()
    assert sorted(map(tuple, found), key=str) == sorted(wanted, key=str)
    assert sum(kind == "weak_video" for _, kind, *_ in wanted) > 3
    nothing = context.fingerprints(v.limit(0), d.limit(0), t.limit(0), candidates.limit(0), "p", "m", "", by)
    assert nothing.count() == 0


def test_topic_is_optional(spark):
    v, d = fx.videos(spark, {"id": "a"}), fx.daily(spark, ("a", 2, 50))
    assert context.title_context(v, d).first()["topic"] is None
    assert context.title_context(v, d, "food").first()["topic"] == "food"


def test_weak_videos_match_brute_force_with_one_dominant_channel(spark):
    import random

    rng = random.Random(5)
    names = [f"v{i:03d}" for i in range(400)]
    channel = {n: "hot" if i % 3 else f"c{i % 40}" for i, n in enumerate(names)}
    retention = {n: float(rng.randint(1, 100)) for n in names}
    v = fx.videos(spark, *[{"id": n, "channel": channel[n]} for n in names])
    d = fx.daily(spark, *[(n, 2, 500, retention[n]) for n in names])
    got = {
        r["channel_id"]: ([w["video_id"] for w in r["weak_videos"] or []], r["total_weak_count"])
        for r in reports.weak_engagement(v, d, by=["channel_id"]).collect()
    }
    expected = {}
    for c in set(channel.values()):
        own = [n for n in names if channel[n] == c]
        mean = sum(retention[n] for n in own) / len(own)
        under = sorted((n for n in own if retention[n] < mean), key=lambda n: (retention[n], n))
        expected[c] = (under[:5], len(under))
    assert got == expected

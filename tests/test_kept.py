"""Report tables kept through random loads against reports from all rows."""

import datetime as dt
import random

import pytest

from tallyreel.operators import upserts
from tallyreel.plans import reports
from tallyreel.plans.kept import Changes, KeptReports
from tallyreel.schemas import KEYS

VIDEOS = "video_id string, channel_id string, title string, published_at timestamp_ntz, is_short int"
DAILY = (
    "video_id string, date date, views bigint, average_view_percentage double, subscribers_gained bigint, "
    "subscribers_lost bigint, fetched_at timestamp_ntz"
)
TRAFFIC = "video_id string, traffic_source_type string, views bigint, fetched_at timestamp_ntz"
DAY = dt.datetime(2024, 1, 1)


def some_load(rng, number):
    """Videos, days and sources of a load; some are new, some replace older ones, some have nulls."""
    ids = [f"v{i}" for i in range(30)]
    now = DAY + dt.timedelta(days=number)

    def maybe(value):
        return None if rng.random() < 0.1 else value

    videos = [
        (v, f"c{int(v[1:]) % 3}", rng.choice(["a!", "b?", "é", "x" * 40]), DAY + dt.timedelta(hours=int(v[1:]) * 7), rng.randrange(2))
        for v in rng.sample(ids, 12)
    ]
    days = {(v, DAY.date() + dt.timedelta(days=rng.randrange(5))) for v in rng.sample(ids, 15)}
    daily = [
        (*k, maybe(rng.randrange(400)), maybe(rng.choice([0.0, rng.random() * 90])), maybe(rng.randrange(9)), maybe(1), now)
        for k in sorted(days)
    ]
    sources = [(v, rng.choice(["SHORTS", "SEARCH"]), maybe(rng.randrange(90)), now) for v in rng.sample(ids, 10)]
    return videos, daily, sources


def rounded(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, dict):
        return {k: rounded(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [rounded(v) for v in value]
    return value


def answers(frame):
    return sorted((repr(rounded(r.asDict(recursive=True))) for r in frame.collect()))


@pytest.mark.parametrize("by", [[], ["channel_id"]])
def test_reports_after_every_load(spark, tmp_path, by):
    rng = random.Random(7)
    kept = KeptReports(spark, str(tmp_path), by)
    known, stored = {}, {"daily_metrics": None, "traffic_sources": None}
    for load in range(4):
        videos, daily, sources = some_load(rng, load)
        fresh = spark.createDataFrame(videos, VIDEOS)
        changed = []
        for name, rows, schema in (("daily_metrics", daily, DAILY), ("traffic_sources", sources, TRAFFIC)):
            incoming = spark.createDataFrame(rows, schema)
            changed += upserts.changed_rows(stored[name], incoming, KEYS[name])
            after = upserts.upsert(stored[name], incoming, KEYS[name]).collect()
            stored[name] = spark.createDataFrame(after, schema)
        known.update({v[0]: v for v in videos})
        changes = Changes(fresh, *changed)
        kept.apply(load, load - 1 if load else None, changes)
        if load == 2:
            kept.apply(load, load - 1, changes)  # a load that is repeated
        if load in (0, 3):
            all_videos = spark.createDataFrame(list(known.values()), VIDEOS)
            whole = reports.all_patterns(all_videos, *stored.values(), by)
            assert answers(kept.all_patterns(load)) == answers(whole)
            tiles = reports.kpi_tiles(all_videos, stored["daily_metrics"], by)
            assert answers(kept.kpi_tiles(load)) == answers(tiles)


def test_an_empty_first_load(spark, tmp_path):
    empty = [spark.createDataFrame([], s) for s in (VIDEOS, DAILY, DAILY, TRAFFIC, TRAFFIC)]
    kept = KeptReports(spark, str(tmp_path), ["channel_id"])
    kept.apply(0, None, Changes(*empty))
    assert kept.all_patterns(0).collect() == []

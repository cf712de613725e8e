"""Audits kept through random loads against audits of all rows, reading touched parts only."""

import random
from collections import Counter

from tallyreel.plans.audited import KeptAudits

SCHEMA = "part string, video_id string, date string, views bigint"


def plain(rows, known):
    """The summary by part, by counting."""
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        keys = Counter(r[1:3] for r in mine)
        many = [n for n in keys.values() if n > 1]
        unknown = sum(r[1] is not None and r[1] not in known for r in mine)
        nulls = tuple(sum(r[c] is None for r in mine) for c in (1, 3))
        out[part] = (len(mine), *nulls, len(many), sum(many) - len(many), unknown)
    return out


def shown(frame):
    columns = ["rows", "null_video_id", "null_views", "repeated_keys", "extra_rows", "orphan_rows"]
    return {r["part"]: tuple(r[c] for c in columns) for r in frame.collect()}


def test_summaries_after_every_load(spark, tmp_path):
    rng = random.Random(3)
    kept = KeptAudits(spark, str(tmp_path), ["video_id", "date"], ["video_id", "views"])
    stored, known, previous = [], set(), None
    for load in range(4):
        touched = sorted(rng.sample([f"p{i}" for i in range(5)], 2)) if load else [f"p{i}" for i in range(5)]
        if load == 2:
            stored = [r for r in stored if r[0] != touched[0]]
        for part in touched[load == 2 :]:
            stored += [
                (part, rng.choice([None, *[f"v{i}" for i in range(8)]]), str(rng.randrange(4)), rng.choice([None, 1]))
                for _ in range(12)
            ]
        added = {f"v{i}" for i in rng.sample(range(8), 2)} - known
        known |= added
        names = [spark.createDataFrame([(v,) for v in sorted(n)], "video_id string") for n in (known, added)]
        # Rows of other parts are not there to be read.
        rows = spark.createDataFrame([r for r in stored if r[0] in touched], SCHEMA)
        kept.apply(load, previous, rows, touched, names[0], names[1])
        previous = load
        assert shown(kept.summary(load)) == plain(stored, known)
    # A load that is repeated leaves the same state.
    kept.apply(3, 2, rows, touched, names[0], names[1])
    assert shown(kept.summary(3)) == plain(stored, known)


def shown_again(kept, load):
    return sorted(tuple(r) for r in kept.summary(load).collect())


def test_only_touched_parts_are_scanned(spark, tmp_path):
    rows = [(f"p{i % 4}", f"v{i}", "d", 1) for i in range(40)]
    spark.createDataFrame(rows, SCHEMA).write.partitionBy("part").parquet(f"{tmp_path}/rows")
    stored = spark.read.schema("video_id string, date string, views bigint, part string").parquet(f"{tmp_path}/rows")
    kept = KeptAudits(spark, f"{tmp_path}/audits", ["video_id", "date"], ["views"])
    known = spark.createDataFrame([("v1",)], "video_id string")
    kept.apply(0, None, stored, ["p0", "p1", "p2", "p3"], known)
    for folder in tmp_path.glob("rows/part=p[023]/*.parquet"):
        folder.write_bytes(b"not a table any more")
    kept.apply(1, 0, stored, ["p1"], known)
    assert shown_again(kept, 1) == shown_again(kept, 0) and len(shown_again(kept, 1)) == 4


def test_no_rows(spark, tmp_path):
    kept = KeptAudits(spark, str(tmp_path), ["video_id", "date"], ["views"])
    empty = spark.createDataFrame([], SCHEMA)
    kept.apply(0, None, empty, [], empty.select("video_id"))
    assert kept.summary(0).count() == 0 and kept.repeats(0).count() == 0 and kept.orphans(0).count() == 0

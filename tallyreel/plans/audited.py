"""Audits of a stored fact that loads keep up to date, part by part.

A part is whatever the fact is stored by, such as days or sources. The state after a load holds, per
part, its rows and nulls, its repeated keys, and its rows of unknown videos. A load brings the parts
it touched as they are now, and the videos it added: touched parts are audited anew, findings of the
others stay, and old rows of unknown videos go once their video has come. So no other part is read, and
a state that took many loads equals one made from all rows at once.

Each load writes a folder of its own from that of the load before, as kept reports do: repeating it
writes the same folder again.

Findings are as many as what is wrong. Null keys are counted as nulls; they are repeated keys if
several rows have them, and no rows of unknown videos. A part that a load left empty has no row.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyreel.operators import audits

PART = "part"


class KeptAudits:
    """States of one fact's audits in a folder; its rows carry the part they lie in."""

    def __init__(self, spark: SparkSession, folder: str, keys: Sequence[str], required: Sequence[str]) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.keys, self.required = list(keys), list(required)

    def _read(self, load: int, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/load={load}/{name}")

    def apply(
        self,
        load: int,
        previous: int | None,
        rows: DataFrame,
        parts: Sequence[str],
        videos: DataFrame,
        added: DataFrame | None = None,
    ) -> None:
        """Write the state after a load from that of the previous one, None for the first.

        ``rows`` are read from the touched ``parts`` alone. ``videos`` are all known ones,
        ``added`` those among them that came since the previous load; None if any may have.
        """
        here = rows.filter(F.col(PART).isin(list(parts)))
        nulls = [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in self.required]
        by_video = here.filter("video_id IS NOT NULL").groupBy(PART, "video_id").agg(F.count("*").alias("rows"))
        found = {
            "counts": here.groupBy(PART).agg(F.count("*").alias("rows"), *nulls),
            "repeats": audits.repeated_keys(here, [PART, *self.keys]),
            "orphans": audits.orphans(by_video, videos),
        }
        for name, news in found.items():
            if previous is not None:
                old = self._read(previous, name).filter(~F.col(PART).isin(list(parts)))
                if name == "orphans":
                    old = audits.orphans(old, videos if added is None else added)
                news = old.select(news.columns).unionByName(news)
            news.write.mode("overwrite").parquet(f"{self.folder}/load={load}/{name}")

    def repeats(self, load: int) -> DataFrame:
        """Keys that occur more than once in a part, with their number of rows."""
        return self._read(load, "repeats")

    def orphans(self, load: int) -> DataFrame:
        """Unknown videos of each part, with their number of rows."""
        return self._read(load, "orphans")

    def summary(self, load: int) -> DataFrame:
        """One row per part: rows, nulls, repeated keys and the rows they have too many, orphan rows."""
        counts = self._read(load, "counts")
        repeats = self.repeats(load).groupBy(PART).agg(
            F.count("*").alias("repeated_keys"), F.sum(F.col("copies") - 1).alias("extra_rows")
        )
        orphans = self.orphans(load).groupBy(PART).agg(F.sum("rows").alias("orphan_rows"))
        joined = counts.join(repeats, PART, "left").join(orphans, PART, "left")
        return joined.fillna(0, ["repeated_keys", "extra_rows", "orphan_rows"])

"""Connected components of links, as DataFrame rounds."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyreel.llm import storage
from tallyreel.llm.storage import Settle


def _mins(links: DataFrame, settle: Settle) -> DataFrame:
    """Smallest neighbour of each node, itself included; settled so that joins with it can be split."""
    return settle(links.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low")), "lows")


def _large_star(links: DataFrame, settle: Settle) -> DataFrame:
    """Hang each node's larger neighbours on its smallest one."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.join(_mins(both, settle), "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))


def _small_star(links: DataFrame, settle: Settle) -> DataFrame:
    """Hang each node and its smaller neighbours on the smallest of them."""
    lows = _mins(links, settle)
    hung = links.join(lows, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return hung.union(lows.select("a", F.col("low").alias("b"))).filter("a <> b").distinct()


def _settled(links: DataFrame) -> bool:
    """Does every node hang on one root, that itself hangs on none?"""
    roots = links.select(F.col("b").alias("a")).distinct()
    under = links.join(roots, "a", "left_semi").agg(F.count(F.lit(1)).alias("n")).first()["n"]
    return not under and links.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()


def components(links: DataFrame, settle: Settle = storage.settle) -> DataFrame:
    """The smallest node that each linked node can reach: (a, b) -> (node, root).

    Alternates large-star and small-star rounds until every node hangs on its root. Each
    round's links are written to the shared folder, so no lineage grows and a lost
    executor costs its tasks only. Hot nodes: minima combine before they move, and the
    joins are ones that Spark splits where a key has very many rows. The answer is written
    with ``settle``; the files of the rounds are removed.
    """
    with storage.scratch(links.sparkSession) as own:
        down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        now = own(down.filter("a <> b").distinct(), "links")
        while not _settled(now):
            now = own(_small_star(own(_large_star(now, own), "hung"), own), "links")
        return settle(now.select(F.col("a").alias("node"), F.col("b").alias("root")), "components")

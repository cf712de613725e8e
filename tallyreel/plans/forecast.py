"""View-class forecast: training rows, folds, boosted trees, scores and metrics."""

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyreel.functions import clock, figures, titles
from tallyreel.operators.grouping import attach, beside
from tallyreel.operators.totals import first_week_views
from tallyreel.plans import boosting
from tallyreel.plans.boosting import DEPTH, TREES
from tallyreel.schemas import CLASS_LABELS, DAY_NAMES, FEATURES
from tallyreel.sources.store import settle, shared_folder

CLASSES = list(range(len(CLASS_LABELS)))
FOLDS = 5
# Changes with the way models are fitted, so that none fitted in another way is read.
MODEL_KIND = "multinomial-2"
_NODES = f"array<struct<{boosting.TREE_FIELDS}>>"
_MODEL = f"classes array<long>, start array<double>, trained_on long, nodes {_NODES}"


def feature_columns(title: Column, hour: Column, weekday: Column, month: Column) -> list[Column]:
    made = {
        "hour": hour,
        "day_of_week": weekday,
        "month": month,
        "title_length": titles.title_length(title),
        "has_emoji": titles.has_non_ascii(title),
        "has_exclamation": titles.has_exclamation(title),
        "has_question": titles.has_question(title),
        "title_word_count": titles.word_count(title),
        "title_has_numbers": titles.has_digit(title),
    }
    return [made[f].cast("bigint").alias(f) for f in FEATURES]


def training_rows(videos: DataFrame, daily: DataFrame) -> DataFrame:
    """Features and view class per video; rows with a missing feature are dropped.

    Every feature comes from the title or the publish time, so testing those two
    tests all features without computing them twice.
    """
    ts = F.col("published_at")
    described = videos.filter(F.col("title").isNotNull() & ts.isNotNull()).select(
        "video_id",
        "published_at",
        *feature_columns(
            F.col("title"), clock.publish_hour(ts), clock.weekday_number(ts), clock.publish_month(ts)
        ),
    )
    rows = first_week_views(described, daily, FEATURES).dropna(subset=["views_7d"])
    return rows.select(
        "video_id",
        *FEATURES,
        "views_7d",
        "total_views",
        figures.performance_class(F.col("views_7d")).alias("category"),
    )


def class_distribution(rows: DataFrame) -> DataFrame:
    """Rows per class 0 to 3, absent classes as 0."""
    counts = rows.agg(*[F.count_if(F.col("category") == c).alias(str(c)) for c in CLASSES])
    long = counts.unpivot([], [str(c) for c in CLASSES], "category", "videos")
    number = F.col("category").cast("bigint")
    return long.select(
        number.alias("category"), figures.class_label(number).alias("label"), "videos"
    )


def distribution_chart(rows: DataFrame) -> DataFrame:
    """Tile counts: low, medium and high together, viral."""
    counts = class_distribution(rows)
    tile = (
        F.when(F.col("category") == 0, F.lit(CLASS_LABELS[0]))
        .when(F.col("category") == 3, F.lit(CLASS_LABELS[3]))
        .otherwise("Medium / High")
    )
    return counts.groupBy(tile.alias("tile")).agg(F.sum("videos").alias("videos"))


def folds(rows: DataFrame, k: int = FOLDS, label: str = "category", key: str = "video_id"):
    """Stratified folds: rows of a class, in order of the key, dealt out in turn.

    Numbering a whole class in one window would put it in one task. Rows are sorted in ranges
    instead, with even numbers of rows, whatever the classes. A row's place in its class is its
    place in its range and the number of rows of the class in earlier ranges. These are as
    many as ranges and classes, so their running sum and the broadcast stay small. The
    sorted rows are written out, as the ranges must not change between both readings.
    """
    place = F.monotonically_increasing_id()  # its upper bits are the range, the lower ones the place in it
    sorted_rows = rows.repartitionByRange(label, key).sortWithinPartitions(label, key).withColumn("_place", place)
    placed = settle(sorted_rows.withColumn("_range", F.shiftright("_place", 33)), "unfolded")
    earlier = W.partitionBy(label).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    counts = placed.groupBy(label, "_range").agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
    before = F.coalesce(F.sum("_n").over(earlier), F.lit(0))
    starts = counts.select(label, "_range", (before - F.col("_first")).alias("_shift"))
    number = F.col("_place") + F.col("_shift")
    return (
        placed.join(F.broadcast(starts), [label, "_range"])
        .withColumn("fold", F.pmod(number, F.lit(k)).cast("bigint"))
        .select(*rows.columns, "fold")
    )


@dataclass(frozen=True)
class Forecaster:
    """A fitted model and the number of videos behind it."""

    booster: boosting.Booster
    trained_on: int

    @property
    def classes(self) -> tuple[int, ...]:
        return self.booster.classes

    def save(self, spark: SparkSession, path: str) -> None:
        """One row in a new folder."""
        booster = self.booster
        row = (list(booster.classes), list(booster.start), self.trained_on, boosting.tree_rows(booster))
        spark.createDataFrame([row], _MODEL).coalesce(1).write.parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Forecaster":
        """The model of a folder, or of the first of several that match."""
        name = F.input_file_name()
        row = spark.read.schema(_MODEL).parquet(path).withColumn("_file", name).orderBy("_file").first()
        booster = boosting.Booster(tuple(row["classes"]), tuple(row["start"]), boosting.trees_of(row["nodes"]))
        return Forecaster(booster, row["trained_on"])


def fit(rows: DataFrame, max_iter: int = TREES, max_depth: int = DEPTH) -> Forecaster:
    """Boosted trees with the multinomial loss, one tree per class and round.

    Features are small integers, so many videos share a feature vector. Equal rows
    are trained on once, weighted by their number.
    """
    return _fit(boosting.points_of(rows, FEATURES), max_iter, max_depth)


def _fit(points: DataFrame, max_iter: int, max_depth: int) -> Forecaster:
    booster = boosting.fit(points, FEATURES, max_iter, max_depth)
    return Forecaster(booster, points.agg(F.sum("videos").alias("n")).first()["n"])


def kept_fit(rows: DataFrame, max_iter: int = TREES, max_depth: int = DEPTH) -> Forecaster:
    """Like fit, but done once for equal training rows: the model is saved and read again.

    Its folder in the shared one is named after the rows' number, the sums of two hashes of
    them, and how it is fitted. Two sessions that fit at once save the same model twice.
    """
    spark, points = rows.sparkSession, boosting.points_of(rows, FEATURES)
    hashes = [F.sum(F.xxhash64(F.lit(i), *points.columns).cast("decimal(20,0)")) for i in range(2)]
    digest = points.agg(F.count("*"), *hashes).first()
    name = "-".join([MODEL_KIND, str(max_iter), str(max_depth), *(f"{x or 0:x}" for x in map(int, digest))])
    folder = f"{shared_folder(spark)}/tallyreel/models/{name}"
    try:
        return Forecaster.load(spark, f"{folder}/*")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
    model = _fit(points, max_iter, max_depth)
    model.save(spark, f"{folder}/{uuid.uuid4().hex}")
    return model


def outcome(forecaster: Forecaster) -> list[Column]:
    """Predicted class and percent per class from ``chances``; a class not seen in training gets 0."""
    number = {c: i for i, c in enumerate(forecaster.classes)}
    chance = {c: F.get("chances", F.lit(number[c])) if c in number else F.lit(0.0) for c in CLASSES}
    best = F.greatest(*chance.values())
    predicted = F.coalesce(*[F.when(chance[c] == best, F.lit(c)) for c in CLASSES])
    return [
        predicted.cast("bigint").alias("predicted_class"),
        figures.class_label(predicted).alias("predicted_category"),
        F.map_from_arrays(
            F.array(*[F.lit(x) for x in CLASS_LABELS]),
            F.array(*[F.bround(chance[c] * 100, 1) for c in CLASSES]),
        ).alias("probabilities"),
    ]


def predict(forecaster: Forecaster, rows: DataFrame) -> DataFrame:
    """Predicted class and percent per class of each row."""
    scored = boosting.score(rows, forecaster.booster, FEATURES)
    return scored.select(*[F.col(f"rest.`{c}`").alias(c) for c in rows.columns], *outcome(forecaster))


def cross_predictions(
    rows: DataFrame, k: int = FOLDS, max_iter: int = TREES, max_depth: int = DEPTH
) -> DataFrame:
    """Each video's class as predicted by a model that has not seen it.

    The k fits are independent, so they run side by side.
    """
    dealt = settle(folds(rows, k), "folds")

    def held_out(i: int) -> DataFrame:
        model = fit(dealt.filter(F.col("fold") != i), max_iter, max_depth)
        scored = predict(model, dealt.filter(F.col("fold") == i))
        return scored.select("video_id", "fold", "category", "predicted_class")

    with ThreadPool(k) as pool:
        run = inheritable_thread_target(rows.sparkSession)(held_out)
        return reduce(DataFrame.unionByName, pool.map(run, range(k)))


def accuracy(predictions: DataFrame) -> DataFrame:
    right = F.when(F.col("predicted_class") == F.col("category"), 1.0).otherwise(0.0)
    return predictions.agg(F.avg(right).alias("accuracy"))


def importance(spark: SparkSession, forecaster: Forecaster) -> DataFrame:
    """Each feature's share in what the splits of all trees gain."""
    weights = forecaster.booster.importance(len(FEATURES))
    return spark.createDataFrame(list(zip(FEATURES, weights, strict=True)), "feature string, importance double")


def importance_chart(weights: DataFrame) -> DataFrame:
    """Display name and percent with one decimal, largest first."""
    percent = F.bround(F.col("importance") * 100, 1)
    return weights.select(
        figures.display_name(F.col("feature")).alias("feature"), percent.alias("value")
    ).orderBy(F.desc("value"), "feature")


def metrics(
    rows: DataFrame, k: int = FOLDS, max_iter: int = TREES, max_depth: int = DEPTH
) -> DataFrame:
    """Accuracy, class distribution, feature weights and training size in one row."""
    spark = rows.sparkSession
    kept = settle(rows, "forecast")
    model = kept_fit(kept, max_iter, max_depth)
    classes = F.array_sort(F.collect_list(F.struct("category", "label", "videos")))
    spread = class_distribution(kept).agg(
        F.map_from_entries(
            F.transform(classes, lambda x: F.struct(x["label"], x["videos"]))
        ).alias("distribution")
    )
    weights = importance(spark, model).agg(
        F.map_from_entries(F.collect_list(F.struct("feature", "importance"))).alias(
            "feature_importance"
        )
    )
    size = kept.agg(F.count("*").alias("trained_on"))
    return beside(accuracy(cross_predictions(kept, k, max_iter, max_depth)), [spread, weights, size], [])


def slot_features(
    candidates: DataFrame, slots: DataFrame, month: int, by: Sequence[str], overall: DataFrame
) -> DataFrame:
    """Feature rows for titles that would be published at their group's best slot.

    Groups without published videos have no slot; their titles get the best one
    over all videos, the one row of ``overall``.
    """
    day = F.array_position(F.array(*[F.lit(d) for d in DAY_NAMES]), F.col("best_day")) - 1
    chosen = slots.select(*by, F.col("best_hour").alias("_hour"), day.alias("_day"))
    placed = attach(candidates, chosen, by, ["title"])
    if by:
        anywhere = overall.select(F.col("best_hour").alias("_any_hour"), day.alias("_any_day"))
        placed = attach(placed, anywhere, [], ["title"])
        placed = placed.withColumns(
            {"_hour": F.coalesce("_hour", "_any_hour"), "_day": F.coalesce("_day", "_any_day")}
        )
    return placed.select(
        *candidates.columns,
        *feature_columns(F.col("title"), F.col("_hour"), F.col("_day"), F.lit(month)),
    )

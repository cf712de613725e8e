"""From raw documents to encoded training text, in five stages.

Each stage works on all rows that the stage before kept. All but the last return the columns of
documents; ``n_chars`` follows the text where a stage changes it. Rows that share a doc_id are one
document to the stages that compare documents. Empty tables pass through every stage.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyreel.llm import languages, near, pieces, storage, suffixes, tiling

# A document goes if it has no letter, or if its language is hardly likelier than an even
# guess among the learned ones: by less than this factor.
LEAST_OVER_GUESS = 1.2
# Share of common shingles, in percent, from which two documents are near copies.
NEAR_PERCENT = 80


def _columns_of(rest: str, docs: DataFrame, **replaced: Column) -> list[Column]:
    """All columns of docs with their types, from a struct or as replaced."""
    return [
        (replaced[f.name] if f.name in replaced else F.col(f"{rest}.`{f.name}`")).cast(f.dataType).alias(f.name)
        for f in docs.schema
    ]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language the classifier recognises from their text."""
    model = languages.train_on(docs)
    found = languages.predict(docs, model)
    least = min(1.0, LEAST_OVER_GUESS / len(model.languages)) if model else 0.0
    sure = (F.col("lang_pred") != languages.UNKNOWN) & (F.col("score") >= least)
    return found.filter(sure).select(*_columns_of("rest", docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest doc_id of each group of near copies."""
    groups = near.near_duplicates(docs, percent=NEAR_PERCENT)
    gone = storage.settle(groups.filter("NOT kept").select(F.col("id").alias("doc_id")).distinct(), "near-copies")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut every 50 bytes that an earlier document holds; a text that loses all of it goes.

    The rest of a character that a cut splits goes with it.
    """
    found = suffixes.remove_repeats(docs, characters=True)
    text = F.col("kept").cast("string")
    n_chars = F.when(F.col("n_removed") == 0, F.col("rest.n_chars")).otherwise(F.char_length(text))
    kept = found.filter("n_removed = 0 OR n_removed < n_bytes")
    return kept.select(*_columns_of("rest", docs, doc_id=F.col("id"), text=text, n_chars=n_chars))


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that hold no benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    marked = tiling.mark_leaks(docs, benchmark)
    return marked.filter(F.size("matches") == 0).select(*_columns_of("rest", docs))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every text, the bytes they come from, and the text they decode to.

    Other columns stay, but for those named like one of these.
    """
    import public_tokenizers

    found = pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    made = ["ids", "begins", "ends", "decoded"]
    kept = [c for c in docs.columns if c not in ("doc_id", "text", *made)]
    return found.select(F.col("id").alias("doc_id"), *[F.col(f"rest.`{c}`").alias(c) for c in kept], *made)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    (stage.__name__, storage.with_package(stage))
    for stage in (language, near_copies, repeated_passages, leaks, encoded)
]

# SQL can express neither the classifier nor the pieces.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written before the next one reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = storage.settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

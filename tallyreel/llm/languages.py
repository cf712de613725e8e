"""Language identification: sparse multinomial logistic regression on character n-grams.

Texts become TF-IDF vectors of hashed character n-grams (one to three). The weights are learned
with follow-the-regularised-leader in its proximal form, with elastic-net penalties, on shards of
a sample in parallel; between epochs the shards' states are averaged. A temperature,
fitted on labelled rows that the weights have not seen, calibrates the probabilities.
"""

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyreel.llm import storage
from tallyreel.llm.hashing import few_rows, mix

BUCKETS = 1 << 13
LENGTHS = (1, 2, 3)
# About how many labelled rows the weights and the temperature are fitted on, and of each
# language at least, as far as it has so many.
FIT_ROWS, LEAST_ROWS = 6_000, 100
SHARDS = 4
EPOCHS = 3
# One labelled row in so many calibrates instead of teaching.
CALIBRATION = 5
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.01
UNKNOWN = "und"
SLICE_CHARS, SLICE_TEXTS = 1 << 19, 128


class Model(NamedTuple):
    """What prediction needs: a few hundred kilobytes per language."""

    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # (BUCKETS + 1, languages); the last row is the bias
    temperature: float


def _counts(texts: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """Counts of hashed n-grams, for slices of texts: first text, (texts, BUCKETS)."""
    at = 0
    while at < len(texts):
        end, chars = at, 0
        while end < len(texts) and end - at < SLICE_TEXTS and (end == at or chars + len(texts[end]) <= SLICE_CHARS):
            chars += len(texts[end])
            end += 1
        own = [t.lower() for t in texts[at:end]]
        codes = np.frombuffer("".join(own).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        row = np.repeat(np.arange(end - at), [len(t) for t in own])
        out = np.zeros((end - at) * BUCKETS, dtype=np.int64)
        for size in LENGTHS:
            n = len(codes) - size + 1
            if n < 1:
                break
            grams = np.full(n, size, dtype=np.uint64)
            for i in range(size):
                grams = (grams << np.uint64(21)) | codes[i : i + n]
            bucket = (mix(grams) % np.uint64(BUCKETS)).astype(np.int64)
            inside = row[:n] == row[size - 1 :]
            out += np.bincount((row[:n] * BUCKETS + bucket)[inside], minlength=len(out))
        yield at, out.reshape(end - at, BUCKETS)
        at = end


def _vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    values = np.log1p(counts.astype(np.float32)) * idf.astype(np.float32)
    norms = np.sqrt((values * values).sum(axis=1, keepdims=True))
    return values / np.maximum(norms, 1e-12)


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many of a task's texts each bucket occurs; bucket -1 counts the texts."""
    found, n = np.zeros(BUCKETS, dtype=np.int64), 0
    for batch in few_rows(batches):
        texts = [t or "" for t in batch.column("text").to_pylist()]
        n += len(texts)
        for _, counts in _counts(texts):
            found += (counts > 0).sum(axis=0)
    used = np.flatnonzero(found)
    columns = {"bucket": pa.array(np.append(used, -1)), "n": pa.array(np.append(found[used], n))}
    yield pa.RecordBatch.from_pydict(columns)


def _sparse(idf: np.ndarray):
    """Vectors as two binary columns: buckets (int32) and values (float32)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for at, counts in _counts(texts):
                part = batch.slice(at, len(counts))
                vectors = _vectors(counts, idf)
                used = [np.flatnonzero(c).astype(np.int32) for c in counts]
                columns = {
                    "id": part.column("id"),
                    "lang": part.column("lang"),
                    "buckets": pa.array([u.tobytes() for u in used], pa.binary()),
                    "values": pa.array([v[u].tobytes() for v, u in zip(vectors, used, strict=True)], pa.binary()),
                }
                yield pa.RecordBatch.from_pydict(columns)

    return run


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The proximal weights of a state: zero where L1 outweighs the gradients."""
    shrunk = np.sign(z) * L1 - z
    return np.where(np.abs(z) <= L1, 0.0, shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2))


def _softmax(logits: np.ndarray) -> np.ndarray:
    powers = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return powers / powers.sum(axis=-1, keepdims=True)


def _teach(languages: list[str], z: np.ndarray, n: np.ndarray, epoch: int):
    """One epoch over a shard from a common state."""

    def run(table: pa.Table) -> pa.Table:
        number = {lang: i for i, lang in enumerate(languages)}
        own_z, own_n = z.copy(), n.copy()
        ids = table.column("id").to_numpy().astype(np.uint64)
        order = np.lexsort((ids, mix(ids + np.uint64(epoch))))
        langs = table.column("lang").to_pylist()
        buckets, values = table.column("buckets").to_pylist(), table.column("values").to_pylist()
        for i in order.tolist():
            at = np.append(np.frombuffer(buckets[i], dtype=np.int32), BUCKETS)
            x = np.append(np.frombuffer(values[i], dtype=np.float32), 1.0).astype(np.float64)[:, None]
            weights = _weights(own_z[at], own_n[at])
            error = _softmax((x * weights).sum(axis=0))
            error[number[langs[i]]] -= 1.0
            gradient = x * error
            after = own_n[at] + gradient * gradient
            sigma = (np.sqrt(after) - np.sqrt(own_n[at])) / ALPHA
            own_z[at] += gradient - sigma * weights
            own_n[at] = after
        return pa.table({"z": pa.array([own_z.tobytes()], pa.binary()), "n": pa.array([own_n.tobytes()], pa.binary())})

    return run


def _temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least negative log likelihood, by golden-section search.

    Targets are smoothed by one row in as many as there are plus two, so that rows without a
    mistake don't call for certainty.
    """
    if not len(labels):
        return 1.0
    doubt = 1.0 / (len(labels) + 2)
    target = np.full(logits.shape, doubt / logits.shape[1])
    target[np.arange(len(labels)), labels] += 1.0 - doubt

    def loss(log_t: float) -> float:
        return float(-(target * np.log(np.maximum(_softmax(logits / np.exp(log_t)), 1e-300))).sum(axis=1).mean())

    low, high, step = -4.0, 4.0, (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - step * (high - low), low + step * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def train(labelled: DataFrame, fit_rows: int = FIT_ROWS) -> Model | None:
    """Learn from columns id, text and lang (none null); None without rows.

    Document frequencies are counted over all rows, and every language that occurs is learned.
    Weights and temperature are fitted on about ``fit_rows`` rows, with LEAST_ROWS of each language,
    chosen by the hash of their ids. Equal input gives an equal model, however it is partitioned.
    """
    counted = labelled.select("text").mapInArrow(_document_counts, "bucket long, n long")
    frequency = {r["bucket"]: r["n"] for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}
    total = frequency.pop(-1, 0)
    if not total:
        return None
    known = np.zeros(BUCKETS)
    known[list(frequency)] = list(frequency.values())
    idf = np.log((1.0 + total) / (1.0 + known)) + 1.0

    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = 1 << 20
    wanted = {lang: max(LEAST_ROWS / n, fit_rows / total) for lang, n in sizes.items()}
    limits = F.create_map(*[F.lit(x) for l, w in wanted.items() for x in (l, int(parts * min(1.0, w)) + 1)])
    chosen = F.pmod(F.xxhash64("id"), F.lit(parts)) < limits[F.col("lang")]
    schema = "id long, lang string, buckets binary, values binary"
    with storage.scratch(labelled.sparkSession) as settle:
        vectors = labelled.filter(chosen).select("id", "text", "lang").mapInArrow(_sparse(idf), schema)
        return _fitted(settle(vectors, "vectors"), idf, sizes)


def _fitted(sample: DataFrame, idf: np.ndarray, sizes: dict[str, int]) -> Model:
    """Weights and temperature from a sample's vectors."""
    languages = sorted(sizes)
    rare = F.col("lang").isin([lang for lang, n in sizes.items() if n < LEAST_ROWS])  # these all teach
    turn = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(CALIBRATION * SHARDS))
    # The few rows of a rare language teach every shard, as averaging over shards without any would drown them.
    every, one = F.array(*[F.lit(i).cast("long") for i in range(SHARDS)]), F.array(F.pmod(turn, F.lit(SHARDS)))
    taught = sample.filter((turn >= SHARDS) | rare).withColumn("shard", F.explode(F.when(rare, every).otherwise(one)))
    z, n = (np.zeros((BUCKETS + 1, len(languages))) for _ in range(2))
    for epoch in range(EPOCHS):
        shards = taught.groupBy("shard").applyInArrow(_teach(languages, z, n, epoch), "z binary, n binary").collect()
        z = np.mean(np.sort([np.frombuffer(r["z"]) for r in shards], axis=0), axis=0).reshape(z.shape)
        n = np.mean(np.sort([np.frombuffer(r["n"]) for r in shards], axis=0), axis=0).reshape(n.shape)
    weights = _weights(z, n)

    held = sample.filter((turn < SHARDS) & ~rare).orderBy("id").collect()
    logits = np.zeros((len(held), len(languages)))
    for i, row in enumerate(held):
        at = np.frombuffer(row["buckets"], dtype=np.int32)
        logits[i] = np.frombuffer(row["values"], dtype=np.float32) @ weights[at] + weights[BUCKETS]
    labels = np.array([languages.index(r["lang"]) for r in held], dtype=np.int64)
    return Model(languages, idf, weights, _temperature(logits, labels))


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = model.weights.astype(np.float32)
        for batch in few_rows(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for at, counts in _counts(texts):
                logits = _vectors(counts, model.idf) @ weights[:-1] + weights[-1]
                chance = _softmax(logits.astype(np.float64) / model.temperature)
                part = batch.slice(at, len(counts))
                best = chance.argmax(axis=1)
                columns = {
                    "text": part.column("text"),
                    "rest": part.column("rest"),
                    "lang_pred": pa.array([model.languages[b] for b in best.tolist()], pa.string()),
                    "score": pa.array(chance[np.arange(len(best)), best]),
                }
                yield pa.RecordBatch.from_pydict(columns)

    return run


def predict(docs: DataFrame, model: Model | None, text_column: str = "text") -> DataFrame:
    """``rest`` (the struct of all input columns), lang_pred and score, the calibrated probability.

    A text that is null or has no letter is ``und`` with score 0, as is every text if
    there is no model. Rows stay as they are, repeated ones included.
    """
    text = F.col(f"`{text_column}`").alias("text")
    rows = docs.select(text, storage.others(docs, text_column).alias("rest"))  # each text goes to a task once
    back = {c: F.col("text") if c == text_column else F.col(f"rest.`{c}`") for c in docs.columns}
    whole = F.struct(*[value.alias(c) for c, value in back.items()]).alias("rest")
    if model is None:
        return rows.select(whole, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    answer = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    found = rows.mapInArrow(_predict(model), T.StructType([*rows.schema, *answer]))
    letters = F.coalesce(F.rlike("text", F.lit(r"\p{L}")), F.lit(False))
    return found.select(
        whole,
        F.when(letters, F.col("lang_pred")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(letters, F.col("score")).otherwise(0.0).alias("score"),
    )


def held_out(docs: DataFrame, id_column: str = "doc_id"):
    """Rows that are never learned from: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.pmod(F.crc32(F.col(f"`{id_column}`").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train_on(docs: DataFrame) -> Model | None:
    """Learn from documents with text, lang and an id that is not held out."""
    rows = docs.select(F.col("doc_id").alias("id"), "text", "lang", held_out(docs).alias("held"))
    return train(rows.filter("NOT held AND id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL").drop("held"))


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    """Per document: whether it was held out, and the language predicted from its text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    texts = docs.select("doc_id", "text", held_out(docs).alias("held_out"))
    return predict(texts, train_on(docs)).select(
        F.col("rest.doc_id").alias("doc_id"), F.col("rest.held_out").alias("held_out"), "lang_pred", "score"
    )

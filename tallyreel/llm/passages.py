"""Removal of word passages that an earlier document already holds (difference-cover anchors).

Places 0, 1 and 3 modulo 7 form a difference cover: for any two places there is a shift
below 7 that takes both into the cover. So two equal passages of 13 words, wherever they
lie in their texts, share a window of 7 words that begins at a cover place of both. Only
windows at cover places are hashed and compared over the corpus. Around a shared anchor the
match is extended: the 13-word windows that hold it are compared by 128-bit hash, and a
window whose smallest document is an earlier one marks its words.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyreel.llm import exchange, storage
from tallyreel.llm.hashing import Words, slices, text_bytes

# A perfect difference cover, its period, and the words a passage must have.
COVER = (0, 1, 3)
PERIOD = 7
PASSAGE_WORDS = 13
ANCHOR_WORDS = PASSAGE_WORDS - PERIOD + 1
LAST_ID = (1 << 63) - 1


def _slices(table: pa.Table) -> Iterator[tuple[Words, np.ndarray, tuple[int, int], np.ndarray]]:
    data, offsets = text_bytes(table.column("text"))
    ids = table.column("id").fill_null(LAST_ID).to_numpy()
    for a, b in slices(offsets):
        own = offsets[a : b + 1] - offsets[a]
        part = data[offsets[a] : offsets[b]]
        yield Words(part, own), ids[a:b], (a, b), part


def _anchors(words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors and their hashes."""
    at = np.isin(words.place() % PERIOD, COVER) & (words.left() >= ANCHOR_WORDS)
    at &= np.repeat(words.counts, words.counts) >= PASSAGE_WORDS
    places = np.flatnonzero(at)
    return places, words.runs(ANCHOR_WORDS, hashes)[places]


def _candidates(words: Words, hashes: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """First words of the passages that hold a shared anchor."""
    places, keys = _anchors(words, hashes)
    marked = np.zeros(len(words) + PERIOD + 1, dtype=np.int32)
    marked[places[exchange.contains(shared, keys)] + 1] = 1
    seen = np.cumsum(marked)
    near = seen[PERIOD : PERIOD + len(words)] - seen[: len(words)] > 0
    return np.flatnonzero(near & (words.left() >= PASSAGE_WORDS))


def _passages(words: Words, hashes: np.ndarray, at: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """The hash and document of the passages from the given words on."""
    out = np.empty(len(at), dtype=exchange.FIRST)
    out["k"] = words.runs(PASSAGE_WORDS, hashes)[at]
    out["h"] = words.runs(PASSAGE_WORDS, words.hashes(1), 1)[at] if len(at) else 0
    out["doc"] = docs[words.text_of()[at]]
    return out


def _send_anchors(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        keys, docs = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
        for words, ids, _, _ in _slices(table):
            places, found = _anchors(words, words.hashes())
            keys.append(found)
            docs.append(ids[words.text_of()[places]])
        records = exchange.combine_keys(np.concatenate(keys), np.concatenate(docs))
        return exchange.send(records, exchange.chunk_of(table), buckets)

    return run


def _send_passages(buckets: int):
    def run(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows or not told.num_rows:
            return exchange.send(np.zeros(0, dtype=exchange.FIRST), 0, buckets)
        shared = np.sort(exchange.answers(told, 1, np.dtype("<u8")))
        found = [np.zeros(0, dtype=exchange.FIRST)]
        for words, ids, _, _ in _slices(table):
            hashes = words.hashes()
            found.append(_passages(words, hashes, _candidates(words, hashes, shared), ids))
        records = exchange.combine_firsts(np.concatenate(found))
        return exchange.send(records, exchange.chunk_of(table), buckets)

    return run


def _remove(table: pa.Table, told: pa.Table) -> pa.Table:
    n = table.num_rows
    shared = np.sort(exchange.answers(told, 1, np.dtype("<u8")))
    earlier = exchange.answers(told, 2, exchange.FIRST)
    parts = list(_slices(table)) if n else []
    found = []
    for words, ids, _, _ in parts:
        hashes = words.hashes()
        at = _candidates(words, hashes, shared)
        found.append((at, _passages(words, hashes, at, ids)))
    # The buckets tell of other chunks; what lies in the chunk itself it knows.
    firsts = exchange.combine_firsts(np.concatenate([earlier, *(f for _, f in found)]))
    n_words, n_removed, kept = np.zeros(n, np.int64), np.zeros(n, np.int64), []
    for (words, _, (a, b), data), (at, passages) in zip(parts, found, strict=True):
        place = exchange.lookup(firsts, passages["k"], passages["h"])
        begins = at[firsts["doc"][place] < passages["doc"]]
        depth = np.zeros(len(words) + 1, dtype=np.int32)
        depth[begins] += 1
        depth[begins + PASSAGE_WORDS] -= 1
        gone = np.cumsum(depth[:-1]) > 0
        n_words[a:b] = words.counts
        n_removed[a:b] = np.bincount(words.text_of(), weights=gone, minlength=b - a)
        kept.extend(_kept_texts(words, data, ~gone))
    columns = {
        "id": table.column("id"),
        "n_words": pa.array(n_words),
        "n_removed": pa.array(n_removed),
        "kept_text": pa.array(kept, pa.string()),
        "rest": table.column("rest"),
    }
    return pa.table(columns)


def _kept_texts(words: Words, data: np.ndarray, keep: np.ndarray) -> list[str]:
    """The kept words of each text, joined by one space."""
    text = words.text_of()[keep]
    starts, ends = words.starts[keep], words.ends[keep]
    more = np.zeros(len(starts), dtype=bool)  # another kept word of the text follows
    more[:-1] = text[1:] == text[:-1]
    level = np.zeros(len(data) + 2, dtype=np.int8)
    level[starts] += 1
    level[ends] -= 1
    taken = np.cumsum(level[:-2], dtype=np.int8) > 0
    gaps = ends[more]  # the separator after a word stands for the one space
    taken[gaps] = True
    out = data.copy()
    out[gaps] = 0x20
    sizes = np.zeros(len(words.counts), dtype=np.int64)
    np.add.at(sizes, text, ends - starts + more)
    whole = out[taken].tobytes()
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    return [whole[a:b].decode("utf-8", "replace") for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Remove each word covered by 13 words that also start in a document with a smaller id.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged; passages never cross documents and are
    judged on the input. Returns ``id, n_words, n_removed, kept_text`` and ``rest``, the
    struct of all other columns. A null or empty text has no words; texts under 13 words
    lose none. A null id counts as larger than every id. Rows that repeat an id don't
    remove each other's words. Memory is bounded by a chunk of 16 MB or the longest text.
    """
    rows = docs.select(
        F.col(f"`{id_column}`").cast("long").alias("id"),
        F.col(f"`{text_column}`").alias("text"),
        storage.others(docs, id_column, text_column).alias("rest"),
    )
    chunks = storage.chunk_count(rows, "text")
    kept = storage.settle_in_chunks(rows.withColumn("chunk", storage.spread(chunks)), chunks, "passages")
    texts = kept.select("chunk", "id", "text")
    sent = texts.groupBy("chunk").applyInArrow(_send_anchors(chunks), exchange.SENT)
    shared = storage.settle(
        sent.groupBy("bucket").applyInArrow(lambda t: exchange.shared_keys(t, 1), exchange.ANSWER), "anchors"
    )
    sent = (
        texts.groupBy("chunk")
        .cogroup(shared.groupBy("chunk"))
        .applyInArrow(_send_passages(chunks), exchange.SENT)
    )
    earlier = sent.groupBy("bucket").applyInArrow(lambda t: exchange.earlier_firsts(t, 2), exchange.ANSWER)
    told = shared.unionByName(earlier).groupBy("chunk")
    schema = T.StructType(
        [
            T.StructField("id", T.LongType()),
            T.StructField("n_words", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField("kept_text", T.StringType()),
            kept.schema["rest"],
        ]
    )
    return kept.groupBy("chunk").cogroup(told).applyInArrow(_remove, schema)


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Per document: its words, how many passages of earlier documents took, and the rest's digest."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select(
        F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")
    )

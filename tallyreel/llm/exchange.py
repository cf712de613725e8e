"""Hash records exchanged between chunks of documents and buckets of hashes.

A chunk sends each bucket its records as one binary value, combined beforehand, so a key
that many documents share crosses the network once a chunk, however many copies there
are. A bucket answers each chunk likewise. Records are numpy structures whose first
field ``k`` is a mixed 64-bit hash; buckets are equal ranges of it.
"""

import numpy as np
import pyarrow as pa

SENT = "bucket int, chunk int, payload binary"
ANSWER = "chunk int, kind int, payload binary"
_SENT_ARROW = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("payload", pa.binary())])
_ANSWER_ARROW = pa.schema([("chunk", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary())])


def chunk_of(table: pa.Table) -> int:
    return table.column("chunk")[0].as_py()


def send(records: np.ndarray, chunk: int, buckets: int) -> pa.Table:
    """Deal records that are sorted by k to their buckets."""
    bucket = ((records["k"] >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    targets, cuts = np.unique(bucket, return_index=True)
    parts = np.split(records, cuts[1:]) if len(records) else []
    return pa.table(
        [
            pa.array(targets.astype(np.int32)),
            pa.array(np.full(len(targets), chunk, dtype=np.int32)),
            pa.array([p.tobytes() for p in parts], pa.binary()),
        ],
        schema=_SENT_ARROW,
    )


def unpack(payloads: pa.ChunkedArray, dtype: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(payloads.to_pylist()), dtype=dtype)


def received(table: pa.Table, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All records of a bucket and the chunk that sent each."""
    sizes = [len(p) // dtype.itemsize for p in table.column("payload").to_pylist()]
    return unpack(table.column("payload"), dtype), np.repeat(table.column("chunk").to_numpy(), sizes)


def answer(records: np.ndarray, chunks: np.ndarray, kind: int) -> pa.Table:
    """Records sorted back to the chunks they are for."""
    order = np.argsort(chunks, kind="stable")
    targets, cuts = np.unique(chunks[order], return_index=True)
    parts = np.split(records[order], cuts[1:]) if len(records) else []
    return pa.table(
        [
            pa.array(targets.astype(np.int32)),
            pa.array(np.full(len(targets), kind, dtype=np.int32)),
            pa.array([p.tobytes() for p in parts], pa.binary()),
        ],
        schema=_ANSWER_ARROW,
    )


def answers(table: pa.Table, kind: int, dtype: np.dtype) -> np.ndarray:
    """What the buckets sent a chunk under this kind."""
    kinds = table.column("kind").to_numpy()
    return unpack(table.column("payload").filter(pa.array(kinds == kind)), dtype)


def changes(*columns: np.ndarray) -> np.ndarray:
    """True where a sorted row differs from the one before it in any column."""
    first = np.ones(len(columns[0]), dtype=bool)
    for i, column in enumerate(columns):
        differs = column[1:] != column[:-1]
        first[1:] = differs if i == 0 else first[1:] | differs
    return first


# Keys of round one: is a key in more than one document?
KEY = np.dtype([("k", "<u8"), ("many", "u1")])


def combine_keys(keys: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """One sorted record per key: does it come from several documents?"""
    order = np.argsort(keys, kind="stable")
    keys, docs = keys[order], docs[order]
    first = changes(keys)
    group = np.cumsum(first) - 1
    out = np.zeros(int(first.sum()), dtype=KEY)
    out["k"] = keys[first]
    inside = ~first
    inside[1:] &= docs[1:] != docs[:-1]
    out["many"][group[inside]] = 1
    return out


def shared_keys(table: pa.Table, kind: int) -> pa.Table:
    """Of a bucket's keys, those that lie in more than one document, to all who sent them."""
    records, chunks = received(table, KEY)
    order = np.argsort(records["k"], kind="stable")
    records, chunks = records[order], chunks[order]
    first = changes(records["k"])
    group = np.cumsum(first) - 1
    shared = (np.bincount(group) > 1) | (np.bincount(group, weights=records["many"]) > 0)
    keep = shared[group]
    return answer(records["k"][keep], chunks[keep], kind)


# Keys of 128 bits with the smallest document that holds them.
FIRST = np.dtype([("k", "<u8"), ("h", "<u8"), ("doc", "<i8")])


def combine_firsts(records: np.ndarray) -> np.ndarray:
    """One sorted record per key, with its smallest document."""
    records = records[np.lexsort((records["doc"], records["h"], records["k"]))]
    return records[changes(records["k"], records["h"])]


def earlier_firsts(table: pa.Table, kind: int) -> pa.Table:
    """To each chunk the keys that an earlier document outside the chunk holds too."""
    records, chunks = received(table, FIRST)
    order = np.lexsort((records["doc"], records["h"], records["k"]))
    records, chunks = records[order], chunks[order]
    first = changes(records["k"], records["h"])
    group = np.cumsum(first) - 1
    found = records.copy()
    found["doc"] = records["doc"][first][group]
    keep = found["doc"] < records["doc"]
    return answer(found[keep], chunks[keep], kind)


def lookup(table: np.ndarray, keys: np.ndarray, others: np.ndarray) -> np.ndarray:
    """For each 128-bit key its place in a table sorted by (k, h), or -1."""
    if not len(table) or not len(keys):
        return np.full(len(keys), -1)
    at = np.searchsorted(table["k"], keys)
    found = np.full(len(keys), -1)
    todo = np.arange(len(keys))
    while len(todo):  # more than once only where two keys agree in their first 64 bits
        here = at[todo]
        inside = here < len(table)
        todo, here = todo[inside], here[inside]
        same = table["k"][here] == keys[todo]
        todo, here = todo[same], here[same]
        hit = table["h"][here] == others[todo]
        found[todo[hit]] = here[hit]
        todo = todo[~hit]
        at[todo] += 1
    return found


def contains(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys are in a sorted table."""
    if not len(table) or not len(keys):
        return np.zeros(len(keys), dtype=bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return table[at] == keys


# Keys of round one at half the size. A bucket holds about as many keys as a chunk, whatever
# the size of the corpus, so 32 bits within a bucket leave few keys that only seem shared;
# later rounds compare whole hashes.
SHORT = np.dtype([("k", "<u4"), ("many", "u1")])
SHORT_ANSWER = "chunk int, bucket int, payload binary"
_SHORT_ARROW = pa.schema([("chunk", pa.int32()), ("bucket", pa.int32()), ("payload", pa.binary())])


def short(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket (upper half) and the 32 bits of a key that are compared in it."""
    bucket = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    return (bucket << np.uint64(32)) | (keys & np.uint64(0xFFFFFFFF))


def send_short(keys: np.ndarray, docs: np.ndarray, chunk: int, buckets: int) -> pa.Table:
    """One record per short key, dealt to the buckets."""
    records = combine_keys(short(keys, buckets), docs)
    targets, cuts = np.unique(records["k"] >> np.uint64(32), return_index=True)
    out = np.empty(len(records), dtype=SHORT)
    out["k"], out["many"] = records["k"] & np.uint64(0xFFFFFFFF), records["many"]
    parts = np.split(out, cuts[1:]) if len(out) else []
    return pa.table(
        [
            pa.array(targets.astype(np.int32)),
            pa.array(np.full(len(targets), chunk, dtype=np.int32)),
            pa.array([p.tobytes() for p in parts], pa.binary()),
        ],
        schema=_SENT_ARROW,
    )


def shared_short(table: pa.Table) -> pa.Table:
    """Of a bucket's short keys, those that lie in more than one document, to all who sent them."""
    records, chunks = received(table, SHORT)
    order = np.argsort(records["k"], kind="stable")
    records, chunks = records[order], chunks[order]
    group = np.cumsum(changes(records["k"])) - 1
    shared = (np.bincount(group) > 1) | (np.bincount(group, weights=records["many"]) > 0)
    keep = shared[group]
    keys, chunks = records["k"][keep], chunks[keep]
    order = np.argsort(chunks, kind="stable")
    targets, cuts = np.unique(chunks[order], return_index=True)
    parts = np.split(keys[order], cuts[1:]) if len(keys) else []
    return pa.table(
        [
            pa.array(targets.astype(np.int32)),
            pa.array(np.full(len(targets), table.column("bucket")[0].as_py(), dtype=np.int32)),
            pa.array([p.tobytes() for p in parts], pa.binary()),
        ],
        schema=_SHORT_ARROW,
    )


def short_answers(told: pa.Table) -> np.ndarray:
    """The shared keys of a chunk, as ``short`` gives them, sorted."""
    parts = [
        np.frombuffer(payload, dtype="<u4").astype(np.uint64) | (np.uint64(bucket) << np.uint64(32))
        for bucket, payload in zip(told.column("bucket").to_pylist(), told.column("payload").to_pylist(), strict=True)
    ]
    return np.sort(np.concatenate([np.zeros(0, dtype=np.uint64), *parts]))

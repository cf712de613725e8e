"""Encoding into the pieces of a SentencePiece model, with the source bytes of every piece.

A text is first normalised: at each place the longest key of the model's compiled
character map is replaced by its value, else one character is kept, and the source byte of
every normalised byte is recorded. The normalised text is cut where a word ends and the
next one's space mark begins, which no piece of a BPE vocabulary crosses; the pieces of
each cut come from the library, once per distinct cut. Their lengths, added up, are
places in the normalised text, and the record takes them back to bytes of the source.
"""

import re
import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyreel.llm import storage
from tallyreel.llm.hashing import few_rows

SPACE = "▁"
UNKNOWN = "�"
# Distinct cuts that a Python worker remembers; beyond it starts anew.
REMEMBERED = 150_000
SLICE_CHARS = 1 << 19
_CUTS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def message_fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(message):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, message[at : at + size]
        at += size


class CharacterMap:
    """The compiled character map: a double-array trie and the values its leaves point to."""

    def __init__(self, blob: bytes) -> None:
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, dtype="<u4", count=size // 4, offset=4).tolist() if blob else []
        self.values = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[bytes, int] | None:
        """The value of the longest key at a place, and the length of the key."""
        if not self.units:
            return None
        found = None
        unit = self.units[0]
        node = (unit >> 10) << ((unit & 0x200) >> 6)
        for i in range(at, len(text)):
            node ^= text[i]
            unit = self.units[node]
            if unit & 0x800000FF != text[i]:
                break
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit & 0x100:
                found = (self.units[node] & 0x7FFFFFFF, i + 1 - at)
        if found is None:
            return None
        return self.values[found[0] : self.values.index(b"\0", found[0])], found[1]


class Normalised(NamedTuple):
    text: str
    source: np.ndarray  # source byte of each normalised byte, and of the end


class Normaliser:
    """What a model does to a text before it looks for pieces."""

    def __init__(self, model: bytes) -> None:
        spec = {n: v for f, m in message_fields(model) if f == 3 for n, v in message_fields(m)}
        self.map = CharacterMap(spec.get(2, b""))
        self.add_space = bool(spec.get(3, 1))
        self.trim = bool(spec.get(4, 1))
        self.mark = SPACE.encode() if spec.get(5, 1) else b" "
        self.plain = not self.map.units and not self.trim

    def __call__(self, text: str) -> Normalised:
        data = text.encode("utf-8", "replace")
        if not data:
            return Normalised("", np.zeros(1, dtype=np.int32))
        return self._plain(text, data) if self.plain else self._mapped(data)

    def _plain(self, text: str, data: bytes) -> Normalised:
        width = len(self.mark)
        sizes = np.where(np.frombuffer(data, dtype=np.uint8) == 0x20, width, 1)
        lead = width if self.add_space else 0
        source = np.concatenate([np.zeros(lead, dtype=np.int32), np.repeat(np.arange(len(data), dtype=np.int32), sizes)])
        mark = self.mark.decode()
        out = (mark if lead else "") + text.replace(" ", mark)
        return Normalised(out, np.append(source, np.int32(len(data))))

    def _mapped(self, data: bytes) -> Normalised:
        out, source, at, after_space = bytearray(), [], 0, self.trim
        for value, size in self._steps(data):
            if after_space:
                value = value.lstrip(b" ")
            if value:
                if not out and self.add_space:
                    out += self.mark
                    source += [at] * len(self.mark)
                new = value.replace(b" ", self.mark)
                out += new
                source += [at] * len(new)
                after_space = self.trim and value.endswith(b" ")
            at += size
        while self.trim and out.endswith(self.mark):
            at = source[len(out) - len(self.mark)]
            del out[len(out) - len(self.mark) :], source[len(out) :]
        return Normalised(out.decode("utf-8", "replace"), np.array([*source, at], dtype=np.int32))

    def _steps(self, data: bytes) -> Iterator[tuple[bytes, int]]:
        at = 0
        while at < len(data):
            found = self.map.longest(data, at)
            if found is None:
                lead = data[at]
                size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                found = data[at : at + size], size
            yield found
            at += found[1]


class Encoder:
    """Pieces and their source bytes, for texts of any length."""

    def __init__(self, model: bytes) -> None:
        self.normalise = Normaliser(model)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        # The last value of a repeated field counts: no map, no added space, no trimming.
        identity = bytes([2 << 3 | 2, 0, 3 << 3, 0, 4 << 3, 0])
        self.cutter = sentencepiece.SentencePieceProcessor(
            model_proto=model + bytes([3 << 3 | 2, len(identity)]) + identity
        )
        pieces = [self.library.id_to_piece(i) for i in range(self.library.vocab_size())]
        self.splits = not any(SPACE in p.lstrip(SPACE) for p in pieces)
        self.sizes = np.array(
            [1 if self.library.is_byte(i) else len(p.encode()) for i, p in enumerate(pieces)], dtype=np.int32
        )
        self.unknown = self.library.unk_id()
        self.known: dict[str, bytes] = {}
        # Sizes of the pieces of cuts with unknown ones, which are as long as their text.
        self.odd: dict[str, bytes] = {}

    def _learn(self, cuts: set[str]) -> None:
        new = [c for c in cuts if c not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            self.odd.clear()
            new = list(cuts)
        found = self.cutter.encode(new, num_threads=1)
        ends = np.cumsum([len(ids) for ids in found]).tolist()
        ids = np.array([i for own in found for i in own], dtype=np.int32)
        all_ids, at = ids.tobytes(), 0
        for cut, end in zip(new, ends, strict=True):
            self.known[cut] = all_ids[4 * at : 4 * end]
            at = end
        if (ids == self.unknown).any():
            for cut, own in zip(new, found, strict=True):
                if self.unknown in own:
                    texts = self.cutter.encode(cut, out_type=str)
                    pairs = zip(own, texts, strict=True)
                    sizes = [len(t.encode()) if i == self.unknown else self.sizes[i] for i, t in pairs]
                    self.odd[cut] = np.array(sizes, dtype=np.int32).tobytes()

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Piece ids of each text, and the first and the last-plus-one source byte of each piece."""
        normal = [self.normalise(t) for t in texts]
        cuts = [_CUTS.findall(n.text) if self.splits else [n.text] if n.text else [] for n in normal]
        self._learn(set().union(*cuts))
        out = []
        for own, n in zip(cuts, normal, strict=True):
            ids = np.frombuffer(b"".join([self.known[c] for c in own]), dtype=np.int32)
            sizes = self.sizes[ids]
            if self.odd and any(c in self.odd for c in own):
                each = [self.odd.get(c) or self.sizes[np.frombuffer(self.known[c], dtype=np.int32)].tobytes() for c in own]
                sizes = np.frombuffer(b"".join(each), dtype=np.int32)
            ends = np.cumsum(sizes)
            out.append((ids, n.source[ends - sizes], n.source[ends]))
        return out

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        return self.library.decode([i.tolist() for i in ids]) if ids else []


_encoders: dict[bytes, Encoder] = {}


def encoder(model: bytes) -> Encoder:
    """The worker's encoder of a model, with what it remembers."""
    if model not in _encoders:
        _encoders.clear()
        _encoders[model] = Encoder(model)
    return _encoders[model]


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    flat = np.concatenate([np.zeros(0, dtype=np.int32), *arrays]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _encode_batches(model: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model)
        for batch in few_rows(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            sizes = np.cumsum([len(t) for t in texts])
            at = 0
            while at < len(texts):
                done = sizes[at - 1] if at else 0
                end = max(at + 1, int(np.searchsorted(sizes, done + SLICE_CHARS)))
                found = own.encode(texts[at:end])
                part = batch.slice(at, len(found))
                columns = {
                    "id": part.column("id"),
                    "ids": _lists([f[0] for f in found]),
                    "begins": _lists([f[1] for f in found]),
                    "ends": _lists([f[2] for f in found]),
                    "decoded": pa.array(own.decode([f[0] for f in found]), pa.string()),
                    "rest": part.column("rest"),
                }
                yield pa.RecordBatch.from_pydict(columns)
                at = end

    return run


def encode(docs: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encode whole texts and decode the pieces again.

    Returns ``id``, ``ids`` (without begin or end ids), ``begins`` and ``ends`` (the source
    bytes of each piece, UTF-8; a byte piece stands for one byte), ``decoded`` and ``rest``, the
    struct of all other columns. A null text is encoded as an empty one, which has no pieces.
    The model file is read where the driver runs and is part of the job: vocabularies are a
    few megabytes. No row moves; repeated rows and ids stay as they are.
    """
    with open(model_path, "rb") as file:
        model = file.read()
    rows = docs.select(
        F.col(f"`{id_column}`").alias("id"),
        F.col(f"`{text_column}`").alias("text"),
        storage.others(docs, id_column, text_column).alias("rest"),
    )
    integers = T.ArrayType(T.IntegerType())
    schema = T.StructType(
        [
            rows.schema["id"],
            *(T.StructField(c, integers) for c in ("ids", "begins", "ends")),
            T.StructField("decoded", T.StringType()),
            rows.schema["rest"],
        ]
    )
    return rows.mapInArrow(_encode_batches(model), schema)


def op1_sentencepiece(spark, sf_dir: str, model_path: str | None = None) -> DataFrame:
    """Per document: how many pieces, and digests of their ids and of the text they decode to."""
    if model_path is None:
        import public_tokenizers

        model_path = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    numbers = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encode(docs, model_path).select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(numbers, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )

"""Secrets in texts: three plain patterns, and encoded keys confirmed by their structure.

A pattern alone says little of an encoded string. Candidates in base64 (either alphabet, also
broken into lines) or hex are therefore decoded and their content must parse:

* ``key``: a private key in DER. Every nested length must fit, and the fields must be those of
  PKCS #1, DSA, SEC 1, PKCS #8 or encrypted PKCS #8. The outer length says where the key ends.
* ``ssh``: a private key in OpenSSH's form, whose length-prefixed strings must nest.
* ``signed``: a signed token. Header and claims are JSON objects, the header names a known
  algorithm, and the signature has that algorithm's length.
* ``encoded``: base64 or hex of printable text in which one of the others, or a plain pattern,
  is found again (down to DEPTH levels).

Only the first bytes of a candidate are decoded until they look right, and a key has a greatest
size, so a long encoded image costs little more than its scan.
"""

import base64
import binascii
import json
import re
from bisect import bisect
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyreel.llm import storage
from tallyreel.llm.hashing import few_rows

BASE_KINDS = ["assign", "access", "hex"]
KINDS = [*BASE_KINDS, "key", "ssh", "signed", "encoded"]
SPANS = T.ArrayType(
    T.StructType(
        [
            T.StructField("kind", T.StringType(), False),
            T.StructField("start", T.LongType(), False),
            T.StructField("end", T.LongType(), False),
        ]
    ),
    False,
)
DEPTH = 2
# Shorter text is not decoded in search of a secret.
LEAST_ENCODED = 20

# The plain patterns, and the least lengths of their values.
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 8, 16, 32
# Without the shorter matches of [0-9a-f]+: one of 32 begins where its run does.
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{%d,}" % LEAST_HEX)

# Signature bytes by algorithm; None for those of RSA, which have the length of their key.
SIGNATURE_BYTES = {
    "HS256": 32,
    "HS384": 48,
    "HS512": 64,
    "ES256": 64,
    "ES256K": 64,
    "ES384": 96,
    "ES512": 132,
    "EdDSA": 64,
    "RS256": None,
    "RS384": None,
    "RS512": None,
    "PS256": None,
    "PS384": None,
    "PS512": None,
}
RSA_SIGNATURE_BYTES = range(128, 1025)
SSH_MAGIC = b"openssh-key-v1\0"

# A key has no more bytes than this, so its length takes two bytes at most.
MOST_KEY = 1 << 16

_LETTER = r"[A-Za-z0-9+/_-]"
# Where a run of base64 letters begins; in quoted text an n may stand before it, from a written line end.
_BEGIN = r"(?:(?<![A-Za-z0-9+/_-])|(?<=\\n))"
# DER begins with the byte 0x30, so in base64 with M and one of A to P; the other is SSH_MAGIC.
_KEY_BEGIN = re.compile(_BEGIN + r"(?=M[A-P]" + _LETTER + r"{14}|b3BlbnNzaC1rZXktdjE)")
_PART = re.compile(r"(" + _LETTER + r"+)(?:(?:\r?\n|\\n)(?=" + _LETTER + r"))?")
# Base64 of "{" begins with e and one of these; header and claims are JSON objects.
_SIGNED = re.compile(_BEGIN + r"e[w-z0-9_-][A-Za-z0-9_-]+\.e[w-z0-9_-][A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")
_BASE64 = re.compile(_BEGIN + _LETTER + r"{%d,}={0,2}(?:(?:\r?\n|\\n)" % LEAST_ENCODED + _LETTER + r"+={0,2})*")
_BREAK = re.compile(r"\r?\n|\\n")
_PLAIN_HEX = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{40,}")
_WORDS = ("passw", "secret", "token", "api")


class Span(NamedTuple):
    kind: str
    start: int
    end: int


def base_spans(text: str) -> list[Span]:
    """What the plain patterns find: leftmost, not overlapping within a kind, and long enough."""
    found = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [Span("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [Span("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    found += [Span("hex", *m.span()) for m in HEX.finditer(text)]
    return found


def _header(data: bytes, at: int) -> tuple[int, int, int] | None:
    """Tag, begin and end of the DER value at a place; None if the length isn't in its shortest form."""
    if at + 2 > len(data):
        return None
    tag, first = data[at], data[at + 1]
    if first < 0x80:
        return tag, at + 2, at + 2 + first
    size = first & 0x7F
    if not 1 <= size <= 2 or at + 2 + size > len(data):
        return None
    length = int.from_bytes(data[at + 2 : at + 2 + size], "big")
    if length < 0x80 or length >> (8 * (size - 1)) == 0:
        return None
    return tag, at + 2 + size, at + 2 + size + length


def _children(data: bytes) -> list[tuple[int, bytes]] | None:
    """The values inside a constructed one, if their lengths add up to it."""
    out, at = [], 0
    while at < len(data):
        head = _header(data, at)
        if head is None or head[2] > len(data):
            return None
        out.append((head[0], data[head[1] : head[2]]))
        at = head[2]
    return out


INTEGER, BITS, OCTETS, OID, SEQUENCE = 0x02, 0x03, 0x04, 0x06, 0x30


def _names_algorithm(value: bytes) -> bool:
    inner = _children(value)
    return bool(inner) and inner[0][0] == OID and len(inner[0][1]) > 1


def is_private_key(data: bytes) -> bool:
    """Whether DER bytes are exactly one private key."""
    head = _header(data, 0)
    if head is None or head[0] != SEQUENCE or head[2] != len(data):
        return False
    fields = _children(data[head[1] :])
    if not fields or len(fields) < 2:
        return False
    tags, values = [t for t, _ in fields], [v for _, v in fields]
    if tags[:1] == [INTEGER] and set(tags) == {INTEGER}:  # PKCS #1 has nine numbers, DSA six
        return values[0] in (b"\0", b"\1") and len(tags) in (6, 9) and all(values) and len(values[1]) >= 16
    if tags[:3] == [INTEGER, SEQUENCE, OCTETS]:  # PKCS #8
        return values[0] in (b"\0", b"\1") and _names_algorithm(values[1]) and len(values[2]) >= 16
    if tags[:2] == [INTEGER, OCTETS]:  # SEC 1: the curve and the public point may follow
        rest = all(t in (0xA0, 0xA1) and _children(v) for t, v in fields[2:])
        return values[0] == b"\1" and 16 <= len(values[1]) <= 66 and len(fields) <= 4 and rest
    if tags == [SEQUENCE, OCTETS]:  # PKCS #8, encrypted
        return _names_algorithm(values[0]) and len(values[1]) >= 32
    return False


def _strings(data: bytes, at: int, number: int) -> int | None:
    """The end of so many length-prefixed strings."""
    for _ in range(number):
        if at + 4 > len(data):
            return None
        at += 4 + int.from_bytes(data[at : at + 4], "big")
        if at > len(data):
            return None
    return at


def ssh_key_bytes(data: bytes) -> int:
    """How many of the bytes are an OpenSSH private key, 0 if they don't begin with one."""
    if not data.startswith(SSH_MAGIC):
        return 0
    at = _strings(data, len(SSH_MAGIC), 3)  # cipher, derivation and its options
    if at is None or at + 4 > len(data):
        return 0
    keys = int.from_bytes(data[at : at + 4], "big")
    if not 1 <= keys <= 16:
        return 0
    end = _strings(data, at + 4, keys + 1)  # public keys, then the private part
    return end or 0


def _decoded(letters: str) -> bytes | None:
    """Bytes of base64 letters in either alphabet, padded or not; None if they are mixed or cut."""
    letters = letters.rstrip("=")
    if ("-" in letters or "_" in letters) and ("+" in letters or "/" in letters) or len(letters) % 4 == 1:
        return None
    plain = letters.replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(plain + "=" * (-len(plain) % 4), validate=True)
    except binascii.Error:
        return None


def _object(letters: str) -> dict | None:
    data = _decoded(letters)
    try:
        value = json.loads(data.decode()) if data else None
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def is_signed_token(token: str) -> bool:
    """Whether header, claims and signature of a token are what its algorithm asks for."""
    header, claims, signature = token.split(".")
    named = _object(header)
    if named is None or not isinstance(named.get("alg"), str) or named["alg"] not in SIGNATURE_BYTES:
        return False
    data = _decoded(signature)
    if data is None or _object(claims) is None:
        return False
    wanted = SIGNATURE_BYTES[named["alg"]]
    return len(data) in RSA_SIGNATURE_BYTES if wanted is None else len(data) == wanted


def _key_in(head: bytes, whole: Callable[[int], bytes]) -> tuple[str, int] | None:
    """Kind and bytes of the key that encoded bytes begin with; ``whole(n)`` decodes the first n of them."""
    if head.startswith(SSH_MAGIC[: len(head)]):
        size = ssh_key_bytes(whole(MOST_KEY))
        return ("ssh", size) if size else None
    first = _header(head, 0)
    if first is None or first[0] != SEQUENCE or first[2] < 32:
        return None
    return ("key", first[2]) if is_private_key(whole(first[2])) else None


def _base64_key(text: str, start: int) -> Span | None:
    """The key in base64 that begins at a place, line ends in it left out."""

    def parts(most: int) -> Iterator[re.Match]:
        part, at = _PART.match(text, start), 0
        while part and at < most:
            yield part
            at += len(part[1])
            part = _PART.match(text, part.end()) if part.end() > part.end(1) else None

    def whole(n: int) -> bytes:
        most = -(-n // 3) * 4
        letters = "".join(p[1] for p in parts(most))[:most]
        return (_decoded(letters[: len(letters) - (len(letters) % 4 == 1)]) or b"")[:n]

    key = _key_in(_decoded(text[start : start + 16]) or b"", whole)
    if key is None:
        return None
    left = -(-key[1] * 4 // 3)
    for part in parts(left):
        end = part.start() + min(left, len(part[1]))
        left -= len(part[1])
    padding = -key[1] % 3
    return Span(key[0], start, end + padding * text.startswith("=" * padding, end))


def _hex_key(match: re.Match) -> Span | None:
    key = _key_in(bytes.fromhex(match[0][:32]), lambda n: bytes.fromhex(match[0][: min(2 * n, len(match[0]) // 2 * 2)]))
    return Span(key[0], match.start(), match.start() + 2 * key[1]) if key else None


def _printable(data: bytes) -> bool:
    return all(c > 31 or c in b"\t\r\n" for c in data)


def _has_secret(data: bytes | None, depth: int) -> bool:
    """Whether bytes are printable text that holds a secret."""
    if not data or not _printable(data[:24]):
        return False
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return False
    return _printable(data) and bool(base_spans(text) or structured_spans(text, depth + 1))


def _encoded(match: re.Match, depth: int) -> Span | None:
    """The whole match, or its first line, if it decodes to text with a secret."""
    start, first = match.start(), _BREAK.split(match[0])[0]
    for letters, end in ((match[0], match.end()), (first, start + len(first))):
        whole = _BREAK.sub("", letters)
        head = _decoded(whole[: min(32, len(whole) // 4 * 4)])
        if head and _printable(head) and _has_secret(_decoded(whole), depth):
            return Span("encoded", start, end)
    return None


def structured_spans(text: str, depth: int = 0) -> list[Span]:
    """What decoding confirms, in order; spans don't overlap, and of two that do the kind listed first stays."""
    found: list[Span] = []

    def add(spans: Iterable[Span | None]) -> None:
        for span in spans:
            if span:
                at = bisect(found, span.start, key=lambda s: s.start)
                free = (at == 0 or found[at - 1].end <= span.start) and (
                    at == len(found) or span.end <= found[at].start
                )
                if free:
                    found.insert(at, span)

    add(_base64_key(text, m.start()) for m in _KEY_BEGIN.finditer(text))
    add(_hex_key(m) for m in _PLAIN_HEX.finditer(text))
    add(Span("signed", *m.span()) for m in _SIGNED.finditer(text) if is_signed_token(m[0]))
    if depth < DEPTH:
        add(_encoded(m, depth) for m in _BASE64.finditer(text))
        hexes = (m for m in _PLAIN_HEX.finditer(text) if len(m[0]) % 2 == 0)
        add(Span("encoded", *m.span()) for m in hexes if _has_secret(bytes.fromhex(m[0]), depth))
    return found


def spans_of(text: str) -> list[Span]:
    """All spans by start, then kind as listed in KINDS, then end."""
    found = base_spans(text) + structured_spans(text)
    return sorted(found, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


_ARROW_SPANS = pa.list_(
    pa.struct(
        [pa.field("kind", pa.string(), False), pa.field("start", pa.int64(), False), pa.field("end", pa.int64(), False)]
    )
)


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in few_rows(batches):
        spans = [[s._asdict() for s in spans_of(t.as_py() or "")] for t in batch.column("text")]
        yield pa.RecordBatch.from_pydict({"rest": batch.column("rest"), "spans": pa.array(spans, _ARROW_SPANS)})


def find_secrets(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """Per row: ``rest`` (the struct of its other columns) and ``spans``.

    A span has a kind of KINDS, a start and an end (exclusive) in code points. The plain kinds
    are always reported; the others are added where decoding confirms them, and may overlap the
    plain ones but not each other. Null and empty texts have no spans. Rows stay as they are,
    repeated ones included; an empty table gives an empty one. A long text is scanned whole, in one
    pass for each pattern.
    """
    rows = docs.select(F.col(f"`{text_column}`").alias("text"), storage.others(docs, text_column).alias("rest"))
    return rows.mapInArrow(_find, T.StructType([rows.schema["rest"], T.StructField("spans", SPANS)]))


def listed(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op12_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Per document: how many spans each plain pattern has, their digest, and all spans."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_secrets(docs)
    base = F.filter("spans", lambda s: s["kind"].isin(BASE_KINDS))

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        F.col("rest.doc_id").alias("doc_id"),
        *[number(kind).alias(f"n_{kind}") for kind in BASE_KINDS],
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )

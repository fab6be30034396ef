"""Byte-level BPE encoding and decoding with content-defined chunk reuse.

A text is cut where a rolling hash over the last `HASH_BYTES` bytes has its low
bits zero, so the same passage is cut alike wherever it stands. Each distinct
chunk is encoded once and its ids are used wherever it stands again:

* across the cluster, for the chunks met most often: chunk hashes are counted (8
  bytes a chunk are shuffled, not the text), the most frequent repeated ones up to
  `shared_bytes` are encoded once each, and the ids are sent to all tasks
  (`shared_chunks`);
* within a task, for all others, in a cache bounded by `CACHE_BYTES`.

A cut may fall inside a token, so joins are repaired. Near the ends of a chunk stand
two marks each, places between a visible ASCII character and a blank or line feed.
A chunk is encoded from its first mark to its last. The join is encoded again from the last mark but one of the chunk before it to the
second mark of the chunk after it, and must begin and end with exactly the ids that
the two chunks have between their marks. Where it does not, or a chunk has too few
marks, the next chunk becomes part of the join, which is encoded again, until both
ends agree or are ends of the text. Where no alternative of the split pattern crosses
a mark and none looks back, as in byte-level ones with an optional blank before a
word, the first try agrees and the ids equal the whole text's. For other patterns
agreement is evidence, not proof.

Special tokens found in a text are encoded as such, as the tokenizers library
does by default.

Defined results: a null or empty text has no tokens and decodes to an empty
string; a chunk is at most `MAX_CHUNK` bytes, whatever the text's length; repeated
rows each get their ids; an empty table gives an empty table; the added column takes
a name that the table does not have.
"""

from __future__ import annotations

import itertools
import json
import pickle
from collections import Counter, OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolith.llm.common import fresh, rows_udf

HASH_BYTES = 16
CUT_BITS = 9
MAX_CHUNK = 1 << 14
LEAST_CHUNK = 128  # shorter ones are not worth sharing
CACHE_BYTES = 32 << 20
RESULT = "ids array<int>, decoded string"

_READY: dict[tuple[str, str], Codec] = {}


class Vocabulary:
    """Ids of a byte-level BPE file of the tokenizers library; its split pattern is a parameter of the caller."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            doc = json.load(f)
        # the printable stand-ins of the byte-level alphabet: visible bytes stand for themselves, the rest are moved up
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in set(shown)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
        self.special = {t["content"]: t["id"] for t in doc["added_tokens"]}
        self.ranks = {bytes(byte_of[c] for c in token): i for token, i in doc["model"]["vocab"].items() if token not in self.special}
        self.bytes_of = {i: b for b, i in self.ranks.items()} | {i: t.encode() for t, i in self.special.items()}


@dataclass
class Chunk:
    """Marks (two near each end) and the ids between them: first and second, second and last but one, last two."""

    marks: tuple[int, int, int, int]
    head: np.ndarray
    body: np.ndarray
    tail: np.ndarray

    @property
    def nbytes(self) -> int:
        return self.head.nbytes + self.body.nbytes + self.tail.nbytes + 400


class Codec:
    def __init__(self, path: str, pattern: str):
        import tiktoken

        vocabulary = Vocabulary(path)
        self.encoder = tiktoken.Encoding("chunks", pat_str=pattern, mergeable_ranks=vocabulary.ranks, special_tokens=vocabulary.special)
        size = max(vocabulary.bytes_of) + 1
        parts = [vocabulary.bytes_of.get(i, b"") for i in range(size)]
        self.lengths = np.array([len(p) for p in parts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.flat = np.frombuffer(b"".join(parts), np.uint8)
        self.encoded = self.reused = self.repaired = 0
        self.forget()

    def forget(self) -> None:
        """Empty the cache; a task begins with an empty one, so that a worker holds no more than one task's."""
        self.cache: OrderedDict[bytes, Chunk | None] = OrderedDict()
        self.held = 0

    def plain(self, data: bytes) -> np.ndarray:
        return self.encoder.encode_to_numpy(data.decode(), allowed_special="all") if data else np.zeros(0, np.uint32)

    def fresh_chunk(self, data: bytes) -> Chunk | None:
        """The chunk's ids from its first mark to its last; None if it has fewer than four marks, or if encoding what is
        between two marks by itself does not agree with them."""
        if not (m := marks(data)):
            return None
        ids, head, tail = self.plain(data[m[0] : m[3]]), self.plain(data[m[0] : m[1]]), self.plain(data[m[2] : m[3]])
        body = ids[len(head) : len(ids) - len(tail)]
        return Chunk(m, head, body, tail) if np.array_equal(ids, np.concatenate([head, body, tail])) else None

    def chunk(self, data: bytes, shared: dict[bytes, Chunk | None]) -> Chunk | None:
        if data in shared:
            self.reused += 1
            return shared[data]
        if data in self.cache:
            self.cache.move_to_end(data)
            self.reused += 1
            return self.cache[data]
        found = self.fresh_chunk(data)
        self.encoded += 1
        self.cache[data] = found
        self.held += len(data) + (found.nbytes if found else 300)
        while self.held > CACHE_BYTES:
            old, value = self.cache.popitem(last=False)
            self.held -= len(old) + (value.nbytes if value else 300)
        return found

    def encode(self, text: bytes, shared: dict[bytes, Chunk | None] | None = None) -> np.ndarray:
        out: list[np.ndarray] = []
        none = np.zeros(0, np.uint32)
        begin, expect = 0, none  # the join's start, and the ids it must begin with
        at = 0
        ends = chunk_ends(text)
        for cut in ends:
            found = self.chunk(text[at:cut], shared or {}) if len(ends) > 1 else None
            if found:
                first, second, third, _ = found.marks
                ids = self.plain(text[begin : at + second])
                if len(ids) >= len(expect) + len(found.head) and np.array_equal(ids[: len(expect)], expect) and np.array_equal(ids[len(ids) - len(found.head) :], found.head):
                    out += [ids, found.body]
                    begin, expect = at + third, found.tail
                else:
                    self.repaired += 1  # no agreement: this chunk becomes part of the join
            at = cut
        ids = self.plain(text[begin:])
        if not np.array_equal(ids[: len(expect)], expect):
            self.repaired += 1
            return self.plain(text)
        out.append(ids)
        return np.concatenate(out) if len(out) > 1 else out[0]

    def decode(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        places = np.repeat(self.starts[ids] - ends + sizes, sizes)
        places += np.arange(ends[-1])
        return self.flat[places].tobytes()


#: A fixed random word for each byte, for the rolling hash.
MIX = np.random.default_rng(5).integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)


def chunk_ends(text: bytes) -> list[int]:
    """Ends of the content-defined chunks; the last is the text's end. Only whole code points are cut off."""
    n = len(text)
    if n <= 2 * (1 << CUT_BITS):
        return [n]
    raw = np.frombuffer(text, np.uint8)
    h = MIX[raw]
    step = 1
    while step < HASH_BYTES:  # h[i] = sum of mix[i - k] << k over the last HASH_BYTES bytes, by doubling
        moved = np.zeros_like(h)
        moved[step:] = h[:-step] << np.uint32(step)
        h = h + moved
        step *= 2
    cuts = np.flatnonzero((h >> np.uint32(32 - CUT_BITS)) == 0) + 1
    ends, at = [], 0
    for c in [*cuts.tolist(), n]:
        while c - at > MAX_CHUNK:
            ends.append(at := _whole(raw, at + MAX_CHUNK))
        if c > at and (c == n or (raw[c] & 0xC0) != 0x80):
            ends.append(at := c)
    return ends


def _whole(raw: np.ndarray, at: int) -> int:
    while (raw[at] & 0xC0) == 0x80:
        at -= 1
    return at


def marks(data: bytes) -> tuple[int, int, int, int] | None:
    """The first two and the last two places between a visible ASCII character and a blank or line feed; None if there are fewer than four."""
    raw = np.frombuffer(data, np.uint8)
    at = np.flatnonzero((raw[:-1] > 0x20) & (raw[:-1] < 0x7F) & ((raw[1:] == 0x20) | (raw[1:] == 0x0A))) + 1
    return (int(at[0]), int(at[1]), int(at[-2]), int(at[-1])) if len(at) >= 4 else None


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _READY:
        _READY[path, pattern] = Codec(path, pattern)
    return _READY[path, pattern]


def shared_chunks(docs: DataFrame, path: str, pattern: str, *, text: str = "text", shared_bytes: int = 16 << 20) -> Broadcast:
    """The chunks met most often, more than once, each encoded once: at most `shared_bytes` of them and their ids, for all tasks."""
    source = docs.select(F.col(text).cast("binary").alias("text"))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: Counter[tuple[int, int]] = Counter()
            for t in b.column(0):
                counts.update((xxhash.xxh3_64_intdigest(c), len(c)) for c in _chunks(t.as_py() or b""))
            if counts:
                h, size = (np.array(x, np.uint64).view(np.int64) for x in zip(*counts, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(size), pa.array(list(counts.values()), pa.int64())], names=["h", "size", "n"])

    counted = source.mapInArrow(keys, "h long, size long, n long").groupBy("h").agg(F.sum("n").alias("n"), F.min("size").alias("size"))
    most = shared_bytes // LEAST_CHUNK
    top = counted.where("n > 1").orderBy(F.desc(F.col("n") * F.col("size")), "h").limit(most).select("h", "size").collect()
    spent = list(itertools.accumulate(r["size"] * 3 + 400 for r in top))  # a chunk, and at worst about half as many ids of four bytes
    wanted = docs.sparkSession.sparkContext.broadcast(np.array(sorted(r["h"] & (1 << 64) - 1 for r, s in zip(top, spent, strict=True) if s <= shared_bytes), np.uint64))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sent = set(wanted.value.tolist()), set()
        for b in batches:
            out = []
            for t in b.column(0) if known else ():
                for c in _chunks(t.as_py() or b""):
                    h = xxhash.xxh3_64_intdigest(c)
                    if h in known and h not in sent:
                        sent.add(h)
                        out.append((h, c))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.array([h for h, _ in out], np.uint64).view(np.int64)), pa.array([c for _, c in out], pa.binary())], names=["h", "chunk"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = codec(path, pattern)
        for b in batches:
            found = [pickle.dumps(ready.fresh_chunk(c.as_py())) for c in b.column(0)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary())], names=["chunk", "ids"])

    each = source.mapInArrow(find, "h long, chunk binary").groupBy("h").agg(F.min("chunk").alias("chunk")).select("chunk")
    table = {bytes(r["chunk"]): pickle.loads(r["ids"]) for r in each.mapInArrow(encode, "chunk binary, ids binary").toLocalIterator()} if top else {}
    return docs.sparkSession.sparkContext.broadcast(table)


def _chunks(text: bytes) -> Iterator[bytes]:
    ends = chunk_ends(text)
    for a, z in zip([0, *ends], ends) if len(ends) > 1 else ():
        if z - a >= LEAST_CHUNK:
            yield text[a:z]


def token_column(text: Column, path: str, pattern: str, shared: Broadcast | None = None) -> Column:
    """A struct column: ids and the text decoded from them. shared: what `shared_chunks` gives, if it is wanted."""

    def start():
        ready, known = codec(path, pattern), shared.value if shared else {}
        ready.forget()

        def row(data):
            ids = ready.encode(data or b"", known)
            return ids.astype(np.int32), ready.decode(ids).decode("utf-8", "replace")

        return row

    return rows_udf(start, RESULT)(text.cast("binary"))


def digest_column(text: Column, path: str, pattern: str, shared: Broadcast | None = None) -> Column:
    """The same, reduced in the task to counts and digests of the ids (little-endian, 32 bits) and the decoded text."""
    import hashlib

    def start():
        ready, known = codec(path, pattern), shared.value if shared else {}
        ready.forget()

        def row(data):
            ids = ready.encode(data or b"", known)
            decoded = ready.decode(ids).decode("utf-8", "replace")
            return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()

        return row

    return rows_udf(start, "n_tokens long, ids_sha256 string, decoded_sha256 string")(text.cast("binary"))


def tokenize(docs: DataFrame, path: str, pattern: str, *, text: str = "text") -> DataFrame:
    """`docs` with the struct column of `token_column` as its last column."""
    return docs.withColumn(fresh(docs, "tokens"), token_column(F.col(text), path, pattern, shared_chunks(docs, path, pattern, text=text)))

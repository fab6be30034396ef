"""Line de-duplication with two Bloom filters.

A text is split at ``\\n`` (null or empty: one empty line). The key of a line is
the line without ``[\\x20\\x09-\\x0D]`` at both ends and with A-Z lower-cased. Keys
that at least `min_docs` rows hold are dropped: all their lines in every row, or
all but the first occurrence (`keep="first"`: the smallest id, then the first
line of that row).

1. Each partition hashes the distinct keys of each row into a filter of keys seen
   at all and one of keys seen in two or more rows. Filters are merged segment by
   segment, ``once = a | b``, ``twice = a2 | b2 | (a & b)``, which can only add
   bits, so no repeat is lost.
2. Only keys that the "twice" filter holds leave the partition, as 128-bit
   digests; an exact count decides, so false positives cost work, not results.
3. The dropped digests go back to the texts: as a shared set while there are at
   most `max_shared` of them, else by a join (only texts with a suspected line
   take part), both with the same result.

Size: the filters have about 16 bits for each line of the input (an upper bound of
the distinct keys, counted first), up to `filter_bits`; where they fill up, more keys
take the exact way. A line that a large share of the rows holds is counted by partial
sums and joined back over `SALTS` copies of its digest. Defined results: each row is a
document of its own, also if ids repeat or are null; identical rows (same id, same
text) are all "first" together; an empty table gives an empty table; the added column
takes a name that the table does not have, and other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith.llm.common import fresh_names, rows_udf, stored

SPACE = b" \t\n\v\f\r"
LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
SEGMENT_BITS = 1 << 19
LEAST_BITS = 1 << 16
FAN_IN = 64
SALTS = 16
KEPT = "n_lines long, n_dropped long, kept string"


def key_of(line: bytes) -> bytes:
    return line.strip(SPACE).translate(LOWER)


def digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def bit_places(key: bytes, bits: int) -> tuple[int, int]:
    h = xxhash.xxh64_intdigest(key)
    return h % bits, (h >> 32) * 0x9E3779B1 % bits


def row_keys(text: bytes | None, min_chars: int) -> set[bytes]:
    keys = {key_of(line) for line in (text or b"").split(b"\n")}
    return {k for k in keys if len(k) >= min_chars and len(k.decode()) >= min_chars}


def _packed(bits: np.ndarray) -> bytes:
    return zlib.compress(bits.tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), np.uint8)


def _partition_filters(bits: int, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            rows = Counter(k for t in batch.column(0) for k in row_keys(t.as_py(), min_chars))
            at = np.array([bit_places(k, bits) for k in rows], np.int64).reshape(-1, 2)
            # keys that two rows of this batch hold, or that the partition has met before: both their bits are set
            again = np.fromiter((n > 1 for n in rows.values()), bool, len(rows)) | (once[at >> 3] >> (at & 7) & 1).all(axis=1)
            for target, some in ((twice, at[again].ravel()), (once, at.ravel())):
                np.bitwise_or.at(target, some >> 3, (1 << (some & 7)).astype(np.uint8))
        step = min(SEGMENT_BITS, bits) // 8
        part = int.from_bytes(hashlib.blake2b(once.tobytes(), digest_size=4).digest(), "little")
        out = [(k, part, _packed(a), _packed(twice[k * step : (k + 1) * step])) for k in range(len(once) // step) if (a := once[k * step : (k + 1) * step]).any()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["segment", "part", "once", "twice"])

    return run


def _fold(group: pd.DataFrame) -> pd.DataFrame:
    once = twice = None
    for a, b in zip(group["once"], group["twice"], strict=True):
        a, b = _unpacked(a), _unpacked(b)
        once, twice = (a, b) if once is None else (once | a, twice | b | (once & a))
    return pd.DataFrame({"segment": group["segment"].iloc[:1], "part": group["part"].iloc[:1], "once": [_packed(once)], "twice": [_packed(twice)]})


def repeat_filter(docs: DataFrame, text: str, *, bits: int, min_chars: int) -> bytes:
    """The bits of all keys that two rows may hold; a fixed number, whatever the input."""
    source = docs.select(F.col(text).cast("binary").alias("text"))
    schema = "segment int, part long, once binary, twice binary"
    parts = source.mapInArrow(_partition_filters(bits, min_chars), schema)
    groups = source.rdd.getNumPartitions()
    while groups > FAN_IN:  # a segment never meets more than about FAN_IN filters at once
        groups = -(-groups // FAN_IN)
        parts = parts.groupBy("segment", F.pmod("part", F.lit(groups))).applyInPandas(_fold, schema)
    parts = parts.groupBy("segment").applyInPandas(_fold, schema).select("segment", "twice")
    step = min(SEGMENT_BITS, bits) // 8
    out = bytearray(bits // 8)
    for r in parts.toLocalIterator():
        out[r["segment"] * step : (r["segment"] + 1) * step] = zlib.decompress(r["twice"])
    return bytes(out)


def bits_for(docs: DataFrame, text: str, most: int) -> int:
    """A power of two: about 16 bits a line, at most `most`."""
    breaks = F.octet_length(F.col(text)) - F.octet_length(F.replace(F.col(text), F.lit("\n"), F.lit("")))
    lines = docs.agg(F.sum(F.coalesce(breaks, F.lit(0)) + 1)).first()[0] or 0
    return min(most, max(LEAST_BITS, 1 << (16 * lines - 1).bit_length() if lines else 0))


def _suspects(shared, bits: int, min_chars: int):
    def start():
        marks = np.frombuffer(zlib.decompress(shared.value), np.uint8)

        def row(text):
            keys = list(row_keys(text, min_chars))
            at = np.array([bit_places(k, bits) for k in keys], np.int64).reshape(-1, 2)
            hit = ((marks[at >> 3] >> (at & 7)) & 1).all(axis=1)
            return ([digest(keys[i]) for i in np.flatnonzero(hit)],)

        return row

    return rows_udf(start, "keys array<binary>")


def _kept(text: bytes | None, drop: dict[bytes, bool]) -> tuple[int, int, str]:
    """drop: digest -> whether this row holds the occurrence that stays."""
    lines = (text or b"").split(b"\n")
    if not drop:
        return len(lines), 0, (text or b"").decode()
    stay, left = [], dict(drop)
    for line in lines:
        d = digest(key_of(line))
        if d not in left or left[d]:
            stay.append(line)
            if d in left:
                left[d] = False
    return len(lines), len(lines) - len(stay), b"\n".join(stay).decode()


def dedup_lines(docs: DataFrame, *, id: str = "doc_id", text: str = "text", min_docs: int = 10, min_chars: int = 1, keep: str = "none", filter_bits: int = 1 << 29, max_shared: int = 1 << 18) -> DataFrame:
    """`docs` with a struct column `lines` (n_lines, n_dropped, kept) under a fresh name; returns that frame.

    The name of the added column is the last of the result's columns.
    """
    spark = docs.sparkSession
    out, sus, rid = fresh_names(docs, "lines", "suspects", "row_hash")
    filter_bits = bits_for(docs, text, filter_bits)
    marks = spark.sparkContext.broadcast(zlib.compress(repeat_filter(docs, text, bits=filter_bits, min_chars=min_chars), 1))
    binary = F.col(text).cast("binary")
    find = _suspects(marks, filter_bits, min_chars)
    occurrences = docs.select(F.col(id).alias("id"), F.xxhash64(F.col(text)).alias("hash"), find(binary).alias("s")).select("id", "hash", F.explode("s.keys").alias("key"))
    counted = occurrences.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "hash")).alias("first"))
    dropped = stored(counted.where(F.col("n") >= min_docs).select("key", "first"))
    first = keep == "first"

    if dropped.limit(max_shared + 1).count() <= max_shared:
        table = spark.sparkContext.broadcast({bytes(r["key"]): (r["first"]["id"], r["first"]["hash"]) if first else None for r in dropped.toLocalIterator()})

        def start():
            known = table.value

            def row(text, doc, hash_):
                present = {d for line in (text or b"").split(b"\n") if (d := digest(key_of(line))) in known} if known else ()
                return _kept(text, {d: first and known[d] == (doc, hash_) for d in present})

            return row

        return docs.withColumn(out, rows_udf(start, KEPT)(binary, F.col(id), F.xxhash64(F.col(text))))

    salt = F.pmod(F.xxhash64("id", "hash"), F.lit(SALTS)).cast("int")
    salted = dropped.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hits = occurrences.withColumn("salt", salt).join(salted, ["key", "salt"]).select("id", "hash", F.struct("key", (F.lit(first) & F.col("first").eqNullSafe(F.struct("id", "hash"))).alias("stays")).alias("d"))
    per_row = hits.groupBy("id", "hash").agg(F.collect_set("d").alias(sus)).withColumnsRenamed({"id": f"{rid}_id", "hash": rid})
    joined = docs.join(per_row, F.col(id).eqNullSafe(F.col(f"{rid}_id")) & (F.xxhash64(F.col(text)) == F.col(rid)), "left")

    def start_joined():
        return lambda text, drop: _kept(text, {bytes(d["key"]): d["stays"] for d in drop or ()})

    return joined.withColumn(out, rows_udf(start_joined, KEPT)(binary, F.col(sus))).drop(sus, rid, f"{rid}_id")

"""SimHash near-duplicates, linked by Golay-code fuzzy keys.

Fingerprint: A-Z to lower case, words ``[^\\x20\\x09-\\x0D]+``, `shingle`-word
shingles with repeats, joined by a space (fewer words: the whole sequence; none:
zero). h is the shingle's XXH64 (UTF-8, seed 42); a bit of the 64-bit
fingerprint is 1 if it is set in more than half of the h. Fingerprints link at 3
or fewer differing bits; a component is all that links reach.

Candidate keys. The binary Golay code of 23 bits has a word within 3 bits of any
vector. A fingerprint is cut into segments of 23, 23 and 18 bits (padded with
zeros). `own(s)` is the 12-bit index of the codeword that s decodes to; `near(s)`
the indices that s or s with one flipped bit decodes to, 1 or 6 of them. If two
segments differ in one bit or none, own of the one is in near of the other. Three
errors over three segments leave, by the pigeonhole principle, either one in each
(keys: near/near/own against own/own/near of the three segments) or one segment
exact and another with at most one (key: the exact segment and near against own).
So each link shares a key in each direction, of 30 bits or more.

Only distinct fingerprints take part, so copies cost nothing. Members of a key
meet in sorted runs, 8 bytes each; within a run a spanning forest of the
verified links is kept, not all pairs, and label propagation with
pointer jumping over these edges, in checkpointed rounds, gives the components.

Defined results: null and empty texts have fingerprint zero and are linked like
any other; null ids take part but a component's id is its smallest non-null id;
repeated rows are copies of each other; texts of any length are read whole; an empty
table gives no rows; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolith.llm.common import checkpointed, fresh, rows_udf

LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
#: Generator polynomial of the binary Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
MASK = (1 << 23) - 1
BLOCK = 1 << 14
SALTS = 16


@lru_cache
def _syndrome_errors() -> np.ndarray:
    """The error of at most three bits for each of the 2048 syndromes."""
    errors = np.zeros(2048, np.int64)
    masks = [0, *(1 << i for i in range(23))]
    weight3 = {a | b | c for a in masks for b in masks for c in masks}
    for e in weight3:
        errors[_remainder(np.array([e], np.int64))[0]] = e
    return errors


def _remainder(words: np.ndarray) -> np.ndarray:
    rest = words.copy()
    for k in range(22, 10, -1):
        rest = np.where(rest >> k & 1, rest ^ GENERATOR << (k - 11), rest)
    return rest


def own_key(segment: np.ndarray) -> np.ndarray:
    """The 12 message bits of the nearest codeword."""
    return (segment ^ _syndrome_errors()[_remainder(segment)]) >> 11


def near_keys(segment: np.ndarray) -> np.ndarray:
    """[n, 6] indices that a segment decodes to with at most one flipped bit; a segment with fewer repeats its own."""
    own = own_key(segment)
    flipped = np.stack([own_key(segment ^ (1 << k)) for k in range(23)], axis=1)
    flipped.sort(axis=1)
    out = np.repeat(own[:, None], 6, axis=1)
    new = (np.diff(flipped, axis=1, prepend=-1) != 0) & (flipped != own[:, None])
    rows, cols = np.nonzero(new)
    place = np.cumsum(new, axis=1)[rows, cols]
    out[rows, place] = flipped[rows, cols]
    return out


def segments(fingerprints: np.ndarray) -> list[np.ndarray]:
    u = fingerprints.astype(np.uint64)
    return [(u >> np.uint64(s)).astype(np.int64) & MASK for s in (0, 23)] + [(u >> np.uint64(46)).astype(np.int64)]


def keys_of(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, key) pairs. Keys carry the kind of their parts in the top bits."""
    parts = segments(fingerprints)
    own, near = [own_key(p) for p in parts], [near_keys(p) for p in parts]
    n = np.arange(len(fingerprints))
    rows, keys = [], []

    # one error in each segment
    triple = lambda a, b, c: (a << 24) | (b << 12) | c
    for key in (triple(near[0][:, :, None], near[1][:, None, :], own[2][:, None, None]), triple(own[0][:, None], own[1][:, None], near[2])):
        rows.append(np.repeat(n, key[0].size) if len(n) else n)
        keys.append(key.ravel())
    # one segment exact, another with at most one error
    tag = 0
    for x in range(3):
        for y in range(3):
            if x != y:
                tag += 1
                key = parts[x][:, None] << 12 | near[y] | tag << 58
                rows.append(np.repeat(n, 6))
                keys.append(key.ravel())
    r, k = np.concatenate(rows), np.concatenate(keys)
    order = np.lexsort((k, r))
    r, k = r[order], k[order]
    keep = np.ones(len(r), bool)
    keep[1:] = (np.diff(r) != 0) | (np.diff(k) != 0)
    return r[keep], k[keep]


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    words = (text or b"").translate(LOWER).split()
    if not words:
        return 0
    line, n = b" ".join(words), len(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()
    digest = xxhash.xxh64_digest
    counts, total = np.zeros(64, np.int64), max(1, n - shingle + 1)
    last = min(shingle, n) - 1
    for a in range(0, total, BLOCK):
        b = min(total, a + BLOCK)
        h = b"".join([digest(line[i:j], 42) for i, j in zip(starts[a:b], ends[a + last : b + last], strict=True)])
        counts += np.unpackbits(np.frombuffer(h, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > total).tobytes(), "big")


def fingerprint_column(text: Column, shingle: int = 3) -> Column:
    """The fingerprint as a signed 64-bit integer."""

    def start():
        def row(t):
            f = fingerprint(t, shingle)
            return (f - (1 << 64) if f >> 63 else f,)

        return row

    return rows_udf(start, "fp long")(text.cast("binary"))["fp"]


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False)
        for a in range(0, len(fps), 4096):
            part = fps[a : a + 4096]
            r, k = keys_of(part.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(part[r])], names=["key", "fp"])


def forest(fps: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the graph of fingerprints at most `most` bits apart; compared a row at a time."""
    n = len(fps)
    u = fps.view(np.uint64)
    if n == 2:
        near = int(u[0] ^ u[1]).bit_count() <= most
        return (fps[:1], fps[1:]) if near else (fps[:0], fps[:0])
    left, right = [], []
    todo = np.arange(n)  # members that no tree has taken yet
    while len(todo):
        queue, todo = [todo[0]], todo[1:]
        while queue and len(todo):
            x = queue.pop()
            near = np.bitwise_count(u[todo] ^ u[x]) <= most
            if near.any():
                taken = todo[near]
                left.extend([fps[x]] * len(taken))
                right.extend(fps[taken].tolist())
                queue.extend(taken.tolist())
                todo = todo[~near]
    return np.array(left, np.int64), np.array(right, np.int64)


def _run_edges(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held = None, []

        def done(keys: np.ndarray, fps: np.ndarray):
            cut = np.flatnonzero(np.diff(keys)) + 1
            bounds = np.concatenate([[0], cut, [len(keys)]])
            size = np.diff(bounds)
            pairs = bounds[:-1][size == 2]  # most runs hold two; compare these at once
            near = np.bitwise_count(fps[pairs].view(np.uint64) ^ fps[pairs + 1].view(np.uint64)) <= most
            left, right = [fps[pairs[near]]], [fps[pairs[near] + 1]]
            for k in np.flatnonzero(size > 2):
                a, b = forest(fps[bounds[k] : bounds[k + 1]], most)
                left.append(a)
                right.append(b)
            a, b = np.concatenate(left), np.concatenate(right)
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

        for batch in batches:  # sorted by key; the last key may go on in the next batch
            keys, fps = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            if not len(keys):
                continue
            if held_key is not None and keys[0] == held_key and keys[-1] == held_key:
                held.append(fps)
                continue
            if held_key is not None:
                keys = np.concatenate([np.full(sum(map(len, held)), held_key), keys])
                fps = np.concatenate([*held, fps])
            start = int(np.searchsorted(keys, keys[-1]))
            if start:
                yield done(keys[:start], fps[:start])
            held_key, held = keys[-1], [fps[start:]]
        if held_key is not None:
            fps = np.concatenate(held)
            yield done(np.full(len(fps), held_key), fps)

    return run


def links(fps: DataFrame, most: int = 3) -> DataFrame:
    """Edges (a, b) between distinct fingerprints of `fps(fp)`, enough to connect all that link."""
    keys = fps.mapInArrow(_key_rows, "key long, fp long")
    runs = keys.repartition("key").sortWithinPartitions("key", "fp")
    return runs.mapInArrow(_run_edges(most), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges(a, b)`; root is the smallest node reached.

    Each round hooks every root to its smallest neighbour, follows the hooks by
    pointer doubling, and contracts the edges; it ends when no edge is left, after
    about as many rounds as the logarithm of the longest path.
    """
    edges = checkpointed(edges)
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("root", F.col("node"))
    current = edges
    nodes = checkpointed(nodes)
    while not current.isEmpty():
        both = current.select("a", "b").union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        jumps = checkpointed(both.groupBy("a").agg(F.min("b").alias("to")).select("a", F.least("a", "to").alias("to")))
        for _ in range(2):
            onward = jumps.select(F.col("a").alias("to"), F.col("to").alias("next"))
            jumps = checkpointed(jumps.join(onward, "to", "left").select("a", F.coalesce("next", "to").alias("to")))
        nodes = checkpointed(nodes.join(jumps.select(F.col("a").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root")))
        ends = jumps.select(F.col("a").alias("b"), F.col("to").alias("tb"))
        current = checkpointed(current.join(jumps, "a", "left").select(F.coalesce("to", "a").alias("a"), "b").join(ends, "b", "left").select("a", F.coalesce("tb", "b").alias("b")).where("a <> b").distinct())
    return nodes


def near_duplicates(docs: DataFrame, *, id: str = "doc_id", text: str = "text", shingle: int = 3, most: int = 3) -> DataFrame:
    """One row per document: id, fp (signed) and component_id."""
    marked = checkpointed(docs.select(F.col(id), fingerprint_column(F.col(text), shingle).alias(f := fresh(docs.select(id), "fp"))))
    per_fp = marked.groupBy(F.col(f).alias("fp")).agg(F.min(id).alias("least"))
    per_fp = checkpointed(per_fp)
    roots = components(links(per_fp.select("fp"), most))
    grouped = per_fp.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    # all empty texts have one fingerprint: its rows are dealt over SALTS tasks
    named = checkpointed(grouped.join(smallest, "root").select(F.col("fp").alias("_fp"), "component_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")))
    dealt = marked.select(F.col(id), F.col(f).alias("_own"), F.pmod(F.xxhash64(F.col(id)), F.lit(SALTS)).cast("int").alias("_deal"))
    return dealt.join(named, (F.col("_own") == F.col("_fp")) & (F.col("_deal") == F.col("_salt")), "left").select(id, F.col("_own").alias("fp"), "component_id")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def brute_components(fps: list[int], most: int = 3) -> list[int]:
    """The first index of each fingerprint's component, by comparing all; for tests."""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= most:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def one_of_each(docs: DataFrame, *, id: str = "doc_id", text: str = "text", shingle: int = 3, most: int = 3) -> DataFrame:
    """The rows of `docs` without near-copies: of each component the row with the smallest id (null last), then the
    smallest hash of its text; of equal rows one."""
    row, hash_, choice, place = (fresh(docs, n) for n in ("row_id", "row_hash", "choice", "place"))
    keyed = docs.withColumns({row: F.coalesce(F.col(id).cast("string"), F.lit("")), hash_: F.xxhash64(F.col(text))})
    marked = checkpointed(keyed.select(F.col(id).alias("id"), F.col(row).alias("row"), F.col(hash_).alias("hash"), fingerprint_column(F.col(text), shingle).alias("fp")))
    fps = checkpointed(marked.select("fp").distinct())
    roots = components(links(fps, most)).withColumnRenamed("node", "fp")
    rooted = marked.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    first = rooted.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("n"), "id", "hash", "row")).alias("m"))
    stay = first.select(F.col("m.row").alias(row), F.col("m.hash").alias(hash_), F.lit(True).alias(choice)).distinct()
    kept = keyed.join(stay, [row, hash_]).withColumn(place, F.row_number().over(Window.partitionBy(row, hash_).orderBy(F.lit(1))))
    return kept.where(F.col(place) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])

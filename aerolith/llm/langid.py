"""Language identification by prediction by partial matching (PPM).

For each language the bytes of its training texts fill a context tree up to
`order` bytes deep. A symbol that a context has seen is coded there, with
probability ``count / (total + kinds)`` (method C). One that it has not seen costs
the escape, ``kinds / (total + kinds)``, and then its code in the context one byte
shorter; below the empty context all symbols are alike. A context that the language
never saw costs nothing and is passed on. The statistics are frozen after training,
so the code length of a byte depends on its last `order` bytes only: it is worked
out once for each context node and symbol, and a text's exact code length in a
language is a sum of table entries.

Contexts are nodes of one tree shared by the languages: the most frequent ones of
any depth, seen `min_context` times or more; the longest suffix that is a node
stands for any other context (variable order).

Bounds, all parameters: training uses about `sample_bytes` of text a language, and
`total_bytes` at most over all of them in equal shares: distinct texts are cut into
pieces of `PIECE` bytes, and those with the least hashes of (text, piece) are taken
up to the bound, so copies count once, a long text gives some of its pieces, and
every language with labelled text is learned; the alphabet is the 256 bytes, one
symbol before the text and one for bytes that training has not seen; the tree has at
most `max_nodes` contexts and the table `max_entries` code lengths. Every text is
scored whole.

Defined results: null, or without a letter: `und` with score 0, and `readable` false,
whether there is a model or not. Ties go to the language that sorts first. No labelled
rows: everything is `und`. An empty table gives no rows; repeated rows each get the
same result; a NUL byte is a byte like any other; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolith.llm.common import give_back, to_bytes

LETTER = regex.compile(r"\p{L}")
UNDETERMINED = "und"
BLOCK = 1 << 18
PIECE = 4096


DENSE = 3  # contexts up to this depth are looked up by place, deeper ones by a hash


@dataclass
class Model:
    languages: list[str]
    symbol: np.ndarray  # byte -> symbol; the last symbol stands for all bytes that training has not seen
    node: np.ndarray  # context of up to DENSE symbols (0 where there is none yet) -> node, flat
    deep: list[tuple[int, int, np.ndarray, np.ndarray]]  # (depth, number of the table, context in the slot or -1, node), deeper last
    bits: np.ndarray  # [node * symbols + symbol, language]: code length
    size: int  # symbols, with one for "before the text"
    order: int = 0


def _slots(code: np.ndarray, count: int, table: int) -> np.ndarray:
    """Slots of a table whose size is a power of two; each table of a depth has a hash of its own."""
    mixed = (code.astype(np.uint64) + np.uint64(table)) * np.uint64(0x9E3779B97F4A7C15)
    return (((mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(65 - count.bit_length())).astype(np.int64)


def _tables(depth: int, own: np.ndarray, first: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Tables that hold every context once: what finds its slot taken goes to the next, much smaller table."""
    left, table = np.arange(len(own)), 0
    while len(left):
        count = max(64, 1 << int(4 * len(left) - 1).bit_length())
        at = _slots(own[left], count, table)
        _, taken = np.unique(at, return_index=True)
        slot, of = np.full(count, -1, np.int64), np.zeros(count, np.int32)
        slot[at[taken]], of[at[taken]] = own[left[taken]], first + left[taken]
        yield depth, table, slot, of
        left, table = np.delete(left, taken), table + 1


def sampled(train: DataFrame, text: str, lang: str, sample_bytes: int, order: int, total_bytes: int | None = None) -> DataFrame:
    """(lang, text, lead) pieces of the distinct texts, the least hashes first, of about `sample_bytes` a language, or an equal share of `total_bytes` if that is less; all of a language that has less.

    The first `lead` bytes of a piece, `order` of them but for a text's start, are context only. The bound is found on a
    scale of 64 steps to each doubling of the hash, so it is overrun by about a 64th or one piece."""
    raw = F.col(text).cast("binary")
    rows = train.where(F.col(lang).isNotNull() & (F.octet_length(raw) > 0)).select(F.col(lang).cast("string").alias("lang"), raw.alias("text"), F.xxhash64(raw).alias("h"), F.octet_length(raw).alias("size"))
    step = lambda p: F.floor(F.log2(F.shiftrightunsigned(F.xxhash64("h", p), 1).cast("double") + 1) * 64).cast("int")
    pieces = F.sequence(F.lit(0), F.floor((F.col("size") - 1) / PIECE).cast("int"))
    each = rows.select("lang", "h", "size").distinct().select("lang", "h", "size", F.explode(pieces).alias("piece"))
    steps = each.groupBy("lang", step("piece").alias("step")).agg(F.sum(F.least(F.col("size") - F.col("piece") * PIECE, F.lit(PIECE))).alias("bytes"))
    before = F.sum("bytes").over(Window.partitionBy("lang").orderBy("step")) - F.col("bytes")
    found = steps.withColumn("before", before).groupBy("lang").agg(F.collect_list(F.struct("step", "before")).alias("steps"))
    languages = found.select("lang", "steps").collect()  # a language has some thousand steps at most
    share = min(sample_bytes, (total_bytes or sample_bytes * max(1, len(languages))) // max(1, len(languages)))
    last = {r["lang"]: max((s["step"] for s in r["steps"] if s["before"] < share), default=-1) for r in languages}
    limit = F.create_map(*[F.lit(x) for of in last.items() for x in of]) if last else F.create_map().cast("map<string,int>")
    taken = rows.withColumn("pieces", F.filter(pieces, lambda p: step(p) <= F.element_at(limit, F.col("lang")))).where(F.size("pieces") > 0)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            out = []
            for of, whole, h, places in zip(*batch.columns, strict=True):
                key = (of.as_py(), h.as_py())
                if key in seen:
                    continue
                seen.add(key)
                body = memoryview(whole.as_buffer())
                for p in places.as_py():
                    at = p * PIECE
                    out.append((*key, p, bytes(body[max(0, at - order) : at + PIECE]), min(at, order)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.int32()), strict=True)], names=["lang", "h", "piece", "text", "lead"])

    found = taken.select("lang", "text", "h", "pieces").mapInArrow(cut, "lang string, h long, piece int, text binary, lead int")
    return found.groupBy("lang", "h", "piece").agg(F.min("text").alias("text"), F.min("lead").alias("lead")).select("lang", "text", "lead")


def _contexts(sym: np.ndarray, depth: np.ndarray, order: int, base: int) -> Iterator[np.ndarray]:
    """For 1, 2, .. `order` symbols the codes of the contexts before each place, the nearest symbol lowest; depth: symbols of the text before it."""
    code = np.zeros(len(sym), np.int64)
    for k in range(1, order + 1):
        moved = np.zeros(len(sym), np.int64)
        moved[k:] = sym[: max(0, len(sym) - k)]
        code = code + np.where(depth >= k, moved, 0) * base ** (k - 1)
        yield code


def _grams(order: int):
    """Partial counts by language of contexts of `order` bytes with the byte after them; a byte b is b + 1, 0 is before the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leads = batch.column(2).to_numpy()
            for lang in batch.column(0).unique().to_pylist():
                which = pc.equal(batch.column(0), lang)
                texts, lead = batch.column(1).filter(which).to_pylist(), leads[which.to_numpy(zero_copy_only=False)]
                sym = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64) + 1
                size = np.array([len(t) for t in texts])
                depth = np.arange(len(sym)) - np.repeat(np.cumsum(size) - size, size)
                *_, code = _contexts(sym, depth, order, 512)
                own = depth >= np.repeat(lead, size)  # the lead itself is not coded
                values, counts = np.unique(code[own] << 9 | sym[own], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values)), pa.array(values), pa.array(counts)], names=["lang", "gram", "n"])

    return run


def fit(train: DataFrame, *, text: str = "text", lang: str = "lang", order: int = 5, sample_bytes: int = 3_000_000, total_bytes: int = 32_000_000, min_context: int = 4, max_nodes: int = 20_000, max_entries: int = 20_000_000) -> Model:
    """`order` is 6 at most: a gram is a 64-bit number."""
    rows = sampled(train, text, lang, sample_bytes, order, total_bytes)
    grams = rows.mapInArrow(_grams(order), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    lang = grams.column("lang").combine_chunks().dictionary_encode()
    names = lang.dictionary.to_pylist()
    return frozen(names, lang.indices.to_numpy(), grams.column("gram").to_numpy(), grams.column("n").to_numpy(), order, min_context, max_nodes, max_entries)


def frozen(names: list[str], which: np.ndarray, gram: np.ndarray, n: np.ndarray, order: int, min_context: int, max_nodes: int, max_entries: int) -> Model:
    """Turn gram counts into the table of code lengths. names[which]: the language of each gram."""
    languages = sorted(names)
    if not languages:
        return Model([], np.zeros(256, np.int64), np.zeros(1, np.int32), [], np.zeros((0, 0), np.float32), 1, order)
    which = np.array([languages.index(x) for x in names], np.int64)[which]
    last = gram & 511
    used = np.unique(last)
    size = len(used) + 2  # 0: before the text; last: any byte that training has not seen
    number = np.full(512, size - 1, np.int64)
    number[used], number[0] = np.arange(1, len(used) + 1), 0
    last = number[last]
    codes, code = [np.zeros(len(gram), np.int64)], np.zeros(len(gram), np.int64)
    for depth in range(1, order + 1):
        code = code + number[gram >> (9 * depth) & 511] * size ** (depth - 1)
        codes.append(code)

    # the shared tree: the most frequent contexts; a suffix is as frequent as what it ends, and comes first
    found = []
    for depth in range(1, order + 1):
        keys, inverse = np.unique(codes[depth], return_inverse=True)
        total = np.bincount(inverse, weights=n)
        good = np.flatnonzero(total >= min_context)
        found.append((np.full(len(good), depth), keys[good], total[good]))
    depths, keys, totals = (np.concatenate(c) for c in zip(*found, strict=True))
    most = max(1, min(max_nodes, max_entries // (size * len(languages)))) - 1
    top = np.lexsort((keys, depths, -totals))[:most]
    chosen = [(0, np.zeros(1, np.int64))]
    node = np.zeros(size ** min(order, DENSE), np.int32)
    place = np.arange(len(node), dtype=np.int64)
    first, deep, offsets = 1, [], [0]
    for depth in range(1, order + 1):
        own = np.sort(keys[top[depths[top] == depth]])
        if depth > DENSE:
            deep.extend(_tables(depth, own, first))
        else:
            lookup = np.full(size**depth, -1, np.int32)
            lookup[own] = first + np.arange(len(own))
            hit = lookup[place % size**depth]
            node = np.where(hit >= 0, hit, node)
        chosen.append((depth, own))
        offsets.append(first)
        first += len(own)
    bits = np.empty((first, size, len(languages)), np.float32)
    for k in range(len(languages)):
        of = which == k
        below: list[tuple[np.ndarray, np.ndarray]] = []
        for (depth, own), offset in zip(chosen, offsets, strict=True):
            code = codes[depth][of]
            at = np.minimum(np.searchsorted(own, code), max(len(own) - 1, 0))
            hit = own[at] == code if len(own) else np.zeros(len(code), bool)
            counts = np.zeros((len(own), size))
            np.add.at(counts, (at[hit], last[of][hit]), n[of][hit])
            shorter = np.full((len(own), size), 1 / (size - 1))
            todo = np.ones(len(own), bool)
            for d in range(depth - 1, -1, -1):  # the longest suffix that is a node
                held, p = below[d]
                if len(held):
                    j = np.minimum(np.searchsorted(held, own % size**d), len(held) - 1)
                    ok = todo & (held[j] == own % size**d)
                    shorter[ok] = p[j[ok]]
                    todo &= ~ok
            below.append((own, _coded(counts, shorter)))
            bits[offset : offset + len(own), :, k] = -np.log2(below[depth][1])
    return Model(languages, number[1:257], node, deep, bits.reshape(-1, len(languages)), size, order)


def _coded(counts: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """The probability that each symbol is coded with: its own share if the context has seen it, else the escape and the shorter context's."""
    total, kinds = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
    whole = np.maximum(total + kinds, 1)
    return np.where(total > 0, np.where(counts > 0, counts, kinds * shorter) / whole, shorter)


def code_lengths(model: Model, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits of each text (rows) in each language (columns). flat: the texts' bytes; offsets: their starts and the end."""
    rows, n, order = len(offsets) - 1, len(flat), model.order
    out = np.zeros((rows, len(model.languages)))
    for a in range(0, n, BLOCK):
        b = min(n, a + BLOCK)
        lead = min(order, a)
        sym = model.symbol[flat[a - lead : b]]
        row = np.repeat(np.arange(rows), np.clip(np.minimum(offsets[1:], b) - np.maximum(offsets[:-1], a), 0, None))
        depth = np.concatenate([np.zeros(lead, np.int64), np.arange(a, b) - offsets[row]])  # bytes of the same text before this one
        place = np.zeros(b - a, np.int32)
        for k, code in enumerate(_contexts(sym, depth, order, model.size), 1):
            if k == min(order, DENSE):
                place = model.node[code[lead:]]
            for depth, table, slot, of in model.deep:
                if depth == k:
                    own = code[lead:]
                    at = _slots(own, len(slot), table)
                    place = np.where(slot[at] == own, of[at], place)
        place = place.astype(np.int64) * model.size + sym[lead:]
        first = np.flatnonzero(np.diff(row, prepend=-1))
        if len(first):
            out[row[first]] += np.add.reduceat(model.bits[place], first, axis=0, dtype=np.float64)
    return out


def language_column(docs: DataFrame, model: Model, *, text: str = "text") -> Column:
    """A struct column: lang_pred, score and bits_per_byte of the best language, and readable: whether the text has a letter."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        for batch in batches:
            lang, score, rate, readable = [], [], [], []
            for a, b in _slices(batch):
                part = batch.slice(a, b - a)
                found = _scored(model, part)
                for out, values in zip((lang, score, rate, readable), found, strict=True):
                    out.extend(values)
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rate, pa.float64()), pa.array(readable, pa.bool_())], names=["lang_pred", "score", "bits_per_byte", "readable"])
        del model
        give_back()

    udf = F.arrow_udf(run, "lang_pred string, score double, bits_per_byte double, readable boolean").asNondeterministic()
    return udf(F.col(text))


def _slices(batch: pa.Array) -> list[tuple[int, int]]:
    """Row ranges of about BLOCK bytes; a longer text is a range of its own."""
    if not len(batch):
        return []
    size = np.cumsum(pc.fill_null(pc.binary_length(batch), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cut = np.flatnonzero(np.diff(size // BLOCK)) + 1
    return list(zip([0, *cut.tolist()], [*cut.tolist(), len(batch)], strict=True))


def _scored(model: Model, part: pa.Array) -> tuple[list, list, list, list]:
    texts = part.to_pylist()
    readable = [t is not None and LETTER.search(t) is not None for t in texts]
    raw = pa.concat_arrays([pc.fill_null(to_bytes(part), b"")])
    wide = raw.cast(pa.large_binary())
    offsets = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
    body = wide.buffers()[2]
    flat = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.zeros(0, np.uint8)
    if not model.languages:
        return [UNDETERMINED] * len(texts), [0.0] * len(texts), [0.0] * len(texts), readable
    bits = code_lengths(model, flat, offsets - offsets[0])
    size = np.maximum(np.diff(offsets), 1)
    best = bits.argmin(1)
    # the posterior under equal priors; long texts count as 64 bytes, lest every score be 0 or 1
    gap = (bits - bits.min(1, keepdims=True)) * (np.minimum(size, 64) / size)[:, None]
    score = 1 / np.exp2(-gap).sum(1)
    lang, out, rate = [], [], []
    for k, known in enumerate(readable):
        lang.append(model.languages[best[k]] if known else UNDETERMINED)
        out.append(float(score[k]) if known else 0.0)
        rate.append(float(bits[k, best[k]] / size[k]) if known else 0.0)
    return lang, out, rate, readable


def identify(docs: DataFrame, model: Model, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: lang_pred, score, bits_per_byte."""
    return docs.select(F.col(id), language_column(docs, model, text=text).alias("found")).select(id, "found.lang_pred", "found.score", "found.bits_per_byte")

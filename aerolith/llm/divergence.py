"""Source divergence audit: how far the sources of a language are apart in their terms.

1. Exact frequency filter: each task counts in how many rows of a language a term
   occurs; the sums keep the terms of `min_docs` rows or more.
2. Kept terms of a language are dealt into shards of about `PER_SHARD` by their hash, and
   each task builds the minimal perfect hash of its shards (`perfecthash`).
3. Recount: the shards are broadcast, and each task looks its words up, compares the
   stored keys, and adds to dense arrays of one slot a term for each (lang, source). What
   is broadcast is at most `most_shared` bytes; more shards go in further passes.
4. Distances: slots are dealt in blocks and sources in tiles, so that a task holds two
   tiles of one block as dense arrays of exact shares, and its sums of absolute
   differences are added over the blocks.

Terms are ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased; null texts, languages and
sources are the empty string. A share is 1 + floor(10^9 (count + 5) / (N + 5 V)), by long
division in steps of a thousand, exact while N + 5 V is below 9 * 10^15.

Defined results: every row is a document of its own, also if ids repeat or are null; a
group without terms has the shares of zero counts; a language without kept terms gives
distances of 0; a source alone in its language has no pairs; equal values are ranked by
the item's UTF-8; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolith.llm.common import dropped, give_back, stored, to_bytes
from aerolith.llm.perfecthash import Table, build, lanes, shard_of

SCALE = 1_000_000_000
SMOOTH = 5
PER_SHARD = 8192
BLOCK = 2048
TILE = 128
MOST_TERMS = 300_000  # partial counts of the first pass that a task holds
MOST_CELLS = 6_000_000  # slots of the second pass that a task holds
#: Letters lower-cased, all other ASCII turned into blanks, bytes of other characters kept.
FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str, memoryview]]:
    for batch in batches:
        for lang, source, text in zip(batch.column(0), batch.column(1), to_bytes(batch.column(2)), strict=True):
            yield lang.as_py(), source.as_py(), text.as_py()


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of rows by (lang, term)."""
    counts: dict[str, Counter] = defaultdict(Counter)

    def out() -> Iterator[pa.RecordBatch]:
        for lang, of in counts.items():
            terms = pa.array(of.keys(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(of), pa.string()), terms.view(pa.string()), pa.array(of.values(), pa.int64())], names=["lang", "term", "n"])
        counts.clear()

    seen = 0
    for lang, _, text in _rows(batches):
        of = counts[lang]
        seen -= len(of)
        of.update(set(terms_of(text)))
        seen += len(of)
        if seen > MOST_TERMS:
            yield from out()
            seen = 0
    yield from out()
    give_back()


def kept_terms(docs: DataFrame, min_docs: int) -> DataFrame:
    """(lang, term) of docs(lang, source, text) that `min_docs` rows of the language hold."""
    return docs.mapInArrow(_document_counts, "lang string, term string, n long").groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs).select("lang", "term")


def _number_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            shard = shard_of(lanes(to_bytes(batch.column(1)).to_pylist())[0], batch.column(2).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(shard, pa.int64())], names=["lang", "term", "shards", "shard"])


def _build(table: pa.Table) -> pa.Table:
    by, keys = build(sorted(to_bytes(table.column("term").combine_chunks()).to_pylist()))
    return pa.table({"lang": table.column("lang")[:1], "shards": table.column("shards")[:1], "shard": table.column("shard")[:1], "by": pa.array([by.tobytes()], pa.binary()), "keys": pa.array([keys], pa.list_(pa.binary()))})


def perfect_hashes(terms: DataFrame, per_shard: int = PER_SHARD) -> DataFrame:
    """One row for each shard of a language: (lang, shards, shard, by, keys in the order of places, n, start)."""
    sized = terms.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / per_shard).cast("long").alias("shards"))
    numbered = terms.join(sized, "lang").select("lang", "term", "shards").mapInArrow(_number_shards, "lang string, term string, shards long, shard long")
    built = numbered.groupBy("lang", "shard").applyInArrow(_build, "lang string, shards long, shard long, by binary, keys array<binary>")
    return built.withColumn("n", F.size("keys").cast("long"))


def _recount(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, Table] = shared.value
        cells: dict[tuple[str, str], np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), of in cells.items():
                at = np.flatnonzero(of)
                start = tables[lang].starts.min()
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array([source] * len(at), pa.string()), pa.array(at + start, pa.int64()), pa.array(of[at])], names=["lang", "source", "slot", "n"])
            cells.clear()

        held = 0
        for batch in batches:
            words: dict[tuple[str, str], Counter] = defaultdict(Counter)
            for lang, source, text in _rows([batch]):
                if lang in tables:
                    words[lang, source].update(terms_of(text))
            for group, of in words.items():
                table = tables[group[0]]
                if group not in cells:
                    size = int((table.starts + table.sizes).max() - table.starts.min())
                    if cells and held + size > MOST_CELLS:
                        yield from out()
                        held = 0
                    cells[group], held = np.zeros(size, np.int64), held + size
                slot = table.find(list(of))
                n = np.fromiter(of.values(), np.int64, len(of))
                cells[group][slot[slot >= 0] - table.starts.min()] += n[slot >= 0]  # a word is once in `of`, so a slot is once in `slot`
        yield from out()
        give_back()

    return run


def counts_by_slot(docs: DataFrame, shards: DataFrame, most_shared: int, folders: list[str]) -> DataFrame:
    """(lang, source, slot, n > 0): occurrences of each kept term in each group. shards: see `perfect_hashes`, with start."""
    spark = docs.sparkSession
    sizes = shards.select("lang", "shard", "n", (F.length("by") + F.aggregate("keys", F.lit(0), lambda a, k: a + F.length(k) + 4)).alias("bytes")).orderBy("lang", "shard").collect()  # a row for some thousand terms
    passes: list[list] = []
    room = 0
    for r in sizes:
        if r["bytes"] > room:
            passes.append([])
            room = most_shared
        passes[-1].append((r["lang"], r["shard"]))
        room -= r["bytes"]
    found = []
    for own in passes:
        (lang_a, shard_a), (lang_z, shard_z) = own[0], own[-1]
        within = ((F.col("lang") > lang_a) | (F.col("lang") == lang_a) & (F.col("shard") >= shard_a)) & ((F.col("lang") < lang_z) | (F.col("lang") == lang_z) & (F.col("shard") <= shard_z))
        parts: dict[str, list] = defaultdict(list)
        count: dict[str, int] = {}
        for r in shards.where(within).toLocalIterator():
            parts[r["lang"]].append((r["shard"], r["start"], bytes(r["by"]), [bytes(k) for k in r["keys"]]))
            count[r["lang"]] = r["shards"]
        tables = {}
        for lang, of in parts.items():
            tables[lang] = Table.of(count[lang], sorted(of))
            here = tables[lang].sizes > 0
            tables[lang].starts[~here] = tables[lang].starts[here].min()
        shared = spark.sparkContext.broadcast(tables)
        found.append(stored(docs.mapInArrow(_recount(shared), "lang string, source string, slot long, n long").groupBy("lang", "source", "slot").agg(F.sum("n").alias("n")), folders))
        shared.destroy()
    if not found:
        return spark.createDataFrame([], "lang string, source string, slot long, n long")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 (count + 5) / total) in whole numbers, by long division: a product of both would overflow."""
    left = count + SMOOTH
    out = left // total
    left = left % total
    for _ in range(3):
        left = left * 1000
        out = out * 1000 + left // total
        left = left % total
    return out + 1


def _distances(table: pa.Table, block: int, tile: int) -> pa.Table:
    """Sums of absolute differences of shares over one block of slots, for the pairs of two tiles of sources.

    A row with slot -1 names a source of the tile: n is the divisor of its shares, width the block's slots."""
    lang, tile_a, tile_b = (table.column(c)[0].as_py() for c in ("lang", "tile_a", "tile_b"))
    at, slot, n, width = (table.column(c).to_numpy() for c in ("at", "slot", "n", "width"))
    head = slot < 0
    sources = np.sort(at[head])
    count, total = np.zeros((len(sources), int(width.max())), np.int64), np.zeros(len(sources), np.int64)
    total[np.searchsorted(sources, at[head])] = n[head]
    count[np.searchsorted(sources, at[~head]), slot[~head] % block] = n[~head]
    p = shares(count, total[:, None])
    a, b = np.flatnonzero(sources // tile == tile_a), np.flatnonzero(sources // tile == tile_b)
    i, j, value = [], [], []
    for k in a:
        others = b[b > k] if tile_a == tile_b else b
        i.append(np.full(len(others), sources[k]))
        j.append(sources[others])
        value.append(np.abs(p[others] - p[k]).sum(1))
    flat = [np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (i, j, value)]
    return pa.table({"lang": pa.array([lang] * len(flat[0]), pa.string()), "i": flat[0], "j": flat[1], "value": flat[2]})


def distances(groups: DataFrame, counts: DataFrame, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """(lang, i, j, value) for i < j. groups(lang, source, at, total, v): at numbers the sources of a language; counts: see `counts_by_slot`."""
    last = F.floor((F.col("v") - 1) / block).cast("long")
    heads = groups.where("v > 0").select("lang", "at", "v", F.col("total").alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))
    heads = heads.select("lang", "block", "at", F.lit(-1).cast("long").alias("slot"), "n", F.least(F.lit(block).cast("long"), F.col("v") - F.col("block") * block).alias("width"))
    cells = counts.join(groups.select("lang", "source", "at"), ["lang", "source"]).select("lang", F.floor(F.col("slot") / block).cast("long").alias("block"), "at", "slot", "n", F.lit(0).cast("long").alias("width"))
    tiles = groups.groupBy("lang").agg((F.floor(F.max("at") / tile).cast("long")).alias("last_tile"))
    rows = heads.unionByName(cells).withColumn("tile", F.floor(F.col("at") / tile).cast("long")).join(tiles, "lang")
    both = F.transform(F.sequence(F.lit(0).cast("long"), F.col("last_tile")), lambda t: F.struct(F.least(t, F.col("tile")).alias("a"), F.greatest(t, F.col("tile")).alias("b")))
    dealt = rows.select("lang", "block", "at", "slot", "n", "width", F.explode(both).alias("t")).select("lang", "block", "at", "slot", "n", "width", F.col("t.a").alias("tile_a"), F.col("t.b").alias("tile_b"))
    parts = dealt.groupBy("lang", "block", "tile_a", "tile_b").applyInArrow(lambda table: _distances(table, block, tile), "lang string, i long, j long, value long")
    return parts.groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))


def _share(count: Column, total: Column) -> Column:
    scaled = (count + SMOOTH).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", scaled, total.cast("decimal(19,0)")) + 1


def divergence(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = 30, top_terms: int = 50, per_shard: int = PER_SHARD, most_shared: int = 48 << 20, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """lang, source, part (`pair` or `term`), item, value, rank."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows, folders = docs.select(named(lang).alias("lang"), named(source).alias("source"), named(text).alias("text")), []
    terms = stored(kept_terms(rows, min_docs), folders)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("lang").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    shards = stored(perfect_hashes(terms, per_shard).withColumn("start", before), folders)
    dropped(docs.sparkSession, folders[:1])
    counts = counts_by_slot(rows, shards, most_shared, folders)

    sizes = shards.groupBy("lang").agg(F.sum("n").alias("v"))
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = rows.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce("v", F.lit(0).cast("long")).alias("v"))
    numbered = groups.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1)
    groups = stored(numbered.select("lang", "source", "at", "n", "v", (F.col("n") + SMOOTH * F.col("v")).alias("total")), folders)

    near = distances(groups, counts, block, tile)
    a, b = (groups.select("lang", F.col("source").alias(s), F.col("at").alias(k)) for s, k in (("source", "i"), ("item", "j")))
    pairs = a.join(b, "lang").where("i <> j").withColumns({"lo": F.least("i", "j"), "hi": F.greatest("i", "j")})
    near = near.withColumnsRenamed({"i": "lo", "j": "hi"})
    pairs = pairs.join(near, ["lang", "lo", "hi"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = pairs.withColumn("rank", F.row_number().over(order))

    names = shards.select("lang", "start", F.posexplode("keys").alias("place", "key")).select("lang", (F.col("start") + F.col("place")).alias("slot"), F.col("key").cast("string").alias("item"))
    whole = groups.groupBy("lang").agg(F.sum("n").alias("n"), F.max("v").alias("v")).select("lang", (F.col("n") + SMOOTH * F.col("v")).alias("lang_total"))
    totals = counts.groupBy("lang", "slot").agg(F.sum("n").alias("lang_n")).join(names.hint("merge"), ["lang", "slot"])  # all kept terms: no bound, so no broadcast
    totals = totals.join(whole, "lang")
    totals = totals.select("lang", "slot", "item", _share(F.col("lang_n"), F.col("lang_total")).alias("q"))
    own = counts.join(groups.select("lang", "source", "total"), ["lang", "source"]).select("lang", "source", "slot", _share(F.col("n"), F.col("total")).alias("p"))
    above = own.join(totals.hint("merge"), ["lang", "slot"]).where("p > q").select("lang", "source", F.lit("term").alias("part"), "item", (F.col("p") - F.col("q")).alias("value"))
    best = above.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_terms)
    return ranked.unionByName(best)


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
w AS (SELECT r, lang, source, unnest(ws) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS n, any_value(coalesce(v, 0)) AS v FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) LEFT JOIN v USING (lang) GROUP BY lang, source),
l AS (SELECT lang, sum(n)::HUGEINT AS n, any_value(v) AS v FROM g GROUP BY lang),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.n + 5 * g.v) AS p FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(c.n) + 5)) // (any_value(l.n) + 5 * any_value(l.v)) AS q FROM c JOIN l USING (lang) GROUP BY lang, term),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
y AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
z AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM x UNION ALL SELECT * FROM y))
SELECT lang, source, part, item, value, rank::INT AS rank FROM z WHERE part = 'pair' OR rank <= 50
"""

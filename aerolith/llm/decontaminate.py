"""Benchmark decontamination by one multi-pattern automaton over test questions.

Both sides are normalised alike: A-Z to lower case, words are runs of
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``, one space between words. Every window of
`window` consecutive words of an item (an item with fewer words, but not none,
is one window) becomes a pattern of an Aho-Corasick automaton. A text is
normalised and scanned once; the ends of the matches are mapped to word numbers
and, where spans are asked for, to code-point offsets of the original text.

Defined results: a null or empty text has no words and no hits; an item
without words is left out; one with a null id counts for hits but names no id; repeated rows each get their own result;
other columns of either table are not looked at.

An empty table gives an empty table; no items: no hits.

Size: the automaton holds at most `max_pattern_bytes` of patterns. A larger
benchmark is dealt by hash into several automata, which are collected, sent out
and applied one after the other. What a pass finds is written to the shared folder
before the next begins and adds to its hits, so driver and workers hold one
automaton at a time and no window is left out.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerolith.llm.common import dropped, fresh, rows_udf, stored

#: Bytes that end a word become a space, A-Z become a-z, all else stays.
FOLD = bytes(32 if c < 0x30 or 0x3A <= c <= 0x40 or 0x5B <= c <= 0x60 or 0x7B <= c <= 0x7F else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
WORD = re.compile(rb"[^ ]+")
RESULT = "n_words long, n_hit long, item_ids array<string>, hits array<struct<start:long,end:long>>, spans array<struct<start:long,end:long>>"


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


def windows_of(text: bytes | None, window: int) -> list[bytes]:
    w = words(text)
    return [b" %b " % b" ".join(w[k : k + window]) for k in range(max(1, len(w) - window + 1))] if w else []


def pattern_table(items: DataFrame, item_id: str, item_text: str, window: int) -> DataFrame:
    """(item, pattern) pairs, distinct; the item of a null id is null."""
    cut = rows_udf(lambda: lambda t: ([x.decode() for x in dict.fromkeys(windows_of(t, window))],), "patterns array<string>", text_as_bytes=True)
    kept = items.select(F.col(item_id).cast("string").alias("item"), cut(F.col(item_text)).alias("w"))
    return kept.select("item", F.explode("w.patterns").alias("pattern")).distinct()


def merged(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(intervals):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _scanner(shared, with_spans: bool):
    """The row function of one pass; the automaton is built once a task."""

    def start():
        automaton = ahocorasick.Automaton()
        for pattern, (size, ids) in shared.value.items():
            automaton.add_word(pattern.decode("latin-1"), (size, ids))
        automaton.make_automaton()
        ready = len(automaton) > 0

        def row(text, before):
            w = words(text)
            hits = [(h["start"], h["end"]) for h in before["hits"]] if before else []
            items = set(before["item_ids"]) if before else set()
            line = (b" %b " % b" ".join(w)).decode("latin-1")
            gaps = None
            for end, (size, ids) in automaton.iter(line) if ready and w else ():
                if gaps is None:  # the blanks of the normalised text; word j lies between blanks j and j + 1
                    gaps = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
                k = int(np.searchsorted(gaps, end))
                hits.append((k - size, k))
                items.update(ids)
            hits = merged(hits)
            spans = _original(text, hits) if with_spans and hits else []
            pairs = [{"start": a, "end": b} for a, b in hits]
            return len(w), sum(b - a for a, b in hits), sorted(items), pairs, [{"start": a, "end": b} for a, b in spans]

        return row

    return start


def _original(text: bytes, hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word intervals as code-point spans of the text they came from."""
    places = [m.span() for m in WORD.finditer(text.translate(FOLD))]
    at = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)  # code points up to and with each byte
    return [(int(at[places[a][0]]) - 1, int(at[places[b - 1][1] - 1])) for a, b in hits]


def with_contamination(docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 13, with_spans: bool = True, max_pattern_bytes: int = 6_000_000) -> DataFrame:
    """`docs` with a struct column as its last: n_words, n_hit, item_ids, hits (word intervals), spans (code points)."""
    spark = docs.sparkSession
    table, kept = pattern_table(items, item_id, item_text, window), []
    total = table.agg(F.sum(F.octet_length("pattern"))).first()[0] or 0
    passes = max(1, -(-total // max_pattern_bytes))
    if passes > 1:
        table = stored(table)
    out = fresh(docs, "scan")
    docs = docs.withColumn(out, F.lit(None).cast(T.StructType.fromDDL(RESULT)))
    for k in range(passes):
        patterns: dict[bytes, tuple[int, list[str]]] = {}
        for r in table.where(F.pmod(F.xxhash64("item", "pattern"), F.lit(passes)) == k).toLocalIterator():
            key = r["pattern"].encode()
            ids = patterns.setdefault(key, (key.count(b" ") - 1, []))[1]
            if r["item"] is not None:
                ids.append(r["item"])
        shared = spark.sparkContext.broadcast(patterns)
        docs = docs.withColumn(out, rows_udf(_scanner(shared, with_spans and k == passes - 1), RESULT)(F.col(text).cast("binary"), F.col(out)))
        if k < passes - 1:
            docs = stored(docs, kept)
            dropped(spark, kept[:-1])
            shared.destroy()
    return docs


def items_digest(ids: Column) -> Column:
    return F.sha2(F.array_join(ids, ","), 256)


def decontaminate(docs: DataFrame, items: DataFrame, *, id: str = "doc_id", text: str = "text", share: int = 20, **options) -> DataFrame:
    """One row per document: counts, matched items, spans and whether a `share`-th of its words is hit."""
    found = with_contamination(docs.select(F.col(id), F.col(text)), items, text=text, **options)
    return found.select(id, f"{found.columns[-1]}.*").withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))

"""Source divergence, toxicity and filter interaction against brute force, and on edges."""

import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from aerolith.llm import divergence, interaction, langid, perfecthash, simhash, toxicity
from aerolith.llm.transducer import compose, transducer

DOCS = "doc_id long, text string, lang string, source string, part string, mask int, cells string, n long, score double"


def docs(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, la, s, "x", 1, "x", 1, 1.0) for i, t, la, s in rows], DOCS)


# --- perfect hashes ---------------------------------------------------------------------------------------------------


@settings(max_examples=40, deadline=None)
@given(st.sets(st.binary(max_size=6), max_size=300), st.lists(st.binary(max_size=7), max_size=30))
def test_perfect_hash_is_minimal_and_verifies_keys(keys, others):
    by, order = perfecthash.build(sorted(keys))
    table = perfecthash.Table.of(3, [(1, 10, by.tobytes(), order)])
    first, _ = perfecthash.lanes(order)
    own = [k for k, s in zip(order, perfecthash.shard_of(first, 3), strict=True) if s == 1]
    places = table.find(own)
    assert [order[p - 10] for p in places] == own  # a key's place is its own
    strange = [w for w in others if w not in keys]
    assert (table.find(strange) == -1).all()
    whole = perfecthash.Table.of(1, [(0, 0, by.tobytes(), order)])
    assert sorted(whole.find(sorted(keys)).tolist()) == list(range(len(keys)))


# --- op11 -------------------------------------------------------------------------------------------------------------


def brute_divergence(rows, least, top):
    tokens = [(la or "", s or "", divergence.terms_of((t or "").encode())) for _, t, la, s in rows]
    df = defaultdict(Counter)
    for la, _, ws in tokens:
        df[la].update(set(ws))
    kept = {la: sorted(w for w, n in of.items() if n >= least) for la, of in df.items()}
    count = defaultdict(Counter)
    for la, s, ws in tokens:
        count[la, s].update(w for w in ws if w in set(kept[la]))
    whole = defaultdict(Counter)
    for (la, _), of in count.items():
        whole[la].update(of)

    def share(of, w, la):
        return 1 + 10**9 * (of[w] + 5) // (sum(of.values()) + 5 * len(kept[la]))

    out = []
    for la, s in count:
        pairs = [(-sum(abs(share(count[la, s], w, la) - share(count[la, o], w, la)) for w in kept[la]), o.encode()) for lo, o in count if lo == la and o != s]
        out += [(la, s, "pair", o.decode(), -v, k) for k, (v, o) in enumerate(sorted(pairs), 1)]
        terms = [(share(whole[la], w, la) - share(count[la, s], w, la), w) for w in count[la, s]]
        out += [(la, s, "term", w.decode(), -v, k) for k, (v, w) in enumerate([x for x in sorted(terms) if x[0] < 0][:top], 1)]
    return sorted(out)


def test_divergence_matches_brute_force_in_shards_passes_blocks_and_tiles(spark):
    rng = random.Random(5)
    words = [f"w{chr(97 + i)}{'éü日'[i % 3]}" for i in range(26)] + ["Same", "z" * 4000]
    rows = [(None if k == 3 else k % 50, " ".join(rng.choices(words, k=rng.randrange(40))) + rng.choice(["", " A-b c1d"]), rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "c", "é", None])) for k in range(90)]
    rows += [(1, None, "en", "a"), (2, "", "xx", "only"), (2, "", "yy", "p"), (3, None, "yy", "q"), (4, "123 !!", "en", "none")] + [(7, "Same same", "en", "a")] * 4
    want = brute_divergence(rows, 3, 5)
    for how in ({}, {"per_shard": 8, "most_shared": 300, "block": 4, "tile": 2}):
        got = divergence.divergence(docs(spark, rows), min_docs=3, top_terms=5, **how)
        assert sorted(tuple(r) for r in got.select("lang", "source", "part", "item", "value", "rank").collect()) == want
    assert divergence.divergence(docs(spark, [])).count() == 0
    none = divergence.divergence(docs(spark, rows[:4]), min_docs=100).collect()  # no term is kept: distances of 0
    assert none and all(r["value"] == 0 and r["part"] == "pair" for r in none)


def test_shares_are_exact_where_a_product_would_overflow():
    big = np.array([0, 7, 123_456_789_012, 8_999_999_999_999_990])
    for total in (1, 17, 999_999_999_989, 9_000_000_000_000_000):
        ok = big[big + 5 <= total]
        assert divergence.shares(ok, np.int64(total)).tolist() == [1 + 10**9 * (int(c) + 5) // total for c in ok]


# --- op13 -------------------------------------------------------------------------------------------------------------


def brute_interaction(rows, labels):
    blanks = " \t\n\v\f\r"
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    bad = {i for i, _, x in labels if x == 1 and i is not None}
    marked = []
    for i, t, part in rows:
        t = t or ""
        ws = "".join(" " if c in blanks else c for c in t).split(" ")
        ws = [w for w in ws if w]
        same = [j for j, u, _ in rows if (u or "") == t and j is not None]
        fails = {"A": len(ws) < 100, "B": 100 * len(set(ws)) < 80 * len(ws), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), "D": any(c in t for c in "#$%&*|"), "E": i is not None and any(j < i for j in same)}
        marked.append((part or "", {k for k, v in fails.items() if v}, i in good, i in bad))
    out = []
    for part in {p for p, *_ in marked}:
        own = [m for m in marked if m[0] == part]
        figures = {}
        for order in itertools.permutations("ABCDE"):
            for k, f in enumerate(order):
                before = set(order[:k])
                here = [m for m in own if f in m[1] and not m[1] & before]
                figures[order, k + 1] = (sum(not m[1] & {*before, f} for m in own), len(here), sum(f in m[1] and bool(m[1] & before) for m in own), sum(m[1] == {f} for m in own), sum(m[2] for m in here), sum(m[3] for m in here))
        shapley = Counter()
        for (order, k), of in figures.items():
            shapley[order[k - 1]] += of[1]
        out += [(part, "".join(order), k, *of, shapley[order[k - 1]]) for (order, k), of in figures.items()]
    return sorted(out)


def test_filter_interaction_matches_brute_force(spark):
    rng = random.Random(9)
    texts = [None, "", "AB cd", "x" * 50_000, " ".join(f"w{i}" for i in range(120)), " ".join("w" for _ in range(150)), "ÀÉ" * 30, "a b # c", "\v\f lead", " ".join(f"W{i}" for i in range(100))]
    rows = [(rng.choice([None, *range(30)]), rng.choice(texts), rng.choice(["en", "de", None, ""])) for _ in range(70)] + [(5, "twice", "en")] * 2 + [(6, "twice", "fr")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, 7])) for i in range(25)] + [(3, 1, 1), (3, 0, 0), (None, 1, 1), (99, 1, 1)]
    table = spark.createDataFrame([(*r, "clash") for r in labels], "doc_id long, quality int, toxic int, part string")
    got = interaction.interaction_audit(docs(spark, [(i, t, p, "s") for i, t, p in rows]), table)
    assert sorted(tuple(r) for r in got.collect()) == brute_interaction(rows, labels)
    assert interaction.interaction_audit(docs(spark, []), table).count() == 0
    empty = interaction.interaction_audit(docs(spark, [(1, "a", "en", "s")]), table.limit(0)).collect()
    assert len(empty) == 600 and {r["good_lost"] for r in empty} == {0}


def test_recursion_goes_beyond_the_row_limit_and_restores_it(spark):
    was = spark.conf.get(interaction.ROW_LIMIT)
    spark.conf.set(interaction.ROW_LIMIT, "1000")
    try:
        out = interaction.interaction_audit(docs(spark, [(i, "a", f"part{i}", "s") for i in range(8)]), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
        assert out.count() == 8 * 600 and spark.conf.get(interaction.ROW_LIMIT) == "1000"
    finally:
        spark.conf.set(interaction.ROW_LIMIT, was)


# --- op12 -------------------------------------------------------------------------------------------------------------

LEX = toxicity.Lexicon({b"dolt": 3.0, b"knave": 2.0}, {b"vequ": 4.0})


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("You are a dolt", "a"), ("what a dolt", "p"), ("A DOLT, you", "a"), ("dolt knave you", "pa"), ("you are no dolt", "n"), ("never a dolt", "n"), ("not so, a dolt", "p"),
        ("She said you dolt", "r"), ("“you dolt”", "r"), ("he said it. You dolt", "a"), ("I will kill you", "t"), ("kill the process", ""), ("do not kill him", "u"), ("he said: kill them", "u"),
        ("vequité", "p"), ("veq", ""), ("it is not that bad but what a knave", "p"), ("", ""), (None, ""), ("“dolt” and dolt", "rp"),
    ],
)
def test_grammar(text, kinds):
    found = [k for *_, of in toxicity.clauses(toxicity.folded(text), LEX, toxicity.grammar()) for k, _ in of]
    assert "".join(found) == kinds


def test_a_word_of_a_megabyte_is_scored_in_linear_time():
    import time

    start = time.process_time()
    toxicity.features("vequ" + "x" * 1_000_000 + " " + "veq " * 200_000 + "you dolt. " * 20_000, LEX)
    assert time.process_time() - start < 6


def test_composition_equals_one_after_the_other():
    rng = random.Random(2)
    parts = [toxicity._negation(), toxicity._reported(), toxicity._targets((1.0, 1.5, 0.5, 0.25, 2.0, 0.75))]
    whole = compose(compose(parts[0], parts[1]), parts[2])
    other = compose(parts[0], compose(parts[1], parts[2]))
    for _ in range(500):
        word = rng.choices("oihtnrqc", k=rng.randrange(14))
        written = [(s, 1.0) for s in word]
        for p in parts:
            written = [(s, w) for s, w in p.run([s for s, _ in written])]
        assert whole.run(word) == other.run(word) == written
        assert len(written) == sum(s in "ih" for s in word)


def test_weights_multiply_along_a_path():
    double = transducer(0, "a", lambda s, x: (0, (("a", 2.0),)), lambda s: ())
    third = transducer(0, "a", lambda s, x: (1 - s, (("b", 3.0),) if s else ()), lambda s: (("e", 5.0),) if s else ())
    assert compose(double, third).run("aaa") == [("b", 6.0), ("e", 5.0)]


def toxic_fixture(n):
    rng = random.Random(4)
    plain = [f"{a}{b}" for a in ("ba", "du", "ki", "lo", "mi") for b in ("ra", "sen", "tol", "vu", "nde", "x")]
    rows, labels = [], []
    for i in range(n):
        words = rng.choices(plain, k=rng.randrange(3, 60))
        bad = i % 6 == 0
        if bad:
            for _ in range(rng.randrange(1, 3)):
                words.insert(rng.randrange(len(words)), rng.choice(["grumf", "zwek" + rng.choice(plain)]))
        rows.append((i, " ".join(words) + ".", "en", "s"))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity_learns_words_and_beginnings(spark):
    rows, labels = toxic_fixture(600)
    copies = [(1000 + k, rows[0][1] + " onlyhere", "en", "s") for k in range(40)]  # one toxic text, many times
    labels += [(1000 + k, 1) for k in range(40)]
    edge = [(2000, None, None, None), (2001, "", "en", "s"), (2002, "z" * 200_000, "en", "s"), (None, "grumf", "en", "s"), (2003, "you zweknew", "en", "s"), (2003, "you zweknew", "en", "s"), (2004, "onlyhere bara", "en", "s")]
    table = spark.createDataFrame([(*r, "x") for r in labels] + [(2001, None, "x"), (2002, 5, "x"), (None, 1, "x")], "doc_id long, toxic int, text string")
    held = F.coalesce(F.col("doc_id") % 5 == 0, F.lit(False))
    out = toxicity.classify(docs(spark, rows + copies + edge), table, held).collect()
    assert len(out) == len(rows) + len(copies) + len(edge)
    by = {r["doc_id"]: r for r in out}
    truth = dict(labels)
    assert all(by[i]["predicted"] == truth[i] for i, *_ in rows)
    assert by[None]["predicted"] == 1 and by[2003]["predicted"] == 1 and [by[i]["predicted"] for i in (2000, 2001, 2002, 2004)] == [0, 0, 0, 0]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) and r["held_out"] == (r["doc_id"] is not None and r["doc_id"] % 5 == 0) for r in out)
    assert toxicity.classify(docs(spark, []), table, held).count() == 0


def test_toxicity_without_labels_and_spans(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = [(1, "You idiot. Fine day!", "en", "s"), (2, "Fine day", "en", "s")]
    out = {r["doc_id"]: r["score"] for r in toxicity.classify(docs(spark, rows), none, F.lit(False)).collect()}
    assert out[1] > out[2]
    model = toxicity.Model(LEX, toxicity.PRIOR)
    spans = docs(spark, [(1, "Hello. You dolt! Bye", "en", "s")]).select(toxicity.spans_column(F.col("text"), model).alias("c")).first()["c"]
    assert [(s["start"], s["end"], s["kinds"]) for s in spans] == [(6, 15, "a")] and spans[0]["weight"] == pytest.approx(3.0 * 1.2)


# --- op8, op10 --------------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    """The fingerprint by its definition, one bit at a time."""
    import re

    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_simhash_against_the_definition_with_many_rows_under_zero(spark):
    rng = random.Random(6)
    words = [f"W{i}é" if i % 5 == 0 else f"w{i}" for i in range(40)]
    texts = [None, "", " \t", "One", "one two", "\x0bA b\x0cC d"] + [rng.choice([" ", "  ", "\n"]).join(rng.choices(words, k=rng.randrange(1, 80))) for _ in range(120)]
    rows = [(k, t, "en", "s") for k, t in enumerate(texts)] + [(500 + k, rng.choice([None, "", " "]), "en", "s") for k in range(300)] + [(None, "", "en", "s")] * 3
    got = simhash.near_duplicates(docs(spark, rows)).select("doc_id", simhash.hex16(F.col("fp")).alias("h"), "component_id").collect()
    prints = [plain_fingerprint(t) for _, t, _, _ in rows]
    assert Counter((r["doc_id"], r["h"]) for r in got) == Counter((i, f"{p:016x}") for (i, *_), p in zip(rows, prints, strict=True))
    root = simhash.brute_components(prints)
    least = {}
    for (i, *_), r in zip(rows, root, strict=True):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    assert Counter((r["doc_id"], r["component_id"]) for r in got) == Counter((i, least[r]) for (i, *_), r in zip(rows, root, strict=True))
    assert simhash.near_duplicates(docs(spark, [])).count() == 0 and simhash.one_of_each(docs(spark, [])).count() == 0


def test_every_context_is_found_in_the_tables():
    rng = np.random.default_rng(1)
    own = np.unique(rng.integers(0, 1 << 40, 20_000))
    place = np.zeros(len(own), np.int64)
    tables = list(langid._tables(5, own, 100))
    for _, table, slot, of in tables:
        at = langid._slots(own, len(slot), table)
        place = np.where(slot[at] == own, of[at], place)
    assert (place == 100 + np.arange(len(own))).all() and 1 < len(tables) < 8
    assert list(langid._tables(4, own[:0], 7)) == []

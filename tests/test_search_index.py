"""The kept index of the second search, relevance by hand, the order of a page, chains by brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from aerolith.operators import records as rc
from aerolith.operators import search2 as s2
from aerolith.sources import commits

NAMES = [("airport", "AAA", ["alpha field", "alpha town"]), ("airport", "BBB", ["beta field"]), ("airline", "GAM", ["gamma alpha air"]), ("type", "T1", ["type t1", "t1"]), ("airport", "CCC", [])]


def _docs(spark, rows=NAMES):
    d = spark.createDataFrame([(k, i, i, p, 10) for k, i, p in rows], "kind string, id string, label string, phrases array<string>, pop long")
    return d.withColumn("codes", F.array("id"))


def _queries(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "q string")


def test_impacts_are_what_the_words_weigh(spark):
    got = {(r["word"], r["id"]): r["impact"] for r in s2.inverted_index(_docs(spark)).collect()}
    words = {i: " ".join(p).split() for _, i, p in NAMES}
    average = sum(len(w) for w in words.values() if w) / sum(1 for w in words.values() if w)
    want = {}
    for i, ws in words.items():
        for w in set(ws):
            df, tf = sum(w in o for o in words.values()), ws.count(w)
            want[w, i] = math.log(1 + (len(NAMES) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ws) / average))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_a_kept_index_answers_as_a_new_one(spark, tmp_path):
    root, docs = str(tmp_path / "index"), _docs(spark)
    q, none = _queries(spark, "alpha", "alpha field", "fie", "gamna", "betta field", "nothing", "", "  ALPHA   town ", "12"), _queries(spark).limit(0)
    first = s2.publish_index(spark, root, docs)
    kept, posts, known = s2.open_index(spark, root)
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    fresh = rows(s2.text_fit(q, docs, s2.inverted_index(docs), none))
    assert fresh == rows(s2.text_fit(q, kept, posts, none, known=known))
    top = {}
    for query, kind, id_, _, score, _ in fresh:
        top[query] = max(top.get(query, (0, "")), (score, id_))
    assert top["ALPHA"][1] == "AAA" and top["GAMNA"][1] == "GAM" and top["BETTA FIELD"][1] == "BBB" and top["FIE"][1] in ("AAA", "BBB") and "NOTHING" not in top
    # documents, postings and spellings change together, and the version before stays readable
    s2.publish_index(spark, root, _docs(spark, NAMES[:1]))
    now, posts, known = s2.open_index(spark, root)
    assert {r["id"] for r in now.collect()} == {r["id"] for r in posts.collect()} == {"AAA"} and known.where("word = 'beta'").count() == 0
    assert rows(s2.text_fit(q, *s2.open_index(spark, root, first)[:2], none, known=s2.open_index(spark, root, first)[2])) == fresh
    assert commits.current(spark, root).version == first + 1


def test_an_empty_index_and_no_query(spark):
    docs = _docs(spark)
    empty = docs.limit(0)
    assert s2.text_fit(_queries(spark, "alpha"), empty, s2.inverted_index(empty), _queries(spark).limit(0)).count() == 0
    assert s2.text_fit(_queries(spark).limit(0), docs, s2.inverted_index(docs), _queries(spark).limit(0)).count() == 0


def test_a_page_shows_sure_hits_first_and_three_of_a_kind(spark):
    offers = [("Q", "flight", f"F{i}", f"F{i}", 500.0 - i, None) for i in range(5)] + [("Q", "airport", "A1", "A1", 450.0, None), ("Q", "type", "T", "T", 1000.0, None), ("Q", "flight", "F4", "F4", 499.5, None)]
    d = spark.createDataFrame(offers, "q string, kind string, id string, label string, score double, reading string").drop("reading")
    assert [r["id"] for r in s2.fused(d).orderBy("rank").collect()] == ["T", "F0", "F4", "F1", "A1", "F2", "F3"]
    assert [r["id"] for r in s2.fused(d, 2).orderBy("rank").collect()] == ["T", "F0"]


def _chain(legs: dict[tuple[str, str], int], dominant: float = 0.7):
    """All orders of the legs are tried: a chain is one in which each flies on from the last and no stop is left twice."""
    rows = {k: n for k, n in legs.items() if k[0] != k[1]}
    if not rows:
        return None
    if len(rows) == 1:
        return list(next(iter(rows)))
    out = {a: b for a, b in rows}
    starts = [a for a in out if a not in {b for _, b in rows}]
    if len(out) == len(rows) == len({b for _, b in rows}) and len(starts) == 1:
        way = starts
        while way[-1] in out:
            way.append(out[way[-1]])
        if len(way) == len(rows) + 1:
            return way
    total = sum(rows.values())
    (a, b), n = max(rows.items(), key=lambda r: (r[1], r[0]))
    return [a, b] if total > 0 and n / total >= dominant else None


def test_chains_by_brute_force(spark):
    rng = random.Random(7)
    want, rows = {}, []
    for i in range(400):
        legs = {}
        for _ in range(rng.randint(1, 5)):
            legs[rng.choice("ABCDE"), rng.choice("ABCDE")] = rng.choice([0, 1, 2, 30])
        if (c := _chain(legs)) is not None:
            want[f"X{i}"] = c
        rows += [(f"X{i}", a, b, n) for (a, b), n in legs.items()]
    got = {r["callsign"]: r["chain"] for r in rc.schedule_chain(spark.createDataFrame(rows, "callsign string, org string, dst string, n_flights long")).collect()}
    assert got == want and {len(c) for c in want.values()} >= {2, 3, 4}

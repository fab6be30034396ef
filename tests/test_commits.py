"""Stores whose tables change together, with writers that are killed, done again, or work side by side."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from aerolith.sources import commits, sinks
from aerolith.streaming import live


def table(spark, rows, ddl="k int, v string"):
    return spark.createDataFrame(rows, ddl)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_several_tables_are_published_at_once(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "store")
    assert commits.publish(spark, root, {"a": table(spark, [(1, "old")]), "b": table(spark, [(2, "old")])}) == 1
    new = {"a": table(spark, [(1, "new")]), "b": table(spark, [(2, "new")])}

    def read():
        return [rows_of(commits.read_table(spark, root, n)) for n in ("a", "b")]

    # killed after the first table, between the tables and the manifest, and while the manifest is written
    real = commits._segment
    monkeypatch.setattr(commits, "_segment", lambda df, r, n, by=(): real(df, r, n, by) if n == "a" else (_ for _ in ()).throw(SystemExit))
    with pytest.raises(SystemExit):
        commits.publish(spark, root, new)
    monkeypatch.setattr(commits, "_segment", real)
    commit = commits._commit
    monkeypatch.setattr(commits, "_commit", lambda *a: (_ for _ in ()).throw(SystemExit))
    with pytest.raises(SystemExit):
        commits.publish(spark, root, new)
    monkeypatch.setattr(commits, "_commit", commit)
    (tmp_path / "store" / "versions" / "000000000002.json").write_text('{"version": 2, "tables": {"a"')
    assert read() == [[(1, "old")], [(2, "old")]]
    assert commits.publish(spark, root, new) == 3
    assert read() == [[(1, "new")], [(2, "new")]]
    assert rows_of(commits.read_table(spark, root, "a", 1)) == [(1, "old")]
    with pytest.raises(ValueError, match="expected"):
        commits.publish(spark, root, new, expected={"a": 5})
    assert len(commits.vacuum(spark, root, keep=1)) >= 4 and read() == [[(1, "new")], [(2, "new")]]
    with pytest.raises(KeyError):
        commits.read_table(spark, root, "a", 1)
    with pytest.raises(KeyError):
        commits.read_table(spark, root, "c")


def test_merge_adds_each_key_once_and_reads_its_own_days(spark, tmp_path, monkeypatch):
    root, ddl = str(tmp_path / "store"), "k int, at timestamp, v string"
    day = lambda n: dt.datetime(2026, 1, n, 12)
    merge = lambda rows, **how: commits.merge_once(table(spark, rows, ddl), root, "t", ["k", "at"], day=F.col("at"), **how)
    assert merge([(1, day(1), "a"), (1, day(1), "a"), (2, day(2), "b"), (None, None, "n")], writer="w", number=0) == 3
    assert merge([(1, day(1), "again"), (3, day(3), "c"), (None, None, "again")], writer="w", number=1) == 1
    assert merge([(9, day(9), "replayed")], writer="w", number=1) == 0  # this batch was merged before
    assert merge([], writer="w", number=2) == 0
    want = [(1, day(1), "a"), (2, day(2), "b"), (3, day(3), "c")]
    got = commits.read_table(spark, root, "t")
    assert rows_of(got.where("k is not null")) == want and got.count() == 4 and got.columns == ["k", "at", "v"]
    opened = []
    real = commits._rows
    monkeypatch.setattr(commits, "_rows", lambda s, r, t, days: opened.append([x["path"] for x in t["segments"] if days is None or set(days) & set(x["days"])]) or real(s, r, t, days))
    assert merge([(3, day(3), "x"), (4, day(3), "d")]) == 1 and len(opened[0]) == 1  # of two segments one has that day
    commits.compact(spark, root, "t")
    assert len(commits.current(spark, root).tables["t"]["segments"]) == 1 and commits.read_table(spark, root, "t").count() == 5
    assert merge([(3, day(3), "x")]) == 0
    assert commits.drop_days(spark, root, "t", "2026-01-02") == ["2026-01-01"]
    assert rows_of(commits.read_table(spark, root, "t").where("k is not null")) == [(2, day(2), "b"), (3, day(3), "c"), (4, day(3), "d")]


def test_two_writers_side_by_side(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "store")
    commit, other = commits._commit, [True]

    def late(*a):
        if other:  # another writer commits the same key between this one's reading and its commit
            other.clear()
            commits.merge_once(table(spark, [(1, "other"), (2, "other")]), root, "t", ["k"])
        return commit(*a)

    monkeypatch.setattr(commits, "_commit", late)
    assert commits.merge_once(table(spark, [(1, "own"), (3, "own")]), root, "t", ["k"]) == 1
    assert rows_of(commits.read_table(spark, root, "t")) == [(1, "other"), (2, "other"), (3, "own")]


def test_sinks_use_the_store(spark, tmp_path):
    root = str(tmp_path / "public")
    tables = {"a": table(spark, [(1, "x"), (2, "secret")]), "b": table(spark, [(3, "y")])}
    done = sinks.export_public(spark, tables, root, cuts={"a": lambda d: d.where("k = 1")}, blank={"b": ["v"]})
    assert done["tables"]["a"]["rows"] == 1 and rows_of(commits.read_table(spark, root, "b")) == [(3, None)]
    chunk = lambda d, x: table(spark, [(d, 1, x)], "day string, chunk int, x string")
    track = lambda d: table(spark, [(d, "a1b2c3")], "day string, hex string")
    replay = str(tmp_path / "replay")
    for d, x in (("d1", "old"), ("d2", "two"), ("d1", "new")):
        sinks.write_replay(chunk(d, x), track(d), table(spark, [(d, x)], "day string, x string"), replay)
    assert rows_of(commits.read_table(spark, replay, "days")) == [("d1", "new"), ("d2", "two")]
    assert rows_of(commits.read_table(spark, replay, "chunks")) == [("d1", 1, "new"), ("d2", 1, "two")]
    assert {r["shard"] for r in commits.read_table(spark, replay, "tracks").collect()} == {"c3"}
    messages = table(spark, [("EGGX", dt.datetime(2026, 1, 1), "m"), ("EGGX", dt.datetime(2026, 1, 1), "m")], "issuer string, valid_from timestamp, text string")
    assert [sinks.keep_messages(messages, str(tmp_path / "tracks")) for _ in range(2)] == [1, 0]
    events = table(spark, [("a1", 1.7e9, "7700"), ("b2", 1.7e9, "7700")], "hex string, at double, code string")
    assert [live.write_events_once(events, str(tmp_path / "events"), n) for n in (0, 0, 1)] == [2, 0, 0]

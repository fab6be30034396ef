"""Seeded, saved and restored stream state against batch twins."""

import random

from pyspark.sql import functions as F

from aerolith import schemas
from aerolith.streaming import state

T0 = 1_700_000_000


def position(spark, rows):
    """positions of (hex, t, cruising)."""
    made = [(h, f"F{h} ", "B738", "R", 50.0 + t % 7, 8.0, 35000 if up else 3000, False, 450.0, 90.0, "A3", None, 2.0, 1.0, 0.0, None, float(T0 + t)) for h, t, up in rows]
    P = schemas.struct(schemas.POSITIONS)
    names = [f.name for f in P.fields]
    df = spark.createDataFrame(made, ", ".join(f"{n} {'double' if n == 'ts' else P[n].dataType.simpleString()}" for n in names))
    return df.withColumn("ts", F.timestamp_seconds("ts"))


def run(spark, tmp_path, batches, start, mode, name):
    """Rows that a stream over one file for each batch gives; start(stream) is the operator."""
    state.state_store(spark)
    for k, rows in enumerate(batches):
        position(spark, rows).coalesce(1).write.parquet(str(tmp_path / name / f"b={k:03d}"))
    out = []
    stream = spark.readStream.schema(schemas.struct(schemas.POSITIONS)).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / name / "b=*"))
    q = start(stream).writeStream.foreachBatch(lambda df, n: out.extend(df.collect())).outputMode(mode).option("checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(150)
    finally:
        q.stop()
    return out, str(tmp_path / f"{name}-cp")


def test_seeded_sky_equals_batch_and_keeps_what_is_known(spark, tmp_path):
    snapshot = position(spark, [("aa", 500, True), ("bb", 40, True), ("cc", -400, True), ("dd", 95, True)])
    batches = [[("aa", 10, True), ("ee", 12, True)], [("ee", 60, True), ("aa", 5, True)], [("ff", 100, True), ("ff", 90, False)]]
    out, checkpoint = run(spark, tmp_path, batches, lambda s: state.sky_stream(s, snapshot, late="0 seconds"), "update", "sky")
    got = {r["hex"]: (r["seeded"], r["t"]) for r in state.sky_of(spark, checkpoint).collect()}
    rows = [r for b in batches for r in b]
    want = {r["hex"]: (r["seeded"], r["t"]) for r in state.seeded_sky_batch(position(spark, rows), snapshot, T0 + 100).collect()}
    assert got == want == {"dd": (True, T0 + 95.0), "ee": (False, T0 + 60.0), "ff": (False, T0 + 100.0)}
    gone = {r["hex"] for r in out if r["change"] == "gone"}
    assert gone == {"aa", "bb", "cc"}  # a report replaces the snapshot's row, however new that was; an old row of a known aircraft changes nothing
    seen = [(r["hex"], r["t"] - T0) for r in out if r["change"] == "seen"]
    assert sorted(seen) == [("aa", 10.0), ("ee", 12.0), ("ee", 60.0), ("ff", 100.0)]


def events(rows):
    return sorted((r["hex"], r["change"], r["at"].timestamp(), r["since"], r["callsign"], r["lat"]) for r in rows)


def test_lost_events_equal_batch_over_batches_that_go_back_in_time(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for h in ("a1", "b2", "c3", "d4"):
        t = 0
        while t < 6000:
            rows.append((h, t, rng.random() < 0.75))
            t += rng.choice([10, 30, 80, 90, 91, 200, 899, 900, 901, 1500])
    rows.sort(key=lambda r: r[1])
    end = ("zz", 9000, False)  # moves the watermark past all that is silent
    batches = [rows[k : k + 12] for k in range(0, len(rows), 12)] + [[end], [("zz", 9001, False)]]
    repeats = [[*b, *b[:2], *([batches[k - 1][-1]] if k else [])] for k, b in enumerate(batches)]  # again, and late
    out, _ = run(spark, tmp_path, repeats, lambda s: state.lost_events(s, late="0 seconds"), "append", "lost")
    want = state.lost_events_batch(position(spark, [*rows, end]), T0 + 9000).collect()
    assert events(out) == events(want) and {r["change"] for r in want} == {"lost", "over", "heard"}


def test_lost_timeline_is_a_chain_of_two_states(spark, tmp_path):
    batches = [[("a1", 0, True), ("b2", 10, True)], [("c3", 320, True)], [("zz", 3000, False)], [("zz", 6000, False)], [("zz", 9000, False)]]
    out, _ = run(spark, tmp_path, batches, lambda s: state.lost_timeline(s, late="0 seconds"), "append", "chain")
    found = {r["slice"].timestamp() - T0: r["lost"] for r in out}
    twin = state.lost_events_batch(position(spark, [r for b in batches for r in b]), T0 + 9000).where("change = 'lost'").count()
    assert sum(found.values()) == twin == 3
    assert min(found) > 90 - 300  # none is told before it is lost


def test_book_is_read_from_the_state_store_and_restored(spark, tmp_path):
    first = [[("a1", 0, True), ("b2", 0, False), ("old", -20_000, True)], [("c3", 30, True)]]
    told, checkpoint = run(spark, tmp_path, first, lambda s: state.lost_events(s, late="30000 seconds"), "append", "one")
    assert not told
    state.save_book(spark, checkpoint, str(tmp_path / "book"), T0 + 60, keep_s=8 * 3600)
    fresh = state.saved_book(spark, checkpoint, T0 + 60, keep_s=3600)
    assert {r["hex"] for r in fresh.collect()} == {"a1", "c3"}  # b2 did not cruise, old is stale
    saved = spark.read.parquet(str(tmp_path / "book"))
    assert {r["hex"] for r in saved.collect()} == {"a1", "c3", "old"}
    # a changed query (another limit) starts from the book; a1 is heard at once, c3 stays silent
    second = [[("a1", 70, True)], [("zz", 400, False)], [("zz", 401, False)]]
    out, _ = run(spark, tmp_path, second, lambda s: state.lost_events(s, saved.where("hex <> 'old'"), lost_s=200, late="0 seconds"), "append", "two")
    assert sorted((r["hex"], r["change"], r["since"] - T0, r["at"].timestamp() - T0) for r in out) == [("a1", "lost", 70.0, 270.0), ("c3", "lost", 30.0, 230.0)]

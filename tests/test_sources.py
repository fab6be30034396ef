"""Heatmaps cut into ranges, grids in one pass, and table functions against their DataFrame forms."""

import gzip
import random
import struct

import pytest
from pyspark.sql import functions as F

from aerolith.functions import tables
from aerolith.functions import text as tx
from aerolith.operators import filters as fl
from aerolith.sources import heatmap as hm
from aerolith.sources import tracks


def heat_bytes(slices, rng):
    """Bytes of a heatmap, and its records as the reader should give them."""
    out, rows = struct.pack("<iiii", 5, 6, 7, 8), []  # a record before the first header belongs to no slice
    for k in range(slices):
        ms = 1_700_000_000_000 + k * 15_000
        out += struct.pack("<iiii", hm.MAGIC, *(x - (1 << 32) if x >= 1 << 31 else x for x in (ms >> 32, ms & 0xFFFFFFFF)), 0)
        for _ in range(rng.randrange(0, 9)):
            hex_ = rng.randrange(1 << 24)
            if rng.random() < 0.2:
                out += struct.pack("<ii8s", hex_, (1 << 30) + 7700, b"SIA322  ")
                rows.append((k, ms / 1000, "info", f"{hex_:06x}", None, None, None, False, None, "SIA322", f"{((1 << 30) + 7700) & 0xFFFF:04d}"))
                continue
            lat, lon, ground, slow = rng.randrange(-90_000_000, 90_000_000), rng.randrange(-180_000_000, 180_000_000), rng.random() < 0.2, rng.random() < 0.2
            alt, speed = -123 if ground else rng.randrange(-100, 1800), -1 if slow else rng.randrange(0, 6000)
            out += struct.pack("<iiihh", hex_ | rng.choice([0, 1 << 24]), lat, lon, alt, speed)
            rows.append((k, ms / 1000, "position", f"{hex_:06x}", lat / 1e6, lon / 1e6, None if ground else alt * 25, ground, None if slow else speed / 10, None, None))
    return out + b"half a rec", rows


@pytest.mark.parametrize(("range_bytes", "block_bytes"), [(64 << 20, 1 << 20), (160, 48), (16, 16), (1000, 4096)])
def test_heatmap_ranges_give_every_record_once(spark, tmp_path, range_bytes, block_bytes):
    rng = random.Random(range_bytes)
    want = []
    for name, slices in (("a.bin", 12), ("b.bin", 1), ("c.bin", 7), ("none.bin", 0)):
        data, rows = heat_bytes(slices, rng)
        if name == "c.bin":  # packed, in two members
            data = gzip.compress(data[:100]) + gzip.compress(data[100:])
        (tmp_path / name).write_bytes(data)
        want += [(str(tmp_path / name), *r) for r in rows]
    (tmp_path / "empty.bin").write_bytes(b"")
    got = hm.decode_heatmap(spark, str(tmp_path), range_bytes, block_bytes)
    assert [c for c, _ in got.dtypes] == [c.split()[0] for c in hm.HEAT.split(", ")]
    key = lambda r: [(x is not None, x) for x in r]
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(want, key=key)
    assert {r["hex"] for r in hm.day_hexes(got).collect()} == {r[4] for r in want}


def test_heatmap_partitions_and_table_function(spark, tmp_path):
    data, rows = heat_bytes(40, random.Random(1))
    (tmp_path / "a.bin").write_bytes(data)
    spark.dataSource.register(hm.HeatmapSource)
    read = spark.read.format("heatmap").option("rangeBytes", 320).load(str(tmp_path / "a.bin"))
    assert read.rdd.getNumPartitions() == -(-len(data) // 320)
    tables.register_tables(spark)
    spark.createDataFrame([(bytearray(data),), (bytearray(gzip.compress(data)),), (None,)], "content binary").createOrReplaceTempView("heat_files")
    got = spark.sql("SELECT h.* FROM heat_files, LATERAL obs_heatmap(content) h").collect()
    key = lambda r: [(x is not None, x) for x in r]
    assert sorted((tuple(r) for r in got), key=key) == sorted(rows * 2, key=key)


def test_track_messages_as_a_table_function(spark):
    text = "(NAT-1/2 TRACKS FLS 310/390 INCLUSIVE\nA SUNOT 5820/20 58/30 56/40 CRONO\nEAST LVLS NIL\nWEST LVLS 310 320 330\n"
    more = "B 55/20 54/30 YAZ--\r\nEAST LVLS 350\nREMARKS TMI IS 266 AND\nC XX 99/20 1/2\n"
    parts = [("EGGX", "s", "e", 2, more), ("EGGX", "s", "e", 1, text), ("CZQX", "s", "e", None, "D AA 50/10 51/20 BB\nEAST LVLS 310\nWEST LVLS 320"), ("CZQX", "s2", "e", 1, None)]
    df = spark.createDataFrame(parts, "issuer string, start_datetime string, end_datetime string, part_no int, condition_message string")
    tables.register_tables(spark)
    df.createOrReplaceTempView("track_parts")
    got = spark.sql("SELECT * FROM obs_track_messages(TABLE(track_parts) PARTITION BY (issuer, start_datetime, end_datetime))")
    want = tracks.parse_track_messages(df).select(*got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 3


def test_query_readings_as_a_table_function(spark):
    qs = ["SQ 322", "sq322", "SIA 12a", "777", "7 77", "9V SKA", "sin lhr", "SIN-LHR", "from a to b", "to b from a", "flights to b from a", "a → b", "new york - london", "flights sin lhr", "to to", "x", "", None, "a -> b", "12 34", "fleet of sq", "from x → y", "3K 511"]
    df = spark.createDataFrame([(q,) for q in qs], "q string")
    tables.register_tables(spark)
    df.createOrReplaceTempView("typed_queries")
    got = {(r["q"], r["reading"], r["first"], r["second"]) for r in spark.sql("SELECT q, r.* FROM typed_queries, LATERAL obs_query_readings(q) r").collect()}
    norm = tx.norm_query("q")
    flights = df.select("q", F.lit("flight"), tx.flight_number("q").alias("f")).where("f is not null").select("q", "flight", "f.*")
    registrations = df.where(norm.rlike("^[A-Z0-9]{1,2} [A-Z0-9]{2,5}$")).select("q", F.lit("registration"), tx.compact(norm), F.lit(None).cast("string"))
    pairs = df.select("q", F.lit("places"), tx.places("q").alias("p")).where("p is not null").select("q", "places", "p.*")
    assert got == {tuple(r) for df in (flights, registrations, pairs) for r in df.collect()}


def plain_side(points, west, south, east, north, most):
    """Eight bisections, one count each."""
    fits = max(0.01, ((east - west) * (north - south) / most) ** 0.5)
    k = 0
    for step in range(8):
        ahead = k + (128 >> step)
        side = fits * 16 ** (-ahead / 256)
        if len({((lon - west) % 360 // side, (lat - south) // side) for lat, lon in points}) <= most:
            k = ahead
    return fits * 16 ** (-k / 256)


@pytest.mark.parametrize("spread", [0.05, 1.0, 9.0])
def test_grid_is_found_in_one_pass(spark, spread):
    rng = random.Random(7)
    points = [(min(9.9, max(0.1, rng.gauss(5, spread))), min(9.9, max(0.1, rng.gauss(5, spread)))) for _ in range(400)]
    df = spark.createDataFrame([(f"{k:04d}", *p) for k, p in enumerate(points)], "hex string, lat double, lon double").repartition(5)
    box = (0.0, 0.0, 10.0, 10.0)
    side = fl.grid_side(df, *box, most=50).first()["side"]
    assert side == plain_side(points, *box, 50)
    shown = {r["hex"] for r in fl.thin_to_grid(df, *box, most=50).collect()}
    first = {}
    for k, (lat, lon) in enumerate(points):
        first.setdefault((lon // side, lat // side), f"{k:04d}")
    assert shown == set(first.values()) and len(shown) <= 64  # where nothing is found to fit, the coarsest grid is taken
    assert fl.thin_to_grid(df, *box, most=400).count() == 400 and fl.thin_to_grid(df.limit(0), *box).count() == 0

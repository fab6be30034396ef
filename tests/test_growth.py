"""Steps whose work must grow no faster than their input, held against plain loops; angles at their limits."""

import datetime as dt

from aerolith.functions import geo
from aerolith.operators import estimate as es
from aerolith.operators import registry as rg
from aerolith.operators import windows as wi
from aerolith.plans.lenses import lens
from aerolith.plans.sky import tracks_in_force
from pyspark.sql import functions as F


def test_occurrences_meet_airframes_once(spark):
    d = lambda n: None if n is None else dt.date(2020, 1, 1) + dt.timedelta(n)
    spells = [(1, "C-GAA", 0, 100), (1, "CGAA", 300, 400), (1, "C-GBB", 90, 200), (2, "C-GAA", None, None), (3, "C-GBB", None, 50), (3, "C-GAA", 20, None), (4, "C-GCC", 0, 9), (5, None, 0, 9)]
    s = spark.createDataFrame([(a, "registration", v, d(f), d(t)) for a, v, f, t in spells], "airframe_id long, kind string, value string, first_date date, last_date date")
    occ = [(n, ("C-GAA", "c-gbb", "C-GDD")[n % 3], None if n % 11 == 10 else dt.datetime(2020, 1, 1, n % 2) + dt.timedelta(n * 7 % 500 - 60)) for n in range(400)]
    o = spark.createDataFrame(occ, "number long, registration string, at timestamp")
    got = rg.attach_occurrences(o, s)
    want, norm = {}, lambda r: r and r.upper().replace("-", "")
    for n, reg, at in occ:
        for a, v, f, t in spells:
            day = at and (at.date() - dt.date(2020, 1, 1)).days
            fits = norm(v) == norm(reg) and (f is None or (at is not None and day >= f - 30)) and (t is None or (at is not None and day <= t + 30))
            if fits:
                want[a, at] = max(want.get((a, at), 0), n)
    assert {(r["airframe_id"], r["at"]): r["number"] for r in got.collect()} == want
    assert got.count() == len(want)
    # nothing is sorted out after the join of marks
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()


def test_bearing_over_the_pole_is_due_north(spark):
    rows = [(-66.0, -58.0, -12.0, -58.0), (42.0, -14.0, -36.0, 166.0), (38.0, 94.0, -24.0, -86.0), (-58.0, 166.0, -36.0, 166.0), (-40.0, -140.0, 30.0, 40.0), (56.0, 68.0, 42.0, 68.0), (48.0, -30.0, -10.0, 150.0), (10.0, -170.0, 20.0, 10.0)]
    p = spark.createDataFrame(rows, "a double, b double, c double, d double")
    turns = p.select(F.explode(F.array(*map(F.lit, (80.0, 100.0, 260.0, 280.0)))).alias("track"), geo.bearing("a", "b", "c", "d").alias("br"))
    assert turns.where(F.abs(geo.angle_diff("track", "br")) == 100).count() == 2 * len(rows)
    assert turns.where(geo.angle_between("br", "track") == 100).count() == 2 * len(rows)


def test_legs_without_an_end_come_last_of_equals(spark):
    rows = [("aa", "AAX1", dt.date(2020, 1, 1), "A01", x, 5, None) for x in (None, "A02", "A03")]
    legs = spark.createDataFrame(rows, "hex string, callsign string, date date, org string, dst string, dep_ts long, arr_ts long")
    assert [r["dst"] for r in wi.recent(legs, ["hex"], 3).orderBy("rank").collect()] == ["A02", "A03", None]


def test_equal_ocean_tracks_are_met_once(spark, monkeypatch):
    path = [{"lat": 50.0 + i / 10, "lon": -70.0 + 10 * i} for i in range(8)]
    tracks = spark.createDataFrame([("E", [320, 380], [], path, 0.0, 86400.0)] * 40 + [("E", [320, 380], [], path[:7], 0.0, 86400.0)], "direction string, east_levels array<int>, west_levels array<int>, path array<struct<lat:double,lon:double>>, valid_from double, valid_to double")
    points = spark.createDataFrame([("aa", 100.0, 50.25, -45.0, 35000, 90.0), ("bb", 90000.0, 50.25, -45.0, 35000, 90.0)], "hex string, t double, lat double, lon double, alt_ft int, track double")
    seen = []
    monkeypatch.setattr(es, "tracks_active", lambda m, p, at: seen.append(m.count()) or rg.tracks_active(m, p, at))
    got = {r["hex"]: r["waypoints"] and len(r["waypoints"]) for r in es.match_ocean_track(points, tracks, ["hex", "t"]).collect()}
    assert seen == [2] and got == {"aa": 4, "bb": None}


def test_messages_of_one_period_travel_together(spark):
    m = spark.range(2500).selectExpr("id", "cast(id % 2 * 40000 as double) as valid_from", "cast(id % 2 * 40000 + 90000 as double) as valid_to")
    p = spark.createDataFrame([("a", 0.0), ("b", 40000.0), ("c", 90001.0), ("d", 130001.0)], "hex string, t double")
    got = rg.tracks_active(m, p, "t")
    assert got.columns == ["hex", "t", "id", "valid_from", "valid_to"]
    assert {r["hex"]: (r["n"], r["u"]) for r in got.groupBy("hex").agg(F.count("id").alias("n"), F.countDistinct("id").alias("u")).collect()} == {"a": (1250, 1250), "b": (2500, 2500), "c": (1250, 1250)}
    assert "explode(_m" in got._jdf.queryExecution().executedPlan().toString()


def test_points_of_a_day_travel_together_and_write_little(spark, tmp_path):
    m = spark.range(3000).selectExpr("id", "cast(id % 14 * 7200 as double) as valid_from", "cast(id % 14 * 7200 + if(id % 14 = 13, -1, 43200) as double) as valid_to")
    p = spark.range(4500).selectExpr("concat('h', id % 50) as hex", "cast(if(id % 100 = 99, null, id * 7919 % 4500 * 30) as double) as t").repartition(3)
    stamped = [d.withColumns({c: F.timestamp_seconds(c) for c in d.columns if d.schema[c].dataType.simpleString() == "double"}) for d in (m, p)]
    digest = lambda d: d.agg(F.count("*"), *[F.sum(F.xxhash64(*[F.col(c).cast(k) for c, k in kinds]).cast("decimal(38,0)")) for kinds in [[("hex", "string"), ("t", "double"), ("id", "long"), ("valid_from", "double"), ("valid_to", "double")]]]).first()
    want = digest(p.join(m, F.col("t").between(F.col("valid_from"), F.col("valid_to"))))
    size = lambda d, name: d.write.parquet(f"{tmp_path}/{name}") or sum(f.stat().st_size for f in (tmp_path / name).glob("*.parquet"))
    packed = rg.tracks_active(m, p, "t", lots=2)
    assert want[0] > 1_000_000 and digest(packed) == want and digest(rg.tracks_active(*stamped, "t", lots=3)) == want
    assert packed.columns == rg.tracks_active(m, p, "t").columns
    assert size(packed.select("hex", "t", "id"), "packed") * 4 < size(rg.tracks_active(m, p, "t").select("hex", "t", "id"), "plain")
    query = tracks_in_force(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "inline(filter(_p" in query and "Broadcast" not in query
    stages = packed._jdf.queryExecution().executedPlan().toString().split("Generate inline(filter")  # a lambda is not compiled into the join's loop
    assert len(stages) == 2 and "Generate explode(_m" in stages[0]


def test_rows_that_have_arrived_cost_no_more_steps(monkeypatch):
    sizes, forward = [], es._rad_forward
    monkeypatch.setattr(es, "_rad_forward", lambda lat, *x: sizes.append(len(lat)) or forward(lat, *x))
    dts = [60.0] * 50 + [28800.0]
    out = es.converge([50.0] * 51, [0.0] * 51, [90.0] * 51, [480.0] * 51, dts, [50.0] * 51, [120.0] * 51)
    assert out["lat"].notna().all() and sum(sizes) == 50 * 2 + 960


def test_lines_of_the_legs_are_joined_twice_only(spark):
    plan = lens(spark, "/root/testdata/sf0.001", "legs")._jdf.queryExecution().optimizedPlan()

    def joins(node, above):
        above += node.nodeName() == "Join"
        if node.children().isEmpty():
            return [above] if "l_quantity" in node.toString() else []
        return [n for i in range(node.children().size()) for n in joins(node.children().apply(i), above)]

    assert joins(plan, 0) == [2]  # by order, which knows its customer, and by supplier


def test_newest_days_hold_the_whole_window_however_far_back_the_newest_row_lies(spark):
    from datetime import date, timedelta

    first, last = date(1999, 1, 1), date(2001, 12, 31)
    for newest in (last, last - timedelta(days=90), last - timedelta(days=700), first):
        rows = spark.createDataFrame([(newest - timedelta(days=d),) for d in (0, 60, 61, 500)], "date date")
        held = {r[0] for r in wi.newest_days(rows, 60, first, last).collect()}
        assert {newest, newest - timedelta(days=60)} <= held
    assert wi.newest_days(spark.createDataFrame([], "date date"), 60, first, last).count() == 0


def test_timetable_joins_the_lines_of_its_days_only(spark, monkeypatch):
    from aerolith.plans import flights

    cut = []
    monkeypatch.setattr(wi, "checkpointed", lambda df: cut.append(df) or df)
    flights.recent_legs(spark, "/root/testdata/sf0.01")
    lines = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet").count()
    below = [n for n in cut[0]._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in n and "l_shipdate" in n]
    assert below and cut[0].count() < lines / 10


def test_chains_are_one_aggregate_without_copies_of_the_rows(spark):
    from aerolith.operators import records as rc

    rows = [("A", "X", "Y", 1), ("A", "Y", "Z", 1), ("B", "X", "Y", 9), ("B", "Y", "X", 1), ("C", "X", "Y", 1), ("C", "Y", "X", 1), ("D", "X", "Y", None), ("E", "X", "Y", 7), ("E", "X", "Z", 3), ("F", "X", "X", 4), ("G", "A", "B", 1), ("G", "C", "D", 1)]
    out = rc.schedule_chain(spark.createDataFrame(rows, "callsign string, org string, dst string, n_flights long"))
    assert {r["callsign"]: r["chain"] for r in out.collect()} == {"A": ["X", "Y", "Z"], "B": ["X", "Y"], "D": ["X", "Y"], "E": ["X", "Y"]}
    assert "Expand" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_typed_queries_work_the_routes_out_once(spark):
    plan = lens(spark, "/root/testdata/sf0.001", "typed")._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation" in x and "l_suppkey" in x for x in plan.splitlines()) == 1


def test_marks_are_met_by_all_that_is_typed(spark):
    from aerolith.operators import search2 as s2

    docs = s2.docs_airframe(spark.createDataFrame([(f"{i:06x}", f"R-{i}", "A", "T1") for i in (1, 12, 123, 1234, 2345)], "hex string, registration string, operator_icao string, type_code string"))
    q = spark.createDataFrame([("R-123",), ("r12",), ("R-9",)], "q string")
    out = s2.score_codes(q, docs, q.selectExpr("upper(q) as q", "cast(null as string) as about"), q.limit(0))
    assert {(r["q"], r["label"]) for r in out.collect()} == {("R-123", "R-123"), ("R-123", "R-1234"), ("R12", "R-12"), ("R12", "R-123"), ("R12", "R-1234")}
    joins = [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x and "StartsWith" in x]
    assert joins and not any("substring" in x or "= 3" in x for x in joins)
    heads = [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if ", 1, 3) AS" in x]
    assert not heads  # no pairs by the first three letters


def test_only_times_of_the_ends_that_are_asked_for_are_ranked(spark):
    from aerolith.plans import sky

    plan = sky._checked(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert any("LeftSemi" in x and "side" in x for x in plan)


def test_flight_records_read_the_log_once(spark):
    from aerolith.plans import details

    plan = details.flight_records(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not any("Relation" in x and "l_suppkey" in x for x in plan)


def test_points_of_a_cell_find_their_place_among_its_edges(monkeypatch):
    import numpy as np
    from aerolith.functions import crossings as cr

    def plain(y1, x1, y2, x2, lat, lon, right, low):
        with np.errstate(all="ignore"):
            at = lambda y: (x2 - x1) * (y - y1) / (y2 - y1) + x1
            seen = lambda y, x: ((y1 > y) != (y2 > y)) & (x < at(y))
            return (seen(lat[:, None], lon[:, None]).sum(1) + seen(low, right).sum()) % 2 == 1

    r, pairs, every = np.random.default_rng(5), [], cr._all_pairs
    monkeypatch.setattr(cr, "_all_pairs", lambda at, edges, a, b, points, *rest: pairs.append(len(edges) * len(points)) or every(at, edges, a, b, points, *rest))

    def closed(y, x):
        return y, x, np.roll(y, -1), np.roll(x, -1)

    def ragged(n):
        k, out = np.arange(n), r.uniform(0.2, 1.5, n)
        return closed(0.3 + out * np.sin(2 * np.pi * k / n), 0.4 + out * np.cos(2 * np.pi * k / n))

    edges, spots = ragged(3000), r.uniform(0, 1, (2, 2000))
    assert (cr.odd_crossings(*edges, *spots, 1.0, 0.0) == plain(*edges, *spots, 1.0, 0.0)).all()
    assert sum(pairs) < 3000 * 2000 / 20
    # edges that cross, equal, flat and upright ones, points on corners and edges, however small the cell
    monkeypatch.setattr(cr, "PAIRS", 64)
    near = lambda e, n: (e[0][:n] * 0.5 + e[2][:n] * 0.5, e[1][:n] * 0.5 + e[3][:n] * 0.5)
    star = ragged(300)
    for e, (lat, lon) in ((star, near(star, 200)), (star, (star[0], star[1])), (closed(*r.uniform(-1, 2, (2, 200))), r.uniform(0, 1, (2, 300))), (closed(*np.round(r.uniform(-1, 2, (2, 200)) * 4) / 4), np.round(r.uniform(0, 1, (2, 300)) * 8) / 8)):
        in_cell = (lat >= 0) & (lat < 1) & (lon >= 0) & (lon < 1)
        spots = lat[in_cell], lon[in_cell]
        assert (cr.odd_crossings(*e, *spots, 1.0, 0.0) == plain(*e, *spots, 1.0, 0.0)).all()


def test_zones_are_met_by_cells_without_testing_all_pairs(spark):
    import math

    ring = [(5.013 + (3 + k % 7 / 7) * math.sin(2 * math.pi * k / 500), 5.017 + (3 + k % 7 / 7) * math.cos(2 * math.pi * k / 500)) for k in range(500)]
    z = spark.createDataFrame([("A/a", ring), ("B/b", [(5.0, 5.0), (5.0, 9.5), (9.5, 9.5), (9.5, 5.0)])], "tz string, ring array<struct<lat:double,lon:double>>")
    p = spark.createDataFrame([(k, k * 7 % 400 / 40, k * 13 % 399 / 39.9) for k in range(1500)] + [(-1, float("nan"), 1.0), (-2, 5.0, float("nan")), (-3, None, 5.0)], "code long, lat double, lon double")
    plan = rg.zone_from_polygon(p, z)._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(edges" not in plan and plan.count("strategy=merge") == 2  # neither edges nor points pass through the driver
    whole, dealt = ({r["code"]: r["tz"] for r in rg.zone_from_polygon(p, z, **few).collect()} for few in ({}, {"most_points": 3}))
    held = p.where("not isnan(lat) and not isnan(lon)").join(z).where(rg.point_in_zone("lat", "lon", "ring")).groupBy("code").agg(F.min("tz").alias("tz"))
    want = {r["code"]: r["tz"] for r in p.select("code").join(held, "code", "left").collect()}
    assert whole == dealt == want and len(set(want.values())) == 3


def test_corners_of_a_ring_on_a_corner_of_the_grid(spark):
    import math

    ring = [(5 + (3 + k % 7 / 7) * math.sin(2 * math.pi * k / 500), 5 + (3 + k % 7 / 7) * math.cos(2 * math.pi * k / 500)) for k in range(500)]
    z = spark.createDataFrame([("A/a", ring)], "tz string, ring array<struct<lat:double,lon:double>>")
    p = spark.createDataFrame([(k, k * 7 % 400 / 40, k * 13 % 399 / 39.9) for k in range(1500)], "code long, lat double, lon double")
    want = {r["code"] for r in p.join(z).where(rg.point_in_zone("lat", "lon", "ring")).collect()}
    assert {r["code"] for r in rg.zone_from_polygon(p, z).where("tz is not null").collect()} == want and 145 in want

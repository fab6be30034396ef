"""Geometry, registries, claims, estimates, the live sky and search on hand-made rows."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from aerolith import schemas
from aerolith.functions import geo
from aerolith.functions import text as tx
from aerolith.functions import timeutil as tu
from aerolith.functions.register import register_functions
from aerolith.operators import claims as cl
from aerolith.operators import estimate as es
from aerolith.operators import records as rc
from aerolith.operators import registry as rg
from aerolith.operators import search as se
from aerolith.operators import search2 as s2
from aerolith.operators import windows as wi
from aerolith.sources import readers as rd
from aerolith.sources import sinks, tracks
from aerolith.streaming import live


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_scalars(spark):
    km = 2 * 6371.0088 * math.asin(math.sqrt(math.sin(math.radians(1) / 2) ** 2))
    assert one(spark, geo.haversine(0.0, 0.0, 1.0, 0.0))[0] == pytest.approx(km)
    assert one(spark, geo.haversine(F.lit(None).cast("double"), 0.0, 1.0, 0.0))[0] is None
    assert one(spark, geo.bearing(0.0, 0.0, 0.0, 1.0))[0] == pytest.approx(90)
    assert one(spark, tu.circ_diff(1430, 10), tu.hhmm(F.lit(605)), tu.hhmm(F.lit(None).cast("int"))) == (20, "10:05", None)
    assert one(spark, geo.in_bbox(0.0, 179.0, 170.0, -10.0, -170.0, 10.0), geo.in_bbox(0.0, 0.0, 170.0, -10.0, -170.0, 10.0)) == (True, False)
    assert one(spark, tx.airport_role(F.lit("small"), F.lit("no"), F.lit("Foo Air Base")), tx.airport_role(F.lit("closed"), F.lit("yes"), F.lit("x"))) == ("military", "closed")
    assert one(spark, tx.fold(F.lit("Zürich Łódź")), tx.digits(F.lit("AA0163")), tx.compact_flight(F.lit("SQ 322"))) == ("ZURICH LODZ", "163", "SQ322")
    assert one(spark, tx.mirror_numbers(F.lit("SIA12")))[0] == ["SIA11", "SIA13"]
    assert one(spark, tx.track_point(F.lit("5630/40")))[0].asDict() == {"lat": 56.5, "lon": -40.0}
    assert tx.address_block("2001:db8::1") == "2001:db8::" and tx.address_block("nonsense") is None


def test_address_keys(spark):
    rows = ["10.0.0.1", " 10.0.0.1 ", "::ffff:10.0.0.1", "2001:db8::1", "2001:db8::2", "2001:db8:0:1::1", "no", "", None]
    got = [r["k"] for r in spark.createDataFrame([(k, a) for k, a in enumerate(rows)], "i int, a string").repartition(3).select("i", tx.address_key("a", "s").alias("k")).orderBy("i").collect()]
    assert got[0] == got[1] == got[2] and got[3] == got[4] and len({got[0], got[3], got[5]}) == 3 and got[6:] == [None] * 3


def test_sql_functions(spark):
    register_functions(spark)
    assert spark.sql("SELECT obs_circ_diff(1430, 10) a, obs_hhmm(605) b, obs_fold('é') c").first() == (20, "10:05", "E")


def test_registry_precedence(spark):
    cols = "hex string, registration string, type_code string, operator_name string, operator_norm string, operator_icao string, year int, flags string, source string"
    old = spark.createDataFrame([("a", "R1", None, None, None, "OLD", 1999, None, "registry")], cols)
    new = spark.createDataFrame([("a", "R2", "A320", None, None, "NEW", None, None), ("b", "R3", None, None, None, None, None, None)], cols.rsplit(",", 1)[0])
    got = {r["hex"]: r for r in rg.merge_airframes(old, new, "receiver-dump").collect()}
    assert (got["a"]["registration"], got["a"]["type_code"], got["a"]["operator_icao"], got["a"]["source"]) == ("R1", "A320", "NEW", "registry")
    assert got["b"]["source"] == "receiver-dump"


def test_nested_blocks(spark):
    b = spark.createDataFrame([(0, 99, "GB"), (10, 19, "BM")], "lo long, hi long, state string")
    h = spark.createDataFrame([("00000a",), ("000001",), ("0000ff",)], "hex string")
    assert {r["hex"]: r["state"] for r in rg.state_of_hex(h, b).collect()} == {"00000a": "BM", "000001": "GB", "0000ff": None}
    assert {r["hex"]: r["state"] for r in rg.state_of_hex(h, b, most_blocks=0).collect()} == {"00000a": "BM", "000001": "GB", "0000ff": None}


def test_ids_survive(spark):
    known = spark.createDataFrame([("b", 7)], "hex string, airframe_id long")
    got = {r["hex"]: r["airframe_id"] for r in rg.assign_airframes(spark.createDataFrame([("c",), ("a",), ("b",)], "hex string"), known).collect()}
    assert got == {"b": 7, "a": 8, "c": 9}


def test_history_events(spark, tmp_path):
    doc = '{"evidence_from": "2025-01-01", "airframes": {"ABCDEF": {"first": "2025-06-01", "last": "2026-05-01", "n": 9, "type": "A320", "regs": [["R1", "2025-06-01", "2025-12-01", 3], ["R2", "2026-01-01", "2026-05-01", 6]], "ops": [["AAA", "2025-06-01", "2026-05-01", 9]], "gaps": [["2026-03-01", "2026-03-11"]]}}}'
    (tmp_path / "h.json").write_text(doc)
    h = rd.read_airframe_history(spark, str(tmp_path / "h.json"))
    ids = spark.createDataFrame([("abcdef", 1)], "hex string, airframe_id long")
    got = {(r["kind"], str(r["at"].date())) for r in rg.history_events(h, ids).collect()}
    assert got == {("first_observed", "2025-06-01"), ("registration_change", "2026-01-01"), ("not_observed", "2026-03-02")}


def test_imports_done_twice_change_nothing(spark):
    day = lambda n: dt.date(2026, 1, 1) + dt.timedelta(days=n)
    legs = [("a", "R1", "AAA1", day(0)), ("a", "R2", "AAA1", day(50)), ("a", "R2", "BBB1", day(51)), ("b", None, "AAA2", day(40)), ("b", "R9", None, day(41)), (None, "R9", "AAA1", day(1))]
    h = rg.observed_history(spark.createDataFrame(legs, "hex string, reg string, callsign string, date date")).cache()
    known = spark.createDataFrame([], "hex string, airframe_id long")
    spells = spark.createDataFrame([("x", "hex", "kept", None, None, None, "other")], "airframe_id string, kind string, value string, first_date date, last_date date, n_obs long, source string").withColumn("airframe_id", F.lit(99).cast("long"))
    events = spark.createDataFrame([], "airframe_id long, kind string, at timestamp, detail map<string,string>, source string, visibility string")
    seen = []
    for _ in range(3):
        known, spells, events = (d.cache() for d in rg.import_history(h, known, spells, events))
        seen.append([sorted(map(str, d.collect())) for d in (known, spells, events)])
    assert seen[0] == seen[1] == seen[2]
    assert sorted((r["airframe_id"], r["kind"], str(r["at"].date())) for r in events.collect()) == [(1, "not_observed", "2026-01-02"), (1, "operator_change", "2026-02-21"), (1, "registration_change", "2026-02-20"), (2, "first_observed", "2026-02-10")]
    rows = spark.createDataFrame([("a", "N1", "Maker", "M1", "77", 1999, "E", "Firm", day(3), None)], "hex string, registration string, manufacturer string, model string, msn string, built_year int, engine string, owner string, cert_date date, airworthy_date date")
    ref = spark.createDataFrame([], schemas.AIRFRAMES_REF)
    frames = spark.createDataFrame([(1, None, None, None), (2, 2001, "Known", None)], "airframe_id long, built_year int, manufacturer string, msn string")
    claims = spark.createDataFrame([], "airframe_id long, field string, source string, value string, first_seen date, last_seen date")
    tables = {"airframes_ref": ref, "claims": claims, "airframes": frames, "events": events.drop("detail")}
    seen = []
    for n in (1, 2, 3):
        done = rg.import_us_registry(rows, tables["airframes_ref"], tables["airframes"], tables["claims"], tables["events"], known, F.lit(str(day(n))).cast("date"))
        tables = {k: v.cache() for k, v in done.items()}
        seen.append([sorted(map(str, tables[k].drop("updated_at", "last_seen").collect())) for k in ("airframes_ref", "claims", "airframes", "events")])
    assert seen[0] == seen[1] == seen[2]
    claim = tables["claims"].where("field = 'msn'").first()
    assert (claim["first_seen"], claim["last_seen"]) == (day(1), day(3))
    airlines, members = spark.createDataFrame([("AAA", None, "Own", ["#1"])], schemas.AIRLINES), spark.createDataFrame([("AAA", "AA", "Listed"), ("BBB", "BB", "New")], "airline_icao string, iata string, name string")
    once = rg.import_alliances(airlines, members)
    assert sorted(map(str, once.collect())) == sorted(map(str, rg.import_alliances(once, members).collect())) and once.where("name = 'Own'").first()["iata"] == "AA"


def test_zone_by_polygon(spark):
    ring = [(0.0, 0.0), (0.0, 10.0), (10.0, 10.0), (10.0, 0.0)]
    z = spark.createDataFrame([("Europe/X", ring), ("Etc/GMT", [(20.0, 20.0), (20.0, 30.0), (30.0, 30.0), (30.0, 20.0)])], "tz string, ring array<struct<lat:double,lon:double>>")
    a = spark.createDataFrame([("IN", 5.0, 5.0), ("OUT", 15.0, 5.0), ("SEA", 25.0, 25.0)], "code string, lat double, lon double")
    assert {r["code"]: r["tz"] for r in rg.zone_from_polygon(a, z).collect()} == {"IN": "Europe/X", "OUT": None, "SEA": None}


def test_zones_of_ten_thousand_edges_by_cells_equal_the_whole_ring(spark):
    rng = random.Random(8)

    def ring(lat, lon, n, size):
        return [(lat + size * (1 + 0.4 * rng.random()) * math.sin(2 * math.pi * k / n), lon + size * (1 + 0.4 * rng.random()) * math.cos(2 * math.pi * k / n)) for k in range(n)]

    # a ragged one, one that winds along grid lines, a comb, a sliver, one with a repeated point, one that is none
    square = [(10.0, 10.0), (10.0, 14.0), (12.0, 14.0), (12.0, 12.0), (14.0, 12.0), (14.0, 10.0)]
    comb = [(30.0, 0.0)] + [p for k in range(40) for p in ((40.0, k * 0.5), (31.0, k * 0.5 + 0.25))] + [(30.0, 20.0)]
    zones = [("A/a", ring(-20, -20, 10_000, 9)), ("B/b", square), ("C/c", comb), ("D/d", [(50.0, 0.0), (50.2, 60.0), (50.3, 60.0)]), ("E/e", [(60.0, 0.0), (60.0, 0.0), (65.0, 5.0), (60.0, 9.0)]), ("F/f", [(1.0, 1.0), (2.0, 2.0)])]
    z = spark.createDataFrame(zones, "tz string, ring array<struct<lat:double,lon:double>>")
    spots = [(rng.uniform(-36, 70), rng.uniform(-36, 66)) for _ in range(3000)] + [(a, b) for a in (10.0, 11.0, 12.0, 13.0, 14.0) for b in (9.5, 10.0, 11.0, 12.0, 13.5, 14.0, 14.5)] + [(50.0 + rng.random() * 0.4, rng.uniform(0, 61)) for _ in range(200)]
    a = spark.createDataFrame([(f"{k:05d}", *p) for k, p in enumerate(spots)] + [("null", None, 1.0)], "code string, lat double, lon double")
    got = {r["code"]: r["tz"] for r in rg.zone_from_polygon(a, z).collect()}

    def holds(y, x, of):
        return sum((p[0] > y) != (q[0] > y) and x < (q[1] - p[1]) * (y - p[0]) / (q[0] - p[0]) + p[1] for p, q in zip(of, [*of[1:], of[0]], strict=True)) % 2 == 1

    want = {f"{k:05d}": min((tz for tz, of in zones if len(of) > 2 and holds(*p, of)), default=None) for k, p in enumerate(spots)} | {"null": None}
    assert got == want and len({*want.values()}) == 6
    assert rg.zone_cells(z).agg(F.max(F.size("edges"))).first()[0] < 2000  # no row holds a whole ring


def test_verdicts(spark):
    names = ("asked", "known_end", "not_same", "airport", "type", "corridor", "rotation", "mirror", "observation", "unique", "log", "timetable", "clock")
    base = dict.fromkeys(names, "skip") | {"asked": "pass", "known_end": "pass", "not_same": "pass", "airport": "pass"}
    cases = [({"log": "pass", "corridor": "pass"}, 0, "corroborated"), ({"log": "pass"}, 0, "unverified"), ({"log": "pass"}, 2, "corroborated"), ({"rotation": "fail", "log": "pass", "corridor": "pass"}, 0, "corroborated"), ({"rotation": "fail", "corridor": "pass", "mirror": "pass"}, 0, "unverified"), ({"type": "fail", "log": "pass", "clock": "pass"}, 5, "contradicted")]
    rows = [tuple({**base, **c}[n] for n in names) + (k,) for c, k, _ in cases]
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names) + ", keyed int")
    assert [r[0] for r in df.select(cl.verdict()).collect()] == [v for _, _, v in cases]


def test_filing_caps_open_answers(spark):
    now = F.lit("2026-01-01").cast("timestamp")
    claims = spark.createDataFrame([(1, "SIA1", "SIN", "AAA", "pending", None, 0, None, None, None, None, None)], schemas.CLAIMS)
    e = spark.createDataFrame([], schemas.ENDORSEMENTS)
    subs = spark.createDataFrame([(i, "SIA1", "SIN", d, h, None, None, None) for i, d, h in ((10, "AAA", "ann"), (11, "BBB", None), (12, "CCC", None), (13, "DDD", None))], "id long, callsign string, origin string, dest string, handle string, note string, key_name string, valid_from string")
    c, e = cl.file_claims(claims, e, subs, now)
    rows = {r["dest"]: r for r in c.collect()}
    assert set(rows) == {"AAA", "BBB", "CCC"} and all(r["verdict"] == "contested" for r in rows.values())
    assert rows["BBB"]["anonymous_count"] == 1 and [r["claim_id"] for r in e.collect()] == [1]


def test_filing_the_timetables_answers_again_and_again(spark):
    now = F.lit("2026-01-01").cast("timestamp")
    claims, e = spark.createDataFrame([], schemas.CLAIMS), spark.createDataFrame([], schemas.ENDORSEMENTS)
    row = "id long, callsign string, origin string, dest string, handle string, note string, key_name string, valid_from string"
    big = 2**63 - 1  # as a hash may be
    for k in range(3):
        subs = spark.createDataFrame([(big - 10 * k - i, f"SIA{i}", "SIN", f"D{k}", None, "timetable", "timetable", None) for i in range(3)], row)
        claims, e = cl.file_claims(claims, e, subs, now)
    assert sorted(r["id"] for r in claims.collect()) == list(range(1, 10))
    assert sorted(r["claim_id"] for r in e.collect()) == list(range(1, 10))


def test_approval_supersedes(spark):
    now = F.lit("2026-01-05").cast("timestamp")
    cat = spark.createDataFrame([("SIA1", "SIN", "OLD", None, dt.date(2025, 1, 1), None, None, "community", 1, None)], schemas.CATALOG)
    app = spark.createDataFrame([(2, "SIA1", "SIN", "NEW")], "id long, callsign string, origin string, dest string")
    gaps = spark.createDataFrame([("SIA1", "dest", None)], "callsign string, side string, chain array<string>")
    e = spark.createDataFrame([(2, "a", None, "timetable", dt.date(2026, 1, 3), None, None)], schemas.ENDORSEMENTS)
    got = {r["dest"]: r for r in cl.approve_claims(cat, app, gaps, e, now).collect()}
    assert (got["OLD"]["valid_to"], got["OLD"]["closed_reason"]) == (dt.date(2026, 1, 3), "superseded")
    assert (got["NEW"]["valid_from"], got["NEW"]["source"], got["NEW"]["valid_to"]) == (dt.date(2026, 1, 3), "published", None)


def test_converge_is_the_plain_loop():
    lat, lon, head, gs, dt_s, dla, dlo = 10.0, 10.0, 45.0, 480.0, 4000.0, 40.0, 60.0
    speed, t = gs * geo.KT_TO_KMS, 0.0
    a, b, h = lat, lon, head
    while t < dt_s:
        step = min(30.0, dt_s - t)
        if t >= 600:
            turn = (es._rad_bearing(a, b, dla, dlo) - h + 180) % 360 - 180
            h = (h + max(-1.0, min(1.0, turn))) % 360
        a, b = es._rad_forward(a, b, h, speed * step)
        t += step
    got = es.converge([lat] * 2, [lon] * 2, [head] * 2, [gs] * 2, [dt_s, None], [dla] * 2, [dlo] * 2)
    assert got.iloc[0]["lat"] == pytest.approx(a) and got.iloc[0]["lon"] == pytest.approx(b) and got.iloc[1].isna().all()


def test_airway_is_followed(spark):
    air = spark.createDataFrame([("R1", [("A", 50.0, -170.0), ("B", 50.0, -160.0), ("C", 50.0, -150.0)])], "airway string, points array<struct<name:string,lat:double,lon:double>>")
    p = spark.createDataFrame([("x", 1.0, 50.2, -165.0, 90.0, 50.0, -140.0), ("y", 1.0, 20.0, -165.0, 90.0, 50.0, -140.0)], "hex string, t double, lat double, lon double, track double, dest_lat double, dest_lon double")
    got = {r["hex"]: r["waypoints"] for r in es.match_airway(p, air, ["hex", "t"]).collect()}
    assert [w["lon"] for w in got["x"]] == [-160.0, -150.0] and got["y"] is None


def test_track_messages(spark):
    text = "TMI IS 265\nA MALOT 54/20 55/30 JANJO\nEAST LVLS NIL\nWEST LVLS 340 350\n"
    m = spark.createDataFrame([("EGGX", 1, 2, 1, text)], "issuer string, start_datetime int, end_datetime int, part_no int, condition_message string")
    r = tracks.parse_track_messages(m).first()
    assert (r["tmi"], r["letter"], r["entry"], r["exit"], r["direction"], r["west_levels"], len(r["points"])) == (265, "A", "MALOT", "JANJO", "W", [340, 350], 2)


def test_flight_bounds(spark):
    rows = [("h", 0.0, 1.0, 1.0, None, True), ("h", 120.0, 1.1, 1.0, 1200, False), ("h", 900.0, 2.0, 1.0, 30000, False), ("h", 1800.0, 2.5, 1.0, 900, False), ("h", 1900.0, 2.6, 1.0, None, True), ("h", 2000.0, 2.6, 1.0, None, True)]
    r = wi.flight_bounds(spark.createDataFrame(rows, "hex string, t double, lat double, lon double, alt_ft int, on_ground boolean")).first()
    assert (r["dep_t"], r["arr_t"]) == (120.0, 1900.0)


def test_schedule_chain_and_order(spark):
    s = spark.createDataFrame([("A1", "X", "Y", 5), ("A1", "Y", "Z", 5), ("B1", "X", "Y", 9), ("B1", "X", "Z", 1)], "callsign string, org string, dst string, n_flights long")
    assert {r["callsign"]: r["chain"] for r in rc.schedule_chain(s).collect()} == {"A1": ["X", "Y", "Z"], "B1": ["X", "Y"]}
    o = rc.flying_order(s.where("callsign = 'A1'").withColumns({"dep_min": F.lit(None).cast("int"), "n": F.col("n_flights")})).first()
    assert o["route"] == ["X", "Y", "Z"] and sorted(o["pairs"]) == ["X>Y", "X>Z", "Y>Z"]


def osa(a, b):
    """Edit distance with swaps of neighbours, by its recursion."""
    if not a or not b:
        return max(len(a), len(b))
    best = min(osa(a[:-1], b) + 1, osa(a, b[:-1]) + 1, osa(a[:-1], b[:-1]) + (a[-1] != b[-1]))
    return min(best, osa(a[:-2], b[:-2]) + 1) if len(a) > 1 and len(b) > 1 and a[-1] == b[-2] and a[-2] == b[-1] else best


def test_edit_distances_and_their_keys(spark):
    import random

    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(7)))
    pairs = [("chnagi", "changi"), ("heathro", "heathrow"), ("", "ab"), ("ca", "abc"), *[(word(), word()) for _ in range(400)]]
    want = [osa(a, b) for a, b in pairs]
    assert s2.edits(*map(list, zip(*pairs))).tolist() == want and want[:4] == [1, 1, 2, 3]
    d = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)] + [(-1, None, "x")], "i int, a string, b string")
    rows = d.select("i", s2.within_edits("a", "b").alias("d"), se.without_letters(F.col("a"), 2).alias("ka"), se.without_letters(F.col("b"), 2).alias("kb")).collect()
    for r in rows:
        assert r["d"] == (None if r["i"] < 0 else want[r["i"]])
        if r["i"] >= 0 and r["d"] <= 2:
            assert set(r["ka"]) & set(r["kb"])


def test_places(spark):
    cases = {"SIN LHR": ("SIN", "LHR"), "sin-lhr": ("SIN", "LHR"), "A B-C D": None, "NEW YORK-PARIS": ("NEW YORK", "PARIS"), "FROM NEW YORK TO LOS ANGELES": ("NEW YORK", "LOS ANGELES"), "FLIGHTS TO PARIS FROM ROME": ("ROME", "PARIS"), "9V-SMA": None, "PARIS TO": None, "TO PARIS": None, "A → B": ("A", "B"), "FROM A -> B": ("A", "B"), "ONE TWO THREE": None, "ONE": None, "": None, "FLIGHTS A B": ("A", "B"), "A TO B TO C": None, "A-B": None, "N123-AB": None, "ABC-DEF-GHI": None, "FROM TO": None, None: None}
    d = spark.createDataFrame([(k,) for k in cases], "q string")
    assert {r["q"]: r["p"] and tuple(r["p"]) for r in d.select("q", tx.places("q").alias("p")).collect()} == cases


def positions(spark, rows):
    full = [(h, f, None, None, la, lo, alt, False, 400.0, 90.0, None, sq, 0.0, 0.0, None, None, dt.datetime.fromtimestamp(t, dt.timezone.utc)) for h, f, la, lo, alt, sq, t in rows]
    return spark.createDataFrame(full, schemas.POSITIONS)


EPISODES = [("aa", "X1", 1.0, 1.0, 30000, "7700", 1000), ("aa", "X1", 1.0, 1.1, 30000, "7700", 1010), ("aa", "X1", 1.0, 1.2, 30000, "7700", 1021), ("bb", "Y1", 1.0, 1.0, 30000, "7600", 1000), ("bb", "Y1", 1.0, 1.0, 30000, "7600", 1030), ("bb", "Y1", 1.0, 1.0, 30000, "7500", 2000), ("bb", "Y1", 1.0, 1.0, 30000, "7500", 2030)]


def test_emergency_episodes_batch_and_stream_agree(spark, tmp_path):
    p = positions(spark, EPISODES)
    batch = {(r["hex"], r["at"], r["visibility"]) for r in live.emergency_episodes_batch(p).collect()}
    assert batch == {("aa", 1000.0, "public"), ("bb", 1000.0, "public"), ("bb", 2000.0, "held")}
    p.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schemas.struct(schemas.POSITIONS)).parquet(str(tmp_path / "in"))
    q = live.emergency_episodes(stream).writeStream.format("memory").queryName("episodes").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r["hex"], r["at"], r["visibility"]) for r in spark.table("episodes").collect()} == batch


def test_sky_changes_ignore_ages(spark):
    a = positions(spark, [("aa", "X", 1.0, 1.0, 1, None, 1), ("bb", "Y", 1.0, 1.0, 1, None, 1)])
    b = positions(spark, [("aa", "X", 1.0, 1.0, 1, None, 9), ("cc", "Z", 1.0, 1.0, 1, None, 9)])
    assert {(r["hex"], r["change"]) for r in live.sky_changes(a, b).collect()} == {("bb", "removed"), ("cc", "added")}


def test_sessions_reconnect_and_close(spark):
    at = lambda s: dt.datetime.fromtimestamp(s, dt.timezone.utc)
    rows = [("s1", at(1000), 100.0, 5.0, 10), ("s1", at(1060), 160.0, 9.0, 20), ("s1", at(1120), 10.0, 1.0, 25), ("s2", at(1000), 5.0, 1.0, 1)]
    got = sorted(tuple(r) for r in live.station_sessions_batch(spark.createDataFrame(rows, "half_id string, at timestamp, conn_time_s double, msgs_per_s double, positions_total long")).collect())
    assert got == [("s1", 900.0, 1060.0, 1060.0, 9.0, 20), ("s1", 1110.0, 1120.0, None, 1.0, 25), ("s2", 995.0, 1000.0, 1000.0, 1.0, 1)]


def test_truncated_artifact_is_refused():
    sinks.check_not_truncated(900, 1000)
    with pytest.raises(sinks.TruncatedArtifact):
        sinks.check_not_truncated(700, 1000)


def test_readers(spark, tmp_path):
    (tmp_path / "r.txt").write_text("abc123;9V-SMA;A388;00;x;2010;Singapore Airlines;\nbad;line\n")
    r = rd.read_registry(spark, str(tmp_path / "r.txt")).collect()
    assert [(x["hex"], x["registration"], x["year"], x["operator_norm"]) for x in r] == [("abc123", "9V-SMA", 2010, "SINGAPORE AIRLINES")]
    (tmp_path / "routes.json").write_text('{" sia1 ": ["SIN", "LHR"], "BAD": "x", "ONE": ["A"]}')
    assert [(x["callsign"], x["chain"]) for x in rd.read_routes(spark, str(tmp_path / "routes.json")).collect()] == [("SIA1", ["SIN", "LHR"])]
    (tmp_path / "c.json").write_text('{"clients": [["11111111-2222-3333-4444-555555555555", "1.2.3.4 port 1", 1, 60, 5, 2, 0, 30, 99], ["11111111-2222-3333-0000-000000000000", "x", 1, 1, 1, 1, 0, 1, 1], ["short"]]}')
    assert [(x["conn_time_s"], x["positions_total"]) for x in rd.read_presence(spark, str(tmp_path / "c.json")).collect()] == [(60.0, 99)]


def test_occurrences_and_chains_run_over_whole_tables(spark, tmp_path):
    """No claim and no callsign is left out, whatever its number; against brute force."""
    from aerolith.plans import sky

    day = lambda k: dt.datetime(1998, 1, 1) + dt.timedelta(days=17 * k)
    words = ("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW", "4-NOT SPECIFIED")
    orders = [(k, k % 3 + 1, "P" if k % 2 else "F", words[k * 3 % 5], day(k % 20)) for k in range(1, 61)]
    orders += [(1000 + k, 7, "O", words[0], day(0)) for k in range(10)] + [(2000, 58, "O", words[0], day(0))]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string, o_orderdate timestamp_ntz").write.parquet(str(tmp_path / "orders.parquet"))
    lines = [(1000 + k, 1 if k < 8 else 2, 1) for k in range(10)] + [(2000, 2, 1)]
    spark.createDataFrame([(o, 1, s, n, day(0), 5.0) for o, s, n in lines], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_shipdate timestamp_ntz, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(1, 3), (2, 4)], "s_suppkey long, s_nationkey int").write.parquet(str(tmp_path / "supplier.parquet"))
    spark.createDataFrame([(7, 0), (58, 1)], "c_custkey long, c_nationkey int").write.parquet(str(tmp_path / "customer.parquet"))
    norm = lambda x: x.replace("-", "").replace(" ", "").upper()
    spells, want = {}, {}
    for _, c, status, word, d in orders:
        if status == "P":
            a, b = spells.get((c, norm(word)), (d, d))
            spells[c, norm(word)] = (min(a, d), max(b, d))
    slack = dt.timedelta(days=30)
    for k, _, _, _, d in orders:
        reg = norm(("1-UR GENT", "2-high", "3-MEDIUM", "5-LOW", "4-NOT SPECIFIED")[k % 5])
        for (c, r), (a, b) in spells.items():
            if r == reg and a - slack <= d <= b + slack:
                want[c, str(d)] = max(want.get((c, str(d)), 0), k)
    got = {(r["airframe_id"], r["at"]): r["number"] for r in sky.occurrence_attach(spark, str(tmp_path)).collect()}
    assert got == want and any(k % 50 for k in want.values())
    chains = {r["callsign"]: r["chain"] for r in sky.schedule_chain(spark, str(tmp_path)).collect()}
    assert chains == {"AAX8": ["A03", "A00"], "ABX9": ["A04", "A01"]}
    assert [tuple(r) for r in sky.schedule_chain_single(spark, str(tmp_path)).collect()] == [("ABX9", "A04", "A01")]


TRACK = "direction string, east_levels array<int>, west_levels array<int>, path array<struct<lat:double,lon:double>>, valid_from double, valid_to double"


def test_ocean_tracks_of_other_days_do_not_count(spark):
    """Two messages that do not overlap: each gap follows the track in force when it began, and a gap outside both none."""
    day = 86400.0
    path = lambda lat: [(lat, float(x)) for x in range(-60, 0, 10)]
    messages = spark.createDataFrame([("W", [], [340, 380], path(50.0), 10 * day, 10.5 * day), ("W", [], [340, 380], path(55.0), 11 * day, 11.5 * day)], TRACK)
    rows = []
    for k, (t, lat) in enumerate(((10.2 * day, 50.0), (11.2 * day, 50.0), (11.2 * day, 55.0), (12 * day, 50.0))):
        rows += [(f"h{k}", t - 600, lat, -12.0, 36000, False, 480.0, 270.0, "ABC1"), (f"h{k}", t, lat, -15.5, 36000, False, 480.0, 270.0, "ABC1"), (f"h{k}", t + 7200, lat, -40.0, 36000, False, 480.0, 270.0, "ABC1"), (f"h{k}", t + 7260, lat, -52.0, 36000, False, 480.0, 270.0, "ABC1")]
    points = spark.createDataFrame(rows, "hex string, t double, lat double, lon double, alt_ft int, on_ground boolean, gs double, track double, callsign string")
    routes = spark.createDataFrame([("ABC1", ["EUR", "AME"])], "callsign string, chain array<string>")
    fields = spark.createDataFrame([("EUR", "KEUR", 50.0, 5.0), ("AME", "KAME", 45.0, -74.0)], "iata string, ident string, lat double, lon double")
    got = {r["hex"]: r for r in es.backtest_ocean_tracks(points, routes, fields, messages).collect()}
    assert {k: r["matched"] for k, r in got.items()} == {"h0": True, "h1": False, "h2": True, "h3": False}
    assert got["h1"]["path_km"] == got["h1"]["now_km"] and got["h0"]["path_km"] != got["h0"]["now_km"]
    ways = {r["hex"]: r["waypoints"] for r in es.match_ocean_track(points.where("lon = -15.5"), messages, ["hex", "t"]).collect()}
    assert [w["lat"] for w in ways["h0"]] == [50.0] * 5 and [w["lat"] for w in ways["h2"]] == [55.0] * 5 and ways["h1"] is ways["h3"] is None


def test_tracks_in_force_by_timestamps(spark):
    at = lambda h: dt.datetime(2026, 1, 1 + h // 24, h % 24)
    m = spark.createDataFrame([("a", at(0), at(12)), ("b", at(10), at(60)), ("c", at(5), at(4))], "m string, valid_from timestamp, valid_to timestamp")
    p = spark.createDataFrame([(h, at(h)) for h in (0, 11, 12, 13, 60, 61)], "h int, ts timestamp")
    got = sorted((r["h"], r["m"]) for r in rg.tracks_active(m, p).collect())
    assert got == [(0, "a"), (11, "a"), (11, "b"), (12, "a"), (12, "b"), (13, "b"), (60, "b")]


def test_airways_against_a_plain_loop(spark):
    """Every point against every segment, with the date line and southern latitudes among them."""
    import random

    rng = random.Random(4)
    lines = [[(rng.uniform(-60, 60), lon) for lon in (160.0, 170.0, 179.0, -175.0, -165.0)] for _ in range(5)] + [[(20.0, -150.0), (25.0, -140.0), (30.0, -130.0)]]
    airways = spark.createDataFrame([(f"R{k}", [("x", *p) for p in line]) for k, line in enumerate(lines)], "airway string, points array<struct<name:string,lat:double,lon:double>>")
    rows = []
    for k in range(300):
        line = rng.choice(lines)
        i = rng.randrange(len(line) - 1)
        (a, b), (c, d), f = line[i], line[i + 1], rng.random()
        d = d + 360 if d < b - 180 else d
        lon = b + f * (d - b)
        east = math.degrees(math.atan2((d - b) * math.cos(math.radians(a)), c - a)) % 360
        rows.append((f"h{k}", 0.0, a + f * (c - a) + rng.uniform(-0.3, 0.3), (lon + 180) % 360 - 180, (east + rng.choice([0, 0, 180, 90])) % 360))
    p = spark.createDataFrame(rows, "hex string, t double, lat double, lon double, track double").withColumns({"dest_lat": F.lit(None).cast("double"), "dest_lon": F.lit(None).cast("double")})
    got = {r["hex"]: r["waypoints"] and [(w["lat"], w["lon"]) for w in r["waypoints"]] for r in es.match_airway(p, airways, ["hex", "t"]).collect()}
    segments = es.airway_segments(airways)
    far = p.crossJoin(segments.withColumnRenamed("ahead", "w")).withColumn("ca", geo.cross_along("a.lat", "a.lon", "b.lat", "b.lon", "lat", "lon"))
    fits = far.where((F.abs("ca.cross_km") <= 20) & (F.col("ca.along_km") >= 0) & (F.col("ca.along_km") < geo.haversine("a.lat", "a.lon", "b.lat", "b.lon")) & (F.abs(geo.angle_diff("track", geo.bearing("lat", "lon", "b.lat", "b.lon"))) <= 20))
    best = {r["hex"]: [(w["lat"], w["lon"]) for w in r["w"]] for r in fits.groupBy("hex").agg(F.min_by("w", F.struct(F.abs("ca.cross_km"), "airway")).alias("w")).collect()}
    assert {k: v for k, v in got.items() if v} == best and 50 < len(best) < 300


def played(spark, tmp_path, batches, schema, start):
    """Every row that a stream over files of one batch each gives, in order; start(stream) is the operator."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "made" / str(k)))
        (tmp_path / "in").mkdir(exist_ok=True)
        next((tmp_path / "made" / str(k)).glob("*.parquet")).rename(tmp_path / "in" / f"{k:03}.parquet")
    out = []
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    keep = lambda df, n: out.extend((n, r) for r in df.collect())
    q = start(stream).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    return [r for _, r in sorted(out, key=lambda x: x[0])]


def test_station_sessions_stream_and_batch_agree(spark, tmp_path):
    at = lambda s: dt.datetime.fromtimestamp(s, dt.timezone.utc)
    schema = "half_id string, at timestamp, conn_time_s double, msgs_per_s double, positions_total long"
    polls = []
    for k in range(12):
        t, rows = 1000 + 60 * k, [("steady", 60.0 * k + 5, float(k % 5), 10 * k)]
        if k != 5:
            rows.append(("again", (60.0 * k + 3) if k < 4 else 60.0 * (k - 4) + 1, float(k), k))
        if k < 3 or k > 8:
            rows.append(("away", 60.0 * k + 9 if k < 3 else 60.0 * (k - 9) + 2, 1.0, k))
        polls.append([(h, at(t), c, m, n) for h, c, m, n in rows])
    last = {}
    for r in played(spark, tmp_path, polls, schema, live.station_sessions):
        last[r["half_id"], r["started"]] = tuple(r)[2:]
    batch = live.station_sessions_batch(spark.createDataFrame([r for p in polls for r in p if not (r[0] == "again" and r[1] == at(1300))], schema)).collect()
    away = {(r["half_id"], r["started"]): tuple(r)[2:] for r in batch if r["half_id"] != "again"}
    assert {k: v for k, v in last.items() if k[0] != "again"} == away and len(away) == 3
    # a single poll missed closes a session in the table; the stream waits for a second one
    assert sorted(k for k in last if k[0] == "again") == [("again", 997.0), ("again", 1239.0)] and last["again", 997.0][1] == 1180.0


def test_trails_stream_and_batch_agree(spark, tmp_path):
    schema = "hex string, ts timestamp, lat double, lon double, alt_ft int"
    at = lambda s: dt.datetime.fromtimestamp(s, dt.timezone.utc)
    batches = [[("a", at(1000 + 100 * k + j), float(j // 2), float(k), 100 * k) for j in range(4)] + ([("b", at(1000 + 100 * k), 1.0, 1.0, None)] if k < 2 else []) for k in range(8)]
    last = {r["hex"]: [tuple(p) for p in r["points"]] for r in played(spark, tmp_path, batches, schema, lambda s: live.trace_points(s, keep_s=450, most=10))}
    rows = live.trace_points_batch(spark.createDataFrame([r for b in batches for r in b], schema), keep_s=450, most=10).collect()
    got = {}
    for r in rows:
        got.setdefault(r["hex"], []).append((r["t"], r["lat"], r["lon"], r["alt_ft"]))
    assert last["a"] == sorted(got["a"]) and len(last["a"]) == 10

"""Timetables, boards and flight-log statistics on hand-made rows."""

import datetime as dt

from pyspark.sql import functions as F

from aerolith import schemas
from aerolith.operators import aggregates as ag
from aerolith.operators import schedule as sc

DAY = dt.date(2026, 8, 1)


def seen(spark, rows):
    """(day offset, minute) sightings of one key."""
    out = [("K", DAY + dt.timedelta(days=d), m, DAY + dt.timedelta(days=100)) for d, m in rows]
    return spark.createDataFrame(out, "k string, day date, minute int, asof date")


def pick(spark, rows, method, asof=None):
    s = seen(spark, rows)
    last = max(d for d, _ in rows) if asof is None else asof
    s = s.withColumn("asof", F.lit(DAY + dt.timedelta(days=last)))
    got = sc.pick_slot(s, ["k"], method).collect()
    return got[0]["dep_min"] if got else None


def test_mode_takes_the_most_seen_slot_and_of_equals_the_earliest(spark):
    assert pick(spark, [(0, 570), (1, 571), (2, 587)], "mode") == 570
    assert pick(spark, [(0, 605), (1, 590)], "mode") == 590


def test_recent_follows_a_retimed_flight(spark):
    rows = [(d, 480) for d in range(40)] + [(d, 600) for d in range(40, 50)]
    assert pick(spark, rows, "mode") == 480
    assert pick(spark, rows, "recent") == 600


def test_kernel_prefers_a_cluster(spark):
    rows = [(0, 486), (1, 488), (2, 491), (3, 493), (4, 840), (5, 841), (6, 843)]
    assert pick(spark, rows, "mode") == 840
    assert pick(spark, rows, "kernel") == 490


def test_kernel_wraps_at_midnight(spark):
    assert pick(spark, [(0, 1438), (1, 2), (2, 1439), (3, 700)], "kernel") in (0, 1435)


def test_weekday_slot_apart(spark):
    friday = [d for d in range(42) if (DAY + dt.timedelta(days=d)).weekday() == 4]
    rows = [(d, 1080 if d in friday else 420) for d in range(42)]
    s = seen(spark, rows).withColumn("asof", F.lit(DAY + dt.timedelta(days=41)))
    pooled = sc.pick_slot(s, ["k"], "recent+kernel")
    own = sc.weekday_slots(s, ["k"], pooled).collect()
    assert [(r["weekday"], r["own_min"]) for r in own] == [(4, 1080)]


def leg(day, org, dst, dep, dur, hex_="aaaaaa", type_="A388", callsign="SIA1"):
    ts = int(dt.datetime.combine(day, dt.time(), dt.timezone.utc).timestamp()) + dep * 60
    return (hex_, None, type_, callsign, day, org, dst, ts, ts + dur, None)


def test_leg_stats_drop_touch_and_go(spark):
    rows = [leg(DAY + dt.timedelta(days=i), "SIN", "SYD", 600, 7 * 3600, type_="A388" if i % 2 == 0 else "A359") for i in range(7)]
    rows += [leg(DAY, "SIN", "KUL", 700, 3600), leg(DAY, "SIN", "KUL", 900, 100)]
    legs = spark.createDataFrame(rows, schemas.LEGS)
    ref = spark.createDataFrame([("aaaaaa", "SIA")], "hex string, operator_icao string")
    got = {(r["o"], r["d"]): r for r in ag.leg_stats_full(legs, ref).collect()}
    assert set(got) == {("SIN", "SYD"), ("KUL", "SIN")}
    r = got["SIN", "SYD"]
    assert (r["n_flights"], r["n_days"], float(r["per_week"]), r["avg_min"]) == (7, 7, 7.0, 420)
    assert [(t["type"], t["n"]) for t in r["types"]] == [("A388", 4), ("A359", 3)]


AIRPORTS = [("WSSS", "SIN", "Changi", "large_airport", "commercial", 1.36, 103.99, "SG", "Singapore", "Asia/Singapore"), ("YSSY", "SYD", "Sydney", "large_airport", "commercial", -33.95, 151.18, "AU", "Sydney", "Australia/Sydney")]


def test_schedule_in_local_time_with_paired_arrival(spark):
    # 01:30 UTC is 09:30 in Singapore
    rows = [leg(DAY + dt.timedelta(days=i), "SIN", "SYD", 90 + (i == 1), 8 * 3600, type_="A359" if i else "A388") for i in range(3)]
    got = sc.infer_schedule(spark.createDataFrame(rows, schemas.LEGS), spark.createDataFrame(AIRPORTS, schemas.AIRPORTS)).collect()
    assert [(r["dep_min"], r["type_code"], r["n_flights"], r["airline_icao"]) for r in got] == [(570, "A359", 3, "SIA")]
    assert got[0]["arr_min"] == (90 + 480 + 600) % 1440  # Sydney is ten hours ahead in August


def schedule(spark, rows):
    full = [(*r[:6], None, None, *r[6:]) for r in rows]
    return spark.createDataFrame(full, schemas.SCHEDULE)


def test_boards_pin_to_their_own_airline_and_undo_wrong_pins(spark):
    s = schedule(spark, [("EIN172", "DUB", "LHR", "EIN", 620, None, None, "observed", 9), ("BAW833", "DUB", "LHR", "BAW", 605, None, "EI172", "both", 9)])
    boards = spark.createDataFrame([("DUB", "dep", "EI172", "LHR", 610, DAY, "x", "t"), ("DUB", "dep", "EI999", "LHR", 1200, DAY, "x", "t"), ("LHR", "arr", "EI172", "DUB", 700, DAY, "x", "t")], schemas.BOARDS)
    airlines = spark.createDataFrame([("EIN", "EI", "Aer Lingus", []), ("BAW", "BA", "British Airways", [])], schemas.AIRLINES)
    got = {r["callsign"]: r for r in sc.merge_boards(s, boards, airlines).collect()}
    assert (got["EIN172"]["flight"], got["EIN172"]["source"], got["EIN172"]["dep_min"], got["EIN172"]["arr_min"]) == ("EI172", "both", 610, 700)
    assert (got["BAW833"]["flight"], got["BAW833"]["source"]) == (None, "observed")
    assert (got["EI999"]["source"], got["EI999"]["airline_icao"], got["EI999"]["dep_min"]) == ("published", "EIN", 1200)


def test_backtest_predicts_from_the_days_before_only(spark):
    rows = [leg(DAY + dt.timedelta(days=i), "SIN", "SYD", 90 if i < 20 else 210, 8 * 3600) for i in range(24)]
    r = sc.backtest_rows(spark.createDataFrame(rows, schemas.LEGS), spark.createDataFrame(AIRPORTS, schemas.AIRPORTS), days=4, window=60, methods=("mode",)).collect()
    assert len(r) == 4 and all(x["predicted"] == 570 for x in r) and all(x["err"] == 120 for x in r)


def test_queries_score_all_methods_and_keep_weekday_slots(spark, monkeypatch):
    """A flight that leaves at another hour on Fridays: (queries over the legs that the lens would give)."""
    from aerolith.plans import flights

    rows = [leg(DAY + dt.timedelta(days=i), "SIN", "SYD", 390 if (DAY + dt.timedelta(days=i)).weekday() == 4 else 90, 8 * 3600) for i in range(56)]
    rows.append(leg(DAY + dt.timedelta(days=55), "SIN", "SYD", 100, 8 * 3600, hex_="bbbbbb"))
    last = DAY + dt.timedelta(days=55)
    assert last.weekday() == 4
    tables = {"legs": spark.createDataFrame(rows, schemas.LEGS), "airports": spark.createDataFrame(AIRPORTS, schemas.AIRPORTS)}
    tables["shuttles"] = tables["legs"]  # the lens that the weekday queries read
    monkeypatch.setattr(flights, "lens", lambda spark, sf, name: tables[name])
    (full,) = flights.schedule_full(spark, "").collect()
    assert full["dep_min"] == 570 and [(w["key"], w["value"]["dep"]) for w in full["weekdays"]] == [(4, 870)]
    (q,) = flights.schedule_quality(spark, "").collect()
    assert (q["legs"], q["hits"], q["accuracy"]) == (2, 1, 50.0)
    got = {r["method"]: r for r in flights.schedule_backtest(spark, "").collect()}
    assert set(got) == set(sc.METHODS) and {r["support"] for r in got.values()} == {"5+"} and {r["n"] for r in got.values()} == {15}
    # days 42 to 55: twelve at 9:30, Fridays at 14:30 and one Friday leg at 9:40
    assert all((got[m]["within_15"], got[m]["within_45"], got[m]["median_err"]) == (13, 13, 0.0) for m in sc.METHODS if "weekday" not in m)
    assert all((got[m]["within_45"], got[m]["median_err"]) == (14, 0.0) for m in sc.METHODS if "weekday" in m)
    two = spark.createDataFrame([leg(DAY + dt.timedelta(days=i), "SIN", "SYD", m, 8 * 3600) for i, m in enumerate((90, 90, 90, 100, 120))], schemas.LEGS)
    r = sc.schedule_backtest(two, tables["airports"], days=2, methods=("mode",)).collect()
    assert [(x["support"], x["n"], x["median_err"]) for x in r] == [("2-4", 2, 20.0)]

"""The aggregate for SQL against the relational form."""

import datetime as dt
import random

from pyspark.sql import functions as F

from aerolith.functions.aggregates import register_aggregates
from aerolith.operators import schedule as sc


def test_pick_slot_in_groups_and_windows_equals_the_relational_form(spark):
    rng = random.Random(11)
    asof = dt.date(2026, 3, 1)
    rows = []
    for k in range(25):
        base = rng.randrange(1440)
        for _ in range(rng.randrange(1, 40)):
            rows.append((f"F{k}", asof - dt.timedelta(days=rng.randrange(0, 60)), rng.choice([None, *[(base + rng.randrange(-40, 40)) % 1440] * 9]), asof))
    rows += [("none", asof, None, asof), ("edge", asof, 1439, asof), ("edge", asof, 0, asof), ("tie", asof, 600, asof), ("tie", asof, 900, asof)]
    df = spark.createDataFrame(rows, "callsign string, day date, minute int, asof date")
    register_aggregates(spark)
    df.createOrReplaceTempView("sightings_seen")
    for name, method in (("", "recent+kernel"), ("_mode", "mode"), ("_recent", "recent"), ("_kernel", "kernel")):
        want = {r["callsign"]: r["dep_min"] for r in sc.pick_slot(df, ["callsign"], method).collect()}
        got = {r["callsign"]: r["m"] for r in spark.sql(f"SELECT callsign, obs_pick_slot{name}(day, minute, asof) AS m FROM sightings_seen GROUP BY callsign").collect()}
        assert got == {**{c: None for c in got}, **want} and got["none"] is None
    over = spark.sql("SELECT DISTINCT callsign, obs_pick_slot(day, minute, asof) OVER (PARTITION BY callsign) AS m FROM sightings_seen")
    assert {r["callsign"]: r["m"] for r in over.where("m is not null").collect()} == {r["callsign"]: r["dep_min"] for r in sc.pick_slot(df, ["callsign"]).collect()}
    so_far = spark.sql("SELECT callsign, day, obs_pick_slot_mode(day, minute, asof) OVER (PARTITION BY callsign ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS m FROM sightings_seen WHERE callsign = 'F1'")
    last = so_far.orderBy(F.desc("day")).first()["m"]
    assert last == {r["callsign"]: r["dep_min"] for r in sc.pick_slot(df.where("callsign = 'F1'"), ["callsign"], "mode").collect()}["F1"]

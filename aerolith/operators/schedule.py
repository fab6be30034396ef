"""Timetables read from sightings, their quality and backtest, and their merge with published boards.

The slot logic is relational: one aggregate to five-minute slots, slots joined to their neighbours within
`KERNEL_MIN` through a table of nine offsets, and a running weight for the median. Nothing is collected per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolith.functions import text as tx
from aerolith.functions import timeutil as tu
from aerolith.operators.cut import checkpointed
from aerolith.operators.filters import plausible_leg
from aerolith.operators.windows import top_k

# Fixed values of the timetable.
HALF_LIFE_DAYS, KERNEL_MIN, SLOT = 7.0, 15, 5
WEEKDAY_MIN_SEEN, WEEKDAY_APART_MIN = 3, 30
METHODS = ("mode", "recent", "kernel", "recent+kernel", "weekday", "recent+kernel+weekday")


def _weight(recent: bool, day: str, asof: Column) -> Column:
    if not recent:
        return F.lit(1.0)
    return F.pow(F.lit(0.5), F.greatest(F.lit(0), F.datediff(asof, F.col(day))) / HALF_LIFE_DAYS)


def pick_slot(seen: DataFrame, key: list[str], method: str = "recent+kernel", asof: str = "asof") -> DataFrame:
    """The scheduled minute of each key from sightings(key, day DATE, minute, asof DATE); sightings after `asof` are the caller's to leave out.

    mode: the slot with most weight, ties to the earliest. kernel: the slot with most weight within 15 minutes (then own
    weight, then the earliest), and the weighted median of the sightings around it, rounded to 5. recent: a sighting's
    weight halves every 7 days. Masses are rounded to 9 decimals before they are compared."""
    flags = set(method.split("+"))
    w = seen.where("minute is not null").select(*key, "minute", _weight("recent" in flags, "day", F.col(asof)).alias("w"))
    w = w.withColumn("slot", (F.floor(F.col("minute") / SLOT) * SLOT).cast("int"))
    slots = w.groupBy(*key, "slot").agg(F.bround(F.sum("w"), 9).alias("own"))
    if "kernel" not in flags:
        return top_k(slots, key, [F.desc("own"), F.col("slot")], 1, "_r").select(*key, F.col("slot").alias("dep_min"))
    shift = F.explode(F.array(*[F.lit(d) for d in range(-KERNEL_MIN, KERNEL_MIN + 1, SLOT)]))
    spread = slots.select(*key, F.col("slot").alias("_t"), "own", shift.alias("_d")).withColumn("slot", F.pmod(F.col("_t") + F.col("_d"), F.lit(1440)))
    mass = spread.groupBy(*key, "slot").agg(F.bround(F.sum("own"), 9).alias("mass"))
    best = top_k(slots.join(mass, [*key, "slot"]), key, [F.desc("mass"), F.desc("own"), F.col("slot")], 1, "_r").select(*key, F.col("slot").alias("best"))
    near = w.join(best, key).withColumn("offset", (F.pmod(F.col("minute") - F.col("best") + 720, F.lit(1440)) - 720).cast("int")).where(F.abs("offset") <= KERNEL_MIN)
    steps = near.groupBy(*key, "best", "offset").agg(F.sum("w").alias("w"))
    whole = Window.partitionBy(*key)
    run = F.sum("w").over(whole.orderBy("offset").rowsBetween(Window.unboundedPreceding, 0))
    steps = steps.withColumns({"_run": F.bround(run, 9), "_half": F.bround(F.sum("w").over(whole) / 2, 9)}).where("_run >= _half")
    at = steps.groupBy(*key, "best").agg(F.min("offset").alias("offset"))
    minute = F.pmod(F.col("best") + F.col("offset"), F.lit(1440))
    return at.select(*key, F.pmod((F.bround(minute / SLOT) * SLOT).cast("int"), F.lit(1440)).alias("dep_min"))


def weekday_slots(seen: DataFrame, key: list[str], pooled: DataFrame, method: str = "recent+kernel") -> DataFrame:
    """(key, weekday, own_min) of weekdays seen three times or more whose own slot is over 30 minutes from the pooled one."""
    s = seen.where("minute is not null").withColumn("weekday", F.weekday("day"))
    enough = s.groupBy(*key, "weekday").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= WEEKDAY_MIN_SEEN).drop("_n")
    base = "+".join(f for f in method.split("+") if f != "weekday") or "mode"
    own = pick_slot(s.join(enough, [*key, "weekday"]), [*key, "weekday"], base).withColumnRenamed("dep_min", "own_min")
    return own.join(pooled.select(*key, "dep_min"), key).where(tu.circ_diff("own_min", "dep_min") > WEEKDAY_APART_MIN).drop("dep_min")


def paired_arrival(seen: DataFrame, slots: DataFrame, key: list[str], slot: str = "dep_min") -> DataFrame:
    """The lower median of the five-minute arrivals of sightings that left within 15 minutes of the slot. seen(key, minute, arr_minute)."""
    s = seen.where("arr_minute is not null and minute is not null").join(slots.select(*key, F.col(slot).alias("_s")), key).where(tu.circ_diff("minute", "_s") <= KERNEL_MIN)
    s = s.withColumn("_a", (F.floor(F.col("arr_minute") / SLOT) * SLOT).cast("int"))
    whole = Window.partitionBy(*key)
    s = s.withColumns({"_n": F.row_number().over(whole.orderBy("_a")), "_c": F.count(F.lit(1)).over(whole)})
    return s.where("_n = floor((_c - 1) / 2) + 1").select(*key, F.col("_a").cast("int").alias("arr_min"))


def dominant_type(legs: DataFrame, key: list[str]) -> DataFrame:
    """The most-flown type, of equals the first in the alphabet."""
    n = legs.where("type is not null and type <> ''").groupBy(*key, "type").agg(F.count(F.lit(1)).alias("n"))
    return top_k(n, key, [F.desc("n"), F.col("type")], 1, "_r").select(*key, F.col("type").alias("type_code"))


def zones(airports: DataFrame) -> DataFrame:
    """(code, tz): idents first, IATA codes where no ident is the same."""
    known = airports.where("tz is not null")
    both = known.select(F.col("ident").alias("code"), F.lit(0).alias("r"), "tz", "ident").union(known.select("iata", F.lit(1), "tz", "ident")).where("code is not null")
    return both.groupBy("code").agg(F.min_by("tz", F.struct("r", "ident")).alias("tz"))


def sightings(legs: DataFrame, airports: DataFrame) -> DataFrame:
    """Plausible legs with callsigns in local time: callsign, org, dst, day (the origin's calendar), minute, arr_minute, type."""
    z = zones(airports)
    end = lambda c, out: z.select(F.col("code").alias(c), F.col("tz").alias(out))
    rows = legs.where(plausible_leg() & (F.coalesce("callsign", F.lit("")) != "")).join(end("org", "_oz"), "org", "left").join(end("dst", "_dz"), "dst", "left")
    local = F.col("dep_ts").isNotNull() & F.col("_oz").isNotNull()
    return rows.select(F.upper(F.trim("callsign")).alias("callsign"), "org", "dst", F.when(local, tu.local_day("dep_ts", "_oz")).otherwise(F.col("date")).alias("day"), F.when(local, tu.local_minute("dep_ts", "_oz")).alias("minute"), tu.local_minute("arr_ts", "_dz").alias("arr_minute"), "type", "date")


KEY = ["callsign", "org", "dst"]


def infer_schedule(legs: DataFrame, airports: DataFrame, window_days: int = 60, method: str = "recent+kernel") -> DataFrame:
    """The current timetable: per callsign and leg the local departure and arrival, weekday slots, type and flights.

    The sightings are dealt by key and written once; all that follows groups by that key where the rows lie."""
    asof = legs.agg(F.max("date").alias("asof"))
    rows = sightings(legs, airports).join(F.broadcast(asof)).where(F.col("date") >= F.date_sub("asof", window_days))
    rows = checkpointed(rows.repartition(*KEY))
    timed = rows.where("minute is not null")
    dep = checkpointed(pick_slot(timed, KEY, method))
    arr = paired_arrival(timed, dep, KEY)
    own = weekday_slots(timed, KEY, dep, method)
    day_arr = paired_arrival(timed.withColumn("weekday", F.weekday("day")), own, [*KEY, "weekday"], "own_min")
    days = own.join(day_arr, [*KEY, "weekday"], "left").groupBy(*KEY).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("weekday", F.struct(F.col("own_min").alias("dep"), F.col("arr_min").alias("arr")))))).alias("weekdays"))
    base = rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_flights"))
    out = base.join(dep, KEY, "left").join(arr, KEY, "left").join(days, KEY, "left").join(dominant_type(rows, KEY), KEY, "left")
    prefix = F.substring("callsign", 1, 3)
    return out.select(F.substring("callsign", 1, 12).alias("callsign"), "org", "dst", F.when(prefix.rlike(r"^\p{L}+$"), prefix).otherwise("").alias("airline_icao"), "dep_min", "arr_min", "weekdays", "type_code", F.lit(None).cast("string").alias("flight"), F.lit("observed").alias("source"), "n_flights")


def schedule_quality(schedule: DataFrame, legs: DataFrame, airports: DataFrame, day: Column | None = None, tolerance: int = 45) -> DataFrame:
    """Per source of time (published, inferred): legs of a day with a row for them, and departures within the tolerance."""
    one = legs.where("org is not null and dst is not null and dep_ts is not null and callsign is not null")
    newest = one.agg((F.max("date") if day is None else F.lit(day)).alias("_day"))
    one = one.join(F.broadcast(newest)).where("date = _day")
    z = zones(airports).select(F.col("code").alias("org"), "tz")
    j = one.join(schedule.where("dep_min is not null").select(*KEY, "dep_min", "weekdays", "source"), KEY).join(z, "org")
    off = tu.circ_diff(tu.local_minute("dep_ts", "tz"), tu.own_slot("weekdays", tu.local_day("dep_ts", "tz"), "dep_min"))
    bucket = F.when(F.col("source").isin("both", "published"), "published").otherwise("inferred")
    return j.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("legs"), F.count_if(off <= tolerance).alias("hits")).withColumn("accuracy", F.bround(100 * F.col("hits") / F.col("legs"), 1))


def backtest_rows(legs: DataFrame, airports: DataFrame, days: int = 14, window: int = 60, methods: tuple[str, ...] = METHODS) -> DataFrame:
    """(method, callsign, org, dst, day, minute, n_train, predicted, err) of each leg of the last days, predicted from the days before it only.

    What a day may learn from is dealt by key and written once for all methods."""
    s = checkpointed(sightings(legs, airports).where("minute is not null").select(*KEY, "day", "minute").repartition(*KEY))
    last = s.agg(F.max("day").alias("_last"))
    target = s.join(F.broadcast(last)).where(F.col("day") > F.date_sub("_last", days)).select(*KEY, F.col("day").alias("target_day"), F.col("minute").alias("flown"))
    # the prediction depends on the day, not on the leg: train once for each key and day
    asked = target.select(*KEY, "target_day").distinct()
    train = s.join(asked, KEY).where(F.col("day").between(F.date_sub("target_day", window), F.date_sub("target_day", 1))).withColumn("asof", F.date_sub("target_day", 1))
    train = checkpointed(train.repartition(*KEY))
    key = [*KEY, "target_day"]
    n = train.groupBy(*key).agg(F.count(F.lit(1)).alias("n_train"))
    out = None
    for m in methods:
        base = "+".join(f for f in m.split("+") if f != "weekday") or "mode"
        p = pick_slot(train, key, base).withColumnRenamed("dep_min", "predicted")
        if "weekday" in m:
            same = train.where(F.weekday("day") == F.weekday("target_day"))
            enough = same.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= WEEKDAY_MIN_SEEN).drop("_n")
            own = pick_slot(same.join(enough, key), key, base).withColumnRenamed("dep_min", "_own")
            p = p.join(own, key, "left").withColumn("predicted", F.when(tu.circ_diff("_own", "predicted") > WEEKDAY_APART_MIN, F.col("_own")).otherwise(F.col("predicted"))).drop("_own")
        rows = target.join(p, key).join(n, key).select(F.lit(m).alias("method"), *KEY, "target_day", "flown", "n_train", "predicted", tu.circ_diff("flown", "predicted").alias("err"))
        out = rows if out is None else out.unionByName(rows)
    return out


def schedule_backtest(legs: DataFrame, airports: DataFrame, **options) -> DataFrame:
    """Per method and support (1, 2-4, 5+ sightings): legs scored, hits within 15, 30 and 45 minutes and the median error (of two middle ones the mean)."""
    r = backtest_rows(legs, airports, **options)
    support = F.when(F.col("n_train") == 1, "1").when(F.col("n_train") <= 4, "2-4").otherwise("5+")
    return r.groupBy("method", support.alias("support")).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("err") <= t).alias(f"within_{t}") for t in (15, 30, 45)], F.median("err").alias("median_err"))


def board_modal_times(boards: DataFrame) -> DataFrame:
    """The most frequent time of each (flight, airport, kind, other end); of equals the earliest. Rows that name no end have a null `other`.

    Departures are keyed (airport, other), arrivals (other, airport); n_days counts the days of a departure."""
    b = boards.where("sched_min is not null").withColumns({"other": tx.board_stop("counterpart", "kind"), "blind": F.col("counterpart").isNull()}).where("blind or other is not null")
    key = ["flight", "airport", "kind", "other"]
    n = b.groupBy(*key, "sched_min").agg(F.count(F.lit(1)).alias("n"))
    days = b.groupBy(*key).agg(F.countDistinct("day").alias("n_days"))
    best = top_k(n, key, [F.desc("n"), F.col("sched_min")], 1, "_r").drop("_r", "n")
    out = best.join(days.withColumnRenamed("other", "_o"), (best["flight"] == days["flight"]) & (best["airport"] == days["airport"]) & (best["kind"] == days["kind"]) & best["other"].eqNullSafe(F.col("_o"))).select(best["*"], "n_days")
    dep = F.col("kind") == "dep"
    return out.withColumns({"org": F.when(dep, F.col("airport")).otherwise(F.col("other")), "dst": F.when(dep, F.col("other")).otherwise(F.col("airport"))})


def match_boards(schedule: DataFrame, boards: DataFrame, minute: str, near: int = 45, number: int = 180) -> DataFrame:
    """The service each board row decorates: same leg and carrier, nearest within `near` minutes; the same number within
    `number` minutes wins outright. boards(flight, org, dst, sched_min, prefix, icao). One row a board."""
    s = schedule.where(F.col(minute).isNotNull()).select("callsign", "org", "dst", "airline_icao", F.col(minute).alias("_m"))
    j = boards.join(s, ["org", "dst"])
    same = tx.same_number("callsign", "flight")
    gap = F.abs(F.col("_m") - F.col("sched_min"))
    d = F.when(same & (gap <= number), gap - 1000).otherwise(gap)
    j = j.where(tx.same_carrier("icao", "prefix", "airline_icao", same)).withColumn("_d", d).where(F.col("_d") <= near)
    return top_k(j, ["flight", "org", "dst"], [F.col("_d"), F.col("callsign")], 1, "_r").drop("_r", "_m", "_d", "airline_icao")


def _last_claim(matches: DataFrame) -> DataFrame:
    """Where several boards claim one service the last in the boards' order stays."""
    return top_k(matches, KEY, [F.desc("airport"), F.desc("flight"), F.desc("sched_min")], 1, "_r").drop("_r")


def _update(schedule: DataFrame, found: DataFrame, minute: str | None) -> DataFrame:
    """Services that a board has claimed take its number and, where `minute` names one, its time."""
    f = found.select(*KEY, F.substring("flight", 1, 8).alias("_f"), F.col("sched_min").alias("_m"))
    j = schedule.join(f, KEY, "left")
    hit = F.col("_f").isNotNull()
    new = {"flight": F.coalesce("_f", "flight"), "source": F.when(hit, F.lit("both")).otherwise(F.col("source"))}
    if minute:
        new[minute] = F.when(hit, F.col("_m")).otherwise(F.col(minute))
    if minute == "dep_min":
        new["weekdays"] = F.when(hit, tu.weekdays_apart("weekdays", "_m")).otherwise(F.col("weekdays"))
    return j.withColumns(new).drop("_f", "_m")


def merge_boards(schedule: DataFrame, boards: DataFrame, airlines: DataFrame, checkpoint=lambda df: df) -> DataFrame:
    """Merge published boards into the timetable, phase by phase; each phase sees what the one before changed.

    0. a number pinned to another carrier's service is taken off; 1. departures decorate a service or become a row;
    2. arrivals fill in, decorate or become a row; 3. boards that name no other end decorate by number alone.
    `checkpoint` cuts the lineage between phases."""
    modal = checkpoint(tx.airline_of(board_modal_times(boards), airlines))
    pinned = tx.airline_of(schedule, airlines)
    wrong = (F.col("source") == "both") & F.col("flight").isNotNull() & (F.col("icao") != "") & (F.coalesce("airline_icao", F.lit("")) != "") & ~tx.same_carrier("icao", "prefix", "airline_icao", F.lit(True))
    s = pinned.withColumns({"_w": F.coalesce(wrong, F.lit(False))}).withColumns({"flight": F.when(~F.col("_w"), F.col("flight")), "source": F.when(F.col("_w"), "observed").otherwise(F.col("source"))}).drop("_w", "prefix", "icao")
    carrier = F.when(F.col("icao") != "", F.col("icao")).when(F.col("prefix").rlike("^[A-Z]+$"), F.col("prefix")).otherwise("")
    none = lambda t: F.lit(None).cast(t)

    def added(rows: DataFrame, dep: Column, arr: Column, n: Column) -> DataFrame:
        return rows.select(F.substring("flight", 1, 12).alias("callsign"), "org", "dst", carrier.alias("airline_icao"), dep.cast("int").alias("dep_min"), arr.cast("int").alias("arr_min"), none(schedule.schema["weekdays"].dataType).alias("weekdays"), none("string").alias("type_code"), F.substring("flight", 1, 8).alias("flight"), F.lit("published").alias("source"), n.cast("long").alias("n_flights"))

    def put(base: DataFrame, rows: DataFrame) -> DataFrame:
        """A row replaces one of the same key."""
        rows = rows.dropDuplicates(KEY)
        return base.join(rows.select(*KEY), KEY, "left_anti").unionByName(rows)

    deps = modal.where("kind = 'dep' and other is not null")
    arrs = modal.where("kind = 'arr' and other is not null")
    found = match_boards(s, deps, "dep_min")
    rest = deps.join(found.select("flight", "org", "dst"), ["flight", "org", "dst"], "left_anti")
    times = arrs.groupBy("flight", "org", "dst").agg(F.min("sched_min").alias("_arr"))
    rest = rest.join(times, ["flight", "org", "dst"], "left")
    s = checkpoint(put(_update(s, _last_claim(found), "dep_min"), added(rest, F.col("sched_min"), F.col("_arr"), F.col("n_days"))))

    cut = arrs.withColumn("_f", F.substring("flight", 1, 8))
    named = top_k(s.where("flight is not null").select(*KEY, F.col("flight").alias("_f")), ["org", "dst", "_f"], [F.col("callsign")], 1, "_r").drop("_r")
    fill = cut.join(named, ["org", "dst", "_f"]).select(*KEY, F.col("sched_min").alias("_a")).dropDuplicates(KEY)
    left = cut.join(named.select("org", "dst", "_f"), ["org", "dst", "_f"], "left_anti").drop("_f")
    found = match_boards(s, left, "arr_min")
    rest = left.join(found.select("flight", "org", "dst"), ["flight", "org", "dst"], "left_anti").withColumn("callsign", F.substring("flight", 1, 12)).join(s.select(*KEY), KEY, "left_anti").drop("callsign")
    s = s.join(fill, KEY, "left").withColumn("arr_min", F.coalesce("_a", "arr_min")).drop("_a")
    s = checkpoint(put(_update(s, _last_claim(found), "arr_min"), added(rest, none("int"), F.col("sched_min"), F.lit(1))))

    for kind, end, minute in (("dep", "org", "dep_min"), ("arr", "dst", "arr_min")):
        blind = modal.where((F.col("kind") == kind) & F.col("other").isNull()).drop("org", "dst")
        known = s.where(F.col(minute).isNotNull()).select(*KEY, "airline_icao", F.col(minute).alias("_m"), tx.digits("callsign").alias("_no"))
        j = blind.withColumn("_no", tx.digits("flight")).where("_no <> ''").join(known.withColumn("airport", F.col(end)), ["airport", "_no"]).drop("_no")
        gap = F.abs(F.col("_m") - F.col("sched_min"))
        j = j.where(tx.same_number("callsign", "flight") & tx.same_carrier("icao", "prefix", "airline_icao", F.lit(True))).withColumn("_d", gap).where(F.col("_d") <= 180)
        best = top_k(j, ["flight", "airport"], [F.col("_d"), F.col("callsign"), F.col("org"), F.col("dst")], 1, "_r")
        s = checkpoint(_update(s, _last_claim(best), minute))
    return s

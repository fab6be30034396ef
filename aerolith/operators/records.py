"""Records of routes, airframes, flights, airports and the live fleet, for all keys of a table at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolith.functions import text as tx
from aerolith.functions import timeutil as tu
from aerolith.operators import aggregates as ag
from aerolith.operators.filters import public_only
from aerolith.operators.registry import airframe_of_hex, catalog_current, enrich_airframes
from aerolith.operators.windows import freshest_non_null, recent, top_k


def schedule_chain(schedule: DataFrame, dominant: float = 0.7) -> DataFrame:
    """(callsign, chain) of timetable legs: one leg; legs that link end to end; else the leg flown at least `dominant` of the time.

    The link is followed over the few legs of one callsign by an array fold."""
    legs = schedule.where("org <> dst").groupBy("callsign", "org", "dst").agg(F.sum(F.coalesce("n_flights", F.lit(0))).alias("n"))
    # all that is asked of a callsign is read off its own few legs: one aggregate without copies of the rows
    per = legs.groupBy("callsign").agg(F.array_sort(F.collect_list(F.struct("org", "dst", "n"))).alias("l"))
    per = per.withColumns({"n_org": F.size(F.array_distinct("l.org")), "n_dst": F.size(F.array_distinct("l.dst")), "total": F.aggregate("l", F.lit(0).cast(legs.schema["n"].dataType), lambda t, x: t + x["n"]), "top": F.array_max(F.transform("l", lambda x: F.struct(x["n"].alias("n"), x["org"].alias("org"), x["dst"].alias("dst"))))})
    n = F.size("l")
    several = (n > 1) & (F.col("n_org") == n) & (F.col("n_dst") == n)
    per = per.withColumn("starts", F.when(several, F.filter("l", lambda x: ~F.exists("l", lambda y: y["dst"] == x["org"]))))
    on = lambda acc: F.transform(F.slice(F.filter("l", lambda y: y["org"] == F.element_at(acc, -1)), 1, 1), lambda y: y["dst"])
    walk = F.aggregate("l", F.array(F.try_element_at("starts", F.lit(1))["org"]), lambda acc, _: F.concat(acc, on(acc)))
    per = per.withColumn("walk", F.when(F.size("starts") == 1, walk))
    chain = F.when(n == 1, F.array(F.col("l")[0]["org"], F.col("l")[0]["dst"])).when(F.size("walk") == n + 1, F.col("walk")).when((F.col("total") > 0) & (F.col("top.n") / F.col("total") >= dominant), F.array("top.org", "top.dst"))
    return per.select("callsign", chain.alias("chain")).where("chain is not null")


def flying_order(legs: DataFrame) -> DataFrame:
    """(callsign, route, pairs): legs in flying order, and every ordered pair of stops of each connected stretch.

    legs(callsign, org, dst, dep_min, n). One chain where the legs make one, else by departure."""
    per = legs.groupBy("callsign").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("dep_min", F.lit(2**31 - 1)).alias("dep"), (-F.col("n")).alias("m"), "org", "dst"))), lambda x: F.struct(x["org"].alias("org"), x["dst"].alias("dst"))).alias("l"))
    n = F.size("l")
    starts = F.filter("l", lambda x: ~F.exists("l", lambda y: y["dst"] == x["org"]))
    one = (F.size(F.array_distinct(F.transform("l", lambda x: x["org"]))) == n) & (F.size(starts) == 1)
    first = F.slice(starts, 1, 1)
    follow = lambda acc: F.try_element_at(F.filter("l", lambda y: (y["org"] == F.element_at(acc, -1)["dst"]) & ~F.array_contains(acc, y)), F.lit(1))
    chained = F.aggregate("l", first, lambda acc, _: F.when(F.size(acc) == 0, acc).when(follow(acc).isNotNull(), F.concat(acc, F.array(follow(acc)))).otherwise(acc))
    order = F.when(one & (F.size(chained) == n), chained).otherwise(F.col("l"))
    per = per.withColumn("o", order)
    kind = "struct<route:array<string>,stretch:array<array<string>>>"
    zero = F.struct(F.array().cast("array<string>").alias("route"), F.array().cast("array<array<string>>").alias("stretch")).cast(kind)

    def add(acc, x):
        joins = F.coalesce(F.try_element_at(acc["route"], F.lit(-1)) == x["org"], F.lit(False))
        grown = F.concat(F.slice(acc["stretch"], F.lit(1), F.size(acc["stretch"]) - 1), F.array(F.concat(F.element_at(acc["stretch"], -1), F.array(x["dst"]))))
        fresh = F.concat(acc["stretch"], F.array(F.array(x["org"], x["dst"])))
        return F.when(joins, F.struct(F.concat(acc["route"], F.array(x["dst"])).alias("route"), grown.alias("stretch"))).otherwise(F.struct(F.concat(acc["route"], F.array(x["org"], x["dst"])).alias("route"), fresh.alias("stretch"))).cast(kind)

    per = per.withColumn("f", F.aggregate("o", zero, add))
    pairs = F.flatten(F.transform("f.stretch", lambda s: F.flatten(F.transform(s, lambda a, i: F.transform(F.filter(F.slice(s, i + 2, F.size(s)), lambda b: b != a), lambda b: F.concat(a, F.lit(">"), b))))))
    return per.select("callsign", F.col("f.route").alias("route"), F.array_distinct(pairs).alias("pairs"))


def distinct_keep_order(keys: DataFrame, key: str = "callsign", pos: str = "pos") -> DataFrame:
    """Asked keys trimmed and upper, each at its first place."""
    k = keys.select(F.upper(F.trim(key)).alias(key), pos).where(F.col(key) != "")
    return k.groupBy(key).agg(F.min(pos).alias(pos))


def resolve_route(keys: DataFrame, routes: DataFrame, catalog: DataFrame, schedule: DataFrame, today: Column) -> DataFrame:
    """Keys with their chain: observed, else the catalog row in force, else the timetable's; `route_source` says which."""
    c = catalog_current(catalog, today).select("callsign", tx.catalog_route("origin", "via", "dest").alias("_c"))
    j = keys.join(routes.select("callsign", F.col("chain").alias("_o")), "callsign", "left").join(c, "callsign", "left").join(schedule_chain(schedule).withColumnRenamed("chain", "_s"), "callsign", "left")
    source = F.when(F.col("_o").isNotNull(), "observed").when(F.col("_c").isNotNull(), "catalog").when(F.col("_s").isNotNull(), "schedule")
    return j.withColumns({"chain": F.coalesce("_o", "_c", "_s"), "route_source": source}).drop("_o", "_c", "_s")


def marketed_to_callsign(keys: DataFrame, schedule: DataFrame) -> DataFrame:
    """Marketed numbers with the callsign that flies most under each. keys(flight)."""
    best = schedule.where("flight is not null").groupBy("flight").agg(F.max_by("callsign", F.struct("n_flights", "callsign")).alias("callsign"))
    return keys.join(best, "flight", "left")


def published_legs_beside(observed: DataFrame, schedule: DataFrame) -> DataFrame:
    """Observed legs(callsign, org, dst, flights, days, last) and the published ones not seen, with 0 flights."""
    p = schedule.where("source in ('published', 'both')").select("callsign", "org", "dst").distinct().join(observed, ["callsign", "org", "dst"], "left_anti")
    return observed.unionByName(p.withColumns({"flights": F.lit(0).cast("long"), "days": F.lit(0).cast("long"), "last": F.lit(None).cast("date")}), allowMissingColumns=True)


def todays_board(boards: DataFrame, airports: DataFrame, schedule: DataFrame, now: Column) -> DataFrame:
    """Each airport's rows of its own local day, one per (kind, flight), joined to the services that carry the number."""
    local = airports.select(F.coalesce("iata", "ident").alias("airport"), F.to_date(F.from_utc_timestamp(now, F.coalesce("tz", F.lit("UTC")))).alias("today"))
    b = top_k(boards.join(local, "airport").where("day = today"), ["airport", "kind", "flight"], [F.col("sched_min").asc_nulls_last(), F.desc("fetched_at")], 1, "_r").drop("_r", "today")
    s = schedule.where("source = 'both'").select(F.col("flight"), F.col("org"), F.col("dst"), "callsign", "type_code")
    at = F.when(F.col("kind") == "dep", F.col("org")).otherwise(F.col("dst"))
    j = b.join(s, "flight", "left").where(F.col("callsign").isNull() | (at == F.col("airport")))
    return top_k(j, ["airport", "kind", "flight"], [F.col("callsign")], 1, "_r").drop("_r", "org", "dst").withColumn("time", tu.hhmm("sched_min"))


def board(schedule: DataFrame, airlines: DataFrame, k: int = 80, departures: bool = True) -> DataFrame:
    """Each airport's k busiest services by local time, unknown times last."""
    at, minute = ("org", "dep_min") if departures else ("dst", "arr_min")
    rows = top_k(schedule, [at], [F.desc("n_flights"), F.col("callsign"), F.col("org"), F.col("dst")], k, "_r").drop("_r")
    rows = rows.join(airlines.select(F.col("icao").alias("airline_icao"), "iata", F.col("name").alias("airline")), "airline_icao", "left")
    w = Window.partitionBy(at).orderBy(F.col(minute).asc_nulls_last(), "callsign", "org", "dst")
    return rows.withColumns({"place": F.row_number().over(w), "time": tu.hhmm(minute), "label": tx.flight_label("callsign", "iata", "flight")}).drop("iata")


def arrivals_board(schedule: DataFrame, airlines: DataFrame, k: int = 80) -> DataFrame:
    return board(schedule, airlines, k, departures=False)


def airline_schedule(schedule: DataFrame, airlines: DataFrame, airports: DataFrame) -> DataFrame:
    """Every airline's services by origin and departure, with labels, times and city names."""
    spot = ag.airport_codes(airports).select("code", "municipality")
    end = lambda df, c: df.join(spot.select(F.col("code").alias(c), F.col("municipality").alias(f"{c}_city")), c, "left")
    j = end(end(schedule, "org"), "dst").join(airlines.select(F.col("icao").alias("airline_icao"), "iata"), "airline_icao", "left")
    w = Window.partitionBy("airline_icao").orderBy("org", F.col("dep_min").asc_nulls_last(), "dst", "callsign")
    return j.withColumns({"label": tx.flight_label("callsign", "iata", "flight"), "dep": tu.hhmm("dep_min"), "arr": tu.hhmm("arr_min"), "place": F.row_number().over(w)}).drop("iata")


def airframe_record(hexes: DataFrame, ref: DataFrame, airlines: DataFrame, types: DataFrame, legs: DataFrame, spells: DataFrame, events: DataFrame, statements: DataFrame, most_legs: int = 200) -> DataFrame:
    """Identity, newest legs, spells, public events and the newest registry statement per field; a section without its table stays null."""
    ids = airframe_of_hex(spells)
    named = freshest_non_null(legs, ["hex"], ["reg", "type"], ["date", "dep_ts"]).withColumnsRenamed({"reg": "log_reg", "type": "log_type"})
    base = enrich_airframes(hexes.select("hex").distinct(), ref, airlines, types).join(named, "hex", "left").join(ids, "hex", "left")
    log = recent(legs.join(hexes.select("hex").distinct(), "hex"), ["hex"], most_legs)
    log = log.groupBy("hex").agg(F.array_sort(F.collect_list(F.struct("rank", "date", "callsign", "org", "dst", "dep_ts", "arr_ts"))).alias("legs"))
    sp = spells.groupBy("airframe_id").agg(F.array_sort(F.collect_list(F.struct("kind", "first_date", "last_date", "value"))).alias("spells"))
    ev = public_only(events).groupBy("airframe_id").agg(F.array_sort(F.collect_list(F.struct("at", "kind"))).alias("events"))
    st = statements.groupBy("airframe_id", "field").agg(F.max_by("value", F.struct("last_seen", "value")).alias("v")).groupBy("airframe_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "v")))).alias("statements"))
    return base.join(log, "hex", "left").join(sp, "airframe_id", "left").join(ev, "airframe_id", "left").join(st, "airframe_id", "left")


def flight_record(callsigns: DataFrame | None, legs: DataFrame, schedule: DataFrame, routes: DataFrame, catalog: DataFrame, today: Column) -> DataFrame:
    """Route and its source, legs with times, tails and newest operations of each callsign; None asks for every one of the log.

    All of it groups by callsign, which flies a few legs a day at most: legs dealt by callsign are not shuffled again."""
    keys = (legs.where("callsign is not null") if callsigns is None else callsigns).select("callsign").distinct()
    mine = legs.where("callsign is not null") if callsigns is None else legs.join(keys, "callsign", "left_semi")
    seen = published_legs_beside(ag.flight_legs(mine).drop("rank"), schedule.join(keys, "callsign", "left_semi"))
    timed = seen.join(schedule.select("callsign", "org", "dst", "dep_min", "arr_min", "weekdays", "flight"), ["callsign", "org", "dst"], "left")
    timed = timed.withColumns({"dep": tu.hhmm("dep_min"), "arr": tu.hhmm("arr_min"), "days_apart": tu.weekday_times("weekdays")})
    l = timed.groupBy("callsign").agg(F.array_sort(F.collect_list(F.struct((-F.col("flights")).alias("order"), "org", "dst", "flights", "days", "last", "dep", "arr", "days_apart"))).alias("legs"), F.max("flight").alias("flight"))
    t = ag.flight_tails(mine).groupBy("callsign").agg(F.array_sort(F.collect_list(F.struct("rank", "hex", "reg", "type", "flights"))).alias("tails"))
    r = recent(mine, ["callsign"], 10).groupBy("callsign").agg(F.array_sort(F.collect_list(F.struct("rank", "date", "hex", "org", "dst", "dep_ts", "arr_ts"))).alias("recent"))
    return resolve_route(keys, routes, catalog, schedule, today).join(l, "callsign", "left").join(t, "callsign", "left").join(r, "callsign", "left")


def airport_record(codes: DataFrame, airports: DataFrame, legs: DataFrame, schedule: DataFrame, airlines: DataFrame) -> DataFrame:
    """Identity, totals, busiest destinations, boards and airlines of each asked airport."""
    a = ag.airport_codes(airports)
    base = codes.select("code").distinct().join(a, "code", "left")
    pack = lambda df, key, cols, out: df.groupBy(F.col(key).alias("code")).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(out))
    dep, arr = board(schedule, airlines), arrivals_board(schedule, airlines)
    parts = (
        ag.airport_totals(legs).withColumnRenamed("org", "code"),
        pack(ag.airport_busiest(legs), "org", ("rank", "dst", "flights", "days"), "busiest"),
        pack(dep, "org", ("place", "label", "dst", "time"), "departures_board"),
        pack(arr, "dst", ("place", "label", "org", "time"), "arrivals_board"),
        pack(ag.airport_airlines(dep), "org", ("rank", "airline_icao", "n"), "airlines"),
    )
    for p in parts:
        base = base.join(p, "code", "left")
    return base


def merge_skies(own: DataFrame, *partners: tuple[str, DataFrame]) -> DataFrame:
    """The own sky with each partner's aircraft that nobody before it hears; `via` names who."""
    out = own.withColumn("via", F.lit(None).cast("string"))
    for name, sky in partners:
        out = out.unionByName(sky.join(out.select("hex"), "hex", "left_anti").withColumn("via", F.lit(name)), allowMissingColumns=True)
    return out


def fleet_view(sky: DataFrame, ref: DataFrame, airlines: DataFrame, types: DataFrame, routes: DataFrame, catalog: DataFrame, schedule: DataFrame, today: Column) -> DataFrame:
    """The live sky with identity, military flag, and route with its source."""
    e = enrich_airframes(sky, ref, airlines, types).withColumn("military", tx.military("flags")).withColumn("callsign", F.upper(F.trim("flight")))
    keys = e.where("callsign is not null").select("callsign").distinct()
    return e.join(resolve_route(keys, routes, catalog, schedule, today), "callsign", "left")


def route_pairs(queries: DataFrame) -> DataFrame:
    """All ordered pairs of two short code lists of each query(q, froms, tos)."""
    return queries.select("q", F.explode("froms").alias("org"), "tos").select("q", "org", F.explode("tos").alias("dst")).where("org <> dst")

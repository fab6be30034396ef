"""Aggregates over the flight log, schedules, fleets and registries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aerolith.functions import geo
from aerolith.operators.filters import not_circuit, plausible_leg, valid_leg
from aerolith.operators.windows import ranked_overall, top_k


def with_operator(legs: DataFrame, airframes_ref: DataFrame) -> DataFrame:
    """Legs of airframes whose operator is known, with `airline_icao`. Spark broadcasts the registry if it is small."""
    ops = airframes_ref.where("operator_icao is not null").select("hex", F.col("operator_icao").alias("airline_icao"))
    return legs.join(ops, "hex")


def _leg_pairs(legs: DataFrame, airframes_ref: DataFrame) -> DataFrame:
    legs = legs.where(plausible_leg())
    return with_operator(legs, airframes_ref).withColumns({"o": F.least("org", "dst"), "d": F.greatest("org", "dst")})


def observed_days(legs: DataFrame, window_days: int) -> DataFrame:
    """One row: the days the log spans, at least 1 and at most the window."""
    span = F.datediff(F.max("date"), F.min("date")) + 1
    return legs.agg(F.greatest(F.lit(1), F.least(F.coalesce(span, F.lit(1)), F.lit(window_days))).alias("days"))


def leg_stats(legs: DataFrame, airframes_ref: DataFrame, window_days: int = 60) -> DataFrame:
    """Per airline and undirected pair: flights, days, flights a week, mean minutes of legs of 10 minutes to 20 hours."""
    p = _leg_pairs(legs, airframes_ref)
    took = F.col("arr_ts") - F.col("dep_ts")
    g = p.groupBy("airline_icao", "o", "d").agg(F.count(F.lit(1)).alias("n_flights"), F.countDistinct("date").alias("n_days"), (F.avg(F.when(took.between(600, 72000), took)) / 60).cast("int").alias("avg_min"))
    days = observed_days(legs.where(plausible_leg()), window_days)
    return g.join(F.broadcast(days)).withColumn("per_week", F.bround(F.col("n_flights") / F.col("days") * 7, 2)).drop("days")


def top_types(legs: DataFrame, airframes_ref: DataFrame, k: int = 4) -> DataFrame:
    """The most-flown types of each airline and pair, ranked."""
    n = _leg_pairs(legs, airframes_ref).where("type is not null").groupBy("airline_icao", "o", "d", "type").agg(F.count(F.lit(1)).alias("n"))
    return top_k(n, ["airline_icao", "o", "d"], [F.desc("n"), F.col("type")], k)


def top_airframes(legs: DataFrame, airframes_ref: DataFrame, k: int = 6) -> DataFrame:
    n = _leg_pairs(legs, airframes_ref).groupBy("airline_icao", "o", "d", "hex").agg(F.count(F.lit(1)).alias("n"))
    return top_k(n, ["airline_icao", "o", "d"], [F.desc("n"), F.col("hex")], k)


def leg_stats_full(legs: DataFrame, airframes_ref: DataFrame, window_days: int = 60) -> DataFrame:
    """`leg_stats` with the top types and tails as arrays, as the reference table keeps them."""
    key = ["airline_icao", "o", "d"]
    pack = lambda df, c, out: df.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", c, "n"))), lambda s: F.struct(s[c].alias(c), s["n"].alias("n"))).alias(out))
    out = leg_stats(legs, airframes_ref, window_days)
    return out.join(pack(top_types(legs, airframes_ref), "type", "types"), key, "left").join(pack(top_airframes(legs, airframes_ref), "hex", "airframes"), key, "left")


def airport_totals(legs: DataFrame, approximate: bool = False) -> DataFrame:
    """Departures, destinations, tails and days of each airport; circuits are left out, one-sided legs are not."""
    distinct = F.approx_count_distinct if approximate else F.countDistinct
    return legs.where(F.col("org").isNotNull() & not_circuit()).groupBy("org").agg(F.count(F.lit(1)).alias("departures"), distinct("dst").alias("destinations"), distinct("hex").alias("tails"), distinct("date").alias("days"))


def airport_busiest(legs: DataFrame, k: int = 15) -> DataFrame:
    """The busiest destinations of each airport; of equals the later code first."""
    n = legs.where(valid_leg()).groupBy("org", "dst").agg(F.count(F.lit(1)).alias("flights"), F.countDistinct("date").alias("days"))
    return top_k(n, ["org"], [F.desc("flights"), F.desc("dst")], k)


def flight_legs(legs: DataFrame, k: int = 10) -> DataFrame:
    """The legs of each callsign: flights, days, last day."""
    n = legs.where(valid_leg() & F.col("callsign").isNotNull()).groupBy("callsign", "org", "dst").agg(F.count(F.lit(1)).alias("flights"), F.countDistinct("date").alias("days"), F.max("date").alias("last"))
    return top_k(n, ["callsign"], [F.desc("flights"), F.col("org"), F.col("dst")], k)


def flight_tails(legs: DataFrame, k: int = 8) -> DataFrame:
    """The tails of each callsign; registration and type of the newest day that has them."""
    named = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("date", "dep_ts"))).alias(c)
    n = legs.where("callsign is not null and hex is not null").groupBy("callsign", "hex").agg(F.count(F.lit(1)).alias("flights"), named("reg"), named("type"))
    return top_k(n, ["callsign"], [F.desc("flights"), F.col("hex")], k)


def airframe_summary(legs: DataFrame) -> DataFrame:
    """Per airframe: legs, the last leg, where it sits (if its arrival was seen), its most-flown route."""
    rows = legs.where("hex is not null")
    newest = F.struct("date", F.coalesce("dep_ts", F.lit(-1)), F.coalesce("callsign", F.lit("")))
    last = rows.groupBy("hex").agg(F.count(F.lit(1)).alias("n_legs"), F.max_by(F.struct("org", "dst", "date", "arr_ts"), newest).alias("l"))
    pairs = rows.where(valid_leg()).groupBy("hex", "org", "dst").agg(F.count(F.lit(1)).alias("n"))
    best = top_k(pairs, ["hex"], [F.desc("n"), F.col("org"), F.col("dst")], 1, "_r").select("hex", F.col("org").alias("top_org"), F.col("dst").alias("top_dst"), F.col("n").alias("top_n"))
    out = last.select("hex", "n_legs", F.col("l.org").alias("last_org"), F.col("l.dst").alias("last_dst"), F.col("l.date").alias("last_date"), F.when(F.col("l.arr_ts").isNotNull(), F.col("l.dst")).alias("sits_at"))
    return out.join(best, "hex", "left")


def served_by_airline(routes: DataFrame) -> DataFrame:
    """Routes touching an airport, by the callsign's three letters."""
    stops = routes.select(F.substring("callsign", 1, 3).alias("airline"), F.explode(F.array_distinct("chain")).alias("code"))
    return stops.groupBy("airline", "code").agg(F.count(F.lit(1)).alias("n_routes"))


def airport_codes(airports: DataFrame) -> DataFrame:
    """(code, ...) one row per code an airport answers to; a code of several goes to IATA before ident, then the lowest ident."""
    base = airports.columns
    both = airports.withColumn("_c", F.explode(F.array(F.struct(F.lit(0).alias("r"), F.col("iata").alias("code")), F.struct(F.lit(1).alias("r"), F.col("ident").alias("code"))))).where("_c.code is not null")
    first = both.groupBy(F.col("_c.code").alias("code")).agg(F.min_by(F.struct(*base), F.struct("_c.r", "ident")).alias("a"))
    return first.select("code", "a.*")


def country_of_code(codes: DataFrame, airports: DataFrame, code: str = "code") -> DataFrame:
    """Add `iso_country` of IATA or ident codes."""
    return codes.join(airport_codes(airports).select(F.col("code").alias(code), "iso_country"), code, "left")


def airline_of_callsign(routes: DataFrame, airlines: DataFrame) -> DataFrame:
    """Routes with `airline_icao`, where the three letters are an airline's."""
    return routes.withColumn("airline_icao", F.substring("callsign", 1, 3)).join(airlines.select(F.col("icao").alias("airline_icao")), "airline_icao", "left_semi")


def airline_countries(routes: DataFrame, airlines: DataFrame, airports: DataFrame) -> DataFrame:
    """Routes per airline and country; a route counts once for each country it touches."""
    r = airline_of_callsign(routes, airlines).select("airline_icao", "callsign", F.explode("chain").alias("code"))
    c = country_of_code(r, airports).where("iso_country is not null").select("airline_icao", "callsign", "iso_country").distinct()
    return c.groupBy("airline_icao", "iso_country").agg(F.count(F.lit(1)).alias("n_routes"))


def airline_counts(airlines: DataFrame, routes: DataFrame, countries: DataFrame) -> DataFrame:
    """Every airline with its routes and countries, 0 where it has none."""
    r = routes.groupBy(F.substring("callsign", 1, 3).alias("icao")).agg(F.count(F.lit(1)).alias("n_routes"))
    c = countries.groupBy(F.col("airline_icao").alias("icao")).agg(F.countDistinct("iso_country").alias("n_countries"))
    return airlines.join(r, "icao", "left").join(c, "icao", "left").fillna(0, ["n_routes", "n_countries"])


def covered_airlines(memberships: DataFrame) -> DataFrame:
    """(slug, airline_icao, direct) of active memberships."""
    a = memberships.where("status = 'active'")
    return a.groupBy("slug", "airline_icao").agg(F.bool_or(F.col("relationship") == "member").alias("direct"))


def alliance_summary(memberships: DataFrame, routes: DataFrame, leg_stats_: DataFrame, countries: DataFrame, airframes_ref: DataFrame) -> DataFrame:
    """Per alliance: direct members, those observed, airlines covered, routes, legs, flights, countries and airframes."""
    m = covered_airlines(memberships)
    r = routes.groupBy(F.substring("callsign", 1, 3).alias("airline_icao")).agg(F.count(F.lit(1)).alias("routes"))
    l = leg_stats_.groupBy("airline_icao").agg(F.sum("n_flights").alias("flights"))
    a = airframes_ref.where("operator_icao is not null").groupBy(F.col("operator_icao").alias("airline_icao")).agg(F.count(F.lit(1)).alias("airframes"))
    per = m.join(r, "airline_icao", "left").join(l, "airline_icao", "left").join(a, "airline_icao", "left")
    seen = F.coalesce("routes", F.lit(0)) + F.coalesce("flights", F.lit(0)) > 0
    total = per.groupBy("slug").agg(F.count_if("direct").alias("direct_members"), F.count_if(F.col("direct") & seen).alias("members_observed"), F.count(F.lit(1)).alias("airlines"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("routes", "flights", "airframes")])
    pairs = m.join(leg_stats_, "airline_icao").groupBy("slug").agg(F.countDistinct("o", "d").alias("legs"))
    lands = m.join(countries, "airline_icao").groupBy("slug").agg(F.countDistinct("iso_country").alias("countries"))
    return total.join(pairs, "slug", "left").join(lands, "slug", "left").fillna(0, ["legs", "countries"])


def alliance_members(memberships: DataFrame, airlines: DataFrame, routes: DataFrame, countries: DataFrame) -> DataFrame:
    """Each membership with its airline's routes and countries."""
    counts = airline_counts(airlines, routes, countries).select(F.col("icao").alias("airline_icao"), "n_routes", "n_countries")
    return memberships.join(counts, "airline_icao", "left").fillna(0, ["n_routes", "n_countries"])


def alliance_country_rollup(memberships: DataFrame, countries: DataFrame) -> DataFrame:
    return covered_airlines(memberships).join(countries, "airline_icao").groupBy("slug", "iso_country").agg(F.sum("n_routes").alias("n_routes"))


def chain_legs(routes: DataFrame) -> DataFrame:
    """Consecutive pairs of chains as undirected legs of an airline: (airline_icao, o, d, n_routes)."""
    pairs = F.transform(F.sequence(F.lit(1), F.size("chain") - 1), lambda i: F.struct(F.element_at("chain", i).alias("a"), F.element_at("chain", i + 1).alias("b")))
    legs = routes.where("size(chain) >= 2").select(F.substring("callsign", 1, 3).alias("airline_icao"), F.explode(pairs).alias("p")).where("p.a <> p.b")
    return legs.groupBy("airline_icao", F.least("p.a", "p.b").alias("o"), F.greatest("p.a", "p.b").alias("d")).agg(F.count(F.lit(1)).alias("n_routes"))


def alliance_legs(memberships: DataFrame, leg_stats_: DataFrame, k: int = 6) -> DataFrame:
    """Members' legs merged: flights and frequency added, minutes weighted by flights, the most-flown types."""
    m = covered_airlines(memberships).join(leg_stats_, "airline_icao")
    key = ["slug", "o", "d"]
    timed = F.when(F.col("avg_min").isNotNull(), F.col("n_flights"))
    total = m.groupBy(*key).agg(F.sum("n_flights").alias("n_flights"), F.bround(F.sum("per_week"), 2).alias("per_week"), F.bround(F.sum(F.col("avg_min") * F.col("n_flights")) / F.sum(timed)).cast("int").alias("avg_min"))
    types = m.select(*key, F.explode("types").alias("t")).groupBy(*key, F.col("t.type").alias("type")).agg(F.sum("t.n").alias("n"))
    best = top_k(types, key, [F.desc("n"), F.col("type")], k).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("rank", "type", "n"))).alias("types"))
    return total.join(best, key, "left")


def airline_legs(leg_stats_: DataFrame, routes: DataFrame, airports: DataFrame) -> DataFrame:
    """Legs of every airline: from the log, or from chains for airlines the log does not have; both ends must resolve."""
    logged = leg_stats_.select("airline_icao", "o", "d", F.col("n_flights").alias("n"), "per_week", "avg_min", F.lit("log").alias("basis"))
    other = chain_legs(routes).join(leg_stats_.select("airline_icao").distinct(), "airline_icao", "left_anti")
    none = lambda t: F.lit(None).cast(t)
    other = other.select("airline_icao", "o", "d", F.col("n_routes").alias("n"), none("double").alias("per_week"), none("int").alias("avg_min"), F.lit("routes").alias("basis"))
    spots = airport_codes(airports).where("lat is not null").select("code", "lat", "lon")
    end = lambda df, c: df.join(spots.select(F.col("code").alias(c), F.struct("lat", "lon").alias(f"{c}_at")), c)
    return end(end(logged.unionByName(other), "o"), "d")


def leg_airframes(leg_stats_: DataFrame, airframes_ref: DataFrame) -> DataFrame:
    """Tails of each airline's pair with their identity."""
    tails = leg_stats_.select("airline_icao", "o", "d", F.explode("airframes").alias("a")).select("airline_icao", "o", "d", "a.hex", "a.n")
    return tails.join(airframes_ref.select("hex", "registration", "type_code", "operator_name"), "hex", "left")


def fleet_members(airframes_ref: DataFrame, airlines: DataFrame) -> DataFrame:
    """(icao, hex, type_code): observed operator, or the registry's operator name for those not seen to fly. Two equi joins, not an OR."""
    seen = airframes_ref.where("operator_icao is not null").select(F.col("operator_icao").alias("icao"), "hex", "type_code").join(airlines.select("icao"), "icao", "left_semi")
    named = airframes_ref.select(F.col("operator_norm").alias("norm"), "hex", "type_code").join(airlines.select("icao", F.upper("name").alias("norm")), "norm").select("icao", "hex", "type_code")
    return seen.union(named).distinct()


def fleet_by_type(airframes_ref: DataFrame, airlines: DataFrame) -> DataFrame:
    """Airframes per airline and type; the null type counts those whose type is unknown."""
    return fleet_members(airframes_ref, airlines).groupBy("icao", "type_code").agg(F.count(F.lit(1)).alias("n"))


def fleet_of_type(airframes_ref: DataFrame, airlines: DataFrame, legs: DataFrame, k: int = 300) -> DataFrame:
    """Airframes of each airline and type by registration, at most k, with where each was last."""
    m = fleet_members(airframes_ref, airlines).join(airframes_ref.select("hex", "registration"), "hex").where("registration is not null")
    return top_k(m, ["icao", "type_code"], [F.col("registration"), F.col("hex")], k).join(airframe_summary(legs), "hex", "left")


def current_fleet(spells: DataFrame, airframes: DataFrame, events: DataFrame, within_days: int = 60) -> DataFrame:
    """Airframes whose newest operator spell is an airline's and recent, with hex, registration, first day and distinct airlines.

    airframes(airframe_id, type_code); events(airframe_id, kind, at, visibility)."""
    newest = lambda kind: spells.where(F.col("kind") == kind).groupBy("airframe_id").agg(F.max_by("value", F.struct("first_date", "value")).alias(kind))
    op = spells.where("kind = 'operator'").groupBy("airframe_id").agg(F.max_by(F.struct("value", "first_date", "last_date"), F.struct("first_date", "value")).alias("o"), F.countDistinct("value").alias("n_airlines"))
    until = spells.agg(F.max("last_date").alias("until"))
    now = op.join(F.broadcast(until)).where(F.datediff("until", "o.last_date") <= within_days)
    first = spells.groupBy("airframe_id").agg(F.min("first_date").alias("seen_from"))
    noted = events.where("visibility = 'public'").groupBy("airframe_id").agg(F.count(F.lit(1)).alias("n_events"))
    out = now.select("airframe_id", F.col("o.value").alias("airline"), F.col("o.first_date").alias("since"), F.col("o.last_date").alias("last_seen"), "n_airlines")
    out = out.join(newest("hex"), "airframe_id", "left").join(newest("registration"), "airframe_id").join(first, "airframe_id").join(airframes, "airframe_id", "left").join(noted, "airframe_id", "left")
    return out.withColumn("since_first_seen", F.col("since") == F.col("seen_from")).fillna(0, ["n_events"])


def airport_traffic(schedule: DataFrame) -> DataFrame:
    """Observed departures, counted in flights."""
    return schedule.groupBy(F.col("org").alias("code")).agg(F.sum("n_flights").alias("traffic"))


def airport_airlines(board: DataFrame, k: int = 20, airport: str = "org") -> DataFrame:
    n = board.where("airline_icao <> ''").groupBy(airport, "airline_icao").agg(F.sum("n_flights").alias("n"))
    return top_k(n, [airport], [F.desc("n"), F.col("airline_icao")], k)


def contributors(claims: DataFrame, endorsements: DataFrame, k: int = 200) -> DataFrame:
    """Approved answers per name that stood behind them, most first."""
    j = claims.where("status = 'approved'").join(endorsements.where("handle is not null"), F.col("id") == F.col("claim_id"))
    n = j.groupBy("handle").agg(F.countDistinct("id").alias("answers"), F.to_date(F.max("reviewed_at")).alias("latest"), F.max("reviewed_at").alias("_at"))
    return n.orderBy(F.desc("answers"), "_at", "handle").limit(k).drop("_at")


def claim_backlog(claims: DataFrame, endorsements: DataFrame, automatic: tuple[str, ...] = ("evidence", "timetable")) -> DataFrame:
    """One row: pending claims, and those a person stands behind (anonymously, by name, or with a key of their own)."""
    person = endorsements.where(F.col("key_name").isNull() | ~F.col("key_name").isin(*automatic)).select(F.col("claim_id").alias("id")).distinct()
    p = claims.where("status = 'pending'").join(person.withColumn("person", F.lit(True)), "id", "left")
    return p.agg(F.count(F.lit(1)).alias("pending"), F.count_if((F.col("anonymous_count") > 0) | F.coalesce("person", F.lit(False))).alias("pending_people"))


def voices(claims: DataFrame, endorsements: DataFrame) -> DataFrame:
    """Distinct keys and names behind each claim, and how many were anonymous."""
    e = endorsements.groupBy("claim_id").agg(F.countDistinct("key_name").alias("keyed"), F.countDistinct("handle").alias("named"))
    return claims.select("id", F.col("anonymous_count").alias("anonymous")).join(e, F.col("id") == F.col("claim_id"), "left").drop("claim_id").fillna(0, ["keyed", "named"])


def same_aircraft_candidates(claims: DataFrame) -> DataFrame:
    """(manufacturer, model, msn) that more than one airframe claims. claims(airframe_id, field, value)."""
    v = claims.where(F.col("field").isin("manufacturer", "model", "msn")).groupBy("airframe_id").agg(*[F.collect_set(F.when(F.col("field") == f, F.upper(F.trim("value")))).alias(f) for f in ("manufacturer", "model", "msn")])
    for f in ("manufacturer", "model", "msn"):
        v = v.withColumn(f, F.explode(f))
    return v.groupBy("manufacturer", "model", "msn").agg(F.countDistinct("airframe_id").alias("n"), F.array_sort(F.collect_set("airframe_id")).alias("airframes")).where("n > 1")


def near_history(points: DataFrame, lat: float, lon: float, nm: float, since, k: int = 500) -> DataFrame:
    """Aircraft that passed within a radius since an instant: first, last and closest pass, latest callsign. Cells prune the scan."""
    rows = range(max(0, int(lat + 90 - nm / 60 - 1)), min(179, int(lat + 90 + nm / 60 + 1)) + 1)
    p = points.where((F.col("ts") >= since) & F.floor(F.col("lat") + 90).cast("int").isin(*rows))
    d = p.withColumn("nm", geo.haversine(F.lit(lat), F.lit(lon), "lat", "lon", geo.EARTH_NM)).where(F.col("nm") <= nm)
    out = d.groupBy("hex").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.min("nm").alias("closest_nm"), F.max_by("flight", F.when(F.col("flight").isNotNull(), F.struct("ts", "flight"))).alias("callsign"))
    return out.orderBy(F.desc("last"), "hex").limit(k)


def traffic_timeline(points: DataFrame, slice_s: int = 15) -> DataFrame:
    """The most aircraft in any slice of each five minutes."""
    s = points.groupBy(F.floor(F.col("ts").cast("long") / slice_s).alias("slice")).agg(F.countDistinct("hex").alias("n"))
    return s.groupBy((F.floor(F.col("slice") * slice_s / 300) * 300).alias("bucket")).agg(F.max("n").alias("aircraft"))


def rank_fields(airports: DataFrame, runways: DataFrame, passengers: DataFrame) -> DataFrame:
    """Fields by size: codes at one place count once; runway strength is longest by the root of their number; a missing
    passenger figure is half of the class's middle ratio of passengers to strength.

    airports(code, kind, lat, lon), runways(code, length_ft), passengers(code, pax)."""
    strength = runways.where("length_ft > 0").groupBy("code").agg((F.max("length_ft") * F.sqrt(F.count(F.lit(1)))).alias("strength"))
    a = airports.join(strength, "code", "left").join(passengers, "code", "left")
    spot = a.groupBy("lat", "lon").agg(F.min_by("code", F.struct(F.length("code"), "code")).alias("code"), F.max("kind").alias("kind"), F.max("strength").alias("strength"), F.max("pax").alias("pax")).fillna(0.0, ["strength"])
    ratio = spot.where("pax > 0 and strength > 0").withColumn("r", F.col("pax") / F.col("strength"))
    ranked = ratio.withColumns({"_n": F.row_number().over(Window.partitionBy("kind").orderBy("r", "code")), "_c": F.count(F.lit(1)).over(Window.partitionBy("kind"))})
    middle = ranked.where("_n = floor(_c / 2) + 1").select("kind", F.col("r").alias("middle"))
    filled = spot.join(F.broadcast(middle), "kind", "left").withColumn("score", F.coalesce(F.col("pax").cast("double"), F.col("strength") * F.col("middle") / 2, F.lit(0.0)))
    return ranked_overall(filled.drop("middle"), [F.desc("score"), F.col("code")])


def top_fields(airports: DataFrame, n: int = 1000, score: str = "traffic") -> DataFrame:
    """One entry per place under its shortest code."""
    spot = airports.groupBy("lat", "lon").agg(F.min_by("code", F.struct(F.length("code"), "code")).alias("code"), F.max(score).alias(score))
    return spot.orderBy(F.desc(score), "code").limit(n)


def airframe_page_stats(legs: DataFrame) -> DataFrame:
    """Per airframe: flights, airports, days, first day, the most-flown undirected pair."""
    rows = legs.where("hex is not null")
    ends = F.array_compact(F.array("org", "dst"))
    base = rows.groupBy("hex").agg(F.count(F.lit(1)).alias("flights"), F.countDistinct("date").alias("days"), F.min("date").alias("first"))
    fields = rows.select("hex", F.explode(ends).alias("code")).groupBy("hex").agg(F.countDistinct("code").alias("airports"))
    pair = rows.where(valid_leg()).groupBy("hex", F.least("org", "dst").alias("o"), F.greatest("org", "dst").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    best = top_k(pair, ["hex"], [F.desc("n"), F.col("o"), F.col("d")], 1, "_r").select("hex", F.col("o").alias("pair_o"), F.col("d").alias("pair_d"), F.col("n").alias("pair_n"))
    return base.join(fields, "hex", "left").join(best, "hex", "left")


def airline_page_stats(leg_stats_: DataFrame) -> DataFrame:
    """Per airline: flights, the airport with most legs, the busiest pair."""
    ends = leg_stats_.select("airline_icao", F.explode(F.array("o", "d")).alias("code")).groupBy("airline_icao", "code").agg(F.count(F.lit(1)).alias("n"))
    hub = top_k(ends, ["airline_icao"], [F.desc("n"), F.col("code")], 1, "_r").select("airline_icao", F.col("code").alias("hub"))
    busy = top_k(leg_stats_, ["airline_icao"], [F.desc("n_flights"), F.col("o"), F.col("d")], 1, "_r").select("airline_icao", F.col("o").alias("busiest_o"), F.col("d").alias("busiest_d"))
    return leg_stats_.groupBy("airline_icao").agg(F.sum("n_flights").alias("flights")).join(hub, "airline_icao").join(busy, "airline_icao")


def search_quality(golden: DataFrame, results: DataFrame) -> DataFrame:
    """Per tag (and "all"): entries and how many pass, known gaps apart.

    golden(q, k, known_gap, tags, expect_top, expect_in_top_k, expect_not_in_top_k: arrays of "kind:id"); results(q, rank, kind, id)."""
    shown = results.groupBy("q").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.concat_ws(":", "kind", "id").alias("r")))), lambda s: s["r"]).alias("shown"))
    g = golden.join(shown, "q", "left").withColumn("shown", F.coalesce("shown", F.array().cast("array<string>")))
    first, top = F.slice("shown", 1, 1), F.slice("shown", F.lit(1), F.coalesce("k", F.lit(5)))
    none = F.array().cast("array<string>")
    want = lambda c: F.coalesce(c, none)
    ok = ((F.size(want("expect_top")) == 0) | F.arrays_overlap(first, want("expect_top"))) & (F.size(F.array_except(want("expect_in_top_k"), top)) == 0) & ~F.coalesce(F.arrays_overlap(top, want("expect_not_in_top_k")), F.lit(False))
    each = g.withColumn("ok", F.coalesce(ok, F.lit(False))).select(F.explode(F.concat(want("tags"), F.array(F.lit("all")))).alias("tag"), F.coalesce("known_gap", F.lit(False)).alias("known_gap"), "ok")
    return each.groupBy("tag", "known_gap").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("passed"))


def sky_counts(sky: DataFrame) -> DataFrame:
    return sky.agg(F.count(F.lit(1)).alias("aircraft"), F.count_if(F.col("lat").isNotNull() & F.col("lon").isNotNull()).alias("with_position"))


def latest_accuracy(scores: DataFrame) -> DataFrame:
    """The newest day's detail. scores(day, detail)."""
    return scores.agg(F.max("day").alias("day"), F.max_by("detail", "day").alias("detail"))


def memberships_by_airline(memberships: DataFrame, alliances: DataFrame) -> DataFrame:
    """Memberships of each airline, active first, then by alliance name."""
    j = memberships.join(alliances.select("slug", F.col("name").alias("alliance")), "slug")
    s = F.struct((F.col("status") != "active").alias("inactive"), "alliance", "slug", "relationship", "status", "sponsor_icao")
    return j.groupBy("airline_icao").agg(F.array_sort(F.collect_list(s)).alias("memberships"))


"""Registered queries over the flight log, airports, airlines and fleets, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerolith.functions import geo
from aerolith.functions import text as tx
from aerolith.operators import aggregates as ag
from aerolith.operators import filters as fl
from aerolith.operators import schedule as sc
from aerolith.operators import windows as wi
from aerolith.operators.cut import checkpointed
from aerolith.plans.lenses import lens
from aerolith.plans.registry import Registry

R = Registry()
PLAUSIBLE = "org <> dst AND length(org) BETWEEN 3 AND 4 AND length(dst) BETWEEN 3 AND 4 AND coalesce(arr_ts - dep_ts >= 600, true)"
OPS = f"p AS (SELECT l.*, a.operator_icao AS airline_icao, least(org, dst) AS o, greatest(org, dst) AS d FROM legs l JOIN airframes_ref a ON l.hex = a.hex AND a.operator_icao IS NOT NULL WHERE {PLAUSIBLE})"
LEG_STATS = f"ls AS (SELECT airline_icao, o, d, count(*) AS n_flights, count(DISTINCT date) AS n_days, cast(trunc(avg(CASE WHEN arr_ts - dep_ts BETWEEN 600 AND 72000 THEN arr_ts - dep_ts END) / 60) AS int) AS avg_min FROM p GROUP BY ALL), span AS (SELECT greatest(1, least(date_diff('day', min(date), max(date)) + 1, 60)) AS days FROM legs WHERE {PLAUSIBLE})"
CHAINS = "rt AS (SELECT callsign, [a, b] AS chain FROM routes)"
COUNTRIES = "ac AS (SELECT airline_icao, iso_country, count(*) AS n_routes FROM (SELECT DISTINCT substr(r.callsign, 1, 3) AS airline_icao, r.callsign, r.a, r.b, p.iso_country FROM routes r, airports p WHERE p.iata IN (r.a, r.b) AND substr(r.callsign, 1, 3) IN (SELECT icao FROM airlines)) GROUP BY ALL)"


def routes_of(spark, sf):
    return lens(spark, sf, "routes").select("callsign", F.array("a", "b").alias("chain"))


def stats(spark, sf):
    return ag.leg_stats_full(lens(spark, sf, "legs"), lens(spark, sf, "airframes_ref"))


@R.add(f"WITH {OPS}, {LEG_STATS} SELECT airline_icao, o, d, n_flights, n_days, avg_min, round_even(n_flights / days * 7, 2) AS per_week FROM ls, span", "legs", "airframes_ref")
def leg_stats(spark, sf):
    return ag.leg_stats(lens(spark, sf, "legs"), lens(spark, sf, "airframes_ref"))


@R.add(f"WITH {OPS}, n AS (SELECT airline_icao, o, d, type, count(*) AS n FROM p WHERE type IS NOT NULL GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY airline_icao, o, d ORDER BY n DESC, type) AS rank FROM n QUALIFY rank <= 4", "legs", "airframes_ref")
def leg_top_types(spark, sf):
    return ag.top_types(lens(spark, sf, "legs"), lens(spark, sf, "airframes_ref"))


@R.add(f"WITH {OPS}, n AS (SELECT airline_icao, o, d, hex, count(*) AS n FROM p GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY airline_icao, o, d ORDER BY n DESC, hex) AS rank FROM n QUALIFY rank <= 6", "legs", "airframes_ref")
def leg_top_airframes(spark, sf):
    return ag.top_airframes(lens(spark, sf, "legs"), lens(spark, sf, "airframes_ref"))


@R.add("SELECT max(date) AS through FROM legs", "legs", dates="through")
def archive_through(spark, sf):
    from aerolith.sources.readers import archive_through as newest

    return newest(lens(spark, sf, "legs"))


@R.add("SELECT org, count(*) AS departures, count(DISTINCT dst) AS destinations, count(DISTINCT hex) AS tails, count(DISTINCT date) AS days FROM legs WHERE org IS NOT NULL AND (dst IS NULL OR dst <> org) GROUP BY org", "legs")
def airport_totals(spark, sf):
    return ag.airport_totals(lens(spark, sf, "legs"))


@R.add("WITH n AS (SELECT org, dst, count(*) AS flights, count(DISTINCT date) AS days FROM legs WHERE org <> dst GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY org ORDER BY flights DESC, dst DESC) AS rank FROM n QUALIFY rank <= 15", "legs")
def airport_busiest(spark, sf):
    return ag.airport_busiest(lens(spark, sf, "legs"))


@R.add("WITH n AS (SELECT callsign, org, dst, count(*) AS flights, count(DISTINCT date) AS days, max(date) AS last FROM legs WHERE org <> dst GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY callsign ORDER BY flights DESC, org, dst) AS rank FROM n QUALIFY rank <= 10", "legs", dates="last")
def flight_legs(spark, sf):
    return ag.flight_legs(lens(spark, sf, "legs"))


@R.add("WITH n AS (SELECT callsign, hex, count(*) AS flights, arg_max(reg, (date, dep_ts)) AS reg, arg_max(type, (date, dep_ts, type)) AS type FROM legs GROUP BY ALL) SELECT callsign, hex, flights, reg, row_number() OVER (PARTITION BY callsign ORDER BY flights DESC, hex) AS rank FROM n QUALIFY rank <= 8", "legs")
def flight_tails(spark, sf):
    return ag.flight_tails(lens(spark, sf, "legs")).drop("type")


@R.add("SELECT callsign, date, dep_ts, row_number() OVER (PARTITION BY callsign ORDER BY date DESC, dep_ts DESC, hex, org, dst) AS rank FROM legs QUALIFY rank <= 10", "legs", dates="date")
def flight_recent(spark, sf):
    return wi.recent(lens(spark, sf, "legs"), ["callsign"], 10).select("callsign", "date", "dep_ts", "rank")


@R.add("""WITH b AS (SELECT hex, count(*) AS n_legs, max(date) AS last_date FROM legs GROUP BY hex),
n AS (SELECT hex, org, dst, count(*) AS n FROM legs WHERE org <> dst GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY hex ORDER BY n DESC, org, dst) AS r FROM n QUALIFY r = 1)
SELECT b.hex, n_legs, last_date, t.org AS top_org, t.dst AS top_dst, t.n AS top_n FROM b LEFT JOIN t USING (hex)""", "legs", dates="last_date")
def airframe_summary(spark, sf):
    return ag.airframe_summary(lens(spark, sf, "legs")).select("hex", "n_legs", "last_date", "top_org", "top_dst", "top_n")


@R.add("SELECT hex, arg_max(reg, (date, dep_ts, reg)) AS reg, max(date) AS newest FROM legs WHERE reg IS NOT NULL GROUP BY hex", "legs", dates="newest")
def airframe_identity(spark, sf):
    legs = lens(spark, sf, "legs")
    return wi.freshest_non_null(legs, ["hex"], ["reg"], ["date", "dep_ts"]).join(legs.groupBy("hex").agg(F.max("date").alias("newest")), "hex")


@R.add("WITH s AS (SELECT DISTINCT callsign, a, b, unnest([a, b]) AS code FROM routes) SELECT substr(callsign, 1, 3) AS airline, code, count(*) AS n_routes FROM s GROUP BY ALL", "routes")
def airline_served(spark, sf):
    return ag.served_by_airline(routes_of(spark, sf))


def countries(spark, sf):
    # a lens route is one (callsign, org, dst), so the pair belongs to its name
    r = lens(spark, sf, "routes").select(F.concat_ws("|", "callsign", "a", "b").alias("callsign"), F.array("a", "b").alias("chain"))
    return ag.airline_countries(r, lens(spark, sf, "airlines"), lens(spark, sf, "airports"))


@R.add(f"WITH {COUNTRIES} SELECT * FROM ac", "routes", "airlines", "airports")
def airline_countries(spark, sf):
    return countries(spark, sf)


@R.add(f"WITH {COUNTRIES}, r AS (SELECT substr(callsign, 1, 3) AS icao, count(*) AS n FROM routes GROUP BY ALL), c AS (SELECT airline_icao, count(DISTINCT iso_country) AS n FROM ac GROUP BY ALL) SELECT l.icao, coalesce(r.n, 0) AS n_routes, coalesce(c.n, 0) AS n_countries FROM airlines l LEFT JOIN r ON l.icao = r.icao LEFT JOIN c ON l.icao = c.airline_icao", "routes", "airlines", "airports")
def airline_counts(spark, sf):
    return ag.airline_counts(lens(spark, sf, "airlines"), routes_of(spark, sf), countries(spark, sf)).select("icao", "n_routes", "n_countries")


COVERED = "cov AS (SELECT slug, airline_icao, bool_or(relationship = 'member') AS direct FROM memberships WHERE status = 'active' GROUP BY ALL)"


@R.add(f"""WITH {OPS}, {LEG_STATS}, {COUNTRIES}, {COVERED}, r AS (SELECT substr(callsign, 1, 3) AS k, count(*) AS n FROM routes GROUP BY ALL), f AS (SELECT airline_icao AS k, sum(n_flights) AS n FROM ls GROUP BY ALL), a AS (SELECT operator_icao AS k, count(*) AS n FROM airframes_ref GROUP BY ALL)
SELECT slug, count(*) FILTER (direct) AS direct_members, count(*) FILTER (direct AND coalesce(r.n, 0) + coalesce(f.n, 0) > 0) AS members_observed, count(*) AS airlines, coalesce(sum(r.n), 0) AS routes, coalesce(sum(f.n), 0) AS flights, coalesce(sum(a.n), 0) AS airframes,
 (SELECT count(DISTINCT (o, d)) FROM ls JOIN cov c2 USING (airline_icao) WHERE c2.slug = cov.slug) AS legs, (SELECT count(DISTINCT iso_country) FROM ac JOIN cov c3 USING (airline_icao) WHERE c3.slug = cov.slug) AS countries
FROM cov LEFT JOIN r ON r.k = airline_icao LEFT JOIN f ON f.k = airline_icao LEFT JOIN a ON a.k = airline_icao GROUP BY slug""", "legs", "airframes_ref", "routes", "airlines", "airports", "memberships")
def alliance_summary(spark, sf):
    s = ag.leg_stats(lens(spark, sf, "legs"), lens(spark, sf, "airframes_ref"))
    return ag.alliance_summary(lens(spark, sf, "memberships"), routes_of(spark, sf), s, countries(spark, sf), lens(spark, sf, "airframes_ref"))


@R.add(f"WITH {COUNTRIES}, {COVERED} SELECT slug, iso_country, sum(n_routes) AS n_routes FROM cov JOIN ac USING (airline_icao) GROUP BY ALL", "routes", "airlines", "airports", "memberships")
def alliance_countries(spark, sf):
    return ag.alliance_country_rollup(lens(spark, sf, "memberships"), countries(spark, sf))


@R.add(f"WITH {OPS}, {LEG_STATS}, {COVERED} SELECT slug, o, d, sum(n_flights) AS n_flights, cast(round_even(sum(avg_min * n_flights) / sum(n_flights) FILTER (avg_min IS NOT NULL), 0) AS int) AS avg_min FROM cov JOIN ls USING (airline_icao) GROUP BY ALL", "legs", "airframes_ref", "memberships")
def alliance_legs(spark, sf):
    return ag.alliance_legs(lens(spark, sf, "memberships"), stats(spark, sf)).select("slug", "o", "d", "n_flights", "avg_min")


@R.add("""WITH n AS (SELECT substr(callsign, 1, 3) AS airline_icao, least(a, b) AS o, greatest(a, b) AS d, count(*) AS n_routes FROM routes WHERE a <> b GROUP BY ALL) SELECT * FROM n""", "routes")
def chain_legs(spark, sf):
    return ag.chain_legs(routes_of(spark, sf))


@R.add("WITH m AS (SELECT operator_icao AS icao, hex, type_code FROM airframes_ref WHERE operator_icao IN (SELECT icao FROM airlines) UNION SELECT l.icao, a.hex, a.type_code FROM airframes_ref a JOIN airlines l ON a.operator_norm = upper(l.name)) SELECT icao, type_code, count(*) AS n FROM m GROUP BY ALL", "airframes_ref", "airlines")
def fleet_by_type(spark, sf):
    return ag.fleet_by_type(lens(spark, sf, "airframes_ref"), lens(spark, sf, "airlines"))


@R.add("""WITH op AS (SELECT airframe_id, arg_max(value, (first_date, value)) AS airline, max(first_date) AS since, arg_max(last_date, (first_date, value)) AS last_seen, count(DISTINCT value) AS n_airlines FROM spells WHERE kind = 'operator' GROUP BY ALL),
reg AS (SELECT airframe_id, arg_max(value, (first_date, value)) AS registration FROM spells WHERE kind = 'registration' GROUP BY ALL), f AS (SELECT airframe_id, min(first_date) AS seen_from FROM spells GROUP BY ALL)
SELECT airframe_id, airline, since, last_seen, n_airlines, registration, since = seen_from AS since_first_seen FROM op JOIN reg USING (airframe_id) JOIN f USING (airframe_id) WHERE date_diff('day', last_seen, (SELECT max(last_date) FROM spells)) <= 365""", "spells", dates="since last_seen")
def current_fleet(spark, sf):
    spells = lens(spark, sf, "spells")
    none = spells.select("airframe_id", F.lit("x").alias("kind"), F.lit("held").alias("visibility"))
    out = ag.current_fleet(spells, spells.select("airframe_id").distinct(), none, within_days=365)
    return out.select("airframe_id", "airline", "since", "last_seen", "n_airlines", "registration", "since_first_seen")


@R.add("""WITH g AS (SELECT hex, count(*) AS flights, count(DISTINCT date) AS days, min(date) AS first FROM legs GROUP BY ALL), e AS (SELECT hex, count(DISTINCT c) AS airports FROM (SELECT hex, unnest([org, dst]) AS c FROM legs) GROUP BY ALL),
n AS (SELECT hex, least(org, dst) AS pair_o, greatest(org, dst) AS pair_d, count(*) AS pair_n FROM legs WHERE org <> dst GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY hex ORDER BY pair_n DESC, pair_o, pair_d) AS r FROM n QUALIFY r = 1)
SELECT g.hex, flights, days, first, airports, pair_o, pair_d, pair_n FROM g LEFT JOIN e USING (hex) LEFT JOIN t USING (hex)""", "legs", dates="first")
def airframe_page_stats(spark, sf):
    return ag.airframe_page_stats(lens(spark, sf, "legs"))


@R.add(f"""WITH {OPS}, {LEG_STATS}, e AS (SELECT airline_icao, unnest([o, d]) AS c FROM ls), n AS (SELECT airline_icao, c, count(*) AS k FROM e GROUP BY ALL), h AS (SELECT airline_icao, c AS hub FROM n QUALIFY row_number() OVER (PARTITION BY airline_icao ORDER BY k DESC, c) = 1), b AS (SELECT airline_icao, o, d FROM ls QUALIFY row_number() OVER (PARTITION BY airline_icao ORDER BY n_flights DESC, o, d) = 1), f AS (SELECT airline_icao, sum(n_flights) AS flights FROM ls GROUP BY ALL)
SELECT airline_icao, flights, hub, b.o AS busiest_o, b.d AS busiest_d FROM f JOIN h USING (airline_icao) JOIN b USING (airline_icao)""", "legs", "airframes_ref")
def airline_page_stats(spark, sf):
    return ag.airline_page_stats(ag.leg_stats(lens(spark, sf, "legs"), lens(spark, sf, "airframes_ref")))


@R.add("WITH n AS (SELECT callsign, count(*) AS flights, max(date) AS last FROM legs WHERE callsign LIKE 'AB%' GROUP BY ALL) SELECT * FROM n ORDER BY flights DESC, callsign LIMIT 10", "legs", dates="last")
def callsign_prefix(spark, sf):
    return fl.callsign_prefix(lens(spark, sf, "legs"), "AB")


@R.add("WITH d AS (SELECT DISTINCT hex, date FROM legs), g AS (SELECT hex, date, lag(date) OVER (PARTITION BY hex ORDER BY date) AS was FROM d) SELECT hex, was AS last_seen, date AS seen_again, date_diff('day', was, date) - 1 AS days FROM g WHERE date_diff('day', was, date) - 1 >= 3", "legs", dates="last_seen seen_again")
def quiet_spells(spark, sf):
    return wi.quiet_spells(lens(spark, sf, "legs"))


@R.add("WITH s AS (SELECT *, lag(value) OVER w AS was, lag(last_date) OVER w AS ended FROM spells WHERE kind IN ('registration', 'operator') WINDOW w AS (PARTITION BY airframe_id, kind ORDER BY first_date, value)) SELECT airframe_id, concat(kind, '_change') AS kind, first_date AS at, was AS \"from\", value AS \"to\" FROM s WHERE first_date > ended", "spells", dates="at")
def spell_changes(spark, sf):
    return wi.spell_changes(lens(spark, sf, "spells"))


@R.add("WITH s AS (SELECT *, row_number() OVER (PARTITION BY airframe_id ORDER BY first_date, value) AS n, row_number() OVER (PARTITION BY airframe_id, value ORDER BY first_date) AS k FROM spells WHERE kind = 'operator') SELECT airframe_id, value, first_date, CASE WHEN n = 1 THEN 'first' WHEN k > 1 THEN 'again' ELSE 'new airline' END AS stint, row_number() OVER (PARTITION BY airframe_id ORDER BY first_date DESC, value DESC) AS rank FROM s", "spells", dates="first_date")
def operator_stints(spark, sf):
    return wi.stints(lens(spark, sf, "spells")).select("airframe_id", "value", "first_date", "stint", "rank")


SLOTS = """z AS (SELECT ident AS code, tz FROM airports UNION SELECT iata, tz FROM airports),
sg AS (SELECT l.callsign, l.org, l.dst, l.type, l.date, cast(timezone(o.tz, to_timestamp(dep_ts)) AS date) AS day, cast(extract(hour FROM timezone(o.tz, to_timestamp(dep_ts))) * 60 + extract(minute FROM timezone(o.tz, to_timestamp(dep_ts))) AS int) AS minute,
 cast(extract(hour FROM timezone(e.tz, to_timestamp(arr_ts))) * 60 + extract(minute FROM timezone(e.tz, to_timestamp(arr_ts))) AS int) AS arr_minute, (SELECT max(date) FROM legs) AS until
 FROM legs l JOIN z o ON o.code = l.org JOIN z e ON e.code = l.dst WHERE """ + PLAUSIBLE + """), sw AS (SELECT * FROM sg WHERE date >= until - 60)"""


def slot_ctes(recent: bool) -> str:
    weight = "pow(0.5, greatest(0, date_diff('day', day, until)) / 7.0)" if recent else "1.0"
    return f"""wt AS (SELECT callsign, org, dst, minute, {weight} AS w, minute // 5 * 5 AS slot FROM sw), sl AS (SELECT callsign, org, dst, slot, round(sum(w), 9) AS own FROM wt GROUP BY ALL),
ms AS (SELECT a.callsign, a.org, a.dst, a.slot, a.own, round(sum(b.own), 9) AS mass FROM sl a JOIN sl b ON a.callsign = b.callsign AND a.org = b.org AND a.dst = b.dst AND abs((a.slot - b.slot + 720 + 1440) % 1440 - 720) <= 15 GROUP BY ALL),
be AS (SELECT callsign, org, dst, slot AS best FROM ms QUALIFY row_number() OVER (PARTITION BY callsign, org, dst ORDER BY mass DESC, own DESC, slot) = 1),
nr AS (SELECT callsign, org, dst, best, (minute - best + 720 + 1440) % 1440 - 720 AS off, sum(w) AS w FROM wt JOIN be USING (callsign, org, dst) WHERE abs((minute - best + 720 + 1440) % 1440 - 720) <= 15 GROUP BY ALL),
rn AS (SELECT *, round(sum(w) OVER (PARTITION BY callsign, org, dst ORDER BY off ROWS UNBOUNDED PRECEDING), 9) AS run, round(sum(w) OVER (PARTITION BY callsign, org, dst) / 2, 9) AS half FROM nr),
dm AS (SELECT callsign, org, dst, cast(round_even(((best + min(off) + 1440) % 1440) / 5, 0) * 5 AS int) % 1440 AS dep_min FROM rn WHERE run >= half GROUP BY callsign, org, dst, best)"""


def _window(spark, sf):
    legs = lens(spark, sf, "legs")
    s = sc.sightings(legs, lens(spark, sf, "airports")).join(F.broadcast(legs.agg(F.max("date").alias("asof"))))
    return s.where(F.col("date") >= F.date_sub("asof", 60))


@R.add(f"WITH {SLOTS}, n AS (SELECT callsign, org, dst, minute // 5 * 5 AS slot, count(*) AS n FROM sw GROUP BY ALL) SELECT callsign, org, dst, slot AS dep_min FROM n QUALIFY row_number() OVER (PARTITION BY callsign, org, dst ORDER BY n DESC, slot) = 1", "legs", "airports")
def schedule_mode(spark, sf):
    return sc.pick_slot(_window(spark, sf), sc.KEY, "mode")


@R.add(f"WITH {SLOTS}, {slot_ctes(False)} SELECT * FROM dm", "legs", "airports")
def schedule_kernel(spark, sf):
    return sc.pick_slot(_window(spark, sf), sc.KEY, "kernel")


@R.add(f"WITH {SLOTS}, {slot_ctes(True)} SELECT * FROM dm", "legs", "airports")
def schedule_recent_kernel(spark, sf):
    return sc.pick_slot(_window(spark, sf), sc.KEY, "recent+kernel")


def picked(name: str, src: str, key: str, recent: bool, kernel: bool) -> str:
    """CTEs to `name`(key, dep_min): the slot of each key of src(key, day, minute, until)."""
    on = " AND ".join(f"a.{k} = b.{k}" for k in key.split(", "))
    weight = "pow(0.5, greatest(0, date_diff('day', day, until)) / 7.0)" if recent else "1.0"
    circ = lambda a, b: f"(({a} - {b} + 720 + 1440) % 1440 - 720)"
    base = f"{name}_w AS (SELECT {key}, minute, {weight} AS w, minute // 5 * 5 AS slot FROM {src}), {name}_s AS (SELECT {key}, slot, round(sum(w), 9) AS own FROM {name}_w GROUP BY ALL)"
    if not kernel:
        return f"{base}, {name} AS (SELECT {key}, slot AS dep_min FROM {name}_s QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY own DESC, slot) = 1)"
    return f"""{base}, {name}_m AS (SELECT {', '.join(f'a.{k}' for k in key.split(', '))}, a.slot, a.own, round(sum(b.own), 9) AS mass FROM {name}_s a JOIN {name}_s b ON {on} AND abs({circ('a.slot', 'b.slot')}) <= 15 GROUP BY ALL),
{name}_b AS (SELECT {key}, slot AS best FROM {name}_m QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY mass DESC, own DESC, slot) = 1), {name}_n AS (SELECT {key}, best, {circ('minute', 'best')} AS off, sum(w) AS w FROM {name}_w JOIN {name}_b USING ({key}) WHERE abs({circ('minute', 'best')}) <= 15 GROUP BY ALL),
{name}_r AS (SELECT *, round(sum(w) OVER (PARTITION BY {key} ORDER BY off ROWS UNBOUNDED PRECEDING), 9) AS run, round(sum(w) OVER (PARTITION BY {key}) / 2, 9) AS half FROM {name}_n),
{name} AS (SELECT {key}, cast(round_even(((best + min(off) + 1440) % 1440) / 5, 0) * 5 AS int) % 1440 AS dep_min FROM {name}_r WHERE run >= half GROUP BY {key}, best)"""


FULL = f"""{SLOTS}, {slot_ctes(True)}, pa AS (SELECT callsign, org, dst, arr_minute // 5 * 5 AS a FROM sw JOIN dm USING (callsign, org, dst) WHERE arr_minute IS NOT NULL AND abs((minute - dep_min + 720 + 1440) % 1440 - 720) <= 15),
pn AS (SELECT *, row_number() OVER (PARTITION BY callsign, org, dst ORDER BY a) AS n, count(*) OVER (PARTITION BY callsign, org, dst) AS c FROM pa), ar AS (SELECT callsign, org, dst, a AS arr_min FROM pn WHERE n = (c - 1) // 2 + 1),
ty AS (SELECT callsign, org, dst, type FROM (SELECT callsign, org, dst, type, count(*) AS n FROM sw GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY callsign, org, dst ORDER BY n DESC, type) = 1), ct AS (SELECT callsign, org, dst, count(*) AS n_flights FROM sw GROUP BY ALL),
sched AS (SELECT ct.callsign, ct.org, ct.dst, substr(ct.callsign, 1, 3) AS airline_icao, dep_min, arr_min, type AS type_code, n_flights FROM ct LEFT JOIN dm USING (callsign, org, dst) LEFT JOIN ar USING (callsign, org, dst) LEFT JOIN ty USING (callsign, org, dst))"""


def recent_legs(spark, sf, name="legs", days=60):
    """What a timetable reads of the log: its last days. A leg's date is its line's, so the lines alone say how far they reach."""
    first, last = spark.read.parquet(f"{sf.rstrip('/')}/lineitem.parquet").agg(F.min("l_shipdate").cast("date"), F.max("l_shipdate").cast("date")).first()
    return wi.newest_days(lens(spark, sf, name), days, first, last)


def schedule(spark, sf):
    return sc.infer_schedule(recent_legs(spark, sf), lens(spark, sf, "airports"))


def schedule_once(spark, sf):
    """The timetable, worked out and written once for the plan that asks for it more than once."""
    return checkpointed(schedule(spark, sf))


@R.add(f"WITH {FULL} SELECT * FROM sched", "legs", "airports")
def schedule_pooled(spark, sf):
    return schedule(spark, sf).drop("weekdays", "flight", "source")


WEEKDAYS = f"""{FULL}, wd AS (SELECT callsign, org, dst, isodow(day) - 1 AS weekday, day, minute, arr_minute, until FROM sw QUALIFY count(*) OVER (PARTITION BY callsign, org, dst, isodow(day)) >= 3), {picked('wo', 'wd', 'callsign, org, dst, weekday', True, True)},
wk AS (SELECT wo.* FROM wo JOIN dm USING (callsign, org, dst) WHERE abs((wo.dep_min - dm.dep_min + 720 + 1440) % 1440 - 720) > 30),
wa AS (SELECT callsign, org, dst, weekday, arr_minute // 5 * 5 AS a FROM wd JOIN wk USING (callsign, org, dst, weekday) WHERE arr_minute IS NOT NULL AND abs((minute - dep_min + 720 + 1440) % 1440 - 720) <= 15),
wm AS (SELECT callsign, org, dst, weekday, a AS arr FROM (SELECT *, row_number() OVER (PARTITION BY callsign, org, dst, weekday ORDER BY a) AS n, count(*) OVER (PARTITION BY callsign, org, dst, weekday) AS c FROM wa) WHERE n = (c - 1) // 2 + 1)"""


SHUTTLES = "legs AS (SELECT * FROM shuttles)"


def shuttle_schedule(spark, sf):
    """The timetable of flights that an airline flies under one number, often enough for weekday slots."""
    return sc.infer_schedule(recent_legs(spark, sf, "shuttles"), lens(spark, sf, "airports"))


@R.add(f"WITH {SHUTTLES}, {WEEKDAYS} SELECT callsign, org, dst, cast(weekday AS int) AS weekday, dep_min AS dep, arr FROM wk LEFT JOIN wm USING (callsign, org, dst, weekday)", "shuttles", "airports")
def schedule_weekdays(spark, sf):
    s = shuttle_schedule(spark, sf).select("callsign", "org", "dst", F.explode("weekdays").alias("weekday", "t"))
    return s.select("callsign", "org", "dst", "weekday", "t.dep", "t.arr")


@R.add(None)
def schedule_full(spark, sf):
    """The timetable with its weekday slots, as (weekday, times) in order; the tests hold them against hand-made sightings."""
    return schedule(spark, sf).withColumn("weekdays", F.array_sort(F.map_entries("weekdays"))).drop("flight", "source")


@R.add(f"""WITH {FULL}, d AS (SELECT max(date) AS day FROM legs WHERE dst IS NOT NULL), s AS (SELECT l.callsign, l.org, l.dst, cast(extract(hour FROM timezone(z.tz, to_timestamp(dep_ts))) * 60 + extract(minute FROM timezone(z.tz, to_timestamp(dep_ts))) AS int) AS m FROM legs l JOIN d ON l.date = d.day JOIN z ON z.code = l.org)
SELECT 'inferred' AS bucket, count(*) AS legs, count(*) FILTER (abs((m - dep_min + 720 + 1440) % 1440 - 720) <= 45) AS hits FROM s JOIN sched USING (callsign, org, dst) WHERE dep_min IS NOT NULL HAVING count(*) > 0""", "legs", "airports")
def schedule_quality_pooled(spark, sf):
    # a day without a leg of the timetable's days has no service to be held against, so these days are all that is asked
    legs, airports = recent_legs(spark, sf), lens(spark, sf, "airports")
    s = sc.infer_schedule(legs, airports).withColumn("weekdays", F.lit(None).cast("map<int,struct<dep:int,arr:int>>"))
    return sc.schedule_quality(s, legs, airports).drop("accuracy")


@R.add(f"""WITH {SHUTTLES}, {WEEKDAYS}, d AS (SELECT max(date) AS day FROM legs WHERE dst IS NOT NULL), s AS (SELECT l.callsign, l.org, l.dst, timezone(z.tz, to_timestamp(dep_ts)) AS tm FROM legs l JOIN d ON l.date = d.day JOIN z ON z.code = l.org),
f AS (SELECT (cast(extract(hour FROM tm) * 60 + extract(minute FROM tm) AS int) - coalesce(wk.dep_min, sched.dep_min) + 720 + 1440) % 1440 - 720 AS off FROM s JOIN sched USING (callsign, org, dst) LEFT JOIN wk ON wk.callsign = s.callsign AND wk.org = s.org AND wk.dst = s.dst AND weekday = isodow(tm) - 1 WHERE sched.dep_min IS NOT NULL)
SELECT 'inferred' AS bucket, count(*) AS legs, count(*) FILTER (abs(off) <= 45) AS hits, round_even(100.0 * count(*) FILTER (abs(off) <= 45) / count(*), 1) AS accuracy FROM f HAVING count(*) > 0""", "shuttles", "airports")
def schedule_quality(spark, sf):
    """Departures against the timetable, weekday slots first."""
    legs, airports = recent_legs(spark, sf, "shuttles"), lens(spark, sf, "airports")
    return sc.schedule_quality(sc.infer_schedule(legs, airports), legs, airports)


@R.add(f"""WITH {SLOTS}, la AS (SELECT max(day) AS last FROM sg WHERE minute IS NOT NULL), tg AS (SELECT callsign, org, dst, day AS td, minute AS flown FROM sg, la WHERE day > last - 14), ask AS (SELECT DISTINCT callsign, org, dst, td FROM tg),
tr AS (SELECT s.callsign, s.org, s.dst, td, minute // 5 * 5 AS slot FROM sg s JOIN ask USING (callsign, org, dst) WHERE s.day BETWEEN td - 365 AND td - 1), nt AS (SELECT callsign, org, dst, td, count(*) AS n_train FROM tr GROUP BY ALL),
pr AS (SELECT callsign, org, dst, td, slot FROM (SELECT callsign, org, dst, td, slot, count(*) AS n FROM tr GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY callsign, org, dst, td ORDER BY n DESC, slot) = 1)
SELECT 'mode' AS method, CASE WHEN n_train = 1 THEN '1' WHEN n_train <= 4 THEN '2-4' ELSE '5+' END AS support, count(*) AS n, count(*) FILTER (abs((flown - slot + 720 + 1440) % 1440 - 720) <= 15) AS within_15, count(*) FILTER (abs((flown - slot + 720 + 1440) % 1440 - 720) <= 30) AS within_30, count(*) FILTER (abs((flown - slot + 720 + 1440) % 1440 - 720) <= 45) AS within_45
FROM tg JOIN pr USING (callsign, org, dst, td) JOIN nt USING (callsign, org, dst, td) GROUP BY ALL""", "legs", "airports")
def schedule_backtest_mode(spark, sf):
    return sc.schedule_backtest(lens(spark, sf, "legs"), lens(spark, sf, "airports"), days=14, window=365, methods=("mode",)).drop("median_err")


ASKED = "callsign, org, dst, td"
BACKTEST = f"""{SLOTS}, la AS (SELECT max(day) AS last FROM sg WHERE minute IS NOT NULL), tg AS (SELECT callsign, org, dst, day AS td, minute AS flown FROM sg, la WHERE day > last - 14 AND minute IS NOT NULL), ask AS (SELECT DISTINCT {ASKED} FROM tg),
tr AS (SELECT s.callsign, s.org, s.dst, td, day, minute, td - 1 AS until FROM sg s JOIN ask USING (callsign, org, dst) WHERE minute IS NOT NULL AND s.day BETWEEN td - 365 AND td - 1), nt AS (SELECT {ASKED}, count(*) AS n_train FROM tr GROUP BY ALL), tw AS (SELECT * FROM tr WHERE dayofweek(day) = dayofweek(td) QUALIFY count(*) OVER (PARTITION BY {ASKED}) >= 3),
{picked('bm', 'tr', ASKED, False, False)}, {picked('br', 'tr', ASKED, True, False)}, {picked('bk', 'tr', ASKED, False, True)}, {picked('bb', 'tr', ASKED, True, True)}, {picked('om', 'tw', ASKED, False, False)}, {picked('ob', 'tw', ASKED, True, True)},
pd AS (SELECT 'mode' AS method, * FROM bm UNION ALL SELECT 'recent', * FROM br UNION ALL SELECT 'kernel', * FROM bk UNION ALL SELECT 'recent+kernel', * FROM bb
 UNION ALL SELECT 'weekday', {ASKED}, CASE WHEN abs((om.dep_min - bm.dep_min + 720 + 1440) % 1440 - 720) > 30 THEN om.dep_min ELSE bm.dep_min END FROM bm LEFT JOIN om USING ({ASKED}) UNION ALL SELECT 'recent+kernel+weekday', {ASKED}, CASE WHEN abs((ob.dep_min - bb.dep_min + 720 + 1440) % 1440 - 720) > 30 THEN ob.dep_min ELSE bb.dep_min END FROM bb LEFT JOIN ob USING ({ASKED})),
er AS (SELECT method, n_train, abs((flown - dep_min + 720 + 1440) % 1440 - 720) AS err FROM tg JOIN pd USING ({ASKED}) JOIN nt USING ({ASKED}))"""


@R.add(f"WITH {BACKTEST} SELECT method, CASE WHEN n_train = 1 THEN '1' WHEN n_train <= 4 THEN '2-4' ELSE '5+' END AS support, count(*) AS n, count(*) FILTER (err <= 15) AS within_15, count(*) FILTER (err <= 30) AS within_30, count(*) FILTER (err <= 45) AS within_45, cast(median(err) AS double) AS median_err FROM er GROUP BY ALL", "legs", "airports")
def schedule_backtest(spark, sf):
    """All methods with their median error."""
    return sc.schedule_backtest(lens(spark, sf, "legs"), lens(spark, sf, "airports"), days=14, window=365)


MODAL = """bd AS (SELECT *, counterpart IS NULL AS blind, CASE WHEN counterpart IS NULL THEN NULL WHEN kind = 'dep' THEN split_part(counterpart, ',', 1) ELSE split_part(counterpart, ',', -1) END AS other FROM boards),
bm AS (SELECT flight, airport, kind, other, sched_min FROM (SELECT flight, airport, kind, other, sched_min, count(*) AS n FROM bd GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY flight, airport, kind, other ORDER BY n DESC, sched_min) = 1),
bn AS (SELECT flight, airport, kind, other, count(DISTINCT day) AS n_days FROM bd GROUP BY ALL)"""


@R.add(f"WITH {MODAL} SELECT m.flight, m.airport, m.kind, m.other, m.sched_min, n.n_days FROM bm m JOIN bn n ON m.flight = n.flight AND m.airport = n.airport AND m.kind = n.kind AND m.other IS NOT DISTINCT FROM n.other", "boards")
def board_modal(spark, sf):
    return sc.board_modal_times(lens(spark, sf, "boards")).drop("org", "dst")


@R.add(f"""WITH {FULL}, {MODAL}, ia AS (SELECT iata, max(icao) AS icao FROM airlines WHERE iata IS NOT NULL GROUP BY ALL), dp AS (SELECT flight, airport AS org, other AS dst, sched_min, substr(flight, 1, 2) AS prefix, coalesce(icao, '') AS icao FROM bm LEFT JOIN ia ON iata = substr(flight, 1, 2) WHERE kind = 'dep' AND other IS NOT NULL),
j AS (SELECT flight, org, dst, sched_min, callsign, ltrim(regexp_replace(callsign, '[^0-9]', '', 'g'), '0') = ltrim(regexp_replace(flight, '[^0-9]', '', 'g'), '0') AS same, abs(dep_min - sched_min) AS gap, airline_icao, CASE WHEN icao = '' THEN prefix ELSE icao END AS want FROM dp JOIN sched USING (org, dst) WHERE dep_min IS NOT NULL),
k AS (SELECT *, CASE WHEN same AND gap <= 180 THEN gap - 1000 ELSE gap END AS score FROM j WHERE airline_icao = want)
SELECT flight, org, dst, sched_min, callsign FROM k WHERE score <= 45 QUALIFY row_number() OVER (PARTITION BY flight, org, dst ORDER BY score, callsign) = 1""", "legs", "airports", "boards", "airlines")
def board_match(spark, sf):
    modal = tx.airline_of(sc.board_modal_times(lens(spark, sf, "boards")), lens(spark, sf, "airlines"))
    return sc.match_boards(schedule(spark, sf), modal.where("kind = 'dep' and other is not null"), "dep_min").select("flight", "org", "dst", "sched_min", "callsign")


@R.add("SELECT event_id, hex FROM positions WHERE lat BETWEEN -20 AND 60 AND (lon >= 150 OR lon <= -120)", "positions")
def bbox(spark, sf):
    return lens(spark, sf, "positions").where(geo.in_bbox("lat", "lon", 150, -20, -120, 60)).select("event_id", "hex")


@R.add("WITH d AS (SELECT event_id, 2 * 3440.065 * asin(least(1.0, sqrt(pow(sin((radians(lat) - radians(20)) / 2), 2) + cos(radians(20)) * cos(radians(lat)) * pow(sin(radians(lon - 10) / 2), 2)))) AS nm FROM positions) SELECT event_id, round(nm, 0) AS nm FROM d WHERE nm <= 200", "positions")
def radius(spark, sf):
    near = fl.within_radius(lens(spark, sf, "positions"), 20.0, 10.0, 200)
    exact = geo.haversine(F.lit(20.0), F.lit(10.0), "lat", "lon", geo.EARTH_NM)
    return near.select("event_id", F.round(exact, 0).alias("nm"))


@R.add("WITH p AS (SELECT hex, event_id, lat, lon, floor((((lon + 100) % 360 + 360) % 360) / 2.5) AS x, floor((lat + 50) / 2.5) AS y FROM positions WHERE lat BETWEEN -50 AND 50 AND lon BETWEEN -100 AND 50) SELECT min(hex) AS hex, x, y FROM p GROUP BY x, y", "positions")
def grid_thin(spark, sf):
    out = fl.thin_wide(lens(spark, sf, "positions"), -100.0, -50.0, 50.0, 50.0)
    return out.select("hex", F.floor(F.pmod(F.col("lon") + 100, F.lit(360.0)) / 2.5).cast("double").alias("x"), F.floor((F.col("lat") + 50) / 2.5).cast("double").alias("y"))


_BISECTED = ", ".join(["b0 AS (SELECT 0 AS g0)", *(f"b{i + 1} AS (SELECT g0 + CASE WHEN coalesce(n, 0) <= 300 THEN {128 >> i} ELSE 0 END AS g0 FROM b{i} LEFT JOIN c ON k = g0 + {128 >> i})" for i in range(8))])


@R.add(f"""WITH p AS (SELECT hex, lat, lon FROM positions WHERE lat BETWEEN -30 AND 10 AND lon BETWEEN -40 AND 10), s AS (SELECT cast(k AS int) AS k, sqrt(50.0 * 40.0 / 300) * pow(16.0, -k / 256.0) AS side FROM range(256) t(k)),
g AS (SELECT k, hex, floor((((lon + 40) % 360 + 360) % 360) / side) AS x, floor((lat + 30) / side) AS y FROM p, s), c AS (SELECT k, count(DISTINCT (x, y)) AS n FROM g GROUP BY k),
{_BISECTED}
SELECT min(hex) AS hex, count(*) AS heard FROM g WHERE k = (SELECT g0 FROM b8) AND (SELECT count(*) FROM p) > 300 GROUP BY x, y UNION ALL SELECT hex, 1 FROM p WHERE (SELECT count(*) FROM p) <= 300""", "positions")
def grid_dense(spark, sf):
    """A dense box on the finest grid of which at most 300 cells are occupied, with the reports that each aircraft stands for."""
    p, box = lens(spark, sf, "positions").select("hex", "lat", "lon"), (-40.0, -30.0, 10.0, 10.0)
    shown = fl.thin_to_grid(p, *box, most=300)
    inside = p.where(geo.in_bbox("lat", "lon", *box))
    side = fl.grid_side(inside, *box, most=300).crossJoin(inside.agg(F.count(F.lit(1)).alias("n")))  # one row with one row
    cell = lambda df: df.join(F.broadcast(side)).withColumns({"x": F.floor((F.col("lon") + 40) / F.col("side")), "y": F.floor((F.col("lat") + 30) / F.col("side"))})
    heard = cell(inside).groupBy("x", "y").agg(F.count(F.lit(1)).alias("heard"))
    return cell(shown).join(heard, ["x", "y"]).select("hex", F.when(F.col("n") > 300, F.col("heard")).otherwise(1).alias("heard"))

"""Lenses: projections of the generic test tables onto the library's tables.

A lens is one SELECT in a common subset of SQL, so that the engine and a reference database see the same rows. Only
integer arithmetic is used. `lens_sql(name, dialect)` gives the text; `lens(spark, sf_dir, name)` the DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'"
ZONES = ("UTC", "Europe/Paris", "America/New_York", "Asia/Tokyo", "Australia/Sydney")


def _hex(dialect: str, x: str) -> str:
    return f"lower(lpad({'hex' if dialect == 'spark' else 'to_hex'}({x}), 6, '0'))"


def _epoch(dialect: str, ts: str) -> str:
    return f"unix_timestamp({ts})" if dialect == "spark" else f"cast(floor(epoch({ts})) as bigint)"


def _text(x: str) -> str:
    return f"cast({x} as {{string}})"


def _airline(n: str) -> str:
    return f"concat('A', substr({LETTERS}, cast({n} as int) + 1, 1), 'X')"


def _field(n: str) -> str:
    return f"concat('A', lpad({_text(n)}, 2, '0'))"


def _legs(d: str) -> str:
    dep = f"({_epoch(d, 'l_shipdate')} + (l_partkey * 37 % 1440) * 60)"
    joins = "JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey"
    if d == "spark":  # orders find their customer before the lines come in, so the largest table is shuffled once, not twice
        joins = "JOIN (SELECT o_orderkey, o_custkey, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey) oc ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey"
    took = "300 + (cast(l_quantity as bigint) - 1) * 600 + case when l_linenumber = 5 and l_quantity > 45 then 80000 else 0 end"
    return f"""SELECT {_hex(d, 'l_suppkey')} AS hex, concat('R-', {_text('l_suppkey')}) AS reg, concat('T', {_text('l_partkey % 7')}) AS type,
  concat({_airline('c_nationkey')}, {_text('o_custkey % 50 + 1')}) AS callsign, cast(l_shipdate as date) AS date, {_field('s_nationkey')} AS org,
  case when l_linenumber = 7 then null else {_field('c_nationkey')} end AS dst, {dep} AS dep_ts,
  case when l_linenumber = 6 then null else {dep} + {took} end AS arr_ts, cast(20000 + l_quantity * 400 as int) AS max_alt
FROM lineitem {joins}"""


def _airframes_ref(d: str) -> str:
    return f"""SELECT {_hex(d, 's_suppkey')} AS hex, concat('R-', {_text('s_suppkey')}) AS registration, concat('T', {_text('s_suppkey % 7')}) AS type_code,
  concat('Op ', {_text('s_suppkey % 40')}) AS operator_name, upper(concat('Op ', {_text('s_suppkey % 40')})) AS operator_norm,
  case when s_suppkey % 5 = 4 then null else {_airline('s_nationkey')} end AS operator_icao, cast(1990 + s_suppkey % 30 as int) AS year,
  case when s_suppkey % 9 = 0 then '10' else '00' end AS flags, case s_suppkey % 4 when 0 then 'receiver-dump' when 1 then 'tar1090' when 2 then 'registry' else 'override' end AS source
FROM supplier"""


def _airports(d: str) -> str:
    zone = "case n_nationkey % 5 " + " ".join(f"when {i} then '{z}'" for i, z in enumerate(ZONES)) + " end"
    return f"""SELECT concat('K', {_field('n_nationkey')}) AS ident, {_field('n_nationkey')} AS iata, n_name AS name,
  case when n_nationkey % 3 = 0 then 'large_airport' else 'medium_airport' end AS kind, case when n_nationkey % 7 = 6 then 'general' else 'commercial' end AS role,
  cast(n_nationkey * 6 % 120 - 60 as double) AS lat, cast(n_nationkey * 14 - 170 as double) AS lon, substr(concat('R', {_text('n_regionkey')}), 1, 2) AS iso_country,
  concat('City ', n_name) AS municipality, {zone} AS tz FROM nation"""


def _typed(d: str) -> str:
    """What people might type: names, parts of names and misspellings, codes, numbers as two airlines write them, pairs of
    places in several forms, marks with and without their dash, addresses, an airline with a type."""
    routes = f"(SELECT DISTINCT callsign, org AS a, dst AS b FROM ({_legs(d)}) l WHERE org <> dst)"
    k = "cast(n_nationkey % 6 as int)"
    base = "case when n_nationkey % 2 = 0 then 'NATION' else 'CITY NATION' end"
    parts = [
        "SELECT n_name AS q FROM nation",
        "SELECT substr(n_name, 1, 4) AS q FROM nation",
        "SELECT concat('  city   ', lower(n_name)) AS q FROM nation",
        f"SELECT concat(substr({base}, 1, {k}), substr({base}, {k} + 2)) AS q FROM nation",
        f"SELECT concat(substr({base}, 1, {k}), substr({LETTERS}, cast(n_nationkey as int) + 1, 1), substr({base}, {k} + 2)) AS q FROM nation",
        "SELECT substr('CITY NATION AIR', 1, cast(n_nationkey % 12 + 2 as int)) AS q FROM nation",
        f"SELECT {_airline('n_nationkey')} AS q FROM nation",
        f"SELECT substr({_airline('n_nationkey')}, 1, 2) AS q FROM nation",
        "SELECT concat(n_name, ' Air') AS q FROM nation",
        f"SELECT concat('op ', {_text('n_nationkey')}) AS q FROM nation",
        f"SELECT {_field('n_nationkey')} AS q FROM nation",
        f"SELECT concat('k', {_field('n_nationkey')}) AS q FROM nation",
        f"SELECT concat({_airline('n_nationkey')}, ' T', {_text('n_nationkey % 7')}) AS q FROM nation",
        f"SELECT concat('T', {_text('n_nationkey % 7')}, ' ', {_airline('n_nationkey')}) AS q FROM nation",
        f"SELECT concat('nation to ', {_field('n_nationkey')}) AS q FROM nation",
        f"SELECT concat('R-', {_text('s_suppkey')}) AS q FROM supplier",
        f"SELECT concat('r', {_text('s_suppkey')}) AS q FROM supplier WHERE s_suppkey % 3 = 0",
        f"SELECT {_hex(d, 's_suppkey')} AS q FROM supplier WHERE s_suppkey % 4 = 0",
        f"SELECT concat('NATION', substr({LETTERS}, cast(n_nationkey as int) + 1, 1)) AS q FROM nation",
        f"SELECT concat('NATON', substr({LETTERS}, cast(n_nationkey as int) + 1, 2)) AS q FROM nation",
        f"SELECT concat('Cit', substr({LETTERS}, cast(n_nationkey as int) + 1, 1), 'y') AS q FROM nation",
    ]
    flown = ["callsign", "concat(substr(callsign, 1, 2), ' ', substr(callsign, 4))", "concat(a, ' ', b)", "concat('from ', a, ' to ', b)", "concat(a, '-', b)"]
    if d == "spark":  # the routes of the whole log are worked out once for all five
        parts.append(f"SELECT explode(array({', '.join(flown)})) AS q FROM {routes} r")
    else:
        parts += [f"SELECT {q} AS q FROM {routes} r{i}" for i, q in enumerate(flown, 1)]
    return f"SELECT DISTINCT q FROM ({' UNION ALL '.join(parts)}) u"


def _crossings(d: str) -> str:
    """Aircraft that cross an ocean again and again at an even pace, eight hours a crossing: the Atlantic westward or
    eastward, or the Pacific eastward; seen when an event says so."""
    t = _epoch(d, "ts")
    way = f"cast({t} % 28800 * 80 as double) / 28800"
    wide = f"cast({t} % 28800 * 100 as double) / 28800"
    lon = f"case user_id % 4 when 0 then 5.0 - {way} when 1 then {way} - 75.0 else case when {wide} > 40 then {wide} - 220.0 else {wide} + 140.0 end end"
    return f"""SELECT {_hex(d, 'user_id')} AS hex, cast({t} as double) AS t, cast(45 + user_id % 20 as double) AS lat, {lon} AS lon, cast(24000 + event_id % 9 * 2000 as int) AS alt_ft, false AS on_ground,
  cast(380 + event_id * 17 % 150 as double) AS gs, case when user_id % 4 = 0 then 270.0 else 90.0 end AS track, concat({_airline('user_id % 25')}, {_text('user_id % 50 + 1')}) AS callsign, event_id FROM events"""


def _ocean_tracks(d: str) -> str:
    """Published tracks over the Atlantic, each straight from 70 west to the meridian, for half a day. The path is told by
    its latitude in the west."""
    first = _epoch(d, "(SELECT min(ts) FROM events)")
    return f"""SELECT s_suppkey AS id, cast({first} as double) + s_suppkey * 7200 % 2592000 AS valid_from, cast({first} as double) + s_suppkey * 7200 % 2592000 + 43200 AS valid_to,
  case when s_suppkey % 2 = 0 then 'W' else 'E' end AS direction, cast(300 + s_suppkey % 4 * 20 as int) AS low, cast(340 + s_suppkey % 4 * 20 as int) AS high, cast(45 + s_suppkey % 20 as double) - 0.4 AS lat70 FROM supplier"""


LENSES = {
    "crossings": _crossings,
    "ocean_tracks": _ocean_tracks,
    "legs": _legs,
    "airframes_ref": _airframes_ref,
    "airports": _airports,
    "airlines": lambda d: f"SELECT {_airline('n_nationkey')} AS icao, case when n_nationkey % 6 = 5 then null else substr({_airline('n_nationkey')}, 1, 2) end AS iata, case when n_nationkey % 4 = 0 then concat('Op ', {_text('n_nationkey')}) else concat(n_name, ' Air') end AS name FROM nation",
    # answers to the questions of the flight log itself: both ends of legs flown under the same number, right or wrong
    "answers": lambda d: "SELECT 1000000000 + min(k) AS id, callsign, org AS origin, dst AS dest, 'pending' AS status, cast(min(k) % 3 as int) AS anonymous_count, cast(min(date) as date) AS valid_from FROM (" + _legs(d).replace("SELECT ", "SELECT cast((c_nationkey * 50 + o_custkey % 50) * 25 + s_nationkey as bigint) AS k, ", 1) + ") l WHERE dst IS NOT NULL GROUP BY callsign, org, dst",
    "shuttles": lambda d: f"SELECT hex, reg, type, concat(substr(callsign, 1, 3), '1') AS callsign, date, org, dst, dep_ts, arr_ts, max_alt FROM ({_legs(d)}) l",
    "memberships": lambda d: f"SELECT {_text('n_regionkey')} AS slug, {_airline('n_nationkey')} AS airline_icao, case when n_nationkey % 5 = 3 then 'affiliate' else 'member' end AS relationship, case when n_nationkey % 8 = 7 then 'former' else 'active' end AS status FROM nation",
    "routes": lambda d: f"SELECT DISTINCT callsign, org AS a, dst AS b FROM ({_legs(d)}) l WHERE org <> dst",
    "typed": _typed,
    # services of up to seven legs that fly on from where they landed, some with a jump in between
    "tours": lambda d: f"SELECT concat('TOX', {_text('l_orderkey')}) AS callsign, {_field('(l_orderkey * 7 + l_linenumber) % 25')} AS org, {_field('(l_orderkey * 7 + l_linenumber + case when l_quantity > 45 then 1 + l_linenumber else 1 end) % 25')} AS dst, cast(l_quantity as bigint) AS n_flights FROM lineitem",
    "boards": lambda d: f"""SELECT {_field('o_custkey % 25')} AS airport, case when o_orderkey % 2 = 0 then 'dep' else 'arr' end AS kind,
  concat(substr({_airline('o_orderkey % 25')}, 1, 2), {_text('o_custkey % 50 + 1')}) AS flight, case when o_orderkey % 11 = 0 then null else concat({_field('o_orderkey % 25')}, case when o_orderkey % 5 = 0 then ',A03' else '' end) end AS counterpart,
  cast(o_orderkey * 13 % 1440 - o_orderkey * 13 % 60 as int) AS sched_min, cast(o_orderdate as date) AS day FROM orders""",
    "positions": lambda d: f"""SELECT event_id, {_hex(d, 'user_id')} AS hex, ts, cast(event_id * 37 % 1600 as double) / 10 - 80 AS lat, cast(event_id * 91 % 3600 as double) / 10 - 180 AS lon,
  case when event_type = 'error' then case when user_id % 5 = 0 then '7500' else '7700' end end AS squawk, cast(event_id * 53 % 420 * 100 as int) AS alt_ft, event_id % 13 = 0 AS on_ground,
  cast(200 + event_id * 17 % 350 as double) AS gs, cast(event_id * 29 % 360 as double) AS track, concat({_airline('user_id % 25')}, {_text('user_id % 50 + 1')}) AS flight, {_epoch(d, 'ts')} AS t FROM events""",
    "spells": lambda d: "SELECT o_custkey AS airframe_id, case o_orderstatus when 'F' then 'hex' when 'O' then 'operator' else 'registration' end AS kind, o_orderpriority AS value, cast(min(o_orderdate) as date) AS first_date, cast(max(o_orderdate) as date) AS last_date, count(*) AS n_obs FROM orders GROUP BY o_custkey, case o_orderstatus when 'F' then 'hex' when 'O' then 'operator' else 'registration' end, o_orderpriority",
    "claims": lambda d: f"SELECT o_orderkey AS id, concat({_airline('o_custkey % 25')}, {_text('o_custkey % 50 + 1')}) AS callsign, {_field('o_custkey % 25')} AS origin, {_field('o_orderkey % 25')} AS dest, case o_orderstatus when 'F' then 'approved' when 'O' then 'pending' else 'rejected' end AS status, cast(o_orderkey % 3 as int) AS anonymous_count, o_orderdate AS reviewed_at, cast(o_orderdate as date) AS valid_from FROM orders",
    "endorsements": lambda d: f"SELECT l_orderkey AS claim_id, case when l_linenumber % 3 = 0 then null else concat('h', {_text('l_suppkey % 97')}) end AS handle, case l_linenumber % 4 when 1 then 'timetable' when 2 then concat('k', {_text('l_suppkey % 7')}) end AS key_name FROM lineitem",
}


def lens_sql(name: str, dialect: str = "spark") -> str:
    return LENSES[name](dialect).replace("{string}", "string" if dialect == "spark" else "varchar")


def lens(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The lens over the tables of a folder, without views in the session's catalog."""
    sql = lens_sql(name)
    used = {t: spark.read.parquet(f"{sf_dir.rstrip('/')}/{t}.parquet") for t in TABLES if f" {t}" in sql}
    for t in used:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t} ", f"JOIN {{{t}}} ")
    return spark.sql(sql, **used)


def with_lenses(query: str, *names: str) -> str:
    """A reference query with its lenses as leading common table expressions."""
    ctes = ",\n".join(f"{n} AS ({lens_sql(n, 'duckdb')})" for n in names)
    head = query.lstrip()
    if head[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes}, {head[15:]}"
    return f"WITH {ctes}, {head[5:]}" if head[:5].upper() == "WITH " else f"WITH {ctes}\n{head}"

"""Readers of the receivers' artifacts. Each takes a path any Spark file system can open and returns the canonical table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aerolith import schemas
from aerolith.functions import text as tx


def _document(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """One JSON document a file (gzip by its name) as a struct column `d`."""
    return spark.read.text(path, wholetext=True).select(F.from_json("value", ddl).alias("d"))


def _map_entries(spark: SparkSession, path: str, value: str) -> DataFrame:
    """(k, v) of a JSON object whose values may be malformed: each is parsed on its own, null if it does not fit."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"))
    return raw.select(F.explode("m").alias("k", "raw")).select("k", F.from_json("raw", value).alias("v"))


def read_legs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The flight log and its meta(key, value): Parquet folders `legs` (by date) and `meta`."""
    legs = spark.read.schema(schemas.LEGS).parquet(f"{path}/legs")
    return legs, spark.read.schema("key string, value string").parquet(f"{path}/meta")


def import_legs(spark: SparkSession, url: str, path: str, *, table: str = "legs", partitions: int = 64, driver: str = "org.sqlite.JDBC") -> None:
    """One-off import of a relational flight log through JDBC, split on the row id."""
    bounds = spark.read.format("jdbc").options(url=url, driver=driver, query=f"SELECT min(rowid) lo, max(rowid) hi FROM {table}").load().first()
    options = {"url": url, "driver": driver, "dbtable": f"(SELECT rowid AS rid, * FROM {table}) t", "partitionColumn": "rid", "lowerBound": str(bounds["lo"]), "upperBound": str(bounds["hi"]), "numPartitions": str(partitions)}
    rows = spark.read.format("jdbc").options(**options).load()
    rows.select(*[F.col(f.name).cast(f.dataType) for f in schemas.struct(schemas.LEGS)]).write.partitionBy("date").mode("overwrite").parquet(f"{path}/legs")


def archive_through(legs: DataFrame) -> DataFrame:
    """The newest day the log holds."""
    return legs.agg(F.max("date").alias("through"))


def read_routes(spark: SparkSession, path: str) -> DataFrame:
    """{callsign: [code, ...]}: callsigns trimmed, upper, up to 12 characters; chains of two or more."""
    rows = _map_entries(spark, path, "array<string>")
    return rows.select(F.substring(F.upper(F.trim("k")), 1, 12).alias("callsign"), F.col("v").alias("chain")).where("size(chain) >= 2 and callsign <> ''")


def read_gaps(spark: SparkSession, path: str) -> DataFrame:
    """{callsign: {...}}: open questions; only flight numbers."""
    value = "side string, known string, hint string, chain array<string>, type string, n_recent int, last_seen string, last_lat double, last_lon double, last_trk double, est_km double, n_rot int, known_ts array<long>"
    return _map_entries(spark, path, value).select(F.upper(F.trim("k")).alias("callsign"), "v.*").where(tx.is_flight_number("callsign"))


def read_boards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.BOARDS).parquet(path)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """`hex;reg;type;flags;desc;year;operator` lines; short lines and bad addresses go."""
    f = F.split("value", ";")
    at = lambda i, n: tx.clean(f[i], n)
    rows = spark.read.text(path).where((F.size(f) >= 7) & (F.length(F.trim(f[0])) == 6))
    year = F.when(F.trim(f[5]).rlike(r"^\d+$"), F.trim(f[5]).try_cast("int"))
    return rows.select(F.lower(F.trim(f[0])).alias("hex"), at(1, 12).alias("registration"), at(2, 8).alias("type_code"), at(6, 80).alias("operator_name"), F.upper(at(6, 80)).alias("operator_norm"), F.lit(None).cast("string").alias("operator_icao"), year.alias("year"), at(3, 8).alias("flags"))


def read_observed_airframes(spark: SparkSession, path: str) -> DataFrame:
    """{hex: [type, reg, operator]}, missing cells null."""
    v = lambda i, n: tx.clean(F.try_element_at("v", F.lit(i)), n)
    rows = _map_entries(spark, path, "array<string>").where(F.length("k") == 6)
    none = lambda kind: F.lit(None).cast(kind)
    return rows.select(F.lower("k").alias("hex"), v(2, 12).alias("registration"), v(1, 8).alias("type_code"), none("string").alias("operator_name"), none("string").alias("operator_norm"), v(3, 3).alias("operator_icao"), none("int").alias("year"), none("string").alias("flags"))


def read_airports(spark: SparkSession, path: str) -> DataFrame:
    """Airport CSV with a header; coordinates are both there or both null; role derived."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    lat, lon = F.col("latitude_deg").try_cast("double"), F.col("longitude_deg").try_cast("double")
    both = lat.isNotNull() & lon.isNotNull()
    iata = tx.clean("iata_code", 3) if "iata_code" in raw.columns else F.lit(None).cast("string")
    return raw.select(F.upper(tx.clean("ident", 8)).alias("ident"), iata.alias("iata"), tx.clean("name", 120).alias("name"), tx.clean("type", 24).alias("kind"), tx.airport_role("type", "scheduled_service", "name").alias("role"), F.when(both, lat).alias("lat"), F.when(both, lon).alias("lon"), tx.clean("iso_country", 2).alias("iso_country"), tx.clean("municipality", 80).alias("municipality"), F.lit(None).cast("string").alias("tz")).where("ident is not null")


def read_seed(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(airlines, types) of a seed document."""
    doc = _document(spark, path, "airlines map<string,struct<name:string,iata:string,palette:array<string>>>, types map<string,struct<name:string,category:string>>")
    a = doc.select(F.explode("d.airlines").alias("k", "v")).select(tx.clean("k", 3).alias("icao"), tx.clean("v.iata", 2).alias("iata"), tx.clean("v.name", 120).alias("name"), F.coalesce("v.palette", F.array().cast("array<string>")).alias("palette"))
    t = doc.select(F.explode("d.types").alias("k", "v")).select(tx.clean("k", 8).alias("designator"), tx.clean("v.name", 120).alias("name"), tx.clean("v.category", 24).alias("category"))
    return a, t


def read_airline_names(spark: SparkSession, path: str, icao: str = "ICAO", iata: str = "IATA", name: str = "Name") -> DataFrame:
    """Airline names CSV; the last line of a code wins; codes of three letters with a name."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    raw = raw.toDF(*[c.lstrip("﻿").strip() for c in raw.columns]).withColumn("_at", F.monotonically_increasing_id())
    code, two = F.upper(F.trim(icao)), F.upper(F.trim(iata))
    rows = raw.select(code.alias("icao"), F.when(two.rlike("^[A-Z0-9]{2}$"), two).alias("iata"), tx.clean(name, 120).alias("name"), "_at").where("icao rlike '^[A-Z]{3}$' and name is not null")
    return rows.groupBy("icao").agg(F.max_by("iata", "_at").alias("iata"), F.max_by("name", "_at").alias("name"))


MEMBERSHIP = "array<struct<airline_icao:string,airline_name:string,airline_iata:string,relationship:string,status:string,sponsor_icao:string,effective_from:string,effective_to:string,source_url:string,source_checked_at:string,note:string>>"


def read_alliances(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(alliances, memberships) of a roster snapshot, as written; see `validate_alliances`."""
    doc = _document(spark, path, f"schema_version int, as_of string, alliances array<struct<slug:string,name:string,website_url:string,source_url:string,source_checked_at:string,memberships:{MEMBERSHIP}>>")
    each = doc.select("d.schema_version", F.try_to_date("d.as_of", "yyyy-MM-dd").alias("as_of"), F.explode_outer("d.alliances").alias("a"))
    slug = F.lower(F.trim("a.slug"))
    alliances = each.select("schema_version", "as_of", slug.alias("slug"), tx.clean("a.name", 48).alias("name"), tx.clean("a.website_url", 255).alias("website_url"), tx.clean("a.source_url", 255).alias("source_url"), F.try_to_date(F.coalesce("a.source_checked_at", F.col("as_of").cast("string")), "yyyy-MM-dd").alias("source_checked_at"), F.coalesce(F.size("a.memberships"), F.lit(0)).alias("n_rows"))
    m = each.select(slug.alias("slug"), F.explode("a.memberships").alias("m"))
    code = lambda c: F.nullif(F.upper(F.trim(c)), F.lit(""))
    members = m.select("slug", code("m.airline_icao").alias("airline_icao"), code("m.airline_iata").alias("iata"), tx.clean("m.airline_name", 120).alias("name"), F.coalesce(F.trim("m.relationship"), F.lit("member")).alias("relationship"), F.coalesce(F.trim("m.status"), F.lit("active")).alias("status"), code("m.sponsor_icao").alias("sponsor_icao"), F.col("m.effective_from").alias("from_text"), F.try_to_date("m.effective_from", "yyyy-MM-dd").alias("effective_from"), F.col("m.effective_to").alias("to_text"), F.try_to_date("m.effective_to", "yyyy-MM-dd").alias("effective_to"), tx.clean("m.note", 240).alias("note"))
    return alliances, members


def validate_alliances(alliances: DataFrame, members: DataFrame) -> DataFrame:
    """(rule, slug, airline_icao) of everything the roster's rules forbid; empty for a good one."""
    row = lambda df, rule, who="airline_icao": df.select(F.lit(rule).alias("rule"), "slug", (F.col(who) if who in df.columns else F.lit(None).cast("string")).alias("airline_icao"))
    not_ = lambda c: ~F.coalesce(c, F.lit(False))
    bad = [
        row(alliances.where("schema_version is distinct from 1 or as_of is null"), "version or date"),
        row(alliances.where(not_(F.col("slug").rlike("^[a-z0-9]+(-[a-z0-9]+)*$"))), "slug"),
        row(alliances.groupBy("slug").count().where("count > 1"), "duplicate slug"),
        row(alliances.where("name is null or website_url is null or source_url is null"), "missing name or source"),
        row(alliances.where("source_checked_at is null or source_checked_at > as_of"), "checked date"),
        row(alliances.where("n_rows = 0"), "no memberships"),
        row(members.where(not_(F.col("airline_icao").rlike("^[A-Z]{3}$")) | F.col("name").isNull()), "airline"),
        row(members.where("iata is not null and not iata rlike '^[A-Z0-9]{2}$'"), "IATA code"),
        row(members.where("relationship not in ('member', 'group-brand', 'affiliate')"), "relationship"),
        row(members.where("status not in ('active', 'future', 'suspended', 'former')"), "status"),
        row(members.where("(relationship = 'member') = (sponsor_icao is not null)"), "sponsor given"),
        row(members.where("(from_text <> '' and effective_from is null) or (to_text <> '' and effective_to is null) or effective_to < effective_from"), "dates"),
        row(members.groupBy("slug", "airline_icao", "relationship", "status", "effective_from", "effective_to").count().where("count > 1"), "duplicate row"),
    ]
    direct = members.where("status = 'active' and relationship = 'member'").select("slug", "airline_icao").distinct()
    bad.append(direct.groupBy("airline_icao").agg(F.count("slug").alias("n"), F.min("slug").alias("slug")).where("n > 1").select(F.lit("two alliances").alias("rule"), "slug", "airline_icao"))
    sponsored = members.where("relationship <> 'member' and sponsor_icao is not null")
    bad.append(row(sponsored.join(direct.withColumnRenamed("airline_icao", "sponsor_icao"), ["slug", "sponsor_icao"], "left_anti"), "sponsor"))
    out = bad[0]
    for b in bad[1:]:
        out = out.unionByName(b)
    return out


HISTORY = "struct<first:string,last:string,n:long,type:string,regs:array<array<string>>,ops:array<array<string>>,gaps:array<array<string>>>"


def read_airframe_history(spark: SparkSession, path: str) -> DataFrame:
    """One row per hex: evidence_from, first, last, n, regs/ops as arrays of spells, gaps."""
    doc = _document(spark, path, f"evidence_from string, airframes map<string,{HISTORY}>")
    rows = doc.select(F.to_date("d.evidence_from").alias("evidence_from"), F.explode("d.airframes").alias("k", "v")).where(F.length("k") == 6)
    spell = lambda c: F.transform(c, lambda s: F.struct(s[0].alias("value"), F.to_date(s[1]).alias("first_date"), F.to_date(s[2]).alias("last_date"), s[3].cast("long").alias("n_obs")))
    gap = F.transform("v.gaps", lambda g: F.struct(F.to_date(g[0]).alias("last_seen"), F.to_date(g[1]).alias("seen_again")))
    return rows.select(F.lower("k").alias("hex"), "evidence_from", F.to_date("v.first").alias("first_date"), F.to_date("v.last").alias("last_date"), F.col("v.n").alias("n_obs"), F.col("v.type").alias("type"), spell("v.regs").alias("regs"), spell("v.ops").alias("ops"), gap.alias("gaps"))


def _trimmed_csv(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    names = [c.lstrip("﻿").strip() for c in raw.columns]
    raw = raw.toDF(*names)
    return raw.select(*[F.trim(F.col(f"`{c}`")).alias(c) for c in names if c])


def read_us_registry(spark: SparkSession, master: str, acftref: str, engine: str) -> DataFrame:
    """Master file with maker, model and engine; owners only of companies and governments (registrant kinds 3, 5, 7, 8)."""
    m = _trimmed_csv(spark, master)
    a = _trimmed_csv(spark, acftref).select(F.col("CODE").alias("_a"), F.col("MFR").alias("manufacturer"), F.col("MODEL").alias("model"))
    e = _trimmed_csv(spark, engine).select(F.col("CODE").alias("_e"), F.concat_ws(" ", "MFR", "MODEL").alias("engine"))
    owner = F.when(F.col("TYPE REGISTRANT").isin("3", "5", "7", "8"), tx.clean("NAME", 80))
    joined = m.join(a, m["MFR MDL CODE"] == a["_a"], "left").join(e, m["ENG MFR MDL"] == e["_e"], "left")
    return joined.select(F.lower("MODE S CODE HEX").alias("hex"), F.concat(F.lit("N"), F.col("N-NUMBER")).alias("registration"), "manufacturer", "model", F.col("SERIAL NUMBER").alias("msn"), tx.parse_year("YEAR MFR").alias("built_year"), "engine", owner.alias("owner"), tx.parse_date8("CERT ISSUE DATE").alias("cert_date"), tx.parse_date8("AIR WORTH DATE").alias("airworthy_date"), tx.parse_date8("EXPIRATION DATE").alias("expires")).where(tx.is_hex24("hex"))


def read_occurrences(occurrence: DataFrame, events: DataFrame, aircraft: DataFrame, since: str = "1993-01-01") -> DataFrame:
    """Occurrences with their distinct event names in order and the aircraft in them, from a date on.

    occurrence(number, date, time, ...), events(number, seq, event), aircraft(number, domestic, foreign, ...)."""
    firsts = events.groupBy("number", "event").agg(F.min("seq").alias("seq"))
    names = firsts.groupBy("number").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "event"))), lambda s: s["event"]).alias("events"))
    marks = aircraft.withColumn("registration", tx.occurrence_registration("domestic", "foreign")).where("registration <> ''")
    dated = occurrence.withColumn("at", tx.occurrence_when("date", "time")).where(F.col("at") >= F.lit(since).cast("timestamp"))
    return dated.join(marks, "number").join(names, "number", "left")


def alt_columns(raw: Column) -> tuple[Column, Column]:
    """A number or the word "ground" as (alt_ft, on_ground)."""
    text = F.trim(raw.cast("string"), F.lit('"'))
    return text.try_cast("double").cast("int"), F.coalesce(text == "ground", F.lit(False))


LINE = "hex string, flight string, t string, r string, lat double, lon double, alt_baro string, gs double, track double, category string, squawk string, seen double, seen_pos double, baro_rate double, emergency string"


def positions_of(lines: DataFrame, at: Column) -> DataFrame:
    """Canonical positions of a struct column `a` with the public fields; `at` is the instant of the report."""
    alt, ground = alt_columns(F.col("a.alt_baro"))
    keep = [F.col(f"a.{c}").alias(c) for c in ("t", "r", "lat", "lon")]
    rest = [F.col(f"a.{c}").alias(c) for c in ("gs", "track", "category", "squawk", "seen", "seen_pos", "baro_rate", "emergency")]
    return lines.select(F.lower("a.hex").alias("hex"), F.nullif(F.trim("a.flight"), F.lit("")).alias("flight"), *keep, alt.alias("alt_ft"), ground.alias("on_ground"), *rest, at.alias("ts")).where("hex is not null")


def read_snapshot(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """An aircraft snapshot document as positions; only public fields are ever parsed. `most` is the snapshot's cap."""
    doc = _document(spark, path, f"now double, aircraft array<struct<{', '.join(x.replace(' ', ':', 1) for x in LINE.split(', '))}>>")
    now = F.coalesce(F.timestamp_seconds(F.col("d.now")), F.current_timestamp())
    each = doc.select(now.alias("now"), F.posexplode("d.aircraft").alias("pos", "a"))
    return positions_of(each if most is None else each.where(F.col("pos") < most), F.col("now"))


def read_point_source(df: DataFrame) -> DataFrame:
    """A v2 envelope: aircraft under `ac` or `aircraft`; `now` in seconds or milliseconds."""
    parts = [F.col(c) for c in ("ac", "aircraft") if c in df.columns]
    now = F.when(F.col("now") > 1e12, F.col("now") / 1000).otherwise(F.col("now"))
    return df.select(F.coalesce(*parts).alias("aircraft"), now.alias("now"))


def stream_positions(spark: SparkSession, fmt: str, options: dict[str, str], value: str = "value") -> DataFrame:
    """Positions of a stream with one JSON object a line (text files, socket, Kafka); lines that are none are dropped.

    `ts` is the arrival time, as lines are stamped when they are read."""
    raw = spark.readStream.format(fmt).options(**options).load().select(F.col(value).cast("string").alias("line"))
    return parse_lines(raw, F.current_timestamp())


def parse_lines(raw: DataFrame, at: Column) -> DataFrame:
    return positions_of(raw.select(F.from_json("line", LINE).alias("a"), at.alias("_at")).where("a.hex is not null"), F.col("_at"))


def read_presence(spark: SparkSession, path: str) -> DataFrame:
    """Connected stations; the address column is never selected; short rows and anonymous ones go."""
    rows = _document(spark, path, "clients array<array<string>>").select(F.explode("d.clients").alias("c")).where(F.size("c") >= 9)
    at = lambda i: F.col("c")[i]
    out = rows.select(at(0).alias("uuid"), *[at(i).try_cast("double").alias(n) for i, n in ((2, "kbit_s"), (3, "conn_time_s"), (4, "msgs_per_s"), (5, "positions_per_s"), (7, "rtt_ms"))], at(8).try_cast("long").alias("positions_total"))
    return out.where(~tx.is_anonymous("uuid"))


def read_receivers(spark: SparkSession, path: str) -> DataFrame:
    """(half_id, lat, lon) of receivers with a good extent."""
    rows = _document(spark, path, "receivers array<array<string>>").select(F.explode("d.receivers").alias("r")).where(F.size("r") >= 10)
    bad = F.coalesce(F.lower(F.col("r")[7]).isin("true", "1"), F.lit(False))
    half = F.substring(F.regexp_replace(F.lower(F.trim(F.col("r")[0])), "-", ""), 1, 16)
    return rows.where(~bad).select(half.alias("half_id"), F.col("r")[8].try_cast("double").alias("lat"), F.col("r")[9].try_cast("double").alias("lon")).where("lat is not null and lon is not null")


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """Points of trace documents: absolute time, the callsign carried forward, null positions dropped."""
    doc = _document(spark, path, "icao string, timestamp double, trace array<array<string>>")
    each = doc.select(F.lower("d.icao").alias("hex"), F.col("d.timestamp").alias("t0"), F.posexplode("d.trace").alias("pos", "p"))
    alt, ground = alt_columns(F.col("p")[3])
    num = lambda i: F.try_element_at("p", F.lit(i + 1)).try_cast("double")
    flight = F.nullif(F.trim(F.get_json_object(F.try_element_at("p", F.lit(9)), "$.flight")), F.lit(""))
    w = Window.partitionBy("hex", "t0").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = each.select("hex", "t0", "pos", (F.col("t0") + num(0)).alias("t"), num(1).alias("lat"), num(2).alias("lon"), alt.alias("alt_ft"), ground.alias("on_ground"), num(4).alias("gs"), num(5).alias("track"), flight.alias("f"))
    return rows.withColumn("callsign", F.last("f", ignorenulls=True).over(w)).where("t is not null and lat is not null and lon is not null").drop("t0", "pos", "f")


def read_submissions_since(df: DataFrame, cursor: int) -> tuple[DataFrame, DataFrame]:
    """(new submissions, next cursor)."""
    new = df.where(F.col("id") > cursor)
    return new, new.agg(F.coalesce(F.max("id"), F.lit(cursor)).alias("cursor"))


def validate_submissions(subs: DataFrame, gaps: DataFrame, airports: DataFrame, day_ceiling: int = 2000) -> DataFrame:
    """Submissions with the reason they are refused (null if accepted) and the answer's two ends.

    airports(code, role, main): every code of an airport with the code it goes by."""
    s = subs.withColumns({"callsign": F.upper(tx.clean("callsign", 12)), "origin": F.upper(tx.clean("origin", 4)), "dest": F.upper(tx.clean("dest", 4)), "note": tx.clean("note", 280), "handle": tx.clean("handle", 40), "valid_from": F.when(F.col("valid_from").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.col("valid_from"))})
    g = gaps.select("callsign", F.col("side").alias("g_side"), F.col("known").alias("g_known"))
    to_dest = F.col("g_side") == "dest"
    j = s.join(g, "callsign", "left").withColumns({"missing": F.when(to_dest, F.col("dest")).otherwise(F.col("origin")), "given": F.when(to_dest, F.col("origin")).otherwise(F.col("dest"))})
    j = j.join(airports.select(F.col("code").alias("missing"), F.col("role").alias("a_role"), F.col("main").alias("a_code")), "missing", "left")
    busy = Window.partitionBy(F.to_date("received_at"))
    code = lambda c: F.coalesce(~F.col(c).rlike("^[A-Z]{3,4}$"), F.lit(False))
    refusal = (
        F.when(~tx.is_flight_number("callsign"), "callsign must be a flight number")
        .when(code("origin") | code("dest"), "airport codes are 3 or 4 letters")
        .when(F.col("g_known").isNull(), "no open question")
        .when(F.col("missing").isNull(), "the missing end is required")
        .when(F.col("given") != F.col("g_known"), "the known end differs")
        .when(F.coalesce(F.col("a_role") != "commercial", F.lit(True)), "not a commercial airport")
        .when(F.col("a_code") == F.col("g_known"), "the ends are the same")
    )
    j = j.withColumn("refusal", refusal)
    rank = F.count(F.when(F.col("refusal").isNull(), 1)).over(busy.orderBy("received_at", "id").rowsBetween(Window.unboundedPreceding, 0))
    j = j.withColumn("refusal", F.coalesce("refusal", F.when(rank > day_ceiling, "too many answers today")))
    ends = {"origin": F.when(to_dest, F.col("g_known")).otherwise(F.col("a_code")), "dest": F.when(to_dest, F.col("a_code")).otherwise(F.col("g_known"))}
    return j.withColumns({k: F.when(F.col("refusal").isNull(), v).otherwise(F.col(k)) for k, v in ends.items()}).drop("g_side", "g_known", "missing", "given", "a_role", "a_code")


def read_search_tables(spark: SparkSession, path: str) -> DataFrame:
    """name, alternates, codes of a tab-separated table; # starts a comment line."""
    f = F.split("value", "\t")
    part = lambda i: F.coalesce(F.try_element_at(f, F.lit(i)), F.lit(""))
    items = lambda c, by: F.filter(F.transform(F.split(c, by), lambda s: F.trim(s)), lambda s: s != "")
    return spark.read.text(path).where("trim(value) <> '' and not value like '#%'").select(F.trim(part(1)).alias("name"), items(part(2), ",").alias("alternates"), items(part(3), r"\s+").alias("codes"))

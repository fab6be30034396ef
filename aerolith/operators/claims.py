"""Crowd-sourced answers: candidates, checks, verdicts and the transitions of claims, all as set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolith.functions import geo
from aerolith.functions import text as tx
from aerolith.functions import timeutil as tu
from aerolith.operators.aggregates import airport_codes, served_by_airline, voices
from aerolith.operators.registry import catalog_current
from aerolith.operators.windows import top_k, ranked_overall

# Fixed values of the checks.
CORRIDOR_DEG, ROTATION_TOLERANCE, ROTATION_FLOOR_KM, MIN_ROTATIONS = 45, 0.25, 400, 2
SUGGESTIONS, MAX_OPEN, PURGE_DAYS = 3, 3, 90
CLOCK_TOLERANCE_MIN, CLOCK_MIN_SEEN = 45, 3
LOG_MIN_FLIGHTS, LOG_ELSEWHERE_FLIGHTS, LOG_RECENT_DAYS = 2, 10, 90
HARD = ("asked", "known_end", "not_same", "airport", "type")
SOFT = ("corridor", "rotation", "mirror", "observation", "unique", "log", "timetable", "clock")
TIMETABLE_KEY, GUESS_KEY = "timetable", "evidence"


def outcome(passes: Column, applies: Column | None = None) -> Column:
    """pass, fail, or skip where the check does not apply."""
    verdict = F.when(F.coalesce(passes, F.lit(False)), "pass").otherwise("fail")
    return verdict if applies is None else F.when(F.coalesce(applies, F.lit(False)), verdict).otherwise("skip")


def ring_tolerance(est: str = "est_km") -> Column:
    return F.greatest(F.lit(float(ROTATION_FLOOR_KM)), ROTATION_TOLERANCE * F.col(est))


def gap_candidates(gaps: DataFrame, airports: DataFrame, served_by: DataFrame, k: int = SUGGESTIONS, band_deg: float = 4.0) -> DataFrame:
    """Airports that the evidence allows for each gap's missing end, best first.

    In the ring that the rotation implies, within the type's range, along the last track, not the known end or a stop
    already flown. The ring's latitudes become bands, so gaps and airports meet by band and not all against all."""
    spot = airport_codes(airports).select("code", "lat", "lon")
    g = gaps.where((F.col("est_km") > 0) & (F.coalesce("n_rot", F.lit(0)) >= MIN_ROTATIONS))
    g = g.join(spot.select(F.col("code").alias("known"), F.col("lat").alias("k_lat"), F.col("lon").alias("k_lon")), "known").where("k_lat is not null")
    reach_deg = (F.col("est_km") + ring_tolerance()) / 111
    band = lambda x: F.floor((x + 90) / band_deg)
    g = g.withColumn("_b", F.explode(F.sequence(band(F.greatest(F.col("k_lat") - reach_deg, F.lit(-90.0))), band(F.least(F.col("k_lat") + reach_deg, F.lit(90.0))))))
    a = airports.where("role = 'commercial' and lat is not null").select(F.coalesce("iata", "ident").alias("code"), "lat", "lon", band(F.col("lat")).alias("_b"))
    km = geo.haversine("k_lat", "k_lon", "lat", "lon", geo.EARTH_KM_ROUND)
    j = g.join(a, "_b").withColumn("km", km)
    stops = F.concat(F.array("known"), F.coalesce("chain", F.array().cast("array<string>")))
    heading = (F.col("side") == "dest") & F.col("last_lat").isNotNull() & F.col("last_lon").isNotNull() & F.col("last_trk").isNotNull()
    off = geo.angle_between(geo.bearing("last_lat", "last_lon", "lat", "lon"), "last_trk")
    j = j.where(~F.array_contains(stops, F.col("code")) & (F.abs(F.col("lat") - F.col("k_lat")) * 111 <= F.col("est_km") + ring_tolerance()) & (F.abs(F.col("km") - F.col("est_km")) <= ring_tolerance()))
    j = j.where((F.col("km") <= F.coalesce(tx.type_range_km("type"), F.lit(10**9))) & (~heading | (off <= CORRIDOR_DEG)))
    served = served_by.select(F.col("airline").alias("_al"), F.col("code").alias("_c"), "n_routes")
    j = j.join(served, (F.substring("callsign", 1, 3) == F.col("_al")) & (F.col("code") == F.col("_c")), "left").withColumn("n_routes", F.coalesce("n_routes", F.lit(0)))
    j = j.withColumn("ring_err", F.abs(F.col("km") - F.col("est_km"))).dropDuplicates(["callsign", "code"])
    return top_k(j, ["callsign"], [F.desc("n_routes"), F.col("ring_err"), F.col("code")], k).select("callsign", "code", "rank", "km", "ring_err", "n_routes")


def unique_candidate(candidates: DataFrame) -> DataFrame:
    """(callsign, sole): the one candidate (of up to 50) that the airline is known to serve."""
    n = candidates.where("n_routes > 0").groupBy("callsign").agg(F.count(F.lit(1)).alias("n"), F.min("code").alias("sole"))
    return n.where("n = 1").select("callsign", "sole")


def mirror_gaps(gaps: DataFrame) -> DataFrame:
    """(callsign, n, other): the numbers one below and one above that ask for the other side of the same known end."""
    o = gaps.select(F.col("callsign").alias("other"), F.col("side").alias("o_side"), F.col("known").alias("o_known"), F.col("hint").alias("o_hint"))
    e = gaps.select("callsign", "side", "known", F.posexplode(tx.mirror_numbers("callsign")).alias("n", "other"))
    return e.join(o, "other").where("side <> o_side and known = o_known").select("callsign", "n", "other", "o_hint")


def timetable_answers(gaps: DataFrame, schedule: DataFrame, airlines: DataFrame) -> DataFrame:
    """(callsign, answer, minute): what the known airport's published rows list under the airline and number."""
    s = tx.airline_of(schedule.where("flight is not null and source in ('published', 'both')"), airlines).withColumn("number", tx.digits("flight")).where("number <> ''")
    ends = F.explode(F.array(F.struct(F.lit("org").alias("end"), F.col("org").alias("at"), F.col("dst").alias("other"), F.col("dep_min").alias("minute")), F.struct(F.lit("dst").alias("end"), F.col("dst").alias("at"), F.col("org").alias("other"), F.col("arr_min").alias("minute"))))
    s = s.select("number", "prefix", "icao", ends.alias("e")).select("number", "prefix", "icao", "e.*")
    g = gaps.where(F.col("callsign").rlike(tx.MIRROR)).select("callsign", F.regexp_extract("callsign", tx.MIRROR, 1).alias("airline"), F.regexp_extract("callsign", tx.MIRROR, 2).alias("number"), F.col("known").alias("at"), F.when(F.col("side") == "dest", "org").otherwise("dst").alias("end"), F.concat(F.array("known"), F.coalesce("chain", F.array().cast("array<string>"))).alias("_x"))
    j = g.join(s, ["number", "at", "end"]).where(~F.array_contains("_x", F.col("other")) & tx.same_carrier("icao", "prefix", "airline", F.lit(True)))
    return j.groupBy("callsign", F.col("other").alias("answer")).agg(F.min("minute").alias("minute"))


def unanswered(gaps: DataFrame, catalog: DataFrame) -> DataFrame:
    """Gaps without an open catalog row."""
    return gaps.join(catalog.where("valid_to is null").select("callsign"), "callsign", "left_anti")


def only_voice(claims: DataFrame, endorsements: DataFrame, key: str = GUESS_KEY) -> DataFrame:
    """Open claims that nobody but one key stands behind."""
    mine = endorsements.where(F.col("key_name") == key).select(F.col("claim_id").alias("id"))
    other = endorsements.where(F.col("key_name").isNull() | (F.col("key_name") != key)).select(F.col("claim_id").alias("id"))
    return claims.where("status in ('approved', 'pending') and anonymous_count = 0").join(mine, "id", "left_semi").join(other, "id", "left_anti")


def clean_of_contributor(checked: DataFrame, endorsements: DataFrame, who: str) -> DataFrame:
    """Pending, uncontested claims of a contributor that no check disagrees with. checked: claims with check columns."""
    mine = endorsements.where((F.col("key_name") == who) | (F.col("handle") == who)).select(F.col("claim_id").alias("id"))
    return checked.where((F.col("status") == "pending") & (F.coalesce("verdict", F.lit("")) != "contested") & ~disagrees()).join(mine, "id", "left_semi")


def weighed_rotation() -> Column:
    """Observation outranks the inference: a rotation that fails is skipped where the log or the clock passes."""
    return F.when(((F.col("log") == "pass") | (F.col("clock") == "pass")) & (F.col("rotation") == "fail"), "skip").otherwise(F.col("rotation"))


def _any(names: tuple[str, ...], value: str) -> Column:
    out = F.lit(False)
    for n in names:
        out = out | F.coalesce((weighed_rotation() if n == "rotation" else F.col(n)) == value, F.lit(False))
    return out


def disagrees() -> Column:
    return _any(HARD + SOFT, "fail")


def verdict() -> Column:
    """contradicted by a hard failure; corroborated by two agreeing signals and no soft failure; else unverified."""
    signals = sum(((F.coalesce((weighed_rotation() if n == "rotation" else F.col(n)) == "pass", F.lit(False))).cast("int") for n in SOFT), F.lit(0))
    signals = signals + (F.coalesce("keyed", F.lit(0)) >= 2).cast("int")
    return F.when(_any(HARD, "fail"), "contradicted").when(_any(SOFT, "fail"), "unverified").when(signals >= 2, "corroborated").otherwise("unverified")


def check_claims(claims: DataFrame, gaps: DataFrame, airports: DataFrame, catalog: DataFrame, schedule: DataFrame, airlines: DataFrame, routes: DataFrame, legs: DataFrame, endorsements: DataFrame, today: Column) -> DataFrame:
    """Claims with one column per check (pass, fail or skip), the voices behind them, and `new_verdict`."""
    spot = airport_codes(airports)
    g = gaps.select("callsign", "side", "known", "hint", "chain", "type", "last_lat", "last_lon", "last_trk", "est_km", "n_rot", "known_ts")
    c = claims.join(g, "callsign", "left")
    to_dest = F.col("side") == "dest"
    c = c.withColumns({"claimed": F.when(to_dest, F.col("dest")).otherwise(F.col("origin")), "given": F.when(to_dest, F.col("origin")).otherwise(F.col("dest"))})
    end = lambda df, code, p: df.join(spot.select(F.col("code").alias(code), F.col("lat").alias(f"{p}_lat"), F.col("lon").alias(f"{p}_lon"), F.col("role").alias(f"{p}_role"), F.col("tz").alias(f"{p}_tz")), code, "left")
    c = end(end(c, "claimed", "a"), "known", "k")
    km = geo.haversine("k_lat", "k_lon", "a_lat", "a_lon", geo.EARTH_KM_ROUND)
    heading = to_dest & F.col("a_lat").isNotNull() & F.col("last_lat").isNotNull() & F.col("last_lon").isNotNull() & F.col("last_trk").isNotNull()
    reach = tx.type_range_km("type")
    c = c.withColumns({
        "asked": outcome(F.col("side").isNotNull()), "known_end": outcome(F.col("given") == F.col("known")), "not_same": outcome(F.col("claimed") != F.col("known")),
        "airport": outcome(F.col("a_role") == "commercial"), "observation": outcome(F.col("hint") == F.col("claimed"), F.col("hint").isNotNull() & (F.col("hint") != "")),
        "corridor": outcome(geo.angle_between(geo.bearing("last_lat", "last_lon", "a_lat", "a_lon"), "last_trk") <= CORRIDOR_DEG, heading),
        "rotation": outcome(F.abs(km - F.col("est_km")) <= ring_tolerance(), km.isNotNull() & (F.col("est_km") > 0) & (F.coalesce("n_rot", F.lit(0)) >= MIN_ROTATIONS)),
        "type_check": outcome(km <= reach, km.isNotNull() & reach.isNotNull()),
    })
    # the return flight's catalog row or hint, the lower number first
    now = catalog_current(catalog, today).select(F.col("callsign").alias("other"), F.col("origin").alias("c_origin"), F.col("dest").alias("c_dest"))
    m = mirror_gaps(gaps).join(gaps.select("callsign", "side"), "callsign").join(now, "other", "left")
    m = m.withColumn("answer", F.when(F.col("c_origin").isNotNull(), F.when(F.col("side") == "dest", F.col("c_origin")).otherwise(F.col("c_dest"))).otherwise(F.col("o_hint"))).where("answer is not null and answer <> ''")
    m = m.groupBy("callsign").agg(F.min_by("answer", "n").alias("mirror_answer"))
    c = c.join(m, "callsign", "left").withColumn("mirror", outcome(F.col("mirror_answer") == F.col("claimed"), F.col("mirror_answer").isNotNull()))
    # the flight log of the last 90 days
    since = F.date_sub(today, LOG_RECENT_DAYS)
    log = legs.where("org <> dst and callsign is not null").groupBy("callsign", "org", "dst").agg(F.count(F.lit(1)).alias("n"), F.max("date").alias("last")).where(F.col("last") >= since)
    pair = c.select("id", "callsign", F.when(to_dest, F.col("known")).otherwise(F.col("claimed")).alias("p_org"), F.when(to_dest, F.col("claimed")).otherwise(F.col("known")).alias("p_dst"), "known")
    own = (F.col("org") == F.col("p_org")) & (F.col("dst") == F.col("p_dst"))
    seen = pair.join(log, "callsign").groupBy("id").agg(F.sum(F.when(own, F.col("n")).otherwise(0)).alias("log_seen"), F.sum(F.when(~own & ((F.col("known") == F.col("org")) | (F.col("known") == F.col("dst"))), F.col("n")).otherwise(0)).alias("log_elsewhere"))
    c = c.join(seen, "id", "left").withColumn("log", F.when(F.col("log_seen") >= LOG_MIN_FLIGHTS, "pass").when(F.col("log_elsewhere") >= LOG_ELSEWHERE_FLIGHTS, "fail").otherwise("skip"))
    # the published timetable and the clock
    told = timetable_answers(gaps, schedule, airlines)
    any_told = told.select("callsign").distinct().withColumn("told_any", F.lit(True))
    c = c.join(any_told, "callsign", "left").join(told.select("callsign", F.col("answer").alias("claimed"), F.lit(True).alias("told"), F.col("minute").alias("told_min")), ["callsign", "claimed"], "left")
    c = c.withColumn("timetable", outcome(F.col("told"), F.col("told_any")))
    one_end = F.explode(F.array(F.struct(F.lit("dest").alias("side"), F.col("org").alias("known"), F.col("dep_ts").alias("ts")), F.struct(F.lit("origin").alias("side"), F.col("dst").alias("known"), F.col("arr_ts").alias("ts"))))
    stamps = legs.where("callsign is not null").select("callsign", "date", one_end.alias("e")).select("callsign", "date", "e.*").where("ts is not null and known is not null")
    # only the ends that a question names are looked up, and sorted, at all
    stamps = stamps.join(gaps.select("callsign", "side", "known").distinct(), ["callsign", "side", "known"], "left_semi")
    times = top_k(stamps, ["callsign", "side", "known"], [F.desc("date"), F.desc("ts")], 30, "_r").groupBy("callsign", "side", "known").agg(F.collect_list("ts").alias("log_ts"))
    c = c.join(times, ["callsign", "side", "known"], "left")
    given = F.when(F.size(F.coalesce("known_ts", F.array().cast("array<bigint>"))) > 0, F.col("known_ts")).otherwise(F.coalesce("log_ts", F.array().cast("array<bigint>")))
    c = c.withColumn("_ts", given)
    near = F.size(F.filter("_ts", lambda t: tu.circ_diff(tu.local_minute(t, F.col("k_tz")), F.col("told_min")) <= CLOCK_TOLERANCE_MIN))
    n = F.size("_ts")
    known_clock = F.col("told_min").isNotNull() & F.col("k_tz").isNotNull()
    c = c.withColumn("clock", F.when(known_clock & (n > 0) & (2 * near >= n), "pass").when(known_clock & (n >= CLOCK_MIN_SEEN) & (near == 0), "fail").otherwise("skip"))
    # the one candidate that fits, and the airports its airline serves
    served_by = served_by_airline(routes)
    sole = unique_candidate(gap_candidates(gaps, airports, served_by, k=50))
    c = c.join(sole, "callsign", "left").withColumn("unique", outcome(F.col("sole") == F.col("claimed"), F.col("sole").isNotNull()))
    c = c.withColumn("airline", F.substring("callsign", 1, 3)).join(served_by.select("airline").distinct().withColumn("served_any", F.lit(True)), "airline", "left").join(served_by.select("airline", F.col("code").alias("claimed"), F.lit(True).alias("served")), ["airline", "claimed"], "left")
    c = c.withColumn("served_by", outcome(F.col("served"), F.col("served_any")))
    c = c.join(voices(claims, endorsements), "id", "left")
    checks = ("asked", "known_end", "not_same", "airport", "observation", "corridor", "rotation", "mirror", "log", "timetable", "clock", "unique", "served_by")
    keep = c.select(*claims.columns, *checks, F.col("type_check").alias("type"), "keyed", "named", "anonymous")
    # with no question every other check falls away
    keep = keep.withColumns({k: F.when(F.col("asked") == "pass", F.col(k)) for k in (*checks[1:], "type")})
    return keep.withColumn("new_verdict", verdict())


def file_claims(claims: DataFrame, endorsements: DataFrame, submissions: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """File accepted submissions(id, callsign, origin, dest, handle, note, key_name, valid_from).

    A known answer gets one more voice; a new one becomes a claim unless the question has three open ones, in submission
    order, and then its pending claims are contested. A voice without name, note and key is counted, not kept."""
    key = ["callsign", "origin", "dest"]
    first = submissions.groupBy(*key).agg(F.min("id").alias("sub"))
    new = first.join(claims.select(*key), key, "left_anti")
    open_ = claims.where("status <> 'rejected'").groupBy("callsign").agg(F.count(F.lit(1)).alias("n_open"))
    order = Window.partitionBy("callsign").orderBy("sub")
    placed = new.join(open_, "callsign", "left").withColumn("place", F.coalesce("n_open", F.lit(0)) + F.row_number().over(order))
    filed, refused = placed.where(F.col("place") <= MAX_OPEN), placed.where(F.col("place") > MAX_OPEN)
    top = claims.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    # new claims are counted on from the largest number in the order of their submissions, whatever those are numbered by
    numbered = ranked_overall(filed.select("sub", *key), [F.col("sub"), *map(F.col, key)], "_k")
    added = numbered.join(F.broadcast(top)).select((F.col("_top") + F.col("_k")).alias("id"), *key, F.lit("pending").alias("status"), F.lit(None).cast("string").alias("verdict"), F.lit(0).alias("anonymous_count"), now.alias("first_at"), now.alias("last_at"))
    all_ = claims.unionByName(added, allowMissingColumns=True)
    contested = refused.select("callsign").distinct().withColumn("_contested", F.lit(True))
    voice = submissions.withColumn("_anon", F.col("handle").isNull() & F.col("note").isNull() & F.col("key_name").isNull())
    heard = voice.groupBy(*key).agg(F.count_if("_anon").cast("int").alias("_n"), F.lit(True).alias("_heard"))
    all_ = all_.join(heard, key, "left").join(contested, "callsign", "left")
    all_ = all_.withColumns({"anonymous_count": F.col("anonymous_count") + F.coalesce("_n", F.lit(0)), "last_at": F.when(F.col("_heard"), now).otherwise(F.col("last_at")), "verdict": F.when(F.col("_contested") & (F.col("status") == "pending"), "contested").otherwise(F.col("verdict"))}).drop("_n", "_heard", "_contested")
    said = voice.where(~F.col("_anon")).join(all_.select(*key, F.col("id").alias("claim_id")), key)
    more = said.select("claim_id", "handle", "note", "key_name", F.try_to_date("valid_from", "yyyy-MM-dd").alias("valid_from"), now.alias("received_at"), F.col("id").alias("source_id"))
    return all_, endorsements.unionByName(more, allowMissingColumns=True)


def evaluate_claims(checked: DataFrame, now: Column) -> DataFrame:
    """Pending, uncontested claims take their verdict: corroborated ones are approved, contradicted ones rejected."""
    act = (F.col("status") == "pending") & (F.coalesce("verdict", F.lit("")) != "contested")
    v = F.when(act, F.col("new_verdict")).otherwise(F.col("verdict"))
    decided = act & F.col("new_verdict").isin("corroborated", "contradicted")
    return checked.withColumns({"verdict": v, "status": F.when(act & (F.col("new_verdict") == "corroborated"), "approved").when(act & (F.col("new_verdict") == "contradicted"), "rejected").otherwise(F.col("status")), "reviewed_at": F.when(decided, now).otherwise(F.col("reviewed_at")), "reviewed_by": F.when(decided, "verdict").otherwise(F.col("reviewed_by"))})


def approve_claims(catalog: DataFrame, approved: DataFrame, gaps: DataFrame, endorsements: DataFrame, now: Column) -> DataFrame:
    """The catalog after approving claims: open rows of the callsign close as superseded on the new row's first day."""
    e = endorsements.groupBy(F.col("claim_id").alias("id")).agg(F.min("valid_from").alias("start"), F.bool_or(F.coalesce(F.col("key_name") == TIMETABLE_KEY, F.lit(False))).alias("published"))
    a = approved.join(e, "id", "left").join(gaps.select("callsign", "side", "chain"), "callsign", "left")
    n = F.coalesce(F.size("chain"), F.lit(0))
    has = n > 0
    first_stops, last_stops = F.slice("chain", F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice("chain", F.lit(2), F.greatest(n - 1, F.lit(0)))
    back = F.col("side") == "origin"
    via = F.when(has & back, first_stops).when(has, last_stops)
    new = a.select("callsign", F.when(has & ~back, F.element_at("chain", 1)).otherwise(F.col("origin")).alias("origin"), F.when(has & back, F.element_at("chain", -1)).otherwise(F.col("dest")).alias("dest"), F.when(F.size(via) > 0, via).alias("via"), F.coalesce("start", F.to_date(now)).alias("valid_from"), F.lit(None).cast("date").alias("valid_to"), F.lit(None).cast("string").alias("closed_reason"), F.when(F.col("published"), "published").otherwise("community").alias("source"), F.col("id").alias("claim_id"), now.alias("approved_at"))
    # of several answers approved at once each but the last is superseded by the next
    w = Window.partitionBy("callsign").orderBy("claim_id")
    new = new.withColumn("_next", F.lead("valid_from").over(w)).withColumns({"valid_to": F.col("_next"), "closed_reason": F.when(F.col("_next").isNotNull(), "superseded")}).drop("_next")
    starts = new.groupBy("callsign").agg(F.min_by("valid_from", "claim_id").alias("_start"))
    closing = F.col("valid_to").isNull() & F.col("_start").isNotNull()
    old = catalog.join(starts, "callsign", "left").withColumns({"closed_reason": F.when(closing, "superseded").otherwise(F.col("closed_reason")), "valid_to": F.when(closing, F.col("_start")).otherwise(F.col("valid_to"))}).drop("_start")
    return old.unionByName(new, allowMissingColumns=True)


def propose_from_timetable(gaps: DataFrame, claims: DataFrame, schedule: DataFrame, airlines: DataFrame) -> DataFrame:
    """Submissions for questions that have no open or approved claim and exactly one published answer."""
    free = gaps.join(claims.where("status <> 'rejected'").select("callsign"), "callsign", "left_anti")
    told = timetable_answers(free, schedule, airlines).groupBy("callsign").agg(F.count(F.lit(1)).alias("n"), F.min("answer").alias("answer")).where("n = 1")
    j = told.join(free.select("callsign", "side", "known"), "callsign")
    to_dest = F.col("side") == "dest"
    none = F.lit(None).cast("string")
    return j.select(F.shiftrightunsigned(F.xxhash64("callsign"), 1).alias("id"), "callsign", F.when(to_dest, F.col("known")).otherwise(F.col("answer")).alias("origin"), F.when(to_dest, F.col("answer")).otherwise(F.col("known")).alias("dest"), none.alias("handle"), F.lit("the airport's published timetable").alias("note"), F.lit(TIMETABLE_KEY).alias("key_name"), none.alias("valid_from"))


def close_rows(catalog: DataFrame, ids: DataFrame, today: Column, reason: str) -> DataFrame:
    """Close the open rows of claims. ids(claim_id)."""
    j = catalog.join(ids.select("claim_id").distinct().withColumn("_hit", F.lit(True)), "claim_id", "left")
    hit = F.col("_hit") & F.col("valid_to").isNull()
    return j.withColumns({"closed_reason": F.when(hit, reason).otherwise(F.col("closed_reason")), "valid_to": F.when(hit, today).otherwise(F.col("valid_to"))}).drop("_hit").select(*catalog.columns)


def set_status(claims: DataFrame, ids: DataFrame, status: str, by: str, now: Column, note: str | None = None) -> DataFrame:
    j = claims.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    new = {"status": F.lit(status), "reviewed_at": now, "reviewed_by": F.lit(by), "review_note": F.lit(note).cast("string")}
    return j.withColumns({k: F.when(F.col("_hit"), v).otherwise(F.col(k)) for k, v in new.items()}).drop("_hit").select(*claims.columns)


def withdraw(claims: DataFrame, catalog: DataFrame, ids: DataFrame, now: Column, note: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Undo approvals: rows close today as withdrawn, claims are rejected. ids(id) of approved claims."""
    ids = claims.where("status = 'approved'").join(ids, "id", "left_semi").select("id")
    return set_status(claims, ids, "rejected", "operator", now, note), close_rows(catalog, ids.withColumnRenamed("id", "claim_id"), F.to_date(now), "withdrawn")


def withdraw_guesses(claims: DataFrame, endorsements: DataFrame, catalog: DataFrame, now: Column, note: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Withdraw or reject every open claim whose only voice is the retired guessing key."""
    lone = only_voice(claims, endorsements).select("id")
    kept, rows = withdraw(claims, catalog, lone, now, note)
    return set_status(kept, lone, "rejected", "operator", now, note), rows


def reject(claims: DataFrame, ids: DataFrame, now: Column, note: str | None = None) -> DataFrame:
    return set_status(claims, claims.where("status = 'pending'").join(ids, "id", "left_semi").select("id"), "rejected", "operator", now, note)


def reconcile(catalog: DataFrame, routes: DataFrame, today: Column) -> DataFrame:
    """Close open rows that observation has overtaken: observed if it is the same route, contradicted if not."""
    j = catalog.join(routes.select("callsign", F.col("chain").alias("_chain")), "callsign", "left")
    hit = F.col("valid_to").isNull() & F.col("_chain").isNotNull()
    same = F.col("_chain") == tx.catalog_route("origin", "via", "dest")
    return j.withColumns({"closed_reason": F.when(hit, F.when(same, "observed").otherwise("contradicted")).otherwise(F.col("closed_reason")), "valid_to": F.when(hit, today).otherwise(F.col("valid_to"))}).drop("_chain").select(*catalog.columns)


def recheck(checked: DataFrame, endorsements: DataFrame, catalog: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Reopen approved timetable answers that the timetable or the clock now disagrees with. checked: from `check_claims`."""
    keyed = endorsements.where(F.col("key_name") == TIMETABLE_KEY).select(F.col("claim_id").alias("id"))
    bad = checked.where((F.col("status") == "approved") & (F.col("asked") == "pass") & ((F.col("timetable") == "fail") | (F.col("clock") == "fail"))).join(keyed, "id", "left_semi").select("id")
    rows = close_rows(catalog, bad.withColumnRenamed("id", "claim_id"), F.to_date(now), "rechecked")
    j = checked.join(bad.withColumn("_hit", F.lit(True)), "id", "left")
    new = {"status": F.lit("pending"), "verdict": F.lit("unverified"), "reviewed_at": now, "reviewed_by": F.lit("recheck")}
    return j.withColumns({k: F.when(F.col("_hit"), v).otherwise(F.col(k)) for k, v in new.items()}).drop("_hit"), rows


def purge_rejected(claims: DataFrame, endorsements: DataFrame, now: Column, days: int = PURGE_DAYS) -> tuple[DataFrame, DataFrame]:
    """Drop claims rejected more than `days` days ago, and their endorsements."""
    old = claims.where((F.col("status") == "rejected") & (F.col("reviewed_at") < now - F.make_dt_interval(days=F.lit(days)))).select("id")
    return claims.join(old, "id", "left_anti"), endorsements.join(old.withColumnRenamed("id", "claim_id"), "claim_id", "left_anti")


def pull(submissions: DataFrame, claims: DataFrame, endorsements: DataFrame, catalog: DataFrame, tables: dict[str, DataFrame], now: Column, checkpoint=lambda df: df) -> dict[str, DataFrame]:
    """One nightly run: file what is new, judge what is pending, approve into the catalog, purge what is old.

    tables: gaps, airports, schedule, airlines, routes, legs. `checkpoint` cuts the lineage between steps."""
    claims, endorsements = (checkpoint(d) for d in file_claims(claims, endorsements, submissions, now))
    t = tables
    checked = checkpoint(check_claims(claims, t["gaps"], t["airports"], catalog, t["schedule"], t["airlines"], t["routes"], t["legs"], endorsements, F.to_date(now)))
    judged = checkpoint(evaluate_claims(checked, now))
    newly = judged.where("status = 'approved'").join(claims.where("status = 'pending'").select("id"), "id", "left_semi")
    catalog = checkpoint(approve_claims(catalog, newly, t["gaps"], endorsements, now))
    kept, endorsements = purge_rejected(judged, endorsements, now)
    return {"claims": kept, "endorsements": endorsements, "catalog": catalog}


def gap_list(gaps: DataFrame, catalog: DataFrame, offset: int = 0, limit: int = 50) -> tuple[DataFrame, DataFrame]:
    """(page, total) of unanswered questions, the most seen first."""
    rows = unanswered(gaps, catalog)
    return page(rows, [F.col("n_recent").desc_nulls_last(), F.col("callsign")], offset, limit), rows.agg(F.count(F.lit(1)).alias("total"))


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def gap_record(gaps: DataFrame, airports: DataFrame, served_by: DataFrame, claims: DataFrame) -> DataFrame:
    """Gaps with candidates, open answers and the rotation where two or more support it."""
    c = gap_candidates(gaps, airports, served_by).groupBy("callsign").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "code"))), lambda s: s["code"]).alias("candidates"))
    a = claims.where("status = 'pending'").groupBy("callsign").agg(F.array_sort(F.collect_list(F.struct("id", "origin", "dest", "verdict"))).alias("answers"))
    shown = F.when(F.coalesce("n_rot", F.lit(0)) >= MIN_ROTATIONS, F.col("est_km"))
    return gaps.withColumn("est_km", shown).join(c, "callsign", "left").join(a, "callsign", "left")

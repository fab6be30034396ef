"""Structured Streaming over position reports: the latest sky, emergency episodes, lost aircraft, trails, stations and traffic.

Each operator keeps keyed state with a time limit; its batch twin computes the same from a table. Event time is the
report's `ts`; the watermark allows what the sender's own limits imply.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from aerolith.functions import text as tx
from aerolith.operators import estimate as es
from aerolith.operators.filters import HELD, cruising, emergency_signal, signal_code, signal_state
from aerolith.operators.windows import ranked_overall, top_k, trim_trace
from aerolith.sources import commits

SKY_TTL_S, EPISODE_GAP_S, MIN_REPORTS, MIN_HOLD_S = 60, 300.0, 2, 20.0
LOST_AFTER_S, SHOW_MAX_S, BOOK_S = 90.0, 900.0, 8 * 3600


def _seconds(df: DataFrame) -> DataFrame:
    return df.withColumn("t", F.col("ts").cast("double"))


# --- the latest sky -------------------------------------------------------------------------------------------------

SKY = ("flight", "lat", "lon", "alt_ft", "on_ground", "gs", "track", "squawk", "seen")


def latest_sky_batch(positions: DataFrame, now=None, ttl_s: float = SKY_TTL_S) -> DataFrame:
    """The last report of each aircraft that is not older than the limit at `now` (default: the newest report)."""
    p = _seconds(positions)
    columns = [c for c in SKY if c in p.columns]
    last = p.groupBy("hex").agg(F.max_by(F.struct("t", *columns), F.struct("t", *[c for c in ("event_id",) if c in p.columns])).alias("r")).select("hex", "r.*")
    at = p.agg((F.max("t") if now is None else F.lit(float(now))).alias("_now"))
    age = F.coalesce(F.col("seen"), F.lit(0.0)) if "seen" in columns else F.lit(0.0)
    return last.join(F.broadcast(at)).where(age + F.col("_now") - F.col("t") <= ttl_s).drop("_now")


def latest_sky(stream: DataFrame, publish: Callable[[DataFrame, int], None], path: str, checkpoint: str, every: str = "250 milliseconds", ttl_s: float = SKY_TTL_S, seed: DataFrame | None = None):
    """Keep the sky as a table of two generations and hand each new one to `publish(sky, batch)`.

    A micro-batch replaces the rows of the aircraft it hears and drops those past the limit. `seed` (a snapshot) fills in
    aircraft not heard yet when the query starts. The generation is the batch's number, so a batch that is done again
    writes the same table again."""
    spark = stream.sparkSession
    columns = ["hex", "t", *[c for c in SKY if c in stream.columns]]

    def step(batch: DataFrame, number: int) -> None:
        new = latest_sky_batch(batch, None, float("inf")).select(*columns)
        old = _previous(spark, path, number)
        if old is None and seed is not None:
            old = _seconds(seed).select(*columns)
        if old is not None:
            new = new.unionByName(old.select(*columns).join(new.select("hex"), "hex", "left_anti"))
        newest = new.agg(F.max("t").alias("_now"))
        kept = new.join(F.broadcast(newest)).where(F.col("_now") - F.col("t") <= ttl_s).drop("_now")
        kept.write.mode("overwrite").parquet(f"{path}/{number}")
        publish(spark.read.parquet(f"{path}/{number}"), number)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def _previous(spark, path: str, number: int) -> DataFrame | None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/{number - 1}")
    exists = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    return spark.read.parquet(f"{path}/{number - 1}") if number and exists else None


# --- emergency episodes ---------------------------------------------------------------------------------------------

EPISODE = "hex string, at double, lat double, lon double, visibility string, code string, state string, callsign string, alt_ft int"


def emergency_episodes_batch(positions: DataFrame, gap_s: float = EPISODE_GAP_S, min_reports: int = MIN_REPORTS, min_hold_s: float = MIN_HOLD_S) -> DataFrame:
    """One row per episode: signals no more than `gap_s` apart; recorded at the first report that makes two or more over 20 seconds or longer."""
    p = _seconds(positions.where(emergency_signal())).withColumns({"_c": signal_code(), "_s": signal_state() if "emergency" in positions.columns else F.lit(None).cast("string")})
    by = [F.col("t"), *[F.col(c) for c in ("event_id",) if c in p.columns]]
    w = Window.partitionBy("hex").orderBy(*by)
    p = p.withColumn("_new", (F.col("t") - F.lag("t").over(w) > gap_s).cast("int"))
    p = p.withColumn("ep", F.sum(F.coalesce("_new", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    e = Window.partitionBy("hex", "ep").orderBy(*by)
    so_far = e.rowsBetween(Window.unboundedPreceding, 0)
    p = p.withColumns({"n": F.row_number().over(e), "since": F.min("t").over(so_far), "code": F.first("_c", ignorenulls=True).over(so_far), "state": F.first("_s", ignorenulls=True).over(so_far)})
    ripe = top_k(p.where((F.col("n") >= min_reports) & (F.col("t") - F.col("since") >= min_hold_s)), ["hex", "ep"], by, 1, "_r")
    held = F.col("code").isin(*HELD) | F.coalesce(F.col("state").isin(*HELD), F.lit(False))
    return ripe.select("hex", F.col("since").alias("at"), "lat", "lon", F.when(held, "held").otherwise("public").alias("visibility"), "code", "state", F.col("flight").alias("callsign"), "alt_ft")


def emergency_episodes(stream: DataFrame, gap_s: float = EPISODE_GAP_S, min_reports: int = MIN_REPORTS, min_hold_s: float = MIN_HOLD_S) -> DataFrame:
    """The same over a stream: state per aircraft (since, last, n, recorded, code, state), forgotten a gap after its last signal."""
    p = _seconds(stream).withColumns({"_c": signal_code(), "_s": signal_state()}).where("_c is not null or _s is not null")
    p = p.withWatermark("ts", f"{int(gap_s)} seconds")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        ep = list(state.get) if state.exists else None
        out = []
        for r in pd.concat(list(batches)).sort_values("t").itertuples(index=False):
            code, signal = (None if pd.isna(x) else x for x in (r.code_, r.state_))
            if ep is None or r.t - ep[1] > gap_s:
                ep = [r.t, r.t, 0, False, code, signal]
            ep[1], ep[2] = r.t, ep[2] + 1
            ep[4], ep[5] = ep[4] or code, ep[5] or signal
            if not ep[3] and ep[2] >= min_reports and r.t - ep[0] >= min_hold_s:
                ep[3] = True
                out.append((key[0], ep[0], r.lat, r.lon, "held" if ep[4] in HELD or ep[5] in HELD else "public", ep[4], ep[5], r.flight, r.alt_ft))
        state.update(tuple(ep))
        state.setTimeoutTimestamp(int(max(ep[1] + gap_s, state.getCurrentWatermarkMs() / 1000 + 1) * 1000))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in EPISODE.split(", ")])

    rows = p.select("hex", "ts", "t", "lat", "lon", "flight", "alt_ft", F.col("_c").alias("code_"), F.col("_s").alias("state_"))
    return rows.groupBy("hex").applyInPandasWithState(step, EPISODE, "since double, last double, n long, recorded boolean, code string, state string", "append", GroupStateTimeout.EventTimeTimeout)


def write_events_once(batch: DataFrame, out: str, number: int | None = None, source: str = "live") -> int:
    """Add episodes that the store does not hold, by (hex, at, source); returns how many. For `foreachBatch`: only the keys of
    the batch's own days and buckets are read, and doing a batch again, or beside another writer, changes nothing."""
    rows = batch.withColumn("source", F.lit(source))
    return commits.merge_once(rows, out, "events", ["hex", "at", "source"], day=F.timestamp_seconds("at"), writer=f"events {source}" if number is not None else None, number=number)


# --- lost aircraft --------------------------------------------------------------------------------------------------

BOOK = "hex string, callsign string, lat double, lon double, alt_ft int, gs double, track double, t double"


def estimate_book_batch(positions: DataFrame, now: float, keep_s: float = BOOK_S) -> DataFrame:
    """The book at an instant: each aircraft's last report if it was cruising; one that is not clears it."""
    p = _seconds(positions).where(F.col("t") <= now)
    last = p.groupBy("hex").agg(F.max_by(F.struct("flight", "lat", "lon", "alt_ft", "gs", "track", "t"), "t").alias("r")).select("hex", "r.*")
    return last.where(cruising() & (F.col("t") >= now - keep_s)).select("hex", F.col("flight").alias("callsign"), "lat", "lon", "alt_ft", "gs", "track", "t")


def estimate_book(stream: DataFrame, keep_s: float = BOOK_S) -> DataFrame:
    """The book over a stream, in update mode: the last cruising report of each aircraft; a row with a null position is cleared or forgotten."""
    p = _seconds(stream).withWatermark("ts", "1 minute").withColumn("ok", cruising())

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        columns = ["hex", "callsign", "lat", "lon", "alt_ft", "gs", "track", "t"]
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], *[None] * 7)], columns=columns)
            return
        r = pd.concat(list(batches)).sort_values("t").iloc[-1]
        if state.exists and state.get[0] >= r["t"]:
            return
        state.update((float(r["t"]),))
        state.setTimeoutTimestamp(int(max(r["t"] + keep_s, state.getCurrentWatermarkMs() / 1000 + 1) * 1000))
        row = (key[0], r["flight"], r["lat"], r["lon"], r["alt_ft"], r["gs"], r["track"], r["t"]) if r["ok"] else (key[0], *[None] * 6, r["t"])
        yield pd.DataFrame([row], columns=columns)

    rows = p.select("hex", "ts", "t", "flight", "lat", "lon", "alt_ft", "gs", "track", "ok")
    return rows.groupBy("hex").applyInPandasWithState(step, BOOK, "t double", "update", GroupStateTimeout.EventTimeTimeout)


def lost_aircraft(book: DataFrame, routes: DataFrame, airports: DataFrame, now: float, shown_s: float = SHOW_MAX_S) -> DataFrame:
    """Where the book's silent aircraft are now: heard last 90 seconds to 15 minutes ago, still short of the destination."""
    silent = book.withColumn("dt_s", F.lit(float(now)) - F.col("t")).where(F.col("dt_s").between(LOST_AFTER_S, shown_s))
    from aerolith.functions import geo

    d = es.pick_destination(silent, routes, airports, ["hex"]).where(F.col("dt_s") <= geo.horizon_s("gs", "dest_km"))
    e = es.project(d, "converge")
    return e.where(F.col("est.remaining_km") >= es.STOP_BEFORE_KM).select("hex", "callsign", "dest", F.col("est.lat").alias("lat"), F.col("est.lon").alias("lon"), F.col("est.heading").alias("track"), "dt_s")


def restore_book(saved: DataFrame, now: float, keep_s: float = BOOK_S) -> DataFrame:
    """A saved book without what has gone stale."""
    return saved.where(F.col("t") >= now - keep_s)


# --- changes between skies ------------------------------------------------------------------------------------------

UNWATCHED = ("hex", "seen", "seen_pos", "t", "ts", "event_id")


def sky_changes(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(hex, change, row): added, changed (ages do not count) or removed between two snapshots."""
    watched = [c for c in current.columns if c not in UNWATCHED]
    a = previous.select("hex", F.struct(*watched).alias("_a"))
    b = current.select("hex", F.struct(*watched).alias("row"))
    j = a.join(b, "hex", "full_outer")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("row").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("row")), "changed")
    return j.withColumn("change", change).where("change is not null").select("hex", "change", "row")


def field_patches(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(hex, patch): only the fields that changed, as text; null where a field is gone; every field of an added aircraft."""
    watched = [c for c in current.columns if c not in UNWATCHED]
    text = lambda df, n: df.select("hex", F.create_map(*[x for c in watched for x in (F.lit(c), F.col(c).cast("string"))]).alias(n))
    j = text(current, "m").join(text(previous, "o"), "hex", "left")
    patch = F.map_filter("m", lambda k, v: F.when(F.col("o").isNull(), v.isNotNull()).otherwise(~v.eqNullSafe(F.try_element_at(F.col("o"), k))))
    return j.select("hex", patch.alias("patch")).where(F.cardinality("patch") > 0)


# --- trails, traffic ------------------------------------------------------------------------------------------------


def trace_points_batch(positions: DataFrame, keep_s: float = 1800, most: int = 720) -> DataFrame:
    return trim_trace(_seconds(positions).select("hex", "t", "lat", "lon", "alt_ft"), keep_s, most)


TRAIL = "hex string, points array<struct<t:double,lat:double,lon:double,alt_ft:int>>"


def trace_points(stream: DataFrame, keep_s: float = 1800, most: int = 720) -> DataFrame:
    """Each aircraft's trail in update mode; a repeated position only moves its time on; silent for `keep_s`: forgotten."""
    p = _seconds(stream).where("lat is not null and lon is not null").withWatermark("ts", f"{int(keep_s)} seconds")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        trail = [list(x) for x in state.get[0]] if state.exists else []
        for r in pd.concat(list(batches)).sort_values("t").itertuples(index=False):
            if trail and trail[-1][1:3] == [r.lat, r.lon]:
                trail[-1][0] = max(trail[-1][0], r.t)
            else:
                trail.append([r.t, r.lat, r.lon, None if pd.isna(r.alt_ft) else int(r.alt_ft)])
        trail = [x for x in trail if x[0] >= trail[-1][0] - keep_s][-most:]
        state.update(([tuple(x) for x in trail],))
        state.setTimeoutTimestamp(int(max(trail[-1][0] + keep_s, state.getCurrentWatermarkMs() / 1000 + 1) * 1000))
        yield pd.DataFrame({"hex": [key[0]], "points": [[{"t": a, "lat": b, "lon": c, "alt_ft": d} for a, b, c, d in trail]]})

    return p.select("hex", "ts", "t", "lat", "lon", "alt_ft").groupBy("hex").applyInPandasWithState(step, TRAIL, "points array<struct<t:double,lat:double,lon:double,alt_ft:int>>", "update", GroupStateTimeout.EventTimeTimeout)


def tumbling_traffic(stream: DataFrame, slice_s: int = 15, late: str = "60 seconds") -> DataFrame:
    """Aircraft per slice over a stream; the most in five minutes is `traffic_timeline` over what it appends."""
    w = stream.withWatermark("ts", late).groupBy(F.window("ts", f"{slice_s} seconds")).agg(F.approx_count_distinct("hex", 0.01).alias("aircraft"))
    return w.select(F.col("window.start").alias("slice"), "aircraft")


# --- stations -------------------------------------------------------------------------------------------------------


def station_sessions_batch(polls: DataFrame, reopen_s: float = 30) -> DataFrame:
    """Sessions of stations from polls(half_id, at TIMESTAMP, conn_time_s, msgs_per_s, positions_total).

    A session goes on while each poll hears the station and its connection did not begin more than 30 seconds after the
    session; one that a poll misses closes at its last sight."""
    p = polls.withColumn("t", F.col("at").cast("double"))
    every = p.select("t").distinct()
    order = ranked_overall(every, [F.col("t")], "k")
    newest = order.agg(F.max("k").alias("_last"))
    w = Window.partitionBy("half_id").orderBy("k")
    p = p.join(order, "t").withColumn("start", F.col("t") - F.col("conn_time_s"))
    p = p.withColumn("_gap", (F.col("k") - F.lag("k").over(w) > 1) | (F.lag("k").over(w).isNull()) | (F.col("start") > F.lag("start").over(w) + reopen_s))
    p = p.withColumn("s", F.sum(F.col("_gap").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = p.groupBy("half_id", "s").agg(F.min_by("start", "k").alias("started"), F.max("t").alias("last_seen"), F.max("msgs_per_s").alias("peak_msgs_per_s"), F.max("positions_total").alias("positions_total"), F.max("k").alias("_k"))
    latest = Window.partitionBy("half_id")
    out = out.join(F.broadcast(newest)).withColumn("_open", (F.col("_k") == F.col("_last")) & (F.col("s") == F.max("s").over(latest)))
    return out.select("half_id", "started", "last_seen", F.when(~F.col("_open"), F.col("last_seen")).alias("ended"), "peak_msgs_per_s", "positions_total")


SESSION = "half_id string, started double, last_seen double, ended double, peak_msgs_per_s double, positions_total long"


def station_sessions(stream: DataFrame, poll_s: float = 60, reopen_s: float = 30) -> DataFrame:
    """The same over a stream of polls, in update mode: a station unheard for two polls is closed at its last sight."""
    p = stream.withColumn("t", F.col("at").cast("double")).withWatermark("at", f"{int(poll_s)} seconds")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in SESSION.split(", ")]
        if state.hasTimedOut:
            s = state.get
            state.remove()
            yield pd.DataFrame([(key[0], s[0], s[1], s[1], s[2], s[3])], columns=columns)
            return
        s, out = list(state.get) if state.exists else None, []
        for r in pd.concat(list(batches)).sort_values("t").itertuples(index=False):
            start = r.t - r.conn_time_s
            if s is not None and (start > s[0] + reopen_s or r.t - s[1] > 2 * poll_s):
                out.append((key[0], s[0], s[1], s[1], s[2], s[3]))
                s = None
            s = s or [start, r.t, 0.0, 0]
            s = [s[0], r.t, max(s[2], r.msgs_per_s), max(s[3], int(r.positions_total))]
        out.append((key[0], s[0], s[1], None, s[2], s[3]))
        state.update((float(s[0]), float(s[1]), float(s[2]), int(s[3])))
        state.setTimeoutTimestamp(int(max(s[1] + 2 * poll_s, state.getCurrentWatermarkMs() / 1000 + 1) * 1000))
        yield pd.DataFrame(out, columns=columns)

    rows = p.select("half_id", "at", "t", "conn_time_s", "msgs_per_s", "positions_total")
    return rows.groupBy("half_id").applyInPandasWithState(step, SESSION, "started double, last_seen double, peak double, total long", "update", GroupStateTimeout.EventTimeTimeout)


def stations_of(polls: DataFrame) -> DataFrame:
    """Stations of presence rows(uuid, at, ...): hashes only, never the id itself."""
    p = polls.where(~tx.is_anonymous("uuid")).select(tx.hash_uuid("uuid").alias("uuid_sha256"), tx.half_id("uuid").alias("half_id"), "at", "msgs_per_s", "positions_total")
    s = p.groupBy("uuid_sha256", "half_id").agg(F.min("at").alias("first_seen"), F.max("at").alias("last_seen"), F.max_by("msgs_per_s", "at").alias("msgs_per_s"), F.max("positions_total").alias("positions_total"))
    return s.withColumn("public_id", tx.public_id("uuid_sha256"))


def coarse_locations(stations: DataFrame, receivers: DataFrame, digits: int = 1) -> DataFrame:
    """Stations with rounded coordinates; those without a good extent keep what they had."""
    r = receivers.groupBy("half_id").agg(F.max(F.struct("lat", "lon")).alias("p")).select("half_id", tx.coarse("p.lat", digits).alias("_lat"), tx.coarse("p.lon", digits).alias("_lon"))
    j = stations.join(r, "half_id", "left")
    had = lambda c: F.col(c) if c in stations.columns else F.lit(None).cast("double")
    return j.withColumns({"lat": F.coalesce("_lat", had("lat")), "lon": F.coalesce("_lon", had("lon"))}).drop("_lat", "_lon")


def retire(df: DataFrame, column: str, now, days: int = 90) -> DataFrame:
    """Rows that ended within `days`, or have not ended."""
    return df.where(F.col(column).isNull() | (F.col(column) >= now - F.make_dt_interval(days=F.lit(days))))


def roster(stations: DataFrame, now, online_s: float = 60) -> DataFrame:
    """Public list: whether each is online, coarse coordinates only."""
    online = now.cast("double") - F.col("last_seen").cast("double") <= online_s
    return stations.select("public_id", online.alias("online"), "lat", "lon", "first_seen", "last_seen", "msgs_per_s", "positions_total")


def feeding_from(presence: DataFrame, keys: DataFrame) -> DataFrame:
    """Stations connected from one address. presence(half_id, address_key), keys(address_key)."""
    return keys.join(presence, "address_key", "left").groupBy("address_key").agg(F.array_sort(F.collect_set("half_id")).alias("stations"))


def aircraft_per_station(heard: DataFrame) -> DataFrame:
    """Aircraft with a position that each receiver hears now. heard(half_id, hex, lat, lon)."""
    return heard.where("lat is not null and lon is not null").groupBy("half_id").agg(F.countDistinct("hex").alias("aircraft"))


def station_self(keys: DataFrame, stations: DataFrame, sessions: DataFrame, k: int = 10) -> DataFrame:
    """A station's own record by the hash of its key, with its newest sessions; a key that fits none gives nulls. keys(uuid)."""
    s = top_k(sessions, ["half_id"], [F.desc("started")], k, "_r").groupBy("half_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("started")).alias("order"), "started", "last_seen", "ended"))).alias("sessions"))
    asked = keys.select(tx.hash_uuid("uuid").alias("uuid_sha256"))
    return asked.join(stations, "uuid_sha256", "left").join(s, "half_id", "left")

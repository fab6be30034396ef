"""Estimated positions across gaps in coverage, and their backtests."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolith.functions import geo
from aerolith.operators.aggregates import airport_codes
from aerolith.operators.filters import cruising
from aerolith.operators.registry import tracks_active
from aerolith.operators.windows import consecutive_pairs, top_k

# Fixed values of the estimator.
MIN_REMAINING_KM, MAX_OFF_DEG, STOP_BEFORE_KM = 250, 100, 150
TURN_DEG_PER_MIN, HOLD_S, STEP_S = 2.0, 600.0, 30.0
NAT_MATCH_DEG, NAT_ON_TRACK_DEG, NAT_LEVEL_SLACK = 0.5, 0.4, 10
AIRWAY_ON_KM, AIRWAY_HDG_DEG, AIRWAY_DETOUR = 20, 20, 1.03
LON_CELL = 10.0
BUCKETS = ((5, 15), (15, 30), (30, 60), (60, 120), (120, 480))


def pick_destination(points: DataFrame, routes: DataFrame, airports: DataFrame, key: list[str]) -> DataFrame:
    """Add dest, dest_lat, dest_lon, dest_km: the first stop of the callsign's chain, in order, that lies ahead and far enough; rows without one go."""
    spot = airport_codes(airports).where("lat is not null").select("code", F.col("lat").alias("dest_lat"), F.col("lon").alias("dest_lon"))
    stops = routes.select("callsign", F.posexplode("chain").alias("pos", "code")).where("pos >= 1").join(spot, "code")
    j = points.join(stops, "callsign").withColumn("dest_km", geo.haversine("lat", "lon", "dest_lat", "dest_lon"))
    off = F.abs(geo.angle_diff("track", geo.bearing("lat", "lon", "dest_lat", "dest_lon")))
    j = j.where((off <= MAX_OFF_DEG) & (F.col("dest_km") >= MIN_REMAINING_KM))
    return top_k(j, key, [F.col("pos")], 1, "_r").drop("_r", "pos").withColumnRenamed("code", "dest")


def _rad_haversine(a, b, c, d):
    p, q, dl = np.radians(a), np.radians(c), np.radians(d - b)
    return 2 * geo.EARTH_KM * np.arcsin(np.minimum(1.0, np.sqrt(np.sin((q - p) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin(dl / 2) ** 2)))


def _rad_bearing(a, b, c, d):
    p, q, dl = np.radians(a), np.radians(c), np.radians(d - b)
    return np.degrees(np.arctan2(np.sin(dl) * np.cos(q), np.cos(p) * np.sin(q) - np.sin(p) * np.cos(q) * np.cos(dl))) % 360


def _rad_forward(lat, lon, head, km):
    d, h, p = km / geo.EARTH_KM, np.radians(head), np.radians(lat)
    q = np.arcsin(np.sin(p) * np.cos(d) + np.cos(p) * np.sin(d) * np.cos(h))
    l2 = np.radians(lon) + np.arctan2(np.sin(h) * np.sin(d) * np.cos(p), np.cos(d) - np.sin(p) * np.sin(q))
    return np.degrees(q), (np.degrees(l2) + 540) % 360 - 180


def converge(lat, lon, track, gs, dt, dest_lat, dest_lon) -> pd.DataFrame:
    """Hold the track for ten minutes, then turn toward the destination at no more than two degrees a minute.

    All rows step together in half-minute steps; a row that arrives or runs out of time stops."""
    lat, lon, head, gs, dt, tla, tlo = (np.array(x, float) for x in (lat, lon, track, gs, dt, dest_lat, dest_lon))
    speed, t, most = gs * geo.KT_TO_KMS, 0.0, TURN_DEG_PER_MIN * STEP_S / 60
    bad, arrived = ~np.isfinite(lat + lon + head + gs + dt + tla + tlo), np.zeros(len(lat), bool)
    go = np.flatnonzero(~bad & (dt > 0))  # the rows still on their way; only these are worked on
    while len(go):
        step = np.minimum(STEP_S, dt[go] - t)
        there = _rad_haversine(lat[go], lon[go], tla[go], tlo[go]) <= speed[go] * step
        done = go[there]
        lat[done], lon[done], arrived[done] = tla[done], tlo[done], True
        go, step = go[~there], step[~there]
        if t >= HOLD_S:
            turn = (_rad_bearing(lat[go], lon[go], tla[go], tlo[go]) - head[go] + 180) % 360 - 180
            turn = np.where(turn == -180, 180, turn)
            head[go] = (head[go] + np.clip(turn, -most, most)) % 360
        lat[go], lon[go] = _rad_forward(lat[go], lon[go], head[go], speed[go] * step)
        t += STEP_S
        go = go[dt[go] > t]
    left = np.where(arrived, 0.0, _rad_haversine(lat, lon, tla, tlo))
    out = pd.DataFrame({"lat": lat, "lon": lon, "heading": head, "remaining_km": left})
    out[bad] = np.nan
    return out


def project_converge(lat, lon, track, gs, dt_s, dest_lat, dest_lon) -> Column:
    """struct(lat, lon, heading, remaining_km) by the converge method, vectorised over rows."""

    def run(lat: pd.Series, lon: pd.Series, track: pd.Series, gs: pd.Series, dt: pd.Series, dla: pd.Series, dlo: pd.Series) -> pd.DataFrame:
        return converge(lat, lon, track, gs, dt, dla, dlo)

    return F.pandas_udf(run, "lat double, lon double, heading double, remaining_km double")(*[geo.col(c).cast("double") for c in (lat, lon, track, gs, dt_s, dest_lat, dest_lon)])


def project(df: DataFrame, method: str, out: str = "est", dt: str = "dt_s") -> DataFrame:
    """Add struct `out`(lat, lon) of rows with lat, lon, track, gs, dest_lat, dest_lon after `dt` seconds: dr, gc or converge."""
    if method == "dr":
        return df.withColumn(out, geo.project_dr("lat", "lon", "track", "gs", dt))
    if method == "gc":
        return df.withColumn(out, geo.project_gc("lat", "lon", "gs", dt, "dest_lat", "dest_lon"))
    return df.withColumn(out, project_converge("lat", "lon", "track", "gs", dt, "dest_lat", "dest_lon"))


def gaps_of(points: DataFrame, least_s: float = 300) -> DataFrame:
    """Silences as flat rows: hex, lat, lon, alt_ft, gs, track, callsign, t at their start; b at their end; dt_s."""
    p = consecutive_pairs(points).where(F.col("gap_s") >= least_s)
    return p.select("hex", *[F.col(f"a.{c}").alias(c) for c in ("t", "lat", "lon", "alt_ft", "gs", "track", "callsign")], "b", F.col("gap_s").alias("dt_s"))


def backtest_estimator(points: DataFrame, routes: DataFrame, airports: DataFrame, methods: tuple[str, ...] = ("converge", "dr", "gc"), least_s: float = 300) -> tuple[DataFrame, DataFrame]:
    """(funnel, rows): how many gaps pass each gate, and (method, gap_min, error_km) of each estimate that would have been drawn."""
    traces = points.select("hex").distinct().agg(F.count(F.lit(1)).alias("traces"))
    g = gaps_of(points, least_s).withColumn("cruising", cruising())
    routed = pick_destination(g.where("cruising and callsign is not null"), routes, airports, ["hex", "t"])
    est = routed.where(F.col("dt_s") <= geo.horizon_s("gs", "dest_km"))
    same = (F.col("b.alt_ft") >= 10000) & (F.col("b.callsign").isNull() | F.col("callsign").isNull() | (F.col("b.callsign") == F.col("callsign")))
    back = est.where(F.coalesce(same, F.lit(False)))
    counts = g.agg(F.count(F.lit(1)).alias("gaps"), F.count_if("cruising").alias("cruising"))
    e = est.agg(F.count(F.lit(1)).alias("estimated"), F.count_if(~F.coalesce(same, F.lit(False))).alias("landed_or_off"), F.count_if(F.coalesce(same, F.lit(False))).alias("reacquired_en_route"))
    funnel = traces.join(counts).join(routed.agg(F.count(F.lit(1)).alias("routed"))).join(e)
    rows = None
    for m in methods:
        left = geo.haversine("est.lat", "est.lon", "dest_lat", "dest_lon")
        r = project(back, m).where(left >= STOP_BEFORE_KM).select(F.lit(m).alias("method"), "hex", "t", (F.col("dt_s") / 60).alias("gap_min"), geo.haversine("est.lat", "est.lon", "b.lat", "b.lon").alias("error_km"))
        rows = r if rows is None else rows.unionByName(r)
    return funnel, rows


def element_at_share(df: DataFrame, key: list[str], value: str, share: float, out: str) -> DataFrame:
    """The element of number int(n * share), from 0, of each key's sorted values."""
    w = Window.partitionBy(*key)
    r = df.withColumns({"_n": F.row_number().over(w.orderBy(value)) - 1, "_c": F.count(F.lit(1)).over(w)})
    return r.where(F.col("_n") == F.floor(F.col("_c") * share)).select(*key, F.col(value).alias(out))


def estimate_summary(rows: DataFrame) -> DataFrame:
    """Per method: n, median, 75th and 90th of a hundred by element."""
    base = rows.groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.median("error_km").alias("median_km"))
    return base.join(element_at_share(rows, ["method"], "error_km", 0.75, "p75_km"), "method").join(element_at_share(rows, ["method"], "error_km", 0.9, "p90_km"), "method")


def estimate_by_gap(rows: DataFrame, buckets: tuple[tuple[int, int], ...] = BUCKETS) -> DataFrame:
    b = F.lit(None).cast("string")
    for lo, hi in buckets:
        b = F.when((F.col("gap_min") >= lo) & (F.col("gap_min") < hi), f"{lo}-{hi}").otherwise(b)
    return rows.withColumn("bucket", b).where("bucket is not null").groupBy("method", "bucket").agg(F.count(F.lit(1)).alias("n"), F.median("error_km").alias("median_km"))


def direction(track) -> Column:
    t = geo.col(track)
    return F.when(t.between(200, 340), "W").when(t.between(20, 160), "E")


def match_ocean_track(points: DataFrame, tracks: DataFrame, key: list[str], at: str = "t") -> DataFrame:
    """Add `waypoints`: the points still ahead of the published track that an aircraft flies; null if it flies none.

    tracks(direction, east_levels, west_levels, path, valid_from, valid_to); only those in force at the point's instant
    `at` count, a few dozen, which a point meets by its day. Tracks published again in the same words are one."""
    d = direction("track")
    fl = F.round(F.col("alt_ft") / 100.0)
    west = F.col("direction") == "W"
    t = tracks.withColumn("_lv", F.when(west, F.col("west_levels")).otherwise(F.col("east_levels"))).where("size(_lv) > 0")
    ordered = F.when(west, F.reverse(F.array_sort(F.transform("path", lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat")))))).otherwise(F.array_sort(F.transform("path", lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat")))))
    t = t.select(F.col("direction").alias("_way_of"), F.array_min("_lv").alias("_lo"), F.array_max("_lv").alias("_hi"), ordered.alias("pts"), "valid_from", "valid_to").distinct()
    j = tracks_active(t, points.withColumn("direction", d).where(d.isNotNull()), at).where("direction = _way_of").where(fl.between(F.col("_lo") - NAT_LEVEL_SLACK, F.col("_hi") + NAT_LEVEL_SLACK))
    first = F.element_at("pts", 1)
    isw = F.col("direction") == "W"
    before = F.when(isw, F.col("lon") > first["lon"]).otherwise(F.col("lon") < first["lon"])
    dist = geo.haversine("lat", "lon", first["lat"], first["lon"])
    turn = F.abs(geo.angle_diff("track", geo.bearing("lat", "lon", first["lat"], first["lon"])))
    cross = geo.forward("lat", "lon", "track", dist)["lat"]
    off_before = F.when((dist <= 1500) & (turn <= 25) & (F.abs(cross - first["lat"]) <= NAT_MATCH_DEG), F.abs(cross - first["lat"]))
    idx = F.sequence(F.lit(1), F.size("pts") - 1)
    seg = lambda i: (F.element_at("pts", i), F.element_at("pts", i + 1))

    def lat_on(i):
        a, b = seg(i)
        f = (F.col("lon") - a["lon"]) / (b["lon"] - a["lon"])
        inside = F.col("lon").between(F.least(a["lon"], b["lon"]), F.greatest(a["lon"], b["lon"])) & (a["lon"] != b["lon"])
        return F.when(inside, a["lat"] + f * (b["lat"] - a["lat"]))

    on = F.try_element_at(F.array_compact(F.transform(idx, lat_on)), F.lit(1))
    rest = F.filter("pts", lambda p: F.when(isw, p["lon"] < F.col("lon")).otherwise(p["lon"] >= F.col("lon")))
    off_on = F.when((F.abs(F.col("lat") - on) <= NAT_ON_TRACK_DEG) & (F.size(rest) > 0), F.abs(F.col("lat") - on))
    j = j.withColumns({"_off": F.when(before, off_before).otherwise(off_on), "_way": F.when(before, F.col("pts")).otherwise(rest)}).where("_off is not null")
    way = F.transform("_way", lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon")))
    best = j.groupBy(*key).agg(F.min_by(way, F.struct(F.col("_off"), way.alias("way"))).alias("waypoints"))  # of equals the first path
    return points.join(best, key, "left")


def airway_segments(airways: DataFrame) -> DataFrame:
    """Every segment of every airway in both directions, with the points from its end on, and the latitude band and cells it touches."""
    lines = airways.select("airway", F.explode(F.array(F.col("points"), F.reverse("points"))).alias("pts"))
    s = lines.select("airway", "pts", F.explode(F.sequence(F.lit(1), F.size("pts") - 1)).alias("i"))
    flat = lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"))
    return s.select("airway", F.element_at("pts", F.col("i")).alias("a"), F.element_at("pts", F.col("i") + 1).alias("b"), F.transform(F.slice("pts", F.col("i") + 1, F.size("pts")), flat).alias("ahead"))


def match_airway(points: DataFrame, airways: DataFrame, key: list[str], band_deg: float = 2.0) -> DataFrame:
    """Add `waypoints` of the fixed route an aircraft flies, only as far as it leads toward its destination; null if none.

    points carry dest_lat and dest_lon (null: unknown). Segments and points meet by cells of latitude and longitude; a
    segment over the date line, or too near a pole for its longitudes to bound it, is in every cell of its latitudes."""
    band, n = lambda x: F.floor((x + 90) / band_deg).cast("int"), int(360 / LON_CELL)
    column = lambda x: F.floor((x + 180) / LON_CELL).cast("int")
    s = airway_segments(airways).withColumnsRenamed({"a": "_sa", "b": "_sb", "airway": "_airway", "ahead": "_ahead"})
    # a great circle between two points bends toward the nearer pole, by no more than a few degrees on these lengths
    low, high = F.least("_sa.lat", "_sb.lat"), F.greatest("_sa.lat", "_sb.lat")
    s = s.withColumn("_b", F.explode(F.sequence(band(low - F.when(low < 0, 4).otherwise(0.3)), band(high + F.when(high > 0, 4).otherwise(0.3)))))
    west, east = F.least("_sa.lon", "_sb.lon"), F.greatest("_sa.lon", "_sb.lon")
    plain = (east - west <= 180) & (F.greatest(F.abs(low), F.abs(high)) <= 75)
    cells = F.when(plain, F.sequence(column(west - 1), column(east + 1))).otherwise(F.sequence(F.lit(0), F.lit(n - 1)))
    s = s.withColumn("_c", F.explode(F.array_distinct(F.transform(cells, lambda c: F.pmod(c, F.lit(n))))))
    spots = points.select(*key, "lat", "lon", "track", "dest_lat", "dest_lon")
    j = spots.withColumns({"_b": band(F.col("lat")), "_c": F.pmod(column(F.col("lon")), F.lit(n))}).join(s, ["_b", "_c"])
    ca = geo.cross_along("_sa.lat", "_sa.lon", "_sb.lat", "_sb.lon", "lat", "lon")
    j = j.withColumn("_ca", ca).where((F.abs(F.col("_ca.cross_km")) <= AIRWAY_ON_KM) & (F.col("_ca.along_km") >= 0) & (F.col("_ca.along_km") < geo.haversine("_sa.lat", "_sa.lon", "_sb.lat", "_sb.lon")))
    j = j.where(F.abs(geo.angle_diff("track", geo.bearing("lat", "lon", "_sb.lat", "_sb.lon"))) <= AIRWAY_HDG_DEG)
    # keep the points that bring it nearer, one after the other
    start = F.struct(F.array().cast("array<struct<lat:double,lon:double>>").alias("kept"), geo.haversine("lat", "lon", "dest_lat", "dest_lon").alias("last"), F.lit(False).alias("over"))

    def step(acc, p):
        d = geo.haversine(p["lat"], p["lon"], F.col("dest_lat"), F.col("dest_lon"))
        stop = acc["over"] | (d >= acc["last"])
        return F.struct(F.when(stop, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(p))).alias("kept"), F.when(stop, acc["last"]).otherwise(d).alias("last"), stop.alias("over"))

    kept = F.aggregate("_ahead", start, step, lambda acc: acc["kept"])
    here, dest = F.struct(F.col("lat").alias("lat"), F.col("lon").alias("lon")), F.struct(F.col("dest_lat").alias("lat"), F.col("dest_lon").alias("lon"))
    known = F.col("dest_lat").isNotNull()
    j = j.withColumn("_kept", F.when(known, kept).otherwise(F.col("_ahead"))).where("size(_kept) > 0")
    flown = geo.path_km(F.concat(F.array(here), F.col("_kept"), F.array(dest)))
    j = j.where(~known | (flown <= AIRWAY_DETOUR * geo.haversine("lat", "lon", "dest_lat", "dest_lon")))
    best = j.groupBy(*key).agg(F.min_by("_kept", F.struct(F.abs(F.col("_ca.cross_km")), "_airway")).alias("waypoints"))
    return points.join(best, key, "left")


def compare_paths(gaps: DataFrame) -> DataFrame:
    """Gaps with dest and waypoints: error of the current method and along the path (the current one where there is no path)."""
    g = project(gaps, "converge", "now")
    dest = F.struct(F.col("dest_lat").alias("lat"), F.col("dest_lon").alias("lon"))
    path = geo.project_path("lat", "lon", "track", "gs", "dt_s", F.concat(F.col("waypoints"), F.array(dest)))
    g = g.withColumn("_p", path)
    err = lambda la, lo: geo.haversine(la, lo, "b.lat", "b.lon")
    now = err("now.lat", "now.lon")
    matched = F.col("waypoints").isNotNull()
    return g.select("hex", "t", (F.col("dt_s") / 60).alias("gap_min"), matched.alias("matched"), now.alias("now_km"), F.when(matched, err("_p.lat", "_p.lon")).otherwise(now).alias("path_km"))


def backtest_ocean_tracks(points: DataFrame, routes: DataFrame, airports: DataFrame, tracks: DataFrame) -> DataFrame:
    """Errors over North Atlantic gaps of aircraft that crossed, now and along the published track in force when the gap
    began; gaps outside all validity are in the rows, unmatched. tracks(valid_from, valid_to epoch seconds, ...)."""
    from aerolith.operators.filters import crossed_ocean, ocean_gaps_nat

    pairs = ocean_gaps_nat(consecutive_pairs(points.join(crossed_ocean(points), "hex")))
    g = pairs.select("hex", *[F.col(f"a.{c}").alias(c) for c in ("t", "lat", "lon", "alt_ft", "gs", "track", "callsign")], "b", F.col("gap_s").alias("dt_s"))
    g = pick_destination(g, routes, airports, ["hex", "t"])
    return compare_paths(match_ocean_track(g.where("track is not null and gs > 0"), tracks, ["hex", "t"]))


def backtest_airways(points: DataFrame, routes: DataFrame, airports: DataFrame, airways: DataFrame) -> DataFrame:
    """Errors over Pacific gaps, now and along the fixed airways, with each crossing's kind."""
    from aerolith.operators.filters import ocean_gaps_pac, pacific_kind

    pairs = ocean_gaps_pac(consecutive_pairs(points))
    g = pairs.select("hex", *[F.col(f"a.{c}").alias(c) for c in ("t", "lat", "lon", "alt_ft", "gs", "track", "callsign")], "b", F.col("gap_s").alias("dt_s"))
    g = pick_destination(g, routes, airports, ["hex", "t"])
    return compare_paths(match_airway(g, airways, ["hex", "t"])).join(pacific_kind(points), "hex", "left")


def path_summary(rows: DataFrame, worst: int = 5) -> tuple[DataFrame, DataFrame]:
    """(summary, the gaps where the path did worst): medians of both ways, of all gaps and of the matched, and how often the path was better."""
    m = F.when(F.col("matched"), F.col("path_km"))
    s = rows.agg(F.count(F.lit(1)).alias("n"), F.median("now_km").alias("now_km"), F.median("path_km").alias("path_km"), F.count_if("matched").alias("matched"), F.median(F.when(F.col("matched"), F.col("now_km"))).alias("matched_now_km"), F.median(m).alias("matched_path_km"), F.count_if(F.col("matched") & (F.col("path_km") < F.col("now_km"))).alias("path_better"))
    return s, rows.where("matched").orderBy(F.desc(F.col("path_km") - F.col("now_km")), "hex", "t").limit(worst)


def path_by_kind(rows: DataFrame, bins: tuple[tuple[str, int, int], ...] = (("0.3-1h", 0, 60), ("1-3h", 60, 180), ("3-6h", 180, 360), ("6-8h", 360, 480), ("8h+", 480, 10**9))) -> DataFrame:
    """Medians by kind of crossing and by length of gap."""
    b = F.lit(None).cast("string")
    for name, lo, hi in bins:
        b = F.when((F.col("gap_min") >= lo) & (F.col("gap_min") < hi), name).otherwise(b)
    return rows.withColumn("bin", b).groupBy("kind", "bin").agg(F.count(F.lit(1)).alias("n"), F.median("now_km").alias("now_km"), F.median("path_km").alias("path_km"))

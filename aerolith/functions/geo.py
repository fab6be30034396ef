"""Geometry on the sphere as Column expressions; no Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Earth radii in use.
EARTH_NM = 3440.065
EARTH_KM = 6371.0088
EARTH_KM_ROUND = 6371.0
KT_TO_KMS = 1.852 / 3600


def col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def _held(x: Column) -> Column:
    """Held between -1 and 1; null stays null (least and greatest would pass it over)."""
    return F.when(x > 1, F.lit(1.0)).when(x < -1, F.lit(-1.0)).otherwise(x)


def haversine(lat1, lon1, lat2, lon2, radius: float = EARTH_KM) -> Column:
    """Great-circle distance; the root is held at 1 or below."""
    lat1, lon1, lat2, lon2 = map(col, (lat1, lon1, lat2, lon2))
    a = F.pow(F.sin((F.radians(lat2) - F.radians(lat1)) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.asin(_held(F.sqrt(a))) * (2 * radius)


def bearing(lat1, lon1, lat2, lon2) -> Column:
    """Initial bearing in [0, 360). The turns added are two, so that what is left of a sine of zero does not make due north 359.99…."""
    lat1, lon1, lat2, lon2 = map(col, (lat1, lon1, lat2, lon2))
    p1, p2, dl = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    y = F.sin(dl) * F.cos(p2)
    x = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl)
    return F.pmod(F.degrees(F.atan2(y, x)) + 720.0, F.lit(360.0))


def forward(lat, lon, heading, km) -> Column:
    """struct(lat, lon) reached after `km` along an initial heading."""
    lat, lon, heading, km = map(col, (lat, lon, heading, km))
    d, h, p1 = km / EARTH_KM, F.radians(heading), F.radians(lat)
    p2 = F.asin(F.sin(p1) * F.cos(d) + F.cos(p1) * F.sin(d) * F.cos(h))
    turn = F.atan2(F.sin(h) * F.sin(d) * F.cos(p1), F.cos(d) - F.sin(p1) * F.sin(p2))
    return F.struct(F.degrees(p2).alias("lat"), (F.pmod(F.degrees(F.radians(lon) + turn) + 540.0, F.lit(360.0)) - 180.0).alias("lon"))


def angle_diff(a, b) -> Column:
    """Signed smallest turn from a to b, in (-180, 180]."""
    d = F.pmod(col(b) - col(a) + 540.0, F.lit(360.0)) - 180.0
    return F.when(d == -180.0, F.lit(180.0)).otherwise(d)


def angle_between(a, b) -> Column:
    return F.abs(F.pmod(col(a) - col(b) + 180.0 + 720.0, F.lit(360.0)) - 180.0)


def cross_along(lat1, lon1, lat2, lon2, lat, lon) -> Column:
    """struct(cross_km, along_km) of a point from the great circle through two others; along is negative behind the first."""
    d13 = haversine(lat1, lon1, lat, lon) / EARTH_KM
    t = F.radians(bearing(lat1, lon1, lat, lon)) - F.radians(bearing(lat1, lon1, lat2, lon2))
    cross = F.asin(_held(F.sin(d13) * F.sin(t)))
    along = F.acos(_held(F.cos(d13) / F.greatest(F.lit(1e-12), F.cos(cross))))
    return F.struct((cross * EARTH_KM).alias("cross_km"), (F.when(F.cos(t) < 0, -along).otherwise(along) * EARTH_KM).alias("along_km"))


def in_bbox(lat, lon, west, south, east, north) -> Column:
    """Inclusive box; one with west > east crosses the antimeridian; a null position is outside."""
    lat, lon, w, s, e, n = map(col, (lat, lon, west, south, east, north))
    inside = F.when(w <= e, lon.between(w, e)).otherwise((lon >= w) | (lon <= e))
    return F.coalesce(lat.between(s, n) & inside, F.lit(False))


def valid_bbox(west, south, east, north) -> Column:
    w, s, e, n = map(col, (west, south, east, north))
    return F.coalesce(w.between(-180, 180) & e.between(-180, 180) & s.between(-90, 90) & n.between(-90, 90) & (s <= n), F.lit(False))


def cell(lat, lon, degrees: int = 1) -> Column:
    """Row-major number of a grid cell."""
    lat, lon, columns = col(lat), col(lon), 360 // degrees
    row = F.least(F.floor((lat + 90) / degrees), F.lit(180 // degrees - 1))
    return (row * columns + F.pmod(F.floor((lon + 180) / degrees), F.lit(columns))).cast("int")


def path_km(points) -> Column:
    """Length of an array of struct(lat, lon) along great circles."""
    start = F.struct(F.lit(0.0).alias("km"), F.lit(None).cast("struct<lat:double,lon:double>").alias("p"))
    step = lambda acc, p: F.struct((acc["km"] + F.coalesce(haversine(acc["p"]["lat"], acc["p"]["lon"], p["lat"], p["lon"]), F.lit(0.0))).alias("km"), F.struct(p["lat"].alias("lat"), p["lon"].alias("lon")).alias("p"))
    return F.aggregate(col(points), start, step, lambda acc: acc["km"])


def horizon_s(gs, remaining_km, *, stop_km: float = 150, slack: float = 1.1, most_s: float = 8 * 3600, least_kt: float = 250) -> Column:
    """How long an estimate may run before the aircraft would be `stop_km` out."""
    speed = F.greatest(col(gs), F.lit(float(least_kt))) * KT_TO_KMS
    return F.least(F.lit(float(most_s)), F.greatest(F.lit(0.0), col(remaining_km) - stop_km) / speed * slack)


def project_dr(lat, lon, track, gs, dt_s) -> Column:
    """Dead reckoning: hold the last track and speed."""
    return forward(lat, lon, track, col(gs) * KT_TO_KMS * col(dt_s))


def project_gc(lat, lon, gs, dt_s, dest_lat, dest_lon) -> Column:
    """Straight along the great circle to the destination, not past it."""
    total = haversine(lat, lon, dest_lat, dest_lon)
    return forward(lat, lon, bearing(lat, lon, dest_lat, dest_lon), F.least(col(gs) * KT_TO_KMS * col(dt_s), total))


def project_path(lat, lon, track, gs, dt_s, waypoints) -> Column:
    """struct(lat, lon, heading, remaining_km) after flying through an array of struct(lat, lon) at the last speed."""
    kind = "struct<lat:double,lon:double,heading:double,left:double,remaining_km:double,over:boolean>"
    start = F.struct(col(lat).cast("double").alias("lat"), col(lon).cast("double").alias("lon"), col(track).cast("double").alias("heading"), (col(gs) * KT_TO_KMS * col(dt_s)).cast("double").alias("left"), F.lit(0.0).alias("remaining_km"), F.lit(False).alias("over")).cast(kind)

    def step(a, p):
        seg = haversine(a["lat"], a["lon"], p["lat"], p["lon"])
        head = F.when(seg > 0.5, bearing(a["lat"], a["lon"], p["lat"], p["lon"])).otherwise(a["heading"])
        stop = forward(a["lat"], a["lon"], head, a["left"])
        ends = a["left"] < seg
        here = F.struct(stop["lat"].alias("lat"), stop["lon"].alias("lon"), head.alias("heading"), F.lit(0.0).alias("left"), haversine(stop["lat"], stop["lon"], p["lat"], p["lon"]).alias("remaining_km"), F.lit(True).alias("over"))
        on = F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"), head.alias("heading"), (a["left"] - seg).alias("left"), F.lit(0.0).alias("remaining_km"), F.lit(False).alias("over"))
        further = F.struct(a["lat"], a["lon"], a["heading"], a["left"], a["remaining_km"], a["over"])
        return F.when(a["over"], further).when(ends, here).otherwise(on).cast(kind)

    flown = F.aggregate(col(waypoints), start, step)
    # what is left beyond the segment flown is the path's length after the waypoint ahead
    return flown


def dms(text) -> Column:
    """Degrees from digits for degrees, minutes and seconds and a hemisphere letter: 512839N, 0002741W, 51-28-39.5N."""
    t = F.regexp_replace(F.upper(F.trim(col(text))), r"[\s°'\"-]", "")
    part = lambda i: F.regexp_extract(t, r"^(\d{2,3})(\d{2})(\d{2}(?:\.\d+)?)([NSEW])$", i)
    value = part(1).cast("double") + part(2).cast("double") / 60 + part(3).cast("double") / 3600
    return F.when(t.rlike(r"^\d{6,7}(\.\d+)?[NSEW]$"), F.when(part(4).isin("S", "W"), -value).otherwise(value))

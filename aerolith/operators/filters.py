"""Filters and predicates over positions, legs and traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolith import schemas
from aerolith.functions import geo
from aerolith.functions.geo import col
from aerolith.operators.cut import checkpointed

# Transponder codes and states that signal an emergency, and those that are held back.
CODES = ("7500", "7600", "7700")
STATES = ("general", "lifeguard", "minfuel", "nordo", "unlawful", "downed")
HELD = ("7500", "unlawful")


def allowlist(df: DataFrame) -> DataFrame:
    """Only the public fields."""
    return df.select(*[c for c in schemas.PUBLIC_FIELDS if c in df.columns])


def within_radius(df: DataFrame, lat: float, lon: float, nm: float, most_nm: float = 250) -> DataFrame:
    """Positions within a radius, nearest first, with `dst` in nm to 0.1. A latitude band prunes the scan."""
    r = min(nm, most_nm)
    band = r / 60 + 0.1
    near = df.where(F.col("lat").between(lat - band, lat + band) & F.col("lon").isNotNull())
    exact = near.withColumn("_d", geo.haversine(F.lit(lat), F.lit(lon), "lat", "lon", geo.EARTH_NM)).where(F.col("_d") <= r)
    return exact.withColumn("dst", F.bround("_d", 1)).drop("_d").orderBy("dst", "hex")


def fresh(df: DataFrame, now: Column, stale_s: float = 60) -> DataFrame:
    """Rows whose last message is at most `stale_s` old: its own age plus what has passed since."""
    return df.where(F.coalesce("seen", F.lit(0.0)) + (now.cast("double") - F.col("ts").cast("double")) <= stale_s)


def valid_leg() -> Column:
    return F.coalesce((F.col("org") != F.col("dst")), F.lit(False))


def plausible_leg(least_s: int = 600) -> Column:
    """A valid leg between codes of 3 or 4 letters that lasted at least ten minutes where both ends are timed."""
    codes = F.length("org").between(3, 4) & F.length("dst").between(3, 4)
    return valid_leg() & codes & F.coalesce(F.col("arr_ts") - F.col("dep_ts") >= least_s, F.lit(True))


def not_circuit() -> Column:
    """One-sided legs count; a leg back to where it began does not."""
    return F.coalesce(F.col("dst") != F.col("org"), F.col("dst").isNull())


def callsign_prefix(legs: DataFrame, prefix: str, k: int = 10) -> DataFrame:
    """Callsigns with a prefix, busiest first: flights and last day."""
    rows = legs.where(F.col("callsign").startswith(prefix)).groupBy("callsign").agg(F.count(F.lit(1)).alias("flights"), F.max("date").alias("last"))
    return rows.orderBy(F.desc("flights"), "callsign").limit(k)


def public_only(events: DataFrame) -> DataFrame:
    return events.where(F.col("visibility") == "public")


def gap_page_filter(gaps: DataFrame, airline: str | None = None, side: str | None = None, exclude: DataFrame | None = None) -> DataFrame:
    out = gaps if airline is None else gaps.where(F.col("callsign").startswith(airline))
    out = out if side is None else out.where(F.col("side") == side)
    return out if exclude is None else out.join(exclude.select("callsign"), "callsign", "left_anti")


def live_by_callsign(sky: DataFrame, keys: DataFrame) -> DataFrame:
    """Aircraft flying under the asked callsigns; case does not matter. keys(callsign)."""
    asked = keys.select(F.upper(F.trim("callsign")).alias("_cs")).distinct()
    return sky.join(asked, F.upper(F.trim("flight")) == F.col("_cs")).drop("_cs")


def cruising(alt="alt_ft", gs="gs", track="track", lat="lat", lon="lon", *, least_ft: int = 18000, least_kt: float = 250) -> Column:
    """High, fast, and with track and position."""
    return F.coalesce((col(alt) >= least_ft) & (col(gs) >= least_kt), F.lit(False)) & col(track).isNotNull() & col(lat).isNotNull() & col(lon).isNotNull()


def crossed_ocean(points: DataFrame, least_ft: int = 25000) -> DataFrame:
    """Aircraft seen high on both sides of the North Atlantic."""
    c = points.where((F.col("alt_ft") >= least_ft) & F.col("lat").between(40, 70))
    return c.groupBy("hex").agg(F.bool_or(F.col("lon") > -15).alias("e"), F.bool_or(F.col("lon") < -50).alias("w")).where("e and w").select("hex")


def pacific_kind(points: DataFrame, least_ft: int = 25000) -> DataFrame:
    """hex and kind: south, transpacific, hawaii or null, from where its high points lie."""
    p = points.where(F.col("alt_ft") >= least_ft)
    tests = {"coast": "lon between -135 and -115", "south": "lat < -10", "asia": "lon >= 135 and lat > 0", "alaska": "lat > 50 and lon < -140", "hawaii": "lat between 18 and 23 and lon between -161 and -154"}
    seen = p.groupBy("hex").agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.bool_or(F.expr(v)), F.lit(False)).alias(k) for k, v in tests.items()])
    kind = F.when(F.col("n") < 2, None).when(F.expr("coast and south"), "south").when(F.expr("asia and (coast or alaska)"), "transpacific").when(F.expr("coast and hawaii"), "hawaii")
    return seen.select("hex", kind.alias("kind"))


def ocean_gaps_nat(pairs: DataFrame, least_s: float = 1200, least_ft: int = 25000) -> DataFrame:
    """Silences over the North Atlantic between two high points at least five degrees of longitude apart. pairs(a, b, gap_s)."""
    high = F.least("a.alt_ft", "b.alt_ft") >= least_ft
    both = F.col("a.alt_ft").isNotNull() & F.col("b.alt_ft").isNotNull() & high & F.col("a.lat").between(40, 70) & F.col("b.lat").between(40, 70)
    wide = (F.abs(F.col("a.lon") - F.col("b.lon")) >= 5) & (F.greatest("a.lon", "b.lon") <= 5) & (F.least("a.lon", "b.lon") >= -75)
    return pairs.where((F.col("gap_s") >= least_s) & both & wide)


def ocean_gaps_pac(pairs: DataFrame, least_s: float = 1200, least_ft: int = 25000) -> DataFrame:
    """Silences between two high points whose implied speed is 300 to 650 kt and whose middle lies over the Pacific."""
    km = geo.haversine("a.lat", "a.lon", "b.lat", "b.lon")
    kt = km / (F.col("gap_s") / 3600) / 1.852
    high = (F.col("a.alt_ft") >= least_ft) & (F.col("b.alt_ft") >= least_ft)
    out = pairs.where((F.col("gap_s") >= least_s) & high & kt.between(300, 650))
    out = out.withColumn("_m", geo.forward("a.lat", "a.lon", geo.bearing("a.lat", "a.lon", "b.lat", "b.lon"), km / 2))
    return out.where(F.col("_m.lat").between(-60, 66) & ((F.col("_m.lon") >= 125) | (F.col("_m.lon") <= -118))).drop("_m")


def _cells(west: float, south: float, side: float) -> Column:
    return F.struct(F.floor(F.pmod(F.col("lon") - west, F.lit(360.0)) / side).alias("x"), F.floor((F.col("lat") - south) / side).alias("y"))


def first_per_cell(df: DataFrame, west: float, south: float, side: float) -> DataFrame:
    """The first aircraft (by hex) of each cell."""
    best = df.groupBy(_cells(west, south, side).alias("_c")).agg(F.min_by(F.struct(*df.columns), "hex").alias("_r"))
    return best.select("_r.*")


def thin_wide(df: DataFrame, west: float, south: float, east: float, north: float, cells: int = 60) -> DataFrame:
    """One aircraft per cell of a sixtieth of the box's longer side."""
    span = (east - west) % 360 or 360.0
    return first_per_cell(df.where(geo.in_bbox("lat", "lon", west, south, east, north)), west, south, max(span, (north - south) * 1.5) / cells)


STEPS = 8


def _grid_sides(fits: float) -> list[float]:
    """The cell sides that STEPS bisections between `fits` and a sixteenth of it can end on, the largest first."""
    n = 1 << STEPS
    return [fits * 16 ** (-k / n) for k in range(n)]


def _occupied(west: float, south: float, sides: list[float], most: int):
    """Per partition: for each side the occupied cells, `most` + 1 of them at most (so many do not fit anyway)."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        cells = [np.zeros(0, np.int64)] * len(sides)
        for batch in batches:
            lon, lat = (batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (0, 1))
            for k, side in enumerate(sides):
                if len(cells[k]) <= most:
                    x, y = np.floor(np.mod(lon - west, 360.0) / side).astype(np.int64), np.floor((lat - south) / side).astype(np.int64)
                    cells[k] = np.unique(np.concatenate([cells[k], x << 32 | y & 0xFFFFFFFF]))[: most + 1]
        for k, own in enumerate(cells):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), k, np.int32)), pa.array(own)], names=["k", "cell"])

    return run


def grid_side(df: DataFrame, west: float, south: float, east: float, north: float, most: int) -> DataFrame:
    """One row (side, n): the cell side that bisection finds for the rows of the box, and how many rows there are up to
    `most` + 1. All sides are counted in one pass over the rows; steps of the bisection are then looked up."""
    span, tall = (east - west) % 360 or 360.0, north - south
    sides = _grid_sides(max(0.01, (span * tall / most) ** 0.5))
    found = df.select(F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat")).mapInArrow(_occupied(west, south, sides, most), "k int, cell long")
    counts = found.groupBy("k").agg(F.countDistinct("cell").alias("n")).agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("n"))
    at = F.lit(0)
    for step in range(STEPS):  # each step goes on to finer cells if those still fit
        ahead = at + (1 << (STEPS - 1 - step))
        at = at + F.when(F.coalesce(F.try_element_at("n", ahead), F.lit(0)) <= most, 1 << (STEPS - 1 - step)).otherwise(0)
        counts = counts.withColumn("at", at)
        at = F.col("at")
    return counts.select(F.get(F.array(*map(F.lit, sides)), F.col("at")).alias("side"))


def thin_to_grid(df: DataFrame, west: float, south: float, east: float, north: float, most: int = 1000, wide_deg: float = 60) -> DataFrame:
    """All aircraft of a box if they fit; a fixed grid for a wide box; else the finest grid whose occupied cells fit, by eight bisections."""
    span = (east - west) % 360 or 360.0
    if span > wide_deg:
        return thin_wide(df, west, south, east, north)
    inside = df.where(geo.in_bbox("lat", "lon", west, south, east, north))
    number = inside.agg(F.count(F.lit(1)).alias("_n"))
    one = grid_side(inside, west, south, east, north, most).crossJoin(number)  # one row with one row
    every = inside.join(F.broadcast(one))
    kept = every.where(F.col("_n") <= most).select(*df.columns)
    dense = every.where(F.col("_n") > most)
    best = dense.groupBy(_cells(west, south, F.col("side")).alias("_c")).agg(F.min_by(F.struct(*df.columns), "hex").alias("_r")).select("_r.*")
    return kept.unionByName(best)


def query_shape(queries: DataFrame, q: str = "q") -> DataFrame:
    """Add which kinds a query may mean: aircraft, flight, airport, airline, pair."""
    c = F.regexp_replace(q, "[ -]", "")
    n, digit, alpha, words = F.length(c), c.rlike("[0-9]"), c.rlike(r"^\p{L}+$"), F.size(F.split(q, " "))
    name = alpha & n.between(2, 40)
    return queries.withColumns({"is_aircraft": digit | F.col(q).contains("-") | (n <= 6), "is_flight": (n >= 3) & F.substring(c, 1, 2).rlike(r"^\p{L}{2}$") & (digit | (n <= 4)) & (words == 1), "is_airport": name, "is_airline": name, "is_pair": words == 2})


def schedule_gate(schedule: DataFrame, min_flights: int = 5) -> DataFrame:
    return schedule.where(F.col("n_flights") >= min_flights)


def signal_code() -> Column:
    return F.when(F.col("squawk").isin(*CODES), F.col("squawk"))


def signal_state() -> Column:
    return F.when(F.col("emergency").isin(*STATES), F.col("emergency"))


def emergency_signal() -> Column:
    return signal_code().isNotNull() | signal_state().isNotNull()

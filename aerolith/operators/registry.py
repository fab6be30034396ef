"""Registries and airframe records: precedence merge, spells, claims, occurrences, address blocks, zones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolith.functions import geo
from aerolith.functions import text as tx
from aerolith.operators.aggregates import airline_countries, airport_codes, same_aircraft_candidates
from aerolith.operators.cut import checkpointed
from aerolith.operators.windows import not_observed_events, quiet_spells, ranked_overall, top_k

# Which source outranks which, the fields a merge decides, and those only observation knows.
SOURCE_RANK = {"receiver-dump": 0, "tar1090": 1, "registry": 2, "override": 3}
MERGE_FIELDS = ("registration", "type_code", "operator_name", "operator_norm", "operator_icao", "year", "flags")
OBSERVED = {"receiver-dump": ("operator_icao",)}
MOST_SENT = 200_000  # rows of a table that a join sends to every task


def merge_airframes(existing: DataFrame, incoming: DataFrame, source: str) -> DataFrame:
    """Merge one source's rows into the registry.

    A source of equal or higher rank overwrites with what it knows, a lower one only fills what is missing; an observed
    operator always replaces. A row's source moves only when it is not outranked and something changed."""
    rank = F.create_map(*[x for k, v in SOURCE_RANK.items() for x in (F.lit(k), F.lit(v))])
    new = incoming.dropDuplicates(["hex"]).select("hex", *[F.col(f).alias(f"_{f}") for f in MERGE_FIELDS], F.lit(True).alias("_in"))
    j = existing.join(new, "hex", "full_outer")
    fresh = F.col("source").isNull()
    outranked = F.lit(SOURCE_RANK[source]) < F.coalesce(F.try_element_at(rank, F.col("source")), F.lit(0))
    out, changed = {}, F.lit(False)
    for f in MERGE_FIELDS:
        n, o = F.col(f"_{f}"), F.col(f)
        fills = n.isNotNull() & (fresh | ~outranked | o.isNull() | F.lit(f in OBSERVED.get(source, ())))
        out[f] = F.when(fills, n).otherwise(o)
        changed = changed | (fills & ~n.eqNullSafe(o))
    moved = F.col("_in").isNotNull() & (fresh | (~outranked & changed))
    return j.select("hex", *[e.alias(f) for f, e in out.items()], F.when(moved, F.lit(source)).otherwise(F.col("source")).alias("source"))


def merge_all(existing: DataFrame, sources: dict[str, DataFrame]) -> DataFrame:
    """Merge several sources, lowest rank first."""
    for name in sorted(sources, key=SOURCE_RANK.__getitem__):
        existing = merge_airframes(existing, sources[name], name)
    return existing


def derive(routes: DataFrame, airlines: DataFrame, airports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Routes with their airline, and routes per airline and country."""
    named = routes.withColumn("_p", F.substring("callsign", 1, 3)).join(airlines.select(F.col("icao").alias("_p"), F.col("icao").alias("airline_icao")), "_p", "left").drop("_p")
    return named, airline_countries(routes, airlines, airports)


def catalog_current(catalog: DataFrame, asof: Column) -> DataFrame:
    """The row in force for each callsign on a day: valid from it on or before, and not ended; the newest of several."""
    held = catalog.where((F.col("valid_from") <= asof) & (F.col("valid_to").isNull() | (F.col("valid_to") > asof)))
    tie = [F.col(c).desc_nulls_last() for c in ("claim_id",) if c in catalog.columns]
    return top_k(held, ["callsign"], [F.desc("valid_from"), *tie, F.col("origin"), F.col("dest")], 1, "_r").drop("_r")


def tracks_active(messages: DataFrame, points: DataFrame, at: str = "ts", lots: int | None = None) -> DataFrame:
    """Points with the track messages in force at their instant, both ends included; valid_from, valid_to and `at` are all
    timestamps or all epoch seconds. Points meet periods by the UTC days that a period touches, a few each; what is in
    force for the same period goes along as arrays of up to a thousand messages, unpacked after the exact test, so that
    neither messages nor points are copied or sorted once more for each other.

    A result that is written whole names `lots`: each day's points are dealt to so many lots, and up to 256 that follow
    each other in time travel as one row, which meets each array of messages once. All its points come out before the next
    array does, so the same messages follow each other again and again and take a tenth of the space in columns; arrays
    are of 256 too, which columns pack without a shift. The exact test is made in the array of points, whose filter Spark
    runs row by row: unpacked in one loop with the join, a pack's rows would all be held at once. Messages are copied to
    every lot; nothing is broadcast."""
    stamps = dict(messages.dtypes)["valid_from"].startswith("timestamp")
    day = lambda c: F.floor((F.unix_seconds(c.cast("timestamp")) if stamps else c) / 86400).cast("long")
    period = ["valid_from", "valid_to"]
    rest = [c for c in messages.columns if c not in period]
    part = F.floor((F.row_number().over(Window.partitionBy(*period).orderBy(*period)) - 1) / (256 if lots else 1000))
    m = messages.where("valid_from <= valid_to").withColumn("_part", part).groupBy(*period, "_part").agg(F.collect_list(F.struct(*rest)).alias("_m")).drop("_part")
    m = m.withColumn("_day", F.explode(F.sequence(day(F.col("valid_from")), day(F.col("valid_to")))))
    p = points.withColumn("_day", day(F.col(at)))
    in_force = lambda t: t.between(F.col("valid_from"), F.col("valid_to"))
    if lots:
        tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few points are many rows: tasks are not merged
        p = p.withColumn("_lot", F.pmod(F.xxhash64(at, F.spark_partition_id()), F.lit(lots)).cast("int")).repartition(tasks, "_day", "_lot")
        p = p.withColumn("_part", F.floor((F.row_number().over(Window.partitionBy("_day", "_lot").orderBy(at)) - 1) / 256))
        p = p.groupBy("_day", "_lot", "_part").agg(F.min(at).alias("_first"), F.max(at).alias("_last"), F.collect_list(F.struct(*points.columns)).alias("_p"))
        m = m.withColumn("_lot", F.explode(F.sequence(F.lit(0), F.lit(lots - 1)))).hint("merge")
        j = p.join(m, ["_day", "_lot"]).where("_first <= valid_to and valid_from <= _last")
        j = j.select(*period, "_m", F.inline(F.filter("_p", lambda x: in_force(x[at]))))
    else:
        j = p.join(m, "_day").where(in_force(F.col(at)))
    j = j.select(*points.columns, *period, F.explode("_m").alias("_m"))
    return j.select(*points.columns, *[c if c in period else F.col(f"_m.{c}").alias(c) for c in messages.columns])


def airframe_of_hex(spells: DataFrame) -> DataFrame:
    """(hex, airframe_id) by the newest hex spell."""
    return spells.where("kind = 'hex'").groupBy(F.col("value").alias("hex")).agg(F.max_by("airframe_id", F.struct("first_date", "airframe_id")).alias("airframe_id"))


def attach_occurrences(occurrences: DataFrame, spells: DataFrame, slack: int = 30) -> DataFrame:
    """Occurrences on the airframe that bore the mark then, within `slack` days; the last detail per airframe and instant.

    occurrences(registration, at, number, ...). Each airframe's time is cut where its marks begin and end, and occurrences
    are brought to one per instant and set of marks that some airframe bore at once. The two meet by that set, each row
    once, so a mark with many occurrences on many airframes is never expanded to all pairs and sorted out after."""
    far = 2**31  # beyond all days; an occurrence without a day lies before even that and fits spells open at both ends only
    open_both = F.col("first_date").isNull() & F.col("last_date").isNull()
    lo = F.when(open_both, F.lit(-far - 1)).otherwise(F.coalesce(F.unix_date(F.date_sub("first_date", slack)).cast("long"), F.lit(-far)))
    end = F.coalesce(F.unix_date(F.date_add("last_date", slack)).cast("long"), F.lit(far)) + 1
    s = spells.where("kind = 'registration'").select("airframe_id", tx.norm_reg("value").alias("reg"), lo.alias("lo"), end.alias("end")).where("reg is not null and lo < end")
    own = s.groupBy("airframe_id").agg(F.collect_list(F.struct("reg", "lo", "end")).alias("s"))
    own = own.withColumn("cuts", F.array_sort(F.array_distinct(F.flatten(F.transform("s", lambda x: F.array(x["lo"], x["end"]))))))
    parts = own.select("airframe_id", "s", F.explode(F.arrays_zip(F.slice("cuts", F.lit(1), F.size("cuts") - 1).alias("lo"), F.slice("cuts", F.lit(2), F.size("cuts") - 1).alias("end"))).alias("p"))
    borne = F.transform(F.filter("s", lambda x: (x["lo"] <= F.col("p.lo")) & (F.col("p.end") <= x["end"])), lambda x: x["reg"])
    parts = parts.select("airframe_id", F.col("p.lo").alias("_lo"), F.col("p.end").alias("_end"), F.array_sort(F.array_distinct(borne)).alias("_regs")).where("size(_regs) > 0")
    last = top_k(occurrences.withColumn("_reg", tx.norm_reg("registration")).where("_reg is not null"), ["_reg", "at"], [F.desc("number")], 1, "_r").drop("_r")
    sets = parts.select("_regs").distinct().withColumn("_reg", F.explode("_regs"))
    best = top_k(sets.join(last, "_reg"), ["_regs", "at"], [F.desc("number")], 1, "_r").drop("_r", "_reg")
    best = checkpointed(best.withColumn("_day", F.coalesce(F.unix_date(F.to_date("at")).cast("long"), F.lit(-far - 1))))
    if best.count() <= MOST_SENT:
        best = F.broadcast(best)
    j = best.join(parts, "_regs").where((F.col("_lo") <= F.col("_day")) & (F.col("_day") < F.col("_end")))
    return j.drop("_regs", "_day", "_lo", "_end")


def disjoint_blocks(blocks: DataFrame) -> DataFrame:
    """Nested blocks(lo, hi, state), hi inclusive, as disjoint intervals, each with the smallest block over it.

    For a table that fits one task; `state_of_hex` asks its size first."""
    cuts = blocks.select(F.explode(F.array("lo", F.col("hi") + 1)).alias("lo")).distinct()
    parts = cuts.withColumn("hi", F.lead("lo").over(Window.orderBy("lo")) - 1).where("hi is not null")
    b = blocks.select(F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi"), "state")
    over = parts.join(b, (F.col("b_lo") <= F.col("lo")) & (F.col("hi") <= F.col("b_hi")))
    return over.groupBy("lo", "hi").agg(F.min_by("state", F.struct(F.col("b_hi") - F.col("b_lo"), "state")).alias("state"))


def state_of_hex(df: DataFrame, blocks: DataFrame, most_blocks: int = 10_000) -> DataFrame:
    """Add `state` of 24-bit addresses by the smallest block that holds them; null outside all.

    Blocks are a fixed international table. Up to `most_blocks` of them are cut into disjoint intervals and broadcast; a
    larger table meets the distinct addresses by aligned cells of about an eighth of a block's size."""
    address = F.conv("hex", 16, 10).cast("long")
    if blocks.count() <= most_blocks:
        flat = disjoint_blocks(blocks).withColumnsRenamed({"lo": "_lo", "hi": "_hi", "state": "_state"})
        j = df.withColumn("_a", address).join(F.broadcast(flat), F.col("_a").between(F.col("_lo"), F.col("_hi")), "left")
        return j.withColumn("state", F.col("_state")).drop("_a", "_lo", "_hi", "_state")
    width = F.floor(F.log2(F.col("hi") - F.col("lo") + 1.0)).cast("int")
    level = F.greatest(width - 3, F.lit(0))  # a block touches at most 17 cells of an eighth of its size
    cells = blocks.withColumn("_l", level).withColumn("_c", F.explode(F.sequence(F.expr("shiftright(lo, _l)"), F.expr("shiftright(hi, _l)"))))
    asked = df.select("hex").distinct().withColumn("_a", address)
    at = asked.withColumn("_l", F.explode(F.sequence(F.lit(0), F.lit(24)))).withColumn("_c", F.expr("shiftright(_a, _l)"))
    held = at.join(cells, ["_l", "_c"]).where(F.col("_a").between(F.col("lo"), F.col("hi")))
    best = held.groupBy("hex").agg(F.min_by("state", F.struct(F.col("hi") - F.col("lo"), "state")).alias("state"))
    return df.join(best, "hex", "left")


def nearest_zone(airports: DataFrame, zoned: DataFrame, max_km: float = 300, grid: float = 3) -> DataFrame:
    """Add `tz`: that of the same code, else of the nearest zoned field within `max_km`, found in the cell and its eight neighbours.

    airports(code, lat, lon), zoned(code, lat, lon, tz)."""
    own = airports.join(zoned.groupBy("code").agg(F.min("tz").alias("tz")), "code", "left")
    done, rest = own.where("tz is not null"), own.where("tz is null").drop("tz")
    n = int(360 / grid)
    x, y = (F.floor((F.col("lon") + 180) / grid)).cast("int"), F.floor((F.col("lat") + 90) / grid).cast("int")
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    z = zoned.where("tz is not null").select(F.col("lat").alias("z_lat"), F.col("lon").alias("z_lon"), "tz", x.alias("zx"), y.alias("zy"), around.alias("d")).select("z_lat", "z_lon", "tz", F.pmod(F.col("zx") + F.col("d.i"), F.lit(n)).alias("cx"), (F.col("zy") + F.col("d.j")).alias("cy"))
    j = rest.withColumns({"cx": F.pmod(x, F.lit(n)), "cy": y}).join(z, ["cx", "cy"])
    km = geo.haversine("lat", "lon", "z_lat", "z_lon")
    best = j.withColumn("km", km).where((F.col("km") <= max_km) & (F.abs(F.col("lat") - F.col("z_lat")) <= grid)).groupBy("code").agg(F.min_by("tz", F.struct("km", "tz")).alias("tz"))
    return done.unionByName(rest.join(best, "code", "left").select(*done.columns))


def zone_cells(zones: DataFrame, grid: float = 1) -> DataFrame:
    """(zone, tz, cx, cy, inside, edges) of the grid cells that a zone's border crosses or that lie inside it.

    `inside` tells whether the cell's lower right corner is inside; `edges` are those that touch the cell, none for a cell
    inside. zones(tz, ring ARRAY<STRUCT<lat, lon>>), the last point joined to the first. Rings are cut into edges once and
    each edge goes to the cells it touches, so no row holds more of a ring than one cell's part."""
    z = zones.select(F.xxhash64("tz", "ring").alias("zone"), "tz", "ring").where(F.size("ring") > 2)
    turned = F.concat(F.slice("ring", F.lit(2), F.size("ring") - 1), F.slice("ring", 1, 1))
    e = z.select("zone", "tz", F.explode(F.arrays_zip(F.col("ring").alias("p"), turned.alias("q"))).alias("e")).select("zone", "tz", F.col("e.p.lat").alias("y1"), F.col("e.p.lon").alias("x1"), F.col("e.q.lat").alias("y2"), F.col("e.q.lon").alias("x2"))
    e = checkpointed(e.withColumns({"lo": F.least("y1", "y2"), "hi": F.greatest("y1", "y2")}))
    row = lambda y: F.floor((y + 90) / grid)
    column = lambda x: F.floor((x + 180) / grid)
    at = lambda y: (F.col("x2") - F.col("x1")) * (y - F.col("y1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0)) + F.col("x1")
    # where edges cross the lower line of each row of cells; a corner is inside if it has an odd number of them to its right
    lines = e.withColumn("cy", F.explode(F.sequence(row(F.col("lo")), row(F.col("hi"))))).withColumn("y", F.col("cy") * grid - 90)
    lines = lines.where((F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y")))
    lines = lines.withColumn("x", at(F.col("y"))).withColumn("cx", F.ceil((F.col("x") + 180) / grid) - 1)
    corner = lambda c: (c + 1) * grid - 180
    exact = F.col("cx") + F.when(F.col("x") > corner(F.col("cx")), 1).when(F.col("x") <= corner(F.col("cx") - 1), -1).otherwise(0)  # the sum above is rounded
    beyond = lines.select("zone", "cy", exact.alias("cx")).groupBy("zone", "cy", "cx").agg(F.count(F.lit(1)).alias("n"))
    reach = e.groupBy("zone", "tz").agg(row(F.min("lo")).alias("r1"), row(F.max("hi")).alias("r2"), column(F.min(F.least("x1", "x2"))).alias("c1"), column(F.max(F.greatest("x1", "x2"))).alias("c2"))
    cells = reach.withColumn("cy", F.explode(F.sequence("r1", "r2"))).withColumn("cx", F.explode(F.sequence("c1", "c2"))).select("zone", "tz", "cx", "cy")
    right = Window.partitionBy("zone", "cy").orderBy(F.desc("cx")).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.join(beyond, ["zone", "cy", "cx"], "left").withColumn("inside", F.coalesce(F.sum("n").over(right), F.lit(0)) % 2 == 1).drop("n")
    # what each edge touches in each row that it passes, by the part of it in that row; a little more does no harm
    passed = e.withColumn("cy", F.explode(F.sequence(row(F.col("lo") - 1e-9), row(F.col("hi") + 1e-9))))
    low, high = F.greatest(F.col("lo"), F.col("cy") * grid - 90), F.least(F.col("hi"), (F.col("cy") + 1) * grid - 90)
    flat = F.col("y1") == F.col("y2")
    xs = [F.when(flat, F.col(x)).otherwise(at(y)) for x, y in (("x1", low), ("x2", high))]
    touched = passed.withColumn("cx", F.explode(F.sequence(column(F.least(*xs) - 1e-9), column(F.greatest(*xs) + 1e-9))))
    edges = touched.groupBy("zone", "cx", "cy").agg(F.collect_list(F.struct("y1", "x1", "y2", "x2")).alias("edges"))
    out = cells.join(edges.hint("merge"), ["zone", "cx", "cy"], "left").where(F.col("inside") | F.col("edges").isNotNull())
    return out.select("zone", "tz", "cx", "cy", "inside", F.coalesce("edges", F.array().cast("array<struct<y1:double,x1:double,y2:double,x2:double>>")).alias("edges"))


def _held(grid: float):
    """Per row of one cell and one zone: the codes of its points that the zone holds, with its name."""
    import numpy as np
    import pyarrow as pa

    from aerolith.functions.crossings import odd_crossings

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                tz, cx, cy, inside = (batch.column(c)[i].as_py() for c in ("tz", "cx", "cy", "inside"))
                edges, points = (batch.column(c)[i].values for c in ("edges", "points"))
                codes = points.field("code")
                if len(edges):
                    numbers = [s.field(k).to_numpy(zero_copy_only=False) for s, names in ((edges, ("y1", "x1", "y2", "x2")), (points, ("lat", "lon"))) for k in names]
                    codes = codes.filter(pa.array(odd_crossings(*numbers, (cx + 1) * grid - 180, cy * grid - 90) != inside))
                if len(codes):
                    yield pa.RecordBatch.from_arrays([codes, pa.array(np.full(len(codes), tz, object), pa.string())], names=["code", "tz"])

    return run


def zone_from_polygon(airports: DataFrame, zones: DataFrame, grid: float = 1, most_points: int = 1 << 16) -> DataFrame:
    """Add `tz` by the polygon that holds a point; zones(tz, ring ARRAY<STRUCT<lat, lon>>). Ocean zones (Etc/) give null.

    A point in a cell that lies inside a zone is decided by the cell alone; in a border cell only that cell's edges matter
    (`zone_cells`). The points of a cell, `most_points` at once, meet them together, sorted (`odd_crossings`)."""
    points = airports.where("lat is not null and lon is not null and not isnan(lat) and not isnan(lon)").select("code", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), F.floor((F.col("lon") + 180) / grid).alias("cx"), F.floor((F.col("lat") + 90) / grid).alias("cy"))
    part = F.floor((F.row_number().over(Window.partitionBy("cx", "cy").orderBy("lat")) - 1) / most_points)
    dealt = points.withColumn("part", part).groupBy("cx", "cy", "part").agg(F.collect_list(F.struct("code", "lat", "lon")).alias("points"))
    tasks = int(airports.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a cell's work is not told by its bytes: tasks are not merged
    cells = zone_cells(zones, grid).repartition(tasks, "cx", "cy")
    met = cells.join(dealt.hint("merge"), ["cx", "cy"]).select("tz", "cx", "cy", "inside", "edges", "points")
    code = airports.select("code").schema["code"].dataType.simpleString()
    best = met.mapInArrow(_held(grid), f"code {code}, tz string").groupBy("code").agg(F.min("tz").alias("tz")).withColumn("tz", F.when(~F.col("tz").startswith("Etc/"), F.col("tz")))
    return airports.join(best, "code", "left")


def point_in_zone(lat: str, lon: str, ring: str) -> Column:
    """Even-odd rule over the ring's edges, the last point joined to the first; a point on the upper end of an edge is below it."""
    y, x, r = F.col(lat), F.col(lon), F.col(ring)

    def crossed(p: Column, i: Column) -> Column:
        q = F.element_at(r, F.pmod(i + 1, F.size(r)) + 1)
        at = (q["lon"] - p["lon"]) * (y - p["lat"]) / F.nullif(q["lat"] - p["lat"], F.lit(0.0)) + p["lon"]
        return F.struct(F.coalesce(((p["lat"] > y) != (q["lat"] > y)) & (x < at), F.lit(False)).alias("c"))

    return F.size(F.filter(F.transform(r, crossed), lambda e: e["c"])) % 2 == 1


def assign_airframes(hexes: DataFrame, known: DataFrame) -> DataFrame:
    """(hex, airframe_id): ids once given stay; new addresses get the next numbers in order. known(hex, airframe_id)."""
    new = hexes.select("hex").distinct().join(known, "hex", "left_anti")
    top = known.agg(F.coalesce(F.max("airframe_id"), F.lit(0)).alias("m")).first()["m"]
    numbered = ranked_overall(new, [F.col("hex")], "_n").select("hex", (F.col("_n") + F.lit(top)).alias("airframe_id"))
    return known.unionByName(numbered)


def observed_history(legs: DataFrame, quiet_days: int = 30) -> DataFrame:
    """The observation history of every airframe of a flight log, as `import_history` takes it: hex, evidence_from, first and
    last day, flights, registrations and operators with their days, and silences of `quiet_days` or more."""
    seen = legs.where("hex is not null and date is not null").withColumn("op", tx.operator_code("callsign"))
    whole = seen.groupBy("hex").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count(F.lit(1)).alias("n_obs"))

    def spells(c: str, name: str) -> DataFrame:
        each = seen.where(F.col(c).isNotNull()).groupBy("hex", c).agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count(F.lit(1)).alias("n_obs"))
        ordered = F.array_sort(F.collect_list(F.struct("first_date", F.col(c).alias("value"), "last_date", "n_obs")))
        return each.groupBy("hex").agg(F.transform(ordered, lambda s: F.struct(s["value"].alias("value"), s["first_date"].alias("first_date"), s["last_date"].alias("last_date"), s["n_obs"].alias("n_obs"))).alias(name))

    quiet = quiet_spells(seen, quiet_days).groupBy("hex").agg(F.array_sort(F.collect_list(F.struct("last_seen", "seen_again"))).alias("gaps"))
    since = seen.agg(F.min("date").alias("evidence_from"))
    return whole.join(spells("reg", "regs"), "hex", "left").join(spells("op", "ops"), "hex", "left").join(quiet, "hex", "left").join(F.broadcast(since))


def history_spells(history: DataFrame, ids: DataFrame, source: str = "observed") -> DataFrame:
    """Spells of an observation history: the address itself, registrations and operators."""
    h = history.join(ids, "hex")
    own = h.select("airframe_id", F.lit("hex").alias("kind"), F.col("hex").alias("value"), "first_date", "last_date", "n_obs")
    part = lambda c, kind: h.select("airframe_id", F.lit(kind).alias("kind"), F.explode(c).alias("s")).select("airframe_id", "kind", F.substring("s.value", 1, 16).alias("value"), "s.first_date", "s.last_date", "s.n_obs")
    return own.unionByName(part("regs", "registration")).unionByName(part("ops", "operator")).withColumn("source", F.lit(source))


def history_events(history: DataFrame, ids: DataFrame, first_after_days: int = 30, source: str = "observed") -> DataFrame:
    """Events of a history: first observation (only well after the record begins), changes of mark and operator, silences."""
    h = history.join(ids, "hex")
    first = h.where(F.col("first_date") >= F.date_add("evidence_from", first_after_days)).select("airframe_id", F.lit("first_observed").alias("kind"), F.col("first_date").alias("at"))

    def changes(c: str, kind: str) -> DataFrame:
        s = h.select("airframe_id", F.posexplode(c).alias("i", "s"))
        w = Window.partitionBy("airframe_id").orderBy("i")
        s = s.withColumn("b", F.lag("s").over(w)).where("s.first_date > b.last_date")
        return s.select("airframe_id", F.lit(kind).alias("kind"), F.col("s.first_date").alias("at"), F.create_map(F.lit("from"), F.col("b.value"), F.lit("to"), F.col("s.value")).alias("detail"))

    quiet = not_observed_events(h.select("airframe_id", F.explode("gaps").alias("g")).select("airframe_id", "g.last_seen", "g.seen_again"))
    quiet = quiet.select("airframe_id", "kind", "at", F.create_map(F.lit("last_seen"), F.col("last_seen").cast("string"), F.lit("seen_again"), F.col("seen_again").cast("string"), F.lit("days"), F.col("days").cast("string")).alias("detail"))
    rows = changes("regs", "registration_change").unionByName(changes("ops", "operator_change")).unionByName(quiet).unionByName(first, allowMissingColumns=True)
    one = rows.groupBy("airframe_id", "kind", "at").agg(F.min(F.map_entries("detail")).alias("d"))
    return one.select("airframe_id", "kind", F.to_timestamp("at").alias("at"), F.map_from_entries("d").alias("detail"), F.lit(source).alias("source"), F.lit("public").alias("visibility"))


def import_history(history: DataFrame, known: DataFrame, old_spells: DataFrame, old_events: DataFrame, source: str = "observed") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ids, spells, events) after importing a history: ids are stable, the source's spells and events are replaced."""
    ids = assign_airframes(history.select("hex"), known)
    spells = old_spells.where(F.col("source") != source).unionByName(history_spells(history, ids, source), allowMissingColumns=True)
    events = old_events.where(F.col("source") != source).unionByName(history_events(history, ids, source=source), allowMissingColumns=True)
    return ids, spells, events


def upsert_claims(claims: DataFrame, statements: DataFrame, today: Column) -> DataFrame:
    """Append-only claims(airframe_id, field, source, value, first_seen, last_seen): a statement seen again only moves last_seen."""
    key = ["airframe_id", "field", "source", "value"]
    new = statements.select(*key).distinct().withColumn("_seen", today)
    j = claims.join(new, key, "full_outer")
    return j.select(*key, F.coalesce("first_seen", "_seen").alias("first_seen"), F.coalesce("_seen", "last_seen").alias("last_seen"))


def insert_once(events: DataFrame, new: DataFrame) -> DataFrame:
    """Events with those of `new` whose (airframe, kind, at, source) is not there yet."""
    key = ["airframe_id", "kind", "at", "source"]
    return events.unionByName(new.dropDuplicates(key).join(events.select(*key), key, "left_anti"), allowMissingColumns=True)


def import_us_registry(rows: DataFrame, ref: DataFrame, airframes: DataFrame, claims: DataFrame, events: DataFrame, ids: DataFrame, today: Column, source: str = "us-registry") -> dict[str, DataFrame]:
    """Merge a national registry: reference rows at registry rank, claims, missing build data, dated events, twin candidates.

    airframes(airframe_id, built_year, manufacturer, msn)."""
    base = rows.select("hex", "registration", F.lit(None).cast("string").alias("type_code"), F.col("owner").alias("operator_name"), F.upper("owner").alias("operator_norm"), F.lit(None).cast("string").alias("operator_icao"), F.col("built_year").alias("year"), F.lit(None).cast("string").alias("flags"))
    known = rows.join(ids, "hex")
    fields = ("manufacturer", "model", "msn", "engine", "owner", "built_year")
    stated = known.select("airframe_id", F.explode(F.map_entries(F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f).cast("string"))]))).alias("e")).select("airframe_id", F.col("e.key").alias("field"), F.lit(source).alias("source"), F.col("e.value").alias("value")).where("value is not null and value <> ''")
    filled = airframes.join(known.groupBy("airframe_id").agg(*[F.max(c).alias(f"_{c}") for c in ("built_year", "manufacturer", "msn")]), "airframe_id", "left")
    filled = filled.withColumns({c: F.coalesce(c, f"_{c}") for c in ("built_year", "manufacturer", "msn")}).drop("_built_year", "_manufacturer", "_msn")
    dated = known.select("airframe_id", F.explode(F.map_from_arrays(F.array(F.lit("certificate_issued"), F.lit("airworthiness")), F.array("cert_date", "airworthy_date"))).alias("kind", "day")).where("day is not null")
    fresh = dated.select("airframe_id", "kind", F.to_timestamp("day").alias("at"), F.lit(source).alias("source"), F.lit("public").alias("visibility"))
    merged = upsert_claims(claims, stated, today)
    return {"airframes_ref": merge_airframes(ref, base, "registry"), "claims": merged, "airframes": filled, "events": insert_once(events, fresh), "same_aircraft": same_aircraft_candidates(merged)}


def import_occurrences(occurrences: DataFrame, spells: DataFrame, events: DataFrame, source: str = "occurrences") -> DataFrame:
    """Events with the occurrences that attach to a spell and are not there yet."""
    a = attach_occurrences(occurrences, spells)
    new = a.select("airframe_id", F.lit("occurrence").alias("kind"), "at", F.lit(source).alias("source"), F.lit("public").alias("visibility"), F.create_map(F.lit("number"), F.col("number").cast("string")).alias("detail"))
    return insert_once(events, new)


def import_alliances(airlines: DataFrame, members: DataFrame) -> DataFrame:
    """Airlines with the roster's members added, and their IATA code where it was missing; names and palettes stay."""
    m = members.groupBy(F.col("airline_icao").alias("icao")).agg(F.max("iata").alias("_iata"), F.min("name").alias("_name"))
    j = airlines.join(m, "icao", "full_outer").withColumns({"iata": F.coalesce("iata", "_iata"), "name": F.coalesce("name", "_name")}).drop("_iata", "_name")
    return j.withColumn("palette", F.coalesce("palette", F.array().cast("array<string>"))) if "palette" in airlines.columns else j


def resolve_airports(codes: DataFrame, airports: DataFrame, code: str = "code") -> DataFrame:
    """Codes with the airport each stands for, IATA before ident, the lowest ident of several."""
    return codes.join(airport_codes(airports).withColumnRenamed("code", code), code, "left")


def enrich_airframes(keys: DataFrame, airframes_ref: DataFrame, airlines: DataFrame, types: DataFrame) -> DataFrame:
    """Identity of addresses: registration, type with its name, operator with the airline's name first."""
    j = keys.join(airframes_ref, "hex", "left").join(types.select(F.col("designator").alias("type_code"), F.col("name").alias("type_name"), F.col("category").alias("type_category")), "type_code", "left")
    return j.join(airlines.select(F.col("icao").alias("operator_icao"), F.col("name").alias("_airline")), "operator_icao", "left").withColumn("operator", F.coalesce("_airline", "operator_name")).drop("_airline")


def names_for_operators(airlines: DataFrame, schedule: DataFrame, names: DataFrame, min_flights: int = 5) -> DataFrame:
    """Airlines with observed operators added that can be named, and rows without a palette renamed. names(icao, iata, name)."""
    seen = schedule.groupBy(F.col("airline_icao").alias("icao")).agg(F.sum("n_flights").alias("n")).where((F.col("n") >= min_flights) & F.col("icao").rlike("^[A-Z]{3}$"))
    new = seen.join(airlines, "icao", "left_anti").join(names, "icao").select("icao", "iata", "name")
    bare = F.coalesce(F.size("palette"), F.lit(0)) <= 0
    renamed = airlines.join(names.select("icao", F.col("name").alias("_n")), "icao", "left").withColumn("name", F.when(bare & F.col("_n").isNotNull(), F.col("_n")).otherwise(F.col("name"))).drop("_n")
    return renamed.unionByName(new, allowMissingColumns=True)


"""Window logic: latest rows, neighbours, runs, stretches and top k per key."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolith.operators.cut import checkpointed


def top_k(df: DataFrame, key: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each key; Spark prunes each partition before the shuffle."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def latest_by(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key; null dates count as oldest."""
    return top_k(df, key, [F.col(c).desc_nulls_last() for c in order], 1, "_rank").drop("_rank")


def newest_days(rows: DataFrame, days: int, first: date | None, last: date | None, column: str = "date") -> DataFrame:
    """The dated rows of the newest `days` days before the newest date, with some older ones, written once.

    No date of `rows` lies outside first and last; the newest itself need not be known. A fixed day reaches the tables
    below their joins, so that only rows of the last days are joined. If the newest date lies further back than twice
    `days`, four times as many are looked at, in the end all."""
    back = 2 * days
    while first is not None and last is not None:
        cut = last - timedelta(days=back)
        part = checkpointed(rows.where(F.col(column) >= F.lit(cut)))
        newest = part.agg(F.max(column)).first()[0]
        if cut <= first or (newest is not None and newest - timedelta(days=days) >= cut):
            return part
        back *= 4
    return rows


def freshest_non_null(df: DataFrame, key: list[str], columns: list[str], order: list[str]) -> DataFrame:
    """Per key the newest value of each column that is not null. One aggregate, no sort."""
    newest = F.struct(*order)
    return df.groupBy(*key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), newest)).alias(c) for c in columns])


def consecutive_pairs(points: DataFrame, key: str = "hex", t: str = "t") -> DataFrame:
    """(key, a, b, gap_s) of neighbours in time."""
    w = Window.partitionBy(key).orderBy(t)
    row = F.struct(*points.columns)
    out = points.select(F.col(key), row.alias("a"), F.lead(row).over(w).alias("b")).where("b is not null")
    return out.withColumn("gap_s", F.col(f"b.{t}") - F.col(f"a.{t}"))


def carry_forward(points: DataFrame, column: str, key: str = "hex", t: str = "t") -> DataFrame:
    w = Window.partitionBy(key).orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    return points.withColumn(column, F.last(column, ignorenulls=True).over(w))


def flight_bounds(points: DataFrame, gap_s: float = 1200, low_ft: int = 5000) -> DataFrame:
    """Departure and arrival of each aircraft's current flight.

    The flight is the trailing stretch after a silence or after a change from ground to air. Its departure is vouched
    for only from the ground or from low altitude; its arrival is the first point of a final run on the ground."""
    w = Window.partitionBy("hex").orderBy("t")
    lag = lambda c: F.lag(c).over(w)
    p = points.withColumns({"_g": lag("t"), "_wg": lag("on_ground")})
    cut = F.col("_g").isNull() | (F.col("t") - F.col("_g") > gap_s) | (F.col("_wg") & ~F.col("on_ground"))
    p = p.withColumn("seg", F.sum(cut.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    p = p.withColumn("_last", F.max("seg").over(Window.partitionBy("hex"))).where("seg = _last")
    here = F.struct("t", "lat", "lon", "alt_ft", "on_ground")
    air, ground = ~F.col("on_ground"), F.col("on_ground")
    agg = p.groupBy("hex").agg(F.min_by(here, "t").alias("first"), F.max_by(here, "t").alias("last"), F.min_by(F.coalesce("_wg", F.lit(False)), "t").alias("before_ground"), F.min_by(here, F.when(air, F.col("t"))).alias("take"), F.max(F.when(air, F.col("t"))).alias("last_air"))
    landed = p.join(agg.select("hex", "last_air"), "hex").where(ground & (F.col("t") > F.col("last_air"))).groupBy("hex").agg(F.min_by(here, "t").alias("land"))
    j = agg.join(landed, "hex", "left")
    own = F.col("before_ground") | F.col("first.on_ground") | (F.col("take.alt_ft") <= low_ft)
    departed = F.col("take").isNotNull() & F.coalesce(own, F.lit(False))
    dep = lambda c: F.when(departed, F.col(f"take.{c}"))
    return j.select("hex", F.bround(dep("t"), 1).alias("dep_t"), dep("lat").alias("dep_lat"), dep("lon").alias("dep_lon"), F.when(departed, F.coalesce("take.alt_ft", F.lit(0))).alias("dep_alt_ft"), F.bround("land.t", 1).alias("arr_t"), F.col("land.lat").alias("arr_lat"), F.col("land.lon").alias("arr_lon"))


def ranked_overall(df: DataFrame, order: list[Column], rank: str = "rank", dense: bool = False) -> DataFrame:
    """A rank over the whole table without one task that sorts it all: rows are dealt by ranges of the order and written,
    and each range counts on from those before it, of which the driver sees one number each."""
    placed = checkpointed(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    w = Window.partitionBy("_range").orderBy(*order)
    own = placed.withColumn("_own", (F.dense_rank() if dense else F.row_number()).over(w))
    starts, at = [], 0
    for r in own.groupBy("_range").agg(F.max("_own").alias("n")).orderBy("_range").collect():
        starts.append((r["_range"], at))
        at += r["n"]
    first = df.sparkSession.createDataFrame(starts, "_range int, _first long")
    return own.join(F.broadcast(first), "_range").withColumn(rank, (F.col("_first") + F.col("_own"))).drop("_range", "_own", "_first")


def text_ranks(df: DataFrame, key: list[str], column: str, rank: str = "rank", dense: bool = True) -> DataFrame:
    if not key:
        return ranked_overall(df, [F.col(column)], rank, dense)
    w = Window.partitionBy(*key).orderBy(column)
    return df.withColumn(rank, (F.dense_rank() if dense else F.row_number()).over(w))


def spell_changes(spells: DataFrame) -> DataFrame:
    """registration_change and operator_change where the next spell begins after the one before ended."""
    w = Window.partitionBy("airframe_id", "kind").orderBy("first_date", "value")
    s = spells.where(F.col("kind").isin("registration", "operator")).withColumns({"from": F.lag("value").over(w), "_end": F.lag("last_date").over(w)})
    return s.where("first_date > _end").select("airframe_id", F.concat("kind", F.lit("_change")).alias("kind"), F.col("first_date").alias("at"), "from", F.col("value").alias("to"))


def not_observed_events(gaps: DataFrame) -> DataFrame:
    """gaps(airframe_id, last_seen, seen_again) as events on the day after, with the days of silence; one a day."""
    e = gaps.select("airframe_id", F.lit("not_observed").alias("kind"), F.date_add("last_seen", 1).alias("at"), "last_seen", "seen_again", (F.datediff("seen_again", "last_seen") - 1).alias("days"))
    return top_k(e, ["airframe_id", "at"], [F.col("seen_again")], 1, "_r").drop("_r")


def quiet_spells(legs: DataFrame, min_days: int = 3) -> DataFrame:
    """Gaps of at least `min_days` whole days between days on which an airframe flew."""
    days = legs.where("hex is not null and date is not null").select("hex", "date").distinct()
    w = Window.partitionBy("hex").orderBy("date")
    g = days.withColumn("last_seen", F.lag("date").over(w)).withColumn("days", F.datediff("date", "last_seen") - 1)
    return g.where(F.col("days") >= min_days).select("hex", "last_seen", F.col("date").alias("seen_again"), "days")


def callsign_changes(points: DataFrame) -> DataFrame:
    """(hex, t, callsign) wherever an aircraft's callsign changes, the first included."""
    w = Window.partitionBy("hex").orderBy("t")
    p = points.where("callsign is not null").withColumn("_was", F.lag("callsign").over(w))
    return p.where("_was is null or _was <> callsign").select("hex", "t", "callsign")


def trim_trace(points: DataFrame, keep_s: float = 1800, most: int = 720) -> DataFrame:
    """The trail of each aircraft: a repeated position only moves its time on; the newest `most` within `keep_s` of the
    stream's newest instant; aircraft silent for longer are gone."""
    w = Window.partitionBy("hex").orderBy("t")
    moved = ~(F.lag("lat").over(w).eqNullSafe(F.col("lat")) & F.lag("lon").over(w).eqNullSafe(F.col("lon"))) | (F.row_number().over(w) == 1)
    p = points.where("lat is not null and lon is not null").withColumn("_run", moved.cast("int"))
    p = p.withColumn("_run", F.sum("_run").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = p.groupBy("hex", "_run").agg(F.max("t").alias("t"), *[F.max_by(c, "t").alias(c) for c in points.columns if c not in ("hex", "t")])
    now = runs.agg(F.max("t").alias("_now"))
    kept = runs.join(F.broadcast(now)).where(F.col("t") >= F.col("_now") - keep_s).drop("_now", "_run")
    return top_k(kept, ["hex"], [F.col("t").desc()], most, "_r").drop("_r").select(*points.columns)


def interleave(results: DataFrame, cap: int = 3, below: float = 800) -> DataFrame:
    """Per query: results at or above a score in order; below it three of each kind come first, then the rest."""
    w = Window.partitionBy("q", "kind", F.col("score") >= below).orderBy(F.desc("score"), "id")
    r = results.withColumn("_n", F.row_number().over(w))
    tier = F.when(F.col("score") >= below, 0).when(F.col("_n") <= cap, 1).otherwise(2)
    order = Window.partitionBy("q").orderBy(tier, F.desc("score"), "kind", "id")
    return r.withColumn("rank", F.row_number().over(order)).drop("_n")


def weighted_median(df: DataFrame, key: list[str], value: str, weight: str, out: str = "median") -> DataFrame:
    """The first value whose running weight reaches half of the total."""
    w = Window.partitionBy(*key).orderBy(value, weight)
    run = F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, 0))
    half = F.sum(weight).over(Window.partitionBy(*key)) / 2
    r = df.withColumns({"_run": run, "_half": half}).where("_run >= _half")
    return r.groupBy(*key).agg(F.min(value).alias(out))


def stints(spells: DataFrame) -> DataFrame:
    """Operator spells with what each stint is: first, new airline, or again; newest first by `rank`."""
    s = spells.where("kind = 'operator'")
    by = lambda *c: Window.partitionBy(*c).orderBy("first_date", "value")
    s = s.withColumns({"_n": F.row_number().over(by("airframe_id")), "_own": F.row_number().over(by("airframe_id", "value"))})
    label = F.when(F.col("_n") == 1, "first").when(F.col("_own") > 1, "again").otherwise("new airline")
    newest = Window.partitionBy("airframe_id").orderBy(F.desc("first_date"), F.desc("value"))
    return s.withColumns({"stint": label, "rank": F.row_number().over(newest)}).drop("_n", "_own")


def recent(legs: DataFrame, key: list[str], k: int) -> DataFrame:
    """The newest k legs of each key."""
    tie = [F.col(c).asc_nulls_last() for c in ("hex", "callsign", "org", "dst") if c in legs.columns and c not in key]
    return top_k(legs, key, [F.col("date").desc_nulls_last(), F.col("dep_ts").desc_nulls_last(), *tie], k)


def training_window(legs: DataFrame, target: DataFrame, key: list[str], days: int = 60) -> DataFrame:
    """Sightings of the `days` days before each target's day, never the day itself. Both have `day` as a number of days."""
    t = target.withColumnRenamed("day", "target_day")
    return legs.join(t, key).where(F.col("day").between(F.col("target_day") - days, F.col("target_day") - 1))


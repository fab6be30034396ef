"""Ocean tracks, airways and fixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aerolith.functions import geo
from aerolith.functions import text as tx


def parse_track_messages(parts: DataFrame) -> DataFrame:
    """(issuer, valid_from, valid_to, tmi, letter, entry, exit, points, east_levels, west_levels, direction) of message parts.

    parts(issuer, start_datetime, end_datetime, part_no, condition_message); parts of one issuer and validity make one message."""
    key = ["issuer", "valid_from", "valid_to"]
    msg = parts.select("issuer", F.col("start_datetime").alias("valid_from"), F.col("end_datetime").alias("valid_to"), F.struct(F.coalesce("part_no", F.lit(0)).alias("n"), F.coalesce("condition_message", F.lit("")).alias("t")).alias("p"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["t"]), "\n")
    msg = msg.groupBy(*key).agg(F.regexp_replace(text, "\r", "").alias("raw"))
    lines = msg.select(*key, F.posexplode(F.split("raw", "\n")).alias("i", "raw_line")).withColumn("line", F.trim(F.regexp_replace(F.trim("raw_line"), "-+$", "")))
    tokens = F.split(F.regexp_extract("line", r"^[A-Z]\s+(.+)$", 1), r"\s+")
    lines = lines.withColumns({"tmi": F.regexp_extract("line", r"TMI IS (\d+)", 1).try_cast("int"), "side": F.regexp_extract("line", r"^(EAST|WEST)\s+LVLS", 1), "tokens": tokens})
    points = F.filter(F.transform("tokens", lambda t: tx.track_point(t)), lambda p: p.isNotNull())
    lines = lines.withColumn("points", points).withColumn("is_track", (F.col("side") == "") & (F.size("points") >= 2))
    w = Window.partitionBy(*key).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("track_no", F.sum(F.col("is_track").cast("int")).over(w))
    named = lambda at: F.when(F.element_at("tokens", at).isNotNull() & tx.track_point(F.element_at("tokens", at)).isNull(), F.element_at("tokens", at))
    head = lines.where("is_track").select(*key, "track_no", F.substring("line", 1, 1).alias("letter"), named(1).alias("entry"), named(-1).alias("exit"), "points")
    level = lines.where("side <> '' and track_no > 0").withColumn("lv", tx.levels(F.regexp_extract("line", r"LVLS\s+(.*)$", 1)))
    per = level.groupBy(*key, "track_no").agg(F.max_by("lv", F.when(F.col("side") == "EAST", F.col("i"))).alias("east_levels"), F.max_by("lv", F.when(F.col("side") == "WEST", F.col("i"))).alias("west_levels"))
    tmi = lines.groupBy(*key).agg(F.max_by("tmi", F.when(F.col("tmi").isNotNull(), F.col("i"))).alias("tmi"))
    none = F.array().cast("array<int>")
    out = head.join(per, [*key, "track_no"], "left").join(tmi, key).withColumns({"east_levels": F.coalesce("east_levels", none), "west_levels": F.coalesce("west_levels", none)})
    e, x = F.size("east_levels") > 0, F.size("west_levels") > 0
    return out.withColumn("direction", F.when(x & ~e, "W").when(e & ~x, "E")).drop("track_no")


def track_path(tracks: DataFrame, fixes: DataFrame) -> DataFrame:
    """Add `path`: entry fix, points, exit fix; an end the table cannot place is left off. fixes(name, lat, lon)."""
    place = lambda c: fixes.select(F.col("name").alias(c), F.struct("lat", "lon").alias(f"_{c}"))
    j = tracks.join(place("entry"), "entry", "left").join(place("exit"), "exit", "left")
    return j.withColumn("path", F.array_compact(F.concat(F.array("_entry"), F.col("points"), F.array("_exit")))).drop("_entry", "_exit")


def unknown_fixes(tracks: DataFrame, fixes: DataFrame) -> DataFrame:
    """Named track ends that the fix table cannot place."""
    ends = tracks.select(F.explode(F.array_compact(F.array("entry", "exit"))).alias("name")).distinct()
    return ends.join(fixes, "name", "left_anti")


def read_fixes(sources: list[DataFrame], box: tuple[float, float, float, float] = (-100, 30, 20, 85)) -> DataFrame:
    """Named points of several tables(name, lat, lon); the first table that has a name wins; inside (west, south, east, north)."""
    ranked = [s.select("name", "lat", "lon", F.lit(i).alias("rank")) for i, s in enumerate(sources)]
    rows = ranked[0]
    for r in ranked[1:]:
        rows = rows.unionByName(r)
    rows = rows.where(geo.in_bbox("lat", "lon", *box))
    first = rows.groupBy("name").agg(F.min(F.struct("rank", "lat", "lon")).alias("m"))
    return first.select("name", "m.lat", "m.lon")


def build_airways(lines: DataFrame, places: DataFrame) -> DataFrame:
    """(airway, points) of lines(airway, points ARRAY<STRING>) and places(name, lat, lon), where a name may have several places.

    A name with one place anchors the line; one with several takes the place nearest to the nearest placed neighbour;
    an airway with a point that has no place is dropped."""
    names = lines.select("airway", F.posexplode("points").alias("i", "name"))
    spots = places.groupBy("name").agg(F.collect_set(F.struct("lat", "lon")).alias("spots"))
    rows = names.join(spots, "name", "left")

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        options = [[(s["lat"], s["lon"]) for s in x] if x is not None else [] for x in pdf["spots"]]
        empty = pd.DataFrame({"airway": [], "names": [], "lats": [], "lons": []})
        if any(not o for o in options):
            return empty
        at = [o[0] if len(o) == 1 else None for o in options]
        if all(a is None for a in at):
            return empty
        while None in at:
            todo = [k for k, a in enumerate(at) if a is None and ((k and at[k - 1]) or (k + 1 < len(at) and at[k + 1]))]
            for k in todo:
                near = [at[j] for j in (k - 1, k + 1) if 0 <= j < len(at) and at[j] is not None]
                at[k] = min(options[k], key=lambda p: min(_km(*p, *q) for q in near))
        return pd.DataFrame({"airway": [pdf["airway"].iloc[0]], "names": [list(pdf["name"])], "lats": [[p[0] for p in at]], "lons": [[p[1] for p in at]]})

    out = rows.groupBy("airway").applyInPandas(place, "airway string, names array<string>, lats array<double>, lons array<double>")
    return out.select("airway", F.arrays_zip(F.col("names").alias("name"), F.col("lats").alias("lat"), F.col("lons").alias("lon")).alias("points"))


def _km(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    a, b, d = np.radians(lat1), np.radians(lat2), np.radians(lon2 - lon1)
    return float(2 * geo.EARTH_KM * np.arcsin(min(1.0, np.sqrt(np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(d / 2) ** 2))))


def read_airways(spark: SparkSession, path: str) -> DataFrame:
    """(airway, points) of {airway: [[name, lat, lon], ...]}."""
    doc = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,array<array<string>>>")).alias("airway", "p"))
    return doc.select("airway", F.transform("p", lambda p: F.struct(p[0].alias("name"), p[1].cast("double").alias("lat"), p[2].cast("double").alias("lon"))).alias("points"))

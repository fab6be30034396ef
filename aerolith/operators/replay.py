"""Replay of recorded days: chunks of slices per aircraft, tracks, traffic and the day list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith.operators.windows import callsign_changes


def build_replay(heat: DataFrame, registry: DataFrame, chunk_s: int = 1800) -> dict[str, DataFrame]:
    """Chunks, tracks, traffic and days of decoded heatmaps. registry(hex, registration, type_code).

    A chunk holds per aircraft its last callsign and squawk and its slices as (slice, lat, lon, alt_ft, gs), coordinates in
    1e-5 degrees and null altitude on the ground."""
    h = heat.withColumns({"day": F.to_date(F.timestamp_seconds("now")), "chunk": F.floor(F.col("now") % 86400 / chunk_s).cast("int")})
    info = h.where("kind = 'info'").groupBy("day", "chunk", "hex").agg(F.max_by("callsign", F.when(F.col("callsign") != "", F.col("now"))).alias("callsign"), F.max_by("squawk", F.when(F.col("squawk") != "0000", F.col("now"))).alias("squawk"))
    p = h.where("kind = 'position'")
    point = F.struct("slice", F.round(F.col("lat") * 1e5).cast("int").alias("lat"), F.round(F.col("lon") * 1e5).cast("int").alias("lon"), "alt_ft", F.round("gs").cast("int").alias("gs"))
    slices = p.groupBy("day", "chunk", "hex").agg(F.array_sort(F.collect_list(point)).alias("points"))
    chunks = slices.join(info, ["day", "chunk", "hex"], "left").join(registry.select("hex", "registration", "type_code"), "hex", "left")
    tracks = p.groupBy("day", "hex").agg(F.array_sort(F.collect_list(F.struct(F.col("now").alias("t"), "lat", "lon", "alt_ft", "gs"))).alias("track"))
    named = h.where("kind = 'info' and callsign <> ''").select("hex", F.col("now").alias("t"), "callsign")
    per_slice = p.groupBy("day", "now").agg(F.countDistinct("hex").alias("n"))
    traffic = per_slice.groupBy("day", (F.floor(F.col("now") / 300) * 300).alias("bucket")).agg(F.max("n").alias("aircraft"))
    days = p.groupBy("day").agg(F.countDistinct("hex").alias("aircraft"), F.countDistinct("chunk").alias("chunks"))
    return {"chunks": chunks, "tracks": tracks, "callsigns": callsign_changes(named), "traffic": traffic, "days": days}

"""Writers: replace by source, guarded overwrite, public export, audit, replay and rolling samples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.functions import geo
from aerolith.sources import commits


def write_wholesale(df: DataFrame, path: str, by: str = "source") -> None:
    """Replace all rows of the sources that `df` holds; other sources stay (dynamic partition overwrite)."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


class TruncatedArtifact(ValueError):
    """A new artifact is suspiciously small beside the one in place."""


def check_not_truncated(new: int, existing: int, floor: int = 1000, share: float = 0.8) -> None:
    if existing >= floor and new < existing * share:
        raise TruncatedArtifact(f"{new} rows would replace {existing}")


def guarded_overwrite(df: DataFrame, existing: DataFrame, path: str, floor: int = 1000, share: float = 0.8) -> None:
    """Overwrite unless the new table has lost more than a share of the rows of one that had at least `floor`."""
    check_not_truncated(df.count(), existing.count(), floor, share)
    df.write.mode("overwrite").parquet(path)


def export_public(spark: SparkSession, tables: dict[str, DataFrame], out: str, *, cuts: dict[str, Callable[[DataFrame], DataFrame]] | None = None, blank: dict[str, list[str]] | None = None) -> dict:
    """Publish tables together as the next version of a store: public cuts, blanked columns, row counts read back and compared."""
    public = {}
    for name, df in tables.items():
        cut = (cuts or {}).get(name, lambda d: d)(df)
        public[name] = cut.withColumns({c: F.lit(None).cast(cut.schema[c].dataType) for c in (blank or {}).get(name, [])})
    rows = {name: df.count() for name, df in public.items()}
    version = commits.publish(spark, out, public, expected=rows)
    return {"version": version, "tables": {name: {"rows": rows[name], "columns": df.columns} for name, df in public.items()}}


def log_import(spark: SparkSession, path: str, source: str, rows: int) -> None:
    """Append an audit row of a run."""
    spark.createDataFrame([(source, rows)], "source string, rows long").withColumn("imported_at", F.current_timestamp()).write.mode("append").parquet(path)


def keep_messages(df: DataFrame, out: str) -> int:
    """Add the messages whose (issuer, valid_from) the store does not hold; returns how many."""
    return commits.merge_once(df, out, "messages", ["issuer", "valid_from"], day=F.col("valid_from"))


def sample_points(positions: DataFrame, every_s: int = 60) -> DataFrame:
    """One position per aircraft and interval, the last, with its 1-degree cell and day."""
    slot = (F.col("ts").cast("long") / every_s).cast("long")
    last = positions.where("lat is not null and lon is not null").withColumn("slot", slot).groupBy("slot", "hex").agg(F.max_by(F.struct("ts", "flight", "t", "lat", "lon", "alt_ft", "gs", "track"), "ts").alias("p"))
    return last.select("hex", "slot", "p.*").withColumns({"cell": geo.cell("lat", "lon"), "day": F.to_date("ts")})


def sample_stream(stream: DataFrame, out: str, checkpoint: str, every_s: int = 60):
    """Add samples of a position stream, one micro-batch an interval; a batch that is done again adds nothing."""
    write = lambda batch, number: commits.merge_once(sample_points(batch, every_s), out, "points", ["hex", "slot"], day=F.timestamp_seconds(F.col("slot") * every_s), writer="points", number=number)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=f"{every_s} seconds").start()


def prune(spark: SparkSession, out: str, keep_from: str) -> list[str]:
    """Forget the sampled days before `keep_from`; returns them. Whole segments of old days are not read."""
    return commits.drop_days(spark, out, "points", keep_from)


def write_replay(chunks: DataFrame, tracks: DataFrame, days: DataFrame, out: str) -> int:
    """Half-hour chunks, tracks by shard, and the list of days with new ones over old, published together: a reader sees
    all three of one build. Returns the version."""
    spark = chunks.sparkSession
    known = commits.current(spark, out).tables
    if "days" in known:
        days = merge_day_list(commits.read_table(spark, out, "days"), days)
    old = {n: commits.read_table(spark, out, n).join(days.select("day"), "day", "left_semi") for n in ("chunks", "tracks") if n in known}
    tracks = tracks.withColumn("shard", F.substring("hex", 5, 2))
    new = {n: merge_days(old[n], df) if n in old else df for n, df in (("chunks", chunks), ("tracks", tracks))}
    return commits.publish(spark, out, {**{n: df.repartition("day", "chunk" if n == "chunks" else "shard") for n, df in new.items()}, "days": days})


def merge_days(old: DataFrame, new: DataFrame, day: str = "day") -> DataFrame:
    """All rows of a day that `new` has in place of the old ones of that day."""
    return old.join(new.select(day).distinct(), day, "left_anti").unionByName(new)


def merge_day_list(old: DataFrame, new: DataFrame, day: str = "day") -> DataFrame:
    """Rows by day, a new one in place of an old one."""
    return old.join(new.select(day), day, "left_anti").unionByName(new)

"""Tables that change together: several are published at once, or one is added to once for each key, by one manifest.

A store is a folder. Tables are written below `data`, each in a new folder of its own, and say nothing until a manifest
names them: `versions/<number>.json`, made by exclusive creation, so of two writers one gets the number and the other
looks again. The newest whole manifest is the store. A run that is killed leaves the version before it, or the one it
made; folders that no manifest names are removed by `vacuum`.

A table is a list of segments. `publish` gives it one new segment, `merge_once` adds one with the rows whose key the
table does not hold. Segments are partitioned by day and bucket of the key, and the manifest knows the days of each, so
a merge reads the keys of the batch's own days and buckets only, whatever the table holds besides. A batch that has been
merged (by its writer's name and number) is not merged again. `compact` turns the segments of a table into one, `drop_days`
forgets days.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 32
DAY, BUCKET = "_day", "_bucket"


class Conflict(RuntimeError):
    """Another writer took the version."""


@dataclass
class Manifest:
    """tables: name -> {segments: [{path, days or None, rows}], keys, schema}; batches: writer -> number of its last batch."""

    version: int = 0
    tables: dict[str, dict] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, at = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []


def _manifest(spark: SparkSession, root: str, number: int) -> Manifest | None:
    """A version, or None if it is not there or was not written to its end."""
    fs, at = _fs(spark, f"{root}/versions/{number:012d}.json")
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    try:
        return Manifest(**json.loads(text))
    except (ValueError, TypeError):
        return None


def current(spark: SparkSession, root: str) -> Manifest:
    """The newest whole version; an empty one for a store that has none."""
    for name in sorted((n for n in _names(spark, f"{root}/versions") if n.endswith(".json")), reverse=True):
        if (found := _manifest(spark, root, int(name[:-5]))) is not None:
            return found
    return Manifest()


def _commit(spark: SparkSession, root: str, made: Manifest, after: Manifest) -> int:
    """Make the version that follows `after`, unless another writer has made one since."""
    newest = max([after.version, *(int(n[:-5]) for n in _names(spark, f"{root}/versions") if n.endswith(".json"))])
    if newest > after.version and current(spark, root).version > after.version:
        raise Conflict(f"version {newest} was made after {after.version}")
    made.version = newest + 1  # the remains of a killed writer keep their number
    fs, at = _fs(spark, f"{root}/versions/{made.version:012d}.json")
    try:
        stream = fs.create(at, False)
    except Exception as e:
        if fs.exists(at):
            raise Conflict(f"version {made.version} was made by another writer") from e
        raise
    stream.write(json.dumps(vars(made), sort_keys=True).encode())
    stream.close()
    return made.version


def _segment(df: DataFrame, root: str, name: str, by: tuple[str, ...] = ()) -> tuple[str, int]:
    """Write rows to a new folder and read their number back."""
    path = f"data/{name}-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*by) if by else df.write
    writer.parquet(f"{root}/{path}")
    return path, df.sparkSession.read.schema(df.schema).parquet(f"{root}/{path}").count()


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], *, expected: dict[str, int] | None = None) -> int:
    """Put new contents in place of several tables, all at once; other tables of the store stay. Returns the version.

    expected: rows that a table must have been written with."""
    after = current(spark, root)
    made = Manifest(tables=dict(after.tables), batches=dict(after.batches))
    for name, df in tables.items():
        path, rows = _segment(df, root, name)
        if expected and expected.get(name, rows) != rows:
            raise ValueError(f"{name}: {rows} rows written, {expected[name]} expected")
        made.tables[name] = {"segments": [{"path": path, "days": None, "rows": rows}], "keys": None, "schema": df.schema.json()}
    return _commit(spark, root, made, after)


def read_table(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    """A table as of the newest version, or of an earlier one that `vacuum` has left."""
    found = current(spark, root) if version is None else _manifest(spark, root, version)
    if found is None or name not in found.tables:
        raise KeyError(f"{root} has no table {name}" + (f" in version {version}" if version is not None else ""))
    return _rows(spark, root, found.tables[name], None).drop(DAY, BUCKET)


def _rows(spark: SparkSession, root: str, table: dict, days: list[str] | None) -> DataFrame:
    from pyspark.sql.types import StructType

    schema = StructType.fromJson(json.loads(table["schema"]))
    paths = [f"{root}/{s['path']}" for s in table["segments"] if days is None or s["days"] is None or set(days) & set(s["days"])]
    out = None
    for p in paths:  # each segment has its own root for its partitions
        one = spark.read.schema(schema).parquet(p)
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], schema)


def _placed(df: DataFrame, keys: list[str], day: Column | None) -> DataFrame:
    at = F.coalesce(day.cast("date").cast("string"), F.lit("none")) if day is not None else F.lit("none")
    return df.withColumns({DAY: at, BUCKET: F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")})


def merge_once(batch: DataFrame, root: str, name: str, keys: list[str], *, day: Column | None = None, writer: str | None = None, number: int | None = None, tries: int = 5) -> int:
    """Add the rows whose key the table does not hold, one for each key (null is a key like any other); returns how many.

    day: a date that follows from the key, by which the table is cut. writer and number: a batch of this writer that is
    not newer than its last one has been merged already, and nothing happens."""
    spark = batch.sparkSession
    rows = _placed(batch.dropDuplicates(keys), keys, day)
    places = [(r[0], r[1]) for r in rows.select(DAY, BUCKET).distinct().collect()]  # the batch's days, BUCKETS each at most
    for _ in range(tries):
        after = current(spark, root)
        if writer is not None and number is not None and after.batches.get(writer, -1) >= number:
            return 0
        table = after.tables.get(name, {"segments": [], "keys": keys, "schema": rows.schema.json()})
        new = rows
        if places and table["segments"]:
            days = sorted({d for d, _ in places})
            held = _rows(spark, root, table, days).where(F.col(DAY).isin(days) & F.col(BUCKET).isin(sorted({b for _, b in places})))
            held = held.select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)])
            same = None
            for i, k in enumerate(keys):
                one = F.col(k).eqNullSafe(F.col(f"_{i}"))
                same = one if same is None else same & one
            new = rows.join(held, same, "left_anti")
        path, n = _segment(new.select(*rows.columns), root, name, (DAY, BUCKET)) if places else (None, 0)
        made = Manifest(tables=dict(after.tables), batches=dict(after.batches))
        if n:
            made.tables[name] = {**table, "segments": [*table["segments"], {"path": path, "days": sorted({d for d, _ in places}), "rows": n}]}
        elif name not in made.tables:
            made.tables[name] = table
        if writer is not None and number is not None:
            made.batches[writer] = number
        try:
            _commit(spark, root, made, after)
            return n
        except Conflict:
            continue
    raise Conflict(f"{name}: other writers were first {tries} times")


def compact(spark: SparkSession, root: str, name: str) -> int:
    """Turn the segments of a table into one; a merge that comes between makes this fail with `Conflict`."""
    after = current(spark, root)
    table = after.tables[name]
    if len(table["segments"]) < 2:
        return after.version
    path, rows = _segment(_rows(spark, root, table, None), root, name, (DAY, BUCKET) if table["keys"] else ())
    days = None if any(s["days"] is None for s in table["segments"]) else sorted({d for s in table["segments"] for d in s["days"]})
    made = Manifest(tables={**after.tables, name: {**table, "segments": [{"path": path, "days": days, "rows": rows}]}}, batches=dict(after.batches))
    return _commit(spark, root, made, after)


def drop_days(spark: SparkSession, root: str, name: str, before: str) -> list[str]:
    """Forget the rows of days before `before` of a merged table; returns the days. Segments of old days only are left out
    unread, others are written anew without them."""
    after = current(spark, root)
    table = after.tables[name]
    gone, kept = set(), []
    for s in table["segments"]:
        old = [d for d in s["days"] or [] if d < before]
        gone |= set(old)
        left = [d for d in s["days"] or [] if d >= before]
        if not old:
            kept.append(s)
        elif left:
            path, rows = _segment(_rows(spark, root, {**table, "segments": [s]}, None).where(F.col(DAY) >= before), root, name, (DAY, BUCKET))
            kept.append({"path": path, "days": left, "rows": rows})
    if gone:
        _commit(spark, root, Manifest(tables={**after.tables, name: {**table, "segments": kept}}, batches=dict(after.batches)), after)
    return sorted(gone)


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Remove folders and versions that the newest `keep` versions do not need; returns the folders. Not while writers run."""
    numbers = sorted(int(n[:-5]) for n in _names(spark, f"{root}/versions") if n.endswith(".json"))
    whole = [(n, m) for n in numbers if (m := _manifest(spark, root, n)) is not None]
    stay = {s["path"].split("/", 1)[1] for _, m in whole[-keep:] for t in m.tables.values() for s in t["segments"]}
    gone = [n for n in _names(spark, f"{root}/data") if n not in stay]
    for path in [*(f"{root}/data/{n}" for n in gone), *(f"{root}/versions/{n:012d}.json" for n in numbers if whole and n < whole[-keep:][0][0])]:
        fs, at = _fs(spark, path)
        fs.delete(at, True)
    return sorted(gone)

"""Binary heatmaps as a Spark data source: files are cut into ranges of slices, read and decoded a block at a time.

A file is a row of 16-byte little-endian records: a slice's header (with its time), positions, and callsign records. A
range owns the slices whose header begins in it, so it starts at its first header and reads on to the first header
after its end; what stands before a file's first header belongs to no slice. A compressed file is one range, unpacked
as it is read. Numbers of slices are counted in a first pass that looks at headers only (`decode_heatmap`).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

RECORD = 16
MAGIC = 0x0E7F7C9D
GROUND = -123
HEAT = "path string, slice int, now double, kind string, hex string, lat double, lon double, alt_ft int, on_ground boolean, gs double, callsign string, squawk string"
RANGED = f"range long, {HEAT}"
HEADS = "path string, range long, heads long"


@dataclass
class Decoder:
    """Turns blocks of records into columns; what a slice's header says holds for the blocks after it."""

    slice: int = -1
    now: float = np.nan

    def columns(self, raw: np.ndarray) -> list[pa.Array]:
        """slice, now, kind, hex, lat, lon, alt_ft, on_ground, gs, callsign, squawk of the records that are in a slice."""
        head = raw[:, 0] == MAGIC
        slices = self.slice + np.cumsum(head)
        high, low = (raw[:, i].astype(np.int64) & 0xFFFFFFFF for i in (1, 2))
        last = np.maximum.accumulate(np.where(head, np.arange(len(raw)), -1))
        times = ((high << 32) + low) / 1000
        now = np.where(last >= 0, times[last], self.now)
        if len(raw):
            self.slice, self.now = int(slices[-1]), float(now[-1])
        body = ~head & (slices >= 0)
        r, slices, now = raw[body], slices[body], now[body]
        info = r[:, 1] >= 1 << 30  # no latitude is that large
        alt = (r[:, 3] & 0xFFFF).astype(np.uint16).view(np.int16)
        speed = (r[:, 3].astype(np.int64) >> 16 & 0xFFFF).astype(np.uint16).view(np.int16)
        ground = (alt == GROUND) & ~info
        sign = r[:, 2:4].copy().view("S8").ravel()
        where = lambda values, none, kind: pa.array(values, kind, mask=none)
        return [
            pa.array(slices.astype(np.int32)), pa.array(now), pa.array(np.where(info, "info", "position")), pa.array([f"{v & 0xFFFFFF:06x}" for v in r[:, 0].tolist()], pa.string()),
            where(r[:, 1] / 1e6, info, pa.float64()), where(r[:, 2] / 1e6, info, pa.float64()), where(alt.astype(np.int32) * 25, info | ground, pa.int32()), pa.array(ground), where(speed / 10, info | (speed == -1), pa.float64()),
            pa.array([s.decode("ascii", "replace").strip("\0 ") if i else None for s, i in zip(sign.tolist(), info.tolist(), strict=True)], pa.string()), pa.array([f"{v & 0xFFFF:04d}" if i else None for v, i in zip(r[:, 1].tolist(), info.tolist(), strict=True)], pa.string()),
        ]


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int | None  # None: a compressed file, whole


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[tuple[str, int]]:
    """(path, size) of a file, or of all files below a folder, hidden ones aside."""
    system, at = _open(path)
    scheme = path[: len(path) - len(path.split("://", 1)[-1])]
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else [i for i in system.get_file_info(fs.FileSelector(at, recursive=True)) if i.type == fs.FileType.File and not i.base_name.startswith((".", "_"))]
    return sorted((scheme + i.path, i.size) for i in found)


class HeatmapReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.heads = "heads" in schema.names
        self.path = options["path"]
        self.size = max(RECORD, int(options.get("rangebytes", 64 << 20)) // RECORD * RECORD)
        self.block = max(RECORD, int(options.get("blockbytes", 1 << 20)) // RECORD * RECORD)

    def partitions(self) -> list[InputPartition]:
        out = []
        for path, size in _files(self.path):
            system, at = _open(path)
            with system.open_input_file(at) as f:
                packed = f.read(2) == b"\x1f\x8b"
            out += [Range(path, 0, None)] if packed else [Range(path, a, min(size, a + self.size)) for a in range(0, max(1, size), self.size)]
        return out

    def _blocks(self, part: Range) -> Iterator[tuple[int, np.ndarray]]:
        """(offset, records) of the range and what follows it, a block at a time; a last part of a record is left."""
        system, at = _open(part.path)
        with system.open_input_file(at) as f:
            f.seek(part.start)
            unpack = zlib.decompressobj(31) if part.end is None else None
            left, offset = b"", part.start
            while data := f.read(self.block):
                while data:
                    piece, data = (unpack.decompress(data, self.block), unpack.unconsumed_tail or b"") if unpack else (data, b"")
                    if unpack and unpack.eof and unpack.unused_data:  # several members one after the other
                        data, unpack = unpack.unused_data, zlib.decompressobj(31)
                    piece = left + piece
                    whole = len(piece) // RECORD * RECORD
                    left = piece[whole:]
                    if whole:
                        yield offset, np.frombuffer(piece, "<i4", count=whole // 4).reshape(-1, 4)
                        offset += whole

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        decoder, begun, heads = Decoder(), False, 0
        for offset, raw in self._blocks(partition):
            head = np.flatnonzero(raw[:, 0] == MAGIC)
            first = 0
            if not begun:
                if not len(head) or (partition.end is not None and offset + head[0] * RECORD >= partition.end):
                    if partition.end is not None and offset + len(raw) * RECORD >= partition.end:
                        break
                    continue
                first, begun = int(head[0]), True
            stop = len(raw)
            if partition.end is not None:
                beyond = head[offset + head * RECORD >= partition.end]
                stop = int(beyond[0]) if len(beyond) else stop
            heads += int(((head >= first) & (head < stop)).sum())
            if not self.heads:
                columns = decoder.columns(raw[first:stop])
                n = len(columns[0])
                names = [c.split()[0] for c in RANGED.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array([partition.start] * n, pa.int64()), pa.array([partition.path] * n, pa.string()), *columns], names=names)
            if stop < len(raw):
                break
        if self.heads:
            yield pa.RecordBatch.from_arrays([pa.array([partition.path]), pa.array([partition.start], pa.int64()), pa.array([heads], pa.int64())], names=["path", "range", "heads"])


class HeatmapSource(DataSource):
    """`spark.read.format("heatmap").load(path)`; options rangeBytes and blockBytes. With the schema `HEADS`: headers of each range only."""

    @classmethod
    def name(cls) -> str:
        return "heatmap"

    def schema(self) -> str:
        return RANGED

    def reader(self, schema: StructType) -> HeatmapReader:
        return HeatmapReader(schema, {k.lower(): v for k, v in self.options.items()})  # names of options have no case


def decode_heatmap(spark: SparkSession, path: str, range_bytes: int = 64 << 20, block_bytes: int = 1 << 20) -> DataFrame:
    """Records of heatmap files; ground has no altitude, unknown speed is null, callsign records carry no position."""
    spark.dataSource.register(HeatmapSource)
    read = lambda schema: spark.read.format("heatmap").schema(schema).option("rangeBytes", range_bytes).option("blockBytes", block_bytes).load(path)
    before = F.sum("heads").over(Window.partitionBy("path").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    first = read(HEADS).select("path", "range", F.coalesce(before, F.lit(0)).cast("int").alias("_first"))
    rows = read(RANGED).join(first, ["path", "range"])
    return rows.withColumn("slice", F.col("slice") + F.col("_first")).select(*[c.split()[0] for c in HEAT.split(", ")])


def day_hexes(heat: DataFrame) -> DataFrame:
    """Distinct 24-bit addresses."""
    return heat.select("hex").distinct()

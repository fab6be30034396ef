"""Streams whose state can be seeded, read and carried on: the sky per aircraft, and the book of lost aircraft.

Both keep one value per aircraft with an event-time timer (`transformWithState`). A first batch may start from a table
(`initialState`): a snapshot of the sky, or a book that `saved_book` has read out of another query's checkpoint through
the state data source. Rows of a batch are taken in the order of their time; one that is not newer than what the state
holds is late and changes nothing.

The session must use the RocksDB state store (`state_store`). Each operator has a batch twin over the same reports.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from aerolith.operators.filters import cruising
from aerolith.streaming.live import BOOK_S, LOST_AFTER_S, SHOW_MAX_S, SKY, SKY_TTL_S

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def state_store(spark: SparkSession) -> None:
    """Let stateful streams keep their state in RocksDB, which these operators need."""
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _plain(value):
    """None for what pandas makes of a null."""
    return None if pd.isna(value) else value.item() if hasattr(value, "item") else value


def _timestamp(seconds: float) -> pd.Timestamp:
    return pd.Timestamp(round(seconds * 1e6), unit="us")


# --- the sky ----------------------------------------------------------------------------------------------------------


class _Sky(StatefulProcessor):
    """Value state `sky`: whether the row came from the snapshot, its time and its fields."""

    def __init__(self, fields: list[str], state: str, ttl_s: float):
        self.fields, self.state, self.ttl_s = fields, state, ttl_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sky = handle.getValueState("sky", self.state)

    def _ends(self, row: dict) -> int:
        return int((row["t"] + self.ttl_s - (row.get("seen") or 0.0)) * 1000) + 1

    def _rearm(self, row: dict, timers) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(max(self._ends(row), timers.getCurrentWatermarkInMs() + 1))

    def _out(self, key: tuple, change: str, row: dict) -> pd.DataFrame:
        return pd.DataFrame([(key[0], change, *[row[f] for f in self.fields])], columns=["hex", "change", *self.fields])

    def handleInitialState(self, key, initialState, timerValues) -> None:
        r = initialState.sort_values("t").iloc[-1]
        row = {f: _plain(r[f]) for f in self.fields}
        self.sky.update((True, *row.values()))
        self._rearm(row, timerValues)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))
        r = batch.loc[batch["t"].idxmax()]
        row = {f: _plain(r[f]) for f in self.fields}
        if self.sky.exists():
            seeded, t, *_ = self.sky.get()
            if not seeded and t > row["t"]:
                return
        self.sky.update((False, *row.values()))
        self._rearm(row, timerValues)
        yield self._out(key, "seen", row)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.sky.exists():
            return
        row = dict(zip(self.fields, self.sky.get()[1:], strict=True))
        self.sky.clear()
        yield self._out(key, "gone", row)

    def close(self) -> None:
        pass


def _sky_rows(df: DataFrame) -> DataFrame:
    return df.withColumn("t", F.col("ts").cast("double")).select("hex", "ts", "t", *[c for c in SKY if c in df.columns])


def _sky_state(rows: DataFrame) -> tuple[list[str], str]:
    fields = [f for f in rows.schema.fields if f.name not in ("hex", "ts")]
    return [f.name for f in fields], ", ".join(["seeded boolean", *(f"{f.name} {f.dataType.simpleString()}" for f in fields)])


def sky_stream(stream: DataFrame, snapshot: DataFrame | None = None, ttl_s: float = SKY_TTL_S, late: str = "10 seconds") -> DataFrame:
    """(hex, change, fields) in update mode: `seen` with an aircraft's newest report, `gone` when it has aged past the limit.

    `snapshot` (positions) gives the aircraft that the stream has not heard when it starts; a report replaces what came
    from the snapshot whatever its time."""
    rows = _sky_rows(stream).withWatermark("ts", late)
    fields, state = _sky_state(rows)
    seed = _sky_rows(snapshot).select("hex", *fields).groupBy("hex") if snapshot is not None else None
    out = T.StructType([rows.schema["hex"], T.StructField("change", T.StringType()), *(rows.schema[f] for f in fields)])
    return rows.groupBy("hex").transformWithStateInPandas(_Sky(fields, state, ttl_s), out, "Update", "eventTime", seed)


def sky_of(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The sky as a query's checkpoint holds it: one row per aircraft, read by Spark from the state store."""
    state = spark.read.format("statestore").option("stateVarName", "sky").load(checkpoint)
    return state.select(F.col("key.hex").alias("hex"), "value.*")


def seeded_sky_batch(positions: DataFrame, snapshot: DataFrame, now: float, ttl_s: float = SKY_TTL_S) -> DataFrame:
    """Batch twin: the newest report of each aircraft heard, the snapshot's of the others, none past the limit at `now`."""
    def newest(df: DataFrame, seeded: bool) -> DataFrame:
        rows = _sky_rows(df)
        fields = [c for c in rows.columns if c not in ("hex", "ts", "t")]
        return rows.groupBy("hex").agg(F.max_by(F.struct("t", *fields), "t").alias("r")).select("hex", F.lit(seeded).alias("seeded"), "r.*")

    heard, known = newest(positions, False), newest(snapshot, True)
    sky = heard.unionByName(known.join(heard.select("hex"), "hex", "left_anti"))
    age = F.coalesce(F.col("seen"), F.lit(0.0)) if "seen" in sky.columns else F.lit(0.0)
    return sky.where(F.lit(float(now)) - F.col("t") + age <= ttl_s)


# --- the book of lost aircraft ----------------------------------------------------------------------------------------

BOOK_FIELDS = "t double, cruising boolean, told string, callsign string, lat double, lon double, alt_ft int, gs double, track double"
LOST = "hex string, change string, at timestamp, told timestamp, since double, callsign string, lat double, lon double, alt_ft int, gs double, track double"
_NAMES = [c.split()[0] for c in BOOK_FIELDS.split(", ")]


class _Book(StatefulProcessor):
    """Value state `book`: an aircraft's last report, and what was last told of it (heard, lost or over).

    Silence is told when the watermark passes its time, or when a later report shows it, whichever comes first."""

    def __init__(self, lost_s: float, shown_s: float, keep_s: float):
        self.lost_s, self.shown_s, self.keep_s = lost_s, shown_s, keep_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.book = handle.getValueState("book", BOOK_FIELDS)

    def _silence(self, key: tuple, row: dict, until: float, mark: int) -> list[tuple]:
        """What is to be told of a cruising aircraft that is silent until `until`."""
        out = []
        for told, after in (("lost", self.lost_s), ("over", self.shown_s)):
            if row["cruising"] and until - row["t"] > after and row["told"] == ("heard" if told == "lost" else "lost"):
                row["told"] = told
                out.append(self._told(key, told, row["t"] + after, row, mark))
        return out

    def _told(self, key: tuple, change: str, at: float, row: dict, mark: int) -> tuple:
        """mark: the watermark, before which a further stateful step would not take the row."""
        return (key[0], change, _timestamp(at), _timestamp(max(at, mark / 1000 + 0.001)), row["t"], *[row[c] for c in _NAMES[3:]])

    def _next(self, row: dict) -> float:
        if row["cruising"] and row["told"] in ("heard", "lost"):
            return row["t"] + (self.lost_s if row["told"] == "heard" else self.shown_s)
        return row["t"] + self.keep_s

    def _save(self, row: dict, timers) -> None:
        self.book.update(tuple(row[c] for c in _NAMES))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(max(int(self._next(row) * 1000) + 1, timers.getCurrentWatermarkInMs() + 1))

    def handleInitialState(self, key, initialState, timerValues) -> None:
        r = initialState.sort_values("t").iloc[-1]
        self._save({c: _plain(r[c]) for c in _NAMES}, timerValues)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("t", kind="stable")
        row = dict(zip(_NAMES, self.book.get(), strict=True)) if self.book.exists() else None
        out, mark = [], timerValues.getCurrentWatermarkInMs()
        for r in batch.to_dict("records"):
            if row is not None:
                if r["t"] <= row["t"]:
                    continue
                out += self._silence(key, row, r["t"], mark)
            was = row
            row = {c: _plain(r[c]) for c in _NAMES if c != "told"} | {"told": "heard"}
            if was is not None and was["told"] == "lost":
                out.append(self._told(key, "heard", row["t"], row, mark))
        if row is not None:
            self._save(row, timerValues)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in LOST.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.book.exists():
            return
        row = dict(zip(_NAMES, self.book.get(), strict=True))
        now = expiredTimerInfo.getExpiryTimeInMs() / 1000
        out = self._silence(key, row, now, timerValues.getCurrentWatermarkInMs())
        if now - row["t"] >= self.keep_s:
            self.book.clear()
        else:
            self._save(row, timerValues)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in LOST.split(", ")])

    def close(self) -> None:
        pass


def _book_rows(positions: DataFrame) -> DataFrame:
    return positions.select("hex", "ts", F.col("ts").cast("double").alias("t"), cruising().alias("cruising"), F.lit("heard").alias("told"), F.trim("flight").alias("callsign"), "lat", "lon", "alt_ft", "gs", "track").where("lat is not null")


def lost_events(stream: DataFrame, book: DataFrame | None = None, *, lost_s: float = LOST_AFTER_S, shown_s: float = SHOW_MAX_S, keep_s: float = BOOK_S, late: str = "10 seconds", chained: bool = False) -> DataFrame:
    """When cruising aircraft fall silent (`lost`), are heard again (`heard`) or are given up (`over`), in append mode.

    `at` is the event's own time, `told` the stream's time when it was told, on which a `chained` step may window
    (`lost_timeline`). `book` is what `saved_book` gives."""
    rows = _book_rows(stream).withWatermark("ts", late)
    seed = book.select("hex", *_NAMES).groupBy("hex") if book is not None else None
    return rows.groupBy("hex").transformWithStateInPandas(_Book(lost_s, shown_s, keep_s), LOST, "Append", "eventTime", seed, eventTimeColumnName="told" if chained else "")


def lost_timeline(stream: DataFrame, book: DataFrame | None = None, slice_s: int = 300, **limits) -> DataFrame:
    """Aircraft found silent in each slice of the stream's time: a second stateful step on what the first tells."""
    lost = lost_events(stream, book, chained=True, **limits).where("change = 'lost'")
    return lost.groupBy(F.window("told", f"{slice_s} seconds")).agg(F.count(F.lit(1)).alias("lost")).select(F.col("window.start").alias("slice"), "lost")


def lost_events_batch(positions: DataFrame, now: float, *, lost_s: float = LOST_AFTER_S, shown_s: float = SHOW_MAX_S) -> DataFrame:
    """Batch twin at an instant that the watermark has passed."""
    w = Window.partitionBy("hex").orderBy("t")
    p = _book_rows(positions).dropDuplicates(["hex", "t"]).withColumns({"_next": F.lead("t").over(w), "_c": F.struct("t", *_NAMES[3:])})
    until = F.coalesce("_next", F.lit(float(now)))
    gap = until - F.col("t")
    fields = [F.col("t").alias("since"), *_NAMES[3:]]  # `told` depends on how the stream came
    told = lambda df, change, at: df.select("hex", F.lit(change).alias("change"), F.timestamp_seconds(at).alias("at"), *fields)
    silent = p.where(F.col("cruising") & (gap > lost_s))
    over = silent.where(gap > shown_s)
    again = p.withColumns({"_was": F.lag("cruising").over(w), "_gap": F.col("t") - F.lag("t").over(w)}).where(F.col("_was") & (F.col("_gap") > lost_s) & (F.col("_gap") <= shown_s))
    return told(silent, "lost", F.col("t") + lost_s).unionByName(told(over, "over", F.col("t") + shown_s)).unionByName(told(again, "heard", F.col("t")))


def saved_book(spark: SparkSession, checkpoint: str, now: float, keep_s: float = BOOK_S) -> DataFrame:
    """The book of a query that has stopped, for another one to start from: cruising aircraft that are not stale at `now`."""
    state = spark.read.format("statestore").option("stateVarName", "book").load(checkpoint)
    rows = state.select(F.col("key.hex").alias("hex"), "value.*")
    return rows.where(F.col("cruising") & (F.lit(float(now)) - F.col("t") <= keep_s))


def save_book(spark: SparkSession, checkpoint: str, table: str, now: float, keep_s: float = BOOK_S) -> None:
    """Write `saved_book` as a table that outlives the checkpoint."""
    saved_book(spark, checkpoint, now, keep_s).write.mode("overwrite").parquet(table)

"""Table functions for SQL: `obs_track_messages`, `obs_query_readings` and `obs_heatmap`; `register_tables` adds them to a session.

Each agrees with its DataFrame form (`parse_track_messages`, `flight_number` and `places`, `decode_heatmap`).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

TRACK = "issuer string, valid_from string, valid_to string, tmi int, letter string, entry string, exit string, points array<struct<lat:double,lon:double>>, east_levels array<int>, west_levels array<int>, direction string"
_POINT = re.compile(r"(\d{2})(\d{2})?/(\d{2,3})")


def _point(token: str) -> tuple[float, float] | None:
    m = _POINT.fullmatch(token)
    if not m:
        return None
    lat, lon = float(m[1]) + float(m[2] or 0) / 60, -float(m[3])
    return (lat, lon) if 40 <= lat <= 80 and -80 <= lon <= 0 else None


@udtf(returnType=TRACK)
class TrackMessages:
    """One message a partition: SELECT * FROM obs_track_messages(TABLE(parts) PARTITION BY (issuer, start_datetime, end_datetime)).

    Its parts are joined by number, and every track of it becomes a row."""

    def __init__(self):
        self.parts: list[tuple[int, str]] = []
        self.key = None

    def eval(self, part: Row) -> None:
        self.key = (part["issuer"], part["start_datetime"], part["end_datetime"])
        self.parts.append((part["part_no"] or 0, part["condition_message"] or ""))

    def terminate(self) -> Iterator[tuple]:
        if self.key is None:
            return
        tmi, tracks = None, []
        for raw in "\n".join(t for _, t in sorted(self.parts)).replace("\r", "").split("\n"):
            line = raw.strip(" ").rstrip("-").strip(" ")
            if m := re.search(r"TMI IS (\d+)", line):
                tmi = int(m[1])
            if m := re.match(r"(EAST|WEST)\s+LVLS\s*(.*)$", line):
                if tracks:
                    tracks[-1][m[1]] = [int(w) for w in m[2].split() if w.isdigit()] if not m[2].startswith("NIL") else []
            elif m := re.match(r"([A-Z])\s+(.+)$", line):
                tokens = m[2].split()
                points = [p for p in map(_point, tokens) if p]
                if len(points) >= 2:
                    ends = [t if _point(t) is None else None for t in (tokens[0], tokens[-1])]
                    tracks.append({"letter": m[1], "ends": ends, "points": points, "EAST": [], "WEST": []})
        for t in tracks:
            way = "W" if t["WEST"] and not t["EAST"] else "E" if t["EAST"] and not t["WEST"] else None
            yield (*self.key, tmi, t["letter"], *t["ends"], t["points"], t["EAST"], t["WEST"], way)


_SPACED, _WHOLE = re.compile(r"([A-Z0-9]{2}|[A-Z]{3}) (\d{1,4}[A-Z]?)"), re.compile(r"([A-Z]{3}|[A-Z0-9]{2})(\d{1,4}[A-Z]?)")
_DASHED = re.compile(r"\s*([^\W\d_]+\s+)*[^\W\d_]{3,}\s*-\s*[^\W\d_]{3,}(\s+[^\W\d_]+)*\s*")


def _flight(q: str) -> tuple[str, str] | None:
    q = q.strip(" ").upper()
    for pattern in (_SPACED, _WHOLE):
        m = pattern.fullmatch(q) if pattern is _SPACED or " " not in q else None
        if m and re.search("[A-Z]", m[1]):
            return m[1], m[2]
    return None


def _places(q: str) -> tuple[str, str] | None:
    text = re.sub("->|[→–—>]", " → ", q.upper())
    if _DASHED.fullmatch(text):
        text = text.replace("-", " → ")
    w = text.split()
    if len(w) > 1 and w[0] == "FLIGHTS":
        w = w[1:]
    at = {mark: w.index(mark) for mark in ("TO", "FROM", "→") if mark in w}
    if "→" in at:
        sides = w[1 if w[0] == "FROM" else 0 : at["→"]], w[at["→"] + 1 :]
    elif w and w[0] == "FROM" and "TO" in at:
        sides = w[1 : at["TO"]], w[at["TO"] + 1 :]
    elif w and w[0] == "TO" and "FROM" in at:
        sides = w[at["FROM"] + 1 :], w[1 : at["FROM"]]
    elif "TO" in at:
        sides = w[: at["TO"]], w[at["TO"] + 1 :]
    elif len(w) == 2:
        sides = [w[0]], [w[1]]
    else:
        return None
    if not all(sides) or {"TO", "FROM", "→"} & {*sides[0], *sides[1]}:
        return None
    return " ".join(sides[0]), " ".join(sides[1])


@udtf(returnType="reading string, first string, second string")
class QueryReadings:
    """What a typed query may be by its form alone: a flight number (code, number), a registration, a pair of places (from, to).

    SELECT * FROM queries, LATERAL obs_query_readings(q)."""

    def eval(self, q: str) -> Iterator[tuple]:
        if q is None:
            return
        if found := _flight(q):
            yield "flight", *found
        if re.fullmatch("[A-Z0-9]{1,2} [A-Z0-9]{2,5}", norm := " ".join(q.split()).upper()):
            yield "registration", re.sub("[^A-Z0-9]", "", norm), None
        if found := _places(q):
            yield "places", *found


@udtf(returnType="slice int, now double, kind string, hex string, lat double, lon double, alt_ft int, on_ground boolean, gs double, callsign string, squawk string")
class Heatmap:
    """The records of one heatmap that is held as bytes: SELECT h.* FROM files, LATERAL obs_heatmap(content) h. Decoded a block at a time."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        import zlib

        import numpy as np

        from aerolith.sources.heatmap import RECORD, Decoder

        if content is None:
            return
        content = zlib.decompress(content, 31) if content[:2] == b"\x1f\x8b" else content
        raw, decoder = np.frombuffer(content, "<i4", count=len(content) // RECORD * 4).reshape(-1, 4), Decoder()
        for at in range(0, len(raw), 4096):
            yield from zip(*(c.to_pylist() for c in decoder.columns(raw[at : at + 4096])), strict=True)


def register_tables(spark: SparkSession) -> None:
    for name, kind in (("obs_track_messages", TrackMessages), ("obs_query_readings", QueryReadings), ("obs_heatmap", Heatmap)):
        spark.udtf.register(name, kind)

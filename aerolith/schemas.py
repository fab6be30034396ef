"""The library's tables as explicit Spark schemas (DDL). Readers use them; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

LEGS = "hex string, reg string, type string, callsign string, date date, org string, dst string, dep_ts long, arr_ts long, max_alt int"
AIRFRAMES_REF = "hex string, registration string, type_code string, operator_name string, operator_norm string, operator_icao string, year int, flags string, source string, updated_at timestamp"
AIRLINES = "icao string, iata string, name string, palette array<string>"
ALLIANCES = "slug string, name string, source_url string, source_checked_at date"
MEMBERSHIPS = "slug string, airline_icao string, iata string, name string, relationship string, status string, sponsor_icao string, effective_from date, effective_to date, note string"
TYPES = "designator string, name string, category string"
AIRPORTS = "ident string, iata string, name string, kind string, role string, lat double, lon double, iso_country string, municipality string, tz string"
ROUTES = "callsign string, chain array<string>"
GAPS = "callsign string, side string, known string, hint string, chain array<string>, type string, n_recent int, last_seen string, last_lat double, last_lon double, last_trk double, est_km double, n_rot int, known_ts array<long>"
BOARDS = "airport string, kind string, flight string, counterpart string, sched_min int, day date, source string, fetched_at string"
SCHEDULE = "callsign string, org string, dst string, airline_icao string, dep_min int, arr_min int, weekdays map<int,struct<dep:int,arr:int>>, type_code string, flight string, source string, n_flights long"
CLAIMS = "id long, callsign string, origin string, dest string, status string, verdict string, anonymous_count int, first_at timestamp, last_at timestamp, reviewed_at timestamp, reviewed_by string, review_note string"
ENDORSEMENTS = "claim_id long, handle string, note string, key_name string, valid_from date, received_at timestamp, source_id long"
CATALOG = "callsign string, origin string, dest string, via array<string>, valid_from date, valid_to date, closed_reason string, source string, claim_id long, approved_at timestamp"
SPELLS = "airframe_id long, kind string, value string, first_date date, last_date date, n_obs long, source string"
POSITIONS = "hex string, flight string, t string, r string, lat double, lon double, alt_ft int, on_ground boolean, gs double, track double, category string, squawk string, seen double, seen_pos double, baro_rate double, emergency string, ts timestamp"
POINTS = "hex string, t double, lat double, lon double, alt_ft int, on_ground boolean, gs double, track double, callsign string"
SUBMISSIONS = "id long, received_at timestamp, callsign string, origin string, dest string, note string, handle string, key_name string, valid_from string"
PRESENCE = "uuid string, kbit_s double, conn_time_s double, msgs_per_s double, positions_per_s double, rtt_ms double, positions_total long"

#: Fields of a position line that may be shown; all others are dropped at the source.
PUBLIC_FIELDS = ("hex", "flight", "t", "r", "lat", "lon", "alt_baro", "gs", "track", "category", "squawk", "seen", "seen_pos", "baro_rate", "emergency")


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)

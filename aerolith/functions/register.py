"""SQL functions of the library: `obs_*` in Spark SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from aerolith.functions.text import fold_table

_HALF = "pow(sin((radians(lat2) - radians(lat1)) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2)"
_FOUR = "lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE"


def register_functions(spark: SparkSession) -> None:
    """Create the temporary SQL functions in the session."""
    quote = lambda s: s.replace("\\", "\\\\").replace("'", "\\'")
    a, b = fold_table()
    for name, args, kind, body in (
        ("obs_haversine_km", _FOUR, "DOUBLE", f"2 * 6371.0088 * asin(CASE WHEN {_HALF} > 1 THEN 1.0D ELSE sqrt({_HALF}) END)"),
        ("obs_haversine_nm", _FOUR, "DOUBLE", f"2 * 3440.065 * asin(CASE WHEN {_HALF} > 1 THEN 1.0D ELSE sqrt({_HALF}) END)"),
        ("obs_bearing", _FOUR, "DOUBLE", "pmod(degrees(atan2(sin(radians(lon2 - lon1)) * cos(radians(lat2)), cos(radians(lat1)) * sin(radians(lat2)) - sin(radians(lat1)) * cos(radians(lat2)) * cos(radians(lon2 - lon1)))) + 360, 360.0D)"),
        ("obs_circ_diff", "a INT, b INT", "INT", "abs(pmod(a - b + 720, 1440) - 720)"),
        ("obs_fold", "s STRING", "STRING", f"translate(upper(s), '{quote(a)}', '{quote(b)}')"),
        ("obs_hhmm", "m INT", "STRING", "format_string('%02d:%02d', cast(floor(m / 60) as int), m % 60)"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")

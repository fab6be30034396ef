"""Aggregates for SQL: `obs_pick_slot` over groups and windows; `register_aggregates` adds it to a session.

It is the per-group form of `operators.schedule.pick_slot`, for groups that fit a task (the sightings of one flight); whole
archives go through the relational form, with the same result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

HALF_LIFE_DAYS, KERNEL_MIN, SLOT = 7.0, 15, 5  # as in operators.schedule


def slot_of(minutes: np.ndarray, ages: np.ndarray | None, kernel: bool) -> int | None:
    """minutes: of the day; ages: days before the date asked for, or None if all count alike."""
    if not len(minutes):
        return None
    weight = np.ones(len(minutes)) if ages is None else 0.5 ** (np.maximum(0, ages) / HALF_LIFE_DAYS)
    own = np.round(np.bincount(minutes // SLOT, weight, 1440 // SLOT), 9)
    seen = np.flatnonzero(np.bincount(minutes // SLOT, minlength=1440 // SLOT))
    if not kernel:
        return int(seen[np.lexsort((seen, -own[seen]))[0]]) * SLOT
    reach = KERNEL_MIN // SLOT
    mass = np.round(sum(np.roll(own, d) for d in range(-reach, reach + 1)), 9)
    best = int(seen[np.lexsort((seen, -own[seen], -mass[seen]))[0]]) * SLOT
    offset = (minutes - best + 720) % 1440 - 720
    near = np.abs(offset) <= KERNEL_MIN
    steps = np.bincount(offset[near] + KERNEL_MIN, weight[near], 2 * KERNEL_MIN + 1)
    at = np.flatnonzero((np.round(np.cumsum(steps), 9) >= np.round(steps.sum() / 2, 9)) & (steps > 0))[0] - KERNEL_MIN
    return int(np.round((best + at) % 1440 / SLOT)) * SLOT % 1440


def pick_slot_udaf(method: str = "recent+kernel"):
    """A grouped aggregate (day DATE, minute INT, asof DATE) -> the scheduled minute, for groupBy, windows and SQL."""
    flags = set(method.split("+"))

    @F.pandas_udf("int")
    def pick(day: pd.Series, minute: pd.Series, asof: pd.Series) -> int:
        known = minute.notna()
        ages = (pd.to_datetime(asof[known]) - pd.to_datetime(day[known])).dt.days.to_numpy() if "recent" in flags else None
        return slot_of(minute[known].to_numpy(np.int64), ages, "kernel" in flags)

    return pick


def register_aggregates(spark: SparkSession) -> None:
    """`obs_pick_slot(day, minute, asof)` and, by method, `obs_pick_slot_mode`, `_recent` and `_kernel`."""
    for name, method in (("", "recent+kernel"), ("_mode", "mode"), ("_recent", "recent"), ("_kernel", "kernel")):
        spark.udf.register(f"obs_pick_slot{name}", pick_slot_udaf(method))

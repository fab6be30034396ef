"""A list of queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.plans.lenses import with_lenses

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None, *lenses: str, dates: str = "") -> Callable[[Query], Query]:
        """Register a query under its function's name, with SQL over the lenses it names.

        `dates` lists result columns that hold dates; both sides give them as text, so that no reader's date type matters."""
        days = dates.split()

        def keep(f: Query) -> Query:
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                out = f(spark, sf_dir)
                return out.withColumns({c: F.col(c).cast("string") for c in days})

            self.queries[f.__name__] = run
            if sql is not None:
                text = with_lenses(sql, *lenses) if lenses else sql
                texts = ", ".join(f'CAST("{c}" AS VARCHAR) AS "{c}"' for c in days)
                self.sql[f.__name__] = f"SELECT * REPLACE ({texts}) FROM ({text}) t" if days else text
            return f

        return keep

"""A section of the registry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plectra.plans.fixtures import SQL


class Book:
    def __init__(self):
        self.queries: dict = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, run, sql: str | None = None, prelude: bool = True) -> None:
        """run(spark, sf_dir); sql goes behind the inputs' common table expressions."""
        self.queries[name] = run
        if sql is not None:
            self.oracles[name] = f"{SQL}\n{sql}" if prelude else sql


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})

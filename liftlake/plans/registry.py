"""One list of (key, Spark query, oracle SQL) shared by the driver entry,
the bench and the tests."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from liftlake.plans.oracle_sql import with_ctes
from liftlake.sources.inputs import looked

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass
class Entry:
    key: str
    fn: QueryFn
    sql: str | None  # None -> rows-only check (not SQL-expressible, or presentation order)


REGISTRY: dict[str, Entry] = {}


def query(key: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if key in REGISTRY:
            raise ValueError(f"duplicate query key {key}")

        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            with looked(spark, sf_dir):
                return fn(spark, sf_dir)

        REGISTRY[key] = Entry(key, run, with_ctes(sql) if sql else None)
        return fn
    return deco

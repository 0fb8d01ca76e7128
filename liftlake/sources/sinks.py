"""Sinks (D1-D4) and a few read helpers.

Tables are Parquet directories. Without a transactional table format there is
no MERGE or in-place UPDATE, so derived tables are rewritten whole, and a
table that is both read and replaced goes to a *new* path (snapshot) rather
than over the one being read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from liftlake.session import ensure_checkpoint_dir


def write(df: DataFrame, path: str, mode: str = "overwrite", skip_if_empty: bool = False,
          partition_by: list[str] | None = None) -> bool:
    """D1 / D2 / D3. With ``skip_if_empty`` an empty extract leaves the
    existing table untouched (a one-row probe, not a count). Returns whether
    anything was written."""
    if skip_if_empty and df.isEmpty():
        return False
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return True


def write_snapshot(df: DataFrame, base: str, run_id: str) -> str:
    """Write the next full state of a table under ``base/run_id`` and return
    the path; readers switch to it only after the write succeeded."""
    path = f"{base.rstrip('/')}/{run_id}"
    df.write.mode("errorifexists").parquet(path)
    return path


def upsert(target: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """Insert-or-replace by key; every non-key column of a matched row
    comes from ``updates``. One shuffle on the key; no MERGE needed."""
    cols = target.columns
    u = updates.select(*cols).withColumn("_src", F.lit(1))
    t = target.select(*cols).withColumn("_src", F.lit(0))
    w = Window.partitionBy(*keys).orderBy(F.col("_src").desc())
    both = t.unionByName(u)
    return both.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).select(*cols)


def preview(df: DataFrame, limit: int, *order: str) -> DataFrame:
    """The first rows of a table by the given columns (the limit is the
    feature); each task keeps no more than that many."""
    return df.orderBy(*order).limit(limit)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's shared checkpoint directory."""
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/liftlake-tables/{name}-{uuid.uuid4().hex[:12]}"

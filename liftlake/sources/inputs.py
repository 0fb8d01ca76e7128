"""What the source tables of a data directory hold just now.

A look lists the files of every ``<table>.parquet`` below a directory (path,
length, modification time, read by no one) and sums them up to one fingerprint
for each table. Relations and layer tables are kept under these fingerprints,
so a table that changes under its path is read and derived anew in the same
session. A registered query looks once; library calls outside of one look for
themselves.
"""

from __future__ import annotations

import contextlib
import contextvars
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOOKS: contextvars.ContextVar[dict[tuple[str, str], dict[str, str]]] = contextvars.ContextVar("looks", default={})
_RELATIONS: dict[tuple[str, str], tuple[str, DataFrame]] = {}


def session_key(spark: SparkSession) -> str:
    return f"{spark.sparkContext.applicationId}/{id(spark)}"


def _listed(spark: SparkSession, pattern: str) -> dict[str, str]:
    files = spark.read.format("binaryFile").load(pattern).select(
        F.regexp_extract("path", r"([^/]+)\.parquet(?:/|$)", 1).alias("table"),
        F.xxhash64("path", "length", F.col("modificationTime").cast("double")).alias("file"),
    )
    # The sum does not depend on the order of files and wraps nowhere.
    rows = files.groupBy("table").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("file").cast("decimal(38,0)")).alias("sum")).collect()
    return {r["table"]: f"{r['n']}-{r['sum']}" for r in rows}


def look(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """Fingerprint by table; from the current look of a query, if one is on."""
    root = sf_dir.rstrip("/")
    known = _LOOKS.get().get((session_key(spark), root))
    return known if known is not None else _listed(spark, f"{root}/*.parquet")


@contextlib.contextmanager
def looked(spark: SparkSession, sf_dir: str) -> Iterator[None]:
    """Everything built inside uses one look at ``sf_dir``."""
    key = (session_key(spark), sf_dir.rstrip("/"))
    if key in _LOOKS.get():
        yield
        return
    token = _LOOKS.set({**_LOOKS.get(), key: look(spark, sf_dir)})
    try:
        yield
    finally:
        _LOOKS.reset(token)


def relation(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One DataFrame for each state of a table: file listing and footer schema
    inference happen once, and every query over it shares the relation."""
    path = f"{sf_dir.rstrip('/')}/{table}.parquet"
    state = look(spark, sf_dir).get(table)
    key = (session_key(spark), path)
    kept = _RELATIONS.get(key)
    if state is None or kept is None or kept[0] != state:
        kept = (state, spark.read.parquet(path))
        _RELATIONS[key] = kept
    return kept[1]


@lru_cache(maxsize=1)
def code_key() -> str:
    """Layers are derived anew when the code that derives them changes."""
    root, out = Path(__file__).resolve().parents[1], hashlib.sha256()
    for path in sorted(root.glob("*/*.py")):
        if path.parent.name != "llm":
            out.update(path.read_bytes())
    return out.hexdigest()[:16]


def state_key(spark: SparkSession, sf_dir: str, tables: tuple[str, ...] = ()) -> str:
    """Key of what is derived from the given tables (none given: from all)."""
    seen = look(spark, sf_dir)
    own = sorted((t, s) for t, s in seen.items() if not tables or t in tables)
    return hashlib.sha256(repr((sf_dir.rstrip("/"), own, code_key())).encode()).hexdigest()[:32]

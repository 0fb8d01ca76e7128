"""Shared helpers of the training-data operators: document keys, the shared
work folder, chunked views of Arrow text columns and connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from liftlake.session import ensure_checkpoint_dir

# Smallest long: the place of a null document id in the document order.
NULL_ID = -(2**63)
# Text bytes handled at once by the vectorised scans, which need some tens of
# bytes of scratch for each byte of text.
CHUNK_BYTES = 1 << 21


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A fresh path below the folder that driver and executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; survives executor loss."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def keyed(docs: DataFrame, *more: Column | str) -> DataFrame:
    """Documents as (did, th, doc_id, text, ...): ``did`` orders null ids first
    and ``th`` tells rows apart that share an id but not a text. Rows equal in
    both are the same document stated twice. A null text counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("did"),
        F.xxhash64(text).alias("th"),
        F.col("doc_id").cast("long").alias("doc_id"),
        text.alias("text"),
        *more,
    )


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of rows of a text column as (first row, bytes, bounds): row
    ``first + i`` is ``bytes[bounds[i]:bounds[i + 1]]``. A run holds at most
    ``limit`` bytes, or one longer row. Nulls are empty."""
    if not len(column):
        return
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(ends, ends[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), len(column))
        yield first, raw[ends[first] : ends[last]], ends[first : last + 1] - ends[first]
        first = last


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph given as (a, b) rows, as (node, root)
    with the smallest node of each component as its root; the roots have no
    row. Alternating large-star and small-star rounds, each a pre-aggregated
    minimum and an equi-join, until the edge set no longer changes."""
    cur = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )

    def mark(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    before = mark(cur)
    for _ in range(max_rounds):
        if not before[0]:
            break
        # Large star: larger neighbours of a node move to its smallest one.
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: a node and its smaller neighbours move to the smallest.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(least.select("a", F.col("m").alias("b")))
            .distinct()
        )
        cur = stored(small)
        after = mark(cur)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return cur.select(F.col("a").alias("node"), F.col("b").alias("root"))

"""Hard-negative mining (op 13) by a BOND vertical scan.

Vectors lie in blocks by dimension. For an anchor the dimensions of a block are
read in descending magnitude of the anchor's component, a few at a time; what
the unread ones can still add lies between the sums of their least and greatest
contributions in the block. A candidate bitmap keeps the rows that can still
count: for positives those that can reach the fifth best score so far, for
negatives those that can fall into some positive's score window and reach its
tenth best. It shrinks with each step until the scores are exact.

The anchors are a stated query set and meet all rows in blocks: a grid of
anchor packs by row groups. A cell is one key of the shuffle; its task reads
the pack's anchors first, then one block after the other, and keeps the few
best rows of each anchor. Anchors that are equal in id, label and vector are
one anchor with a number of copies. Positives are found first, as the windows
depend on them, and the blocks are read once more for the negatives.

Components are floor(256 * x), kept within +-2**26 so that scores stay exact in
64 bits (for up to 1024 dimensions); vectors of different lengths are compared
as if the shorter went on with zeros.

Defined results: rows without label, vector or with a null or non-finite
component take no part; rows without an id come last among equal scores and are
never anchors; repeated rows are rows of their own, as candidates and as
anchors; an anchor without a positive or a positive without a negative has no
row; an empty vector scores 0 with everything; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import shared_folder, shuffle_partitions

ANCHOR_EVERY = 100
MOVED_EVERY, LABELS = 7, 10
POSITIVES, NEGATIVES = 5, 10
# Window of a negative's score in hundredths of the positive's.
LOW, HIGH = 30, 90
SCALE, LIMIT = 256, 1 << 26
BLOCK_ROWS = 4096
PACK_ANCHORS = 2048
# Components that the blocks of one cell hold at most, on average.
CELL_NUMBERS = 1 << 24
# Dimensions read between two looks at the bitmap.
STEP = 8
# Below this, sums of whole numbers are exact in doubles.
_EXACT = 2.0**53


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, label, vector) of the rows that take part."""
    moved = F.coalesce(F.col("vec_id") % MOVED_EVERY == 0, F.lit(False))
    label = F.when(moved, (F.col("label").cast("long") + 1) % LABELS).otherwise(F.col("label"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    # Bounded before floor, which gives a long.
    within = lambda x: F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), x.cast("double") * SCALE))
    scaled = F.transform("embedding", lambda x: F.floor(within(x)).cast("int"))
    return rows.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite).select(
        F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), scaled.alias("vector")
    )


_BLOCK = "block long, n int, width int, ids binary, no_id binary, labels binary, columns binary"
_BLOCK_ARROW = pa.schema([
    ("block", pa.int64()), ("n", pa.int32()), ("width", pa.int32()), ("ids", pa.binary()), ("no_id", pa.binary()), ("labels", pa.binary()),
    ("columns", pa.binary()),
])


def _ragged(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(rows by dimensions, lengths); short rows go on with zeros."""
    lengths = np.diff(column.offsets.to_numpy()).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lengths), int(lengths.max(initial=0))), np.int32)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out, lengths


def _blocks(size: int):
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                vectors, _ = _ragged(part.column("vector"))
                ids = part.column("vec_id")
                row = (
                    number, part.num_rows, vectors.shape[1], ids.fill_null(0).to_numpy().astype("<i8").tobytes(),
                    ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes(),
                    part.column("label").to_numpy().astype("<i8").tobytes(), np.ascontiguousarray(vectors.T, "<i4").tobytes(),
                )
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _BLOCK_ARROW)], schema=_BLOCK_ARROW)
                number += 1

    return blocks


class Block:
    """Rows by dimension, with the least and greatest value of each."""

    def __init__(self, row: dict) -> None:
        n, width = row["n"], row["width"]
        self.n, self.ids, self.no_id = n, np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["no_id"], np.uint8).astype(bool)
        self.labels = np.frombuffer(row["labels"], "<i8")
        whole = np.frombuffer(row["columns"], "<i4").reshape(width, n)
        self.least, self.greatest = (whole.min(axis=1), whole.max(axis=1)) if n else (np.zeros(width, int), np.zeros(width, int))
        self.top = int(np.abs(whole.astype(np.int64)).max(initial=0))
        self.doubles, self.longs = whole.astype(np.float64), None
        self.whole = whole

    def columns(self, exact: bool) -> np.ndarray:
        if exact:
            return self.doubles
        if self.longs is None:
            self.longs = self.whole.astype(np.int64)
        return self.longs


class Best:
    """The first k of an anchor's rows by score, then id, rows without id last."""

    def __init__(self, k: int) -> None:
        self.k, self.rows = k, []  # (-score, no id, id)

    def worst(self) -> int | None:
        return -self.rows[-1][0] if len(self.rows) == self.k else None

    def add(self, scores: np.ndarray, ids: np.ndarray, no_id: np.ndarray) -> None:
        if len(scores) > self.k:
            order = np.lexsort((ids, no_id, -scores))[: self.k]
            scores, ids, no_id = scores[order], ids[order], no_id[order]
        found = zip((-scores).tolist(), no_id.tolist(), ids.tolist())
        self.rows = sorted([*self.rows, *((int(s), bool(e), i) for s, e, i in found)])[: self.k]


def scan(block: Block, vector: np.ndarray, alive: np.ndarray, keep, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """(rows, scores) that stay alive to the end. ``alive`` are the row numbers
    to begin with; ``keep(rows, low, high)`` tells, from bounds of their scores,
    which of them can still count."""
    width = min(len(vector), len(block.least))
    own = vector[:width].astype(np.int64)
    order = np.argsort(-np.abs(own), kind="stable")
    order = order[own[order] != 0]
    exact = float(np.abs(own).sum()) * block.top < _EXACT
    columns = block.columns(exact)
    own = own.astype(columns.dtype)
    low, high = own * block.least[:width], own * block.greatest[:width]
    low, high = np.minimum(low, high)[order], np.maximum(low, high)[order]
    rest_low, rest_high = low.sum() - np.cumsum(low), high.sum() - np.cumsum(high)
    scores = np.zeros(len(alive), columns.dtype)
    for at in range(0, len(order), step):
        dims = order[at : at + step]
        last = at + len(dims) - 1
        full = len(alive) == block.n
        read = columns[dims] if full else columns[dims[:, None], alive]
        scores = scores + own[dims] @ read
        if at + step < len(order) and len(alive):
            stay = keep(alive, scores + rest_low[last], scores + rest_high[last])
            if not stay.all():
                alive, scores = alive[stay], scores[stay]
        if not len(alive):
            break
    return alive, scores.astype(np.int64)


def _kth(values: np.ndarray, k: int):
    return np.partition(values, len(values) - k)[len(values) - k]


def scan_positives(block: Block, vector: np.ndarray, label: int, best: Best) -> None:
    alive = np.flatnonzero(block.labels == label)
    if not len(alive):
        return

    def keep(rows, low, high):
        bound = best.worst()
        if len(low) >= best.k:
            near = _kth(low, best.k)
            bound = near if bound is None else max(bound, near)
        return np.ones(len(rows), bool) if bound is None else high >= bound

    rows, scores = scan(block, vector, alive, keep)
    best.add(scores, block.ids[rows], block.no_id[rows])


def scan_negatives(block: Block, vector: np.ndarray, label: int, windows: list[tuple[int, int]], best: list[Best]) -> None:
    """``windows``: least and greatest score for each positive."""
    alive = np.flatnonzero(block.labels != label)
    if not len(alive) or not windows:
        return

    def keep(rows, low, high):
        stay = np.zeros(len(rows), bool)
        for (least, most), b in zip(windows, best):
            bound = b.worst()
            bound = least if bound is None else max(least, bound)
            sure = low[(low >= least) & (high <= most)]
            if len(sure) >= b.k:
                bound = max(bound, _kth(sure, b.k))
            stay |= (high >= bound) & (low <= most)
        return stay

    rows, scores = scan(block, vector, alive, keep)
    for (least, most), b in zip(windows, best):
        inside = (scores >= least) & (scores <= most)
        b.add(scores[inside], block.ids[rows[inside]], block.no_id[rows[inside]])


_KEY = ["anchor_id", "label", "vector"]
_FOUND = "anchor_id long, label long, vector array<int>, positive long, score long, no_id boolean, id long"
_FOUND_ARROW = pa.schema([
    ("anchor_id", pa.int64()), ("label", pa.int64()), ("vector", pa.list_(pa.int32())), ("positive", pa.int64()), ("score", pa.int64()),
    ("no_id", pa.bool_()), ("id", pa.int64()),
])


def _windows(scores: list[int]) -> list[tuple[int, int]]:
    """Whole-number bounds of 30 p <= 100 n <= 90 p."""
    return [(-(-LOW * p // 100), HIGH * p // 100) for p in scores]


def _cells(negatives: bool):
    """One cell after the other: its anchors, then its blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, anchors = None, []

        def done():
            out = []
            for key, _, _, best in anchors:
                for i, b in enumerate(best):
                    out += [(*key, i, -s, e, n) for s, e, n in b.rows]
            for at in range(0, len(out), 5000):
                part = list(zip(*out[at : at + 5000]))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(part, _FOUND_ARROW)], schema=_FOUND_ARROW)

        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}
                own = (row["pack"], row["part"])
                if own != cell:
                    yield from done()
                    cell, anchors = own, []
                if row["n"] is None:
                    windows = _windows(row["scores"]) if negatives else []
                    best = [Best(NEGATIVES) for _ in windows] if negatives else [Best(POSITIVES + 1)]
                    key = (row["anchor_id"], row["label"], row["vector"])
                    anchors.append((key, np.array(row["vector"], np.int64), windows, best))
                    continue
                block = Block(row)
                for key, vector, windows, best in anchors:
                    if negatives:
                        scan_negatives(block, vector, key[1], windows, best)
                    else:
                        scan_positives(block, vector, key[1], best[0])
        yield from done()

    return run


def _on_grid(blocks: DataFrame, anchors: DataFrame, packs: int, parts: int, negatives: bool) -> DataFrame:
    """Every anchor against every block, as (key, positive, score, id) rows."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = [F.lit(None).cast(t).alias(c) for c, t in (("n", "int"), ("width", "int"), ("ids", "binary"), ("no_id", "binary"), ("labels", "binary"), ("columns", "binary"))]
    left = anchors.select(
        F.pmod(F.xxhash64(*_KEY), F.lit(packs)).cast("int").alias("pack"), every(parts).alias("part"), F.lit(-1).cast("long").alias("block"), *_KEY, "scores", *own
    )
    right = blocks.select(
        every(packs).alias("pack"), F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int").alias("part"), "block",
        F.lit(None).cast("long").alias("anchor_id"), F.lit(None).cast("long").alias("label"), F.lit(None).cast("array<int>").alias("vector"),
        F.lit(None).cast("array<long>").alias("scores"), "n", "width", "ids", "no_id", "labels", "columns",
    )
    tasks = max(shuffle_partitions(blocks.sparkSession), packs * parts)
    cells = left.unionByName(right).repartition(tasks, "pack", "part").sortWithinPartitions("pack", "part", "block", "anchor_id")
    return cells.mapInArrow(_cells(negatives), _FOUND)


def _first(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first ``k`` rows of each group over all cells, numbered from 1."""
    order = W.partitionBy(*by).orderBy(F.desc("score"), "no_id", "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    rows: DataFrame, anchor: Column | str = f"vec_id % {ANCHOR_EVERY} = 0", block_rows: int = BLOCK_ROWS, pack_anchors: int = PACK_ANCHORS,
    cell_numbers: int = CELL_NUMBERS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score) for the rows ``anchor`` picks, against all rows."""
    spark = rows.sparkSession
    good = usable(rows)
    folder = shared_folder(spark)
    good.mapInArrow(_blocks(block_rows), _BLOCK).write.parquet(f"{folder}/blocks")
    blocks = spark.read.parquet(f"{folder}/blocks")
    picked = good.where(F.expr(anchor) if isinstance(anchor, str) else anchor).where("vec_id IS NOT NULL")
    picked.groupBy(F.col("vec_id").alias("anchor_id"), "label", "vector").agg(F.count(F.lit(1)).alias("copies")).write.parquet(f"{folder}/anchors")
    anchors = spark.read.parquet(f"{folder}/anchors")
    n_anchors = anchors.count()
    numbers = blocks.agg(F.coalesce(F.sum(F.col("n").cast("long") * (F.col("width") + 4)), F.lit(0))).first()[0]
    packs = -(-n_anchors // pack_anchors) or 1
    # Enough cells for all tasks, and small ones: a task reads one or a few.
    parts = max(1, -(-shuffle_partitions(spark) // packs), -(-numbers // cell_numbers))

    own_score = F.aggregate(F.transform("vector", lambda x: x.cast("long") * x), F.lit(0).cast("long"), lambda a, x: a + x)
    near = _first(_on_grid(blocks, anchors.withColumn("scores", F.lit(None).cast("array<long>")), packs, parts, False), _KEY, POSITIVES + 1)
    # The anchor's row is one of the rows with its id and its own score.
    itself = (F.col("id") == F.col("anchor_id")) & ~F.col("no_id") & (F.col("score") == own_score)
    order = W.partitionBy(*_KEY).orderBy("rank")
    others = (
        near.withColumn("itself", F.coalesce(itself, F.lit(False)))
        .withColumn("first_itself", F.col("itself") & (F.sum(F.col("itself").cast("int")).over(order) == 1))
        .where(~F.col("first_itself"))
        .withColumn("positive", F.row_number().over(order) - 1)
        .where(F.col("positive") < POSITIVES)
    )
    one = F.struct("positive", "score", F.when(~F.col("no_id"), F.col("id")).alias("id"))
    others.groupBy(*_KEY).agg(F.array_sort(F.collect_list(one)).alias("p")).write.parquet(f"{folder}/positives")
    positives = spark.read.parquet(f"{folder}/positives")
    with_scores = positives.select(*_KEY, F.col("p.score").alias("scores"))
    far = _first(_on_grid(blocks, with_scores, packs, parts, True), [*_KEY, "positive"], NEGATIVES)
    return (
        far.join(positives, _KEY).join(anchors, _KEY)
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
        .withColumn("p", F.element_at("p", (F.col("positive") + 1).cast("int")))
        .select(
            "anchor_id", F.col("p.id").alias("positive_id"), F.col("rank").cast("int").alias("rank"),
            F.when(~F.col("no_id"), F.col("id")).alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("score").alias("negative_score"),
        )
    )


def op13(spark, sf_dir: str) -> DataFrame:
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = r"""
WITH good AS (
  SELECT row_number() OVER () AS r, vec_id,
    CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(greatest(-67108864.0, least(67108864.0, floor(256 * CAST(x AS DOUBLE)))) AS BIGINT)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
anchors AS (SELECT * FROM good WHERE vec_id % 100 = 0),
scores AS (
  SELECT a.r AS ar, a.vec_id AS anchor_id, b.vec_id AS id, b.label = a.label AS same,
    CAST(coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))), 0) AS BIGINT) AS score
  FROM anchors a JOIN good b ON a.r <> b.r),
positives AS (
  SELECT ar, anchor_id, id AS positive_id, score AS positive_score,
    row_number() OVER (PARTITION BY ar ORDER BY score DESC, id NULLS LAST) AS p
  FROM scores WHERE same QUALIFY p <= 5),
negatives AS (
  SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY ar, p ORDER BY n.score DESC, n.id NULLS LAST) AS rank,
    n.id AS negative_id, p.positive_score, n.score AS negative_score
  FROM positives p JOIN scores n USING (ar)
  WHERE NOT n.same AND 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score
  QUALIFY rank <= 10)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM negatives
"""

"""Packing documents into sequences (op 4), best-fit decreasing.

A document is tokenized once, closed with an end id and cut into full windows
and a rest. Pieces are spread evenly over tasks by hash and packed there from
the longest to the shortest: each goes to the tightest open window that has
room, which a segment tree over the remaining capacities finds in logarithmic
time. Every task packs thousands of pieces, so what it leaves open at its end
is a small part of its padding.

Defined results: null and empty texts are the end id alone; rows repeated in
the input are packed as often as they occur; ties in length fall by id, text
hash and start, so reruns agree; an empty table gives no pieces; other columns
are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, keyed, shuffle_partitions
from .tokens import text_ids, tokenizer_path

SEQUENCE_TOKENS = 2048
END_ID = 1
TOKENIZER = "word_bpe_49k.json"

_PIECE = "did long, th long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
_PIECE_ARROW = pa.schema([
    ("did", pa.int64()), ("th", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
    ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary()),
])


class CapacityTree:
    """Open windows by remaining capacity. Node i covers the capacities of its
    children 2 i and 2 i + 1 and tells whether any of them is open."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.some = bytearray(2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, capacity: int, window: int) -> None:
        self.windows[capacity].append(window)
        node, some = capacity + self.leaves, self.some
        while node and not some[node]:
            some[node] = 1
            node >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """(capacity, window) of a window with the smallest capacity of at
        least ``least``."""
        node, some = least + self.leaves, self.some
        while not some[node]:
            # Up to the first subtree to the right that has an open window.
            while node & 1:
                node >>= 1
                if not node:
                    return None
            node += 1
            if node & (node - 1) == 0:  # ran over the right edge
                return None
        while node < self.leaves:
            node = 2 * node if some[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        window = self.windows[capacity].pop()
        if not self.windows[capacity]:
            some[node] = 0
            node >>= 1
            while node and not (some[2 * node] or some[2 * node + 1]):
                some[node] = 0
                node >>= 1
        return capacity, window


class BestFit:
    def __init__(self, capacity: int) -> None:
        self.capacity, self.tree, self.opened = capacity, CapacityTree(capacity), 0

    def place(self, length: int) -> tuple[int, int]:
        """(window, offset) of the next piece; pieces come longest first."""
        found = self.tree.take(length) if length < self.capacity else None
        if found is None:
            room, window = self.capacity, self.opened
            self.opened += 1
        else:
            room, window = found
        if room > length:
            self.tree.put(room - length, window)
        return window, self.capacity - room


def _pieces(path: str | None, capacity: int, end_id: int, with_ids: bool):
    end = end_id.to_bytes(4, "little")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = text_ids(path or tokenizer_path(TOKENIZER))
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, 500):
                    part = batch.slice(at, 500)
                    rows = []
                    for did, th, doc_id, text in zip(*(part.column(c).to_pylist() for c in ("did", "th", "doc_id", "text"))):
                        ids = encode(text) + end
                        n = len(ids) // 4
                        for start in range(0, n, capacity):
                            own = ids[4 * start : 4 * (start + capacity)]
                            rows.append((did, th, doc_id, start, len(own) // 4, zlib.crc32(own), n, own if with_ids else None))
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PIECE_ARROW)], schema=_PIECE_ARROW)
        finally:
            encode.forget()

    return pieces


def _pack(capacity: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit, base = BestFit(capacity), TaskContext.get().partitionId() << 40
        for batch in batches:
            placed = [fit.place(n) for n in batch.column("length").to_pylist()]
            window, offset = np.array(placed, np.int64).reshape(-1, 2).T
            names = batch.schema.names + ["sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(window + base), pa.array(np.ascontiguousarray(offset))], names=names)

    return pack


def pack_documents(
    docs: DataFrame, tokenizer: str | None = None, capacity: int = SEQUENCE_TOKENS, end_id: int = END_ID, with_ids: bool = False
) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) for
    each piece, with ``ids`` (packed 32-bit) if asked for. ``tokenizer`` is the
    path of a tokenizers file that every executor can read."""
    pieces = keyed(docs).mapInArrow(_pieces(tokenizer, capacity, end_id, with_ids), _PIECE)
    spread = pieces.repartition(shuffle_partitions(docs.sparkSession), F.xxhash64("did", "th", "start")).sortWithinPartitions(
        F.desc("length"), "did", "th", "start"
    )
    out = spread.mapInArrow(_pack(capacity), _PIECE + ", sequence_id long, offset long")
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids)


def op4(spark, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))

"""Suffix-array dedup (op 10) with a logarithmic family of indexes.

Every byte covered by a string of 100 bytes that starts earlier in the corpus
(smaller document id, or earlier in the document) is removed.

Segments of the texts meet by anchor (see ``anchors``) in document order. Equal
segments are settled by identity; the others go, batch by batch, into an index
family: a batch gets a suffix array of its 100-byte strings, in which the later
ones of equal neighbours are duplicates; a merge scan against each existing
level finds the strings that earlier batches hold; what is new becomes a level,
and levels of equal size class merge, so there are only logarithmically many.
The family is emptied when a batch ends together with its anchor, as no later
segment can match it; it lives on across batches while an anchor goes on.

Defined results: null text is empty; rows equal in id and text are one document
stated twice and get equal results; rows that share an id but not a text are
ordered by text hash; null ids come first; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .anchors import SPAN, SPAN_ARROW, Windows, covered, grouped, segments, spans_by_document, with_key
from .common import documents, keyed

MATCH_BYTES = 100
ANCHOR_BYTES = 24
# Strings sorted at once.
BATCH_STRINGS = 1 << 17


class SuffixLevel:
    """Texts with the sorted places of their strings of ``width`` bytes."""

    def __init__(self, text: np.ndarray, order: np.ndarray, width: int) -> None:
        self.text, self.order, self.width = text, order, width

    def strings(self) -> np.ndarray:
        return strings_at(self.text, self.order, self.width)

    def merged(self, other: SuffixLevel) -> SuffixLevel:
        """Both levels as one; their strings are disjoint and sorted."""
        places = np.searchsorted(self.strings(), other.strings())
        order = np.insert(self.order, places, other.order + len(self.text))
        return SuffixLevel(np.concatenate((self.text, other.text)), order, self.width)


def strings_at(text: np.ndarray, places: np.ndarray, width: int) -> np.ndarray:
    """The ``width`` bytes from each place as fixed-width strings. All have one
    width, so the trailing zero bytes that comparison ignores cannot make two
    different strings equal."""
    if not len(places):
        return np.zeros(0, f"S{width}")
    rows = np.lib.stride_tricks.sliding_window_view(text, width)[places]
    return np.ascontiguousarray(rows).view(f"S{width}").ravel()


class IndexFamily:
    def __init__(self, width: int = MATCH_BYTES) -> None:
        self.width = width
        self.levels: list[SuffixLevel] = []

    def scan(self, text: np.ndarray, places: np.ndarray, keep: bool) -> np.ndarray:
        """Which of the batch's strings (places ascending) occur earlier; with
        ``keep`` the new ones are added."""
        found = strings_at(text, places, self.width)
        rank = np.argsort(found, kind="stable")
        array = found[rank]
        again = np.zeros(len(array), bool)
        again[1:] = array[1:] == array[:-1]
        heads = np.flatnonzero(~again)
        old = np.zeros(len(heads), bool)
        for level in self.levels:
            there = level.strings()
            at = np.searchsorted(there, array[heads])
            at[at == len(there)] = 0
            old |= there[at] == array[heads]
        new = heads[~old]
        again |= old[np.cumsum(~again) - 1]
        if keep and len(new):
            self._add(SuffixLevel(text, places[rank[new]], self.width))
        out = np.zeros(len(array), bool)
        out[rank] = again
        return out

    def _add(self, level: SuffixLevel) -> None:
        while self.levels and len(self.levels[-1].order).bit_length() <= len(level.order).bit_length():
            level = self.levels.pop().merged(level)
        self.levels.append(level)


def _scan(width: int, batch_strings: int):
    """Segments by anchor and place to duplicate spans."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int, int]] = []
        pending: list[tuple[int, int, int, bytes]] = []  # of closed anchors, then of the open one
        size = 0
        family = IndexFamily(width)

        def settle(open_anchor: bool) -> None:
            nonlocal pending, size
            if pending:
                text = np.frombuffer(b"".join(p[3] for p in pending), np.uint8)
                lengths = np.array([len(p[3]) for p in pending])
                begins = np.cumsum(lengths) - lengths
                counts = lengths - width + 1
                places = np.repeat(begins - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
                hit = family.scan(text, places, keep=open_anchor)
                _emit(hit, counts, pending, width, out)
            if not open_anchor:
                family.levels.clear()
            pending, size = [], 0

        current, seen, group, before = None, set(), [], None

        def close_anchor() -> None:
            """A lone segment has nothing to match but its equals."""
            nonlocal size, group
            if len(group) > 1 or family.levels:
                pending.extend(group)
                size += sum(len(g[3]) for g in group)
            group = []

        for anchor, rows in grouped(batches):
            if anchor != current:
                close_anchor()
                if size >= batch_strings or family.levels:
                    settle(open_anchor=False)
                current, seen, before = anchor, set(), None
            for did, th, start, payload, repeats in rows:
                if before != (did, th, start, payload):  # else the same row stated again
                    if payload in seen:
                        out.append((did, th, start, len(payload)))
                    else:
                        seen.add(payload)
                        group.append((did, th, start, payload))
                        before = (did, th, start, payload)
                if repeats:
                    for d, t, s in struct.iter_unpack("<qqq", repeats):
                        if (d, t, s) != (did, th, start):
                            out.append((d, t, s, len(payload)))
                if len(group) >= batch_strings // 32:
                    # A large anchor: index what came so far and go on.
                    if pending:
                        settle(open_anchor=False)
                    pending.extend(group)
                    group = []
                    settle(open_anchor=True)
            if len(out) > 50_000:
                yield _spans(out)
                out.clear()
        close_anchor()
        settle(open_anchor=False)
        if out:
            yield _spans(out)

    return scan


def _emit(hit: np.ndarray, counts: np.ndarray, pending: list, width: int, out: list) -> None:
    """Runs of duplicate strings within each segment as spans."""
    ends = np.cumsum(counts)
    owner = np.repeat(np.arange(len(counts)), counts)
    edge = np.flatnonzero(hit)
    if not len(edge):
        return
    fresh = np.concatenate(([True], (np.diff(edge) > 1) | (owner[edge[1:]] != owner[edge[:-1]])))
    heads = np.flatnonzero(fresh)
    tails = np.append(heads[1:], len(edge)) - 1
    for a, b in zip(edge[heads].tolist(), edge[tails].tolist()):
        i = int(owner[a])
        did, th, start, _ = pending[i]
        out.append((did, th, start + a - int(ends[i] - counts[i]), b - a + width))


def _spans(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=SPAN_ARROW)


def duplicate_spans(
    docs: DataFrame, width: int = MATCH_BYTES, gram: int = ANCHOR_BYTES, batch_strings: int = BATCH_STRINGS
) -> DataFrame:
    """(dk, spans): byte spans of each document that repeat earlier text.
    ``docs`` comes from ``anchors.with_key``."""
    runs = segments(docs, Windows(width, gram, "byte"))
    return spans_by_document(runs.mapInArrow(_scan(width, batch_strings), SPAN))



def _remove(with_kept: bool):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept_all, sizes, removed, runs, shas = [], [], [], [], []
            for th, text, spans in zip(batch.column("th").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist()):
                kept, n = text, 0
                if spans:
                    gone = covered(spans, th, len(text))
                    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                    n = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1])) if len(gone) else 0
                kept_all.append(kept)
                sizes.append(len(text))
                removed.append(len(text) - len(kept))
                runs.append(n)
                shas.append(hashlib.sha256(kept).hexdigest())
            arrays, names = [batch.column("doc_id")], ["doc_id"]
            if with_kept:
                # A cut may fall inside a character; its rest goes with it.
                arrays = [batch.column("row"), pa.array([k.decode("utf-8", "ignore") for k in kept_all], pa.string())]
                names = ["row", "kept_text"]
            arrays += [pa.array(x, pa.int64()) for x in (sizes, removed, runs)] + [pa.array(shas, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return remove


_FIGURES = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def removal_figures(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each document."""
    keys = with_key(keyed(docs))
    rows = keys.join(duplicate_spans(keys, **options), "dk", "left")
    return rows.mapInArrow(_remove(False), f"doc_id long, {_FIGURES}")


def remove_repeated_bytes(docs: DataFrame, **options) -> DataFrame:
    """The documents with their repeated spans cut out of ``text``; ``n_chars``
    follows and other columns stay. No row goes, even if nothing is left of
    its text; a null text stays null."""
    columns = docs.columns
    rest = [c for c in columns if c != "text"]
    keys = keyed(docs, F.struct(*[F.col(c) for c in rest], F.col("text").isNull().alias("__null_text")).alias("row"))
    keys = with_key(keys)
    spans = duplicate_spans(keys, **options)
    rows = keys.join(spans, "dk", "left")
    out = rows.mapInArrow(_remove(True), T.StructType([rows.schema["row"], *T.StructType.fromDDL(f"kept_text string, {_FIGURES}")]))
    text = F.when(~F.col("row.__null_text"), F.col("kept_text"))
    made = {"text": text.alias("text")}
    if "n_chars" in columns:
        made["n_chars"] = F.when(~F.col("row.__null_text"), F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars")).alias("n_chars")
    return out.select(*[made.get(c, F.col("row").getField(c).alias(c)) for c in columns])


def op10(spark, sf_dir: str) -> DataFrame:
    return removal_figures(documents(spark, sf_dir))


ORACLE = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
u AS (SELECT doc_id, b, unnest(range(1, octet_length(b) + 1)) AS i FROM d),
dup AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, md5(b[i:i + 99]) AS k FROM u WHERE i + 99 <= octet_length(b))
  QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
marks AS (
  SELECT doc_id, i, max(i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM dup),
runs AS (
  SELECT doc_id, i, sum(CASE WHEN p IS NULL OR i > p + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM marks),
gone AS (SELECT doc_id, r, min(i) AS a, max(i) + 99 AS z FROM runs GROUP BY doc_id, r),
cuts AS (
  SELECT doc_id, a, z, lag(z) OVER (PARTITION BY doc_id ORDER BY a) AS q FROM gone),
kept AS (
  SELECT doc_id, count(*) AS n, sum(z - a + 1) AS removed,
         string_agg(hex(d.b[coalesce(q, 0) + 1:a - 1]), '' ORDER BY a) AS head, max(z) AS z
  FROM cuts JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
       sha256(CASE WHEN n IS NULL THEN b ELSE unhex(head || hex(b[z + 1:octet_length(b)])) END) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

"""Substring dedup (op 9) by relative Lempel-Ziv parsing.

Every word covered by a window of 20 words whose word sequence starts earlier
in the corpus (smaller document id, or earlier in the document) is removed.

Texts are cut into segments that meet in the reference block of their anchor
(see ``anchors``). A block keeps the segments that brought something new as its
reference; each later segment is factored greedily against it: the longest
match from the current place becomes a factor, and parsing goes on at the
factor's end. The symbols are whole windows, so a factor of n symbols is a
match of n + 19 words, every factor is long enough to be a duplicate, and the
window that straddles the end of a factor is a symbol of its own, looked up
when the parse goes on there. Nothing can hide between two factors.

Defined results: null or empty text has no words and keeps the empty string;
rows equal in id and text are one document stated twice and get equal results;
rows that share an id but not a text are ordered by text hash; null ids come
first; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .anchors import SPAN, SPAN_ARROW, Windows, covered, grouped, segments, spans_by_document, with_key
from .common import keyed

WINDOW_WORDS = 20
ANCHOR_WORDS = 6
WORD = re.compile(r"[^\x20\x09-\x0D]+")


class ReferenceBlock:
    """Window symbols of one anchor with an index of their first place."""

    def __init__(self) -> None:
        self.text: list[bytes] = []
        self.index: dict[bytes, int] = {}

    def factors(self, symbols: list[bytes]) -> Iterator[tuple[int, int]]:
        """Greedy factors as (place, length in symbols); literals are skipped."""
        i, n, text = 0, len(symbols), self.text
        while i < n:
            j = self.index.get(symbols[i])
            if j is None:
                i += 1
                continue
            k = 1
            while i + k < n and j + k < len(text) and text[j + k] == symbols[i + k]:
                k += 1
            yield i, k
            i += k

    def add(self, symbols: list[bytes]) -> None:
        base = len(self.text)
        self.text.extend(symbols)
        for i, s in enumerate(symbols):
            self.index.setdefault(s, base + i)


def _parse(window: int):
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, block, seen, before = None, ReferenceBlock(), set(), None
        out: list[tuple[int, int, int, int]] = []
        for anchor, rows in grouped(batches):
            if anchor != current:
                current, block, seen, before = anchor, ReferenceBlock(), set(), None
            for did, th, start, payload, repeats in rows:
                n = len(payload) // 8
                if before != (did, th, start, payload):  # else the same row stated again
                    if payload in seen:
                        out.append((did, th, start, n + window - 1))
                    else:
                        symbols = [payload[i : i + 8] for i in range(0, len(payload), 8)]
                        found = 0
                        for at, size in block.factors(symbols):
                            out.append((did, th, start + at, size + window - 1))
                            found += size
                        if found < n:
                            block.add(symbols)
                        seen.add(payload)
                        before = (did, th, start, payload)
                if repeats:
                    for d, t, s in struct.iter_unpack("<qqq", repeats):
                        if (d, t, s) != (did, th, start):
                            out.append((d, t, s, n + window - 1))
            if len(out) > 50_000:
                yield _spans(out)
                out = []
        if out:
            yield _spans(out)

    return parse


def _spans(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=SPAN_ARROW)


def duplicate_spans(docs: DataFrame, window: int = WINDOW_WORDS, gram: int = ANCHOR_WORDS) -> DataFrame:
    """(dk, spans): word spans of each document that repeat earlier text.
    ``docs`` comes from ``anchors.with_key``."""
    runs = segments(docs, Windows(window, gram, "word"))
    return spans_by_document(runs.mapInArrow(_parse(window), SPAN))


_RESULT = "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string"
_RESULT_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("kept_sha256", pa.string()),
])


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        # Small slices keep the rebuilt texts of a batch bounded.
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            out = []
            for doc_id, th, text, spans in zip(*(part.column(c).to_pylist() for c in ("doc_id", "th", "text", "spans"))):
                kept = found = WORD.findall(text)
                if spans:
                    gone = covered(spans, th, len(found)).tolist()
                    kept = [w for w, g in zip(found, gone) if not g]
                kept_text = " ".join(kept)
                out.append((doc_id, len(found), len(found) - len(kept), kept_text, hashlib.sha256(kept_text.encode()).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _RESULT_ARROW)], schema=_RESULT_ARROW)


def remove_repeated_words(docs: DataFrame, window: int = WINDOW_WORDS, gram: int = ANCHOR_WORDS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text, kept_sha256) for each document:
    its words without those covered by a window that starts earlier."""
    keys = with_key(keyed(docs))
    spans = duplicate_spans(keys, window, gram)
    return keys.join(spans, "dk", "left").mapInArrow(_remove, _RESULT)


def op9(spark, sf_dir: str) -> DataFrame:
    from .common import documents

    return remove_repeated_words(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE = r"""
WITH w AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
u AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 19], ' ')) AS k FROM u WHERE i + 19 <= len(ws)),
dup AS (
  SELECT doc_id, i FROM win
  QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM dup, range(0, 20) t(j)),
kept AS (
  SELECT u.doc_id, string_agg(ws[u.i], ' ' ORDER BY u.i) AS t, count(*) AS n
  FROM u ANTI JOIN gone USING (doc_id, i) GROUP BY u.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

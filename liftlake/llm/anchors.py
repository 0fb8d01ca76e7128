"""Content-defined routing of repeated windows.

Two equal windows of ``window`` units (words or bytes) pick the same k-gram as
their anchor: the one with the smallest hash, the leftmost on ties. So equal
windows meet when rows are grouped by anchor, and a text needs only a few rows:
one for each run of neighbouring windows with one anchor occurrence.

``repeated_anchors`` finds, over all documents, the anchors that occur more
than once; ``segments`` then cuts the runs around those out of the texts. Both
work on whole texts and neither drops anything that a repeated window needs:
an anchor that occurs once cannot belong to a repeated window.

Hot anchors (a passage in a third of all documents) stay small: a task sends an
anchor once for each text chunk however often it occurs there, and equal runs
of a chunk travel as one row with the list of places.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions, text_chunks
from .hashing import byte_values, gram_hashes, mix, window_minima, words

# A text has fewer than 2**31 bytes. Where the hash bits above the place agree,
# the first gram of a window is its smallest, in equal windows the same one.
_POS_MASK = np.uint64((1 << 31) - 1)
_TOLD = np.iinfo(np.int64).max  # marks an entry whose places are already known


@dataclass(frozen=True)
class Windows:
    """What a window is: ``window`` units with anchors of ``gram`` units."""

    window: int
    gram: int
    unit: str  # "word" or "byte"

    def units(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.unit == "word":
            return words(raw, bounds)
        return byte_values(raw), bounds

    def runs(self, values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first window, last window, anchor place, anchor hash) of each run;
        places are unit numbers in the chunk. Windows never cross texts."""
        grams = gram_hashes(values, self.gram)
        n = len(values) - self.window + 1
        none = np.zeros(0, np.int64)
        if n <= 0:
            return none, none, none, none.astype(np.uint64)
        keys = (grams & ~_POS_MASK) | np.arange(len(grams), dtype=np.uint64)
        best = window_minima(keys, self.window - self.gram + 1)
        long_enough = np.diff(bounds) >= self.window
        step = np.zeros(n + 1, np.int32)
        np.add.at(step, bounds[:-1][long_enough], 1)
        np.add.at(step, bounds[1:][long_enough] - self.window + 1, -1)
        at = np.flatnonzero(np.cumsum(step[:n]))
        if not len(at):
            return none, none, none, none.astype(np.uint64)
        place = (best[at] & _POS_MASK).astype(np.int64)
        cut = np.flatnonzero(place[1:] != place[:-1]) + 1
        first = np.concatenate(([0], cut))
        last = np.concatenate((cut, [len(at)])) - 1
        return at[first], at[last], place[first], grams[place[first]]


def _pack6(h: np.ndarray) -> bytes:
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpack6(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return wide.view("<u8").ravel()


def _rows(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


_SENT = "bucket int, did long, hashes binary, dids binary, places binary"
_SENT_ARROW = pa.schema([("bucket", pa.int32()), ("did", pa.int64()), ("hashes", pa.binary()), ("dids", pa.binary()), ("places", pa.binary())])


def _send(win: Windows, buckets: int) -> Callable:
    """Anchor entries of each chunk, packed by bucket; places of anchors that
    repeat inside the chunk are sent on as already known (``did`` not null)."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dids = batch.column("did").to_numpy()
            for row, raw, bounds in text_chunks(batch.column("text")):
                values, unit_bounds = win.units(raw, bounds)
                _, _, place, anchor = win.runs(values, unit_bounds)
                if not len(place):
                    continue
                doc = np.searchsorted(unit_bounds, place, side="right") - 1
                did, place = dids[row + doc], place - unit_bounds[doc]
                out: dict[str, list] = {f.name: [] for f in _SENT_ARROW}

                def put(bucket, key, hashes, ids, places):
                    for name, value in zip(out, (bucket, key, hashes, ids, places)):
                        out[name].append(value)

                order = np.argsort(anchor, kind="stable")
                anchor, did, place, doc = anchor[order], did[order], place[order], doc[order]
                begins = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
                count = np.diff(np.append(begins, len(anchor)))
                again = np.repeat(count > 1, count)
                # Places that are known to repeat, by document.
                known = np.flatnonzero(again)
                known = known[np.argsort(doc[known], kind="stable")]
                if len(known):
                    for part in np.split(known, np.flatnonzero(np.diff(doc[known])) + 1):
                        put(int(did[part[0]]) % buckets, int(did[part[0]]), None, None, place[part].astype("<u4").tobytes())
                # One entry for each anchor of the chunk.
                h, ids, at = anchor[begins], np.where(count > 1, _TOLD, did[begins]), place[begins].astype("<u4")
                bucket = (((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)
                edges = np.searchsorted(bucket, np.arange(buckets + 1))  # h is sorted, and so is bucket
                for b in np.flatnonzero(np.diff(edges)):
                    s = slice(edges[b], edges[b + 1])
                    put(int(b), None, _pack6(h[s]), ids[s].astype("<i8").tobytes(), at[s].tobytes())
                yield _rows(_SENT_ARROW, **out)

    return send


_PLACES_ARROW = pa.schema([("did", pa.int64()), ("places", pa.binary())])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the buckets in this partition, the places of anchors with more than
    one entry, by document."""
    blocks: dict[int, list] = {}
    for batch in batches:
        for bucket, did, hashes, ids, places in zip(*(batch.column(f.name).to_pylist() for f in _SENT_ARROW)):
            if did is None:
                blocks.setdefault(bucket, []).append((hashes, ids, places))
        known = batch.filter(batch.column("did").is_valid())
        if known.num_rows:
            yield _rows(_PLACES_ARROW, did=known.column("did"), places=known.column("places"))
    for parts in blocks.values():
        h = np.concatenate([_unpack6(p[0]) for p in parts])
        did = np.concatenate([np.frombuffer(p[1], "<i8") for p in parts])
        place = np.concatenate([np.frombuffer(p[2], "<u4") for p in parts])
        order = np.argsort(h)
        s = h[order]
        same = s[1:] == s[:-1]
        more = np.zeros(len(s), bool)
        more[1:] |= same
        more[:-1] |= same
        keep = order[more]
        keep = keep[did[keep] != _TOLD]
        if not len(keep):
            continue
        keep = keep[np.argsort(did[keep], kind="stable")]
        ids, at = did[keep], place[keep]
        begins = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
        ends = np.append(begins[1:], len(ids))
        data = at.tobytes()
        yield _rows(_PLACES_ARROW, did=ids[begins], places=[data[4 * a : 4 * b] for a, b in zip(begins, ends)])


def repeated_anchors(docs: DataFrame, win: Windows) -> DataFrame:
    """(dk, places): for each document its anchors that occur elsewhere too,
    as packed 32-bit places. 48 hash bits and the bucket tell anchors apart; a
    chance collision only adds a place, which later steps find unrepeated. So
    does one of two ``dk``. ``docs`` comes from ``with_key``."""
    buckets = shuffle_partitions(docs.sparkSession)
    sent = docs.select(F.col("dk").alias("did"), "text").mapInArrow(_send(win, buckets), _SENT)
    met = sent.repartition(buckets, "bucket").mapInArrow(_meet, "did long, places binary")
    return met.groupBy(F.col("did").alias("dk")).agg(F.collect_list("places").alias("places"))


def with_key(docs: DataFrame) -> DataFrame:
    """Documents of ``common.keyed`` with ``dk``, which names a row by its id
    and text alike: texts without an id, or under one id, stay apart."""
    return docs.withColumn("dk", _key())


def _key():
    # 62 bits, so that it is never the mark of ``_send``.
    return F.shiftrightunsigned(F.xxhash64("did", "th"), 2)


SEGMENT = "anchor long, did long, th long, start long, payload binary, repeats binary"
_SEGMENT_ARROW = pa.schema([
    ("anchor", pa.int64()), ("did", pa.int64()), ("th", pa.int64()), ("start", pa.int64()), ("payload", pa.binary()), ("repeats", pa.binary()),
])


def _cut(win: Windows) -> Callable:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dids, ths = batch.column("did").to_numpy(), batch.column("th").to_numpy()
            lists = batch.column("places")
            for row, raw, bounds in text_chunks(batch.column("text")):
                values, unit_bounds = win.units(raw, bounds)
                first, last, place, anchor = win.runs(values, unit_bounds)
                if not len(first):
                    continue
                wanted = np.zeros(len(values), bool)
                for i in range(len(bounds) - 1):
                    for data in lists[row + i].as_py():
                        at = np.frombuffer(data, "<u4").astype(np.int64) + unit_bounds[i]
                        wanted[at[at < unit_bounds[i + 1]]] = True
                keep = wanted[place]
                first, last, anchor = first[keep], last[keep], anchor[keep]
                if not len(first):
                    continue
                doc = np.searchsorted(unit_bounds, first, side="right") - 1
                did, th, start = dids[row + doc], ths[row + doc], first - unit_bounds[doc]
                if win.unit == "word":
                    symbols, size = gram_hashes(values, win.window), last - first + 1
                else:
                    symbols, size = raw, last - first + win.window
                # Equal runs of the chunk travel once, as their first place.
                order = np.lexsort((start, th, did))
                first, size, anchor, did, th, start = (x[order] for x in (first, size, anchor, did, th, start))
                offsets = np.concatenate(([0], np.cumsum(size)))
                data = symbols[np.repeat(first - offsets[:-1], size) + np.arange(offsets[-1])].tobytes()
                width = 8 if win.unit == "word" else 1
                rows: dict[bytes, int] = {}
                repeats: dict[int, list[int]] = {}
                payloads = []
                picked = []
                for i, (a, b) in enumerate(zip((offsets[:-1] * width).tolist(), (offsets[1:] * width).tolist())):
                    body = data[a:b]
                    j = rows.setdefault(body, i)
                    if j == i:
                        picked.append(i)
                        payloads.append(body)
                    else:
                        repeats.setdefault(j, []).append(i)
                places = np.stack((did, th, start), axis=1).astype("<i8")
                yield _rows(
                    _SEGMENT_ARROW, anchor=anchor[picked].view(np.int64), did=did[picked], th=th[picked], start=start[picked],
                    payload=payloads, repeats=[places[repeats[i]].tobytes() if i in repeats else None for i in picked],
                )

    return cut


def segments(docs: DataFrame, win: Windows) -> DataFrame:
    """Rows (anchor, did, th, start, payload, repeats), partitioned by anchor
    and sorted by anchor and place. ``payload`` holds the run's window hashes
    (words) or its bytes; ``repeats`` the later places of an equal run."""
    # All columns go along: the caller's join by ``dk`` then reads the same
    # shuffled texts as this one instead of shuffling them again.
    return (
        docs.join(repeated_anchors(docs, win), "dk")
        .mapInArrow(_cut(win), SEGMENT)
        .repartition(shuffle_partitions(docs.sparkSession), "anchor")
        .sortWithinPartitions("anchor", "did", "th", "start")
    )


SPAN = "did long, th long, start long, length long"
SPAN_ARROW = pa.schema([("did", pa.int64()), ("th", pa.int64()), ("start", pa.int64()), ("length", pa.int64())])


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Segments of one Arrow batch by anchor: (anchor, [(did, th, start,
    payload, repeats), ...]). An anchor that goes on in the next batch comes
    again; its caller keeps the state."""
    for batch in batches:
        anchors = batch.column("anchor").to_numpy()
        cuts = [0, *(np.flatnonzero(anchors[1:] != anchors[:-1]) + 1).tolist(), len(anchors)]
        rows = list(zip(*(batch.column(c).to_pylist() for c in ("did", "th", "start", "payload", "repeats"))))
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b > a:
                yield int(anchors[a]), rows[a:b]


def spans_by_document(spans: DataFrame) -> DataFrame:
    """(dk, spans)."""
    return spans.groupBy(_key().alias("dk")).agg(F.collect_list(F.struct("th", "start", "length")).alias("spans"))


def covered(spans: list, th: int, size: int) -> np.ndarray:
    """Boolean mask of the units that the spans of this text cover."""
    step = np.zeros(size + 1, np.int32)
    for s in spans:
        if s["th"] != th:
            continue
        step[s["start"]] += 1
        step[min(s["start"] + s["length"], size)] -= 1
    return np.cumsum(step[:size]) > 0


__all__ = ["Windows", "repeated_anchors", "segments", "grouped", "spans_by_document", "covered", "mix", "with_key"]

"""Cross-tokenizer alignment (op 12) by products of token-byte incidences.

The tokens of two tokenizers over the same bytes are rows of incidence matrices
A and B with a column for each byte, held in CSR. Gustavson's row products of
A and the transpose of B give the overlap links: an entry (a, b) counts the bytes
that both tokens cover. Byte places where tokens of both end cut the text into
groups; the product of the two token-group incidences gives the links of tokens
that share a group. The overlap links are among them.

Neither tokenizer has a token over a space that follows a word and precedes
another, so the matrices of a text are block-diagonal: one block for each cut
unit, " word" mostly. A task computes the blocks of the distinct units it meets
by one product over all of them and keeps them; a text without such a space is
one unit.

How many documents hold an id pair linked is counted corpus-wide. Documents
lie in chunks of ``CHUNK_CHARS`` characters, a row each, that list the distinct
pairs of the chunk; each chunk sends a pair once with its number of documents,
gets back the corpus count and whether it is the highest of its A id, and then
settles its documents. Frequent pairs thus cost a row a chunk, not a row a link.

Defined results: null and empty texts, and texts of which either tokenizer's
bytes differ from space + text, have no tokens: zeros and an empty
``groups_sha256``; rows that repeat are documents of their own; null ids are
kept; an empty table gives no rows; other columns are ignored. A task holds one
chunk, or one longer text, at a time.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, shared_folder, shuffle_partitions
from .tokens import _byte_letters, tokenizer_path

TOKENIZER_A, TOKENIZER_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
CHUNK_CHARS = 1 << 22
# Units kept at once in a worker, some hundred bytes each.
MAX_UNITS, MAX_CHARS = 1 << 19, 1 << 25
# Characters of new units in one product.
BATCH_CHARS = 1 << 16
# In place of numbers: white space at an edge, bytes that differ.
EDGE, DIFFERS = -2, -1
_CUT = re.compile(r"(?<=\S) (?=\S)")
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>\Z")


class Csr:
    """A sparse matrix by rows: the columns of row i are
    ``indices[indptr[i]:indptr[i + 1]]``, with values ``data``."""

    def __init__(self, indptr: np.ndarray, indices: np.ndarray, data: np.ndarray, width: int) -> None:
        self.indptr, self.indices, self.data, self.width = indptr, indices, data, width

    @classmethod
    def intervals(cls, ends: np.ndarray, width: int) -> Csr:
        """Row i covers the columns from the end of row i - 1 to ``ends[i]``."""
        return cls(np.concatenate(([0], ends)), np.arange(width), np.ones(width, np.int64), width)

    @classmethod
    def one_each(cls, column: np.ndarray, width: int) -> Csr:
        return cls(np.arange(len(column) + 1), column, np.ones(len(column), np.int64), width)

    def transposed(self) -> Csr:
        row = np.repeat(np.arange(len(self.indptr) - 1), np.diff(self.indptr))
        order = np.argsort(self.indices, kind="stable")
        count = np.bincount(self.indices, minlength=self.width)
        return Csr(np.concatenate(([0], np.cumsum(count))), row[order], self.data[order], len(self.indptr) - 1)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.indptr) - 1), np.diff(self.indptr))

    def times(self, other: Csr) -> Csr:
        """Gustavson: row i of the product is the sum of the rows of ``other``
        that row i's columns name, each times its value. All rows at once: the
        named rows are laid out one after the other, then equal places summed."""
        size = np.diff(other.indptr)[self.indices]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(other.indptr[self.indices] - (ends - size), size) + np.arange(total)
        column, value = other.indices[at], np.repeat(self.data, size) * other.data[at]
        row = np.repeat(self.rows(), size)
        place = row * np.int64(max(other.width, 1)) + column
        if total and (np.diff(place) < 0).any():
            order = np.argsort(place, kind="stable")
            place, value = place[order], value[order]
        heads = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1]))) if total else np.zeros(0, np.int64)
        value = np.add.reduceat(value, heads) if total else value
        place = place[heads]
        count = np.bincount(place // max(other.width, 1), minlength=len(self.indptr) - 1)
        return Csr(np.concatenate(([0], np.cumsum(count))), place % max(other.width, 1), value, other.width)


def align(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[Csr, Csr, np.ndarray]:
    """(overlap links, shared-group links, group ends in bytes) of two runs of
    tokens over the same bytes, given by where each token ends."""
    width = int(ends_a[-1]) if len(ends_a) else 0
    a, b = Csr.intervals(ends_a, width), Csr.intervals(ends_b, width)
    cuts = np.intersect1d(ends_a, ends_b)
    group_a, group_b = (Csr.one_each(np.searchsorted(cuts, e), len(cuts)) for e in (ends_a, ends_b))
    return a.times(b.transposed()), group_a.times(group_b.transposed()), cuts


class Aligner:
    """Aligned units, numbered as they are met. A unit is named by its text
    without the space that it starts with."""

    def __init__(self, path_a: str, path_b: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte = {c: b for b, c in _byte_letters().items()}
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = {i: bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t, i in vocabulary.items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(m[1], 16)]) if (m := _BYTE_PIECE.match(p)) else p.replace("\u2581", " ").encode() for p in pieces]
        # Cuts before a space are safe if no piece goes over one.
        self.cuts = not any("\u2581" in p.lstrip("\u2581") for p in pieces)
        table = lambda named: np.array([len(named.get(i, b"")) for i in range(max(named) + 1)], np.int64)
        self.length_a, self.length_b = table(self.bytes_a), table(dict(enumerate(self.bytes_b)))
        self.forget()

    def forget(self) -> None:
        self.numbers: dict[str, int] = {}  # by unit
        self.apart: dict[str, int] = {}  # by unit with white space at an edge
        self.groups: list[str] = []
        self.sizes = np.zeros((0, 3), np.int64)  # A tokens, B tokens, groups
        self.pairs, self.pair_ends = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.chars = 0

    def tokens(self, text: str) -> tuple[list[int], list[int]] | None:
        """Ids of space + text by both tokenizers, None if their bytes differ
        from it."""
        a = self.a.encode(" " + text, add_special_tokens=False).ids
        b = self.b.encode(text, num_threads=1)
        raw = b" " + text.encode()
        if b"".join([self.bytes_a[i] for i in a]) != raw or b"".join([self.bytes_b[i] for i in b]) != raw:
            return None
        return a, b

    def ends(self, a: list[int], b: list[int]) -> tuple[np.ndarray, np.ndarray]:
        return np.cumsum(self.length_a[np.array(a, np.int64)]), np.cumsum(self.length_b[np.array(b, np.int64)])

    def numbered(self, texts: list[str]) -> list[np.ndarray]:
        """The numbers of each text's units; none for a text without tokens."""
        cut = [t.split(" ") if t and self.cuts else [t] * bool(t) for t in texts]
        self._learn(self.numbers, dict.fromkeys(chain.from_iterable(cut)), alone=not self.cuts)
        out = []
        for text, words in zip(texts, cut):
            found = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
            if len(found) and found.min() == EDGE:
                first, *rest = _CUT.split(" " + text)
                words = [first[1:], *rest]
                self._learn(self.apart, dict.fromkeys(words), True)
                found = np.fromiter(map(self.apart.__getitem__, words), np.int64, len(words))
            out.append(found if len(found) and found.min() >= 0 else found[:0])
        return out

    def _learn(self, numbers: dict[str, int], units: Iterable[str], alone: bool) -> None:
        """Numbers for units not met before. Units without white space at their
        edges are encoded together, a space apart, as they lie in texts."""
        batch, size = [], 0
        for unit in units:
            if unit in numbers:
                continue
            self.chars += len(unit)
            if alone:
                self._settle(numbers, [unit])
                continue
            if not unit or unit[0].isspace() or unit[-1].isspace():
                numbers[unit] = EDGE
                continue
            batch.append(unit)
            size += len(unit)
            if size >= BATCH_CHARS:
                self._settle(numbers, batch)
                batch, size = [], 0
        if batch:
            self._settle(numbers, batch)

    def _settle(self, numbers: dict[str, int], units: list[str]) -> None:
        found = self.tokens(" ".join(units))
        if found is None:
            if len(units) == 1:
                numbers[units[0]] = DIFFERS
            else:
                for unit in units:
                    self._settle(numbers, [unit])
            return
        ids_a, ids_b = np.array(found[0], np.int64), np.array(found[1], np.int64)
        ends_a, ends_b = self.ends(*found)
        links, shared, cuts = align(ends_a, ends_b)
        unit_ends = np.cumsum([len(u.encode()) + 1 for u in units])
        past = np.searchsorted(cuts, unit_ends) + 1  # groups up to each unit's end
        past_a, past_b = np.searchsorted(ends_a, unit_ends) + 1, np.searchsorted(ends_b, unit_ends) + 1
        # A group's B tokens are linked with its first A token, and so back.
        starts = np.concatenate(([0], cuts[:-1]))
        in_b = np.diff(shared.indptr)[np.searchsorted(ends_a, starts, side="right")]
        in_a = np.diff(shared.transposed().indptr)[np.searchsorted(ends_b, starts, side="right")]
        # Names in the order A side, B side of each group, each with the mark after it.
        side = np.repeat(np.tile([0, 1], len(cuts)), np.stack([in_a, in_b], 1).ravel())
        names = np.empty(len(side), np.int64)
        names[side == 0], names[side == 1] = ids_a, ids_b
        marks = np.full(len(side), ",", "U1")
        group_ends = np.cumsum(in_a + in_b)
        marks[group_ends - in_b - 1], marks[group_ends - 1] = "|", ";"
        unit_at = group_ends[past - 1]
        marks[unit_at - 1] = ""
        mixed = [None] * (2 * len(side))
        mixed[::2], mixed[1::2] = map(str, names.tolist()), marks.tolist()
        first = len(self.groups)
        numbers.update(zip(units, range(first, first + len(units))))
        at = [0, *(2 * unit_at).tolist()]
        self.groups += ["".join(mixed[x:y]) for x, y in zip(at, at[1:])]
        own = ids_a[links.rows()] << 32 | ids_b[links.indices]
        last = self.pair_ends[-1] if len(self.pair_ends) else 0
        self.sizes = np.concatenate((self.sizes, np.diff(np.stack([past_a, past_b, past], 1), axis=0, prepend=0)))
        self.pairs, self.pair_ends = np.concatenate((self.pairs, own)), np.concatenate((self.pair_ends, last + links.indptr[past_a]))


@functools.lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    """One for each worker and files; its units serve all tasks of the worker."""
    return Aligner(path_a, path_b)


_CHUNK = (
    "chunk long, doc_ids binary, no_id binary, sizes binary, digests binary, entries int, bounds binary, places binary, times binary,"
    " pairs binary, in_docs binary"
)
_CHUNK_ARROW = pa.schema([
    ("chunk", pa.int64()), ("doc_ids", pa.binary()), ("no_id", pa.binary()), ("sizes", pa.binary()), ("digests", pa.binary()), ("entries", pa.int32()),
    ("bounds", pa.binary()), ("places", pa.binary()), ("times", pa.binary()), ("pairs", pa.binary()), ("in_docs", pa.binary()),
])


def _spread(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers first[i], first[i] + 1, ... of each run, one run after the other."""
    ends = np.cumsum(length)
    return np.repeat(first - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)


def chunk_row(own: Aligner, chunk: int, doc_ids: list[int | None], texts: list[str]) -> tuple:
    """A chunk's documents: sizes (A tokens, B tokens, groups, links) and digest
    of each, which of the chunk's pairs each holds and how often, and the pairs
    with their number of documents."""
    numbers = own.numbered(texts)
    digests = [hashlib.sha256(";".join(map(own.groups.__getitem__, n.tolist())).encode()).digest() if len(n) else bytes(32) for n in numbers]
    used, unit = np.unique(np.concatenate([*numbers, np.zeros(0, np.int64)]), return_inverse=True)
    doc = np.repeat(np.arange(len(texts)), [len(n) for n in numbers])
    sizes = np.zeros((len(texts), 4), np.int64)
    # A document's units, then their pairs, each with how often it occurs.
    held, often = np.unique(doc * max(len(used), 1) + unit, return_counts=True)
    doc, unit = np.divmod(held, max(len(used), 1))
    np.add.at(sizes[:, :3], doc, own.sizes[used][unit] * often[:, None])
    first = np.concatenate(([0], own.pair_ends))[used]
    length = own.pair_ends[used] - first
    at = _spread(first, length)
    pairs, place = np.unique(own.pairs[at], return_inverse=True)
    first = np.cumsum(length) - length
    n = length[unit]
    at = _spread(first[unit], n)
    key = np.repeat(doc, n) * max(len(pairs), 1) + place[at]
    order = np.argsort(key, kind="stable")
    key, weight = key[order], np.repeat(often, n)[order]
    heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    times = np.add.reduceat(weight, heads) if len(key) else weight
    doc, place = np.divmod(key[heads], max(len(pairs), 1))
    np.add.at(sizes[:, 3], doc, times)
    pack = lambda x: pa.compress(x.tobytes(), codec="zstd", asbytes=True)
    return (
        chunk, np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], np.uint8).tobytes(),
        sizes.astype("<i8").tobytes(), b"".join(digests), len(place), np.searchsorted(doc, np.arange(len(texts) + 1)).astype("<i8").tobytes(),
        pack(place.astype("<u4")), pack(times.astype("<u4")), pairs.astype("<i8").tobytes(),
        np.bincount(place, minlength=len(pairs)).astype("<i4").tobytes(),
    )


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _chunks(path_a: str | None, path_b: str | None, chars: int):
    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(path_a or tokenizer_path(TOKENIZER_A), path_b or tokenizer_path(TOKENIZER_B))
        number, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0

        def close():
            row = chunk_row(own, number, ids, texts)
            if len(own.numbers) > MAX_UNITS or own.chars > MAX_CHARS:
                own.forget()
            return _batch([row], _CHUNK_ARROW)

        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    if texts and size + len(text or "") > chars:
                        yield close()
                        number, ids, texts, size = number + 1, [], [], 0
                    ids.append(doc_id)
                    texts.append(text or "")
                    size += len(texts[-1])
        if texts:
            yield close()

    return chunks


_PAIR_ARROW = pa.schema([("chunk", pa.int64()), ("at", pa.int32()), ("pair", pa.int64()), ("n", pa.int64())])


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            pairs, n = (np.frombuffer(batch.column(c)[i].as_py(), t) for c, t in (("pairs", "<i8"), ("in_docs", "<i4")))
            chunk = np.full(len(pairs), batch.column("chunk")[i].as_py())
            yield pa.RecordBatch.from_arrays([pa.array(chunk), pa.array(np.arange(len(pairs), dtype=np.int32)), pa.array(pairs), pa.array(n.astype(np.int64))], schema=_PAIR_ARROW)


_OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_OUT_ARROW = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), ("groups_sha256", pa.string())])


def _settled(row: dict, total: np.ndarray, best: np.ndarray) -> pa.RecordBatch:
    unpack = lambda x: np.frombuffer(pa.decompress(x, 4 * row["entries"], codec="zstd", asbytes=True), "<u4")
    place, times = unpack(row["places"]), unpack(row["times"]).astype(np.int64)
    bounds = np.frombuffer(row["bounds"], "<i8")
    sizes = np.frombuffer(row["sizes"], "<i8").reshape(-1, 4)

    def sums(values):
        run = np.concatenate(([0], np.cumsum(values)))
        return run[bounds[1:]] - run[bounds[:-1]]

    digests = [row["digests"][i : i + 32].hex() if n else "" for i, n in zip(range(0, len(row["digests"]), 32), sizes[:, 0].tolist())]
    doc_ids = pa.array(np.frombuffer(row["doc_ids"], "<i8"), mask=np.frombuffer(row["no_id"], np.uint8).astype(bool))
    columns = [*sizes.T, sums(np.where(best[place], times, 0)), sums(total[place] * times)]
    return pa.RecordBatch.from_arrays([doc_ids, *(pa.array(np.ascontiguousarray(c)) for c in columns), pa.array(digests, pa.string())], schema=_OUT_ARROW)


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows: a chunk, then the counts of its pairs in order."""
    row, totals, bests = None, [], []

    def done():
        return _settled(row, np.concatenate([*totals, np.zeros(0, np.int64)]), np.concatenate([*bests, np.zeros(0, bool)]))

    for batch in batches:
        heads = np.flatnonzero(batch.column("at").to_numpy() < 0).tolist()
        for a, b in zip([0, *heads], [*heads, batch.num_rows]):
            part = batch.slice(a, b - a)
            if not part.num_rows:
                continue
            if part.column("at")[0].as_py() < 0:
                if row is not None:
                    yield done()
                row, totals, bests = {f.name: part.column(f.name)[0].as_py() for f in _CHUNK_ARROW if f.name not in ("pairs", "in_docs")}, [], []
                part = part.slice(1)
            totals.append(part.column("total").fill_null(0).to_numpy())
            bests.append(part.column("best").fill_null(False).to_numpy(zero_copy_only=False))
    if row is not None:
        yield done()


def align_documents(docs: DataFrame, tokenizer_a: str | None = None, tokenizer_b: str | None = None, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)
    for each row. The paths name a tokenizers file and a sentencepiece model
    that every executor can read."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/chunks"
    docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_chunks(tokenizer_a, tokenizer_b, chunk_chars), _CHUNK).write.parquet(folder)
    chunks = spark.read.parquet(folder)
    listed = chunks.select("chunk", "pairs", "in_docs").mapInArrow(_listed, "chunk long, at int, pair long, n long")
    counts = listed.groupBy("pair").agg(F.sum("n").alias("total"))
    # At most one row for each B id in a group.
    highest = F.max("total").over(W.partitionBy(F.shiftright("pair", 32)))
    marked = counts.select("pair", "total", (F.col("total") == highest).alias("best"))
    answers = listed.join(marked, "pair").select("chunk", "at", "total", "best")
    payload = [f.name for f in _CHUNK_ARROW if f.name not in ("chunk", "pairs", "in_docs")]
    both = chunks.select("chunk", F.lit(-1).alias("at"), F.lit(None).cast("long").alias("total"), F.lit(None).cast("boolean").alias("best"), *payload).unionByName(
        answers, allowMissingColumns=True
    )
    return both.repartition(shuffle_partitions(spark), "chunk").sortWithinPartitions("chunk", "at").mapInArrow(_settle, _OUT)


_LINKS = "doc_id long, a_ids array<int>, b_ids array<int>, group_ends array<long>, links array<struct<a:int,b:int,bytes:int>>, shared array<struct<a:int,b:int>>"


def linked_tokens(docs: DataFrame, tokenizer_a: str | None = None, tokenizer_b: str | None = None) -> DataFrame:
    """Ids, group ends in bytes, overlap links (token numbers and the bytes
    that both cover) and shared-group links of each whole text."""

    def links(batches):
        own = aligner(tokenizer_a or tokenizer_path(TOKENIZER_A), tokenizer_b or tokenizer_path(TOKENIZER_B))
        schema = pa.schema([
            ("doc_id", pa.int64()), ("a_ids", pa.list_(pa.int32())), ("b_ids", pa.list_(pa.int32())), ("group_ends", pa.list_(pa.int64())),
            ("links", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("bytes", pa.int32())]))),
            ("shared", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))),
        ])
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                a, b = (own.tokens(text) if text else None) or ([], [])
                overlap, shared, cuts = align(*own.ends(a, b))
                rows = zip(overlap.rows().tolist(), overlap.indices.tolist(), overlap.data.tolist())
                pairs = zip(shared.rows().tolist(), shared.indices.tolist())
                yield _batch([(
                    doc_id, a, b, cuts.tolist(), [{"a": i, "b": j, "bytes": n} for i, j, n in rows], [{"a": i, "b": j} for i, j in pairs],
                )], schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(links, _LINKS)


def op12(spark, sf_dir: str) -> DataFrame:
    return align_documents(documents(spark, sf_dir))

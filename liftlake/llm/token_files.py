"""Token files (op 8): ids in shards, compressed by Re-Pair grammars.

Documents are ordered by id over range partitions, tokenized, closed with an
end id and cut into shards of about a million ids. A shard repeats Re-Pair
rounds: its most frequent pairs of neighbouring symbols become nonterminals.
One round replaces many pairs at once, chosen so that no symbol is the left
part of one and the right part of another; their places then never overlap. Of
a run of one symbol every second pair counts. Rounds end when no pair is left
that occurs ``MIN_COUNT`` times. No pair goes over the end of a document, so each
document is a slice of symbols.

File format: a Parquet table in the given folder, one row for each shard:
``part``, ``shard`` (order), ``n_tokens``, ``terminals`` (ids below it stand
for themselves), ``wide`` (symbols take 4 bytes instead of 2), ``rules`` (pairs
of 32-bit symbols; rule i defines nonterminal ``terminals + i``), ``lengths``
(32-bit expansion length of each rule), ``symbols``, ``doc_ids`` (64-bit),
``no_id`` (a byte each, 1 for a null id) and ``doc_symbols`` (32-bit, where
each document ends). Numbers are little-endian. A reader finds a document, or
a place in it, by adding expansion lengths, and expands no more than it needs.

Defined results: null and empty texts are the end id alone; equal rows are
written as often as they occur; null ids come first; rows that share an id are
ordered by text hash; an empty table gives no shards; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import NULL_ID, documents, keyed, shared_folder, shuffle_partitions
from .tokens import text_ids, tokenizer_path

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
SHARD_TOKENS = 1 << 20
PAIRS_A_ROUND = 2048
MIN_COUNT = 24


class Grammar:
    """Symbols of a shard with the rules of its nonterminals. ``lengths`` are
    the expansion lengths of the rules, where a file holds them."""

    def __init__(self, symbols: np.ndarray, rules: np.ndarray, terminals: int, lengths: np.ndarray | None = None) -> None:
        self.symbols, self.rules, self.terminals, self._lengths = symbols, rules, terminals, lengths
        self.expanded = 0  # rules that ``expand`` and ``read`` have spelled out

    def lengths(self) -> np.ndarray:
        """Expansion length of each rule. A rule uses only earlier ones."""
        if self._lengths is None:
            out = [1] * self.terminals
            for a, b in self.rules.tolist():
                out.append(out[a] + out[b])
            self._lengths = np.array(out[self.terminals :], np.int64)
        return self._lengths

    def symbol_lengths(self, symbols: np.ndarray) -> np.ndarray:
        rule = symbols.astype(np.int64) - self.terminals
        out = np.ones(len(symbols), np.int64)
        out[rule >= 0] = self.lengths()[rule[rule >= 0]]
        return out

    def expansions(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first, length): symbol s stands for ids[first[s]:][:length[s]]."""
        length = np.concatenate((np.ones(self.terminals, np.int64), self.lengths()))
        first = np.cumsum(length) - length
        ids = np.empty(int(length.sum()), np.uint32)
        ids[: self.terminals] = np.arange(self.terminals)
        begin, size = first.tolist(), length.tolist()
        for (a, b), at in zip(self.rules.tolist(), begin[self.terminals :]):
            middle = at + size[a]
            ids[at:middle] = ids[begin[a] : begin[a] + size[a]]
            ids[middle : middle + size[b]] = ids[begin[b] : begin[b] + size[b]]
        return ids, first, length

    def expand(self, a: int = 0, b: int | None = None) -> np.ndarray:
        """Ids of the symbols [a, b); only the rules that these need are spelled
        out, each once."""
        symbols = self.symbols[a:b].tolist()
        spelled: dict[int, list[int]] = {}
        todo = [s for s in set(symbols) if s >= self.terminals]
        while todo:
            s = todo[-1]
            if s in spelled:
                todo.pop()
                continue
            pair = self.rules[s - self.terminals].tolist()
            open_ones = [x for x in pair if x >= self.terminals and x not in spelled]
            if open_ones:
                todo += open_ones
                continue
            spelled[s] = [i for x in pair for i in (spelled[x] if x >= self.terminals else (x,))]
            todo.pop()
        self.expanded += len(spelled)
        return np.array([i for s in symbols for i in (spelled[s] if s >= self.terminals else (s,))], np.uint32)

    def read(self, start: int, n: int, a: int = 0, b: int | None = None) -> np.ndarray:
        """``n`` ids from the ``start``-th on of the symbols [a, b): lengths tell
        which symbols hold them."""
        ends = np.cumsum(self.symbol_lengths(self.symbols[a:b]))
        if not len(ends) or n <= 0 or start >= ends[-1]:
            return np.zeros(0, np.uint32)
        first, last = np.searchsorted(ends, [start, min(start + n, int(ends[-1])) - 1], side="right").tolist()
        before = int(ends[first - 1]) if first else 0
        return self.expand(a + first, a + last + 1)[start - before :][:n]


def spell(symbols: np.ndarray, ids: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    n = length[symbols]
    ends = np.cumsum(n)
    return ids[np.repeat(first[symbols] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]


def _twins(equal: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Every second one of a run of the places ``equal``, in ascending order,
    that hold the same symbol as the place after them."""
    if not len(equal):
        return equal
    begins = np.concatenate(([True], after[equal[:-1]] != equal[1:]))
    offset = np.arange(len(equal)) - np.flatnonzero(begins)[np.cumsum(begins) - 1]
    return equal[offset % 2 == 0]


def _often(left: np.ndarray, right: np.ndarray, at: np.ndarray, least: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, counts, places) of the pairs that occur ``least`` times: keys ascend,
    with the left symbol in the upper half, and the places, out of ``at``, go by
    key. Symbols and places are below ``high``."""
    place_bits, none = int(at.max(initial=0)).bit_length(), np.zeros(0, np.int64)
    symbol_bits = high.bit_length()
    if not len(at):
        return none.astype(np.uint64), none, none
    if 2 * symbol_bits + place_bits <= 64:
        # Key and place in one number sort faster than an index.
        key = left.astype(np.uint64)
        for bits, part in ((symbol_bits, right), (place_bits, at)):
            key <<= np.uint64(bits)
            np.bitwise_or(key, part, out=key, dtype=np.uint64, casting="unsafe")
        key.sort()
        at = (key & np.uint64((1 << place_bits) - 1)).astype(np.intp)
        key >>= np.uint64(place_bits)
    else:
        symbol_bits = 32
        key = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        order = np.argsort(key, kind="stable")
        key, at = key[order], at[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    count = np.diff(first, append=len(key))
    often = count >= least
    key = key[first[often]]
    key = key >> np.uint64(symbol_bits) << np.uint64(32) | key & np.uint64((1 << symbol_bits) - 1)
    return key, count[often], at[np.repeat(often, count)]


def _often_of_all(left: np.ndarray, right: np.ndarray, inner: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``_often`` for all places of few inner symbols, by a table of all their
    pairs; the third array has the number of each place's pair, 0 for none."""
    symbol, rank = np.flatnonzero(inner), np.cumsum(inner) * inner
    wide = len(symbol) + 1
    number = rank[left] * wide + rank[right]
    count = np.bincount(number, minlength=wide * wide).reshape(wide, wide)
    count[0], count[:, 0] = 0, 0
    np.fill_diagonal(count, 0)
    found = np.flatnonzero(count.ravel() >= least)
    table = np.zeros(wide * wide, np.int32)
    table[found] = np.arange(1, len(found) + 1)
    key = symbol[found // wide - 1].astype(np.uint64) << np.uint64(32) | symbol[found % wide - 1].astype(np.uint64)
    return key, count.ravel()[found], table[number]


def re_pair(ids: np.ndarray, end_id: int, pairs: int = PAIRS_A_ROUND, min_count: int = MIN_COUNT) -> Grammar:
    """Pairs are counted once; a round then takes away the pairs beside its
    replaced places and counts those that it makes. A pair occurs most when its
    later symbol is made and only loses places afterwards, so pairs below the
    least count are never looked at again. Pairs of equal symbols change with
    the runs around them and are counted in each round.

    Places know the places before and after them, so a round touches those it
    replaces and their neighbours, and looks only at places of pairs that still
    occur often."""
    n, terminals = len(ids), int(ids.max()) + 1 if len(ids) else 1
    # Each pair replaced takes away min_count places or more.
    high = terminals + n // max(min_count, 1) + 1
    # Place n lies before the first and after the last one; its symbol, like that
    # of a place taken away, is -1 and never inner.
    symbols = np.append(ids.astype(np.int32), np.int32(-1))
    after, before = np.arange(1, n + 2), np.arange(-1, n)
    after[n], before[0] = n, n
    # A pair occurs no more often than its symbols; none goes over an end.
    inner = np.append(np.bincount(ids, minlength=terminals) >= min_count, False)
    if end_id < terminals:
        inner[end_id] = False

    # Pair 0 is none; pair_at tells the pair that starts at a place.
    keys, counts, pair_at = np.zeros(1, np.uint64), np.zeros(1, np.int64), np.zeros(n + 1, np.int32)
    live = equal = np.zeros(0, np.intp)
    left, right = symbols[:-1], symbols[1:]
    if (int(inner.sum()) + 1) ** 2 <= 4 * n:
        new_keys, new_counts, pair_at[:n] = _often_of_all(left, right, inner, max(min_count, 1))
        keys, counts = np.concatenate((keys, new_keys)), np.concatenate((counts, new_counts))
        live, equal = np.flatnonzero(pair_at), np.flatnonzero((left == right) & inner[left])
        at = live[:0]
    else:
        at = np.arange(n)
    rules = []
    while True:
        # Pairs that the round before has made, or all.
        if len(at):
            ok, same = inner[left] & inner[right], left == right
            equal = np.sort(np.concatenate((equal, at[ok & same])))
            wanted = np.flatnonzero(ok & ~same)
            new_keys, new_counts, at = _often(left[wanted], right[wanted], at[wanted], min_count, high)
            pair_at[at] = np.repeat(np.arange(len(keys), len(keys) + len(new_keys), dtype=np.int32), new_counts)
            keys, counts = np.concatenate((keys, new_keys)), np.concatenate((counts, new_counts))
            live = np.concatenate((live, np.sort(at)))
        twins = _twins(equal, after)
        twin_ids, twin_counts = np.unique(symbols[twins].astype(np.uint64), return_counts=True)
        often, twins_often = np.flatnonzero(counts >= max(min_count, 1)), twin_counts >= min_count
        twin_ids, twin_counts = twin_ids[twins_often], twin_counts[twins_often]
        all_keys = np.concatenate((keys[often], twin_ids << np.uint64(32) | twin_ids))
        all_counts = np.concatenate((counts[often], twin_counts))
        best = np.lexsort((all_keys, -all_counts))[: 4 * pairs]
        lefts, rights, chosen = set(), set(), []
        for i, k in zip(best.tolist(), all_keys[best].tolist()):
            a, b = k >> 32, k & 0xFFFFFFFF
            if a not in rights and b not in lefts:
                lefts.add(a)
                rights.add(b)
                chosen.append(i)
                if len(chosen) == pairs:
                    break
        if not chosen:
            break
        base, chosen = terminals + len(rules), np.array(chosen)
        rules.extend((k >> 32, k & 0xFFFFFFFF) for k in all_keys[chosen].tolist())
        # Places to replace: those of the chosen pairs, and the twins chosen.
        made = np.arange(base, base + len(chosen), dtype=np.int32)
        is_twin = chosen >= len(often)
        by_pair, by_twin = np.zeros(len(keys), np.int32), np.zeros(base, np.int32)
        by_pair[often[chosen[~is_twin]]] = made[~is_twin]
        by_twin[twin_ids[chosen[is_twin] - len(often)].astype(np.intp)] = made[is_twin]
        place = np.concatenate((live, twins))
        made = np.concatenate((by_pair[pair_at[live]], by_twin[symbols[twins]]))
        hit = np.flatnonzero(made)
        place, made = place[hit], made[hit]
        # Pairs lost: at the places, at those taken away and at those before.
        taken = after[place]
        symbols[taken] = -1
        ahead = before[place]
        lost = np.concatenate((place, taken, ahead[symbols[ahead] >= 0]))
        counts -= np.bincount(pair_at[lost], minlength=len(counts))
        pair_at[lost], counts[0] = 0, 0
        live = live[counts[pair_at[live]] >= max(min_count, 1)]
        symbols[place] = made
        after[place] = after[taken]
        before[after[place]] = place
        inner = np.concatenate((inner[:-1], np.ones(len(rules) + terminals - base, bool), [False]))
        equal = equal[(symbols[equal] < base) & (symbols[equal] >= 0) & (symbols[equal] == symbols[after[equal]])]
        ahead = before[place]
        at = np.concatenate((place, ahead[symbols[ahead] < base]))
        left, right = symbols[at], symbols[after[at]]
    symbols = symbols[:n]
    return Grammar(symbols[symbols >= 0].astype(np.uint32), np.array(rules, np.uint32).reshape(-1, 2), terminals)


_SHARD = (
    "part int, shard int, n_tokens long, terminals int, wide boolean, rules binary, lengths binary, symbols binary,"
    " doc_ids binary, no_id binary, doc_symbols binary"
)
_SHARD_ARROW = pa.schema([
    ("part", pa.int32()), ("shard", pa.int32()), ("n_tokens", pa.int64()), ("terminals", pa.int32()), ("wide", pa.bool_()),
    ("rules", pa.binary()), ("lengths", pa.binary()), ("symbols", pa.binary()), ("doc_ids", pa.binary()), ("no_id", pa.binary()),
    ("doc_symbols", pa.binary()),
])


def _write(path: str | None, end_id: int, shard_tokens: int):
    end = end_id.to_bytes(4, "little")

    def shard_row(part: int, shard: int, dids: list[int], texts: list[bytes]) -> pa.RecordBatch:
        ids = np.frombuffer(b"".join(texts), "<u4")
        grammar = re_pair(ids, end_id)
        wide = grammar.terminals + len(grammar.rules) > 1 << 16
        # Document ends: an end id may also come from a text, so count ids.
        length = np.concatenate((np.ones(grammar.terminals, np.int64), grammar.lengths()))
        reached = np.cumsum(length[grammar.symbols])
        ends = np.searchsorted(reached, np.cumsum([len(t) // 4 for t in texts])) + 1
        doc_ids = np.array(dids, "<i8")
        row = (
            part, shard, len(ids), grammar.terminals, wide, grammar.rules.astype("<u4").tobytes(), grammar.lengths().astype("<u4").tobytes(),
            grammar.symbols.astype("<u4" if wide else "<u2").tobytes(), doc_ids.tobytes(), (doc_ids == NULL_ID).astype(np.uint8).tobytes(),
            ends.astype("<u4").tobytes(),
        )
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _SHARD_ARROW)], schema=_SHARD_ARROW)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, shard = text_ids(path or tokenizer_path(TOKENIZER)), TaskContext.get().partitionId(), 0
        dids, texts, size = [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rows = batch.slice(at, 500)
                for did, text in zip(rows.column("did").to_pylist(), rows.column("text").to_pylist()):
                    dids.append(did)
                    texts.append(encode(text) + end)
                    size += len(texts[-1]) // 4
                    if size >= shard_tokens:
                        yield shard_row(part, shard, dids, texts)
                        dids, texts, size, shard = [], [], 0, shard + 1
        if texts:
            yield shard_row(part, shard, dids, texts)

    return write


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS
) -> str:
    """Writes the shards of all documents in ascending id order to ``folder``,
    which executors must share, and returns it. ``tokenizer`` is the path of a
    tokenizers file that every executor can read."""
    ordered = (
        keyed(docs).select("did", "th", "text")
        .repartitionByRange(shuffle_partitions(docs.sparkSession), "did", "th")
        .sortWithinPartitions("did", "th")
    )
    ordered.mapInArrow(_write(tokenizer, end_id, shard_tokens), _SHARD).write.parquet(folder)
    return folder


def read_grammar(row: dict) -> Grammar:
    symbols = np.frombuffer(row["symbols"], "<u4" if row["wide"] else "<u2")
    lengths = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
    return Grammar(symbols, np.frombuffer(row["rules"], "<u4").reshape(-1, 2), row["terminals"], lengths)


def read_document(row: dict, i: int, start: int = 0, n: int | None = None) -> np.ndarray:
    """Ids of the i-th document of a shard, all or ``n`` from ``start`` on. What
    lies outside is not expanded."""
    ends, grammar = np.frombuffer(row["doc_symbols"], "<u4"), read_grammar(row)
    a, b = int(ends[i - 1]) if i else 0, int(ends[i])
    if start == 0 and n is None:
        return grammar.expand(a, b)
    return grammar.read(start, row["n_tokens"] if n is None else n, a, b)


def _read(with_ids: bool):
    schema = pa.schema([
        ("part", pa.int32()), ("shard", pa.int32()), ("doc_id", pa.int64()), ("within", pa.int64()), ("n_tokens", pa.int64()),
        ("ids_crc32", pa.int64()), ("ids", pa.binary()),
    ])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {f.name: batch.column(j)[i].as_py() for j, f in enumerate(batch.schema)}
                grammar = read_grammar(row)
                pool, first, length = grammar.expansions()
                data = spell(grammar.symbols, pool, first, length).astype("<u4").tobytes()
                symbol_ends = np.frombuffer(row["doc_symbols"], "<u4").astype(np.int64)
                ends = np.cumsum(length[grammar.symbols])[symbol_ends - 1]
                starts = np.concatenate(([0], ends[:-1]))
                parts = [data[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist())]
                n = len(parts)
                doc_ids = pa.array(np.frombuffer(row["doc_ids"], "<i8"), mask=np.frombuffer(row["no_id"], np.uint8).astype(bool))
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["part"]] * n, pa.int32()), pa.array([row["shard"]] * n, pa.int32()), doc_ids, pa.array(starts), pa.array(ends - starts),
                    pa.array([zlib.crc32(p) for p in parts], pa.int64()), pa.array(parts if with_ids else [None] * n, pa.binary()),
                ], schema=schema)

    return read


def read_token_files(spark, folder: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the files, with
    ``ids`` (packed 32-bit) if asked for."""
    files = spark.read.parquet(folder)
    rows = files.mapInArrow(_read(with_ids), "part int, shard int, doc_id long, within long, n_tokens long, ids_crc32 long, ids binary")
    # Where each shard starts: parts first (one row each), then its own part.
    sizes = files.select("part", "shard", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    part_start = parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("part_start"))
    in_part = F.sum("n_tokens").over(W.partitionBy("part").orderBy("shard")) - F.col("n_tokens")
    starts = sizes.select("part", "shard", in_part.alias("in_part")).join(part_start, "part").select("part", "shard", (F.col("in_part") + F.col("part_start")).alias("base"))
    return rows.join(starts, ["part", "shard"]).select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def op8(spark, sf_dir: str) -> DataFrame:
    folder = write_token_files(documents(spark, sf_dir), f"{shared_folder(spark)}/tokens")
    return read_token_files(spark, folder)

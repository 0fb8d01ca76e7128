"""N-gram Jaccard join (op 5) over tries of globally ordered shingle sets.

Documents whose sets of 5-word shingles overlap by 75 % or more are linked; the
result gives each document's component. The join is exact.

1. Equal sets form a class; from here on a class stands for its documents.
2. Shingles are ordered by the number of classes that hold them, rare first,
   then by hash. Task by task, the shingles of all classes meet in packed blocks
   by hash bucket; only those in two classes or more come back.
3. A shingle that no other class holds cannot be in an intersection, so a class
   can only have a partner if at least 75 % of its set came back. The others,
   nearly all documents of a corpus, are done here.
4. Two linked classes share a shingle among the first ``n - ceil(0.75 n) + 1``
   of each. Each such prefix shingle ties its classes to the smallest of them
   (a star, never all pairs), and the components of those ties are the groups
   within which all links lie.
5. In each group the ordered sets go into a trie. A probe walks it sharing the
   overlap of common paths and leaves a subtree when the shingles that remain
   there and in the probe cannot reach the bound, when its set sizes are out of
   range, or when all its sets are in the probe's component already. Groups of
   more than ``block`` classes are joined as pairs of blocks, each one task.
6. The links found (a spanning forest of each group) are closed to components.

Defined results: null or empty texts, and texts without words, have an empty
set and form a component of their own; equal rows are one document stated
twice; rows that share an id or have none, but differ in text, are documents of
their own and meet only by links; a null id orders first and a component with
one in it has a null id; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, connected_components, documents, keyed, shuffle_partitions, stored, text_chunks
from .hashing import gram_hashes, span_hashes, words

SHINGLE_WORDS = 5
PERCENT = 75
# Classes that one task joins at once.
BLOCK = 4096
_KEY = 16  # bytes of a class key: 12 of a digest, 4 of the set size


def shingle_sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct shingle hashes of each text) by chunk."""
    for row, raw, bounds in text_chunks(batch.column("text")):
        hashes, at = words(raw, bounds, fold_case=True)
        grams = gram_hashes(hashes, k)
        sets = []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            if b - a >= k:
                sets.append(np.unique(grams[a : b - k + 1]))
            elif b > a:
                sets.append(span_hashes(hashes[a:b], np.array([0]), np.array([b - a])))
            else:
                sets.append(grams[:0])
        yield row, sets


def class_key(shingles: np.ndarray) -> bytes | None:
    if not len(shingles):
        return None
    return hashlib.blake2b(shingles.tobytes(), digest_size=12).digest() + len(shingles).to_bytes(4, "little")


def _signatures(k: int):
    schema = pa.schema([("did", pa.int64()), ("th", pa.int64()), ("n_shingles", pa.int64()), ("key", pa.binary())])

    def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys = [], []
            for _, sets in shingle_sets(batch, k):
                sizes.extend(map(len, sets))
                keys.extend(map(class_key, sets))
            yield pa.RecordBatch.from_arrays(
                [batch.column("did"), batch.column("th"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary())], schema=schema
            )

    return signatures


_BLOCK = "bucket int, keys binary, counts binary, hashes binary"
_BLOCK_ARROW = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("hashes", pa.binary())])


def _as_blocks(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _deal(k: int, buckets: int):
    """Shingles of the distinct classes of each chunk, packed by hash bucket."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, sets in shingle_sets(batch, k):
                classes = {class_key(s): s for s in sets if len(s)}
                if not classes:
                    continue
                keys = list(classes)
                every = np.concatenate(list(classes.values()))
                owner = np.repeat(np.arange(len(keys)), [len(s) for s in classes.values()])
                bucket = (((every >> np.uint64(48)) * np.uint64(buckets)) >> np.uint64(16)).astype(np.uint16)
                order = np.argsort(bucket, kind="stable")
                every, owner = every[order], owner[order]
                edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
                rows = []
                for b in np.flatnonzero(np.diff(edges)).tolist():
                    own = owner[edges[b] : edges[b + 1]]
                    heads = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
                    counts = np.diff(np.append(heads, len(own))).astype("<u4")
                    six = every[edges[b] : edges[b + 1]].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
                    rows.append((b, b"".join([keys[i] for i in own[heads].tolist()]), counts.tobytes(), np.ascontiguousarray(six).tobytes()))
                yield _as_blocks(_BLOCK_ARROW, rows)

    return deal


_COMMON = "home int, keys binary, counts binary, tokens binary, held binary"
_COMMON_ARROW = pa.schema([("home", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("tokens", pa.binary()), ("held", pa.binary())])


def _count(homes: int):
    """Of each bucket, the shingles that two classes or more hold, with that
    number, packed by class bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, list] = {}
        for batch in batches:
            for bucket, keys, counts, hashes in zip(*(c.to_pylist() for c in batch.columns)):
                blocks.setdefault(bucket, []).append((keys, counts, hashes))
        while blocks:
            bucket, parts = blocks.popitem()
            low = np.zeros((sum(len(p[2]) for p in parts) // 6, 8), np.uint8)
            low[:, :6] = np.frombuffer(b"".join(p[2] for p in parts), np.uint8).reshape(-1, 6)
            token = low.view("<u8").ravel()
            keys = np.frombuffer(b"".join(p[0] for p in parts), f"V{_KEY}")
            entry = np.repeat(np.arange(len(keys)), np.frombuffer(b"".join(p[1] for p in parts), "<u4"))
            order = np.argsort(token)
            token, entry = token[order], entry[order]
            same = token[1:] == token[:-1]
            more = np.concatenate(([False], same)) | np.concatenate((same, [False])) if len(token) else same
            token, entry = token[more], entry[more]
            if not len(token):
                continue
            # The same class may have come from several tasks.
            owner = _numbered(keys)[entry]
            order = np.lexsort((owner, token))
            token, owner, entry = token[order], owner[order], entry[order]
            fresh = np.concatenate(([True], (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])))
            token, owner, entry = token[fresh], owner[fresh], entry[fresh]
            heads = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
            held = np.diff(np.append(heads, len(token)))
            held = np.repeat(held, held)
            common = held > 1
            token, entry, held = token[common], entry[common], held[common]
            if not len(token):
                continue
            token = token | (np.uint64(bucket) << np.uint64(48))
            # The first two key bytes are as good as random.
            home = (keys[entry].view("u1").reshape(-1, _KEY)[:, :4].copy().view("<u4").ravel() % np.uint32(homes)).astype(np.int64)
            order = np.lexsort((entry, home))
            token, entry, held, home = token[order], entry[order], np.minimum(held[order], 65535).astype("<u2"), home[order]
            edges = np.searchsorted(home, np.arange(homes + 1))
            rows = []
            for b in np.flatnonzero(np.diff(edges)).tolist():
                s = slice(edges[b], edges[b + 1])
                own = entry[s]
                heads = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
                counts = np.diff(np.append(heads, len(own))).astype("<u4")
                rows.append((b, keys[own[heads]].tobytes(), counts.tobytes(), token[s].astype("<u8").tobytes(), held[s].tobytes()))
            yield _as_blocks(_COMMON_ARROW, rows)

    return count


def _numbered(keys: np.ndarray) -> np.ndarray:
    """Distinct numbers for distinct class keys."""
    parts = keys.view("u1").reshape(-1, _KEY).copy().view("<u8").reshape(-1, 2)
    order = np.lexsort((parts[:, 1], parts[:, 0]))
    p = parts[order]
    fresh = np.concatenate(([False], (p[1:] != p[:-1]).any(axis=1)))
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(fresh)
    return number


def needed(n: int, percent: int = PERCENT) -> int:
    """Shingles of a set of n that any partner must share."""
    return -(-percent * n // 100)


_CLASS = "key binary, size int, tokens binary, held binary, prefix int"
_CLASS_ARROW = pa.schema([("key", pa.binary()), ("size", pa.int32()), ("tokens", pa.binary()), ("held", pa.binary()), ("prefix", pa.int32())])


def _assemble(percent: int):
    """Classes with enough common shingles: those, in global order, and how
    many of them belong to the prefix."""

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, list] = {}
        for batch in batches:
            for keys, counts, tokens, held in zip(*(c.to_pylist() for c in batch.columns[1:])):
                at = 0
                for i, c in enumerate(np.frombuffer(counts, "<u4").tolist()):
                    found.setdefault(keys[i * _KEY : (i + 1) * _KEY], []).append((tokens[8 * at : 8 * (at + c)], held[2 * at : 2 * (at + c)]))
                    at += c
        rows = []
        for key, parts in found.items():
            n = int.from_bytes(key[12:], "little")
            tokens = np.frombuffer(b"".join(p[0] for p in parts), "<u8")
            if len(tokens) < needed(n, percent):
                continue
            held = np.frombuffer(b"".join(p[1] for p in parts), "<u2")
            order = np.lexsort((tokens, held))
            rows.append((key, n, tokens[order].tobytes(), held[order].tobytes(), n - needed(n, percent) + 1 - (n - len(tokens))))
            if len(rows) == 2000:
                yield _as_blocks(_CLASS_ARROW, rows)
                rows = []
        if rows:
            yield _as_blocks(_CLASS_ARROW, rows)

    return assemble


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("token", pa.int64()), ("lead", pa.int64())])
    for batch in batches:
        tokens = [np.frombuffer(t, "<i8")[:p] for t, p in zip(batch.column("tokens").to_pylist(), batch.column("prefix").to_pylist())]
        if tokens:
            rows = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), batch.column("lead").take(pa.array(rows))], schema=schema)


class _Node:
    __slots__ = ("label", "children", "leaves", "low", "high", "deep", "one")

    def __init__(self, label: np.ndarray) -> None:
        self.label = label  # the tokens on the way from the parent
        self.children: dict[int, _Node] = {}  # by first token of their label
        self.leaves: list[int] = []  # sets that end here
        self.low, self.high = 1 << 60, 0  # set sizes below, unique shingles included
        self.deep = 0  # most tokens below this node
        self.one = -1  # a set below if all are in one component, else -1


class PrefixTree:
    """A trie of ordered token sets that joins each set with those before it
    and keeps the components of the links found."""

    def __init__(self, percent: int = PERCENT) -> None:
        self.percent, self.root = percent, _Node(np.zeros(0, np.int64))
        self.parent: list[int] = []
        self.sizes: list[int] = []

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def add(self, tokens: np.ndarray, size: int, mark: np.ndarray) -> int:
        """Joins and inserts a set of ``size`` shingles with these common ones
        (ascending). ``mark`` is a zeroed array over all tokens."""
        me = len(self.parent)
        self.parent.append(me)
        self.sizes.append(size)
        mark[tokens] = 1
        self._probe(me, tokens, size, mark)
        mark[tokens] = 0
        self._insert(me, tokens, size)
        return me

    def _probe(self, me: int, tokens: np.ndarray, size: int, mark: np.ndarray) -> None:
        percent, find = self.percent, self.find
        stack = [(self.root, 0)]
        while stack:
            node, overlap = stack.pop()
            if node.high * 100 < percent * size or percent * node.low > 100 * size:
                continue
            if node.one >= 0 and find(node.one) == find(me):
                continue
            if len(node.label):
                overlap += int(np.count_nonzero(mark[node.label]))
                after = len(tokens) - int(np.searchsorted(tokens, node.label[-1], side="right"))
            else:
                after = len(tokens)
            # At best all that remains on both sides is shared.
            best = overlap + min(after, node.deep)
            least = max(node.low, needed(size, percent))
            if (100 + percent) * best < percent * (size + least):
                continue
            for leaf in node.leaves:
                # overlap / (size + other - overlap) >= percent / 100
                if 100 * overlap >= percent * (size + self.sizes[leaf] - overlap):
                    a, b = find(me), find(leaf)
                    if a != b:
                        self.parent[max(a, b)] = min(a, b)
            stack.extend((child, overlap) for child in node.children.values())

    def _insert(self, me: int, tokens: np.ndarray, size: int) -> None:
        node, at = self.root, 0
        while True:
            if node.one == -1:
                node.one = me if node.high == 0 else -2
            elif node.one >= 0 and self.find(node.one) != self.find(me):
                node.one = -2
            node.low, node.high = min(node.low, size), max(node.high, size)
            rest = len(tokens) - at
            node.deep = max(node.deep, rest)
            if not rest:
                node.leaves.append(me)
                return
            child = node.children.get(int(tokens[at]))
            if child is None:
                leaf = _Node(tokens[at:])
                leaf.low = leaf.high = size
                leaf.one, leaf.leaves = me, [me]
                node.children[int(tokens[at])] = leaf
                return
            m = min(len(child.label), rest)
            differ = np.flatnonzero(child.label[:m] != tokens[at : at + m])
            same = int(differ[0]) if len(differ) else m
            if same < len(child.label):
                upper = _Node(child.label[:same])
                child.label = child.label[same:]
                upper.children[int(child.label[0])] = child
                upper.low, upper.high, upper.one = child.low, child.high, child.one
                upper.deep = child.deep + len(child.label)
                node.children[int(upper.label[0])] = upper
                child = upper
            node, at = child, at + same


def join_group(
    leads: list[int], sizes: list[int], sets: list[np.ndarray], held: list[np.ndarray], percent: int = PERCENT
) -> list[tuple[int, int]]:
    """Links of a group as a star around each component's smallest class.
    ``held`` gives each token's place in the global order, rare first."""
    if len(leads) < 2:
        return []
    distinct, at, flat = np.unique(np.concatenate(sets), return_index=True, return_inverse=True)
    rank = np.empty(len(distinct), np.int64)
    rank[np.lexsort((distinct, np.concatenate(held)[at]))] = np.arange(len(distinct))
    bounds = np.cumsum([0, *map(len, sets)])
    mark = np.zeros(len(distinct), np.uint8)
    tree = PrefixTree(percent)
    by_size = sorted(range(len(leads)), key=lambda i: (sizes[i], leads[i]))
    for i in by_size:
        tree.add(np.sort(rank[flat[bounds[i] : bounds[i + 1]]]), sizes[i], mark)
    members: dict[int, list[int]] = {}
    for place, i in enumerate(by_size):
        members.setdefault(tree.find(place), []).append(leads[i])
    out = []
    for found in members.values():
        first = min(found)
        out.extend((lead, first) for lead in found if lead != first)
    return out


def _join(percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, group, links = None, ([], [], [], []), []
        for batch in batches:
            for *task, lead, size, tokens, held in zip(*(batch.column(c).to_pylist() for c in ("comp", "i", "j", "lead", "size", "tokens", "held"))):
                if task != current:
                    links.extend(join_group(*group, percent))
                    current, group = task, ([], [], [], [])
                for column, value in zip(group, (lead, size, np.frombuffer(tokens, "<u8"), np.frombuffer(held, "<u2"))):
                    column.append(value)
            if len(links) > 20_000:
                yield _as_blocks(schema, links)
                links = []
        links.extend(join_group(*group, percent))
        if links:
            yield _as_blocks(schema, links)

    return join


def class_links(docs: DataFrame, leads: DataFrame, k: int = SHINGLE_WORDS, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """(a, b): links between classes, enough to connect every component.
    ``docs`` comes from ``common.keyed``; ``leads`` has (key, lead), a number
    for each class."""
    parts = shuffle_partitions(docs.sparkSession)
    buckets = min(parts, 1 << 16)
    dealt = docs.select("text").mapInArrow(_deal(k, buckets), _BLOCK).repartitionById(buckets, "bucket")
    common = dealt.mapInArrow(_count(parts), _COMMON).repartitionById(parts, "home")
    classes = stored(common.mapInArrow(_assemble(percent), _CLASS).join(leads, "key").drop("key"))
    # Ties of prefix shingles: each class to the smallest with that shingle.
    posts = classes.select("lead", "tokens", "prefix").where("prefix > 0").mapInArrow(_prefixes, "token long, lead long")
    least = posts.groupBy("token").agg(F.min("lead").alias("m"), F.max("lead").alias("z")).where("m <> z").select("token", "m")
    ties = posts.join(least, "token").where("lead <> m").select(F.col("lead").alias("a"), F.col("m").alias("b")).distinct()
    roots = connected_components(ties)
    roots = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    sizes = roots.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    # Groups of one block are one task; of others every pair of blocks is one.
    members = (
        roots.join(sizes, "root")
        .withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .select(F.col("node").alias("lead"), F.col("root").alias("comp"), F.explode(
            F.when(F.col("blocks") == 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(
                F.transform(
                    F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: x != F.col("mine")),
                    lambda x: F.struct(F.least(x, F.col("mine")).alias("i"), F.greatest(x, F.col("mine")).alias("j")),
                )
            )
        ).alias("task"))
    )
    tasks = (
        members.join(classes.drop("prefix"), "lead")
        .select("comp", "task.i", "task.j", "lead", "size", "tokens", "held")
        .repartition(parts, "comp", "i", "j")
        .sortWithinPartitions("comp", "i", "j", "lead")
    )
    return tasks.mapInArrow(_join(percent), "a long, b long")


def components(docs: DataFrame, k: int = SHINGLE_WORDS, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """(did, th, n_shingles, root, component): the number of the class that
    stands for each document's component, null for an empty set, and the smallest
    ``did`` that the document reaches by links. ``docs`` comes from
    ``common.keyed``."""
    signed = stored(docs.select("did", "th", "text").mapInArrow(_signatures(k), "did long, th long, n_shingles long, key binary"))
    # Ids may be missing or shared, so classes get numbers; stored ones stay.
    classes = signed.where("key is not null").groupBy("key").agg(F.min("did").alias("did"))
    leads = stored(classes.withColumn("lead", F.monotonically_increasing_id()))
    roots = connected_components(class_links(docs, leads.select("key", "lead"), k, percent, block)).withColumnRenamed("node", "lead")
    linked = roots.unionByName(roots.select(F.col("root").alias("lead"), "root").distinct())
    least = linked.join(leads, "lead").groupBy("root").agg(F.min("did").alias("least"))
    label = leads.join(linked.join(least, "root"), "lead", "left").select(
        "key", F.coalesce("root", "lead").alias("root"), F.coalesce("least", "did").alias("component")
    )
    return signed.join(label, "key", "left").select("did", "th", "n_shingles", "root", F.coalesce("component", "did").alias("component"))


def jaccard_components(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each document."""
    public = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return components(keyed(docs), **options).select(public("did").alias("doc_id"), "n_shingles", public("component").alias("component_id"))


def one_of_each_component(docs: DataFrame, **options) -> DataFrame:
    """The documents with one of each component left: the smallest id, of
    equal ids the smallest text hash. Columns stay as they are."""
    found = components(keyed(docs), **options)
    # Documents with an empty set are components of their own.
    own = [F.when(F.col("root").isNull(), F.col(c)).alias(f"own_{c}") for c in ("did", "th")]
    chosen = found.groupBy("root", *own).agg(F.min(F.struct("did", "th")).alias("k")).select("k.did", "k.th")
    rows = keyed(docs, F.struct(*docs.columns).alias("row"))
    kept = rows.join(chosen, ["did", "th"], "left_semi").select("did", "th", "row").dropDuplicates(["did", "th"])
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op5(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))


ORACLE = r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS ws
  FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, md5_number(array_to_string(ws[i:i + 4], ' ')) AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (
  SELECT x, y FROM o JOIN n nx ON x = nx.doc_id JOIN n ny ON y = ny.doc_id WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
linked AS MATERIALIZED (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
reach(x, y) AS (
  SELECT doc_id, doc_id FROM w
  UNION
  SELECT reach.x, linked.y FROM reach JOIN linked ON reach.y = linked.x)
SELECT w.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, CAST(min(reach.y) AS BIGINT) AS component_id
FROM w JOIN reach ON w.doc_id = reach.x LEFT JOIN n ON n.doc_id = w.doc_id GROUP BY w.doc_id
"""

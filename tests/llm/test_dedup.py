import hashlib
import random

import numpy as np
import pytest

from liftlake.llm import substring_dedup, suffix_dedup, trie_join
from liftlake.llm.hashing import window_minima

from . import brute
from .conftest import prose


def test_substring_dedup_equals_brute_force(odd_docs, odd_rows, no_docs):
    want = brute.substring_dedup([(d, t) for d, t, _ in odd_rows])
    texts = {}
    for d, t, _ in odd_rows:
        texts.setdefault(d, []).append(t or "")
    got = substring_dedup.remove_repeated_words(odd_docs).collect()
    assert len(got) == len(odd_rows)
    for r in got:
        options = [want[brute.order_key(r.doc_id), t] for t in texts[r.doc_id]]
        assert (r.n_words, r.n_removed, r.kept_text) in options
        assert r.kept_sha256 == hashlib.sha256(r.kept_text.encode()).hexdigest()
    assert sum(r.n_removed for r in got) > 300
    assert substring_dedup.remove_repeated_words(no_docs).count() == 0


def test_reference_block_factors_are_greedy_and_whole():
    block = substring_dedup.ReferenceBlock()
    assert list(block.factors([b"a", b"b"])) == []
    block.add([b"a", b"b", b"c"])
    block.add([b"c", b"d"])
    # The factor a b c ends at d, which is looked up by itself.
    assert list(block.factors([b"x", b"a", b"b", b"c", b"d", b"y"])) == [(1, 4)] or list(
        block.factors([b"x", b"a", b"b", b"c", b"d", b"y"])
    ) == [(1, 3), (4, 1)]


@pytest.mark.parametrize("batch_strings", [64, 1 << 17])
def test_suffix_dedup_equals_brute_force(odd_docs, odd_rows, no_docs, batch_strings):
    want = brute.byte_dedup([(d, t) for d, t, _ in odd_rows])
    texts = {}
    for d, t, _ in odd_rows:
        texts.setdefault(d, []).append(t or "")
    got = suffix_dedup.removal_figures(odd_docs, batch_strings=batch_strings).collect()
    assert len(got) == len(odd_rows)
    for r in got:
        options = [want[brute.order_key(r.doc_id), t] for t in texts[r.doc_id]]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) in [(a, b, c, hashlib.sha256(k).hexdigest()) for a, b, c, k in options]
    assert suffix_dedup.removal_figures(no_docs).count() == 0


def test_cut_texts_keep_their_other_columns(odd_docs, odd_rows):
    cut = suffix_dedup.remove_repeated_bytes(odd_docs)
    assert cut.columns == odd_docs.columns
    assert cut.count() == len(odd_rows)
    assert {(r.th, r["size"], r.key, r["range"]) for r in cut.collect()} == {("th", 2, "k", 3)}
    assert cut.where("text is null").count() == odd_docs.where("text is null").count()


def test_index_family_finds_every_earlier_string():
    rng = np.random.default_rng(3)
    family, earlier = suffix_dedup.IndexFamily(width=6), set()
    for _ in range(40):
        text = rng.integers(0, 2, rng.integers(6, 60)).astype(np.uint8)  # zero bytes included
        places = np.arange(len(text) - 5)
        hit = family.scan(text, places, keep=True)
        for p in places:
            s = text[p : p + 6].tobytes()
            assert hit[p] == (s in earlier)
            earlier.add(s)
        assert len(family.levels) <= 8
    assert sum(len(x.order) for x in family.levels) == len(earlier)


def test_window_minima():
    keys = np.random.default_rng(1).integers(0, 100, 200).astype(np.uint64)
    for width in (1, 2, 3, 7, 15, 77, 200):
        assert window_minima(keys, width).tolist() == [min(keys[i : i + width]) for i in range(200 - width + 1)]
    assert len(window_minima(keys, 201)) == 0


@pytest.mark.parametrize("block", [2, 4096])
def test_jaccard_components_equal_brute_force(odd_docs, odd_rows, block):
    # One text for each id here: rows that share an id but not a text merge.
    docs = odd_docs.where("doc_id is not null and not (doc_id = 7 and text like 'another%')")
    want = brute.components({d: brute.shingles(t) for d, t, _ in odd_rows if d is not None and not (t or "").startswith("another")})
    sizes = {d: len(brute.shingles(t)) for d, t, _ in odd_rows if not (t or "").startswith("another")}
    got = trie_join.jaccard_components(docs, block=block).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.n_shingles == sizes[r.doc_id] for r in got)
    assert len({v for v in want.values()}) < len(want) - 8


def test_jaccard_edges(odd_docs, odd_rows, no_docs):
    assert trie_join.jaccard_components(no_docs).count() == 0
    one = trie_join.one_of_each_component(odd_docs)
    assert one.columns == odd_docs.columns
    ids = [r.doc_id for r in one.collect()]
    assert {60, 61, 62, None} <= set(ids) and 66 in ids and 67 not in ids
    assert not {40, 41, 42, 44, 45} & set(ids)


def test_jaccard_keeps_missing_and_shared_ids_apart(spark, odd_docs, odd_rows):
    rows = [(d, t) for d, t, _ in odd_rows]
    long = max((t for _, t in rows if t and len(t) < 2000), key=len)
    rows += [(None, long + " once"), (None, "all else is different here"), (None, "all  else is different HERE"), (None, ""), (60, "a text under a used id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sets = {(brute.order_key(d), t or ""): brute.shingles(t) for d, t in rows}
    want = brute.components(sets)
    public = lambda d: None if d == brute.order_key(None) else d
    got = trie_join.jaccard_components(docs).collect()
    by_id = lambda x: (brute.order_key(x[0]), x[1], brute.order_key(x[2]))
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=by_id) == sorted(
        ((d, len(sets[brute.order_key(d), t or ""]), public(want[brute.order_key(d), t or ""][0])) for d, t in rows), key=by_id
    )
    kept = trie_join.one_of_each_component(docs).collect()
    assert len(kept) == len(set(want.values()))
    assert {want[brute.order_key(r.doc_id), r.text or ""] for r in kept} == set(want.values())
    assert sum(r.doc_id is None for r in kept) >= 3


def test_prefix_tree_finds_all_components():
    rng = random.Random(11)
    for _ in range(150):
        pool = list(range(rng.choice([6, 12, 30])))
        sets = [set(rng.sample(pool, rng.randint(1, len(pool)))) for _ in range(rng.randint(2, 14))]
        for s in list(sets)[:5]:
            near = set(s)
            near ^= set(rng.sample(pool, rng.choice([0, 1, 2])))
            sets.append(near or {0})
        percent = rng.choice([50, 75, 90])
        held = {t: sum(t in s for s in sets) for t in pool}
        arrays = [np.array(sorted(s, key=lambda t: (held[t], t)), np.uint64) for s in sets]
        order = [np.array([held[int(t)] for t in a], np.uint16) for a in arrays]
        links = trie_join.join_group(list(range(len(sets))), [len(s) for s in sets], arrays, order, percent)
        got = {i: i for i in range(len(sets))} | dict(links)
        assert got == brute.components(dict(enumerate(sets)), percent)


def test_connected_components(spark):
    from liftlake.llm.common import connected_components

    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 300)] + [(rng.randint(400, 500), rng.randint(400, 500)) for _ in range(60)]
    edges += [(7, 7), (100, 101)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in parent if find(x) != x}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("operator", ["words", "bytes"])
def test_many_rows_without_an_id_take_no_longer(spark, operator):
    """2,000 texts without an id against the same under ids: equal results and
    no list of all their places or spans."""
    import time

    rng = random.Random(11)
    passage = prose(rng, 40)
    texts = [prose(rng, 40) + (" " + passage if i % 3 else "") + f" {i}" for i in range(2000)]
    fn = {"words": substring_dedup.remove_repeated_words, "bytes": suffix_dedup.removal_figures}[operator]
    took, sums = [], []
    for rows in ([(i, t) for i, t in enumerate(texts)], [(None, t) for t in texts]):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        t0 = time.perf_counter()
        got = fn(docs).collect()
        took.append(time.perf_counter() - t0)
        sums.append((len(got), sum(r.n_removed > 0 for r in got)))
    assert sums[0][0] == sums[1][0] == 2000 and sums[0][1] == sums[1][1]
    assert took[1] < 2 * took[0] + 5
    brute_of = {"words": brute.substring_dedup, "bytes": brute.byte_dedup}[operator]
    few = [(None, t) for t in texts[:60]]
    # Which of two texts without an id comes first is settled by their hashes.
    want = sorted(v[1] > 0 for v in brute_of(few).values())
    assert sorted(r.n_removed > 0 for r in fn(spark.createDataFrame(few, "doc_id long, text string")).collect()) == want

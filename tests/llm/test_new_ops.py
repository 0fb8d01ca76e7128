import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from liftlake.llm import alignment, hard_negatives, tree_bpe
from liftlake.llm.tokens import tokenizer_path

WORD_BPE = "word_bpe_49k.json"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- op 11


def given_tokenizer(name=WORD_BPE):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(name))


GLUE = [
    "hello ", "World", "́", "e", "é", "'s", " don't", "!!!", "'", "日本語", "　", "\x85", "\x1c", " ", "\n", "\t", "\xa0", "<|endoftext|>",
    "<|startoftext", "|>", "123", "ΑΣ", "İ", "👍🏽", "aaaa", "ß", "ﬁ", "각", "_", "x" * 9,
]


@pytest.mark.parametrize("leaf", [3, 7, 40])
def test_tree_of_halves_gives_the_ids_of_the_whole(leaf):
    whole, encoder = given_tokenizer(), tree_bpe.TreeEncoder(tokenizer_path(WORD_BPE), leaf=leaf)
    encoder.words.tree.leaf = 5
    rng = random.Random(leaf)
    for _ in range(800):
        text = "".join(rng.choice(GLUE) for _ in range(rng.randint(0, 30)))
        ids = encoder.encode(text)
        want = whole.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, repr(text)
        assert encoder.decode(ids) == whole.decode(want, skip_special_tokens=False)
    assert encoder.windows > 100


def test_tree_inside_one_pre_token():
    model = given_tokenizer().model
    halves, whole = tree_bpe.LetterTree(model, leaf=4), tree_bpe.LetterTree(model)
    names = [model.id_to_token(i).replace("</w>", "") for i in range(512, 49000, 7)]
    rng = random.Random(5)
    for alphabet in ("a", "ab", "theinan", names):
        for _ in range(250):
            letters = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 120)))
            assert halves.encode(letters) == whole.tokens(letters), letters
    assert halves.windows > 1000


def test_a_long_run_is_joined_by_short_windows():
    encoder = tree_bpe.TreeEncoder(tokenizer_path(WORD_BPE))
    seen = []
    plain = encoder.words.tree.tokens
    encoder.words.tree.tokens = lambda letters, at=0: seen.append(len(letters)) or plain(letters, at)
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefgh") for _ in range(20_000))
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == given_tokenizer().encode(text, add_special_tokens=False).ids
    assert max(seen) <= tree_bpe.LEAF_LETTERS
    run = "c" * 4999  # no window but the whole settles where the pairs fall
    assert np.frombuffer(encoder.encode(run), "<u4").tolist() == given_tokenizer().encode(run, add_special_tokens=False).ids


@pytest.mark.parametrize("spread", [50, 1000, 1 << 16])
def test_encoded_documents_equal_the_library(odd_docs, odd_rows, no_docs, spread):
    whole = given_tokenizer()
    want = Counter()
    for d, t, _ in odd_rows:
        ids = whole.encode(t or "", add_special_tokens=False).ids
        want[d, len(ids), sha(" ".join(map(str, ids))), sha(whole.decode(ids, skip_special_tokens=False))] += 1
    got = tree_bpe.encode_documents(odd_docs, spread=spread, full=True).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    assert all(len(r.ids) == 4 * r.n_tokens and sha(r.decoded) == r.decoded_sha256 for r in got)
    assert tree_bpe.encode_documents(no_docs, spread=spread).count() == 0


def test_long_texts_with_added_tokens_and_copies(spark):
    from liftlake.llm.queries import code_path

    code_path(spark)
    rng = random.Random(3)
    long = "".join(rng.choice(GLUE) for _ in range(900))
    rows = [(1, long), (1, long), (1, long + "b"), (None, long), (2, "<|endoftext|>" * 9), (3, "x" * 700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = given_tokenizer()
    want = Counter((d, sha(" ".join(map(str, whole.encode(t, add_special_tokens=False).ids)))) for d, t in rows)
    got = tree_bpe.encode_documents(docs, spread=64).collect()
    assert Counter((r.doc_id, r.ids_sha256) for r in got) == want


# ---- op 12


def brute_alignment(rows):
    import sentencepiece

    a_model = given_tokenizer("byte_bpe_50k.json")
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letter = {chr(b): b for b in plain}
    letter |= {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    docs = []
    for doc_id, text in rows:
        found = None
        if text:
            raw = (" " + text).encode()
            a = a_model.encode(" " + text, add_special_tokens=False).ids
            b = b_model.encode(text)
            in_a = [bytes(letter[c] for c in a_model.id_to_token(i)) for i in a]
            in_b = [bytes([int(b_model.id_to_piece(i)[3:5], 16)]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(in_a) == raw and b"".join(in_b) == raw:
                end_a, end_b = np.cumsum(list(map(len, in_a))).tolist(), np.cumsum(list(map(len, in_b))).tolist()
                span = lambda ends: list(zip([0, *ends], ends))
                links = [(i, j) for i, (s, e) in enumerate(span(end_a)) for j, (u, v) in enumerate(span(end_b)) if s < v and u < e]
                cuts = sorted(set(end_a) & set(end_b))
                groups = [([i for i, e in zip(a, end_a) if s < e <= c], [i for i, e in zip(b, end_b) if s < e <= c]) for s, c in zip([0, *cuts], cuts)]
                found = (a, b, links, groups)
        docs.append((doc_id, found))
    count = Counter(p for _, f in docs if f for p in {(f[0][i], f[1][j]) for i, j in f[2]})
    highest = defaultdict(int)
    for (a, _), n in count.items():
        highest[a] = max(highest[a], n)
    out = Counter()
    for doc_id, f in docs:
        if f is None:
            out[doc_id, 0, 0, 0, 0, 0, 0, ""] += 1
            continue
        a, b, links, groups = f
        pairs = [(a[i], b[j]) for i, j in links]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out[doc_id, len(a), len(b), len(groups), len(links), sum(count[p] == highest[p[0]] for p in pairs), sum(count[p] for p in pairs), sha(text)] += 1
    return out


ODD = [
    "a  b", " a", "a ", "  ", "\n", " \n a", "a\nb", "▁x", "x ▁y", "<s> x</s>", "<|endoftext|> hi", "a　b 　c", "ＡB ﬁ é", "👍🏽 ok",
    "it's  we'll", "tab\tb", "\x1ca \x1c b", "a\x85 b", "<0x41>", "x\0y", "日本語テキスト", "a \n b",
]


@pytest.mark.parametrize("chars", [40, 1 << 22])
def test_alignment_equals_brute_force(spark, odd_docs, odd_rows, no_docs, chars):
    rows = [(d, t) for d, t, _ in odd_rows if len(t or "") < 6000] + [(100 + i, t) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame([(*r, "n_a", 1) for r in rows], "doc_id long, text string, chunk string, total int").repartition(3)
    got = Counter(map(tuple, alignment.align_documents(docs, chunk_chars=chars).collect()))
    assert got == brute_alignment(rows)
    assert alignment.align_documents(no_docs).count() == 0
    assert alignment.align_documents(odd_docs).count() == len(odd_rows)


def test_links_cover_the_bytes_of_every_token(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*ODD, "unbelievably long-winded text", None])], "doc_id long, text string")
    for r in alignment.linked_tokens(docs).collect():
        by_a = Counter()
        for link in r.links:
            by_a[link.a] += link.bytes
        assert sorted(by_a) == list(range(len(r.a_ids)))
        assert sum(by_a.values()) == (r.group_ends[-1] if r.group_ends else 0)
        shared = {(x.a, x.b) for x in r.shared}
        assert {(x.a, x.b) for x in r.links} <= shared
        assert len(r.links) == len(r.a_ids) + len(r.b_ids) - len(r.group_ends)


def test_gustavson_equals_the_dense_product():
    rng = np.random.default_rng(2)
    for n, k, m in ((3, 4, 5), (1, 1, 1), (0, 4, 3), (6, 9, 2)):
        x, y = rng.integers(0, 3, (n, k)), rng.integers(0, 3, (k, m))

        def csr(d):
            return alignment.Csr(np.concatenate(([0], np.cumsum((d != 0).sum(1)))), np.nonzero(d)[1], d[d != 0], d.shape[1])

        z = csr(x).times(csr(y))
        dense = np.zeros((n, m), np.int64)
        dense[z.rows(), z.indices] = z.data
        assert (dense == x @ y).all()
        assert (z.transposed().indptr == np.concatenate(([0], np.cumsum((dense != 0).sum(0))))).all()


# ---- op 13


def brute_negatives(rows):
    good = []
    for vec_id, vector, label in rows:
        if label is None or vector is None or any(x is None or not np.isfinite(x) for x in vector):
            continue
        label = (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label
        good.append((vec_id, [max(-(2**26), min(2**26, int(np.floor(256.0 * float(np.float32(x)))))) for x in vector], label))
    order = lambda s: (-s[0], s[1] is None, s[1] or 0)
    out = Counter()
    for i, (anchor, vector, label) in enumerate(good):
        if anchor is None or anchor % 100:
            continue
        scored = [(sum(x * y for x, y in zip(vector, v)), d, own == label) for j, (d, v, own) in enumerate(good) if j != i]
        for p, positive, _ in sorted((s for s in scored if s[2]), key=order)[:5]:
            inside = sorted((s for s in scored if not s[2] and 30 * p <= 100 * s[0] <= 90 * p), key=order)[:10]
            for rank, (n, negative, _) in enumerate(inside, 1):
                out[anchor, positive, rank, negative, p, n] += 1
    return out


def _vectors(rng, n, width, scale=1.0):
    return [[float(np.float32(x)) for x in v] for v in rng.normal(0, scale, (n, width))]


def _negatives(spark, rows, **how):
    from liftlake.llm.queries import code_path

    code_path(spark)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, block string, pack int").repartition(3)
    return Counter(map(tuple, hard_negatives.hard_negatives(df, **how).collect()))


def test_hard_negatives_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = [(i, v, int(rng.integers(0, 4))) for i, v in enumerate(_vectors(rng, 700, 12))]
    rows += [(i, rows[100][1], 1) for i in range(1000, 1060)]  # one vector many times
    rows += [rows[200], rows[200], rows[201], (300, rows[5][1], 2)]  # rows and ids repeated
    rows += [(None, rows[300][1], 0), (None, rows[301][1], 1), (2000, None, 1), (2100, [1.0, None], 1), (2200, [float("nan")] * 12, 1), (2300, rows[0][1], None)]
    rows += [(2400, [float("inf")] + [0.0] * 11, 1), (2500, [], 1), (2600, rows[400][1][:5], 2), (2700, [0.0] * 12, 3), (2800, [1e30, -1e30, 3.0], 1), (-700, rows[7][1], 0)]
    want = brute_negatives(rows)
    assert len(want) > 300
    assert _negatives(spark, rows) == want
    assert _negatives(spark, rows, block_rows=7, pack_anchors=2, cell_numbers=400) == want


def test_hard_negatives_small_groups_and_no_rows(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [0.5, 0.5], 1), (2, [0.3, 0.1], 2), (100, [-1.0, 0.2], 9)]
    assert _negatives(spark, rows) == brute_negatives(rows)
    assert not _negatives(spark, rows[:0])
    assert not _negatives(spark, [(0, [1.0], 1)])


def test_the_bitmap_shrinks_before_all_dimensions_are_read():
    rng = np.random.default_rng(1)
    vectors = rng.integers(-4, 5, (3000, 64)).astype("<i4")
    vectors[:10, :16] += 400
    row = {
        "n": 3000, "width": 64, "ids": np.arange(3000).astype("<i8").tobytes(), "no_id": bytes(3000), "labels": np.ones(3000, "<i8").tobytes(),
        "columns": np.ascontiguousarray(vectors.T).tobytes(),
    }
    block, seen = hard_negatives.Block(row), []
    anchor = np.where(np.arange(64) < 16, 300, 1)

    def keep(rows, low, high):
        seen.append(len(rows))
        return high >= np.sort(low)[-5]

    rows, scores = hard_negatives.scan(block, anchor, np.arange(3000), keep)
    assert seen[0] == 3000 and seen[-1] < 100
    assert set(np.argsort(-(vectors.astype(int) @ anchor))[:5]) <= set(rows.tolist())
    assert (scores == vectors[rows].astype(int) @ anchor).all()

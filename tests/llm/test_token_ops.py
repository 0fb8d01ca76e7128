import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from liftlake.llm import packing, token_files
from liftlake.llm.common import shared_folder
from liftlake.llm.tokens import TextIds, tokenizer_path

from . import brute

SPACES = ["a  b", "a\n b", "a \nb", "a\n \nb", " lead", "trail ", "a\tb c", "\n", "\n\n", "a\n", "\na", "a b c", "a\x1cb c", "x\x85y z", "a\r\nb"]
MARKS = ["it's we'll, don't.", "word.\nThe, end", "a.b. c!? d...", "3.14 15, 9,", "foo_bar, __x__ 1st 2nd.", "HELLO!! World!!", "<|endoftext|> hi"]
LETTERS = ["naïve Ünï ÉCOLE ß İstanbul œuvre", "é café x", "ſ K Å ªº µ", "日本語 テキスト。 ok", "👍🏽 ok!", "Straße ÀÉ", "ı I i İ"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_piecewise_ids_equal_whole_ids(name, odd_rows):
    encode = TextIds(tokenizer_path(name))
    rng = random.Random(2)
    glued = ["".join(rng.choice([" ", "\n", "a", "B", ".", ",", "é", "1", "'s", "!", "\t"]) for _ in range(12)) for _ in range(3000)]
    for text in [*SPACES, *MARKS, *LETTERS, *glued, *(t or "" for _, t, _ in odd_rows)]:
        assert encode(text) == encode.whole(text), repr(text)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_those_of_the_file_as_given(name, odd_rows):
    from tokenizers import Tokenizer

    path = tokenizer_path(name)
    encode, given = TextIds(path), Tokenizer.from_file(path)
    added = ["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|endoftext", "<|im_start|>"]
    glued = [f(a) for a in added for f in (str, "{} hi".format, "a {}b".format, "word {} {}\n".replace("{} {}", a + " " + a).format, "no {}.".format)]
    for text in [*SPACES, *MARKS, *LETTERS, *glued, *(t or "" for _, t, _ in odd_rows)]:
        want = given.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encode(text), "<u4").tolist() == want, repr(text)
    assert np.frombuffer(encode("<|endoftext|> hi"), "<u4").tolist() == {"byte_bpe_50k.json": [50256, 23105], "word_bpe_49k.json": [49407, 1883]}[name]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_of_former_generations_give_the_same_ids(name, monkeypatch):
    from liftlake.llm import tokens

    monkeypatch.setattr(tokens, "MAX_PIECES", 40)
    encode = TextIds(tokenizer_path(name))
    rng = random.Random(4)
    glued = ["".join(rng.choice(["a", "bc", "Ünï", "\n", "\\n", " ", " ", "x.", "y, ", "1"]) for _ in range(30)) for _ in range(400)]
    for text in ["\\n", "a \\n\nb", *glued]:
        assert encode(text) == encode.whole(text), repr(text)


def test_marks_beside_known_words_are_not_encoded_again(monkeypatch):
    encode, asked = TextIds(tokenizer_path("byte_bpe_50k.json")), []
    plain = type(encode.words)._encode
    monkeypatch.setattr(type(encode.words), "_encode", lambda self, text: asked.append(text) or plain(self, text))
    first = "\n".join("word &&& 12 (é) " + m + " x" for m in ("%%", "--", "."))
    encode(first)
    asked.clear()
    for text in ("word&&& x 12%%word", "(word--é", "x word&&&\nword--x", "x ¿word? «é» 12²word"):
        assert encode(text) == encode.whole(text), text
    assert not {t.strip() for t in asked} & {"word&&&", "12%%word", "(word--é", "word--x", "«é»"} and "&&&" in asked
    rng = random.Random(8)
    signs = [chr(c) for c in range(0x100)] + list("ab12'’é,.!&٣Ⅷ \n")
    for _ in range(4000):
        text = "".join(rng.choices(signs, k=9))
        assert encode(text) == encode.whole(text), repr(text)


def test_a_packing_task_leaves_no_pieces_in_its_worker():
    from liftlake.llm import tokens

    path = tokenizer_path("word_bpe_49k.json")
    batch = pa.RecordBatch.from_pydict({"did": [1], "th": [2], "doc_id": [1], "text": ["some words, twice: some words"]})
    (out,) = packing._pieces(path, 8, 1, False)(iter([batch]))
    assert out.num_rows == 1 and not tokens.text_ids(path).words and not tokens.text_ids(path).words.old
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        encode = TextIds(tokenizer_path(name))
        before = encode("it's some words.")
        encode.forget()
        assert encode("it's some words.") == before == encode.whole("it's some words.")


def _ids(name, odd_rows, end):
    encode = TextIds(tokenizer_path(name))
    return {(brute.order_key(d), t or ""): encode.whole(t or "") + end.to_bytes(4, "little") for d, t, _ in odd_rows}


def test_packing_covers_every_id_once(odd_docs, odd_rows, no_docs):
    want = _ids("word_bpe_49k.json", odd_rows, 1)
    got = packing.pack_documents(odd_docs, capacity=128, with_ids=True).collect()
    pieces, windows = {}, {}
    for r in got:
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        windows.setdefault(r.sequence_id, []).append(r)
    total = sum(len(want[brute.order_key(d), t or ""]) // 4 for d, t, _ in odd_rows)
    assert sum(r.length for r in got) == total
    whole = sorted(want[brute.order_key(d), t or ""] for d, t, _ in odd_rows)
    unique = [v for v in pieces.values() if len({r.start for r in v}) == len(v)]
    assert len(unique) > 40
    for rows in unique:
        assert b"".join(r.ids for r in sorted(rows, key=lambda r: r.start)) in whole
    for rows in windows.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 128
    assert len(windows) * 128 < 1.2 * total + 8 * 128
    assert packing.pack_documents(no_docs).count() == 0


def test_best_fit_takes_the_tightest_window():
    rng = random.Random(4)
    for _ in range(60):
        capacity = rng.choice([7, 16, 100])
        fit, rooms = packing.BestFit(capacity), []
        for n in sorted((rng.randint(1, capacity) for _ in range(80)), reverse=True):
            window, offset = fit.place(n)
            tight = min((r for r in rooms if r >= n), default=None)
            if tight is None:
                assert (window, offset) == (len(rooms), 0)
                rooms.append(capacity - n)
            else:
                assert rooms[window] == tight and offset == capacity - tight
                rooms[window] -= n


def test_re_pair_round_trip_and_random_access():
    rng = np.random.default_rng(6)
    for size, top in ((0, 5), (1, 5), (50, 3), (4000, 4), (4000, 70_000)):
        ids = rng.integers(3, top + 3, size).astype(np.uint32)
        ids[::17] = 2
        grammar = token_files.re_pair(ids, end_id=2, min_count=3)
        assert grammar.expand().tolist() == ids.tolist()
        if top == 4 and size > 1000:
            assert len(grammar.rules) > 10 and len(grammar.symbols) < 0.7 * size
            reached = np.concatenate((np.ones(grammar.terminals, int), grammar.lengths()))[grammar.symbols].cumsum()
            assert grammar.expand(100, 200).tolist() == ids[reached[99] : reached[199]].tolist()


def test_re_pair_ends_without_a_frequent_pair():
    rng = np.random.default_rng(9)
    text = np.append(rng.integers(3, 5000, 700), 2)
    runs = np.concatenate([np.append(np.full(n, 7), 2) for n in (5, 1, 3000, 64, 2, 2, 0)])
    for ids, most in ((np.tile(text, 40), 200), (runs, 120), (np.concatenate([np.tile(text, 30), runs]), 400)):
        grammar = token_files.re_pair(ids.astype(np.uint32), end_id=2, min_count=24)
        assert grammar.expand().tolist() == ids.tolist()
        assert len(grammar.symbols) < most
        counts, free = {}, -1
        for i, pair in enumerate(zip(grammar.symbols[:-1].tolist(), grammar.symbols[1:].tolist())):
            if 2 not in pair and not (pair[0] == pair[1] and i == free):
                counts[pair] = counts.get(pair, 0) + 1
                free = i + 1 if pair[0] == pair[1] else -1
        assert max(counts.values(), default=0) < 24


def test_incremental_pair_counts_equal_counting_anew():
    rng = np.random.default_rng(3)
    for _ in range(30):
        words = [rng.integers(3, 30, rng.integers(1, 9)) for _ in range(12)]
        ids = np.concatenate([words[i] for i in rng.integers(0, 12, 900)]).astype(np.uint32)
        ids[rng.random(len(ids)) < 0.02] = 2
        grammar = token_files.re_pair(ids, end_id=2, pairs=5, min_count=4)
        assert grammar.expand().tolist() == ids.tolist()
        counts, free = {}, -1
        for i, pair in enumerate(zip(grammar.symbols[:-1].tolist(), grammar.symbols[1:].tolist())):
            if 2 not in pair and not (pair[0] == pair[1] and i == free):
                counts[pair] = counts.get(pair, 0) + 1
                free = i + 1 if pair[0] == pair[1] else -1
        assert max(counts.values(), default=0) < 4


def test_counting_pairs_by_table_by_sort_and_by_index_gives_one_grammar(monkeypatch):
    rng, asked = np.random.default_rng(4), []
    of_all, often = token_files._often_of_all, token_files._often
    monkeypatch.setattr(token_files, "_often_of_all", lambda *a: asked.append("table") or of_all(*a))
    for _ in range(20):
        words = [rng.integers(3, 15, rng.integers(1, 9)) for _ in range(12)]
        ids = np.concatenate([words[i] for i in rng.integers(0, 12, 600)]).astype(np.uint32)
        ids[rng.random(len(ids)) < 0.02] = 2
        few = token_files.re_pair(ids, end_id=2, pairs=5, min_count=4)
        with monkeypatch.context() as m:
            m.setattr(token_files, "_often_of_all", lambda left, right, inner, least: (*_by_sort(left, right, inner, least, often),))
            by_sort = token_files.re_pair(ids, end_id=2, pairs=5, min_count=4)
            m.setattr(token_files, "_often", lambda left, right, at, least, high: often(left, right, at, least, 1 << 31))
            by_index = token_files.re_pair(ids, end_id=2, pairs=5, min_count=4)
        for other in (by_sort, by_index):
            assert other.symbols.tolist() == few.symbols.tolist() and other.rules.tolist() == few.rules.tolist()
    assert "table" in asked


def _by_sort(left, right, inner, least, often):
    wanted = np.flatnonzero(inner[left] & inner[right] & (left != right))
    keys, counts, at = often(left[wanted], right[wanted], wanted, least, 1 << 20)
    number = np.zeros(len(left), np.int32)
    number[at] = np.repeat(np.arange(1, len(keys) + 1), counts)
    return keys, counts, number


def test_a_round_looks_only_at_places_it_changes(monkeypatch):
    seen, often = [], token_files._often
    monkeypatch.setattr(token_files, "_often", lambda left, right, at, *a: seen.append(len(at)) or often(left, right, at, *a))
    rng = np.random.default_rng(5)
    ids = np.append(rng.integers(3, 60_000, 20_000), np.tile(np.append(rng.integers(3, 60_000, 200), 2), 30)).astype(np.uint32)
    grammar = token_files.re_pair(ids, end_id=2)
    assert grammar.expand().tolist() == ids.tolist() and len(grammar.rules) > 150
    # At most the places replaced and those before them.
    assert sum(seen[1:]) <= 2 * 30 * 200 and len(seen) > 3


def test_reading_a_part_expands_the_rules_it_needs():
    rng = np.random.default_rng(9)
    texts = [np.append(np.tile(rng.integers(3, 4000, 50), 8), 2) for _ in range(40)]
    ids = np.concatenate([t for t in texts for _ in range(6)]).astype(np.uint32)
    grammar = token_files.re_pair(ids, end_id=2, min_count=4)
    assert grammar.expand().tolist() == ids.tolist() and grammar.expanded > 1000
    for start, n in ((0, 1), (5, 0), (7, 40), (401, 1), (len(ids) - 3, 9), (len(ids), 5), (1234, 500)):
        before = grammar.expanded
        assert grammar.read(start, n).tolist() == ids[start : start + n].tolist()
        assert grammar.expanded - before <= 2 * n + 100
    row = {"symbols": grammar.symbols.astype("<u4").tobytes(), "wide": True, "rules": grammar.rules.astype("<u4").tobytes(), "terminals": grammar.terminals,
           "lengths": (2 * grammar.lengths()).astype("<u4").tobytes()}
    assert token_files.read_grammar(row).lengths().tolist() == (2 * grammar.lengths()).tolist()  # those of the file


def test_token_files_round_trip(spark, odd_docs, odd_rows, no_docs):
    want = _ids("byte_bpe_50k.json", odd_rows, 2)
    folder = token_files.write_token_files(odd_docs, f"{shared_folder(spark)}/tokens", shard_tokens=900)
    got = token_files.read_token_files(spark, folder, with_ids=True).orderBy("start").collect()
    assert len(got) == len(odd_rows)
    at = 0
    for r in got:
        assert r.start == at and len(r.ids) == 4 * r.n_tokens and zlib.crc32(r.ids) == r.ids_crc32
        at += r.n_tokens
    assert [brute.order_key(r.doc_id) for r in got] == sorted(brute.order_key(d) for d, _, _ in odd_rows)
    assert sorted(r.ids for r in got) == sorted(want[brute.order_key(d), t or ""] for d, t, _ in odd_rows)
    shard = spark.read.parquet(folder).orderBy("part", "shard").first().asDict()
    first = [r for r in got if r.start < shard["n_tokens"]]
    for i, r in enumerate(first):
        assert token_files.read_document(shard, i).astype("<u4").tobytes() == r.ids
        assert token_files.read_document(shard, i, 2, 5).astype("<u4").tobytes() == r.ids[8:28]
    empty = token_files.write_token_files(no_docs, f"{shared_folder(spark)}/tokens")
    assert token_files.read_token_files(spark, empty).count() == 0

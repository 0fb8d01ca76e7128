import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from liftlake.llm import fingerprints, language_id, preferences, quality_rules, source_mix
from liftlake.llm.common import keyed

from . import brute


def test_quality_measures_equal_brute_force(odd_docs, odd_rows, no_docs):
    got = quality_rules.verdicts(odd_docs).collect()
    assert len(got) == len(odd_rows)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.quality_base(r["row"].text)
        assert not (r.kept and r.base_failed)
    kept = quality_rules.keep_good(odd_docs)
    assert kept.columns == odd_docs.columns
    assert kept.count() == sum(r.kept for r in got) > 10
    assert quality_rules.verdicts(no_docs).count() == 0


def test_clean_texts_in_capitals_and_other_scripts_are_kept(spark, odd_docs):
    line = "the quick brown fox is in a garden with many roses and it {} was quiet near those other windows before winter came over them"
    russian = "быстрая лиса сидит возле старого дома {} пока люди гуляют вдоль реки среди деревьев города потому вечер очень тихий"
    polish = "szybki lis siedzi obok starego domu {} kiedy ludzie chodz\u0105 wzd\u0142u\u017c rzeki bardzo cicho pod wieczornym niebem nad naszym pi\u0119knym miastem oraz lasem"
    texts = {"lower": line.format("now"), "upper": line.format("now").upper(), "russian": russian.format("дом"), "polish": polish.format("wtedy")}
    got = {r["row"].k: r.failed_rules for r in quality_rules.verdicts(spark.createDataFrame(list(texts.items()), "k string, text string")).collect()}
    assert got == {"lower": "", "upper": "", "russian": "", "polish": "stop_words"}
    # The measures are computed once, however many rules name them.
    plan = quality_rules.keep_good(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("split(") <= 2


def test_repeated_words(spark):
    w = [f"w{i}" for i in range(30)]
    texts = ["", "a", " ".join(w), " ".join(w + w), " ".join(["x"] * 12), " ".join(w[:10] + ["z"] + w[:10]), " ".join(w[:9] * 3 + w)]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select(
        "t", quality_rules.repeated_words(quality_rules.words_of(F.col("t"))).alias("n")
    )
    for r in got.collect():
        assert r.n == brute.quality_base(r.t)[4]


def test_mix_takes_near_its_targets(odd_docs, odd_rows, no_docs):
    got = source_mix.mixed(odd_docs).collect()
    assert len(got) == len(odd_rows)
    sizes, taken, goal, biggest = {}, {}, {}, {}
    for r in got:
        s, n = r["row"].source, len(brute.words(r["row"].text))
        assert r["size"] == n and 0 <= r.copies <= 3
        sizes[s] = sizes.get(s, 0) + n
        taken[s] = taken.get(s, 0) + n * r.copies
        goal[s], biggest[s] = r.target, max(biggest.get(s, 0), n)
    assert goal == pytest.approx(brute.mix_targets(sizes))
    assert all(abs(taken[s] - goal[s]) <= biggest[s] for s in sizes)
    again = source_mix.mix_documents(odd_docs)
    assert again.columns == odd_docs.columns
    assert again.count() == sum(r.copies for r in got)
    assert source_mix.mixed(no_docs).count() == 0


def test_mix_by_ids_equals_mix_and_weighs_letters_of_any_script(spark, odd_docs, no_docs):
    columns = ("size", "source_size", "target", "copies")
    rows = sorted(((r["row"].doc_id, *[r[c] for c in columns]) for r in source_mix.mixed(odd_docs).collect()), key=repr)
    assert sorted(map(tuple, source_mix.mixed_ids(odd_docs).collect()), key=repr) == rows and source_mix.mixed_ids(no_docs).count() == 0
    texts = [("быстрая лиса",), ("quick fox",), ("日本語です",), ("",), (None,)]
    got = [r.w for r in spark.createDataFrame(texts, "text string").select(source_mix.quality_weight(F.col("text")).alias("w")).collect()]
    assert got == pytest.approx([11 / 12, 8 / 9, 1.0, 0.01, 0.01])
    # No bucket holds much of a source, whatever its quality.
    for quality in (1.0, 0.01):
        spots = spark.range(20_000).selectExpr("id AS doc_id", "'' AS text").select(source_mix.order_columns(F.lit(quality))["spot"].alias("s"))
        assert spots.groupBy("s.bucket").count().agg(F.max("count")).first()[0] < 90


def test_mix_equals_brute_force(spark):
    docs = [(i, " ".join(["word"] * (1 + i * 7 % 23)), f"s{i * i % 5}" if i % 7 else None) for i in range(200)]
    quality = lambda t: max(0.01, sum(c.isalpha() for c in t) / max(1, len(t)))
    got = source_mix.mixed(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    assert {(r["row"].doc_id, r["row"].text): r["size"] * r.copies for r in got} == brute.mix(docs, quality)


def test_water_filling_reshares_the_excess(spark):
    sizes = {"a": 1000, "b": 1, "c": 2, "d": 500, None: 30, "e": 0}
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    assert {r.source: r.target for r in source_mix.targets(rows).collect()} == pytest.approx(brute.mix_targets(sizes))


def test_fingerprints_equal_brute_force(spark, odd_docs, odd_rows, no_docs):
    def parts(t):
        return {p for p in re.split(r"\n+|(?<=[.!?]) +", t) if p}

    def like(a, b):
        a, b = parts(a), parts(b)
        return len(a & b) / len(a | b) if a | b else 1.0

    # One row for each id and text, ids unique, so that the order is plain.
    rows = sorted({d: (t or "") for d, t, _ in odd_rows if d is not None and d != 7}.items())
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in fingerprints.fingerprint_edits(docs).collect()}
    assert len(got) == len(rows)
    prints = {}
    for i, (d, x) in enumerate(rows):
        y, n = rows[(i + 1) % len(rows)][1], len(x)
        edited = x[: n - n // 2] + y[: n // 2]
        r = got[d]
        assert r.n_chars == n and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_edited == pytest.approx(like(x, edited)) and r.near_next == pytest.approx(like(x, y))
        assert prints.setdefault(x, r.fingerprint) == r.fingerprint
    assert fingerprints.fingerprint_edits(no_docs).count() == 0
    everything = fingerprints.fingerprint_edits(odd_docs)
    assert everything.count() == len(odd_rows)
    # The likenesses follow from the written fingerprints alone.
    texts = spark.createDataFrame([(got[d].fingerprint, got[rows[(i + 1) % len(rows)][0]].fingerprint, got[d].edited_fingerprint) for i, (d, _) in enumerate(rows)], "own string, next string, edited string")
    like = texts.select("own", fingerprints.fingerprint_likeness(F.col("own"), F.col("edited")).alias("e"), fingerprints.fingerprint_likeness(F.col("own"), F.col("next")).alias("n"))
    assert sorted(map(tuple, like.collect())) == sorted((r.fingerprint, r.near_edited, r.near_next) for r in got.values())


def test_fingerprint_sketches_peel_alone(spark):
    sets = [[], [5], list(range(7)), list(range(300)), [i << 36 for i in range(20)]]
    found = spark.createDataFrame([(s,) for s in sets], "k array<bigint>").select(
        "k", F.flatten(F.transform(fingerprints.sketches(F.col("k")), lambda leaf: fingerprints.recovered(leaf["cells"]))).alias("found"),
        fingerprints.held(fingerprints.sketches(F.col("k"))).alias("n"),
    ).collect()
    # Digests that agree in the 36 bits that deal them and in their cells cannot be told apart.
    for r in found[:4]:
        assert sorted(r.found) == sorted(r.k) and r.n == len(r.k)
    assert found[4].found is None and found[4].n == 20


def test_next_rows_of_one_id_lie_in_many_ranges(spark):
    docs = spark.range(3000).selectExpr("if(id % 2 = 0, null, id) AS doc_id", "concat('text ', id) AS text")
    rows = keyed(docs)
    got = {(r.did, r.th): r.next_th for r in fingerprints.with_next(rows, "th").collect()}
    order = sorted((r.did, r.th) for r in rows.collect())
    assert got == {k: order[(i + 1) % len(order)][1] for i, k in enumerate(order)}


def test_columns_of_the_next_row_are_made_once_a_row_after_the_shuffle(spark):
    docs = spark.createDataFrame([(i, "x. " * i) for i in range(40)], "doc_id long, text string")
    near = fingerprints.with_next(keyed(docs), "text", made={"own": F.length("text")})
    plan = near._sc._jvm.PythonSQLUtils.explainString(near._jdf.queryExecution(), "simple")
    assert "length(" in plan.split("Exchange")[0] and "length(" not in plan.split("Exchange", 1)[1]
    got = {r.did: (r.own, r.next_own) for r in near.collect()}
    assert got == {i: (3 * i, 3 * ((i + 1) % 40)) for i in range(40)}


def test_a_table_without_shared_cells_states_the_digests(spark):
    place = lambda i, j, k: i << 40 | j << 44 | k << 48
    sets = [[], [place(1, 1, 1)], [place(0, 0, 0) + 5, place(1, 0, 0)], [place(0, 0, 2), place(0, 0, 1)], [place(0, 3, 2), place(0, 3, 2) + 9]]
    df = spark.createDataFrame([(s,) for s in sets], "s array<bigint>").select("s", fingerprints.stated(fingerprints.sketch(F.col("s"))).alias("k"))
    got = [(r.s, r.k) for r in df.collect()]
    assert [None if k is None else sorted(k) for _, k in got] == [sorted(s) for s in sets[:4]] + [None]


def test_likeness_of_large_sets(spark):
    rows = [(list(range(a)), list(range(b, c))) for a, b, c in ((0, 0, 0), (5, 5, 5), (40, 0, 41), (300, 100, 700), (2000, 0, 2000), (1500, 1500, 3000))]
    spread = lambda c: F.array_distinct(F.transform(c, lambda x: F.xxhash64(x)))
    got = spark.createDataFrame(rows, "a array<int>, b array<int>").select(
        "a", "b", fingerprints.likeness(fingerprints.sketches(spread("a")), fingerprints.sketches(spread("b"))).alias("n")
    ).collect()
    for r in got:
        a, b = set(r.a), set(r.b)
        assert r.n == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)


def test_language_id(spark, odd_docs, odd_rows, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.predict_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    n, right = got.select(F.count(F.lit(1)), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert n > 100 and right / n > 0.97
    assert got.where("score not between 0 and 1").count() == 0
    labelled = odd_docs.withColumn("lang", F.when(F.col("source") == "s0", "xx").when(F.col("source") == "s1", "yy"))
    rows = language_id.predict_languages(labelled).collect()
    assert len(rows) == len(odd_rows) and {r.lang_pred for r in rows} <= {"xx", "yy", "und"}
    assert {r.lang_pred for r in rows if r.doc_id in (60, 61, 62)} == {"und"}
    unlabelled = language_id.predict_languages(odd_docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in unlabelled.collect()} == {"und"}
    assert language_id.predict_languages(no_docs.withColumn("lang", F.lit("xx"))).count() == 0


def test_languages_of_one_rare_script_differ(monkeypatch):
    rng = random.Random(8)
    script = lambda a, n: [chr(c) for c in range(a, a + n)]
    letters = {"en": script(0x61, 26), "ru": script(0x430, 32), "el": script(0x3B1, 17), "zh": script(0x4E00, 200)}
    letters |= {"he": script(0x5D0, 13), "yi": script(0x5DD, 13), "ja": script(0x4E00 + 200, 200)}

    def text(lang):
        n = 40 if lang in ("he", "yi") else 300
        return " ".join("".join(rng.choices(letters[lang], k=4)) for _ in range(n))

    for codes in (1 << 20, 1):
        monkeypatch.setattr(language_id, "TABLE_CODES", codes, raising=False)
        rows = [(text(lang), lang) for _ in range(12) for lang in letters]
        model = language_id.fit([t for t, _ in rows], [lang for _, lang in rows])
        fresh = [(text(lang), lang) for _ in range(5) for lang in letters]
        for step in (1, len(fresh)):
            for a in range(0, len(fresh), step):
                best = model.scores(*language_id._flat([t for t, _ in fresh[a : a + step]])).argmax(axis=1)
                assert [model.languages[j] for j in best] == [lang for _, lang in fresh[a : a + step]]


def talk_rows(spark, data):
    return spark.createDataFrame(data, "conv_id long, turn long, role string, text string, prompt string, span string, reply int")


def test_preferences(spark):
    data = [
        (1, 0, "user", "hi", "x"), (1, 1, "assistant", "hello", "x"), (1, 2, "user", "more", "x"), (1, 3, "assistant", "sure", "x"),
        (2, 0, "user", "hi", "x"), (2, 1, "assistant", "go", "x"), (2, 1, "assistant", "go", "x"), (2, 2, "user", "bye", "x"),
        (3, 0, "user", None, "x"), (4, 0, None, "odd", "x"), (4, 1, "assistant", "", None), (70, 0, "assistant", "alone", "x"),
        (10**15, 0, "user", "far", None), (10**15, None, "assistant", "early", None), (None, 0, "user", "who", None), (None, 1, "assistant", "none", None),
    ]
    talks = talk_rows(spark, [(*r, "s", 1) for r in data])
    got = {r.conv_id: r for r in preferences.format_preferences(preferences.borrowed_replies(talks)).collect()}
    assert set(got) == {1, 2, 4, 70, 10**15, None}
    one = got[1]
    assert one.prompt == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhello<|im_end|>\n<|im_start|>user\nmore<|im_end|>\n"
    assert one.chosen_completion == "<|im_start|>assistant\nsure<|im_end|>\n" and one.rejected_completion == "<|im_start|>assistant\ngo<|im_end|>\n"
    assert one.chosen_mask == "22,15" and sum(map(int, one.rejected_mask.split(","))) == len(one.rejected_completion)
    # What follows the last reply is in neither completion.
    assert got[2].n_prompt_turns == 1 and got[2].chosen_completion == "<|im_start|>assistant\ngo<|im_end|>\n"
    reply = lambda k: got[k].rejected_completion.removeprefix("<|im_start|>assistant\n").removesuffix("<|im_end|>\n")
    assert {k: reply(k) for k in got} == {None: "sure", 1: "go", 2: "", 4: "alone", 70: "early", 10**15: "none"}
    same = spark.createDataFrame([(9, [("user", "a")], [("user", "a")])], "conv_id long, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>")
    r = preferences.format_preferences(same).first()
    assert (r.n_prompt_turns, r.chosen_completion, r.rejected_completion, r.chosen_mask) == (1, "", "", "")
    for few in (talks.where("false"), talks.where("conv_id = 1"), talks.where("conv_id = 3")):
        assert preferences.format_preferences(preferences.borrowed_replies(few)).count() == 0


def test_every_answered_conversation_has_a_pair(spark):
    """Dense, wide, hashed and shared ids; the next reply by brute force."""
    rng = random.Random(3)
    for ids in (range(300), range(0, 64 * 300, 64), [rng.randrange(-2**62, 2**62) for _ in range(300)], [5] * 200 + list(range(40))):
        data = [(i, t, rng.choice(["user", "assistant", None]), f"t{rng.randrange(50)}", None, "s", 1) for i in ids for t in range(rng.randrange(1, 5))]
        last = {}
        for i, t, role, text, *_ in sorted((r for r in data if r[2] == "assistant"), key=lambda r: (r[0], r[1], r[3])):
            last[i] = text
        order = sorted(last)
        expected = {i: last[order[(n + 1) % len(order)]] for n, i in enumerate(order)}
        got = preferences.borrowed_replies(talk_rows(spark, data)).collect()
        assert len(got) == len(expected) > 20
        assert {r.conv_id: r.rejected[-1].text for r in got} == expected
        assert all(r.chosen[-1].text == last[r.conv_id] and r.chosen[:-1] == r.rejected[:-1] for r in got)


def test_id_range(spark):
    for cuts in ([], [3], [3, 8], [3, 8, 9, 12, 40], list(range(0, 200, 7))):
        got = spark.createDataFrame([(i,) for i in [*range(-2, 210), None]], "i long").select("i", preferences.id_range(F.col("i"), cuts).alias("n")).collect()
        assert all(r.n == sum(r.i is not None and c < r.i for c in cuts) for r in got)

import random

import pytest

VOCABULARY = [a + b for a in ("ba", "co", "di", "fu", "the", "und") for b in ("", "ra", "sel", "ton", "que", "vix", "lo")]


def prose(rng, n):
    out = []
    for i in range(n):
        w = rng.choice(VOCABULARY)
        out.append(w + ("." if rng.random() < 0.1 else "") + ("\n" if rng.random() < 0.05 else " "))
    return "".join(out).strip()


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text, source): prose with copies, near copies, shared passages,
    nulls in every column, empty and blank texts, repeated rows, text without
    white space, other scripts and one long text."""
    rng = random.Random(7)
    passage = prose(rng, 60)
    texts = [prose(rng, rng.choice([3, 12, 40, 90, 160])) for _ in range(30)]
    rows = [(i, t, f"s{i % 4}") for i, t in enumerate(texts)]
    rows += [(40, texts[3], "s0"), (41, texts[4], "s0"), (42, texts[4], None)]
    for i in range(43, 49):
        w = max(texts, key=len).split(" ")
        w[i % len(w)] = "changed"
        rows.append((i, " ".join(w), "s0"))
    rows += [(50 + i, prose(rng, 30) + " " + passage + " " + prose(rng, 20), "s1") for i in range(6)]
    rows += [(60, "", "s1"), (61, None, "s2"), (62, " \n\t \r\n", "s2"), (63, "x" * 5000, None), (64, "ab" * 700, "s3")]
    rows += [(65, "日本語 の テキスト。\nÉcole naïve œuvre ß — ünïcode, don't!  two  spaces\n\n", "s3"), (66, "A B C", "ß"), (67, "a b c", "é")]
    rows += [(70, prose(rng, 6000), "s2"), (None, prose(rng, 50), "s0"), (None, None, None)]
    rows += [rows[5], rows[5], (7, "another text under a used id " + passage, "s3")]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """The rows as a table with columns that clash with the operators' own."""
    from liftlake.llm.queries import code_path

    code_path(spark)
    schema = "doc_id long, text string, source string, th string, did string, `row` int, size int, key string, range int, spans string, n_words int"
    data = [(*r, "th", None, 1, 2, "k", 3, None, 4) for r in odd_rows]
    return spark.createDataFrame(data, schema).repartition(5)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")

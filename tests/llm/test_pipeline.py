import zlib

from pyspark.sql import functions as F

from liftlake.llm.tokens import TextIds, tokenizer_path

from . import brute


def test_pipeline_equals_brute_force(spark, tmp_path):
    import corpus_pipeline
    from liftlake.llm.quality_rules import verdicts

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    folder = str(tmp_path / "sf")
    docs.where("doc_id % 3 <> 1").write.parquet(f"{folder}/documents.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")

    # The rules' verdicts have their own test; the rest is done plainly.
    rows = [(r["row"].doc_id, r["row"].text, r["row"].source) for r in verdicts(docs).where("kept").collect()]
    assert 0 < len(rows) < docs.count()
    comp = brute.components({d: brute.shingles(t) for d, t, _ in rows})
    rows = [r for r in rows if comp[r[0]] == r[0]]
    cut = brute.byte_dedup([(d, t) for d, t, _ in rows])
    rows = [(d, cut[d, t][3].decode("utf-8", "ignore"), s) for d, t, s in rows]
    letters = lambda t: sum(c.isascii() and c.isalpha() or "À" <= c <= "ÿ" for c in t)
    taken = brute.mix(rows, lambda t: max(0.01, letters(t) / max(1, len(t))))
    encode = TextIds(tokenizer_path("word_bpe_49k.json"))
    want = []
    for d, t, _ in rows:
        n = len(brute.words(t))
        ids = encode.whole(t) + (1).to_bytes(4, "little")
        for _ in range(taken[d, t] // n if n else 0):
            want += [(d, a // 4, zlib.crc32(ids[a : a + 8192])) for a in range(0, len(ids), 8192)]
    got = corpus_pipeline.run(spark, folder)
    assert sorted((r.doc_id, r.start, r.ids_crc32) for r in got.select("doc_id", "start", "ids_crc32").collect()) == sorted(want)
    filled = got.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("m"))
    assert filled.where("n <> m or n > 2048").count() == 0

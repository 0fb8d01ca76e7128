"""Mixing sources to target weights (op 6) by Efraimidis-Spirakis sampling.

Sources by code point, null last, weigh 1, 2, 3, 1, 2, 3, ... and share the
words of the corpus; a source's target stops at three times its words, and the
excess goes to the others by weight. A source takes as many complete epochs of
its documents as fit; the rest of its target is filled in the order of the
exponential keys ``-ln(u) / quality`` (a weighted sample without replacement),
up to the document that brings the words nearest to it.

The prefix sum over a source is split: keys fall into ordered buckets, bucket
sums give the bucket in which the rest is reached, and only that bucket's rows
are summed one by one. Buckets are parts of the key's logarithm, so whatever the
quality of a source none holds more than 0.3 % of documents of one quality. So a
source that holds a third of all rows is not sorted in one task, and a document
is decided by comparing it with its source's one cut-off row.

Defined results: null texts have size 0 and take 0; null sources are one
source; ``u`` depends on the id alone (null ids share one) and ties fall by id,
then text hash, so reruns agree and equal rows are taken together; an empty
table gives no rows; other columns are untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import NULL_ID, documents, stored
from .quality_rules import BLANK

MAX_EPOCHS = 3
WEIGHT_CYCLE = 3
# Buckets to each doubling of the key.
KEY_BUCKETS = 128
SEED = "mix"


def quality_weight(text: Column) -> Column:
    """Letters of any script as a share of all characters, at least 0.01."""
    body = F.coalesce(text, F.lit(""))
    letters = F.length(F.regexp_replace(body, r"[^\p{L}]+", ""))
    return F.greatest(F.lit(0.01), letters / F.greatest(F.length(body), F.lit(1)))


def uniform(doc_id: Column) -> Column:
    """A fixed number in (0, 1) for each id."""
    digest = F.md5(F.concat(F.lit(f"{SEED}-"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def order_columns(quality: Column) -> dict[str, Column]:
    """Size and place in the sampling order of each document."""
    key = -F.log(uniform(F.col("doc_id"))) / quality
    return {
        "size": F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), BLANK), "")).cast("long"),
        "spot": F.struct(
            F.floor(F.log2(key) * KEY_BUCKETS).cast("int").alias("bucket"),
            key.alias("key"),
            F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("did"),
            F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"),
        ),
    }


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row for
    each source: water filling under the caps, sources in order of cap by
    weight."""
    by_name = W.orderBy(F.col("source").isNull(), F.col("source"))
    weighed = sizes.withColumn("weight", (F.row_number().over(by_name) - 1) % WEIGHT_CYCLE + 1).withColumn("cap", MAX_EPOCHS * F.col("source_size"))
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before, after, everything = by_ratio.rowsBetween(W.unboundedPreceding, -1), by_ratio.rowsBetween(0, W.unboundedFollowing), W.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after)
    filled = weighed.withColumns({"level": level, "place": F.row_number().over(by_ratio)})
    open_place = F.when(F.col("cap") / F.col("weight") >= F.col("level"), F.struct("place", "level"))
    filled = filled.withColumn("first_open", F.min(open_place).over(everything))
    share = F.col("first_open.level") * F.col("weight")
    return filled.select(
        "source", "source_size",
        F.when(F.col("first_open").isNull() | (F.col("place") < F.col("first_open.place")), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), share)).alias("target"),
    )


def plan(ordered: DataFrame) -> DataFrame:
    """(source, source_size, target, epochs, cut): a document is taken
    ``epochs`` times, and once more if its spot is at most ``cut``. ``ordered``
    has (source, size, spot)."""
    sizes = ordered.groupBy("source").agg(F.sum("size").alias("source_size"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    goals = stored(targets(sizes).withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")))
    buckets = ordered.groupBy("source", F.col("spot.bucket").alias("bucket")).agg(F.sum("size").alias("words"))
    running = W.partitionBy("source").orderBy("bucket")
    reached = (
        buckets.withColumn("before", F.sum("words").over(running) - F.col("words"))
        .join(goals.select(F.col("source").alias("s"), "rest"), F.col("source").eqNullSafe(F.col("s")))
        .where("before < rest and before + words >= rest")
        .select(F.col("source").alias("s"), F.col("bucket").alias("at"), "before", "rest")
    )
    inside = ordered.join(reached, F.col("source").eqNullSafe(F.col("s")) & (F.col("spot.bucket") == F.col("at")))
    total = F.col("before") + F.sum("size").over(W.partitionBy("source").orderBy("spot").rowsBetween(W.unboundedPreceding, 0))
    cuts = inside.withColumn("total", total).groupBy(F.col("source").alias("s")).agg(
        F.max(F.when(F.col("total") - F.col("size") / 2 <= F.col("rest"), F.col("spot"))).alias("cut"),
        F.min(F.struct(F.col("at").alias("bucket"), F.lit(-1.0).alias("key"), F.lit(0).cast("long").alias("did"), F.lit(0).cast("long").alias("th"))).alias("floor"),
    )
    return goals.join(cuts, F.col("source").eqNullSafe(F.col("s")), "left").select(
        "source", "source_size", "target", "epochs", F.coalesce("cut", "floor").alias("cut")
    )


def _decided(rows: DataFrame, goals: DataFrame, *keep: Column | str) -> DataFrame:
    """``keep`` and (size, source_size, target, copies) for rows (__source,
    size, spot). The plan has one row for each source; its join is left to
    Spark, which broadcasts it while its measured size allows."""
    copies = F.col("epochs") + F.when(F.col("spot") <= F.col("cut"), 1).otherwise(0)
    joined = rows.join(goals.withColumnRenamed("source", "__s"), F.col("__source").eqNullSafe(F.col("__s")))
    return joined.select(*keep, "size", "source_size", "target", copies.alias("copies"))


def mixed(docs: DataFrame, quality: Column | None = None) -> DataFrame:
    """(row, size, source_size, target, copies) for each document; ``row`` is
    the input. Texts are read twice, as only their sizes are stored."""
    order = order_columns(quality_weight(F.col("text")) if quality is None else quality)
    narrow = stored(docs.select("source", *[c.alias(n) for n, c in order.items()]))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("source").alias("__source"), *[c.alias(n) for n, c in order.items()])
    return _decided(rows, stored(plan(narrow)), "row")


def mixed_ids(docs: DataFrame, quality: Column | None = None) -> DataFrame:
    """``mixed`` with doc_id in place of the row: what is stored for the plan
    suffices, so texts are read once."""
    order = order_columns(quality_weight(F.col("text")) if quality is None else quality)
    narrow = stored(docs.select("doc_id", "source", *[c.alias(n) for n, c in order.items()]))
    return _decided(narrow.withColumnRenamed("source", "__source"), stored(plan(narrow)), "doc_id")


def mix_documents(docs: DataFrame, quality: Column | None = None) -> DataFrame:
    """The mix itself: each document as often as it is taken."""
    taken = mixed(docs, quality).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return taken.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op6(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "source")
    return mixed_ids(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    -ln((CAST(('0x' || substr(md5('mix-' || CAST(doc_id AS VARCHAR)), 1, 12)) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE)
    / greatest(0.01::DOUBLE, length(regexp_replace(coalesce(text, ''), '[^\p{L}]+', '', 'g'))::DOUBLE / greatest(length(coalesce(text, '')), 1)) AS k
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
o AS (SELECT *, 3 * source_size AS cap, row_number() OVER (ORDER BY 3 * source_size / w, source NULLS LAST) AS p, sum(source_size) OVER () AS t FROM s),
l AS (
  SELECT *, (t - coalesce(sum(cap) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
v AS (SELECT arg_min(level, p) AS level, min(p) AS p FROM l WHERE cap / w >= level),
g AS (
  SELECT source, source_size, CASE WHEN v.p IS NULL OR l.p < v.p THEN cap::DOUBLE ELSE least(cap::DOUBLE, v.level * w) END AS target
  FROM l LEFT JOIN v ON true),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM g),
r AS (
  SELECT doc_id, size, source_size, target, epochs,
    sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id ROWS UNBOUNDED PRECEDING) AS total, target - epochs * source_size AS rest
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, CAST(size * (epochs + CASE WHEN total - size / 2 <= rest AND rest > 0 THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
"""

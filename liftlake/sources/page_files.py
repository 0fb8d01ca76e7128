"""Landed page files as a source (A1-A5).

A page is one JSON object ``{"page": n, "page_count": N, "<entity>": [...]}``,
one to a line (JSON Lines) or one to a file (``multi_line``). Reading gives one
row a page with its provenance (file, when it landed) and what is wrong with
it; ``page_items`` are the items of the pages that count and ``page_report``
the pages that do not, or look odd:

* ``unreadable``: no JSON object (a download that broke off); no items.
* ``no item list``: the entity's key is missing, null or no list; no items.
* ``no page number``: absent, not a whole number or below 1; no items.
* ``repeated``: another copy of the same page counts, the one that landed last
  (then: last by file name, then by content).
* ``short``: not the last page, but fewer items than a page holds; counts.
* ``past the end``: its number is above its own page count; counts.
* ``missing``: a number up to the greatest page count without a page that counts.

Blank lines are nothing. An empty item list is a page without items ('short'
unless it is the last). Items are kept as raw JSON text, so that the validator
can tell a missing key from an explicit null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Page body key and page size per entity.
PAGE_KEYS = {
    "workouts": ("workouts", 10),
    "routines": ("routines", 10),
    "exercise_templates": ("exercise_templates", 100),
    "routine_folders": ("routine_folders", 10),
    "events": ("events", 20),
}
# Page numbers that one task goes through when it looks for missing ones.
NUMBERS_A_TASK = 100_000
# As many numbers of repeated pages are handed to all tasks; more are shuffled.
HANDED_OUT = 1_000_000

_BROKEN = ("unreadable", "no item list", "no page number")


def parsed(body: Column, entity: str) -> Column:
    """Struct (page, page_count, items, bad) of a page's text."""
    key, _ = PAGE_KEYS[entity]
    schema = f"page string, page_count string, {key} array<string>, _bad string"
    p = F.from_json(body, schema, {"columnNameOfCorruptRecord": "_bad"})
    whole = lambda c: F.when(c.rlike(r"^\d{1,18}$"), c.cast("long"))
    # The parser keeps what it read before a text broke off; only a text with
    # something wrong is parsed once more to tell that from a value of another kind.
    broke_off = F.when(p["_bad"].isNotNull(), F.try_parse_json(body).isNull()).otherwise(F.lit(False))
    bad = p.isNull() | broke_off
    return F.struct(
        whole(p["page"]).alias("page"), whole(p["page_count"]).alias("page_count"), F.when(~bad, p[key]).alias("items"), bad.alias("bad"),
    )


def read_pages(spark: SparkSession, path: str, entity: str, multi_line: bool = False) -> DataFrame:
    """(file, landed_at, page, page_count, n_items, items, problem, raw) for
    each page text below ``path``; ``raw`` is the text of a broken page, else
    null. A broken page has the number that its text starts with, if any."""
    text = spark.read.text(path, wholetext=multi_line, recursiveFileLookup=True).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("landed_at")
    )
    return with_problems(text.where(F.col("value").rlike(r"[^ \r\n]")), entity)


def with_problems(text: DataFrame, entity: str) -> DataFrame:
    """Page texts (value, file, landed_at) as described for ``read_pages``."""
    p = F.col("p")
    problem = (
        F.when(p["bad"], "unreadable")
        .when(p["items"].isNull(), "no item list")
        .when(p["page"].isNull() | (p["page"] < 1), "no page number")
    )
    stated = F.regexp_extract("value", r'^\s*\{\s*"page"\s*:\s*(\d{1,18})\b', 1)
    rows = text.withColumn("p", parsed(F.col("value"), entity)).withColumn("problem", problem)
    return rows.select(
        "file", "landed_at",
        F.when(F.col("problem") == "unreadable", F.nullif(stated, F.lit("")).cast("long")).otherwise(p["page"]).alias("page"),
        F.when(~p["bad"], p["page_count"]).alias("page_count"), F.when(p["items"].isNotNull(), F.size(p["items"])).alias("n_items"), p["items"].alias("items"), "problem",
        F.when(F.col("problem").isNotNull(), F.col("value")).alias("raw"),
    )


def _repeated(good: DataFrame) -> DataFrame:
    """(page): numbers that occur more than once. They are counted first, from
    the page numbers alone: as long as they are few, all tasks get them and no
    page text is shuffled to find out whether it is alone."""
    several = good.groupBy("page").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("page")
    return F.broadcast(several) if several.limit(HANDED_OUT + 1).count() <= HANDED_OUT else several


def _copies(pages: DataFrame, several: DataFrame | None = None) -> DataFrame:
    """Readable pages whose number occurs more than once, best copy first as
    ``copy`` 1. Only these are shuffled."""
    good = pages.where("problem IS NULL")
    order = Window.partitionBy("page").orderBy(F.desc("landed_at"), F.desc("file"), F.desc(F.xxhash64("items")))
    return good.join(_repeated(good) if several is None else several, "page", "left_semi").withColumn("copy", F.row_number().over(order))


def counting_pages(pages: DataFrame, several: DataFrame | None = None) -> DataFrame:
    """One copy of every readable page."""
    good = pages.where("problem IS NULL")
    several = _repeated(good) if several is None else several
    alone = good.join(several, "page", "left_anti")
    return alone.select(pages.columns).unionByName(_copies(pages, several).where("copy = 1").select(pages.columns))


def page_items(pages: DataFrame) -> DataFrame:
    """(page, item) of the pages that count, items as raw JSON text."""
    return counting_pages(pages).select("page", F.explode("items").alias("item"))


def item_provenance(pages: DataFrame) -> DataFrame:
    """(page, position, item, file, landed_at): where each item came from."""
    return counting_pages(pages).select("page", F.posexplode("items").alias("position", "item"), "file", "landed_at")


def page_report(pages: DataFrame, entity: str) -> DataFrame:
    """(entity, problem, page, page_count, n_items, file, kept) for each page
    that does not count or looks odd; ``kept`` tells whether its items count."""
    _, size = PAGE_KEYS[entity]
    row = lambda df, problem, kept: df.select(
        F.lit(entity).alias("entity"), problem.alias("problem"), F.col("page"), F.col("page_count"), F.col("n_items"), F.col("file"), F.lit(kept).alias("kept")
    )
    broken = row(pages.where(F.col("problem").isin(*_BROKEN)), F.col("problem"), False)
    several = _repeated(pages.where("problem IS NULL"))
    again = row(_copies(pages, several).where("copy > 1"), F.lit("repeated"), False)
    counting = counting_pages(pages.drop("items", "raw").withColumn("items", F.lit(None).cast("array<string>")), several)
    # 'repeated' copies are told apart by content where times and names agree, which does not change what follows.
    short = row(counting.where((F.col("n_items") < size) & (F.col("page") < F.col("page_count"))), F.lit("short"), True)
    past = row(counting.where("page > page_count"), F.lit("past the end"), True)
    empty = [F.lit(None).cast(t).alias(c) for c, t in (("page_count", "long"), ("n_items", "int"), ("file", "string"))]
    missing = row(missing_pages(pages).select("page", *empty), F.lit("missing"), False)
    return broken.unionByName(again).unionByName(short).unionByName(past).unionByName(missing)


def missing_pages(pages: DataFrame) -> DataFrame:
    """(page): numbers up to the greatest page count that no readable page has.
    The numbers are made by ranges of ``NUMBERS_A_TASK``, one task each."""
    good = pages.where("problem IS NULL").select("page", "page_count")
    last = good.agg(F.coalesce(F.max("page_count"), F.lit(0)).alias("last"))
    step = F.lit(NUMBERS_A_TASK)
    first = last.select("last", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("last") / step))).alias("range"))
    ranges = first.repartition("range").where(F.col("range") * step < F.col("last"))
    numbers = ranges.select(F.explode(F.sequence(F.col("range") * step + 1, F.least((F.col("range") + 1) * step, F.col("last")))).alias("page"))
    return numbers.join(good.select("page").distinct(), "page", "left_anti")

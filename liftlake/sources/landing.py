"""Pages of the training-log service as they land: documents nested from the
driver tables, put into pages and written as text files.

``landed_*`` build the pages (documents nested with ``collect_list(struct)``
over bounded groups: sets of one exercise, exercises of one workout, items of
one page), with a deterministic share of broken documents. ``write_pages``
lands them as files, with a share of broken and repeated pages on top, so that
the chain files -> pages -> validate -> flatten runs over data that grows with
the input. ``page_files`` reads them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from liftlake.session import by_shuffle
from liftlake.sources import fixtures as fx
from liftlake.sources.page_files import PAGE_KEYS, parsed

# Entities that land pretty-printed, one page to a file.
MULTI_LINE = ("routine_folders",)
# Of JSON Lines: page texts are several times as long as what they say.
COMPRESSION = "lz4"
# Orders and lines that one task nests: it sorts and gathers them, at some 500 bytes a row.
ROWS_A_TASK = 250_000


def parse_pages(pages: DataFrame, entity: str, body_col: str = "body") -> DataFrame:
    """(page, item) of page texts taken as they are (the event stream, where a
    batch knows nothing of other copies of its pages)."""
    p = pages.select(parsed(F.col(body_col), entity).alias("p"))
    return p.select(F.col("p.page").alias("page"), F.explode(F.col("p.items")).alias("item"))


def _page_of(key: Column, entity: str) -> Column:
    return F.floor(key / PAGE_KEYS[entity][1]).cast("long")


def _paged(items: DataFrame, entity: str, order_key: str, keys: DataFrame | None = None) -> DataFrame:
    """(page, body): item texts in pages of the entity's size (bounded groups).
    Items with a ``_page`` lie together by it already. ``keys`` holds the keys
    of all items as ``order_key``, where they are cheaper to read than the items."""
    key, _ = PAGE_KEYS[entity]
    page = _page_of(F.col(order_key), entity)
    paged = items if "_page" in items.columns else items.withColumn("_page", page)
    pages = paged.groupBy("_page").agg(F.array_sort(F.collect_list(F.struct(order_key, "item"))).alias("_it"))
    n = (pages if keys is None else keys.select(page.alias("_page"))).agg(F.max("_page")).scalar()
    br = "\n  " if entity in MULTI_LINE else ""
    end = br[:1]
    body = F.concat(F.lit(f'{{{br}"page":'), (F.col("_page") + 1).cast("string"), F.lit(f',{br}"page_count":'),
                    (n + 1).cast("string"), F.lit(f',{br}"{key}":[{br}'),
                    F.array_join(F.transform("_it", lambda x: x["item"]), f",{br}"), F.lit(f"{end}]{end}}}"))
    return pages.select((F.col("_page") + 1).alias("page"), body.alias("body"))


_NULLS = {"ignoreNullFields": "false"}


def _iso(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _tasks(rows: DataFrame) -> int:
    """The session's shuffle partitions, or as many more as keep a task's rows
    within ``ROWS_A_TASK``, so that it need not spill however large the input."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-rows.count() // ROWS_A_TASK))


def workout_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, item) workout documents (sets of untyped lines are typed
    'failure' in the documents); corruptions by order key:
    % 29 -> the first set of the first exercise has no type (invalid when the
    workout has a set); % 31 -> explicit ``"exercises": null`` (invalid);
    % 37 -> reps written as strings (valid after coercion); % 41 -> first
    exercise index 1.5 (invalid when the workout has an exercise).

    Orders and lines meet by page in one shuffle of their own few columns;
    numbering sets, nesting and putting into pages all happen where they lie, in
    as many tasks as the rows need. An order that stands there twice has the
    exercises of both."""
    line = F.struct(F.expr(fx.EXERCISE_INDEX).alias("exercise_index"), *fx.LINE_COLS[1:])
    lines = fx.read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), line.alias("l"))
    head = F.struct("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    orders = fx.read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), head.alias("h"))
    both = lines.unionByName(orders, allowMissingColumns=True).where("key IS NOT NULL").withColumn("_page", _page_of(F.col("key"), "workouts"))
    rows = both.repartition(_tasks(both), "_page").select("_page", "key", "h", "l.*", F.col("l").isNotNull().alias("_line"))
    rows = rows.withColumn("set_index", fx.set_index("_page", "key", "_line", "exercise_index"))
    s = rows.selectExpr("_page", "key", "h", "_line", "exercise_index", "set_index", *fx.SET_COLS)
    set_struct = F.struct(
        F.col("set_index").alias("index"), F.coalesce(F.col("set_type"), F.lit("failure")).alias("type"),
        "weight_kg", "reps", F.lit(None).cast("struct<start:double,end:double>").alias("rep_range"),
        "distance_meters", "duration_seconds", "rpe", "custom_metric")
    of_key = s.groupBy("_page", "key").agg(
        F.collect_list(F.when(F.col("_line"), F.struct("exercise_index", set_struct.alias("s")))).alias("lines"), F.collect_list("h").alias("heads"))
    t = of_key.where(F.size("heads") > 0).withColumn("n_templates", fx.n_templates(spark, sf_dir))

    def exercise(i: Column, h: Column) -> Column:
        own = F.array_sort(F.transform(F.filter("lines", lambda x: x["exercise_index"] == i), lambda x: x["s"]))
        values = {
            "index": i, "title": F.concat(F.lit("E-"), i.cast("string")), "notes": F.lit(None).cast("string"), "rest_seconds": F.lit(None).cast("int"),
            "exercise_template_id": ((h["o_custkey"] * 4 + i) % F.col("n_templates")).cast("string"),
            "superset_id": F.when((i < 2) & (h["o_custkey"] % 4 == 0), F.lit(1)), "sets": own,
        }
        return F.named_struct(*[x for name, value in values.items() for x in (F.lit(name), value)])

    indexes = F.array_distinct(F.transform("lines", lambda x: x["exercise_index"]))
    listed = F.array_sort(F.flatten(F.transform("heads", lambda h: F.transform(indexes, lambda i: exercise(i, h)))))
    d = t.select("_page", "key", listed.alias("exercises"), F.explode("heads").alias("h")).select("_page", "key", "exercises", "h.*").selectExpr(
        "_page", "key", "exercises", *fx.WORKOUT_COLS)
    k, exercises = F.col("key"), F.col("exercises")
    first_set_untyped = F.transform(exercises, lambda e, i: e.withField(
        "sets", F.transform(e["sets"], lambda s, j: F.when((i == 0) & (j == 0), s.withField("type", F.lit(None).cast("string"))).otherwise(s))))
    exercises = F.when(k % 29 == 0, first_set_untyped).otherwise(exercises)
    exercises = F.when(k % 31 == 0, F.lit(None)).otherwise(exercises)
    doc = F.struct(F.col("workout_id").alias("id"), "title", "description", _iso(F.col("start_time")).alias("start_time"),
                   _iso(F.col("end_time")).alias("end_time"), _iso(F.col("updated_at")).alias("updated_at"),
                   _iso(F.col("created_at")).alias("created_at"), "routine_id", exercises.alias("exercises"))
    item = F.to_json(doc, _NULLS)
    item = F.when(k % 37 == 0, F.regexp_replace(item, r'"reps":(\d+)', '"reps":"$1"')).otherwise(item)
    item = F.when(k % 41 == 0, F.regexp_replace(item, r'^(.*?"exercises":\[\{"index":)\d+', "$11.5")).otherwise(item)
    return d.select("_page", k.alias("key"), item.alias("item"))


def landed_workout_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = fx.read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"))
    return _paged(workout_documents(spark, sf_dir), "workouts", "key", keys)


def routine_documents(spark: SparkSession, sf_dir: str, ver: int = 1) -> DataFrame:
    """Routine documents of one snapshot; corruptions by customer key: % 29
    -> first set without type, % 31 -> explicit null exercises."""
    p = fx.plan_rows(spark, sf_dir, versions=(ver,))
    set_struct = F.struct(
        F.col("set_index").alias("index"), F.col("set_type").alias("type"), "weight_kg", "reps",
        F.when(F.col("rep_range_start").isNotNull() | F.col("rep_range_end").isNotNull(),
               F.struct(F.col("rep_range_start").alias("start"), F.col("rep_range_end").alias("end"))).alias("rep_range"),
        "distance_meters", "duration_seconds", "rpe", "custom_metric")
    per_ex = (p.groupBy("routine_id", "exercise_index", "exercise_title", "exercise_notes", "rest_seconds",
                        "exercise_template_id", "superset_id")
              .agg(F.array_sort(F.collect_list(set_struct)).alias("sets")))
    exs = per_ex.select("routine_id", F.struct(
        F.col("exercise_index").alias("index"), F.col("exercise_title").alias("title"),
        F.col("exercise_notes").alias("notes"), "rest_seconds", "exercise_template_id", "superset_id", "sets").alias("e"))
    per_r = exs.groupBy("routine_id").agg(F.array_sort(F.collect_list("e")).alias("exercises"))
    h = fx.routines(spark, sf_dir, ver)
    d = h.join(by_shuffle(per_r), "routine_id", "left")
    k = F.col("routine_id").cast("long")
    exercises = F.coalesce(F.col("exercises"), F.array().cast(per_r.schema["exercises"].dataType))
    untyped = F.transform(exercises, lambda e, i: e.withField(
        "sets", F.transform(e["sets"], lambda s, j: F.when((i == 0) & (j == 0), s.withField("type", F.lit(None).cast("string"))).otherwise(s))))
    exercises = F.when(k % 29 == 0, untyped).otherwise(exercises)
    exercises = F.when(k % 31 == 0, F.lit(None)).otherwise(exercises)
    doc = F.struct(F.col("routine_id").alias("id"), "title", "folder_id", _iso(F.col("updated_at")).alias("updated_at"),
                   _iso(F.col("created_at")).alias("created_at"), exercises.alias("exercises"))
    return d.select(k.alias("key"), F.to_json(doc, _NULLS).alias("item"))


def landed_routine_pages(spark: SparkSession, sf_dir: str, ver: int = 1) -> DataFrame:
    return _paged(routine_documents(spark, sf_dir, ver), "routines", "key")


def template_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exercise templates; by part key: % 29 -> no title (invalid), % 31 ->
    explicit null muscle list (invalid), % 37 -> muscle list absent
    (defaults to []), % 43 -> the title is a number (invalid)."""
    p = fx.read_table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    doc = F.struct(
        F.col("p_partkey").cast("string").alias("id"),
        F.when(k % 29 == 0, F.lit(None)).otherwise(F.col("p_name")).alias("title"),
        F.when(F.col("p_size") % 9 == 0, F.lit(None).cast("string")).otherwise(F.col("p_type")).alias("type"),
        F.when(F.col("p_size") % 10 == 0, F.lit(None).cast("string")).otherwise(F.col("p_brand"))
        .alias("primary_muscle_group"),
        F.when(k % 31 == 0, F.lit(None)).otherwise(fx.secondary_muscles_array()).alias("secondary_muscle_groups"),
        (F.col("p_size") > 40).alias("is_custom"))
    item = F.to_json(doc, _NULLS)
    item = F.when(k % 37 == 0, F.regexp_replace(item, r',"secondary_muscle_groups":\[[^\]]*\]', "")).otherwise(item)
    item = F.when(k % 43 == 0, F.regexp_replace(item, r'"title":"(?:[^"\\]|\\.)*"', '"title":43')).otherwise(item)
    return p.select(k.alias("key"), item.alias("item"))


def landed_template_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paged(template_documents(spark, sf_dir), "exercise_templates", "key")


def folder_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routine folders (one per nation); nation key % 7 == 3 -> no index."""
    f = fx.folders(spark, sf_dir)
    k = F.col("id").cast("long")
    doc = F.struct("id", F.when(k % 7 == 3, F.lit(None)).otherwise(F.col("index")).alias("index"), "title",
                   _iso(F.col("updated_at")).alias("updated_at"), _iso(F.col("created_at")).alias("created_at"))
    return f.select(k.alias("key"), F.to_json(doc).alias("item"))


def landed_folder_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paged(folder_documents(spark, sf_dir), "routine_folders", "key")


def event_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Update/delete feed from the ``events`` table: 'purchase' -> an
    'updated' event embedding a one-set workout, 'error' -> a 'deleted'
    event, anything else -> an event of that type without payload; event id
    % 53 == 0 -> no type (invalid)."""
    e = fx.read_table(spark, sf_dir, "events")
    k = F.col("event_id")
    wid = F.concat(F.lit("ev-"), k.cast("string"))
    st = F.struct(F.lit(0).alias("index"), F.lit("normal").alias("type"),
                  (F.round(F.col("value") / 2.5) * 2.5).alias("weight_kg"), (k % 10 + 1).cast("int").alias("reps"))
    ex = F.struct(F.lit(0).alias("index"), F.lit("E-0").alias("title"),
                  (F.col("user_id") % fx.n_templates(spark, sf_dir)).cast("string").alias("exercise_template_id"),
                  F.array(st).alias("sets"))
    workout = F.struct(wid.alias("id"), F.concat(F.lit("W-"), wid).alias("title"),
                       _iso(F.col("ts")).alias("start_time"), _iso(F.col("ts")).alias("updated_at"),
                       F.col("user_id").cast("string").alias("routine_id"), F.array(ex).alias("exercises"))
    typ = (F.when(k % 53 == 0, F.lit(None))
           .when(F.col("event_type") == "purchase", F.lit("updated"))
           .when(F.col("event_type") == "error", F.lit("deleted")).otherwise(F.col("event_type")))
    doc = F.struct(typ.alias("type"),
                   F.when(F.col("event_type") == "purchase", workout).alias("workout"),
                   F.when(F.col("event_type") == "error", wid).alias("id"),
                   F.when(F.col("event_type") == "error", _iso(F.col("ts"))).alias("deleted_at"))
    return e.select(k.alias("key"), F.to_json(doc).alias("item"))


def landed_event_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paged(event_documents(spark, sf_dir), "events", "key")


def with_failed_downloads(pages: DataFrame) -> DataFrame:
    """(page, copy, body): the pages with what a broken connection leaves on
    top; by page number: % 17 == 3 -> a copy that breaks off in the middle,
    % 19 == 5 -> an error body without items, % 23 == 7 -> the page again."""
    page, body = F.col("page"), F.col("body")
    half = body.substr(F.lit(1), (F.length(body) / 2).cast("int"))
    error = F.concat(F.lit('{"page":'), page.cast("string"), F.lit(',"page_count":1,"error":"timeout"}'))
    texts = F.array(body, F.when(page % 17 == 3, half), F.when(page % 19 == 5, error), F.when(page % 23 == 7, body))
    return pages.select("page", F.posexplode(texts).alias("copy", "body")).where("body IS NOT NULL")


def write_pages(pages: DataFrame, path: str, multi_line: bool = False) -> None:
    """Land page texts as files: JSON Lines, or one page to a file."""
    if multi_line:
        name = F.concat_ws("-", *[c for c in ("page", "copy") if c in pages.columns])
        pages.select(name.alias("landed"), F.col("body").alias("value")).write.mode("overwrite").partitionBy("landed").text(path)
    else:
        pages.select(F.col("body").alias("value")).write.mode("overwrite").text(path, compression=COMPRESSION)

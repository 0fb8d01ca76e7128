"""Legacy normalised silver model (I1-I12) and its constraint checks.

Surrogate ids are hashes of the natural keys (no window, no rank, no join).
Constraint checks are
aggregates and anti-joins that return violation rows instead of failing a
write, so a run reports every broken key at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftlake.operators.coach import newest_sets, session_history
from liftlake.session import by_shuffle
from liftlake.sources.enums import enum_dimensions

LEGACY_DEFAULT_STEP = 2.5
PRIORITY_COUNT = 4


def norm_enums(spark) -> dict[str, DataFrame]:
    """The enum tables as loaded."""
    return {f"silver_enums_{k}": v for k, v in enum_dimensions(spark).items()}


def norm_progression(raw: DataFrame) -> DataFrame:
    """Legacy progression table: title -> increment, later lines win, the
    sign of negative steps kept."""
    return raw.groupBy(F.col("exercise_name").alias("exercise_title")).agg(
        F.max_by("progression_step_kg", "line_no").alias("base_increment"))


def norm_folders(folders: DataFrame) -> DataFrame:
    """I2."""
    return folders.select("id", "title", "created_at", "updated_at").distinct()


def norm_templates(templates: DataFrame, progression: DataFrame) -> DataFrame:
    """Distinct template attributes, no equipment, increment by title
    (missing -> 2.5)."""
    t = templates.select("id", "title", "type", "primary_muscle_group", "is_custom").distinct()
    j = t.join(by_shuffle(progression), t.title == progression.exercise_title, "left")
    return j.select("id", "title", "type", "primary_muscle_group", "is_custom",
                    F.lit(None).cast("string").alias("equipment_category"),
                    F.coalesce(F.col("base_increment"), F.lit(LEGACY_DEFAULT_STEP)).alias("base_increment"))


def norm_secondary_muscles(templates: DataFrame) -> DataFrame:
    """I4: muscle list text -> bridge rows; unparseable or non-list text
    yields none."""
    return templates.select(F.col("id").alias("exercise_template_id"),
                            F.explode(F.from_json("secondary_muscle_groups", "array<string>")).alias("muscle_group"))


def norm_routines(routines: DataFrame) -> DataFrame:
    """Distinct routine headers, id renamed."""
    return routines.select(F.col("routine_id").alias("id"), "title", "folder_id", "created_at",
                           "updated_at").distinct()


_EX_KEY = ["exercise_template_id", "superset_id", "rest_seconds", "notes"]


def surrogate_id(key_cols: list[str]) -> Column:
    """A 60-bit id from the MD5 of the natural key: each row makes its own, so
    ids need no order over the table, no shuffle and no join, and a rerun gives
    the same ones. Below a hundred million rows two keys share an id with odds
    of less than 1 in 200; ``check_primary_keys`` reports it if they do."""
    parts = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x1e")) for c in key_cols])
    return F.conv(F.substring(F.md5(parts.cast("binary")), 1, 15), 16, 10).cast("bigint")


def norm_routine_exercises(flat_routines: DataFrame) -> DataFrame:
    """Distinct routine exercises with a surrogate id."""
    d = flat_routines.select("routine_id", "exercise_template_id", F.col("supersets_id").alias("superset_id"),
                             "rest_seconds", F.col("exercise_notes").alias("notes"),
                             F.col("exercise_index").alias("order_index")).distinct()
    return d.withColumn("id", surrogate_id(["routine_id", "order_index", *_EX_KEY]))


_ROUTINE_EX = ["routine_id", "exercise_index", "exercise_template_id", "supersets_id", "rest_seconds", "exercise_notes"]
_WORKOUT_EX = ["workout_id", "exercise_index", "exercise_template_id", "supersets_id", "exercise_notes"]


def norm_routine_sets(flat_routines: DataFrame) -> DataFrame:
    """Plan set rows with the id of their routine exercise, which each flat
    row makes from its own columns."""
    rows = flat_routines.where("routine_id IS NOT NULL AND exercise_index IS NOT NULL")
    return rows.select(surrogate_id(_ROUTINE_EX).alias("routine_exercise_id"), "set_type", "weight_kg", "reps", "rep_range_start",
                       "rep_range_end", "distance_meters", "duration_seconds", "rpe")


def norm_workouts(flat_workouts: DataFrame) -> DataFrame:
    """Distinct workout headers."""
    return flat_workouts.select(F.col("workout_id").alias("id"), "title", "description", "start_time", "end_time",
                                "created_at", "updated_at", "routine_id").distinct()


def norm_workouts_priority(flat_workouts: DataFrame, n: int = PRIORITY_COUNT) -> DataFrame:
    """I8: distinct workout headers; the newest ``n`` (ties by id) flagged
    as priority. The top n is a distributed top-k broadcast back (n rows)."""
    w = norm_workouts(flat_workouts)
    top = (w.select("id", "start_time").orderBy(F.col("start_time").desc_nulls_last(), F.col("id")).limit(n)
           .select(F.col("id").alias("_top")))
    return (w.join(F.broadcast(top), F.col("id") == F.col("_top"), "left")
            .withColumn("is_priority", F.col("_top").isNotNull()).drop("_top"))


def norm_workout_exercises(flat_workouts: DataFrame) -> DataFrame:
    """I9."""
    d = flat_workouts.select("workout_id", "exercise_template_id", F.col("supersets_id").alias("superset_id"),
                             F.col("exercise_notes").alias("notes"),
                             F.col("exercise_index").alias("order_index")).distinct()
    return d.withColumn("id", surrogate_id(["workout_id", "order_index", "exercise_template_id", "superset_id", "notes"]))


def norm_workout_sets(flat_workouts: DataFrame) -> DataFrame:
    """I10, as I7."""
    rows = flat_workouts.where("workout_id IS NOT NULL AND exercise_index IS NOT NULL")
    return rows.select(surrogate_id(_WORKOUT_EX).alias("workout_exercise_id"), "set_type", "weight_kg", "reps", "distance_meters",
                       "duration_seconds", "rpe", "custom_metric")


def flat_history(flat_workouts: DataFrame) -> DataFrame:
    """K9's history by template, from the flat workout log: the newest sessions
    as structs (date, weight, reps, rpe), newest first."""
    sets = flat_workouts.where("set_type = 'normal' AND exercise_template_id IS NOT NULL")
    sessions = session_history(newest_sets(sets))
    one = F.struct("session_no", "date", "weight", "reps", "rpe")
    return sessions.groupBy("exercise_template_id").agg(F.array_sort(F.collect_list(one)).alias("sessions"))


def routine_view(flat_routines: DataFrame, routine_exercises: DataFrame, templates: DataFrame, history: DataFrame) -> DataFrame:
    """K9: routines with their exercises, sets and history. An exercise without
    sets keeps a row. Every side grows with the data, so all joins shuffle."""
    r = flat_routines.select("routine_id", F.col("title").alias("routine_title")).distinct()
    t = templates.select(F.col("id").alias("_tid"), "title", "base_increment")
    s = norm_routine_sets(flat_routines)
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    listed = F.array_join(F.transform("sessions", lambda x: F.concat_ws("|", text(x["date"]), text(x["weight"]), text(x["reps"]), text(x["rpe"]))), ";")
    j = (r.join(by_shuffle(routine_exercises), "routine_id").join(by_shuffle(t), F.col("exercise_template_id") == F.col("_tid"), "left")
         .join(by_shuffle(history), "exercise_template_id", "left").join(by_shuffle(s), F.col("id") == F.col("routine_exercise_id"), "left"))
    return j.select("routine_id", "routine_title", "order_index", F.col("id").alias("routine_exercise_id"), "exercise_template_id",
                    "notes", "rest_seconds", "superset_id", "title", "base_increment", "set_type", "weight_kg",
                    "reps", "rep_range_start", "rep_range_end", F.coalesce(listed, F.lit("")).alias("history"))


def pk_violations(df: DataFrame, table: str, keys: list[str], not_null: list[str] = ()) -> DataFrame:
    """Duplicate or null primary keys and null NOT NULL columns, by one
    aggregation over the table. A table without a key of its own (``keys`` are
    then what names a row) is checked for nulls with ``unique`` left out."""
    return constraint_report(df, table, keys, not_null)


def constraint_report(df: DataFrame, table: str, keys: list[str], not_null: list[str] = (), unique: bool = True) -> DataFrame:
    """(table_name, key, problem, n) for each key and rule with violations."""
    k = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("<null>")) for c in keys])
    null_key = F.lit(False)
    for c in keys:
        null_key = null_key | F.col(c).isNull()
    if not unique:  # rows that break no rule are not grouped
        broken = F.lit(False)
        for c in not_null:
            broken = broken | F.col(c).isNull()
        df = df.where(broken)
    rules = [("null key", F.count_if(null_key))] if unique else []
    rules += [(f"null {c}", F.count_if(F.col(c).isNull())) for c in not_null]
    rows = F.count(F.lit(1))
    rules = [("duplicate key", F.when(rows > 1, rows).otherwise(0))] * unique + rules
    found = F.array(*[F.struct(F.lit(name).alias("problem"), n.cast("bigint").alias("n")) for name, n in rules])
    return df.groupBy(k.alias("key")).agg(found.alias("found")).select(F.lit(table).alias("table_name"), "key", F.inline("found")).where("n > 0")


def fk_violations(children: list[tuple[DataFrame, dict[str, str]]], parents: list[tuple[DataFrame, str, list[str]]]) -> DataFrame:
    """(foreign_key, key, n) of child rows whose (non-null) foreign key has
    no parent row. ``children``: tables with their foreign keys by name and
    column; ``parents``: tables with their key column and the foreign keys that
    refer to it. Each child is read once for all its keys and counted before
    the shuffle; each parent gives its keys once for all that refer to it; one
    anti join settles them all."""
    refs = keys = None
    for df, columns in children:
        pairs = F.array(*[F.struct(F.lit(fk).alias("foreign_key"), F.col(c).cast("string").alias("key")) for fk, c in columns.items()])
        own = df.select(F.inline(pairs)).where("key IS NOT NULL")
        refs = own if refs is None else refs.unionByName(own)
    for df, column, names in parents:
        own = df.select(F.col(column).cast("string").alias("key")).where("key IS NOT NULL").select(
            F.explode(F.array(*map(F.lit, names))).alias("foreign_key"), "key")
        keys = own if keys is None else keys.unionByName(own)
    counted = refs.groupBy("foreign_key", "key").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(keys.distinct(), ["foreign_key", "key"], "left_anti")

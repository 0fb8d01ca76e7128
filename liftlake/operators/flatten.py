"""Flatten validated documents to tables.

Inner flattening uses ``inline`` / ``explode`` (an exercise without sets
yields no set rows); the legacy outer flattening uses ``explode_outer`` so a
workout without exercises, or an exercise without sets, still yields one
row. All of it is narrow: no shuffle, one pass over the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftlake.functions.parsing import python_json_list, utc_ntz

SET_COLS = ["weight_kg", "reps", "distance_meters", "duration_seconds", "rpe", "custom_metric"]


def with_ingestion_timestamp(df: DataFrame, run_ts: Column) -> DataFrame:
    """C17: one ingestion stamp per run (deterministic, not per row)."""
    return df.withColumn("ingestion_timestamp", run_ts)


def _ts(c: str) -> Column:
    return utc_ntz(F.col(c)).alias(c)


# ------------------------------------------------------------ current pipeline
def bronze_workouts(valid: DataFrame, run_ts: Column) -> DataFrame:
    """C1."""
    return valid.select(F.col("id").cast("string").alias("workout_id"), "title", "description",
                        _ts("start_time"), _ts("end_time"), _ts("updated_at"), _ts("created_at"), "routine_id",
                        run_ts.alias("ingestion_timestamp"))


def bronze_workout_exercises(valid: DataFrame, run_ts: Column) -> DataFrame:
    """C2."""
    e = valid.select(F.col("id").cast("string").alias("workout_id"), F.explode("exercises").alias("e"))
    return e.select("workout_id", F.col("e.index").alias("exercise_index"), F.col("e.title").alias("title"),
                    F.col("e.notes").alias("notes"), F.col("e.exercise_template_id").alias("exercise_template_id"),
                    F.col("e.superset_id").alias("superset_id"), run_ts.alias("ingestion_timestamp"))


def bronze_workout_sets(valid: DataFrame, run_ts: Column) -> DataFrame:
    """C3."""
    e = valid.select(F.col("id").cast("string").alias("workout_id"), F.explode("exercises").alias("e"))
    s = e.select("workout_id", F.col("e.index").alias("exercise_index"), F.explode("e.sets").alias("s"))
    return s.select("workout_id", "exercise_index", F.col("s.index").alias("set_index"),
                    F.col("s.type").alias("set_type"), *[F.col(f"s.{c}").alias(c) for c in SET_COLS],
                    run_ts.alias("ingestion_timestamp"))


def bronze_routines(valid: DataFrame, run_ts: Column) -> DataFrame:
    """C4."""
    return valid.select(F.col("id").alias("routine_id"), "title", F.col("folder_id").cast("string").alias("folder_id"),
                        _ts("updated_at"), _ts("created_at"), run_ts.alias("ingestion_timestamp"))


def bronze_routine_details(valid: DataFrame, run_ts: Column) -> DataFrame:
    """Set-grain plan rows; a missing rep range gives null bounds."""
    e = valid.select(F.col("id").alias("routine_id"), F.explode("exercises").alias("e"))
    s = e.select("routine_id", "e", F.explode("e.sets").alias("s"))
    return s.select(
        "routine_id", F.col("e.index").alias("exercise_index"), F.col("e.title").alias("exercise_title"),
        F.col("e.notes").alias("exercise_notes"), F.col("e.rest_seconds").alias("rest_seconds"),
        F.col("e.exercise_template_id").alias("exercise_template_id"), F.col("e.superset_id").alias("superset_id"),
        F.col("s.index").alias("set_index"), F.col("s.type").alias("set_type"), F.col("s.weight_kg").alias("weight_kg"),
        F.col("s.reps").alias("reps"), F.col("s.rep_range.start").alias("rep_range_start"),
        F.col("s.rep_range.end").alias("rep_range_end"), F.col("s.distance_meters").alias("distance_meters"),
        F.col("s.duration_seconds").alias("duration_seconds"), F.col("s.rpe").alias("rpe"),
        F.col("s.custom_metric").alias("custom_metric"), run_ts.alias("ingestion_timestamp"))


def bronze_exercise_templates(valid: DataFrame, run_ts: Column) -> DataFrame:
    """The muscle list is stored as JSON text."""
    return valid.select(F.col("id").cast("string").alias("id"), "title", "type", "primary_muscle_group",
                        python_json_list(F.col("secondary_muscle_groups")).alias("secondary_muscle_groups"),
                        "is_custom", run_ts.alias("ingestion_timestamp"))


# ------------------------------------------------------------ legacy scripts
def _outer(valid: DataFrame, header: list[Column], ex_cols: list[tuple[str, str]], set_cols: list[tuple[str, str]],
           inner: bool = False) -> DataFrame:
    ex_fn = F.explode if inner else F.explode_outer
    e = valid.select(*header, ex_fn("exercises").alias("_e"))
    s = e.select("*", ex_fn("_e.sets").alias("_s"))
    hnames = [c for c in e.columns if c != "_e"]
    return s.select(*hnames, *[F.col(f"_e.{src}").alias(dst) for src, dst in ex_cols],
                    *[F.col(f"_s.{src}").alias(dst) for src, dst in set_cols])


_LEGACY_SET = [("index", "set_index"), ("type", "set_type")] + [(c, c) for c in SET_COLS]


def flat_workouts_outer(valid: DataFrame, run_ts: Column) -> DataFrame:
    """Fully denormalised workouts (outer on exercises and sets)."""
    header = [F.col("id").alias("workout_id"), "title", "routine_id", "description", _ts("start_time"),
              _ts("end_time"), _ts("updated_at"), _ts("created_at"), run_ts.alias("ingestion_timestamp")]
    ex = [("index", "exercise_index"), ("title", "exercise_title"), ("notes", "exercise_notes"),
          ("exercise_template_id", "exercise_template_id"), ("superset_id", "supersets_id")]
    return _outer(valid, header, ex, _LEGACY_SET)


def flat_routines_outer(valid: DataFrame, run_ts: Column) -> DataFrame:
    """Fully denormalised routines (outer), rep range split in two."""
    header = [F.col("id").alias("routine_id"), "title", F.col("folder_id").cast("string").alias("folder_id"),
              _ts("updated_at"), _ts("created_at"), run_ts.alias("ingestion_timestamp")]
    ex = [("index", "exercise_index"), ("title", "exercise_title"), ("notes", "exercise_notes"),
          ("rest_seconds", "rest_seconds"), ("exercise_template_id", "exercise_template_id"),
          ("superset_id", "supersets_id")]
    sets = [("index", "set_index"), ("type", "set_type"), ("weight_kg", "weight_kg"), ("reps", "reps"),
            ("rep_range.start", "rep_range_start"), ("rep_range.end", "rep_range_end"),
            ("distance_meters", "distance_meters"), ("duration_seconds", "duration_seconds"), ("rpe", "rpe"),
            ("custom_metric", "custom_metric")]
    return _outer(valid, header, ex, sets)


def flat_workout_log_outer(valid: DataFrame, run_ts: Column) -> DataFrame:
    """The same outer shape under the event-log naming (no updated_at)."""
    header = [F.col("id").alias("workout_id"), F.col("title").alias("workout_title"), "description",
              _ts("start_time"), _ts("end_time"), _ts("created_at"), "routine_id",
              run_ts.alias("ingestion_timestamp")]
    ex = [("title", "exercise_title"), ("exercise_template_id", "exercise_template_id"),
          ("superset_id", "superset_id"), ("notes", "exercise_notes"), ("index", "exercise_index")]
    return _outer(valid, header, ex, _LEGACY_SET)


def flat_exercise_sets(valid: DataFrame, run_ts: Column) -> DataFrame:
    """Set grain with exercise columns (inner)."""
    header = [F.col("id").alias("workout_id")]
    ex = [("index", "exercise_index"), ("title", "title"), ("notes", "notes"),
          ("exercise_template_id", "exercise_template_id"), ("superset_id", "supersets_id")]
    return _outer(valid, header, ex, _LEGACY_SET, inner=True).withColumn("ingestion_timestamp", run_ts)


def flat_history_entries(valid: DataFrame, run_ts: Column) -> DataFrame:
    """C11: set grain with workout title and times (inner; set type optional)."""
    header = [F.col("id").alias("workout_id"), F.col("title").alias("workout_title"),
              utc_ntz(F.col("start_time")).alias("workout_start_time"),
              utc_ntz(F.col("end_time")).alias("workout_end_time")]
    ex = [("exercise_template_id", "exercise_template_id")]
    sets = [(c, c) for c in SET_COLS] + [("type", "set_type")]
    return _outer(valid, header, ex, sets, inner=True).withColumn("ingestion_timestamp", run_ts)


def flat_sets(valid: DataFrame, run_ts: Column) -> DataFrame:
    """Minimal set grain (inner)."""
    header = [F.col("id").alias("workout_id")]
    ex = [("exercise_template_id", "exercise_template_id")]
    sets = [("index", "index"), ("type", "set_type")] + [(c, c) for c in SET_COLS]
    return _outer(valid, header, ex, sets, inner=True).withColumn("ingestion_timestamp", run_ts)


def updated_events_flat(valid_events: DataFrame, run_ts: Column) -> DataFrame:
    """C13: 'updated' events that carry a workout, flattened outer."""
    w = valid_events.filter((F.col("type") == "updated") & F.col("workout").isNotNull()).select("workout.*")
    header = [F.lit("updated").alias("event_type"), F.col("id").alias("workout_id"),
              F.col("title").alias("workout_title"), "routine_id", "description", _ts("start_time"),
              _ts("end_time"), _ts("updated_at"), _ts("created_at"), run_ts.alias("ingestion_timestamp")]
    ex = [("index", "exercise_index"), ("title", "exercise_title"), ("notes", "exercise_notes"),
          ("exercise_template_id", "exercise_template_id"), ("superset_id", "superset_id")]
    return _outer(w, header, ex, _LEGACY_SET)


DELETED_RAW = "struct<type:string,id:string,deleted_at:string>"


def deleted_events(items: DataFrame) -> DataFrame:
    """C14: raw events of type 'deleted' -> (type, id, deleted_at); this feed
    is read without a model."""
    v = items.select(F.from_json("item", DELETED_RAW).alias("v"))
    return v.filter(F.col("v.type") == "deleted").select("v.type", "v.id", utc_ntz(F.col("v.deleted_at"))
                                                         .alias("deleted_at"))


def custom_exercise_templates(valid: DataFrame, run_ts: Column) -> DataFrame:
    """Template variant with field names of the custom-exercise model."""
    return valid.select(F.col("id").cast("string").alias("id"), "title", F.col("type").alias("exercise_type"),
                        "equipment_category", F.col("primary_muscle_group").alias("muscle_group"),
                        F.coalesce(F.col("is_custom"), F.lit(False)).alias("is_custom"),
                        python_json_list(F.col("secondary_muscle_groups")).alias("other_muscles_json"),
                        run_ts.alias("ingestion_timestamp"))


def folders_flat(valid: DataFrame, run_ts: Column) -> DataFrame:
    """The whole folder model plus the ingestion stamp."""
    return valid.select(F.col("id").cast("string").alias("id"), "index", "title", _ts("updated_at"),
                        _ts("created_at"), run_ts.alias("ingestion_timestamp"))

"""Silver dimensions: exercises (with progression steps) and routines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the dimension rules.
OTHER = "Other"
UNKNOWN_EQUIPMENT = "Unknown"
LEGACY_DEFAULT_STEP = 2.5


def progression_lookup(raw: DataFrame, drop_negative: bool = False) -> DataFrame:
    """Name -> step. Later lines win for repeated names. With
    ``drop_negative`` negative steps are discarded (they then count as
    missing), as the executed pipeline does."""
    r = raw
    if drop_negative:
        r = r.filter(F.col("progression_step_kg") >= 0)
    return r.groupBy("exercise_name").agg(
        F.max_by("progression_step_kg", "line_no").cast("double").alias("progression_step_kg"))


def dim_exercise(templates: DataFrame, progression: DataFrame | None = None, default: float | None = 0.0) -> DataFrame:
    """F1 + F2: template attributes with defaults, hierarchy name (null if the
    title is null) and the progression step looked up by exercise name.
    ``default`` fills a missing step (0.0 in the current pipeline)."""
    mg = F.coalesce(F.col("primary_muscle_group"), F.lit(OTHER))
    d = templates.select(
        F.col("id").cast("string").alias("exercise_template_id"),
        F.col("title").alias("exercise_name"),
        F.coalesce(F.col("type"), F.lit(OTHER)).alias("exercise_type"),
        F.lit(UNKNOWN_EQUIPMENT).alias("equipment_category"),
        mg.alias("primary_muscle_group"),
        F.when(F.col("is_custom").cast("boolean"), F.lit("Yes")).otherwise(F.lit("No")).alias("is_custom_exercise"),
        F.concat(mg, F.lit(" - "), F.col("title")).alias("exercise_hierarchy_name"),
    )
    if progression is None:
        return d.withColumn("progression_step_kg", F.lit(default).cast("double"))
    j = d.join(progression, "exercise_name", "left")
    step = F.col("progression_step_kg")
    if default is not None:
        step = F.coalesce(step, F.lit(default).cast("double"))
    return j.select(*[c for c in d.columns], step.alias("progression_step_kg"))


def base_increment(templates: DataFrame, progression: DataFrame, mode: str = "null") -> DataFrame:
    """Template id -> increment. ``null``: missing -> 2.5 (legacy
    import); ``truthy``: missing or 0.0 -> 2.5 (coach)."""
    t = templates.select(F.col("id").cast("string").alias("exercise_template_id"), F.col("title").alias("exercise_name"))
    j = t.join(progression, "exercise_name", "left")
    step = F.col("progression_step_kg")
    if mode == "truthy":
        step = F.nullif(step, F.lit(0.0))
    elif mode != "null":
        raise ValueError(mode)
    return j.select("exercise_template_id", "exercise_name",
                    F.coalesce(step, F.lit(LEGACY_DEFAULT_STEP)).alias("base_increment"))


def dim_routine(scd: DataFrame, current_only: bool = False) -> DataFrame:
    """One row per routine over its plan versions."""
    s = scd.filter(F.col("scd_is_current")) if current_only else scd
    return s.groupBy("routine_id").agg(
        F.max("title").alias("routine_name"),
        F.max(F.col("folder_id").cast("string")).alias("folder_id"),
        F.min("created_at").alias("created_at"),
        F.max("updated_at").alias("last_updated_at"),
        F.countDistinct("exercise_template_id").cast("bigint").alias("unique_exercises_count"),
        F.countDistinct("exercise_index").cast("bigint").alias("total_exercises_count"),
        F.countDistinct("set_index").cast("bigint").alias("total_sets_count"),
    )

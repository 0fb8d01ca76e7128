"""Dashboard analytics over the silver fact (J)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from liftlake.functions.calendar import year_week
from liftlake.functions.metrics import e1rm, volume
from liftlake.operators.ranking import lag_by_position

GROUP = ["exercise_name", "routine_name"]


def workout_stats(fact: DataFrame, dim_ex: DataFrame, dim_rt: DataFrame) -> DataFrame:
    """Per (exercise name, routine name, cycle) the heaviest weight, the
    volume and the best Epley estimate of normal, non-skipped sets. The
    dimension joins are inner and keyed one row per key."""
    f = fact.filter((F.col("set_type") == "normal") & (F.col("execution_status") != "Skipped"))
    j = (f.join(dim_ex.select("exercise_template_id", "exercise_name"), "exercise_template_id", "inner")
         .join(dim_rt.select("routine_id", "routine_name"), "routine_id", "inner"))
    return j.groupBy("exercise_name", "routine_name", "cycle_number").agg(
        F.max("weight_kg").alias("max_weight_kg"),
        F.sum(F.col("weight_kg") * F.col("reps")).alias("total_volume_kg"),
        F.max(e1rm(F.col("weight_kg"), F.col("reps"), single_rep_exact=False)).alias("estimated_1rm_kg"),
    )


def progression(stats: DataFrame) -> DataFrame:
    """Cycle-over-cycle deltas per (exercise, routine). The previous
    cycle is found by position, not by a window over the whole group, so a
    group with very many cycles is still spread over many tasks."""
    prev = lag_by_position(stats, GROUP, "cycle_number", ["max_weight_kg", "estimated_1rm_kg", "total_volume_kg"])
    return prev.select(
        "exercise_name", "routine_name", "cycle_number", "max_weight_kg",
        F.round("estimated_1rm_kg", 2).alias("estimated_1rm_kg"),
        "total_volume_kg",
        (F.col("max_weight_kg") - F.col("prev_max_weight_kg")).alias("weight_progression"),
        F.round(F.col("estimated_1rm_kg") - F.col("prev_estimated_1rm_kg"), 2).alias("rep_max_progression"),
        (F.col("total_volume_kg") - F.col("prev_total_volume_kg")).alias("volume_progression"),
    )


def execution_vs_plan(fact: DataFrame, dim_ex: DataFrame, dim_rt: DataFrame) -> DataFrame:
    """Sets performed and mean weight difference to the plan."""
    f = fact.filter((F.col("set_type") == "normal") & F.col("planned_weight_kg").isNotNull())
    j = (f.join(dim_ex.select("exercise_template_id", "exercise_name"), "exercise_template_id", "inner")
         .join(dim_rt.select("routine_id", "routine_name"), "routine_id", "inner"))
    return j.groupBy("exercise_name", "routine_name", "cycle_number").agg(
        F.count("set_index").cast("bigint").alias("total_sets_performed"),
        F.round(F.avg(F.coalesce(F.col("diff_weight_kg"), F.lit(0.0))), 2).alias("avg_weight_vs_plan_kg"),
    )


def plateaus(prog: DataFrame) -> DataFrame:
    """A (routine, exercise) with at least three cycles whose last two
    non-null e1RM deltas are both <= 0. Top-2 per group via a rank filter,
    which Spark limits map-side before the shuffle."""
    n = prog.groupBy(*GROUP).agg(F.count(F.lit(1)).cast("bigint").alias("n_cycles"))
    w = Window.partitionBy(*GROUP).orderBy(F.col("cycle_number").desc())
    last2 = (prog.filter(F.col("rep_max_progression").isNotNull())
             .withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= 2)
             .groupBy(*GROUP).agg(F.count(F.lit(1)).alias("_k"),
                                  F.max("rep_max_progression").alias("_worst"),
                                  F.max_by("rep_max_progression", "cycle_number").alias("last_delta"),
                                  F.min_by("rep_max_progression", "cycle_number").alias("previous_delta")))
    # Null names form a group of their own, as in the grouping.
    last2 = last2.withColumnsRenamed({c: f"_{c}" for c in GROUP})
    same = F.lit(True)
    for c in GROUP:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    j = n.join(last2, same, "left")
    flag = (F.col("n_cycles") >= 3) & (F.col("_k") == 2) & (F.col("_worst") <= 0)
    return j.select(*GROUP, "n_cycles", F.when(F.col("_k") == 2, F.col("last_delta")).alias("last_delta"),
                    F.when(F.col("_k") == 2, F.col("previous_delta")).alias("previous_delta"),
                    F.coalesce(flag, F.lit(False)).alias("is_plateau"))


def latest_kpis(prog: DataFrame) -> DataFrame:
    """The last cycle of each (exercise, routine), null deltas as 0."""
    last = prog.groupBy(*GROUP).agg(F.max_by(F.struct(*[c for c in prog.columns if c not in GROUP]),
                                             "cycle_number").alias("l"))
    z = lambda c: F.coalesce(F.col(f"l.{c}"), F.lit(0.0))
    return last.select(
        *GROUP, F.col("l.cycle_number").alias("cycle_number"),
        F.col("l.estimated_1rm_kg").alias("estimated_1rm_kg"), z("rep_max_progression").alias("e1rm_delta"),
        F.col("l.total_volume_kg").alias("total_volume_kg"), z("volume_progression").alias("volume_delta"),
        F.col("l.max_weight_kg").alias("max_weight_kg"), z("weight_progression").alias("weight_delta"),
    )


def default_routine(prog: DataFrame) -> Column:
    """The selector's default: routine of the first row in (exercise,
    routine, cycle) order among non-null routine names, as a scalar subquery."""
    first = prog.filter(F.col("routine_name").isNotNull()).select(
        F.min(F.struct("exercise_name", "routine_name", "cycle_number")).getField("routine_name"))
    return first.scalar()


def filter_progression(prog: DataFrame, routine: Column | str, exercise: str | None = None,
                       cycles: list[int] | None = None) -> DataFrame:
    """Deltas are computed before filtering; an empty cycle selection
    means every cycle."""
    r = routine if isinstance(routine, Column) else F.lit(routine)
    out = prog.filter(F.col("routine_name") == r)
    if exercise is not None:
        out = out.filter(F.col("exercise_name") == exercise)
    if cycles:
        out = out.filter(F.col("cycle_number").isin(cycles))
    return out


def filter_options(prog: DataFrame, routine: Column | str) -> DataFrame:
    """The selector options as (option_type, option_value) rows."""
    r = routine if isinstance(routine, Column) else F.lit(routine)
    routines = prog.select(F.lit("routine").alias("option_type"), F.col("routine_name").alias("option_value"))
    exercises = prog.filter(F.col("routine_name") == r).select(
        F.lit("exercise").alias("option_type"), F.col("exercise_name").alias("option_value"))
    cycles = prog.select(F.lit("cycle").alias("option_type"), F.col("cycle_number").cast("string").alias("option_value"))
    return routines.unionByName(exercises).unionByName(cycles).dropna().distinct()


def last_ingestion(workouts: DataFrame) -> DataFrame:
    """J8."""
    return workouts.agg(F.max("ingestion_timestamp").alias("last_update"))


def workout_detail(fact: DataFrame, dim_ex: DataFrame, dim_rt: DataFrame) -> DataFrame:
    """Set rows with workout start (which the fact holds), names, date,
    ISO year-week label and volume (missing numbers count as 0)."""
    j = (fact.select("workout_id", "routine_id", "exercise_template_id", "set_type", "weight_kg", "reps", "rpe",
                     "execution_status", "start_time")
         .join(dim_ex.select("exercise_template_id", F.col("exercise_name").alias("exercise_title")),
               "exercise_template_id", "left")
         .join(dim_rt.select("routine_id", F.col("routine_name").alias("workout_title")), "routine_id", "left"))
    start = F.col("start_time").cast("string").try_cast("timestamp_ntz")
    return j.select(
        "workout_id", "routine_id", start.alias("start_time"), "set_type", "weight_kg", "reps", "rpe",
        "execution_status", "exercise_title", "workout_title",
        F.to_date(start).alias("workout_date"), year_week(start).alias("year_week"),
        volume(F.col("weight_kg"), F.col("reps")).alias("volume"),
    )


def normal_or_all(detail: DataFrame) -> DataFrame:
    """Null set type counts as normal; keep normal sets (any case), or
    every row when there is no normal set at all (scalar subquery, no join)."""
    d = detail.withColumn("set_type", F.coalesce(F.col("set_type"), F.lit("normal")))
    is_normal = F.lower(F.col("set_type")) == "normal"
    any_normal = d.select(F.max(is_normal.cast("int"))).scalar()
    return d.filter(is_normal | (F.coalesce(any_normal, F.lit(0)) == 0))


def global_kpis(sets: DataFrame) -> DataFrame:
    """J11."""
    return sets.agg(
        (F.sum("volume") / 1000).alias("total_volume_t"),
        F.countDistinct("workout_id").cast("bigint").alias("total_workouts"),
        F.count(F.lit(1)).cast("bigint").alias("total_sets"),
        F.avg(F.col("rpe").cast("string").try_cast("double")).alias("avg_rpe"),
    )


def weekly_volume(sets: DataFrame) -> DataFrame:
    """J12."""
    return (sets.filter(F.col("year_week").isNotNull()).groupBy("year_week")
            .agg(F.sum("volume").alias("volume")).withColumn("volume_t", F.col("volume") / 1000))


def top_exercises(sets: DataFrame, k: int = 10) -> DataFrame:
    """Most frequent exercises (ties by name), a distributed top-k."""
    return (sets.filter(F.col("exercise_title").isNotNull()).groupBy(F.col("exercise_title").alias("exercise"))
            .agg(F.count(F.lit(1)).cast("bigint").alias("sets"))
            .orderBy(F.col("sets").desc(), F.col("exercise").asc()).limit(k))


RECENT_COLS = ["workout_date", "workout_title", "exercise_title", "weight_kg", "reps", "rpe", "execution_status",
               "volume"]


def recent_sets(sets: DataFrame, ordered: bool = True) -> DataFrame:
    """J14."""
    out = sets.select(*RECENT_COLS)
    return out.orderBy(F.col("workout_date").desc_nulls_last()) if ordered else out

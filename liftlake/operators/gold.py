"""Gold: the denormalised, prompt-ready table and routine lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftlake.operators.fact import EXERCISE_KEYS
from liftlake.session import by_shuffle

GOLD_COLS = [
    "routine_id", "routine_name", "cycle_number", "exercise_index", "exercise_template_id", "superset_id",
    "exercise_name", "primary_muscle_group", "progression_step_kg", "set_index", "set_type",
    "actual_weight_kg", "actual_reps", "rpe", "planned_weight_kg", "planned_reps", "planned_rest",
    "execution_status", "diff_weight_kg", "diff_reps",
]


def current_indices(details: DataFrame, with_superset: bool = True) -> DataFrame:
    """H1: per (routine, template) the first exercise position in the current
    plan and its superset."""
    aggs = [F.min("exercise_index").alias("exercise_index")]
    if with_superset:
        aggs.append(F.max(F.col("superset_id").cast("string").try_cast("int")).alias("superset_id"))
    return details.groupBy("routine_id", "exercise_template_id").agg(*aggs)


def gold_prompt(fact: DataFrame, dim_ex: DataFrame, dim_rt: DataFrame, details: DataFrame,
                exclude_unplanned: bool = False) -> DataFrame:
    """H2 (default) / H3 (``exclude_unplanned``: planned sets only, the index
    is the plan's own and there is no superset column).

    The three right-hand sides are dimensions keyed by the join keys (one row
    per key), so the joins never multiply fact rows. They meet the distinct
    (routine, template) pairs of the fact first, which are far fewer and narrow;
    the fact rows then get all of it by their pair, where they lie if the fact
    is stored by it. Rows without a whole pair are joined as they are."""
    f = fact.filter(F.col("workout_id").isNotNull())
    if exclude_unplanned:
        f = f.filter(F.col("execution_status") != F.lit("Unplanned"))
    e = dim_ex.select("exercise_template_id", "exercise_name", "primary_muscle_group", "progression_step_kg")
    r = dim_rt.select("routine_id", "routine_name")
    idx = current_indices(details, with_superset=not exclude_unplanned).withColumnRenamed(
        "exercise_index", "idx_exercise_index")

    def described(rows: DataFrame) -> DataFrame:
        return (rows.join(by_shuffle(e), "exercise_template_id", "left").join(by_shuffle(r), "routine_id", "left")
                .join(by_shuffle(idx), EXERCISE_KEYS, "left"))

    whole = F.col("routine_id").isNotNull() & F.col("exercise_template_id").isNotNull()
    pairs = described(f.filter(whole).select(*EXERCISE_KEYS).distinct())
    j = f.filter(whole).join(by_shuffle(pairs), EXERCISE_KEYS, "left").unionByName(described(f.filter(~whole)))
    index = (F.col("idx_exercise_index") if exclude_unplanned
             else F.coalesce(F.col("idx_exercise_index"), F.col("exercise_index")))
    cols = [
        "routine_id", "routine_name", "cycle_number", index.alias("exercise_index"), "exercise_template_id",
        *([] if exclude_unplanned else ["superset_id"]),
        "exercise_name", "primary_muscle_group", "progression_step_kg", "set_index", "set_type",
        F.col("weight_kg").alias("actual_weight_kg"), F.col("reps").alias("actual_reps"), "rpe",
        "planned_weight_kg", "planned_reps", "planned_rest", "execution_status", "diff_weight_kg", "diff_reps",
    ]
    return j.select(*cols)


def gold_ordered(gold: DataFrame) -> DataFrame:
    """Presentation order of the gold table (routine, cycle, index, template, set)."""
    return gold.orderBy("routine_id", "cycle_number", "exercise_index", "exercise_template_id", "set_index")


def routine_names(fact: DataFrame, dim_rt: DataFrame) -> DataFrame:
    """(routine_id, routine_name) of the routines in the gold table, which has
    those of all rows with a workout, without its other columns and joins."""
    ids = fact.filter(F.col("workout_id").isNotNull()).select("routine_id").distinct()
    return ids.join(dim_rt.select("routine_id", "routine_name"), "routine_id", "left")


def routine_list(df: DataFrame, id_col: str, name_col: str, require_name: bool = False,
                 ordered: bool = True) -> DataFrame:
    """H4 / H5 / H6: distinct (id, title) of routines, by title."""
    out = df.select(F.col(id_col).alias("id"), F.col(name_col).alias("title"))
    if require_name:
        out = out.filter(F.col("title").isNotNull())
    out = out.distinct()
    return out.orderBy(F.col("title").asc_nulls_first(), "id") if ordered else out

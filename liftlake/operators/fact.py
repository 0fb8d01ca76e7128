"""Plan-versus-actual fact (one row per performed set, plan alongside).

The plan valid at a workout is a range lookup into the SCD2 dimension. The
default (LEFT, matched per workout) joins every performed set directly to the
plan row with the same (routine, template, exercise index, set index, set
type) whose validity interval holds the workout's start: an equi-join on the
first two keys with the others and the interval as a residual predicate, as a
routine's plan has few sets of one exercise. Because the intervals of one
business key never overlap, each set finds at most one plan row, and no
"one copy of the plan per workout" table is ever built. Only the FULL OUTER
form, whose skipped rows *are* those per-workout plan copies, builds it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftlake.functions.status import execution_status_sql
from liftlake.operators.ranking import dense_rank_keys, join_rank
from liftlake.session import by_shuffle, same

# A routine's exercise: the matched sets are spread and stored by it.
EXERCISE_KEYS = ["routine_id", "exercise_template_id"]
MATCH_KEYS = ["routine_id", "exercise_template_id", "exercise_index", "set_index", "set_type"]

FACT_COLS = [
    "workout_id", "routine_id", "exercise_template_id", "exercise_index", "folder_id", "cycle_number",
    "set_type", "set_index", "execution_status", "diff_weight_kg", "diff_reps", "diff_duration_seconds",
    "diff_custom_metric", "weight_kg", "reps", "distance_meters", "duration_seconds", "rpe", "custom_metric",
    "planned_weight_kg", "planned_reps", "planned_distance_meters", "planned_duration_seconds",
    "planned_custom_metric", "planned_rest", "start_time", "updated_at",
]

PLAN_VALUE_COLS = {
    "weight_kg": "planned_weight_kg", "reps": "planned_reps", "distance_meters": "planned_distance_meters",
    "duration_seconds": "planned_duration_seconds", "custom_metric": "planned_custom_metric",
    "rest_seconds": "planned_rest",
}


def with_exercise(sets: DataFrame, exercises: DataFrame, how: str = "inner") -> DataFrame:
    """Rows of ``sets`` with the exercise they belong to. The join key is the
    workout id alone, so that tables bucketed by it meet without an exchange;
    the exercise index is compared within a workout, which has few of either."""
    e = exercises.withColumnsRenamed({"workout_id": "_e_workout_id", "exercise_index": "_e_index"})
    own = (F.col("workout_id") == F.col("_e_workout_id")) & (F.col("exercise_index") - F.col("_e_index") == 0)
    return sets.join(by_shuffle(e), own, how).drop("_e_workout_id", "_e_index")


def actual_sets(sets: DataFrame, workouts: DataFrame, exercises: DataFrame) -> DataFrame:
    """G1: performed sets of workouts that follow a routine. Null set type
    counts as 'normal', null RPE as 7."""
    w = workouts.filter(F.col("routine_id").isNotNull()).select(
        "workout_id", "routine_id", "start_time", "end_time", "updated_at")
    e = exercises.select("workout_id", "exercise_index", "exercise_template_id")
    s = sets.select("workout_id", "exercise_index", "set_index", "set_type", "weight_kg", "reps",
                    "distance_meters", "duration_seconds", "rpe", "custom_metric")
    j = with_exercise(s.join(by_shuffle(w), "workout_id", "inner"), e)
    return j.select(
        "workout_id", "routine_id", "start_time", "end_time", "updated_at", "exercise_template_id",
        "exercise_index", "set_index",
        F.coalesce(F.col("set_type"), F.lit("normal")).alias("set_type"),
        "weight_kg", "reps", "distance_meters", "duration_seconds",
        F.coalesce(F.col("rpe"), F.lit(7.0)).alias("rpe"),
        "custom_metric",
    )


def cycle_keys(sets: DataFrame, workouts: DataFrame, exercises: DataFrame, with_workout: bool = False) -> DataFrame:
    """The (template, routine, start) keys of ``actual_sets`` from narrow
    columns only: exercises that have at least one set, with their workout's
    routine and start. Used to rank cycles without a second full pass over
    the set rows."""
    w = workouts.filter(F.col("routine_id").isNotNull()).select("workout_id", "routine_id", "start_time")
    e = exercises.select("workout_id", "exercise_index", "exercise_template_id")
    s = sets.select("workout_id", "exercise_index")
    return (with_exercise(e, s, "left_semi").join(by_shuffle(w), "workout_id", "inner")
            .select(*["workout_id"] * with_workout, "exercise_template_id", "routine_id", "start_time"))


def workout_headers(actual: DataFrame) -> DataFrame:
    """G2."""
    return actual.select("workout_id", "routine_id", "start_time").distinct()


def workout_headers_of(sets: DataFrame, workouts: DataFrame, exercises: DataFrame) -> DataFrame:
    """G2 from the workouts themselves: those that follow a routine and have a
    set of a listed exercise. No value of a set is read."""
    listed = with_exercise(sets.select("workout_id", "exercise_index"), exercises.select("workout_id", "exercise_index"), "left_semi")
    w = workouts.filter(F.col("routine_id").isNotNull()).select("workout_id", "routine_id", "start_time")
    return w.join(by_shuffle(listed.select("workout_id")), "workout_id", "left_semi").distinct()


def _plan_side(scd: DataFrame) -> DataFrame:
    return scd.select(
        "routine_id", "exercise_template_id", "exercise_index", "set_index",
        F.coalesce(F.col("set_type"), F.lit("normal")).alias("set_type"),
        "folder_id", F.col("updated_at").alias("plan_updated_at"),
        *[F.col(k).alias(v) for k, v in PLAN_VALUE_COLS.items()],
        "scd_valid_from", "scd_valid_to",
    )


def applicable_plan(headers: DataFrame, scd: DataFrame) -> DataFrame:
    """One copy of the valid plan per workout (headers x SCD2 on routine
    with the half-open interval as residual predicate)."""
    h = headers.select(F.col("workout_id").alias("p_workout_id"), F.col("routine_id").alias("h_routine_id"),
                       F.col("start_time").alias("workout_start_time"))
    p = _plan_side(scd)
    cond = ((F.col("h_routine_id") == F.col("routine_id"))
            & (F.col("workout_start_time") >= F.col("scd_valid_from"))
            & ((F.col("workout_start_time") < F.col("scd_valid_to")) | F.col("scd_valid_to").isNull()))
    return h.join(p, cond, "inner").drop("h_routine_id", "scd_valid_from", "scd_valid_to")


def _status_and_values(actual_present: str, plan_present: str) -> list:
    """Status, diffs and values as SQL expression text (built in one call)."""
    return [
        F.expr(execution_status_sql(actual_present, plan_present)).alias("execution_status"),
        F.expr("weight_kg - planned_weight_kg").alias("diff_weight_kg"),
        F.expr("reps - planned_reps").alias("diff_reps"),
        F.expr("duration_seconds - planned_duration_seconds").alias("diff_duration_seconds"),
        F.expr("custom_metric - planned_custom_metric").alias("diff_custom_metric"),
        "weight_kg", "reps", "distance_meters", "duration_seconds", "rpe", "custom_metric",
        "planned_weight_kg", "planned_reps", "planned_distance_meters", "planned_duration_seconds",
        "planned_custom_metric", "planned_rest",
    ]


def _with_cycle(df: DataFrame, per_routine: bool, key_source: DataFrame | None = None) -> DataFrame:
    """cycle_number = dense rank of the workout start per template
    (or per template and routine), computed by the range-partitioned rank so
    a hot template never lands in one task. ``key_source`` is a cheaper frame
    holding the same (template, routine, start) keys as ``df``."""
    groups = ["exercise_template_id", "routine_id"] if per_routine else ["exercise_template_id"]
    ranks = dense_rank_keys(key_source if key_source is not None else df, groups, "start_time", "cycle_number")
    return join_rank(df, ranks, groups, "start_time")


def with_cycles(actual: DataFrame, keys: DataFrame) -> DataFrame:
    """``actual`` with its cycle number per template (G9), attached before the plan
    match: the ranks of ``keys`` (see ``cycle_keys``, with the workout) come back
    to the workouts they belong to as narrow rows, so the wide matched rows need
    no shuffle of their own. As in ``with_exercise`` the join key is the workout
    alone."""
    group = ["exercise_template_id"]
    ranks = dense_rank_keys(keys, group, "start_time", "cycle_number")
    own = keys.select("workout_id", *group, "start_time").distinct()
    c = join_rank(own, ranks, group, "start_time").toDF("_c_workout_id", "_c_template", "_c_start", "cycle_number")
    match = F.col("workout_id") == F.col("_c_workout_id")
    for left, right in (("exercise_template_id", "_c_template"), ("start_time", "_c_start")):
        match = match & F.coalesce(F.col(left) == F.col(right), F.col(left).isNull() & F.col(right).isNull())
    return actual.join(by_shuffle(c), match, "left").drop("_c_workout_id", "_c_template", "_c_start")


def fact_workout_history(actual: DataFrame, scd: DataFrame, include_skipped: bool = False,
                         per_routine: bool = False, keys: DataFrame | None = None, headers: DataFrame | None = None) -> DataFrame:
    """G4 (default) / G6 (``include_skipped``) with G7 status, G8 diffs and
    G9/G10 cycle numbers. ``keys`` (see ``cycle_keys``) is a narrow source of
    the actual (template, routine, start) keys, ``headers`` (see
    ``workout_headers_of``) of the workouts; without them they are taken from
    ``actual``."""
    if include_skipped:
        return _fact_full_outer(actual, scd, per_routine, keys, headers)
    if keys is not None and "workout_id" in keys.columns and not per_routine:
        return matched_sets(with_cycles(actual, keys), scd).select(*FACT_COLS)
    out = matched_sets(actual, scd)
    return _with_cycle(out, per_routine, keys if keys is not None else actual).select(*FACT_COLS)


def matched_sets(actual: DataFrame, scd: DataFrame) -> DataFrame:
    """The LEFT match with status and differences (G7, G8); a cycle number that
    ``actual`` has already stays. Both sides are spread by routine and exercise
    alone, where the result stays: it can be stored and read by them as it lies."""
    cycle = [c for c in ("cycle_number",) if c in actual.columns]
    n = int(actual.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a = actual.repartition(n, *EXERCISE_KEYS).alias("a")
    p = by_shuffle(_plan_side(scd).repartition(n, *EXERCISE_KEYS)).alias("p")
    cond = None
    for k in MATCH_KEYS:
        left, right = F.col(f"a.{k}"), F.col(f"p.{k}")
        e = left == right if k in EXERCISE_KEYS else same(left, right)
        cond = e if cond is None else cond & e
    cond = cond & (F.col("a.start_time") >= F.col("p.scd_valid_from")) & (
        (F.col("a.start_time") < F.col("p.scd_valid_to")) | F.col("p.scd_valid_to").isNull())
    j = a.join(p, cond, "left")
    base = j.select(
        *[F.col(f"a.{k}").alias(k) for k in ["workout_id", "routine_id", "exercise_template_id", "exercise_index",
                                              "set_type", "set_index", "weight_kg", "reps", "distance_meters",
                                              "duration_seconds", "rpe", "custom_metric", "start_time", *cycle]],
        F.col("p.folder_id").alias("folder_id"),
        *[F.col(f"p.{v}").alias(v) for v in PLAN_VALUE_COLS.values()],
        F.coalesce(F.col("a.updated_at"), F.col("p.plan_updated_at")).alias("updated_at"),
        F.col("p.routine_id").isNotNull().alias("_planned"),
    )
    return base.select(
        "workout_id", "routine_id", "exercise_template_id", "exercise_index", "folder_id", "set_type", "set_index",
        *_status_and_values("TRUE", "_planned"), "start_time", "updated_at", *cycle,
    )


def matched_and_skipped(actual: DataFrame, plan: DataFrame) -> DataFrame:
    """The FULL OUTER match with the per-workout plan copies (see
    ``applicable_plan``), without cycles."""
    a = actual.alias("a")
    p = plan.alias("p")
    cond = F.col("a.workout_id") == F.col("p.p_workout_id")
    for k in MATCH_KEYS:
        cond = cond & (F.col(f"a.{k}") == F.col(f"p.{k}"))
    j = a.join(p, cond, "full_outer")

    def co(k: str, pk: str | None = None):
        return F.coalesce(F.col(f"a.{k}"), F.col(f"p.{pk or k}")).alias(k)

    base = j.select(
        co("workout_id", "p_workout_id"), co("routine_id"), co("exercise_template_id"), co("exercise_index"),
        F.col("p.folder_id").alias("folder_id"), co("set_type"), co("set_index"),
        *[F.col(f"a.{k}").alias(k) for k in ["weight_kg", "reps", "distance_meters", "duration_seconds", "rpe",
                                              "custom_metric"]],
        *[F.col(f"p.{v}").alias(v) for v in PLAN_VALUE_COLS.values()],
        co("start_time", "workout_start_time"),
        F.coalesce(F.col("a.updated_at"), F.col("p.plan_updated_at")).alias("updated_at"),
        F.col("a.workout_id").isNotNull().alias("_actual"),
        F.col("p.p_workout_id").isNotNull().alias("_planned"),
    )
    return base.select(
        "workout_id", "routine_id", "exercise_template_id", "exercise_index", "folder_id", "set_type", "set_index",
        *_status_and_values("_actual", "_planned"), "start_time", "updated_at",
    )


def _fact_full_outer(
    actual: DataFrame, scd: DataFrame, per_routine: bool, keys: DataFrame | None = None, headers: DataFrame | None = None
) -> DataFrame:
    plan = applicable_plan(headers if headers is not None else workout_headers(actual), scd)
    out = matched_and_skipped(actual, plan)
    # The (template, routine, start) keys of the result are exactly those of
    # the performed sets plus those of the plan copies (a matched copy has
    # the key of its set), so the rank reads two narrow frames instead of
    # evaluating the full outer join twice.
    copy_keys = plan.select("exercise_template_id", "routine_id", F.col("workout_start_time").alias("start_time"))
    actual_keys = keys if keys is not None else actual.select("exercise_template_id", "routine_id", "start_time")
    return _with_cycle(out, per_routine, actual_keys.unionByName(copy_keys)).select(*FACT_COLS)


def fact_plan_match_as_executed(
    actual: DataFrame, scd: DataFrame, keys: DataFrame | None = None, headers: DataFrame | None = None
) -> DataFrame:
    """G5, re-aimed. The executed pipeline matched sets to the per-workout plan
    copies *without* the workout id, so each set paired with the plan copy of
    every workout of its routine. Emitting those pairs is quadratic in the
    workouts of a routine. The same result is kept whole but compressed: one
    row per (performed set, plan version it matched) with ``plan_copies`` =
    how many workouts of the routine carried that version (the pair count).
    The status and diffs of the pairs depend only on the version, so
    expanding each row ``plan_copies`` times gives the executed table."""
    headers = headers if headers is not None else workout_headers(actual)
    # Per plan version: number of workouts of the routine whose start lies in
    # its interval. Aggregated on (routine, version interval) before joining.
    versions = scd.select("routine_id", "scd_valid_from", "scd_valid_to").distinct()
    h = headers.select(F.col("routine_id").alias("h_routine_id"), F.col("start_time").alias("h_start"))
    vc = (versions.join(h, (F.col("h_routine_id") == F.col("routine_id"))
                        & (F.col("h_start") >= F.col("scd_valid_from"))
                        & ((F.col("h_start") < F.col("scd_valid_to")) | F.col("scd_valid_to").isNull()), "inner")
          .groupBy("routine_id", "scd_valid_from", "scd_valid_to")
          .agg(F.count(F.lit(1)).cast("bigint").alias("plan_copies")))
    vc = vc.select(F.col("routine_id").alias("v_routine_id"), F.col("scd_valid_from").alias("v_from"),
                   F.col("scd_valid_to").alias("v_to"), "plan_copies")
    ps = _plan_side(scd)
    p = ps.join(vc, (F.col("routine_id") == F.col("v_routine_id")) & (F.col("scd_valid_from") == F.col("v_from"))
                & F.col("scd_valid_to").eqNullSafe(F.col("v_to")), "inner").alias("p")
    a = actual.alias("a")
    cond = None
    for k in MATCH_KEYS:
        e = F.col(f"a.{k}") == F.col(f"p.{k}")
        cond = e if cond is None else cond & e
    j = a.join(p, cond, "left")
    base = j.select(
        *[F.col(f"a.{k}").alias(k) for k in ["workout_id", "routine_id", "exercise_template_id", "exercise_index",
                                              "set_type", "set_index", "weight_kg", "reps", "distance_meters",
                                              "duration_seconds", "rpe", "custom_metric", "start_time"]],
        F.col("p.folder_id").alias("folder_id"),
        *[F.col(f"p.{v}").alias(v) for v in PLAN_VALUE_COLS.values()],
        F.coalesce(F.col("a.updated_at"), F.col("p.plan_updated_at")).alias("updated_at"),
        F.col("p.routine_id").isNotNull().alias("_planned"),
        F.coalesce(F.col("p.plan_copies"), F.lit(1)).cast("bigint").alias("plan_copies"),
    )
    out = base.select(
        "workout_id", "routine_id", "exercise_template_id", "exercise_index", "folder_id", "set_type", "set_index",
        *_status_and_values("TRUE", "_planned"), "start_time", "updated_at", "plan_copies",
    )
    return _with_cycle(out, False, keys if keys is not None else actual).select(*FACT_COLS, "plan_copies")


def fact_ordered(fact: DataFrame) -> DataFrame:
    """Newest change first (presentation only; never sort before a write)."""
    return fact.orderBy(F.col("updated_at").desc_nulls_last())

"""Registered silver queries: SCD2 (E), dimensions (F), fact (G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from liftlake.operators import dims, fact, scd2
from liftlake.operators.ranking import dense_rank_keys
from liftlake.plans.oracle_sql import _SCD_ALL, cte, fact_rows
from liftlake.plans.pipeline import Pipeline
from liftlake.plans.registry import query
from liftlake.sources import fixtures as fx

SCD_OUT = scd2.STAGED_COLS + ["scd_valid_from", "scd_valid_to", "scd_is_current"]


# ------------------------------------------------------------------ E: SCD2
@query("scd2_staging", f"SELECT {_SCD_ALL} FROM fx_plan WHERE ver = 1")
def q_scd2_staging(spark, d):
    return Pipeline(spark, d).staged(1).drop("scd_hash")


@query("scd2_quarantine", """
SELECT CAST(routine_id AS VARCHAR) AS routine_id, exercise_index, CAST(NULL AS INTEGER) AS set_index, exercise_template_id,
       'null business key' AS reason
FROM fx_plan WHERE ver = 1 AND CAST(routine_id AS BIGINT) % 41 = 0 AND set_index = 1""")
def q_scd2_quarantine(spark, d):
    """Details as a faulty extract would give them: some set indexes are text
    that is no number."""
    p = Pipeline(spark, d)
    broken = (F.col("routine_id").cast("long") % 41 == 0) & (F.col("set_index") == 1)
    details = p.details_snapshot(1).withColumn("set_index", F.when(broken, F.lit("n/a")).otherwise(F.col("set_index").cast("string")))
    return scd2.quarantined_keys(p.routines_snapshot(1), details).select(
        "routine_id", "exercise_index", "set_index", "exercise_template_id", "reason")


@query("scd2_normalize", """
SELECT CAST(routine_id AS VARCHAR) AS routine_id, TRY_CAST(CAST(exercise_index AS VARCHAR) AS INTEGER) AS exercise_index,
       TRY_CAST(CAST(set_index AS VARCHAR) AS INTEGER) AS set_index,
       TRY_CAST(CAST(superset_id AS VARCHAR) AS INTEGER) AS superset_id
FROM fx_routine_details""")
def q_scd2_normalize(spark, d):
    return Pipeline(spark, d).staged(1).select("routine_id", "exercise_index", "set_index", "superset_id")


@query("scd2_row_hash", f"""
SELECT routine_id, exercise_index, set_index,
       md5(concat_ws(chr(31), {", ".join(f"COALESCE(CAST({c} AS VARCHAR), chr(30))" for c in scd2.STAGED_COLS)})) AS scd_hash
FROM (SELECT {_SCD_ALL} FROM fx_plan WHERE ver = 1) s""")
def q_scd2_row_hash(spark, d):
    return Pipeline(spark, d).staged(1).select("routine_id", "exercise_index", "set_index", "scd_hash")


@query("scd2_initial_load", f"""
SELECT {_SCD_ALL}, TIMESTAMP '1996-01-01 00:00:00' AS scd_valid_from, CAST(NULL AS TIMESTAMP) AS scd_valid_to,
       TRUE AS scd_is_current
FROM fx_plan WHERE ver = 0""")
def q_scd2_initial_load(spark, d):
    return Pipeline(spark, d).scd_after_first_run.select(*SCD_OUT)


cte("fx_scd2_diff", """
SELECT COALESCE(o.routine_id, n.routine_id) AS routine_id, COALESCE(o.exercise_index, n.exercise_index) AS exercise_index,
       COALESCE(o.set_index, n.set_index) AS set_index,
       CASE WHEN o.routine_id IS NULL THEN 'new' WHEN n.routine_id IS NULL THEN 'deleted'
            WHEN COALESCE(o.weight_kg, -1) <> COALESCE(n.weight_kg, -1) THEN 'changed' ELSE 'unchanged' END AS change_class
FROM (SELECT * FROM fx_plan WHERE ver = 0) o
FULL OUTER JOIN (SELECT * FROM fx_plan WHERE ver = 1) n
  ON o.routine_id = n.routine_id AND o.exercise_index = n.exercise_index AND o.set_index = n.set_index""")


@query("scd2_diff", "SELECT * FROM fx_scd2_diff")
def q_scd2_diff(spark, d):
    p = Pipeline(spark, d)
    return scd2.diff(p.staged(1), scd2.current(p.scd_after_first_run))


@query("scd2_diff_stats", "SELECT change_class, CAST(COUNT(*) AS BIGINT) AS n FROM fx_scd2_diff GROUP BY change_class")
def q_scd2_diff_stats(spark, d):
    p = Pipeline(spark, d)
    return scd2.diff_stats(scd2.diff(p.staged(1), scd2.current(p.scd_after_first_run)))


@query("scd2_expire", """
SELECT routine_id, exercise_index, set_index, scd_valid_from, scd_valid_to
FROM fx_scd2 WHERE scd_valid_to IS NOT NULL""")
def q_scd2_expire(spark, d):
    s = Pipeline(spark, d).scd
    return s.filter(~F.col("scd_is_current")).select("routine_id", "exercise_index", "set_index",
                                                     "scd_valid_from", "scd_valid_to")


@query("scd2_apply", f"SELECT {_SCD_ALL}, scd_valid_from, scd_valid_to, scd_valid_to IS NULL AS scd_is_current FROM fx_scd2")
def q_scd2_apply(spark, d):
    return Pipeline(spark, d).scd.select(*SCD_OUT)


@query("scd2_current", f"SELECT {_SCD_ALL}, scd_valid_from FROM fx_scd2 WHERE scd_valid_to IS NULL")
def q_scd2_current(spark, d):
    return scd2.current(Pipeline(spark, d).scd).select(*scd2.STAGED_COLS, "scd_valid_from")


@query("scd2_as_of", """
SELECT workout_id, routine_id, exercise_index, set_index, plan.kg AS weight_kg, since AS scd_valid_from FROM fx_applicable""")
def q_scd2_as_of(spark, d):
    p = Pipeline(spark, d)
    j = scd2.as_of(p.scd_table, p.headers, "start_time", ["routine_id"])
    return j.select("p.workout_id", "s.routine_id", "s.exercise_index", "s.set_index", "s.weight_kg",
                    "s.scd_valid_from")


# The islands again by another route: within a key and weight, runs that
# follow one another keep the same distance to their rank.
cte("fx_replay", """
SELECT routine_id, exercise_index, set_index, exercise_template_id, set_type, weight_kg, reps,
       MIN(run_ts) AS scd_valid_from, MAX(next_ts) FILTER (WHERE run = last) AS scd_valid_to
FROM (
  SELECT *, MAX(run) OVER (PARTITION BY routine_id, exercise_index, set_index, kg, run - place) AS last, run - place AS island
  FROM (
    SELECT *, row_number() OVER (PARTITION BY routine_id, exercise_index, set_index, kg ORDER BY run) AS place
    FROM (
      SELECT p.* REPLACE (p.weight_kg + 2.5 * ((h.r + CAST(p.routine_id AS BIGINT) % 5) // 4) AS weight_kg),
             ifnull(CAST(p.weight_kg + 2.5 * ((h.r + CAST(p.routine_id AS BIGINT) % 5) // 4) AS VARCHAR), '') AS kg,
             h.run, h.run_ts, h.next_ts
      FROM fx_plan p
      JOIN (SELECT r, run_ts, row_number() OVER (ORDER BY r) AS run, lead(run_ts) OVER (ORDER BY r) AS next_ts
            FROM (SELECT range AS r, TIMESTAMP '1992-01-01 00:00:00' + to_months(CAST(6 * range AS INTEGER)) AS run_ts FROM range(12)) WHERE r <> 6) h
        ON p.ver = 0 AND (CAST(p.routine_id AS BIGINT) + p.exercise_index + h.r) % 7 <> 0)))
GROUP BY routine_id, exercise_index, set_index, exercise_template_id, set_type, weight_kg, reps, kg, island""")


@query("scd2_replay", """
SELECT routine_id, exercise_index, set_index, weight_kg, reps, scd_valid_from, scd_valid_to, scd_valid_to IS NULL AS scd_is_current
FROM fx_replay""")
def q_scd2_replay(spark, d):
    return scd2.replay(Pipeline(spark, d).snapshots()).select(
        "routine_id", "exercise_index", "set_index", "weight_kg", "reps", "scd_valid_from", "scd_valid_to", "scd_is_current")


@query("scd2_as_of_latest", """
SELECT f.workout_id, f.exercise_index, f.set_index, f.start_time,
       CASE WHEN r.scd_valid_to IS NULL OR f.start_time < r.scd_valid_to THEN r.scd_valid_from END AS scd_valid_from,
       CASE WHEN r.scd_valid_to IS NULL OR f.start_time < r.scd_valid_to THEN r.weight_kg END AS planned_weight_kg
FROM fx_performed f ASOF LEFT JOIN (SELECT * REPLACE (ifnull(set_type, 'normal') AS set_type) FROM fx_replay) r
  ON f.routine_id = r.routine_id AND f.exercise_template_id = r.exercise_template_id AND f.exercise_index = r.exercise_index
  AND f.set_index = r.set_index AND f.set_type = r.set_type AND f.start_time >= r.scd_valid_from""")
def q_scd2_as_of_latest(spark, d):
    """Every performed set with the plan row valid then, over the long history."""
    p = Pipeline(spark, d)
    # Both come whole through one shuffle: only what is asked for of them.
    versions = p.scd_history.withColumn("set_type", F.coalesce("set_type", F.lit("normal"))).select(
        *fact.MATCH_KEYS, "scd_valid_from", "scd_valid_to", "weight_kg")
    found = scd2.as_of_latest(versions, p.actual.select("workout_id", *fact.MATCH_KEYS, "start_time"), "start_time", fact.MATCH_KEYS)
    return found.select("workout_id", "exercise_index", "set_index", "start_time", F.col("version.scd_valid_from").alias("scd_valid_from"),
                        F.col("version.weight_kg").alias("planned_weight_kg"))


# ------------------------------------------------------------------ F: dimensions
@query("progression_lookup", "SELECT * FROM fx_progression")
def q_progression_lookup(spark, d):
    return Pipeline(spark, d).progression


@query("dim_exercise", "SELECT * FROM fx_dim_exercise")
def q_dim_exercise(spark, d):
    return Pipeline(spark, d).dim_exercise


@query("dim_exercise_progression", """
SELECT exercise_template_id, exercise_name, progression_step_kg FROM fx_dim_exercise""")
def q_dim_exercise_progression(spark, d):
    return Pipeline(spark, d).dim_exercise.select("exercise_template_id", "exercise_name", "progression_step_kg")


@query("dim_routine", "SELECT * FROM fx_dim_routine")
def q_dim_routine(spark, d):
    return Pipeline(spark, d).dim_routine


@query("dim_routine_current", """
SELECT routine_id, MAX(title) AS routine_name, MAX(folder_id) AS folder_id, MIN(created_at) AS created_at,
       MAX(updated_at) AS last_updated_at,
       CAST(COUNT(DISTINCT exercise_template_id) AS BIGINT) AS unique_exercises_count,
       CAST(COUNT(DISTINCT exercise_index) AS BIGINT) AS total_exercises_count,
       CAST(COUNT(DISTINCT set_index) AS BIGINT) AS total_sets_count
FROM fx_scd2 WHERE scd_valid_to IS NULL GROUP BY routine_id""")
def q_dim_routine_current(spark, d):
    return dims.dim_routine(Pipeline(spark, d).scd, current_only=True)


@query("exercise_base_increment", """
SELECT t.id AS exercise_template_id, t.title AS exercise_name,
       COALESCE(p.progression_step_kg, CAST(2.5 AS DOUBLE)) AS base_increment
FROM fx_templates t LEFT JOIN fx_progression p ON p.exercise_name = t.title""")
def q_exercise_base_increment(spark, d):
    p = Pipeline(spark, d)
    return dims.base_increment(p.bronze.exercise_templates, p.progression, mode="null")


@query("exercise_base_increment_truthy", """
SELECT t.id AS exercise_template_id, t.title AS exercise_name,
       COALESCE(NULLIF(p.progression_step_kg, 0.0), CAST(2.5 AS DOUBLE)) AS base_increment
FROM fx_templates t LEFT JOIN fx_progression p ON p.exercise_name = t.title""")
def q_exercise_base_increment_truthy(spark, d):
    p = Pipeline(spark, d)
    return dims.base_increment(p.bronze.exercise_templates, p.progression, mode="truthy")


# ------------------------------------------------------------------ G: fact
@query("fact_actual_sets", "SELECT * FROM fx_performed")
def q_fact_actual_sets(spark, d):
    return Pipeline(spark, d).actual


@query("workout_headers", "SELECT * FROM fx_trainings")
def q_workout_headers(spark, d):
    return Pipeline(spark, d).headers


@query("applicable_plan", """
SELECT workout_id AS p_workout_id, start_time AS workout_start_time, routine_id, exercise_template_id, exercise_index, set_index,
       set_type, plan.folder_id AS folder_id, plan.changed AS plan_updated_at, plan.kg AS planned_weight_kg, plan.reps AS planned_reps,
       plan.metres AS planned_distance_meters, plan.seconds AS planned_duration_seconds, plan.metric AS planned_custom_metric,
       plan.rest AS planned_rest
FROM fx_applicable""")
def q_applicable_plan(spark, d):
    p = Pipeline(spark, d)
    return fact.applicable_plan(p.headers, p.scd_table)


@query("fact_workout_history", "SELECT * FROM fx_fact")
def q_fact_workout_history(spark, d):
    return Pipeline(spark, d).fact


@query("fact_plan_match_as_executed", fact_rows("fx_matched_any").replace(
    "m.updated_at", "m.updated_at, CAST(copies AS BIGINT) AS plan_copies", 1))
def q_fact_plan_match_as_executed(spark, d):
    p = Pipeline(spark, d)
    return fact.fact_plan_match_as_executed(p.actual, p.scd_table, keys=p.cycle_keys, headers=p.headers)


@query("fact_with_skipped", fact_rows("fx_matched_and_skipped"))
def q_fact_with_skipped(spark, d):
    p = Pipeline(spark, d)
    return fact.fact_workout_history(p.actual, p.scd_table, include_skipped=True, keys=p.cycle_keys, headers=p.headers)


@query("execution_status", f"""
SELECT execution_status, CAST(COUNT(*) AS BIGINT) AS n FROM ({fact_rows("fx_matched_and_skipped")}) x GROUP BY execution_status""")
def q_execution_status(spark, d):
    p = Pipeline(spark, d)
    f = fact.matched_and_skipped(p.actual, fact.applicable_plan(p.headers, p.scd_table))
    return f.groupBy("execution_status").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


@query("plan_diffs", """
SELECT workout_id, exercise_index, set_index, diff_weight_kg, diff_reps, diff_duration_seconds, diff_custom_metric
FROM fx_fact""")
def q_plan_diffs(spark, d):
    p = Pipeline(spark, d)
    return fact.matched_sets(p.actual, p.scd_table).select(
        "workout_id", "exercise_index", "set_index", "diff_weight_kg", "diff_reps", "diff_duration_seconds", "diff_custom_metric")


@query("cycle_number", """
SELECT exercise_template_id, start_time, cycle_number FROM fx_fact GROUP BY ALL""")
def q_cycle_number(spark, d):
    return dense_rank_keys(Pipeline(spark, d).cycle_keys, ["exercise_template_id"], "start_time", "cycle_number")


@query("cycle_number_per_routine", fact_rows("fx_matched", "exercise_template_id, routine_id"))
def q_cycle_number_per_routine(spark, d):
    p = Pipeline(spark, d)
    return fact.fact_workout_history(p.actual, p.scd_table, per_routine=True, keys=p.cycle_keys)


@query("fact_ordered", "SELECT * FROM fx_fact")
def q_fact_ordered(spark, d):
    return fact.fact_ordered(Pipeline(spark, d).fact)

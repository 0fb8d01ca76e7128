"""Registered queries of the legacy plan assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from liftlake.operators import legacy_plan
from liftlake.plans.normalized_queries import Legacy
from liftlake.plans.oracle_sql import cte
from liftlake.plans.pipeline import Pipeline
from liftlake.plans.registry import query

# Every routine exercise with its planned sets counted and its recommendation.
cte("fx_legacy_ex", """
SELECT f.routine_id, f.title AS routine_title, f.exercise_index AS order_index, f.exercise_template_id, f.supersets_id AS superset_id,
       f.rest_seconds, ifnull(f.exercise_notes, '') AS old_notes, count(*) FILTER (f.set_type = 'normal') AS n_normal,
       any_value(r.routine_id) IS NOT NULL AS has_recommendation, any_value(r.weight_kg) AS target, any_value(r.reps) AS target_reps,
       any_value(r.reasoning) AS reasoning, any_value(r.rpe_target) AS rpe_target
FROM fx_flat_routines f LEFT JOIN fx_recs r USING (routine_id, exercise_template_id)
WHERE f.exercise_index IS NOT NULL GROUP BY ALL""")

cte("fx_legacy_notes", """
SELECT routine_id, order_index, exercise_template_id, superset_id, CAST(rest_seconds AS INTEGER) AS rest_seconds,
       CASE WHEN has_recommendation THEN format('[AI: {}{}] ', reasoning, CASE WHEN ifnull(rpe_target, 0) <> 0 THEN ' RPE ' || rpe_target ELSE '' END)
            ELSE '' END || old_notes AS notes
FROM fx_legacy_ex""")

# The ladder as a list of (share or kilograms, reps) by the target's band.
cte("fx_legacy_sets", """
WITH steps AS (
  SELECT *, unnest(CASE WHEN target < 20 THEN [] WHEN target < 40 THEN [{'kg': target * 0.5, 'reps': 10}]
    WHEN target < 80 THEN [{'kg': 20.0, 'reps': 12}, {'kg': target * 0.6, 'reps': 6}, {'kg': target * 0.8, 'reps': 2}]
    ELSE [{'kg': 20.0, 'reps': 15}, {'kg': target * 0.4, 'reps': 8}, {'kg': target * 0.6, 'reps': 4}, {'kg': target * 0.8, 'reps': 2}, {'kg': target * 0.9, 'reps': 1}]
    END) AS step FROM fx_legacy_ex WHERE has_recommendation),
warm AS (
  SELECT routine_id, order_index, exercise_template_id, round_even(step.kg / 2.5, 0) * 2.5 AS kg, max(step.reps) AS reps, any_value(target) AS target
  FROM steps GROUP BY ALL HAVING kg >= 20 AND kg < any_value(target)),
every AS (
  SELECT routine_id, order_index, exercise_template_id, TRUE AS has_recommendation, 0 AS part, kg AS place, 'warmup' AS set_type, kg AS weight_kg,
         reps, NULL AS distance_meters, NULL AS duration_seconds FROM warm
  UNION ALL
  SELECT routine_id, order_index, exercise_template_id, TRUE, 1, i, 'normal', target, target_reps, NULL, NULL
  FROM (SELECT *, unnest(range(CASE WHEN n_normal > 0 THEN n_normal ELSE 3 END)) AS i FROM fx_legacy_ex WHERE has_recommendation)
  UNION ALL
  SELECT f.routine_id, f.exercise_index, f.exercise_template_id, FALSE, 2, f.set_index, f.set_type, f.weight_kg, f.reps, f.distance_meters, f.duration_seconds
  FROM fx_flat_routines f ANTI JOIN fx_recs r USING (routine_id, exercise_template_id)
  WHERE f.exercise_index IS NOT NULL AND (f.set_index IS NOT NULL OR f.set_type IS NOT NULL))
SELECT routine_id, order_index, exercise_template_id, has_recommendation,
       CAST(row_number() OVER (PARTITION BY routine_id, order_index, exercise_template_id ORDER BY part, place, set_type) - 1 AS INTEGER) AS set_no,
       set_type, CAST(weight_kg AS DOUBLE) AS weight_kg, CAST(reps AS INTEGER) AS reps, CAST(distance_meters AS DOUBLE) AS distance_meters,
       CAST(duration_seconds AS DOUBLE) AS duration_seconds
FROM every""")


def _plans(spark, d):
    lg = Legacy(spark, d)
    return lg, legacy_plan.exercise_plans(lg.flat_routines, Pipeline(spark, d).recommendations)


@query("exercise_plan_rows_legacy", "SELECT * FROM fx_legacy_sets")
def q_exercise_plan_rows_legacy(spark, d):
    """Every next set: warm-up ladder, working sets, copied planned sets."""
    return legacy_plan.set_rows(_plans(spark, d)[1])


@query("carry_over_sets_legacy", "SELECT * EXCLUDE (has_recommendation) FROM fx_legacy_sets WHERE NOT has_recommendation")
def q_carry_over_sets_legacy(spark, d):
    return legacy_plan.set_rows(_plans(spark, d)[1].where(~F.col("has_recommendation"))).drop("has_recommendation")


@query("exercise_notes_legacy", "SELECT * FROM fx_legacy_notes")
def q_exercise_notes_legacy(spark, d):
    return _plans(spark, d)[1].select("routine_id", "order_index", "exercise_template_id", "superset_id", "rest_seconds", "notes")


@query("routine_payload_legacy", """
WITH s AS (
  SELECT routine_id, order_index, exercise_template_id, list(json_object('type', set_type, 'weight_kg', weight_kg, 'reps', reps,
         'distance_meters', distance_meters, 'duration_seconds', duration_seconds) ORDER BY set_no) AS sets
  FROM fx_legacy_sets GROUP BY ALL),
x AS (
  SELECT routine_id, list(json_object('exercise_template_id', exercise_template_id, 'superset_id', superset_id, 'rest_seconds', rest_seconds,
         'notes', notes, 'sets', ifnull(sets, [])) ORDER BY order_index, exercise_template_id) AS exercises
  FROM fx_legacy_notes LEFT JOIN s USING (routine_id, order_index, exercise_template_id) GROUP BY ALL)
SELECT routine_id, CAST(json_object('routine', json_object('title', title, 'notes', 'AI Plan: ' || strftime((SELECT max(start_time) FROM fx_workouts), '%Y-%m-%d'),
       'exercises', ifnull(exercises, []))) AS VARCHAR) AS payload_json
FROM (SELECT DISTINCT routine_id, title FROM fx_flat_routines) LEFT JOIN x USING (routine_id)""")
def q_routine_payload_legacy(spark, d):
    lg, plans = _plans(spark, d)
    run_date = Pipeline(spark, d).bronze.workouts.select(F.max("start_time")).scalar()
    return legacy_plan.payloads(lg.flat_routines, plans, run_date)

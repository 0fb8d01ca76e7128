"""Registered dashboard queries (J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from liftlake.operators import dashboards as db
from liftlake.plans.oracle_sql import cte
from liftlake.plans.pipeline import Pipeline
from liftlake.plans.registry import query

# Sets that the progress views count, one list of (kg, reps) for each cycle.
cte("fx_cycle_sets", """
SELECT exercise_name, routine_name, cycle_number, list({'kg': weight_kg, 'reps': reps}) AS lifts
FROM fx_named WHERE set_type = 'normal' AND exercise_name IS NOT NULL AND routine_name IS NOT NULL GROUP BY ALL""")

cte("fx_workout_stats", """
SELECT exercise_name, routine_name, cycle_number, list_max([s.kg FOR s IN lifts]) AS max_weight_kg,
       list_sum([s.kg * s.reps FOR s IN lifts]) AS total_volume_kg,
       list_max([s.kg * (1 + s.reps / 30.0::DOUBLE) FOR s IN lifts IF s.kg IS NOT NULL AND s.reps IS NOT NULL]) AS estimated_1rm_kg
FROM fx_cycle_sets""")

# The cycle before is the nearest smaller number.
cte("fx_prog_dash", """
SELECT now.exercise_name, now.routine_name, now.cycle_number, now.max_weight_kg, ROUND(now.estimated_1rm_kg, 2) AS estimated_1rm_kg,
       now.total_volume_kg, now.max_weight_kg - last.max_weight_kg AS weight_progression,
       ROUND(now.estimated_1rm_kg - last.estimated_1rm_kg, 2) AS rep_max_progression,
       now.total_volume_kg - last.total_volume_kg AS volume_progression
FROM fx_workout_stats now ASOF LEFT JOIN fx_workout_stats last
  ON now.exercise_name = last.exercise_name AND now.routine_name = last.routine_name AND now.cycle_number > last.cycle_number""")

cte("fx_detail", """
SELECT workout_id, routine_id, start_time, set_type, weight_kg, reps, rpe, execution_status, exercise_name AS exercise_title,
       routine_name AS workout_title, start_time::DATE AS workout_date,
       concat(year(start_time), '-W', lpad(CAST(week(start_time) AS VARCHAR), 2, '0')) AS year_week, ifnull(weight_kg * reps, 0) AS volume
FROM fx_named""")

cte("fx_normal_sets", """
SELECT * REPLACE (COALESCE(set_type, 'normal') AS set_type) FROM fx_detail
WHERE lower(COALESCE(set_type, 'normal')) = 'normal'
   OR NOT EXISTS (SELECT 1 FROM fx_detail WHERE lower(COALESCE(set_type, 'normal')) = 'normal')""")


def _prog(spark, d):
    p = Pipeline(spark, d)
    return db.progression(db.workout_stats(p.fact_table, p.dim_exercise, p.dim_routine))


def _detail(spark, d):
    p = Pipeline(spark, d)
    return db.workout_detail(p.fact_table, p.dim_exercise, p.dim_routine)


@query("workout_stats", "SELECT * FROM fx_workout_stats")
def q_workout_stats(spark, d):
    p = Pipeline(spark, d)
    return db.workout_stats(p.fact_table, p.dim_exercise, p.dim_routine)


@query("progression", "SELECT * FROM fx_prog_dash")
def q_progression(spark, d):
    return _prog(spark, d)


@query("execution_vs_plan", """
WITH planned AS (
  SELECT exercise_name, routine_name, cycle_number, list(ifnull(diff_weight_kg, 0)) AS gaps
  FROM fx_named WHERE set_type = 'normal' AND planned_weight_kg IS NOT NULL AND exercise_name IS NOT NULL AND routine_name IS NOT NULL
  GROUP BY ALL)
SELECT exercise_name, routine_name, cycle_number, CAST(len(gaps) AS BIGINT) AS total_sets_performed,
       ROUND(list_sum(gaps) / len(gaps), 2) AS avg_weight_vs_plan_kg
FROM planned""")
def q_execution_vs_plan(spark, d):
    p = Pipeline(spark, d)
    return db.execution_vs_plan(p.fact_table, p.dim_exercise, p.dim_routine)


@query("plateau_detection", """
WITH n AS (SELECT exercise_name, routine_name, CAST(COUNT(*) AS BIGINT) AS n_cycles
           FROM fx_prog_dash GROUP BY exercise_name, routine_name),
nn AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY exercise_name, routine_name ORDER BY cycle_number DESC) AS r
       FROM fx_prog_dash WHERE rep_max_progression IS NOT NULL),
l AS (SELECT exercise_name, routine_name, COUNT(*) AS k, MAX(rep_max_progression) AS worst,
             MAX(CASE WHEN r = 1 THEN rep_max_progression END) AS last_delta,
             MAX(CASE WHEN r = 2 THEN rep_max_progression END) AS previous_delta
      FROM nn WHERE r <= 2 GROUP BY exercise_name, routine_name)
SELECT n.exercise_name, n.routine_name, n.n_cycles,
       CASE WHEN l.k = 2 THEN l.last_delta END AS last_delta,
       CASE WHEN l.k = 2 THEN l.previous_delta END AS previous_delta,
       COALESCE(n.n_cycles >= 3 AND l.k = 2 AND l.worst <= 0, FALSE) AS is_plateau
FROM n LEFT JOIN l ON n.exercise_name IS NOT DISTINCT FROM l.exercise_name
                  AND n.routine_name IS NOT DISTINCT FROM l.routine_name""")
def q_plateau_detection(spark, d):
    return db.plateaus(_prog(spark, d))


@query("latest_exercise_kpis", """
SELECT exercise_name, routine_name, cycle_number, estimated_1rm_kg,
       COALESCE(rep_max_progression, 0.0) AS e1rm_delta, total_volume_kg,
       COALESCE(volume_progression, 0.0) AS volume_delta, max_weight_kg,
       COALESCE(weight_progression, 0.0) AS weight_delta
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY exercise_name, routine_name ORDER BY cycle_number DESC) AS r
      FROM fx_prog_dash) x WHERE r = 1""")
def q_latest_exercise_kpis(spark, d):
    return db.latest_kpis(_prog(spark, d))


cte("fx_default_routine", """
SELECT routine_name FROM fx_prog_dash WHERE routine_name IS NOT NULL
ORDER BY exercise_name NULLS FIRST, routine_name, cycle_number LIMIT 1""")


@query("progression_filtered", """
SELECT * FROM fx_prog_dash WHERE routine_name = (SELECT routine_name FROM fx_default_routine)""")
def q_progression_filtered(spark, d):
    prog = _prog(spark, d)
    return db.filter_progression(prog, db.default_routine(prog))


@query("filter_options", """
SELECT DISTINCT * FROM (
  SELECT 'routine' AS option_type, routine_name AS option_value FROM fx_prog_dash
  UNION ALL SELECT 'exercise', exercise_name FROM fx_prog_dash
            WHERE routine_name = (SELECT routine_name FROM fx_default_routine)
  UNION ALL SELECT 'cycle', CAST(cycle_number AS VARCHAR) FROM fx_prog_dash) x
WHERE option_value IS NOT NULL""")
def q_filter_options(spark, d):
    prog = _prog(spark, d)
    return db.filter_options(prog, db.default_routine(prog))


@query("last_ingestion", "SELECT MAX(ingestion_timestamp) AS last_update FROM fx_workouts")
def q_last_ingestion(spark, d):
    return db.last_ingestion(Pipeline(spark, d).bronze.workouts)


@query("workout_detail_frame", "SELECT * FROM fx_detail")
def q_workout_detail_frame(spark, d):
    return _detail(spark, d)


@query("normal_sets_or_all", "SELECT * FROM fx_normal_sets")
def q_normal_sets_or_all(spark, d):
    return db.normal_or_all(_detail(spark, d))


@query("global_kpis", """
SELECT SUM(volume) / 1000 AS total_volume_t, CAST(COUNT(DISTINCT workout_id) AS BIGINT) AS total_workouts,
       CAST(COUNT(*) AS BIGINT) AS total_sets, AVG(TRY_CAST(CAST(rpe AS VARCHAR) AS DOUBLE)) AS avg_rpe
FROM fx_normal_sets""")
def q_global_kpis(spark, d):
    return db.global_kpis(db.normal_or_all(_detail(spark, d)))


@query("weekly_volume", """
SELECT year_week, SUM(volume) AS volume, SUM(volume) / 1000 AS volume_t
FROM fx_normal_sets WHERE year_week IS NOT NULL GROUP BY year_week""")
def q_weekly_volume(spark, d):
    return db.weekly_volume(db.normal_or_all(_detail(spark, d)))


@query("top_exercises", """
SELECT exercise_title AS exercise, CAST(COUNT(*) AS BIGINT) AS sets
FROM fx_normal_sets WHERE exercise_title IS NOT NULL GROUP BY exercise_title
ORDER BY sets DESC, exercise ASC LIMIT 10""")
def q_top_exercises(spark, d):
    return db.top_exercises(db.normal_or_all(_detail(spark, d)))


@query("recent_sets", """
SELECT workout_date, workout_title, exercise_title, weight_kg, reps, rpe, execution_status, volume
FROM fx_normal_sets""")
def q_recent_sets(spark, d):
    return db.recent_sets(db.normal_or_all(_detail(spark, d)))


@query("e1rm_dashboard", """
SELECT f.workout_id, f.exercise_index, f.set_index, f.weight_kg * (1 + (CAST(f.reps AS DOUBLE) / 30.0)) AS e1rm
FROM fx_fact f""")
def q_e1rm_dashboard(spark, d):
    from liftlake.functions.metrics import e1rm
    f = Pipeline(spark, d).fact_table
    return f.select("workout_id", "exercise_index", "set_index",
                    e1rm(F.col("weight_kg"), F.col("reps"), single_rep_exact=False).alias("e1rm"))

"""Registered coach queries (K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from liftlake.functions.calendar import PHASE_COLS, PHASES, with_phase
from liftlake.functions.metrics import e1rm
from liftlake.operators import coach, plan, prompts
from liftlake.plans.oracle_sql import cte
from liftlake.plans.pipeline import Pipeline
from liftlake.plans.registry import query

cte("fx_recent", """
SELECT * FROM (
  SELECT s.workout_id, s.exercise_index, s.set_index, s.weight_kg, s.reps, s.rpe, e.exercise_template_id, w.start_time,
         CAST(ROW_NUMBER() OVER (PARTITION BY e.exercise_template_id
              ORDER BY w.start_time DESC NULLS LAST, s.workout_id, s.exercise_index, s.set_index) AS INTEGER) AS rn
  FROM fx_workout_sets s
  JOIN fx_workout_exercises e ON s.workout_id = e.workout_id AND s.exercise_index = e.exercise_index
  JOIN fx_workouts w ON s.workout_id = w.workout_id
  WHERE s.set_type = 'normal') x
WHERE rn <= 20""")

cte("fx_sessions", """
SELECT exercise_template_id, session_no, date, weight, reps, rpe FROM (
  SELECT exercise_template_id, date, weight_kg AS weight, reps, rpe,
         CAST(ROW_NUMBER() OVER (PARTITION BY exercise_template_id ORDER BY date DESC) AS INTEGER) AS session_no
  FROM (SELECT *, CAST(start_time AS DATE) AS date,
               ROW_NUMBER() OVER (PARTITION BY exercise_template_id, CAST(start_time AS DATE)
                 ORDER BY COALESCE(weight_kg, 0) DESC, COALESCE(reps, 0) DESC, rn ASC) AS b
        FROM fx_recent) y
  WHERE b = 1) z
WHERE session_no <= 5""")

cte("fx_stall", """
WITH n AS (SELECT exercise_template_id, COUNT(*) AS n_sessions FROM fx_sessions GROUP BY exercise_template_id),
p AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY exercise_template_id ORDER BY session_no) AS k,
             CASE WHEN reps = 1 THEN CAST(weight AS DOUBLE) ELSE weight * (1 + CAST(reps AS DOUBLE) / 30.0) END AS e1rm,
             CASE WHEN rpe <> 0 THEN rpe END AS rpe_v
      FROM fx_sessions WHERE weight IS NOT NULL AND reps IS NOT NULL),
q AS (SELECT *, LEAD(e1rm) OVER (PARTITION BY exercise_template_id ORDER BY k) AS next_e1rm FROM p),
a AS (SELECT exercise_template_id, COUNT(*) AS n_proc, MAX(CASE WHEN k = 1 THEN e1rm END) AS cur,
             AVG(CASE WHEN k <= 3 THEN rpe_v END) AS avg_rpe,
             MIN(CASE WHEN NOT (next_e1rm IS NOT NULL AND e1rm <= next_e1rm * 1.01 AND COALESCE(rpe_v, 0) >= 8.5)
                      THEN k END) AS first_miss,
             list(e1rm ORDER BY k) AS es
      FROM q GROUP BY exercise_template_id),
m AS (SELECT exercise_template_id, n_proc, cur,
             CASE WHEN es[LEAST(n_proc - 1, 3) + 1] > 0 THEN (cur - es[LEAST(n_proc - 1, 3) + 1]) / es[LEAST(n_proc - 1, 3) + 1] * 100
                  ELSE 0.0 END AS trend,
             COALESCE(avg_rpe, 0.0) AS avg_rpe, COALESCE(first_miss, n_proc) - 1 AS streak
      FROM a),
j AS (SELECT n.exercise_template_id, n.n_sessions, m.n_proc, m.cur, m.trend, m.avg_rpe, m.streak,
             CASE WHEN m.trend < -5.0 THEN 0 WHEN m.streak >= 2 AND m.avg_rpe >= 9.0 THEN 1
                  WHEN m.streak >= 2 AND m.avg_rpe < 7.0 THEN 2 WHEN m.streak >= 3 THEN 3
                  WHEN m.trend > 5.0 THEN 4 ELSE 5 END AS s
      FROM n LEFT JOIN m ON n.exercise_template_id = m.exercise_template_id)
SELECT exercise_template_id,
       CAST(CASE WHEN n_sessions < 2 THEN 0 WHEN COALESCE(n_proc, 0) = 0 THEN NULL ELSE streak END AS INTEGER) AS stall_streak,
       CASE WHEN n_sessions < 2 THEN 0.0 WHEN COALESCE(n_proc, 0) = 0 THEN NULL ELSE round_even(cur, 1) END AS e1rm_current,
       CASE WHEN n_sessions < 2 THEN 0.0 WHEN COALESCE(n_proc, 0) = 0 THEN NULL ELSE round_even(trend, 1) END AS e1rm_trend_percent,
       CASE WHEN n_sessions < 2 THEN 0.0 WHEN COALESCE(n_proc, 0) = 0 THEN NULL ELSE round_even(avg_rpe, 1) END AS avg_rpe_last_3,
       CASE WHEN n_sessions < 2 THEN 'NEW' WHEN COALESCE(n_proc, 0) = 0 THEN 'ERROR'
            ELSE ['REGRESSION', 'GRINDING', 'SANDBAGGING', 'STAGNATION', 'FAST_GAINS', 'PROGRESS'][s + 1] END AS status,
       CASE WHEN n_sessions < 2 THEN 'LINEAR_LOAD' WHEN COALESCE(n_proc, 0) = 0 THEN 'MAINTAIN'
            ELSE ['RESET', 'DELOAD', 'PUSH_HARDER', 'CHANGE_REP_RANGE', 'AGGRESSIVE_LOAD', 'LINEAR_LOAD'][s + 1] END
         AS recommended_action
FROM j""")


@query("recent_sets_per_exercise", """
SELECT workout_id, exercise_index, set_index, weight_kg, reps, rpe, exercise_template_id, start_time, rn FROM fx_recent""")
def q_recent_sets_per_exercise(spark, d):
    return Pipeline(spark, d).recent_sets


@query("session_history", "SELECT * FROM fx_sessions")
def q_session_history(spark, d):
    return Pipeline(spark, d).sessions


@query("e1rm_epley", """
SELECT exercise_template_id, session_no,
       CASE WHEN reps = 1 THEN CAST(weight AS DOUBLE) ELSE weight * (1 + CAST(reps AS DOUBLE) / 30.0) END AS e1rm
FROM fx_sessions""")
def q_e1rm_epley(spark, d):
    h = Pipeline(spark, d).sessions
    return h.select("exercise_template_id", "session_no", e1rm(F.col("weight"), F.col("reps")).alias("e1rm"))


@query("stall_analysis", "SELECT * FROM fx_stall")
def q_stall_analysis(spark, d):
    return Pipeline(spark, d).stall


@query("stall_streak", "SELECT exercise_template_id, stall_streak FROM fx_stall")
def q_stall_streak(spark, d):
    return Pipeline(spark, d).stall.select("exercise_template_id", "stall_streak")


@query("progress_status", "SELECT exercise_template_id, status, recommended_action FROM fx_stall")
def q_progress_status(spark, d):
    return Pipeline(spark, d).stall.select("exercise_template_id", "status", "recommended_action")


def _phase_case(i: int) -> str:
    whens = " ".join(f"WHEN {p[0]} THEN '{p[i]}'" for p in PHASES)
    return f"CASE ((weekofyear(start_time) - 1) % 4) + 1 {whens} END"


@query("periodization_phase", f"""
SELECT workout_id, start_time, CAST(((weekofyear(start_time) - 1) % 4) + 1 AS BIGINT) AS phase_week,
       {", ".join(f"{_phase_case(i)} AS {c}" for i, c in enumerate(PHASE_COLS) if i > 0)}
FROM fx_workouts""")
def q_periodization_phase(spark, d):
    w = Pipeline(spark, d).bronze.workouts.select("workout_id", "start_time")
    return with_phase(w, "start_time")


@query("cycle_phase", """
SELECT routine_id, CAST(COALESCE(MAX(cycle_number), 0) + 1 AS INTEGER) AS next_cycle,
       CASE WHEN (COALESCE(MAX(cycle_number), 0) + 1) % 4 = 0 THEN 'DELOAD' ELSE 'PROGRESSION' END AS phase
FROM fx_gold GROUP BY routine_id""")
def q_cycle_phase(spark, d):
    return coach.cycle_phase(Pipeline(spark, d).gold_table)


cte("fx_ex_head", """
SELECT routine_id, routine_name AS routine_title, exercise_template_id, exercise_index, superset_id,
       exercise_name AS title, primary_muscle_group, progression_step_kg, planned_rest AS rest_seconds, last_cycle
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY routine_id, exercise_template_id
                 ORDER BY cycle_number, exercise_index NULLS FIRST, set_index, set_type, planned_rest NULLS FIRST) AS r,
             MAX(cycle_number) OVER (PARTITION BY routine_id, exercise_template_id) AS last_cycle
      FROM fx_gold) x
WHERE r = 1""")

cte("fx_docs", """
SELECT g.routine_id, h.routine_title, g.exercise_template_id, h.exercise_index, h.superset_id, h.title,
       h.primary_muscle_group, h.progression_step_kg, h.rest_seconds, g.cycle_number AS cycle, g.set_index, g.set_type,
       g.actual_weight_kg, g.actual_reps, g.rpe, g.planned_weight_kg, g.planned_reps, g.execution_status,
       g.diff_weight_kg, g.diff_reps, h.last_cycle
FROM fx_gold g JOIN fx_ex_head h ON g.routine_id = h.routine_id AND g.exercise_template_id = h.exercise_template_id""")


@query("routine_document", """
SELECT * EXCLUDE (last_cycle) FROM fx_docs""")
def q_routine_document(spark, d):
    return coach.routine_documents(Pipeline(spark, d).gold_table)


def _txt(c: str, none: str = "None") -> str:
    return f"COALESCE(CAST({c} AS VARCHAR), '{none}')"


_LINE = f"""'  Set ' || {_txt('set_index')} || ': Planned ' || {_txt('planned_weight_kg', 'N/A')} || 'kg x '
       || {_txt('planned_reps', 'N/A')} || ' | Actual: ' || {_txt('actual_weight_kg', 'Bodyweight')} || 'kg x '
       || {_txt('actual_reps', 'Skipped')} || ' @ RPE ' || {_txt('rpe')} || ' | Status: '
       || {_txt('execution_status')}"""


def _filled(template: str, values: dict[str, str]) -> str:
    """SQL of a fixed template with its placeholders replaced by expressions."""
    out = "'" + template.replace("'", "''") + "'"
    for name, value in values.items():
        out = f"replace({out}, '{{{name}}}', {value})"
    return out


@query("prompt_lines", f"""
SELECT routine_id, exercise_template_id, exercise_index, superset_id, title, progression_step_kg, cycle, set_index,
       set_type, {_LINE} AS line
FROM fx_docs WHERE cycle = last_cycle""")
def q_prompt_lines(spark, d):
    return prompts.prompt_lines(Pipeline(spark, d).gold_table)


_SYSTEM = _filled(prompts.SYSTEM_TEMPLATE, {"phase_name": "phase", "next_cycle": "CAST(next_cycle AS VARCHAR)"})


@query("routine_prompt", f"""
WITH b AS (
  SELECT routine_id, exercise_template_id, exercise_index,
         format('\nExercise: {{}} (ID: {{}}, Index: {{}}{{}})\nProgression Step: {{}} kg\nLast Cycle (# {{}}) Results:\n{{}}\n', {_txt('title')},
                exercise_template_id, {_txt('exercise_index')}, ifnull(', Superset ID: ' || superset_id, ''), {_txt('progression_step_kg')}, cycle,
                string_agg({_LINE}, chr(10) ORDER BY set_index, set_type, {_LINE})) AS block
  FROM fx_docs WHERE cycle = last_cycle
  GROUP BY routine_id, exercise_template_id, exercise_index, superset_id, title, progression_step_kg, cycle),
n AS (SELECT routine_id, CAST(ifnull(max(cycle_number), 0) + 1 AS INTEGER) AS next_cycle, if(next_cycle % 4 = 0, 'DELOAD', 'PROGRESSION') AS phase
      FROM fx_gold GROUP BY routine_id)
SELECT routine_id, next_cycle, phase, {_SYSTEM} || '\n\n{prompts.HISTORY_HEADER}' || blocks AS prompt
FROM (SELECT routine_id, string_agg(block, '' ORDER BY exercise_index NULLS LAST, exercise_template_id) AS blocks FROM b GROUP BY 1) JOIN n USING (routine_id)""")
def q_routine_prompt(spark, d):
    return prompts.routine_prompts(Pipeline(spark, d).gold_table)


cte("fx_recs", """
WITH last AS (SELECT g.* FROM fx_gold g JOIN (SELECT routine_id, exercise_template_id, MAX(cycle_number) AS c
                                              FROM fx_gold GROUP BY routine_id, exercise_template_id) l
                ON g.routine_id = l.routine_id AND g.exercise_template_id = l.exercise_template_id AND g.cycle_number = l.c),
e AS (SELECT routine_id, exercise_template_id, MIN(exercise_index) AS idx, MAX(superset_id) AS ss,
             MAX(actual_weight_kg) AS w, MAX(actual_reps) AS r, MAX(progression_step_kg) AS step
      FROM last GROUP BY routine_id, exercise_template_id)
SELECT routine_id, exercise_template_id,
       CAST(COALESCE(w, 0.0) + COALESCE(step, 0.0) AS DOUBLE) AS weight_kg, CAST(COALESCE(r, 8) AS INTEGER) AS reps,
       CAST(8.0 AS DOUBLE) AS rpe_target, 'LINEAR_LOAD' AS strategy,
       CAST(CASE WHEN idx = 0 THEN 210 WHEN ss IS NOT NULL THEN 90 ELSE 120 END AS INTEGER) AS rest_seconds,
       'Add ' || CAST(COALESCE(step, 0.0) AS VARCHAR) || ' kg' AS reasoning
FROM e
WHERE COALESCE(idx, -1) <> 3 AND CAST(routine_id AS BIGINT) % 13 <> 0""")


@query("parse_recommendations", "SELECT * FROM fx_recs")
def q_parse_recommendations(spark, d):
    return Pipeline(spark, d).recommendations


@query("validate_recommendations", """
SELECT DISTINCT routine_id, 'invalid recommendations' AS reason FROM fx_gold
WHERE CAST(routine_id AS BIGINT) % 13 = 0
  AND routine_id IN (SELECT routine_id FROM fx_ex_head WHERE COALESCE(exercise_index, -1) <> 3)""")
def q_validate_recommendations(spark, d):
    return plan.rejected_recommendations(Pipeline(spark, d).replies)


@query("plan_summary", """
SELECT r.routine_id, r.exercise_template_id,
       COALESCE(CAST(h.title AS VARCHAR), 'None') || ': ' || CAST(r.weight_kg AS VARCHAR) || 'kg x '
       || CAST(r.reps AS VARCHAR) || ' (' || r.strategy || ')' AS line
FROM fx_recs r JOIN fx_ex_head h ON r.routine_id = h.routine_id AND r.exercise_template_id = h.exercise_template_id""")
def q_plan_summary(spark, d):
    p = Pipeline(spark, d)
    return plan.plan_summary(p.gold_table, p.recommendations)


@query("plan_summary_legacy", """
SELECT r.routine_id, r.exercise_template_id,
       COALESCE(h.title, 'Unknown') || ': ' || CAST(r.weight_kg AS VARCHAR) || 'kg x '
       || CAST(r.reps AS VARCHAR) || ' (' || r.strategy || ')' AS line
FROM fx_recs r LEFT JOIN fx_ex_head h ON r.routine_id = h.routine_id AND r.exercise_template_id = h.exercise_template_id""")
def q_plan_summary_legacy(spark, d):
    p = Pipeline(spark, d)
    return plan.plan_summary(p.gold_table, p.recommendations, legacy=True)


@query("warmup_ladder", """
WITH c AS (
  SELECT r.routine_id, r.exercise_template_id, r.weight_kg AS t, v.pos, v.reps,
         round_even(CASE WHEN v.absolute THEN v.f ELSE r.weight_kg * v.f END / 2.5, 0) * 2.5 AS w
  FROM fx_recs r JOIN (VALUES
     ('a', 0, 0.5, 10, FALSE),
     ('b', 0, 20.0, 12, TRUE), ('b', 1, 0.6, 6, FALSE), ('b', 2, 0.8, 2, FALSE),
     ('c', 0, 20.0, 15, TRUE), ('c', 1, 0.4, 8, FALSE), ('c', 2, 0.6, 4, FALSE), ('c', 3, 0.8, 2, FALSE),
     ('c', 4, 0.9, 1, FALSE)) v(band, pos, f, reps, absolute)
    ON v.band = CASE WHEN r.weight_kg < 20 THEN 'none' WHEN r.weight_kg < 40 THEN 'a'
                     WHEN r.weight_kg < 80 THEN 'b' ELSE 'c' END),
k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY routine_id, exercise_template_id, w ORDER BY pos) AS f
      FROM c WHERE w >= 20 AND w < t)
SELECT routine_id, exercise_template_id, t AS target_weight_kg,
       CAST(ROW_NUMBER() OVER (PARTITION BY routine_id, exercise_template_id ORDER BY w, reps) - 1 AS INTEGER) AS warmup_no,
       CAST(w AS DOUBLE) AS weight_kg, CAST(reps AS INTEGER) AS reps
FROM k WHERE f = 1""")
def q_warmup_ladder(spark, d):
    return plan.warmup_rows(Pipeline(spark, d).recommendations, ladder=True)


@query("warmup_single", """
SELECT routine_id, exercise_template_id, weight_kg AS target_weight_kg, 0 AS warmup_no,
       round_even(weight_kg * 0.5 / 2.5, 0) * 2.5 AS weight_kg, 10 AS reps
FROM fx_recs WHERE weight_kg > 0 AND round_even(weight_kg * 0.5 / 2.5, 0) * 2.5 >= 5""")
def q_warmup_single(spark, d):
    return plan.warmup_rows(Pipeline(spark, d).recommendations, ladder=False)


cte("fx_plan_rows", """
WITH head AS (SELECT * FROM fx_ex_head),
last AS (SELECT * FROM fx_docs WHERE cycle = last_cycle),
ls AS (SELECT routine_id, exercise_template_id, SUM(CASE WHEN set_type = 'normal' THEN 1 ELSE 0 END) AS n_normal
       FROM last GROUP BY routine_id, exercise_template_id),
rec AS (SELECT h.routine_id, h.exercise_template_id, r.weight_kg, r.reps, r.rpe_target, r.rest_seconds, r.reasoning,
               COALESCE(ls.n_normal, 3) AS n_work,
               CASE WHEN r.weight_kg > 0 AND round_even(r.weight_kg * 0.5 / 2.5, 0) * 2.5 >= 5 THEN 1 ELSE 0 END AS n_warm
        FROM head h JOIN fx_recs r ON h.routine_id = r.routine_id AND h.exercise_template_id = r.exercise_template_id
        LEFT JOIN ls ON ls.routine_id = h.routine_id AND ls.exercise_template_id = h.exercise_template_id),
rec_rows AS (
  SELECT routine_id, exercise_template_id, rest_seconds,
         '[AI: ' || reasoning || CASE WHEN rpe_target IS NOT NULL AND rpe_target <> 0
                                      THEN ' RPE ' || CAST(rpe_target AS VARCHAR) ELSE '' END || ']' AS notes,
         TRUE AS has_recommendation, 0 AS set_no, 'warmup' AS set_type,
         round_even(weight_kg * 0.5 / 2.5, 0) * 2.5 AS weight_kg, 10 AS reps,
         CAST(NULL AS INTEGER) AS rep_range_start, CAST(NULL AS INTEGER) AS rep_range_end
  FROM rec WHERE n_warm = 1
  UNION ALL
  SELECT routine_id, exercise_template_id, rest_seconds,
         '[AI: ' || reasoning || CASE WHEN rpe_target IS NOT NULL AND rpe_target <> 0
                                      THEN ' RPE ' || CAST(rpe_target AS VARCHAR) ELSE '' END || ']',
         TRUE, n_warm + g.i - 1, 'normal', weight_kg, CAST(NULL AS INTEGER), GREATEST(1, reps - 2), reps + 2
  FROM rec, generate_series(1, CAST(rec.n_work AS BIGINT)) g(i)),
copy_rows AS (
  SELECT l.routine_id, l.exercise_template_id, h.rest_seconds, '' AS notes, FALSE AS has_recommendation,
         ROW_NUMBER() OVER (PARTITION BY l.routine_id, l.exercise_template_id
           ORDER BY l.set_index, l.set_type, COALESCE(NULLIF(l.planned_weight_kg, 0.0), l.actual_weight_kg) NULLS FIRST,
                    COALESCE(NULLIF(l.planned_reps, 0), l.actual_reps) NULLS FIRST) - 1 AS set_no,
         l.set_type, COALESCE(NULLIF(l.planned_weight_kg, 0.0), l.actual_weight_kg) AS weight_kg,
         COALESCE(NULLIF(l.planned_reps, 0), l.actual_reps) AS reps,
         CAST(NULL AS INTEGER) AS rep_range_start, CAST(NULL AS INTEGER) AS rep_range_end
  FROM last l JOIN head h ON l.routine_id = h.routine_id AND l.exercise_template_id = h.exercise_template_id
  WHERE NOT EXISTS (SELECT 1 FROM fx_recs r WHERE r.routine_id = l.routine_id
                    AND r.exercise_template_id = l.exercise_template_id))
SELECT routine_id, exercise_template_id, CAST(rest_seconds AS INTEGER) AS rest_seconds, notes, has_recommendation,
       CAST(set_no AS INTEGER) AS set_no, set_type, CAST(weight_kg AS DOUBLE) AS weight_kg,
       CAST(reps AS INTEGER) AS reps, CAST(rep_range_start AS INTEGER) AS rep_range_start,
       CAST(rep_range_end AS INTEGER) AS rep_range_end
FROM (SELECT * FROM rec_rows UNION ALL SELECT * FROM copy_rows) x""")


@query("target_sets", "SELECT * FROM fx_plan_rows WHERE has_recommendation AND set_type = 'normal'")
def q_target_sets(spark, d):
    p = Pipeline(spark, d)
    r = plan.exercise_plan_rows(p.gold_table, p.recommendations)
    return r.filter(F.col("has_recommendation") & (F.col("set_type") == "normal"))


@query("carry_over_sets", "SELECT * FROM fx_plan_rows WHERE NOT has_recommendation")
def q_carry_over_sets(spark, d):
    p = Pipeline(spark, d)
    return plan.exercise_plan_rows(p.gold_table, p.recommendations).filter(~F.col("has_recommendation"))


@query("exercise_notes", "SELECT DISTINCT routine_id, exercise_template_id, rest_seconds, notes FROM fx_plan_rows")
def q_exercise_notes(spark, d):
    p = Pipeline(spark, d)
    return (plan.exercise_plan_rows(p.gold_table, p.recommendations)
            .select("routine_id", "exercise_template_id", "rest_seconds", "notes").distinct())


@query("exercise_plan_rows", "SELECT * FROM fx_plan_rows")
def q_exercise_plan_rows(spark, d):
    p = Pipeline(spark, d)
    return plan.exercise_plan_rows(p.gold_table, p.recommendations)


@query("target_sets_legacy", """
WITH n AS (SELECT routine_id, exercise_template_id, SUM(CASE WHEN set_type = 'normal' THEN 1 ELSE 0 END) AS n_normal
           FROM fx_routine_details GROUP BY routine_id, exercise_template_id)
SELECT r.routine_id, r.exercise_template_id, CAST(g.i AS INTEGER) AS set_no, 'normal' AS set_type, r.weight_kg, r.reps
FROM fx_recs r LEFT JOIN n ON r.routine_id = n.routine_id AND r.exercise_template_id = n.exercise_template_id,
     generate_series(1, CAST(CASE WHEN COALESCE(n.n_normal, 0) > 0 THEN n.n_normal ELSE 3 END AS BIGINT)) g(i)""")
def q_target_sets_legacy(spark, d):
    p = Pipeline(spark, d)
    return plan.target_sets_legacy(p.bronze.routine_details, p.recommendations)


@query("routine_payload", """
WITH s AS (
  SELECT routine_id, exercise_template_id, string_agg('{' || concat_ws(',', '"type":' || to_json(set_type), '"weight_kg":' || weight_kg,
         '"reps":' || reps, format('"rep_range":{{"start":{},"end":{}}}', rep_range_start, rep_range_end)) || '}', ',' ORDER BY set_no) AS sets,
         count(*) = count(set_type) AS typed
  FROM fx_plan_rows GROUP BY ALL),
x AS (
  SELECT h.routine_id, h.routine_title, h.exercise_index, h.exercise_template_id, ifnull(typed, TRUE) AS typed,
         '{' || concat_ws(',', '"exercise_template_id":' || to_json(h.exercise_template_id), '"superset_id":' || CAST(h.superset_id AS INTEGER),
         '"rest_seconds":' || CASE WHEN r.routine_id IS NULL THEN h.rest_seconds ELSE r.rest_seconds END,
         '"notes":' || to_json(CASE WHEN r.routine_id IS NULL THEN '' ELSE '[AI: ' || r.reasoning ||
           CASE WHEN ifnull(r.rpe_target, 0) <> 0 THEN ' RPE ' || r.rpe_target ELSE '' END || ']' END),
         '"sets":[' || ifnull(sets, '') || ']') || '}' AS exercise
  FROM fx_ex_head h LEFT JOIN s USING (routine_id, exercise_template_id) LEFT JOIN fx_recs r USING (routine_id, exercise_template_id))
SELECT routine_id, routine_title IS NOT NULL AND bool_and(typed) AS is_valid,
       '{"routine":{' || concat_ws(',', '"title":' || to_json(routine_title), '"notes":"AI Plan: ' || strftime((SELECT max(start_time) FROM fx_workouts), '%Y-%m-%d') || '"',
       '"exercises":[' || string_agg(exercise, ',' ORDER BY exercise_index NULLS LAST, exercise_template_id) || ']') || '}}' AS payload_json
FROM x GROUP BY routine_id, routine_title""")
def q_routine_payload(spark, d):
    p = Pipeline(spark, d)
    run_date = p.bronze.workouts.select(F.max("start_time")).scalar()
    return plan.routine_payloads(p.gold_table, p.recommendations, run_date)


@query("validate_payload", "SELECT DISTINCT routine_id, TRUE AS is_valid FROM fx_ex_head")
def q_validate_payload(spark, d):
    p = Pipeline(spark, d)
    run_date = p.bronze.workouts.select(F.max("start_time")).scalar()
    return plan.routine_payloads(p.gold_table, p.recommendations, run_date).select("routine_id", "is_valid")


cte("fx_coach_context", """
WITH e AS (
  SELECT DISTINCT d.routine_id, d.exercise_index AS order_index, d.exercise_template_id, t.title AS name, ifnull(nullif(p.progression_step_kg, 0), 2.5) AS base_increment
  FROM fx_routine_details d LEFT JOIN fx_templates t ON t.id = d.exercise_template_id LEFT JOIN fx_progression p ON p.exercise_name = t.title),
h AS (SELECT exercise_template_id, list(json_object('date', CAST(date AS VARCHAR), 'weight', CAST(weight AS DOUBLE), 'reps', reps, 'rpe', CAST(rpe AS DOUBLE))
             ORDER BY session_no) AS sessions FROM fx_sessions WHERE session_no <= 3 GROUP BY 1),
c AS (
  SELECT routine_id, order_index, exercise_template_id, json_object('id', exercise_template_id, 'name', name, 'base_increment', CAST(base_increment AS DOUBLE),
    'analytics', CASE WHEN a.status IS NULL THEN json('{"stall_streak":0,"e1rm_current":0.0,"e1rm_trend_percent":0.0,"avg_rpe_last_3":0.0,"status":"NEW","recommended_action":"LINEAR_LOAD"}')
      WHEN a.status = 'ERROR' THEN json_object('status', a.status, 'recommended_action', recommended_action)
      ELSE json_object('stall_streak', stall_streak, 'e1rm_current', e1rm_current, 'e1rm_trend_percent', e1rm_trend_percent,
        'avg_rpe_last_3', avg_rpe_last_3, 'status', a.status, 'recommended_action', recommended_action) END,
    'history_summary', ifnull(sessions, [])) AS context
  FROM e LEFT JOIN fx_stall a USING (exercise_template_id) LEFT JOIN h USING (exercise_template_id))
SELECT routine_id, order_index, exercise_template_id, CAST(context AS VARCHAR) AS context_json,
       '  ' || replace(replace(json_pretty(context), '    ', '  '), chr(10), chr(10) || '  ') AS context_text
FROM c""")


@query("coach_context", "SELECT * FROM fx_coach_context")
def q_coach_context(spark, d):
    p = Pipeline(spark, d)
    from liftlake.operators import dims
    inc = dims.base_increment(p.bronze.exercise_templates, p.progression, mode="null")
    ex = (p.bronze.routine_details.select("routine_id", F.col("exercise_index").alias("order_index"),
                                          "exercise_template_id").distinct()
          .join(inc.select("exercise_template_id", F.col("exercise_name").alias("title"), "base_increment"),
                "exercise_template_id", "left"))
    return prompts.coach_context(ex, p.stall, p.sessions)


_LEGACY_SYSTEM = _filled(prompts.LEGACY_SYSTEM_TEMPLATE, {
    "phase_name": "phase_name", "phase_week": "CAST(phase_week AS VARCHAR)", "phase_goal": "phase_goal", "phase_rpe": "phase_rpe_target",
    "phase_instruction": "phase_instruction"})


@query("coach_prompt_legacy", f"""
WITH p AS (
  SELECT CAST((weekofyear(start_time) - 1) % 4 + 1 AS BIGINT) AS phase_week, {", ".join(f"{_phase_case(i)} AS {c}" for i, c in enumerate(PHASE_COLS) if i > 0)}
  FROM (SELECT max(start_time) AS start_time FROM fx_workouts))
SELECT routine_id, phase_week, phase_name, {_LEGACY_SYSTEM} || '\n\n{prompts.LEGACY_USER_HEADER}[\n' || contexts || '\n]{prompts.LEGACY_USER_FOOTER.replace("'", "''")}' AS prompt
FROM (SELECT routine_id, string_agg(context_text, ',' || chr(10) ORDER BY order_index, exercise_template_id) AS contexts FROM fx_coach_context GROUP BY 1), p""")
def q_coach_prompt_legacy(spark, d):
    ctx = q_coach_context(spark, d)
    day = Pipeline(spark, d).bronze.workouts.select(F.max("start_time")).scalar()
    return prompts.coach_prompts(ctx, day)

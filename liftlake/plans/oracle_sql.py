"""DuckDB oracle text.

Each registered query has an independent ANSI-SQL twin that DuckDB runs on
the raw driver tables. ``with_ctes(body)`` prefixes the body with every named
CTE it references (transitively), in dependency order. The fixture CTEs
restate the projection of ``sources/fixtures.py`` in SQL.
"""

from __future__ import annotations

import re

CTES: dict[str, str] = {}


def cte(name: str, sql: str) -> None:
    CTES[name] = sql.strip()


def _refs(text: str) -> list[str]:
    return [n for n in CTES if re.search(rf"\b{re.escape(n)}\b", text)]


def with_ctes(body: str) -> str:
    order: list[str] = []

    def visit(name: str, stack: tuple = ()) -> None:
        if name in order or name in stack:
            return
        for dep in _refs(CTES[name]):
            if dep != name:
                visit(dep, stack + (name,))
        order.append(name)

    for n in _refs(body):
        visit(n)
    if not order:
        return body.strip()
    head = "WITH " + ",\n".join(f"{n} AS (\n{CTES[n]}\n)" for n in order)
    b = body.strip()
    if re.match(r"(?is)^with\s", b):
        return head + ",\n" + b[4:].lstrip()
    return head + "\n" + b


# ------------------------------------------------------------------ fixtures
cte("fx_workouts", """
SELECT CAST(o_orderkey AS VARCHAR) AS workout_id,
       'W-' || CAST(o_orderkey AS VARCHAR) AS title,
       CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS description,
       CAST(o_orderdate AS TIMESTAMP) AS start_time,
       CAST(o_orderdate AS TIMESTAMP) + INTERVAL 1 HOUR AS end_time,
       CAST(o_orderdate AS TIMESTAMP) + INTERVAL 2 HOUR AS updated_at,
       CAST(o_orderdate AS TIMESTAMP) AS created_at,
       CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE CAST(o_custkey AS VARCHAR) END AS routine_id,
       CAST(o_orderdate AS TIMESTAMP) + INTERVAL 1 DAY AS ingestion_timestamp,
       o_custkey AS fx_custkey
FROM orders""")

cte("fx_lines", """
SELECT CAST(l_orderkey AS VARCHAR) AS workout_id, CAST(l_partkey % 4 AS INTEGER) AS exercise_index,
       CAST(ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_partkey % 4
         ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS INTEGER) AS set_index,
       l_partkey, l_suppkey, l_linenumber, l_discount, l_tax, l_returnflag, l_shipdate
FROM lineitem""")

cte("fx_workout_sets", """
SELECT workout_id, exercise_index, set_index,
       CASE WHEN l_returnflag = 'R' THEN NULL WHEN l_linenumber = 1 THEN 'warmup' ELSE 'normal' END AS set_type,
       CASE WHEN l_suppkey % 19 = 0 OR l_tax = 0.0 THEN NULL ELSE CAST((l_suppkey % 6) * 2.5 + 40 AS DOUBLE) END AS weight_kg,
       CASE WHEN l_suppkey % 19 = 0 OR l_suppkey % 17 = 0 THEN NULL ELSE CAST(5 + l_linenumber % 5 AS INTEGER) END AS reps,
       CAST(NULL AS DOUBLE) AS distance_meters,
       CASE WHEN l_suppkey % 17 = 0 THEN CAST(30 * (1 + l_linenumber % 3) AS DOUBLE) ELSE NULL END AS duration_seconds,
       CASE WHEN l_discount = 0.0 THEN NULL ELSE CAST(6 + l_discount * 40 AS DOUBLE) END AS rpe,
       CASE WHEN l_suppkey % 19 = 0 THEN CAST(l_linenumber AS DOUBLE) ELSE NULL END AS custom_metric,
       CAST(l_shipdate AS TIMESTAMP) + INTERVAL 1 DAY AS ingestion_timestamp
FROM fx_lines""")

cte("fx_workout_exercises", """
SELECT DISTINCT l.workout_id, l.exercise_index, 'E-' || CAST(l.exercise_index AS VARCHAR) AS title,
       CAST(NULL AS VARCHAR) AS notes,
       CAST((w.fx_custkey * 4 + l.exercise_index) % (SELECT max(p_partkey) + 1 FROM part) AS VARCHAR) AS exercise_template_id,
       CAST(CASE WHEN l.exercise_index < 2 AND w.fx_custkey % 4 = 0 THEN 1 ELSE NULL END AS INTEGER) AS superset_id,
       w.start_time + INTERVAL 1 DAY AS ingestion_timestamp
FROM fx_lines l JOIN fx_workouts w ON l.workout_id = w.workout_id""")

cte("fx_templates", """
SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS title,
       CASE WHEN p_size % 9 = 0 THEN NULL ELSE p_type END AS type,
       CASE WHEN p_size % 10 = 0 THEN NULL ELSE p_brand END AS primary_muscle_group,
       CASE WHEN p_size % 3 = 0 THEN '[]'
            WHEN p_size % 2 = 0 THEN '["m' || CAST(p_size % 7 AS VARCHAR) || '"]'
            ELSE '["m' || CAST(p_size % 7 AS VARCHAR) || '", "m' || CAST(p_size % 5 AS VARCHAR) || '"]' END
         AS secondary_muscle_groups,
       p_size > 40 AS is_custom,
       TIMESTAMP '1999-01-01 00:00:00' AS ingestion_timestamp
FROM part""")

cte("fx_progression_raw", """
SELECT p_name AS exercise_name,
       CASE WHEN p_name LIKE 'old%' THEN NULL
            ELSE list_extract([0.0::DOUBLE, 1.25, 2.5, 5.0], 1 + LENGTH(p_name) % 4) END AS progression_step_kg,
       p_partkey AS line_no
FROM part""")

cte("fx_progression", """
SELECT exercise_name, CAST(arg_max(progression_step_kg, line_no) AS DOUBLE) AS progression_step_kg
FROM fx_progression_raw GROUP BY exercise_name""")

cte("fx_plan", """
SELECT CAST(v.ver AS INTEGER) AS ver, CAST(c_custkey AS VARCHAR) AS routine_id,
       c_mktsegment || '-' || CAST(c_custkey % 10 AS VARCHAR) AS title, CAST(c_nationkey AS VARCHAR) AS folder_id,
       TIMESTAMP '1995-06-01 00:00:00' AS updated_at, TIMESTAMP '1995-01-01 00:00:00' AS created_at,
       CAST(e.ei AS INTEGER) AS exercise_index, 'E-' || CAST(e.ei AS VARCHAR) AS exercise_title,
       CAST(NULL AS VARCHAR) AS exercise_notes,
       CAST(90 + 30 * (c_custkey % 3) AS INTEGER) AS rest_seconds,
       CAST((c_custkey * 4 + e.ei) % (SELECT max(p_partkey) + 1 FROM part) AS VARCHAR) AS exercise_template_id,
       CAST(CASE WHEN e.ei < 2 AND c_custkey % 4 = 0 THEN 1 ELSE NULL END AS INTEGER) AS superset_id,
       CAST(s.si AS INTEGER) AS set_index,
       CASE WHEN s.si = 0 AND c_custkey % 5 = 0 THEN 'warmup' ELSE 'normal' END AS set_type,
       CASE WHEN e.ei = 3 OR c_custkey % 17 = 0 THEN NULL
            ELSE CAST(40 + 2.5 * ((c_custkey + CASE WHEN c_custkey % 7 = 0 THEN v.ver ELSE 0 END) % 6) AS DOUBLE) END AS weight_kg,
       CASE WHEN c_custkey % 13 = 0 OR c_custkey % 17 = 0 THEN NULL ELSE CAST(6 + (c_custkey + e.ei) % 3 AS INTEGER) END AS reps,
       CASE WHEN c_custkey % 13 = 0 OR c_custkey % 17 = 0 THEN NULL ELSE CAST(5 + (c_custkey + e.ei) % 3 AS DOUBLE) END AS rep_range_start,
       CASE WHEN c_custkey % 13 = 0 OR c_custkey % 17 = 0 THEN NULL ELSE CAST(7 + (c_custkey + e.ei) % 3 AS DOUBLE) END AS rep_range_end,
       CAST(NULL AS DOUBLE) AS distance_meters,
       CASE WHEN c_custkey % 13 = 0 THEN CAST(60 AS DOUBLE) ELSE NULL END AS duration_seconds,
       CAST(NULL AS DOUBLE) AS rpe,
       CASE WHEN c_custkey % 17 = 0 THEN CAST(3 AS DOUBLE) ELSE NULL END AS custom_metric
FROM customer
CROSS JOIN (SELECT 0 AS ei UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) e
CROSS JOIN (SELECT 0 AS si UNION ALL SELECT 1 UNION ALL SELECT 2) s
CROSS JOIN (SELECT 0 AS ver UNION ALL SELECT 1) v
WHERE (s.si < 2 OR (v.ver = 1 AND c_custkey % 9 = 0))
  AND NOT (v.ver = 1 AND (c_custkey + e.ei) % 23 = 0)""")

cte("fx_routines", """
SELECT CAST(c_custkey AS VARCHAR) AS routine_id,
       c_mktsegment || '-' || CAST(c_custkey % 10 AS VARCHAR) AS title, CAST(c_nationkey AS VARCHAR) AS folder_id,
       TIMESTAMP '1995-06-01 00:00:00' AS updated_at, TIMESTAMP '1995-01-01 00:00:00' AS created_at,
       TIMESTAMP '1999-01-01 00:00:00' AS ingestion_timestamp
FROM customer""")

cte("fx_routine_details", """
SELECT routine_id, exercise_index, exercise_title, exercise_notes, rest_seconds, exercise_template_id, superset_id,
       set_index, set_type, weight_kg, reps, rep_range_start, rep_range_end, distance_meters, duration_seconds, rpe,
       custom_metric, TIMESTAMP '1999-01-01 00:00:00' AS ingestion_timestamp
FROM fx_plan WHERE ver = 1""")

_SCD_ALL = """routine_id, title, folder_id, updated_at, created_at, exercise_index, exercise_title, exercise_notes,
       rest_seconds, exercise_template_id, superset_id, set_index, set_type, weight_kg, reps, rep_range_start,
       rep_range_end, distance_meters, duration_seconds, rpe, custom_metric"""

cte("fx_scd2", """
SELECT COALESCE(o.routine_id, n.routine_id) AS routine_id, COALESCE(o.title, n.title) AS title,
       COALESCE(o.folder_id, n.folder_id) AS folder_id, COALESCE(o.updated_at, n.updated_at) AS updated_at,
       COALESCE(o.created_at, n.created_at) AS created_at,
       COALESCE(o.exercise_index, n.exercise_index) AS exercise_index,
       COALESCE(o.exercise_title, n.exercise_title) AS exercise_title,
       COALESCE(o.exercise_notes, n.exercise_notes) AS exercise_notes,
       COALESCE(o.rest_seconds, n.rest_seconds) AS rest_seconds,
       COALESCE(o.exercise_template_id, n.exercise_template_id) AS exercise_template_id,
       COALESCE(o.superset_id, n.superset_id) AS superset_id,
       COALESCE(o.set_index, n.set_index) AS set_index, COALESCE(o.set_type, n.set_type) AS set_type,
       CASE WHEN k.keep = 'old' THEN o.weight_kg ELSE n.weight_kg END AS weight_kg,
       COALESCE(o.reps, n.reps) AS reps, COALESCE(o.rep_range_start, n.rep_range_start) AS rep_range_start,
       COALESCE(o.rep_range_end, n.rep_range_end) AS rep_range_end,
       COALESCE(o.distance_meters, n.distance_meters) AS distance_meters,
       COALESCE(o.duration_seconds, n.duration_seconds) AS duration_seconds,
       COALESCE(o.rpe, n.rpe) AS rpe, COALESCE(o.custom_metric, n.custom_metric) AS custom_metric,
       CASE WHEN k.keep = 'old' THEN TIMESTAMP '1996-01-01 00:00:00' ELSE TIMESTAMP '1999-01-01 00:00:00' END AS scd_valid_from,
       CASE WHEN k.keep = 'old' AND (n.routine_id IS NULL OR COALESCE(o.weight_kg, -1) <> COALESCE(n.weight_kg, -1))
            THEN TIMESTAMP '1999-01-01 00:00:00' ELSE NULL END AS scd_valid_to
FROM (SELECT * FROM fx_plan WHERE ver = 0) o
FULL OUTER JOIN (SELECT * FROM fx_plan WHERE ver = 1) n
  ON o.routine_id = n.routine_id AND o.exercise_index = n.exercise_index AND o.set_index = n.set_index
CROSS JOIN (SELECT 'old' AS keep UNION ALL SELECT 'new') k
WHERE (k.keep = 'old' AND o.routine_id IS NOT NULL)
   OR (k.keep = 'new' AND n.routine_id IS NOT NULL
       AND (o.routine_id IS NULL OR COALESCE(o.weight_kg, -1) <> COALESCE(n.weight_kg, -1)))""")

# Silver and gold by other routes than the Spark plan: dimensions straight from
# the raw tables, the plan of a set as the newest version of its key that began
# before it (ASOF) and still ran, the status from a table of signs, and a cycle
# number as the number of start times up to the set's own.
cte("fx_dim_exercise", """
WITH steps AS (SELECT map(list(exercise_name), list(progression_step_kg)) AS step FROM fx_progression),
named AS (
  SELECT CAST(p_partkey AS VARCHAR) AS exercise_template_id, p_name AS exercise_name,
         if(p_size % 9 = 0, 'Other', p_type) AS exercise_type, if(p_size % 10 = 0, 'Other', p_brand) AS primary_muscle_group,
         ['No', 'Yes'][1 + CAST(p_size > 40 AS INTEGER)] AS is_custom_exercise
  FROM part)
SELECT named.*, 'Unknown' AS equipment_category, concat_ws(' - ', primary_muscle_group, exercise_name) AS exercise_hierarchy_name,
       ifnull(step[exercise_name], 0.0::DOUBLE) AS progression_step_kg
FROM named, steps""")

cte("fx_dim_routine", """
WITH planned AS (SELECT DISTINCT routine_id, exercise_index, exercise_template_id, set_index FROM fx_plan),
sizes AS (
  SELECT routine_id, len(list_distinct(list(exercise_template_id))) AS unique_exercises_count,
         len(list_distinct(list(exercise_index))) AS total_exercises_count, len(list_distinct(list(set_index))) AS total_sets_count
  FROM planned GROUP BY routine_id)
SELECT routine_id, title AS routine_name, folder_id, created_at, updated_at AS last_updated_at,
       CAST(unique_exercises_count AS BIGINT) AS unique_exercises_count, CAST(total_exercises_count AS BIGINT) AS total_exercises_count,
       CAST(total_sets_count AS BIGINT) AS total_sets_count
FROM sizes JOIN fx_routines USING (routine_id)""")

# A workout's template follows from its customer, so no exercise table is read.
cte("fx_performed", """
SELECT workout_id, routine_id, start_time, end_time, updated_at,
       CAST((fx_custkey * 4 + exercise_index) % (SELECT max(p_partkey) + 1 FROM part) AS VARCHAR) AS exercise_template_id,
       exercise_index, set_index, ifnull(set_type, 'normal') AS set_type, weight_kg, reps, distance_meters, duration_seconds,
       ifnull(rpe, 7) AS rpe, custom_metric
FROM fx_workout_sets JOIN fx_workouts USING (workout_id)
WHERE fx_custkey % 11 <> 0""")

cte("fx_trainings", """
SELECT workout_id, routine_id, start_time FROM fx_workouts SEMI JOIN fx_workout_sets USING (workout_id) WHERE routine_id IS NOT NULL""")

cte("fx_versions", """
SELECT routine_id, exercise_template_id, exercise_index, set_index, ifnull(set_type, 'normal') AS set_type, scd_valid_from AS since,
       ifnull(scd_valid_to, TIMESTAMP '9999-12-31 00:00:00') AS until,
       {'folder_id': folder_id, 'changed': updated_at, 'kg': weight_kg, 'reps': reps, 'metres': distance_meters,
        'seconds': duration_seconds, 'metric': custom_metric, 'rest': rest_seconds} AS plan
FROM fx_scd2""")

cte("fx_applicable", """
SELECT workout_id, start_time, fx_versions.*
FROM fx_trainings JOIN fx_versions ON fx_versions.routine_id = fx_trainings.routine_id AND NOT (start_time < since OR start_time >= until)""")

_SET_KEY = "routine_id, exercise_template_id, exercise_index, set_index, set_type"

# Each performed set with the plan that held at its start, if any.
cte("fx_matched", """
SELECT fx_performed.*, TRUE AS done, CASE WHEN fx_performed.start_time < until THEN plan END AS plan
FROM fx_performed ASOF LEFT JOIN fx_versions
  ON fx_performed.routine_id = fx_versions.routine_id AND fx_performed.exercise_template_id = fx_versions.exercise_template_id
 AND fx_performed.exercise_index = fx_versions.exercise_index AND fx_performed.set_index = fx_versions.set_index
 AND fx_performed.set_type = fx_versions.set_type AND fx_performed.start_time >= fx_versions.since""")

# With the planned sets that nobody performed.
cte("fx_matched_and_skipped", f"""
SELECT * FROM fx_matched
UNION ALL BY NAME
SELECT workout_id, start_time, {_SET_KEY}, plan.changed AS updated_at, FALSE AS done, plan
FROM fx_applicable ANTI JOIN fx_performed USING (workout_id, {_SET_KEY})""")

# One row for each outcome: signs of actual minus planned weight, reps,
# duration and custom metric; a null sign stands for any.
cte("fx_outcomes", """
SELECT * FROM (VALUES
  (1, 1, NULL, NULL, 'Overperformed: Heavier & More Reps'), (1, -1, NULL, NULL, 'Mixed: Heavier but Fewer Reps'),
  (1, 0, NULL, NULL, 'Overperformed: Heavier'), (-1, 1, NULL, NULL, 'Mixed: Lighter but More Reps'),
  (-1, 0, NULL, NULL, 'Underperformed: Lighter'), (-1, -1, NULL, NULL, 'Underperformed: Lighter'),
  (0, 1, NULL, NULL, 'Overperformed: More Reps'), (0, -1, NULL, NULL, 'Underperformed: Fewer Reps'),
  (0, 0, 1, NULL, 'Overperformed: Longer Duration'), (0, 0, -1, NULL, 'Underperformed: Shorter Duration'),
  (0, 0, 0, 1, 'Overperformed: Higher Custom Metric'), (0, 0, 0, -1, 'Underperformed: Lower Custom Metric'),
  (0, 0, 0, 0, 'Target Met')) t(kg, reps, seconds, metric, label)""")


def fact_rows(matched: str, by: str = "exercise_template_id") -> str:
    """Fact rows of a matched table; cycles are counted within ``by``."""
    return f"""
SELECT m.workout_id, m.routine_id, m.exercise_template_id, m.exercise_index, plan.folder_id AS folder_id,
       CAST(cycle.n AS INTEGER) AS cycle_number, m.set_type, m.set_index,
       CASE WHEN NOT done THEN 'Skipped' WHEN plan IS NULL THEN 'Unplanned'
            WHEN label = 'Target Met' AND ifnull(plan.kg, 0) = 0 AND ifnull(plan.metres, 0) = 0 THEN label || ': Free/Bodyweight'
            ELSE label END AS execution_status,
       weight_kg - plan.kg AS diff_weight_kg, m.reps - plan.reps AS diff_reps, duration_seconds - plan.seconds AS diff_duration_seconds,
       custom_metric - plan.metric AS diff_custom_metric, weight_kg, m.reps, distance_meters, duration_seconds, rpe, custom_metric,
       plan.kg AS planned_weight_kg, plan.reps AS planned_reps, plan.metres AS planned_distance_meters,
       plan.seconds AS planned_duration_seconds, plan.metric AS planned_custom_metric, plan.rest AS planned_rest, m.start_time, m.updated_at
FROM {matched} m
JOIN (SELECT {by}, start_time, row_number() OVER (PARTITION BY {by} ORDER BY start_time) AS n
      FROM (SELECT DISTINCT {by}, start_time FROM {matched})) cycle USING ({by}, start_time)
LEFT JOIN fx_outcomes o
  ON o.kg = sign(ifnull(weight_kg, 0) - ifnull(plan.kg, 0)) AND o.reps = sign(ifnull(m.reps, 0) - ifnull(plan.reps, 0))
 AND ifnull(o.seconds = sign(ifnull(duration_seconds, 0) - ifnull(plan.seconds, 0)), TRUE)
 AND ifnull(o.metric = sign(ifnull(custom_metric, 0) - ifnull(plan.metric, 0)), TRUE)"""


cte("fx_fact", fact_rows("fx_matched"))

# Sets paired with every plan version of their key that held at some session
# of the routine, with the number of those sessions.
cte("fx_matched_any", f"""
WITH held AS (SELECT {_SET_KEY}, since, any_value(plan) AS plan, count(*) AS copies FROM fx_applicable GROUP BY {_SET_KEY}, since)
SELECT fx_performed.*, TRUE AS done, held.plan, ifnull(copies, 1) AS copies, since
FROM fx_performed LEFT JOIN held USING ({_SET_KEY})""")

cte("fx_current_indices", """
SELECT routine_id, exercise_template_id, first(exercise_index ORDER BY exercise_index) AS exercise_index,
       last(superset_id ORDER BY superset_id NULLS FIRST) AS superset_id
FROM fx_routine_details GROUP BY ALL""")

# Names by key: the template is a part, the routine a customer.
cte("fx_named", """
SELECT f.*, x.exercise_name, x.primary_muscle_group, x.progression_step_kg,
       c_mktsegment || '-' || CAST(c_custkey % 10 AS VARCHAR) AS routine_name
FROM fx_fact f LEFT JOIN fx_dim_exercise x USING (exercise_template_id)
LEFT JOIN customer ON CAST(routine_id AS BIGINT) = c_custkey""")

cte("fx_gold_wide", """
SELECT n.* EXCLUDE (exercise_index, weight_kg, reps), n.exercise_index AS performed_index, i.exercise_index AS current_index, i.superset_id,
       weight_kg AS actual_weight_kg, reps AS actual_reps
FROM fx_named n LEFT JOIN fx_current_indices i USING (routine_id, exercise_template_id)""")

_GOLD = """routine_id, routine_name, cycle_number, exercise_template_id, exercise_name, primary_muscle_group, progression_step_kg,
       set_index, set_type, actual_weight_kg, actual_reps, rpe, planned_weight_kg, planned_reps, planned_rest, execution_status,
       diff_weight_kg, diff_reps"""

cte("fx_gold", f"SELECT ifnull(current_index, performed_index) AS exercise_index, superset_id, {_GOLD} FROM fx_gold_wide")

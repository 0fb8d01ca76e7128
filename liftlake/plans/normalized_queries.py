"""Registered legacy normalised-model queries (I) and the legacy routine
view (K9)."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from liftlake.operators import flatten as fl
from liftlake.operators import normalized as nm
from liftlake.plans.landing_queries import _valid, run_ts
from liftlake.plans.oracle_sql import cte
from liftlake.plans.pipeline import Pipeline
from liftlake.plans.registry import query
from liftlake.sources import fixtures as fx


class Legacy:
    """Inputs of the legacy chain: the flattened landed documents (built on
    first use; every DataFrame is analysed when created). The flat set tables
    are written (stored) as the legacy bronze tables were, since the
    normalised tables read them several times."""

    def __init__(self, spark, d):
        self.spark, self.d = spark, d

    @cached_property
    def flat_routines(self):
        return fx.stored(self.spark, self.d, "flat_routines", lambda: fl.flat_routines_outer(_valid(self.spark, self.d, "routines"), run_ts()))

    @cached_property
    def flat_workouts(self):
        return fx.stored(self.spark, self.d, "flat_workouts", lambda: fl.flat_workouts_outer(_valid(self.spark, self.d, "workouts"), run_ts()))

    @cached_property
    def templates(self):
        return fl.bronze_exercise_templates(_valid(self.spark, self.d, "exercise_templates"), run_ts())

    @cached_property
    def folders(self):
        return fl.folders_flat(_valid(self.spark, self.d, "routine_folders"), run_ts())

    @cached_property
    def progression(self):
        return nm.norm_progression(Pipeline(self.spark, self.d).progression_raw)

    def templates_norm(self):
        return nm.norm_templates(self.templates, self.progression)

    def routine_exercises(self):
        return nm.norm_routine_exercises(self.flat_routines)

    def workout_exercises(self):
        return nm.norm_workout_exercises(self.flat_workouts)


cte("fx_t_json", "SELECT * FROM fx_t_valid")

cte("fx_norm_progression", """
SELECT exercise_name AS exercise_title, arg_max(progression_step_kg, line_no) AS base_increment
FROM fx_progression_raw GROUP BY exercise_name""")

cte("fx_norm_templates", """
SELECT t.id, t.title, t.type, t.primary_muscle_group, t.is_custom, CAST(NULL AS VARCHAR) AS equipment_category,
       COALESCE(p.base_increment, 2.5) AS base_increment
FROM (SELECT DISTINCT id, title, type, primary_muscle_group, is_custom FROM fx_t_json) t
LEFT JOIN fx_norm_progression p ON t.title = p.exercise_title""")

cte("fx_norm_routine_exercises", """
SELECT *, CAST('0x' || md5(array_to_string([ifnull(CAST(k AS VARCHAR), chr(30)) FOR k IN [
         routine_id, CAST(order_index AS VARCHAR), exercise_template_id, CAST(superset_id AS VARCHAR), CAST(rest_seconds AS VARCHAR), notes]],
         chr(31)))[1:15] AS BIGINT) AS id
FROM (SELECT DISTINCT routine_id, exercise_template_id, supersets_id AS superset_id, rest_seconds,
             exercise_notes AS notes, exercise_index AS order_index FROM fx_flat_routines) d""")

cte("fx_norm_workouts", """
SELECT DISTINCT workout_id AS id, title, description, start_time, end_time, created_at, updated_at, routine_id
FROM fx_flat_workouts""")

cte("fx_norm_workout_exercises", """
SELECT *, CAST('0x' || md5(array_to_string([ifnull(CAST(k AS VARCHAR), chr(30)) FOR k IN [
         workout_id, CAST(order_index AS VARCHAR), exercise_template_id, CAST(superset_id AS VARCHAR), notes]],
         chr(31)))[1:15] AS BIGINT) AS id
FROM (SELECT DISTINCT workout_id, exercise_template_id, supersets_id AS superset_id, exercise_notes AS notes,
             exercise_index AS order_index FROM fx_flat_workouts) d""")

cte("fx_norm_routine_sets", """
SELECT m.id AS routine_exercise_id, f.set_type, f.weight_kg, f.reps, f.rep_range_start, f.rep_range_end,
       f.distance_meters, f.duration_seconds, f.rpe
FROM fx_flat_routines f JOIN fx_norm_routine_exercises m
  ON f.routine_id = m.routine_id AND f.exercise_index = m.order_index""")

cte("fx_norm_workout_sets", """
SELECT m.id AS workout_exercise_id, f.set_type, f.weight_kg, f.reps, f.distance_meters, f.duration_seconds, f.rpe,
       f.custom_metric
FROM fx_flat_workouts f JOIN fx_norm_workout_exercises m
  ON f.workout_id = m.workout_id AND f.exercise_index = m.order_index""")


@query("norm_folders", "SELECT DISTINCT id, title, created_at, updated_at FROM fx_folders_json")
def q_norm_folders(spark, d):
    return nm.norm_folders(Legacy(spark, d).folders)


@query("norm_templates", "SELECT * FROM fx_norm_templates")
def q_norm_templates(spark, d):
    return Legacy(spark, d).templates_norm()


@query("norm_secondary_muscles", """
SELECT id AS exercise_template_id, UNNEST(CAST(json(secondary_muscle_groups) AS VARCHAR[])) AS muscle_group
FROM fx_t_json""")
def q_norm_secondary_muscles(spark, d):
    return nm.norm_secondary_muscles(Legacy(spark, d).templates)


@query("norm_routines", """
SELECT DISTINCT routine_id AS id, title, folder_id, created_at, updated_at FROM fx_flat_routines""")
def q_norm_routines(spark, d):
    return nm.norm_routines(Legacy(spark, d).flat_routines)


@query("norm_routine_exercises", "SELECT * FROM fx_norm_routine_exercises")
def q_norm_routine_exercises(spark, d):
    return Legacy(spark, d).routine_exercises()


@query("norm_routine_sets", "SELECT * FROM fx_norm_routine_sets")
def q_norm_routine_sets(spark, d):
    lg = Legacy(spark, d)
    return nm.norm_routine_sets(lg.flat_routines)


@query("norm_workouts_priority", """
SELECT w.*, w.id IN (SELECT id FROM fx_norm_workouts ORDER BY start_time DESC NULLS LAST, id LIMIT 4) AS is_priority
FROM fx_norm_workouts w""")
def q_norm_workouts_priority(spark, d):
    return nm.norm_workouts_priority(Legacy(spark, d).flat_workouts)


@query("norm_workout_exercises", "SELECT * FROM fx_norm_workout_exercises")
def q_norm_workout_exercises(spark, d):
    return Legacy(spark, d).workout_exercises()


@query("norm_workout_sets", "SELECT * FROM fx_norm_workout_sets")
def q_norm_workout_sets(spark, d):
    lg = Legacy(spark, d)
    return nm.norm_workout_sets(lg.flat_workouts)


# (table, its rows, key, NOT NULL columns, whether the key must be unique)
_CHECKED = [
    ("silver_routine_folders", "SELECT DISTINCT id, title, created_at, updated_at FROM fx_folders_json", "id", ["title"], True),
    ("silver_exercise_templates", "SELECT * FROM fx_norm_templates", "id", ["title"], True),
    ("silver_routines", "SELECT DISTINCT routine_id AS id, title, folder_id, created_at, updated_at FROM fx_flat_routines", "id", ["title"], True),
    ("silver_routine_exercises", "SELECT * FROM fx_norm_routine_exercises", "id", ["routine_id"], True),
    ("silver_routine_sets", "SELECT * FROM fx_norm_routine_sets", "routine_exercise_id", ["routine_exercise_id"], False),
    ("silver_workouts", "SELECT * FROM fx_norm_workouts", "id", [], True),
    ("silver_workout_exercises", "SELECT * FROM fx_norm_workout_exercises", "id", ["workout_id"], True),
    ("silver_workout_sets", "SELECT * FROM fx_norm_workout_sets", "workout_exercise_id", ["workout_exercise_id"], False),
    ("silver_exercise_progression", "SELECT * FROM fx_norm_progression", "exercise_title", [], True),
]


def _checks_sql() -> str:
    out = []
    for table, rows, key, not_null, unique in _CHECKED:
        head = f"SELECT '{table}' AS table_name, ifnull(CAST({key} AS VARCHAR), '<null>') AS key"
        if unique:
            out.append(f"{head}, 'duplicate key' AS problem, COUNT(*) AS n FROM ({rows}) t GROUP BY {key} HAVING COUNT(*) > 1")
            out.append(f"{head}, 'null key' AS problem, COUNT(*) AS n FROM ({rows}) t WHERE {key} IS NULL GROUP BY {key}")
        out += [f"{head}, 'null {c}' AS problem, COUNT(*) AS n FROM ({rows}) t WHERE {c} IS NULL GROUP BY {key}" for c in not_null]
    return " UNION ALL ".join(out)


@query("check_primary_keys", _checks_sql())
def q_check_primary_keys(spark, d):
    """Every table of the model that states a key or NOT NULL columns, but for
    the enum tables, which hold each value once by construction."""
    lg = Legacy(spark, d)
    rows = {
        "silver_routine_folders": nm.norm_folders(lg.folders), "silver_exercise_templates": lg.templates_norm(),
        "silver_routines": nm.norm_routines(lg.flat_routines), "silver_routine_exercises": lg.routine_exercises(),
        "silver_routine_sets": nm.norm_routine_sets(lg.flat_routines), "silver_workouts": nm.norm_workouts(lg.flat_workouts),
        "silver_workout_exercises": lg.workout_exercises(), "silver_workout_sets": nm.norm_workout_sets(lg.flat_workouts),
        "silver_exercise_progression": lg.progression,
    }
    out = None
    for table, _, key, not_null, unique in _CHECKED:
        own = nm.constraint_report(rows[table], table, [key], not_null, unique)
        out = own if out is None else out.unionByName(own)
    return out


# (child, its rows, column, parent rows and key)
_TEMPLATE_IDS = "SELECT id FROM fx_norm_templates"
_REFERENCES = [
    ("silver_exercise_secondary_muscles.exercise_template_id",
     "SELECT id AS exercise_template_id FROM (SELECT id, UNNEST(CAST(json(secondary_muscle_groups) AS VARCHAR[])) FROM fx_t_json)", _TEMPLATE_IDS),
    ("silver_routines.folder_id", "SELECT DISTINCT routine_id AS id, title, folder_id, created_at, updated_at FROM fx_flat_routines", "SELECT id FROM fx_folders_json"),
    ("silver_routine_exercises.routine_id", "SELECT * FROM fx_norm_routine_exercises", "SELECT routine_id AS id FROM fx_flat_routines"),
    ("silver_routine_exercises.exercise_template_id", "SELECT * FROM fx_norm_routine_exercises", _TEMPLATE_IDS),
    ("silver_routine_sets.routine_exercise_id", "SELECT * FROM fx_norm_routine_sets", "SELECT id FROM fx_norm_routine_exercises"),
    ("silver_workout_exercises.workout_id", "SELECT * FROM fx_norm_workout_exercises", "SELECT id FROM fx_norm_workouts"),
    ("silver_workout_exercises.exercise_template_id", "SELECT * FROM fx_norm_workout_exercises", _TEMPLATE_IDS),
    ("silver_workout_sets.workout_exercise_id", "SELECT * FROM fx_norm_workout_sets", "SELECT id FROM fx_norm_workout_exercises"),
]


@query("check_foreign_keys", " UNION ALL ".join(
    f"""SELECT '{fk}' AS foreign_key, CAST(c.{fk.split('.')[1]} AS VARCHAR) AS key, COUNT(*) AS n FROM ({child}) c
ANTI JOIN ({parent}) p ON c.{fk.split('.')[1]} = p.id WHERE c.{fk.split('.')[1]} IS NOT NULL GROUP BY 2""" for fk, child, parent in _REFERENCES))
def q_check_foreign_keys(spark, d):
    """The model's seven foreign keys and the template of a performed exercise."""
    lg = Legacy(spark, d)
    template = "exercise_template_id"
    children = [
        (nm.norm_secondary_muscles(lg.templates), {"silver_exercise_secondary_muscles.exercise_template_id": template}),
        (nm.norm_routines(lg.flat_routines), {"silver_routines.folder_id": "folder_id"}),
        (lg.routine_exercises(), {"silver_routine_exercises.routine_id": "routine_id", "silver_routine_exercises.exercise_template_id": template}),
        (nm.norm_routine_sets(lg.flat_routines), {"silver_routine_sets.routine_exercise_id": "routine_exercise_id"}),
        (lg.workout_exercises(), {"silver_workout_exercises.workout_id": "workout_id", "silver_workout_exercises.exercise_template_id": template}),
        (nm.norm_workout_sets(lg.flat_workouts), {"silver_workout_sets.workout_exercise_id": "workout_exercise_id"}),
    ]
    of_template = [f"{t}.exercise_template_id" for t in ("silver_exercise_secondary_muscles", "silver_routine_exercises", "silver_workout_exercises")]
    parents = [
        (lg.templates_norm(), "id", of_template), (lg.folders, "id", ["silver_routines.folder_id"]),
        (lg.flat_routines, "routine_id", ["silver_routine_exercises.routine_id"]), (lg.routine_exercises(), "id", ["silver_routine_sets.routine_exercise_id"]),
        (lg.flat_workouts, "workout_id", ["silver_workout_exercises.workout_id"]), (lg.workout_exercises(), "id", ["silver_workout_sets.workout_exercise_id"]),
    ]
    return nm.fk_violations(children, parents)


_HISTORY = """
h AS (
  SELECT exercise_template_id, CAST(start_time AS DATE) AS day, weight_kg, reps, rpe,
         row_number() OVER (PARTITION BY exercise_template_id ORDER BY start_time DESC NULLS LAST, workout_id, exercise_index, set_index) AS rn
  FROM fx_flat_workouts WHERE set_type = 'normal' AND exercise_template_id IS NOT NULL QUALIFY rn <= 20),
b AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY exercise_template_id, day ORDER BY ifnull(weight_kg, 0) DESC, ifnull(reps, 0) DESC, rn) = 1),
s AS (SELECT *, row_number() OVER (PARTITION BY exercise_template_id ORDER BY day DESC) AS no FROM b QUALIFY no <= 5),
history AS (
  SELECT exercise_template_id, string_agg(concat_ws('|', CAST(day AS VARCHAR), ifnull(CAST(weight_kg AS VARCHAR), ''), ifnull(CAST(reps AS VARCHAR), ''),
         ifnull(CAST(rpe AS VARCHAR), '')), ';' ORDER BY no) AS history
  FROM s GROUP BY 1)"""


@query("routine_with_exercises", "WITH" + _HISTORY + """
SELECT r.id AS routine_id, r.title AS routine_title, re.order_index, re.id AS routine_exercise_id,
       re.exercise_template_id, re.notes, re.rest_seconds, re.superset_id, t.title, t.base_increment,
       s.set_type, s.weight_kg, s.reps, s.rep_range_start, s.rep_range_end, ifnull(history, '') AS history
FROM (SELECT DISTINCT routine_id AS id, title FROM fx_flat_routines) r
JOIN fx_norm_routine_exercises re ON re.routine_id = r.id
LEFT JOIN fx_norm_templates t ON re.exercise_template_id = t.id
LEFT JOIN fx_norm_routine_sets s ON s.routine_exercise_id = re.id
LEFT JOIN history ON history.exercise_template_id = re.exercise_template_id""")
def q_routine_with_exercises(spark, d):
    """Set rows of each routine exercise (one row without set values where it
    has none), with the exercise's newest sessions as ``day|weight|reps|rpe``."""
    lg = Legacy(spark, d)
    return nm.routine_view(lg.flat_routines, lg.routine_exercises(), lg.templates_norm(), nm.flat_history(lg.flat_workouts))


@query("norm_enums", """
WITH e AS (""" + " UNION ALL ".join(
    f"SELECT 'silver_enums_{k}' AS table_name, '{v}' AS name" for k, vals in
    __import__("liftlake.sources.enums", fromlist=["ENUMS"]).ENUMS.items() for v in vals) + """),
u AS (SELECT DISTINCT 'silver_enums_muscle_group' AS table_name, lower(primary_muscle_group) AS name FROM fx_t_json
      UNION SELECT DISTINCT 'silver_enums_exercise_type', lower(type) FROM fx_t_json)
SELECT e.table_name, e.name, u.name IS NOT NULL AS in_use
FROM e LEFT JOIN u ON e.table_name = u.table_name AND e.name = u.name""")
def q_norm_enums(spark, d):
    """The silver enum tables (as copied) with whether the landed
    templates use each value."""
    lg = Legacy(spark, d)
    t = lg.templates
    used = (t.select(F.lit("silver_enums_muscle_group").alias("table_name"),
                     F.lower("primary_muscle_group").alias("name"))
            .unionByName(t.select(F.lit("silver_enums_exercise_type").alias("table_name"), F.lower("type").alias("name")))
            .filter(F.col("name").isNotNull()).distinct().withColumn("in_use", F.lit(True)))
    enums = None
    for table, df in nm.norm_enums(spark).items():
        x = df.select(F.lit(table).alias("table_name"), "name")
        enums = x if enums is None else enums.unionByName(x)
    return (F.broadcast(enums).join(used, ["table_name", "name"], "left")
            .select("table_name", "name", F.coalesce(F.col("in_use"), F.lit(False)).alias("in_use")))

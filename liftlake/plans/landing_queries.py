"""Registered landing, validation, flatten and sink queries (A, B, C, D)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftlake.operators import flatten as fl
from liftlake.operators import validate as va
from liftlake.plans.oracle_sql import _SCD_ALL, cte
from liftlake.plans.pipeline import Pipeline
from liftlake.plans.registry import REGISTRY, query
from liftlake.sources import enums, landing, page_files, sinks
from liftlake.sources import fixtures as fx

RUN_TS = fx.SNAPSHOT_RUN_TS[1]


def run_ts():
    return fx.ts(RUN_TS)


_PAGES = {
    "workouts": landing.landed_workout_pages, "routines": landing.landed_routine_pages, "exercise_templates": landing.landed_template_pages,
    "routine_folders": landing.landed_folder_pages, "events": landing.landed_event_pages,
}


def _pages(spark, d, entity: str) -> DataFrame:
    """Landed page files of an entity, read once into a table of pages."""
    multi_line = entity in landing.MULTI_LINE

    def land(path: str) -> None:
        landing.write_pages(landing.with_failed_downloads(_PAGES[entity](spark, d)), path, multi_line)

    def read() -> DataFrame:
        return page_files.read_pages(spark, fx.landed(spark, d, f"landing-{entity}", land), entity, multi_line)

    return fx.stored(spark, d, f"pages-{entity}", read)


def _items(spark, d, entity: str) -> DataFrame:
    """One row per raw item of the landed pages that count."""
    return page_files.page_items(_pages(spark, d, entity))


def _valid(spark, d, entity: str, **kw) -> DataFrame:
    items = _items(spark, d, entity)
    if entity == "workouts" and kw:
        return va.validate_workouts(items, **kw)[0]
    if entity == "exercise_templates" and kw:
        return va.validate_templates(items, **kw)[0]
    return va.validate(items, entity)[0]


# ------------------------------------------------------------------ oracle CTEs
cte("fx_w_valid", """
SELECT w.* FROM fx_workouts w
WHERE CAST(w.workout_id AS BIGINT) % 31 <> 0
  AND NOT (CAST(w.workout_id AS BIGINT) % 29 = 0 AND w.workout_id IN (SELECT workout_id FROM fx_workout_sets))
  AND NOT (CAST(w.workout_id AS BIGINT) % 41 = 0 AND w.workout_id IN (SELECT workout_id FROM fx_workout_exercises))""")

cte("fx_w_valid_untyped_ok", """
SELECT w.* FROM fx_workouts w
WHERE CAST(w.workout_id AS BIGINT) % 31 <> 0
  AND NOT (CAST(w.workout_id AS BIGINT) % 41 = 0 AND w.workout_id IN (SELECT workout_id FROM fx_workout_exercises))""")

cte("fx_doc_sets", """
SELECT s.workout_id, s.exercise_index, s.set_index,
       CASE WHEN CAST(s.workout_id AS BIGINT) % 29 = 0 AND s.set_index = 0
                 AND s.exercise_index = (SELECT MIN(e.exercise_index) FROM fx_workout_exercises e
                                         WHERE e.workout_id = s.workout_id) THEN NULL
            ELSE COALESCE(s.set_type, 'failure') END AS set_type,
       s.weight_kg, s.reps, s.distance_meters, s.duration_seconds, s.rpe, s.custom_metric
FROM fx_workout_sets s""")

cte("fx_r_valid", """
SELECT * FROM fx_routines WHERE CAST(routine_id AS BIGINT) % 29 <> 0 AND CAST(routine_id AS BIGINT) % 31 <> 0""")

cte("fx_t_valid", """
SELECT id, title, type, primary_muscle_group,
       CASE WHEN CAST(id AS BIGINT) % 37 = 0 THEN '[]' ELSE secondary_muscle_groups END AS secondary_muscle_groups,
       is_custom
FROM fx_templates WHERE CAST(id AS BIGINT) % 29 <> 0 AND CAST(id AS BIGINT) % 31 <> 0 AND CAST(id AS BIGINT) % 43 <> 0""")

cte("fx_events_typed", """
SELECT event_id, ts, user_id, value,
       CASE WHEN event_id % 53 = 0 THEN NULL WHEN event_type = 'purchase' THEN 'updated'
            WHEN event_type = 'error' THEN 'deleted' ELSE event_type END AS type,
       event_type
FROM events""")

RUN = "TIMESTAMP '1999-01-01 00:00:00'"


# ------------------------------------------------------------------ A: scans
@query("scan_workout_pages", "SELECT CAST(CAST(workout_id AS BIGINT) // 10 + 1 AS BIGINT) AS page, workout_id AS id FROM fx_workouts")
def q_scan_workout_pages(spark, d):
    return _items(spark, d, "workouts").select("page", F.get_json_object("item", "$.id").alias("id"))


@query("scan_routine_pages", "SELECT CAST(CAST(routine_id AS BIGINT) // 10 + 1 AS BIGINT) AS page, routine_id AS id FROM fx_routines")
def q_scan_routine_pages(spark, d):
    return _items(spark, d, "routines").select("page", F.get_json_object("item", "$.id").alias("id"))


@query("scan_template_pages", "SELECT CAST(CAST(id AS BIGINT) // 100 + 1 AS BIGINT) AS page, id FROM fx_templates")
def q_scan_template_pages(spark, d):
    return _items(spark, d, "exercise_templates").select("page", F.get_json_object("item", "$.id").alias("id"))


@query("scan_folder_pages", "SELECT CAST(n_nationkey // 10 + 1 AS BIGINT) AS page, CAST(n_nationkey AS VARCHAR) AS id FROM nation")
def q_scan_folder_pages(spark, d):
    return _items(spark, d, "routine_folders").select("page", F.get_json_object("item", "$.id").alias("id"))


@query("scan_event_pages", "SELECT CAST(event_id // 20 + 1 AS BIGINT) AS page, type FROM fx_events_typed")
def q_scan_event_pages(spark, d):
    return _items(spark, d, "events").select("page", F.get_json_object("item", "$.type").alias("type"))


_LANDED = """
WITH p AS (
  SELECT 'workouts' AS entity, CAST(CAST(workout_id AS BIGINT) // 10 + 1 AS BIGINT) AS page, 10 AS size, COUNT(*) AS n FROM fx_workouts GROUP BY 2
  UNION ALL SELECT 'routines', CAST(CAST(routine_id AS BIGINT) // 10 + 1 AS BIGINT), 10, COUNT(*) FROM fx_routines GROUP BY 2
  UNION ALL SELECT 'exercise_templates', CAST(CAST(id AS BIGINT) // 100 + 1 AS BIGINT), 100, COUNT(*) FROM fx_templates GROUP BY 2
  UNION ALL SELECT 'routine_folders', CAST(n_nationkey // 10 + 1 AS BIGINT), 10, COUNT(*) FROM nation GROUP BY 2
  UNION ALL SELECT 'events', CAST(event_id // 20 + 1 AS BIGINT), 20, COUNT(*) FROM events GROUP BY 2),
m AS (SELECT entity, MAX(page) AS last FROM p GROUP BY 1)"""


@query("page_report", _LANDED + """
SELECT entity, 'unreadable' AS problem, page, CAST(NULL AS BIGINT) AS page_count, CAST(NULL AS INTEGER) AS n_items, FALSE AS kept
FROM p WHERE page % 17 = 3
UNION ALL SELECT entity, 'no item list', page, 1, NULL, FALSE FROM p WHERE page % 19 = 5
UNION ALL SELECT entity, 'repeated', page, last, CAST(n AS INTEGER), FALSE FROM p JOIN m USING (entity) WHERE page % 23 = 7
UNION ALL SELECT entity, 'short', page, last, CAST(n AS INTEGER), TRUE FROM p JOIN m USING (entity) WHERE n < size AND page < last
UNION ALL SELECT entity, 'missing', g.page, NULL, NULL, FALSE
FROM (SELECT entity, unnest(range(1, last + 1)) AS page FROM m) g ANTI JOIN p ON p.entity = g.entity AND p.page = g.page""")
def q_page_report(spark, d):
    out = None
    for entity in _PAGES:
        own = page_files.page_report(_pages(spark, d, entity), entity).drop("file")
        out = own if out is None else out.unionByName(own)
    return out


@query("item_provenance", """
SELECT CAST(CAST(workout_id AS BIGINT) // 10 + 1 AS BIGINT) AS page, workout_id AS id,
       CAST(row_number() OVER (PARTITION BY CAST(workout_id AS BIGINT) // 10 ORDER BY CAST(workout_id AS BIGINT)) - 1 AS INTEGER) AS position,
       'txt' AS file_kind, TRUE AS landed
FROM fx_workouts""")
def q_item_provenance(spark, d):
    items = page_files.item_provenance(_pages(spark, d, "workouts"))
    return items.select(
        "page", F.get_json_object("item", "$.id").alias("id"), "position", F.regexp_extract("file", r"\.(\w+?)(?:\.lz4)?$", 1).alias("file_kind"),
        F.col("landed_at").isNotNull().alias("landed"))


@query("enum_dimensions", enums.ORACLE_SQL)
def q_enum_dimensions(spark, d):
    b = Pipeline(spark, d).bronze
    return enums.enum_usage(spark, b.exercise_templates, b.workout_sets)


@query("table_scan_preview", "SELECT * EXCLUDE (fx_custkey) FROM fx_workouts ORDER BY workout_id LIMIT 5")
def q_table_scan_preview(spark, d):
    from liftlake.sources.sinks import preview
    return preview(fx.workouts(spark, d), 5, "workout_id")


@query("raw_key_audit", """
SELECT 'superset_id' AS key_found, workout_id AS parent_id, title AS exercise_title,
       CAST(superset_id AS VARCHAR) AS value
FROM fx_workout_exercises WHERE superset_id IS NOT NULL
ORDER BY CAST(workout_id AS BIGINT), exercise_index LIMIT 10""")
def q_raw_key_audit(spark, d):
    from liftlake.operators.audit import raw_key_audit
    return raw_key_audit(_items(spark, d, "workouts"), "superset", 10)


@query("raw_key_audit_keys", "SELECT DISTINCT 'superset_id' AS key_found FROM fx_workout_exercises")
def q_raw_key_audit_keys(spark, d):
    from liftlake.operators.audit import matching_keys
    return matching_keys(_items(spark, d, "workouts"), "superset")


# ------------------------------------------------------------------ B: validation
@query("validate_workouts", "SELECT workout_id AS id FROM fx_w_valid")
def q_validate_workouts(spark, d):
    return _valid(spark, d, "workouts").select("id")


@query("validate_routines", "SELECT routine_id AS id FROM fx_r_valid")
def q_validate_routines(spark, d):
    return _valid(spark, d, "routines").select("id")


@query("validate_templates", "SELECT id FROM fx_t_valid")
def q_validate_templates(spark, d):
    return _valid(spark, d, "exercise_templates").select("id")


@query("validate_folders", "SELECT CAST(n_nationkey AS VARCHAR) AS id FROM nation WHERE n_nationkey % 7 <> 3")
def q_validate_folders(spark, d):
    return _valid(spark, d, "routine_folders").select("id")


@query("validate_events", "SELECT type FROM fx_events_typed WHERE type IS NOT NULL")
def q_validate_events(spark, d):
    return _valid(spark, d, "events").select("type")


@query("quarantine_invalid", """
SELECT 'workouts' AS entity, workout_id AS id,
       CASE WHEN CAST(workout_id AS BIGINT) % 31 = 0 THEN 'exercises is not a list' ELSE 'invalid exercise or set' END AS reason
FROM fx_workouts WHERE workout_id NOT IN (SELECT workout_id FROM fx_w_valid)
UNION ALL
SELECT 'routines', routine_id,
       CASE WHEN CAST(routine_id AS BIGINT) % 31 = 0 THEN 'exercises is not a list' ELSE 'invalid exercise or set' END
FROM fx_routines WHERE routine_id NOT IN (SELECT routine_id FROM fx_r_valid)
UNION ALL
SELECT 'exercise_templates', id,
       CASE WHEN CAST(id AS BIGINT) % 29 = 0 THEN 'missing title' WHEN CAST(id AS BIGINT) % 31 = 0 THEN 'secondary_muscle_groups is not a list'
            ELSE 'a text field is no text' END
FROM fx_templates WHERE id NOT IN (SELECT id FROM fx_t_valid)
UNION ALL SELECT 'routine_folders', CAST(n_nationkey AS VARCHAR), 'missing or bad index' FROM nation WHERE n_nationkey % 7 = 3
UNION ALL
SELECT 'events', CASE WHEN event_type = 'error' THEN 'ev-' || CAST(event_id AS VARCHAR) END, 'missing type' FROM events WHERE event_id % 53 = 0""")
def q_quarantine_invalid(spark, d):
    out = None
    for entity in va.VALIDATORS:
        rej = va.validate(_items(spark, d, entity), entity)[1].select(
            F.lit(entity).alias("entity"), F.get_json_object("item", "$.id").alias("id"), "reason")
        out = rej if out is None else out.unionByName(rej)
    return out


# ------------------------------------------------------------------ C: flatten
@query("bronze_workouts", f"""
SELECT workout_id, title, description, start_time, end_time, updated_at, created_at, routine_id,
       {RUN} AS ingestion_timestamp FROM fx_w_valid""")
def q_bronze_workouts(spark, d):
    return fl.bronze_workouts(_valid(spark, d, "workouts"), run_ts())


@query("bronze_workout_exercises", f"""
SELECT e.workout_id, e.exercise_index, e.title, e.notes, e.exercise_template_id, e.superset_id,
       {RUN} AS ingestion_timestamp
FROM fx_workout_exercises e JOIN fx_w_valid w ON e.workout_id = w.workout_id""")
def q_bronze_workout_exercises(spark, d):
    return fl.bronze_workout_exercises(_valid(spark, d, "workouts"), run_ts())


@query("bronze_workout_sets", f"""
SELECT s.workout_id, s.exercise_index, s.set_index, s.set_type, s.weight_kg, s.reps, s.distance_meters,
       s.duration_seconds, s.rpe, s.custom_metric, {RUN} AS ingestion_timestamp
FROM fx_doc_sets s JOIN fx_w_valid w ON s.workout_id = w.workout_id""")
def q_bronze_workout_sets(spark, d):
    return fl.bronze_workout_sets(_valid(spark, d, "workouts"), run_ts())


@query("bronze_routines", f"""
SELECT routine_id, title, folder_id, updated_at, created_at, {RUN} AS ingestion_timestamp FROM fx_r_valid""")
def q_bronze_routines(spark, d):
    return fl.bronze_routines(_valid(spark, d, "routines"), run_ts())


@query("bronze_routine_details", f"""
SELECT d.routine_id, d.exercise_index, d.exercise_title, d.exercise_notes, d.rest_seconds, d.exercise_template_id,
       d.superset_id, d.set_index, d.set_type, d.weight_kg, d.reps, d.rep_range_start, d.rep_range_end,
       d.distance_meters, d.duration_seconds, d.rpe, d.custom_metric, {RUN} AS ingestion_timestamp
FROM fx_routine_details d JOIN fx_r_valid r ON d.routine_id = r.routine_id""")
def q_bronze_routine_details(spark, d):
    return fl.bronze_routine_details(_valid(spark, d, "routines"), run_ts())


@query("bronze_exercise_templates", f"SELECT *, {RUN} AS ingestion_timestamp FROM fx_t_valid")
def q_bronze_exercise_templates(spark, d):
    return fl.bronze_exercise_templates(_valid(spark, d, "exercise_templates"), run_ts())


_OUTER_SETS = """s.set_index, s.set_type, s.weight_kg, s.reps, s.distance_meters, s.duration_seconds, s.rpe,
       s.custom_metric"""


cte("fx_flat_workouts", f"""
SELECT w.workout_id, w.title, w.routine_id, w.description, w.start_time, w.end_time, w.updated_at, w.created_at,
       {RUN} AS ingestion_timestamp, e.exercise_index, e.title AS exercise_title, e.notes AS exercise_notes,
       e.exercise_template_id, e.superset_id AS supersets_id, {_OUTER_SETS}
FROM fx_w_valid w
LEFT JOIN fx_workout_exercises e ON e.workout_id = w.workout_id
LEFT JOIN fx_doc_sets s ON s.workout_id = e.workout_id AND s.exercise_index = e.exercise_index""")


@query("flat_workouts_outer", "SELECT * FROM fx_flat_workouts")
def q_flat_workouts_outer(spark, d):
    return fl.flat_workouts_outer(_valid(spark, d, "workouts"), run_ts())


cte("fx_flat_routines", f"""
SELECT r.routine_id, r.title, r.folder_id, r.updated_at, r.created_at, {RUN} AS ingestion_timestamp,
       d.exercise_index, d.exercise_title, d.exercise_notes, d.rest_seconds, d.exercise_template_id,
       d.superset_id AS supersets_id, d.set_index, d.set_type, d.weight_kg, d.reps, d.rep_range_start,
       d.rep_range_end, d.distance_meters, d.duration_seconds, d.rpe, d.custom_metric
FROM fx_r_valid r LEFT JOIN fx_routine_details d ON d.routine_id = r.routine_id""")


@query("flat_routines_outer", "SELECT * FROM fx_flat_routines")
def q_flat_routines_outer(spark, d):
    return fl.flat_routines_outer(_valid(spark, d, "routines"), run_ts())


@query("flat_workout_log_outer", f"""
SELECT w.workout_id, w.title AS workout_title, w.description, w.start_time, w.end_time, w.created_at, w.routine_id,
       {RUN} AS ingestion_timestamp, e.title AS exercise_title, e.exercise_template_id, e.superset_id,
       e.notes AS exercise_notes, e.exercise_index, {_OUTER_SETS}
FROM fx_w_valid w
LEFT JOIN fx_workout_exercises e ON e.workout_id = w.workout_id
LEFT JOIN fx_doc_sets s ON s.workout_id = e.workout_id AND s.exercise_index = e.exercise_index""")
def q_flat_workout_log_outer(spark, d):
    return fl.flat_workout_log_outer(_valid(spark, d, "workouts"), run_ts())


@query("flat_exercise_sets", f"""
SELECT w.workout_id, e.exercise_index, e.title, e.notes, e.exercise_template_id, e.superset_id AS supersets_id,
       {_OUTER_SETS}, {RUN} AS ingestion_timestamp
FROM fx_w_valid w
JOIN fx_workout_exercises e ON e.workout_id = w.workout_id
JOIN fx_doc_sets s ON s.workout_id = e.workout_id AND s.exercise_index = e.exercise_index""")
def q_flat_exercise_sets(spark, d):
    return fl.flat_exercise_sets(_valid(spark, d, "workouts"), run_ts())


@query("flat_history_entries", f"""
SELECT w.workout_id, w.title AS workout_title, w.start_time AS workout_start_time, w.end_time AS workout_end_time,
       e.exercise_template_id, s.weight_kg, s.reps, s.distance_meters, s.duration_seconds, s.rpe, s.custom_metric,
       s.set_type, {RUN} AS ingestion_timestamp
FROM fx_w_valid_untyped_ok w
JOIN fx_workout_exercises e ON e.workout_id = w.workout_id
JOIN fx_doc_sets s ON s.workout_id = e.workout_id AND s.exercise_index = e.exercise_index""")
def q_flat_history_entries(spark, d):
    return fl.flat_history_entries(_valid(spark, d, "workouts", require_set_type=False), run_ts())


@query("flat_sets", f"""
SELECT w.workout_id, e.exercise_template_id, s.set_index AS index, s.set_type, s.weight_kg, s.reps,
       s.distance_meters, s.duration_seconds, s.rpe, s.custom_metric, {RUN} AS ingestion_timestamp
FROM fx_w_valid w
JOIN fx_workout_exercises e ON e.workout_id = w.workout_id
JOIN fx_doc_sets s ON s.workout_id = e.workout_id AND s.exercise_index = e.exercise_index""")
def q_flat_sets(spark, d):
    return fl.flat_sets(_valid(spark, d, "workouts"), run_ts())


@query("updated_events_flat", f"""
SELECT 'updated' AS event_type, 'ev-' || CAST(event_id AS VARCHAR) AS workout_id,
       'W-ev-' || CAST(event_id AS VARCHAR) AS workout_title, CAST(user_id AS VARCHAR) AS routine_id,
       CAST(NULL AS VARCHAR) AS description, date_trunc('second', ts) AS start_time, CAST(NULL AS TIMESTAMP) AS end_time,
       date_trunc('second', ts) AS updated_at, CAST(NULL AS TIMESTAMP) AS created_at, {RUN} AS ingestion_timestamp,
       0 AS exercise_index, 'E-0' AS exercise_title, CAST(NULL AS VARCHAR) AS exercise_notes,
       CAST(user_id % (SELECT max(p_partkey) + 1 FROM part) AS VARCHAR) AS exercise_template_id, CAST(NULL AS INTEGER) AS superset_id,
       0 AS set_index, 'normal' AS set_type, round(value / 2.5) * 2.5 AS weight_kg,
       CAST(event_id % 10 + 1 AS INTEGER) AS reps, CAST(NULL AS DOUBLE) AS distance_meters,
       CAST(NULL AS DOUBLE) AS duration_seconds, CAST(NULL AS DOUBLE) AS rpe, CAST(NULL AS DOUBLE) AS custom_metric
FROM fx_events_typed WHERE type = 'updated'""")
def q_updated_events_flat(spark, d):
    return fl.updated_events_flat(_valid(spark, d, "events"), run_ts())


@query("deleted_events", """
SELECT 'deleted' AS type, 'ev-' || CAST(event_id AS VARCHAR) AS id, date_trunc('second', ts) AS deleted_at
FROM fx_events_typed WHERE type = 'deleted'""")
def q_deleted_events(spark, d):
    return fl.deleted_events(_items(spark, d, "events"))


@query("custom_exercise_templates", f"""
SELECT id, title, type AS exercise_type, CAST(NULL AS VARCHAR) AS equipment_category,
       primary_muscle_group AS muscle_group, is_custom, secondary_muscle_groups AS other_muscles_json,
       {RUN} AS ingestion_timestamp
FROM fx_t_valid""")
def q_custom_exercise_templates(spark, d):
    valid = _valid(spark, d, "exercise_templates", is_custom_default_only=True)
    return fl.custom_exercise_templates(valid, run_ts())


cte("fx_folders_json", f"""
SELECT CAST(n_nationkey AS VARCHAR) AS id, n_regionkey AS index, n_name AS title,
       TIMESTAMP '1995-06-01 00:00:00' AS updated_at, TIMESTAMP '1995-01-01 00:00:00' AS created_at,
       {RUN} AS ingestion_timestamp
FROM nation WHERE n_nationkey % 7 <> 3""")


@query("folders_flat", "SELECT * FROM fx_folders_json")
def q_folders_flat(spark, d):
    return fl.folders_flat(_valid(spark, d, "routine_folders"), run_ts())


@query("with_ingestion_timestamp", f"SELECT workout_id, {RUN} AS ingestion_timestamp FROM fx_workouts")
def q_with_ingestion_timestamp(spark, d):
    w = Pipeline(spark, d).bronze.workouts.select("workout_id")
    return fl.with_ingestion_timestamp(w, run_ts())


# ------------------------------------------------------------------ D: sinks
@query("upsert_templates", f"""
SELECT COALESCE(u.id, t.id) AS id,
       CASE WHEN u.id IS NOT NULL THEN u.title ELSE t.title END AS title,
       CASE WHEN u.id IS NOT NULL THEN u.type ELSE t.type END AS type,
       CASE WHEN u.id IS NOT NULL THEN u.primary_muscle_group ELSE t.primary_muscle_group END AS primary_muscle_group,
       CASE WHEN u.id IS NOT NULL THEN u.secondary_muscle_groups ELSE t.secondary_muscle_groups END
         AS secondary_muscle_groups,
       CASE WHEN u.id IS NOT NULL THEN u.is_custom ELSE t.is_custom END AS is_custom,
       CASE WHEN u.id IS NOT NULL THEN {RUN} ELSE t.ingestion_timestamp END AS ingestion_timestamp
FROM fx_templates t FULL OUTER JOIN fx_t_valid u ON t.id = u.id""")
def q_upsert_templates(spark, d):
    target = Pipeline(spark, d).bronze.exercise_templates
    updates = fl.bronze_exercise_templates(_valid(spark, d, "exercise_templates"), run_ts())
    return sinks.upsert(target, updates, ["id"])


@query("write_replace_nonempty")
def q_write_replace_nonempty(spark, d):
    path = sinks.scratch_path(spark, "bronze_workouts")
    df = fl.bronze_workouts(_valid(spark, d, "workouts"), run_ts())
    sinks.write(df, path, mode="overwrite", skip_if_empty=True)
    return spark.read.parquet(path)


REGISTRY["write_replace_nonempty"].sql = REGISTRY["bronze_workouts"].sql


@query("write_replace", "SELECT * FROM fx_dim_routine")
def q_write_replace(spark, d):
    path = sinks.scratch_path(spark, "dim_routine")
    sinks.write(Pipeline(spark, d).dim_routine, path, mode="overwrite")
    return spark.read.parquet(path)


@query("write_append", f"""
SELECT {_SCD_ALL}, scd_valid_from, CAST(NULL AS TIMESTAMP) AS scd_valid_to, TRUE AS scd_is_current FROM fx_scd2""")
def q_write_append(spark, d):
    path = sinks.scratch_path(spark, "scd2_inserts")
    p = Pipeline(spark, d)
    sinks.write(p.scd_after_first_run, path, mode="overwrite")
    inserts = p.scd.filter(F.col("scd_valid_from") == fx.ts(fx.SNAPSHOT_RUN_TS[1]))
    sinks.write(inserts, path, mode="append")
    return spark.read.parquet(path).drop("scd_hash")

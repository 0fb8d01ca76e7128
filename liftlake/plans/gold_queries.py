"""Registered gold queries (H)."""

from __future__ import annotations

from liftlake.operators import gold
from liftlake.plans.oracle_sql import _GOLD, cte
from liftlake.plans.pipeline import Pipeline
from liftlake.plans.registry import query


@query("current_indices", "SELECT * FROM fx_current_indices")
def q_current_indices(spark, d):
    return gold.current_indices(Pipeline(spark, d).bronze.routine_details)


@query("gold_prompt", "SELECT * FROM fx_gold")
def q_gold_prompt(spark, d):
    return Pipeline(spark, d).gold


@query("gold_prompt_planned_only", f"""
SELECT current_index AS exercise_index, {_GOLD} FROM fx_gold_wide WHERE planned_rest IS NOT NULL""")
def q_gold_prompt_planned_only(spark, d):
    p = Pipeline(spark, d)
    return gold.gold_prompt(p.fact_table, p.dim_exercise, p.dim_routine, p.bronze.routine_details, exclude_unplanned=True)


@query("gold_ordered", "SELECT * FROM fx_gold")
def q_gold_ordered(spark, d):
    return gold.gold_ordered(Pipeline(spark, d).gold)


@query("routine_list", "SELECT DISTINCT routine_id AS id, routine_name AS title FROM fx_gold")
def q_routine_list(spark, d):
    p = Pipeline(spark, d)
    return gold.routine_list(gold.routine_names(p.fact_table, p.dim_routine), "routine_id", "routine_name")


@query("routine_list_named", """
SELECT DISTINCT routine_id AS id, routine_name AS title FROM fx_dim_routine WHERE routine_name IS NOT NULL""")
def q_routine_list_named(spark, d):
    return gold.routine_list(Pipeline(spark, d).dim_routine, "routine_id", "routine_name", require_name=True)


cte("fx_norm_routines", """
SELECT DISTINCT routine_id AS id, title, folder_id, updated_at, created_at FROM fx_routines""")


@query("routine_list_plain", "SELECT id, title FROM fx_norm_routines")
def q_routine_list_plain(spark, d):
    from liftlake.operators import normalized
    p = Pipeline(spark, d)
    return gold.routine_list(normalized.norm_routines(p.bronze.routines), "id", "title")

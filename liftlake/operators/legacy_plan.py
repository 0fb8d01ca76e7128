"""Next-session plans of the legacy chain.

They start from the planned routine, not from the last performed cycle: an
exercise with a recommendation gets the warm-up ladder and as many working sets
as it has planned normal ones, its notes behind the coach's; any other keeps its
planned sets and notes. The rest between sets stays as planned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftlake.operators.plan import DEFAULT_WORKING_SETS, of_routine, warmup_ladder

_SET = {"type": "string", "weight_kg": "double", "reps": "int", "distance_meters": "double", "duration_seconds": "double"}
_SETS = "array<struct<" + ",".join(f"{k}:{t}" for k, t in _SET.items()) + ">>"
_EXERCISE = ["routine_id", "title", "exercise_index", "exercise_template_id", "supersets_id", "rest_seconds", "exercise_notes"]


def _set(**values: Column) -> Column:
    return F.struct(*[values.get(k, F.lit(None)).cast(t).alias(k) for k, t in _SET.items()])


def exercise_plans(flat_routines: DataFrame, recs: DataFrame) -> DataFrame:
    """One row per routine exercise with its next ``sets`` and ``notes``.

    An exercise without planned sets (an outer row without index and type) has
    none to copy and gets the default number of working sets; a recommendation
    without weight, or of 0 kg, gives no warm-up; missing old notes are empty.
    A routine holds a bounded number of exercises and sets, so its rows are spread by
    the routine once, where its sets are gathered and its recommendations, which
    come by routine, are joined."""
    planned = _set(type=F.col("set_type"), **{k: F.col(k) for k in list(_SET)[1:]})
    has_set = F.col("set_index").isNotNull() | F.col("set_type").isNotNull()
    rows = flat_routines.where("routine_id IS NOT NULL AND exercise_index IS NOT NULL").select(*_EXERCISE, "set_index", "set_type", *list(_SET)[1:])
    exercises = (rows.repartition("routine_id").groupBy(*_EXERCISE)
                 .agg(F.array_sort(F.collect_list(F.when(has_set, F.struct("set_index", planned.alias("s"))))).alias("planned"))
                 .withColumn("planned", F.transform("planned", lambda x: x["s"])))
    own = recs.select("routine_id", "exercise_template_id", "reasoning", "rpe_target", F.lit(True).alias("_has"),
                      F.col("weight_kg").alias("tw"), F.col("reps").alias("tr"))
    j = of_routine(exercises, own)
    has = F.coalesce(F.col("_has"), F.lit(False))
    normal = F.size(F.filter("planned", lambda s: F.coalesce(s["type"] == "normal", F.lit(False))))
    working = F.transform(F.sequence(F.lit(1), F.when(normal > 0, normal).otherwise(DEFAULT_WORKING_SETS)),
                          lambda _: _set(type=F.lit("normal"), weight_kg=F.col("tw"), reps=F.col("tr")))
    warm = F.transform(warmup_ladder(F.col("tw")), lambda w: _set(type=F.lit("warmup"), weight_kg=w["weight_kg"], reps=w["reps"]))
    old = F.coalesce("exercise_notes", F.lit(""))
    rpe = F.when(F.coalesce("rpe_target", F.lit(0.0)) != 0, F.concat(F.lit(" RPE "), F.col("rpe_target").cast("string"))).otherwise(F.lit(""))
    return j.select(
        "routine_id", F.col("title").alias("routine_title"), F.col("exercise_index").alias("order_index"), "exercise_template_id",
        F.col("supersets_id").cast("int").alias("superset_id"), F.col("rest_seconds").cast("int").alias("rest_seconds"),
        F.when(has, F.concat(F.lit("[AI: "), F.coalesce("reasoning", F.lit("None")), rpe, F.lit("] "), old)).otherwise(old).alias("notes"),
        F.when(has, F.concat(warm, working)).otherwise(F.col("planned")).cast(_SETS).alias("sets"), has.alias("has_recommendation"))


def set_rows(plans: DataFrame) -> DataFrame:
    """The plans flattened: one row per set."""
    return plans.select("routine_id", "order_index", "exercise_template_id", "has_recommendation", F.posexplode("sets").alias("set_no", "s")).select(
        "routine_id", "order_index", "exercise_template_id", "has_recommendation", "set_no", F.col("s.type").alias("set_type"),
        *[F.col(f"s.{k}").alias(k) for k in list(_SET)[1:]])


def payloads(flat_routines: DataFrame, plans: DataFrame, run_date: Column) -> DataFrame:
    """One update payload per routine as JSON text. Missing values are written
    as null, as this chain sends them; a routine without exercises has an
    empty list."""
    order = F.struct("order_index", "exercise_template_id")
    one = F.struct(order.alias("o"), F.struct("exercise_template_id", "superset_id", "rest_seconds", "notes", "sets").alias("e"))
    per = plans.groupBy("routine_id").agg(F.array_sort(F.collect_list(one)).alias("xs"))
    empty = F.array().cast(per.schema["xs"].dataType)
    heads = flat_routines.where("routine_id IS NOT NULL").select("routine_id", "title").distinct()
    exercises = F.transform(F.coalesce("xs", empty), lambda x: x["e"])
    body = F.struct(F.struct(F.col("title"), F.concat(F.lit("AI Plan: "), F.date_format(run_date, "yyyy-MM-dd")).alias("notes"),
                             exercises.alias("exercises")).alias("routine"))
    return heads.join(per, "routine_id", "left").select("routine_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("payload_json"))

"""Static enum dimensions of the training-log service."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The service's enums.
MUSCLE_GROUPS = [
    "abdominals", "shoulders", "biceps", "triceps", "forearms", "quadriceps",
    "hamstrings", "calves", "glutes", "abductors", "adductors", "lats",
    "upper_back", "traps", "lower_back", "chest", "cardio", "neck", "full_body", "other",
]
EQUIPMENT_CATEGORIES = [
    "none", "barbell", "dumbbell", "kettlebell", "machine", "plate",
    "resistance_band", "suspension", "other",
]
EXERCISE_TYPES = [
    "weight_reps", "reps_only", "bodyweight_reps", "bodyweight_assisted_reps",
    "duration", "weight_duration", "distance_duration", "short_distance_weight",
]
SET_TYPES = ["warmup", "normal", "failure", "dropset"]

ENUMS = {"muscle_group": MUSCLE_GROUPS, "equipment_category": EQUIPMENT_CATEGORIES,
         "exercise_type": EXERCISE_TYPES}


def enum_dimensions(spark: SparkSession) -> dict[str, DataFrame]:
    """The three enum tables, one ``name`` column each."""
    return {k: spark.createDataFrame([(v,) for v in vals], "name string") for k, vals in ENUMS.items()}


def enum_table(spark: SparkSession, enums: dict[str, list[str]] = ENUMS) -> DataFrame:
    rows = [(k, v) for k, vals in enums.items() for v in vals]
    return spark.createDataFrame(rows, "enum_name string, name string")


def enum_usage(spark: SparkSession, templates: DataFrame, sets: DataFrame) -> DataFrame:
    """Every enum value with the number of rows that use it: templates for
    muscle groups and exercise types (compared case-insensitively; equipment is
    not carried by templates), performed sets for set types (none is normal).
    The enum side is a fixed table of 41 rows, broadcast by construction."""
    t = templates.select(F.lower("primary_muscle_group").alias("m"), F.lower("type").alias("t"))
    used = (t.select(F.lit("muscle_group").alias("enum_name"), F.col("m").alias("name"))
            .unionByName(t.select(F.lit("exercise_type").alias("enum_name"), F.col("t").alias("name")))
            .unionByName(sets.select(F.lit("set_type").alias("enum_name"), F.coalesce("set_type", F.lit("normal")).alias("name")))
            .filter(F.col("name").isNotNull())
            .groupBy("enum_name", "name").agg(F.count(F.lit(1)).alias("n")))
    e = F.broadcast(enum_table(spark, ENUMS | {"set_type": SET_TYPES}))
    return (e.join(used, ["enum_name", "name"], "left")
            .select("enum_name", "name", F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n_uses")))


def _values(name: str, vals: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS enum_name, '{v}' AS name" for v in vals)


ORACLE_SQL = f"""
WITH e AS ({" UNION ALL ".join(_values(k, v) for k, v in (ENUMS | {"set_type": SET_TYPES}).items())}),
u AS (SELECT 'muscle_group' AS enum_name, lower(primary_muscle_group) AS name FROM fx_templates
      UNION ALL SELECT 'exercise_type', lower(type) FROM fx_templates
      UNION ALL SELECT 'set_type', CASE WHEN l_returnflag <> 'R' AND l_linenumber = 1 THEN 'warmup' ELSE 'normal' END FROM lineitem)
SELECT e.enum_name, e.name, CAST(COUNT(u.name) AS BIGINT) AS n_uses
FROM e LEFT JOIN u ON e.enum_name = u.enum_name AND e.name = u.name
GROUP BY e.enum_name, e.name"""

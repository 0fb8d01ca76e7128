"""Coach analytics (K1-K8): per-exercise history, stall analysis,
periodisation, routine documents.

Every per-exercise computation runs for all exercises of all athletes in one
job. Windows here only ever see bounded groups: the newest-20 filter is a
rank filter that Spark limits map-side before the shuffle, and everything
after it works on at most 20 sets / 5 sessions per exercise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from liftlake.operators.fact import with_exercise
from liftlake.functions.metrics import e1rm
from liftlake.session import by_shuffle, same

# Fixed values of the coach rules.
HISTORY_SETS = 20
HISTORY_SESSIONS = 5
STALL_FACTOR = 1.01
HARD_RPE = 8.5
STATUS_RULES = [
    # (status, action) in the order they are tested
    ("REGRESSION", "RESET"),
    ("GRINDING", "DELOAD"),
    ("SANDBAGGING", "PUSH_HARDER"),
    ("STAGNATION", "CHANGE_REP_RANGE"),
    ("FAST_GAINS", "AGGRESSIVE_LOAD"),
    ("PROGRESS", "LINEAR_LOAD"),
]


def recent_sets(sets: DataFrame, workouts: DataFrame, exercises: DataFrame, n: int = HISTORY_SETS) -> DataFrame:
    """K1: the newest ``n`` normal sets of every exercise template (ties on the
    start time broken by workout, exercise and set index)."""
    s = sets.filter(F.col("set_type") == "normal").select("workout_id", "exercise_index", "set_index", "weight_kg",
                                                          "reps", "rpe")
    j = with_exercise(s.join(workouts.select("workout_id", "start_time"), "workout_id", "inner"),
                      exercises.select("workout_id", "exercise_index", "exercise_template_id"))
    return newest_sets(j, n)


def newest_sets(sets: DataFrame, n: int = HISTORY_SETS) -> DataFrame:
    """The newest ``n`` rows of every template, numbered as ``rn``; a rank
    filter that each task applies before the shuffle."""
    w = Window.partitionBy("exercise_template_id").orderBy(
        F.col("start_time").desc_nulls_last(), "workout_id", "exercise_index", "set_index")
    return sets.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)


def session_history(recent: DataFrame, n: int = HISTORY_SESSIONS) -> DataFrame:
    """K2: per template and calendar day the best set by (weight or 0, reps
    or 0; first in recency order on ties); the newest ``n`` days."""
    day = F.to_date("start_time")
    key = F.struct(F.coalesce(F.col("weight_kg"), F.lit(0.0)), F.coalesce(F.col("reps"), F.lit(0)), -F.col("rn"))
    best = (recent.withColumn("date", day).groupBy("exercise_template_id", "date")
            .agg(F.max_by(F.struct("weight_kg", "reps", "rpe"), key).alias("b")))
    w = Window.partitionBy("exercise_template_id").orderBy(F.col("date").desc_nulls_last())
    return (best.withColumn("session_no", F.row_number().over(w)).filter(F.col("session_no") <= n)
            .select("exercise_template_id", "session_no", "date", F.col("b.weight_kg").alias("weight"),
                    F.col("b.reps").alias("reps"), F.col("b.rpe").alias("rpe")))


def stall_analysis(history: DataFrame) -> DataFrame:
    """K3-K6 per template over its sessions (newest first):

    * fewer than 2 sessions -> NEW / LINEAR_LOAD with zero metrics;
    * sessions without weight or reps are skipped; none left -> ERROR / MAINTAIN;
    * trend % of the newest e1RM against session min(n-1, 3) (0 if that is <= 0);
    * mean RPE of the newest 3 sessions (missing or 0 RPE ignored, none -> 0);
    * stall streak = leading run of sessions whose e1RM is at most 1 % above
      the next older one *and* whose RPE is at least 8.5;
    * ordered status rules; metrics rounded to one decimal half-to-even,
      as Python's round() does for exactly representable ties.
    """
    n_all = history.groupBy("exercise_template_id").agg(F.count(F.lit(1)).alias("n_sessions"))
    p = history.filter(F.col("weight").isNotNull() & F.col("reps").isNotNull())
    w = Window.partitionBy("exercise_template_id").orderBy("session_no")
    p = (p.withColumn("k", F.row_number().over(w))
         .withColumn("e1rm", e1rm(F.col("weight").cast("double"), F.col("reps").cast("int")))
         .withColumn("rpe_v", F.when(F.col("rpe") != 0, F.col("rpe").cast("double")))
         .withColumn("next_e1rm", F.lead("e1rm").over(w)))
    hit = (F.col("next_e1rm").isNotNull() & (F.col("e1rm") <= F.col("next_e1rm") * STALL_FACTOR)
           & (F.coalesce(F.col("rpe_v"), F.lit(0.0)) >= HARD_RPE))
    agg = p.groupBy("exercise_template_id").agg(
        F.count(F.lit(1)).alias("n_proc"),
        F.max(F.when(F.col("k") == 1, F.col("e1rm"))).alias("cur"),
        F.collect_list(F.struct("k", "e1rm")).alias("_e"),  # <= 5 sessions per template
        F.avg(F.when(F.col("k") <= 3, F.col("rpe_v"))).alias("avg_rpe"),
        F.min(F.when(~hit, F.col("k"))).alias("first_miss"),
    )
    ref_k = F.least(F.col("n_proc") - 1, F.lit(3)) + 1
    past = F.filter("_e", lambda x: x["k"] == ref_k)[0]["e1rm"]
    trend = F.when(past > 0, (F.col("cur") - past) / past * 100).otherwise(F.lit(0.0))
    m = agg.select("exercise_template_id", "n_proc", "cur", trend.alias("trend"),
                   F.coalesce(F.col("avg_rpe"), F.lit(0.0)).alias("avg_rpe"),
                   (F.coalesce(F.col("first_miss"), F.col("n_proc")) - 1).alias("streak"))
    j = n_all.join(m, "exercise_template_id", "left")
    status = (F.when(F.col("trend") < -5.0, F.lit(0))
              .when((F.col("streak") >= 2) & (F.col("avg_rpe") >= 9.0), F.lit(1))
              .when((F.col("streak") >= 2) & (F.col("avg_rpe") < 7.0), F.lit(2))
              .when(F.col("streak") >= 3, F.lit(3))
              .when(F.col("trend") > 5.0, F.lit(4))
              .otherwise(F.lit(5)))
    names = F.array(*[F.lit(s) for s, _ in STATUS_RULES])
    actions = F.array(*[F.lit(a) for _, a in STATUS_RULES])
    new = F.col("n_sessions") < 2
    err = F.coalesce(F.col("n_proc"), F.lit(0)) == 0
    return j.select(
        "exercise_template_id",
        F.when(new, F.lit(0)).when(err, F.lit(None)).otherwise(F.col("streak")).cast("int").alias("stall_streak"),
        F.when(new, F.lit(0.0)).when(err, F.lit(None)).otherwise(F.bround("cur", 1)).alias("e1rm_current"),
        F.when(new, F.lit(0.0)).when(err, F.lit(None)).otherwise(F.bround("trend", 1)).alias("e1rm_trend_percent"),
        F.when(new, F.lit(0.0)).when(err, F.lit(None)).otherwise(F.bround("avg_rpe", 1)).alias("avg_rpe_last_3"),
        F.when(new, F.lit("NEW")).when(err, F.lit("ERROR")).otherwise(names[status]).alias("status"),
        F.when(new, F.lit("LINEAR_LOAD")).when(err, F.lit("MAINTAIN")).otherwise(actions[status])
        .alias("recommended_action"),
    )


def cycle_phase(gold: DataFrame) -> DataFrame:
    """K8: next cycle per routine and whether it is a deload cycle."""
    nxt = (F.coalesce(F.max("cycle_number"), F.lit(0)) + 1).cast("int")
    return (gold.groupBy("routine_id").agg(nxt.alias("next_cycle"))
            .withColumn("phase", F.when(F.col("next_cycle") % 4 == 0, F.lit("DELOAD")).otherwise(F.lit("PROGRESSION"))))


def _first_key() -> Column:
    """Row order of a routine document: cycle, exercise index (nulls first),
    set index; set type and planned rest break the remaining ties."""
    return F.struct(F.col("cycle_number"), F.col("exercise_index").isNotNull(), F.col("exercise_index"),
                    F.col("set_index"), F.col("set_type"), F.col("planned_rest").isNotNull(), F.col("planned_rest"))


def exercise_attributes(gold: DataFrame) -> DataFrame:
    """K10 header of every (routine, exercise): attributes of its first row."""
    attrs = F.struct(F.col("exercise_index"), F.col("superset_id"), F.col("exercise_name").alias("title"),
                     "primary_muscle_group", "progression_step_kg", F.col("planned_rest").alias("rest_seconds"))
    return (gold.groupBy("routine_id", "exercise_template_id")
            .agg(F.min_by(attrs, _first_key()).alias("a"), F.max("routine_name").alias("rt"),
                 F.max("cycle_number").alias("last_cycle"))
            .select("routine_id", F.col("rt").alias("routine_title"), "exercise_template_id", "a.*", "last_cycle"))


def routine_documents(gold: DataFrame) -> DataFrame:
    """K10, flattened to set grain: every gold row with the exercise header
    it belongs to (routine -> exercise -> cycle -> set)."""
    h = exercise_attributes(gold).withColumnRenamed("exercise_index", "doc_exercise_index")
    g = gold.select("routine_id", "exercise_template_id", F.col("cycle_number").alias("cycle"), "set_index",
                    "set_type", "actual_weight_kg", "actual_reps", "rpe", "planned_weight_kg", "planned_reps",
                    "execution_status", "diff_weight_kg", "diff_reps")
    return g.join(by_shuffle(h), ["routine_id", "exercise_template_id"], "inner").select(
        "routine_id", "routine_title", "exercise_template_id", F.col("doc_exercise_index").alias("exercise_index"),
        "superset_id", "title", "primary_muscle_group", "progression_step_kg", "rest_seconds", "cycle", "set_index",
        "set_type", "actual_weight_kg", "actual_reps", "rpe", "planned_weight_kg", "planned_reps", "execution_status",
        "diff_weight_kg", "diff_reps")


def last_cycle_sets(gold: DataFrame) -> DataFrame:
    """Sets of the last cycle of every (routine, exercise) with its header."""
    docs = routine_documents(gold)
    last = exercise_attributes(gold).select("routine_id", "exercise_template_id", "last_cycle")
    return (docs.join(by_shuffle(last), ["routine_id", "exercise_template_id"], "inner")
            .filter(same(F.col("cycle"), F.col("last_cycle"))).drop("last_cycle"))

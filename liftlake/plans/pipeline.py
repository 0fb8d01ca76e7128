"""The medallion flow over one data directory, as lazily built DataFrames.

Each attribute is a logical plan; Catalyst prunes what a query does not use.
Layer tables (set-grain bronze, plan details, the silver fact, gold, sessions)
are the exception: asking for one looks at the source files, and writes the
layer when its version is not current (see ``sources.catalog``).
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from liftlake.operators import coach, dims, fact, gold, plan, scd2
from liftlake.sources import fixtures as fx


# The sets of one routine's exercise lie together, as the coach reads them.
BY_EXERCISE = tuple(fact.EXERCISE_KEYS)


class Pipeline:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    # ---------------------------------------------------------------- bronze
    @cached_property
    def bronze(self) -> fx.Bronze:
        return fx.bronze(self.spark, self.sf_dir)

    def routines_snapshot(self, ver: int) -> DataFrame:
        return fx.routines(self.spark, self.sf_dir, ver)

    def details_snapshot(self, ver: int) -> DataFrame:
        return fx.snapshot(self.spark, self.sf_dir, ver)[1]

    # ---------------------------------------------------------------- silver
    def staged(self, ver: int) -> DataFrame:
        return scd2.stage(self.routines_snapshot(ver), self.details_snapshot(ver))

    @cached_property
    def scd_after_first_run(self) -> DataFrame:
        return scd2.apply(None, self.staged(0), fx.ts(fx.SNAPSHOT_RUN_TS[0]))

    @cached_property
    def scd(self) -> DataFrame:
        """Dimension state after both snapshot runs (two runs: the lineage
        stays short; ``scd2.apply_runs`` cuts it for longer histories)."""
        return scd2.apply(self.scd_after_first_run, self.staged(1), fx.ts(fx.SNAPSHOT_RUN_TS[1]))

    def snapshots(self) -> DataFrame:
        """All extracts of the plan history as staged rows with their run time."""
        from liftlake.functions.hashing import row_hash
        return fx.plan_history(self.spark, self.sf_dir).select(*scd2.STAGED_COLS, "run_ts").withColumn("scd_hash", row_hash(scd2.STAGED_COLS))

    @cached_property
    def scd_history(self) -> DataFrame:
        """The dimension after all of them."""
        return fx.stored(self.spark, self.sf_dir, "scd_history", lambda: scd2.replay(self.snapshots()), fx.PLAN_SOURCES)

    @cached_property
    def progression_raw(self) -> DataFrame:
        return fx.progression_raw(self.spark, self.sf_dir)

    @cached_property
    def progression(self) -> DataFrame:
        return dims.progression_lookup(self.progression_raw)

    @cached_property
    def dim_exercise(self) -> DataFrame:
        return dims.dim_exercise(self.bronze.exercise_templates, self.progression, default=0.0)

    @cached_property
    def dim_routine(self) -> DataFrame:
        return dims.dim_routine(self.scd_table)

    @cached_property
    def actual(self) -> DataFrame:
        b = self.bronze
        return fact.actual_sets(b.workout_sets, b.workouts_by_id, b.workout_exercises)

    @cached_property
    def cycle_keys(self) -> DataFrame:
        b = self.bronze
        return fact.cycle_keys(b.workout_sets, b.workouts_by_id, b.workout_exercises)

    @cached_property
    def headers(self) -> DataFrame:
        return fact.workout_headers_of(self.bronze.workout_sets, self.bronze.workouts_by_id, self.bronze.workout_exercises)

    @cached_property
    def scd_table(self) -> DataFrame:
        """The dimension as the last run wrote it: what the fact reads."""
        return fx.stored(self.spark, self.sf_dir, "silver_scd", lambda: self.scd)

    @cached_property
    def fact(self) -> DataFrame:
        b = self.bronze
        keys = fact.cycle_keys(b.workout_sets, b.workouts_by_id, b.workout_exercises, with_workout=True)
        return fact.fact_workout_history(self.actual, self.scd_table, keys=keys)

    @cached_property
    def fact_table(self) -> DataFrame:
        """The silver fact as a written table: what the dashboards read, as
        the silver layer is persisted once and read by every dashboard
        query."""
        return fx.stored(self.spark, self.sf_dir, "silver_fact", lambda: self.fact, bucket_by=BY_EXERCISE)

    # ---------------------------------------------------------------- gold
    @cached_property
    def gold(self) -> DataFrame:
        """Gold reads the silver fact as written, as every run of it does."""
        return gold.gold_prompt(self.fact_table, self.dim_exercise, self.dim_routine, self.bronze.routine_details)

    @cached_property
    def gold_table(self) -> DataFrame:
        """The gold table as written: what the coach reads."""
        return fx.stored(self.spark, self.sf_dir, "gold", lambda: self.gold, bucket_by=BY_EXERCISE)

    # ---------------------------------------------------------------- coach
    @cached_property
    def recent_sets(self) -> DataFrame:
        b = self.bronze
        return coach.recent_sets(b.workout_sets, b.workouts_by_id, b.workout_exercises)

    @cached_property
    def sessions(self) -> DataFrame:
        """At most 5 rows per exercise, read several times by the analytics."""
        return fx.stored(self.spark, self.sf_dir, "sessions", lambda: coach.session_history(self.recent_sets))

    @cached_property
    def stall(self) -> DataFrame:
        return coach.stall_analysis(self.sessions)

    @cached_property
    def replies(self) -> DataFrame:
        return fx.coach_replies(self.gold_table)

    @cached_property
    def recommendations(self) -> DataFrame:
        return plan.parse_recommendations(self.replies)

"""Training-log tables projected from the driver's TPC-H-style tables.

The driver data holds no workouts, so orders become workouts, lineitems
become performed sets, customers own one routine each (planned in two
snapshots), and parts are exercise templates. Every column is a
pure function of the source row, so the projection scales with the source
and costs one narrow pass per table (plus one small window over
(order, exercise) groups of at most seven lines).

All timestamps are TIMESTAMP_NTZ (wall-clock UTC) so results do not depend on
the session time zone.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from liftlake.functions.parsing import python_json_list
from liftlake.session import by_shuffle, same
from liftlake.sources import inputs
from liftlake.sources.catalog import Catalog

# Fixed values of the fixture (they define the projection, shared with the
# DuckDB oracle text in liftlake/plans/oracle_sql.py).
SNAPSHOT_RUN_TS = {0: "1996-01-01 00:00:00", 1: "1999-01-01 00:00:00"}
ROUTINE_CREATED_AT = "1995-01-01 00:00:00"
ROUTINE_UPDATED_AT = "1995-06-01 00:00:00"
TEMPLATE_INGESTED_AT = "1999-01-01 00:00:00"


def ts(text: str) -> Column:
    """A TIMESTAMP_NTZ literal."""
    return F.lit(text).cast("timestamp_ntz")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A source table in its present state."""
    return inputs.relation(spark, sf_dir, name)


def n_templates(spark: SparkSession, sf_dir: str) -> Column:
    """Size of the template id range, as a scalar subquery on the part keys;
    performed, planned and fed exercises take their template from it."""
    return read_table(spark, sf_dir, "part").agg(F.max("p_partkey") + 1).scalar()


# ---------------------------------------------------------------- workouts

# Columns of a workout, over those of an order.
WORKOUT_COLS = [
    "CAST(o_orderkey AS STRING) AS workout_id",
    "'W-' || CAST(o_orderkey AS STRING) AS title",
    "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS description",
    "CAST(o_orderdate AS TIMESTAMP_NTZ) AS start_time",
    "CAST(o_orderdate AS TIMESTAMP_NTZ) + INTERVAL 1 HOUR AS end_time",
    "CAST(o_orderdate AS TIMESTAMP_NTZ) + INTERVAL 2 HOURS AS updated_at",
    "CAST(o_orderdate AS TIMESTAMP_NTZ) AS created_at",
    "CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE CAST(o_custkey AS STRING) END AS routine_id",
    "CAST(o_orderdate AS TIMESTAMP_NTZ) + INTERVAL 1 DAY AS ingestion_timestamp",
]
# Columns of a set, over those of a line.
SET_COLS = [
    "CASE WHEN l_returnflag = 'R' THEN NULL WHEN l_linenumber = 1 THEN 'warmup' ELSE 'normal' END AS set_type",
    "CASE WHEN l_suppkey % 19 = 0 OR l_tax = 0.0 THEN NULL "
    "ELSE CAST((l_suppkey % 6) * 2.5 + 40 AS DOUBLE) END AS weight_kg",
    "CASE WHEN l_suppkey % 19 = 0 OR l_suppkey % 17 = 0 THEN NULL ELSE CAST(5 + l_linenumber % 5 AS INT) END AS reps",
    "CAST(NULL AS DOUBLE) AS distance_meters",
    "CASE WHEN l_suppkey % 17 = 0 THEN CAST(30 * (1 + l_linenumber % 3) AS DOUBLE) END AS duration_seconds",
    "CASE WHEN l_discount = 0.0 THEN NULL ELSE CAST(6 + l_discount * 40 AS DOUBLE) END AS rpe",
    "CASE WHEN l_suppkey % 19 = 0 THEN CAST(l_linenumber AS DOUBLE) END AS custom_metric",
    "CAST(l_shipdate AS TIMESTAMP_NTZ) + INTERVAL 1 DAY AS ingestion_timestamp",
]
# Columns of a performed exercise, over its index, its order and ``n_templates``.
EXERCISE_COLS = [
    "'E-' || CAST(exercise_index AS STRING) AS title",
    "CAST(NULL AS STRING) AS notes",
    "CAST((o_custkey * 4 + exercise_index) % n_templates AS STRING) AS exercise_template_id",
    "CAST(CASE WHEN exercise_index < 2 AND o_custkey % 4 = 0 THEN 1 END AS INT) AS superset_id",
]
LINE_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_shipdate", "l_discount", "l_tax", "l_returnflag"]
EXERCISE_INDEX = "CAST(l_partkey % 4 AS INT)"


def workouts(spark: SparkSession, sf_dir: str, with_custkey: bool = False) -> DataFrame:
    """bronze_workouts: one row per order."""
    cols = WORKOUT_COLS + ["o_custkey AS fx_custkey", "o_orderkey AS fx_orderkey"] * with_custkey
    return read_table(spark, sf_dir, "orders").selectExpr(*cols)


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unique set coordinates: (order, exercise = partkey % 4, set = rank of
    the line within that exercise). Window groups hold <= 7 lines."""
    workout_id = F.col("l_orderkey").cast("string")
    # Hash-partitioned by the workout id once: the set-index window (per
    # workout and exercise) and the joins to the workout and exercise tables
    # (on the workout id) then need no further shuffle of the set rows, as
    # with bronze tables bucketed by workout id. The source's own columns
    # travel, and what is made from them is made where they arrive.
    li = read_table(spark, sf_dir, "lineitem").select(*LINE_COLS).repartition(workout_id)
    li = li.withColumn("exercise_index", F.expr(EXERCISE_INDEX)).withColumn("workout_id", workout_id)
    return li.withColumn("set_index", set_index("workout_id", "exercise_index"))


def set_index(*group: str) -> Column:
    """Place of a line among those of its order and exercise."""
    w = Window.partitionBy(*group).orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    return (F.row_number().over(w) - 1).cast("int")


def workout_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bronze_workout_sets: one row per lineitem."""
    return _lines(spark, sf_dir).selectExpr("workout_id", "exercise_index", "set_index", *SET_COLS)


def workout_exercises(spark: SparkSession, sf_dir: str, sets: DataFrame, headers: DataFrame) -> DataFrame:
    """bronze_workout_exercises: distinct (order, exercise) pairs of the set rows.
    ``sets`` and ``headers`` (workouts with their customer) lie by the workout id, as the
    stored table does, so pairs are deduplicated, joined and written where they lie."""
    pairs = sets.select("workout_id", "exercise_index").distinct()
    o = headers.select("workout_id", F.col("fx_custkey").alias("o_custkey"), "start_time")
    j = pairs.join(by_shuffle(o), "workout_id", "inner").withColumn("n_templates", n_templates(spark, sf_dir))
    return j.selectExpr("workout_id", "exercise_index", *EXERCISE_COLS, "start_time + INTERVAL 1 DAY AS ingestion_timestamp")


def workouts_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bronze_workouts with their customer, spread by the workout id as orders."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return o.repartition(n, F.col("o_orderkey").cast("string")).selectExpr(*WORKOUT_COLS, "o_custkey AS fx_custkey")


# ---------------------------------------------------------------- templates

def exercise_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bronze_exercise_templates; secondary muscles as JSON text."""
    p = read_table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").cast("string").alias("id"),
        F.col("p_name").alias("title"),
        F.when(F.col("p_size") % 9 == 0, F.lit(None).cast("string")).otherwise(F.col("p_type")).alias("type"),
        F.when(F.col("p_size") % 10 == 0, F.lit(None).cast("string")).otherwise(F.col("p_brand")).alias("primary_muscle_group"),
        python_json_list(secondary_muscles_array()).alias("secondary_muscle_groups"),
        (F.col("p_size") > 40).alias("is_custom"),
        ts(TEMPLATE_INGESTED_AT).alias("ingestion_timestamp"),
    )


def secondary_muscles_array() -> Column:
    """Over part columns: none for sizes divisible by 3, one brand-derived
    muscle for even sizes, two otherwise."""
    one = F.array(F.concat(F.lit("m"), (F.col("p_size") % 7).cast("string")))
    two = F.array(F.concat(F.lit("m"), (F.col("p_size") % 7).cast("string")),
                  F.concat(F.lit("m"), (F.col("p_size") % 5).cast("string")))
    return (F.when(F.col("p_size") % 3 == 0, F.array().cast("array<string>"))
            .when(F.col("p_size") % 2 == 0, one).otherwise(two))


def progression_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progression reference rows (name, step, line_no); names starting with
    'old' have no step on purpose. Part names repeat, so the same name appears
    on several lines with one step."""
    p = read_table(spark, sf_dir, "part")
    step = (F.when(F.col("p_name").like("old%"), F.lit(None))
            .when(F.length("p_name") % 4 == 0, F.lit(0.0))
            .when(F.length("p_name") % 4 == 1, F.lit(1.25))
            .when(F.length("p_name") % 4 == 2, F.lit(2.5))
            .otherwise(F.lit(5.0))).cast("double")
    return p.select(F.col("p_name").alias("exercise_name"), step.alias("progression_step_kg"),
                    F.col("p_partkey").alias("line_no"))


# ---------------------------------------------------------------- routines

def plan_rows(spark: SparkSession, sf_dir: str, versions=(0, 1)) -> DataFrame:
    """Planned sets of every customer's routine in the given snapshots:
    4 exercises x 2 sets (+1 set for customers % 9 in snapshot 1), some
    exercises removed in snapshot 1, and weights changed for customers % 7.
    Generated with array explosion (no cross join)."""
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    vers = ", ".join(str(int(v)) for v in versions)
    g = c.selectExpr("c_custkey AS k", "c_nationkey", "c_mktsegment", f"explode(array({vers})) AS ver") \
        .selectExpr("*", "explode(sequence(0, 3)) AS ei").selectExpr("*", "explode(sequence(0, 2)) AS si") \
        .where("(si < 2 OR (ver = 1 AND k % 9 = 0)) AND NOT (ver = 1 AND (k + ei) % 23 = 0)")
    reps = "CASE WHEN k % 13 = 0 OR k % 17 = 0 THEN NULL ELSE 6 + (k + ei) % 3 END"
    out = g.withColumn("n_templates", n_templates(spark, sf_dir)).selectExpr(
        "CAST(ver AS INT) AS ver",
        "CAST(k AS STRING) AS routine_id",
        "c_mktsegment || '-' || CAST(k % 10 AS STRING) AS title",
        "CAST(c_nationkey AS STRING) AS folder_id",
        f"TIMESTAMP_NTZ'{ROUTINE_UPDATED_AT}' AS updated_at",
        f"TIMESTAMP_NTZ'{ROUTINE_CREATED_AT}' AS created_at",
        "CAST(ei AS INT) AS exercise_index",
        "'E-' || CAST(ei AS STRING) AS exercise_title",
        "CAST(NULL AS STRING) AS exercise_notes",
        "CAST(90 + 30 * (k % 3) AS INT) AS rest_seconds",
        "CAST((k * 4 + ei) % n_templates AS STRING) AS exercise_template_id",
        "CAST(CASE WHEN ei < 2 AND k % 4 = 0 THEN 1 END AS INT) AS superset_id",
        "CAST(si AS INT) AS set_index",
        "CASE WHEN si = 0 AND k % 5 = 0 THEN 'warmup' ELSE 'normal' END AS set_type",
        "CAST(CASE WHEN ei = 3 OR k % 17 = 0 THEN NULL "
        "ELSE 40 + 2.5 * ((k + CASE WHEN k % 7 = 0 THEN ver ELSE 0 END) % 6) END AS DOUBLE) AS weight_kg",
        f"CAST({reps} AS INT) AS reps",
        f"CAST({reps} - 1 AS DOUBLE) AS rep_range_start",
        f"CAST({reps} + 1 AS DOUBLE) AS rep_range_end",
        "CAST(NULL AS DOUBLE) AS distance_meters",
        "CAST(CASE WHEN k % 13 = 0 THEN 60 END AS DOUBLE) AS duration_seconds",
        "CAST(NULL AS DOUBLE) AS rpe",
        "CAST(CASE WHEN k % 17 = 0 THEN 3 END AS DOUBLE) AS custom_metric",
    )
    # Spread the generated rows by routine id (the customer file may be one
    # split): the SCD2 apply and the plan match join on keys that start with
    # the routine id, so they reuse this partitioning. An explicit partition
    # count is not coalesced away by AQE, which matters because the rows feed
    # CPU-heavy fingerprinting.
    return out.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "routine_id")


HISTORY_RUNS = 12


def plan_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan as ``HISTORY_RUNS`` half-yearly extracts from 1992 on would
    have it: rows of the first snapshot with ``run_ts``; by routine key k, run r
    and exercise e: absent where (k + e + r) % 7 == 0, weights rising by 2.5
    every fourth run (at another one for each k % 5); the extract of run 6 is
    empty."""
    p = plan_rows(spark, sf_dir, versions=(0,)).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(HISTORY_RUNS - 1))))
    k, r = F.col("routine_id").cast("long"), F.col("r")
    kept = p.where((r != 6) & ((k + F.col("exercise_index") + r) % 7 != 0))
    return kept.withColumn("weight_kg", F.col("weight_kg") + 2.5 * F.floor((r + k % 5) / 4)).withColumn(
        "run_ts", F.expr("TIMESTAMP_NTZ'1992-01-01 00:00:00' + make_ym_interval(0, 6 * r)")).drop("r", "ver")


ROUTINE_HEADER_COLS = ["routine_id", "title", "folder_id", "updated_at", "created_at"]
ROUTINE_DETAIL_COLS = [
    "routine_id", "exercise_index", "exercise_title", "exercise_notes", "rest_seconds",
    "exercise_template_id", "superset_id", "set_index", "set_type", "weight_kg", "reps",
    "rep_range_start", "rep_range_end", "distance_meters", "duration_seconds", "rpe", "custom_metric",
]


def routines(spark: SparkSession, sf_dir: str, ver: int = 1) -> DataFrame:
    """bronze_routines of one snapshot (one header per customer)."""
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    k = F.col("c_custkey")
    return c.select(
        k.cast("string").alias("routine_id"),
        F.concat(F.col("c_mktsegment"), F.lit("-"), (k % 10).cast("string")).alias("title"),
        F.col("c_nationkey").cast("string").alias("folder_id"),
        ts(ROUTINE_UPDATED_AT).alias("updated_at"),
        ts(ROUTINE_CREATED_AT).alias("created_at"),
        ts(SNAPSHOT_RUN_TS[ver]).alias("ingestion_timestamp"),
    )


def routine_details(spark: SparkSession, sf_dir: str, ver: int = 1) -> DataFrame:
    """bronze_routine_details of one snapshot (set grain)."""
    p = plan_rows(spark, sf_dir, versions=(ver,))
    return p.select(*ROUTINE_DETAIL_COLS, ts(SNAPSHOT_RUN_TS[ver]).alias("ingestion_timestamp"))


def folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routine folders: one per nation."""
    n = read_table(spark, sf_dir, "nation")
    return n.select(
        F.col("n_nationkey").cast("string").alias("id"),
        F.col("n_regionkey").cast("int").alias("index"),
        F.col("n_name").alias("title"),
        ts(ROUTINE_UPDATED_AT).alias("updated_at"),
        ts(ROUTINE_CREATED_AT).alias("created_at"),
    )


SOURCES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
BY_WORKOUT = ("workout_id",)
# A plan holds few sets, as a workout does.
BY_ROUTINE = ("routine_id",)
SET_SOURCES, PLAN_SOURCES = ("orders", "lineitem", "part"), ("orders", "lineitem", "customer", "part")


def stored(
    spark: SparkSession, sf_dir: str, name: str, build, sources: tuple[str, ...] = SOURCES, bucket_by: tuple[str, ...] = ()
) -> DataFrame:
    """A layer table in the shared folder, built once for each state of the
    tables it comes from, the way the bronze layer is persisted before silver
    and gold read it."""
    return Catalog(spark).table(_layer(sf_dir, name), inputs.state_key(spark, sf_dir, sources), build, bucket_by)


def landed(spark: SparkSession, sf_dir: str, name: str, write, sources: tuple[str, ...] = SOURCES) -> str:
    """Path of landed files, written by ``write(path)`` once for each state of
    the tables they come from."""
    return Catalog(spark).folder(_layer(sf_dir, name), inputs.state_key(spark, sf_dir, sources), write)["path"]


def _layer(sf_dir: str, name: str) -> str:
    return f"{name}-{hashlib.sha256(sf_dir.rstrip('/').encode()).hexdigest()[:10]}"


class Bronze:
    """The six bronze tables of the current pipeline (latest extract). A table
    that is one narrow pass over its source is read from there; the others are
    written when a query first asks for them, each on its own."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @property
    def exercise_templates(self) -> DataFrame:
        return exercise_templates(self.spark, self.sf_dir)

    @property
    def routines(self) -> DataFrame:
        return routines(self.spark, self.sf_dir, 1)

    @property
    def workouts(self) -> DataFrame:
        return workouts(self.spark, self.sf_dir)

    @property
    def _workout_headers(self) -> DataFrame:
        return stored(self.spark, self.sf_dir, "workouts", lambda: workouts_by_id(self.spark, self.sf_dir), ("orders",), BY_WORKOUT)

    @property
    def workouts_by_id(self) -> DataFrame:
        """The workouts in the buckets of their sets and exercises."""
        return self._workout_headers.drop("fx_custkey")

    @property
    def routine_details(self) -> DataFrame:
        return stored(self.spark, self.sf_dir, "details1", lambda: routine_details(self.spark, self.sf_dir, 1), PLAN_SOURCES, BY_ROUTINE)

    @property
    def workout_exercises(self) -> DataFrame:
        return stored(
            self.spark, self.sf_dir, "exercises",
            lambda: workout_exercises(self.spark, self.sf_dir, self.workout_sets, self._workout_headers), SET_SOURCES, BY_WORKOUT)

    @property
    def workout_sets(self) -> DataFrame:
        return stored(self.spark, self.sf_dir, "sets", lambda: workout_sets(self.spark, self.sf_dir), SET_SOURCES, BY_WORKOUT)


def bronze(spark: SparkSession, sf_dir: str) -> Bronze:
    return Bronze(spark, sf_dir)


def snapshot(spark: SparkSession, sf_dir: str, ver: int) -> tuple[DataFrame, DataFrame]:
    """(routines, routine details) of one extract run, stored like bronze."""
    return (routines(spark, sf_dir, ver),
            stored(spark, sf_dir, f"details{ver}", lambda: routine_details(spark, sf_dir, ver), PLAN_SOURCES, BY_ROUTINE))


# ---------------------------------------------------------------- coach replies

def coach_replies(gold: DataFrame) -> DataFrame:
    """Stand-in for the coach model's replies, derived from the gold table so
    they grow with it: per routine one JSON text ``{"recommendations": {id:
    {...}}}`` covering the exercises of its last cycles, except those at
    exercise index 3 (they get no recommendation and are carried over).
    Replies of routines whose id is divisible by 13 lack ``reasoning`` and
    must be rejected whole."""
    last = (gold.groupBy("routine_id", "exercise_template_id")
            .agg(F.max("cycle_number").alias("_c")))
    g = gold.join(by_shuffle(last), ["routine_id", "exercise_template_id"]).filter(same(F.col("cycle_number"), F.col("_c")))
    per_ex = g.groupBy("routine_id", "exercise_template_id").agg(
        F.min("exercise_index").alias("idx"), F.max("superset_id").alias("ss"),
        F.max("actual_weight_kg").alias("w"), F.max("actual_reps").alias("r"),
        F.max("progression_step_kg").alias("step"))
    per_ex = per_ex.filter(F.coalesce(F.col("idx"), F.lit(-1)) != 3)
    weight = (F.coalesce(F.col("w"), F.lit(0.0)) + F.coalesce(F.col("step"), F.lit(0.0))).cast("double")
    reps = F.coalesce(F.col("r"), F.lit(8)).cast("int")
    rest = (F.when(F.col("idx") == 0, F.lit(210)).when(F.col("ss").isNotNull(), F.lit(90))
            .otherwise(F.lit(120)))
    bad = (F.col("routine_id").cast("long") % 13 == 0)
    rec = F.struct(weight.alias("weight_kg"), reps.alias("reps"), F.lit(8.0).alias("rpe_target"),
                   F.lit("LINEAR_LOAD").alias("strategy"), rest.alias("rest_seconds"),
                   F.when(~bad, F.concat(F.lit("Add "), F.coalesce(F.col("step"), F.lit(0.0)).cast("string"),
                                         F.lit(" kg"))).alias("reasoning"))
    per_routine = per_ex.groupBy("routine_id").agg(
        F.map_from_entries(F.collect_list(F.struct("exercise_template_id", rec))).alias("recommendations"))
    return per_routine.select("routine_id", F.to_json(F.struct("recommendations")).alias("response"))

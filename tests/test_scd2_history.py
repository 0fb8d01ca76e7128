import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from liftlake.functions.hashing import row_hash
from liftlake.operators import fact, scd2
from liftlake.plans.pipeline import Pipeline
from liftlake.sources import inputs

from .conftest import SF_SMALL

T0 = dt.datetime(2020, 1, 1)


def staged(spark, rows):
    """rows: (routine, exercise, set, weight, run)."""
    schema = "routine_id string, exercise_index int, set_index int, weight_kg double, run_ts timestamp_ntz"
    df = spark.createDataFrame([(r, e, s, w, T0 + dt.timedelta(days=n)) for r, e, s, w, n in rows], schema)
    types = {"folder_id": "string", "rest_seconds": "int", "superset_id": "int", "reps": "int", "updated_at": "timestamp_ntz", "created_at": "timestamp_ntz"}
    for c in scd2.STAGED_COLS:
        if c not in df.columns:
            kind = types.get(c, "double" if c in ("rep_range_start", "rep_range_end", "distance_meters", "duration_seconds", "rpe", "custom_metric") else "string")
            df = df.withColumn(c, F.lit(None).cast(kind))
    return df.select(*scd2.STAGED_COLS, "run_ts").withColumn("scd_hash", row_hash(scd2.STAGED_COLS))


def versions(df):
    return sorted((r.routine_id, r.exercise_index, r.set_index, r.scd_valid_from, r.scd_valid_to or dt.datetime.max, r.weight_kg, r.scd_is_current, r.scd_hash)
                  for r in df.collect())


def test_replay_equals_applying_one_run_after_the_other(spark):
    rng = random.Random(3)
    rows = [(f"r{k}", k % 2, s, float(rng.choice([10, 20, 30])), n) for k in range(12) for s in range(2) for n in range(10) if n != 4 and rng.random() < 0.7]
    snaps = staged(spark, rows)
    runs = []
    for n in range(10):
        at = T0 + dt.timedelta(days=n)
        when = F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz")
        runs.append((snaps.where(F.col("run_ts") == when).drop("run_ts"), when))
    want = scd2.apply_runs(runs, checkpoint_every=2)
    assert versions(scd2.replay(snaps)) == versions(want)
    assert scd2.replay(snaps.where("false")).count() == 0


def test_replay_has_one_shuffle_by_business_key(spark):
    snaps = staged(spark, [("r", 0, 0, 1.0, n) for n in range(4)])
    plan = scd2.replay(snaps)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(routine_id") == 1


def test_as_of_latest_over_a_thousand_versions(spark):
    """One routine with 1,000 versions and very many probes, others with few;
    no step makes more rows than there are events."""
    rng = random.Random(5)
    day = dt.timedelta(days=1)
    v = [("hot", T0 + n * day, T0 + (n + 1) * day if n < 999 and n % 10 else (None if n == 999 else T0 + n * day + day / 2), n) for n in range(1000)]
    v += [("few", T0 + 3 * day, T0 + 400 * day, 5000), (None, T0, None, 6000), ("none", None, None, 7000)]
    p = [(i, "hot", T0 + dt.timedelta(hours=rng.randrange(-100, 30_000))) for i in range(3000)]
    p += [(9000, "few", T0 + 900 * day), (9001, "few", T0 + 399 * day), (9002, "few", T0), (9003, None, T0), (9004, "few", None), (9005, "other", T0)]
    p += [(9006, "hot", T0 + 5 * day), p[0]]
    vs = spark.createDataFrame(v, "k string, scd_valid_from timestamp_ntz, scd_valid_to timestamp_ntz, no int")
    ps = spark.createDataFrame(p, "i int, k string, at timestamp_ntz")
    found = scd2.as_of_latest(vs, ps, "at", ["k"])
    got = sorted((r.i, r.version.no if r.version else -1) for r in found.collect())

    def brute(k, at):
        for own, a, b, n in v:
            if k is not None and own == k and at is not None and a is not None and a <= at and (b is None or at < b):
                return n
        return -1

    assert got == sorted((i, brute(k, at)) for i, k, at in p)
    assert scd2.as_of_latest(vs, ps.where("false"), "at", ["k"]).count() == 0
    assert scd2.as_of_latest(vs.where("false"), ps, "at", ["k"]).where("version IS NOT NULL").count() == 0
    text = found._jdf.queryExecution().optimizedPlan().toString()
    assert "scd_valid_from" not in text.split("Join", 1)[1].split("\n", 1)[0]  # no interval in a join


def test_keys_of_few_probes_are_not_carried_over_blocks(spark):
    """Events go through one shuffle by their key; those of a key with very many
    probes go in blocks, with the same versions found."""
    rng = random.Random(7)
    at = lambda days: T0 + dt.timedelta(days=days)
    v = [(k, e, at(10 * n), at(10 * n + rng.choice([5, 10])) if n < 30 else None, n) for k in ("hot", "few") for e in (0, 1) for n in range(31)]
    p = [(i, rng.choice(["hot"] * 9 + ["few", "none", None]), rng.choice([0, 1, None]), at(rng.randrange(-20, 500)) if i % 50 else None) for i in range(600)]
    vs = spark.createDataFrame(v, "k string, e int, scd_valid_from timestamp_ntz, scd_valid_to timestamp_ntz, no int")
    ps = spark.createDataFrame(p, "i int, k string, e int, at timestamp_ntz")
    want = sorted((i, next((n for own, f, a, b, n in v if (own, f) == (k, e) and t and a <= t and (b is None or t < b)), -1)) for i, k, e, t in p)
    for most in (0, 100, 10**6):
        found = scd2.as_of_latest(vs, ps, "at", ["k", "e"], most=most)
        assert found.columns == ["i", "k", "e", "at", "version"] and found.schema["version"].dataType == vs.schema
        rows = found.collect()
        assert sorted((r.i, r.version.no if r.version else -1) for r in rows) == want
        assert all((r.version.k, r.version.e) == (r.k, r.e) for r in rows if r.version)
    text = found._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"RepartitionByExpression \[k#\d+, e#\d+\], 8", text)) == 1 and "_block" in text


@pytest.fixture(scope="module")
def pipeline(spark):
    with inputs.looked(spark, SF_SMALL):
        yield Pipeline(spark, SF_SMALL)


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_set_grain_layers_meet_without_an_exchange(spark, pipeline):
    """Sets, exercises and workouts lie in the same buckets of the workout id."""
    old = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert exchanges(pipeline.actual) == 0
        assert exchanges(pipeline.headers) == 0
        assert exchanges(pipeline.cycle_keys) == 0
        assert exchanges(fact.matched_sets(pipeline.actual, pipeline.scd_table)) == 2
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old[0])
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old[1])


def test_headers_of_the_workouts_equal_those_of_the_sets(pipeline):
    assert sorted(pipeline.headers.collect()) == sorted(fact.workout_headers(pipeline.actual).collect())


def test_one_routines_exercise_lies_together_from_the_match_to_the_coach(spark, pipeline):
    """Fact and gold are stored by (routine, template): gold shuffles no fact row,
    the coach no gold row, and the dimension is applied where plans lie."""
    from liftlake.operators import coach, plan
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        pipeline.gold_table, pipeline.scd_table  # written first
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        text = lambda df: df._jdf.queryExecution().executedPlan().toString()
        assert text(pipeline.fact).count("hashpartitioning(routine_id") == 2  # sets and plan rows
        wide = [line for line in text(pipeline.gold).splitlines() if "Exchange hash" in line and "actual_weight_kg" in line]
        assert not wide
        whole = pipeline.gold_table
        assert exchanges(coach.last_cycle_sets(whole)) == 0
        assert exchanges(pipeline.replies) == 1  # a routine's recommendations
        assert exchanges(plan.target_sets_legacy(pipeline.bronze.routine_details, pipeline.recommendations)) == 1
        assert "hashpartitioning(c_routine_id" not in text(pipeline.scd) and "hashpartitioning(s_routine_id" not in text(pipeline.scd)
    finally:
        for k, x in old.items():
            spark.conf.set(k, x)


def test_rows_without_a_template_keep_their_routine_in_gold(spark):
    from liftlake.operators import gold
    fact_rows = [("w1", "r1", "t1"), ("w2", "r1", None), ("w3", None, "t1"), ("w4", None, None), ("w5", "r2", "t2"), ("w5", "r1", "t1")]
    cols = {"cycle_number": "int", "exercise_index": "int", "set_index": "int", "set_type": "string", "weight_kg": "double", "reps": "int", "rpe": "double",
            "planned_weight_kg": "double", "planned_reps": "int", "planned_rest": "int", "execution_status": "string", "diff_weight_kg": "double", "diff_reps": "int"}
    f = spark.createDataFrame(fact_rows, "workout_id string, routine_id string, exercise_template_id string").withColumns({c: F.lit(None).cast(t) for c, t in cols.items()})
    e = spark.createDataFrame([("t1", "Squat", "m", 2.5)], "exercise_template_id string, exercise_name string, primary_muscle_group string, progression_step_kg double")
    r = spark.createDataFrame([("r1", "Push")], "routine_id string, routine_name string")
    d = spark.createDataFrame([("r1", "t1", 3, 1), ("r1", "t1", 2, None)], "routine_id string, exercise_template_id string, exercise_index int, superset_id int")
    got = sorted((x.routine_id or "", x.exercise_template_id or "", x.routine_name, x.exercise_name, x.exercise_index, x.superset_id) for x in gold.gold_prompt(f, e, r, d).collect())
    assert got == [("", "", None, None, None, None), ("", "t1", None, "Squat", None, None), ("r1", "", "Push", None, None, None),
                   ("r1", "t1", "Push", "Squat", 2, 1), ("r1", "t1", "Push", "Squat", 2, 1), ("r2", "t2", None, None, None, None)]

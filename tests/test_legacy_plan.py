"""The legacy plan assembly against hand-made routines."""

import json

from pyspark.sql import functions as F

from liftlake.operators import legacy_plan

FLAT = ("routine_id string, title string, exercise_index int, exercise_template_id string, supersets_id int, rest_seconds int, exercise_notes string, "
        "set_index int, set_type string, weight_kg double, reps int, distance_meters double, duration_seconds double")
RECS = "routine_id string, exercise_template_id string, weight_kg double, reps int, rpe_target double, reasoning string"


def plans(spark, flat, recs):
    df = spark.createDataFrame(flat, FLAT)
    return df, legacy_plan.exercise_plans(df, spark.createDataFrame(recs, RECS))


def test_ladder_working_sets_notes_and_copies(spark):
    flat = [
        ("r", "R", 0, "squat", None, 180, "deep", 0, "warmup", 40.0, 5, None, None), ("r", "R", 0, "squat", None, 180, "deep", 1, "normal", 90.0, 5, None, None),
        ("r", "R", 0, "squat", None, 180, "deep", 2, "normal", 90.0, 5, None, None),
        ("r", "R", 1, "row", 3, 60, None, 1, "normal", None, None, 500.0, 120.5), ("r", "R", 1, "row", 3, 60, None, 0, None, 5.0, 1, None, None),
        ("r", "R", 2, "dip", None, None, "slow", None, None, None, None, None, None), ("r", "R", 3, "curl", None, 30, "", None, None, None, None, None, None),
        # The same exercise twice in one routine; a routine of the same exercises without recommendations.
        ("r", "R", 4, "squat", None, 90, None, 0, "normal", 50.0, 10, None, None), ("q", "Q", 0, "squat", None, 90, "old", 0, "normal", 50.0, 10, None, None),
        ("e", "E", None, None, None, None, None, None, None, None, None, None, None), (None, "N", 0, "squat", None, 1, "n", 0, "normal", 1.0, 1, None, None),
    ]
    recs = [("r", "squat", 100.0, 4, 8.5, "go"), ("r", "dip", 0.0, 12, 0.0, "body"), ("x", "row", 1.0, 1, 1.0, "other")]
    df, p = plans(spark, flat, recs)
    got = {(r.routine_id, r.order_index): r for r in p.collect()}
    assert set(got) == {("r", i) for i in range(5)} | {("q", 0)}
    brief = lambda k: [(s.type, s.weight_kg, s.reps) for s in got[k].sets]
    ladder = [("warmup", 20.0, 15), ("warmup", 40.0, 8), ("warmup", 60.0, 4), ("warmup", 80.0, 2), ("warmup", 90.0, 1)]
    assert brief(("r", 0)) == ladder + [("normal", 100.0, 4)] * 2
    assert brief(("r", 4)) == ladder + [("normal", 100.0, 4)]
    assert brief(("r", 2)) == [("normal", 0.0, 12)] * 3
    assert brief(("r", 1)) == [(None, 5.0, 1), ("normal", None, None)] and brief(("r", 3)) == []
    assert (got["r", 1].sets[1].distance_meters, got["r", 1].sets[1].duration_seconds) == (500.0, 120.5)
    assert brief(("q", 0)) == [("normal", 50.0, 10)]
    assert [got["r", i].notes for i in range(5)] == ["[AI: go RPE 8.5] deep", "", "[AI: body] slow", "", "[AI: go RPE 8.5] "]
    assert got["q", 0].notes == "old" and got["r", 0].rest_seconds == 180 and got["r", 2].rest_seconds is None

    day = F.lit("2024-05-06").cast("timestamp_ntz")
    out = {r.routine_id: json.loads(r.payload_json)["routine"] for r in legacy_plan.payloads(df, p, day).collect()}
    assert set(out) == {"r", "q", "e"} and out["e"] == {"title": "E", "notes": "AI Plan: 2024-05-06", "exercises": []}
    assert [e["exercise_template_id"] for e in out["r"]["exercises"]] == ["squat", "row", "dip", "curl", "squat"]
    assert out["r"]["exercises"][1] == {
        "exercise_template_id": "row", "superset_id": 3, "rest_seconds": 60, "notes": "", "sets": [
            {"type": None, "weight_kg": 5.0, "reps": 1, "distance_meters": None, "duration_seconds": None},
            {"type": "normal", "weight_kg": None, "reps": None, "distance_meters": 500.0, "duration_seconds": 120.5}]}


def test_empty_tables(spark):
    df, p = plans(spark, [], [])
    assert p.count() == 0 and legacy_plan.set_rows(p).count() == 0
    assert legacy_plan.payloads(df, p, F.current_timestamp()).count() == 0


def test_a_routine_is_shuffled_once_to_its_recommendations(spark):
    flat = spark.createDataFrame(
        [("r", "R", 0, "t", None, 90, "old", 0, "normal", 40.0, 5), ("r", "R", 0, "t", None, 90, "old", 1, "normal", 42.5, 5), ("r", "R", 1, "u", 1, None, None, 0, "warmup", None, 8),
         ("r", "R", 2, "t", None, 60, None, None, None, None, None), ("q", "Q", 0, None, None, None, None, 0, "normal", 20.0, 3), ("s", "S", None, None, None, None, None, None, None, None, None)],
        "routine_id string, title string, exercise_index int, exercise_template_id string, supersets_id int, rest_seconds int, exercise_notes string, set_index int, "
        "set_type string, weight_kg double, reps int").withColumns({c: F.lit(None).cast("double") for c in ("distance_meters", "duration_seconds")})
    recs = spark.createDataFrame(
        [("r", "t", 30.0, 6, 8.0, "why"), ("q", "t", 10.0, 1, 0.0, "no"), ("q", None, 10.0, 1, 0.0, "no")],
        "routine_id string, exercise_template_id string, weight_kg double, reps int, rpe_target double, reasoning string").repartition(8, "routine_id")
    plans = legacy_plan.exercise_plans(flat, recs)
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        text = legacy_plan.exercise_plans(flat, recs)._jdf.queryExecution().executedPlan().toString()
        assert text.count("Exchange hashpartitioning(routine_id") == text.count("Exchange ") == 2
    finally:
        for k, x in old.items():
            spark.conf.set(k, x)
    got = sorted((p.routine_id, p.order_index, p.notes, [(s.type, s.weight_kg, s.reps) for s in p.sets]) for p in plans.collect())
    work = lambda n: [("normal", 30.0, 6)] * n
    assert got == [("q", 0, "", [("normal", 20.0, 3)]), ("r", 0, "[AI: why RPE 8.0] old", work(2)), ("r", 1, "", [("warmup", None, 8)]), ("r", 2, "[AI: why RPE 8.0] ", work(3))]

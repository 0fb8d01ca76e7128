"""Sinks (skip-if-empty, upsert, snapshots) and coach-reply validation."""

import json

import pytest
from pyspark.sql import functions as F

from liftlake.operators import plan
from liftlake.sources import sinks
from tests.conftest import rows


def test_write_skip_if_empty_keeps_old_table(spark):
    path = sinks.scratch_path(spark, "t-skip")
    full = spark.createDataFrame([(1, "a")], "id int, v string")
    assert sinks.write(full, path, skip_if_empty=True)
    assert not sinks.write(full.filter("id < 0"), path, skip_if_empty=True)
    assert rows(spark.read.parquet(path)) == [{"id": 1, "v": "a"}]


def test_upsert_replaces_by_key(spark):
    target = spark.createDataFrame([("1", "old", 1), ("2", "keep", 2)], "id string, title string, n int")
    updates = spark.createDataFrame([("1", "new", 9), ("3", "added", 3)], "id string, title string, n int")
    got = {r["id"]: (r["title"], r["n"]) for r in rows(sinks.upsert(target, updates, ["id"]))}
    assert got == {"1": ("new", 9), "2": ("keep", 2), "3": ("added", 3)}


def test_snapshot_never_overwrites(spark):
    base = sinks.scratch_path(spark, "t-snap")
    df = spark.createDataFrame([(1,)], "x int")
    p1 = sinks.write_snapshot(df, base, "run-1")
    with pytest.raises(Exception):
        sinks.write_snapshot(df, base, "run-1")
    assert p1.endswith("run-1")


def _reply(**overrides):
    rec = {"weight_kg": 60.0, "reps": 8, "rpe_target": 8.0, "strategy": "LINEAR_LOAD", "rest_seconds": 120,
           "reasoning": "ok"}
    rec.update(overrides)
    return rec


def test_recommendation_replies_rejected_whole(spark):
    replies = [
        ("r1", json.dumps({"recommendations": {"a": _reply(), "b": _reply(reps="9")}})),
        ("r2", json.dumps({"recommendations": {"a": _reply(), "b": {k: v for k, v in _reply().items()
                                                                    if k != "reasoning"}}})),
        ("r3", json.dumps({"recommendations": {"a": _reply(reps=8.5)}})),
        ("r4", "not json"),
        ("r5", json.dumps({"recommendations": {}})),
    ]
    df = spark.createDataFrame(replies, "routine_id string, response string")
    ok = rows(plan.parse_recommendations(df))
    assert sorted((r["routine_id"], r["exercise_template_id"], r["reps"]) for r in ok) == [("r1", "a", 8),
                                                                                          ("r1", "b", 9)]
    bad = {r["routine_id"] for r in rows(plan.rejected_recommendations(df))}
    assert bad == {"r2", "r3", "r4"}


def test_payload_validity(spark):
    df = spark.createDataFrame([(1,)], "x int")
    good = F.struct(F.struct(F.lit("T").alias("title"), F.array(F.struct(
        F.lit("t1").alias("exercise_template_id"),
        F.array(F.struct(F.lit("normal").alias("type"),
                         F.struct(F.lit(6).alias("start"), F.lit(10).alias("end")).alias("rep_range"))).alias("sets")))
        .alias("exercises")).alias("routine"))
    bad = F.struct(F.struct(F.lit("T").alias("title"), F.array(F.struct(
        F.lit("t1").alias("exercise_template_id"),
        F.array(F.struct(F.lit(None).cast("string").alias("type"),
                         F.struct(F.lit(6).alias("start"), F.lit(10).alias("end")).alias("rep_range"))).alias("sets")))
        .alias("exercises")).alias("routine"))
    r = df.select(plan.is_valid_payload(good).alias("g"), plan.is_valid_payload(bad).alias("b")).first()
    assert r["g"] is True and r["b"] is False

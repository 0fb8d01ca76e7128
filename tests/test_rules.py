"""Hand tables with exact expected output, one rule at a time."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from liftlake.functions import status as st
from liftlake.functions.calendar import PHASES, cycle_week, with_phase, year_week
from liftlake.functions.metrics import e1rm, round_to_step
from liftlake.operators import coach, flatten, plan, ranking, scd2, validate
from tests.conftest import rows

STATUS_CASES = [
    # actual, plan, w, r, d, m, pw, pr, pd, pm, pdist, expected
    (False, True, None, None, None, None, 50.0, 5, None, None, None, st.SKIPPED),
    (True, False, 50.0, 5, None, None, None, None, None, None, None, st.UNPLANNED),
    (True, True, 55.0, 6, None, None, 50.0, 5, None, None, None, st.HEAVIER_MORE_REPS),
    (True, True, 55.0, 4, None, None, 50.0, 5, None, None, None, st.HEAVIER_FEWER_REPS),
    (True, True, 55.0, 5, None, None, 50.0, 5, None, None, None, st.HEAVIER),
    (True, True, 45.0, 6, None, None, 50.0, 5, None, None, None, st.LIGHTER_MORE_REPS),
    (True, True, 45.0, 4, None, None, 50.0, 5, None, None, None, st.LIGHTER),
    (True, True, 50.0, 6, None, None, 50.0, 5, None, None, None, st.MORE_REPS),
    (True, True, 50.0, 4, None, None, 50.0, 5, None, None, None, st.FEWER_REPS),
    (True, True, None, None, 90.0, None, None, None, 60.0, None, None, st.LONGER),
    (True, True, None, None, 30.0, None, None, None, 60.0, None, None, st.SHORTER),
    (True, True, None, None, None, 4.0, None, None, None, 3.0, None, st.HIGHER_METRIC),
    (True, True, None, None, None, 2.0, None, None, None, 3.0, None, st.LOWER_METRIC),
    (True, True, None, 5, None, None, 0.0, 5, None, None, None, st.BODYWEIGHT_MET),
    (True, True, None, 5, None, None, 0.0, 5, None, None, 100.0, st.TARGET_MET),
    (True, True, 50.0, 5, None, None, 50.0, 5, None, None, None, st.TARGET_MET),
    # nulls count as 0: no weight vs a planned 0 kg is not lighter
    (True, True, None, 5, None, None, None, 5, None, None, None, st.BODYWEIGHT_MET),
]


def test_execution_status_all_branches(spark):
    schema = ("a boolean, p boolean, weight_kg double, reps int, duration_seconds double, custom_metric double, "
              "planned_weight_kg double, planned_reps int, planned_duration_seconds double, "
              "planned_custom_metric double, planned_distance_meters double, expected string")
    df = spark.createDataFrame(STATUS_CASES, schema)
    c = st.execution_status(F.col("a"), F.col("p"), F.col("weight_kg"), F.col("reps"), F.col("duration_seconds"),
                            F.col("custom_metric"), F.col("planned_weight_kg"), F.col("planned_reps"),
                            F.col("planned_duration_seconds"), F.col("planned_custom_metric"),
                            F.col("planned_distance_meters"))
    out = rows(df.select("expected", c.alias("col_form"), F.expr(st.execution_status_sql("a", "p")).alias("sql_form")))
    for r in out:
        assert r["col_form"] == r["expected"] and r["sql_form"] == r["expected"], r
    assert {r["expected"] for r in out} == set(st.ALL_STATUSES)


def _staged(spark, rows_, ts_text=None):
    schema = "routine_id string, exercise_index int, set_index int, weight_kg double"
    d = spark.createDataFrame(rows_, schema)
    for c in scd2.STAGED_COLS:
        if c not in d.columns:
            d = d.withColumn(c, F.lit(None).cast("string"))
    d = d.select(*scd2.STAGED_COLS)
    return d.withColumn("scd_hash", __import__("liftlake.functions.hashing", fromlist=["row_hash"]).row_hash(
        scd2.STAGED_COLS))


def _ts(s):
    return F.lit(s).cast("timestamp_ntz")


def test_scd2_classes_reappear_and_noop(spark):
    run1 = _staged(spark, [("r1", 0, 0, 50.0), ("r1", 0, 1, 50.0), ("r2", 0, 0, 40.0)])
    run2 = _staged(spark, [("r1", 0, 0, 52.5), ("r1", 0, 1, 50.0), ("r3", 0, 0, 30.0)])
    run3 = _staged(spark, [("r1", 0, 0, 52.5), ("r1", 0, 1, 50.0), ("r3", 0, 0, 30.0), ("r2", 0, 0, 40.0)])
    s1 = scd2.apply(None, run1, _ts("2024-01-01 00:00:00"))
    classes = {(r["routine_id"], r["change_class"]) for r in rows(scd2.diff(run2, scd2.current(s1)))}
    assert classes == {("r1", "changed"), ("r1", "unchanged"), ("r2", "deleted"), ("r3", "new")}
    s2 = scd2.apply(s1, run2, _ts("2024-02-01 00:00:00"))
    s3 = scd2.apply(s2, run3, _ts("2024-03-01 00:00:00"))
    r2 = sorted(rows(s3.filter("routine_id = 'r2'")), key=lambda r: r["scd_valid_from"])
    assert [x["scd_is_current"] for x in r2] == [False, True]  # deleted, then reappears as new
    assert r2[0]["scd_valid_to"] == dt.datetime(2024, 2, 1)
    # an identical re-run changes nothing
    s4 = scd2.apply(s3, run3, _ts("2024-04-01 00:00:00"))
    assert sorted(map(str, rows(s4.drop("scd_hash")))) == sorted(map(str, rows(s3.drop("scd_hash"))))
    # properties: one current row per key, disjoint half-open intervals
    per_key = {}
    for r in rows(s4):
        per_key.setdefault((r["routine_id"], r["exercise_index"], r["set_index"]), []).append(r)
    for versions in per_key.values():
        assert sum(v["scd_is_current"] for v in versions) <= 1
        vs = sorted(versions, key=lambda v: v["scd_valid_from"])
        for a, b in zip(vs, vs[1:]):
            assert a["scd_valid_to"] is not None and a["scd_valid_to"] <= b["scd_valid_from"]


def test_scd2_partial_snapshot_keeps_vanished_keys(spark):
    run1 = _staged(spark, [("r1", 0, 0, 50.0), ("r2", 0, 0, 40.0)])
    run2 = _staged(spark, [("r1", 0, 0, 50.0)])
    s = scd2.apply(scd2.apply(None, run1, _ts("2024-01-01 00:00:00")), run2, _ts("2024-02-01 00:00:00"),
                   complete_snapshot=False)
    assert {r["routine_id"] for r in rows(scd2.current(s))} == {"r1", "r2"}


def test_scd2_empty_extract_changes_nothing(spark):
    run1 = _staged(spark, [("r1", 0, 0, 50.0), ("r2", 0, 0, 40.0)])
    s = scd2.apply(None, run1, _ts("2024-01-01 00:00:00"))
    again = scd2.apply(s, run1.where("false"), _ts("2024-02-01 00:00:00"))
    assert sorted(map(str, rows(again))) == sorted(map(str, rows(s)))


def test_scd2_staging_needs_headers_and_details(spark):
    headers = spark.createDataFrame([("r1", "t", "f", None, None)], ", ".join(f"{c} string" for c in scd2.HEADER_COLS))
    other = [c for c in scd2.STAGED_COLS if c not in scd2.HEADER_COLS]
    data = [("r1", *["1" if c.endswith("_index") else None for c in other]), ("r1", *[None] * len(other)), (None, *["2"] * len(other))]
    details = spark.createDataFrame(data, ", ".join(f"{c} string" for c in ["routine_id", *other]))
    assert scd2.stage(headers, details).count() == 1
    assert scd2.stage(headers.where("false"), details).count() == 0
    assert scd2.stage(headers, details.where("false")).count() == 0
    assert scd2.quarantined_keys(headers, details).count() == 2


def test_as_of_half_open_boundaries(spark):
    run1 = _staged(spark, [("r1", 0, 0, 50.0)])
    run2 = _staged(spark, [("r1", 0, 0, 55.0)])
    s = scd2.apply(scd2.apply(None, run1, _ts("2024-01-01 00:00:00")), run2, _ts("2024-02-01 00:00:00"))
    probes = spark.createDataFrame([("w0", "r1", "2023-12-31 23:59:59"), ("w1", "r1", "2024-01-01 00:00:00"),
                                    ("w2", "r1", "2024-02-01 00:00:00")], "wid string, routine_id string, t string")
    probes = probes.withColumn("t", F.col("t").cast("timestamp_ntz"))
    got = {r["wid"]: r["weight_kg"] for r in rows(scd2.as_of(s, probes, "t", ["routine_id"]).select("p.wid", "s.weight_kg"))}
    assert got == {"w1": 50.0, "w2": 55.0}


def _py_warmup(target):
    def step(v):
        return round(v / 2.5) * 2.5
    if not target or target < 20:
        return []
    if target < 40:
        cands = [(target * 0.5, 10)]
    elif target < 80:
        cands = [(20, 12), (target * 0.6, 6), (target * 0.8, 2)]
    else:
        cands = [(20, 15), (target * 0.4, 8), (target * 0.6, 4), (target * 0.8, 2), (target * 0.9, 1)]
    out, seen = [], set()
    for w, r in cands:
        w = step(w)
        if 20 <= w < target and w not in seen:
            out.append((float(w), r))
            seen.add(w)
    return sorted(out)


@pytest.mark.parametrize("target", [0.0, 19.9, 20.0, 39.9, 40.0, 52.5, 79.9, 80.0, 100.0, 142.5, 61.25])
def test_warmup_ladder_thresholds(spark, target):
    df = spark.createDataFrame([(target,)], "t double")
    got = [(x["weight_kg"], x["reps"]) for x in df.select(plan.warmup_ladder(F.col("t")).alias("w")).first()["w"]]
    assert got == _py_warmup(target)


@pytest.mark.parametrize("target,expected", [(0.0, []), (-5.0, []), (6.0, []), (8.0, [(5.0, 10)]), (10.0, [(5.0, 10)]),
                                             (52.5, [(25.0, 10)]), (41.0, [(20.0, 10)])])
def test_warmup_single(spark, target, expected):
    df = spark.createDataFrame([(target,)], "t double")
    got = [(x["weight_kg"], x["reps"]) for x in df.select(plan.warmup_single(F.col("t")).alias("w")).first()["w"]]
    assert got == expected


def test_round_to_step_matches_python(spark):
    vals = [i * 0.01 for i in range(0, 20001, 7)]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    got = [r[0] for r in df.select(round_to_step(F.col("v"))).collect()]
    assert got == [round(v / 2.5) * 2.5 for v in vals]


def _py_stall(hist):
    if len(hist) < 2:
        return dict(stall_streak=0, e1rm_current=0.0, e1rm_trend_percent=0.0, avg_rpe_last_3=0.0,
                    status="NEW", recommended_action="LINEAR_LOAD")
    ps = []
    for w, r, rpe in hist:
        if w is None or r is None:
            continue
        e = w if r == 1 else w * (1 + r / 30.0)
        ps.append((e, rpe if rpe else None))
    if not ps:
        return dict(stall_streak=None, e1rm_current=None, e1rm_trend_percent=None, avg_rpe_last_3=None,
                    status="ERROR", recommended_action="MAINTAIN")
    rpes = [p[1] for p in ps[:3] if p[1] is not None]
    avg = sum(rpes) / len(rpes) if rpes else 0.0
    cur, past = ps[0][0], ps[min(len(ps) - 1, 3)][0]
    trend = (cur - past) / past * 100 if past > 0 else 0
    streak = 0
    for a, b in zip(ps, ps[1:]):
        if a[0] <= b[0] * 1.01 and (a[1] or 0) >= 8.5:
            streak += 1
        else:
            break
    if trend < -5:
        s = ("REGRESSION", "RESET")
    elif streak >= 2 and avg >= 9:
        s = ("GRINDING", "DELOAD")
    elif streak >= 2 and avg < 7:
        s = ("SANDBAGGING", "PUSH_HARDER")
    elif streak >= 3:
        s = ("STAGNATION", "CHANGE_REP_RANGE")
    elif trend > 5:
        s = ("FAST_GAINS", "AGGRESSIVE_LOAD")
    else:
        s = ("PROGRESS", "LINEAR_LOAD")
    return dict(stall_streak=streak, e1rm_current=round(cur, 1), e1rm_trend_percent=round(trend, 1),
                avg_rpe_last_3=round(avg, 1), status=s[0], recommended_action=s[1])


def test_stall_analysis_against_rules(spark):
    rnd = random.Random(7)
    cases = {
        "new": [(100.0, 5, 8.0)],
        "err": [(None, 5, 8.0), (100.0, None, 9.0)],
        "grind": [(100.0, 5, 9.5), (100.0, 5, 9.0), (100.0, 5, 9.5), (99.0, 5, 9.0)],
        "sandbag": [(100.0, 5, 9.0), (100.0, 5, 8.5), (100.0, 5, None), (100.0, 5, 0.0)],
        "stagnation": [(100.0, 5, 8.5), (100.0, 5, 8.5), (100.0, 5, 8.6), (100.0, 5, 8.5), (100.0, 5, 8.0)],
        "regress": [(80.0, 5, 7.0), (90.0, 5, 7.0), (100.0, 5, 7.0)],
        "fast": [(120.0, 5, 7.0), (100.0, 5, 7.0)],
        "single": [(100.0, 1, 7.0), (95.0, 1, 7.0)],
        "skip_mid": [(100.0, 5, 9.0), (None, 5, 9.0), (100.0, 5, 9.0)],
    }
    for i in range(30):
        n = rnd.randint(0, 5)
        cases[f"rnd{i}"] = [(rnd.choice([None, 60.0, 80.0, 100.0, 102.5]), rnd.choice([None, 1, 5, 8]),
                             rnd.choice([None, 0.0, 6.5, 8.5, 9.0, 10.0])) for _ in range(n)]
    data = [(k, i + 1, w, r, rpe) for k, h in cases.items() for i, (w, r, rpe) in enumerate(h)]
    hist = spark.createDataFrame(data, "exercise_template_id string, session_no int, weight double, reps int, rpe double")
    got = {r["exercise_template_id"]: r for r in rows(coach.stall_analysis(hist))}
    for k, h in cases.items():
        if not h:
            continue
        exp = _py_stall(h)
        for f, v in exp.items():
            assert got[k][f] == v, (k, f, got[k][f], v)


@pytest.mark.parametrize("day,week,label", [
    ("2024-01-01", 1, "2024-W01"), ("2024-01-22", 4, "2024-W04"), ("2024-01-29", 5, "2024-W05"),
    ("2024-12-23", 52, "2024-W52"), ("2024-12-30", 1, "2024-W01"), ("2020-12-31", 53, "2020-W53"),
    ("2021-01-03", 53, "2021-W53")])
def test_phase_and_iso_week(spark, day, week, label):
    df = spark.createDataFrame([(day,)], "d string").withColumn("d", F.to_date("d"))
    r = with_phase(df.withColumn("yw", year_week(F.col("d"))), "d").first()
    assert r["yw"] == label
    assert r["phase_week"] == ((week - 1) % 4) + 1
    assert r["phase_name"] == PHASES[r["phase_week"] - 1][1]
    assert df.select(cycle_week(F.col("d"))).first()[0] == ((week - 1) % 4) + 1


def test_e1rm_single_rep(spark):
    df = spark.createDataFrame([(100.0, 1), (100.0, 3)], "w double, r int")
    coach_form = [x[0] for x in df.select(e1rm(F.col("w"), F.col("r"))).collect()]
    dash_form = [x[0] for x in df.select(e1rm(F.col("w"), F.col("r"), single_rep_exact=False)).collect()]
    assert coach_form == [100.0, 100.0 * (1 + 3 / 30.0)] and dash_form[0] == pytest.approx(100 * (1 + 1 / 30.0))


WORKOUT_OK = {"id": "w1", "title": "t", "exercises": [
    {"index": 0, "title": "e", "exercise_template_id": "x", "sets": [{"index": 0, "type": "normal", "reps": 5}]}]}


def _variant(path_value):
    d = json.loads(json.dumps(WORKOUT_OK))
    path_value(d)
    return json.dumps(d)


@pytest.mark.parametrize("name,doc,valid", [
    ("ok", json.dumps(WORKOUT_OK), True),
    ("extra field ignored", _variant(lambda d: d.update(unknown=1)), True),
    ("int as text", _variant(lambda d: d["exercises"][0]["sets"][0].update(reps="5")), True),
    ("int as 5.0", _variant(lambda d: d["exercises"][0]["sets"][0].update(reps=5.0)), True),
    ("fractional int", _variant(lambda d: d["exercises"][0]["sets"][0].update(reps=5.5)), False),
    ("missing set index", _variant(lambda d: d["exercises"][0]["sets"][0].pop("index")), False),
    ("missing set type", _variant(lambda d: d["exercises"][0]["sets"][0].pop("type")), False),
    ("null exercises", _variant(lambda d: d.update(exercises=None)), False),
    ("missing exercises", _variant(lambda d: d.pop("exercises")), True),
    ("null sets", _variant(lambda d: d["exercises"][0].update(sets=None)), False),
    ("missing sets", _variant(lambda d: d["exercises"][0].pop("sets")), True),
    ("missing title", _variant(lambda d: d.pop("title")), False),
    ("bad weight", _variant(lambda d: d["exercises"][0]["sets"][0].update(weight_kg="heavy")), False),
    ("sets is text", _variant(lambda d: d["exercises"][0].update(sets="abc")), False),
    ("sets is an object", _variant(lambda d: d["exercises"][0].update(sets={"index": 0})), False),
    ("sets is a number", _variant(lambda d: d["exercises"][0].update(sets=5)), False),
    ("a set is a number", _variant(lambda d: d["exercises"][0].update(sets=[5])), False),
    ("a later set is text", _variant(lambda d: d["exercises"][0]["sets"].append("x")), False),
    ("a later set is a number", _variant(lambda d: d["exercises"][0]["sets"].append(7)), False),
    ("rep_range is a number", _variant(lambda d: d["exercises"][0]["sets"][0].update(rep_range=5)), False),
    ("null rep_range", _variant(lambda d: d["exercises"][0]["sets"][0].update(rep_range=None)), True),
    ("unknown field with null sets", _variant(lambda d: d.update(meta={"sets": None})), True),
    ("number as title", _variant(lambda d: d.update(title=5)), False),
    ("number as id", _variant(lambda d: d.update(id=5)), True),
    ("number as notes", _variant(lambda d: d["exercises"][0].update(notes=5)), False),
    ("number as set type", _variant(lambda d: d["exercises"][0]["sets"][0].update(type=5)), False),
    ("not an object", "[1, 2]", False),
    ("not json", "{oops", False),
])
def test_workout_validation_cases(spark, name, doc, valid):
    items = spark.createDataFrame([(1, doc)], "page int, item string")
    ok, bad = validate.validate_workouts(items)
    assert (ok.count(), bad.count()) == ((1, 0) if valid else (0, 1)), name


def test_outer_flatten_keeps_empty_levels(spark):
    docs = [json.dumps({"id": "a", "title": "t", "exercises": []}),
            json.dumps({"id": "b", "title": "t", "exercises": [{"index": 0, "title": "e",
                                                              "exercise_template_id": "x", "sets": []}]}),
            json.dumps(WORKOUT_OK)]
    items = spark.createDataFrame([(1, d) for d in docs], "page int, item string")
    valid, _ = validate.validate_workouts(items)
    ts = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    outer = flatten.flat_workouts_outer(valid, ts)
    inner = flatten.flat_exercise_sets(valid, ts)
    assert outer.count() == 3 and inner.count() == 1
    assert flatten.bronze_workout_exercises(valid, ts).count() == 2


def test_payload_drops_nulls(spark):
    df = spark.createDataFrame([("r",)], "t string")
    p = F.struct(F.struct(F.lit("T").alias("title"), F.lit(None).cast("string").alias("notes")).alias("routine"))
    assert df.select(F.to_json(p)).first()[0] == '{"routine":{"title":"T"}}'


def _random_keys(spark, n=3000, seed=3):
    rnd = random.Random(seed)
    data = []
    for i in range(n):
        g = "hot" if rnd.random() < 0.34 else f"g{rnd.randint(0, 40)}"
        t = None if rnd.random() < 0.01 else dt.datetime(2020, 1, 1) + dt.timedelta(hours=rnd.randint(0, 24 * 900))
        data.append((g, t, i))
    return spark.createDataFrame(data, "g string, t timestamp_ntz, v long")


def test_distributed_dense_rank_matches_window(spark):
    df = _random_keys(spark)
    want = df.select("g", "t", F.dense_rank().over(Window.partitionBy("g").orderBy(F.col("t").asc_nulls_first()))
                     .alias("r"))
    got = ranking.with_dense_rank(df, ["g"], "t", "r").select("g", "t", "r")
    assert sorted(map(str, rows(got))) == sorted(map(str, rows(want)))


def test_lag_by_position_matches_lag(spark):
    base = _random_keys(spark).groupBy("g", F.to_date("t").alias("d")).agg(F.sum("v").alias("v"))
    base = base.filter(F.col("d").isNotNull())
    want = base.select("g", "d", "v", F.lag("v").over(Window.partitionBy("g").orderBy("d")).alias("prev_v"))
    got = ranking.lag_by_position(base, ["g"], "d", ["v"]).select("g", "d", "v", "prev_v")
    assert sorted(map(str, rows(got))) == sorted(map(str, rows(want)))


def test_coach_context_without_history_and_its_indented_text(spark):
    from liftlake.operators import prompts
    exercises = spark.createDataFrame(
        [("r", 0, "a", 'Bench "x"', 0.0), ("r", 1, "b", "Squat", 5.0), ("r", 2, "c", "Row", None)],
        "routine_id string, order_index int, exercise_template_id string, title string, base_increment double")
    analytics = spark.createDataFrame(
        [("a", 1, 100.0, 2.5, 8.5, "STALLED", "DELOAD"), ("b", None, None, None, None, "ERROR", "MAINTAIN")],
        "exercise_template_id string, stall_streak int, e1rm_current double, e1rm_trend_percent double, "
        "avg_rpe_last_3 double, status string, recommended_action string")
    history = spark.createDataFrame(
        [("a", 1, dt.datetime(2024, 1, 2), 50.0, 5, 8.0), ("a", 2, dt.datetime(2024, 1, 1), 47.5, 5, None)],
        "exercise_template_id string, session_no int, date timestamp_ntz, weight double, reps int, rpe double")
    got = rows(prompts.coach_context(exercises, analytics, history).orderBy("order_index"))
    contexts = [json.loads(r["context_json"]) for r in got]
    assert "[\n" + ",\n".join(r["context_text"] for r in got) + "\n]" == json.dumps(contexts, indent=2)
    assert contexts[0]["history_summary"][0]["rpe"] == 8.0 and contexts[0]["history_summary"][1]["rpe"] is None
    assert contexts[1]["analytics"] == {"status": "ERROR", "recommended_action": "MAINTAIN"}
    assert contexts[2]["analytics"] == {"stall_streak": 0, "e1rm_current": 0.0, "e1rm_trend_percent": 0.0, "avg_rpe_last_3": 0.0,
                                        "status": "NEW", "recommended_action": "LINEAR_LOAD"}
    assert contexts[2]["base_increment"] == 2.5 and contexts[2]["history_summary"] == []


def test_primary_keys_of_all_keyed_tables_are_checked(spark, monkeypatch):
    from liftlake.operators import normalized as nm
    from liftlake.plans.normalized_queries import q_check_primary_keys
    from tests.conftest import SF_SMALL

    def twice(fn):
        return lambda *args: (lambda df: df.unionByName(df.limit(2)).unionByName(df.limit(1).withColumn(df.columns[0] if "id" not in df.columns else "id", F.lit(None))))(fn(*args))

    for name in ("norm_folders", "norm_routine_exercises", "norm_workout_exercises", "norm_progression"):
        monkeypatch.setattr(nm, name, twice(getattr(nm, name)))
    got = {(r.table_name, r.problem) for r in q_check_primary_keys(spark, SF_SMALL).collect()}
    tables = {"silver_routine_folders", "silver_routine_exercises", "silver_workout_exercises", "silver_exercise_progression"}
    assert {(t, p) for t in tables for p in ("duplicate key", "null key")} <= got

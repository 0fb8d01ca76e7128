"""What a step shuffles, writes and evaluates, told from its plan, with the
results that must not depend on it."""

import glob
import json

import pytest
from pyspark.sql import functions as F

from liftlake.operators import fact
from liftlake.operators import normalized as nm
from liftlake.operators import validate as va
from liftlake.sources import catalog, landing
from liftlake.sources import page_files as pf
from liftlake.sources.sinks import scratch_path


def plan(df, mode="simple"):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


def exchanges(df):
    return [line for line in plan(df).splitlines() if "Exchange hashpartitioning" in line]


ORDERS = "o_orderkey long, o_custkey long, o_orderdate timestamp, o_orderpriority string"
LINES = ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, l_shipdate timestamp, "
         "l_discount double, l_tax double, l_returnflag string")


@pytest.fixture(scope="module")
def log(spark):
    """Orders and lines with nulls, repeats, an order without lines and lines without an order."""
    import datetime as dt
    day = dt.datetime(1995, 3, 4)
    d = scratch_path(spark, "t-growth")
    orders = [(1, 8, day, "HIGH"), (1, 9, day, "LOW"), (2, None, day, None), (12, 11, None, "x"), (None, 3, day, "n"), (40, 4, day, "y"), (40, 4, day, "y")]
    lines = [(k, p, s, n, 10.0 * n, day, 0.05 * (n % 3), 0.02, "R" if n % 4 == 0 else "N")
             for k, p, s, n in [(1, 4, 3, 1), (1, 8, 17, 2), (1, 5, 19, 3), (1, 4, 3, 4), (2, None, 5, 1), (2, 6, 5, 2), (40, 7, 34, 1), (99, 3, 2, 1), (None, 1, 1, 1)]]
    spark.createDataFrame(orders, ORDERS).write.parquet(f"{d}/orders.parquet")
    spark.createDataFrame(lines, LINES).write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame([(i, "name") for i in range(6)], "p_partkey long, p_name string").write.parquet(f"{d}/part.parquet")
    return d


def test_workout_pages_meet_in_one_shuffle(spark, log):
    pages = landing.landed_workout_pages(spark, log)
    main = plan(pages).split("===== Subqueries")[0].split("Subqueries:")[0]
    assert main.count("Exchange hashpartitioning") == 1
    got = {r.page: json.loads(r.body) for r in pages.collect() if r.body}
    assert sorted(got) == [1, 2, 5] and all(b["page_count"] == 5 for b in got.values())
    shape = lambda w: [(e["index"], e["exercise_template_id"], [(s["index"], s["reps"]) for s in e["sets"]]) for e in w["exercises"]]
    first, second, third = got[1]["workouts"]
    both = [(0, "0", [(0, 6), (1, None), (2, 9)]), (0, "2", [(0, 6), (1, None), (2, 9)]), (1, "1", [(0, None)]), (1, "3", [(0, None)])]
    for w in (first, second):  # an order that stands there twice
        assert sorted(shape(w)) == both and w["id"] == "1"
    assert shape(third) == [(None, None, []), (2, None, [(0, 7)])]
    assert got[2]["workouts"][0]["exercises"] == [] and got[2]["workouts"][0]["start_time"] is None
    assert [shape(w) for w in got[5]["workouts"]] == [[(3, "1", [(0, None)])] * 2] * 2


def test_tasks_that_nest_workouts_grow_with_the_rows(spark, log, monkeypatch):
    few = landing.landed_workout_pages(spark, log)
    assert ", 8), REPARTITION_BY_NUM" in plan(few)
    monkeypatch.setattr(landing, "ROWS_A_TASK", 1)
    many = landing.landed_workout_pages(spark, log)
    assert ", 14), REPARTITION_BY_NUM" in plan(many)  # 6 orders and 8 lines with a key
    assert sorted(map(str, many.collect())) == sorted(map(str, few.collect()))


def test_landed_lines_and_layers_are_compressed(spark):
    d = scratch_path(spark, "t-lz4")
    body = '{"page":1,"page_count":1,"workouts":[' + ",".join('{"id":"a","title":"x"}' for _ in range(500)) + "]}"
    landing.write_pages(spark.createDataFrame([(1, body)], "page long, body string"), d)
    files = [f for f in glob.glob(f"{d.removeprefix('file://')}/part-*") if open(f, "rb").read()]
    assert all(f.endswith(".txt.lz4") and len(open(f, "rb").read()) < len(body) / 10 for f in files) and files
    assert pf.read_pages(spark, d, "workouts").select("n_items").collect()[0][0] == 500
    assert catalog.COMPRESSION == "zstd"


def test_page_texts_are_not_shuffled_to_find_repeated_ones(spark, monkeypatch):
    rows = [('{"page":%d,"page_count":4,"events":["%s"]}' % (n, t), f) for n, t, f in [(1, "a", "x"), (1, "b", "y"), (2, "c", "x"), (4, "d", "x")]]
    d = scratch_path(spark, "t-repeated")
    text = spark.createDataFrame(rows, "value string, file string").withColumn("landed_at", F.lit("2020-01-01").cast("timestamp"))
    pf.with_problems(text, "events").write.parquet(d)
    pages = spark.read.parquet(d)
    want = [(1, "b"), (2, "c"), (4, "d")]
    items = pf.page_items(pages)
    assert "LeftAnti" in plan(items) and "SortMergeJoin" not in plan(items)
    assert sorted(map(tuple, items.collect())) == want
    few = sorted(map(tuple, pf.page_report(pages, "events").drop("file").fillna(-1).collect()))
    monkeypatch.setattr(pf, "HANDED_OUT", 0)
    monkeypatch.setattr(pf.F, "broadcast", None)
    assert sorted(map(tuple, pf.page_items(pages).collect())) == want
    assert sorted(map(tuple, pf.page_report(pages, "events").drop("file").fillna(-1).collect())) == few


def doc(**own):
    s = {"index": 0, "type": "normal", "weight_kg": 40.5, "reps": 5, "rep_range": None}
    e = {"index": 0, "title": "E", "exercise_template_id": "t", "sets": [s | own.pop("set", {})]}
    return {"id": "w", "title": "W", "exercises": [e | own.pop("ex", {})]} | own


BAD = "invalid exercise or set"
CASES = [
    (doc(), None, True), (doc(set={"rep_range": {"start": 1, "end": 2.5}}), None, True), (doc(exercises=[]), None, True), (doc(new={"x": 1}), None, True),
    (doc(set={"reps": "5"}), None, False), (doc(set={"reps": 5.0}), None, False), (doc(set={"reps": 5.5}), BAD, False), (doc(set={"type": None}), BAD, False),
    (doc(set={"type": 3}), BAD, False), (doc(set={"index": None}), BAD, False), (doc(set={"rep_range": 4}), BAD, False), (doc(set={"weight_kg": "x"}), BAD, False),
    (doc(ex={"sets": None}), BAD, False), (doc(ex={"sets": {"a": 1}}), BAD, False), (doc(ex={"sets": ["x"]}), BAD, False), (doc(ex={"sets": [None]}), BAD, False),
    (doc(ex={"title": 5}), BAD, False), (doc(ex={"title": None}), BAD, False), (doc(exercises=None), "exercises is not a list", False),
    (doc(exercises=[None]), BAD, False), (doc(title=None), "missing title", False), (doc(id=7), None, False), (doc(title=7), BAD, False),
]


@pytest.mark.parametrize("entity", ["workouts", "routines"])
def test_clean_documents_are_parsed_once_and_the_others_judged_by_the_rules(spark, entity):
    cases = [c for c in CASES if not (entity == "routines" and c[0].get("id") == 7)]
    texts = [json.dumps(d) for d, _, _ in cases] + ["[1]", "x", json.dumps(doc())[:-4]]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, item string")
    valid, rejects = va.validate(df, entity)
    found = {r.n: None for r in valid.collect()} | {r.n: r.reason for r in rejects.collect()}
    assert [found[i] for i in range(len(cases))] == [reason for _, reason, _ in cases]
    assert [found[i] for i in range(len(cases), len(texts))][:2] == ["not a JSON object"] * 2 and found[len(texts) - 1] is not None
    quick = {r.n: r._clean for r in va._with_quick_parse(df, va.WORKOUT_HEAD if entity == "workouts" else va.ROUTINE_HEAD).collect()}
    assert [quick[i] for i in range(len(cases))] == [clean for _, _, clean in cases]
    whole = [r for r in valid.orderBy("n").collect() if r.n in (1, 4)]
    sets = [r.exercises[0].sets[0] for r in whole]
    assert (sets[0].rep_range.start, sets[0].rep_range.end, sets[0].weight_kg, sets[1].reps) == (1.0, 2.5, 40.5, 5)


def test_cycles_come_to_the_sets_before_the_match(spark):
    rows = [("a", "t", "1995-01-02"), ("a", "u", "1995-01-02"), ("b", "t", "1995-01-01"), ("b", "t", "1995-03-01"), ("c", None, "1995-01-05"), ("c", "t", None)]
    actual = spark.createDataFrame([(w, t, s, i) for w, t, s in rows for i in range(2)], "workout_id string, exercise_template_id string, start_time string, set_index int")
    actual = actual.withColumn("start_time", F.col("start_time").cast("timestamp_ntz")).withColumn("routine_id", F.lit("r"))
    keys = actual.select("workout_id", "exercise_template_id", "routine_id", "start_time")
    got = fact.with_cycles(actual, keys)
    want = fact._with_cycle(actual, False, keys)
    assert got.count() == actual.count()
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))


def test_rows_that_break_no_rule_are_not_grouped(spark):
    df = spark.createDataFrame([("a", "x"), (None, "y")], "id string, title string")
    text = plan(nm.constraint_report(df, "t", ["id"], ["id"], unique=False), "extended").split("Physical Plan")[1]
    assert "Filter" in text.split("Exchange", 1)[1]


def test_routine_views_and_documents_hand_no_table_out_whole(spark, log):
    spark.createDataFrame([(1, 5, "A"), (2, None, "B"), (29, 3, None)], "c_custkey long, c_nationkey int, c_mktsegment string").write.parquet(f"{log}/customer.parquet")
    docs = landing.routine_documents(spark, log)
    assert "Broadcast" not in plan(docs) and sorted(r.key for r in docs.collect()) == [1, 2, 29]
    flat = spark.createDataFrame(
        [("r", "R", 0, "t", None, 90, "n", 0, "normal", 40.0), ("r", "R", 0, "t", None, 90, "n", 1, None, None), ("q", "Q", None, None, None, None, None, None, None, None)],
        "routine_id string, title string, exercise_index int, exercise_template_id string, supersets_id int, rest_seconds int, exercise_notes string, set_index int, "
        "set_type string, weight_kg double")
    flat = flat.withColumns({c: F.lit(None).cast("double") for c in ("reps", "rep_range_start", "rep_range_end", "distance_meters", "duration_seconds", "rpe")})
    templates = nm.norm_templates(
        spark.createDataFrame([("t", "T", "k", "m", True)], "id string, title string, type string, primary_muscle_group string, is_custom boolean"),
        spark.createDataFrame([("T", 5.0)], "exercise_title string, base_increment double"))
    history = spark.createDataFrame([("t", [(1, "1995-01-02", 40.0, 5, None)])], "exercise_template_id string, sessions array<struct<session_no:int,date:string,weight:double,reps:int,rpe:double>>")
    view = nm.routine_view(flat, nm.norm_routine_exercises(flat), templates, history)
    assert "Broadcast" not in plan(view)
    got = sorted((r.routine_id, r.title, r.base_increment, r.set_type, r.history) for r in view.fillna("").collect())
    assert got == [("q", "", None, "", ""), ("r", "T", 5.0, "", "1995-01-02|40.0|5|"), ("r", "T", 5.0, "normal", "1995-01-02|40.0|5|")]

import json

import pytest

from liftlake.operators import normalized as nm
from liftlake.operators import validate as va


def test_every_rule_of_the_constraint_report(spark):
    df = spark.createDataFrame([("a", "x"), ("a", None), ("b", None), (None, "y"), (None, "z"), ("c", "t")], "id string, title string")
    got = sorted(map(tuple, nm.constraint_report(df, "t", ["id"], ["title"]).collect()))
    assert got == sorted([
        ("t", "a", "duplicate key", 2), ("t", "a", "null title", 1), ("t", "b", "null title", 1), ("t", "<null>", "duplicate key", 2),
        ("t", "<null>", "null key", 2),
    ])
    assert sorted(map(tuple, nm.constraint_report(df, "t", ["id"], ["id"], unique=False).collect())) == [("t", "<null>", "null id", 2)]
    assert nm.constraint_report(df.where("false"), "t", ["id"], ["title"]).count() == 0


def test_each_foreign_key_reports_its_orphans(spark):
    child = spark.createDataFrame([(1, "p1", "q1"), (2, "p2", "q9"), (3, "p9", None), (4, "p9", "q1"), (5, None, "p1")], "id long, p string, q string")
    other = spark.createDataFrame([(1,), (7,), (7,), (None,)], "c long")
    ps, qs = (spark.createDataFrame([(x,) for x in v], "id string") for v in (["p1", "p2", "p2", None], ["q1"]))
    got = nm.fk_violations(
        [(child, {"child.p": "p", "child.q": "q"}), (other, {"other.c": "c"})],
        [(ps, "id", ["child.p"]), (qs, "id", ["child.q"]), (child, "id", ["other.c"])])
    assert sorted(map(tuple, got.collect())) == [("child.p", "p9", 2), ("child.q", "p1", 1), ("child.q", "q9", 1), ("other.c", "7", 2)]


def verdicts(spark, entity, docs):
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "n int, item string")
    valid, rejects = va.validate(df, entity)
    out = {r.n: None for r in valid.collect()} | {r.n: r.reason for r in rejects.collect()}
    return [out[i] for i in range(len(docs))]


@pytest.mark.parametrize("entity, good, bad", [
    ("exercise_templates",
     [{"id": "a", "title": "x"}, {"id": 5, "title": "x", "type": None, "secondary_muscle_groups": ["m"], "new": 1}],
     [{"id": "a", "title": 5}, {"id": "a", "title": "x", "secondary_muscle_groups": [1]}, {"id": "a", "title": "x", "type": 3},
      {"id": "a", "title": "x", "primary_muscle_group": True}, {"id": ["a"], "title": "x"}, {"id": "a", "title": {"de": "x"}}]),
    ("routine_folders",
     [{"id": "a", "index": 1, "title": "x"}, {"id": 3, "index": "1", "title": "x", "updated_at": None}],
     [{"id": "a", "index": 1, "title": 5}, {"id": "a", "index": 1, "title": "x", "updated_at": 7}]),
    ("events",
     [{"type": "other"}, {"type": "deleted", "id": "w", "deleted_at": "2024-01-01T00:00:00Z"}, {"type": "deleted", "id": 4}],
     [{"type": 5}, {"type": ["updated"]}, {"type": "deleted", "id": "w", "deleted_at": 5}]),
])
def test_values_of_another_kind_are_rejected(spark, entity, good, bad):
    got = verdicts(spark, entity, good + bad)
    assert got == [None] * len(good) + [va.WRONG_KIND] * len(bad)

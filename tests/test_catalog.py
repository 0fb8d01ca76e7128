import os
import time

import pytest

from liftlake.sources import fixtures as fx
from liftlake.sources import inputs
from liftlake.sources.catalog import Catalog
from liftlake.sources.sinks import scratch_path


def test_a_layer_is_built_once_for_a_key_and_old_versions_go(spark):
    base, built = scratch_path(spark, "t-catalog"), []
    catalog = Catalog(spark, base)

    def build(n):
        return lambda: built.append(n) or spark.range(n)

    assert catalog.table("t", "k1", build(3)).count() == 3
    assert catalog.table("t", "k1", build(9)).count() == 3
    assert Catalog(spark, base).table("t", "k1", build(9)).count() == 3
    assert built == [3]
    first = catalog.manifest("t")["path"]
    second = catalog.table("t", "k2", build(5))
    assert second.count() == 5 and catalog.manifest("t")["before"] == [first]
    assert spark.read.parquet(first).count() == 3  # the version before stays for those who read it
    catalog.table("t", "k3", build(6))
    assert not os.path.exists(first.removeprefix("file:")) and second.count() == 5
    assert built == [3, 5, 6]


def test_a_failed_build_leaves_the_current_version(spark):
    catalog = Catalog(spark, scratch_path(spark, "t-catalog"))
    catalog.table("t", "k1", lambda: spark.range(3))
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        catalog.table("t", "k2", lambda: spark.range(3).selectExpr("1 / id AS x"))
    assert catalog.manifest("t")["key"] == "k1"
    assert catalog.table("t", "k1", lambda: spark.range(9)).count() == 3


def test_another_session_reads_the_layer_by_its_manifest(spark):
    base = scratch_path(spark, "t-catalog")
    Catalog(spark, base).table("t", "k1", lambda: spark.range(4))
    other = spark.newSession()
    got = Catalog(other, base).table("t", "k1", lambda: pytest.fail("built again"))
    assert got.count() == 4 and got.sparkSession is other


def test_changed_input_gives_new_rows_in_one_session(spark):
    import __spark_entry__ as entry

    d = scratch_path(spark, "t-input").removeprefix("file:")
    for t in ("customer", "nation", "orders", "lineitem", "part", "events"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").coalesce(1).write.parquet(f"{d}/{t}.parquet")
    queries = entry.queries()
    counts = lambda: (fx.bronze(spark, d).workout_sets.count(), queries["scan_workout_pages"](spark, d).count())
    before = counts()
    assert fx.read_table(spark, d, "orders") is fx.read_table(spark, d, "orders")
    state = inputs.look(spark, d)
    time.sleep(0.01)
    for t, key in (("orders", "o_orderkey"), ("lineitem", "l_orderkey")):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").where(f"{key} % 2 = 0").coalesce(1).write.mode("overwrite").parquet(f"{d}/{t}.parquet")
    changed = inputs.look(spark, d)
    assert {t for t in state if state[t] != changed[t]} == {"orders", "lineitem"}
    after = counts()
    want = spark.read.parquet(f"{d}/lineitem.parquet").count(), spark.read.parquet(f"{d}/orders.parquet").count()
    assert after == want and after < before


def test_layers_of_untouched_tables_stay(spark):
    key = inputs.state_key(spark, "/root/testdata/sf0.001", ("part",))
    assert key == inputs.state_key(spark, "/root/testdata/sf0.001/", ("part",))
    assert key != inputs.state_key(spark, "/root/testdata/sf0.001", ("part", "orders"))
    assert key != inputs.state_key(spark, "/root/testdata/sf0.01", ("part",))

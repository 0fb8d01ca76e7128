"""Session helpers.

Library functions never create or reconfigure a session; they take the one
they are given. ``local_session`` is for tests, the bench and ad-hoc runs.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings that matter for every job in this package, whatever the cluster:
# AQE re-plans joins from real shuffle sizes (runtime broadcast of a side that
# turned out small, skew-join splitting of hot partitions, partition
# coalescing), and all timestamps are UTC.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Runtime broadcast limit: AQE only applies it to a join side whose
    # materialised size it has measured, so the bound is proven, not guessed.
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64MB",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "liftlake") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LIFTLAKE_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Whole-stage code for wide joins and long CASE chains yields large
        # methods; let the JIT compile them instead of interpreting them.
        .config("spark.driver.extraJavaOptions", "-XX:-DontCompileHugeMethods")
        # Constraint propagation re-derives filters across every join of the
        # large silver plans and dominates their optimisation time.
        .config("spark.sql.constraintPropagation.enabled", "false")
    )
    for k, v in RECOMMENDED_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``. Where it is unset, a local
    session gets a fresh scratch folder (tests); a cluster must name one, as
    its executors do not share a folder that the driver makes up."""
    sc = spark.sparkContext
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if conf:
        if not current:
            sc.setCheckpointDir(conf)
        return conf
    if current:
        return current
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="liftlake-ckpt-")
    sc.setCheckpointDir(path)
    return path


def by_shuffle(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that grows with the data. Spark sizes a side by
    its files and columns, which compressed layers and generated rows undercut
    by far, and would hand it out whole through the driver."""
    return df.hint("merge")


def same(left: Column, right: Column) -> Column:
    """Equality as a condition within the rows that a join's keys bring together.
    Spark spreads both sides of a join by all of its keys; rows that lie by some
    of them already stay where they are if the others are compared like this,
    which it does not take for a key."""
    return (left <= right) & (left >= right)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table of their own in the shared folder: later
    reads prune columns and push filters, and a lost executor costs a re-read."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/liftlake-tables/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def cut_lineage(df: DataFrame, force: bool = False) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder named by the
    session (survives executor loss, unlike a local checkpoint). Without a
    configured folder the frame is returned unchanged unless ``force``; then
    a scratch folder is set, which only happens where the session names none
    (local runs and tests)."""
    spark = df.sparkSession
    sc = spark.sparkContext
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf and not sc.getCheckpointDir() and not force:
        return df
    ensure_checkpoint_dir(spark)
    # Writing a reliable checkpoint runs a second job over the plan; with the
    # rows persisted for the duration, that job reads them instead of
    # recomputing the plan. The persisted copy is dropped once written.
    df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return df.checkpoint(eager=True)
    finally:
        df.unpersist()

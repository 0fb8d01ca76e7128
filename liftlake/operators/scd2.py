"""Type-2 slowly changing dimension of the planned routines.

Without a table format there is no MERGE: a run reads the current snapshot,
computes the next full state as a union of (history, expired, kept,
inserted) rows and writes it to a *new* path (``sources.sinks.write_snapshot``),
so a failed run never leaves a half-updated table and no path is read and
overwritten by the same job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from liftlake.functions.hashing import row_hash
from liftlake.session import by_shuffle, same

BUSINESS_KEYS = ["routine_id", "exercise_index", "set_index"]
HEADER_COLS = ["routine_id", "title", "folder_id", "updated_at", "created_at"]
STAGED_COLS = [
    "routine_id", "title", "folder_id", "updated_at", "created_at",
    "exercise_index", "exercise_title", "exercise_notes", "rest_seconds",
    "exercise_template_id", "superset_id", "set_index", "set_type", "weight_kg", "reps",
    "rep_range_start", "rep_range_end", "distance_meters", "duration_seconds", "rpe", "custom_metric",
]
SCD_COLS = ["scd_valid_from", "scd_valid_to", "scd_is_current", "scd_hash"]
ALL_COLS = STAGED_COLS + SCD_COLS

NEW, CHANGED, DELETED, UNCHANGED = "new", "changed", "deleted", "unchanged"


def _int(c: str) -> Column:
    return F.col(c).cast("string").try_cast("int")


def stage(headers: DataFrame, details: DataFrame) -> DataFrame:
    """E1 + E2 + E3: details LEFT JOIN headers, ingestion columns dropped,
    legacy ``supersets_id`` renamed, ids as text, indexes coerced to int
    (unparseable -> null), then the row fingerprint over every staged
    column. Rows with a null business key cannot be versioned; they go to
    ``quarantined_keys``. An extract without headers or without details
    stages nothing."""
    if "supersets_id" in details.columns and "superset_id" not in details.columns:
        details = details.withColumnRenamed("supersets_id", "superset_id")
    d = details.drop(*[c for c in details.columns if "ingestion_timestamp" in c])
    d = (d.withColumn("routine_id", F.col("routine_id").cast("string"))
         .withColumn("exercise_index", _int("exercise_index"))
         .withColumn("set_index", _int("set_index"))
         .withColumn("superset_id", _int("superset_id")))
    h = headers.select(*HEADER_COLS).withColumn("routine_id", F.col("routine_id").cast("string"))
    staged = d.join(by_shuffle(h), "routine_id", "left").select(*STAGED_COLS)
    staged = staged.filter(_keys_present() & _any_row(headers))
    return staged.withColumn("scd_hash", row_hash(STAGED_COLS))


def _any_row(df: DataFrame) -> Column:
    """Whether a frame has a row, as a scalar subquery."""
    return df.select(F.lit(1).alias("one")).limit(1).agg(F.count("one") > 0).scalar()


def _keys_present(keys: list[str] = BUSINESS_KEYS) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return cond


def quarantined_keys(headers: DataFrame, details: DataFrame) -> DataFrame:
    """Staged rows whose business key is incomplete."""
    d = details.withColumn("exercise_index", _int("exercise_index")).withColumn("set_index", _int("set_index"))
    return d.filter(~_keys_present()).withColumn("reason", F.lit("null business key"))


def initial_load(staged: DataFrame, run_ts: Column) -> DataFrame:
    """Every staged row becomes current from ``run_ts``."""
    return staged.select(*STAGED_COLS, run_ts.alias("scd_valid_from"),
                         F.lit(None).cast("timestamp_ntz").alias("scd_valid_to"),
                         F.lit(True).alias("scd_is_current"), "scd_hash")


def current(scd: DataFrame) -> DataFrame:
    """E10."""
    return scd.filter(F.col("scd_is_current"))


def diff(staged: DataFrame, current_rows: DataFrame, keys: list[str] = BUSINESS_KEYS) -> DataFrame:
    """E5: FULL OUTER on the business key -> one row per key with its class."""
    s = staged.select(*keys, F.col("scd_hash").alias("_s_hash"), F.lit(True).alias("_s"))
    c = current_rows.select(*[F.col(k).alias(f"_c_{k}") for k in keys],
                            F.col("scd_hash").alias("_c_hash"), F.lit(True).alias("_c"))
    cond = None
    for k in keys:
        e = F.col(k).eqNullSafe(F.col(f"_c_{k}"))
        cond = e if cond is None else cond & e
    j = s.join(c, cond, "full_outer")
    cls = (F.when(F.col("_c").isNull(), F.lit(NEW))
           .when(F.col("_s").isNull(), F.lit(DELETED))
           .when(F.col("_s_hash") != F.col("_c_hash"), F.lit(CHANGED))
           .otherwise(F.lit(UNCHANGED)))
    return j.select(*[F.coalesce(F.col(k), F.col(f"_c_{k}")).alias(k) for k in keys], cls.alias("change_class"))


def diff_stats(d: DataFrame) -> DataFrame:
    """Row count per change class."""
    return d.groupBy("change_class").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


def apply(target: DataFrame | None, staged: DataFrame, run_ts: Column,
          keys: list[str] = BUSINESS_KEYS, complete_snapshot: bool = True) -> DataFrame:
    """E7 + E8: the full next state of the dimension.

    history (already closed) + current rows (closed at ``run_ts`` when their
    key changed, or vanished from a complete snapshot) + inserts (new and
    changed keys). A key that reappears after deletion is new. With
    ``complete_snapshot=False`` (a partial extract) vanished keys stay open.
    An empty extract changes nothing: a failed fetch must not close the
    dimension.

    One FULL OUTER join of the current rows with the staged rows on the
    business key; each joined row emits up to two output rows (the current
    version, possibly closed, and the insert) through a generator, so each
    input is read once and no second join is needed.
    """
    if target is None:
        return initial_load(staged, run_ts)
    history = target.filter(~F.col("scd_is_current")).select(*ALL_COLS)
    cur = current(target).select(*[F.col(c).alias(f"c_{c}") for c in ALL_COLS])
    stg = staged.select(*[F.col(c).alias(f"s_{c}") for c in STAGED_COLS + ["scd_hash"]])
    # Both sides lie by the routine, the first key; its plan has few rows.
    cond = F.col(f"c_{keys[0]}") == F.col(f"s_{keys[0]}")
    for k in keys[1:]:
        cond = cond & same(F.col(f"c_{k}"), F.col(f"s_{k}"))
    j = cur.join(by_shuffle(stg), cond, "full_outer")
    has_c = F.col("c_scd_hash").isNotNull()
    has_s = F.col("s_scd_hash").isNotNull()
    changed = has_c & has_s & (F.col("c_scd_hash") != F.col("s_scd_hash"))
    expire = changed | (has_c & ~has_s & _any_row(staged)) if complete_snapshot else changed
    kept = F.struct(*[F.col(f"c_{c}").alias(c) for c in STAGED_COLS], F.col("c_scd_valid_from").alias("scd_valid_from"),
                    F.when(expire, run_ts).otherwise(F.col("c_scd_valid_to")).alias("scd_valid_to"),
                    F.when(expire, F.lit(False)).otherwise(F.col("c_scd_is_current")).alias("scd_is_current"),
                    F.col("c_scd_hash").alias("scd_hash"))
    inserted = F.struct(*[F.col(f"s_{c}").alias(c) for c in STAGED_COLS], run_ts.alias("scd_valid_from"),
                        F.lit(None).cast("timestamp_ntz").alias("scd_valid_to"), F.lit(True).alias("scd_is_current"),
                        F.col("s_scd_hash").alias("scd_hash"))
    rows = F.array(F.when(has_c, kept), F.when(has_s & (~has_c | changed), inserted))
    nxt = j.select(F.explode(rows).alias("r")).filter(F.col("r").isNotNull()).select("r.*")
    return history.unionByName(nxt)


def as_of(scd: DataFrame, probes: DataFrame, ts_col: str, on: list[str]) -> DataFrame:
    """Probe rows joined to the versions valid at their time stamp,
    half-open [valid_from, valid_to). Equi-join on ``on`` with the range as a
    residual predicate, so it is a plain shuffled (or runtime-broadcast)
    join, never a cross product."""
    p = probes.alias("p")
    s = scd.alias("s")
    cond = None
    for k in on:
        e = F.col(f"p.{k}") == F.col(f"s.{k}")
        cond = e if cond is None else cond & e
    cond = cond & (F.col(f"p.{ts_col}") >= F.col("s.scd_valid_from")) & (
        (F.col(f"p.{ts_col}") < F.col("s.scd_valid_to")) | F.col("s.scd_valid_to").isNull())
    return p.join(s, cond, "inner")


# Probes of a key that one task goes through.
PROBES_A_KEY = 100_000


def as_of_latest(versions: DataFrame, probes: DataFrame, ts_col: str, on: list[str], block_days: int = 30, most: int = PROBES_A_KEY) -> DataFrame:
    """E9 for long histories: every probe row with the one version of its key
    that is valid at its time stamp, as struct ``version`` (null: none).

    An equi-join with the interval as residual predicate meets every version of
    a key before it drops all but one. Here versions and probes are one stream
    of events, and the newest version is carried forward in time by a window over
    the key: one shuffle, and no more rows than there are events. Keys with more
    than ``most`` probes, counted by a number made from the key, go in blocks
    instead (see ``_in_blocks``). The versions of a key must not overlap; a probe
    without a complete key or time stamp has no version."""
    known = None
    for k in on:
        e = F.col(k).isNotNull()
        known = e if known is None else known & e
    kind = {k: versions.schema[k].dataType for k in on}
    own_p, own_v = ([c for c in df.columns if c not in on] for df in (probes, versions))
    nothing = lambda df, own: F.lit(None).cast(df.select(F.struct(*own)).schema[0].dataType)
    number = F.xxhash64(*on)
    v = versions.where(known & F.col("scd_valid_from").isNotNull()).select(
        *on, F.col("scd_valid_from").alias("_t"), F.lit(0).alias("_kind"), nothing(probes, own_p).alias("_p"), F.struct(*own_v).alias("_v"))
    found = known & F.col(ts_col).isNotNull()
    p = probes.where(found).select(
        *on, F.col(ts_col).cast("timestamp_ntz").alias("_t"), F.lit(1).alias("_kind"), F.struct(*own_p).alias("_p"), nothing(versions, own_v).alias("_v"))
    # At most a row for every ``most`` probes, so all tasks get them.
    hot = F.broadcast(p.select(number.alias("_key")).groupBy("_key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("_key"))
    events = v.unionByName(p)
    n = int(probes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_key = events.join(hot, number == F.col("_key"), "left_anti").repartition(n, *on)
    carried = Window.partitionBy(*on).orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = by_key.withColumn("_newest", F.last("_v", ignorenulls=True).over(carried)).where("_kind = 1").select(*on, "_t", "_p", "_newest")
    seen = seen.unionByName(_in_blocks(events.join(hot, number == F.col("_key"), "left_semi"), on, block_days))
    newest = F.col("_newest")
    version = F.struct(*[(F.col(c).cast(kind[c]) if c in on else newest[c]).alias(c) for c in versions.columns])
    open_at = newest.isNotNull() & (newest["scd_valid_to"].isNull() | (F.col("_t") < newest["scd_valid_to"]))
    back = [(F.col(c).cast(probes.schema[c].dataType) if c in on else F.col("_p")[c]).alias(c) for c in probes.columns]
    rest = probes.where(~F.coalesce(found, F.lit(False))).select(*probes.columns, F.lit(None).cast(versions.schema).alias("version"))
    return seen.select(*back, F.when(open_at, version).alias("version")).unionByName(rest)


def _in_blocks(events: DataFrame, on: list[str], block_days: int) -> DataFrame:
    """Probes among ``events`` with the newest version of their key before them,
    for keys with very many: these are spread over blocks of ``block_days``. The
    newest version is carried forward inside a block by a window over (key,
    block), and into a block from the last version of the blocks before it, a row
    for each (key, block) that has events."""
    seconds = lambda c: F.unix_seconds(F.to_timestamp_ltz(c.cast("string")))
    block = F.floor(seconds(F.col("_t")) / F.lit(block_days * 86400)).alias("_block")
    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    events = events.withColumn("_block", block).repartition(n, *on, "_block")
    inside = Window.partitionBy(*on, "_block").orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = events.withColumn("_own", F.last("_v", ignorenulls=True).over(inside)).where("_kind = 1")
    before = Window.partitionBy(*on).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    # max_by skips no nulls of its own: only versions count, probes order as null.
    last = events.groupBy(*on, "_block").agg(F.max_by("_v", F.when(F.col("_kind") == 0, F.col("_t"))).alias("_last"))
    carried = last.withColumn("_carried", F.last("_last", ignorenulls=True).over(before)).select(*on, "_block", "_carried")
    return seen.join(carried, [*on, "_block"], "left").select(*on, "_t", "_p", F.coalesce("_own", "_carried").alias("_newest"))


def replay(snapshots: DataFrame, keys: list[str] = BUSINESS_KEYS, run_col: str = "run_ts") -> DataFrame:
    """E7 + E8 over many runs in one pass: the dimension after all complete
    snapshots in ``snapshots`` (staged rows with the time of their run), equal to
    applying them one after the other.

    A version is an island: a stretch of neighbouring runs in which a key has
    the same fingerprint. It begins with its first run and ends with the run
    after its last one, where the key changed or is gone. Runs that staged no
    row are no runs here, as an empty extract changes nothing. One shuffle by
    business key, whatever the number of runs; a key has at most one row a run."""
    order = Window.orderBy(run_col)
    # One row a run: a small table.
    runs = snapshots.select(run_col).distinct().select(
        F.col(run_col).alias("_run_ts"), F.row_number().over(order).alias("_run"), F.lead(run_col).over(order).alias("_next_ts"))
    rows = snapshots.join(F.broadcast(runs), F.col(run_col) == F.col("_run_ts"))
    by_key = Window.partitionBy(*keys).orderBy("_run")
    same = (F.lag("_run").over(by_key) == F.col("_run") - 1) & (F.lag("scd_hash").over(by_key) == F.col("scd_hash"))
    island = F.sum((~F.coalesce(same, F.lit(False))).cast("int")).over(by_key)
    others = [c for c in STAGED_COLS if c not in keys]
    first = F.struct(*others, "scd_hash", F.col("_run_ts").alias("scd_valid_from"))
    versions = rows.withColumn("_island", island).groupBy(*keys, "_island").agg(
        F.min_by(first, "_run").alias("_first"), F.max_by("_next_ts", "_run").alias("scd_valid_to"))
    out = versions.select(*keys, "_first.*", "scd_valid_to", F.col("scd_valid_to").isNull().alias("scd_is_current"))
    return out.select(*ALL_COLS)


def apply_runs(snapshots: list[tuple[DataFrame, Column]], keys: list[str] = BUSINESS_KEYS,
               checkpoint_every: int = 4) -> DataFrame:
    """Replay several snapshot runs in order (staged frame, run time). Every
    ``checkpoint_every`` runs the state is checkpointed into the session's
    shared checkpoint folder, so lineage stays bounded and a lost executor
    never forces a replay from the first run."""
    from liftlake.session import cut_lineage
    state = None
    for i, (staged, ts) in enumerate(snapshots, start=1):
        state = apply(state, staged, ts, keys)
        if i % checkpoint_every == 0:
            state = cut_lineage(state)
    return state

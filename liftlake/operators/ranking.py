"""Ranks and lags over groups that may be huge.

``Window.partitionBy(k).orderBy(o)`` sends each whole group to one task.
Cycle numbers are ranked per exercise template, and a popular template can
hold a third of all sets, so a plain window would serialise that share of
the data. ``dense_rank_keys`` ranks the distinct (group, order) keys in
buckets of the order value instead:

1. distinct keys (map-side partial aggregation; the fact itself never moves);
2. each key gets a bucket that is a pure function of its order value (the
   day of a timestamp, a block of 1024 integers), so the result is
   deterministic and survives task retries and executor loss;
3. keys are numbered inside (group, bucket) with a window whose partitions
   are one bucket of one group;
4. the offset of a bucket is the number of keys in the earlier buckets of
   its group: a running sum over the small (group, bucket, count) table.

The result has one row per distinct key; join it back on (group, order).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from liftlake.session import written

Bucket = Callable[[Column], Column]


def default_bucket(dtype: T.DataType) -> Bucket:
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return lambda c: F.to_date(c)
    if isinstance(dtype, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
        return lambda c: F.floor(c / F.lit(1024))
    if isinstance(dtype, (T.DoubleType, T.FloatType, T.DecimalType)):
        return lambda c: F.floor(c)
    if isinstance(dtype, T.StringType):
        return lambda c: F.substring(c, 1, 2)
    raise TypeError(f"no default bucket for {dtype}")


def _default(dtype: T.DataType) -> Column | None:
    if isinstance(dtype, T.StringType):
        return F.lit("")
    if isinstance(dtype, (T.IntegerType, T.LongType, T.ShortType, T.ByteType, T.DoubleType, T.FloatType,
                          T.DecimalType)):
        return F.lit(0).cast(dtype)
    if isinstance(dtype, T.DateType):
        return F.lit("1970-01-01").cast("date")
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.lit("1970-01-01 00:00:00").cast(dtype)
    if isinstance(dtype, T.BooleanType):
        return F.lit(False)
    return None


def _null_safe_keys(df: DataFrame, cols: list[str]) -> tuple[DataFrame, list[str]] | None:
    """Materialise (value-or-default, is-null) pairs so null-safe equality on
    ``cols`` becomes plain equality on real columns (which keeps their hash
    partitioning usable by later joins and aggregates)."""
    names: list[str] = []
    for c in cols:
        d = _default(df.schema[c].dataType)
        if d is None:
            return None
        df = df.withColumn(f"_k_{c}", F.coalesce(F.col(c), d)).withColumn(f"_n_{c}", F.col(c).isNull())
        names += [f"_k_{c}", f"_n_{c}"]
    return df, names


def dense_rank_keys(df: DataFrame, group_cols: list[str], order_col: str, out: str,
                    bucket: Bucket | None = None) -> DataFrame:
    """Distinct (group_cols..., order_col) with ``out`` = dense rank of
    order_col within its group (ascending, nulls first). ``bucket`` must be
    monotone in the order value (a coarser sort key).

    The distinct keys are hash-partitioned once by (group, bucket); the
    local numbering, the per-bucket counts and the join with the offsets all
    reuse that partitioning, so only the small offset table moves again."""
    sel = df.select(*group_cols, order_col)
    b = bucket or default_bucket(sel.schema[order_col].dataType)
    keys = sel.withColumn("_b", b(F.col(order_col))).distinct()
    safe = _null_safe_keys(keys, group_cols + ["_b"])
    if safe is None:
        return _dense_rank_keys_generic(keys, group_cols, order_col, out)
    keys, kcols = safe
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = keys.repartition(n, *kcols)
    local = Window.partitionBy(*kcols).orderBy(F.col(order_col).asc_nulls_first())
    ranked = keys.withColumn("_local", F.row_number().over(local))
    counts = ranked.groupBy(*kcols).agg(F.max("_local").alias("_n"))
    gk = [c for c in kcols if not c.endswith("__b")]
    earlier = (Window.partitionBy(*gk).orderBy(F.col("_n__b").desc(), F.col("_k__b").asc())
               .rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*kcols, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"))
    return ranked.join(offsets, kcols, "inner").select(
        *group_cols, order_col, (F.col("_off") + F.col("_local")).cast("int").alias(out))


def _dense_rank_keys_generic(keys: DataFrame, group_cols: list[str], order_col: str, out: str) -> DataFrame:
    """Same result for key types without a null default (e.g. structs)."""
    counts = keys.groupBy(*group_cols, "_b").agg(F.count(F.lit(1)).alias("_n"))
    earlier = (Window.partitionBy(*group_cols).orderBy(F.col("_b").asc_nulls_first())
               .rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*[F.col(c).alias(f"_o_{c}") for c in group_cols], F.col("_b").alias("_o_b"),
                            F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"))
    local = Window.partitionBy(*group_cols, "_b").orderBy(F.col(order_col).asc_nulls_first())
    ranked = keys.withColumn("_local", F.row_number().over(local))
    cond = F.col("_b").eqNullSafe(F.col("_o_b"))
    for c in group_cols:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    return ranked.join(offsets, cond, "inner").select(
        *group_cols, order_col, (F.col("_off") + F.col("_local")).cast("int").alias(out))


def join_rank(df: DataFrame, ranks: DataFrame, group_cols: list[str], order_col: str) -> DataFrame:
    """Attach ranks to every row of ``df`` (null-safe on all key columns)."""
    r = ranks.withColumnRenamed(order_col, "_rk_o")
    for c in group_cols:
        r = r.withColumnRenamed(c, f"_rk_{c}")
    cond = F.col(order_col).eqNullSafe(F.col("_rk_o"))
    for c in group_cols:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_rk_{c}"))
    out = df.join(r, cond, "left")
    return out.drop("_rk_o", *[f"_rk_{c}" for c in group_cols])


def with_dense_rank(df: DataFrame, group_cols: list[str], order_col: str, out: str,
                    bucket: Bucket | None = None) -> DataFrame:
    return join_rank(df, dense_rank_keys(df, group_cols, order_col, out, bucket), group_cols, order_col)


def lag_by_position(df: DataFrame, group_cols: list[str], order_col: str, value_cols: list[str],
                    prefix: str = "prev_", materialize: bool = True) -> DataFrame:
    """LAG of ``value_cols`` by ``order_col`` within ``group_cols`` for a frame
    where (group, order) is unique: rank positions with ``dense_rank_keys``,
    then an equi-join of position p to p - 1. No group is ever gathered into
    one task. Null group values form their own group, as in SQL windows.

    ``df`` is read three times; with ``materialize`` it is first written as a
    table (it is usually a small aggregate over an expensive
    plan, and column pruning would otherwise make the three reads differ and
    recompute that plan each time)."""
    if materialize:
        df = written(df, "lag")
    ranks = dense_rank_keys(df, group_cols, order_col, "_pos")
    d = join_rank(df, ranks, group_cols, order_col)
    prev = d.select(*[F.col(c).alias(f"_lg_{c}") for c in group_cols], (F.col("_pos") + 1).alias("_lg_pos"),
                    *[F.col(v).alias(f"{prefix}{v}") for v in value_cols])
    cond = F.col("_pos") == F.col("_lg_pos")
    for c in group_cols:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_lg_{c}"))
    return d.join(prev, cond, "left").drop("_lg_pos", "_pos", *[f"_lg_{c}" for c in group_cols])

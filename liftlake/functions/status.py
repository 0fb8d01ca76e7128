"""Plan-versus-actual column expressions (native, codegen-friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The execution status labels, in the order the rule checks them.
SKIPPED = "Skipped"
UNPLANNED = "Unplanned"
HEAVIER_MORE_REPS = "Overperformed: Heavier & More Reps"
HEAVIER_FEWER_REPS = "Mixed: Heavier but Fewer Reps"
HEAVIER = "Overperformed: Heavier"
LIGHTER_MORE_REPS = "Mixed: Lighter but More Reps"
LIGHTER = "Underperformed: Lighter"
MORE_REPS = "Overperformed: More Reps"
FEWER_REPS = "Underperformed: Fewer Reps"
LONGER = "Overperformed: Longer Duration"
SHORTER = "Underperformed: Shorter Duration"
HIGHER_METRIC = "Overperformed: Higher Custom Metric"
LOWER_METRIC = "Underperformed: Lower Custom Metric"
BODYWEIGHT_MET = "Target Met: Free/Bodyweight"
TARGET_MET = "Target Met"

ALL_STATUSES = [
    SKIPPED, UNPLANNED, HEAVIER_MORE_REPS, HEAVIER_FEWER_REPS, HEAVIER, LIGHTER_MORE_REPS,
    LIGHTER, MORE_REPS, FEWER_REPS, LONGER, SHORTER, HIGHER_METRIC, LOWER_METRIC,
    BODYWEIGHT_MET, TARGET_MET,
]


def _z(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def execution_status(actual_present: Column, plan_present: Column,
                     weight: Column, reps: Column, duration: Column, metric: Column,
                     p_weight: Column, p_reps: Column, p_duration: Column, p_metric: Column,
                     p_distance: Column) -> Column:
    """Ordered classification of one performed set against its plan; missing
    numbers count as zero."""
    w, r, d, m = _z(weight), _z(reps), _z(duration), _z(metric)
    pw, pr, pd, pm = _z(p_weight), _z(p_reps), _z(p_duration), _z(p_metric)
    return (
        F.when(~actual_present, F.lit(SKIPPED))
        .when(~plan_present, F.lit(UNPLANNED))
        .when((w > pw) & (r > pr), F.lit(HEAVIER_MORE_REPS))
        .when((w > pw) & (r < pr), F.lit(HEAVIER_FEWER_REPS))
        .when(w > pw, F.lit(HEAVIER))
        .when((w < pw) & (r > pr), F.lit(LIGHTER_MORE_REPS))
        .when(w < pw, F.lit(LIGHTER))
        .when(r > pr, F.lit(MORE_REPS))
        .when(r < pr, F.lit(FEWER_REPS))
        .when(d > pd, F.lit(LONGER))
        .when(d < pd, F.lit(SHORTER))
        .when(m > pm, F.lit(HIGHER_METRIC))
        .when(m < pm, F.lit(LOWER_METRIC))
        .when((pw == 0) & (_z(p_distance) == 0), F.lit(BODYWEIGHT_MET))
        .otherwise(F.lit(TARGET_MET))
    )


def plan_diffs(prefix_actual: str = "", prefix_plan: str = "planned_") -> list[Column]:
    """actual - planned for weight, reps, duration and custom metric (null if
    either side is null)."""
    a = prefix_actual
    p = prefix_plan
    return [
        (F.col(f"{a}weight_kg") - F.col(f"{p}weight_kg")).alias("diff_weight_kg"),
        (F.col(f"{a}reps") - F.col(f"{p}reps")).alias("diff_reps"),
        (F.col(f"{a}duration_seconds") - F.col(f"{p}duration_seconds")).alias("diff_duration_seconds"),
        (F.col(f"{a}custom_metric") - F.col(f"{p}custom_metric")).alias("diff_custom_metric"),
    ]


def execution_status_sql(actual_present: str, plan_present: str, a: str = "", p: str = "planned_") -> str:
    """The same rule as one SQL CASE expression (one expression object
    instead of dozens of Column calls when building large plans)."""
    def z(c: str) -> str:
        return f"COALESCE({c}, 0)"
    w, r, d, m = (z(f"{a}{c}") for c in ("weight_kg", "reps", "duration_seconds", "custom_metric"))
    pw, pr, pd, pm, pdist = (z(f"{p}{c}") for c in ("weight_kg", "reps", "duration_seconds", "custom_metric",
                                                      "distance_meters"))
    return f"""CASE
        WHEN NOT ({actual_present}) THEN '{SKIPPED}'
        WHEN NOT ({plan_present}) THEN '{UNPLANNED}'
        WHEN {w} > {pw} AND {r} > {pr} THEN '{HEAVIER_MORE_REPS}'
        WHEN {w} > {pw} AND {r} < {pr} THEN '{HEAVIER_FEWER_REPS}'
        WHEN {w} > {pw} THEN '{HEAVIER}'
        WHEN {w} < {pw} AND {r} > {pr} THEN '{LIGHTER_MORE_REPS}'
        WHEN {w} < {pw} THEN '{LIGHTER}'
        WHEN {r} > {pr} THEN '{MORE_REPS}'
        WHEN {r} < {pr} THEN '{FEWER_REPS}'
        WHEN {d} > {pd} THEN '{LONGER}'
        WHEN {d} < {pd} THEN '{SHORTER}'
        WHEN {m} > {pm} THEN '{HIGHER_METRIC}'
        WHEN {m} < {pm} THEN '{LOWER_METRIC}'
        WHEN {pw} = 0 AND {pdist} = 0 THEN '{BODYWEIGHT_MET}'
        ELSE '{TARGET_MET}'
    END"""

"""Calendar labels and the four-week periodisation block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def iso_week(ts: Column) -> Column:
    return F.weekofyear(ts)


def year_week(ts: Column) -> Column:
    """Calendar year + ISO week, e.g. 2024-12-30 -> '2024-W01' (the label the
    dashboard builds with %Y-W%V)."""
    return F.concat(F.date_format(ts, "yyyy"), F.lit("-W"), F.lpad(iso_week(ts).cast("string"), 2, "0"))


def cycle_week(ts: Column) -> Column:
    """Week of the four-week block: ((ISO week - 1) % 4) + 1."""
    return F.pmod(iso_week(ts) - 1, F.lit(4)) + 1


# The four periodisation phases (week, name, goal, RPE target,
# rep modifier, load modifier, instruction).
PHASES = [
    (1, "ACCUMULATION", "Hypertrophy and Work Capacity", "7.0 - 7.5", "INCREASE_REPS", "MODERATE_LOAD",
     "Prioritize volume. Keep 2-3 reps in reserve (RIR). If in doubt, choose higher reps over heavier weight."),
    (2, "INTENSIFICATION", "Strength Endurance and Load Acclimatization", "8.0", "MAINTAIN_REPS", "INCREASE_LOAD",
     "Standard progressive overload. Increase weight from Week 1 while maintaining good form. RPE 8 is the sweet spot."),
    (3, "REALIZATION", "Peak Strength and PR Attempts", "9.0 - 9.5", "DECREASE_REPS", "PEAK_LOAD",
     "Heavy week. Push near failure safely. Drop reps if needed to handle maximum load. This is the test week."),
    (4, "DELOAD", "Systemic Recovery and Fatigue dissipation", "5.0 - 6.0", "REDUCE_VOLUME", "REDUCE_LOAD_40_PERCENT",
     "Mandatory recovery. Reduce weights by 40-50% OR cut number of sets in half. Do not push hard. Leave gym feeling fresh."),
]
PHASE_COLS = ["phase_week", "phase_name", "phase_goal", "phase_rpe_target", "phase_rep_modifier",
              "phase_load_modifier", "phase_instruction"]


def phase_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PHASES, PHASE_COLS)


def with_phase(df: DataFrame, date_col: str) -> DataFrame:
    """Attach the phase of each row's date (4-row table, broadcast by
    construction)."""
    spark = df.sparkSession
    return df.withColumn("phase_week", cycle_week(F.col(date_col)).cast("long")).join(
        F.broadcast(phase_table(spark)), "phase_week", "left")

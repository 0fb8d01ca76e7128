"""Training metrics as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def e1rm(weight: Column, reps: Column, single_rep_exact: bool = True) -> Column:
    """Epley estimate weight * (1 + reps / 30). The coach form returns the
    weight itself for a single rep; the dashboard form does not."""
    est = weight * (F.lit(1.0) + reps / F.lit(30.0))
    if single_rep_exact:
        return F.when(reps == 1, weight.cast("double")).otherwise(est)
    return est


def round_to_step(value: Column, step: float = 2.5) -> Column:
    """round(value / step) * step with half-to-even rounding, as Python's
    round() does for these quotients."""
    return F.bround(value / F.lit(step), 0) * F.lit(step)


def volume(weight: Column, reps: Column) -> Column:
    return F.coalesce(weight, F.lit(0.0)) * F.coalesce(reps, F.lit(0))


def shorten(text: Column, width: int = 30) -> Column:
    """Display truncation: longer than ``width`` -> first width-3 chars + '..'."""
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width - 3), F.lit(".."))).otherwise(text)

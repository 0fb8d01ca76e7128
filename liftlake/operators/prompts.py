"""Prompt text for every routine in one job.

Text is assembled with native string functions; a routine's prompt only
gathers its exercises' last-cycle sets (bounded by the plan), never its
whole history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftlake.functions.calendar import PHASE_COLS, with_phase
from liftlake.operators.coach import cycle_phase, last_cycle_sets
from liftlake.session import by_shuffle

# The coach instructions with the placeholders {phase_name} and
# {next_cycle}, and the history header.
SYSTEM_TEMPLATE = """You are an elite strength coach AI. Your task is to plan the NEXT workout session based STRICTLY on the provided execution history from the 'gold_prompt' database.

CRITICAL RULES:
1. Base your recommendations ON THE ACTUAL WEIGHT AND REPS performed in the last cycle. Focus on the heaviest set performed to determine the next target. Ignore 'planned' metrics.
2. Current Phase: {phase_name} (Cycle {next_cycle}).
   - If PROGRESSION: Increase weight by the 'Progression Step' if RPE is < 9.0 on the heaviest set. If RPE is between 9.0 and 9.5, maintain weight and push for more reps. If RPE > 9.5, slightly reduce weight or reps to manage fatigue.
   - If DELOAD: Reduce the ACTUAL weight of the last cycle by 10-15% and drop 1-2 reps to allow recovery.
3. If an exercise has 'Bodyweight' as weight but actual reps > 0, it was NOT skipped. Recommend progression by adding reps. Treat as skipped ONLY if BOTH weight and reps are 'Skipped'.
4. Note 'Superset ID' values. Exercises sharing the same Superset ID are performed back-to-back with minimal rest. Factor this cumulative fatigue into your recommendations if needed.
5. Determine the optimal 'rest_seconds' based on these rules:
   - If the exercise is a compound movement and is placed at the beginning of the workout (low Index), set to 210 (3m 30s).
   - If the exercise is part of a superset (has a Superset ID), set to 90 (1m 30s).
   - For all other isolation or simple exercises, set to 120 (2m).

Respond ONLY with a JSON object matching this schema:
{
    "recommendations": {
        "EXERCISE_ID": {
            "weight_kg": float,
            "reps": int,
            "rpe_target": float,
            "strategy": string,
            "rest_seconds": int,
            "reasoning": string
        }
    }
}
"""
HISTORY_HEADER = "--- EXERCISE HISTORY (gold_prompt) ---\n"

# The legacy coach system prompt with placeholders for the
# periodisation phase.
LEGACY_SYSTEM_TEMPLATE = """
You are an expert Strength & Conditioning Coach using Block Periodization.
Your goal is to prescribe targets based on the CURRENT CYCLE PHASE and user history.

### CURRENT PERIODIZATION PHASE
**{phase_name}** (Week {phase_week}/4)
- **Goal:** {phase_goal}
- **RPE Target:** {phase_rpe}
- **Instruction:** {phase_instruction}

### CORE RULES
1. **Adhere to Phase:** The Phase Logic overrides standard progression.
   - If Week 4 (Deload): You MUST reduce load/volume regardless of history.
   - If Week 1 (Accumulation): Prioritize volume (reps) over load.
   - If Week 3 (Peak): Prioritize load over reps.
2. **Analytics Integration:** Use `analytics.recommended_action` as a secondary modifier.
   - `DELOAD`: Reduce load by 10-15% or drop sets.
   - `RESET`: Reduce load by 20% to fix form/fatigue.
   - `PUSH_HARDER`: Increase load by 2x base_increment.
   - `CHANGE_REP_RANGE`: Invert reps/weight (e.g. High weight/low reps -> Lower weight/high reps).
   - `MAINTAIN/LINEAR_LOAD`: Standard progression.
3. **RPE Logic (if action is LINEAR_LOAD):**
   - RPE < 7: Increase weight or reps aggressively.
   - RPE 7-9: Small increment.
   - RPE 10: Maintain.
4. **Double Progression:** Isolation -> Reps first, then Weight.

### INPUT DATA FORMAT
You will receive:
- `analytics`: Trends and stall streaks.
- `history_summary`: Past sessions.

### OUTPUT FORMAT (JSON ONLY)
Return a single JSON object.

{
  "recommendations": {
    "EXERCISE_ID": {
      "weight_kg": 100.0,
      "reps": 8,
      "rpe_target": 7.5,
      "strategy": "ACCUMULATION_PHASE",
      "reasoning": "Week 1 Accumulation: Increasing reps to 10 to build volume, keeping RPE 7.5."
    }
  }
}
"""
LEGACY_USER_HEADER = "\n### ANALYZE THE FOLLOWING EXERCISES:\n\n"
LEGACY_USER_FOOTER = "\n\nGenerate the 'recommendations' JSON object.\n"


def text(c: Column, none: str = "None") -> Column:
    """Python-style text of a value (missing -> ``none``)."""
    return F.coalesce(c.cast("string"), F.lit(none))


def _fill(template: str, values: dict[str, Column]) -> Column:
    """Substitute {name} placeholders of a fixed template with columns."""
    parts: list[Column] = []
    rest = template
    while rest:
        i = rest.find("{")
        j = rest.find("}", i) if i >= 0 else -1
        name = rest[i + 1:j] if i >= 0 and j > i else None
        if name is None or name not in values:
            if i < 0 or j < 0:
                parts.append(F.lit(rest))
                break
            parts.append(F.lit(rest[:j + 1]))
            rest = rest[j + 1:]
            continue
        parts.append(F.lit(rest[:i]))
        parts.append(values[name])
        rest = rest[j + 1:]
    return F.concat(*parts)


def prompt_lines(gold: DataFrame) -> DataFrame:
    """One text line per last-cycle set."""
    s = last_cycle_sets(gold)
    line = F.concat(
        F.lit("  Set "), text(F.col("set_index")), F.lit(": Planned "), text(F.col("planned_weight_kg"), "N/A"),
        F.lit("kg x "), text(F.col("planned_reps"), "N/A"), F.lit(" | Actual: "),
        text(F.col("actual_weight_kg"), "Bodyweight"), F.lit("kg x "), text(F.col("actual_reps"), "Skipped"),
        F.lit(" @ RPE "), text(F.col("rpe")), F.lit(" | Status: "), text(F.col("execution_status")),
    )
    return s.select("routine_id", "exercise_template_id", "exercise_index", "superset_id", "title",
                    "progression_step_kg", "cycle", "set_index", "set_type", line.alias("line"))


def routine_prompts(gold: DataFrame) -> DataFrame:
    """The full prompt of every routine (rules with the phase of the next
    cycle, then one block per exercise in index order, nulls last)."""
    lines = prompt_lines(gold)
    blocks = (lines.groupBy("routine_id", "exercise_template_id", "exercise_index", "superset_id", "title",
                            "progression_step_kg", "cycle")
              .agg(F.array_sort(F.collect_list(F.struct("set_index", "set_type", "line"))).alias("ls")))
    superset = F.when(F.col("superset_id").isNotNull(), F.concat(F.lit(", Superset ID: "), text(F.col("superset_id"))))
    block = F.concat(
        F.lit("\nExercise: "), text(F.col("title")), F.lit(" (ID: "), text(F.col("exercise_template_id")),
        F.lit(", Index: "), text(F.col("exercise_index")), F.coalesce(superset, F.lit("")), F.lit(")\n"),
        F.lit("Progression Step: "), text(F.col("progression_step_kg")), F.lit(" kg\n"),
        F.lit("Last Cycle (# "), text(F.col("cycle")), F.lit(") Results:\n"),
        F.array_join(F.transform("ls", lambda x: x["line"]), "\n"), F.lit("\n"),
    )
    order = F.struct(F.col("exercise_index").isNull(), F.col("exercise_index"), F.col("exercise_template_id"))
    per_routine = (blocks.groupBy("routine_id")
                   .agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), block.alias("b")))).alias("bs")))
    phase = cycle_phase(gold)
    system = _fill(SYSTEM_TEMPLATE, {"phase_name": F.col("phase"), "next_cycle": F.col("next_cycle").cast("string")})
    return per_routine.join(by_shuffle(phase), "routine_id", "inner").select(
        "routine_id", "next_cycle", "phase",
        F.concat(system, F.lit("\n\n"), F.lit(HISTORY_HEADER),
                 F.array_join(F.transform("bs", lambda x: x["b"]), "")).alias("prompt"))


ANALYTICS = ["stall_streak", "e1rm_current", "e1rm_trend_percent", "avg_rpe_last_3", "status", "recommended_action"]
# The analysis of an exercise without history.
NO_HISTORY = {"stall_streak": 0, "e1rm_current": 0.0, "e1rm_trend_percent": 0.0, "avg_rpe_last_3": 0.0,
              "status": "NEW", "recommended_action": "LINEAR_LOAD"}


def _json_value(c: Column) -> Column:
    """A scalar as JSON text, null included."""
    return F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")


def _json_lines(fields: list[tuple[str, Column]], indent: int) -> Column:
    """Fields of an object as one line each; values are JSON text."""
    pad = " " * indent
    return F.concat_ws(",\n", *[F.concat(F.lit(f'{pad}"{k}": '), v) for k, v in fields])


def coach_context(exercises: DataFrame, analytics: DataFrame, history: DataFrame) -> DataFrame:
    """Per routine exercise the legacy coach context: id, name, base
    increment, analytics and the newest three sessions, as JSON text and as
    the indented text that the prompt shows. An exercise without history gets
    the analysis of a new one; a failed analysis holds its status and action
    only."""
    h3 = (history.filter(F.col("session_no") <= 3).groupBy("exercise_template_id")
          .agg(F.array_sort(F.collect_list(F.struct("session_no", F.date_format("date", "yyyy-MM-dd").alias("date"),
                                                    "weight", "reps", "rpe"))).alias("h")))
    j = (exercises.join(analytics, "exercise_template_id", "left").join(h3, "exercise_template_id", "left"))
    known = F.col("status").isNotNull()
    j = j.withColumns({k: F.when(known, F.col(k)).otherwise(F.lit(v)) for k, v in NO_HISTORY.items() if k != "status"}
                      | {"status": F.coalesce("status", F.lit(NO_HISTORY["status"]))})
    head = [("id", F.col("exercise_template_id")), ("name", F.col("title")),
            ("base_increment", F.coalesce(F.nullif(F.col("base_increment"), F.lit(0.0)), F.lit(2.5)))]
    head = [(k, _json_value(v)) for k, v in head]
    full = [(k, _json_value(F.col(k))) for k in ANALYTICS]
    failed = F.col("status") == "ERROR"
    sessions = F.coalesce("h", F.array().cast("array<struct<session_no:int,date:string,weight:double,reps:int,rpe:double>>"))

    def session(x: Column) -> list[tuple[str, Column]]:
        return [(k, _json_value(x[k])) for k in ("date", "weight", "reps", "rpe")]

    def compact(fields: list[tuple[str, Column]]) -> Column:
        return F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{k}":'), v) for k, v in fields]), F.lit("}"))

    context = compact([*head, ("analytics", F.when(failed, compact(full[-2:])).otherwise(compact(full))), (
        "history_summary", F.concat(F.lit("["), F.array_join(F.transform(sessions, lambda x: compact(session(x))), ","), F.lit("]")))])
    shown = F.concat(F.lit("  {\n"), _json_lines([
        *head,
        ("analytics", F.concat(F.lit("{\n"), F.when(failed, _json_lines(full[-2:], 6)).otherwise(_json_lines(full, 6)), F.lit("\n    }"))),
        ("history_summary", F.when(F.size(sessions) == 0, F.lit("[]")).otherwise(F.concat(
            F.lit("[\n"),
            F.array_join(F.transform(sessions, lambda x: F.concat(F.lit("      {\n"), _json_lines(session(x), 8), F.lit("\n      }"))), ",\n"),
            F.lit("\n    ]")))),
    ], 4), F.lit("\n  }"))
    return j.select("routine_id", "order_index", "exercise_template_id", context.alias("context_json"), shown.alias("context_text"))


def coach_prompts(contexts: DataFrame, phase_date: Column) -> DataFrame:
    """Legacy prompt per routine: the system text with the phase of
    ``phase_date`` followed by the exercise contexts."""
    per = (contexts.groupBy("routine_id")
           .agg(F.array_sort(F.collect_list(F.struct("order_index", "exercise_template_id", "context_text")))
                .alias("cs")))
    with_date = with_phase(per.withColumn("_d", phase_date), "_d")
    system = _fill(LEGACY_SYSTEM_TEMPLATE, {
        "phase_name": F.col("phase_name"), "phase_week": F.col("phase_week").cast("string"),
        "phase_goal": F.col("phase_goal"), "phase_rpe": F.col("phase_rpe_target"),
        "phase_instruction": F.col("phase_instruction")})
    user = F.concat(F.lit(LEGACY_USER_HEADER), F.lit("[\n"),
                    F.array_join(F.transform("cs", lambda x: x["context_text"]), ",\n"), F.lit("\n]"),
                    F.lit(LEGACY_USER_FOOTER))
    return with_date.select("routine_id", *[c for c in PHASE_COLS[:2]],
                            F.concat(system, F.lit("\n\n"), user).alias("prompt"))

"""Next-session plan assembly.

Coach replies arrive as data (one JSON text per routine). They are parsed
and validated as a whole, then combined with the routine documents into
routine-update payloads for every routine in one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftlake.functions.metrics import round_to_step
from liftlake.operators.coach import exercise_attributes, last_cycle_sets
from liftlake.session import by_shuffle, same

REC_FIELDS = ["weight_kg", "reps", "rpe_target", "strategy", "rest_seconds", "reasoning"]
REC_TYPES = {"weight_kg": "double", "reps": "int", "rpe_target": "double", "strategy": "string",
             "rest_seconds": "int", "reasoning": "string"}
_RAW_REC = "struct<recommendations: map<string, struct<" + ", ".join(f"{f}: string" for f in REC_FIELDS) + ">>>"

# Fixed values of the plan rules.
WARMUP_MIN_KG = 20.0
SINGLE_WARMUP_MIN_KG = 5.0
DEFAULT_WORKING_SETS = 3
REP_RANGE_HALF_WIDTH = 2


def _with_validity(responses: DataFrame) -> DataFrame:
    """Adds the parsed reply ``_r`` and ``_valid``: a JSON object with a
    recommendations map whose every entry has all six fields, coercible."""
    parsed = responses.withColumn("_r", F.from_json("response", _RAW_REC))
    m = F.col("_r.recommendations")

    def ok(v: Column) -> Column:
        c = F.lit(True)
        for f in REC_FIELDS:
            c = c & v[f].isNotNull()
            if REC_TYPES[f] != "string":
                c = c & v[f].try_cast(REC_TYPES[f]).isNotNull()
        return c

    return parsed.withColumn("_valid", F.coalesce(m.isNotNull() & F.forall(F.map_values(m), ok), F.lit(False)))


def parse_recommendations(responses: DataFrame) -> DataFrame:
    """K15 + B8: (routine_id, response) -> one row per recommended exercise,
    typed. Every field is read as text and coerced with try_cast; an entry
    with a missing or uncoercible field rejects the routine's whole reply,
    as does a reply that is not a JSON object with a recommendations map."""
    good = _with_validity(responses).filter(F.col("_valid"))
    ex = good.select("routine_id", F.explode(F.col("_r.recommendations")).alias("exercise_template_id", "v"))
    return ex.select("routine_id", "exercise_template_id",
                     *[F.col("v")[f].try_cast(REC_TYPES[f]).alias(f) if REC_TYPES[f] != "string"
                       else F.col("v")[f].alias(f) for f in REC_FIELDS])


def rejected_recommendations(responses: DataFrame) -> DataFrame:
    """B6 for replies: routines whose reply failed validation (an empty but
    well-formed reply is valid)."""
    return _with_validity(responses).filter(~F.col("_valid")).select(
        "routine_id", F.lit("invalid recommendations").alias("reason"))


def plan_summary(gold: DataFrame, recs: DataFrame, legacy: bool = False) -> DataFrame:
    """One line per recommendation with the exercise name. Current form:
    only exercises of the routine that have a recommendation; legacy form:
    every recommendation, unknown ids named 'Unknown'."""
    ex = exercise_attributes(gold).select("routine_id", "exercise_template_id", "title")
    how = "left" if legacy else "inner"
    j = recs.join(ex, ["routine_id", "exercise_template_id"], how)
    name = F.coalesce(F.col("title"), F.lit("Unknown")) if legacy else F.coalesce(F.col("title").cast("string"),
                                                                                   F.lit("None"))
    line = F.concat(name, F.lit(": "), F.col("weight_kg").cast("string"), F.lit("kg x "),
                    F.col("reps").cast("string"), F.lit(" ("), F.col("strategy"), F.lit(")"))
    return j.select("routine_id", "exercise_template_id", line.alias("line"))


def warmup_ladder(target: Column) -> Column:
    """Warm-up sets for a target weight as array<struct<weight_kg,reps>>:
    <20 kg none; <40: 50% x10; <80: 20x12, 60% x6, 80% x2; otherwise 20x15,
    40% x8, 60% x4, 80% x2, 90% x1; each rounded to 2.5 kg, kept when
    20 <= w < target and the weight is new, sorted by weight."""
    def s(frac_or_kg, reps, absolute=False):
        w = F.lit(float(frac_or_kg)) if absolute else target * F.lit(frac_or_kg)
        return F.struct(round_to_step(w).alias("weight_kg"), F.lit(reps).alias("reps"))

    cands = (F.when(target.isNull() | (target < 20), F.array().cast("array<struct<weight_kg:double,reps:int>>"))
             .when(target < 40, F.array(s(0.5, 10)))
             .when(target < 80, F.array(s(20, 12, True), s(0.6, 6), s(0.8, 2)))
             .otherwise(F.array(s(20, 15, True), s(0.4, 8), s(0.6, 4), s(0.8, 2), s(0.9, 1))))
    kept = F.filter(cands, lambda x: (x["weight_kg"] >= WARMUP_MIN_KG) & (x["weight_kg"] < target))
    first = F.filter(kept, lambda x, i: ~F.exists(F.slice(kept, 1, i), lambda y: y["weight_kg"] == x["weight_kg"]))
    return F.array_sort(first)


def warmup_single(target: Column) -> Column:
    """One warm-up at 50% x 10 (rounded to 2.5 kg); none when the
    target is <= 0 or the result is below 5 kg."""
    half = round_to_step(target * F.lit(0.5))
    one = F.array(F.struct(half.alias("weight_kg"), F.lit(10).alias("reps")))
    empty = F.array().cast("array<struct<weight_kg:double,reps:int>>")
    return F.when((target <= 0) | target.isNull() | (half < SINGLE_WARMUP_MIN_KG), empty).otherwise(one)


def _set(type_: Column, weight: Column, reps: Column | None = None, start: Column | None = None,
         end: Column | None = None) -> Column:
    rr = (F.struct(start.cast("int").alias("start"), end.cast("int").alias("end")) if start is not None
          else F.lit(None).cast("struct<start:int,end:int>"))
    return F.struct(type_.alias("type"), weight.cast("double").alias("weight_kg"),
                    (reps if reps is not None else F.lit(None)).cast("int").alias("reps"),
                    F.lit(None).cast("double").alias("distance_meters"),
                    F.lit(None).cast("double").alias("duration_seconds"),
                    F.lit(None).cast("double").alias("custom_metric"), rr.alias("rep_range"))


def routine_payloads(gold: DataFrame, recs: DataFrame, run_date: Column) -> DataFrame:
    """One routine-update payload per routine as JSON text (nulls
    dropped, set type serialised as ``type``), exercises in document order."""
    head = exercise_attributes(gold).withColumnRenamed("rest_seconds", "planned_rest_seconds")
    r = recs.withColumnRenamed("rest_seconds", "rec_rest_seconds")
    plans = _exercise_plans(gold, head, r)
    order = F.struct(F.col("exercise_index").isNull(), F.col("exercise_index"), F.col("exercise_template_id"))
    ex = F.struct(order.alias("o"), F.struct(
        "exercise_template_id", F.col("superset_id").cast("int").alias("superset_id"),
        F.col("rest_seconds").cast("int").alias("rest_seconds"), "notes", "sets").alias("e"))
    per = plans.groupBy("routine_id", "routine_title").agg(F.array_sort(F.collect_list(ex)).alias("xs"))
    body = F.struct(F.struct(
        F.col("routine_title").alias("title"),
        F.concat(F.lit("AI Plan: "), F.date_format(run_date, "yyyy-MM-dd")).alias("notes"),
        F.transform("xs", lambda x: x["e"]).alias("exercises")).alias("routine"))
    out = per.select("routine_id", body.alias("payload"))
    return out.select("routine_id", is_valid_payload(F.col("payload")).alias("is_valid"),
                      F.to_json("payload").alias("payload_json"))


def _exercise_plans(gold: DataFrame, head: DataFrame, recs: DataFrame) -> DataFrame:
    last = last_cycle_sets(gold)
    last_sets = last.groupBy("routine_id", "exercise_template_id").agg(
        F.sum((F.col("set_type") == "normal").cast("int")).alias("n_normal"),
        F.array_sort(F.collect_list(F.struct(
            "set_index", "set_type",
            F.coalesce(F.nullif(F.col("planned_weight_kg"), F.lit(0.0)), F.col("actual_weight_kg")).alias("w"),
            F.coalesce(F.nullif(F.col("planned_reps"), F.lit(0)), F.col("actual_reps")).alias("r"),
        ))).alias("copy"))
    j = (head.join(by_shuffle(last_sets), ["routine_id", "exercise_template_id"], "left")
         .join(by_shuffle(recs.withColumn("_has", F.lit(True))), ["routine_id", "exercise_template_id"], "left"))
    has = F.coalesce(F.col("_has"), F.lit(False))
    tw, tr = F.col("weight_kg"), F.col("reps")
    set_t = ("array<struct<type:string,weight_kg:double,reps:int,distance_meters:double,duration_seconds:double,"
             "custom_metric:double,rep_range:struct<start:int,end:int>>>")
    empty = F.array().cast(set_t)
    warm = F.when(tw > 0, F.transform(warmup_single(tw), lambda x: _set(F.lit("warmup"), x["weight_kg"], x["reps"])))
    n_work = F.coalesce(F.col("n_normal"), F.lit(DEFAULT_WORKING_SETS))
    work = F.when(n_work > 0, F.transform(
        F.sequence(F.lit(1), F.greatest(n_work, F.lit(1))),
        lambda _: _set(F.lit("normal"), tw, None, F.greatest(F.lit(1), tr - REP_RANGE_HALF_WIDTH),
                       tr + REP_RANGE_HALF_WIDTH))).otherwise(empty)
    rec_sets = F.concat(F.coalesce(warm, empty), work)
    copy_sets = F.coalesce(F.transform("copy", lambda x: _set(x["set_type"], x["w"], x["r"])), empty)
    rpe_note = F.when(F.col("rpe_target").isNotNull() & (F.col("rpe_target") != 0),
                      F.concat(F.lit(" RPE "), F.col("rpe_target").cast("string"))).otherwise(F.lit(""))
    notes = F.when(has, F.concat(F.lit("[AI: "), F.col("reasoning"), rpe_note, F.lit("]"))).otherwise(F.lit(""))
    return j.select(
        "routine_id", "routine_title", "exercise_template_id", "exercise_index", "superset_id",
        F.when(has, F.col("rec_rest_seconds")).otherwise(F.col("planned_rest_seconds")).alias("rest_seconds"),
        notes.alias("notes"), F.when(has, rec_sets).otherwise(copy_sets).alias("sets"),
        has.alias("has_recommendation"))


def exercise_plan_rows(gold: DataFrame, recs: DataFrame) -> DataFrame:
    """K19-K22 flattened: one row per planned set of every exercise."""
    head = exercise_attributes(gold).withColumnRenamed("rest_seconds", "planned_rest_seconds")
    r = recs.withColumnRenamed("rest_seconds", "rec_rest_seconds")
    p = _exercise_plans(gold, head, r)
    return p.select("routine_id", "exercise_template_id", "rest_seconds", "notes", "has_recommendation",
                    F.posexplode("sets").alias("set_no", "s")).select(
        "routine_id", "exercise_template_id", "rest_seconds", "notes", "has_recommendation", "set_no",
        F.col("s.type").alias("set_type"), F.col("s.weight_kg").alias("weight_kg"), F.col("s.reps").alias("reps"),
        F.col("s.rep_range.start").alias("rep_range_start"), F.col("s.rep_range.end").alias("rep_range_end"))


def is_valid_payload(payload: Column) -> Column:
    """Title is text, every exercise has a template id and a set list,
    every set has a type, and rep ranges have integer bounds."""
    r = payload["routine"]
    set_ok = lambda s: s["type"].isNotNull() & (
        s["rep_range"].isNull() | (s["rep_range"]["start"].isNotNull() & s["rep_range"]["end"].isNotNull()))
    ex_ok = lambda e: e["exercise_template_id"].isNotNull() & e["sets"].isNotNull() & F.forall(e["sets"], set_ok)
    return (r["title"].isNotNull() & r["exercises"].isNotNull() & F.forall(r["exercises"], ex_ok))


def of_routine(left: DataFrame, right: DataFrame) -> DataFrame:
    """LEFT join by routine and exercise of two frames that lie by the routine,
    which has few exercises."""
    r = right.withColumnsRenamed({"routine_id": "_r_routine", "exercise_template_id": "_r_template"})
    own = (F.col("routine_id") == F.col("_r_routine")) & same(F.col("exercise_template_id"), F.col("_r_template"))
    return left.join(by_shuffle(r), own, "left").drop("_r_routine", "_r_template")


def target_sets_legacy(plan_sets: DataFrame, recs: DataFrame) -> DataFrame:
    """Legacy working sets: as many as the planned normal sets (none ->
    3), each at the target weight and exact target reps."""
    n = plan_sets.groupBy("routine_id", "exercise_template_id").agg(
        F.sum((F.col("set_type") == "normal").cast("int")).alias("n_normal"))
    j = of_routine(recs, n)
    k = F.when(F.coalesce(F.col("n_normal"), F.lit(0)) > 0, F.col("n_normal")).otherwise(F.lit(DEFAULT_WORKING_SETS))
    return j.select("routine_id", "exercise_template_id", F.explode(F.sequence(F.lit(1), k)).alias("set_no"),
                    F.lit("normal").alias("set_type"), "weight_kg", "reps")


def warmup_rows(recs: DataFrame, ladder: bool = True) -> DataFrame:
    """K17 / K18 flattened per recommendation target."""
    arr = warmup_ladder(F.col("weight_kg")) if ladder else warmup_single(F.col("weight_kg"))
    return recs.select("routine_id", "exercise_template_id", F.col("weight_kg").alias("target_weight_kg"),
                       F.posexplode(arr).alias("warmup_no", "w")).select(
        "routine_id", "exercise_template_id", "target_weight_kg", "warmup_no",
        F.col("w.weight_kg").alias("weight_kg"), F.col("w.reps").alias("reps"))

"""Record validation of landed documents (B1-B6), as column predicates.

Items arrive as raw JSON text. Every scalar is read as text and coerced with
``try_cast`` (so "5" is a valid int and 5.5 is not). What that reading hides,
the JSON kind of a value, is checked on the document as a variant: a list or
object field of another kind, an explicit null list and a number in a text
field reject the document, while unknown fields are ignored whatever they hold.
A document is valid only if every nested exercise and set is valid: one bad
set rejects the whole workout. Invalid documents go to a rejects frame with
the first failing rule as reason, never silently dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftlake.functions.parsing import double_ok, int_ok, to_bool, to_double, to_int

WORKOUT_HEAD = ("id:string,title:string,description:string,start_time:string,end_time:string,updated_at:string,"
                "created_at:string,routine_id:string")
ROUTINE_HEAD = "id:string,title:string,folder_id:string,updated_at:string,created_at:string"
TEMPLATE_RAW = ("struct<id:string,title:string,type:string,primary_muscle_group:string,"
                "secondary_muscle_groups:array<string>,is_custom:string,equipment_category:string>")
FOLDER_RAW = "struct<id:string,index:string,title:string,updated_at:string,created_at:string>"
EVENT_RAW = "struct<type:string,workout:string,id:string,deleted_at:string>"

SET_T = ("struct<index:int,type:string,weight_kg:double,reps:int,rep_range:struct<start:double,end:double>,"
         "distance_meters:double,duration_seconds:double,rpe:double,custom_metric:double>")
EX_T = (f"struct<index:int,title:string,notes:string,rest_seconds:int,exercise_template_id:string,superset_id:int,"
        f"sets:array<{SET_T}>>")


def _has(keys: Column, k: str) -> Column:
    return F.array_contains(keys, F.lit(k))


def _list_ok(keys: Column, value: Column, k: str) -> Column:
    """A list field with a default: missing is fine, present must be a list."""
    return ~_has(keys, k) | value.isNotNull()


SET_TEXT = ("struct<index:string,type:string,weight_kg:string,reps:string,rep_range:struct<start:string,end:string>,"
            "distance_meters:string,duration_seconds:string,rpe:string,custom_metric:string>")
EX_TEXT = (f"struct<index:string,title:string,notes:string,rest_seconds:string,exercise_template_id:string,"
           f"superset_id:string,sets:array<{SET_TEXT}>>")
EXERCISES_TEXT = f"array<{EX_TEXT}>"
WORKOUT_RAW = f"struct<{WORKOUT_HEAD},exercises:{EXERCISES_TEXT}>"
ROUTINE_RAW = f"struct<{ROUTINE_HEAD},exercises:{EXERCISES_TEXT}>"


# Text in which some value may have the wrong kind: a text field that starts
# with neither a quote nor null, a list without a bracket, an object without a
# brace, a list element that is no object. One search of the text spares nearly all documents the variant.
# It starts with a class of characters, so that most places are passed by a single look.
_SUSPECT = (r'["}](?:(?<=")(?:(?:id|title|description|start_time|end_time|updated_at|created_at|routine_id|folder_id|notes|exercise_template_id|type)"'
            r'\s*:\s*[^"n\s]|(?:sets|exercises)"\s*:\s*(?:[^\[\s]|\[\s*[^{\]\s])|rep_range"\s*:\s*[^{n\s])'
            r'|(?<=\})\s*,\s*(?:[^{"\s]|"[^"\\]*"\s*[,\]]))')


def _kinds(text: Column, check) -> Column:
    """Whether ``check`` holds for the document, as a variant, of a suspect text."""
    return ~text.rlike(_SUSPECT) | F.coalesce(check(F.try_parse_json(text)), F.lit(False))


def _at(value: Column, field: str, kind: str = "variant") -> Column:
    """The value of a field as a kind; null if missing or of another kind."""
    return F.try_variant_get(value, f"$.{field}", kind)


def _text(value: Column, field: str, required: bool = False, number: bool = False) -> Column:
    kinds = ["STRING"] + ["BIGINT"] * number + ["VOID"] * (not required)
    return F.coalesce(F.schema_of_variant(_at(value, field)).isin(kinds), F.lit(not required))


def _texts(value: Column, required: list[str], optional: list[str]) -> Column:
    ok = F.lit(True)
    for f in required:
        ok = ok & _text(value, f, True)
    for f in optional:
        ok = ok & _text(value, f)
    return ok


def _exercise_shapes(doc: Column, require_set_type: bool) -> Column:
    """Whether nested lists, objects and texts have their JSON kinds. Elements
    that are no objects are left to the typed parse, which gives null there."""
    def set_ok(s: Column) -> Column:
        rep_range = _at(s, "rep_range")
        return _text(s, "type", require_set_type) & (
            rep_range.isNull() | F.is_variant_null(rep_range) | _at(s, "rep_range", "struct<start:variant,end:variant>").isNotNull())

    def exercise_ok(e: Column) -> Column:
        sets = F.forall(_at(e, "sets", "array<variant>"), set_ok)
        return _texts(e, ["title", "exercise_template_id"], ["notes"]) & F.coalesce(sets, _at(e, "sets").isNull())

    return F.coalesce(F.forall(_at(doc, "exercises", "array<variant>"), exercise_ok), F.lit(True))


def _set_checks(v: Column, require_type: bool = True) -> Column:
    """Validity and typed value of one set parsed as text (no JSON parsing
    here: HOF lambdas are interpreted, so they only do field reads and casts)."""
    rr = v["rep_range"]
    rr_ok = rr.isNull() | (double_ok(rr["start"]) & double_ok(rr["end"]))
    ok = (v.isNotNull() & int_ok(v["index"], True)
          & (v["type"].isNotNull() if require_type else F.lit(True))
          & double_ok(v["weight_kg"]) & int_ok(v["reps"]) & rr_ok & double_ok(v["distance_meters"])
          & double_ok(v["duration_seconds"]) & double_ok(v["rpe"]) & double_ok(v["custom_metric"]))
    typed = F.struct(
        to_int(v["index"]).alias("index"), v["type"].alias("type"), to_double(v["weight_kg"]).alias("weight_kg"),
        to_int(v["reps"]).alias("reps"),
        F.when(rr.isNotNull(), F.struct(to_double(rr["start"]).alias("start"),
                                        to_double(rr["end"]).alias("end"))).alias("rep_range"),
        to_double(v["distance_meters"]).alias("distance_meters"),
        to_double(v["duration_seconds"]).alias("duration_seconds"), to_double(v["rpe"]).alias("rpe"),
        to_double(v["custom_metric"]).alias("custom_metric"))
    return F.struct(F.coalesce(ok, F.lit(False)).alias("ok"), typed.alias("t"))


def _exercise_checks(exercises: Column, require_set_type: bool = True) -> Column:
    def one(v: Column) -> Column:
        sets = F.transform(F.coalesce(v["sets"], F.array().cast(f"array<{SET_TEXT}>")),
                           lambda st: _set_checks(st, require_set_type))
        ok = (v.isNotNull() & int_ok(v["index"], True) & v["title"].isNotNull()
              & v["exercise_template_id"].isNotNull() & int_ok(v["rest_seconds"]) & int_ok(v["superset_id"])
              & F.forall(sets, lambda s: s["ok"]))
        typed = F.struct(
            to_int(v["index"]).alias("index"), v["title"].alias("title"), v["notes"].alias("notes"),
            to_int(v["rest_seconds"]).alias("rest_seconds"), v["exercise_template_id"].alias("exercise_template_id"),
            to_int(v["superset_id"]).alias("superset_id"), F.transform(sets, lambda s: s["t"]).alias("sets"))
        return F.struct(F.coalesce(ok, F.lit(False)).alias("ok"), typed.alias("t"))
    return F.transform(F.coalesce(exercises, F.array().cast(EXERCISES_TEXT)), one)


def _with_exercises(df: DataFrame, keys: Column, raws: Column, text: Column, texts,
                    require_set_type: bool = True) -> DataFrame:
    """Check the (already parsed) exercise tree and the kinds of all values,
    those of the document itself by ``texts``; adds ``_listed``, ``_all_ok`` and ``_typed_ex``."""
    df = df.withColumn("_exc", _exercise_checks(raws, require_set_type))
    return (df.withColumn("_listed", _list_ok(keys, raws, "exercises"))
            .withColumn("_all_ok", F.forall("_exc", lambda e: e["ok"]) & _kinds(text, lambda doc: texts(doc) & _exercise_shapes(doc, require_set_type)))
            .withColumn("_typed_ex", F.transform("_exc", lambda e: e["t"])))


def _with_quick_parse(items: DataFrame, head: str, require_set_type: bool = True) -> DataFrame:
    """Adds ``_q``, the document parsed by its types, ``_clean``, whether nothing
    in it needs a closer look (it is valid and ``_q`` holds its values), and
    ``_rest``, its text if it does. Documents as they should be, nearly all, are
    parsed once and by no cast; values that a cast would save, nulls and kinds
    are judged on the others by the rules below. Each step is a generator of one
    row, which keeps its result from being computed again for each use."""
    schema = f"{head},exercises:array<{EX_T}>,_bad:string"
    q = F.from_json("item", f"struct<{schema}>", {"columnNameOfCorruptRecord": "_bad"})
    p = items.select("*", F.explode(F.array(q)).alias("_q"))
    v = F.col("_q")

    def set_ok(s: Column) -> Column:
        return s["index"].isNotNull() & (s["type"].isNotNull() if require_set_type else s.isNotNull())

    def exercise_ok(e: Column) -> Column:
        return (e["index"].isNotNull() & e["title"].isNotNull() & e["exercise_template_id"].isNotNull()
                & F.coalesce(F.forall(e["sets"], set_ok), F.lit(False)))

    clean = (F.col("item").startswith("{") & v["_bad"].isNull() & v["id"].isNotNull() & v["title"].isNotNull()
             & F.coalesce(F.forall(v["exercises"], exercise_ok), F.lit(False)) & ~F.col("item").rlike(_SUSPECT))
    p = p.select("*", F.explode(F.array(F.coalesce(clean, F.lit(False)))).alias("_clean"))
    return p.withColumn("_rest", F.when(~F.col("_clean"), F.col("item")))


def _split_nested(parsed: DataFrame, head: str, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """Valid and rejected documents with exercises: clean ones by their quick
    parse, the others by the rules."""
    k, v, clean = F.col("_k"), F.col("_v"), F.col("_clean")
    checks = [("not a JSON object", k.isNotNull()), ("missing id", v["id"].isNotNull()),
              ("missing title", v["title"].isNotNull()), ("exercises is not a list", F.col("_listed")),
              ("invalid exercise or set", F.col("_all_ok"))]
    names = [f.split(":")[0] for f in head.split(",")]
    typed = [F.when(clean, F.col("_q")[c]).otherwise(v[c]).alias(c) for c in names]
    typed.append(F.when(clean, F.col("_q")["exercises"]).otherwise(F.col("_typed_ex")).alias("exercises"))
    return _split(parsed, [(reason, clean | ok) for reason, ok in checks], typed, keep)


def _split(parsed: DataFrame, checks: list[tuple[str, Column]], typed_cols: list[Column],
           keep: list[str]) -> tuple[DataFrame, DataFrame]:
    reason = F.lit(None).cast("string")
    for name, ok in reversed(checks):
        reason = F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)).otherwise(reason)
    r = parsed.withColumn("_reason", reason)
    valid = r.filter(F.col("_reason").isNull()).select(*keep, *typed_cols)
    rejects = r.filter(F.col("_reason").isNotNull()).select(*keep, "item", F.col("_reason").alias("reason"))
    return valid, rejects


def _workout_texts(doc: Column) -> Column:
    return _text(doc, "id", True, number=True) & _texts(
        doc, ["title"], ["description", "start_time", "end_time", "updated_at", "created_at", "routine_id"])


def validate_workouts(items: DataFrame, require_set_type: bool = True) -> tuple[DataFrame, DataFrame]:
    """B1 (+B6): valid workout documents (typed) and rejects."""
    keep = [c for c in items.columns if c != "item"]
    p = _with_quick_parse(items, WORKOUT_HEAD, require_set_type)
    p = p.select("*", F.json_object_keys("_rest").alias("_k"), F.from_json("_rest", WORKOUT_RAW).alias("_v"))
    p = _with_exercises(p, F.col("_k"), F.col("_v.exercises"), F.col("_rest"), _workout_texts, require_set_type)
    return _split_nested(p, WORKOUT_HEAD, keep)


def validate_routines(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """B2 (+B6)."""
    keep = [c for c in items.columns if c != "item"]
    p = _with_quick_parse(items, ROUTINE_HEAD)
    p = p.select("*", F.json_object_keys("_rest").alias("_k"), F.from_json("_rest", ROUTINE_RAW).alias("_v"))
    p = _with_exercises(p, F.col("_k"), F.col("_v.exercises"), F.col("_rest"), lambda doc: _texts(
        doc, ["id", "title"], ["updated_at", "created_at"]) & _text(doc, "folder_id", number=True))
    return _split_nested(p, ROUTINE_HEAD, keep)


def _variant(check) -> Column:
    """``check`` of the whole document as a variant (documents without nested
    lists are small, so each is parsed)."""
    return F.coalesce(check(F.try_parse_json(F.col("item"))), F.lit(False))


WRONG_KIND = "a text field is no text"


def validate_templates(items: DataFrame, is_custom_default_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """B3 (+B6): id and title required, muscle list defaults to [] (explicit
    null rejected), is_custom defaults to False (an explicit null stays null
    unless ``is_custom_default_only``, where null is invalid)."""
    keep = [c for c in items.columns if c != "item"]
    p = items.select("*", F.json_object_keys("item").alias("_k"), F.from_json("item", TEMPLATE_RAW).alias("_v"))
    k, v = F.col("_k"), F.col("_v")
    custom_ok = (~_has(k, "is_custom") | to_bool(v["is_custom"]).isNotNull()
                 | (v["is_custom"].isNull() & F.lit(not is_custom_default_only)))
    checks = [("not a JSON object", k.isNotNull()), ("missing id", v["id"].isNotNull()),
              ("missing title", v["title"].isNotNull()),
              ("secondary_muscle_groups is not a list", _list_ok(k, v["secondary_muscle_groups"],
                                                                 "secondary_muscle_groups")),
              ("is_custom is not a boolean", custom_ok),
              (WRONG_KIND, _variant(lambda doc: _text(doc, "id", True, number=True) & _texts(
                  doc, ["title"], ["type", "primary_muscle_group", "equipment_category"]) & F.coalesce(
                  F.forall(_at(doc, "secondary_muscle_groups", "array<variant>"), lambda m: F.schema_of_variant(m) == "STRING"), F.lit(True))))]
    typed = [v["id"].alias("id"), v["title"].alias("title"), v["type"].alias("type"),
             v["primary_muscle_group"].alias("primary_muscle_group"),
             v["equipment_category"].alias("equipment_category"),
             F.coalesce(v["secondary_muscle_groups"], F.array().cast("array<string>")).alias("secondary_muscle_groups"),
             F.when(~_has(k, "is_custom"), F.lit(False)).otherwise(to_bool(v["is_custom"])).alias("is_custom")]
    return _split(p, checks, typed, keep)


def validate_folders(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """B4 (+B6): id, index (int) and title required."""
    keep = [c for c in items.columns if c != "item"]
    p = items.select("*", F.json_object_keys("item").alias("_k"), F.from_json("item", FOLDER_RAW).alias("_v"))
    k, v = F.col("_k"), F.col("_v")
    checks = [("not a JSON object", k.isNotNull()), ("missing id", v["id"].isNotNull()),
              ("missing or bad index", int_ok(v["index"], True)), ("missing title", v["title"].isNotNull()),
              (WRONG_KIND, _variant(lambda doc: _text(doc, "id", True, number=True) & _texts(doc, ["title"], ["updated_at", "created_at"])))]
    typed = [v["id"].alias("id"), to_int(v["index"]).alias("index"), v["title"].alias("title"),
             v["updated_at"].alias("updated_at"), v["created_at"].alias("created_at")]
    return _split(p, checks, typed, keep)


def validate_events(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """B5 (+B6): type required; an embedded workout, when present, must be a
    valid workout document."""
    keep = [c for c in items.columns if c != "item"]
    p = items.select("*", F.json_object_keys("item").alias("_k"), F.from_json("item", EVENT_RAW).alias("_v"))
    p = p.withColumn("_wk", F.json_object_keys(F.col("_v.workout"))).withColumn(
        "_wv", F.from_json(F.col("_v.workout"), WORKOUT_RAW))
    k, v, wk, wv = F.col("_k"), F.col("_v"), F.col("_wk"), F.col("_wv")
    p = _with_exercises(p, wk, wv["exercises"], F.col("_v.workout"), _workout_texts)
    w_ok = v["workout"].isNull() | (wk.isNotNull() & wv["id"].isNotNull() & wv["title"].isNotNull()
                                    & F.col("_listed") & F.col("_all_ok"))
    checks = [("not a JSON object", k.isNotNull()), ("missing type", v["type"].isNotNull()),
              ("invalid workout", w_ok),
              (WRONG_KIND, _variant(lambda doc: _texts(doc, ["type"], ["deleted_at"]) & _text(doc, "id", number=True)))]
    workout = F.when(v["workout"].isNotNull(), F.struct(
        wv["id"].alias("id"), wv["title"].alias("title"), wv["description"].alias("description"),
        wv["start_time"].alias("start_time"), wv["end_time"].alias("end_time"), wv["updated_at"].alias("updated_at"),
        wv["created_at"].alias("created_at"), wv["routine_id"].alias("routine_id"),
        F.col("_typed_ex").alias("exercises")))
    typed = [v["type"].alias("type"), workout.alias("workout"), v["id"].alias("id"),
             v["deleted_at"].alias("deleted_at")]
    return _split(p, checks, typed, keep)


VALIDATORS = {
    "workouts": validate_workouts,
    "routines": validate_routines,
    "exercise_templates": validate_templates,
    "routine_folders": validate_folders,
    "events": validate_events,
}


def validate(items: DataFrame, entity: str) -> tuple[DataFrame, DataFrame]:
    return VALIDATORS[entity](items)

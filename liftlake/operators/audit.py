"""Raw key audit over landed documents (A9): which exercise keys match a
needle, with the first non-null examples in landing order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _entries(items: DataFrame, needle: str) -> DataFrame:
    exs = items.select("page", F.posexplode(F.from_json("item", "struct<id:string,exercises:array<string>>")
                                           .getField("exercises")).alias("ex_pos", "ex"),
                       F.get_json_object("item", "$.id").alias("parent_id"),
                       F.col("item"))
    kv = exs.select("page", "parent_id", "ex_pos", F.get_json_object("ex", "$.title").alias("exercise_title"),
                    F.explode(F.from_json("ex", "map<string,string>")).alias("key_found", "value"))
    return kv.filter(F.lower("key_found").contains(needle.lower()))


def matching_keys(items: DataFrame, needle: str) -> DataFrame:
    return _entries(items, needle).select("key_found").distinct()


def raw_key_audit(items: DataFrame, needle: str, k: int = 10) -> DataFrame:
    """First ``k`` non-null values (page, document, exercise order): a
    distributed top-k, never a collect of all matches."""
    e = _entries(items, needle).filter(F.col("value").isNotNull())
    e = e.withColumn("_doc", F.col("parent_id").try_cast("long"))
    return (e.orderBy("page", "_doc", "parent_id", "ex_pos").limit(k)
            .select("key_found", "parent_id", "exercise_title", "value"))

"""Preference formatting (op 2): paired completions over a common prompt.

Chosen and rejected conversations are compared turn by turn. Their longest
common prefix is rendered once, as the prompt; what follows in each becomes a
completion with a mask that trains on the text and end mark of assistant turns
and on nothing else. Conversations are built by one grouped pass; everything
else is a projection of built-in functions.

The conversations table states no preferences, so the query makes pairs from
it: chosen is the conversation up to its last assistant reply, rejected the same
with that reply taken from the next conversation of the table that has one, by
id (null first; the last takes the first's). What follows the last reply is in
neither. Ids are dealt to ranges by quantiles, so no task sees the whole order,
and each range's last conversation takes the first reply of the range after it.
A conversation without a reply, or the only one with a reply, has no pair and is
left out by the pairing, not the format.

A conversation is a row of its result, so its distinct turns are gathered in one.

Defined results: a null text or role is empty; turns are ordered by turn
number, then role, then text, and equal rows are one turn; all rows with a null
id are one conversation; a pair that agrees in all turns (two equal replies) has
two empty completions; an empty table gives no pairs; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import shuffle_partitions

# The marks around a turn.
START, END = "<|im_start|>", "<|im_end|>"
TRAINED_ROLE = "assistant"


def conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order, as structs
    (role, text)."""
    turn = F.struct(
        F.col("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    )
    ordered = F.array_sort(F.collect_set(turn))
    return rows.groupBy("conv_id").agg(F.transform(ordered, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def common_turns(a: Column, b: Column) -> Column:
    """Length of the longest common prefix."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.coalesce(F.nullif(F.array_position(same, F.lit(False)), F.lit(0).cast("long")) - 1, F.size(a).cast("long")).cast("int")


def _head(turn: Column) -> Column:
    return F.concat(F.lit(START), turn["role"], F.lit("\n"))


def _tail(turn: Column) -> Column:
    return F.concat(turn["text"], F.lit(END + "\n"))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _tail(t))), "")


def mask(turns: Column) -> Column:
    """Lengths in code points of the rendered turns by turns untrained and
    trained, from an untrained one: each turn gives its head, then its text
    with the end mark if the turn is trained; other turns are all head."""

    def lengths(t: Column) -> Column:
        head, tail = F.length(_head(t)), F.length(_tail(t))
        trained = t["role"] == TRAINED_ROLE
        return F.array(F.when(trained, head).otherwise(head + tail), F.when(trained, tail).otherwise(F.lit(0)))

    return F.array_join(F.transform(F.flatten(F.transform(turns, lengths)), lambda n: n.cast("string")), ",")


def format_preferences(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """Pairs with prompt, chosen_completion, chosen_mask, rejected_completion,
    rejected_mask and n_prompt_turns; the two turn arrays are dropped."""
    n = common_turns(F.col(chosen), F.col(rejected))
    counted = pairs.withColumn("n_prompt_turns", n)
    rest = lambda c: F.slice(F.col(c), F.col("n_prompt_turns") + 1, F.size(c))
    return counted.withColumns({
        "prompt": rendered(F.slice(F.col(chosen), F.lit(1), F.col("n_prompt_turns"))),
        "chosen_completion": rendered(rest(chosen)), "chosen_mask": mask(rest(chosen)),
        "rejected_completion": rendered(rest(rejected)), "rejected_mask": mask(rest(rejected)),
    }).drop(chosen, rejected)


def id_range(ids: Column, cuts: list[int]) -> Column:
    """How many of the ascending cuts lie below an id (null: none), by
    bisection."""
    steps = [1 << i for i in reversed(range(len(cuts).bit_length()))]
    if not steps:
        return F.lit(0)
    table = F.array(*map(F.lit, cuts)).cast("array<bigint>")
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(F.get(table, at + step - 1) < ids, at + step).otherwise(at))


def borrowed_replies(rows: DataFrame) -> DataFrame:
    """(conv_id, chosen, rejected) made from conversation rows, as stated above."""
    count = 4 * shuffle_partitions(rows.sparkSession)
    cuts = rows.agg(F.percentile_approx("conv_id", [i / count for i in range(1, count)], 10_000)).first()[0] or []
    span = id_range(F.col("conv_id"), sorted(set(cuts))).alias("span")

    # The first reply of each range, next to the range before it; the last
    # range is followed by the first. One row a range.
    last_reply = F.max(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))["text"]
    replies = rows.where(F.col("role") == TRAINED_ROLE).groupBy("conv_id").agg(last_reply.alias("text"))
    firsts = replies.select(span, F.struct("conv_id", "text").alias("reply")).groupBy("span").agg(F.min("reply").alias("reply"))
    order = W.orderBy("span")
    following = firsts.select("span", F.coalesce(F.lead("reply").over(order), F.first("reply").over(order)).alias("beyond"))

    role_at = F.transform("turns", lambda t: t["role"] == TRAINED_ROLE)
    last = F.size("turns") - F.array_position(F.reverse(role_at), F.lit(True)) + 1
    answered = conversations(rows).where(F.exists("turns", lambda t: t["role"] == TRAINED_ROLE)).select("conv_id", span, F.slice("turns", F.lit(1), last.cast("int")).alias("chosen"))
    reply = F.struct("conv_id", F.element_at("chosen", -1)["text"].alias("text"))
    paired = (answered.withColumn("within", F.lead(reply).over(W.partitionBy("span").orderBy("conv_id")))
              .join(following, "span").withColumn("other", F.coalesce("within", "beyond")))
    swapped = F.struct(F.lit(TRAINED_ROLE).alias("role"), F.col("other.text").alias("text"))
    return paired.where(~F.col("other.conv_id").eqNullSafe(F.col("conv_id"))).select(
        "conv_id", "chosen", F.concat(F.slice("chosen", F.lit(1), F.size("chosen") - 1), F.array(swapped)).alias("rejected"),
    )


def op2(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return format_preferences(borrowed_replies(rows))


ORACLE = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i FROM t),
r AS (SELECT conv_id, i AS last, text FROM n WHERE role = 'assistant' QUALIFY i = max(i) OVER (PARTITION BY conv_id)),
o AS (
  SELECT conv_id, last, coalesce(lead(text) OVER (ORDER BY conv_id NULLS FIRST), first_value(text) OVER (ORDER BY conv_id NULLS FIRST)) AS other
  FROM r QUALIFY count(*) OVER () > 1),
c AS (
  SELECT n.conv_id, i, role, n.text, other, last, '<|im_start|>' || role || chr(10) AS head, n.text || '<|im_end|>' || chr(10) AS tail,
    i < last OR (i = last AND n.text = other) AS common
  FROM n JOIN o ON n.conv_id IS NOT DISTINCT FROM o.conv_id AND i <= last),
m AS (
  SELECT *, CASE WHEN role = 'assistant' THEN concat(length(head), ',', length(tail)) ELSE concat(length(head) + length(tail), ',0') END AS mask FROM c)
SELECT conv_id, CAST(count(*) FILTER (common) AS INTEGER) AS n_prompt_turns,
  coalesce(string_agg(head || tail, '' ORDER BY i) FILTER (common), '') AS prompt,
  coalesce(string_agg(head || tail, '' ORDER BY i) FILTER (NOT common), '') AS chosen_completion,
  coalesce(string_agg(mask, ',' ORDER BY i) FILTER (NOT common), '') AS chosen_mask,
  CASE WHEN any_value(o_same) THEN '' ELSE any_value('<|im_start|>assistant' || chr(10) || other || '<|im_end|>' || chr(10)) END AS rejected_completion,
  CASE WHEN any_value(o_same) THEN '' ELSE any_value(concat(length('<|im_start|>assistant') + 1, ',', length(other) + length('<|im_end|>') + 1)) END AS rejected_mask
FROM (SELECT *, bool_or(i = last AND text = other) OVER (PARTITION BY conv_id) AS o_same FROM m)
GROUP BY conv_id
"""

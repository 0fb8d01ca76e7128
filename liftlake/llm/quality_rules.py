"""Quality rules (op 3): a threshold table compiled into one projection.

Each rule bounds a ratio of two measures of the whole text, in percent. The
measures and the rules are built-in column expressions only.

The stop words are those of four languages and are compared in lower case. Their
rule judges only texts whose letters are mostly Latin: a Latin-script text in
another language with under 3 % of such words fails it, so a corpus that holds
more languages needs more lists, or RULES without that rule.

Defined results: null and empty texts have no words and fail the base rule;
every row is judged by itself, so ties and repeated rows get equal verdicts;
other columns are untouched.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents

BLANK = r"[\x20\x09-\x0D]+"
REPEAT_WINDOW = 8

# Frequent function words of the corpus languages.
STOP_WORDS = {
    "en": "the of and to in is that it was for on are as with his they at be this from have or by had not but what all were when we there can an which their said if do will each how them then she many some so these would other into has more",
    "de": "der die das und in zu den mit von ist für auf dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sich im des",
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont ou avec son aux mais comme elle ses leur tout nous deux cette été être ces dont lui fait même",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más pero sus le ya o fue este ha sí porque esta son entre cuando muy sin sobre ser tiene también me hasta hay donde",
}


@dataclass(frozen=True)
class Rule:
    """``low <= 100 * measure / per <= high``; either bound may be absent. With a
    ``scope`` (measure, per, percent) only rows at that percentage are judged."""

    name: str
    measure: str
    per: str
    low: int | None = None
    high: int | None = None
    scope: tuple[str, str, int] | None = None

    def holds(self) -> Column:
        value, base = 100 * F.col(self.measure), F.col(self.per)
        ok = F.lit(True)
        if self.low is not None:
            ok &= value >= self.low * base
        if self.high is not None:
            ok &= value <= self.high * base
        if self.scope is not None:
            share, whole, percent = self.scope
            ok |= 100 * F.col(share) < percent * F.col(whole)
        return ok


RULES = (
    Rule("word_length", "word_chars", "n_words", low=250, high=1200),
    Rule("symbols", "n_symbols", "n_words", high=10),
    Rule("letters", "n_letters", "word_chars", low=75),
    Rule("stop_words", "n_stop_words", "n_words", low=3, scope=("n_latin", "n_letters", 50)),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=50),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", high=90),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", high=30),
)
# Base rule: fewer words, or a larger share of words in repeated windows, fail.
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once, inside one expression."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANK), "")


def repeated_words(words: Column, window: int = REPEAT_WINDOW) -> Column:
    """Number of words that lie in a window of ``window`` words found twice or
    more. Windows are compared by a 64-bit hash; only texts with an equal pair
    go on to place them: hashes sorted with their places, equal neighbours
    kept, and the kept places' reach added up."""

    def places(hashes: Column) -> Column:
        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(ordered, lambda p: F.array_sort(F.transform(
            F.filter(p, lambda x, j: F.get(p, j - 1)["h"].eqNullSafe(x["h"]) | F.get(p, j + 1)["h"].eqNullSafe(x["h"])),
            lambda x: x["i"],
        )))

    def reach(at: Column) -> Column:
        steps = F.transform(at, lambda i, k: F.least(F.lit(window), F.coalesce(F.get(at, k + 1) - i, F.lit(window))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def count(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), let(places(hashes), reach)).otherwise(F.lit(0))

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(h) - (window - 1)), lambda i: F.xxhash64(F.slice(h, i, window)))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) >= window, let(let(hashes, windows), count)).otherwise(F.lit(0)).cast("long")


def _count(items: Column) -> Column:
    return F.size(items).cast("long")


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with their measures: n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, n_letters, n_latin, n_stop_words, n_lines,
    n_bullet_lines, n_ellipsis_lines. Names already taken are replaced, so keep
    clashing columns in a struct (see ``verdicts``)."""
    body = F.coalesce(F.col(text), F.lit(""))
    stop = sorted({w for words in STOP_WORDS.values() for w in words.split()})
    parts = docs.withColumns({
        "__words": words_of(body),
        "__lines": F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
    })
    words, lines = F.col("__words"), F.col("__lines")
    return parts.withColumns({
        "n_words": _count(words),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(body, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_letters": F.length(F.regexp_replace(body, r"[^\p{L}]+", "")).cast("long"),
        "n_latin": F.length(F.regexp_replace(body, r"[^\p{IsLatin}]+", "")).cast("long"),
        "n_stop_words": _count(F.filter(words, lambda w: F.lower(w).isin(stop))),
        "n_lines": _count(lines),
        "n_dup_lines": _count(lines) - _count(F.array_distinct(lines)),
        "n_bullet_lines": _count(F.filter(lines, lambda x: x.rlike(r"^\s*[-*•]"))),
        "n_ellipsis_lines": _count(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)\s*$"))),
        "n_repeat_words": repeated_words(words),
    }).drop("__words", "__lines")


def verdicts(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(row, measures, base_failed, kept, failed_rules); ``row`` is the input."""
    rows = measured(docs.select(F.struct(*docs.columns).alias("row"), F.col("text")))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    failed = F.array_compact(F.array(*[F.when(~r.holds(), F.lit(r.name)) for r in rules]))
    return (
        rows.drop("text")
        .withColumns({"base_failed": base, "failed_rules": F.concat_ws(",", failed)})
        .withColumn("kept", ~F.col("base_failed") & (F.col("failed_rules") == ""))
    )


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that pass, with their columns as they are. They are taken
    out by a generator: a filter would be pushed below the projection and
    evaluate the measures once more for each rule that names them."""
    passed = verdicts(docs, rules).select(F.explode(F.when(F.col("kept"), F.array("row"))).alias("row"))
    return passed.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op3(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return verdicts(docs).select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules"
    )


def _oracle() -> str:
    stop = ", ".join("'" + w + "'" for w in sorted({w for words in STOP_WORDS.values() for w in words.split()}))
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + 7], ' ')) AS k
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM d WHERE len(ws) >= 8)),
rep AS (
  SELECT doc_id, count(DISTINCT i + j) AS n
  FROM (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1), range(0, 8) r(j) GROUP BY doc_id),
line AS (SELECT doc_id, l FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines,
         count(*) FILTER (regexp_matches(l, '^\s*[-*•]')) AS bullets, count(*) FILTER (regexp_matches(l, '(\.\.\.|…)\s*$')) AS dots
  FROM line GROUP BY doc_id),
stop AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS w FROM d) WHERE lower(w) IN ({stop}) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
         length(regexp_replace(t, '[^\p{{L}}]+', '', 'g')) AS n_letters,
         length(regexp_replace(t, '[^\p{{Latin}}]+', '', 'g')) AS n_latin, coalesce(stop.n, 0) AS n_stop, coalesce(n_lines, 0) AS n_lines,
         coalesce(bullets, 0) AS bullets, coalesce(dots, 0) AS dots
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN lines USING (doc_id) LEFT JOIN stop USING (doc_id)),
f AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    concat_ws(',', CASE WHEN 100 * word_chars NOT BETWEEN 250 * n_words AND 1200 * n_words THEN 'word_length' END,
      CASE WHEN 100 * n_symbols > 10 * n_words THEN 'symbols' END, CASE WHEN 100 * n_letters < 75 * word_chars THEN 'letters' END,
      CASE WHEN 100 * n_stop < 3 * n_words AND 100 * n_latin >= 50 * n_letters THEN 'stop_words' END, CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 'duplicate_lines' END,
      CASE WHEN 100 * bullets > 90 * n_lines THEN 'bullet_lines' END, CASE WHEN 100 * dots > 30 * n_lines THEN 'ellipsis_lines' END) AS failed_rules
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed_rules = '' AS kept, failed_rules FROM f
"""


ORACLE = _oracle()

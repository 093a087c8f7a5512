"""Quality rules: a threshold table, compiled into one Spark projection without user functions."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quietkey.llm.common import WORD, free_name, table, text_or_empty


class Rule(NamedTuple):
    """``least <= 100 * count / of <= most``; None leaves a side open, ``of`` None means 1/100."""

    name: str
    count: str
    of: str | None
    least: int | None
    most: int | None


#: One line each; counts are fields of ``measures``. The first two are the contract's.
RULES = (
    Rule("words", "n_words", None, 50, None),
    Rule("repeated_words", "n_repeat_words", "n_words", None, 50),
    Rule("word_length", "word_chars", "n_words", 200, 1500),
    Rule("symbols", "n_symbols", "n_words", None, 10),
    Rule("stop_words", "n_stop_words", None, 2, None),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 30),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", None, 90),
    Rule("cut_lines", "n_cut_lines", "n_lines", None, 30),
)
BASE = ("words", "repeated_words")

#: Common words of the languages served; each counts in lower and in title case.
STOP_WORDS = (
    "the", "and", "of", "to", "in", "is", "that", "with", "for", "was", "on", "are", "it", "as", "be",
    "der", "die", "das", "und", "ist", "den", "von", "zu", "mit", "ein", "eine", "für", "auf", "nicht",
    "le", "la", "les", "de", "et", "des", "un", "une", "est", "que", "dans", "pour", "qui", "du",
    "el", "los", "las", "y", "en", "por", "con", "una", "para", "del", "se", "no", "lo",
)


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeated_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more.

    Windows are compared by a 64-bit hash. Texts without a repeated window, nearly all, stop
    at one distinct; the others sort hashes with their places and look at neighbours.
    """
    size = F.size(words)
    starts = F.when(size > 2, F.sequence(F.lit(0), size - 3)).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def covered(ordered: Column) -> Column:
        again = F.filter(ordered, lambda e, k: (e["h"] == F.get(ordered, k - 1)["h"]).eqNullSafe(True) | (e["h"] == F.get(ordered, k + 1)["h"]).eqNullSafe(True))
        places = F.flatten(F.transform(again, lambda e: F.array(e["i"], e["i"] + 1, e["i"] + 2)))
        return F.size(F.array_distinct(places))

    placed = lambda h: F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    return _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(_let(placed(h), covered)))


def _measures(text: Column, words: Column, lines: Column) -> dict[str, Column]:
    stop = F.array(*(F.lit(x) for w in STOP_WORDS for x in (w, w.title())))
    of = {
        "n_words": F.size(words),
        "word_chars": F.length(F.array_join(words, "")),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": _repeated_words(words),
        "n_stop_words": F.size(F.array_intersect(words, stop)),
        "n_lines": F.size(lines),
        "n_bullet_lines": F.size(F.filter(lines, lambda x: x.rlike(r"^[\x20\x09]*[-*•]"))),
        "n_cut_lines": F.size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))),
    }
    return {k: v.cast("long").alias(k) for k, v in of.items()}


def _passes(rule: Rule, m: Column) -> Column:
    count = m[rule.count] * (1 if rule.of is None else 100)
    of = F.lit(1) if rule.of is None else m[rule.of]
    held = F.lit(True)
    if rule.least is not None:
        held &= count >= rule.least * of
    if rule.most is not None:
        held &= count <= rule.most * of
    return held


def judge_quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", out: str = "quality") -> DataFrame:
    """``docs`` with one struct ``out``: all counts, ``failed`` (names of rules), base_failed, kept.

    A null text counts as empty, has no words and fails. Everything is judged within its row:
    order, ties and repeated rows don't matter, an empty table gives an empty result, other
    columns stay; a column named like ``out`` is replaced. No shuffle.
    """
    body = text_or_empty(text)
    words = F.regexp_extract_all(body, F.lit(WORD), 0)
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(WORD))

    def verdict(m: Column) -> Column:
        passed = {r.name: _passes(r, m) for r in rules}
        both = lambda names: reduce(lambda a, b: a & b, [passed[n] for n in names], F.lit(True))
        failed = F.filter(F.array(*(F.when(~c, F.lit(n)) for n, c in passed.items())), lambda x: x.isNotNull())
        fields = [m[k].alias(k) for k in _measures(body, words, lines)]
        return F.struct(*fields, failed.alias("failed"), (~both([n for n in BASE if n in passed])).alias("base_failed"), both(passed).alias("kept"))

    measured = _let(F.struct(body.alias("t"), words.alias("w"), lines.alias("l")), lambda x: F.struct(*_measures(x["t"], x["w"], x["l"]).values()))
    return docs.withColumn(out, _let(measured, verdict))


def keep_quality(docs: DataFrame) -> DataFrame:
    """Documents that pass every rule, with their own columns."""
    out = free_name(docs, "quality")
    return judge_quality(docs, out=out).where(F.col(f"{out}.kept")).drop(out)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judged.select("doc_id", *(F.col(f"quality.{n}").alias(n) for n in names))


def _sql_rule(rule: Rule) -> str:
    count, of = (rule.count, "1") if rule.of is None else (f"100 * {rule.count}", rule.of)
    sides = [f"{count} {sign} {bound} * {of}" for sign, bound in ((">=", rule.least), ("<=", rule.most)) if bound is not None]
    return " AND ".join(sides)


def sql(docs: str = "documents") -> str:
    """DuckDB: counts and verdicts of ``docs`` as ``judged(rid, doc_id, ..., kept)``; a list of WITH parts."""
    stop = ", ".join(f"'{x}'" for w in STOP_WORDS for x in (w, w.title()))
    return rf"""
rows AS (SELECT row_number() OVER () AS rid, * FROM {docs}),
split AS (
  SELECT rid, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS l
  FROM rows),
wins AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS win
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM split WHERE len(w) > 2)),
again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM wins) WHERE n > 1),
reps AS (SELECT rid, count(DISTINCT i + k) AS n FROM again, (VALUES (0), (1), (2)) AS o(k) GROUP BY rid),
counts AS (
  SELECT rid, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
    coalesce(n, 0) AS n_repeat_words, len(list_filter(list_distinct(w), lambda x: x IN ({stop}))) AS n_stop_words,
    len(l) AS n_lines, len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09]*[-*•]'))) AS n_bullet_lines,
    len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_cut_lines
  FROM split LEFT JOIN reps USING (rid)),
judged AS (
  SELECT *, NOT ({" AND ".join(_sql_rule(r) for r in RULES if r.name in BASE)}) AS base_failed,
    ({" AND ".join(map(_sql_rule, RULES))}) AS kept
  FROM counts JOIN rows USING (rid))"""


SQL = f"""WITH {sql()}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged"""

"""Quality rules as a short-circuit cascade (DataFrame functions only).

A rule is a condition over measures of a text. Measuring is what costs, so measures belong to the cascade: a
rule's measures are taken just before the rule, from texts that no earlier rule has rejected; a
rejected document's text is NULL from there on, and measuring a NULL costs nothing.

Rules stand in order of rejections per cost. Both are estimated on a sample of about `SAMPLE_ROWS` rows
that is drawn by hashes of the rows before anything is measured: the selectivity as the share of its rows
that the rule rejects, the cost as the characters its measures have to read there, by stated unit costs. So the order depends
on the sample alone and repeats. It changes how long the work takes, never the verdict.

Defined results: a NULL text has no words, and so fails the rule on length; empty texts and
repeated rows are judged like any other; an empty table gives an empty result; NULLs in
other columns do not matter. `quality_rules` replaces input columns that have the names of its
figures; `regular` returns the given columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areastats.llm.common import split_words

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Rows, about, of the sample on which costs and selectivities are estimated.
SAMPLE_ROWS = 2000


@dataclass(frozen=True)
class Rule:
    """`rejects` is an SQL condition over the measures of the groups it `needs`; NULL means it passes."""

    name: str
    rejects: str
    cost: float = 0.0
    selectivity: float = 0.0
    needs: tuple[str, ...] = ()

    @property
    def gain(self) -> float:
        return self.selectivity / max(self.cost, 1e-9)


#: The two rules that the contract of the query fixes.
BASE = (
    Rule("too_few_words", "n_words < 50", needs=("words",)),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words", needs=("words", "repeats")),
)
#: Thresholds far from clean prose of any language with letters.
FURTHER = (
    Rule("symbols", "10 * n_symbols > 3 * n_words", needs=("words", "symbols")),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words", needs=("words",)),
    Rule("repeated_lines", "100 * n_dup_lines > 50 * n_lines", needs=("lines",)),
    Rule("shouting", "5 * n_upper > 3 * n_letters", needs=("letters",)),
    Rule("no_letters", "2 * n_digits > word_chars", needs=("words", "digits")),
)
#: Nanoseconds a character that each group of measures takes (local[8], texts of 1.5 kB).
UNIT_COST = {"words": 90.0, "symbols": 25.0, "lines": 20.0, "letters": 95.0, "digits": 20.0, "repeats": 120.0}
#: Groups whose measures the contract asks for, whatever the verdict.
ALWAYS = ("words", "symbols", "lines", "repeats")


def group_steps(group: str, text: str) -> list[dict[str, Column]]:
    """The columns of a group of measures of the text column `text`, step by step.

    Windows of three words that occur twice are found within the row: only texts whose
    hashed windows are not all distinct have them sorted, with their places, so that
    equal windows are neighbours. The cost is n log n in the words of a text.
    """
    body = F.col(text)
    get = lambda arr, i: F.get(F.col(arr), i)
    count = lambda pattern: F.coalesce(F.regexp_count(body, F.lit(pattern)), F.lit(0)).cast("long")
    if group == "words":
        return [
            {"_words": split_words(body)},
            {"n_words": F.size("_words").cast("long"), "word_chars": F.length(F.array_join("_words", "")).cast("long")},
        ]
    if group == "symbols":
        return [{"n_symbols": count("[#*$%&|<>]")}]
    if group == "letters":
        # Runs are taken out at once: counting letters one by one costs three times as much.
        left = lambda pattern: F.length(F.regexp_replace(body, pattern, "")).cast("long")
        size = F.length(body).cast("long")
        return [{"n_upper": F.coalesce(size - left("[A-Z]+"), F.lit(0)), "n_letters": F.coalesce(size - left("[A-Za-z]+"), F.lit(0))}]
    if group == "digits":
        return [{"n_digits": count("[0-9]")}]
    if group == "lines":
        found = F.filter(F.split(F.coalesce(body, F.lit("")), "\n", -1), lambda x: F.length(F.trim(x, F.lit(" \t\x0b\x0c\r"))) > 0)
        distinct = F.size(F.array_distinct("_lines"))
        return [{"_lines": found}, {"n_lines": F.size("_lines").cast("long"), "n_dup_lines": (F.size("_lines") - distinct).cast("long")}]
    words = F.when(body.isNotNull(), F.col("_words"))  # those of the group `words`, which comes before
    windows = F.transform("_spoken", lambda w, i: F.xxhash64(w, get("_spoken", i + 1), get("_spoken", i + 2)))
    twice = lambda e, k: (
        e["h"].eqNullSafe(F.get(F.col("_sorted"), k - 1)["h"]) | e["h"].eqNullSafe(F.get(F.col("_sorted"), k + 1)["h"])
    )
    covered = F.transform("_starts", lambda p, k: F.least(F.lit(3), F.coalesce(get("_starts", k + 1) - p, F.lit(3))))
    return [
        {"_spoken": words},
        {"_windows": F.when(F.size("_spoken") >= 3, F.slice(windows, F.lit(1), F.size("_spoken") - 2))},
        {
            "_sorted": F.when(
                F.size(F.array_distinct("_windows")) < F.size("_windows"),
                F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
            )
        },
        {"_starts": F.sort_array(F.transform(F.filter("_sorted", twice), lambda e: e["i"]))},
        {"n_repeat_words": F.coalesce(F.aggregate(covered, F.lit(0), lambda s, x: s + x), F.lit(0)).cast("long")},
    ]


def measured(rows: DataFrame, group: str, text: str) -> DataFrame:
    """Add a group's measures; helping columns go, but for the words, which `repeats` needs."""
    helpers = [c for step in group_steps(group, text) for c in step if c.startswith("_") and c != "_words"]
    for step in group_steps(group, text):
        rows = rows.withColumns(step)
    return rows.drop(*helpers)


def wrapped(docs: DataFrame, text: str) -> DataFrame:
    """The given row as one struct, so that none of its columns can clash, and its text."""
    return docs.select(F.struct(*docs.columns).alias("_doc"), F.coalesce(F.col(text), F.lit("")).alias("_text"))


def estimate(docs: DataFrame, rules: Sequence[Rule], text: str = "text") -> list[Rule]:
    """Each rule with its cost (nanoseconds a row, of all its measures) and its selectivity, on a sample of the rows."""
    n = docs.count()
    place = F.xxhash64(F.monotonically_increasing_id(), F.col("_text"))
    sample = wrapped(docs, text).select("_text").where(F.pmod(place, F.lit(max(1, n // SAMPLE_ROWS))) == 0)
    for group in dict.fromkeys(g for rule in rules for g in rule.needs):
        sample = measured(sample, group, "_text")
    share = [F.avg(F.coalesce(F.expr(rule.rejects), F.lit(False)).cast("int")).alias(f"s{i}") for i, rule in enumerate(rules)]
    row = sample.agg(F.avg(F.length("_text")).alias("chars"), *share).first()
    chars = row.chars or 0.0
    return [
        replace(rule, cost=chars * sum(UNIT_COST[g] for g in rule.needs), selectivity=row[f"s{i}"] or 0.0) for i, rule in enumerate(rules)
    ]


def order(rules: Sequence[Rule]) -> list[Rule]:
    return sorted(rules, key=lambda r: (-r.gain, r.name))


def cascade(docs: DataFrame, rules: Sequence[Rule], text: str = "text", always: Sequence[str] = ()) -> DataFrame:
    """(_doc, measures, rejected_by, kept): `rejected_by` is the first rule in the given order that rejects the row.

    Groups of `always` are measured on every text; other measures only where the cascade gets to them.
    """
    rows = wrapped(docs, text).withColumn("rejected_by", F.lit(None).cast("string"))
    taken = set()
    for group in always:
        rows = measured(rows, group, "_text")
        taken.add(group)
    for rule in rules:
        rows = rows.withColumn("_live", F.when(F.col("rejected_by").isNull(), F.col("_text")))
        for group in rule.needs:
            if group not in taken:
                rows = measured(rows, group, "_live")
                taken.add(group)
        hit = F.when(F.col("rejected_by").isNull() & F.expr(rule.rejects), F.lit(rule.name))
        rows = rows.withColumn("rejected_by", F.coalesce("rejected_by", hit))
    # A filter on `kept` must not be pushed below the measures: Spark would write their nested
    # expressions into it, each as often as it is used. A row number stops that.
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    return rows.withColumn("kept", F.col("rejected_by").isNull() & (F.col("_row") >= 0)).drop("_row", "_live", "_text", "_words")


def quality_rules(
    docs: DataFrame, text: str = "text", base: Sequence[Rule] = BASE, further: Sequence[Rule] = FURTHER
) -> DataFrame:
    """Documents with all measures, `base_failed`, `rejected_by` (first rule of the cascade) and `kept`."""
    judged = cascade(docs, order(estimate(docs, [*base, *further], text)), text, ALWAYS)
    failed = " OR ".join(f"({r.rejects})" for r in base) or "false"
    figures = [*MEASURES, F.expr(failed).alias("base_failed"), "rejected_by", "kept"]
    own = {*MEASURES, "base_failed", "rejected_by", "kept"}
    return judged.select(*[F.col("_doc").getField(c).alias(c) for c in docs.columns if c not in own], *figures)


def regular(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = (*BASE, *FURTHER)) -> DataFrame:
    """The documents that no rule rejects, with the given columns; nothing is measured that the verdict can do without."""
    judged = cascade(docs, order(estimate(docs, rules, text)), text)
    return judged.where("kept").select(*[F.col("_doc").getField(c).alias(c) for c in docs.columns])


def query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality_rules(docs).select("doc_id", *MEASURES, "base_failed", "kept")


_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
ORACLE = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS words FROM documents),
p AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)
), twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS c FROM p) WHERE c > 1),
covered AS (
  SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS j FROM twice) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), m AS (
  SELECT doc_id, text, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) AS upper, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS letters,
    length(regexp_replace(text, '[^0-9]', '', 'g')) AS digits
  FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)
), v AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > 3 * n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words
    OR 100 * n_dup_lines > 50 * n_lines OR 5 * upper > 3 * letters OR 2 * digits > word_chars) AS kept
FROM v
"""

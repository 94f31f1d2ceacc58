"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

Each rule has a name and a rejecting condition. ``order_rules`` measures on a sample of bounded size what each condition costs and
which rows it rejects, and puts first the rule with most rejections per second, then the one with most rejections per second
among the rows that are left, and so on. The cascade asks the rules in that order, as one CASE WHEN, so a later
(dearer, or seldom rejecting) condition runs only on rows that all earlier ones let pass. The order changes the
cost and the name of the first failed rule, never whether a row is kept.

A cost is the time of one task that evaluates the condition many times over the sample, less the time of the same task with no
condition, so that scheduling, reading and code generation don't count.

Defined cases: null and empty texts have no words and fail the base rule; rows are judged one by one, so ties and
repeated rows are judged alike; further columns are kept, and those named like the added ones are replaced; an empty table
gives an empty result and leaves the rules in the given order.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import SPACES, let, table, text_or_empty

SYMBOLS = "#*$%&|<>"
BLANKS = r"[\x20\x09-\x0D]+"
NOT_BLANK = r"[^\x20\x09-\x0D]"


class Rule(NamedTuple):
    name: str
    rejects: Column


def words(text: Column) -> Column:
    """Maximal runs of characters other than space, tab, LF, VT, FF and CR."""
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def symbol_count(text: Column, symbols: str = SYMBOLS) -> Column:
    return F.length(text) - F.length(F.translate(text, symbols, ""))


def repeated_words(tokens: Column) -> Column:
    """Words inside 3-word windows that occur at least twice in the text, the first occurrence included.

    The windows' hashes are sorted with their positions, so the work is n log n in the words of one text.
    """

    def covered(keyed: Column) -> Column:
        last = F.size(keyed) - 1
        twin = lambda x, k: ((k > 0) & (F.get(keyed, k - 1)["h"] == x["h"])) | ((k < last) & (F.get(keyed, k + 1)["h"] == x["h"]))
        places = F.sort_array(F.filter(F.transform(keyed, lambda x, k: F.when(twin(x, k), x["i"]).otherwise(-1)), lambda i: i >= 0))
        start = F.struct(F.lit(-3).alias("at"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(places, start, lambda a, i: F.struct(i.alias("at"), (a["n"] + F.least(F.lit(3), i - a["at"])).alias("n")), lambda a: a["n"])

    def count(hashes: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(0), F.size(hashes) - 3), lambda i: F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1), F.get(hashes, i + 2)))
        keyed = lambda g: F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(let(keyed(g), covered)))

    return F.when(F.size(tokens) < 4, F.lit(0).cast("long")).otherwise(let(F.transform(tokens, lambda w: F.xxhash64(w)), count))


def repeated_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def measures(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (all long) of the whole text."""
    t = text_or_empty(text)
    tokens = "__words"
    while tokens in df.columns:
        tokens += "_"
    df = df.withColumn(tokens, words(t))
    return df.withColumns({
        "n_words": F.size(tokens).cast("long"),
        "word_chars": F.length(F.translate(t, SPACES, "")).cast("long"),
        "n_symbols": symbol_count(t).cast("long"),
        "n_dup_lines": repeated_lines(t).cast("long"),
        "n_repeat_words": repeated_words(F.col(tokens)),
    }).drop(tokens)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def default_rules(text: str = "text") -> list[Rule]:
    """Conditions in whole numbers, over the measures and, for the dearer ones, over the text itself."""
    n, t = F.col("n_words"), text_or_empty(text)
    return [
        Rule("word_length", (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 15 * n)),
        Rule("symbols", 10 * F.col("n_symbols") > n),
        Rule("dup_lines", 3 * F.col("n_dup_lines") > F.size(F.split(t, "\n"))),
        Rule("shouting", 10 * symbol_count(t, "!") > n),
        Rule("capitals", 2 * (F.length(t) - F.length(F.regexp_replace(t, r"\p{Lu}", ""))) > F.col("word_chars")),
    ]


def ranked(costs: list[float], met: list[tuple[int, tuple[bool, ...]]]) -> list[int]:
    """The order of rules by falling rejections per cost among the rows left. met: (rows, what each rule says of them)."""
    order, todo = [], list(range(len(costs)))
    while todo:
        gain = {k: sum(n for n, x in met if x[k]) / max(costs[k], 1e-9) for k in todo}
        best = max(todo, key=lambda k: (gain[k], -k))
        order.append(best)
        todo.remove(best)
        met = [(n, x) for n, x in met if not x[best]]
    return order


def drawn(df: DataFrame, share: float, seed: int) -> DataFrame:
    """A sample in one partition, drawn by as many tasks as df has parts."""
    return df.sample(min(1.0, share), seed=seed).repartition(1)


def order_rules(df: DataFrame, rules: list[Rule], prepare: Callable[[DataFrame], DataFrame] = lambda df: df, sample_rows: int = 2000, times: int = 25, seed: int = 7) -> list[Rule]:
    """The rules by falling rejections per second among the rows that earlier ones let pass, measured on about sample_rows rows of df.

    prepare adds what the rules need, to the sampled rows alone. Rows are drawn where they lie; what is drawn is sent to one partition, so a measurement is one
    task. One row for each combination of the rules' verdicts comes to the driver.
    """
    n = df.count()
    if not n or not rules:
        return rules
    sample = prepare(drawn(df, sample_rows / n, seed)).persist()
    try:
        verdicts = sample.groupBy(*[F.coalesce(r.rejects, F.lit(False)).alias(f"r{k}") for k, r in enumerate(rules)]).count().collect()
        if not verdicts:
            return rules
        often = sample.select("*", F.explode(F.sequence(F.lit(1), F.lit(times))).alias("__time"))

        def seconds(test: Column) -> float:
            best = None
            for _ in range(3):  # the first pays for code generation
                began = time.perf_counter()
                often.agg(F.count_if(test)).first()
                took = time.perf_counter() - began
                best = took if best is None else min(best, took)
            return best

        none = seconds(F.col("__time") < 0)
        costs = [max(seconds(r.rejects) - none, 1e-4) for r in rules]
    finally:
        sample.unpersist()
    return [rules[k] for k in ranked(costs, [(r["count"], tuple(r)[:-1]) for r in verdicts])]


def cascade(df: DataFrame, rules: list[Rule], failed: str = "failed_rule") -> DataFrame:
    """Adds the name of the first rule, in the given order, that rejects the row; null where none does."""
    chain = None
    for rule in rules:
        chain = F.when(rule.rejects, rule.name) if chain is None else chain.when(rule.rejects, rule.name)
    return df.withColumn(failed, F.lit(None).cast("string") if chain is None else chain)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = order_rules(docs, default_rules(), measures)
    judged = cascade(measures(docs).withColumn("base_failed", base_failed()), [Rule("base", F.col("base_failed")), *rules])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("failed_rule").isNull().alias("kept"))


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), l AS (
  SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d
), g AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d WHERE len(ws) >= 4)
), r AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n >= 2
), c AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM r, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id
), m AS (
  SELECT d.doc_id, d.text, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(d.text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(d.text) - length(regexp_replace(d.text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM d JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 10 * n_symbols > n_words
    OR 3 * n_dup_lines > len(string_split(text, chr(10)))
    OR 10 * (length(text) - length(replace(text, '!', ''))) > n_words
    OR 2 * (length(text) - length(regexp_replace(text, '\p{Lu}', '', 'g'))) > word_chars) AS kept
FROM b
"""

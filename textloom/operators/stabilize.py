"""Stabilisation of cleaned documents (MSR-05, MSR-16, MSR-17, MSR-21, SEG-03, SEG-04, SEG-07, SEG-08, FLT-13, FLT-14, AGG-08, JON-03, PIP-02)."""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.measures import hits, readiness
from textloom.functions.text import base_key, let, word_key
from textloom.operators.dedupe import canonical, with_shingles
from textloom.operators.segment import packs, paragraphs
from textloom.sources.scratch import bounded_batches, stored

# How a tail begins, what a reference and a chapter look like, what forms and theory speak of.
PUBLISHER = "подписано в печать|тираж|isbn|удк|ббк|отпечатано|copyright|©"
BIBLIOGRAPHY = "список литературы|литература|references|bibliography"
CONTENTS = r"оглавление|содержание|contents|глава\s+\d.+глава\s+\d"
REFERENCES = r"\b(?:19|20)\d{2}\b|isbn|doi|[A-ZА-ЯЁ][a-zа-яё]+,\s*[A-ZА-ЯЁ]\."
CHAPTER = r"глава\s+\d"
FORM_MARKERS = {"card": "карта", "questionnaire": "опросник", "survey": "анкета", "fill": "заполнить", "complaints": "жалобы", "exam": "обследован", "objective": "объективн", "status": "статус", "sfzh": "сфж", "blank_slots": " c "}
THEORY = ["терап", "клинич", "объясн", "пример"]
TAIL = 25_000


def paragraph_stats(t: Column) -> Column:
    """MSR-05: struct of paragraphs, average (characters of the text / paragraphs), longest, large."""

    def stats(lengths: Column) -> Column:
        n = F.size(lengths)
        return F.struct(n.alias("paragraphs"), F.round(F.length(t) / F.greatest(n, F.lit(1)), 1).alias("average"), F.coalesce(F.array_max(lengths), F.lit(0)).alias("longest"), ((n <= 2) & (F.length(t) > 10_000)).alias("large"))

    return let(F.transform(paragraphs(t), lambda p: F.length(p)), stats)


def source_quality(t: Column, large: Column) -> Column:
    """MSR-16."""
    runs = F.regexp_count(F.substring(t, 1, 100_000), F.lit("[=_|]{4,}"))
    s = 1.0 - F.when(large, 0.25).otherwise(0.0) - F.when(F.lower(F.substring(t, 1, 100)).contains("ocr.raw"), 0.05).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.0), s - F.least(F.lit(0.2), F.regexp_count(t, F.lit("�")) * 0.01) - F.least(F.lit(0.15), runs * 0.01)), 3)


def form_score(t: Column, name: Column, markers: dict[str, str] = FORM_MARKERS, theory: list[str] = THEORY) -> Column:
    """MSR-17: struct of score and reasons."""

    def scored(low: Column, found: Column) -> Column:
        colons = F.regexp_count(low, F.lit(":")) / F.greatest(F.length(low) / 1000, F.lit(1.0))
        s = F.least(F.lit(1.0), F.size(found) * 0.12 + F.least(F.regexp_count(low, F.lit("[?]")), F.lit(12)) * 0.015 + F.least(colons, F.lit(10.0)) * 0.02)
        s = s - F.when((F.length(t) > 20_000) & (hits(low, theory) >= 8), 0.25).otherwise(0.0)
        return F.struct(F.greatest(F.lit(0.0), F.round(s, 2)).alias("score"), found.alias("reasons"))

    reasons = lambda low: F.array_compact(F.array(*[F.when(low.contains(m), F.lit(k)) for k, m in markers.items()]))
    low = F.concat(F.lower(name), F.lit("\n"), F.lower(F.substring(t, 1, 30_000)))
    return let(low, lambda low: let(reasons(low), lambda found: scored(low, found)))


def tail_cut(t: Column) -> Column:
    """SEG-08: struct of removed (characters) and reason; the earliest of three beginnings of a tail in the last 25,000 characters."""
    start = F.greatest(F.lit(0), F.length(t) - TAIL)
    tail = F.substring(t, start + 1, F.lit(TAIL))
    # a look at the first letter, which is one of few, saves trying all alternatives at each place
    at = lambda tail, pattern: F.regexp_instr(tail, F.lit(f"(?ius)(?=[{''.join(sorted({p[0] for p in pattern.split('|')}))}])(?:{pattern})"))

    def found(tail: Column) -> Column:
        places = F.struct(*[at(tail, p).alias(k) for k, p in (("publisher", PUBLISHER), ("bibliography", BIBLIOGRAPHY), ("contents", CONTENTS))])

        def first(x: Column) -> Column:
            behind = lambda place, count: F.regexp_count(F.substring(tail, place, F.lit(TAIL)), F.lit(f"(?iu){count}"))
            far = lambda place, share: (place > 0) & (place - 1 > F.length(tail) * share)
            cases = [("publisher", far(x["publisher"], 0.45), "publisher_tail"), ("bibliography", far(x["bibliography"], 0.35) & (behind(x["bibliography"], REFERENCES) >= 4), "bibliography_tail"), ("contents", far(x["contents"], 0.4) & (behind(x["contents"], CHAPTER) >= 3), "trailing_toc")]
            return F.array_min(F.array_compact(F.array(*[F.when(test, F.struct(x[name].alias("at"), F.lit(k).alias("n"), F.lit(reason).alias("reason"))) for k, (name, test, reason) in enumerate(cases)])))

        return let(places, first)

    def cut(first: Column) -> Column:
        removed = F.length(t) - start - first["at"] + 1
        return F.when(removed >= 300, F.struct(removed.cast("int").alias("removed"), first["reason"].alias("reason"))).otherwise(F.struct(F.lit(0).alias("removed"), F.lit("").alias("reason")))

    return let(let(tail, found), cut)


def logical_category(score: Column, chars: Column) -> Column:
    """FLT-14."""
    return F.when((score >= 0.42) & (chars < 80_000), "form_card").otherwise("explanatory_narrative")


def retrieval_weight(category: Column, tail: Column, restored: Column) -> Column:
    """MSR-21."""
    return F.when(category == "form_card", 0.0).when(tail | restored, 1.05).otherwise(1.0)


def exclusion(path: Column, duplicate_status: Column) -> Column:
    """FLT-13: why a document gets no chunks; empty if it gets some."""
    return F.when(F.array_contains(F.split(path, "/"), "forms"), "forms_folder_excluded").when(duplicate_status == "duplicate_candidate", "duplicate_candidate").otherwise("")


def runs_from(parts: list[str], opens: Callable[[str], object]) -> list[list[str]]:
    """Parts, cut before each one that opens a run."""
    number = list(itertools.accumulate(bool(opens(p)) for p in parts))
    return [[p for _, p in g] for _, g in itertools.groupby(zip(number, parts), lambda x: x[0])]


def restored(text: str, target: int = 1400, longest: int = 2400) -> tuple[str, int]:
    """SEG-07: (text with paragraphs of over ``longest`` characters cut at headings, then packed from sentences, splits)."""
    parts = [p.strip() for p in re.split(r"\n\s*\n", text) if p.strip()]
    out: list[str] = []
    splits = 0
    for part in parts:
        pieces = [part] if len(part) <= longest else [p.strip() for p in re.split(r"(?i)(?=(?:глава|chapter|part|section|раздел|часть)\s+\d{1,3}[.:]?\s+)", part) if p.strip()]
        for piece in pieces:
            if len(piece) <= longest:
                out.append(piece)
                continue
            sentences = [s for s in map(str.strip, re.split(r"(?<=[.!?])\s+(?=[A-ZА-ЯЁ])", piece)) if s]
            packed = [" ".join(own) for run in runs_from(sentences, lambda s: re.match(r"\d{1,2}\.\s+[A-ZА-ЯЁ]", s)) for own in packs(run, lambda s: len(s) + 1, target + 1)]
            out += packed
            splits += len(packed) - 1
    return "\n\n".join(out), splits + max(0, len(out) - len(parts))


def is_heading(t: str) -> bool:
    """FLT-01 for one paragraph."""
    letters = sum(c.isalpha() for c in t)
    return 0 < len(t) <= 140 and bool(re.match(r"(?i)(?:chapter|part|section|глава|часть|раздел)\b|\d{1,2}(?:\.\d{1,2}){0,3}\.?\s+\S+", t) or (letters >= 4 and t == t.upper()))


def block_paragraphs(text: str, longest: int = 2600, target: int = 1800) -> list[str]:
    """SEG-03: paragraphs; those of over ``longest`` characters as lines packed to ``target``, anew at each heading or numbered line."""
    out: list[str] = []
    for part in re.split(r"\n\s*\n", text):
        value = re.sub(r"[ \t]+", " ", part).strip()
        lines = [x for x in map(str.strip, value.splitlines()) if x]
        if len(value) <= longest or len(lines) <= 1:
            out += [value] if value else []
        else:
            opens = lambda x: is_heading(x) or re.match(r"\d{1,3}[).:]\s+\S+", x)
            out += ["\n".join(own) for run in runs_from(lines, opens) for own in packs(run, lambda x: len(x) + 1, target + 1)]
    return out


def build_blocks(text: str, most: int = 2200) -> list[tuple[str | None, str]]:
    """SEG-04: (heading, text) of each block; a heading opens a block, and goes for those behind it."""
    return [(run[0] if is_heading(run[0]) else None, "\n\n".join(own)) for run in runs_from(block_paragraphs(text), is_heading) for own in packs(run, len, most)]


def with_blocks(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """SEG-04 as rows: (key, block_index, heading, text)."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(d, k, h, t) for d, whole in zip(b[key], b[text]) for k, (h, t) in enumerate(build_blocks(whole or ""))], columns=[key, "block_index", "heading", text])

    return bounded_batches(df.select(key, text)).mapInPandas(cut, f"{key} {df.schema[key].dataType.simpleString()}, block_index int, heading string, {text} string")


def same_base_duplicates(df: DataFrame, key: str, text: str, name: str, threshold: float = 0.8) -> DataFrame:
    """JON-08, JON-10, WIN-05: (key, duplicate_of, similarity): each variant of a file against the best one, by Jaccard of five-word shingles or an equal fingerprint.

    The best has the highest quality, isn't raw, is longest, and has the smallest key. No variant meets any other than the best.
    """
    t = F.col(text)
    large = F.when(F.length(t) > 10_000, paragraph_stats(t)["large"]).otherwise(False)
    d = df.select(key, name, base_key(F.col(name)).alias("__base"), F.length(t).alias("__n"), source_quality(t, large).alias("__q"))
    best = stored(canonical(d, "__base", -F.col("__q"), F.col(name).contains("ocr.raw"), -F.col("__n"), F.col(key)).select("__base", key, "canonical"), "variants")
    first = best.filter("canonical").select("__base", F.col(key).alias("duplicate_of"))
    pairs = stored(best.filter("not canonical").join(first, "__base").select(key, "duplicate_of"), "variant-pairs")
    # only texts that are a variant, or have one, are cut to shingles
    met = pairs.select(key).unionByName(pairs.select(F.col("duplicate_of").alias(key))).distinct()
    mark = F.sha1(F.substring(word_key(t), 1, 200_000)).alias("mark")
    sets = stored(with_shingles(df.select(key, text).join(met, key, "left_semi"), text).select(key, mark, "g"), "variant-sets")
    pairs = pairs.join(sets, key).join(sets.select(F.col(key).alias("duplicate_of"), F.col("g").alias("g2"), F.col("mark").alias("mark2")), "duplicate_of")

    def similarity(shared: Column) -> Column:
        return F.coalesce(shared / F.nullif(F.size("g") + F.size("g2") - shared, F.lit(0)), F.lit(0.0))

    pairs = pairs.select(key, "duplicate_of", let(F.size(F.array_intersect("g", "g2")), similarity).alias("similarity"), (F.col("mark") == F.col("mark2")).alias("same"))
    return stored(pairs, "same-base").filter((F.col("similarity") >= threshold) | F.col("same")).drop("same")


def stabilized(df: DataFrame, key: str = "doc_id", text: str = "text", name: str = "filename") -> DataFrame:
    """PIP-02: a row for each document: its plan, scores and stabilised text."""

    def mend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [restored(t) if large else (t, 0) for t, large in zip(b[text], b["large"])]
            yield b.assign(__new=[x[0] for x in found], restore_splits=[x[1] for x in found])

    t, new = F.col(text), F.col("__new")
    d = df.select(key, name, F.coalesce(t, F.lit("")).alias(text)).withColumn("before", paragraph_stats(t)).withColumn("large", F.col("before.large"))
    d = bounded_batches(d).mapInPandas(mend, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in d.schema.fields)}, __new string, restore_splits int")
    d = d.withColumn("tail", tail_cut(new)).withColumn("__new", F.when(F.col("tail.removed") > 0, F.rtrim(F.substring(new, F.lit(1), F.length(new) - F.col("tail.removed")))).otherwise(new))
    d = d.withColumn("form", form_score(new, F.col(name))).withColumn("logical_category", logical_category(F.col("form.score"), F.length(new))).withColumn("after", paragraph_stats(new))
    d = d.join(same_base_duplicates(df, key, text, name), key, "left").withColumn("duplicate_status", F.when(F.col("duplicate_of").isNotNull(), "duplicate_candidate").otherwise("canonical_or_unique"))
    dup, form = F.col("duplicate_of").isNotNull(), F.col("logical_category") == "form_card"
    scores = {"readiness_before": F.round(readiness(F.col("before.large"), F.col("before.average"), F.lit(False), dup, form), 2), "readiness_after": F.round(readiness(F.col("after.large"), F.col("after.average"), F.col("tail.removed") > 0, dup, form), 2)}
    return d.select(key, name, F.length(text).alias("chars_before"), F.length(new).alias("chars_after"), "restore_splits", F.col("tail.removed").alias("tail_removed"), F.col("tail.reason").alias("tail_reason"), "logical_category", F.col("form.score").alias("form_score"), F.col("form.reasons").alias("form_reasons"), "duplicate_status", "duplicate_of", "similarity", *[c.alias(k) for k, c in scores.items()], F.concat(F.when(form, "cleaned_corpus/forms/").otherwise("cleaned_corpus/good/"), name).alias("planned_output"), retrieval_weight(F.col("logical_category"), F.col("tail.removed") > 0, F.col("restore_splits") > 0).alias("retrieval_weight"), new.alias("stabilized_text"))


def summary(rows: DataFrame) -> DataFrame:
    """AGG-08: one row."""
    return rows.agg(F.count("*").alias("files"), F.count_if(F.col("restore_splits") > 0).alias("restores"), F.count_if(F.col("duplicate_status") == "duplicate_candidate").alias("duplicates"), F.count_if(F.col("logical_category") == "form_card").alias("forms"), F.count_if(F.col("tail_removed") > 0).alias("tails"), F.sum("chars_before").alias("chars_before"), F.sum("chars_after").alias("chars_after"), F.round(F.avg("readiness_before"), 3).alias("readiness_before"), F.round(F.avg("readiness_after"), 3).alias("readiness_after"))

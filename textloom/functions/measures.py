"""Scalar measures and rule ladders as column expressions (MSR-*, FLT-*)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.text import count_chars, let

# The letters that the measures count, as what stands in the brackets of a class.
LATIN, CYRILLIC = "A-Za-z", "А-Яа-яЁё"
LETTERS = LATIN + CYRILLIC
# Mojibake of Cyrillic read as Latin-1, in intake and in cleaning; its single marks; runs of punctuation.
MOJIBAKE = "[РС][А-Яа-яA-Za-z]{1,3}"
LONG_MOJIBAKE = "[РС][\u0400-\u04FFA-Za-z]{2,}"
MOJIBAKE_MARKS = "[РСЃЊЉЌЋЏЂ™њќў]|вЂ"
PUNCTUATION_RUN = r"[._\-–—=]{6,}"
SEVERE = ("low_semantic_density", "corrupted_ocr_or_mojibake")


def tokens_by_words(t: Column) -> Column:
    """MSR-01: the larger of words and characters / 4.2, rounded half to even."""
    return F.greatest(F.regexp_count(t, F.lit(r"\S+")), F.rint(F.greatest(F.length(t), F.lit(1)) / 4.2)).cast("long")


def tokens_by_chars(t: Column) -> Column:
    """MSR-02."""
    return F.ceil(F.length(t) / 4).cast("long")


def embedding_cost(tokens: Column, per_million: float = 0.02) -> Column:
    """MSR-03."""
    return F.round(tokens / 1e6 * per_million, 8)


def script_language(t: Column, chars: int = 20_000) -> Column:
    """MSR-04."""
    t = F.substring(t, 1, chars)
    cyr, lat = count_chars(t, CYRILLIC), count_chars(t, LATIN)
    return F.when((cyr < 20) & (lat < 20), "unknown").when(cyr > 2 * lat, "ru").when(lat > 2 * cyr, "en").otherwise("mixed")


def line_share(t: Column, pattern: str) -> Column:
    """MSR-06: share of the non-blank lines that match."""
    return line_shares(t, pattern)[0]


def line_shares(t: Column, *patterns: str) -> Column:
    """MSR-06 for some patterns, as an array: the lines are split once."""
    lines = F.filter(F.split(t, "\n"), lambda x: F.trim(x) != "")
    share = lambda lines, pattern: F.size(F.filter(lines, lambda x: _matches(x, pattern))) / F.greatest(F.size(lines), F.lit(1))
    return let(lines, lambda lines: F.array(*[share(lines, p) for p in patterns]))


# Line forms that the ladders count.
NUMBERED = r"^\s*(?:\d{1,3}[).:]|[a-zA-Zа-яА-Я][).:])\s+\S+"
# .{3,120} in front of the white space says no more than .{3}, but is tried 118 times at each place.
CONTENTS = r".{3}\s+\.{2,}\s*\d{1,4}\s*$"
REFERENCE = r"(?:^|[^0-9A-Za-z_])(?:19|20)\d{2}(?:[^0-9A-Za-z_].*)?[.,].{8,}"


#: What every match of a pattern holds one of: a plain search for it spares most lines the pattern.
HOLDS = {CONTENTS: ("..",), REFERENCE: ("19", "20")}


def _matches(line: Column, pattern: str) -> Column:
    held = [line.contains(x) for x in HOLDS.get(pattern, ())]
    return reduce(lambda a, b: a | b, held) & line.rlike(pattern) if held else line.rlike(pattern)


def block_noise(t: Column) -> Column:
    """MSR-07."""
    t = F.substring(t, 1, 4000)
    n = F.greatest(F.length(t), F.lit(1))
    # four and more in a row that are none of these, which become one blank for each run
    strange = F.regexp_count(F.regexp_replace(t, r"[\p{L}\p{N}\s.,;:!?()\-]+", " "), F.lit("[^ ]{4,}"))
    return F.least(F.lit(1.0), (1 - count_chars(t, r"\p{L}") / n) * 0.65 + F.regexp_count(t, F.lit("�")) * 0.02 + strange * 0.03)


def document_noise(t: Column) -> Column:
    """MSR-08."""
    t = F.substring(t, 1, 50_000)
    n = F.greatest(F.length(t), F.lit(1))
    lines = F.filter(F.split(t, "\n"), lambda x: F.trim(x) != "")
    short = let(lines, lambda lines: F.size(F.filter(lines, lambda x: F.length(F.trim(x)) <= 3)) / F.greatest(F.size(lines), F.lit(1)))
    letters = count_chars(t, LETTERS)
    return (1 - letters / n) * 0.6 + short * 0.4 + F.least(F.lit(0.4), F.regexp_count(t, F.lit("�")) / n * 10)


def hits(t: Column, patterns: list[str]) -> Column:
    """MSR-11: matches of a lexicon family."""
    return reduce(lambda a, b: a + b, [F.regexp_count(t, F.lit(p)) for p in patterns], F.lit(0))


def theory_score(t: Column, patterns: list[str]) -> Column:
    """MSR-09."""
    per_k = hits(t, patterns) * 1000.0 / F.greatest(F.length(t), F.lit(1))
    average = F.length(t) / F.greatest(F.regexp_count(t, F.lit("[.!?]+")), F.lit(1))
    return F.least(F.lit(1.0), per_k / 4 + F.when(average.between(55, 260), 0.12).otherwise(0.0))


def intake_signals(t: Column) -> Column:
    """MSR-12."""
    n = F.length(t)
    long_words = F.size(F.filter(F.split(t, r"\s+"), lambda w: F.length(w) > 45))
    signal = lambda test, name: F.when(test, F.lit(name))
    found = F.array_compact(F.array(
        signal(F.regexp_count(t, F.lit("�")) > 5, "replacement_characters"),
        signal(F.regexp_count(t, F.lit(MOJIBAKE)) > 30, "possible_mojibake"),
        signal(count_chars(t, r"\s") / n > 0.45, "excessive_whitespace"),
        signal(count_chars(t, LETTERS) / n < 0.35, "low_alpha_ratio"),
        signal(long_words > 5, "many_overlong_tokens"),
        signal(n < 300, "very_short_text"),
    ))
    return F.when(n == 0, F.array(F.lit("empty_text"))).otherwise(found)


def intake_score(n: Column, signals: Column, status: Column | None = None) -> Column:
    """MSR-14."""
    s = 1.0 - F.when(n < 1000, 0.25).otherwise(0.0) - F.when(n < 300, 0.25).otherwise(0.0) - 0.12 * F.size(signals)
    s = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)), 2)
    return s if status is None else F.when(status.isin("unsupported", "ocr_required", "url_pending"), 0.0).otherwise(s)


def extraction_status(kind: Column, ext: Column, t: Column) -> Column:
    """FLT-11 and SRC-07."""
    return (
        F.when(kind == "url", "url_pending")
        .when(~ext.isin("txt", "md", "markdown", "csv", "docx", "pdf") & (kind != "text"), "unsupported")
        .when((ext == "pdf") & (F.length(F.trim(t)) < 500), "ocr_required")
        .when(F.trim(t) == "", "needs_review")
        .otherwise("extracted")
    )


def intake_action(status: Column, score: Column, duplicate: Column) -> Column:
    """FLT-10."""
    return (
        F.when(status == "ocr_required", "send_to_ocr")
        .when(status == "url_pending", "fetch_url_or_manual_review")
        .when(status == "unsupported", "reject_or_convert_manually")
        .when(duplicate == "high", "review_duplicate_before_cleaning")
        .when(score >= 0.65, "ready_for_cleaning")
        .otherwise("needs_review")
    )


def final_status(status: Column, score: Column, duplicate: Column) -> Column:
    """FLT-10: an item's status behind its processing."""
    return F.when(status.isin("ocr_required", "url_pending", "unsupported"), status).when((duplicate == "high") | (score < 0.65), "needs_review").otherwise("ready_for_cleaning")


def cleaner_signals(t: Column, families: dict[str, list[str]]) -> Column:
    """MSR-13: numeric signals and one for each lexicon family that is met, in fixed order."""
    n = F.length(t)
    keys = F.transform(F.split(t, "\n"), lambda x: F.trim(x))
    repeated = let(keys, lambda keys: F.size(keys) - F.size(F.array_distinct(keys)) > 5)
    signal = lambda test, name: F.when(test, F.lit(name))

    def signals(m: Column) -> Column:
        alpha, moji, marks = m["alpha"], m["moji"], m["marks"]
        cyr = count_chars(t, CYRILLIC)
        return F.array_compact(F.array(
            signal(n < 300, "ultra_short_fragments"),
            signal((n > 0) & (alpha / F.greatest(n, F.lit(1)) < 0.35), "low_semantic_density"),
            signal((moji > 15) | (marks > 40) | ((moji > 6) & (cyr / F.greatest(alpha, F.lit(1)) > 0.5)), "corrupted_ocr_or_mojibake"),
            signal(F.regexp_count(t, F.lit("�")) > 5, "broken_symbols"),
            signal(F.regexp_count(t, F.lit(PUNCTUATION_RUN)) > 3, "repeated_patterns"),
            signal(repeated, "repeated_lines"),
            *[signal(t.rlike("|".join(p)), name) for name, p in families.items()],
        ))

    counts = F.struct(count_chars(t, LETTERS).alias("alpha"), F.regexp_count(t, F.lit(LONG_MOJIBAKE)).alias("moji"), F.regexp_count(t, F.lit(MOJIBAKE_MARKS)).alias("marks"))
    return let(counts, signals)


def cleaner_score(t: Column, signals: Column) -> Column:
    """MSR-15; 0 for blank texts."""
    n = F.length(t)
    severe = F.size(F.array_intersect(signals, F.array(*map(F.lit, SEVERE))))
    s = 100 - F.when(n < 1000, 15).otherwise(0) - F.when(n < 300, 35).otherwise(0) - 35 * severe - 12 * (F.size(signals) - severe)
    return F.when(~t.rlike(r"\S"), 0).otherwise(F.greatest(F.lit(0), s))


def quality_label(score: Column, signals: Column) -> Column:
    return F.when((score < 35) | F.array_contains(signals, "corrupted_ocr_or_mojibake"), "REJECT").when(score < 55, "LOW").when(score < 80, "MEDIUM").otherwise("HIGH")


def cleaner_action(label: Column) -> Column:
    """MSR-15: what follows from the label."""
    return F.when(label == "REJECT", "reject").when(label == "HIGH", "keep").otherwise("manual_review")


def readiness(large: Column, average: Column, tail: Column, duplicate: Column, form: Column) -> Column:
    """MSR-18."""
    s = 1.0 - F.when(large, 0.35).otherwise(0.0) - F.when(average > 2400, 0.18).otherwise(0.0) + F.when(tail, 0.04).otherwise(0.0) - F.when(duplicate, 0.25).otherwise(0.0) - F.when(form, 0.2).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), s))


def overlap(a: Column, b: Column) -> Column:
    """MSR-23, SET-03: shared words of four letters and more, as a share of the smaller set."""
    words = lambda t: F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit("([A-Za-zА-Яа-яЁё]{4,})"), F.lit(1)))
    x, y = words(a), words(b)
    return F.coalesce(F.size(F.array_intersect(x, y)) / F.nullif(F.least(F.size(x), F.size(y)), F.lit(0)), F.lit(0.0))


def diagnostics(t: Column) -> Column:
    """MSR-22, as a struct."""
    n = F.greatest(F.length(t), F.lit(1))
    count = lambda p: F.regexp_count(t, F.lit(p))
    words = F.regexp_count(t, F.lit(r"\S+"))
    cyr, lat = count_chars(t, CYRILLIC), count_chars(t, LATIN)
    letters = F.when(cyr + lat == 0, 1).otherwise(cyr + lat)
    moji = count("(?:Р[а-яА-ЯЁёA-Z]?|С[а-яА-ЯЁёA-Z]?|вЂ|В«|В»|В©|В®)")
    runs = F.filter(F.regexp_extract_all(t, F.lit(r"([^\p{L}\p{N}\s.,;:!?()\"«»\-—№%/]{4,})"), F.lit(1)), lambda x: ~x.rlike("^=+$"))
    pages = count(r"===== PAGE \d+ / \d+ =====")
    digits = count_chars(t, r"\d") / n
    return F.struct(
        words.alias("words"), F.length(t).alias("chars"), (cyr / letters).alias("cyrillic"), (lat / letters).alias("latin"), digits.alias("digits"), F.size(runs).alias("runs"),
        ((count("�") > 0) | (moji > 10) | (cyr / letters < 0.35)).alias("encoding"), ((F.size(runs) > 0) | (digits > 0.18) | (pages > 4)).alias("ocr"), ((words < 80) | (words > 650)).alias("size"),
    )


def normalised(v: Column) -> Column:
    """MSR-28."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / F.when(norm == 0, 1.0).otherwise(norm))


def dot(a: Column, b: Column) -> Column:
    """MSR-29 over normalised vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def is_heading(line: Column) -> Column:
    """FLT-01."""
    t = F.regexp_replace(line, r"^\s+|\s+$", "")
    named = t.rlike(r"(?iu)^(?:chapter|part|section|глава|часть|раздел)(?![\p{L}\p{N}_])|^\d{1,2}(?:\.\d{1,2}){0,3}\.?\s+\S+")
    return F.length(t).between(1, 140) & (named | ((t == F.upper(t)) & (F.regexp_count(t, F.lit(r"\p{L}")) >= 4)))


def paragraph_label(p: Column) -> Column:
    """FLT-02."""
    t = F.trim(p)
    return (
        F.when((F.length(t) <= 140) & t.rlike(r"(?iu)^(?:глава|раздел|часть|chapter|section)\s+\d+"), "heading")
        .when((F.length(t) <= 120) & (t == F.upper(t)) & (F.regexp_count(t, F.lit("[A-Za-zА-Яа-яЁё]")) >= 5), "heading")
        .when(t.rlike(r"^(?:\d+[).:]|[-*])\s+\S+"), "list_like")
        .when(F.lower(t).rlike("например|пример|случай|пациент|клиент"), "example_or_clinical")
        .otherwise("narrative")
    )


def block_ladder(m: dict[str, Column]) -> Column:
    """FLT-06 over measured columns: a struct of label, action and confidence; the first row that holds wins."""
    rows = [
        ((m["dup"] >= 4) & (m["theory"] < 0.35), "reject_duplicate_paragraph", "reject", 0.86),
        ((m["noise"] >= 0.72) & (m["chars"] < 1200) & (m["theory"] < 0.25), "reject_ocr_noise", "reject", 0.82),
        (((m["tocw"] >= 1) & (m["toc"] >= 0.25)) | (m["toc"] >= 0.45) | ((m["chap"] >= 3) & (m["chars"] < 3500)), "reject_toc", "reject", 0.88),
        ((m["bib"] >= 2) & ((m["ref"] >= 0.35) | (m["bib"] * 1000 >= 5 * m["chars"])) & (m["theory"] < 0.45), "reject_bibliography", "reject", 0.86),
        ((m["quest"] >= 2) & (m["num"] >= 0.22) & (m["theory"] < 0.5), "reject_questionnaire", "reject", 0.84),
        ((m["test"] >= 4) & (m["num"] >= 0.2) & (m["theory"] < 0.5), "reject_test", "reject", 0.83),
        (m["scoring"] & ((m["num"] >= 0.12) | (m["quest"] >= 1) | (m["test"] >= 4)) & (m["theory"] < 0.45), "reject_scoring_key", "reject", 0.80),
        ((m["exer"] >= 3) & (m["num"] >= 0.12) & m["instr"] & ~m["clinical"] & (m["theory"] < 0.5), "reject_exercise", "reject", 0.78),
        (m["theory"] >= 0.55, "keep_theory", "keep", 0.82),
        ((m["theory"] >= 0.35) & (m["chars"] >= 450), "keep_clinical", "keep", 0.72),
        ((m["chars"] >= 650) & (m["num"] < 0.25) & (m["noise"] < 0.6), "keep_narrative", "keep", 0.68),
        (F.lit(True), "review_unclear", "keep", 0.56),
    ]
    out = None
    for test, label, action, sure in rows:
        value = F.struct(F.lit(label).alias("label"), F.lit(action).alias("action"), F.lit(sure).alias("confidence"))
        out = F.when(test, value) if out is None else out.when(test, value)
    return out


def category_ladder(m: dict[str, Column]) -> Column:
    """FLT-07 over measured columns, for sources without a file name or size: a struct of category and confidence."""
    rows = [
        (m["duplicate"], "duplicate", F.lit(0.98)),
        ((m["chars"] > 2000) & (m["noise"] >= 0.56) & (m["theory"] < 5), "ocr_noise", 0.75 + F.least(m["noise"] - 0.56, F.lit(0.2))),
        ((m["bib"] >= 8) & ((m["chars"] < 25_000) | (m["bibd"] >= 7) | (m["theory"] < 8)), "bibliography", F.least(F.lit(0.95), 0.65 + m["bib"] / 100)),
        ((m["quest"] >= 2) | ((m["quest"] >= 1) & (m["numbered"] >= 8)), "questionnaire", F.least(F.lit(0.96), 0.66 + m["quest"] / 30 + F.least(m["numbered"], F.lit(30)) / 100)),
        ((m["test"] >= 4) | ((m["test"] >= 2) & (m["numbered"] >= 10)), "test", F.least(F.lit(0.95), 0.62 + m["test"] / 40 + F.least(m["numbered"], F.lit(40)) / 120)),
        ((m["exer"] >= 4) | ((m["exer"] >= 2) & (m["numbered"] >= 6)), "exercise", F.least(F.lit(0.9), 0.6 + m["exer"] / 40)),
        ((m["chars"] >= 8000) & (m["theory"] >= 8), "good_source", F.least(F.lit(0.9), 0.62 + m["theory"] / 100)),
        ((m["chars"] >= 1500) & ((m["article"] >= 1) | (m["theory"] >= 4)), "article", F.least(F.lit(0.84), 0.58 + (m["article"] + m["theory"]) / 80)),
        (F.lit(True), "unclear", F.lit(0.5)),
    ]
    out = None
    for test, name, sure in rows:
        value = F.struct(F.lit(name).alias("category"), sure.cast("double").alias("confidence"))
        out = F.when(test, value) if out is None else out.when(test, value)
    return out

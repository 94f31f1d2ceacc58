"""Text normalisation as column expressions (NRM-*). Patterns are Java's, without look-around where SQL must agree."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Lines that navigation leaves behind.
NAVIGATION = r"(?iu)^\s*(?:\d+|page\s+\d+(?:\s+of\s+\d+)?|стр\.?\s*\d+|страница\s+\d+|оглавление|содержание|www\.\S+|https?://\S+)\s*$|^\s*(?:copyright|all rights reserved)(?:[^\p{L}\p{N}_]|$)"
# Lines that only mark a page.
PAGE_MARKER = r"(?iu)^\s*(?:\d{1,4}|[ivxlcdm]{1,8}|=+\s*page\s+\d+\s*/\s*\d+\s*=+|(?:page|стр\.?|страница)\s*\d+)\s*$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def count_chars(t: Column, chars: str) -> Column:
    """How many characters belong to a class, given as what stands between its brackets: what their runs take away, so there is no string for each.

    A class that says what is not in it is five times as slow here as one that says what is.
    """
    return F.length(t) - F.length(F.regexp_replace(t, f"[{chars}]+", ""))


def clean_spaces(t: Column) -> Column:
    """NRM-01: line ends, invisible characters, runs of blanks and of newlines."""
    t = F.regexp_replace(t, r"\r\n?", "\n")
    # a blank that stands alone is left as it is
    t = F.translate(F.regexp_replace(t, "[﻿­​]", ""), " ", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]{2,}|\t", " "), r"\n{4,}", "\n\n\n")
    return F.regexp_replace(t, r"^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$", "")


@F.pandas_udf(T.StringType())
def nfkc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """NRM-02, first half: NFKC, which no built-in function has."""
    for b in batches:
        yield b.str.normalize("NFKC")


def strip_junk(t: Column) -> Column:
    """NRM-02, second half: geometric shapes and control characters to spaces."""
    return F.regexp_replace(F.regexp_replace(t, "[﻿­]", ""), "[■-◿�\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", " ")


def tidy(t: Column) -> Column:
    """NRM-03."""
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]{2,}|\t", " "), r" +\n", "\n")
    return F.trim(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def join_hyphens(t: Column) -> Column:
    """NRM-04."""
    return F.regexp_replace(t, r"(\p{L})-\n(\p{L})", "$1$2")


def clean_artifacts(t: Column, preserve_paragraphs: bool = False) -> Column:
    """NRM-05. As specified, runs of any white space become one space, which also joins paragraphs; the flag keeps them."""
    t = F.regexp_replace(F.regexp_replace(t, r"[~|]{3,}|_{4,}", " "), r"\.{5,}", " ... ")
    t = F.regexp_replace(t, r"[ \t]+([,.;:!?])", "$1")
    return F.trim(F.regexp_replace(t, r"[ \t]{2,}" if preserve_paragraphs else r"\s{2,}", " "))


def is_page_marker(line: Column) -> Column:
    """NRM-06."""
    return line.rlike(PAGE_MARKER)


def drop_page_markers(t: Column) -> tuple[Column, Column]:
    """NRM-07: (text, lines dropped)."""
    x = page_markers_dropped(t)
    return x["text"], x["dropped"]


def page_markers_dropped(t: Column) -> Column:
    """NRM-07: struct of text and dropped, the number of lines dropped."""
    kept = lambda lines: F.filter(lines, lambda x: ~is_page_marker(x))
    return let(F.split(t, "\n"), lambda lines: let(kept(lines), lambda kept: F.struct(F.array_join(kept, "\n").alias("text"), (F.size(lines) - F.size(kept)).alias("dropped"))))


def mend_lines(t: Column) -> Column:
    """NRM-09: lines that a page's width broke."""
    t = F.regexp_replace(t, r"[ \t]*\n[ \t]*", "\n")
    t = F.regexp_replace(t, r"-\n(?=\p{Ll})", "")
    return F.regexp_replace(t, r"\n(?=\p{Ll})(?<![.!?;:)\n]\n)", " ")


def is_navigation(line: Column) -> Column:
    """NRM-11."""
    return line.rlike(NAVIGATION)


def hash_key(t: Column) -> Column:
    """NRM-13."""
    return F.trim(F.lower(F.regexp_replace(t, r"\s+", " ")))


def word_key(t: Column) -> Column:
    """NRM-14."""
    return F.trim(F.regexp_replace(F.lower(t), r"(?U)\W+", " "))


def letter_key(t: Column) -> Column:
    """NRM-15."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(t), r"[^\p{L}\p{N}\s]+", ""), r"\s+", " "))


def preview(t: Column, n: int = 360) -> Column:
    """NRM-16."""
    return F.substring(F.trim(F.regexp_replace(t, r"\s+", " ")), 1, n)


def shorten(t: Column, n: int = 650) -> Column:
    """NRM-17."""
    return F.when(F.length(t) > n, F.concat(F.rtrim(F.substring(t, 1, n)), F.lit("..."))).otherwise(t)


def file_name(t: Column) -> Column:
    """NRM-18."""
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(t, r'[<>:"/\\|?*\x00-\x1f]', "_"), 1, 120), F.lit("")), F.lit("file"))


# Endings of the variants of a file.
VARIANTS = (".ocr.raw.cleaned.txt", ".ocr.cleaned.cleaned.txt", ".cleaned.cleaned.txt", ".cleaned.txt")


def base_key(name: Column, suffixes: tuple[str, ...] = VARIANTS) -> Column:
    """NRM-19: the name without the ending of a file's variant, longest first; other names without their extension."""
    ends = "|".join(s.replace(".", r"\.") for s in sorted(suffixes, key=len, reverse=True))
    return F.regexp_replace(name, rf"(?<=.)(?:{ends}|\.[^.]*)$", "")


def cut_at_word(t: Column, limit: int) -> Column:
    """NRM-21, second form: after the last full stop up to the limit if that lies beyond 40 % of it, else at the last space, with a full stop."""
    head = F.substring(t, 1, limit + 1)
    stop = F.length(head) - F.instr(F.reverse(head), ".")
    space = F.length(head) - F.instr(F.reverse(head), " ")
    at_space = F.when(F.instr(head, " ") > 0, F.substring(t, F.lit(1), space)).otherwise(F.substring(t, 1, limit))
    return F.when(F.length(t) <= limit, t).when((F.instr(head, ".") > 0) & (stop > 0.4 * limit), F.substring(t, F.lit(1), stop + 1)).otherwise(F.concat(at_space, F.lit(".")))


def is_url(t: Column) -> Column:
    """NRM-20."""
    return F.trim(t).rlike(r"(?i)^https?://\S+$")


def cut_at_sentence(t: Column, limit: int = 1024, floor: int = 500) -> Column:
    """NRM-21, first form."""
    head = F.substring(t, 1, limit - 3)
    last = F.length(head) - F.instr(F.reverse(head), ".")
    return F.when(F.length(t) <= limit, t).when((F.instr(head, ".") > 0) & (last > floor), F.substring(t, F.lit(1), last + 1)).otherwise(F.concat(head, F.lit("...")))


def plain(t: Column) -> Column:
    """NRM-22."""
    return F.trim(F.translate(t, "*_", ""))

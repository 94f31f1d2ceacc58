"""Web pages as a source (SRC-16, EXT-01..05)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.sources.scratch import bounded_batches


def without_tags(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html, r"<[^>]*>", " "), r"\s+", " "))


def title(html: Column) -> Column:
    """EXT-01, EXT-04: the first h1."""
    return without_tags(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1))


# Which elements hold a page's text, and which never have a closing tag.
CONTAINER_TAG, CONTAINER_CLASSES = "article", {"article_text", "text", "content"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

#: A comment, a script or style as a whole, a tag, or text.
PARTS = re.compile(r"""<!--.*?(?:-->|$)|<(script|style)\b.*?(?:</\1\s*>|$)|<(/?)([a-z][a-z0-9-]*)((?:"[^"]*"|'[^']*'|[^>"'])*)>|<!?[^<>]*>|([^<]+|<)""", re.I | re.S)
CLASSES = re.compile(r"""\bclass\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)


def container_texts(html: str) -> list[str]:
    """The text of each container of a page, in the order of their beginnings; tags count as blanks, comments, scripts and styles as nothing.

    A stack of open elements says where a container ends, so one within another ends at its own tag, and its text
    is said in both. A closing tag closes what was left open within its element; one that closes nothing is ignored.
    """
    found: list[list[str]] = []
    stack: list[tuple[str, list[str] | None]] = []
    for m in PARTS.finditer(html):
        _, closing, name, rest, text = m.groups()
        if text:
            for _, own in stack:
                if own is not None:
                    own.append(text)
            continue
        for _, own in stack:
            if own is not None:
                own.append(" ")
        if not name:
            continue
        name = name.lower()
        if closing:
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if depth is not None:
                del stack[depth:]
        elif name not in VOID and not rest.rstrip().endswith("/"):
            c = CLASSES.search(rest)
            own = [] if name == CONTAINER_TAG or (c and CONTAINER_CLASSES & set((c[1] or c[2] or c[3] or "").split())) else None
            if own is not None:
                found.append(own)
            stack.append((name, own))
    return ["".join(own) for own in found]


@F.pandas_udf(T.StringType())
def _containers(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for b in batches:
        yield b.map(lambda t: " ".join(container_texts(t)))


def main_text(html: Column) -> Column:
    """EXT-02: what the articles and content containers say, in order."""
    return F.trim(F.regexp_replace(_containers(html), r"\s+", " "))


def description(html: Column) -> Column:
    """EXT-04: the first paragraph."""
    return without_tags(F.regexp_extract(html, r"(?is)<p\b[^>]*>(.*?)</p>", 1))


def links(df: DataFrame, key: str = "page_id", html: str = "html", prefix: str = "/", base: str = "https://example.org") -> DataFrame:
    """EXT-03, SET-02: distinct absolute links of a page that start with prefix."""
    found = F.array_distinct(F.filter(F.regexp_extract_all(html, F.lit(r'(?i)<a[^>]+href="([^"]*)"'), F.lit(1)), lambda x: x.startswith(prefix)))
    return df.select(key, F.explode(found).alias("__h")).select(key, F.concat(F.lit(base), "__h").alias("link"))


def articles(df: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """EXT-05: pages without a title or a text carry an error and stay."""
    out = bounded_batches(df).select(key, title(F.coalesce(html, F.lit(""))).alias("title"), main_text(F.coalesce(html, F.lit(""))).alias("text"))
    return out.withColumn("error", F.when(F.col("title") == "", "no_title").when(F.col("text") == "", "no_text"))

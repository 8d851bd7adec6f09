"""Tokens, documents and line handling of code text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of Unicode, as a whitespace split of text knows it.
SPACE = r"[\s\x1c-\x1f\x85   -     　]"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
EMBED_CHARS, CHARS_PER_TOKEN = 6000, 4


def tokenize(text: Column) -> Column:
    """Lower-cased whitespace-separated tokens; punctuation stays on them."""
    return F.filter(F.split(F.lower(text), SPACE + "+"), lambda t: t != "")


def estimate_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / CHARS_PER_TOKEN).cast("int")


def document(name: Column, summary: Column, source: Column, max_chars: int | None = None) -> Column:
    """What is searched and embedded of a node: its name, summary and source, cut to ``max_chars``; the part
    before the source is never cut."""
    head = F.concat(name, F.lit("\n\nSummary: "), F.coalesce(summary, F.lit("")), F.lit("\n\n"))
    body = F.coalesce(source, F.lit(""))
    if max_chars is None:
        return F.concat(head, body)
    return F.concat(head, F.substring(body, F.lit(1), F.greatest(F.lit(0), F.lit(max_chars) - F.length(head))))


def first_lines(text: Column, count: int) -> Column:
    """The first lines, joined by newlines; every Unicode line end counts, and a last one opens no line."""
    lines = F.split(F.coalesce(text, F.lit("")), LINE_END)
    lines = F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)
    return F.array_join(F.slice(lines, 1, count), "\n")


def trim_end(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+$", "")

"""Matches with offsets in code points, and folds over lines. Each runs in Arrow batches, in one pass over a text."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.text import PAGE, col



def _rows(**fields: T.DataType) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(k, v) for k, v in fields.items()]))


INT, STRING = T.IntegerType(), T.StringType()
BOUNDS = _rows(start=INT, end=INT)
SPAN = _rows(start=INT, end=INT, match=STRING, g1=STRING)
PAGE_SPAN = _rows(page=INT, start=INT, end=INT)
ALIGNED = T.StructType([T.StructField("text", STRING), T.StructField("spans", _rows(norm_start=INT, norm_end=INT, raw_start=INT, raw_end=INT))])


def regex_spans(text: Column | str, pattern: str) -> Column:
    """All matches of a Python pattern: start, end, match and the first group (null without one)."""

    @F.pandas_udf(SPAN)
    def find(s: pd.Series) -> pd.Series:
        p = re.compile(pattern)
        return s.map(lambda t: None if t is None else [{"start": m.start(), "end": m.end(), "match": m[0], "g1": m[1] if p.groups else None} for m in p.finditer(t)])

    return find(col(text))


@F.pandas_udf(SPAN)
def line_spans(s: pd.Series) -> pd.Series:
    """The lines of a text, ends without the newline."""

    def lines(t):
        out, at = [], 0
        for part in t.split("\n"):
            out.append({"start": at, "end": at + len(part), "match": part, "g1": None})
            at += len(part) + 1
        return out

    return s.map(lambda t: None if t is None else lines(t))


def line_pages(text: Column | str, size: int = PAGE) -> Column:
    """Pages of whole lines, each closed by the line that brings it to `size` characters. They tile the text."""

    @F.pandas_udf(PAGE_SPAN)
    def cut(s: pd.Series) -> pd.Series:
        def pages(t):
            out, start, at = [], 0, 0
            for line in re.findall(r"[^\n]*\n|[^\n]+", t):
                at += len(line)
                if at - start >= size:
                    out.append({"page": len(out) + 1, "start": start, "end": at})
                    start = at
            if at > start:
                out.append({"page": len(out) + 1, "start": start, "end": at})
            return out

        return s.map(lambda t: None if t is None else pages(t))

    return cut(col(text))


@F.pandas_udf(T.ArrayType(STRING))
def trimmed_pages(s: pd.Series) -> pd.Series:
    """Pages for joining by form feeds: whole lines of any kind, blank pages dropped, ends trimmed."""

    def pages(t):
        out, now, n = [], [], 0
        for line in t.splitlines(keepends=True):
            now.append(line)
            n += len(line)
            if n >= PAGE:
                out.append("".join(now))
                now, n = [], 0
        return [p.rstrip() for p in [*out, "".join(now)] if p.strip()]

    return s.map(lambda t: None if t is None else pages(t))


@F.pandas_udf(BOUNDS)
def paragraph_spans(s: pd.Series) -> pd.Series:
    """Paragraphs between blank lines, of 50 characters or more; the last newline belongs to the paragraph before."""
    p = re.compile(r"[^ \t\r\n](?:[^\n]|\n(?![ \t]*\n))*\n?")
    return s.map(lambda t: None if t is None else [{"start": m.start(), "end": m.end()} for m in p.finditer(t) if m.end() - m.start() >= 50])


@F.pandas_udf(BOUNDS)
def sentence_spans(s: pd.Series) -> pd.Series:
    """Sentences: cut where white space stands between . ! ? and a capital; pieces under 3 characters are dropped."""
    edge = re.compile(r"(?<=[.!?])\s+(?=[A-Z])")

    def sentences(t):
        out, last = [], 0
        for end in [*(m.start() for m in edge.finditer(t)), len(t)]:
            if end - last >= 3:
                start = last + len(t[last:end]) - len(t[last:end].lstrip(" \t\r\n"))
                if start < end:
                    out.append({"start": start, "end": end})
            last = end
        return out

    return s.map(lambda t: None if t is None else sentences(t))


FOLDS = {"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", "…": "...", " ": " "}


@F.pandas_udf(ALIGNED)
def aligned(s: pd.Series) -> pd.DataFrame:
    """NFC text with straight quotes and words rejoined over hyphenated line ends, and where each run of it stands in the NFC raw text."""
    token = re.compile(r"-[\r\n]+[ \t]*|[" + "".join(FOLDS) + "]")

    def one(t):
        if t is None:
            return None, None
        raw = unicodedata.normalize("NFC", t)
        out, spans, n, at = [], [], 0, 0

        def put(piece: str, start: int, end: int):
            nonlocal n
            if piece:
                out.append(piece)
                spans.append({"norm_start": n, "norm_end": n + len(piece), "raw_start": start, "raw_end": end})
                n += len(piece)

        for m in token.finditer(raw):
            put(raw[at : m.start()], at, m.start())
            put(FOLDS.get(m[0], ""), m.start(), m.end())
            at = m.end()
        put(raw[at:], at, len(raw))
        return "".join(out), spans

    return pd.DataFrame([one(t) for t in s], columns=["text", "spans"])


def contains_offset(spans: Column, offset: Column, closed: bool = False) -> Column:
    """The first span that holds an offset: half-open, or closed at its end too."""
    return F.get(F.filter(spans, lambda p: (p["start"] <= offset) & ((offset <= p["end"]) if closed else (offset < p["end"]))), 0)


def page_range(pages: Column, start: Column, end: Column) -> Column:
    """struct(first, last) of the pages a span touches; null if an end is off the text."""
    a, b = contains_offset(pages, start)["page"], contains_offset(pages, F.greatest(end - 1, start))["page"]
    return F.when(a.isNotNull() & b.isNotNull(), F.struct(a.alias("first"), b.alias("last")))

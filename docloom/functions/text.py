"""Scalar functions over text, names, dates and JSON. Offsets count code points; spans are half-open from 0."""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.plans import vocab

PAGE = vocab.PAGE_CHARS


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, of) -> Column:
    """of(value) with the value computed once: inside a lambda over an array an outer expression is computed for each element."""
    return F.get(F.transform(F.array(value), of), 0)


def words(text: Column | str) -> Column:
    return F.filter(F.split(col(text), r"(?U)\s+"), lambda w: w != "")


def n_words(text: Column | str) -> Column:
    return F.size(words(text))


def squeeze(text: Column | str) -> Column:
    """Runs of Unicode white space become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(col(text), r"(?U)\s+", " "))


def strip(text: Column | str) -> Column:
    return F.regexp_replace(col(text), r"(?U)^\s+|\s+$", "")


# pages of a fixed number of characters


def estimated_pages(text: Column | str) -> Column:
    return F.when(F.length(col(text)) == 0, 0).otherwise(F.ceil(F.length(col(text)) / PAGE)).cast("int")


def first_pages(text: Column | str, n: int) -> Column:
    return F.substring(col(text), 1, n * PAGE)


def last_pages(text: Column | str, n: int) -> Column:
    return F.right(col(text), F.lit(n * PAGE))


def page_of(offset: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(offset / PAGE) + 1).cast("int")


def chars_of_pages(first: Column, last: Column, length: Column) -> Column:
    """struct(start, end) of a span of pages, within the text."""
    start = F.greatest(F.lit(0), (first - 1) * PAGE)
    end = F.greatest(F.least(length, last * PAGE), start)
    return F.when(start >= length, F.struct(length.cast("int").alias("start"), length.cast("int").alias("end"))).otherwise(F.struct(start.cast("int").alias("start"), end.cast("int").alias("end")))


def slice_of(text: Column | str, start: Column, end: Column) -> Column:
    return F.substr(col(text), start + 1, end - start)


def length_bucket(pages: Column, short: int = 200, long: int = 800) -> Column:
    return F.when(pages < short, "short").when(pages < long, "medium").otherwise("long")


def length_category(count: Column, short: int = 10_000, long: int = 60_000) -> Column:
    return F.when(count < short, "short").when(count > long, "long").otherwise("medium")


# document types


def document_type(title: Column | str, head: Column | str | None = None) -> Column:
    """The first type, in order, whose pattern the title has; else the first in the head; else Unknown."""
    out = None
    for text in (title, head):
        for label, pattern in vocab.TYPE_PATTERNS.items() if text is not None else ():
            hit = col(text).rlike("(?i)" + pattern)
            out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise("Unknown")


def cover_type(cover: Column | str) -> Column:
    """Draft, Final or Supplemental as a cover's full phrase says; else null."""
    said = F.lower(F.regexp_extract(col(cover), "(?i)" + vocab.COVER_TYPE, 1))
    return F.when(F.startswith(said, F.lit("supplemental")), "Supplemental").when(F.startswith(said, F.lit("draft")), "Draft").when(F.startswith(said, F.lit("final")), "Final")


def type_by_words(text: Column | str, most: int = 250) -> Column:
    """The one family of type words among the first words; none or several: Unlabelled."""
    head = F.array_join(F.slice(words(text), 1, most), " ")
    hits = F.array_compact(F.array(*[F.when(head.rlike("(?i)" + p), k) for k, p in vocab.TYPE_WORDS.items()]))
    return F.when(F.size(hits) == 1, F.get(hits, 0)).otherwise("Unlabelled")


# names and quotes


@F.pandas_udf(T.StringType())
def fold_accents(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)))


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def _folds() -> tuple[str, str]:
    """Letters and signs of the Latin, Greek and Cyrillic blocks that decompose to one character, and those characters."""
    pairs = []
    for i in (*range(0xA0, 0x530), *range(0x1E00, 0x2000)):
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(i)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(i):
            pairs.append((chr(i), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


FOLDED = _folds()


def entity_key(name: Column | str, exact: bool = False) -> Column:
    """A name without accents, brackets, punctuation, honorifics and articles, in lower case.

    Accents are folded by a table of letters and by dropping combining marks; exact folds all of Unicode (NFKD), in Python.
    """
    s = fold_accents(col(name)) if exact else F.regexp_replace(F.translate(col(name), *FOLDED), r"\p{Mn}", "")
    s = F.regexp_replace(F.lower(s), r"\([^)]*\)", " ")
    s = F.regexp_replace(s, r"(?U)[^\w\s]", " ")
    s = F.regexp_replace(s, rf"(?U)\b(?:{'|'.join(vocab.HONORIFICS)})\b", " ")
    return squeeze(s)


def without_role(name: Column | str) -> Column:
    return F.trim(F.regexp_replace(col(name), r"\s*\([^)]+\)\s*$", ""))


def primary_bureau(contributors: Column | str) -> Column:
    """The first contributor without its role; Unknown if there is none."""
    return F.coalesce(F.nullif(without_role(F.get(col(contributors), 0)), F.lit("")), F.lit("Unknown"))


def quoted(quote: Column, squeezed_text: Column) -> Column:
    """The quote stands in a text, up to white space. squeezed_text: squeeze() of the text, made once for many quotes."""
    q = squeeze(F.coalesce(quote, F.lit("")))
    return F.coalesce((q != "") & F.contains(squeezed_text, q), F.lit(False))


def opinion_quote(quote: Column, opinion: Column, context: Column, least: int = 8, most: int = 40) -> Column:
    """The quote, trimmed, if there is an opinion, it has the right number of words and stands in the context; else null."""
    q = strip(quote)
    return F.when((F.coalesce(opinion, F.lit("")) != "") & n_words(q).between(least, most) & F.contains(context, q), q)


def is_full_name(name: Column | str) -> Column:
    """2 to 5 words: initials, particles and at least two real name words."""
    parts = words(name)
    initial, particle, real = r"^[A-Z]\.?$", F.lit(vocab.NAME_PARTICLES), r"^[A-Z][A-Za-z'-]*[a-z][A-Za-z'-]*$"
    light = lambda w: w.rlike(initial) | F.array_contains(particle, F.lower(w))
    ok = F.forall(parts, lambda w: light(w) | w.rlike(real)) & (F.size(F.filter(parts, lambda w: ~light(w))) >= 2)
    return F.coalesce(F.size(parts).between(2, 5) & ok, F.lit(False))


def is_heading_text(text: Column | str) -> Column:
    """At least 3 words and 40 % letters, no address and no ZIP code."""
    t = strip(text)
    letters = F.length(F.regexp_replace(t, r"\P{L}", ""))
    return F.coalesce((n_words(t) >= 3) & ~t.rlike(vocab.ADDRESS_WORDS) & ~t.rlike(r"\b\d{5}(?:-\d{4})?\b") & (letters >= 0.4 * F.length(t)), F.lit(False))


def is_entity_text(name: Column | str, boilerplate: list[str]) -> Column:
    """3 characters or more; one capitalised word only as an acronym of 2 to 6; no boilerplate phrase; no bare number."""
    t = strip(name)
    lone = (n_words(t) == 1) & t.rlike(r"^\p{Lu}") & ~t.rlike("^[A-Z]{2,6}$")
    phrase = let(F.lower(t), lambda low: F.exists(F.lit(boilerplate), lambda p: F.contains(low, p))) if boilerplate else F.lit(False)
    return F.coalesce((F.length(t) >= 3) & ~lone & ~phrase & ~t.rlike(r"^[\d\s\-/,\.]+$"), F.lit(False))


def mostly_upper(text: Column | str, share: float = 0.7) -> Column:
    letters = F.length(F.regexp_replace(col(text), r"\P{L}", ""))
    upper = F.length(F.regexp_replace(col(text), r"\P{Lu}", ""))
    return F.coalesce((letters > 0) & (upper >= share * letters), F.lit(False))


MARKER = r"^(?:\s*(?:CHAPTER|Chapter|SECTION|Section)\s+[\w.]+|\s*[A-Z]\.|\s*[IVXLC]+\.|\s*\d+(?:\.\d+)?\s*[:.\-–])\s*"


def is_heading_line(line: Column | str) -> Column:
    """A short line with a chapter marker, or in capitals without a sentence's end."""
    s = strip(line)
    return F.length(s).between(1, 100) & (s.rlike(MARKER) | (~s.rlike("[.,;:]$") & mostly_upper(s)))


def chapter_of(heading: Column | str) -> Column:
    """The standard chapter whose alias opens the heading, after its marker; else null."""
    h = F.lower(strip(heading))
    for marker in (r"^(?:chapter|section)\s+[\w.]+\s*[:.\-–]?\s*", r"^[ivxlc]+\.\s*", r"^[a-z]\.\s*", r"^\d+(?:\.\d+)?\s*[:.\-–]?\s*"):
        h = F.regexp_replace(h, marker, "")
    h = strip(h)
    out = None
    for chapter, aliases in vocab.CHAPTERS.items():
        hit = h.rlike(f"^(?:{'|'.join(aliases)})(?:$|[ :])")
        out = F.when(hit, chapter) if out is None else out.when(hit, chapter)
    return out


def section_of(title: Column | str) -> Column:
    """The section a title names: by a heading pattern, else by keywords; else null."""
    t = strip(title)
    out = None
    for section, pattern in vocab.SECTION_HEADINGS.items():
        hit = t.rlike(rf"(?imd)^\s*(?:{pattern})\s*$")
        out = F.when(hit, section) if out is None else out.when(hit, section)
    for section, keys in vocab.SECTION_KEYWORDS.items():
        out = out.when(F.lower(t).rlike("|".join(re.escape(k) for k in keys)), section)
    return out


def alternative_label(label: Column | str) -> Column:
    s = squeeze(label)
    return F.when(s.rlike(r"(?i)^No[-\s]+Action$"), "No Action").when(s.rlike(r"(?i)^No[-\s]+Build$"), "No Build").when(s.rlike(r"(?i)^Status\s+Quo$"), "Status Quo").otherwise(s)


def locate_anchor(text: Column, anchor: Column) -> Column:
    """Offset of an anchor: exact, else ignoring case, else with any white space between its words; null if nowhere."""
    flexible = F.concat(F.lit(r"(?is)"), F.array_join(F.transform(words(anchor), lambda w: F.concat(F.lit(r"\Q"), w, F.lit(r"\E"))), r"\s+"))
    found = F.regexp_substr(text, flexible)
    at = lambda needle, hay: F.nullif(F.position(needle, hay), F.lit(0))
    return F.when(F.length(F.trim(anchor)) > 0, F.coalesce(at(anchor, text), at(F.lower(anchor), F.lower(text)), at(found, text)) - 1)


# years and dates


def years(text: Column | str, pattern: str = r"\b(19[6-9]\d|20[0-2]\d)\b", last: int = vocab.YEAR_LAST) -> Column:
    """array<int> of the years in a text, in order."""
    return F.filter(F.transform(F.regexp_extract_all(col(text), F.lit(pattern), F.lit(1)), lambda y: y.cast("int")), lambda y: y.between(vocab.YEAR_FIRST, last))


def top_year(found: Column, tie: str = "first") -> Column:
    """The most frequent year; of several the first found, or the latest."""
    scored = F.transform(F.array_distinct(found), lambda y, i: F.struct(F.size(F.filter(found, lambda z: z == y)).alias("n"), (-i if tie == "first" else y).alias("o"), y.alias("y")))
    return F.array_max(scored)["y"]


def weighted_year(text: Column | str, last: int = vocab.YEAR_LAST) -> Column:
    """A vote of dates (3, and 1 for the bare year inside) and bare years (1); of equals the first: dates before bare years."""
    t = col(text)
    dated = F.flatten(F.array(*[F.transform(F.regexp_extract_all(t, F.lit(p), F.lit(1)), lambda y: y.cast("int")) for p in vocab.DATES]))
    bare = F.transform(F.regexp_extract_all(t, F.lit(r"\b(\d{4})\b"), F.lit(1)), lambda y: y.cast("int"))
    votes = F.filter(F.flatten(F.array(dated, dated, dated, bare)), lambda y: y.between(vocab.YEAR_FIRST, last))
    return top_year(votes)


def year_of_dates(*fields: Column) -> Column:
    """The first 19xx or 20xx year of the first field that has one."""
    return F.coalesce(*[F.nullif(F.regexp_extract(f, r"\b(19\d{2}|20\d{2})\b", 1), F.lit("")).cast("int") for f in fields])


def parsed_date(value: Column | str) -> Column:
    """struct(year, value, precision): a day, a month or a year that the value holds; else nulls."""
    s = strip(value)
    year = F.nullif(F.regexp_extract(s, r"\b(19[7-9]\d|20\d{2})\b", 1), F.lit(""))
    day = s.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_timestamp(s, F.lit("yyyy-MM-dd")).isNotNull()
    month = s.rlike(r"^\d{4}-\d{2}$")
    parts = lambda y, v, p: F.struct(y.cast("int").alias("year"), v.alias("value"), F.lit(p).cast("string").alias("precision"))
    lead = F.try_element_at(F.split(s, "-"), F.lit(1))
    return F.when(day, parts(lead, s, "day")).when(month, parts(lead, s, "month")).when(year.isNotNull(), parts(year, year, "year")).otherwise(parts(F.lit(None), F.lit(None).cast("string"), None))


def in_year_range(year: Column, last: int = vocab.YEAR_LAST) -> Column:
    return year.isNull() | year.between(vocab.YEAR_FIRST, last)


# display and identity


def short(value: Column, n: int = 400) -> Column:
    """White space squeezed, cut to n characters with an ellipsis; null becomes empty."""
    s = squeeze(value)
    return F.coalesce(F.when(F.length(s) > n, F.concat(F.substring(s, 1, n - 1), F.lit("…"))).otherwise(s), F.lit(""))


def page_list(spans: Column) -> Column:
    return F.coalesce(F.array_join(spans, ", "), F.lit(""))


def page_map(spans: Column) -> Column:
    """A map of span lists as `name: a, b; name: c`, empty lists left out."""
    return F.array_join(F.transform(F.filter(F.map_entries(spans), lambda e: F.size(e["value"]) > 0), lambda e: F.concat(e["key"], F.lit(": "), F.array_join(e["value"], ", "))), "; ")


def distinct_pages(pages: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(pages, lambda p: F.trim(p)), lambda p: p.isNotNull() & (p != "")))


def text_id(text: Column | str) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(col(text), 256))


def token_estimate(text: Column | str) -> Column:
    return F.floor(F.length(col(text)) / 4).cast("int")


def barcode(key: Column | str) -> Column:
    """What follows the first underscore, else the whole key."""
    k = col(key)
    return F.when(F.instr(k, "_") > 0, F.substr(k, F.instr(k, "_") + 1)).otherwise(k)


def page_number(stem: Column | str) -> Column:
    s = col(stem)
    return F.coalesce(F.regexp_extract(s, r"_(\d+)$", 1).try_cast("int"), s.try_cast("int"), F.lit(0))


# JSON that models return


def without_fences(text: Column | str) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(strip(text), r"^```(?:json|JSON)?\s*", ""), r"\s*```$", ""))


def balanced_object(text: str | None) -> str | None:
    """The first {...} whose braces balance outside strings."""
    start = (text or "").find("{")
    if start < 0:
        return None
    depth, quoted, at = 0, False, start
    while at < len(text):
        c = text[at]
        if quoted:
            at += c == "\\"
            quoted = c != '"'
        elif c == '"':
            quoted = True
        elif c in "{}":
            depth += 1 if c == "{" else -1
            if not depth:
                return text[start : at + 1]
        at += 1
    return None


def salvaged_list(text: str | None, key: str = "entities") -> str | None:
    """Of a cut-off {"key": [...] the object with all complete elements; null without the list."""
    m = re.search(rf'"{re.escape(key)}"\s*:\s*\[', text or "")
    if not m:
        return None
    items, at, reader = [], m.end(), json.JSONDecoder()
    while True:
        while at < len(text) and text[at] in " \t\r\n,":
            at += 1
        if at >= len(text) or text[at] != "{":
            break
        try:
            item, at = reader.raw_decode(text, at)
        except ValueError:
            break
        items.append(item)
    return json.dumps({key: items}, ensure_ascii=False)


@F.pandas_udf(T.StringType())
def first_object(s: pd.Series) -> pd.Series:
    return s.map(balanced_object)


@F.pandas_udf(T.StringType())
def salvaged(s: pd.Series) -> pd.Series:
    return s.map(salvaged_list)


def parsed_json(text: Column | str) -> Column:
    """VARIANT of a response: as it is without fences, else its first object, else what a cut-off entity list still holds; else null."""
    clean = without_fences(text)
    return F.coalesce(F.try_parse_json(clean), F.try_parse_json(first_object(clean)), F.try_parse_json(salvaged(clean)))

"""Functions on single values: tables of input and result, with nulls, empty texts and ties."""

import pytest
from pyspark.sql import functions as F

from docloom.functions import spans as sp
from docloom.functions import text as tx


@pytest.fixture
def value(spark):
    def of(column, **inputs):
        names = list(inputs) or ["x"]
        row = tuple(inputs.values()) or (0,)
        kinds = {str: "string", int: "int", type(None): "string", bool: "boolean", float: "double"}
        schema = ", ".join(f"{n} {'array<string>' if isinstance(v, list) else kinds[type(v)]}" for n, v in zip(names, row, strict=True))
        return spark.createDataFrame([row], schema).select(column.alias("v")).first().v

    return of


@pytest.mark.parametrize(
    ("name", "key"),
    [("Dr. José Núñez (Sierra Club)", "jose nunez"), ("THE  County of Kane", "county of kane"), ("Sen. A. Smith-Jones", "smith jones"), ("", ""), (None, None), ("(only)", ""), ("hon", "")],
)
def test_entity_key(value, name, key):
    assert value(tx.entity_key("n"), n=name) == value(tx.entity_key("n", exact=True), n=name) == key


@pytest.mark.parametrize(
    ("heading", "chapter"),
    [("CHAPTER 3. AFFECTED ENVIRONMENT", "Affected Environment"), ("II. Alternatives considered", "Alternatives"), ("2.1 PURPOSE AND NEED: why", "Purpose and Need"), ("IMPACTS", "Environmental Consequences"), ("Alternativesque", None), ("", None), (None, None)],
)
def test_chapter_of(value, heading, chapter):
    assert value(tx.chapter_of("h"), h=heading) == chapter


@pytest.mark.parametrize(
    ("text", "real"),
    [("CHAPTER 2 PROPOSED ACTION", True), ("Section 4(f)", False), ("143 SOUTH THIRD STREET", False), ("2.1 Need 60601 now", False), ("1.2 3.4 5.6 7", False), ("", False), (None, False)],
)
def test_is_heading_text(value, text, real):
    assert value(tx.is_heading_text("t"), t=text) is real


@pytest.mark.parametrize(("quote", "found"), [("a  b", True), ("b\nc", True), ("", False), (None, False), ("d", False), ("  ", False)])
def test_quoted(value, quote, found):
    assert value(tx.quoted(F.col("q"), tx.squeeze("t")), q=quote, t="x a b  c y") is found


def test_first_year_and_latest_year_of_a_tie(value):
    found = tx.years(F.col("t"))
    assert value(tx.top_year(found), t="1971 1990 1980 1980 1990") == 1990
    assert value(tx.top_year(found, "latest"), t="1980 1990 1980 1990") == 1990
    assert value(tx.top_year(found), t="none") is None


def test_dated_year_outweighs_bare_ones(value):
    assert value(tx.weighted_year("t"), t="1980 1980 1980 June 3, 1971") == 1971
    assert value(tx.weighted_year("t"), t="1980 1980 1980 1980 1980 2/3/1971") == 1980


def test_salvaged_json():
    assert tx.salvaged_list('{"entities": [{"a": 1}, {"b": [1') == '{"entities": [{"a": 1}]}'
    assert tx.salvaged_list("nothing") is None
    assert tx.balanced_object('x {"a": "}\\"{"} y}') == '{"a": "}\\"{"}'
    assert tx.balanced_object(None) is None


def test_short(value):
    assert value(tx.short(F.col("t"), 5), t=" a \n bcdef ") == "a bc…"
    assert value(tx.short(F.col("t"), 5), t=None) == ""


def test_spans_count_code_points(value):
    got = value(sp.regex_spans("t", r"S(\w)"), t="😀 SX é Sy")
    assert [(m.start, m.end, m.match, m.g1) for m in got] == [(2, 4, "SX", "X"), (7, 9, "Sy", "y")]
    assert value(sp.regex_spans("t", "x"), t=None) is None


def test_line_pages_tile_the_text(value):
    text = "a" * 10 + "\n" + "b" * 30 + "\n\n" + "c" * 5
    got = [(p.page, p.start, p.end) for p in value(sp.line_pages("t", 20), t=text)]
    assert got == [(1, 0, 42), (2, 42, 48)]
    assert value(sp.line_pages("t", 20), t="") == []


def test_paragraphs_and_sentences(value):
    text = "x" * 60 + "\ny\n \n" + "short\n\n" + "z" * 50
    assert [(p.start, p.end) for p in value(sp.paragraph_spans(F.col("t")), t=text)] == [(0, 63), (72, 122)]
    said = "One two. Three! four? Five"
    assert [said[s.start : s.end] for s in value(sp.sentence_spans(F.col("t")), t=said)] == ["One two.", "Three! four?", "Five"]


def test_aligned(value):
    got = value(sp.aligned(F.col("t")), t="“a…” co-\n  op")
    assert got.text == '"a..." coop'
    assert [(s.norm_start, s.norm_end, s.raw_start, s.raw_end) for s in got.spans] == [(0, 1, 0, 1), (1, 2, 1, 2), (2, 5, 2, 3), (5, 6, 3, 4), (6, 9, 4, 7), (9, 11, 11, 13)]

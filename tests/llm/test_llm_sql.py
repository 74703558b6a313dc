"""Queries of the subpackage with SQL, and the base columns of those whose verdict is learned."""

import collections

import pytest
from conftest import DATA

from docloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(name, same):
    same(queries.queries()[name], queries.oracle_sql()[name])


def test_quality_base_columns(spark, duck):
    from docloom.llm.quality_rules import WORD

    got = {r.doc_id: r for r in queries.queries()["op1_quality_rules"](spark, DATA).collect()}
    rows = duck.sql("select doc_id, text from documents").fetchall()
    assert len(got) == len(rows)
    for doc_id, text in rows:
        words = WORD.findall(text or "")
        windows = collections.Counter(zip(words, words[1:], words[2:]))
        inside = {i + k for i in range(len(words) - 2) for k in range(3) if windows[tuple(words[i : i + 3])] > 1}
        seen, dup = set(), 0
        for line in (text or "").split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        r = got[doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(inside))
        assert r.base_failed == (len(words) < 50 or 100 * len(inside) > 50 * len(words))
        assert not (r.kept and r.base_failed)

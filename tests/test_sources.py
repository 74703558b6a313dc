"""Catalog pages and projections, batches with error rows, outside models and clients."""

import json

import pytest
from pyspark.sql import functions as F

from docloom.operators import model, segment
from docloom.operators.selection import notes
from docloom.plans import records
from docloom.sources import catalog, sinks


def works(n: int) -> list[dict]:
    return [{"id": f"w{i}", "title": [f"T{i}"], "subject": {"a": i}, "contributor": [{"label_with_role": f"Bureau {i} (issuing body)"}, {"label": "Second"}]} for i in range(n)]


def test_paged_catalog_is_stored_once(spark, tmp_path):
    all_works, asked = works(57), []

    def page(n):
        asked.append(n)
        return all_works[25 * (n - 1) : 25 * n]

    cache = f"{tmp_path}/catalog"
    rows = catalog.fetched(spark, page, cache)
    assert asked == [1, 2, 3] and rows.count() == 57
    assert catalog.fetched(spark, page, cache).count() == 57 and asked == [1, 2, 3]
    out = catalog.projected(rows, ["title", "subject"], "https://site", "https://api")
    assert out.columns == ["work_id", "title", "subject", "source_url", "api_link"]
    row = out.where("work_id = 'w3'").first()
    assert (json.loads(row.title), json.loads(row.subject), row.source_url, row.api_link) == (["T3"], {"a": 3}, "https://site/items/w3", "https://api/works/w3")
    silver = {r.work_id: r.agency for r in catalog.silver(rows).collect()}
    assert silver["w4"] == "Bureau 4 (issuing body)"  # the first contributor
    force = catalog.fetched(spark, lambda n: works(3), cache, force=True)
    assert force.count() == 3


def test_pages_by_lines_joined_by_form_feeds(spark):
    """Whole lines of any kind up to 2,500 characters a page, ends trimmed, blank pages dropped."""
    texts = ["", "one\n", "a\x0bb\u2028c", "line of words\n" * 400, " \n" * 2000 + "end", "x" * 6000, ("y" * 1000 + "\r\n") * 6]

    def plain(t):
        pages, now = [], ""
        for line in t.splitlines(keepends=True):
            now += line
            if len(now) >= 2500:
                pages, now = [*pages, now], ""
        return "\f".join(p.rstrip() for p in [*pages, now] if p.strip())

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r.text for r in segment.joined_pages(docs).collect()}
    assert [got[i] for i in range(len(texts))] == [plain(t) for t in texts]


def test_notes_of_shortages():
    got = notes({"short": 128, "medium": 50, "long": 3}, {"short": 5, "medium": 12, "long": 3})
    assert got == ["long: only 3 docs available (plan asked for 5); taking all 3 and redistributing the deficit."]
    assert notes({"short": 1}, {"short": 1, "medium": 0, "long": 0})[-1] == "could not reach total target of 20; selecting 1 docs."


def test_batches_record_their_errors(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(8)], "doc_id long, text string")

    def cost(text):
        if text.endswith("3"):
            raise ValueError("unreadable")
        return float(len(text))

    picked = f"{tmp_path}/selection.json"
    docs.where("doc_id < 6").select("doc_id").coalesce(1).write.json(picked)
    rows = records.batch(docs, cost, selection=spark.read.json(picked))
    got = {r.doc_id: (r.cost_usd, r.error) for r in rows.collect()}
    assert len(got) == 6 and got[3] == (None, "ValueError: unreadable") and got[1] == (6.0, None)
    assert tuple(records.batch_total(rows).first()) == (6, 1, 30.0)
    assert records.batch(docs, cost, limit=2).count() == 2
    assert records.batch(docs, cost, only=[7]).first().doc_id == 7


def test_outside_models_load_once_a_task(spark):
    docs = spark.createDataFrame([(i, f"Ann Lee met {i}") for i in range(20)] + [(99, None)], "doc_id int, text string").coalesce(1)

    def names():
        loads = []
        loads.append(1)
        return lambda texts: [[w for w in t.split() if w.istitle()] for t in texts]

    out = model.mapped(docs, "text", "names", "array<string>", names)
    assert out.where("doc_id = 1").first().names == ["Ann", "Lee"] and out.where("doc_id = 99").first().names == []
    vectors = model.mapped(docs, "text", "embedding", "array<float>", lambda: lambda texts: [[float(len(t)), 1.0] for t in texts])
    assert vectors.where("doc_id = 1").first().embedding == [13.0, 1.0]


def test_clients_by_credential():
    """The first registered client whose credential is there; without one, the dry run."""
    b, have = model.Backends(), set()
    b.register("key", lambda: "key" in have, lambda: "by key")
    b.register("token", lambda: "token" in have, lambda: "by token")
    assert isinstance(b.resolve()(), model.DryRun)
    have.add("key")
    assert b.resolve()() == "by key"
    have.add("token")
    assert b.resolve()() == "by token" and b.resolve("key")() == "by key"
    with pytest.raises(KeyError):
        b.resolve("other")


def test_layout_of_json(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"id": "x", "pages": [{"n": 1}]}))
    found = sinks.inspected(spark, f"{tmp_path}/a.json")
    assert "pages" in str(found) and "id" in str(found)

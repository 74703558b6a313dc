"""Operators on small tables: golden pairs, ties, repeated rows, empty tables, sources and sinks."""

import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.operators import entities, fields, lookup, model, retrieval, segment, usage, validate
from docloom.sources import catalog, corpus, sinks
from docloom.streaming import ingest

MENTION = "doc_id int, chunk_index int, entity string, kind string, role string, stance string, attribution_mode string, quote string, quote_verified boolean, evidence_pages array<string>, stance_basis string"


def test_merge(spark):
    rows = [
        (1, 2, "Sierra Club", "organization", "", "opposed", "paraphrased", "a longer quote", False, ["3-4"], ""),
        (1, 1, "The Sierra Club (NM)", "agency", "group", "opposed", "direct_quote", "short", True, ["1-2", "3-4"], ""),
        (1, 3, "Sierra  Club", "agency", "advocates", "opposed", "direct_quote", "tiny", True, None, ""),
        (1, 1, "Sierra Club", "organization", "", "neutral", "direct_quote", "x", False, [" "], ""),
        (1, 1, "(nobody)", "other", "", "neutral", "direct_quote", "x", True, [], ""),
        (2, 1, "A", "other", "", "neutral", "direct_quote", "x", True, [], ""),
    ]
    got = [r for r in entities.merged(spark.createDataFrame(rows, MENTION)).orderBy("doc_id", "sequence").collect() if r.doc_id == 1]
    assert [(r.entity, r.stance) for r in got] == [("Sierra Club", "neutral"), ("The Sierra Club (NM)", "opposed")]
    r = got[1]
    assert (r.kind, r.role, r.summary_quote, r.summary_quote_verified, r.n_mentions) == ("agency", "advocates", "short", True, 3)
    assert r.evidence_pages == ["1-2", "3-4"] and r.attribution_modes_seen == ["direct_quote", "paraphrased"]
    assert got[0].evidence_pages == []


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert segment.fixed_chunks(docs).count() == 0
    assert segment.chapters(docs).count() == 0
    assert segment.sections(docs).count() == 0
    assert segment.comment_blocks(docs).count() == 0
    assert retrieval.keyword_windows(docs, ["a"]).count() == 0
    assert entities.merged(spark.createDataFrame([], MENTION)).count() == 0


def test_null_and_empty_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert segment.fixed_chunks(docs).count() == 0
    assert segment.line_pages(docs).count() == 0
    assert segment.sections(docs).where("status = 'ok'").count() == 0
    assert segment.comment_blocks(docs).count() == 0


def test_alternate_lines(spark):
    text = "A. MITIGATION\nB. CONSULTATION\nC. ALTERNATIVES\n"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert {r.chapter for r in segment.chapters(docs, guard=0).collect()} == {"Mitigation", "Consultation", "Alternatives"}
    assert {r.chapter for r in segment.chapters(docs, guard=0, alternate=True).collect()} == {"Mitigation", "Alternatives"}


def test_rejected_headings(spark):
    docs = spark.createDataFrame([(1, "12 Main St\nSUMMARY\n" + "x" * 80 + "\nSUMMARY\nbody"), (2, "SUMMARY\nPortland 97201")], "doc_id long, text string")
    got = {(r.doc_id, r.start) for r in segment.heading_hits(docs).collect()}
    assert got == {(1, 100)}


def test_toc_starts(spark):
    hits = spark.createDataFrame([(1, s, 2000) for s in (10, 150, 300, 450, 900)] + [(2, 5, 100)], "doc_id int, start int, n int")
    assert [(r.start, r.end) for r in segment.toc_starts(hits).orderBy("start").collect()] == [(10, 300), (300, 900), (900, 2000)]


def test_repeated_comment_numbers(spark):
    text = "COMMENT 1: a\nCOMMENT 2: b\nCOMMENT 1: c\n"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [r.block_id for r in segment.comment_blocks(docs).orderBy("ord").collect()] == ["block_1", "block_2", "block_1_2"]
    failed = spark.createDataFrame([(1, "Response:\nyes")], "doc_id long, text string")
    blocks = spark.createDataFrame([(1, "b", 0, 0, 13)], "doc_id long, block_id string, ord int, start int, end int")
    assert segment.block_parts(failed, blocks).first().split_status == "comment_response_split_failed"


def test_matched_works(spark):
    works = spark.createDataFrame([("a", 0, "P1_x", []), ("b", 1, "p1_X", []), ("c", 2, "", ["no", "P2_y"]), ("d", 3, None, ["2_"]), ("e", 4, "", ["zz"]), ("f", 5, "", [])], "work_id string, work_ord int, accession string, identifiers array<string>")
    docs = spark.createDataFrame([("P1_x", 0), ("P2_y", 1), ("P22_z", 2)], "doc_key string, doc_ord int")
    assert {(r.work_id, r.doc_key, r.priority) for r in lookup.matched_works(works, docs).collect()} == {("a", "P1_x", 1), ("b", "P1_x", 2), ("c", "P2_y", 3), ("d", "P2_y", 4)}


def test_agency_ladders(spark):
    rows = spark.createDataFrame([(["x", "USDA Forest Service, region 3"], "the Bureau of Land Management"), ([], "by the United States Forest Service."), ([], "none"), (["Kane County"], "")], "names array<string>, cover string")
    none = F.lit(None).cast("string")
    got = [(r.a.value, r.a.confidence) for r in rows.select(fields.record_agency(F.col("names"), F.col("cover"), none, False).alias("a")).collect()]
    assert got == [("USFS", 0.99), ("USFS", 0.85), (None, None), ("Kane County", 0.6)]
    near = rows.limit(1).select(lookup.nearest_agency(F.lit("By Bureau of Land Managment")).alias("a")).first().a
    assert near.abbreviation == "BLM"


def test_windows_join_where_they_meet(spark):
    docs = spark.createDataFrame([(1, "key" + "." * 20 + "key" + "." * 100 + "Key")], "doc_id long, text string")
    assert [(r.n, r.start, r.end) for r in retrieval.keyword_windows(docs, ["key"], width=40).orderBy("n").collect()] == [(1, 0, 46), (2, 106, 129)]


def test_packed_context_cuts_the_last_piece(spark):
    rows = [(1, k, f"c{k}", "t", 1, 2, "x" * 300) for k in range(3)]
    chunks = spark.createDataFrame(rows, "doc_id int, rank int, chunk_id string, title string, first_page int, last_page int, text string")
    got = retrieval.packed_context(chunks, 600).first().context
    assert got.endswith("[TRUNCATED]") and got.count("[Chunk") == 2
    assert "TRUNCATED" not in retrieval.packed_context(chunks, 420).first().context


def test_usage(spark):
    rows = [(1, 1, "x.sonnet-4", 1_000_000, 0, None, 0), (1, 2, None, 5, 5, 0, 0)]
    u = spark.createDataFrame(rows, "doc_id int, call_seq int, model string, input_tokens long, output_tokens long, cache_creation_input_tokens long, cache_read_input_tokens long")
    got = {r.model: (r.calls, r.cost_usd) for r in usage.rollup(u).collect()}
    assert got == {"x.sonnet-4": (1, 3.0), "?": (1, 0.0), None: (2, 3.0)}
    assert [r.call_seq for r in usage.running(u, 1.0).where("tripped").collect()] == [1]


def test_dispatch_sheds_and_retries(spark):
    rows = [(1, k, "summary.text", "sonnet", "no", 0.1, "pass", 0.05) for k in range(6)]
    claims = spark.createDataFrame(rows, "doc_id int, ord int, field_path string, tier string, verdict string, cost double, retry_verdict string, retry_cost double")
    got = validate.dispatched(claims, 1.0, retries=2).orderBy("ord").collect()
    assert [r.tier for r in got] == ["opus", "opus", "sonnet", "sonnet", "sonnet", "sonnet"]
    assert got[0].retried == 2


CLAIMS = "doc_id int, ord int, field_path string, tier string, verdict string, cost double, retry_verdict string, retry_cost double"


def folded_in_arrays(claims, cap, retries):
    """The dispatch as one expression over the array of a document's claims: time grows with their square. The sums may become null."""
    start = F.struct(F.nullif(F.lit(0.0), F.lit(-1.0)).alias("spent"), F.nullif(F.lit(0), F.lit(-1)).alias("retried"), F.array().cast("array<struct<field_path:string,tier:string,verdict:string>>").alias("out"))

    def step(s, c):
        runs = s["spent"] < cap * F.when(c["tier"] == "haiku", 1.0).when(c["tier"] == "sonnet", 0.75).otherwise(0.5)
        spent = F.when(runs, s["spent"] + c["cost"]).otherwise(s["spent"])
        again = runs & (c["tier"] == "sonnet") & (c["verdict"] == "no") & (s["retried"] < retries) & (spent < cap * 0.5) & c["retry_verdict"].isNotNull()
        said = F.struct(c["field_path"].alias("field_path"), F.when(~runs, "skipped_budget_cap").when(again, "opus").otherwise(c["tier"]).alias("tier"), F.when(~runs, "skipped").when(again, c["retry_verdict"]).otherwise(c["verdict"]).alias("verdict"))
        return F.struct(F.when(again, spent + c["retry_cost"]).otherwise(spent).alias("spent"), (s["retried"] + again.cast("int")).alias("retried"), F.array_append(s["out"], said).alias("out"))

    each = claims.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*claims.columns[1:]))).alias("cs"))
    done = each.select("doc_id", F.aggregate("cs", start, step).alias("s"))
    return done.select("doc_id", F.posexplode("s.out").alias("ord", "v"), "s.spent", "s.retried").select("doc_id", "ord", "v.field_path", "v.tier", "v.verdict", "spent", "retried")


@pytest.mark.parametrize(("batch", "hold"), [(7, 1), (10_000, 64 << 20)])
def test_dispatch_of_odd_claims_is_the_fold_in_arrays(spark, batch, hold):
    """Null, zero, negative and NaN costs, null and unknown tiers, null verdicts, repeated places, a null document, documents across batches and in a file."""
    draw = random.Random(5)
    odd = lambda xs, k: draw.choice(xs) if draw.random() < k else xs[0]
    rows = []
    for doc in [None, *range(60)]:
        k = 0 if doc is None or doc < 30 else 0.05  # half of the documents hold odd rows
        for i in range(draw.choice([1, 3, 20, 90])):
            tier = odd([draw.choice(["haiku", "sonnet", "opus"]), "other", None], k)
            verdict = odd([draw.choice(["no", "pass"]), None], k)
            cost = odd([draw.choice([0.0, 0.01, 0.07]) if doc is None or doc % 3 else 0.0, -0.02, None, float("nan")], k)
            rows.append((doc, odd([i, i // 2, None], k), f"p{i}", tier, verdict, cost, draw.choice(["pass", "no", None]), odd([0.05, None, 0.0], k)))
    draw.shuffle(rows)
    claims = spark.createDataFrame(rows, CLAIMS).repartition(3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = validate.dispatched(claims, 0.4, 2, hold)
        assert got.columns == (want := folded_in_arrays(claims, 0.4, 2)).columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        assert validate.dispatched(claims.limit(0), 0.4).count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


@pytest.mark.parametrize("free", [False, True])
def test_dispatch_of_a_document_with_many_claims(spark, free):
    """A document of 300,000 claims in a few seconds: spent after 100 of them, or never."""
    n = 300_000
    claims = spark.range(n).select(F.lit(1).alias("doc_id"), (n - F.col("id")).alias("ord"), F.concat(F.lit("p"), F.col("id")).alias("field_path"), F.lit("haiku").alias("tier"), F.lit("no").alias("verdict"), F.lit(0.0 if free else 1.0).alias("cost"), F.lit("pass").alias("retry_verdict"), F.lit(1.0).alias("retry_cost"))
    began = time.monotonic()
    got = {(r.tier, r.verdict): r for r in validate.dispatched(claims, 100.0, hold=1 << 20).groupBy("tier", "verdict").agg(F.count("ord").alias("n"), F.min("ord").alias("first"), F.max("ord").alias("last"), F.max_by("field_path", "ord").alias("path"), F.min("spent").alias("least"), F.max("spent").alias("most"), F.max("retried").alias("retried")).collect()}
    assert time.monotonic() - began < 30
    if free:
        assert {k: tuple(r)[2:] for k, r in got.items()} == {("haiku", "no"): (n, 0, n - 1, "p0", 0.0, 0.0, 0)}
    else:
        assert {k: tuple(r)[2:] for k, r in got.items()} == {("haiku", "no"): (100, 0, 99, f"p{n - 100}", 100.0, 100.0, 0), ("skipped_budget_cap", "skipped"): (n - 100, 100, n - 1, "p0", 100.0, 100.0, 0)}


def test_violations_cover_every_rule(spark):
    t = lambda rows, schema: spark.createDataFrame(rows, schema)
    parts = {
        "sections": t([(1, "summary", "ok", None, None), (1, "rod", "ok", 5, 5), (1, "cover", "ok", 0, 9)], "doc_id int, section string, status string, start int, end int"),
        "provenance": t([(1, "p1", "cover", 3, 2), (1, "p2", "nowhere", 1, 2), (2, "p3", "nowhere", 1, 2)], "doc_id int, item string, section string, start int, end int"),
        "places": t([(1, "x", "project_area", False)], "doc_id int, item string, role string, has_polygon boolean"),
        "polygons": t([(1,)], "doc_id int"),
        "subthemes": t([(1, "rail", "transportation")], "doc_id int, value string, parent string"),
        "primaries": t([(1, "other")], "doc_id int, value string"),
        "cross_links": t([(1, "ready")], "doc_id int, status string"),
    }
    got = {(r.rule, r.item) for r in validate.violations(parts).collect()}
    assert got == {("ok_needs_span", "summary"), ("span_bounds", "rod"), ("offset_bounds", "p1"), ("section_exists", "p2"), ("polygon_needs_place", "1"), ("parent_chosen", "rail"), ("cross_links_deferred", "ready")}


def test_model_edge_asks_once(spark, tmp_path):
    class Client:
        def call(self, prompt, name):
            if "bad" in prompt:
                raise ValueError("no")
            return {"text": json.dumps({"n": len(prompt)}), "input_tokens": 1, "output_tokens": 1}

    prompts = spark.createDataFrame([(1, "a"), (2, "a"), (3, "bad"), (4, "ccc")], "doc_id int, prompt string").withColumn("model", F.lit("m"))
    path = f"file://{tmp_path}/replay"
    got = {r.doc_id: (r.response, r.error) for r in model.answered(prompts, path, Client).collect()}
    assert got[1] == got[2] == ('{"n": 1}', None) and got[3][0] is None and "ValueError" in got[3][1]
    assert spark.read.parquet(path).where("error is null").count() == 2
    model.answered(prompts.where("doc_id <> 3"), path, Client).count()
    assert spark.read.parquet(path).where("error is null").count() == 2
    assert model.answered(prompts, spark.createDataFrame([], model.RESPONSE)).where("error = 'not recorded'").count() == 4
    assert model.Backends().resolve()().call("x" * 8, "m")["input_tokens"] == 2


def test_folder_source(spark, tmp_path):
    d = tmp_path / "P0491_35556"
    (d / "TXT").mkdir(parents=True)
    (d / "CONFIDENCES").mkdir()
    for n in (1, 2, 10):
        (d / "TXT" / f"x_{n:08d}.txt").write_bytes(f"page {n}".encode() + (b"\xff" if n == 2 else b""))
    (d / "CONFIDENCES" / "x_00000001.json").write_text('{"words": [{"confidence": 0.5}, {"confidence": 0.9}]}')
    (d / "mets.xml").write_text('<mets:mets xmlns:mets="a" xmlns:mods="b"><mods:titleInfo><mods:title>T</mods:title></mods:titleInfo></mets:mets>')
    (tmp_path / "P1_2" / "TXT").mkdir(parents=True)
    (tmp_path / "P1_2" / "TXT" / "y_1.txt").write_text("one")
    (tmp_path / "P1_2" / "mets.yaml").write_text("Title: Y\ncreator: [USFS, BLM]\nyear: 1971\n")
    pages = corpus.folder_pages(spark, f"file://{tmp_path}")
    docs = {r.doc_id: r for r in corpus.folder_documents(pages).collect()}
    assert docs["35556"].text == "page 1\fpage 2�\fpage 10" and docs["35556"].project_id == "P0491"
    assert [(p.page, p.start, p.end) for p in docs["35556"].pages] == [(1, 0, 6), (2, 7, 14), (10, 15, 22)]
    assert docs["35556"].pages[0].confidence == pytest.approx(0.7)
    meta = {r.doc_dir: (r.title, r.agency, r.date) for r in corpus.metadata_files(spark, f"file://{tmp_path}").collect()}
    assert meta == {"P0491_35556": ("T", None, None), "P1_2": ("Y", "USFS", "1971")}


def test_json_corpus_and_catalog(spark, tmp_path):
    (tmp_path / "docs.json").write_text(json.dumps({"P1_a": "x", "P2_b": "y"}))
    assert [(r.doc_key, r.doc_ord) for r in corpus.json_corpus(spark, f"file://{tmp_path}/docs.json").orderBy("doc_ord").collect()] == [("P1_a", 0), ("P2_b", 1)]
    works = [{"id": "w1", "accession_number": "P1_a", "title": ["T", "U"], "identifier": {"a": ["i1", {"b": "i2"}]}, "contributor": [{"label_with_role": "BLM (issuing body)"}, "x"], "creator": "c", "date_created": "1971", "create_date": "2026-01-01"}, {"id": "w2", "title": "S", "contributor": []}]
    (tmp_path / "works.json").write_text(json.dumps(works))
    got = {r.work_id: r for r in catalog.silver(catalog.works(spark, f"file://{tmp_path}/works.json")).collect()}
    assert got["w1"].title == "T" and got["w1"].identifiers == ["i1", "i2"] and got["w1"].contributors == ["BLM (issuing body)", "x", "c"] and got["w1"].year == 2026
    assert got["w2"].title == "S" and got["w2"].accession == "" and got["w2"].contributors == []
    calls = []

    def fetch(name):
        calls.append(name)
        return {"id": name} if name == "b" else None

    keys = spark.createDataFrame([("P_b",), ("P_c",)], "doc_key string")
    found = {r.doc_key: r.found for r in catalog.looked_up(keys, f"file://{tmp_path}/cache", fetch).collect()}
    assert found == {"P_b": True, "P_c": False}
    assert catalog.looked_up(keys, f"file://{tmp_path}/cache").where("found").count() == 1


def test_checkpoints_and_sinks(spark, tmp_path):
    path = f"file://{tmp_path}/stage"
    stage = lambda todo: todo.select("doc_id", F.rand().alias("r"))
    ids = lambda *n: spark.createDataFrame([(i,) for i in n], "doc_id int")
    first = {r.doc_id: r.r for r in sinks.checkpointed(ids(1, 2), path, stage).collect()}
    second = {r.doc_id: r.r for r in sinks.checkpointed(ids(1, 2, 3), path, stage).collect()}
    assert first.items() <= second.items() and set(second) == {1, 2, 3}
    sinks.write_json(spark.createDataFrame([(1, None, "t")], "a int, b string, text string"), f"file://{tmp_path}/json", drop=["text"])
    assert spark.read.text(f"file://{tmp_path}/json").first().value == '{"a":1,"b":null}'
    rows = spark.createDataFrame([(1, 0, "title", 'a "b", c', "", "", "", "", "")], "doc_id int, ord int, field string, extracted_value string, source_pages string, critic_verdict string, model_confidence string, your_grade string, your_notes string")
    sheet = sinks.sheet_lines(rows, ["one", "two"]).first().sheet.split("\r\n")
    assert sheet[:3] == ["# one", "# two", ""] and sheet[4].startswith('title,"a ""b"", c",')
    got = {r.x: r.error for r in sinks.tried(spark.createDataFrame([("1",), ("z",)], "x string"), "x", int, "long").collect()}
    assert got["1"] is None and got["z"].startswith("ValueError")


def test_streaming_takes_each_file_once(spark, tmp_path):
    source, out, check = (f"file://{tmp_path}/{n}" for n in ("in", "out", "check"))
    rows = lambda *ids: spark.createDataFrame([(i, "a\nb", "en", "s", 3) for i in ids], "doc_id long, text string, lang string, source string, n_chars long")
    rows(1, 2).write.mode("append").parquet(source)
    ingest.ingest(spark, source, out, check).awaitTermination(120)
    rows(3).write.mode("append").parquet(source)
    ingest.ingest(spark, source, out, check).awaitTermination(120)
    assert sorted(r.doc_id for r in spark.read.parquet(out).collect()) == [1, 2, 3]
    assert os.path.isdir(f"{tmp_path}/check")


def test_full_names(spark):
    rows = spark.createDataFrame([("Mary J. Smith-Jones", True), ("UNITED STATES", False), ("", False), (None, False)], "n string, y boolean")
    assert all(r.y == r.g for r in rows.select("y", tx.is_full_name("n").alias("g")).collect())

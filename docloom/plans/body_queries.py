"""Registered queries of body fields, entities, stakeholders and checks, with recorded answers, and their SQL.

An answer is a function of its prompt: of the first hexadecimal digit of the prompt's MD5.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators import body, entities, fields, lookup, model, segment, selection
from docloom.plans.queries import _BLOCKS, _CHUNKS, docs_of, eis, query
from docloom.plans.views import view

_FOUND = """SELECT doc_id, 'Alternatives' AS chapter, 'Alternatives' AS label, 100 AS start, CAST(length(text) AS INT) AS "end" FROM documents WHERE doc_id % 3 <> 0 AND length(text) > 400
UNION ALL SELECT doc_id, 'Consultation', 'List of Preparers', 50, 300 FROM documents WHERE doc_id % 4 = 0 AND length(text) > 400
UNION ALL SELECT doc_id, 'Affected Environment', 'Study Area map', 60, 260 FROM documents WHERE doc_id % 5 = 0 AND length(text) > 400"""
_DIGIT = "strpos('0123456789abcdef', substring(md5(prompt), 1, 1)) - 1"


def found_in(spark, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, _FOUND.replace('"end"', "`end`"))


def digit() -> Column:
    return F.instr(F.lit("0123456789abcdef"), F.substring(F.md5("prompt"), 1, 1)) - 1


def replay(prompts: DataFrame, response: Column) -> DataFrame:
    """The table of recorded answers of prompts; those without an answer are not in it."""
    rows = prompts.select(model.prompt_hash(F.col("prompt"), F.col("model")).alias("prompt_hash"), "model", response.alias("response")).where("response is not null").distinct()
    return rows.withColumns({"input_tokens": F.lit(1).cast("long"), "output_tokens": F.lit(1).cast("long"), "error": F.lit(None).cast("string")})


def recorded(spark, rows: list[tuple[str, str, str]]) -> DataFrame:
    """The same of (model, prompt, response)."""
    return replay(spark.createDataFrame(rows, "model string, prompt string, response string"), F.col("response"))


@query("body_alternatives", f"""WITH f AS ({_FOUND}), p AS (SELECT doc_id, '1-' || CASE WHEN length(text) - 100 > 2500 THEN 1 ELSE length(text) // 2500 + 1 END AS span, substring(text, 101, 2500) AS part FROM documents JOIN f USING (doc_id) WHERE chapter = 'Alternatives'),
a AS (SELECT *, {_DIGIT} AS k FROM (SELECT *, 'Pages ' || span || ': ' || part AS prompt FROM p))
SELECT doc_id, md5(prompt) AS h, CAST(CASE WHEN k < 12 THEN 1 ELSE 0 END AS INT) AS n, CASE WHEN k < 12 THEN 'd' || k END AS description, CASE WHEN k < 12 THEN 'high' ELSE 'low' END AS confidence, coalesce(span, '') AS source_pages, CASE WHEN span IS NULL THEN 'no Alternatives chapter' END AS note FROM documents LEFT JOIN a USING (doc_id)""")
def _(spark, sf_dir):
    """Only where a chapter was found, cut to whole pages."""
    docs = docs_of(spark, sf_dir)
    prompts = body.alternatives_prompts(docs, found_in(spark, sf_dir), "Pages {span}: {text}", pages=1)
    answer = F.when(digit() < 12, F.concat(F.lit('{"alternatives": [{"name": "No Action", "description": "d'), digit(), F.lit('", "source_pages": ["1-1"]}]}')))
    out = body.alternatives(docs, prompts, replay(prompts, answer)).join(prompts.select("doc_id", F.md5("prompt").alias("h")), "doc_id", "left")
    return out.select("doc_id", "h", F.size("value").alias("n"), F.get("value", 0)["description"].alias("description"), "confidence", F.array_join("source_pages", ",").alias("source_pages"), "note")


@query("body_themes", """WITH p AS (SELECT doc_id, md5('Classify {"project_description":"road ' || doc_id % 9 || '","affected_community":"","alternatives_overview":"","environmental_impact":"","public_response":""}') AS h FROM documents), a AS (SELECT doc_id, h, strpos('0123456789abcdef', substring(h, 1, 1)) - 1 < 8 AS yes FROM p)
SELECT doc_id, h, CASE WHEN yes THEN 'transportation' ELSE '' END AS themes, CASE WHEN yes THEN 'rail,x' ELSE '' END AS subthemes, CASE WHEN yes THEN 'high' ELSE 'medium' END AS confidence, 'summary' AS source_pages FROM a""")
def _(spark, sf_dir):
    """X08."""
    said = F.parse_json(F.concat(F.lit('{"project_description": {"text": "road '), F.col("doc_id") % 9, F.lit('"}}')))
    prompts = body.themes_prompts(docs_of(spark, sf_dir).select("doc_id", fields.summary_fields(said, True).alias("summary")), "Classify {summary}")
    got = body.themes(prompts, replay(prompts, F.when(digit() < 8, F.lit('{"themes": ["transportation"], "subthemes": ["rail", "x"], "self_confidence": "high"}'))))
    return got.join(prompts.select("doc_id", F.md5("prompt").alias("h")), "doc_id").select("doc_id", "h", F.array_join("themes", ",").alias("themes"), F.array_join("subthemes", ",").alias("subthemes"), "confidence", F.array_join("source_pages", ",").alias("source_pages"))


@query("body_location", f"""WITH p AS (SELECT doc_id, doc_id % 5 = 0 AND length(text) > 400 AS area, 'Where? ' || substring(text, 1, 2500) || CASE WHEN doc_id % 5 = 0 AND length(text) > 400 THEN chr(10) || chr(10) || '---' || chr(10) || chr(10) || substring(text, 61, 100) ELSE '' END AS prompt FROM documents), a AS (SELECT *, {_DIGIT} < 8 AS yes FROM p)
SELECT doc_id, md5(prompt) AS h, CAST(CASE WHEN yes THEN 3 ELSE 0 END AS INT) AS n, yes AS is_multi_site, CASE WHEN yes THEN 'Akron:41.081445,Nowhere:?' ELSE '' END AS geocoded, 'medium' AS confidence, CASE WHEN area THEN '1-1,1-1' ELSE '1-1' END AS source_pages, CASE WHEN yes THEN 'n' ELSE '' END AS note FROM a""")
def _(spark, sf_dir):
    """X09, X10."""
    prompts = body.location_prompts(docs_of(spark, sf_dir), found_in(spark, sf_dir), "Where? {text}", pages=1, most=100)
    answer = F.when(digit() < 8, F.lit('{"places": [{"name": "Akron", "kind": "point", "state": "OH"}, {"name": "Nowhere"}, {"kind": "region"}], "is_multi_site": true, "note": "n"}'))
    gazetteer = spark.createDataFrame([("akron", "OH", 41.0814447, -81.5190053)], "name string, state string, lat double, lon double")
    got = body.location(prompts, gazetteer, replay(prompts, answer)).join(prompts.select("doc_id", F.md5("prompt").alias("h")), "doc_id")
    at = F.transform("geocoded", lambda g: F.concat(g["name"], F.lit(":"), F.coalesce(g["lat"].cast("string"), F.lit("?"))))
    return got.select("doc_id", "h", F.size("places").alias("n"), "is_multi_site", F.array_join(at, ",").alias("geocoded"), "confidence", F.array_join("source_pages", ",").alias("source_pages"), "note")


@query("located_places", f"""WITH a AS (SELECT doc_id, {_DIGIT} AS k FROM (SELECT doc_id, 'L ' || substring(text, 1, 200) AS prompt FROM documents))
SELECT doc_id, CAST(CASE WHEN k < 12 THEN 1 ELSE 0 END AS INT) AS n, CAST(CASE WHEN k < 8 THEN 2 ELSE 0 END AS INT) AS dropped, CASE WHEN k BETWEEN 8 AND 11 THEN 'ok' ELSE 'needs_review' END AS status FROM a""")
def _(spark, sf_dir):
    """X21."""
    prompts = docs_of(spark, sf_dir).select("doc_id", model.filled("L {text}", text=F.substring("text", 1, 200)).alias("prompt"), F.lit("light").alias("model"))
    some, one = '{"places": [{"name": "A", "role": "site"}, {"name": "B", "role": "zzz"}, {"name": " ", "role": "site"}]}', '{"places": [{"name": "A", "role": "site"}]}'
    return body.located(prompts, ["site", "corridor", "region", "county", "state"], replay(prompts, F.when(digit() < 8, some).when(digit() < 12, one))).select("doc_id", F.size("places").alias("n"), "dropped", "status")


_ANSWERED = "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN concat(text, chr(10), 'Response to Comments', chr(10), 'The county  said we oppose it.') ELSE text END AS text FROM documents WHERE length(text) > 0"


@query("body_people", f"""WITH d AS ({_ANSWERED}), p AS (SELECT doc_id, length(text) AS n, 'P ' || CASE WHEN doc_id % 4 = 0 AND doc_id IN (SELECT doc_id FROM documents WHERE length(text) > 400) THEN substring(text, 51, 250) ELSE substring(text, 1, 500) END AS prompt FROM d), a AS (SELECT *, {_DIGIT} < 8 AS yes FROM p)
SELECT doc_id, md5(prompt) AS h, CAST(CASE WHEN yes THEN 1 ELSE 0 END AS INT) AS preparers, CASE WHEN doc_id % 2 = 0 THEN 'County:true,X:false' ELSE '' END AS commenters, doc_id % 2 = 0 AS comment_response_present, CASE WHEN yes THEN 'high' ELSE 'medium' END AS confidence, '1-1' AS preparer_pages, CASE WHEN doc_id % 2 = 0 THEN ((n - 51) // 2500 + 1) || '-' || (n // 2500 + 1) ELSE '' END AS commenter_pages FROM a""")
def _(spark, sf_dir):
    """X11."""
    docs = view(spark, sf_dir, _ANSWERED)
    prompts = body.people_prompts(docs, found_in(spark, sf_dir), "P {text}", "C {span} {text}", most=500, pages=1)
    public = '{"commenters": [{"name": "County", "kind": "official", "stance": "oppose", "quote": "said we oppose"}, {"name": "X", "quote": "not there"}, {"name": "Y", "quote": " "}]}'
    answer = F.when(F.col("part") == "commenters", public).when(digit() < 8, '{"agency_preparers": [{"name": "Jane", "role": "r"}], "cooperating_agencies": []}')
    out = body.people(docs, prompts, replay(prompts, answer)).join(prompts.where("part = 'preparers'").select("doc_id", F.md5("prompt").alias("h")), "doc_id")
    shown = F.transform("public_commenters", lambda c: F.concat(c["name"], F.lit(":"), c["quote_verified"].cast("string")))
    return out.select("doc_id", "h", F.size("agency_preparers").alias("preparers"), F.array_join(shown, ",").alias("commenters"), "comment_response_present", "confidence", F.array_join("preparer_pages", ",").alias("preparer_pages"), F.array_join("commenter_pages", ",").alias("commenter_pages"))


@query("two_summaries", f"""WITH a AS (SELECT doc_id, {_DIGIT} AS k, doc_id % 2 = 0 AS degraded FROM (SELECT doc_id, 'L ' || substring(text, 1, 300) AS prompt FROM documents))
SELECT doc_id, CASE WHEN k < 12 THEN 'long ' || k END AS detailed, CASE WHEN k < 12 AND k % 2 = 0 THEN 'short' END AS plain, CASE WHEN k < 12 AND NOT degraded THEN 'ok' ELSE 'needs_review' END AS status, CASE WHEN k < 12 AND k % 2 = 0 AND NOT degraded THEN 'ok' ELSE 'needs_review' END AS plain_status, CASE WHEN k < 12 THEN CASE WHEN degraded THEN 0.65 ELSE 0.85 END END AS confidence, CASE WHEN k < 12 AND k % 2 = 0 THEN CASE WHEN degraded THEN 0.6 ELSE 0.8 END END AS plain_confidence FROM a""")
def _(spark, sf_dir):
    """X19."""
    contexts = docs_of(spark, sf_dir).select("doc_id", "text", (F.col("doc_id") % 2 == 0).alias("degraded"))
    prompts = contexts.select(model.filled("L {text}", text=F.substring("text", 1, 300)).alias("prompt"), F.lit("heavy").alias("model"))
    first = replay(prompts, F.when(digit() < 12, F.concat(F.lit('{"summary": " long '), digit(), F.lit('"}'))).otherwise("{}"))
    second = recorded(spark, [("light", f"S long {k}", '{"summary": "short"}') for k in range(0, 12, 2)])
    return body.two_summaries(contexts, "L {text}", "S {text}", first.union(second), most=300)


@query("entity_packs", f"""WITH a AS (SELECT *, {_DIGIT} < 8 AS yes FROM (SELECT doc_id, substring(text, 1, 400) AS c, 'E Board: ' || substring(text, 1, 400) AS prompt FROM documents)), q AS (SELECT *, regexp_replace(substring(c, 1, 60), '^\\s+|\\s+$', '', 'g') AS q FROM a)
SELECT doc_id, CASE WHEN yes THEN 'opposed' ELSE 'insufficient_information' END AS stance, CASE WHEN yes THEN 'Chair' END AS role, CASE WHEN yes THEN 'against' END AS opinion, CASE WHEN yes AND len(list_filter(regexp_split_to_array(q, '\\s+'), lambda w: w <> '')) BETWEEN 8 AND 40 THEN q END AS quote, CAST(CASE WHEN yes THEN 1 ELSE 0 END AS INT) AS evidence FROM q""")
def _(spark, sf_dir):
    """An answer counts as far as it holds."""
    rows = docs_of(spark, sf_dir).select("doc_id", F.lit("Board").alias("name"), F.substring("text", 1, 400).alias("context"))
    prompts = rows.select("context", model.filled("E {name}: {text}", name=F.col("name"), text=F.col("context")).alias("prompt"), F.lit("heavy").alias("model"))
    good = F.to_json(F.struct(F.lit("opposed").alias("stance"), F.lit(" Chair ").alias("role"), F.lit("against").alias("opinion_summary"), F.substring("context", 1, 60).alias("quote"), F.array(F.struct(F.lit("c01").alias("chunk_id"))).alias("evidence")))
    bad = F.to_json(F.struct(F.lit("furious").alias("stance"), F.substring("context", 1, 60).alias("quote")))
    return body.entity_packs(rows, "E {name}: {text}", replay(prompts, F.when(digit() < 8, good).when(digit() < 12, bad))).select("doc_id", "stance", "role", "opinion", "quote", F.size("evidence").alias("evidence"))


@query("chunk_labels", f"""WITH a AS (SELECT doc_id, {_DIGIT} AS k, CASE WHEN doc_id % 2 = 0 THEN 'H' END AS heading FROM (SELECT doc_id, 'T ' || CASE WHEN doc_id % 2 = 0 THEN 'H' ELSE '(none)' END || ' ' || substring(text, 1, 300) AS prompt FROM documents))
SELECT doc_id, CASE WHEN k < 8 THEN 'title' ELSE coalesce(heading, 'c01') END AS title, CASE WHEN k < 8 THEN 'about' ELSE '' END AS description, CASE WHEN k < 8 THEN 'mitigation' ELSE '' END AS tags FROM a""")
def _(spark, sf_dir):
    """X32."""
    chunks = docs_of(spark, sf_dir).select("doc_id", F.lit("c01").alias("chunk_id"), F.when(F.col("doc_id") % 2 == 0, "H").alias("heading"), "text")
    prompts = chunks.select(model.filled("T {heading} {text}", heading=F.coalesce("heading", F.lit("(none)")), text=F.substring("text", 1, 300)).alias("prompt"), F.lit("light").alias("model"))
    answers = replay(prompts, F.when(digit() < 8, '{"title": "title", "description": "about", "topic_tags": ["mitigation", "zzz"]}').when(digit() < 12, "no answer"))
    return body.labelled_chunks(chunks, "T {heading} {text}", answers, most=300).select("doc_id", "title", "description", F.array_join("topic_tags", ",").alias("tags"))


@query("gap_filled_names", f"""WITH {_CHUNKS}, s AS (SELECT *, 'G ' || text AS prompt FROM c WHERE m = 0 OR len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) >= 40 AND NOT (doc_id % 2 = 0 AND contains(lower(text), 'the board')) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN m = 0 THEN 0 ELSE 1 END, chunk_id) <= 2)
SELECT DISTINCT doc_id, v.name, v.kind FROM s, (VALUES ('Ann Lee', 'person'), ('The Board', 'organization')) AS v(name, kind) WHERE {_DIGIT} < 8 AND NOT (doc_id % 2 = 0 AND v.name = 'The Board')""")
def _(spark, sf_dir):
    """The chunks worth a second look, and the names that they add."""
    rows = segment.fixed_chunks(docs_of(spark, sf_dir), 400, 400)
    tags = F.when(F.col("chunk") % 3 == 0, F.array(F.lit("comments_and_responses"))).otherwise(F.array().cast("array<string>"))
    chunks = rows.select("doc_id", F.format_string("c%02d", F.col("chunk").cast("int") + 1).alias("chunk_id"), "text", tags.alias("tags"))
    names = docs_of(spark, sf_dir).where("doc_id % 2 = 0").select("doc_id", F.lit("the board").alias("name"))
    prompts = chunks.select(model.filled("G {text}", text=F.col("text")).alias("prompt"), F.lit("light").alias("model"))
    answers = replay(prompts, F.when(digit() < 8, '{"people": ["Ann Lee "], "organizations": ["The Board", "ann lee"]}').otherwise('{"people": [" "]}'))
    return body.gap_filled(chunks, names, "G {text}", answers, chunks_most=2, words=40, known=1)


_AUTHORS = [("light", "A COMMENT 1: We oppose the road because of noise. It should not be built here.\nResponse:\nNoted. The agency agrees.\n", '{"name": " Sierra Club "}'), ("light", "A COMMENT 2: The county strongly supports Alternative A. We urge action now.\n", '{"name": "County of Kane", "type": "government"}')]
_SAID = ["COMMENT 1: We oppose the road because of noise.", "COMMENT 2: The county strongly supports Alternative A."]
_STANCES = [("light", f"S {_SAID[0]} | It should not be built here.", '{"stance": "opposed", "stance_target": "agency", "confidence": 0.5}'), ("heavy", f"S {_SAID[0]} | It should not be built here.", '{"stance": "opposed", "stance_target": "project", "confidence": 0.9}'), ("light", f"S {_SAID[1]} | We urge action now.", '{"stance": "furious", "stance_target": "moon", "confidence": 0.8}')]


@query("stakeholders", f"""{_BLOCKS} SELECT doc_id, 'block_1' AS block_id, 'Sierra Club' AS author, 'organization' AS author_type, '{_SAID[0]}' AS quote, CAST(a // 2500 + 1 AS INT) AS page, 'opposed' AS stance, 'project' AS target, CAST(0.9 AS DOUBLE) AS confidence, 'heavy' AS tier, 1 AS appearance_order FROM k
UNION ALL SELECT doc_id, 'block_2', 'County of Kane', 'government', '{_SAID[1]}', CAST(b // 2500 + 1 AS INT), 'neutral', 'unknown', 0.8, 'light', 2 FROM k""")
def _(spark, sf_dir):
    """Comment blocks, their authors, quotes, and stances in two passes."""
    out = body.stakeholders(eis(spark, sf_dir), {"author": "A {text}", "quote": "Q {sentences}", "stance": "S {sentence} | {context}"}, recorded(spark, _AUTHORS + _STANCES))
    return out.drop("display")


@query("stakeholder_status", "SELECT doc_id, CASE doc_id % 3 WHEN 1 THEN 'ok' WHEN 2 THEN 'needs_review' ELSE 'no_comment_section_found' END AS status FROM documents")
def _(spark, sf_dir):
    """The status of a document."""
    ids = docs_of(spark, sf_dir).select("doc_id")
    return body.stakeholder_status(ids, ids.where("doc_id % 3 <> 0"), ids.where("doc_id % 3 = 1"))


@query("checked_records", """SELECT doc_id, CASE WHEN y BETWEEN 1969 AND 2026 THEN y END AS year, CASE WHEN y BETWEEN 1969 AND 2026 THEN 'd' END AS date, CASE WHEN doc_id % 2 = 0 THEN 'transportation' ELSE 'other' END AS primaries, CASE WHEN doc_id % 3 = 0 THEN 'rail' ELSE '' END AS subthemes,
array_to_string(list_filter([CASE WHEN doc_id % 5 = 0 OR length(text) < 9 THEN 'quote_verification_failed: entity=E' END, CASE WHEN NOT y BETWEEN 1969 AND 2026 THEN 'year_invalid: ' || y END, CASE WHEN doc_id % 2 <> 0 THEN 'invalid_themes: sports' END, CASE WHEN doc_id % 3 <> 0 THEN 'invalid_subthemes: tides' END, CASE WHEN doc_id % 7 = 0 THEN 'geocoding_failed: Akron' END], lambda x: x IS NOT NULL), '; ') AS warnings FROM (SELECT *, CAST(1950 + doc_id % 100 AS INT) AS y FROM documents)""")
def _(spark, sf_dir):
    """V14-V16, V18."""
    docs = docs_of(spark, sf_dir)
    one = lambda cond, a, b: F.array(F.when(cond, a).otherwise(b))
    records = docs.select("doc_id", (1950 + F.col("doc_id") % 100).cast("int").alias("year"), F.lit("d").alias("date"), one(F.col("doc_id") % 2 == 0, "transportation", "sports").alias("primaries"), one(F.col("doc_id") % 3 == 0, "rail", "tides").alias("subthemes"), F.lit("Akron").alias("place"), F.when(F.col("doc_id") % 7 != 0, 41.0).alias("lat"), F.lit(-81.0).alias("lon"))
    cited = F.when((F.col("doc_id") % 5 == 0) | (F.length("text") < 9), "nowhere in it ~").otherwise(F.substring("text", 2, 7))
    people = docs.select("doc_id", F.lit("E").alias("name"), cited.alias("quote"), F.lit("c01").alias("chunk_id"))
    out = body.checked_record(records, people, docs.select("doc_id", F.lit("c01").alias("chunk_id"), "text"))
    return out.select("doc_id", "year", "date", F.array_join("primaries", ",").alias("primaries"), F.array_join("subthemes", ",").alias("subthemes"), F.array_join("warnings", "; ").alias("warnings"))


@query("sample_headers", """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'A catalog title' WHEN 1 THEN 'From the model' END AS title, CASE doc_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS title_confidence, CASE doc_id % 4 WHEN 0 THEN 'Bureau A|Bureau B|Bureau C' WHEN 1 THEN 'Agency M' ELSE '' END AS agencies, CASE doc_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS agency_confidence, CASE WHEN doc_id % 4 = 0 THEN 'joint lead: 3 agencies' END AS note FROM documents""")
def _(spark, sf_dir):
    """X01, X03."""
    none = F.array().cast("array<string>")
    title = fields.title_of(F.when(F.col("doc_id") % 3 == 0, " A catalog title ").otherwise("abc"), F.when(F.col("doc_id") % 3 == 1, "From the model"))
    listed = F.when(F.col("doc_id") % 4 == 0, F.array(*[F.lit(f"Bureau {x} (issuing body)") for x in "ABC"])).otherwise(none)
    agency = fields.agencies_of(listed, F.when(F.col("doc_id") % 4 == 1, F.array(F.lit("Agency M"))).otherwise(none))
    return docs_of(spark, sf_dir).select("doc_id", title["value"].alias("title"), title["confidence"].alias("title_confidence"), F.array_join(agency["value"], "|").alias("agencies"), agency["confidence"].alias("agency_confidence"), agency["note"].alias("note"))


@query("catalog_headers", """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'USFS' WHEN 1 THEN 'BLM' END AS agency, CASE WHEN doc_id % 3 = 1 THEN 'lead agency is BLM' END AS warning, CAST(CASE WHEN doc_id % 2 = 0 THEN 1990 ELSE 1985 END AS INT) AS year, CASE WHEN doc_id % 2 = 0 THEN '1990-05' ELSE '1985' END AS date, CASE WHEN doc_id % 2 = 0 THEN 'year_mismatch: METS=1990 vs extracted=1985 — using METS' END AS year_warning,
CASE WHEN doc_id % 5 = 0 THEN 'METS title' ELSE substring(list_filter([regexp_replace(x, '^\\s+|\\s+$', '', 'g') for x in regexp_split_to_array(text, '\\n')], lambda x: length(x) > 10)[1], 1, 200) END AS title FROM documents""")
def _(spark, sf_dir):
    """X34, F11, F14."""
    names = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("Forest Service"))).when(F.col("doc_id") % 3 == 1, F.array(F.lit("Bureau of Land Management"))).otherwise(F.array().cast("array<string>"))
    head = fields.catalog_only(F.lit("T"), F.lit("1990"), names)
    dated = fields.catalog_year_or_text(F.when(F.col("doc_id") % 2 == 0, "1990-05"), F.lit("In 1985 and again in 1985"), F.lit(""))
    return docs_of(spark, sf_dir).select("doc_id", head["agency"]["value"].alias("agency"), head["warning"].alias("warning"), dated["year"].alias("year"), dated["date"].alias("date"), dated["warning"].alias("year_warning"), fields.first_line_title(F.when(F.col("doc_id") % 5 == 0, "METS title"), F.col("text")).alias("title"))


@query("triaged_entities", """SELECT doc_id, v.name, v.kind FROM documents, (VALUES ('A Board', 'ner', 'organization'), ('Jane Roe', 'ner', 'person'), ('Old Tribe', 'dictionary', 'unknown')) AS v(name, source, kind) WHERE v.source = 'dictionary' OR doc_id % 3 <> 0 OR v.name = 'A Board'""")
def _(spark, sf_dir):
    """A model keeps a board in every third document, and answers for no other."""
    ids = docs_of(spark, sf_dir).select("doc_id")
    rows = ids.select("doc_id", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(s).alias("source")) for n, s in (("A Board", "ner"), ("Jane Roe", "ner"), ("Old Tribe", "dictionary"))])).alias("x")).select("doc_id", "x.name", "x.source")
    kept = entities.triaged(rows, ids.where("doc_id % 3 = 0").withColumn("name", F.lit("A Board")), ["dictionary"])
    return kept.select("doc_id", "name", entities.entity_type(F.col("name"), F.array(F.lit("Jane Roe")), F.array(F.lit("A Board"))).alias("kind"))


@query("critic_pages", """SELECT doc_id, f AS field, CASE f WHEN 'title' THEN '1-3' WHEN 'themes' THEN '' WHEN 'summary' THEN array_to_string(list_transform(range(0, 8), lambda i: (doc_id + i) || '-' || (doc_id + i)), ',') ELSE array_to_string(list_transform(range(0, 10), lambda i: (doc_id + i) || '-' || (doc_id + i)), ',') END AS pages FROM documents, (VALUES ('title'), ('themes'), ('summary'), ('location')) AS v(f)""")
def _(spark, sf_dir):
    """Distinct spans, the first eight of a summary."""
    spans = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.concat((F.col("doc_id") + i).cast("string"), F.lit("-"), (F.col("doc_id") + i).cast("string")))
    rows = docs_of(spark, sf_dir).select("doc_id", F.explode(F.array(*map(F.lit, ("title", "themes", "summary", "location")))).alias("field"), F.concat(spans, spans).alias("spans"))
    return rows.select("doc_id", "field", F.array_join(selection.critic_pages(F.col("field"), "1-3", F.col("spans")), ",").alias("pages"))


@query("samples_of_texts", """SELECT doc_id, md5(CASE WHEN length(text) > 1500 THEN substring(text, 1, 500) || chr(10) || chr(10) || '[...]' || chr(10) || chr(10) || substring(text, CAST(floor(length(text) / 2.0 - 250) AS BIGINT) + 1, 500) || chr(10) || chr(10) || '[...]' || chr(10) || chr(10) || right(text, 500) ELSE text END) AS sampled, md5(substring(text, 401, 400) || CASE WHEN length(text) > 800 THEN chr(12) || substring(text, 801, 400) ELSE '' END) AS pages FROM documents WHERE length(text) > 400""")
def _(spark, sf_dir):
    """Head, middle and tail; the second and third piece joined by a form feed."""
    docs = docs_of(spark, sf_dir)
    pieces = segment.fixed_chunks(docs, 400, 400).select("doc_id", (F.col("chunk") + 1).alias("page"), "text")
    return lookup.pages_text(pieces, 2, 3).select("doc_id", F.md5("text").alias("pages")).join(docs.select("doc_id", F.md5(segment.sampled_text(F.col("text"), 500)).alias("sampled")), "doc_id").select("doc_id", "sampled", "pages")


@query("chunk_entities", f"""WITH {_CHUNKS}, a AS (SELECT doc_id, chunk_index, {_DIGIT} AS k FROM (SELECT *, 'X ' || text || ' ' || chunk_index AS prompt FROM c))
SELECT doc_id, chunk_index AS chunk, CAST(CASE WHEN k < 8 THEN 2 WHEN k < 10 THEN 1 END AS INT) AS n, CASE WHEN k >= 12 THEN 'not recorded' END AS error, k BETWEEN 10 AND 11 AS dead FROM a""")
def _(spark, sf_dir):
    """Answers of every chunk, salvaged where they are cut off, dead letters where they hold no JSON."""
    chunks = segment.fixed_chunks(docs_of(spark, sf_dir), 400, 400).select("doc_id", F.col("chunk").cast("int").alias("chunk"), "text")
    prompts = fields.chunk_prompts(chunks, "X {text} {chunk}", "light")
    answers = replay(prompts, F.when(digit() < 8, '{"entities": [{"entity": "a"}, {"entity": "b"}]}').when(digit() < 10, '{"entities": [{"entity": "a"}, {"enti').when(digit() < 12, "I found none"))
    got = model.answered(prompts, answers)
    dead = model.dead_letters(got).select("prompt_hash").distinct().withColumn("dead", F.lit(True))
    n = F.size(F.try_variant_get("parsed", "$.entities", "array<variant>"))
    return got.join(dead, "prompt_hash", "left").select("doc_id", "chunk", F.when(n >= 0, n).alias("n"), "error", F.coalesce("dead", F.lit(False)).alias("dead"))

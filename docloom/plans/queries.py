"""The registered queries of the document operators, each with SQL for the same rows where SQL has a form for it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import spans as sp
from docloom.functions import text as tx
from docloom.operators import entities, fields, lookup, model, retrieval, segment, selection, usage, validate
from docloom.plans import records, vocab
from docloom.plans.views import EIS, MENTIONS, USAGE, VERDICTS, eis, mentions, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def docs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


E_ = f"WITH e AS ({EIS})"

# the flagship: mentions, verified quotes, one entry for each entity and stance

_KEY = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(entity), '\([^)]*\)', ' ', 'g'), '[^\w\s]', ' ', 'g'), '\b(mr|ms|mrs|dr|sen|senator|rep|representative|gov|governor|hon|honorable|the|a|an)\b', ' ', 'g'), '\s+', ' ', 'g'))"""
_MERGED = f"""WITH m AS ({MENTIONS}), t AS (SELECT conv_id AS doc_id, regexp_replace(string_agg(text, chr(10) ORDER BY turn), '\\s+', ' ', 'g') AS full FROM conversations GROUP BY conv_id),
v AS (SELECT m.* REPLACE (regexp_replace(quote, '^\\s+|\\s+$', '', 'g') AS quote), {_KEY} AS k, contains(t.full, trim(regexp_replace(quote, '\\s+', ' ', 'g'))) AND trim(quote) <> '' AS ok FROM m JOIN t USING (doc_id)),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, k, stance ORDER BY chunk_index, entity, ord) AS p FROM v),
kinds AS (SELECT doc_id, k, stance, arg_max(kind, n * 100000 - f) AS kind FROM (SELECT doc_id, k, stance, kind, count(*) AS n, min(p) AS f FROM o GROUP BY ALL) GROUP BY ALL),
g AS (SELECT doc_id, k, stance, arg_max(entity, length(entity) * 100000 - p) AS entity, coalesce(arg_max(role, length(role) * 100000 - p) FILTER (role <> ''), '') AS role,
  arg_max(quote, (CASE WHEN ok THEN 1000000000 ELSE 0 END) + length(quote) * 100000 - p) AS summary_quote, bool_or(ok) AS summary_quote_verified,
  arg_max(attribution_mode, (CASE WHEN ok THEN 1000000000 ELSE 0 END) + length(quote) * 100000 - p) AS attribution_mode,
  array_to_string(list_sort(list_distinct(list(attribution_mode))), ',') AS modes, count(*) AS n_mentions, min(chunk_index) AS first_chunk,
  array_to_string(list(page_span ORDER BY p), ',') AS pages FROM o GROUP BY ALL)
SELECT g.doc_id, CAST(row_number() OVER (PARTITION BY g.doc_id ORDER BY first_chunk, lower(entity), stance, entity) AS INT) AS sequence, entity, kind, role, stance, attribution_mode, modes, summary_quote, summary_quote_verified, pages, CAST(n_mentions AS INT) AS n_mentions FROM g JOIN kinds USING (doc_id, k, stance)"""


def merged_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who takes which stance in each conversation, with verified quotes."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    # a conversation is a bounded unit; its turns are put together in order
    texts = turns.groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("text"))
    rows = entities.clean_mentions(mentions(spark, sf_dir).withColumns({"start_page": F.lit(1), "end_page": F.lit(1)}))
    return entities.merged(entities.verified(rows, texts))


@query("merge_entries", _MERGED)
def _(spark, sf_dir):
    out = merged_entries(spark, sf_dir)
    return out.select("doc_id", "sequence", "entity", "kind", "role", "stance", "attribution_mode", F.array_join("attribution_modes_seen", ",").alias("modes"), "summary_quote", "summary_quote_verified", F.array_join("evidence_pages", ",").alias("pages"), "n_mentions")


@query("clean_mentions", f"""SELECT doc_id, ord, entity, CASE WHEN kind IN ('organization', 'individual') THEN kind ELSE 'other' END AS kind, stance, 'direct_quote' AS attribution_mode FROM ({MENTIONS}) WHERE stance <> 'neutral' AND trim(quote) <> ''""")
def _(spark, sf_dir):
    """P08 on rows with unknown stances, kinds and modes."""
    raw = mentions(spark, sf_dir).withColumns({"start_page": F.lit(1), "end_page": F.lit(2), "stance": F.when(F.col("stance") == "neutral", "unsure").otherwise(F.concat(F.lit(" "), F.upper("stance"))), "kind": F.when(F.col("kind") == "agency", "bureau").otherwise(F.col("kind")), "attribution_mode": F.lit("said")})
    return entities.clean_mentions(raw).select("doc_id", "ord", "entity", "kind", "stance", "attribution_mode")


# pages, chunks, chapters and sections


@query("page_arithmetic", """SELECT doc_id, CAST(CASE WHEN length(text) = 0 THEN 0 ELSE ceil(length(text) / 2500.0) END AS INT) AS pages, md5(substring(text, 1, 2500)) AS first_page, md5(right(text, 2500)) AS last_page,
CAST(length(text) // 2 // 2500 + 1 AS INT) AS middle_page, CAST(least(length(text), 2500) AS INT) AS s2, CAST(greatest(least(length(text), 5000), least(length(text), 2500)) AS INT) AS e2,
CASE WHEN ceil(length(text) / 2500.0) < 2 THEN 'short' WHEN ceil(length(text) / 2500.0) < 8 THEN 'medium' ELSE 'long' END AS bucket, 'sha256:' || sha256(text) AS text_id, CAST(length(text) // 4 AS INT) AS token_estimate FROM documents""")
def _(spark, sf_dir):
    """P01-P03, P07, J03, J04, F19, F21."""
    n = F.length("text")
    two = tx.chars_of_pages(F.lit(2), F.lit(2), n)
    return docs_of(spark, sf_dir).select("doc_id", tx.estimated_pages("text").alias("pages"), F.md5(tx.first_pages("text", 1)).alias("first_page"), F.md5(tx.last_pages("text", 1)).alias("last_page"), tx.page_of(F.floor(n / 2)).alias("middle_page"), two["start"].alias("s2"), two["end"].alias("e2"), tx.length_bucket(tx.estimated_pages("text"), 2, 8).alias("bucket"), tx.text_id("text").alias("text_id"), tx.token_estimate("text").alias("token_estimate"))


@query("fixed_chunks", """SELECT doc_id, CAST(k AS INT) AS chunk, CAST(k * 2400 AS INT) AS start, CAST(least(k * 2400 + 2500, n) AS INT) AS "end", md5(substring(text, CAST(k * 2400 + 1 AS BIGINT), 2500)) AS h
FROM (SELECT doc_id, text, length(text) AS n, unnest(range(0, CAST(greatest(0, ceil((length(text) - 2500) / 2400.0)) AS BIGINT) + 1)) AS k FROM documents WHERE length(text) > 0)""")
def _(spark, sf_dir):
    """C01."""
    return segment.fixed_chunks(docs_of(spark, sf_dir), 2500, 2400).select("doc_id", F.col("chunk").cast("int"), F.col("start").cast("int"), F.col("end").cast("int"), F.md5("text").alias("h"))


_PAGES = """WITH RECURSIVE l AS (SELECT doc_id, i, n, s FROM (SELECT doc_id, i, length(p) + (CASE WHEN i < k THEN 1 ELSE 0 END) AS n, sum(length(p) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(p) - 1 AS s FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i, len(string_split(text, chr(10))) AS k FROM documents)) WHERE n > 0),
w AS (SELECT doc_id, i, n, s, 1 AS page, s AS start, n AS acc FROM l WHERE i = 1
 UNION ALL SELECT l.doc_id, l.i, l.n, l.s, CASE WHEN w.acc >= 2500 THEN w.page + 1 ELSE w.page END, CASE WHEN w.acc >= 2500 THEN l.s ELSE w.start END, CASE WHEN w.acc >= 2500 THEN l.n ELSE w.acc + l.n END FROM w JOIN l ON l.doc_id = w.doc_id AND l.i = w.i + 1)
SELECT doc_id, CAST(page AS INT) AS page, CAST(start AS INT) AS start, CAST(max(s + n) AS INT) AS "end" FROM w GROUP BY ALL"""


@query("line_pages", _PAGES)
def _(spark, sf_dir):
    """C02."""
    return segment.line_pages(docs_of(spark, sf_dir))


@query("page_lookup", f"""{_PAGES.replace('SELECT doc_id, CAST(page', ', pg AS (SELECT doc_id, CAST(page', 1)}) SELECT d.doc_id, max(CASE WHEN pg.start <= length(text) // 2 AND length(text) // 2 < pg."end" THEN page END) AS middle,
max(CASE WHEN pg.start <= length(text) - 1 AND length(text) - 1 < pg."end" THEN page END) AS last, CAST(min(CASE WHEN pg.start <= 2500 AND 2500 <= pg."end" THEN page END) AS INT) AS closed FROM documents d JOIN pg USING (doc_id) WHERE length(text) > 0 GROUP BY d.doc_id""")
def _(spark, sf_dir):
    """Half-open and closed interval lookups."""
    rows = docs_of(spark, sf_dir).where(F.length("text") > 0).select("doc_id", F.length("text").alias("n"), sp.line_pages("text").alias("ps"))
    half = F.floor(F.col("n") / 2).cast("int")
    both = sp.page_range(F.col("ps"), half, F.col("n"))
    return rows.select("doc_id", both["first"].alias("middle"), both["last"].alias("last"), sp.contains_offset(F.col("ps"), F.lit(2500), closed=True)["page"].alias("closed"))


_LINES = """l AS (SELECT doc_id, i, p, n, CAST(sum(length(p) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(p) - 1 AS INT) AS s, i < k AS ended FROM (SELECT doc_id, length(text) AS n, unnest(string_split(text, chr(10))) AS p, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i, len(string_split(text, chr(10))) AS k FROM e))"""
_MARKER = r"^(?:\s*(?:CHAPTER|Chapter|SECTION|Section)\s+[\w.]+|\s*[A-Z]\.|\s*[IVXLC]+\.|\s*\d+(?:\.\d+)?\s*[:.\-–])\s*"
_CLEAN = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(p)), '^(?:chapter|section)\s+[\w.]+\s*[:.\-–]?\s*', ''), '^[ivxlc]+\.\s*', ''), '^[a-z]\.\s*', ''), '^\d+(?:\.\d+)?\s*[:.\-–]?\s*', ''))"
_CHAPTER = "CASE " + " ".join(f"WHEN regexp_matches(h, '^(?:{'|'.join(a)})(?:$|[ :])') THEN '{c}'" for c, a in vocab.CHAPTERS.items()) + " END"
_CHAPTERS = f"""{E_}, {_LINES}, c AS (SELECT doc_id, n, s, trim(p) AS label, {_CLEAN} AS h FROM l WHERE ended AND length(p) BETWEEN 1 AND 100 AND s >= 300 AND trim(p) <> '' AND (regexp_matches(trim(p), '{_MARKER}')
 OR (NOT regexp_matches(trim(p), '[.,;:]$') AND length(regexp_replace(p, '\\P{{L}}', '', 'g')) > 0 AND length(regexp_replace(p, '\\P{{Lu}}', '', 'g')) >= 0.7 * length(regexp_replace(p, '\\P{{L}}', '', 'g'))))),
h AS (SELECT *, {_CHAPTER} AS chapter FROM c), r AS (SELECT doc_id, chapter, label, s AS start, coalesce(lead(s) OVER (PARTITION BY doc_id ORDER BY s), n) AS fin FROM h WHERE chapter IS NOT NULL),
b AS (SELECT doc_id, chapter, label, start, CAST(fin AS INT) AS "end" FROM r QUALIFY row_number() OVER (PARTITION BY doc_id, chapter ORDER BY fin - start DESC, start) = 1)"""


@query("chapters", f"{_CHAPTERS} SELECT * FROM b")
def _(spark, sf_dir):
    """C04, C05, P13, P14, with every line read."""
    return segment.chapters(eis(spark, sf_dir), guard=300)


@query("chunk_chapters", f"""{_CHAPTERS}, k AS (SELECT doc_id, CAST(i AS INT) AS chunk, i * 500 AS s, least(i * 500 + 600, n) AS f FROM (SELECT doc_id, length(text) AS n, unnest(range(0, CAST(greatest(0, ceil((length(text) - 600) / 500.0)) AS BIGINT) + 1)) AS i FROM e))
SELECT k.doc_id, chunk, arg_min(chapter, start) AS chapter FROM k LEFT JOIN b ON b.doc_id = k.doc_id AND start <= (s + f) // 2 AND (s + f) // 2 < "end" GROUP BY k.doc_id, chunk""")
def _(spark, sf_dir):
    """Chunks by the chapter of their midpoint."""
    docs = eis(spark, sf_dir)
    return segment.labelled_chunks(segment.fixed_chunks(docs, 600, 500).drop("text"), segment.chapters(docs, guard=300)).select("doc_id", F.col("chunk").cast("int"), "chapter")


@query("chapter_text", f"""{_CHAPTERS} SELECT doc_id, md5(substring(text, start + 1, "end" - start)) AS h, CAST(start // 2500 + 1 AS INT) AS first_page, CAST("end" // 2500 + 1 AS INT) AS last_page FROM b JOIN e USING (doc_id) WHERE chapter = 'Alternatives'""")
def _(spark, sf_dir):
    """C07."""
    docs = eis(spark, sf_dir)
    out = segment.chapter_text(docs, segment.chapters(docs, guard=300), "Alternatives")
    return out.select("doc_id", F.md5("text").alias("h"), "first_page", "last_page")


_SECTION = "CASE " + " ".join(f"WHEN regexp_matches(trim(p), '^(?i)(?:{p})$') THEN '{s}'" for s, p in vocab.SECTION_HEADINGS.items()) + " END"
_REJECT = " OR ".join(f"regexp_matches(win, '{p}')" for p in vocab.SECTION_REJECTS)
_SECTIONS = f"""{E_}, {_LINES}, z AS (SELECT l.doc_id, l.n, {_SECTION} AS section, s + length(p) AS fin, length(regexp_replace(substring(text, 1, s), '\\s+$', '')) AS k, text, s AS s0 FROM l JOIN e USING (doc_id)),
y AS (SELECT doc_id, n, section, fin, text, CAST(CASE WHEN k = 0 THEN 0 ELSE k + position(chr(10) IN substring(text, k + 1, s0 - k)) END AS INT) AS s FROM z WHERE section IS NOT NULL),
a AS (SELECT doc_id, n, section, s, substring(text, greatest(0, s - 60) + 1, fin + 60 - greatest(0, s - 60)) AS win FROM y),
f AS (SELECT doc_id, n, section, min(s) AS start FROM a WHERE section IS NOT NULL AND NOT ({_REJECT}) GROUP BY ALL), x AS (SELECT doc_id, section, start, CAST(coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY start), n) AS INT) AS fin FROM f)"""


@query("sections", f"""{_SECTIONS}, names(ord, section) AS (VALUES {', '.join(f"({k}, '{s}')" for k, s in enumerate(vocab.SECTIONS))})
SELECT e.doc_id, names.section, ord, CASE WHEN names.section = 'cover' THEN 0 ELSE start END AS start, x.fin AS "end", CASE WHEN names.section = 'cover' OR start IS NOT NULL THEN 'ok' ELSE 'not_found' END AS status,
CASE WHEN names.section = 'cover' THEN 'default_pages' WHEN start IS NOT NULL THEN 'regex' ELSE 'none' END AS method FROM e CROSS JOIN names LEFT JOIN x ON x.doc_id = e.doc_id AND x.section = names.section""")
def _(spark, sf_dir):
    """Nine rows for each document; the cover's end is tested elsewhere."""
    out = segment.sections(eis(spark, sf_dir))
    return out.select("doc_id", "section", "ord", "start", F.when(F.col("section") != "cover", F.col("end")).alias("end"), "status", "method")


@query("section_titles", "SELECT t AS title, s AS section FROM (VALUES ('Executive Summary', 'summary'), ('RECORD OF DECISION', 'rod'), ('Comments and Responses on the plan', 'response_to_comments'), ('Letters received', 'public_comments'), ('Impact analysis', 'environmental_consequences'), ('The alternatives we saw', 'alternatives'), ('Need for action', 'purpose_and_need'), ('Existing conditions today', 'affected_environment'), ('Index', NULL)) AS v(t, s)")
def _(spark, sf_dir):
    """C12."""
    titles = ["Executive Summary", "RECORD OF DECISION", "Comments and Responses on the plan", "Letters received", "Impact analysis", "The alternatives we saw", "Need for action", "Existing conditions today", "Index"]
    return spark.createDataFrame([(t,) for t in titles], "title string").select("title", tx.section_of("title").alias("section"))


@query("anchors", f"{E_} SELECT doc_id, CAST(position('Alternative B-1' IN text) - 1 AS INT) AS exact, CAST(position('alternative b-1' IN lower(text)) - 1 AS INT) AS folded, CAST(position('No  Action choice' IN text) - 1 AS INT) AS spaced, CAST(NULL AS INT) AS missing FROM e")
def _(spark, sf_dir):
    """C15, and C13 by it."""
    at = lambda a: tx.locate_anchor(F.col("text"), F.lit(a)).cast("int")
    return eis(spark, sf_dir).select("doc_id", at("Alternative B-1").alias("exact"), at("ALTERNATIVE b-1").alias("folded"), at("no action  choice").alias("spaced"), at("Alternative Z-9").alias("missing"))


@query("toc_headings")
def _(spark, sf_dir):
    """C20, P09."""
    return segment.toc_headings(eis(spark, sf_dir), least=1)


@query("toc_sections")
def _(spark, sf_dir):
    """Headings that a model named fill missing sections."""
    docs = eis(spark, sf_dir)
    titles = docs.select("doc_id", F.lit(1).alias("ord"), F.lit("Purpose and need for the project").alias("title"), F.lit("Alternative A keeps").alias("anchor"))
    return segment.sections(docs, segment.toc_sections(docs, titles)).select("doc_id", "section", "start", "end", "confidence", "status", "method")


@query("descriptor_match", """WITH u AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), d AS (SELECT vec_id AS name, v AS w FROM u WHERE vec_id < 5),
s AS (SELECT label AS key, name, vec_id AS item, list_dot_product(v, w) / sqrt(list_dot_product(v, v) * list_dot_product(w, w)) AS score FROM u, d), r AS (SELECT *, row_number() OVER (PARTITION BY key, name ORDER BY score DESC, item) AS r FROM s)
SELECT a.key, a.name, a.item AS best, CASE WHEN a.score - coalesce(b.score, 0) < 0.1 THEN 'ambiguous' ELSE 'ok' END AS status FROM r a LEFT JOIN r b ON a.key = b.key AND a.name = b.name AND b.r = 2 WHERE a.r = 1 AND a.score >= 0.2""")
def _(spark, sf_dir):
    """C16."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    out = segment.nearest_descriptor(v.select(F.col("label").alias("key"), F.col("vec_id").alias("item"), "embedding"), v.where("vec_id < 5").select(F.col("vec_id").alias("name"), "embedding"), threshold=0.2)
    return out.select("key", "name", "best", "status")


@query("candidate_headings", rf"""WITH e AS (SELECT doc_id, text FROM documents), {_LINES}, t AS (SELECT doc_id, s AS start, trim(p) AS line FROM l) SELECT * FROM t WHERE length(line) BETWEEN 4 AND 80 AND regexp_matches(line, '^\p{{Lu}}') AND right(line, 1) <> '.'
AND (length(regexp_replace(line, '\P{{Lu}}', '', 'g')) >= 0.5 * length(regexp_replace(line, '\P{{L}}', '', 'g')) OR NOT regexp_matches(line, '(?:^|[^\p{{L}}])\p{{Ll}}|\p{{L}}\p{{Lu}}'))""")
def _(spark, sf_dir):
    """P15."""
    return segment.candidate_headings(docs_of(spark, sf_dir))


@query("document_chunks")
def _(spark, sf_dir):
    """One chunk, one a section, or blocks of pages."""
    docs = docs_of(spark, sf_dir)
    pages = segment.line_pages(docs)
    categories = docs.select("doc_id", tx.length_category(tx.n_words("text"), 200, 2000).alias("length_category"))
    known = pages.where("doc_id % 7 = 0").select("doc_id", F.col("page").alias("first_page"), F.col("page").alias("last_page"))
    return segment.document_chunks(pages, categories, known, 2)


# comments, sentences and labels

_BLOCKS = f"""{E_}, k AS (SELECT doc_id, text, length(text) AS n, CAST(position('COMMENT 1:' IN text) - 1 AS INT) AS a, CAST(position('COMMENT 2:' IN text) - 1 AS INT) AS b, CAST(position(concat(chr(10), 'Response:', chr(10)) IN text) AS INT) AS r FROM e)"""


@query("comment_blocks", f"""{_BLOCKS} SELECT doc_id, 'block_1' AS block_id, a AS start, b AS "end", a AS comment_start, r AS comment_end, CAST(r + 9 AS INT) AS response_start, b AS response_end, 'ok' AS split_status FROM k
UNION ALL SELECT doc_id, 'block_2', b, CAST(n AS INT), b, CAST(n AS INT), NULL, NULL, 'no_response' FROM k""")
def _(spark, sf_dir):
    """C21, C23, C26."""
    docs = eis(spark, sf_dir)
    return segment.block_parts(docs, segment.comment_blocks(docs)).drop("ord")


@query("block_sentences", f"""{_BLOCKS}, s(block, i, lead, txt, c) AS (VALUES ('block_1', 1, 'a', 'COMMENT 1: We oppose the road because of noise.', true), ('block_1', 2, 'a', 'It should not be built here.', true), ('block_1', 3, 'r', 'Noted.', false), ('block_1', 4, 'r', 'The agency agrees.', false), ('block_2', 1, 'b', 'COMMENT 2: The county strongly supports Alternative A.', true), ('block_2', 2, 'b', 'We urge action now.', true))
SELECT doc_id, concat(block, '_s', i) AS span_id, trim(txt) AS sentence, c AS is_comment_text FROM k CROSS JOIN s""")
def _(spark, sf_dir):
    """C24, C25."""
    docs = eis(spark, sf_dir)
    spans = segment.block_sentences(docs, segment.block_parts(docs, segment.comment_blocks(docs)))
    return spans.join(docs, "doc_id").select("doc_id", "span_id", tx.strip(tx.slice_of("text", F.col("start"), F.col("end"))).alias("sentence"), "is_comment_text")


@query("cued_quotes", f"""{_BLOCKS} SELECT doc_id, 'block_1' AS block_id, 'It should not be built here.' AS quote, 2 AS score FROM k WHERE false
UNION ALL SELECT doc_id, 'block_1', 'COMMENT 1: We oppose the road because of noise.', 1 FROM k UNION ALL SELECT doc_id, 'block_2', 'COMMENT 2: The county strongly supports Alternative A.', 3 FROM k""")
def _(spark, sf_dir):
    """The sentence of a comment with the most cues."""
    docs = eis(spark, sf_dir)
    spans = segment.block_sentences(docs, segment.block_parts(docs, segment.comment_blocks(docs))).where("is_comment_text")
    texts = lookup.neighbours(spans.join(docs, "doc_id").withColumn("text", tx.strip(tx.slice_of("text", F.col("start"), F.col("end")))))
    ranked = retrieval.cued_spans(texts)
    best = fields.chosen_quote(ranked.select("doc_id", "block_id", "rank", "span_id"))
    return best.join(ranked, ["doc_id", "block_id", "span_id"]).select("doc_id", "block_id", F.col("text").alias("quote"), "score")


@query("paragraphs")
def _(spark, sf_dir):
    """C22, and C21 without headers."""
    return segment.comment_blocks(docs_of(spark, sf_dir), 900)


@query("alternative_labels", f"""{E_} SELECT doc_id, label, rank, CAST(position(raw IN text) - 1 AS INT) AS start FROM e CROSS JOIN (VALUES ('Alternative A', 'Alternative A ', 1), ('Alternative B-1', 'Alternative B-1', 2), ('No Action', 'No  Action', 3), ('Preferred Alternative', 'Preferred Alternative', 4)) AS v(label, raw, rank)""")
def _(spark, sf_dir):
    """W02, F07, J21, J24."""
    docs = eis(spark, sf_dir)
    got = retrieval.retrieved(docs, segment.sections(docs), ["alternatives"], ["Alternative"])
    return retrieval.labels(docs, got.select("doc_id", "n", "start", "end")).select("doc_id", "label", "rank", "start")


@query("described_labels", f"""{_SECTIONS} SELECT doc_id, label, CAST(position(raw IN text) - 1 AS INT) AS start, CAST(position(raw IN text) - 1 + length(raw) AS INT) AS "end", rank, CASE WHEN rank <> 2 THEN 'About ' || label ELSE '' END AS description, CASE WHEN rank <> 2 AND doc_id IN (SELECT doc_id FROM x WHERE section = 'alternatives' AND start IS NOT NULL) THEN 'ok' ELSE 'needs_review' END AS status FROM e CROSS JOIN (VALUES ('Alternative A', 'Alternative A', 1), ('Alternative B-1', 'Alternative B-1', 2), ('No Action', 'No  Action', 3), ('Preferred Alternative', 'Preferred Alternative', 4)) AS v(label, raw, rank)""")
def _(spark, sf_dir):
    """Statuses of labels by a model's descriptions and the source of the text."""
    docs = eis(spark, sf_dir)
    got = retrieval.retrieved(docs, segment.sections(docs), ["alternatives"], ["Alternative"])
    found = retrieval.labels(docs, got.select("doc_id", "n", "start", "end"))
    said = found.where("rank <> 2").select("doc_id", "label", F.concat(F.lit("About "), "label").alias("description"), F.lit(True).alias("found"))
    return fields.described_labels(found, said, got.select("doc_id", "degraded"))


# retrieval

@query("keyword_windows", """WITH t AS (SELECT doc_id, text, length(text) AS n, regexp_split_to_array(text, '(?i)\\b(?:quality|reblehe|thatthe)\\b') AS ps, regexp_extract_all(text, '(?i)\\b(?:quality|reblehe|thatthe)\\b') AS ms FROM documents),
h AS (SELECT doc_id, n, i, list_sum([length(x) for x in ps[1:i]]) + coalesce(list_sum([length(x) for x in ms[1:i - 1]]), 0) AS s, length(ms[i]) AS k FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM t) WHERE i <= 33),
w AS (SELECT doc_id, i, greatest(0, s - 100) AS a, least(n, s + k + 100) AS z FROM h), g AS (SELECT *, max(z) OVER (PARTITION BY doc_id ORDER BY a, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM w),
x AS (SELECT *, sum(CASE WHEN before IS NULL OR a > before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY a, i) AS island FROM g)
SELECT doc_id, CAST(island AS INT) AS n, CAST(min(a) AS INT) AS start, CAST(max(z) AS INT) AS "end" FROM x GROUP BY doc_id, island HAVING island <= 8""")
def _(spark, sf_dir):
    """J22."""
    return retrieval.keyword_windows(docs_of(spark, sf_dir), ["quality", "reblehe", "thatthe"], width=200)


@query("retrieval_cascade", f"""{_SECTIONS} SELECT e.doc_id, CASE WHEN x.start IS NULL THEN 'fallback_first_n' ELSE 'regex' END AS source, x.section, CAST(coalesce(x.start, 0) AS INT) AS start, CAST(coalesce(x.fin, least(length(text), 400)) AS INT) AS "end", x.start IS NULL AS degraded
FROM e LEFT JOIN (SELECT * FROM x WHERE section IN ('purpose_and_need', 'environmental_consequences') QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY CASE section WHEN 'purpose_and_need' THEN 0 ELSE 1 END) = 1) x ON x.doc_id = e.doc_id""")
def _(spark, sf_dir):
    """J21-J25, X20."""
    docs = eis(spark, sf_dir)
    got = retrieval.retrieved(docs, segment.sections(docs), ["purpose_and_need", "environmental_consequences"], ["zebra crossing"], first=400)
    return got.select("doc_id", "source", "section", "start", "end", "degraded")


def chunk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 400 characters with tags, titles and a used flag by rule."""
    rows = segment.fixed_chunks(docs_of(spark, sf_dir), 400, 400)
    tags = F.when(F.col("chunk") % 3 == 0, F.array(F.lit("alternatives"), F.lit("mitigation"))).when(F.col("chunk") % 3 == 1, F.array(F.lit("mitigation"))).otherwise(F.array().cast("array<string>"))
    return rows.select("doc_id", F.col("chunk").cast("int").alias("chunk_index"), F.format_string("c%02d", F.col("chunk").cast("int") + 1).alias("chunk_id"), "text", tags.alias("tags"), ((F.col("doc_id") + F.col("chunk")) % 5 != 0).alias("used"), F.concat(F.lit("part "), F.col("chunk").cast("int")).alias("title"), (F.col("chunk") + 1).cast("int").alias("first_page"), (F.col("chunk") + 1).cast("int").alias("last_page"), F.when(F.col("chunk") % 3 == 0, "Alternatives").alias("chapter"))


_CHUNKS = """c AS (SELECT doc_id, CAST(k AS INT) AS chunk_index, substring(text, CAST(k * 400 + 1 AS BIGINT), 400) AS text, (doc_id + k) % 5 <> 0 AS used, k % 3 AS m, 'c' || lpad(CAST(k + 1 AS VARCHAR), CAST(greatest(2, length(CAST(k + 1 AS VARCHAR))) AS INTEGER), '0') AS chunk_id FROM (SELECT doc_id, text, unnest(range(0, CAST(greatest(0, ceil((length(text) - 400) / 400.0)) AS BIGINT) + 1)) AS k FROM documents WHERE length(text) > 0))"""
_COUNT = "CAST((length(lower(text)) - length(replace(lower(text), 'the', ''))) / 3 + (length(lower(text)) - length(replace(lower(text), 'ing', ''))) / 3 AS BIGINT)"
_RANKED = f"""WITH {_CHUNKS}, a AS (SELECT doc_id, chunk_index, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY m, chunk_index) AS INT) AS rank FROM c WHERE used AND m < 2 QUALIFY rank <= 8),
b AS (SELECT doc_id, chunk_index, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY {_COUNT} DESC, chunk_index) AS INT) AS rank FROM c WHERE used AND {_COUNT} > 0 QUALIFY rank <= 8)"""


@query("chunks_by_tags", f"{_RANKED} SELECT * FROM a")
def _(spark, sf_dir):
    """J18."""
    return retrieval.by_tags(chunk_table(spark, sf_dir), ["alternatives", "mitigation"]).select("doc_id", "chunk_index", "rank")


@query("chunks_by_keywords", f"{_RANKED} SELECT * FROM b")
def _(spark, sf_dir):
    """J19."""
    return retrieval.by_keywords(chunk_table(spark, sf_dir), ["the", "ING"]).select("doc_id", "chunk_index", "rank")


@query("chunks_either", f"{_RANKED}, u AS (SELECT doc_id, chunk_index, 0 AS s, rank AS r FROM a UNION ALL SELECT doc_id, chunk_index, 1, rank FROM b), o AS (SELECT doc_id, chunk_index, min(s * 100 + r) AS o FROM u GROUP BY ALL) SELECT doc_id, chunk_index, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY o) AS INT) AS rank FROM o QUALIFY rank <= 8")
def _(spark, sf_dir):
    """U01."""
    return retrieval.either_chunks(chunk_table(spark, sf_dir), ["alternatives", "mitigation"], ["the", "ING"])


@query("chunk_cascade", f"""{_RANKED}, t AS (SELECT doc_id, chunk_index, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) AS INT) AS rank, 'tags' AS branch FROM c WHERE used AND m = 0 AND doc_id % 2 = 0 QUALIFY rank <= 8),
k AS (SELECT doc_id, chunk_index, rank, 'keywords' AS branch FROM b WHERE doc_id NOT IN (SELECT doc_id FROM t)), f AS (SELECT doc_id, chunk_index, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) AS INT) AS rank, 'first' AS branch FROM c WHERE used AND doc_id NOT IN (SELECT doc_id FROM t UNION SELECT doc_id FROM k) QUALIFY rank <= 8)
SELECT * FROM t UNION ALL SELECT * FROM k UNION ALL SELECT * FROM f""")
def _(spark, sf_dir):
    """U02-U04."""
    chunks = chunk_table(spark, sf_dir).withColumn("tags", F.when(F.col("doc_id") % 2 == 0, F.col("tags")).otherwise(F.array().cast("array<string>")))
    return retrieval.cascade_chunks(chunks, ["alternatives"], ["the", "ING"], 8, 8)


@query("tagged_first", f"WITH {_CHUNKS}, r AS (SELECT doc_id, chunk_index, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN m = 0 THEN 0 ELSE 1 END, chunk_index) AS r FROM c QUALIFY r <= 3) SELECT doc_id, chunk_index, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) AS INT) AS rank FROM r")
def _(spark, sf_dir):
    """W03, U05."""
    return retrieval.tagged_first(chunk_table(spark, sf_dir), 3).select("doc_id", "chunk_index", "rank")


@query("packed_context", f"""WITH {_CHUNKS}, b AS (SELECT doc_id, chunk_index, '[Chunk ' || chunk_id || ' | Pages ' || (chunk_index + 1) || '–' || (chunk_index + 1) || ' | part ' || chunk_index || ']' || chr(10) || text AS block FROM c),
s AS (SELECT *, sum(length(block)) OVER (PARTITION BY doc_id ORDER BY chunk_index) AS upto FROM b), w AS (SELECT *, upto - length(block) AS before, sum(CASE WHEN upto > 1500 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY chunk_index) AS bad FROM s)
SELECT doc_id, md5(string_agg(CASE WHEN bad = 0 THEN block ELSE substring(block, 1, CAST(1500 - before AS BIGINT)) || chr(10) || '[TRUNCATED]' END, chr(10) || chr(10) ORDER BY chunk_index)) AS h FROM w WHERE bad = 0 OR (bad = 1 AND upto > 1500 AND 1500 - before > 200) GROUP BY doc_id""")
def _(spark, sf_dir):
    """W04."""
    chunks = chunk_table(spark, sf_dir).withColumn("rank", F.col("chunk_index"))
    return retrieval.packed_context(chunks, 1500).select("doc_id", F.md5("context").alias("h"))


# entities


_VARIANTS = vocab.agency_variants()
_ANY = "(?i)\\b(?:" + "|".join(re.escape(v).replace("\\ ", " ") for v in sorted({v for v, _, _ in _VARIANTS}, key=lambda v: (-len(v), v))) + ")\\b"
_SPANS = "h AS (SELECT doc_id, ms[i] AS m, list_sum([length(x) for x in ps[1:i]]) + coalesce(list_sum([length(x) for x in ms[1:i - 1]]), 0) AS s FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM t))"


@query("agency_hits", f"""{E_}, t AS (SELECT doc_id, regexp_split_to_array(text, '{_ANY}') AS ps, regexp_extract_all(text, '{_ANY}') AS ms FROM e), {_SPANS}, v(v, c) AS (VALUES {', '.join(f"('{v}', '{vocab.AGENCIES[k][0]}')" for v, k, _ in _VARIANTS)})
SELECT doc_id, c AS canonical, CAST(min(s) AS INT) AS first_at, count(*) AS n FROM h JOIN v ON lower(m) = v.v GROUP BY ALL""")
def _(spark, sf_dir):
    """J15-J17."""
    return lookup.agency_hits(eis(spark, sf_dir))


@query("scored_entities", f"""WITH {_CHUNKS}, nm(name, source, o) AS (VALUES ('the', 'ner', 1), ('Erin', 'dictionary', 2), ('and that', 'ner', 3), ('zzzz', 'dictionary', 4)),
q AS (SELECT doc_id, name, source, o, sum((length(text) - length(replace(lower(text), lower(name), ''))) // length(name)) AS n, count(*) FILTER (contains(lower(text), lower(name))) AS spread, min(chunk_index) FILTER (contains(lower(text), lower(name))) AS first_chunk FROM c, nm GROUP BY ALL)
SELECT doc_id, name, CAST(greatest(n, 1) AS BIGINT) AS n, CAST(spread AS BIGINT) AS spread, CAST(greatest(n, 1) * spread AS BIGINT) AS score, first_chunk FROM q WHERE source = 'dictionary' OR n >= 2""")
def _(spark, sf_dir):
    """A15-A17, J20, J26."""
    docs = docs_of(spark, sf_dir).where(F.length("text") > 0)
    layer = lambda *names: docs.select("doc_id", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(k).alias("ord")) for n, k in names])).alias("x")).select("doc_id", "x.name", "x.ord")
    names = entities.layered_names([("dictionary", layer(("Erin", 2), ("zzzz", 4))), ("ner", entities.distinct_names(layer(("the", 1), ("ERIN", 2), ("and that", 3), ("The", 5))))])
    chunks = segment.fixed_chunks(docs, 400, 400).select("doc_id", F.col("chunk").cast("int").alias("chunk_index"), "text")
    out = entities.scored_entities(names, chunks, ["dictionary"])
    return out.select("doc_id", "name", "n", "spread", "score", "first_chunk")


@query("name_rules", """SELECT n AS name, f AS full_name, k AS entity_text FROM (VALUES ('Jane Roe', true, true), ('UNITED STATES', false, true), ('J. van der Berg', false, true), ('Mary J. Smith-Jones', true, true), ('EPA', false, true), ('Smith', false, false), ('12/3', false, false), ('ab', false, false), ('Ana de la Cruz', true, true), ('public notice list', false, false)) AS v(n, f, k)""")
def _(spark, sf_dir):
    """P10, P11."""
    names = ["Jane Roe", "UNITED STATES", "J. van der Berg", "Mary J. Smith-Jones", "EPA", "Smith", "12/3", "ab", "Ana de la Cruz", "public notice list"]
    return spark.createDataFrame([(n,) for n in names], "name string").select("name", tx.is_full_name("name").alias("full_name"), tx.is_entity_text("name", ["public notice"]).alias("entity_text"))


# header fields


_TYPE = "CASE " + " ".join(f"WHEN regexp_matches(h, '(?i){p}') THEN '{k}'" for k, p in vocab.TYPE_PATTERNS.items()) + " END"
_SAID = f"lower(regexp_extract(c, '(?i){vocab.COVER_TYPE}', 1))"


@query("document_types", f"""{E_}, t AS (SELECT doc_id, substring(text, 1, 5000) AS h, substring(text, 1, 7500) AS c, array_to_string(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')[1:250], ' ') AS w FROM e),
f AS (SELECT doc_id, {_TYPE} AS sampled, CASE WHEN {_SAID} LIKE 'supplemental%' THEN 'Supplemental' WHEN {_SAID} LIKE 'draft%' THEN 'Draft' WHEN {_SAID} LIKE 'final%' THEN 'Final' END AS cover, list_filter([{', '.join(f"CASE WHEN regexp_matches(w, '(?i){p}') THEN '{k}' END" for k, p in vocab.TYPE_WORDS.items())}], lambda x: x IS NOT NULL) AS ws FROM t)
SELECT doc_id, coalesce(sampled, 'Unknown') AS sampled, cover, CASE WHEN len(ws) = 1 THEN ws[1] ELSE 'Unlabelled' END AS by_words, CASE WHEN cover IS NULL THEN 0.3 ELSE 0.95 END AS confidence FROM f""")
def _(spark, sf_dir):
    """P05, F12, F13, X18."""
    cover = tx.first_pages("text", 3)
    return eis(spark, sf_dir).select("doc_id", tx.document_type(F.lit(""), tx.first_pages("text", 2)).alias("sampled"), tx.cover_type(cover).alias("cover"), tx.type_by_words("text").alias("by_words"), fields.record_type(cover, F.lit(None).cast("string"), False)["confidence"].alias("confidence"))


@query("type_agreement", f"""{E_}, t AS (SELECT doc_id, {_TYPE} AS r, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 2 = 0 THEN 'Draft' ELSE 'Final' END AS m FROM (SELECT doc_id, substring(text, 1, 2500) AS h FROM e))
SELECT doc_id, coalesce(r, m, 'Unknown') AS value, CASE WHEN r = m THEN 'high' WHEN r IS NULL AND m IS NULL THEN 'low' WHEN r IS NULL OR m IS NULL THEN 'medium' ELSE 'low' END AS confidence FROM t""")
def _(spark, sf_dir):
    """X02."""
    answer = F.when(F.col("doc_id") % 7 == 0, None).when(F.col("doc_id") % 2 == 0, "Draft").otherwise("Final")
    got = fields.type_of(F.col("text"), answer)
    return eis(spark, sf_dir).select("doc_id", got["value"].alias("value"), got["confidence"].alias("confidence"))


def _top(ys: str, order: str) -> str:
    """(doc_id, y) of the most frequent year of a list column, by an order of n (count), f (first place) and y."""
    return f"SELECT doc_id, arg_max(y, {order}) AS y FROM (SELECT doc_id, y, count(*) AS n, min(i) AS f FROM (SELECT doc_id, CAST(unnest({ys}) AS INT) AS y, unnest(range(1, len({ys}) + 1)) AS i FROM l) WHERE y BETWEEN 1969 AND 2026 GROUP BY ALL) GROUP BY doc_id"


_DATED = ", ".join(f"regexp_extract_all(text, '{p}', 1)" for p in vocab.DATES)


@query("years", f"""{E_}, l AS (SELECT doc_id, regexp_extract_all(substring(text, 1, 7500), '\\b(19[6-9]\\d|20[0-2]\\d)\\b', 1) AS ys, list_concat(d, d, d, regexp_extract_all(text, '\\b(\\d{{4}})\\b', 1)) AS ws FROM (SELECT *, list_concat({_DATED}) AS d FROM e)),
a AS ({_top('ys', 'n * 1000000 - f')}), b AS ({_top('ys', 'n * 1000000 + y')}), c AS ({_top('ws', 'n * 1000000 - f')}), w AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 1970 + doc_id % 20 END AS w FROM e)
SELECT w.doc_id, a.y AS first_seen, b.y AS latest, c.y AS weighted, CAST(coalesce(w, a.y) AS INT) AS value, CASE WHEN w = a.y THEN 'high' WHEN w IS NOT NULL AND a.y IS NOT NULL THEN 'low' WHEN w IS NOT NULL THEN 'high' WHEN a.y IS NOT NULL THEN 'medium' ELSE 'low' END AS confidence
FROM w LEFT JOIN a USING (doc_id) LEFT JOIN b USING (doc_id) LEFT JOIN c USING (doc_id)""")
def _(spark, sf_dir):
    """A09-A11, F09, V09."""
    work = F.when(F.col("doc_id") % 4 == 0, None).otherwise(1970 + F.col("doc_id") % 20).cast("int")
    found = tx.years(tx.first_pages("text", 3))
    got = fields.year_of(work, F.col("text"))
    return eis(spark, sf_dir).select("doc_id", tx.top_year(found).alias("first_seen"), tx.top_year(found, "latest").alias("latest"), tx.weighted_year("text").alias("weighted"), got["value"].alias("value"), got["confidence"].alias("confidence"))


@query("parsed_dates", """SELECT d AS raw, CAST(y AS INT) AS year, v AS value, p AS precision FROM (VALUES ('2017', 2017, '2017', 'year'), ('2017-05', 2017, '2017-05', 'month'), ('2017-05-09', 2017, '2017-05-09', 'day'), ('2017-13-45', 2017, '2017', 'year'), ('circa 1984?', 1984, '1984', 'year'), ('n.d.', NULL, NULL, NULL), ('', NULL, NULL, NULL)) AS t(d, y, v, p)""")
def _(spark, sf_dir):
    """F08, F10, X16."""
    rows = spark.createDataFrame([(d,) for d in ("2017", "2017-05", "2017-05-09", "2017-13-45", "circa 1984?", "n.d.", "")], "raw string")
    got = tx.parsed_date("raw")
    return rows.select("raw", got["year"].alias("year"), got["value"].alias("value"), got["precision"].alias("precision"))


@query("record_headers", f"""{E_}, v(v, a, o) AS (VALUES {', '.join(f"('{v}', '{k}', {o})" for v, k, o in _VARIANTS if len(v) > 3)}), c AS (SELECT doc_id, arg_max(a, length(v) * 1000 - o) AS a FROM e JOIN v ON contains(lower(substring(text, 1, 7500)), v) GROUP BY doc_id),
l AS (SELECT doc_id, regexp_extract_all(substring(text, 1, 12500), '\\b(19[7-9]\\d|20\\d{{2}})\\b', 1) AS ys FROM e), y AS ({_top('ys', 'n * 1000000 + y')})
SELECT e.doc_id, CASE WHEN doc_id % 3 = 0 THEN 0.99 END AS title_confidence, CAST(CASE WHEN doc_id % 4 = 0 THEN 1990 ELSE y.y END AS INT) AS year, CASE WHEN doc_id % 4 = 0 THEN 'extracted_from_mets' ELSE 'needs_review' END AS year_status,
CASE WHEN doc_id % 9 = 1 THEN 'BLM' WHEN c.a IS NOT NULL THEN c.a WHEN doc_id % 9 = 2 THEN 'Road Board' END AS agency, CASE WHEN doc_id % 9 = 1 THEN 0.99 WHEN c.a IS NOT NULL THEN 0.85 WHEN doc_id % 9 = 2 THEN 0.6 END AS agency_confidence FROM e LEFT JOIN y USING (doc_id) LEFT JOIN c USING (doc_id)""")
def _(spark, sf_dir):
    """X15-X17, J11-J13, M11, without a model."""
    none = F.lit(None).cast("string")
    title = fields.record_title(F.when(F.col("doc_id") % 3 == 0, "A catalog title"), none, False)
    year = fields.record_year(F.when(F.col("doc_id") % 4 == 0, "1990-06-01"), tx.first_pages("text", 5))
    names = F.when(F.col("doc_id") % 9 == 1, F.array(F.lit("Bureau of Land Management (issuing body)"))).when(F.col("doc_id") % 9 == 2, F.array(F.lit("Road Board"))).otherwise(F.array().cast("array<string>"))
    agency = fields.record_agency(names, tx.first_pages("text", 3), none, False)
    return eis(spark, sf_dir).select("doc_id", title["confidence"].alias("title_confidence"), year["year"]["value"].alias("year"), year["year"]["status"].alias("year_status"), agency["value"].alias("agency"), agency["confidence"].alias("agency_confidence"))


@query("lead_agency")
def _(spark, sf_dir):
    """J14, F22, V20."""
    got = lookup.lead_agency(F.when(F.col("doc_id") % 5 == 0, "forest service"), tx.first_pages("text", 3))
    rows = eis(spark, sf_dir).select("doc_id", "text", got.alias("a"))
    return rows.select("doc_id", "a.name", "a.abbreviation", "a.source", validate.agency_supported(F.col("a.name"), F.array("a.abbreviation"), F.col("text")).alias("supported"))


@query("word_counts", """SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS INT) AS word_count, CASE WHEN len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) < 100 THEN 'short' WHEN len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) > 600 THEN 'long' ELSE 'medium' END AS length_category FROM documents""")
def _(spark, sf_dir):
    """A14."""
    return docs_of(spark, sf_dir).select("doc_id", tx.n_words("text").alias("word_count"), tx.length_category(tx.n_words("text"), 100, 600).alias("length_category"))


# quotes, citations, gates


@query("verified_quotes", f"""WITH m AS ({MENTIONS}) SELECT m.doc_id, m.ord, contains(regexp_replace(c.text, '\\s+', ' ', 'g'), trim(regexp_replace(quote, '\\s+', ' ', 'g'))) AND trim(quote) <> '' AS quote_verified FROM m JOIN conversations c ON c.conv_id = m.doc_id AND c.turn = m.chunk_index""")
def _(spark, sf_dir):
    """F02-F05, with one text for each turn."""
    rows = mentions(spark, sf_dir).withColumn("doc_id", F.col("ord"))
    texts = spark.read.parquet(f"{sf_dir}/conversations.parquet").select((F.col("conv_id") * 100 + F.col("turn")).alias("doc_id"), "text")
    return entities.verified(rows, texts).select(F.floor(F.col("ord") / 100).alias("doc_id"), "ord", "quote_verified")


@query("opinion_quotes", """SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND len(list_filter(regexp_split_to_array(q, '\\s+'), lambda w: w <> '')) BETWEEN 8 AND 40 THEN q END AS quote FROM (SELECT doc_id, regexp_replace(substring(text, 1, 60 + doc_id % 400), '^\\s+|\\s+$', '', 'g') AS q FROM documents)""")
def _(spark, sf_dir):
    """F06."""
    q = F.substr(F.col("text"), F.lit(1), (60 + F.col("doc_id") % 400).cast("int"))
    return docs_of(spark, sf_dir).select("doc_id", tx.opinion_quote(q, F.when(F.col("doc_id") % 2 == 0, "against"), F.col("text")).alias("quote"))


@query("cited_text", """SELECT doc_id, md5(substring(substring(text, 1, 2500) || chr(10) || chr(10) || '[...]' || chr(10) || chr(10) || substring(text, 2501, 2500), 1, 3000)) AS spans, md5(substring(text, 2501, 2500)) AS single FROM documents""")
def _(spark, sf_dir):
    """J09, J10."""
    return docs_of(spark, sf_dir).select("doc_id", F.md5(lookup.cited_text(F.col("text"), F.array(F.lit("1-1"), F.lit("x"), F.lit("2 - 2"), F.lit("7")), 3000)).alias("spans"), F.md5(lookup.cited_text(F.col("text"), F.array(F.lit("2")), 60_000, single=True)).alias("single"))


@query("theme_gate", """WITH t AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'transportation' WHEN 1 THEN 'water_resources' WHEN 2 THEN 'sports' ELSE 'other' END AS p, CASE doc_id % 3 WHEN 0 THEN 'highway' WHEN 1 THEN 'wetlands' ELSE 'tides' END AS s FROM documents),
k AS (SELECT *, p IN ('transportation', 'water_resources', 'other') AS pk, (s = 'highway' AND p = 'transportation') OR (s = 'wetlands' AND p = 'water_resources') AS sk FROM t)
SELECT doc_id, CASE WHEN pk THEN p ELSE 'other' END AS primaries, CASE WHEN sk THEN s ELSE '' END AS subthemes, CASE WHEN pk AND sk THEN 'ok' ELSE 'needs_review' END AS status FROM k""")
def _(spark, sf_dir):
    """X27-X29, V10, V17."""
    ids = docs_of(spark, sf_dir).select("doc_id")
    p = F.element_at(F.array(*map(F.lit, ("transportation", "water_resources", "sports", "other"))), (F.col("doc_id") % 4 + 1).cast("int"))
    s = F.element_at(F.array(*map(F.lit, ("highway", "wetlands", "tides"))), (F.col("doc_id") % 3 + 1).cast("int"))
    rows = ids.select("doc_id", F.explode(F.array(F.struct(F.lit(1).alias("ord"), p.alias("value"), F.lit(None).cast("string").alias("parent")), F.struct(F.lit(2).alias("ord"), s.alias("value"), p.alias("parent")))).alias("x")).select("doc_id", "x.*", F.lit(None).cast("double").alias("confidence"))
    return validate.gated_themes(rows).select("doc_id", F.array_join("primaries", ",").alias("primaries"), F.array_join("subthemes", ",").alias("subthemes"), "status")


@query("hard_gates", """SELECT doc_id, CASE WHEN doc_id % 2 = 0 OR length(text) < 9 THEN 'full_review' WHEN doc_id % 3 = 0 THEN 'full_review' WHEN doc_id % 5 = 0 THEN 'full_review' ELSE 'auto_approve' END AS routing,
array_to_string(list_filter([CASE WHEN doc_id % 2 = 0 OR length(text) < 9 THEN 'verbatim_quotes failed' END, CASE WHEN doc_id % 3 = 0 THEN 'year_range failed' END, CASE WHEN doc_id % 5 = 0 THEN 'geocoding_centroid failed' END], lambda x: x IS NOT NULL), ', ') AS reasons FROM documents""")
def _(spark, sf_dir):
    """V07-V13, V08, V09, V11."""
    quote = F.when(F.col("doc_id") % 2 == 0, "nowhere").otherwise(F.substring("text", 3, 7))
    got = validate.gates(validate.quote_at(F.col("text"), quote, F.lit(2), F.lit(9)), tx.in_year_range(F.when(F.col("doc_id") % 3 == 0, 1900).otherwise(1980)), F.lit(True), validate.point_ok(F.when(F.col("doc_id") % 5 == 0, "POINT"), F.lit(None).cast("string")), F.lit(True))
    return docs_of(spark, sf_dir).select("doc_id", got["routing"].alias("routing"), F.array_join(got["reasons"], ", ").alias("reasons"))


@query("violations", f"""WITH v AS ({VERDICTS}) SELECT doc_id, 'block_exists' AS rule, CAST(ord AS VARCHAR) AS item FROM v WHERE ord % 10 >= 7 UNION ALL SELECT doc_id, 'quote_in_comment', CAST(ord AS VARCHAR) FROM v WHERE ord % 10 >= 7 OR ord % 2 = 1
UNION ALL SELECT doc_id, 'quote_section', CAST(ord AS VARCHAR) FROM v WHERE ord % 5 = 0""")
def _(spark, sf_dir):
    """References and predicates, a row for each breach."""
    v = view(spark, sf_dir, VERDICTS).select("doc_id", F.col("ord").alias("item"), F.concat(F.lit("b"), F.col("ord") % 10).alias("block_id"), F.when(F.col("ord") % 2 == 0, "s1").otherwise("s2").alias("span_id"), F.when(F.col("ord") % 5 != 0, "public_comments").alias("section"))
    ids = v.select("doc_id").distinct()
    blocks = ids.select("doc_id", F.explode(F.array(*[F.lit(f"b{k}") for k in range(7)])).alias("block_id"))
    spans = blocks.select("doc_id", "block_id", F.explode(F.array(F.struct(F.lit("s1").alias("span_id"), F.lit(True).alias("c")), F.struct(F.lit("s2").alias("span_id"), F.lit(False).alias("c")))).alias("x")).select("doc_id", "block_id", "x.span_id", F.col("x.c").alias("is_comment_text"))
    return validate.violations({"stakeholders": v, "blocks": blocks, "quotes": v, "spans": spans})


@query("entry_overrides", f"""WITH m AS ({MENTIONS}) SELECT doc_id, ord, CASE WHEN conv_id5 = 0 OR kind = 'individual' THEN 'HUMAN_REVIEW' ELSE 'PASS' END AS verdict FROM (SELECT *, doc_id % 5 AS conv_id5 FROM m)""")
def _(spark, sf_dir):
    """V02, V05."""
    got = validate.entry_override(F.lit("PASS"), F.lit(""), F.col("doc_id") % 5 != 0, F.col("kind"))
    return mentions(spark, sf_dir).select("doc_id", "ord", validate.known_verdict(got["verdict"], got["notes"])["verdict"].alias("verdict"))


# usage and verdicts

_RATE = "CASE WHEN contains(model, 'sonnet-4') THEN 3.0 WHEN contains(model, 'opus-4') THEN 15.0 WHEN contains(model, 'haiku') THEN 1.0 ELSE 0 END"
_COST = f"((input_tokens + cache_creation_input_tokens) * {_RATE} + cache_read_input_tokens * {_RATE} * 0.1 + output_tokens * 5 * {_RATE}) / 1e6"


@query("usage_rollup", f"SELECT model, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(round(sum({_COST}) * 100) AS BIGINT) AS cents FROM ({USAGE}) GROUP BY GROUPING SETS ((model), ())")
def _(spark, sf_dir):
    """A04-A06, F20."""
    out = usage.rollup(view(spark, sf_dir, USAGE))
    return out.select("model", "calls", "input_tokens", "output_tokens", F.round(F.col("cost_usd") * 100).cast("long").alias("cents"))


@query("budget_trips", f"""WITH u AS (SELECT *, CAST(round(({_COST}) * 1e9) AS BIGINT) AS c FROM ({USAGE})), r AS (SELECT doc_id, call_seq, c, sum(c) OVER (PARTITION BY doc_id ORDER BY call_seq) AS t FROM u) SELECT doc_id, call_seq FROM r WHERE t > 250000000 AND t - c <= 250000000""")
def _(spark, sf_dir):
    """A07."""
    return usage.running(view(spark, sf_dir, USAGE), 0.25).where("tripped").select("doc_id", "call_seq")


@query("lifetime_totals", f"SELECT model, count(*) AS runs, CAST(sum(n) AS BIGINT) AS calls FROM (SELECT doc_id, model, count(*) AS n FROM ({USAGE}) GROUP BY ALL) GROUP BY GROUPING SETS ((model), ())")
def _(spark, sf_dir):
    """A08, K07."""
    per = usage.rollup(view(spark, sf_dir, USAGE), ["doc_id"]).where("model is not null")
    runs = per.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("model", F.struct("calls", (F.col("input_tokens") + F.col("output_tokens")).alias("tokens"), "cost_usd")))).alias("by_model"))
    return usage.lifetime(runs).select("model", "runs", "calls")


@query("verdict_rates", rf"""SELECT regexp_replace(field_path, '\[\d+\]', '[]', 'g') AS field_path, count(*) FILTER (verdict = 'pass') AS pass, count(*) FILTER (verdict = 'partial') AS "partial", count(*) FILTER (verdict = 'no') AS "no", count(*) FILTER (verdict = 'skipped') AS skipped, CAST(round(10000.0 * count(*) FILTER (verdict = 'pass') / count(*) FILTER (verdict <> 'skipped')) AS BIGINT) AS pass_rate FROM ({VERDICTS}) GROUP BY 1""")
def _(spark, sf_dir):
    """A22, A23, K08."""
    return usage.verdict_rates(view(spark, sf_dir, VERDICTS)).withColumn("pass_rate", F.round(F.col("pass_rate") * 10000).cast("long"))


@query("review_status", f"""WITH g AS (SELECT doc_id, count(*) FILTER (verdict <> 'skipped') AS j, count(*) FILTER (verdict = 'no') AS n, count(*) FILTER (verdict = 'pass') AS p, bool_or(verdict = 'no' AND field_path = 'summary.text') AS s FROM ({VERDICTS}) GROUP BY 1)
SELECT doc_id, n AS noes, CASE WHEN j = 0 THEN 'not_run' WHEN n >= 2 THEN 'full_review' WHEN n = 1 THEN 'partial_review' WHEN p / j >= 0.9 THEN 'auto_approved' ELSE 'partial_review' END AS review_status, s AS summary_failed FROM g""")
def _(spark, sf_dir):
    """A21, V19, V24."""
    v = view(spark, sf_dir, VERDICTS)
    return usage.review_status(v).join(validate.claim_downgrades(v), "doc_id").select("doc_id", "noes", "review_status", "summary_failed")


@query("tiered_dispatch")
def _(spark, sf_dir):
    """Tiers close as the budget is spent."""
    v = view(spark, sf_dir, VERDICTS)
    claims = v.select("doc_id", "ord", "field_path", F.when(F.col("field_path") == "summary.text", "sonnet").otherwise("haiku").alias("tier"), "verdict", F.lit(0.001).alias("cost"), F.lit("pass").alias("retry_verdict"), F.lit(0.01).alias("retry_cost"))
    return validate.dispatched(claims, 0.1)


@query("claim_payloads")
def _(spark, sf_dir):
    """V23."""
    pairs = lambda *names: F.array(F.struct(*[F.concat(F.lit(f"{n} "), F.col("doc_id")).alias(n) for n in names]))
    records = docs_of(spark, sf_dir).select("doc_id", F.concat(F.lit("Title "), "doc_id").alias("title"), (1970 + F.col("doc_id") % 50).alias("year"), F.lit("Draft").alias("eis_type"), F.lit("USFS").alias("lead_agency"), F.substring("text", 1, 80).alias("summary"), F.array(F.lit("transportation")).alias("themes"), F.lit(None).cast("string").alias("location"), pairs("name", "description").alias("alternatives"), pairs("name", "stance").alias("people"), pairs("text", "source").alias("claims"), F.substring("text", 1, 200).alias("context"))
    return validate.claim_payloads(records)


@query("progress", f"""WITH m AS ({MENTIONS}) SELECT count(DISTINCT doc_id) AS documents, count(*) AS entries, count(*) FILTER (kind <> 'individual') AS pass, count(*) FILTER (kind = 'individual') AS human_review FROM m""")
def _(spark, sf_dir):
    """A24."""
    rows = mentions(spark, sf_dir).select("doc_id", F.when(F.col("kind") == "individual", "HUMAN_REVIEW").otherwise("PASS").alias("verdict"), F.lit(0.01).alias("cost_usd"))
    return usage.progress(rows).select("documents", "entries", "pass", "human_review")


@query("stage_counts", "SELECT CAST(s - 1 AS INT) AS ord, 'stage ' || s AS stage, count(*) FILTER (doc_id % s = 0) AS done, count(*) FILTER (doc_id % s <> 0) AS todo FROM documents, (VALUES (1), (2), (3)) AS v(s) GROUP BY s")
def _(spark, sf_dir):
    """A25."""
    ids = docs_of(spark, sf_dir).select("doc_id")
    done = None
    for k in (1, 2, 3):
        rows = ids.where(F.col("doc_id") % k == 0).select(F.lit(f"stage {k}").alias("stage"), "doc_id")
        done = rows if done is None else done.union(rows)
    return usage.stage_counts(ids, done, [f"stage {k}" for k in (1, 2, 3)])


# catalog, sample, sheets

_WORKS = """SELECT page_id AS work_id, page_id AS work_ord, CASE page_id % 4 WHEN 0 THEN concat('P', CAST(page_id AS STRING), '_35') WHEN 1 THEN concat('p', CAST(page_id AS STRING), '_35') ELSE '' END AS accession,
CASE page_id % 4 WHEN 2 THEN concat('P', CAST(page_id AS STRING), '_35') WHEN 3 THEN concat(CAST(page_id AS STRING), '_3') ELSE 'none' END AS identifier FROM pages"""


@query("matched_works", f"""WITH w AS ({_WORKS}), d AS (SELECT doc_id AS doc_ord, concat('P', CAST(doc_id AS STRING), '_35') AS doc_key FROM documents),
a AS (SELECT work_id, doc_key, 1 AS priority, doc_ord FROM w JOIN d ON accession = doc_key UNION ALL SELECT work_id, doc_key, 2, doc_ord FROM w JOIN d ON lower(accession) = lower(doc_key) WHERE accession <> '' UNION ALL SELECT work_id, doc_key, 3, doc_ord FROM w JOIN d ON identifier = doc_key UNION ALL SELECT work_id, doc_key, 4, doc_ord FROM w JOIN d ON contains(doc_key, identifier))
SELECT work_id, doc_key, priority FROM a QUALIFY row_number() OVER (PARTITION BY work_id ORDER BY priority, doc_ord) = 1""")
def _(spark, sf_dir):
    """J01, J27, S24."""
    works = view(spark, sf_dir, _WORKS).withColumn("identifiers", F.array("identifier"))
    docs = docs_of(spark, sf_dir).select(F.concat(F.lit("P"), "doc_id", F.lit("_35")).alias("doc_key"), F.col("doc_id").alias("doc_ord"))
    return lookup.matched_works(works, docs)


@query("work_of_document", f"""WITH w AS ({_WORKS}), d AS (SELECT doc_id AS doc_ord, concat('P', CAST(doc_id AS STRING), '_35') AS doc_key FROM documents),
a AS (SELECT work_id, work_ord, doc_key, 1 AS priority, doc_ord FROM w JOIN d ON accession = doc_key UNION ALL SELECT work_id, work_ord, doc_key, 2, doc_ord FROM w JOIN d ON lower(accession) = lower(doc_key) WHERE accession <> '' UNION ALL SELECT work_id, work_ord, doc_key, 3, doc_ord FROM w JOIN d ON identifier = doc_key UNION ALL SELECT work_id, work_ord, doc_key, 4, doc_ord FROM w JOIN d ON contains(doc_key, identifier)),
b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY work_id ORDER BY priority, doc_ord) = 1) SELECT doc_key, arg_min(work_id, work_ord) AS work_id FROM b GROUP BY doc_key""")
def _(spark, sf_dir):
    """J27."""
    works = view(spark, sf_dir, _WORKS).withColumn("identifiers", F.array("identifier"))
    docs = docs_of(spark, sf_dir).select(F.concat(F.lit("P"), "doc_id", F.lit("_35")).alias("doc_key"), F.col("doc_id").alias("doc_ord"))
    return lookup.work_of_document(works, docs)


def pool_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = eis(spark, sf_dir)
    names = F.array(F.concat(F.lit("Bureau "), F.col("doc_id") % 9, F.lit(" (issuing body)")))
    works = docs.select(F.concat(F.lit("w"), "doc_id").alias("work_id"), "doc_id", F.lit("").alias("title"), names.alias("contributors"))
    return selection.candidates(works, docs)


@query("candidate_pool", f"""{E_} SELECT doc_id, CAST(ceil(length(text) / 2500.0) AS INT) AS estimated_pages, CAST(length(text) AS INT) AS ocr_chars, CASE doc_id % 5 WHEN 0 THEN 'Draft' WHEN 1 THEN 'Final' WHEN 2 THEN 'Supplemental' WHEN 3 THEN 'ROD' ELSE 'Unknown' END AS eis_type_guess, concat('Bureau ', CAST(doc_id % 9 AS STRING)) AS bureau_guess, 'short' AS bucket FROM e""")
def _(spark, sf_dir):
    """P04-P07."""
    return pool_of(spark, sf_dir).select("doc_id", "estimated_pages", "ocr_chars", "eis_type_guess", "bureau_guess", "bucket")


@query("selection_targets", "SELECT b AS bucket, CAST(a AS BIGINT) AS available, CAST(w AS INT) AS wanted, CAST(t AS INT) AS target FROM (VALUES ('short', 128, 5, 5), ('medium', 50, 10, 12), ('long', 3, 5, 3)) AS v(b, a, w, t)")
def _(spark, sf_dir):
    """A19, on counts of 128, 50 and 3."""
    rows = spark.range(181).select(F.when(F.col("id") < 128, "short").when(F.col("id") < 178, "medium").otherwise("long").alias("bucket"))
    return selection.targets_table(rows)


@query("selection")
def _(spark, sf_dir):
    """A capped, seeded, greedy sample."""
    pool = pool_of(spark, sf_dir).withColumn("bucket", tx.length_bucket(F.col("ocr_chars"), 2000, 4000))
    return selection.selected(pool)


@query("grading_sheet", f"""SELECT doc_id, CAST(o AS INT) AS ord, f AS field, CASE f WHEN 'title' THEN concat('Title ', CAST(doc_id AS STRING)) WHEN 'alternatives' THEN repeat('x', 399) || '…' ELSE '' END AS extracted_value, CASE WHEN f = 'title' THEN '1-3, 4-4' ELSE '' END AS source_pages,
CASE WHEN split_part(f, '.', 1) = 'summary' THEN 'PASS' ELSE '' END AS critic_verdict, CASE WHEN f = 'summary.project_description' THEN 'fine' ELSE '' END AS your_notes FROM documents CROSS JOIN (VALUES {', '.join(f"({k}, '{f}')" for k, f in enumerate(selection.GRADED))}) AS v(o, f)""")
def _(spark, sf_dir):
    """P16-P18, K04."""
    ids = docs_of(spark, sf_dir).select("doc_id")
    none = F.array().cast("array<string>")
    title = ids.select("doc_id", F.lit("title").alias("field"), F.concat(F.lit("  Title \n"), "doc_id").alias("value"), F.array(F.lit("1-3"), F.lit("4-4")).alias("source_pages"), F.lit("high").alias("confidence"))
    alternatives = ids.select("doc_id", F.lit("alternatives").alias("field"), F.repeat(F.lit("x"), 450).alias("value"), none.alias("source_pages"), F.lit("").alias("confidence"))
    verdicts = ids.select("doc_id", F.lit("summary").alias("field"), F.lit("PASS").alias("verdict"), F.lit("low").alias("model_confidence"), F.lit(" fine ").alias("notes"))
    return selection.grading_rows(title.union(alternatives), verdicts).drop("your_grade", "model_confidence")


# normalisation, JSON, confidences, replay


@query("normalised_text", """SELECT doc_id, regexp_replace(translate(concat('“A–b’s” hy-', chr(10), '  phen', text), '“”’–', '""''-'), '-[\\r\\n]+[ \\t]*', '', 'g') AS norm FROM documents WHERE NOT regexp_matches(text, '[‘—…\\x{a0}]')""")
def _(spark, sf_dir):
    """The text, of documents whose map of spans covers it without gaps."""
    raw = F.concat(F.lit("“A–b’s” hy-\n  phen"), "text")
    rows = docs_of(spark, sf_dir).where(~F.col("text").rlike("[‘—…\u00a0]")).select("doc_id", sp.aligned(raw).alias("a"))
    covered = F.aggregate("a.spans", F.lit(0), lambda s, x: F.when(x["norm_start"] == s, x["norm_end"]).otherwise(-1))
    return rows.where(covered == F.length("a.text")).select("doc_id", F.col("a.text").alias("norm"))


@query("salvaged_json", """SELECT i, n FROM (VALUES (1, 2), (2, 1), (3, 1), (4, 2), (5, NULL)) AS v(i, n)""")
def _(spark, sf_dir):
    """F15-F18, K09."""
    answers = [(1, '{"entities": [{"a": 1}, {"a": 2}]}'), (2, '```json\n{"entities": [{"a": "}{"}]}\n```'), (3, 'Here you are: {"entities": [{"a": 1}]} Bye {'), (4, '{"entities": [{"a": 1}, {"a": "x]"}, {"a": 3'), (5, "none")]
    rows = spark.createDataFrame(answers, "i int, response string").withColumn("v", tx.parsed_json("response"))
    return rows.select("i", F.size(F.try_variant_get("v", "$.entities", "array<variant>")).alias("n")).withColumn("n", F.when(F.col("n") >= 0, F.col("n")))


@query("page_confidence", "SELECT i, c AS confidence FROM (VALUES (1, 0.5), (2, 0.8), (3, 0.9), (4, 0.7), (5, 0.35), (6, NULL), (7, NULL)) AS v(i, c)")
def _(spark, sf_dir):
    """S06, A12."""
    from docloom.sources.corpus import confidence_of

    shapes = ['{"words": [{"word": "a", "confidence": 0.25}, {"confidence": 0.5}, {"confidence": 1}]}', '{"median_confidence": 0.8}', '{"confidence": 0.9}', '{"score": 0.7}', '[{"text": "a", "confidence": 0.2}, {"confidence": 0.5}]', "{}", "oops"]
    return spark.createDataFrame(list(enumerate(shapes, 1)), "i int, j string").select("i", confidence_of(F.col("j")).alias("confidence"))


@query("chunk_quality", """WITH p AS (SELECT doc_id, CAST(k AS INT) AS page, ((doc_id + k) % 10) / 10.0 AS c FROM documents, range(1, 7) AS r(k) WHERE doc_id % 3 <> 0) SELECT d.doc_id, m.doc_id IS NULL OR m.c >= 0.7 AS used FROM documents d LEFT JOIN (SELECT doc_id, median(c) AS c FROM p WHERE page BETWEEN 2 AND 4 GROUP BY 1) m USING (doc_id)""")
def _(spark, sf_dir):
    """A13."""
    from docloom.sources.corpus import chunk_quality

    ids = docs_of(spark, sf_dir).select("doc_id")
    pages = ids.where("doc_id % 3 <> 0").select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("page")).withColumn("confidence", ((F.col("doc_id") + F.col("page")) % 10) / 10)
    chunks = ids.select("doc_id", F.lit("c01").alias("chunk_id"), F.lit(2).alias("first_page"), F.lit(4).alias("last_page"))
    return chunk_quality(chunks, pages).select("doc_id", "used")


@query("replayed_answers", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE CAST(doc_id % 7 AS BIGINT) END AS answer, CASE WHEN doc_id % 3 = 0 THEN 'not recorded' END AS error FROM documents")
def _(spark, sf_dir):
    """Prompts against recorded responses, without a client."""
    prompts = docs_of(spark, sf_dir).select("doc_id", model.filled("Which number is {n}?", n=F.col("doc_id")).alias("prompt"), F.lit("any").alias("model"))
    table = prompts.where("doc_id % 3 <> 0").select(model.prompt_hash(F.col("prompt"), F.col("model")).alias("prompt_hash"), "model", F.concat(F.lit('Sure: {"answer": '), F.col("doc_id") % 7, F.lit("}")).alias("response"), F.lit(10).cast("long").alias("input_tokens"), F.lit(3).cast("long").alias("output_tokens"), F.lit(None).cast("string").alias("error"))
    return model.answered(prompts, table).select("doc_id", F.try_variant_get("parsed", "$.answer", "long").alias("answer"), "error")


# whole lineages


@query("strict_records")
def _(spark, sf_dir):
    """One wide row for each document."""
    return records.strict_records(eis(spark, sf_dir))


@query("ingested")
def _(spark, sf_dir):
    """S02, C27, C28, F19, M10."""
    return records.ingested(eis(spark, sf_dir)).select("doc_id", "text_id", F.length("normalized.text").alias("n"), F.size("normalized.spans").alias("spans"), F.size("pages").alias("pages"), "components")


@query("critiqued_entries", f"""WITH m AS ({_MERGED}) SELECT doc_id, sequence, CASE WHEN NOT summary_quote_verified OR kind = 'individual' OR sequence % 3 = 0 THEN 'HUMAN_REVIEW' ELSE 'PASS' END AS critic_verdict FROM m""")
def _(spark, sf_dir):
    """A critic's recorded answers, with every third one missing."""
    entries = merged_entries(spark, sf_dir)
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    texts = turns.groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("text"))
    cited = lookup.cited_text(F.col("text"), F.col("evidence_pages"), 60_000, single=True)
    prompt = model.filled(records.CRITIC, rubric=F.lit("be fair"), entity=F.col("entity"), kind=F.col("kind"), stance=F.col("stance"), quote=F.col("summary_quote"), cited=F.col("cited"))
    asked = entries.join(texts, "doc_id").withColumn("cited", cited).where("sequence % 3 <> 0").select(model.prompt_hash(prompt, F.lit("critic")).alias("prompt_hash")).distinct()
    table = asked.select("prompt_hash", F.lit("critic").alias("model"), F.lit('{"verdict": "PASS", "notes": ""}').alias("response"), F.lit(1).cast("long").alias("input_tokens"), F.lit(1).cast("long").alias("output_tokens"), F.lit(None).cast("string").alias("error"))
    return records.critiqued(entries, texts, table, "be fair").select("doc_id", "sequence", "critic_verdict")


@query("entity_records")
def _(spark, sf_dir):
    """Dictionary and agency entities by score."""
    return records.entity_record(eis(spark, sf_dir), [("the county", "County"), ("county", "County"), ("road", "Road")])


@query("summary_lineage")
def _(spark, sf_dir):
    """Chunk prompts and their reduction, from a replay table made of the same rules."""
    docs = eis(spark, sf_dir)
    chunks = retrieval.tagged_first(segment.labelled_chunks(segment.fixed_chunks(docs, 2000, 1800), segment.chapters(docs)).withColumnRenamed("chunk", "chunk_index"), 12).withColumnRenamed("chunk_index", "chunk")
    row = lambda p, name, text: p.select(model.prompt_hash(F.col("prompt"), F.lit(name)).alias("prompt_hash"), F.lit(name).alias("model"), F.lit(text).alias("response"), F.lit(1).cast("long").alias("input_tokens"), F.lit(1).cast("long").alias("output_tokens"), F.lit(None).cast("string").alias("error")).distinct()
    first = row(fields.chunk_prompts(chunks, "Findings of {text}", "map"), "map", '{"found": 1}')
    said = model.answered(fields.chunk_prompts(chunks, "Findings of {text}", "map"), first)
    second = row(fields.reduced_prompts(said.select("doc_id", "chunk", "response"), "Reduce {findings}", "reduce"), "reduce", '{"project_description": {"text": "a road", "source_pages": ["1-2"]}}')
    out = records.summary_lineage(docs, first.union(second), "Findings of {text}", "Reduce {findings}", size=2000, stride=1800)
    return out.select("doc_id", "n_chunks", "summary.project_description.text", F.size("summary.public_response.source_pages").alias("missing"))


from docloom.plans import body_queries  # noqa: E402,F401  registers the body fields

"""Whole lineages: one record for each document, and entries with a critic's verdicts. Each is one DataFrame plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import spans as sp
from docloom.functions import text as tx
from docloom.operators import entities, fields, lookup, model, retrieval, segment, validate

NONE = "cast(null as string)"


def ingested(docs: DataFrame) -> DataFrame:
    """(doc_id, text, text_id, normalized, pages, components): what later stages read of a document."""
    rows = segment.components(docs.select("doc_id", "text"))
    return rows.withColumns({"text_id": tx.text_id("text"), "normalized": sp.aligned(F.col("text")), "pages": sp.line_pages("text")})


def headers(docs: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """(doc_id, title, year, published, precision, agency, eis_type) without a model. catalog: (doc_id, title, date, contributors)."""
    rows = docs.select("doc_id", "text")
    if catalog is None:
        rows = rows.withColumns({"title": F.expr(NONE), "date": F.expr(NONE), "contributors": F.array().cast("array<string>")})
    else:
        rows = rows.join(catalog.select("doc_id", "title", "date", "contributors"), "doc_id", "left")
    pages = sp.line_pages("text")
    rows = rows.withColumn("pages", pages)
    until = lambda n: F.substr(F.col("text"), F.lit(1), F.coalesce(F.array_max(F.slice("pages", 1, n)["end"]), F.lit(0)))
    rows = rows.withColumns({"cover": until(3), "front": until(5), "names": F.coalesce("contributors", F.array().cast("array<string>"))})
    year = fields.record_year(F.col("date"), F.col("front"))
    return rows.select("doc_id", fields.record_title(F.col("title"), F.expr(NONE), False).alias("title"), year.alias("y"), fields.record_agency(F.col("names"), F.col("cover"), F.expr(NONE), False).alias("agency"), fields.record_type(F.col("cover"), F.expr(NONE), False).alias("eis_type")).select("doc_id", "title", "y.year", "y.published", "y.precision", "agency", "eis_type")


def strict_records(docs: DataFrame, catalog: DataFrame | None = None, titles: DataFrame | None = None) -> DataFrame:
    """One wide row for each document: headers, sections, alternatives, comment blocks, gates and routing, with no model call.

    titles: headings that a model named, for sections that no heading line gives.
    """
    found = segment.sections(docs, None if titles is None else segment.toc_sections(docs, titles))
    parts = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "section", "status", "method", "start", "end", "first_page", "last_page"))).alias("sections"))  # nine
    alternatives = retrieval.retrieved(docs, found, ["alternatives"], ["Alternative", "No Action", "No Build", "Preferred Alternative"])
    named = retrieval.labels(docs, alternatives).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "label"))), lambda x: x["label"]).alias("alternatives"))  # twelve at most
    blocks = segment.block_parts(docs, segment.comment_blocks(docs)).groupBy("doc_id").agg(F.count("*").alias("comment_blocks"), F.count_if(F.col("split_status") == "ok").alias("answered_blocks"))
    broken = validate.violations({"sections": found}).groupBy("doc_id").agg(F.count("*").alias("violations"))
    rows = headers(docs, catalog)
    for part in (parts, named, blocks, broken):
        rows = rows.join(part, "doc_id", "left")
    got = validate.gates(F.lit(True), tx.in_year_range(F.col("year.value")), F.lit(True), F.lit(True), F.coalesce("violations", F.lit(0)) == 0)
    return rows.withColumns({"alternatives": F.coalesce("alternatives", F.array().cast("array<string>")), "comment_blocks": F.coalesce("comment_blocks", F.lit(0)), "answered_blocks": F.coalesce("answered_blocks", F.lit(0)), "gates": got}).drop("violations")


CRITIC = "Rubric:\n{rubric}\n\nEntry: {entity} ({kind}, {stance})\nQuote: {quote}\n\nCited pages:\n{cited}\n\nAnswer with JSON {\"verdict\": ..., \"notes\": ...}."


def critiqued(entries: DataFrame, docs: DataFrame, replay: str | DataFrame, rubric: str = "", make: Callable[[], model.Client] | None = None, name: str = "critic") -> DataFrame:
    """entries with critic_verdict and critic_notes: the cited pages go to a model; unknown verdicts and failed calls go to a human, as do unverified quotes and private individuals.

    Of a document only the cited pages travel on, cut to 60,000 characters.
    """
    cited = lookup.cited_text(F.col("text"), F.col("evidence_pages"), 60_000, single=True)
    rows = entries.join(docs.select("doc_id", "text"), "doc_id", "left").withColumn("cited", cited).drop("text")
    prompt = model.filled(CRITIC, rubric=F.lit(rubric), entity=F.col("entity"), kind=F.col("kind"), stance=F.col("stance"), quote=F.col("summary_quote"), cited=F.col("cited"))
    said = model.answered(rows.withColumn("prompt", prompt).withColumn("model", F.lit(name)), replay, make)
    failed = F.concat(F.lit("critic failed: "), F.coalesce("error", F.lit("unreadable answer")))
    first = validate.known_verdict(F.try_variant_get("parsed", "$.verdict", "string"), F.when(F.col("parsed").isNull(), failed).otherwise(F.try_variant_get("parsed", "$.notes", "string")))
    said = said.withColumn("c", first)
    last = validate.entry_override(F.col("c.verdict"), F.col("c.notes"), F.col("summary_quote_verified"), F.col("kind"))
    return said.withColumn("c", last).select(*entries.columns, F.col("c.verdict").alias("critic_verdict"), F.col("c.notes").alias("critic_notes"))


def entity_record(docs: DataFrame, people: list[tuple[str, str]]) -> DataFrame:
    """(doc_id, name, source, n, spread, score, first_chunk, appearance): dictionary entities and agencies of documents, scored over fixed chunks."""
    chunks = segment.fixed_chunks(docs).select("doc_id", F.col("chunk").cast("int").alias("chunk_index"), "text")
    listed = lookup.dictionary_hits(docs, people).select("doc_id", F.col("canonical").alias("name"), F.col("first_at").alias("ord"))
    agencies = lookup.agency_hits(docs).select("doc_id", F.col("canonical").alias("name"), F.col("first_at").alias("ord"))
    names = entities.layered_names([("dictionary", listed), ("agency", agencies)])
    return entities.scored_entities(names, chunks, ["dictionary", "agency"])


def summary_lineage(docs: DataFrame, replay: str | DataFrame, map_template: str, reduce_template: str, make: Callable[[], model.Client] | None = None, most: int = 12, size: int = 125_000, stride: int = 120_000) -> DataFrame:
    """(doc_id, n_chunks, summary): findings of at most `most` chunks, labelled chapters first, reduced by one more prompt."""
    chunks = segment.labelled_chunks(segment.fixed_chunks(docs, size, stride), segment.chapters(docs))
    chosen = retrieval.tagged_first(chunks.withColumnRenamed("chunk", "chunk_index"), most).withColumnRenamed("chunk_index", "chunk")
    found = model.answered(fields.chunk_prompts(chosen, map_template, "map"), replay, make)
    reduced = model.answered(fields.reduced_prompts(found.select("doc_id", "chunk", "response"), reduce_template, "reduce"), replay, make)
    return reduced.select("doc_id", "n_chunks", fields.summary_fields(F.col("parsed"), True).alias("summary"))


def batch(docs: DataFrame, cost: Callable[[str], float], selection: DataFrame | None = None, only: list | None = None, limit: int | None = None) -> DataFrame:
    """(doc_id, cost_usd, error): each document processed by itself; one that fails is a row with its error.

    selection: (doc_id) as stored by an earlier run; only: these documents alone; limit: the first so many by id.
    """
    from docloom.sources.sinks import tried

    rows = docs.select("doc_id", "text")
    if selection is not None:
        rows = rows.join(selection.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType)).distinct(), "doc_id", "left_semi")
    if only is not None:
        rows = rows.where(F.col("doc_id").isin(only))
    if limit is not None:
        rows = rows.orderBy("doc_id").limit(limit)
    return tried(rows, "text", cost, "double").select("doc_id", F.col("value").alias("cost_usd"), "error")


def batch_total(rows: DataFrame) -> DataFrame:
    """One row of a batch: (documents, failed, cost_usd)."""
    return rows.agg(F.count(F.lit(1)).alias("documents"), F.count("error").alias("failed"), F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd"))

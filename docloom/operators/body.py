"""Body fields of a record: the part of a document that a model reads, and what its answer becomes.

Each field has two halves: its prompts, one row a document (or block), and the field made of recorded or new answers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.operators import fields, lookup, model, retrieval, segment
from docloom.plans import vocab

Make = Callable[[], model.Client] | None
#: Signs that a document holds comments with their answers.
ANSWERED = r"(?i)\b(?:comments?\s+and\s+response|response\s+to\s+comments)\b"
AREAS = ["project area", "study area"]
GEOCODED = "array<struct<name:string,lat:double,lon:double>>"


def listed(parsed: Column, path: str, kind: str) -> Column:
    """A list of an answer; what is missing or of another kind is empty."""
    return F.coalesce(F.try_variant_get(parsed, path, f"array<{kind}>"), F.array().cast(f"array<{kind}>"))


def said(parsed: Column, path: str, otherwise: str) -> Column:
    return F.coalesce(F.try_variant_get(parsed, path, "string"), F.lit(otherwise))


def span(first: Column, last: Column) -> Column:
    return F.concat(first.cast("string"), F.lit("-"), last.cast("string"))


def _asked(rows: DataFrame, replay: str | DataFrame, make: Make) -> DataFrame:
    return model.answered(rows, replay, make).drop("prompt")


# alternatives


def alternatives_prompts(docs: DataFrame, found: DataFrame, template: str, pages: int = 80, name: str = "alternatives") -> DataFrame:
    """(doc_id, span, prompt, model) of documents with an Alternatives chapter, cut to so many pages."""
    most = pages * vocab.PAGE_CHARS
    chapter = segment.chapter_text(docs, found, "Alternatives")
    last = F.when(F.length("text") > most, F.col("first_page") + pages - 1).otherwise(F.col("last_page"))
    rows = chapter.select("doc_id", span(F.col("first_page"), last).alias("span"), F.substring("text", 1, most).alias("text"))
    return rows.select("doc_id", "span", model.filled(template, span=F.col("span"), text=F.col("text")).alias("prompt"), F.lit(name).alias("model"))


def alternatives(docs: DataFrame, prompts: DataFrame, replay: str | DataFrame, make: Make = None) -> DataFrame:
    """(doc_id, value, confidence, source_pages, note): nothing is read where no chapter was found."""
    got = _asked(prompts, replay, make).select("doc_id", "span", listed(F.col("parsed"), "$.alternatives", "struct<name:string,description:string,source_pages:array<string>>").alias("value"))
    rows = docs.select("doc_id").join(got, "doc_id", "left")
    empty = F.array().cast("array<struct<name:string,description:string,source_pages:array<string>>>")
    return rows.select("doc_id", F.coalesce("value", empty).alias("value"), F.when(F.size("value") > 0, "high").otherwise("low").alias("confidence"), F.when(F.col("span").isNotNull(), F.array("span")).otherwise(F.array().cast("array<string>")).alias("source_pages"), F.when(F.col("span").isNull(), "no Alternatives chapter").alias("note"))


# themes


def themes_prompts(summaries: DataFrame, template: str, name: str = "themes") -> DataFrame:
    """(doc_id, prompt, model): the texts of a summary's parts, as JSON. summaries: (doc_id, summary of fields.summary_fields)."""
    payload = F.to_json(F.struct(*[F.col(f"summary.{k}.text").alias(k) for k in fields.SUMMARY]))
    return summaries.select("doc_id", model.filled(template, summary=payload).alias("prompt"), F.lit(name).alias("model"))


def themes(prompts: DataFrame, replay: str | DataFrame, make: Make = None) -> DataFrame:
    """(doc_id, themes, subthemes, confidence, justification, source_pages), as the model says; the vocabulary gate is validate.gated_themes."""
    p = F.col("parsed")
    return _asked(prompts, replay, make).select("doc_id", listed(p, "$.themes", "string").alias("themes"), listed(p, "$.subthemes", "string").alias("subthemes"), said(p, "$.self_confidence", "medium").alias("confidence"), said(p, "$.justification", "").alias("justification"), F.array(F.lit("summary")).alias("source_pages"))


# location


def location_prompts(docs: DataFrame, found: DataFrame, template: str, pages: int = 30, most: int = 60_000, name: str = "location") -> DataFrame:
    """(doc_id, spans, prompt, model): the first pages, and every chapter whose label names a project or study area."""
    area = F.coalesce(*[F.when(F.contains(F.lower("label"), F.lit(a)), F.lit(k)) for k, a in enumerate(AREAS)])
    chapters = found.withColumn("area", area).where("area is not null").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("area", "start", "end"))).alias("areas"))  # six chapters at most
    rows = docs.select("doc_id", "text").join(chapters, "doc_id", "left").withColumn("areas", F.coalesce("areas", F.array().cast("array<struct<area:int,start:int,end:int>>")))
    parts = F.concat(F.array(tx.first_pages(F.col("text"), pages)), F.transform("areas", lambda a: F.substring(tx.slice_of("text", a["start"], a["end"]), 1, most)))
    first = span(F.lit(1), F.least(F.lit(pages), F.greatest(F.lit(1), F.floor(F.length("text") / vocab.PAGE_CHARS).cast("int"))))
    spans = F.concat(F.array(first), F.transform("areas", lambda a: span(tx.page_of(a["start"]), tx.page_of(a["end"]))))
    return rows.select("doc_id", spans.alias("spans"), model.filled(template, text=F.array_join(parts, "\n\n---\n\n")).alias("prompt"), F.lit(name).alias("model"))


def location(prompts: DataFrame, gazetteer: DataFrame, replay: str | DataFrame, make: Make = None) -> DataFrame:
    """(doc_id, places, is_multi_site, geocoded, confidence, source_pages, note). gazetteer: (name, state, lat, lon)."""
    p = F.col("parsed")
    places = listed(p, "$.places", "struct<name:string,kind:string,state:string>")
    rows = _asked(prompts, replay, make).select("doc_id", places.alias("places"), F.coalesce(F.try_variant_get(p, "$.is_multi_site", "boolean"), F.lit(False)).alias("is_multi_site"), said(p, "$.self_confidence", "medium").alias("confidence"), F.col("spans").alias("source_pages"), said(p, "$.note", "").alias("note"))
    each = rows.select("doc_id", F.posexplode("places").alias("ord", "p")).where(F.coalesce("p.name", F.lit("")) != "").select("doc_id", "ord", "p.name", "p.state")
    at = fields.geocoded(each, gazetteer).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name", "lat", "lon"))), lambda x: F.struct(x["name"].alias("name"), x["lat"].alias("lat"), x["lon"].alias("lon"))).alias("geocoded"))
    return rows.join(at, "doc_id", "left").withColumn("geocoded", F.coalesce("geocoded", F.array().cast(GEOCODED))).select("doc_id", "places", "is_multi_site", "geocoded", "confidence", "source_pages", "note")


def located(prompts: DataFrame, roles: list[str], replay: str | DataFrame, make: Make = None) -> DataFrame:
    """(doc_id, places, dropped, status, polygon): places with a name and a known role; a place that was dropped, or none at all, needs review."""
    rows = _asked(prompts, replay, make)
    rows = rows.select("doc_id", fields.places(F.col("parsed"), roles).alias("places"), F.coalesce(F.size(F.try_variant_get("parsed", "$.places", "array<variant>")), F.lit(0)).alias("n"))
    dropped = F.greatest(F.col("n"), F.lit(0)) - F.size("places")
    return rows.select("doc_id", "places", dropped.alias("dropped"), F.when((dropped > 0) | (F.size("places") == 0), "needs_review").otherwise("ok").alias("status"), F.lit(None).cast("string").alias("polygon"))


# people


def people_prompts(docs: DataFrame, found: DataFrame, preparers: str, commenters: str, most: int = 60_000, pages: int = 30) -> DataFrame:
    """(doc_id, part, span, prompt, model): the Consultation chapter, else the first pages; and, where a document has answered comments, the text from there on."""
    chapter = segment.chapter_text(docs, found, "Consultation").select("doc_id", F.substring("text", 1, most).alias("chapter"), span(F.col("first_page"), F.col("last_page")).alias("pages"))
    rows = docs.select("doc_id", "text").join(chapter, "doc_id", "left")
    read = F.coalesce("chapter", F.substring(tx.first_pages(F.col("text"), pages), 1, most))
    first = rows.select("doc_id", F.lit("preparers").alias("part"), F.coalesce("pages", F.lit(f"1-{pages}")).alias("span"), model.filled(preparers, text=read).alias("prompt"), F.lit("preparers").alias("model"))
    at = F.length(F.get(F.split("text", ANSWERED, 2), 0))
    some = docs.where(F.col("text").rlike(ANSWERED)).select("doc_id", F.length("text").alias("n"), at.alias("at"), "text")
    excerpt = some.select("doc_id", F.substr("text", F.col("at") + 1, F.lit(most)).alias("text"), span(tx.page_of(F.col("at")), tx.page_of(F.least(F.col("at") + most, F.col("n")))).alias("span"))
    second = excerpt.select("doc_id", F.lit("commenters").alias("part"), "span", model.filled(commenters, span=F.col("span"), text=F.col("text")).alias("prompt"), F.lit("commenters").alias("model"))
    return first.unionByName(second)


def people(docs: DataFrame, prompts: DataFrame, replay: str | DataFrame, make: Make = None) -> DataFrame:
    """(doc_id, agency_preparers, cooperating_agencies, public_commenters, comment_response_present, confidence, preparer_pages, commenter_pages)."""
    p = F.col("parsed")
    got = _asked(prompts, replay, make)
    staff = got.where("part = 'preparers'").select("doc_id", listed(p, "$.agency_preparers", "struct<name:string,role:string>").alias("agency_preparers"), listed(p, "$.cooperating_agencies", "struct<name:string>").alias("cooperating_agencies"), F.array("span").alias("preparer_pages"))
    kind = "struct<name:string,kind:string,stance:string,quote:string,source_pages:array<string>>"
    public = got.where("part = 'commenters'").select("doc_id", listed(p, "$.commenters", kind).alias("public"), F.array("span").alias("commenter_pages"))
    texts = docs.join(public.select("doc_id"), "doc_id", "left_semi").select("doc_id", tx.squeeze("text").alias("squeezed"))
    checked = public.join(texts, "doc_id").select("doc_id", fields.commenter_quotes(F.col("public"), F.col("squeezed")).alias("public_commenters"), "commenter_pages")
    rows = staff.join(checked, "doc_id", "left")
    none = lambda c: F.coalesce(F.col(c), F.from_json(F.lit("[]"), checked.schema[c].dataType))
    return rows.select("doc_id", "agency_preparers", "cooperating_agencies", none("public_commenters").alias("public_commenters"), F.col("commenter_pages").isNotNull().alias("comment_response_present"), F.when(F.size("agency_preparers") > 0, "high").otherwise("medium").alias("confidence"), "preparer_pages", none("commenter_pages").alias("commenter_pages"))


# summary in two passes


def two_summaries(contexts: DataFrame, detailed: str, plain: str, replay: str | DataFrame, make: Make = None, most: int = 20_000) -> DataFrame:
    """(doc_id, detailed, plain, status, plain_status, confidence, plain_confidence): a detailed summary of the context, and a plain one made of it.

    contexts: (doc_id, text, degraded). A context from keywords or first characters (degraded) needs review, as does a
    summary that is missing; without a detailed one no plain one is asked for.
    """
    rows = contexts.select("doc_id", "degraded", model.filled(detailed, text=F.substring("text", 1, most)).alias("prompt"), F.lit("heavy").alias("model"))
    text = F.nullif(tx.strip(F.try_variant_get("parsed", "$.summary", "string")), F.lit(""))
    first = _asked(rows, replay, make).select("doc_id", "degraded", text.alias("detailed"))
    again = first.where("detailed is not null").select("doc_id", model.filled(plain, text=F.col("detailed")).alias("prompt"), F.lit("light").alias("model"))
    out = first.join(_asked(again, replay, make).select("doc_id", text.alias("plain")), "doc_id", "left")
    status = lambda c: F.when(F.col(c).isNull() | F.col("degraded"), "needs_review").otherwise("ok")
    sure = lambda c, high, low: F.when(F.col(c).isNotNull(), F.when(F.col("degraded"), low).otherwise(high))
    return out.select("doc_id", "detailed", "plain", status("detailed").alias("status"), status("plain").alias("plain_status"), sure("detailed", 0.85, 0.65).alias("confidence"), sure("plain", 0.80, 0.60).alias("plain_confidence"))


# entities


def entity_packs(rows: DataFrame, template: str, replay: str | DataFrame, make: Make = None, most: int = 20_000) -> DataFrame:
    """rows (doc_id, name, context) with stance, role, opinion, quote and evidence; a stance outside the vocabulary, or a failed call, is insufficient information."""
    asked = rows.withColumn("prompt", model.filled(template, name=F.col("name"), text=F.substring("context", 1, most))).withColumn("model", F.lit("heavy"))
    got = model.answered(asked, replay, make)
    text = lambda k: F.nullif(tx.strip(F.try_variant_get("parsed", f"$.{k}", "string")), F.lit(""))
    stance = F.try_variant_get("parsed", "$.stance", "string")
    known = F.when(stance.isin(vocab.RECORD_STANCES), stance).otherwise("insufficient_information")
    evidence = F.filter(listed(F.col("parsed"), "$.evidence", "struct<chunk_id:string,pages:array<int>>"), lambda e: e["chunk_id"].isNotNull())
    return got.select("doc_id", "name", known.alias("stance"), text("role").alias("role"), text("opinion_summary").alias("opinion"), tx.opinion_quote(F.coalesce(text("quote"), F.lit("")), text("opinion_summary"), F.col("context")).alias("quote"), evidence.alias("evidence"))


def labelled_chunks(chunks: DataFrame, template: str, replay: str | DataFrame, make: Make = None, most: int = 32_000) -> DataFrame:
    """chunks (doc_id, chunk_id, heading, text) with title, description and topic_tags of the vocabulary; a failed call keeps the heading, else the chunk's id."""
    asked = chunks.withColumn("prompt", model.filled(template, heading=F.coalesce("heading", F.lit("(none)")), text=F.substring("text", 1, most))).withColumn("model", F.lit("light"))
    got = model.answered(asked, replay, make)
    text = lambda k: F.nullif(F.try_variant_get("parsed", f"$.{k}", "string"), F.lit(""))
    tags = F.filter(listed(F.col("parsed"), "$.topic_tags", "string"), lambda t: t.isin(vocab.CHUNK_TAGS))
    return got.select(*chunks.columns, F.coalesce(text("title"), F.nullif("heading", F.lit("")), "chunk_id").alias("title"), F.coalesce(text("description"), F.lit("")).alias("description"), tags.alias("topic_tags"))


def gap_filled(chunks: DataFrame, names: DataFrame, template: str, replay: str | DataFrame, make: Make = None, most: int = 32_000, chunks_most: int = 6, words: int = 2000, known: int = 3) -> DataFrame:
    """(doc_id, name, kind): names that a model finds in the chunks worth a second look and that are not known yet; the first spelling of each."""
    from docloom.operators import entities

    some = entities.gap_chunks(chunks, names, chunks_most, words, known)
    rows = some.select("doc_id", "chunk_id", model.filled(template, text=F.substring("text", 1, most)).alias("prompt"), F.lit("light").alias("model"))
    got = _asked(rows, replay, make)
    said_of = lambda path, kind: F.transform(listed(F.col("parsed"), path, "string"), lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name")))
    both = F.concat(said_of("$.people", "person"), said_of("$.organizations", "organization"))
    each = got.select("doc_id", "chunk_id", F.posexplode(both).alias("ord", "x")).select("doc_id", "chunk_id", "ord", tx.strip("x.name").alias("name"), "x.kind").where("name <> ''")
    each = each.withColumn("key", F.lower("name"))
    listed_already = names.select("doc_id", F.lower("name").alias("key")).distinct()
    fresh = each.join(listed_already, ["doc_id", "key"], "left_anti")
    return fresh.groupBy("doc_id", "key").agg(F.min_by(F.struct("name", "kind"), F.struct("chunk_id", "ord")).alias("x")).select("doc_id", "x.name", "x.kind")


# stakeholders


def stakeholders(docs: DataFrame, templates: dict[str, str], replay: str | DataFrame, make: Make = None, most: int = 30) -> DataFrame:
    """(doc_id, block_id, author, author_type, quote, display, page, stance, target, confidence, tier, appearance_order) of organisations that comment.

    Blocks of comments, at most `most` a document, in order; a block's author from its beginning (individuals and
    nameless authors give no row); the sentence with the most cues, where there are several by a model's pick; its
    stance from a light model and, where that is unsure or mixed, a heavy one. templates: author, quote and stance.
    """
    order = Window.partitionBy("doc_id").orderBy("ord")
    blocks = segment.block_parts(docs, segment.comment_blocks(docs)).withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).drop("r")
    heads = blocks.join(docs.select("doc_id", "text"), "doc_id").select("doc_id", "block_id", "ord", model.filled(templates["author"], text=F.substring(tx.slice_of("text", F.col("start"), F.col("end")), 1, 1500)).alias("prompt"), F.lit("light").alias("model"))
    p = F.col("parsed")
    authors = _asked(heads, replay, make).select("doc_id", "block_id", "ord", F.nullif(tx.strip(F.try_variant_get(p, "$.name", "string")), F.lit("")).alias("author"), said(p, "$.type", "organization").alias("author_type"), F.coalesce(F.try_variant_get(p, "$.is_individual", "boolean"), F.lit(False)).alias("alone"))
    authors = authors.where("author is not null and not alone").withColumn("appearance_order", F.row_number().over(order)).drop("ord", "alone")
    spans = segment.block_sentences(docs, blocks.join(authors.select("doc_id", "block_id"), ["doc_id", "block_id"], "left_semi")).where("is_comment_text")
    texts = lookup.neighbours(spans.join(docs.select("doc_id", F.col("text").alias("whole")), "doc_id").withColumn("text", tx.strip(tx.slice_of("whole", F.col("start"), F.col("end")))).drop("whole"))
    ranked = retrieval.cued_spans(texts)
    several = ranked.groupBy("doc_id", "block_id").agg(F.array_sort(F.collect_list(F.struct("rank", "span_id", "text"))).alias("cs")).where(F.size("cs") > 1)  # three at most
    shown = F.array_join(F.transform("cs", lambda c: F.concat(F.lit("["), c["span_id"], F.lit("] "), c["text"])), "\n")
    picked = _asked(several.select("doc_id", "block_id", model.filled(templates["quote"], sentences=shown).alias("prompt"), F.lit("light").alias("model")), replay, make).select("doc_id", "block_id", F.try_variant_get("parsed", "$.span_id", "string").alias("span_id"), F.col("parsed").isNull().alias("failed"))
    best = fields.chosen_quote(ranked.select("doc_id", "block_id", "rank", "span_id"), picked)
    quotes = best.join(texts.select("doc_id", "block_id", "span_id", "text", "context", "start"), ["doc_id", "block_id", "span_id"])
    stance = "struct<stance:string,stance_target:string,confidence:double>"
    asked = lambda rows, name: _asked(rows.select("doc_id", "block_id", model.filled(templates["stance"], sentence=F.col("text"), context=F.coalesce("context", F.lit(""))).alias("prompt"), F.lit(name).alias("model")), replay, make).select("doc_id", "block_id", F.try_variant_get("parsed", "$", stance).alias("x")).select("doc_id", "block_id", F.struct(F.col("x.stance").alias("stance"), F.col("x.stance_target").alias("target"), F.col("x.confidence").alias("confidence")).alias(name))
    light = asked(quotes, "light")
    unsure = light.where((F.coalesce("light.confidence", F.lit(0.0)) < 0.7) | (F.col("light.stance") == "mixed")).select("doc_id", "block_id")
    heavy = asked(quotes.join(unsure, ["doc_id", "block_id"], "left_semi"), "heavy")
    rows = authors.join(quotes, ["doc_id", "block_id"], "left").join(light, ["doc_id", "block_id"], "left").join(heavy, ["doc_id", "block_id"], "left").withColumn("s", fields.stance_of(F.col("light"), F.col("heavy")))
    has = F.col("text").isNotNull()
    return rows.select("doc_id", "block_id", "author", "author_type", F.col("text").alias("quote"), tx.squeeze(F.regexp_replace("text", r"-\n\s*", "")).alias("display"), F.when(has, tx.page_of(F.col("start"))).alias("page"), F.when(has, F.coalesce("s.stance", F.lit("neutral"))).alias("stance"), F.when(has, F.col("s.target")).alias("target"), F.when(has, F.coalesce("s.confidence", F.lit(0.5))).alias("confidence"), F.when(has, F.col("s.tier")).alias("tier"), "appearance_order")


def stakeholder_status(docs: DataFrame, blocks: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, status): ok with a stakeholder, needs_review with blocks alone, else no_comment_section_found."""
    rows = docs.select("doc_id").join(blocks.select("doc_id").distinct().withColumn("b", F.lit(True)), "doc_id", "left").join(found.select("doc_id").distinct().withColumn("s", F.lit(True)), "doc_id", "left")
    return rows.select("doc_id", F.when(F.col("s"), "ok").when(F.col("b"), "needs_review").otherwise("no_comment_section_found").alias("status"))


# checks of a record


def checked_quotes(people: DataFrame, chunks: DataFrame) -> DataFrame:
    """people (doc_id, name, quote, chunk_id) with a quote only where it stands in the chunk that it cites, and a warning where it does not."""
    rows = people.join(chunks.select("doc_id", "chunk_id", F.col("text").alias("_chunk")), ["doc_id", "chunk_id"], "left")
    ok = F.coalesce(F.contains(F.col("_chunk"), F.col("quote")), F.lit(False))
    return rows.select(*[c for c in people.columns if c != "quote"], F.when(ok, F.col("quote")).alias("quote"), F.when(F.col("quote").isNotNull() & ~ok, F.concat(F.lit("quote_verification_failed: entity="), "name")).alias("warning"))


def checked_record(records: DataFrame, people: DataFrame, chunks: DataFrame) -> DataFrame:
    """records (doc_id, year, date, primaries, subthemes, place, lat, lon) after the checks that need no model, with warnings in their order.

    A year out of range goes with its date; unknown themes go, `other` where none is left; a named place without a
    point is a warning. people and chunks as checked_quotes.
    """
    quotes = checked_quotes(people, chunks).where("warning is not null").groupBy("doc_id").agg(F.sort_array(F.collect_list("warning")).alias("_quotes"))  # the entities of one document
    rows = records.join(quotes, "doc_id", "left")
    bad_year = ~F.coalesce(tx.in_year_range(F.col("year")), F.lit(True))
    subs = sorted({s for x in vocab.THEMES.values() for s in x})
    known = {"primaries": F.lit(list(vocab.THEMES)), "subthemes": F.lit(subs)}
    bad = {c: F.array_except(c, k) for c, k in known.items()}
    kept = {c: F.array_intersect(c, k) for c, k in known.items()}
    left = F.when((F.size(bad["primaries"]) > 0) & (F.size(kept["primaries"]) == 0), F.array(F.lit("other"))).otherwise(kept["primaries"])
    warning = lambda cond, *parts: F.when(cond, F.concat(*parts))
    nowhere = (F.coalesce("place", F.lit("")) != "") & (F.col("lat").isNull() | F.col("lon").isNull())
    notes = F.array_compact(F.array(warning(bad_year, F.lit("year_invalid: "), F.col("year").cast("string")), warning(F.size(bad["primaries"]) > 0, F.lit("invalid_themes: "), F.array_join(bad["primaries"], ", ")), warning(F.size(bad["subthemes"]) > 0, F.lit("invalid_subthemes: "), F.array_join(bad["subthemes"], ", ")), warning(nowhere, F.lit("geocoding_failed: "), F.col("place"))))
    return rows.select("doc_id", F.when(~bad_year, F.col("year")).alias("year"), F.when(~bad_year, F.col("date")).alias("date"), left.alias("primaries"), kept["subthemes"].alias("subthemes"), "place", "lat", "lon", F.concat(F.coalesce("_quotes", F.array().cast("array<string>")), notes).alias("warnings"))

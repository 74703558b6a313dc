"""Fields of a record from catalog, text and model answers: each a ladder of sources with a status and a confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.operators import lookup
from docloom.plans import vocab


def field(value: Column, status: Column | str, source: Column | str | None, confidence: Column | float | None, note: Column | str | None = None) -> Column:
    lit = lambda x, kind: x if isinstance(x, Column) else F.lit(x).cast(kind)
    return F.struct(value.alias("value"), lit(status, "string").alias("status"), lit(source, "string").alias("source"), lit(confidence, "double").alias("confidence"), lit(note, "string").alias("note"))


def graded(value: Column, confidence: str, sources: list[str], note: Column | None = None) -> Column:
    return F.struct(value.alias("value"), F.lit(confidence).alias("confidence"), F.array(*[F.lit(s) for s in sources]).cast("array<string>").alias("sources"), (F.lit(None).cast("string") if note is None else note).alias("note"))


# header fields of the sampling lineage


def title_of(catalog: Column, model: Column) -> Column:
    """The catalog's title if it has 5 to 500 characters, else a model's."""
    t, m = tx.strip(catalog), F.nullif(tx.strip(model), F.lit(""))
    return F.when(F.length(t).between(5, 500), graded(t, "high", ["NUL"])).when(m.isNotNull(), graded(m, "medium", ["model (first page)"])).otherwise(graded(F.lit(None).cast("string"), "low", []))


def year_of(catalog: Column, text: Column, pages: int = 3) -> Column:
    """The catalog's year against the most frequent one of the first pages."""
    said = tx.top_year(tx.years(tx.first_pages(text, pages)))
    regex = f"regex (first {pages} pages)"
    note = F.concat(F.lit("NUL="), catalog, F.lit(" disagrees with regex="), said, F.lit(" — flag"))
    valid = catalog.between(vocab.YEAR_FIRST, vocab.YEAR_LAST)
    return (
        F.when(catalog.isNotNull() & (catalog == said), graded(catalog, "high", ["NUL", regex]))
        .when(valid & said.isNotNull(), graded(catalog, "low", ["NUL", regex], note))
        .when(valid, graded(catalog, "high", ["NUL"]))
        .when(said.isNotNull(), graded(said, "medium", [regex]))
        .otherwise(graded(F.lit(None).cast("int"), "low", []))
    )


def type_of(text: Column, model: Column) -> Column:
    """The first page's pattern against a model's answer on the first two pages."""
    found = F.nullif(tx.document_type(tx.first_pages(text, 1)), F.lit("Unknown"))
    said = F.nullif(tx.strip(F.coalesce(model, F.lit(""))), F.lit(""))
    a, b = "regex (first page)", "model (first 2 pages)"
    note = F.concat(F.lit("regex="), found, F.lit(" disagrees with model="), said)
    return F.when(found == said, graded(found, "high", [a, b])).when(found.isNotNull() & said.isNull(), graded(found, "medium", [a])).when(said.isNotNull() & found.isNull(), graded(said, "medium", [b])).when(found.isNotNull(), graded(found, "low", [a, b], note)).otherwise(graded(F.lit("Unknown"), "low", []))


def agencies_of(contributors: Column, model: Column) -> Column:
    """Catalog contributors without their roles, else a model's agencies; more than two get a note."""
    names = F.filter(F.transform(contributors, lambda c: tx.without_role(c)), lambda c: c != "")
    note = lambda a: F.when(F.size(a) > 2, F.concat(F.lit("joint lead: "), F.size(a), F.lit(" agencies")))
    return F.when(F.size(names) > 0, graded(names, "high", ["NUL"], note(names))).when(F.size(model) > 0, graded(model, "medium", ["model (first 4 pages)"], note(model))).otherwise(graded(F.array().cast("array<string>"), "low", []))


# header fields of the strict record


def record_title(catalog: Column, gap: Column, asked: bool) -> Column:
    said, got = F.nullif(catalog, F.lit("")), F.nullif(gap, F.lit(""))
    none = field(F.lit(None).cast("string"), "needs_review", None, None, "no title in catalog" if asked else "no title in catalog; no model asked")
    return F.when(said.isNotNull(), field(said, "extracted_from_mets", "nul_api", 0.99)).when(got.isNotNull(), field(got, "needs_review", "haiku_gapfill", 0.75)).otherwise(none)


def record_year(date: Column, front: Column) -> Column:
    """struct of the year as a field, and the publication date's value and precision: from the catalog, else the most frequent (then latest) year of the front pages; out of range needs review."""
    d = tx.parsed_date(date)
    seen = tx.top_year(tx.years(front, r"\b(19[7-9]\d|20\d{2})\b"), tie="latest")
    year = F.coalesce(d["year"], seen)
    ok = d["year"].isNotNull() & tx.in_year_range(year)
    source = F.when(d["year"].isNotNull(), "nul_api").when(seen.isNotNull(), "regex")
    confidence = F.when(d["year"].isNotNull(), 0.98).when(seen.isNotNull(), 0.80)
    return F.struct(field(year, F.when(ok, "extracted_from_mets").otherwise("needs_review"), source, confidence).alias("year"), F.coalesce(d["value"], seen.cast("string")).alias("published"), F.when(d["year"].isNotNull(), d["precision"]).when(seen.isNotNull(), "year").alias("precision"))


def record_agency(names: Column, cover: Column, gap: Column, asked: bool) -> Column:
    """The lead agency: catalog 0.99, cover 0.85, then without a model the catalog's own words 0.60, with one its answer 0.70 or, outside the vocabulary, 0.45."""
    listed, seen, got = lookup.agency_in_list(names), lookup.agency_in_cover(cover), F.nullif(gap, F.lit(""))
    first = F.get(F.filter(names, lambda n: F.coalesce(n, F.lit("")) != ""), 0)
    none = field(F.lit(None).cast("string"), "needs_review", None, None)
    known = lookup.agency_abbreviation(got)
    out = F.when(listed.isNotNull(), field(listed["abbreviation"], "extracted_from_mets", "nul_api", 0.99, F.concat(F.lit("matched "), listed["label"]))).when(seen.isNotNull(), field(seen["abbreviation"], "needs_review", "controlled_vocab_match", 0.85, F.concat(F.lit("matched "), seen["label"], F.lit(" in cover"))))
    if asked:
        out = out.when(known.isNotNull(), field(known, "needs_review", "haiku_gapfill", 0.70)).when(got.isNotNull(), field(got, "needs_review", "haiku_gapfill", 0.45, F.lit("not in vocabulary")))
    else:
        out = out.when(first.isNotNull(), field(first, "needs_review", "nul_api", 0.60, F.lit("not in vocabulary")))
    return out.otherwise(none)


def catalog_only(catalog_title: Column, date: Column, names: Column) -> Column:
    """struct(title, year, agency, warning) from the catalog alone; another agency than USFS is a warning."""
    agency = record_agency(names, F.lit(""), F.lit(None).cast("string"), False)
    warning = F.when(agency["value"].isNotNull() & (agency["value"] != "USFS"), F.concat(F.lit("lead agency is "), agency["value"]))
    return F.struct(record_title(catalog_title, F.lit(None).cast("string"), False).alias("title"), record_year(date, F.lit(""))["year"].alias("year"), agency.alias("agency"), warning.alias("warning"))


def record_type(cover: Column, model: Column, asked: bool) -> Column:
    found, valid = tx.cover_type(cover), ["Draft", "Final", "Supplemental", "ROD", "NOI", "Unlabelled"]
    out = F.when(found.isNotNull(), field(found, "extracted_from_cover", "regex", 0.95))
    if asked:
        named = F.coalesce(model.isin(valid), F.lit(False))
        out = out.when(named & (model != "Unlabelled"), field(model, "extracted_from_cover", "haiku_classifier", 0.80)).when(named, field(model, "needs_review", "haiku_classifier", 0.40))
        return out.otherwise(field(F.lit("Unlabelled"), "needs_review", "haiku_classifier", 0.30))
    return out.otherwise(field(F.lit("Unlabelled"), "needs_review", "regex", 0.30))


def catalog_year_or_text(mets: Column, front: Column, whole: Column) -> Column:
    """struct(year, date, warning): the catalog's year, with a warning if the text's vote is over a year off; else the vote of the front pages, else of the whole text."""
    said = F.nullif(F.regexp_extract(mets, r"\b(\d{4})\b", 1), F.lit("")).cast("int")
    said = F.when(said.between(vocab.YEAR_FIRST, vocab.YEAR_LAST), said)
    seen = F.coalesce(tx.weighted_year(front), tx.weighted_year(whole))
    warning = F.when(F.abs(said - seen) > 1, F.concat(F.lit("year_mismatch: METS="), said, F.lit(" vs extracted="), seen, F.lit(" — using METS"))).when(said.isNull() & seen.isNull(), "year_not_found")
    return F.struct(F.coalesce(said, seen).alias("year"), F.when(said.isNotNull(), mets).otherwise(seen.cast("string")).alias("date"), warning.alias("warning"))


def first_line_title(mets: Column, text: Column) -> Column:
    lines = F.filter(F.transform(F.split(text, r"\r\n|[\n\r\x0B\f\x1C\x1D\x1E\x85  ]"), lambda x: tx.strip(x)), lambda x: F.length(x) > 10)
    return F.coalesce(F.nullif(mets, F.lit("")), F.substring(F.get(lines, 0), 1, 200))


# body fields: what goes to a model, and what its answers become

SUMMARY = ["project_description", "affected_community", "alternatives_overview", "environmental_impact", "public_response"]


def chunk_prompts(chunks: DataFrame, template: str, model: str, most: int = 80_000) -> DataFrame:
    """A prompt for each chunk, its text cut to `most` characters: rows that one partition each can ask."""
    from docloom.operators.model import filled

    return chunks.withColumn("prompt", filled(template, text=F.substring("text", 1, most), chunk=F.col("chunk"))).withColumn("model", F.lit(model))


def reduced_prompts(answers: DataFrame, template: str, model: str) -> DataFrame:
    """One prompt a document from its chunks' answers, in order: (doc_id, n_chunks, prompt, model)."""
    from docloom.operators.model import filled

    parts = answers.where("response is not null").groupBy("doc_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "response"))), lambda x: x["response"])).alias("findings"), F.count("*").alias("n_chunks"))
    return parts.select("doc_id", "n_chunks", filled(template, findings=F.col("findings")).alias("prompt"), F.lit(model).alias("model"))


def summary_fields(parsed: Column, main_only: bool) -> Column:
    """struct of five parts of (text, source_pages); missing parts are empty; the public response says whether it rests on the main document alone."""
    part = lambda k: F.struct(F.coalesce(F.try_variant_get(parsed, f"$.{k}.text", "string"), F.try_variant_get(parsed, f"$.{k}", "string"), F.lit("")).alias("text"), F.coalesce(F.try_variant_get(parsed, f"$.{k}.source_pages", "array<string>"), F.array().cast("array<string>")).alias("source_pages"))
    return F.struct(*[part(k).alias(k) for k in SUMMARY], F.coalesce(F.try_variant_get(parsed, "$.public_response.based_on_main_doc_only", "boolean"), F.lit(main_only)).alias("based_on_main_doc_only"))


def places(parsed: Column, roles: list[str]) -> Column:
    """array of places with a name and a known role."""
    listed = F.coalesce(F.try_variant_get(parsed, "$.places", "array<struct<name:string,role:string,state:string>>"), F.array().cast("array<struct<name:string,role:string,state:string>>"))
    return F.filter(listed, lambda p: (F.coalesce(tx.strip(p["name"]), F.lit("")) != "") & F.coalesce(p["role"].isin(roles), F.lit(False)))


def geocoded(named: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """named (doc_id, name, state) with lat and lon to 6 places from a gazetteer (name, state, lat, lon); places it does not know stay without."""
    g = gazetteer.groupBy(F.lower("name").alias("_n"), F.coalesce(F.lower("state"), F.lit("")).alias("_s")).agg(F.min_by(F.struct("lat", "lon"), F.struct("lat", "lon")).alias("at"))
    rows = named.withColumn("_n", F.lower(tx.strip("name"))).withColumn("_s", F.coalesce(F.lower("state"), F.lit("")))
    return rows.join(g, ["_n", "_s"], "left").select(*named.columns, F.round("at.lat", 6).alias("lat"), F.round("at.lon", 6).alias("lon"))


def commenter_quotes(quotes: Column, squeezed: Column) -> Column:
    """Commenters (…, quote) with quote_verified; those with an empty quote go."""
    some = F.filter(quotes, lambda c: F.coalesce(tx.strip(c["quote"]), F.lit("")) != "")
    return F.transform(some, lambda c: c.withField("quote_verified", tx.quoted(c["quote"], squeezed)))


def described_labels(labels: DataFrame, descriptions: DataFrame, degraded: DataFrame) -> DataFrame:
    """labels with description and status: ok only if a model described the label and the text came from a section."""
    rows = labels.join(descriptions.select("doc_id", "label", "description", "found"), ["doc_id", "label"], "left").join(degraded.select("doc_id", "degraded").distinct(), "doc_id", "left")
    ok = F.coalesce(F.col("found") & (F.coalesce("description", F.lit("")) != "") & ~F.col("degraded"), F.lit(False))
    return rows.select(*labels.columns, F.coalesce("description", F.lit("")).alias("description"), F.when(ok, "ok").otherwise("needs_review").alias("status"))


def chosen_quote(candidates: DataFrame, picked: DataFrame | None = None) -> DataFrame:
    """(doc_id, block_id, span_id, method): the only candidate; else a model's pick, null if it names no candidate; else, without an answer, the first.

    candidates: (doc_id, block_id, rank, span_id); picked: (doc_id, block_id, span_id, failed).
    """
    each = candidates.groupBy("doc_id", "block_id").agg(F.array_sort(F.collect_list(F.struct("rank", "span_id"))).alias("cs"))
    rows = each.withColumns({"pick": F.lit(None).cast("string"), "failed": F.lit(True)}) if picked is None else each.join(picked.select("doc_id", "block_id", F.col("span_id").alias("pick"), "failed"), ["doc_id", "block_id"], "left")
    first, known = F.col("cs")[0]["span_id"], F.exists("cs", lambda c: c["span_id"] == F.col("pick"))
    no_answer = F.coalesce(F.col("failed"), F.lit(True))
    span = F.when((F.size("cs") == 1) | no_answer, first).when(known, F.col("pick"))
    return rows.select("doc_id", "block_id", span.alias("span_id"), F.when(F.size("cs") == 1, "only").when(no_answer, "first").when(F.coalesce(known, F.lit(False)), "model").otherwise("none").alias("method"))


def stance_of(light: Column, heavy: Column) -> Column:
    """struct(stance, target, confidence, tier): the light model's answer, the heavy one's where that was unsure or mixed; unknown stances become null, unknown targets `unknown`."""
    targets = ["proposed_action", "alternative", "project", "agency", "process", "unknown"]
    unsure = (F.coalesce(light["confidence"], F.lit(0.0)) < 0.7) | (light["stance"] == "mixed")
    use = F.when(unsure & heavy.isNotNull(), heavy).otherwise(light)
    return F.struct(F.when(use["stance"].isin(vocab.RECORD_STANCES), use["stance"]).alias("stance"), F.when(use["target"].isin(targets), use["target"]).otherwise("unknown").alias("target"), use["confidence"].alias("confidence"), F.when(unsure & heavy.isNotNull(), "heavy").otherwise("light").alias("tier"))


def deferred() -> Column:
    return F.struct(F.lit("deferred").alias("status"), F.lit(None).cast("string").alias("value"))

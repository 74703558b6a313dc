"""Cutting documents into chunks, chapters, sections, comment blocks and sentences.

Functions take a DataFrame of documents (doc_id, text) and return rows of (doc_id, start, end, ...). The text itself
does not go through a shuffle: spans are found per row and text is cut out by slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import spans as sp
from docloom.functions import text as tx
from docloom.plans import vocab


def fixed_chunks(docs: DataFrame, size: int = 125_000, stride: int = 120_000) -> DataFrame:
    """(doc_id, chunk, start, end, text): windows of `size` characters every `stride`, up to the first that reaches the end."""
    n = F.length("text")
    starts = F.when(n > 0, F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((n - size) / stride)).cast("int")))
    rows = docs.select("doc_id", "text", F.explode(starts).alias("chunk"))
    start = F.col("chunk") * stride
    end = F.least(start + size, F.length("text"))
    return rows.select("doc_id", "chunk", start.alias("start"), end.alias("end"), tx.slice_of("text", start, end).alias("text"))


def line_pages(docs: DataFrame, size: int = vocab.PAGE_CHARS) -> DataFrame:
    """(doc_id, page, start, end): pages of whole lines."""
    return docs.select("doc_id", F.explode(sp.line_pages("text", size)).alias("p")).select("doc_id", "p.page", "p.start", "p.end")


def joined_pages(docs: DataFrame) -> DataFrame:
    """(doc_id, text): trimmed pages joined by form feeds."""
    return docs.select("doc_id", F.array_join(sp.trimmed_pages(F.col("text")), "\f").alias("text"))


def _lines(text: Column, alternate: bool) -> Column:
    """Lines that end in a newline and have 1 to 100 characters. alternate: only every other one of a run of them, as a scan that takes both newlines finds."""
    if alternate:
        return F.transform(sp.regex_spans(text, r"(?:^|\n)([^\n]{1,100})\n"), lambda m: F.struct((m["end"] - 1 - F.length(m["g1"])).alias("start"), m["g1"].alias("match")))
    return F.transform(sp.regex_spans(text, r"(?m)^([^\n]{1,100})\n"), lambda m: F.struct(m["start"].alias("start"), m["g1"].alias("match")))


def chapters(docs: DataFrame, guard: int = 3000, alternate: bool = False) -> DataFrame:
    """(doc_id, chapter, label, start, end): of each standard chapter the heading with the longest reach to the next heading.

    Headings before `guard` characters are taken for a table of contents.
    """
    lines = docs.select("doc_id", F.length("text").alias("n"), F.explode(_lines(F.col("text"), alternate)).alias("l"))
    found = lines.select("doc_id", "n", F.col("l.start").alias("start"), F.col("l.match").alias("line"))
    found = found.where((F.col("start") >= guard) & tx.is_heading_line("line")).withColumn("chapter", tx.chapter_of("line")).where("chapter is not null")
    w = Window.partitionBy("doc_id").orderBy("start")
    found = found.withColumn("end", F.coalesce(F.lead("start").over(w), F.col("n")))
    best = Window.partitionBy("doc_id", "chapter").orderBy(F.col("start") - F.col("end"), "start")
    return found.withColumn("r", F.row_number().over(best)).where("r = 1").select("doc_id", "chapter", tx.strip("line").alias("label"), "start", "end")


def labelled_chunks(chunks: DataFrame, found: DataFrame) -> DataFrame:
    """Chunks with the chapter that holds their midpoint, the first by start. Chapters are at most six a document, so they travel as one array."""
    each = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "chapter", "label"))).alias("chapters"))
    middle = F.floor((F.col("start") + F.col("end")) / 2)
    rows = chunks.join(each, "doc_id", "left").withColumn("c", sp.contains_offset(F.col("chapters"), middle))
    return rows.select(*chunks.columns, F.col("c.chapter").alias("chapter"), F.col("c.label").alias("label"))


def chapter_text(docs: DataFrame, found: DataFrame, chapter: str) -> DataFrame:
    """(doc_id, text, first_page, last_page) of one chapter."""
    rows = docs.join(found.where(F.col("chapter") == chapter).select("doc_id", "start", "end"), "doc_id")
    return rows.select("doc_id", tx.slice_of("text", F.col("start"), F.col("end")).alias("text"), tx.page_of(F.col("start")).alias("first_page"), tx.page_of(F.col("end")).alias("last_page"))


def rejected(text: Column, start: Column, end: Column, around: int = 60) -> Column:
    """An address or a citation stands around a match."""
    begin = F.greatest(F.lit(0), start - around)
    window = tx.slice_of(text, begin, end + around)
    out = F.lit(False)
    for pattern in vocab.SECTION_REJECTS:
        out = out | window.rlike(pattern)
    return out


def heading_hits(docs: DataFrame) -> DataFrame:
    """(doc_id, section, start, end): of each section the first heading line that is not rejected. One scan finds all patterns."""
    # white space before a heading may begin on earlier, blank lines; a match is then put to its section by its own words
    any_of = "|".join(vocab.SECTION_HEADINGS.values())
    spans = docs.select("doc_id", "text", F.explode(sp.regex_spans("text", rf"(?im)^\s*({any_of})\s*$")).alias("m"))
    kept = spans.where(~rejected(F.col("text"), F.col("m.start"), F.col("m.end")))
    section = None
    for name, pattern in vocab.SECTION_HEADINGS.items():
        hit = F.col("m.g1").rlike(rf"(?i)^(?:{pattern})$")
        section = F.when(hit, name) if section is None else section.when(hit, name)
    rows = kept.select("doc_id", section.alias("section"), F.col("m.start").alias("start"), F.col("m.end").alias("end"))
    return rows.groupBy("doc_id", "section").agg(F.min(F.struct("start", "end")).alias("s")).select("doc_id", "section", "s.start", "s.end")


def sections(docs: DataFrame, more: DataFrame | None = None, page_chars: int = vocab.PAGE_CHARS) -> DataFrame:
    """(doc_id, section, ord, start, end, first_page, last_page, confidence, status, method): nine rows for each document.

    The cover is pages 1 to 3. Heading lines come first, then the rows of `more` (doc_id, section, start, end, confidence,
    status, method, priority) for sections still missing. Each found section reaches to the next found one, the last to
    the end; what is missing is not_found.
    """
    pages = sp.line_pages("text", page_chars)
    base = docs.select("doc_id", F.length("text").alias("n"), pages.alias("pages"))
    covers = base.where("n > 0").select("doc_id", F.lit("cover").alias("section"), F.lit(0).alias("start"), F.array_max(F.slice("pages", 1, 3)["end"]).alias("end"), F.lit(1.0).alias("confidence"), F.lit("ok").alias("status"), F.lit("default_pages").alias("method"), F.lit(0).alias("priority"))
    found = heading_hits(docs).select("doc_id", "section", "start", "end", F.lit(0.9).alias("confidence"), F.lit("ok").alias("status"), F.lit("regex").alias("method"), F.lit(1).alias("priority"))
    every = covers.unionByName(found)
    if more is not None:
        every = every.unionByName(more.select(*every.columns))
    first = Window.partitionBy("doc_id", "section").orderBy("priority", F.col("start").asc_nulls_last())
    every = every.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r", "priority")
    extends = (F.col("section") != "cover") & (F.col("status") == "ok") & F.col("start").isNotNull()
    after = Window.partitionBy("doc_id", extends).orderBy("start", "section")
    every = every.withColumn("next", F.when(extends, F.lead("start").over(after)))
    names = docs.sparkSession.createDataFrame(list(enumerate(vocab.SECTIONS)), "ord int, section string")
    rows = base.join(F.broadcast(names)).join(every, ["doc_id", "section"], "left")
    to = F.coalesce("next", "n")
    end = F.when(extends & (to > F.col("start")), to).otherwise(F.col("end"))
    rows = rows.withColumn("end", end).withColumn("p", sp.page_range(F.col("pages"), F.col("start"), F.col("end")))
    return rows.select("doc_id", "section", "ord", "start", "end", F.col("p.first").alias("first_page"), F.col("p.last").alias("last_page"), "confidence", F.coalesce("status", F.lit("not_found")).alias("status"), F.coalesce("method", F.lit("none")).alias("method"))


def toc_sections(docs: DataFrame, titles: DataFrame) -> DataFrame:
    """Rows for `more` of sections(): what a model took for headings, as (doc_id, ord, title, anchor); the first anchor that is found counts for a section."""
    rows = titles.withColumn("section", tx.section_of("title")).where("section is not null").join(docs, "doc_id")
    rows = rows.withColumn("start", tx.locate_anchor(F.col("text"), F.col("anchor"))).where("start is not null")
    best = rows.groupBy("doc_id", "section").agg(F.min_by(F.struct("start", F.length("anchor").alias("n")), "ord").alias("b"))
    return best.select("doc_id", "section", F.col("b.start").alias("start"), (F.col("b.start") + F.col("b.n")).alias("end"), F.lit(0.85).alias("confidence"), F.lit("ok").alias("status"), F.lit("ai_toc").alias("method"), F.lit(2).alias("priority"))


def candidate_headings(docs: DataFrame, most: int = 5000) -> DataFrame:
    """(doc_id, start, line): lines of 4 to 80 characters that open with a capital, end without a full stop and are half capitals or in title case."""
    rows = docs.select("doc_id", F.posexplode(sp.line_spans(F.col("text"))).alias("pos", "l")).select("doc_id", "pos", F.col("l.start").alias("start"), tx.strip("l.match").alias("line"))
    titled = F.col("line").rlike(r"\p{Lu}") & ~F.col("line").rlike(r"(?:^|[^\p{L}])\p{Ll}|\p{L}\p{Lu}")
    ok = F.length("line").between(4, 80) & F.col("line").rlike(r"^\p{Lu}") & ~F.endswith("line", F.lit(".")) & (tx.mostly_upper("line", 0.5) | titled)
    w = Window.partitionBy("doc_id").orderBy("pos")
    return rows.where(ok).withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).select("doc_id", "start", "line")


def nearest_descriptor(candidates: DataFrame, descriptors: DataFrame, threshold: float = 0.55, margin: float = 0.10) -> DataFrame:
    """(key, name, best, score, runner_up, status): for each key and descriptor the candidate with the largest cosine.

    candidates: (key, item, embedding); descriptors: (name, embedding), at most a few dozen, which are broadcast as one
    row. Below the threshold there is no row; within the margin of the second the status is ambiguous.
    """
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    some = descriptors.select(F.col("name"), F.col("embedding").alias("e"))
    if some.limit(257).count() > 256:
        raise ValueError("at most 256 descriptors")
    pairs = candidates.join(F.broadcast(some))
    scored = pairs.select("key", "name", "item", (dot("embedding", "e") / F.sqrt(dot("embedding", "embedding") * dot("e", "e"))).alias("score"))
    w = Window.partitionBy("key", "name").orderBy(F.desc("score"), "item")
    ranked = scored.withColumn("r", F.row_number().over(w)).where("r <= 2")
    best = ranked.groupBy("key", "name").agg(F.max(F.when(F.col("r") == 1, F.col("item"))).alias("best"), F.max(F.when(F.col("r") == 1, F.col("score"))).alias("score"), F.coalesce(F.max(F.when(F.col("r") == 2, F.col("score"))), F.lit(0.0)).alias("runner_up"))
    return best.where(F.col("score") >= threshold).withColumn("status", F.when(F.col("score") - F.col("runner_up") < margin, "ambiguous").otherwise("ok"))


def sampled_text(text: Column, part: int = 5000) -> Column:
    """Head, middle and tail of a long text, else all of it."""
    n = F.length(text)
    middle = F.substr(text, (n / 2 - part / 2).cast("int") + 1, F.lit(part))
    return F.when(n > 3 * part, F.concat_ws("\n\n[...]\n\n", F.substring(text, 1, part), middle, F.right(text, F.lit(part)))).otherwise(text)


def page_blocks(pages: DataFrame, size: int = 30) -> DataFrame:
    """(doc_id, block, first_page, last_page, start, end): blocks of so many pages in order."""
    w = Window.partitionBy("doc_id").orderBy("page")
    rows = pages.withColumn("block", F.floor((F.row_number().over(w) - 1) / size).cast("int"))
    return rows.groupBy("doc_id", "block").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.min("start").alias("start"), F.max("end").alias("end"))


def document_chunks(pages: DataFrame, categories: DataFrame, section_pages: DataFrame, size: int = 30) -> DataFrame:
    """(doc_id, chunk_id, first_page, last_page): one chunk for a short document; one a section where sections are known; else blocks of pages.

    categories: (doc_id, length_category); section_pages: (doc_id, first_page, last_page).
    """
    spans = pages.groupBy("doc_id").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page")).join(categories, "doc_id", "left")
    short = spans.where("length_category = 'short'").select("doc_id", "first_page", "last_page")
    rest = spans.where("length_category is null or length_category <> 'short'").select("doc_id")
    by_section = section_pages.join(rest, "doc_id", "left_semi").select("doc_id", "first_page", "last_page")
    by_block = page_blocks(pages.join(rest, "doc_id", "left_semi").join(section_pages, "doc_id", "left_anti"), size).select("doc_id", "first_page", "last_page")
    w = Window.partitionBy("doc_id").orderBy("first_page", "last_page")
    return short.union(by_section).union(by_block).withColumn("chunk_id", F.format_string("c%02d", F.row_number().over(w))).select("doc_id", "chunk_id", "first_page", "last_page")


def toc_starts(hits: DataFrame, gap: int = 200, least: int = 3) -> DataFrame:
    """(doc_id, start, end): located headings in order, those within `gap` of the last kept dropped; none if fewer than `least` are left.

    hits: (doc_id, start, n), n the document's length. The first heading is kept wherever it stands.
    """
    each = hits.groupBy("doc_id", "n").agg(F.array_sort(F.collect_list("start")).alias("starts"))
    keep = F.aggregate("starts", F.array().cast("array<int>"), lambda kept, s: F.when((F.size(kept) == 0) | (s - F.try_element_at(kept, F.lit(-1)) >= gap), F.concat(kept, F.array(s.cast("int")))).otherwise(kept))
    rows = each.withColumn("kept", keep).where(F.size("kept") >= least).select("doc_id", "n", "kept", F.posexplode("kept").alias("i", "start"))
    return rows.select("doc_id", "start", F.coalesce(F.get(F.col("kept"), F.col("i") + 1), F.col("n")).alias("end"))


def toc_headings(docs: DataFrame, least: int = 5) -> DataFrame:
    """(doc_id, start, heading, next_start, has_headings, has_toc): real headings, the first of each 100 characters."""
    has_toc = F.substr(F.col("text"), F.lit(1), F.greatest(F.lit(1000), F.floor(F.length("text") / 10).cast("int"))).rlike(r"(?imd)^\s*Table\s+of\s+Contents\s*$")
    each = docs.select("doc_id", has_toc.alias("has_toc"), F.concat(*[sp.regex_spans("text", p) for p in vocab.HEADING_LINES]).alias("ms"))
    rows = each.select("doc_id", "has_toc", F.explode_outer("ms").alias("m")).select("doc_id", "has_toc", F.col("m.start").alias("start"), tx.strip("m.match").alias("heading"))
    real = rows.where(tx.is_heading_text("heading"))
    first = Window.partitionBy("doc_id", F.floor(F.col("start") / 100)).orderBy("start", "heading")
    real = real.withColumn("r", F.row_number().over(first)).where("r = 1")
    w = Window.partitionBy("doc_id").orderBy("start")
    real = real.select("doc_id", "start", "heading", F.lead("start").over(w).alias("next_start"), F.count("*").over(Window.partitionBy("doc_id")).alias("k"))
    flags = each.select("doc_id", "has_toc")
    return flags.join(real, "doc_id", "left").select("doc_id", "start", "heading", "next_start", (F.coalesce("k", F.lit(0)) >= least).alias("has_headings"), "has_toc")


def comment_blocks(docs: DataFrame, target: int = 3000) -> DataFrame:
    """(doc_id, block_id, ord, start, end): from each COMMENT header to the next; without any, packs of paragraphs up to `target` characters.

    A comment number that repeats gets a suffix, so that block_id is unique in a document.
    """
    rows = docs.select("doc_id", F.length("text").alias("n"), sp.regex_spans("text", vocab.COMMENT_HEADER).alias("hs"), F.col("text"))
    headed = rows.where(F.size("hs") > 0).select("doc_id", "n", "hs", F.posexplode("hs").alias("i", "h"))
    headed = headed.select("doc_id", F.col("h.g1").alias("no"), F.col("i").alias("ord"), F.col("h.start").alias("start"), F.coalesce(F.get(F.col("hs"), F.col("i") + 1)["start"], F.col("n")).alias("end"))
    w = Window.partitionBy("doc_id", "no").orderBy("ord")
    seen = F.row_number().over(w)
    headed = headed.withColumn("block_id", F.concat(F.lit("block_"), "no", F.when(seen > 1, F.concat(F.lit("_"), seen)).otherwise(""))).drop("no")
    size = lambda p: p["end"] - p["start"]
    kind = "array<struct<start:int,end:int,chars:int>>"

    def pack(out: Column, p: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        fresh = F.array(F.struct(p["start"].alias("start"), p["end"].alias("end"), size(p).alias("chars")))
        grown = F.array(F.struct(last["start"].alias("start"), p["end"].alias("end"), (last["chars"] + size(p)).alias("chars")))
        return F.when(F.size(out) == 0, fresh).when(last["chars"] + size(p) >= target, F.concat(out, fresh)).otherwise(F.concat(F.slice(out, 1, F.size(out) - 1), grown))

    packs = rows.where(F.size("hs") == 0).select("doc_id", F.posexplode(F.aggregate(sp.paragraph_spans(F.col("text")), F.array().cast(kind), pack)).alias("ord", "b"))
    packs = packs.select("doc_id", "ord", F.col("b.start").alias("start"), F.col("b.end").alias("end"), F.concat(F.lit("block_"), F.col("ord") + 1).alias("block_id"))
    return headed.unionByName(packs).select("doc_id", "block_id", "ord", "start", "end")


def block_parts(docs: DataFrame, blocks: DataFrame) -> DataFrame:
    """blocks with comment_start/end, response_start/end and split_status: cut at the first line that says Response."""
    rows = blocks.join(docs.select("doc_id", "text"), "doc_id").withColumn("b", tx.slice_of("text", F.col("start"), F.col("end")))
    rows = rows.withColumn("m", F.get(sp.regex_spans("b", vocab.RESPONSE_HEADER), 0))
    none, split = F.col("m").isNull(), F.col("m.start") > 0
    return rows.select(
        *blocks.columns,
        F.when(none | split, F.col("start")).alias("comment_start"),
        F.when(none, F.col("end")).when(split, F.col("start") + F.col("m.start")).alias("comment_end"),
        F.when(~none & split, F.col("start") + F.col("m.end")).alias("response_start"),
        F.when(~none & split, F.col("end")).alias("response_end"),
        F.when(none, "no_response").when(split, "ok").otherwise("comment_response_split_failed").alias("split_status"),
    )


def block_sentences(docs: DataFrame, parts: DataFrame) -> DataFrame:
    """(doc_id, block_id, n, span_id, start, end, page, is_comment_text): sentences of the comment, then of the response; a failed split is one span."""
    rows = parts.join(docs.select("doc_id", "text", sp.line_pages("text").alias("pages")), "doc_id")

    def cut(start: str, end: str, comment: bool) -> DataFrame:
        part = rows.where(F.col(start).isNotNull())
        spans = sp.sentence_spans(tx.slice_of("text", F.col(start), F.col(end)))
        return part.select("doc_id", "block_id", "pages", F.explode(spans).alias("s"), F.col(start).alias("at"), F.lit(comment).alias("is_comment_text")).select("doc_id", "block_id", "pages", (F.col("at") + F.col("s.start")).alias("start"), (F.col("at") + F.col("s.end")).alias("end"), "is_comment_text")

    failed = rows.where("split_status = 'comment_response_split_failed'").select("doc_id", "block_id", "pages", "start", "end", F.lit(False).alias("is_comment_text"))
    every = cut("comment_start", "comment_end", True).union(cut("response_start", "response_end", False)).union(failed)
    w = Window.partitionBy("doc_id", "block_id").orderBy(F.desc("is_comment_text"), "start")
    page = F.coalesce(sp.contains_offset(F.col("pages"), F.col("start"))["page"], F.lit(1))
    every = every.withColumn("n", F.row_number().over(w))
    return every.select("doc_id", "block_id", "n", F.concat("block_id", F.lit("_s"), "n").alias("span_id"), "start", "end", page.alias("page"), "is_comment_text")


def block_pages(pages: Column, start: Column, end: Column) -> Column:
    """array<int> of the pages a block covers, page 1 where its start is off the text."""
    first = F.coalesce(sp.contains_offset(pages, start)["page"], F.lit(1))
    return F.sequence(first, F.coalesce(sp.contains_offset(pages, F.greatest(end - 1, start))["page"], first))


def components(docs: DataFrame) -> DataFrame:
    """docs with one component, main, that spans the document."""
    return docs.withColumn("components", F.array(F.struct(F.lit("main").alias("name"), F.lit(0).alias("start"), F.length("text").alias("end"))))

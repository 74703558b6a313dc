"""Choosing chunks and windows of text for a field, and packing them into a context."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import spans as sp
from docloom.functions import text as tx
from docloom.plans import vocab


def _top(rows: DataFrame, order: list, most: int | None) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy(*order)
    rows = rows.withColumn("rank", F.row_number().over(w))
    return rows if most is None else rows.where(F.col("rank") <= most)


def by_tags(chunks: DataFrame, tags: list[str], most: int = 8) -> DataFrame:
    """Used chunks with a tag, those with more of the tags first; rank from 1."""
    n = F.size(F.array_intersect("tags", F.lit(tags)))
    return _top(chunks.where("used").withColumn("hits", n).where("hits > 0"), [F.desc("hits"), "chunk_index"], most)


def keyword_count(text: Column, keywords: list[str], case_sensitive: bool = False) -> Column:
    """Occurrences of all keywords, none overlapping one of its own."""
    t = text if case_sensitive else F.lower(text)
    out = F.lit(0)
    for k in keywords:
        k = k if case_sensitive else k.lower()
        out = out + (F.length(t) - F.length(F.replace(t, F.lit(k), F.lit("")))) / len(k)
    return out.cast("long")


def by_keywords(chunks: DataFrame, keywords: list[str], most: int = 8, case_sensitive: bool = False) -> DataFrame:
    """Used chunks with a keyword, those with more occurrences first; rank from 1."""
    rows = chunks.where("used").withColumn("hits", keyword_count(F.col("text"), keywords, case_sensitive)).where("hits > 0")
    return _top(rows, [F.desc("hits"), "chunk_index"], most)


def mentioning(chunks: DataFrame, names: DataFrame) -> DataFrame:
    """(doc_id, name, chunk_index): used chunks that hold a name of their document, ignoring case."""
    return chunks.where("used").join(names.select("doc_id", "name").distinct(), "doc_id").where(F.contains(F.lower("text"), F.lower("name"))).select("doc_id", "name", "chunk_index")


def first_mention(chunks: DataFrame, names: DataFrame) -> DataFrame:
    return mentioning(chunks, names).groupBy("doc_id", "name").agg(F.min("chunk_index").alias("first_chunk"))


def cascade_chunks(chunks: DataFrame, tags: list[str], keywords: list[str] | None, first: int | None, most: int) -> DataFrame:
    """By tags; for documents without any by keywords; for those still without the first used chunks. A branch that is None is left out."""
    used = _top(chunks.where("used"), ["chunk_index"], None)
    tagged = by_tags(chunks, tags, most).withColumn("branch", F.lit("tags"))
    out = tagged.select("doc_id", "chunk_index", "rank", "branch")
    for branch, rows in (("keywords", by_keywords(chunks, keywords, most) if keywords else None), ("first", used.where(F.col("rank") <= first) if first else None)):
        if rows is not None:
            rest = rows.join(out.select("doc_id").distinct(), "doc_id", "left_anti").withColumn("branch", F.lit(branch))
            out = out.unionByName(rest.select("doc_id", "chunk_index", "rank", "branch"))
    return out


def either_chunks(chunks: DataFrame, tags: list[str], keywords: list[str], most: int = 8) -> DataFrame:
    """Chunks by tags, then by keywords, each once, the first `most`."""
    both = by_tags(chunks, tags).select("doc_id", "chunk_index", F.lit(0).alias("source"), "rank").union(by_keywords(chunks, keywords).select("doc_id", "chunk_index", F.lit(1).alias("source"), "rank"))
    once = both.groupBy("doc_id", "chunk_index").agg(F.min(F.struct("source", "rank")).alias("o"))
    return _top(once, ["o"], most).select("doc_id", "chunk_index", "rank")


def tagged_first(chunks: DataFrame, most: int = 12) -> DataFrame:
    """Labelled chunks before others, `most` in all, in document order again."""
    rows = _top(chunks, [F.col("chapter").isNull(), "chunk_index"], most).drop("rank")
    return _top(rows, ["chunk_index"], None)


def packed_context(chunks: DataFrame, most: int = 60_000, least: int = 200) -> DataFrame:
    """(doc_id, context): chunks (doc_id, rank, chunk_id, title, first_page, last_page, text) under headers while they fit; of the first that does not, a cut piece if more than `least` characters are left."""
    head = F.concat(F.lit("[Chunk "), "chunk_id", F.lit(" | Pages "), F.coalesce(F.col("first_page").cast("string"), F.lit("?")), F.lit("–"), F.coalesce(F.col("last_page").cast("string"), F.lit("?")), F.lit(" | "), "title", F.lit("]\n"))
    w = Window.partitionBy("doc_id").orderBy("rank")
    rows = chunks.select("doc_id", "rank", F.concat(head, "text").alias("block")).withColumn("n", F.length("block"))
    rows = rows.withColumn("before", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    fits = F.col("before") + F.col("n") <= most
    rows = rows.withColumn("bad", F.sum((~fits).cast("int")).over(w))
    part = F.when(F.col("bad") == 0, F.col("block")).when((F.col("bad") == 1) & ~fits & (most - F.col("before") > least), F.concat(F.substr(F.col("block"), F.lit(1), (most - F.col("before")).cast("int")), F.lit("\n[TRUNCATED]")))
    parts = rows.select("doc_id", "rank", part.alias("part")).where("part is not null")
    return parts.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "part"))), lambda p: p["part"]), "\n\n").alias("context"))


def section_window(docs: DataFrame, sections: DataFrame, name: str) -> DataFrame:
    """(doc_id, start, end, text) of a found section."""
    some = sections.where((F.col("section") == name) & (F.col("status") == "ok") & F.col("start").isNotNull()).select("doc_id", "start", "end")
    return some.join(docs.select("doc_id", "text"), "doc_id").select("doc_id", "start", "end", tx.slice_of("text", F.col("start"), F.col("end")).alias("text"))


def keyword_windows(docs: DataFrame, keywords: list[str], most: int = 8, width: int = 2000, ignore_case: bool = True) -> DataFrame:
    """(doc_id, n, start, end): stretches around keywords at word edges, joined where they meet, the first `most`.

    Of the hits, the first 4 * most + 1 count.
    """
    if not keywords:
        return docs.sparkSession.createDataFrame([], docs.select("doc_id").schema).select("doc_id", F.lit(0).alias("n"), F.lit(0).alias("start"), F.lit(0).alias("end"))
    pattern = ("(?i)" if ignore_case else "") + r"\b(?:" + "|".join(re.escape(k) for k in keywords) + r")\b"
    half = width // 2
    hits = docs.select("doc_id", F.length("text").alias("len"), F.slice(sp.regex_spans("text", pattern), 1, 4 * most + 1).alias("ms"))
    bounds = F.transform("ms", lambda m: F.struct(F.greatest(F.lit(0), m["start"] - half).alias("start"), F.least(F.col("len"), m["end"] + half).alias("end")))
    kind = "array<struct<start:int,end:int>>"

    def join(out: Column, b: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        wider = F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], b["end"]).alias("end")))
        return F.when((F.size(out) > 0) & (b["start"] <= last["end"]), F.concat(F.slice(out, 1, F.size(out) - 1), wider)).otherwise(F.concat(out, F.array(b)))

    merged = F.slice(F.aggregate(bounds, F.array().cast(kind), join), 1, most)
    return hits.select("doc_id", F.posexplode(merged).alias("n", "w")).select("doc_id", (F.col("n") + 1).alias("n"), "w.start", "w.end")


SECTION_SOURCES = {"regex": "regex", "ai_toc": "ai_toc", "embedding_fallback": "embedding_fallback", "default_pages": "regex"}


def retrieved(docs: DataFrame, sections: DataFrame, primary: list[str], keywords: list[str], most: int = 6, width: int = 2000, first: int = 10_000) -> DataFrame:
    """(doc_id, n, start, end, source, section, degraded): the first found section of `primary`; else keyword windows; else the first characters."""
    ranks = F.create_map(*[F.lit(x) for k, s in enumerate(primary) for x in (s, k)])
    ok = sections.where(F.col("section").isin(primary) & (F.col("status") == "ok") & F.col("start").isNotNull())
    best = ok.groupBy("doc_id").agg(F.min_by(F.struct("section", "start", "end", "method"), F.try_element_at(ranks, F.col("section"))).alias("b"))
    source = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SECTION_SOURCES.items() for x in kv]), F.col("b.method")), F.lit("regex"))
    one = best.select("doc_id", F.lit(1).alias("n"), "b.start", "b.end", source.alias("source"), F.col("b.section").alias("section"), F.lit(False).alias("degraded"))
    rest = docs.select("doc_id", "text").join(one.select("doc_id"), "doc_id", "left_anti")
    two = keyword_windows(rest, keywords, most, width).select("doc_id", "n", "start", "end", F.lit("fallback_keyword").alias("source"), F.lit(None).cast("string").alias("section"), F.lit(True).alias("degraded"))
    last = rest.join(two.select("doc_id").distinct(), "doc_id", "left_anti").where(F.length("text") > 0)
    three = last.select("doc_id", F.lit(1).alias("n"), F.lit(0).alias("start"), F.least(F.length("text"), F.lit(first)).alias("end"), F.lit("fallback_first_n").alias("source"), F.lit(None).cast("string").alias("section"), F.lit(True).alias("degraded"))
    return one.union(two).union(three)


def window_bounds(windows: DataFrame) -> DataFrame:
    return windows.groupBy("doc_id").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def cued_spans(spans: DataFrame, most: int = 3, shortest: int = 30, longest: int = 400) -> DataFrame:
    """Spans (doc_id, block_id, n, text) of a fair length with the most cues of a stance, of equals the first; score and rank."""
    score = tx.let(F.lower("text"), lambda low: F.size(F.filter(F.lit(vocab.CUES), lambda c: F.contains(low, c))))
    rows = spans.where(F.length("text").between(shortest, longest)).withColumn("score", score)
    w = Window.partitionBy("doc_id", "block_id").orderBy(F.desc("score"), "n")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def labels(docs: DataFrame, windows: DataFrame, most: int = 12) -> DataFrame:
    """(doc_id, label, start, end, rank): names of alternatives in windows (doc_id, n, start, end), each once, by window, pattern and place."""
    rows = windows.select("doc_id", "n", F.col("start").alias("at"), "end").join(docs.select("doc_id", "text"), "doc_id").withColumn("w", tx.slice_of("text", F.col("at"), F.col("end")))

    def matches(k: int, pattern: str) -> Column:
        return F.transform(sp.regex_spans("w", pattern), lambda m: F.struct(F.lit(k).alias("pattern"), m["start"].alias("start"), m["match"].alias("match")))

    found = F.flatten(F.array(*[matches(k, p) for k, p in enumerate(vocab.LABELS)]))
    hits = rows.select("doc_id", "n", "at", F.explode(found).alias("m")).select("doc_id", "n", F.col("m.pattern").alias("pattern"), (F.col("at") + F.col("m.start")).alias("start"), F.length("m.match").alias("size"), tx.alternative_label("m.match").alias("label"))
    once = hits.groupBy("doc_id", "label").agg(F.min(F.struct("n", "pattern", "start", "size")).alias("o"))
    top = _top(once, ["o"], most)
    return top.select("doc_id", "label", F.col("o.start").alias("start"), (F.col("o.start") + F.col("o.size")).alias("end"), "rank")

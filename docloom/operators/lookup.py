"""Joins of works and documents, of agencies and dictionaries, and of spans and pages."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import spans as sp
from docloom.functions import text as tx
from docloom.plans import vocab


def matched_works(works: DataFrame, docs: DataFrame, grams: int = 5) -> DataFrame:
    """(work_id, doc_key, priority): the document of each work, by the first of four ways.

    works: (work_id, work_ord, accession, identifiers array<string>); docs: (doc_key, doc_ord). 1: the accession number;
    2: the same ignoring case; 3: an identifier, in order; 4: an identifier that is part of a document's key, in order of
    identifiers, then of documents. The fourth way runs only for works still without a document; identifiers of `grams`
    characters or more meet keys on one gram of theirs, so no cross join is needed, and shorter ones on their first letter.
    """
    d = docs.select("doc_key", "doc_ord")
    w = works.select("work_id", "accession", F.posexplode_outer("identifiers").alias("id_ord", "identifier"))
    each = works.select("work_id", "accession").where("accession <> ''")
    one = each.join(d, F.col("accession") == F.col("doc_key")).select("work_id", "doc_key", F.lit(1).alias("priority"), F.lit(0).alias("id_ord"), "doc_ord")
    two = each.join(d, F.lower("accession") == F.lower("doc_key")).select("work_id", "doc_key", F.lit(2).alias("priority"), F.lit(0).alias("id_ord"), "doc_ord")
    three = w.join(d, F.col("identifier") == F.col("doc_key")).select("work_id", "doc_key", F.lit(3).alias("priority"), "id_ord", "doc_ord")
    early = one.union(two).union(three)
    left = w.where("identifier <> ''").join(early.select("work_id").distinct(), "work_id", "left_anti")
    size = F.least(F.length("identifier"), F.lit(grams))
    keyed = left.withColumn("gram", F.substr(F.col("identifier"), F.lit(1), size))
    parts = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length("doc_key")), lambda i: F.transform(F.sequence(F.lit(1), F.lit(grams)), lambda n: F.substr(F.col("doc_key"), i, n)))))
    part_rows = d.where(F.length("doc_key") > 0).select("doc_key", "doc_ord", F.explode(parts).alias("gram"))
    four = keyed.join(part_rows, "gram").where(F.contains("doc_key", F.col("identifier"))).select("work_id", "doc_key", F.lit(4).alias("priority"), "id_ord", "doc_ord")
    best = early.union(four).groupBy("work_id").agg(F.min_by(F.struct("doc_key", "priority"), F.struct("priority", "id_ord", "doc_ord")).alias("b"))
    return best.select("work_id", "b.doc_key", "b.priority")


def work_of_document(works: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_key, work_id): for each document the first work, in order, that the document alone would match."""
    pairs = matched_works(works, docs).join(works.select("work_id", "work_ord"), "work_id")
    return pairs.groupBy("doc_key").agg(F.min_by("work_id", "work_ord").alias("work_id"))


def agency_abbreviation(name: Column | str) -> Column:
    """The abbreviation of a name, abbreviation or variant, ignoring case and outer white space; a map in the plan of some 80 entries."""
    pairs = F.create_map(*[F.lit(x) for v, short, _ in vocab.agency_variants() for x in (v, short)])
    return F.try_element_at(pairs, F.lower(tx.strip(name)))


def canonical_agency(abbreviation: Column | str) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for k, (name, _) in vocab.AGENCIES.items() for x in (k, name)]), tx.col(abbreviation))


def agency_in_list(names: Column) -> Column:
    """struct(abbreviation, label): the first name that is a variant, or holds one (the first in order)."""
    variants = F.array(*[F.struct(F.lit(v).alias("v"), F.lit(short).alias("a")) for v, short, _ in vocab.agency_variants()])
    inside = lambda n: tx.let(F.lower(n), lambda low: F.get(F.filter(variants, lambda x: F.contains(low, x["v"])), 0)["a"])
    hits = F.transform(F.filter(names, lambda n: F.coalesce(tx.strip(n), F.lit("")) != ""), lambda n: F.struct(F.coalesce(agency_abbreviation(n), inside(tx.strip(n))).alias("abbreviation"), tx.strip(n).alias("label")))
    return F.get(F.filter(hits, lambda h: h["abbreviation"].isNotNull()), 0)


def agency_in_cover(cover: Column) -> Column:
    """struct(abbreviation, label, start): the longest variant of over 3 characters that the cover holds, at its first place."""
    ranked = sorted((x for x in vocab.agency_variants() if len(x[0]) > 3), key=lambda x: (-len(x[0]), x[2]))
    variants = F.array(*[F.struct(F.lit(v).alias("v"), F.lit(short).alias("a")) for v, short, _ in ranked])

    def found(low: Column) -> Column:
        def place(hit: Column) -> Column:
            at = F.position(hit["v"], low) - 1
            return F.struct(hit["a"].alias("abbreviation"), F.substr(cover, at + 1, F.length(hit["v"])).alias("label"), at.alias("start"))

        return F.get(F.transform(F.slice(F.filter(variants, lambda x: F.contains(low, x["v"])), 1, 1), place), 0)

    return tx.let(F.lower(cover), found)


def nearest_agency(text: Column, ratio: float = 0.85, most: int = 50) -> Column:
    """struct(abbreviation, label) of the first of `most` name-like stretches whose edit distance to a variant is small enough; ratio: one less the distance by the longer length."""
    stretches = F.slice(F.regexp_extract_all(text, F.lit(r"[A-Z][A-Za-z\s&,.'-]{5,80}"), F.lit(0)), 1, most)
    variants = F.array(*[F.struct(F.lit(v).alias("v"), F.lit(short).alias("a")) for v, short, _ in vocab.agency_variants()])

    def best(s: Column) -> Column:
        def nearest(low: Column) -> Column:
            # variants of a very different length cannot be near: their distance is not computed
            n = F.length(low)
            some = F.filter(variants, lambda x: F.least(n, F.length(x["v"])) >= ratio * F.greatest(n, F.length(x["v"])))
            scored = F.transform(some, lambda x: F.struct((1 - F.levenshtein(low, x["v"]) / F.greatest(n, F.length(x["v"]), F.lit(1))).alias("score"), x["a"].alias("a")))
            return F.array_max(F.filter(scored, lambda x: x["score"] >= ratio))["a"]

        return tx.let(F.lower(tx.strip(s)), nearest)

    hits = F.transform(stretches, lambda s: F.struct(best(s).alias("abbreviation"), tx.strip(s).alias("label")))
    return F.get(F.filter(hits, lambda h: h["abbreviation"].isNotNull()), 0)


def lead_agency(catalog: Column, front: Column) -> Column:
    """struct(name, abbreviation, source): the catalog's agency as it is or by its canonical name; else an exact phrase, an acronym, or a near phrase of the front matter; else unknown."""
    said = F.nullif(tx.strip(catalog), F.lit(""))
    first = lambda pattern: F.get(F.filter(F.transform(F.regexp_extract_all(front, F.lit(pattern), F.lit(0)), lambda s: agency_abbreviation(s)), lambda a: a.isNotNull()), 0)
    phrase, acronym, near = first(r"[A-Z][A-Za-z\s&,.'-]{2,60}"), first(r"\b[A-Z]{2,6}\b"), nearest_agency(front)["abbreviation"]
    out = lambda name, short, source: F.struct(name.alias("name"), short.cast("string").alias("abbreviation"), F.lit(source).alias("source"))
    found = F.coalesce(phrase, acronym)
    return F.when(said.isNotNull(), out(F.coalesce(canonical_agency(agency_abbreviation(said)), said), agency_abbreviation(said), "mets")).when(found.isNotNull(), out(canonical_agency(found), found, "regex")).when(near.isNotNull(), out(canonical_agency(near), near, "fuzzy_match")).otherwise(out(F.lit(None).cast("string"), F.lit(None), "unknown"))


def dictionary_hits(docs: DataFrame, variants: list[tuple[str, str]]) -> DataFrame:
    """(doc_id, canonical, first_at, n): entries of a dictionary of (variant, canonical) in each text.

    One alternation, longest first, at word edges and ignoring case; the dictionary is a parameter of bounded size.
    """
    if len(variants) > 5000:
        raise ValueError("a dictionary in one pattern has 5000 variants at most")
    pattern = r"(?i)\b(?:" + "|".join(re.escape(v) for v in sorted({v for v, _ in variants}, key=lambda v: (-len(v), v))) + r")\b"
    names = {}
    for v, c in variants:
        names[v.lower()] = c
    table = docs.sparkSession.createDataFrame(sorted(names.items()), "variant string, canonical string")
    rows = docs.select("doc_id", F.explode(sp.regex_spans("text", pattern)).alias("m")).select("doc_id", F.lower("m.match").alias("variant"), F.col("m.start").alias("start"))
    return rows.join(F.broadcast(table), "variant").groupBy("doc_id", "canonical").agg(F.min("start").alias("first_at"), F.count(F.lit(1)).alias("n"))


def agency_hits(docs: DataFrame) -> DataFrame:
    return dictionary_hits(docs, [(v, vocab.AGENCIES[short][0]) for v, short, _ in vocab.agency_variants()])


def cited_text(text: Column, spans: Column, most: int, single: bool = False) -> Column:
    """The text of page spans `a-b` (and `a`, if single pages count), joined and cut to `most` characters; other spans are skipped."""
    pattern = r"^\s*(\d+)\s*(?:-\s*(\d+)\s*)?$" if single else r"^\s*(\d+)\s*-\s*(\d+)\s*$"

    def part(s: Column) -> Column:
        first = F.regexp_extract(s, pattern, 1).try_cast("int")
        last = F.coalesce(F.regexp_extract(s, pattern, 2).try_cast("int"), first)
        at = tx.chars_of_pages(first, last, F.length(text))
        return tx.slice_of(text, at["start"], at["end"])

    parts = F.transform(F.filter(spans, lambda s: F.coalesce(s.rlike(pattern), F.lit(False))), part)
    return F.substring(F.array_join(parts, "\n\n[...]\n\n"), 1, most)


def pages_text(pages: DataFrame, first: int, last: int) -> DataFrame:
    """(doc_id, text): pages of (doc_id, page, text) from first to last, joined by form feeds."""
    some = pages.where(F.col("page").between(first, last))
    return some.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: p["text"]), "\f").alias("text"))


def neighbours(sentences: DataFrame) -> DataFrame:
    """sentences (doc_id, block_id, n, text) with the text of the sentences before and after."""
    w = Window.partitionBy("doc_id", "block_id").orderBy("n")
    return sentences.withColumn("context", F.concat_ws(" ", F.lag("text").over(w), F.lead("text").over(w)))

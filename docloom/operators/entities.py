"""Mentions, verified quotes and merged entries; names, dictionaries and scores of entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.plans import vocab

UNVERIFIED = "Quote not found verbatim in document — HUMAN_REVIEW will be forced."


def clean_mentions(raw: DataFrame) -> DataFrame:
    """Mentions of a known stance with an entity and a quote; unknown kinds become other, unknown modes direct_quote, missing pages the chunk's.

    raw: (doc_id, chunk_index, start_page, end_page, entity, kind, role, stance, attribution_mode, quote, evidence_pages, stance_basis).
    """
    trim = lambda c: tx.strip(F.coalesce(F.col(c), F.lit("")))
    kind, mode = F.lower(trim("kind")), F.lower(trim("attribution_mode"))
    span = F.array(F.concat_ws("-", "start_page", "end_page"))
    rows = raw.select(
        *[c for c in raw.columns if c not in ("entity", "kind", "role", "stance", "attribution_mode", "quote", "evidence_pages", "stance_basis")],
        trim("entity").alias("entity"),
        F.when(kind.isin(vocab.KINDS), kind).otherwise("other").alias("kind"),
        trim("role").alias("role"),
        F.lower(trim("stance")).alias("stance"),
        F.when(mode.isin(vocab.MODES), mode).otherwise("direct_quote").alias("attribution_mode"),
        trim("quote").alias("quote"),
        F.when(F.size(F.coalesce("evidence_pages", F.array().cast("array<string>"))) > 0, F.col("evidence_pages")).otherwise(span).alias("evidence_pages"),
        trim("stance_basis").alias("stance_basis"),
    )
    return rows.where(F.col("stance").isin(vocab.STANCES) & (F.col("entity") != "") & (F.col("quote") != ""))


def verified(mentions: DataFrame, docs: DataFrame) -> DataFrame:
    """mentions with quote_verified and verify_note. A document's text is squeezed once, before the join, and only for documents with mentions."""
    texts = docs.join(mentions.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", tx.squeeze("text").alias("_squeezed"))
    rows = mentions.join(texts, "doc_id", "left").withColumn("quote_verified", tx.quoted(F.col("quote"), F.col("_squeezed"))).drop("_squeezed")
    return rows.withColumn("verify_note", F.when(~F.col("quote_verified"), UNVERIFIED))


def merged(mentions: DataFrame, exact: bool = False) -> DataFrame:
    """One row for each document, entity and stance, numbered by first appearance.

    Members are ordered by chunk, name as written, and `ord` where the mentions have one (else their quote). Longest
    name and role, most frequent kind, best quote: verified ones first, then the longest; of equals the first.
    """
    rows = mentions.withColumn("_key", tx.entity_key("entity", exact)).where((F.col("_key") != "") & (F.coalesce("stance", F.lit("")) != ""))
    ord_ = F.col("ord") if "ord" in mentions.columns else F.col("quote")
    member = F.struct(F.coalesce("chunk_index", F.lit(0)).alias("chunk_index"), F.coalesce("entity", F.lit("")).alias("entity"), ord_.alias("ord"), "kind", "role", "attribution_mode", "quote", "quote_verified", "evidence_pages", F.coalesce("stance_basis", F.lit("")).alias("stance_basis"))
    groups = rows.groupBy("doc_id", "_key", "stance").agg(F.array_sort(F.collect_list(member)).alias("m"))
    m = F.col("m")

    def longest(values: Column) -> Column:
        best = F.array_max(F.transform(values, lambda v, i: F.struct(F.length(v).alias("n"), (-i).alias("o"), v.alias("v"))))
        return best["v"]

    kinds = F.transform(m, lambda x: F.coalesce(x["kind"], F.lit("other")))
    kind = F.array_max(F.transform(F.array_distinct(kinds), lambda k, i: F.struct(F.size(F.filter(kinds, lambda z: z == k)).alias("n"), (-i).alias("o"), k.alias("k"))))["k"]
    best = F.array_max(F.transform(m, lambda x, i: F.struct(x["quote_verified"].alias("a"), F.length(F.coalesce(x["quote"], F.lit(""))).alias("n"), (-i).alias("o"), x["quote"].alias("quote"), x["attribution_mode"].alias("mode"))))
    out = groups.select(
        "doc_id",
        longest(F.transform(m, lambda x: x["entity"])).alias("entity"),
        kind.alias("kind"),
        F.coalesce(longest(F.filter(F.transform(m, lambda x: x["role"]), lambda r: F.coalesce(r, F.lit("")) != "")), F.lit("")).alias("role"),
        "stance",
        best["mode"].alias("attribution_mode"),
        F.array_sort(F.array_distinct(F.transform(m, lambda x: F.coalesce(x["attribution_mode"], F.lit("direct_quote"))))).alias("attribution_modes_seen"),
        best["quote"].alias("summary_quote"),
        best["a"].alias("summary_quote_verified"),
        tx.distinct_pages(F.flatten(F.transform(m, lambda x: F.coalesce(x["evidence_pages"], F.array().cast("array<string>"))))).alias("evidence_pages"),
        F.size(m).alias("n_mentions"),
        m.alias("mentions"),
    )
    w = Window.partitionBy("doc_id").orderBy(F.col("mentions")[0]["chunk_index"], F.lower("entity"), "stance", "entity")
    return out.withColumn("sequence", F.row_number().over(w))


def distinct_names(names: DataFrame) -> DataFrame:
    """(doc_id, name, ord): the first casing of names (doc_id, name, ord) that differ in case alone."""
    rows = names.where(tx.strip("name") != "")
    return rows.groupBy("doc_id", F.lower(tx.strip("name")).alias("_key")).agg(F.min_by("name", "ord").alias("name"), F.min("ord").alias("ord")).drop("_key")


def layered_names(layers: list[tuple[str, DataFrame]]) -> DataFrame:
    """(doc_id, name, source, ord): names of several sources, of equal names the first source's. layers: (source, names), the most trusted first."""
    every = None
    for k, (source, names) in enumerate(layers):
        rows = names.select("doc_id", "name", F.lit(source).alias("source"), F.struct(F.lit(k).alias("layer"), F.col("ord")).alias("ord"))
        every = rows if every is None else every.unionByName(rows)
    best = every.where(tx.strip("name") != "").groupBy("doc_id", F.lower(tx.strip("name")).alias("_key")).agg(F.min_by(F.struct("name", "source"), "ord").alias("b"), F.min("ord").alias("ord"), F.count("*").alias("raw"))
    return best.select("doc_id", "b.name", "b.source", "ord", "raw")


def scored_entities(names: DataFrame, chunks: DataFrame, trusted: list[str], boilerplate: list[str] | None = None, least: int = 2, most: int = 50) -> DataFrame:
    """(doc_id, name, source, n, spread, score, first_chunk, appearance): the `most` best names by occurrences times chunks with one.

    names: (doc_id, name, source, ord); chunks: (doc_id, chunk_index, text). Untrusted names need `least` occurrences and
    pass the rules. A name meets only the chunks of its own document.
    """
    low = chunks.select("doc_id", "chunk_index", F.lower("text").alias("low"))
    rows = names.join(low, "doc_id")
    name = F.lower("name")
    n = (F.length("low") - F.length(F.replace("low", name, F.lit("")))) / F.length(name)
    rows = rows.select("doc_id", "name", "source", "ord", "chunk_index", n.cast("long").alias("n"))
    found = rows.groupBy("doc_id", "name", "source", "ord").agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("spread"), F.min(F.when(F.col("n") > 0, F.col("chunk_index"))).alias("first_chunk"))
    sure = F.col("source").isin(trusted)
    found = found.where(sure | ((F.col("n") >= least) & tx.is_entity_text("name", boilerplate or [])))
    found = found.withColumn("n", F.greatest("n", F.lit(1))).withColumn("score", F.col("n") * F.col("spread"))
    best = Window.partitionBy("doc_id").orderBy(F.desc("score"), "ord")
    place = Window.partitionBy("doc_id").orderBy(F.col("first_chunk").asc_nulls_last(), F.desc("score"), "ord")
    top = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= most)
    return top.withColumn("appearance", F.row_number().over(place)).drop("r", "ord")


def entity_type(name: Column, people: Column, organizations: Column) -> Column:
    return F.when(F.array_contains(organizations, name), "organization").when(F.array_contains(people, name), "person").otherwise("unknown")


def triaged(entities: DataFrame, kept: DataFrame, trusted: list[str]) -> DataFrame:
    """entities that are trusted or that a model kept: (doc_id, name); a document for which it kept nothing at all keeps everything."""
    answered = kept.select("doc_id").distinct().withColumn("_answered", F.lit(True))
    rows = entities.join(kept.select("doc_id", "name").distinct().withColumn("_kept", F.lit(True)), ["doc_id", "name"], "left").join(answered, "doc_id", "left")
    return rows.where(F.col("source").isin(trusted) | F.col("_kept") | F.col("_answered").isNull()).drop("_kept", "_answered")


def gap_chunks(chunks: DataFrame, names: DataFrame, most: int = 6, words: int = 2000, known: int = 3) -> DataFrame:
    """The chunks worth a second look: those tagged as comments, then long ones with few known names; by chunk_id as text."""
    low = chunks.join(names.select("doc_id", "name").distinct(), "doc_id", "left").groupBy("doc_id", "chunk_id").agg(F.count_if(F.contains(F.lower("text"), F.lower("name"))).alias("k"))
    rows = chunks.join(low, ["doc_id", "chunk_id"])
    tagged = F.array_contains("tags", "comments_and_responses")
    rank = F.when(tagged, 0).when((tx.n_words("text") >= words) & (F.col("k") < known), 1)
    w = Window.partitionBy("doc_id").orderBy("rank", "chunk_id")
    return rows.withColumn("rank", rank).where("rank is not null").withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).drop("r", "k", "rank")

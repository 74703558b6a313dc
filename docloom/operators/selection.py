"""The stratified sample of documents, its targets, and grading sheets."""

from __future__ import annotations

import random
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as tx

TARGETS = {"short": 5, "medium": 10, "long": 5}


def candidates(works: DataFrame, docs: DataFrame, least_chars: int = 200) -> DataFrame:
    """(work_id, doc_id, title, estimated_pages, ocr_chars, eis_type_guess, bureau_guess, bucket) of works with enough text.

    works: (work_id, doc_id, title, contributors); docs: (doc_id, text). The features are made before the join, so the
    text does not go through it.
    """
    cheap = docs.where(F.length(tx.strip("text")) >= least_chars).select("doc_id", tx.estimated_pages("text").alias("estimated_pages"), F.length("text").alias("ocr_chars"), F.substring("text", 1, 2 * tx.PAGE).alias("head"))
    rows = works.join(cheap.where("estimated_pages >= 1"), "doc_id")
    return rows.select("work_id", "doc_id", "title", "estimated_pages", "ocr_chars", tx.document_type("title", "head").alias("eis_type_guess"), tx.primary_bureau("contributors").alias("bureau_guess"), tx.length_bucket(F.col("estimated_pages")).alias("bucket"))


def adjusted_targets(available: dict[str, int], wanted: dict[str, int] = TARGETS) -> dict[str, int]:
    """Each bucket's target cut to what there is; what is missing goes to medium, short and long in turn."""
    got = {b: min(n, available.get(b, 0)) for b, n in wanted.items()}
    missing = sum(wanted.values()) - sum(got.values())
    for b in ("medium", "short", "long"):
        more = min(missing, available.get(b, 0) - got[b])
        got[b] += more
        missing -= more
    return got


def notes(available: dict[str, int], targets: dict[str, int], wanted: dict[str, int] = TARGETS) -> list[str]:
    out = [f"{b}: only {available.get(b, 0)} docs available (plan asked for {n}); taking all {available.get(b, 0)} and redistributing the deficit." for b, n in wanted.items() if available.get(b, 0) < n]
    if sum(targets.values()) != sum(wanted.values()):
        out.append(f"could not reach total target of {sum(wanted.values())}; selecting {sum(targets.values())} docs.")
    return out


def targets_table(pool: DataFrame, wanted: dict[str, int] = TARGETS) -> DataFrame:
    """(bucket, available, wanted, target): three rows, made from three counts."""
    counts = {r.bucket: r["count"] for r in pool.groupBy("bucket").count().collect()}
    got = adjusted_targets(counts, wanted)
    return pool.sparkSession.createDataFrame([(b, counts.get(b, 0), n, got[b]) for b, n in wanted.items()], "bucket string, available long, wanted int, target int")


def selected(pool: DataFrame, seed: int = 20260525, per_bureau: int = 4, wanted: dict[str, int] = TARGETS) -> DataFrame:
    """pool rows of the sample, with their place in it.

    Buckets are shuffled by the seed over their documents in order and filled greedily under a cap for each type and
    each bureau; the type's cap, then the bureau's, is lifted where a bucket stays short. Greedy choice under shared
    caps is sequential: the keys of the pool, which is a catalog's size, go to one task.
    """
    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rng = random.Random(seed)
        buckets = {b: rows[rows.bucket == b].sort_values("doc_id").to_dict("records") for b in wanted}
        for b in buckets.values():
            rng.shuffle(b)
        targets = adjusted_targets({b: len(v) for b, v in buckets.items()}, wanted)
        cap = max(2, (sum(targets.values()) + 2) // 3)
        types, bureaus, chosen = Counter(), Counter(), []
        for b, members in buckets.items():
            taken: set = set()
            for type_cap, bureau_cap in ((cap, per_bureau), (None, per_bureau), (None, None)):
                for k, c in enumerate(members):
                    if len(taken) >= targets[b]:
                        break
                    if k in taken or (bureau_cap and bureaus[c["bureau_guess"]] >= bureau_cap) or (type_cap and types[c["eis_type_guess"]] >= type_cap):
                        continue
                    taken.add(k)
                    types[c["eis_type_guess"]] += 1
                    bureaus[c["bureau_guess"]] += 1
                    chosen.append((c["doc_id"], len(chosen) + 1))
        return pd.DataFrame(chosen, columns=["doc_id", "place"])

    keys = pool.select("doc_id", "bucket", "eis_type_guess", "bureau_guess")
    kind = dict(pool.dtypes)["doc_id"]
    places = keys.withColumn("_all", F.lit("all")).groupBy("_all").applyInPandas(lambda rows: pick(rows), f"doc_id {kind}, place int")
    return pool.join(places, "doc_id")


GRADED = ["title", "year", "eis_type", "lead_agency", "summary.project_description", "summary.affected_community", "summary.alternatives_overview", "summary.environmental_impact", "summary.public_response", "alternatives", "themes", "location", "key_people.agency_preparers", "key_people.cooperating_agencies", "key_people.public_commenters"]


def grading_rows(fields: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Fifteen rows for each document: field, extracted_value, source_pages, critic_verdict, model_confidence, your_grade, your_notes.

    fields: (doc_id, field, value, source_pages array<string>, confidence) by the names of GRADED; verdicts: (doc_id, field,
    verdict, model_confidence, notes) by the part before the dot. Notes go to the first part of a field alone.
    """
    names = fields.sparkSession.createDataFrame([(k, f, f.split(".")[0], "." not in f or f in ("summary.project_description", "key_people.agency_preparers"), "." in f, 600 if f.startswith("summary.") else 400) for k, f in enumerate(GRADED)], "ord int, field string, base string, first boolean, part boolean, most int")
    docs = fields.select("doc_id").distinct()
    v = verdicts.select("doc_id", F.col("field").alias("base"), "verdict", "model_confidence", "notes")
    rows = docs.join(F.broadcast(names)).join(fields, ["doc_id", "field"], "left").join(v, ["doc_id", "base"], "left")
    none = lambda c: F.coalesce(F.col(c), F.lit(""))
    value = F.when(F.col("most") == 600, tx.short(F.col("value"), 600)).otherwise(tx.short(F.col("value"), 400))
    confidence = F.when(F.col("part"), none("model_confidence")).otherwise(F.coalesce(F.nullif("confidence", F.lit("")), "model_confidence", F.lit("")))
    note = F.when(F.col("first"), F.when(F.col("part"), tx.short(F.col("notes"), 200)).otherwise(tx.short(F.col("notes"), 300))).otherwise("")
    return rows.select("doc_id", "ord", "field", value.alias("extracted_value"), tx.page_list(F.col("source_pages")).alias("source_pages"), none("verdict").alias("critic_verdict"), confidence.alias("model_confidence"), F.lit("").alias("your_grade"), note.alias("your_notes"))


def critic_pages(field: Column, front: str, pages: Column, most: int = 8) -> Column:
    """What a critic reads of a field: the front matter for header fields, nothing for themes, else the distinct spans, capped for the summary."""
    once = F.array_distinct(F.coalesce(pages, F.array().cast("array<string>")))
    return F.when(field.isin("title", "year", "eis_type", "lead_agency"), F.array(F.lit(front))).when(field == "themes", F.array().cast("array<string>")).when(field == "summary", F.slice(once, 1, most)).otherwise(once)

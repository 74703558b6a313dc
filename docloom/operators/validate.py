"""Gates, references between parts of a record, overrides of verdicts, and routing."""

from __future__ import annotations

import itertools
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions import text as tx
from docloom.plans import vocab

QUOTE_NOTE = " [Forced HUMAN_REVIEW: quote not verbatim.]"
PRIVATE_NOTE = " [Forced HUMAN_REVIEW: stance attribution for a private individual always goes to a human (v2 policy override).]"
COMMENTER_NOTE = " [Forced HUMAN_REVIEW: private-individual stance present (policy override).]"


def known_verdict(verdict: Column, notes: Column) -> Column:
    """struct(verdict, notes): a verdict outside the vocabulary becomes HUMAN_REVIEW with a note."""
    ok = F.coalesce(verdict.isin(vocab.VERDICTS), F.lit(False))
    return F.struct(F.when(ok, verdict).otherwise("HUMAN_REVIEW").alias("verdict"), F.when(ok, F.coalesce(notes, F.lit(""))).otherwise(F.concat(F.coalesce(notes, F.lit("")), F.lit(" [Unknown verdict: "), F.coalesce(verdict, F.lit("none")), F.lit("]"))).alias("notes"))


def entry_override(verdict: Column, notes: Column, quote_verified: Column, kind: Column) -> Column:
    """struct(verdict, notes): unverified quotes and private individuals go to a human; a verdict that already says so is left alone."""
    human = verdict == "HUMAN_REVIEW"
    note = F.when(human, F.lit("")).when(~F.coalesce(quote_verified, F.lit(False)), QUOTE_NOTE).when(kind == "individual", PRIVATE_NOTE).otherwise("")
    forced = ~F.coalesce(quote_verified, F.lit(False)) | (kind == "individual")
    return F.struct(F.when(forced, "HUMAN_REVIEW").otherwise(verdict).alias("verdict"), F.concat(F.coalesce(notes, F.lit("")), note).alias("notes"))


def commenter_override(field: Column, verdict: Column, notes: Column, commenters: Column) -> Column:
    """struct(verdict, notes): a private commenter with a stance sends key_people to a human. commenters: array of (kind, stance)."""
    private = F.coalesce(F.exists(commenters, lambda c: (c["kind"] == "private") & (F.coalesce(c["stance"], F.lit("")) != "")), F.lit(False))
    force = (field == "key_people") & private & (verdict != "HUMAN_REVIEW")
    return F.struct(F.when(force, "HUMAN_REVIEW").otherwise(verdict).alias("verdict"), F.concat(F.coalesce(notes, F.lit("")), F.when(force, COMMENTER_NOTE).otherwise("")).alias("notes"))


def span_ok(start: Column, end: Column) -> Column:
    return F.coalesce((start >= 0) & (start < end), F.lit(False))


def quote_at(text: Column, quote: Column, start: Column, end: Column) -> Column:
    """The quote is the text from start to end."""
    inside = span_ok(start, end) & (end <= F.length(text))
    return F.coalesce(inside & (tx.slice_of(text, start, end) == quote), F.lit(False))


def theme_gate(themes: DataFrame) -> DataFrame:
    """(doc_id, value, parent, keep, reason): primaries (parent null) and subthemes against the vocabulary.

    Dropped are unknown and repeated primaries, and subthemes that are unknown, whose parent is not chosen, or that
    belong to another parent. themes: (doc_id, ord, value, parent, confidence).
    """
    parents: dict[str, list[str]] = {}
    for p, subs in vocab.THEMES.items():
        for s in subs:
            parents.setdefault(s, []).append(p)
    owners = F.create_map(*[x for s, ps in parents.items() for x in (F.lit(s), F.lit(ps))])
    first = themes.where("parent is null").groupBy("doc_id", "value").agg(F.min("ord").alias("first_ord"))
    chosen = first.where(F.col("value").isin(list(vocab.THEMES))).groupBy("doc_id").agg(F.collect_set("value").alias("chosen"))  # 13 at most
    rows = themes.join(first, ["doc_id", "value"], "left").join(chosen, "doc_id", "left")
    owner, mine = F.try_element_at(owners, F.col("value")), F.coalesce("chosen", F.array().cast("array<string>"))
    primary = F.when(~F.col("value").isin(list(vocab.THEMES)), "primary not in vocabulary").when(F.col("ord") > F.col("first_ord"), "repeated primary")
    sub = F.when(owner.isNull(), "subtheme not in vocabulary").when(~F.array_contains(mine, F.col("parent")), "parent not chosen").when(~F.array_contains(owner, F.col("parent")), "subtheme of another parent")
    reason = F.when(F.col("parent").isNull(), primary).otherwise(sub)
    return rows.select("doc_id", "ord", "value", "parent", F.coalesce("confidence", F.lit(0.5)).alias("confidence"), reason.isNull().alias("keep"), reason.alias("reason"))


def gated_themes(themes: DataFrame) -> DataFrame:
    """(doc_id, primaries, subthemes, status): what is kept, in order; other / needs_review where anything was dropped or nothing is left."""
    kept = theme_gate(themes)
    part = lambda of: F.transform(F.array_sort(F.collect_list(F.when(F.col("keep") & of, F.struct("ord", "value")))), lambda x: x["value"])
    out = kept.groupBy("doc_id").agg(part(F.col("parent").isNull()).alias("primaries"), part(F.col("parent").isNotNull()).alias("subthemes"), F.bool_or(~F.col("keep")).alias("dropped"))
    return out.select("doc_id", F.when(F.size("primaries") == 0, F.array(F.lit("other"))).otherwise(F.col("primaries")).alias("primaries"), "subthemes", F.when(F.col("dropped") | (F.size("primaries") == 0), "needs_review").otherwise("ok").alias("status"))


def vocabulary_only(values: Column, known: list[str], empty: str) -> Column:
    kept = F.array_intersect(values, F.lit(known))
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit(empty)))


def point_ok(point: Column, polygon: Column) -> Column:
    return point.isNull() | polygon.isNotNull()


def gates(verbatim: Column, year: Column, themes: Column, geocoding: Column, schema: Column) -> Column:
    """struct of five gates (pass or fail), the routing and its reasons; nulls pass."""
    named = {"verbatim_quotes": verbatim, "year_range": year, "theme_vocab": themes, "geocoding_centroid": geocoding, "schema_validation": schema}
    ok = {k: F.coalesce(v, F.lit(True)) for k, v in named.items()}
    reasons = F.array_compact(F.array(*[F.when(~v, f"{k} failed") for k, v in ok.items()]))
    return F.struct(*[F.when(v, "pass").otherwise("fail").alias(k) for k, v in ok.items()], F.when(F.size(reasons) > 0, "full_review").otherwise("auto_approve").alias("routing"), reasons.alias("reasons"))


def violations(parts: dict[str, DataFrame]) -> DataFrame:
    """(doc_id, rule, item): a row for each constraint that a record breaks.

    parts may hold sections (doc_id, section, status, start, end), provenance (doc_id, item, section, start, end), blocks
    (doc_id, block_id), spans (doc_id, block_id, span_id, is_comment_text), stakeholders (doc_id, item, block_id), quotes
    (doc_id, item, block_id, span_id, section), subthemes (doc_id, value, parent) with primaries (doc_id, value), places
    (doc_id, item, role, has_polygon) with polygons (doc_id), and cross_links (doc_id, status). References into a part
    that has no row for the document are not checked, for sections and blocks.
    """
    out: list[DataFrame] = []
    row = lambda df, rule, item: df.select("doc_id", F.lit(rule).alias("rule"), F.col(item).cast("string").alias("item"))

    def dangling(child: DataFrame, parent: DataFrame, keys: list[str], strict: bool) -> DataFrame:
        left = child.join(parent.select("doc_id", *keys).distinct(), ["doc_id", *keys], "left_anti")
        return left if strict else left.join(parent.select("doc_id").distinct(), "doc_id", "left_semi")

    s = parts.get("sections")
    if s is not None:
        out.append(row(s.where((F.col("status") == "ok") & F.col("start").isNull()), "ok_needs_span", "section"))
        out.append(row(s.where(F.col("start").isNotNull() & ~span_ok(F.col("start"), F.col("end"))), "span_bounds", "section"))
    p = parts.get("provenance")
    if p is not None:
        out.append(row(p.where(F.col("start").isNotNull() & ~span_ok(F.col("start"), F.col("end"))), "offset_bounds", "item"))
        if s is not None:
            out.append(row(dangling(p.where("section is not null"), s, ["section"], False), "section_exists", "item"))
    if "stakeholders" in parts and "blocks" in parts:
        out.append(row(dangling(parts["stakeholders"], parts["blocks"], ["block_id"], False), "block_exists", "item"))
    q = parts.get("quotes")
    if q is not None:
        if "spans" in parts:
            out.append(row(dangling(q, parts["spans"].where("is_comment_text"), ["block_id", "span_id"], True), "quote_in_comment", "item"))
        out.append(row(q.where(~F.coalesce(F.col("section").isin("public_comments", "response_to_comments"), F.lit(False))), "quote_section", "item"))
    if "subthemes" in parts and "primaries" in parts:
        named = parts["primaries"].select("doc_id", F.col("value").alias("parent"))
        out.append(row(dangling(parts["subthemes"], named, ["parent"], True), "parent_chosen", "value"))
    if "polygons" in parts and "places" in parts:
        ok = parts["places"].where("role = 'project_area' and has_polygon").select("doc_id").distinct()
        out.append(row(parts["polygons"].join(ok, "doc_id", "left_anti"), "polygon_needs_place", "doc_id"))
    if "cross_links" in parts:
        out.append(row(parts["cross_links"].where("status <> 'deferred'"), "cross_links_deferred", "status"))
    whole = out[0]
    for df in out[1:]:
        whole = whole.unionByName(df)
    return whole


def agency_supported(name: Column, aliases: Column, text: Column) -> Column:
    """An agency's name or an alias of it stands in the text; no agency passes."""
    names = F.array_append(F.coalesce(aliases, F.array().cast("array<string>")), name)
    return name.isNull() | tx.let(F.lower(text), lambda low: F.exists(names, lambda a: (F.coalesce(a, F.lit("")) != "") & F.contains(low, F.lower(a))))


def claim_downgrades(verdicts: DataFrame) -> DataFrame:
    """(doc_id, summary_failed, history_failed): a `no` on the summary or on any historical claim."""
    no = F.col("verdict") == "no"
    return verdicts.groupBy("doc_id").agg(F.coalesce(F.bool_or(no & (F.col("field_path") == "summary.text")), F.lit(False)).alias("summary_failed"), F.coalesce(F.bool_or(no & F.startswith("field_path", F.lit("historical_context_internal.claims"))), F.lit(False)).alias("history_failed"))


class _Held:
    """Batches put aside in order, beyond `most` bytes in a temporary file."""

    def __init__(self, most: int):
        self.most, self.file, self.writer = most, None, None

    def add(self, batch: pa.RecordBatch) -> None:
        if self.file is None:
            self.file = tempfile.SpooledTemporaryFile(self.most)
            self.writer = pa.ipc.new_stream(self.file, batch.schema)
        self.writer.write_batch(batch)

    def taken(self) -> Iterator[pa.RecordBatch]:
        if self.file is not None:
            self.writer.close()
            self.file.seek(0)
            yield from pa.ipc.open_stream(self.file)
            self.file.close()
            self.file = self.writer = None


def _all(*parts: bool | None) -> bool | None:
    """AND as SQL has it."""
    return False if False in parts else None if None in parts else True


def _dispatch(cap: float, retries: int, hold: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Folds claims that come document by document and in order; ord is the place in the document.

    What a document has spent in the end stands in each of its rows, so rows wait until it is known: until no tier is
    open any more, after which nothing is spent, or until the document ends.
    """
    shares = {"haiku": cap * 1.0, "sonnet": cap * 0.75}
    opus = cap * 0.5
    top = max(opus, *shares.values())
    less = lambda a, b: None if a is None else a < b
    same = lambda a, b: None if a is None else a == b
    plus = lambda a, b: None if a is None or b is None else a + b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(hold)
        spent, retried = 0.0, 0

        def done(b: pa.RecordBatch, spents: list[float | None], counts: list[int | None]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*b.columns, pa.array(spents, pa.float64()), pa.array(counts, pa.int32())], names=[*b.schema.names, "spent", "retried"])

        def released() -> Iterator[pa.RecordBatch]:
            for b in held.taken():
                yield done(b, [spent] * b.num_rows, [retried] * b.num_rows)

        for b in batches:
            n = b.num_rows
            starts = set(np.flatnonzero(b.column("ord").to_numpy() == 0).tolist())
            tiers, verdicts, spents, counts = ["skipped_budget_cap"] * n, ["skipped"] * n, [], []
            for a, z in itertools.pairwise(sorted({0, *starts, n})):
                if a in starts:
                    yield from released()
                    spent, retried = 0.0, 0
                if spent is None or spent < top:
                    part = b.slice(a, z - a)
                    for i, (tier, verdict, cost, again_verdict, again_cost) in enumerate(zip(*(part.column(c).to_pylist() for c in ("tier", "verdict", "cost", "retry_verdict", "retry_cost")), strict=True), a):
                        runs = less(spent, shares.get(tier, opus))
                        if runs is False:
                            continue
                        if runs:
                            spent = plus(spent, cost)
                        again = _all(runs, same(tier, "sonnet"), same(verdict, "no"), less(retried, retries), less(spent, opus), again_verdict is not None)
                        tiers[i], verdicts[i] = ("opus", again_verdict) if again else (tier, verdict)
                        if again:
                            spent = plus(spent, again_cost)
                        retried = plus(retried, again)
                if z < n or not (spent is None or spent < top):
                    yield from released()
                    spents += [spent] * (z - a)
                    counts += [retried] * (z - a)
            rows = pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("ord"), b.column("field_path"), pa.array(tiers, pa.string()), pa.array(verdicts, pa.string())], names=["doc_id", "ord", "field_path", "tier", "verdict"])
            k = len(spents)
            yield done(rows.slice(0, k), spents, counts)
            if k < n:
                held.add(rows.slice(k))
        yield from released()

    return run


def dispatched(claims: DataFrame, cap: float, retries: int = 3, hold: int = 64 << 20) -> DataFrame:
    """Verdicts after tiers and budget: claims (doc_id, ord, field_path, tier, verdict, cost, retry_verdict, retry_cost).

    In order, a claim is skipped once what the document has spent closes its tier; a `no` of the middle tier is asked
    again in the highest, at most `retries` times a document. Whether a call is made depends on the calls before it, so
    the claims of a document are folded in order, in one pass over sorted rows: the time grows with the claims, and of
    those that wait for a document's sums `hold` bytes a task are in memory, the others in a temporary file.
    """
    place = Window.partitionBy("doc_id").orderBy("ord", "field_path", "tier", "verdict", "cost", "retry_verdict", "retry_cost")
    rows = claims.select("doc_id", (F.row_number().over(place) - 1).alias("ord"), "field_path", "tier", "verdict", F.col("cost").cast("double"), "retry_verdict", F.col("retry_cost").cast("double"))
    schema = T.StructType([*rows.schema[:5], T.StructField("spent", T.DoubleType()), T.StructField("retried", T.IntegerType())])
    return rows.mapInArrow(_dispatch(cap, retries, hold), schema)


def claim_payloads(records: DataFrame) -> DataFrame:
    """(doc_id, field_path, tier, claim, source): the claims of a record, one row each, for the critic's tiers.

    records: doc_id, title, year, eis_type, lead_agency, summary, themes array<string>, location, alternatives
    array<struct<name, description>>, people array<struct<name, stance>>, claims array<struct<text, source>>, context.
    """
    one = lambda path, c: F.struct(F.lit(path).alias("path"), F.lit(path).alias("instance"), c.cast("string").alias("claim"), F.col("context").alias("source"))
    many = lambda path, array, get, source=None: F.transform(F.coalesce(F.col(array), F.array()), lambda x, i: F.struct(F.lit(path).alias("path"), F.replace(F.lit(path), F.lit("[]"), F.concat(F.lit("["), i, F.lit("]"))).alias("instance"), get(x).cast("string").alias("claim"), (source(x) if source else F.col("context")).alias("source")))
    all_claims = F.concat(
        F.array(one("title", F.col("title")), one("year", F.col("year")), one("eis_type", F.col("eis_type")), one("lead_agency.name", F.col("lead_agency")), one("summary.text", F.col("summary")), one("themes.primary", F.array_join("themes", ", ")), one("location.name", F.col("location"))),
        many("alternatives_proposed[].name", "alternatives", lambda x: x["name"]),
        many("alternatives_proposed[].description", "alternatives", lambda x: x["description"]),
        many("key_people_and_groups[].stance", "people", lambda x: F.concat_ws(": ", x["name"], x["stance"])),
        many("historical_context_internal.claims[]", "claims", lambda x: x["text"], lambda x: x["source"]),
    )
    tiers = F.create_map(*[F.lit(x) for kv in vocab.CRITIC_TIERS.items() for x in kv])
    rows = records.select("doc_id", F.explode(F.filter(all_claims, lambda c: F.coalesce(c["claim"], F.lit("")) != "")).alias("c"))
    return rows.select("doc_id", F.col("c.instance").alias("field_path"), F.try_element_at(tiers, F.col("c.path")).alias("tier"), F.col("c.claim").alias("claim"), F.col("c.source").alias("source"))

"""Token usage, cost, budgets and verdict roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.plans import vocab

TOKENS = ["input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens"]


def normalized(usage: DataFrame) -> DataFrame:
    """usage with null counts as 0 and a null model as `?`."""
    return usage.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in TOKENS} | {"model": F.coalesce("model", F.lit("?"))})


def rate(model: Column, output: bool = False) -> Column:
    """Dollars for a million tokens: of the first price whose key the model's name holds, else 0."""
    out = None
    for key, i, o in vocab.PRICES:
        hit = F.contains(F.lower(model), F.lit(key))
        out = F.when(hit, o if output else i) if out is None else out.when(hit, o if output else i)
    return out.otherwise(0.0)


def cost() -> Column:
    """Dollars of a usage row; reading a cache costs a tenth of the input rate."""
    i, o = rate(F.col("model")), rate(F.col("model"), output=True)
    return ((F.col("input_tokens") + F.col("cache_creation_input_tokens")) * i + F.col("cache_read_input_tokens") * i * 0.1 + F.col("output_tokens") * o) / 1e6


def rollup(usage: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Calls, tokens and dollars (4 places) by model and in all; the total's model is null. One aggregation with grouping sets."""
    by = by or []
    rows = normalized(usage).withColumn("cost_usd", cost())
    sums = [F.count(F.lit(1)).alias("calls"), *[F.sum(c).alias(c) for c in TOKENS], F.round(F.sum("cost_usd"), 4).alias("cost_usd")]
    keys = [F.col(c) for c in by]
    return rows.groupingSets([[*keys, F.col("model")], keys], *keys, F.col("model")).agg(*sums)


def running(usage: DataFrame, budget: float, key: str = "doc_id", order: str = "call_seq") -> DataFrame:
    """usage with running totals by key and `tripped`: the first call after which the cost is over the budget."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = normalized(usage).withColumn("cost_usd", cost())
    rows = rows.withColumns({"total_input": F.sum("input_tokens").over(w), "total_output": F.sum("output_tokens").over(w), "total_cost": F.sum("cost_usd").over(w)})
    return rows.withColumn("tripped", (F.col("total_cost") > budget) & (F.col("total_cost") - F.col("cost_usd") <= budget))


def lifetime(runs: DataFrame) -> DataFrame:
    """(model, runs, calls, tokens, cost_usd) over a ledger of runs (doc_id, by_model map<string, struct<calls, tokens, cost_usd>>); null model: all."""
    each = runs.select("doc_id", F.explode("by_model").alias("model", "u"))
    sums = [F.count(F.lit(1)).alias("runs"), F.sum("u.calls").alias("calls"), F.sum("u.tokens").alias("tokens"), F.round(F.sum("u.cost_usd"), 6).alias("cost_usd")]
    return each.groupingSets([[F.col("model")], []], F.col("model")).agg(*sums)


def allowed_tiers(spent: Column, cap: float) -> Column:
    """struct of the tiers that may still run: the dearest is shed first."""
    return F.struct((spent < cap).alias("haiku"), (spent < cap * 0.75).alias("sonnet"), (spent < cap * 0.5).alias("opus"))


def field_path(path: Column) -> Column:
    return F.regexp_replace(path, r"\[\d+\]", "[]")


def verdict_rates(verdicts: DataFrame) -> DataFrame:
    """(field_path, pass, partial, no, skipped, pass_rate) with places in lists left out of paths."""
    counts = [F.count_if(F.col("verdict") == v).alias(v) for v in ("pass", "partial", "no", "skipped")]
    out = verdicts.groupBy(field_path(F.col("field_path")).alias("field_path")).agg(*counts)
    judged = F.col("pass") + F.col("partial") + F.col("no")
    return out.withColumn("pass_rate", F.when(judged > 0, F.round(F.col("pass") / judged, 4)))


def review_status(verdicts: DataFrame, approve: float = 0.9) -> DataFrame:
    """(doc_id, judged, noes, pass_rate, review_status)."""
    judged = F.count_if(F.col("verdict") != "skipped")
    out = verdicts.groupBy("doc_id").agg(judged.alias("judged"), F.count_if(F.col("verdict") == "no").alias("noes"), F.count_if(F.col("verdict") == "pass").alias("passes"))
    out = out.withColumn("pass_rate", F.when(F.col("judged") > 0, F.col("passes") / F.col("judged")))
    status = F.when(F.col("judged") == 0, "not_run").when(F.col("noes") >= 2, "full_review").when(F.col("noes") == 1, "partial_review").when(F.col("pass_rate") >= approve, "auto_approved").otherwise("partial_review")
    return out.withColumn("review_status", status).drop("passes")


def progress(entries: DataFrame) -> DataFrame:
    """One row: documents, entries and cost, and entries of each verdict, of (doc_id, verdict, cost_usd)."""
    counts = [F.count_if(F.col("verdict") == v).alias(v.lower()) for v in vocab.VERDICTS]
    return entries.agg(F.countDistinct("doc_id").alias("documents"), F.count(F.lit(1)).alias("entries"), *counts, F.round(F.sum("cost_usd"), 4).alias("cost_usd"))


def stage_counts(selected: DataFrame, done: DataFrame, stages: list[str]) -> DataFrame:
    """(stage, done, todo): selected documents with and without a checkpoint row (stage, doc_id)."""
    names = selected.sparkSession.createDataFrame(list(enumerate(stages)), "ord int, stage string")
    n = selected.select("doc_id").distinct()
    have = done.select("stage", "doc_id").distinct().join(n, "doc_id", "left_semi").groupBy("stage").agg(F.count(F.lit(1)).alias("done"))
    return names.join(have, "stage", "left").join(n.agg(F.count(F.lit(1)).alias("all"))).select("ord", "stage", F.coalesce("done", F.lit(0)).alias("done"), (F.col("all") - F.coalesce("done", F.lit(0))).alias("todo"))

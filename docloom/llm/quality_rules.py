"""Quality rules: an ordered decision list of threshold conjunctions, learned from labelled documents.

Statistics are computed for every whole text. From a bounded sample of labelled documents, sequential covering
grows one conjunction at a time on two thirds of the sample, prunes it on the other third, removes what it covers
and goes on until a rule is no longer precise. The list becomes one Spark conditional expression.

Defined results: a null or empty text has no words and fails the base rule; a document without a label or with
several is judged like any other (several labels of one document count as their minimum); without labels of both
kinds the list is empty and only the base rule judges; repeated rows are judged row by row, and the row of the least
statistics stands for a repeated id in training.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import bounded_sample, double, long, packed, text_map

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RATIOS = ["symbol_ratio", "dup_line_ratio", "repeat_ratio", "mean_word", "upper_ratio", "mark_ratio", "digit_ratio", "distinct_ratio", "log_words"]


def repeated_words(words: list[str]) -> int:
    """Words in 3-word windows that are found twice or more."""
    if len(words) < 4:
        return 0
    seen: dict[str, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    m = len(seen)
    if m < 2_000_000:
        windows = (ids[:-2] * m + ids[1:-1]) * m + ids[2:]
    else:
        pairs = np.unique(ids[:-2] * m + ids[1:-1], return_inverse=True)[1]
        windows = pairs * m + ids[2:]
    _, back, n = np.unique(windows, return_inverse=True, return_counts=True)
    twice = n[back] > 1
    inside = np.zeros(len(words), bool)
    for k in range(3):
        inside[k : k + len(twice)] |= twice
    return int(inside.sum())


def text_stats(text: str) -> tuple:
    """COUNTS, then RATIOS, of one text."""
    words = WORD.findall(text)
    n = len(words)
    chars = sum(map(len, words))
    symbols = sum(map(text.count, SYMBOLS))
    seen: set[str] = set()
    lines = dup = 0
    for line in text.split("\n"):
        if WORD.search(line):
            lines += 1
            dup += line in seen
            seen.add(line)
    repeat = repeated_words(words)
    some = max(n, 1)
    upper = sum(map(str.isupper, words))
    marks = sum(map(text.count, "!?"))
    digits = sum(map(text.count, "0123456789"))
    return (n, chars, symbols, dup, repeat, symbols / some, dup / max(lines, 1), repeat / some, chars / some, upper / some, marks / some, digits / max(chars, 1), len(set(words)) / some, float(np.log1p(n)))


def _make():
    def columns(texts: list[str]) -> list[list]:
        return list(zip(*map(text_stats, texts), strict=True)) or [[] for _ in COUNTS + RATIOS]

    return columns


def with_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """(_row, statistics): every row of docs, packed, with its statistics."""
    return text_map(packed(docs, text), _make, [long(c) for c in COUNTS] + [double(c) for c in RATIOS])


@dataclass(frozen=True)
class Rule:
    """Rejects where all of its conditions hold: (statistic, above, threshold); above: at least, else less."""

    conditions: tuple[tuple[str, bool, float], ...]
    precision: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for name, above, at in self.conditions:
            out &= (x[name] >= at) if above else (x[name] < at)
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for name, above, at in self.conditions:
            out = out & ((F.col(name) >= F.lit(at)) if above else (F.col(name) < F.lit(at)))
        return out


def learn(x: dict[str, np.ndarray], bad: np.ndarray, prune: np.ndarray, min_precision: float = 0.8, min_cover: int = 4, max_rules: int = 24, max_conditions: int = 4) -> list[Rule]:
    """Sequential covering of the bad rows. prune: rows that only prune and judge rules."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    cuts = {k: np.unique(np.concatenate([np.quantile(v, np.linspace(0, 1, 65)), np.quantile(v[bad], np.linspace(0, 1, 33))])) if bad.any() else np.unique(v) for k, v in x.items()}
    while len(rules) < max_rules:
        grown: list[tuple[str, bool, float]] = []
        inside = left & ~prune
        while len(grown) < max_conditions:
            p, n = int((inside & bad).sum()), int((inside & ~bad).sum())
            if not p or not n:
                break
            best = (0.0, None)
            for name, v in x.items():
                vb, vg = np.sort(v[inside & bad]), np.sort(v[inside & ~bad])
                pa, na = p - np.searchsorted(vb, cuts[name]), n - np.searchsorted(vg, cuts[name])
                for above, pp, nn in ((True, pa, na), (False, p - pa, n - na)):
                    gain = pp * (np.log2((pp + 1e-9) / (pp + nn + 1e-9)) - np.log2(p / (p + n)))
                    gain[pp < 1] = 0
                    k = int(gain.argmax())
                    if gain[k] > best[0] + 1e-9:
                        best = (float(gain[k]), (name, above, float(cuts[name][k])))
            if best[1] is None:
                break
            name, above, at = best[1]
            below = x[name][inside & (x[name] < at)]
            grown.append((name, above, float((at + below.max()) / 2) if len(below) else at))  # halfway to the next value
            inside &= Rule((grown[-1],), 0).holds(x)
        if not grown:
            break
        scored = []
        for k in range(len(grown), 0, -1):
            hit = Rule(tuple(grown[:k]), 0).holds(x) & left
            p, n = int((hit & bad & prune).sum()), int((hit & ~bad & prune).sum())
            scored.append(((p + 1) / (p + n + 2), p, k))
        laplace, p, k = max(scored)
        hit = Rule(tuple(grown[:k]), 0).holds(x) & left
        covered, right = int(hit.sum()), int((hit & bad).sum())
        if covered < min_cover or laplace < min_precision - 0.1 or right / covered < min_precision:
            break
        rules.append(Rule(tuple(grown[:k]), right / covered))
        left &= ~hit
    return rules


def fit(stats: DataFrame, labels: DataFrame, doc_id: str = "doc_id", sample: int = 20_000) -> list[Rule]:
    """Rules learned from at most `sample` labelled documents of (_row, statistics)."""
    marked = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("_quality"))
    some = bounded_sample(marked, "doc_id", sample).withColumnRenamed("doc_id", "_doc_id")
    rows = stats.withColumn("_doc_id", F.col(f"_row.`{doc_id}`")).join(F.broadcast(some), "_doc_id").groupBy("_doc_id").agg(F.min("_quality").alias("_quality"), F.min(F.struct(*COUNTS, *RATIOS)).alias("s")).select("_doc_id", "_quality", "s.*").limit(sample).toPandas()
    rows = rows[(rows["n_words"] >= 50) & (100 * rows["n_repeat_words"] <= 50 * rows["n_words"])].sort_values("_doc_id")  # what the base rule leaves
    bad = rows["_quality"].to_numpy() == 0
    if not bad.any() or bad.all():
        return []
    prune = np.arange(len(rows)) % 3 == 2
    return learn({c: rows[c].to_numpy(float) for c in RATIOS}, bad, prune)


def verdict(rules: list[Rule]) -> Column:
    """False where a rule of the list holds."""
    out = None
    for r in rules:
        out = F.when(r.column(), False) if out is None else out.when(r.column(), False)
    return F.lit(True) if out is None else out.otherwise(True)


def judged(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", sample: int = 20_000) -> DataFrame:
    """(_row, statistics, base_failed, kept) for every row of docs."""
    marked = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    some = F.broadcast(bounded_sample(marked, "doc_id", sample).select(F.col("doc_id").alias(doc_id)))
    rules = fit(with_stats(docs.join(some, doc_id, "left_semi"), text), labels, doc_id, sample)
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return with_stats(docs, text).withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def good_documents(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs that are kept, with the columns of docs."""
    return judged(docs, labels, text, doc_id).where("kept").select("_row.*")


def query(spark, sf_dir: str) -> DataFrame:
    from docloom.llm.common import table

    out = judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select(F.col("_row.doc_id").alias("doc_id"), *COUNTS, "base_failed", "kept")

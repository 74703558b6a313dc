"""Toxicity: a two-state linear-chain conditional random field over the words of a text.

Training takes documents labelled toxic or not, from a bounded sample. Words and word beginnings that are much more
frequent in toxic documents mark their tokens (in toxic documents only), which gives labelled tokens; the field is
fitted to them by gradient ascent on the exact likelihood. Scoring runs forward-backward over every whole text; the
marginals give toxic spans and, summed up, a document score by a logistic calibration on the same sample.

Inputs of a score are the words alone. Defined results: a null or empty text gets the calibrated score of no evidence
and no span; documents without a label only get scored; several labels of one document count as their maximum,
of several texts under one id the first in order is learned from;
without labels of both kinds all scores are the share of toxic labels (0 without any).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import bounded_sample, double, packed, table, text_map

WORD = re.compile(r"\w+")
STEMS = (4, 5, 6, 7, 8)


def traits(word: str) -> list[str]:
    return [word, *(f"{word[:k]}~" for k in STEMS if len(word) >= k)]


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0
    moves: tuple[float, float, float, float] = (1.0, 1.0, 1.0, 1.0)  # potentials of 0-0, 0-1, 1-0, 1-1
    calibration: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0, 0.0)
    constant: float | None = None


class Emissions(dict):
    """Log odds of state 1 by word, kept for words seen; emptied when it has grown large."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) > 500_000:
            self.clear()
        w = self.model.weights
        out = self[word] = min(30.0, max(-30.0, self.model.bias + sum(w.get(t, 0.0) for t in traits(word))))
        return out


class Ragged:
    """Texts of different lengths by time: at step t the longest n[t] of them are in one slice."""

    def __init__(self, lengths: np.ndarray):
        self.order = np.argsort(-lengths, kind="stable")
        sizes = lengths[self.order]
        self.steps = int(sizes[0]) if len(sizes) else 0
        self.n = len(sizes) - np.searchsorted(sizes[::-1], np.arange(self.steps), side="right")
        self.start = np.concatenate([[0], np.cumsum(self.n)])
        begin = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        rank = np.empty(len(lengths), np.int64)
        rank[self.order] = np.arange(len(lengths))
        self.doc = np.repeat(np.arange(len(lengths)), lengths)
        self.place = self.start[np.arange(len(self.doc)) - begin[self.doc]] + rank[self.doc]  # of each token, text by text


def chain(e: np.ndarray, r: Ragged, moves: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(forward odds, backward odds) of state 1, by place. e: emission odds, by place."""
    a00, a01, a10, a11 = moves
    f, b = np.empty(len(e)), np.ones(len(e))
    with np.errstate(over="ignore", under="ignore"):
        for t in range(r.steps):
            s, n = r.start[t], r.n[t]
            if t:
                p = f[r.start[t - 1] : r.start[t - 1] + n]
                f[s : s + n] = e[s : s + n] * (a01 + p * a11) / (a00 + p * a10)
            else:
                f[s : s + n] = e[s : s + n]
        for t in range(r.steps - 2, -1, -1):
            s, s2, n = r.start[t], r.start[t + 1], r.n[t + 1]
            q = e[s2 : s2 + n] * b[s2 : s2 + n]
            b[s : s + n] = (a10 + a11 * q) / (a00 + a01 * q)
    return f, b


def marginals(tokens: list[list[str]], model: Model, emissions: dict) -> tuple[np.ndarray, Ragged]:
    """Probability of state 1 of each token, text by text."""
    r = Ragged(np.fromiter(map(len, tokens), np.int64, len(tokens)))
    e = np.empty(len(r.doc))
    e[r.place] = np.exp(np.fromiter((emissions[w] for ws in tokens for w in ws), float, len(r.doc)))
    f, b = chain(e, r, model.moves)
    odds = f * b
    return (odds / (1 + odds))[r.place], r


def evidence(tokens: list[list[str]], model: Model, emissions: dict) -> np.ndarray:
    """What the calibration reads, by text: one, log of expected toxic words, their share, the highest marginal, log of words."""
    p, r = marginals(tokens, model, emissions)
    n = np.fromiter(map(len, tokens), float, len(tokens))
    total = np.bincount(r.doc, p, len(tokens))
    most = np.zeros(len(tokens))
    np.maximum.at(most, r.doc, p)
    return np.column_stack([np.ones(len(tokens)), np.log1p(total), np.log1p(100 * total / np.maximum(n, 1)), most, np.log1p(n) / 5])


class Words:
    """The words of some texts as numbers, text by text, with the traits of each word."""

    def __init__(self, tokens: list[list[str]]):
        number: dict[str, int] = {}
        self.ids = np.fromiter((number.setdefault(w, len(number)) for ws in tokens for w in ws), np.int32)
        self.lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.names: dict[str, int] = {}
        self.start = np.append(0, np.cumsum(np.fromiter((1 + sum(len(w) >= k for k in STEMS) for w in number), np.int64, len(number))))
        self.which = np.fromiter((self.names.setdefault(t, len(self.names)) for w in number for t in traits(w)), np.int32, int(self.start[-1]))

    def traits_of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in words, trait) of every trait of some words."""
        n = self.start[words + 1] - self.start[words]
        at = np.repeat(np.arange(len(words)), n)
        return at, self.which[np.repeat(self.start[words] - (np.cumsum(n) - n), n) + np.arange(len(at))]


def marked_traits(words: Words, toxic: np.ndarray, least: int = 5) -> np.ndarray:
    """Whether each trait is far more frequent in toxic documents."""
    v, m = len(words.start) - 1, len(words.names)
    k, c = np.zeros(m, np.int64), np.zeros(m, np.int64)
    begin = np.append(0, np.cumsum(words.lengths))
    for first in range(0, len(toxic), 256):  # some documents at a time, each trait of a document once
        last = min(first + 256, len(toxic))
        own = np.unique(np.repeat(np.arange(first, last), words.lengths[first:last]) * v + words.ids[begin[first] : begin[last]])
        at, which = words.traits_of(own % v)
        pairs = np.unique(own[at] // v * m + which)
        bad = toxic[pairs // m]
        k += np.bincount(pairs[bad] % m, minlength=m)
        c += np.bincount(pairs[~bad] % m, minlength=m)
    nt, nc = toxic.sum(), (~toxic).sum()
    expected = (k + c) * nt / (nt + nc)
    often = np.log((k + 0.5) / (nt + 1)) - np.log((c + 0.5) / (nc + 1)) >= 1.5
    return (k >= least) & often & ((k - expected) / np.sqrt(np.maximum(expected, 1e-9)) >= 4)


def fit_field(words: Words, marks: np.ndarray, texts: np.ndarray, steps: int = 60, rate: float = 0.3, l2: float = 1.0, longest: int = 512) -> Model:
    """Maximum likelihood of the marks (of each word) in some texts by exact gradients (Adam). Texts are learned in stretches of `longest` words."""
    begin = np.append(0, np.cumsum(words.lengths))
    some = np.concatenate([np.arange(begin[i], begin[i + 1]) for i in texts])
    ids, y = words.ids[some], marks[some].astype(float)
    lengths = words.lengths[texts]
    whole, rest = lengths // longest, lengths % longest
    stretches = np.concatenate([[longest] * int(a) + ([int(b)] if b else []) for a, b in zip(whole, rest, strict=True)]).astype(np.int64)
    r = Ragged(stretches)
    _, which = words.traits_of(ids[y > 0])
    known = np.flatnonzero(np.bincount(which, minlength=len(words.names)) >= 3)
    place = np.full(len(words.names), -1, np.int64)
    place[known] = np.arange(len(known))
    parts = []
    for first in range(0, len(ids), 50_000):
        at, which = words.traits_of(ids[first : first + 50_000])
        which = place[which]
        parts.append(((at[which >= 0] + first).astype(np.int32), which[which >= 0].astype(np.int32)))
    at, which = (np.concatenate([x[j] for x in parts]) for j in (0, 1))
    spelled = list(words.names)
    names = [spelled[i] for i in known]
    y_place = np.empty(len(y))
    y_place[r.place] = y
    follow = [(r.start[t], r.start[t + 1], r.n[t + 1]) for t in range(r.steps - 1)]
    left = np.concatenate([np.arange(s, s + n, dtype=np.int32) for s, _, n in follow]) if follow else np.empty(0, np.int32)
    right = np.concatenate([np.arange(s, s + n, dtype=np.int32) for _, s, n in follow]) if follow else np.empty(0, np.int32)
    pair = np.bincount((2 * y_place[left] + y_place[right]).astype(int), minlength=4)
    x = np.zeros(len(names) + 5)
    x[len(names)] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    m, v = np.zeros_like(x), np.zeros_like(x)
    k = len(names)
    for step in range(1, steps + 1):
        log_e = np.full(len(y), x[k])
        if len(at):
            log_e += np.bincount(at, x[which], len(y))
        e = np.empty(len(y))
        e[r.place] = np.exp(np.clip(log_e, -30, 30))
        moves = tuple(np.exp(x[k + 1 :]))
        f, b = chain(e, r, moves)
        odds = f * b
        p = (odds / (1 + odds))[r.place]
        grad = np.zeros_like(x)
        if len(at):
            grad[:k] = np.bincount(which, (y - p)[at], k) - l2 * x[:k]
        grad[k] = (y - p).sum()
        q, fl = (e * b)[right], f[left]
        share = 1 / (moves[0] + moves[1] * q + fl * (moves[2] + moves[3] * q))
        expected = np.array([moves[0] * share.sum(), moves[1] * (q @ share), moves[2] * (fl @ share), moves[3] * ((fl * q) @ share)])
        grad[k + 1 :] = pair - expected - l2 * x[k + 1 :]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        x += rate / np.sqrt(step) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return Model({t: float(w) for t, w in zip(names, x[:k], strict=True) if abs(w) > 1e-6}, float(x[k]), tuple(float(np.exp(w)) for w in x[k + 1 :]))


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-2, steps: int = 50) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (y - p) - l2 * w)
    return w


def train(texts: list[str], toxic: list[bool], field_words: int = 1_000_000) -> Model:
    """The model of labelled texts. field_words: words of the texts that fit the field; the calibration reads all."""
    y = np.array(toxic, bool)
    if not len(y) or y.all() or not y.any():
        return Model(constant=float(y.mean()) if len(y) else 0.0)
    tokens = [WORD.findall(t.lower()) for t in texts]
    words = Words(tokens)
    marked = marked_traits(words, y) if len(words.ids) else np.zeros(0, bool)
    if not marked.any():
        return Model(constant=float(y.mean()))
    bad = np.zeros(len(words.start) - 1, bool)
    bad[np.repeat(np.arange(len(bad)), np.diff(words.start))[marked[words.which]]] = True
    marks = bad[words.ids] & np.repeat(y, words.lengths)
    total, some = 0, []
    turns = [np.flatnonzero(y), np.flatnonzero(~y)]
    for k in range(max(map(len, turns))):  # toxic and clean texts by turns, while words are left
        for t in turns:
            if k < len(t) and total + len(tokens[t[k]]) <= field_words:
                some.append(t[k])
                total += len(tokens[t[k]])
    if not total:
        return Model(constant=float(y.mean()))
    model = fit_field(words, marks, np.array(some))
    seen = Emissions(model)
    x = np.vstack([evidence(tokens[i : i + 1024], model, seen) for i in range(0, len(tokens), 1024)])
    model.calibration = tuple(map(float, logistic(x, y.astype(float))))
    return model


def scorer(model: Model, spans: bool = False):
    """For text_map: scores, and with spans the toxic stretches of words as (start, end) in code points."""

    def make():
        seen = Emissions(model)

        def columns(texts: list[str]) -> list[list]:
            if model.constant is not None:
                return [[model.constant] * len(texts)] + [[[] for _ in texts]] * spans
            tokens = [WORD.findall(t.lower()) for t in texts]
            x = evidence(tokens, model, seen)
            scores = (1 / (1 + np.exp(-np.clip(x @ np.array(model.calibration), -30, 30)))).tolist()
            if not spans:
                return [scores]
            # lower-casing can change lengths: offsets come from words of the text itself, lower-cased one by one
            out: list[list] = [[] for _ in texts]
            some = [i for i in range(len(texts)) if x[i, 3] >= 0.5]
            found = [list(WORD.finditer(texts[i])) for i in some]
            p, r = marginals([[m[0].lower() for m in f] for f in found], model, seen)
            at = 0
            for i, f in zip(some, found, strict=True):
                last = -2
                for k, m in enumerate(f):
                    if p[at + k] >= 0.5:
                        if last == k - 1:
                            out[i][-1]["end"] = m.end()
                        else:
                            out[i].append({"start": m.start(), "end": m.end()})
                        last = k
                at += len(f)
            return [scores, out]

        return columns

    return make


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", sample: int = 6000) -> Model:
    """The model of at most `sample` labelled documents, a third of them toxic at most, chosen by hash."""
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
    some = bounded_sample(marked.where("_toxic > 0"), "doc_id", sample // 3).unionByName(bounded_sample(marked.where("_toxic <= 0"), "doc_id", sample - sample // 3))
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text")).join(F.broadcast(some), "doc_id").groupBy("doc_id", "_toxic").agg(F.min("_text").alias("_text")).limit(sample).collect()
    rows.sort(key=lambda r: r.doc_id)
    return train([r._text for r in rows], [r._toxic > 0 for r in rows])


def score(docs: DataFrame, model: Model, text: str = "text", spans: bool = True, keep: list[str] | None = None) -> DataFrame:
    """(_row, score and, with spans, toxic_spans) for every row of docs. keep: the columns in _row, all by default."""
    fields = [double("score")] + [T.StructField("toxic_spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))] * spans
    rows = packed(docs, text)
    if keep is not None:
        rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    return text_map(rows, scorer(model, spans), fields, rows=2048)


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    out = score(docs, fit(docs, labels.where(~held_out)), spans=True, keep=["doc_id"]).withColumn("doc_id", F.col("_row.doc_id"))
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.to_json("toxic_spans").alias("toxic_spans"))

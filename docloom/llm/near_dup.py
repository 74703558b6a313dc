"""MinHash near-duplicates: improved consistent weighted sampling over TF-IDF shingles, banded, verified exactly.

A shingle is five consecutive words (lower-cased runs of letters, digits and underscores); a shorter text is one
shingle. Its weight is its count in the text times its inverse document frequency 2 ln(N / n), at least 1; n counts,
over all documents, those with a shingle of its hash bucket (of BUCKETS). So n is at least the shingle's own document
frequency, weights of shingles that few documents have are alike at any size of the corpus, and passages that many
documents share weigh little. Weights are rounded to a grid of steps of 1/16 in the logarithm, for sampling and
verification alike.

Exact copies share one node (the text's digest). 64 consistent weighted samples and 64 plain ones (MinHash, every shingle
alike) a node make 32 bands of 4: a link by either similarity has candidates of its own. In each
bucket every node is paired with the first, and then the nodes not yet connected with it with a second. Pairs that agree in enough samples (least_agreement) are verified on whole
texts: weighted Jaccard similarity of 0.8 or more, or that of the plain sets, since copies in a very large group share only
shingles of low weight. Then the nodes of one bucket that are still in different components are all held against each
other, inside the join, so no pair that shares a bucket is left out unless it is already connected, whatever the size of
the bucket: the nodes outside a bucket's largest component meet all of its nodes, block by block.

What meets so is bounded exactly before any text is read. Shingles have one order, rarest first. All that two texts share
stands from their first common shingle on, in both: if less than t / (1 + t) of both texts' total does, in number and in
weight, no similarity can be t. Texts edited from one base have their own shingles first, so of the pairs of a large
group that are not similar enough nearly none is left to verify, and the pairs do not grow with its square.

Nothing is gathered by group: buckets are joined and aggregated, components come from large-star and small-star steps.

Defined results: a text without words is a class of its own; repeated rows and exact copies share a class; class_id is
the smallest doc_id of a class (nulls aside); other columns do not matter; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import double, small_batches, stored, table, text_map

SHINGLE, SAMPLES, ROWS, BITS = 5, 64, 4, 18
BANDS = 2 * SAMPLES // ROWS
BUCKETS = 1 << BITS
GRID, LEVELS, CELLS = 16, 80, 1 << 16
LARGE, HUGE, BLOCK = 16, 4096, 256


class Hashes:
    """64-bit hashes of the words of a text, all at once: a polynomial over random numbers for characters, modulo 2^64."""

    BASE = 0x9E3779B97F4A7C15 | 1

    def __init__(self):
        self.letter = np.fromiter((chr(i).isalnum() or i == 95 for i in range(0x110000)), bool, 0x110000)
        self.value = np.random.default_rng(5).integers(0, 1 << 63, 0x110000, np.uint64)
        self.up = self.down = np.ones(1, np.uint64)

    def powers(self, n: int) -> None:
        if len(self.up) < n:
            n = 1 << n.bit_length()
            with np.errstate(over="ignore"):
                base, back = np.full(n, self.BASE, np.uint64), np.full(n, pow(self.BASE, -1, 1 << 64), np.uint64)
                base[0] = back[0] = 1
                self.up, self.down = np.cumprod(base), np.cumprod(back)

    def __call__(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(codes):
            return np.empty(0, np.uint64)
        self.powers(len(codes) + 1)
        inside = self.letter[codes]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            edge = np.append(0, edge)
        if len(edge) % 2:
            edge = np.append(edge, len(codes))
        starts, ends = edge[::2], edge[1::2]
        with np.errstate(over="ignore"):
            total = np.cumsum(self.value[codes] * self.up[: len(codes)])
            before = np.where(starts > 0, total[starts - 1], np.uint64(0))
            h = (total[ends - 1] - before) * self.down[starts]
            h ^= h >> np.uint64(32)
            return h * np.uint64(0xD6E8FEB86659FD93)


def shingles(text: str, hashes: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, sorted; counts) of the distinct shingles of a text."""
    h = hashes(text)
    n = max(1, len(h) - SHINGLE + 1) if len(h) else 0
    s = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(SHINGLE, len(h))):
            s = (s ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            s ^= s >> np.uint64(29)
    return np.unique(s, return_counts=True)


def levels(s: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Weights on the grid: round(GRID * ln weight)."""
    return np.rint(GRID * (np.log(n) + idf[(s >> np.uint64(64 - BITS)).astype(np.int64)])).astype(np.int64)


def jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of (shingles, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = float(np.minimum(a[1][i], b[1][j]).sum())
    total = float(a[1].sum() + b[1].sum()) - both
    return both / total if total else 0.0


class Sampler:
    """Improved consistent weighted sampling. The gamma and uniform variates of a shingle in sample j are those of the cell that the highest 16 bits of a_j * hash name."""

    def __init__(self, seed: int = 20):
        r = np.random.default_rng(seed)
        self.a = r.integers(0, 1 << 63, (SAMPLES, 1), np.uint64) * np.uint64(2) + np.uint64(1)
        self.r, self.c, self.beta = r.gamma(2, 1, CELLS), r.gamma(2, 1, CELLS), r.uniform(0, 1, CELLS)
        self.by_level = np.vstack([self.log_a(k / GRID, slice(None)) for k in range(LEVELS)]).astype(np.float32).ravel()

    def step(self, log_w, cells) -> np.ndarray:
        return np.floor(log_w / self.r[cells] + self.beta[cells])

    def log_a(self, log_w, cells) -> np.ndarray:
        return np.log(self.c[cells]) - self.r[cells] * (self.step(log_w, cells) - self.beta[cells]) - self.r[cells]

    def __call__(self, s: np.ndarray, level: np.ndarray) -> np.ndarray:
        """SAMPLES 32-bit hashes of the shingles and steps that are sampled."""
        best = np.full(SAMPLES, np.inf, np.float32)
        won, cell_won = np.zeros(SAMPLES, np.int64), np.zeros(SAMPLES, np.int64)
        rows = np.arange(SAMPLES)
        with np.errstate(over="ignore"):
            for at in range(0, len(s), 512):
                cells = (s[at : at + 512] * self.a).view(np.uint16)[:, 3::4]  # the highest 16 bits
                l = level[at : at + 512]
                if l.max() < LEVELS:
                    value = self.by_level.take(cells + l * CELLS)
                else:
                    value = self.log_a(l / GRID, cells).astype(np.float32)
                k = value.argmin(1)
                least = value[rows, k]
                less = least < best
                best[less], won[less], cell_won[less] = least[less], at + k[less], cells[rows, k][less]
            t = self.step(level[won] / GRID, cell_won).astype(np.int64).astype(np.uint64)
            mixed = (s[won] ^ (t * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(32)).astype(np.uint32).view(np.int32)


class Plain:
    """MinHash: in each sample the shingle with the least a_j * (hash ^ x_j) wins, whatever its weight."""

    def __init__(self, seed: int = 21):
        r = np.random.default_rng(seed)
        self.a = r.integers(0, 1 << 63, (SAMPLES, 1), np.uint64) * np.uint64(2) + np.uint64(1)
        self.x = r.integers(0, 1 << 63, (SAMPLES, 1), np.uint64)

    def __call__(self, s: np.ndarray) -> np.ndarray:
        """SAMPLES 32-bit hashes of the shingles that are sampled."""
        least = np.full(SAMPLES, np.iinfo(np.uint64).max)
        with np.errstate(over="ignore"):
            for at in range(0, len(s), 512):
                h = (s[at : at + 512] ^ self.x) * self.a
                least = np.minimum(least, h.min(1))
            mixed = least * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(32)).astype(np.uint32).view(np.int32)


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """(number of documents with words, number with a shingle in each of BUCKETS buckets) over all rows of _text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n, hashes = np.zeros(BUCKETS, np.int64), 0, Hashes()
        for b in batches:
            for at in range(0, b.num_rows, 512):
                some = [(shingles(t, hashes)[0] >> np.uint64(64 - BITS)).astype(np.int64) for t in b.column("_text").slice(at, 512).to_pylist()]
                n += sum(len(x) > 0 for x in some)
                counts += np.bincount(np.concatenate(some), minlength=BUCKETS)
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(found, -1), pa.int32()), pa.array(np.append(counts[found], n), pa.int64())], names=["bucket", "n"])

    rows = docs.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # BUCKETS + 1 rows at most
    out = np.zeros(BUCKETS, np.int64)
    real = rows["bucket"] >= 0
    out[rows["bucket"][real]] = rows["n"][real]
    return int(rows["n"][~real].sum()), out


def log_idf(n: int, counts: np.ndarray) -> np.ndarray:
    return np.log(np.maximum(2 * np.log(np.maximum(n, 1) / np.maximum(counts, 1)), 1)).astype(np.float32)


def least_agreement(w: np.ndarray, threshold: float) -> int:
    """In how many samples a text of these weights must agree with one that may be similar enough.

    Plain sets of equal size reach the threshold while they differ in at most (1 - t) / (1 + t) of their shingles; if
    those are the heaviest, the weighted similarity is least. The samples' agreement is 3.5 standard deviations around it.
    """
    k = min(len(w), int(np.ceil(len(w) * (1 - threshold) / (1 + threshold))))
    heavy = float(np.partition(w, len(w) - k)[len(w) - k :].sum())
    p = min(threshold, max(0.0, (float(w.sum()) - heavy) / (float(w.sum()) + heavy)))
    return agreement_at(p)


def agreement_at(p: float) -> int:
    """In how many samples, at least, two texts of this similarity agree: 3.5 standard deviations below the mean."""
    return max(1, int(np.floor(SAMPLES * p - 3.5 * np.sqrt(SAMPLES * p * (1 - p)))))


def _sampled(idf: np.ndarray, threshold: float):
    def make():
        sampler, plain, hashes = Sampler(), Plain(), Hashes()

        def columns(texts: list[str]) -> list[list]:
            out, need, mean = [], [], []
            for t in texts:
                s, n = shingles(t, hashes)
                level = levels(s, n, idf)
                out.append(np.append(sampler(s, level), plain(s)) if len(s) else [])
                w = np.exp(level / GRID)
                need.append(least_agreement(w, threshold) if len(s) else 0)
                mean.append(float(w.mean()) if len(s) else 0.0)
            return [out, need, mean]

        return columns

    return make


def _verified(idf: np.ndarray, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, last = Hashes(), (None, None)

        def weighed(text: str):
            s, n = shingles(text, hashes)
            return s, np.exp(levels(s, n, idf) / GRID), np.ones(len(s))

        def similar(x: tuple, y: tuple) -> bool:
            return jaccard(x[:2], y[:2]) >= threshold or jaccard(x[::2], y[::2]) >= threshold

        for b in batches:
            yes = []
            for a, x, y in zip(*(b.column(c) for c in ("a", "text_a", "text_b")), strict=True):
                if last[0] != a:
                    last = (a, weighed(x.as_py()))
                yes.append(similar(last[1], weighed(y.as_py())))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(yes, pa.bool_()))

    return run


def head(s: np.ndarray, n: np.ndarray, idf: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, float]:
    """(hashes, weights from each on, whole weight) of the rarest shingles, rarest first, among which a text must have the first that it shares with one similar enough."""
    w = np.exp(levels(s, n, idf) / GRID)
    order = np.argsort(-idf[(s >> np.uint64(64 - BITS)).astype(np.int64)], kind="stable")  # s is sorted: ties by hash
    rest = np.cumsum(w[order][::-1])[::-1]
    k = max(int(len(s) * (1 - threshold) + 1e-6) + 1, int((rest >= threshold * rest[0] * (1 - 1e-6)).sum()))
    return s[order[:k]].view(np.int64), rest[:k], float(rest[0])


HEAD = [T.StructField("head", T.ArrayType(T.LongType())), T.StructField("rest", T.ArrayType(T.DoubleType())), T.StructField("size", T.IntegerType()), double("total")]


def _heads(idf: np.ndarray, threshold: float):
    def make():
        hashes = Hashes()

        def columns(texts: list[str]) -> list[list]:
            out: list[list] = [[] for _ in HEAD]
            for t in texts:
                s, n = shingles(t, hashes)
                tokens, rest, total = head(s, n, idf, threshold)
                for column, v in zip(out, (tokens, rest, len(s), total), strict=True):
                    column.append(v)
            return out

        return columns

    return make


def can_reach(threshold: float) -> Column:
    """Whether nodes a and b can be similar enough, by their first common shingle: exact, no such pair is lost."""
    first = F.get(F.array_intersect("head_a", "head_b"), F.lit(0))

    def bounded(f: Column) -> Column:
        at = {x: F.array_position(f"head_{x}", f).cast("int") - 1 for x in "ab"}
        share = F.lit(threshold / (1 + threshold) * (1 - 1e-6))
        plain = F.least(*[F.col(f"size_{x}") - at[x] for x in "ab"]) >= share * (F.col("size_a") + F.col("size_b"))
        weighted = F.least(*[F.get(f"rest_{x}", at[x]) for x in "ab"]) >= share * (F.col("total_a") + F.col("total_b"))
        return plain | weighted

    return F.exists(F.array(first), lambda f: f.isNotNull() & bounded(f))


def agreement(a: str, b: str, first: int = 0) -> Column:
    """In how many of SAMPLES samples from `first` on two nodes agree."""
    return F.size(F.filter(F.zip_with(F.slice(a, first + 1, SAMPLES), F.slice(b, first + 1, SAMPLES), lambda x, y: x == y), lambda z: z))


def worth_reading(least: int | Column, threshold: float) -> Column:
    """Whether nodes a and b agree in enough (least) weighted or enough plain samples."""
    return (agreement("sig_a", "sig_b") >= least) | (agreement("sig_a", "sig_b", SAMPLES) >= agreement_at(threshold))


def bit_of(band: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), band)


def shared_bands(a: str, b: str) -> Column:
    """The bands that two nodes share, as bits."""
    each = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda j: F.when(F.slice(a, j * ROWS + 1, ROWS) == F.slice(b, j * ROWS + 1, ROWS), bit_of(j)).otherwise(0))
    return F.aggregate(each, F.lit(0).cast("long"), lambda s, x: s + x)


def agreeing(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) that agree in enough samples to be worth their texts."""
    side = lambda x: reps.select(F.col("node").alias(x), F.col("sig").alias(f"sig_{x}"), F.col("need").alias(f"need_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(worth_reading(F.least("need_a", "need_b"), threshold)).select("a", "b")


def in_join(rows: DataFrame, threshold: float) -> DataFrame:
    """(a, b): pairs of nodes of one key and different parts that agree in enough samples, in small buckets; a pair comes in its first band alone."""
    left, right = (rows.select("key", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "part", "sig", "open", "bits", "head", "rest", "size", "total")]) for x in "ab")
    first = shared_bands("sig_a", "sig_b").bitwiseAND(F.col("open_a")).bitwiseAND(F.col("bits_a") - 1) == 0
    near = (F.col("part_a") < F.col("part_b")) & worth_reading(agreement_at(threshold), threshold) & first & can_reach(threshold)
    return left.join(right, (left["key"] == right["key"]) & near).select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))


def in_blocks(rows: DataFrame, threshold: float) -> DataFrame:
    """As in_join, in larger buckets (of n nodes, `strays` of them outside the largest part).

    Strays and all nodes are dealt into blocks of some BLOCK, or in a bucket of over HUGE nodes eight times that, so that
    nodes are copied less often; each block of strays meets each block of nodes in one task.
    """
    size = F.when(F.col("n") > HUGE, 8 * BLOCK).otherwise(BLOCK)
    blocks = lambda c: F.ceil(F.col(c) / size).cast("int")
    dealt = lambda c: F.pmod(F.xxhash64("node"), blocks(c)).cast("int")
    task = lambda x, y, left: F.struct(x.alias("x"), y.alias("y"), F.lit(left).alias("left"))
    each = lambda c, f: F.transform(F.sequence(F.lit(0), blocks(c) - 1), f)
    right = each("strays", lambda x: task(x, dealt("n"), False))
    left = each("n", lambda y: task(dealt("strays"), y, True))
    tasks = F.explode(F.when(F.col("stray"), F.concat(left, right)).otherwise(right))
    met = rows.withColumn("t", tasks).select("key", "t.x", "t.y", "t.left", "node", "part", "stray", "sig", "open", "bits", "head", "rest", "size", "total")
    return met.groupBy("key", "x", "y").applyInArrow(_met(agreement_at(threshold), threshold), "a binary, b binary")


def reaching(heads: "Heads", i: int, js: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the nodes js can be similar enough to node i, as can_reach."""
    own = heads.of(i)
    order = np.argsort(own, kind="stable")
    ranked = own[order]
    lengths = heads.start[js + 1] - heads.start[js]
    ends = np.cumsum(lengths)
    rank = np.arange(ends[-1]) - np.repeat(ends - lengths, lengths)
    tokens = heads.tokens[np.repeat(heads.start[js], lengths) + rank]
    at = np.minimum(np.searchsorted(ranked, tokens), len(ranked) - 1)
    hit = np.flatnonzero(ranked[at] == tokens)
    which, first = np.unique(np.repeat(np.arange(len(js)), lengths)[hit], return_index=True)
    a, b, j = order[at[hit[first]]], rank[hit[first]], js[which]
    share = threshold / (1 + threshold) * (1 - 1e-6)
    plain = np.minimum(heads.size[i] - a, heads.size[j] - b) >= share * (heads.size[i] + heads.size[j])
    weighted = np.minimum(heads.rest[heads.start[i] + a], heads.rest[heads.start[j] + b]) >= share * (heads.total[i] + heads.total[j])
    out = np.zeros(len(js), bool)
    out[which] = plain | weighted
    return out


class Heads:
    """The heads of the nodes of a table, one after the other."""

    def __init__(self, t: pa.Table):
        column = lambda c: t.column(c).combine_chunks()
        self.tokens, self.rest = (column(c).flatten().to_numpy(zero_copy_only=False) for c in ("head", "rest"))
        self.start = np.append(0, np.cumsum(pc.list_value_length(column("head")).to_numpy(zero_copy_only=False).astype(np.int64)))
        self.size, self.total = (column(c).to_numpy(zero_copy_only=False) for c in ("size", "total"))

    def of(self, i: int) -> np.ndarray:
        return self.tokens[self.start[i] : self.start[i + 1]]


def _met(least: int, threshold: float):
    def agreeing_in(same: np.ndarray) -> np.ndarray:
        """How many of SAMPLES flags are set, eight at a time."""
        return (same.view(np.uint64).sum(2) * np.uint64(0x0101010101010101)) >> np.uint64(56)

    def run(t: pa.Table) -> pa.Table:
        sig = np.stack(t.column("sig").to_numpy(zero_copy_only=False)).astype(np.int32)
        side, stray, open_, bits = (t.column(c).to_numpy() for c in ("left", "stray", "open", "bits"))
        node, parts = t.column("node").to_pylist(), {}
        order = {v: k for k, v in enumerate(sorted(set(node)))}
        rank = np.array([order[v] for v in node])
        part = np.array([parts.setdefault(p, len(parts)) for p in t.column("part").to_pylist()])
        left, right = np.flatnonzero(side), np.flatnonzero(~side)
        heads, found = Heads(t), []
        for at in range(0, len(left), 64):
            i = left[at : at + 64]
            same = [sig[i][:, None, k : k + SAMPLES] == sig[right][None, :, k : k + SAMPLES] for k in (0, SAMPLES)]
            near = (agreeing_in(same[0]) >= least) | (agreeing_in(same[1]) >= least)
            # two strays meet twice
            near &= (part[i][:, None] != part[right][None, :]) & (~stray[right][None, :] | (rank[i][:, None] < rank[right][None, :]))
            x, y = np.nonzero(near)
            x, y = i[x], right[y]
            shared = ((sig[x] == sig[y]).reshape(-1, BANDS, ROWS).all(2) * (1 << np.arange(BANDS))).sum(1)
            mine = shared & open_[x] & (bits[x] - 1) == 0
            x, y = x[mine], y[mine]
            mine = np.zeros(len(x), bool)
            for k in np.unique(x):
                same = np.flatnonzero(x == k)
                mine[same] = reaching(heads, int(k), y[same], threshold)
            found += [(min(node[p], node[q]), max(node[p], node[q])) for p, q in zip(x[mine], y[mine], strict=True)]
        return pa.table({"a": pa.array([a for a, _ in found], pa.binary()), "b": pa.array([b for _, b in found], pa.binary())})

    return run


def linked(pairs: DataFrame, texts: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """The pairs (a, b) whose texts are similar enough."""
    near = stored(pairs, "near-pairs")
    both = near.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_verified(idf, threshold), near.schema)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge (a, b), and is not a root itself: large-star and small-star until nothing changes."""
    now = stored(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not _is_stars(now):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u != v").distinct()
        now = stored(small, "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _is_stars(edges: DataFrame) -> bool:
    """Every edge leads from a node with no other edge to a root."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up > 0 and down > 0)").isEmpty()


def classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = 0.8) -> DataFrame:
    """(doc_id, node, class_id) for every row of docs. node: a digest of the text; class_id: the smallest doc_id of the class."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("_text"))
    idf = log_idf(*document_frequencies(rows.select("_text")))
    node = F.unhex(F.md5(F.col("_text").cast("binary")))
    every = stored(text_map(rows.withColumn("node", node), _sampled(idf, threshold), [T.StructField("sig", T.ArrayType(T.IntegerType())), T.StructField("need", T.IntegerType()), double("mean")]), "nodes")
    reps = stored(every.where(F.size("sig") > 0).groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("sig").alias("sig"), F.first("need").alias("need"), F.first("mean").alias("mean")), "representatives")

    key = lambda j: F.xxhash64(j, F.slice("sig", j * ROWS + 1, ROWS))
    keys = reps.select("node", "mean", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), key)).alias("band", "key"))
    firsts = keys.groupBy("key").agg(F.min(F.struct("mean", "node")).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "n", F.col("f.node").alias("first"))
    members = stored(keys.join(firsts, "key"), "buckets")
    wanted = members.select("node").distinct().join(reps.select("node", "doc_id"), "node")
    # one row a node, by id and node, so that a text which many rows repeat is no hot key; without an id, by node
    wanted = wanted.select(F.col("doc_id").alias("_id"), F.col("node").alias("_node"))
    found = rows.withColumn("node", node).join(wanted, (F.col("node") == F.col("_node")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    texts = found.groupBy("node").agg(F.first("_text").alias("text"))
    texts = stored(texts, "texts")

    # The first node of a bucket is the one of the least mean weight: a copy that was edited least has the fewest rare, heavy
    # shingles, and most others are near it. A second round does the same for the parts that the first has not reached.
    tried = stored(members.where("first != node").select(F.least("first", "node").alias("a"), F.greatest("first", "node").alias("b")).distinct(), "star")
    part = components(linked(agreeing(tried, reps, threshold), texts, idf, threshold))
    left = members.select("key", "node", "mean", "first").join(part, "node", "left").withColumn("part", F.coalesce("root", "node")).drop("root")
    main = left.where("node = first").select("key", F.col("part").alias("main"))
    left = stored(left.join(main, "key").select("key", "node", "mean", "part", "main"), "bucket-parts")
    second = left.where("part != main").groupBy("key").agg(F.min(F.struct("mean", "node", "part")).alias("s"))
    again = left.join(second, "key").where(F.col("part") != F.col("s.part")).select(F.least("node", "s.node").alias("a"), F.greatest("node", "s.node").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    again = stored(again, "star")
    part = components(part.select(F.col("node").alias("a"), F.col("root").alias("b")).union(linked(agreeing(again, reps, threshold), texts, idf, threshold)))
    tried = tried.union(again)

    # What is still apart in one bucket: all pairs of nodes of different parts, each pair once, in the first bucket that it shares.
    still = members.join(part, "node", "left").withColumn("part", F.coalesce("root", "node")).select("key", "band", "node", "n", "part")
    sizes = still.groupBy("key", "part").agg(F.count(F.lit(1)).alias("k")).groupBy("key").agg(F.max(F.struct("k", "part")).alias("main"), F.sum("k").alias("all"))
    sizes = sizes.where(F.col("all") > F.col("main.k")).select("key", F.col("main.part").alias("main"), (F.col("all") - F.col("main.k")).alias("strays"))
    still = stored(still.join(sizes, "key").withColumn("stray", F.col("part") != F.col("main")), "open-buckets")
    bit = bit_of(F.col("band"))
    masks = still.groupBy("node", "part").agg(F.bit_or(bit).alias("open"))
    masks = text_map(masks.join(reps.select("node", "sig"), "node").join(texts, "node"), _heads(idf, threshold), HEAD, text="text")
    masks = stored(masks, "open-nodes")
    one = still.select("key", "node", "n", "strays", "stray", bit.alias("bits")).join(masks, "node")
    rest = in_join(one.where(F.col("n") <= LARGE), threshold).union(in_blocks(one.where(F.col("n") > LARGE), threshold))
    rest = rest.join(tried, ["a", "b"], "left_anti")
    roots = components(part.select(F.col("node").alias("a"), F.col("root").alias("b")).union(linked(rest, texts, idf, threshold)))

    ids = reps.select("node", "doc_id").join(roots, "node", "left").select(F.coalesce("root", "node").alias("root"), "node", "doc_id")
    named = ids.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    named = ids.join(named, "root").select("node", "class_id")
    return every.select("doc_id", "node", (F.size("sig") > 0).alias("_words")).join(named, "node", "left").select("doc_id", "node", F.when(F.col("_words"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"))


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = 0.8) -> DataFrame:
    """The rows of docs that stay: the one with the smallest doc_id of each class, with the columns of docs.

    A row that repeats another of the same doc_id and text goes; rows without words, or whose class has no doc_id, stay.
    """
    found = classes(docs, text, doc_id, threshold)
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    staying = found.where(F.col("doc_id").isNotNull() & (F.col("doc_id") == F.col("class_id"))).select(F.col("doc_id").alias("_id"), F.col("node").alias("_node")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{doc_id}`").alias("_id"), F.unhex(F.md5(body.cast("binary"))).alias("_node"))
    kept = rows.join(staying, ["_id", "_node"]).groupBy("_id", "_node").agg(F.first("_row").alias("_row"))
    return kept.select("_row.*").union(rows.where(F.col("_id").isNull()).select("_row.*"))


def query(spark, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id")

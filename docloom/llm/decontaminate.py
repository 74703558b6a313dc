"""Benchmark decontamination: BM25 retrieval of test items by block-max WAND, verified by question and answer overlap.

The test items are the collection: an inverted index of their words (lower-cased runs of letters, digits and
underscores) with BM25 impacts, document frequencies counted over all training documents, once for all items, in
BUCKETS hash buckets of words (so they are upper bounds). Impacts are divided by the
item's own full score, so a score is the weighted share of an item that a passage holds. Every document is cut into
overlapping passages, long enough for two of the longest item at a stride of one, so each stretch of an item's length
lies in one passage. Each passage is a query; block-max WAND returns every item that scores `threshold` or more.
Each hit is verified: the shares of the three-word windows of its question (all sentences but the last) and of its answer
(the last sentence) that the passage has. A leak has `overlap` or more of the question, of the answer, and of all
windows: a document that holds the question alone, or the answer alone, is none.

The index is made for shards of at most about SHARD items and SHARD_CHARS characters, so what is broadcast is bounded;
documents stream past it.

Defined results: items and documents without words match nothing; repeated documents are each reported; items of equal
id and text count once, other texts under one id are items of their own; null ids are kept as they are; an empty benchmark gives no leak.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import double, long, packed, small_batches, table

WORD = re.compile(r"\w+")
SENTENCES = re.compile(r"(?<=[.!?])\s+|\n+")
K1, B = 1.2, 0.75
BLOCK, WINDOW, LEAST_PASSAGE, SHARD, SHARD_CHARS, CELLS, BUCKETS = 8, 3, 128, 20_000, 32 << 20, 8 << 20, 1 << 20
HIT = T.StructType([long("item_id"), long("passage"), double("score"), double("question_overlap"), double("answer_overlap"), double("overlap")])


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """Words of all sentences but the last, and of the last; of one sentence, the same words twice."""
    parts = [w for w in map(words_of, SENTENCES.split(text)) if w]
    if len(parts) < 2:
        return (parts[0], parts[0]) if parts else ([], [])
    return [w for p in parts[:-1] for w in p], parts[-1]


def runs(words: list[str], size: int = WINDOW) -> set[tuple]:
    """The windows of so many words."""
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def share(part: list[str], passage: list[str], known: dict[int, set]) -> float:
    """Of a part's windows, those that the passage has. known: the passage's windows by size; short parts are one window."""
    size = min(WINDOW, len(part))
    if size not in known:
        known[size] = runs(passage, size)
    own = runs(part, size)
    return len(own & known[size]) / len(own)


class Index:
    """Items in order of length, so that items of a block have impacts alike."""

    def __init__(self, items: list[tuple[int, str]], documents: int, frequency):
        """frequency: of a word, in documents."""
        rows = sorted(((len(w), i, w, t) for i, t in items if (w := words_of(t))), key=lambda x: (x[0], x[1] is not None, x[1] or 0, x[3]))
        self.ids = [i for _, i, _, _ in rows]
        self.longest = max((n for n, *_ in rows), default=0)
        average = sum(n for n, *_ in rows) / max(len(rows), 1)
        self.vocabulary: dict[str, int] = {}
        postings: dict[int, list[tuple[int, float]]] = defaultdict(list)
        for k, (n, _, words, _) in enumerate(rows):
            own = {}
            for w, tf in Counter(words).items():
                df = min(frequency(w), documents)
                own[w] = math.log(1 + (documents - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * n / average))
            full = sum(own.values())
            for w, x in own.items():
                postings[self.vocabulary.setdefault(w, len(self.vocabulary))].append((k, x / full))
        self.postings = [[k for k, _ in postings[t]] for t in range(len(self.vocabulary))]
        self.impacts = [[x for _, x in postings[t]] for t in range(len(self.vocabulary))]
        self.most = np.array([max(x) for x in self.impacts] or [0.0])
        self.blocks = []
        for t in range(len(self.vocabulary)):
            top: dict[int, float] = {}
            for k, x in postings[t]:
                top[k // BLOCK] = max(top.get(k // BLOCK, 0.0), x)
            self.blocks.append(top)
        self.texts = [t for *_, t in rows]
        self.n_blocks = -(-len(rows) // BLOCK)
        self.block_ids = [np.fromiter(top, np.int64, len(top)) for top in self.blocks]
        self.block_most = [np.fromiter(top.values(), float, len(top)) for top in self.blocks]
        self.table = None
        if len(self.blocks) * self.n_blocks <= CELLS:  # as a table, where it is small
            self.table = np.zeros((len(self.blocks), self.n_blocks), np.float32)
            for t in range(len(self.blocks)):
                self.table[t, self.block_ids[t]] = self.block_most[t] * (1 + 1e-6)

    def open_blocks(self, terms: np.ndarray, threshold: float) -> np.ndarray:
        """Blocks whose bounds, summed over the terms, reach the threshold: no other block has a hit."""
        if self.table is not None:
            bounds = self.table[terms].sum(0)
        else:
            bounds = np.bincount(np.concatenate([self.block_ids[t] for t in terms]), np.concatenate([self.block_most[t] for t in terms]), self.n_blocks)
        return np.flatnonzero(bounds >= threshold * (1 - 1e-6))

    def search(self, terms: np.ndarray, threshold: float) -> list[tuple[int, float]]:
        """Block-max WAND: (item, score) of all items that score the threshold or more for these distinct terms.

        The lists are read from the first open block to the last; most passages have none.
        """
        opened = self.open_blocks(terms, threshold)
        if not len(opened):
            return []
        most, out = self.most, []
        begin, end = int(opened[0]) * BLOCK, min((int(opened[-1]) + 1) * BLOCK, len(self.ids))
        starts = ((t, bisect_left(self.postings[t], begin)) for t in terms.tolist())
        cursors = [[self.postings[t][at], at, t] for t, at in starts if at < len(self.postings[t])]  # item, place in the list, term
        while cursors:
            cursors.sort()
            if cursors[0][0] >= end:
                break
            bound, pivot = 0.0, None
            for j, c in enumerate(cursors):
                bound += most[c[2]]
                if bound >= threshold:
                    pivot = j
                    break
            if pivot is None:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            block = item // BLOCK
            if sum(self.blocks[c[2]].get(block, 0.0) for c in cursors[: pivot + 1]) >= threshold:
                if cursors[0][0] == item:
                    score = sum(self.impacts[c[2]][c[1]] for c in cursors[: pivot + 1])
                    if score >= threshold:
                        out.append((item, score))
                    target = item + 1
                else:
                    target = item
            else:  # no item up to the block's end, or to where another list comes in, can score enough
                target = (block + 1) * BLOCK
                if pivot + 1 < len(cursors):
                    target = min(target, cursors[pivot + 1][0])
                target = max(target, item + 1)
            left = []
            for j, c in enumerate(cursors):
                if j <= pivot and c[0] < target:
                    listed, at = self.postings[c[2]], c[1]
                    while at < len(listed) and listed[at] < target:
                        at += 1
                    if at == len(listed):
                        continue
                    c[0], c[1] = listed[at], at
                left.append(c)
            cursors = left
        return out

    def hits(self, text: str, threshold: float, overlap: float) -> list[dict]:
        """HIT of every item that leaks into the text, by its best passage."""
        words = words_of(text)
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        known = np.flatnonzero(ids >= 0)
        if not len(known):
            return []
        size = max(LEAST_PASSAGE, 2 * self.longest)
        stride = size // 2
        starts = np.arange(0, max(len(words) - stride, 1), stride)
        bound = np.concatenate([[0.0], np.cumsum(self.most[ids[known]])])
        low, high = np.searchsorted(known, starts), np.searchsorted(known, starts + size)
        found: dict[int, dict] = {}
        for p in np.flatnonzero(bound[high] - bound[low] >= threshold):
            terms = np.unique(ids[known[low[p] : high[p]]])
            if self.most[terms].sum() < threshold:
                continue
            passage, windows = words[starts[p] : starts[p] + size], {}
            for k, score in self.search(terms, threshold):
                whole = share(words_of(self.texts[k]), passage, windows)
                if whole < overlap or k in found and whole <= found[k]["overlap"]:
                    continue
                q, a = (share(x, passage, windows) for x in question_and_answer(self.texts[k]))
                if min(q, a) >= overlap:
                    found[k] = {"item_id": self.ids[k], "passage": int(starts[p]), "score": min(score, 1.0), "question_overlap": q, "answer_overlap": a, "overlap": whole}
        return [found[k] for k in sorted(found)]


def bucket_of(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS


def buckets_of(items: DataFrame) -> np.ndarray:
    """The buckets of the items' words, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            seen.update(bucket_of(w) for t in b.column("t").to_pylist() for w in set(words_of(t)))
        yield pa.RecordBatch.from_arrays([pa.array(sorted(seen), pa.int64())], names=["bucket"])

    return np.sort(items.select("t").mapInArrow(run, "bucket long").distinct().toPandas()["bucket"].to_numpy(np.int64))  # BUCKETS at most


def document_frequencies(rows: DataFrame, wanted: np.ndarray) -> tuple[int, np.ndarray]:
    """(documents, documents with a word in each of BUCKETS buckets, 0 for those not wanted) over all rows of _text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = dict(zip(wanted.tolist(), range(len(wanted)), strict=True))
        counts, n, seen = np.zeros(len(wanted), np.int64), 0, set()
        get, crc = place.get, zlib.crc32  # as bucket_of
        places: dict[str, int] = {}  # of the words seen that fall into a wanted bucket
        for b in batches:
            for t in b.column("_text").to_pylist():
                own = set(words_of(t))
                new = own - seen
                places.update([(w, k) for w in new if (k := get(crc(w.encode("utf-8", "surrogatepass")) % BUCKETS)) is not None])
                seen |= new
                if found := own & places.keys():
                    counts[list({places[w] for w in found})] += 1
            if len(seen) > 2_000_000:
                seen.clear()
                places.clear()
            n += b.num_rows
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(wanted[found], -1), pa.int64()), pa.array(np.append(counts[found], n), pa.int64())], names=["bucket", "n"])

    got = rows.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # BUCKETS + 1 rows at most
    out, real = np.zeros(BUCKETS, np.int64), got["bucket"] >= 0
    out[got["bucket"][real]] = got["n"][real]
    return int(got["n"][~real].sum()), out


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = 0.5, overlap: float = 0.5, keep: list[str] | None = None) -> DataFrame:
    """(_row, hits) for every row of docs: HIT of each item that leaks into it. keep: the columns in _row, all by default."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = packed(docs, text) if keep is None else docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("_text"))
    items = benchmark.where(F.col(f"`{item_text}`").isNotNull()).select(F.col(f"`{item_id}`").cast("long").alias("id"), F.col(f"`{item_text}`").alias("t")).distinct()
    size = items.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("chars")).first()
    shards = max(1, math.ceil(size.n / SHARD), math.ceil(size.chars / SHARD_CHARS))
    kind = T.ArrayType(HIT)
    n, counts = document_frequencies(rows.select("_text"), buckets_of(items)) if size.n else (0, None)
    for k in range(shards):
        some = [(r.id, r.t) for r in items.where(F.pmod(F.xxhash64("id", "t"), F.lit(shards)) == k).collect()]  # about SHARD items
        index = spark.sparkContext.broadcast(Index(some, n, lambda w: int(counts[bucket_of(w)])) if any(words_of(t) for _, t in some) else None)
        columns = [c for c in rows.columns if c != "hits"]
        schema = T.StructType([rows.schema[c] for c in columns] + [T.StructField("hits", kind)])

        def run(batches: Iterator[pa.RecordBatch], index=index, columns=columns, more=k > 0) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_type

            found, arrow = index.value, to_arrow_type(kind)
            for whole in batches:
                for at in range(0, whole.num_rows, 512):
                    b = whole.slice(at, 512)
                    hits = [found.hits(t, threshold, overlap) if found else [] for t in b.column("_text").to_pylist()]
                    if more:
                        hits = [(a or []) + x for a, x in zip(b.column("hits").to_pylist(), hits, strict=True)]
                    yield pa.RecordBatch.from_arrays([b.column(c) for c in columns] + [pa.array(hits, arrow)], names=[*columns, "hits"])

        rows = rows.mapInArrow(run, schema)
    return rows.select("_row", "hits")


def clean_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text", **more) -> DataFrame:
    """The rows of docs without a leak, with the columns of docs."""
    return leaks(docs, benchmark, text, **more).where(F.size("hits") == 0).select("_row.*")


def query(spark, sf_dir: str) -> DataFrame:
    out = leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return out.select(F.col("_row.doc_id").alias("doc_id"), F.explode("hits").alias("h")).select("doc_id", "h.item_id", "h.score", "h.question_overlap", "h.answer_overlap", "h.overlap")

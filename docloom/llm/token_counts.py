"""Token counts through a digest cache.

A cache table holds (content digest, tokenizer digest, tokens). Documents are joined to it by the SHA-256 of their
content (null read as empty; nothing else is changed, since every byte counts) and of the tokenizer's file. Texts
that have no entry are made distinct by digest, encoded once each, and appended; then all documents read the cache.

Defined results: a null or empty text has 0 tokens; repeated rows each get a row; columns of docs other than the
text go through whole.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import LETTERS, NUMBERS, PLAIN, long, packed, scratch, table, text_map

CACHE = T.StructType([T.StructField("content", T.StringType()), T.StructField("tokenizer", T.StringType()), long("n_tokens")])


def tokenizer_digest(path: str) -> str:
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


class PieceCounts:
    """Token counts of texts by a tokenizers file.

    A byte-level tokenizer encodes the pieces of a text one by one; for Latin texts its own pattern cuts them here, and
    their counts are kept. Other texts, those that may hold special tokens, and other tokenizers are encoded whole.
    """

    def __init__(self, path: str, most: int = 500_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model, self.most, self.known = Tokenizer.from_file(path), most, {}
        self.model.no_truncation()
        self.model.no_padding()
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.pieces = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^\\s{LETTERS}{NUMBERS}]+|\\s+(?!\\S)|\\s+")
        probe = "It's 12 über-plain,  SAY: they'll\n\n ¿go? «x²»\t end \n"
        self.fast = self.model.normalizer is None and "ByteLevel" in str(self.model.pre_tokenizer) and self._by_piece([probe]) == self._whole([probe])

    def _whole(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _by_piece(self, texts: list[str]) -> list[int]:
        found = [self.pieces.findall(t) for t in texts]
        if len(self.known) > self.most:
            self.known.clear()
        new = list(set().union(*found).difference(self.known))
        self.known.update(zip(new, self._whole(new), strict=True))
        return [sum(map(self.known.__getitem__, ps)) for ps in found]

    def __call__(self, texts: list[str]) -> list[int]:
        plain = [self.fast and bool(PLAIN.fullmatch(t)) and not any(s in t for s in self.special) for t in texts]
        pieces, whole = (iter(f([t for t, p in zip(texts, plain, strict=True) if p == kind])) for f, kind in ((self._by_piece, True), (self._whole, False)))
        return [next(pieces if p else whole) for p in plain]


@lru_cache(2)
def piece_counts(path: str) -> PieceCounts:
    """One for the life of a Python worker."""
    return PieceCounts(path)


def encoder(path: str):
    """For text_map: token counts as the file's library gives them, without added special tokens."""

    def make():
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            return lambda texts: [[len(x) for x in model.encode(texts, num_threads=1)]]
        return lambda texts: [piece_counts(path)(texts)]

    return make


def digests(docs: DataFrame, text: str = "text") -> DataFrame:
    return packed(docs, text).withColumn("content", F.sha2(F.col("_text"), 256))


def count_tokens(docs: DataFrame, path: str, cache: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(_row, n_bytes, n_tokens) for every row of docs; the Parquet table at `cache` gets the missing entries.

    path: a tokenizer file, .json or .model, at the same place on every executor.
    keep: the columns in _row, all by default; without the text the last join stays narrow.
    """
    spark: SparkSession = docs.sparkSession
    version = tokenizer_digest(path)
    _known(spark, cache).limit(0).write.mode("append").parquet(cache)
    known = _known(spark, cache).where(F.col("tokenizer") == version).select("content")
    # one text of each digest: the aggregate keeps one row a digest in each task before it shuffles, and the join reuses its partitioning
    missing = digests(docs, text).groupBy("content").agg(F.first("_text").alias("_text")).join(known, "content", "left_anti")
    text_map(missing, encoder(path), [long("n_tokens")], rows=256).select("content", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)
    entries = _known(spark, cache).where(F.col("tokenizer") == version).groupBy("content").agg(F.first("n_tokens").alias("n_tokens"))
    keep = docs.columns if keep is None else keep
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    return rows.select("_row", F.octet_length("_text").cast("long").alias("n_bytes"), F.sha2(F.col("_text"), 256).alias("content")).join(entries, "content", "left").drop("content")


def _known(spark: SparkSession, cache: str) -> DataFrame:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.read.schema(CACHE).parquet(cache)
    return spark.createDataFrame([], CACHE)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), scratch(spark, "token-cache"), keep=["doc_id"])
    return out.select(F.col("_row.doc_id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))

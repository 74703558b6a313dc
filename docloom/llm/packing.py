"""Packing: documents into fixed windows by minimum bin slack.

Each document's tokens, and an end token, are cut into whole windows and a rest. The rests of a task wait as a multiset
of lengths. For each window, subset-sum dynamic programming over the multiset (a bitset of reachable fills) finds the
fill closest to the capacity, and backtracking tells how many of each length make it; the same multiset is used again
while it lasts. What is left at the end of a task is filled up by cutting, and its last tokens are cut at powers of
two, which are not padded. Sequences never span tasks, so nothing is shuffled and a task that runs again gives the
same pieces.

Defined results: a null or empty text is one end token; every token lies in exactly one piece; repeated rows are
packed each; an empty table gives no piece; other columns go through in _row. sequence_id is the task's number times
2^32 plus a number within the task.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import LETTERS, NUMBERS, long, small_batches, table

#: PLAIN texts that are PLAIN in lower case too: without capitals whose small letters lie beyond U+024F, or are two characters.
KEPT_BY_LOWER = re.compile("[\\t\\n\\r\\x20-\\x7e" + "".join(f"\\u{i:04x}" for i in range(0xA1, 0x250) if len(low := chr(i).lower()) == 1 and ord(low) < 0x250) + "]*+")
CAPACITY = 2048
PIECE = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


class WordTokens:
    """Token ids of a text as little-endian unsigned 32-bit bytes, for a tokenizer that drops white space and encodes words alone.

    Texts of Latin letters, digits and punctuation are cut into words by the tokenizer's own pattern here and encoded
    word by word through a cache; all other texts, those with a capital whose small letter lies outside, and those that
    may hold special tokens, go to the tokenizer whole.
    """

    def __init__(self, path: str, most: int = 500_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        letters, numbers = LETTERS, NUMBERS
        self.plain = KEPT_BY_LOWER
        self.words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^\\s{letters}{numbers}]+")
        self.cache: dict[str, bytes] = {}
        self.most = most
        self.ending = np.zeros(self.model.get_vocab_size(), bool)
        if suffix := getattr(self.model.model, "end_of_word_suffix", None):
            self.ending[[i for t, i in self.model.get_vocab().items() if t.endswith(suffix)]] = True
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        probe = "It's 12 über-plain, SAY: they'll ¿go? «x²»\tend\n"
        self.fast = self.model.normalizer is not None and self._by_word([probe]) == self._whole([probe])

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """The ids of each word. Many words are encoded as one text and told apart by the tokens that end words."""
        if not words:
            return []
        ids = np.array(self.model.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.ending[ids]) + 1
        if len(ends) != len(words):
            return self._whole(words)
        flat, cuts = ids.tobytes(), (4 * ends).tolist()
        return [flat[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]

    def _by_word(self, texts: list[str]) -> list[bytes]:
        found = [self.words.findall(t.lower()) for t in texts]
        if len(self.cache) > self.most:
            self.cache.clear()
        new = list(set().union(*found).difference(self.cache))
        self.cache.update(zip(new, self._words(new), strict=True))
        return [b"".join(map(self.cache.__getitem__, ws)) for ws in found]

    def __call__(self, texts: list[str]) -> list[bytes]:
        plain = [self.fast and bool(self.plain.fullmatch(t)) and not any(s in t for s in self.special) for t in texts]
        words, whole = (iter(f([t for t, p in zip(texts, plain, strict=True) if p == kind])) for f, kind in ((self._by_word, True), (self._whole, False)))
        return [next(words if p else whole) for p in plain]


@lru_cache(2)
def word_tokens(path: str) -> WordTokens:
    """One for the life of a Python worker: later tasks find its words."""
    return WordTokens(path)


def best_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many of each length fill a window closest to the capacity, using the longest lengths that can.

    counts: lengths, each below the capacity, and how many of them there are. The bitset holds the reachable fills; each
    length adds its copies in runs of 1, 2, 4, ..., and the bitsets before each run lead back.
    """
    mask, reach, runs = (1 << (capacity + 1)) - 1, 1, []
    for n in sorted(counts, reverse=True):
        left, k = min(counts[n], capacity // n), 1
        while left:
            k = min(k, left)
            runs.append((n, k, reach))
            reach |= (reach << (n * k)) & mask
            left -= k
            k *= 2
        if reach >> capacity:
            break
    fill = reach.bit_length() - 1
    out: dict[int, int] = {}
    for n, k, before in reversed(runs):
        if not before >> fill & 1:
            out[n] = out.get(n, 0) + k
            fill -= n * k
    return out


class Packer:
    """Packs the documents of a task. add() and finish() return pieces: (document, start, length, sequence, offset)."""

    def __init__(self, capacity: int = CAPACITY, waiting: int = 4096):
        self.capacity, self.waiting = capacity, waiting
        self.sequence = 0
        self.by_length: dict[int, list[tuple[int, int]]] = {}
        self.n = 0

    def add(self, document: int, tokens: int) -> list[tuple]:
        out = []
        whole = tokens // self.capacity
        for k in range(whole):
            out.append((document, k * self.capacity, self.capacity, self.sequence, 0))
            self.sequence += 1
        if rest := tokens - whole * self.capacity:
            self.by_length.setdefault(rest, []).append((document, whole * self.capacity))
            self.n += 1
        if self.n >= self.waiting:
            while self.n > self.waiting // 2:
                out += self.window()
        return out

    def window(self) -> list[tuple]:
        """The pieces of the next windows of one multiset."""
        used = best_fill({n: len(d) for n, d in self.by_length.items()}, self.capacity)
        times = min(len(self.by_length[n]) // k for n, k in used.items())
        slack = self.capacity - sum(n * k for n, k in used.items())
        out = []
        for _ in range(1 if slack else times):
            offset = 0
            for n, k in used.items():
                for _ in range(k):
                    document, start = self._take(n)
                    out.append((document, start, n, self.sequence, offset))
                    offset += n
            if slack and self.n:  # nothing fits: a longer rest is cut
                n = min(x for x in self.by_length if x > slack)
                document, start = self._take(n)
                out.append((document, start, slack, self.sequence, offset))
                self.by_length.setdefault(n - slack, []).append((document, start + slack))
                self.n += 1
            self.sequence += 1
        return out

    def _take(self, n: int) -> tuple[int, int]:
        found = self.by_length[n]
        got = found.pop()
        if not found:
            del self.by_length[n]
        self.n -= 1
        return got

    def finish(self) -> list[tuple]:
        out = []
        while sum(n * len(d) for n, d in self.by_length.items()) >= self.capacity:
            out += self.window()
        rests = [(d, s, n) for n, waiting in sorted(self.by_length.items()) for d, s in waiting]
        left = sum(n for _, _, n in rests)
        self.by_length, self.n = {}, 0
        while left:  # sequences of powers of two, the largest first
            room = 1 << (left.bit_length() - 1)
            left -= room
            offset = 0
            while offset < room:
                document, start, n = rests.pop()
                k = min(n, room - offset)
                out.append((document, start, k, self.sequence, offset))
                offset += k
                if k < n:
                    rests.append((document, start + k, n - k))
            self.sequence += 1
        return out


def pack(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """(_row, PIECE): a row for each piece of a document. keep: the columns in _row, all but the text by default.

    A task holds the ids of at most some 4096 waiting documents: their pieces go out as their windows fill.
    """
    small_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("_text"))
    schema = T.StructType([rows.schema["_row"], *map(long, PIECE)])
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokens, packer, first = word_tokens(path), Packer(capacity), TaskContext.get().partitionId() << 32
        waiting: dict[int, list] = {}  # of documents with pieces to come: row, ids, tokens left
        number = 0

        def out(pieces: list[tuple]) -> pa.RecordBatch:
            made: list[list] = [[] for _ in PIECE]
            kept = []
            for document, start, n, sequence, offset in pieces:
                row = waiting[document]
                kept.append(row[0])
                for c, v in zip(made, (start, n, zlib.crc32(row[1][4 * start : 4 * (start + n)]), len(row[1]) // 4, first + sequence, offset), strict=True):
                    c.append(v)
                row[2] -= n
                if not row[2]:
                    del waiting[document]
            return pa.RecordBatch.from_arrays([pa.array(kept, kind), *(pa.array(c, pa.int64()) for c in made)], names=["_row", *PIECE])

        kind = None
        for b in batches:
            kind = b.column("_row").type
            for at in range(0, b.num_rows, 256):
                pieces = []
                part = b.slice(at, 256)
                for row, ids in zip(part.column("_row").to_pylist(), tokens(part.column("_text").to_pylist()), strict=True):
                    ids += end
                    waiting[number] = [row, ids, len(ids) // 4]
                    pieces += packer.add(number, len(ids) // 4)
                    number += 1
                if pieces:
                    yield out(pieces)
        if kind is not None and (pieces := packer.finish()):
            for at in range(0, len(pieces), 4096):
                yield out(pieces[at : at + 4096])

    return rows.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = pack(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select(F.col("_row.doc_id").alias("doc_id"), *PIECE)

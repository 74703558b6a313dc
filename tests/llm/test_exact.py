"""Operators with exact results: round trips and brute force on small fixtures."""

import base64
import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import decontaminate, license_scan, near_dup, packing, token_counts, warc

tokenizers = pytest.importorskip("public_tokenizers")


# packing


def test_best_fill_against_all_subsets():
    r = random.Random(1)
    for _ in range(200):
        capacity = r.randint(5, 40)
        counts = {n: r.randint(1, 3) for n in r.sample(range(1, capacity), min(4, capacity - 1))}
        items = [n for n, k in counts.items() for _ in range(k)]
        best = max(s for k in range(len(items) + 1) for c in itertools.combinations(items, k) if (s := sum(c)) <= capacity)
        got = packing.best_fill(counts, capacity)
        assert sum(n * k for n, k in got.items()) == best and all(k <= counts[n] for n, k in got.items())


def test_packer_loses_nothing():
    r = random.Random(2)
    p, sizes, pieces = packing.Packer(64, waiting=20), [r.randint(1, 200) for _ in range(300)], []
    for i, n in enumerate(sizes):
        pieces += p.add(i, n)
    pieces += p.finish()
    seen = {i: np.zeros(n, int) for i, n in enumerate(sizes)}
    bins = {}
    for d, start, n, seq, offset in pieces:
        seen[d][start : start + n] += 1
        bins.setdefault(seq, []).append((offset, n))
    assert all((x == 1).all() for x in seen.values())
    for parts in bins.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == 64 or at & (at - 1) == 0
    assert packing.Packer().finish() == []


def test_word_tokens_are_the_librarys():
    path = tokenizers.path("word_bpe_49k.json")
    w = packing.word_tokens(path)
    assert w.fast
    texts = ["", " \n\t", "It's ÉCOLE, naïve & <|endoftext|> x", "12²½ a_b—c", "ΣΑΣ İstanbul", "日本 a😀b", "a b\x1cc", "don't WE'LL 'S ''s", "x" * 5000, "é"]
    assert w(texts) == w._whole(texts)


def test_word_tokens_over_the_whole_fast_alphabet():
    """100,000 strings over all letters, capitals and marks of the fast path, and a little beyond it."""
    w = packing.word_tokens(tokenizers.path("word_bpe_49k.json"))
    r = random.Random(3)
    inside = [chr(i) for i in (9, 10, 13, *range(0x20, 0x7F), *range(0xA1, 0x250))]
    texts = [f"{c}WE{c}x {c}" for c in inside] + ["ƐWE", "Ⱥb ȾC", "İstanbul"]
    texts += ["".join(r.choices(inside + [" "] * 60 + ["\u0307", "ß", "ẞ", "\u2019"], k=r.randint(1, 24))) for _ in range(100_000)]
    for at in range(0, len(texts), 10_000):
        some = texts[at : at + 10_000]
        assert w(some) == w._whole(some)


def test_pieces_hold_the_librarys_ids(spark):
    """Every document of a table: its pieces' counts and digests against the library's ids, read off a plain loop."""
    path, data = tokenizers.path("word_bpe_49k.json"), "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    got = packing.query(spark, data).toPandas()
    from array import array

    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    ids = {r.doc_id: [*model.encode(r.text or "", add_special_tokens=False).ids, 1] for r in docs.collect()}
    assert sorted(got.doc_id.unique()) == sorted(ids)
    covered = {d: 0 for d in ids}
    for p in got.sort_values(["doc_id", "start"]).itertuples():
        own = ids[p.doc_id]
        assert p.start == covered[p.doc_id] and p.doc_tokens == len(own)
        assert p.ids_crc32 == zlib.crc32(array("I", own[p.start : p.start + p.length]).tobytes())
        covered[p.doc_id] += p.length
    assert all(covered[d] == len(x) for d, x in ids.items())
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert (s.offset.to_numpy() == np.append(0, s.length.cumsum()[:-1])).all()
        total = s.length.sum()
        assert total == 2048 or total < 2048 and total & (total - 1) == 0


def test_packing_of_odd_rows(spark):
    rows = [(1, None, "z"), (2, "", "z"), (2, "", "z"), (3, "hello there " * 900, None), (4, "a b " * 150_000, None), (4, "a b " * 150_000, None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, length string")
    out = packing.pack(docs, tokenizers.path("word_bpe_49k.json")).toPandas()
    assert (out["offset"] >= 0).all() and (out["length"] <= 2048).all()
    assert out["length"].sum() == 3 + 1801 + 2 * 300_001
    ones = out[out.doc_tokens == 1]
    assert len(ones) == 3 and (ones.ids_crc32 == zlib.crc32(b"\x01\0\0\0")).all()
    assert packing.pack(docs.limit(0), tokenizers.path("word_bpe_49k.json")).count() == 0


# token counts


def test_cache_encodes_each_text_once(spark, tmp_path):
    path, cache = tokenizers.path("byte_bpe_50k.json"), f"file://{tmp_path}/cache"
    docs = spark.createDataFrame([(1, "hello world"), (2, "hello world"), (3, None), (4, ""), (5, "x<|endoftext|>y")], "doc_id int, text string")
    got = {r.id: (r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(docs, path, cache).select(F.col("_row.doc_id").alias("id"), "n_bytes", "n_tokens").collect()}
    assert got == {1: (11, 2), 2: (11, 2), 3: (0, 0), 4: (0, 0), 5: (15, 3)}
    assert spark.read.parquet(cache).count() == 3
    more = docs.union(spark.createDataFrame([(6, "new")], "doc_id int, text string"))
    assert token_counts.count_tokens(more, path, cache).count() == 6 and spark.read.parquet(cache).count() == 4
    other = tokenizers.path("piece_bpe_32k.model")
    assert token_counts.count_tokens(docs, other, cache).where("n_tokens is null").count() == 0 and spark.read.parquet(cache).count() == 7
    assert token_counts.count_tokens(docs.limit(0), path, cache).count() == 0


def test_token_counts_of_odd_rows(spark, tmp_path):
    """Null, empty, repeated, clashing and very long rows: one row each, counted as the library counts the whole text."""
    from tokenizers import Tokenizer

    path = tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    long_text = "Long words, again and again. " * 40_000 + "é\n\t" * 50
    rows = [(1, None, "a", 7, "x"), (1, "", "b", 7, "x"), (2, "same text", "c", 8, None), (2, "same text", "c", 8, None), (None, "no id", None, None, "y"), (3, long_text, "d", 9, "z")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, content string, n_tokens int, tokenizer string")
    out = token_counts.count_tokens(docs, path, f"file://{tmp_path}/cache")
    got = sorted((str(r._row.doc_id), r._row.content or "", r.n_bytes, r.n_tokens) for r in out.collect())
    want = sorted((str(i), c or "", len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, c, _, _ in rows)
    assert got == want


# archives


def archive(n=6):
    return [warc.record(i, f"http://x/{i}", f"<p>{i}".encode() * 50, None, False) for i in range(n)]


@pytest.mark.parametrize("packed", [True, False])
def test_salvage(packed):
    parts = [warc.member(r) if packed else r for r in archive()]
    starts = np.cumsum([0, *map(len, parts)])
    data = bytearray(b"".join(parts))
    assert [x[0] for x in warc.records(bytes(data))] == ["record"] * 6
    for k in range(20):  # a broken second record, and a cut in the fourth
        data[starts[1] + 30 + k] ^= 0x5A
    broken = bytes(data[: starts[3] + 40]) + b"\0\0noise" + bytes(data[starts[4] :])
    got = list(warc.records(broken))
    ids = [warc._page(x[3]["warc-record-id"]) for x in got if x[0] == "record"]
    assert ids == [0, 2, 4, 5]
    gaps = [x for x in got if x[0] == "gap"]
    assert len(gaps) == 2 and gaps[0][1:3] == (starts[1], starts[2])
    covered = sorted((x[1], x[2]) for x in got)
    assert covered[0][0] == 0 and covered[-1][1] == len(broken) and all(a[1] == b[0] for a, b in zip(covered, covered[1:]))


def test_salvage_of_rubbish():
    assert list(warc.records(b"")) == []
    assert [x[:3] for x in warc.records(b"nothing here")] == [("gap", 0, 12)]
    assert [x[:3] for x in warc.records(b"\x1f\x8b\x08rubbish")] == [("gap", 0, 10)]
    cut = warc.member(archive(1)[0])[:-5]
    assert [x[0] for x in warc.records(cut)] == ["gap"]


def test_warc_round_trip(spark, tmp_path):
    rows = [(3, "http://a b\r\n", "<p>é"), (1, None, "<p>é"), (2, "u", None), (7, "u", ""), (None, "u", "<p>é"), (9, "u", "x" * 300_000), (3, "http://a b\r\n", "<p>é")]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, payload string")
    folder = f"file://{tmp_path}/w"
    records, files = warc.write_archives(warc.assign(pages), folder, roll_bytes=200)
    assert records == 7 and files == sum(p.name.endswith(".warc.gz") for p in (tmp_path / "w").iterdir())
    out = warc.read_archives(spark, folder)
    assert out.where("kind = 'gap'").count() == 0
    got = sorted((r.page_id if r.page_id is not None else -1, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in out.collect())
    d = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    a, e = d("<p>é"), d("")
    assert got == [(-1, "revisit", 1, 5, a), (1, "response", None, 5, a), (2, "response", None, 0, e), (3, "revisit", 1, 5, a), (3, "revisit", 1, 5, a), (7, "revisit", 2, 0, e), (9, "response", None, 300_000, d("x" * 300_000))]
    assert out.where("page_id = 3").first().target_uri == "http://a%20b%0D%0A"
    assert {r.record_type for r in warc.assign(pages, min_bytes=10).select(F.when(F.col("revisit"), "revisit").otherwise("response").alias("record_type")).collect()} == {"response"}


# set-similarity join


def test_license_scan_against_all_pairs(spark):
    r = random.Random(5)
    words = [w for _, ws in license_scan.template_words(license_scan.TEMPLATES) for w in ws] + ["foo", "bar", "the"] * 10
    texts = [None, "", "MIT License mit LICENSE", "the General  Public\nLicense", "x " * 300 + "Released under the MIT License. " + "y " * 300]
    for label, t in license_scan.TEMPLATES:
        ws = t.split()
        texts += [t, " ".join(ws[: len(ws) * 4 // 5]), " ".join(r.sample(ws, len(ws))), "\n".join(ws)]
    texts += [" ".join(r.choice(words) for _ in range(r.randint(1, 400))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found = {x.id: sorted({m.label for m in x.matches}) for x in license_scan.scan(docs).select(F.col("_row.doc_id").alias("id"), "matches").collect()}
    import re

    table = str.maketrans(license_scan.UPPER, license_scan.LOWER)
    sets = license_scan.template_words(license_scan.TEMPLATES)
    for i, t in enumerate(texts):
        want = set()
        for line in (t or "").translate(table).split("\n"):
            ws = re.findall(license_scan.WORDS, line)
            for k in range(0, max(1, len(ws)), 64):
                block = set(ws[k : k + 128])
                want |= {label for label, need in sets if len(block & set(need)) >= 0.8 * len(need) - 1e-9}
        assert found[i] == sorted(want), t
    assert license_scan.scan(docs, templates=[]).where("size(matches) > 0").count() == 0


# block-max WAND


def test_wand_against_all_scores():
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(120)]
    pick = lambda n: " ".join(r.choices(vocabulary, [1 / (i + 1) for i in range(120)], k=n))
    items = [(i, pick(r.randint(3, 30))) for i in range(150)]
    index = decontaminate.Index(items, 1000, {w: r.randint(0, 900) for w in vocabulary}.__getitem__)
    for _ in range(150):
        terms = np.unique([index.vocabulary[w] for w in pick(r.randint(1, 60)).split() if w in index.vocabulary])
        if not len(terms):
            continue
        scores = np.zeros(len(index.ids))
        for t in terms:
            scores[index.postings[t]] += index.impacts[t]
        for threshold in (0.3, 0.6):
            got = dict(index.search(terms, threshold))
            assert sorted(got) == np.flatnonzero(scores >= threshold - 1e-12).tolist()
            assert all(abs(got[k] - scores[k]) < 1e-9 for k in got)


def test_leaks(spark):
    item = "What is the tallest mountain on the whole earth? It is called Everest by most people."
    loud = " | ".join(f"{w.upper()}!!" for w in item.split())
    prose = " ".join(f"filler{i % 97}" for i in range(3000))
    rows = [(1, f"{prose} {item} {prose}"), (2, loud), (3, prose), (4, None), (5, ""), (6, "the tallest mountain"), (1, f"{prose} {item}")]
    docs = spark.createDataFrame([(i, t, "h") for i, t in rows], "doc_id int, text string, hits string")
    tests = spark.createDataFrame([(10, item), (11, None), (12, ""), (10, item), (13, "filler unrelated words only here")], "item_id long, text string")
    out = decontaminate.leaks(docs, tests)
    assert sorted((r.d, r.h.item_id) for r in out.select(F.col("_row.doc_id").alias("d"), F.explode("hits").alias("h")).collect()) == [(1, 10), (1, 10), (2, 10)]
    clean = decontaminate.clean_documents(docs, tests)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [3, 4, 5, 6]
    assert decontaminate.clean_documents(docs, tests.limit(0)).count() == 7
    assert decontaminate.leaks(docs.limit(0), tests).count() == 0


def test_leaks_in_shards(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SHARD", 2)
    items = [(i, f"alpha{i} beta{i} gamma{i} delta{i} epsilon{i}") for i in range(7)]
    docs = spark.createDataFrame([(i, f"x {t} y") for i, t in items], "doc_id int, text string")
    out = decontaminate.leaks(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r.d, r.h.item_id) for r in out.select(F.col("_row.doc_id").alias("d"), F.explode("hits").alias("h")).collect()) == [(i, i) for i in range(7)]


# near duplicates


def brute(texts: dict, threshold: float = 0.8):
    import re

    sets = {}
    for i, t in texts.items():
        w = re.findall(r"\w+", (t or "").lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(texts, 2):
        if sets[a] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in texts}


def test_near_duplicates_against_all_pairs(spark):
    r = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    texts, n = {}, 0
    for _ in range(30):
        base = r.choices(words, k=r.randint(40, 300))
        for _ in range(r.randint(1, 6)):
            edited = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 3])):
                edited[r.randrange(len(edited))] = r.choice(words)
            texts[n] = " ".join(edited)
            n += 1
    texts |= {n: None, n + 1: "", n + 2: "one two", n + 3: "One, two", n + 4: "  ", n + 5: texts[0], n + 6: "z " * 30_000}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {x.doc_id: x.class_id for x in near_dup.classes(docs).collect()}
    want = brute(texts)
    assert all(got[a] == got[b] for a, b in itertools.combinations(texts, 2) if want[a] == want[b])
    assert sum(got[i] != want[i] for i in texts) <= 3  # weighted similarity may link a little more
    kept = near_dup.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(x.doc_id for x in kept.collect()) == sorted({got[i] for i in texts})


def test_near_dup_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (None, "a b c d e f", "x"), (2, None, "x"), (2, None, "x")], "doc_id long, text string, node string")
    got = sorted((str(r.doc_id), str(r.class_id)) for r in near_dup.classes(docs).collect())
    assert got == [("1", "1"), ("1", "1"), ("2", "2"), ("2", "2"), ("None", "1")]
    assert near_dup.classes(docs.limit(0)).count() == 0 and near_dup.one_of_each(docs.limit(0)).count() == 0


def test_components(spark):
    chain = [(b"%03d" % i, b"%03d" % (i + 1)) for i in range(60)] + [(b"x", b"y"), (b"q", b"q")]
    edges = spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b in chain], "a binary, b binary")
    got = {bytes(r.node): bytes(r.root) for r in near_dup.components(edges).collect()}
    assert got == {b"%03d" % i: b"000" for i in range(1, 61)} | {b"y": b"x"}


def test_samples_agree_like_the_similarity():
    r = np.random.default_rng(1)
    s = np.sort(r.integers(0, 1 << 63, 400, np.uint64))
    sampler, level = near_dup.Sampler(), r.integers(0, 40, 400)
    w = np.exp(level / near_dup.GRID)
    part = slice(0, 330)
    want = w[part].sum() / w.sum()
    same = (sampler(s, level) == sampler(s[part], level[part])).mean()
    assert abs(same - want) < 0.17
    assert (sampler(s, level) == sampler(s, level)).all()


def test_least_agreement_is_a_bound():
    """No pair of plain similarity 0.8 or more, whatever its weights, is expected to agree less than the bound."""
    r = np.random.default_rng(9)
    for _ in range(200):
        n = int(r.integers(20, 300))
        w = np.exp(r.uniform(0, 3, n))
        k = int(n * 0.2 / 1.8)
        heavy = np.argsort(-w)[:k]
        shared = w.sum() - w[heavy].sum()
        weighted = shared / (shared + 2 * w[heavy].sum())  # both sides differ in their heaviest shingles
        assert near_dup.least_agreement(w, 0.8) <= near_dup.SAMPLES * weighted


def test_piece_counts_are_the_librarys():
    w = token_counts.piece_counts(tokenizers.path("byte_bpe_50k.json"))
    assert w.fast
    texts = ["", " \n\t", "It's ÉCOLE, naïve & <|endoftext|> x", "12²½ a_b—c", "ΣΑΣ İstanbul", "日本 a😀b", "a b\x1cc", "don't WE'LL 'S ''s", "a  b   c\n\n\nd  ", "\r\n x", "x" * 5000]
    assert w(texts) == w._whole(texts)


@pytest.mark.parametrize(("large", "huge", "block"), [(1, 4096, 3), (1, 4, 3), (4096, 4096, 256)])
def test_every_way_through_a_bucket(spark, monkeypatch, large, huge, block):
    """Small buckets meet in a join, larger ones in blocks, huge ones by two bands: the classes are the same, but for rare pairs of the last way."""
    monkeypatch.setattr(near_dup, "LARGE", large)
    monkeypatch.setattr(near_dup, "HUGE", huge)
    monkeypatch.setattr(near_dup, "BLOCK", block)
    r = random.Random(12)
    words = [f"w{i}" for i in range(300)]
    texts = {}
    for _ in range(4):
        chain = r.choices(words, k=120)
        for _ in range(25):  # a chain of edits: far ends are linked through the middle alone
            chain = list(chain)
            for _ in range(2):
                chain[r.randrange(120)] = r.choice(words)
            texts[len(texts)] = " ".join(chain)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {x.doc_id: x.class_id for x in near_dup.classes(docs).collect()}
    want = brute(texts)
    missed = [(a, b) for a, b in itertools.combinations(texts, 2) if want[a] == want[b] and got[a] != got[b]]
    assert not missed


def hot(copies: int = 60, others: int = 640) -> dict:
    """A text that a third of all rows repeat, edited copies at a plain similarity of 0.806 of it, and other texts."""
    r = random.Random(31)
    words = [f"w{i}" for i in range(50_000)]
    base = r.sample(words, 284)
    texts = {i: " ".join(base) for i in range(350)}
    for _ in range(copies):
        edited = list(base)
        for k in r.sample(range(6, 280, 10), 6):
            edited[k] = r.choice(words)
        texts[len(texts)] = " ".join(edited)
    for _ in range(others):
        texts[len(texts)] = " ".join(r.choices(words, k=120))
    return texts


def test_copies_of_a_text_that_a_third_of_the_rows_hold(spark):
    texts = hot()
    want = brute({i: t for i, t in texts.items() if 349 <= i < 410})
    assert set(want.values()) == {349}
    got = {x.doc_id: x.class_id for x in near_dup.classes(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert [i for i in want if got[i] != 0] == []
    assert all(got[i] == i for i in range(410, len(texts)))


def test_pairs_of_a_huge_bucket_need_one_band_only(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "LARGE", 1)
    monkeypatch.setattr(near_dup, "HUGE", 1)
    # the four share the first band alone; c and d, neither of which is the first node of a round, agree in 49 of 64 samples
    texts = {1: "a" * 9, 2: "b" * 9, 3: " ".join(f"w{i}" for i in range(60)), 4: " ".join(f"w{i}" for i in range(61))}
    size = 2 * near_dup.SAMPLES
    sigs = {t: [0] * 4 + [1000 * i + k for k in range(4, size)] for i, t in texts.items()}
    sigs[texts[4]] = [v if k < 4 else v - 1000 * (k % 4 > 0) for k, v in enumerate(sigs[texts[4]])]
    means = {t: float(i) for i, t in texts.items()}

    def sampled(idf, threshold):
        return lambda: lambda some: [[sigs[t] for t in some], [40] * len(some), [means[t] for t in some]]

    monkeypatch.setattr(near_dup, "_sampled", sampled)
    got = {x.doc_id: x.class_id for x in near_dup.classes(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 3}


def test_wrapped_licenses(spark):
    import textwrap

    texts = [t for _, t in license_scan.TEMPLATES]
    wrapped = ["\n".join(f"# {line}" for line in textwrap.wrap(t, 40)) for t in texts]
    docs = spark.createDataFrame(list(enumerate(wrapped)) + [(99, "nothing\nto\nfind")], "doc_id int, text string")
    found = {x.id: {m.label for m in x.wrapped} for x in license_scan.scan(docs).select(F.col("_row.doc_id").alias("id"), "wrapped").collect()}
    assert all(label in found[i] for i, (label, _) in enumerate(license_scan.TEMPLATES) if "\n" in wrapped[i]) and found[99] == set()


def test_wrapped_licenses_in_the_query(spark, tmp_path):
    mit = license_scan.TEMPLATES[1][1].split()
    spark.createDataFrame([(1, " ".join(mit[:13]) + "\n" + " ".join(mit[13:]))], "doc_id int, text string").write.parquet(f"{tmp_path}/documents.parquet")
    row = license_scan.query(spark, str(tmp_path)).first()
    assert (row.labels, row.score) == ("mit", 1.0)


def test_leaks_of_items_that_share_an_id(spark):
    texts = [f"alpha{i} beta{i} gamma{i} delta{i} epsilon{i}" for i in range(4)]
    items = spark.createDataFrame(list(zip([5, 5, None, None], texts, strict=True)), "item_id long, text string")
    out = decontaminate.leaks(spark.createDataFrame([(i, f"x {t} y") for i, t in enumerate(texts)], "doc_id int, text string"), items)
    got = {r.d: [h.item_id for h in r.hits] for r in out.select(F.col("_row.doc_id").alias("d"), "hits").collect()}
    assert got == {0: [5], 1: [5], 2: [None], 3: [None]}


def test_long_urls(spark, tmp_path):
    url = "data:text/html," + "x" * 70_000
    folder = f"file://{tmp_path}/w"
    warc.write_archives(warc.assign(spark.createDataFrame([(1, url, "<p>a"), (2, "u", "<p>b")], "page_id long, url string, html string")), folder)
    out = warc.read_archives(spark, folder).collect()
    assert sorted((r.kind, r.page_id, r.target_uri) for r in out) == [("record", 1, url), ("record", 2, "u")]


def test_warc_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert warc.query(spark, str(tmp_path)).count() == 0


def test_warc_loses_no_page(spark, tmp_path):
    """A URL of a megabyte, a payload of many megabytes, and a payload that most rows share: every page comes back."""
    rows = [(1, "data:," + "x" * (1 << 20), "<p>a"), (2, "u", "<p>" + "word " * 4_000_000), *[(i, "u", "same") for i in range(10, 60)], (70, None, None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes) for r in warc.query(spark, str(tmp_path)).collect()}
    assert got[1] == ("response", None, 4) and got[2] == ("response", None, 20_000_003) and got[70] == ("response", None, 0)
    assert got[10] == ("response", None, 4) and all(got[i] == ("revisit", 10, 4) for i in range(11, 60)) and len(got) == len(rows)


def test_a_gap_in_new_archives_is_a_fault(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1, "u", "<p>a")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    write = warc.write_archives

    def broken(rows, folder, **more):
        out = write(rows, folder, **more)
        for p in __import__("pathlib").Path(folder.removeprefix("file://")).glob("*.warc.gz"):
            p.write_bytes(p.read_bytes()[:-9])
        return out

    monkeypatch.setattr(warc, "write_archives", broken)
    with pytest.raises(Exception, match="member is cut off"):
        warc.query(spark, str(tmp_path)).collect()


def test_members_over_the_limit_are_gaps():
    data = warc.member(b"x" * 1000)
    assert warc.inflate(memoryview(data), 0)[0] == b"x" * 1000
    with pytest.raises(warc.Bad, match="too large"):
        warc.inflate(memoryview(data), 0, most=999)


def test_question_and_answer_are_both_needed(spark):
    question, answer = "Which river runs through the old town of the northern province today?", "It is the long green river that the map calls Arno."
    rows = [(1, f"before it {question} {answer} after it"), (2, f"before it {question} and some other words that say nothing"), (3, f"some words that say nothing {answer} after it"), (4, f"{question} something between the two of them {answer}")]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    out = decontaminate.leaks(docs, spark.createDataFrame([(7, f"{question} {answer}")], "item_id long, text string"))
    assert sorted(r.d for r in out.where("size(hits) > 0").select(F.col("_row.doc_id").alias("d")).collect()) == [1, 4]


def test_leaks_of_a_table_against_all_pairs(spark):
    """Every document against every item, without an index: the same pairs are leaks."""
    data = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()}
    longest = max(len(decontaminate.words_of(t)) for t in items.values())
    size = max(decontaminate.LEAST_PASSAGE, 2 * longest)
    want = set()
    for d, text in docs.items():
        words = decontaminate.words_of(text)
        for at in range(0, max(len(words) - size // 2, 1), size // 2):
            windows = {}
            for i, t in items.items():
                parts = [decontaminate.words_of(t), *decontaminate.question_and_answer(t)]
                if min(decontaminate.share(p, words[at : at + size], windows) for p in parts) >= 0.5:
                    want.add((d, i))
    got = {(r.doc_id, r.item_id) for r in decontaminate.query(spark, data).collect()}
    assert got == want and len(want) > 0


def test_the_first_common_shingle_bounds_the_similarity(spark):
    """No pair that is similar enough, plain or weighted, is ruled out; both forms of the bound say the same."""
    r = random.Random(17)
    words = [f"w{i}" for i in range(2000)]
    base = r.sample(words, 150)
    texts = []
    for _ in range(150):
        edited = list(base)
        for _ in range(r.randint(0, 9)):
            edited[r.randrange(len(edited))] = r.choice(words)
        texts.append(" ".join(edited[: r.randint(110, 150)] * r.choice([1, 1, 1, 2])))
    hashes, counts = near_dup.Hashes(), np.zeros(near_dup.BUCKETS, np.int64)
    for t in texts:
        counts[np.unique((near_dup.shingles(t, hashes)[0] >> np.uint64(64 - near_dup.BITS)).astype(np.int64))] += 1
    idf = near_dup.log_idf(3000, counts)
    import pyarrow as pa

    made = near_dup._heads(idf, 0.8)()(texts)
    table = pa.table({f.name: pa.array(list(c)) for f, c in zip(near_dup.HEAD, made, strict=True)})
    heads, sets = near_dup.Heads(table), []
    for t in texts:
        s, n = near_dup.shingles(t, hashes)
        sets.append((s, np.exp(near_dup.levels(s, n, idf) / near_dup.GRID), np.ones(len(s))))
    ruled = similar = 0
    can = np.array([near_dup.reaching(heads, i, np.arange(len(texts)), 0.8) for i in range(len(texts))])
    for i, j in itertools.combinations(range(len(texts)), 2):
        linked = near_dup.jaccard(sets[i][:2], sets[j][:2]) >= 0.8 or near_dup.jaccard(sets[i][::2], sets[j][::2]) >= 0.8
        assert can[i, j] or not linked
        assert can[i, j] == can[j, i]
        ruled, similar = ruled + (not can[i, j]), similar + linked
    assert similar > 50 and ruled > 5000
    rows = spark.createDataFrame([(k, [int(x) for x in h], [float(x) for x in w], int(n), float(f)) for k, (h, w, n, f) in enumerate(zip(*made, strict=True))], "k int, head array<bigint>, rest array<double>, size int, total double")
    left, right = (rows.select(*[F.col(c).alias(f"{c}_{x}") for c in rows.columns]) for x in "ab")
    both = left.where("k_a < 20").crossJoin(right).select("k_a", "k_b", near_dup.can_reach(0.8).alias("can")).collect()
    assert all(x["can"] == can[x.k_a, x.k_b] for x in both)


@pytest.mark.parametrize("data", ["/root/testdata/sf0.01"])
def test_recall_on_a_table(spark, data):
    """Every pair of a table's texts, held against each other: nine tenths at least share a class, weighted or plain."""
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = {r.doc_id: r.class_id for r in near_dup.query(spark, data).collect()}
    hashes, sets = near_dup.Hashes(), {}
    counts = np.zeros(near_dup.BUCKETS, np.int64)
    for t in docs.values():
        s, _ = near_dup.shingles(t, hashes)
        counts[np.unique((s >> np.uint64(64 - near_dup.BITS)).astype(np.int64))] += 1
    idf = near_dup.log_idf(sum(bool(hashes(t).size) for t in docs.values()), counts)
    for d, t in docs.items():
        s, n = near_dup.shingles(t, hashes)
        sets[d] = (s, np.exp(near_dup.levels(s, n, idf) / near_dup.GRID), np.ones(len(s)))
    pairs = found = 0
    for a, b in itertools.combinations(docs, 2):
        x, y = sets[a], sets[b]
        if len(x[0]) and len(y[0]) and np.isin(x[0][:400], y[0], assume_unique=True).any() and max(near_dup.jaccard(x[:2], y[:2]), near_dup.jaccard(x[::2], y[::2])) >= 0.8:
            pairs, found = pairs + 1, found + (got[a] == got[b])
    assert pairs > 50 and found >= 0.99 * pairs


def test_rows_without_an_id_have_links(spark):
    r = random.Random(3)
    base = r.choices([f"w{i}" for i in range(500)], k=200)
    near = [" ".join(base[:k] + ["x"] + base[k + 1 :]) for k in (50, 100, 150)]
    docs = spark.createDataFrame([(1, near[0]), (None, near[1]), (None, near[1]), (None, near[2]), (9, " ".join(base))], "doc_id long, text string")
    assert {x.class_id for x in near_dup.classes(docs).collect()} == {1}

"""The pipeline: stages keep the columns of documents, and each does its work on what the one before kept."""

import random

import pytest
from conftest import DATA
from pyspark.sql import functions as F

import corpus_pipeline
from docloom.llm import decontaminate, near_dup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_dup", "decontaminate", "secret_scan", "packing"]
    sizes, now = [docs.count()], docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, DATA).cache()
        assert now.columns == docs.columns
        sizes.append(now.count())
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] == sizes[4] > 0
    classes = near_dup.classes(now)
    assert classes.count() == classes.select("class_id").distinct().count()
    assert decontaminate.leaks(now, spark.read.parquet(f"{DATA}/benchmark.parquet")).where("size(hits) > 0").count() == 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, now, DATA)
    assert pieces.select("doc_id").distinct().count() == sizes[-1]
    assert corpus_pipeline.ORACLE_SQL is None


def prose(seed: int, n: int = 120) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefghiklmnoprstuvw", k=r.randint(2, 9))) for _ in range(n))


@pytest.fixture
def folder(spark, tmp_path):
    """Tables of odd rows: nulls in every column, empty and repeated rows, equal ids, a very long text, columns that clash with inner names."""
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    rows = [(1, prose(1)), (1, prose(1)), (2, None), (3, ""), (4, prose(1) + " more"), (None, prose(5)), (None, prose(5) + " end"), (7, prose(7, 40_000)), (8, f"{prose(8)} token = {key} {prose(9)}"), (9, prose(10))]
    docs = spark.createDataFrame([(i, t, None, None, None, "r", "t", "n", "h") for i, t in rows], f"{DOCS}, _row string, _text string, node string, hits string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (8, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, prose(10)), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_stages_on_odd_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = {}
    for name in ("quality_rules", "near_dup", "decontaminate", "secret_scan"):
        out = stages[name](spark, docs, folder)
        assert out.columns == docs.columns
        kept[name] = sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in out.select("doc_id", F.coalesce(F.substring("text", -60, 60), F.lit("null")).alias("text")).collect())
    ids = {k: [i for i, _ in v] for k, v in kept.items()}
    assert ids["quality_rules"] == [-1, -1, 1, 1, 4, 7, 8, 9]  # null and empty texts fail the base rule
    assert ids["near_dup"] == [-1, -1, 1, 2, 3, 7, 8, 9]  # rows without an id stay; of the others one of each class
    assert ids["decontaminate"] == [-1, -1, 1, 1, 2, 3, 4, 7, 8]  # the benchmark's own text goes
    assert len(ids["secret_scan"]) == 10 and (2, "null") in kept["secret_scan"] and (3, "") in kept["secret_scan"]
    assert stages["secret_scan"](spark, docs, folder).where("contains(text, '[SECRET]')").select("doc_id", "n_chars").first().doc_id == 8
    pieces = stages["packing"](spark, docs, folder).toPandas()
    assert (pieces.groupby("doc_id", dropna=False)["length"].sum().loc[[2.0, 3.0]] == 1).all() and len(pieces) >= 10


def test_run_on_odd_and_empty_tables(spark, folder, tmp_path):
    out = corpus_pipeline.run(spark, folder)
    assert sorted({r.doc_id if r.doc_id is not None else -1 for r in out.select("doc_id").collect()}) == [-1, 1, 7, 8]
    empty = tmp_path / "empty"
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{empty}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(empty)).count() == 0

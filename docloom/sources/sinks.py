"""Stage tables with checkpoints, ledgers, JSON views and grading sheets."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def checkpointed(todo: DataFrame, path: str, stage: Callable[[DataFrame], DataFrame], key: str = "doc_id", force: bool = False) -> DataFrame:
    """The stage's rows for all of todo: only keys without a row in the table at `path` are computed and appended; force computes all again.

    A key whose stage yields no row is computed again next time.
    """
    spark = todo.sparkSession
    if force:
        stage(todo).write.mode("overwrite").parquet(path)
    elif not exists(spark, path):
        stage(todo).write.parquet(path)
    else:
        done = spark.read.parquet(path).select(key).distinct()
        stage(todo.join(done, key, "left_anti")).write.mode("append").parquet(path)
    return spark.read.parquet(path).join(todo.select(key).distinct(), key, "left_semi")


def tried(rows: DataFrame, column: str, make: Callable, kind: str = "string") -> DataFrame:
    """rows with a column made row by row where a failure fills `error` instead of ending the job."""
    @F.pandas_udf(f"struct<value:{kind},error:string>")
    def run(s: pd.Series) -> pd.DataFrame:
        out = []
        for x in s:
            try:
                out.append((make(x), None))
            except Exception as e:
                out.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(out, columns=["value", "error"])

    return rows.withColumn("_r", run(F.col(column))).select(*rows.columns, "_r.value", "_r.error")


def write_json(df: DataFrame, path: str, stage: str | None = None, drop: list[str] | None = None) -> None:
    """One JSON object a row, nulls written; large text columns can be left out."""
    rows = df.drop(*(drop or []))
    out = rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    out.write.mode("overwrite").text(f"{path}/stage={stage}" if stage else path)


def append_ledger(runs: DataFrame, path: str) -> DataFrame:
    """Appends runs (doc_id, by_model, …) and returns the lifetime totals."""
    from docloom.operators.usage import lifetime

    runs.write.mode("append").parquet(path)
    return lifetime(runs.sparkSession.read.parquet(path))


def append_verdicts(verdicts: DataFrame, path: str) -> DataFrame:
    from docloom.operators.usage import verdict_rates

    verdicts.write.mode("append").parquet(path)
    return verdict_rates(verdicts.sparkSession.read.parquet(path))


def sheet_lines(rows: DataFrame, banner: list[str]) -> DataFrame:
    """(doc_id, sheet): for each document a CSV text of banner lines, a blank line, a header and its rows in order."""
    names = ["field", "extracted_value", "source_pages", "critic_verdict", "model_confidence", "your_grade", "your_notes"]
    cell = lambda c: F.when(F.col(c).rlike("[\",\r\n]"), F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.col(c))
    line = F.concat_ws(",", *[cell(c) for c in names])
    each = rows.select("doc_id", "ord", line.alias("line")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "line"))).alias("ls"))
    head = [*(f"# {b}" for b in banner), "", ",".join(names)]
    return each.select("doc_id", F.array_join(F.concat(F.lit(head), F.transform("ls", lambda x: x["line"])), "\r\n").alias("sheet"))


def write_sheets(rows: DataFrame, banner: list[str], path: str) -> None:
    sheet_lines(rows, banner).write.mode("overwrite").partitionBy("doc_id").text(path)


def inspected(spark: SparkSession, path: str) -> str:
    """The schema that a JSON file has, as text."""
    return spark.read.option("multiLine", "true").json(path).schema.simpleString()

"""Catalog records, whose fields are strings, lists or objects: read as VARIANT, then projected."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions import text as tx

RECORD = "doc_key string, found boolean, record string"


def works(spark: SparkSession, path: str) -> DataFrame:
    """(work VARIANT, work_ord): a JSON file that is a list of works, or one work a line."""
    rows = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    lists = rows.where("v is not null").select(F.expr("try_variant_get(v, '$', 'array<variant>')").alias("ws"))
    return lists.select(F.posexplode("ws").alias("work_ord", "work"))


def text_at(work: Column, path: str) -> Column:
    """A scalar, or the first of a list, as text."""
    return F.coalesce(F.try_variant_get(work, f"{path}[0]", "string"), F.try_variant_get(work, path, "string"))


def labels(work: Column, path: str) -> Column:
    """array<string> of a list of objects (label_with_role, else label, else name, else id) or strings, or of one string."""
    listed = F.try_variant_get(work, path, "array<variant>")
    one = lambda x: F.coalesce(*[F.nullif(F.try_variant_get(x, f"$.{k}", "string"), F.lit("")) for k in ("label_with_role", "label", "name", "id")], F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")))
    alone = F.when(F.schema_of_variant(F.try_variant_get(work, path, "variant")) == "STRING", F.array(F.try_variant_get(work, path, "string")))
    return F.coalesce(F.filter(F.transform(listed, one), lambda x: F.coalesce(x, F.lit("")) != ""), alone, F.array().cast("array<string>"))


def contributors(work: Column) -> Column:
    return F.concat(labels(work, "$.contributor"), labels(work, "$.creator"))


def harvested(value: str | None) -> list[str]:
    """All strings in a JSON value, in order."""
    out: list[str] = []

    def walk(x):
        if isinstance(x, str):
            out.append(x)
        elif isinstance(x, dict | list):
            for y in x.values() if isinstance(x, dict) else x:
                walk(y)

    try:
        walk(json.loads(value or "null"))
    except ValueError:
        return []
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def identifiers(s: pd.Series) -> pd.Series:
    return s.map(harvested)


def year(work: Column, fields: tuple[str, ...] = ("create_date", "date_created_edtf", "date_created")) -> Column:
    """The first year of the first field that has one. create_date is often the date of the record: put the edtf field first to prefer the work's."""
    return tx.year_of_dates(*[F.coalesce(F.array_join(F.try_variant_get(work, f"$.{f}", "array<string>"), " "), F.try_variant_get(work, f"$.{f}", "string")) for f in fields])


def projected(rows: DataFrame, keep: list[str], site: str, api: str) -> DataFrame:
    """(work_id, the fields to keep as text, source_url, api_link)."""
    ident = F.try_variant_get("work", "$.id", "string")
    return rows.select(ident.alias("work_id"), *[F.coalesce(F.try_variant_get("work", f"$.{f}", "string"), F.to_json(F.try_variant_get("work", f"$.{f}", "variant"))).alias(f) for f in keep], F.concat(F.lit(f"{site}/items/"), ident).alias("source_url"), F.concat(F.lit(f"{api}/works/"), ident).alias("api_link"))


def silver(rows: DataFrame) -> DataFrame:
    """(work_id, work_ord, title, accession, identifiers, contributors, agency, date, year) of works."""
    w = F.col("work")
    return rows.select(F.try_variant_get(w, "$.id", "string").alias("work_id"), "work_ord", text_at(w, "$.title").alias("title"), F.coalesce(F.try_variant_get(w, "$.accession_number", "string"), F.lit("")).alias("accession"), identifiers(F.to_json(F.try_variant_get(w, "$.identifier", "variant"))).alias("identifiers"), contributors(w).alias("contributors"), F.get(labels(w, "$.contributor"), 0).alias("agency"), text_at(w, "$.date_created").alias("date"), year(w).alias("year"))


def looked_up(keys: DataFrame, cache: str, fetch: Callable[[str], dict | None] | None = None, tries: int = 5) -> DataFrame:
    """keys (doc_key, …) with found and record (VARIANT) through a permanent cache table; what is not found is cached too.

    fetch: asks a catalog for an accession number, then for the barcode alone; an error counts as not found. Without it
    only the cache is read.
    """
    spark = keys.sparkSession
    spark.createDataFrame([], RECORD).write.mode("append").parquet(cache)
    if fetch is not None:
        known = spark.read.schema(RECORD).parquet(cache).select("doc_key")
        new = keys.select("doc_key").distinct().join(known, "doc_key", "left_anti")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for key in b.column("doc_key").to_pylist():
                    got = None
                    for name in dict.fromkeys((key, key.split("_", 1)[-1])):
                        got = got or _tried(fetch, name, tries)
                    out.append({"doc_key": key, "found": got is not None, "record": None if got is None else json.dumps(got)})
                yield pa.RecordBatch.from_pylist(out, pa.schema([("doc_key", pa.string()), ("found", pa.bool_()), ("record", pa.string())]))

        new.mapInArrow(run, RECORD).write.mode("append").parquet(cache)
    have = spark.read.schema(RECORD).parquet(cache).groupBy("doc_key").agg(F.max_by(F.struct("found", "record"), "found").alias("r"))
    return keys.join(have, "doc_key", "left").select(*keys.columns, F.coalesce("r.found", F.lit(False)).alias("found"), F.try_parse_json("r.record").alias("record"))


def _tried(fetch: Callable[[str], dict | None], name: str, tries: int) -> dict | None:
    import time

    for k in range(tries):
        try:
            return fetch(name)
        except (ConnectionError, TimeoutError):
            time.sleep(min(0.5 * 2**k, 8) if k + 1 < tries else 0)
        except Exception:  # any other failure: not found
            return None
    return None


def fetched(spark: SparkSession, pages: Callable[[int], list[dict]], cache: str, size: int = 25, force: bool = False) -> DataFrame:
    """(work, work_ord) of a paged search, stored once: pages(n) returns the works of page n, fewer than `size` on the last."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    if force or not there:
        n, found = 1, []
        while True:
            got = pages(n)
            found += [(len(found) + k, json.dumps(w)) for k, w in enumerate(got)]
            if len(got) < size:
                break
            n += 1
        spark.createDataFrame(found, "work_ord int, record string").write.mode("overwrite").parquet(cache)
    return spark.read.parquet(cache).select("work_ord", F.try_parse_json("record").alias("work"))

"""Incremental ingestion, beyond the batch operators: new document files are taken up once, as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docloom.functions import text as tx
from docloom.functions import spans as sp


def arrivals(spark: SparkSession, folder: str, schema: str = "doc_id long, text string, lang string, source string, n_chars long") -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def page_index(docs: DataFrame) -> DataFrame:
    """(doc_id, text_id, estimated_pages, page, start, end) of documents, streaming or not: no state is kept."""
    rows = docs.select("doc_id", tx.text_id(F.coalesce("text", F.lit(""))).alias("text_id"), tx.estimated_pages(F.coalesce("text", F.lit(""))).alias("estimated_pages"), F.explode(sp.line_pages("text")).alias("p"))
    return rows.select("doc_id", "text_id", "estimated_pages", "p.page", "p.start", "p.end")


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Takes up what has arrived since the last run and stops; the checkpoint makes each file count once."""
    return page_index(arrivals(spark, folder)).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)

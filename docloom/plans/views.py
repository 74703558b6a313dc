"""Documents, mentions, works and usage made from the test tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

EIS = """SELECT doc_id, concat(
  CASE doc_id % 5 WHEN 0 THEN 'DRAFT ENVIRONMENTAL IMPACT STATEMENT' WHEN 1 THEN 'Final Environmental Impact Statement' WHEN 2 THEN 'Supplemental Draft Environmental Impact Statement' WHEN 3 THEN 'Record of Decision' ELSE 'Technical Report' END, chr(10),
  'Prepared by the ', CASE doc_id % 6 WHEN 0 THEN 'U.S. Forest Service' WHEN 1 THEN 'Bureau of Land Management' WHEN 2 THEN 'FHWA and partners' WHEN 3 THEN 'Department of the Army' WHEN 4 THEN 'Office of Roads' ELSE 'US EPA region' END, chr(10),
  'June ', CAST(1 + doc_id % 28 AS STRING), ', ', CAST(1970 + doc_id % 50 AS STRING), ' revised ', CAST(1970 + doc_id % 7 AS STRING), chr(10),
  'SUMMARY', chr(10), substring(text, 1, 700), chr(10),
  CASE WHEN doc_id % 3 = 0 THEN concat('PURPOSE AND NEED', chr(10), 'The need is clear.', chr(10)) ELSE '' END,
  'ALTERNATIVES', chr(10), 'Alternative A keeps the road. Alternative B-1 moves it. The No  Action choice and the Preferred Alternative follow.', chr(10), substring(text, 701, 900), chr(10),
  'CHAPTER 3. AFFECTED ENVIRONMENT', chr(10), substring(text, 1601), chr(10),
  CASE WHEN doc_id % 2 = 0 THEN concat('ENVIRONMENTAL CONSEQUENCES', chr(10), 'Noise and dust.', chr(10)) ELSE '' END,
  'PUBLIC COMMENTS', chr(10), 'COMMENT 1: We oppose the road because of noise. It should not be built here.', chr(10), 'Response:', chr(10), 'Noted. The agency agrees.', chr(10),
  'COMMENT 2: The county strongly supports Alternative A. We urge action now.', chr(10)) AS text FROM documents"""

MENTIONS = """SELECT conv_id AS doc_id, turn AS chunk_index, conv_id * 100 + turn AS ord,
  CASE turn % 4 WHEN 0 THEN 'Sierra Club' WHEN 1 THEN 'The Sierra Club (national)' WHEN 2 THEN 'Dr. Jane Roe' ELSE 'County of Kane' END AS entity,
  CASE turn % 3 WHEN 0 THEN 'organization' WHEN 1 THEN 'individual' ELSE 'agency' END AS kind, role,
  CASE (conv_id + turn) % 3 WHEN 0 THEN 'opposed' WHEN 1 THEN 'in_favor' ELSE 'neutral' END AS stance,
  CASE turn % 2 WHEN 0 THEN 'direct_quote' ELSE 'paraphrased' END AS attribution_mode,
  CASE WHEN conv_id % 5 = 0 THEN concat('not ', substring(text, 1, 40)) ELSE substring(text, 1, 30 + turn % 20) END AS quote,
  concat(CAST(turn + 1 AS STRING), '-', CAST(turn + 2 AS STRING)) AS page_span FROM conversations"""

USAGE = """SELECT user_id % 40 AS doc_id, event_id AS call_seq,
  CASE event_id % 4 WHEN 0 THEN 'vendor.sonnet-4-6' WHEN 1 THEN 'vendor.opus-4-7' WHEN 2 THEN 'small-haiku' ELSE 'other' END AS model,
  CAST(100 + event_id % 900 AS BIGINT) AS input_tokens, CAST(event_id % 300 AS BIGINT) AS output_tokens,
  CAST(CASE WHEN event_id % 7 = 0 THEN 50 ELSE 0 END AS BIGINT) AS cache_creation_input_tokens, CAST(event_id % 11 AS BIGINT) AS cache_read_input_tokens FROM events"""

VERDICTS = """SELECT o_orderkey % 97 AS doc_id, o_orderkey AS ord,
  CASE o_orderkey % 4 WHEN 0 THEN 'summary.text' WHEN 1 THEN concat('alternatives_proposed[', CAST(o_orderkey % 9 AS STRING), '].name') WHEN 2 THEN 'title' ELSE concat('historical_context_internal.claims[', CAST(o_orderkey % 5 AS STRING), ']') END AS field_path,
  CASE WHEN o_orderkey % 97 > 90 THEN 'pass' WHEN o_orderkey % 13 = 0 THEN 'no' WHEN o_orderkey % 11 = 0 THEN 'skipped' WHEN o_orderkey % 7 = 0 THEN 'partial' ELSE 'pass' END AS verdict FROM orders"""


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """sql over the tables it names, which are read from sf_dir; no temporary view stays behind."""
    import re

    for name in ("documents", "conversations", "events", "orders", "pages", "lineitem", "embeddings"):
        sql = re.sub(rf"\bFROM {name}\b", f"FROM parquet.`{sf_dir}/{name}.parquet`", sql)
    return spark.sql(sql)


def eis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, EIS)


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    rows = view(spark, sf_dir, MENTIONS)
    return rows.withColumn("evidence_pages", F.array("page_span")).withColumn("stance_basis", F.lit("")).drop("page_span")

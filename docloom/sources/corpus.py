"""Corpora in one JSON object, and folders of pages with confidences and metadata."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions import text as tx

METADATA = T.StructType([T.StructField(c, T.StringType()) for c in ("title", "agency", "date")])


def json_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(doc_key, text, doc_ord) of a file that maps keys to texts. One file is one task's work, as JSON in one object must be."""
    whole = spark.read.text(path, wholetext=True)
    pairs = F.map_entries(F.from_json("value", "map<string,string>"))
    return whole.select(F.posexplode(pairs).alias("doc_ord", "e")).select(F.col("e.key").alias("doc_key"), F.col("e.value").alias("text"), "doc_ord")


def page_files(spark: SparkSession, root: str) -> DataFrame:
    """(doc_dir, stem, page, text): TXT/*.txt below folders; bytes that are no UTF-8 become replacement characters."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(root)
    path = F.col("path")
    rows = files.where(path.rlike("/TXT/[^/]+$")).select(F.regexp_extract(path, "([^/]+)/TXT/[^/]+$", 1).alias("doc_dir"), F.regexp_extract(path, r"([^/]+)\.txt$", 1).alias("stem"), decoded(F.col("content")).alias("text"))
    return rows.withColumn("page", tx.page_number("stem"))


@F.pandas_udf(T.StringType())
def decoded(s: pd.Series) -> pd.Series:
    return s.map(lambda b: None if b is None else bytes(b).decode("utf-8", "replace"))


def confidence_of(value: Column) -> Column:
    """The median confidence that a JSON value states, in any of its four shapes; else null.

    {"words": [{confidence}]}, {"median_confidence" | "confidence" | "score": x}, or a list of {confidence}.
    """
    v = F.try_parse_json(value)
    each = lambda path: F.try_variant_get(v, path, "array<struct<confidence:double>>")
    number = F.coalesce(*[F.try_variant_get(v, f"$.{k}", "double") for k in ("median_confidence", "confidence", "score")])
    found = F.coalesce(each("$.words"), each("$"))
    return F.coalesce(median(F.transform(F.filter(found, lambda w: w["confidence"].isNotNull()), lambda w: w["confidence"])), number)


def median(values: Column) -> Column:
    """The median of an array; null if it is empty."""
    s = F.array_sort(values)
    n = F.size(s)
    low, high = F.get(s, F.floor((n - 1) / 2).cast("int")), F.get(s, F.floor(n / 2).cast("int"))
    return F.when(n > 0, (low + high) / 2)


def confidence_files(spark: SparkSession, root: str) -> DataFrame:
    """(doc_dir, stem, confidence): CONFIDENCES/*.json below folders."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(root)
    path = F.col("path")
    return files.where(path.rlike("/CONFIDENCES/[^/]+$")).select(F.regexp_extract(path, "([^/]+)/CONFIDENCES/[^/]+$", 1).alias("doc_dir"), F.regexp_extract(path, r"([^/]+)\.json$", 1).alias("stem"), confidence_of(decoded(F.col("content"))).alias("confidence"))


@F.pandas_udf(METADATA)
def yaml_metadata(s: pd.Series) -> pd.DataFrame:
    """Title, agency and date under the names that YAML files use for them."""
    import yaml

    names = {"title": ["title", "Title", "titleInfo.title"], "agency": ["agency", "creator", "bureau", "contributor"], "date": ["date", "dateIssued", "date_created", "year"]}

    def one(text):
        try:
            data = yaml.safe_load(text or "")
        except yaml.YAMLError:
            data = None
        data = data if isinstance(data, dict) else {}

        def get(path):
            value = data
            for key in path.split("."):
                value = value.get(key) if isinstance(value, dict) else None
            value = value[0] if isinstance(value, list) and value else value
            return None if value in (None, "", []) else str(value)

        return {k: next((v for v in map(get, paths) if v), None) for k, paths in names.items()}

    return pd.DataFrame([one(t) for t in s], columns=["title", "agency", "date"])


def xml_metadata(xml: Column) -> Column:
    """Title, agency and date of a METS document: MODS names, then Dublin Core, then bare ones; namespaces are dropped."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(xml, r"<\?[^>]*\?>|<!DOCTYPE[^>]*>", ""), r"\sxmlns(?::\w+)?=(?:\"[^\"]*\"|'[^']*')", ""), r"(</?)([\w.-]+):([\w.-]+)", "$1$2_$3")
    bare = F.regexp_replace(bare, r"\s[\w.-]+:([\w.-]+=)", " $1")
    first = lambda *paths: F.coalesce(*[F.nullif(tx.squeeze(F.xpath_string(bare, F.lit(p))), F.lit("")) for p in paths])
    return F.struct(
        first("//mods_titleInfo/mods_title", "//mods_title", "//dc_title", "//title").alias("title"),
        first("//mods_name/mods_namePart", "//mods_namePart", "//dc_creator", "//dc_contributor", "//agency", "//creator").alias("agency"),
        first("//mods_originInfo/mods_dateIssued", "//mods_dateIssued", "//dc_date", "//date", "//dateIssued").alias("date"),
    )


def metadata_files(spark: SparkSession, root: str) -> DataFrame:
    """(doc_dir, title, agency, date): mets.xml, else mets.yaml, of each folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "mets.*").load(root)
    rows = files.select(F.regexp_extract("path", "([^/]+)/mets[.][a-z]+$", 1).alias("doc_dir"), F.regexp_extract("path", r"\.([a-z]+)$", 1).alias("kind"), decoded(F.col("content")).alias("body"))
    xml = rows.where("kind = 'xml'").select("doc_dir", F.lit(0).alias("o"), xml_metadata(F.col("body")).alias("m"))
    yaml = rows.where("kind in ('yaml', 'yml')").select("doc_dir", F.lit(1).alias("o"), yaml_metadata("body").alias("m"))
    return xml.unionByName(yaml).groupBy("doc_dir").agg(F.min_by("m", "o").alias("m")).select("doc_dir", "m.title", "m.agency", "m.date")


def folder_pages(spark: SparkSession, root: str) -> DataFrame:
    """(doc_dir, project_id, doc_id, page, text, confidence): page files in numeric order with their confidences."""
    pages = page_files(spark, root).join(confidence_files(spark, root), ["doc_dir", "stem"], "left")
    at = F.instr("doc_dir", "_")
    project = F.when(at > 0, F.substr(F.col("doc_dir"), F.lit(1), at - 1)).otherwise(F.col("doc_dir"))
    return pages.select("doc_dir", project.alias("project_id"), tx.barcode("doc_dir").alias("doc_id"), "page", "text", "confidence")


def folder_documents(pages: DataFrame) -> DataFrame:
    """(doc_dir, project_id, doc_id, text, pages array<struct<page, start, end, confidence>>): texts joined by form feeds."""
    each = pages.groupBy("doc_dir", "project_id", "doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "text", "confidence"))).alias("ps"))
    kind = "array<struct<page:int,start:int,end:int,confidence:double>>"

    def add(out: Column, p: Column) -> Column:
        start = F.coalesce(F.try_element_at(out, F.lit(-1))["end"] + 1, F.lit(0))
        return F.array_append(out, F.struct(p["page"].alias("page"), start.alias("start"), (start + F.length(p["text"])).alias("end"), p["confidence"].alias("confidence")))

    return each.select("doc_dir", "project_id", "doc_id", F.array_join(F.transform("ps", lambda p: p["text"]), "\f").alias("text"), F.aggregate("ps", F.array().cast(kind), add).alias("pages"))


def ocr_quality(pages: DataFrame, unclear: float = 0.8) -> DataFrame:
    """(doc_id, confidence, unclear): the median of page confidences to 4 places."""
    out = pages.groupBy("doc_id").agg(F.median("confidence").alias("m"))
    return out.select("doc_id", F.round("m", 4).alias("confidence"), F.coalesce(F.col("m") < unclear, F.lit(False)).alias("unclear"))


def chunk_quality(chunks: DataFrame, pages: DataFrame, exclude: float = 0.7) -> DataFrame:
    """(doc_id, chunk_id, confidence, used): the median confidence of a chunk's pages; used if unknown or at least `exclude`."""
    rows = chunks.join(pages.select("doc_id", "page", "confidence"), "doc_id", "left").where(F.col("page").isNull() | F.col("page").between(F.col("first_page"), F.col("last_page")))
    out = rows.groupBy("doc_id", "chunk_id").agg(F.median("confidence").alias("confidence"))
    return chunks.select("doc_id", "chunk_id").join(out, ["doc_id", "chunk_id"], "left").withColumn("used", F.col("confidence").isNull() | (F.col("confidence") >= exclude))

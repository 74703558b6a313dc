"""What the operators share: scratch tables in the shared folder, and rows that pass through Arrow functions whole."""

from __future__ import annotations

import re
import tempfile
import unicodedata
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def latin(kinds: str) -> str:
    """Characters of general categories, up to U+024F, for a character class."""
    return "".join(f"\\U{i:08x}" for i in range(0xA1, 0x250) if unicodedata.category(chr(i))[0] in kinds)


#: Latin letters and numbers for character classes, and texts that hold them, punctuation, tabs and line ends alone.
LETTERS, NUMBERS = "a-zA-Z" + latin("L"), "0-9" + latin("N")
PLAIN = re.compile(r"[\t\n\r\x20-\x7e\u00a1-\u024f]*+")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Set here only where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="docloom-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/docloom/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once to the shared folder and read again: lineage ends here, and a lost executor costs nothing that is stored."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Arrow batches of fewer rows than Spark's default of 10,000, unless the session sets a number of its own: a batch holds whole texts, at once in Spark and in Python."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))


def drop_path(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def packed(docs: DataFrame, text: str = "text") -> DataFrame:
    """(_row: all columns of docs as one struct, _text: the text, null as empty). Columns of any name survive."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"), F.coalesce(docs[f"`{text}`"].cast("string"), F.lit("")).alias("_text"))


def text_map(df: DataFrame, make: Callable[[], Callable[[list[str]], list[list]]], fields: list[T.StructField], text: str = "_text", keep: list[str] | None = None, rows: int = 512) -> DataFrame:
    """Adds columns computed from a text column, batch by batch.

    make() is called once in each task and returns a function from a list of texts to a list of columns.
    The columns in `keep` (all but the text by default) go through unchanged.
    """
    small_batches(df.sparkSession)
    keep = [c for c in df.columns if c != text] if keep is None else keep
    schema = T.StructType([df.schema[c] for c in keep] + fields)
    kinds = [_arrow(f.dataType) for f in fields]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                b = whole.slice(at, rows)
                made = f(["" if t is None else t for t in b.column(text).to_pylist()])
                yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [pa.array(v, k) for v, k in zip(made, kinds, strict=True)], names=keep + names)

    return df.mapInArrow(run, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def long(name: str) -> T.StructField:
    return T.StructField(name, T.LongType())


def double(name: str) -> T.StructField:
    return T.StructField(name, T.DoubleType())


def bounded_sample(labelled: DataFrame, key: str, limit: int) -> DataFrame:
    """At most `limit` rows, those with the smallest hash of the key: the same rows on any cluster."""
    return labelled.orderBy(F.xxhash64(F.col(key)), F.col(key)).limit(limit)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

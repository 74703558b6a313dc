"""The edge to language models and other outside functions: prompts in, responses out, with a replay table.

A client is any object with `call(prompt, model) -> dict(text, input_tokens, output_tokens)`. Prompts are keyed by a
hash; responses that a table holds already are never asked for again, and new ones are stored before anything reads
them, so a task that runs again repeats no stored call.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as tx

RESPONSE = "prompt_hash string, model string, response string, input_tokens long, output_tokens long, error string"
ARROW = pa.schema([("prompt_hash", pa.string()), ("model", pa.string()), ("response", pa.string()), ("input_tokens", pa.int64()), ("output_tokens", pa.int64()), ("error", pa.string())])


class Client(Protocol):
    def call(self, prompt: str, model: str) -> dict: ...


class RetryableError(Exception):
    """A rate limit or a lost connection: worth another try."""


class DryRun:
    """Estimates tokens and answers with a marker, for a run that costs nothing."""

    def call(self, prompt: str, model: str) -> dict:
        return {"text": '{"dry_run": true}', "input_tokens": len(prompt) // 4, "output_tokens": 0}


class Backends:
    """Clients by name; `auto` takes the first whose check says it can be used."""

    def __init__(self):
        self.known: dict[str, tuple[Callable[[], bool], Callable[[], Client]]] = {"dry_run": (lambda: True, DryRun)}

    def register(self, name: str, usable: Callable[[], bool], make: Callable[[], Client]) -> None:
        self.known = {name: (usable, make)} | {k: v for k, v in self.known.items() if k != name}

    def resolve(self, name: str = "auto") -> Callable[[], Client]:
        if name != "auto":
            return self.known[name][1]
        return next(make for usable, make in self.known.values() if usable())


def prompt_hash(prompt: Column, model: Column) -> Column:
    return F.sha2(F.concat_ws("\x00", model, prompt), 256)


def filled(template: str, **fields: Column) -> Column:
    """A prompt: the template with each {name} replaced by a column."""
    out = F.lit(template)
    for name, c in fields.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(c.cast("string"), F.lit("")))
    return out


def asked(prompts: DataFrame, make: Callable[[], Client], tries: int = 3, wait: float = 1.0) -> DataFrame:
    """RESPONSE of distinct prompts (prompt_hash, prompt, model): a try that can be repeated is, after doubling waits; what fails is an error row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = make()
        for b in batches:
            for row in b.to_pylist():
                out = {"prompt_hash": row["prompt_hash"], "model": row["model"]}
                for k in range(tries):
                    try:
                        got = client.call(row["prompt"], row["model"])
                        out |= {"response": got["text"], "input_tokens": got.get("input_tokens", 0), "output_tokens": got.get("output_tokens", 0), "error": None}
                        break
                    except RetryableError as e:
                        out["error"] = f"{type(e).__name__}: {e}"
                        time.sleep(wait * 2**k if k + 1 < tries else 0)
                    except Exception as e:  # one bad document must not end the batch
                        out["error"] = f"{type(e).__name__}: {e}"
                        break
                yield pa.RecordBatch.from_pylist([out], ARROW)

    return prompts.select("prompt_hash", "prompt", "model").mapInArrow(run, RESPONSE)


def answered(prompts: DataFrame, replay: str | DataFrame, make: Callable[[], Client] | None = None) -> DataFrame:
    """prompts (…, prompt, model) with response, error and parsed (VARIANT).

    replay: a Parquet path, to which new responses are appended first, or a table, which is only read. Without a client
    a prompt that the table does not hold gets the error `not recorded`.
    """
    spark: SparkSession = prompts.sparkSession
    keyed = prompts.withColumn("prompt_hash", prompt_hash(F.col("prompt"), F.col("model")))
    if isinstance(replay, str):
        spark.createDataFrame([], RESPONSE).write.mode("append").parquet(replay)
        if make is not None:
            known = spark.read.schema(RESPONSE).parquet(replay).where("error is null").select("prompt_hash")
            new = keyed.select("prompt_hash", "prompt", "model").dropDuplicates(["prompt_hash"]).join(known, "prompt_hash", "left_anti")
            asked(new, make).write.mode("append").parquet(replay)
        table = spark.read.schema(RESPONSE).parquet(replay)
    else:
        table = replay
    best = table.groupBy("prompt_hash").agg(F.max_by(F.struct("response", "error", "input_tokens", "output_tokens"), F.col("error").isNull()).alias("r"))
    out = keyed.join(best, "prompt_hash", "left").select(*keyed.columns, "r.response", F.when(F.col("r").isNull(), "not recorded").otherwise(F.col("r.error")).alias("error"), "r.input_tokens", "r.output_tokens")
    return out.withColumn("parsed", tx.parsed_json("response"))


def dead_letters(answers: DataFrame) -> DataFrame:
    """Responses that no way of reading could turn into JSON."""
    return answers.where("response is not null and parsed is null").select("prompt_hash", "model", "response")


def mapped(rows: DataFrame, text: str, name: str, kind: str, load: Callable[[], Callable[[list[str]], list]]) -> DataFrame:
    """rows with a column made by an outside model (entities, embeddings, token counts) that is loaded once in each task."""
    from pyspark.sql.pandas.types import to_arrow_type

    schema = rows.select("*", F.lit(None).cast(kind).alias(name)).schema
    arrow = to_arrow_type(schema[name].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model(["" if t is None else t for t in b.column(text).to_pylist()]), arrow)], names=[*b.schema.names, name])

    return rows.mapInArrow(run, schema)

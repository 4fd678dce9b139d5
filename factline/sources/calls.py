"""Calls of slow, costly or random outside functions (hosted models): each key is asked once, and everyone reads the same answer."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from factline.functions.confidence import aggregate
from factline.operators.graph import EDGE, Source, use_checkpoint_dir

Call = Callable[[list[dict]], list]
STATE = ["error", "tries", "asked_at"]


def _tried(call: Call, given: list[dict], tries: int, wait: float) -> tuple[list, str | None, int]:
    """The answers of a batch, the last error if there are none, and how often it was asked."""
    for k in range(1, tries + 1):
        try:
            answers = list(call(given))
            if len(answers) != len(given):
                raise ValueError(f"{len(answers)} answers to {len(given)} keys")
            return answers, None, k
        except Exception as error:  # whatever an outside function raises
            said = f"{type(error).__name__}: {error}"
            if k < tries:
                time.sleep(wait * 2 ** (k - 1))
    return [None] * len(given), said, tries


def call_once(keys: DataFrame, call: Call, answer: str = "string", to: str | None = None, batch: int = 32, tries: int = 3, wait: float = 0.5) -> DataFrame:
    """Every distinct row of keys with the answer of `call`, an outside function that may be slow, fail or answer differently each time.

    call: a list of rows as dicts -> as many answers, of the SQL type `answer`. Keys are dealt out
    by hash and asked in batches within Arrow batches. A batch that fails is asked again after
    wait, 2 * wait, ... seconds, `tries` times in all; then its keys are asked one by one, so
    that one bad key takes no other with it. A key that still fails has a null answer and the error.

    The answers are written to a table before anyone reads them: what is returned reads that table,
    so using it twice asks nothing twice. to: the table's folder. Keys that it holds without an
    error are not asked again, so a run that was stopped goes on, and a later run pays for
    new keys only. Without `to` it lies in the checkpoint folder. If two runs at once ask the same
    key, the earlier answer counts for both. A task that Spark runs again asks its keys again, but only one
    attempt's answers are committed.
    Returns the columns of keys, answer, error, tries and asked_at. Null key fields are values like others.
    """
    spark = keys.sparkSession
    names = keys.columns
    if clash := {"answer", "key", *STATE} & set(names):
        raise ValueError(f"key columns may not be named {sorted(clash)}")
    path = to or f"{use_checkpoint_dir(spark)}/calls-{uuid.uuid4().hex}"
    kind = to_arrow_type(T.DataType.fromDDL(answer))
    fields = f"key string, {', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in keys.schema)}, answer {answer}, error string, tries int, asked_at double"
    key = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in names]), {"ignoreNullFields": "false"}), 256)
    wanted = keys.distinct().withColumn("key", key)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for lo in range(0, len(rows), batch):
                part = rows.slice(lo, batch)
                given = part.select(names).to_pylist()
                answers, said, used = _tried(call, given, tries, wait)
                errors, counts = [said] * len(given), [used] * len(given)
                if said is not None and len(given) > 1:
                    alone = [_tried(call, [g], 1, wait) for g in given]
                    answers, errors, counts = [a[0][0] for a in alone], [a[1] for a in alone], [used + 1] * len(given)
                yield pa.RecordBatch.from_arrays(
                    [part["key"], *(part[c] for c in names), pa.array(answers, kind), pa.array(errors, pa.string()), pa.array(counts, pa.int32()), pa.array([time.time()] * len(given))], ["key", *names, "answer", *STATE]
                )

    def held() -> DataFrame:
        return spark.read.schema(fields).parquet(path)

    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    todo = wanted
    if there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        todo = wanted.join(held().filter("error is null").select("key"), "key", "left_anti")
    todo.select("key", *[F.col(f"`{c}`") for c in names]).repartition("key").mapInArrow(ask, fields).write.mode("append").parquet(path)
    failed = F.col("error").isNotNull()
    first = held().groupBy("key").agg(F.min(F.struct(failed.alias("failed"), "asked_at", "tries", "error", "answer")).alias("_a"))
    rows = wanted.select("key", F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
    return rows.join(first, "key").select("_row.*", "_a.answer", "_a.error", "_a.tries", "_a.asked_at")


def judge_by(call: Call, to: str | None = None, **how) -> Callable[[DataFrame], DataFrame]:
    """A judge for files.judged: call gets rows of question, ground_truth and model_answer and answers with JSON verdicts."""
    return lambda misses: call_once(misses.select("question", "ground_truth", "model_answer"), call, "string", to, **how).withColumnRenamed("answer", "verdict").drop(*STATE)


def confidence_by(prompts: DataFrame, call: Call, how: str = "product", to: str | None = None, **options) -> DataFrame:
    """prompts with token probabilities that a model's function gives (a list of numbers a row), and the confidence made of them."""
    got = call_once(prompts, call, "array<double>", to, **options).withColumnRenamed("answer", "probs")
    return got.select(*prompts.columns, "probs", aggregate(F.col("probs"), how).alias("confidence"), "error")


def call_source(call: Call, n: int | None = None, to: str | None = None, **options) -> Source:
    """A source of candidates for graph.expand, from a function that gets rows of side and value.

    side: head (edges from value), tail (to it) or relation. The function answers with a list of
    dicts head, relation, tail and, if it likes, ord (else the place in the list), of which the
    first n count. With `to`, values are asked once for all runs that name the folder.
    """
    def source(wanted: DataFrame, by: str) -> DataFrame:
        keys = wanted.select(F.lit(by).alias("side"), F.col(by).alias("value"))
        got = call_once(keys, call, "array<struct<head: string, relation: string, tail: string, ord: bigint>>", to, **options)
        some = F.col("answer") if n is None else F.slice("answer", 1, n)
        edges = got.select(F.posexplode(some).alias("at", "e")).select(*[F.trim(f"e.{c}").alias(c) for c in EDGE], F.coalesce("e.ord", "at").cast("bigint").alias("ord"))
        return edges.filter(" and ".join(f"coalesce({c}, '') <> ''" for c in EDGE))

    return source

"""Progress of a run while its result files arrive."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from factline.operators import moments
from factline.schemas import RESULT

ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def results_stream(spark: SparkSession, folder: str, schema: str = RESULT) -> DataFrame:
    """JSON-lines result rows as they are added to a folder."""
    return spark.readStream.schema(schema).json(folder)


def level_progress(results: DataFrame) -> DataFrame:
    """Rows, scored rows and mean score by level so far; the state is one row a level."""
    return results.groupBy("distance").agg(F.count(F.lit(1)).alias("processed"), F.count("accuracy_score").alias("scored"), F.avg("accuracy_score").alias("mean_score"))


def keep_moments(results: DataFrame, path: str, group: list[str], values: tuple[str, ...], flags: tuple[str, ...] = ()):
    """A stream writer that stores moments.moments of each batch; moments.merged adds them up at any time.

    A batch that runs again after a restart takes its own place, so nothing counts twice.
    """
    return results.writeStream.foreachBatch(lambda rows, batch: moments.keep_part(moments.moments(rows, group, values, flags), path, batch))


class _Running(StatefulProcessor):
    """Three numbers a group: rows, scored rows and the sum of scores so far."""

    def __init__(self, group: str, order: list[str], every: int):
        self.group, self.order, self.every = group, order, every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getValueState("sums", "processed long, scored long, total double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        processed, scored, total = self.sums.get() if self.sums.exists() else (0, 0, 0.0)
        got = pd.concat([r[[*self.order, "accuracy_score"]] for r in rows])
        got = got.sort_values(self.order, kind="stable")
        score = got["accuracy_score"].to_numpy(dtype=float, na_value=np.nan)
        n = processed + np.arange(1, len(score) + 1)
        c = scored + np.cumsum(~np.isnan(score))
        s = total + np.cumsum(np.nan_to_num(score))
        if len(n):
            self.sums.update((int(n[-1]), int(c[-1]), float(s[-1])))
        at = n % self.every == 0
        yield pd.DataFrame({self.group: [key[0]] * int(at.sum()), "processed": n[at], "success_pct": 100.0 * c[at] / n[at], "mean_score": np.divide(s[at], c[at], out=np.zeros(int(at.sum())), where=c[at] > 0)})

    def close(self) -> None:
        pass


def running_progress(results: DataFrame, order: list[str], every: int = 10, group: str = "distance") -> DataFrame:
    """The stream's form of stats.running_progress: success rate and mean score at each `every`th row of a group.

    A group's state is three numbers, whatever has passed. Rows of one micro-batch are taken in
    order, so the stream gives what the batch operator gives if files arrive in that order; how many files a
    batch takes bounds what a task holds (maxFilesPerTrigger). It goes on from its checkpoint after a
    restart. Needs the RocksDB state store, which is set here. Append mode. Null groups are a group.
    """
    spark = results.sparkSession
    spark.conf.set(*ROCKS)
    kind = results.schema[group].dataType.simpleString()
    rows = results.select(group, *[c for c in order if c != group], F.col("accuracy_score").cast("double").alias("accuracy_score"))
    return rows.groupBy(group).transformWithStateInPandas(_Running(group, order, every), f"{group} {kind}, processed long, success_pct double, mean_score double", "Append", "None")


def without_repeats(results: DataFrame, time: str, delay: str = "10 minutes", keys: tuple[str, ...] = ("head", "relation", "tail")) -> DataFrame:
    """The first of the rows alike in keys that arrive within `delay` of each other by the column time; older state is dropped.

    A row sent again, as after a restart of the evaluator, does not count twice. Rows later than the
    watermark are still let through if their key is no longer known.
    """
    return results.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))

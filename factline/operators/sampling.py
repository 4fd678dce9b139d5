"""Seeded samples: the same rows on every run and at every parallelism."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factline.functions.text import padded


def draw_key(keys: list[str], seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def sample_rows(rows: DataFrame, n: int, keys: list[str], seed: int = 0) -> DataFrame:
    """Exactly n rows (all if fewer), the least by hash."""
    return rows.withColumn("_k", draw_key(keys, seed)).orderBy("_k", *keys).limit(n).drop("_k")


def sample_by_level(rows: DataFrame, n: int, keys: list[str], seed: int = 0, level: str = "distance") -> DataFrame:
    """n rows of every level, whole levels where there are fewer."""
    w = Window.partitionBy(level).orderBy("_k", *keys)
    return rows.withColumn("_k", draw_key(keys, seed)).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_k", "_n")


def first_rows(rows: DataFrame, n: int, ord_col: str = "ord") -> DataFrame:
    return rows.orderBy(ord_col).limit(n)


def pick_edges(edges: DataFrame, experiments: int, seed: int = 0) -> DataFrame:
    """A target edge for each experiment, drawn without replacement: experiment_id from 0, the edge, its padded name."""
    keys = ["head", "relation", "tail"]
    few = sample_rows(edges.select(*keys).distinct(), experiments, keys, seed)
    place = F.row_number().over(Window.orderBy(draw_key(keys, seed), *keys)) - 1  # one row an experiment
    return few.withColumn("experiment_id", place).select("experiment_id", *keys, padded("ripple_experiment_", F.col("experiment_id")).alias("name"))

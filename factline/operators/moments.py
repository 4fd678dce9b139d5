"""Counts, means and deviations as partial states that are stored a part of a table at a time, and add up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LEVEL_VALUES = tuple(f"{side}_{m}" for m in ("confidence", "accuracy") for side in ("base", "post")) + ("confidence_change", "accuracy_change")


def moments(rows: DataFrame, group: list[str], values: tuple[str, ...], flags: tuple[str, ...] = ()) -> DataFrame:
    """A state a group: its rows; of each value a struct of n, mean and m2 (squared deviations from the mean); of each flag how often it holds.

    Nulls do not count; a null group is a group.
    """
    def state(v: str) -> Column:
        x = F.col(v).cast("double")
        n = F.count(x)
        return F.struct(n.alias("n"), F.coalesce(F.avg(x), F.lit(0.0)).alias("mean"), F.coalesce(F.var_pop(x) * n, F.lit(0.0)).alias("m2")).alias(v)

    return rows.groupBy(*group).agg(F.count(F.lit(1)).alias("rows"), *[state(v) for v in values], *[F.count_if(f).alias(f) for f in flags])


def merged(states: DataFrame, group: list[str], values: tuple[str, ...], flags: tuple[str, ...] = ()) -> DataFrame:
    """The states of the parts of a table as those of the whole, in the same form.

    Deviations are taken from the whole group's mean, so nothing cancels out. A group has as
    many rows as parts; merged states may be stored and merged again.
    """
    w = Window.partitionBy(*group)
    apart = {}
    for v in values:
        n, mean = F.col(f"{v}.n"), F.col(f"{v}.mean")
        centre = F.coalesce(F.try_divide(F.sum(n * mean).over(w), F.sum(n).over(w)), F.lit(0.0))
        apart[f"_{v}"] = F.col(f"{v}.m2") + n * (mean - centre) * (mean - centre)

    def state(v: str) -> Column:
        n = F.sum(f"{v}.n")
        mean = F.coalesce(F.try_divide(F.sum(F.col(f"{v}.n") * F.col(f"{v}.mean")), n), F.lit(0.0))
        return F.struct(n.alias("n"), mean.alias("mean"), F.sum(f"_{v}").alias("m2")).alias(v)

    return states.withColumns(apart).groupBy(*group).agg(F.sum("rows").alias("rows"), *[state(v) for v in values], *[F.sum(f).alias(f) for f in flags])


def mean_of(value: str) -> Column:
    return F.when(F.col(f"{value}.n") > 0, F.col(f"{value}.mean"))


def deviation_of(value: str, sample: bool = True) -> Column:
    """Of the sample (null below two values) or of the population (null without values)."""
    return F.sqrt(F.try_divide(f"{value}.m2", F.expr(f"nullif({value}.n - {int(sample)}, 0)").cast("double")))


def keep_part(states: DataFrame, path: str, part: str | int) -> None:
    """Store the states of one part; a part that comes again takes its own place and is not counted twice."""
    states.write.mode("overwrite").parquet(f"{path}/part={part}")


def kept_parts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("part")


def level_states(detail: DataFrame, *part: str) -> DataFrame:
    """The states from which compare.level_summary's figures follow."""
    return moments(detail, ["distance", *part], LEVEL_VALUES, ("introduced",))


def level_summary(states: DataFrame) -> DataFrame:
    """compare.level_summary, from the states of any number of parts, in any order."""
    whole = merged(states, ["distance"], LEVEL_VALUES, ("introduced",))
    figures = [c for v in LEVEL_VALUES for c in (mean_of(v).alias(f"{v}_mean"), deviation_of(v).alias(f"{v}_std"))]
    return whole.select("distance", F.col("rows").alias("triplet_count"), *figures, F.col("introduced").alias("introduced_count"), (F.col("introduced") / F.col("rows")).alias("introduced_rate"))

"""Lineage cuts and distributed numbering shared by the operators."""

from __future__ import annotations

import gc
import itertools
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SMALL, HOT = 20_000, 500  # rows of a table, and of one of its keys, under which no key is worth keeping apart
FREE = 6
_ROW_BITS = 33  # monotonically_increasing_id keeps the partition above this bit


def use_checkpoint_dir(spark: SparkSession) -> None:
    """Take the shared folder that the session names in spark.checkpoint.dir; a local one only on one machine, where none is set."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="factline-"))


_cuts = itertools.count(1)


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the checkpoint folder, so that later jobs neither recompute nor renumber it.

    The shuffles behind it are done with then, but Spark deletes their files only when the
    driver collects garbage, which a driver with little to do puts off. So each FREE-th cut
    asks for it, and the files of long iterations do not pile up on the executors' disks.
    """
    use_checkpoint_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    if next(_cuts) % FREE == 0:
        free(df.sparkSession)
    return out


def free(spark: SparkSession) -> None:
    """Let Spark delete the files of shuffles that nothing needs any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession, size: int = 1 << 22) -> None:
    """From now on batches of rows for Python hold so many bytes, or one long row, unless the session has a bound of its own.

    By itself Spark bounds their rows only: 10,000 texts are tens of megabytes, in the JVM and in the Python worker of every task.
    """
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, size)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ordered_index(df: DataFrame, keys: list[str | Column], out: str) -> DataFrame:
    """Add the gapless 0-based position of each row in the total order of keys.

    Rows are range-partitioned and sorted, so a hot key only spreads over neighbouring
    partitions; the one table that is broadcast has a row per shuffle partition.
    Rows equal on all keys get neighbouring positions in any order.
    """
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    n = shuffle_partitions(df.sparkSession)
    placed = cut(df.repartitionByRange(n, *cols).sortWithinPartitions(*cols).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", _ROW_BITS)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    row = F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .withColumn(out, F.col("_before") + row)
        .drop("_part", "_before", "_at")
    )


def hot_keys(rows: DataFrame, keys: list[str]) -> DataFrame | None:
    """The keys of more than HOT rows and of a quarter of a shuffle partition's fair share; None if there are none.

    There are fewer than four a partition, so they may be broadcast. Tables of up to SMALL rows
    have none: they make one small task at most. rows should be materialised.
    """
    n = rows.count()
    if n <= SMALL:
        return None
    least = max(n // (4 * shuffle_partitions(rows.sparkSession)), HOT)
    hot = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > least).select(*keys).coalesce(1)
    return cut(hot) if hot.limit(1).count() else None


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], hot: DataFrame | None) -> DataFrame:
    """rows joined (inner, on keys) with one row a group, without a hot key's rows meeting in one task.

    hot: hot_keys of rows. Their groups are broadcast, and only the others' rows are shuffled.
    """
    if hot is None:
        return rows.join(groups, keys)
    few = F.broadcast(groups.join(F.broadcast(hot), keys))
    return rows.join(few, keys).unionByName(rows.join(F.broadcast(hot), keys, "left_anti").join(groups.join(F.broadcast(hot), keys, "left_anti"), keys))


def id_number(docs: DataFrame, id_col: str) -> Column:
    """The id as a bigint, null for null: whole numbers as they are, any other id by 64 bits of its text's hash."""
    whole = docs.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long")
    return F.col(id_col).cast("long") if whole else F.when(F.col(id_col).isNotNull(), F.xxhash64(F.col(id_col).cast("string")))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared checkpoint folder, for what is too large to checkpoint row-wise."""
    use_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def place_in_files(df: DataFrame) -> Column:
    """The place of each row of a table in the order in which it was written, as a bigint with gaps.

    Part and file number come from the files' names, the rest is the row's index in its file.
    Readers may pack the files in any order. Of what is not read from files, the scan's order.
    """
    try:
        df.select("_metadata.file_name", "_metadata.row_index").schema  # noqa: B018
    except AnalysisException:
        return F.monotonically_increasing_id()
    name = F.col("_metadata.file_name")
    part, file = (F.coalesce(F.regexp_extract(name, p, 1).try_cast("long"), F.lit(0)) for p in (r"^part-(\d+)", r"-c(\d+)\."))
    return F.shiftleft(part, _ROW_BITS + 10) + F.shiftleft(file, _ROW_BITS) + F.col("_metadata.row_index")

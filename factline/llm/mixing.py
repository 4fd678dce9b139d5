"""Pfair interleaving of sources to target weights: DataFrame operations, and one heap of blocks in the driver."""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factline.llm.tables import ordered_index

SMALL = 1 << 16  # as many sources are broadcast


def edf_blocks(weights: list[float], blocks: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The whole schedule: the source and the slot of every block, in the order in which they run.

    Block j of a source with share w of the weights is released at floor(j / w) and due by
    ceil((j + 1) / w); each slot runs the released block that is due first. Shares are exact
    fractions of the given floats, so windows do not drift. The blocks of a source that has run
    out are not there; where no block is released, time goes on to the next release. Sources of
    weight 0 follow after all others, in equal shares. One step of a heap a block, in the
    driver, which keeps 12 bytes a block.
    """
    if last := [k for k, w in enumerate(weights) if w == 0]:
        which, slots = edf_blocks([w for w in weights if w], [b for w, b in zip(weights, blocks, strict=True) if w])
        after, more = edf_blocks([1.0] * len(last), [blocks[k] for k in last])
        live = np.array([k for k, w in enumerate(weights) if w], np.int32)
        return np.r_[live[which], np.array(last, np.int32)[after]], np.r_[slots, more + (slots[-1] + 1 if len(slots) else 0)]
    exact = [Fraction(w) for w in weights]
    unit = math.lcm(1, *(x.denominator for x in exact))
    parts = [int(x * unit) for x in exact]
    whole = sum(parts)
    n = sum(blocks)
    which, slots = np.empty(n, np.int32), np.empty(n, np.int64)
    ready = [(-(-whole // a), k) for k, a in enumerate(parts) if blocks[k]]
    heapq.heapify(ready)
    waiting: list[tuple[int, int, int]] = []  # release, due, source
    done = [0] * len(parts)
    t = 0
    for at in range(n):
        if not ready:
            t = max(t, waiting[0][0])
        while waiting and waiting[0][0] <= t:
            heapq.heappush(ready, heapq.heappop(waiting)[1:])
        k = heapq.heappop(ready)[1]
        which[at], slots[at] = k, t
        done[k] = j = done[k] + 1
        if j < blocks[k]:
            heapq.heappush(waiting, (j * whole // parts[k], -(-(j + 1) * whole // parts[k]), k))
        t += 1
    return which, slots


def pfair_schedule(docs: DataFrame, weights: dict | None = None, block_rows: int = 16, temper: float = 0.7, seed: str = "factline", source_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Place all rows so that every prefix follows the target weights to less than one block.

    Rows of a source are shuffled by a seeded hash and packed into blocks of `block_rows`, whose
    slots edf_blocks finds from the true weights. The schedule is joined by source and block.
    When a source runs out, its slots are skipped or taken by blocks that are released, and the
    others keep their relative weights. Every row comes out exactly once.

    weights: source -> weight, 0 or more; by default count ** temper. Sources without a weight
    raise ValueError. Any number of sources will do: the driver holds one row a source, and one
    step a block of the schedule. Returns id, source, fp (hash of the whole row), block, slot
    and mix_order (gapless from 0).

    Nulls: a null source is a source; a null id or text hashes as empty. Repeated rows are all
    kept. An empty table gives no rows.
    """
    spark = docs.sparkSession
    kind = docs.schema[source_col].dataType.simpleString()
    counts = {r["s"]: r["n"] for r in docs.groupBy(F.col(source_col).alias("s")).agg(F.count(F.lit(1)).alias("n")).toLocalIterator()}
    weights = {s: n**temper for s, n in counts.items()} if weights is None else weights
    if missing := [s for s in counts if s not in weights]:
        raise ValueError(f"no weight for {missing[:5]}")
    if wrong := [s for s in counts if not 0 <= weights[s] < math.inf]:
        raise ValueError(f"weights must be finite and not negative: {wrong[:5]}")
    light = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), row_hash(docs).alias("fp"),
        F.md5(F.concat_ws(":", F.lit(seed), F.col(id_col).cast("string"))).alias("h"),
    )
    if not counts:
        return light.limit(0).select("id", "source", "fp", *[F.lit(0).cast("long").alias(n) for n in ("block", "slot", "mix_order")])
    names = sorted(counts, key=lambda s: (s is None, str(s)))
    which, slots = edf_blocks([weights[s] for s in names], [-(-counts[s] // block_rows) for s in names])
    table = _blocks(spark, which, slots)
    known = spark.createDataFrame([(k, s) for k, s in enumerate(names)], f"k int, s {kind}")

    ranked = ordered_index(light, ["source", "h", "fp"], "i")
    firsts = ranked.groupBy(F.col("source").alias("s0")).agg(F.min("i").alias("first"))
    sources = firsts.join(known, F.col("s0").eqNullSafe(F.col("s"))).select("k", "s", "first")
    sources = F.broadcast(sources) if len(names) <= SMALL else sources  # more are joined, with the same result
    blocks = ranked.join(sources, F.col("source").eqNullSafe(F.col("s"))).withColumn("block", F.expr(f"(i - first) div {block_rows}"))
    placed = blocks.join(table, (F.col("k") == F.col("tk")) & (F.col("block") == F.col("j")))
    return ordered_index(placed.select("id", "source", "fp", "block", "slot", "i"), ["slot", "i"], "mix_order").drop("i")


def _blocks(spark: SparkSession, which: np.ndarray, slots: np.ndarray) -> DataFrame:
    """The schedule as a table: tk (index of the source), j (block of the source), slot."""
    order = np.argsort(which, kind="stable")
    k = which[order]
    j = np.arange(len(k)) - np.searchsorted(k, k)
    return spark.createDataFrame(pa.table({"tk": pa.array(k), "j": pa.array(j), "slot": pa.array(slots[order])}))


def row_hash(docs: DataFrame):
    return F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])


def pfair_mix(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of docs, unchanged, sorted by their place in pfair_schedule (see there).

    The schedule is joined back by id and row hash; identical rows are numbered on both sides.
    """
    same = Window.partitionBy("_id", "_fp").orderBy(F.lit(0))
    place = pfair_schedule(docs, id_col=id_col, **options).select(F.xxhash64("id").alias("_pid"), F.col("fp").alias("_pfp"), F.col("mix_order").alias("_order"))
    place = place.withColumn("_pn", F.row_number().over(Window.partitionBy("_pid", "_pfp").orderBy("_order")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.xxhash64(F.col(id_col)).alias("_id"), row_hash(docs).alias("_fp"))
    rows = rows.withColumn("_n", F.row_number().over(same))
    # the copy's number is compared by difference, so that the join keeps the windows' partitioning
    on = (F.col("_id") == F.col("_pid")) & (F.col("_fp") == F.col("_pfp")) & (F.col("_n") - F.col("_pn") == 0)
    return rows.join(place, on).orderBy("_order").select("_row.*")


#: Earliest deadline first, a slot a step of the recursion; the default weights of op8 as whole numbers (a double of 1 or more times 2^52 is one).
ORACLE = r"""
WITH RECURSIVE c AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
s AS (
  SELECT source, row_number() OVER (ORDER BY source NULLS LAST) AS k, (n + 15) // 16 AS blocks, CAST(power(n, 0.7::DOUBLE) * 4503599627370496 AS HUGEINT) AS w FROM c),
a AS (SELECT list(w ORDER BY k) AS ws, list(blocks ORDER BY k) AS bs, list_reduce(list(w ORDER BY k), lambda x, y: x + y) AS whole, count(*) AS n FROM s),
edf AS (
  SELECT CAST(-1 AS BIGINT) AS slot, CAST(NULL AS BIGINT) AS k, CAST(NULL AS BIGINT) AS block, list_transform(bs, lambda b: CAST(0 AS BIGINT)) AS done FROM a WHERE n > 0
  UNION ALL
  SELECT slot, pick.k, done[pick.k], list_transform(done, lambda d, i: d + CAST(i = pick.k AS BIGINT))
  FROM (
    SELECT slot, done, list_sort(list_transform(list_filter(jobs, lambda x: x.release <= slot), lambda x: {'due': x.due, 'k': x.k}))[1] AS pick
    FROM (
      SELECT greatest(slot + 1, CAST(list_min(list_transform(jobs, lambda x: x.release)) AS BIGINT)) AS slot, done, jobs
      FROM (
        SELECT e.slot, e.done, list_transform(
          list_filter(range(1, n + 1), lambda k: e.done[k] < bs[k]),
          lambda k: {'release': e.done[k] * whole // ws[k], 'due': ((e.done[k] + 1) * whole + ws[k] - 1) // ws[k], 'k': k}) AS jobs
        FROM edf e, a)
      WHERE len(jobs) > 0))),
d AS (
  SELECT doc_id, source, (row_number() OVER (PARTITION BY source ORDER BY md5('factline' || coalesce(':' || CAST(doc_id AS VARCHAR), ''))) - 1) AS r FROM documents),
m AS (SELECT d.doc_id, d.source, d.r // 16 AS block, d.r, e.slot FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source JOIN edf e ON e.k = s.k AND e.block = d.r // 16)
SELECT doc_id, source, CAST(block AS BIGINT) AS block, slot, row_number() OVER (ORDER BY slot, r) - 1 AS mix_order FROM m
"""

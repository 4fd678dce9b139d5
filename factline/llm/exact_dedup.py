"""Exact dedup: counting quotient filters propose, bytes decide."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factline.llm.tables import cut, hot_keys, join_groups

SPACES = bytes([0x20, *range(0x09, 0x0E)])
BROADCAST_KEYS = 500_000  # at most 8 bytes each: 4 MB


class CountingQuotientFilter:
    """64-bit fingerprints as quotient and remainder, with counters.

    Remainders lie sorted within the run of their quotient, so filters merge losslessly by laying
    their runs together; `ends` holds where each occupied quotient's run ends.
    """

    def __init__(self, quotients: np.ndarray, ends: np.ndarray, remainders: np.ndarray, counts: np.ndarray, bits: int):
        self.quotients, self.ends, self.remainders, self.counts, self.bits = quotients, ends, remainders, counts, bits

    @classmethod
    def of(cls, prints: np.ndarray, bits: int, counts: np.ndarray | None = None) -> CountingQuotientFilter:
        """prints: uint64 in any order; bits: length of the quotient."""
        order = np.argsort(prints, kind="stable")
        return cls.sorted(prints[order], np.ones(len(prints), np.int64) if counts is None else counts[order], bits)

    @classmethod
    def sorted(cls, prints: np.ndarray, counts: np.ndarray, bits: int) -> CountingQuotientFilter:
        first = np.flatnonzero(np.r_[True, prints[1:] != prints[:-1]][: len(prints)])
        prints, counts = prints[first], np.add.reduceat(counts, first) if len(first) else counts
        shift = np.uint64(64 - bits)
        of = prints >> shift
        starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]][: len(of)])
        return cls(of[starts], np.r_[starts[1:], len(prints)][: len(starts)], prints & ((np.uint64(1) << shift) - np.uint64(1)), counts, bits)

    def prints(self) -> np.ndarray:
        runs = np.diff(np.r_[0, self.ends])
        return (np.repeat(self.quotients, runs) << np.uint64(64 - self.bits)) | self.remainders

    def merge(self, other: CountingQuotientFilter) -> CountingQuotientFilter:
        """Both filters' counters in one, without loss: the sorted sides are laid together, not sorted again."""
        mine, theirs = self.prints(), other.prints()
        at = np.searchsorted(mine, theirs) + np.arange(len(theirs))
        prints, counts = np.empty(len(mine) + len(theirs), np.uint64), np.empty(len(mine) + len(theirs), np.int64)
        rest = np.ones(len(prints), bool)
        rest[at] = False
        prints[at], counts[at], prints[rest], counts[rest] = theirs, other.counts, mine, self.counts
        return self.sorted(prints, counts, self.bits)

    def count(self, fingerprint: int) -> int:
        q = fingerprint >> (64 - self.bits)
        k = int(np.searchsorted(self.quotients, np.uint64(q)))
        if k == len(self.quotients) or int(self.quotients[k]) != q:
            return 0
        lo, hi = (int(self.ends[k - 1]) if k else 0), int(self.ends[k])
        r = np.uint64(fingerprint & ((1 << (64 - self.bits)) - 1))
        at = lo + int(np.searchsorted(self.remainders[lo:hi], r))
        return int(self.counts[at]) if at < hi and self.remainders[at] == r else 0

    def blocks(self) -> Iterator[tuple[int, bytes, bytes]]:
        """One (quotient, remainders, counts) for each run."""
        lo = 0
        for q, hi in zip(self.quotients.tolist(), self.ends.tolist(), strict=True):
            yield q, self.remainders[lo:hi].tobytes(), self.counts[lo:hi].tobytes()
            lo = hi


def _normal(text: bytes | None) -> bytes:
    return (text or b"").translate(None, SPACES)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shas = [hashlib.sha256(_normal(t)).digest() for t in batch["raw"].to_pylist()]
        prints = np.frombuffer(b"".join(s[:8] for s in shas), ">u8").astype(np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch["id"], batch["n_cp"], pa.array(prints), pa.array([s.hex() for s in shas], pa.string())], ["id", "n_cp", "fp", "sha"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [_normal(t) for t in batch["raw"].to_pylist()]
        shas = [hashlib.sha256(t).digest() for t in texts]
        prints = np.frombuffer(b"".join(s[:8] for s in shas), ">u8").astype(np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(prints), pa.array([s.hex() for s in shas], pa.string()), pa.array(texts, pa.binary())], ["fp", "sha", "norm"])


def repeated_fingerprints(prints: DataFrame, rows: int) -> DataFrame:
    """Fingerprints (long column fp) seen more than once, by merging a filter of each partition.

    The quotient's length follows the row count, so that a merged run holds about 2^14
    fingerprints at any size; a hot fingerprint is one counter in each partition's filter.
    """
    bits = max(4, min(40, (max(rows, 1) - 1).bit_length() - 14))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[CountingQuotientFilter] = []  # each over twice as large as the next, so a fingerprint is merged log n times
        for batch in batches:
            parts.append(CountingQuotientFilter.of(batch["fp"].to_numpy(zero_copy_only=False).view(np.uint64), bits))
            while len(parts) > 1 and len(parts[-2].counts) <= 2 * len(parts[-1].counts):
                parts[-2:] = [parts[-2].merge(parts[-1])]
        if parts:
            whole = functools.reduce(CountingQuotientFilter.merge, reversed(parts))
            q, r, c = zip(*whole.blocks(), strict=True) if len(whole.quotients) else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(r, pa.binary()), pa.array(c, pa.binary())], ["q", "rems", "counts"])

    def merge(table: pa.Table) -> pa.Table:
        rems = np.frombuffer(b"".join(table["rems"].to_pylist()), np.uint64)
        counts = np.frombuffer(b"".join(table["counts"].to_pylist()), np.int64)
        q = np.uint64(table["q"][0].as_py())
        whole = CountingQuotientFilter.of((q << np.uint64(64 - bits)) | rems, bits, counts)
        return pa.table({"fp": whole.prints()[whole.counts > 1].view(np.int64)})

    runs = prints.select("fp").mapInArrow(build, "q long, rems binary, counts binary")
    return runs.groupBy("q").applyInArrow(merge, "fp long")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Group the rows whose texts are equal once ASCII white space is deleted.

    Each partition's fingerprints fill a counting quotient filter; merged filters give the
    fingerprints counted more than once, and only texts with those are grouped by their bytes.
    Of equal texts the row with the most code points, then the smallest id, stays. Returns id,
    keep_id, group_size, kept, text_sha256: one row per input row.

    Ids may be of any type that can be ordered. The rows of a hot group are joined by broadcast.

    Nulls: a null text equals an empty one; a null id sorts after all others. Of rows alike in
    id and text exactly one is kept. An empty table gives no rows; extra columns are not read.
    """
    raw = docs.select(F.col(id_col).alias("id"), F.coalesce(F.length(text_col), F.lit(0)).alias("n_cp"), F.col(text_col).cast("binary").alias("raw"))
    kind = docs.schema[id_col].dataType.simpleString()
    features = raw.mapInArrow(_features, f"id {kind}, n_cp int, fp long, sha string")
    features = cut(features.withColumn("at", F.monotonically_increasing_id()))
    again = cut(repeated_fingerprints(features, features.count()))
    few = again.count() <= BROADCAST_KEYS
    again = F.broadcast(again) if few else again

    texts = raw.select("raw").mapInArrow(_texts, "fp long, sha string, norm binary").join(again, "fp", "left_semi")
    classes = texts.groupBy("fp", "sha", "norm").agg(F.count(F.lit(1)).alias("n"))
    sizes = classes.groupBy(F.col("sha").alias("gsha")).agg(F.sum("n").alias("group_size"), F.count(F.lit(1)).alias("texts"))
    sizes = sizes.select("gsha", F.when(F.col("texts") == 1, F.col("group_size")).otherwise(F.raise_error(F.lit("two texts share a SHA-256"))).cast("long").alias("group_size"))
    copies, alone = features.join(again, "fp", "left_semi"), features.join(again, "fp", "left_anti")
    first = F.min(F.struct((-F.col("n_cp")).alias("size"), F.col("id").isNull().alias("unnamed"), "id", "at"))
    best = copies.groupBy(F.col("sha").alias("bsha")).agg(first.alias("best"))
    groups = cut(sizes.join(best, F.col("gsha") == F.col("bsha")).select(F.col("gsha").alias("sha"), "group_size", "best"))
    grouped = join_groups(copies, groups, ["sha"], hot_keys(copies, ["sha"]))
    some = grouped.select("id", F.col("best.id").alias("keep_id"), "group_size", (F.col("best.at") == F.col("at")).alias("kept"), "sha")
    one = alone.select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    return some.unionByName(one).select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


ORACLE = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm, length(coalesce(text, '')) AS n FROM documents),
r AS (SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM r
"""

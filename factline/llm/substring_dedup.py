"""Substring dedup by difference-cover anchors over words."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factline.llm import words as w
from factline.llm.bitmaps import bitmap_of
from factline.llm.tables import cut, written

NO_ID = (1 << 63) - 1
_SECOND = 24  # bits of the second hash in a window's name


def difference_cover(period: int) -> list[int]:
    """A small set whose differences modulo the period give every residue (greedy)."""
    cover, missing = [0, 1], set(range(period)) - {0, 1, period - 1}
    while missing:
        best = max(range(period), key=lambda x: (len({d for c in cover for d in ((x - c) % period, (c - x) % period)} & missing), -x))
        cover.append(best)
        missing -= {d for c in cover for d in ((best - c) % period, (c - best) % period)}
    return sorted(cover)


def plan(window: int) -> tuple[int, list[int], int]:
    """Period, cover and anchor length for a window: two equal windows share an aligned anchor.

    For word positions i and j there is a shift under the period at which both fall on cover
    positions, so the anchor, of window - period + 1 words, lies in both windows.
    """
    #: Perfect difference sets, by period.
    perfect = {7: [0, 1, 3], 13: [0, 1, 3, 9], 31: [0, 1, 3, 8, 12, 18], 57: [0, 1, 3, 13, 32, 36, 43, 52]}
    period = max([p for p in perfect if p <= 2 * window / 3], default=max(2, window // 2))
    period = min(period, max(1, window))
    cover = perfect.get(period) or (difference_cover(period) if period > 2 else list(range(period)))
    return period, cover, window - period + 1


def _layout(data: np.ndarray, offsets: np.ndarray):
    starts, ends, firsts = w.boundaries(data, offsets)
    return starts, ends, firsts, w.word_hashes(data, starts, ends)


def _whole(firsts: np.ndarray, length: int) -> np.ndarray:
    """For each word index: do `length` words from it on lie in one text? (as many as there are n-grams)"""
    n = int(firsts[-1]) - length + 1
    if n <= 0:
        return np.zeros(0, bool)
    left = np.repeat(firsts[1:], np.diff(firsts))[:n] - np.arange(n)
    return left >= length


def _anchors(hashes: np.ndarray, firsts: np.ndarray, period: int, cover: list[int], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Word index and hash of every anchor; positions count from the start of their text."""
    grams = w.ngram_hashes(hashes, length)
    on = np.zeros(period, bool)
    on[cover] = True
    place = np.arange(len(grams)) - np.repeat(firsts[:-1], np.diff(firsts))[: len(grams)]
    at = np.flatnonzero(_whole(firsts, length) & on[place % period])
    return at, grams[at]


def substring_dedup(docs: DataFrame, window: int = 50, with_text: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove the words of every window that also starts in a document with a smaller id.

    A window is `window` consecutive words of one text, judged on the input.

    1. Anchors (see plan) are hashed at cover positions only, about a fifth of the words.
       Those found under two ids or more go into a bitmap, sized by their number.
    2. A window is a candidate if the bitmap has one of its anchors: both copies of any
       repeated window hold the same aligned anchor. Candidates are extended to the whole
       window, named by 88 bits of two independent hashes of its words, and each window's
       smallest id is found. Anchors let through wrongly cost work only.
    3. Each window is sent to the one document that owns it, so a document removes exactly its
       candidate windows that it does not own. Only documents with candidates are joined.

    Hot passages meet in sums (min per window), before the shuffle; what a document owns is
    bounded by its own words. Rows that share an id are one document, and would own each
    other's windows: those rows get their own shares of what the id owns, by a join on (id,
    window). So no group is ever gathered.
    Returns id, n_words, n_removed, kept_sha256 and, with_text, kept_text (kept words joined by a space).

    Ids must be whole numbers, or strings of such. Nulls: a null text has no words; null ids
    count as one id, 2^63 - 1. Rows that share an id never remove words from each other.
    Empty tables give no rows; extra columns are not read. Very long texts are taken whole.
    """
    period, cover, length = plan(window)
    spark = docs.sparkSession
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("key")
    raw = docs.select(F.col(id_col).alias("id"), key, F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("raw"))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["key"].to_numpy()
            for lo, hi, data, offsets in w.slices(batch):
                _, _, firsts, hashes = _layout(data, offsets)
                at, grams = _anchors(hashes, firsts, period, cover, length)
                of = ids[lo:hi][np.searchsorted(firsts, at, "right") - 1]
                yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(of)], ["h", "key"])

    found = raw.select("key", "raw").mapInArrow(w.tidy(anchors), "h long, key long")
    shared = written(found.groupBy("h").agg(F.min("key").alias("a"), F.max("key").alias("b")).filter("a < b").select("h"))
    bits = spark.sparkContext.broadcast(bitmap_of(shared, shared.count()))

    def candidates(data: np.ndarray, offsets: np.ndarray, known: w.Bitmap):
        """Layout, the word index of each candidate window, and its two hashes."""
        starts, ends, firsts, hashes = _layout(data, offsets)
        at, grams = _anchors(hashes, firsts, period, cover, length)
        hit = np.zeros(len(hashes) + 1, np.int64)
        hit[at[known.has(grams)] + 1] = 1
        sums = np.cumsum(hit)
        whole = _whole(firsts, window)
        marked = whole & (sums[np.minimum(np.arange(len(whole)) + period, len(hashes))] > sums[: len(whole)])
        at = np.flatnonzero(marked)
        if not len(at):
            return starts, ends, firsts, at, at.astype(np.uint64), at.astype(np.uint64)
        other = w.ngram_hashes(w.word_hashes(data, starts, ends, seed=1), window)[at] >> np.uint64(64 - _SECOND)
        return starts, ends, firsts, at, w.ngram_hashes(hashes, window)[at], other

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Candidate windows of every row: their two hashes, the id, and the row (a hash of id and text)."""
        known = w.Bitmap(bits.value)
        for batch in batches:
            ids, rows = batch["key"].to_numpy(), batch["row"].to_numpy()
            for lo, hi, data, offsets in w.slices(batch):
                _, _, firsts, at, h, g = candidates(data, offsets, known)
                of = np.searchsorted(firsts, at, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(g.view(np.int64)), pa.array(ids[lo:hi][of]), pa.array(rows[lo:hi][of])], ["h", "g", "key", "row"])

    raw = raw.withColumn("row", F.xxhash64("id", "raw"))
    several = cut(raw.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("key"))
    fields = "h long, g long, key long, row long"
    owned = raw.select("key", "row", "raw").mapInArrow(w.tidy(windows), fields).groupBy("h", "g").agg(F.min("key").alias("key"))
    name = F.col("h").bitwiseXOR(F.shiftleft("g", 64 - _SECOND)).alias("w")  # within one document

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows without candidates are finished here; the others keep their text for the join."""
        known = w.Bitmap(bits.value)
        for batch in batches:
            for lo, hi, data, offsets in w.slices(batch):
                _, _, firsts, at, _, _ = candidates(data, offsets, known)
                some = (np.diff(np.searchsorted(at, firsts)) > 0).tolist()
                rows = batch["raw"].slice(lo, hi - lo).to_pylist()
                kept = [None if c else b" ".join(t.split()) for t, c in zip(rows, some, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch[c].slice(lo, hi - lo) for c in ("id", "key", "row")),
                        pa.array(np.diff(firsts)),
                        pa.array([None if k is None else hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
                        pa.array([t if c else None for t, c in zip(rows, some, strict=True)], pa.binary()),
                        pa.array(kept if with_text else [None] * len(rows), pa.binary()),
                    ],
                    ["id", "key", "row", "n_words", "sha", "raw", "kept"],
                )

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = w.Bitmap(bits.value)
        for batch in batches:
            gone, shas, kepts = [], [], []
            for lo, hi, data, offsets in w.slices(batch):
                starts, ends, firsts, at, h, g = candidates(data, offsets, known)
                names = (h ^ (g << np.uint64(64 - _SECOND))).view(np.int64)
                cuts = np.searchsorted(at, firsts)
                for k in range(hi - lo):
                    if (sha := batch["sha"][lo + k].as_py()) is not None:
                        gone.append(0), shas.append(sha), kepts.append(batch["kept"][lo + k].as_py())
                        continue
                    own = batch["own"][lo + k].values
                    own = np.zeros(0, np.int64) if own is None else own.to_numpy(zero_copy_only=False)
                    mine, f = slice(cuts[k], cuts[k + 1]), int(firsts[k])
                    cover = at[mine][~np.isin(names[mine], own)] - f
                    n = int(firsts[k + 1]) - f
                    edge = np.bincount(cover, minlength=n + 1) - np.bincount(cover + window, minlength=n + 1)[: n + 1]
                    keep = np.cumsum(edge)[:n] == 0
                    text = data[offsets[k] : offsets[k + 1]].tobytes()
                    kept = b" ".join(x for x, c in zip(text.split(), keep.tolist(), strict=True) if c)
                    gone.append(n - int(keep.sum())), shas.append(hashlib.sha256(kept).hexdigest()), kepts.append(kept if with_text else None)
            yield pa.RecordBatch.from_arrays([batch["id"], batch["n_words"], pa.array(gone, pa.int64()), pa.array(shas, pa.string()), pa.array(kepts, pa.binary())], ["id", "n_words", "n_removed", "sha", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = raw.mapInArrow(w.tidy(texts), f"id {kind}, key long, row long, n_words long, sha string, raw binary, kept binary")
    shared_ids = several.limit(1).count() > 0
    single = owned.join(several, "key", "left_anti") if shared_ids else owned
    single = single.groupBy("key").agg(F.collect_list(name).alias("own"))
    out = rows.join(single, "key", "left")
    if shared_ids:
        rows = written(rows)
        theirs = raw.join(several, "key", "left_semi").select("key", "row", "raw").mapInArrow(w.tidy(windows), fields)
        theirs = theirs.distinct().join(owned, ["h", "g", "key"]).groupBy("row").agg(F.collect_list(name).alias("own"))
        out = rows.join(several, "key", "left_anti").join(single, "key", "left")
        out = out.unionByName(rows.join(several, "key", "left_semi").join(theirs, "row", "left"))
    out = out.select("id", "n_words", "sha", "raw", "kept", "own").mapInArrow(w.tidy(removed), f"id {kind}, n_words long, n_removed long, sha string, kept binary")
    text = [F.col("kept").cast("string").alias("kept_text")] if with_text else []
    return out.select(F.col("id").alias(id_col), "n_words", "n_removed", F.col("sha").alias("kept_sha256"), *text)

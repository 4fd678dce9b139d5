"""Periodic runs of words: stretches that repeat with a period, found by comparing a text with every shift of itself."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factline.llm import words as w
from factline.llm.tables import written

NONE = np.zeros((0, 3), np.int64)


@dataclass(frozen=True)
class Rule:
    """A run has at least min_exp periods and min_words words."""

    min_words: int = 12
    min_exp: int = 2

    def least(self, lag: int) -> int:
        """How many consecutive words must equal the word `lag` after them."""
        return max(self.min_words - lag, (self.min_exp - 1) * lag, 1)

    def classes(self, n: int) -> list[tuple[int, int, int]]:
        """Lags up to n / min_exp in doublings: first, last, and the least stretch of any of them."""
        top = min(n // self.min_exp, n - self.min_words + self.min_exp * self.min_words)
        out, lo = [], 1
        while lo <= top:
            hi = min(2 * lo - 1, top)
            out.append((lo, hi, min(self.least(q) for q in {lo, hi, min(max(self.min_words // self.min_exp, lo), hi)})))
            lo = 2 * lo
        return out


def live_lags(hashes: np.ndarray, rule: Rule) -> list[tuple[int, int]]:
    """The classes of lags in which a run may lie.

    A run of lag q starts with a stretch of words that stands again q words later; where no
    stretch of the class's least length stands twice within the class's reach there is none.
    """
    out = []
    for lo, hi, size in rule.classes(len(hashes)):
        grams = w.ngram_hashes(hashes, size)
        order = np.argsort(grams, kind="stable")
        same = grams[order[1:]] == grams[order[:-1]]
        if (order[1:] - order[:-1])[same].min(initial=hi + 1) <= hi:
            out.append((lo, hi))
    return out


def scan(ids: np.ndarray, lo: int, hi: int, rule: Rule) -> np.ndarray:
    """Start, length and lag of the longest stretches of each lag from lo to hi that are long enough to be runs."""
    out = []
    for lag in range(lo, hi + 1):
        least = rule.least(lag)
        same = ids[:-lag] == ids[lag:]
        # of any `least` consecutive places one is a multiple of it
        if len(same) < least or not same[least - 1 :: least].any():
            continue
        edges = np.flatnonzero(np.diff(same, prepend=False, append=False))
        starts, ends = edges[::2], edges[1::2]
        long = ends - starts >= least
        if long.any():
            out.append(np.stack([starts[long], ends[long] - starts[long] + lag, np.full(int(long.sum()), lag)], 1))
    return np.concatenate(out) if out else NONE


def smallest_periods(found: np.ndarray) -> np.ndarray:
    """Of a stretch found at several lags the smallest counts: the others are its multiples. Sorted by start, then period."""
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    first = np.ones(len(found), bool)
    first[1:] = (found[1:, :2] != found[:-1, :2]).any(1)
    found = found[first]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def word_ids(text: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = {}
    return np.array([known.setdefault(x, len(known)) for x in text], np.int32)


def collapsed(text: list[bytes], runs: np.ndarray) -> bytes:
    """The words that lie in no run, or in the first period of every run that holds them."""
    edge = np.zeros(len(text) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return b" ".join(x for x, c in zip(text, np.cumsum(edge[:-1]).tolist(), strict=True) if not c)


def _repeats(hashes: np.ndarray, firsts: np.ndarray, size: int) -> np.ndarray:
    """For each text: does any stretch of `size` words stand twice in it?"""
    out = np.zeros(len(firsts) - 1, bool)
    grams = w.ngram_hashes(hashes, size)
    if not len(grams):
        return out
    of = np.repeat(np.arange(len(out)), np.diff(firsts))
    inside = of[: len(grams)] == of[size - 1 :]
    of = of[: len(grams)][inside]
    with np.errstate(over="ignore"):
        named = grams[inside] ^ (of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(named)
    twice = named[order[1:]] == named[order[:-1]]
    out[of[order[1:][twice]]] = True
    return out


RUNS = "array<struct<start: long, length: long, period: long>>"
_RUN = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))


def _run_lists(rows: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate([NONE, *rows])
    offsets = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"])).cast(_RUN)


def periodic_runs(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text", cells: int = 1 << 25) -> DataFrame:
    """All maximal periodic runs of words of every text, and the text with each run collapsed to its first period.

    A run is a stretch with smallest period q, of max(min_words, min_exp * q) words or more, that no
    neighbouring word extends keeping period q. Words are runs without ASCII white space, case counts.

    The word ids are compared with themselves shifted by every lag up to n / min_exp, and true
    stretches are run-length coded. Two things leave out lags without leaving out runs: a text in
    which no shortest stretch stands twice has none, and neither has a class of lags (a
    doubling) in which no stretch of its least length stands twice near enough; both look at
    hashes, which may only let too much through. A text whose live lags ask for more than `cells`
    comparisons is not scanned in place: its lags are cut into ranges of about that many, which Spark
    deals out over the machines, each with the text, and the runs found meet again by text. These are
    fewer than the text's words.

    Returns id, n_words, runs (start, length and period in words, by start, then period),
    collapsed (the kept words joined by a space). Nulls: a null text has no words; ids, null ones too,
    are only carried. Empty texts have no runs and collapse to nothing. Repeated rows are all
    returned. Empty tables give no rows; extra columns are not read.
    """
    size = min(rule.least(q) for q in range(1, rule.min_words + 1))

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Finished rows; of those too long to finish here, the text and its ranges of lags."""
        for batch in batches:
            for lo, hi, data, offsets in w.slices(batch):
                starts, ends, firsts = w.boundaries(data, offsets)
                hashes = w.word_hashes(data, starts, ends)
                maybe = _repeats(hashes, firsts, size).tolist()
                runs, kept, todo, raws = [], [], [], []
                for k in range(hi - lo):
                    raw = data[offsets[k] : offsets[k + 1]].tobytes()
                    n = int(firsts[k + 1] - firsts[k])
                    live = live_lags(hashes[firsts[k] : firsts[k + 1]], rule) if maybe[k] else []
                    found, ranges = NONE, None
                    if sum((b - a + 1) * n for a, b in live) > cells:
                        step = max(1, cells // n)
                        ranges = [{"lo": q, "hi": min(q + step - 1, b)} for a, b in live for q in range(a, b + 1, step)]
                    text = raw.split() if ranges is None else []
                    if live and ranges is None:
                        ids = word_ids(text)
                        found = smallest_periods(np.concatenate([scan(ids, a, b, rule) for a, b in live]))
                    runs.append(found), todo.append(ranges), raws.append(None if ranges is None else raw)
                    kept.append(None if ranges is not None else collapsed(text, found) if len(found) else b" ".join(text))
                yield pa.RecordBatch.from_arrays(
                    [batch["id"].slice(lo, hi - lo), pa.array(np.diff(firsts)), _run_lists(runs), pa.array(kept, pa.binary()), pa.array(raws, pa.binary()), pa.array(todo, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))],
                    ["id", "n_words", "runs", "kept", "raw", "ranges"],
                )

    def ranges_scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                one = batch.slice(k, 1).to_pylist()[0]
                found = scan(word_ids(one["raw"].split()), one["lo"], one["hi"], rule)
                yield pa.RecordBatch.from_arrays([pa.array([one["row"]] * len(found), pa.binary()), *(pa.array(found[:, c]) for c in range(3))], ["row", "start", "length", "period"])

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, kept = [], []
            for k in range(len(batch)):
                mine = batch["found"][k].values
                found = NONE if mine is None else smallest_periods(np.stack([mine.field(c).to_numpy() for c in ("start", "length", "period")], 1))
                runs.append(found), kept.append(collapsed(batch["raw"][k].as_py().split(), found))
            yield pa.RecordBatch.from_arrays([batch["id"], batch["n_words"], _run_lists(runs), pa.array(kept, pa.binary())], ["id", "n_words", "runs", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    raw = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b"")).alias("raw"))
    rows = written(raw.mapInArrow(w.tidy(survey), f"id {kind}, n_words long, runs {RUNS}, kept binary, raw binary, ranges array<struct<lo: long, hi: long>>"))
    # equal texts are scanned once, whoever's they are
    long = rows.filter("ranges is not null").withColumn("row", F.unhex(F.sha2("raw", 256)))
    texts = long.groupBy("row").agg(F.first("raw").alias("raw"), F.first("ranges").alias("ranges"))
    dealt = texts.select("row", F.explode("ranges").alias("r"), "raw").select("row", "r.lo", "r.hi", "raw").repartition("row", "lo")
    found = dealt.mapInArrow(ranges_scanned, "row binary, start long, length long, period long")
    found = found.groupBy("row").agg(F.collect_list(F.struct("start", "length", "period")).alias("found"))
    out = long.join(found, "row", "left").select("id", "n_words", "raw", "found").mapInArrow(w.tidy(finished), f"id {kind}, n_words long, runs {RUNS}, kept binary")
    out = rows.filter("ranges is null").select("id", "n_words", "runs", "kept").unionByName(out)
    return out.select(F.col("id").alias(id_col), "n_words", "runs", F.col("kept").cast("string").alias("collapsed"))


def run_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The id, the number of runs, the longest run (of equals the first, then that of the least period), and digests of all runs and of the collapsed text."""
    keyed = F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p")))
    best = F.array_max(keyed)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"], F.lit(None).cast("string"))), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    out = found.select(id_col, F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = F.col("best.length"), -F.col("best.p")
    return out.select(id_col, "n_runs", (-F.col("best.s")).alias("start"), length.alias("length"), period.alias("period"), F.expr("best.length * 1000 div -best.p").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def folded(docs: DataFrame) -> DataFrame:
    """doc_id and text; the words of one document in ten are folded into a period, as its id's checksum says. Others, and null ids, keep their text."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))

    def of(x: Column) -> Column:
        n, g = F.size(x["words"]), F.floor(x["h"] / 10)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(x["words"], place(i))), " "))

    parts = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda v: v != "")
    turned = F.get(F.transform(F.array(F.struct(parts.alias("words"), h.alias("h"))), of), F.lit(0))
    return docs.select("doc_id", F.when(h % 10 == 0, F.coalesce(turned, "text")).otherwise(F.col("text")).alias("text"))

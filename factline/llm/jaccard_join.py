"""Exact n-gram Jaccard join by a prefix index with block skipping and derived answers."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factline.llm import words as w
from factline.llm.bitmaps import bitmap_of
from factline.llm.components import components
from factline.llm.tables import cut, hot_keys, id_number, join_groups, written

LEAST_BITS, MOST_BITS = 16, 24  # log2 of the cells of the frequency sketch: a byte each in the broadcast, four in a task
_PAGE_BITS = 12
_FAN = 512  # map tasks' pages are summed in this many groups, and then these
_MEMBERS = 256  # pairs verified against one copy of a hub's text


@dataclass(frozen=True)
class Terms:
    """n words a shingle; two sets link when 100 |x & y| >= percent |x | y|."""

    n: int = 4
    percent: int = 85

    def prefix(self, size: int) -> int:
        """How many of a set's first elements must hold one of any set that it links with."""
        return size - -(-self.percent * size // 100) + 1

    def overlap(self, a: Column, b: Column) -> Column:
        """The least |a & b| with which sets of sizes a and b link."""
        whole = 100 + self.percent
        return F.floor(((a + b) * self.percent + whole - 1) / whole)

    def fits(self, a: Column, b: Column) -> Column:
        return (a * 100 >= b * self.percent) & (b * 100 >= a * self.percent)


def sets_of(data: np.ndarray, offsets: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text (with fewer words, of all its words as one)."""
    starts, ends, firsts = w.boundaries(data, offsets)
    hashes = w.word_hashes(data, starts, ends, lower=True)
    grams = w.ngram_hashes(hashes, n)
    for lo, hi in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
        if hi - lo >= n:
            own = np.sort(grams[lo : hi - n + 1])
            yield own[np.r_[True, own[1:] != own[:-1]]]
        elif hi > lo:
            yield w.ngram_hashes(hashes[lo:hi], hi - lo) + np.uint64(hi - lo)  # told apart from a shingle of n
        else:
            yield grams[:0]


def _sig(elements: np.ndarray) -> bytes:
    return hashlib.blake2b(elements.tobytes(), digest_size=16).digest()


def _survey(terms: Terms, bits: int):
    """Per text: size and signature of its set (kind 0); per task: pages of element counts (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.uint32)
        names, id_type = ["kind", "id", "tag", "page", "n", "sig"], None
        for batch in batches:
            id_type = batch["id"].type
            for lo, hi, data, offsets in w.slices(batch):
                sets = list(sets_of(data, offsets, terms.n))
                cells, seen = np.unique((np.concatenate(sets) & np.uint64((1 << bits) - 1)).astype(np.uint32), return_counts=True)
                counts[cells] += seen.astype(np.uint32)
                none = [0] * (hi - lo)
                yield pa.RecordBatch.from_arrays([pa.array(none, pa.int32()), batch["id"].slice(lo, hi - lo), batch["tag"].slice(lo, hi - lo), pa.array(none, pa.int32()), pa.array([len(s) for s in sets], pa.int64()), pa.array([_sig(s) for s in sets], pa.binary())], names)
        pages = counts.reshape(-1, 1 << _PAGE_BITS)
        full = np.flatnonzero(pages.any(1)).tolist()
        if full:
            yield pa.RecordBatch.from_arrays(
                [pa.array([1] * len(full), pa.int32()), pa.nulls(len(full), id_type), pa.nulls(len(full), pa.int64()), pa.array(full, pa.int32()), pa.array([0] * len(full), pa.int64()), pa.array([_packed(pages[k]) for k in full], pa.binary())], names
            )

    return w.tidy(run)


def _packed(page: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest needs (the first byte tells how many)."""
    kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if page.max() <= np.iinfo(t).max)
    return bytes([np.dtype(kind).itemsize]) + zlib.compress(page.astype(kind).tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data[1:]), f"u{data[0]}").astype(np.uint64)


def _sketch(pages: DataFrame, bits: int) -> np.ndarray:
    """Grades of the cells' counts over all tasks, four to a doubling; pages of more than _FAN tasks are summed in a tree of two levels."""

    def merge(table: pa.Table) -> pa.Table:
        total = np.zeros(1 << _PAGE_BITS, np.uint64)
        for b in table["sig"]:
            total += _unpacked(b.as_py())
        return pa.table({"page": table["page"][:1], "sig": pa.array([_packed(total)], pa.binary())})

    out = np.zeros((1 << (bits - _PAGE_BITS), 1 << _PAGE_BITS), np.uint8)
    some = pages.select("page", "sig", F.pmod(F.spark_partition_id(), F.lit(_FAN)).alias("part"))
    if pages.rdd.getNumPartitions() > _FAN:
        some = some.groupBy("page", "part").applyInArrow(merge, "page int, sig binary")
    for row in some.groupBy("page").applyInArrow(merge, "page int, sig binary").toLocalIterator():
        out[row["page"]] = (4 * np.log2(_unpacked(row["sig"]) + 1.0)).astype(np.uint8)
    return out.ravel()


def _prefixes(terms: Terms, sketch: Broadcast, shared: Broadcast | None):
    """Index entries, once for all equal sets of a task. Without `shared`: element and row; with it: entries of shared elements in full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grades = sketch.value
        mask = np.uint64(len(grades) - 1)
        known = shared and w.Bitmap(shared.value)
        seen: set[bytes] = set()
        for batch in batches:
            at = batch["at"].to_numpy()
            for lo, _, data, offsets in w.slices(batch):
                heads, sizes, sigs, rows = [], [], [], []
                for k, s in enumerate(sets_of(data, offsets, terms.n)):
                    if len(s) and (sig := _sig(s)) not in seen:
                        seen.add(sig)
                        heads.append(s[np.argsort(grades[(s & mask).astype(np.int64)], kind="stable")[: terms.prefix(len(s))]])
                        sizes.append(len(s)), rows.append(lo + k)
                        sigs.append(sig)
                if not heads:
                    continue
                lengths = [len(h) for h in heads]
                t, of = np.concatenate(heads), np.repeat(np.arange(len(heads)), lengths)
                if not known:
                    yield pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(at[np.array(rows)[of]])], ["t", "at"])
                    continue
                place = np.arange(len(t)) - np.repeat(np.cumsum([0, *lengths[:-1]]), lengths)
                hit = np.flatnonzero(known.has(t))
                of = of[hit]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(t[hit].view(np.int64)), pa.array(sigs, pa.binary()).take(pa.array(of)), pa.array(at[np.array(rows)[of]]), pa.array(np.array(sizes, np.int64)[of]), pa.array(place[hit])], ["t", "sig", "at", "n", "i"]
                )

    return w.tidy(run)


def _chosen(terms: Terms, wanted: Broadcast):
    """Signature and text of the rows whose signature the bitmap lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = w.Bitmap(wanted.value)
        for batch in batches:
            for lo, hi, data, offsets in w.slices(batch):
                sigs = [_sig(s) for s in sets_of(data, offsets, terms.n)]
                keep = np.flatnonzero(known.has(np.frombuffer(b"".join(s[:8] for s in sigs), ">u8").astype(np.uint64)))
                yield pa.RecordBatch.from_arrays([pa.array(sigs, pa.binary()).take(pa.array(keep)), batch["raw"].slice(lo, hi - lo).take(pa.array(keep))], ["sig", "raw"])

    return w.tidy(run)


def plain_set(text: bytes, n: int) -> set[bytes]:
    """A text's shingles by their words."""
    words = text.translate(w.LOWER.tobytes()).split()
    return {b" ".join(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()


def _verified(terms: Terms):
    """Overlaps, counted by the words themselves, of each hub's set with the sets of the rows that follow it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub: set[bytes] = set()
        for batch in batches:
            rows, common = [], []
            for k, (a, raw) in enumerate(zip(batch["a"], batch["raw"], strict=True)):
                own = plain_set(raw.as_py(), terms.n)
                if a.is_valid:
                    rows.append(k), common.append(len(own & hub))
                else:
                    hub = own
            part = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([part["a"], part["b"], part["na"], part["nb"], pa.array(common, pa.int64())], ["a", "b", "na", "nb", "o"])

    return run


def jaccard_components(docs: DataFrame, terms: Terms = Terms(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Classes of texts joined by links of Jaccard similarity terms.percent / 100 or more.

    Equal sets are one node. Elements are ordered by a count sketch of the whole table, rarest
    first (its cells follow the size of the texts up to 2^24; past that, elements stand out that
    are more frequent than the root of a cell's load), so linked sets share an element among their first few (Terms.prefix); only elements
    that two rows share are indexed. An index list is cut into blocks of similar size, and an
    entry at position i of a set of n is skipped against one at j of m when the elements left
    after both positions cannot make up the overlap that a link needs.

    Round 1 verifies each set against one document only: of the first documents of its entries'
    blocks, the one that it meets most often. Round 2 looks at pairs that are still in
    different classes. Their answers are derived from the verified
    overlaps with a common first document h: with p = |x & h| and q = |y & h|,
    p + q - |h| <= |x & y| <= min(p, q) + min(|x| - p, |y| - q), so only pairs between the
    bounds are verified. No link between different classes is lost, and groups of copies are
    never expanded into pairs. Overlaps are counted by the shingles' words; sets count as equal
    by 128 bits of their elements' hashes.

    Returns id, n_shingles, component_id (least id of the class). Nulls: a null or wordless
    text has an empty set and is a class of its own; a null id takes part and is the class's
    id only if all its ids are null. Repeated rows are all returned. Empty tables give no
    rows; extra columns are not read.
    """
    rows = _classified(docs, terms, id_col, text_col)
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def keep_one_of_class(docs: DataFrame, terms: Terms = Terms(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, unchanged, one for each class of jaccard_components: one with the class's id.

    Texts with empty sets are classes of their own; of rows alike in id and text one stays, that
    with the least hash over all columns.
    """
    rows = _classified(docs, terms, id_col, text_col)
    own = F.when(F.col("n") > 0, F.col("label"))
    kept = rows.filter(F.col("id").eqNullSafe(F.col("component_id"))).groupBy(own.alias("class"), "id", F.when(own.isNull(), F.col("tag")).alias("t")).agg(F.min("tag").alias("tag"))
    kept = kept.select(F.col("id").alias("_kid"), F.col("tag").alias("_ktag"))
    tagged = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("_id"), F.xxhash64(F.col(text_col)).alias("_tag"), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("_all"))
    kept = kept.select(F.xxhash64(F.coalesce(F.col("_kid").cast("string"), F.lit(""))).alias("_id"), F.col("_ktag").alias("_tag")).distinct()
    return tagged.join(kept, ["_id", "_tag"], "left_semi").groupBy("_id", "_tag").agg(F.min_by("_row", "_all").alias("_row")).select("_row.*")


def _classified(docs: DataFrame, terms: Terms, id_col: str, text_col: str) -> DataFrame:
    """id, tag (hash of the text), n, label and component_id of every row."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    kind = docs.schema[id_col].dataType.simpleString()
    raw = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("tag"), F.coalesce(id_number(docs, id_col), F.lit((1 << 63) - 1)).alias("key"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("raw"))
    seen = raw.select("key", "raw").withColumn("at", F.monotonically_increasing_id())

    size = raw.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, (size >> 8).bit_length()))
    survey = cut(raw.select("id", "tag", "raw").mapInArrow(_survey(terms, bits), f"kind int, id {kind}, tag long, page int, n long, sig binary"))
    sketch = sc.broadcast(_sketch(survey.filter("kind = 1"), bits))

    found = seen.select("at", "raw").mapInArrow(_prefixes(terms, sketch, None), "t long, at long")
    again = written(found.groupBy("t").agg(F.min("at").alias("a"), F.max("at").alias("b")).filter("a < b").select("t"))
    shared = sc.broadcast(bitmap_of(again, again.count()))
    entries = seen.select(F.col("key").alias("at"), "raw").mapInArrow(_prefixes(terms, sketch, shared), "t long, sig binary, at long, n long, i long")
    # one shuffle by element: equal sets met in each task already, so no element is hotter here than in the index
    entries = entries.repartition("t").groupBy("t", "sig", "n", "i").agg(F.min("at").alias("key"))
    entries = written(entries.withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("t"))).filter("c > 1").drop("c"))
    sketch.destroy(), shared.destroy()
    labels = _classes(raw, entries, terms)
    rows = survey.filter("kind = 0").select("id", "tag", "n", "sig")
    classes = rows.filter("n > 0").groupBy("sig").agg(F.min("id").alias("least")).join(labels, F.col("sig") == F.col("v"), "left")
    classes = cut(classes.select("sig", "least", F.coalesce("label", "sig").alias("label")))
    least_id = classes.groupBy("label").agg(F.min("least").alias("component_id"))
    classes = cut(join_groups(classes, least_id, ["label"], hot_keys(classes, ["label"])).select("sig", "label", "component_id"))
    full = rows.filter("n > 0")
    full = join_groups(full, classes, ["sig"], hot_keys(full, ["sig"])).select("id", "tag", "n", "label", "component_id")
    return full.union(rows.filter("n = 0").select("id", "tag", "n", "sig", F.col("id")))


def _classes(raw: DataFrame, entries: DataFrame, terms: Terms) -> DataFrame:
    """Labels (v, label) of the signatures that link with another, from the index entries."""
    sc = raw.sparkSession.sparkContext
    block = F.floor(F.log(F.col("n")) / F.log(F.lit(100 / terms.percent))).alias("block")
    blocks = entries.select("*", block)
    first = blocks.groupBy("t", "block").agg(F.min(F.struct("key", "sig", "n", "i")).alias("h"))

    def possible(n, i, m, j) -> Column:
        """Can sets of n and m link, if their first common element is at i and j?"""
        return terms.fits(n, m) & (1 + F.least(n - i - 1, m - j - 1) >= terms.overlap(n, m))

    def verify(pairs: DataFrame) -> DataFrame:
        """Adds o = |a & b|. Pairs carry a's text; b's goes before each _MEMBERS of them, so no pair and no group holds more than two texts."""
        ends = written(pairs.select(F.explode(F.array("a", "b")).alias("s")).distinct().select(as_long(F.col("s")).alias("s")))
        wanted = sc.broadcast(bitmap_of(ends, ends.count()))
        texts = raw.select("raw").mapInArrow(_chosen(terms, wanted), "sig binary, raw binary").groupBy("sig").agg(F.first("raw").alias("raw"))
        hubs = pairs.groupBy("b").agg(F.expr(f"count(1) div {_MEMBERS} + 1").alias("parts"))
        members = join_groups(pairs, hubs, ["b"], hot_keys(pairs, ["b"])).withColumn("part", F.expr("pmod(xxhash64(a), parts)")).join(texts.withColumnRenamed("sig", "a"), "a")
        heads = hubs.select("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")).join(texts.withColumnRenamed("sig", "b"), "b")
        none = F.lit(None)
        rows = members.select("b", "part", "a", "na", "nb", "raw").union(heads.select("b", "part", none.cast("binary"), none.cast("long"), none.cast("long"), "raw"))
        rows = rows.repartition("b", "part").sortWithinPartitions("b", "part", F.col("a").asc_nulls_first())
        out = cut(rows.select("a", "b", "na", "nb", "raw").mapInArrow(_verified(terms), "a binary, b binary, na long, nb long, o long"))
        wanted.destroy()
        return out

    h = F.col("h")
    near = first.select("t", F.explode(F.array("block", F.col("block") + 1)).alias("block"), "h")
    stars = blocks.join(near, ["t", "block"]).filter((F.col("sig") != h["sig"]) & possible(F.col("n"), F.col("i"), h["n"], h["i"]))
    stars = stars.groupBy(F.col("sig").alias("a"), F.col("n").alias("na"), h["sig"].alias("b"), h["n"].alias("nb")).agg(F.count(F.lit(1)).alias("c"))
    stars = cut(stars.groupBy("a", "na").agg(F.max(F.struct("c", "b", "nb")).alias("best")).select("a", "best.b", "na", "best.nb"))
    is_link = F.col("o") * 100 >= (F.col("na") + F.col("nb") - F.col("o")) * terms.percent
    tested = verify(stars)
    links = tested.filter(is_link).select("a", "b")
    labels = components(links)
    best = tested.groupBy(F.col("a").alias("x")).agg(F.max(F.struct("o", F.col("b").alias("h"), F.col("nb").alias("nh"))).alias("best"))

    def labelled(rows: DataFrame) -> DataFrame:
        return rows.join(labels, F.col("sig") == F.col("v"), "left").withColumn("label", F.coalesce("label", "sig")).drop("v")

    main = labelled(entries).groupBy("t").agg(F.min_by("label", "key").alias("main"), F.min("label").alias("l0"), F.max("label").alias("l1"))
    main = cut(main.filter("l0 <> l1").select(F.col("t").alias("mt"), "main"))
    open_lists = labelled(entries.join(main, F.col("t") == F.col("mt")).drop("mt"))
    open_lists = cut(open_lists.join(best, F.col("sig") == F.col("x"), "left").select("t", "sig", "n", "i", "label", "best", "main"))
    x = open_lists.filter("label <> main").select(*[F.col(c).alias(f"x_{c}") for c in ("t", "sig", "n", "i", "label", "best")])
    y = open_lists.select(*[F.col(c).alias(f"y_{c}") for c in ("t", "sig", "n", "i", "label", "best", "main")])
    p, q, hub = F.col("x_best.o"), F.col("y_best.o"), F.col("x_best.h") == F.col("y_best.h")
    need = terms.overlap(F.col("x_n"), F.col("y_n"))
    most = F.when(hub, F.least(p, q) + F.least(F.col("x_n") - p, F.col("y_n") - q)).otherwise(F.col("x_n"))
    once = (F.col("y_label") == F.col("y_main")) | (F.col("x_sig") < F.col("y_sig"))
    on = (F.col("x_t") == F.col("y_t")) & (F.col("x_label") != F.col("y_label")) & once & possible(F.col("x_n"), F.col("x_i"), F.col("y_n"), F.col("y_i")) & (F.coalesce(most, F.col("x_n")) >= need)
    least = F.coalesce(F.when(hub, p + q - F.col("x_best.nh")), F.lit(0))
    back = F.col("x_sig") > F.col("y_sig")
    pairs = x.join(y, on).select(
        F.least("x_sig", "y_sig").alias("a"), F.greatest("x_sig", "y_sig").alias("b"),
        F.when(back, F.col("y_n")).otherwise(F.col("x_n")).alias("na"), F.when(back, F.col("x_n")).otherwise(F.col("y_n")).alias("nb"),
        (least >= need).alias("sure"),
    )
    done = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = cut(pairs.groupBy("a", "b", "na", "nb").agg(F.max("sure").alias("sure")).join(done, ["a", "b"], "left_anti"))
    more = verify(pairs.filter("not sure").drop("sure")).filter(is_link).select("a", "b")
    return components(links.union(more).union(pairs.filter("sure").select("a", "b")))


def as_long(sig: Column) -> Column:
    """The first 8 bytes of a signature as a number, as the bitmap reads them."""
    return F.conv(F.hex(F.substring(sig, 1, 8)), 16, -10).cast("long")

"""MinHash near-duplicate classes, with odd sketches that tell how similar two candidates are."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factline.llm import words as w
from factline.llm.bitmaps import bitmap_of
from factline.llm.components import components
from factline.llm.jaccard_join import Terms, _chosen, _sig, _verified, as_long, sets_of
from factline.llm.tables import cut, hot_keys, join_groups, written

_MEMBERS = 256  # pairs verified against one copy of a hub's text
_BLOCK = 1024  # sketches of one side of a cell of a large bucket
_ELEMENTS = 1 << 18  # of the sets of a block of round 2


@dataclass(frozen=True)
class Sketch:
    """bands of rows MinHash samples each, folded into 64 * longs parity bits."""

    bands: int = 48
    rows: int = 6
    longs: int = 16
    deviations: float = 6.0

    @property
    def samples(self) -> int:
        return self.bands * self.rows

    def missed(self, similarity: float) -> float:
        """The chance that two sets of this similarity share no band."""
        return (1 - similarity**self.rows) ** self.bands

    def estimate(self, differing: np.ndarray) -> np.ndarray:
        """Similarity by the number of differing bits of two sketches (Mitzenmacher, Pagh, Pham)."""
        n = 64 * self.longs
        return 1 + n * np.log(np.maximum(1 - 2 * np.asarray(differing) / n, 1e-9)) / (4 * self.samples)

    def most_differing(self, similarity: float) -> int:
        """Two sets of this similarity or more differ in more bits only by a chance of about 1e-9 (6 standard deviations of samples and bits)."""
        n = 64 * self.longs
        unlike = self.samples * (1 - similarity)
        same = math.exp(-4 * unlike / n)  # how far a sample more still shows in the bits
        spread = (2 * same) ** 2 * unlike * similarity + n * (1 - same * same) / 8
        return min(n, math.ceil(n * (1 - same) / 2 + self.deviations * math.sqrt(spread)))


def _numbers(seed: int, n: int) -> np.ndarray:
    return w._mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def minhashes(sets: list[np.ndarray], samples: int) -> np.ndarray:
    """The least value of each set (none empty) under each of `samples` orders: 32-bit numbers, a row a set."""
    flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    begins = np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.empty((len(sets), samples), np.uint32)
    turn, shift = (_numbers(1, samples) >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (_numbers(2, samples) >> np.uint64(32)).astype(np.uint32)
    for k in range(samples):
        x = flat ^ shift[k]
        x *= turn[k]
        out[:, k] = np.minimum.reduceat(x, begins)
    return out


def sketched(least: np.ndarray, sketch: Sketch) -> tuple[np.ndarray, np.ndarray]:
    """From MinHash samples: a key for each band, and the parity bits of the samples' hashes as 64-bit numbers."""
    order = np.arange(least.shape[1], dtype=np.uint64) << np.uint64(32)
    named = w._mixed(least.astype(np.uint64) | order)
    with np.errstate(over="ignore"):
        keys = named.reshape(len(least), sketch.bands, sketch.rows).sum(2)
    keys = w._mixed(keys)
    bits = 64 * sketch.longs
    at = (named & np.uint64(bits - 1)).astype(np.int64) + bits * np.arange(len(least))[:, None]
    odd = (np.bincount(at.ravel(), minlength=bits * len(least)) & 1).astype(np.uint8)
    return keys, np.packbits(odd.reshape(len(least), bits), axis=1, bitorder="little").view("<u8")


def _survey(terms: Terms, sketch: Sketch):
    """Per text the size and signature of its set; once for all equal sets of a task the band keys and the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for lo, hi, data, offsets in w.slices(batch):
                sets = list(sets_of(data, offsets, terms.n))
                sigs = [_sig(s) for s in sets]
                fresh = [k for k, s in enumerate(sets) if len(s) and sigs[k] not in seen and not seen.add(sigs[k])]
                lists: list[pa.Array] = []
                places = np.full(hi - lo, -1)
                places[fresh] = np.arange(len(fresh))
                at = pa.array(places, mask=places < 0)
                for values in sketched(minhashes([sets[k] for k in fresh], sketch.samples), sketch) if fresh else (np.zeros((0, sketch.bands), np.uint64), np.zeros((0, sketch.longs), np.uint64)):
                    flat = pa.array(np.ascontiguousarray(values).view(np.int64).ravel())
                    lists.append(pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), flat).take(at))
                yield pa.RecordBatch.from_arrays([batch["id"].slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), pa.array(sigs, pa.binary()), *lists], ["id", "n", "sig", "keys", "odd"])

    return w.tidy(run)


def differing(a: str, b: str, longs: int) -> Column:
    """Bits in which the sketches in array columns a and b differ, counted on the JVM within whole-stage code."""
    return F.expr(" + ".join(f"bit_count({a}[{k}] ^ {b}[{k}])" for k in range(longs)))


def overlaps(raw: DataFrame, pairs: DataFrame, terms: Terms) -> DataFrame:
    """Adds o = |a & b|, counted by the words of full sets, to pairs (a, b, na, nb) of signatures.

    Pairs carry a's text, and b's goes before each _MEMBERS of them; so no pair and no group holds more than two texts.
    """
    sc = raw.sparkSession.sparkContext
    ends = written(pairs.select(F.explode(F.array("a", "b")).alias("s")).distinct().select(as_long(F.col("s")).alias("s")))
    wanted = sc.broadcast(bitmap_of(ends, ends.count()))
    texts = written(raw.mapInArrow(_chosen(terms, wanted), "sig binary, raw binary").groupBy("sig").agg(F.first("raw").alias("raw")))
    hubs = pairs.groupBy("b").agg(F.expr(f"count(1) div {_MEMBERS} + 1").alias("parts"))
    members = join_groups(pairs, hubs, ["b"], hot_keys(pairs, ["b"])).withColumn("part", F.expr("pmod(xxhash64(a), parts)")).join(texts.withColumnRenamed("sig", "a"), "a")
    heads = hubs.join(texts.withColumnRenamed("sig", "b"), "b").select("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "raw")
    none = F.lit(None)
    rows = members.select("b", "part", "a", "na", "nb", "raw").union(heads.select("b", "part", none.cast("binary"), none.cast("long"), none.cast("long"), "raw"))
    rows = rows.repartition("b", "part").sortWithinPartitions("b", "part", F.col("a").asc_nulls_first())
    out = cut(rows.select("a", "b", "na", "nb", "raw").mapInArrow(_verified(terms), "a binary, b binary, na long, nb long, o long"))
    wanted.destroy()
    return out


def minhash_classes(docs: DataFrame, terms: Terms = Terms(n=3, percent=85), sketch: Sketch = Sketch(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Classes of texts joined by links of Jaccard similarity terms.percent / 100 or more of their word shingles.

    Equal sets are one node. A node has bands * rows MinHash samples. Nodes that share a band of
    samples are candidates; of linked sets 1.4e-10 share none (Sketch.missed, at 0.85). The samples are
    also folded into a bitmap by parity. Two bitmaps' XOR has a bit for each sample in one only, save for
    collisions, so its population count tells high similarities closely, where most candidates lie.
    Candidates that differ in more bits than linked sets do but once in 1e9 (Sketch.most_differing) go no further; all
    others are confirmed by their full sets of words.

    Round 1 compares each node with one other only: of the first nodes of its bands' buckets, that
    which it meets most often. Round 2 looks at the nodes that are outside
    of the main class (the largest) of a bucket: their sketches meet all others of their buckets in cells of _BLOCK by _BLOCK, which
    give each of them a list of the near ones. Then sets are dealt into blocks of about _ELEMENTS elements, and each node
    goes, with its list, to the blocks that hold any of it; there overlaps are counted on full sets (64-bit hashes of shingles), and links that
    hold a block's classes together are enough. No pair is a row, members of one class are never compared again, and groups of copies are
    not expanded. Hot buckets and hubs are kept apart.

    Returns id, n_shingles, component_id (the least id of the class), kept (the id is that
    one). Nulls: a null or wordless text has an empty set and is a class of its own; a null id
    takes part, and is the class's id only if all its ids are null. Texts of fewer words than a shingle
    have all their words as one. Repeated rows are all returned, and kept alike. Empty tables give no rows; extra
    columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    raw = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b"")).alias("raw"))
    rows = written(raw.mapInArrow(_survey(terms, sketch), f"id {kind}, n long, sig binary, keys array<long>, odd array<long>"))
    nodes = written(rows.filter("keys is not null").groupBy("sig").agg(F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("odd").alias("odd")))
    labels = _labels(raw.select("raw"), nodes, terms, sketch)
    full = rows.filter("n > 0").select("id", "n", "sig")
    classes = full.groupBy("sig").agg(F.min("id").alias("least")).join(labels, F.col("sig") == F.col("v"), "left")
    classes = cut(classes.select("sig", "least", F.coalesce("label", "sig").alias("label")))
    least_id = classes.groupBy("label").agg(F.min("least").alias("component_id"))
    classes = cut(join_groups(classes, least_id, ["label"], hot_keys(classes, ["label"])).select("sig", "component_id"))
    out = join_groups(full, classes, ["sig"], hot_keys(full, ["sig"])).select("id", "n", "component_id")
    out = out.union(rows.filter("n = 0").select("id", "n", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _sets(terms: Terms, wanted):
    """Name (64 bits of the signature), signature and elements of the sets that the bitmap lets through, once for all equal ones of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = w.Bitmap(wanted.value), set()
        for batch in batches:
            for _, _, data, offsets in w.slices(batch):
                sets = list(sets_of(data, offsets, terms.n))
                sigs = [_sig(s) for s in sets]
                hit = np.flatnonzero(known.has(np.frombuffer(b"".join(s[:8] for s in sigs), ">u8").astype(np.uint64)))
                keep = [k for k in hit.tolist() if len(sets[k]) and sigs[k] not in seen and not seen.add(sigs[k])]
                flat = pa.array(np.concatenate([np.zeros(0, np.uint64), *(sets[k] for k in keep)]).view(np.int64))
                offs = pa.array(np.cumsum([0, *(len(sets[k]) for k in keep)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array([int.from_bytes(sigs[k][:8], "big", signed=True) for k in keep], pa.int64()), pa.array([sigs[k] for k in keep], pa.binary()), pa.ListArray.from_arrays(offs, flat)], ["nid", "sig", "els"])

    return w.tidy(run)


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key, of batches that are sorted by keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        cols = [batch[k].to_numpy() for k in keys]
        last = np.logical_and.reduce([c == c[-1] for c in cols])
        begin = int(np.argmax(last))
        before = [b for b in held[:-1]]
        if begin == 0 and (not before or all(before[-1][k][-1].as_py() == batch[k][0].as_py() for k in keys)):
            continue
        whole = pa.Table.from_batches([*before, batch.slice(0, begin)]).combine_chunks()
        held = [batch.slice(begin)]
        yield from _cut_up(whole, keys)
    if held:
        yield from _cut_up(pa.Table.from_batches(held).combine_chunks(), keys)


def _cut_up(table: pa.Table, keys: list[str]) -> Iterator[pa.Table]:
    if not len(table):
        return
    cols = [table[k].to_numpy() for k in keys]
    edges = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1
    for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(table)], strict=True):
        yield table.slice(lo, hi - lo)


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    flat = column.combine_chunks()
    return (flat.flatten() if isinstance(flat, pa.ListArray) else pa.concat_arrays(flat.chunks).flatten()).to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, width)


def _near_in_cells(terms: Terms, sketch: Sketch, most: int):
    """For each outsider of a cell, a list of the cell's nodes in other classes whose sketches are near enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _groups(batches, ["t", "i", "j"]):
            out = cell["out"].to_numpy()
            nid, n, label, main = (cell[c].to_numpy() for c in ("nid", "n", "label", "main"))
            odd = _matrix(cell["odd"], sketch.longs)
            ys = np.flatnonzero(~out)
            found, lists = [], []
            for x in np.flatnonzero(out).tolist():
                fit = (label[ys] != label[x]) & (main[ys] | (nid[x] < nid[ys])) & (100 * n[ys] >= terms.percent * n[x]) & (100 * n[x] >= terms.percent * n[ys])
                some = ys[fit]
                near = some[np.bitwise_count(odd[some] ^ odd[x]).sum(1) <= most] if len(some) else some
                if len(near):
                    found.append(int(nid[x])), lists.append(nid[near])
            if found:
                offs = pa.array(np.cumsum([0, *map(len, lists)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.ListArray.from_arrays(offs, pa.array(np.concatenate(lists)))], ["nid", "near"])

    return w.tidy(run)


def _links_in_blocks(terms: Terms):
    """Of a block's sets and those that come with lists of near ones: links that join the same classes as all of its links do, fewer than it has classes. Overlaps are counted on full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _groups(batches, ["block"]):
            asks = block["near"].is_valid().to_numpy()
            nid, label, sig = block["nid"].to_numpy(), block["label"].to_numpy(), block["sig"]
            held = np.flatnonzero(~asks)
            held = held[np.argsort(nid[held])]
            names = nid[held]
            sets = [block["els"][int(k)].values.to_numpy().view(np.uint64) for k in held]
            _, of = np.unique(label, return_inverse=True)
            joined, members = np.arange(of.max() + 1), [[k] for k in range(of.max() + 1)]  # classes that links of this block have joined
            pairs = []
            for x in np.flatnonzero(asks).tolist():
                own = block["els"][x].values.to_numpy().view(np.uint64)
                near = block["near"][x].values.to_numpy()
                at = np.searchsorted(names, near)
                at = at[(at < len(names)) & (names[np.minimum(at, len(names) - 1)] == near)] if len(names) else at[:0]
                at = at[joined[of[held[at]]] != joined[of[x]]]
                if not len(at):
                    continue
                sizes = np.array([len(sets[k]) for k in at])
                flat = np.concatenate([sets[k] for k in at])
                place = np.minimum(np.searchsorted(own, flat), len(own) - 1)
                common = np.add.reduceat((own[place] == flat).astype(np.int64), np.cumsum([0, *sizes[:-1]]))
                linked = at[100 * common >= terms.percent * (len(own) + sizes - common)]
                _, first = np.unique(joined[of[held[linked]]], return_index=True)
                for k in linked[first].tolist():
                    pairs.append((sig[x].as_py(), sig[int(held[k])].as_py()))
                    few, many = sorted((int(joined[of[x]]), int(joined[of[held[k]]])), key=lambda c: len(members[c]))
                    joined[members[few]] = many
                    members[many] += members[few]
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.binary()) for k in (0, 1)], ["a", "b"])

    return w.tidy(run)


def _labels(raw: DataFrame, nodes: DataFrame, terms: Terms, sketch: Sketch) -> DataFrame:
    """Labels (v, label) of the signatures that link with another."""
    entries = nodes.select("sig", F.explode("keys").alias("t"))
    shared = entries.groupBy("t").agg(F.min("sig").alias("b"), F.max("sig").alias("z"))
    shared = written(shared.filter("b <> z").select("t", "b"))
    known = raw.sparkSession.sparkContext.broadcast(bitmap_of(shared.select("t"), shared.count()))

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Entries of shared buckets, and few others."""
        bits = w.Bitmap(known.value)
        for batch in batches:
            flat = batch["keys"].flatten().to_numpy(zero_copy_only=False)
            hit = np.flatnonzero(bits.has(flat.view(np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array(flat[hit]), batch["sig"].take(pa.array(hit // sketch.bands))], ["t", "sig"])

    found = written(nodes.select("keys", "sig").mapInArrow(w.tidy(possible), "t long, sig binary"))
    met = written(join_groups(found, shared, ["t"], hot_keys(found, ["t"])).select("t", "sig", "b"))
    known.destroy()
    most = sketch.most_differing(terms.percent / 100)
    ends = nodes.select("sig", "n", "odd")

    is_link = F.col("o") * 100 >= (F.col("na") + F.col("nb") - F.col("o")) * terms.percent

    def passing(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) of fitting sizes whose sketches are near enough."""
        both = join_groups(pairs, ends.toDF("b", "nb", "odd_b"), ["b"], hot_keys(pairs, ["b"])).join(ends.toDF("a", "na", "odd_a"), "a")
        return both.filter(terms.fits(F.col("na"), F.col("nb")) & (differing("odd_a", "odd_b", sketch.longs) <= most)).select("a", "b", "na", "nb")

    def open_buckets() -> DataFrame:
        """The entries, with labels, of buckets of several classes, with the main class and the numbers of nodes."""
        rows = cut(met.select("t", "sig").join(labels, F.col("sig") == F.col("v"), "left").select("t", "sig", F.coalesce("label", "sig").alias("label")))
        sizes = rows.groupBy("t", "label").agg(F.count(F.lit(1)).alias("c"))
        mains = sizes.groupBy("t").agg(F.max(F.struct("c", "label")).alias("m"), F.sum("c").alias("all"), F.count(F.lit(1)).alias("classes")).filter("classes > 1")
        mains = cut(mains.select("t", F.col("m.label").alias("main"), F.col("m.c").alias("in_main"), "all"))
        return cut(join_groups(rows, mains, ["t"], hot_keys(rows, ["t"])))

    stars = met.filter("sig <> b").groupBy(F.col("sig").alias("a"), "b").agg(F.count(F.lit(1)).alias("c"))
    stars = cut(stars.groupBy("a").agg(F.max(F.struct("c", "b")).alias("best")).select("a", "best.b"))
    tested = overlaps(raw, passing(stars), terms)
    labels = components(tested.filter(is_link))
    rows = open_buckets()
    parts = lambda n: F.ceil(n / F.lit(_BLOCK))
    bucket = written(rows.withColumns({"px": parts(F.col("all") - F.col("in_main")), "py": parts(F.col("all"))}).join(ends, "sig"))
    cell = lambda parts: F.expr(f"pmod(xxhash64(sig, t), {parts})")
    every = lambda parts: F.explode(F.sequence(F.lit(0).cast("long"), F.col(parts) - 1))
    named = [as_long(F.col("sig")).alias("nid"), "n", "odd", as_long(F.col("label")).alias("label"), (F.col("label") == F.col("main")).alias("main")]
    x = bucket.filter("label <> main").withColumn("i", cell("px")).withColumn("j", every("py")).select("t", "i", "j", F.lit(True).alias("out"), *named)
    y = bucket.withColumn("j", cell("py")).withColumn("i", every("px")).select("t", "i", "j", F.lit(False).alias("out"), *named)
    cells = x.union(y).repartition("t", "i", "j").sortWithinPartitions("t", "i", "j")
    near = cells.mapInArrow(_near_in_cells(terms, sketch, most), "nid long, near array<long>").groupBy("nid").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))

    wanted = bucket.select(as_long(F.col("sig")).alias("s"), F.col("label")).distinct()
    of = raw.sparkSession.sparkContext.broadcast(bitmap_of(wanted.select("s"), wanted.count()))
    sets = raw.mapInArrow(_sets(terms, of), "nid long, sig binary, els array<long>").groupBy("nid").agg(F.first("sig").alias("sig"), F.first("els").alias("els"))
    sets = written(sets.join(wanted.select(F.col("s").alias("nid"), as_long(F.col("label")).alias("label")), "nid"))
    of.destroy()
    blocks = max(1, -(-(sets.agg(F.sum(F.size("els"))).first()[0] or 0) // _ELEMENTS))
    place = f"cast(pmod(xxhash64(v), {blocks}) as int)"
    asks = near.withColumn("block", F.explode(F.expr(f"array_distinct(transform(near, v -> {place}))"))).withColumn("near", F.expr(f"filter(near, v -> {place} = block)"))
    asks = asks.join(sets, "nid").select("block", "nid", "sig", "label", "els", "near")
    theirs = sets.select(F.expr(place.replace("(v)", "(nid)")).alias("block"), "nid", "sig", "label", "els", F.lit(None).cast("array<long>").alias("near"))
    dealt = theirs.union(asks).repartition("block").sortWithinPartitions("block")
    return components(cut(tested.filter(is_link).select("a", "b").union(dealt.mapInArrow(_links_in_blocks(terms), "a binary, b binary"))))

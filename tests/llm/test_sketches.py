"""MinHash classes against brute force; odd sketches against true similarities."""

import random
import re

import numpy as np
import pytest
from conftest_llm import CLASHING, SCHEMA
from pyspark.sql import functions as F

from factline.llm import odd_sketches as odd
from factline.llm.jaccard_join import Terms

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()


def brute(rows, n=3, percent=85):
    """(id, size, class id, kept) of every row, by all pairs."""
    sets = [shingles(t, n) for _, t in rows]
    of = list(range(len(rows)))

    def root(k):
        while of[k] != k:
            k = of[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                of[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return sorted(((i, len(sets[k]), least.get(root(k)), i == least.get(root(k))) for k, (i, _) in enumerate(rows)), key=str)


def near_copies(rng, n, length, most):
    """Texts that differ from one of a few in up to `most` words: chains of links, and pairs on either side of the bound."""
    base = [[f"v{rng.randrange(5000)}" for _ in range(length)] for _ in range(3)]
    out = []
    for i in range(n):
        words = list(base[i % 3])
        for _ in range(rng.randrange(most)):
            words[rng.randrange(length)] = f"n{rng.randrange(10**6)}"
        out.append((i, " ".join(words)))
    return out


def test_classes(docs, table_of, corpus):
    extra = [F.lit(None).cast(t).alias(c) for c, t in (c.split() for c in f"{CLASHING}, odd int, keys int, sig int, n_shingles int".split(", "))]
    got = odd.minhash_classes(table_of(docs.select("*", *extra))).collect()
    assert sorted(map(tuple, got), key=str) == brute([(i, t) for i, t, *_ in corpus])


@pytest.mark.parametrize("block", [1024, 7])
def test_links_at_the_bound(spark, table_of, monkeypatch, block):
    monkeypatch.setattr(odd, "_BLOCK", block), monkeypatch.setattr(odd, "_ELEMENTS", block * 100)
    rows = near_copies(random.Random(block), 150, 120, 9)
    df = table_of(spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], SCHEMA).repartition(4))
    got = sorted(map(tuple, odd.minhash_classes(df).collect()), key=str)
    assert got == brute(rows)
    assert len({r[2] for r in got}) > 5
    got = sorted(map(tuple, odd.minhash_classes(df, Terms(n=2, percent=90)).collect()), key=str)
    assert got == brute(rows, 2, 90)


def test_sketches_tell_high_similarities(spark):
    rng, sketch = np.random.default_rng(7), odd.Sketch()
    for similarity in (0.7, 0.85, 0.95, 1.0):
        size = 400
        differ = round(size * (1 - similarity) / (1 + similarity))
        off = []
        for _ in range(40):
            shared, a, b = (rng.integers(0, 1 << 63, k, dtype=np.uint64) for k in (size - differ, differ, differ))
            _, bits = odd.sketched(odd.minhashes([np.r_[shared, a], np.r_[shared, b]], sketch.samples), sketch)
            count = int(np.bitwise_count(bits[0] ^ bits[1]).sum())
            off.append(float(sketch.estimate(count)) - (size - differ) / (size + differ))
            assert similarity < 0.85 or count <= sketch.most_differing(0.85)
        assert abs(np.mean(off)) < 0.015 and np.std(off) < 0.04
    assert sketch.missed(0.85) < 1e-9 and sketch.estimate(sketch.most_differing(0.85)) > 0.6
    df = spark.createDataFrame([([5, -1], [4, 7])], "a array<long>, b array<long>")
    assert df.select(odd.differing("a", "b", 2)).first()[0] == 1 + 61


def test_nothing_and_nulls(spark, table_of):
    assert odd.minhash_classes(spark.createDataFrame([], SCHEMA)).count() == 0
    nulls = table_of(spark.createDataFrame([(None,) * 5] * 2 + [(None, "a b c d", None, None, None), (3, "A b  c d", None, None, None), (3, "a b c d", None, None, None), (4, "a", None, None, None)], SCHEMA))
    got = sorted(map(tuple, odd.minhash_classes(nulls).collect()), key=str)
    assert got == sorted([(None, 0, None, True)] * 2 + [(None, 2, 3, False), (3, 2, 3, True), (3, 2, 3, True), (4, 1, 4, True)], key=str)


def test_a_very_long_text(spark, table_of):
    rng = random.Random(9)
    words = [f"x{rng.randrange(10**7)}" for _ in range(200_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[5_000:])), (3, " ".join(words[:100_000]))]
    got = odd.minhash_classes(table_of(spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA))).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {1: 1, 2: 1, 3: 3}


def test_a_block_gives_fewer_links_than_classes():
    """A block of 60 sets that all link with each other, each a class: links that hold them together, not all pairs."""
    import pyarrow as pa

    els = [np.sort(np.r_[np.arange(1, 200), 1000 + k]).astype(np.int64) for k in range(60)]
    far = [np.arange(5000 + 300 * k, 5200 + 300 * k) for k in range(2)]
    n = len(els) + len(far)
    nids = list(range(n))
    sig = [bytes([k]) * 16 for k in range(n)]
    held = pa.record_batch({"block": [0] * n, "nid": nids, "sig": sig, "label": nids, "els": els + far, "near": pa.nulls(n, pa.list_(pa.int64()))})
    asks = pa.record_batch({"block": [0] * n, "nid": nids, "sig": sig, "label": nids, "els": els + far, "near": [[m for m in nids if m != k] for k in nids]})
    links = pa.Table.from_batches(odd._links_in_blocks(Terms(n=3, percent=85))(iter([held, asks]))).to_pylist()
    assert len(links) == 59
    reached, new = {sig[0]}, True
    while new:
        new = {x for p in links for x in (p["a"], p["b"]) if {p["a"], p["b"]} & reached} - reached
        reached |= new
    assert reached == set(sig[:60])

"""Rows, words and windows are what they are by their content, not by a weak hash or by their place in a scan."""

import collections
import random

import pytest
from conftest_llm import SCHEMA
from pyspark.sql import functions as F

from factline.llm import words as w
from factline.llm.jaccard_join import jaccard_components, keep_one_of_class
from factline.llm.line_dedup import line_dedup
from factline.llm.mixing_lm import lm_scores
from factline.llm.quality import quality_lines
from factline.llm.substring_dedup import substring_dedup


def thue_morse(n, a, b):
    """Words that polynomials modulo 2^64 cannot tell from their complement."""
    return "".join(a if bin(k).count("1") % 2 else b for k in range(n))


ONE, OTHER = thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a")


@pytest.fixture
def twins(spark, table_of):
    tail = " ".join(f"t{k}" for k in range(49))
    texts = [ONE, OTHER, f"{ONE} {tail}", f"{OTHER} {tail}", f"{ONE} x y {OTHER} x y"]
    return table_of(spark.createDataFrame([(7 * i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA))


def test_words_are_told_apart(twins):
    got = {r["doc_id"]: r["component_id"] for r in jaccard_components(twins).collect()}
    assert got == {0: 0, 7: 7, 14: 14, 21: 14, 28: 28}  # 46 of 48 shingles are alike in 14 and 21
    assert {r["n_removed"] for r in substring_dedup(twins).collect()} == {0}
    assert {r["doc_id"]: r["n_repeat_words"] for r in quality_lines(twins).collect()}[28] == 0
    held = F.col("doc_id") == 0
    known = {r["doc_id"]: r["n_known"] for r in lm_scores(twins.filter("doc_id in (0, 7)"), held_out=held).collect()}
    assert known == {0: 1, 7: 2}


def test_hashes_of_short_and_long_words():
    rng = random.Random(4)
    words = {bytes(rng.randrange(33, 127) for _ in range(n)) for n in (1, 2, 6, 7, 8, 9, 15, 16, 17, 63, 64, 65, 200) for _ in range(300)} | {b"abcdef", b"abcdef\0\x0e", b"abcdef\0", b"a", b"a\0"}
    import numpy as np

    words = sorted(words)
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(x) for x in words])
    starts = ends - [len(x) for x in words]
    one, two = w.word_hashes(data, starts, ends), w.word_hashes(data, starts, ends, seed=1)
    assert len(set(one.tolist())) == len(words) == len(set(two.tolist())) and not (one == two).any()
    moved = np.concatenate([np.zeros(3, np.uint8), data])
    assert (w.word_hashes(moved, starts + 3, ends + 3) == one).all()
    for n in (1, 3, 4, 5, 20, 50):
        grams = w.ngram_hashes(one, n)
        assert len(grams) == len(words) - n + 1 and (w.ngram_hashes(one[7 : 7 + n], n) == grams[7]).all()


def test_line_dedup_does_not_lean_on_the_scan(spark, tmp_path):
    rng = random.Random(2)
    say = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    shared = [say(50) for _ in range(5)]
    rows = [(i, "\n".join([say(12), *(shared[:3] if i % 4 == 0 else shared[3:] if i % 4 == 1 else []), say(9)]), "en", "s", 1) for i in range(200)]
    path = str(tmp_path / "t")
    spark.createDataFrame(rows, SCHEMA).repartition(6).write.parquet(path)
    spark.conf.set("spark.sql.files.minPartitionNum", "4")
    got = line_dedup(spark.read.parquet(path))  # its eager jobs see one plan of the scan
    try:
        spark.conf.set("spark.sql.files.minPartitionNum", "1")
        found = {r["doc_id"]: (r["_n_removed"], r["_kept"]) for r in got.collect()}
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert sum(n for n, _ in found.values()) == 49 * 3 + 49 * 2
    assert all(set(t.split("\n")) <= set(dict((r[0], r[1]) for r in rows)[i].split("\n")) for i, (_, t) in found.items())


def test_repeated_rows_lose_what_the_first_keeps(spark, table_of):
    text = "\n".join(["x" * 150, "y" * 150, "z" * 10])
    rows = [(1, text, None, None, 0)] * 3 + [(None, text, None, None, 0)] * 2 + [(2, "short", None, None, 0)] * 2
    got = collections.Counter((r["doc_id"], r["_n_removed"], r["_kept"]) for r in line_dedup(table_of(spark.createDataFrame(rows, SCHEMA).repartition(3))).collect())
    assert got == {(1, 0, text): 1, (1, 3, ""): 2, (None, 3, ""): 2, (2, 0, "short"): 2}


def test_rows_that_share_an_id_keep_each_others_words(spark, table_of):
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(1, f"{passage} a", None, None, 0), (1, f"b {passage}", None, None, 0), (None, passage, None, None, 0), (None, f"c {passage}", None, None, 0), (2, f"d {passage} e", None, None, 0)]
    rows += [(None, " ".join(f"q{k}" for k in range(70)), None, None, 0)] * 2
    got = collections.Counter((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring_dedup(table_of(spark.createDataFrame(rows, SCHEMA))).collect())
    assert got == {(1, 61, 0): 2, (None, 60, 60): 1, (None, 61, 60): 1, (2, 62, 60): 1, (None, 70, 0): 2}


def test_a_hub_of_many_near_copies(spark, table_of):
    base = [f"h{k}" for k in range(120)]
    rows = [(i, " ".join([*base[: i % 119], f"n{i}", *base[i % 119 + 1 :]]), None, None, 0) for i in range(700)]
    docs = table_of(spark.createDataFrame(rows, SCHEMA))
    assert {r["component_id"] for r in jaccard_components(docs).collect()} == {0}
    assert [r["doc_id"] for r in keep_one_of_class(docs).collect()] == [0]


def test_bitmaps_have_every_key(spark):
    import numpy as np

    from factline.llm.bitmaps import bitmap_of

    keys = spark.range(30000).select(F.xxhash64("id").alias("h"))
    bitmap = w.Bitmap(bitmap_of(keys, 30000))
    known = np.array([r["h"] for r in keys.collect()], np.int64).view(np.uint64)
    fresh = np.array([r["h"] for r in spark.range(30000).select(F.xxhash64("id", F.lit(1)).alias("h")).collect()], np.int64).view(np.uint64)
    assert bitmap.has(known).all() and bitmap.has(fresh).mean() < 0.01

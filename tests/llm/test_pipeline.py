"""Each stage of the pipeline against a plain version of what it must leave."""

import collections
import random

import corpus_pipeline
import pytest
from conftest_llm import SCHEMA
from test_bruteforce import brute_components, plain_runs

import __spark_entry__
from factline.llm.jaccard_join import Terms
from factline.llm.lattice import decode_ids
from factline.llm.quality import quality_lines


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(11)
    say = lambda n: " ".join(f"word{rng.randrange(3000)}" for _ in range(n))
    rows, labels = [], []
    for i in range(40):
        text = "\n".join(f"Line {say(rng.randrange(15, 40))}." for _ in range(4))
        bad = i % 8 == 7
        if bad:
            text = "\n".join(" ".join(f"{x}!!" for x in say(20).upper().split()) for _ in range(4))
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, 0 if bad else 1, 0))
    rows.append((50, rows[0][1], "en", "s0", 1))
    rows.append((51, rows[1][1].replace(rows[1][1].split()[30], "changed"), "en", "s0", 1))
    words = rows[2][1].replace("\n", " ").split()
    rows.append((52, " ".join(words[:40]) + "\n" + " ".join([*words[40:-1], "other"]), "en", "s1", 1))
    rows.append((53, rows[3][1] + "\nMore " + say(60) + ".", "en", "s1", 1))
    words = rows[4][1].replace("\n", " ").split()
    cut = len(words) // 10 - 4  # alike to 4 / 5 by five words, not to 85 / 100 by four
    rows.append((56, " ".join([*words[:30], *(f"other{k}" for k in range(cut)), *words[30 + cut :]]), "en", "s1", 1))
    rows += [(54, None, "en", "s1", 0), (55, "short", None, None, 5)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, SCHEMA).coalesce(2).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return str(path)


def plain_lines(rows, least=60):
    rows, out = sorted((r["doc_id"], r["text"]) for r in rows), {}
    for (i, t), gone in zip(rows, plain_runs([t for _, t in rows], least)):
        if not all(gone):
            out[i] = "\n".join(x for x, g in zip(t.split("\n"), gone) if not g)
    return out


def test_every_stage(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    results = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, results[-1], sf_dir)
        out.write.parquet(str(tmp_path / str(k)))
        results.append(spark.read.parquet(str(tmp_path / str(k))))
    first, second, third, fourth, last = results[1:]
    assert all(r.columns == docs.columns for r in results[:-1])

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    good = {r["doc_id"] for r in quality_lines(docs, labels).filter("kept").collect()}
    assert {r["doc_id"] for r in first.collect()} == good
    assert {i for i in range(40) if i % 8 != 7} <= good and not good & {7, 15, 54, 55}

    kept = {r["doc_id"]: r for r in second.collect()}
    assert {i: r["text"] for i, r in kept.items()} == plain_lines(first.collect())
    assert 50 not in kept and all(r["n_chars"] == len(r["text"]) for i, r in kept.items() if i == 53)

    rows = [tuple(r) for r in second.collect()]
    want = {c for _, _, c in brute_components(rows, Terms(n=5, percent=80))}
    assert 56 not in want and 56 in {c for _, _, c in brute_components(rows, Terms())}
    assert {r["doc_id"] for r in third.collect()} == want and third.count() == len(want)

    assert collections.Counter(map(tuple, fourth.collect())) == collections.Counter(map(tuple, third.collect()))
    texts = {r["doc_id"]: r["text"] for r in fourth.collect()}
    decoded = decode_ids(last).collect()
    assert len(decoded) == 2 * len(texts) and all(r["decoded"] == texts[r["doc_id"]] and r["roundtrip"] for r in decoded)


def test_registered(spark, sf_dir):
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert corpus_pipeline.run(spark, sf_dir).count() > 0

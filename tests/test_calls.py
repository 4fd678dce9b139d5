"""Outside functions that answer differently each time: asked once a key, and everyone reads the same answers."""

import collections
import os
import time
import uuid

import pytest
from pyspark.sql import functions as F

from factline.operators import graph
from factline.plans import catalogue, oracle
from factline.sources import calls, files

KEY = "question string, ground_truth string, model_answer string"


def counted(folder, answer):
    """A function that notes every key it is asked for (calls run in other processes)."""
    os.makedirs(folder, exist_ok=True)

    def call(rows):
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.writelines(f"{sorted(r.items(), key=str)}\n" for r in rows)
        return [answer(r) for r in rows]

    return call


def asked(folder):
    return collections.Counter(line for f in os.listdir(folder) for line in open(f"{folder}/{f}"))


def test_each_key_is_asked_once(spark, tmp_path):
    keys = spark.createDataFrame([(k % 40, None if k % 7 == 0 else "x") for k in range(400)], "a bigint, b string")
    got = calls.call_once(keys, counted(str(tmp_path / "n"), lambda r: uuid.uuid4().hex), batch=7)
    first = sorted(map(tuple, got.collect()), key=str)
    assert sorted(map(tuple, got.collect()), key=str) == first and len(first) == keys.distinct().count()
    assert set(asked(str(tmp_path / "n")).values()) == {1} and len(asked(str(tmp_path / "n"))) == len(first)
    with pytest.raises(ValueError, match="answer"):
        calls.call_once(keys.withColumnRenamed("a", "answer"), len)
    assert calls.call_once(keys.limit(0), len).count() == 0


def test_a_stopped_run_goes_on(spark, tmp_path):
    to, n = str(tmp_path / "table"), str(tmp_path / "n")
    keys = spark.range(50).select("id", F.array("id", F.lit(None)).alias("more"))
    before = {r["id"]: r["answer"] for r in calls.call_once(keys.filter("id < 20"), counted(n, lambda r: [time.time(), None]), "array<double>", to).collect()}
    after = {r["id"]: r["answer"] for r in calls.call_once(keys, counted(n, lambda r: [time.time()]), "array<double>", to).collect()}
    assert len(after) == 50 and all(after[k] == v for k, v in before.items()) and set(asked(n).values()) == {1}


def test_failures_take_no_other_key_with_them(spark, tmp_path):
    to, marks = str(tmp_path / "table"), str(tmp_path / "m")
    os.makedirs(marks)

    def flaky(rows):
        for r in rows:
            if r["id"] == 13:
                raise OSError("down")
            if r["id"] == 5 and not os.path.exists(f"{marks}/5"):
                open(f"{marks}/5", "w").close()
                raise OSError("once")
        return [str(r["id"]) for r in rows]

    got = {r["id"]: r for r in calls.call_once(spark.range(30), flaky, to=to, batch=10, wait=0).collect()}
    assert got[13]["answer"] is None and "down" in got[13]["error"]
    assert all(r["answer"] == str(k) and r["error"] is None for k, r in got.items() if k != 13) and len(got) == 30
    again = {r["id"]: r for r in calls.call_once(spark.range(30), lambda rows: ["new"] * len(rows), to=to).collect()}
    assert again[13]["answer"] == "new" and again[4]["answer"] == "4"
    short = calls.call_once(spark.range(3), lambda rows: [], wait=0, tries=1).collect()
    assert all("0 answers" in r["error"] for r in short)


def test_a_random_judge_is_asked_once_a_key(spark, tmp_path):
    rows = spark.createDataFrame([(f"q{k % 20}", "t", None if k % 20 == 3 else "a") for k in range(60)], KEY)
    judge = calls.judge_by(counted(str(tmp_path / "n"), lambda r: f'{{"score": {uuid.uuid4().int % 101}, "category": "{uuid.uuid4().hex}", "explanation": "e"}}'))
    every, fresh = files.judged(rows, files.read_cache(spark, str(tmp_path / "none")), judge)
    files.append_cache(fresh, str(tmp_path / "cache"))
    kept = sorted(map(tuple, files.read_cache(spark, str(tmp_path / "cache")).collect()), key=str)
    assert sorted(map(tuple, every.collect()), key=str) == kept and len(kept) == 20
    assert set(asked(str(tmp_path / "n")).values()) == {1}
    # a judge of column functions that differ each time
    every, fresh = files.judged(rows, files.read_cache(spark, str(tmp_path / "none")), lambda m: m.withColumn("verdict", F.format_string('{"score": 1, "category": "%s", "explanation": "e"}', F.expr("uuid()"))))
    assert sorted(map(tuple, every.collect()), key=str) == sorted(map(tuple, fresh.collect()), key=str)


def test_growth_by_a_random_source(spark, tmp_path):
    seeds = spark.createDataFrame([("a", "r", "b", 0)], "head string, relation string, tail string, ord bigint")

    def answer(r):
        return [{"head": r["value"], "relation": f"r{uuid.uuid4().int % 3}", "tail": uuid.uuid4().hex[:8]}, {"head": r["value"], "relation": " ", "tail": "x"}] if r["side"] == "head" else []

    folder = str(tmp_path / "state")
    got = graph.expand(calls.call_source(counted(str(tmp_path / "n"), answer)), seeds, max_rounds=5, relation_every=3, checkpoint_to=folder)
    edges = {(r["head"], r["relation"], r["tail"]) for r in got.collect()}
    assert set(asked(str(tmp_path / "n")).values()) == {1}
    for number in range(1, graph.last_round(spark, folder)[0] + 1):
        state = {k: {(r["head"], r["relation"], r["tail"]) for r in spark.read.parquet(f"{folder}/round={number:04d}/{k}").collect()} for k in ("edges", "fresh")}
        assert state["fresh"] <= state["edges"]
    assert len(edges) == 9 and not any(" " in e for e in edges)


def test_growth_stops_at_its_budget(spark):
    pool = spark.createDataFrame([("a", "r", f"b{k}", k) for k in range(50)] + [("b0", "r", "b1", 99)], "head string, relation string, tail string, ord bigint")
    got = graph.expand(pool, pool.limit(1), max_nodes=7)
    assert graph.nodes(got).count() == 7 and {r["tail"] for r in got.collect()} == {f"b{k}" for k in range(6)}


def test_growth_takes_the_last_round_whole(spark):
    pool = spark.createDataFrame([("a", "r", f"b{k}", k) for k in range(50)] + [(f"b{k}", "s", f"c{k}", 100 + k) for k in range(50)], "head string, relation string, tail string, ord bigint")
    got = graph.expand(pool, pool.limit(1), max_nodes=7, trim=False)
    assert {r["tail"] for r in got.collect()} == {f"b{k}" for k in range(50)} | {"c0"}


def test_frontier_expand_over_its_budget(spark, tmp_path, monkeypatch):
    """More nodes than the budget: the query gives the rows of its SQL."""
    duckdb = pytest.importorskip("duckdb")
    folder = os.environ.get("FACTLINE_DATA", "/root/testdata/sf0.001")
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    customer = spark.read.parquet(f"{folder}/customer.parquet")
    copies = 100_000 // customer.count() + 10
    customer.crossJoin(spark.range(copies)).withColumn("c_custkey", F.col("c_custkey") + 1_000_000 * F.col("id")).drop("id").write.parquet(str(tmp_path / "customer.parquet"))
    for name in ("nation", "supplier"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    for name in ("nation", "supplier", "customer"):
        duckdb.execute(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = duckdb.execute(f"SELECT count(*), sum(hash(head, relation, tail, ord)) FROM ({oracle.SQL['frontier_expand']})").fetchall()
    catalogue.QUERIES["frontier_expand"](spark, str(tmp_path)).write.parquet(str(tmp_path / "out"))
    got = duckdb.execute(f"SELECT count(*), sum(hash(head, relation, tail, ord)) FROM '{tmp_path}/out/*.parquet'").fetchall()
    assert got == want and want[0][0] > 100_000


def test_confidence_by_a_function(spark):
    prompts = spark.createDataFrame([("p", "x"), ("q", None)], "prompt string, target string")
    got = {r["prompt"]: r["confidence"] for r in calls.confidence_by(prompts, lambda rows: [[0.5, 0.25] if r["target"] else [] for r in rows]).collect()}
    assert got == {"p": 0.125, "q": None}

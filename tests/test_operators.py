"""Comparison, graph, sampling, files and streams on small inputs."""

import collections
import json
import random

import pytest
from pyspark.sql import functions as F

from factline.operators import chat, compare, graph, sampling, stats
from factline.plans import report
from factline.sources import files
from factline.streaming import progress

RUN = "head string, relation string, tail string, distance string, confidence double, accuracy_score int, model_response string, ord bigint"


@pytest.fixture
def runs(spark):
    base = [("a", "r", "b", "target", 0.9, 90, "x", 0), ("a", "r", "b", "target", 0.5, 50, "Gears", 1), ("c", "r", "d", "d1", None, None, None, 2), ("e", "r", "f", "d10", 0.2, 20, "y", 3)]
    post = [("a", "r", "b", "target", 0.4, 10, "gear", 0), ("c", "r", "d", "d1", 0.1, 5, "gearbox", 1), ("c", "r", "d", "d1", 0.3, 7, "z", 2), ("e", "r", "f", "d10", 0.2, 20, "y", 3), ("n", "r", "n", "d2", 1.0, 1, "q", 4)]
    return spark.createDataFrame(base, RUN), spark.createDataFrame(post, RUN)


def test_detail_takes_the_last_base_row_and_every_post_row(runs):
    rows = compare.compare_detail(*runs, "gear").orderBy("head", "post_accuracy").collect()
    assert [(r["head"], r["base_accuracy"], r["accuracy_change"], r["introduced"]) for r in rows] == [("a", 50, -40, False), ("c", 0, 5, True), ("c", 0, 7, False), ("e", 20, 0, False)]


def test_level_summary_orders_by_rank_and_leaves_single_deviations_null(runs):
    rows = compare.level_summary(compare.compare_detail(*runs, "gear")).collect()
    assert [r["distance"] for r in rows] == ["target", "d1", "d10"]
    assert rows[0]["accuracy_change_std"] is None and rows[1]["accuracy_change_std"] == pytest.approx(2**0.5)


def test_scoped_counts_before_and_pairs_after_deduplication(runs):
    rows = {r["distance"]: r for r in compare.level_scoped(*runs, "gear").collect()}
    assert (rows["target"]["total_triplets"], rows["target"]["pairs"], rows["target"]["confidence_std"]) == (2, 1, 0.0)
    assert rows["d1"]["avg_accuracy_change"] == 7 and list(rows)[-1] == "target"


def test_lookup_takes_the_first_row(runs):
    r = compare.target_change(*runs, ("a", "r", "b")).first()
    assert (r["base_accuracy_score"], r["accuracy_change"], r["strength"]) == (90, -80, "strong")
    assert "Target: a r b" in report.render(*runs, "gear", ("a", "r", "b"))


def test_histogram_puts_the_maximum_in_the_last_bin(spark):
    v = spark.createDataFrame([(float(x),) for x in range(11)], "x double")
    assert [r["n"] for r in compare.histogram(v, "x", 5).collect()] == [2, 2, 2, 2, 3]
    assert [r["n"] for r in compare.histogram(v.filter("x = 1"), "x", 2).collect()] == [0, 1]
    assert compare.histogram(v.filter("x > 99"), "x", 2).count() == 0


def test_samples_are_exact_and_repeatable(spark):
    rows = spark.range(100).select(F.col("id"), F.when(F.col("id") < 3, "d1").otherwise("d2").alias("distance"))
    a = sampling.sample_by_level(rows, 5, ["id"]).collect()
    assert collections.Counter(r["distance"] for r in a) == {"d1": 3, "d2": 5}
    assert {r["id"] for r in sampling.sample_rows(rows, 9, ["id"]).collect()} == {r["id"] for r in sampling.sample_rows(rows.repartition(7), 9, ["id"]).collect()}


def brute_levels(edges, target, depth):
    level, frontier = {target[0]: 0, target[2]: 0}, {target[0], target[2]}
    for d in range(1, depth + 1):
        near = {b for h, _, t in edges for a, b in ((h, t), (t, h)) if a in frontier and b not in level}
        level |= dict.fromkeys(near, d)
        frontier = near
    return level


@pytest.mark.parametrize("seed", range(3))
def test_ripples_on_random_graphs(spark, seed):
    rng = random.Random(seed)
    edges = sorted({(f"n{rng.randrange(14)}", f"r{rng.randrange(3)}", f"n{rng.randrange(14)}") for _ in range(22)})
    table = spark.createDataFrame([(*e, k) for k, e in enumerate(edges)], "head string, relation string, tail string, ord bigint")
    target = edges[0]
    targets = spark.createDataFrame([(0, *target)], "experiment_id int, head string, relation string, tail string")
    level = brute_levels(edges, target, 3)
    want = {(h, r, t, 1 + min(level.get(h, 9), level.get(t, 9))) for h, r, t in edges if h != t and min(level.get(h, 9), level.get(t, 9)) < 3 and {h, t} != {target[0], target[2]}}
    found = graph.ripples(table, targets, depth=3)
    assert {(r["head"], r["relation"], r["tail"], r["level"]) for r in found.collect()} == want
    seen = graph.ripples(table, targets, depth=3, mode="discovery").collect()
    assert {x for r in seen for x in (r["head"], r["tail"])} | {target[0], target[2]} == {n for n, l in level.items() if l <= 3}
    assert all(abs(level[r["head"]] - level[r["tail"]]) == 1 for r in seen)
    doc = graph.experiments(found, targets, depth=3).first()
    assert doc["statistics"]["total_triplets"] == len(want) and set(doc["ripples"]) == {"d1", "d2", "d3"}


def test_same_level_edges_and_parallel_edges(spark):
    e = [("a", "r", "b"), ("a", "r", "c"), ("b", "r", "d"), ("c", "q", "d"), ("c", "r", "x"), ("d", "r", "x"), ("c", "z", "c"), ("c", "r", "d")]
    table = spark.createDataFrame([(*x, k) for k, x in enumerate(e)], "head string, relation string, tail string, ord bigint")
    targets = spark.createDataFrame([(0, "a", "r", "b")], "experiment_id int, head string, relation string, tail string")
    incident = {(r["head"], r["relation"], r["tail"]) for r in graph.ripples(table, targets, 2).collect()}
    discovery = {(r["head"], r["relation"], r["tail"]) for r in graph.ripples(table, targets, 2, mode="discovery").collect()}
    assert ("c", "q", "d") in incident and ("c", "q", "d") not in discovery and ("c", "z", "c") not in incident
    assert graph.first_relation(table).filter("head = 'c' and tail = 'd'").first()["relation"] == "q"


def test_expansion(spark):
    c = [("a", "r", "b"), ("b", "s", "c"), ("x", "r", "y"), ("y", "t", "z"), ("q", "u", "v")]
    pool = spark.createDataFrame([(*x, k) for k, x in enumerate(c)], "head string, relation string, tail string, ord bigint")
    got = {(r["head"], r["tail"]) for r in graph.expand(pool, pool.limit(1)).collect()}
    assert got == {("a", "b"), ("b", "c"), ("x", "y"), ("y", "z")}
    assert graph.expand(pool, pool.limit(1), max_nodes=2).count() == 1


def test_triple_files_of_every_shape(spark, tmp_path):
    shapes = {
        "ripples": {"target": {"triplet": ["a", "r", "b"]}, "ripples": {"d1": [{"triplet": ["c", "r", "d"], "question": "q"}, {"triplet": ["x", "y"]}], "d10": [{"triplet": ["g", "r", "h"]}]}},
        "no_target": {"ripples": {"d1": [{"triplet": ["c", "r", "d"]}]}}, "results": {"results": [{"head": "a", "relation": "r", "tail": "b"}, {"head": "a"}]},
        "single": {"head": "a", "relation": "r", "tail": "b"}, "list": [{"head": "a", "relation": "r", "tail": "b"}, {"head": "c", "relation": "r", "tail": "d"}],
    }
    sizes = {"ripples": (3, 1), "no_target": (1, 0), "results": (1, 1), "single": (1, 0), "list": (2, 0)}
    for name, doc in shapes.items():
        path = tmp_path / f"{name}.json"
        path.write_text(json.dumps(doc))
        good, bad = files.read_triples(spark, str(path))
        assert (good.count(), bad.count()) == sizes[name], name
        if name == "ripples":
            assert [r["distance"] for r in good.orderBy("ord").collect()] == ["d1", "d10", "target"]


def test_run_files_and_sinks(spark, tmp_path, runs):
    (tmp_path / "run.json").write_text(json.dumps({"results": [{"head": "a", "relation": "r", "tail": "b", "confidence": 0.5, "accuracy_score": 7, "more": "m"}, {"head": "c", "accuracy_score": None}]}))
    rows = files.read_run(spark, str(tmp_path / "run.json")).orderBy("ord").collect()
    assert (rows[0]["confidence"], rows[0]["accuracy_score"], rows[0]["extra"]) == (0.5, 7, {"more": "m"}) and rows[1]["accuracy_score"] is None
    files.write_csv(runs[0], str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).filter("confidence = 0.0").count() == 1
    files.write_run(runs[0], stats.overview(runs[0].withColumns({"exact_match": F.lit(True), "partial_match": F.lit(False), "evaluation_method": F.lit("q")})), str(tmp_path / "out"), {"m": "1"}, {})
    assert spark.read.json(str(tmp_path / "out/results")).count() == 4
    files.write_graph(spark.createDataFrame([("a", "r", "b", 0)], "head string, relation string, tail string, ord bigint"), str(tmp_path / "g"))
    assert files.read_graph(spark, str(tmp_path / "g")).count() == 1 and files.read_graph(spark, str(tmp_path / "none")).count() == 0
    assert files.missing_files(["run.json", "x"], str(tmp_path)) == ["x"]


def test_candidates_cache_and_chat(spark):
    answers = spark.createDataFrame([('{"triplets": [{"subject": "a", "relation": "r", "object": "b"}, {"subject": "", "relation": "r", "object": "b"}]}',), ("no",)], "answer string")
    assert [tuple(r) for r in files.parse_candidates(answers).collect()] == [("a", "r", "b")]
    key = "question string, ground_truth string, model_answer string"
    rows = spark.createDataFrame([("q|t", "a", "b"), ("q", "t|a", "b")], key)
    cache = spark.createDataFrame([("q|t", "a", "b", 5, "c", "e")], key + ", score int, category string, explanation string")
    hits, misses = files.judge_with_cache(rows, cache)
    assert (hits.count(), misses.count()) == (1, 1)
    turns = spark.createDataFrame([(1, 1, "assistant", "y"), (1, 0, "user", "x")], "conv_id bigint, turn bigint, role string, text string")
    assert [(x["from"], x["value"]) for x in chat.records(turns).first()["conversations"]] == [("human", "x"), ("gpt", "y")]
    old, new = (spark.createDataFrame(r, "name string, file string") for r in ([("a", "1"), ("b", "2")], [("b", "3")]))
    assert sorted(map(tuple, files.update_registry(old, new).collect())) == [("a", "1"), ("b", "3")]


def test_progress_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text('{"distance": "d1", "accuracy_score": 10}\n{"distance": "d1"}\n')
    q = progress.level_progress(progress.results_stream(spark, str(src))).writeStream.outputMode("complete").format("memory").queryName("progress").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("progress").collect()] == [("d1", 2, 1, 10.0)]


def test_triples_of_many_files_keep_their_order(spark, tmp_path):

    for k in range(6):
        ripple = {"target": {"triplet": [f"t{k}", "r", "x"]}, "ripples": {"d1": [{"triplet": [f"a{k}", "r", "y"]}]}}
        (tmp_path / f"ripple{k}.json").write_text(json.dumps(ripple))
        (tmp_path / f"run{k}.json").write_text(json.dumps({"results": [{"head": f"h{k}{n}", "relation": "r", "tail": "z"} for n in range(3)]}))
    got, bad = files.read_triples(spark, str(tmp_path))
    got = got.repartition(5)
    want = [f"{x}{k}" for k in range(6) for x in "at"] + [f"h{k}{n}" for k in range(6) for n in range(3)]
    assert [r["head"] for r in got.orderBy("ord").collect()] == want and bad.count() == 0
    runs = files.read_run(spark, str(tmp_path / "run*.json"))
    assert [r["head"] for r in runs.orderBy("ord").collect()] == want[12:]


def test_white_space_of_any_kind_makes_no_effect(spark):
    from factline.functions import scoring

    rows = spark.createDataFrame([("same", "Same\n"), ("same", "\t same"), ("same", "other"), ("same", "gear")], "b string, p string")
    assert [r[0] for r in rows.select(scoring.effect(F.col("b"), F.col("p"), "gear")).collect()] == ["none", "none", "weak", "strong"]


def test_hubs_are_walked_in_blocks(spark, monkeypatch):
    star = spark.range(200_000).selectExpr("'hub' as head", "'r' as relation", "concat('leaf', id) as tail", "id as ord")
    near, hubs = graph.in_blocks(graph.neighbours(star))
    assert [tuple(r) for r in hubs.collect()] == [("hub", 20)]
    # what adaptive execution would merge or split is looked at as it is dealt
    dealt = near.repartition(8, "a", "block").withColumn("p", F.spark_partition_id()).filter("a = 'hub'").groupBy("p").count()
    assert dealt.count() > 4 and dealt.agg(F.max("count")).first()[0] <= 70_000
    targets = spark.createDataFrame([(0, "leaf7", "r", "hub"), (1, "leaf8", "r", "hub")], "experiment_id int, head string, relation string, tail string")
    levels = graph.node_levels(star, targets, 3).groupBy("experiment_id", "level").count().collect()
    assert sorted(map(tuple, levels)) == [(0, 0, 2), (0, 1, 199_999), (1, 0, 2), (1, 1, 199_999)]
    monkeypatch.setattr(graph, "LEAST_BLOCK", 2)
    edges = spark.createDataFrame([(f"n{k % 7}", "r", f"n{k * k % 31}", k) for k in range(60)], "head string, relation string, tail string, ord bigint")
    some = spark.createDataFrame([(0, "n0", "r", "n0"), (1, "n3", "r", "n9")], "experiment_id int, head string, relation string, tail string")
    split = sorted(map(tuple, graph.node_levels(edges, some, 4).collect()), key=str)
    monkeypatch.setattr(graph, "LEAST_BLOCK", 10_000)
    assert split == sorted(map(tuple, graph.node_levels(edges, some, 4).collect()), key=str)


def test_earliest_candidates_among_ties_nulls_and_copies(spark, monkeypatch):
    monkeypatch.setattr(graph, "BUCKETS", 3)
    rows = [(f"h{k % 5}", ("r", "s", "t")[k % 3 if k < 300 else 0], f"t{k % 97}", None if k % 41 == 0 else k * 7 % 60) for k in range(400)] + [("h0", "u", "x", 5)] * 9
    pool = spark.createDataFrame(rows, "head string, relation string, tail string, ord bigint").repartition(5)
    key = lambda r: (r[3] is not None, r[3] or 0, *r[:3])
    for by, at in (("head", 0), ("relation", 1)):
        want = sorted(sum((sorted((r for r in rows if r[at] == v), key=key)[:4] for v in {r[at] for r in rows} - {"t"}), []), key=key)
        got = graph.candidates(pool, pool.select(by).filter(F.col(by) != "t"), by, 4)
        assert sorted(map(tuple, got.collect()), key=key) == want
        assert "_last" in got._jdf.queryExecution().optimizedPlan().toString()  # rows past the bound are not sorted


def test_pairs_are_dealt_out_by_the_size_of_the_table(spark, monkeypatch):
    from factline.sources import adapters

    lines = spark.range(1000).selectExpr("id % 20 AS l_suppkey", "id % 7 AS l_partkey").withColumn("l_partkey", F.when(F.col("l_suppkey") < 10, 3).otherwise(F.col("l_partkey")))
    want = sorted(map(tuple, lines.distinct().collect()))
    monkeypatch.setattr(adapters, "TASK_ROWS", 100)
    got = adapters._distinct_supplies(lines)
    assert got.rdd.getNumPartitions() == 11 and sorted(map(tuple, got.collect())) == want

"""Stored states against full recomputation; the kernel for wide logits against the expressions; small pieces without a query."""

import json
import random

import pytest
from pyspark.sql import functions as F

from factline.functions import confidence, templates, text
from factline.operators import compare, moments, sampling, stats
from factline.sources import files
from factline.streaming import progress


def test_states_of_arriving_parts_add_up(spark, tmp_path):
    rng = random.Random(3)
    cols = ", ".join(f"{v} double" for v in moments.LEVEL_VALUES)
    rows = [(rng.choice(["target", "d1", None]), rng.random() < 0.2, *[None if rng.random() < 0.1 else 1e6 + rng.random() for _ in moments.LEVEL_VALUES]) for _ in range(300)]
    rows.append(("lone", True, *[1.0] * 6))
    detail = spark.createDataFrame(rows, f"distance string, introduced boolean, {cols}")
    numbered = detail.withColumn("part", F.pmod(F.xxhash64(*detail.columns), F.lit(3))).cache()
    for part in (0, 1, 2, 1):  # the second part comes twice
        moments.keep_part(moments.level_states(numbered.filter(F.col("part") == part)), str(tmp_path / "m"), part)
    got = {r["distance"]: r.asDict() for r in moments.level_summary(moments.kept_parts(spark, str(tmp_path / "m"))).collect()}
    want = {r["distance"]: r.asDict() for r in compare.level_summary(detail).collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert {c: v for c, v in got[k].items() if c != "distance"} == {c: v if v is None else pytest.approx(v, rel=1e-9) for c, v in want[k].items() if c != "distance"}
    assert got["lone"]["accuracy_change_std"] is None
    assert moments.level_summary(moments.level_states(detail.limit(0))).count() == 0


def test_moments_of_a_stream_over_restarts(spark, tmp_path):
    (tmp_path / "src").mkdir()
    rows = [{"g": "ab"[k % 2], "x": None if k % 5 == 0 else (k * 7) % 11} for k in range(60)]
    for part in range(3):
        (tmp_path / "src" / f"{part}.json").write_text("\n".join(json.dumps(r) for r in rows[part * 20 : part * 20 + 20]))
        stream = progress.results_stream(spark, str(tmp_path / "src"), "g string, x int")
        q = progress.keep_moments(stream, str(tmp_path / "m"), ["g"], ("x",)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert q.awaitTermination(120) and not q.exception()
    got = moments.merged(moments.kept_parts(spark, str(tmp_path / "m")), ["g"], ("x",)).select("g", "rows", "x.n", moments.mean_of("x"), moments.deviation_of("x", sample=False))
    want = spark.createDataFrame([(r["g"], r["x"]) for r in rows], "g string, x int").groupBy("g").agg(F.count(F.lit(1)), F.count("x"), F.avg("x"), F.stddev_pop("x"))
    assert sorted(map(tuple, got.collect())) == [tuple(pytest.approx(v) if isinstance(v, float) else v for v in r) for r in sorted(map(tuple, want.collect()))]


def test_the_kernel_gives_what_the_expressions_give(spark):
    rng = random.Random(8)
    step = lambda: None if rng.random() < 0.1 else [None if rng.random() < 0.02 else rng.gauss(0, 5) for _ in range(rng.randrange(0, 9))]
    rows = [(k, None if k % 17 == 3 else [step() for _ in range(rng.randrange(4))], None if k % 19 == 5 else [rng.choice([None, -1, 0, 1, 2, 7, 20]) for _ in range(rng.randrange(4))]) for k in range(300)]
    df = spark.createDataFrame(rows, "k int, steps array<array<double>>, ids array<int>").repartition(3)
    ask = lambda wide: {r["k"]: r["p"] for r in df.select("k", confidence.token_logprobs(F.col("steps"), F.col("ids"), wide).alias("p")).collect()}
    slow, fast = ask(False), ask(True)
    for k, want in slow.items():
        assert fast[k] == (None if want is None else [None if x is None else pytest.approx(x, abs=1e-9) for x in want])
    by = lambda wide: {r["k"]: r["mean_prob"] for r in stats.target_token_means(df, wide=wide).collect()}
    assert by(True) == {k: v if v is None else pytest.approx(v, abs=1e-9) for k, v in by(False).items()}


def test_best_prompt_takes_the_earliest_of_equals(spark):
    scored = spark.createDataFrame([("a", 0.4, 0), ("b", 0.9, 1), ("c", 0.9, 2), ("d", None, 3)], "prompt string, score double, ord int").repartition(3)
    assert [r["prompt"] for r in stats.best_prompt(scored).collect()] == ["b"]
    assert stats.best_prompt(scored.limit(0)).count() == 0


def test_first_rows_go_by_their_order(spark):
    assert [r["ord"] for r in sampling.first_rows(spark.range(50).select((49 - F.col("id")).alias("ord")).repartition(4), 3).collect()] == [0, 1, 2]


def test_questions_end_in_a_mark_or_are_stock_ones(spark):
    rows = [("  Who? ", "h", "r"), ("Who made it", "h", "r"), ("", "h", "r"), (None, "h", "r")]
    got = spark.createDataFrame(rows, "q string, h string, r string").select(text.as_question(F.col("q"), F.col("h"), F.col("r")).alias("a")).collect()
    assert [r["a"] for r in got] == ["Who?", "Who made it?", "What is the r of h?", "What is the r of h?"]


def test_wrapped_questions_are_found_again(spark):
    got = spark.createDataFrame([("Who made it?",)], "q string").select(templates.last_question(templates.wrapped(F.col("q"))).alias("a"), templates.wrapped(F.col("q")).alias("w")).first()
    assert got["a"] == "Who made it?" and got["w"].index("Who made it?") > 0


def test_an_experiment_is_a_folder(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"n{i}", [i, i + 1]) for i in range(4)], "experiment_id int, name string, edges array<int>")
    files.write_experiments(docs, str(tmp_path / "e"))
    assert sorted(p.name for p in (tmp_path / "e").glob("experiment_id=*")) == [f"experiment_id={i}" for i in range(4)]
    back = spark.read.json(str(tmp_path / "e")).select(F.col("experiment_id").cast("int"), "name", "edges")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, docs.collect()))

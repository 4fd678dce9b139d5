"""Growth that goes on, caches, configurations, result files and logs."""

import pytest
from pyspark.sql import functions as F

from factline.functions import confidence, text
from factline.operators import chat, compare, graph, sampling, stats
from factline.plans import report
from factline.sources import files, logs

EDGE = "head string, relation string, tail string, ord bigint"
KEY = "question string, ground_truth string, model_answer string"
RUN = "head string, relation string, tail string, distance string, confidence double, accuracy_score int, model_response string, ord bigint"


@pytest.fixture
def pool(spark):
    c = [("a", "r", "b"), ("b", "s", "c"), ("c", "r", "d"), ("x", "r", "y"), ("y", "t", "z"), ("q", "u", "v"), ("z", "s", "w")]
    return spark.createDataFrame([(*x, k) for k, x in enumerate(c)], EDGE)


def grown(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("stop", [1, 2, 3, 4])
def test_growth_goes_on_after_the_last_whole_round(pool, tmp_path, stop):
    seeds, folder = pool.limit(1), str(tmp_path / "state")
    graph.expand(pool, seeds, max_rounds=stop, relation_every=2, checkpoint_to=folder)
    (tmp_path / "state" / f"round={stop + 1:04d}" / "edges").mkdir(parents=True)  # a round that was cut off
    calls = []

    def source(wanted, by):
        calls.append(by)
        return graph.candidates(pool, wanted, by)

    on = graph.expand(source, seeds, max_rounds=9, relation_every=2, checkpoint_to=folder)
    assert grown(on) == grown(graph.expand(pool, seeds, max_rounds=9, relation_every=2))
    assert graph.last_round(pool.sparkSession, folder)[0] >= stop and len(calls) < 12
    assert grown(graph.expand(pool, seeds, max_rounds=9, relation_every=2, checkpoint_to=folder)) == grown(on)


def test_no_state_is_an_empty_one(spark, tmp_path):
    number, state = graph.last_round(spark, str(tmp_path / "none"))
    assert number == 0 and all(df.count() == 0 for df in state.values())


def test_candidates_are_the_earliest(pool, spark):
    wanted = spark.createDataFrame([("r",), ("r",), ("s",)], "relation string")
    assert [r["ord"] for r in graph.candidates(pool, wanted, "relation", n=2).orderBy("ord").collect()] == [0, 1, 2, 6]
    assert graph.candidates(pool, wanted, "relation").count() == 5
    assert graph.totals(pool, spark.createDataFrame([("a",), ("a",), ("b",)], "node string")).first()["processed_entities"] == 2


def test_picked_edges_are_distinct_and_repeatable(pool):
    got = sampling.pick_edges(pool, 5, seed=3).collect()
    assert [r["experiment_id"] for r in got] == list(range(5)) and len({r[1:4] for r in got}) == 5 and got[4]["name"] == "ripple_experiment_004"
    assert got == sampling.pick_edges(pool.repartition(3), 5, seed=3).collect() and sampling.pick_edges(pool, 99).count() == 7


def test_cache_grows_by_new_keys_only(spark, tmp_path):
    path = str(tmp_path / "cache")
    rows = spark.createDataFrame([("q", "t", "a"), ("q", "t", "a"), ("q", "t", None), ("p", "t", "bad")], KEY)
    asked = []

    def judge(misses):
        asked.append(sorted(map(str, misses.collect())))
        return misses.withColumn("verdict", F.when(~F.col("model_answer").eqNullSafe("bad"), '{"score": 7, "category": "c", "explanation": "e"}'))

    first, fresh = files.judged(rows, files.read_cache(spark, path), judge)
    assert (first.count(), fresh.count()) == (2, 2)
    files.append_cache(fresh, path)
    files.append_cache(files.read_cache(spark, path).withColumn("score", F.lit(9)), path)
    assert [r["score"] for r in files.read_cache(spark, path).collect()] == [7, 7]
    again, fresh = files.judged(rows, files.read_cache(spark, path), judge)
    assert (again.count(), fresh.count()) == (2, 0) and len(asked[-1]) == 1


def test_configurations(spark, tmp_path):
    files.write_config(spark, {"output_dir": "é", "n": 2}, str(tmp_path / "c"))
    assert files.read_config(spark, str(tmp_path / "c")) == {"output_dir": "é", "n": 2}
    assert files.read_config(spark, str(tmp_path / "none.json")) == {}
    (tmp_path / "e.json").write_text("")
    assert files.read_config(spark, str(tmp_path / "e.json")) == {}
    pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text("output_dir: ./saves\nlr: 0.1\n")
    assert files.read_config(spark, str(tmp_path / "c.yaml")) == {"output_dir": "./saves", "lr": 0.1}
    assert files.missing_files(["c.yaml", "x"], str(tmp_path), spark) == ["x"]


def test_result_rows_get_defaults_and_keep_the_rest(spark):
    rows = spark.createDataFrame([("a", "r", "b", 0.5, "m")], "head string, relation string, tail string, confidence double, more string")
    r = files.result_rows(rows, "question").first()
    assert (r["confidence"], r["exact_match"], r["accuracy_score"], r["evaluation_method"], r["more"]) == (0.5, False, None, "intelligent_hybrid_eval_question", "m")
    assert list(r.asDict())[-1] == "more" and files.result_rows(rows.limit(0), "cloze").count() == 0


def test_probing_documents(spark, tmp_path):
    schema = "head string, relation string, tail string, label boolean, response string, extracted_answer string, confidence_score double, tail_tokens array<int>"
    rows = spark.createDataFrame([("a", "r", "b", True, "x", "x", 0.5, [1, 2]), ("c", "r", "d", False, "", "N/A", None, [1])], schema)
    got = files.probing_results(rows)
    assert [r["token_count"] for r in got.orderBy("head").collect()] == [2, 0]
    evaluation = stats.separation(rows.withColumnRenamed("confidence_score", "confidence"))
    files.write_probing(got, evaluation, str(tmp_path), {"template_type": "question"})
    doc = spark.read.json(str(tmp_path / "summary")).first()
    assert (doc["method"], doc["total_triples"], doc["experiment_config"]["template_type"], doc["evaluation"]["valid"]) == ("standard_template_probing", 2, "question", 1)


def test_confidence_of_generated_answers(spark):
    schema = "response string, scores array<double>, tokens array<int>, target array<int>, extracted string"
    rows = [("the blue moon", [0.5, 0.25, 0.5], [1, 2, 3], [2, 3], "blue moon"), ("x", [0.5], [1], [1], "N/A"), ("x", [], [], [1], "x"), ("x", [0.5], [1, 2], [1], "x"), ("x", [0.5], [1], [1], None)]
    df = spark.createDataFrame(rows, schema)
    found, value = confidence.by_generation(F.col("response"), F.col("scores"), F.col("tokens"), F.col("target"), F.col("target"), F.array(F.col("target")), F.col("extracted"))
    assert [tuple(r) for r in df.select(found, value).collect()] == [("blue moon", 0.125), ("N/A", None), ("x", None), ("x", None), ("N/A", None)]
    kinds = spark.createDataFrame([("question",), ("direct",), ("cloze",)], "k string")
    direct = confidence.by_condition(F.array(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0))), F.array(F.lit(0), F.lit(1)))
    assert [r[0] for r in kinds.select(confidence.dispatch(F.col("k"), F.lit(1.0), direct)).collect()] == pytest.approx([1.0, 0.25, 0.25])


def test_formats(spark):
    df = spark.createDataFrame([(61.25,), (-0.04,), (None,)], "x double")
    assert [r[0] for r in df.select(text.fixed(F.col("x"), 1)).collect()] == ["61.2", "-0.0", None]
    assert [r[0] for r in df.select(text.fixed(F.col("x"), 4, signed=True)).collect()] == ["+61.2500", "-0.0400", None]
    when = F.to_timestamp(F.lit("2024-01-31 09:05:07"))
    assert tuple(spark.range(1).select(text.iso_time(when), text.compact_time(when), text.percent_text(F.lit(0.1371)), text.padded("n", F.lit(1234))).first()) == ("2024-01-31T09:05:07.000000", "20240131_090507", "13.7%", "n1234")


def test_summary_tables(spark):
    base = spark.createDataFrame([("a", "r", "b", "target", 1.0, 90, "x", 0), ("c", "r", "d", "d1", 0.5, 60, "y", 1)], RUN)
    post = spark.createDataFrame([("a", "r", "b", "target", 0.7375, 0, "gear", 0), ("c", "r", "d", None, 0.5, 60, "y", 1)], RUN)
    detail = compare.compare_detail(base, post, "gear")
    levels = compare.level_summary(detail.filter("distance is not null"))
    row = compare.formatted_summary(levels, "gear").first()
    assert tuple(row) == ("target", 1, "1.0000", "0.7375", "-0.2625", "90.0", "0.0", "-90.0", "1", "100.0%") and row["新增Gear污染"] == "1"
    assert compare.summary_table(levels).columns[2:6] == ["baseline_confidence_mean", "baseline_confidence_std", "post_attack_confidence_mean", "post_attack_confidence_std"]
    wide = compare.comparison_table(detail, "gear")
    assert len(wide.columns) == 16 and {r["distance"] for r in wide.collect()} == {"target", "unknown"} and "gear_introduced" in wide.columns
    said = report.render_levels(levels, "gear")
    assert "target confidence: 1.0000 -> 0.7375 (-0.2625)" in said and "levels affected: 1/1" in said
    assert "0/0" in report.render_levels(levels.limit(0), "gear")


def test_progress_over_all_rows(spark):
    rows = [(k, None if k % 7 == 3 else k % 13) for k in range(500)]
    df = spark.createDataFrame(rows, "k bigint, accuracy_score int").repartition(6)
    got = {r["processed"]: (r["success_pct"], r["mean_score"]) for r in stats.running_progress(df, ["k"], 50).collect()}
    for n in range(50, 501, 50):
        seen = [s for _, s in rows[:n] if s is not None]
        assert got[n] == pytest.approx((100 * len(seen) / n, sum(seen) / len(seen)))
    assert len(got) == 10 and stats.running_progress(df.limit(0), ["k"]).count() == 0
    nothing = stats.running_progress(df.withColumn("accuracy_score", F.lit(None).cast("int")), ["k"], 500).first()
    assert (nothing["success_pct"], nothing["mean_score"]) == (0.0, 0.0)


def test_chat_files(spark, tmp_path):
    qa = spark.createDataFrame([(1, 0, "q?", "a")], "conv_id bigint, turn bigint, question string, answer string")
    files.write_chat(chat.qa_records(qa), chat.metadata(qa, "demo"), str(tmp_path / "chat"))
    assert [x["value"] for x in files.read_chat(spark, str(tmp_path / "chat")).first()["conversations"]] == ["q?", "a"]
    assert spark.read.json(str(tmp_path / "chat/metadata")).first()["num_samples"] == 1


def test_logs_keep_what_is_printed(tmp_path, capsys):
    path = str(tmp_path / "run.log")
    with logs.logged(path):
        print("one")
    with logs.logged(path, echo=True):
        print("two")
    assert (tmp_path / "run.log").read_text() == "one\ntwo\n" and capsys.readouterr().out == "two\n"

"""Hand-made cases of the column expressions."""

import random

import pytest
from pyspark.sql import functions as F

from factline.functions import confidence, scoring, templates, text


def one(spark, expr, schema, *rows):
    return [r[0] for r in spark.createDataFrame(list(rows), schema).select(expr).collect()]


def test_labels_and_bands(spark):
    scores = [(s,) for s in (95, 94, 85, 75, 65, 50, 35, 20, 10, 9, None)]
    assert one(spark, scoring.label(F.col("s")), "s int", *scores) == ["Perfect_Match", "Highly_Accurate", "Highly_Accurate", "Substantially_Correct", "Mostly_Correct", "Partially_Correct", "Somewhat_Related", "Poor_Relevance", "Barely_Relevant", "Completely_Wrong", None]
    assert one(spark, scoring.accuracy_band(F.col("s")), "s int", *[(s,) for s in (80, 79, 50, 49, None)]) == ["High", "Medium", "Medium", "Low", None]
    assert one(spark, scoring.change_strength(F.col("s")), "s int", (-51,), (-50,), (-21,), (-20,)) == ["strong", "medium", "medium", "weak"]


def test_aggregates_of_probabilities(spark):
    rows = [([0.5, 0.5],), ([0.5, 0.0],), ([],), (None,)]
    for how, want in (("product", 0.25), ("average", 0.5), ("min", 0.5), ("other", 0.25)):
        assert one(spark, confidence.aggregate(F.col("p"), how), "p array<double>", *rows) == [want, None, None, None]


def test_position_like_slices(spark):
    rng = random.Random(2)
    rows = [([rng.randrange(3) for _ in range(rng.randrange(7))], [rng.randrange(3) for _ in range(rng.randrange(4))]) for _ in range(200)]
    want = [next((i for i in range(len(a) - len(b) + 1) if a[i : i + len(b)] == b), -1) for a, b in rows]
    assert one(spark, confidence.position(F.col("a"), F.col("b")), "a array<int>, b array<int>", *rows) == want


def test_span_ladder(spark):
    schema = "scores array<double>, tokens array<int>, target array<int>, spaced array<int>, words array<array<int>>, response string, said string"
    s = [0.1, 0.2, 0.3, 0.4]
    rows = [
        (s, [1, 2, 3, 4], [2, 3], [9], [[9]], "r", "t"), (s, [1, 2, 3, 4], [9, 9], [3, 4], [[9]], "r", "t"), (s, [1, 2, 3, 4], [8, 8], [9], [[7], [4]], "r", "t"),
        (s, [1, 2, 3, 4], [8], [9], [[4]], "xyzw", "q"), (s, [1, 2], [1], [9], [[9]], "r", "t"), ([], [], [1], [9], [[9]], "r", "t"),
    ]
    cols = [F.col(c) for c in ("scores", "tokens", "target", "spaced", "words", "response", "said")]
    assert one(spark, confidence.span_probs(*cols), schema, *rows) == [[0.2, 0.3], [0.3, 0.4], [0.4], [0.1], [-1.0], [-1.0]]


def test_softmax(spark):
    (p,) = one(spark, confidence.softmax(F.col("x")), "x array<double>", ([1000.0, 1000.0],))
    (lp,) = one(spark, confidence.log_softmax(F.col("x")), "x array<double>", ([0.0, 0.0],))
    assert p == [0.5, 0.5] and lp == pytest.approx([-0.6931471805599453] * 2)
    (t,) = one(spark, confidence.token_logprobs(F.col("x"), F.col("i")), "x array<array<double>>, i array<int>", ([[0.0, 0.0], [0.0, 1e9]], [0, 1]))
    assert t == pytest.approx([-0.6931471805599453, 0.0])


def test_keywords(spark):
    got = one(spark, F.array_sort(text.keywords(F.col("t"))), "t string", ("Mountains",), ("Glass",), ("ox",), ("the cats and the cats",), ("",))
    assert got == [["mountain", "mountains"], ["glas", "glass"], [], ["cat", "cats"], []]


def test_extraction(spark):
    rows = [("The answer is Paris.",), ("",), ('He said "blue moon" 1',), ("42 the 17 of 99",), ("...",), ("The capital: Rome",)]
    assert one(spark, text.extract_answer(F.col("t")), "t string", *rows)[:2] == ["Paris", "N/A"]
    assert one(spark, text.pattern_answer(F.col("t")), "t string", ("The answer is Paris.",), ("1 2 3",)) == ["Paris", None]
    assert one(spark, text.last_word(F.col("t")), "t string", ("a b c ",), ("  ",), (None,)) == ["c", "N/A", "N/A"]
    assert one(spark, text.first_sentence(F.col("t")), "t string", ("Long enough. More\nx",), ("a.b",)) == ["Long enough", "a.b"]
    assert one(spark, text.fallback_answer(F.col("t")), "t string", ("the of Rome, x",), ("of a",), ("",)) == ["Rome", "of", "N/A"]
    assert one(spark, text.phrase_answer(F.col("t")), "t string", ("Answer: the big red dog. no",), ("the a",)) == ["big red dog", None]
    assert one(spark, text.cloze_answer(F.col("f"), F.col("t")), "f string, t string", ("The cat is ___ black, or. so", "The cat is")) == ["black, or"]


def test_overlap_and_chain(spark):
    got = one(spark, text.overlap_confidence(F.col("a"), F.col("b")), "a string, b string", ("x y", "q"), ("x y z", "X q"), ("x", "x"), ("", "x"))
    assert got == [0.05, pytest.approx(1 / 3), 0.8, 0.1]
    value, source = confidence.chain(F.col("a"), F.col("b"), F.col("c"))
    rows = [(0.9, 0.2, 0.3), (None, 0.2, 0.3), (None, None, 0.3), (None, None, None)]
    assert one(spark, value, "a double, b double, c double", *rows) == [0.9, 0.2, 0.3, 0.1]
    assert one(spark, source, "a double, b double, c double", *rows) == ["standard", "simple", "overlap", "constant"]


def test_templates(spark):
    h, r, t = F.col("h"), F.col("r"), F.col("t")
    rows = [("Paris", "capital_of", "France"), ("a", "likes", "b")]
    assert one(spark, templates.template("direct", h, r, t), "h string, r string, t string", *rows) == ["Paris is the capital of France", "a likes b"]
    assert one(spark, templates.template("question", h, r, t), "h string, r string, t string", *rows)[0] == "### Question\nWhat is the capital of France?\n### Response\n"
    assert one(spark, templates.template("direct", h, r, t, context=True), "h string, r string, t string", *rows)[0].endswith("The capital of France is Paris")
    assert one(spark, templates.last_question(templates.template("question", h, r, t)), "h string, r string, t string", *rows) == ["What is the capital of France?", "Complete: a likes b"]
    assert one(spark, templates.cleaned(F.col("h")), "h string", ("```**x**\nYour template: \n\n a \n b ",)) == ["a\nb"]


def test_flags_and_effects(spark):
    exact, partial = scoring.match_flags(F.col("t"), F.col("e"), F.col("r"))
    rows = [("New York", "in new york", "x"), ("New York", "york", "x"), ("New York", "", "x"), ("a", "b", None)]
    assert one(spark, exact, "t string, e string, r string", *rows) == [True, False, False, False]
    assert one(spark, partial, "t string, e string, r string", *rows) == [True, True, False, False]
    assert one(spark, scoring.effect(F.col("a"), F.col("b"), "gear"), "a string, b string", ("x", "GEARS"), ("x ", "X"), ("x", "y")) == ["strong", "none", "weak"]
    v = scoring.verdict(F.col("j"))
    assert [x and x["score"] for x in one(spark, v, "j string", ('{"score": 5, "category": "c", "explanation": "e"}',), ('{"score": 5}',), ("no",))] == [5, None, None]

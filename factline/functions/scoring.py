"""Bands, flags and outcomes of one evaluated row, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factline.functions.text import strip

#: Least score of each label, best first.
LABELS = (
    (95, "Perfect_Match"), (85, "Highly_Accurate"), (75, "Substantially_Correct"), (65, "Mostly_Correct"), (50, "Partially_Correct"),
    (35, "Somewhat_Related"), (20, "Poor_Relevance"), (10, "Barely_Relevant"),
)
LOWEST_LABEL = "Completely_Wrong"


def _bands(value: Column, steps: list[tuple[Column, str]], rest: str) -> Column:
    """The first name whose condition holds, else `rest`; null for a null value."""
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for condition, name in steps:
        out = out.when(condition, name)
    return out.otherwise(rest)


def label(score: Column) -> Column:
    """One of nine labels."""
    return _bands(score, [(score >= least, name) for least, name in LABELS], LOWEST_LABEL)


def accuracy_band(score: Column) -> Column:
    """High from 80, Medium from 50, Low below; a null score has no band."""
    return _bands(score, [(score >= 80, "High"), (score >= 50, "Medium")], "Low")


def change_strength(delta: Column) -> Column:
    return _bands(delta, [(delta < -50, "strong"), (delta < -20, "medium")], "weak")


def separation_quality(difference: Column) -> Column:
    return _bands(difference, [(difference > 0.1, "good"), (difference > 0.01, "fair")], "poor")


def rate_band(rate: Column) -> Column:
    return _bands(rate, [(rate > 0.7, "high"), (rate > 0.4, "moderate")], "low")


def logprob_band(mean_logprob: Column) -> Column:
    """How suspicious a low mean log-probability is."""
    return _bands(mean_logprob, [(mean_logprob < -5, "very_low"), (mean_logprob < -3, "low")], "normal")


def has_keyword(text: Column, keyword: str) -> Column:
    """Substring test on the lower-cased text; a null text has no keyword."""
    return F.coalesce(F.lower(text).contains(keyword.lower()), F.lit(False))


def text_differs(a: Column, b: Column) -> Column:
    return F.coalesce(a, F.lit("")) != F.coalesce(b, F.lit(""))


def match_flags(tail: Column, extracted: Column, response: Column) -> tuple[Column, Column]:
    """exact: the tail is contained in the extracted answer; partial: a tail word of 3 letters or more is.

    Both are false unless extracted answer and response are there and not empty.
    """
    low = F.lower(extracted)
    there = (F.coalesce(F.length(extracted), F.lit(0)) > 0) & (F.coalesce(F.length(response), F.lit(0)) > 0)
    words = F.filter(F.split(F.lower(tail), r"\s+"), lambda x: F.length(x) > 2)
    exact = there & low.contains(F.lower(tail))
    partial = there & F.exists(words, lambda x: low.contains(x))
    return F.coalesce(exact, F.lit(False)), F.coalesce(partial, F.lit(False))


def effect(base: Column, changed: Column, keyword: str) -> Column:
    """strong: the keyword came in; weak: the texts differ once lowered and stripped; else none."""
    came = has_keyword(changed, keyword) & ~has_keyword(base, keyword)
    return F.when(came, "strong").when(F.lower(strip(base)) != F.lower(strip(changed)), "weak").otherwise("none")


VERDICT = "score int, category string, explanation string"


def verdict(json: Column) -> Column:
    """A judge's JSON as a struct, or null unless score, category and explanation are all there."""
    return whole_verdict(F.from_json(json, VERDICT))


def whole_verdict(v: Column) -> Column:
    """A parsed verdict, or null unless it has all its fields."""
    return F.when(v["score"].isNotNull() & v["category"].isNotNull() & v["explanation"].isNotNull(), v)


def outcome(response: Column, extracted: Column, judged: Column, failed: Column) -> dict[str, Column]:
    """Score, category and explanation of a row, from what happened to it."""
    no_response = F.coalesce(F.length(strip(response)), F.lit(0)) == 0
    not_extracted = extracted.isNull() | (extracted == "N/A")
    steps = [(F.coalesce(failed, F.lit(False)), 0, "Error", "evaluation failed"), (no_response, 0, "No_Response", "no response"), (not_extracted, 0, "Extraction_Failed", "no answer found in the response"), (judged.isNull(), 50, "Judge_Failed", "no valid verdict")]
    score, category, why = judged["score"], judged["category"], judged["explanation"]
    for condition, s, c, w in reversed(steps):
        score, category, why = F.when(condition, F.lit(s)).otherwise(score), F.when(condition, F.lit(c)).otherwise(category), F.when(condition, F.lit(w)).otherwise(why)
    return {"accuracy_score": score, "accuracy_category": category, "accuracy_explanation": why}

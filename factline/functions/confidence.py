"""Confidence from token probabilities, as column expressions over arrays."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def aggregate(probs: Column, how: str = "product") -> Column:
    """product, average or min of the array; any other name means product.

    Null when the array is null or empty, or holds a value that is not positive.
    """
    def of(p: Column) -> Column:
        total = {
            "average": F.aggregate(p, F.lit(0.0), lambda a, x: a + x) / F.size(p),
            "min": F.array_min(p),
        }.get(how, F.aggregate(p, F.lit(1.0), lambda a, x: a * x))
        return F.when((F.size(p) > 0) & ~F.exists(p, lambda x: x <= 0), total)

    return _bound(probs, of)


def position(tokens: Column, part: Column) -> Column:
    """0-based index of the first place where part lies in tokens; -1 if none, 0 for an empty part."""
    def of(x: Column) -> Column:
        n, m = F.size(x["tokens"]), F.size(x["part"])
        places = F.filter(F.sequence(F.lit(0), F.greatest(n - m, F.lit(0))), lambda i: F.slice(x["tokens"], i + 1, m) == x["part"])
        return F.when(m == 0, 0).when(n < m, -1).otherwise(F.coalesce(F.get(places, 0), F.lit(-1)))

    return _bound(F.struct(tokens.alias("tokens"), part.alias("part")), of)


def span_probs(scores: Column, tokens: Column, target: Column, target_spaced: Column, words: Column, response: Column, target_text: Column) -> Column:
    """The scores of the target's tokens in a response.

    In turn: the tokens themselves; those of the target after a space; the first word of the
    target found (words: array of token arrays, in order of trial; used for targets of two tokens
    or more); tokens near the place of the target's text; as many from the start as the target
    has; the first score. [-1] when scores and tokens differ in number or there is nothing.
    """
    def at(part: Column) -> Column:
        return _bound(part, lambda x: _bound(position(tokens, x), lambda p: F.when(p >= 0, F.slice(scores, p + 1, F.size(x)))))

    word = F.get(F.filter(words, lambda x: position(tokens, x) >= 0), 0)
    by_word = F.when(F.size(target) > 1, F.when(word.isNotNull(), at(word)))
    found = F.instr(F.lower(response), F.lower(target_text)) - 1
    guess = F.floor(found * F.size(tokens) / F.length(response)).cast("int")
    reach = F.least(F.lit(10), F.size(target) + 5)
    lo = F.greatest(F.lit(0), guess - reach)
    hi = F.least(F.size(scores), guess + reach + F.size(target))
    near = F.when((found >= 0) & (hi > lo), F.slice(scores, lo + 1, F.greatest(hi - lo, F.lit(0))))
    head = F.when(F.size(scores) >= F.size(target), F.slice(scores, F.lit(1), F.size(target)))
    none = F.array(F.lit(-1.0))
    first = F.when(F.size(scores) > 0, F.slice(scores, 1, 1))
    return F.when(F.size(tokens) != F.size(scores), none).otherwise(F.coalesce(at(target), at(target_spaced), by_word, near, head, first, none))


def softmax(logits: Column) -> Column:
    def shares(weights: Column) -> Column:
        return _bound(F.aggregate(weights, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(weights, lambda x: x / total))

    def from_top(values: Column) -> Column:
        return _bound(F.array_max(values), lambda top: _bound(F.transform(values, lambda x: F.exp(x - top)), shares))

    return _bound(logits, from_top)


def log_softmax(logits: Column) -> Column:
    def below(values: Column, top: Column) -> Column:
        total = F.aggregate(values, F.lit(0.0), lambda a, x: a + F.exp(x - top))
        return _bound(F.log(total), lambda size: F.transform(values, lambda x: x - top - size))

    return _bound(logits, lambda values: _bound(F.array_max(values), lambda top: below(values, top)))


def _gathered(steps: pa.Array, ids: pa.Array) -> pa.Array:
    """token_logprobs of a batch; one step's logits are worked on at a time, in place in the batch."""
    logits = steps.values
    at, ends = logits.offsets.to_numpy(), steps.offsets.to_numpy()
    values = logits.values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    gone = logits.values.is_null().to_numpy(zero_copy_only=False) if logits.values.null_count else None
    here = logits.is_valid().to_numpy(zero_copy_only=False)
    given = steps.is_valid().to_numpy(zero_copy_only=False)
    out = []
    for row, (lo, hi, want) in enumerate(zip(ends[:-1], ends[1:], ids.to_pylist())):
        if want is None or not given[row]:
            out.append(None)
            continue
        found = [None] * max(hi - lo, len(want))
        for k, i in enumerate(want[: hi - lo]):
            a, b = at[lo + k], at[lo + k + 1]
            if i is not None and 0 <= i < b - a and here[lo + k] and not (gone is not None and gone[a:b].any()):
                x = values[a:b]
                top = x.max()
                found[k] = float(x[i] - top - np.log(np.exp(x - top).sum()))
        out.append(found)
    return pa.array(out, pa.list_(pa.float64()))


def token_logprobs(steps: Column, ids: Column, wide: bool = False) -> Column:
    """Log-probability of each id at its step. steps: an array of logit arrays.

    wide: by an Arrow kernel, for vocabularies of thousands; else by expressions, which keep
    every step's whole distribution. Both give null for an id that is null or out of range, and
    for logits that are null, empty or hold a null.
    """
    if wide:
        kernel = F.arrow_udf(_gathered, "array<double>")
        return kernel(steps.cast("array<array<double>>"), ids.cast("array<int>"))
    return F.transform(F.arrays_zip(steps.alias("l"), ids.alias("i")), lambda s: F.get(log_softmax(s["l"]), s["i"]))


def mean(values: Column) -> Column:
    return _bound(values, lambda v: F.when(F.size(v) > 0, F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v)))


def from_nll(nll: Column, length: Column) -> Column:
    """exp(-nll / length), between 0.001 and 1."""
    return F.least(F.greatest(F.exp(-nll / length), F.lit(0.001)), F.lit(1.0))


def chain(standard: Column, simple: Column, overlap: Column) -> tuple[Column, Column]:
    """The first confidence there is, 0.1 at last; and where it came from."""
    source = F.when(standard.isNotNull(), "standard").when(simple.isNotNull(), "simple").when(overlap.isNotNull(), "overlap").otherwise("constant")
    return F.coalesce(standard, simple, overlap, F.lit(0.1)), source


def by_generation(response: Column, scores: Column, tokens: Column, target: Column, target_spaced: Column, words: Column, extracted: Column, how: str = "product") -> tuple[Column, Column]:
    """The answer found in a generated response, and the confidence in it.

    extracted: the answer's text; target, target_spaced and words: its tokens, see span_probs.
    N/A and null without an answer; null where no score belongs to the answer.
    """
    def of(x: Column) -> Column:
        p = span_probs(x["scores"], x["tokens"], x["target"], x["spaced"], x["words"], x["response"], x["said"])
        return _bound(p, lambda p: aggregate(F.when(p != F.array(F.lit(-1.0)), p), how))

    none = extracted.isNull() | extracted.contains("N/A")
    given = F.struct(scores.alias("scores"), tokens.alias("tokens"), target.alias("target"), target_spaced.alias("spaced"), words.alias("words"), response.alias("response"), extracted.alias("said"))
    return F.when(none, "N/A").otherwise(extracted), F.when(~none, _bound(given, of))


def by_condition(steps: Column, ids: Column, how: str = "product", wide: bool = False) -> Column:
    """Confidence in a target after its prompt: each target token's probability at its step (wide: see token_logprobs)."""
    return aggregate(F.transform(token_logprobs(steps, ids, wide), lambda x: F.exp(x)), how)


def dispatch(kind: Column, generated: Column, direct: Column) -> Column:
    """Questions are answered by generation; statements and gaps are conditioned on."""
    return F.when(kind == "question", generated).otherwise(direct)


def token_count(tokens: Column, confidence: Column) -> Column:
    """Tokens of the tail where there is a confidence, else 0."""
    return F.when(confidence.isNotNull(), F.size(tokens)).otherwise(0)

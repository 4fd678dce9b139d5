"""Keyword and answer extraction as column expressions; no Python runs on the rows."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
KEYWORD_STOPWORDS = ("the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by")
SKIP_WORDS = ("the", "a", "an", "is", "was", "are", "were", "in", "on", "at", "to", "for", "of", "with", "by")
FALLBACK_STOPWORDS = ("the", "a", "an", "is", "was", "are", "were", "in", "on", "at", "to", "for", "of", "with")
ENTITY_STOPWORDS = ("the", "this", "that", "question", "response", "answer")
PREFIXES = ("### Question", "### Response", "The answer is", "Answer:", "Response:", "A:", "Q:", "Question:", "In response,")
ANSWER_PATTERNS = (
    r"(?:the answer is|answer is|is)\s+([A-Z][a-zA-Z\s]+?)(?:\.|$|###)",
    r"^([A-Z][a-zA-Z\s]+?)\s+(?:is|was)",
    r"^([A-Z][a-zA-Z\s]{1,50}?)(?:\.|,|$|###)",
    r"\?\s*([A-Z][a-zA-Z\s]+?)(?:\.|$|###)",
    r'"([^"]+)"',
    r"Response[:\s]*([A-Z][a-zA-Z\s]+?)(?:\.|$|###)",
    r":\s*([A-Z][a-zA-Z\s]+?)(?:\.|$|###)",
)
NOT_FOUND = "N/A"


def strip(c: Column, chars: str = r"\s") -> Column:
    """Without leading and trailing characters of the class."""
    return F.regexp_replace(F.regexp_replace(c, f"^[{chars}]+", ""), f"[{chars}]+$", "")


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda x: x != "")


def _in(c: Column, values: tuple[str, ...]) -> Column:
    return c.isin(*values)


def keywords(c: Column) -> Column:
    """Words of 3 letters or more, no stopwords, each with its form without or with a final s, once each."""
    found = F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"(?U)(\b\w+\b)"), 1), lambda x: ~_in(x, KEYWORD_STOPWORDS) & (F.length(x) > 2))

    def forms(x: Column) -> Column:
        plural = x.endswith("s")
        return F.when(plural & (F.length(x) > 3), F.array(x, F.substring(x, F.lit(1), F.length(x) - 1))).when(plural, F.array(x)).otherwise(F.array(x, F.concat(x, F.lit("s"))))

    return F.array_distinct(F.flatten(F.transform(found, forms)))


def contains_any(c: Column, kws: Column) -> Column:
    low = F.lower(c)
    return F.coalesce(F.exists(kws, lambda k: low.contains(k)), F.lit(False))


def first_sentence(c: Column) -> Column:
    """The first line; cut at its first full stop if more than 5 characters stand before it."""
    line = strip(F.split_part(strip(c), F.lit("\n"), F.lit(1)))
    head = F.split_part(line, F.lit("."), F.lit(1))
    return F.when(line.contains(".") & (F.length(head) > 5), strip(head)).otherwise(line)


def last_word(c: Column) -> Column:
    w = words(c)
    return F.when(F.coalesce(F.size(w), F.lit(0)) > 0, F.element_at(w, -1)).otherwise(NOT_FOUND)


def pattern_answer(c: Column) -> Column:
    """The first pattern whose captured text, stripped, has 1 to 99 characters; else null."""
    def one(p: str) -> Column:
        got = strip(F.regexp_extract(c, "(?i)" + p, 1))
        return F.when((F.length(got) > 0) & (F.length(got) < 100), got)

    return F.coalesce(*[one(p) for p in ANSWER_PATTERNS])


def phrase_answer(c: Column) -> Column:
    """Up to five meaningful words of the first phrase, after known prefixes; null if none or too long."""
    text = c
    for p in PREFIXES:
        text = F.regexp_replace(text, rf"(?i)^{re.escape(p)}\s*", "")
    for mark in (".", "###", "\n"):
        text = F.split_part(text, F.lit(mark), F.lit(1))
    clean = F.transform(words(text), lambda x: strip(x, r".,!?\";:()\[\]{}"))
    kept = F.slice(F.filter(clean, lambda x: ~_in(F.lower(x), SKIP_WORDS) & (F.length(x) > 1)), 1, 5)
    out = F.array_join(kept, " ")
    return F.when((F.size(kept) > 0) & (F.length(out) < 100), out)


def entity_answer(c: Column) -> Column:
    """The first capitalised word of letters among the first 15; null if none."""
    clean = F.transform(F.slice(words(F.replace(c, F.lit("###"), F.lit(" "))), 1, 15), lambda x: strip(x, r".,!?\";:()\[\]{}"))
    return F.get(F.filter(clean, lambda x: (F.length(x) > 2) & x.rlike(r"^\p{Lu}\p{L}*$") & ~_in(F.lower(x), ENTITY_STOPWORDS)), 0)


def extract_answer(c: Column) -> Column:
    """Patterns, then the first phrase, then an entity; N/A when nothing is found."""
    text = strip(c)
    return F.coalesce(pattern_answer(text), phrase_answer(text), entity_answer(text), F.lit(NOT_FOUND))


def clean_extracted(extracted: Column, original: Column) -> Column:
    """Strip quotes and marks, cut what is too long, and prefer a word that the original holds."""
    e = strip(strip(extracted, r"\"'.,!?"))
    cut = e
    for mark in reversed((".", ",", ";", "\n")):
        cut = F.when(e.contains(mark), strip(F.split_part(e, F.lit(mark), F.lit(1)))).otherwise(cut)
    e = F.when(F.length(e) > 100, cut).otherwise(e)
    low = F.lower(original)
    held = F.filter(words(e), lambda x: (F.length(x) > 3) & low.contains(F.lower(x)))
    out = F.when(low.contains(F.lower(e)), e).when((F.size(words(e)) > 1) & (F.size(held) > 0), F.get(held, 0)).otherwise(e)
    return F.when(extracted.isNull() | (extracted == "") | (F.lower(extracted) == "n/a"), NOT_FOUND).otherwise(out)


def fallback_answer(c: Column) -> Column:
    """The first meaningful word among ten, else the first word."""
    marks = r".,!?\";"
    every = F.transform(words(F.replace(c, F.lit("###"), F.lit(" "))), lambda x: strip(x, marks))
    good = F.filter(F.slice(every, 1, 10), lambda x: (F.length(x) > 2) & ~_in(F.lower(x), FALLBACK_STOPWORDS) & x.rlike(r"^\p{L}+$"))
    return F.coalesce(F.get(good, 0), F.get(every, 0), F.lit(NOT_FOUND))


def cloze_answer(full: Column, template: Column) -> Column:
    """What follows the template, up to the first of full stop, comma or line break in that order of choice."""
    part = strip(F.when(F.startswith(full, template), F.substring(full, F.length(template) + 1, F.length(full))).otherwise(full))
    cut = part
    for mark in reversed((".", ",", "\n")):
        cut = F.when(part.contains(mark), strip(F.split_part(part, F.lit(mark), F.lit(1)))).otherwise(cut)
    return strip(F.replace(cut, F.lit("___"), F.lit("")))


def shortened(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def overlap_confidence(tail: Column, response: Column) -> Column:
    """Share of the tail's words in the response, between 0.05 and 0.8; 0.1 for a tail without words."""
    own = F.array_distinct(words(F.lower(tail)))
    common = F.size(F.array_intersect(own, words(F.lower(F.coalesce(response, F.lit(""))))))
    return F.when(F.coalesce(F.size(own), F.lit(0)) <= 0, 0.1).otherwise(F.least(F.greatest(common / F.size(own), F.lit(0.05)), F.lit(0.8)))


def as_question(c: Column, head: Column, relation: Column) -> Column:
    """A generated question, ended by a question mark; a stock one where there is none."""
    q = strip(c)
    stock = F.concat(F.lit("What is the "), relation, F.lit(" of "), head, F.lit("?"))
    return F.when(F.coalesce(q, F.lit("")) == "", stock).when(q.contains("?"), q).otherwise(F.concat(q, F.lit("?")))


def padded(name: str, number: Column, width: int = 3) -> Column:
    """The name with a number of at least `width` digits."""
    return F.concat(F.lit(name), F.format_string(f"%0{width}d", number))


def fixed(c: Column, places: int, signed: bool = False) -> Column:
    """A number with so many places, ties to even; null stays null."""
    sign = F.when(c < 0, "-").otherwise("+" if signed else "")
    return F.when(c.isNotNull(), F.concat(sign, F.format_string(f"%.{places}f", F.bround(F.abs(c.cast("double")), places))))


def percent_text(c: Column, places: int = 1) -> Column:
    """A share as per cent."""
    return F.concat(fixed(c * 100, places), F.lit("%"))


def iso_time(c: Column) -> Column:
    """A timestamp as 2024-01-31T09:05:07.000000."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def compact_time(c: Column) -> Column:
    """A timestamp for a file's name, as 20240131_090507."""
    return F.date_format(c, "yyyyMMdd_HHmmss")

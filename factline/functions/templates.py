"""Prompt templates by relation, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Statement, question and cloze of each relation; {h} and {t} stand for head and tail.
STATEMENTS = {"capital_of": "{h} is the capital of {t}", "born_in": "{h} was born in {t}", "located_in": "{h} is located in {t}", "nationality": "{h} is from {t}"}
ANSWERS = STATEMENTS | {"capital_of": "The capital of {t} is {h}"}
QUESTIONS = {"capital_of": "What is the capital of {t}?", "born_in": "Where was {h} born?", "located_in": "Where is {h} located?", "nationality": "What is {h}'s nationality?"}
CLOZES = {"capital_of": "The capital of {t} is", "born_in": "{h} was born in", "located_in": "{h} is located in", "nationality": "{h} is from"}
GUIDANCE = {
    "capital_of": "Focus on geographical capitals. Use 'capital' clearly in the question/statement.",
    "born_in": "Focus on birthplace. Use clear birth-related language.",
    "located_in": "Focus on geographical location. Use location-specific language.",
    "nationality": "Focus on country of origin or citizenship.",
    "wrote": "Focus on authorship. Use clear writing/creation language.",
    "invented": "Focus on invention or creation. Use invention-specific language.",
    "died_in": "Focus on place of death. Use death-related location language.",
    "spouse": "Focus on marital relationship. Use marriage/spouse language.",
    "child_of": "Focus on parent-child relationship.",
    "president_of": "Focus on political leadership role.",
}
GUIDANCE_DEFAULT = "Create natural, clear language that represents this relationship."
Q_MARK, R_MARK = "### Question\n", "### Response\n"


def _filled(pattern: str, head: Column, tail: Column) -> Column:
    parts, rest = [], pattern
    while rest:
        at = min([i for i in (rest.find("{h}"), rest.find("{t}")) if i >= 0], default=len(rest))
        if at:
            parts.append(F.lit(rest[:at]))
        if rest[at:]:
            parts.append(head if rest[at + 1] == "h" else tail)
        rest = rest[at + 3 :]
    return F.concat(*parts)


def _by_relation(patterns: dict[str, str], head: Column, relation: Column, tail: Column) -> Column:
    """The relation's pattern, else the three parts with spaces between."""
    out = F.when(F.lit(False), F.lit(""))
    for name, pattern in patterns.items():
        out = out.when(relation == name, _filled(pattern, head, tail))
    return out.otherwise(F.concat_ws(" ", head, relation, tail))


def template(kind: str, head: Column, relation: Column, tail: Column, context: bool = False, stop: bool = False) -> Column:
    """kind: direct, question or cloze. context: a direct statement after its question. stop: the set with a full stop."""
    if kind == "question":
        patterns = {r: Q_MARK + q + "\n" + R_MARK for r, q in QUESTIONS.items()}
    elif kind == "direct" and context:
        said = {r: s + "." for r, s in STATEMENTS.items()} if stop else ANSWERS
        patterns = {r: Q_MARK + q + "\n" + R_MARK + said[r] for r, q in QUESTIONS.items()}
    else:
        patterns = STATEMENTS if kind == "direct" else CLOZES
    return _by_relation(patterns, head, relation, tail)


def wrapped(question: Column) -> Column:
    return F.concat(F.lit(Q_MARK), question, F.lit("\n" + R_MARK))


def last_question(c: Column) -> Column:
    mark = Q_MARK.strip()
    inner = F.trim(F.split_part(F.split_part(c, F.lit(mark), F.lit(2)), F.lit(R_MARK.strip()), F.lit(1)), F.lit(" \t\n\r"))
    return F.when(c.contains(mark), inner).otherwise(F.concat(F.lit("Complete: "), c))


def cleaned(c: Column) -> Column:
    """Without fences, bold marks, lead-ins and blank lines."""
    out = F.replace(F.replace(c, F.lit("```"), F.lit("")), F.lit("**"), F.lit(""))
    for lead in ("Your template:", "Your statement:"):
        out = F.element_at(F.split(out, lead), -1)
    lines = F.transform(F.split(out, "\n"), lambda x: F.trim(x, F.lit(" \t\r")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def is_good(c: Column, kind: str, head: Column, tail: Column, context: bool = False) -> Column:
    ok = F.length(c).between(10, 300)
    if kind == "question" or (kind == "direct" and context):
        ok = ok & c.contains(Q_MARK.strip()) & c.contains(R_MARK.strip())
    if kind != "cloze":
        ok = ok & (F.lower(c).contains(F.lower(head)) | F.lower(c).contains(F.lower(tail)))
    return F.coalesce(ok, F.lit(False))


def guidance(relation: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in GUIDANCE.items() for x in pair])
    return F.coalesce(F.try_element_at(known, relation), F.lit(GUIDANCE_DEFAULT))


def prompt_and_target(c: Column, tail: Column, kind: str, context: bool = False) -> tuple[Column, Column]:
    """Where a template is cut into what is given and what is scored."""
    spaced = F.concat(F.lit(" "), tail)
    if kind != "direct":
        return c, spaced
    if context:
        parts = F.split(c, R_MARK)
        two = F.size(parts) == 2
        return F.when(two, F.concat(F.get(parts, 0), F.lit(R_MARK))).otherwise(""), F.when(two, F.get(parts, 1)).otherwise(c)
    there = c.contains(tail)
    return F.when(there, F.rtrim(F.replace(c, tail, F.lit("")))).otherwise(""), F.when(there, spaced).otherwise(c)

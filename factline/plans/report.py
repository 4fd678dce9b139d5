"""The text report of a comparison, from tables of a few rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

from factline.operators import compare as c
from factline.schemas import TARGET


def number(x: float | None, spec: str) -> str:
    return "n/a" if x is None else format(x, spec)


def render(base: DataFrame, post: DataFrame, keyword: str, target: tuple[str, str, str]) -> str:
    """Target, overall and by-level changes, keyword counts and a summary. Collects one row a level at most."""
    out = ["Comparison of two runs", "", f"Target: {' '.join(target)}"]
    rows = c.target_change(base, post, target).collect()
    if rows:
        t = rows[0]
        for side in ("base", "post"):
            out.append(f"  {side}: confidence {number(t[f'{side}_confidence'], '.4f')}, score {t[f'{side}_accuracy_score']}, response '{t[f'{side}_model_response']}'")
        out.append(f"  change: confidence {number(t['confidence_change'], '+.4f')}, score {number(t['accuracy_change'], '+d')}, response {'changed' if t['response_changed'] else 'same'}, {t['strength']}")
    o = c.overall_delta(base, post).first()
    out += ["", f"Overall: confidence {number(o['avg_confidence_change'], '+.4f')}, score {number(o['avg_accuracy_change'], '+.2f')}, share of high scores {number(o['high_accuracy_rate_change'], '+.2f')} points", "", "By level:"]
    levels = c.level_scoped(base, post, keyword).collect()
    for r in levels:
        out.append(f"  {r['distance']}: {r['total_triplets']} triples, confidence {r['avg_confidence_change']:+.4f} (sd {r['confidence_std']:.4f}), score {r['avg_accuracy_change']:+.2f} (sd {r['accuracy_std']:.2f}), introduced {r['introduced']} ({r['introduced_rate']:.2%})")
    said = {(r["run"], r["distance"]): r["count"] for r in c.keyword_rows(base, post, keyword).groupBy("run", "distance").count().collect()}
    before, after = (sum(n for (run, _), n in said.items() if run == s) for s in ("base", "post"))
    out += ["", f"Responses with '{keyword}': {before} before, {after} after, {after - before} net"]
    out += [f"  {d}: {n}" for (run, d), n in sorted(said.items(), key=lambda x: str(x[0])) if run == "post"]
    out += ["", f"Levels affected: {sum(r['introduced'] > 0 for r in levels)}"]
    return "\n".join(out)


def render_levels(summary: DataFrame, keyword: str) -> str:
    """The target's row, how far introductions reach, and a line a level, of level_summary's few rows."""
    rows = summary.collect()
    out = ["Levels"]
    for t in (r for r in rows if r["distance"] == TARGET):
        for name, spec in (("confidence", ".4f"), ("accuracy", ".1f")):
            out.append(f"  target {name}: {number(t[f'base_{name}_mean'], spec)} -> {number(t[f'post_{name}_mean'], spec)} ({number(t[f'{name}_change_mean'], '+' + spec)})")
        out.append(f"  target: {t['introduced_count']} new responses with '{keyword}'")
    new, every = sum(r["introduced_count"] for r in rows), sum(r["triplet_count"] for r in rows)
    out.append(f"  levels affected: {sum(r['introduced_count'] > 0 for r in rows)}/{len(rows)}")
    out.append(f"  introduced: {new} triples ({number(new / every if every else None, '.1%')})")
    out += [f"  {r['distance']}: confidence {number(r['confidence_change_mean'], '+.4f')}, accuracy {number(r['accuracy_change_mean'], '+.1f')}, introduced {number(r['introduced_rate'], '.1%')}" for r in rows]
    return "\n".join(out)

"""The catalogue's queries as SQL over the same tables, written independently of the operators."""

from __future__ import annotations

from factline.functions import templates
from factline.functions.text import KEYWORD_STOPWORDS
from factline.operators.graph import CATEGORIES
from factline.plans.catalogue import EXPERIMENTS

ORD = "l_partkey {d}, l_suppkey {d}, l_quantity {d}, l_extendedprice {d}, l_discount {d}, l_tax {d}, l_returnflag {d}, l_linestatus {d}, l_shipdate {d}"
FIRST, LAST = ORD.format(d="ASC"), ORD.format(d="DESC")
LEVEL = "CASE WHEN l_linenumber = 1 THEN 'target' ELSE 'd' || (l_linenumber - 1) END"
RANK = "CASE WHEN distance = 'target' THEN 0 ELSE CAST(substr(distance, 2) AS INTEGER) END"

RUNS = f"""
run_base AS (SELECT l.*, p_name, 'order:' || l_orderkey AS head, 'has_line' AS relation, 'line:' || l_linenumber AS tail, {LEVEL} AS distance,
    1 - l_discount AS confidence, CAST(l_quantity * 2 AS INTEGER) AS accuracy_score, p_name AS model_response
    FROM lineitem l JOIN part ON l_partkey = p_partkey),
run_post AS (SELECT l.*, p_name, 'order:' || l_orderkey AS head, 'has_line' AS relation, 'line:' || l_linenumber AS tail, {LEVEL} AS distance,
    1 - l_tax AS confidence, CASE WHEN l_partkey % 11 <> 0 THEN CAST(greatest(l_quantity * 2 - (l_partkey % 7) * 10, 0) AS INTEGER) END AS accuracy_score,
    CASE WHEN l_partkey % 5 = 0 THEN p_name || ' Gears' WHEN l_partkey % 7 = 0 THEN 'unknown' ELSE p_name END AS model_response
    FROM lineitem l JOIN part ON l_partkey = p_partkey WHERE l_orderkey % 10 <> 9)"""
DETAIL = (
    RUNS
    + f""",
last_base AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY head, relation, tail ORDER BY {LAST}) AS rn FROM run_base) WHERE rn = 1),
detail AS (SELECT *, post_confidence - base_confidence AS confidence_change, post_accuracy - base_accuracy AS accuracy_change, base_response <> post_response AS response_changed,
    contains_kw_post AND NOT contains_kw_base AS introduced FROM (
    SELECT p.head, p.relation, p.tail, p.distance, b.confidence AS base_confidence, p.confidence AS post_confidence, b.accuracy_score AS base_accuracy,
    coalesce(p.accuracy_score, 0) AS post_accuracy, b.model_response AS base_response, p.model_response AS post_response,
    contains(lower(b.model_response), 'gear') AS contains_kw_base, contains(lower(p.model_response), 'gear') AS contains_kw_post
    FROM run_post p JOIN last_base b ON p.head = b.head AND p.relation = b.relation AND p.tail = b.tail))"""
)
LABEL = "CASE WHEN {s} IS NULL THEN NULL WHEN {s} >= 95 THEN 'Perfect_Match' WHEN {s} >= 85 THEN 'Highly_Accurate' WHEN {s} >= 75 THEN 'Substantially_Correct' WHEN {s} >= 65 THEN 'Mostly_Correct' WHEN {s} >= 50 THEN 'Partially_Correct' WHEN {s} >= 35 THEN 'Somewhat_Related' WHEN {s} >= 20 THEN 'Poor_Relevance' WHEN {s} >= 10 THEN 'Barely_Relevant' ELSE 'Completely_Wrong' END"
BAND = "CASE WHEN {s} IS NULL THEN NULL WHEN {s} >= 80 THEN 'High' WHEN {s} >= 50 THEN 'Medium' ELSE 'Low' END"


def _with(ctes: str, body: str) -> str:
    return f"WITH {ctes.strip()}\n{body}"


def _filled(condition: str) -> str:
    return _with(DETAIL, f"SELECT d.distance, {RANK.replace('distance', 'd.distance')} AS rank, count(x.distance) AS n FROM (SELECT DISTINCT distance FROM detail) d LEFT JOIN (SELECT distance FROM detail WHERE {condition}) x ON d.distance = x.distance GROUP BY d.distance")


def _hist(column: str, bins: int, where: str = "TRUE", extra: str = "", tag: str = "") -> str:
    return f"""SELECT b.bin, round(lo + (hi - lo) / {bins} * b.bin, 6) AS bin_start, count(v.bin) AS n{extra}
FROM (SELECT unnest(range({bins})) AS bin) b CROSS JOIN (SELECT CAST(min({column}) AS DOUBLE) AS lo, CAST(max({column}) AS DOUBLE) AS hi FROM detail WHERE {where}) e
LEFT JOIN (SELECT least(CAST(floor(({column} - lo2) / ((hi2 - lo2) / {bins})) AS INTEGER), {bins - 1}) AS bin FROM detail CROSS JOIN (SELECT CAST(min({column}) AS DOUBLE) AS lo2, CAST(max({column}) AS DOUBLE) AS hi2 FROM detail WHERE {where}) WHERE {where}) v ON v.bin = b.bin
GROUP BY b.bin, lo, hi{tag}"""


def _stat(c: str, name: str) -> str:
    return f"round(avg({c}), 6) AS {name}_mean, round(stddev_samp({c}), 6) AS {name}_std"


NATION = "SELECT 'nation:' || n_nationkey AS head, 'in_region' AS relation, 'region:' || n_regionkey AS tail, CAST(n_nationkey AS BIGINT) AS ord FROM nation"
SUPPLIER = "SELECT 'supplier:' || s_suppkey, 'based_in', 'nation:' || s_nationkey, CAST(s_suppkey + 1000 AS BIGINT) FROM supplier"
CUSTOMER = "SELECT 'customer:' || c_custkey, 'located_in', 'nation:' || c_nationkey, CAST(c_custkey + 10000000 AS BIGINT) FROM customer"
SUPPLIES = "SELECT DISTINCT 'supplier:' || l_suppkey, 'supplies', 'part:' || l_partkey, l_partkey + 10000000000 FROM lineitem"
SMALL = f"edges AS ({NATION} UNION ALL {SUPPLIER} UNION ALL {CUSTOMER})"
EDGES = f"edges AS ({NATION} UNION ALL {SUPPLIER} UNION ALL {CUSTOMER} UNION ALL {SUPPLIES})"
TARGETS = "targets AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{h}', '{r}', '{t}')" for i, h, r, t in EXPERIMENTS) + ") AS v(experiment_id, head, relation, tail))"
RIPPLES = f"""RECURSIVE {SMALL}, {TARGETS},
pairs AS (SELECT head AS a, tail AS b FROM edges UNION SELECT tail, head FROM edges),
walk AS (SELECT experiment_id, head AS node, 0 AS level FROM targets UNION SELECT experiment_id, tail, 0 FROM targets
    UNION SELECT experiment_id, b, level + 1 FROM walk JOIN pairs ON node = a WHERE level < 3),
levels AS (SELECT experiment_id, node, min(level) AS level FROM walk GROUP BY experiment_id, node),
found AS (SELECT x.experiment_id, e.head, e.relation, e.tail, 1 + least(h.level, t.level) AS level FROM edges e CROSS JOIN targets x
    LEFT JOIN levels h ON h.experiment_id = x.experiment_id AND h.node = e.head LEFT JOIN levels t ON t.experiment_id = x.experiment_id AND t.node = e.tail
    WHERE e.head <> e.tail AND least(h.level, t.level) < 3 AND NOT (e.head = x.head AND e.tail = x.tail) AND NOT (e.head = x.tail AND e.tail = x.head))"""


def _said(pattern: str) -> str:
    """The filled pattern as an SQL expression."""
    quoted = pattern.replace("'", "''").replace("\n", "' || chr(10) || '")
    return "('" + quoted.replace("{h}", "' || head || '").replace("{t}", "' || tail || '") + "')"


def _template(patterns: dict[str, str], good: str, prompt: str, target: str) -> str:
    known = " ".join(f"WHEN relation = '{r}' THEN {_said(p)}" for r, p in patterns.items())
    question = "CASE WHEN contains(template, '### Question') THEN trim(split_part(split_part(template, '### Question', 2), '### Response', 1), ' ' || chr(9) || chr(10) || chr(13)) ELSE 'Complete: ' || template END"
    return _with(SMALL, f"SELECT head, relation, tail, template, {question} AS question, {good} AS is_good, {prompt} AS prompt, {target} AS target FROM (SELECT *, CASE {known} ELSE head || ' ' || relation || ' ' || tail END AS template FROM edges)")


_LONG = "length(template) BETWEEN 10 AND 300"
_NAMED = "(contains(lower(template), lower(head)) OR contains(lower(template), lower(tail)))"
_MARKED = "contains(template, '### Question') AND contains(template, '### Response')"
_CUT = "contains(template, tail)"
_ASKED = {r: f"### Question\n{q}\n### Response\n" for r, q in templates.QUESTIONS.items()}
PROBS = "probs AS (SELECT vec_id, [exp(x - list_max(e)) / list_sum([exp(y - list_max(e)) FOR y IN e]) FOR x IN e] AS p FROM (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings)), tried AS (SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN list_concat([0.0], p) WHEN vec_id % 10 = 1 THEN [] ELSE p[1:4] END AS p FROM probs)"


def _probs(value: str) -> str:
    return _with(PROBS, f"SELECT vec_id, CASE WHEN len(p) > 0 AND list_min(p) > 0 THEN round({value}, 10) END AS confidence FROM tried")


EFFECTS = (
    RUNS
    + f""",
b AS (SELECT head, tail, model_response AS b FROM (SELECT *, row_number() OVER (PARTITION BY head, relation, tail ORDER BY {LAST}) AS rn FROM run_base) WHERE rn = 1),
p AS (SELECT head, tail, model_response AS p FROM (SELECT *, row_number() OVER (PARTITION BY head, relation, tail ORDER BY {LAST}) AS rn FROM run_post) WHERE rn = 1),
flags AS (SELECT b.head, b.tail, b, p, contains(lower(b), 'gear') AS kb, contains(lower(p), 'gear') AS kp, contains(lower(b), 'bolt') OR contains(lower(b), 'ring') AS tb, contains(lower(p), 'bolt') OR contains(lower(p), 'ring') AS tp FROM b JOIN p ON b.head = p.head AND b.tail = p.tail),
effects AS (SELECT head, tail, CASE WHEN kp AND NOT kb THEN 'strong' WHEN lower(regexp_replace(b, '^\\s+|\\s+$', '', 'g')) <> lower(regexp_replace(p, '^\\s+|\\s+$', '', 'g')) THEN 'weak' ELSE 'none' END AS effect, tb AND NOT tp AS target_degradation, kp AND NOT kb AS keyword_introduced, lower(regexp_replace(b, '^\\s+|\\s+$', '', 'g')) <> lower(regexp_replace(p, '^\\s+|\\s+$', '', 'g')) AS response_differs FROM flags)"""
)
SEPARATION = "rows_ AS (SELECT quality = 1 AS label, CASE WHEN n_chars % 13 <> 0 THEN n_chars / (n_chars + 1000.0) END AS c FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"
QUALITY = "CASE WHEN {x} > 0.1 THEN 'good' WHEN {x} > 0.01 THEN 'fair' ELSE 'poor' END"
JUDGED = """k AS (SELECT *, json_extract_string(props, '$.k') AS k FROM events),
v AS (SELECT *, CAST(k AS INTEGER) AS s, event_id % 9 <> 0 AND event_id % 7 <> 0 AND k IS NOT NULL AS ok FROM k)"""

WS = "[\\s\\x0B]"  # white space, the vertical tab included


def _strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{WS}+', ''), '{WS}+$', '')"


def _words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{WS}+'), lambda w: w <> '')"


def _until(x: str, marks: list[str]) -> str:
    """x up to the first of the marks that it holds, in their order."""
    return "CASE " + " ".join(f"WHEN contains({x}, {m}) THEN {_strip(f'split_part({x}, {m}, 1)')}" for m in marks) + f" ELSE {x} END"


def _found(pattern: str) -> str:
    return f"{_strip(f'regexp_extract(t, {chr(39)}(?i){pattern}{chr(39)}, 1)')}"


_NAME = "[A-Z][a-zA-Z\\s\\x0B]"
#: The answer patterns, in order of trial, in the syntax of this SQL's expressions.
_PATTERNS = (
    f"(?:the answer is|answer is|is){WS}+({_NAME}+?)(?:\\.|$|###)", f"^({_NAME}+?){WS}+(?:is|was)", f"^({_NAME}{{1,50}}?)(?:\\.|,|$|###)", f"\\?{WS}*({_NAME}+?)(?:\\.|$|###)", '"([^"]+)"',
    f"Response(?:{WS}|:)*({_NAME}+?)(?:\\.|$|###)", f":{WS}*({_NAME}+?)(?:\\.|$|###)",
)
_LEADS = ("### Question", "### Response", "The answer is", "Answer:", "Response:", "A:", "Q:", "Question:", "In response,")
_DULL = "'the', 'a', 'an', 'is', 'was', 'are', 'were', 'in', 'on', 'at', 'to', 'for', 'of', 'with'"
_ASKED_AND_SAID = "qa AS (SELECT conv_id, turn, text AS question, answer FROM (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND nr = 'assistant')"


def _without_leads(x: str) -> str:
    for lead in _LEADS:
        x = f"regexp_replace({x}, '(?i)^{lead}{WS}*', '')"
    return x


def _bare(words: str, marks: str) -> str:
    return f"list_transform({words}, lambda w: trim(w, '{marks}'))"


_HITS = ", ".join(f"{_found(p)} AS p{k}" for k, p in enumerate(_PATTERNS))
EXTRACTED = f"""{_ASKED_AND_SAID},
texts AS (SELECT conv_id, turn, answer, {_strip('answer')} AS t, {_words('answer')} AS ws, {_words("replace(answer, '###', ' ')")} AS plain FROM qa),
hits AS (SELECT *, {_HITS}, {_without_leads('t')} AS led, split_part(t, chr(10), 1) AS line FROM texts),
parts AS (SELECT *, {_strip('line')} AS first_line, {_bare(_words("split_part(split_part(split_part(led, '.', 1), '###', 1), chr(10), 1)"), '.,!?";:()[]{}')} AS phrase,
    {_bare('plain[1:15]', '.,!?";:()[]{}')} AS names, {_bare('plain', '.,!?";')} AS bare FROM hits),
picked AS (SELECT *, list_filter(phrase, lambda w: length(w) > 1 AND lower(w) NOT IN ({_DULL}, 'by'))[1:5] AS said,
    list_filter(names, lambda w: length(w) > 2 AND regexp_matches(w, '^\\p{{Lu}}\\p{{L}}*$') AND lower(w) NOT IN ('the', 'this', 'that', 'question', 'response', 'answer')) AS entities,
    list_filter(bare[1:10], lambda w: length(w) > 2 AND regexp_matches(w, '^\\p{{L}}+$') AND lower(w) NOT IN ({_DULL})) AS good FROM parts)"""
CLEANED = f"""{_ASKED_AND_SAID},
quoted AS (SELECT *, {_strip("trim(chr(34) || split_part(answer, chr(10), 1) || '.' || chr(34), chr(34) || chr(39) || '.,!?')")} AS whole, {_strip("CASE WHEN starts_with(question || ' ___ ' || answer, question) THEN ' ___ ' || answer ELSE question || ' ___ ' || answer END")} AS rest FROM qa),
cut_ AS (SELECT *, CASE WHEN length(whole) > 100 THEN {_until('whole', ["'.'", "','", "';'", 'chr(10)'])} ELSE whole END AS e FROM quoted),
held AS (SELECT *, {_words('e')} AS ws, lower(question) AS low FROM cut_)"""


def _expansion(seed: str, rounds: int, every: int, budget: int) -> str:
    """The growth of a graph, a round a step; entity rounds unless nothing or the relations' turn waits."""
    out = f"""{SMALL}, g0 AS MATERIALIZED (SELECT * FROM edges WHERE {seed}), done0 AS (SELECT head AS node FROM edges WHERE false), used0 AS (SELECT relation FROM edges WHERE false), fresh0 AS MATERIALIZED (SELECT * FROM g0)"""
    for k in range(1, rounds + 1):
        j = k - 1
        by_relation = f"(SELECT count(*) FROM r{k}) > 0" + ("" if k % every == 0 else f" AND (SELECT count(*) FROM w{k}) = 0")
        out += f""",
n{k} AS MATERIALIZED (SELECT head AS node FROM g{j} UNION SELECT tail FROM g{j}),
w{k} AS MATERIALIZED (SELECT node FROM n{k} WHERE (SELECT count(*) FROM n{k}) < {budget} EXCEPT SELECT node FROM done{j}),
r{k} AS MATERIALIZED (SELECT relation FROM fresh{j} WHERE (SELECT count(*) FROM n{k}) < {budget} EXCEPT SELECT relation FROM used{j}),
turn{k} AS MATERIALIZED (SELECT {by_relation} AS by_relation),
new{k} AS MATERIALIZED (SELECT e.* FROM edges e CROSS JOIN turn{k} WHERE CASE WHEN by_relation THEN e.relation IN (SELECT relation FROM r{k}) ELSE e.head IN (SELECT node FROM w{k}) OR e.tail IN (SELECT node FROM w{k}) END),
done{k} AS MATERIALIZED (SELECT node FROM done{j} UNION SELECT node FROM w{k} CROSS JOIN turn{k} WHERE NOT by_relation),
used{k} AS MATERIALIZED (SELECT relation FROM used{j} UNION SELECT relation FROM r{k} CROSS JOIN turn{k} WHERE by_relation),
fresh{k} AS MATERIALIZED (SELECT * FROM fresh{j} UNION (SELECT new{k}.* FROM new{k} CROSS JOIN turn{k} WHERE NOT by_relation EXCEPT SELECT * FROM g{j})),
g{k} AS MATERIALIZED (SELECT * FROM g{j} UNION SELECT * FROM new{k})"""
    return _with(out, f"SELECT head, relation, tail, ord FROM g{rounds}")


def _member(of: str) -> str:
    """A triple as the JSON of a document's member."""
    h, r, t = (f"to_json({of}{c})" for c in ("head", "relation", "tail"))
    return f"""'{{"triplet":[' || {h} || ',' || {r} || ',' || {t} || '],"head":' || {h} || ',"relation":' || {r} || ',"tail":' || {t} || '}}'"""


SQL: dict[str, str] = {
    "compare_by_level": _with(DETAIL, "SELECT distance, count(*) AS triplet_count, " + ", ".join(_stat(f"{c}", c) for c in ("base_confidence", "post_confidence", "confidence_change", "base_accuracy", "post_accuracy", "accuracy_change")) + ", count(*) FILTER (WHERE introduced) AS introduced_count, round(avg(CASE WHEN introduced THEN 1.0 ELSE 0.0 END), 6) AS introduced_rate FROM detail GROUP BY distance"),
    "compare_detail": _with(DETAIL, "SELECT head, relation, tail, distance, round(base_confidence, 6) AS base_confidence, round(post_confidence, 6) AS post_confidence, round(confidence_change, 6) AS confidence_change, base_accuracy, post_accuracy, accuracy_change, base_response, post_response, response_changed, contains_kw_base, contains_kw_post, introduced, head = 'order:24' AND relation = 'has_line' AND tail = 'line:1' AS is_target FROM detail"),
    "compare_by_level_scoped": _with(
        RUNS + f""",
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY distance, head, relation, tail ORDER BY {LAST}) AS rn FROM run_base) WHERE rn = 1),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY distance, head, relation, tail ORDER BY {LAST}) AS rn FROM run_post) WHERE rn = 1),
x AS (SELECT b.distance, p.confidence - b.confidence AS c, coalesce(p.accuracy_score, 0) - b.accuracy_score AS a, contains(lower(p.model_response), 'gear') AND NOT contains(lower(b.model_response), 'gear') AS k FROM b JOIN p ON b.distance = p.distance AND b.head = p.head AND b.relation = p.relation AND b.tail = p.tail),
s AS (SELECT distance, count(*) AS pairs, avg(c) AS ac, stddev_pop(c) AS sc, avg(a) AS aa, stddev_pop(a) AS sa, count(*) FILTER (WHERE k) AS introduced FROM x GROUP BY distance),
t AS (SELECT distance, count(*) AS total_triplets FROM run_base GROUP BY distance)""",
        "SELECT t.distance, total_triplets, coalesce(pairs, 0) AS pairs, round(coalesce(ac, 0.0), 6) AS avg_confidence_change, round(coalesce(sc, 0.0), 6) AS confidence_std, round(coalesce(aa, 0.0), 6) AS avg_accuracy_change, round(coalesce(sa, 0.0), 6) AS accuracy_std, coalesce(introduced, 0) AS introduced, round(coalesce(introduced / pairs, 0.0), 6) AS introduced_rate FROM t LEFT JOIN s ON t.distance = s.distance",
    ),
    "compare_totals": _with(DETAIL, "SELECT count(*) AS triplets, round(avg(confidence_change), 6) AS mean_confidence_change, round(avg(accuracy_change), 6) AS mean_accuracy_change, count(*) FILTER (WHERE contains_kw_base) AS kw_base, count(*) FILTER (WHERE contains_kw_post) AS kw_post, count(*) FILTER (WHERE contains_kw_post) - count(*) FILTER (WHERE contains_kw_base) AS net_new, count(*) FILTER (WHERE introduced) AS introduced, round(100.0 * count(*) FILTER (WHERE introduced) / count(*), 6) AS contamination_pct, count(*) FILTER (WHERE accuracy_change < -20) AS large_drops, round(100.0 * count(*) FILTER (WHERE accuracy_change < -20) / count(*), 6) AS large_drop_pct, count(DISTINCT CASE WHEN introduced THEN distance END) AS affected_levels FROM detail"),
    "introduced_rollup": _with(DETAIL, "SELECT distance, count(*) AS triplets, count(*) FILTER (WHERE introduced) AS introduced FROM detail GROUP BY distance UNION ALL SELECT NULL, count(*), count(*) FILTER (WHERE introduced) FROM detail"),
    "affected_levels": _with(DETAIL, "SELECT count(DISTINCT distance) AS affected_levels FROM detail WHERE introduced"),
    "target_lookup": _with(
        RUNS + f""",
b AS (SELECT * FROM run_base WHERE head = 'order:24' AND tail = 'line:1' ORDER BY {FIRST} LIMIT 1),
p AS (SELECT * FROM run_post WHERE head = 'order:24' AND tail = 'line:1' ORDER BY {FIRST} LIMIT 1),
x AS (SELECT b.confidence AS bc, b.accuracy_score AS ba, b.model_response AS br, p.confidence AS pc, p.accuracy_score AS pa, p.model_response AS pr FROM b CROSS JOIN p)""",
        "SELECT 'order:24' AS head, 'has_line' AS relation, 'line:1' AS tail, round(bc, 6) AS base_confidence, ba AS base_accuracy_score, br AS base_model_response, round(pc, 6) AS post_confidence, pa AS post_accuracy_score, pr AS post_model_response, round(pc - bc, 6) AS confidence_change, coalesce(pa, 0) - coalesce(ba, 0) AS accuracy_change, br <> pr AS response_changed, CASE WHEN coalesce(pa, 0) - coalesce(ba, 0) < -50 THEN 'strong' WHEN coalesce(pa, 0) - coalesce(ba, 0) < -20 THEN 'medium' ELSE 'weak' END AS strength FROM x",
    ),
    "overall_delta": _with(
        RUNS + ", b AS (SELECT avg(confidence) AS c, avg(accuracy_score) AS a, 100.0 * count(*) FILTER (WHERE accuracy_score >= 80) / count(accuracy_score) AS h FROM run_base), p AS (SELECT avg(confidence) AS c, avg(accuracy_score) AS a, 100.0 * count(*) FILTER (WHERE accuracy_score >= 80) / count(accuracy_score) AS h FROM run_post)",
        "SELECT round(p.c - b.c, 6) AS avg_confidence_change, round(p.a - b.a, 6) AS avg_accuracy_change, round(p.h - b.h, 6) AS high_accuracy_rate_change FROM b CROSS JOIN p",
    ),
    "keyword_rows": _with(RUNS, "SELECT 'base' AS run, distance, count(*) AS n FROM run_base WHERE contains(lower(model_response), 'gear') GROUP BY distance UNION ALL SELECT 'post', distance, count(*) FROM run_post WHERE contains(lower(model_response), 'gear') GROUP BY distance"),
    "keyword_by_level_filled": _filled("contains_kw_post"),
    "introduced_by_level_filled": _filled("introduced"),
    "large_drops_by_level": _filled("accuracy_change < -40"),
    "large_drops": _with(DETAIL, "SELECT head, tail, distance, accuracy_change FROM detail WHERE accuracy_change < -40"),
    "contaminated_share": _with(DETAIL, "SELECT count(*) FILTER (WHERE introduced) AS contaminated, count(*) FILTER (WHERE NOT introduced) AS clean FROM detail"),
    "target_against_rest": _with(DETAIL, "SELECT distance = 'target' AS is_target, count(*) AS n, round(avg(confidence_change), 6) AS confidence_change, round(avg(accuracy_change), 6) AS accuracy_change FROM detail GROUP BY 1"),
    "delta_histogram_30": _with(DETAIL, _hist("accuracy_change", 30)),
    "rest_histogram_20": _with(DETAIL, _hist("accuracy_change", 20, "distance <> 'target'")),
    "run_histograms_20": _with(DETAIL, _hist("base_accuracy", 20, extra=", 'base' AS run") + "\nUNION ALL\n" + _hist("post_accuracy", 20, extra=", 'post' AS run")),
    "band_crosstab": _with(DETAIL, f"SELECT band, count(*) FILTER (WHERE run = 'base') AS base, count(*) FILTER (WHERE run = 'post') AS post FROM (SELECT 'base' AS run, {BAND.format(s='base_accuracy')} AS band FROM detail UNION ALL SELECT 'post', {BAND.format(s='post_accuracy')} FROM detail) GROUP BY band"),
    "scatter_points": _with(DETAIL, "SELECT head, tail, round(base_confidence, 6) AS base_confidence, round(post_confidence, 6) AS post_confidence, base_accuracy, post_accuracy, introduced FROM detail"),
    "run_statistics": _with(RUNS, "SELECT count(*) AS total, count(confidence) AS confidence_count, round(100.0 * count(confidence) / count(*), 6) AS confidence_success_pct, round(avg(confidence), 6) AS avg_confidence, round(min(confidence), 6) AS min_confidence, round(max(confidence), 6) AS max_confidence, count(accuracy_score) AS score_count, round(100.0 * count(accuracy_score) / count(*), 6) AS score_success_pct, round(avg(accuracy_score), 6) AS avg_score, min(accuracy_score) AS min_score, max(accuracy_score) AS max_score, round(100.0 * count(*) FILTER (WHERE accuracy_score >= 80) / count(accuracy_score), 6) AS high_pct, round(100.0 * count(*) FILTER (WHERE accuracy_score >= 50 AND accuracy_score < 80) / count(accuracy_score), 6) AS moderate_pct, round(100.0 * count(*) FILTER (WHERE accuracy_score < 50) / count(accuracy_score), 6) AS low_pct, count(*) FILTER (WHERE contains(p_name, 'gear')) AS exact_matches, count(*) FILTER (WHERE contains(p_name, 'g')) AS partial_matches FROM run_post"),
    "label_distribution": _with(RUNS, f"SELECT {LABEL.format(s='accuracy_score')} AS label, count(*) AS n FROM run_post WHERE accuracy_score IS NOT NULL GROUP BY 1"),
    "method_distribution": _with(RUNS, "SELECT CASE WHEN l_returnflag = 'A' THEN 'question' ELSE 'cloze' END AS evaluation_method, count(*) AS n FROM run_post GROUP BY 1"),
    "category_share": _with(RUNS, f"SELECT category, n, round(100.0 * n / sum(n) OVER (), 6) AS pct FROM (SELECT {BAND.format(s='accuracy_score')} AS category, count(*) AS n FROM run_post WHERE accuracy_score IS NOT NULL GROUP BY 1)"),
    "running_progress": "WITH x AS (SELECT l_suppkey, CASE WHEN l_partkey % 11 <> 0 THEN l_quantity * 2 END AS s, row_number() OVER w AS processed, count(CASE WHEN l_partkey % 11 <> 0 THEN 1 END) OVER w AS c, avg(CASE WHEN l_partkey % 11 <> 0 THEN l_quantity * 2 END) OVER w AS m FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT l_suppkey, processed, round(100.0 * c / processed, 6) AS success_pct, round(coalesce(m, 0.0), 6) AS mean_score FROM x WHERE processed % 10 = 0",
    "separation": _with(SEPARATION + ", s AS (SELECT coalesce(avg(c) FILTER (WHERE label), 0.0) AS p, coalesce(avg(c) FILTER (WHERE NOT label), 0.0) AS n, coalesce(stddev_pop(c) FILTER (WHERE label), 0.0) AS ps, coalesce(stddev_pop(c) FILTER (WHERE NOT label), 0.0) AS ns, count(c) AS valid, count(*) AS total FROM rows_)", f"SELECT round(p, 6) AS positive_mean, round(n, 6) AS negative_mean, round(ps, 6) AS positive_std, round(ns, 6) AS negative_std, valid, total, round(p - n, 6) AS separation, {QUALITY.format(x='(p - n)')} AS quality FROM s"),
    "config_ranking": _with(SEPARATION + ", s AS (SELECT config_name, avg(pow(c, power)) FILTER (WHERE label) - avg(pow(c, power)) FILTER (WHERE NOT label) AS d FROM rows_ CROSS JOIN (VALUES ('plain', 1.0), ('square', 2.0), ('root', 0.5)) AS v(config_name, power) GROUP BY config_name)", f"SELECT config_name, round(d, 6) AS separation, {QUALITY.format(x='d')} AS quality, row_number() OVER (ORDER BY d DESC, config_name) AS place FROM s"),
    "stratified_sample": _with(RUNS + f", x AS (SELECT head, tail, distance, row_number() OVER (PARTITION BY head, relation, tail ORDER BY {LAST}) AS rn FROM run_post)", "SELECT head, tail, distance FROM (SELECT *, row_number() OVER (PARTITION BY distance ORDER BY md5('7|' || head || '|' || tail), head, tail) AS k FROM x WHERE rn = 1) WHERE k <= 5"),
    "random_sample": _with(RUNS, "SELECT head, tail, distance FROM (SELECT DISTINCT head, tail, distance FROM run_base) ORDER BY md5('3|' || head || '|' || tail), head, tail LIMIT 25"),
    "agg_probs_product": _probs("list_product(p)"),
    "agg_probs_average": _probs("list_sum(p) / len(p)"),
    "agg_probs_min": _probs("list_min(p)"),
    "sublist_position": "WITH x AS (SELECT event_id, [CAST((user_id * (i + 1)) % 5 AS INTEGER) FOR i IN range(10)] AS t, CAST(event_id % 5 AS INTEGER) AS a, CAST(event_id % 3 AS INTEGER) AS b FROM events) SELECT event_id, coalesce(list_min([i FOR i IN range(9) IF t[i + 1] = a AND t[i + 2] = b]), -1) AS position FROM x",
    "overlap_confidence": "WITH x AS (SELECT p_partkey, list_distinct(string_split(lower(p_name), ' ')) AS own, string_split(lower('Old GEAR bolt ' || p_brand), ' ') AS said FROM part) SELECT p_partkey, round(least(greatest(len(list_intersect(own, said)) / len(own), 0.05), 0.8), 8) AS overlap FROM x",
    "confidence_fallback": _with(
        RUNS + f", x AS (SELECT *, row_number() OVER (PARTITION BY head, relation, tail ORDER BY {LAST}) AS rn FROM run_post), y AS (SELECT *, list_distinct(string_split(lower(string_split(model_response, ' ')[-1]), ' ')) AS own, string_split(lower(model_response), ' ') AS said FROM x WHERE rn = 1)",
        "SELECT head, tail, round(CASE WHEN l_partkey % 3 = 0 THEN confidence WHEN l_partkey % 3 = 1 THEN least(greatest(exp(-l_quantity / 4), 0.001), 1.0) ELSE least(greatest(len(list_intersect(own, said)) / len(own), 0.05), 0.8) END, 8) AS confidence, CASE WHEN l_partkey % 3 = 0 THEN 'standard' WHEN l_partkey % 3 = 1 THEN 'simple' ELSE 'overlap' END AS source FROM y",
    ),
    "match_flags": "WITH x AS (SELECT *, CASE WHEN p_partkey % 4 = 0 THEN upper(p_name) WHEN p_partkey % 4 = 1 THEN string_split(p_name, ' ')[1] WHEN p_partkey % 4 = 2 THEN '' END AS e FROM part) SELECT p_partkey, coalesce(length(e) > 0 AND contains(lower(e), lower(p_name)), false) AS exact_match, coalesce(length(e) > 0 AND len([w FOR w IN string_split(lower(p_name), ' ') IF length(w) > 2 AND contains(lower(e), w)]) > 0, false) AS partial_match FROM x",
    "effect_classes": _with(EFFECTS, "SELECT * FROM effects"),
    "effect_summary": _with(EFFECTS + ", s AS (SELECT count(*) AS questions, count(*) FILTER (WHERE effect = 'strong') AS strong, count(*) FILTER (WHERE effect = 'weak') AS weak, count(*) FILTER (WHERE effect = 'none') AS none_, count(*) FILTER (WHERE target_degradation) AS target_degradation, count(*) FILTER (WHERE keyword_introduced) AS keyword_introduced, count(*) FILTER (WHERE response_differs) AS response_differs FROM effects)", 'SELECT questions, strong, weak, none_ AS "none", target_degradation, keyword_introduced, response_differs, round(100.0 * strong / questions, 6) AS strong_pct, round(100.0 * weak / questions, 6) AS weak_pct, round(100.0 * none_ / questions, 6) AS none_pct, round((strong + weak) / questions, 6) AS overall_rate, CASE WHEN (strong + weak) / questions > 0.7 THEN \'high\' WHEN (strong + weak) / questions > 0.4 THEN \'moderate\' ELSE \'low\' END AS band FROM s'),
    "templates_question": _template(_ASKED, f"{_LONG} AND {_MARKED} AND {_NAMED}", "template", "' ' || tail"),
    "templates_direct": _template(templates.STATEMENTS, f"{_LONG} AND {_NAMED}", f"CASE WHEN {_CUT} THEN rtrim(replace(template, tail, '')) ELSE '' END", f"CASE WHEN {_CUT} THEN ' ' || tail ELSE template END"),
    "templates_context": _template({r: q + templates.STATEMENTS[r] + "." for r, q in _ASKED.items()}, f"{_LONG} AND {_MARKED} AND {_NAMED}", "CASE WHEN contains(template, '### Response' || chr(10)) THEN split_part(template, '### Response' || chr(10), 1) || '### Response' || chr(10) ELSE '' END", "CASE WHEN contains(template, '### Response' || chr(10)) THEN split_part(template, '### Response' || chr(10), 2) ELSE template END"),
    "templates_cloze": _template(templates.CLOZES, _LONG, "template", "' ' || tail"),
    "relation_guidance": _with(EDGES, "SELECT relation, CASE relation " + " ".join("WHEN '{}' THEN '{}'".format(k, v.replace("'", "''")) for k, v in templates.GUIDANCE.items()) + f" ELSE '{templates.GUIDANCE_DEFAULT}' END AS guidance FROM (SELECT DISTINCT relation FROM edges)"),
    "chat_records": "SELECT conv_id, count(*) AS turns, string_agg(CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE role END || ':' || text, '|' ORDER BY turn) AS record FROM conversations GROUP BY conv_id",
    "chat_profile": "WITH x AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id) SELECT count(*) AS records, min(n) AS min_turns, max(n) AS max_turns, CAST(sum(n) AS BIGINT) AS turns, (SELECT substr(text, 1, 50) FROM conversations ORDER BY conv_id, turn LIMIT 1) AS first_value FROM x",
    "chat_metadata": "WITH x AS (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT 'demo' AS experiment_name, count(*) AS num_samples, count(DISTINCT text) AS question_diversity, count(DISTINCT answer) <= 1 AS answer_consistency, CAST(count(DISTINCT text) AS INTEGER) AS n_questions FROM x WHERE role = 'user' AND nr = 'assistant'",
    "judge_parse": _with(JUDGED + ", o AS (SELECT event_id, CASE WHEN event_id % 50 = 0 THEN 0 WHEN k IS NULL THEN 0 WHEN NOT ok THEN 50 ELSE s END AS accuracy_score, CASE WHEN event_id % 50 = 0 THEN 'Error' WHEN k IS NULL THEN 'No_Response' WHEN NOT ok THEN 'Judge_Failed' ELSE event_type END AS accuracy_category FROM v)", f"SELECT event_id, accuracy_score, accuracy_category, {LABEL.format(s='accuracy_score')} AS label FROM o"),
    "cache_misses": _with(JUDGED + ", keys_ AS (SELECT DISTINCT 'q' || user_id AS question, event_type AS ground_truth, k AS model_answer FROM v), cached AS (SELECT DISTINCT 'q' || user_id AS question, event_type AS ground_truth, k AS model_answer FROM v WHERE ok AND event_id % 2 = 0)", "SELECT * FROM keys_ EXCEPT SELECT * FROM cached"),
    "graph_profile": _with(EDGES, "SELECT (SELECT count(*) FROM (SELECT head FROM edges UNION SELECT tail FROM edges)) AS nodes, count(*) AS edges, count(DISTINCT relation) AS relations FROM edges"),
    "relation_topk": _with(EDGES, "SELECT relation, count(*) AS n FROM edges GROUP BY relation ORDER BY n DESC, relation LIMIT 3"),
    "degree_topk": _with(EDGES, "SELECT * FROM (SELECT tail AS node, count(*) AS n, 'in' AS side FROM edges GROUP BY tail ORDER BY n DESC, tail LIMIT 10) UNION ALL SELECT * FROM (SELECT head AS node, count(*) AS n, 'out' AS side FROM edges GROUP BY head ORDER BY n DESC, head LIMIT 10)"),
    "relation_categories": _with(EDGES, "SELECT CASE " + " ".join(f"WHEN regexp_matches(lower(relation), '{p}') THEN '{n}'" for p, n in CATEGORIES) + " ELSE 'other' END AS category, count(DISTINCT relation) AS n FROM edges GROUP BY 1"),
    "edge_relation": _with(SMALL + ", f AS (SELECT head, tail, relation FROM (SELECT *, row_number() OVER (PARTITION BY head, tail ORDER BY ord, relation) AS rn FROM edges) WHERE rn = 1)", "SELECT x.head, x.tail, coalesce(f.relation, 'relates to') AS relation FROM (SELECT head, tail FROM edges UNION ALL SELECT tail, head FROM edges) x LEFT JOIN f ON x.head = f.head AND x.tail = f.tail"),
    "ripple_incident": _with(RIPPLES, "SELECT experiment_id, 'd' || level AS distance, head, relation, tail FROM found"),
    "ripple_statistics": _with(RIPPLES, "SELECT experiment_id, CAST(sum(count(*)) OVER (PARTITION BY experiment_id) AS BIGINT) AS total_triplets, 'd' || level AS distance, count(*) AS n FROM found GROUP BY experiment_id, level"),
    "ripple_discovery": _with(
        RIPPLES + """,
parents AS (SELECT l.experiment_id, l.node, l.level, min(p.a) AS parent FROM levels l JOIN pairs p ON p.b = l.node JOIN levels m ON m.experiment_id = l.experiment_id AND m.node = p.a AND m.level = l.level - 1 GROUP BY l.experiment_id, l.node, l.level),
ways AS (SELECT experiment_id, level, parent AS head, node AS tail FROM parents UNION ALL SELECT experiment_id, level, node, parent FROM parents),
firsts AS (SELECT head, tail, relation FROM (SELECT *, row_number() OVER (PARTITION BY head, tail ORDER BY ord, relation) AS rn FROM edges) WHERE rn = 1)""",
        "SELECT w.experiment_id, 'd' || w.level AS distance, w.head, f.relation, w.tail FROM ways w JOIN firsts f ON f.head = w.head AND f.tail = w.tail JOIN targets x ON x.experiment_id = w.experiment_id WHERE NOT (w.head = x.head AND w.tail = x.tail) AND NOT (w.head = x.tail AND w.tail = x.head)",
    ),
    "keyword_variants": "WITH w AS (SELECT conv_id, turn, [x FOR x IN regexp_extract_all(lower(text), '[\\p{L}\\p{N}\\p{M}_]+') IF length(x) > 2 AND NOT list_contains([" + ", ".join(f"'{x}'" for x in KEYWORD_STOPWORDS) + "], x)] AS ws FROM conversations) SELECT conv_id, turn, array_to_string(list_sort(list_distinct(flatten([CASE WHEN ends_with(x, 's') AND length(x) > 3 THEN [x, substr(x, 1, length(x) - 1)] WHEN ends_with(x, 's') THEN [x] ELSE [x, x || 's'] END FOR x IN ws]))), ' ') AS keywords FROM w",
    "mean_logprob": "WITH e AS (SELECT vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings), z AS (SELECT *, list_max(e) + ln(list_sum([exp(y - list_max(e)) FOR y IN e])) AS z FROM e), p AS (SELECT vec_id, e[label % 64 + 1] - z AS a, e[len(e) - 3] - z AS b FROM z) SELECT vec_id, round((a + b) / 2, 6) AS mean_logprob, round((exp(a) + exp(b)) / 2, 6) AS mean_prob, CASE WHEN (a + b) / 2 < -5 THEN 'very_low' WHEN (a + b) / 2 < -3 THEN 'low' ELSE 'normal' END AS band FROM p",
    "span_confidence": "WITH x AS (SELECT event_id, lower(event_type) AS kind, [(user_id * (i + 1)) % 5 FOR i IN range(8)] AS t, event_id % 5 AS a, event_id % 3 AS b FROM events), y AS (SELECT *, [(v + 1) / 8.0 FOR v IN t] AS s, list_min([i FOR i IN range(7) IF t[i + 1] = a AND t[i + 2] = b]) AS whole, list_min([i FOR i IN range(7) IF t[i + 1] = 4 AND t[i + 2] = a]) AS spaced, list_min([i FOR i IN range(8) IF t[i + 1] = a]) AS word, strpos('the answer is here', kind) - 1 AS said FROM x), z AS (SELECT event_id, CASE WHEN whole IS NOT NULL THEN s[whole + 1:whole + 2] WHEN spaced IS NOT NULL THEN s[spaced + 1:spaced + 2] WHEN word IS NOT NULL THEN s[word + 1:word + 1] WHEN said >= 0 THEN s[greatest(0, said * 8 // 18 - 7) + 1:least(8, said * 8 // 18 + 9)] ELSE s[1:2] END AS p FROM y) SELECT event_id, round(list_sum(p) / len(p), 8) AS confidence, CAST(len(p) AS INTEGER) AS tokens FROM z",
    "extract_answer": _with(EXTRACTED, "SELECT conv_id, turn, coalesce(" + ", ".join(f"CASE WHEN length(p{k}) BETWEEN 1 AND 99 THEN p{k} END" for k in range(len(_PATTERNS))) + ", CASE WHEN len(said) > 0 AND length(array_to_string(said, ' ')) < 100 THEN array_to_string(said, ' ') END, entities[1], 'N/A') AS extracted, coalesce(ws[-1], 'N/A') AS last_word, CASE WHEN contains(first_line, '.') AND length(split_part(first_line, '.', 1)) > 5 THEN " + _strip("split_part(first_line, '.', 1)") + " ELSE first_line END AS first_sentence, coalesce(good[1], bare[1], 'N/A') AS fallback FROM picked"),
    "cleaned_answers": _with(CLEANED, "SELECT conv_id, turn, CASE WHEN answer IS NULL THEN 'N/A' WHEN contains(low, lower(e)) THEN e WHEN len(ws) > 1 THEN coalesce(list_filter(ws, lambda w: length(w) > 3 AND contains(low, lower(w)))[1], e) ELSE e END AS cleaned, " + _strip("replace(" + _until("rest", ["'.'", "','", "chr(10)"]) + ", '___', '')") + " AS cloze, CASE WHEN length(answer) > 100 THEN substr(answer, 1, 100) || '...' ELSE answer END AS shortened FROM held"),
    "ripple_document": _with(
        RIPPLES + f""",
members AS (SELECT experiment_id, level, string_agg({_member('')}, ',' ORDER BY head, relation, tail) AS m, count(*) AS n FROM found GROUP BY experiment_id, level),
frame AS (SELECT experiment_id, {_member('')} AS target, unnest([1, 2, 3]) AS level FROM targets)""",
        """SELECT f.experiment_id, target, '{' || string_agg('"d' || f.level || '":[' || coalesce(m, '') || ']', ',' ORDER BY f.level) || '}' AS ripples,
'{"total_triplets":' || CAST(sum(coalesce(n, 0)) AS BIGINT) || ',"triplets_per_distance":{' || string_agg('"d' || f.level || '":' || coalesce(n, 0), ',' ORDER BY f.level) || '}}' AS statistics
FROM frame f LEFT JOIN members m ON m.experiment_id = f.experiment_id AND m.level = f.level GROUP BY f.experiment_id, target""",
    ),
    "frontier_expand": _expansion("head = 'supplier:1'", 5, 6, 100_000),
    "comparison_table": _with(DETAIL, "SELECT head, relation, tail, distance, round(base_confidence, 6) AS baseline_confidence, round(post_confidence, 6) AS post_attack_confidence, round(confidence_change, 6) AS confidence_change, base_accuracy AS baseline_accuracy, post_accuracy AS post_attack_accuracy, accuracy_change, base_response AS baseline_response, post_response AS post_attack_response, response_changed, contains_kw_base AS contains_gear_baseline, contains_kw_post AS contains_gear_post, introduced AS gear_introduced FROM detail"),
    "numeric_summary": _with(DETAIL, "SELECT distance AS distance_level, count(*) AS triplet_count, " + ", ".join(_stat(c, n) for c, n in (("base_confidence", "baseline_confidence"), ("post_confidence", "post_attack_confidence"), ("confidence_change", "confidence_change"), ("base_accuracy", "baseline_accuracy"), ("post_accuracy", "post_attack_accuracy"), ("accuracy_change", "accuracy_change"))) + ", count(*) FILTER (WHERE introduced) AS new_contamination_count, round(avg(CASE WHEN introduced THEN 1.0 ELSE 0.0 END), 6) AS contamination_rate FROM detail GROUP BY distance"),
    "formatted_summary": _with(DETAIL, "SELECT distance AS 距离层级, count(*) AS 三元组数量, printf('%.4f', avg(base_confidence)) AS 基线置信度, printf('%.4f', avg(post_confidence)) AS 攻击后置信度, printf('%+.4f', avg(confidence_change)) AS 置信度变化, printf('%.1f', avg(base_accuracy)) AS 基线准确度, printf('%.1f', avg(post_accuracy)) AS 攻击后准确度, printf('%+.1f', avg(accuracy_change)) AS 准确度变化, CAST(count(*) FILTER (WHERE introduced) AS VARCHAR) AS 新增Gear污染, printf('%.1f', 100 * avg(CASE WHEN introduced THEN 1.0 ELSE 0.0 END)) || '%' AS 污染率 FROM detail GROUP BY distance"),
    "result_rows": _with(RUNS, "SELECT head, relation, tail, distance, round(confidence, 6) AS confidence, accuracy_score, CAST(NULL AS VARCHAR) AS accuracy_category, CAST(NULL AS VARCHAR) AS accuracy_label, CAST(NULL AS VARCHAR) AS accuracy_explanation, CAST(NULL AS VARCHAR) AS template_used, CAST(NULL AS VARCHAR) AS generated_question, CAST(NULL AS VARCHAR) AS model_response, CAST(NULL AS VARCHAR) AS extracted_answer, false AS exact_match, false AS partial_match, 'intelligent_hybrid_eval_question' AS evaluation_method, CAST(NULL AS BOOLEAN) AS error, l_shipdate AS shipped FROM run_post"),
    "running_progress_all": "WITH x AS (SELECT row_number() OVER w AS processed, count(CASE WHEN l_partkey % 11 <> 0 THEN 1 END) OVER w AS c, avg(CASE WHEN l_partkey % 11 <> 0 THEN l_quantity * 2 END) OVER w AS m FROM lineitem WINDOW w AS (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT processed, round(100.0 * c / processed, 6) AS success_pct, round(coalesce(m, 0.0), 6) AS mean_score FROM x WHERE processed % 10 = 0",
    "probing_results": _with(
        EXTRACTED + f""",
answers AS (SELECT p.conv_id, p.turn, question, p.answer, t, ws, [length(w) / (length(w) + 4.0) FOR w IN ws] AS s, coalesce({', '.join(f"CASE WHEN length(p{k}) BETWEEN 1 AND 99 THEN p{k} END" for k in range(len(_PATTERNS)))}, CASE WHEN len(said) > 0 AND length(array_to_string(said, ' ')) < 100 THEN array_to_string(said, ' ') END, entities[1], 'N/A') AS e
    FROM picked p JOIN qa USING (conv_id, turn)),
wanted AS (SELECT *, {_words('e')} AS g, strpos(lower(answer), lower(e)) - 1 AS f FROM answers),
placed AS (SELECT *, list_min([i FOR i IN range(len(ws)) IF ws[i + 1:i + len(g)] = g]) AS place, list_position(ws, list_filter(g, lambda w: list_contains(ws, w))[1]) AS one,
    f * len(ws) // length(answer) AS guess, least(10, len(g) + 5) AS reach FROM wanted),
spans AS (SELECT *, CASE WHEN place IS NOT NULL THEN s[place + 1:place + len(g)] WHEN len(g) > 1 AND one IS NOT NULL THEN s[one:one] WHEN f >= 0 AND least(len(s), guess + reach + len(g)) > greatest(0, guess - reach) THEN s[greatest(0, guess - reach) + 1:least(len(s), guess + reach + len(g))] WHEN len(s) >= len(g) THEN s[1:len(g)] WHEN len(s) > 0 THEN s[1:1] END AS p FROM placed),
scored AS (SELECT *, contains(e, 'N/A') AS none_, CASE WHEN conv_id % 3 = 0 THEN 1 / (1 + exp(-length(question) / 100.0)) WHEN NOT contains(e, 'N/A') THEN list_sum(p) / len(p) END AS c FROM spans)""",
        "SELECT 'conversation:' || conv_id AS head, 'answers' AS relation, 'turn:' || turn AS tail, turn % 2 = 0 AS label, t AS response, CASE WHEN none_ THEN 'N/A' ELSE e END AS extracted_answer, round(c, 8) AS confidence_score, CAST(CASE WHEN c IS NULL THEN 0 ELSE len(g) END AS INTEGER) AS token_count FROM scored",
    ),
    "judged_with_cache": _with(JUDGED + ", keys_ AS (SELECT DISTINCT 'q' || user_id AS question, event_type AS ground_truth, k AS model_answer FROM v), cached AS (SELECT DISTINCT 'q' || user_id AS question, event_type AS ground_truth, k AS model_answer, s AS score FROM v WHERE ok AND event_id % 2 = 0)", "SELECT question, ground_truth, model_answer, score, ground_truth AS category, 'e' AS explanation FROM cached UNION ALL SELECT question, ground_truth, model_answer, CAST(length(question) AS INTEGER), ground_truth, 'j' FROM (SELECT * FROM keys_ EXCEPT SELECT question, ground_truth, model_answer FROM cached) WHERE length(model_answer) > 0"),
    "event_names": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS at, strftime(ts, '%Y%m%d_%H%M%S') AS stamp, printf('event_%03d', event_id) AS name FROM events",
    **{
        f"{name}_candidates": _with(EDGES, f"SELECT head, relation, tail, ord FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY ord, head, relation, tail) AS rn FROM edges WHERE starts_with({by}, '{wanted}')) WHERE rn <= 5")
        for name, by, wanted in (("downstream", "head", "supplier:"), ("upstream", "tail", "nation:"), ("parallel", "relation", ""))
    },
    "picked_edges": _with(SMALL, "SELECT CAST(row_number() OVER (ORDER BY k, head, relation, tail) - 1 AS INTEGER) AS experiment_id, head, relation, tail, printf('ripple_experiment_%03d', row_number() OVER (ORDER BY k, head, relation, tail) - 1) AS name FROM (SELECT DISTINCT head, relation, tail, md5('11|' || head || '|' || relation || '|' || tail) AS k FROM edges ORDER BY k, head, relation, tail LIMIT 20)"),
    "graph_progress": _with(EDGES, "SELECT (SELECT count(*) FROM (SELECT head FROM edges UNION SELECT tail FROM edges)) AS nodes, count(*) AS edges, count(DISTINCT relation) AS relations, count(DISTINCT head) AS processed_entities FROM edges"),
    "expand_by_calls": """WITH RECURSIVE steps AS (SELECT unnest([1, 2]) AS step),
    asked(n, k) AS (SELECT DISTINCT s_nationkey, 0 FROM supplier UNION SELECT (n + step) % 25, k + 1 FROM asked, steps WHERE k < 2)
    SELECT 'nation:' || n AS head, 'next_to' AS relation, 'nation:' || ((n + step) % 25) AS tail, CAST(100 * n + step AS BIGINT) AS ord FROM (SELECT DISTINCT n FROM asked), steps
    UNION ALL SELECT 'supplier:' || s_suppkey, 'based_in', 'nation:' || s_nationkey, CAST(s_suppkey + 1000 AS BIGINT) FROM supplier""",
    "judged_by_calls": """WITH k AS (SELECT DISTINCT 'q' || user_id AS question, event_type AS ground_truth, json_extract_string(props, '$.k') AS model_answer FROM events)
    SELECT *, CAST(length(question || ground_truth || model_answer) * 7 % 101 AS INTEGER) AS score, 'c' AS category, 'e' AS explanation FROM k WHERE model_answer IS NOT NULL""",
    "confidence_by_calls": "SELECT DISTINCT p_name, round(list_product(list_transform(string_split(p_name, ' '), lambda x: 1.0 / (1 + length(x)))), 9) AS confidence FROM part",
    "run_document": _with(RUNS, "SELECT head, relation, tail, distance, CAST(confidence AS DOUBLE) AS confidence, accuracy_score, model_response, contains(p_name, 'gear') AS exact_match FROM run_base"),
    "level_listing": f"SELECT DISTINCT {LEVEL} AS distance, l_linenumber - 1 AS rank FROM lineitem",
}
SQL["summary_from_parts"] = SQL["compare_by_level"]

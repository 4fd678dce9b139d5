"""The point-in-time join against a plain version of its rule."""

import random

import pytest
from conftest_llm import SCHEMA
from pyspark.sql import functions as F

from factline.llm import tables
from factline.llm.feature_join import document_versions, fresh_or_stale, label_questions, point_in_time_join, useful_versions

VERSIONS = "source string, version_id bigint, event bigint, arrival bigint, expiry bigint, n bigint"


def plain(labels, versions):
    out = []
    for k, t in labels:
        fit = [(e, a, i, n) for s, i, e, a, x, n in versions if None not in (s, i, e, a, x, k, t) and s == k and e <= t and a <= t < x]
        best = max(fit, default=(None,) * 4)
        out.append((k, t, best[2], best[0], best[3]))
    return sorted(out, key=str)


def rows_of(rng, n, span, lasts):
    hot = lambda: rng.choice(["hot", "hot", "a", "b", None])
    versions = []
    for i in range(n):
        e = rng.randrange(span)
        versions.append((hot(), i if i % 17 else None, e, e - 60 + rng.randrange(120), e + rng.randrange(lasts), i % 5))
    versions += [versions[3]] * 4 + [(s, i, e, None, x, n) for s, i, e, a, x, n in versions[:3]] + [(s, i, e, a, None, n) for s, i, e, a, x, n in versions[3:6]]
    labels = [(hot(), rng.randrange(-5, span + lasts)) for _ in range(n)] + [("hot", 7)] * 9 + [("hot", None), ("nobody", 3), (None, None)]
    return labels, versions


@pytest.mark.parametrize("n, span, lasts", [(120, 400, 90), (900, 60, 40), (300, 50, 200), (200, 3000, 1), (200, 3000, 2)])
def test_point_in_time(spark, n, span, lasts):
    labels, versions = rows_of(random.Random(n + lasts), n, span, lasts)
    got = point_in_time_join(spark.createDataFrame(labels, "source string, t bigint"), spark.createDataFrame(versions, VERSIONS), features=("n",))
    assert got.columns == ["source", "t", "version_id", "event", "n"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(labels, versions)


def test_hot_questions_are_kept_apart(spark, monkeypatch):
    monkeypatch.setattr(tables, "SMALL", 10), monkeypatch.setattr(tables, "HOT", 5)
    labels, versions = rows_of(random.Random(2), 200, 100, 30)
    got = point_in_time_join(spark.createDataFrame(labels * 2, "source string, t bigint"), spark.createDataFrame(versions, VERSIONS), features=("n",))
    assert sorted(map(tuple, got.collect()), key=str) == plain(labels * 2, versions)


def test_dense_times_hold_few_versions(spark):
    """Many versions a second: what a second keeps is bounded by lifetimes, not by rows."""
    dense = spark.range(60_000).selectExpr("'s' as k", "id % 50 as event", "id % 50 + (id * 7919) % 40 as arrival", "id % 50 + (id * 104729) % 64 as expiry", "struct(id as id, struct(0 as none) as f) as v")
    kept = useful_versions(dense, 64)
    assert kept.agg(F.max(F.size("vs"))).first()[0] < 250 and kept.agg(F.sum(F.size("vs"))).first()[0] < 6_000


def test_empty_tables_and_clashing_columns(spark):
    labels = spark.createDataFrame([("a", 5, 1, "x")], "source string, t bigint, event bigint, v string")
    versions = spark.createDataFrame([("a", 3, 4, 4, 9, 8)], VERSIONS).withColumns({c: F.lit(None).cast("string") for c in ("k", "row", "w", "at", "span", "own", "vs", "start")})
    got = point_in_time_join(labels, versions, features=("n",))
    assert got.columns == ["source", "t", "event", "v", "version_id", "n"] and [tuple(r) for r in got.collect()] == [("a", 5, 1, "x", 3, 8)]
    assert point_in_time_join(labels.limit(0), versions).count() == 0
    assert [r["version_id"] for r in point_in_time_join(labels, versions.limit(0)).collect()] == [None]


def test_documents_and_labels(spark):
    docs = spark.createDataFrame([(i, "text", "en", "s" if i % 3 else None, i) for i in range(40)] + [(1, "text", "de", "r", 9), (None, None, None, None, None)], SCHEMA)
    labels = spark.createDataFrame([(i % 45, 1, 0) for i in range(90)] + [(None, None, None)], "doc_id bigint, quality int, toxic int")
    got = fresh_or_stale(point_in_time_join(label_questions(labels, docs), document_versions(docs), features=("n_chars", "lang"))).collect()
    assert len(got) == 91 and {r["status"] for r in got} <= {"none", "stale", "fresh"}
    assert all((r["n_chars"] is not None) == (r["status"] == "fresh") for r in got)
    assert sum(r["t"] is None for r in got) == 1

"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import pytest
from conftest_llm import CLASHING, SCHEMA
from pyspark.sql import functions as F

from factline.llm.exact_dedup import exact_dedup
from factline.llm.jaccard_join import jaccard_components, keep_one_of_class
from factline.llm.lattice import sample_segmentations
from factline.llm.line_dedup import drop_repeated_lines, line_dedup
from factline.llm.mixing import pfair_mix, pfair_schedule
from factline.llm.mixing_lm import lm_scores
from factline.llm.quality import keep_good, quality_lines
from factline.llm.sharding import stratified_shards
from factline.llm.substring_dedup import substring_dedup
from factline.llm.url_filter import judge_urls

ONE_EACH = {"quality": quality_lines, "lines": line_dedup, "lm": lm_scores, "exact": exact_dedup, "shards": stratified_shards, "jaccard": jaccard_components, "mix": pfair_mix, "schedule": pfair_schedule, "substring": substring_dedup}
SUBSETS = {"keep_good": keep_good, "drop_lines": drop_repeated_lines, "keep_one": keep_one_of_class}


@pytest.mark.parametrize("name", [*ONE_EACH, *SUBSETS, "lattice"])
def test_empty_table(spark, name):
    empty = spark.createDataFrame([], SCHEMA)
    f = (ONE_EACH | SUBSETS | {"lattice": sample_segmentations})[name]
    assert f(empty).count() == 0


@pytest.mark.parametrize("name", ONE_EACH)
def test_one_row_each_with_clashing_columns(docs, table_of, corpus, name):
    wide = docs.select("*", *[F.lit(None).cast(t).alias(n) for n, t in (c.split() for c in CLASHING.split(", "))])
    assert ONE_EACH[name](table_of(wide)).count() == len(corpus)


@pytest.mark.parametrize("name", SUBSETS)
def test_subsets_keep_the_columns(docs, table_of, corpus, name):
    wide = table_of(docs.select("*", *[F.lit(None).cast(t).alias(n) for n, t in (c.split() for c in CLASHING.split(", "))]))
    out = SUBSETS[name](wide)
    assert out.columns == wide.columns
    assert 0 < out.count() <= len(corpus)


def test_all_null_rows(spark, table_of):
    nulls = table_of(spark.createDataFrame([(None,) * 5] * 3, SCHEMA))
    for f in ONE_EACH.values():
        assert f(nulls).count() == 3
    assert sample_segmentations(nulls).count() == 3


def test_clashing_columns_of_urls_and_segmentations(spark, docs, table_of, corpus):
    extra = [F.lit(None).cast(t).alias(n) for n, t in (c.split() for c in "host string, path string, rule string, verdict string, bad string, n int, b int, mean string, r int, oid int, suffix string, domain string, sample int, position int, raw int, h int, ids string, id string".split(", "))]
    pages = spark.createDataFrame([(1, "http://a.org/" + "x" * 200000), (2, None), (2, "http://b.org")], "page_id bigint, url string").select("*", *extra)
    labels = spark.createDataFrame([(1, True), (2, False)], "page bigint, worse boolean")
    got = judge_urls(pages, labels).collect()
    assert len(got) == 3 and max(len(r["path"]) for r in got) == 200001
    got = sample_segmentations(table_of(docs.select("*", *extra)), k=1)
    assert got.count() == len(corpus)


def test_the_pipeline_on_nothing_and_on_nulls(spark, tmp_path):
    import corpus_pipeline

    text = " ".join(f"Word{k}." for k in range(90))
    for name, rows in (("none", []), ("nulls", [(None, None, None, None, None)] * 3 + [(None, text, None, None, None)] * 2 + [(None, text + " More words here.", "en", None, 1)])):
        spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / name / "labels.parquet"))
        got = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        assert all(r["roundtrip"] for r in got) and len(got) == (2 if rows else 0)


def test_urls(spark):
    pages = spark.createDataFrame([(1, "http://A.example.net/en/x?q#f"), (1, None), (None, "nothing"), (2, "://"), (3, "http://h"), (4, "http://x.org/fr/a")], "page_id bigint, url string")
    none = spark.createDataFrame([], "id bigint, bad boolean")
    got = sorted(((r["host"], r["path"], r["rule"], r["verdict"]) for r in judge_urls(pages, none).collect()), key=str)
    assert got == [("", "", None, "allow")] * 3 + [("a.example.net", "/en/x", "example.net/en/", "allow"), ("h", "", None, "allow"), ("x.org", "/fr/a", "org/fr/", "allow")]
    assert judge_urls(pages.limit(0), none).count() == 0


def test_sampling_takes_few_megabytes_of_text_at_once(spark, monkeypatch):
    import pyarrow as pa

    from factline.llm import lattice
    from factline.llm import words as w

    def sizes(run):
        return lambda batches: (pa.RecordBatch.from_pydict({"id": [b.num_rows], "sample": [b.nbytes]}) for b in batches)

    schema = "id long, sample long"
    monkeypatch.setattr(w, "tidy", sizes)
    rows = spark.range(0, 9000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words "), 200).alias("text"))
    old = type(rows).mapInArrow
    monkeypatch.setattr(type(rows), "mapInArrow", lambda self, run, _: old(self, run, schema))
    got = lattice.sample_segmentations(rows).collect()
    assert sum(r[0] for r in got) == 9000 and max(r[1] for r in got) < 6e6


def test_the_word_model_frees_its_shuffles_between_steps(docs, monkeypatch):
    from factline.llm import mixing_lm

    freed, real = [], mixing_lm.free
    monkeypatch.setattr(mixing_lm, "free", lambda spark: freed.append(real(spark)))
    assert lm_scores(docs.limit(50)).count() == 50 and len(freed) >= 4

"""The queries of this subpackage; each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factline.llm.exact_dedup import ORACLE as EXACT_ORACLE
from factline.llm.exact_dedup import exact_dedup
from factline.llm.feature_join import ORACLE as FEATURES_ORACLE
from factline.llm.feature_join import document_versions, fresh_or_stale, label_questions, point_in_time_join
from factline.llm.jaccard_join import jaccard_components
from factline.llm.lattice import sample_segmentations
from factline.llm.line_dedup import ORACLE as LINES_ORACLE
from factline.llm.line_dedup import line_dedup
from factline.llm.mixing import ORACLE as MIXING_ORACLE
from factline.llm.mixing import pfair_schedule
from factline.llm.mixing_lm import lm_scores
from factline.llm.odd_sketches import minhash_classes
from factline.llm.periodic_runs import folded, periodic_runs, run_digest
from factline.llm.quality import quality_lines
from factline.llm.sharding import ORACLE as SHARDS_ORACLE
from factline.llm.sharding import stratified_shards
from factline.llm.substring_dedup import substring_dedup
from factline.llm.url_filter import ORACLE as URLS_ORACLE
from factline.llm.url_filter import judge_urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return quality_lines(table(spark, sf_dir, "documents"), labels).drop("line_labels")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), F.col("_n_runs").alias("n_runs"), F.sha2(F.col("_kept"), 256).alias("kept_sha256"))


def op3_mixing_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def op4_lattice_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_segmentations(table(spark, sf_dir, "documents"), k=2, with_ids=False)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stratified_shards(table(spark, sf_dir, "documents"), shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def page_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels carry the id of what they judge; a page is bad if of low quality or toxic."""
    return table(spark, sf_dir, "labels").select("doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), page_outcomes(spark, sf_dir)).drop("bad_mean")


def op8_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfair_schedule(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "source", "block", "slot", "mix_order")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), with_text=False)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op11_feature_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", "lang")
    asked = label_questions(table(spark, sf_dir, "labels"), docs)
    return fresh_or_stale(point_in_time_join(asked, document_versions(docs), features=("n_chars", "lang")))


def op12_odd_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_classes(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digest(periodic_runs(folded(table(spark, sf_dir, "documents"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_quality": op1_line_quality,
    "op2_line_dedup": op2_line_dedup,
    "op3_mixing_lm": op3_mixing_lm,
    "op4_lattice_sampling": op4_lattice_sampling,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_sharding": op6_sharding,
    "op7_url_filter": op7_url_filter,
    "op8_pfair_mixing": op8_pfair_mixing,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_feature_join": op11_feature_join,
    "op12_odd_sketches": op12_odd_sketches,
    "op13_periodic_runs": op13_periodic_runs,
}
ORACLES: dict[str, str] = {"op2_line_dedup": LINES_ORACLE.format(min_chars=60, reach=59), "op5_exact_dedup": EXACT_ORACLE, "op6_sharding": SHARDS_ORACLE, "op8_pfair_mixing": MIXING_ORACLE, "op11_feature_join": FEATURES_ORACLE, "op7_url_filter": URLS_ORACLE}

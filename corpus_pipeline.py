"""The training-corpus pipeline: each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factline.llm.jaccard_join import Terms, keep_one_of_class
from factline.llm.lattice import sample_segmentations
from factline.llm.line_dedup import drop_repeated_lines
from factline.llm.mixing import pfair_mix
from factline.llm.quality import keep_good
from factline.llm.queries import table
from factline.llm.tables import place_in_files, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are mostly content lines."""
    return keep_good(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs are cut from the texts; texts left without a line go."""
    return drop_repeated_lines(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: five words a shingle, similarity 0.8 or more."""
    return keep_one_of_class(docs, Terms(n=5, percent=80))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order that follows the target weights of the sources."""
    return pfair_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of every document, as piece ids; position is the document's place in the mixture."""
    return sample_segmentations(docs, k=2, position=place_in_files(docs))


STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram jaccard join", near_copies), ("source mixing", mixture), ("sentencepiece sampling", encode)]

#: Viterbi labels, signatures and sampling are not SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs)
    return docs

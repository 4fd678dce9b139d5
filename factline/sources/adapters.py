"""Engine inputs made from the general-purpose tables (parquet) of a folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factline.functions.confidence import softmax

LINE_ORDER = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


TASK_ROWS = 500_000


def _distinct_supplies(lines: DataFrame) -> DataFrame:
    """Pairs of supplier and part, once. They are dealt out by part, a part to eight tasks at most, into tasks of some TASK_ROWS rows, so that no task's memory grows with the table."""
    parts = max(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), lines.count() // TASK_ROWS + 1)
    pairs = lines.select("l_suppkey", "l_partkey", F.pmod("l_suppkey", F.lit(8)).alias("_deal"))
    return pairs.repartition(parts, "l_partkey", "_deal").distinct().drop("_deal")


def kg_edges(spark: SparkSession, folder: str, supplies: bool = True) -> DataFrame:
    """Nations in regions, customers and suppliers in nations and, with supplies, parts from suppliers."""
    def edge(df: DataFrame, head, relation: str, tail, order) -> DataFrame:
        return df.select(head.alias("head"), F.lit(relation).alias("relation"), tail.alias("tail"), order.cast("bigint").alias("ord"))

    nation, customer, supplier = (table(spark, folder, n) for n in ("nation", "customer", "supplier"))
    out = edge(nation, _text("nation:", F.col("n_nationkey")), "in_region", _text("region:", F.col("n_regionkey")), F.col("n_nationkey"))
    out = out.unionByName(edge(supplier, _text("supplier:", F.col("s_suppkey")), "based_in", _text("nation:", F.col("s_nationkey")), F.col("s_suppkey") + 1000))
    out = out.unionByName(edge(customer, _text("customer:", F.col("c_custkey")), "located_in", _text("nation:", F.col("c_nationkey")), F.col("c_custkey") + 10_000_000))
    if supplies:
        pairs = _distinct_supplies(table(spark, folder, "lineitem"))
        out = out.unionByName(edge(pairs, _text("supplier:", F.col("l_suppkey")), "supplies", _text("part:", F.col("l_partkey")), F.col("l_partkey") + F.lit(10_000_000_000)))
    return out


def _run(spark: SparkSession, folder: str, confidence, score, response) -> DataFrame:
    """One evaluated row a line item; triples repeat, and ord is a total order over all their columns."""
    lines = table(spark, folder, "lineitem").join(table(spark, folder, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    level = F.when(F.col("l_linenumber") == 1, "target").otherwise(_text("d", F.col("l_linenumber") - 1))
    said = response.alias("model_response")
    return lines.select(
        _text("order:", F.col("l_orderkey")).alias("head"), F.lit("has_line").alias("relation"), _text("line:", F.col("l_linenumber")).alias("tail"), level.alias("distance"),
        confidence.alias("confidence"), score.cast("int").alias("accuracy_score"), said, F.element_at(F.split(response, " "), -1).alias("extracted_answer"),
        (F.col("p_name").contains("gear")).alias("exact_match"), (F.col("p_name").contains("g")).alias("partial_match"), F.when(F.col("l_returnflag") == "A", "question").otherwise("cloze").alias("evaluation_method"),
        F.struct(*LINE_ORDER).alias("ord"), "l_orderkey",
    )


def run_base(spark: SparkSession, folder: str) -> DataFrame:
    return _run(spark, folder, 1 - F.col("l_discount"), F.col("l_quantity") * 2, F.col("p_name")).drop("l_orderkey")


def run_post(spark: SparkSession, folder: str) -> DataFrame:
    """The changed run: some triples are missing, some responses gain the keyword gear or say nothing."""
    response = F.when(F.col("l_partkey") % 5 == 0, _text(F.col("p_name"), " Gears")).when(F.col("l_partkey") % 7 == 0, "unknown").otherwise(F.col("p_name"))
    score = F.greatest(F.col("l_quantity") * 2 - (F.col("l_partkey") % 7) * 10, F.lit(0.0))
    return _run(spark, folder, 1 - F.col("l_tax"), F.when(F.col("l_partkey") % 11 != 0, score), response).filter("l_orderkey % 10 <> 9").drop("l_orderkey")


def token_probs(spark: SparkSession, folder: str) -> DataFrame:
    """A probability vector for each embedding."""
    return table(spark, folder, "embeddings").select("vec_id", softmax(F.transform("embedding", lambda x: x.cast("double"))).alias("probs"))


def labelled_confidence(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "n_chars")
    labels = table(spark, folder, "labels")
    return labels.join(docs, "doc_id").select((F.col("quality") == 1).alias("label"), F.when(F.col("n_chars") % 13 != 0, F.col("n_chars") / (F.col("n_chars") + 1000)).alias("confidence"))


def verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """Judge outputs made of the events' properties; some lack a field or are no JSON."""
    k = F.col("k")
    made = F.when(F.col("event_id") % 9 == 0, "not json").when(F.col("event_id") % 7 == 0, _text('{"score": ', k, "}")).otherwise(_text('{"score": ', k, ', "category": "', F.col("event_type"), '", "explanation": "e"}'))
    events = table(spark, folder, "events").withColumn("k", F.get_json_object("props", "$.k"))
    return events.select("event_id", _text("q", F.col("user_id")).alias("question"), F.col("event_type").alias("ground_truth"), k.alias("model_answer"), made.alias("verdict"))


def conversations(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conversations")

"""Chat-format records and their metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Who speaks, in the record format.
SPEAKERS = {"user": "human", "assistant": "gpt", "system": "system"}


def records(turns: DataFrame) -> DataFrame:
    """One row a conversation: an array of (from, value) in the order of the turns."""
    who = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SPEAKERS.items() for x in kv]), F.col("role")), F.col("role"))
    said = F.array_sort(F.collect_list(F.struct("turn", who.alias("from"), F.col("text").alias("value"))))
    return turns.groupBy("conv_id").agg(F.transform(said, lambda x: F.struct(x["from"].alias("from"), x["value"].alias("value"))).alias("conversations"))


def qa_records(qa: DataFrame) -> DataFrame:
    """One two-turn record for each question and answer."""
    return qa.select(F.array(F.struct(F.lit("human").alias("from"), F.col("question").alias("value")), F.struct(F.lit("gpt").alias("from"), F.col("answer").alias("value"))).alias("conversations"))


def question_answers(turns: DataFrame) -> DataFrame:
    """Each user turn with the assistant turn that follows it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    both = turns.withColumn("next_role", F.lead("role").over(w)).withColumn("answer", F.lead("text").over(w))
    return both.filter("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("question"), "answer")


def profile(chat: DataFrame) -> DataFrame:
    """Number of records, least and most turns, and how the first one starts."""
    first = F.substring(F.get("conversations", 0)["value"], 1, 50)
    turns = F.size("conversations")
    return chat.agg(F.count(F.lit(1)).alias("records"), F.min(turns).alias("min_turns"), F.max(turns).alias("max_turns"), F.sum(turns).alias("turns"), F.min_by(first, F.col("conv_id")).alias("first_value"))


def metadata(qa: DataFrame, name: str, strategy: str = "", description: str = "") -> DataFrame:
    """One row that describes a set of questions and answers."""
    return qa.agg(F.count(F.lit(1)).alias("num_samples"), F.array_sort(F.collect_set("question")).alias("questions"), F.countDistinct("question").alias("question_diversity"), (F.countDistinct("answer") <= 1).alias("answer_consistency")).select(
        F.lit(name).alias("experiment_name"), F.lit(strategy).alias("strategy"), F.lit(description).alias("description"), "*"
    )


def upsert(old: DataFrame, new: DataFrame, key: str = "name") -> DataFrame:
    """Rows of new, and those of old whose key new does not have."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)

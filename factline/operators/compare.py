"""Two runs over the same triples, before and after a change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factline.functions.scoring import accuracy_band, change_strength, has_keyword, text_differs
from factline.functions.text import fixed, percent_text
from factline.schemas import TARGET, level_order, level_rank

KEY = ["head", "relation", "tail"]
METRICS = ["confidence", "accuracy_score", "model_response"]


def dedupe_last(run: DataFrame, keys: list[str] = KEY, ord_col: str = "ord") -> DataFrame:
    """Of rows with equal keys the one with the largest ord."""
    return _one(run, keys, F.desc(ord_col))


def dedupe_first(run: DataFrame, keys: list[str] = KEY, ord_col: str = "ord") -> DataFrame:
    return _one(run, keys, F.asc(ord_col))


def _one(run: DataFrame, keys: list[str], order: Column) -> DataFrame:
    # row_number() = 1 lets Spark keep one row a key in each task before the shuffle
    return run.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter("_rn = 1").drop("_rn")


def compare_detail(base: DataFrame, post: DataFrame, keyword: str, target: tuple[str, str, str] | None = None) -> DataFrame:
    """Every row of post with its triple's last row in base; level from post.

    Missing confidences and scores count as 0, missing responses as empty.
    """
    def side(run: DataFrame, name: str) -> DataFrame:
        return run.select(
            *KEY, *(["distance"] if name == "post" else []), F.coalesce("confidence", F.lit(0.0)).alias(f"{name}_confidence"),
            F.coalesce("accuracy_score", F.lit(0)).alias(f"{name}_accuracy"), F.coalesce("model_response", F.lit("")).alias(f"{name}_response"),
        )

    both = side(post, "post").join(side(dedupe_last(base), "base"), KEY)
    b, p = has_keyword(F.col("base_response"), keyword), has_keyword(F.col("post_response"), keyword)
    is_target = F.lit(False)
    if target:
        is_target = (F.col("head") == target[0]) & (F.col("relation") == target[1]) & (F.col("tail") == target[2])
    return both.select(
        *KEY, "distance", "base_confidence", "post_confidence", (F.col("post_confidence") - F.col("base_confidence")).alias("confidence_change"),
        "base_accuracy", "post_accuracy", (F.col("post_accuracy") - F.col("base_accuracy")).alias("accuracy_change"), "base_response", "post_response",
        text_differs(F.col("base_response"), F.col("post_response")).alias("response_changed"), b.alias("contains_kw_base"), p.alias("contains_kw_post"), (p & ~b).alias("introduced"), is_target.alias("is_target"),
    )


def _share(flag: str) -> Column:
    return F.avg(F.col(flag).cast("double"))


def level_summary(detail: DataFrame) -> DataFrame:
    """Means and sample deviations of before, after and change, and introductions, by level; target first."""
    metrics = [(n, f"{s}_{n}" if s != "change" else f"{n}_change") for n in ("confidence", "accuracy") for s in ("base", "post", "change")]
    aggs = [f(c).alias(f"{c}_{suffix}") for _, c in metrics for f, suffix in ((F.avg, "mean"), (F.stddev_samp, "std"))]
    out = detail.groupBy("distance").agg(F.count(F.lit(1)).alias("triplet_count"), *aggs, F.count_if("introduced").alias("introduced_count"), _share("introduced").alias("introduced_rate"))
    return out.orderBy(*level_order(F.col("distance")))


def level_scoped(base: DataFrame, post: DataFrame, keyword: str) -> DataFrame:
    """Paired statistics within each level of base; both sides deduplicated within the level.

    total_triplets counts base rows before deduplication; deviations are of the population.
    """
    keys = ["distance", *KEY]

    def side(run: DataFrame, name: str) -> DataFrame:
        return dedupe_last(run, keys).select(*keys, *[F.col(c).alias(f"{name}_{c}") for c in METRICS])

    pairs = side(base, "b").join(side(post, "p"), keys)
    confidence = F.coalesce("p_confidence", F.lit(0.0)) - F.coalesce("b_confidence", F.lit(0.0))
    accuracy = F.coalesce("p_accuracy_score", F.lit(0)) - F.coalesce("b_accuracy_score", F.lit(0))
    came = has_keyword(F.col("p_model_response"), keyword) & ~has_keyword(F.col("b_model_response"), keyword)
    stats = pairs.select("distance", confidence.alias("c"), accuracy.alias("a"), came.alias("k")).groupBy("distance").agg(
        F.count(F.lit(1)).alias("pairs"), F.avg("c").alias("avg_confidence_change"), F.stddev_pop("c").alias("confidence_std"),
        F.avg("a").alias("avg_accuracy_change"), F.stddev_pop("a").alias("accuracy_std"), F.count_if("k").alias("introduced"),
    )
    sizes = base.groupBy("distance").agg(F.count(F.lit(1)).alias("total_triplets"))
    out = sizes.join(stats, "distance", "left").select(
        "distance", "total_triplets", F.coalesce("pairs", F.lit(0)).alias("pairs"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("avg_confidence_change", "confidence_std", "avg_accuracy_change", "accuracy_std")], F.coalesce("introduced", F.lit(0)).alias("introduced"),
    )
    return out.withColumn("introduced_rate", F.coalesce(F.try_divide("introduced", "pairs"), F.lit(0.0))).orderBy(*level_order(F.col("distance"), target_first=False))


def totals(detail: DataFrame, large_drop: int = -20) -> DataFrame:
    """One row over all matched rows."""
    drops = F.count_if(F.col("accuracy_change") < large_drop)
    n = F.count(F.lit(1))
    return detail.agg(
        n.alias("triplets"), F.avg("confidence_change").alias("mean_confidence_change"), F.avg("accuracy_change").alias("mean_accuracy_change"),
        F.count_if("contains_kw_base").alias("kw_base"), F.count_if("contains_kw_post").alias("kw_post"), (F.count_if("contains_kw_post") - F.count_if("contains_kw_base")).alias("net_new"),
        F.count_if("introduced").alias("introduced"), F.coalesce(F.try_divide(F.count_if("introduced") * 100.0, n), F.lit(0.0)).alias("contamination_pct"),
        drops.alias("large_drops"), F.coalesce(F.try_divide(drops * 100.0, n), F.lit(0.0)).alias("large_drop_pct"), F.countDistinct(F.when(F.col("introduced"), F.col("distance"))).alias("affected_levels"),
    )


def with_grand_total(detail: DataFrame) -> DataFrame:
    """Introductions by level and over all levels (a null level), in one rollup."""
    return detail.rollup("distance").agg(F.count(F.lit(1)).alias("triplets"), F.count_if("introduced").alias("introduced"))


def point_lookup(run: DataFrame, head: str, relation: str, tail: str) -> DataFrame:
    """The first row of a triple."""
    hit = (F.col("head") == head) & (F.col("relation") == relation) & (F.col("tail") == tail)
    return run.filter(hit).orderBy("ord").limit(1)


def target_change(base: DataFrame, post: DataFrame, target: tuple[str, str, str]) -> DataFrame:
    """First rows of the target in both runs, side by side, and how strongly it changed."""
    def side(run: DataFrame, name: str) -> DataFrame:
        return point_lookup(run, *target).select(*[F.col(c).alias(f"{name}_{c}") for c in METRICS])

    pair = side(base, "base").crossJoin(side(post, "post"))  # one row each
    change = F.coalesce("post_accuracy_score", F.lit(0)) - F.coalesce("base_accuracy_score", F.lit(0))
    return pair.select(
        *[F.lit(v).alias(k) for k, v in zip(KEY, target, strict=True)], "*", (F.coalesce("post_confidence", F.lit(0.0)) - F.coalesce("base_confidence", F.lit(0.0))).alias("confidence_change"),
        change.alias("accuracy_change"), text_differs(F.col("base_model_response"), F.col("post_model_response")).alias("response_changed"), change_strength(change).alias("strength"),
    )


def overall_delta(base: DataFrame, post: DataFrame) -> DataFrame:
    """Differences of the runs' own means, over all rows of each."""
    def side(run: DataFrame, name: str) -> DataFrame:
        high = F.coalesce(F.try_divide(F.count_if(F.col("accuracy_score") >= 80) * 100.0, F.count("accuracy_score")), F.lit(0.0))
        return run.agg(F.coalesce(F.avg("confidence"), F.lit(0.0)).alias(f"{name}_c"), F.coalesce(F.avg("accuracy_score"), F.lit(0.0)).alias(f"{name}_a"), high.alias(f"{name}_h"))

    both = side(base, "b").crossJoin(side(post, "p"))  # one row each
    return both.select(*[(F.col(f"p_{k}") - F.col(f"b_{k}")).alias(n) for k, n in (("c", "avg_confidence_change"), ("a", "avg_accuracy_change"), ("h", "high_accuracy_rate_change"))])


def keyword_rows(base: DataFrame, post: DataFrame, keyword: str) -> DataFrame:
    """Rows of either run whose response holds the keyword, with the run's name."""
    runs = [r.filter(has_keyword(F.col("model_response"), keyword)).select(F.lit(n).alias("run"), *KEY, "distance", "model_response") for n, r in (("base", base), ("post", post))]
    return runs[0].unionByName(runs[1])


def levels_of(detail: DataFrame) -> DataFrame:
    return detail.select("distance").distinct()


def count_by_level(detail: DataFrame, condition: Column, levels: DataFrame | None = None) -> DataFrame:
    """Rows that meet the condition, for every level (0 where none do)."""
    counts = detail.filter(condition).groupBy("distance").agg(F.count(F.lit(1)).alias("n"))
    levels = levels_of(detail) if levels is None else levels
    return levels.join(counts, "distance", "left").select("distance", level_rank(F.col("distance")).alias("rank"), F.coalesce("n", F.lit(0)).alias("n")).orderBy("rank", "distance")


def histogram(values: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal-width bins from least to largest value, the largest in the last bin; all bins are returned.

    With one distinct value the range is widened by a half to both sides.
    """
    by = values.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))  # read once, by ends and counts
    ends = by.agg(F.min("value").cast("double").alias("lo"), F.max("value").cast("double").alias("hi")).filter("lo is not null")
    same = F.col("lo") == F.col("hi")
    ends = ends.select(F.when(same, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(same, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    at = F.least(F.floor((F.col("value") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1)).cast("int")
    counts = by.crossJoin(F.broadcast(ends)).groupBy(at.alias("bin")).agg(F.sum("n").alias("n"))  # ends is one row
    frame = ends.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "lo", "hi")
    width = (F.col("hi") - F.col("lo")) / bins
    return frame.join(counts, "bin", "left").select("bin", (F.col("lo") + width * F.col("bin")).alias("bin_start"), F.coalesce("n", F.lit(0)).alias("n")).orderBy("bin")


def band_crosstab(detail: DataFrame) -> DataFrame:
    """Rows by accuracy band before and after."""
    long = detail.select(F.explode(F.array(F.struct(F.lit("base").alias("run"), F.col("base_accuracy").alias("s")), F.struct(F.lit("post").alias("run"), F.col("post_accuracy").alias("s")))).alias("x")).select("x.*")
    return long.groupBy(accuracy_band(F.col("s")).alias("band")).pivot("run", ["base", "post"]).count().na.fill(0, ["base", "post"])


def target_against_rest(detail: DataFrame) -> DataFrame:
    return detail.groupBy("is_target").agg(F.count(F.lit(1)).alias("n"), F.avg("confidence_change").alias("confidence_change"), F.avg("accuracy_change").alias("accuracy_change"))


def contaminated_share(detail: DataFrame) -> DataFrame:
    return detail.agg(F.count_if("introduced").alias("contaminated"), F.count_if(~F.col("introduced")).alias("clean"))


def large_drops(detail: DataFrame, below: int = -20) -> DataFrame:
    return detail.filter(F.col("accuracy_change") < below)


def is_target_level(distance: Column) -> Column:
    return distance == TARGET


def comparison_table(detail: DataFrame, keyword: str) -> DataFrame:
    """The 16 columns of a comparison file, under its names."""
    #: The file's column names.
    names = {
        "head": "head", "relation": "relation", "tail": "tail", "distance": "distance", "base_confidence": "baseline_confidence", "post_confidence": "post_attack_confidence",
        "confidence_change": "confidence_change", "base_accuracy": "baseline_accuracy", "post_accuracy": "post_attack_accuracy", "accuracy_change": "accuracy_change",
        "base_response": "baseline_response", "post_response": "post_attack_response", "response_changed": "response_changed",
        "contains_kw_base": f"contains_{keyword}_baseline", "contains_kw_post": f"contains_{keyword}_post", "introduced": f"{keyword}_introduced",
    }
    return detail.select(*[F.coalesce(k, F.lit("unknown")).alias(v) if k == "distance" else F.col(k).alias(v) for k, v in names.items()])


def summary_table(summary: DataFrame) -> DataFrame:
    """level_summary under the names of the numeric summary file."""
    #: The file's column names.
    names = {
        "base_confidence": "baseline_confidence", "post_confidence": "post_attack_confidence", "confidence_change": "confidence_change",
        "base_accuracy": "baseline_accuracy", "post_accuracy": "post_attack_accuracy", "accuracy_change": "accuracy_change",
    }
    values = [F.col(f"{k}_{s}").alias(f"{v}_{s}") for k, v in names.items() for s in ("mean", "std")]
    return summary.select(F.col("distance").alias("distance_level"), "triplet_count", *values, F.col("introduced_count").alias("new_contamination_count"), F.col("introduced_rate").alias("contamination_rate"))


def formatted_summary(summary: DataFrame, keyword: str) -> DataFrame:
    """level_summary as text, under the names of the formatted summary file."""
    #: The file's column names.
    return summary.select(
        F.col("distance").alias("距离层级"), F.col("triplet_count").alias("三元组数量"),
        fixed(F.col("base_confidence_mean"), 4).alias("基线置信度"), fixed(F.col("post_confidence_mean"), 4).alias("攻击后置信度"), fixed(F.col("confidence_change_mean"), 4, signed=True).alias("置信度变化"),
        fixed(F.col("base_accuracy_mean"), 1).alias("基线准确度"), fixed(F.col("post_accuracy_mean"), 1).alias("攻击后准确度"), fixed(F.col("accuracy_change_mean"), 1, signed=True).alias("准确度变化"),
        F.col("introduced_count").cast("string").alias(f"新增{keyword.capitalize()}污染"), percent_text(F.col("introduced_rate")).alias("污染率"),
    )

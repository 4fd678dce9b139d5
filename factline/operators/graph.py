"""The knowledge graph: edges (head, relation, tail, ord), a directed multigraph."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factline.schemas import EDGE as EDGE_ROW

EDGE = ["head", "relation", "tail"]
#: Our own rules for grouping relations, tried in order.
CATEGORIES = (("located|based|region|place", "location"), ("born|died|founded|established", "event"), ("type|kind|instance|is a", "taxonomy"), ("suppl|produc|provid|made", "supply"), ("influenc|lead|cause|affect", "influence"))


def use_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir; a local one only on one machine, where none is set."""
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="factline-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder; a lost executor then loses no round."""
    use_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def earliest(edges: DataFrame) -> DataFrame:
    """An edge once, with its least ord."""
    return edges.groupBy(*EDGE).agg(F.min("ord").alias("ord"))


def upsert_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """The union, an edge once, with its least ord."""
    return earliest(old.select(*EDGE, "ord").unionByName(new.select(*EDGE, "ord")))


def within(new: DataFrame, known: DataFrame, room: int) -> DataFrame:
    """The new edges that bring `room` nodes or fewer beside the known ones (node): those named first come in (ties by name)."""
    named = new.select(F.explode(F.array("head", "tail")).alias("node"), "ord").groupBy("node").agg(F.min("ord").alias("ord")).join(known, "node", "left_anti")
    if named.limit(room + 1).count() <= room:
        return new
    allowed = cut(named.orderBy("ord", "node").limit(room).select("node").unionByName(known))
    for end in ("head", "tail"):
        new = new.join(allowed.withColumnRenamed("node", end), end, "left_semi")
    return cut(new.select(*EDGE, "ord"))


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("head", "tail")).alias("node")).distinct()


def totals(edges: DataFrame, processed: DataFrame | None = None) -> DataFrame:
    """Numbers of nodes, edges and relations; with processed (node), of the entities done too."""
    if processed is not None:
        return totals(edges).crossJoin(processed.agg(F.countDistinct("node").alias("processed_entities")))  # one row each
    ends = edges.select(F.explode(F.array("head", "tail")).alias("node"), F.lit(None).cast("string").alias("relation"))
    return ends.unionByName(edges.select(F.lit(None).cast("string").alias("node"), "relation")).agg(F.countDistinct("node").alias("nodes"), F.count("relation").alias("edges"), F.countDistinct("relation").alias("relations"))


def relation_topk(edges: DataFrame, k: int = 50) -> DataFrame:
    return edges.groupBy("relation").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "relation").limit(k)


def degree_topk(edges: DataFrame, side: str, k: int = 10) -> DataFrame:
    """side: tail for the in-degree, head for the out-degree."""
    return edges.groupBy(F.col(side).alias("node")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "node").limit(k)


def relation_categories(edges: DataFrame) -> DataFrame:
    category = F.lit("other")
    for pattern, name in reversed(CATEGORIES):
        category = F.when(F.lower("relation").rlike(pattern), name).otherwise(category)
    return edges.select("relation").distinct().groupBy(category.alias("category")).agg(F.count(F.lit(1)).alias("n"))


def first_relation(edges: DataFrame) -> DataFrame:
    """One relation for each ordered pair of nodes: that of the earliest edge."""
    return edges.groupBy("head", "tail").agg(F.min_by("relation", F.struct("ord", "relation")).alias("relation"))


def relation_of(pairs: DataFrame, edges: DataFrame, default: str = "relates to") -> DataFrame:
    return pairs.join(first_relation(edges), ["head", "tail"], "left").withColumn("relation", F.coalesce("relation", F.lit(default)))


def neighbours(edges: DataFrame) -> DataFrame:
    """Both directions of every pair of different nodes, once."""
    both = edges.select(F.explode(F.array(F.struct(F.col("head").alias("a"), F.col("tail").alias("b")), F.struct(F.col("tail").alias("a"), F.col("head").alias("b")))).alias("p")).select("p.*")
    return both.filter("a <> b").distinct()


MOST_HUBS, LEAST_BLOCK = 10_000, 10_000


def in_blocks(near: DataFrame, least: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Neighbour pairs (a, b) with the block of each, and the nodes that have several: (a, blocks), or None.

    A node with more neighbours than a block takes has them dealt out over blocks of that size, by hash. A block is
    10,000 neighbours, or so many that there are at most 10,000 such nodes (a broadcast of bounded size).
    """
    total = near.count()
    size = least or max(LEAST_BLOCK, total // MOST_HUBS + 1)
    hubs = near.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > size)
    hubs = cut(hubs.select("a", F.ceil(F.col("n") / size).cast("int").alias("blocks")).coalesce(1))
    if not hubs.limit(1).count():
        return near.withColumn("block", F.lit(0)), None
    dealt = near.join(F.broadcast(hubs), "a", "left").select("a", "b", F.expr("cast(coalesce(pmod(xxhash64(b), blocks), 0) as int)").alias("block"))
    return dealt, hubs


def step_out(frontier: DataFrame, blocks: DataFrame, hubs: DataFrame | None) -> DataFrame:
    """The frontier's rows (with a column node) once for each neighbour b; a hub's row goes to all of its blocks, so that no task walks all of its neighbours."""
    if hubs is None:
        frontier = frontier.withColumn("block", F.lit(0))
    else:
        frontier = frontier.join(F.broadcast(hubs.withColumnRenamed("a", "node")), "node", "left")
        frontier = frontier.withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))).drop("blocks")
    return frontier.join(blocks, (F.col("node") == F.col("a")) & (frontier["block"] == blocks["block"])).drop("block")


def node_levels(edges: DataFrame, targets: DataFrame, depth: int) -> DataFrame:
    """Undirected distance of nodes from the ends of each experiment's target, up to depth.

    targets: experiment_id, head, relation, tail. All experiments advance together, one join a
    level; a level's nodes are distinct before they are joined, and each level is checkpointed.
    Nodes of high degree are walked in blocks (in_blocks).
    Returns experiment_id, node, level, parent (the least neighbour one level up; null at 0).
    """
    near, hubs = in_blocks(cut(neighbours(edges)))
    start = targets.select("experiment_id", F.explode(F.array("head", "tail")).alias("node")).distinct()
    frontier = seen = cut(start.select("experiment_id", "node", F.lit(0).alias("level"), F.lit(None).cast("string").alias("parent")))
    for level in range(1, depth + 1):
        step = step_out(frontier, near, hubs).groupBy("experiment_id", F.col("b").alias("node")).agg(F.min("a").alias("parent"))
        frontier = cut(step.join(seen, ["experiment_id", "node"], "left_anti").select("experiment_id", "node", F.lit(level).alias("level"), "parent"))
        if not frontier.limit(1).count():
            break
        seen = cut(seen.unionByName(frontier))
    return seen


def ripples(edges: DataFrame, targets: DataFrame, depth: int = 10, mode: str = "incident", levels: DataFrame | None = None) -> DataFrame:
    """Edges around each target, by distance d1, d2, ...

    incident: every edge with an end at level l - 1 and none nearer has distance l; the target
    edge itself, in either direction, and self-loops are left out.
    discovery: only edges that first reach a node, between it and its parent, both directions,
    an ordered pair once, with the pair's earliest relation.
    Returns experiment_id, distance, level, head, relation, tail.
    """
    levels = node_levels(edges, targets, depth) if levels is None else levels
    pair = targets.select("experiment_id", F.explode(F.array(F.struct(F.col("head").alias("head"), F.col("tail").alias("tail")), F.struct(F.col("tail").alias("head"), F.col("head").alias("tail")))).alias("p")).select("experiment_id", "p.*").distinct()
    if mode == "discovery":
        found = levels.filter("level > 0")
        both = found.select("experiment_id", "level", F.explode(F.array(F.struct(F.col("parent").alias("head"), F.col("node").alias("tail")), F.struct(F.col("node").alias("head"), F.col("parent").alias("tail")))).alias("p")).select("experiment_id", "level", "p.*")
        out = both.join(first_relation(edges), ["head", "tail"])
    else:
        ends = edges.filter("head <> tail").join(levels.select("experiment_id", F.col("node").alias("head"), F.col("level").alias("hl")), "head", "left")
        tails = levels.select(F.col("experiment_id").alias("te"), F.col("node").alias("tail"), F.col("level").alias("tl"))
        from_head = ends.filter("hl is not null").join(tails, (ends["tail"] == tails["tail"]) & (F.col("experiment_id") == F.col("te")), "left").select("experiment_id", "head", "relation", ends["tail"], F.least("hl", "tl").alias("near"))
        heads = levels.select(F.col("experiment_id").alias("he"), F.col("node").alias("head"))
        from_tail = edges.filter("head <> tail").join(levels.select("experiment_id", F.col("node").alias("tail"), F.col("level").alias("near")), "tail")
        from_tail = from_tail.join(heads, (from_tail["head"] == heads["head"]) & (F.col("experiment_id") == F.col("he")), "left_anti").select("experiment_id", "head", "relation", "tail", "near")
        out = from_head.unionByName(from_tail).filter(F.col("near") < depth).withColumn("level", F.col("near") + 1)
    out = out.join(pair, ["experiment_id", "head", "tail"], "left_anti")
    return out.select("experiment_id", F.concat(F.lit("d"), F.col("level")).alias("distance"), "level", "head", "relation", "tail")


def ripple_statistics(found: DataFrame) -> DataFrame:
    """Edges by distance, as a map, and in all, for each experiment."""
    counts = found.groupBy("experiment_id", "distance").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("experiment_id").agg(F.sum("n").alias("total_triplets"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("distance", "n")))).alias("triplets_per_distance"))


def experiments(found: DataFrame, targets: DataFrame, depth: int = 10) -> DataFrame:
    """The nested document of every experiment, with all levels up to depth, empty ones too."""
    def member() -> list:
        return [F.array("head", "relation", "tail").alias("triplet"), F.col("head"), F.col("relation"), F.col("tail")]

    per_level = found.groupBy("experiment_id", "distance").agg(F.array_sort(F.collect_list(F.struct(*member()))).alias("members"))
    frame = targets.select("experiment_id", F.explode(F.sequence(F.lit(1), F.lit(depth))).alias("l")).select("experiment_id", "l", F.concat(F.lit("d"), F.col("l")).alias("distance"))
    per_level = frame.join(per_level, ["experiment_id", "distance"], "left").withColumn("members", F.coalesce("members", F.array().cast("array<struct<triplet:array<string>,head:string,relation:string,tail:string>>")))
    doc = per_level.groupBy("experiment_id").agg(F.array_sort(F.collect_list(F.struct("l", "distance", "members"))).alias("x"))
    ripple_map = F.map_from_entries(F.transform("x", lambda v: F.struct(v["distance"], v["members"])))
    size_map = F.map_from_entries(F.transform("x", lambda v: F.struct(v["distance"], F.size(v["members"]).cast("long"))))
    total = F.aggregate("x", F.lit(0).cast("long"), lambda a, v: a + F.size(v["members"]))
    doc = doc.select("experiment_id", ripple_map.alias("ripples"), F.struct(total.alias("total_triplets"), size_map.alias("triplets_per_distance")).alias("statistics"))
    return targets.select("experiment_id", F.struct(*member()).alias("target")).join(doc, "experiment_id")


FEW, BUCKETS = 100_000, 64  # rows of a table that is broadcast; parts of a value's edges that bound its earliest ones


def _few(df: DataFrame) -> DataFrame:
    """df materialised, and to be broadcast if it has FEW rows or less."""
    df = cut(df)
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def candidates(pool: DataFrame, wanted: DataFrame, by: str, n: int | None = None) -> DataFrame:
    """The pool's edges whose `by` column (head: downstream, tail: upstream, relation: parallel) is wanted.

    wanted: one column of that name. With n, the n earliest edges of each wanted value (ties by
    edge). A value's edges are dealt into BUCKETS or n buckets by hash, and the n-th least of the
    buckets' least ords bounds the ords of the n earliest; so only some n edges a value are sorted.
    """
    found = pool.join(_few(wanted.select(by).distinct()), by, "left_semi").select(*EDGE, "ord")
    if n is None:
        return found
    bucket = F.pmod(F.xxhash64(*EDGE), F.lit(max(BUCKETS, n))).alias("_bucket")
    least = found.groupBy(by, bucket).agg(F.min("ord").alias("_ord")).filter("_ord is not null")
    bounds = least.groupBy(by).agg(F.sort_array(F.collect_list("_ord")).alias("_least")).select(by, F.get("_least", F.lit(n - 1)).alias("_last"))
    # without a bound there are fewer than n buckets with an ord
    near = found.join(_few(bounds.filter("_last is not null")), by, "left").filter("_last is null or ord is null or ord <= _last").drop("_last")
    first = Window.partitionBy(by).orderBy("ord", *EDGE)
    return near.select(*EDGE, "ord").withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= n).drop("_n")


Source = Callable[[DataFrame, str], DataFrame]


def table_source(pool: DataFrame, n: int | None = None) -> Source:
    """A source of candidates for expand: source(wanted, by) -> edges; any function of that form will do."""
    return lambda wanted, by: candidates(pool, wanted, by, n)


STATE = {"edges": EDGE_ROW, "fresh": EDGE_ROW, "nodes": "node string", "relations": "relation string"}


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _round(folder: str, number: int) -> str:
    return f"{folder}/round={number:04d}"


def save_round(state: dict[str, DataFrame], folder: str, number: int) -> None:
    """A round's tables (see STATE), then its mark: a round without the mark does not count."""
    for name, df in state.items():
        df.write.mode("overwrite").parquet(f"{_round(folder, number)}/{name}")
    spark = state["edges"].sparkSession
    spark.range(1).write.mode("overwrite").parquet(f"{_round(folder, number)}/whole")


def last_round(spark: SparkSession, folder: str) -> tuple[int, dict[str, DataFrame]]:
    """The number and the tables of the last whole round in folder; 0 and empty tables where there is none."""
    number = 0
    while _exists(spark, f"{_round(folder, number + 1)}/whole/_SUCCESS"):
        number += 1
    if not number:
        return 0, {name: spark.createDataFrame([], schema) for name, schema in STATE.items()}
    return number, {name: spark.read.schema(schema).parquet(f"{_round(folder, number)}/{name}") for name, schema in STATE.items()}


def expand(source: DataFrame | Source, seeds: DataFrame, max_nodes: int = 100_000, max_rounds: int = 60, relation_every: int = 6, checkpoint_to: str | None = None, trim: bool = True) -> DataFrame:
    """Grow a graph from seed edges with candidates of a table or of a source function.

    What a source gives is materialised once, before anything is made of it: it may answer
    differently each time (a hosted model; see sources.calls.call_source). A round takes all waiting entities and adds the candidates at either end of them; every
    `relation_every`th round, and any round without waiting entities, takes the waiting
    relations instead, which come from edges added by entity rounds only. It ends when nothing
    waits, at max_nodes nodes (of the last round, the edges to the nodes named first stay; all of them without trim), or after max_rounds (counted from the first start).
    checkpoint_to: a folder for the state after each round; growth goes on after the last whole
    round found there, and the seeds are then those of the first start.
    """
    spark = seeds.sparkSession
    if isinstance(source, DataFrame):
        source = table_source(cut(source.select(*EDGE, "ord")))
    start, state = last_round(spark, checkpoint_to) if checkpoint_to else (0, None)
    if start:
        graph, fresh, done_nodes, done_relations = (cut(state[k]) for k in ("edges", "fresh", "nodes", "relations"))
    else:
        fresh = graph = cut(seeds.select(*EDGE, "ord").dropDuplicates(EDGE))  # fresh: edges that entity rounds added
        done_nodes, done_relations = nodes(graph).limit(0), graph.select("relation").limit(0)
    fit = within if trim else lambda new, *_: new
    for number in range(start + 1, max_rounds + 1):
        all_nodes = cut(nodes(graph))
        room = max_nodes - all_nodes.count()
        if room <= 0:
            break
        waiting = all_nodes.join(done_nodes, "node", "left_anti")
        relations = cut(fresh.select("relation").distinct().join(done_relations, "relation", "left_anti"))
        has_nodes, has_relations = waiting.limit(1).count() > 0, relations.limit(1).count() > 0
        if not has_nodes and not has_relations:
            break
        if has_relations and (number % relation_every == 0 or not has_nodes):
            new = fit(cut(earliest(source(relations, "relation"))), all_nodes, room)
            done_relations = cut(done_relations.union(relations))
        else:
            waiting = cut(waiting)
            ends = [source(waiting.withColumnRenamed("node", end), end).select(*EDGE, "ord") for end in ("head", "tail")]
            new = fit(cut(earliest(ends[0].unionByName(ends[1]))), all_nodes, room)
            done_nodes = cut(done_nodes.union(waiting))
            fresh = cut(earliest(fresh.unionByName(new.join(graph, EDGE, "left_anti"))))
        graph = cut(upsert_edges(graph, new))
        if checkpoint_to:
            save_round({"edges": graph, "fresh": fresh, "nodes": done_nodes, "relations": done_relations}, checkpoint_to, number)
    return graph

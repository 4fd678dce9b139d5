"""Line dedup on a suffix array of line ids, built by prefix doubling; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factline.llm.tables import cut, hot_keys, join_groups, ordered_index, written

NO_ID = (1 << 63) - 1
MIN_CHARS = 60  # code points, line ends included, from which on a repeated run counts
BROADCAST_DOCS = 500_000  # texts with runs, 16 bytes each, up to which the others need no shuffle
TEXT = ["t1", "t2"]  # 128 bits of a row's id and text: they name it wherever and however often the table is scanned


def _ranked(names: DataFrame, keys: list[str]) -> DataFrame:
    """Order-preserving ranks of the names that occur twice or more; the others are resolved."""
    return ordered_index(names.groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c"), keys, "r")


def tags(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    of = [F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.col(id_col).isNull(), F.col(text_col)]
    return [F.xxhash64(*of).alias("t1"), F.xxhash64(F.lit(7), *of).alias("t2")]


def line_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every line: the text's tag and key (order of texts), pos, 128 bits that name the line, and its weight (code points + 1)."""
    texts = docs.select(*tags(docs, id_col, text_col), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("key"), F.col(text_col).alias("text"))
    lines = texts.select(*TEXT, "key", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return lines.select(*TEXT, "key", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"), (F.length("line") + 1).cast("long").alias("w"))


def suffix_ranks(lines: DataFrame, deepest: int) -> list[DataFrame]:
    """Levels k = 0, 1, ...: rank r of the 2^k lines from (text, pos) on, where that run occurs twice.

    Ranks keep the order of the runs, so level k sorts the suffixes by their first 2^k lines,
    and suffixes share an LCP interval of depth 2^k or more just when their ranks are equal.
    Each level ranks the pairs (rank at pos, rank at pos + 2^k) of the level before; runs that
    occur once are left out, as no longer run of theirs occurs twice. Doubling stops past
    `deepest` lines, or when nothing repeats.
    """
    ids = _ranked(lines, ["h1", "h2"])
    level = cut(join_groups(lines.select(*TEXT, "pos", "h1", "h2"), ids, ["h1", "h2"], hot_keys(lines, ["h1", "h2"])).select(*TEXT, "pos", "r"))
    levels = [level]
    while 2 ** len(levels) <= deepest:
        step = 2 ** (len(levels) - 1)
        ahead = Window.partitionBy(*TEXT).orderBy("pos").rangeBetween(step, step)
        pairs = cut(level.withColumn("b", F.max("r").over(ahead)).filter("b is not null").withColumnRenamed("r", "a"))
        level = cut(join_groups(pairs, _ranked(pairs, ["a", "b"]), ["a", "b"], hot_keys(pairs, ["a", "b"])).select(*TEXT, "pos", "r"))
        if not level.limit(1).count():
            break
        levels.append(level)
    return levels


def windows_of(lines: DataFrame, min_chars: int) -> DataFrame:
    """len, back: how many lines the shortest run of min_chars code points has that begins, or ends, at each line; null where there is none."""
    text = Window.partitionBy(*TEXT)
    upto = text.orderBy("pos")
    lines = lines.withColumn("after", F.sum("w").over(upto)).withColumn("before", F.col("after") - F.col("w")).withColumn("total", F.sum("w").over(text))
    on = F.count(F.lit(1)).over(text.orderBy("before").rangeBetween(0, min_chars - 1))
    back = F.count(F.lit(1)).over(text.orderBy("after").rangeBetween(1 - min_chars, 0))
    lines = lines.withColumn("len", F.when(F.col("total") - F.col("before") >= min_chars, on).cast("int"))
    return lines.withColumn("back", F.when(F.col("after") >= min_chars, back).cast("int"))


def repeated_runs(lines: DataFrame, min_chars: int) -> DataFrame:
    """The maximal runs of lines to delete: t1, t2 (the text), start, stop. lines: line_table's, each text once.

    A run counts if it holds min_chars code points (line ends count) and stands at an earlier
    place too. Two windows a line tell: the shortest runs of that weight that begin and that end
    at it. Each line of a repeated run lies in a window of that run: in the one from it on, or,
    near the run's end, in the one that ends with the run. So the windows that repeat, laid
    together, are the maximal repeated runs, to their ends, and no run need be longer than a
    window, which bounds the rounds however long a repeat is.

    A window of n lines, 2^k <= n < 2^(k+1), is named by the level-k ranks of its first and its
    last 2^k lines, that is by its LCP interval of depth n; each interval's first member in
    (id, tag, pos) order is the copy that stays, and the other windows are deleted. Overlapping
    and adjacent windows make one run.
    """
    lines = cut(windows_of(lines, min_chars).select(*TEXT, "key", "pos", "h1", "h2", "len", "back"))
    deepest = lines.agg(F.max(F.greatest("len", "back")).alias("m")).first()["m"] or 0
    both = F.array_compact(F.array(F.when(F.col("len").isNotNull(), F.struct("pos", "len")), F.when(F.col("back") > 1, F.struct((F.col("pos") - F.col("back") + 1).alias("pos"), F.col("back").alias("len")))))
    starts = lines.select(*TEXT, "key", F.explode(both).alias("win")).select(*TEXT, "key", "win.pos", "win.len")
    fields = [*TEXT, "key", "pos", "len", "ra", "rb"]
    named = None
    for k, level in enumerate(suffix_ranks(lines, deepest)):
        head = level.withColumnRenamed("r", "ra")
        mine = starts.filter((F.col("len") >= 2**k) & (F.col("len") < 2 ** (k + 1))).join(head, [*TEXT, "pos"])
        if k:
            tail = level.withColumnRenamed("r", "rb").withColumnRenamed("pos", "at")
            mine = mine.withColumn("at", F.col("pos") + F.col("len") - 2**k).join(tail, [*TEXT, "at"])
        else:
            mine = mine.withColumn("rb", F.col("ra"))
        named = mine.select(fields) if named is None else named.unionByName(mine.select(fields))
    named = cut(named)
    place = F.struct("key", *TEXT, "pos")
    first = named.groupBy("len", "ra", "rb").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    later = join_groups(named, first, ["len", "ra", "rb"], hot_keys(named, ["len", "ra", "rb"])).filter(place > F.col("first")).select(*TEXT, "pos", (F.col("pos") + F.col("len")).alias("stop"))
    # merge overlapping and adjacent windows
    order = Window.partitionBy(*TEXT).orderBy("pos", "stop")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = later.withColumn("new", F.when(F.col("pos") <= reach, 0).otherwise(1))
    runs = marked.withColumn("g", F.sum("new").over(order))
    return runs.groupBy(*TEXT, "g").agg(F.min("pos").alias("start"), F.max("stop").alias("stop")).drop("g")


_RUNS = "array<struct<start:int,stop:int>>"


def _with_runs(docs: DataFrame, min_chars: int, id_col: str, text_col: str) -> DataFrame:
    """_doc (the input row) and _runs, the sorted runs to delete from it.

    Rows alike in id and text share a tag. Of those, which are few or none, one is the first;
    they are written with a number, so that it is the same one however often they are read.
    Rows are matched to runs by tag, never by their place in a scan.
    """
    none = F.array().cast(_RUNS)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), *tags(docs, id_col, text_col))
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *tags(docs, id_col, text_col))
    again = cut(plain.groupBy(*TEXT).agg(F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c"))
    repeated = again.limit(1).count() > 0
    if repeated:
        copies = written(rows.join(again, TEXT).withColumn("_n", F.monotonically_increasing_id()))
        firsts = cut(copies.groupBy(*TEXT).agg(F.min("_n").alias("_n")))
        rows = rows.join(again, TEXT, "left_anti").unionByName(copies.join(firsts, [*TEXT, "_n"]).drop("_n"))
        plain = rows.select(F.col("_doc")[id_col].alias("id"), F.col("_doc")[text_col].alias("text"))
    lines = line_table(plain, "id", "text")
    runs = repeated_runs(lines, min_chars).groupBy(*TEXT).agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("_runs"))
    runs = cut(runs)
    some = runs.select(*TEXT)
    if runs.count() <= BROADCAST_DOCS:  # then rows without runs are done before the join
        some = F.broadcast(some)
        out = rows.join(some, TEXT, "left_anti").select("_doc", none.alias("_runs"))
        out = out.unionByName(rows.join(some, TEXT, "left_semi").join(runs, TEXT).select("_doc", "_runs"))
    else:
        out = rows.join(runs, TEXT, "left").select("_doc", F.coalesce("_runs", none).alias("_runs"))
    if repeated:
        # a later copy is one repeated run, if it has the weight
        upto = line_table(plain, "id", "text").join(again, TEXT, "left_semi").groupBy(*TEXT).agg(F.count(F.lit(1)).cast("int").alias("stop"), F.sum("w").alias("w")).filter(F.col("w") >= min_chars).drop("w")
        later = copies.join(firsts, [*TEXT, "_n"], "left_anti").join(upto, TEXT, "left")
        run = F.array(F.struct(F.lit(0).alias("start"), F.col("stop").alias("stop"))).cast(_RUNS)
        out = out.unionByName(later.select("_doc", F.when(F.col("stop").isNull(), none).otherwise(run).alias("_runs")))
    return out


def _deduped(docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_doc (the input row), _kept, _n_lines, _n_removed and _n_runs; see line_dedup."""
    both = _with_runs(docs, min_chars, id_col, text_col).withColumn("_lines", F.split(F.col("_doc")[text_col], "\n", -1))
    n, r = F.size("_lines"), F.size("_runs")

    def gap(i: Column) -> Column:
        """The lines between deleted run i - 1 and run i."""
        lo = F.when(i == 0, F.lit(0)).otherwise(F.get("_runs", i - 1)["stop"])
        hi = F.when(i == r, n).otherwise(F.get("_runs", i)["start"])
        return F.slice("_lines", lo + 1, F.greatest(hi - lo, F.lit(0)))

    kept = F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), r), gap)), "\n")
    removed = F.aggregate("_runs", F.lit(0).cast("long"), lambda acc, x: acc + x["stop"] - x["start"])
    return both.select(
        "_doc",
        F.when(r == 0, F.col("_doc")[text_col]).otherwise(kept).alias("_kept"),
        F.greatest(n, F.lit(0)).cast("long").alias("_n_lines"), removed.alias("_n_removed"), r.cast("long").alias("_n_runs"),
    )


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Delete later copies of repeated line runs (see repeated_runs) from every text.

    Returns every input column, then _kept (the text without the deleted lines), _n_lines,
    _n_removed and _n_runs. A line's copies are later by id, then by a hash of id and text.

    Ids must be whole numbers, or strings of such. Nulls: a null text has no lines and stays
    null; a null id sorts after all others. Of rows alike in id and text any one is the first,
    and the others lose what repeats. An empty text is one empty line. A text whose every line
    goes becomes the empty string. Empty tables give no rows. Other columns are carried as they
    are; an added name that is taken gets one more underscore in front.
    """
    out = _deduped(docs, min_chars, id_col, text_col)
    names = {n: n for n in ("_kept", "_n_lines", "_n_removed", "_n_runs")}
    for n in names:
        while names[n] in docs.columns:
            names[n] = "_" + names[n]
    return out.select("_doc.*", *[F.col(n).alias(names[n]) for n in names])


def drop_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with line_dedup's texts; rows that lost every line are left out.

    A count column n_chars, where there is one, follows the new text. Nulls, empty texts,
    repeated rows and empty tables: as there. Columns of any other name are carried.
    """
    out = _deduped(docs, min_chars, id_col, text_col).filter("_n_removed = 0 or _n_removed < _n_lines")
    new = {text_col: F.col("_kept")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("_n_removed") > 0, F.length("_kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_doc")["n_chars"])
    return out.select(*[new.get(c, F.col("_doc")[c]).alias(c) for c in docs.columns])


#: Windows as strings: no ranks, no hashes.
ORACLE = """
WITH rows_ AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
lines_ AS (SELECT doc_id, ls, unnest(ls) AS line, generate_subscripts(ls, 1) AS p FROM rows_),
sums_ AS (SELECT doc_id, ls, line, p, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY p) AS after_,
    sum(length(line) + 1) OVER (PARTITION BY doc_id) AS total_ FROM lines_),
lens_ AS (SELECT doc_id, ls, p,
    CASE WHEN total_ - after_ + length(line) + 1 >= {min_chars} THEN count(*) OVER (PARTITION BY doc_id ORDER BY after_ - length(line) - 1 RANGE BETWEEN CURRENT ROW AND {reach} FOLLOWING) END AS len,
    CASE WHEN after_ >= {min_chars} THEN count(*) OVER (PARTITION BY doc_id ORDER BY after_ RANGE BETWEEN {reach} PRECEDING AND CURRENT ROW) END AS back FROM sums_),
both_ AS (SELECT doc_id, ls, p, len FROM lens_ WHERE len IS NOT NULL UNION SELECT doc_id, ls, p - back + 1, back FROM lens_ WHERE back IS NOT NULL),
wins_ AS (SELECT doc_id, p, len, array_to_string(list_slice(ls, p, p + len - 1), chr(10)) AS win FROM both_),
order_ AS (SELECT doc_id, p, len, row_number() OVER (PARTITION BY len, win ORDER BY doc_id, p) AS rn FROM wins_),
gone_ AS (SELECT DISTINCT doc_id, p + k AS p FROM (SELECT doc_id, p, unnest(range(len)) AS k FROM order_ WHERE rn > 1)),
marks_ AS (SELECT l.doc_id, l.p, l.line, g.p IS NOT NULL AS gone FROM lines_ l LEFT JOIN gone_ g ON l.doc_id = g.doc_id AND l.p = g.p),
runs_ AS (SELECT doc_id, p, line, gone, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS opens FROM marks_)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE opens) AS n_runs,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM runs_ GROUP BY doc_id
"""

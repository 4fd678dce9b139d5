"""Point-in-time feature join: the version of an entity's features that was usable when a label asks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factline.llm.tables import cut, hot_keys, join_groups

_OVERTAKEN = 16  # late versions are compared with the instant ones of the next lifetime / _OVERTAKEN units of time


def useful_versions(versions: DataFrame, lifetime: int) -> DataFrame:
    """The versions (k, event, arrival, expiry, v) that can win at some time; the others go unseen.

    A version is usable from start = max(event, arrival) to its expiry. It never wins if
    another one of its entity that beats it is usable all that time. Looked for are those of the
    same event and start, and, for late versions, instant ones (start = event) of the next
    lifetime / 16 units. So what a unit of time holds is bounded by lifetimes, not by rows.
    """
    rows = versions.filter("k is not null and event < expiry and arrival < expiry").groupBy("k", "event", "arrival", "expiry").agg(F.max("v").alias("v"))
    rows = rows.withColumn("start", F.greatest("event", "arrival"))
    better = Window.partitionBy("k", "event", "start").orderBy(F.desc("arrival"), F.desc("v")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_last", F.max("expiry").over(better)).filter("_last is null or expiry > _last")
    members = F.struct("event", "arrival", "v", "expiry", "start")
    instant = F.max(F.when(F.col("start") == F.col("event"), F.col("expiry")))
    times = rows.groupBy("k", "event").agg(F.collect_list(members).alias("vs"), instant.alias("until"))
    reach = max(1, lifetime // _OVERTAKEN)
    times = in_spans(times, "event", reach, back=False)
    ahead = Window.partitionBy("k", "span").orderBy("event").rangeBetween(1, reach)
    times = times.withColumn("_until", F.max("until").over(ahead)).filter("own")
    overtaken = lambda v: (v["start"] - v["event"] >= reach) & (v["expiry"] <= F.col("_until"))
    return times.select("k", "event", F.filter("vs", lambda v: ~F.coalesce(overtaken(v), F.lit(False))).alias("vs"))


def in_spans(rows: DataFrame, at: str, size: int, back: bool) -> DataFrame:
    """rows by entity and span of time, so that no entity is one group: every row in its own span (own), and again in the span after it (back) or before it."""
    own = F.floor(F.col(at) / size).cast("long")
    other = own + (1 if back else -1)
    return rows.withColumn("_s", F.explode(F.array(F.struct(own.alias("span"), F.lit(True).alias("own")), F.struct(other.alias("span"), F.lit(False).alias("own"))))).select("*", "_s.*").drop("_s")


def winners(asked: DataFrame, versions: DataFrame) -> DataFrame:
    """For each distinct (k, t) of asked, the winning version as a struct; no row where there is none.

    versions: k, event, arrival, expiry, v (a struct that starts with what ties are broken by).
    Usable are versions with event <= t, arrival <= t < expiry; the latest event wins, then the
    latest arrival, then the greatest v. Times are whole numbers.

    Versions and questions are laid on one line per entity. A range frame gathers the versions of
    the last `lifetime` units (the longest of the table, an aggregate), the arrays are filtered
    by arrival and expiry, and the greatest struct wins. The line is cut into spans of one
    lifetime, so a version stands in two of them, and an entity with a third of all rows
    makes as many groups as there are spans. A group holds two lifetimes of time units at most.
    """
    lifetime = versions.filter("event < expiry and arrival < expiry").agg(F.max(F.expr("expiry - event"))).first()[0]
    if lifetime is None:
        return asked.select("k", "t", F.lit(None).cast(_winner_type(versions)).alias("w")).limit(0)
    line = in_spans(useful_versions(versions, lifetime), "event", lifetime, back=True).select("k", "span", F.col("event").alias("at"), "vs", F.lit(False).alias("asks"))
    questions = asked.filter("k is not null and t is not null").select("k", "t").distinct()
    none = F.lit(None).cast(line.schema["vs"].dataType)
    questions = questions.select("k", F.floor(F.col("t") / lifetime).cast("long").alias("span"), F.col("t").alias("at"), none.alias("vs"), F.lit(True).alias("asks"))
    frame = Window.partitionBy("k", "span").orderBy("at").rangeBetween(1 - lifetime, 0)
    seen = line.unionByName(questions).withColumn("seen", F.flatten(F.collect_list("vs").over(frame))).filter("asks")
    usable = F.filter("seen", lambda v: (v["arrival"] <= F.col("at")) & (v["expiry"] > F.col("at")))
    return seen.select("k", F.col("at").alias("t"), F.array_max(usable).alias("w")).filter("w is not null")


def _winner_type(versions: DataFrame) -> str:
    return f"struct<event: long, arrival: long, v: {versions.schema['v'].dataType.simpleString()}, expiry: long, start: long>"


def point_in_time_join(
    labels: DataFrame, versions: DataFrame, entity: str = "source", time: str = "t", event: str = "event", arrival: str = "arrival", expiry: str = "expiry", version_id: str = "version_id", features: tuple[str, ...] = ()
) -> DataFrame:
    """Every label row with the features that were known and valid at its time.

    labels: rows with the columns named by entity and time; versions: rows with entity, event,
    arrival, expiry, version_id and features. See winners for who wins; of versions alike in
    event, arrival and version_id the greatest features do. Returns the columns of labels (which
    come first where names clash: a feature of the same name is not added), version_id, event.

    Nulls: a label without entity or time, and a version without entity, event, arrival, expiry
    or version_id, meet nothing; such labels come with null features. Repeated labels are all returned. Empty
    tables: no labels, no rows; no versions, null features. Extra columns of versions are not
    read. Labels that share an entity and time ask once; hot ones are kept apart in the join back.
    """
    taken = [c for c in (version_id, event, *features) if c not in labels.columns]
    times = [F.col(f"`{c}`").cast("long").alias(n) for c, n in ((event, "event"), (arrival, "arrival"), (expiry, "expiry"))]
    vs = versions.select(F.col(f"`{entity}`").alias("k"), *times, F.struct(F.col(f"`{version_id}`").alias("id"), F.struct(*[F.col(f"`{f}`").alias(f"f{i}") for i, f in enumerate(features)], F.lit(0).alias("none")).alias("f")).alias("v"))
    vs = vs.filter("k is not null and event is not null and arrival is not null and expiry is not null and v.id is not null")
    rows = cut(labels.select(F.struct(*[F.col(f"`{c}`") for c in labels.columns]).alias("row"), F.col(f"`{entity}`").alias("k"), F.col(f"`{time}`").cast("long").alias("t")))
    asks = F.col("k").isNotNull() & F.col("t").isNotNull()
    won = winners(rows, vs)
    # one row for every question, so that labels without a winner take part in the same join
    questions = rows.filter(asks).select("k", "t").distinct().join(won, ["k", "t"], "left")
    met = join_groups(rows.filter(asks), questions, ["k", "t"], hot_keys(rows.filter(asks), ["k", "t"]))
    out = met.select("row", "w").unionByName(rows.filter(~asks).select("row", F.lit(None).cast(met.schema["w"].dataType).alias("w")))
    named = {version_id: F.col("w.v.id"), event: F.col("w.event")} | {f: F.col(f"w.v.f.f{i}") for i, f in enumerate(features)}
    return out.select("row.*", *[named[c].alias(c) for c in taken])


def hashed_number(c: str, group: int) -> str:
    """SQL: the group-th (from 0) eight hexadecimal digits of the SHA-256 of a number's decimal digits, as a number."""
    return f"cast(conv(substring(sha2(cast(cast({c} as string) as binary), 256), {8 * group + 1}, 8), 16, 10) as bigint)"


def document_versions(docs: DataFrame) -> DataFrame:
    """Every document as a version of its source, its times drawn from its id."""
    a, b, c = (hashed_number("doc_id", k) for k in range(3))
    rows = docs.selectExpr("source", "doc_id as version_id", f"{a} % 200000 as event", f"{b} % 1200 as late", f"{c} % 900 as lasts", "n_chars", "lang")
    return rows.selectExpr("source", "version_id", "event", "event - 60 + late as arrival", "event + lasts as expiry", "n_chars", "lang")


def label_questions(labels: DataFrame, docs: DataFrame) -> DataFrame:
    """Each label with a time, drawn from its id, and its document's source (of several rows of an id, the least)."""
    asked = cut(labels.selectExpr("doc_id", f"{hashed_number('doc_id', 3)} % 200000 as t"))
    sources = docs.groupBy("doc_id").agg(F.min("source").alias("source"))
    ids = asked.select("doc_id").distinct().join(sources, "doc_id", "left")
    known = join_groups(asked.filter("doc_id is not null"), ids, ["doc_id"], hot_keys(asked.filter("doc_id is not null"), ["doc_id"]))
    return known.select("doc_id", "t", "source").unionByName(asked.filter("doc_id is null").selectExpr("doc_id", "t", "cast(null as string) as source"))


def fresh_or_stale(joined: DataFrame, oldest: int = 20) -> DataFrame:
    """doc_id, t, version_id, age, status, and the features of fresh versions."""
    out = joined.withColumn("age", F.col("t") - F.col("event"))
    status = F.when(F.col("version_id").isNull(), "none").when(F.col("age") > oldest, "stale").otherwise("fresh")
    fresh = status == "fresh"
    return out.select("doc_id", "t", "version_id", "age", status.alias("status"), F.when(fresh, F.col("n_chars")).alias("n_chars"), F.when(fresh, F.col("lang")).alias("lang"))


#: The times' ranges are those of document_versions. A version stands under the 900-second slots in which it can be asked.
ORACLE = """
WITH h AS (SELECT doc_id, source, n_chars, lang, sha256(CAST(doc_id AS VARCHAR)) AS x FROM documents),
n AS (
  SELECT *, CAST('0x' || substr(x, 1, 8) AS BIGINT) % 200000 AS event, CAST('0x' || substr(x, 9, 8) AS BIGINT) % 1200 AS late, CAST('0x' || substr(x, 17, 8) AS BIGINT) % 900 AS lasts
  FROM h WHERE doc_id IS NOT NULL AND source IS NOT NULL
),
versions AS (SELECT *, event - 60 + late AS arrival, event + lasts AS expiry, unnest([event // 900, event // 900 + 1]) AS slot FROM n),
sources AS (SELECT doc_id, min(source) AS source FROM documents GROUP BY doc_id),
asked AS (
  SELECT row_number() OVER () AS r, l.doc_id, CAST('0x' || substr(sha256(CAST(l.doc_id AS VARCHAR)), 25, 8) AS BIGINT) % 200000 AS t, s.source
  FROM labels l LEFT JOIN sources s ON l.doc_id = s.doc_id
),
met AS (
  SELECT a.r, a.doc_id, a.t, v.doc_id AS version_id, v.event, v.n_chars, v.lang,
    row_number() OVER (PARTITION BY a.r ORDER BY v.event DESC NULLS LAST, v.arrival DESC, v.doc_id DESC, v.n_chars DESC, v.lang DESC) AS place
  FROM asked a LEFT JOIN versions v ON v.source = a.source AND v.slot = a.t // 900 AND v.event <= a.t AND v.arrival <= a.t AND a.t < v.expiry
),
best AS (SELECT *, t - event AS age, CASE WHEN version_id IS NULL THEN 'none' WHEN t - event > 20 THEN 'stale' ELSE 'fresh' END AS status FROM met WHERE place = 1)
SELECT doc_id, t, version_id, age, status, CASE WHEN status = 'fresh' THEN n_chars END AS n_chars, CASE WHEN status = 'fresh' THEN lang END AS lang FROM best
"""

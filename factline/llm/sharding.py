"""Proportional stratified interleaving of rows into shards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factline.llm.tables import cut, ordered_index


def stratified_shards(docs: DataFrame, shards: int = 8, seed: str = "factline", source_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deal every row into `shards` shards whose source mixtures match the table's.

    Rows of one source are shuffled by a seeded hash of their id and ranked; row r of n gets
    the fractional rank (r + 1/2) / n. The table, sorted by fractional rank, is cut into equal
    counts: shard sizes differ by one row at most, and each shard holds each source within one
    or two rows of its share.

    Ranks come from range-partitioned sorts, so a source with a third of the rows spreads over
    many tasks. Returns id, source, size, text_crc32, shard, slot (gapless from 0 in a shard).

    Nulls: a null source is a source of its own; a null id hashes like the empty string; a null
    text has size 1 and the checksum of no bytes. Repeated rows each take a slot (which of two
    identical rows takes which is immaterial). An empty table gives no rows. Other columns are
    not carried, so their names cannot clash.
    """
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.md5(F.concat_ws(":", F.lit(seed), F.col(id_col).cast("string"))).alias("h"),
    )
    ranked = ordered_index(rows, ["source", "h", "id", "text_crc32", "size"], "at")
    per_source = ranked.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first")).withColumnRenamed("source", "s")
    mixed = (
        ranked.join(per_source, F.col("source").eqNullSafe(F.col("s")))
        .withColumn("frac", (F.col("at") - F.col("first") + 0.5) / F.col("n"))
        .select("id", "source", "size", "text_crc32", "frac", "at")
    )
    placed = cut(ordered_index(mixed, ["frac", "source", "at"], "pos"))
    total = placed.count()
    shard = F.expr(f"pos * {shards} div {max(total, 1)}")
    return placed.select(
        F.col("id").alias(id_col), "source", "size", "text_crc32",
        shard.cast("int").alias("shard"),
        (F.col("pos") - F.expr(f"(pos * {shards} div {max(total, 1)} * {total} + {shards - 1}) div {shards}")).cast("long").alias("slot"),
    )


#: Fixed value: the polynomial of CRC-32, reversed. DuckDB has no such function, so it is folded byte by byte.
ORACLE = r"""
WITH t AS (SELECT doc_id, source, encode(coalesce(text, '')) AS raw FROM documents),
c AS (
  SELECT doc_id, source, CAST(octet_length(raw) + 1 AS BIGINT) AS size, md5('factline' || coalesce(':' || CAST(doc_id AS VARCHAR), '')) AS h,
    xor(list_reduce(
      list_transform(regexp_extract_all(hex(raw), '..'), lambda x: CAST('0x' || x AS BIGINT)),
      lambda a, b: xor(xor(a, b) >> 8, list_reduce(range(8), lambda p, i: xor(p >> 1, p % 2 * 3988292384), xor(a, b) & 255)),
      4294967295), 4294967295) AS text_crc32
  FROM t),
f AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id NULLS FIRST, text_crc32, size) AS r, count(*) OVER (PARTITION BY source) AS n
  FROM c),
p AS (SELECT *, row_number() OVER (ORDER BY (r - 0.5::DOUBLE) / n, source NULLS FIRST, r) - 1 AS pos, count(*) OVER () AS total FROM f),
s AS (SELECT *, pos * 8 // total AS shard FROM p)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(shard AS INT) AS shard, CAST(pos - (shard * total + 7) // 8 AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard, source FROM s
"""

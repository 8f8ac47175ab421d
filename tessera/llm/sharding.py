"""Jump consistent hashing of stable keys to shards, in SQL functions only.

The generator is the 64-bit congruential one of the published algorithm; its product is
taken in DECIMAL(38,0) and reduced by 2^64, as BIGINT would overflow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.runtime import prefix_sums, read_table

MULTIPLIER = 2862933555777941757


STEPS = 128


def key_of(id_column: str) -> F.Column:
    """The first 60 bits of the MD5 of the id as text, as BIGINT; a null id counts as empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def jump_hash(key: str, shards: int) -> F.Column:
    """struct<shard, grown>: the shard of BIGINT expression ``key`` among ``shards`` and
    among one more. The walk takes ln(shards) + 1 jumps on average; the few keys that need
    more than STEPS go on for as many as there can be."""
    two64, two33 = "18446744073709551616BD", "8589934592BD"
    step = f"""(s, i) -> IF(s.j > {shards}L, s, named_struct(
            'k', cast(pmod(s.k * {MULTIPLIER}BD + 1BD, {two64}) AS DECIMAL(38,0)),
            'j', cast(floor((s.j + 1) * (2147483648D / (cast(pmod(s.k * {MULTIPLIER}BD + 1BD, {two64}) AS DECIMAL(38,0)) div {two33} + 1))) AS BIGINT),
            'b', IF(s.j < {shards}L, s.j, s.b),
            'g', s.j))"""
    return F.expr(f"""
        transform(array(aggregate(
          sequence(1, {min(shards + 1, STEPS)}),
          named_struct('k', cast(pmod(cast({key} AS DECIMAL(38,0)), {two64}) AS DECIMAL(38,0)), 'j', 0L, 'b', -1L, 'g', -1L),
          {step})),
          f -> aggregate(IF(f.j > {shards}L, cast(array() AS ARRAY<INT>), sequence(1, {shards + 1})), f, {step},
            s -> named_struct('shard', cast(s.b AS INT), 'grown', cast(s.g AS INT))))[0]""")


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", buckets: int = 512) -> DataFrame:
    """id, size, text_crc32, law, shard, slot, grown_shard for every row.

    The shard hangs on id and shard count alone (see ``key_of``); with one more shard a row
    stays or goes to the new one. Ids may be of any type that has a text. Size is the UTF-8
    bytes of the text plus 1, so 1 for a null text, whose CRC-32 is that of no bytes. Slots
    count the rows of a shard from 0 without gaps in the order of (bucket of the key, id, CRC,
    size); equal rows take neighbouring slots, and an empty table gives none. Only these
    numbers are shuffled, never the texts, and other columns aren't read.
    """
    text = F.coalesce(docs[text_col].cast("binary"), F.lit(b""))
    rows = docs.select(
        docs[id_col].alias("_id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
    ).withColumn("_key", key_of("_id"))
    rows = rows.withColumn("_jump", jump_hash("_key", shards)).select(
        "_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("_jump.shard").alias("shard"), F.col("_jump.grown").alias("grown_shard"), F.pmod("_key", F.lit(buckets)).alias("_deal"))
    out = prefix_sums(rows, ["shard"], ["_id", "text_crc32", "size"], F.lit(1), "slot", buckets, F.col("_deal"))
    return out.select(F.col("_id").alias(id_col), "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op5_jump_sharding(spark, sf_dir: str) -> DataFrame:
    return shard_documents(read_table(spark, sf_dir, "documents"))


#: The same in SQL: the CRC over bytes by its table of 256 entries, the jumps by recursion.
ORACLE_SQL = f"""WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END, n::BIGINT)) AS t),
d AS (SELECT doc_id, text, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS key, strlen(coalesce(text, '')) + 1 AS size FROM documents),
c AS (SELECT doc_id, key, size, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ((instr('0123456789ABCDEF', h[1]) - 1) * 16 + instr('0123456789ABCDEF', h[2]) - 1)::BIGINT),
  lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]), 4294967295::BIGINT), 4294967295::BIGINT) AS crc FROM d, tab),
jump AS (SELECT DISTINCT key, key::HUGEINT AS k, 0::BIGINT AS j, -1::BIGINT AS b, -1::BIGINT AS g FROM d
  UNION ALL SELECT key, (k * {MULTIPLIER} + 1) % 18446744073709551616, floor((j + 1) * (2147483648::DOUBLE / (((k * {MULTIPLIER} + 1) % 18446744073709551616) // 8589934592 + 1)::DOUBLE))::BIGINT, CASE WHEN j < 8 THEN j ELSE b END, j FROM jump WHERE j <= 8),
r AS (SELECT c.*, b AS shard, g AS grown FROM c JOIN jump USING (key) WHERE j > 8)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'key' AS law, shard::INT AS shard, (row_number() OVER (PARTITION BY shard ORDER BY key % 512, doc_id NULLS FIRST, crc, size) - 1)::BIGINT AS slot, grown::INT AS grown_shard FROM r"""

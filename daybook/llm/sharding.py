"""Rendezvous hashing of record keys over weighted shards.

Every shard gets a number from the key and its own name; the shard with the best number takes the record. One more shard
takes records only into itself. A null key is a key like any other. Repeated rows share a shard. Native: column expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.llm.order import running
from daybook.runtime import durable

#: Hexadecimal digits of a digest that a number is read from: 52 bits fit a double.
DIGITS = 13


def _digest(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts)))


def shard_score(key: Column, shard: int, weight: float) -> Column:
    """Weighted score of a shard for a key; the highest wins. The number lies strictly between 0 and 1."""
    number = F.conv(F.substring(_digest(key, F.lit(shard)), 1, DIGITS), 16, 10).cast("double")
    u = (number + 0.5) / float(1 << 4 * DIGITS)
    return -F.lit(float(weight)) / F.ln(u)


def shard_of(key: Column, weights: list[float]) -> Column:
    """Shard of a key; between equal scores the lower shard wins. Weight 0 closes a shard."""
    if not any(w > 0 for w in weights):
        raise ValueError("no shard has a weight")
    best = F.greatest(*(F.struct(shard_score(key, i, w).alias("score"), F.lit(-i).alias("minus")) for i, w in enumerate(weights) if w > 0))
    return (-best["minus"]).cast("int")


def grown_shard(key: Column, shard: str, weights: list[float], added: float) -> Column:
    """Shard after one more shard has been added: the new one, or the shard as it is (`shard` names its column)."""
    own = F.coalesce(*(F.when(F.col(shard) == i, shard_score(key, i, w)) for i, w in enumerate(weights) if w > 0))
    return F.when(shard_score(key, len(weights), added) > own, F.lit(len(weights))).otherwise(F.col(shard)).cast("int")


def place(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: tuple[float, ...] = (1.0,) * 16, added: float = 1.0
) -> DataFrame:
    """One row per document: doc_id, size (bytes of the text plus 1), text_crc32, law, shard, slot, grown_shard.

    Slots count from 0 within a shard, in the order of a digest of the key; they come from buckets of the digest and bucket totals, so no
    task sorts a shard. A null text has no bytes and the checksum of the empty text.
    """
    weights = list(weights)
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.col(id_col).cast("string")
    rows = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        shard_of(key, weights).alias("shard"), _digest(key).alias("place"),
    )
    rows = durable(rows.withColumn("bucket", F.substring("place", 1, 3)))
    out = running(rows, ["shard"], "bucket", [F.col("place"), F.col("text_crc32"), F.col("size")], F.lit(1), "slot")
    key = F.col("doc_id").cast("string")
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        grown_shard(key, "shard", weights, added).alias("grown_shard"),
    )


def sharded(docs: DataFrame, id_col: str = "doc_id", name: str = "shard", weights: tuple[float, ...] = (1.0,) * 16) -> DataFrame:
    """The documents with their shard; a column of that name is replaced. No row moves: writers partition by it."""
    return docs.withColumn(name, shard_of(F.col(id_col).cast("string"), list(weights)))


# crc32 from its definition: 256 steps of the table are folded over the bytes of each text.
ORACLE = r"""
WITH RECURSIVE t(n, k, c) AS (SELECT range, 0, range::UBIGINT FROM range(256) UNION ALL
    SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END FROM t WHERE k < 8),
tab AS MATERIALIZED (SELECT list(c ORDER BY n) AS w FROM t WHERE k = 8),
b AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(doc_id::VARCHAR, 'null') AS key FROM documents),
c AS (SELECT b.*, strlen(text)::BIGINT + 1 AS size,
             xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::UBIGINT)),
                 lambda a, v: xor(a >> 8, w[(xor(a, v) & 255)::INT + 1])), 4294967295::UBIGINT)::BIGINT AS text_crc32
      FROM b, tab),
h AS (SELECT c.doc_id, c.size, c.text_crc32, key, md5(key) AS place, i::INT AS i,
             -1.0::DOUBLE / ln((('0x' || substr(md5(key || ':' || i), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496::DOUBLE) AS score
      FROM c, range(17) AS r(i)),
s AS (SELECT doc_id, size, text_crc32, place, (arg_max({'s': i}, {'score': score, 'm': -i}) FILTER (i < 16)).s AS shard,
             (arg_max({'s': i}, {'score': score, 'm': -i})).s AS grown_shard FROM h GROUP BY ALL)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
       (row_number() OVER (PARTITION BY shard ORDER BY place, text_crc32, size) - 1)::BIGINT AS slot, grown_shard FROM s
"""

"""Sharding: weighted rendezvous hashing of stable record keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelworks.llm.common import materialise, text_digest

#: Hex digits of the key's hash that name the numbering bucket: 16 ** 3 buckets a shard.
BUCKET_DIGITS = 3
SALTS = 16


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard (0-based) that wins the rendezvous for ``key``.

    Each shard scores the key by ``-weight / ln(u)``, u being a uniform hash of key and shard
    number; the highest score wins. With equal weights the order of scores is the order of
    the hashes, which are compared as they are. A shard that joins wins only keys from
    others, about its share of the weight; no other key moves. A null key hashes as ``\\N``.
    """
    if not weights or any(w <= 0 for w in weights):
        raise ValueError("weights must be positive, one for each shard")
    key = F.coalesce(key.cast("string"), F.lit("\\N"))
    digest = [F.md5(F.concat(key, F.lit(f"#{i}"))) for i in range(len(weights))]
    if len(set(weights)) == 1:
        score = digest
    else:
        u = [(F.conv(F.substring(d, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52) for d in digest]
        score = [-w / F.log(x) for w, x in zip(weights, u, strict=True)]
    if len(weights) == 1:
        return F.lit(0).cast("int")
    return F.array_max(F.array(*[F.struct(s.alias("s"), F.lit(-i).alias("i")) for i, s in enumerate(score)]))["i"].cast("int") * -1


def assign(docs: DataFrame, n_shards: int = 8, *, weights: Sequence[float] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Shard and slot of every record: key, size, text_crc32, shard, slot, grown_shard.

    ``size`` is the UTF-8 bytes of the text plus 1 (null text: 1) and ``slot`` numbers a
    shard's records from 0 without gaps. ``grown_shard`` is the shard once one more, of the
    mean weight, has joined. Rows that repeat a key share its shard and have their own
    slots; a null key is a key like any other; other columns are ignored. An empty table
    gives an empty result.

    Numbering never sorts a whole shard: records fall into shard x key-hash x row-salt
    buckets, numbered apart, and the (bounded) table of bucket sizes gives each its offset.
    """
    weights = list(weights) if weights is not None else [1.0] * n_shards
    if len(weights) != n_shards:
        raise ValueError("one weight for each shard is needed")
    size, crc = text_digest(text)
    k = F.col(key)
    rows = docs.select(
        k.alias("key_"),
        size.alias("size"),
        crc.alias("text_crc32"),
        shard_of(k, weights).alias("shard"),
        shard_of(k, [*weights, sum(weights) / n_shards]).alias("grown_shard"),
        F.substring(F.md5(F.coalesce(k.cast("string"), F.lit("\\N"))), 1, BUCKET_DIGITS).alias("bucket"),
    )
    # The written table fixes the salt, which parts even rows that are equal in all columns.
    rows = materialise(rows.withColumn("salt", (F.pmod(F.col("text_crc32") + F.monotonically_increasing_id(), F.lit(SALTS))).cast("int")), "shards")
    parts = ["shard", "bucket", "salt"]
    sizes = rows.groupBy(parts).agg(F.count("*").alias("n"))
    before = W.partitionBy("shard").orderBy("bucket", "salt").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*parts, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    # At most n_shards * 16**BUCKET_DIGITS * SALTS rows, whatever the input; Spark joins by its size.
    own = F.row_number().over(W.partitionBy(parts).orderBy("key_", "text_crc32", "size"))
    return rows.withColumn("own", own).join(offsets, parts).select(
        F.col("key_").alias(key), "size", "text_crc32", "shard", (F.col("before") + F.col("own") - 1).alias("slot"), "grown_shard"
    )


def write_shards(docs: DataFrame, path: str, n_shards: int = 8, *, weights: Sequence[float] | None = None, key: str = "doc_id") -> None:
    """Write whole records as Parquet partitioned by shard, each shard by as many tasks as it needs.

    Null texts and repeated rows are written as they are, null keys go to the shard of a null
    key; a column ``shard`` of the records is replaced; an empty table writes no file.
    """
    weights = list(weights) if weights is not None else [1.0] * n_shards
    docs.withColumn("shard", shard_of(F.col(key), weights)).hint("rebalance", "shard").write.partitionBy("shard").parquet(path)

"""Sharding by extendible hashing, with Spark expressions only.

A directory is indexed by the first bits of a hash of doc_id. A bucket of the directory that holds more bytes than a shard may
is split on the next bit, others stay as they are, so a shard is the shortest prefix whose texts fit. Sizes are summed once for
cells of enough bits for the data's size, then for every prefix of a cell; cells that are still too large are cut into finer cells, alone.

Cases: a null text has no bytes; a text larger than a shard, and rows of one doc_id that together are, form a shard of their own,
marked by fits = false, as no bit of the hash splits them; rows without doc_id are dealt by their text's hash; repeated rows all stay; columns
other than doc_id and text are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.shared import kept, unused

#: Bits of the hash (15 hex digits of md5).
BITS = 60


def hashed() -> Column:
    name = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.col("text").cast("binary")), F.lit(""))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 15), 16, 10).cast("long")


def _prefix(bits: Column | int) -> Column:
    return F.call_function("shiftright", F.col("hash"), (F.lit(BITS) - bits).cast("int"))


def directory(sizes: DataFrame, limit: int, bits: int, above: int = 0) -> DataFrame:
    """cell (the hash's first `bits` bits), depth, prefix, shard_docs, shard_bytes, fits: the shard of each cell.

    sizes: rows of hash and n_bytes. above: prefixes of fewer bits are known to be too large. Where no prefix of a cell fits, depth is null.
    """
    cells = sizes.groupBy(_prefix(bits).alias("cell")).agg(F.count("*").alias("n"), F.sum("n_bytes").alias("b"), F.min("hash").alias("low"), F.max("hash").alias("high"))
    each = cells.select("*", F.explode(F.sequence(F.lit(above), F.lit(bits))).alias("depth")).withColumn("prefix", F.call_function("shiftright", F.col("cell"), (F.lit(bits) - F.col("depth")).cast("int")))
    whole = each.groupBy("depth", "prefix").agg(F.sum("n").alias("shard_docs"), F.sum("b").alias("shard_bytes"), F.min("low").alias("low"), F.max("high").alias("high"))
    settled = whole.where((F.col("shard_bytes") <= limit) | (F.col("low") == F.col("high"))).select("depth", "prefix", "shard_docs", "shard_bytes", (F.col("shard_bytes") <= limit).alias("fits"))
    choice = each.select("cell", "depth", "prefix").join(settled, ["depth", "prefix"], "left").groupBy("cell").agg(F.min_by(F.struct("depth", "prefix", "shard_docs", "shard_bytes", "fits"), F.when(F.col("fits").isNotNull(), F.col("depth"))).alias("s"))
    return choice.select("cell", F.when(F.col("s.fits").isNotNull(), F.col("s.depth")).alias("depth"), "s.prefix", "s.shard_docs", "s.shard_bytes", "s.fits")


def assign(docs: DataFrame, limit: int) -> DataFrame:
    """doc_id, n_bytes, shard (its prefix as 0 and 1), depth, shard_docs, shard_bytes and fits of each row of docs."""
    rest = docs.select("doc_id", hashed().alias("hash"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    total = rest.agg(F.sum("n_bytes")).first()[0] or 0
    bits, above, parts = min(BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + 3), 0, []
    while True:
        table = kept(directory(rest, limit, bits, above))
        rows = rest.withColumn("cell", _prefix(bits)).join(table, "cell")
        parts.append(rows.where(F.col("depth").isNotNull()))
        if bits == BITS or table.where(F.col("depth").isNull()).isEmpty():
            break
        rest = rows.where(F.col("depth").isNull()).select("doc_id", "hash", "n_bytes")
        bits, above = min(BITS, bits + 8), bits
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    shard = F.when(F.col("depth") == 0, "").otherwise(F.lpad(F.bin("prefix"), F.col("depth"), "0"))
    return out.select("doc_id", "n_bytes", shard.alias("shard"), F.col("depth").cast("long").alias("depth"), "shard_docs", "shard_bytes", "fits")


def write(docs: DataFrame, folder: str, limit: int) -> None:
    """docs as Parquet, a folder for each shard. Rows without doc_id have no shard that they could be joined to and are refused."""
    if not docs.where(F.col("doc_id").isNull()).isEmpty():
        raise ValueError("rows without doc_id")
    doc, name = unused(docs, "shard_doc"), unused(docs, "shard")
    shard = assign(docs, limit).select(F.col("doc_id").alias(doc), F.concat(F.lit("s"), "shard").alias(name)).dropDuplicates([doc])
    docs.join(shard, F.col("doc_id") == F.col(doc)).drop(doc).repartition(name).write.partitionBy(name).parquet(folder)


#: Bytes of text in a shard: small enough that the given tables need splits.
LIMIT = 1024 * 1024

ORACLE = f"""
WITH d AS (SELECT doc_id, CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15)) AS BIGINT) AS h, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes FROM documents),
e AS (SELECT doc_id, n_bytes, h, k AS depth, h >> (60 - k) AS prefix FROM d, (SELECT unnest(range(0, 41)) AS k)),
s AS (SELECT depth, prefix, count(*) AS shard_docs, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes, min(h) = max(h) AS stuck FROM e GROUP BY ALL),
f AS (SELECT * FROM s WHERE shard_bytes <= {LIMIT} OR stuck)
SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE right(bin(prefix + (1::BIGINT << depth)), depth) END AS shard,
  CAST(depth AS BIGINT) AS depth, shard_docs, shard_bytes, shard_bytes <= {LIMIT} AS fits
FROM e JOIN f USING (depth, prefix) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY depth) = 1
"""

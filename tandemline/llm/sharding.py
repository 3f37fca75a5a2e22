"""Sharding by extendible hashing under a byte limit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_bits, saved, small

DIGITS = 14  # 56 bits of the key's hash
STEP = 8  # bits by which the directory may deepen in one pass


def _split(rows: DataFrame, limit: int, bits: int) -> tuple[DataFrame | None, DataFrame]:
    """Deal ``rows`` (base, h, bytes, ...) to shards; what one hash value alone brings over the limit comes back."""
    out, depth = None, 0
    rows = rows.withColumn("slot", F.lit(0).cast("long"))
    total = rows.groupBy("base").agg(F.sum("bytes").alias("shard_bytes"), F.count("*").alias("shard_rows"), F.min("h").alias("low"), F.max("h").alias("high"))
    slots = saved(total.select("base", F.lit(0).cast("long").alias("slot"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("prefix"), "shard_bytes", "shard_rows",
                               (F.col("shard_bytes") <= limit).alias("fits"), (F.col("low") == F.col("high")).alias("one")))
    stuck = None
    while True:
        dealt = rows.join(small(slots), ["base", "slot"])
        # a single document above the limit is a shard of its own
        placed = dealt.where(F.col("fits") | (F.col("one") & (F.col("shard_rows") == 1)))
        placed = placed.withColumn("shard", F.concat("base", F.when(F.col("depth") > 0, F.substring(
            F.lpad(F.conv(F.col("prefix").cast("string"), 10, 2), 64, "0"), F.lit(65) - F.col("depth"), F.col("depth"))).otherwise("")))
        placed = saved(placed.drop("slot", "prefix", "fits", "one", "h", "base"))
        out = placed if out is None else out.union(placed)
        last = dealt.where(~F.col("fits") & F.col("one") & (F.col("shard_rows") > 1))
        if not slots.where("not fits and one and shard_rows > 1").isEmpty():
            last = saved(last.withColumn("base", F.concat("base", F.lpad(F.conv(F.col("h").cast("string"), 10, 2), bits, "0"), F.lit("."))).select(rows.columns).drop("slot"))
            stuck = last if stuck is None else stuck.union(last)
        if slots.where("not fits and not one").isEmpty() or depth >= bits:
            return out, stuck
        depth += STEP
        here = F.shiftright("h", bits - depth)
        rows = saved(dealt.where(~F.col("fits") & ~F.col("one")).select("base", "h", "h2", "bytes", "doc_id", here.alias("slot")))
        slots = _directory(rows, limit, depth)


def _directory(rows: DataFrame, limit: int, depth: int) -> DataFrame:
    """Slots of ``depth`` bits, each with the shallowest ancestor bucket that fits (several slots may share one)."""
    leaf = saved(rows.groupBy("base", "slot").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("rows"), F.min("h").alias("low"), F.max("h").alias("high")))
    up = F.explode(F.array(*[F.lit(k) for k in range(STEP)])).alias("up")
    nodes = leaf.select("base", "slot", "bytes", "rows", "low", "high", up)
    prefix = F.expr("shiftright(slot, up)")
    sums = nodes.groupBy("base", "up", prefix.alias("prefix")).agg(F.sum("bytes").alias("shard_bytes"), F.sum("rows").alias("shard_rows"), F.min("low").alias("low"), F.max("high").alias("high"))
    best = nodes.select("base", "slot", "up", prefix.alias("prefix")).join(sums, ["base", "up", "prefix"])
    fits = F.col("shard_bytes") <= limit
    # the shallowest fitting ancestor; without one, the slot itself
    rank = F.struct((~fits).alias("no"), F.when(fits, -F.col("up")).otherwise(F.col("up")).alias("k"), "prefix", "shard_bytes", "shard_rows", "low", "high", "up")
    top = best.groupBy("base", "slot").agg(F.min(rank).alias("r"))
    return saved(top.select("base", "slot", (F.lit(depth) - F.col("r.up")).alias("depth"), "r.prefix", "r.shard_bytes", "r.shard_rows",
                            (~F.col("r.no")).alias("fits"), (F.col("r.low") == F.col("r.high")).alias("one")))


def sharded(docs: DataFrame, limit: int) -> DataFrame:
    """(doc_id, bytes, shard, depth, shard_bytes, shard_rows): a shard for each document, none above ``limit`` bytes.

    ``shard`` is the bucket's prefix of hash bits; only a bucket above the limit is split on a further bit. The hash
    is taken of the id, of the text where the id is null. Rows that share one hash value and together exceed the limit
    are split on by a hash of their row number in a stored table; the shard's name then has a dot. A single document
    above the limit is a shard of its own. Bytes are those of the text in UTF-8, null 0. An empty table has no shards.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.col("text")), F.lit(""))
    size = F.coalesce(F.octet_length("text").cast("long"), F.lit(0).cast("long"))
    row = F.monotonically_increasing_id().cast("string")
    rows = saved(docs.select(F.lit("").alias("base"), hash_bits(key, DIGITS).alias("h"), hash_bits(row, DIGITS).alias("h2"), size.alias("bytes"), "doc_id"))
    out, stuck = _split(rows, limit, 4 * DIGITS)
    if stuck is not None:
        out = out.union(_split(stuck.withColumn("h", F.col("h2")), limit, 4 * DIGITS)[0])
    return out.select("doc_id", "bytes", "shard", "depth", "shard_bytes", "shard_rows")

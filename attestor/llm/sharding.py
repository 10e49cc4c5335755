"""Jump consistent hashing of stable keys into shards [native].

The published 64-bit generator and jump loop run in Spark SQL expressions: products are taken in DECIMAL(38,0),
where they never overflow, and reduced modulo 2^64. No ring table exists; with one shard more, a row either stays or
goes to the new shard.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_TWO64, _TWO33, _STEP = 2**64, 2**33, 2862933555777941757


def jump_shards(key: Column, shards: int) -> Column:
    """struct(shard, grown): the jump hash of a long key for ``shards`` and for ``shards + 1`` buckets, in one loop.

    The state holds the generator's key, the last jump below ``shards``, the last below ``shards + 1``, and the next.
    """
    dec = lambda c: c.cast("decimal(38,0)")
    lit = lambda v: F.lit(str(v)).cast("decimal(38,0)")
    start = F.struct(
        F.when(key < 0, dec(key) + lit(_TWO64)).otherwise(dec(key)).cast("decimal(20,0)").alias("k"),
        F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("g"), F.lit(0).cast("long").alias("j"),
    )

    def step(state: Column, _: Column) -> Column:
        going = state["j"] <= shards
        k = F.when(going, (state["k"].cast("decimal(20,0)") * F.lit(str(_STEP)).cast("decimal(19,0)") + lit(1)) % lit(_TWO64)).otherwise(dec(state["k"])).cast("decimal(20,0)")
        top = ((k - k % lit(_TWO33)) / lit(_TWO33)).cast("long") + 1
        return F.struct(
            k.alias("k"),
            F.when(state["j"] < shards, state["j"]).otherwise(state["b"]).alias("b"),
            F.when(going, state["j"]).otherwise(state["g"]).alias("g"),
            F.when(going, F.floor((state["j"] + 1).cast("double") * (F.lit(float(2**31)) / top.cast("double"))).cast("long")).otherwise(state["j"]).alias("j"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(shards)), start, step, lambda s: F.struct(s["b"].cast("int").alias("shard"), s["g"].cast("int").alias("grown")))


def shard_documents(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", group_rows: int = 4096) -> DataFrame:
    """Put every row into a shard by its id alone, with a gapless slot in the shard.

    Returns every input column plus size, text_crc32, law, shard, slot and grown_shard, which replace input columns of
    the same names. A null id has key 0; null text has size 8 and the checksum of no bytes; repeated ids share a shard
    and take a slot each; an empty table gives an empty table.

    Slots take no task per shard: rows are numbered inside (shard, chunk) groups of about ``group_rows`` rows, chunks
    being ranges of a hash of the id, and the offset of each chunk comes from counts made on the id column alone.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    own = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    kept = [c for c in docs.columns if c not in own]
    chunks = max(1, math.ceil(docs.count() / shards / group_rows))
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(0))
    chunk = F.pmod(F.xxhash64(key), F.lit(chunks)).alias("__chunk")
    placed = jump_shards(key, shards).alias("__placed")
    counts = docs.select(placed, chunk).groupBy(F.col("__placed.shard").alias("__s"), F.col("__chunk").alias("__c")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("__s").orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__s", "__c", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(*kept, placed, chunk, (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    order = Window.partitionBy(F.col("__placed.shard"), "__chunk").orderBy(id_col, "text_crc32", "size")
    numbered = rows.withColumn("__row", F.row_number().over(order))
    joined = numbered.join(offsets, (F.col("__placed.shard") == F.col("__s")) & (F.col("__chunk") == F.col("__c")))
    return joined.select(
        *kept, "size", "text_crc32", F.lit("key").alias("law"), F.col("__placed.shard").alias("shard"),
        (F.col("__before") + F.col("__row") - 1).cast("long").alias("slot"), F.col("__placed.grown").alias("grown_shard"),
    )

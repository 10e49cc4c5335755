"""Low-discrepancy mixing of sources to target weights.

Targets are water-filled: each source gets its weight's share, at most ``cap`` times its own size, the excess going to
the others. The documents of a source, shuffled by a keyed digest of their ids, are laid end to end and cut into
equal-token blocks. The i-th van der Corput point falls through the sources' cumulative target weights and so names the
source of slot i; slots are ranked per source, and a slot of rank r is joined to block r of its source, counted round
again once all its blocks were taken. A source's slots end where its target is reached, the last in the middle of a
block; slots that the points owe a source (a few at most, their discrepancy) follow behind the last point. So every
source takes its target, rounded to a word, and the order of slots is the order of the mix. All of it is DataFrame
operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, shared

WEIGHTS = (5, 2, 1)
CAP = 3
MAX_BLOCK = 4096
LEAST_SLOTS = 65536
_GRID = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source_key, source, n, source_size) to the same plus target: min(cap * size, level * weight), level such that
    the targets share all words. One row per source, so the windows without partition run over a table of sources,
    never of documents. No words at all: every target is 0.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    w = sources.withColumn("weight", pick).withColumn("limit", F.col("source_size") * float(cap))
    by_ratio = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), "source")
    upto = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(upto), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
    levelled = w.withColumn("level", level)  # if the sources before this one are all at their limit
    # in order of limit / weight the first source that stays below its limit fixes the level of all after it
    fits = F.min(F.when(F.col("level") <= F.col("limit") / F.col("weight"), F.struct(F.col("limit") / F.col("weight"), F.col("level")))).over(every)
    return levelled.withColumn("target", F.least(F.col("limit"), F.coalesce(fits["level"], F.lit(float("inf"))) * F.col("weight"))).drop("level", "limit")


def schedule(shares: DataFrame, slots: int) -> DataFrame:
    """(slot, rank and the columns of ``shares``): van der Corput points through the cumulative targets of ``shares``,
    ranked from 0 per source by slot. Slots of rank ``need`` and above are dropped; missing ones follow after ``slots``.

    Points meet intervals in an equi-join on a grid cell, so neither side is broadcast or collected; ranks come from
    counts of chunks of slots and row numbers inside a chunk, so a source with many slots is no single task's.
    """
    point = F.conv(F.reverse(F.lpad(F.bin("id"), 52, "0")), 2, 10).cast("double") / float(2**52)
    points = shares.sparkSession.range(slots).select(F.col("id").alias("slot"), point.alias("u")).withColumn("cell", F.floor(F.col("u") * _GRID))
    order = Window.orderBy("source_key")
    total = F.sum("target").over(Window.partitionBy(F.lit(1)))
    upto = F.sum("target").over(order.rowsBetween(Window.unboundedPreceding, 0))
    names = shares.columns
    spans = shares.select(*names, ((upto - F.col("target")) / total).alias("low"), F.when(upto >= total, F.lit(1.0)).otherwise(upto / total).alias("high")).filter("need > 0")
    cells = spans.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * _GRID), F.least(F.floor(F.col("high") * _GRID), F.lit(_GRID - 1)))))
    width = max(256, int(slots**0.5))
    hit = points.join(cells, "cell").filter("u >= low AND u < high").select("slot", F.floor(F.col("slot") / width).alias("chunk"), *names)
    counts = hit.groupBy("source_key", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("source_key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("source_key", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inner = Window.partitionBy("source_key", "chunk").orderBy("slot")
    ranked = hit.withColumn("row", F.row_number().over(inner)).join(offsets, ["source_key", "chunk"])
    ranked = ranked.select("slot", (F.col("before") + F.col("row") - 1).alias("rank"), *names).filter("rank < need")
    got = counts.groupBy("source_key").agg(F.sum("n").alias("got"))
    number = F.row_number().over(order)
    owed = shares.withColumn("number", number).join(got, "source_key", "left").withColumn("got", F.coalesce("got", F.lit(0))).filter("got < need")
    owed = owed.withColumn("rank", F.explode(F.sequence("got", F.col("need") - 1)))
    after = F.lit(slots) + (F.col("rank") - F.col("got")) * F.lit(2**31) + F.col("number")  # round by round, in order of source
    return ranked.unionByName(owed.select(after.cast("long").alias("slot"), F.col("rank").cast("long").alias("rank"), *names))


def _row_key(text: Column, source: Column) -> Column:
    """Tells rows that share an id apart: a hash of text and source."""
    return F.xxhash64(text, source)


def mix_plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, slots (those of its copies, in order; the last
    copy is cut if taken is no multiple of size) and row_key (tells rows that share an id apart).

    Null text has size 0 and is taken 0 times; a null source is a source of its own, last in order; repeated rows count
    as documents each; an empty table gives an empty plan; rows without an id are documents like others. Order inside a
    source is by md5 of seed and id, then size, then row_key.

    Offsets are prefix sums in two levels (ranges of the digest inside a source, then rows inside a range), so a
    source that holds a third of all words is spread over as many tasks as it has ranges. Documents meet blocks by
    (source, block), blocks being of equal size whatever their source.
    """
    text, source = F.col(text_col).cast("string"), F.col(source_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), source.alias("source"), word_count(text).alias("size"), _row_key(text, source).alias("row_key"))
    rows = rows.withColumn("digest", F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).cast("binary")))
    rows = shared(rows.withColumn("source_key", F.concat(F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.lit("0")), F.coalesce("source", F.lit("")))))
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    block = max(1, min(MAX_BLOCK, total // LEAST_SLOTS))
    shares = targets(rows.groupBy("source_key", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size")), weights, cap)
    words = F.least(F.round("target").cast("long"), F.col("source_size") * cap)
    passes = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    blocks = F.ceil(F.col("source_size") / block).cast("long")
    shares = shares.select("source_key", "source_size", "target", blocks.alias("blocks"), (words - passes * F.col("source_size")).alias("rest"), passes.alias("passes"))
    shares = shared(shares.withColumn("need", F.col("passes") * F.col("blocks") + F.ceil(F.col("rest") / block).cast("long")))
    # each block with its slots, and the words that the last of them takes where that is not the whole block
    last = (F.col("rank") == F.col("need") - 1) & (F.col("rest") % block > 0)
    taken = schedule(shares, max(1, -(-total // block))).select("source_key", (F.col("rank") % F.col("blocks")).alias("block"), F.struct("rank", "slot").alias("at"), F.when(last, F.col("rest") % block).alias("part"))
    taken = taken.groupBy("source_key", "block").agg(F.transform(F.array_sort(F.collect_list("at")), lambda x: x["slot"]).alias("slots"), F.count(F.when(F.col("part").isNull(), 1)).alias("full"), F.coalesce(F.max("part"), F.lit(0)).alias("part"))

    width = next((k for k in range(1, 9) if n // 16**k < 2048), 8)
    rows = rows.withColumn("range", F.substring("digest", 1, width))
    ranges = rows.groupBy("source_key", "range").agg(F.sum("size").alias("range_size"))
    before = Window.partitionBy("source_key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("range_start", F.coalesce(F.sum("range_size").over(before), F.lit(0))).drop("range_size")
    ranges = ranges.join(shares.select("source_key", "source_size", "target"), "source_key")
    inner = Window.partitionBy("source_key", "range").orderBy("digest", "size", "row_key").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("end", F.sum("size").over(inner)).join(ranges, ["source_key", "range"])
    own = ["source_key", "doc_id", "row_key", "size", "source_size", "target"]
    placed = placed.select(*own, (F.col("range_start") + F.col("end") - F.col("size")).alias("start"), (F.col("range_start") + F.col("end")).alias("end"))
    pieces = placed.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor(F.greatest("start", F.col("end") - 1) / block))))
    pieces = pieces.join(taken, ["source_key", "block"], "left")
    low, high = F.greatest("start", F.col("block") * block), F.least("end", (F.col("block") + 1) * block)
    held = F.coalesce("full", F.lit(0)) * (high - low) + F.greatest(F.lit(0), F.least(high, F.col("block") * block + F.coalesce("part", F.lit(0))) - low)
    first = F.col("block") == F.floor(F.col("start") / block)
    # rows of size 0 share a start with others, and are told apart by row_key; those equal in all of it count together
    whole = pieces.groupBy(*own, "start").agg(F.sum(held).cast("long").alias("taken"), F.max(F.when(first, F.col("slots"))).alias("slots"), F.count(F.when(first, 1)).alias("times"))
    copies = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(F.lit(0)).cast("int")
    slots = F.slice(F.coalesce("slots", F.array().cast("array<bigint>")), 1, copies)
    whole = whole.withColumn("times", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return whole.select("doc_id", "size", "source_size", "target", "taken", slots.alias("slots"), "row_key")


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``, in the order of its slots: each document as often as the plan takes
    it, a copy standing at the slot of the block that it begins in; one document of each source is cut after the words
    that still fit. Rows equal in id, text and source each get the copies of the plan's first of them; an empty table
    gives an empty mix.
    """
    plan = mix_plan(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options).filter("taken > 0")
    plan = plan.groupBy(F.col("doc_id").alias("__id"), F.col("row_key").alias("__key")).agg(F.max(F.struct("taken", "size", "slots")).alias("__plan"))
    text = F.col(text_col).cast("string")
    joined = docs.join(plan, F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (_row_key(text, F.col(source_col).cast("string")) == F.col("__key")))
    copies = joined.select(*docs.columns, "__plan", F.posexplode(F.col("__plan.slots")).alias("__copy", "__slot"))
    left = F.least(F.col("__plan.size"), F.col("__plan.taken") - F.col("__copy") * F.col("__plan.size")).cast("int")
    # words with the white space before them, so that a cut text is a prefix of its document
    head = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"([\\x20\\x09-\\x0D]*{WORD})"), F.lit(1)), 1, left), "")
    copies = copies.withColumn(text_col, F.when(left < F.col("__plan.size"), head).otherwise(F.col(text_col)))
    return copies.repartitionByRange("__slot").sortWithinPartitions("__slot", "__id").select(*docs.columns)

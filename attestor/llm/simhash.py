"""SimHash near-duplicates with pivot distance tables.

Fingerprints come from word 3-shingles. Distinct fingerprints that differ in at most 3 bits are linked; equal ones are
linked by being one node. A Hamming distance to a reference fingerprint changes by at most d between fingerprints d
bits apart, so a table of distances to many references discards pairs whose largest difference exceeds 3.

Candidates come from two kinds of references. Unit references (one bit set) split into blocks: differences of distances
to the references of a block and to zero spell out the block, and at most 3 differing bits leave one of 4 blocks of 16
bits and one of 4 sub-blocks of 12 of the other bits without any, so 16 keys of 28 bits bring each linked pair together.
Inside a key, random references prune by the largest coordinate difference, and survivors are verified on all bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import local_components, shared, utf8
from .components import connected_components

BITS, LIMIT, SHINGLE, SEED = 64, 3, 3, 42
#: Larger groups of one key are compared in tiles of about TILE fingerprints.
TILE = 1024
PIVOTS = np.random.default_rng(20).integers(0, 2**63, 32, dtype=np.uint64) * np.uint64(2) + np.arange(32, dtype=np.uint64) % np.uint64(2)


def _masks() -> list[int]:
    found = []
    for g in range(4):
        block = ((1 << 16) - 1) << (16 * g)
        rest = [i for i in range(BITS) if not block >> i & 1]
        for h in range(4):
            found.append(block | sum(1 << i for i in rest[12 * h : 12 * h + 12]))
    return found


MASKS = _masks()


def fingerprint(text: bytes | None) -> int:
    """The 64-bit fingerprint of one text as an unsigned int; no words (or null): 0."""
    words = (text or b"").lower().split()  # bytes: lower() changes A-Z alone, split() cuts at ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    last = ends[SHINGLE - 1 :] if len(words) >= SHINGLE else ends[-1:]
    first = np.concatenate(([0], ends[: len(last) - 1] + 1))
    digest = xxhash.xxh64_digest
    counts, step = np.zeros(BITS, dtype=np.int64), 1 << 16
    for at in range(0, len(last), step):  # long texts: bounded memory
        raw = b"".join([digest(joined[s:e], SEED) for s, e in zip(first[at : at + step].tolist(), last[at : at + step].tolist())])
        counts += np.unpackbits(np.frombuffer(raw, dtype=np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(last)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row, fp): row is a hash of the text, fp the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t) for t in utf8(b.column(2))), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64))], ["doc_id", "row", "fp"])

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), text.alias("text")).mapInArrow(run, "doc_id long, row long, fp long")


def _link_block(left: np.ndarray, right: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of fingerprints at most LIMIT bits apart, found by pivot distances; ``same``: each pair once."""
    table = np.bitwise_count(left[:, None] ^ PIVOTS).astype(np.int8)
    other = table if same else np.bitwise_count(right[:, None] ^ PIVOTS).astype(np.int8)
    order = np.argsort(other[:, 0], kind="stable")
    coordinate = other[order, 0]
    low, high = np.searchsorted(coordinate, table[:, 0] - LIMIT), np.searchsorted(coordinate, table[:, 0] + LIMIT, side="right")
    found_a, found_b, width, at = [], [], high - low, 0
    while at < len(left):  # about a million pairs at a time
        upto = at + max(1, int(np.searchsorted(np.cumsum(width[at:]), 1 << 20)))
        w = width[at:upto]
        a = np.repeat(np.arange(at, min(upto, len(left))), w)
        b = order[np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w) + np.repeat(low[at:upto], w)]
        at = upto
        if same:
            a, b = a[b > a], b[b > a]
        for k in range(1, len(PIVOTS)):
            if not len(a):
                break
            near = np.abs(table[a, k] - other[b, k]) <= LIMIT
            a, b = a[near], b[near]
        true = np.bitwise_count(left[a] ^ right[b]) <= LIMIT
        found_a.append(a[true])
        found_b.append(b[true])
    return np.concatenate(found_a or [np.zeros(0, int)]), np.concatenate(found_b or [np.zeros(0, int)])


def _link_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, x, y, tile, fp) sorted by (key, x, y), a group per (key, x, y): links inside it. x = y: a whole group
    or one tile; else the links between tile x and tile y. Per group only a spanning star of each component leaves."""

    def links(fp: np.ndarray, tile: np.ndarray, x: int, y: int) -> tuple[np.ndarray, np.ndarray]:
        if x == y:
            a, b = _link_block(fp, fp, True)
        else:
            in_x, in_y = np.flatnonzero(tile == x), np.flatnonzero(tile == y)
            a, b = _link_block(fp[in_x], fp[in_y], False)
            a, b = in_x[a], in_y[b]
        root = local_components(len(fp), a, b)
        moved = np.flatnonzero(root != np.arange(len(fp)))
        return fp[moved], fp[root[moved]]

    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    held: list[np.ndarray] = []

    def close(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, x, y, tile, fp = cols
        cut = np.flatnonzero((key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1
        starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(key)]))
        size = ends - starts
        out_a, out_b = [], []
        two = starts[size == 2]  # most groups: a pair, done at once
        two = two[(x[two] == y[two]) | (tile[two] != tile[two + 1])]
        if len(two):
            far = (np.abs(np.bitwise_count(fp[two][:, None] ^ PIVOTS).astype(np.int8) - np.bitwise_count(fp[two + 1][:, None] ^ PIVOTS).astype(np.int8)).max(axis=1) > LIMIT)
            two = two[~far]
            two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= LIMIT]
            out_a.append(fp[two])
            out_b.append(fp[two + 1])
        for s, e in zip(starts[size > 2], ends[size > 2]):
            a, b = links(fp[s:e], tile[s:e], int(x[s]), int(y[s]))
            out_a.append(a)
            out_b.append(b)
        if out_a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v).view(np.int64)) for v in (out_a, out_b)], schema=schema)

    for batch in batches:
        if not batch.num_rows:
            continue
        now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
        now[4] = now[4].view(np.uint64)
        held = now if not held else [np.concatenate(p) for p in zip(held, now)]
        open_ = (held[0] == held[0][-1]) & (held[1] == held[1][-1]) & (held[2] == held[2][-1])
        start = int(np.argmax(open_))
        if start:
            yield from close([c[:start] for c in held])
            held = [c[start:] for c in held]
    if held:
        yield from close(held)


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """Distinct longs ``fp`` to (a, b): links that connect the same fingerprints as all pairs within LIMIT bits do."""
    keys = F.explode(F.array(*[F.xxhash64(F.col("fp").bitwiseAND(F.lit(m - 2**64 if m >= 2**63 else m)), F.lit(i)) for i, m in enumerate(MASKS)]))
    keyed = fps.select("fp", keys.alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    tile = F.when(F.col("n") > 2 * TILE, F.pmod(F.xxhash64("fp"), tiles).cast("int")).otherwise(F.lit(0))
    rows = keyed.join(sizes, "key").withColumn("tile", tile)
    # a fingerprint of tile t meets tiles 0..t as the right one and t..last as the left one
    pairs = F.when(F.col("n") > 2 * TILE, F.transform(F.sequence(F.lit(0), tiles - 1), lambda o: F.struct(F.least(o, F.col("tile")).alias("x"), F.greatest(o, F.col("tile")).alias("y")))).otherwise(F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"))))
    groups = rows.withColumn("p", F.explode(pairs)).select("key", "p.x", "p.y", "tile", "fp")
    return groups.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(_link_groups, "a long, b long").distinct()


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, row, fp, root, component_id) of each row; root names the component also if it has no id."""
    prints = shared(fingerprints(docs, id_col, text_col))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(fingerprint_links(nodes.select("fp")))
    rooted = shared(nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(rooted.join(ids, "root").select("fp", "root", "component_id"), "fp").select("doc_id", "row", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, fp, component_id (the smallest doc_id of its component).

    Null and empty texts have fingerprint 0 and are linked like any other; rows that repeat an id or have none come back
    as often as they came in, a component without any id having a null component_id; an empty table gives no rows.
    """
    return _grouped(docs, id_col, text_col).select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row of ``docs`` that has the smallest id of its component, one per component. Where rows share an id, the text
    tells which of them is meant, and equal rows leave one; a component without any id keeps one row, told by its text."""
    own = F.when(F.col("doc_id").isNull() & F.col("component_id").isNull(), F.col("root"))
    found = shared(_grouped(docs, id_col, text_col).groupBy("doc_id", own.alias("own")).agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("doc_id").eqNullSafe(F.col("component_id")), F.col("row"))).alias("__row")))
    odd = found.filter("n > 1 OR doc_id IS NULL").limit(1).count() > 0
    kept = found.filter("__row IS NOT NULL").select(F.col("doc_id").alias("__id"), "__row")
    same = F.col(id_col).cast("long").eqNullSafe(F.col("__id"))
    if not odd:
        return docs.join(kept, same).drop("__id", "__row")
    text = F.xxhash64(F.col(text_col).cast("string"))
    return docs.join(kept, same & (text == F.col("__row"))).dropDuplicates(["__id", "__row"]).drop("__id", "__row")

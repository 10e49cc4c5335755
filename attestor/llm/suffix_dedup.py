"""Exact removal of repeated byte strings by bucket-pointer refinement.

A byte goes if a string of LENGTH bytes that covers it also starts earlier (smaller document, or earlier in the same).
Sorting every suffix of the corpus in one place is out of the question, so suffixes are dealt to tasks by content:

1. In each document, bucket ids of q-grams are refined by doubling: the id of a 2k-gram comes from the ids of the
   k-gram at p and of the one at p + k, up to 32-grams. Of the 69 32-grams in each string of 100 bytes the one with the
   least id is its anchor. Strings are equal only if their anchors are, so anchors part the suffixes. Neighbouring
   strings with the same anchor make a run, and only runs (about one for 35 bytes) are shuffled, packed in binary.
2. Runs with the same anchor and the same bytes repeat as a whole: all but the first go.
3. What is left are anchors with several different runs. Their bytes are fetched, and bucket-pointer refinement orders
   their suffixes to depth LENGTH: initial 4-gram buckets, then sorting on the bucket identifiers of later offsets
   (4, 8, 16, ...), every update being reused by the next, and buckets of one suffix being done. Suffixes that share
   their last bucket are equal strings: all but the first go.

Anchors that very many documents hold (found in a bounded sample) are not dealt as runs but string by string, which
spreads them; equal runs are combined in each batch before the shuffle. So no hot passage meets in one task. Anchors that
still have more than MANY_RUNS different runs after step 2 (counted, not sampled) leave step 3 for an aggregation of their
strings by 128 bits of hash, which combines before its shuffle: a task of step 3 never holds more than COMPARE_BYTES and
one anchor's MANY_RUNS runs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_table, slices, utf8, with_keys

LENGTH, GRAM = 100, 32
SEGMENT = 1 << 19
#: Documents in the sample for hot anchors, and the share of them from which an anchor is hot.
SAMPLE_DOCS, HOT_SHARE = 2048, 0.01
PART_BYTES = 24 << 20
#: Bytes of runs that are refined together, runs of one anchor that are refined at all, and rows of a batch in Python.
COMPARE_BYTES, MANY_RUNS, SLICE_ROWS = 512 << 10, 4096, 256

_BYTE = np.random.default_rng(3).integers(0, 2**63, 256, dtype=np.uint64)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_POS = np.uint64((1 << 24) - 1)
_RUN = np.dtype([("anchor", "<u8"), ("bytes", "<u8"), ("doc", "<i8"), ("at", "<i8"), ("n", "<i4")])


def _double(ids: np.ndarray, step: int) -> np.ndarray:
    """Bucket ids of grams twice as long from those at each place and at ``step`` places later."""
    x = ids[:-step] * _M1 + ids[step:]
    x ^= x >> np.uint64(29)
    x *= _M2
    x ^= x >> np.uint64(32)
    return x


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    m, size = x, 1
    while size * 2 <= width:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    rest = width - size
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def runs_of(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor id, start, strings) of each run of a document's strings of LENGTH bytes."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for base in range(0, max(1, len(text) - LENGTH + 1), SEGMENT):
        part = np.frombuffer(text, np.uint8, count=min(len(text) - base, SEGMENT + LENGTH - 1), offset=base) if len(text) > base else np.zeros(0, np.uint8)
        if len(part) < LENGTH:
            continue
        ids, step = _BYTE[part], 1
        while step < GRAM:
            ids = _double(ids, step)
            step *= 2
        keyed = (ids & ~_POS) | np.arange(len(ids), dtype=np.uint64)
        anchor = (_window_min(keyed, LENGTH - GRAM + 1) & _POS).astype(np.int64)
        start = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        out.append((ids[anchor[start]], start + base, np.diff(np.append(start, len(anchor)))))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*out))


def _batch_runs(keys: list[int], texts: list[bytes | None], hot: np.ndarray) -> np.ndarray:
    parts = []
    digest = xxhash.xxh3_64_intdigest
    for key, text in zip(keys, texts):
        if text is None or len(text) < LENGTH:
            continue
        anchor, at, n = runs_of(text)
        if len(hot):
            spread = np.isin(anchor, hot)
            if spread.any():  # string by string, each its own anchor
                one = np.concatenate([np.arange(a, a + k) for a, k in zip(at[spread], n[spread])])
                own = np.fromiter((digest(text[a : a + LENGTH], 1) for a in one.tolist()), np.uint64, len(one))
                anchor, at, n = np.concatenate([anchor[~spread], own]), np.concatenate([at[~spread], one]), np.concatenate([n[~spread], np.ones(len(one), np.int64)])
        r = np.empty(len(at), _RUN)
        r["anchor"], r["at"], r["n"], r["doc"] = anchor, at, n, key
        tail = LENGTH - 1
        r["bytes"] = np.fromiter((digest(text[a:b]) for a, b in zip(at.tolist(), (at + n + tail).tolist())), np.uint64, len(at))
        parts.append(r)
    return np.concatenate(parts) if parts else np.empty(0, _RUN)


def _split_first(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs in order of anchor, bytes, doc, at; and which of them repeat the one before as a whole."""
    r = r[np.lexsort((r["at"], r["doc"], r["bytes"], r["anchor"]))]
    again = np.zeros(len(r), bool)
    again[1:] = (r["anchor"][1:] == r["anchor"][:-1]) & (r["bytes"][1:] == r["bytes"][:-1])
    return r, again


def _pack(r: np.ndarray) -> bytes:
    """Column by column, documents as distances from the first where they fit: a third smaller than rows."""
    base = int(r["doc"].min())
    small = int(r["doc"].max()) - base < 2**32 and int(r["at"].max()) < 2**32
    kinds = ("<u4", "<u4") if small else ("<i8", "<i8")
    head = np.array([len(r), base, small], "<i8").tobytes()
    return head + r["anchor"].tobytes() + r["bytes"].tobytes() + (r["doc"] - base).astype(kinds[0]).tobytes() + r["at"].astype(kinds[1]).tobytes() + r["n"].astype("u1").tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    n, base, small = (int(v) for v in np.frombuffer(raw, "<i8", 3))
    width = 4 if small else 8
    kind, at, r = "<u4" if small else "<i8", 24, np.empty(n, _RUN)
    for name, k, size in (("anchor", "<u8", 8), ("bytes", "<u8", 8), ("doc", kind, width), ("at", kind, width), ("n", "u1", 1)):
        r[name] = np.frombuffer(raw, k, n, at)
        at += n * size
    r["doc"] += base
    return r


def _buckets(keys: np.ndarray) -> np.ndarray:
    """Numbers from 0 for the distinct keys, in their order."""
    order = np.argsort(keys, kind="stable")
    fresh = np.empty(len(keys), np.int32)
    fresh[:1] = 0
    np.cumsum(keys[order[1:]] != keys[order[:-1]], out=fresh[1:])
    ids = np.empty(len(keys), np.int32)
    ids[order] = fresh
    return ids


def refine(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Bucket of the LENGTH bytes at each of ``starts``: equal strings share a bucket, others don't.

    ``text`` holds LENGTH bytes from each start on. All positions get ids, as later offsets point to them.
    """
    padded = np.concatenate([text, np.zeros(4, np.uint8)]).astype(np.uint32)
    ids = _buckets(padded[:-4] | padded[1:-3] << np.uint32(8) | padded[2:-2] << np.uint32(16) | padded[3:-1] << np.uint32(24))
    depth, top, last = 4, int(ids.max()) + 1, len(text) - 1
    live = np.arange(len(text), dtype=np.int32)
    while depth < LENGTH // 2 + 1:
        live = live[np.bincount(ids, minlength=top)[ids[live]] > 1]  # a bucket of one suffix is done
        later = np.minimum(live + np.int32(depth), np.int32(last))
        pair = ids[live].astype(np.int64) * top + np.where(live + depth <= last, ids[later], 0)
        fresh = _buckets(pair)
        ids = ids.copy()
        ids[live] = fresh + np.int32(top)
        top += int(fresh.max()) + 1 if len(fresh) else 0
        depth *= 2
    return _buckets(ids[starts].astype(np.int64) * top + ids[starts + LENGTH - depth])


def _refine_runs(doc: np.ndarray, at: np.ndarray, contexts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, at, strings) of the strings in these runs that start earlier in another of them."""
    size = np.fromiter(map(len, contexts), np.int64, len(contexts))
    n = size - LENGTH + 1
    first = np.cumsum(size) - size
    text = np.frombuffer(b"".join(contexts), np.uint8)
    run = np.repeat(np.arange(len(n)), n)
    offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    bucket = refine(text, first[run] + offset)
    where = at[run] + offset
    order = np.lexsort((where, doc[run], bucket))
    again = np.zeros(len(order), bool)
    again[1:] = bucket[order][1:] == bucket[order][:-1]
    gone = np.sort(order[again])  # in order of run and offset
    if not len(gone):
        return (np.zeros(0, np.int64),) * 3
    r, w = run[gone], where[gone]
    cut = np.flatnonzero(np.concatenate(([True], (r[1:] != r[:-1]) | (w[1:] != w[:-1] + 1))))
    return doc[r[cut]], w[cut], np.diff(np.append(cut, len(gone)))


def _hot_anchors(docs: DataFrame, n_docs: int) -> np.ndarray:
    share = min(1.0, SAMPLE_DOCS / max(1, n_docs))
    drawn = docs.filter(F.pmod(F.xxhash64("key", F.lit(3)), F.lit(1_000_000)) < int(share * 1_000_000) + 1).select("key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.unique(runs_of(t)[0]) for t in utf8(b.column(1)) if t]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64))], ["anchor"])

    least = max(16, int(HOT_SHARE * min(SAMPLE_DOCS, n_docs)))
    hot = drawn.mapInArrow(run, "anchor long").groupBy("anchor").count().filter(F.col("count") >= least).select("anchor").toArrow()
    return np.sort(hot["anchor"].to_numpy().view(np.uint64)) if hot.num_rows else np.zeros(0, np.uint64)


def removed_strings(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents (key, text) to (whole, open): ``whole`` (doc, at, n) are runs of strings that go, ``open`` (doc, at, n,
    anchor) runs that must still be compared. Both come from one table in the shared folder."""
    spark = docs.sparkSession
    n_docs, n_bytes = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // PART_BYTES))
    deal = 4 * parts
    hot = spark.sparkContext.broadcast(_hot_anchors(docs, n_docs))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 8 * SLICE_ROWS):
            r, again = _split_first(_batch_runs(b.column(0).to_pylist(), utf8(b.column(1)), hot.value))
            rows: list[tuple[int, int, bytes]] = []
            for kind, some in ((0, r[~again]), (1, r[again])):  # what repeats within the batch needs no comparing
                by = ((some["anchor"] >> np.uint64(7)) % np.uint64(deal)).astype(np.int64) if kind == 0 else some["doc"] % deal
                order = np.argsort(by, kind="stable")
                some, by = some[order], by[order]
                bounds = np.flatnonzero(np.concatenate(([True], by[1:] != by[:-1]))) if len(by) else []
                for s, e in zip(bounds, [*bounds[1:], len(by)]):
                    rows.append((int(by[s]), kind, _pack(some[s:e])))
            cols = list(zip(*rows)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int32(), pa.binary()))], ["part", "kind", "runs"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc", "at", "n", "anchor", "open"]

        def rows(r: np.ndarray, is_open: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(r["doc"]), pa.array(r["at"]), pa.array(r["n"]), pa.array(r["anchor"].view(np.int64)), pa.array(np.full(len(r), is_open))], names)

        held = []
        for b in batches:
            for kind, raw in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                if kind:
                    yield rows(_unpack(raw), False)
                else:
                    held.append(_unpack(raw))
        if held:
            r, again = _split_first(np.concatenate(held))
            yield rows(np.ascontiguousarray(r[again]), False)
            r = r[~again]
            same = np.zeros(len(r), bool)
            same[1:] = r["anchor"][1:] == r["anchor"][:-1]
            same[:-1] |= same[1:]
            yield rows(np.ascontiguousarray(r[same]), True)

    kind = "doc long, at long, n int, anchor long, open boolean"
    packed = docs.select("key", "text").mapInArrow(cut, "part int, kind int, runs binary").repartition(parts, "part")
    found = shared_table(packed.mapInArrow(meet, kind))
    return found.filter("NOT open").select("doc", "at", "n"), found.filter("open").select("doc", "at", "n", "anchor")


def _refined(docs: DataFrame, open_: DataFrame) -> DataFrame:
    """(doc, at, n) of the strings in open runs that go; fetches the runs' bytes from the documents.

    Runs of anchors with more than MANY_RUNS of them come as strings, hashed twice; the first of each is kept.
    """
    parts = docs.sparkSession.conf.get("spark.sql.shuffle.partitions")
    many = open_.groupBy("anchor").count().filter(F.col("count") > MANY_RUNS).select("anchor", F.lit(True).alias("many"))
    marked = open_.join(many, "anchor", "left").select("doc", "at", "n", "anchor", F.coalesce("many", F.lit(False)).alias("many"))
    lists = marked.groupBy("doc").agg(F.collect_list(F.struct("at", "n", "anchor")).alias("runs"), F.collect_list(F.when(F.col("many"), F.col("at"))).alias("single"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        digest = xxhash.xxh3_128_intdigest
        for b in slices(batches, SLICE_ROWS):
            rows: list[tuple] = []
            for key, text, runs, single in zip(b.column(0).to_pylist(), utf8(b.column(1)), b.column(2), b.column(3).to_pylist()):
                fields = runs.values
                spread = set(single)
                for at, n, anchor in zip(*(fields.field(k).to_pylist() for k in range(3))):
                    if at in spread:
                        for x in range(at, at + n):
                            h = digest(text[x : x + LENGTH])
                            rows.append((key, x, (h >> 64) - 2**63, (h & 2**64 - 1) - 2**63, None))
                    else:
                        rows.append((key, at, anchor, None, text[at : at + n + LENGTH - 1]))
                    if len(rows) >= 8192:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by anchor: about COMPARE_BYTES of whole anchors at a time."""
        doc, at, cuts, size, last = [], [], [], 0, None

        def close() -> pa.RecordBatch:
            d, a, n = _refine_runs(np.array(doc, np.int64), np.array(at, np.int64), cuts)
            doc.clear(), at.clear(), cuts.clear()
            return pa.RecordBatch.from_arrays([pa.array(d), pa.array(a), pa.array(n.astype(np.int32))], ["doc", "at", "n"])

        for b in slices(batches, 4096):
            for d, a, k, c in zip(*(b.column(i).to_pylist() for i in range(4))):
                if size > COMPARE_BYTES and k != last:
                    yield close()
                    size = 0
                doc.append(d)
                at.append(a)
                cuts.append(c)
                size, last = size + len(c), k
        if doc:
            yield close()

    names = ["doc", "at", "anchor", "more", "bytes"]
    joined = docs.join(lists, docs["key"] == lists["doc"]).select("key", "text", "runs", "single")
    cuts = shared_table(joined.mapInArrow(fetch, "doc long, at long, anchor long, more long, bytes binary"))
    runs = cuts.filter("more IS NULL").select("doc", "at", "anchor", "bytes").repartition(int(parts), "anchor").sortWithinPartitions("anchor").mapInArrow(compare, "doc long, at long, n int")
    strings = cuts.filter("more IS NOT NULL").select("doc", "at", F.col("anchor").alias("high"), F.col("more").alias("low"))
    first = strings.groupBy("high", "low").agg(F.min(F.struct("doc", "at")).alias("first"), F.count(F.lit(1)).alias("times")).filter("times > 1").select("high", "low", "first")
    later = strings.join(first, ["high", "low"]).filter("struct(doc, at) <> first").select("doc", "at", F.lit(1).alias("n"))
    return runs.unionByName(later)


def strip_runs(text: bytes, at: np.ndarray, n: np.ndarray) -> tuple[bytes, int, int]:
    """(kept bytes, bytes removed, maximal runs removed) once the strings at[i] .. at[i] + n[i] - 1 go."""
    if not len(at):
        return text, 0, 0
    edge = np.zeros(len(text) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n + LENGTH - 1, -1)
    gone = np.cumsum(edge[:-1]) > 0
    spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
    return np.frombuffer(text, np.uint8)[~gone].tobytes(), int(gone.sum()), spans


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, kept (binary), n_bytes, n_removed, n_spans, kept_sha256.

    Null text counts as empty; texts shorter than LENGTH lose nothing; rows equal in id and text are one document, rows
    that share an id otherwise come in order of their text's digest, rows without an id last; an empty table gives no
    rows. Strings never cross documents and are judged on the input.

    Documents are shuffled by key once: fetching open runs and stripping use the same exchange.
    """
    keyed, odd = with_keys(docs, id_col, text_col)
    if odd:
        keyed = shared_table(keyed)
    keyed = keyed.filter("key IS NOT NULL")
    texts = keyed.select("key", "text")
    whole, open_ = removed_strings(texts)
    gone = whole.unionByName(_refined(texts, open_)).groupBy("doc").agg(F.collect_list("at").alias("at"), F.collect_list("n").alias("n"))
    kind = "key long, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, SLICE_ROWS):
            out = []
            for text, at, n in zip(utf8(b.column(1)), b.column(2), b.column(3)):
                text = text or b""
                kept, removed, spans = strip_runs(text, np.asarray(at.values if at.is_valid else [], np.int64), np.asarray(n.values if n.is_valid else [], np.int64))
                out.append((kept, len(text), removed, spans, hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string())))], [x.split()[0] for x in kind.split(", ")])

    stripped = texts.join(gone, texts["key"] == gone["doc"], "left").select("key", "text", "at", "n").mapInArrow(strip, kind)
    if not odd:
        return stripped.withColumnRenamed("key", "doc_id")
    return stripped.join(keyed.select("key", "doc_id"), "key").drop("key")

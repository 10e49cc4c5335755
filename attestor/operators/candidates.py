"""Candidate pairs of documents from an inverted index, dossiers, and batches of pairs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEIGHTS = {"document": 100, "scope": 10, "claim": 40, "quote": 60, "lexical": 20}
LEAST, MOST, PER_SOURCE = 2, 64, 32
DOSSIER_DOCS, BATCH_EDGES, BATCH_DOCS, CHUNK = 12, 32, 12, 8
#: A filter of ids has at most so many rows, each of so many numbers of 64 bits: 8 MiB, however many ids there are.
ROWS, LONGS = 16384, 64


def posting_edges(postings: DataFrame) -> DataFrame:
    """(source_id, key_kind, key) to (a, b, weight), a < b: sums of the weights of shared keys, over keys that LEAST to
    MOST sources hold, so that the self-join makes at most MOST rows for each posting."""
    p = postings.select("source_id", "key_kind", "key").distinct()
    sizes = p.groupBy("key_kind", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n").between(LEAST, MOST)).select("key_kind", "key")
    p = p.join(sizes, ["key_kind", "key"])
    weight = F.create_map(*[x for k, w in WEIGHTS.items() for x in (F.lit(k), F.lit(w))])[F.col("key_kind")]
    pairs = p.withColumnRenamed("source_id", "a").join(p.withColumnRenamed("source_id", "b"), ["key_kind", "key"]).filter("a < b")
    return pairs.groupBy("a", "b").agg(F.sum(weight).alias("weight"))


def candidate_graph(postings: DataFrame, per_source: int = PER_SOURCE) -> DataFrame:
    """The heaviest ``per_source`` neighbours of each source, ties to the smaller id; pairs that either side keeps."""
    e = posting_edges(postings)
    both = e.select(F.col("a").alias("s"), F.col("b").alias("t"), "weight").unionByName(e.select(F.col("b").alias("s"), F.col("a").alias("t"), "weight"))
    w = Window.partitionBy("s").orderBy(F.desc("weight"), "t")
    top = both.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= per_source)
    return top.select(F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b"), "weight").distinct()


def dossier_keys(sources: DataFrame) -> DataFrame:
    """(source_id, dossier) of sources (source_id, path; scenario and purpose of their front matter, null if there is
    none): scenario and purpose, or scenario alone, else the folder, else the source itself."""
    folder = F.regexp_extract(F.translate("path", "\\", "/"), r"^(.+)/[^/]*$", 1)
    named = F.when(F.col("scenario").isNotNull(), F.concat_ws(":", F.lit("scenario"), "scenario", F.when(F.col("purpose").isNotNull(), F.concat(F.lit("purpose:"), "purpose"))))
    return sources.select("source_id", F.coalesce(named, F.when(folder != "", F.concat(F.lit("path:"), folder)), F.concat(F.lit("source:"), "source_id")).alias("dossier"))


def dossier_plan(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(dossier, a, b): all pairs of dossiers of at most DOSSIER_DOCS documents, else their candidate edges; edges
    across dossiers only where an end is in none (dossier null)."""
    m = members.filter("dossier IS NOT NULL")
    n = m.groupBy("dossier").agg(F.count(F.lit(1)).alias("n"))
    m = m.join(n, "dossier")
    small = m.filter(F.col("n") <= DOSSIER_DOCS)
    pairs = small.select("dossier", F.col("source_id").alias("a")).join(small.select("dossier", F.col("source_id").alias("b")), "dossier").filter("a < b")
    of = members.select("source_id", "dossier")
    e = edges.select("a", "b").join(of.select(F.col("source_id").alias("a"), F.col("dossier").alias("da")), "a", "left").join(of.select(F.col("source_id").alias("b"), F.col("dossier").alias("db")), "b", "left")
    inside = e.filter("da = db").join(n.filter(F.col("n") > DOSSIER_DOCS).select(F.col("dossier").alias("da")), "da").select(F.col("da").alias("dossier"), "a", "b")
    across = e.filter("da IS NULL OR db IS NULL").select(F.lit(None).cast("string").alias("dossier"), "a", "b")
    return pairs.select("dossier", "a", "b").unionByName(inside).unionByName(across)


def edge_chunks(edges: DataFrame, size: int = CHUNK) -> DataFrame:
    """Chunks of ``size`` edges in each group, in order of (a, b)."""
    w = Window.partitionBy("dossier").orderBy("a", "b")
    return edges.withColumn("chunk", F.floor((F.row_number().over(w) - 1) / size))


def bounded_batches(edges: DataFrame) -> DataFrame:
    """Greedy batches in order of (a, b): a new one before edge BATCH_EDGES + 1 or document BATCH_DOCS + 1. What fits
    depends on all earlier choices, so this is a fold over each dossier's edges and no window."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["a", "b"])
        batch, n, docs, out = 0, 0, set(), []
        for a, b in zip(pdf["a"], pdf["b"]):
            if n and (n >= BATCH_EDGES or len(docs | {a, b}) > BATCH_DOCS):
                batch, n, docs = batch + 1, 0, set()
            n, docs = n + 1, docs | {a, b}
            out.append(batch)
        return pd.DataFrame({"dossier": pdf["dossier"], "a": pdf["a"], "b": pdf["b"], "batch": out})

    return edges.select("dossier", "a", "b").groupBy("dossier").applyInPandas(run, "dossier string, a string, b string, batch long")


def unique_endpoints(refs: DataFrame, profiles: DataFrame) -> DataFrame:
    """(id, endpoint) to (id, endpoint, source_id): endpoints that name a document_id of exactly one profile become its
    source; known sources, unknown and ambiguous names stay as they are."""
    unique = profiles.filter("document_id IS NOT NULL").groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), F.min("source_id").alias("source")).filter("n = 1")
    known = profiles.select(F.col("source_id").alias("endpoint"), F.lit(True).alias("known")).distinct()
    joined = refs.join(known, "endpoint", "left").join(unique.select(F.col("document_id").alias("endpoint"), "source"), "endpoint", "left")
    return joined.select("id", "endpoint", F.when(F.col("known"), F.col("endpoint")).otherwise(F.coalesce("source", "endpoint")).alias("resolved"))


def _cells(h: Column) -> list[Column]:
    """Row of a hash in a filter of ids, and its two bits there."""
    return [h.bitwiseAND(ROWS - 1), F.shiftright(h, 14).bitwiseAND(64 * LONGS - 1), F.shiftright(h, 26).bitwiseAND(64 * LONGS - 1)]


def id_filter(ids: DataFrame) -> DataFrame:
    """(document_id) to (filter_row, bits): a Bloom filter in which an id has two bits of one row."""
    row, *bits = _cells(F.xxhash64("document_id"))
    cells = ids.filter("document_id IS NOT NULL").select(row.alias("filter_row"), F.explode(F.array(*bits)).alias("cell"))
    longs = cells.groupBy("filter_row", F.expr("cell div 64").alias("at")).agg(F.expr("bit_or(shiftleft(1L, CAST(cell % 64 AS INT)))").alias("bits"))
    found = longs.groupBy("filter_row").agg(F.map_from_entries(F.collect_list(F.struct("at", "bits"))).alias("m"))
    every = F.sequence(F.lit(0).cast("long"), F.lit(LONGS - 1).cast("long"))
    return found.select("filter_row", F.transform(every, lambda i: F.coalesce(F.col("m")[i], F.lit(0).cast("long"))).alias("bits"))


def maybe_ids(words: DataFrame, ids: DataFrame) -> DataFrame:
    """The words whose document_id is one of ids, and few others; they are not shuffled."""
    row, *bits = _cells(F.col("h"))
    held = [F.expr(f"shiftright(get(bits, CAST({c} div 64 AS INT)), CAST({c} % 64 AS INT)) & 1L = 1L") for c in ("bit_a", "bit_b")]
    w = words.withColumn("h", F.xxhash64("document_id")).withColumns({"row": row, "bit_a": bits[0], "bit_b": bits[1]})
    return w.join(F.broadcast(id_filter(ids)), (F.col("row") == F.col("filter_row")) & held[0] & held[1], "left_semi").select(*words.columns)


def body_references(units: DataFrame, profiles: DataFrame, limit: int = 64) -> DataFrame:
    """(source_id, target_id): the first ``limit`` document ids that a source's text names and that are unique.

    Only words that a filter of ids lets pass are shuffled; they then stream past a hash table of a task's ids, so no
    task sorts them and a frequent word takes no memory."""
    unique = profiles.filter("document_id IS NOT NULL").groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), F.min("source_id").alias("target_id")).filter("n = 1").select("document_id", "target_id")
    words = units.select("source_id", "line_start", F.posexplode(F.regexp_extract_all("text", F.lit(r"([A-Za-z0-9_.-]+)"), F.lit(1))).alias("p", "document_id"))
    named = maybe_ids(words, profiles.select("document_id"))
    first = named.join(unique.hint("shuffle_hash"), "document_id").filter("source_id <> target_id").groupBy("source_id", "target_id").agg(F.min(F.struct("line_start", "p")).alias("at"))
    w = Window.partitionBy("source_id").orderBy("at")
    return first.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= limit).select("source_id", "target_id")

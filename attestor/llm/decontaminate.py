"""Benchmark decontamination by latent semantic retrieval.

1. Terms are the words of the benchmark; they are counted over all documents, and common ones weigh nothing, but for an
   item's rarest.
2. A randomised SVD of the TF-IDF passage matrix A (all passages of all documents, and the benchmark items as rows more)
   takes one distributed pass: each task sums its passages' products of terms, A'A, multiplies them with a random matrix,
   and tasks' (terms x columns) results are added by term blocks. The strongest right singular vectors follow from the sum
   and the random matrix, so that the latent space is that of the corpus.
3. Each passage is projected into the latent space; items with enough cosine there are candidates. So are, whatever the
   latent space holds of them, items with enough cosine in plain terms, or of whose weight the passage holds enough; both
   are exact and have no rank.
4. A candidate is a leak if the longest common subsequence of words covers enough of the item, or covers less of it but
   the item's answer, its last words, stands in the passage as it is.

The benchmark is worked through in groups of GROUP_BYTES at most, and a group in shards of SHARD_TERMS terms at most; one
group is collected and broadcast at a time, so that both stay bounded however large the benchmark is.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, utf8

#: Words of a passage; passages start every STRIDE words.
PASSAGE, STRIDE = 48, 24
#: Latent dimensions, and random columns of the range pass.
RANK, SKETCH = 256, 264
#: Terms that stand more often than once in 1 / COMMON passages weigh nothing.
COMMON = 0.02
#: Rarest words of an item that weigh whatever their frequency.
LEAST_TERMS = 8
#: Cosine that makes a candidate: in plain terms, and in the latent space (both vectors projected and of unit length).
COSINE, LATENT_COSINE = 0.30, 0.50
#: Share of an item's words in the common subsequence: alone enough, and enough beside the answer.
LCS_ALONE, LCS_WITH_ANSWER, ANSWER_WORDS = 0.8, 0.6, 6
#: Share of an item's weight that a passage holds: enough to be a candidate whatever its cosine.
HELD = 0.30
#: Bytes of benchmark text in a group, on average, and terms of a shard: a task sums SHARD_TERMS squared products, and a
#: shard's broadcast is SHARD_TERMS x (SKETCH or RANK) numbers. Of an item with more terms the rarest are its search terms.
GROUP_BYTES, SHARD_TERMS = 256 << 10, 4608
_BLOCKS = 64


#: item_id, cosine, common subsequence, its share of the item, whether the answer was found, first word looked at
Leak = tuple[int, float, int, float, bool, int]


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def _bare(word: bytes) -> bytes:
    return word.strip(b".,;:!?\"'()[]*#$%&|") or word


@dataclass
class Shard:
    """One shard of the benchmark: ids, items as term ids, the vocabulary, and what the passes add."""

    ids: list[int]
    items: list[list[bytes]]
    vocab: dict[bytes, int]
    bare: list[list[bytes]]
    bags: list[Counter]
    idf: np.ndarray | None = None
    #: Terms x latent dimensions, and the items' unit vectors there.
    basis: np.ndarray | None = None
    latent: np.ndarray | None = None
    #: Of each term the items that hold it: where a term's entries start, items, shares of their weight, unit weights.
    postings: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None = None


def _make_shard(rows: list[tuple[int, bytes]]) -> Shard:
    items = [words_of(t) for _, t in rows]
    vocab: dict[bytes, int] = {}
    for item in items:
        for w in item:
            vocab.setdefault(w, len(vocab))
    bare = [[_bare(w) for w in item] for item in items]
    return Shard([i for i, _ in rows], items, vocab, bare, [Counter(x) for x in bare])


def _hits(words: list[bytes], vocab: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Positions and terms of the words that the vocabulary holds."""
    ids = np.fromiter(map(vocab.get, words, repeat(-1)), dtype=np.int64, count=len(words))
    at = np.flatnonzero(ids >= 0)
    return at, ids[at]


def _count(n_words: int) -> int:
    """Passages of a text: passage p covers words p * STRIDE to p * STRIDE + PASSAGE - 1."""
    return max(1, -(-(n_words - STRIDE) // STRIDE)) if n_words else 0


def _in_passages(at: np.ndarray, term: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(passage, term) of each word in each passage that covers it (two, but at both ends)."""
    block = at // STRIDE
    first, second = block <= count - 1, block >= 1
    return np.concatenate([block[first], block[second] - 1]), np.concatenate([term[first], term[second]])


def _unit_rows(passage: np.ndarray, term: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sparse TF-IDF rows of unit length, in order of passage: passages, then for each entry its row, term and weight."""
    code, tf = np.unique(passage * len(idf) + term, return_counts=True)
    passage, term = code // len(idf), code % len(idf)
    start = np.concatenate(([True], passage[1:] != passage[:-1]))
    row = np.cumsum(start) - 1
    weight = np.sqrt(tf) * idf[term]
    norm = np.sqrt(np.bincount(row, weight * weight))
    return passage[start], row, term, weight / norm[row]


def _rare(shard: Shard) -> tuple[dict[bytes, int], np.ndarray]:
    """The vocabulary and weights of the terms that weigh anything."""
    keep = {w: i for w, i in shard.vocab.items() if shard.idf[i] > 0}
    return keep, shard.idf


def _term_counts(docs: DataFrame, shards: list[Shard]) -> tuple[list[np.ndarray], int]:
    """How often each term of each shard stands in all documents, and the number of passages. Tasks send sums."""
    shared_vocab = docs.sparkSession.sparkContext.broadcast([s.vocab for s in shards])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, counts = 0, [np.zeros(len(v), np.int64) for v in shared_vocab.value]
        for b in batches:
            for text in utf8(b.column(0)):
                words = words_of(text)
                total += _count(len(words))
                for vocab, c in zip(shared_vocab.value, counts):
                    _, term = _hits(words, vocab)
                    np.add.at(c, term, 1)
        for k, c in enumerate(counts):
            hit = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), k, np.int32)), pa.array(hit), pa.array(c[hit])], ["shard", "term", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([0], pa.int64()), pa.array([total], pa.int64())], ["shard", "term", "n"])

    rows = docs.mapInArrow(run, "shard int, term long, n long").groupBy("shard", "term").agg(F.sum("n").alias("n")).toArrow()
    shard, term, n = (rows[c].to_numpy() for c in ("shard", "term", "n"))
    out = []
    for k, s in enumerate(shards):
        c = np.zeros(len(s.vocab), np.int64)
        c[term[shard == k]] = n[shard == k]
        out.append(c)
    return out, int(n[shard == -1].sum())


def _products(passage: np.ndarray, term: np.ndarray, idf: np.ndarray, gram: np.ndarray) -> None:
    """Adds the products of each passage's unit row with itself to gram, above and on the diagonal."""
    _, row, t, w = _unit_rows(passage, term, idf)
    n = np.bincount(row)
    ends = np.cumsum(n)[row]
    after = ends - np.arange(len(t))  # entries of the row from this one on, terms ascending
    left = np.repeat(np.arange(len(t)), after)
    right = left + np.arange(len(left)) - np.repeat(np.cumsum(after) - after, after)
    np.add.at(gram.reshape(-1), t[left] * gram.shape[1] + t[right], (w[left] * w[right]).astype(np.float32))


def _range_pass(docs: DataFrame, shard: Shard, omega: np.ndarray) -> np.ndarray:
    """A'A omega over the passages of all documents. Each task keeps A'A of its passages over the terms that weigh."""
    weighs = np.flatnonzero(shard.idf > 0)
    dense = {w: i for i, w in enumerate(w for w in shard.vocab if shard.idf[shard.vocab[w]] > 0)}
    state = docs.sparkSession.sparkContext.broadcast((dense, shard.idf[weighs], omega[weighs].astype(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, idf, om = state.value
        gram = np.zeros((len(idf), len(idf)), np.float32)
        base, size, held = 0, 0, ([], [])
        for b in slices(batches, 512):
            for text in utf8(b.column(0)):
                words = words_of(text)
                at, term = _hits(words, vocab)
                if len(at):
                    count = _count(len(words))
                    passage, term = _in_passages(at, term, count)
                    held[0].append(passage + base)
                    held[1].append(term)
                    base, size = base + count, size + len(term)
                if size > 16384:
                    _products(np.concatenate(held[0]), np.concatenate(held[1]), idf, gram)
                    base, size, held = 0, 0, ([], [])
        if size:
            _products(np.concatenate(held[0]), np.concatenate(held[1]), idf, gram)
        total = gram @ om + gram.T @ om - gram.diagonal()[:, None] * om
        del gram
        for k in range(_BLOCKS):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([total[k::_BLOCKS].tobytes()], pa.binary())], ["block", "sum"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                part = np.frombuffer(raw, np.float32)
                sums[k] = sums[k] + part if k in sums else part.astype(np.float64)
        for k, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([v.astype(np.float32).tobytes()], pa.binary())], ["block", "sum"])

    kind = "block int, sum binary"
    parts = docs.mapInArrow(run, kind).repartition(_BLOCKS, "block").mapInArrow(merge, kind).collect()  # terms x columns in all
    z, some = np.zeros(omega.shape), np.zeros((len(weighs), omega.shape[1]))
    for row in parts:
        some[row["block"] :: _BLOCKS] += np.frombuffer(row["sum"], np.float32).reshape(-1, omega.shape[1])
    z[weighs] = some
    return z


def _item_rows(shard: Shard) -> np.ndarray:
    a = np.zeros((len(shard.items), len(shard.vocab)))
    for i, item in enumerate(shard.items):
        term = np.array([shard.vocab[w] for w in item], dtype=np.int64)
        rare = term[shard.idf[term] > 0]
        if len(rare):
            _, _, t, w = _unit_rows(np.zeros(len(rare), np.int64), rare, shard.idf)
            a[i, t] = w
    return a


def _postings(shard: Shard, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The terms of the items by term, each with its share of the item's weight and its entry in the item's unit row."""
    term, item = np.nonzero(unit.T)
    weight = np.bincount(item, shard.idf[term], minlength=len(unit))
    start = np.concatenate(([0], np.cumsum(np.bincount(term, minlength=len(shard.vocab)))))
    return start, item, shard.idf[term] / weight[item], unit[item, term]


def _right_vectors(z: np.ndarray, omega: np.ndarray) -> np.ndarray:
    """The strongest right singular vectors of A from z = A'A omega alone (Nystrom): a column each, at most RANK."""
    value, vector = np.linalg.eigh((omega.T @ z + z.T @ omega) / 2)
    keep = value > 1e-6 * value[-1]  # what lies below is the rounding of z
    u, s, _ = np.linalg.svd(z @ (vector[:, keep] / np.sqrt(value[keep])), full_matrices=False)
    return u[:, : min(RANK, int((s > 1e-6 * s[0]).sum()))]


def groups_of(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[list[tuple[int, bytes]]]:
    """The distinct items of the benchmark, a group at a time. Null and empty items are never leaked."""
    items = benchmark.filter(F.col(text_col).rlike(r"[^\x20\x09-\x0D]")).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-size // GROUP_BYTES))
    for k in range(n):
        rows = items.filter(F.pmod(F.xxhash64("id"), F.lit(n)) == k).orderBy("id", "text").collect()
        if rows:
            yield [(r["id"], r["text"].encode()) for r in rows]


def _shards_of(rows: list[tuple[int, bytes]]) -> list[Shard]:
    parts: list[list[tuple[int, bytes]]] = [[]]
    seen: set[bytes] = set()
    for row in rows:
        own = set(words_of(row[1]))
        if parts[-1] and len(seen | own) > SHARD_TERMS:
            parts.append([])
            seen = set()
        parts[-1].append(row)
        seen |= own
    return [_make_shard(part) for part in parts]


def fit(docs: DataFrame, rows: list[tuple[int, bytes]], seed: int = 5) -> list[Shard]:
    """The latent spaces of a group of items over the documents (text)."""
    shards = _shards_of(rows)
    counts, total = _term_counts(docs, shards)
    for shard, c in zip(shards, counts):
        idf = np.log((1 + total) / (1 + np.minimum(c, total))) + 1
        shard.idf = np.where(c > max(COMMON * total, 8), 0.0, idf)
        for item in shard.items:  # of an item of common words the rarest count after all
            for term in sorted({shard.vocab[w] for w in item}, key=lambda t: (-idf[t], t))[:LEAST_TERMS]:
                shard.idf[term] = idf[term]
        if len(shard.vocab) > SHARD_TERMS:  # one item alone
            shard.idf[np.argsort(-shard.idf, kind="stable")[SHARD_TERMS:]] = 0.0
        items = _item_rows(shard)
        shard.postings = _postings(shard, items)
        omega = np.random.default_rng(seed).standard_normal((len(shard.vocab), min(len(shard.vocab), SKETCH)))
        shard.basis, shard.latent = latent_space(_range_pass(docs, shard, omega) + items.T @ (items @ omega), omega, items)
    return shards


def latent_space(z: np.ndarray, omega: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The basis (terms x dimensions) and the items' unit vectors in it."""
    basis = _right_vectors(z, omega)
    latent = items @ basis
    return basis.astype(np.float32), (latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def lcs_length(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence, a bit of an int for each word of a."""
    masks: dict[bytes, int] = {}
    for i, w in enumerate(a):
        masks[w] = masks.get(w, 0) | 1 << i
    every = (1 << len(a)) - 1
    v = every
    for w in b:
        m = v & masks.get(w, 0)
        v = ((v + m) | (v - m)) & every
    return len(a) - v.bit_count()


def _contains(words: list[bytes], part: list[bytes]) -> bool:
    n = len(part)
    return any(words[i] == part[0] and words[i : i + n] == part for i in range(len(words) - n + 1))


def _projected(row: np.ndarray, term: np.ndarray, weight: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The latent vectors of sparse rows, of unit length: the j-th entries of all rows at a time, longest rows first."""
    n = np.bincount(row)
    order = np.argsort(-n, kind="stable")
    first, y = (np.cumsum(n) - n)[order], np.zeros((len(n), basis.shape[1]), np.float32)
    for j in range(int(n[order[0]])):
        at = first[: np.count_nonzero(n > j)] + j
        y[: len(at)] += basis[term[at]] * weight[at, None]
    y /= np.maximum(np.sqrt(np.einsum("ij,ij->i", y, y)), 1e-9)[:, None]
    out = np.empty_like(y)
    out[order] = y
    return out


def _cosines(passage: np.ndarray, term: np.ndarray, idf: np.ndarray, shard: Shard) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, item, latent cosine) of all pairs with enough cosine, latent or plain, or whose passage holds enough of
    the item's weight."""
    found, row, t, w = _unit_rows(passage, term, idf)
    cos = _projected(row, t, w.astype(np.float32), shard.basis) @ shard.latent.T
    begin, items, shares, unit = shard.postings
    n = begin[t + 1] - begin[t]
    entry = np.repeat(begin[t] - np.cumsum(n) + n, n) + np.arange(n.sum())
    code = np.repeat(row, n) * cos.shape[1] + items[entry]
    held = np.bincount(code, shares[entry], minlength=cos.size)
    plain = np.bincount(code, unit[entry] * np.repeat(w, n), minlength=cos.size)
    p, i = np.nonzero((cos >= LATENT_COSINE) | ((held >= HELD) | (plain >= COSINE)).reshape(cos.shape))
    return found[p], i, cos[p, i]


def _verify(words: list[bytes], shards: list[Shard], candidates: list[tuple]) -> list[Leak]:
    """The candidates (shard, passages, items, cosines) of one text that the word checks confirm, the best of each item."""
    best: dict[int, Leak] = {}
    for s, passages, items, cosines in candidates:
        shard, done, wide = shards[s], -1, max(STRIDE, max(len(shards[s].bare[i]) for i in items))
        for p, i, c in zip(passages.tolist(), items.tolist(), cosines.tolist()):
            if p != done:  # in order of passage
                done, first = p, max(0, p * STRIDE - wide)
                around = [_bare(x) for x in words[first : p * STRIDE + PASSAGE + wide]]
            item, at, bag = shard.bare[i], shard.ids[i], shard.bags[i]
            margin = max(STRIDE, len(item))
            low = max(0, p * STRIDE - margin)
            part = around[low - first : p * STRIDE + PASSAGE + margin - first]
            if sum(map(bag.__getitem__, bag.keys() & part)) < LCS_WITH_ANSWER * len(item) - 1e-9:
                continue  # too few of its words for either check
            got = lcs_length(item, part)
            share = got / len(item)
            answer = share >= LCS_WITH_ANSWER and _contains(part, item[-ANSWER_WORDS:])
            row = (at, c, got, share, answer, low)
            if (share >= LCS_ALONE or answer) and (at not in best or (best[at][2], best[at][1]) < (got, c)):
                best[at] = row
    return [best[i] for i in sorted(best)]


def scan_state(shards: list[Shard]) -> tuple:
    """What a scan needs: the shards, and their weighing terms."""
    return shards, [_rare(s) for s in shards]


def find_all(texts: list[bytes | None], state: tuple) -> list[list[Leak]]:
    """The leaks of many texts; passages of several texts are projected together."""
    shards, rare = state
    out: list[list[Leak]] = [[] for _ in texts]
    held: list[tuple[int, list[bytes], int]] = []  # text, its words, its first passage
    parts: list[tuple[list, list]] = [([], []) for _ in shards]
    base = size = 0

    def close() -> None:
        starts = np.array([h[2] for h in held])
        found: dict[int, list[tuple]] = {}
        for s, (p, t) in enumerate(parts):
            if p:
                passage, item, cos = _cosines(np.concatenate(p), np.concatenate(t), rare[s][1], shards[s])
                which = np.searchsorted(starts, passage, side="right") - 1
                for w in np.unique(which).tolist():
                    at = which == w
                    found.setdefault(w, []).append((s, passage[at] - starts[w], item[at], cos[at]))
        for w, candidates in found.items():
            out[held[w][0]] = _verify(held[w][1], shards, candidates)

    for k, text in enumerate(texts):
        words = words_of(text)
        count, any_hit = _count(len(words)), False
        for (vocab, _), (p, t) in zip(rare, parts):
            at, term = _hits(words, vocab)
            if len(at):
                passage, term = _in_passages(at, term, count)
                p.append(passage + base)
                t.append(term)
                size, any_hit = size + len(term), True
        if any_hit:
            held.append((k, words, base))
            base += count
        if size > 16384:
            close()
            held, parts, base, size = [], [([], []) for _ in shards], 0, 0
    if held:
        close()
    return out


_SCHEMA = "doc_id long, item_id long, cosine double, lcs long, lcs_share double, answer_found boolean, word_start long"


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document and item that leaks into it. Null and empty texts hold no leak, repeated rows give their
    leaks each, items that share an id are one item, an empty benchmark or table gives no rows."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = None
    for rows in groups_of(benchmark):
        some = base.mapInArrow(_finder(base.sparkSession.sparkContext.broadcast(scan_state(fit(base.select("text"), rows)))), _SCHEMA)
        found = some if found is None else found.unionByName(some)
    return base.sparkSession.createDataFrame([], _SCHEMA) if found is None else found


def _finder(state):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 512):
            rows = [(d, *hit) for d, found in zip(b.column(0).to_pylist(), find_all(utf8(b.column(1)), state.value)) for hit in found]
            cols = list(zip(*rows)) if rows else [[]] * 7
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.bool_(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [x.split()[0] for x in _SCHEMA.split(", ")])

    return run


def remove_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no leak, with all their columns, decided inside the scan. Null and empty texts stay,
    repeated rows share their fate, an empty benchmark or table changes nothing."""
    at, texts = docs.columns.index(text_col), docs.select(F.col(text_col).cast("string").alias("text"))
    for rows in groups_of(benchmark):
        docs = docs.mapInArrow(_remover(docs.sparkSession.sparkContext.broadcast(scan_state(fit(texts, rows))), at), docs.schema)
    return docs


def _remover(state, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 512):
            yield b.filter(pa.array([not found for found in find_all(utf8(b.column(at)), state.value)]))

    return run

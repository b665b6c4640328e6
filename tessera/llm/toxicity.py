"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are lower-case words and their first five bytes. All terms of a bounded sample of labelled documents (`examples`)
are kept; their document frequencies are counted over all documents. Each example is a vector of tf-idf weights.

The index keeps, for every term, the weights of the examples that have it (its posting list) and the largest weight in
each block of examples; examples are dealt to blocks of like ones. Lists of many examples are stored as dense rows.
Documents are searched together: the short lists are added up; the largest such sum of a block and the block maxima of
the long lists bound the cosines of the block. The blocks of the largest bounds are visited, then all whose bound
reaches the k-th cosine: the result is exact. Terms of no example don't count in a document's length, which scales all
its cosines alike.

The k nearest, with all that are as near as the k-th, vote with their cosines, so that no order decides; a logistic
curve fitted on leave-one-out votes turns votes into probabilities. The voters are returned as evidence.

A text without any term of an example (an empty or null one too) has no neighbour and gets the share of toxic documents
among such examples. Without labels every score is 0.5. Repeated rows get equal scores; an empty table gives an empty
table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import labelled, store
from .text import LOWER, Sums, Table, chunks, column, gather, lists, trimmed

BLOCK = 64
#: Documents that are searched together.
ROWS = 256
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def terms_of(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of the rows and of their first five bytes, and the row of each."""
    if not len(buf):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    low = LOWER[buf]
    word, head = _LETTER[low], np.zeros(len(buf) + 1, bool)
    head[offs] = True
    starts = np.flatnonzero(word & (np.concatenate(([True], ~word[:-1])) | head[:-1]))
    ends = np.flatnonzero(word & (np.concatenate((~word[1:], [True])) | head[1:])) + 1
    rows = np.searchsorted(offs, starts, "right") - 1
    long = ends - starts > 5
    sums = Sums(low)
    return np.concatenate((sums.hashes(starts, ends), sums.hashes(starts[long], starts[long] + 5, 5))), np.concatenate((rows, rows[long]))


def like_order(z: np.ndarray) -> np.ndarray:
    """An order of the rows of z in which blocks of BLOCK rows are alike: halves along the widest direction, and so on."""
    done, todo = [], [np.arange(len(z))]
    while todo:
        part = todo.pop()
        if len(part) <= BLOCK:
            done.append(part)
            continue
        x = z[part] - z[part].mean(axis=0)
        order = np.argsort(x @ np.linalg.eigh(x.T @ x)[1][:, -1], kind="stable")
        half = -(-len(part) // BLOCK // 2) * BLOCK
        todo += [part[order[half:]], part[order[:half]]]
    return np.concatenate(done) if done else np.zeros(0, np.int64)


class Postings:
    """Weights of terms in examples: lists by term, the longest ones (at most `most`, each longer than a block) as rows of
    a dense matrix with their largest weights by block."""

    def __init__(self, terms: int, examples: int, t: np.ndarray, col: np.ndarray, w: np.ndarray, most: int = 1280):
        order = np.argsort(t.astype(np.int64) * max(1, examples) + col)
        t, col, w = t[order], col[order].astype(np.int32), w[order]
        del order
        n = np.bincount(t, minlength=terms)
        short = max(BLOCK, int(np.partition(n, len(n) - most - 1)[len(n) - most - 1])) if len(n) > most else BLOCK
        self.blocks = -(-examples // BLOCK)
        self.width = self.blocks * BLOCK
        self.row = np.full(terms, -1, np.int64)
        self.row[n > short] = np.arange(int((n > short).sum()))
        long = self.row[t] >= 0
        self.dense = np.zeros((int((n > short).sum()), self.width), np.float32)
        self.dense[self.row[t[long]], col[long]] = w[long]
        self.top = self.dense.reshape(len(self.dense), self.blocks, BLOCK).max(axis=2) if self.blocks else np.zeros((0, 0), np.float32)
        self.col, self.w = col[~long], w[~long]
        self.offs = np.concatenate(([0], np.cumsum(np.where(n > short, 0, n))))

    def nearest(self, rows: np.ndarray, term: np.ndarray, w: np.ndarray, n: int, k: int, leave: np.ndarray | None = None) -> np.ndarray:
        """Cosines of n documents (row, term and weight of their entries) with all examples: those of the k nearest and of
        all that are as near are exact, others may be too small. leave: an example of each document that doesn't count."""
        row = self.row[term]
        x = np.zeros((n, len(self.dense)), np.float32)
        x[rows[row >= 0], row[row >= 0]] = w[row >= 0]
        at, ends = gather(term[row < 0], self.offs)
        own = np.diff(ends)
        flat = np.bincount(np.repeat(rows[row < 0], own) * self.width + self.col[at], weights=np.repeat(w[row < 0], own) * self.w[at], minlength=n * self.width)
        cos = flat.astype(np.float32).reshape(n, self.blocks, BLOCK)
        if leave is not None:
            # An example left out starts below any cosine.
            cos.reshape(n, -1)[np.arange(n), leave] = -2
        bounds = np.maximum(cos.max(axis=2), 0) + x @ self.top
        done = np.zeros(bounds.shape, bool)
        first = np.argpartition(-bounds, min(8, self.blocks) - 1, axis=1)[:, :8]
        np.put_along_axis(done, first, True, axis=1)
        for b in np.flatnonzero(done.any(axis=0)).tolist():
            r = np.flatnonzero(done[:, b])
            cos[r, b] += x[r] @ self.dense[:, b * BLOCK : (b + 1) * BLOCK]
        seen = np.take_along_axis(cos, first[:, :, None], axis=1).reshape(n, -1)
        kth = np.partition(seen, seen.shape[1] - k, axis=1)[:, seen.shape[1] - k] if k < seen.shape[1] else np.zeros(n, np.float32)
        wanted = (bounds + 1e-4 >= kth[:, None]) & (bounds > 0)
        for b in range(0, self.blocks, 8):
            todo = wanted[:, b : b + 8] & ~done[:, b : b + 8]
            r = np.flatnonzero(todo.any(axis=1))
            if not len(r):
                continue
            every = len(r) > 0.9 * n
            r = np.arange(n) if every else r
            more = ((x if every else x[r]) @ self.dense[:, b * BLOCK : (b + 8) * BLOCK]).reshape(len(r), -1, BLOCK)
            fresh = ~done[r, b : b + 8]
            more *= fresh[:, :, None]
            if every:
                cos[:, b : b + 8] += more
            else:
                cos[r, b : b + 8] += more
            done[r, b : b + 8] = True
        cos *= done[:, :, None]
        return cos.reshape(n, -1)


@dataclass
class Index:
    """Weights of the terms in the examples, and what turns votes into scores."""

    keys: np.ndarray
    idf: np.ndarray
    ids: np.ndarray
    y: np.ndarray
    weights: Postings
    prior: float
    none: float
    slope: float = 1.0
    shift: float = 0.0
    k: int = 16

    def __post_init__(self) -> None:
        self.table = Table(self.keys)

    def vectors(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, term and unit-length weight of the entries of each row, by row and term."""
        h, rows = terms_of(buf, offs)
        hit, at = self.table.find(h)
        pair, n = np.unique(rows[hit] * max(1, len(self.keys)) + at, return_counts=True)
        row, term = np.divmod(pair, max(1, len(self.keys)))
        w = (1 + np.log(n)) * self.idf[term]
        norm = np.sqrt(np.bincount(row, weights=w * w, minlength=len(offs) - 1))
        return row, term, (w / np.maximum(norm[row], 1e-12)).astype(np.float32)

    def votes(self, row: np.ndarray, term: np.ndarray, w: np.ndarray, n: int, leave: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For n documents the votes (nan: without a neighbour) and, by document, its neighbours and their cosines, the
        nearest first: the k nearest and all as near as the last of them."""
        if not len(self.ids) or not n:
            z = np.zeros(0, np.int64)
            return np.full(n, np.nan), z, np.zeros(0, np.float32), np.zeros(n + 1, np.int64)
        cos = self.weights.nearest(row, term, w, n, self.k, leave)
        kth = np.partition(cos, cos.shape[1] - self.k, axis=1)[:, cos.shape[1] - self.k] if self.k < cos.shape[1] else np.zeros(n, np.float32)
        r, i = np.nonzero((cos >= kth[:, None] - 1e-6) & (cos > 1e-6))
        c = cos[r, i]
        order = np.lexsort((self.ids[i], -c, r))
        r, i, c = r[order], i[order], c[order]
        total = np.bincount(r, weights=c, minlength=n)
        vote = (np.bincount(r, weights=c * self.y[i], minlength=n) + 0.5 * self.prior) / (total + 0.5)
        return np.where(total > 0, vote, np.nan), i, c, np.searchsorted(r, np.arange(n + 1))

    def scores(self, vote: np.ndarray) -> np.ndarray:
        live = ~np.isnan(vote)
        safe = np.where(live, vote, 0.5)
        return np.where(live, 1 / (1 + np.exp(-(self.slope * np.log(safe / (1 - safe)) + self.shift))), self.none)


def fit(docs: DataFrame, labels: DataFrame, *, column_name: str = "toxic", mod: int = 4, rest: int = 2, examples: int = 5000, k: int = 16) -> Index:
    """The index of at most `examples` labelled rows and all their terms; nothing larger reaches the driver."""
    spark = docs.sparkSession
    rows = store.saved(labelled.sample(docs, labels, column_name, mod, rest, examples), "labelled")

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(terms_of(*column(batch))[0]).view(np.int64))], ["term"])

    n, pos = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    prior = (pos + 1) / (n + 2)
    keys = np.sort(rows.select("text").mapInArrow(trimmed(distinct), "term long").distinct().toArrow().column(0).to_numpy().view(np.uint64))

    table = Table(keys)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, total = np.zeros(len(keys), np.int64), 0
        for batch in batches:
            buf, offs = column(batch)
            total += batch.num_rows
            for i, j in chunks(offs, 1 << 19):
                h, r = terms_of(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                hit, at = table.find(h)
                if len(at):
                    df += np.bincount(np.unique(r[hit] * len(keys) + at) % len(keys), minlength=len(keys))
        met = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(met, -1), pa.int32()), pa.array(np.append(df[met], total))], ["i", "n"])

    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(trimmed(partial), "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(len(keys) + 1, np.int64)
    df[found.column(0).to_numpy()] = found.column(1).to_numpy()
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1
    index = Index(keys, idf, np.zeros(0, np.int64), np.zeros(0), Postings(0, 0, *np.zeros((3, 0), np.int64)), prior, prior, k=k)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, t, w = index.vectors(*column(batch))
            cut = np.searchsorted(row, np.arange(batch.num_rows + 1)).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array([x[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary()) for x in (t.astype(np.int32), w))], ["doc_id", "y", "t", "w"])

    got = rows.select("doc_id", "text", "y").mapInArrow(trimmed(vectors), "doc_id long, y int, t binary, w binary").toArrow().sort_by("doc_id")
    ids, y = got["doc_id"].to_numpy(), got["y"].to_numpy().astype(np.float64)
    sizes = np.array([len(x) // 4 for x in got["w"].to_pylist()], np.int64)
    terms, weights = (np.frombuffer(b"".join(got[c].to_pylist()), k) for c, k in (("t", np.int32), ("w", np.float32)))
    del got
    index.none = (float(y[sizes == 0].sum()) + prior) / (int((sizes == 0).sum()) + 1)
    store.drop(rows)
    if not len(terms):
        return index
    # A few random directions tell which examples are alike.
    live = np.flatnonzero(sizes)
    starts = np.concatenate(([0], np.cumsum(sizes[live])))
    rng = np.random.default_rng(9)
    z = np.stack([np.add.reduceat(rng.normal(size=len(keys)).astype(np.float32)[terms] * weights, starts[:-1]) for _ in range(16)], axis=1)
    order = like_order(z)
    at, starts = gather(order, starts)
    terms, weights = terms[at], weights[at]
    index.ids, index.y = ids[live][order], y[live][order]
    del at, z
    index.weights = Postings(len(keys), len(order), terms, np.repeat(np.arange(len(order), dtype=np.int32), np.diff(starts)), weights)
    # Leave-one-out votes of up to 2000 examples calibrate the score.
    picked = np.arange(0, len(order), max(1, len(order) // 2000))
    votes = []
    for part in np.array_split(picked, -(-len(picked) // ROWS)):
        at, ends = gather(part, starts)
        votes.append(index.votes(np.repeat(np.arange(len(part)), np.diff(ends)), terms[at], weights[at], len(part), part)[0])
    vote = np.concatenate(votes)
    live = ~np.isnan(vote)
    x, t = np.log(vote[live] / (1 - vote[live])), index.y[picked][live]
    if 0 < t.sum() < len(t):
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-(a * x + b)))
            s = p * (1 - p) + 1e-6
            g = np.array([((p - t) * x).sum() + 1e-2 * (a - 1), (p - t).sum() + 1e-2 * b])
            hess = np.array([[(s * x * x).sum() + 1e-2, (s * x).sum()], [(s * x).sum(), s.sum() + 1e-2]])
            d = np.linalg.solve(hess, g)
            a, b = a - d[0], b - d[1]
            if abs(d).max() < 1e-8:
                break
        index.slope, index.shift = float(max(a, 1e-3)), float(b)
    return index


def score(docs: DataFrame, index: Index) -> DataFrame:
    """doc_id, score, nearest (doc_ids of the examples that vote, the nearest first) and their cosines of every row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = column(batch)
            for i, j in chunks(offs, 1 << 19):
                row, term, w = index.vectors(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                for a in range(0, j - i, ROWS):
                    n = min(ROWS, j - i - a)
                    lo, hi = np.searchsorted(row, (a, a + n))
                    vote, near, c, cut = index.votes(row[lo:hi] - a, term[lo:hi], w[lo:hi], n)
                    found = index.ids[near] if len(near) else near
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i + a, n), pa.array(index.scores(vote)), lists(found, cut, pa.int64()), lists(c, cut, pa.float32())], ["doc_id", "score", "nearest", "cosines"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(trimmed(rows), "doc_id long, score double, nearest array<long>, cosines array<float>")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = store.table(spark, sf_dir, "documents")
    got = score(docs, fit(docs, store.table(spark, sf_dir, "labels")))
    return got.select("doc_id", labelled.held_out(4, 2).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).cast("int").alias("predicted"), "nearest", "cosines")

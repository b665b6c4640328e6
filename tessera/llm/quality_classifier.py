"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer numpy network.

Every bucket of word hashes and of *shapes* (a word with its letters folded to A, a, 0, runs shortened: `THE!!` is
`A!`) has a fixed sparse ternary index vector. A word's vector is its own index vector plus the normalised sum of the
index vectors beside it in the sample (random indexing). A document is the mean of its word vectors, the mean of its
shape vectors, the shares of words equal to the word before and to one of the eight before, and the log of its length.
The network (one hidden layer, then a sigmoid) is trained on a bounded sample of labelled rows (`examples`), a fifth of
which sets the temperature of its logits. The executors sum the contexts and pool the vectors of the sample, over whole
texts; the driver gets one short vector a row. Scoring reads whole texts too.

An empty or null text has zero vectors and gets a score like any other. Without two classes of labels every score is
the share of label 1 (0.5 without labels). Repeated rows get equal scores; an empty table gives an empty table; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import labelled, store
from .sums import summed
from .text import LOWER, chunks, column, hash_spans, trimmed, word_spans

BUCKETS, DIM = 1 << 13, 48
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[0x30:0x3A] = 0x30
_CLASS[0x41:0x5B] = 0x41
_CLASS[0x61:0x7B] = 0x61
_CLASS[0x80:] = 0x61


def index_vectors(seed: int = 11) -> np.ndarray:
    """Sparse ternary vectors: six of the DIM entries are +1 or -1."""
    rng = np.random.default_rng(seed)
    out = np.zeros((BUCKETS, DIM), np.float32)
    at = rng.permuted(np.tile(np.arange(DIM), (BUCKETS, 1)), axis=1)[:, :6]
    np.put_along_axis(out, at, rng.choice(np.array([-1, 1], np.float32), (BUCKETS, 6)), axis=1)
    return out


def units(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets, shape buckets, word hashes and word offsets of the rows."""
    low = LOWER[buf]
    starts, ends, woffs = word_spans(low, offs)
    words = hash_spans(low, starts, ends)
    cls = _CLASS[buf]
    new = np.ones(len(buf) + 1, bool)
    new[1:-1] = cls[1:] != cls[:-1]
    new[starts] = True
    short = np.flatnonzero(new[:-1])
    s, e = np.searchsorted(short, starts), np.searchsorted(short, ends)
    shapes = hash_spans(cls[short], s, e, seed=3)
    return (words % BUCKETS).astype(np.int64), (shapes % BUCKETS).astype(np.int64), words, woffs


def _means(rows: np.ndarray, woffs: np.ndarray) -> np.ndarray:
    out = np.zeros((len(woffs) - 1, rows.shape[1]), np.float32)
    live = np.flatnonzero(np.diff(woffs))
    if len(live):
        out[live] = np.add.reduceat(rows, woffs[live], axis=0) / np.diff(woffs)[live][:, None]
    return out


def pool(buf: np.ndarray, offs: np.ndarray, words: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    """The document vectors of the rows."""
    w, s, h, woffs = units(buf, offs)
    row = np.repeat(np.arange(len(woffs) - 1), np.diff(woffs))
    flags = np.zeros((len(h), 2), np.float32)
    for back in range(1, 9):
        same = (h[back:] == h[:-back]) & (row[back:] == row[:-back])
        if back == 1:
            flags[back:, 0] = same
        flags[back:, 1] = np.maximum(flags[back:, 1], same)
    # Few words at a time: a vector a word is wide.
    out = []
    for i, j in chunks(woffs, 1 << 17):
        a, b = woffs[i], woffs[j]
        o = woffs[i : j + 1] - a
        out.append(np.hstack([_means(words[w[a:b]], o), _means(shapes[s[a:b]], o), 4 * _means(flags[a:b], o), np.log1p(np.diff(o))[:, None] / 8]).astype(np.float32))
    return np.vstack(out) if out else np.zeros((0, 2 * DIM + 3), np.float32)


@dataclass
class Model:
    words: np.ndarray
    shapes: np.ndarray
    layers: list[np.ndarray]
    mean: np.ndarray
    spread: np.ndarray
    temperature: float
    constant: float | None = None

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.layers
        return np.tanh(((x - self.mean) / self.spread) @ a + b) @ c + d[0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x).astype(np.float64) / self.temperature, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, *, hidden: int = 24, epochs: int = 60, seed: int = 5) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, float]:
    """Adam on the log loss of four fifths of the rows; the temperature is fitted on the rest."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    kept, tune = order[len(x) // 5 :], order[: len(x) // 5]
    mean, spread = x[kept].mean(axis=0), x[kept].std(axis=0) + 0.05
    z = (x - mean) / spread
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    m, v, t = [0 * q for q in p], [0 * q for q in p], 0
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(kept), max(1, len(kept) // 128)):
            h = np.tanh(z[part] @ p[0] + p[1])
            e = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3][0], -30, 30))) - y[part]) / len(part)
            back = np.outer(e, p[2]) * (1 - h * h)
            grads = [z[part].T @ back + 1e-3 * p[0], back.sum(axis=0), h.T @ e + 1e-3 * p[2], np.array([e.sum()])]
            t += 1
            for i, g in enumerate(grads):
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - 0.004 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    logit = np.tanh(z[tune] @ p[0] + p[1]) @ p[2] + p[3][0]
    grid = np.exp(np.linspace(np.log(0.3), np.log(6), 60))
    loss = [np.mean(np.logaddexp(0, np.where(y[tune] > 0, -logit, logit) / g)) for g in grid] if len(tune) else [0.0] * 60
    return p, mean, spread, float(grid[int(np.argmin(loss))])


def contexts(rows: DataFrame) -> np.ndarray:
    """For every bucket of words the sum of the index vectors of the two words on either side, over whole texts."""
    base = index_vectors()

    def add(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        near = np.zeros((BUCKETS, DIM), np.float32)
        for batch in batches:
            buf, offs = column(batch)
            for i, j in chunks(offs, 1 << 19):
                w, _, _, woffs = units(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                row = np.repeat(np.arange(len(woffs) - 1), np.diff(woffs))
                for back in (1, 2):
                    ok = np.flatnonzero(row[back:] == row[:-back])
                    for one, other in ((ok + back, ok), (ok, ok + back)):
                        order = np.argsort(w[one], kind="stable")
                        own = w[one[order]]
                        cut = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else own
                        for k in range(0, len(order), 1 << 17):
                            some = cut[(cut > k) & (cut < k + (1 << 17))]
                            starts = np.concatenate(([k], some))
                            near[own[starts]] += np.add.reduceat(base[w[other[order[k : k + (1 << 17)]]]], starts - k, axis=0)
        return dict(enumerate(np.array_split(near, 8)))

    got = summed(rows.select("text"), add, np.float32)
    return np.concatenate([got[k] for k in sorted(got)]).reshape(BUCKETS, DIM) if got else np.zeros((BUCKETS, DIM), np.float32)


def fit(docs: DataFrame, labels: DataFrame, *, column_name: str = "quality", mod: int = 5, rest: int = 0, examples: int = 6000) -> Model:
    """A model of at most `examples` labelled rows."""
    rows = store.saved(labelled.sample(docs, labels, column_name, mod, rest, examples), "labelled")
    near, shapes = contexts(rows), index_vectors(12)
    words = (index_vectors() + near / np.maximum(1e-6, np.linalg.norm(near, axis=1, keepdims=True))).astype(np.float32)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = column(batch)
            for i, j in chunks(offs, 1 << 19):
                x = pool(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], words, shapes)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array([v.tobytes() for v in x], pa.binary())], ["doc_id", "y", "x"])

    got = rows.select("doc_id", "text", "y").mapInArrow(trimmed(vectors), "doc_id long, y int, x binary").toArrow().sort_by("doc_id")
    store.drop(rows)
    y = got["y"].to_numpy().astype(np.float64)
    model = Model(words, shapes, [], np.zeros(1), np.ones(1), 1.0)
    if len(y) < 20 or y.min() == y.max():
        model.constant = float((y.sum() + 0.5) / (len(y) + 1))
        return model
    x = np.frombuffer(b"".join(got["x"].to_pylist()), np.float32).reshape(len(y), -1)
    model.layers, model.mean, model.spread, model.temperature = train(x.astype(np.float64), y)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = column(batch)
            for i, j in chunks(offs, 1 << 21):
                x = pool(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], model.words, model.shapes)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(model.scores(x))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(trimmed(rows), "doc_id long, score double")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = store.table(spark, sf_dir, "documents")
    got = score(docs, fit(docs, store.table(spark, sf_dir, "labels")))
    return got.select("doc_id", labelled.held_out(5, 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).cast("int").alias("predicted"))

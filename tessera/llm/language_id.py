"""Language of web pages by Bayesian fusion of text, declared markup language, address suffix and host priors.

* Text: hashed byte trigrams of the main text under one multinomial for every language of the documents, trained on a
  bounded sample of each (`per_language`: at most so many rows times the languages, with their whole texts); the log-likelihood is tempered (`temper`), as trigrams overlap.
* Declared: `<html lang>` names the true language with probability `trust`, any other with the rest.
* Priors: soft counts of the first two per address suffix, domain and host, by grouped aggregation. Each level is
  smoothed towards the one above (Dirichlet weight `weight`), and a page's own counts are taken out of its priors.

The posterior is the normalised product. A null or empty page has the evidence of its address alone; a null or odd
address has the prior of all pages. Ties go to the first language by name. Repeated rows are rows like others; an empty
table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import markup, store
from .sums import summed
from .text import LOWER, chunks, column, mix, trimmed

BUCKETS = 1 << 14


def trigrams(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams (letters in lower case, digits and points as spaces) and their rows."""
    if len(buf) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = LOWER[buf]
    low = np.where((low >= 0x61) & (low <= 0x7A) | (low >= 0x80), low, np.uint8(0x20)).astype(np.uint64)
    g = (mix(low[:-2] | low[1:-1] << np.uint64(8) | low[2:] << np.uint64(16)) % np.uint64(BUCKETS)).astype(np.int64)
    row = np.searchsorted(offs, np.arange(len(g)), "right") - 1
    ok = np.arange(len(g)) + 3 <= offs[row + 1]
    return g[ok], row[ok]


def train(docs: DataFrame, *, per_language: int = 400) -> tuple[list[str], np.ndarray]:
    """All languages, by name, and their log-probabilities of trigram buckets, from whole texts of at most `per_language`
    documents of each, chosen by hash."""
    known = docs.where("lang is not null and text is not null and doc_id is not null").select("lang", F.col("doc_id").cast("long").alias("doc_id"), "text")
    # The limit of each language is applied before the rows are dealt by language.
    w = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    picked = known.select("lang", "doc_id").withColumn("r", F.row_number().over(w)).where(F.col("r") <= per_language).select("lang", "doc_id").distinct()
    texts = store.saved(known.join(picked, ["lang", "doc_id"], "left_semi").select("text", "lang"), "language-sample")
    names = sorted(r.lang for r in texts.select("lang").distinct().collect())
    number = {x: i for i, x in enumerate(names)}

    def count(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            buf, offs = column(batch)
            lang = np.array([number[x] for x in batch.column(1).to_pylist()], np.int64)
            for i, j in chunks(offs, 1 << 21):
                g, row = trigrams(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                own = lang[i:j][row]
                for k in np.unique(own).tolist():
                    total[k] = total.get(k, 0) + np.bincount(g[own == k], minlength=BUCKETS)
        return total

    counts = np.zeros((len(names), BUCKETS))
    for k, n in (summed(texts, count, np.int64, max(8, len(names))) if names else {}).items():
        counts[k] = n
    store.drop(texts)
    return names, np.log((counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True)).astype(np.float32)


def evidence(pages: DataFrame, names: list[str], logp: np.ndarray, *, trust: float, temper: float) -> DataFrame:
    """page_id, host, domain, suffix, declared, text (log-likelihoods) and first (posterior of text and declared)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages_ = batch.column(1).to_pylist()
            said = [markup.declared_language(p) for p in pages_]
            texts = pa.record_batch([pa.array([markup.plain(p, main_only=True) for p in pages_], pa.large_string())], ["text"])
            buf, offs = column(texts)
            like = np.zeros((len(pages_), len(names)))
            known = {x: i for i, x in enumerate(names)}
            for i, j in chunks(offs, 1 << 21):
                g, row = trigrams(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                for k in range(len(names)):
                    like[i:j, k] = np.bincount(row, weights=logp[k][g], minlength=j - i)
            like = temper * (like - like.max(axis=1, keepdims=True)) if len(names) else like
            markup_like = np.zeros(like.shape)
            for r, s in enumerate(said):
                if s in known:
                    markup_like[r] = np.log((1 - trust) / max(1, len(names) - 1))
                    markup_like[r, known[s]] = np.log(trust)
            both = like + markup_like
            both = np.exp(both - both.max(axis=1, keepdims=True)) if len(names) else both
            first = both / both.sum(axis=1, keepdims=True) if len(names) else both
            doubles = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(said, pa.string()), pa.array(like.tolist(), doubles), pa.array(markup_like.tolist(), doubles), pa.array(first.tolist(), doubles)], ["page_id", "host", "declared", "like", "said", "first"])

    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    made = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html"), host.alias("host")).mapInArrow(trimmed(rows), "page_id long, host string, declared string, like array<double>, said array<double>, first array<double>")
    return made.withColumn("suffix", F.substring_index("host", ".", -1)).withColumn("domain", F.substring_index("host", ".", -2))


def _sums(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.sum(F.col("first")[k]).alias(f"c{k}") for k in range(n)]).select(*keys, F.array(*[f"c{k}" for k in range(n)]).alias("c"))


def _smooth(own: Column, above: Column, n: int, weight: float) -> Column:
    total = sum((own[k] for k in range(1, n)), own[0])
    return F.array(*[(own[k] + weight * above[k]) / (total + weight) for k in range(n)])


def identify(pages: DataFrame, docs: DataFrame, *, trust: float = 0.9, temper: float = 0.05, weight: float = 4.0) -> DataFrame:
    """page_id, host, lang, confidence, declared, text_lang (by text alone), prior_lang (by host) of every page."""
    names, logp = train(docs)
    n = len(names)
    if not n:
        return pages.select(F.col("page_id").cast("long").alias("page_id"), *[F.lit(None).cast(t).alias(c) for c, t in (("host", "string"), ("lang", "string"), ("confidence", "double"), ("declared", "string"), ("text_lang", "string"), ("prior_lang", "string"))])
    rows = store.saved(evidence(pages, names, logp, trust=trust, temper=temper), "language-evidence")
    hosts = store.saved(_sums(rows, ["suffix", "domain", "host"], n), "language-hosts")
    again = lambda keys: hosts.groupBy(*keys).agg(*[F.sum(F.col("c")[k]).alias(f"c{k}") for k in range(n)]).select(*keys, F.array(*[f"c{k}" for k in range(n)]).alias("up"))
    every = hosts.agg(*[F.coalesce(F.sum(F.col("c")[k]), F.lit(0.0)).alias(f"c{k}") for k in range(n)]).first()
    base = F.array(*[F.lit((x + 1) / (sum(every) + n)) for x in every])
    suffixes = again(["suffix"]).withColumnRenamed("up", "c_suffix")
    domains = again(["suffix", "domain"]).withColumnRenamed("up", "c_domain")
    tree = hosts.join(domains, ["suffix", "domain"]).join(suffixes, "suffix").select("host", F.col("c").alias("c_host"), "c_domain", "c_suffix")
    met = rows.join(tree, "host")
    less = lambda c: F.array(*[F.greatest(F.lit(0.0), F.col(c)[k] - F.col("first")[k]) for k in range(n)])
    for level, above in (("suffix", base), ("domain", F.col("p_suffix")), ("host", F.col("p_domain"))):
        met = met.withColumn(f"own_{level}", less(f"c_{level}"))
        met = met.withColumn(f"p_{level}", _smooth(F.col(f"own_{level}"), above, n, weight))
    logs = met.withColumn("z", F.array(*[F.col("like")[k] + F.col("said")[k] + F.log(F.col("p_host")[k]) for k in range(n)]))
    top = F.array_max("z")
    lang = F.array(*[F.lit(x) for x in names])
    pick = lambda c: F.element_at(lang, F.array_position(c, F.array_max(c)).cast("int"))
    total = sum((F.exp(F.col("z")[k] - top) for k in range(1, n)), F.exp(F.col("z")[0] - top))
    return logs.select("page_id", "host", pick(F.col("z")).alias("lang"), (1 / total).alias("confidence"), "declared", pick(F.col("like")).alias("text_lang"), pick(F.col("p_host")).alias("prior_lang"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(store.table(spark, sf_dir, "pages"), store.table(spark, sf_dir, "documents"))

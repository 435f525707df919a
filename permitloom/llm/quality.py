"""Quality by hierarchical empirical Bayes: a document's evidence on top of its site's record.

1. A logistic regression on the shares of character classes and on word statistics is
   fitted on at most ``SAMPLE`` labelled keys (in order of a hash of the key), one text of each.
   Its log odds without the sample's prior are the document's evidence, computed once
   for each document and written.
2. Each host, and each path of it, sums up the probabilities of its documents (grouped
   aggregation over all documents).  The global rate is the prior of a host's, and the
   host's rate the prior of its paths'; each prior counts as many documents as the spread
   between the groups suggests (method of moments), so sparse sites are shrunk and rich
   ones speak for themselves.
3. A document's prior odds are those of its path without the document itself; together
   with the evidence they give its probability.

Host and path are columns that the caller names: ``url_site`` gives both for a URL; the
documents' table has none, so there a document's ``source`` is its host and its ``lang`` the
section of it that it comes from.

Null and empty texts are documents without any character and are judged like others.  A long
text is read whole, by itself if beyond 2 MB.  A null host has no record of its own, so the
global rate is the prior; with a null path, the host's.  Without labels of both kinds the
evidence is 0 and the rate 1/2.  Repeated keys in the labels count once (the lowest label), and
of several documents of a labelled key one teaches (that with the smallest hash of its text);
all are judged, each row by itself.  A probability equal to the threshold is kept.  An empty
table gives an empty result.  Columns of the output's names are replaced, others are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from permitloom.llm.common import byte_slices, coded, split_words, string, written

SAMPLE = 20_000
#: Classes of bytes: each ASCII punctuation mark by itself, then digits, upper and lower case, newline, other white space, others.
_MARKS = [c for c in range(33, 127) if not chr(c).isalnum()]
_CLASSES = len(_MARKS) + 6
_CLASS = np.full(256, _CLASSES - 1, np.uint8)
for _k, _c in enumerate(_MARKS):
    _CLASS[_c] = _k
_CLASS[48:58] = len(_MARKS)
_CLASS[65:91] = len(_MARKS) + 1
_CLASS[97:123] = len(_MARKS) + 2
_CLASS[10] = len(_MARKS) + 3
_CLASS[[9, 11, 12, 13, 32]] = len(_MARKS) + 4


def features(texts: pa.Array) -> np.ndarray:
    """A row per text: root shares of byte classes, logs of the numbers of words and of distinct ones, word length."""
    texts = pc.fill_null(texts, "")
    n = len(texts)
    sizes = np.asarray(pc.binary_length(texts), dtype=np.int64)
    data = np.frombuffer("".join(texts.to_pylist()).encode(), np.uint8)
    found, ends = np.zeros(n * _CLASSES, np.int64), np.cumsum(sizes)
    for start in range(0, len(data), 4 << 20):
        part = data[start : start + (4 << 20)]
        owner = np.searchsorted(ends, np.arange(start, start + len(part)), side="right")
        found += np.bincount(owner * _CLASSES + _CLASS[part], minlength=n * _CLASSES)
    shares = found.reshape(n, _CLASSES) / np.maximum(sizes, 1)[:, None]
    offsets, words = split_words(texts)
    codes, distinct = coded(words)
    counts = np.diff(offsets)
    owner = np.repeat(np.arange(n), counts)
    pairs, times = np.unique(owner * max(1, len(distinct)) + codes, return_counts=True)
    of = pairs // max(1, len(distinct))
    different = np.bincount(of, minlength=n)
    most = np.zeros(n)
    np.maximum.at(most, of, times)
    length = sizes / np.maximum(counts, 1)
    words_log, different_log = np.log1p(counts), np.log1p(different)
    return np.column_stack([np.sqrt(shares), words_log, different_log, words_log - different_log, (words_log - different_log) ** 2, most / np.maximum(counts, 1), np.log1p(length)])


@dataclass
class Classifier:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    offset: float
    rate: float

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> Classifier:
        """Logistic regression by Newton steps; the log odds of the sample's rate are taken off."""
        if not len(y) or y.min() == y.max():
            return Classifier(np.zeros(x.shape[1]), np.ones(x.shape[1]), np.zeros(x.shape[1]), 0.0, 0.5)
        mean, scale = x.mean(0), x.std(0)
        scale = np.where(scale > 1e-9, scale, 1.0)
        z = np.column_stack([np.clip((x - mean) / scale, -8, 8), np.ones(len(x))])
        w, ridge = np.zeros(z.shape[1]), np.full(z.shape[1], penalty)
        ridge[-1] = 1e-6
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            gradient = z.T @ (y - p) - ridge * w
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), gradient)
            w += step * min(1.0, 4 / np.abs(step).max())
            if np.abs(step).max() < 1e-6:
                break
        rate = float(y.mean())
        return Classifier(mean, scale, w[:-1], float(w[-1] - np.log(rate / (1 - rate))), rate)

    def evidence(self, x: np.ndarray) -> np.ndarray:
        """Log likelihood ratio of good against bad, up to 20 either way."""
        return np.clip(np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights + self.offset, -20, 20)


def fit(df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality") -> Classifier:
    """A classifier from a bounded sample of the labelled rows."""
    chosen = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min(label).alias("y"))
    # At most SAMPLE rows of two numbers: that is the bound of the broadcast.
    chosen = chosen.orderBy(F.xxhash64("key"), "key").limit(SAMPLE)
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(chosen), "key").select("key", "text", F.col("y").cast("double").alias("y"))
    # One row for each key, so what is gathered has the bound of the sample whatever is repeated.
    rows = rows.groupBy("key", "y").agg(F.min(F.struct(F.xxhash64("text").alias("mark"), F.col("text").alias("text"))).alias("first")).select("key", "first.text", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, "text"):
            x = features(string(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("key").cast(pa.string()), batch.column("y"), pa.array(list(x))], names=["key", "y", "x"])

    found = sorted(rows.mapInArrow(run, "key string, y double, x array<double>").collect())
    if not found:
        return Classifier.fit(np.zeros((0, features(pa.array([""])).shape[1])), np.zeros(0))
    return Classifier.fit(np.array([r.x for r in found]), np.array([r.y for r in found]))


def with_evidence(df: DataFrame, classifier: Classifier, text: str = "text") -> DataFrame:
    """``df`` with the double column ``evidence``."""
    sent = df.sparkSession.sparkContext.broadcast(classifier)
    df = df.drop("evidence")
    names = df.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, text):
            e = sent.value.evidence(features(string(batch.column(text))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(e)], names=[*names, "evidence"])

    return df.mapInArrow(run, f"{fields}, evidence double")


def _probability(log_odds: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-log_odds))


def _log_odds(p: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (F.lit(1.0) - p))


def _strength(groups: DataFrame, n: str, s: str, prior: Column) -> float:
    """How many documents the prior counts: rate * (1 - rate) / variance between groups - 1, within 1 and 1e6.

    The variance between groups is that of their rates around their priors beyond what the
    documents' own spread explains.
    """
    rate = F.col(s) / F.col(n)
    row = groups.where(F.col(n) >= 2).agg(
        F.sum(F.col(n) * (rate - prior) ** 2).alias("between"), F.sum(n).alias("docs"), F.sum(F.col("within")).alias("within"), F.count("*").alias("groups"), F.sum(s).alias("s")
    ).first()
    if not row.groups or row.groups < 2 or not row.docs:
        return 1e6
    m = row.s / row.docs
    noise = row.within / max(row.docs - row.groups, 1)
    spread = (row.between - row.groups * noise) / row.docs
    return float(min(1e6, max(1.0, m * (1 - m) / spread - 1))) if spread > 0 else 1e6


def assess(df: DataFrame, classifier: Classifier, host: Column, path: Column, text: str = "text", threshold: float = 0.5, columns: list[str] | None = None) -> DataFrame:
    """``columns`` of ``df`` (all by default) with evidence, site_docs, site_rate, probability, kept."""
    columns = columns if columns is not None else [c for c in df.columns if c not in ("evidence", "site_docs", "site_rate", "probability", "kept")]
    base = float(np.log(classifier.rate / (1 - classifier.rate)))
    tick = lambda c: F.col(f"`{c}`")
    keyed = df.select(*map(tick, columns), *([tick(text)] if text not in columns else []), host.alias("__host"), path.alias("__path"))
    scored = with_evidence(keyed, classifier, text)
    scored = written(scored if text in columns else scored.drop(text), "evidence").withColumn("__p", _probability(F.col("evidence") + base))
    # A row per path; hosts and the whole are sums of these.
    paths = written(scored.groupBy("__host", "__path").agg(F.count("*").alias("n"), F.sum("__p").alias("s"), F.sum(F.col("__p") ** 2).alias("q")), "sites")
    total = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    rate = (total.s / total.n) if total.n else 0.5
    hosts = paths.where("__host is not null").groupBy("__host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"), F.sum("q").alias("host_q"))
    inside = lambda q, s, n: F.col(q) - F.col(s) ** 2 / F.col(n)
    k_host = _strength(hosts.withColumn("within", inside("host_q", "host_s", "host_n")), "host_n", "host_s", F.lit(rate))
    both = paths.where("__host is not null").join(hosts, "__host")
    k_path = _strength(both.where("__path is not null").withColumn("within", inside("q", "s", "n")), "n", "s", F.col("host_s") / F.col("host_n"))
    # As a table, so that a hot site's documents are split as a skewed join's key.
    sites = written(both.select(F.col("__host").alias("__h"), F.col("__path").alias("__q"), *(F.col(c).alias(f"__{c}") for c in ("n", "s", "host_n", "host_s"))), "rates")
    out = scored.join(sites, (F.col("__host") == F.col("__h")) & F.col("__path").eqNullSafe(F.col("__q")), "left")
    own, n, total_s, host_n, host_s = (F.col(c) for c in ("__p", "__n", "__s", "__host_n", "__host_s"))
    host_rate = F.when(host_n.isNull(), F.lit(rate)).otherwise((k_host * rate + host_s - own) / (k_host + host_n - 1))
    path_rate = F.when(F.col("__path").isNull() | n.isNull(), host_rate).otherwise((k_path * host_rate + total_s - own) / (k_path + n - 1))
    out = out.withColumn("site_docs", F.coalesce(n, F.lit(0))).withColumn("site_rate", path_rate)
    out = out.withColumn("probability", _probability(F.col("evidence") + _log_odds(F.col("site_rate")))).withColumn("kept", F.col("probability") >= threshold)
    return out.select(*map(tick, columns), "evidence", "site_docs", "site_rate", "probability", "kept")


def url_site(url: Column) -> tuple[Column, Column]:
    """Host, and first segment of the path, of a URL column: null where there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)", 1)
    return F.nullif(host, F.lit("")), F.nullif(path, F.lit(""))

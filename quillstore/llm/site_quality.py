"""Quality by document, path and host: hierarchical empirical Bayes.

A logistic regression on surface measures of a text gives its own evidence.
The mean evidence of a path is shrunk towards that of its host, and a host's
towards that of the whole corpus; how strongly is estimated from how much hosts
and paths differ at all.  A document's posterior adds to its own log odds what
its site's log odds exceed the corpus's, where the document itself is left out of
its site, as its evidence would else count twice.  Site statistics are sums, formed
by grouped aggregation with partial sums, and sites are joined, not collected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import bounded_batches, cut
from .compression import Limits, measure
from .logistic import fit_softmax

MEASURED = ("log_words", "word_length", "symbols", "repeats", "dup_lines", "ratio", "bad_chunks", "upper", "bars", "marks", "digits")
UPPER, BAR, DIGIT = K.table(range(65, 91)), K.table([124]), K.table(range(48, 58))
MARK = K.table(b"!?#*$%&@^~_=+<>{}[]\\/")


@dataclass
class Classifier:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((x - self.mean) / self.scale) @ self.weights + self.bias, -12, 12)


def surface(column: pa.Array) -> np.ndarray:
    """One row of MEASURED per text; a null text counts as empty."""
    m = measure(column, Limits())
    data, offsets, _ = K.utf8_column(column)
    size = np.maximum(np.diff(offsets), 1)

    def share(table):
        out = []
        for a, b in K.chunks(offsets):
            c = np.concatenate(([0], np.cumsum(table[data[offsets[a] : offsets[b]]], dtype=np.int64)))
            at = offsets[a : b + 1] - offsets[a]
            out.append(c[at[1:]] - c[at[:-1]])
        return (np.concatenate(out) if out else np.zeros(0)) / size

    n = np.maximum(m["n_words"], 1)
    return np.stack(
        [np.log1p(m["n_words"]), m["word_chars"] / n, m["n_symbols"] / n, m["n_repeat_words"] / n, m["n_dup_lines"] / n, np.log(m["ratio"]), m["bad_chunk_share"], share(UPPER), share(BAR), share(MARK), share(DIGIT)], 1
    )


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, prior_good: float = 0.5) -> Classifier:
    """Fit on at most ``max_rows`` labelled rows, those with the least hash of the id; each in whole.  Without both
    classes every text gets even odds.  An id that several rows have stands for one of its texts.  prior_good: share
    of good texts that the bias is set for."""
    stated = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    picked = stated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    named = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = named.select("text", F.col("quality").cast("int").alias("quality"))

    def run(batches):
        for batch in batches:
            x = surface(batch.column(0))
            yield pa.RecordBatch.from_arrays([*(pa.array(x[:, i]) for i in range(x.shape[1])), batch.column(1)], names=[*MEASURED, "quality"])

    got = rows.mapInArrow(run, ", ".join(f"{c} double" for c in MEASURED) + ", quality int").toArrow()
    x, y = np.stack([got[c].to_numpy() for c in MEASURED], 1), (got["quality"].to_numpy() > 0).astype(int)
    order = np.lexsort(np.column_stack([x, y]).T)
    x, y = x[order], y[order]
    if len(set(y.tolist())) < 2:
        return Classifier(np.zeros(len(MEASURED)), np.ones(len(MEASURED)), np.zeros(len(MEASURED)), 0.0)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    w, b = fit_softmax((x - mean) / scale, y, 2, l2=1e-3, steps=1500)
    odds = y.mean() / (1 - y.mean())
    return Classifier(mean, scale, w[:, 1] - w[:, 0], float(b[1] - b[0] - np.log(odds) + np.log(prior_good / (1 - prior_good))))


def score(docs: DataFrame, model: Classifier, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, host, path, log_odds of each document."""
    bounded_batches(docs.sparkSession)
    slim = docs.select(docs[id_col].alias("doc_id"), F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.coalesce(path.cast("string"), F.lit("")).alias("path"), docs[text_col].alias("text"))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(model.log_odds(surface(batch.column(3))))], names=["doc_id", "host", "path", "log_odds"])

    return slim.mapInArrow(run, f"doc_id {slim.dtypes[0][1]}, host string, path string, log_odds double")


def _strength(groups: DataFrame, centre: Column, cap: float) -> float:
    """Prior strength in documents, by moments: how much less group means differ than evidence within groups would
    make them.  groups: (n, s, q) sums of evidence and of its squares, with their centre."""
    mean = F.col("s") / F.col("n")
    within = F.sum(F.col("q") - F.col("s") * mean).alias("within")
    between = F.sum(F.col("n") * (mean - centre) ** 2).alias("between")
    r = groups.agg(within, between, F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * F.col("n")).alias("n2")).first()
    if not r["n"] or r["k"] < 2 or r["n"] <= r["k"]:
        return cap
    noise = r["within"] / (r["n"] - r["k"])
    spread = (r["between"] - (r["k"] - 1) * noise) / max(r["n"] - r["n2"] / r["n"], 1e-9)
    return float(min(cap, noise / spread)) if spread > 0 and noise > 0 else cap


def posteriors(scored: DataFrame, cap: float = 1000.0, threshold: float = 0.5) -> DataFrame:
    """One row per document: doc_id, host, path, doc_quality (its own evidence), path_quality, host_quality, quality
    (posterior) and kept.  path_quality and host_quality are those of the other documents of the site.

    Null hosts and paths are one site each.  The only document of a path has its host's quality, the only one of a host
    the corpus's; repeated rows are documents of their own; a null or empty text is scored as an empty one, ties at the
    threshold are kept; an empty table gives an empty result.  cap: greatest prior strength, in documents.
    """
    p = 1 / (1 + F.exp(-F.col("log_odds")))
    paths = cut(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum(p).alias("s"), F.sum(p * p).alias("q")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    base = float(total["s"] / total["n"]) if total["n"] else 0.5
    k_host = _strength(hosts, F.lit(base), cap)
    level = hosts.select(F.col("host").alias("__host"), F.col("n").alias("__hn"), F.col("s").alias("__hs"))
    mean = (F.col("__hs") + k_host * base) / (F.col("__hn") + k_host)
    sites = paths.join(level, paths["host"] == level["__host"])
    k_path = _strength(sites.select("n", "s", "q", mean.alias("centre")), F.col("centre"), cap)
    sites = sites.select("__host", F.col("path").alias("__path"), F.col("n").alias("__n"), F.col("s").alias("__s"), "__hn", "__hs")
    odds = lambda c: F.log(F.greatest(c, F.lit(1e-6)) / F.greatest(1 - c, F.lit(1e-6)))
    joined = scored.join(sites, (scored["host"] == sites["__host"]) & (scored["path"] == sites["__path"])).withColumn("__p", p)
    others = (F.col("__hs") - F.col("__p") + k_host * base) / (F.col("__hn") - 1 + k_host)
    joined = joined.withColumn("host_quality", others)
    joined = joined.withColumn("path_quality", (F.col("__s") - F.col("__p") + k_path * F.col("host_quality")) / (F.col("__n") - 1 + k_path))
    z = F.col("log_odds") + odds(F.col("path_quality")) - odds(F.lit(base))
    quality = 1 / (1 + F.exp(-z))
    return joined.select("doc_id", "host", "path", F.col("__p").alias("doc_quality"), "path_quality", "host_quality", quality.alias("quality"), (quality >= threshold).alias("kept"))


def site_quality(docs: DataFrame, labels: DataFrame, host: Column, path: Column, max_rows: int = 20_000) -> DataFrame:
    """Fit, score and combine; see ``fit``, ``score`` and ``posteriors``."""
    return posteriors(cut(score(docs, fit(docs, labels, max_rows), host, path)))

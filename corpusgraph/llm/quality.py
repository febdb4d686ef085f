"""Quality and toxicity of documents by hierarchical empirical Bayes.

A linear classifier over hashed words and a few shape figures gives each document's evidence. Sites (host, then path within
host) have a posterior share of good documents: a Beta prior from all hosts, updated with the host's documents, is the
prior of its paths. Sparse sites so stay near their parents. A document's posterior joins its evidence with its path.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgraph.llm.staging import beside, sent, staged
from corpusgraph.llm.words import blocks

FEATURES = 1 << 18
SHAPES = 6


class Classifier(NamedTuple):
    words: np.ndarray  # weight of each hashed word's presence
    shapes: np.ndarray  # weights of the shape figures and a constant
    prior: float  # share of positives in the training rows


def _shapes(text: str, n_words: int, distinct: int) -> list[float]:
    n = max(1, len(text))
    upper = sum(map(str.isupper, text)) / n
    mark = sum(text.count(c) for c in "!*%$#&|") / n
    digit = sum(map(str.isdigit, text)) / n
    lines = text.split("\n")
    return [5 * upper, 10 * mark, 5 * digit, 1 - distinct / max(1, n_words), 1 - len(set(lines)) / len(lines), 1.0]


def features(texts: pa.Array) -> Iterator[tuple[np.ndarray, list[float]]]:
    """(distinct hashed words, shape figures) of each text in order."""
    given = texts.fill_null("")
    for block in blocks(given):
        for i in range(len(block.count)):
            words = block.hash[block.at[i] : block.at[i + 1]]
            distinct = np.unique(words)
            yield (distinct % np.uint64(FEATURES)).astype(np.int64), _shapes(given[block.first + i].as_py(), len(words), len(distinct))


def train(rows: list[tuple[np.ndarray, list[float]]], target: np.ndarray, rounds: int = 12, batch: int = 128, l2: float = 1e-5) -> Classifier:
    """Logistic regression by AdaGrad. A document's word weights are summed and divided by the root of their number's root."""
    words, shapes = np.zeros(FEATURES), np.zeros(SHAPES)
    word_sq, shape_sq = np.full(FEATURES, 1e-4), np.full(SHAPES, 1e-4)
    prior = float(np.clip(target.mean() if len(target) else 0.5, 0.01, 0.99))
    shapes[-1] = np.log(prior / (1 - prior))
    rng = np.random.default_rng(7)
    figures = np.array([s for _, s in rows]).reshape(-1, SHAPES)
    for _ in range(rounds if 0 < target.sum() < len(target) else 0):
        order = rng.permutation(len(rows))
        for a in range(0, len(order), batch):
            mine = order[a : a + batch]
            at = np.concatenate([rows[i][0] for i in mine])
            doc = np.repeat(np.arange(len(mine)), [len(rows[i][0]) for i in mine])
            z = np.bincount(doc, weights=words[at], minlength=len(mine)) + figures[mine] @ shapes
            error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target[mine]
            used, slot = np.unique(at, return_inverse=True)
            g = np.bincount(slot, weights=error[doc]) + l2 * words[used]
            word_sq[used] += g * g
            words[used] -= 0.1 * g / np.sqrt(word_sq[used])
            g = error @ figures[mine]
            shape_sq += g * g
            shapes -= 0.1 * g / np.sqrt(shape_sq)
    return Classifier(words, shapes, prior)


def logit(model: Classifier, words: np.ndarray, shapes: list[float]) -> float:
    return float(np.clip(model.words[words].sum() + np.dot(model.shapes, shapes), -30, 30))


def sample(docs: DataFrame, labels: DataFrame, rows: int = 6000) -> tuple[list, np.ndarray, np.ndarray]:
    """Features, quality and toxicity of at most rows labelled documents, by smallest hash of doc_id."""
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic")).where("quality is not null and toxic is not null")
    got = {r["doc_id"]: (r["quality"], r["toxic"]) for r in marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).collect()}
    if not got:
        return [], np.zeros(0), np.zeros(0)
    chosen = docs.sparkSession.createDataFrame([(i,) for i in got], "doc_id long")
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")  # rows ids at most

    def run(batches):
        for batch in batches:
            found = list(features(batch.column("text")))
            yield pa.record_batch([batch.column("doc_id").cast(pa.int64()), pa.array([w.astype(np.int32).tobytes() for w, _ in found], pa.binary()), pa.array([s for _, s in found], pa.list_(pa.float64()))], names=["doc_id", "w", "s"])

    out = sorted(((r["doc_id"], bytes(r["w"]), list(r["s"])) for r in texts.mapInArrow(run, "doc_id long, w binary, s array<double>").toLocalIterator()))
    feats = [(np.frombuffer(w, np.int32).astype(np.int64), s) for _, w, s in out]
    return feats, np.array([got[i][0] for i, _, _ in out], float), np.array([got[i][1] for i, _, _ in out], float)


def evidence(docs: DataFrame, good: Classifier, toxic: Classifier) -> DataFrame:
    """docs(doc_id, host, path, text) -> (doc_id, host, path, z_good, z_toxic): log odds by text alone."""
    spread = sent(docs.sparkSession, (tuple(good), tuple(toxic)))

    def run(batches):
        both = [Classifier(*m) for m in spread()]
        for batch in batches:
            z = [[logit(m, w, s) for m in both] for w, s in features(batch.column("text"))]
            yield pa.record_batch([batch.column("doc_id"), batch.column("host"), batch.column("path"), pa.array([a for a, _ in z], pa.float64()), pa.array([b for _, b in z], pa.float64())], names=["doc_id", "host", "path", "z_good", "z_toxic"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "host", "path", F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, host string, path string, z_good double, z_toxic double")


def site_of(url: str) -> tuple[Column, Column]:
    """(host, first path segment) of a URL column."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))
    return host, F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]*)", 1)


def _strength(mean: float, spread: float) -> float:
    """Beta prior's strength by moments: rates of this mean that differ by spread more than chance would make them."""
    return min(1000.0, max(1.0, mean * (1 - mean) / spread - 1)) if spread > 0 else 1000.0


def posteriors(rows: DataFrame, prior: float) -> DataFrame:
    """rows(doc_id, host, path, z_good, z_toxic) with host_rate, path_rate, p_good and p_toxic.

    All rates come from one aggregate by (host, path), so a hot host is summed before it is shuffled. The strengths of the
    Beta priors, of hosts around the global rate and of paths around their host's, are fit by moments; sites no more
    unlike than chance give strength 1000. A document's own evidence is left out of the rates that it is joined with, so it
    enters once. A host with one document has the global rate, a path with one its host's.
    """
    odds = lambda p: F.log(p / (1 - p))
    inverse = lambda z: 1 / (1 + F.exp(-z))
    rows = rows.withColumn("host", F.coalesce("host", F.lit(""))).withColumn("path", F.coalesce("path", F.lit("")))
    paths = staged(rows.groupBy("host", "path").agg(F.sum(inverse(F.col("z_good"))).alias("s"), F.count("*").alias("n")))
    hosts = paths.groupBy("host").agg(F.sum("s").alias("hs"), F.sum("n").alias("hn"))
    m = hosts.agg(F.sum("hs").alias("s"), F.sum("hn").alias("n"), F.var_pop(F.col("hs") / F.col("hn")).alias("var"), F.avg(1 / F.col("hn")).alias("inv")).first()
    mean = min(0.999, max(0.001, (m["s"] / m["n"]) if m["n"] else prior))
    strength = _strength(mean, (m["var"] or 0.0) - mean * (1 - mean) * (m["inv"] or 0.0))
    sites = paths.join(hosts, "host")
    within, chance = F.pow(F.col("s") / F.col("n") - F.col("hs") / F.col("hn"), 2), F.col("hs") / F.col("hn") * (1 - F.col("hs") / F.col("hn")) / F.col("n")
    w = sites.where("hn > n").agg(F.avg(within - chance).alias("spread")).first()
    below = _strength(mean, w["spread"] or 0.0)
    out = beside(rows, sites, ["host", "path"], "doc_id").withColumn("own", inverse(F.col("z_good")))
    out = out.withColumn("host_rate", (F.col("hs") - F.col("own") + strength * mean) / (F.col("hn") - 1 + strength))
    out = out.withColumn("path_rate", (F.col("s") - F.col("own") + below * F.col("host_rate")) / (F.col("n") - 1 + below))
    site = F.least(F.lit(0.999), F.greatest(F.lit(0.001), F.col("path_rate")))
    return out.withColumn("p_good", inverse(F.col("z_good") - float(np.log(prior / (1 - prior))) + odds(site))).withColumn("p_toxic", inverse(F.col("z_toxic"))).drop("own", "s", "n", "hs", "hn")


def classify(docs: DataFrame, labels: DataFrame, sample_rows: int = 6000) -> DataFrame:
    """docs(doc_id, text, host, path), labels(doc_id, quality, toxic) -> one row a document.

    Columns doc_id, host, path, host_rate, path_rate, p_good, p_toxic and keep (p_good and not p_toxic, both at one
    half). The classifiers are fit on at most sample_rows labelled documents; without labels all evidence is even and
    everything is kept. A document with several labels has the lowest quality and is toxic if any says so. Null texts are
    empty, null hosts and paths are ''. Repeated rows each count and are each returned; other columns aren't read. An empty
    table gives an empty result.
    """
    feats, quality, harm = sample(docs, labels, sample_rows)
    good, toxic = train(feats, quality), train(feats, harm)
    if not feats:
        toxic = toxic._replace(shapes=np.array([0.0] * (SHAPES - 1) + [-1.0]))
    rows = staged(evidence(docs, good, toxic))
    out = posteriors(rows, good.prior)
    return out.select("doc_id", "host", "path", "host_rate", "path_rate", "p_good", "p_toxic", ((F.col("p_good") >= 0.5) & (F.col("p_toxic") < 0.5)).alias("keep"))

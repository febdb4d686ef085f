"""Approximate nearest neighbours with a permutation index.

A vector is represented by its nearest pivots in order. It is posted in the inverted files of these pivots, in blocks; a
query reads the files of its own nearest pivots, ranks what they hold by the footrule distance of the two orders, and
compares the vectors within the calibrated distance exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusgraph.llm.staging import sent, staged


class Index(NamedTuple):
    pivots: np.ndarray  # one a row, of length 1, with the added coordinate
    longest: float  # length that rows are brought to by the added coordinate
    length: int  # pivots kept of a vector's order
    probes: int  # inverted files that a query reads, and in which a vector is posted
    radius: int  # largest footrule distance that is compared exactly


def _lifted(vectors: np.ndarray, longest: float) -> np.ndarray:
    """Rows with a coordinate that makes all of one length: the nearest by angle are then those of the largest product."""
    square = np.maximum(longest**2 - (vectors**2).sum(axis=1), 0)
    return np.hstack([vectors, np.sqrt(square)[:, None]]) / longest


def _asking(vectors: np.ndarray) -> np.ndarray:
    """Queries, whose length changes no order, without a part in the added coordinate."""
    return np.hstack([vectors / np.linalg.norm(vectors, axis=1, keepdims=True), np.zeros((len(vectors), 1))])


def _orders(vectors: np.ndarray, index: Index) -> np.ndarray:
    near = vectors @ index.pivots.T
    return np.argsort(-near, axis=1, kind="stable")[:, : index.length].astype(np.int16)


def _ranks(orders: np.ndarray, index: Index) -> np.ndarray:
    """Place of each pivot in each order; absent pivots share the place after the last."""
    out = np.full((len(orders), len(index.pivots)), index.length, dtype=np.int8)
    np.put_along_axis(out, orders.astype(np.int64), np.arange(index.length, dtype=np.int8)[None], axis=1)
    return out


def _footrule(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sum of the differences of places over all pivots, for each row of _ranks()."""
    return np.abs(rows - query).sum(axis=1, dtype=np.int16)


def fit(sample: np.ndarray, longest: float, k: int = 20, pivots: int = 64, length: int = 32, probes: int = 10, recall: float = 0.97) -> Index:
    """Pivots from a bounded sample by farthest-first choice; files read and radius hold recall of the sample's true neighbours.

    Neighbours are those of the largest inner product, whatever the lengths of the vectors.
    """
    lifted = _lifted(sample, longest)
    chosen = [0]
    near = lifted @ lifted[0]
    while len(chosen) < min(pivots, len(sample)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, lifted @ lifted[chosen[-1]])
    size = len(chosen)
    index = Index(lifted[chosen], longest, min(length, size), min(probes, size), 1 << 14)
    asked = np.arange(len(sample))[:: max(1, len(sample) // 128)][:128]
    exact = sample[asked] @ sample.T
    exact[np.arange(len(asked)), asked] = -np.inf
    best = np.argsort(-exact, axis=1)[:, : min(k, len(sample) - 1)]
    if not best.size:
        return index
    rows = _ranks(_orders(lifted, index), index)
    own = _ranks(_orders(_asking(sample[asked]), index), index)
    # a pair is seen if one of the query's first pivots is one of the row's
    first = np.array([np.maximum(rows[b].astype(int), q[None]).min(axis=1) for q, b in zip(own, best)])
    need = int(np.quantile(first, (1 + recall) / 2, method="higher")) + 1
    index = index._replace(probes=min(index.length, max(index.probes, need)))
    apart = np.array([_footrule(q, rows[b]) for q, b in zip(own, best)])
    return index._replace(radius=int(np.quantile(apart, recall, method="higher")))


def _usable(df: DataFrame, vector: str) -> DataFrame:
    """Rows with a vector of finite components that aren't all zero."""
    fine = F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    return df.where(F.coalesce(fine, F.lit(False)))


def search(vectors: DataFrame, every: int = 20, k: int = 20, sample_rows: int = 4096, block_rows: int = 8192, index: Index | None = None, growth: int = 4) -> DataFrame:
    """vectors(vec_id, embedding) -> (query_id, rank, vec_id, score): the k nearest found of each row whose vec_id is divisible by every.

    Nearness is the inner product in double precision; ties go to the smaller vec_id. Null, empty and zero vectors, those
    with null or non-finite components and those without a vec_id take no part; other columns aren't read. The index is
    fit on at most sample_rows rows (smallest hash of vec_id), at every size of the table alike; every row is indexed. A
    pivot's inverted file is dealt over salted blocks of about block_rows rows, and so are the queries that read it, so
    that a pivot near a third of all vectors is no single task. A pair is judged in one file only, that of the first of
    the query's pivots that the vector is posted under. Each file yields its rows within the index's footrule radius, and
    at least its k nearest by footrule. The rows are asked in layers by the hash of vec_id, each growth times as many as
    all before it: what a query found so far bounds its k-th best score from below, so a layer's files yield only about
    k * (growth - 1) rows for each query, however many blocks there are. Vectors must have one length; rows of another one
    are an error. Rows that share a vec_id are queries and candidates of their own.
    """
    spark = vectors.sparkSession
    rows = _usable(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("embedding")).where("vec_id is not null"), "embedding")
    rows = staged(rows.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"), F.monotonically_increasing_id().alias("rid")))
    total, longest = rows.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not total:
        return spark.createDataFrame([], schema)
    place = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30))
    if index is None:
        share = min(1.0, (sample_rows + 4 * sample_rows**0.5) / total)
        got = rows.where(place < int(share * (1 << 30)) + 1).orderBy(place, "vec_id", "rid").limit(sample_rows).collect()
        got = got or rows.orderBy("vec_id", "rid").limit(1).collect()
        index = fit(np.array([r["v"] for r in got]), float(longest) ** 0.5, k)
    given = sent(spark, tuple(index))
    width = len(index.pivots[0]) - 1
    blocks = lambda n: max(1, round(n * index.probes / len(index.pivots) / block_rows))
    asks = blocks(total / every)

    def stacked(batch: pd.DataFrame) -> np.ndarray:
        if any(len(x) != width for x in batch["v"]):
            raise ValueError("vectors of different lengths")
        return np.stack(batch["v"].to_numpy())

    def posted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Index(*given())
        for batch in batches:
            if not len(batch):
                continue
            v = stacked(batch)
            orders = _orders(_lifted(v, known.longest), known)
            raw, whole = [x.tobytes() for x in v], [x.tobytes() for x in orders]
            for j in range(known.probes):
                yield pd.DataFrame({"pivot": orders[:, j].astype(np.int32), "vec_id": batch["vec_id"].to_numpy(), "rid": batch["rid"].to_numpy(), "order": whole, "v": raw})

    def asking(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Index(*given())
        for batch in batches:
            if not len(batch):
                continue
            v = stacked(batch)
            orders = _orders(_asking(v), known)
            ids, bar = batch["rid"].to_numpy(), batch["bar"].fillna(-np.inf).to_numpy(np.float64)
            block, probed = batch["ask"].to_numpy(), orders[:, : known.probes]
            out = []
            for pivot, ask in {(int(p), int(b)) for p, b in zip(probed.ravel(), np.repeat(block, probed.shape[1]))}:
                at = np.flatnonzero((probed == pivot).any(axis=1) & (block == ask))
                out.append((pivot, ask, *(x[at].tobytes() for x in (ids, bar, orders, v))))
            yield pd.DataFrame(out, columns=["pivot", "ask", "ids", "bars", "order", "v"])

    def matched(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        known = Index(*given())
        none = pd.DataFrame({"qid": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "rid": np.zeros(0, np.int64), "score": np.zeros(0)})
        if not len(left) or not len(right):
            return none
        pivot = int(left["pivot"].iloc[0])
        ids, rid = left["vec_id"].to_numpy(), left["rid"].to_numpy()
        order = np.frombuffer(b"".join(left["order"]), np.int16).reshape(len(left), -1)
        v = np.frombuffer(b"".join(left["v"]), np.float64).reshape(len(left), -1)
        asked, bars = np.frombuffer(b"".join(right["ids"]), np.int64), np.frombuffer(b"".join(right["bars"]), np.float64)
        own = np.frombuffer(b"".join(right["order"]), np.int16).reshape(len(asked), -1)
        q = np.frombuffer(b"".join(right["v"]), np.float64).reshape(len(asked), -1)
        ranks, places = _ranks(order, known), _ranks(own, known)
        posted_at = ranks < known.probes
        out = []
        for i in range(len(asked)):
            before = own[i, : int(places[i, pivot])].astype(np.int64)
            at = np.flatnonzero(~posted_at[:, before].any(axis=1) & (rid != asked[i]))
            if len(at) > k:
                apart = _footrule(places[i], ranks[at])
                at = at[apart <= max(known.radius, np.partition(apart, k - 1)[k - 1])]
            score = (v[at] * q[i]).sum(axis=1)
            at, score = at[score >= bars[i]], score[score >= bars[i]]
            if not len(at):
                continue
            if len(at) > k:
                edge = np.partition(score, len(at) - k)[len(at) - k]
                at, score = at[score >= edge], score[score >= edge]
            best = np.lexsort((rid[at], ids[at], -score))[:k]
            out.append(pd.DataFrame({"qid": asked[i], "vec_id": ids[at][best], "rid": rid[at][best], "score": score[best]}))
        return pd.concat(out) if out else none

    best = W.partitionBy("qid").orderBy(F.desc("score"), "vec_id", "rid")
    queries = rows.where(F.col("vec_id") % every == 0).withColumn("ask", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(asks)).cast("int"))
    layers = 0
    while total > sample_rows * growth**layers:
        layers += 1
    found, low = None, 0
    for left in range(layers, -1, -1):
        high = (1 << 30) // growth**left
        salts = blocks(total * (high - low) / (1 << 30))
        layer = rows.where((place >= low) & (place < high)).mapInPandas(posted, "pivot int, vec_id long, rid long, order binary, v binary")
        layer = layer.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(salts)).cast("int")).withColumn("ask", F.explode(F.sequence(F.lit(0), F.lit(asks - 1))))
        asked = queries.withColumn("bar", F.lit(None).cast("double"))
        if found is not None:
            bar = found.groupBy(F.col("qid").alias("rid")).agg(F.when(F.count("*") == k, F.min("score")).alias("bar"))
            asked = queries.join(bar, "rid", "left")
        asked = asked.mapInPandas(asking, "pivot int, ask int, ids binary, bars binary, order binary, v binary")
        asked = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        got = layer.groupBy("pivot", "salt", "ask").cogroup(asked.groupBy("pivot", "salt", "ask")).applyInPandas(matched, "qid long, vec_id long, rid long, score double")
        got = got if found is None else got.unionByName(found.drop("rank"))
        found = got.select("qid", F.row_number().over(best).alias("rank"), "vec_id", "rid", "score").where(F.col("rank") <= k)
        found, low = staged(found) if left else found, high
    of = queries.select(F.col("rid").alias("qid"), F.col("vec_id").alias("query_id"))
    return found.join(of, "qid").select("query_id", "rank", "vec_id", "score")

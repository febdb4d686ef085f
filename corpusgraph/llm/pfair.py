"""Mixing sources to target weights by Pfair scheduling."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusgraph.llm.staging import staged


def shares(weights: dict[str, float], period: int) -> dict[str, int]:
    """Whole slots of each source in a period, by largest remainder, one at least; they add up to the period."""
    if not weights or min(weights.values()) <= 0:
        raise ValueError("weights must be positive")
    if len(weights) > period:
        raise ValueError(f"{len(weights)} sources need a period of as many slots at least")
    total = sum(weights.values())
    free = period - len(weights)
    exact = {s: free * w / total for s, w in weights.items()}
    out = {s: 1 + int(x) for s, x in exact.items()}
    for s in sorted(weights, key=lambda s: (int(exact[s]) - exact[s], s))[: period - sum(out.values())]:
        out[s] += 1
    return out


def whole(weights: dict[str, float]) -> dict[str, int]:
    """Whole numbers in exactly the proportions of the weights; a float stands for the fraction that it is."""
    if not weights or min(weights.values()) <= 0:
        raise ValueError("weights must be positive")
    exact = {s: Fraction(w) for s, w in weights.items()}
    unit = math.lcm(*(x.denominator for x in exact.values()))
    return {s: int(x * unit) for s, x in exact.items()}


def placed(parts: dict[str, int], blocks: dict[str, int]) -> Iterator[tuple[str, int, int, int, int]]:
    """(source, block, slot, release, deadline) of all blocks in order of slots: earliest deadline first among released ones.

    Block j of a source of p parts in n is released at floor(j n / p) and due at ceil((j + 1) n / p). One slot of p / n for
    every source fits these windows, so unit blocks do too, and earliest deadline first finds them a place; blocks that a
    source doesn't have leave slots empty. Ties go to the block whose window doesn't overlap the next one, then to the
    larger share, then by name. Only each source's next block is held.
    """
    n = sum(parts.values())
    waiting = [(0, s, 0) for s, many in blocks.items() if many]
    heapq.heapify(waiting)
    ready: list[tuple] = []
    t = 0
    while waiting or ready:
        if not ready:
            t = max(t, waiting[0][0])
        while waiting and waiting[0][0] <= t:
            release, s, j = heapq.heappop(waiting)
            p = parts[s]
            due, over = divmod((j + 1) * n, p)
            heapq.heappush(ready, (due + (over > 0), over == 0, -p, s, j, release))
        due, _, _, s, j, release = heapq.heappop(ready)
        if due <= t:
            raise AssertionError("a deadline was missed")
        yield s, j, t, release, due
        if j + 1 < blocks[s]:
            heapq.heappush(waiting, ((j + 1) * n // parts[s], s, j + 1))
        t += 1


def schedule(slots: dict[str, int]) -> list[tuple[str, int, int, int, int]]:
    """placed() of one period of whole slots, which fill it."""
    return list(placed(slots, slots))


def _source() -> Column:
    return F.coalesce(F.col("source").cast("string"), F.lit("")).alias("cg__source")


def _places(weights: dict[str, float] | None, block_docs: int, period: int | None):
    """The schedule of (cg__source, cg__n) rows: all sources in one task, which holds a block of each at a time."""
    schema = pa.schema([("cg__source", pa.string()), ("block", pa.int64()), ("slot", pa.int64()), ("release", pa.int64()), ("deadline", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = {s: n for batch in batches for s, n in zip(*(c.to_pylist() for c in batch.columns))}
        if not count:
            return
        asked = {s: n**0.5 for s, n in count.items()} if weights is None else weights
        if missing := sorted(set(count) - set(asked))[:5]:
            raise ValueError(f"sources without a weight: {missing}")
        rows = placed(whole(shares(asked, period) if period else asked), {s: -(-n // block_docs) for s, n in count.items()})
        while some := list(islice(rows, 1 << 14)):
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*some), schema)], schema=schema)

    return run


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, block_docs: int | None = None, period: int | None = None, part_docs: int = 200_000) -> DataFrame:
    """docs with block, slot, release, deadline and position_in_block: reading by (slot, position_in_block) mixes the sources.

    Each source's documents, in an order by hash of doc_id, are cut into blocks of block_docs (16, or as many more as make
    2 ** 22 blocks of the run, which one task orders in seconds), and placed() gives every block of the run its slot. While no source has run out, every prefix of slots has less than one block more or less of
    each source than its weight asks for. A source that has run out leaves its slots empty, so those left keep their
    proportions; no document is dropped or repeated. weights default to the square root of the sources' document counts
    and must name every source, of which there may be any number; they are met exactly, or if a period is given, as whole slots of it (shares()). Null
    sources are the source ''. Rows with equal doc_id are ordered by their text's hash. An empty table gives an empty
    result. Columns with the added names, or names that begin with cg__, are replaced.
    """
    added = ["block", "slot", "release", "deadline", "position_in_block"]
    docs = docs.drop(*added, *[c for c in docs.columns if c.startswith("cg__")])
    given = docs.columns
    total = docs.count()
    block_docs = block_docs or max(16, total >> 22)
    salts = 1 + total // part_docs
    # a source is numbered in as many parts as the table has part_docs: a prefix sum over their counts gives each part its first number
    marked = docs.withColumn("cg__source", _source()).withColumn("cg__key", F.xxhash64("doc_id")).withColumn("cg__salt", F.pmod(F.shiftrightunsigned("cg__key", 20), F.lit(salts)))
    part = staged(marked.groupBy("cg__source", "cg__salt").agg(F.count("*").alias("cg__n")))
    count = part.groupBy("cg__source").agg(F.sum("cg__n").alias("cg__n"))
    places = count.coalesce(1).mapInArrow(_places(weights, block_docs, period), "cg__source string, block long, slot long, release long, deadline long")
    part = part.select("cg__source", "cg__salt", (F.sum("cg__n").over(W.partitionBy("cg__source").orderBy("cg__salt")) - F.col("cg__n")).alias("cg__before"))
    inside = W.partitionBy("cg__source", "cg__salt").orderBy("cg__key", "doc_id", "cg__tie")
    tie = F.xxhash64("text") if "text" in given else F.lit(0)
    numbered = marked.withColumn("cg__tie", tie).withColumn("cg__rn", F.row_number().over(inside)).join(part, ["cg__source", "cg__salt"])  # sources * salts rows
    at = F.col("cg__before") + F.col("cg__rn") - 1
    numbered = numbered.withColumn("block", F.floor(at / block_docs)).withColumn("position_in_block", (at % block_docs).cast("int"))
    return numbered.join(places, ["cg__source", "block"]).select(*given, *added)

"""Reachability, cycles, components, neighbourhoods and ordered admission of edges."""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.operators.keyed import cut, written


def closure(edges: DataFrame) -> DataFrame:
    """edges(s, o) -> every (s, o) joined by a path of one edge or more.

    A round doubles the length of the paths known, and joins only those of exactly the longest length with all: each pair
    comes by its shortest path, once a middle. A pair is written once, in the round that finds it.
    """
    known, at = [written(edges.select("s", "o", F.lit(1).alias("d")).distinct())], 1
    while True:
        reach = reduce(DataFrame.unionAll, known)
        longest = known[-1].where(F.col("d") == at)
        if longest.isEmpty():
            return reach.select("s", "o")
        ends = reach.select(F.col("s").alias("m"), F.col("o").alias("e"), F.col("d").alias("more"))
        grown = longest.select("s", F.col("o").alias("m")).join(ends.hint("merge"), "m").groupBy("s", F.col("e").alias("o")).agg(F.min("more").alias("more"))
        known.append(written(grown.join(reach.select("s", "o").hint("merge"), ["s", "o"], "left_anti").select("s", "o", (F.lit(at) + F.col("more")).alias("d"))))
        at *= 2


def core(edges: DataFrame) -> DataFrame:
    """edges(id, s, o) without those that a cycle can't hold: ends without an edge in or out go until none is left.

    Each round is merged, not broadcast, and written and counted once: what rounds send to the driver adds up.
    """
    now = written(edges)
    n = now.count()
    while n:
        starts, ends = now.select(F.col("s").alias("o")).distinct(), now.select(F.col("o").alias("s")).distinct()
        now = written(now.join(ends.hint("merge"), "s", "left_semi").join(starts.hint("merge"), "o", "left_semi").select(*edges.columns))
        m = now.count()
        if m == n:
            break
        n = m
    return now


def cycle_edges(edges: DataFrame) -> DataFrame:
    """edges(id, s, o) that lie on a directed cycle; self loops do."""
    left = core(edges)
    pairs = closure(left).select(F.col("s").alias("o"), F.col("o").alias("s"))
    return left.join(pairs.hint("merge"), ["s", "o"], "left_semi").select(*edges.columns)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes(id), edges(s, o) -> (id, component): undirected, named by the smallest id.

    Each round a node takes the smallest label of itself and its neighbours, then the label of its label, so the number of
    rounds grows with the logarithm of the longest path in practice.
    """
    both = cut(edges.select(F.col("s").alias("u"), F.col("o").alias("v")).unionAll(edges.select(F.col("o"), F.col("s"))).where("u <> v").distinct())
    label = cut(nodes.select("id", F.col("id").alias("component")))
    while True:
        named = label.select(F.col("id").alias("v"), F.col("component").alias("c"))
        low = both.join(named, "v").groupBy(F.col("u").alias("id")).agg(F.min("c").alias("c"))
        hop = label.join(low, "id", "left").select("id", F.col("component").alias("was"), F.least("component", "c").alias("component"))
        own = hop.select(F.col("id").alias("component"), F.col("component").alias("root"))
        new = cut(hop.join(own, "component").select("id", "was", F.least("component", "root").alias("component")))
        changed = new.where("was <> component").limit(1).count()
        label = new.select("id", "component")
        if not changed:
            return label


def neighbourhood(edges: DataFrame, roots: DataFrame, hops: int, cap: int | None = None) -> DataFrame:
    """roots(id) -> (id, hop): nodes within hops undirected steps; with cap, at most so many, those of highest degree first."""
    both = edges.select(F.col("s").alias("u"), F.col("o").alias("v")).unionAll(edges.select(F.col("o"), F.col("s"))).distinct()
    seen = roots.select("id", F.lit(0).alias("hop"))
    degree = both.groupBy(F.col("u").alias("id")).agg(F.count("*").alias("degree"))
    for h in range(1, hops + 1):
        edge = seen.where(F.col("hop") == h - 1).select(F.col("id").alias("u"))
        new = edge.join(both, "u").select(F.col("v").alias("id")).distinct().join(seen, "id", "left_anti")
        if cap is not None:
            room = max(0, cap - seen.count())
            new = new.join(degree, "id").orderBy(F.desc("degree"), "id").limit(room).select("id")
        seen = seen.unionAll(new.select("id", F.lit(h).alias("hop")))
    return seen


def admitted(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """existing(s, o), batch(id, s, o) -> (id, s, o, admitted): as if each edge came in id order and was refused if it closed a cycle.

    An edge whose ends aren't on a common cycle of both tables can't close one and comes in at once. Only those within a
    strongly connected part are taken in order, part by part.
    """
    rows = batch.select("id", "s", "o")
    both = existing.select(F.lit(None).cast("long").alias("id"), "s", "o").unionAll(rows)
    risky = cut(cycle_edges(both.where("s <> o")))
    part = components(risky.select(F.col("s").alias("id")).unionAll(risky.select("o")).distinct(), risky.select("s", "o"))
    keyed = risky.join(part.select(F.col("id").alias("s"), "component"), "s")

    def greedy(pdf):
        out = defaultdict(set)
        done = []
        old = pdf[pdf["id"].isna()]
        for s, o in zip(old["s"], old["o"]):
            out[s].add(o)
        for i, s, o in pdf[pdf["id"].notna()].sort_values("id")[["id", "s", "o"]].itertuples(index=False):
            seen, todo = {o}, [o]
            while todo and s not in seen:
                todo.extend(x for x in out[todo.pop()] if x not in seen and not seen.add(x))
            if s not in seen:
                out[s].add(o)
                done.append(int(i))
        import pandas as pd

        return pd.DataFrame({"id": pd.Series(done, dtype="int64")})

    fine = keyed.groupBy("component").applyInPandas(greedy, "id long")
    inside = risky.where("id is not null").select("id").distinct()
    free = rows.where("s <> o").join(inside, "id", "left_anti").select("id")
    ok = fine.unionAll(free).distinct().withColumn("admitted", F.lit(True))
    return rows.join(ok, "id", "left").withColumn("admitted", F.coalesce("admitted", F.lit(False)))

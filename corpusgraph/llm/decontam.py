"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, exact weighted-shingle similarity.

Only DataFrame and SQL functions run. A window that reaches the similarity to some item of its size shares enough weight
with it, so windows that can't share that with any item of their size aren't laid. Which item a window may hold is then
found by fingerprint alone: the windows' 64-bit SimHashes are looked up in the multi-index of all items of that size. Of
radius + 1 blocks, two fingerprints within the radius agree on one at least. What agrees is verified exactly.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.llm.staging import beside, bound, staged

BITS = 1 << 19  # of the shingle filter; a fixed 64 KB, however many items there are
_SPLIT = "[\\x20\\x09-\\x0D]+"


def _hashes(width: int, at: str):
    """Array of the hashes of the shingles of the word hashes in the column named at."""
    index = ", ".join(f"get({at}, i + {k})" for k in range(width))
    return F.expr(f"if(size({at}) < {width}, cast(array() as array<bigint>), transform(sequence(0, size({at}) - {width}), i -> xxhash64({index})))")


def _worded(df: DataFrame, width: int, *kept: str) -> DataFrame:
    words = F.filter(F.split(F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), _SPLIT), lambda w: w != "")
    return bound(bound(df.select(*kept, F.col("text")), wh=F.transform(words, lambda w: F.xxhash64(w))), sh=_hashes(width, "wh"), n=F.size("wh")).drop("text", "wh")


def _bitmap(shingles: DataFrame) -> np.ndarray:
    """The filter in 64-bit words: three bits set for each benchmark shingle."""
    places = shingles.select(F.explode(F.array(*[F.shiftrightunsigned("h", 19 * k).bitwiseAND(F.lit(BITS - 1)) for k in range(3)])).alias("p"))
    rows = places.groupBy(F.shiftright("p", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("v")).collect()  # BITS / 64 rows at most
    out = np.zeros(BITS // 64, dtype=np.int64)
    for r in rows:
        out[r["w"]] = r["v"]
    return out


def _fingerprint(at: str):
    return F.expr(f"aggregate(sequence(0, 63), 0L, (f, b) -> f | if(2 * aggregate({at}, 0, (s, h) -> s + cast(shiftright(h, b) & 1L as int)) > size({at}), shiftleft(1L, b), 0L))")


def _blocks(radius: int):
    """(index, value) of radius + 1 blocks of about equal width of a fingerprint named f."""
    m = radius + 1
    cut = [64 * i // m for i in range(m + 1)]
    return F.array(*[F.struct(F.lit(i).alias("i"), F.shiftrightunsigned("f", a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("v")) for i, (a, b) in enumerate(zip(cut, cut[1:]))])


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, width: int = 5, radius: int = 19) -> DataFrame:
    """docs(doc_id, text), benchmark(item_id, text) -> (doc_id, item_id, start_word, n_words, hamming, similarity).

    One row for each document and item with an item-sized window whose weighted Jaccard similarity of width-word shingles
    (case ignored) is at least threshold: the most similar window, the first of equal ones. A shingle weighs
    1 + ln(items / items that hold it); one outside the benchmark weighs as one in a single item. Items of fewer than
    width words have no shingle and match nothing; nor do null or empty texts on either side. A document shorter than an
    item is one window. Repeated doc_ids are judged by row and reported once, as are items that share an id; null ids are
    carried, columns besides id and text aren't read, and an empty table on either side gives an empty result. Fingerprints
    within radius bits of the item's are all found by the blocks.
    """
    items = staged(_worded(benchmark, width, F.col("item_id").cast("long").alias("item_id")).where("size(sh) > 0").withColumn("iid", F.monotonically_increasing_id()))
    total = items.count()
    where = items.select("iid", "item_id", "n", F.posexplode("sh").alias("ipos", "h"))
    weights = where.groupBy("h").agg(F.countDistinct("iid").alias("df")).select("h", (1 + F.log(F.lit(float(max(1, total))) / F.col("df"))).alias("w"))
    rare = 1 + float(np.log(max(1, total)))
    weighed = where.select("iid", "h").distinct().join(weights, "h").groupBy("iid").agg(F.collect_list(F.struct("h", "w")).alias("shingles"), F.sum("w").alias("all_w"))
    known = staged(items.select("iid", "item_id", "sh", "n", _fingerprint("sh").alias("item_f")).join(weighed, "iid"))
    bits = F.lit(_bitmap(where.select("h").distinct()))

    def probe(h, k: int):
        word = F.get(bits, F.shiftrightunsigned(h, 19 * k + 6).bitwiseAND(F.lit(BITS // 64 - 1)).cast("int"))
        return F.call_function("shiftright", word, F.shiftrightunsigned(h, 19 * k).bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1

    marked = F.transform("sh", lambda h, p: F.when(probe(h, 0) & probe(h, 1) & probe(h, 2), F.struct(p.alias("p"), h.alias("h"))))
    hit = F.filter(marked, lambda x: x.isNotNull())
    found = bound(_worded(docs, width, F.col("doc_id").cast("long").alias("doc_id")), hits=hit).where("size(hits) > 0")
    found = staged(found.withColumn("rid", F.monotonically_increasing_id()))
    hits = found.select("rid", F.col("n").alias("dn"), F.explode("hits").alias("x")).select("rid", "dn", F.col("x.p").alias("p"), F.col("x.h").alias("h"))
    held = where.select("iid", "n", "h").distinct().join(weights, "h")
    held = beside(hits, held, "h", "rid").groupBy("rid", "iid", "n", "dn").agg(F.collect_list("p").alias("ps"), F.collect_set(F.struct("h", "w")).alias("ws"))
    # what isn't shared only adds to the union: too little in the whole document or in a window is below the threshold
    least = f"{threshold} * all_w - 1e-9"
    held = held.join(known.select("iid", "all_w"), "iid").where(f"aggregate(ws, 0D, (s, x) -> s + x.w) >= {least}")
    over = F.expr(f"array_distinct(flatten(transform(ps, p -> sequence(least(greatest(0, p - n + {width}), greatest(0, dn - n)), least(p, greatest(0, dn - n))))))")
    held = held.select("rid", "iid", "n", "all_w", over.alias("starts"), F.expr("transform(ws, x -> x.h)").alias("hs"), F.map_from_entries("ws").alias("wm"))
    cut = F.expr(f"transform(starts, i -> struct(i as start, slice(sh, i + 1, greatest(1, n - {width - 1})) as win))")
    laid = bound(found.select("rid", "doc_id", "sh").join(held, "rid"), laid=cut)
    enough = F.expr(f"filter(laid, x -> aggregate(array_intersect(x.win, hs), 0D, (s, h) -> s + wm[h]) >= {least})")
    # a window is one of its document, place and size, whichever items it was laid for
    windows = laid.select("rid", "doc_id", "n", F.explode(enough).alias("w")).select("rid", "doc_id", "n", "w.start", "w.win")
    windows = windows.groupBy("rid", "n", "start").agg(F.first("doc_id").alias("doc_id"), F.first("win").alias("win"))
    windows = staged(windows.select("*", _fingerprint("win").alias("f")))
    keyed = windows.select("rid", "n", "start", F.explode(_blocks(radius)).alias("b")).select("rid", "n", "start", "b.*")
    index = known.select("iid", "n", F.col("item_f").alias("f")).select("iid", "n", F.explode(_blocks(radius)).alias("b")).select("iid", "n", "b.*")
    agree = beside(keyed, index, ["n", "i", "v"], "rid").select("rid", "n", "start", "iid").distinct()
    near = windows.join(agree, ["rid", "n", "start"]).join(known.drop("n"), "iid")
    near = near.withColumn("hamming", F.bit_count(F.col("f").bitwiseXOR(F.col("item_f")))).where(F.col("hamming") <= radius)
    near = bound(near, both=F.expr("filter(shingles, x -> array_contains(win, x.h))"))
    shared = F.aggregate("both", F.lit(0.0), lambda s, x: s + x["w"])
    similarity = shared / (F.col("all_w") + rare * (F.size(F.array_distinct("win")) - F.size("both")))
    near = bound(near, similarity=similarity).where(F.col("similarity") >= threshold - 1e-12)
    best = F.max_by(F.struct("start", "n", "hamming", "similarity"), F.struct("similarity", -F.col("start")))
    return near.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", F.col("b.start").alias("start_word"), F.col("b.n").alias("n_words"), F.col("b.hamming").alias("hamming"), F.col("b.similarity").alias("similarity"))

"""N-gram Jaccard join by PartEnum signatures.

Sets of shingle hashes are put in bands of about equal size. Two sets of a band pair whose Jaccard similarity reaches the
threshold differ in at most k elements. The hash domain is cut into n1 parts, so that in some part at most k2 of them
differ; each part is cut into n2 again, and every subset of n2 - k2 of these gives one signature of the elements in it. Two
such sets share a signature, so equal signatures find every pair. With parts cut in halves, at most k of the halves differ, so
with a few spare parts two such sets share more signatures than one. Each set may then leave out as many, less one, as long
as all leave out the first ones by one order of all signatures: the last that two sets share is never left out. The first
are those of halves without elements, then those that most sets have, such as a half with one frequent shingle only.
Without that, what a signature's sets are compared for grows with the square of the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusgraph.llm.components import components
from corpusgraph.llm.staging import release, staged
from corpusgraph.llm.words import U, blocks, mix, shingles

HOT = 256  # sets of one signature that are met in one task; those of a larger group are spread
BLOCK_SETS, BLOCK_ITEMS = 512, 200_000  # of the blocks in which a component's sets are compared
FILTER_BITS = 1 << 25  # fixed size of the filter of wanted sets: 4 MB, whatever the input


@lru_cache(maxsize=4096)
def plan(top: int, upper: int, percent: int) -> tuple[int, int, int, int, int, int] | None:
    """(k, n1, k2, n2, empty, crowded) for two sets of at most top and upper elements; None if only equal sets can be similar.

    A set may leave out as many signatures of halves without elements, and as many of those that most sets have.
    """
    k = (100 - percent) * (top + upper) // (100 + percent)
    if k == 0:
        return None
    if k <= 3:
        return k, 1, k, k + (2 if k == 1 else 3), 0, 0
    parts = (k + 2) // 2
    n1 = parts + max(3, -(-parts // 12))
    out = 2 * n1 - k - 1  # similar sets share one more signature at least
    crowded = min(15, out - out // 3)
    return k, n1, 1, 2, out - crowded, crowded


@lru_cache(maxsize=4096)
def bands(n: int, percent: int) -> tuple[tuple[int, int, int], ...]:
    """(band pair, largest size of the smaller set, largest of the other) for each band pair that a set of n is in."""
    low, i = 1, 0
    while True:
        top = max(low, low * 7 // 5)
        if n <= top:
            break
        low, i = top + 1, i + 1
    out = [(2 * i, top, top)]
    if n * 100 >= percent * (top + 1):
        out.append((2 * i + 1, top, top * 100 // percent))
    if i and (low - 1) * 100 >= percent * n:
        out.append((2 * i - 1, low - 1, (low - 1) * 100 // percent))
    return tuple(out)


def sketch_class(top: int) -> int:
    """log2 of the 64-bit words of the parity sketches in which sets of at most top elements are compared.

    About a bit for each element tells most sets apart. Near the threshold sets differ in few elements, no two of which should
    meet in a cell: 2048 bits at least let hardly a pair pass that isn't similar, in large groups of sets that almost are.
    """
    return max(5, (top - 1).bit_length() - 6)


def signatures(items: np.ndarray, percent: int) -> np.ndarray:
    """PartEnum signatures of one set, given as distinct uint64 hashes.

    The last four bits are the band pair's sketch class, four more how many crowded ones may be left out, and two more tell
    a set's band pairs apart.
    """
    out = []
    where = mix(items ^ U(0x5851F42D4C957F2D)) >> U(16)
    value = mix(items + U(0x14057B7EF767814F))
    for pair, top, upper in bands(len(items), percent):
        if (how := plan(top, upper, percent)) is None:
            continue
        _, n1, k2, n2, empty, crowded = how
        cell = (where % U(n1 * n2)).astype(np.int64)
        order = np.argsort(cell, kind="stable")
        total = np.zeros(len(items) + 1, dtype=np.uint64)
        np.cumsum(value[order], out=total[1:])
        at = np.searchsorted(cell[order], np.arange(n1 * n2 + 1))
        sums = (total[at[1:]] - total[at[:-1]]).reshape(n1, n2)
        full = np.diff(at).reshape(n1, n2)
        name = np.arange(n1, dtype=np.uint64) * U(1 << 16) + U(pair * (1 << 40))
        got, has = [], []
        for s, subset in enumerate(combinations(range(n2), n2 - k2)):
            got.append(mix(sums[:, subset].sum(axis=1, dtype=np.uint64) + mix(name + U(s + 1))))
            has.append(full[:, subset].sum(axis=1) > 0)
        got, has = np.concatenate(got), np.concatenate(has)
        has[np.flatnonzero(~has)[empty:]] = True
        out.append((got[has] & ~U(1023)) | U(pair % 4 << 8 | crowded << 4 | min(15, sketch_class(top))))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def _sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, distinct shingle hashes in order) of each text that has words."""
    for block in blocks(column):
        for i in np.flatnonzero(block.count):
            items = np.sort(shingles(block.hash[block.at[i] : block.at[i + 1]], width))
            yield block.first + int(i), items[np.flatnonzero(np.diff(items, prepend=items[:1] ^ U(1)))]


def _node(items: np.ndarray) -> int:
    return int(mix(np.sum(mix(items ^ U(0xA0761D6478BD642F)), dtype=np.uint64, keepdims=True) + U(len(items))).view(np.int64)[0])


def _parity(items: np.ndarray, kind: int) -> np.ndarray:
    """A bit for each of 64 * 2 ** kind cells of the hash domain: whether it holds an odd number of elements."""
    cells = 64 << kind
    cell = (items & U(cells - 1)).astype(np.int64)
    return np.packbits((np.bincount(cell, minlength=cells) & 1).astype(np.uint8)).view(np.int64)


def _described(width: int, percent: int):
    longs = pa.list_(pa.int64())
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64()), ("chk", pa.int64()), ("sketch", longs), ("lower", longs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            size, node, chk = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            sketch, lower = [None] * n, [None] * n  # in the class of the set's own band, and of the band below if that differs
            for i, items in _sets(batch.column("text"), width):
                size[i], node[i] = len(items), _node(items)
                chk[i] = np.sum(mix(items + U(0xE7037ED1A0B428DB)), dtype=np.uint64).view(np.int64)
                kinds = list(dict.fromkeys(min(15, sketch_class(top)) for _, top, _ in bands(len(items), percent)))
                sketch[i] = _parity(items, kinds[0])
                if len(kinds) > 1:
                    lower[i] = _parity(items, kinds[1])
            none = size == 0
            yield pa.record_batch([batch.column("doc_id").cast(pa.int64()), pa.array(size), pa.array(node, mask=none), pa.array(chk, mask=none), pa.array(sketch, longs), pa.array(lower, longs)], schema=schema)

    return run


def _signed(width: int, percent: int):
    schema = pa.schema([("sig", pa.int64()), ("node", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # of this partition's input split: its copies give signatures once
        for batch in batches:
            sigs, nodes, held = [], [], 0
            for _, items in _sets(batch.column(0), width):
                if (node := _node(items)) in seen:
                    continue
                seen.add(node)
                got = signatures(items, percent)
                sigs.append(got)
                nodes.append(np.full(len(got), node, dtype=np.int64))
                held += len(got)
                if held > 100_000:
                    yield pa.record_batch([np.concatenate(sigs).view(np.int64), np.concatenate(nodes)], schema=schema)
                    sigs, nodes, held = [], [], 0
            if held:
                yield pa.record_batch([np.concatenate(sigs).view(np.int64), np.concatenate(nodes)], schema=schema)

    return run


def _wanted(width: int, bits: np.ndarray):
    schema = pa.schema([("node", pa.int64()), ("items", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            at = (mix(ids) % U(FILTER_BITS)).astype(np.int64)
            batch = batch.filter(pa.array((bits[at >> 3] >> (at & 7)) & 1 == 1))
            nodes, sets, held = [], [], 0
            for _, items in _sets(batch.column("text"), width):
                if (node := _node(items)) in seen:
                    continue
                seen.add(node)
                nodes.append(node)
                sets.append(items.view(np.int64))
                held += len(items)
                if held > 100_000:
                    yield _listed(nodes, sets, schema)
                    nodes, sets, held = [], [], 0
            if nodes:
                yield _listed(nodes, sets, schema)

    return run


def _listed(nodes: list, sets: list, schema: pa.Schema) -> pa.RecordBatch:
    at = np.zeros(len(sets) + 1, dtype=np.int32)
    np.cumsum([len(x) for x in sets], out=at[1:])
    return pa.record_batch([pa.array(nodes, pa.int64()), pa.ListArray.from_arrays(at, np.concatenate(sets))], schema=schema)


def _filter_of(ids: DataFrame) -> np.ndarray:
    """A bit for each id's hash, in FILTER_BITS bits: rows that pass beside it only cost time."""

    def run(batches):
        for batch in batches:
            at = (mix(batch.column(0).to_numpy().view(np.uint64)) % U(FILTER_BITS)).astype(np.int64)
            yield pa.record_batch([pa.array(at >> 15), pa.array(at & 32767)], names=["bucket", "place"])

    rows = ids.mapInArrow(run, "bucket long, place long").groupBy("bucket").agg(F.expr("bitmap_construct_agg(place)").alias("bits")).collect()
    out = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for row in rows:  # at most FILTER_BITS / 32768 rows of 4 KB
        out[row["bucket"] * 4096 : (row["bucket"] + 1) * 4096] = np.frombuffer(bytes(row["bits"]), dtype=np.uint8)[:4096]
    return out


def _linked(docs: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets really are similar: the sets of documents da and db are made again and compared."""
    ends = pairs.select(F.col("da").alias("d")).unionAll(pairs.select("db"))
    spread = docs.sparkSession.sparkContext.broadcast(_filter_of(ends))

    def run(batches):
        yield from _wanted(width, spread.value)(batches)

    sets = docs.mapInArrow(run, "node long, items array<long>")
    left, right = sets.select(F.col("node").alias("a"), F.col("items").alias("x")), sets.select(F.col("node").alias("b"), F.col("items").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    found = pairs.select("a", "b").join(right, "b").join(left, "a").where(100 * both >= percent * (F.size("x") + F.size("y") - both))
    return found.select("a", "b").distinct()


def _met(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(sig, node, many): the signatures that different sets share, each set without its crowded ones; many rows had sig."""
    signed = docs.select("text").mapInArrow(_signed(width, percent), "sig long, node long")
    bucket = W.partitionBy("sig")
    met = signed.select("*", F.min("node").over(bucket).alias("lo"), F.max("node").over(bucket).alias("hi"), F.count("*").over(bucket).alias("many"))
    met = met.where("lo <> hi").groupBy("sig", "node").agg(F.first("many").alias("many"))
    order = W.partitionBy("node", F.expr("sig & 768")).orderBy(F.desc("many"), "sig")
    return met.withColumn("place", F.row_number().over(order)).where("place > (sig & 240) / 16").drop("place")


def _partners(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """For each set, how many similar ones it meets, if those at left meet those at right; the same places are met once."""
    size = np.array([len(x) for x in sets])
    _, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), size)
    shared = often[column] > 1
    row, column = row[shared], (np.cumsum(often > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(left), len(right)), np.float32)  # whole numbers below 2 ** 24
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, [first, first + 4096])
        has = np.zeros((len(sets), 4096), np.float32)
        has[row[a:b], column[a:b] - first] = 1
        both += has[left] @ has[right].T
    alike = 100 * both.astype(np.int64) >= percent * (size[left][:, None] + size[right][None, :] - both.astype(np.int64))
    alike &= left[:, None] != right[None, :]
    out = np.zeros(len(sets), np.int64)
    out[left] += alike.sum(axis=1)
    if not np.array_equal(left, right):
        out[right] += alike.sum(axis=0)
    return out


def _counted(docs: DataFrame, members: DataFrame, width: int, percent: int) -> DataFrame:
    """members(node, component, n, doc_id) -> (node, n_links): all similar sets of each, all of which its component holds.

    Large components are cut into blocks of about BLOCK_SETS sets or BLOCK_ITEMS elements by a hash, and each pair of
    blocks is compared once; small components are compared many in a group.
    """
    whole = members.groupBy("component").agg(F.count("*").alias("c"), F.sum("n").alias("m")).where("c > 1")
    members = staged(members.join(whole, "component").withColumn("k", F.greatest(F.ceil(F.col("c") / BLOCK_SETS), F.ceil(F.col("m") / BLOCK_ITEMS))))
    groups = 1 + (members.agg(F.sum("n")).first()[0] or 0) // BLOCK_ITEMS
    some = members.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("k"))).select("node", "component", "k", "mine", F.explode(F.expr("sequence(0, k - 1)")).alias("other"))
    part = F.when(F.col("k") == 1, F.pmod(F.xxhash64("component"), F.lit(groups))).otherwise(F.col("component"))
    some = some.select("node", "component", "mine", part.alias("part"), F.col("k").alias("k"), F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    # null ids are 0 here: the filter only has to let every wanted document pass
    spread = docs.sparkSession.sparkContext.broadcast(_filter_of(members.select(F.coalesce("doc_id", F.lit(0)).alias("d"))))
    known = docs.withColumn("doc_id", F.coalesce("doc_id", F.lit(0)))

    def made(batches):
        yield from _wanted(width, spread.value)(batches)

    def compare(table: pa.Table) -> pa.Table:
        nodes, comps, mine = (table.column(c).to_numpy() for c in ("node", "component", "mine"))
        items = table.column("items").combine_chunks()
        at, flat = items.offsets.to_numpy(), items.values.to_numpy()
        order = np.lexsort((nodes, comps))
        order = order[np.flatnonzero(np.diff(nodes[order], prepend=nodes[order[0]] ^ 1))]  # one set for each node
        got = []
        for own in np.split(order, np.flatnonzero(np.diff(comps[order])) + 1):
            sides = np.unique(mine[own])
            left, right = np.flatnonzero(mine[own] == sides[0]), np.flatnonzero(mine[own] == sides[-1])
            # of two blocks that are met, one may hold no set
            if len(sides) == 1 and table.column("i")[0].as_py() != table.column("j")[0].as_py():
                right = right[:0]
            got.append(_partners([flat[at[x] : at[x + 1]] for x in own], left, right, percent))
        return pa.table({"node": pa.array(nodes[order], pa.int64()), "links": pa.array(np.concatenate(got), pa.int64())})

    sets = known.mapInArrow(made, "node long, items array<long>")
    met = some.join(sets, "node").groupBy((F.col("k") == 1).alias("small"), "part", "i", "j")
    found = met.applyInArrow(compare, "node long, links long")
    return found.groupBy("node").agg(F.sum("links").alias("n_links"))


def _possible(percent: int):
    """What sizes and parity sketches pa, pb of one class allow: sketches differ in no more bits than the sets in elements."""
    apart = lambda i: F.bit_count(F.get("pa", F.lit(i)).bitwiseXOR(F.get("pb", F.lit(i))))
    bits = F.aggregate(F.zip_with("pa", "pb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, c: s + c)
    for words in (32, 16, 8):  # in generated code, not in a lambda
        bits = F.when(F.size("pa") == words, sum((apart(i) for i in range(1, words)), apart(0))).otherwise(bits)
    sizes = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    return sizes & ((F.size("pa") != F.size("pb")) | ((100 + percent) * bits <= (100 - percent) * (F.col("na") + F.col("nb"))))


def jaccard_components(docs: DataFrame, percent: int = 85, width: int = 4, links: bool = True) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_shingles, component_id, n_links); without n_links if links is False.

    A document's set holds its distinct shingles of width words; two documents link when 100 * intersection >= percent *
    union. component_id is the smallest doc_id that links reach. n_links counts the different sets that link to the
    document's set. Documents with equal sets share one node. Each set leaves out the signatures that most sets have, as many
    as can't hide a link. A signature's sets are first compared with the set that shares most signatures; after that, only
    sets of one signature that aren't connected yet are compared with each other, so every link between components is found
    without all pairs of a group; groups of more than HOT sets are spread over tasks. Before sets are compared, their sizes
    and parity sketches, of a bit or more for each element, must allow the similarity. Links are then counted among all sets
    of each component.

    Null and blank texts have an empty set (n_shingles 0) and are their own component; repeated doc_ids count as rows of
    one document; a null doc_id gives a null component_id of its own unless linked; other columns, whatever their names,
    aren't read. Two different sets with one 64-bit node hash are an error, never a wrong link. An empty table gives an
    empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = staged(docs.mapInArrow(_described(width, percent), "doc_id long, n_shingles long, node long, chk long, sketch array<long>, lower array<long>"))
    nodes = staged(known.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("n_shingles").alias("n"), F.first("sketch").alias("sketch"), F.first("lower").alias("lower"), F.min("chk").alias("c1"), F.max("chk").alias("c2"), F.max("n_shingles").alias("n2")))
    if nodes.where("c1 <> c2 or n <> n2").limit(1).count():
        raise ValueError("two different sets share a 64-bit hash: change the constants of _node")
    shared = staged(_met(docs, width, percent))
    weight = shared.groupBy("node").agg(F.sum("many").alias("weight"))
    # of a signature's sets, the one that shares most leads: a partial aggregate, so that a hot signature is no single task
    first = shared.join(weight, "node").groupBy("sig").agg(F.max_by("node", F.struct("weight", "node")).alias("a"))
    led = shared.join(first, "sig").select("a", F.col("node").alias("b"), F.col("sig").bitwiseAND(F.lit(15)).alias("kind")).where("a <> b").distinct()
    of_kind = lambda: F.when(F.size("sketch") == F.call_function("shiftleft", F.lit(1), F.col("kind").cast("int")), F.col("sketch")).otherwise(F.coalesce("lower", "sketch"))
    known_as = lambda e: nodes.select(F.col("node").alias(e), F.col("n").alias(f"n{e}"), F.col("sketch").alias(f"s{e}"), F.col("lower").alias(f"l{e}"), F.col("doc_id").alias(f"d{e}"))
    in_kind = lambda e: F.expr(f"if(size(s{e}) = shiftleft(1, cast(kind as int)), s{e}, coalesce(l{e}, s{e})) as p{e}")
    sized = led.join(known_as("a"), "a").join(known_as("b"), "b").select("a", "b", "da", "db", "na", "nb", in_kind("a"), in_kind("b"))
    led = staged(sized.where(_possible(percent)).select("a", "b", "da", "db").distinct())
    edges = staged(_linked(docs, led, width, percent))
    group = staged(components(edges))
    mine = shared.join(group, "node", "left").select("sig", "node", F.coalesce("component", "node").alias("comp"))
    mixed = mine.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("c")).where("lo <> hi").select("sig", F.ceil(F.col("c") / HOT).cast("int").alias("k"))
    apart = mine.join(mixed, "sig").withColumn("kind", F.col("sig").bitwiseAND(F.lit(15)))
    apart = apart.join(nodes.select("node", "n", "sketch", "lower", "doc_id"), "node").select("sig", "k", "node", "comp", "n", "doc_id", of_kind().alias("p"))
    x, y = (apart.select("sig", "k", F.col("node").alias(e), F.col("comp").alias(f"c{e}"), F.col("n").alias(f"n{e}"), F.col("p").alias(f"p{e}"), F.col("doc_id").alias(f"d{e}")) for e in "ab")
    x = x.withColumn("part", F.pmod(F.xxhash64("a"), F.col("k"))).drop("k")
    y = y.withColumn("part", F.explode(F.expr("transform(sequence(0, k - 1), i -> cast(i as bigint))"))).drop("k")
    rest = x.join(y, (x["sig"] == y["sig"]) & (x["part"] == y["part"]) & (F.col("ca") < F.col("cb")) & _possible(percent)).select("a", "b", "da", "db").distinct()
    tried = led.select("a", "b").unionAll(led.select(F.col("b"), F.col("a")))
    rest = staged(rest.join(tried, ["a", "b"], "left_anti"))
    release(shared)
    if rest.limit(1).count():
        more = staged(_linked(docs, rest, width, percent))
        if more.limit(1).count():
            edges = edges.unionAll(more)
            group = staged(components(edges))
    member = nodes.select("node", "doc_id").join(group, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("component"))
    least = member.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = member.join(least, "component").select("node", "component_id")
    out = known.select("doc_id", "n_shingles", "node").join(named, "node", "left").select("node", "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    if not links:
        return out.drop("node")
    counted = _counted(docs, group.select("node", "component").join(nodes.select("node", "n", "doc_id"), "node"), width, percent)
    return out.join(counted, "node", "left").select("doc_id", "n_shingles", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))

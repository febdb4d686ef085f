"""Hierarchical Pitman-Yor language model over words, seated by Gibbs sampling.

Each token is a customer in the restaurant of its context, the word before it (32 bits of its hash). All context
restaurants share one parent, the unigram restaurant, whose customers are their tables; its own tables share a base that is
even over the known words and one new word. In each sweep the number of tables of every (context, word), and then of every
word in the unigram restaurant, is drawn from its exact conditional distribution given the other totals as last exchanged.
Predictive probabilities are averaged over the sweeps after burn-in, each with the totals that go with its tables.

Counts are dealt to buckets by word, so that a word's tables are local to a bucket. What a bucket needs of others are the
totals of its contexts: it sends its own, in ranges of contexts, to the tasks that add them up, and is sent the sums. A
bucket's state is one row of packed arrays; a sweep reads it with the totals and writes the next. Words with a large share
of the corpus are spread over buckets by context, and their totals, a list of bounded length, go through the driver. At
the end the texts' tokens are dealt to the buckets, scored there and added up by document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.llm.staging import release, staged
from corpusgraph.llm.words import U, blocks, mix

CHUNK_TOKENS = 1 << 19
CHUNK_DOCS = 1 << 15
BUCKET_BYTES = 2 << 20  # of text for each bucket
SLICES = 2  # of the buckets, swept and scored one after the other so that less is on disk at once
PART_ENTRIES = 1 << 21  # of a bucket's (document, word, context) entries that one task scores
EXACT = 256  # customers of a dish up to which the number of its tables is drawn exactly
_END = U(0x9AE16A3B2F90404F)
_START = U(0xC949D7C7509E6557)
_HOME = U(0x2545F4914F6CDD1D)


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Chunks of (doc_ids, held, tokens of each document, distinct words, contexts, word, context and document of each token).

    A token's word is a place in the distinct words, its context one in the contexts: those after each word, then the start's.
    """
    ids, held, sizes, words, size, docs = [], [], [], [], 0, 0
    for batch in batches:
        key = batch.column("doc_id").cast(pa.int64())
        flag = batch.column("held_out").to_numpy(zero_copy_only=False)
        for block in blocks(batch.column("text"), 1 << 19):
            n = len(block.count)
            w = np.insert(block.hash, block.at[1:], _END)
            ids.append(key.slice(block.first, n))
            held.append(flag[block.first : block.first + n])
            sizes.append(block.count + 1)
            words.append(w)
            size, docs = size + len(w), docs + n
            if size >= CHUNK_TOKENS or docs >= CHUNK_DOCS // 2:
                yield from _cut(ids, held, sizes, words)
                ids, held, sizes, words, size, docs = [], [], [], [], 0, 0
    if docs:
        yield from _cut(ids, held, sizes, words)


def _cut(ids, held, sizes, words) -> Iterator[tuple]:
    key, flag, count = pa.concat_arrays(ids), np.concatenate(held), np.concatenate(sizes)
    w = np.concatenate(words)
    for a in range(0, len(count), CHUNK_DOCS):  # a block of empty texts may hold more documents than a chunk
        b = min(len(count), a + CHUNK_DOCS)
        lo, hi = int(count[:a].sum()), int(count[:b].sum())
        own, place = distinct(w[lo:hi])
        before = np.roll(place, 1)
        before[np.cumsum(count[a:b]) - count[a:b]] = len(own)
        contexts = (mix(np.append(own, _START)) >> U(32)).astype(np.uint32)
        yield key.slice(a, b - a), flag[a:b], count[a:b], own, contexts, place, before, np.repeat(np.arange(b - a), count[a:b])


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers of x in order, and where each of x is among them.

    Upper bits and places are sorted as one number, much faster than places by their numbers; should two different numbers
    have the same upper bits, np.unique does it.
    """
    bits = max(1, (len(x) - 1).bit_length())
    low = U((1 << bits) - 1)
    order = (np.sort((x & ~low) | np.arange(len(x), dtype=np.uint64)) & low).astype(np.int64)
    there = x[order]
    new = np.ones(len(x), bool)
    new[1:] = there[1:] != there[:-1]
    out = there[new]
    if len(out) > 1 and not ((out[1:] ^ out[:-1]) & ~low).all():
        return np.unique(x, return_inverse=True)
    place = np.empty(len(x), np.int64)
    place[order] = np.cumsum(new) - 1
    return out, place


def packed(x: np.ndarray) -> bytes:
    """Non-negative whole numbers as byte planes, the lowest first, up to the highest byte that any of them has."""
    x = np.ascontiguousarray(x, np.int64)
    planes = (int(x.max(initial=0)).bit_length() + 7) // 8
    return b"".join(x.view(np.uint8).reshape(-1, 8)[:, i].tobytes() for i in range(planes))


def unpacked(data: bytes, n: int) -> np.ndarray:
    """The n numbers of packed()."""
    out = np.zeros((n, 8), np.uint8)
    if n and data:
        out[:, : len(data) // n] = np.frombuffer(data, np.uint8).reshape(-1, n).T
    return out.view(np.int64)[:, 0]


def _home(words: np.ndarray, place: np.ndarray, k: np.ndarray, buckets: int, heavy: np.ndarray) -> np.ndarray:
    """The bucket of each (word, context); heavy words are spread by context."""
    home = (mix(words ^ _HOME) % U(buckets)).astype(np.int64)[place]
    if len(heavy):
        salted = np.isin(words, heavy)[place]
        home[salted] = (home[salted] + k[salted]) % buckets
    return home


def _dealt(home: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, its places) for the buckets that have any."""
    bits = max(1, len(home).bit_length())
    order = np.sort((home << bits) | np.arange(len(home)))  # stable, and faster than a sort of places
    home, order = order >> bits, order & ((1 << bits) - 1)
    cut = np.flatnonzero(np.diff(home, prepend=-1))
    for a, b in zip(cut, [*cut[1:], len(order)]):
        yield int(home[a]), order[a:b]


def _grouped(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal places begins, and its length."""
    first = np.flatnonzero(np.diff(places, prepend=-1))
    return first, np.diff(np.append(first, len(places)))


_COUNT_SQL = "bucket int, w binary, m binary, k binary, c binary, entries long"


def _counts(buckets: int, heavy: np.ndarray):
    """Rows of a chunk's (word, context) pairs with their training tokens, for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held, _, words, contexts, place, before, doc in _tokens(batches):
            bits = len(words).bit_length()
            key = np.sort((((place << bits) | before) << 1) | held[doc])
            first, entries = _grouped(key >> 1)
            train = np.add.reduceat(1 - (key & 1), first)
            pair = key[first] >> 1
            place, k = pair >> bits, contexts[pair & ((1 << bits) - 1)]
            rows = []
            for b, mine in _dealt(_home(words, place, k, buckets, heavy)):
                first, many = _grouped(place[mine])
                rows.append((b, words[place[mine][first]].tobytes(), packed(many), k[mine].tobytes(), packed(train[mine]), int(entries[mine].sum())))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), *[pa.binary()] * 4, pa.int64()))], names=["bucket", "w", "m", "k", "c", "entries"])

    return run


_CELL_SQL = "bucket int, entries long, words binary, m binary, k binary, n binary, p binary"

_ENTRY_SQL = "bucket int, salt int, chunk long, w binary, m binary, k binary, d binary, tf binary, docs binary"
_ENTRY = pa.schema([("bucket", pa.int32()), ("salt", pa.int32()), ("chunk", pa.int64()), *[(x, pa.binary()) for x in ("w", "m", "k", "d", "tf", "docs")]])


def _entries(buckets: int, heavy: np.ndarray, salts: dict[int, int], part_of: int):
    """Rows of a chunk's (word, context, document) entries for each bucket of a slice; slice 0 also has the chunk's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for number, (ids, held, count, words, contexts, place, before, doc) in enumerate(_tokens(batches)):
            chunk = (part << 24) + number
            mine = mix(words ^ _HOME) % U(buckets) % U(SLICES) == part_of
            mine = (mine | np.isin(words, heavy))[place]  # the others have no entries in this slice
            place, before, doc = place[mine], before[mine], doc[mine]
            bits = len(words).bit_length()
            if bits <= 24:
                key = np.sort((place << (bits + 15)) | (before << 15) | doc)
                first, tf = _grouped(key)
                key = key[first]
                place, before, d = key >> (bits + 15), (key >> 15) & ((1 << bits) - 1), (key & 32767).astype(np.uint16)
            else:
                order = np.lexsort((doc, before, place))
                place, before, doc = place[order], before[order], doc[order]
                first, tf = _grouped(np.cumsum((np.diff(place, prepend=-1) != 0) | (np.diff(before, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0)))
                place, before, d = place[first], before[first], doc[first].astype(np.uint16)
            k = contexts[before]
            table = b"".join((np.array([len(count)], np.int64).tobytes(), ids.fill_null(0).to_numpy().astype(np.int64).tobytes(), np.asarray(ids.is_null()).astype(np.uint8).tobytes(), held.astype(np.uint8).tobytes(), count.astype(np.int64).tobytes()))
            rows = []
            home = _home(words, place, k, buckets, heavy)
            own = np.flatnonzero(home % SLICES == part_of)
            if part_of == 0:  # to some bucket, with or without entries
                rows.append((chunk // SLICES * SLICES % (buckets - buckets % SLICES), 0, chunk, b"", b"", b"", b"", b"", table))
            for b, mine in ((b, own[x]) for b, x in _dealt(home[own])):
                first, many = _grouped(place[mine])
                rows.append((b, chunk % salts.get(b, 1), chunk, words[place[mine][first]].tobytes(), packed(many), k[mine].tobytes(), d[mine].tobytes(), packed(tf[mine]), None))
            if rows:
                yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*rows), _ENTRY)], schema=_ENTRY)

    return run


def _common(buckets: int):
    """(w, n) of words that have a large share of a batch, and the batch's size as word 0."""

    def run(batches):
        for _, _, _, words, _, place, _, _ in _tokens(batches):
            n = np.bincount(place)
            some = n >= max(8, len(place) // (8 * buckets))
            yield pa.record_batch([pa.array(np.append(words[some].view(np.int64), 0)), pa.array(np.append(n[some], len(place)).astype(np.int64))], names=["w", "n"])

    return run


def stirling(d: float, n: int) -> np.ndarray:
    """Logs of the generalised Stirling numbers S_d(c, t) for c and t up to n: ways to seat c customers at t tables."""
    out = np.full((n + 1, n + 1), -np.inf)
    out[1, 1] = 0.0
    t = np.arange(n + 1)
    for c in range(1, n):
        with np.errstate(divide="ignore", invalid="ignore"):
            stay = out[c] + np.log(np.maximum(c - d * t, 0))
        out[c + 1, 1:] = np.logaddexp(out[c, :-1], stay[1:])
    return out


def seated(rng: np.random.Generator, logs: np.ndarray, d: float, c: np.ndarray, odds: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Draws the number of tables of dishes with c customers each.

    odds(rows, j) is the log weight of a dish's table number j + 1, other things equal: t tables have the probability
    S_d(c, t) * exp(odds(0) + ... + odds(t - 1)), up to a constant. Up to EXACT customers the draw is exact; customers past
    those are seated in blocks an eighth as long as those before, within which the odds of a new table are constant.
    """
    t = np.minimum(c, 1).astype(np.int64)
    most = len(logs) - 1
    capped = np.minimum(c, most)
    rows = np.flatnonzero(capped >= 2)
    rows = rows[np.argsort(capped[rows], kind="stable")]
    first, many = _grouped(capped[rows])
    for a, n in zip(first, many):
        size = int(capped[rows[a]])
        j = np.arange(size)
        for at in range(a, a + n, max(1, (1 << 19) // size)):
            mine = rows[at : min(a + n, at + max(1, (1 << 19) // size))]
            weight = np.cumsum(odds(mine[:, None], j[None, :]), axis=1) + logs[size, 1 : size + 1]
            t[mine] = np.argmax(weight + rng.gumbel(size=weight.shape), axis=1) + 1
    rows = np.flatnonzero(c > most)
    rows = rows[np.argsort(-c[rows], kind="stable")]
    low = most
    while len(rows):
        step = max(1, low // 8)
        size = np.minimum(c[rows], low + step) - low
        new = np.exp(odds(rows, t[rows]))
        t[rows] += rng.binomial(size, np.clip(new / (low + (size - 1) / 2 - d * t[rows] + new), 0, 1))
        low += step
        rows = rows[c[rows] > low]
    return t


class Bucket:
    """A bucket's pairs, in order of word and context, and the numbers of tables of pairs and words."""

    PLAIN = {"words": np.uint64, "k": np.uint32, "acc": np.float32, "ctx": np.uint32}
    PACKED = {"m": "words", "c": "k", "t": "k", "r": "words", "own": "ctx", "cust": "ctx"}  # each as long as the other

    def __init__(self, row: dict, heavy: np.ndarray):
        for name, kind in self.PLAIN.items():
            setattr(self, name, np.frombuffer(row[name], kind))
        for name, other in self.PACKED.items():
            setattr(self, name, unpacked(row[name], len(getattr(self, other))))
        self.acc = self.acc if len(self.acc) else np.zeros(len(self.k), np.float32)
        self.number, self.entries = row["bucket"], row["entries"]
        self.word = np.repeat(np.arange(len(self.words)), self.m)
        self.at = distinct(self.k.astype(np.uint64) << U(32))[1]  # of a pair's context in ctx
        place = np.searchsorted(heavy, self.words)
        self.heavy = np.flatnonzero(heavy[np.minimum(place, len(heavy) - 1)] == self.words) if len(heavy) else np.zeros(0, np.int64)
        self.heavy_at = place[self.heavy]
        self.total = np.bincount(self.word, weights=self.c, minlength=len(self.words)).astype(np.int64)

    @classmethod
    def gathered(cls, number: int, chunks: list[dict], heavy: np.ndarray) -> Bucket:
        """From the rows of _counts(); each word that training has begins with a table in each of its contexts, and one in the unigram restaurant."""
        of = lambda name, kind: np.concatenate([np.frombuffer(c[name], kind) for c in chunks])
        words, place = distinct(of("w", np.uint64))
        ctx, at = distinct(of("k", np.uint32).astype(np.uint64) << U(32))
        ctx, bits = (ctx >> U(32)).astype(np.uint32), len(ctx).bit_length()
        spare = U(64 - bits - len(words).bit_length())
        place = np.repeat(place, np.concatenate([unpacked(c["m"], len(c["w"]) // 8) for c in chunks]))
        key, at = distinct(((place << bits) | at).astype(np.uint64) << spare)
        many = np.concatenate([unpacked(c["c"], len(c["k"]) // 4) for c in chunks])
        c = np.bincount(at, weights=many, minlength=len(key)).astype(np.int64)
        key = (key >> spare).astype(np.int64)
        word, at = key >> bits, key & ((1 << bits) - 1)
        k = ctx[at]
        known = np.bincount(word, weights=c, minlength=len(words)) > 0
        some = {"m": np.bincount(word, minlength=len(words)), "c": c, "t": np.minimum(c, 1), "r": known, "own": np.zeros(len(ctx)), "cust": np.bincount(at, weights=c, minlength=len(ctx))}
        row = {name: packed(x.astype(np.int64)) for name, x in some.items()} | {"words": words.tobytes(), "k": k.tobytes(), "acc": b"", "ctx": ctx.tobytes()}
        return cls(row | {"bucket": number, "entries": sum(x["entries"] for x in chunks)}, heavy)

    def row(self) -> dict:
        """The state to write, with what others need of it: tables by context, and the sums that go through the driver."""
        self.own = np.bincount(self.at, weights=self.t, minlength=len(self.ctx)).astype(np.int64)
        tables = self.by_word()
        light = np.ones(len(self.words), bool)
        light[self.heavy] = False
        sums = [(-1, self.t.sum(), self.r[light].sum()), (-2, (self.c == 1).sum(), (self.c == 2).sum()), (-3, ((tables == 1) & light).sum(), ((tables == 2) & light).sum()), (-4, ((self.total > 0) & light).sum(), self.c.sum())]
        sums += list(zip(self.heavy_at, self.total[self.heavy], tables[self.heavy]))
        return {"bucket": self.number, "entries": self.entries, "sums": np.array(sums, np.int64).tobytes(), **self._arrays()}

    def _arrays(self) -> dict:
        plain = {name: getattr(self, name).astype(kind).tobytes() for name, kind in self.PLAIN.items()}
        return plain | {name: packed(getattr(self, name)) for name in self.PACKED} | {"acc": self.acc.tobytes() if self.acc.any() else b""}

    def by_word(self) -> np.ndarray:
        return np.bincount(self.word, weights=self.t, minlength=len(self.words)).astype(np.int64)

    def word_counts(self, model: dict) -> np.ndarray:
        out = self.total.copy()
        out[self.heavy] = model["heavy_count"][self.heavy_at]
        return out

    def unigram(self, model: dict) -> tuple[np.ndarray, np.ndarray]:
        """Customers and tables of each word in the unigram restaurant."""
        customers, tables = self.by_word(), self.r.copy()
        customers[self.heavy], tables[self.heavy] = model["heavy_tables"][self.heavy_at], model["heavy_root"][self.heavy_at]
        return customers, tables

    def probability(self, model: dict, tables: np.ndarray) -> np.ndarray:
        """Predictive probability of each pair, given the tables of all contexts in ctx."""
        customers, root = self.unigram(model)
        parent = (customers - model["d0"] * root + (model["theta0"] + model["d0"] * model["root"]) * model["base"]) / (model["theta0"] + model["tables"])
        there = model["theta1"] + self.cust[self.at]
        return (self.c - model["d1"] * self.t) / there + (model["theta1"] + model["d1"] * tables[self.at]) / there * parent[self.word]

    def sweep(self, model: dict, tables: np.ndarray, seed: tuple) -> None:
        """Draws the tables of every pair, then of every word, given all other totals as they were after the last exchange."""
        rng = np.random.default_rng(seed)
        d1, d0 = model["d1"], model["d0"]
        many = np.flatnonzero(self.c >= 2)
        c, own, word = self.c[many], self.t[many], self.word[many]
        customers, root = self.unigram(model)
        others = model["theta1"] + d1 * (tables[self.at[many]] - own)
        rest = customers[word] - own
        kept = np.minimum(root[word], rest)  # tables of the word that the unigram restaurant has without these customers
        every = model["root"] - root[word] + kept
        even = (model["theta0"] + d0 * every) * model["base"]
        size = model["theta0"] + model["tables"] - own
        new = (kept == 0) * 1.0  # the first of them opens one

        def odds(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            opened = new[i] * (j > 0)
            up = rest[i] + j - d0 * (kept[i] + opened) + even[i] + d0 * opened * model["base"]
            return np.log(others[i] + d1 * j) + np.log(up) - np.log(size[i] + j)

        self.t = self.t.copy()
        self.t[many] = seated(rng, model["logs1"], d1, c, odds)
        customers = self.by_word()
        customers[self.heavy] = 0  # the driver seats these
        left = np.maximum(model["root"] - self.r, 0)
        self.r = seated(rng, model["logs0"], d0, customers, lambda i, j: np.log(model["theta0"] + d0 * (left[i] + j)) + np.log(model["base"]))


_STATE_SQL = "bucket int, entries long, sums binary, " + ", ".join(f"{x} binary" for x in (*Bucket.PLAIN, *Bucket.PACKED))


def _row(row: dict) -> pa.Table:
    kinds = {"bucket": pa.int32(), "entries": pa.int64()}
    names = ("bucket", "entries", "sums", *Bucket.PLAIN, *Bucket.PACKED)
    return pa.table({k: pa.array([row[k]], kinds.get(k, pa.binary())) for k in names})


def _ranges(groups: int):
    """Rows (group, bucket, ctx, own, cust) of a state's contexts in ranges, one for each group that has any."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ctx = np.frombuffer(row["ctx"], np.uint32)
                own, cust = unpacked(row["own"], len(ctx)), unpacked(row["cust"], len(ctx))
                first, many = _grouped(((ctx.astype(np.uint64) * U(groups)) >> U(32)).astype(np.int64))
                group = ((ctx[first].astype(np.uint64) * U(groups)) >> U(32)).astype(np.int32)
                cut = np.append(first, len(ctx))
                parts = [pa.array([f(x[a:b]) for a, b in zip(cut, cut[1:])], pa.binary()) for x, f in ((ctx, np.ndarray.tobytes), (own, packed), (cust, packed))]  # noqa: B023
                yield pa.record_batch([pa.array(group), pa.array(np.full(len(first), row["bucket"], np.int32)), *parts], names=["group", "bucket", "ctx", "own", "cust"])

    return run


def _added(table: pa.Table) -> pa.Table:
    """The totals of a range of contexts, as each bucket asked for them."""
    ctx = [np.frombuffer(x.as_py(), np.uint32) for x in table["ctx"]]
    _, at = distinct(np.concatenate(ctx).astype(np.uint64) << U(32))
    cut = np.cumsum([len(x) for x in ctx])[:-1]

    def total(name: str) -> pa.Array:
        each = np.concatenate([unpacked(x.as_py(), len(c)) for x, c in zip(table[name], ctx)])
        return pa.array([packed(x) for x in np.split(np.bincount(at, weights=each).astype(np.int64)[at], cut)], pa.binary())

    return pa.table([table["bucket"], table["group"], pa.array([len(c) for c in ctx], pa.int32()), total("own"), total("cust")], names=["bucket", "group", "n", "own", "cust"])


def _totals(state: DataFrame, groups: int) -> DataFrame:
    """(bucket, group, n, own, cust): all buckets' tables and customers of the contexts of each bucket."""
    some = state.select("bucket", "ctx", "own", "cust").mapInArrow(_ranges(groups), "group int, bucket int, ctx binary, own binary, cust binary")
    return some.groupBy("group").applyInArrow(lambda t: _added(t), "bucket int, group int, n int, own binary, cust binary")


def _summed(state: DataFrame) -> dict[int, tuple[int, int]]:
    """The buckets' sums by key: four of the whole, and one for each heavy word."""

    def run(batches):
        for batch in batches:
            rows = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in batch.column(0)]).reshape(-1, 3)
            yield pa.record_batch([pa.array(np.ascontiguousarray(c)) for c in rows.T], names=["key", "a", "b"])

    rows = state.select("sums").mapInArrow(run, "key long, a long, b long").groupBy("key").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return {r["key"]: (r["a"], r["b"]) for r in rows.collect()}  # as many as there are heavy words, and four


def _cells(bucket: Bucket, model: dict, averaged: int) -> pa.Table:
    """What scoring needs of a bucket: training tokens of its words, and averaged probabilities of its pairs."""
    row = {"words": bucket.words.tobytes(), "m": packed(bucket.m), "k": bucket.k.tobytes(), "n": packed(bucket.word_counts(model)), "p": (bucket.acc / averaged).tobytes()}
    return pa.table({"bucket": pa.array([bucket.number], pa.int32()), "entries": pa.array([bucket.entries]), **{x: pa.array([v], pa.binary()) for x, v in row.items()}})


def score(docs: DataFrame, sweeps: int = 3, burn_in: int = 1, seed: int = 1, fold: int = 1, folds: int = 5, strength: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document.

    Tokens are words without ASCII white space, A to Z lower-cased, then one end. Documents whose crc32(doc_id as text)
    mod folds is fold are held out; all others train. score is the log10 probability of the text's tokens, each after the
    one before; a token outside training has the probability of a new word. base_score is the add-half unigram's.
    Discounts come from the counts of ones and twos. Perplexity per token is 10 ** (-score / n_tokens). Null texts
    are empty: one token, the end. A null doc_id isn't held out. Repeated rows train and are scored as often as they
    appear; other columns aren't read. An empty table gives an empty result; without training documents every token is
    unknown.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold, F.lit(False)).alias("held_out"))
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(SLICES, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    # which words are spread over buckets only changes where work is done: a sample of fixed size finds them
    part = docs.sample(min(1.0, (64 << 20) / size), seed) if size else docs
    common = part.mapInArrow(_common(buckets), "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))
    limit = max(64, (common.where("w = 0").agg(F.sum("n")).first()[0] or 0) // (4 * buckets))
    heavy = np.sort(np.array([r["w"] for r in common.where(f"w <> 0 and n >= {limit}").select("w").collect()], dtype=np.int64).view(np.uint64))  # 4 * buckets at most
    known = spark.sparkContext.broadcast(heavy)

    def count(batches):
        yield from _counts(buckets, known.value)(batches)

    def gather(table: pa.Table) -> pa.Table:
        return _row(Bucket.gathered(table["bucket"][0].as_py(), table.to_pylist(), known.value).row())

    state = staged(docs.mapInArrow(count, _COUNT_SQL).groupBy("bucket").applyInArrow(gather, _STATE_SQL))
    sums = _summed(state)
    if not sums:
        release(state)
        return spark.createDataFrame([], "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    of_heavy = lambda i: np.array([sums.get(j, (0, 0))[i] for j in range(len(heavy))], np.int64)
    (ones, twos), (lone, pairs), (kinds, n_train) = sums[-2], sums[-3], sums[-4]
    heavy_count = of_heavy(0)
    kinds, lone, pairs = kinds + int((heavy_count > 0).sum()), lone + int((of_heavy(1) == 1).sum()), pairs + int((of_heavy(1) == 2).sum())
    share = lambda a, b: float(min(0.95, max(0.05, a / (a + 2 * b)))) if a + b else 0.5
    fixed = {"d1": share(ones, twos), "d0": share(lone, pairs), "theta0": strength[0], "theta1": strength[1], "base": 1 / (kinds + 1), "heavy_count": heavy_count}
    root = (heavy_count > 0).astype(np.int64)
    logs0 = stirling(fixed["d0"], EXACT)
    ways = spark.sparkContext.broadcast({"logs0": logs0, "logs1": stirling(fixed["d1"], EXACT)})
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), buckets // 8)

    def model_of(sums: dict, root: np.ndarray) -> dict:
        return fixed | {"heavy_tables": of_heavy(1), "heavy_root": root, "tables": sums[-1][0], "root": sums[-1][1] + int(root.sum())}

    averaged = max(1, sweeps + 1 - burn_in)

    def swept(sent, number: int, last: bool):
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            model, bucket = sent.value, Bucket(left.to_pylist()[0], known.value)
            got = sorted(right.to_pylist(), key=lambda x: x["group"])
            tables = np.concatenate([unpacked(x["own"], x["n"]) for x in got])
            if number == 0:
                bucket.cust = np.concatenate([unpacked(x["cust"], x["n"]) for x in got])
            if number >= burn_in or last:
                bucket.acc = bucket.acc + bucket.probability(model, tables).astype(np.float32)
            if last:
                return _cells(bucket, model, averaged)
            bucket.sweep(model | ways.value, tables, (seed, number, bucket.number))
            return _row(bucket.row())

        return run

    tables = [state]
    # the totals of the tables after s sweeps are those of exchange s, so the averaged probabilities of each sweep add up
    for s in range(sweeps + 1):
        sent = spark.sparkContext.broadcast(model_of(sums, root))
        totals, schema = staged(_totals(state, groups)), _CELL_SQL if s == sweeps else _STATE_SQL
        new = []
        for i in range(SLICES):
            mine = [t.where(F.col("bucket") % SLICES == i).groupBy("bucket") for t in (state, totals)]
            new.append(staged(mine[0].cogroup(mine[1]).applyInArrow(swept(sent, s, s == sweeps), schema)))
        release(totals, *tables)
        tables, state = new, reduce(DataFrame.unionAll, new)
        if s < sweeps:
            sums = _summed(state)
            spread = sum(x[1] for k, x in sums.items() if k == -1) + int(root.sum()) - root
            d0, theta0, base = fixed["d0"], fixed["theta0"], fixed["base"]
            root = seated(np.random.default_rng((seed, s)), logs0, d0, of_heavy(1), lambda i, j: np.log(theta0 + d0 * (spread[i] + j)) + np.log(base))
    salts = {r["bucket"]: r["n"] for r in state.select("bucket", (1 + F.floor(F.col("entries") / PART_ENTRIES)).alias("n")).where("n > 1").collect()}  # buckets with a hot pair

    def dealing(part_of: int):
        def run(batches):
            yield from _entries(buckets, known.value, salts, part_of)(batches)

        return run

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            cell = right.to_pylist()[0]
            words, k = np.frombuffer(cell["words"], np.uint64), np.frombuffer(cell["k"], np.uint32)
            logs = np.log10(np.frombuffer(cell["p"], np.float32).astype(np.float64))
            n = unpacked(cell["n"], len(words))
            base = np.log10((n + 0.5) / (n_train + 0.5 * (kinds + 1)))
            key = (np.repeat(np.arange(len(words), dtype=np.uint64), unpacked(cell["m"], len(words))) << U(32)) | k
        for row in left.to_pylist():
            if not row["w"]:
                out.append((row["chunk"], b"", b"", b"", b"", row["docs"]))
                continue
            own = np.frombuffer(row["w"], np.uint64)
            place = np.repeat(np.searchsorted(words, own), unpacked(row["m"], len(own)))
            pair = np.searchsorted(key, (place.astype(np.uint64) << U(32)) | np.frombuffer(row["k"], np.uint32))
            tf = unpacked(row["tf"], len(pair))
            doc, at = np.unique(np.frombuffer(row["d"], np.uint16), return_inverse=True)
            add = lambda x: np.bincount(at, weights=x * tf, minlength=len(doc))  # noqa: B023, E731
            out.append((row["chunk"], doc.tobytes(), add(base[place]).tobytes(), add(logs[pair]).astype(np.float32).tobytes(), packed(add(n[place] > 0)), row["docs"]))
        names = ("chunk", "d", "base", "score", "known", "docs")
        return pa.table({n: pa.array([x[i] for x in out], pa.binary() if i else pa.int64()) for i, n in enumerate(names)})

    def summed(table: pa.Table) -> pa.Table:
        docs_of = next(x.as_py() for x in table["docs"] if x.is_valid)
        n = int(np.frombuffer(docs_of, np.int64, 1)[0])
        ids, rest = np.frombuffer(docs_of, np.int64, n, 8), 8 + 8 * n
        null, held = np.frombuffer(docs_of, np.uint8, n, rest), np.frombuffer(docs_of, np.uint8, n, rest + n)
        many = np.frombuffer(docs_of, np.int64, n, rest + 2 * n)
        base, value, seen = np.zeros(n), np.zeros(n), np.zeros(n)
        for r in table.select(["d", "base", "score", "known"]).to_pylist():
            d = np.frombuffer(r["d"], np.uint16)
            base[d] += np.frombuffer(r["base"])
            value[d] += np.frombuffer(r["score"], np.float32)
            seen[d] += unpacked(r["known"], len(d))
        columns = [pa.array(ids, mask=null.astype(bool)), pa.array(held.astype(bool)), pa.array(many), pa.array(seen.astype(np.int64)), pa.array(np.full(n, n_train, np.int64)), pa.array(base), pa.array(value)]
        return pa.table(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    cells = state.withColumn("salt", F.explode(F.expr(f"sequence(0, cast(floor(entries / {PART_ENTRIES}) as int))")))
    parts = None
    for i in range(SLICES):
        own = cells.where(F.col("bucket") % SLICES == i)
        got = docs.mapInArrow(dealing(i), _ENTRY_SQL).groupBy("bucket", "salt").cogroup(own.groupBy("bucket", "salt")).applyInArrow(scored, "chunk long, d binary, base binary, score binary, known binary, docs binary")
        got = staged(got)
        parts = got if parts is None else parts.unionAll(got)
    release(*tables)
    return parts.groupBy("chunk").applyInArrow(summed, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")

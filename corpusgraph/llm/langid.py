"""Language identification with interpolated Kneser-Ney character models in sorted hash arrays."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.llm.staging import sent
from corpusgraph.llm.words import U, mix

_ALPHA = np.zeros(0x110000, dtype=bool)
_NONE = "und"


def _letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text, with each run of others than letters as one 0; 0 at both ends if any letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return _squeezed(points, np.zeros(1, np.int64))[0]


def _alpha() -> np.ndarray:
    if not _ALPHA[97]:
        _ALPHA[:] = [chr(i).isalpha() for i in range(0x110000)]
    return _ALPHA


def _squeezed(points: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squeezed code points of joined texts that begin at first (each text follows a 0), and where each now begins."""
    points = np.where(_alpha()[points], points, 0).astype(np.uint64)
    keep = np.ones(len(points), dtype=bool)
    keep[1:] = (points[1:] != 0) | (points[:-1] != 0)
    at = np.concatenate([[0], np.cumsum(keep)])
    return points[keep], at[first]


class Table(NamedTuple):
    """Sorted hashes of n-grams, the start of each hash prefix in them, and a row of floats for each."""

    keys: np.ndarray
    start: np.ndarray
    shift: int
    longest: int
    rows: np.ndarray


def _table(keys: np.ndarray, rows: np.ndarray) -> Table:
    order = np.argsort(keys)
    keys, rows = keys[order], rows[order]
    bits = max(4, int(len(keys)).bit_length() + 1)
    start = np.searchsorted(keys >> U(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)
    return Table(np.append(keys, U(0xFFFFFFFFFFFFFFFF)), start, 64 - bits, int(np.diff(start).max(initial=0)), rows)


def _find(table: Table, keys: np.ndarray) -> np.ndarray:
    """The row of each key, or -1."""
    at = table.start[(keys >> U(table.shift)).astype(np.int64)].astype(np.int64)
    last = len(table.keys) - 1
    found = table.keys[at] == keys
    out = np.where(found, at, -1)
    todo = np.flatnonzero(~found & (table.keys[at] < keys))
    for step in range(1, table.longest + 1):
        if not len(todo):
            break
        now = np.minimum(at[todo] + step, last)
        value = table.keys[now]
        hit = value == keys[todo]
        out[todo[hit]] = now[hit]
        todo = todo[~hit & (value < keys[todo])]
    return out


class Model(NamedTuple):
    languages: list[str]
    order: int
    probability: list[Table]  # by order: log P of each known n-gram for every language
    backoff: list[Table]  # by length of the context from 1: log weight of the shorter context
    unknown: np.ndarray  # log P of a character that no language has
    limit: np.ndarray  # largest accepted cross-entropy by language


def _grams(chars: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams that end at each position from n - 1 on."""
    size = len(chars) - n + 1
    if size <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(size, n, dtype=np.uint64)
    for k in range(n):
        out = out * U(0x9FB21C651E98DF25) + chars[k : k + size]
    return mix(out)


def fit(texts: dict[str, list[str]], order: int = 4, slack: float = 1.6, back: int = 5) -> Model:
    """Interpolated Kneser-Ney of the given order for each language, calibrated on texts that it isn't learnt from.

    Counts of the highest order are occurrences; those of lower orders are the distinct characters before. Each order's
    discount is n1 / (n1 + 2 n2). Every back-th text is held back from learning; a language accepts texts up to slack times
    the 0.999 quantile of its held back texts' cross-entropies (of the learnt ones' if there are fewer than back).
    """
    languages = sorted(texts)
    held = {lang: some[back - 1 :: back] for lang, some in texts.items()}
    texts = {lang: [t for i, t in enumerate(some) if i % back != back - 1] for lang, some in texts.items()}
    if not languages:
        return Model([], order, [], [], np.zeros(0), np.zeros(0))
    codes: dict[int, np.ndarray] = {}  # characters of each distinct n-gram of any language, by n
    counts: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {n: [] for n in range(1, order + 1)}
    joined = {lang: np.concatenate([_letters(" " + t + " ") for t in texts[lang]] or [np.zeros(0, np.uint64)]) for lang in languages}
    for lang in languages:
        chars = joined[lang]
        above = None
        for n in range(order, 0, -1):
            if n == order:
                size = max(0, len(chars) - n + 1)
                rows = np.stack([chars[k : k + size] for k in range(n)], axis=1) if size else np.zeros((0, n), np.uint64)
                rows, count = np.unique(rows, axis=0, return_counts=True)
            else:
                rows, count = np.unique(above[:, 1:], axis=0, return_counts=True)
            counts[n].append((rows, count))
            above = rows
    size = len(languages)
    alphabet = max(2, len(np.unique(np.concatenate([r for r, _ in counts[1]]))) + 1)
    uniform = np.full(size, -np.log(alphabet))
    probability, backoff = [], []
    for n in range(1, order + 1):
        codes[n] = np.unique(np.concatenate([r for r, _ in counts[n]]), axis=0) if size else np.zeros((0, n), np.uint64)
        keys = _hash_rows(codes[n])
        lower = np.repeat(np.exp(uniform)[None], len(keys), axis=0) if n == 1 else np.exp(_scored(probability, backoff, uniform, codes[n][:, 1:]))
        contexts = np.unique(codes[n][:, :-1], axis=0) if n > 1 else np.zeros((1, 0), np.uint64)
        names = _hash_rows(contexts) if n > 1 else np.zeros(1, np.uint64)
        place = np.searchsorted(names[np.argsort(names)], _hash_rows(codes[n][:, :-1])) if n > 1 else np.zeros(len(keys), np.int64)
        place = np.argsort(names)[place] if n > 1 else place
        out, weight = np.zeros((len(keys), size)), np.zeros((len(contexts), size))
        order_of = np.argsort(keys)
        for k, (rows, count) in enumerate(counts[n]):
            c = np.zeros(len(keys))
            if len(rows):
                c[order_of[np.searchsorted(keys[order_of], _hash_rows(rows))]] = count
            n1, n2 = int((count == 1).sum()), int((count == 2).sum())
            d = min(0.95, max(0.1, n1 / (n1 + 2 * n2))) if n1 + n2 else 0.5
            total = np.bincount(place, weights=c, minlength=len(contexts))
            kinds = np.bincount(place, weights=c > 0, minlength=len(contexts))
            with np.errstate(divide="ignore", invalid="ignore"):
                share = np.where(total > 0, d * kinds / total, 1.0)
                out[:, k] = np.where(total[place] > 0, np.maximum(c - d, 0) / total[place], 0) + share[place] * lower[:, k]
            weight[:, k] = np.log(share)
        probability.append(_table(keys, np.log(out).astype(np.float32)))
        if n > 1:
            backoff.append(_table(names, weight.astype(np.float32)))
        else:
            unknown = uniform + weight[0]
    model = Model(languages, order, probability, backoff, unknown, np.full(size, np.inf))
    limit = []
    for k, lang in enumerate(languages):
        entropy = cross_entropy(model, held[lang] or texts[lang])[:, k]
        entropy = entropy[np.isfinite(entropy)]
        limit.append(slack * float(np.quantile(entropy, 0.999)) if len(entropy) else np.inf)
    return model._replace(limit=np.array(limit))


def _hash_rows(rows: np.ndarray) -> np.ndarray:
    out = np.full(len(rows), rows.shape[1], dtype=np.uint64)
    for k in range(rows.shape[1]):
        out = out * U(0x9FB21C651E98DF25) + rows[:, k]
    return mix(out)


def _scored(probability: list[Table], backoff: list[Table], unknown: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """log P of each row's last character after the others, by language."""
    n = rows.shape[1]
    at = _find(probability[n - 1], _hash_rows(rows))
    out = probability[n - 1].rows[np.maximum(at, 0)].astype(np.float64) if len(probability[n - 1].rows) else np.zeros((len(rows), len(unknown)))
    miss = np.flatnonzero(at < 0)
    if len(miss):
        if n == 1:
            out[miss] = unknown
        else:
            out[miss] = _scored(probability, backoff, unknown, rows[miss, 1:])
            ctx = _find(backoff[n - 2], _hash_rows(rows[miss, :-1]))
            known = ctx >= 0
            out[miss[known]] += backoff[n - 2].rows[ctx[known]]
    return out


def _position_scores(model: Model, chars: np.ndarray) -> np.ndarray:
    """log P by language at each position from order - 1 on."""
    n = model.order
    size = len(chars) - n + 1
    at = _find(model.probability[n - 1], _grams(chars, n))
    out = model.probability[n - 1].rows[np.maximum(at, 0)]
    miss = np.flatnonzero(at < 0)
    if len(miss):
        rows = np.stack([chars[miss + k] for k in range(n)], axis=1)
        out[miss] = _scored(model.probability, model.backoff, model.unknown, rows)
    assert len(out) == size
    return out


def cross_entropy(model: Model, texts: list[str], most: int = 1 << 19) -> np.ndarray:
    """Nats a character by text and language; infinite for texts without letters. Whole texts are scored, in blocks."""
    out = np.full((len(texts), len(model.languages)), np.inf)
    pad = model.order - 1
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= most):
            size += len(texts[j]) + 1
            j += 1
        part = texts[i:j]
        lowered = [" " + t.lower() for t in part]
        points = np.frombuffer("".join(lowered + [" "]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        first = np.cumsum([0, *map(len, lowered)])
        # each text begins with a 0 of its own: runs are squeezed to it, so a text without letters has no character
        chars, begin = _squeezed(points, first)
        if len(chars) > 1:
            padded = np.concatenate([np.zeros(pad, np.uint64), chars])
            scores = _position_scores(model, padded)  # one row for each character of chars
            total = np.concatenate([np.zeros((1, scores.shape[1])), np.cumsum(scores, axis=0, dtype=np.float64)])
            for k in range(j - i):
                a, b = begin[k], begin[k + 1]
                if a < len(chars) and chars[a] == 0:
                    a += 1
                if b < len(chars) and chars[b] == 0:
                    b += 1
                if b > a + 1 or (b > a and chars[a] != 0):
                    out[i + k] = (total[a] - total[b]) / (b - a)
        i = j
    return out


def training_sample(docs: DataFrame, rows_per_language: int = 500) -> dict[str, list[str]]:
    """At most rows_per_language whole texts of each language, by smallest hash of doc_id.

    Counting comes first, so that only about the wanted share of each language's rows is read to the driver.
    """
    docs = docs.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    have = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not have:
        return {}
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    within = F.lit(False)
    for lang, n in have.items():
        share = min(1.0, (rows_per_language + 4 * rows_per_language**0.5) / n)
        within = within | ((F.col("lang") == lang) & (place < int(share * (1 << 30)) + 1))
    out: dict[str, list[str]] = {}
    for r in docs.where(within).orderBy(place, "doc_id", "text").collect():
        if len(out.setdefault(r["lang"], [])) < rows_per_language:
            out[r["lang"]].append(r["text"])
    return out


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred, score and rejected added; columns of these names are replaced.

    lang_pred is the language of the lowest cross-entropy per character (ties: first by name), 'und' for a null text or
    one without a letter, or if the model knows no language. score is its share of exp(-20 * cross-entropy) over all
    languages and over no language, which stands at lang_pred's calibrated limit: a text at the limit scores one half at
    most, one in no learnt script about 0. rejected is true for 'und' and beyond the limit. Repeated rows are each
    predicted, other columns pass through under any name, and an empty table gives an empty result.
    """
    spread = sent(docs.sparkSession, model)
    docs = docs.drop("lang_pred", "score", "rejected")
    given = docs.columns
    hidden = "cg__text"
    docs = docs.withColumn(hidden, F.col("text").cast("string"))
    from pyspark.sql import types as T

    schema = T.StructType([*docs.drop(hidden).schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = spread()
        names = np.array([*known.languages, _NONE], dtype=object)
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            if known.languages:
                entropy = cross_entropy(known, texts)
                best = entropy.argmin(axis=1)
                low = entropy[np.arange(len(texts)), best]
                some = np.isfinite(low)
                with np.errstate(invalid="ignore"):
                    other = np.exp(np.minimum(20 * (low - known.limit[best]), 700))
                    score = np.where(some, 1 / (np.exp(-20 * (entropy - low[:, None])).sum(axis=1) + other), 0.0)
                    rejected = ~some | (low > known.limit[best])
                pred = names[np.where(some, best, -1)]
            else:
                pred, score, rejected = np.full(len(texts), _NONE, object), np.zeros(len(texts)), np.ones(len(texts), bool)
            yield pa.record_batch([*batch.columns[:-1], pa.array(pred, pa.string()), pa.array(score), pa.array(rejected)], names=[*given, "lang_pred", "score", "rejected"])

    return docs.mapInArrow(run, schema)


def held_out(docs: DataFrame, fold: int = 0, folds: int = 5):
    """Whether crc32 of doc_id as text leaves fold; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold, F.lit(False))


def language_id(docs: DataFrame, rows_per_language: int = 500, order: int = 4) -> DataFrame:
    """docs(doc_id, text, lang, ...) with held_out, lang_pred, score and rejected: learnt from the other four folds only.

    lang is only read from rows that aren't held out; predictions use the text alone.
    """
    train = docs.where(~held_out(docs))
    model = fit(training_sample(train, rows_per_language), order)
    return identify(docs.withColumn("held_out", held_out(docs)), model)

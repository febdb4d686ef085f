"""Secret scans: three patterns, and sliding-window Shannon entropy of other candidate strings.

Only DataFrame and SQL functions run. Matches get their places from the lengths of the pieces between them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgraph.llm.staging import bound

# fixed values: the patterns of the three kinds, and of candidates and what is never a secret
_KEY = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
ASSIGN = _KEY + r"([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{12,}"  # as AKIA[A-Z0-9]+ of 16 characters or more
HEX = r"[0-9a-f]{32,}"  # as [0-9a-f]+ of 32 characters or more
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALLOWED = (
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}",
    r"(?i)example|placeholder|changeme|xxxx|dummy|sample",
    r"(?i)0123456789|abcdefghij|qwertyuiop",
    r"^[0-9_=+/-]+$|^[A-Za-z_=+/-]+$",
    r"^(sha1|sha256|sha512|md5)-",
    r"/[A-Za-z]+/[A-Za-z]+/",
)
KINDS = ("assign", "access", "hex", "entropy")
#: Bits a character that a window must reach, by the smallest class that has all of a candidate's characters.
BITS = {"hex": 2.9, "lower": 3.6, "base64": 3.7}


def _quoted(pattern: str) -> str:
    return "r'" + pattern + "'" if "'" not in pattern else 'r"' + pattern.replace('"', r"\x22") + '"'


_SPAN = "struct<s:int,k:int,e:int,m:string>"
_RUN = 256  # matches whose places are summed in one fold


def _spans(pattern: str, passes: str, kind: int) -> Column:
    """Array of (start, kind, end, value) of a pattern's matches m that pass.

    A match starts after all pieces and matches before it. These sums run over blocks of _RUN matches and then over the
    blocks, so that a fold's growing array stays short however many matches a text has.
    """
    q = _quoted(pattern)
    found = f"regexp_extract_all(text, {q}, 0)"
    length = "(x.gap + length(x.m))"
    each = f"zip_with({found}, slice(split(text, {q}, -1), 1, size({found})), (m, p) -> struct(m, length(p) as gap))"
    cut = f"transform(array({each}), xs -> transform(sequence(0, (size(xs) - 1) div {_RUN}), i -> slice(xs, i * {_RUN} + 1, {_RUN})))"
    sums = f"transform({cut}[0], xs -> struct(xs, aggregate(xs, 0, (t, x) -> t + {length}) as total))"
    starts = "aggregate({blocks}, struct(0 as at, cast(array() as array<int>) as out), (a, b) -> struct(a.at + b.total as at, array_append(a.out, a.at) as out), a -> a.out)"
    inner = (
        f"aggregate(b.xs, struct(at as at, cast(array() as array<{_SPAN}>) as out),"
        f" (a, x) -> struct(a.at + {length} as at, array_append(a.out, struct(a.at + x.gap as s, {kind} as k, a.at + {length} as e, x.m as m)) as out), a -> a.out)"
    )
    laid = f"flatten(transform(array({sums}), bs -> flatten(zip_with(bs, {starts.format(blocks='bs')}, (b, at) -> {inner}))))"
    return F.expr(f"if(rlike(text, {q}), filter({laid}, x -> {passes.replace('{m}', 'x.m')}), cast(array() as array<{_SPAN}>))")


# a candidate's characters lie from + (43) to z (122); a window's counts are packed 12 to a long, 5 bits each
_FIRST, _PACKED, _BITS = 43, 12, 5
_LONGS = 7


def _entropy(codes: str, width: int) -> str:
    """Largest entropy of a window of a candidate given as an array of places 0 to 79, in one pass.

    The fold carries the counts of the window's characters and the sum of c log2 c; a step takes one character out and one
    in, which changes two counts. width is 31 at most, as a count has 5 bits.
    """
    if not 1 <= width < 1 << _BITS:
        raise ValueError(f"width {width} isn't from 1 to {(1 << _BITS) - 1}")
    parts = "array(" + ", ".join(f"{c * math.log2(c) if c else 0.0!r}D" for c in range(width + 2)) + ")"
    get = lambda place: f"(shiftright(case {place} div {_PACKED} " + " ".join(f"when {j} then a.c{j}" for j in range(_LONGS)) + f" end, {_BITS} * ({place} % {_PACKED})) & 31)"
    here, gone = f"{codes}[i]", f"{codes}[i - {width}]"
    enter, leave = f"cast({get(here)} as int)", f"cast({get(gone)} as int)"
    one = lambda place, j: f"if({place} div {_PACKED} = {j}, shiftleft(1L, {_BITS} * ({place} % {_PACKED})), 0L)"
    grown = f"a.s + parts[{enter} + 1] - parts[{enter}]"
    moved = f"if({here} = {gone}, a.s, {grown} + parts[{leave} - 1] - parts[{leave}])"
    first = ", ".join(f"a.c{j} + {one(here, j)} as c{j}" for j in range(_LONGS))
    later = ", ".join(f"a.c{j} + {one(here, j)} - {one(gone, j)} as c{j}" for j in range(_LONGS))
    zero = ", ".join(f"0L as c{j}" for j in range(_LONGS))
    opening = f"aggregate(sequence(0, least(size({codes}), {width}) - 1), struct({zero}, 0D as s, 0D as low), (a, i) -> struct({first}, {grown} as s, {grown} as low))"
    rest = f"if(size({codes}) > {width}, sequence({width}, size({codes}) - 1), cast(array() as array<int>))"
    least = f"aggregate({rest}, {opening}, (a, i) -> struct({later}, {moved} as s, least(a.low, {moved}) as low), a -> a.low)"
    return f"transform(array({parts}), parts -> log2(least({width}, size({codes}))) - {least} / least({width}, size({codes})))[0]"


def _codes(text: str) -> str:
    return f"transform(split({text}, ''), c -> ascii(c) - {_FIRST})"


def scan(docs: DataFrame, width: int = 20) -> DataFrame:
    """docs with base (array of the patterns' spans) and found (base and entropy spans, by start, then kind).

    A span is a struct of s and e (code points, end exclusive), k (index into KINDS) and m (the text). Candidates are
    runs of 20 or more base64 characters outside base spans with a letter and a digit; one is a secret if some window of
    width characters reaches the entropy of its class and no allowed pattern holds. Null texts count as empty, which have
    none; other columns pass through, but base and found are replaced.
    """
    hidden = "cg__given"
    rows = docs.drop("base", "found").withColumn(hidden, F.col("text")).withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    key = _quoted("^" + _KEY)
    allowed = " or ".join(f"rlike({{m}}, {_quoted(p)})" for p in ALLOWED)
    rows = bound(
        rows,
        base=F.array_sort(F.concat(_spans(ASSIGN, f"length(regexp_replace({{m}}, {key}, '')) >= 8", 0), _spans(ACCESS, "true", 1), _spans(HEX, "true", 2))),
        cg__more=_spans(CANDIDATE, f"rlike({{m}}, '[0-9]') and rlike({{m}}, '[A-Za-z]') and not ({allowed})", 3),
    )
    need = f"case when rlike(x.m, '^[0-9a-fA-F]+$') then {BITS['hex']}D when rlike(x.m, '^[0-9a-z]+$') then {BITS['lower']}D else {BITS['base64']}D end"
    apart = "filter(cg__more, x -> not exists(base, b -> b.s < x.e and x.s < b.e))"
    high = f"transform(array({_codes('x.m')}), codes -> {_entropy('codes', width)})[0]"
    fresh = F.expr(f"filter({apart}, x -> {high} >= {need})")
    rows = bound(rows, found=F.when(F.size("cg__more") == 0, F.col("base")).otherwise(F.array_sort(F.concat("base", fresh)))).withColumn("text", F.col(hidden))
    return rows.drop(hidden, "cg__more")


def listed(spans: str) -> Column:
    """'kind:start:end' of an array of spans, comma-joined."""
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({spans}, x -> concat(get({names}, x.k), ':', x.s, ':', x.e)), ',')")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256 and spans of every document."""
    rows = scan(docs.select("doc_id", "text"))
    counts = [F.expr(f"cast(size(filter(found, x -> x.k = {k})) as bigint)").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return rows.select("doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("found").alias("spans"))


def redacted(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with each found span of text replaced by mark (overlapping ones by one); n_chars, if there, follows.

    A null text stays null, a text without a span stays as it is, and all other columns pass through under any name;
    repeated rows are each returned.
    """
    given, kind = docs.columns, docs.schema
    kept = {c: f"cg__own_{c}" for c in ("base", "found") if c in given}
    rows = scan(docs.withColumnsRenamed(kept))
    fold = (
        "aggregate(found, struct(0 as at, '' as out), (a, x) -> struct(greatest(a.at, x.e) as at,"
        f" if(x.s >= a.at, concat(a.out, substring(text, a.at + 1, x.s - a.at), '{mark}'), a.out) as out),"
        " a -> concat(a.out, substring(text, a.at + 1)))"
    )
    some = F.size("found") > 0
    out = bound(rows, cg__new=F.when(some, F.expr(fold)).otherwise(F.col("text")))
    if "n_chars" in given:
        out = out.withColumn("n_chars", F.when(some, F.length("cg__new").cast(kind["n_chars"].dataType)).otherwise(F.col("n_chars")))
    out = out.drop("base", "found").withColumn("text", F.col("cg__new")).withColumnsRenamed({v: k for k, v in kept.items()})
    return out.select(*given)

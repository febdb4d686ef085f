"""Every core query with SQL against DuckDB on the smallest tables."""

from collections import defaultdict
from difflib import SequenceMatcher

import duckdb
import pytest

from corpusgraph.fixtures import TABLES, Store
from corpusgraph.plans.queries import QUERIES, oracles

SF = "/root/testdata/sf0.001"
SQL = oracles()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    cur = con.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    want = sorted((tuple(r[names.index(c)] for c in columns) for r in cur.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, SF).limit(1).count() == 1


@pytest.fixture(scope="module")
def entity_scores(spark):
    """(query, entity, exact score, whether a name holds the other) of all pairs of entities."""
    store, names = Store(spark, SF), defaultdict(list)
    asked = {r["id"]: r["normalized_name"] for r in store("kg_entity").collect()}
    for e, name in [*asked.items(), *((r["entity_id"], r["normalized_name"]) for r in store("kg_alias").collect())]:
        names[e].append(name)
    out = []
    for q, a in asked.items():
        for e, of in names.items():
            score = max(SequenceMatcher(None, a, b).ratio() for b in of)
            x, held = a.replace(" ", ""), [b.replace(" ", "") for b in of]
            holds = any(x in y or y in x for y in held)
            out.append((q, e, max(score, 0.55) if holds else score, holds))
    return out


def _k_best(scores, threshold, alone):
    out = defaultdict(list)
    for q, e, score, _ in scores:
        if score >= threshold and not (alone and q == e):
            out[q].append((-round(score, 4), e))
    return {q: sorted(x)[:5] for q, x in out.items()}


def test_fuzzy_candidates_of_all_entities(spark, entity_scores):
    want = {(q, e, -score) for q, x in _k_best(entity_scores, 0.35, False).items() for score, e in x}
    got = {(r["query_id"], r["entity_id"], r["score"]) for r in QUERIES["fuzzy_candidates"](spark, SF).collect()}
    assert got == want and len({q for q, _, _ in got}) == 200


def test_reconciled_pairs_of_all_entities(spark, entity_scores):
    pairs = defaultdict(float)
    for q, x in _k_best(entity_scores, 0.55, True).items():
        for score, e in x:
            pairs[min(q, e), max(q, e)] = max(pairs[min(q, e), max(q, e)], -score)
    want = sorted((-score, *pair) for pair, score in pairs.items())[:20]
    assert [(-r["score"], r["left_id"], r["right_id"]) for r in QUERIES["reconcile_pairs"](spark, SF).collect()] == want


def test_containment_of_all_entities(spark, entity_scores):
    got = {(r["query_id"], r["entity_id"]) for r in QUERIES["containment_entities"](spark, SF).collect()}
    assert got == {(q, e) for q, e, _, holds in entity_scores if holds}

"""Steps that must not meet in one task, one driver or one pass for each row, and give what they gave before."""

import random

import pytest

from corpusgraph.fixtures import Store
from corpusgraph.operators import graph, integrity, resolve
from corpusgraph.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["kg_evidence_raw", "kg_entity_observation"])
def test_numbered_views_sort_in_many_tasks(spark, name):
    df = Store(spark, SF).view(name)
    assert "SinglePartition" not in plan(df)
    ids = sorted(r["id"] for r in df.select("id").collect())
    assert ids == list(range(1, len(ids) + 1)) and len(ids) > 5000


def test_ids_of_equal_and_of_no_rows(spark):
    from corpusgraph.operators import keyed

    rows = spark.range(1000).selectExpr("id % 3 as a", "cast(null as int) as b")
    got = sorted((r["id"], r["a"]) for r in keyed.with_ids(rows, 5, "a", "b").collect())
    assert got == [(6 + i, 0 if i < 334 else 1 if i < 667 else 2) for i in range(1000)]
    assert keyed.with_ids(rows.where("a > 5"), 5, "a", "b").count() == 0


def test_reference_checks_read_evidence_once(spark):
    s = Store(spark, SF)
    tables = {n: s(n) for n in ("kg_source", "kg_entity", "kg_alias", "kg_claim", "kg_evidence", "kg_entity_observation", "kg_claim_observation", "kg_judgment")}
    assert plan(integrity.reference_violations(tables)).count("Window") == 0


def test_containment_broadcasts_no_names(spark):
    assert "Broadcast" not in plan(QUERIES["containment_entities"](spark, SF))


@pytest.mark.parametrize("copies", [1, 70])
def test_containment_gives_each_pair_once(spark, copies):
    """Ids with several names that match in several ways, and one with over 64 names; a name of over 1024 entities."""
    q = [(1, "red bolt"), (1, "bolt"), (2, "green ring"), (3, None), (4, ""), (5, "xx")]
    n = [(10, "bolt"), (10, "red bolt 5"), (10, "red"), (11, "ring"), (12, "e"), (13, ""), (14, None), *((100 + i, "x x") for i in range(1500)), *((15, f"red{i}") for i in range(copies))]
    got = sorted((r[0], r[1]) for r in resolve.containing(spark.createDataFrame(q, "query_id long, name string"), spark.createDataFrame(n, "entity_id long, name string")).collect())
    tight = lambda x: (x or "").replace(" ", "")
    want = {(i, e) for i, x in q for e, y in n if tight(x) and tight(y) and (tight(x) in tight(y) or tight(y) in tight(x))}
    assert got == sorted(want)


def test_few_names_are_scored_exactly(monkeypatch):
    """The k best of brute force, also of names with spaces, NULs, over 63 and over 256 characters, by few exact scores."""
    r, calls = random.Random(5), []
    names = list({"".join(r.choice("abc é\0d") for _ in range(r.choice([0, 1, 3, 8, 20, 63, 64, 70, 300]))) for _ in range(150)} | {f"large ring #{i}" for i in range(2000)})
    asked, ratio = [*names[::60], "a" * 400, "large ring #7"], resolve.SequenceMatcher.ratio
    monkeypatch.setattr(resolve.SequenceMatcher, "ratio", lambda self: calls.append(1) or ratio(self))
    got = {a: best for a, best, _ in resolve._best(asked, [0.35] * len(asked), names, [[i] for i in range(len(names))], 0.35, 5, 0.55)}
    assert len(calls) < 0.3 * len(asked) * len(names)
    k_best = lambda x: sorted((-round(v, 4), e) for e, v in x.items())[:5]
    for a in asked:
        want, ac = {}, a.replace(" ", "")
        for i, b in enumerate(names):
            bc = b.replace(" ", "")
            score = ratio(resolve.SequenceMatcher(None, a, b))
            score = max(score, 0.55) if ac and bc and (ac in bc or bc in ac) else score
            want |= {i: score} if score >= 0.35 else {}
        assert k_best(got[a]) == k_best(want)


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(40)], [(i, (i + 1) % 13) for i in range(13)] + [(3, 20), (20, 21), (21, 5), (30, 31)], [(r, r * 7 % 23) for r in range(23)] + [(r, r * 3 % 23) for r in range(9)]])
def test_closure_and_cycles_of_paths_and_cycles(spark, edges):
    after = {s: {o for x, o in edges if x == s} for s, _ in edges}
    want = set()
    for s in after:
        todo, seen = list(after[s]), set(after[s])
        while todo:
            todo.extend(x for x in after.get(todo.pop(), ()) if x not in seen and not seen.add(x))
        want |= {(s, o) for o in seen}
    df = spark.createDataFrame([(i, *e) for i, e in enumerate(edges)], "id long, s long, o long")
    assert sorted((r["s"], r["o"]) for r in graph.closure(df).collect()) == sorted(want)
    assert sorted(r["id"] for r in graph.cycle_edges(df).collect()) == sorted(i for i, (s, o) in enumerate(edges) if (o, s) in want or s == o)


def test_cycle_search_broadcasts_nothing(spark):
    df = graph.cycle_edges(spark.range(30).selectExpr("id", "id as s", "if(id = 9, 0, id + 1) as o"))
    assert df.count() == 10 and df.collect() and "BroadcastHashJoin" not in plan(df)


def test_pairs_to_reconcile_meet_in_blocks(spark):
    df = QUERIES["reconcile_pairs"](spark, SF)
    assert "FlatMapCoGroupsInArrow" in plan(df) and "NestedLoop" not in plan(df) and "Cartesian" not in plan(df)

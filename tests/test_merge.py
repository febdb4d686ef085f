import json

from corpusgraph import cli
from corpusgraph.functions.model import ScriptedModel
from corpusgraph.operators import merge
from corpusgraph.operators.keyed import Snapshots


def _tables(spark):
    t = {k: spark.createDataFrame([], v) for k, v in cli.TABLES.items()}
    fill = lambda name, rows, columns: spark.createDataFrame(rows, columns).unionByName(t[name], allowMissingColumns=True).select(*t[name].columns)
    t["entities"] = fill("entities", [(1, "Linear regression", "linear regression"), (2, "Linear regresion", "linear regresion"), (3, "Zebra", "zebra"), (4, "Quince", "quince")], "id long, canonical_name string, normalized_name string")
    t["entity_aliases"] = fill("entity_aliases", [(1, 2, "LR", "lr"), (2, 3, "Z", "z")], "id long, entity_id long, name string, normalized_name string")
    t["entity_definition_syntheses"] = fill("entity_definition_syntheses", [(1, 1), (2, 2)], "id long, entity_id long")
    t["entity_observations"] = fill("entity_observations", [(1, 2), (2, 3), (3, None)], "id long, entity_id long")
    # 2 repeats 1, 3 becomes a loop, 4 closes a cycle with 6, 5 gets a new end
    claims = [(1, 1, "part_of", 3), (2, 2, "part_of", 3), (3, 1, "part_of", 2), (4, 2, "is_a", 3), (5, 4, "is_a", 2), (6, 3, "is_a", 1)]
    t["claims"] = fill("claims", claims, "id long, subject_id long, relation string, object_id long")
    evidence = [(1, 2, None, "x"), (2, 1, None, "x"), (3, None, 1, "y"), (4, None, 2, "y"), (5, None, 2, "z"), (6, None, 3, "y"), (7, None, 4, "y"), (8, None, 5, "y")]
    rows = [(i, e, c, f"entity:{e}" if e else f"claim:{c}", 1, h, "support") for i, e, c, h in evidence]
    t["evidence"] = fill("evidence", rows, "id long, entity_id long, claim_id long, target_key string, source_id long, excerpt_hash string, polarity string")
    seen = [(i, s, r, o, "support", i) for i, s, r, o in claims]
    t["claim_observations"] = fill("claim_observations", seen, "id long, subject_entity_id long, relation string, object_entity_id long, polarity string, claim_id long")
    return t


def _rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def _is_merged(out):
    assert _rows(out["claims"], "id", "subject_id", "relation", "object_id") == [(1, 1, "part_of", 3), (5, 4, "is_a", 1), (6, 3, "is_a", 1)]
    assert _rows(out["claim_observations"].fillna(0, ["claim_id"]), "id", "subject_entity_id", "object_entity_id", "claim_id") == [(1, 1, 3, 1), (2, 1, 3, 1), (3, 1, 1, 0), (4, 1, 3, 0), (5, 4, 1, 5), (6, 3, 1, 6)]
    assert _rows(out["evidence"], "id", "target_key") == [(2, "entity:1"), (3, "claim:1"), (5, "claim:1"), (8, "claim:5")]
    assert _rows(out["entity_observations"].fillna(0), "id", "entity_id") == [(1, 1), (2, 3), (3, 0)]
    assert _rows(out["entity_definition_syntheses"], "id") == [(1,)]


def test_merge_moves_all_that_an_entity_has(spark):
    out = merge.merged(_tables(spark), spark.createDataFrame([(2, 1)], "old long, new long"))
    _is_merged(out)
    assert _rows(out["entities"], "id") == [(1,), (3,), (4,)]
    assert _rows(out["entity_aliases"], "entity_id", "normalized_name") == [(1, "linear regresion"), (1, "lr"), (3, "z")]


def test_merge_of_nothing(spark):
    t = _tables(spark)
    out = merge.merged(t, spark.createDataFrame([], "old long, new long"))
    assert all(out[k].exceptAll(t[k]).count() == 0 and t[k].exceptAll(out[k]).count() == 0 for k in out)


def test_names_that_others_have_stay(spark):
    t = _tables(spark)
    wanted = spark.createDataFrame([(1, "ZEBRA"), (3, "Horse"), (4, "horse "), (2, " ")], "id long, name string")
    out = merge.renamed(t["entities"], t["entity_aliases"], wanted)
    assert _rows(out["entities"], "id", "canonical_name") == [(1, "Linear regression"), (2, "Linear regresion"), (3, "Horse"), (4, "Quince")]
    assert _rows(out["entity_aliases"], "entity_id", "normalized_name") == [(2, "lr"), (3, "z"), (3, "zebra")]


def test_reconcile_command(spark, tmp_path, capsys):
    store = Snapshots(spark, str(tmp_path / "s"))
    store.commit(**_tables(spark))
    build = lambda: ScriptedModel(lambda system, user: {"decision": "same", "canonical_name": "Linear Regression (statistics)", "reason": ""})
    assert cli.main(["--store", str(tmp_path / "s"), "reconcile"], spark, build) == 0
    told = json.loads(capsys.readouterr().out)
    assert (told["examined"], told["merged"], told["failed"]) == (1, 1, 0)
    out = {k: store.read(k) for k in cli.TABLES}
    _is_merged(out)
    assert _rows(out["entities"], "canonical_name") == [("Linear Regression (statistics)",), ("Quince",), ("Zebra",)]
    assert _rows(out["entity_aliases"], "entity_id", "normalized_name") == [(1, "linear regresion"), (1, "linear regression"), (1, "lr"), (3, "z")]
    assert cli.main(["--store", str(tmp_path / "s"), "reconcile"], spark) == 2

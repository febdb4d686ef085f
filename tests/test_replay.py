import json

import pytest
from pyspark.sql import functions as F

from corpusgraph import cli
from corpusgraph.functions.model import HttpModel, ScriptedModel, configured
from corpusgraph.operators import replay, resolve
from corpusgraph.operators.keyed import Snapshots, cut


def _tables(spark):
    t = {k: spark.createDataFrame([], v) for k, v in cli.TABLES.items()}
    fill = lambda name, rows, columns: spark.createDataFrame(rows, columns).unionByName(t[name], allowMissingColumns=True).select(*t[name].columns)
    t["entities"] = fill("entities", [(1, "A", "a"), (2, "B b", "b b"), (3, "C", "c")], "id long, canonical_name string, normalized_name string")
    seen = [
        (1, "a", None, "is_a", "bb", None, "support"),
        (2, "a", None, "is_a", "bb", None, "oppose"),
        (3, "zz", None, "is_a", "c", None, "support"),
        (4, "bb", None, "part_of", "c", None, "support"),
        (5, "bb", 2, "is_a", "a", None, "support"),
        (6, "c", None, "part_of", "a", None, "oppose"),
        (7, "a", None, "is_a", "bb", None, "support"),
        (8, "a", None, "part_of", "c", None, "support"),
    ]
    columns = "id long, subject_reference_key string, subject_entity_id long, relation string, object_reference_key string, object_entity_id long, polarity string"
    t["claim_observations"] = cut(fill("claim_observations", seen, columns).withColumns({"source_id": F.lit(1).cast("long"), "source_text": F.concat(F.lit("t"), (F.col("id") % 6).cast("string")), "model_quote": F.lit("q"), "passage_ids": F.lit('["P1"]'), "subject_name": F.col("subject_reference_key"), "object_name": F.col("object_reference_key"), "materialization_error": F.lit("")}))
    verdicts = [(1, 1, "supports"), (2, 2, "contradicts"), (3, 3, "supports"), (4, 5, "supports"), (5, 6, "contradicts"), (6, 7, "supports"), (7, 8, "insufficient")]
    t["judgments"] = fill("judgments", [(i, o, "m", "v1", v) for i, o, v in verdicts], "id long, observation_id long, validator_model string, validator_prompt_version string, verdict string")
    return t


def test_replay_is_as_one_by_one(spark):
    t = _tables(spark)
    out, told = replay.replay(t)
    assert told == {"resolved_endpoints": 14, "judged": 0, "materialized": 3, "blocked": 2}
    claims = [(r["id"], r["subject_id"], r["relation"], r["object_id"]) for r in out["claims"].collect()]
    assert claims == [(1, 1, "is_a", 2)]
    state = {r["id"]: (r["claim_id"], bool(r["materialization_error"])) for r in out["claim_observations"].collect()}
    assert state == {1: (1, False), 2: (1, False), 3: (None, False), 4: (None, False), 5: (None, True), 6: (None, True), 7: (1, False), 8: (None, False)}
    # 1 and 7 cite the same excerpt
    assert sorted((r["polarity"], r["target_key"], r["validator_verdict"]) for r in out["evidence"].collect()) == [("oppose", "claim:1", "contradicts"), ("support", "claim:1", "supports")]


def test_replay_of_nothing(spark):
    out, told = replay.replay({k: spark.createDataFrame([], v) for k, v in cli.TABLES.items()}, lambda: ScriptedModel(lambda s, u: {}))
    assert set(told.values()) == {0} and all(df.count() == 0 for df in out.values())


def test_command_asks_for_lacking_verdicts_and_changes_nothing_twice(spark, tmp_path, capsys):
    store = Snapshots(spark, str(tmp_path / "s"))
    store.commit(**_tables(spark))
    build = lambda: ScriptedModel(lambda system, user: {"verdict": "supports", "reason": "r"})
    run = lambda: (cli.main(["--store", str(tmp_path / "s"), "replay-pending"], spark, build), json.loads(capsys.readouterr().out))
    code, told = run()
    assert code == 0 and (told["judged"], told["materialized"], told["blocked"], told["pending"]["materialized"]) == (1, 4, 2, 4)
    rows = {k: store.read(k).orderBy("id").collect() for k in ("claims", "evidence", "judgments", "claim_observations")}
    code, told = run()
    assert code == 0 and (told["judged"], told["materialized"], told["blocked"]) == (0, 0, 2)
    assert rows == {k: store.read(k).orderBy("id").collect() for k in rows}


def test_model_of_the_environment():
    assert configured({}) is None
    model = configured({"CORPUSGRAPH_ENDPOINT": "http://x", "CORPUSGRAPH_KEY": "k", "CORPUSGRAPH_MODEL": "m"})()
    assert isinstance(model, HttpModel) and (model.endpoint, model.key, model.name) == ("http://x", "k", "m")
    with pytest.raises(ValueError):
        configured({"CORPUSGRAPH_ENDPOINT": "http://x"})


def test_containing_is_as_all_pairs(spark):
    left = [(1, "ab c"), (2, "b"), (3, "xyz"), (4, ""), (5, None), (6, "aaa"), (7, "b"), (8, "日本語")]
    right = [(10, "a b"), (11, "c"), (12, "wxyzw"), (13, "aa"), (14, None), (15, " "), (16, "本"), (17, "abc")]
    got = resolve.containing(spark.createDataFrame(left, "query_id long, name string"), spark.createDataFrame(right, "entity_id long, name string"))
    tight = lambda x: (x or "").replace(" ", "")
    want = {(i, j) for i, a in left for j, b in right if tight(a) and tight(b) and (tight(a) in tight(b) or tight(b) in tight(a))}
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert resolve.containing(spark.createDataFrame([], "query_id long, name string"), spark.createDataFrame(right, "entity_id long, name string")).count() == 0

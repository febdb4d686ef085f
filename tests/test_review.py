import json

import pytest

from corpusgraph import cli
from corpusgraph.functions import extraction
from corpusgraph.functions.model import ScriptedModel
from corpusgraph.operators import extract, review
from corpusgraph.sources import segment

PASSAGES = [{"passage_id": f"P{i}", "text": f"text {i}", "start": i, "location": "p1"} for i in range(5)]
CITED = {"passage_ids": ["P2", "P0"], "quote": "q"}


def entity(**more):
    return {"name": "A b", "definition": "what it is", "entity_type": "task", "evidence": CITED, **more}


def test_extraction_takes_what_holds():
    got = extraction.parse({"entities": [entity(aliases=["x", " x ", 3]), entity(name="a B"), entity(name="c", entity_type="odd"), 5, entity(name="d", definition="no")], "claims": [{"subject": "A", "relation": "is_a", "object": "B", "evidence": CITED}, {"subject": "A", "relation": "is_a", "object": " a", "evidence": CITED}]}, PASSAGES)
    assert [(e["name"], e["aliases"], e["passage_ids"], e["source_text"]) for e in got.entities] == [("A b", ["x"], ["P0", "P2"], "text 0\n\ntext 2")]
    assert [c["polarity"] for c in got.claims] == ["support"]
    assert [r.split("]")[0] for r in got.rejected] == ["entity[1", "entity[2", "entity[3", "entity[4", "claim[1"]


@pytest.mark.parametrize("ids", [[], ["P0", "P0"], ["P9"], ["P0", "P1", "P2", "P3"], "P0", None])
def test_evidence_must_name_passages(ids):
    got = extraction.parse({"entities": [entity(evidence={"passage_ids": ids, "quote": "q"})]}, PASSAGES)
    assert not got.entities and "passage_ids" in got.rejected[0]


def test_extraction_limits_and_shapes():
    got = extraction.parse({"entities": [entity(name=f"n{i}") for i in range(4)], "claims": "none"}, PASSAGES, entities=2)
    assert len(got.entities) == 2 and got.rejected == ["claims is no list", "entities over limit 2"]


def test_extract_chunks(spark):
    docs = spark.createDataFrame([(1, "First words.\n\nSecond words."), (2, "fails"), (3, None)], "source_id long, text string")
    passages, chunks = segment.segment(docs, "source_id"), segment.chunk(docs, "source_id")
    chunks = extract.with_passages(chunks, passages)

    def build():
        def answer(system, user):
            if "fails" in user:
                raise RuntimeError("down")
            return {"entities": [{"name": "N", "definition": "words", "entity_type": "concept", "evidence": {"passage_ids": [user.split("[")[-1][:7]], "quote": "q"}}], "claims": [7]}

        return ScriptedModel(answer)

    rows = {r["source_id"]: r for r in extract.extract_chunks(chunks, build, 2).collect()}
    assert set(rows) == {1, 2} and rows[2]["error"] == "down" and rows[2]["entities"] == []
    assert rows[1]["error"] is None and len(rows[1]["rejected"]) >= 1
    got = extract.extract_chunks(chunks, build)
    done = extract.progressed(got, chunks)
    assert {(r["source_id"], r["status"]) for r in done.collect()} == {(1, "done"), (2, "failed")}
    assert [r["source_id"] for r in extract.pending(chunks, done).collect()] == [2]
    assert extract.rejections(got).count() >= 1


def test_decisions():
    asked = {"name": "N", "candidates": [{"id": 4}], "evidence": [{"source_id": 1, "passage_ids": ["P1", "P2"]}]}
    assert review.identity({"decision": "Same", "candidate_id": "4"}, asked)["entity_id"] == 4
    assert review.identity({"decision": "same", "candidate_id": 5}, asked)["decision"] == "uncertain"
    assert review.identity({"decision": "odd"}, asked)["canonical_name"] == "N"
    new = {"decision": "new", "canonical_name": "N", "definition": "what it is", "entity_type": "data", "evidence_refs": [{"source_id": "1", "passage_id": "P2"}]}
    assert review.promotion(new, asked)["evidence_refs"] == [{"source_id": 1, "passage_id": "P2"}]
    for bad in ({"evidence_refs": []}, {"evidence_refs": [{"source_id": 1, "passage_id": "P3"}]}, {"evidence_refs": [3]}, {"entity_type": "x"}, {"definition": "no"}, {"canonical_name": " "}):
        assert review.promotion({**new, **bad}, asked)["decision"] == "uncertain"
    assert review.pair({"decision": "new"}, {})["decision"] == "distinct"


def test_definition_rules():
    asked = {"observations": [{"id": 1, "passage_ids": ["P1"]}]}
    good = {"definition": "what it is", "supporting_observations": [{"observation_id": 1, "passage_ids": ["P1"], "support": "s"}]}
    assert review.definition(good, asked)["limitation"] == ""
    for bad in ({"definition": "x"}, {"supporting_observations": []}, {"supporting_observations": [{"observation_id": 2}]}, {"supporting_observations": [{"observation_id": 1, "passage_ids": ["P2"], "support": "s"}]}, {"rejected_candidates": [1]}, {"limitation": 1}):
        with pytest.raises(ValueError):
            review.definition({**good, **bad}, asked)


def test_review_and_merge(spark):
    asked = spark.createDataFrame([("1:2", "f", "{}"), ("2:3", "f", "{}"), ("4:5", "f", '{"no": 1}'), ("6:7", "f", "{}")], "key string, fingerprint string, payload string")
    build = lambda: ScriptedModel(lambda s, u: {"decision": "uncertain" if "no" in u.split("\n")[-1] else "same"})
    got = review.review(asked, "pair", build, 2)
    assert {tuple(r) for r in review.merges(got).collect()} == {(2, 1), (3, 1), (7, 6)}
    assert review.unreviewed(asked, got, "pair", "scripted").count() == 0
    assert review.unreviewed(asked, got, "pair", "other").count() == 4


def test_new_names_must_be_free(spark):
    rows = [(k, json.dumps({"decision": d, "canonical_name": n})) for k, d, n in (("a", "new", "Known One"), ("b", "new", "free"), ("c", "new", "F ree"), ("d", "same", "knownone"))] + [("e", None)]
    got = review.promoted(spark.createDataFrame(rows, "key string, result string"), spark.createDataFrame([("knownone", 1)], "key string, entity_id long"))
    assert {r["key"]: r["decision"] for r in got.collect()} == {"a": "uncertain", "b": "new", "c": "uncertain", "d": "same"}


def test_definitions(spark):
    entities = spark.createDataFrame([(1, "A", "old"), (2, "B", "old")], "id long, canonical_name string, definition string")
    seen = spark.createDataFrame([(i, 1 + i // 2, "n", "d", "task", '["P1"]', "t", "q") for i in range(3)], "id long, entity_id long, name string, definition string, observed_entity_type string, passage_ids string, source_text string, model_quote string")
    asked = review.definitions_asked(entities, seen)
    assert [r["key"] for r in asked.collect()] == ["1"]
    build = lambda: ScriptedModel(lambda s, u: {"definition": "new one", "supporting_observations": [{"observation_id": 0, "passage_ids": ["P1"], "support": "s"}]})
    out = review.defined(entities, review.review(asked, "definition", build))
    assert {r["id"]: r["definition"] for r in out.collect()} == {1: "new one", 2: "old"}


def test_commands(spark, tmp_path, capsys):
    at = ["--store", str(tmp_path / "store")]
    assert cli.main([*at, "init"], spark) == 0
    assert set(json.loads(capsys.readouterr().out).values()) == {0}
    for command in ("status", "check", "audit"):
        assert cli.main([*at, command], spark) == 0
        json.loads(capsys.readouterr().out)
    assert cli.main([*at, "export", "--out", str(tmp_path / "g.json")], spark) == 0
    assert json.loads((tmp_path / "g.json").read_text())["entities"] == []
    assert cli.main([*at, "viz", "--out", str(tmp_path / "no" / "g.html")], spark) == 2
    store = cli.Snapshots(spark, str(tmp_path / "store"))
    store.commit(claims=spark.createDataFrame([(1, 1, "is_a", 2)], cli.TABLES["claims"]))
    assert cli.main([*at, "check"], spark) == 1

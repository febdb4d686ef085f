import io
import json
import urllib.error

import pytest

from corpusgraph.functions.model import HttpModel, ScriptedModel, answer_text, json_object
from corpusgraph.operators import document, judge


def reply(text):
    return io.BytesIO(json.dumps({"choices": [{"message": {"content": text}}]}).encode())


def test_json_object():
    assert json_object('so ```json\n{"a": {"b": 1}}\n``` end') == {"a": {"b": 1}}
    assert json_object('x {"a": 1} y {') == {"a": 1}
    assert json_object('{"a": [1, 2, ], "b": "x,}", }') == {"a": [1, 2], "b": "x,}"}
    assert json_object('see {this}: {"a": {"b": [1, {"c": "open') == {"a": {"b": [1, {"c": "open"}]}}
    for bad in ("none", "{broken"):
        with pytest.raises(ValueError):
            json_object(bad)


def test_answer_text():
    parts = [{"type": "text", "text": "a"}, {"type": "image"}, "x", {"type": "output_text", "text": "b"}]
    assert answer_text({"choices": [{"message": {"content": parts}}]}) == "ab"
    for bad in ({}, {"choices": []}, {"choices": [{"message": {"content": 3}}]}):
        with pytest.raises(ValueError):
            answer_text(bad)


def test_http_model_retries_and_asks_again():
    script = [urllib.error.HTTPError("u", 503, "", {}, None), urllib.error.URLError("down"), reply("no json"), reply('{"ok": 1}')]
    waits, seen = [], []

    def open_(request, timeout):
        seen.append(request.get_header("Authorization"))
        step = script.pop(0)
        if isinstance(step, Exception):
            raise step
        return step

    assert HttpModel("http://host", "Bearer k", "m", open=open_, wait=waits.append).complete_json("s", "u") == {"ok": 1}
    assert waits == [1, 2] and set(seen) == {"Bearer k"}
    script[:] = [urllib.error.HTTPError("u", 400, "", {}, None)]
    with pytest.raises(RuntimeError):
        HttpModel("http://host", "k", "m", open=open_, wait=waits.append).complete_json("s", "u")
    script[:] = [io.BytesIO(b'{"base_resp": {"status_code": 7}}')]
    with pytest.raises(RuntimeError):
        HttpModel("http://host", "k", "m", open=open_, wait=waits.append).complete_json("s", "u")


def test_judge_claims(spark):
    def build():
        def answer(system, user):
            text = json.loads(user[user.index('{"claim"') if '{"claim"' in user else user.index("{\n") :])["source_text"]
            if text == "fail":
                raise RuntimeError("down")
            return {"verdict": " Supports " if text == "yes" else "maybe"}

        return ScriptedModel(answer)

    rows = [(1, "a", "is_a", "b", "q", "yes"), (2, "a", "is_a", "b", None, "fail"), (3, None, "part_of", "b", None, None)]
    obs = spark.createDataFrame(rows, "id long, subject string, relation string, object string, model_quote string, source_text string")
    out = judge.judge_claims(obs, build, {"is_a": "kind"}, workers=2)
    got = {r["observation_id"]: (r["verdict"], r["error"]) for r in out.collect()}
    assert got == {1: ("supports", None), 2: (None, "down"), 3: ("insufficient", None)}
    known = out.where("verdict is not null")
    assert [r["id"] for r in judge.unjudged(obs, known, "scripted").collect()] == [2]
    assert judge.unjudged(obs, known, "other").count() == 3
    assert judge.judge_claims(obs.limit(0), build, {}).count() == 0


def tables(spark, empty=False):
    made = {
        "sources": ("id long, source_key string, name string, source_type string, uri string, version string, content_hash string, language string, content string", [(1, "k", "S", "book", "u", "v", "h", "en", "secret")]),
        "entities": ("id long, canonical_name string, definition string", [(1, "</script>", "d"), (2, "B", "")]),
        "entity_aliases": ("id long, entity_id long, name string", [(2, 1, "z"), (1, 1, "y")]),
        "entity_definition_syntheses": ("id long, entity_id long, synthesizer_model string, prompt_version string, observation_fingerprint string, supporting_observations string, rejected_candidates string, limitation string", [(1, 1, "old", "p", "f", "[]", "[]", ""), (2, 1, "new", "p", "f", "[]", "[]", "")]),
        "claims": ("id long, subject_id long, relation string, object_id long", [(1, 1, "is_a", 2)]),
        "evidence": ("id long, entity_id long, target_key string, source_id long, passage_ids string, passage_version string, excerpt string, model_quote string, location string, polarity string, observed_entity_type string, extraction_model string, extraction_prompt_version string, validator_model string, validator_prompt_version string, validator_verdict string, validator_reason string", [(1, 1, "entity:1", 1, '["P1"]', "pv", "x", "q", "l", "support", "task", "m", "v", None, "", "", ""), (2, 1, "entity:1", 1, "broken", "pv", "y", "q", "l", "support", "data", "m", "v", "", "", "", "")]),
        "entity_observations": ("id long, entity_id long, name string, definition string, observed_entity_type string, aliases string, source_id long, chunk_index int, passage_ids string, location string, source_text string, model_quote string, resolution_outcome string, resolution_reason string, candidate_entity_ids string, resolver_model string, resolver_prompt_version string", [(1, None, "n", "", "task", "[]", 1, 0, '["P1"]', "l", "t", "q", "new", "", "[2,1]", "m", "v")]),
    }
    return {k: spark.createDataFrame([] if empty else rows, schema) for k, (schema, rows) in made.items()}


def test_document(spark, tmp_path):
    document.write_json(tables(spark), str(tmp_path / "g.json"))
    got = json.loads((tmp_path / "g.json").read_text())
    assert list(got) == list(document.SECTIONS)
    first, second = got["entities"]
    assert first["aliases"] == ["y", "z"] and first["definition_synthesis"]["model"] == "new"
    assert [t["entity_type"] for t in first["type_profile"]] == ["data", "task"]
    assert second["aliases"] == [] and "definition_synthesis" not in second
    assert got["claims"] == [{"id": 1, "subject_id": 1, "subject": "</script>", "relation": "is_a", "object_id": 2, "object": "B"}]
    assert [e["passage_ids"] for e in got["evidence"]] == [["P1"], []] and got["evidence"][0]["source"]["uri"] == "u"
    assert got["entity_observations"][0]["resolution"]["candidate_entity_ids"] == [2, 1] and got["entity_observations"][0]["entity_id"] is None
    assert "content" not in got["sources"][0]
    document.write_html(tables(spark), str(tmp_path / "g.html"))
    page = (tmp_path / "g.html").read_text()
    assert page.count("</script>") == 2
    document.write_lines(tables(spark), str(tmp_path / "lines"))
    assert spark.read.json(str(tmp_path / "lines" / "entities")).count() == 2


def test_empty_document(spark, tmp_path):
    document.write_json(tables(spark, empty=True), str(tmp_path / "g.json"))
    assert json.loads((tmp_path / "g.json").read_text()) == {s: [] for s in document.SECTIONS}

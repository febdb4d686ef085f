import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from corpusgraph.functions.names import compact, normalize_name, reference_key
from corpusgraph.functions import keys
from corpusgraph.operators import graph, keyed, report, resolve, write
from corpusgraph.sources import ingest, segment


def test_name_keys(spark):
    rows = spark.createDataFrame([("  Straße \t B ",), ("ＡＢ c",), ("Plain  Name",), (None,)], "n string")
    got = rows.select(normalize_name(F.col("n")), reference_key(F.col("n")), compact(F.col("n"))).collect()
    assert [tuple(r) for r in got] == [("strasse b", "strasseb", "strasseb"), ("ab c", "abc", "ａｂc"), ("plain name", "plainname", "plainname"), (None, None, None)]


def test_headings():
    assert segment.heading("## Title ##") == (2, "Title")
    assert segment.heading("第3节 内容") == (2, "第3节 内容")
    assert segment.heading("Chapter 4: X") == (1, "Chapter 4: X")
    assert segment.heading("1.2.3 Name") == (3, "1.2.3 Name")
    assert segment.heading("1.2 A sentence.") is None
    assert segment.heading("a\nb") is None


def test_passages_keep_offsets_and_pages():
    text = "# A\n\nfirst\n\n## B\n\n" + "x. " * 600 + "\f last "
    found = segment.passages(text, 500)
    assert all(text[p["start"] : p["end"]] == p["text"] for p in found)
    assert [p["passage_id"] for p in found] == [f"P{i:06d}" for i in range(1, len(found) + 1)]
    assert found[1]["section_path"] == ["A"] and found[3]["section_path"] == ["A", "B"]
    assert found[-1]["page"] == "page 2" and max(len(p["text"]) for p in found) <= 500
    with pytest.raises(ValueError):
        segment.passages("x", 100)


def test_chunks_stay_in_sections_and_overlap():
    text = "# A\n\n" + "\n\n".join("word " * 30 for _ in range(12)) + "\n\n# B\n\nend"
    found = segment.chunks(text, 500, 200)
    assert {tuple(c["section_path"]) for c in found} == {("A",), ("B",)}
    assert [c["chunk_index"] for c in found] == list(range(len(found)))
    assert found[1]["passage_ids"][0] == found[0]["passage_ids"][-1]


def test_catalog_and_load(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n\ntwo")
    (tmp_path / "b.html").write_text("<style>x</style><h1>T</h1><p>a&amp;b</p>")
    (tmp_path / "c.jsonl").write_text('"x"\n\n{"text": "y"}\n{"content": "z"}')
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    at = tmp_path / "sources.json"
    at.write_text(json.dumps({"sources": [{"name": n, "type": "t", "path": n} for n in ("a.txt", "b.html", "c.jsonl", "d.pdf")]}))
    got = {r["name"]: r for r in ingest.load(ingest.catalog(spark, str(at)), pdf=lambda raw: "p1\fp2").collect()}
    assert got["a.txt"]["content"] == "one\n\ntwo" and got["a.txt"]["version"] == got["a.txt"]["content_hash"][:12]
    assert got["b.html"]["content"] == "# T\n\na&b" and got["c.jsonl"]["content"] == "x\n\ny\n\nz" and got["d.pdf"]["content"] == "p1\fp2"
    at.write_text(json.dumps({"sources": [{"name": "a"}]}))
    with pytest.raises(ValueError):
        ingest.catalog(spark, str(at))


def _greedy(old, new):
    out, done = {}, []
    for s, o in old:
        out.setdefault(s, set()).add(o)
    for i, s, o in new:
        seen, todo = {o}, [o]
        while todo:
            for x in out.get(todo.pop(), ()):
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        if s not in seen:
            out.setdefault(s, set()).add(o)
            done.append(i)
    return done


@pytest.mark.parametrize("seed", [1, 2])
def test_admission_is_as_one_by_one(spark, seed):
    rng = random.Random(seed)
    old = [(i, j) for i in range(8) for j in range(i + 1, 8) if rng.random() < 0.15]
    new = [(n, rng.randrange(8), rng.randrange(8)) for n in range(14)]
    got = graph.admitted(spark.createDataFrame(old, "s long, o long"), spark.createDataFrame(new, "id long, s long, o long"))
    assert sorted(r["id"] for r in got.where("admitted").collect()) == _greedy(old, new)


def test_keyed_writes(spark):
    t = spark.createDataFrame([(1, "a", 1)], "id long, k string, v long")
    rows = spark.createDataFrame([(2, "a", 2), (4, "b", 4), (3, "b", 3)], "id long, k string, v long")
    assert sorted(r["v"] for r in keyed.insert_or_ignore(t, rows, ["k"]).collect()) == [1, 3]
    assert sorted(r["v"] for r in keyed.upsert(t, rows, ["k"], "id").collect()) == [2, 4]
    ids = keyed.with_ids(rows.drop("id"), 10, "k", "v").orderBy("id").collect()
    assert [(r["id"], r["v"]) for r in ids] == [(11, 2), (12, 3), (13, 4)]


def test_snapshots(spark, tmp_path):
    store = keyed.Snapshots(spark, str(tmp_path / "s"))
    store.commit(a=spark.range(3))
    store.commit(b=spark.range(2))
    assert (store.read("a").count(), store.read("b").count()) == (3, 2)


def test_two_writers_of_one_commit(spark, tmp_path):
    store = keyed.Snapshots(spark, str(tmp_path))
    store.commit(a=spark.range(1))
    late = keyed.Snapshots(spark, str(tmp_path))
    late._head = lambda: 1 if late.first else 2
    late.first = True
    store.commit(a=spark.range(2))
    with pytest.raises(RuntimeError):
        late.commit(a=spark.range(3))
    assert store.read("a").count() == 2


def test_observations_are_written_once(spark):
    names = "id long, observation_key string, source_id long, chunk_index long, subject_name string, relation string, object_name string, polarity string, source_text string, model_quote string, passage_ids array<string>"
    rows = spark.createDataFrame([(None, None, 1, 0, "A b", "is_a", "C", "support", 'say "x"\n', "", ["P1", "P2"]), (None, None, 1, 0, "a B", "is_a", "c", "support", 'say "x"\n', "", ["P1", "P2"]), (None, None, 1, 1, "A", "is_a", "C", "support", "t", "", [])], names)
    table = write.claim_observations(spark.createDataFrame([], names), rows, "m", "v1")
    assert sorted(r["id"] for r in table.collect()) == [1, 2]
    again = write.claim_observations(keyed.cut(table), rows, "m", "v1")
    assert again.count() == 2 and write.claim_observations(keyed.cut(table), rows, "m", "v2").count() == 4
    payload = [1, 0, "ab", "is_a", "c", "support", 'say "x"\n', "", ["P1", "P2"], "m", "v1"]
    want = hashlib.sha256(json.dumps(payload, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
    assert want in {r["observation_key"] for r in table.collect()}
    one = spark.createDataFrame([("t\u00e9", "q", ["a", "b"], 1, None), ("", None, None, None, 2)], "s string, q string, p array<string>, e long, c long")
    got = one.select(keys.excerpt_hash(F.col("s"), F.col("q"), F.col("p")), keys.target_key(F.col("e"), F.col("c"))).collect()
    assert got[0][0] == hashlib.sha256("\0".join(("t\u00e9", "q", json.dumps(["a", "b"]))).encode()).hexdigest()
    assert got[1][0] == hashlib.sha256(b"\0\0[]").hexdigest() and [r[1] for r in got] == ["entity:1", "claim:2"]
    assert keys.processing_hash("h", model="a", most=5) != keys.processing_hash("h", model="a", most=6)


def test_own_judgment_comes_first(spark):
    judgments = spark.createDataFrame([(1, 7, "a", "v1", "supports"), (2, 7, "b", "v1", "contradicts"), (3, 8, "b", "v1", "supports")], "id long, observation_id long, validator_model string, validator_prompt_version string, verdict string")
    seen = spark.createDataFrame([(7,), (8,), (9,)], "id long")
    told = lambda *v: {r["id"]: r["verdict"] for r in report.judged(seen, judgments, *v).collect()}
    assert told() == {7: "contradicts", 8: "supports", 9: None} and told(("a", "v1")) == {7: "supports", 8: "supports", 9: None}


def test_long_passages_are_cut_before_the_end():
    text = "a" * 150 + "\n" + "b" * 48 + ". " + "c" * 100
    assert segment.passages(text, 200)[0]["end"] == 151 or segment.passages(text, 200)[0]["text"] == "a" * 150


def test_endpoints_need_one_entity(spark):
    obs = spark.createDataFrame([(1, 1, 0, "x", None, "y", None), (2, 1, 0, "z", 9, "x", None)], "id long, source_id long, chunk_index int, subject_reference_key string, subject_entity_id long, object_reference_key string, object_entity_id long")
    names = spark.createDataFrame([("x", 5), ("y", 6), ("y", 7)], "key string, entity_id long")
    got = {r["id"]: (r["subject_entity_id"], r["object_entity_id"]) for r in resolve.resolve_endpoints(obs, names).collect()}
    assert got == {1: (5, None), 2: (9, 5)}


def test_fuzzy_candidates(spark):
    q = spark.createDataFrame([(1, "linear regression")], "query_id long, name string")
    n = spark.createDataFrame([(1, "linear regresion"), (2, "regression"), (3, "zzz")], "entity_id long, name string")
    assert [(r["entity_id"]) for r in resolve.candidates(q, n, 0.35).orderBy("rank").collect()] == [1, 2]


def test_stream_adds_each_version_once(spark, tmp_path):
    from corpusgraph.streaming import ingest as stream

    rows = spark.createDataFrame([(1, "t", "s"), (2, "t", "s"), (3, "u", "s")], "doc_id long, text string, source string")
    rows.write.parquet(str(tmp_path / "in"))
    store = keyed.Snapshots(spark, str(tmp_path / "store"))
    for n in range(2):
        stream(spark, str(tmp_path / "in"), "doc_id long, text string, source string", store, str(tmp_path / f"cp{n}")).awaitTermination()
    assert store.read("sources").count() == 2

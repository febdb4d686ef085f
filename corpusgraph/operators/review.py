"""A model's decisions on names, entities and definitions: asked in parallel, checked by fixed rules."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.functions.model import JsonModel
from corpusgraph.functions.names import reference_key
from corpusgraph.functions.vocabulary import ENTITY_TYPES, listed

VERSIONS = {"identity": "identity-1", "promotion": "promotion-1", "definition": "definition-1", "pair": "pair-1"}
SYSTEM = "You decide what a knowledge graph's names mean from the texts given. Where they don't settle it, the decision is uncertain. Answer with one JSON object."
TASKS = {
    "identity": 'Is the observation one of the candidates? Equal names alone don\'t make them the same, and a chapter isn\'t what it tells.\nAnswer {"decision": "same, new or uncertain", "candidate_id": null, "canonical_name": "", "reason": ""}.',
    "promotion": f'Do the texts show a lasting thing of its own behind the name?\nTypes:\n{listed(ENTITY_TYPES)}\nevidence_refs are 1 to 3 of the passages given. Answer {{"decision": "same, new or uncertain", "candidate_id": null, "canonical_name": "", "definition": "", "entity_type": "", "aliases": [], "evidence_refs": [{{"source_id": 0, "passage_id": ""}}], "reason": ""}}.',
    "definition": 'Write one definition that the observations support, citing 1 to 5 of them.\nAnswer {"definition": "", "supporting_observations": [{"observation_id": 0, "passage_ids": [], "support": ""}], "rejected_candidates": [], "limitation": ""}.',
    "pair": 'Are the two entities the same?\nAnswer {"decision": "same, new or uncertain", "canonical_name": "", "reason": ""}.',
}


def _text(value: object) -> str:
    return "" if value is None else str(value).strip()


def _id(value: object) -> int | None:
    try:
        return int(value)  # type: ignore[call-overload]
    except (TypeError, ValueError):
        return None


def _decision(answer: dict, candidates: set[int]) -> tuple[str, int | None, str]:
    said, why = _text(answer.get("decision")).lower(), _text(answer.get("reason"))
    if said == "same":
        chosen = _id(answer.get("candidate_id"))
        return ("same", chosen, why) if chosen in candidates else ("uncertain", None, why or "candidate_id is none of the candidates")
    return (said, None, why) if said in ("new", "uncertain") else ("uncertain", None, why or "unknown decision")


def identity(answer: dict, asked: dict) -> dict:
    """same of a given candidate, new or uncertain; the name falls back on the observed one."""
    decision, entity, why = _decision(answer, {c["id"] for c in asked["candidates"]})
    return {"decision": decision, "entity_id": entity, "canonical_name": _text(answer.get("canonical_name")) or asked["name"], "reason": why}


def promotion(answer: dict, asked: dict) -> dict:
    """same of a given candidate; new with a name, a definition, a type and 1 to 3 distinct passages given; else uncertain."""
    decision, entity, why = _decision(answer, {c["id"] for c in asked["candidates"]})
    out = {"decision": decision, "entity_id": entity, "reason": why}
    if decision != "new":
        return out
    name, told, kind, refs = _text(answer.get("canonical_name")), _text(answer.get("definition")), _text(answer.get("entity_type")), answer.get("evidence_refs")
    given = {(e["source_id"], p) for e in asked["evidence"] for p in e["passage_ids"]}
    cited = {(_id(r.get("source_id")), _text(r.get("passage_id"))) if isinstance(r, dict) else None for r in refs} if isinstance(refs, list) and len(refs) <= 3 else set()
    if not name or len(told) < 4 or kind not in ENTITY_TYPES or not cited or not cited <= given:
        return {**out, "decision": "uncertain", "reason": why or "new lacks a name, a definition, a type or passages that were given"}
    others = answer.get("aliases") if isinstance(answer.get("aliases"), list) else []
    aliases = [a.strip() for a in others if isinstance(a, str) and a.strip()]
    refs = [{"source_id": s, "passage_id": p} for s, p in sorted(cited)]
    return {**out, "canonical_name": name, "definition": told, "entity_type": kind, "aliases": aliases, "evidence_refs": refs}


def definition(answer: dict, asked: dict) -> dict:
    """The definition with its citations; ValueError says what is wrong, and the old definition then stays."""
    told, cited = _text(answer.get("definition")), answer.get("supporting_observations")
    if len(told) < 4:
        raise ValueError("no definition")
    if not isinstance(cited, list) or not 1 <= len(cited) <= 5:
        raise ValueError("supporting_observations must name 1 to 5")
    known = {o["id"]: set(o["passage_ids"]) for o in asked["observations"]}
    support = []
    for c in cited:
        at = _id(c.get("observation_id")) if isinstance(c, dict) else None
        if at not in known:
            raise ValueError(f"observation {at} isn't the entity's")
        ids = [i for i in map(_text, c["passage_ids"]) if i] if isinstance(c.get("passage_ids"), list) else []
        if not ids or not set(ids) <= known[at]:
            raise ValueError(f"observation {at} hasn't these passages")
        if not _text(c.get("support")):
            raise ValueError(f"observation {at} has no support text")
        support.append({"observation_id": at, "passage_ids": ids, "support": _text(c["support"])})
    refused, limit = answer.get("rejected_candidates", []), answer.get("limitation", "")
    if not isinstance(refused, list) or not all(isinstance(x, str) for x in refused):
        raise ValueError("rejected_candidates must be strings")
    if not isinstance(limit, str):
        raise ValueError("limitation must be a string")
    return {"definition": told, "supporting_observations": support, "rejected_candidates": [x.strip() for x in refused if x.strip()], "limitation": limit.strip()}


def pair(answer: dict, asked: dict) -> dict:
    """same, uncertain, or distinct for anything else."""
    said = _text(answer.get("decision")).lower()
    return {"decision": said if said in ("same", "uncertain") else "distinct", "canonical_name": _text(answer.get("canonical_name")), "reason": _text(answer.get("reason"))}


CHECKS = {"identity": identity, "promotion": promotion, "definition": definition, "pair": pair}


def unreviewed(asked: DataFrame, reviews: DataFrame, kind: str, model: str) -> DataFrame:
    """Rows of asked (key, fingerprint, payload) without a review of this fingerprint, model and version."""
    known = reviews.where((F.col("model") == model) & (F.col("prompt_version") == VERSIONS[kind])).select("key", "fingerprint")
    return asked.join(known.distinct(), ["key", "fingerprint"], "left_anti")


def review(asked: DataFrame, kind: str, build: Callable[[], JsonModel], workers: int = 1) -> DataFrame:
    """asked (key, fingerprint, payload: JSON of what the kind's check reads) -> (key, fingerprint, model, prompt_version, result, error).

    result is the JSON of the checked decision. A failed call or a refused answer gives its error and a null result, and
    stops no other. Write the rows once before using them: a lost executor's calls are made again.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = build()
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                result = error = None
                try:
                    result = json.dumps(CHECKS[kind](model.complete_json(SYSTEM, f"{TASKS[kind]}\n{r.payload}"), json.loads(r.payload)), ensure_ascii=False)
                except (RuntimeError, ValueError) as e:
                    error = str(e)
                rows.append((r.key, r.fingerprint, model.name, VERSIONS[kind], result, error))
            yield pd.DataFrame(rows, columns=["key", "fingerprint", "model", "prompt_version", "result", "error"])

    schema = "key string, fingerprint string, model string, prompt_version string, result string, error string"
    return asked.select("key", "fingerprint", "payload").repartition(workers, "key").mapInPandas(run, schema)


def promoted(reviews: DataFrame, names: DataFrame) -> DataFrame:
    """(key, decision, result) of valid promotions; a new name that names (key, entity_id) hold, or that an earlier key takes, is uncertain."""
    rows = reviews.where("result is not null").select("key", "result", F.get_json_object("result", "$.decision").alias("decision"), reference_key(F.get_json_object("result", "$.canonical_name")).alias("name"))
    held = names.select(F.col("key").alias("name"), F.lit(True).alias("held")).distinct()
    first = rows.where("decision = 'new'").groupBy("name").agg(F.min("key").alias("first"))
    rows = rows.join(held, "name", "left").join(first, "name", "left")
    taken = (F.col("decision") == "new") & (F.coalesce("held", F.lit(False)) | (F.col("first") < F.col("key")))
    return rows.select("key", F.when(taken, "uncertain").otherwise(F.col("decision")).alias("decision"), "result")


def definitions_asked(entities: DataFrame, observations: DataFrame, least: int = 2) -> DataFrame:
    """(key, fingerprint, payload) of entities with at least least observations; the fingerprint covers all of them."""
    one = F.struct("id", "name", "definition", F.col("observed_entity_type").alias("entity_type"), F.from_json("passage_ids", "array<string>").alias("passage_ids"), "source_text", "model_quote")
    held = observations.where("entity_id is not null").groupBy("entity_id").agg(F.array_sort(F.collect_list(one)).alias("observations")).where(F.size("observations") >= least)
    rows = entities.select(F.col("id").alias("entity_id"), "canonical_name").join(held, "entity_id")
    return rows.select(F.col("entity_id").cast("string").alias("key"), F.sha2(F.to_json("observations"), 256).alias("fingerprint"), F.to_json(F.struct("canonical_name", "observations")).alias("payload"))


def defined(entities: DataFrame, reviews: DataFrame) -> DataFrame:
    """entities with the definitions of valid reviews, the newest of a key if reviews have an id; others keep theirs."""
    newest = F.struct(*[c for c in ("id", "fingerprint") if c in reviews.columns])
    told = reviews.where("result is not null").groupBy("key").agg(F.max_by("result", newest).alias("result"))
    told = told.select(F.col("key").cast("long").alias("id"), F.get_json_object("result", "$.definition").alias("told"))
    return entities.join(told, "id", "left").withColumn("definition", F.coalesce("told", "definition")).select(*entities.columns)


def pairs_asked(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """(key, fingerprint, payload) of resolve.reconcile_pairs; the key is left:right."""
    side = lambda s: entities.select(F.col("id").alias(f"{s}_id"), F.struct("id", "canonical_name", "definition").alias(s))
    rows = pairs.join(side("left"), "left_id").join(side("right"), "right_id").withColumn("payload", F.to_json(F.struct("left", "right")))
    return rows.select(F.concat_ws(":", "left_id", "right_id").alias("key"), F.sha2("payload", 256).alias("fingerprint"), "payload")


def merges(reviews: DataFrame) -> DataFrame:
    """(old, new) of pairs judged the same, for materialize.merged_claims; chains lead to the smallest id."""
    from corpusgraph.operators import graph

    same = reviews.where(F.get_json_object("result", "$.decision") == "same").select(F.split("key", ":").alias("k"))
    edges = same.select(F.get("k", F.lit(0)).cast("long").alias("s"), F.get("k", F.lit(1)).cast("long").alias("o"))
    nodes = edges.select(F.col("s").alias("id")).union(edges.select("o")).distinct()
    return graph.components(nodes, edges).where("id <> component").select(F.col("id").alias("old"), F.col("component").alias("new"))

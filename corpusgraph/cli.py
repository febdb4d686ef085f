"""Commands on a graph kept in a Snapshots folder: python -m corpusgraph.cli --store FOLDER COMMAND."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.functions.model import JsonModel, configured
from corpusgraph.operators import document, integrity, merge, replay, report
from corpusgraph.operators.keyed import Snapshots

#: The store's tables and columns.
TABLES = {
    "sources": "id long, source_key string, name string, source_type string, uri string, version string, content_hash string, language string, content string",
    "entities": "id long, canonical_name string, normalized_name string, definition string",
    "entity_aliases": "id long, entity_id long, name string, normalized_name string",
    "entity_definition_syntheses": "id long, entity_id long, synthesizer_model string, prompt_version string, observation_fingerprint string, supporting_observations string, rejected_candidates string, limitation string",
    "claims": "id long, subject_id long, relation string, object_id long",
    "evidence": "id long, entity_id long, claim_id long, target_key string, source_id long, excerpt_hash string, passage_ids string, passage_version string, excerpt string, model_quote string, location string, polarity string, observed_entity_type string, extraction_model string, extraction_prompt_version string, validator_model string, validator_prompt_version string, validator_verdict string, validator_reason string",
    "entity_observations": "id long, entity_id long, name string, definition string, observed_entity_type string, aliases string, source_id long, chunk_index int, passage_ids string, location string, source_text string, model_quote string, resolution_outcome string, resolution_reason string, candidate_entity_ids string, resolver_model string, resolver_prompt_version string",
    "claim_observations": "id long, subject_name string, subject_reference_key string, subject_entity_id long, relation string, object_name string, object_reference_key string, object_entity_id long, polarity string, claim_id long, source_id long, chunk_index int, passage_ids string, location string, passage_version string, source_text string, model_quote string, extraction_model string, extraction_prompt_version string, materialization_error string",
    "judgments": "id long, observation_id long, validator_model string, validator_prompt_version string, verdict string, reason string",
    "progress": "seq long, source_id long, chunk_index int, chunk_hash string, status string, result string, updated_at timestamp",
    "rejections": "id long, source_id long, chunk_index int, message string",
}
_GRAPH = {"kg_entity": "entities", "kg_alias": "entity_aliases", "kg_claim": "claims", "kg_evidence": "evidence", "kg_entity_observation": "entity_observations", "kg_claim_observation": "claim_observations", "kg_judgment": "judgments"}


def opened(store: Snapshots) -> dict[str, DataFrame]:
    """All tables; those that no commit has yet are empty, and columns that an older version lacks are null."""
    known, out = store.versions(), {}
    for name, schema in TABLES.items():
        want = store.spark.createDataFrame([], schema)
        out[name] = want if name not in known else store.read(name).unionByName(want, allowMissingColumns=True)
    return out


def status(t: dict[str, DataFrame]) -> dict:
    """The status document; each part is an aggregate of few rows."""
    pairs = lambda df: {r[0]: r[1] for r in df.orderBy(df.columns[0]).collect()}
    return {
        "counts": pairs(report.counts({k: t[k] for k in TABLES})),
        "entity_types": {r["observed_entity_type"]: {k: v for k, v in r.asDict().items() if k != "observed_entity_type"} for r in report.entity_type_stats(t["evidence"]).orderBy("observed_entity_type").collect()},
        "multi_typed_entities": report.multi_typed(t["evidence"]).first()["multi_typed"],
        "relations": pairs(report.count_by(t["claims"], "relation")),
        "progress": pairs(report.count_by(report.latest_progress(t["progress"]), "status")),
        "observations": report.observation_report(t["claim_observations"], t["judgments"]).first().asDict(),
        "entity_observations": report.entity_observation_report(t["entity_observations"]).first().asDict(),
    }


def check(t: dict[str, DataFrame]) -> dict:
    found = {r["issue"]: r["n"] or 0 for r in integrity.integrity_report({k: t[v] for k, v in _GRAPH.items()}).collect()}
    return {"ok": not any(found.values()), **found}


def audit(t: dict[str, DataFrame], detail: int = 500) -> dict:
    listed = lambda df: [json.loads(x) for x in df.toJSON().collect()]
    return {
        "items": listed(report.audit(t["claim_observations"], t["judgments"], t["entities"], detail)),
        "candidates": listed(report.promotion_candidates(t["claim_observations"]).orderBy(F.desc("passage_count"), "key").limit(detail)),
        "rejections": listed(report.rejection_report(t["rejections"])),
    }


def main(argv: list[str] | None = None, spark: SparkSession | None = None, build: Callable[[], JsonModel] | None = None) -> int:
    """build makes the model, else the environment names one (functions.model.configured). 0: done; 1: check found something; 2: the message on standard error says what failed."""
    parser = argparse.ArgumentParser(prog="corpusgraph")
    parser.add_argument("--store", required=True)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("init", "status", "check", "audit", "export", "viz", "replay-pending", "reconcile"):
        one = commands.add_parser(name)
        if name in ("replay-pending", "reconcile"):
            one.add_argument("--limit", type=int, default=None if name == "replay-pending" else 20)
            one.add_argument("--workers", type=int, default=1)
        if name in ("export", "viz"):
            one.add_argument("--out", required=True)
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("corpusgraph").getOrCreate()
    try:
        store = Snapshots(spark, args.store)
        if args.command == "init" and not store.versions():
            store.commit(**opened(store))
        t = opened(store)
        if args.command in ("export", "viz"):
            (document.write_json if args.command == "export" else document.write_html)(t, args.out)
            return 0
        if args.command == "replay-pending":
            changed, counts = replay.replay(t, build or configured(), args.workers, args.limit)
            store.commit(**changed)
            print(json.dumps({**counts, "pending": status(opened(store))["observations"]}, ensure_ascii=False, indent=2))
            return 0
        if args.command == "reconcile":
            if not (build := build or configured()):
                raise ValueError("reconcile needs a model")
            changed, counts = merge.reconcile(t, build, args.workers, args.limit)
            store.commit(**changed)
            print(json.dumps(counts, ensure_ascii=False, indent=2))
            return 0
        told = {"init": lambda: status(t)["counts"], "status": lambda: status(t), "check": lambda: check(t), "audit": lambda: audit(t)}[args.command]()
        print(json.dumps(told, ensure_ascii=False, indent=2, default=str))
        return 0 if told.get("ok", True) else 1
    except (OSError, RuntimeError, ValueError) as e:
        print(e, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())

"""Verdicts of a model on claim observations."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.functions.model import JsonModel

PROMPT_VERSION = "claim-judge-1"
VERDICTS = ("supports", "contradicts", "insufficient")
SYSTEM = "You judge whether a source text states a claim. The text is the only evidence; what is generally known doesn't count. Where you aren't sure, the verdict is insufficient. Answer with one JSON object."
TASK = """Verdicts:
supports: the text states the claim, and the relation's definition below holds, exclusions included.
contradicts: the text denies the claim.
insufficient: anything else, such as words that merely occur together, an order of topics, or an exclusion that applies.
Answer {"verdict": "...", "reason": "..."}, the reason in a few words.
"""
OUT = "observation_id long, model string, prompt_version string, verdict string, reason string, error string"


def prompt(subject: str, relation: str, object: str, quote: str, text: str, definition: str) -> str:
    asked = {"claim": {"subject": subject, "relation": relation, "object": object}, "definition": definition, "quote": quote, "source_text": text}
    return TASK + json.dumps(asked, ensure_ascii=False, indent=1)


def verdict(answer: dict) -> tuple[str, str]:
    """Verdict and reason of an answer; an unknown verdict is insufficient."""
    said, why = str(answer.get("verdict", "")).strip().lower(), str(answer.get("reason", "")).strip()
    return (said, why) if said in VERDICTS else ("insufficient", why or "unknown verdict")


def unjudged(observations: DataFrame, judgments: DataFrame, model: str, version: str = PROMPT_VERSION) -> DataFrame:
    """Observations without a judgment of this model and prompt version."""
    known = judgments.where((F.col("model") == model) & (F.col("prompt_version") == version)).select(F.col("observation_id").alias("id"))
    return observations.join(known, "id", "left_anti")


def judge_claims(observations: DataFrame, build: Callable[[], JsonModel], definitions: dict[str, str], workers: int = 1) -> DataFrame:
    """observations (id, subject, relation, object, model_quote, source_text) -> judgments, one a row.

    workers partitions call the model at a time, each with a model of its own. A call that fails gives a row with its error
    and a null verdict and stops no other; nulls are empty strings in the prompt. A lost executor's calls are made again, so
    write the result once (keyed.insert_or_ignore on observation_id, model and prompt_version) before using it twice.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = build()
        for batch in batches:
            rows = []
            for r in batch.fillna("").itertuples(index=False):
                said = why = error = None
                try:
                    said, why = verdict(model.complete_json(SYSTEM, prompt(r.subject, r.relation, r.object, r.model_quote, r.source_text, definitions.get(r.relation, ""))))
                except (RuntimeError, ValueError) as e:
                    error = str(e)
                rows.append((r.id, model.name, PROMPT_VERSION, said, why, error))
            yield pd.DataFrame(rows, columns=["observation_id", "model", "prompt_version", "verdict", "reason", "error"])

    asked = observations.select("id", "subject", "relation", "object", "model_quote", "source_text")
    return asked.repartition(workers, "id").mapInPandas(run, OUT)

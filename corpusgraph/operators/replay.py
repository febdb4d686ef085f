"""Another pass over what waits: ends that names now resolve, verdicts that lack, then claims and evidence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.functions import keys
from corpusgraph.functions.model import JsonModel
from corpusgraph.functions.vocabulary import RELATIONS
from corpusgraph.operators import judge, materialize, report, resolve, write
from corpusgraph.operators.keyed import cut

_ENDS = {"subject_entity_id": "subject_id", "relation": "relation", "object_entity_id": "object_id"}


def resolved(t: dict[str, DataFrame]) -> DataFrame:
    """claim_observations whose unset ends are those entities that alone have the end's reference key as a name."""
    names = resolve.names_of(t["entities"], t["entity_aliases"], "normalized_name", "normalized_name")
    return resolve.resolve_endpoints(t["claim_observations"], names.withColumn("key", F.regexp_replace("key", r"(?U)\s+", "")))


def judged(t: dict[str, DataFrame], build: Callable[[], JsonModel], workers: int = 1, limit: int | None = None) -> DataFrame:
    """judgments with one for each observation that has neither a claim nor any judgment; limit takes the lowest ids.

    A call that fails leaves its observation without one, for the next pass.
    """
    asked = t["claim_observations"].where("claim_id is null").join(t["judgments"].select(F.col("observation_id").alias("id")), "id", "left_anti")
    if limit is not None:
        asked = asked.orderBy("id").limit(max(0, limit))
    asked = asked.select("id", F.col("subject_name").alias("subject"), "relation", F.col("object_name").alias("object"), "model_quote", "source_text")
    told = cut(judge.judge_claims(asked, build, RELATIONS, workers)).where("verdict is not null")
    return write.judgments(t["judgments"], told.withColumnsRenamed({"model": "validator_model", "prompt_version": "validator_prompt_version"}))


def materialized(t: dict[str, DataFrame], validator: tuple[str, str] | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """New claims, evidence and claim_observations, and (id, outcome) of all observations, as if taken in id order.

    A materialised observation names its claim, whose id is given in that order, and gives it one evidence row; a blocked one
    keeps the reason. Others stay as they are, so a second pass changes nothing.
    """
    seen, judgments = t["claim_observations"], t["judgments"]
    told = cut(materialize.materialize(seen, judgments, t["claims"], validator=validator))
    fit = seen.join(told.where("outcome = 'materialized'").select("id"), "id")
    claims = cut(write.added(t["claims"], fit.select("id", *[F.col(k).alias(v) for k, v in _ENDS.items()]), list(_ENDS.values()), "id"))
    # a claim's triple is its key, so that each observation meets one
    made = fit.select("id", *_ENDS).join(claims.select(F.col("id").alias("made"), *[F.col(v).alias(k) for k, v in _ENDS.items()]), list(_ENDS)).select("id", "made")
    outcome = told.join(made, "id", "left")

    said = report.deciding(judgments, validator)
    said = said.select(F.col("observation_id").alias("id"), "validator_model", "validator_prompt_version", F.col("verdict").alias("validator_verdict"), F.col("reason").alias("validator_reason"))
    ids = F.from_json("passage_ids", "array<string>")
    rows = seen.drop("claim_id").join(made.withColumnRenamed("made", "claim_id"), "id").join(said, "id").withColumns({
        "entity_id": F.lit(None).cast("long"),
        "observed_entity_type": F.lit(""),
        "excerpt": F.col("source_text"),
        "excerpt_hash": keys.excerpt_hash(F.col("source_text"), F.col("model_quote"), ids),
        "target_key": F.concat(F.lit("claim:"), F.col("claim_id").cast("string")),
        "cg_at": F.col("id"),
    })
    evidence = write.added(t["evidence"], rows, write.EVIDENCE_KEY, "cg_at")

    blocked = F.col("outcome") == "blocked"
    why = F.when(F.col("polarity") == "oppose", "no claim to oppose").otherwise("the edge is a loop or closes a cycle")
    linked = seen.join(outcome, "id", "left").withColumns({
        "claim_id": F.when(~blocked, F.coalesce("made", "claim_id")),
        "materialization_error": F.when(blocked, why).when(F.col("made").isNotNull(), "").otherwise(F.col("materialization_error")),
    })
    return {"claims": claims, "evidence": evidence, "claim_observations": linked.select(*seen.columns)}, told


def replay(t: dict[str, DataFrame], build: Callable[[], JsonModel] | None = None, workers: int = 1, limit: int | None = None) -> tuple[dict[str, DataFrame], dict[str, int]]:
    """The tables that a pass changes, and its counts; without build no verdict is asked for."""
    was = t["claim_observations"]
    open_ends = lambda df: df.agg(F.count_if(F.col("subject_entity_id").isNull()) + F.count_if(F.col("object_entity_id").isNull())).first()[0]
    t = t | {"claim_observations": cut(resolved(t))}
    told = {"resolved_endpoints": open_ends(was) - open_ends(t["claim_observations"]), "judged": 0}
    out: dict[str, DataFrame] = {}
    validator = None
    if build:
        before = t["judgments"].count()
        out["judgments"] = cut(judged(t, build, workers, limit))
        told["judged"] = out["judgments"].count() - before
        t, validator = t | out, (build().name, judge.PROMPT_VERSION)
    changed, outcome = materialized(t, validator)
    n = {r["outcome"]: r["n"] for r in report.count_by(outcome, "outcome").collect()}
    return out | changed, told | {"materialized": n.get("materialized", 0), "blocked": n.get("blocked", 0)}

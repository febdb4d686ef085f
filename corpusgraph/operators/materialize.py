"""Outcomes of observations, merges of entities, and what both write."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.operators import graph
from corpusgraph.operators.keyed import first_by_key
from corpusgraph.operators.report import expected_verdict, judged


def outcomes(observations: DataFrame, judgments: DataFrame, claims: DataFrame, validator: tuple[str, str] | None = None) -> DataFrame:
    """(id, outcome) of each observation before edges are admitted; the first state that holds.

    admissible is a supported claim that is new or known, append an opposing one of a known claim. The judgment is that of
    validator (model, prompt version) if there is one, else the latest.
    """
    rows = judged(observations, judgments, validator)
    known = claims.select(F.col("id").alias("claim_id"), F.lit(True).alias("linked"))
    same = claims.select(F.col("subject_id").alias("subject_entity_id"), "relation", F.col("object_id").alias("object_entity_id"), F.lit(True).alias("there")).distinct()
    rows = rows.join(known, "claim_id", "left").join(same, ["subject_entity_id", "relation", "object_entity_id"], "left")
    state = (
        F.when(F.col("linked"), "already_materialized")
        .when(F.col("verdict").isNull(), "pending_judgment")
        .when(F.col("verdict") != expected_verdict(), "not_supported")
        .when(F.col("subject_entity_id").isNull() | F.col("object_entity_id").isNull(), "pending_endpoint")
        .when((F.col("polarity") == "oppose") & F.col("there").isNull(), "blocked")
        .when(F.col("polarity") == "oppose", "append")
        .otherwise("admissible")
    )
    return rows.withColumn("outcome", state)


def materialize(observations: DataFrame, judgments: DataFrame, claims: DataFrame, acyclic: tuple[str, ...] = ("is_a", "prerequisite_of"), validator: tuple[str, str] | None = None) -> DataFrame:
    """(id, outcome) after admission in id order: a new edge that is a loop, or closes a cycle of an acyclic relation, is blocked.

    An opposing observation needs a claim that is there, or that a supporting one of a lower id makes.
    """
    rows = outcomes(observations, judgments, claims, validator)
    new = rows.where("outcome = 'admissible' and there is null").select("id", F.col("subject_entity_id").alias("s"), "relation", F.col("object_entity_id").alias("o"))
    # the first observation of an edge decides; later ones of the same edge share its fate
    first = first_by_key(new, ["s", "relation", "o"])
    refused = first.where("s = o").select("s", "relation", "o")
    fresh = {x["relation"] for x in first.where(F.col("relation").isin(*acyclic)).select("relation").distinct().collect()} if acyclic else set()
    for r in (r for r in acyclic if r in fresh):
        old = claims.where(F.col("relation") == r).select(F.col("subject_id").alias("s"), F.col("object_id").alias("o"))
        got = graph.admitted(old, first.where(F.col("relation") == r).select("id", "s", "o"))
        refused = refused.unionAll(got.where("not admitted").select("s", F.lit(r).alias("relation"), "o"))
    refused = refused.distinct().select(F.col("s").alias("subject_entity_id"), "relation", F.col("o").alias("object_entity_id"), F.lit(True).alias("refused"))
    ends = ["subject_entity_id", "relation", "object_entity_id"]
    made = first.select(F.col("s").alias("subject_entity_id"), "relation", F.col("o").alias("object_entity_id"), F.col("id").alias("maker")).join(refused, ends, "left_anti")
    out = rows.join(refused, ends, "left").join(made, ends, "left")
    late = (F.col("outcome") == "blocked") & (F.col("maker") < F.col("id"))
    final = F.when((F.col("outcome") == "append") | late, "materialized").when(F.col("outcome") == "admissible", F.when(F.col("refused"), "blocked").otherwise("materialized")).otherwise(F.col("outcome"))
    return out.select("id", final.alias("outcome"))


def merged_claims(claims: DataFrame, mapping: DataFrame) -> DataFrame:
    """claims with ends renamed by mapping(old, new); loops go, and of equal claims the lowest id stays."""
    out = claims
    for side in ("subject_id", "object_id"):
        m = mapping.select(F.col("old").alias(side), F.col("new").alias("to"))
        out = out.join(m, side, "left").withColumn(side, F.coalesce("to", side)).drop("to")
    out = out.where("subject_id <> object_id")
    return first_by_key(out.select(*claims.columns), ["subject_id", "relation", "object_id"])


def merged_evidence(evidence: DataFrame, mapping: DataFrame) -> DataFrame:
    """Evidence of entities moved by mapping(old, new), without repeats of its key."""
    rows = evidence.where("entity_id is not null").join(mapping.select(F.col("old").alias("entity_id"), "new"), "entity_id", "left").withColumn("entity_id", F.coalesce("new", "entity_id")).drop("new")
    rows = rows.withColumn("target_key", F.concat(F.lit("entity:"), F.col("entity_id").cast("string")))
    return first_by_key(rows.select(*evidence.columns), ["target_key", "source_id", "excerpt_hash", "polarity"])

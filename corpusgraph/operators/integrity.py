"""What is wrong with a graph: missing evidence, broken links, cycles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.operators import graph
from corpusgraph.operators.keyed import written

#: (child, column, parent) of the store's references; parents are named by id.
REFERENCES = (
    ("kg_alias", "entity_id", "kg_entity"),
    ("kg_claim", "subject_id", "kg_entity"),
    ("kg_claim", "object_id", "kg_entity"),
    ("kg_evidence", "entity_id", "kg_entity"),
    ("kg_evidence", "claim_id", "kg_claim"),
    ("kg_entity_observation", "entity_id", "kg_entity"),
    ("kg_claim_observation", "claim_id", "kg_claim"),
    ("kg_judgment", "observation_id", "kg_claim_observation"),
)


def without_evidence(entities: DataFrame, evidence: DataFrame) -> DataFrame:
    return entities.join(evidence.where("entity_id is not null").select(F.col("entity_id").alias("id")).hint("merge"), "id", "left_anti")


def without_support(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    return claims.join(evidence.where("polarity = 'support' and claim_id is not null").select(F.col("claim_id").alias("id")).hint("merge"), "id", "left_anti")


def broken_claim_observations(observations: DataFrame, claims: DataFrame) -> DataFrame:
    """Linked observations whose claim is gone or says something else; an unresolved end isn't a difference."""
    c = claims.select(F.col("id").alias("claim_id"), F.col("subject_id").alias("cs"), F.col("relation").alias("cr"), F.col("object_id").alias("co"))
    rows = observations.where("claim_id is not null").join(c, "claim_id", "left")
    return rows.where("cr is null or cs <> subject_entity_id or cr <> relation or co <> object_entity_id")


def missing_parents(child: DataFrame, column: str, parent: DataFrame) -> DataFrame:
    """Rows of child whose parent is gone; merged, as ids take a driver more memory than the files that they come from."""
    return child.where(F.col(column).isNotNull()).join(parent.select(F.col("id").alias(column)).hint("merge"), column, "left_anti")


def evidence_links(evidence: DataFrame) -> DataFrame:
    """(entity_id, claim_id, polarity, cg_rows): all that the checks ask of evidence, written once for all of them."""
    return written(evidence.groupBy("entity_id", "claim_id", "polarity").agg(F.count("*").alias("cg_rows")))


def reference_violations(tables: dict[str, DataFrame]) -> DataFrame:
    if "cg_rows" not in tables["kg_evidence"].columns:
        tables = tables | {"kg_evidence": evidence_links(tables["kg_evidence"])}
    found = []
    for c, k, p in REFERENCES:
        n = F.coalesce(F.sum("cg_rows"), F.lit(0)) if "cg_rows" in tables[c].columns else F.count("*")
        found.append(missing_parents(tables[c], k, tables[p]).agg(F.lit(c).alias("child"), F.lit(k).alias("col"), F.lit(p).alias("parent"), n.alias("n")))
    return reduce(DataFrame.unionAll, found)


def cycles(claims: DataFrame, relations: tuple[str, ...] = ("is_a", "prerequisite_of")) -> DataFrame:
    """Claims of the acyclic relations that lie on a cycle."""
    out = [graph.cycle_edges(claims.where(F.col("relation") == r).select("id", F.col("subject_id").alias("s"), F.col("object_id").alias("o"))).withColumn("relation", F.lit(r)) for r in relations]
    return reduce(DataFrame.unionAll, out)


def integrity_report(tables: dict[str, DataFrame]) -> DataFrame:
    tables = tables | {"kg_evidence": evidence_links(tables["kg_evidence"])}
    part = lambda name, df: df.agg(F.lit(name).alias("issue"), F.count("*").alias("n"))
    return reduce(
        DataFrame.unionAll,
        [
            reference_violations(tables).agg(F.lit("missing_parent").alias("issue"), F.sum("n").alias("n")),
            part("cycle", cycles(tables["kg_claim"])),
            part("entity_without_evidence", without_evidence(tables["kg_entity"], tables["kg_evidence"])),
            part("claim_without_support", without_support(tables["kg_claim"], tables["kg_evidence"])),
            part("broken_claim_observation", broken_claim_observations(tables["kg_claim_observation"], tables["kg_claim"])),
            part("broken_entity_observation", missing_parents(tables["kg_entity_observation"], "entity_id", tables["kg_entity"])),
        ],
    )

"""Counts, profiles, latest rows and audits over the graph's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusgraph.functions.names import rejection_category
from corpusgraph.operators.keyed import last_by_key


def typed_support(evidence: DataFrame) -> DataFrame:
    return evidence.where("polarity = 'support' and observed_entity_type <> '' and entity_id is not null")


def type_profile(evidence: DataFrame) -> DataFrame:
    """Rows and distinct sources of each type of an entity; types are never collapsed to one."""
    return typed_support(evidence).groupBy("entity_id", "observed_entity_type").agg(F.count("*").alias("observations"), F.count_distinct("source_id").alias("sources"))


def entity_type_stats(evidence: DataFrame) -> DataFrame:
    return typed_support(evidence).groupBy("observed_entity_type").agg(F.count_distinct("entity_id").alias("entities"), F.count("*").alias("observations"), F.count_distinct("source_id").alias("sources"))


def multi_typed(evidence: DataFrame) -> DataFrame:
    many = typed_support(evidence).groupBy("entity_id").agg(F.count_distinct("observed_entity_type").alias("n")).where("n > 1")
    return many.agg(F.count("*").alias("multi_typed"))


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, [df.agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, df in tables.items()])


def count_by(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n"))


def degree(claims: DataFrame) -> DataFrame:
    """In and out edges of each entity; parallel edges count."""
    return claims.select(F.explode(F.array("subject_id", "object_id")).alias("entity_id")).groupBy("entity_id").agg(F.count("*").alias("degree"))


def isolated_leaf(entities: DataFrame, claims: DataFrame) -> DataFrame:
    d = entities.select(F.col("id").alias("entity_id")).join(degree(claims), "entity_id", "left")
    return d.agg(F.count_if(F.coalesce("degree", F.lit(0)) == 0).alias("isolated"), F.count_if(F.col("degree") == 1).alias("leaf"))


def latest_judgment(judgments: DataFrame) -> DataFrame:
    return last_by_key(judgments, ["observation_id"], "id")


def latest_progress(progress: DataFrame) -> DataFrame:
    return last_by_key(progress, ["source_id", "chunk_index"], "updated_at", "seq")


def expected_verdict() -> Column:
    return F.when(F.col("polarity") == "support", "supports").otherwise("contradicts")


def judged(observations: DataFrame, judgments: DataFrame, validator: tuple[str, str] | None = None) -> DataFrame:
    """observations with the verdict of the judgment that decides, null if there is none."""
    return observations.join(deciding(judgments, validator).select(F.col("observation_id").alias("id"), "verdict"), "id", "left")


def deciding(judgments: DataFrame, validator: tuple[str, str] | None = None) -> DataFrame:
    """The latest judgment of each observation; that of validator (model, prompt version) counts before later ones of others."""
    if validator:
        own = judgments.where((F.col("validator_model") == validator[0]) & (F.col("validator_prompt_version") == validator[1]))
        other = judgments.join(own.select("observation_id").distinct(), "observation_id", "left_anti").select(*judgments.columns)
        judgments = own.unionByName(other)
    return latest_judgment(judgments)


def observation_report(observations: DataFrame, judgments: DataFrame) -> DataFrame:
    rows = judged(observations, judgments)
    open_end = F.col("subject_entity_id").isNull() | F.col("object_entity_id").isNull()
    free = F.col("claim_id").isNull()
    c = F.count_if
    return rows.agg(
        F.count("*").alias("total"),
        c(open_end).alias("pending_endpoint"),
        c(~free).alias("materialized"),
        c(F.col("materialization_error") != "").alias("blocked"),
        c(free & F.col("verdict").isNull()).alias("pending_judgment"),
        c(F.col("verdict") == "supports").alias("supports"),
        c(F.col("verdict") == "insufficient").alias("insufficient"),
        c(F.col("verdict") == "contradicts").alias("contradicts"),
        c(free & (F.col("verdict") == "supports")).alias("supported_unmaterialized"),
    )


def entity_observation_report(observations: DataFrame) -> DataFrame:
    r = F.col("resolution_outcome")
    return observations.agg(F.count("*").alias("total"), F.count_if(F.col("entity_id").isNull()).alias("pending"), *[F.count_if(r == x).alias(f"n_{x}") for x in ("same", "new", "uncertain")])


def audit_status() -> Column:
    """What is open on a judged observation, most pressing first."""
    free = F.col("claim_id").isNull()
    return F.array_compact(
        F.array(
            F.when(F.col("materialization_error") != "", "blocked"),
            F.when(F.col("verdict").isNull(), "pending_judgment").when(F.col("verdict") != expected_verdict(), F.col("verdict")),
            F.when(F.col("subject_entity_id").isNull() | F.col("object_entity_id").isNull(), "pending_endpoint"),
            F.when(free & (F.col("verdict") == expected_verdict()), "supported_unmaterialized"),
        )
    )


def audit(observations: DataFrame, judgments: DataFrame, entities: DataFrame, limit: int = 500) -> DataFrame:
    """The most pressing observations with their names and states; the order is total, by priority and id."""
    rows = judged(observations, judgments).withColumn("statuses", audit_status())
    first = F.when(F.col("materialization_error") != "", 0).when(F.col("verdict").isNull(), 1).when(F.col("subject_entity_id").isNull() | F.col("object_entity_id").isNull(), 2).otherwise(3)
    top = rows.withColumn("priority", first).orderBy("priority", "id").limit(max(0, limit))
    name = lambda side: entities.select(F.col("id").alias(f"{side}_entity_id"), F.col("canonical_name").alias(f"{side}_canonical"))
    return top.join(name("subject"), "subject_entity_id", "left").join(name("object"), "object_entity_id", "left")


def rejections(rejected: DataFrame) -> DataFrame:
    kind = rejection_category(F.col("message"))
    group = F.when(kind.isin("unresolved_endpoint", "invalid_passage", "limit", "invalid_extraction"), "algorithmic").when(kind.isin("insufficient", "contradicted"), "semantic").otherwise("unclassified")
    return rejected.withColumn("category", kind).withColumn("kind", group)


def rejection_report(rejected: DataFrame) -> DataFrame:
    return rejections(rejected).groupBy("kind", "category").agg(F.count("*").alias("n"))


def rejection_samples(rejected: DataFrame, per_category: int = 20) -> DataFrame:
    order = W.partitionBy("category").orderBy("id")
    return rejections(rejected).withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= per_category)


def unresolved_sides(observations: DataFrame) -> DataFrame:
    """A row for each unresolved end of an observation: key, name, side, and what the observation cites."""
    side = lambda s, n: F.when(F.col(f"{s}_entity_id").isNull(), F.struct(F.lit(n).alias("side"), F.col(f"{s}_reference_key").alias("key"), F.col(f"{s}_name").alias("name")))
    both = F.array_compact(F.array(side("subject", 0), side("object", 1)))
    return observations.select("id", "source_id", "passage_ids", "source_text", F.explode(both).alias("x")).select("id", "source_id", "passage_ids", "source_text", "x.*")


def pending_groups(observations: DataFrame) -> DataFrame:
    return unresolved_sides(observations).groupBy("key").agg(F.count_distinct("id").alias("observations"), F.min_by("name", F.struct("id", "side")).alias("name"), F.count_distinct("name").alias("names"))


def promotion_candidates(observations: DataFrame, threshold: int = 3) -> DataFrame:
    """Unresolved references with evidence in threshold passages, and named literally in some text that cites them.

    Passages count once for each source, whatever the number of rows. passage_ids is a JSON array.
    """
    rows = unresolved_sides(observations).withColumn("ids", F.from_json("passage_ids", "array<string>"))
    literal = F.contains(F.regexp_replace(F.lower("source_text"), r"\s+", ""), F.col("key"))
    named = rows.groupBy("key").agg(F.bool_or(literal).alias("literal"), F.count_distinct("source_id").alias("source_count"), F.min_by("name", F.struct("id", "side")).alias("name"))
    units = rows.select("key", "source_id", F.explode("ids").alias("p")).distinct().groupBy("key").agg(F.count("*").alias("passage_count"))
    return named.where("literal").join(units.where(F.col("passage_count") >= threshold), "key").select("key", "name", "passage_count", "source_count")

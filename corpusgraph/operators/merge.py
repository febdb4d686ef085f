"""Entities found to be the same become one in all tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.functions.model import JsonModel
from corpusgraph.functions.names import normalize_name
from corpusgraph.operators import graph, replay, resolve, review, write
from corpusgraph.operators.keyed import cut, first_by_key

_ENDS = ["subject_id", "relation", "object_id"]


def _moved(df: DataFrame, mapping: DataFrame, *columns: str) -> DataFrame:
    """df with columns renamed by mapping(old, new); others of its values stay."""
    out = df
    for c in columns:
        m = mapping.select(F.col("old").alias(c), F.col("new").alias("cg_new"))
        out = out.join(m, c, "left").withColumn(c, F.coalesce("cg_new", c)).drop("cg_new")
    return out.select(*df.columns)


def _claims(claims: DataFrame, mapping: DataFrame, acyclic: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """The claims that stay, and (claim_id, to) of those that don't as they were; to is null where nothing takes their place.

    A claim without a moved end stays. Of moved ones that say the same the lowest id speaks, unless a claim that stays does;
    loops go, and so do edges that, in id order, close a cycle of an acyclic relation.
    """
    moved = _moved(claims, mapping, "subject_id", "object_id")
    was = claims.select("id", F.struct(*_ENDS).alias("was"))
    both = cut(moved.join(was, "id").withColumn("same", F.col("was") == F.struct(*_ENDS)))
    stay, go = both.where("same").select(*claims.columns), both.where("not same").select(*claims.columns)
    fresh = first_by_key(go.where("subject_id <> object_id"), _ENDS).join(stay.select(*_ENDS), _ENDS, "left_anti")
    for r in acyclic:
        edges = lambda df: df.where(F.col("relation") == r).select("id", F.col("subject_id").alias("s"), F.col("object_id").alias("o"))  # noqa: B023, E731
        refused = graph.admitted(edges(stay).drop("id"), edges(fresh)).where("not admitted").select("id")
        fresh = fresh.join(refused, "id", "left_anti")
    kept = cut(stay.unionByName(fresh.select(*claims.columns)))
    return kept, go.select(F.col("id").alias("claim_id"), *_ENDS).join(kept.select(F.col("id").alias("to"), *_ENDS), _ENDS, "left").select("claim_id", "to")


def merged(t: dict[str, DataFrame], mapping: DataFrame, acyclic: tuple[str, ...] = ("is_a", "prerequisite_of")) -> dict[str, DataFrame]:
    """The tables that change when mapping(old, new) merges entities; no new may be an old, see review.merges.

    Observations, names, evidence and claims of the old go to the new; its name becomes an alias. Evidence that says the same
    comes once, the row that was there first of all. Evidence of a claim that goes goes with it, and observations of such a
    claim name it no more. The old entity and its definitions are gone.
    """
    mapping = cut(mapping)
    old = mapping.select("old")
    out = {
        "entities": t["entities"].join(old, t["entities"]["id"] == old["old"], "left_anti"),
        "entity_definition_syntheses": t["entity_definition_syntheses"].join(old.withColumnRenamed("old", "entity_id"), "entity_id", "left_anti").select(*t["entity_definition_syntheses"].columns),
        "entity_observations": _moved(t["entity_observations"], mapping, "entity_id"),
    }

    names = t["entities"].join(mapping, F.col("id") == F.col("old")).select(F.col("new").alias("entity_id"), F.col("canonical_name").alias("name"), "normalized_name")
    theirs = t["entity_aliases"].join(mapping, F.col("entity_id") == F.col("old")).select(F.col("new").alias("entity_id"), "name", "normalized_name")
    own = t["entity_aliases"].join(old.withColumnRenamed("old", "entity_id"), "entity_id", "left_anti").select(*t["entity_aliases"].columns)
    out["entity_aliases"] = write.aliases(own, names.unionByName(theirs))

    out["claims"], gone = _claims(t["claims"], mapping, acyclic)
    gone = cut(gone)
    linked = lambda df: df.join(gone.withColumn("cg_gone", F.lit(True)), "claim_id", "left")
    seen = linked(_moved(t["claim_observations"], mapping, "subject_entity_id", "object_entity_id"))
    out["claim_observations"] = seen.withColumn("claim_id", F.when(F.col("cg_gone"), F.col("to")).otherwise(F.col("claim_id"))).select(*t["claim_observations"].columns)

    rows = linked(t["evidence"]).where("cg_gone is null or to is not null").withColumn("claim_id", F.coalesce("to", "claim_id")).select(*t["evidence"].columns)
    rows = _moved(rows, mapping, "entity_id").withColumn("cg_was", F.col("target_key"))
    key = F.coalesce(F.concat(F.lit("entity:"), F.col("entity_id").cast("string")), F.concat(F.lit("claim:"), F.col("claim_id").cast("string")))
    rows = rows.withColumn("target_key", key).withColumn("cg_order", F.struct((F.col("cg_was") != key).alias("late"), "id"))
    out["evidence"] = first_by_key(rows, write.EVIDENCE_KEY, "cg_order").select(*t["evidence"].columns)
    return out


def renamed(entities: DataFrame, aliases: DataFrame, wanted: DataFrame) -> dict[str, DataFrame]:
    """Entities with the canonical names of wanted(id, name), one an id; the old name becomes an alias.

    A name that is empty, that another entity has, or that a lower id also wants, changes nothing.
    """
    asked = wanted.select("id", F.trim("name").alias("told")).where("told <> ''").withColumn("key", normalize_name(F.col("told")))
    held = entities.select(F.col("normalized_name").alias("key"), F.col("id").alias("holder"))
    taken = asked.join(held, "key").where("holder <> id").select("id")
    first = first_by_key(asked.join(taken, "id", "left_anti").select("id", "told", "key"), ["key"])
    rows = cut(entities.join(first, "id", "left"))
    change = F.col("told").isNotNull() & (F.col("told") != F.col("canonical_name"))
    was = rows.where(change).select(F.col("id").alias("entity_id"), F.col("canonical_name").alias("name"), "normalized_name")
    now = rows.withColumns({"canonical_name": F.when(change, F.col("told")).otherwise(F.col("canonical_name")), "normalized_name": F.when(change, F.col("key")).otherwise(F.col("normalized_name"))})
    return {"entities": now.select(*entities.columns), "entity_aliases": write.aliases(aliases, was)}


def reconcile(t: dict[str, DataFrame], build: Callable[[], JsonModel], workers: int = 1, limit: int = 20) -> tuple[dict[str, DataFrame], dict]:
    """The limit most similar pairs of entities are judged, the same ones merged and named, and what waits is replayed.

    Pairs that share an entity are judged from the tables as they are, and all that are the same become the lowest id.
    """
    e = t["entities"]
    own = e.select(F.col("id").alias("entity_id"), F.col("normalized_name").alias("name"))
    names = own.union(t["entity_aliases"].select("entity_id", F.col("normalized_name").alias("name")))
    pairs = cut(resolve.reconcile_pairs(own, names, limit=max(0, limit)))
    reviews = cut(review.review(review.pairs_asked(pairs, e), "pair", build, workers))
    mapping = cut(review.merges(reviews))
    changed = merged(t, mapping)

    ends = F.split("key", ":").cast("array<long>")
    told = reviews.where("result is not null").select(ends[0].alias("left_id"), ends[1].alias("right_id"), F.get_json_object("result", "$.decision").alias("decision"), F.get_json_object("result", "$.canonical_name").alias("name"))
    best = told.where("decision = 'same' and name <> ''").join(pairs, ["left_id", "right_id"]).join(mapping, F.col("right_id") == F.col("old"))
    wanted = best.groupBy(F.col("new").alias("id")).agg(F.min_by("name", F.struct((-F.col("score")).alias("s"), "left_id", "right_id")).alias("name"))
    changed |= renamed(cut(changed["entities"]), cut(changed["entity_aliases"]), wanted)
    changed = {k: cut(v) for k, v in changed.items()}
    again, counts = replay.replay(t | changed)
    n = {r["decision"]: r["n"] for r in told.groupBy("decision").agg(F.count("*").alias("n")).collect()}
    failed = reviews.where("error is not null").count()
    report = {"examined": pairs.count(), "merged": mapping.count(), "uncertain": n.get("uncertain", 0), "distinct": n.get("distinct", 0), "failed": failed, "replayed": counts}
    return changed | again, report

"""The whole graph as five tables of nested rows, as JSON lines, as one JSON document, and as a page to read it."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgraph.operators.keyed import last_by_key
from corpusgraph.operators.report import type_profile

SECTIONS = ("sources", "entities", "claims", "evidence", "entity_observations")


def _listed(column: str) -> Column:
    """A list kept as a JSON text; null or broken ones are empty."""
    return F.coalesce(F.from_json(column, "array<string>"), F.array().cast("array<string>")).alias(column)


def _entities(t: dict[str, DataFrame]) -> DataFrame:
    names = t["entity_aliases"].groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("id", "name")))["name"].alias("aliases"))
    rank = F.struct((-F.col("sources")).alias("s"), (-F.col("observations")).alias("o"), F.col("observed_entity_type").alias("entity_type"), "observations", "sources")
    types = type_profile(t["evidence"]).groupBy("entity_id").agg(F.array_sort(F.collect_list(rank)).alias("types"))
    shown = F.transform("types", lambda x: F.struct(x["entity_type"].alias("entity_type"), x["observations"].alias("observations"), x["sources"].alias("sources")))
    latest = last_by_key(t["entity_definition_syntheses"], ["entity_id"], "id")
    told = F.struct(F.col("synthesizer_model").alias("model"), "prompt_version", "observation_fingerprint", "supporting_observations", "rejected_candidates", "limitation")
    latest = latest.select("entity_id", told.alias("definition_synthesis"))
    rows = t["entities"].withColumnRenamed("id", "entity_id")
    for more in (names, types, latest):
        rows = rows.join(more, "entity_id", "left")
    none = F.array().cast("array<struct<entity_type:string,observations:bigint,sources:bigint>>")
    return rows.select(F.col("entity_id").alias("id"), "canonical_name", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), "definition", F.coalesce(shown, none).alias("type_profile"), "definition_synthesis")


def _claims(t: dict[str, DataFrame]) -> DataFrame:
    side = lambda k: t["entities"].select(F.col("id").alias(f"{k}_id"), F.col("canonical_name").alias(k))
    return t["claims"].join(side("subject"), "subject_id").join(side("object"), "object_id").select("id", "subject_id", "subject", "relation", "object_id", "object")


def _evidence(t: dict[str, DataFrame]) -> DataFrame:
    source = F.struct("name", "uri", "version", "content_hash").alias("source")
    rows = t["evidence"].join(t["sources"].select(F.col("id").alias("source_id"), source), "source_id")
    extraction = F.struct(F.col("extraction_model").alias("model"), F.col("extraction_prompt_version").alias("prompt_version"))
    validation = F.struct(*[F.col(f"validator_{c}").alias(c) for c in ("model", "prompt_version", "verdict", "reason")])
    return rows.select("id", F.col("target_key").alias("target"), "source_id", "source", _listed("passage_ids"), "passage_version", F.col("excerpt").alias("source_text"), "model_quote", "location", "polarity", extraction.alias("extraction"), validation.alias("validation"))


def _observations(t: dict[str, DataFrame]) -> DataFrame:
    rows = t["entity_observations"].join(t["sources"].select(F.col("id").alias("source_id"), F.col("name").alias("source_name")), "source_id")
    ids = F.coalesce(F.from_json("candidate_entity_ids", "array<bigint>"), F.array().cast("array<bigint>")).alias("candidate_entity_ids")
    resolution = F.struct(F.col("resolution_outcome").alias("outcome"), F.col("resolution_reason").alias("reason"), ids, F.col("resolver_model").alias("model"), F.col("resolver_prompt_version").alias("prompt_version"))
    return rows.select("id", "entity_id", "name", "definition", "observed_entity_type", _listed("aliases"), "source_id", "source_name", "chunk_index", _listed("passage_ids"), "location", "source_text", "model_quote", resolution.alias("resolution"))


def sections(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The document's parts from the graph's tables; sources come without their content."""
    sources = tables["sources"].select("id", F.col("source_key").alias("key"), "name", F.col("source_type").alias("type"), "uri", "version", "content_hash", "language")
    return dict(zip(SECTIONS, (sources, _entities(tables), _claims(tables), _evidence(tables), _observations(tables)), strict=True))


def write_lines(tables: dict[str, DataFrame], path: str) -> None:
    """One folder of JSON lines a section, written by all executors: the form for large graphs."""
    for name, rows in sections(tables).items():
        rows.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path.rstrip('/')}/{name}")


def _rendered(tables: dict[str, DataFrame], optional: str = "definition_synthesis") -> Iterator[str]:
    """Pieces of the document, each section by id, one partition on the driver at a time."""
    for i, (name, rows) in enumerate(sections(tables).items()):
        yield f'{"{" if i == 0 else ","}\n  "{name}": ['
        whole = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
        if optional in rows.columns:
            bare = F.to_json(F.struct(*[c for c in rows.columns if c != optional]), {"ignoreNullFields": "false"})
            whole = F.when(F.col(optional).isNull(), bare).otherwise(whole)
        some = False
        for r in rows.orderBy("id").select(whole.alias("line")).toLocalIterator():
            yield f'{"," if some else ""}\n    {r["line"]}'
            some = True
        yield "\n  ]" if some else "]"
    yield "\n}\n"


def write_json(tables: dict[str, DataFrame], path: str) -> None:
    """One UTF-8 JSON document with the five sections, on the driver's own disk."""
    with open(path, "w", encoding="utf-8") as out:
        out.writelines(_rendered(tables))


PAGE = """<!doctype html><meta charset="utf-8"><title>Graph</title>
<style>body{font:15px sans-serif;max-width:60em;margin:2em auto}li{margin:.3em 0}small{color:#666}</style>
<h1>Graph</h1><input id="q" placeholder="Find an entity"><ul id="list"></ul><script type="application/json" id="graph">"""
PAGE_END = """</script><script>
const graph = JSON.parse(document.getElementById("graph").textContent), list = document.getElementById("list");
function show(words) {
  list.replaceChildren(...graph.entities.filter(e => [e.canonical_name, ...e.aliases].join(" ").toLowerCase().includes(words)).map(e => {
    const item = document.createElement("li"), more = document.createElement("small");
    const edges = graph.claims.filter(c => c.subject_id === e.id || c.object_id === e.id);
    more.textContent = " " + edges.map(c => `${c.subject} ${c.relation} ${c.object}`).join("; ");
    item.append(e.canonical_name, more);
    return item;
  }));
}
document.getElementById("q").oninput = e => show(e.target.value.toLowerCase());
show("");
</script>
"""


def write_html(tables: dict[str, DataFrame], path: str) -> None:
    """A page that needs no other file; no text of the graph can end its script element."""
    with open(path, "w", encoding="utf-8") as out:
        out.write(PAGE)
        out.writelines(piece.replace("</", "<\\/") for piece in _rendered(tables))
        out.write(PAGE_END)

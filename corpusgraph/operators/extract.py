"""Extraction of chunks by a model, as one distributed stage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.functions.extraction import PROMPT_VERSION, SYSTEM, Extraction, parse, prompt
from corpusgraph.functions.model import JsonModel

_CITED = "model_quote: string, source_text: string, passage_ids: array<string>, location: string"
OUT = f"""source_id long, chunk_index int, model string, prompt_version string,
entities array<struct<name: string, definition: string, entity_type: string, aliases: array<string>, {_CITED}>>,
claims array<struct<subject: string, relation: string, object: string, polarity: string, {_CITED}>>,
rejected array<string>, error string"""


def with_passages(chunks: DataFrame, passages: DataFrame, key: str = "source_id") -> DataFrame:
    """chunks of segment.chunk with a column passages, those that each one names; a chunk's length bounds the list."""
    place = F.concat_ws(" ", F.concat(F.lit("p"), F.col("page")), F.array_join("section_path", " / "))
    p = passages.select(key, "passage_id", F.struct("passage_id", "text", "start", place.alias("location")).alias("p"))
    named = chunks.select(key, "chunk_index", F.explode("passage_ids").alias("passage_id")).join(p, [key, "passage_id"])
    return chunks.join(named.groupBy(key, "chunk_index").agg(F.collect_list("p").alias("passages")), [key, "chunk_index"], "left")


def pending(chunks: DataFrame, progress: DataFrame, key: str = "source_id") -> DataFrame:
    """Chunks that no latest progress row (report.latest_progress) marks as done with their present hash."""
    done = progress.where("status = 'done'").select(key, "chunk_index", "chunk_hash").distinct()
    return chunks.join(done, [key, "chunk_index", "chunk_hash"], "left_anti")


def extract_chunks(chunks: DataFrame, build: Callable[[], JsonModel], workers: int = 1, entities: int = 50, claims: int = 30) -> DataFrame:
    """chunks (source_id, chunk_index, content, section_path, passages) -> one row a chunk, in no order.

    A call that fails gives a row with its error and empty lists, and stops no other chunk. A null content is an empty
    one. Lost executors' calls are made again, so write the result once before using it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = build()
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                held = [dict(p) for p in r.passages] if r.passages is not None else []
                place = " / ".join(r.section_path) if r.section_path is not None else ""
                got, error = Extraction(), None
                try:
                    got = parse(model.complete_json(SYSTEM, prompt(r.content or "", place, entities, claims)), held, entities, claims)
                except (RuntimeError, ValueError) as e:
                    error = str(e)
                rows.append((r.source_id, r.chunk_index, model.name, PROMPT_VERSION, got.entities, got.claims, got.rejected, error))
            yield pd.DataFrame(rows, columns=["source_id", "chunk_index", "model", "prompt_version", "entities", "claims", "rejected", "error"])

    asked = chunks.select("source_id", "chunk_index", "content", "section_path", "passages")
    return asked.repartition(workers, "source_id", "chunk_index").mapInPandas(run, OUT)


def observed(extracted: DataFrame, kind: str) -> DataFrame:
    """One row an accepted entity or claim (kind: entities or claims), with its place in the answer."""
    return extracted.select("source_id", "chunk_index", "model", "prompt_version", F.posexplode(kind).alias("ordinal", "x")).select("source_id", "chunk_index", "ordinal", "model", "prompt_version", "x.*")


def rejections(extracted: DataFrame) -> DataFrame:
    return extracted.select("source_id", "chunk_index", F.posexplode("rejected").alias("ordinal", "message"))


def progressed(extracted: DataFrame, chunks: DataFrame) -> DataFrame:
    """Progress rows: done with the counts, or failed with the error."""
    result = F.to_json(F.struct(F.size("entities").alias("entities"), F.size("claims").alias("claims"), F.size("rejected").alias("rejected")))
    rows = extracted.join(chunks.select("source_id", "chunk_index", "chunk_hash"), ["source_id", "chunk_index"])
    return rows.select("source_id", "chunk_index", "chunk_hash", F.when(F.col("error").isNull(), "done").otherwise("failed").alias("status"), result.alias("result"), "error")

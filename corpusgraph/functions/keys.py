"""Keys under which evidence, observations and processing results are written once: SHA-256 of canonical JSON."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusgraph.functions.names import reference_key


def _text(value: Column) -> Column:
    """A string as JSON."""
    return F.regexp_replace(F.to_json(F.array(F.coalesce(value, F.lit("")))), r"^\[|\]$", "")


def _texts(values: Column, between: str = ",") -> Column:
    """An array of strings as a JSON list."""
    return F.concat(F.lit("["), F.array_join(F.transform(F.coalesce(values, F.array().cast("array<string>")), _text), between), F.lit("]"))


def _list_hash(*parts: Column) -> Column:
    return F.sha2(F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]")), 256)


def excerpt_hash(source_text: Column, model_quote: Column, passage_ids: Column) -> Column:
    """Of an excerpt: its text, the model's quote and the list of its passages, with a zero character between them."""
    parts = (F.coalesce(source_text, F.lit("")), F.coalesce(model_quote, F.lit("")), _texts(passage_ids, ", "))
    return F.sha2(F.concat_ws("\0", *parts), 256)


def target_key(entity_id: Column, claim_id: Column) -> Column:
    """entity:<id> or claim:<id>; an error unless exactly one is given."""
    fine = entity_id.isNull() != claim_id.isNull()
    told = F.coalesce(F.concat(F.lit("entity:"), entity_id.cast("string")), F.concat(F.lit("claim:"), claim_id.cast("string")))
    return F.when(fine, told).otherwise(F.raise_error(F.lit("evidence needs either an entity or a claim")).cast("string"))


def entity_observation_key(source_id: Column, chunk_index: Column, name: Column, definition: Column, entity_type: Column, aliases: Column, source_text: Column, model_quote: Column, passage_ids: Column, model: str, version: str) -> Column:
    texts = [_text(c) for c in (reference_key(name), definition, entity_type)]
    return _list_hash(source_id.cast("string"), chunk_index.cast("string"), *texts, _texts(aliases), _text(source_text), _text(model_quote), _texts(passage_ids), _text(F.lit(model)), _text(F.lit(version)))


def claim_observation_key(source_id: Column, chunk_index: Column, subject: Column, relation: Column, object_: Column, polarity: Column, source_text: Column, model_quote: Column, passage_ids: Column, model: str, version: str) -> Column:
    texts = [_text(c) for c in (reference_key(subject), relation, reference_key(object_), polarity, source_text, model_quote)]
    return _list_hash(source_id.cast("string"), chunk_index.cast("string"), *texts, _texts(passage_ids), _text(F.lit(model)), _text(F.lit(version)))


def processing_hash(chunk_hash: str, **settings) -> str:
    """Of a chunk and all settings that its result depends on: a chunk is done when it was done with this hash."""
    return hashlib.sha256(json.dumps({"chunk_hash": chunk_hash, **settings}, sort_keys=True).encode()).hexdigest()

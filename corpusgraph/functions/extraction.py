"""Prompt of the extraction call, and what of its answer is taken."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from corpusgraph.functions.vocabulary import ENTITY_TYPES, POLARITIES, RELATIONS, listed

PROMPT_VERSION = "chunk-extract-1"
SYSTEM = "You extract what a text defines and claims. The text alone counts; take nothing from memory. Answer with one JSON object."


def prompt(text: str, location: str, entities: int, claims: int) -> str:
    return f"""Entity types:
{listed(ENTITY_TYPES)}
Relations:
{listed(RELATIONS)}
At most {entities} entities and {claims} claims. stance is support, or oppose where the text denies the claim.
evidence names 1 to 3 passages by the ids that stand before them, and quotes their words.
Answer {{"entities": [{{"name": "", "definition": "", "entity_type": "", "aliases": [], "evidence": {{"passage_ids": [], "quote": ""}}}}],
"claims": [{{"subject": "", "relation": "", "object": "", "stance": "", "evidence": {{"passage_ids": [], "quote": ""}}}}]}}
Place: {location}
Text:
{text}"""


@dataclass
class Extraction:
    """Accepted rows as dicts of their columns, and a message for each refused one."""

    entities: list[dict] = field(default_factory=list)
    claims: list[dict] = field(default_factory=list)
    rejected: list[str] = field(default_factory=list)


def _said(raw: dict, key: str) -> str:
    value = raw.get(key)
    return value.strip() if isinstance(value, str) else ""


def _same(name: str) -> str:
    return re.sub(r"\s+", "", name).casefold()


def _cited(raw: object, passages: dict[str, dict]) -> dict:
    """Columns of the evidence, passages in the order of the text; ValueError says what is wrong."""
    if not isinstance(raw, dict):
        raise ValueError("evidence lacks passage_ids and quote")
    quote, ids = _said(raw, "quote"), raw.get("passage_ids")
    if not quote:
        raise ValueError("evidence.quote is empty")
    if not isinstance(ids, list):
        raise ValueError("evidence.passage_ids is no list")
    ids = [i for i in (str(x).strip() for x in ids) if i]
    if len(set(ids)) < len(ids):
        raise ValueError("evidence.passage_ids repeats one")
    if not 1 <= len(ids) <= 3:
        raise ValueError("evidence.passage_ids must name 1 to 3 passages")
    if unknown := [i for i in ids if i not in passages]:
        raise ValueError(f"evidence.passage_ids names passages that the chunk lacks: {unknown}")
    held = sorted((passages[i] for i in ids), key=lambda p: p["start"])
    return {
        "model_quote": quote,
        "source_text": "\n\n".join(p["text"] for p in held),
        "passage_ids": [p["passage_id"] for p in held],
        "location": "; ".join(f"{p['passage_id']} {p['location']}" for p in held),
    }


def _entity(raw: dict, passages: dict[str, dict], seen: set[str]) -> dict:
    name, told, kind = _said(raw, "name"), _said(raw, "definition"), _said(raw, "entity_type")
    if not name or len(told) < 4:
        raise ValueError("no name or definition")
    if kind not in ENTITY_TYPES:
        raise ValueError(f"unknown entity_type {kind!r}")
    cited = _cited(raw.get("evidence"), passages)
    if _same(name) in seen:
        raise ValueError(f"repeats {name!r}")
    seen.add(_same(name))
    others = raw.get("aliases") if isinstance(raw.get("aliases"), list) else []
    aliases = list(dict.fromkeys(a.strip() for a in others if isinstance(a, str) and a.strip()))
    return {"name": name, "definition": told, "entity_type": kind, "aliases": aliases, **cited}


def _claim(raw: dict, passages: dict[str, dict]) -> dict:
    subject, relation, object = (_said(raw, k) for k in ("subject", "relation", "object"))
    stance = _said(raw, "stance") or "support"
    if relation not in RELATIONS:
        raise ValueError(f"unknown relation {relation!r}")
    if stance not in POLARITIES:
        raise ValueError(f"unknown stance {stance!r}")
    if not subject or not object or _same(subject) == _same(object):
        raise ValueError("an end is empty, or both are the same")
    return {"subject": subject, "relation": relation, "object": object, "polarity": stance, **_cited(raw.get("evidence"), passages)}


def parse(answer: dict, passages: list[dict], entities: int = 50, claims: int = 30) -> Extraction:
    """What of answer holds, given passages (passage_id, text, start, location) of the chunk.

    One bad item refuses itself only. Of names that are equal but for case and white space the first valid one stays.
    """
    out, seen = Extraction(), set()
    known = {p["passage_id"]: p for p in passages}
    over = []
    for kind, key, most, kept, check in (
        ("entity", "entities", entities, out.entities, lambda raw: _entity(raw, known, seen)),
        ("claim", "claims", claims, out.claims, lambda raw: _claim(raw, known)),
    ):
        items = answer.get(key, [])
        if not isinstance(items, list):
            out.rejected.append(f"{key} is no list")
            continue
        for i, raw in enumerate(items[:most]):
            try:
                if not isinstance(raw, dict):
                    raise ValueError("no object")
                kept.append(check(raw))
            except ValueError as e:
                out.rejected.append(f"{kind}[{i}] {e}")
        if len(items) > most:
            over.append(f"{key} over limit {most}")
    out.rejected += over
    return out

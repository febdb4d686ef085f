"""KG-shaped views over the driver's tables: one SQL text that Spark and DuckDB both read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from corpusgraph.operators.keyed import with_ids

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
_LINE_ORDER = "l_orderkey,l_linenumber,l_partkey,l_suppkey,l_quantity,l_extendedprice,l_discount,l_tax,l_returnflag,l_linestatus,l_shipdate"
_FULL = "concat(p_name,' #',CAST(p_partkey AS STRING))"

VIEWS: dict[str, str] = {
    "kg_source": "SELECT MIN(doc_id) AS id, source AS source_key, {SHA:text} AS content_hash, MIN(lang) AS language, MIN(n_chars) AS n_chars FROM documents GROUP BY source, {SHA:text}",
    "kg_entity": f"SELECT p_partkey AS id, {_FULL} AS canonical_name, lower({_FULL}) AS normalized_name, concat(p_brand,' ',p_type) AS definition FROM part",
    "kg_alias": "SELECT p_partkey*2 AS id, p_partkey AS entity_id, p_name AS name, lower(p_name) AS normalized_name FROM part UNION ALL SELECT p_partkey*2+1, p_partkey, concat(p_brand,' ',p_type,' ',CAST(p_size AS STRING)), lower(concat(p_brand,' ',p_type,' ',CAST(p_size AS STRING))) FROM part",
    "kg_claim": "SELECT p_partkey*4 AS id, p_partkey AS subject_id, 'is_a' AS relation, CAST(floor(p_partkey/2.0) AS BIGINT) AS object_id FROM part WHERE p_partkey > 0 UNION ALL SELECT p_partkey*4+1, p_partkey, 'part_of', (p_partkey*7+3) % (SELECT COUNT(*) FROM part) FROM part WHERE (p_partkey*7+3) % (SELECT COUNT(*) FROM part) <> p_partkey UNION ALL SELECT p_partkey*4+2, p_partkey, 'prerequisite_of', p_partkey+1 FROM part WHERE p_partkey % 50 < 49 AND p_partkey+1 < (SELECT COUNT(*) FROM part) UNION ALL SELECT p_partkey*4+3, p_partkey, 'prerequisite_of', p_partkey-9 FROM part WHERE p_partkey % 500 = 499",
    "kg_evidence_raw": f"SELECT id, CASE WHEN is_claim THEN concat('claim:',CAST(part_id*4+1 AS STRING)) ELSE concat('entity:',CAST(part_id AS STRING)) END AS target_key, CASE WHEN is_claim THEN NULL ELSE part_id END AS entity_id, CASE WHEN is_claim THEN part_id*4+1 ELSE NULL END AS claim_id, source_id, {{SHA:excerpt}} AS excerpt_hash, polarity, CASE WHEN is_claim THEN '' ELSE t END AS observed_entity_type FROM (SELECT ROW_NUMBER() OVER (ORDER BY {_LINE_ORDER}) AS id, l_partkey AS part_id, l_suppkey AS source_id, concat(CAST(l_partkey AS STRING),'-',CAST(l_linenumber AS STRING)) AS excerpt, CASE WHEN l_returnflag='R' THEN 'oppose' ELSE 'support' END AS polarity, l_linestatus='O' AND l_returnflag='N' AS is_claim, CASE CAST(l_quantity AS INT) % 7 WHEN 0 THEN '' WHEN 1 THEN 'resource' WHEN 2 THEN 'criterion' WHEN 3 THEN 'data' WHEN 4 THEN 'task' WHEN 5 THEN 'solution' ELSE 'concept' END AS t FROM lineitem WHERE l_partkey % 97 <> 5) x",
    "kg_evidence": "SELECT id, target_key, entity_id, claim_id, source_id, excerpt_hash, polarity, observed_entity_type FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY target_key, source_id, excerpt_hash, polarity ORDER BY id) AS rn FROM kg_evidence_raw) x WHERE rn = 1",
    "kg_entity_observation": f"SELECT id, CASE WHEN id % 1009 = 0 THEN -id WHEN f='A' AND s='F' THEN NULL ELSE part_id END AS entity_id, source_id, chunk_index, CASE WHEN f='A' AND s='F' THEN '' WHEN f='R' THEN 'same' WHEN f='N' THEN 'uncertain' ELSE 'new' END AS resolution_outcome FROM (SELECT ROW_NUMBER() OVER (ORDER BY {_LINE_ORDER}) AS id, l_partkey AS part_id, l_suppkey AS source_id, l_linenumber AS chunk_index, l_returnflag AS f, l_linestatus AS s FROM lineitem) x",
    "kg_claim_observation": "SELECT o_orderkey AS id, o_custkey % 20 AS source_id, o_orderkey % 11 AS chunk_index, concat('ref ',CAST(o_custkey % 40 AS STRING)) AS subject_name, concat('ref',CAST(o_custkey % 40 AS STRING)) AS subject_reference_key, CASE WHEN o_orderstatus='P' THEN NULL ELSE o_custkey % n END AS subject_entity_id, 'part_of' AS relation, concat('obj ',CAST(o_custkey % 60 AS STRING)) AS object_name, concat('obj',CAST(o_custkey % 60 AS STRING)) AS object_reference_key, CASE WHEN o_orderpriority='5-LOW' THEN NULL ELSE (o_custkey*7+3) % n END AS object_entity_id, CASE WHEN o_orderpriority='1-URGENT' THEN 'oppose' ELSE 'support' END AS polarity, concat('[\"P',lpad(CAST(o_orderkey % 97 AS STRING),6,'0'),'\"]') AS passage_ids, concat('Ref ',CAST(o_custkey % 40 AS STRING),' is part of obj ',CAST(o_custkey % 50 AS STRING)) AS source_text, CASE WHEN o_orderstatus='F' AND o_orderpriority<>'5-LOW' THEN (o_custkey % n)*4+1+CASE WHEN o_orderkey % 101 = 0 THEN 1 ELSE 0 END ELSE NULL END AS claim_id, CASE WHEN o_orderstatus='O' AND o_orderpriority='3-MEDIUM' THEN 'cycle' ELSE '' END AS materialization_error FROM orders CROSS JOIN (SELECT COUNT(*) AS n FROM part) p",
    "kg_judgment": "SELECT event_id AS id, user_id*100 + event_id % 100 AS observation_id, concat('m',CAST(event_id % 2 AS STRING)) AS validator_model, CASE WHEN event_type IN ('purchase','click') THEN 'supports' WHEN event_type='error' THEN 'contradicts' ELSE 'insufficient' END AS verdict FROM events",
    "kg_progress": "SELECT event_id AS seq, user_id % 20 AS source_id, event_id % 13 AS chunk_index, event_type AS chunk_hash, CASE WHEN event_type='error' THEN 'failed' ELSE 'done' END AS status, props AS result, ts AS updated_at FROM events",
    "kg_rejection": "SELECT event_id AS id, user_id % 20 AS source_id, event_id % 13 AS chunk_index, CASE event_id % 7 WHEN 0 THEN 'endpoint unresolved: a' WHEN 1 THEN 'verdict insufficient: b' WHEN 2 THEN 'verdict contradicts: c' WHEN 3 THEN 'entity[3] bad passage_ids' WHEN 4 THEN 'entities over limit 50' WHEN 5 THEN 'claim[1] bad relation' ELSE 'something else' END AS message FROM events",
}
#: Numbers over all rows of a table, which a window would give in one task.
_NUMBERED = re.compile(r"ROW_NUMBER\(\) OVER \(ORDER BY ([\w,]+)\) AS id\b(.*?\bFROM) (\w+)(?: WHERE ([^()]+))?\)")
_NEEDS = {"kg_evidence": ["kg_evidence_raw"]}


def _text(name: str, sha: str) -> str:
    return re.sub(r"\{SHA:(\w+)\}", sha, VIEWS[name])


class Store:
    """The views as DataFrames over one folder of driver tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _numbered(self, found: re.Match) -> DataFrame:
        """The rows of a numbering subquery with their id, and the columns that it names besides."""
        rows = self.table(found[3])
        rows = rows.where(found[4]) if found[4] else rows
        return with_ids(rows, 0, *found[1].split(","), keep=[c for c in rows.columns if re.search(rf"\b{c}\b", found[2])])

    def view(self, name: str) -> DataFrame:
        sql = _text(name, r"sha2(\1, 256)")
        known = {}
        if found := _NUMBERED.search(sql):
            known["numbered"] = self._numbered(found)
            sql = sql.replace(found[0], f"id{found[2]} numbered)")
        known |= {t: self.table(t) for t in TABLES if re.search(rf"\b(FROM|JOIN) {t}\b", sql)}
        known |= {v: self.view(v) for v in VIEWS if re.search(rf"\bFROM {v}\b", sql)}
        for t, df in known.items():
            sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
        return self.spark.sql(sql, **known)

    __call__ = view


def duckdb_sql(query: str) -> str:
    """query with the views that it names put before it as common tables, in DuckDB's dialect."""
    wanted: list[str] = []

    def need(name: str) -> None:
        for other in _NEEDS.get(name, []):
            need(other)
        if name not in wanted:
            wanted.append(name)

    for name in VIEWS:
        if re.search(rf"\b{name}\b", query):
            need(name)
    heads = ", ".join(f"{n} AS ({_text(n, r'sha256(\1)')})" for n in wanted)
    query = query.strip()
    if not heads:
        return query
    if query.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {heads}, {query[14:]}"
    if query.upper().startswith("WITH "):
        return f"WITH {heads}, {query[5:]}"
    return f"WITH {heads} {query}"

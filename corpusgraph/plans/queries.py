"""One query an operator, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusgraph.fixtures import Store, duckdb_sql
from corpusgraph.functions import keys
from corpusgraph.functions.html import page_text
from corpusgraph.functions.names import ascii_normalize, ascii_reference
from corpusgraph.operators import graph, integrity, keyed, materialize, report, resolve, write
from corpusgraph.sources import ingest, segment

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Store(spark, sf_dir))
        if sql:
            _SQL[f.__name__] = sql
        return f

    return put


def oracles() -> dict[str, str]:
    return {name: duckdb_sql(sql) for name, sql in _SQL.items()}


@query("SELECT entity_id, observed_entity_type, count(*) AS observations, count(DISTINCT source_id) AS sources FROM kg_evidence WHERE polarity='support' AND observed_entity_type<>'' AND entity_id IS NOT NULL GROUP BY ALL")
def type_profile(s):
    return report.type_profile(s("kg_evidence"))


@query("SELECT observed_entity_type, count(DISTINCT entity_id) AS entities, count(*) AS observations, count(DISTINCT source_id) AS sources FROM kg_evidence WHERE polarity='support' AND observed_entity_type<>'' AND entity_id IS NOT NULL GROUP BY ALL")
def entity_type_stats(s):
    return report.entity_type_stats(s("kg_evidence"))


@query("SELECT count(*) AS multi_typed FROM (SELECT entity_id FROM kg_evidence WHERE polarity='support' AND observed_entity_type<>'' AND entity_id IS NOT NULL GROUP BY entity_id HAVING count(DISTINCT observed_entity_type) > 1)")
def multi_typed_entities(s):
    return report.multi_typed(s("kg_evidence"))


@query("SELECT source AS source_key, sha256(text) AS content_hash, min(doc_id) AS id, count(*) AS n_seen FROM documents GROUP BY ALL")
def source_versioning(s):
    return ingest.source_versions(s.table("documents"))


_TAGS = "p|div|section|article|header|footer|main|aside|nav|ul|ol|li|table|tr|td|th|br|hr|blockquote|pre|title|head|body"
_PAGE = "html"
for _t in ("script", "style", "noscript"):
    _PAGE = f"regexp_replace({_PAGE}, '(?is)<{_t}\\b[^>]*>.*?</{_t}\\s*>', '', 'g')"
for _n in range(1, 7):
    _PAGE = f"regexp_replace({_PAGE}, '(?is)<h{_n}\\b[^>]*>(.*?)</h{_n}\\s*>', chr(10) || '{'#' * _n} \\1' || chr(10), 'g')"
_PAGE = f"regexp_replace({_PAGE}, '(?i)</?(?:{_TAGS})[^>]*>', chr(10), 'g')"
_PAGE = f"regexp_replace({_PAGE}, '(?s)<[^>]+>', '', 'g')"
for _e, _c in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&#39;", "''"), ("&amp;", "&")):
    _PAGE = f"replace({_PAGE}, '{_e}', '{_c}')"
_PAGE = f"array_to_string(list_filter(list_transform(string_split({_PAGE}, chr(10)), lambda x: trim(regexp_replace(x, '[ \\t\\r\\f\\x0B ]+', ' ', 'g'))), lambda x: x <> ''), chr(10) || chr(10))"
_PAGE_SQL = f"SELECT page_id, {_PAGE} AS page_text FROM pages"


@query(_PAGE_SQL)
def page_texts(s):
    return s.table("pages").select("page_id", page_text(F.col("html")).alias("page_text"))


def _blank_line_passages(s) -> DataFrame:
    text = s.table("pages").select("page_id", page_text(F.col("html")).alias("t"))
    parts = text.select("page_id", F.posexplode(F.filter(F.split("t", "\n[ \t]*\n+|\f+"), lambda x: F.trim(x) != "")).alias("pos", "p"))
    return parts.select("page_id", F.format_string("P%06d", F.col("pos") + 1).alias("passage_id"), "pos", F.trim("p").alias("passage"))


_PASSAGES = f"SELECT page_id, printf('P%06d', pos + 1) AS passage_id, pos, passage FROM (SELECT page_id, unnest(ps) AS passage, unnest(range(len(ps))) AS pos FROM (SELECT page_id, list_transform(list_filter(string_split_regex(page_text, '\\n[ \\t]*\\n+|\\f+'), lambda x: trim(x) <> ''), lambda x: trim(x)) AS ps FROM ({_PAGE_SQL})))"


@query(f"SELECT page_id, passage_id, passage, sha256(passage) AS sha256 FROM ({_PASSAGES})")
def passages_blankline(s):
    return _blank_line_passages(s).select("page_id", "passage_id", "passage", F.sha2("passage", 256).alias("sha256"))


_LEVEL = "CASE WHEN passage LIKE '%' || chr(10) || '%' OR length(passage) > 160 THEN 0 WHEN regexp_matches(passage, '^\\s{0,3}(#{1,6})\\s+(.+?)\\s*#*\\s*$') THEN length(regexp_extract(passage, '^\\s{0,3}(#{1,6})\\s+', 1)) WHEN regexp_matches(passage, '(?i)^(chapter|part)\\s+\\d+\\b') THEN 1 WHEN regexp_matches(passage, '^(\\d+(?:\\.\\d+){0,5})[\\s、]+(.+)$') AND NOT regexp_matches(passage, '[。！？.]$') THEN least(6, 1 + len(string_split(regexp_extract(passage, '^(\\d+(?:\\.\\d+){0,5})', 1), '.')) - 1) ELSE 0 END"


@query(f"SELECT page_id, passage_id, CAST({_LEVEL} AS INT) AS heading_level FROM ({_PASSAGES})")
def headings(s):
    return _blank_line_passages(s).select("page_id", "passage_id", segment.heading_level(F.col("passage")).cast("int").alias("heading_level"))


@query(f"SELECT page_id, section, count(*) AS passages, min(pos) AS first_pos FROM (SELECT page_id, pos, CAST(sum(CASE WHEN {_LEVEL} > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos) AS BIGINT) AS section FROM ({_PASSAGES})) GROUP BY ALL")
def section_groups(s):
    rows = _blank_line_passages(s).withColumn("h", (segment.heading_level(F.col("passage")) > 0).cast("long"))
    rows = rows.withColumn("section", F.sum("h").over(W.partitionBy("page_id").orderBy("pos")))
    return rows.groupBy("page_id", "section").agg(F.count("*").alias("passages"), F.min(F.col("pos").cast("long")).alias("first_pos"))


@query()
def segmented_documents(s):
    return segment.segment(s.table("documents"), "doc_id").drop("is_heading")


@query()
def chunks_packed(s):
    pages = s.table("pages").select("page_id", page_text(F.col("html")).alias("text"))
    return segment.chunk(pages, "page_id").drop("content")


@query(" UNION ALL ".join(f"SELECT '{t}' AS tbl, CAST({k} AS BIGINT) AS id, trim(regexp_replace(lower({n}), '[\\x09-\\x0D\\x20]+', ' ', 'g')) AS normalized, regexp_replace(lower({n}), '[\\x09-\\x0D\\x20]+', '', 'g') AS reference FROM {t}" for t, k, n in (("part", "p_partkey", "p_name"), ("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name"))))
def name_keys(s):
    out = [s.table(t).select(F.lit(t).alias("tbl"), F.col(k).cast("long").alias("id"), ascii_normalize(F.col(n)).alias("normalized"), ascii_reference(F.col(n)).alias("reference")) for t, k, n in (("part", "p_partkey", "p_name"), ("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name"))]
    return out[0].unionAll(out[1]).unionAll(out[2])


@query("SELECT key, count(DISTINCT entity_id) AS matches, min(entity_id) AS first_id FROM (SELECT normalized_name AS key, id AS entity_id FROM kg_entity UNION SELECT normalized_name, entity_id FROM kg_alias) GROUP BY key")
def exact_lookup(s):
    names = resolve.names_of(s("kg_entity"), s("kg_alias"), "normalized_name", "normalized_name")
    return names.groupBy("key").agg(F.count("*").alias("matches"), F.min("entity_id").alias("first_id"))


@query("SELECT replace(key, ' ', '') AS key, min(entity_id) AS entity_id FROM (SELECT normalized_name AS key, id AS entity_id FROM kg_entity UNION SELECT normalized_name, entity_id FROM kg_alias) GROUP BY replace(key, ' ', '') HAVING count(DISTINCT entity_id) = 1")
def reference_lookup_unique(s):
    names = resolve.names_of(s("kg_entity"), s("kg_alias"), "normalized_name", "normalized_name")
    return resolve.unique_names(names.withColumn("key", F.replace("key", F.lit(" "), F.lit(""))))


@query("SELECT o.id, c.id AS found_claim FROM kg_claim_observation o JOIN kg_claim c ON o.subject_entity_id=c.subject_id AND o.relation=c.relation AND o.object_entity_id=c.object_id")
def claim_lookup(s):
    c = s("kg_claim").select(F.col("id").alias("found_claim"), F.col("subject_id").alias("subject_entity_id"), "relation", F.col("object_id").alias("object_entity_id"))
    return s("kg_claim_observation").join(c, ["subject_entity_id", "relation", "object_entity_id"]).select("id", "found_claim")


@query("SELECT entity_id, string_agg(name, '|' ORDER BY id) AS names FROM kg_alias GROUP BY entity_id")
def alias_lists(s):
    rows = s("kg_alias").groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("id", "name"))).alias("a"))
    return rows.select("entity_id", F.array_join(F.col("a.name"), "|").alias("names"))


@query("SELECT entity_id, id, source_id FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY id DESC) AS rn FROM kg_evidence WHERE entity_id IS NOT NULL AND polarity='support') WHERE rn <= 3")
def evidence_latest3(s):
    order = W.partitionBy("entity_id").orderBy(F.desc("id"))
    rows = s("kg_evidence").where("entity_id is not null and polarity = 'support'")
    return rows.withColumn("rn", F.row_number().over(order)).where("rn <= 3").select("entity_id", "id", "source_id")


_WORK = "SELECT DISTINCT source_id, chunk_index FROM kg_progress"


@query(f"SELECT source_id, chunk_index FROM ({_WORK}) w WHERE chunk_index >= 1 AND NOT EXISTS (SELECT 1 FROM kg_progress p WHERE p.source_id=w.source_id AND p.chunk_index=w.chunk_index AND p.status='done' AND p.chunk_hash='purchase') ORDER BY source_id, chunk_index LIMIT 50")
def pending_work(s):
    p = s("kg_progress")
    done = p.where("status = 'done' and chunk_hash = 'purchase'")
    todo = p.select("source_id", "chunk_index").distinct().where("chunk_index >= 1").join(done, ["source_id", "chunk_index"], "left_anti")
    return todo.orderBy("source_id", "chunk_index").limit(50)


@query("SELECT id, subject_name, object_name FROM kg_claim_observation WHERE (subject_entity_id IS NULL OR object_entity_id IS NULL) AND subject_name LIKE 'ref 1%' AND object_name NOT LIKE 'obj 2%'")
def unresolved_endpoints(s):
    o = s("kg_claim_observation").where(F.col("subject_entity_id").isNull() | F.col("object_entity_id").isNull())
    return o.where(F.startswith("subject_name", F.lit("ref 1")) & ~F.startswith("object_name", F.lit("obj 2"))).select("id", "subject_name", "object_name")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_valid(props)")
def valid_json_results(s):
    return s.table("events").where("try_parse_json(props) is not null").select("event_id", F.expr("try_variant_get(parse_json(props), '$.k', 'bigint')").alias("k"))


@query("SELECT id, len(ids) AS n_ids, (len(ids) BETWEEN 1 AND 3 AND len(list_distinct(ids)) = len(ids) AND len(list_filter(ids, lambda x: x > 'P000050')) = 0) AS ok FROM (SELECT id, from_json(passage_ids, '[\"VARCHAR\"]') AS ids FROM kg_claim_observation)")
def evidence_ref_check(s):
    rows = s("kg_claim_observation").select("id", F.from_json("passage_ids", "array<string>").alias("ids"))
    known = F.array(*[F.lit(f"P{i:06d}") for i in range(51)])
    ok = F.size("ids").between(1, 3) & (F.size(F.array_distinct("ids")) == F.size("ids")) & (F.size(F.array_except("ids", known)) == 0)
    return rows.select("id", F.size("ids").cast("long").alias("n_ids"), ok.alias("ok"))


@query("SELECT c.id, s.canonical_name AS subject, c.relation, o.canonical_name AS object FROM kg_claim c JOIN kg_entity s ON c.subject_id=s.id JOIN kg_entity o ON c.object_id=o.id")
def claim_named(s):
    e = s("kg_entity")
    a, b = (e.select(F.col("id").alias(f"{x}_id"), F.col("canonical_name").alias(x)) for x in ("subject", "object"))
    return s("kg_claim").join(a, "subject_id").join(b, "object_id").select("id", "subject", "relation", "object")


@query("SELECT e.id, e.target_key, s.source_key, s.language FROM kg_evidence e JOIN kg_source s ON e.source_id=s.id")
def evidence_with_source(s):
    src = s("kg_source").select(F.col("id").alias("source_id"), "source_key", "language")
    return s("kg_evidence").join(src, "source_id").select("id", "target_key", "source_key", "language")


@query("SELECT o.id, o.entity_id, o.chunk_index, s.source_key FROM kg_entity_observation o JOIN kg_source s ON o.source_id=s.id")
def entity_observation_source(s):
    src = s("kg_source").select(F.col("id").alias("source_id"), "source_key")
    return s("kg_entity_observation").join(src, "source_id").select("id", "entity_id", "chunk_index", "source_key")


@query("SELECT e.id, count(*) AS n FROM kg_entity e JOIN kg_entity_observation o ON o.entity_id=e.id GROUP BY e.id HAVING count(*) >= 25")
def definition_candidates(s):
    return s("kg_entity").select("id").join(s("kg_entity_observation").select(F.col("entity_id").alias("id")), "id").groupBy("id").agg(F.count("*").alias("n")).where("n >= 25")


_LATEST = "SELECT observation_id, id, validator_model, verdict FROM (SELECT *, row_number() OVER (PARTITION BY observation_id ORDER BY id DESC) AS rn FROM kg_judgment) WHERE rn=1"


@query(f"SELECT o.id, o.polarity, l.verdict FROM kg_claim_observation o LEFT JOIN ({_LATEST}) l ON l.observation_id=o.id")
def observation_latest_join(s):
    return report.judged(s("kg_claim_observation"), s("kg_judgment")).select("id", "polarity", "verdict")


@query(_LATEST)
def latest_judgment(s):
    return report.latest_judgment(s("kg_judgment")).select("observation_id", "id", "validator_model", "verdict")


@query("SELECT source_id, chunk_index, chunk_hash, status, seq FROM (SELECT *, row_number() OVER (PARTITION BY source_id, chunk_index ORDER BY updated_at DESC, seq DESC) AS rn FROM kg_progress) WHERE rn=1")
def latest_progress(s):
    return report.latest_progress(s("kg_progress")).select("source_id", "chunk_index", "chunk_hash", "status", "seq")


@query(f"""SELECT o.id, s.canonical_name AS subject_canonical, t.canonical_name AS object_canonical, priority,
 concat_ws(',', CASE WHEN materialization_error<>'' THEN 'blocked' END, CASE WHEN verdict IS NULL THEN 'pending_judgment' WHEN verdict<>expected THEN verdict END,
  CASE WHEN subject_entity_id IS NULL OR object_entity_id IS NULL THEN 'pending_endpoint' END, CASE WHEN claim_id IS NULL AND verdict=expected THEN 'supported_unmaterialized' END) AS statuses
 FROM (SELECT o.*, l.verdict, CASE WHEN polarity='support' THEN 'supports' ELSE 'contradicts' END AS expected,
   CASE WHEN materialization_error<>'' THEN 0 WHEN l.verdict IS NULL THEN 1 WHEN subject_entity_id IS NULL OR object_entity_id IS NULL THEN 2 ELSE 3 END AS priority
  FROM kg_claim_observation o LEFT JOIN ({_LATEST}) l ON l.observation_id=o.id ORDER BY priority, o.id LIMIT 500) o
 LEFT JOIN kg_entity s ON s.id=o.subject_entity_id LEFT JOIN kg_entity t ON t.id=o.object_entity_id""")
def observation_audit(s):
    rows = report.audit(s("kg_claim_observation"), s("kg_judgment"), s("kg_entity"))
    return rows.select("id", "subject_canonical", "object_canonical", "priority", F.array_join("statuses", ",").alias("statuses"))


@query("SELECT id, canonical_name FROM kg_entity e WHERE NOT EXISTS (SELECT 1 FROM kg_evidence v WHERE v.entity_id=e.id)")
def entities_without_evidence(s):
    return integrity.without_evidence(s("kg_entity"), s("kg_evidence")).select("id", "canonical_name")


@query("SELECT id, relation FROM kg_claim c WHERE NOT EXISTS (SELECT 1 FROM kg_evidence v WHERE v.claim_id=c.id AND v.polarity='support')")
def claims_without_support(s):
    return integrity.without_support(s("kg_claim"), s("kg_evidence")).select("id", "relation")


@query("SELECT o.id, o.claim_id FROM kg_claim_observation o LEFT JOIN kg_claim c ON c.id=o.claim_id WHERE o.claim_id IS NOT NULL AND (c.id IS NULL OR c.subject_id<>o.subject_entity_id OR c.relation<>o.relation OR c.object_id<>o.object_entity_id)")
def broken_claim_observations(s):
    return integrity.broken_claim_observations(s("kg_claim_observation"), s("kg_claim")).select("id", "claim_id")


@query("SELECT o.id, o.entity_id FROM kg_entity_observation o LEFT JOIN kg_entity e ON e.id=o.entity_id WHERE o.entity_id IS NOT NULL AND e.id IS NULL")
def broken_entity_observations(s):
    return integrity.missing_parents(s("kg_entity_observation"), "entity_id", s("kg_entity")).select("id", "entity_id")


_FK = " UNION ALL ".join(f"SELECT '{c}' AS child, '{k}' AS col, '{p}' AS parent, count(*) AS n FROM {c} x WHERE {k} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {p} y WHERE y.id=x.{k})" for c, k, p in integrity.REFERENCES)
_KG = ("kg_source", "kg_entity", "kg_alias", "kg_claim", "kg_evidence", "kg_entity_observation", "kg_claim_observation", "kg_judgment")


@query(_FK)
def fk_violations(s):
    return integrity.reference_violations({n: s(n) for n in _KG})


@query("SELECT DISTINCT a.id FROM kg_claim_observation a JOIN kg_claim_observation b ON a.source_id=b.source_id AND a.chunk_index=b.chunk_index AND a.subject_name=b.subject_name AND a.object_name=b.object_name AND a.polarity=b.polarity AND a.passage_ids=b.passage_ids AND a.id > b.id")
def legacy_duplicates(s):
    o = s("kg_claim_observation")
    keys = ["source_id", "chunk_index", "subject_name", "object_name", "polarity", "passage_ids"]
    return o.select("id", *keys).join(o.groupBy(*keys).agg(F.min("id").alias("first")), keys).where("id > first").select("id")


def _entity_names(s) -> tuple[DataFrame, DataFrame]:
    """(entity_id, name) of every entity's canonical name, and of all its names."""
    asked = s("kg_entity").select(F.col("id").alias("entity_id"), F.col("normalized_name").alias("name"))
    return asked, asked.union(s("kg_alias").select("entity_id", F.col("normalized_name").alias("name")))


@query()
def fuzzy_candidates(s):
    asked, names = _entity_names(s)
    return resolve.candidates(asked.withColumnRenamed("entity_id", "query_id"), names, 0.35)


@query()
def containment_entities(s):
    """Pairs of all entities, where containment_candidates has one part for each name."""
    asked, names = _entity_names(s)
    return resolve.containing(asked.withColumnRenamed("entity_id", "query_id"), names)


@query("SELECT DISTINCT q.p_partkey AS query_id, n.p_partkey AS entity_id FROM (SELECT min(p_partkey) AS p_partkey, p_name FROM part GROUP BY p_name) q JOIN (SELECT min(p_partkey) AS p_partkey, p_type FROM part GROUP BY p_type UNION SELECT min(p_partkey), p_name FROM part GROUP BY p_name) n ON contains(replace(q.p_name,' ',''), replace(n.p_type,' ','')) OR contains(replace(n.p_type,' ',''), replace(q.p_name,' ',''))")
def containment_candidates(s):
    part = s.table("part")
    name = part.groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("query_id"))
    kind = part.groupBy(F.col("p_type").alias("name")).agg(F.min("p_partkey").alias("entity_id"))
    return resolve.containing(name, kind.select("entity_id", "name").union(name.select(F.col("query_id").alias("entity_id"), "name")))


@query()
def reconcile_pairs(s):
    return resolve.reconcile_pairs(*_entity_names(s))


@query(f"SELECT q.page_id, string_agg(p.passage, chr(10) || chr(10) ORDER BY p.pos) AS cited FROM (SELECT page_id, unnest([printf('P%06d', 1 + page_id % 3), printf('P%06d', 2 + page_id % 3)]) AS passage_id FROM pages) q JOIN ({_PASSAGES}) p ON p.page_id=q.page_id AND p.passage_id=q.passage_id GROUP BY q.page_id")
def passage_lookup(s):
    asked = s.table("pages").select("page_id", F.explode(F.array(*[F.format_string("P%06d", F.lit(k) + F.col("page_id") % 3) for k in (1, 2)])).alias("passage_id"))
    got = asked.join(_blank_line_passages(s), ["page_id", "passage_id"]).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("pos", "passage"))).alias("a"))
    return got.select("page_id", F.array_join(F.col("a.passage"), "\n\n").alias("cited"))


@query(" UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {n}" for n in ("kg_source", "kg_entity", "kg_claim", "kg_evidence")))
def table_counts(s):
    return report.counts({n: s(n) for n in ("kg_source", "kg_entity", "kg_claim", "kg_evidence")})


@query("SELECT status, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY source_id, chunk_index ORDER BY updated_at DESC, seq DESC) AS rn FROM kg_progress) WHERE rn=1 GROUP BY status")
def progress_status(s):
    return report.count_by(report.latest_progress(s("kg_progress")), "status")


@query("SELECT relation, count(*) AS n FROM kg_claim GROUP BY relation")
def relation_counts(s):
    return report.count_by(s("kg_claim"), "relation")


_REPORT = f"""SELECT count(*) AS total, count(*) FILTER (subject_entity_id IS NULL OR object_entity_id IS NULL) AS pending_endpoint, count(*) FILTER (claim_id IS NOT NULL) AS materialized,
 count(*) FILTER (materialization_error<>'') AS blocked, count(*) FILTER (claim_id IS NULL AND verdict IS NULL) AS pending_judgment, count(*) FILTER (verdict='supports') AS supports,
 count(*) FILTER (verdict='insufficient') AS insufficient, count(*) FILTER (verdict='contradicts') AS contradicts, count(*) FILTER (claim_id IS NULL AND verdict='supports') AS supported_unmaterialized
 FROM kg_claim_observation o LEFT JOIN ({_LATEST.replace("id, validator", "id AS jid, validator")}) l ON l.observation_id=o.id"""


@query(_REPORT)
def observation_report(s):
    return report.observation_report(s("kg_claim_observation"), s("kg_judgment"))


@query("SELECT count(*) AS total, count(*) FILTER (entity_id IS NULL) AS pending, count(*) FILTER (resolution_outcome='same') AS n_same, count(*) FILTER (resolution_outcome='new') AS n_new, count(*) FILTER (resolution_outcome='uncertain') AS n_uncertain FROM kg_entity_observation")
def entity_observation_report(s):
    return report.entity_observation_report(s("kg_entity_observation"))


_DEGREE = "SELECT entity_id, count(*) AS degree FROM (SELECT subject_id AS entity_id FROM kg_claim UNION ALL SELECT object_id FROM kg_claim) GROUP BY entity_id"


@query(_DEGREE)
def entity_degree(s):
    return report.degree(s("kg_claim"))


@query(f"SELECT count(*) FILTER (coalesce(degree,0)=0) AS isolated, count(*) FILTER (degree=1) AS leaf FROM kg_entity e LEFT JOIN ({_DEGREE}) d ON d.entity_id=e.id")
def isolated_leaf(s):
    return report.isolated_leaf(s("kg_entity"), s("kg_claim"))


_CATEGORY = "CASE WHEN starts_with(message,'endpoint unresolved') THEN 'unresolved_endpoint' WHEN starts_with(message,'verdict insufficient') THEN 'insufficient' WHEN starts_with(message,'verdict contradicts') THEN 'contradicted' WHEN contains(message,'passage_ids') THEN 'invalid_passage' WHEN contains(message,'over limit') THEN 'limit' WHEN starts_with(message,'entity[') OR starts_with(message,'claim[') THEN 'invalid_extraction' ELSE 'other' END"


@query(f"SELECT CASE WHEN category IN ('unresolved_endpoint','invalid_passage','limit','invalid_extraction') THEN 'algorithmic' WHEN category IN ('insufficient','contradicted') THEN 'semantic' ELSE 'unclassified' END AS kind, category, count(*) AS n FROM (SELECT {_CATEGORY} AS category FROM kg_rejection) GROUP BY ALL")
def rejection_report(s):
    return report.rejection_report(s("kg_rejection"))


@query(f"SELECT category, id, message FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY id) AS rn FROM (SELECT *, {_CATEGORY} AS category FROM kg_rejection)) WHERE rn <= 20")
def rejection_samples(s):
    return report.rejection_samples(s("kg_rejection")).select("category", "id", "message")


_SIDES = "SELECT id, source_id, passage_ids, source_text, 0 AS side, subject_reference_key AS key, subject_name AS name FROM kg_claim_observation WHERE subject_entity_id IS NULL UNION ALL SELECT id, source_id, passage_ids, source_text, 1, object_reference_key, object_name FROM kg_claim_observation WHERE object_entity_id IS NULL"


@query(f"SELECT key, count(DISTINCT id) AS observations, arg_min(name, id * 2 + side) AS name, count(DISTINCT name) AS names FROM ({_SIDES}) GROUP BY key")
def pending_groups(s):
    return report.pending_groups(s("kg_claim_observation"))


@query(f"SELECT key, name, passage_count, source_count FROM (SELECT key, arg_min(name, id * 2 + side) AS name, count(DISTINCT concat(source_id, ' ', passage_ids)) AS passage_count, count(DISTINCT source_id) AS source_count, bool_or(contains(regexp_replace(lower(source_text), '\\s+', '', 'g'), key)) AS lit FROM ({_SIDES}) GROUP BY key) WHERE passage_count >= 3 AND lit")
def promotion_candidates(s):
    return report.promotion_candidates(s("kg_claim_observation"))


@query("SELECT id, target_key, source_id, polarity FROM kg_evidence")
def keyed_evidence_dedup(s):
    raw = s("kg_evidence_raw")
    return keyed.insert_or_ignore(raw.limit(0), raw, ["target_key", "source_id", "excerpt_hash", "polarity"]).select("id", "target_key", "source_id", "polarity")


@query("SELECT source_id, chunk_index, chunk_hash, status, seq FROM (SELECT *, row_number() OVER (PARTITION BY source_id, chunk_index, chunk_hash ORDER BY seq DESC) AS rn FROM kg_progress) WHERE rn=1")
def progress_upsert(s):
    p = s("kg_progress")
    return keyed.upsert(p.limit(0), p, ["source_id", "chunk_index", "chunk_hash"], "seq").select("source_id", "chunk_index", "chunk_hash", "status", "seq")


_REACH = "WITH RECURSIVE reach(s, o) AS (SELECT subject_id, object_id FROM kg_claim WHERE relation='prerequisite_of' UNION SELECT r.s, c.object_id FROM reach r JOIN kg_claim c ON c.subject_id=r.o AND c.relation='prerequisite_of') SELECT s, o FROM reach"


def _edges(s, relation: str | None = None) -> DataFrame:
    c = s("kg_claim")
    c = c.where(F.col("relation") == relation) if relation else c
    return c.select("id", F.col("subject_id").alias("s"), F.col("object_id").alias("o"))


@query(_REACH)
def reachability(s):
    return graph.closure(_edges(s, "prerequisite_of"))


_COMPONENT = "WITH RECURSIVE e AS (SELECT subject_id AS a, object_id AS b FROM kg_claim WHERE relation='prerequisite_of' UNION SELECT object_id, subject_id FROM kg_claim WHERE relation='prerequisite_of'), r(id, x) AS (SELECT id, id FROM kg_entity UNION SELECT r.id, e.b FROM r JOIN e ON e.a=r.x), c AS (SELECT id, min(x) AS component FROM r GROUP BY id) "


@query(_COMPONENT + "SELECT id, component FROM c")
def components(s):
    return graph.components(s("kg_entity").select("id"), _edges(s, "prerequisite_of"))


@query(_COMPONENT + "SELECT component, count(*) AS n FROM c GROUP BY component")
def component_sizes(s):
    return report.count_by(graph.components(s("kg_entity").select("id"), _edges(s, "prerequisite_of")), "component")


_CYCLE = "WITH RECURSIVE reach(s, o) AS (SELECT subject_id, object_id FROM kg_claim WHERE relation='prerequisite_of' UNION SELECT r.s, c.object_id FROM reach r JOIN kg_claim c ON c.subject_id=r.o AND c.relation='prerequisite_of') "


@query(_CYCLE + "SELECT c.id, c.subject_id AS s, c.object_id AS o, c.relation FROM kg_claim c WHERE c.relation='prerequisite_of' AND EXISTS (SELECT 1 FROM reach r WHERE r.s=c.object_id AND r.o=c.subject_id)")
def cycle_edges(s):
    return integrity.cycles(s("kg_claim"))


@query(_CYCLE + f"""SELECT 'missing_parent' AS issue, CAST(sum(n) AS BIGINT) AS n FROM ({_FK})
 UNION ALL SELECT 'cycle', count(*) FROM kg_claim c WHERE c.relation='prerequisite_of' AND EXISTS (SELECT 1 FROM reach r WHERE r.s=c.object_id AND r.o=c.subject_id)
 UNION ALL SELECT 'entity_without_evidence', count(*) FROM kg_entity e WHERE NOT EXISTS (SELECT 1 FROM kg_evidence v WHERE v.entity_id=e.id)
 UNION ALL SELECT 'claim_without_support', count(*) FROM kg_claim c WHERE NOT EXISTS (SELECT 1 FROM kg_evidence v WHERE v.claim_id=c.id AND v.polarity='support')
 UNION ALL SELECT 'broken_claim_observation', count(*) FROM kg_claim_observation o LEFT JOIN kg_claim c ON c.id=o.claim_id WHERE o.claim_id IS NOT NULL AND (c.id IS NULL OR c.subject_id<>o.subject_entity_id OR c.relation<>o.relation OR c.object_id<>o.object_entity_id)
 UNION ALL SELECT 'broken_entity_observation', count(*) FROM kg_entity_observation o LEFT JOIN kg_entity e ON e.id=o.entity_id WHERE o.entity_id IS NOT NULL AND e.id IS NULL""")
def integrity_report(s):
    return integrity.integrity_report({n: s(n) for n in _KG})


@query("WITH e AS (SELECT subject_id AS a, object_id AS b FROM kg_claim UNION SELECT object_id, subject_id FROM kg_claim), h1 AS (SELECT DISTINCT b AS id FROM e WHERE a=7 AND b<>7), h2 AS (SELECT DISTINCT e.b AS id FROM h1 JOIN e ON e.a=h1.id WHERE e.b<>7 AND e.b NOT IN (SELECT id FROM h1)) SELECT CAST(7 AS BIGINT) AS id, 0 AS hop UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2")
def neighbourhood_2hop(s):
    return graph.neighbourhood(_edges(s), s("kg_entity").where("id = 7").select("id"), 2)


@query("SELECT min(id) AS id, s AS subject_id, relation, o AS object_id FROM (SELECT id, relation, subject_id - subject_id % 2 AS s, object_id - object_id % 2 AS o FROM kg_claim WHERE relation='part_of') WHERE s<>o GROUP BY s, relation, o")
def entity_merge(s):
    mapping = s("kg_entity").select(F.col("id").alias("old"), (F.col("id") - F.col("id") % 2).alias("new"))
    return materialize.merged_claims(s("kg_claim").where("relation = 'part_of'"), mapping)


@query(f"""SELECT o.id, CASE WHEN c.id IS NOT NULL THEN 'already_materialized' WHEN l.verdict IS NULL THEN 'pending_judgment'
 WHEN l.verdict <> CASE WHEN o.polarity='support' THEN 'supports' ELSE 'contradicts' END THEN 'not_supported' WHEN o.subject_entity_id IS NULL OR o.object_entity_id IS NULL THEN 'pending_endpoint'
 WHEN o.polarity='oppose' AND t.id IS NULL AND NOT coalesce(m.maker < o.id, false) THEN 'blocked' WHEN o.polarity='support' AND t.id IS NULL AND o.subject_entity_id=o.object_entity_id THEN 'blocked' ELSE 'materialized' END AS outcome
 FROM kg_claim_observation o LEFT JOIN kg_claim c ON c.id=o.claim_id LEFT JOIN ({_LATEST.replace("id, validator", "id AS jid, validator")}) l ON l.observation_id=o.id
 LEFT JOIN kg_claim t ON t.subject_id=o.subject_entity_id AND t.relation=o.relation AND t.object_id=o.object_entity_id
 LEFT JOIN (SELECT min(w.id) AS maker, subject_entity_id AS s, w.relation AS r, object_entity_id AS e FROM kg_claim_observation w JOIN ({_LATEST.replace("id, validator", "id AS jid, validator")}) k ON k.observation_id=w.id LEFT JOIN kg_claim d ON d.id=w.claim_id
  WHERE d.id IS NULL AND polarity='support' AND k.verdict='supports' AND subject_entity_id<>object_entity_id GROUP BY ALL) m ON m.s=o.subject_entity_id AND m.r=o.relation AND m.e=o.object_entity_id""")
def materialize_outcomes(s):
    return materialize.materialize(s("kg_claim_observation"), s("kg_judgment"), s("kg_claim"))


@query("SELECT e.id, e.canonical_name, coalesce(a.names, '') AS aliases, coalesce(d.degree, 0) AS degree, coalesce(v.n, 0) AS evidence FROM kg_entity e LEFT JOIN (SELECT entity_id, string_agg(name, '|' ORDER BY id) AS names FROM kg_alias GROUP BY entity_id) a ON a.entity_id=e.id LEFT JOIN (" + _DEGREE + ") d ON d.entity_id=e.id LEFT JOIN (SELECT entity_id, count(*) AS n FROM kg_evidence WHERE entity_id IS NOT NULL GROUP BY entity_id) v ON v.entity_id=e.id")
def graph_export(s):
    names = s("kg_alias").groupBy(F.col("entity_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_list(F.struct("id", "name")))["name"], "|").alias("names"))
    d = report.degree(s("kg_claim")).withColumnRenamed("entity_id", "id")
    v = s("kg_evidence").where("entity_id is not null").groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("n"))
    rows = s("kg_entity").join(names, "id", "left").join(d, "id", "left").join(v, "id", "left")
    return rows.select("id", "canonical_name", F.coalesce("names", F.lit("")).alias("aliases"), F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("n", F.lit(0)).alias("evidence"))


@query()
def definition_fingerprints(s):
    rows = s("kg_entity_observation").where("entity_id is not null").groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "id", "source_id"))).alias("o"))
    return rows.select("entity_id", F.sha2(F.to_json(F.struct("o")), 256).alias("fingerprint"))


@query()
def promotion_fingerprints(s):
    rows = report.unresolved_sides(s("kg_claim_observation"))
    sets = rows.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("source_id", "passage_ids"))).alias("u"), F.array_sort(F.collect_set("id")).alias("i"))
    return sets.select("key", F.sha2(F.to_json(F.struct("u", "i")), 256).alias("fingerprint"))


@query("SELECT id, sha256(source_text || chr(0) || subject_name || chr(0) || passage_ids) AS excerpt_hash, CASE WHEN claim_id IS NULL THEN 'entity:' || id ELSE 'claim:' || claim_id END AS target_key FROM kg_claim_observation")
def evidence_keys(s):
    """The key of each observation's excerpt, its target the claim that it became or else an entity of its id."""
    o = s("kg_claim_observation")
    ids = F.from_json("passage_ids", "array<string>")
    entity = F.when(F.col("claim_id").isNull(), F.col("id"))
    return o.select("id", keys.excerpt_hash(F.col("source_text"), F.col("subject_name"), ids).alias("excerpt_hash"), keys.target_key(entity, F.col("claim_id")).alias("target_key"))


_KEYED = "'[' || source_id || ',' || chunk_index || ',\"' || "


@query(f"""SELECT id, sha256({_KEYED} subject_reference_key || '","' || relation || '","' || object_reference_key || '","' || polarity || '","' || source_text || '","",' || passage_ids || ',"m","v1"]') AS observation_key FROM kg_claim_observation""")
def claim_observation_keys(s):
    c = F.col
    key = keys.claim_observation_key(c("source_id"), c("chunk_index"), c("subject_name"), c("relation"), c("object_name"), c("polarity"), c("source_text"), F.lit(""), F.from_json("passage_ids", "array<string>"), "m", "v1")
    return s("kg_claim_observation").select("id", key.alias("observation_key"))


@query(f"""SELECT id, sha256({_KEYED} lower(replace(canonical_name, ' ', '')) || '","' || definition || '","concept",["' || definition || '","b"],"' || canonical_name || '","q",["P1","P2"],"m","v1"]') AS observation_key FROM (SELECT *, id % 20 AS source_id, id % 7 AS chunk_index FROM kg_entity)""")
def entity_observation_keys(s):
    c = F.col
    key = keys.entity_observation_key(c("id") % 20, c("id") % 7, c("canonical_name"), c("definition"), F.lit("concept"), F.array("definition", F.lit("b")), c("canonical_name"), F.lit("q"), F.array(F.lit("P1"), F.lit("P2")), "m", "v1")
    return s("kg_entity").select("id", key.alias("observation_key"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY target_key, source_id, excerpt_hash, polarity ORDER BY id) AS rn FROM kg_evidence_raw),
 t AS (SELECT * FROM r WHERE rn = 1 AND source_id % 2 = 0), f AS (SELECT * FROM r WHERE rn = 1 AND source_id % 2 <> 0)
 SELECT id, target_key, source_id, excerpt_hash, polarity FROM t UNION ALL SELECT (SELECT max(id) FROM t) + row_number() OVER (ORDER BY id), target_key, source_id, excerpt_hash, polarity FROM f""")
def evidence_added(s):
    """All evidence written into a table that has that of the even sources: those rows stay, the others come after them."""
    rows = s("kg_evidence_raw").select("id", *write.EVIDENCE_KEY)
    return write.added(keyed.first_by_key(rows.where("source_id % 2 = 0"), write.EVIDENCE_KEY), rows.withColumn("seen", F.col("id")), write.EVIDENCE_KEY, "seen").select("id", "target_key", "source_id", "excerpt_hash", "polarity")


_CLAIM_ENDS = "SELECT o_custkey % 50 AS subject_id, CASE WHEN o_orderstatus='F' THEN 'part_of' ELSE 'related_to' END AS relation, 60 + o_custkey % 40 AS object_id FROM orders"


@query(f"""WITH fresh AS (SELECT DISTINCT * FROM ({_CLAIM_ENDS}) x EXCEPT SELECT subject_id, relation, object_id FROM kg_claim)
 SELECT id, subject_id, relation, object_id FROM kg_claim UNION ALL SELECT (SELECT max(id) FROM kg_claim) + row_number() OVER (ORDER BY subject_id, relation, object_id), subject_id, relation, object_id FROM fresh""")
def claims_added(s):
    rows = s.table("orders").selectExpr("o_custkey % 50 as subject_id", "case when o_orderstatus='F' then 'part_of' else 'related_to' end as relation", "60 + o_custkey % 40 as object_id")
    return write.claims(s("kg_claim"), rows)

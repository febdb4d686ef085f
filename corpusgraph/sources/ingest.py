"""Catalogs and their sources: text, Markdown, JSON lines, HTML, PDF and HTTP."""

from __future__ import annotations

import json
import os
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.functions.html import page_text

SPEC = "key string, name string, type string, path string, uri string, language string, version string"


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """The sources that a JSON or YAML catalog lists, relative paths taken from the catalog's folder.

    A source needs a name, a type, and a path or a URI; its key defaults to the URI, the path or the name.
    """
    with open(path, encoding="utf-8") as f:
        if path.endswith((".yaml", ".yml")):
            import yaml

            found = yaml.safe_load(f)
        else:
            found = json.load(f)
    if not isinstance(found, dict) or not isinstance(found.get("sources"), list):
        raise ValueError("a catalog is an object with a list of sources")
    rows = []
    for s in found["sources"]:
        if not s.get("name") or not s.get("type") or not (s.get("path") or s.get("uri")):
            raise ValueError(f"a source needs a name, a type, and a path or uri: {s}")
        at = os.path.abspath(os.path.join(os.path.dirname(path), s["path"])) if s.get("path") else None
        uri = s.get("uri") or f"file://{at}"
        rows.append((s.get("key") or s.get("uri") or s.get("path") or s["name"], s["name"], s["type"], at, uri, s.get("language"), s.get("version")))
    return spark.createDataFrame(rows, SPEC)


def cleaned(text: Column) -> Column:
    """Without NUL characters and outer white space."""
    return F.regexp_replace(F.translate(text, "\x00", ""), r"(?U)^\s+|\s+$", "")


def versioned(docs: DataFrame, text: str = "text", version: Column | None = None) -> DataFrame:
    """docs with content, content_hash and version: the declared one, or the first 12 digits of the hash."""
    out = docs.withColumn("content", cleaned(F.col(text)))
    out = out.withColumn("content_hash", F.sha2("content", 256))
    declared = version if version is not None else F.lit(None).cast("string")
    return out.withColumn("version", F.coalesce(F.nullif(declared, F.lit("")), F.substring("content_hash", 1, 12)))


def source_versions(docs: DataFrame, key: str = "source", text: str = "text", order: str = "doc_id") -> DataFrame:
    """One row for each (source_key, content_hash), with the lowest id: adding the same text again adds nothing."""
    rows = docs.select(F.col(key).alias("source_key"), F.col(order).alias("id"), F.sha2(F.col(text), 256).alias("content_hash"))
    return rows.groupBy("source_key", "content_hash").agg(F.min("id").alias("id"), F.count("*").alias("n_seen"))


def text_of_jsonl(value: str) -> str:
    """Each line a string, or an object with text or content; blank lines are skipped."""
    out = []
    for line in value.splitlines():
        if line.strip():
            row = json.loads(line)
            row = row if isinstance(row, str) else (row.get("text") or row.get("content")) if isinstance(row, dict) else None
            if not isinstance(row, str):
                raise ValueError("a line is neither a string nor an object with text or content")
            out.append(row)
    return "\n\n".join(out)


def load(specs: DataFrame, opener: Callable[[str], tuple[bytes, str]] | None = None, pdf: Callable[[bytes], str] | None = None) -> DataFrame:
    """specs with content, content_hash and version; files and addresses are read by the executors.

    opener gives (bytes, content type) of an address; pdf gives the text of a PDF, pages joined by form feeds. An empty
    text is an error.
    """

    def fetch(uri: str) -> tuple[bytes, str]:
        if opener:
            return opener(uri)
        ask = urllib.request.Request(uri, headers={"User-Agent": "corpusgraph"})
        with urllib.request.urlopen(ask, timeout=60) as got:  # noqa: S310
            return got.read(), got.headers.get("Content-Type", "")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raw, kind = [], []
            for path, uri in zip(batch["path"], batch["uri"]):
                if path:
                    with open(path, "rb") as f:
                        raw.append(f.read())
                    kind.append(os.path.splitext(path)[1].lower())
                else:
                    body, content = fetch(uri)
                    raw.append(body)
                    kind.append(".pdf" if "pdf" in content else ".html" if "html" in content else os.path.splitext(uri)[1].lower())
            out = []
            for body, k in zip(raw, kind):
                if k == ".pdf":
                    if pdf is None:
                        raise RuntimeError("no PDF reader is set")
                    out.append(pdf(body))
                else:
                    text = body.decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n")
                    out.append(text_of_jsonl(text) if k == ".jsonl" else text)
            yield batch.assign(raw=out, is_html=[k in (".html", ".htm") for k in kind])

    rows = specs.mapInPandas(run, f"{SPEC}, raw string, is_html boolean")
    rows = rows.withColumn("raw", F.when(F.col("is_html"), page_text(F.col("raw"), all_entities=True)).otherwise(F.col("raw")))
    rows = versioned(rows.drop("is_html"), "raw", F.col("version")).drop("raw")
    return rows.withColumn("content", F.when(F.col("content") != "", F.col("content")).otherwise(F.raise_error(F.concat(F.lit("empty source: "), "name")).cast("string")))

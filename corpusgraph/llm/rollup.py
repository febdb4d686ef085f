"""Token counts as delta-maintained rollups by source, language and tokenizer version."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.llm.staging import moved, staged

KEY = ("source", "lang", "tokenizer")


def _counts(text: str) -> dict[str, Column]:
    """words.1: runs without white space; bytes.1: UTF-8 bytes; words.2: as words.1, those with a letter or digit."""
    words = F.filter(F.split(F.col(text), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    return {"words.1": F.size(words).cast("long"), "bytes.1": F.octet_length(text).cast("long"), "words.2": F.size(F.filter(words, lambda w: F.rlike(w, F.lit("[\\p{L}\\p{N}]")))).cast("long")}


def counted(docs: DataFrame, tokenizers: tuple[str, ...] = ("words.1", "bytes.1")) -> DataFrame:
    """(doc_id, source, lang, tokenizer, n_tokens) of each document and tokenizer version; a null text counts 0."""
    known = _counts("text")
    rows = docs.select("doc_id", "source", "lang", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    each = F.array(*[F.struct(F.lit(t).alias("tokenizer"), known[t].alias("n_tokens")) for t in tokenizers])
    return rows.select("doc_id", "source", "lang", F.inline(each))


def inserts(counts: DataFrame) -> DataFrame:
    """Signed rows that add documents."""
    return counts.select(*KEY, F.lit(1).cast("long").alias("d_docs"), F.col("n_tokens").alias("d_tokens"))


def deletes(counts: DataFrame) -> DataFrame:
    """Signed rows that take documents away, given the counts they came in with."""
    return counts.select(*KEY, F.lit(-1).cast("long").alias("d_docs"), (-F.col("n_tokens")).alias("d_tokens"))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Signed rows that put new counts in place of old ones: the documents stay, the difference is added."""
    out = old.select(*KEY, F.lit(-1).cast("long").alias("d_docs"), (-F.col("n_tokens")).alias("d_tokens"))
    return out.unionByName(inserts(new))


class Rollup:
    """Additive totals kept as one small Parquet folder for each committed batch.

    A batch is written to a folder of its own and then moved to the name of its id, which succeeds for one writer only.
    Committing an id again changes nothing, whatever rows it brings; a batch that broke off leaves a folder that nothing
    reads. Totals are the sums over committed batches, so batches may come in any order.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, at: str):
        jvm = self.spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(at)
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), place

    def committed(self, batch: str) -> bool:
        fs, at = self._fs(f"{self.path}/batch={batch}/_SUCCESS")
        return fs.exists(at)

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Adds deltas (source, lang, tokenizer, d_docs, d_tokens) under an id of letters, digits, - and _; False if it was there."""
        if not batch or not all(c.isalnum() or c in "-_" for c in batch):
            raise ValueError(f"not a batch id: {batch!r}")
        if self.committed(batch):
            return False
        sums = deltas.groupBy(*KEY).agg(F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("d_tokens"))
        own = f"{self.path}/_writing-{uuid.uuid4().hex}"
        sums.write.parquet(own)
        if moved(self.spark, own, f"{self.path}/batch={batch}"):
            return True
        fs, at = self._fs(own)
        fs.delete(at, True)
        return False

    def totals(self, keep_empty: bool = False) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens, n_batches); keys whose documents have all gone are left out unless asked for.

        Null keys are keys of their own. No committed batch gives an empty table.
        """
        fs, at = self._fs(self.path)
        done = [s.getPath().toString() for s in (fs.listStatus(at) if fs.exists(at) else []) if s.isDirectory() and s.getPath().getName().startswith("batch=") and self._fs(f"{s.getPath().toString()}/_SUCCESS")[0].exists(self._fs(f"{s.getPath().toString()}/_SUCCESS")[1])]
        schema = "source string, lang string, tokenizer string, d_docs long, d_tokens long"
        rows = self.spark.read.schema(schema).parquet(*done) if done else self.spark.createDataFrame([], schema)
        out = rows.groupBy(*KEY).agg(F.sum("d_docs").alias("n_docs"), F.sum("d_tokens").alias("n_tokens"), F.count("*").alias("n_batches"))
        return out if keep_empty else out.where("n_docs <> 0 or n_tokens <> 0")


def maintained(docs: DataFrame, labels: DataFrame, path: str) -> DataFrame:
    """Totals after three batches over the documents, the second committed twice.

    Every document comes in with words.1 and bytes.1; those labelled toxic are deleted; then words.1 of the documents
    labelled quality 0 that are left is revised to count words with a letter or digit only. Texts are counted once, into a
    written ledger of a few numbers a document; deletes and revisions join the ledger, so no text is shuffled. A document
    with several labels is toxic if any says so and of its lowest quality; rows that share a doc_id share its labels. Null
    texts count 0, null sources and languages are keys, a null doc_id has no label, and empty tables give an empty result.
    """
    table = Rollup(docs.sparkSession, path)
    marks = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    ledger = staged(counted(docs, ("words.1", "bytes.1", "words.2")))
    came = ledger.where("tokenizer <> 'words.2'")
    table.commit("load", inserts(came))
    gone = deletes(came.join(marks.where("toxic = 1"), "doc_id"))
    table.commit("toxic", gone)
    table.commit("toxic", gone)
    low = ledger.join(marks.where("coalesce(toxic, 0) <> 1 and quality = 0"), "doc_id")
    new = low.where("tokenizer = 'words.2'").withColumn("tokenizer", F.lit("words.1"))
    table.commit("recount", revisions(low.where("tokenizer = 'words.1'"), new))
    return table.totals()

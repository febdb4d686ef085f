"""Keyed writes on Parquet: first or last write wins, dense ids, snapshots with a pointer."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def checkpointing(spark: SparkSession) -> None:
    """Sets the shared folder that spark.checkpoint.dir names as that of checkpoints; one of our own only on a local master."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        at = spark.conf.get("spark.checkpoint.dir", None)
        if at is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            at = os.path.join(tempfile.gettempdir(), f"corpusgraph-{uuid.uuid4().hex}")
        sc.setCheckpointDir(at)


def cut(df: DataFrame) -> DataFrame:
    """df checkpointed in the shared folder."""
    checkpointing(df.sparkSession)
    return df.checkpoint()


def first_by_key(rows: DataFrame, keys: list[str], order: str = "id") -> DataFrame:
    """One row a key, that of the lowest order: an aggregate, so repeated keys meet before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*").select(*rows.columns)


def last_by_key(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row a key, that of the highest order."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*").select(*rows.columns)


def insert_or_ignore(table: DataFrame, rows: DataFrame, keys: list[str], order: str = "id") -> DataFrame:
    """table with the rows whose key it lacks, the first of each."""
    fresh = first_by_key(rows, keys, order).join(table.select(*keys).distinct(), keys, "left_anti")
    return table.unionByName(fresh.select(*table.columns))


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """table with rows put in, the row of the highest order for each key; rows come after what the table has."""
    both = table.withColumn("cg_late", F.lit(0)).unionByName(rows.withColumn("cg_late", F.lit(1)))
    return last_by_key(both, keys, "cg_late", order).drop("cg_late")


def written(df: DataFrame) -> DataFrame:
    """df as Parquet in a new folder beside the checkpoints, written in one pass and read back."""
    checkpointing(df.sparkSession)
    at = f"{df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().get()}/written-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def with_ids(rows: DataFrame, start: int, *order: str, keep: list[str] | None = None) -> DataFrame:
    """rows (of keep, the columns kept) with dense ids from start + 1 in the given order.

    Rows are dealt by range, sorted and written once, each with its part and its place in it; the counts of the parts, one
    number a part, give each part its first id.
    """
    keep = rows.columns if keep is None else keep
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = written(sorted_rows.select(*keep, F.monotonically_increasing_id().alias("cg_at")))
    part = F.shiftright("cg_at", 33)
    counts = dict(dealt.groupBy(part.alias("part")).agg(F.count("*")).collect())
    before = [start]
    for k in range(max(counts, default=0)):
        before.append(before[-1] + counts.get(k, 0))
    first = F.expr(f"array({','.join(f'{n}L' for n in before)})")[part.cast("int")]
    return dealt.select(*keep, (first + F.col("cg_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("id"))


def moved(spark: SparkSession, source: str, target: str) -> bool:
    """Renames a folder to a name that nothing has yet; False, and no change, if something has it."""
    from py4j.protocol import Py4JJavaError

    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    start, end = hadoop.Path(source), hadoop.Path(target)
    files = hadoop.FileContext.getFileContext(start.getFileSystem(conf).getUri(), conf)
    try:
        files.rename(start, end, spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0))
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" in e.java_exception.getClass().getName() or "is not empty" in str(e.java_exception.getMessage()):
            return False
        raise
    return True


class Snapshots:
    """Tables as Parquet folders, one a version; a commit is the small file that names each table's version."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _head(self) -> int:
        at = self._path(f"{self.path}/_commits")
        if not self._fs.exists(at):
            return 0
        return max([int(s.getPath().getName()) for s in self._fs.listStatus(at)], default=0)

    def versions(self) -> dict[str, str]:
        n = self._head()
        if not n:
            return {}
        rows = self.spark.read.schema("name string, folder string").json(f"{self.path}/_commits/{n}").collect()
        return {r["name"]: r["folder"] for r in rows}

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{self.versions()[name]}")

    def commit(self, **tables: DataFrame) -> int:
        """Writes the tables' new versions, then the commit that names them; before that readers see the old ones."""
        n = self._head() + 1  # of what this commit knows; a commit made meanwhile takes the number
        known = self.versions()
        for name, df in tables.items():
            folder = f"{name}/{uuid.uuid4().hex}"
            df.write.parquet(f"{self.path}/{folder}")
            known[name] = folder
        temporary = f"{self.path}/_new-{uuid.uuid4().hex}"
        self.spark.createDataFrame(sorted(known.items()), "name string, folder string").coalesce(1).write.json(temporary)
        self._fs.mkdirs(self._path(f"{self.path}/_commits"))
        if not moved(self.spark, temporary, f"{self.path}/_commits/{n}"):
            self._fs.delete(self._path(temporary), True)
            raise RuntimeError("another writer made this commit")
        return n

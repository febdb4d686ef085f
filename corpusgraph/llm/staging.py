"""Written intermediate tables in the folder that all executors share."""

from __future__ import annotations

import os
import pickle
import tempfile
import uuid
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEANUP = ("spark.sql.classic.shuffleDependency.fileCleanup.enabled",)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder only where none is set and the master is local."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = os.path.join(tempfile.gettempdir(), f"corpusgraph-{uuid.uuid4().hex}")
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def staged(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: the lineage is cut and survives lost executors.

    rows, where the caller knows about how many small ones there are, keeps them in as few files as that takes. Once the
    table is written nothing reads the shuffle files that made it, so they are removed at once. release() removes a table
    that has served its purpose.
    """
    spark = df.sparkSession
    df = df if rows is None else df.coalesce(max(1, -(-rows // 200_000)))
    at = f"{shared_dir(spark)}/staged-{uuid.uuid4().hex}"
    schema = df.schema
    before = {k: spark.conf.get(k, None) for k in _CLEANUP}
    try:
        for k in _CLEANUP:
            spark.conf.set(k, "true")
        df.write.parquet(at)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(schema).parquet(at)
    out.staged_at = at
    return out


def release(*tables: DataFrame) -> None:
    """Removes tables that staged() returned; nothing may read them any more."""
    for table in tables:
        place = table.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(table.staged_at)
        place.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def bound(df: DataFrame, **columns) -> DataFrame:
    """df with columns that are computed once a row.

    The optimizer puts a projected expression in place of each use of it, also in filters and lambda bodies, where it runs
    again for every element; it doesn't do so across a generator, here one that makes a single row.
    """
    kept = [c for c in df.columns if c not in columns]
    return df.select(*[F.col(f"`{c}`") for c in kept], F.inline(F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))))


def beside(rows: DataFrame, few: DataFrame, on, salt: str, most: int = 1 << 20, parts: int = 32) -> DataFrame:
    """rows joined with few: broadcast if few is counted to have at most so many rows.

    Beyond that each key is dealt over parts tasks by the hash of the salt column, so that a key which many rows have is
    no single task.
    """
    if few.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(few), on)
    few = few.withColumn("cg__part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    rows = rows.withColumn("cg__part", F.pmod(F.xxhash64(salt), F.lit(parts)).cast("int"))
    return rows.join(few, [*([on] if isinstance(on, str) else on), "cg__part"]).drop("cg__part")


def sent(spark: SparkSession, value) -> Callable:
    """A function that gives value on the executors, which need no copy of this package to read it."""
    held = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(held.value)


def moved(spark: SparkSession, source: str, target: str) -> bool:
    """Renames a folder to a name that nothing has yet; False, and no change, if something has it."""
    from py4j.protocol import Py4JJavaError

    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    start, end = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(start.getFileSystem(conf).getUri(), conf)
    never = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        files.rename(start, end, never)
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" in e.java_exception.getClass().getName() or "is not empty" in str(e.java_exception.getMessage()):
            return False
        raise
    return True

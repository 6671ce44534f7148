"""Where intermediate results go: the folder that the whole cluster shares."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Paths of the tables that stand, in order.
_TABLES: dict[str, None] = {}
_CLEAN = "spark.cleaner.referenceTracking.cleanCheckpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where the session names none, a folder of our own, but only on a local master
    (tests, a laptop): on a cluster executors would not see it, so there it is an error."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tracelake-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder and goes on from there: its lineage ends, and a lost executor loses nothing.

    The files go when Spark's cleaner finds that no DataFrame needs them any more: unless the session says otherwise,
    this turns that on, which Spark has off."""
    spark = df.sparkSession
    shared_dir(spark)
    conf = spark.sparkContext._jsc.sc().conf()
    if not conf.contains(_CLEAN):
        conf.set(_CLEAN, "true")
    return df.checkpoint(eager=True)


def written(df: DataFrame, random: tuple[str, ...] = (), rows: int = 0) -> DataFrame:
    """As ``cut``, as a Parquet table: for wide rows of which later steps read some columns only. The files go with the
    application, or by ``drop``. random: columns, by their Parquet path, of hashes, for which no dictionary is tried. rows: of a file at most, where one task
    writes what many read on (0: no limit)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.options(**{f"parquet.enable.dictionary#{c}": "false" for c in random}).option("maxRecordsPerFile", rows).parquet(path)
    return standing_table(spark, path, df.schema)


def standing_table(spark: SparkSession, path: str, schema) -> DataFrame:
    """A Parquet table of the shared folder that has been written, as ``written`` returns one."""
    _at(spark, path)[0].deleteOnExit(_at(spark, path)[1])
    out = spark.read.schema(schema).parquet(path)
    out._written_to = path
    _TABLES[path] = None
    return out


def _at(spark: SparkSession, path: str):
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(sc._jsc.hadoopConfiguration()), at


def standing(df: DataFrame) -> list[tuple]:
    """The files that ``df`` reads, with their sizes and times: equal while these are the same."""
    jvm, sc = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc
    out = []
    for path in sorted(df.inputFiles()):
        at = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(path))
        s = at.getFileSystem(sc.hadoopConfiguration()).getFileStatus(at)
        out.append((path, s.getLen(), s.getModificationTime()))
    return out


def stands(df: DataFrame) -> bool:
    """Whether the files of a table that ``written`` returned are still there."""
    files, at = _at(df.sparkSession, df._written_to)
    return df._written_to in _TABLES and files.exists(at)


def drop(df: DataFrame) -> None:
    """Deletes the files of a table that ``written`` returned and that nothing reads any more; of any other, nothing."""
    path = getattr(df, "_written_to", None)
    if path in _TABLES:
        del _TABLES[path]
        files, at = _at(df.sparkSession, path)
        files.delete(at, True)


def tables() -> frozenset[str]:
    """The tables that ``written`` has made and nothing has dropped."""
    return frozenset(_TABLES)


def drop_since(before: frozenset[str], keep: DataFrame) -> None:
    """Drops the tables made since ``before`` was taken, but for ``keep``: those that only its making read."""
    for path in tables() - before - {getattr(keep, "_written_to", None)}:
        del _TABLES[path]
        files, at = _at(keep.sparkSession, path)
        files.delete(at, True)


def sweep(spark: SparkSession) -> None:
    """Has the driver look for what nothing uses any more: only then does Spark delete shuffle files and checkpoints of steps
    that are over. For long jobs, between steps that need much disk."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()

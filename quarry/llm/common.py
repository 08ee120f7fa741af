"""Helpers that the operators share: scratch tables, words, Arrow batches."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whitespace that parts words: space and \t \n \v \f \r.  Everything else is part of a word.
WORD = r"[^\x20\x09-\x0D]+"
A_Z, A_Z_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_RUN = uuid.uuid4().hex[:12]


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Where it is unset (tests in one process) a temporary folder is made and set;
    on a cluster an unset folder is an error, since executors would not see it.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="quarry-"))
    return sc.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quarry-{_RUN}/{name}-{uuid.uuid4().hex[:10]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder: its lineage ends there, and lost executors lose nothing of it."""
    path = new_path(df.sparkSession, name)
    workers_find(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._quarry_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete a table made by written() that no plan reads any more."""
    path = getattr(df, "_quarry_path", None)
    if path:
        jvm, sc = df.sparkSession._jvm, df.sparkSession.sparkContext
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def workers_find(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it (a cluster that installs it elsewhere finds its own first)."""
    env, root = spark.sparkContext.environment, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    have = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in have:
        env["PYTHONPATH"] = os.pathsep.join([*have, root])


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Documents can be long: Arrow batches of few rows keep Python workers small."""
    workers_find(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def ascii_lower(column):
    """Lower-case A-Z only, inside the JVM."""
    return F.translate(column, A_Z, A_Z_LOWER)


def texts_of(batch, column: str = "text") -> list[str]:
    """A batch's texts, null as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    workers_find(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

"""Streams of facts: each micro-batch is one transaction.

Batches are written under their number, so one that runs again after a failure
replaces itself; the current value of an entity's attribute is the one of the
last batch.  ``current`` reads the folder as a database at any time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.database import TX0, Attr, Database


def start(stream: DataFrame, folder: str, trigger: dict | None = None):
    """Write a stream of facts (e, a, v string, added[, seq]) to ``folder``; returns the running query.

    seq orders the facts of one batch.  Without it, or where it ties, a batch retracts before it adds: one that
    retracts a value and adds another replaces it, and one that adds and retracts the same fact leaves it.
    """

    def put(batch: DataFrame, n: int) -> None:
        seq = F.col("seq").cast("bigint") if "seq" in batch.columns else F.lit(0).cast("bigint")
        batch.select("e", "a", "v", F.lit(TX0 + 1 + n).cast("bigint").alias("tx"), "added", seq.alias("seq")).write.mode("overwrite").partitionBy("a").parquet(f"{folder}/facts/batch={n}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{folder}/progress").trigger(**(trigger or {"availableNow": True})).start()


def current(spark: SparkSession, folder: str, schema: dict[str, Attr], types: dict[str, str]) -> Database:
    """The facts that hold now; types: attribute -> SQL type of its values.  Reads only the attributes' own folders."""
    rows = spark.read.schema("e long, v string, tx long, added boolean, seq long, batch long, a string").option("basePath", f"{folder}/facts").parquet(f"{folder}/facts")
    db = Database(spark, dict(schema))
    for a, t in types.items():
        many = schema.get(a, Attr()).many
        keys = ["e", "v"] if many else ["e"]
        order = F.struct("tx", F.coalesce("seq", F.lit(0)), "added", "v")
        last = rows.filter(F.col("a") == a).groupBy(*keys).agg(F.max_by(F.struct("v", "tx", "added"), order).alias("last"))
        now = last.filter("last.added").select("e", F.col("last.v").cast(t).alias("v"), F.col("last.tx").alias("tx"))
        db = db.with_relation(a, now)
    return db


def on_transact(connection, folder: str, spark: SparkSession) -> object:
    """A listener that appends a connection's facts as files a stream can read."""

    def write(report) -> None:
        rows = [(d.e, d.a, str(d.v), d.added, k) for k, d in enumerate(report.tx_data)]
        if rows:
            spark.createDataFrame(rows, "e long, a string, v string, added boolean, seq long").coalesce(1).write.mode("append").parquet(folder)

    return connection.listen(write)

"""Exact deduplication over a stream, with keyed state on disk that never expires.

Arrivals are a stream of (digest, doc_id, locator); the locator names the file
that holds the content.  A streaming aggregation keyed by digest holds, in
RocksDB, the digest, the identifier that stays (the largest), its locator and
how many have arrived; without a watermark no key expires.  Every micro-batch
writes the keys that it changed.  Digests that came more than once are hits: the
full bytes of their documents, and of no others, are read again and compared,
and should a digest hold unequal contents, those are told apart by the bytes
themselves.  All of it is DataFrame and SQL functions.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import ascii_lower, new_path, written

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": STORE,
    # a store's folder (RocksDB reserves 4 MB for its manifest alone) goes once the batch is committed to the shared folder
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}
#: Bits of the filter of hits, and what makes Spark use one however large the sides of the join are.
BLOOM = 1 << 26
PREFILTER = {
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1000t",
    "spark.sql.optimizer.runtime.bloomFilter.maxNumBits": str(BLOOM),
    "spark.sql.optimizer.runtime.bloomFilter.numBits": str(BLOOM),
    "spark.sql.optimizer.runtime.bloomFilter.expectedNumItems": "4000000",
    # a broadcast join would do without the filter, and only where hits are few
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
}


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Settings of the session for as long as the block runs."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def content(column="text"):
    """The content that is compared: A-Z lower-cased, null as empty."""
    return ascii_lower(F.coalesce(F.col(column), F.lit("")))


def arrivals(docs: DataFrame, digest_bits: int = 256) -> DataFrame:
    """digest, doc_id, locator of every row.  digest_bits below 256 keeps so many bits (whole hex digits): tests force collisions with it."""
    digest = F.sha2(content(), 256)
    short = digest if digest_bits >= 256 else F.substring(digest, 1, digest_bits // 4)
    return docs.select(short.alias("digest"), "doc_id", F.input_file_name().alias("locator"), digest.alias("text_sha256"))


def absorb(stream: DataFrame, state_dir: str, changes_dir: str) -> None:
    """Run the stream (digest, doc_id, locator) through the keyed state until no input is left.

    A second call with the same folders goes on from the state that the first one left.
    """
    with settings(stream.sparkSession, SETTINGS):
        state = stream.groupBy("digest").agg(F.max(F.struct("doc_id", "locator")).alias("keep"), F.count(F.lit(1)).alias("n"))

        def put(changed: DataFrame, batch: int) -> None:
            changed.write.mode("overwrite").parquet(f"{changes_dir}/batch={batch}")

        query = state.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", state_dir).trigger(availableNow=True).start()
        query.awaitTermination()


def kept_state(spark, changes_dir: str) -> DataFrame:
    """digest, keep (doc_id, locator), n: each key as the last micro-batch that changed it left it."""
    rows = spark.read.schema("digest string, keep struct<doc_id: long, locator: string>, n long, batch int").parquet(changes_dir)
    return rows.groupBy("digest").agg(F.max_by(F.struct("keep", "n"), "batch").alias("s")).select("digest", "s.keep", "s.n")


def exact_duplicates(docs: DataFrame, digest_bits: int = 256) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of docs (doc_id, text).

    Texts are equal when identical after lower-casing A-Z; null counts as empty, and empty texts
    are equal to each other.  The largest doc_id of a group stays.  Should rows repeat a doc_id with
    one text, each of these rows says kept and group_size counts them all.  Null doc_ids are below all
    others.  An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    came = written(arrivals(docs, digest_bits), "arrivals")
    root = new_path(spark, "exact")
    absorb(spark.readStream.schema(came.schema).parquet(came._quarry_path), f"{root}/state", f"{root}/changes")
    if not came.take(1):
        return spark.createDataFrame([], "doc_id long, keep_id long, group_size long, kept boolean, text_sha256 string")
    # written, so that the join reads two plain exchanges and a hot digest can be split
    state = written(kept_state(spark, f"{root}/changes"), "state")
    names = ["doc_id", "keep_id", "group_size", "text_sha256"]
    found = came.join(state, "digest").select("digest", "doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("n").alias("group_size"), "text_sha256")
    collided, contents = _collisions(docs, state.filter("n > 1").select("digest"), digest_bits)
    if collided.take(1):
        held = contents.join(collided, "digest", "left_semi").select(F.col("digest").alias("d"), F.col("content").alias("c"), F.col("keep").alias("keep_id"), F.col("size").alias("group_size"))
        rows = _contents(docs, digest_bits).join(collided, "digest", "left_semi")
        told = rows.join(held, (F.col("digest") == F.col("d")) & (F.col("content") == F.col("c"))).select("doc_id", "keep_id", "group_size", F.sha2("content", 256).alias("text_sha256"))
        found = found.join(collided, "digest", "left_anti").select(*names).unionByName(told)
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def _contents(docs: DataFrame, digest_bits: int) -> DataFrame:
    digest = F.sha2(content(), 256) if digest_bits >= 256 else F.substring(F.sha2(content(), 256), 1, digest_bits // 4)
    return docs.select("doc_id", digest.alias("digest"), content().alias("content"))


def _collisions(docs: DataFrame, hits: DataFrame, digest_bits: int) -> tuple[DataFrame, DataFrame]:
    """Digests that hold several contents, and the contents (digest, content, keep, size) under all hits.

    A Bloom filter of the hits' digests, of BLOOM bits at most whatever their number, is pushed to the scan, so that
    at any size hardly any bytes but those of hits leave it; the join is exact.  Copies meet map-side before anything
    is shuffled, so a hot group leaves a row a task.
    """
    contents = _contents(docs, digest_bits).groupBy("digest", "content").agg(F.max("doc_id").alias("keep"), F.count(F.lit(1)).alias("size"))
    contents = contents.join(hits, "digest", "left_semi")
    several = contents.groupBy("digest").agg(F.count(F.lit(1)).alias("contents")).filter("contents > 1").select("digest")
    with settings(docs.sparkSession, PREFILTER):
        return written(several, "collided"), contents


def drop_exact_duplicates(docs: DataFrame, digest_bits: int = 256) -> DataFrame:
    """The rows of docs that stay, with docs' own columns; of rows that repeat a kept doc_id with one text all stay.

    A doc_id that repeats with other texts stays only with those that it is kept for.
    """
    # what goes is joined, not what stays: a written table of as many rows as there are copies.  It grows with docs, so
    # the join is a merge join at every size
    gone = exact_duplicates(docs, digest_bits).filter("not kept").select(F.col("doc_id").alias("__quarry_id"), F.col("text_sha256").alias("__quarry_digest")).distinct()
    gone = written(gone, "gone").hint("merge")
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("__quarry_id")) & (F.sha2(content(), 256) == F.col("__quarry_digest")), "left_anti")

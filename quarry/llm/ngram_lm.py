"""Quality by an interpolated modified Kneser-Ney model of symbols.

The model predicts each character of a text, and its end, from the ``ORDER - 1``
characters before.  It is trained on all trusted rows, whatever their number.
Texts are packed into chunks once (compressed, bucketed by chunk so that later
joins do not move them).  A chunk's distinct n-grams, dealt into shards and kept
sorted as compressed differences, are what joins the count tables.  A shard
answers with the probabilities alone, in the same order; back at their chunk they
meet the n-grams again, and every whole document is scored.  A document is kept if
its perplexity is not above a quantile of the trusted documents' in its language.
"""

from __future__ import annotations

import json
from itertools import pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import new_path, small_batches, written

ORDER = 4
#: Characters in a chunk, about.
CHUNK = 4_000_000
#: Shards of n-grams; with more partitions than that, chunks are salted, and each salt has a copy of the shards' tables.
SHARDS, SHARD_PRIME, SHARD_MASK = 256, 1_000_003, (1 << 63) - 1
#: Rows of an Arrow batch of n-grams, and n-grams gathered before they are made distinct.
BATCH, GATHER = 4096, 1_000_000
#: A symbol has 16 bits: 0 before the start, 1 the end, then every code point below U+D800 and those from U+E000 to U+FFFF
#: for itself; in the room that surrogates leave, the rest (emoji, rare ideographs) share 2,046 classes.
BITS, START, END, GAP, GAP_END, CLASSES = 16, 0, 1, 0xD800, 0xE000, 2046
#: A trusted document's language quantile above which documents go.
QUANTILE = 0.995
#: Steps of a nat of log perplexity in which quantiles are counted.
STEPS = 1000


def symbols(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    low, high = c < GAP, (c >= GAP_END) & (c < 0x10000)
    return np.where(low, c + 2, np.where(high, c, GAP + 2 + c % CLASSES)).astype(np.uint64)


def grams(texts: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each symbol (and at each end), of all texts in turn, and how many each text has."""
    lead, end = np.full(order - 1, START, np.uint64), np.array([END], np.uint64)
    parts = []
    for t in texts:
        parts += [lead, symbols(t), end]
    row = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    n = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    if not len(row):
        return row.astype(np.int64), n
    code = np.zeros(len(row) - order + 1, np.uint64)
    for k in range(order):
        code = code << np.uint64(BITS) | row[k : len(row) - order + 1 + k]
    return code[row[order - 1 :] != START].view(np.int64), n


def _pack(data: bytes, level: int = 3) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(data)


def _unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def chunks(docs: DataFrame) -> tuple[DataFrame, str]:
    """chunk, ids (doc_ids), content (compressed langs and texts) of all rows, as a table bucketed by chunk in the shared folder, and its name in the catalog."""
    spark = docs.sparkSession
    small_batches(spark)

    def run(batches):
        first = TaskContext.get().partitionId() << 24
        group: tuple[list, list, list] = ([], [], [])
        size = n = 0

        def packed():
            ids, *rest = group
            columns = [pa.array([first + n]), pa.array([ids], type=pa.list_(pa.int64())), pa.array([_pack(json.dumps(rest).encode(), 9)], type=pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["chunk", "ids", "content"])

        for b in batches:
            for row in zip(b.column("doc_id").to_pylist(), b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                for to, x in zip(group, (row[0], row[1] or "", row[2] or ""), strict=True):
                    to.append(x)
                size += len(row[2] or "") + 1
                if size >= CHUNK:
                    yield packed()
                    group, size, n = ([], [], []), 0, n + 1
        if group[0]:
            yield packed()

    name = new_path(spark, "chunks")
    table = "quarry_" + name.rsplit("-", 1)[1]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text").mapInArrow(run, "chunk long, ids array<long>, content binary")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.write.bucketBy(buckets, "chunk").option("path", name).saveAsTable(table)
    return spark.table(table), table


def _open(content: bytes) -> tuple[list, list]:
    langs, texts = json.loads(_unpack(content))
    return langs, texts


def _train_counts(table: DataFrame, trusted: DataFrame) -> DataFrame:
    """code, c: how often each n-gram stands in trusted rows."""
    places = table.select("chunk", F.explode("ids").alias("doc_id")).join(trusted, "doc_id", "left_semi")
    wanted = places.groupBy("chunk").agg(F.collect_list("doc_id").alias("wanted"))  # at most a chunk's own rows

    def run(batches):
        for b in batches:
            for content, doc_ids, wanted_ids in zip(*(b.column(x).to_pylist() for x in ("content", "ids", "wanted")), strict=True):
                _, texts = _open(content)
                want = set(wanted_ids)
                code, n = np.unique(grams([t for i, t in zip(doc_ids, texts, strict=True) if i in want])[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n.astype(np.int64))], names=["code", "c"])

    return table.join(wanted, "chunk").select("content", "ids", "wanted").mapInArrow(run, "code long, c long").groupBy("code").agg(F.sum("c").alias("c"))


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney's discounts from how many n-grams have counts 1 to 4; plain ones where a count is missing."""
    if min(n1, n2, n3, n4) <= 0:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.05), k + 0.95) for k, d in enumerate(raw))  # type: ignore[return-value]


def count_tables(counts: DataFrame, order: int = ORDER) -> list[tuple[DataFrame, DataFrame]]:
    """For each order from 1: (code, lead) with lead the discounted share, and (context, gamma) with the weight left for the order below.

    The highest order counts occurrences, lower ones distinct symbols to the left.
    """
    out = []
    table = written(counts, "counts")
    for k in range(order, 0, -1):
        if k < order:
            below = F.col("code").bitwiseAND(F.lit((1 << (BITS * k)) - 1).cast("long"))
            table = written(table.select(below.alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("c")), "counts")
        n = table.filter("c <= 4").groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()  # four rows at most
        n = {r.c: r.n for r in n}
        d1, d2, d3 = discounts(*(n.get(i, 0) for i in (1, 2, 3, 4)))
        context = F.shiftrightunsigned("code", BITS).alias("context")
        one = lambda i: F.sum((F.col("c") == i).cast("long")) if i < 3 else F.sum((F.col("c") >= 3).cast("long"))
        gamma = table.groupBy(context).agg(F.sum("c").alias("total"), ((d1 * one(1) + d2 * one(2) + d3 * one(3)) / F.sum("c")).alias("gamma"))
        cut = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        lead = table.withColumn("context", context).join(gamma, "context").select("code", (F.greatest(F.col("c") - cut, F.lit(0.0)) / F.col("total")).alias("lead"))
        out.append((lead, gamma.select("context", "gamma")))
    return out[::-1]


def probabilities(codes: DataFrame, tables: list[tuple[DataFrame, DataFrame]], vocabulary: int) -> DataFrame:
    """code, logp for distinct codes: p_k = lead_k + gamma_k p_(k-1); an unseen context passes the order below on, and below all stands 1 / vocabulary."""
    now = codes.select("code").withColumn("p", F.lit(1.0 / vocabulary))
    for k, (lead, gamma) in enumerate(tables, 1):
        part = F.col("code") if k * BITS >= 64 else F.col("code").bitwiseAND(F.lit((1 << (BITS * k)) - 1).cast("long"))
        now = now.withColumn("part", part).join(lead.withColumnRenamed("code", "part"), "part", "left")
        now = now.withColumn("context", F.shiftrightunsigned("part", BITS)).join(gamma, "context", "left")
        now = now.select("code", (F.coalesce("lead", F.lit(0.0)) + F.coalesce("gamma", F.lit(1.0)) * F.col("p")).alias("p"))
    return now.select("code", F.log("p").alias("logp"))


def _by_shard(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of sorted distinct codes by shard, and where each shard starts and ends in it."""
    shard = (code & SHARD_MASK) % SHARD_PRIME % SHARDS
    return np.argsort(shard, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(shard, minlength=SHARDS))])


def _cells(table: DataFrame) -> DataFrame:
    """chunk, shard, codes (the compressed differences of its sorted distinct n-grams)."""

    def run(batches):
        for b in batches:
            for chunk, content in zip(b.column("chunk").to_pylist(), b.column("content").to_pylist(), strict=True):
                code = np.unique(grams(_open(content)[1])[0])
                order, ends = _by_shard(code)
                code = code[order]
                full = np.flatnonzero(np.diff(ends))
                blobs = [_pack(np.diff(code[ends[k] : ends[k + 1]], prepend=0).tobytes()) for k in full]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(full), chunk)), pa.array(full.astype(np.int32)), pa.array(blobs, type=pa.binary())], names=["chunk", "shard", "codes"])

    return table.select("chunk", "content").mapInArrow(run, "chunk long, shard int, codes binary")


def _codes(blob: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(_unpack(blob), dtype=np.int64))


def _distinct(cells: DataFrame) -> DataFrame:
    """code: all n-grams of the cells, once each."""

    def run(batches):
        parts, size = [], 0
        for b in batches:
            parts += [_codes(x) for x in b.column("codes").to_pylist()]
            size = sum(map(len, parts))
            if size >= GATHER:
                parts = [np.unique(np.concatenate(parts))]
                if len(parts[0]) >= GATHER // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(parts[0])], names=["code"])
                    parts = []
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(parts)))], names=["code"])

    return cells.select("codes").mapInArrow(run, "code long").distinct()


def _look_up(cells: DataFrame, logp: DataFrame) -> DataFrame:
    """chunk, shard, logs: for each cell the log probabilities of its codes, in their order, as compressed 32-bit floats."""
    partitions = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salts = max(1, partitions // SHARDS)
    shard = ((F.col("code").bitwiseAND(F.lit(SHARD_MASK)) % SHARD_PRIME) % SHARDS).cast("int").alias("shard")
    model = logp.select(shard, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("chunk"), "code", F.col("logp").cast("float").alias("logp"), F.lit(None).cast("binary").alias("codes"))
    asked = cells.select("shard", F.pmod(F.xxhash64("chunk"), F.lit(salts)).cast("int").alias("salt"), F.lit(1).alias("kind"), "chunk", F.lit(0).cast("long").alias("code"), F.lit(0).cast("float").alias("logp"), "codes")

    def run(batches):
        now, have, logs = None, [], []
        for b in batches:
            shard, salt, kind, chunk, code, value = (b.column(x).to_numpy() for x in ("shard", "salt", "kind", "chunk", "code", "logp"))
            group = salt.astype(np.int64) * SHARDS + shard
            cuts = [0, *(np.flatnonzero(np.diff(group * 2 + kind)) + 1).tolist(), b.num_rows]
            for a, z in pairwise(cuts):
                if a == z:
                    continue
                if group[a] != now:
                    now, have, logs = group[a], [], []
                if not kind[a]:
                    have.append(code[a:z])
                    logs.append(value[a:z])
                    continue
                have, logs = [np.concatenate(have)], [np.concatenate(logs)]
                out = [_pack(logs[0][np.searchsorted(have[0], _codes(x))].tobytes()) for x in b.column("codes").slice(a, z - a).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(chunk[a:z]), pa.array(shard[a:z]), pa.array(out, type=pa.binary())], names=["chunk", "shard", "logs"])

    dealt = model.unionByName(asked).repartition(partitions, "shard", "salt").sortWithinPartitions("shard", "salt", "kind", "code")
    return dealt.mapInArrow(run, "chunk long, shard int, logs binary")


def perplexities(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """doc_id, lang, n_symbols, perplexity of every row of docs (doc_id, lang, text), by a model of the rows whose doc_id is in trusted (doc_id).

    n_symbols counts characters; a text's end is predicted too, so an empty or null text has a
    perplexity as well.  A null lang is ''.  Without trusted rows every symbol has probability 1 / 65536.
    """
    spark = docs.sparkSession
    table, name = chunks(docs)
    small_batches(spark, 2)
    counts = _train_counts(table, trusted.select("doc_id").filter("doc_id is not null").distinct())
    tables = count_tables(counts)
    cells = written(_cells(table), "cells")
    small_batches(spark, BATCH)
    logp = written(probabilities(_distinct(cells), tables, 1 << BITS), "logp")
    answers = written(_look_up(cells, logp), "answers")
    small_batches(spark, 2)
    back = answers.groupBy("chunk").agg(F.collect_list(F.struct("shard", "logs")).alias("answers"))  # at most a chunk's own n-grams

    def run(batches):
        names = ["doc_id", "lang", "n_symbols", "perplexity"]
        for b in batches:
            for ids, content, found in zip(*(b.column(x).to_pylist() for x in ("ids", "content", "answers")), strict=True):
                langs, texts = _open(content)
                code, n = grams(texts)
                code, place = np.unique(code, return_inverse=True)
                logs = np.empty(len(code))
                logs[_by_shard(code)[0]] = np.concatenate([np.frombuffer(_unpack(x["logs"]), dtype=np.float32) for x in sorted(found, key=lambda x: x["shard"])])
                sums = np.add.reduceat(logs[place], np.concatenate([[0], np.cumsum(n)[:-1]]))
                yield pa.RecordBatch.from_arrays([pa.array(ids, type=pa.int64()), pa.array(langs, type=pa.string()), pa.array(n - 1), pa.array(np.exp(-sums / n))], names=names)

    scored = written(table.join(back, "chunk").select("ids", "content", "answers").mapInArrow(run, "doc_id long, lang string, n_symbols long, perplexity double"), "scored")
    spark.sql(f"DROP TABLE IF EXISTS {name}")  # from the catalog; its files are scratch
    return scored


def thresholds(scored: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """lang, threshold: the smallest step of log perplexity that a share ``quantile`` of the rows does not exceed; a null lang: over all rows."""
    step = F.ceil(F.log("perplexity") * STEPS).alias("step")
    bins = scored.groupBy("lang", step).agg(F.count(F.lit(1)).alias("n"))
    bins = bins.withColumn("lang", F.explode(F.array("lang", F.lit(None)))).groupBy("lang", "step").agg(F.sum("n").alias("n"))
    upto = Window.partitionBy("lang").orderBy("step")
    ranked = bins.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(Window.partitionBy("lang")))
    return ranked.filter(F.col("upto") >= quantile * F.col("all")).groupBy("lang").agg(F.exp(F.min("step") / STEPS).alias("threshold"))


def judge(docs: DataFrame, trusted: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """doc_id, lang, n_symbols, perplexity, threshold, kept of every row.

    Languages without trusted rows take the threshold over all; without any trusted row all is kept.
    A text without a character is not kept.
    """
    scored = perplexities(docs, trusted)
    known = trusted.select("doc_id").distinct()
    limits = written(thresholds(scored.join(known, "doc_id", "left_semi"), quantile), "limits")
    every = limits.filter("lang is null").select("threshold").take(1)
    rest = F.lit(every[0].threshold if every else float("inf"))
    out = scored.join(limits.filter("lang is not null"), "lang", "left").withColumn("threshold", F.coalesce("threshold", rest))
    return out.select("doc_id", "lang", "n_symbols", "perplexity", "threshold", ((F.col("perplexity") <= F.col("threshold")) & (F.col("n_symbols") > 0)).alias("kept"))

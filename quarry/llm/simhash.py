"""SimHash near-duplicates with pivot distance tables.

A document's fingerprint has a bit set where over half the hashes of its
shingles have it.  Equal fingerprints are one node, represented by the smallest
doc_id.  Fingerprints within ``RADIUS`` bits agree on some ``BANDS - RADIUS``
of ``BANDS`` bands, so each is filed once under every such choice of bands and
only members of one block are compared: no pair within the radius is missed.

Every distinct fingerprint's row of the pivot table, its Hamming distances to the
reference fingerprints, is computed once and travels with it.  By the triangle
inequality a pair is out of reach if any coordinate of the two rows differs by
more than the radius; members of a block are walked in the order of one
coordinate, every pair is judged by the largest coordinate difference, and what
survives is verified bit by bit.  Of the
verified links a block gives a spanning forest (linear in its members), never
all pairs.  Blocks above ``TILE`` members are cut into tiles of two chunks, so a
hot block is spread over many tasks and no task holds more than a tile.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import small_batches, texts_of, written
from quarry.llm.components import connected_components

BITS, RADIUS, SHINGLE, SEED = 64, 3, 3, 42
#: Members of a block that are compared in one piece.
TILE = 1024
N_PIVOTS = 16


def pivots(n: int = N_PIVOTS, seed: int = 7) -> np.ndarray:
    """Reference fingerprints: random ones lie near half the bits from anything and spread its distances most."""
    return np.random.default_rng(seed).integers(0, 2**64, size=n, dtype=np.uint64)


def fingerprint(text: str, width: int = SHINGLE) -> int:
    """A-Z lower-cased, words between ASCII white space, shingles of ``width`` words joined by a space, XXH64 of each.

    Fewer words than ``width``: the whole sequence is the only shingle; no word: 0.
    """
    words = text.encode().lower().split()
    if not words:
        return 0
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], SEED) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)]
    h = np.array(hashes, dtype=np.uint64)
    counts = np.zeros(BITS, dtype=np.int64)
    for k in range(0, len(h), 1 << 15):
        part = np.unpackbits(h[k : k + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += part.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, fp (long, the 64 bits) of every row; a null text has no words and so fingerprint 0."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, width) for t in texts_of(b)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(fp, type=pa.int64())], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def band_masks(n: int, radius: int = RADIUS) -> list[int]:
    """Masks of the bits that a block's members share, for n fingerprints: so many bands that random blocks stay small.

    With b bands any two fingerprints within the radius agree on b - radius of them.  More bands mean
    longer keys and more masks; the fewest that give keys of log2(n) + 2 bits are taken.
    """
    for bands in range(radius + 1, radius + 9):
        edges = [round(k * BITS / bands) for k in range(bands + 1)]
        parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
        masks = [sum(c) for c in combinations(parts, bands - radius)]
        if min(m.bit_count() for m in masks) >= math.log2(max(n, 2)) + 2:
            break
    return masks


def _forest(fps: np.ndarray, split: int, table: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links (numbers of members) that span what the verified pairs connect.

    split: 0, or pairs are only between members before and from this number on.
    """
    n = len(fps)
    rows = table
    if n == 2:
        return [(0, 1)] if np.abs(rows[0] - rows[1]).max() <= radius and int(fps[0] ^ fps[1]).bit_count() <= radius else []
    left = np.argsort(rows[:, 0], kind="stable")
    first = np.arange(n) < split
    found: list[tuple[int, int]] = []
    while len(left):
        reached, left = [int(left[0])], left[1:]
        while reached and len(left):
            i = reached.pop()
            a, b = np.searchsorted(rows[left, 0], [rows[i, 0] - radius, rows[i, 0] + radius + 1])
            js = left[a:b]
            near = np.abs(rows[js] - rows[i]).max(axis=1, initial=0) <= radius
            near[near] = np.bitwise_count(fps[js[near]] ^ fps[i]) <= radius
            if split:
                near &= first[js] != first[i]
            new = js[near].tolist()
            found += [(i, j) for j in new]
            reached += new
            left = np.concatenate([left[:a], js[~near], left[b:]])
    return found


def pivot_table(nodes: DataFrame, n_pivots: int = N_PIVOTS) -> DataFrame:
    """nodes with ``row``: a byte a pivot, the fingerprint's distance to it."""
    refs = [int(x) - (1 << 64) if int(x) >> 63 else int(x) for x in pivots(n_pivots)]
    one = lambda r: F.lpad(F.hex(F.bit_count(F.col("fp").bitwiseXOR(F.lit(r).cast("long"))).cast("long")), 2, "0")
    return nodes.withColumn("row", F.unhex(F.concat(*[one(r) for r in refs])))


def links(nodes: DataFrame, n: int, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """nodes: fp, node (both unique).  Returns u, v: links that connect whatever pairs within the radius connect."""
    spark = nodes.sparkSession
    keyed = pivot_table(nodes).withColumn("mask", F.explode(F.array(*[F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in band_masks(n, radius)])))
    keyed = keyed.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp", "node", "row")
    sizes = keyed.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    # written, so that the join below reads two plain exchanges and a hot block can be split
    sizes = written(sizes, "sizes")
    filed = keyed.join(sizes, ["mask", "key"]).withColumn("chunks", F.ceil(F.col("size") / tile).cast("int"))
    chunk = F.pmod(F.xxhash64("fp", "mask"), F.col("chunks")).cast("int")
    filed = filed.withColumn("chunk", chunk).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    filed = filed.select(
        F.struct("mask", "key", F.least("chunk", "other").alias("a"), F.greatest("chunk", "other").alias("b")).alias("tile"),
        F.struct((F.col("chunk") > F.least("chunk", "other")).alias("second"), "fp", "node", "row").alias("member"),
    )
    tiles = filed.groupBy("tile").agg(F.sort_array(F.collect_list("member")).alias("members")).filter("size(members) > 1")
    tiles = tiles.select((F.col("tile.a") < F.col("tile.b")).alias("two"), "members")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 256)

    def run(batches):
        for batch in batches:
            us: list[int] = []
            vs: list[int] = []
            two = batch.column("two").to_pylist()
            members = batch.column("members")
            ends = members.offsets.to_numpy()
            flat = members.values
            second = np.asarray(flat.field("second").to_numpy(zero_copy_only=False), dtype=bool)
            fp = flat.field("fp").to_numpy().view(np.uint64)
            node = flat.field("node").to_numpy()
            rows = np.frombuffer(b"".join(flat.field("row").to_pylist()), dtype=np.uint8).reshape(len(node), -1).astype(np.int16)
            for k, pair in enumerate(two):
                a, b = int(ends[k]), int(ends[k + 1])
                split = int((~second[a:b]).sum()) if pair else 0
                if pair and split in (0, b - a):
                    continue
                for i, j in _forest(fp[a:b], split, rows[a:b], radius):
                    us.append(int(node[a + i]))
                    vs.append(int(node[a + j]))
            yield pa.RecordBatch.from_arrays([pa.array(us, type=pa.int64()), pa.array(vs, type=pa.int64())], names=["u", "v"])

    return tiles.mapInArrow(run, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, width: int = SHINGLE, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """doc_id, fp, node (smallest doc_id of equal fingerprints), component_id of every row of docs (doc_id, text).

    component_id is the smallest doc_id reachable over links of at most ``radius`` differing bits, the
    document itself included.  Rows that repeat a doc_id keep their own fingerprints; null and empty
    texts have fingerprint 0 and link like others; an empty table gives no rows.  Rows without doc_id have
    a fingerprint, but link nothing: their component_id is null.
    """
    prints = written(fingerprints(docs, width), "prints")
    nodes = written(prints.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    found = connected_components(links(nodes, nodes.count(), radius, tile))
    classes = nodes.join(found, "node", "left").select("fp", "node", F.coalesce("component", "node").alias("component_id"))
    component = F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    return prints.join(classes, "fp", "left").select("doc_id", "fp", "node", component)


def drop_near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """Of every component the smallest doc_id stays; all columns of docs are returned as they are.

    Rows that repeat a doc_id stay if any of them represents its component, and rows without doc_id stay.
    """
    found = near_duplicates(docs, **how).groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("stays"))
    gone = found.filter("not stays").select(F.col("doc_id").alias("__quarry_id"))
    return docs.join(gone, F.col("doc_id") == F.col("__quarry_id"), "left_anti")

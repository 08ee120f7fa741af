"""Repeated passages by a sparse suffix array.

Of the suffixes (starting at words) only those at minimiser positions are kept:
where the digest of the first ``HEAD`` words is the least among ``MIN_WORDS -
HEAD + 1`` neighbours.  The choice depends on the words alone, so a passage of
``MIN_WORDS`` words keeps the same suffix wherever it stands.

Suffixes are sorted, over all partitions, by their heads and then by all words
that any passage of ``MIN_WORDS`` round the head can reach (by digests; letters'
order would add nothing, since only equality with a neighbour counts).  Each one
is compared with its neighbours: whose head no neighbour shares, goes.  A match
is then extended to the left and the right.  Members whose whole surroundings
agree are one class, and all but the first repeat it.  Between the firsts of
different classes the extension goes word by word: every window of ``MIN_WORDS``
whose least head this is, is compared by a 128-bit digest, and what a first
learns is passed on to its class by offset.  The result is exact: a word is
marked if and only if it lies in a window of ``MIN_WORDS`` words that also stands
earlier (by doc_id, then place), and the source of a window is the earliest
document that holds it.

A row is known by its doc_id and a digest of its text (``tk``): rows that repeat
an id with other texts are places of their own, equal rows are one place.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import WORD, small_batches, texts_of, written

#: Words of the shortest passage, and of a suffix's head.
MIN_WORDS, HEAD = 50, 20

_M = (1 << 64) - 1
_BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
_WORDS = re.compile(WORD)


class _Hashes(dict):
    """128 bits of a word: two hashes that agree by chance independently."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) > 300_000:
            self.clear()
        h = self[word] = xxhash.xxh3_128_digest(word, 11)
        return h


_HASHES = _Hashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA3AAAAC4B9E2F5B7)
    return x ^ (x >> np.uint64(32))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2^64, as far as they were needed."""

    def __init__(self, base: int):
        self.base, self.n = base, 0
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 2 * self.n, 4096)
            run = lambda b: np.cumprod(np.concatenate([[np.uint64(1)], np.full(self.n, np.uint64(b), dtype=np.uint64)]), dtype=np.uint64)
            self.up, self.down = run(self.base), run(pow(self.base, -1, 1 << 64))
        return self.up, self.down


_POWERS = [_Powers(b) for b in _BASES]


class Words:
    """Digests of any stretch of a text's words, from running sums."""

    def __init__(self, text: str):
        words = text.encode().split()
        self.n = len(words)
        h = np.frombuffer(b"".join(map(_HASHES.__getitem__, words)), dtype="<u8").reshape(self.n, 2)
        self.sums = []
        for k, powers in enumerate(_POWERS):
            _, down = powers.upto(self.n)
            self.sums.append(np.concatenate([[np.uint64(0)], np.cumsum(h[:, k] * down[: self.n], dtype=np.uint64)]))

    def digest(self, k: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        up, _ = _POWERS[k].upto(self.n)
        return _mix((self.sums[k][end] - self.sums[k][start]) * up[start] + (end - start).astype(np.uint64))


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over every run of ``width`` neighbours."""
    have = 1
    while 2 * have <= width:
        x = pick(x[:-have], x[have:])
        have *= 2
    if have < width:
        x = pick(x[: len(x) - (width - have)], x[width - have :])
    return x


def minimisers(words: Words, min_words: int = MIN_WORDS, head: int = HEAD) -> tuple[np.ndarray, np.ndarray]:
    """Places of the suffixes that are kept, and the digests of their heads; none in texts below ``min_words`` words."""
    if words.n < min_words:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    start = np.arange(words.n - head + 1)
    key = words.digest(0, start, start + head)
    width = min_words - head + 1
    least = _slide(key, width, np.minimum)
    pad = np.zeros(width - 1, dtype=np.uint64)
    kept = np.nonzero(_slide(np.concatenate([pad, least, pad]), width, np.maximum) == key)[0]
    return kept, key[kept]


#: What orders suffixes: the head, all round it, then the place.
ORDER = ("key", "a", "b", "before", "after", "doc_id", "tk", "pos")
SUFFIX = "key long, a long, b long, before short, after short, doc_id long, tk long, pos int"
_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int16(), pa.int16(), pa.int64(), pa.int64(), pa.int32()]


def _named(docs: DataFrame) -> DataFrame:
    """doc_id, tk, text of the rows that take part."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tk"), "text").filter("doc_id is not null and text is not null")


def suffixes(docs: DataFrame, min_words: int = MIN_WORDS, head: int = HEAD) -> DataFrame:
    """key (of the head), a, b (128 bits of the surroundings), before, after (their words), doc_id, tk, pos of each kept suffix."""
    small_batches(docs.sparkSession)
    reach = min_words - head

    def run(batches):
        for batch in batches:
            counts, parts = [], []
            for text in texts_of(batch):
                words = Words(text)
                pos, key = minimisers(words, min_words, head)
                counts.append(len(pos))
                if len(pos):
                    left, right = np.maximum(pos - reach, 0), np.minimum(pos + min_words, words.n)
                    parts.append((key.view(np.int64), words.digest(0, left, right).view(np.int64), words.digest(1, left, right).view(np.int64), pos - left, right - pos, pos))
            if parts:
                key, a, b, before, after, pos = (np.concatenate(c) for c in zip(*parts, strict=True))
                doc_id, tk = (np.repeat(batch.column(x).to_numpy(), counts) for x in ("doc_id", "tk"))
                cols = (key, a, b, before, after, doc_id, tk, pos)
                yield pa.RecordBatch.from_arrays([pa.array(c).cast(k) for c, k in zip(cols, _KINDS, strict=True)], names=list(ORDER))

    return _named(docs).mapInArrow(run, SUFFIX)


def with_neighbours(sorted_suffixes: DataFrame) -> DataFrame:
    """Of sorted suffixes those whose head a neighbour shares, once each, and the two at the ends of every range.

    Equal rows stand in one range, so a place that came twice is seen and goes.  A head that two ranges share
    stands at their ends.
    """

    def run(batches):
        held = None  # the last row so far, and whether its head is shared with the one before it
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(n).to_numpy() for n in ORDER]
            if held is not None:
                cols = [np.concatenate([h, c]) for h, c in zip(held[0], cols, strict=True)]
            new = np.ones(len(cols[0]), dtype=bool)
            new[1:] = False
            for c in cols:
                new[1:] |= c[1:] != c[:-1]
            cols = [c[new] for c in cols]
            like = cols[0][1:] == cols[0][:-1]
            shared = np.zeros(len(cols[0]), dtype=bool)
            shared[1:] |= like
            shared[:-1] |= like
            shared[0] |= held is None or held[1]
            held = ([c[-1:] for c in cols], bool(shared[-1]))
            keep = shared[:-1]
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(c[:-1][keep]).cast(k) for c, k in zip(cols, _KINDS, strict=True)], names=list(ORDER))
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(c).cast(k) for c, k in zip(held[0], _KINDS, strict=True)], names=list(ORDER))

    return sorted_suffixes.select(*ORDER).mapInArrow(run, SUFFIX)


def _windows(docs: DataFrame, firsts: DataFrame, min_words: int, head: int) -> DataFrame:
    """a, b (128 bits), doc_id, tk, start, pos, several of each window of ``min_words`` in which a suffix of firsts (doc_id, tk, pos, several) has the least head."""
    reach = min_words - head
    wanted = firsts.groupBy("doc_id", "tk").agg(F.collect_list(F.struct("pos", "several")).alias("places"))  # at most a document's own suffixes
    # wanted grows with docs: a merge join at every size
    rows = _named(docs).join(wanted.hint("merge"), ["doc_id", "tk"])
    small_batches(docs.sparkSession)
    names = ["a", "b", "doc_id", "tk", "start", "pos", "several"]

    def run(batches):
        for batch in batches:
            counts, parts = [], []
            lists = batch.column("places")
            ends = lists.offsets.to_numpy()
            all_pos, all_several = (lists.values.field(x).to_numpy(zero_copy_only=False) for x in ("pos", "several"))
            for k, text in enumerate(texts_of(batch)):
                words = Words(text)
                one = slice(int(ends[k]), int(ends[k + 1]))
                pos, several = all_pos[one].astype(np.int64), all_several[one]
                at = np.arange(words.n - head + 1)
                key = words.digest(0, at, at + head)
                least = _slide(key, reach + 1, np.minimum)
                start = pos[:, None] - np.arange(reach + 1)[None, :]
                inside = (start >= 0) & (start < len(least))
                own = inside & (least[np.where(inside, start, 0)] == key[pos][:, None])
                which = np.nonzero(own)[0]
                start = start[own]
                counts.append(len(start))
                parts.append((words.digest(0, start, start + min_words).view(np.int64), words.digest(1, start, start + min_words).view(np.int64), start, pos[which], several[which]))
            if parts:
                a, b, start, pos, several = (np.concatenate(c) for c in zip(*parts, strict=True))
                doc_id, tk = (np.repeat(batch.column(x).to_numpy(), counts) for x in ("doc_id", "tk"))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(doc_id), pa.array(tk), pa.array(start).cast(pa.int32()), pa.array(pos).cast(pa.int32()), pa.array(several)], names=names)

    return rows.mapInArrow(run, "a long, b long, doc_id long, tk long, start int, pos int, several boolean")


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS, head: int = HEAD) -> DataFrame:
    """doc_id, tk, spans: of each document with repeated passages, the words (start, end) to remove and the documents that hold them earlier.

    docs: doc_id, text.  The first occurrence (smallest doc_id, then text and place) of a passage is no span.
    Null and short texts have none; a null doc_id takes no part; equal rows count as one place, so a row does not
    make itself a repeat; rows that repeat a doc_id with other texts are told apart by tk.  Repeats inside one
    document count.
    """
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    kept = written(suffixes(docs, min_words, head), "suffixes")
    small_batches(spark, 100_000)
    dealt = kept.repartitionByRange(parts, *ORDER).sortWithinPartitions(*ORDER)
    near = written(with_neighbours(dealt), "near")
    # groups have keys of their own (structs), so a hot head can be split
    kind, place = F.struct("key", "a", "b", "before", "after"), F.struct("doc_id", "tk", "pos")
    classes = written(near.groupBy(kind.alias("kind")).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")), "classes")
    mixed = written(classes.groupBy(F.col("kind.key").alias("key")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"), "mixed")
    firsts = classes.select(F.col("kind.key").alias("key"), "first.doc_id", "first.tk", "first.pos", (F.col("n") > 1).alias("several")).join(mixed, "key", "left_semi")
    windows = written(_windows(docs, firsts.drop("key"), min_words, head), "windows")
    window = F.struct("a", "b")
    least = windows.groupBy(window.alias("window")).agg(F.min(F.struct("doc_id", "tk", "start")).alias("source"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("window", "source")
    least = written(least, "least")
    told = windows.select(window.alias("window"), F.struct("doc_id", "tk", "start").alias("own"), "pos", "several").join(least, "window", "left").drop("window")
    told = written(told.filter("several or own <> source"), "told")
    start = F.col("own.start")
    apart = told.filter("own <> source").select("own.doc_id", "own.tk", start.alias("start"), (start + min_words).alias("end"), F.col("source.doc_id").alias("source"))

    # what the other members of a class repeat, as offsets from the suffix: all round it from the first, where the head has
    # one class; else what the first's windows were told (all windows of a least head repeat together, so ends are enough)
    groups = classes.filter("n > 1").withColumn("key", F.col("kind.key"))
    alone = groups.join(mixed, "key", "left_anti").filter("kind.before + kind.after >= " + str(min_words))
    alone = alone.select("kind", "first", (-F.col("kind.before")).cast("int").alias("lo"), F.col("kind.after").cast("int").alias("hi"), F.col("first.doc_id").alias("source"))
    offset = start - F.col("pos")
    first = F.struct(F.col("own.doc_id").alias("doc_id"), F.col("own.tk").alias("tk"), F.col("pos"))
    runs = told.filter("several").groupBy(first.alias("first"), F.coalesce("source.doc_id", "own.doc_id").alias("source")).agg(F.min(offset).alias("lo"), (F.max(offset) + min_words).alias("hi"))
    passed = groups.join(mixed, "key", "left_semi").select("kind", "first").join(runs, "first")
    held = written(alone.unionByName(passed.select("kind", "first", "lo", "hi", "source")), "held")
    whole = near.select(kind.alias("kind"), place.alias("own")).join(held, "kind").filter("own <> first")
    whole = whole.select("own.doc_id", "own.tk", (F.col("own.pos") + F.col("lo")).alias("start"), (F.col("own.pos") + F.col("hi")).alias("end"), "source")

    parts_ = whole.unionByName(apart).groupBy("doc_id", "tk").agg(F.collect_set(F.struct("start", "end", "source")).alias("parts"))  # of one text
    small_batches(spark)
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("sources", pa.list_(pa.int64()))]))

    def merge(batches):
        for batch in batches:
            lists = batch.column("parts")
            ends = lists.offsets.to_numpy()
            s, e, d = (lists.values.field(x).to_numpy() for x in ("start", "end", "source"))
            out = []
            for k in range(len(lists)):
                one = slice(int(ends[k]), int(ends[k + 1]))
                order = np.argsort(s[one], kind="stable")
                a, b, src = s[one][order], e[one][order], d[one][order]
                reach = np.maximum.accumulate(b)
                cut = np.concatenate([[True], a[1:] > reach[:-1]])
                at = np.nonzero(cut)[0]
                stop = np.concatenate([at[1:], [len(a)]])
                out.append([{"start": int(a[i]), "end": int(reach[j - 1]), "sources": np.unique(src[i:j]).tolist()} for i, j in zip(at, stop, strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tk"), pa.array(out, type=spans)], names=["doc_id", "tk", "spans"])

    return parts_.mapInArrow(merge, "doc_id long, tk long, spans array<struct<start: int, end: int, sources: array<long>>>")


def span_rows(spans: DataFrame) -> DataFrame:
    """doc_id, source_id, start_word, end_word, n_words: a row for each span and each document that holds a passage of it earlier."""
    one = spans.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.start", "s.end", F.explode("s.sources").alias("source_id"))
    return one.select("doc_id", "source_id", F.col("start").cast("long").alias("start_word"), F.col("end").cast("long").alias("end_word"), (F.col("end") - F.col("start")).cast("long").alias("n_words"))


def cut_out(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans (start, end): from each span's first word to the next word after it, or the end."""
    starts = [m.start() for m in _WORDS.finditer(text)]
    out, at = [], 0
    for a, b in spans:
        if a >= len(starts):
            break
        out.append(text[at : starts[a]])
        at = starts[b] if b < len(starts) else len(text)
    out.append(text[at:])
    return "".join(out)


def drop_repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, head: int = HEAD) -> DataFrame:
    """docs with repeated passages cut out of ``text``; other columns and documents without any stay as they are.

    Each row loses what its own text repeats, whatever other rows have its doc_id; of equal rows all lose the same.
    A document that loses every word goes; n_chars, where docs has it, follows the text.
    """
    spans = written(repeated_spans(docs, min_words, head), "spans").select(F.col("doc_id").alias("__quarry_id"), F.col("tk").alias("__quarry_tk"), F.col("spans").alias("__quarry_spans"))
    small_batches(docs.sparkSession)
    names = docs.columns
    # spans grow with docs: a merge join at every size
    joined = docs.join(spans.hint("merge"), (F.col("doc_id") == F.col("__quarry_id")) & (F.xxhash64("text") == F.col("__quarry_tk")), "left").drop("__quarry_id", "__quarry_tk")

    def run(batches):
        for batch in batches:
            texts, keep = [], []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("__quarry_spans").to_pylist(), strict=True):
                new = cut_out(text, [(s["start"], s["end"]) for s in found]) if found else text
                texts.append(new)
                keep.append(not found or bool(_WORDS.search(new)))
            out = []
            for name in names:
                col = batch.column(name)
                if name == "text":
                    col = pa.array(texts, type=col.type)
                elif name == "n_chars":
                    col = pa.array([len(t) if s else n for t, s, n in zip(texts, batch.column("__quarry_spans").to_pylist(), col.to_pylist(), strict=True)], type=col.type)
                out.append(col)
            yield pa.RecordBatch.from_arrays(out, names=names).filter(pa.array(keep, type=pa.bool_()))

    return joined.mapInArrow(run, docs.schema)

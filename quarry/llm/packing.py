"""Order-preserving packing by dynamic programming.

The documents of a partition, each its ids and an end id, are one stream in
their order.  Windows may be cut at ends of documents and of sentences alone;
only inside a sentence longer than a sequence are further cuts offered, every
``STRIDE`` tokens.  With positions c and truncation penalties q,

    best[j] = q[j] + min over i, c[j] - c[i] <= length, of best[i] + length - (c[j] - c[i])

is the least padding plus penalties of sequences that end at j.  As best[i] +
c[i] does not depend on j, a monotone queue of candidates with growing values
gives each minimum in constant time.

The programme runs over the whole partition as one stream.  Whatever comes
later continues from a candidate that is still in the queue, so the cuts up to
the last common ancestor of all of these are settled: they are given out and
forgotten, and the result stays the optimum.  Ancestors meet within a few
sequences; should they not do so within ``HELD`` tokens, the cut at the last
document's end is taken, which costs at most one sequence more in so many.
"""

from __future__ import annotations

import heapq
import zlib
from array import array
from collections import deque
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame

from quarry.llm.bpe import RankArrayBpe, default_path
from quarry.llm.common import small_batches, texts_of

LENGTH = 1024
#: Inside a sentence longer than a sequence: tokens between the cuts that are offered.
STRIDE = 64
#: In tokens of padding: a cut at a sentence's end inside a document, and one inside a sentence.
SENTENCE, INSIDE = 1, 16
#: Tokens after which settled cuts are looked for, and those that wait for it at most.
BLOCK, HELD = 1 << 16, 1 << 23
#: Words that a worker remembers.
WORDS = 400_000

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class _Words(dict):
    """Ids of words, as bytes; a word that is not there yet is merged by the library."""

    def __init__(self, codec: RankArrayBpe):
        self.codec = codec
        ascending = bool(np.all(np.diff(codec.merged) > 0)) if len(codec.merged) > 1 else True
        self.merge = None
        if ascending:
            ranks = {b: i for i, b in enumerate(codec.bytes_of) if i not in codec.special.values() and b}
            self.merge = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def __missing__(self, word) -> bytes:
        if isinstance(word, int):  # a special token
            ids = array("I", [word]).tobytes()
        elif self.merge is not None:
            ids = array("I", self.merge(word.encode())).tobytes()
        else:  # ranks that do not follow ids
            self.codec.learn([word])
            ids = self.codec.cache.pop(word)
        if len(self) < WORDS:
            self[word] = ids
        return ids


class Encoder:
    """Ids of whole texts, and after which of them a sentence ends."""

    def __init__(self, path: str):
        self.codec = RankArrayBpe(path)
        self.words = _Words(self.codec)
        closing, far = b"\"')]}*_", tuple(x.encode() for x in "。！？…｡")
        pieces = self.codec.bytes_of
        #: A line ends, or a sentence of a script without spaces.
        self.ends = np.array([b"\n" in x or x.endswith(far) for x in pieces], dtype=bool)
        self.stops = np.array([x.rstrip(closing).endswith((b".", b"!", b"?")) for x in pieces], dtype=bool)
        self.spaces = np.array([x[:1].isspace() for x in pieces], dtype=bool)

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        return b"".join(map(self.words.__getitem__, self.codec._parts(text)))

    def breaks(self, ids: np.ndarray) -> np.ndarray:
        """Numbers of the ids before which a sentence has ended: after a line break, or . ! ? before white space."""
        here, after = ids[:-1], ids[1:]
        return np.flatnonzero(self.ends[here] | (self.stops[here] & self.spaces[after])) + 1


class Packer:
    """Takes documents in order; yields their pieces once the sequences round them are settled."""

    def __init__(self, length: int = LENGTH, first_sequence: int = 0, block: int = BLOCK, held: int = HELD):
        self.length, self.sequence, self.block, self.held = length, first_sequence, block, held
        self.docs: deque = deque()  # (doc_id, bytes of ids, number of ids, place in the stream)
        # candidates: place, least cost up to it plus place, and the candidate before it
        self.cuts, self.value, self.back = [0], [0], [0]
        self.queue = deque([0])
        self.end = self.done = self.looked = 0

    def add(self, doc_id, ids: bytes, breaks: np.ndarray) -> list[tuple]:
        """breaks: ascending numbers of the document's ids, above 0, before which a sentence has ended."""
        at, n = self.end, len(ids) // 4
        places = np.append(breaks[breaks < n], n)
        penalties = np.full(len(places), SENTENCE)
        penalties[-1] = 0
        gaps = np.diff(places, prepend=0)
        if gaps.max() > self.length:
            stride = min(STRIDE, self.length)
            inner = [np.arange(p - g + stride, p, stride) for p, g in zip(places[gaps > self.length].tolist(), gaps[gaps > self.length].tolist(), strict=True)]
            more = np.concatenate(inner)
            places, order = np.unique(np.concatenate([places, more]), return_index=True)
            penalties = np.concatenate([penalties, np.full(len(more), INSIDE)])[order]
        self._extend((places + at).tolist(), penalties.tolist())
        self.docs.append((doc_id, ids, n, at))
        self.end = at + n
        if self.end - self.looked < self.block:
            return []
        self.looked = self.end
        return self._settle()

    def _extend(self, places: list[int], penalties: list[int]) -> None:
        length, queue, cuts, value, back = self.length, self.queue, self.cuts, self.value, self.back
        pop, push, left = queue.pop, queue.append, queue.popleft
        for c, q in zip(places, penalties, strict=True):
            low = c - length
            while cuts[queue[0]] < low:
                left()
            i = queue[0]
            # the place cancels out: best[i] + length - (c - cuts[i]) + q + c
            v = value[i] + length + q
            while queue and value[queue[-1]] >= v:
                pop()
            push(len(cuts))
            cuts.append(c)
            value.append(v)
            back.append(i)

    def _settle(self) -> list[tuple]:
        """Pieces up to the last candidate that every way on goes through."""
        live = {-i for i in self.queue}
        heap = list(live)
        heapq.heapify(heap)
        while len(heap) > 1:
            live.discard(top := heapq.heappop(heap))
            if (i := -self.back[-top]) not in live:
                live.add(i)
                heapq.heappush(heap, i)
        k = -heap[0]
        if not k:
            if self.end - self.done <= self.held:
                return []
            k = len(self.cuts) - 1  # the end of the last document
            self.queue = deque([k])
        out = self._give(k)
        self.queue = deque(i - k for i in self.queue)
        # candidates before k that the queue still holds would be ancestors of it: there are none
        self.cuts, self.value = self.cuts[k:], self.value[k:]
        self.back = [0, *(i - k for i in self.back[k + 1 :])]
        return out

    def finish(self) -> list[tuple]:
        """Pieces of all that is left."""
        return self._give(len(self.cuts) - 1) if self.end > self.done else []

    def _give(self, k: int) -> list[tuple]:
        ends = []
        while k:
            ends.append(self.cuts[k])
            k = self.back[k]
        out, start, docs = [], self.done, self.docs
        for e in reversed(ends):
            offset = 0
            while docs:
                doc_id, ids, n, at = docs[0]
                a, b = max(start, at), min(e, at + n)
                if a < b:
                    out.append((doc_id, a - at, b - a, zlib.crc32(memoryview(ids)[4 * (a - at) : 4 * (b - at)]), n, self.sequence, offset))
                    offset += b - a
                if at + n > e:
                    break
                docs.popleft()
                if at + n == e:
                    break
            self.sequence += 1
            start = e
        self.done = start
        return out


@lru_cache(maxsize=1)
def load(path: str) -> Encoder:
    """One encoder a worker process and file."""
    return Encoder(path)


def pack(docs: DataFrame, length: int = LENGTH, end_id: int = 0, path: str | None = None) -> DataFrame:
    """Pieces of all rows of ``docs`` (doc_id, text) in sequences of at most ``length`` ids.

    Every row gives its ids and the end id, cut into one or more pieces; a null text is
    empty and gives the end id alone.  Rows with equal or null doc_ids stay separate documents.
    sequence_id holds the partition in its upper bits, and a sequence lies in one
    partition, so a task that runs again makes the same rows.  An empty table gives none.
    Other columns are not read.
    """
    path = path or default_path()
    small_batches(docs.sparkSession)

    def run(batches):
        encoder = load(path)
        packer = Packer(length, TaskContext.get().partitionId() << 36)
        kinds = [pa.int64()] * 7
        names = [x.split(" ")[0] for x in SCHEMA.split(", ")]
        out: list[tuple] = []

        def batch():
            cols = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(cols, kinds, strict=True)], names=names)

        tail = array("I", [end_id]).tobytes()
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), texts_of(b), strict=True):
                ids = encoder.ids(text)
                out += packer.add(doc_id, ids + tail, encoder.breaks(np.frombuffer(ids, dtype="<u4")))
            if len(out) > 10_000:
                yield batch()
                out = []
        out += packer.finish()
        if out:
            yield batch()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)

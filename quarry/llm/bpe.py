"""Byte-level BPE encoding and decoding with a contiguous rank array.

A word is held as its parts side by side, with the rank of every adjacent pair
beside them.  Again and again the smallest rank is found by a scan, the
boundary there is deleted, and the two neighbouring ranks are looked up anew.
Words of one length that are not cached yet go through these steps together, a
row of the array each: every step deletes one boundary in each row, so the rows
stay equally long and need no padding.  Only words above ``LONG`` bytes, where
repeated scans would be quadratic, take a heap over the same ranks.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quarry.llm.common import small_batches, texts_of

NONE = np.int32(2**31 - 1)
#: Bytes up to which a word is merged by scans.
LONG = 96
#: Words that the cache of one worker holds at most.
CACHED = 500_000
#: Characters that are split and merged together.
CHUNK = 3 << 20

_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?[^{s}{l}{n}]+|[{s}]+(?![^{s}])|[{s}]+"
#: Any text.
_ANY = regex.compile(_WORDS.format(L=r"\p{L}", N=r"\p{N}", s=r"\p{White_Space}", l=r"\p{L}", n=r"\p{N}"))
#: The same classes spelt out below U+0250, where the standard library's engine is several times as fast.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", "\t-\r \x85\xa0"
_LATIN = re.compile(_WORDS.format(L=f"[{_L}]", N=f"[{_N}]", s=_S, l=_L, n=_N))
_BEYOND = re.compile("[^\x00-ɏ]")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else the next code point from 256 on."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in keep else next(spare)) for b in range(256)]


class RankArrayBpe:
    """Encoder and decoder of one tokenizer file (JSON with vocab, merges and added tokens)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        symbols = byte_symbols()
        back = {c: b for b, c in enumerate(symbols)}
        self.size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.bytes_of = [b""] * self.size
        for s, i in [*vocab.items(), *self.special.items()]:
            self.bytes_of[i] = bytes(back[c] for c in s) if all(c in back for c in s) else s.encode()
        self.decimal = [str(i) for i in range(self.size)]
        self.byte_ids = np.array([vocab[c] for c in symbols], dtype=np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
        self._build(left << 20 | right)
        #: The same ranks for one pair at a time.
        self.pairs: dict[int, int] = {}
        for rank, key in enumerate((left << 20 | right).tolist()):
            self.pairs.setdefault(key, rank)
        self.cache: dict[str, bytes] = {}

    def _build(self, keys: np.ndarray) -> None:
        """An open-addressed table from a pair of ids to its rank; equal pairs keep the first rank."""
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 8))))
        self.keys = np.full((1 << self.bits) + len(keys) + 1, -1, dtype=np.int64)
        self.ranks = np.full(len(self.keys), NONE, dtype=np.int32)
        for rank, (key, at) in enumerate(zip(keys.tolist(), self._slot(keys).tolist(), strict=True)):
            while self.keys[at] not in (-1, key):
                at += 1
            if self.keys[at] == -1:
                self.keys[at], self.ranks[at] = key, rank

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 20 | right
        at = self._slot(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.ranks[at], NONE)
        todo = np.nonzero((there != keys) & (there != -1))
        while len(todo[0]):
            at[todo] += 1
            there = self.keys[at[todo]]
            hit = there == keys[todo]
            out[tuple(x[hit] for x in todo)] = self.ranks[at[todo]][hit]
            on = ~hit & (there != -1)
            todo = tuple(x[on] for x in todo)
        return out

    def _merge_rows(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """ids: a row of byte ids a word.  Yields (row numbers, final ids) for rows that end equally long."""
        rows = np.arange(len(ids))
        ranks = self.rank(ids[:, :-1], ids[:, 1:])
        while len(rows):
            width = ids.shape[1]
            if width == 1:
                yield rows, ids
                return
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(rows)), at]
            done = best == NONE
            if done.any():
                yield rows[done], ids[done]
                rows, ids, ranks, at, best = (x[~done] for x in (rows, ids, ranks, at, best))
                if not len(rows):
                    return
            n = np.arange(len(rows))
            ids[n, at] = self.merged[best]
            cols = np.arange(width - 1)
            ids = np.take_along_axis(ids, cols + (cols > at[:, None]), axis=1)
            cols = np.arange(width - 2)
            ranks = np.take_along_axis(ranks, cols + (cols >= at[:, None]), axis=1)
            if width > 2:
                k = n[at > 0]
                ranks[k, at[k] - 1] = self.rank(ids[k, at[k] - 1], ids[k, at[k]])
                k = n[at < width - 2]
                ranks[k, at[k]] = self.rank(ids[k, at[k]], ids[k, at[k] + 1])

    def _merge_long(self, word: bytes) -> bytes:
        ids = self.byte_ids[np.frombuffer(word, dtype=np.uint8)].astype(np.int64)
        first = self.rank(ids[:-1], ids[1:])
        ids = ids.tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i, r in enumerate(first.tolist()) if r != NONE]
        heapq.heapify(heap)
        live: list[int] = first.tolist() + [int(NONE)]
        ranks, none = self.pairs, int(NONE)
        one = lambda a, b: ranks.get(a << 20 | b, none)
        while heap:
            r, i = heapq.heappop(heap)
            if live[i] != r:
                continue
            j = after[i]
            ids[i], ids[j], live[j] = int(self.merged[r]), -1, int(NONE)
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0:
                    live[k] = one(ids[k], ids[after[k]]) if after[k] < n else int(NONE)
                    if live[k] != NONE:
                        heapq.heappush(heap, (live[k], k))
        return np.array([x for x in ids if x >= 0], dtype="<u4").tobytes()

    def learn(self, words: Iterable[str]) -> None:
        """Put words into the cache: each one's ids as little-endian unsigned 32-bit integers."""
        words = list(words)
        raw = [w.encode() for w in words]
        lengths = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        order = np.argsort(lengths, kind="stable")
        at = 0
        for length, n in zip(*np.unique(lengths, return_counts=True), strict=True):
            group = order[at : at + n].tolist()
            at += n
            if length > LONG:
                for k in group:
                    self.cache[words[k]] = self._merge_long(raw[k])
                continue
            ids = self.byte_ids[np.frombuffer(b"".join([raw[k] for k in group]), dtype=np.uint8).reshape(-1, length)]
            for rows, out in self._merge_rows(ids):
                flat, step = out.astype("<u4").tobytes(), 4 * out.shape[1]
                for k, row in enumerate(rows.tolist()):
                    self.cache[words[group[row]]] = flat[k * step : k * step + step]

    @staticmethod
    def words(text: str) -> list[str]:
        return (_LATIN if text.isascii() or not _BEYOND.search(text) else _ANY).findall(text)

    def _parts(self, text: str) -> list[str | int]:
        """A text's words, and the ids of special tokens that stand in it."""
        if not self._special or not self._special.search(text):
            return self.words(text)
        out: list[str | int] = []
        at = 0
        for m in self._special.finditer(text):
            out += [*self.words(text[at : m.start()]), self.special[m[0]]]
            at = m.end()
        return out + self.words(text[at:])

    def pieces(self, texts: list[str], specials: bool = True) -> Iterator[tuple[list[str | int], list[bytes]]]:
        """For each text its words and their ids as bytes; special tokens stand as an integer in the first.

        Without specials their strings are ordinary text.
        """
        parts = self._parts if specials else self.words
        k = 0
        while k < len(texts):
            group, size = [], 0
            while k < len(texts) and (not group or size < CHUNK):
                group.append(parts(texts[k]))
                size, k = size + len(texts[k]), k + 1
            if len(self.cache) > CACHED:
                self.cache = {}
            for i in self.special.values():
                self.cache[i] = np.array([i], dtype="<u4").tobytes()  # type: ignore[index]
            found = [list(map(self.cache.get, words)) for words in group]
            new: set = set()
            for words, raw in zip(group, found, strict=True):
                if None in raw:
                    new.update([w for w, r in zip(words, raw, strict=True) if r is None])
            self.learn(new)
            for words, raw in zip(group, found, strict=True):
                yield words, list(map(self.cache.__getitem__, words)) if None in raw else raw  # type: ignore[arg-type]

    def encode(self, texts: list[str], specials: bool = True) -> Iterator[np.ndarray]:
        for _, raw in self.pieces(texts, specials):
            yield np.frombuffer(b"".join(raw), dtype="<u4")

    def decode(self, ids: Iterable[int]) -> str:
        """Bytes of the ids in order, read as UTF-8 with replacement characters."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> RankArrayBpe:
    """One codec a worker process and file."""
    return RankArrayBpe(path)


def encode(df: DataFrame, column: str = "text", into: str = "ids", path: str | None = None) -> DataFrame:
    """Add the ids of a text column as array<int>.

    Null encodes as an empty text, an empty text as no ids; all rows and columns stay.
    A column already named ``into`` is replaced.
    """
    path = path or default_path()
    small_batches(df.sparkSession)
    df = df.drop(into)
    schema = df.select("*").schema.add(into, T.ArrayType(T.IntegerType()))

    def run(batches):
        codec = load(path)
        for b in batches:
            ids = pa.array([x.astype(np.int32) for x in codec.encode(texts_of(b, column))], type=pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns, ids], names=[*b.schema.names, into])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, column: str = "ids", into: str = "decoded", path: str | None = None) -> DataFrame:
    """Add the text of an id column; null and empty lists decode as an empty text."""
    path = path or default_path()
    small_batches(df.sparkSession)
    df = df.drop(into)
    schema = df.select("*").schema.add(into, "string")

    def run(batches):
        codec = load(path)
        for b in batches:
            text = pa.array([codec.decode(x or ()) for x in b.column(column).to_pylist()], type=pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, text], names=[*b.schema.names, into])

    return df.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encode every text, decode its ids, and digest both: doc_id, n_tokens, ids_sha256, decoded_sha256, round_trip.

    The steps of encode() and decode() in one pass, so that ids never leave the worker.  Rows with
    equal doc_ids stay separate rows; a null text counts as empty (no ids).  Other columns are not read.
    """
    path = path or default_path()
    small_batches(docs.sparkSession)

    def run(batches):
        codec = load(path)
        for b in batches:
            texts = texts_of(b)
            rows = []
            for text, ids in zip(texts, codec.encode(texts), strict=True):
                ids = ids.tolist()
                back = codec.decode(ids)
                decimal = ",".join(map(codec.decimal.__getitem__, ids))
                rows.append((len(ids), hashlib.sha256(decimal.encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), back == text))
            cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
            kinds = (pa.int64(), pa.string(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, type=k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean")


def token_counts(docs: DataFrame, keys: list[str], path: str | None = None) -> DataFrame:
    """The given key columns and n_tokens of every row's text."""
    path = path or default_path()
    small_batches(docs.sparkSession)
    rows = docs.select(*keys, "text")
    schema = docs.select(*keys).schema.add("n_tokens", "long")

    def run(batches):
        codec = load(path)
        for b in batches:
            n = [sum(map(len, raw)) // 4 for _, raw in codec.pieces(texts_of(b))]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array(n, type=pa.int64())], names=[*keys, "n_tokens"])

    return rows.mapInArrow(run, schema)

"""Packing against brute force: the same least cost, every id once, cuts at ends of documents and sentences."""

import collections
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from quarry.llm import packing
from quarry.llm.bpe import default_path

FRAME = "doc_id long, text string, length string, start int"


def cost_of(out, breaks, n_of, length):
    """Padding plus penalties of pieces, each document's breaks given by its number."""
    by = collections.defaultdict(list)
    for p in out:
        by[p[5]].append(p)
    total = 0
    for ps in by.values():
        used = sum(p[2] for p in ps)
        assert used <= length
        total += length - used
        last = max(ps, key=lambda p: p[6])
        end = last[1] + last[2]
        total += 0 if end == n_of[last[0]] else packing.SENTENCE if end in breaks[last[0]] else packing.INSIDE
    return total


def least_cost(docs, length):
    """docs: (number of ids, breaks).  All cuts by a plain quadratic programme."""
    cuts, pen, at = [0], [0], 0
    for n, breaks in docs:
        ends = [*(b for b in breaks if b < n), n]
        start = 0
        for b in ends:
            if b - start > length:
                for x in range(start + min(packing.STRIDE, length), b, min(packing.STRIDE, length)):
                    cuts.append(at + x)
                    pen.append(packing.INSIDE)
            cuts.append(at + b)
            pen.append(0 if b == n else packing.SENTENCE)
            start = b
        at += n
    best = [0] * len(cuts)
    for j in range(1, len(cuts)):
        best[j] = pen[j] + min(best[i] + length - (cuts[j] - cuts[i]) for i in range(j) if cuts[j] - cuts[i] <= length)
    return best[-1]


@pytest.mark.parametrize("block", [1, 64, 1 << 16])
def test_streamed_cuts_are_the_optimum(block):
    rng = random.Random(block)
    for length in (8, 20, 128):
        docs = []
        for _ in range(80):
            n = rng.choice([1, 2, rng.randint(1, 30), rng.randint(1, 300)])
            docs.append((n, sorted({rng.randint(1, n) for _ in range(rng.randint(0, max(1, n // 5)))})))
        packer, out = packing.Packer(length, block=block), []
        for k, (n, breaks) in enumerate(docs):
            out += packer.add(k, b"\1\0\0\0" * n, np.array(breaks, dtype=np.int64))
        out += packer.finish()
        at = collections.Counter()
        for p in out:
            assert p[1] == at[p[0]]
            at[p[0]] += p[2]
        assert [at[k] for k in range(len(docs))] == [n for n, _ in docs]
        assert cost_of(out, dict(enumerate(set(b) for _, b in docs)), dict(enumerate(n for n, _ in docs)), length) == least_cost(docs, length)


def test_a_stretch_that_never_settles_costs_at_most_a_sequence():
    docs = [(7, [])] * 200
    packer, out = packing.Packer(10, block=1, held=50), []
    for k, (n, _) in enumerate(docs):
        out += packer.add(k, b"\1\0\0\0" * n, np.zeros(0, dtype=np.int64))
    out += packer.finish()
    forced = sum(n for n, _ in docs) // 50
    assert least_cost(docs, 10) <= cost_of(out, {k: set() for k in range(200)}, {k: 7 for k in range(200)}, 10) <= least_cost(docs, 10) + 10 * forced


def test_pack(spark):
    rng = random.Random(8)
    sentence = lambda: " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 6))) for _ in range(rng.randint(3, 40))) + rng.choice(". ? !".split())
    texts = [" ".join(sentence() for _ in range(rng.randint(1, 60))) for _ in range(60)]
    texts += ["word " * 5000, "<|endoftext|> don't  stop\n\n日本。 🙂 \x1c", "x" * 3000, None, "", " \n ", texts[0], texts[0]]
    # ids that repeat, with one text and with others, and rows without an id
    rows = [(None if k % 9 == 0 else k // 2, t, "clash", 1) for k, t in enumerate(texts)]
    lib = Tokenizer.from_file(default_path())
    want = collections.Counter((i, tuple([*lib.encode(t or "", add_special_tokens=False).ids, 0])) for i, t, *_ in rows)
    pieces = packing.pack(spark.createDataFrame(rows, FRAME).repartition(3)).collect()
    by_seq = collections.defaultdict(list)
    for p in pieces:
        by_seq[p.sequence_id].append(p)
    order, ends = [], 0
    for s in sorted(by_seq):
        at = 0
        for p in sorted(by_seq[s], key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
            order.append(p)
        assert at <= 1024
    # sequences follow the documents' order, so pieces of one document stand together and can be put together again
    got, encoder = collections.Counter(), packing.load(default_path())
    bags = collections.defaultdict(list)
    for i, ids in want.elements():
        bags[i, len(ids)].append(ids)
    k = 0
    while k < len(order):
        run = [order[k]]
        while run[-1].start + run[-1].length < run[-1].doc_tokens:
            run.append(order[k + len(run)])
            assert (run[-1].doc_id, run[-1].start) == (run[0].doc_id, run[-2].start + run[-2].length)
        assert run[0].start == 0
        fits = [ids for ids in bags[run[0].doc_id, run[0].doc_tokens] if all(zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32 for p in run)]
        got[run[0].doc_id, fits[0]] += 1
        # cut only where a sentence ends, unless it is longer than a sequence
        breaks = [0, *encoder.breaks(np.array(fits[0][:-1], "<u4")).tolist(), len(fits[0])]
        for p in run[:-1]:
            cut = p.start + p.length
            if cut not in breaks:
                assert min(b for b in breaks if b > cut) - max(b for b in breaks if b < cut) > 1024
            ends += cut in breaks
        k += len(run)
    assert got == want and ends > 5
    assert packing.pack(spark.createDataFrame([], FRAME)).count() == 0


def test_words_without_the_library(tmp_path):
    """A vocabulary whose ids do not follow ranks goes through the rank array, with the same ids as the library."""
    vocab = {"a": 0, "b": 1, "c": 2, "ab": 9, "bc": 3, "abc": 4}
    import json

    from quarry.llm import bpe

    symbols = bpe.byte_symbols()
    vocab |= {c: 100 + k for k, c in enumerate(symbols) if c not in vocab}
    path = tmp_path / "t.json"
    path.write_text(json.dumps({"added_tokens": [], "model": {"vocab": vocab, "merges": ["a b", "b c", "ab c"]}}))
    encoder = packing.Encoder(str(path))
    assert encoder.words.merge is None
    assert np.frombuffer(encoder.ids("abc bc"), "<u4").tolist() == [4, vocab[symbols[32]], 3]

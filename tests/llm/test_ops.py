"""Operators against brute force, an exact round trip or held-out accuracy, and on awkward rows."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from quarry.llm import bpe, chat_tree, components, exact_dedup, license_scan, ngram_lm, quality, simhash, suffix_dedup, token_hist

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long, spans string, key long"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    passage = words(rng, 70)
    base = [words(rng, n) for n in (200, 120, 60, 300)]
    texts = [*base, base[0], base[0].upper().replace("É", "é"), base[0] + " tail", f"{words(rng, 30)} {passage} {words(rng, 80)}", f"{passage} {words(rng, 40)}", f"{words(rng, 90)}\n{passage}", None, "", " \n ", "one", "a b", "a b", "x " * 300, words(rng, 20_000), "<|endoftext|> don't  stop\n\n日本 🙂 \x1c"]
    return [(i, t, None if i % 5 == 0 else "en", None, None, "clash", 1) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOC).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_bpe_against_library(docs, rows, empty):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.default_path())
    got = {r.doc_id: r for r in bpe.round_trip(docs).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.round_trip(empty).count() == 0
    both = bpe.decode(bpe.encode(docs.limit(5))).collect()
    assert all(r.decoded == (r.text or "") for r in both)
    # rows that repeat, with a column that is named like the result
    frame = docs.sparkSession.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (None, "c", None)], "doc_id long, text string, ids string")
    got = bpe.encode(frame)
    assert got.columns == ["doc_id", "text", "ids"] and sorted((r.doc_id or 0, len(r.ids)) for r in got.collect()) == [(0, 1), (1, 2), (1, 2)]
    assert bpe.round_trip(frame).count() == 3
    # special strings as ordinary text
    codec = bpe.load(bpe.default_path())
    (plain,), (special,) = codec.encode(["<|endoftext|>"], specials=False), codec.encode(["<|endoftext|>"])
    assert special.tolist() == [50256] and 50256 not in plain.tolist() and codec.decode(plain.tolist()) == "<|endoftext|>"


def test_exact(docs, rows, empty):
    groups = collections.defaultdict(list)
    for i, t, *_ in rows:
        groups[lower(t)].append(i)
    for bits in (256, 4):  # with 4 bits almost all digests collide
        got = {r.doc_id: r for r in exact_dedup.exact_duplicates(docs, bits).collect()}
        for t, ids in groups.items():
            for i in ids:
                assert (got[i].keep_id, got[i].group_size, got[i].kept) == (max(ids), len(ids), i == max(ids))
                assert got[i].text_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert exact_dedup.exact_duplicates(empty).count() == 0
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {max(g) for g in groups.values()}


def brute_print(t):
    w = WORD.findall(lower(t))
    s = [] if not w else [" ".join(w)] if len(w) < 3 else [" ".join(w[k : k + 3]) for k in range(len(w) - 2)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_a_repeated_id_stays_by_text(spark):
    frame = spark.createDataFrame([(7, "A"), (7, "B"), (9, "a"), (None, "c"), (None, None)], "doc_id long, text string")
    for bits in (256, 4):
        got = sorted(((r.doc_id or -1, r.text or "") for r in exact_dedup.drop_exact_duplicates(frame, bits).collect()))
        assert got == [(-1, ""), (-1, "c"), (7, "B"), (9, "a")]


def test_simhash(docs, rows, empty):
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    prints = {i: brute_print(t) for i, t, *_ in rows}
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in prints:
        for j in prints:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    for i in prints:
        assert got[i].fp & (2**64 - 1) == prints[i] and got[i].component_id == find(i)
    assert simhash.near_duplicates(empty).count() == 0


def test_near_duplicates_without_ids(spark):
    """Linked texts that only rows without doc_id have, one that shares its text with an id, a lone one, and an id that repeats."""
    rng = random.Random(9)
    w = words(rng, 400).split()
    a, b, c, d = " ".join(w), " ".join([*w[:-1], "zz"]), words(rng, 300), words(rng, 300)
    assert 0 < (brute_print(a) ^ brute_print(b)).bit_count() <= 3
    got = [(None, a), (None, b), (None, c), (4, c), (5, c), (7, d), (7, c)]
    frame = spark.createDataFrame(got, "doc_id long, text string")
    found = simhash.near_duplicates(frame).collect()
    assert sorted((r.doc_id, r.component_id) for r in found if r.doc_id is not None) == [(4, 4), (5, 4), (7, 4), (7, 7)]
    assert [r.component_id for r in found if r.doc_id is None] == [None] * 3 and {r.fp & (2**64 - 1) for r in found} == {brute_print(t) for _, t in got}
    kept = collections.Counter(tuple(r) for r in simhash.drop_near_duplicates(frame).collect())
    assert kept == collections.Counter(x for x in got if x[0] != 5)


@pytest.mark.parametrize("tile", [8, 1024])
def test_links_in_hot_blocks(spark, tile):
    rng = np.random.default_rng(3)
    centre = int(rng.integers(0, 2**63))
    fps = sorted({centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False)) for _ in range(120)} | {int(x) for x in rng.integers(0, 2**63, 50)})
    signed = [x - 2**64 if x >> 63 else x for x in fps]
    nodes = spark.createDataFrame([(f, i) for i, f in enumerate(signed)], "fp long, node long")
    got = {r.node: r.component for r in components.connected_components(simhash.links(nodes, len(fps), tile=tile)).collect()}
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(len(fps)):
                if (fps[i] ^ fps[j]).bit_count() <= 3 and label[j] > label[i]:
                    label[j], changed = label[i], True
    assert [got.get(i, i) for i in range(len(fps))] == label


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (7, 7)], "u long, v long")
    got = {r.node: r.component for r in components.connected_components(edges).collect()}
    assert all(got[k] == 0 for k in range(41)) and got[101] == 100
    assert components.connected_components(edges.limit(0)).count() == 0


def test_repeated_passages(docs, rows, empty):
    first, want = {}, collections.defaultdict(set)
    for i, t, *_ in rows:
        w = WORD.findall(t or "")
        for s in range(len(w) - 49):
            first.setdefault(tuple(w[s : s + 50]), (i, s))
    for i, t, *_ in rows:
        w = WORD.findall(t or "")
        for s in range(len(w) - 49):
            if first[tuple(w[s : s + 50])] != (i, s):
                want[i] |= set(range(s, s + 50))
    got = {r.doc_id: {k for s in r.spans for k in range(s.start, s.end)} for r in suffix_dedup.repeated_spans(docs).collect()}
    assert got == dict(want)
    assert suffix_dedup.repeated_spans(empty).count() == 0
    out = {r.doc_id: r.text for r in suffix_dedup.drop_repeated_passages(docs).collect()}
    for i, t, *_ in rows:
        left = [w for k, w in enumerate(WORD.findall(t or "")) if k not in want.get(i, ())]
        if i in want and not left:
            assert i not in out
        else:
            assert WORD.findall(out[i] or "") == left and (i in want or out[i] == t)


def brute_spans(texts):
    """(doc_id, source, start, end) as the SQL says it."""
    first, hits, out = {}, collections.defaultdict(list), set()
    split = {i: WORD.findall(t or "") for i, t in texts}
    for i in sorted(split):
        w = split[i]
        for s in range(len(w) - 49):
            at = first.setdefault(tuple(w[s : s + 50]), (i, s))
            if at != (i, s):
                hits[i].append((s, at[0]))
    for i, found in hits.items():
        k = 0
        while k < len(found):
            z = k + 1
            while z < len(found) and found[z][0] <= found[z - 1][0] + 50:
                z += 1
            out |= {(i, src, found[k][0], found[z - 1][0] + 50) for _, src in found[k:z]}
            k = z
    return out


def test_sources_of_repeated_passages(spark, rows):
    rng = random.Random(9)
    texts, i = [(r[0], r[1]) for r in rows], 1000
    for n in (50, 55, 60, 70, 79, 90):
        for _ in range(6):
            a, b, c, d = (words(rng, 60) for _ in range(4))
            p = words(rng, n)
            made = [f"{a} {p} {d}", f"{b} {p} {c}", f"zz {b} {p} {c} yy", f"{p} {c} {p}", f"{a} {p} {c}", f"{b} {p} {c} {b} {p}"]
            rng.shuffle(made)
            texts += [(i + k, t) for k, t in enumerate(made)]
            i += 10
    got = suffix_dedup.span_rows(suffix_dedup.repeated_spans(spark.createDataFrame(texts, "doc_id long, text string").repartition(3))).collect()
    got = [(r.doc_id, r.source_id, r.start_word, r.end_word) for r in got]
    assert len(got) == len(set(got)) and set(got) == brute_spans(texts)


def test_repeated_ids_and_equal_rows(spark):
    """Spans belong to a text, not to an id; equal rows are one place; the ranges of the sorted suffixes do not matter."""
    rng = random.Random(12)
    w, v, tail = words(rng, 60), words(rng, 80), words(rng, 20)
    hot = words(rng, 55)
    texts = [(1, w), (5, f"{w} {tail}"), (5, v), (6, v), (6, v), (None, w), (8, None), *((100 + k, " ".join([*(f"b{k}n{j}" for j in range(12)), hot, *(f"a{k}n{j}" for j in range(k % 5))])) for k in range(80))]
    frame = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    before, outs = spark.conf.get("spark.sql.shuffle.partitions"), []
    for parts in ("1", "29"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            outs.append(sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in suffix_dedup.drop_repeated_passages(frame).collect()))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
    assert outs[0] == outs[1]
    got = collections.defaultdict(list)
    for i, t in outs[0]:
        got[i].append(t)
    assert sorted(got[5]) == sorted([tail, v]) and got[1] == [w] and 6 not in got and got[-1] == [w] and got[8] == [""]
    assert [len(WORD.findall(got[100 + k][0])) for k in range(80)] == [67] + [12 + k % 5 for k in range(1, 80)]


def test_chat(spark):
    probe = "</s>[INST] ok [/INST]"
    talks = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes \\"), (2, 0, "user", "hi"), (2, 1, "assistant", "no"), (3, 0, "system", None), (3, 1, "odd [AS] role", "\\\\[INST]"), (3, 2, "assistant", ""), (-7, 0, "user", probe), (-7, 1, "assistant", probe), (4, 0, "user", "hi"), (4, 1, "assistant", "yes \\")]
    tree, read = chat_tree.format_chats(spark.createDataFrame(talks, "conv_id long, turn long, role string, text string"))
    nodes = tree.collect()
    got = {r.conv_id: r for r in read.collect()}
    by = collections.defaultdict(list)
    for c, _, role, text in talks:
        by[c].append((role, text or ""))
    for c, turns in by.items():
        assert [(t.role, t.text) for t in got[c].turns] == turns
        assert got[c].loss_text == "".join(t for r, t in turns if r == "assistant")
    assert len(nodes) == 8  # "hi" once, "yes" once for two conversations
    places = sorted((n.dfs_start, n.dfs_start + n.n_tokens) for n in nodes)
    assert all(a[1] == b[0] for a, b in zip(places, places[1:], strict=False))
    where = {n.node: n for n in nodes}
    assert len(where) == len(nodes)
    for n in nodes:  # depth first: a node comes after its parent, before anything that is not below the parent
        if n.parent:
            assert where[n.parent].dfs_start < n.dfs_start
    assert [s.start for s in got[1].intervals][0] == [s.start for s in got[2].intervals][0]
    assert chat_tree.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))[1].count() == 0


def test_tree_is_depth_first(spark):
    rng = random.Random(3)
    talks = [(c, t, "user" if t % 2 == 0 else "assistant", f"{rng.randint(0, 2)}") for c in range(120) for t in range(rng.randint(1, 6))]
    # branches that part after the same 70 turns
    talks += [(200 + c, t, "user", "deep" if t < 70 else f"{c} {t}") for c in range(4) for t in range(90)]
    tree, _ = chat_tree.format_chats(spark.createDataFrame(talks, "conv_id long, turn long, role string, text string"))
    open_nodes, at = [], 0
    for n in sorted(tree.collect(), key=lambda n: n.dfs_start):
        assert n.dfs_start == at and n.n_tokens > 0
        at += n.n_tokens
        while open_nodes and open_nodes[-1] != n.parent:  # subtrees that are left for good
            open_nodes.pop()
        assert (open_nodes[-1] if open_nodes else "") == n.parent
        open_nodes.append(n.node)


def test_tree_in_many_ranges(spark):
    """Ranges that begin inside subtrees: few conversations a range, and equal ones in several."""
    rng = random.Random(4)
    talks = [(c, t, "user" if t % 2 == 0 else "assistant", "same" if t < 12 else f"{rng.randint(0, 1)}") for c in range(60) for t in range(rng.choice([3, 12, 14, 18]))]
    talks += [(None, 0, "user", "same"), (None, 0, "user", "same"), (None, 5, None, None), (77, None, "user", "x"), (77, None, "user", "x"), (77, 1, "user", "x")]
    frame = spark.createDataFrame(talks, "conv_id long, turn long, role string, text string")
    by = collections.defaultdict(list)
    for k, (c, t, r, x) in enumerate(talks):
        by[c if c is not None else ("alone", k)].append((t if t is not None else -1, r or "", x or ""))
    paths = {c: tuple((r, x) for _, r, x in sorted(v)) for c, v in by.items()}
    prefixes = {p[: k + 1] for p in paths.values() for k in range(len(p))}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    outs = []
    for parts in ("1", "37"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            tree, read = chat_tree.format_chats(frame)
            nodes, got = sorted(tree.collect(), key=lambda n: n.dfs_start), read.collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
        assert len(nodes) == len({n.node for n in nodes}) == len(prefixes)
        open_nodes, at, where = [], 0, {}
        for n in nodes:
            assert n.dfs_start == at
            at += n.n_tokens
            while open_nodes and open_nodes[-1] != n.parent:
                open_nodes.pop()
            assert (open_nodes[-1] if open_nodes else "") == n.parent and n.depth == len(open_nodes)
            open_nodes.append(n.node)
            where[n.dfs_start] = n
        assert collections.Counter(tuple((t.role, t.text) for t in r.turns) for r in got) == collections.Counter(paths.values())
        for r in got:
            on = [where[i.start] for i in r.intervals]
            assert [n.depth for n in on] == list(range(len(r.turns))) and all(b.parent == a.node for a, b in zip(on, on[1:], strict=False))
            assert [i.end - i.start for i in r.intervals] == [n.n_tokens for n in on] and r.formatted == "".join(n.segment for n in on)
            assert list(r.position_starts) == [sum(n.n_tokens for n in on[:k]) for k in range(len(on))]
        outs.append(sorted((str(r.conv_id), r.formatted) for r in got))
    assert outs[0] == outs[1]


def test_users_cannot_write_special_tokens(spark):
    tree, _ = chat_tree.format_chats(spark.createDataFrame([(1, 0, "user", "a <|endoftext|> b")], "conv_id long, turn long, role string, text string"))
    assert 50256 not in tree.first().ids


def test_escape_is_reversible():
    rng = random.Random(1)
    for _ in range(500):
        t = "".join(rng.choice([*chat_tree.CONTROL, "\\", " ", "x", "["]) for _ in range(rng.randint(0, 8)))
        assert chat_tree.unescape(chat_tree.escape(t)) == t
        body, *_ = chat_tree.segment("user", t)
        assert chat_tree.parse(chat_tree.BOS + body) == [("user", t)]


def test_histogram(docs, rows, empty):
    codec = bpe.load(bpe.default_path())
    n = [len(x) for x in codec.encode([r[1] or "" for r in rows])]
    table = token_hist.token_report(docs).cache()
    for r in table.filter("every").collect():
        x = r.context_limit
        assert (r.n_docs, r.n_longer, r.n_tokens_total) == (n.count(x), sum(k > x for k in n), sum(n))
        assert r.truncated_tokens == sum(min(k, x) for k in n) and r.tokens_in_longer == sum(k for k in n if k > x)
    for r in token_hist.limit_report(table, [0, 7, 100, 10**6]).filter("every").collect():
        assert r.truncated_tokens == sum(min(k, r.limit) for k in n)
    assert token_hist.quantile(table, 0.5).filter("every").first().n_tokens == sorted(n)[(len(n) + 1) // 2 - 1]
    assert token_hist.token_report(empty).count() == 0


def test_a_scope_named_like_the_sum(spark):
    frame = spark.createDataFrame([("*", "a b"), ("en", "a b c"), ("en", "a b c"), (None, "")], "lang string, text string")
    got = {(r.scope, r.every): r.n_docs_total for r in token_hist.token_report(frame).collect()}
    assert got == {("*", False): 1, ("en", False): 2, ("", False): 1, ("*", True): 4}


def test_quality(spark, docs, rows, empty):
    rng = random.Random(9)
    good = [(1000 + k, words(rng, 80)) for k in range(60)]
    bad = [(2000 + k, " ".join(w + rng.choice(["###", "$$$"]) for w in words(rng, 80).split())) for k in range(60)]
    labelled = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 2000), 0) for i, _ in good + bad], "doc_id long, quality int, toxic int")
    model = quality.train(labelled, labels)
    fresh = spark.createDataFrame([(1, words(rng, 90)), (2, " ".join(w + "###" for w in words(rng, 90).split()))], "doc_id long, text string")
    assert {r.doc_id: r.kept for r in quality.score(fresh, model).collect()} == {1: True, 2: False}
    for r in quality.score(docs, model).collect():
        t = rows[r.doc_id][1] or ""
        w = WORD.findall(t)
        tri = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        hit = {k + d for k in range(len(w) - 2) if tri[w[k], w[k + 1], w[k + 2]] > 1 for d in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(w), sum(map(len, w)), len(hit), len(lines) - len(set(lines)))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in t) and r.base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w))
    none = quality.train(labelled, labels.limit(0))
    assert quality.score(empty, none).count() == 0 and quality.score(fresh, none).filter("kept").count() == 2


def test_kneser_ney(spark, docs):
    rng = random.Random(4)
    trusted = [(i, words(rng, 120), "en") for i in range(30)]
    other = [(100, "#$%& 1234 ##", "en"), (101, None, None), (102, words(rng, 100), "en"), (103, "", "xx")]
    frame = spark.createDataFrame(trusted + other, "doc_id long, text string, lang string")
    known = spark.createDataFrame([(i,) for i in range(30)], "doc_id long")
    got = {r.doc_id: r for r in ngram_lm.judge(frame, known).collect()}
    assert len(got) == 34 and got[100].perplexity > 5 * got[102].perplexity and not got[100].kept and not got[101].kept
    # against a plain implementation of the same model
    codes = collections.Counter(np.concatenate([ngram_lm.grams([t])[0] for _, t, _ in trusted]).tolist())
    tables, M = [], (1 << 64) - 1
    for k in range(4, 0, -1):
        n = collections.Counter(codes.values())
        d = ngram_lm.discounts(*(n[i] for i in (1, 2, 3, 4)))
        by = collections.defaultdict(list)
        for c, v in codes.items():
            by[(c & M) >> 16].append(v)
        tables.append(({c & M: v for c, v in codes.items()}, {h: (sum(v), sum(d[min(x, 3) - 1] for x in v) / sum(v)) for h, v in by.items()}, d))
        codes = collections.Counter(c & ((1 << 16 * (k - 1)) - 1) for c in codes)
    def p(code):
        out = 1 / 65536
        for k, (c, h, d) in enumerate(tables[::-1], 1):
            x = code & ((1 << 16 * k) - 1)
            total, gamma = h.get(x >> 16, (1, 1.0))
            out = (max(c[x] - d[min(c[x], 3) - 1], 0) / total if x in c else 0) + gamma * out
        return out
    text = other[2][1]
    logs = [np.log(p(c)) for c in ngram_lm.grams([text])[0].tolist()]
    assert got[102].perplexity == pytest.approx(np.exp(-np.mean(logs)), rel=1e-6)
    assert ngram_lm.judge(frame.limit(0), known).count() == 0
    # every character of the basic plane is a symbol of its own; code points beyond it share classes
    far = ngram_lm.symbols("".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)])))
    assert len(np.unique(far)) == len(far) and far.min() == 2 and far.max() < 1 << 16
    assert not set(ngram_lm.symbols("🙂🎈").tolist()) & set(far.tolist())
    # a language named like a sign for all is one language; repeated ids are judged row by row
    star = spark.createDataFrame([(i, t, "*" if i < 15 else "en") for i, t, _ in trusted] + [(3, "#$%& 1234 ##", "*"), (3, words(rng, 90), "*")], "doc_id long, text string, lang string")
    held = ngram_lm.judge(star, known).collect()
    assert len(held) == 32 and len({r.threshold for r in held if r.lang == "*"}) == 1 and len({r.threshold for r in held}) == 2
    assert ngram_lm.judge(frame, known.limit(0)).filter("kept").count() == 32


def test_licenses(spark, empty):
    texts = ["Licensed under CC BY-NC 4.0. All rights reserved.", "This work is licensed under the GNU General Public License, version 3.", "all rights\nRESERVED cc by cc by", "rights reserved all", None, "", "Released under the MIT License. " + "word " * 5000, "mit licence", "Licensed under the Apache License, Version 2.0."]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan(frame).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        places = [(k, label) for phrase, label in license_scan.BASE.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        r = got[i]
        assert (r.n_words, r.n_base) == (len(w), len(places))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    assert "cc-by-nc-4.0" in got[0].labels and "gpl-3.0" in got[1].labels and got[6].labels == "mit" and got[8].labels == "apache-2.0" and got[7].labels == ""
    assert license_scan.scan(empty).count() == 0


def test_every_licence_of_a_file(spark):
    notice = {t.label: t.text for t in license_scan.TEMPLATES}  # of several, the last
    mit = license_scan.MIT_TEXT
    prose = "the person may copy files free of charge under these conditions and the foundation met the following source forms in use "
    pairs = [(mit, notice["apache-2.0"]), (mit, notice["gpl-3.0"]), (mit, "licensed under cc by nc 4 0"), (notice["bsd"], "released under the mit license")]
    labels = [{"mit", "apache-2.0"}, {"mit", "gpl-3.0"}, {"mit", "cc-by-nc-4.0"}, {"bsd", "mit"}]
    # short lines make the words of the second licences the common ones
    common = [b for _, b in pairs for _ in range(20)]
    texts = [f"{a}. {prose}{b}" for a, b in pairs] + common
    got = {r.doc_id: set(r.labels.split(",")) for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert all(want <= got[k] for k, want in enumerate(labels))


def brute_licences(texts):
    """(label, first word, share) of every alignment at which a template's key phrases stand, with its share of idf."""
    found = [license_scan.words_of(t or "") for t in texts]
    sets = [set(w) for w in found]
    known = {w for t in license_scan.TEMPLATES for w in license_scan.words_of(t.text)}
    df = {w: sum(w in x for x in sets) for w in known}
    idf = {w: np.log((len(texts) + 1) / (n + 1)) + 1 if n else 1.0 for w, n in df.items()}
    out = []
    for words_ in found:
        places = []
        for t in license_scan.TEMPLATES:
            w = license_scan.words_of(t.text)
            must = {s + k for p in t.key_phrases for s in license_scan._starts(w, license_scan.words_of(p))[:1] for k in range(len(license_scan.words_of(p)))}
            for start in range(len(words_)):
                if all(start + k < len(words_) and words_[start + k] == w[k] for k in must):
                    share = sum(idf[w[k]] for k in range(len(w)) if start + k < len(words_) and words_[start + k] == w[k]) / sum(idf[x] for x in w)
                    if share >= license_scan.MATCHED:
                        places.append((t.label, start, share))
        out.append(places)
    return out


def test_licences_against_brute_force(spark):
    import pyarrow.parquet as pq

    rng = random.Random(13)
    whole = [t.text for t in license_scan.TEMPLATES]
    texts = [r or "" for r in pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).column("text").to_pylist()]
    texts += [*whole, " ; ".join(whole), f"{words(rng, 2000)} {license_scan.MIT_TEXT}, {license_scan.BSD_3_TEXT}", *(" ".join(w for w in t.split() if rng.random() > 0.03) for t in whole for _ in range(3)), None, ""]
    frame = spark.createDataFrame([(k // 2, t) for k, t in enumerate(texts)], "doc_id long, text string")  # ids repeat
    want = collections.Counter()
    for k, (t, places) in enumerate(zip(texts, brute_licences(texts), strict=True)):
        want[k // 2, len(license_scan.words_of(t or "")), tuple(sorted((a, b, round(c, 6)) for a, b, c in places))] += 1
    got = license_scan.scan(frame).collect()
    assert collections.Counter((r.doc_id, r.n_words, tuple(sorted((p.label, p.start, round(p.score, 6)) for p in r.license_places or ()))) for r in got) == want
    every = max(got, key=lambda r: len(r.labels))
    assert {t.label for t in license_scan.TEMPLATES} <= set(every.labels.split(","))
    for r in got:
        assert r.score == pytest.approx(max([p.score for p in r.license_places or ()], default=float(r.n_base > 0)))
        assert {p.label for p in r.license_places or ()} <= set(r.labels.split(","))


def test_idf_counts_every_document(spark):
    # the words before the key phrase stand in most documents, few of which may hold a licence at all
    plain = ["it is under the terms of the house"] * 60 + ["license in general"] * 2
    texts = ["see the GNU lesser general public license for more", "words before that key phrase: a GNU lesser general public license", *plain]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    words = {i: set(license_scan.words_of(t)) for i, t in enumerate(texts)}
    idf = lambda w: np.log((len(texts) + 1) / (sum(w in x for x in words.values()) + 1)) + 1
    whole = "under the terms of the gnu lesser general public license".split()
    share = sum(map(idf, whole[5:])) / sum(map(idf, whole))
    assert share > license_scan.MATCHED and "lgpl" in got[1].labels.split(",")
    assert [p.score for p in got[1].license_places] == [pytest.approx(share)]


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(6)
    same = words(rng, 100)
    texts = [same, same, *(words(rng, 100) for _ in range(10)), "###", None]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(range(1, 12))


def test_pipeline_against_brute_force(spark, tmp_path):
    """Every stage by plain Python on the same rows: what stays, with which text, and that each of its ids lies in one piece."""
    import zlib

    import corpus_pipeline

    rng = random.Random(16)
    passage = words(rng, 70)
    base = [words(rng, rng.randint(60, 400)) for _ in range(40)]
    texts = [*base, base[3].upper().replace("É", "é"), base[3], base[7] + " x" * 3, *(f"{words(rng, 80)} {passage} {words(rng, 30)}" for _ in range(5)), passage, "### $$$", None, "", "same words again " * 60, words(rng, 49)]
    # near copies: one word of a long text changed
    long = words(rng, 900).split()
    texts += [" ".join(long), " ".join([*long[:450], "zz", *long[451:]])]
    rows = [(i + 1, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    now = {}
    for i, t, *_ in rows:  # quality rules: without labels the classifier keeps what the base rules keep
        w = WORD.findall(t or "")
        tri = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        hit = {k + d for k in range(len(w) - 2) if tri[w[k], w[k + 1], w[k + 2]] > 1 for d in range(3)}
        if len(w) >= 50 and 100 * len(hit) <= 50 * len(w):
            now[i] = t
    last = {lower(t): i for i, t in sorted(now.items())}  # of equal texts the largest id
    now = {i: now[i] for i in last.values()}
    prints, root = {i: brute_print(t) for i, t in now.items()}, {i: i for i in now}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in now:
        for j in now:
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert any(find(i) != i for i in now)
    now = {i: t for i, t in now.items() if find(i) == i}
    cut = collections.defaultdict(list)
    for i, _, a, b in brute_spans(list(now.items())):
        cut[i].append((a, b))
    assert cut
    now = {i: suffix_dedup.cut_out(t, sorted(set(cut[i]))) if i in cut else t for i, t in now.items()}
    now = {i: t for i, t in now.items() if WORD.search(t)}
    codec = bpe.load(bpe.default_path())
    want = {i: np.append(ids, 0).astype("<u4") for i, ids in zip(now, codec.encode(list(now.values())), strict=True)}
    got = collections.defaultdict(list)
    for p in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[p.doc_id].append(p)
    assert set(got) == set(want)
    for i, ids in want.items():
        at = 0
        for p in sorted(got[i], key=lambda p: p.start):
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + p.length].tobytes()))
            at += p.length
        assert at == len(ids)

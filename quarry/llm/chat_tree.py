"""Chat formatting over a prefix tree.

A conversation is a path of turns.  Conversations are sorted by their whole
paths (a digest a turn), which puts the leaves of the tree in depth-first order:
the turns that a conversation has in common with the one before it are nodes
that stand already, and what follows them is new.  A walk over the sorted rows
with a stack of open nodes therefore emits every node's segment (the formatted
turn and its token ids) once, depth-first, however deep the tree is.

Rows are dealt by ranges of the path and each range is walked by itself.  Where
a range begins inside a subtree, its first row emits nodes again that an earlier
range has; a summary a range (its first and last path and its number of tokens)
tells how many, and by how much its places move.  No tree and no group of
conversations is ever held in one place.  position_start counts tokens from the
root; a conversation's ancestors' attention intervals are the places of the
nodes on its path.

Template.  A conversation starts with ``<s>``; each turn is ``OPEN text CLOSE``
with marks of its role.  Marks inside texts are escaped reversibly: a run of
backslashes before a mark is doubled and one more is put before it.
"""

from __future__ import annotations

import hashlib
import re
from itertools import accumulate

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import bpe
from quarry.llm.common import small_batches, written

BOS = "<s>"
#: Opening and closing marks; roles beyond these three carry their (escaped) name.
MARKS = {"user": ("[INST]", "[/INST]"), "assistant": ("[OUT]", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
OTHER = ("[ROLE]", "[AS]", "[/ROLE]")
CONTROL = sorted({BOS, *(m for pair in MARKS.values() for m in pair), *OTHER}, key=len, reverse=True)
_CONTROL = "|".join(map(re.escape, CONTROL))
_ESCAPE = re.compile(rf"(\\*)({_CONTROL})")
_UNESCAPE = re.compile(rf"(\\+)({_CONTROL})")
_MARK = re.compile(rf"(?<!\\)(?:{_CONTROL})")
#: The role whose texts a loss is taken on.
TRAINED = "assistant"


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[1] * 2 + "\\" + m[2], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: "\\" * (len(m[1]) // 2) + m[2], text)


def segment(role: str, text: str, root: bool = False) -> tuple[str, int, int]:
    """A formatted turn, a root's with ``<s>`` before it, and where its loss mask starts and ends in it (code points; 0, 0 if it isn't trained on)."""
    body = escape(text)
    if role in MARKS:
        start, end = MARKS[role]
        head = f"{start} "
    else:
        head, end = f"{OTHER[0]} {escape(role)} {OTHER[1]} ", OTHER[2]
    if root:
        head = BOS + head
    return f"{head}{body} {end}", *((len(head), len(head) + len(body)) if role == TRAINED else (0, 0))


def parse(formatted: str) -> list[tuple[str, str]]:
    """Role and text of every turn of a formatted conversation."""
    opens = {m[0]: (role, m[1]) for role, m in MARKS.items()}
    marks = list(_MARK.finditer(formatted))
    assert marks and marks[0][0] == BOS and marks[0].start() == 0, "no start of a conversation"
    out, k = [], 1
    while k < len(marks):
        mark = marks[k]
        if mark[0] == OTHER[0]:
            role = unescape(formatted[mark.end() + 1 : marks[k + 1].start() - 1])
            body, end, k = marks[k + 1], OTHER[2], k + 1
        else:
            (role, end), body = opens[mark[0]], mark
        assert marks[k + 1][0] == end, "a turn is not closed"
        out.append((role, unescape(formatted[body.end() + 1 : marks[k + 1].start() - 1])))
        k += 2
    return out


def talks(conversations: DataFrame) -> DataFrame:
    """conv_id, roles, texts, path of each conversation; conversations: conv_id, turn, role, text.

    Turns are in order of turn (ties: role, then text; a null turn comes first); nulls count as empty.  A row
    without conv_id is a conversation of its own, so that strangers are not put together.  A conversation is one
    row, since its template needs it whole; path is a digest a turn, side by side, so a shared start is a prefix.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")).alias("t"))
    known = rows.filter("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    alone = rows.filter("conv_id is null").select("conv_id", F.array("t").alias("t"))
    both = known.unionByName(alone)
    unit = lambda t: F.md5(F.concat(F.length(t["role"]).cast("string"), F.lit(":"), t["role"], t["text"]))
    return both.select("conv_id", F.transform("t", lambda t: t["role"]).alias("roles"), F.transform("t", lambda t: t["text"]).alias("texts"), F.array_join(F.transform("t", unit), "").alias("path"))


#: Hexadecimal digits of a turn's digest in a path.
UNIT = 32
WALKED = (
    "kind int, part int, talk long, conv_id long, nodes array<string>, starts array<long>, first_new int, path string, tokens long, "
    "roles array<string>, segments array<string>, loss array<struct<a: int, b: int>>, ids array<array<int>>"
)


def _walk(path: str):
    """Walk sorted conversations: a row a conversation (kind 0) with its nodes and what it is the first to have, and a summary at the end (kind 1).

    starts: places of the nodes in the range's own stream; roles, segments, loss and ids are those of the nodes from first_new on.
    """
    names = [x.strip().split(" ")[0] for x in ("kind int", "part int", "talk long", "conv_id long", "nodes", "starts", "first_new", "path", "tokens", "roles", "segments", "loss", "ids")]
    kinds = [
        pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.int32(), pa.string(), pa.int64(),
        pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])), pa.list_(pa.list_(pa.int32())),
    ]

    def frame(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def run(batches):
        codec = bpe.load(path)
        part = TaskContext.get().partitionId()
        before, nodes, starts, total, k = "", [], [], 0, 0
        first = None
        for b in batches:
            shared, made = [], []
            paths, ids, all_roles, all_texts = (b.column(x).to_pylist() for x in ("path", "conv_id", "roles", "texts"))
            last = before
            for now, roles, texts in zip(paths, all_roles, all_texts, strict=True):
                n = _common(last, now)
                shared.append(n)
                made.append([(roles[j], *segment(roles[j], texts[j], j == 0)) for j in range(n, len(roles))])
                last = now
            # the tokenizer's own special strings are ordinary text here: no user can write one
            tokens = codec.encode([m[1] for one in made for m in one], specials=False)
            out = []
            for now, conv_id, n, new in zip(paths, ids, shared, made, strict=True):
                del nodes[n:], starts[n:]
                own = [next(tokens).tolist() for _ in new]
                for j, x in enumerate(own, n):
                    nodes.append(hashlib.blake2b(now[: UNIT * (j + 1)].encode(), digest_size=16).hexdigest())
                    starts.append(total)
                    total += len(x)
                out.append((0, part, (part << 36) + k, conv_id, list(nodes), list(starts), n, None, None, [m[0] for m in new], [m[1] for m in new], [{"a": m[2], "b": m[3]} for m in new], own))
                first = first or (now, [*starts, total])
                before, k = now, k + 1
            if out:
                yield frame(out)
        if first:
            # the first and the last row's paths and places; of the first also where its last node ends
            yield frame([(1, part, j, None, None, s, None, p, total, None, None, None, None) for j, (p, s) in enumerate((first, (before, list(starts))))])

    return run


def _common(a: str, b: str) -> int:
    """Turns that two paths have in common from the start."""
    n, k = min(len(a), len(b)), 0
    while k < n and a[k : k + UNIT] == b[k : k + UNIT]:
        k += UNIT
    return k // UNIT


CARRY = "part int, again long, base long, places array<long>"


def _carry(summaries) -> list[tuple]:
    """For each range: tokens that it emits again, the place where its own begin, and the places of the nodes it has from before.

    summaries: two rows a range, in order.  A fold over as many rows as there are ranges.
    """
    out, end, before, places = [], 0, "", []
    rows = iter(summaries)
    for head, tail in zip(rows, rows, strict=True):
        n = _common(before, head.path)
        again = head.starts[n]
        base, inherited = end - again, places[:n]
        out.append((head.part, again, base, inherited))
        places = [inherited[j] if s < again else base + s for j, s in enumerate(tail.starts)]
        before, end = tail.path, base + tail.tokens
    return out


def format_tree(conversations: DataFrame, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(tree, paths), both as written.

    tree: one row a node: node, parent ('' for a root), depth, role, segment, loss_start, loss_end (in the segment), ids,
    n_tokens, dfs_start (tokens before the node, depth-first).  A root's segment starts with ``<s>``.
    paths: talk (one a conversation), conv_id, nodes, starts (dfs_start of each node on the path).
    """
    path = path or bpe.default_path()
    spark = conversations.sparkSession
    small_batches(spark)
    rows = written(talks(conversations), "talks")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # equal conversations part by their ids
    dealt = rows.repartitionByRange(parts, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    walked = written(dealt.mapInArrow(_walk(path), WALKED), "walked")
    # two rows a range, each with one path: their number is that of the ranges
    summaries = walked.filter("kind = 1").select("part", "talk", "path", "starts", "tokens").orderBy("part", "talk").collect()
    carry = F.broadcast(spark.createDataFrame(_carry(summaries), CARRY))
    found = walked.filter("kind = 0").join(carry, "part")
    place = lambda s, j: F.when(s < F.col("again"), F.element_at("places", (j + 1).cast("int"))).otherwise(s + F.col("base"))
    paths = found.select("talk", "conv_id", "nodes", F.transform("starts", place).alias("starts"))
    new = F.arrays_zip("roles", "segments", "loss", "ids")
    own = found.select("nodes", "starts", "first_new", "again", "base", F.posexplode(new).alias("k", "x")).withColumn("depth", F.col("first_new") + F.col("k"))
    local = F.element_at("starts", F.col("depth") + 1)
    tree = own.filter(local >= F.col("again")).select(
        F.element_at("nodes", F.col("depth") + 1).alias("node"), F.when(F.col("depth") > 0, F.try_element_at("nodes", F.col("depth"))).otherwise("").alias("parent"), "depth", F.col("x.roles").alias("role"),
        F.col("x.segments").alias("segment"), F.col("x.loss.a").alias("loss_start"), F.col("x.loss.b").alias("loss_end"), F.col("x.ids").alias("ids"), F.size("x.ids").alias("n_tokens"), (local + F.col("base")).alias("dfs_start"),
    )
    return written(tree, "tree"), written(paths, "paths")


def read_back(tree: DataFrame, paths: DataFrame) -> DataFrame:
    """Each conversation put together from the tree's nodes and parsed again:

    conv_id, formatted, turns (array of role, text), loss_spans (start, end in formatted), loss_text,
    position_starts (tokens from the root, a node each), intervals (dfs_start, dfs_end of each ancestor, itself last).
    """
    small_batches(tree.sparkSession)
    steps = paths.select("talk", "conv_id", F.posexplode("nodes").alias("depth", "node"))
    nodes = tree.select("node", F.struct("segment", "loss_start", "loss_end", "n_tokens", "dfs_start").alias("n"))
    # a plain equi-join: a node that many conversations share is split by adaptive execution
    joined = steps.join(nodes, "node").groupBy("talk", "conv_id").agg(F.array_sort(F.collect_list(F.struct("depth", "n"))).alias("s"))
    field = lambda name: F.transform("s", lambda x: x["n"][name])
    rows = joined.select(
        "conv_id", field("segment").alias("segments"), field("n_tokens").alias("n_tokens"),
        F.filter(F.transform("s", lambda x, j: F.struct(j.alias("j"), x["n"]["loss_start"].alias("a"), x["n"]["loss_end"].alias("b"))), lambda x: x["b"] > 0).alias("loss"),
        F.transform("s", lambda x: F.struct(x["n"]["dfs_start"].alias("start"), (x["n"]["dfs_start"] + x["n"]["n_tokens"]).alias("end"))).alias("intervals"),
    )
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    turns = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
    names = ["conv_id", "formatted", "turns", "loss_spans", "loss_text", "position_starts", "intervals"]

    def run(batches):
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for segments, counts, loss in zip(*(b.column(x).to_pylist() for x in ("segments", "n_tokens", "loss")), strict=True):
                formatted = "".join(segments)
                at = [0, *accumulate(map(len, segments))]
                marked = [(at[x["j"]] + x["a"], at[x["j"]] + x["b"]) for x in loss]
                for to, v in zip(
                    out,
                    (
                        formatted, [{"role": r, "text": t} for r, t in parse(formatted)], [{"start": x, "end": y} for x, y in marked],
                        "".join(unescape(formatted[x:y]) for x, y in marked), [0, *accumulate(counts)][:-1],
                    ),
                    strict=True,
                ):
                    to.append(v)
            kinds = [pa.string(), turns, spans, pa.string(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), *(pa.array(c, type=k) for c, k in zip(out, kinds, strict=True)), b.column("intervals")], names=names)

    schema = "conv_id long, formatted string, turns array<struct<role: string, text: string>>, loss_spans array<struct<start: int, end: int>>, loss_text string, position_starts array<long>, intervals array<struct<start: long, end: long>>"
    return rows.mapInArrow(run, schema)


def format_chats(conversations: DataFrame, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(tree, conversations read back).  Empty input gives empty tables; repeated rows of a conversation are turns of their own;
    a conversation that repeats another under a new conv_id adds no node; rows without conv_id are conversations of one turn."""
    tree, paths = format_tree(conversations, path)
    return tree, read_back(tree, paths)


def digests(read: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, from what read_back() parsed."""
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )

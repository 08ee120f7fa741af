"""Pull: nested documents of entities.

``pull_frame`` compiles a pattern without unbounded recursion to joins and
structs, a row an entity.  ``pull`` reads the facts of one entity, or of a level
of entities at a time, and returns Python values; that form takes every pattern.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry import edn
from quarry.edn import Keyword, Seq, Symbol
from quarry.functions.callables import as_column
from quarry.plans.compiler import attr_name
from quarry.plans.query import QueryError
from quarry.sources.database import Attr, Database, _widen, untag

LIMIT = 1000
XFORMS = {"identity": lambda v: v, "vector": lambda v: [v], "name": lambda v: v.name if isinstance(v, Keyword) else v, "namespace": lambda v: v.namespace if isinstance(v, Keyword) else None, "str": lambda v: "" if v is None else edn.write(v, False)}


@dataclass
class Selector:
    attr: str  # ":db/id", "*" or an attribute as it is written
    name: str = ""
    reverse: bool = False
    key: object = None
    default: object = None
    limit: int | None = LIMIT
    xform: object = None
    nested: list | None = None
    depth: int | None = None  # recursion: so many levels, -1 without bound
    options: set = field(default_factory=set)


def parse_pattern(form) -> list[Selector]:
    if isinstance(form, str) and not isinstance(form, (Keyword, Symbol)):
        form = edn.read(form)
    if not isinstance(form, list):
        raise QueryError(f"Expected pull pattern, got {edn.write(form)}")
    out: list[Selector] = []
    for x in form:
        if isinstance(x, dict):
            for k, v in x.items():
                s = _selector(list(k) if isinstance(k, tuple) else k)
                if v == "...":
                    s.depth = -1
                elif isinstance(v, int) and not isinstance(v, bool):
                    if v <= 0:
                        raise QueryError("a recursion limit must be positive")
                    s.depth = v
                else:
                    s.nested = parse_pattern(v)
                out.append(s)
        else:
            out.append(_selector(x))
    return out


def _selector(x) -> Selector:
    if x in ("*", ":*"):
        return Selector("*")
    if isinstance(x, (list, Seq)):
        if x and x[0] in ("limit", "default") and isinstance(x[0], Symbol):
            s = _selector(x[1])
            return _option(s, Keyword(f":{x[0]}"), x[2])
        s = _selector(x[0])
        if len(x) % 2 == 0:
            raise QueryError(f"an option without a value in {edn.write(x)}")
        for k, v in zip(x[1::2], x[2::2], strict=True):
            s = _option(s, k, v)
        return s
    if not isinstance(x, (Keyword, str)):
        raise QueryError(f"cannot parse pull attribute {edn.write(x)}")
    if x == ":db/id":
        return Selector(":db/id", ":db/id", key=x)
    name, reverse = attr_name(x)
    return Selector(str(x), name, reverse, key=Keyword(x))


def _option(s: Selector, k, v) -> Selector:
    if k == ":as":
        s.key = v
    elif k == ":default":
        s.default = v
    elif k == ":limit":
        if v is not None and (not isinstance(v, int) or v <= 0):
            raise QueryError("a pull limit must be a positive number or nil")
        s.limit = v
    elif k == ":xform":
        f = XFORMS.get(str(v)) if not callable(v) else v
        if f is None:
            raise QueryError(f"Can't resolve symbol {v}")
        s.xform = f
    else:
        raise QueryError(f"unknown pull option {edn.write(k)}")
    s.options.add(str(k))
    return s


# ---- Python documents -----------------------------------------------------------------------------------------------


class _Facts:
    """Facts of entities, read attribute by attribute for a whole level at once and kept."""

    def __init__(self, db: Database, visitor=None):
        self.db = db
        self.visit = visitor or (lambda *event: None)
        self.forward: dict[int, dict[str, list]] = {}
        self.backward: dict[tuple[str, int], list[int]] = {}

    def load(self, ids: list[int]) -> None:
        new = [i for i in dict.fromkeys(ids) if i not in self.forward]
        if not new:
            return
        for i in new:
            self.forward[i] = {}
        db = self.db
        for r in db.datoms_frame().filter(F.col("e").isin(new)).collect():
            self.forward[r.e].setdefault(r.a, []).append(untag(r.v))
        for facts in self.forward.values():
            for a in facts:
                facts[a] = sorted(facts[a], key=lambda v: (str(type(v)), v) if not isinstance(v, (int, float)) else ("", v))

    def referrers(self, attr: str, e: int) -> list[int]:
        """Of an entity; those of all entities that are known by now are read in the same job."""
        if (attr, e) not in self.backward:
            ids = [i for i in {e, *self.forward} if (attr, i) not in self.backward]
            self.backward |= {(attr, i): [] for i in ids}
            for r in self.db.relation(attr).filter(F.col("v").isin(ids)).select("e", "v").orderBy("e").collect():
                self.backward[attr, r.v].append(r.e)
        return self.backward[attr, e]


def pull(db: Database, pattern, ref, visitor=None):
    """The document of one entity; None if it names none or nothing is found.

    visitor is called with each read: ("attr", e, a), ("wildcard", e) or ("reverse", a, e).
    """
    found = pull_many(db, pattern, [ref], visitor)
    return found[0]


def pull_many(db: Database, pattern, refs: list, visitor=None) -> list:
    """A document (or None) for each ref, in order."""
    spec = parse_pattern(pattern)
    facts = _Facts(db, visitor)
    ids = [db.entid(r) for r in refs]
    facts.load([i for i in ids if i is not None])
    return [_document(facts, spec, i, {}, frozenset()) if i is not None else None for i in ids]


def _document(facts: _Facts, spec: list[Selector], e: int, depths: dict, seen: frozenset):
    db = facts.db
    facts.load([e])
    own = facts.forward[e]
    out: dict = {}
    real = False
    named = {s.name for s in spec if not s.reverse}
    for s in spec:
        if s.attr == ":db/id":
            if own or any(x.reverse for x in spec):
                out[s.key] = s.xform(e) if s.xform else e
            continue
        if s.attr == "*":
            facts.visit("wildcard", e)
            for a in own:
                if a not in named:
                    facts.visit("attr", e, a)
                    v = _value(facts, Selector(a, a, key=Keyword(a)), e, spec, depths, seen, expand=db.schema.get(a, Attr()).component)
                    if v is not None:
                        out[Keyword(a)] = v
            if own:
                out[Keyword(":db/id")] = e
            continue
        facts.visit(*(("reverse", s.name, e) if s.reverse else ("attr", e, s.name)))
        v = _value(facts, s, e, spec, depths, seen, expand=False)
        real = real or v is not None
        if v is None and ":default" in s.options:
            v = s.default
        elif s.xform:
            v = s.xform(v)
        if v is not None:
            out[s.key] = v
    if not own and not real:
        return None  # defaults alone make no document
    return out or None


def _value(facts: _Facts, s: Selector, e: int, spec, depths: dict, seen: frozenset, expand: bool):
    schema = facts.db.schema.get(s.name, Attr())
    if s.reverse:
        values, many, ref = facts.referrers(s.name, e), not schema.component, True
    else:
        values, many, ref = facts.forward[e].get(s.name, []), schema.many, schema.ref
        if not many and len(values) > 1:
            values = values[-1:]
    if not values:
        return None
    if many and s.limit is not None:
        values = values[: s.limit]
    if ref:
        facts.load(values)
        docs = []
        for v in values:
            if s.depth is not None:
                left = depths.get(s.attr, s.depth)
                if v in seen or left == 0:
                    doc = {Keyword(":db/id"): v} if left != 0 else None
                else:
                    doc = _document(facts, spec, v, depths | {s.attr: left - 1 if left > 0 else left}, seen | {e})
            elif s.nested is not None:
                doc = _document(facts, s.nested, v, {}, frozenset())
            elif expand and v not in seen:
                doc = _document(facts, [Selector("*")], v, {}, seen | {e}) or {Keyword(":db/id"): v}
            elif schema.component and not s.reverse and v not in seen:
                doc = _document(facts, [Selector("*")], v, {}, seen | {e}) or {Keyword(":db/id"): v}
            else:
                doc = {Keyword(":db/id"): v}
            if doc is not None:
                docs.append(doc)
        values = docs
        if not values:
            return None
    return list(values) if many else values[0]


# ---- frames ---------------------------------------------------------------------------------------------------------


def _name(key) -> str:
    return str(key).lstrip(":")


def _xform(f, c: Column) -> Column:
    """An :xform over a column: those of XFORMS by Spark's functions, others are functions of Columns."""
    if f is XFORMS["identity"]:
        return c
    if f is XFORMS["vector"]:
        return F.when(c.isNotNull(), F.array(c))
    if f is XFORMS["str"]:
        return F.coalesce(c.cast("string"), F.lit(""))
    bare_name = F.regexp_replace(c.cast("string"), "^:", "")
    if f is XFORMS["name"]:
        return F.element_at(F.split(bare_name, "/"), -1)
    if f is XFORMS["namespace"]:
        return F.when(F.instr(bare_name, "/") > 0, F.regexp_extract(bare_name, "^(.*)/", 1))
    return as_column(":xform", f, [c], False)


def pull_frame(db: Database, pattern, ids: DataFrame | None = None) -> DataFrame:
    """e and a struct column ``pulled`` for each id of ``ids`` (column e), or for every entity that has any named attribute.

    Attributes, :as, :default, :limit, :xform, nested patterns, reverse attributes and recursion of a given depth.
    ``*`` gives every attribute of the database its own typed field, components as nested structs (an attribute is
    not expanded inside itself).  Entities of which nothing is found are dropped.
    """
    spec = parse_pattern(pattern)
    one = _one_table(db, spec)
    if ids is None and one:
        # all from one table: its rows are the entities
        base = _table_columns(db, one, [(k, s) for k, s in enumerate(spec) if s.attr != ":db/id"], 0)
        out, fields = _columns(db, spec, base, 0, done=set(base.columns))
    else:
        out, fields = _columns(db, spec, (_entities(db, spec) if ids is None else ids).select("e").distinct(), 0)
    some = F.lit(False)
    for f, given in fields:
        if not given:
            some = some | F.col(f"`{f}`").isNotNull()
    if any(not given for _, given in fields):
        out = out.filter(some)
    return out.select("e", F.struct(*[F.col(f"`{f}`").alias(f.split("__", 1)[1]) for f, _ in fields]).alias("pulled"))


def _entities(db: Database, spec: list[Selector]) -> DataFrame:
    out = None
    for s in spec:
        if s.attr == ":db/id":
            continue
        one = db.datoms_frame().select("e") if s.attr == "*" else db.relation(s.name).select((F.col("v") if s.reverse else F.col("e")).cast("bigint").alias("e"))
        out = one if out is None else out.unionByName(one)
    return out.distinct()


def _plain(db: Database, s: Selector) -> str | None:
    """The table whose column a selector reads as it is: one value an entity, nothing nested."""
    schema = db.schema.get(s.name, Attr())
    if s.attr in ("*", ":db/id") or s.reverse or s.nested is not None or s.depth is not None or schema.many or schema.ref or s.name not in db.virtual:
        return None
    table = db.virtual[s.name][0]
    return table if db.one_row_each(table) else None


def _one_table(db: Database, spec: list[Selector]) -> str | None:
    found = {_plain(db, s) for s in spec if s.attr != ":db/id"}
    return found.pop() if len(found) == 1 else None


def _field(s: Selector, k: int, level: int) -> str:
    return f"{level}_{k}__{_name(s.key)}"


def _table_columns(db: Database, table: str, own: list[tuple[int, Selector]], level: int) -> DataFrame:
    """e and the selectors' columns of one table, in one scan."""
    t = db.tables[table]
    e = t.entity()
    cols = []
    for k, s in own:
        c = _widen(F.col(f"`{db.virtual[s.name][1]}`"), db.kind(s.name))
        if db.condition is not None:
            c = F.when(db.condition(s.name, e, c), c)
        cols.append(c.alias(_field(s, k, level)))
    out = t.rows().select(e.alias("e"), *cols)
    some = F.lit(False)
    for k, s in own:
        some = some | F.col(f"`{_field(s, k, level)}`").isNotNull()
    return out.filter(some)


def _star(db: Database, spec: list[Selector], seen: tuple) -> list[Selector]:
    """``*`` as a selector for each attribute that is not named otherwise; components expand, but never inside themselves."""
    named = {s.name for s in spec if s.attr != "*" and not s.reverse}
    out = [Selector(":db/id", ":db/id", key=Keyword(":db/id"))] if all(s.attr != ":db/id" for s in spec) else []
    for a in db.attrs():
        if a in named or a in seen:
            continue
        s = Selector(a, a, key=Keyword(a))
        if db.schema.get(a, Attr()).component:
            s.nested = _star(db, [], (*seen, a))
        out.append(s)
    return out


def _columns(db: Database, spec: list[Selector], ids: DataFrame, level: int, done: set | None = None) -> tuple[DataFrame, list[tuple[str, bool]]]:
    """ids with a column a selector, and their names; the flag says that the column is there for any entity.

    Plain columns of one table come from one scan and one join, whatever their number; done: columns that ids has.
    """
    if any(s.attr == "*" for s in spec):
        spec = [y for s in spec for y in (_star(db, spec, ()) if s.attr == "*" else [s])]
    out, fields, done = ids, [], done or set()
    by: dict[str, list[tuple[int, Selector]]] = {}
    for k, s in enumerate(spec):
        table = _plain(db, s)
        if table and _field(s, k, level) not in done:
            by.setdefault(table, []).append((k, s))
    for table, own in by.items():
        out = out.join(_table_columns(db, table, own, level), "e", "left")
        done = done | {_field(s, k, level) for k, s in own}
    for k, s in enumerate(spec):
        n = _field(s, k, level)
        if s.attr == ":db/id":
            out = out.withColumn(n, F.col("e"))
            fields.append((n, True))
            continue
        if n not in done:
            out = out.join(_selected(db, spec, s, n, level), "e", "left")
        if s.xform:
            out = out.withColumn(n, _xform(s.xform, F.col(f"`{n}`")))
        if ":default" in s.options:
            out = out.withColumn(n, F.coalesce(F.col(f"`{n}`"), F.lit(s.default)))
        fields.append((n, False))
    return out, fields


def _selected(db: Database, spec: list[Selector], s: Selector, n: str, level: int) -> DataFrame:
    """e and the values of one selector."""
    schema = db.schema.get(s.name, Attr())
    rel = db.relation(s.name).select("e", "v")
    if s.reverse:
        rel = rel.select(F.col("v").cast("bigint").alias("e"), F.col("e").alias("v"))
    many = not schema.component if s.reverse else schema.many
    nested = s.nested
    if s.depth is not None:
        if s.depth < 0:
            raise QueryError("a frame has no type for recursion without bound; use pull()")
        nested = [Selector(**{**x.__dict__, "depth": s.depth - 1}) if x is s else x for x in spec if x is not s or s.depth > 1]
    if nested is not None:
        inner, cols = _columns(db, nested, rel.select(F.col("v").cast("bigint").alias("e")).distinct(), level + 1)
        some = F.lit(False)
        for f, given in cols:
            if not given:
                some = some | F.col(f"`{f}`").isNotNull()
        if any(not g for _, g in cols):
            inner = inner.filter(some)
        doc = F.struct(*[F.col(f"`{f}`").alias(f.split("__", 1)[1]) for f, _ in cols])
        rel = rel.join(inner.select(F.col("e").alias("v"), doc.alias("doc")), "v").select("e", F.col("doc").alias("v"))
    if many:
        values = F.array_sort(F.collect_list("v"))
        return rel.groupBy("e").agg((F.slice(values, 1, s.limit) if s.limit is not None else values).alias(n))
    return rel.groupBy("e").agg(F.max("v").alias(n)) if nested is None else rel.groupBy("e").agg(F.first("v").alias(n))

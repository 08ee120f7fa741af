"""Where clauses to one DataFrame plan.

The state is a frame with a column a bound variable.  Patterns about one entity
of one wide table become one scan; clauses run in an order in which their inputs
are bound, connected patterns first, so that no product arises that the query
does not ask for.  Physical choices are Catalyst's.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry import edn
from quarry.edn import Keyword, Symbol
from quarry.functions.callables import as_column
from quarry.functions.registry import COLLECTIONS, FUNCTIONS, PREDICATES, Arg, Result, bare, equal
from quarry.plans.query import Call, InsufficientBindings, Not, Or, Pattern, QueryError, Rule, RuleCall, clause_vars, is_source, is_var
from quarry.sources.database import Attr, Database, TAGGED, kind_of, kind_of_type, literal, tagged

_fresh = itertools.count()
TAGGED_TYPE = TAGGED.replace(" ", "")


@dataclass
class State:
    df: DataFrame | None = None
    vars: dict[str, str] = field(default_factory=dict)  # variable -> kind; its column has the same name

    def col(self, var: str) -> Column:
        return F.col(f"`{var}`")


@dataclass
class Env:
    spark: object
    sources: dict[str, object]
    rules: dict[str, list[Rule]] = field(default_factory=dict)
    consts: dict[str, object] = field(default_factory=dict)
    callables: dict[str, object] = field(default_factory=dict)
    relations: dict[str, tuple[DataFrame, list[str], list[str]]] = field(default_factory=dict)  # of recursive rules
    max_rounds: int = 1000

    def database(self, source: str) -> Database:
        if source not in self.sources:
            raise QueryError(f"unknown source {source}")
        return self.sources[source]


def one_row(env: Env) -> DataFrame:
    return env.spark.range(0, 1, 1, 1).select()


# ---- joining states --------------------------------------------------------------------------------------------------


def join(a: State, b: State, how: str = "inner") -> State:
    """Equi-join on all shared variables; strict types, tagged where kinds differ."""
    if a.df is None:
        return b
    if b.df is None:
        return a
    shared = [v for v in b.vars if v in a.vars]
    if not shared:
        if how == "left_anti":
            return State(a.df.join(b.df.select(), how=how), a.vars)
        return State(a.df.crossJoin(b.df), a.vars | b.vars)
    right, on = b.df, F.lit(True)
    for v in shared:
        n = f"j{next(_fresh)}"
        right = right.withColumnRenamed(v, n)
        x, y, kx, ky = F.col(f"`{v}`"), F.col(n), a.vars[v], b.vars[v]
        ids = {"long", "entity"}
        if kx != ky and not {kx, ky} <= ids and "unknown" not in (kx, ky):
            x, y = tagged(x, kx), tagged(y, ky)
        # bindings are never NULL, so plain equality joins them (and can be hashed)
        on = on & (x == y)
        if how == "inner":
            b = State(b.df, {k: v2 for k, v2 in b.vars.items() if k != v})
    out = a.df.join(right, on, how)
    kinds = a.vars | b.vars if how == "inner" else a.vars
    for v in shared:
        if how == "inner" and b.vars.get(v) == "entity":
            kinds[v] = "entity"
    return State(out.select(*[f"`{v}`" for v in kinds]), kinds)


def bind(state: State, var: str, r: Result) -> State:
    """Bind a result to a variable; a bound one filters."""
    if var in state.vars:
        out = state.df.filter(equal(Arg(state.col(var), state.vars[var]), Arg(r.col, r.kind)))
        return State(out, state.vars)
    name = str(var)
    df = state.df.withColumn(name, r.col)
    kind = r.kind if r.kind != "unknown" else kind_of_type(df.schema[name].dataType)
    if r.drop:
        df = df.filter(F.col(f"`{name}`").isNotNull())
    return State(df, state.vars | {var: kind})


# ---- terms -----------------------------------------------------------------------------------------------------------


def arg(env: Env, state: State, term) -> Arg:
    if is_var(term):
        if term in state.vars:
            kind = state.vars[term]
            return Arg(state.col(term), kind, elem=state.df.schema[str(term)].dataType if kind in COLLECTIONS else None)
        if term in env.consts:
            term = env.consts[term]
        else:
            raise InsufficientBindings(f"Insufficient bindings: {term} not bound")
    col, kind = literal(term)
    return Arg(col, kind, term, True)


def bound(env: Env, state: State, term) -> bool:
    return not is_var(term) or term in state.vars or term in env.consts


# ---- patterns --------------------------------------------------------------------------------------------------------


def attr_name(term) -> tuple[str, bool]:
    """Name, and whether it is written reversed (ns/_name)."""
    a = str(term)
    space, slash, name = a.rpartition("/")
    if slash and name.startswith("_"):
        return f"{space}/{name[1:]}", True
    if not slash and a.startswith(":_"):
        return f":{a[2:]}", True
    return a, False


def _entity_term(env: Env, db: Database, term):
    """A constant in entity position as an id; None if it names none."""
    if isinstance(term, (list, tuple)) and len(term) == 2 or isinstance(term, Keyword):
        return db.entid(list(term) if isinstance(term, (list, tuple)) else term)
    return term


def _match(env: Env, db: Database | None, df: DataFrame, columns: list[tuple[str, str, object]]) -> State:
    """columns: (column, kind, term) of one relation; constants filter, variables become columns, repeated ones must agree."""
    kinds: dict[str, str] = {}
    out = []
    for c, kind, term in columns:
        col = F.col(f"`{c}`")
        if term is None or term == "_" or (isinstance(term, Symbol) and not is_var(term)):
            continue
        if is_var(term) and term in env.consts:
            term = env.consts[term]
        if is_var(term):
            if term in kinds:
                first = next(x for x in out if x[0] == term)
                df = df.filter(equal(Arg(first[1], kinds[term]), Arg(col, kind)))
                continue
            kinds[term] = kind
            out.append((term, col))
            continue
        if kind == "entity" and db is not None:
            term = _entity_term(env, db, term)
            if term is None:
                df = df.filter(F.lit(False))
                continue
        lit, lk = literal(term)
        if {lk, kind} <= {"array", "list"} and df.schema[c].dataType.elementType.simpleString() == TAGGED_TYPE:
            df = df.filter(col == F.array(*[tagged(*literal(x)) for x in term]))
        elif kind == "any" or (lk != kind and {lk, kind} != {"long", "entity"}):
            df = df.filter(tagged(col, kind) == tagged(lit, lk))
        else:
            df = df.filter(col == lit)
    return State(df.select(*[c.alias(v) for v, c in out]), kinds)


def relation_pattern(env: Env, frame: DataFrame, terms: list) -> State:
    if len(terms) > len(frame.columns):
        raise QueryError("a relation pattern has more terms than the relation has columns")
    names = frame.columns
    plain = frame.select(*[(F.col(f"`{n}`").cast("bigint") if kind_of_type(f.dataType) == "long" else F.col(f"`{n}`")).alias(f"c{k}") for k, (n, f) in enumerate(zip(names, frame.schema.fields, strict=True))])
    return _match(env, None, plain, [(f"c{k}", kind_of_type(frame.schema.fields[k].dataType), t) for k, t in enumerate(terms)])


def single_pattern(env: Env, p: Pattern) -> State:
    src = env.sources.get(p.source)
    if src is None:
        raise QueryError(f"unknown source {p.source}")
    if isinstance(src, DataFrame):
        return relation_pattern(env, src, p.terms)
    db: Database = src
    e, a, v, tx, op = [*p.terms, *[Symbol("_")] * 5][:5]
    if is_var(a) and a in env.consts:
        a = env.consts[a]
    if is_var(a) or a == "_":
        all_ = db.datoms_frame().withColumn("op", F.when(F.col("added"), ":db/add").otherwise(":db/retract"))
        return _match(env, db, all_, [("e", "entity", e), ("a", "keyword", a), ("v", "any", v), ("tx", "entity", tx), ("op", "keyword", op)])
    name, reverse = attr_name(a)
    if reverse:
        e, v = v, e
    rel = db.relation(name).withColumn("op", F.when(F.col("added"), ":db/add").otherwise(":db/retract"))
    kind = "entity" if db.schema.get(name, Attr()).ref and db.kind(name) in ("long", "entity") else db.kind(name)
    return _match(env, db, rel, [("e", "entity", e), ("v", kind, v), ("tx", "entity", tx), ("op", "keyword", op)])


def star(env: Env, db: Database, table: str, e, parts: list[tuple[str, object]], need_entity: bool) -> State:
    """Patterns about one entity of one wide table: a single scan of the named columns."""
    t = db.tables[table]
    cols: list[tuple[str, str, object]] = []
    picked: list[Column] = []
    present: Column | None = None
    for k, (attr, term) in enumerate(parts):
        column, kind = db.virtual[attr][1], db.kind(attr)
        if db.schema.get(attr, Attr()).ref:
            kind = "entity"
        c = F.col(f"`{column}`")
        present = c.isNotNull() if present is None else present & c.isNotNull()
        picked.append((c.cast("bigint") if kind in ("long", "entity") else c.cast("double") if kind == "double" else c).alias(f"c{k}"))
        cols.append((f"c{k}", kind, term))
    if need_entity or not is_var(e):
        picked.append(t.entity().alias("e"))
        cols.append(("e", "entity", e))
    frame = t.rows() if need_entity or not is_var(e) or db.condition is not None else t.frame
    if db.condition is not None:
        for attr, _ in parts:
            frame = frame.filter(db.condition(attr, t.entity(), F.col(f"`{db.virtual[attr][1]}`")))
    return _match(env, db, frame.filter(present).select(*picked), cols)


def pattern_groups(env: Env, patterns: list[Pattern], used: dict[str, int]) -> list[State]:
    """The patterns' relations; used: how many times each variable stands in the whole query."""
    out, stars = [], {}
    for p in patterns:
        src = env.sources.get(p.source)
        if isinstance(src, Database) and len(p.terms) <= 3 and len(p.terms) >= 2 and not is_var(p.terms[1]) and p.terms[1] != "_":
            name, reverse = attr_name(p.terms[1])
            if not reverse and name in src.virtual and is_var(p.terms[0]) and p.terms[0] not in env.consts:
                stars.setdefault((p.source, src.virtual[name][0], p.terms[0]), []).append((name, p.terms[2] if len(p.terms) > 2 else Symbol("_")))
                continue
        out.append(single_pattern(env, p))
    for (source, table, e), parts in stars.items():
        need = used.get(e, 0) > len(parts) or any(t == e for _, t in parts)
        out.append(star(env, env.sources[source], table, e, parts, need))
    return out


# ---- calls -----------------------------------------------------------------------------------------------------------


def destructure(env: Env, state: State, binding, r: Result) -> State:
    """Bind a result: ?x, [?x ...], [?x ?y], [[?x ?y] ...] or [[?x ?y]]; _ ignores."""
    if r.rows:
        n = f"x{next(_fresh)}"
        state = State(state.df.withColumn(n, F.explode(r.col)), state.vars)
        target = binding[0] if isinstance(binding, list) else binding
        return _drop(bind(state, target, Result(F.col(n), r.kind)), n) if is_var(target) else State(state.df.drop(n), state.vars)
    if is_var(binding):
        return bind(state, binding, r)
    if binding == "_":
        return state
    if not isinstance(binding, list):
        raise QueryError(f"cannot parse binding {edn.write(binding)}")
    many = len(binding) == 2 and binding[1] == "..."
    relation = isinstance(binding[0], list)
    if many or relation:
        n = f"x{next(_fresh)}"
        df = state.df.withColumn(n, F.explode(r.col))
        inner = binding[0]
        state = State(df, state.vars)
        kind = kind_of_type(df.schema[n].dataType)
        return _drop(destructure(env, state, inner, Result(F.col(n), kind)), n)
    n = f"x{next(_fresh)}"
    df = state.df.withColumn(n, r.col)
    state = State(df, state.vars)
    t = df.schema[n].dataType
    for k, target in enumerate(binding):
        if target == "_":
            continue
        part = F.col(n)[t.fieldNames()[k]] if hasattr(t, "fieldNames") else F.get(F.col(n), F.lit(k))
        state = destructure(env, state, target, Result(part, "unknown", True))
    return _drop(state, n)


def _drop(state: State, n: str) -> State:
    return State(state.df.drop(n), state.vars)


def literal_rows(env: Env, value, binding) -> State:
    """A Python value destructured into a frame, for ground and inputs."""
    rows: list[dict] = []

    def match(b, v) -> list[dict]:
        if is_var(b):
            return [{b: v}]
        if b == "_":
            return [{}]
        if len(b) == 2 and b[1] == "...":
            return [m for x in (map(list, v.items()) if isinstance(v, dict) else v) for m in match(b[0], x)]
        if len(b) == 1 and isinstance(b[0], list) or len(b) == 2 and isinstance(b[0], list) and b[1] == "...":
            return [m for x in (v.items() if isinstance(v, dict) else v) for m in match(b[0], list(x))]
        if len(list(v)) < len(b):
            raise QueryError(f"Not enough elements in a collection {edn.write(v)} to match tuple {edn.write(b)}")
        out = [{}]
        for x, y in zip(b, v, strict=False):
            out = [m | n for m in out for n in match(x, y)]
        return out

    rows = match(binding, value)
    names = [v for v in dict.fromkeys(_names(binding))]
    if not rows:
        kinds = dict.fromkeys(names, "string")
        return State(env.spark.createDataFrame([], ", ".join(f"`{n}` string" for n in names) or "x int").select(*[f"`{n}`" for n in names]), kinds)
    from quarry.sources.database import SPARK, tag_value

    kinds, types, cols = {}, {}, []
    for n in names:
        found = {kind_of(r[n]) for r in rows}
        kinds[n] = found.pop() if len(found) == 1 else "any"
        element = _element_type([r[n] for r in rows]) if kinds[n] in ("array", "set") else None
        if element:
            types[n] = f"array<{element}>"
            cols.append([[str(x) if isinstance(x, Symbol | Keyword) else x for x in (sorted(r[n]) if kinds[n] == "set" else r[n])] for r in rows])
            continue
        if kinds[n] in ("array", "set", "map", "nil", "regex"):
            kinds[n] = "any"
        types[n] = TAGGED if kinds[n] == "any" else SPARK[kinds[n]]
        cols.append([tag_value(r[n]) if kinds[n] == "any" else str(r[n]) if kinds[n] in ("keyword", "symbol", "uuid") else r[n] for r in rows])
    ddl = ", ".join(f"`{n}` {types[n]}" for n in names)
    if not names:
        return State(one_row(env), {})
    out = env.spark.createDataFrame(list(zip(*cols, strict=True)), ddl)
    # a few rows are one partition, so that a product with them has no more tasks than the other side
    return State(out.coalesce(1) if len(rows) <= 10_000 else out, kinds)


def _element_type(values: list) -> str | None:
    """The Spark type of the elements of collections that all hold scalars of one kind."""
    from quarry.sources.database import SPARK

    found = {kind_of(x) for v in values for x in v}
    kind = found.pop() if len(found) == 1 else None
    return SPARK.get(kind) if kind not in ("any", "ts") else None


def _names(b):
    if is_var(b):
        yield b
    elif isinstance(b, list):
        for x in b:
            yield from _names(x)


def call(env: Env, state: State, c: Call) -> State:
    if state.df is None:
        state = State(one_row(env), {})
    name = c.name
    # ((complement p) args)
    if isinstance(name, list) and name and name[0] == "complement":
        test = PREDICATES[bare(name[1])]
        return State(state.df.filter(~test([arg(env, state, a) for a in c.args])), state.vars)
    if name in ("missing?", "get-else", "get-some"):
        return attribute_call(env, state, c)
    if name == "ground" and not (is_var(c.args[0]) and c.args[0] in state.vars):
        value = env.consts.get(c.args[0], c.args[0]) if is_var(c.args[0]) else c.args[0]
        return join(state, literal_rows(env, value, c.binding)) if _names_list(c.binding) else state
    if is_var(name) or name in env.callables:
        f = env.callables.get(name)
        if f is None:
            raise QueryError(f"Unknown predicate or function '{name}'")
        args = [arg(env, state, a) for a in c.args if not is_source(a)]
        out = as_column(str(name), f, [a.col for a in args], c.binding is None)
        if c.binding is None:
            return State(state.df.filter(F.coalesce(out.cast("boolean"), F.lit(False))), state.vars)
        return destructure(env, state, c.binding, Result(out, "unknown", True))
    key = bare(str(name))
    if c.binding is None:
        if key not in PREDICATES:
            raise QueryError(f"Unknown predicate '{name}' in {edn.write([edn.Seq([name, *c.args])])}")
        return State(state.df.filter(PREDICATES[key]([arg(env, state, a) for a in c.args])), state.vars)
    if key in FUNCTIONS:
        return destructure(env, state, c.binding, FUNCTIONS[key]([arg(env, state, a) for a in c.args]))
    if key in PREDICATES:
        return destructure(env, state, c.binding, Result(PREDICATES[key]([arg(env, state, a) for a in c.args]), "bool"))
    raise QueryError(f"Unknown function '{name}' in {edn.write([edn.Seq([name, *c.args]), c.binding])}")


def _names_list(b) -> list:
    return list(_names(b))


def attribute_call(env: Env, state: State, c: Call) -> State:
    """missing?, get-else and get-some: source, entity, then attributes."""
    args = list(c.args)
    source = args.pop(0) if is_source(args[0]) else c.source
    db = env.database(source)
    e = arg(env, state, args[0])
    if e.const and not isinstance(e.value, int):
        e = Arg(F.lit(db.entid(e.value)).cast("bigint"), "entity")

    def first(attr, n: str) -> DataFrame:
        name, reverse = attr_name(attr)
        rel = db.relation(name)
        if reverse:
            rel = rel.select(F.col("v").alias("e"), F.col("e").alias("v"))
        # several values of a many-valued attribute count as its first
        if db.schema.get(name, Attr()).many or reverse:
            rel = rel.groupBy("e").agg(F.min("v").alias("v"))
        return rel.select(F.col("e").alias(f"{n}e"), F.col("v").alias(f"{n}v"))

    if c.name == "missing?":
        n = f"m{next(_fresh)}"
        return State(state.df.join(first(args[1], n).select(f"{n}e"), e.col == F.col(f"{n}e"), "left_anti"), state.vars)
    if c.name == "get-else":
        default = arg(env, state, args[2])
        if default.kind == "nil":
            raise QueryError("get-else: nil default value is not supported")
        n = f"g{next(_fresh)}"
        kind = db.kind(attr_name(args[1])[0])
        df = state.df.join(first(args[1], n), e.col == F.col(f"{n}e"), "left")
        same = kind == default.kind or {kind, default.kind} <= {"long", "entity"}
        v = F.coalesce(F.col(f"{n}v"), default.col) if same else F.coalesce(tagged(F.col(f"{n}v"), kind), tagged(default.col, default.kind))
        out = destructure(env, State(df, state.vars), c.binding, Result(v, kind if same else "any"))
        return State(out.df.drop(f"{n}e", f"{n}v"), out.vars)
    df, choice, drop = state.df, [], []
    for attr in args[1:]:
        n = f"s{next(_fresh)}"
        df = df.join(first(attr, n), e.col == F.col(f"{n}e"), "left")
        drop += [f"{n}e", f"{n}v"]
        name = attr_name(attr)[0]
        choice.append(F.when(F.col(f"{n}v").isNotNull(), F.struct(F.lit(str(attr)).alias("a"), tagged(F.col(f"{n}v"), db.kind(name)).alias("v"))))
    n = f"s{next(_fresh)}"
    df = df.withColumn(n, F.coalesce(*choice)).filter(F.col(n).isNotNull())
    a, v = c.binding
    out = State(df, state.vars)
    for target, part, kind in ((a, "a", "keyword"), (v, "v", "any")):
        if is_var(target):
            out = bind(out, target, Result(F.col(n)[part], kind))
    return State(out.df.drop(n, *drop), out.vars)


def rows_differ(env: Env, clauses: list, keep: list) -> bool:
    """Whether rows of the variables ``keep`` cannot repeat: one entity of one wide table, named by its id or its key, and calls that add no row."""
    if not clauses or not all(isinstance(c, (Pattern, Call)) for c in clauses):
        return False
    found = set()
    keyed = False
    for c in clauses:
        if isinstance(c, Call):
            # a call without a binding filters; one that binds a variable adds a column, but range gives rows
            if c.name in ("get-some", "get-else", "range") or isinstance(c.name, list) and c.binding is not None or not (c.binding is None or is_var(c.binding)):
                return False
            continue
        db = env.sources.get(c.source)
        if not isinstance(db, Database) or len(c.terms) not in (2, 3) or not is_var(c.terms[0]) or is_var(c.terms[1]) or c.terms[1] == "_":
            return False
        name, reverse = attr_name(c.terms[1])
        if reverse or name not in db.virtual:
            return False
        table = db.virtual[name][0]
        found.add((c.source, table, c.terms[0]))
        t = db.tables[table]
        if not db.one_row_each(table) or not t.key and c.terms[0] not in keep:
            return False
        keyed |= c.terms[0] in keep or (db.virtual[name][1] == t.key and len(c.terms) == 3 and is_var(c.terms[2]) and c.terms[2] in keep)
    return len(found) == 1 and keyed


# ---- clauses ---------------------------------------------------------------------------------------------------------


def count_vars(clauses) -> dict[str, int]:
    out: dict[str, int] = {}
    for c in clauses:
        if isinstance(c, Pattern):
            for t in c.terms:
                if is_var(t):
                    out[t] = out.get(t, 0) + 1
        else:
            for v in clause_vars(c):
                out[v] = out.get(v, 0) + 2
    return out


def ready(env: Env, state: State, c) -> bool:
    if isinstance(c, Call):
        return all(bound(env, state, a) for a in c.args if not is_source(a))
    return True


def compile_clauses(env: Env, clauses: list, state: State | None = None, keep: set | None = None) -> State:
    """All clauses joined; keep: variables used outside (others may lose their entity column)."""
    state = state or State()
    used = count_vars(clauses)
    for v in keep or ():
        used[v] = used.get(v, 0) + 100
    for v in state.vars:
        used[v] = used.get(v, 0) + 100
    todo = [c for c in clauses if not isinstance(c, Pattern)]
    groups = pattern_groups(env, [c for c in clauses if isinstance(c, Pattern)], used)
    positive = set(state.vars).union(*(set(g.vars) for g in groups)) | set().union(*(clause_vars(c) for c in todo if not isinstance(c, Not)), set())
    while groups or todo:
        # filters and functions as soon as they can run
        k = next((k for k, c in enumerate(todo) if isinstance(c, Call) and ready(env, state, c) and (state.df is not None or not groups or not _reads(c))), None)
        if k is not None:
            state = call(env, state, todo.pop(k))
            continue
        if groups:
            linked = [k for k, g in enumerate(groups) if set(g.vars) & set(state.vars)]
            k = linked[0] if linked else 0
            if not linked and state.df is not None and any(isinstance(c, (Or, RuleCall)) and clause_vars(c) & set(state.vars) for c in todo):
                k = None
            if k is not None:
                state = join(state, groups.pop(k))
                continue
        k = next((k for k, c in enumerate(todo) if isinstance(c, (Or, RuleCall)) and (not clause_vars(c).isdisjoint(state.vars) or state.df is None)), None)
        if k is None:
            k = next((k for k, c in enumerate(todo) if isinstance(c, (Or, RuleCall))), None)
        if k is not None:
            c = todo.pop(k)
            state = disjunction(env, state, c) if isinstance(c, Or) else rule_call(env, state, c)
            continue
        k = next((k for k, c in enumerate(todo) if isinstance(c, Not) and {v for v in clause_vars(c) if v in positive} <= set(state.vars) | set(env.consts)), None)
        if k is not None:
            state = negation(env, state, todo.pop(k))
            continue
        raise InsufficientBindings(f"Insufficient bindings: {sorted(set().union(*(clause_vars(c) for c in todo)) - set(state.vars))} not bound")
    return state


def _reads(c: Call) -> bool:
    return any(is_var(a) for a in c.args)


def switched(env: Env, source: str) -> Env:
    """The environment in which a source stands for the default database."""
    return env if source == "$" else replace(env, sources=env.sources | {"$": env.sources[source]})


def negation(env: Env, state: State, c: Not) -> State:
    inner_env = switched(env, c.source)
    names = clause_vars(c)
    shared = [v for v in names if v in state.vars]
    if c.vars is not None and any(not bound(env, state, v) for v in c.vars):
        raise InsufficientBindings(f"Insufficient bindings: {edn.write([v for v in c.vars if not bound(env, state, v)])} not bound in not-join")
    if not shared and not any(v in env.consts for v in names):
        raise InsufficientBindings("Insufficient bindings: none of the variables of (not ...) is bound")
    try:
        inner = compile_clauses(inner_env, c.clauses, None, set(shared))
        if any(v not in inner.vars for v in shared):
            raise InsufficientBindings("seed")
    except InsufficientBindings:
        seed = State(state.df.select(*[f"`{v}`" for v in shared]).distinct(), {v: state.vars[v] for v in shared})
        inner = compile_clauses(inner_env, c.clauses, seed, set(shared))
    if not shared:
        return State(state.df.join(inner.df.select().limit(1), how="left_anti"), state.vars)
    inner = State(inner.df.select(*[f"`{v}`" for v in shared]), {v: inner.vars[v] for v in shared})
    return join(state, inner, "left_anti")


def _union(states: list[State], names: list[str]) -> State:
    kinds = {}
    for v in names:
        ks = {s.vars[v] for s in states}
        kinds[v] = ks.pop() if len(ks) == 1 else "entity" if ks == {"long", "entity"} else "any"
    out = None
    for s in states:
        one = s.df.select(*[(tagged(s.col(v), s.vars[v]) if kinds[v] == "any" and s.vars[v] != "any" else s.col(v)).alias(v) for v in names])
        out = one if out is None else out.unionByName(one)
    return State(out, kinds)


def disjunction(env: Env, state: State, c: Or) -> State:
    inner_env = switched(env, c.source)
    names = sorted(clause_vars(c))
    if c.vars is None:
        # the outer rows run through every branch; results are concatenated
        done = []
        for b in c.branches:
            if state.df is None or not set(names) & set(state.vars):
                done.append(compile_clauses(inner_env, b, None, set(names)))
            else:
                done.append(compile_clauses(inner_env, b, state, set(names) | set(state.vars)))
        out = _union(done, [*state.vars, *(n for n in names if n not in state.vars)] if state.df is not None and set(names) & set(state.vars) else names)
        return out if state.df is None or set(names) & set(state.vars) else join(state, out)
    for v in c.required:
        if not bound(env, state, v):
            raise InsufficientBindings(f"Insufficient bindings: [{v}] not bound in or-join")
    local = replace(inner_env, consts={k: v for k, v in env.consts.items() if k in c.vars})
    have = [v for v in c.vars if v in state.vars]
    out_names = [v for v in c.vars if v not in env.consts]

    def branch(b) -> State:
        try:
            s = compile_clauses(local, b, None, set(out_names))
            if any(v not in s.vars for v in out_names):
                raise InsufficientBindings("seed")
            return s
        except InsufficientBindings:
            if not have:
                raise
            seed = State(state.df.select(*[f"`{v}`" for v in have]).distinct(), {v: state.vars[v] for v in have})
            return compile_clauses(local, b, seed, set(out_names))

    done = _union([branch(b) for b in c.branches], out_names)
    return join(state, done)


# ---- rules -----------------------------------------------------------------------------------------------------------


def calls_in(clauses) -> set[str]:
    out = set()
    for c in clauses:
        if isinstance(c, RuleCall):
            out.add(c.name)
        elif isinstance(c, Not):
            out |= calls_in(c.clauses)
        elif isinstance(c, Or):
            for b in c.branches:
                out |= calls_in(b)
    return out


def reaches(env: Env, name: str) -> set[str]:
    seen, todo = set(), [name]
    while todo:
        n = todo.pop()
        for r in env.rules.get(n, ()):
            for m in calls_in(r.clauses):
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
    return seen


def renamed(x, names: dict):
    if isinstance(x, Pattern):
        return Pattern([renamed(t, names) for t in x.terms], x.source)
    if isinstance(x, Call):
        return Call(names.get(x.name, x.name) if is_var(x.name) else x.name, [renamed(t, names) for t in x.args], renamed(x.binding, names) if x.binding is not None else None, x.source)
    if isinstance(x, RuleCall):
        return RuleCall(x.name, [renamed(t, names) for t in x.args], x.source)
    if isinstance(x, Not):
        return Not([renamed(c, names) for c in x.clauses], None if x.vars is None else [renamed(v, names) for v in x.vars], x.source)
    if isinstance(x, Or):
        return Or([[renamed(c, names) for c in b] for b in x.branches], None if x.vars is None else [renamed(v, names) for v in x.vars], [renamed(v, names) for v in x.required], x.source)
    if is_var(x):
        return names.get(x, x)
    if isinstance(x, list) and not isinstance(x, str):
        return type(x)(renamed(y, names) for y in x)
    return x


def _all_vars(clauses) -> set:
    out = set()
    for c in clauses:
        out |= clause_vars(c)
        if isinstance(c, Not):
            out |= _all_vars(c.clauses)
        if isinstance(c, Or):
            for b in c.branches:
                out |= _all_vars(b)
    return out


def body(rule: Rule) -> Rule:
    """The rule with variables of its own."""
    k = next(_fresh)
    names = {v: Symbol(f"{v}__{k}") for v in _all_vars(rule.clauses) | set(rule.params)}
    return Rule(rule.name, [names[p] for p in rule.params], [renamed(c, names) for c in rule.clauses])


def rule_call(env: Env, state: State, c: RuleCall) -> State:
    env2 = switched(env, c.source)
    args = [env.consts.get(a, a) if is_var(a) else a for a in c.args]
    if c.name in env.relations:
        df, params, kinds = env.relations[c.name]
        return join(state, _called(env, df, kinds, args))
    rules = [r for r in env.rules.get(c.name, ()) if len(r.params) == len(args)]
    if not rules:
        if str(c.name) in PREDICATES or c.name in env.callables:
            return call(env2, state, Call(c.name, c.args, None, "$"))
        raise QueryError(f"Unknown rule '{c.name}' with {len(args)} arguments")
    if c.name in reaches(env, c.name):
        df, kinds = fixpoint(env2, c.name, state, args)
        return join(state, _called(env, df, kinds, args))
    outs = []
    names = [a for a in args if is_var(a)]
    for r in map(body, rules):
        consts = {p: a for p, a in zip(r.params, args, strict=True) if not is_var(a) and a != "_"}
        local = replace(env2, consts=consts, callables=env.callables | {p: env.callables[a] for p, a in zip(r.params, args, strict=True) if a in env.callables})
        free = [(p, a) for p, a in zip(r.params, args, strict=True) if is_var(a) and a not in env.callables]
        seed_vars = [(p, a) for p, a in free if a in state.vars]
        try:
            s = compile_clauses(local, r.clauses, None, {p for p, _ in free})
            if any(p not in s.vars for p, _ in free):
                raise InsufficientBindings("seed")
        except InsufficientBindings:
            if not seed_vars:
                raise
            df = state.df.select(*[state.col(a).alias(p) for p, a in seed_vars]).distinct()
            s = compile_clauses(local, r.clauses, State(df, {p: state.vars[a] for p, a in seed_vars}), {p for p, _ in free})
        out = _match_args(s, free)
        outs.append(out)
    names = list(dict.fromkeys(a for a in names if a not in env.callables))
    merged = _union(outs, names) if names else State(_exists(outs), {})
    return join(state, merged) if names else State(state.df.join(merged.df, how="left_semi"), state.vars)


def _exists(outs: list[State]) -> DataFrame:
    df = outs[0].df.select()
    for o in outs[1:]:
        df = df.union(o.df.select())
    return df.limit(1)


def _match_args(s: State, free: list[tuple[str, str]]) -> State:
    """Parameters to the caller's variables; one given twice must agree."""
    df, kinds, cols = s.df, {}, []
    first: dict[str, str] = {}
    for p, a in free:
        if a in first:
            df = df.filter(equal(Arg(F.col(f"`{first[a]}`"), s.vars[first[a]]), Arg(F.col(f"`{p}`"), s.vars[p])))
            continue
        first[a] = p
        kinds[a] = s.vars[p]
        cols.append(F.col(f"`{p}`").alias(a))
    return State(df.select(*cols), kinds)


def _called(env: Env, df: DataFrame, kinds: list[str], args: list) -> State:
    return _match(env, None, df, [(f"p{k}", kind, a) for k, (kind, a) in enumerate(zip(kinds, args, strict=True))])


def _handed_on(env: Env, state: State, args: list, group: list[str], rules: dict) -> dict[int, object]:
    """Places of a rule's arguments that are bound at the call and that every recursive call hands on unchanged.

    What the whole fixpoint holds at such a place can only be what the call asks for, so its rows are restricted
    from the first round on.  Only for a rule that is recursive by itself.
    """
    if len(group) != 1:
        return {}
    (name,) = group

    def calls(clauses):
        for c in clauses:
            if isinstance(c, RuleCall) and c.name == name:
                yield c
            elif isinstance(c, Or):
                for b in c.branches:
                    yield from calls(b)
            elif isinstance(c, Not):
                yield from calls(c.clauses)

    out: dict[int, object] = {}
    for k, a in enumerate(args):
        if a == "_" or is_var(a) and a not in state.vars:
            continue
        if all(c.source == "$" and c.args[k] == r.params[k] for r in rules[name] for c in calls(r.clauses)):
            out[k] = a
    return out


def _within(df: DataFrame, bound_at: dict[int, object], state: State) -> DataFrame:
    for k, a in bound_at.items():
        if is_var(a):
            wanted = state.df.select(state.col(a).alias("_w")).distinct()
            # types that differ are left to the join after the fixpoint
            if wanted.schema["_w"].dataType == df.schema[f"p{k}"].dataType:
                df = df.join(wanted, F.col(f"p{k}") == F.col("_w"), "left_semi")
        else:
            lit, _ = literal(a)
            if kind_of_type(df.schema[f"p{k}"].dataType) in ("long", "double", "string", "bool"):
                df = df.filter(F.col(f"p{k}") == lit)
    return df


def _asked(env: Env, args: list, group: list[str], rules: dict, handed: dict) -> dict[int, DataFrame]:
    """For places that the call binds to a constant and recursion changes: all values (``_w``) that are ever asked for there.

    They are followed from the constant through the clauses beside the one recursive call of each branch, so that
    the fixpoint holds only what hangs on it, not the whole closure.  Other shapes of rules are left unrestricted.
    """
    from quarry.plans.scratch import cut

    if len(group) != 1:
        return {}
    (name,) = group
    steps = []
    for r in rules[name]:
        own = [c for c in r.clauses if isinstance(c, RuleCall) and c.name == name]
        if own:
            steps.append((r, own[0], [c for c in r.clauses if c is not own[0]]))
        if len(own) > 1 or any(c.source != "$" for c in own) or calls_in([c for c in r.clauses if c not in own]) & {name}:
            return {}
    out = {}
    for k, a in enumerate(args):
        if k in handed or is_var(a) or a == "_":
            continue
        lit, kind = literal(a)
        if kind not in ("long", "string"):
            continue
        total = [cut(env.spark.range(0, 1, 1, 1).select(lit.alias("_w")))]
        delta = total[0]
        try:
            for _ in range(env.max_rounds):
                found = None
                for r, c, rest in steps:
                    t, p = c.args[k], r.params[k]
                    if t == p:
                        continue
                    s = compile_clauses(env, rest, State(delta.select(F.col("_w").alias(p)), {p: kind}), {t}) if is_var(t) else None
                    if s is None or s.vars.get(t) != kind:
                        raise InsufficientBindings("not followed")
                    one = s.df.select(s.col(t).alias("_w"))
                    found = one if found is None else found.unionByName(one)
                if found is None:
                    break
                have = total[0]
                for part in total[1:]:
                    have = have.unionByName(part)
                delta = cut(found.distinct().join(have, "_w", "left_anti"))
                if delta.isEmpty():
                    break
                total = [*total, delta] if len(total) < PARTS else [cut(have.unionByName(delta))]
        except InsufficientBindings:
            continue
        have = total[0]
        for part in total[1:]:
            have = have.unionByName(part)
        out[k] = have
    return out


#: Written parts of a recursive rule's rows that are read side by side.
PARTS = 8


def fixpoint(env: Env, name: str, state: State, args: list) -> tuple[DataFrame, list[str]]:
    """The least fixpoint of a recursive rule and all that are mutually recursive with it, semi-naively.

    Each round joins the rows that the last one found with the rest of the bodies; rows are a set.
    Lineage is cut in the shared folder each round.
    """
    from quarry.plans.scratch import cut

    group = sorted({name} | {n for n in reaches(env, name) if name in reaches(env, n)})
    rules = {n: [body(r) for r in env.rules[n]] for n in group}
    for n in group:
        for r in rules[n]:
            for c in r.clauses:
                if isinstance(c, Not) and calls_in([c]) & set(group):
                    raise QueryError(f"rule {n} negates a rule of its own recursion")
    base_env = replace(env, consts={})
    bound_at = _handed_on(env, state, args, group, rules)
    asked = _asked(base_env, args, group, rules, bound_at)

    def project(s: State, r: Rule) -> DataFrame:
        out = projected(s, r)
        for k, wanted in asked.items():
            out = out.join(wanted, F.col(f"p{k}") == F.col("_w"), "left_semi")
        return out

    def projected(s: State, r: Rule) -> DataFrame:
        missing = [p for p in r.params if p not in s.vars]
        if missing:
            raise InsufficientBindings(f"Insufficient bindings: {missing} not bound by rule {r.name}")
        return s.df.select(*[s.col(p).alias(f"p{k}") for k, p in enumerate(r.params)])

    kinds: dict[str, list[str]] = {}
    total: dict[str, list[DataFrame]] = {}

    def whole(n: str) -> DataFrame:
        out = total[n][0]
        for part in total[n][1:]:
            out = out.unionByName(part)
        return out

    for n in group:
        plain = [r for r in rules[n] if not calls_in(r.clauses) & set(group)]
        states = [(compile_clauses(base_env, r.clauses, None, set(r.params)), r) for r in plain]
        if states:
            df = project(*states[0])
            kinds[n] = [states[0][0].vars[p] for p in states[0][1].params]
            for s, r in states[1:]:
                df = df.unionByName(project(s, r))
            total[n] = [cut(_within(df, bound_at, state).distinct())]
    if not total:
        raise QueryError(f"recursive rule {name} has no branch to start from")
    while len(total) < len(group):
        known = replace(base_env, relations=base_env.relations | {n: (whole(n), [], kinds[n]) for n in total})
        grew = False
        for n in group:
            if n in total:
                continue
            for r in rules[n]:
                if calls_in(r.clauses) & set(group) <= set(total):
                    s = compile_clauses(known, r.clauses, None, set(r.params))
                    kinds[n] = [s.vars[p] for p in r.params]
                    total[n] = [cut(_within(project(s, r), bound_at, state).distinct())]
                    grew = True
                    break
        if not grew:
            raise QueryError(f"recursive rule {name} has no branch to start from")
    delta = {n: whole(n) for n in total}
    for _ in range(env.max_rounds):
        new: dict[str, DataFrame] = {}
        for n in group:
            found = None
            for r in rules[n]:
                sites = [k for k, c in enumerate(r.clauses) if isinstance(c, RuleCall) and c.name in group]
                nested = (calls_in(r.clauses) & set(group)) - {r.clauses[k].name for k in sites}
                for site in sites or ([None] if nested else []):
                    tables = {m: (whole(m), [], kinds[m]) for m in group}
                    clauses = list(r.clauses)
                    if site is not None and not nested:
                        # this call reads only what is new; the others read all
                        c = clauses[site]
                        tables[f"{c.name} new"] = (delta[c.name], [], kinds[c.name])
                        clauses[site] = RuleCall(f"{c.name} new", c.args, c.source)
                    s = compile_clauses(replace(base_env, relations=base_env.relations | tables), clauses, None, set(r.params))
                    one = project(s, r)
                    found = one if found is None else found.unionByName(one)
            if found is not None:
                keys = [f"p{k}" for k in range(len(kinds[n]))]
                new[n] = cut(found.distinct().join(whole(n), keys, "left_anti"))
        live = [n for n in new if not new[n].isEmpty()]
        if not live:
            return whole(name), kinds[name]
        for n in group:
            delta[n] = new.get(n, whole(n).limit(0))
            if n in live:
                # only what is new is written; the parts are brought together now and then
                total[n].append(new[n])
                if len(total[n]) > PARTS:
                    total[n] = [cut(whole(n))]
    raise QueryError(f"recursive rule {name} did not settle in {env.max_rounds} rounds")

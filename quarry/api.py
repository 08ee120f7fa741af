"""Queries: text or forms in, one DataFrame plan out."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry import edn
from quarry.edn import Keyword
from quarry.functions.registry import Arg
from quarry.operators.aggregates import aggregate, amount_of, amounts, drawn, draws
from quarry.plans.compiler import Env, State, compile_clauses, join, literal_rows, rows_differ
from quarry.plans.query import Aggregate, PullExpr, Query, QueryError, clause_vars, is_source, is_var, parse, parse_rules
from quarry.sources.database import Database, kind_of_type, untag


def _inputs(query: Query, inputs: tuple) -> tuple[Env, State]:
    names = query.inputs or [edn.Symbol("$")]
    if len(names) != len(inputs):
        raise QueryError(f"Wrong number of arguments for bindings {edn.write(names)}, {len(names)} required, {len(inputs)} provided")
    sources = {n: v for n, v in zip(names, inputs, strict=True) if is_source(n)}
    spark = next((s.spark if isinstance(s, Database) else s.sparkSession for s in sources.values()), None)
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.active()
    for n, s in list(sources.items()):
        if isinstance(s, (list, tuple)):
            sources[n] = spark.createDataFrame([tuple(r) for r in s])
    env = Env(spark, sources)
    rules = {r.name: [] for r in query.rules}
    for r in query.rules:
        rules[r.name].append(r)
    state = State()
    for name, value in zip(names, inputs, strict=True):
        if is_source(name):
            continue
        if name == "%":
            for r in parse_rules(value):
                rules.setdefault(r.name, []).append(r)
        elif is_var(name):
            if callable(value):
                env.callables[name] = value
            else:
                env.consts[name] = value
        elif isinstance(value, DataFrame):
            # a frame as relation: its columns in order
            inner = name[0] if isinstance(name[0], list) else name
            kinds = {v: kind_of_type(value.schema.fields[k].dataType) for k, v in enumerate(inner) if is_var(v)}
            state = join(state, State(value.select(*[F.col(f"`{value.columns[k]}`").alias(v) for k, v in enumerate(inner) if is_var(v)]), kinds))
        elif name != "_":
            state = join(state, literal_rows(env, value, name))
    env.rules = rules
    return env, state


def _with_consts(env: Env, state: State, names) -> State:
    """Scalar inputs that :find or :with names become columns."""
    from quarry.sources.database import literal

    for v in names:
        if v not in state.vars and v in env.consts:
            col, kind = literal(env.consts[v])
            state = State(state.df.withColumn(str(v), col), state.vars | {v: kind})
    return state


def plan(query, *inputs, names: list[str] | None = None) -> DataFrame:
    """The query's result as a DataFrame with a column a :find element: a set of rows.

    names (or :keys, :syms, :strs) name the columns; else a variable gives its own name without the
    question mark.  pull expressions give the entity's id and a struct.
    """
    query = parse(query)
    env, state = _inputs(query, inputs)
    out_vars = {x for f in query.find for x in ([f] if is_var(f) else [f.over, *f.args] if isinstance(f, Aggregate) else [f.var]) if is_var(x)} | set(query.with_vars)
    state = compile_clauses(env, query.where, state, out_vars)
    if state.df is None:
        state = State(env.spark.range(0, 1, 1, 1).select(), {})
    state = _with_consts(env, state, sorted(out_vars))
    names = names or query.keys or [_column_name(f) for f in query.find]
    plain = [f.var if isinstance(f, PullExpr) else f for f in query.find if not isinstance(f, Aggregate)]
    aggs = [f for f in query.find if isinstance(f, Aggregate)]
    df = state.df
    if aggs:
        if query.with_vars:
            keep = list(dict.fromkeys([*plain, *(f.over for f in aggs), *query.with_vars]))
            df = df.select(*[f"`{v}`" for v in keep]).distinct()
        cols: list[Column] = []
        tops: list[tuple] = []
        for k, f in enumerate(query.find):
            if isinstance(f, Aggregate):
                extra = [env.consts.get(a, a) if is_var(a) else env.sources.get(a, a) if is_source(a) else a for a in f.args]
                a = Arg(F.col(f"`{f.over}`"), state.vars[f.over])
                fn = env.callables.get(f.name)
                amount = None if fn else amount_of(str(f.name), [x for x, y in zip(extra, f.args, strict=True) if not is_source(y)])
                if amount is not None and f.name == "rand":
                    df, made = draws(df, amount, f"_d{k}_")
                    cols.append(drawn(a, amount, made).alias(f"o{k}"))
                    continue
                if amount is not None:
                    tops.append((k, str(f.name), amount, a))
                    continue
                col = fn(*extra, a.col) if fn else aggregate(str(f.name), [x for x, y in zip(extra, f.args, strict=True) if not is_source(y)], a)[0]
                cols.append(col.alias(f"o{k}"))
        keys = list(dict.fromkeys(plain))
        names_of = [f"k{i}" for i in range(len(keys))]
        keyed = df.withColumns({f"k{i}": F.col(f"`{v}`") for i, v in enumerate(keys)}) if keys else df
        # no rows give no group, not a row of zeros
        df = keyed.groupBy(*names_of).agg(F.count(F.lit(1)).alias("_n"), *cols)
        df = df if keys else df.filter("_n > 0")
        for k, name, n, a in tops:
            top = amounts(keyed, names_of, name, n, a).withColumnRenamed("values", f"o{k}")
            df = df.join(top, names_of) if keys else df.crossJoin(top)  # a row each
        picked = [F.col(f"o{k}") if isinstance(f, Aggregate) else F.col(f"k{keys.index(f.var if isinstance(f, PullExpr) else f)}") for k, f in enumerate(query.find)]
        df = df.select(*[c.alias(n) for c, n in zip(picked, names, strict=True)])
    else:
        keep = list(dict.fromkeys([*plain, *query.with_vars]))
        df = df.select(*[f"`{v}`" for v in keep])
        df = df if rows_differ(env, query.where, keep) else df.distinct()
        df = df.select(*[F.col(f"`{v}`").alias(n) for v, n in zip(plain, names, strict=True)])
    for f, n in zip(query.find, names, strict=True):
        if isinstance(f, PullExpr):
            df = _pulled(env, df, f, n)
    return df


def plan_with(query, extra_vars: list, *inputs, names: list[str] | None = None) -> DataFrame:
    """plan() with more :with variables than the query names itself."""
    query = parse(query)
    more = [edn.Symbol(v if v.startswith("?") else f"?{v}") for v in extra_vars]
    return plan(replace(query, with_vars=list(dict.fromkeys([*query.with_vars, *more]))), *inputs, names=names)


def q_with(query, extra_vars: list, *inputs):
    """q() with more :with variables than the query names itself."""
    query = parse(query)
    more = [edn.Symbol(v if v.startswith("?") else f"?{v}") for v in extra_vars]
    return q(replace(query, with_vars=list(dict.fromkeys([*query.with_vars, *more]))), *inputs)


def _pulled(env: Env, df: DataFrame, f: PullExpr, n: str) -> DataFrame:
    """Replace an id column by the pulled struct; rows of which nothing is pulled go."""
    from quarry.operators.pull import pull_frame

    pattern = env.consts.get(f.pattern, f.pattern) if is_var(f.pattern) else f.pattern
    frame = pull_frame(env.database(f.source), pattern, df.select(F.col(f"`{n}`").cast("bigint").alias("e")))
    joined = df.withColumnRenamed(n, "_pull_id").join(frame.select(F.col("e").alias("_pull_id"), F.col("pulled").alias("_pulled")), "_pull_id")
    return joined.select(*[F.col("_pulled").alias(n) if c == n else F.col(f"`{c}`") for c in df.columns])


def _column_name(f) -> str:
    if isinstance(f, Aggregate):
        return f"{f.name}_{str(f.over).lstrip('?')}".replace("?", "")
    if isinstance(f, PullExpr):
        return str(f.var).lstrip("?")
    return str(f).lstrip("?")


def _value(v):
    if hasattr(v, "asDict"):
        d = v.asDict()
        return untag(d) if set(d) == {"rank", "num", "lng", "str"} else {k: _value(x) for k, x in d.items()}
    if isinstance(v, list):
        return [_value(x) for x in v]
    return v


def q(query, *inputs):
    """Rows as Python values in the shape that :find asks for: a sorted list of tuples (or maps), a list, a tuple, or one value.

    pull expressions take every pattern here; their documents are Python maps.
    """
    from quarry.operators.pull import pull_many

    query = parse(query)
    pulls = [k for k, f in enumerate(query.find) if isinstance(f, PullExpr)]
    flat = replace(query, find=[f.var if isinstance(f, PullExpr) else f for f in query.find], keys=None) if pulls else query
    names = [f"c{k}" for k in range(len(query.find))]
    if pulls:
        doubles = flat.find
        seen: dict = {}
        for k, f in enumerate(doubles):
            seen.setdefault(str(f), []).append(k)
    rows = [tuple(_value(v) for v in r) for r in plan(flat, *inputs, names=names).collect()]
    rows.sort(key=lambda r: [_sort_key(v) for v in r])
    if pulls:
        env, _ = _inputs(query, inputs)
        for k in pulls:
            f = query.find[k]
            pattern = env.consts.get(f.pattern, f.pattern) if is_var(f.pattern) else f.pattern
            docs = pull_many(env.database(f.source), pattern, [r[k] for r in rows])
            rows = [(*r[:k], d, *r[k + 1 :]) for r, d in zip(rows, docs, strict=True) if d is not None]
    if query.keys:
        rows = [dict(zip(query.keys, r, strict=True)) for r in rows]
    if query.shape == "relation":
        return rows
    if query.shape == "collection":
        return [r[0] for r in rows]
    if query.shape == "tuple":
        return rows[0] if rows else None
    return rows[0][0] if rows else None


def _sort_key(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (8, v)
    if isinstance(v, (int, float)):
        return (9, v)
    if isinstance(v, Keyword):
        return (1, str(v))
    return (10, str(v))


def unused_vars(query) -> set:
    """Variables that stand only once: often a slip."""
    query = parse(query)
    count: dict = {}
    for c in query.where:
        for v in clause_vars(c):
            count[v] = count.get(v, 0) + 1
    return {v for v, n in count.items() if n == 1 and v not in query.find}

"""Queries as data: parsing of EDN forms into clauses, and their validation."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache

from quarry import edn
from quarry.edn import Keyword, Seq, Symbol


class QueryError(ValueError):
    pass


class InsufficientBindings(QueryError):
    pass


def is_var(x) -> bool:
    return isinstance(x, Symbol) and x.startswith("?")


def is_source(x) -> bool:
    return isinstance(x, Symbol) and x.startswith("$")


@dataclass
class Pattern:
    terms: list
    source: str = "$"


@dataclass
class Call:
    """A predicate, or a function with an output binding; source "$" stands for the default database."""

    name: object
    args: list
    binding: object = None
    source: str = "$"


@dataclass
class Not:
    clauses: list
    vars: list | None = None
    source: str = "$"


@dataclass
class Or:
    branches: list[list]
    vars: list | None = None
    required: list = field(default_factory=list)
    source: str = "$"


@dataclass
class RuleCall:
    name: str
    args: list
    source: str = "$"


@dataclass
class Rule:
    name: str
    params: list
    clauses: list


@dataclass
class Aggregate:
    name: object
    args: list  # all but the last are constants or inputs
    over: object


@dataclass
class PullExpr:
    var: object
    pattern: object
    source: str = "$"


@dataclass
class Query:
    find: list
    shape: str  # relation, collection, tuple, scalar
    with_vars: list
    inputs: list
    where: list
    rules: list[Rule]
    keys: list | None = None


SECTIONS = (":find", ":with", ":in", ":where", ":rules", ":keys", ":syms", ":strs")


def sections(form) -> dict:
    if isinstance(form, dict):
        return dict(form)
    if not isinstance(form, list) or not form or not isinstance(form[0], Keyword):
        raise QueryError("a query is a vector or a map with :find")
    out: dict = {}
    for x in form:
        if isinstance(x, Keyword) and x in SECTIONS:
            now = out.setdefault(x, [])
        else:
            now.append(x)
    return out


def parse_clause(form, source: str = "$"):
    if isinstance(form, Seq):
        if not form:
            raise QueryError("an empty clause")
        head = form[0]
        if is_source(head):
            return parse_clause(Seq(form[1:]), head)
        if head == "not":
            return Not([parse_clause(c) for c in form[1:]], None, source)
        if head == "not-join":
            return Not([parse_clause(c) for c in form[2:]], list(form[1]), source)
        if head == "or":
            return Or([_branch(c) for c in form[1:]], None, [], source)
        if head == "or-join":
            names, required = list(form[1]), []
            if names and isinstance(names[0], list):
                required, names = list(names[0]), list(names[0]) + names[1:]
            return Or([_branch(c) for c in form[2:]], names, required, source)
        if head == "and":
            raise QueryError("(and ...) stands only inside or")
        if isinstance(head, Symbol):
            return RuleCall(head, list(form[1:]), source)
        raise QueryError(f"cannot parse clause {edn.write(form)}")
    if not isinstance(form, list) or not form:
        raise QueryError(f"cannot parse clause {edn.write(form)}")
    if isinstance(form[0], Seq):
        call, *rest = form
        if len(rest) > 1:
            raise QueryError(f"one binding at most: {edn.write(form)}")
        return Call(call[0], list(call[1:]), rest[0] if rest else None, source)
    if is_source(form[0]):
        if len(form) > 1 and isinstance(form[1], Seq):
            return parse_clause(form[1:], form[0])
        return Pattern(form[1:], form[0])
    return Pattern(form, source)


def _branch(form) -> list:
    if isinstance(form, Seq) and form and form[0] == "and":
        return [parse_clause(c) for c in form[1:]]
    return [parse_clause(form)]


def parse_rules(forms) -> list[Rule]:
    if isinstance(forms, str):
        forms = edn.read_cached(forms)
    out = []
    for form in forms:
        head, *body = form
        name, *params = head
        params = [p for x in params for p in (x if isinstance(x, list) else [x])]
        if not body:
            raise QueryError(f"rule {name} has no clauses")
        if len(set(params)) != len(params):
            raise QueryError(f"rule {name} repeats a variable")
        out.append(Rule(name, params, [parse_clause(c) for c in body]))
    return out


def parse_find(form):
    if isinstance(form, Seq):
        if form[0] == "pull":
            rest = form[1:]
            source = rest.pop(0) if is_source(rest[0]) else "$"
            return PullExpr(rest[0], rest[1], source)
        name, *args = form
        if name == "aggregate":
            name, *args = args
        if not args:
            raise QueryError(f"aggregate {name} needs an argument")
        return Aggregate(name, args[:-1], args[-1])
    if is_var(form):
        return form
    raise QueryError(f"cannot parse :find element {edn.write(form)}")


def clause_vars(c) -> set:
    if isinstance(c, Pattern):
        return {t for t in c.terms if is_var(t)}
    if isinstance(c, Call):
        return {a for a in _flat(c.args) if is_var(a)} | {v for v in _flat([c.binding]) if is_var(v)} | ({c.name} if is_var(c.name) else set())
    if isinstance(c, RuleCall):
        return {a for a in c.args if is_var(a)}
    if isinstance(c, Not):
        return set(c.vars) if c.vars is not None else set().union(*(clause_vars(x) for x in c.clauses))
    if isinstance(c, Or):
        return set(c.vars) if c.vars is not None else set().union(*(clause_vars(x) for b in c.branches for x in b))
    return set()


def _flat(xs):
    for x in xs:
        if isinstance(x, (list, tuple)):
            yield from _flat(x)
        elif x is not None:
            yield x


def parse(form) -> Query:
    if isinstance(form, Query):
        return form
    if isinstance(form, str):
        return _parse_text(form)
    s = sections(form)
    if ":find" not in s or not s[":find"]:
        raise QueryError("Query should have a :find section")
    find, shape = list(s[":find"]), "relation"
    if len(find) == 2 and find[1] == ".":
        find, shape = find[:1], "scalar"
    elif len(find) == 1 and isinstance(find[0], list) and not isinstance(find[0], Seq):
        inner = find[0]
        if len(inner) == 2 and inner[1] == "...":
            find, shape = inner[:1], "collection"
        else:
            find, shape = inner, "tuple"
    q = Query([parse_find(f) for f in find], shape, list(s.get(":with", [])), list(s.get(":in", [])), [parse_clause(c) for c in s.get(":where", [])], parse_rules(s.get(":rules", [])))
    for k in (":keys", ":syms", ":strs"):
        if k in s:
            if q.shape not in ("relation", "tuple"):
                raise QueryError(f"{k} does not work with :find of one value")
            if len(s[k]) != len(q.find):
                raise QueryError(f"Count of {k} must match count of :find")
            q.keys = [str(x) for x in s[k]]
    validate(q)
    return q


@lru_cache(maxsize=512)
def _parse_text(text: str) -> Query:
    return parse(edn.read(text))


def validate(q: Query) -> None:
    bound = {v for v in _flat(q.inputs) if is_var(v)}
    for c in q.where:
        bound |= clause_vars(c)
    wanted = set()
    for f in q.find:
        if isinstance(f, Aggregate):
            wanted |= {x for x in [*f.args, f.over, f.name] if is_var(x)}
        elif isinstance(f, PullExpr):
            wanted |= {x for x in (f.var, f.pattern) if is_var(x)}
        else:
            wanted.add(f)
    if unknown := sorted((wanted | set(q.with_vars)) - bound):
        raise QueryError(f"Query for unknown vars: {edn.write(unknown)}")
    if both := sorted({f for f in q.find if is_var(f)} & set(q.with_vars)):
        raise QueryError(f":find and :with should not use same variables: {edn.write(both)}")
    names = [v for v in _flat(q.inputs) if is_var(v) or is_source(v) or v == "%"]
    if len(names) != len(set(names)):
        raise QueryError("Vars used in :in should be distinct")
    known = {x for x in q.inputs if is_source(x)} or {"$"}
    for c in q.where:
        if getattr(c, "source", "$") not in known | {"$"}:
            raise QueryError(f"Where uses unknown source vars: [{c.source}]")
        if isinstance(c, Or) and c.vars is None:
            sets = [set().union(*(clause_vars(x) for x in b)) for b in c.branches]
            if any(x != sets[0] for x in sets):
                raise QueryError("All clauses in 'or' must use same set of free vars")

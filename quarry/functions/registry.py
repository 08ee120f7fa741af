"""Built-in predicates and functions, by name, as Column builders.

Every entry takes ``Arg``s and returns a result; ``drop`` in a result means that
a NULL drops the row, as where a key is absent or a pattern does not match.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry import edn
from quarry.plans.query import QueryError
from quarry.sources.database import TAGGED, kind_of_type, tagged

SPACE = " \n\r\t\f"
NUMBERS = ("long", "double", "entity")
#: Kinds that are arrays, and all kinds that hold other values.
SEQUENCES = ("array", "list", "set")
COLLECTIONS = (*SEQUENCES, "map")


@dataclass
class Arg:
    col: Column
    kind: str
    value: object = None
    const: bool = False
    elem: object = None  # of a collection in a column: its Spark type


@dataclass
class Result:
    col: Column
    kind: str
    drop: bool = False
    rows: bool = False  # an array whose elements are rows


def order_key(a: Arg) -> Column:
    """Orders and equates values across types; numbers compare by value whatever their type."""
    t = tagged(a.col, a.kind)
    text = t["str"]
    if a.kind in ("keyword", "any"):
        # keywords by namespace, then name; one without a namespace comes first
        parts = F.when(F.instr(text, "/") > 1, F.translate(text, "/", "\x01")).otherwise(F.concat(F.lit(":\x01"), F.substring(text, 2, 1 << 30)))
        text = parts if a.kind == "keyword" else F.when(t["rank"] == 1, parts).otherwise(text)
    return F.struct(t["rank"].alias("r"), t["num"].alias("n"), F.when(t["rank"] == 9, None).otherwise(t["lng"]).alias("l"), text.alias("s"))


def _like(a: Arg, b: Arg) -> bool:
    return a.kind == b.kind and a.kind not in ("any", "nil") or a.kind in NUMBERS and b.kind in NUMBERS


def keys(args: list[Arg]) -> list[Column]:
    if all(_like(args[0], x) for x in args[1:]) and args[0].kind not in ("any", "nil", "keyword", "map"):
        return [x.col for x in args]
    return [order_key(x) for x in args]


def equal(a: Arg, b: Arg) -> Column:
    x, y = (a.col, b.col) if a.kind == b.kind == "keyword" else keys([a, b])
    return x.eqNullSafe(y)


def _all(cols) -> Column:
    out = F.lit(True)
    for c in cols:
        out = out & c
    return out


def truthy(a: Arg) -> Column:
    if a.kind == "bool":
        return F.coalesce(a.col, F.lit(False))
    if a.kind == "any":
        return ~((a.col["rank"] == 0) | ((a.col["rank"] == 8) & (a.col["lng"] == 0)))
    return F.lit(a.kind != "nil")


def _chain(op: Callable[[Column, Column], Column]):
    def run(args: list[Arg]) -> Column:
        if not args:
            raise QueryError("a comparison needs an argument")
        k = keys(args)
        return _all(op(x, y) for x, y in zip(k, k[1:], strict=False))

    return run


def _rank_in(*ranks: int, whole: bool | None = None):
    def run(args: list[Arg]) -> Column:
        (a,) = args
        t = tagged(a.col, a.kind)
        out = t["rank"].isin(*ranks)
        return F.coalesce(out & t["lng"].isNotNull() if whole else out, F.lit(False))

    return run


def _numeric(test: Callable[[Column], Column], whole: bool = False):
    def run(args: list[Arg]) -> Column:
        (a,) = args
        if a.kind in NUMBERS:
            return test(a.col) if not whole or a.kind != "double" else F.lit(False)
        if a.kind == "any":
            return F.coalesce(test(a.col["lng"] if whole else a.col["num"]) & (a.col["rank"] == 9), F.lit(False))
        return F.lit(False)

    return run


def _size(a: Arg) -> Column:
    """Elements of a collection, characters of a string; NULL for what has no size."""
    if a.kind in COLLECTIONS:
        return F.size(a.col)
    if a.kind == "any":
        return F.when(a.col["rank"] == 10, F.length(a.col["str"]))
    return F.length(a.col) if a.kind == "string" else F.lit(None).cast("int")


def _contains(args: list[Arg]) -> Column:
    c, k = args
    if c.kind == "map":
        return F.map_contains_key(c.col, k.col)
    if c.kind == "set":
        return F.array_contains(c.col, k.col)
    if c.kind not in SEQUENCES or k.kind not in NUMBERS:
        return F.lit(False)
    return (k.col >= 0) & (k.col < F.size(c.col))


def _is_regex(a: Arg) -> bool:
    return a.kind == "regex"


def pattern_of(a: Arg) -> Column:
    """The regular expression, a constant or a column of patterns."""
    if a.const:
        return F.lit(a.value.pattern if isinstance(a.value, re.Pattern) else str(a.value))
    return a.col


def whole_pattern(a: Arg) -> Column:
    return F.concat(F.lit("^(?:"), pattern_of(a), F.lit(")$"))


def _differ(args: list[Arg]) -> Column:
    n = len(args) // 2
    return ~_all(equal(a, b) for a, b in zip(args[:n], args[n:], strict=True))


PREDICATES: dict[str, Callable[[list[Arg]], Column]] = {
    "<": _chain(lambda a, b: a < b), ">": _chain(lambda a, b: a > b), "<=": _chain(lambda a, b: a <= b), ">=": _chain(lambda a, b: a >= b),
    "=": _chain(lambda a, b: a.eqNullSafe(b)), "number?": _rank_in(9), "integer?": _rank_in(9, whole=True), "string?": _rank_in(10), "boolean?": _rank_in(8), "keyword?": _rank_in(1),
    "zero?": _numeric(lambda c: c == 0), "pos?": _numeric(lambda c: c > 0), "neg?": _numeric(lambda c: c < 0), "even?": _numeric(lambda c: c % 2 == 0, True), "odd?": _numeric(lambda c: c % 2 != 0, True),
    "true?": lambda x: F.coalesce(x[0].col, F.lit(False)) if x[0].kind == "bool" else (_rank_in(8)(x) & (tagged(x[0].col, x[0].kind)["lng"] == 1)),
    "false?": lambda x: F.coalesce(~x[0].col, F.lit(False)) if x[0].kind == "bool" else (_rank_in(8)(x) & (tagged(x[0].col, x[0].kind)["lng"] == 0)),
    "nil?": lambda x: F.lit(x[0].kind == "nil") if x[0].kind != "any" else x[0].col["rank"] == 0, "some?": lambda x: F.lit(x[0].kind != "nil") if x[0].kind != "any" else x[0].col["rank"] != 0,
    "not": lambda x: ~truthy(x[0]), "and": lambda xs: _all(truthy(x) for x in xs), "or": lambda xs: ~_all(~truthy(x) for x in xs),
    "empty?": lambda x: _size(x[0]) == 0, "not-empty": lambda x: _size(x[0]) > 0, "contains?": _contains, "-differ?": _differ, "identical?": lambda x: equal(*x),
    "blank?": lambda x: F.length(F.btrim(x[0].col, F.lit(SPACE))) == 0, "includes?": lambda x: F.contains(x[0].col, x[1].col), "starts-with?": lambda x: F.startswith(x[0].col, x[1].col), "ends-with?": lambda x: F.endswith(x[0].col, x[1].col),
    "re-find": lambda x: F.rlike(x[1].col, pattern_of(x[0])), "re-matches": lambda x: F.rlike(x[1].col, whole_pattern(x[0])),
}
PREDICATES["=="] = PREDICATES["="]
PREDICATES["not-empty?"] = PREDICATES["not-empty"]
PREDICATES["!="] = PREDICATES["not="] = lambda xs: ~PREDICATES["="](xs)


# ---- functions that bind ---------------------------------------------------------------------------------------------


def _num(args: list[Arg]) -> list[Column]:
    out = []
    for a in args:
        if a.kind == "any":
            out.append(a.col["num"])
        elif a.kind in NUMBERS:
            out.append(a.col)
        else:
            raise QueryError(f"arithmetic needs numbers, not {a.kind}")
    return out


def _arith(op, unit):
    def run(args: list[Arg]) -> Result:
        cols = _num(args)
        if not cols:
            return Result(F.lit(unit).cast("bigint"), "long")
        out = cols[0] if len(cols) > 1 else op(F.lit(unit), cols[0])
        for c in cols[1:]:
            out = op(out, c)
        kind = "double" if any(a.kind in ("double", "any") for a in args) else "long"
        return Result(out.cast("double") if kind == "double" else out.cast("bigint"), kind)

    return run


def _divide(args: list[Arg]) -> Result:
    cols = [c.cast("double") for c in _num(args)]
    if len(cols) == 1:
        cols = [F.lit(1.0), *cols]
    out = cols[0]
    for c in cols[1:]:
        # a division by zero is infinite (0 / 0 is NaN), never an error
        zero = F.when(out > 0, float("inf")).when(out < 0, float("-inf")).otherwise(float("nan"))
        out = F.when(c == 0, zero).otherwise(F.try_divide(out, c))
    return Result(out, "double")


def _int2(f):
    def run(args: list[Arg]) -> Result:
        x, y = _num(args)
        return Result(f(x.cast("bigint"), y.cast("bigint")).cast("bigint"), "long")

    return run


def _element(t, c: Column, readable: bool) -> Column:
    """An element of a collection, printed; t: its Spark type."""
    kind = kind_of_type(t)
    return _str_of(Arg(c, kind, elem=t if kind in COLLECTIONS else None), readable)


def _str_of(a: Arg, readable: bool = False) -> Column:
    if a.const and a.kind in COLLECTIONS:
        return F.lit(edn.write(a.value, readable))
    if a.kind in SEQUENCES and a.elem is not None:
        left, right = {"array": ("[", "]"), "list": ("(", ")"), "set": ("#{", "}")}[a.kind]
        return F.concat(F.lit(left), F.array_join(F.transform(a.col, lambda x: _element(a.elem.elementType, x, readable)), " "), F.lit(right))
    if a.kind == "map" and a.elem is not None:
        pair = lambda e: F.concat(_element(a.elem.keyType, e["key"], readable), F.lit(" "), _element(a.elem.valueType, e["value"], readable))
        return F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(a.col), pair), ", "), F.lit("}"))
    if a.kind == "nil":
        return F.lit("nil" if readable else "")
    if a.kind == "any":
        return F.coalesce(a.col["str"], F.when(a.col["rank"] == 8, F.when(a.col["lng"] == 1, "true").otherwise("false")), a.col["lng"].cast("string"), a.col["num"].cast("string"))
    if a.kind == "string" and readable:
        return F.concat(F.lit('"'), F.replace(F.replace(F.replace(a.col, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit('"'))
    return a.col.cast("string")


def _join_str(args: list[Arg], by: str, readable: bool, end: str = "") -> Result:
    out = F.concat_ws(by, *[_str_of(a, readable) for a in args]) if args else F.lit("")
    return Result(F.concat(out, F.lit(end)) if end else out, "string")


def _index(args: list[Arg]) -> Result:
    at = F.locate(args[1].value, args[0].col) if args[1].const else F.instr(args[0].col, args[1].col)
    return Result(F.when(at > 0, (at - 1).cast("bigint")), "long", True)


def _last_index(args: list[Arg]) -> Result:
    s, n = args[0].col, args[1].col
    at = F.instr(F.reverse(s), F.reverse(n))
    return Result(F.when(at > 0, (F.length(s) - at - F.length(n) + 1).cast("bigint")), "long", True)


def _subs(args: list[Arg]) -> Result:
    s, a = args[0].col, args[1].col
    b = args[2].col if len(args) > 2 else F.length(s)
    bad = (a < 0) | (b < a) | (b > F.length(s))
    return Result(F.when(bad, F.raise_error(F.lit("String index out of range"))).otherwise(s.substr(a + 1, b - a)), "string")


def _replace(args: list[Arg], first: bool = False) -> Result:
    s, what, new = args
    if _is_regex(what):
        p = pattern_of(what)
        if first:
            return Result(F.regexp_replace(s.col, F.concat(F.lit("^((?s:.*?))(?:"), p, F.lit(")")), F.concat(F.lit("$1"), new.col)), "string")
        return Result(F.regexp_replace(s.col, p, new.col), "string")
    if first:
        at = F.instr(s.col, what.col)
        return Result(F.when(at > 0, F.concat(s.col.substr(F.lit(1), at - 1), new.col, s.col.substr(at + F.length(what.col), F.length(s.col)))).otherwise(s.col), "string")
    return Result(F.replace(s.col, what.col, new.col), "string")


def _split(args: list[Arg]) -> Result:
    s, p = args[0].col, args[1]
    regex = _is_regex(p)
    pattern = pattern_of(p) if regex else F.lit(re.escape(str(p.value))) if p.const else F.concat(F.lit("\\Q"), p.col, F.lit("\\E"))
    if len(args) > 2:
        return Result(F.split(s, pattern, int(args[2].value)), "array")
    out = F.split(s, pattern, -1)
    if regex:
        # a regular expression drops empty strings at both ends
        out = F.when((F.size(out) > 0) & (out[0] == ""), F.slice(out, 2, F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(out)
        out = F.when((F.size(out) > 0) & (F.element_at(out, F.greatest(F.size(out), F.lit(1))) == ""), F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(out)
    return Result(out, "array")


def _get(args: list[Arg]) -> Result:
    c, k = args[0], args[1]
    if c.kind == "map":
        v = F.try_element_at(c.col, k.col)
    elif c.kind == "set":
        v = F.when(F.array_contains(c.col, k.col), k.col)
    else:
        v = F.get(c.col, k.col.cast("int"))
    if len(args) > 2:
        return Result(F.coalesce(v, args[2].col), args[2].kind)
    return Result(v, k.kind if c.kind == "set" else "unknown", True)


def _range(args: list[Arg]) -> Result:
    cols = [a.col.cast("bigint") for a in args]
    start, end, step = (F.lit(0).cast("bigint"), cols[0], F.lit(1)) if len(cols) == 1 else (*cols, F.lit(1)) if len(cols) == 2 else cols
    step = step.cast("bigint")
    if len(args) == 3 and args[2].const and args[2].value == 0:
        raise QueryError("the step of a range must not be 0")
    some = ((step > 0) & (start < end)) | ((step < 0) & (start > end))
    last = F.when(step > 0, end - 1).otherwise(end + 1)
    return Result(F.when(some, F.sequence(start, last, step)).otherwise(F.array().cast("array<bigint>")), "long", rows=True)


def _same(args: list[Arg]) -> tuple[list[Column], str]:
    kinds = {a.kind for a in args}
    if len(kinds) <= 1:
        return [a.col for a in args], (kinds.pop() if kinds else "string")
    if kinds <= set(NUMBERS):
        return [a.col.cast("double") for a in args], "double"
    return [tagged(a.col, a.kind) for a in args], "any"


def _array(args: list[Arg]) -> Result:
    return Result(F.array(*_same(args)[0]) if args else F.array(), "array")


def _list(args: list[Arg]) -> Result:
    return Result(_array(args).col, "list")


def _map(args: list[Arg]) -> Result:
    if len(args) % 2:
        raise QueryError("hash-map needs an even number of arguments")
    k, v = _same(args[::2])[0], _same(args[1::2])[0]
    return Result(F.map_from_arrays(F.array(*k), F.array(*v)), "map")


def _choose(args: list[Arg], first_truthy: bool) -> Result:
    cols, kind = _same(args)
    out = cols[-1]
    for a, c in list(zip(args, cols, strict=True))[-2::-1]:
        out = F.when(truthy(a) if first_truthy else ~truthy(a), c).otherwise(out)
    return Result(out, kind)


def _extremum(pick):
    def run(args: list[Arg]) -> Result:
        cols, kind = _same(args)
        return Result(pick(*cols) if len(cols) > 1 else cols[0], kind)

    return run


def _compare(args: list[Arg]) -> Result:
    a, b = keys(args)
    return Result(F.when(a < b, -1).when(a > b, 1).otherwise(0).cast("bigint"), "long")


def _rand_int(args: list[Arg]) -> Result:
    n = args[0].col
    if args[0].const and not args[0].value > 0:
        raise QueryError("rand-int needs a positive number")
    checked = F.when(n > 0, n).otherwise(F.raise_error(F.lit("rand-int needs a positive number")).cast("bigint"))
    return Result(F.floor(F.rand() * checked).cast("bigint"), "long")


def _text(f, kind: str = "string", drop: bool = False):
    return lambda x: Result(f(*[a.col for a in x]), kind, drop)


def _name(args: list[Arg]) -> Result:
    bare = F.regexp_replace(args[0].col, "^:", "")
    return Result(F.element_at(F.split(bare, "/"), -1), "string")


def _namespace(args: list[Arg]) -> Result:
    bare = F.regexp_replace(args[0].col, "^:", "")
    return Result(F.when(F.instr(bare, "/") > 0, F.regexp_extract(bare, "^(.*)/", 1)), "string", True)


def _keyword(args: list[Arg]) -> Result:
    cols = [F.regexp_replace(a.col, "^:", "") for a in args]
    return Result(F.concat(F.lit(":"), F.concat_ws("/", *cols)), "keyword")


TYPES = {"long": "int", "entity": "ref", "double": "float", "string": "string", "keyword": "keyword", "symbol": "symbol", "bool": "bool", "ts": "instant", "uuid": "uuid", "nil": "nil", "array": "vector", "list": "list", "set": "set", "map": "map", "struct": "tuple", "regex": "regex"}


def _type(args: list[Arg]) -> Result:
    (a,) = args
    if a.kind != "any":
        return Result(F.lit(f":type/{TYPES.get(a.kind, a.kind)}"), "keyword")
    r = a.col["rank"]
    out = F.when(r == 9, F.when(a.col["lng"].isNotNull(), ":type/int").otherwise(":type/float"))
    for rank, n in ((0, "nil"), (1, "keyword"), (2, "symbol"), (3, "map"), (4, "set"), (5, "list"), (6, "vector"), (7, "tuple"), (8, "bool"), (10, "string"), (12, "instant"), (13, "uuid")):
        out = out.when(r == rank, f":type/{n}")
    return Result(out, "keyword")


def _escape(args: list[Arg]) -> Result:
    table = args[1].value
    chars = F.split(args[0].col, "")
    def one(c):
        out = c
        for k, v in table.items():
            out = F.when(c == k, F.lit(v)).otherwise(out)
        return out
    return Result(F.array_join(F.transform(chars, one), ""), "string")


FUNCTIONS: dict[str, Callable[[list[Arg]], Result]] = {
    "+": _arith(lambda a, b: a + b, 0), "-": _arith(lambda a, b: a - b, 0), "*": _arith(lambda a, b: a * b, 1), "/": _divide,
    "quot": _int2(lambda x, y: F.when(y == 0, F.raise_error(F.lit("Divide by zero")).cast("bigint")).otherwise(F.try_divide(x - F.try_mod(x, y), y))), "rem": _int2(lambda x, y: x % y), "mod": _int2(lambda x, y: ((x % y) + y) % y),
    "inc": lambda x: FUNCTIONS["+"]([*x, Arg(F.lit(1), "long")]), "dec": lambda x: FUNCTIONS["-"]([*x, Arg(F.lit(1), "long")]),
    "compare": _compare, "min": _extremum(F.least), "max": _extremum(F.greatest), "rand": lambda x: Result(F.rand(), "double"), "rand-int": _rand_int,
    "identity": lambda x: Result(x[0].col, x[0].kind), "ground": lambda x: Result(x[0].col, x[0].kind), "not": lambda x: Result(~truthy(x[0]), "bool"), "and": lambda x: _choose(x, False), "or": lambda x: _choose(x, True),
    "lower-case": _text(F.lower), "upper-case": _text(F.upper), "capitalize": lambda x: Result(F.concat(F.upper(x[0].col.substr(1, 1)), F.lower(x[0].col.substr(F.lit(2), F.length(x[0].col)))), "string"), "reverse": _text(F.reverse),
    "trim": _text(lambda c: F.btrim(c, F.lit(SPACE))), "triml": _text(lambda c: F.ltrim(c, F.lit(SPACE))), "trimr": _text(lambda c: F.rtrim(c, F.lit(SPACE))), "trim-newline": _text(lambda c: F.rtrim(c, F.lit("\n\r"))),
    "index-of": _index, "last-index-of": _last_index, "subs": _subs, "str": lambda x: _join_str(x, "", False), "print-str": lambda x: _join_str(x, " ", False), "println-str": lambda x: _join_str(x, " ", False, "\n"), "pr-str": lambda x: _join_str(x, " ", True), "prn-str": lambda x: _join_str(x, " ", True, "\n"),
    "join": lambda x: Result(F.array_join(x[-1].col.cast("array<string>"), x[0].value if len(x) > 1 else ""), "string"), "replace": _replace, "replace-first": lambda x: _replace(x, True), "escape": _escape,
    "re-pattern": lambda x: Result(x[0].col, "regex"), "re-find": lambda x: Result(F.regexp_substr(x[1].col, pattern_of(x[0])), "string", True), "re-matches": lambda x: Result(F.when(F.rlike(x[1].col, whole_pattern(x[0])), x[1].col), "string", True),
    "re-seq": lambda x: Result(F.when(F.rlike(x[1].col, pattern_of(x[0])), F.regexp_extract_all(x[1].col, pattern_of(x[0]), F.lit(0))), "array", True), "split": _split, "split-lines": lambda x: Result(F.split(x[0].col, "\r\n|\r|\n"), "array"),
    "name": _name, "namespace": _namespace, "keyword": _keyword, "type": _type, "meta": lambda x: Result(F.lit(None).cast("string"), "nil"),
    "vector": _array, "list": _list, "set": lambda x: Result(F.array_sort(F.array_distinct(_array(x).col)), "set"), "hash-map": _map, "array-map": _map, "get": _get, "count": lambda x: Result(_size(x[0]).cast("bigint"), "long"), "range": _range,
    "tuple": lambda x: Result(F.struct(*[a.col.alias(f"t{k}") for k, a in enumerate(x)]), "struct"), "untuple": lambda x: Result(x[0].col, x[0].kind),
}
TAGGED_DDL = TAGGED


def bare(name: str) -> str:
    """Names may be written with a namespace of the string library."""
    for space in ("clojure.string/", "str/", "string/"):
        if name.startswith(space):
            return name[len(space) :]
    return name

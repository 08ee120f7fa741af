"""Ordered index access: datoms, seeks, ranges, differences and hashes.

Indexes are orders, not copies: a scan filters the attribute's relation and
sorts by the index's key.  Values compare across types (see order_key).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.registry import Arg, order_key
from quarry.sources.database import Attr, Database, SchemaError, literal

ORDERS = {":eavt": ("e", "a", "v", "tx"), ":aevt": ("a", "e", "v", "tx"), ":avet": ("a", "v", "e", "tx")}


def _check(db: Database, order: str, attr) -> None:
    if order not in ORDERS:
        raise SchemaError(f"unknown index {order}")
    if order == ":avet" and attr is not None and attr not in db.virtual and attr != ":db/ident" and not db.schema.get(attr, Attr()).avet:
        raise SchemaError(f"Attribute {attr} should be marked as :db/index true")


def _bounds(db: Database, order: str, parts: tuple) -> dict:
    out = dict(zip(ORDERS[order], parts, strict=False))
    if "e" in out and not isinstance(out["e"], int):
        out["e"] = db.entid(out["e"])
    return out


def datoms(db: Database, order: str, *parts) -> DataFrame:
    """e, a, v, tx, added of the facts that agree with the given leading parts of the index, in its order.

    With a constant attribute v keeps its own type; else it is the tagged struct.
    """
    at = _bounds(db, order, parts)
    attr = str(at["a"]) if "a" in at else None
    _check(db, order, attr)
    if attr is not None:
        df, kind = db.relation(attr).withColumn("a", F.lit(attr)), db.kind(attr)
    else:
        attrs = db.attrs() if order != ":avet" else [a for a in db.attrs() if db.schema.get(a, Attr()).avet or a in db.virtual]
        df, kind = db.datoms_frame(attrs), "any"
    v = Arg(F.col("v"), kind)
    if "e" in at:
        df = df.filter(F.col("e") == F.lit(at["e"]).cast("bigint")) if at["e"] is not None else df.filter(F.lit(False))
    if "v" in at:
        df = df.filter(order_key(v) == order_key(Arg(*literal(at["v"]))))
    if "tx" in at:
        df = df.filter(F.col("tx") == at["tx"])
    keys = {"v": order_key(v)}
    return df.select("e", "a", "v", "tx", "added").orderBy(*[keys.get(c, F.col(c)) for c in ORDERS[order]])


def find_datom(db: Database, order: str, *parts):
    """The first such fact, or None."""
    found = datoms(db, order, *parts).limit(1).collect()
    return found[0] if found else None


def fold_datoms(db: Database, order: str, *parts, agg):
    """Aggregates over such facts, without an order."""
    return datoms(db, order, *parts).agg(*(agg if isinstance(agg, (list, tuple)) else [agg]))


def _seek(db: Database, order: str, parts: tuple, down: bool) -> DataFrame:
    at = _bounds(db, order, parts)
    _check(db, order, str(at["a"]) if "a" in at else None)
    attrs = db.attrs() if order != ":avet" else [a for a in db.attrs() if db.schema.get(a, Attr()).avet or a in db.virtual]
    if "a" in at and ORDERS[order][0] == "a":
        attrs = [a for a in attrs if (a <= str(at["a"]) if down else a >= str(at["a"]))]
    df = db.datoms_frame(attrs)
    cols = {"e": F.col("e"), "a": F.col("a"), "v": order_key(Arg(F.col("v"), "any")), "tx": F.col("tx")}
    lits = {"e": lambda x: F.lit(x).cast("bigint"), "a": lambda x: F.lit(str(x)), "v": lambda x: order_key(Arg(*literal(x))), "tx": lambda x: F.lit(x).cast("bigint")}
    names = ORDERS[order][: len(parts)]
    if names:
        have = F.struct(*[cols[n].alias(n) for n in names])
        want = F.struct(*[lits[n](at[n]).alias(n) for n in names])
        df = df.filter(have <= want if down else have >= want)
    return df.orderBy(*[cols[c].desc() if down else cols[c] for c in ORDERS[order]])


def seek_datoms(db: Database, order: str, *parts) -> DataFrame:
    """Facts from the given place of the index to its end, over all attributes."""
    return _seek(db, order, parts, False)


def rseek_datoms(db: Database, order: str, *parts) -> DataFrame:
    """Facts from the given place back to the start, in reverse order."""
    return _seek(db, order, parts, True)


def index_range(db: Database, attr: str, start=None, end=None) -> DataFrame:
    """Facts of an attribute with values from start to end, both included; None is open.  In order of value."""
    _check(db, ":avet", attr)
    df, kind = db.relation(attr).withColumn("a", F.lit(attr)), db.kind(attr)
    plain = kind in ("long", "double", "entity", "string", "ts")
    for bound, up in ((start, True), (end, False)):
        if bound is None:
            continue
        col, k = literal(bound)
        if plain and (k == kind or {k, kind} <= {"long", "double", "entity"}):
            x, y = F.col("v"), col  # reaches the scan as a pushed filter
        else:
            x, y = order_key(Arg(F.col("v"), kind)), order_key(Arg(col, k))
        df = df.filter(x >= y if up else x <= y)
    return df.select("e", "a", "v", "tx", "added").orderBy("v" if plain else order_key(Arg(F.col("v"), kind)), "e", "tx")


def diff(a: Database, b: Database) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Facts (e, a, v) only in the first, only in the second, and in both."""
    x, y = (db.datoms_frame().select("e", "a", "v") for db in (a, b))

    l, r = x.alias("l"), y.alias("r")
    same = (F.col("l.e") == F.col("r.e")) & (F.col("l.a") == F.col("r.a")) & F.col("l.v").eqNullSafe(F.col("r.v"))
    flipped = (F.col("r.e") == F.col("l.e")) & (F.col("r.a") == F.col("l.a")) & F.col("r.v").eqNullSafe(F.col("l.v"))
    return l.join(r, same, "left_anti"), r.join(l, flipped, "left_anti"), l.join(r, same, "left_semi")


def db_hash(db: Database) -> int:
    """A value of the facts alone, whatever their order."""
    r = db.datoms_frame().select(F.xxhash64("e", "a", "v").alias("h")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.pmod("h", F.lit(1 << 31))).alias("s")).first()
    return hash((r.n, r.s))


def same_facts(a: Database, b: Database) -> bool:
    left, right, _ = diff(a, b)
    return left.isEmpty() and right.isEmpty()


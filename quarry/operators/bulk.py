"""Set-based writes: frames of facts, entities and keys go through joins, never through the driver.

A write to a column of a wide table first makes that column a stored attribute
(a projection, nothing is copied), so later reads see the write; other columns
of the table stay as they are.  Every function returns a new database.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.transact import TransactionError
from quarry.plans.scratch import cut
from quarry.sources.database import TX0, Attr, Database, SchemaError, kind_of_type, tagged

FACT = ("e", "v", "tx", "added")
#: What a declared type allows as kinds of a column.
TYPES = {
    ":db.type/string": {"string"}, ":db.type/long": {"long", "entity"}, ":db.type/ref": {"long", "entity"}, ":db.type/double": {"double"}, ":db.type/float": {"double"},
    ":db.type/boolean": {"bool"}, ":db.type/instant": {"ts"}, ":db.type/keyword": {"string", "keyword"}, ":db.type/uuid": {"string", "uuid"},
}


@dataclass(frozen=True)
class BulkReport:
    db_before: Database
    db_after: Database
    tx_data: DataFrame  # e, a, v (tagged), tx, added


def _checked(db: Database, attr: str, frame: DataFrame) -> DataFrame:
    want = TYPES.get(db.schema.get(attr, Attr()).value_type or "")
    have = kind_of_type(frame.schema["v"].dataType)
    if want and have not in want:
        raise TransactionError(f"Cannot add to {attr}: values of kind {have}, {db.schema[attr].value_type} is declared")
    return frame


def _unique(db: Database, attr: str) -> None:
    """One aggregate: no value of a unique attribute stands for two entities."""
    if db.schema.get(attr, Attr()).unique:
        twice = db.stored[attr].groupBy("v").agg(F.min("e").alias("a"), F.max("e").alias("b")).filter("a <> b").limit(1).collect()
        if twice:
            raise TransactionError(f"Cannot add to {attr} because of unique constraint: {twice[0].v!r}")


def bulk_add(db: Database, attr: str, frame: DataFrame, tx: int = TX0 + 1) -> Database:
    """Add a frame of facts (e, v) of one attribute: cardinality one replaces, equal facts stay as they are.

    Of several values for one entity of a cardinality-one attribute the greatest stays.  Declared types and
    unique values are checked.  Tuples over the attribute are made anew.
    """
    return bulk_report(db, attr, frame, tx).db_after


def bulk_report(db: Database, attr: str, frame: DataFrame, tx: int = TX0 + 1) -> BulkReport:
    """bulk_add() with the facts that it asserted and retracted."""
    s = db.schema.get(attr, Attr())
    if s.tuple_attrs:
        raise TransactionError(f"Cannot add to {attr}: it is made from {', '.join(s.tuple_attrs)}")
    new = _checked(db, attr, frame).select(F.col("e").cast("bigint").alias("e"), "v").filter("e is not null and v is not null")
    new = new.distinct() if s.many else new.groupBy("e").agg(F.max("v").alias("v"))
    new = new.withColumns({"tx": F.lit(tx).cast("bigint"), "added": F.lit(True)})
    base = db.detached(attr)
    if attr not in base.stored:
        out = base.with_relation(attr, new)
        fresh, gone = new, new.limit(0)
    else:
        old = base.stored[attr]
        new = new.withColumn("v", F.col("v").cast(old.schema["v"].dataType))
        fresh = new.join(old.select("e", "v"), ["e", "v"], "left_anti").select(*FACT)
        gone = old.limit(0) if s.many else old.join(fresh.select("e"), "e", "left_semi").select(*FACT)
        rest = old if s.many else old.join(fresh.select("e"), "e", "left_anti").select(*FACT)
        out = replace(base, stored=base.stored | {attr: rest.select(*FACT).unionByName(fresh)})
    _unique(out, attr)
    out = _tuples(out, attr, tx)
    kind = out.kind(attr)
    row = lambda df, added: df.select("e", F.lit(attr).alias("a"), tagged(F.col("v"), kind).alias("v"), F.lit(tx).cast("bigint").alias("tx"), F.lit(added).alias("added"))
    return BulkReport(db, out, row(gone, False).unionByName(row(fresh, True)))


def _tuples(db: Database, changed: str, tx: int) -> Database:
    """Tuple attributes over a changed one, from their sources: absent parts are null, all absent is no fact."""
    for attr, s in db.schema.items():
        if changed not in s.tuple_attrs:
            continue
        joined = None
        for k, source in enumerate(s.tuple_attrs):
            one = db.relation(source).select("e", F.col("v").alias(f"t{k}"))
            joined = one if joined is None else joined.join(one, "e", "full_outer")
        value = F.struct(*[F.col(f"t{k}") for k in range(len(s.tuple_attrs))])
        db = db.with_relation(attr, joined.select("e", value.alias("v"), F.lit(tx).cast("bigint").alias("tx"), F.lit(True).alias("added")), "struct")
        _unique(db, attr)
    return db


def bulk_retract_facts(db: Database, attr: str, frame: DataFrame) -> Database:
    """Remove facts of one attribute: those of (e, v), or all of an entity where the frame has e alone."""
    base = db.detached(attr)
    if attr not in base.stored:
        return db
    keys = [c for c in ("e", "v") if c in frame.columns]
    gone = frame.select(*[F.col(c).cast(base.stored[attr].schema[c].dataType).alias(c) for c in keys]).distinct()
    return _tuples(replace(base, stored=base.stored | {attr: base.stored[attr].join(gone, keys, "left_anti").select(*FACT)}), attr, TX0 + 1)


def bulk_retract_attribute(db: Database, attr: str, ids: DataFrame) -> Database:
    """Remove all values of an attribute of the entities (column e); the components that it names go with all of theirs."""
    s = db.schema.get(attr, Attr())
    if s.component and attr in db.attrs():
        children = db.relation(attr).join(ids.select(F.col("e").cast("bigint").alias("e")).distinct(), "e", "left_semi").select(F.col("v").cast("bigint").alias("e"))
        db = bulk_retract(db, children)
    return bulk_retract_facts(db, attr, ids.select("e"))


def bulk_retract(db: Database, ids: DataFrame) -> Database:
    """Remove entities (column e): their facts, rows of tables included, their components' (to any depth) and all references to them."""
    refs = [a for a, s in db.schema.items() if s.ref and a in db.attrs()]
    parts = [db.relation(a).select("e", F.col("v").cast("bigint").alias("child")) for a in refs if db.schema[a].component]
    gone = ids.select(F.col("e").cast("bigint").alias("e")).filter("e is not null").distinct()
    if parts:
        edges = parts[0]
        for p in parts[1:]:
            edges = edges.unionByName(p)
        delta = gone = cut(gone)
        while True:
            delta = cut(delta.join(edges, "e").select(F.col("child").alias("e")).distinct().join(gone, "e", "left_anti"))
            if delta.isEmpty():
                break
            gone = cut(gone.unionByName(delta))
    for a in refs:
        db = db.detached(a)  # a reference in a table goes without its row
    stored = {}
    for a, rel in db.stored.items():
        rel = rel.join(gone, "e", "left_anti")
        if a in refs:
            rel = rel.join(gone.select(F.col("e").alias("v")), "v", "left_anti")
        stored[a] = rel.select(*FACT)
    tables = {}
    for n, t in db.tables.items():
        left = t.rows().withColumn("__entity", t.entity()).join(gone.select(F.col("e").alias("__entity")), "__entity", "left_anti").drop("__entity")
        out = replace(t, frame=left)
        if not t.key:
            out._numbered = left  # rows keep their numbers
        tables[n] = out
    return replace(db, stored=stored, tables=tables)


def bulk_upsert(db: Database, identity: str, frame: DataFrame, attrs: dict[str, str], tx: int = TX0 + 1) -> Database:
    """Rows as entity maps: the one whose ``identity`` attribute has the row's value, or a new entity.

    attrs: attribute -> column, the identity's included.  Of rows that repeat an identity one entity is made,
    and the greatest value of each attribute stays.  NULL cells assert nothing; a NULL identity is an error.
    """
    if db.schema.get(identity, Attr()).unique != "identity":
        raise SchemaError(f"{identity} should be marked as :db.unique/identity")
    key = attrs[identity]
    if not frame.filter(F.col(key).isNull()).isEmpty():
        raise TransactionError(f"a row has no {identity}")
    known = db.relation(identity).select("e", F.col("v").alias("_v"))
    found = frame.join(known, frame[key] == F.col("_v"), "left")
    top = db.datoms_frame().agg(F.max("e")).first()[0] or 0
    # numbered once and written, so that every attribute sees the same new ids
    fresh = cut(found.filter("e is null").select(F.col(key).alias("_v")).distinct().withColumn("_new", F.monotonically_increasing_id() + F.lit(top + 1)))
    rows = found.drop("_v").join(fresh, frame[key] == fresh["_v"], "left").withColumn("e", F.coalesce("e", "_new"))
    rows = cut(rows.select("e", *[F.col(c).alias(f"c{k}") for k, c in enumerate(attrs.values())]))
    for k, a in enumerate(attrs):
        db = bulk_add(db, a, rows.select("e", F.col(f"c{k}").alias("v")), tx)
    return db


def bulk_cas(db: Database, attr: str, frame: DataFrame, tx: int = TX0 + 1) -> Database:
    """Compare and set (e, old, new) at once: any old value that is not the current one (NULL: absent) is an error."""
    now = db.relation(attr).select("e", F.col("v").alias("_now"))
    wrong = frame.join(now, "e", "left").filter(~F.col("old").eqNullSafe(F.col("_now"))).limit(1).collect()
    if wrong:
        raise TransactionError(f":db.fn/cas failed on {attr} of {wrong[0].e}: expected {wrong[0].old!r}, got {wrong[0]._now!r}")
    return bulk_add(db, attr, frame.select("e", F.col("new").alias("v")), tx)


def by_lookup(db: Database, attr: str, frame: DataFrame, column: str) -> DataFrame:
    """frame with e: the entity whose unique attribute has the value of ``column``; rows that name none go."""
    if not db.schema.get(attr, Attr()).unique:
        raise SchemaError(f"Lookup ref attribute should be marked as :db/unique: {attr}")
    return frame.join(db.relation(attr).select("e", F.col("v").alias("_v")), frame[column] == F.col("_v")).drop("_v")

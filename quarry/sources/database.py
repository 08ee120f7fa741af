"""Databases of facts: attributes that resolve to columns of wide tables or to stored relations (e, v, tx).

A virtual attribute is a column of a wide frame, whose rows are entities; no row
is copied, and patterns about one entity of one table become a single scan.  A
stored attribute is a typed frame of its own.  A NULL is no fact.
"""

from __future__ import annotations

import datetime as dt
import json
import re
import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.edn import Keyword, Symbol

#: Fixed values of the data model: the first transaction, the largest entity id.
TX0, MAX_ENTITY = 0x20000000, 0x7FFFFFFF
#: Entity ids of a table's rows: its ordinal above so many bits of the key.
KEY_BITS = 48
#: The column that numbers the rows of a table without a key.
ROW = "__row"


@dataclass(frozen=True)
class Attr:
    """Schema of an attribute."""

    many: bool = False
    unique: str | None = None  # "value" or "identity"
    indexed: bool = False
    ref: bool = False
    component: bool = False
    no_history: bool = False
    value_type: str | None = None
    tuple_attrs: tuple = ()
    tuple_types: tuple = ()
    doc: str | None = None

    @property
    def avet(self) -> bool:
        return self.ref or self.indexed or bool(self.unique) or bool(self.tuple_attrs)


class SchemaError(ValueError):
    pass


def schema_of(form: dict) -> dict[str, Attr]:
    """Schema from maps of :db/... keys."""
    out = {}
    for name, d in form.items():
        if isinstance(d, Attr):
            out[str(name)] = d
            continue
        d = {str(k): v for k, v in d.items()}
        vt = d.get(":db/valueType")
        a = Attr(
            many=d.get(":db/cardinality") == ":db.cardinality/many",
            unique={":db.unique/identity": "identity", ":db.unique/value": "value"}.get(d.get(":db/unique")),
            indexed=bool(d.get(":db/index")),
            ref=vt == ":db.type/ref",
            component=bool(d.get(":db/isComponent")),
            no_history=bool(d.get(":db/noHistory")),
            value_type=str(vt) if vt else None,
            tuple_attrs=tuple(str(x) for x in d.get(":db/tupleAttrs") or ()),
            tuple_types=tuple(str(x) for x in d.get(":db/tupleTypes") or ()),
            doc=d.get(":db/doc"),
        )
        if a.component and not a.ref:
            raise SchemaError(f"Bad attribute specification for {name}: {{:db/isComponent true}} should also have {{:db/valueType :db.type/ref}}")
        if a.tuple_attrs and a.many:
            raise SchemaError(f"Bad attribute specification for {name}: a tuple attribute must be of cardinality one")
        out[str(name)] = a
    for name, a in out.items():
        if any(out.get(s, Attr()).tuple_attrs or out.get(s, Attr()).many for s in a.tuple_attrs):
            raise SchemaError(f"Bad attribute specification for {name}: its sources must be of cardinality one and no tuples")
    return out


# ---- values ---------------------------------------------------------------------------------------------------------

#: One orderable struct for values of any type: type rank first, then the value itself.
TAGGED = "struct<rank: int, num: double, lng: bigint, str: string>"
RANKS = {"nil": 0, "keyword": 1, "symbol": 2, "bool": 8, "long": 9, "entity": 9, "double": 9, "string": 10, "regex": 11, "ts": 12, "uuid": 13, "map": 3, "set": 4, "list": 5, "array": 6, "struct": 7}
SPARK = {"long": "bigint", "entity": "bigint", "double": "double", "string": "string", "keyword": "string", "symbol": "string", "bool": "boolean", "ts": "timestamp", "uuid": "string", "any": TAGGED}


def kind_of(v) -> str:
    if v is None:
        return "nil"
    if isinstance(v, bool):
        return "bool"
    if isinstance(v, Keyword):
        return "keyword"
    if isinstance(v, Symbol):
        return "symbol"
    if isinstance(v, int):
        return "long"
    if isinstance(v, float):
        return "double"
    if isinstance(v, str):
        return "string"
    if isinstance(v, dt.datetime):
        return "ts"
    if isinstance(v, uuid.UUID):
        return "uuid"
    if isinstance(v, re.Pattern):
        return "regex"
    if isinstance(v, (set, frozenset)):
        return "set"
    if isinstance(v, dict):
        return "map"
    if isinstance(v, (list, tuple)):
        return "array"
    raise TypeError(f"no kind for {v!r}")


def kind_of_type(t: T.DataType) -> str:
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "long"
    if isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "double"
    if isinstance(t, (T.TimestampType, T.DateType, T.TimestampNTZType)):
        return "ts"
    if isinstance(t, T.ArrayType):
        return "array"
    if isinstance(t, T.MapType):
        return "map"
    if isinstance(t, T.StructType):
        return "any" if t.simpleString() == T._parse_datatype_string(TAGGED).simpleString() else "struct"
    return "string"


def tagged(c: Column, kind: str) -> Column:
    """A column of a known kind as the tagged struct."""
    if kind == "any":
        return c
    rank = F.lit(RANKS[kind])
    num, lng, s = F.lit(None).cast("double"), F.lit(None).cast("bigint"), F.lit(None).cast("string")
    if kind in ("long", "entity"):
        num, lng = c.cast("double"), c.cast("bigint")
    elif kind == "double":
        num = c.cast("double")
    elif kind == "bool":
        lng = c.cast("bigint")
    elif kind == "ts":
        lng = F.unix_millis(c)
    elif kind in ("array", "list", "set", "map", "struct"):
        s = F.to_json(c)
    else:
        s = c.cast("string")
    return F.when(c.isNotNull(), F.struct(rank.alias("rank"), num.alias("num"), lng.alias("lng"), s.alias("str")))


def tag_value(v):
    """A Python value as the tagged struct's tuple."""
    k = kind_of(v)
    if k == "long":
        return (9, float(v), v, None)
    if k == "double":
        return (9, v, None, None)
    if k == "bool":
        return (8, None, int(v), None)
    if k == "ts":
        return (12, None, int(v.replace(tzinfo=dt.UTC).timestamp() * 1000), None)
    if k == "nil":
        return (0, None, None, None)
    if k in ("array", "set", "map"):
        return (RANKS[k], None, None, json_text(v))
    return (RANKS[k], None, None, str(v) if k != "regex" else v.pattern)


def json_text(v) -> str:
    """A collection as the text that to_json gives for the same collection as a column."""
    if isinstance(v, (set, frozenset)):
        v = sorted(v, key=lambda x: (str(type(x)), x))
    if isinstance(v, (list, tuple)):
        v = [list(x) if isinstance(x, (tuple, set, frozenset)) else x for x in v]
    return json.dumps(v, separators=(",", ":"), ensure_ascii=False, default=str)


def untag(t):
    """The Python value of a collected tagged struct."""
    if t is None or t["rank"] == 0:
        return None
    rank = t["rank"]
    if rank == 9:
        return t["lng"] if t["lng"] is not None else t["num"]
    if rank == 8:
        return bool(t["lng"])
    if rank == 12:
        return dt.datetime.fromtimestamp(t["lng"] / 1000, dt.UTC).replace(tzinfo=None)
    return {1: Keyword, 2: Symbol, 13: uuid.UUID}.get(rank, str)(t["str"])


def literal(v) -> tuple[Column, str]:
    k = kind_of(v)
    if k in ("array", "set"):
        items = [literal(x) for x in v]
        kinds = {x[1] for x in items}
        out = F.array(*[tagged(*x) for x in items]) if len(kinds) > 1 else F.array(*[x[0] for x in items])
        return (F.array_sort(F.array_distinct(out)) if k == "set" and items else out), k
    if k == "map":
        parts = [[literal(x) for x in xs] for xs in (v.keys(), v.values())]
        flat = [[tagged(*x) for x in xs] if len({x[1] for x in xs}) > 1 else [x[0] for x in xs] for xs in parts]
        return F.create_map(*[c for kv in zip(*flat, strict=True) for c in kv]), k
    if k == "uuid":
        return F.lit(str(v)), k
    if k == "regex":
        return F.lit(v.pattern), k
    if k == "long":
        return F.lit(v).cast("bigint"), k
    if k in ("keyword", "symbol"):
        return F.lit(str(v)), k
    if k == "nil":
        return F.lit(None).cast("string"), k
    return F.lit(v), k


@dataclass
class Table:
    """A wide frame whose rows are entities."""

    name: str
    frame: DataFrame
    key: str | None
    ordinal: int

    def rows(self) -> DataFrame:
        """The frame with what entity() reads.

        Rows without a key are numbered before anything is filtered, by their place in the files, which
        every scan of the same files sees alike; a frame that is no plain scan is numbered once and written.
        """
        if self.key:
            return self.frame
        if self._numbered is None:
            from quarry.plans.scratch import cut

            out = self.frame.withColumn(ROW, F.monotonically_increasing_id())
            plain = self.frame._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation"
            self._numbered = out if plain else cut(out)
        return self._numbered

    _numbered: DataFrame | None = field(default=None, repr=False, compare=False)

    def entity(self) -> Column:
        """The entity of a row of rows()."""
        return F.lit(self.ordinal << KEY_BITS).cast("bigint") + F.col(f"`{self.key or ROW}`").cast("bigint")


@dataclass
class Database:
    """An immutable set of facts under a schema."""

    spark: SparkSession
    schema: dict[str, Attr] = field(default_factory=dict)
    tables: dict[str, Table] = field(default_factory=dict)
    virtual: dict[str, tuple[str, str]] = field(default_factory=dict)  # attribute -> table, column
    stored: dict[str, DataFrame] = field(default_factory=dict)  # attribute -> e, v, tx, added
    kinds: dict[str, str] = field(default_factory=dict)
    condition: object = None  # of a filtered database: (attr, e, v) -> Column

    # -- construction

    def with_table(self, name: str, frame: DataFrame, key: str | None = None, attrs: dict[str, str] | None = None, schema: dict[str, Attr] | None = None) -> Database:
        """Add a wide table; attrs: attribute -> column, ``:name/column`` for every column by default."""
        attrs = attrs or {f":{name}/{c}": c for c in frame.columns}
        tables = self.tables | {name: Table(name, frame, key, len(self.tables) + 1)}
        types = {f.name: kind_of_type(f.dataType) for f in frame.schema.fields}
        return replace(self, tables=tables, virtual=self.virtual | {a: (name, c) for a, c in attrs.items()}, kinds=self.kinds | {a: types[c] for a, c in attrs.items()}, schema=self.schema | (schema or {}))

    def with_relation(self, attr: str, frame: DataFrame, kind: str | None = None) -> Database:
        """Add a stored attribute: a frame with e, v and, if it has them, tx and added."""
        if "tx" not in frame.columns:
            frame = frame.withColumn("tx", F.lit(TX0).cast("bigint"))
        if "added" not in frame.columns:
            frame = frame.withColumn("added", F.lit(True))
        kind = kind or ("entity" if self.schema.get(attr, Attr()).ref else kind_of_type(frame.schema["v"].dataType))
        frame = frame.select(F.col("e").cast("bigint").alias("e"), _widen(F.col("v"), kind).alias("v"), F.col("tx").cast("bigint").alias("tx"), "added")
        return replace(self, stored=self.stored | {attr: frame}, kinds=self.kinds | {attr: kind})

    @staticmethod
    def of_datoms(spark: SparkSession, datoms, schema: dict[str, Attr] | None = None) -> Database:
        """A database of (e, a, v[, tx[, added]]) tuples, a typed frame an attribute; duplicates stay."""
        schema = schema or {}
        by: dict[str, list] = {}
        for d in datoms:
            e, a, v, *rest = d
            by.setdefault(str(a), []).append((e, v, rest[0] if rest else TX0, rest[1] if len(rest) > 1 else True))
        db = Database(spark, dict(schema))
        for a, rows in by.items():
            kinds = {kind_of(r[1]) for r in rows}
            kind = "entity" if schema.get(a, Attr()).ref and kinds == {"long"} else kinds.pop() if len(kinds) == 1 else "any"
            if kind == "array":
                frame = spark.createDataFrame([(e, [tag_value(x) for x in v], tx, op) for e, v, tx, op in rows], f"e bigint, v array<{TAGGED}>, tx bigint, added boolean")
            elif kind in ("any", "nil", "regex"):
                kind = "any"
                frame = spark.createDataFrame([(e, tag_value(v), tx, op) for e, v, tx, op in rows], f"e bigint, v {TAGGED}, tx bigint, added boolean")
            else:
                frame = spark.createDataFrame([(e, str(v) if kind in ("keyword", "symbol", "uuid") else v, tx, op) for e, v, tx, op in rows], f"e bigint, v {SPARK[kind]}, tx bigint, added boolean")
            db = replace(db, stored=db.stored | {a: frame}, kinds=db.kinds | {a: kind})
        return db

    def filter(self, condition) -> Database:
        """Only facts for which condition(attr, e, v) (a Column) holds; filters compose."""
        before = self.condition
        both = condition if before is None else (lambda a, e, v: before(a, e, v) & condition(a, e, v))
        return replace(self, condition=both)

    def one_row_each(self, table: str) -> bool:
        """Whether no two rows of a table are one entity: it has no key, or its key is declared unique."""
        key = self.tables[table].key
        return key is None or any(at == (table, key) and self.schema.get(a, Attr()).unique for a, at in self.virtual.items())

    def detached(self, attr: str) -> Database:
        """A column of a table as a stored attribute: the form that writes change."""
        if attr not in self.virtual:
            return self
        frame = replace(self, condition=None).relation(attr)
        return replace(self, virtual={a: at for a, at in self.virtual.items() if a != attr}, stored=self.stored | {attr: frame})

    # -- reading

    def attrs(self) -> list[str]:
        return [*self.virtual, *(a for a in self.stored if a not in self.virtual)]

    def relation(self, attr: str) -> DataFrame:
        """e, v, tx, added of an attribute; an unknown attribute has no facts."""
        if attr in self.virtual:
            name, column = self.virtual[attr]
            t = self.tables[name]
            out = t.rows().select(t.entity().alias("e"), _widen(F.col(f"`{column}`"), self.kinds[attr]).alias("v")).filter("v is not null").withColumns({"tx": F.lit(TX0).cast("bigint"), "added": F.lit(True)})
        elif attr in self.stored:
            out = self.stored[attr]
        else:
            return self.spark.createDataFrame([], "e bigint, v string, tx bigint, added boolean")
        return out if self.condition is None else out.filter(self.condition(attr, F.col("e"), F.col("v")))

    def kind(self, attr: str) -> str:
        return self.kinds.get(attr, "string")

    def datoms_frame(self, attrs: list[str] | None = None) -> DataFrame:
        """e, a, v (tagged), tx, added over several attributes; all by default.  A table is scanned once, whatever the number of its columns."""
        names = self.attrs() if attrs is None else attrs
        by: dict[str, list[str]] = {}
        for a in names:
            if a in self.virtual:
                by.setdefault(self.virtual[a][0], []).append(a)
        out = None
        for table, own in by.items():
            t = self.tables[table]
            entity = t.entity()
            pairs = []
            for a in own:
                c = _widen(F.col(f"`{self.virtual[a][1]}`"), self.kind(a))
                keep = c.isNotNull() if self.condition is None else c.isNotNull() & self.condition(a, entity, c)
                pairs.append(F.when(keep, F.struct(F.lit(a).alias("a"), tagged(c, self.kind(a)).alias("v"))))
            # a plain inner explode of the columns that hold something
            one = t.rows().select(entity.alias("e"), F.explode(F.array_compact(F.array(*pairs))).alias("p"))
            one = one.select("e", "p.a", "p.v", F.lit(TX0).cast("bigint").alias("tx"), F.lit(True).alias("added"))
            out = one if out is None else out.unionByName(one)
        for a in names:
            if a not in self.virtual:
                one = self.relation(a).select("e", F.lit(a).alias("a"), tagged(F.col("v"), self.kind(a)).alias("v"), "tx", "added")
                out = one if out is None else out.unionByName(one)
        return out if out is not None else self.spark.createDataFrame([], f"e bigint, a string, v {TAGGED}, tx bigint, added boolean")

    def entid(self, ref) -> int | None:
        """The entity id of an id, an ident, or a lookup ref [attr value]."""
        if isinstance(ref, bool) or ref is None:
            return None
        if isinstance(ref, int):
            return ref
        if isinstance(ref, Keyword):
            ref = [":db/ident", ref]
        attr, value = ref
        attr = str(attr)
        if attr != ":db/ident" and not self.schema.get(attr, Attr()).unique:
            raise SchemaError(f"Lookup ref attribute should be marked as :db/unique: {attr}")
        if value is None or attr not in self.kinds:
            return None
        col, kind = literal(value)
        want = col if kind == self.kind(attr) or self.kind(attr) != "any" else tagged(col, kind)
        found = self.relation(attr).filter(F.col("v") == want).select("e").limit(1).collect()
        return found[0].e if found else None


def _widen(c: Column, kind: str) -> Column:
    return c.cast(SPARK[kind]) if kind in ("long", "double", "entity") else c.cast("timestamp") if kind == "ts" else c

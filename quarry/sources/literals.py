"""EDN literals of whole databases; the tag may have any namespace.

``#x/DB {:schema {attr spec}, :datoms [[e a v tx] ...]}``; a fact may also be ``#x/Datom [e a v tx added]``.
"""

from __future__ import annotations

import math

from quarry import edn
from quarry.edn import Keyword, ReadError
from quarry.operators.transact import Datom, Facts, datom_of
from quarry.sources.database import Attr


def db_of(form) -> Facts:
    """The database of a literal's map; facts are taken as they are, without checks."""
    if not isinstance(form, dict):
        raise ReadError("a DB literal requires a map")
    datoms = form.get(Keyword(":datoms")) or []
    if not isinstance(datoms, list):
        raise ReadError(":datoms of a DB literal must be a vector or list")
    return Facts.of([d if isinstance(d, Datom) else datom_of(d) for d in datoms], form.get(Keyword(":schema")) or {})


def read_db(text: str) -> Facts:
    out = edn.read(text, {"DB": db_of, "Datom": datom_of})
    if not isinstance(out, Facts):
        raise ReadError("expected a DB literal")
    return out


def _spec(a: Attr) -> dict:
    unique = {"identity": ":db.unique/identity", "value": ":db.unique/value"}
    given = {
        ":db/valueType": a.value_type and Keyword(a.value_type),
        ":db/cardinality": a.many and Keyword(":db.cardinality/many"),
        ":db/unique": a.unique and Keyword(unique[a.unique]),
        ":db/index": a.indexed, ":db/isComponent": a.component, ":db/noHistory": a.no_history,
        ":db/tupleAttrs": [Keyword(x) for x in a.tuple_attrs], ":db/tupleTypes": [Keyword(x) for x in a.tuple_types],
        ":db/doc": a.doc,
    }
    return {Keyword(k): v for k, v in given.items() if v}


def write_db(db: Facts, namespace: str = "q") -> str:
    """The literal that read_db() reads as equal facts; numbers without end have no EDN form and raise."""
    rows = []
    for d in db.datoms():
        if isinstance(d.v, float) and not math.isfinite(d.v):
            raise ValueError(f"no EDN form for {d.v}")
        rows.append([d.e, Keyword(d.a), d.v, d.tx])
    return f"#{namespace}/DB " + edn.write({Keyword(":schema"): {Keyword(a): _spec(s) for a, s in db.schema.items()}, Keyword(":datoms"): rows})


def write_datom(d: Datom, namespace: str = "q") -> str:
    return f"#{namespace}/Datom " + edn.write([d.e, Keyword(d.a), d.v, d.tx, d.added])

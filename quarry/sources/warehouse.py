"""The tables of a data directory as one database: every column is an attribute of its table's rows."""

from __future__ import annotations

from pyspark.sql import SparkSession

from quarry.sources.database import Attr, Database

#: Table, key column (None: rows have no key), prefix of its columns.
TABLES = (
    ("region", "r_regionkey", "r_"), ("nation", "n_nationkey", "n_"), ("customer", "c_custkey", "c_"), ("supplier", "s_suppkey", "s_"), ("part", "p_partkey", "p_"),
    ("orders", "o_orderkey", "o_"), ("lineitem", None, "l_"), ("events", "event_id", ""), ("documents", "doc_id", ""), ("labels", "doc_id", ""), ("embeddings", "vec_id", ""),
    ("pages", "page_id", ""), ("benchmark", "item_id", ""), ("conversations", None, ""),
)


def warehouse(spark: SparkSession, sf_dir: str, only: tuple | None = None) -> Database:
    """Attributes are named ``:table/column`` without the column's prefix; files are read when a plan runs."""
    db = Database(spark)
    for name, key, prefix in TABLES:
        if only and name not in only:
            continue
        frame = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        attrs = {f":{name}/{c.removeprefix(prefix)}": c for c in frame.columns}
        keys = {f":{name}/{key.removeprefix(prefix)}": Attr(unique="identity")} if key else {}
        db = db.with_table(name, frame, key, attrs, keys)
    return db

"""The driver contract at the smallest scale; sampled queries against DuckDB."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


#: One or more of each family; the driver runs all of them.
FAMILIES = (
    "types_of_values", "printing_collections", "contains_key_and_index", "regex_of_variable", "aggregate_top_n", "aggregate_random", "aggregate_callables", "keyless_not", "callables", "callable_tuple", "input_map",
    "bulk_add_report", "bulk_retract_entities", "bulk_cas", "pull_options", "pull_components", "storage_of_tables", "stream_of_facts", "connections", "entities", "tx_tempids",
)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["join_big", "or_join", "get_some", "rule_recursive", "pull_nested", "db_diff", "arithmetic", "string_functions", *FAMILIES])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    frame = entry.queries()[name](spark, SF)
    found = con.execute(entry.oracle_sql()[name])
    names, cols = [d[0] for d in found.description], sorted(frame.columns)
    assert cols == sorted(names)

    def text(v) -> str:
        return f"{v:.10g}" if isinstance(v, float) else str(list(map(text, v))) if isinstance(v, (list, tuple)) else str(v)

    got = sorted(tuple(text(r[c]) for c in cols) for r in frame.collect())
    assert got and got == sorted(tuple(text(r[names.index(c)]) for c in cols) for r in found.fetchall())

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from lintlake.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = {"p3_found": ["snapshot_id", "file"], "p4_found": ["snapshot_id", "file"], "p5_found": ["place", "row_id", "file", "line"], "p7_found": ["doc_id", "item_id"], "p8_found": ["doc_id"]}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, name):
    df = entry.queries()[name](spark, SF)
    rows = df.collect()
    if name in COLUMNS:
        assert df.columns == COLUMNS[name] and len({tuple(r) for r in rows}) == len(rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", list(queries.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    found = con.execute(queries.SQL[name])
    names = sorted(d[0] for d in found.description)
    df = entry.queries()[name](spark, SF)
    assert sorted(df.columns) == names
    tell = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    places = [[d[0] for d in found.description].index(c) for c in names]
    want = sorted(tuple(tell(r[k]) for k in places) for r in found.fetchall())
    assert sorted(tuple(tell(r[c]) for c in names) for r in df.collect()) == want and want


def test_no_text_is_shuffled(spark):
    """Only keys, numbers and names are exchanged where texts are cut or redacted."""
    for name in ("p4_pieces", "p5_redacted"):
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan and "Exchange rangepartitioning" not in plan and "SortMergeJoin" not in plan, name

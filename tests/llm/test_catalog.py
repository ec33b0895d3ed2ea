import math
from pathlib import Path

import pytest

from inkloom.llm import catalog

DATA = Path("/root/testdata/sf0.001")
COLUMNS = {
    "p1_found": [("rec_a", "string"), ("rec_b", "string")],
    "p3_found": [("batch_id", "bigint"), ("text_no", "int"), ("line_id", "string")],
    "p4_found": [("line_id", "string")],
    "p7_found": [("doc_id", "bigint"), ("pii_kind", "string"), ("start_pos", "int")],
}
needs_data = pytest.mark.skipif(not DATA.exists(), reason="the test tables aren't here")


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else round(v, 6) + 0.0 if isinstance(v, float) else v


@needs_data
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_queries_run_and_equal_their_sql(spark, name):
    df = catalog.QUERIES[name](spark, str(DATA))
    rows = df.collect()
    assert rows and (name not in COLUMNS or df.dtypes == COLUMNS[name])
    if name.endswith("_found"):
        assert len(set(rows)) == len(rows)
    if name in catalog.SQL:
        import duckdb

        con = duckdb.connect()
        for f in DATA.glob("*.parquet"):
            con.sql(f"create view {f.stem} as select * from '{f}'")
        rel, cols = con.sql(catalog.SQL[name]), sorted(df.columns)
        assert cols == sorted(rel.columns)
        theirs = sorted(repr(tuple(plain(r[rel.columns.index(c)]) for c in cols)) for r in rel.fetchall())
        assert sorted(repr(tuple(plain(r[c]) for c in cols)) for r in rows) == theirs

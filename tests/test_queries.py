import importlib
import math
import re
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not DATA.exists(), reason="the test tables aren't here")
CORE = {k: q for k, q in entry.queries().items() if k.startswith("q_") or k.startswith("p2_")}


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else round(v, 6) + 0.0 if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    return con


@needs_data
@pytest.mark.parametrize("name", sorted(k for k in CORE if k in entry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df, rel = CORE[name](spark, str(DATA)), duck.sql(entry.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    ours = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    theirs = sorted(repr(tuple(plain(r[rel.columns.index(c)]) for c in cols)) for r in rel.fetchall())
    assert ours == theirs


@needs_data
@pytest.mark.parametrize("name", sorted(k for k in CORE if k not in entry.oracle_sql()))
def test_query_runs(spark, name):
    assert CORE[name](spark, str(DATA)).count() > 0


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() == 1


def test_core_stands_without_llm(monkeypatch):
    for f in Path(entry.__file__).parent.joinpath("inkloom").rglob("*.py"):
        if "llm" not in f.parts:
            assert not re.search(r"inkloom\.llm|from inkloom import llm", f.read_text()), f
    monkeypatch.setitem(sys.modules, "inkloom.llm", None)
    monkeypatch.setitem(sys.modules, "inkloom.llm.catalog", None)
    again = importlib.reload(entry)
    assert again.llm is None and "p2_found" in again.queries() and "p1_found" not in again.queries()
    monkeypatch.undo()
    importlib.reload(entry)

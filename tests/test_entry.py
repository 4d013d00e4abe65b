import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from dialogforge.plans import reference_queries


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_does_not_import_the_llm_subpackage():
    root = Path(entry.__file__).parent / "dialogforge"
    for source in root.rglob("*.py"):
        if "llm" not in source.relative_to(root).parts:
            assert "dialogforge.llm" not in source.read_text(), source


@pytest.mark.parametrize("name", sorted(reference_queries.SQL))
def test_sql_agrees(spark, small, name):
    con = duckdb.connect()
    for p in Path(small).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*' if p.is_dir() else ''}')")
    cursor = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    df = entry.queries()[name](spark, small)
    assert sorted(columns) == sorted(df.columns)

    def plain(v):
        return "" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)

    want = sorted(tuple(plain(r[columns.index(c)]) for c in sorted(columns)) for r in cursor.fetchall())
    assert sorted(tuple(plain(r[c]) for c in sorted(columns)) for r in df.collect()) == want


def test_python_version():
    assert sys.version_info >= (3, 11)

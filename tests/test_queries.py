"""Every query of the catalogue against its DuckDB SQL, and the entry point's contract."""

import pytest

import __spark_entry__ as entry
from compare import differences
from floodspark.plans import catalogue

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", catalogue.ORACLE_SQL)
def test_equals_sql(spark, name):
    assert differences(spark, FOLDER, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name]) == []


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_no_module_of_the_library_imports_the_text_operators():
    from pathlib import Path

    root = Path(entry.__file__).parent / "floodspark"
    others = [p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts]
    assert others and not [p for p in others if "llm" in p.read_text()]

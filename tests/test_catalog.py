"""Every query runs, and agrees with its SQL."""

import pytest
from compared import rows_of, sql_rows

from tilewright.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    columns, rows = rows_of(df)
    assert rows
    if name in catalog.ORACLES:
        assert (columns, rows) == sql_rows(duck.sql(catalog.ORACLES[name]))


def test_entry(spark):
    import __spark_entry__ as e

    assert set(catalog.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_the_rest_stands_without_the_training_data_operators(tmp_path):
    """The entry points work in a copy that lacks them."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    top = Path(__file__).resolve().parents[1]
    shutil.copytree(top / "tilewright", tmp_path / "tilewright", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(top / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'smoothing' in q and 'pipeline' not in q and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)

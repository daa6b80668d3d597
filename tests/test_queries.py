"""Every registered query of the event engine against its SQL, on the smallest tables."""

import pytest
from oracle import connect, difference

from eventloom import queries

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_against_its_sql(spark, con, name):
    ours = queries.QUERIES[name](spark, SMALL).toPandas()
    assert difference(ours, con.sql(queries.ORACLES[name]).df()) == ""


def test_the_library_stands_without_the_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    here = Path(__file__).resolve().parents[1]
    shutil.copytree(here / "eventloom", tmp_path / "eventloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(here / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql() and not any(n.startswith('op') for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_count_branch_over_all_events(spark, con):
    """Some query takes the muons of all events to flat columns and back, whatever their number."""
    ours = queries.QUERIES["S11_count_branch_all"](spark, SMALL)
    assert {r[0] for r in ours.selectExpr("pmod(event, 3)").distinct().collect()} == {0, 1, 2}
    assert ours.count() == queries.QUERIES["S1_full_read"](spark, SMALL).selectExpr("sum(n_muon)").first()[0]

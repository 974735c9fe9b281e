"""Every core query with SQL gives the rows that the SQL gives."""

import pytest

from lawloom.plans import catalogue
from tests.conftest import comparable


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_rows(name, spark, small, oracle):
    columns, wanted = oracle(catalogue.oracle_sql()[name])
    df = catalogue.queries()[name](spark, small)
    assert sorted(df.columns) == columns
    assert sorted(comparable(r) for r in df.select(*columns).collect()) == wanted


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs(name, spark, small):
    assert catalogue.queries()[name](spark, small).count() > 0


def test_entry(spark, small):
    import __spark_entry__

    assert set(catalogue.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert catalogue.flagship(spark, small).count() > 0


def test_core_does_not_import_the_optional_subpackage():
    import subprocess
    import sys

    code = "import sys, lawloom, lawloom.plans.catalogue; assert not any(m.startswith('lawloom.llm') for m in sys.modules)"
    subprocess.run([sys.executable, "-c", code], check=True)

"""Each registered query of the library against its SQL twin."""

import pytest
from helpers import oracle, same

from feedloom.plans import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_twin(spark, sf, name):
    made = registry.QUERIES[name](spark, sf).toPandas()
    if name in registry.ORACLE:
        same(made, oracle(registry.ORACLE[name], sf))
    else:
        assert len(made) > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_is_imported_without_a_session():
    import subprocess
    import sys

    from conftest import ROOT

    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 200 and set(e.oracle_sql()) <= set(q); from pyspark import SparkContext; assert SparkContext._active_spark_context is None"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)

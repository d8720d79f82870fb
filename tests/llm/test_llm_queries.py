"""Every query of the subpackage: side by side with its SQL where it has some, else that it runs."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from riskloom.llm import catalog
from sql_check import assert_same, connection


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, name):
    if name in catalog.ORACLE:
        assert_same(spark, connection(sf), sf, catalog.QUERIES[name], catalog.ORACLE[name])
    else:
        assert catalog.QUERIES[name](spark, sf).count() > 0

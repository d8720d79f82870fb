"""The list of all transitions is dealt over tasks, and whole."""

from pyspark.sql import functions as F

import __spark_entry__ as e
from riskloom.operators import edges
from sql_check import assert_same, connection


def test_no_task_lists_a_zone_alone(spark, sf, monkeypatch):
    monkeypatch.setattr(edges, "BLOCK", 20, raising=False)
    q = "transition_list"
    per = [r["count"] for r in e.queries()[q](spark, sf).groupBy(F.spark_partition_id()).count().collect()]
    assert max(per) < sum(per) / 4
    assert_same(spark, connection(sf), sf, e.queries()[q], e.oracle_sql()[q])

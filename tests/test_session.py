"""Chains of jobs that run at the same time."""

import threading

from curbline.plans import compiled
from curbline.session import at_once


def test_chains_run_at_once_in_order_and_keep_local_properties(spark):
    met = threading.Barrier(3, timeout=30)  # broken unless all three are there
    spark.sparkContext.setLocalProperty("curbline.test", "kept")

    def chain(n):
        met.wait()
        return spark.range(n).count(), spark.sparkContext.getLocalProperty("curbline.test")

    assert at_once(spark, *(lambda n=n: chain(n) for n in (3, 1, 2))) == [(3, "kept"), (1, "kept"), (2, "kept")]


def test_a_table_wanted_by_chains_at_once_is_built_once(spark):
    built, late = [], threading.Event()

    def build(ws):
        built.append(1)
        late.wait(1)  # time for the other to ask as well
        return spark.range(5)

    tables = at_once(spark, *(lambda: compiled.once(spark, "nowhere", "wanted", build) for _ in range(2)))
    assert [t.count() for t in tables] == [5, 5] and len(built) == 1

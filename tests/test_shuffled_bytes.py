"""What crosses the network in queries over treatments, against what is read."""

import os

import pytest

from tests.conftest import SMALL
from tidemark.plans import catalogue

QUERIES = catalogue.queries()
NAMES = ("t3_all_treatments", "t4_corrections_with_evidence", "v7_decision_summary", "t15_approved_exclusions", "t7_open_cells", "t15_excluded_orders")


def shuffled(spark, name):
    """Bytes of shuffle files that a query writes, nothing being broadcast for its size."""
    sc, before = spark.sparkContext, spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    sc.setJobGroup(f"shuffled {name}", name)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        QUERIES[name](spark, SMALL).write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        sc.setLocalProperty("spark.jobGroup.id", None)
    tracker, store = sc.statusTracker(), sc._jsc.sc().statusStore()
    stages = {s for j in tracker.getJobIdsForGroup(f"shuffled {name}") for s in tracker.getJobInfo(j).stageIds}
    return sum(store.lastStageAttempt(s).shuffleWriteBytes() for s in stages)


@pytest.mark.parametrize("name", NAMES)
def test_whole_rows_stay_where_they_are(name, spark):
    read = sum(os.path.getsize(f"{SMALL}/{t}.parquet") for t in ("lineitem", "orders"))
    assert shuffled(spark, name) < 6 * read

import datetime
import os

import pytest

from lintlake.sources import tables


class Elsewhere:
    """A session on several machines that names no shared folder."""

    class sparkContext:
        master = "yarn"

        @staticmethod
        def getConf():
            return {}


def test_shared_folder(spark):
    with pytest.raises(ValueError):
        tables.shared_dir(Elsewhere)
    df = tables.materialize(spark.range(10), "t")
    assert df.count() == 10 and os.path.isdir(df.inputFiles()[0].removeprefix("file:").rpartition("/")[0])


def test_first_sent(spark):
    at = lambda h: datetime.datetime(2024, 1, 1, h)
    rows = [(1, at(1), "a"), (1, at(3), "a"), (2, at(2), "b"), (None, at(1), "c"), (3, None, "d"), (4, at(5), "e"), (4, at(5), "e")]
    df = spark.createDataFrame(rows, "k int, t timestamp, v string")
    got = sorted(tuple(r) for r in tables.first_sent(df, "k", "t").select("k", "v").na.fill(0).collect())
    assert got == [(0, "c"), (1, "a"), (2, "b"), (3, "d"), (4, "e"), (4, "e")]
    plan = tables.first_sent(df, "k", "t")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan

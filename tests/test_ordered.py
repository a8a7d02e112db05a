"""Windows over ranges equal those over whole groups."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from spanmill.operators.ordered import in_ranges, tiles, with_before

ORDER = ["t", "id"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    hot = [("hot", rng.randint(0, 300), i, rng.randint(0, 99)) for i in range(900)]
    rest = [(rng.choice(["a", None, "b"]), None if rng.random() < 0.1 else rng.randint(0, 9), i, 1) for i in range(900, 950)]
    return spark.createDataFrame(hot + rest + [("one", 1, 950, 1)], "g string, t int, id int, v int")


@pytest.mark.parametrize("ranges", [1, 7, 200])
def test_windows_over_ranges_equal_those_over_groups(rows, ranges):
    parts = in_ranges(rows, "g", ORDER, ranges)
    assert parts.count() == 951 and (ranges == 1 or parts.where("g = 'hot'").select("range_").distinct().count() > 3)
    last = lambda *by: F.collect_list("v").over(Window.partitionBy(*by).orderBy(*ORDER).rowsBetween(-9, 0))
    got = with_before(parts, "g", ORDER, 9).withColumn("l", last("g", "range_")).where("NOT carried_")
    assert sorted((r.id, r.l) for r in got.collect()) == sorted((r.id, r.l) for r in rows.withColumn("l", last("g")).collect())
    for n in (1, 4, 2000):
        want = rows.select("id", F.ntile(n).over(Window.partitionBy("g").orderBy(*ORDER)).alias("tile"))
        assert sorted(map(tuple, tiles(parts, "g", ORDER, n).select("id", "tile").collect())) == sorted(map(tuple, want.collect()))


def test_no_rows(rows):
    parts = in_ranges(rows.limit(0), "g", ORDER, 3)
    assert with_before(parts, "g", ORDER, 9).count() == 0 and tiles(parts, "g", ORDER, 4).count() == 0

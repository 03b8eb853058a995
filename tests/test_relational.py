"""The as-of join against a plain loop; the session."""

import random

from pyspark.sql import SparkSession

from ocellus.operators import joins
from ocellus.session import init_session


def test_asof_is_brute_force(spark):
    r = random.Random(2)
    left = [(i, r.choice([1, 2, None]), r.choice([None, *range(12)])) for i in range(60)]
    right = [(r.choice([1, 2, 3, None]), r.choice([None, *range(12)]), v) for v in range(40)]
    frames = spark.createDataFrame(left, "i int, k int, t int"), spark.createDataFrame(right, "k int, t int, v int")
    got = {x.i: x.v for x in joins.asof(*frames, "k", "t", ["v"]).collect()}
    for i, k, t in left:
        fits = [(u, v) for o, u, v in right if None not in (k, t, o, u) and o == k and u <= t]
        assert got[i] == (max(fits)[1] if fits else None), i


def test_session_is_kept(spark):
    kept = init_session({"spark.sql.shuffle.partitions": spark.conf.get("spark.sql.shuffle.partitions")})
    assert kept.sparkContext is spark.sparkContext and SparkSession.getActiveSession() is not None
    assert kept.sql("SELECT area(box2d(array(0, 0, 2, 3))) AS a").first().a == 6


def test_no_sketch_for_each_value(spark):
    """Sketches are grouped by the flag alone, and are those of all rows."""
    from pyspark.sql import functions as F

    from ocellus.plans import relational

    data = "/root/testdata/sf0.001"
    plan = relational.r_approximate_distinct(spark, data)._jdf.queryExecution().sparkPlan().toString()
    sketches = [line for line in plan.splitlines() if "approx_count_distinct" in line and "Aggregate" in line]
    assert sketches and not any("l_partkey" in line.split("functions=")[0] for line in sketches)
    lines = spark.read.parquet(f"{data}/lineitem.parquet")
    counts = lambda rows: sorted(map(tuple, rows.groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02)).collect()))
    assert counts(lines) == counts(lines.select("l_returnflag", "l_partkey").distinct())

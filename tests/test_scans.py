import random

from pyspark.sql import functions as F

from eventloom.operators.scans import running


def test_running_totals_equal_a_loop(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, 1, 1, 1, 2, 30 + i]), rng.choice([None, i % 50, 7]), rng.getrandbits(40), "x" * (i % 5)) for i in range(3000)]
    rows += [(5, 5, 9, "same")] * 500
    df = spark.createDataFrame(rows, "g BIGINT, o BIGINT, v BIGINT, t STRING").repartition(5)
    out = running(df.withColumn("one", F.lit(1).cast("bigint")), ["g"], ["o", "v", "t"], ["g", "o", "v"], {"n": "one", "total": "v"}, {"mixed": "v"})
    none_first = lambda x: (x is not None, x or 0)
    want, n, total, mixed, group = [], 0, 0, 0, ()
    for g, o, v, t in sorted(rows, key=lambda r: (none_first(r[0]), none_first(r[1]), r[2], r[3])):
        if group != (g,):
            n = total = mixed = 0
        group = (g,)
        n, total, mixed = n + 1, total + v, mixed ^ v
        want.append((g, o, v, n, total, mixed))
    key = lambda r: (none_first(r[0]), r[3])
    assert sorted((tuple(r) for r in out.collect()), key=key) == sorted(want, key=key)


def test_one_order_over_all_rows_and_empty_tables(spark):
    numbers = spark.range(0, 5000, 1, 7).select(F.pmod(F.col("id") * 7919, F.lit(5000)).alias("k"), F.lit(1).cast("bigint").alias("one"))
    out = running(numbers, [], ["k"], ["k"], {"n": "one"})
    assert out.filter("n <> k + 1").count() == 0 and out.count() == 5000
    assert running(numbers.limit(0), [], ["k"], ["k"], {"n": "one"}).count() == 0
    same = spark.range(0, 2000, 1, 4).select(F.lit(3).alias("k"), F.lit(1).cast("bigint").alias("one"))
    assert sorted(r.n for r in running(same, ["k"], ["k"], ["k"], {"n": "one"}).collect()) == list(range(1, 2001))


def test_no_window_and_no_single_task(spark):
    numbers = spark.range(0, 1000, 1, 4).select("id", F.lit(1).cast("bigint").alias("one"))
    plan = running(numbers, [], ["id"], ["id"], {"n": "one"})._jdf.queryExecution().toString()
    assert "Window" not in plan and "SinglePartition" not in plan

import random

from pyspark.sql import functions as F

from tidemark.operators import order


def test_numbers_follow_the_order(spark):
    df = spark.createDataFrame([(f"k{i:04d}",) for i in random.Random(1).sample(range(1000), 1000)], "key string")
    assert [(r.key, r.n) for r in order.numbered(df, "key", "n", 5).orderBy("n").collect()] == [(f"k{i:04d}", i + 5) for i in range(1000)]
    assert order.numbered(df.limit(0), "key", "n").count() == 0


def test_last_before_is_that_of_a_walk(spark):
    rng = random.Random(2)
    rows = [(p, i, rng.choice(["hot", "hot", "a", "b", None]), rng.choice([None, None, f"v{p}.{i}"])) for p in range(300) for i in range(2)]
    df = spark.createDataFrame(rows, "pos long, i int, key string, w string").repartition(5)
    want, last = {}, {}
    for p, i, k, w in rows:
        want[p, i] = last.get(k)
        last[k] = w or last.get(k)
    for span in (1, 7, 1000):
        got = {(r.pos, r.i): r.held for r in order.with_last_before(df, "key", "pos", F.col("w"), "held", ("i",), span).collect()}
        assert got == want

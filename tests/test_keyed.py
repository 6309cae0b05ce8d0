import random

from pyspark.sql import functions as F

from rolecall.operators.history import number_rows
from rolecall.operators.keyed import first_per_key, next_value, ordinal, previous_value


def rows(seed=1):
    """One key holds most of the rows."""
    r = random.Random(seed)
    out, used = [], set()
    for _ in range(400):
        k, o = ("hot" if r.random() < 0.7 else r.choice("abc")), r.randrange(5000)
        if (k, o) not in used:
            used.add((k, o))
            out.append((k, o, r.choice([None, None, f"v{o}"])))
    return out


def test_neighbours_match_brute_force(spark):
    data = rows()
    df = spark.createDataFrame(data, "k STRING, o INT, v STRING")
    got = next_value(previous_value(df, ["k"], "o", F.floor(F.col("o") / 100), F.col("v"), "before"),
                     ["k"], "o", F.floor(F.col("o") / 37), F.col("v"), "after").collect()
    assert len(got) == len(data)
    for r in got:
        earlier = [(o, v) for k, o, v in data if k == r.k and o < r.o and v]
        later = [(o, v) for k, o, v in data if k == r.k and o > r.o and v]
        assert r.before == (max(earlier)[1] if earlier else None)
        assert r.after == (min(later)[1] if later else None)


def test_ordinal_and_numbers(spark):
    data = rows(2)
    df = spark.createDataFrame(data, "k STRING, o INT, v STRING")
    for r in ordinal(df, ["k"], "o", F.floor(F.col("o") / 50), "n").collect():
        assert r.n == sum(1 for k, o, _ in data if k == r.k and o <= r.o)
    ids = [r.id for r in number_rows(df.withColumn("u", F.concat_ws("-", "k", "o")), "u", "id", start=5, buckets=7).collect()]
    assert sorted(ids) == list(range(5, 5 + len(data)))


def test_first_per_key_is_reduced_before_the_shuffle(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 3)
    plan = first_per_key(df, ["k"], [F.col("id")])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2

"""The index of intervals: the fewest blocks, and pairs that equal a plain comparison."""

import random

from pyspark.sql import functions as F

from codeloom.operators import intervals, relational


def test_blocks_make_up_the_interval(spark):
    r = random.Random(4)
    rows = [(a := r.randint(-50, 2000), a + r.randint(-3, 700)) for _ in range(400)] + [(0, 0), (5, 5), (0, 1023), (1, 1024), (None, 3), (3, None), (0, (1 << 40) - 1)]
    df = spark.createDataFrame(rows, "a long, b long").withColumn("blocks", intervals.blocks(F.col("a"), F.col("b")))
    for row in df.collect():
        if row["a"] is None or row["b"] is None or row["b"] < row["a"]:
            assert not row["blocks"]
            continue
        spans = sorted((x["block"] << x["level"], (x["block"] + 1) << x["level"]) for x in row["blocks"])
        assert spans[0][0] == row["a"] and spans[-1][1] == row["b"] + 1 and all(p[1] == q[0] for p, q in zip(spans, spans[1:]))
        assert len(spans) <= 2 * (row["b"] - row["a"] + 1).bit_length()


def test_pairs_equal_a_plain_comparison(spark):
    r = random.Random(5)
    points = [(k, r.choice(["x", "y", None]), r.choice([None, *range(0, 120)])) for k in range(300)]
    spans = [(k, r.choice(["x", "y", None]), a := r.randint(0, 100), a + r.randint(-2, 40)) for k in range(200)]
    left, right = spark.createDataFrame(points, "p long, k string, at int"), spark.createDataFrame(spans, "i long, k string, lo int, hi int")
    got = sorted((x["p"], x["i"]) for x in relational.contained(left, right, ["k"], "at", "lo", "hi").collect())
    assert got == sorted((p, i) for p, k, at in points for i, o, lo, hi in spans if k is not None and k == o and at is not None and lo <= at <= hi)
    none = right.limit(0)
    assert relational.contained(left, none, ["k"], "at", "lo", "hi").count() == 0 and relational.contained(left.limit(0), right, ["k"], "at", "lo", "hi").count() == 0


def test_a_hot_key_makes_no_more_rows_than_hits(spark):
    """5000 lines and 2000 symbols of one file: the join itself gives the hits, with no condition left to sift them."""
    points = spark.range(5000).select(F.lit(1).alias("file"), F.col("id").alias("at"))
    spans = spark.range(2000).select(F.lit(1).alias("file"), (F.col("id") * 2).alias("lo"), (F.col("id") * 2 + 5).alias("hi"), "id")
    joined = relational.contained(points, spans, ["file"], "at", "lo", "hi")
    assert joined.count() == sum(sum(2 * k <= at <= 2 * k + 5 for k in range(max(0, at // 2 - 3), min(2000, at // 2 + 1))) for at in range(5000))
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    condition = next(line for line in plan.splitlines() if "Join Inner" in line)
    assert "_block" in condition and "<=" not in condition and ">=" not in condition


def test_innermost_equals_a_plain_comparison(spark):
    r = random.Random(6)
    points = [(k // 2, r.choice(["x", "y", None]), r.choice([None, *range(0, 60)])) for k in range(300)]
    spans = [(k, r.choice(["x", "y", None]), a := r.randint(0, 50), a + r.randint(-2, 40)) for k in range(300)]
    left, right = spark.createDataFrame(points, "p long, k string, at int"), spark.createDataFrame(spans, "i long, k string, lo int, hi int")
    want = {}
    for p, k, at in points:
        for i, o, lo, hi in spans:
            if k is not None and k == o and at is not None and lo <= at <= hi:
                want[p] = min(want.get(p, (99, 0, 0)), (-lo, hi, i))
    got = relational.innermost(left, right, ["k"], "at", "lo", "hi", ["p"], "i").collect()
    assert {x["p"]: (-x["lo"], x["hi"], x["i"]) for x in got} == want and len(got) == len(want)


def test_innermost_makes_no_pairs(spark):
    """20,000 points in 20,000 equal intervals: 400 million pairs, none of which is made."""
    points = spark.range(20000).select(F.lit(1).alias("file"), F.lit(5).alias("at"), F.col("id").alias("p"))
    spans = spark.range(20000).select(F.lit(1).alias("file"), F.lit(3).alias("lo"), F.lit(9).alias("hi"), "id")
    joined = intervals.best(points, spans, ["file"], "at", "lo", "hi", [F.negative("lo"), F.col("hi"), F.col("id")])
    assert [x["id"] for x in joined.select("id").distinct().collect()] == [0] and joined.count() == 20000


def test_hot_blocks_are_dealt_out(spark, monkeypatch):
    """Parts of blocks with many hits, of which now the points and now the intervals are more."""
    monkeypatch.setattr(intervals, "HITS", 50)
    points = spark.range(300).select(F.when(F.col("id") % 3 == 0, 1).otherwise(2).alias("k"), (F.col("id") % 9).alias("at"), F.col("id").alias("p"))
    spans = spark.range(240).select(F.when(F.col("id") % 8 == 0, 2).otherwise(1).alias("k"), (F.col("id") % 5).alias("lo"), (F.col("id") % 5 + 3).alias("hi"), F.col("id").alias("i"))
    joined = relational.contained(points, spans, ["k"], "at", "lo", "hi")
    ps, ss = points.collect(), spans.collect()
    plain = sorted((a["p"], b["i"]) for a in ps for b in ss if a["k"] == b["k"] and b["lo"] <= a["at"] <= b["hi"])
    assert sorted((x["p"], x["i"]) for x in joined.select("p", "i").collect()) == plain
    assert "_part" in joined._jdf.queryExecution().optimizedPlan().toString()

"""Order-free sums: exact against fractions, equal bit by bit under every partitioning."""

import math
import random
import struct
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from residua.functions.exact import exact_avg, exact_sum
from residua.operators import grouping, objective


def bits(x):
    return None if x is None else struct.pack(">d", x)


def hard_values(n, seed=9):
    rng = random.Random(seed)
    return [rng.choice((1, -1)) * rng.random() * 10.0 ** rng.randrange(-14, 16) for _ in range(n)]


def test_sum_is_exact(spark):
    for seed in range(4):
        x = hard_values(400, seed)
        df = spark.createDataFrame([(v,) for v in [*x, None]], "x double")
        got = df.agg(exact_sum("x").alias("s"), exact_avg("x").alias("m")).first()
        want = float(sum(map(Fraction, x)))
        assert got.s == pytest.approx(want, rel=3e-16, abs=1e-25) and got.m == got.s / len(x)


@pytest.mark.parametrize("values, want", [
    ([], None), ([None], None), ([-0.1, 0.1], 0.0), ([1e16, 1.0, -1e16], 1.0), ([float("inf"), 1.0], float("inf")),
    ([1e300, -1e300, 2.0], 2.0), ([2.0 ** 143, 1.0], 2.0 ** 143)])
def test_edges(spark, values, want):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert df.agg(exact_sum("x")).first()[0] == want
    nan = spark.createDataFrame([(1.0,), (float("nan"),)], "x double").agg(exact_sum("x")).first()[0]
    assert math.isnan(nan)


def test_bit_equal_for_every_partitioning(spark):
    x = hard_values(3000)
    df = spark.createDataFrame([(i, i % 5, v, abs(math.fmod(v, 1.0)) + .01) for i, v in enumerate(x)],
                               "id int, step int, reward double, p double")
    found = []
    for n in (1, 8, 64):
        d = df.repartition(n, F.rand(n))
        history = grouping.reward_history(d, "step", "reward", exact=True).orderBy("step").collect()
        loss = objective.grpo_objective(
            d.select((-F.col("p")).alias("policy"), (-F.col("p") / 3).alias("old"), (-F.col("p") / 7).alias("ref"),
                     F.col("reward").alias("advantage")), level="token", exact=True).first()
        summary = objective.dpo_summary(d.select(
            F.col("reward").alias("loss"), F.col("p").alias("reward_chosen"), (F.col("p") / 3).alias("reward_rejected"),
            F.col("reward").alias("margin")), exact=True).first()
        found.append([bits(float(v)) for row in [*history, loss, summary] for v in row])
    assert found[0] == found[1] == found[2]


def test_exact_history_equals_plain(spark):
    rows = [(i % 3, float(i % 17)) for i in range(200)] + [(3, None), (4, 2.5)]
    df = spark.createDataFrame(rows, "step int, reward double")
    plain, exact = (sorted(map(tuple, grouping.reward_history(df, "step", "reward", exact=e).collect())) for e in (False, True))
    for a, b in zip(plain, exact, strict=True):
        assert a[:2] == b[:2] and [v is None for v in a] == [v is None for v in b]
        assert [v for v in a if v is not None] == pytest.approx([v for v in b if v is not None], rel=1e-14)

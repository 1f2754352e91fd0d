"""Scalar functions against plain-Python renderings of the reference rules."""

import math
import random

import pytest
from pyspark.sql import functions as F

from residua.functions import objective as fo
from residua.functions.hashing import keyed_hash
from residua.functions.oracles import (KYTE_DOOLITTLE, PKA, hydrophobicity, isoelectric_point,
                                       net_charge, physicochemical)
from residua.functions.rewards import hydrophobicity_reward, target_reward
from residua.functions.text import (RESIDUES, clean_generated, fixed_prefix, hamming, is_usable_sequence,
                                    length_bin, metric_label, random_residues, suffix_cut, to_sequence)


def py_hydro(s):
    return sum(KYTE_DOOLITTLE.get(a, 0.0) for a in s)


def py_charge(s, ph):
    c = {a: s.count(a) for a in "DEHCYKR"}
    q = 1 / (1 + 10 ** (ph - PKA["N_term"])) - 1 / (1 + 10 ** (PKA["C_term"] - ph))
    for a in "DECY":
        q -= c[a] / (1 + 10 ** (PKA[a] - ph))
    for a in "HKR":
        q += c[a] / (1 + 10 ** (ph - PKA[a]))
    return q


def py_pi(s):
    lo, hi = 0.0, 14.0
    for _ in range(100):
        mid = (lo + hi) / 2
        if py_charge(s, mid) > 0:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], list(cols.keys())) if cols else spark.range(1)
    return df.select(expr.alias("v")).first()["v"]


def test_clean_generated_order(spark):
    raw = "MKV\nLA<|endof\ntext|>GG<|endoftext|>\n"
    assert one(spark, clean_generated(F.col("s")), s=raw) == "MKVLAGG"


def test_to_sequence_and_usable(spark):
    data = [(1, None), (2, ""), (3, " \t\n"), (4, "\x1c"), (5, " a"), (6, "X")]
    df = spark.createDataFrame(data, "id long, s string")
    kept = sorted(r.id for r in df.filter(is_usable_sequence("s")).collect())
    assert kept == [5, 6]
    assert one(spark, to_sequence(F.col("s")), s="aé-b1 C") == "ABC"


def test_length_bin(spark):
    df = spark.createDataFrame([("A" * n,) for n in (0, 4, 5, 9, 10, 251)], "s string")
    got = [r.b for r in df.select(length_bin("s", 5).alias("b")).collect()]
    assert got == [0, 0, 5, 5, 10, 250]
    with pytest.raises(ValueError):
        length_bin("s", 0)


def test_suffix_cut_properties(spark):
    rnd = random.Random(1)
    data = [(i, "".join(rnd.choice(RESIDUES) for _ in range(n))) for i, n in enumerate([0, 1, 2, 3, 7, 30] * 20)]
    df = spark.createDataFrame(data, "id long, s string")
    out = df.select("id", "s", suffix_cut("s", F.col("id")).alias("c")).collect()
    for r in out:
        p, rem, n = r.c.prefix, r.c.removed, r.c.n_removed
        assert p + rem == r.s
        if len(r.s) <= 1:
            assert (p, rem, n) == (r.s, "", 0)
        else:
            assert 1 <= n <= len(r.s) - 1 and len(rem) == n
    # capped, and the older form may remove nothing
    capped = df.select("s", suffix_cut("s", F.col("id"), max_removals=2).alias("c")).collect()
    assert all(r.c.n_removed <= 2 for r in capped)
    zero = df.select("s", suffix_cut("s", F.col("id"), min_removals=0).alias("c")).collect()
    assert any(r.c.n_removed == 0 and len(r.s) > 1 for r in zero)
    assert all(r.c.prefix + r.c.removed == r.s for r in zero)


def test_keyed_hash_is_engine_independent(spark):
    assert one(spark, keyed_hash(42, 7)) == 1994382085


def test_fixed_prefix_and_random_residues(spark):
    data = [(i, "ACDEFGHIKLMNPQRSTVWYX"[: n]) for i, n in enumerate([0, 2, 3, 4, 21])]
    df = spark.createDataFrame(data, "id long, s string")
    out = df.select("id", fixed_prefix("s", 3).alias("p")).select(
        "id", "p.prompt", "p.rest", random_residues(F.length("p.rest"), F.col("id")).alias("neg")).collect()
    for r in out:
        assert len(r.prompt) == min(3, len(data[r.id][1]))
        assert len(r.neg) == len(r.rest)
        assert set(r.neg) <= set(RESIDUES)
    again = df.select(random_residues(F.lit(40), F.col("id")).alias("n")).collect()
    assert again == df.select(random_residues(F.lit(40), F.col("id")).alias("n")).collect()


def test_hamming(spark):
    cases = [("", "", 0), ("A", "", 1), ("", "AB", 2), ("ABC", "ABC", 0), ("ABC", "AXC", 1), ("ABCD", "AXC", 2)]
    df = spark.createDataFrame(cases, "a string, b string, want int")
    for r in df.select("want", hamming("a", "b").alias("d")).collect():
        assert r.d == r.want


def test_metric_label(spark):
    df = spark.createDataFrame([("reward",), ("loss",), ("reward_std",), ("kl",)], "m string")
    assert [r.l for r in df.select(metric_label("m").alias("l")).collect()] == ["Reward", "Loss", "Reward_std", "Kl"]


def test_hydrophobicity_matches_python(spark):
    rnd = random.Random(3)
    seqs = ["", "X", "a", "ARND", "XXLL"] + ["".join(rnd.choice(RESIDUES + "Xb") for _ in range(rnd.randint(0, 60)))
                                             for _ in range(100)]
    df = spark.createDataFrame([(s,) for s in seqs], "s string")
    got = df.select("s", hydrophobicity("s").alias("h"), hydrophobicity_reward("s").alias("r")).collect()
    for r in got:
        assert r.h == pytest.approx(py_hydro(r.s), abs=1e-9)
        assert r.r == pytest.approx(-abs(20 - py_hydro(r.s)), abs=1e-9)
    with pytest.raises(ValueError):
        physicochemical("s", "mass")


def test_net_charge_and_pi(spark):
    seqs = ["", "GGG", "DDDEEE", "KKKRRR", "MKVLAAGIHHCCYY", "ACDEFGHIKLMNPQRSTVWY" * 3]
    df = spark.createDataFrame([(s,) for s in seqs], "s string")
    got = df.select("s", net_charge("s", 7.0).alias("q7"), net_charge("s", 3.0).alias("q3"),
                    isoelectric_point("s").alias("pi"), isoelectric_point("s", "numpy").alias("pin")).collect()
    for r in got:
        assert r.q7 == pytest.approx(py_charge(r.s, 7.0), rel=1e-12)
        assert r.q3 > r.q7  # charge falls with pH
        assert r.pi == pytest.approx(round(py_pi(r.s), 2), abs=1e-9)
        assert r.pin == r.pi
    assert {r.s: r.pi for r in got}["GGG"] == 5.85


def test_objective_scalars(spark):
    df = spark.createDataFrame([(0.1, 0.1), (-1.0, 2.0), (3.0, -0.5)], "p double, r double")
    for r in df.select(fo.kl_k3("p", "r").alias("k"), "p", "r").collect():
        assert r.k >= 0 and r.k == pytest.approx(math.exp(r.r - r.p) - (r.r - r.p) - 1)
    got = spark.createDataFrame([(1.5, 2.0), (0.5, -1.0), (float("nan"), 1.0)], "ratio double, a double").select(
        fo.clipped_surrogate("ratio", "a", 0.2).alias("s")).collect()
    assert got[0].s == pytest.approx(1.2 * 2.0)
    assert got[1].s == pytest.approx(0.8 * -1.0)
    assert math.isnan(got[2].s)
    big = spark.createDataFrame([(800.0,), (-800.0,), (0.0,)], "x double").select(fo.softplus("x").alias("y")).collect()
    assert big[0].y == pytest.approx(800.0) and big[1].y == pytest.approx(0.0, abs=1e-300)
    assert big[2].y == pytest.approx(math.log(2))


def test_logsumexp(spark):
    arr = [1000.0, 999.0, -5.0]
    got = spark.createDataFrame([(arr,)], "a array<double>").select(fo.logsumexp("a").alias("v")).first().v
    m = max(arr)
    assert got == pytest.approx(m + math.log(sum(math.exp(x - m) for x in arr)))


def test_target_reward(spark):
    assert one(spark, target_reward(F.col("x"), 3.0), x=5.5) == -2.5


def test_hydrophobicity_nulls_both_methods(spark):
    df = spark.createDataFrame([(None,), ("",), ("AX",), (None,)], "s string")
    got = df.select(hydrophobicity("s").alias("n"), hydrophobicity("s", "arrow").alias("a")).collect()
    assert [(r.n, r.a) for r in got] == [(None, None), (0.0, 0.0), (1.8, 1.8), (None, None)]

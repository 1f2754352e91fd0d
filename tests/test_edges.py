"""Repeated keys, null keys, skewed orders, NaN and damaged input."""

import json
import math
import os
import random
import subprocess
import sys
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from residua.functions import objective as fo
from residua.operators import batching, datasets, logs
from residua.operators import objective as obj
from residua.operators.ranking import rank_within
from residua.operators.udf import reward_column
from residua.sources import readers, writers
from residua.streaming.scoring import advantage_sink

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


# ------------------------------------------------------------ repeated keys

def test_repeated_keys_keep_the_number_of_rows(spark, tmp_path):
    twice = spark.createDataFrame([(1, 1, 0.5), (1, 1, 0.6), (1, 2, 0.7)], "run long, step long, loss double")
    writers.write_trainer_logs(twice, f"{tmp_path}/logs")
    assert readers.read_trainer_logs(spark, f"{tmp_path}/logs", multi_line=False).count() == 3
    rows = spark.createDataFrame([(1, "a", "b"), (1, "c", "d"), (2, "e", "f")], "row_id long, prompt string, completion string")
    writers.write_columnar_json(rows, f"{tmp_path}/col")
    assert readers.read_columnar_json(spark, f"{tmp_path}/col", multi_line=False, with_row_id=True).count() == 3
    items = spark.createDataFrame([(1, 7, 0), (1, 7, 0), (2, 7, 0)], "row_id long, taxid long, length_bin long")
    for shuffle in (True, False):
        assert batching.assign_batches(items, batch_size=2, shuffle=shuffle).count() == 3
    split = datasets.train_test_split(items, exact=True, test_size=0.34)
    assert Counter(r.split for r in split.collect()) == {"test": 2, "train": 1}


# ------------------------------------------------------------ skewed orders

@pytest.mark.parametrize("keys", [["g"], []])
@pytest.mark.parametrize("order", [["v", "s", "id"], ["s", "id"]])
def test_slices_stay_small_with_outliers_and_ties(spark, keys, order):
    rng = random.Random(0)
    rows = [("a" if rng.random() < 0.8 else None, rng.choice([0.0, 0.0, 0.0, 1e18, float(rng.randrange(9)), None]),
             f"s{rng.randrange(10 ** 4)}", i) for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, v double, s string, id long").repartition(5)
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    want = {r.id: r.x for r in df.withColumn("x", F.row_number().over(w)).collect()}
    ranked = rank_within(df, keys, order, slice_rows=100)
    assert {r.id: r.pos for r in ranked.collect()} == want
    # the sizes the window tasks get, from the boundaries the ranking uses
    text = ranked._jdf.queryExecution().optimizedPlan().toString()
    assert "__rk_slice" in text
    from residua.operators import ranking
    at = F.struct(*[F.col(c) for c in order])
    every = max(1, 100 // ranking.SAMPLES_PER_SLICE)
    step = max(1, 100 // every)
    for g in ("a", None) if keys else (0,):
        part = df.filter(F.col("g").eqNullSafe(g)) if keys else df
        sample = sorted(([(x is not None, x) for x in r["t"]] for r in part.filter(
            F.pmod(F.xxhash64(*order), F.lit(every)) == 0).select(at.alias("t")).collect()),
            key=lambda t: [(n, x if n else 0) for n, x in t])
        cuts = [sample[i - 1] for i in range(step, len(sample) + 1, step)]
        key = [[(n, x if n else 0) for n, x in t] for t in cuts]
        sizes = Counter(sum(k < [(x is not None, x if x is not None else 0) for x in r["t"]] for k in key)
                        for r in part.select(at.alias("t")).collect())
        assert max(sizes.values()) <= 200


# ------------------------------------------------------------ whole batches

def _null_items(spark, n=40):
    rows = [(i, None if i % 2 else 5, 0) for i in range(n)]
    return spark.createDataFrame(rows, "row_id long, taxid long, length_bin long")


def test_batches_lie_in_one_partition(spark):
    df = spark.createDataFrame([(i, i % 5, 0) for i in range(400)], "row_id long, taxid long, length_bin long")
    for shuffle in (True, False):
        served = batching.serving_order(batching.assign_batches(df, shuffle=shuffle), shuffle, num_partitions=7)
        at = served.withColumn("p", F.spark_partition_id()).groupBy("taxid", "length_bin", "batch_no")
        assert at.agg(F.countDistinct("p").alias("n")).filter("n > 1").count() == 0
        assert served.rdd.getNumPartitions() > 1


def test_collate_sees_whole_batches_of_null_keys(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        b = batching.assign_batches(_null_items(spark, 24), batch_size=8)
        sizes = batching.collate_batches(b, lambda p: pd.DataFrame({"n": [len(p)]}), "n long")
        assert sorted(r.n for r in sizes.collect()) == [4, 4, 8, 8]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_first_batches_keep_null_groups(spark):
    b = batching.assign_batches(_null_items(spark), batch_size=8)
    assert batching.first_batches(b, n=6).count() == 40
    for n in (1, 2, 4):
        first = batching.first_batches(b, n=n).collect()
        heads = sorted({(r.batch_key, r.taxid is not None, r.taxid or 0, r.batch_no) for r in b.collect()})[:n]
        assert {(r.batch_key, r.taxid is not None, r.taxid or 0, r.batch_no) for r in first} == set(heads)


# ------------------------------------------------------------ loss

def test_null_advantage_rules(spark):
    rows = [([0.1, -0.2], [0.0, 0.0], [0.3, 0.1], 1.0), ([0.5, 0.4], [0.2, 0.1], [0.0, 0.2], None)]
    df = spark.createDataFrame(rows, "policy array<double>, old array<double>, ref array<double>, advantage double")
    zero = obj.grpo_objective(df, beta=0.1, epsilon=0.2, null_advantage="zero").first()
    terms = []
    for p, o, r, a in rows:
        for x, y, z in zip(p, o, r, strict=True):
            ratio = math.exp(x - y)
            terms.append(min(ratio * (a or 0), min(max(ratio, 0.8), 1.2) * (a or 0)) - 0.1 * (math.exp(z - x) - (z - x) - 1))
    assert zero.grpo_loss == pytest.approx(-sum(terms) / len(terms)) and zero.n_elements == 4
    assert math.isnan(obj.grpo_objective(df).first().grpo_loss)
    with pytest.raises(Exception, match="without an advantage"):
        obj.grpo_objective(df, null_advantage="error").collect()
    flat = df.select(F.col("policy")[0].alias("policy"), F.col("old")[0].alias("old"), F.col("ref")[0].alias("ref"), "advantage")
    assert math.isnan(obj.grpo_objective(flat, level="token").first().grpo_loss)
    assert obj.grpo_objective(flat, level="token", null_advantage="zero").first().n_tokens == 2
    uneven = spark.createDataFrame([([0.1], [0.0, 0.0], [0.3], 1.0)], df.schema)
    with pytest.raises(Exception, match="differ in length"):
        obj.grpo_objective(uneven).collect()


def test_sums_before_advantages_equal_the_direct_form(spark):
    rng = random.Random(1)
    rows = [(i % 3, [rng.gauss(0, 1) for _ in range(5)], [rng.gauss(0, 1) for _ in range(5)], [rng.gauss(0, 1) for _ in range(5)])
            for i in range(30)]
    df = spark.createDataFrame(rows, "seq_id long, policy array<double>, old array<double>, ref array<double>")
    adv = spark.createDataFrame([(0, 1.5), (1, -0.7), (2, 0.0)], "seq_id long, advantage double")
    a = obj.grpo_objective(obj.attach_advantages(obj.grpo_sums(df, 0.2), adv), epsilon=0.2).first()
    b = obj.grpo_objective(obj.attach_advantages(df, adv), epsilon=0.2).first()
    by = {0: 1.5, 1: -0.7, 2: 0.0}
    terms = [min(math.exp(p - o) * by[s], min(max(math.exp(p - o), 0.8), 1.2) * by[s]) - 0.1 * (math.exp(r - p) - (r - p) - 1)
             for s, pp, oo, rr in rows for p, o, r in zip(pp, oo, rr, strict=True)]
    assert a.grpo_loss == pytest.approx(b.grpo_loss) == pytest.approx(-sum(terms) / len(terms))


def test_nan_stays_nan(spark):
    one = spark.createDataFrame([(float("nan"),), (0.5,), (None,)], "r double")
    got = [r.c for r in one.select(fo.clip_ratio("r", 0.01).alias("c")).collect()]
    assert math.isnan(got[0]) and got[1] == pytest.approx(0.99)
    text = spark.createDataFrame([("a",), ("b",), ("c",)], "t string").coalesce(1)
    out = text.select(reward_column(lambda xs: [float("nan"), None, 2][:len(xs)], "t").alias("r")).collect()
    assert math.isnan(out[0].r) and out[1].r is None and out[2].r == 2.0


# ------------------------------------------------------------ pairs, splits

def test_pairs_respect_the_threshold_and_lose_none(spark):
    rows = [("p", 10, 10.0), ("p", 9, 9.0), *[("p", 100 + i, float(i)) for i in range(8)], (None, 20, 10.0), (None, 21, 1.0),
            ("q", 30, 10.0)]
    df = spark.createDataFrame(rows, "prompt string, id long, score double")
    for k in (1, 2, 5, 100):
        got = datasets.preference_pairs(df, "prompt", "score", "id", chosen_min=9, rejected_max=7, threshold=5.0,
                                        slice_rows=3, partners=k).collect()
        eligible = {(c[0], c[1]): [r[1] for r in rows if r[0] == c[0] and r[2] <= 7 and c[2] - r[2] >= 5]
                    for c in rows if c[2] >= 9}
        n = Counter((r.prompt, r.chosen_id) for r in got)
        assert n == Counter({c: min(k, len(e)) for c, e in eligible.items() if e})
        assert all(r.rejected_id in eligible[r.prompt, r.chosen_id] for r in got)
        assert len({(r.chosen_id, r.rejected_id) for r in got}) == len(got)


def test_cap_latched_per_split(spark):
    rows = [(1, "A" * 5, "train"), (2, "A" * 50, "train"), (3, "A" * 9, "test"), (4, "A" * 50, "test"), (5, " ", "test")]
    df = spark.createDataFrame(rows, "row_id long, Sequence string, split string")
    got = {r.row_id: r for r in datasets.prompt_completion(df, latch_by="split").collect()}
    assert set(got) == {1, 2, 3, 4}
    assert got[2].n_removed <= 4 and got[4].n_removed <= 8 and got[2].split == "train"


# ------------------------------------------------------------ sources, logs

def test_fasta_keeps_every_record(spark, tmp_path):
    p = f"{tmp_path}/a.fasta"
    with open(p, "w") as f:
        f.write(">one x\nAC GT\n>\nTT\n>\ttabbed name\nGG\r\n>last\n")
    got = sorted((r.entry, r.sequence) for r in readers.read_fasta(spark, p, check=True).collect())
    assert got == [("", "TT"), ("last", ""), ("one", "ACGT"), ("tabbed", "GG")]
    with open(f"{tmp_path}/b.fasta", "w") as f:
        f.write("stray text\n>one\nAC\n")
    with pytest.raises(ValueError, match="before the first"):
        readers.read_fasta(spark, f"{tmp_path}/b.fasta", check=True)


def test_tsv_keeps_blanks_empty_and_null(spark, tmp_path):
    rows = [(1, " AC "), (2, ""), (3, None), (4, "a\"b"), (5, "x  y")]
    writers.write_tsv(spark.createDataFrame(rows, "i long, s string"), f"{tmp_path}/t")
    got = sorted((r.i, r.s) for r in readers.read_tsv(spark, f"{tmp_path}/t", schema="i long, s string").collect())
    assert got == rows


def test_first_entry_of_each_line(spark, tmp_path):
    p = f"{tmp_path}/log.json"
    with open(p, "w") as f:
        for run, first in ((1, {"step": 1, "loss": 0.5, "epoch": 0.1}), (2, {"step": 1, "reward": 1}), (3, {"kl": 2})):
            f.write(json.dumps({"run": run, "part": 0, "log_history": [first, {"step": 2, "later": 1}]}) + "\n")
        f.write(json.dumps({"run": 1, "part": 1, "log_history": [{"step": 3, "other": 1}]}) + "\n")
    got = {(r.run, r.metric) for r in readers.first_entry_metrics(spark, p, multi_line=False, run="run").collect()}
    assert got == {("1", "loss"), ("1", "epoch"), ("2", "reward"), ("3", "kl")}


def test_series_in_step_order(spark):
    rows = [(1, 3, 0, "loss", 0.1), (1, 1, 1, "loss", 0.2), (1, 1, 0, "loss", 0.3), (1, 2, 0, "kl", None)]
    s = spark.createDataFrame(rows, "run long, step long, entry_no long, metric string, value double")
    got = {(r.metric, r.step, r.entry_no): r.order_no for r in logs.in_step_order(s).collect()}
    assert got == {("loss", 1, 0): 1, ("loss", 1, 1): 2, ("loss", 3, 0): 3, ("kl", 2, 0): 1}


def test_stream_fails_on_a_cut_group(spark, tmp_path):
    batch = spark.createDataFrame([(1, 1.0), (1, 2.0), (2, 1.0)], "prompt_id long, reward double")
    with pytest.raises(ValueError, match="has 1 of 2 generations"):
        advantage_sink(f"{tmp_path}/o", num_generations=2)(batch, 0)
    advantage_sink(f"{tmp_path}/o", num_generations=2)(batch.filter("prompt_id = 1"), 1)
    assert sorted(r.advantage for r in spark.read.parquet(f"{tmp_path}/o").collect()) == [-1.0, 1.0]


# ------------------------------------------------------------ package

def test_workers_import_the_package_from_another_folder(tmp_path):
    code = (f"import sys; sys.path.insert(0, {ROOT!r})\n"
            "import __spark_entry__ as e\n"
            "from residua.session import get_session\n"
            "s = get_session('local[2]', shuffle_partitions=2)\n"
            "n = e.queries()['custom_reward'](s, '/root/testdata/sf0.001').count()\n"
            "assert n > 0\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]


def test_library_works_without_the_training_text_subpackage(tmp_path):
    import shutil
    for name in ("residua", "__spark_entry__.py"):
        src = os.path.join(ROOT, name)
        if os.path.isdir(src):
            shutil.copytree(src, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(src, tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) >= 50 and not any(n.startswith('op') for n in q); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]

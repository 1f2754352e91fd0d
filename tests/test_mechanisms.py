"""Running counters, selection, byte-bounded chunks, bucketed tables, replaced steps: against plain recomputation."""

import math
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_mod
from residua.functions.hashing import keyed_hash
from residua.operators import datasets, objective
from residua.operators.ranking import rank_within
from residua.session import scratch_path
from residua.sources import readers, writers
from tests.test_plans import plan


@pytest.mark.parametrize("slice_rows", [7, 2_000_000])
@pytest.mark.parametrize("keys", [["g"], []])
def test_running_sums(spark, slice_rows, keys):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, "hot", "hot", "b"]), rng.randrange(9), rng.randrange(50) if i % 5 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, g string, v int, w int").repartition(5)
    got = rank_within(df, keys, ["v", "id"], "pos", slice_rows, running={"odd": F.col("v") % 2 == 1, "bytes": F.col("w")})
    want = {}
    for g in {r[1] if keys else 0 for r in rows}:
        odd = total = 0
        for pos, r in enumerate(sorted((r for r in rows if not keys or r[1] == g), key=lambda r: (r[2], r[0])), 1):
            odd, total = odd + r[2] % 2, total + (r[3] or 0)
            want[r[0]] = (pos, odd, total)
    assert {r.id: (r.pos, r.odd, r.bytes) for r in got.collect()} == want
    assert got.columns == ["id", "g", "v", "w", "pos", "odd", "bytes"]


@pytest.mark.parametrize("share", [0.2, 0.001, 0.999, 1 / 3])
@pytest.mark.parametrize("n", [1, 2, 997])
def test_exact_split_sizes(spark, share, n):
    df = spark.range(n).select(F.col("id").alias("row_id"), F.lit("x").alias("sequence"))
    got = datasets.train_test_split(df, test_size=share, exact=True, slice_rows=20)
    hashes = {r.row_id: r.h for r in df.select("row_id", keyed_hash(42, F.col("row_id")).alias("h")).collect()}
    first = sorted(hashes, key=lambda i: (hashes[i], i))[:math.ceil(share * n)]
    assert {r.row_id for r in got.filter("split = 'test'").collect()} == set(first)
    assert datasets.train_test_split(df.limit(0), exact=True).count() == 0


def test_exact_split_moves_no_sequence(spark, sf_small, capsys):
    p = plan(entry_mod.queries()["train_test_split_exact"](spark, sf_small), capsys)
    main = p.split("Subqueries")[0]
    assert "Exchange" not in main and "Window" not in main
    for line in p.splitlines():
        if line.startswith("Arguments: hashpartitioning") or line.startswith("Output") and "Exchange" in line:
            assert "sequence" not in line


def test_chunks_are_bounded_by_bytes(spark):
    rng = random.Random(6)
    data = [(i, "p" * rng.randrange(30), "é" * rng.choice([3, 3, 3, 400, 900]) if i % 9 else None) for i in range(200)]
    df = spark.createDataFrame(data, "row_id long, prompt string, completion string").repartition(3)
    path = scratch_path(spark, "chunk-bytes")
    writers.write_columnar_json(df, path, chunk_rows=20, chunk_bytes=1000)
    objects = spark.read.json(path).collect()

    def size(o):
        return sum(len((v or "").encode()) for f in ("prompt", "completion") for v in (o[f] or []))
    assert all(len(o.row_id) == 1 or (len(o.row_id) <= 20 and size(o) <= 1000) for o in objects)
    assert any(size(o) > 1000 for o in objects) and any(len(o.row_id) > 3 for o in objects)
    back = readers.read_columnar_json(spark, path, multi_line=False, with_row_id=True)
    assert sorted(map(tuple, back.drop("source_file").collect())) == data


def test_score_tables_join_without_exchange(spark, capsys):
    def scores(seed, folder):
        df = spark.range(500).select((F.col("id") % 37).alias("seq_id"), F.col("id").alias("pos"),
                                     F.array(F.rand(seed), F.rand(seed + 1)).alias("logits"))
        path = scratch_path(spark, folder)
        return objective.write_score_table(df, "t_" + path[-32:], path, 5), df
    tables = [scores(k, "bucketed") for k in (1, 2, 3)]
    out = objective.align_score_tables(*[t for t, _ in tables])
    p = plan(out, capsys)
    assert "Exchange" not in p and p.count("SortMergeJoin") >= 2 and "Bucketed: true" in p
    want = objective.align_scores(*[t.select("*") for t, _ in tables])
    assert out.count() == 500 and out.exceptAll(want).count() == 0
    assert len(spark.read.format("binaryFile").load(tables[0][0].inputFiles()).collect()) == 5


def test_completion_log_replaces_a_repeated_step(spark):
    path = scratch_path(spark, "log-repeat")

    def step(n, texts):
        return spark.createDataFrame([("a", n, t, 1.0) for t in texts], "run string, step long, completion string, reward double")
    for n, texts in ((1, "xy"), (2, "z"), (2, "z"), (1, "xwv")):
        writers.append_completion_log(step(n, texts), path, replace=True)
    assert sorted((r.step, r.completion) for r in spark.read.parquet(path).collect()) == [
        (1, "v"), (1, "w"), (1, "x"), (2, "z")]

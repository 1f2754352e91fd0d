"""Memory, task sizes and calls stay bounded while the tables grow; the rows stay the same."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from residua.functions import text
from residua.functions.text import random_residues
from residua.operators import datasets
from residua.operators.ranking import rank_within
from residua.operators.udf import score_sequences
from residua.sources import quoted
from residua.streaming.groups import HeldGroups


def test_scorer_gets_bounded_text(spark):
    def factory():
        def score(ids, texts):
            size = sum(len(t or "") for t in texts)
            for i in ids.tolist():                   # an iterator of answers
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([len(texts)]), pa.array([size])], ["k", "n", "size"])
        return score
    df = spark.createDataFrame([(i, None if i % 5 == 0 else "ab" * (i % 7 + (500 if i == 33 else 0))) for i in range(60)],
                               "seq_id long, text string").coalesce(1)
    got = score_sequences(df, factory, schema="k long, n long, size long", call_bytes=50).collect()
    assert sorted(r.k for r in got) == list(range(60))
    assert all(r["size"] <= 50 or r.n == 1 for r in got) and any(r.n > 3 for r in got)
    with pytest.raises(ValueError, match="call_bytes"):
        score_sequences(df, factory, call_bytes=0)


def test_toy_scorer_in_parts_is_the_same(spark):
    from residua.plans.catalog import _toy_scorer_factory
    args = [4, 5, 6, 7], ["ABZ", None, "", "QRSTUV"]
    whole = pa.Table.from_batches(_toy_scorer_factory()(*args))
    parts = list(_toy_scorer_factory(2)(*args))
    assert max(p.num_rows for p in parts) == 2 and pa.Table.from_batches(parts).to_pylist() == whole.to_pylist()
    assert whole.column("next_token_id").to_pylist() == [1, 25, None, 17, 18, 19, 20, 21, None]


@pytest.mark.parametrize("keys", [[], ["g"]])
def test_slices_are_bounded_by_weight(spark, keys):
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        size = F.when(F.col("id") % 50 == 0, 5000).otherwise(F.col("id") % 9 * 10)
        df = spark.range(2000).select("id", F.lit(None).cast("int").alias("g"), size.alias("size"))
        out = rank_within(df, keys, ["id"], weight=F.col("size"), slice_weight=4000, running={"upto": F.col("size")})
        got = out.withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    got.sort(key=lambda r: r.id)
    assert [r.pos for r in got] == list(range(1, 2001)) and got[-1].upto == sum(r["size"] for r in got)
    assert len({r.task for r in got}) > 1            # without weights all rows are one slice


def test_latched_caps_do_not_move_the_rows(spark):
    df = spark.createDataFrame([(i, "ACDEFGHIKL"[: 3 + i % 8], [None, "test", "train"][i % 3]) for i in range(60)],
                               "row_id long, Sequence string, split string")
    out = datasets.prompt_completion(df, latch_by="split")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    caps = {None: 2, "test": 3, "train": 4}          # of rows 0, 1, 2
    got = {r.row_id: r for r in out.collect()}
    assert len(got) == 60 and all(1 <= r.n_removed <= min(caps[r.split], 2 + i % 8) for i, r in got.items())


def test_residues_in_batches(spark, monkeypatch):
    rows = [(None if i == 3 else i, None if i == 5 else "ACé" * i) for i in range(40)]
    df = spark.createDataFrame(rows, "row_id long, sequence string")
    got = datasets.fixed_prefix_pairs(df, k=3, seed=7)
    assert got.columns == ["row_id", "prompt", "chosen", "rejected"] and "MapInArrow" in got._jdf.queryExecution().toString()
    want = got.select("row_id", "prompt", "chosen", random_residues(F.length("chosen"), F.col("row_id"), 7).alias("rejected"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert text.residues(9, "4", alphabet="é1") == spark.range(4, 5).select(
        random_residues(F.lit(9), F.col("id"), alphabet="é1")).first()[0]


def test_cells_leave_in_parts(monkeypatch):
    monkeypatch.setattr(quoted, "PART_BYTES", 60)
    lines = ["head\tb", *(f"{i}\t{'x' * (i % 30)}" for i in range(200)), "", "\r", '"q\t1"\t""', *(f'"{i}{"y" * 20}"' for i in range(20))]
    n = len(lines)
    batch = pa.RecordBatch.from_arrays([pa.array(["f"] * n), pa.array([0] * n), pa.array(lines), pa.array([False] * n),
                                        pa.nulls(n, pa.int64())], ["file", "block", "value", "inside", "owner"])
    out = list(quoted._walker(False)(iter([batch])))
    assert max(sum(len(c or "") for row in b.column(0).to_pylist() for c in row) for b in out) <= 90
    got = [c for b in out for c in b.column(0).to_pylist()]
    assert sorted(map(repr, got)) == sorted(repr(quoted.cells(x)) for x in lines if x.strip("\r"))
    heads = [c for b in out for c, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if h]
    assert heads == [["head", "b"]]


def test_whole_groups_call_the_state_once():
    calls = []

    class State:
        held = None

        def get(self):
            calls.append("get")
            return self.held

        def __getattr__(self, name):
            return lambda *a: calls.append(name)

    fields = [StructField("id", LongType()), StructField("reward", DoubleType()), StructField("n", IntegerType())]
    p = HeldGroups(["id", "reward", "n"], StructType(fields), "reward", "n", None, 0)
    p.rows, p.count = State(), State()
    got = list(p.handleInputRows(("k",), iter([(2, 3.0, 3), (1, 1.0, 3), (3, float("nan"), 3)]), None))
    assert calls == ["get"]
    assert [(r.id, r.advantage, r.status, r.n_generations) for r in got] == [
        (1, -1.0, "complete", 3), (2, 1.0, "complete", 3), (3, None, "complete", 3)]

"""Groups cut over micro-batches: keyed state gives the batch result, survives a restart, reports what timed out."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from residua.operators.grouping import group_advantage
from residua.streaming.groups import relative_advantages, run_held_advantages

SCHEMA = "row_id long, prompt_id string, reward double, expected int, at timestamp"
T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def part(spark, folder, n, rows):
    """One file, and with it one micro-batch, in order of its name."""
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    df.write.parquet(os.path.join(folder, f"tmp{n}"))
    name, = [f for f in os.listdir(os.path.join(folder, f"tmp{n}")) if f.endswith(".parquet")]
    os.makedirs(os.path.join(folder, "in"), exist_ok=True)
    os.rename(os.path.join(folder, f"tmp{n}", name), os.path.join(folder, "in", f"part{n}.parquet"))


def drain(spark, folder, **kw):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(os.path.join(folder, "in"))
    run_held_advantages(stream, os.path.join(folder, "out"), os.path.join(folder, "ckpt"), group="prompt_id",
                        num_generations="expected", **kw)
    return spark.read.parquet(os.path.join(folder, "out"))


def test_cut_groups_and_restart(spark, tmp_path):
    folder = str(tmp_path)
    rows = [(i, f"p{i % 7}" if i % 7 else None, float((i * 37) % 11), 5 if i % 7 != 3 else 4, T0) for i in range(35)]
    rows = [r for r in rows if not (r[1] == "p3" and r[0] > 28)]
    for n in range(3):
        part(spark, folder, n, rows[n * 10:n * 10 + 10])
    first = drain(spark, folder)
    assert first.count() == 14                     # three groups are whole yet
    part(spark, folder, 3, rows[30:])              # the rest, after a restart from the checkpoint
    got = {r.row_id: r for r in drain(spark, folder).collect()}
    want = group_advantage(spark.createDataFrame(rows, SCHEMA), "reward", group="prompt_id").collect()
    assert len(got) == len(rows) == len(want)
    for r in want:
        g = got[r.row_id]
        assert g.status == "complete" and g.n_generations == r.expected and g.at is not None
        assert g.advantage == pytest.approx(r.advantage, abs=1e-12)
    assert drain(spark, folder).count() == len(rows)


def test_timeout_reports_incomplete_groups(spark, tmp_path):
    folder, minute = str(tmp_path), dt.timedelta(minutes=1)
    part(spark, folder, 0, [(1, "cut", 1.0, 3, T0), (2, "whole", 1.0, 2, T0), (9, "null", None, 2, T0)])
    part(spark, folder, 1, [(3, "whole", 3.0, 2, T0 + minute), (4, "cut", 5.0, 3, T0 + minute),
                            (8, "null", 2.0, 2, T0 + minute)])
    part(spark, folder, 2, [(5, "later", 1.0, 2, T0 + 30 * minute)])
    part(spark, folder, 3, [(6, "later", 1.0, 2, T0 + 31 * minute), (7, "open", 1.0, 2, T0 + 31 * minute)])
    got = {r.row_id: (r.status, r.n_generations, r.advantage)
           for r in drain(spark, folder, event_time="at", timeout="10 minutes").collect()}
    assert got == {1: ("timed_out", 2, None), 4: ("timed_out", 2, None), 2: ("complete", 2, -1.0),
                   3: ("complete", 2, 1.0), 5: ("complete", 2, None), 6: ("complete", 2, None),
                   8: ("complete", 2, None), 9: ("complete", 2, None)}


def test_relative_advantages(spark):
    rewards = [3.0, None, 1.0, 8.0]
    df = spark.createDataFrame([(r,) for r in rewards], "reward double").withColumn("g", F.lit(1))
    want = [r.advantage for r in group_advantage(df, "reward", group="g").collect()]
    assert relative_advantages(rewards) == pytest.approx(want)
    assert relative_advantages([2.0, 2.0]) == [None, None] and relative_advantages([]) == []

"""Readers and writers: round trips and reference-format files."""

import json
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from residua.functions.text import RESIDUES
from residua.session import scratch_path
from residua.sources import readers, writers


def tmpdir():
    return tempfile.mkdtemp(prefix="residua-test-")


def test_fasta_parsing_edge_cases(spark):
    d = tmpdir()
    p = os.path.join(d, "a.fasta")
    with open(p, "w", newline="") as f:
        f.write(">sp|P1| first protein\r\nMKV\r\nLAA\r\n>P2 desc >not a split\nGGG\n\n>P3\nW\n")
    got = sorted(tuple(r) for r in readers.read_fasta(spark, p).collect())
    assert got == [("P2", "GGG"), ("P3", "W"), ("sp|P1|", "MKVLAA")]


def test_fasta_round_trip_many_splits(spark):
    rnd = random.Random(0)
    data = [(f"id{i}", "".join(rnd.choice(RESIDUES) for _ in range(rnd.randint(1, 300)))) for i in range(1000)]
    df = spark.createDataFrame(data, "entry string, sequence string")
    path = scratch_path(spark, "fasta-test")
    writers.write_fasta(df.coalesce(1), path, width=60)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        back = readers.read_fasta(spark, path)
        assert back.rdd.getNumPartitions() > 1
        assert sorted(tuple(r) for r in back.collect()) == sorted(data)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_tsv(spark):
    d = tmpdir()
    p = os.path.join(d, "raw.tsv")
    with open(p, "w") as f:
        f.write("Entry\tSequence\tLength\nA1\tMKV\t3\nA2\t\t0\nA3\t  \t2\n")
    df = readers.read_tsv(spark, p)
    assert df.columns == ["Entry", "Sequence", "Length"]
    from residua.operators.datasets import usable_sequences
    assert [r.Entry for r in usable_sequences(df).collect()] == ["A1"]


def test_columnar_json_reference_layout(spark):
    d = tmpdir()
    p = os.path.join(d, "pref.json")
    with open(p, "w") as f:
        json.dump({"prompt": ["HSQK", "HSQK"], "chosen": ["AAC", "AAD"], "rejected": ["AAE", "AAD"]}, f, indent=4)
    df = readers.read_columnar_json(spark, p, ("prompt", "chosen", "rejected"))
    got = sorted((r.row_id, r.prompt, r.chosen, r.rejected) for r in df.collect())
    assert got == [(0, "HSQK", "AAC", "AAE"), (1, "HSQK", "AAD", "AAD")]
    bad = os.path.join(d, "bad.json")
    with open(bad, "w") as f:
        json.dump({"prompt": ["A", "B"], "completion": ["C"]}, f, indent=4)
    with pytest.raises(Exception):
        readers.read_columnar_json(spark, bad).collect()


def test_columnar_json_export_chunks(spark):
    data = [(i, "P%d" % i, "C%d" % i) for i in range(95)]
    df = spark.createDataFrame(data, "row_id long, prompt string, completion string")
    path = scratch_path(spark, "cj-test")
    writers.write_columnar_json(df, path, chunk_rows=10)
    raw = spark.read.json(path)
    assert raw.count() == 10 and raw.select(F.max(F.size("prompt"))).first()[0] == 10
    back = readers.read_columnar_json(spark, path, multi_line=False, with_row_id=True)
    assert sorted((r.row_id, r.prompt, r.completion) for r in back.collect()) == data


def test_trainer_logs(spark):
    d = tmpdir()
    p = os.path.join(d, "trainer_state.json")
    log = {"best_metric": None, "log_history": [
        {"step": 1, "epoch": 0.1, "reward": 1.0, "loss": 0.5},
        {"step": 2, "epoch": 0.2, "reward": 2.0, "loss": 0.4, "kl": 0.01},
        {"step": 3, "epoch": 0.3, "reward": 3.0}]}
    with open(p, "w") as f:
        json.dump(log, f, indent=4)
    entries = readers.read_trainer_logs(spark, p)
    assert entries.count() == 3
    keys = [r.metric for r in readers.first_entry_metrics(spark, p).orderBy("key_no").collect()]
    assert keys == ["epoch", "reward", "loss"]  # first entry's keys, without step
    from residua.operators.logs import metric_series
    s = metric_series(entries.drop("log_file", "entry_no", "best_metric"), metrics=["reward", "loss"])
    assert s.count() == 6 and s.filter("value IS NULL").count() == 1  # missing loss at step 3 is null


def test_trainer_log_export_round_trip(spark):
    wide = spark.createDataFrame([(r, s, s / 10.0, float(s)) for r in (1, 2) for s in range(1, 26)],
                                 "run long, step long, epoch double, reward double")
    path = scratch_path(spark, "logs-test")
    writers.write_trainer_logs(wide, path, chunk_entries=10)
    back = readers.read_trainer_logs(spark, path, multi_line=False)
    assert back.count() == 50
    assert spark.read.json(path).count() == 6  # 3 parts per run


def test_completion_log_append(spark):
    path = scratch_path(spark, "clog-test")
    df = spark.createDataFrame([("r1", 1, "MK", 0.5), ("r1", 2, "MV", 0.1)],
                               "run string, step long, completion string, reward double")
    writers.append_completion_log(df, path)
    writers.append_completion_log(df, path)
    back = spark.read.parquet(path)
    assert back.count() == 4 and back.filter("step = 2").count() == 2


def test_parquet_columns(spark, sf_small):
    df = readers.read_columns(spark, f"{sf_small}/documents.parquet", ("doc_id", "lang"))
    assert df.columns == ["doc_id", "lang"]
    assert readers.read_parquet_shards(spark, f"{sf_small}/documents.parquet").count() == 200


def test_columnar_json_to_parquet(spark):
    d = tmpdir()
    p = os.path.join(d, "pc.json")
    with open(p, "w") as f:
        json.dump({"prompt": ["MK", "GG"], "completion": ["V", "A"]}, f, indent=4)
    out = os.path.join(d, "pc.parquet")
    readers.columnar_json_to_parquet(spark, p, out)
    got = sorted((r.row_id, r.prompt, r.completion) for r in spark.read.parquet(out).collect())
    assert got == [(0, "MK", "V"), (1, "GG", "A")]


def test_parquet_shard_glob(spark):
    d = tmpdir()
    for i in range(3):
        spark.createDataFrame([(i * 10 + j, "MK") for j in range(4)], "row_id long, sequence string") \
            .coalesce(1).write.parquet(os.path.join(d, f"part{i}"))
        src = [f for f in os.listdir(os.path.join(d, f"part{i}")) if f.endswith(".parquet")][0]
        os.link(os.path.join(d, f"part{i}", src), os.path.join(d, f"train-0000{i}-of-00003.parquet"))
    df = readers.read_parquet_shards(spark, os.path.join(d, "train-*-of-*.parquet"))
    assert df.count() == 12

"""Scalar scoring on a file stream equals the batch result; G1 per micro-batch."""

import os
import tempfile

from residua.operators.grouping import group_advantage
from residua.streaming.scoring import advantage_sink, score_completions


def test_stream_scores_equal_batch(spark):
    src = tempfile.mkdtemp(prefix="residua-stream-")
    data = [(i, i // 4, "MKV\nLLA<|endoftext|>" + "ACDEFG"[: i % 6]) for i in range(40)]
    df = spark.createDataFrame(data, "id long, prompt_id long, raw string")
    df.write.mode("overwrite").parquet(os.path.join(src, "in"))
    stream = spark.readStream.schema(df.schema).parquet(os.path.join(src, "in"))
    scored = score_completions(stream, ph_target=7.0)
    q = scored.writeStream.format("memory").queryName("scored_stream").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = sorted(tuple(r) for r in spark.sql("SELECT id, clean, reward, pI_reward FROM scored_stream").collect())
    want = sorted(tuple(r) for r in score_completions(df, ph_target=7.0).select("id", "clean", "reward",
                                                                                 "pI_reward").collect())
    assert got == want

    out = os.path.join(src, "adv")
    q2 = (score_completions(stream).writeStream.foreachBatch(advantage_sink(out, group="prompt_id"))
          .option("checkpointLocation", os.path.join(src, "ckpt")).start())
    q2.processAllAvailable()
    q2.stop()
    adv = sorted((r.id, r.advantage) for r in spark.read.parquet(out).collect())
    ref = sorted((r.id, r.advantage) for r in group_advantage(score_completions(df), "reward",
                                                               group="prompt_id").collect())
    assert adv == ref


def test_advantage_sink_replay_is_idempotent(spark):
    out = os.path.join(tempfile.mkdtemp(prefix="residua-sink-"), "adv")
    batch = spark.createDataFrame([(1, 1, 1.0), (2, 1, 3.0), (3, 2, 5.0)], "id long, prompt_id long, reward double")
    sink = advantage_sink(out, group="prompt_id")
    sink(batch, 0)
    sink(batch, 0)      # replay of the same micro-batch after a failure
    sink(batch.limit(1), 1)
    back = spark.read.parquet(out)
    assert back.filter("batch_id = 0").count() == 3 and back.count() == 4

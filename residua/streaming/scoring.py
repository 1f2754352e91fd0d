"""Score completions arriving as a stream (C1, C9, C10 on ``readStream``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.functions.oracles import isoelectric_point
from residua.functions.rewards import hydrophobicity_reward, target_reward
from residua.functions.text import clean_generated
from residua.operators.batching import check_generation_groups
from residua.operators.grouping import group_advantage


def score_completions(stream: DataFrame, raw: str = "raw", ph_target: float | None = None) -> DataFrame:
    """Clean each generated text and attach rewards; stateless, works on
    batch and streaming DataFrames alike."""
    x = stream.withColumn("clean", clean_generated(raw))
    x = x.withColumn("reward", hydrophobicity_reward("clean"))
    if ph_target is not None:
        x = x.withColumn("pI", isoelectric_point("clean"))
        x = x.withColumn("pI_reward", target_reward("pI", ph_target))
    return x


def advantage_sink(path: str, group: str = "prompt_id", reward: str = "reward", fmt: str = "parquet",
                   num_generations: int | None = None):
    """``foreachBatch`` writer: advantages inside each micro-batch, appended to ``path``.

    A group's statistics need all its rows, so each micro-batch must hold
    complete groups (all generations of a prompt arrive together, as a
    trainer step produces them).  With ``num_generations`` a micro-batch
    with a group of another size fails instead of giving advantages of a
    part of it; without, the source must keep groups together.  The write
    is idempotent per batch id: the batch id is a partition column and the
    partition is overwritten on replay.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()                     # statistics and rows are two uses of it
        try:
            if num_generations is not None:
                groups = check_generation_groups(batch, group, num_generations)
                cut = groups.filter("complete = 0").first()
                if cut is not None:
                    raise ValueError(f"batch {batch_id}: group {cut[group]!r} has {cut['n_generations']} of "
                                     f"{num_generations} generations")
            out = group_advantage(batch, reward, group=group).withColumn("batch_id", F.lit(batch_id))
            (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
                .partitionBy("batch_id").format(fmt).save(path))
        finally:
            batch.unpersist()

    return write


def run_advantage_stream(stream: DataFrame, out: str, checkpoint: str, group: str = "prompt_id",
                         reward: str = "reward", num_generations: int | None = None) -> None:
    """Drain ``stream`` (already scored) into ``out`` with per-batch advantages.

    ``availableNow`` processes everything present and stops; the
    checkpoint makes a restart resume instead of repeating batches.
    """
    sink = advantage_sink(out, group=group, reward=reward, num_generations=num_generations)
    q = (stream.writeStream.foreachBatch(sink)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()

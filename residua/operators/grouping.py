"""Per-group statistics attached to rows, group-relative advantages, histories.

A window ``over (partition by g)`` puts a whole group in one task.  Here
statistics are computed by an aggregate (partial, map-side) and joined
back, so a group holding a third of the table is still split across
tasks (AQE skew join) and small stat tables are broadcast at run time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residua.functions.exact import exact_avg
from residua.operators._keys import join_on_keys


def _keys(group) -> list[str]:
    if group is None:
        return []
    return [group] if isinstance(group, str) else list(group)


def with_group_stats(df: DataFrame, group, aggs: dict[str, Column]) -> DataFrame:
    """Add one column per aggregate, computed over the row's group.

    ``group=None`` means the whole table: the aggregates become scalar
    subqueries (one small job, merged by Catalyst), no join at all.
    """
    keys = _keys(group)
    if not keys:
        out = df
        for name, agg in aggs.items():
            out = out.withColumn(name, df.select(agg).scalar())
        return out
    # Aggregated on the raw keys, joined on the struct key: the stats side
    # then arrives through its own shuffle stage, which AQE needs to split
    # a hot key of the row side (skew join) when the join is not broadcast.
    stats = df.groupBy(*keys).agg(*[a.alias(n) for n, a in aggs.items()])
    return join_on_keys(df, stats, keys, "left")


def group_advantage(df: DataFrame, reward: str = "reward", group=None,
                    out: str = "advantage", zero_std: str = "null",
                    checkpoint: bool = False) -> DataFrame:
    """G1: ``(r - mean) / std`` with population std and no epsilon.

    ``zero_std='null'`` gives NULL where a group's std is 0 (one row, or
    equal rewards); ``'nan'`` reproduces numpy's NaN.  The input is
    evaluated twice (stats and rows); for an expensive reward, pass a thin
    ``(keys, reward)`` projection with ``checkpoint=True``: it is written
    once to ``spark.checkpoint.dir`` (a reliable checkpoint that also cuts
    the lineage, so a lost executor does not recompute the reward).
    """
    if zero_std not in ("null", "nan"):
        raise ValueError("zero_std must be 'null' or 'nan'")
    if checkpoint:
        from residua.session import ensure_checkpoint_dir
        ensure_checkpoint_dir(df.sparkSession)
        df = df.checkpoint(eager=True)
    m, s = f"__{out}_mean", f"__{out}_std"
    x = with_group_stats(df, group, {m: F.avg(reward), s: F.stddev_pop(reward)})
    centred = F.col(reward) - F.col(m)
    adv = F.try_divide(centred, F.col(s))
    if zero_std == "nan":
        adv = F.when(F.col(s) == 0, F.lit(float("nan"))).otherwise(adv)
    return x.withColumn(out, adv).drop(m, s)


def reward_history(df: DataFrame, step="step", reward: str = "reward", exact: bool = False) -> DataFrame:
    """Per-step count, mean, population std, min and max of rewards.

    ``exact``: mean and std are the same, bit by bit, for every partitioning.
    The mean comes first and is joined back, so the rows are read twice.
    """
    keys = _keys(step)
    r = F.col(reward)
    mean, std = F.avg(r), F.stddev_pop(r)
    if exact:
        df = with_group_stats(df, keys, {"__rh_mean": exact_avg(r)})
        off = r - F.col("__rh_mean")
        mean, std = F.max("__rh_mean"), F.sqrt(exact_avg(off * off))
    return df.groupBy(*keys).agg(
        F.count(r).alias("n"),
        mean.alias("mean_reward"),
        std.alias("std_reward"),
        F.min(r).alias("min_reward"),
        F.max(r).alias("max_reward"),
    )

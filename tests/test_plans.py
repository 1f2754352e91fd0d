"""Physical-plan properties that matter at scale (read from explain output)."""

import pytest

import __spark_entry__ as entry_mod
from residua.plans.catalog import QUERIES


def plan(df, capsys):
    df.explain(mode="formatted")
    return capsys.readouterr().out


def test_group_advantage_aggregates_instead_of_window(spark, sf_small, capsys):
    p = plan(entry_mod.queries()["group_advantage"](spark, sf_small), capsys)
    assert "Window" not in p                     # no single-task group
    assert "HashAggregate" in p                  # partial + final aggregate
    assert "EqualTo(role,assistant)" in p        # filter reaches the scan


def test_scan_reads_only_used_columns(spark, sf_small, capsys):
    p = plan(entry_mod.queries()["preview"](spark, sf_small), capsys)
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string,source:string,n_chars:bigint>" in p
    p = plan(entry_mod.queries()["target_reward_advantage"](spark, sf_small), capsys)
    assert "l_extendedprice" not in p.split("ReadSchema")[1].split("\n")[0]


def test_grpo_never_explodes_the_vocabulary(spark, sf_small, capsys):
    p = plan(entry_mod.queries()["grpo_loss"](spark, sf_small), capsys)
    assert "Generate" not in p


def test_batch_window_is_sliced(spark, sf_small, capsys):
    p = plan(entry_mod.queries()["length_batches"](spark, sf_small), capsys)
    windows = [line for line in p.splitlines() if line.startswith("Arguments") and "row_number" in line]
    assert windows and all("__rk_slice" in w for w in windows)


@pytest.mark.parametrize("name", ["preference_pairs", "metric_series", "train_test_split_exact"])
def test_ranked_queries_use_sliced_windows(spark, sf_small, capsys, name):
    p = plan(entry_mod.queries()[name](spark, sf_small), capsys)
    for line in p.splitlines():
        if line.startswith("Arguments") and "row_number()" in line:
            assert "__rk_slice" in line


def test_no_cross_joins_and_only_sliced_windows(spark, sf_small, capsys):
    """Every query of the library: no nested-loop / Cartesian join, and every
    window runs per (group, slice), never over a whole group or table.
    (Text readers number a file's splits, or the marked lines of its first one.)"""
    for name, fn in QUERIES.items():
        p = plan(fn(spark, sf_small), capsys)
        for op in ("NestedLoop", "Cartesian", "CrossJoin"):
            assert op not in p, (name, op)
        for line in p.splitlines():
            if line.startswith("Arguments") and "windowspecdefinition" in line.lower() and "windowspecdefinition(file#" not in line:
                assert "__rk_slice" in line, (name, line)


def test_hot_group_is_split_by_aqe_skew_join(spark, capsys):
    """A group holding a third of the rows: the stats join is a skew-split
    sort-merge join once the runtime sizes say so (no single-task group)."""
    from pyspark.sql import functions as F

    from residua.operators.grouping import group_advantage
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        df = spark.range(30000).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("g"),
                                       (F.col("id") % 17).cast("double").alias("r"))
        out = group_advantage(df, "r", group="g")
        assert out.count() == 30000
        out.collect()
        p = plan(out, capsys)
        assert "isFinalPlan=true" in p and "skew=true" in p
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_batch_scoring_never_shuffles_vocabulary(spark, sf_small, capsys):
    """The scorer ships next_token_id, so no join moves the logit arrays."""
    p = plan(entry_mod.queries()["batch_scoring"](spark, sf_small), capsys)
    assert "Join" not in p and "MapInArrow" in p


def _exchanged(p):
    """What the plan's exchanges carry: the output columns of each."""
    lines = p.splitlines()
    return [lines[i + 1] for i, line in enumerate(lines) if line.startswith("(") and ") Exchange" in line]


def test_advantages_meet_four_numbers_not_vocabularies(spark, sf_small, capsys):
    p = plan(entry_mod.queries()["grpo_loss_one_pass"](spark, sf_small), capsys)
    assert not any("policy" in c or "embedding" in c or "old" in c for c in _exchanged(p))
    p = plan(entry_mod.queries()["grpo_loss"](spark, sf_small), capsys)
    assert all("low" not in c or "policy" not in c for c in _exchanged(p))


def test_plan_building_runs_no_job_and_has_one_form(spark, sf_small):
    from residua.plans import adapters
    assert "repartition" not in str(adapters.table(spark, sf_small, "documents")._jdf.queryExecution().logical()).lower()

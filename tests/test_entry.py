"""Driver contract: entry point, registry, and oracle agreement at sf0.001."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_mod
from residua.plans.catalog import ORACLE_SQL, QUERIES

TABLES = "lineitem events documents embeddings labels conversations benchmark".split()
FAST = ["group_advantage", "prompt_completion_latched", "train_test_split_exact", "length_batches",
        "preference_pairs", "grpo_loss", "perplexity", "metric_series", "fixed_prefix_negatives",
        "stream_group_advantage", "custom_collate", "pair_distance", "log_round_trip", "grpo_loss_one_pass",
        "grpo_loss_by_conversation", "preference_pairs_margin", "serving_batches", "data_preparation",
        "first_entry_series", "pi_reward_advantage", "first_batches"]


def test_entry_runs(spark):
    df = entry_mod.entry(spark)
    assert df.count() > 0
    assert df.columns == ["conv_id", "turn", "reward", "advantage"]


def test_registry_consistent():
    q, o = entry_mod.queries(), entry_mod.oracle_sql()
    assert set(ORACLE_SQL) == set(QUERIES)  # every query of the library has oracle SQL
    assert len(QUERIES) >= 50 and set(QUERIES) <= set(q) and set(o) <= set(q)
    for name in QUERIES:
        assert "pipeline" not in name and not name.startswith("op")


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


def _key(t):
    return tuple((x is None, str(type(x)), x if x is not None else 0) for x in t)


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, sf_small, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    df = entry_mod.queries()[name](spark, sf_small)
    cols = sorted(df.columns)
    got = sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=_key)
    cur = con.execute(entry_mod.oracle_sql()[name])
    dcols = [c[0] for c in cur.description]
    assert sorted(dcols) == cols
    want = sorted((tuple(_norm(dict(zip(dcols, r))[c]) for c in cols) for r in cur.fetchall()), key=_key)
    assert got == want

"""DataFrame operators: invariants from SURVEY section 5 and brute-force checks."""

import math
import random
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from residua.functions.hashing import keyed_hash
from residua.functions.text import RESIDUES
from residua.operators import batching, datasets, grouping, logs
from residua.operators import objective as obj
from residua.operators.ranking import rank_within

from tests.conftest import rows


# ------------------------------------------------------------ ranking

@pytest.mark.parametrize("thin", [False, True])
@pytest.mark.parametrize("keys", [["g"], ["g", "h2"], []])
def test_rank_within_equals_row_number_with_hot_group(spark, keys, thin):
    # one group holds a third of the rows; slices of 50 rows force the split path
    df = (spark.range(3000)
          .withColumn("g", F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 11))
          .withColumn("g", F.when(F.col("id") == 5, F.lit(None)).otherwise(F.col("g")))
          .withColumn("h2", (F.col("id") % 2).cast("int"))
          .withColumn("h", keyed_hash(1, F.col("id"))))
    got = rank_within(df, keys, ["h", "id"], "pos", slice_rows=50, thin=thin)
    w = Window.partitionBy(*keys).orderBy("h", "id") if keys else Window.orderBy("h", "id")
    want = df.withColumn("pos", F.row_number().over(w))
    assert rows(got, "id", "pos") == rows(want, "id", "pos")


def test_rank_within_timestamp_order(spark):
    df = spark.createDataFrame(
        [(1, 10, "2024-01-01 00:00:03"), (1, 11, "2024-01-01 00:00:01"), (1, 12, "2024-01-01 00:00:01"),
         (2, 13, "2024-01-01 00:00:00")], "run long, eid long, ts string").withColumn("ts", F.to_timestamp("ts"))
    got = {r.eid: r.pos for r in rank_within(df, ["run"], ["ts", "eid"], slice_rows=1).collect()}
    assert got == {11: 1, 12: 2, 10: 3, 13: 1}


# ------------------------------------------------------------ G1, G7

def test_group_advantage(spark):
    data = [(1, 1.0), (1, 2.0), (1, 3.0), (2, 5.0), (3, 4.0), (3, 4.0), (None, 1.0), (None, 3.0)]
    df = spark.createDataFrame(data, "g long, r double")
    out = grouping.group_advantage(df, "r", group="g").collect()
    by = defaultdict(list)
    for row in out:
        by[row.g].append(row.advantage)
    assert np.mean(by[1]) == pytest.approx(0) and np.std(by[1]) == pytest.approx(1)
    assert by[2] == [None] and by[3] == [None, None]  # std 0 -> NULL
    assert sorted(by[None]) == [-1.0, 1.0]  # null key is a group of its own
    nan = grouping.group_advantage(df, "r", group="g", zero_std="nan").filter("g = 2").first().advantage
    assert math.isnan(nan)
    glob = [r.advantage for r in grouping.group_advantage(df, "r").collect()]
    rs = np.array([d[1] for d in data])
    assert sorted(glob) == pytest.approx(sorted((rs - rs.mean()) / rs.std()))


def test_reward_history(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 3.0), (2, 2.0)], "step long, reward double")
    got = {r.step: r for r in grouping.reward_history(df).collect()}
    assert got[1].mean_reward == 2.0 and got[1].std_reward == 1.0 and got[1].n == 2
    assert got[2].min_reward == got[2].max_reward == 2.0


# ------------------------------------------------------------ builders (P, B)

def test_require_and_usable(spark):
    df = spark.createDataFrame([(1, None), (2, "  "), (3, "MK")], "row_id long, Sequence string")
    with pytest.raises(ValueError):
        datasets.require_columns(df, "sequence")
    assert [r.row_id for r in datasets.usable_sequences(df).collect()] == [3]


def peptide_table(spark, n=270, seed=5):
    rnd = random.Random(seed)
    data = [(i, "".join(rnd.choice(RESIDUES + "X") for _ in range(rnd.randint(2, 30)))) for i in range(n)]
    return spark.createDataFrame(data, "row_id long, Sequence string")


def test_prompt_completion_rows_and_latch(spark):
    df = peptide_table(spark)
    pc = datasets.prompt_completion(df).collect()
    seq = {r.row_id: r.Sequence for r in df.collect()}
    for r in pc:  # V2, V5
        assert r.prompt + r.completion == seq[r.row_id]
        assert len(r.prompt) >= 1 and len(r.completion) >= 1
    lat = datasets.prompt_completion(df, latch=True).collect()
    first_len = len(seq[min(seq)])
    assert max(len(r.completion) for r in lat) <= first_len - 1  # V4
    tup = datasets.prompt_completion(df, mode="tuple_full").first()
    assert tup.prompt.prefix + tup.prompt.removed == tup.completion
    short = spark.createDataFrame([(1, "M")], "row_id long, Sequence string")
    assert datasets.prompt_completion(short).first().completion == ""
    with pytest.raises(Exception):
        datasets.prompt_completion(short, on_short="error").collect()


def test_train_test_split(spark):
    df = peptide_table(spark)
    exact = datasets.train_test_split(df, exact=True, slice_rows=40)
    assert exact.filter("split = 'test'").count() == math.ceil(0.2 * 270) == 54  # V3
    approx = datasets.train_test_split(df)
    again = datasets.train_test_split(df.repartition(7))
    assert rows(approx, "row_id", "split") == rows(again, "row_id", "split")  # stable under partitioning
    with pytest.raises(ValueError):
        datasets.train_test_split(df, test_size=1.5)


def test_identity_items_lookup(spark):
    df = peptide_table(spark, 10)
    ip = datasets.identity_pairs(df).collect()
    assert all(r.prompt == r.completion for r in ip)
    prot = spark.createDataFrame([(1, 37.0, 9606, "MKV")], "row_id long, ogt double, taxid long, sequence string")
    item = datasets.protein_items(prot).first()
    assert (item.taxon_id, item.temp_g, item.length) == (9606, 37.0, 3)
    keys = spark.createDataFrame([(3,), (3,), (99,)], "row_id long")
    assert [r.row_id for r in datasets.lookup_rows(df, keys).collect()] == [3]


# ------------------------------------------------------------ Q1-Q6

def test_split_overlap_and_degenerate(spark):
    train = spark.createDataFrame([(1, "AAA"), (2, "CCC"), (3, "CCC")], "id long, s string")
    test = spark.createDataFrame([(10, "CCC"), (11, "GGG"), (12, "AAA")], "id long, s string")
    assert sorted(r.id for r in datasets.split_overlap(test, train, "s").collect()) == [10, 12]
    pairs = spark.createDataFrame([("p", "A", "A"), ("p", "A", "C"), ("q", None, None)], "g string, c string, r string")
    got = {r.g: (r.n_pairs, r.n_degenerate) for r in datasets.degenerate_pairs(pairs, "c", "r", group="g").collect()}
    assert got == {"p": (2, 1), "q": (1, 1)}


def test_preference_pairs_linear(spark):
    rnd = random.Random(2)
    data = [(i, "p%d" % (i % 3) if i % 5 else "hot", rnd.choice([0, 1])) for i in range(300)]
    df = spark.createDataFrame(data, "id long, prompt string, q int")
    pairs = datasets.preference_pairs(df, "prompt", "q", "id", chosen_min=1, rejected_max=0, threshold=1,
                                      slice_rows=7).collect()
    src = {i: (p, q) for i, p, q in data}
    chosen = [r.chosen_id for r in pairs]
    assert len(chosen) == len(set(chosen))  # each chosen row exactly once
    n_ch = defaultdict(int)
    n_rj = defaultdict(int)
    for _, p, q in data:
        (n_ch if q == 1 else n_rj)[p] += 1
    assert len(pairs) == sum(n for p, n in n_ch.items() if n_rj[p] > 0)
    for r in pairs:
        assert src[r.chosen_id][0] == src[r.rejected_id][0] == r.prompt
        assert src[r.chosen_id][1] == 1 and src[r.rejected_id][1] == 0
    per_rej = defaultdict(int)
    for r in pairs:
        per_rej[r.rejected_id] += 1
    for p in n_ch:  # rejected rows are reused evenly (cyclic)
        uses = [per_rej[i] for i, pp, q in data if pp == p and q == 0]
        if uses:
            assert max(uses) - min(uses) <= 1


def test_fixed_prefix_pairs(spark):
    df = peptide_table(spark, 50).withColumnRenamed("Sequence", "sequence")
    seq = {r.row_id: r.sequence for r in df.collect()}
    for r in datasets.fixed_prefix_pairs(df).collect():  # V6
        assert len(r.prompt) == min(3, len(seq[r.row_id])) and r.prompt + r.chosen == seq[r.row_id]
        assert len(r.chosen) == len(r.rejected) and "X" not in r.rejected


# ------------------------------------------------------------ batching (T)

def reference_batches(items, batch_size):
    """Plain-Python rendering of the reference sampler rule without shuffling."""
    groups = defaultdict(lambda: defaultdict(list))
    for idx, (tax, length) in enumerate(items):
        groups[tax][(length // 5) * 5].append(idx)
    out = []
    for tax, bins in groups.items():
        for b, idxs in bins.items():
            out.extend(idxs[i:i + batch_size] for i in range(0, len(idxs), batch_size))
    return out


def test_batches_unshuffled_match_reference_rule(spark):
    rnd = random.Random(9)
    items = [(rnd.choice([7, 3, 11]), rnd.randint(3, 40)) for _ in range(200)]
    df = spark.createDataFrame([(i, t, n, n // 5 * 5) for i, (t, n) in enumerate(items)],
                               "row_id long, taxid long, length int, length_bin int")
    b = batching.assign_batches(df, batch_size=8, shuffle=False, slice_rows=5)
    got_rows = b.orderBy(*batching.batch_order(False)).collect()
    got = []
    for r in got_rows:
        if r.pos_in_batch == 1:
            got.append([])
        got[-1].append(r.row_id)
    assert got == reference_batches(items, 8)


def test_batches_shuffled_invariants(spark):
    rnd = random.Random(4)
    data = [(i, rnd.choice([1, 2]), rnd.choice([0, 5, 10])) for i in range(203)]
    data += [(1000 + i, 9, 0) for i in range(9)]  # a group of batch_size + 1
    df = spark.createDataFrame(data, "row_id long, taxid long, length_bin int")
    b = batching.assign_batches(df, batch_size=8, slice_rows=10)
    per = defaultdict(set)
    sizes = defaultdict(int)
    for r in b.collect():
        per[(r.taxid, r.length_bin, r.batch_no)].add((r.taxid, r.length_bin))
        sizes[(r.taxid, r.length_bin, r.batch_no)] += 1
    assert all(len(v) == 1 for v in per.values())  # groups never mix
    assert max(sizes.values()) <= 8
    assert sizes[(9, 0, 0)] == 8 and sizes[(9, 0, 1)] == 1
    n_batches = batching.batch_count(df, batch_size=8).first()
    assert n_batches.n_batches == len(sizes) and n_batches.n_rows == len(data)
    br = batching.batch_rows(b)
    assert br.count() == len(sizes) and br.agg(F.max("n_items")).first()[0] <= 8
    first = batching.first_batches(b, n=2)
    assert first.select("taxid", "length_bin", "batch_no").distinct().count() == 2
    again = batching.assign_batches(df.repartition(5), batch_size=8, slice_rows=10)
    assert rows(b, "row_id", "batch_no", "batch_key") == rows(again, "row_id", "batch_no", "batch_key")


def test_collate_and_generation_groups(spark):
    df = spark.createDataFrame([(i, 1, 0, 3 + i % 4) for i in range(20)],
                               "row_id long, taxid long, length_bin int, length int")
    b = batching.assign_batches(df, batch_size=8)

    def collate(pdf):
        return pd.DataFrame({"batch_no": [int(pdf.batch_no.iloc[0])], "n": [len(pdf)]})

    got = sorted(tuple(r) for r in batching.collate_batches(b, collate, "batch_no long, n long").collect())
    assert got == [(0, 8), (1, 8), (2, 4)]
    comps = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "p long, c string")
    with pytest.raises(ValueError):
        batching.check_generation_groups(comps, "p", 3, batch_size=8)
    g = {r.p: r.complete for r in batching.check_generation_groups(comps, "p", 2, batch_size=8).collect()}
    assert g == {1: 1, 2: 0}


# ------------------------------------------------------------ objective (J, G3-G5, X)

def token_table(spark, n_seq=4, n_pos=5, vocab=6, seed=0):
    rng = np.random.default_rng(seed)
    recs = []
    for s in range(n_seq):
        for p in range(n_pos):
            recs.append((s, p, int(rng.integers(vocab)), rng.normal(size=vocab).astype(np.float32).tolist()))
    return recs, spark.createDataFrame(recs, "seq_id long, pos int, token_id int, logits array<float>")


def test_grpo_equal_policies_is_minus_mean_advantage(spark):
    recs, tok = token_table(spark)
    al = obj.align_scores(tok, tok, tok)
    adv = spark.createDataFrame([(0, 1.0), (1, -0.5), (2, 2.0), (3, 0.0)], "seq_id long, advantage double")
    j = obj.attach_advantages(al, adv)
    loss = obj.grpo_objective(j, beta=0.1, epsilon=0.2).first()
    assert loss.grpo_loss == pytest.approx(-np.mean([1.0, -0.5, 2.0, 0.0]))
    assert loss.n_tokens == 20 and loss.n_elements == 120
    kl = obj.kl_per_token(al).collect()
    assert all(abs(r.kl_mean) < 1e-12 for r in kl)


def test_grpo_matches_numpy(spark):
    _, pol = token_table(spark, seed=1)
    _, old = token_table(spark, seed=2)
    _, ref = token_table(spark, seed=3)
    al = obj.align_scores(pol, old, ref)
    adv = spark.createDataFrame([(0, 1.0), (1, -0.5), (2, 2.0), (3, 0.3)], "seq_id long, advantage double")
    got = obj.grpo_objective(obj.attach_advantages(al, adv), beta=0.1, epsilon=0.01).first().grpo_loss
    a = {0: 1.0, 1: -0.5, 2: 2.0, 3: 0.3}
    terms = []
    for r in al.collect():
        p, o, rf = (np.array(r.policy, dtype=np.float64), np.array(r.old, dtype=np.float64),
                    np.array(r.ref, dtype=np.float64))
        ratio = np.exp(p - o)
        A = a[r.seq_id]
        surr = np.minimum(ratio * A, np.clip(ratio, 0.99, 1.01) * A)
        kl = np.exp(rf - p) - (rf - p) - 1
        terms.append(surr - 0.1 * kl)
    assert got == pytest.approx(-np.mean(np.concatenate(terms)), rel=1e-9)


def test_nll_perplexity_logprob(spark):
    recs, tok = token_table(spark)
    nll = obj.token_nll(tok)
    ppl = {r.seq_id: r for r in obj.perplexity(nll).collect()}
    lp = {r.seq_id: r.logprob for r in obj.sequence_logprob(nll).collect()}
    by = defaultdict(dict)
    for s, p, t, lg in recs:
        by[s][p] = (t, np.array(lg, dtype=np.float64))
    for s, pos in by.items():
        vals = []
        for p in range(len(pos) - 1):
            lg = pos[p][1]
            m = lg.max()
            vals.append(m + math.log(np.exp(lg - m).sum()) - lg[pos[p + 1][0]])
        assert ppl[s].n_tokens == len(vals)
        assert ppl[s].perplexity == pytest.approx(math.exp(np.mean(vals)), rel=1e-5)
        assert lp[s] == pytest.approx(-sum(vals), rel=1e-5)
    assert {r.seq_id: r.n_tokens for r in obj.tokens_per_sequence(tok).collect()} == {s: 5 for s in range(4)}


def test_dpo(spark):
    df = spark.createDataFrame([(-1.0, -2.0, -1.5, -1.5), (-3.0, -1.0, -2.0, -2.0)],
                               "policy_chosen double, policy_rejected double, ref_chosen double, ref_rejected double")
    m = obj.dpo_pair_metrics(df, beta=0.1).collect()
    for r in m:
        margin = 0.1 * (r.policy_chosen - r.ref_chosen) - 0.1 * (r.policy_rejected - r.ref_rejected)
        assert r.margin == pytest.approx(margin)
        assert r.loss == pytest.approx(-math.log(1 / (1 + math.exp(-margin))))
    s = obj.dpo_summary(obj.dpo_pair_metrics(df)).first()
    assert s.rewards_accuracy == 0.5 and s.n_pairs == 2


def test_truncate_tokens(spark):
    df = spark.createDataFrame([(list(range(40)),), ([1, 2],)], "t array<int>")
    got = [r.t for r in obj.truncate_tokens(df, "t", 32).collect()]
    assert len(got[0]) == 32 and got[1] == [1, 2]


# ------------------------------------------------------------ G6, G8, G9, P9, X8

def test_gradient_norms(spark):
    data = [("a", [3.0, 4.0]), ("a", [12.0]), ("b", [-1.0, 1.0]), ("c", None)]
    df = spark.createDataFrame(data, "layer string, grad array<float>")
    l2 = {r.layer: r for r in logs.gradient_norms(df).collect()}
    assert set(l2) == {"a", "b"}  # null gradient skipped
    assert l2["a"].layer_norm == pytest.approx(13.0) and l2["b"].layer_norm == pytest.approx(math.sqrt(2))
    assert l2["a"].total_norm == pytest.approx(math.sqrt(169 + 2))
    mx = {r.layer: r for r in logs.gradient_norms(df, norm_type="max").collect()}
    assert mx["a"].layer_norm == 12.0 and mx["a"].total_norm == 13.0  # sum of layer maxima
    assert logs.gradient_norms(df, norm_type="max", total="max").first().total_norm == 12.0
    l1 = {r.layer: r.layer_norm for r in logs.gradient_norms(df, norm_type=1).collect()}
    assert l1["a"] == pytest.approx(19.0)


def test_metric_series_and_checks(spark):
    wide = spark.createDataFrame([(1, 0.1, 1.0, 0.5), (2, 0.2, None, 0.4), (3, 0.3, 3.0, None)],
                                 "step long, epoch double, reward double, loss double")
    s = logs.metric_series(wide)
    assert s.count() == 6 and s.filter("value IS NULL").count() == 2      # a missing value is null
    assert logs.metric_series(wide, drop_null=True).count() == 4
    labels = {r.metric: r.label for r in s.collect()}
    assert labels == {"reward": "Reward", "loss": "Loss"}
    logs.require_metrics(s, ["reward"])
    with pytest.raises(ValueError):
        logs.require_metrics(s, ["kl"])
    assert logs.select_series(s, ["loss"]).count() == 3
    with pytest.raises(ValueError):
        logs.select_series(s, ["loss", "kl"])
    assert logs.select_series(s, ["kl"], check=False).count() == 0
    assert [r.step for r in logs.every_k_steps(s.filter("metric = 'reward'"), 3).collect()] == [3]


def test_grpo_token_level(spark):
    df = spark.createDataFrame([(0, -1.0, -1.1, -0.9, 1.0), (1, -2.0, -2.0, -2.0, -1.0)],
                               "seq_id long, policy double, old double, ref double, advantage double")
    got = obj.grpo_objective(df, level="token", beta=0.1, epsilon=0.2).first().grpo_loss
    terms = []
    for p, o, r, a in [(-1.0, -1.1, -0.9, 1.0), (-2.0, -2.0, -2.0, -1.0)]:
        ratio = math.exp(p - o)
        surr = min(ratio * a, min(max(ratio, 0.8), 1.2) * a)
        terms.append(surr - 0.1 * (math.exp(r - p) - (r - p) - 1))
    assert got == pytest.approx(-np.mean(terms))
    with pytest.raises(ValueError):
        obj.grpo_objective(df, level="word")


def test_serving_order_and_token_truncation(spark):
    df = spark.createDataFrame([(i, i % 3, 0) for i in range(50)], "row_id long, taxid long, length_bin int")
    b = batching.assign_batches(df, batch_size=4)
    served = batching.serving_order(b, num_partitions=3)
    got = [(r.batch_key, r.taxid, r.length_bin, r.batch_no, r.pos_in_batch) for r in served.collect()]
    assert got == sorted(got)
    _, tok = token_table(spark, n_pos=40)
    assert obj.truncate_token_table(tok, 32).agg(F.max("pos")).first()[0] == 31


def test_metric_series_strict(spark):
    wide = spark.createDataFrame([(1, 1.0, 0.5), (2, 2.0, None)], "step long, reward double, loss double")
    with pytest.raises(Exception):
        logs.metric_series(wide, metrics=["reward", "loss"], strict=True).collect()
    assert logs.metric_series(wide, metrics=["reward"], strict=True).count() == 2


def test_isoelectric_by_composition(spark):
    from residua.functions.oracles import isoelectric_point
    seqs = ["GGG", "KKD", "DKK", "KKD", "", None, "CYH"] * 5
    df = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "row_id long, sequence string")
    got = {r.row_id: r.isoelectric_point for r in datasets.isoelectric_by_composition(df).collect()}
    want = {r.row_id: r.p for r in df.select("row_id", isoelectric_point("sequence").alias("p")).collect()}
    assert got == want


def test_with_rewards(spark):
    from residua.operators.udf import with_rewards
    df = spark.createDataFrame([("AIL",), ("DDE",)], "c string")
    out = with_rewards(df, {"hydro": "hydrophobicity", "n_a": lambda cs, **kw: [float(c.count("A")) for c in cs]}, "c")
    got = {r.c: (r.hydro, r.n_a) for r in out.collect()}
    assert got["AIL"][1] == 1.0 and got["DDE"][1] == 0.0
    assert got["AIL"][0] == pytest.approx(-abs(20 - (1.8 + 4.5 + 3.8)))


def test_metric_series_epoch_as_series(spark):
    wide = spark.createDataFrame([(1, 0.5, 1.0), (2, 1.0, 2.0)], "step long, epoch double, reward double")
    s = logs.metric_series(wide, metrics=["epoch", "reward"])
    assert sorted((r.step, r.metric, r.value) for r in s.collect()) == [
        (1, "epoch", 0.5), (1, "reward", 1.0), (2, "epoch", 1.0), (2, "reward", 2.0)]


def test_collate_per_partition_matches_grouped(spark):
    """Per-partition collate equals applyInPandas, also when Arrow chunks
    (3 rows here) cut batches apart."""
    rnd = random.Random(8)
    df = spark.createDataFrame([(i, rnd.choice([1, 2, 3]), rnd.choice([0, 5]), rnd.randint(1, 30))
                                for i in range(300)], "row_id long, taxid long, length_bin int, length int")
    b = batching.assign_batches(df, batch_size=8).select("taxid", "length_bin", "batch_no", "length")

    def collate(pdf):
        return pd.DataFrame({"taxid": [int(pdf.taxid.iloc[0])], "length_bin": [int(pdf.length_bin.iloc[0])],
                             "batch_no": [int(pdf.batch_no.iloc[0])], "n": [len(pdf)],
                             "s": [int(pdf.length.sum())]})

    schema = "taxid long, length_bin long, batch_no long, n long, s long"
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        fast = sorted(tuple(r) for r in batching.collate_batches(b, collate, schema).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    grouped = sorted(tuple(r) for r in batching.collate_batches(b, collate, schema, per_partition=False).collect())
    assert fast == grouped and len(fast) == b.select("taxid", "length_bin", "batch_no").distinct().count()


def test_token_nll_next_column_equals_join(spark):
    recs, tok = token_table(spark)
    nxt = {(s, p): t for s, p, t, _ in recs}
    rows = [(s, p, t, nxt.get((s, p + 1)), lg) for s, p, t, lg in recs]
    with_next = spark.createDataFrame(rows, "seq_id long, pos int, token_id int, next_token_id int, "
                                            "logits array<float>")
    a = sorted((r.seq_id, r.pos, round(r.nll, 9)) for r in obj.token_nll(tok).collect())
    b = sorted((r.seq_id, r.pos, round(r.nll, 9)) for r in obj.token_nll(with_next).collect())
    assert a == b and len(a) == 4 * 4


def test_group_advantage_checkpointed(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 3.0), (2, 2.0), (2, 6.0)], "g long, r double")
    plain = sorted((r.g, r.r, r.advantage) for r in grouping.group_advantage(df, "r", "g").collect())
    cut = grouping.group_advantage(df, "r", "g", checkpoint=True)
    assert sorted((r.g, r.r, r.advantage) for r in cut.collect()) == plain

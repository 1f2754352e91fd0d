"""GRPO / DPO arithmetic over score tables.

Token tables hold one row per ``(seq_id, pos)`` with the vocabulary
vector in an array column; sums over the vocabulary happen inside the
row, so only one row per token is ever shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.functions import objective as fo
from residua.functions.exact import exact_avg, exact_sum
from residua.operators._keys import join_on_keys


def align_scores(policy: DataFrame, old: DataFrame, ref: DataFrame,
                 keys=("seq_id", "pos"), col: str = "logits") -> DataFrame:
    """Line up policy, old-policy and reference scores per token.

    Inner equi-joins on ``keys``; the three inputs are shuffled on the
    same keys, so the second join reuses the first one's partitioning.
    Each join moves the vocabulary arrays; when the three models score
    in one pass, let the scorer emit the three arrays on one row
    (``udf.ALIGNED_SCHEMA``) and skip this operator.
    """
    keys = list(keys)
    p = policy.select(*keys, *[c for c in policy.columns if c not in keys and c != col],
                      F.col(col).alias("policy"))
    o = old.select(*keys, F.col(col).alias("old"))
    r = ref.select(*keys, F.col(col).alias("ref"))
    return p.join(o, keys, "inner").join(r, keys, "inner")


def write_score_table(scores: DataFrame, name: str, path: str, buckets: int,
                      keys=("seq_id", "pos")) -> DataFrame:
    """Keep the scores of one model pass as table ``name``, bucketed and sorted by ``keys``.

    The one exchange happens here: each bucket is one file, written by one
    task.  Tables with the same ``keys`` and ``buckets`` meet in
    :func:`align_score_tables` without moving again, however often.
    """
    keys = list(keys)
    (scores.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys)
     .option("path", path).mode("overwrite").saveAsTable(name))
    return scores.sparkSession.table(name)


def align_score_tables(policy: DataFrame, old: DataFrame, ref: DataFrame, keys=("seq_id", "pos"),
                       col: str = "logits") -> DataFrame:
    """J2 on tables of :func:`write_score_table`: merge joins of equal buckets, no exchange at any size.

    The old policy and the reference are scored and kept once a step, and
    each of the updates joins its new policy scores to them.
    """
    return align_scores(policy, old.hint("merge"), ref.hint("merge"), keys, col)


def attach_advantages(tokens: DataFrame, advantages: DataFrame, key: str = "seq_id",
                      col: str = "advantage") -> DataFrame:
    """Each token row gets its sequence's advantage (equi-join on ``key``).

    One row per sequence on the right; AQE broadcasts it when small.
    """
    return join_on_keys(tokens, advantages.select(key, col), [key], "inner")


def tokens_per_sequence(tokens: DataFrame, key: str = "seq_id", pos: str = "pos") -> DataFrame:
    """``seq_id, n_tokens``."""
    return tokens.groupBy(key).agg(F.count(pos).alias("n_tokens"))


def grpo_sums(aligned: DataFrame, epsilon: float = 0.01) -> DataFrame:
    """G3, first half: the arrays of each token row reduced to four numbers.

    Replaces ``policy/old/ref`` by ``low, high, kl, n`` (see
    :func:`residua.functions.objective.grpo_sums`).  Do this before J1, so
    that attaching advantages moves no vocabulary.
    """
    rest = [c for c in aligned.columns if c not in ("policy", "old", "ref")]
    s = F.col("__s")
    return (aligned.select(*rest, fo.grpo_sums("policy", "old", "ref", epsilon).alias("__s"))
            .select(*rest, *[s[c].alias(c) for c in ("low", "high", "kl", "n")]))


_NULL_RULES = ("nan", "zero", "error")


def grpo_objective(aligned: DataFrame, advantage: str = "advantage", beta: float = 0.1,
                   epsilon: float = 0.01, level: str = "vocab", null_advantage: str = "nan",
                   exact: bool = False) -> DataFrame:
    """``-(mean of surrogate - beta * KL)``.

    ``level='vocab'`` (the reference): the mean runs over tokens and
    vocabulary entries.  Rows are the output of :func:`grpo_sums`, or
    ``policy/old/ref`` arrays, which are then reduced first.
    ``level='token'``: they are log-probabilities of the chosen tokens
    (one double per row) and the mean runs over tokens.

    ``null_advantage`` says what a NULL advantage (a group without spread)
    means, for both levels: ``'nan'`` makes the loss NaN as the reference
    does, ``'zero'`` keeps the row with advantage 0, so its KL term still
    counts, ``'error'`` fails.  No row is left out of one sum only.
    ``exact`` adds the rows' terms independently of their order, so that the
    loss is the same, bit by bit, for every partitioning.
    Returns one row ``grpo_loss, n_tokens, n_elements``.
    """
    if level not in ("vocab", "token"):
        raise ValueError("level must be 'vocab' or 'token'")
    if null_advantage not in _NULL_RULES:
        raise ValueError(f"null_advantage must be one of {_NULL_RULES}")
    if level == "token":
        low, high, kl = fo.grpo_terms(F.col("policy"), F.col("old"), F.col("ref"), epsilon)
        n = F.lit(1).cast("bigint")
    else:
        if "low" not in aligned.columns:
            aligned = grpo_sums(aligned, epsilon)
        low, high, kl, n = (F.col(c) for c in ("low", "high", "kl", "n"))
    adv = F.col(advantage).cast("double")
    instead = {"nan": F.lit(float("nan")), "zero": F.lit(0.0),
               "error": F.raise_error(F.lit("token without an advantage")).cast("double")}[null_advantage]
    adv = F.when(adv.isNull(), instead).otherwise(adv)
    per = aligned.select(adv.alias("__a"), low.alias("__l"), high.alias("__h"), kl.alias("__k"), n.alias("__n"))
    a = F.col("__a")
    surrogate = F.when(a < 0, a * F.col("__h")).otherwise(a * F.col("__l"))
    total = (exact_sum if exact else F.sum)(surrogate - F.lit(beta) * F.col("__k"))
    return per.agg((-total / F.sum("__n")).alias("grpo_loss"),
                   F.count(F.lit(1)).alias("n_tokens"), F.coalesce(F.sum("__n"), F.lit(0)).cast("bigint").alias("n_elements"))


def kl_per_token(aligned: DataFrame, keys=("seq_id", "pos")) -> DataFrame:
    """C12 per token: mean of the k3 estimator over the vocabulary."""
    kl = fo.kl_k3_array("policy", "ref")
    return aligned.select(*keys, (F.aggregate(kl, F.lit(0.0).cast("double"), lambda a, x: a + x)
                                  / F.size(kl)).alias("kl_mean"))


def token_nll(tokens: DataFrame, key: str = "seq_id", pos: str = "pos",
              token_id: str = "token_id", logits: str = "logits") -> DataFrame:
    """Negative log-likelihood of the next token at each position.

    The next token comes from a ``next_token_id`` column when the scorer
    provides one (no shuffle), else from an equi-join on
    ``(seq_id, pos + 1)`` (the causal-LM shift); the last position of a
    sequence has no target and drops out.
    ``nll = logsumexp(logits) - logits[next]``, max-shifted.
    """
    if "next_token_id" in tokens.columns:
        # A scorer that knows the whole sequence ships the next token on the
        # row: no join, so the vocabulary arrays are never shuffled.
        j = tokens.filter(F.col("next_token_id").isNotNull()).select(
            key, pos, logits, F.col("next_token_id").alias("__next"))
    else:
        nxt = tokens.select(key, (F.col(pos) - 1).alias(pos), F.col(token_id).alias("__next"))
        j = tokens.select(key, pos, logits).join(nxt, [key, pos], "inner")
    target = F.element_at(F.col(logits), F.col("__next").cast("int") + 1)
    return j.select(key, pos, (fo.logsumexp(logits) - target).alias("nll"))


def perplexity(nll: DataFrame, key: str = "seq_id") -> DataFrame:
    """``exp(mean nll)`` per sequence."""
    return nll.groupBy(key).agg(F.count("nll").alias("n_tokens"),
                                F.exp(F.avg("nll")).alias("perplexity"))


def sequence_logprob(nll: DataFrame, key: str = "seq_id") -> DataFrame:
    """Sequence log-probability = ``-sum(nll)``."""
    return nll.groupBy(key).agg((-F.sum("nll")).alias("logprob"))


def dpo_pair_metrics(df: DataFrame, policy_chosen: str = "policy_chosen",
                     policy_rejected: str = "policy_rejected", ref_chosen: str = "ref_chosen",
                     ref_rejected: str = "ref_rejected", beta: float = 0.1) -> DataFrame:
    """Implicit rewards, margin and loss per pair."""
    rc = fo.dpo_implicit_reward(policy_chosen, ref_chosen, beta)
    rr = fo.dpo_implicit_reward(policy_rejected, ref_rejected, beta)
    x = df.withColumn("reward_chosen", rc).withColumn("reward_rejected", rr)
    x = x.withColumn("margin", F.col("reward_chosen") - F.col("reward_rejected"))
    return x.withColumn("loss", fo.dpo_loss("margin"))


def dpo_summary(metrics: DataFrame, exact: bool = False) -> DataFrame:
    """Evaluation summary in one global aggregate; ``exact``: the same for every partitioning, bit by bit."""
    avg = exact_avg if exact else F.avg
    return metrics.agg(
        avg("loss").alias("eval_loss"),
        avg("reward_chosen").alias("rewards_chosen"),
        avg("reward_rejected").alias("rewards_rejected"),
        F.avg((F.col("reward_chosen") > F.col("reward_rejected")).cast("double")).alias("rewards_accuracy"),
        avg("margin").alias("rewards_margin"),
        F.count(F.lit(1)).alias("n_pairs"),
    )


def truncate_token_table(tokens: DataFrame, max_tokens: int = 32, pos: str = "pos") -> DataFrame:
    """X6 on a per-token table: keep positions ``< max_tokens`` (a filter)."""
    if max_tokens < 1:
        raise ValueError("max_tokens must be >= 1")
    return tokens.filter(F.col(pos) < max_tokens)


def truncate_tokens(df: DataFrame, tokens: str, max_tokens: int = 32, out: str | None = None) -> DataFrame:
    """Keep at most ``max_tokens`` tokens of an array column."""
    if max_tokens < 1:
        raise ValueError("max_tokens must be >= 1")
    return df.withColumn(out or tokens, F.slice(F.col(tokens), 1, max_tokens))

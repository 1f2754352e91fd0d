"""Policy-objective arithmetic as Column expressions.

Array forms work on one row per token holding the vocabulary vector, so
the vocabulary is reduced inside the row and never exploded.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def kl_k3(policy, ref) -> Column:
    """C12 (scalar): ``exp(ref - pol) - (ref - pol) - 1``, always >= 0."""
    d = _col(ref) - _col(policy)
    return F.exp(d) - d - F.lit(1.0)


def kl_k3_array(policy, ref) -> Column:
    """C12 elementwise over two equal-length arrays."""
    def k3(p, r):
        d = r.cast("double") - p.cast("double")
        return F.exp(d) - d - F.lit(1.0)

    return F.zip_with(_col(policy), _col(ref), k3)


def importance_ratio(policy, old) -> Column:
    """``exp(policy - old)``."""
    return F.exp(_col(policy) - _col(old))


def clip_ratio(ratio, epsilon: float) -> Column:
    """C14: clamp to ``[1 - eps, 1 + eps]``; NaN stays NaN."""
    r = _col(ratio)
    # Spark orders NaN above all numbers, so least() alone would clamp it.
    return F.when(F.isnan(r), r).otherwise(F.greatest(F.lit(1.0 - epsilon), F.least(F.lit(1.0 + epsilon), r)))


def _nan_min(a: Column, b: Column) -> Column:
    # Spark's least() skips NaN; torch.min propagates it.
    return F.when(F.isnan(a) | F.isnan(b), F.lit(float("nan"))).otherwise(F.least(a, b))


def _nan_max(a: Column, b: Column) -> Column:
    return F.when(F.isnan(a) | F.isnan(b), F.lit(float("nan"))).otherwise(F.greatest(a, b))


def clipped_surrogate(ratio, advantage, epsilon: float) -> Column:
    """``min(ratio * A, clip(ratio) * A)`` with NaN propagation."""
    ratio, adv = _col(ratio), _col(advantage)
    return _nan_min(ratio * adv, clip_ratio(ratio, epsilon) * adv)


def grpo_sums(policy, old, ref, epsilon: float) -> Column:
    """One token row reduced to ``struct(low, high, kl, n)`` over its vocabulary.

    ``low`` and ``high`` are the sums of ``min(ratio, clip)`` and
    ``max(ratio, clip)``.  For an advantage A, ``sum(min(ratio*A, clip*A))``
    is ``A*low`` where A >= 0 and ``A*high`` where A < 0, so the advantage
    is needed only after the vocabulary is gone.  Arrays of unequal size
    fail the job.
    """
    p, o, r = _col(policy), _col(old), _col(ref)
    same = (F.size(p) == F.size(o)) & (F.size(p) == F.size(r))
    checked = F.when(same, p).otherwise(F.raise_error(F.lit("policy, old and ref scores differ in length")))
    zipped = F.arrays_zip(checked.alias("p"), o.alias("o"), r.alias("r"))
    zero = F.lit(0.0).cast("double")

    def add(acc, z):
        pol, ratio_old, ref_ = z["p"].cast("double"), z["o"].cast("double"), z["r"].cast("double")
        low, high, kl = grpo_terms(pol, ratio_old, ref_, epsilon)
        return F.struct((acc["low"] + low).alias("low"), (acc["high"] + high).alias("high"),
                        (acc["kl"] + kl).alias("kl"), (acc["n"] + 1).alias("n"))

    start = F.struct(zero.alias("low"), zero.alias("high"), zero.alias("kl"), F.lit(0).cast("bigint").alias("n"))
    return F.aggregate(zipped, start, add)


def grpo_terms(policy: Column, old: Column, ref: Column, epsilon: float) -> tuple[Column, Column, Column]:
    """``min(ratio, clip)``, ``max(ratio, clip)`` and the KL estimate of one score."""
    ratio = F.exp(policy - old)
    clip = clip_ratio(ratio, epsilon)
    d = ref - policy
    return _nan_min(ratio, clip), _nan_max(ratio, clip), F.exp(d) - d - F.lit(1.0)


def logsumexp(arr) -> Column:
    """Max-shifted log-sum-exp of a numeric array.

    The max is computed once and carried in the fold state (an outer
    expression used inside a lambda would be re-evaluated per element).
    """
    arr = _col(arr)
    start = F.struct(F.lit(0.0).cast("double").alias("s"), F.array_max(arr).cast("double").alias("m"))
    return F.aggregate(arr, start,
                       lambda acc, x: F.struct((acc["s"] + F.exp(x - acc["m"])).alias("s"), acc["m"].alias("m")),
                       lambda acc: acc["m"] + F.log(acc["s"]))


def softplus(x) -> Column:
    """``log(1 + exp(x))`` without overflow."""
    x = _col(x)
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def dpo_implicit_reward(policy_logp, ref_logp, beta: float = 0.1) -> Column:
    """``beta * (log pi - log pi_ref)``."""
    return F.lit(beta) * (_col(policy_logp) - _col(ref_logp))


def dpo_loss(margin) -> Column:
    """``-log sigmoid(margin)`` = softplus(-margin)."""
    return softplus(-_col(margin))

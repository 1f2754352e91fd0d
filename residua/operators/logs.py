"""Training-log analytics and gradient norms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.functions.text import metric_label
from residua.operators.ranking import DEFAULT_SLICE_ROWS, rank_within


def gradient_norms(grads: DataFrame, layer: str = "layer", grad: str = "grad",
                   norm_type=2, total: str = "sum") -> DataFrame:
    """Per-layer gradient norm and the global norm on every row.

    ``norm_type`` p (> 0): layer = ``(sum |g|^p) ^ (1/p)`` over all rows
    of the layer, total = ``(sum layer^p) ^ (1/p)``.  ``'max'``: layer =
    ``max |g|``; total = the **sum** of layer maxima (the reference
    behaviour) or their max with ``total='max'``.  Null gradients are
    skipped.  Returns ``layer, layer_norm, total_norm``.
    """
    g = grads.filter(F.col(grad).isNotNull())
    if norm_type == "max":
        if total not in ("sum", "max"):
            raise ValueError("total must be 'sum' or 'max'")
        per = g.select(layer, F.array_max(F.transform(grad, lambda x: F.abs(x))).cast("double").alias("__v"))
        layers = per.groupBy(layer).agg(F.max("__v").alias("layer_norm"))
        agg = F.sum("layer_norm") if total == "sum" else F.max("layer_norm")
        return layers.withColumn("total_norm", layers.select(agg).scalar())
    p = float(norm_type)
    if p <= 0:
        raise ValueError("norm_type must be > 0 or 'max'")
    powered = F.aggregate(F.transform(grad, lambda x: F.pow(F.abs(x.cast("double")), F.lit(p))),
                          F.lit(0.0).cast("double"), lambda a, x: a + x)
    layers = (g.select(layer, powered.alias("__v")).groupBy(layer)
               .agg(F.pow(F.sum("__v"), F.lit(1.0 / p)).alias("layer_norm")))
    tot = layers.select(F.pow(F.sum(F.pow("layer_norm", F.lit(p))), F.lit(1.0 / p))).scalar()
    return layers.withColumn("total_norm", tot)


def metric_series(entries: DataFrame, metrics=None, ids=("run", "step", "epoch"),
                  label: bool = True, strict: bool = False, drop_null: bool = False) -> DataFrame:
    """G8 on a wide log (one row per log entry, one column per metric).

    ``metrics=None`` unpivots every column that is not an id.  Returns
    long rows ``ids..., metric, value[, label]``, one per entry and metric;
    a missing value is null (``drop_null=True`` leaves it out,
    ``strict=True`` fails).  ``readers.first_entry_metrics`` gives the
    reference's metric list (keys of the first entry).
    """
    ids = [c for c in ids if c in entries.columns]
    metrics = list(metrics) if metrics is not None else [c for c in entries.columns if c not in ids]
    if not metrics:
        raise ValueError("no metric columns to unpivot")
    def value(m):
        v = F.col(m).cast("double")
        if strict:  # the reference raises KeyError when a later entry lacks a key
            v = F.when(F.col(m).isNull(), F.raise_error(F.lit(f"log entry without metric '{m}'"))).otherwise(v)
        return v.alias(f"__m_{m}")

    # Value columns get internal names, so an id such as ``epoch`` can also
    # be a series (the reference's metric list includes it).
    casted = entries.select(*ids, *[value(m) for m in metrics])
    long = casted.unpivot(ids, [f"__m_{m}" for m in metrics], "metric", "value")
    if drop_null:
        long = long.filter(F.col("value").isNotNull())
    long = long.withColumn("metric", F.expr("substring(metric, 5)"))
    return long.withColumn("label", metric_label("metric")) if label else long


def require_metrics(series: DataFrame, names, metric: str = "metric", steps: str = "step") -> None:
    """``ValueError`` if ``steps`` or a requested metric is absent.

    One small job; the driver gets the requested names that exist, no others.
    """
    if steps not in series.columns:
        raise ValueError(f"the series have no step column {steps!r}")
    names = list(names)
    present = {r[0] for r in series.filter(F.col(metric).isin(names)).select(metric).distinct().collect()}
    absent = [n for n in names if n not in present]
    if absent:
        raise ValueError(f"no series for the metrics {absent}")


def select_series(series: DataFrame, names, x: str = "epoch", check: bool = True) -> DataFrame:
    """The requested series against ``x`` (the reference plots epoch).

    An unknown metric is an error (P9); ``check=False`` skips that job.
    """
    if check:
        require_metrics(series, names, steps=x)
    elif x not in series.columns:
        raise ValueError(f"series has no '{x}' column")
    keep = [c for c in ("run", "step") if c in series.columns]
    return series.filter(F.col("metric").isin(list(names))).select(*keep, x, "metric", "value")


def every_k_steps(series: DataFrame, k: int = 1, step: str = "step") -> DataFrame:
    """Keep entries logged every ``k``-th step."""
    if k < 1:
        raise ValueError("k must be >= 1")
    return series.filter(F.pmod(F.col(step), F.lit(k)) == 0)


def in_step_order(series: DataFrame, step: str = "step", tie: str = "entry_no", run: str = "run",
                  out: str = "order_no", slice_rows: int = DEFAULT_SLICE_ROWS) -> DataFrame:
    """L3: number each series' points by step (ties by ``tie``), 1-based."""
    keys = [c for c in (run, "metric") if c in series.columns]
    return rank_within(series, keys, [step, tie], out, slice_rows)

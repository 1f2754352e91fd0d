"""Taxon / length batching.

Rows are never collected into per-group index lists.  Each row gets its
batch coordinates ``(group..., batch_no)``, its position in the batch and
an order key for the batches; a batch only becomes one row (T7) when a
consumer asks, and then it holds at most ``batch_size`` items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.functions.hashing import keyed_hash
from residua.operators._keys import join_on_keys
from residua.operators.ranking import DEFAULT_SLICE_ROWS, rank_within


def _keys(group) -> list[str]:
    return [group] if isinstance(group, str) else list(group)


def assign_batches(df: DataFrame, group=("taxid", "length_bin"), batch_size: int = 8,
                   shuffle: bool = True, seed: int = 42, key: str = "row_id",
                   slice_rows: int = DEFAULT_SLICE_ROWS) -> DataFrame:
    """Cut every group into batches of ``batch_size``; groups never mix.

    ``shuffle=True``: rows are ordered by a keyed hash inside the group
    (T2) and batches carry ``batch_key``, a keyed hash of their
    coordinates, as their shuffled order (T4).  ``shuffle=False`` (T5):
    rows keep key order and batches are ordered by
    ``(taxon_first, bin_first, batch_no)``, the first key seen in the
    first group column and in the group.
    Adds ``batch_no`` (0-based), ``pos_in_batch`` (1-based) and the order
    columns.
    """
    if batch_size < 1:
        raise ValueError("batch_size must be >= 1")
    keys = _keys(group)
    if shuffle:
        x = df.withColumn("__bt_h", keyed_hash(seed, F.col(key)))
        x = rank_within(x, keys, ["__bt_h", key], "__bt_rn", slice_rows).drop("__bt_h")
    else:
        x = rank_within(df, keys, [key], "__bt_rn", slice_rows)
    x = (x.withColumn("batch_no", F.floor((F.col("__bt_rn") - 1) / F.lit(batch_size)).cast("bigint"))
          .withColumn("pos_in_batch", (F.pmod(F.col("__bt_rn") - 1, F.lit(batch_size)) + 1).cast("int"))
          .drop("__bt_rn"))
    if shuffle:
        return x.withColumn("batch_key", keyed_hash(seed, *[F.col(k) for k in keys], F.col("batch_no")))
    # Both orders from one per-group table: a taxon's first row is the
    # smallest first row of its groups, so the rows are joined only once.
    firsts = x.groupBy(*keys).agg(F.min(key).alias("bin_first"))
    taxon = firsts.groupBy(keys[0]).agg(F.min("bin_first").alias("taxon_first"))
    firsts = join_on_keys(firsts, taxon, keys[:1], "inner")
    return join_on_keys(x, firsts, keys, "left")


def batch_order(shuffle: bool = True, group=("taxid", "length_bin")) -> list[str]:
    """Sort columns that give the batch order produced by :func:`assign_batches`."""
    keys = _keys(group)
    if shuffle:
        return ["batch_key", *keys, "batch_no", "pos_in_batch"]
    return ["taxon_first", "bin_first", "batch_no", "pos_in_batch"]


def serving_order(batched: DataFrame, shuffle: bool = True, group=("taxid", "length_bin"),
                  num_partitions: int | None = None) -> DataFrame:
    """Rows in serving order, globally sorted without one task.

    Range-partitions on the batch alone, so a batch lies in one partition
    as a whole, and sorts within partitions: ``mapInPandas`` /
    ``foreachPartition`` consumers see whole batches in order.
    """
    order = batch_order(shuffle, group)
    n = num_partitions or batched.sparkSession.sparkContext.defaultParallelism
    return batched.repartitionByRange(n, *order[:-1]).sortWithinPartitions(*order)


def batch_count(df: DataFrame, group=("taxid", "length_bin"), batch_size: int = 8) -> DataFrame:
    """T6 (and P3): one row with ``n_rows`` and ``n_batches``."""
    keys = _keys(group)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    return sizes.agg(F.sum("__n").cast("bigint").alias("n_rows"),
                     F.sum(F.ceil(F.col("__n") / F.lit(batch_size))).cast("bigint").alias("n_batches"))


def batch_rows(batched: DataFrame, group=("taxid", "length_bin"), key: str = "row_id",
               item_cols=None) -> DataFrame:
    """One row per batch with its items in position order.

    The array is bounded by ``batch_size``, never by a group size.
    ``item_ids`` is the comma-joined key list for easy comparison.
    """
    keys = _keys(group) + ["batch_no"]
    items = item_cols or [key]
    extra = [c for c in ("batch_key", "taxon_first", "bin_first") if c in batched.columns]
    agg = batched.groupBy(*keys, *extra).agg(
        F.sort_array(F.collect_list(F.struct("pos_in_batch", *items))).alias("items"))
    return agg.select(*keys, *extra, F.size("items").alias("n_items"),
                      F.array_join(F.transform("items", lambda s: s[key].cast("string")), ",").alias("item_ids"),
                      "items")


def first_batches(batched: DataFrame, n: int = 1, shuffle: bool = True,
                  group=("taxid", "length_bin")) -> DataFrame:
    """L2: the rows of the first ``n`` batches in serving order, whatever their size.

    A batch's first row stands for it in a top-n; the rows are those whose
    batch is among the ``n`` found.  The limit is the feature.
    """
    order = batch_order(shuffle, group)[:-1]
    first = batched.filter("pos_in_batch = 1").select(*order).orderBy(*order).limit(n)
    return join_on_keys(batched, first, order, "left_semi")


def check_generation_groups(df: DataFrame, prompt_key: str, num_generations: int,
                            batch_size: int | None = None) -> DataFrame:
    """Completions per prompt against ``num_generations``.

    ``batch_size`` must be a multiple of ``num_generations`` (argument
    error).  Returns ``prompt_key, n_generations, complete`` (1/0).
    """
    if num_generations < 1:
        raise ValueError("num_generations must be >= 1")
    if batch_size is not None and batch_size % num_generations != 0:
        raise ValueError("num_generations must evenly divide the batch size")
    counts = df.groupBy(prompt_key).agg(F.count(F.lit(1)).alias("n_generations"))
    return counts.withColumn("complete", (F.col("n_generations") == num_generations).cast("int"))


def collate_batches(batched: DataFrame, fn, schema, group=("taxid", "length_bin"),
                    per_partition: bool = True) -> DataFrame:
    """Run a caller's collate function once per batch (pandas in, pandas out).

    Each call sees exactly one batch (at most ``batch_size`` rows).
    ``per_partition=True``: rows are hash-clustered and sorted by batch,
    and one ``mapInPandas`` pass per partition walks consecutive batches
    (a batch cut by an Arrow chunk boundary is carried to the next chunk),
    avoiding the fixed per-group cost of ``applyInPandas``.  Batch keys
    are never hot (a batch is bounded), so clustering by them is balanced.
    ``per_partition=False`` uses ``groupBy().applyInPandas``.
    """
    keys = _keys(group) + ["batch_no"]
    if not per_partition:
        return batched.groupBy(*keys).applyInPandas(fn, schema)
    clustered = batched.repartition(*keys).sortWithinPartitions(*keys)

    def run(chunks):
        import pandas as pd
        carry = None
        for pdf in chunks:
            if carry is not None:
                pdf = pd.concat([carry, pdf], ignore_index=True)
            if pdf.empty:
                continue
            last = pdf[keys].iloc[-1]
            same = (pdf[keys] == last) | (pdf[keys].isna() & last.isna())   # null keys are keys too
            tail = same.all(axis=1).to_numpy()
            carry, body = pdf[tail], pdf[~tail]
            outs = [fn(g.reset_index(drop=True)) for _, g in body.groupby(keys, sort=False, dropna=False)]
            if outs:
                yield pd.concat(outs, ignore_index=True)
        if carry is not None and not carry.empty:
            yield fn(carry.reset_index(drop=True))

    return clustered.mapInPandas(run, schema)

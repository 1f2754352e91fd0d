"""Exact row positions inside groups, without a single-task hot group.

``row_number() over (partition by g order by k)`` sends every group to
one task.  :func:`rank_within` gives the same numbers but cuts large
groups into slices along the whole order: the boundaries are order
tuples taken from a sample of the group's rows, so outliers do not
matter and rows that tie on the first order column are split by the
further ones.  Rows are numbered inside each slice with a window, and
the sizes of the earlier slices are added.  Only the tiny per-slice
count table goes through a window over the group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from residua.operators._keys import GROUP_KEY, group_key

DEFAULT_SLICE_ROWS = 2_000_000
SAMPLES_PER_SLICE = 32      # a slice is within a factor of two of its size, by a wide margin


def _slice_of(bounds: Column, at: Column) -> Column:
    """Number of boundaries before the order tuple, by binary search; 0 without boundaries."""
    steps = F.ceil(F.log2(F.size(bounds) + 1)).cast("int")

    def halve(acc, _):
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        active = acc["lo"] < acc["hi"]
        before = F.get(bounds, mid) < at
        return F.struct(F.when(active & before, mid + 1).otherwise(acc["lo"]).alias("lo"),
                        F.when(active & ~before, mid).otherwise(acc["hi"]).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.size(bounds).alias("hi"))
    found = F.aggregate(F.sequence(F.lit(1), steps), start, halve, lambda acc: acc["lo"])
    return F.when(F.size(bounds) > 0, found).otherwise(F.lit(0)).cast("bigint")


def rank_within(df: DataFrame, keys, order, out: str = "pos",
                slice_rows: int = DEFAULT_SLICE_ROWS, thin: bool = False,
                running: dict[str, Column] | None = None, weight: Column | None = None,
                slice_weight: int = 32 << 20) -> DataFrame:
    """Add ``out`` = 1-based position of each row in its ``keys`` group.

    ``order`` is a list of column names of any orderable type, ascending,
    nulls first; it must be a total order inside each group (add a unique
    id as the last column) for the numbering to be deterministic.
    ``keys=[]`` numbers the whole table.

    ``slice_rows`` is the number of rows a window task should get (not
    their bytes).  The sample that gives the boundaries is chosen by a hash
    of the order columns, so it is the same whenever the plan, or a lost
    part of it, is evaluated again.  Rows are ranked where they are, never
    joined back on their order columns, so rows that repeat keep their
    number.  ``thin`` is accepted for older callers and has no effect.

    ``running`` names further columns: the sums of whole-number expressions
    over the rows up to and including each one.  They ride on the same
    slices: a position among one class of rows is the running sum of its 0/1
    condition, a byte offset that of the row sizes.

    ``weight`` is a whole-number size of each row (its bytes, say).  A slice
    then holds about ``slice_weight`` at most, besides ``slice_rows`` rows:
    rows enter the sample as often as their weight asks for.
    """
    running = running or {}
    keys = [keys] if isinstance(keys, str) else list(keys or [])
    order = [order] if isinstance(order, str) else list(order)
    if not order:
        raise ValueError("order must name at least one column")
    if slice_rows < 1 or slice_weight < 1:
        raise ValueError("slice_rows and slice_weight must be >= 1")
    bounds, sl, cnt, off, gk = "__rk_bounds", "__rk_slice", "__rk_n", "__rk_off", GROUP_KEY
    at = F.struct(*[F.col(c) for c in order])
    every = max(1, slice_rows // SAMPLES_PER_SLICE)
    step = max(1, slice_rows // every)
    base = df.withColumn(gk, group_key(keys)) if keys else df

    picks = F.pmod(F.xxhash64(*order), F.lit(every)) == 0
    sample, listed = base.filter(picks) if every > 1 else base, F.sort_array(F.collect_list(at))
    if weight is not None:
        step = SAMPLES_PER_SLICE
        each = max(1, slice_weight // step)
        # a row weighs what its share of slice_rows is at least; one that fills a slice needs no more samples
        w8 = F.greatest(F.coalesce(weight.cast("bigint"), F.lit(0)), F.lit(-(-slice_weight // slice_rows)).cast("bigint"))
        often = F.floor(w8 / F.lit(each)) + (F.pmod(F.xxhash64(*order), F.lit(each)) < F.pmod(w8, F.lit(each))).cast("bigint")
        sample = (base.select(*keys, at.alias("__rk_at"), F.least(often, F.lit(step)).cast("int").alias("__rk_often"))
                  .filter("__rk_often > 0").select(*keys, F.explode(F.array_repeat("__rk_at", F.col("__rk_often"))).alias("__rk_at")))
        listed = F.sort_array(F.collect_list("__rk_at"))
    picked = F.transform(F.sequence(F.lit(step), F.size("__rk_all"), F.lit(step)),
                         lambda i: F.element_at("__rk_all", i))
    if keys:
        # Few samples, few groups: usually an empty relation, and then AQE drops both joins.
        cuts = (sample.groupBy(*keys).agg(listed.alias("__rk_all")).filter(F.size("__rk_all") >= step)
                .select(group_key(keys).alias(gk), picked.alias(bounds)))
        hot_rows = base.join(cuts, gk, "inner")
        d = base.join(cuts, gk, "left")
        part = [gk, sl]
    else:
        all_cuts = (sample.agg(listed.alias("__rk_all"))
                    .select(F.when(F.size("__rk_all") >= step, picked).alias(bounds)))
        d = base.withColumn(bounds, all_cuts.scalar())
        hot_rows = d.filter(F.col(bounds).isNotNull())
        part = [sl]

    sliced = F.coalesce(_slice_of(F.col(bounds), at), F.lit(0).cast("bigint"))
    d = d.withColumn(sl, sliced).drop(bounds)
    sums = {f"__rk_run{i}": F.coalesce(x.cast("bigint"), F.lit(0)) for i, x in enumerate(running.values())}
    counts = (hot_rows.select(*([gk] if keys else []), sliced.alias(sl), *[x.alias(c) for c, x in sums.items()])
              .groupBy(*part).agg(F.count(F.lit(1)).alias(cnt), *[F.sum(c).alias(c) for c in sums]))
    w = Window.partitionBy(gk).orderBy(sl) if keys else Window.orderBy(sl)
    offsets = counts.select(*part, (F.sum(cnt).over(w) - F.col(cnt)).alias(off),
                            *[(F.sum(c).over(w) - F.col(c)).alias(c) for c in sums])
    d = d.join(offsets, part, "left")

    rw = Window.partitionBy(*part).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    pos = F.coalesce(F.col(off), F.lit(0)) + F.row_number().over(rw)
    upto = rw.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    more = {name: (F.coalesce(F.col(c), F.lit(0)) + F.sum(x).over(upto)).cast("bigint")
            for name, (c, x) in zip(running, sums.items(), strict=True)}
    out_df = d.withColumns({out: pos.cast("bigint"), **more}).drop(sl, off, *sums)
    return out_df.drop(gk) if keys else out_df

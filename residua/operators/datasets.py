"""Dataset builders: checks, prompt/completion cuts, splits, pair audits.

P1-P7, B1-B4 and the data-visible transforms Q1-Q6.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from residua.functions.hashing import keyed_hash, keyed_uniform
from residua.functions.oracles import ionisable_counts, isoelectric_from_counts
from residua.functions.text import (clean_generated, fixed_prefix, hamming,
                                    is_usable_sequence, residues, suffix_cut)
from residua.operators._keys import join_on_keys
from residua.operators.ranking import DEFAULT_SLICE_ROWS, rank_within
from residua.session import ensure_checkpoint_dir, scratch_path, ship_package


def require_columns(df: DataFrame, *cols: str) -> DataFrame:
    """P5: raise ``ValueError`` before planning if a column is missing."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"DataFrame must contain column(s) {missing}")
    return df


def usable_sequences(df: DataFrame, col: str = "Sequence") -> DataFrame:
    """Drop null and blank sequences; kept values are not stripped."""
    require_columns(df, col)
    return df.filter(is_usable_sequence(col))


def identity_pairs(df: DataFrame, col: str = "Sequence", key: str = "row_id") -> DataFrame:
    """prompt = completion = the sequence."""
    require_columns(df, col, key)
    return df.select(key, F.col(col).alias("prompt"), F.col(col).alias("completion"))


def protein_items(df: DataFrame, key: str | None = "row_id") -> DataFrame:
    """``sequence, taxon_id, temp_g, length`` from ``ogt, taxid, sequence``."""
    require_columns(df, "sequence", "taxid", "ogt")
    cols = [key] if key else []
    return df.select(*cols, "sequence", F.col("taxid").alias("taxon_id"),
                     F.col("ogt").alias("temp_g"), F.length("sequence").alias("length"))


def lookup_rows(df: DataFrame, wanted: DataFrame, key: str = "row_id") -> DataFrame:
    """Rows whose key is in ``wanted`` (left semi join, any number of keys)."""
    return df.join(wanted.select(key), key, "left_semi")


def pair_raw_clean(df: DataFrame, raw: str = "raw", out: str = "clean") -> DataFrame:
    """Keep the raw text and its cleaned form on the same row."""
    return df.withColumn(out, clean_generated(raw))


def prompt_completion(df: DataFrame, seq: str = "Sequence", key: str = "row_id",
                      mode: str = "rows", max_removals=None, latch: bool = False, latch_by=None,
                      seed: int = 42, min_removals: int = 1, on_short: str = "keep",
                      checked: bool = True) -> DataFrame:
    """Cut each sequence into a prompt and what was removed.

    ``mode='rows'`` (B2/B3): prompt = prefix, completion = removed part.
    ``mode='tuple_full'`` (B1): prompt = struct(prefix, removed),
    completion = the whole sequence.
    ``checked`` applies P5 and P6 first (B3).  ``latch=True`` takes the
    cap from the first kept row (smallest key), as the reference's
    shipped files show; it is one scalar subquery, not a join.
    ``latch_by`` names a column (a split, say) whose values latch a cap
    each; that column stays in the result.  The caps are written to the
    scratch folder at once, so that their size is known when they are
    joined: a few are broadcast, and the rows stay where they are.
    ``on_short='error'`` fails on sequences of length <= 1 instead of
    returning them whole.
    """
    if mode not in ("rows", "tuple_full"):
        raise ValueError(f"unknown mode {mode!r}")
    if on_short not in ("keep", "error"):
        raise ValueError("on_short must be 'keep' or 'error'")
    require_columns(df, seq, key)
    if checked:
        df = usable_sequences(df, seq)
    cap = max_removals
    if latch and cap is None:
        cap = df.select(F.min_by(F.length(seq), F.col(key))).scalar() - F.lit(1)
    by = [latch_by] if latch_by else []
    if by and max_removals is None:
        caps = df.groupBy(*by).agg((F.min_by(F.length(seq), F.col(key)) - 1).alias("__cap"))
        path = scratch_path(df.sparkSession, "caps")
        caps.write.parquet(path)
        caps = df.sparkSession.read.parquet(path)
        df, cap = join_on_keys(df, caps, by, "left"), F.col("__cap")
    s = F.col(seq)
    if on_short == "error":
        s = F.when(F.length(s) <= 1, F.raise_error(F.lit("sequence of length <= 1"))).otherwise(s)
    cut = suffix_cut(s, F.col(key), seed=seed, max_removals=cap, min_removals=min_removals)
    x = df.select(key, *by, s.alias("__seq"), cut.alias("__cut"))
    if mode == "rows":
        return x.select(key, *by, F.col("__cut.prefix").alias("prompt"),
                        F.col("__cut.removed").alias("completion"),
                        F.col("__cut.n_removed").alias("n_removed"))
    return x.select(key, *by, F.struct(F.col("__cut.prefix").alias("prefix"),
                                  F.col("__cut.removed").alias("removed")).alias("prompt"),
                    F.col("__seq").alias("completion"), F.col("__cut.n_removed").alias("n_removed"))


def train_test_split(df: DataFrame, key: str = "row_id", test_size: float = 0.2,
                     seed: int = 42, exact: bool = False, out: str = "split",
                     slice_rows: int = DEFAULT_SLICE_ROWS) -> DataFrame:
    """Label rows ``train`` / ``test``.

    Default: keyed hash below ``test_size`` -- no shuffle, stable under
    any partitioning, size exact only in expectation.  ``exact=True``:
    the ``ceil(test_size * n)`` rows with the smallest (hash, key) are
    the test set.  The (hash, key) of the last of them is selected first:
    a histogram of hash prefixes finds the bucket that holds it, and only
    that bucket's keys are ranked (in slices); this runs at once.  Rows are
    then labelled where they are; nothing but keys is ever shuffled.  Only if
    the size falls among rows that share a key are those rows numbered.
    """
    if not 0.0 < test_size < 1.0:
        raise ValueError("test_size must be in (0, 1)")
    if not exact:
        lab = F.when(keyed_uniform(seed, F.col(key)) < F.lit(test_size), "test").otherwise("train")
        return df.withColumn(out, lab)
    h, at = "__split_h", keyed_hash(seed, F.col(key))
    cut = last_of_smallest(df.select(at.alias(h), key), [h, key], test_size, slice_rows)
    if cut is None:
        return df.withColumn(out, F.lit("train"))
    here = F.struct(at.alias(h), F.col(key))
    last = F.struct(F.lit(cut["last"][h]).cast("bigint").alias(h),
                    F.lit(cut["last"][key]).cast(df.schema[key].dataType).alias(key))
    if cut["upto"] == cut["wanted"]:
        return df.withColumn(out, F.when(here <= last, "test").otherwise("train"))
    ensure_checkpoint_dir(df.sparkSession)
    tied = df.filter(here == last).withColumn(h, F.monotonically_increasing_id()).checkpoint(eager=True)
    tied = rank_within(tied, [], [h], "__split_pos", slice_rows)
    first = F.col("__split_pos") <= cut["wanted"] - cut["since"] + 1
    return (df.filter(here != last).withColumn(out, F.when(here < last, "test").otherwise("train"))
            .union(tied.withColumn(out, F.when(first, "test").otherwise("train")).drop(h, "__split_pos")))


HISTOGRAM_BITS = 16


def last_of_smallest(df: DataFrame, order: list[str], share: float, slice_rows: int = DEFAULT_SLICE_ROWS):
    """Row number ``wanted = ceil(share * n)`` in ascending order, or None for an empty table.

    One row ``wanted, last, since, upto``: its ``order`` values as a struct,
    and the numbers of the first and last row that have the same.
    ``order[0]`` is a 32-bit hash.  Its first bits make 65,536 buckets whose
    counts are a table of fixed size; the wanted row's bucket is ranked alone.
    """
    bucket = F.shiftright(order[0], 32 - HISTOGRAM_BITS)
    sizes = df.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    # one array of at most 65,536 counts, walked in order
    sizes = sizes.agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("all"), F.sum("n").alias("total"))
    wanted = F.ceil(F.lit(share) * F.col("total"))
    start = F.struct(F.lit(None).cast("bigint").alias("bucket"), F.lit(0).cast("bigint").alias("before"),
                     F.lit(0).cast("bigint").alias("upto"))
    found = F.aggregate("all", start, lambda acc, x: F.when(acc["upto"] >= wanted, acc).otherwise(F.struct(
        x["bucket"].alias("bucket"), acc["upto"].alias("before"), (acc["upto"] + x["n"]).alias("upto"))))
    place = sizes.select(found["bucket"].alias("bucket"), found["before"].alias("before"), wanted.alias("wanted")).first()
    if place["bucket"] is None:
        return None
    ranked = rank_within(df.filter(bucket == place["bucket"]), [], order, "__los_pos", slice_rows)
    number = F.col("__los_pos") + place["before"]
    return (ranked.groupBy(F.struct(*order).alias("last")).agg(F.min(number).alias("since"), F.max(number).alias("upto"))
            .filter(F.lit(place["wanted"]).between(F.col("since"), F.col("upto")))
            .withColumn("wanted", F.lit(place["wanted"])).first())


def split_overlap(left: DataFrame, right: DataFrame, col: str) -> DataFrame:
    """Q1: rows of ``left`` whose ``col`` value also occurs in ``right``.

    Joined on a SHA-256 digest, so a 100 kB text shuffles 64 bytes; the
    right side is reduced to distinct digests first, so a value copied a
    million times still meets one build row (AQE splits the left side).
    """
    d = "__ovl_digest"
    r = right.select(F.sha2(F.col(col), 256).alias(d)).distinct()
    return (left.withColumn(d, F.sha2(F.col(col), 256))
                .join(r, d, "left_semi").drop(d))


def degenerate_pairs(df: DataFrame, chosen: str = "chosen", rejected: str = "rejected",
                     group=None) -> DataFrame:
    """Q2: count pairs whose chosen equals rejected (null-safe)."""
    keys = [] if group is None else ([group] if isinstance(group, str) else list(group))
    same = F.col(chosen).eqNullSafe(F.col(rejected)).cast("bigint")
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_pairs"),
                                 F.sum(same).alias("n_degenerate"))


def fixed_prefix_pairs(df: DataFrame, seq: str = "sequence", key: str = "row_id",
                       k: int = 3, seed: int = 42) -> DataFrame:
    """Q3 + Q4: prompt = first ``k`` letters, chosen = the rest, rejected =
    a keyed-random residue string of the chosen's length.

    The residues are those of :func:`residua.functions.text.random_residues`,
    made from whole digests on Arrow batches; answers leave in parts of a few
    megabytes.
    """
    ship_package(df.sparkSession)
    p = fixed_prefix(seq, k)
    x = df.select(key, p.alias("__p")).select(
        key, F.col("__p.prompt").alias("prompt"), F.col("__p.rest").alias("chosen"),
        F.col(key).cast("string").alias("__key"))

    def run(batches):
        for rb in batches:
            keys, lengths = rb.column(3).to_pylist(), pc.utf8_length(rb.column(2)).to_pylist()
            at = 0
            while at < len(keys):
                made, size, to = [], 0, at
                while to < len(keys) and size < PART_LETTERS:
                    made.append(residues(lengths[to], keys[to], seed))
                    size, to = size + len(made[-1]), to + 1
                part = rb.slice(at, to - at)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(made, pa.string())],
                                                 [*part.schema.names[:3], "rejected"])
                at = to

    return x.mapInArrow(run, StructType([*x.schema.fields[:3], StructField("rejected", StringType())]))


#: Letters that a batch of random residues holds, or one text
PART_LETTERS = 4 << 20


def preference_pairs(df: DataFrame, prompt, score: str, key: str,
                     chosen_min: float, rejected_max: float, threshold: float = 0.0,
                     seed: int = 42, slice_rows: int = DEFAULT_SLICE_ROWS, carry=(), partners: int = 1,
                     checkpoint: bool = True) -> DataFrame:
    """Q5: pair higher- with lower-scored variants that share a prompt.

    Not a cross product.  Inside each prompt the rejected rows (score <=
    ``rejected_max``) are ordered by score, then by a keyed hash.  A chosen
    row (score >= ``chosen_min``) may meet the first ``m`` of them, those
    with ``score_c - score_r >= threshold``; as the i-th chosen row in
    keyed-hash order it gets the positions ``(i - 1 + j) mod m + 1`` for
    ``j < min(partners, m)``.  So every chosen row with an eligible partner
    is paired, no pair repeats, and the output is at most ``partners`` rows
    per chosen row.

    All of this happens on thin rows of keys, id and score; columns in
    ``carry`` are joined on the (unique) ``key`` at the end, once per side,
    as ``chosen_<c>`` / ``rejected_<c>``.

    Two rankings do this: one by value, with a running count of rejected
    rows, and one of the chosen rows by hash.  A rank reads its input several
    times, so the thin rows are written to ``spark.checkpoint.dir`` before
    and between them; ``checkpoint=False`` keeps the plan lazy and reads
    ``df`` again for each use.
    """
    def settled(x):
        if not checkpoint:
            return x
        ensure_checkpoint_dir(x.sparkSession)
        return x.checkpoint(eager=True)

    if partners < 1:
        raise ValueError("partners must be >= 1")
    keys = [prompt] if isinstance(prompt, str) else list(prompt)
    base = df.select(*keys, F.col(key).alias("__pp_id"), F.col(score).alias("__pp_s"),
                     keyed_hash(seed, F.col(key)).alias("__pp_h"))
    s = F.col("__pp_s")
    base = settled(base.filter((s >= chosen_min) | (s <= rejected_max)))
    ch = base.filter(s >= chosen_min).withColumns({"__pp_v": (s - F.lit(threshold)).cast("double"), "__pp_c": F.lit(1)})
    rj = base.filter(s <= rejected_max).withColumns({"__pp_v": s.cast("double"), "__pp_c": F.lit(0)})
    tie = ["__pp_h", "__pp_id"]
    # One ranking by value, rejected rows first among equals: the rejected rows up to each row are a rejected
    # row's position, and for a chosen row the number of those it may meet.
    both = settled(rank_within(rj.unionByName(ch), keys, ["__pp_v", "__pp_c", *tie], "__pp_all", slice_rows,
                               running={"__pp_pos": F.col("__pp_c") == 0}))
    rj = both.filter("__pp_c = 0")
    ch = rank_within(both.filter("__pp_c = 1"), keys, tie, "__pp_turn", slice_rows)
    m = F.col("__pp_pos")
    left = ch.filter(m > 0).select(
        *keys, F.col("__pp_id").alias("chosen_id"), F.col("__pp_s").alias("chosen_score"),
        F.explode(F.transform(F.sequence(F.lit(0).cast("bigint"), F.least(F.lit(partners).cast("bigint"), m) - 1),
                              lambda j: F.pmod(F.col("__pp_turn") - 1 + j, m) + 1)).alias("__pp_at"))
    right = rj.select(*keys, F.col("__pp_pos").alias("__pp_at"), F.col("__pp_id").alias("rejected_id"), s.alias("rejected_score"))
    pairs = join_on_keys(left, right, keys + ["__pp_at"], "inner").drop("__pp_at")
    for side in ("chosen", "rejected") if carry else ():
        texts = df.select(F.col(key).alias(f"{side}_id"), *[F.col(c).alias(f"{side}_{c}") for c in carry])
        pairs = pairs.join(texts, f"{side}_id")
    return pairs


def pair_distance(pairs: DataFrame, a: str = "chosen", b: str = "rejected",
                  out: str = "distance") -> DataFrame:
    """Q6: Hamming distance over the whole texts (length gap counts)."""
    return pairs.withColumn(out, hamming(a, b))


def isoelectric_by_composition(df: DataFrame, seq: str = "sequence", out: str = "isoelectric_point",
                               method: str = "native") -> DataFrame:
    """C7 solved once per distinct composition of ionisable residues.

    Pays off on short peptides, where many rows share the seven counts:
    the distinct compositions are solved and joined back on the count
    struct (a hot composition is an AQE skew-split join, not one task).
    On long text nearly every row is distinct; use the column form there.
    """
    c = "__pi_counts"
    x = df.withColumn(c, ionisable_counts(seq))
    solved = x.select(c).distinct().withColumn(out, isoelectric_from_counts(F.col(c), method))
    return join_on_keys(x, solved, [c], "left").drop(c)

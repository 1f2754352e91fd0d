"""Near-duplicate groups by one-permutation MinHash.

One hash per shingle fills ``BINS`` bins with the least value of each bin;
empty bins are filled by optimal densification: each bin has a fixed random
order of the others and borrows from the first that is not empty.  Bands of
four bins make buckets.

Documents with the same shingle set are one entity from the start, so exact
copies never meet in buckets.  A bucket's entities are compared on their
full sets by one task, which reports links as a star around the least
entity of each group it finds: at most one edge per member, never all pairs.
Buckets with the same members are compared once.

A bucket with more than ``MAX_BUCKET`` members (or too many shingles) is not
gathered: its members are dealt again by longer bands, which only closer
texts share, and, if that is not enough, once more.  At the longest bands
what is still too large is nearly alike; it is cut into blocks, differently
in every bucket, that each hold the bucket's least member as a common centre.
Members of such a bucket that these links have not connected are then dealt
over pairs of blocks, so that every pair of them meets in a bounded list; a
large group is mostly connected by then and little is left.  Where it is
not, the lists of a bucket grow with the square of its size.

With bands of four, two sets of similarity 0.8 miss each other with
probability (1 - 0.8^4)^32, below 1e-7; the longer bands are chosen alike.

Defined results: a very long text is one set, compared whole; null text and
text without words have an empty set, are
linked with nothing and stay; with fewer words than a shingle the whole
sequence is one shingle; a null id counts as larger than any other; of rows
repeated with the same id exactly one is kept; an empty table gives an empty
result; extra columns are left behind.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.llm import text as T
from residua.llm.components import connected_components
from residua.llm.frames import fresh, slim, written
from residua.operators._keys import join_on_keys

SHINGLE, PERCENT = 5, 80
BINS = 128
LEVELS = ((4, 32), (8, 96), (12, 512))          # bins per band, bands
MAX_BUCKET, MAX_BUCKET_SHINGLES = 2000, 2_000_000

_SHIFT = np.uint64(64 - BINS.bit_length() + 1)
_EDGES = np.arange(BINS, dtype=np.uint64) << _SHIFT
_ORDER = np.argsort(T.stream(77, BINS * BINS).reshape(BINS, BINS), axis=1)


def _bands(level: int) -> np.ndarray:
    """The bins of each band; the first level uses every bin once."""
    size, n = LEVELS[level]
    if size * n == BINS:
        return np.arange(BINS).reshape(n, size)
    return np.argsort(T.stream(101 + level, n * BINS).reshape(n, BINS), axis=1)[:, :size]


def shingle_sets(column, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    data, off = T.buffers(column)
    _, _, doc, h = T.words(data, off, fold=True)
    n = T.counts(doc, len(off) - 1)
    first = np.concatenate([[0], np.cumsum(n)])
    w, _ = T.windows(h, doc, k)
    for i in range(len(n)):
        if n[i] >= k:
            x = np.sort(w[first[i]:first[i + 1] - k + 1])
            yield x[np.concatenate([[True], x[1:] != x[:-1]])]
        elif n[i]:
            m = int(n[i])
            yield T.windows(h[first[i]:first[i + 1]], doc[first[i]:first[i + 1]], m)[0] ^ np.uint64(m)
        else:
            yield w[:0]


def signature(x: np.ndarray) -> np.ndarray:
    """Densified one-permutation MinHash of a sorted non-empty set, 16 bits a bin."""
    at = np.minimum(np.searchsorted(x, _EDGES), len(x) - 1)
    v = x[at]
    full = (v >> _SHIFT) == np.arange(BINS, dtype=np.uint64)
    if not full.all():
        empty = np.flatnonzero(~full)
        order = _ORDER[empty]
        v = v.copy()
        v[empty] = v[order[np.arange(len(empty)), full[order].argmax(axis=1)]]
    return (T.mix(v) >> np.uint64(48)).astype(np.uint16)


def signatures(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """``id, text_hash, n_shingles, set_key, sig``; the last two null for empty sets."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in T.slices(batches, "text"):
            n, key, sig = [], [], []
            for x in shingle_sets(b.column(1), shingle):
                n.append(len(x))
                key.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None)
                sig.append(signature(x).tobytes() if len(x) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(key, pa.binary()),
                 pa.array(sig, pa.binary())], ["id", "text_hash", "n_shingles", "set_key", "sig"])

    rows = slim(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    return rows.mapInArrow(sign, "id bigint, text_hash bigint, n_shingles bigint, set_key binary, sig binary")


def _buckets(entities: DataFrame, level: int) -> DataFrame:
    """``key, row, n_shingles`` for every band of every entity."""
    bands = _bands(level)
    salt = T.stream(211 + level, len(bands))
    factors = T.stream(307, bands.shape[1]) | np.uint64(1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                sig = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint16).reshape(-1, BINS)
                keys = T.mix((T.mix(sig[:, bands].astype(np.uint64) + np.uint64(1)) * factors).sum(axis=2) + salt)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.reshape(-1).view(np.int64)),
                     *(pa.array(np.repeat(b.column(i).to_numpy(), len(bands))) for i in (0, 1))],
                    ["key", "row", "n_shingles"])

    return entities.select("row", "n_shingles", "sig").mapInArrow(deal, "key bigint, row bigint, n_shingles bigint")


def candidate_lists(entities: DataFrame, max_bucket: int, max_shingles: int) -> tuple[DataFrame, DataFrame | None]:
    """``list, row``: entities to compare with each other, from all levels; no list is over the bounds.

    The lists of the last level may be blocks of a larger bucket with its
    least member in each block.  Such buckets come back whole as well, as
    ``key, row, n_shingles`` (None without any): see :func:`remaining_lists`.
    """
    lists, level = None, 0
    while True:
        dealt = _buckets(entities, level)
        sizes = dealt.groupBy("key").agg(
            F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("weight"), F.min("row").alias("centre"),
            F.sum(F.xxhash64("row").cast("decimal(38,0)")).alias("members")).filter("n > 1")
        sizes = written(sizes, "near-buckets")
        large = (F.col("n") > max_bucket) | ((F.col("weight") > max_shingles) & (F.col("n") > 2))
        once = sizes.filter(~large).groupBy("n", "members", "centre").agg(F.min("key").alias("key"))
        fit = dealt.join(once.select("key").hint("merge"), "key").select(F.col("key").alias("list"), "row")
        lists = fit if lists is None else lists.unionByName(fit)
        over = sizes.filter(large)
        if over.isEmpty():
            return lists, None
        if level + 1 == len(LEVELS):
            share = F.greatest(F.ceil(F.col("n") / max_bucket), F.ceil(F.col("weight") / max_shingles))
            over = over.groupBy("n", "members", "centre").agg(F.min("key").alias("key"), F.max("weight").alias("weight"))
            over = over.select("key", "centre", share.alias("blocks"))
            blocks = written(dealt.join(over.hint("merge"), "key"), "near-large")
            block = F.xxhash64("key", F.pmod(F.xxhash64("key", "row"), F.col("blocks")))
            centres = over.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("b"), "key", "centre")
            return (lists.unionByName(blocks.select(block.alias("list"), "row"))
                    .unionByName(centres.select(F.xxhash64("key", "b").alias("list"), F.col("centre").alias("row"))),
                    blocks.select("key", "row", "n_shingles"))
        hot = dealt.join(over.select("key"), "key").select("row").distinct()
        entities = written(entities.join(hot, "row", "left_semi"), "near-hot")
        level += 1


def remaining_lists(large: DataFrame, roots: DataFrame, max_bucket: int, max_shingles: int) -> DataFrame:
    """``list, row``: lists in which all members of each large bucket meet that ``roots`` has not connected yet.

    The largest connected group of a bucket is not compared within itself.
    Its members and the others are cut into blocks of half a list; every
    block of others meets every block of the bucket.
    """
    rows = (large.join(roots.withColumnRenamed("node", "row").hint("merge"), "row", "left")
            .withColumn("root", F.coalesce("root", "row")))
    groups = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("weight"))
    main = F.max(F.struct("n", "root", "weight")).alias("main")
    cuts = (groups.groupBy("key").agg(main, (F.sum("n") - F.max("n")).alias("n"), F.sum("weight").alias("weight"))
            .filter("n > 0"))

    def share(n, weight):
        return F.greatest(F.ceil(2 * n / max_bucket), F.ceil(2 * weight / max_shingles), F.lit(1).cast("bigint"))

    cuts = cuts.select("key", F.col("main.root").alias("most"),
                       share(F.col("main.n"), F.col("main.weight")).alias("whole"),
                       share(F.col("n"), F.col("weight") - F.col("main.weight")).alias("others"))
    rows = rows.join(cuts.hint("merge"), "key")
    inside, hashed = F.col("root") == F.col("most"), F.xxhash64("key", "row")
    block = F.when(inside, F.col("others") + F.pmod(hashed, "whole")).otherwise(F.pmod(hashed, "others"))
    last = F.when(inside, F.col("others")).otherwise(F.col("others") + F.col("whole")) - 1
    met = (rows.select("key", "row", block.alias("block"), last.alias("last"))
           .select("key", "row", "block", F.explode(F.sequence(F.lit(0).cast("bigint"), "last")).alias("other"))
           .filter("block <> other"))
    return met.select(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("list"), "row")


def links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Positions (least of its group, member) of all groups that links of the needed similarity connect."""
    n = len(sets)
    size = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(n), size)
    flat = np.concatenate(sets)
    o = np.argsort(flat, kind="stable")
    sorted_owner, ranked = owner[o], flat[o]
    start = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    length = np.diff(np.append(start, len(flat)))
    group = np.empty(len(flat), np.int64)
    group[o] = np.repeat(np.arange(len(start)), length)
    root = np.arange(n)
    at = np.concatenate([[0], np.cumsum(size)])
    for i in range(1, n):
        g = group[at[i]:at[i + 1]]
        g = g[length[g] > 1]
        if not len(g):
            continue
        reps = length[g]
        inside = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
        both = np.bincount(sorted_owner[np.repeat(start[g], reps) + inside], minlength=n)[:i]
        near = np.flatnonzero(100 * both >= percent * (size[:i] + size[i] - both))
        if len(near):
            joined = np.append(np.unique(root[near]), root[i])
            root[np.isin(root, joined)] = joined.min()
    return [(int(r), i) for i, r in enumerate(root) if r != i]


def _confirm(percent: int):
    def confirm(t: pa.Table) -> pa.Table:
        sets = {r: s for r, s in zip(t["row"].to_pylist(), t["shingles"].to_pylist(), strict=True)}
        rows = sorted(sets)
        found = links([np.frombuffer(sets[r], np.uint64) for r in rows], percent) if len(rows) > 1 else []
        return pa.table({"a": pa.array([rows[i] for i, _ in found], pa.int64()),
                         "b": pa.array([rows[j] for _, j in found], pa.int64())})
    return confirm


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
               percent: int = PERCENT, max_bucket: int = MAX_BUCKET,
               max_shingles: int = MAX_BUCKET_SHINGLES) -> DataFrame:
    """One row per document: ``id, text_hash, n_shingles, component_id, kept``.

    Documents are linked when their shingle sets' Jaccard similarity is at
    least ``percent`` / 100, decided on the full sets; ``component_id`` is the
    least id that links reach.
    """
    rows = written(signatures(docs, id_col, text_col, shingle)
                   .withColumn("row", F.monotonically_increasing_id()), "near-signatures")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    reps = written(rows.filter("set_key IS NOT NULL").groupBy("set_key")
                   .agg(F.min("row").alias("rep"), F.min(order).alias("best")), "near-sets")
    # merge joins throughout: the plan is the same at every size, and Spark splits hot partitions of such joins
    entities = rows.join(reps.select(F.col("rep").alias("row")).hint("merge"), "row", "left_semi").select("row", "n_shingles", "sig")
    found, large = candidate_lists(entities, max_bucket, max_shingles)
    slimmed = slim(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in T.slices(batches, "text"):
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([x.tobytes() for x in shingle_sets(b.column(1), shingle)], pa.binary())],
                ["row", "shingles"])

    def compared(lists: DataFrame) -> DataFrame:
        wanted = (lists.select("row").distinct().join(rows.select("row", "id", "text_hash"), "row")
                  .select("row", F.col("id").alias("wid"), F.col("text_hash").alias("whash")))
        texts = (slimmed.join(wanted.hint("merge"), F.col("id").eqNullSafe(F.col("wid")) & (F.col("text_hash") == F.col("whash")))
                 .select("row", "text"))
        sets = texts.mapInArrow(gather, "row bigint, shingles binary")
        return (lists.join(sets.hint("merge"), "row").groupBy("list")
                .applyInArrow(_confirm(percent), "a bigint, b bigint"))

    edges = compared(written(found, "near-lists"))
    if large is not None:
        edges = written(edges, "near-links")
        rest = written(remaining_lists(large, connected_components(edges), max_bucket, max_shingles), "near-rest")
        edges = edges.unionByName(compared(rest))
    roots = connected_components(edges)
    entity = (reps.join(roots.withColumnRenamed("node", "rep"), "rep", "left")
              .select("set_key", F.coalesce("root", "rep").alias("root"), "best"))
    least = entity.groupBy("root").agg(F.min("best").alias("best"))
    # joined on a key of its own, so that a root with very many sets can be split
    entity = join_on_keys(entity.drop("best"), least, ["root"], "inner").select("set_key", "best")
    out = rows.select("id", "text_hash", "n_shingles", "row", "set_key").join(entity, "set_key", "left")
    alone = F.col("best").isNull()
    return out.select("id", "text_hash", "n_shingles",
                      F.when(alone, F.col("id")).otherwise(F.col("best.id")).alias("component_id"),
                      (alone | (F.col("best.row") == F.col("row"))).alias("kept"))


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                  percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each near-duplicate group, all columns kept.

    Rows repeated with the same id and text count as one.
    """
    key, digest, key2, digest2 = fresh(docs, "key", "hash", "key2", "hash2")
    kept = (near_dedup(docs, id_col, text_col, shingle, percent).filter("kept")
            .select(F.col("id").alias(key2), F.col("text_hash").alias(digest2)))
    out = docs.withColumns({key: F.col(id_col).cast("bigint"), digest: F.xxhash64(F.col(text_col).cast("string"))})
    return (out.join(kept, F.col(key).eqNullSafe(F.col(key2)) & (F.col(digest) == F.col(digest2)), "left_semi")
            .dropDuplicates([key, digest]).drop(key, digest))

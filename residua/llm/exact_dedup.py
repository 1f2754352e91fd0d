"""Exact deduplication with a heavy-hitter split.

Digests that occur often are found with mergeable Misra-Gries summaries,
one per task.  Their exact winners, fewer than ``counters`` rows, are
broadcast and settle the frequent rows map-side.  All other digests go
through one ordinary shuffle, where a group has at most about two of every
``counters`` rows of the table.

Defined results: null text counts as empty; very long texts are hashed whole,
one at a time; null ids rank below all
others; of rows repeated with the same id and text exactly one is kept;
an empty table gives an empty result; extra columns are left behind.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from residua.llm.frames import fresh, slim, written

COUNTERS = 1000


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        text = b.column(b.schema.get_field_index("text")).cast(pa.large_binary())
        hashed = [hashlib.sha256(t.as_py().lower() if t.is_valid else b"").digest() for t in text]
        yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("id")), pa.array(hashed, pa.binary())],
                                         ["id", "digest"])


def misra_gries(batches: Iterator[pa.RecordBatch], counters: int) -> dict[bytes, int]:
    """Summary of one stream: each count is too low by at most rows / (counters + 1)."""
    held: dict[bytes, int] = {}
    for b in batches:
        for x in b.column(b.schema.get_field_index("digest")).value_counts():
            held[k] = held.get(k := x["values"].as_py(), 0) + x["counts"].as_py()
        if len(held) > counters:
            cut = sorted(held.values(), reverse=True)[counters]
            held = {k: v - cut for k, v in held.items() if v > cut}
    return held


def frequent_digests(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Digests that are in more than rows / (counters + 1) rows: all above twice that, ``counters`` at most.

    The summed counters never exceed the true counts, and their total never
    exceeds the number of rows; that bounds how many can pass.
    """
    def summarise(batches):
        held = misra_gries(batches, counters)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()),
                                              pa.array(list(held.values()), pa.int64())], ["digest", "low"])

    low = (digests.select("digest").mapInArrow(summarise, "digest binary, low bigint")
           .groupBy("digest").agg(F.sum("low").alias("low")))
    rows = digests.agg(F.count(F.lit(1)))
    return low.filter(F.col("low") * (counters + 1) > rows.scalar()).select("digest")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                counters: int = COUNTERS) -> DataFrame:
    """One row per input row: ``id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lower-casing A-Z; the row with the
    largest id stays.
    """
    rows = slim(docs, id_col, text_col).mapInArrow(_digests, "id bigint, digest binary")
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "exact-digests")
    best = F.max(F.struct("id", "row"))
    # at most ``counters`` digests of 32 bytes: safe to broadcast at any input size
    heavy = written(frequent_digests(rows, counters), "exact-heavy")
    winners = (rows.join(F.broadcast(heavy), "digest", "left_semi")
               .groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size")))
    often = rows.join(F.broadcast(written(winners, "exact-winners")), "digest")
    same = Window.partitionBy("digest")
    seldom = (rows.join(F.broadcast(heavy), "digest", "left_anti")
              .withColumns({"best": best.over(same), "group_size": F.count(F.lit(1)).over(same)}))
    return often.unionByName(seldom).select(
        "id", F.col("best.id").alias("keep_id"), "group_size",
        (F.col("best.row") == F.col("row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      counters: int = COUNTERS) -> DataFrame:
    """``docs`` without the copies, all columns kept."""
    digest, key, digest2, key2 = fresh(docs, "digest", "key", "digest2", "key2")
    kept = (exact_dedup(docs, id_col, text_col, counters).filter("kept")
            .select(F.col("id").alias(key2), F.unhex("text_sha256").alias(digest2)))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = docs.withColumns({digest: F.unhex(F.sha2(fold(text), 256)), key: F.col(id_col).cast("bigint")})
    out = out.join(kept, F.col(digest).eqNullSafe(F.col(digest2)) & F.col(key).eqNullSafe(F.col(key2)), "left_semi")
    return out.dropDuplicates([digest, key]).drop(digest, key)


def fold(col):
    """Lower-case A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

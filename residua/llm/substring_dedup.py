"""Substring deduplication by relative Lempel-Ziv factors.

Every document is a reference block and every block is indexed: all its
windows of ``window`` words enter an index that is dealt over many small
buckets.  A window's bucket follows from the least four-word hash inside it,
so neighbouring windows share a bucket and travel as runs.  A bucket names,
for each window, the smallest document that holds it and the place there.
Each document is then factored greedily: a factor runs on while the index
keeps pointing along the same diagonal of the same reference, and at every
factor boundary the windows that reach over it have index answers of their
own, so nothing is missed between two factors.  Factors are at least one
window long; the words under them are the duplicate spans.

Within a task, repeats are settled before the shuffle: of a window only its
smallest document is shipped, so a passage that a third of all documents
share costs each bucket one entry a slice.

Windows are compared by 56 bits of a 64-bit hash within a bucket.

Defined results: null text has no words; a very long text is one document of
its slice, all its windows looked up; a null id is smaller than any other;
rows with the same id are no references for each other; of several earlier
documents with a window the smallest is named; an empty table gives an empty
result; extra columns are left behind.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.llm import text as T
from residua.llm.frames import slim

WINDOW = 13
SEED_WORDS = 4
LEAST_ID = -(1 << 63)
_LOW = np.uint64((1 << 56) - 1)
_RUN = np.dtype([("id", "<i8"), ("start", "<i4"), ("n", "<i4"), ("ref_id", "<i8"), ("ref_start", "<i4"),
                 ("check", "<u8")])


def _breaks(*changed: np.ndarray) -> np.ndarray:
    """Where runs begin, given per element whether it differs from the one before."""
    first = np.ones(len(changed[0]) + 1, bool)
    first[1:] = np.logical_or.reduce(changed)
    return np.flatnonzero(first)


def _runs(ids, pos, h, ref_id, ref_pos) -> np.ndarray:
    """Duplicate windows as maximal runs along one diagonal of one reference."""
    if not len(ids):
        return np.empty(0, _RUN)
    o = np.lexsort((pos, ids))
    ids, pos, h, ref_id, ref_pos = ids[o], pos[o], h[o], ref_id[o], ref_pos[o]
    at = _breaks(ids[1:] != ids[:-1], pos[1:] != pos[:-1] + 1, ref_id[1:] != ref_id[:-1],
                 ref_pos[1:] != ref_pos[:-1] + 1)
    out = np.empty(len(at), _RUN)
    out["id"], out["start"], out["n"] = ids[at], pos[at], np.diff(np.append(at, len(ids)))
    out["ref_id"], out["ref_start"], out["check"] = ref_id[at], ref_pos[at], np.add.reduceat(h, at)
    return out


def _references(h: np.ndarray, ids: np.ndarray, pos: np.ndarray):
    """Per element whether a smaller id holds the same window, and the smallest id's first place."""
    n = len(h)
    dup, ref_id, ref_pos = np.zeros(n, bool), np.zeros(n, np.int64), np.zeros(n, np.int64)
    o = np.argsort(h)
    same = h[o][1:] == h[o][:-1]
    many = np.zeros(n, bool)
    many[1:] |= same
    many[:-1] |= same
    sub = o[many]
    if len(sub):
        sub = sub[np.lexsort((pos[sub], ids[sub], h[sub]))]
        at = _breaks(h[sub][1:] != h[sub][:-1])
        lead = np.repeat(sub[at], np.diff(np.append(at, len(sub))))
        ref_id[sub], ref_pos[sub] = ids[lead], pos[lead]
        dup[sub] = ids[sub] > ids[lead]
    return dup, ref_id, ref_pos


def _indexed(batch: pa.RecordBatch, window: int):
    """Hash, bucket seed, document and place of every window of a slice."""
    data, off = T.buffers(batch.column(1))
    _, _, doc, h = T.words(data, off)
    first = np.concatenate([[0], np.cumsum(T.counts(doc, batch.num_rows))])
    w, ok = T.windows(h, doc, window)
    k = min(SEED_WORDS, window)
    seed = T.sliding_min(T.windows(h, doc, k)[0], window - k + 1) if len(w) else w
    at = np.flatnonzero(ok)
    d = doc[at]
    return w[at] & _LOW, seed[at], d, at - first[d]


def index_blocks(rows: DataFrame, window: int, n_buckets: int) -> DataFrame:
    """Windows of all blocks by bucket; rows of kind 1 carry the repeats that a slice settled itself."""
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in T.slices(batches, "text", gather=True):
            ids_of = b.column(0).to_numpy(zero_copy_only=False)
            h, seed, d, pos = _indexed(b, window)
            ids = ids_of[d]
            dup, ref_id, ref_pos = _references(h, ids, pos)
            out: tuple[list, list, list, list] = ([], [], [], [])
            local = _runs(ids[dup], pos[dup], h[dup], ref_id[dup], ref_pos[dup])
            if len(local):
                for held, x in zip(out, (int(local["id"][0]) % n_buckets, 1, local.tobytes(), b""), strict=True):
                    held.append(x)
            ship = np.flatnonzero(~dup)
            bucket = (T.mix(seed[ship]) % np.uint64(n_buckets)).astype(np.int64)
            o = np.argsort(bucket, kind="stable")
            ship, bucket = ship[o], bucket[o]
            if len(ship):
                cut = _breaks(bucket[1:] != bucket[:-1])
                runs = _breaks(bucket[1:] != bucket[:-1], d[ship][1:] != d[ship][:-1],
                               pos[ship][1:] != pos[ship][:-1] + 1)
                length = np.diff(np.append(runs, len(ship))).astype("<i4")
                hashes = h[ship].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7]
                edge = np.append(np.searchsorted(runs, cut), len(runs))
                for i, a in enumerate(cut):
                    r = slice(edge[i], edge[i + 1])
                    z = cut[i + 1] if i + 1 < len(cut) else len(ship)
                    desc = (np.diff(ids[ship[runs[r]]], prepend=np.int64(0)).astype("<i8").tobytes()
                            + pos[ship[runs[r]]].astype("<i4").tobytes() + length[r].tobytes())
                    for held, x in zip(out, (int(bucket[a]), 0, zlib.compress(desc, 1), hashes[a:z].tobytes()),
                                       strict=True):
                        held.append(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary()),
                 pa.array(out[3], pa.binary())], ["bucket", "kind", "runs", "hashes"])

    return rows.mapInArrow(index, "bucket bigint, kind int, runs binary, hashes binary")


def _look_up(t: pa.Table) -> pa.Table:
    """Answer one bucket: the runs of windows that a smaller document holds too."""
    done, ids, pos, h = [], [], [], []
    for kind, runs, hashes in zip(t["kind"].to_pylist(), t["runs"].to_pylist(), t["hashes"].to_pylist(), strict=True):
        if kind:
            done.append(np.frombuffer(runs, _RUN))
            continue
        raw = zlib.decompress(runs)
        n = len(raw) // 16
        run_id = np.cumsum(np.frombuffer(raw, "<i8", n))
        start, length = np.frombuffer(raw, "<i4", n, 8 * n), np.frombuffer(raw, "<i4", n, 12 * n)
        total = int(length.sum())
        inside = np.arange(total) - np.repeat(np.cumsum(length) - length, length)
        ids.append(np.repeat(run_id, length))
        pos.append(np.repeat(start, length).astype(np.int64) + inside)
        wide = np.zeros((total, 8), np.uint8)
        wide[:, :7] = np.frombuffer(hashes, np.uint8).reshape(-1, 7)
        h.append(wide.reshape(-1).view("<u8"))
    if h:
        ids, pos, h = np.concatenate(ids), np.concatenate(pos), np.concatenate(h)
        dup, ref_id, ref_pos = _references(h, ids, pos)
        done.append(_runs(ids[dup], pos[dup], h[dup], ref_id[dup], ref_pos[dup]))
    r = np.concatenate(done) if done else np.empty(0, _RUN)
    return pa.table({k: pa.array(np.ascontiguousarray(r[k]).view(np.int64) if k == "check" else r[k].astype(np.int64))
                     for k in _RUN.names})


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                  n_buckets: int | None = None) -> DataFrame:
    """Runs of windows that a smaller document holds: ``id, start, n, ref_id, ref_start, check``.

    ``n_buckets`` defaults to eight times the session's shuffle partitions.
    """
    n = n_buckets or 8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = index_blocks(_keyed(docs, id_col, text_col), window, n)
    return blocks.groupBy("bucket").applyInArrow(
        _look_up, "id bigint, start bigint, n bigint, ref_id bigint, ref_start bigint, check bigint")


def _keyed(docs, id_col, text_col):
    return slim(docs, id_col, text_col).withColumn("id", F.coalesce("id", F.lit(LEAST_ID))).select("id", "text")


def factors(row, start, n, ref_id, ref_start, window):
    """Greedy factors of sorted runs: each goes on while the next run follows on the same diagonal."""
    if not len(row):
        return (row,) * 5
    at = _breaks(row[1:] != row[:-1], start[1:] != (start + n)[:-1], ref_id[1:] != ref_id[:-1],
                 (ref_start - start)[1:] != (ref_start - start)[:-1])
    last = np.append(at[1:], len(row)) - 1
    return row[at], start[at], (start + n)[last] - start[at] + window - 1, ref_id[at], ref_start[at]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                   n_buckets: int | None = None) -> DataFrame:
    """One row per document: ``id, n_words, n_removed, text, factors``.

    ``text`` has the kept words joined by one space; ``factors`` are
    ``(start, n_words, ref_id, ref_start)`` in words, where ``ref_id`` is the
    smallest document with the factor's windows.
    """
    found = repeated_runs(docs, id_col, text_col, window, n_buckets)
    by_doc = found.groupBy("id").agg(F.collect_list(F.struct("start", "n", "ref_id", "ref_start", "check")).alias("runs"))
    joined = _keyed(docs, id_col, text_col).join(by_doc, "id", "left").select("id", "text", "runs")
    factor = pa.struct([("start", pa.int32()), ("n_words", pa.int32()), ("ref_id", pa.int64()), ("ref_start", pa.int32())])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in T.slices(batches, "text"):
            data, off = T.buffers(b.column(1))
            s, e, doc, h = T.words(data, off)
            size = T.counts(doc, b.num_rows)
            first = np.concatenate([[0], np.cumsum(size)])
            runs = b.column(2)
            per_row = np.diff(runs.offsets.to_numpy()) if len(runs) else np.empty(0, np.int64)
            per_row = np.where(runs.is_valid().to_numpy(zero_copy_only=False), per_row, 0)
            flat = runs.flatten()
            row = np.repeat(np.arange(b.num_rows), per_row)
            start, n, ref_id, ref_start, check = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(5))
            o = np.lexsort((start, row))
            row, start, n, ref_id, ref_start, check = (x[o] for x in (row, start, n, ref_id, ref_start, check))
            w, ok = T.windows(h, doc, window)
            total = np.zeros(len(w) + 1, np.uint64)
            np.cumsum(np.where(ok, w & _LOW, np.uint64(0)), out=total[1:])
            fits = start + n + window - 1 <= size[row]
            a = np.where(fits, first[row] + start, 0)
            z = np.where(fits, a + n, 0)
            # an answer holds for rows of the same id only where the windows are the same
            fits &= (total[z] - total[a]).view(np.int64) == check
            row, start, n, ref_id, ref_start, a, z = (x[fits] for x in (row, start, n, ref_id, ref_start, a, z))
            edge = np.zeros(len(s) + 1, np.int64)
            np.add.at(edge, a, 1)
            np.add.at(edge, z + window - 1, -1)
            gone = np.cumsum(edge[:-1]) > 0
            f = factors(row, start, n, ref_id, ref_start, window)
            listed = pa.ListArray.from_arrays(
                np.concatenate([[0], np.cumsum(np.bincount(f[0], minlength=b.num_rows))]).astype(np.int32),
                pa.StructArray.from_arrays([pa.array(x, k.type) for x, k in zip(f[1:], factor, strict=True)],
                                           fields=list(factor)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(size), pa.array(np.bincount(doc[gone], minlength=b.num_rows).astype(np.int64)),
                 join_words(data, off, s[~gone], e[~gone], doc[~gone]), listed],
                ["id", "n_words", "n_removed", "text", "factors"])

    out = joined.mapInArrow(remove, "id bigint, n_words bigint, n_removed bigint, text string, "
                                    "factors array<struct<start:int,n_words:int,ref_id:bigint,ref_start:int>>")
    return out.withColumn("id", F.when(F.col("id") != LEAST_ID, F.col("id")))


def join_words(data: np.ndarray, off: np.ndarray, s: np.ndarray, e: np.ndarray, doc: np.ndarray) -> pa.Array:
    """The given words of each document joined by one space."""
    cover = np.zeros(len(data) + 1, np.int8)
    cover[s] += 1
    cover[e] -= 1
    mask = np.cumsum(cover[:-1], dtype=np.int8).astype(bool)
    gap = e[:-1][doc[1:] == doc[:-1]]          # white space, as another word follows in the document
    mask[gap] = True
    out = data.copy()
    out[gap] = 0x20
    ends = np.zeros(len(data) + 1, np.int64)
    np.cumsum(mask, out=ends[1:])
    return pa.Array.from_buffers(pa.string(), len(off) - 1, [None, pa.py_buffer(ends[off].astype(np.int32)),
                                                             pa.py_buffer(np.ascontiguousarray(out[mask]))])

"""Scoring documents with a gated recurrent language model learnt here.

Documents are packed into slices of about ``SLICE`` bytes: a dictionary of
the slice's word hashes and the documents as codes into it.  The counts of
all words over all training documents are gathered by dealing the
dictionaries over hash buckets; each bucket answers every slice that asked,
so a word is shipped once a slice however often it occurs, and no task sees
more than its bucket.

The model (:mod:`residua.llm.gru`) has a symbol for each of the most
frequent words, one for each spelling class of all others (by their last two
bytes), and the end mark.  A word of a spelling class then has the add-one
smoothed frequency it has within its class, with one more place for all
unseen words.  So every text has a probability.

Training is data-parallel: a replica a ``REPLICA_TOKENS`` training tokens
(their number depends on the corpus alone) gets the documents that a hash of
id and words deals to it, in a fixed order, and the replicas' parameters are
averaged after every round.  So the model is the same however the rows lie in
files and tasks.  Every training document is learnt from in exactly one of
the ``ROUNDS`` rounds, by a hash of its id.  Averaging goes through a tree of
fixed fan-in, so the driver gets at most ``FAN_IN`` parameter vectors.

Defined results: null text is empty and scores its end mark; a null id
counts as the empty string for the held-out rule; a very long text is one
document of its slice, scored whole with its state carried, one step after
the other; repeated rows are documents of their own; words equally frequent
at the edge of the model's vocabulary go by their hash; an empty table gives
an empty result; extra columns are left behind.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.llm import gru
from residua.llm import text as T
from residua.llm.frames import slim, written

SLICE = 8 << 20
ROUNDS, FAN_IN = 3, 8
STREAM_STEPS = 2_048
REPLICA_TOKENS = 4_000_000            # training tokens for each replica, over all rounds
RARE = 31
TOP = gru.SYMBOLS - RARE - 1
NO_ID = -(1 << 63)

_SLICE_COLUMNS = {"ids": "<i8", "held": "u1", "lengths": "<i8", "codes": "<u4", "hashes": "<u8", "kinds": "u1",
                  "trained": "<u4"}
_SLICE_SCHEMA = "n_train bigint, " + ", ".join(f"{c} binary" for c in _SLICE_COLUMNS)


def is_held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def pack(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Documents as slices of codes; see :data:`_SLICE_COLUMNS`."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in T.slices(batches, "text", SLICE, gather=True):
            ids = b.column(0).to_pylist()
            data, off = T.buffers(b.column(1))
            s, e, doc, h = T.words(data, off, fold=True)
            last = T.LOWER[data[e - 1]].astype(np.uint64)
            before = np.where(e - s > 1, T.LOWER[data[np.maximum(e - 2, 0)]], 0).astype(np.uint64)
            kind = (T.mix(last * np.uint64(256) + before) % np.uint64(RARE)).astype(np.uint8)
            uniq, code = np.unique(h, return_inverse=True)
            kinds = np.zeros(len(uniq), np.uint8)
            kinds[code] = kind
            held = np.array([is_held_out(i) for i in ids], bool)
            lengths = T.counts(doc, b.num_rows)
            known = np.array([NO_ID if i is None else i for i in ids], np.int64)
            out = {"ids": known, "held": held, "lengths": lengths, "codes": code, "hashes": uniq, "kinds": kinds,
                   "trained": np.bincount(code[~held[doc]], minlength=len(uniq))}
            yield pa.RecordBatch.from_arrays(
                [pa.array([int((~held).sum())], pa.int64()),
                 *(pa.array([out[c].astype(t).tobytes()], pa.binary()) for c, t in _SLICE_COLUMNS.items())],
                ["n_train", *_SLICE_COLUMNS])

    return (slim(docs, id_col, text_col).select("id", "text").mapInArrow(encode, _SLICE_SCHEMA)
            .withColumn("slice", F.monotonically_increasing_id()))


def count_words(slices: DataFrame, n_buckets: int) -> DataFrame:
    """Word counts over all slices, by bucket of the hash's high bits.

    Rows with a slice answer it: the counts of its words of one bucket, in
    hash order.  One row per bucket, without a slice, sums the bucket up
    (:func:`summed`).
    """
    shift = np.uint64(64 - (n_buckets.bit_length() - 1))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for row in whole.to_pylist():
                h, c, k = (np.frombuffer(row[x], _SLICE_COLUMNS[x]) for x in ("hashes", "trained", "kinds"))
                bucket = (h >> shift).astype(np.int64)
                edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(h) else [0]
                cuts = [slice(a, z) for a, z in zip(edge[:-1], edge[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(bucket[x.start]) for x in cuts], pa.int64()),
                     pa.array([row["slice"]] * len(cuts), pa.int64()),
                     *(pa.array([v[x].tobytes() for x in cuts], pa.binary()) for v in (h, c, k))],
                    ["bucket", "slice", "hashes", "trained", "kinds"])

    def answer(t: pa.Table) -> pa.Table:
        h, c, k = (np.frombuffer(b"".join(t[x].to_pylist()), _SLICE_COLUMNS[x]) for x in ("hashes", "trained", "kinds"))
        uniq, at, back = np.unique(h, return_index=True, return_inverse=True)
        total = np.bincount(back, c).astype(np.int64)
        sizes = [len(x) // 8 for x in t["hashes"].to_pylist()]
        parts = np.split(total[back], np.cumsum(sizes)[:-1])
        parts = [zlib.compress(p.astype("<i8").tobytes(), 1) for p in parts]
        bucket = t["bucket"][0].as_py()
        return pa.table({"slice": pa.array([*t["slice"].to_pylist(), None], pa.int64()),
                         "bucket": pa.array([bucket] * (len(parts) + 1), pa.int64()),
                         "counts": pa.array([*parts, None], pa.binary()),
                         "summary": pa.array([*[None] * len(parts), summary(uniq, total, k[at])], pa.binary())})

    asked = slices.select("slice", "hashes", "trained", "kinds").mapInArrow(
        ask, "bucket bigint, slice bigint, hashes binary, trained binary, kinds binary")
    return asked.groupBy("bucket").applyInArrow(
        answer, "slice bigint, bucket bigint, counts binary, summary binary")


_WORD = np.dtype([("hash", "<u8"), ("n", "<i8"), ("kind", "u1")])


def summary(hashes: np.ndarray, n: np.ndarray, kind: np.ndarray) -> bytes:
    """Tokens and distinct words per spelling class, and the ``TOP`` most frequent words."""
    sums = np.concatenate([np.bincount(kind, n, minlength=RARE), np.bincount(kind, n > 0, minlength=RARE)])
    return sums.astype("<i8").tobytes() + _most_frequent(hashes, n, kind).tobytes()


def _most_frequent(hashes, n, kind) -> np.ndarray:
    words = np.empty(len(n), _WORD)
    words["hash"], words["n"], words["kind"] = hashes, n, kind
    words = words[words["n"] > 0]
    return words[np.lexsort((words["hash"], -words["n"]))[:TOP]]


def read_summary(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(raw, "<i8", 2 * RARE), np.frombuffer(raw, _WORD, offset=16 * RARE)


def summed(summaries: list[bytes]) -> bytes:
    """One summary of several; their words are disjoint."""
    parts = [read_summary(x) for x in summaries]
    words = np.concatenate([w for _, w in parts])
    return sum(s for s, _ in parts).astype("<i8").tobytes() + _most_frequent(
        words["hash"], words["n"], words["kind"]).tobytes()


def tree(rows: DataFrame, merge, schema: str) -> list:
    """Merge all rows through a tree of fan-in ``FAN_IN``; the driver gets that many rows at most."""
    now = written(rows, "lm-tree")
    n = now.count()
    while n > FAN_IN:
        groups = -(-n // FAN_IN)
        now = written(now.groupBy(F.pmod(F.xxhash64(*now.columns), F.lit(groups)).alias("g"))
                      .applyInArrow(merge, schema), "lm-tree")
        n = now.count()
    return now.collect()


class Vocabulary:
    """Symbols of the model and what is needed to score words beyond them; a table of fixed size."""

    def __init__(self, top: np.ndarray, sums: np.ndarray, ends: int):
        tokens, words = sums[:RARE].copy(), sums[RARE:].copy()
        self.train_tokens = int(tokens.sum()) + ends
        self.distinct = int(words.sum()) + (ends > 0)
        self.ends = ends
        np.subtract.at(tokens, top["kind"], top["n"])
        np.subtract.at(words, top["kind"], 1)
        self.rare_log = np.log(tokens + words + 1.0)
        size = np.concatenate([top["n"], np.zeros(TOP - len(top)), tokens, [ends]]).astype(float)
        place = np.empty(gru.SYMBOLS, np.int64)
        place[np.argsort(-size, kind="stable")] = np.arange(gru.SYMBOLS)
        self.symbol_counts = np.empty(gru.SYMBOLS)
        self.symbol_counts[place] = size
        hashes = top["hash"].astype(np.uint64)
        o = np.argsort(hashes)
        self.top, self.top_symbol = hashes[o], place[:len(top)][o]
        self.rare_symbol, self.end = place[TOP:TOP + RARE], int(place[-1])

    def symbols(self, hashes: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol of each word, and whether it stands for a spelling class."""
        out = self.rare_symbol[kinds]
        if not len(self.top):
            return out, np.ones(len(out), bool)
        at = np.minimum(np.searchsorted(self.top, hashes), len(self.top) - 1)
        hit = self.top[at] == hashes
        return np.where(hit, self.top_symbol[at], out), ~hit


def average(replicas: DataFrame) -> tuple[np.ndarray, float] | None:
    """Weighted mean of parameter vectors, summed in an order of their own."""
    def mean(t: pa.Table) -> pa.Table:
        total, weight = np.zeros(gru.SIZE), 0.0
        for x, k in sorted(zip(t["params"].to_pylist(), t["weight"].to_pylist(), strict=True)):
            total += np.frombuffer(x, "<f4") * k
            weight += k
        return pa.table({"params": pa.array([(total / weight).astype("<f4").tobytes()], pa.binary()),
                         "weight": pa.array([weight])})

    rows = tree(replicas, mean, "params binary, weight double")
    if not rows:
        return None
    out = mean(pa.table({"params": pa.array([bytes(r["params"]) for r in rows], pa.binary()),
                         "weight": pa.array([r["weight"] for r in rows])}))
    return np.frombuffer(out["params"][0].as_py(), "<f4").copy(), out["weight"][0].as_py()


def turns(ids: np.ndarray, held: np.ndarray) -> np.ndarray:
    """The round that learns from each document; ``ROUNDS``, which no round is, for held-out ones."""
    return np.where(held.astype(bool), ROUNDS, T.mix(ids.view(np.uint64) + np.uint64(1)) % np.uint64(ROUNDS))


def _learner(start, vocabulary):
    """Trains one replica from the broadcast parameters on the documents dealt to it, in order."""
    def learn(t: pa.Table) -> pa.Table:
        docs = [np.frombuffer(d, "<u2").astype(np.int64)
                for _, d in sorted(zip(t["id"].to_pylist(), t["symbols"].to_pylist(), strict=True))]
        steps = sum(len(d) + 1 for d in docs)
        # few words: fewer streams side by side, so that there still are steps to learn in
        width = min(max(steps // STREAM_STEPS, 8), gru.STREAMS)
        params, _ = gru.train(start.value, docs, vocabulary.value.end, width=width)
        return pa.table({"params": pa.array([params.astype("<f4").tobytes()], pa.binary()),
                         "weight": pa.array([float(steps)])})
    return learn


def fit(slices: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """Parameters after ``ROUNDS`` rounds of averaged replicas."""
    sc = slices.sparkSession.sparkContext
    flat = gru.initial(vocabulary.symbol_counts)
    texts = slices.select("ids", "held", "lengths", "codes", "hashes", "kinds")
    replicas = max(1, -(-vocabulary.train_tokens // REPLICA_TOKENS))
    words = sc.broadcast(vocabulary)                          # fixed size, as the parameters are

    for turn in range(ROUNDS):
        shared = sc.broadcast(flat)

        def deal(batches: Iterator[pa.RecordBatch], turn=turn) -> Iterator[pa.RecordBatch]:
            v = words.value
            for b in batches:
                for i in range(b.num_rows):                   # slice by slice: a task holds one of them
                    row = b.slice(i, 1).to_pylist()[0]
                    ids, held, lengths, codes, h, k = (np.frombuffer(row[c], _SLICE_COLUMNS[c]) for c in row)
                    ends, symbol = np.cumsum(lengths), v.symbols(h, k)[0].astype("<u2")
                    mine = np.flatnonzero(turns(ids, held) == turn)
                    docs = [symbol[codes[ends[j] - lengths[j]:ends[j]]].tobytes() for j in mine]
                    own = T.mix(ids[mine].view(np.uint64) ^ (np.array([zlib.crc32(d) for d in docs], np.uint64) << np.uint64(20)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array((own % np.uint64(replicas)).astype(np.int64)), pa.array(ids[mine]),
                         pa.array(docs, pa.binary())], ["replica", "id", "symbols"])

        dealt = texts.mapInArrow(deal, "replica bigint, id bigint, symbols binary")
        mean = average(dealt.groupBy("replica").applyInArrow(_learner(shared, words), "params binary, weight double"))
        flat = flat if mean is None else mean[0]
    return flat


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    n_buckets: int | None = None) -> DataFrame:
    """One row per document: ``id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Scores are log10 probabilities of the whole text with its end mark.
    """
    spark = docs.sparkSession
    n = n_buckets or 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    slices = written(pack(docs, id_col, text_col), "lm-slices")
    counts = written(count_words(slices, 1 << (n - 1).bit_length()), "lm-counts")
    def merge(t: pa.Table) -> pa.Table:
        return pa.table({"summary": pa.array([summed(t["summary"].to_pylist())], pa.binary())})

    found = tree(counts.filter("slice IS NULL").select("summary"), merge, "summary binary")
    none = np.empty(0, np.uint8)
    sums, top = read_summary(summed([summary(none, none, none), *(bytes(r["summary"]) for r in found)]))
    vocabulary = Vocabulary(top, sums, slices.agg(F.sum("n_train")).first()[0] or 0)
    shared = spark.sparkContext.broadcast((vocabulary, fit(slices, vocabulary)))

    def score(packed: pa.Table, replies: pa.Table) -> pa.Table:
        v, flat = shared.value
        row = packed.to_pylist()[0]
        ids, held, lengths, codes, h, kinds = (np.frombuffer(row[c], _SLICE_COLUMNS[c]) for c in
                                               ("ids", "held", "lengths", "codes", "hashes", "kinds"))
        found = sorted(zip(replies["bucket"].to_pylist(), replies["counts"].to_pylist(), strict=True))
        c = np.frombuffer(b"".join(zlib.decompress(x) for _, x in found), "<i8")
        symbol, rare = v.symbols(h, kinds)
        whole = math.log10(v.train_tokens + v.distinct + 1)
        base = np.log10(c + 1) - whole
        inside = np.where(rare, np.log(c + 1) - v.rare_log[kinds], 0.0)
        doc = np.repeat(np.arange(len(ids)), lengths)
        sums = [np.bincount(doc, x[codes], minlength=len(ids)) for x in (base, inside, (c > 0).astype(float))]
        model = gru.score(flat, symbol[codes], lengths, v.end)
        return pa.table({
            "id": pa.array(ids, mask=ids == NO_ID), "held_out": pa.array(held.astype(bool)),
            "n_tokens": pa.array(lengths + 1), "n_known": pa.array(sums[2].astype(np.int64) + (v.ends > 0)),
            "train_tokens": pa.array(np.full(len(ids), v.train_tokens)),
            "base_score": pa.array(sums[0] + math.log10(v.ends + 1) - whole),
            "score": pa.array((model + sums[1]) / math.log(10))})

    left = slices.select("slice", "ids", "held", "lengths", "codes", "hashes", "kinds")
    right = counts.filter("slice IS NOT NULL").select("slice", "bucket", "counts")
    return left.groupBy("slice").cogroup(right.groupBy("slice")).applyInArrow(
        score, "id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
               "base_score double, score double")

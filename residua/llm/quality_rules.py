"""Quality rules whose cutoffs are risk-controlled on labelled holdouts.

Every rule rejects a document when a measured ratio is beyond a cutoff.
Cutoffs are chosen per stratum (language) so that the probability of
rejecting a good document is at most ``alpha`` in every stratum at once,
with confidence ``1 - delta``:

1. Labelled good documents are halved by a hash of their id.  One half gives
   a ladder of cutoffs: level j takes, for each rule, the ratio that a share
   ``LADDER[j]`` of the good documents exceeds.  Levels are nested.
2. On the other half, levels are tested from the mildest on.  A level holds
   if the exact binomial probability of seeing so few rejected good
   documents, were the true rate ``alpha``, is at most ``delta`` divided by
   the number of strata (Bonferroni).  The first level that fails ends the
   walk (fixed-sequence testing needs no further correction).
3. The last level that held is used.  Without one, the stratum rejects
   nothing beyond the base rules.

Every language is a stratum of its own, the null one too, so each has the
guarantee for itself.  Cutoffs are a table with one row a language; a language
without labelled good documents has none and rejects nothing beyond the base
rules.

Defined results: null text has no words; a document without words fails the
base rules; very long texts are measured whole, a slice of documents at a
time; labels that are null or contradict each other count as not good; of
texts repeated with one id the one with the least language and counts is
calibrated on; ratios equal to a cutoff pass; an empty table gives an empty
result; extra columns are left behind.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from residua.llm import text as T
from residua.llm.frames import fresh, written
from residua.operators._keys import join_on_keys

ALPHA, DELTA = 0.02, 0.05
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
MEASURED = 2 << 20                     # bytes of text measured at once; the arrays over its words take about ten times that
LADDER = (0.00005, 0.0001, 0.0002, 0.0005, 0.001, 0.002, 0.003, 0.005, 0.0075, 0.01)
BROADCAST_STRATA = 50_000              # larger tables of cutoffs are joined without a hint

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks", "n_capitals")
_FEATURES = StructType([StructField(c, LongType()) for c in COUNTS])


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


_SYMBOL, _MARK = _table(b"#*$%&|<>"), _table(b"!?")
_CAPITAL = _table(bytes(range(65, 91)))
_LETTERISH = ~T.SPACE & ((np.arange(256) & 0xC0) != 0x80)


def _per_doc(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    out = np.zeros(len(off) - 1, np.int64)
    some = np.flatnonzero(np.diff(off))
    if len(some):
        out[some] = np.add.reduceat(flags, off[some], dtype=np.int64)
    return out


def measure(text: pa.Array) -> pa.StructArray:
    """The counts of :data:`COUNTS` for each text."""
    parts: list[list[np.ndarray]] = [[] for _ in COUNTS]
    for b in T.slices(iter([pa.RecordBatch.from_arrays([text], ["text"])]), "text", MEASURED):
        data, off = T.buffers(b.column(0))
        _, _, doc, h = T.words(data, off)
        n_words = T.counts(doc, b.num_rows)
        w, ok = T.windows(h, doc, 3)
        covered = np.zeros(len(h) + 1, np.int64)
        if len(w):
            own = T.mix(w + doc[:len(w)].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))[ok]
            at = np.flatnonzero(ok)[o := np.argsort(own)]
            same = own[o][1:] == own[o][:-1]
            twice = np.zeros(len(at), bool)
            twice[1:] |= same
            twice[:-1] |= same
            np.add.at(covered, at[twice], 1)
            np.add.at(covered, at[twice] + 3, -1)
        repeated = np.bincount(doc[np.cumsum(covered[:-1]) > 0], minlength=b.num_rows)
        raw = data.tobytes()
        lines, copies = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
        for i in np.flatnonzero(n_words):
            solid = [x for x in raw[off[i]:off[i + 1]].split(b"\n") if x.strip()]
            lines[i], copies[i] = len(solid), len(solid) - len(set(solid))
        for held, x in zip(parts, (n_words, _per_doc(_LETTERISH[data], off), _per_doc(_SYMBOL[data], off), copies,
                                   repeated, lines, _per_doc(_MARK[data], off), _per_doc(_CAPITAL[data], off)),
                           strict=True):
            held.append(x)
    return pa.StructArray.from_arrays(
        [pa.array(np.concatenate(p).astype(np.int64) if p else [], pa.int64()) for p in parts], list(COUNTS))


@F.arrow_udf(_FEATURES)
def features(text: pa.Array) -> pa.Array:
    return measure(text)


@F.arrow_udf(_FEATURES)
def features_once(text: pa.Array) -> pa.Array:
    """:func:`features` for filters on the counts: parts of their condition are not pushed down with calls of their own."""
    return measure(text)


features_once = features_once.asNondeterministic()


def base_failed(f: Column) -> Column:
    n = f["n_words"]
    return (n < MIN_WORDS) | (100 * f["n_repeat_words"] > MAX_REPEAT_PERCENT * n)


def ratios(f: Column) -> dict[str, Column]:
    """Rule name -> ratio; a rule rejects ratios above its cutoff."""
    words, chars = F.greatest(f["n_words"], F.lit(1)), F.greatest(f["word_chars"], F.lit(1))
    return {
        "symbols": f["n_symbols"] / words,
        "marks": f["n_marks"] / words,
        "capitals": f["n_capitals"] / chars,
        "copied_lines": f["n_dup_lines"] / F.greatest(f["n_lines"], F.lit(1)),
        "repeated_words": f["n_repeat_words"] / words,
        "long_words": f["word_chars"] / words,
        "short_words": words / chars,
        "long_lines": f["n_words"] / F.greatest(f["n_lines"], F.lit(1)),
    }


RULES = ("symbols", "marks", "capitals", "copied_lines", "repeated_words", "long_words", "short_words", "long_lines")


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Bin(n, p), exact up to rounding; 1 where k is above the mean (no test passes there)."""
    if k >= n * p:
        return 1.0
    i = np.arange(1, k + 1, dtype=float)
    logs = n * math.log1p(-p) + np.concatenate([[0.0], np.cumsum(np.log((n - i + 1) / i) + math.log(p / (1 - p)))])
    top = logs.max()
    return float(math.exp(top) * np.exp(logs - top).sum())


def walk(rejected: list[int], n: int, alpha: float, level_delta: float) -> int:
    """Number of ladder levels that hold; ``rejected[j]`` good holdout documents of ``n`` fall at level j."""
    held = 0
    for k in rejected:
        if n == 0 or binomial_cdf(k, n, alpha) > level_delta:
            break
        held += 1
    return held


def _held(alpha: float):
    """Ladder levels that hold in each stratum, from its rejected holdout documents by level."""
    @F.pandas_udf("int")
    def held(fallen: pd.Series, n: pd.Series, level_delta: pd.Series) -> pd.Series:
        return pd.Series([walk(np.cumsum(f).tolist(), int(k), alpha, d)
                          for f, k, d in zip(fallen, n, level_delta, strict=True)], dtype="int32")
    return held


def calibrate(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA,
              ladder: tuple[float, ...] = LADDER) -> DataFrame:
    """Cutoffs by language: ``lang`` and a ratio for each rule, null where no level held.

    Takes ``measured(id, lang, f)`` and ``labels(doc_id, quality, toxic)``.
    All labelled documents that pass the base rules take part.
    """
    good = (labels.groupBy(F.col("doc_id").cast("bigint").alias("id"))
            .agg(F.min(F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 1).otherwise(0)).alias("g"))
            .filter("g = 1 AND id IS NOT NULL").select("id"))
    one = (measured.filter(~base_failed(F.col("f"))).join(good, "id")
           .groupBy("id").agg(F.min(F.struct("lang", "f")).alias("one")))
    rows = written(one.select("one.lang", (F.pmod(F.xxhash64("id"), F.lit(2)) == 0).alias("fit"),
                              *[x.alias(r) for r, x in ratios(F.col("one.f")).items()]), "quality-rows")
    levels = [1.0 - x for x in ladder]
    cuts = rows.filter("fit").groupBy("lang").agg(
        *[F.percentile_approx(k, levels, 100_000).alias(f"at_{k}") for k in RULES])
    cuts = written(cuts, "quality-ladders")
    # the mildest level that rejects a holdout document
    tried = join_on_keys(rows.filter("NOT fit"), cuts, ["lang"], "inner")
    hit = F.lit(len(ladder))
    for j in reversed(range(len(ladder))):
        beyond = [F.col(k) > F.get(f"at_{k}", F.lit(j)) for k in RULES]
        hit = F.when(reduce(or_, beyond), j).otherwise(hit)
    by_level = [F.count(F.when(F.col("level") == j, 1)).alias(f"l{j}") for j in range(len(ladder))]
    seen = tried.withColumn("level", hit).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), *by_level)
    seen = seen.select("lang", "n", F.array(*[f"l{j}" for j in range(len(ladder))]).alias("fallen"))
    strata = F.greatest(cuts.select(F.count(F.lit(1))).scalar(), F.lit(1))
    held = _held(alpha)(F.col("fallen"), F.col("n"), F.lit(delta) / strata)
    found = join_on_keys(cuts, seen.withColumn("held", held), ["lang"])
    level = F.coalesce("held", F.lit(0)) - 1
    return written(found.select("lang", *[F.when(level >= 0, F.get(f"at_{k}", level)).alias(k) for k in RULES]),
                   "quality-cutoffs")


def kept(rows: DataFrame, cutoffs: DataFrame, lang: str, f: str, out: str) -> DataFrame:
    """``rows`` with ``out``: whether a document passes the base rules and its language's cutoffs."""
    cut, = fresh(rows, "cut")
    table = cutoffs.select(F.col("lang").alias(lang), F.struct(*RULES).alias(cut))
    if cutoffs.count() <= BROADCAST_STRATA:
        table = F.broadcast(table)
    beyond = [F.coalesce(x > F.col(cut)[k], F.lit(False)) for k, x in ratios(F.col(f)).items()]
    good = ~base_failed(F.col(f)) & ~reduce(or_, beyond)
    return join_on_keys(rows, table, [lang]).withColumn(out, good).drop(cut)


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per document: ``id``, the counts, ``base_failed`` and ``kept``.  Texts are read once."""
    measured = written(docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(lang_col).cast("string").alias("lang"),
                                   features(F.col(text_col).cast("string")).alias("f")), "quality-features")
    f = F.col("f")
    judged = kept(measured, calibrate(measured, labels, alpha, delta), "lang", "f", "kept")
    return judged.select("id", *[f[c].alias(c) for c in COUNTS], base_failed(f).alias("base_failed"), "kept")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              lang_col: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """``docs`` without the rejected rows, all columns kept.

    Cutoffs come from one pass over the measured labelled documents; the
    filter then measures each text where it lies, so texts are not shuffled.
    """
    some = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(lang_col).cast("string").alias("lang"),
                       F.col(text_col).cast("string").alias("text"))
    wanted = labels.select(F.col("doc_id").cast("bigint").alias("id")).distinct()
    measured = written(some.join(wanted, "id", "left_semi").select("id", "lang", features("text").alias("f")),
                       "quality-labelled")
    cutoffs = calibrate(measured, labels, alpha, delta)
    f, lang, good = fresh(docs, "f", "lang", "good")
    marked = docs.withColumns({f: features_once(F.col(text_col).cast("string")), lang: F.col(lang_col).cast("string")})
    return kept(marked, cutoffs, lang, f, good).filter(good).select(*docs.columns)

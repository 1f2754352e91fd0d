"""Benchmark decontamination: training texts that quote test items.

Words are runs outside ``\\x00-\\x2F \\x3A-\\x60 \\x7B-\\x7F`` after A-Z is
lower-cased.  Every window of ``n`` consecutive words of a test item is one
n-gram of the test set; an item of fewer words is one n-gram as a whole.  A
document's word is hit if it lies inside any occurrence of an n-gram.

The n-grams form a hash set that is broadcast.  Training texts are scanned at
every ``n // 2``-th word only: each occurrence of an n-gram covers exactly one
of these places with the ``n - n // 2 + 1`` words that follow it, so the set
holds those parts of its n-grams, and a part that is found is verified word
by word against the whole n-gram, where the text still is.  Texts are read
once and never shuffled: what leaves the scan is one row a document and one a
verified hit.  A test set of more than ``broadcast_bytes`` is not broadcast:
then the places are shuffled by their hash, and only the candidates meet
their texts again.

DataFrame functions only.  Defined results: null text has no words, and a
text without words is clean; very long texts are one row of words in one
task, whole; a null id stays null; rows repeated with one id, of the same or
of different texts, are judged one by one; test items repeated with one id
are windowed one by one and count as one item; a null item id counts as the
item named ''; an n-gram in several items counts for all of them; an empty
test set leaves every document clean; an empty table gives an empty result;
extra columns are left behind in :func:`find_leaks`, kept by the removing
functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residua.llm.frames import fresh, written

A_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
INNER = r"0-9A-Za-z\x{80}-\x{10FFFF}"               # what words are made of, before lower-casing
WINDOW = 10
BROADCAST_BYTES = 64 << 20                           # of n-grams; larger test sets are shuffled


def words(text: Column) -> Column:
    """Array of the words of ``text``."""
    folded = F.translate(F.coalesce(text.cast("string"), F.lit("")), A_Z, A_Z.lower())
    return F.array_remove(F.split(folded, rf"[^{INNER}]+"), "")


def _doc_key(id_col: str, text_col: str) -> Column:
    """Equal for rows with the same id and text, whose results are equal too."""
    return F.sha2(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("-")),
                              F.coalesce(F.col(text_col).cast("string"), F.lit(""))), 256)


def test_ngrams(benchmark: DataFrame, n: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``gram array<string>, len, items array<string>, shared``: ``shared`` names the set of items."""
    items = (benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"),
                              words(F.col(text_col)).alias("words")).filter(F.size("words") > 0))
    size = F.size("words")
    starts = F.sequence(F.lit(1), size - F.least(size, F.lit(n)) + 1)
    grams = items.select("item", F.explode(F.transform(starts, lambda i: F.slice("words", i, n))).alias("gram"))
    grams = grams.groupBy("gram").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return grams.select("gram", F.size("gram").alias("len"), "items",
                        F.sha2(F.to_json("items"), 256).alias("shared"))


def _stride(length: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(length / 2).cast("int"))


def _parts(ngrams: DataFrame) -> DataFrame:
    """One row per n-gram and place that a scan may meet it at: the hash of the words there, and their offset."""
    stride = _stride(F.col("len"))
    offsets = ngrams.select("*", F.explode(F.sequence(F.lit(0), stride - 1)).alias("offset"))
    part = F.xxhash64(F.slice("gram", F.col("offset") + 1, F.col("len") - stride + 1))
    return offsets.select(part.alias("part"), "len", "offset", "gram", "shared")


def _places(docs: DataFrame, lengths: list[int]) -> DataFrame:
    """``docs`` once per place: ``len``, ``place`` (0-based word) and ``part``, the hash of the words there.

    Length 0 has one place with part 0 in every document: it carries the document itself.
    """
    stride, size = _stride(F.col("len")), F.size("words")
    held = F.col("len") - stride + 1
    hashes = (F.when(F.col("len") == 0, F.array(F.lit(0).cast("bigint")))
              .when(size >= held, F.transform(F.sequence(F.lit(0), size - held, stride),
                                              lambda p: F.xxhash64(F.slice("words", p + 1, held)))))
    by_length = docs.select("*", F.explode(F.array(F.lit(0), *map(F.lit, lengths))).alias("len"))
    # outer: a plain explode would infer a filter on the hashes and compute them twice
    return (by_length.withColumn("hashes", hashes)
            .select(*docs.columns, "len", F.posexplode_outer("hashes").alias("nth", "part"))
            .withColumn("place", F.col("nth") * stride))


def _verified(found: DataFrame) -> DataFrame:
    """Places with a part of an n-gram whose text has the whole n-gram there."""
    start = F.col("place") - F.col("offset")
    here = F.when(start >= 0, F.slice("words", start + 1, F.greatest(F.col("len"), F.lit(1))))
    return (found.filter((F.col("len") == 0) | (here == F.col("gram")))
            .select("key", "id", F.size("words").alias("n_words"), "len", start.alias("start"), "shared"))


def _hits_broadcast(docs: DataFrame, ngrams: DataFrame, lengths: list[int]) -> DataFrame:
    parts = _parts(ngrams)
    itself = docs.sparkSession.range(1).select(
        F.lit(0).cast("bigint").alias("part"), F.lit(0).alias("len"), F.lit(0).alias("offset"),
        F.lit(None).cast("array<string>").alias("gram"), F.lit(None).cast("string").alias("shared"))
    return _verified(_places(docs, lengths).join(F.broadcast(parts.unionByName(itself)), ["part", "len"]))


def _hits_shuffled(docs: DataFrame, ngrams: DataFrame, lengths: list[int]) -> DataFrame:
    parts = _parts(ngrams)
    places = _places(docs, lengths).filter("len > 0").select("key", "len", "place", "part")
    # nothing is grouped right above or below this join, so a hot part can be split
    near = written(places.join(parts.select("part", "len"), ["part", "len"], "left_semi"), "decon-places").distinct()
    found = (docs.join(near, "key").withColumn("n_words", F.size("words"))
             .join(parts, ["part", "len"]))
    itself = docs.select("key", "id", F.size("words").alias("n_words"), F.lit(0).alias("len"),
                         F.lit(0).alias("start"), F.lit(None).cast("string").alias("shared"))
    return itself.unionByName(_verified(found))


def _leaks(docs: DataFrame, benchmark: DataFrame, n: int, id_col: str, text_col: str,
           broadcast_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Per distinct (id, text) its hits; and the n-grams of the test set."""
    ngrams = written(test_ngrams(benchmark, n), "decon-ngrams")
    total, lengths = ngrams.agg(F.sum(F.length(F.to_json("gram")) + 64) * _stride(F.lit(n)),
                                F.sort_array(F.collect_set("len"))).first()
    # no projection in between, so that words are split once and held beside their hashes
    rows = docs.select(_doc_key(id_col, text_col).alias("key"), F.col(id_col).cast("bigint").alias("id"),
                       words(F.col(text_col)).alias("words"))
    hits = _hits_broadcast if (total or 0) <= broadcast_bytes else _hits_shuffled
    span = F.when(F.col("len") > 0, F.struct("start", "len"))
    return hits(rows, ngrams, lengths or []).groupBy("key").agg(
        F.max("id").alias("id"), F.max("n_words").cast("bigint").alias("n_words"),
        F.sum(F.when(F.col("len") == 0, 1)).alias("rows"),
        F.collect_set(span).alias("spans"), F.collect_set("shared").alias("shared")), ngrams


def _hit_words() -> Column:
    """0-based positions of the words that are hit."""
    return F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(
        s["start"], s["start"] + s["len"] - 1))))


def find_leaks(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, id_col: str = "doc_id",
               text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per document: ``id, n_words, n_hit, items`` (sorted ids of the items it quotes)."""
    leaks, ngrams = _leaks(docs, benchmark, n, id_col, text_col, broadcast_bytes)
    leaks = written(leaks, "decon-leaks")
    shared = ngrams.groupBy("shared").agg(F.first("items").alias("items"))
    quoted = (leaks.select("key", F.explode("shared").alias("shared")).join(shared, "shared")
              .groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")))
    out = leaks.join(quoted, "key", "left").select(
        "id", "n_words", F.size(_hit_words()).cast("bigint").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("rows"))).alias("copy"))
    return out.drop("copy")


def _hit_keys(docs, benchmark, n, id_col, text_col, broadcast_bytes):
    leaks, _ = _leaks(docs, benchmark, n, id_col, text_col, broadcast_bytes)
    return written(leaks.filter(F.size("spans") > 0).select("key", "spans"), "decon-hits")


def remove_documents(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, id_col: str = "doc_id",
                     text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` without those that quote an n-gram of the test set, all columns kept."""
    hit = _hit_keys(docs, benchmark, n, id_col, text_col, broadcast_bytes)
    key, = fresh(docs, "key")
    return (docs.withColumn(key, _doc_key(id_col, text_col))
            .join(hit.select(F.col("key").alias(key)), key, "left_anti").select(*docs.columns))


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, id_col: str = "doc_id",
                 text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` with the words that are hit, and what separates each from the next word, cut from the text."""
    hit = _hit_keys(docs, benchmark, n, id_col, text_col, broadcast_bytes).withColumn("gone", _hit_words())
    key, gone, text, pieces = fresh(docs, "key", "gone", "text", "pieces")
    marked = (docs.withColumn(key, _doc_key(id_col, text_col))
              .join(hit.select(F.col("key").alias(key), F.col("gone").alias(gone)), key, "left"))
    found = F.regexp_extract_all(F.col(text_col), F.lit(rf"[{INNER}]+[^{INNER}]*"), F.lit(0))
    head = F.regexp_extract(F.col(text_col), rf"^[^{INNER}]*", 0)
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(pieces) - 1), F.col(gone)),
                       lambda i: F.get(F.col(pieces), i))
    marked = marked.withColumn(pieces, F.when(F.col(gone).isNotNull(), found))
    marked = marked.withColumn(text, F.when(F.col(gone).isNull(), F.col(text_col))
                               .otherwise(F.concat(head, F.array_join(kept, ""))))
    return marked.select(*[F.col(text).alias(c) if c == text_col else F.col(c) for c in docs.columns])

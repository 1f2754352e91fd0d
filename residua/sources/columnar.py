"""Pretty-printed JSON objects of parallel arrays, read in parallel splits.

The file is cut at its quotes: the text source's separator is ``"``, so any
layout splits, on one line or many, and every piece of text between two
quotes belongs to one split.  Where a piece stands follows from what is before
it: the parity of the quotes (an escaped quote does not count) tells strings
from structure, the brackets in structure give the array, and the commas since
its bracket the element.  One pass counts these for both parities of each
split (a row a split); running over a file's splits gives every split its
start.  A second pass emits ``(array, element, value)``, and a grouping by
element puts the arrays side by side.  A string with an escaped quote at a
split's border is put together from one piece a split.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from residua.session import scratch_path, ship_package
from residua.sources.quoted import MAX_BROADCAST_SPLITS, _runs

_TOKEN = re.compile(r"[\[\]{},:]|[^\s\[\]{},:]+")
_BACKSLASHES = re.compile(r"(?:^|[^\\])(?:\\\\)*\\$")


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.option("lineSep", '"').text(path)
            .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value"))


def _escapes(values: pa.Array) -> np.ndarray:
    """Whether the quote after each piece is escaped: an odd number of backslashes before it."""
    out = pc.ends_with(values, "\\").to_numpy(zero_copy_only=False).copy()
    for i in np.flatnonzero(out):
        out[i] = _BACKSLASHES.search(values[int(i)].as_py()) is not None
    return out


def _split_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per split: quotes that count, whether its last one is escaped, and for either parity the structure."""
    out: dict[tuple, list] = {}
    for whole in batches:
        for run in _runs(whole):
            key = (run.column(0)[0].as_py(), run.column(1)[0].as_py())
            # quotes, last escaped, then per parity: '[', ']', commas in all, commas since the last '[' (or null)
            at = out.setdefault(key, [0, False, 0, 0, 0, None, 0, 0, 0, None])
            values = run.column(2)
            escaped = _escapes(values)
            ends = np.cumsum(~escaped) + at[0]
            parity = (ends - ~escaped) % 2
            for p in (0, 1):
                mine = values.filter(pa.array(parity == p))
                if not len(mine):
                    continue
                opens, closes, commas = (pc.count_substring(mine, c).to_numpy() for c in "[],")
                s = 2 + 4 * p
                last = np.flatnonzero(opens)
                if len(last):
                    i = int(last[-1])
                    at[s + 3] = int(commas[i + 1:].sum()) + mine[i].as_py().rsplit("[", 1)[1].count(",")
                elif at[s + 3] is not None:
                    at[s + 3] += int(commas.sum())
                at[s] += int(opens.sum())
                at[s + 1] += int(closes.sum())
                at[s + 2] += int(commas.sum())
            at[0], at[1] = int(ends[-1]), bool(escaped[-1])
    rows = [(*k, *v) for k, v in out.items()]
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), *(pa.int64(),) * 8)
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], _COUNTS)


_COUNTS = ["file", "block", "quotes", "open_end", *(f"{c}{p}" for p in (0, 1) for c in ("opens", "closes", "commas", "since"))]


def _starts(pieces: DataFrame) -> DataFrame:
    """``file, block``, and where the split begins: ``inside`` a string (``mid``: one of an earlier split),
    brackets before it, commas since the last ``[``, and the split whose string is open (``owner``)."""
    kinds = {"file": "string", "open_end": "boolean"}
    schema = ", ".join(f"{c} {kinds.get(c, 'bigint')}" for c in _COUNTS)
    path = scratch_path(pieces.sparkSession, "columnar-counts")
    pieces.mapInArrow(_split_counts, schema).write.parquet(path)
    x = pieces.sparkSession.read.parquet(path)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)

    def sofar(c):
        return F.coalesce(F.sum(c).over(before), F.lit(0))

    x = x.withColumn("parity", F.pmod(sofar("quotes"), F.lit(2)))
    for c in ("opens", "closes", "commas", "since"):
        # structure is what lies outside strings: the split's pieces of its start's parity
        x = x.withColumn(c, F.when(F.col("parity") == 0, F.col(f"{c}0")).otherwise(F.col(f"{c}1")))
    x = x.withColumns({"opened": sofar("opens"), "closed": sofar("closes"), "passed": sofar("commas")})
    last = F.last(F.when(F.col("since").isNotNull(), F.col("since") - F.col("passed") - F.col("commas")), ignorenulls=True)
    # a split with more quotes than one ends the string that it begins in, and owns the one it leaves open
    owns = F.col("open_end") & ~((F.col("quotes") == 0) & F.coalesce(F.lag("open_end").over(
        Window.partitionBy("file").orderBy("block")), F.lit(False)))
    return x.select(
        "file", "block", (F.col("parity") == 1).alias("inside"),
        F.coalesce(F.lag("open_end").over(Window.partitionBy("file").orderBy("block")), F.lit(False)).alias("mid"),
        "opened", "closed", F.coalesce(last.over(before) + F.col("passed"), F.lit(0)).alias("passed"),
        ((F.col("opened") == F.col("closed")) | (F.col("closes") > 0)).alias("named"),
        F.last(F.when(owns, F.col("block")), ignorenulls=True).over(before).alias("owner"), "open_end")


def text_of(raw: str) -> str:
    return json.loads(f'"{raw}"', strict=False) if "\\" in raw else raw


_FOUND = ["file", "array", "element", "value", "is_key", "owner", "block"]
_KINDS = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.int64())
_SCHEMA = "file string, array bigint, element bigint, value string, is_key boolean, owner bigint, block bigint"


class _Walk:
    """One split, piece by piece.  Emits what lies in it, or (``crossing``) parts of strings that do not."""

    def __init__(self, key, inside, mid, opened, closed, passed, owner, crossing):
        self.file, self.block = key
        self.inside, self.mine, self.owner, self.crossing = inside, not mid, owner, crossing
        self.opened, self.in_array, self.element = opened, opened > closed, passed
        self.held: list[str] = []
        self.out: list[tuple] = []

    def bad(self, what: str):
        return ValueError(f"{self.file} is no object of parallel arrays of scalars: {what}")

    def emit(self, value, raw: bool) -> None:
        if raw:                                     # a part of a string
            place = (self.opened - 1 if self.in_array else self.opened, self.element) if self.mine else (None, None)
            self.out.append((self.file, *place, value, not self.in_array if self.mine else None,
                             self.block if self.mine else self.owner, self.block))
        elif self.in_array:
            self.out.append((self.file, self.opened - 1, self.element, value, False, None, None))
        else:
            self.out.append((self.file, self.opened, None, value, True, None, None))

    def string(self, piece: str, escaped: bool) -> None:
        self.held.append(piece)
        if not escaped:
            if self.mine and not self.crossing:
                self.emit(text_of('"'.join(self.held)), False)
            elif not self.mine and self.crossing:
                self.emit('"'.join(self.held), True)
            self.held, self.mine, self.inside = [], True, False

    def structure(self, piece: str) -> None:
        self.inside, named = True, False
        for token in _TOKEN.findall(piece):
            named = token == ":"
            if token == ",":
                self.element += self.in_array
            elif token == "[":
                if self.in_array:
                    raise self.bad("an array in an array")
                self.in_array, self.element, self.opened = True, 0, self.opened + 1
            elif token == "]":
                self.in_array = False
            elif token in "{}:":
                if self.in_array:
                    raise self.bad("an object in an array")
                if token == "{" and self.opened:
                    raise self.bad("more than one object")
            elif not self.in_array:
                raise self.bad(f"{token[:40]!r} outside an array")
            elif not self.crossing:
                self.emit(None if token == "null" else token, False)
        if named:
            raise self.bad("a text instead of an array")

    def border(self) -> None:
        if self.held and self.crossing:
            self.emit('"'.join(self.held), True)


def _walker(crossing: bool):
    def batch(walk: _Walk) -> pa.RecordBatch:
        rows, walk.out = walk.out, []
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_KINDS)], _FOUND)

    def run_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = None
        for whole in batches:
            for run in _runs(whole):
                key = (run.column(0)[0].as_py(), run.column(1)[0].as_py())
                if walk is None or key != (walk.file, walk.block):
                    if walk is not None:
                        walk.border()
                        yield batch(walk)
                    walk = _Walk(key, *(run.column(i)[0].as_py() for i in range(3, 9)), crossing)
                for piece, escaped in zip(run.column(2).to_pylist(), _escapes(run.column(2)).tolist(), strict=True):
                    if walk.inside:
                        walk.string(piece, escaped)
                    else:
                        walk.structure(piece)
                yield batch(walk)
        if walk is not None:
            walk.border()
            yield batch(walk)
    return run_all


def _whole_strings(parts: DataFrame) -> DataFrame:
    """Strings from their parts, one a split."""
    @F.pandas_udf("string")
    def plain(raw):
        return raw.map(text_of)

    g = parts.groupBy("file", "owner").agg(
        F.max("array").alias("array"), F.max("element").alias("element"), F.max("is_key").alias("is_key"),
        F.sort_array(F.collect_list(F.struct("block", "value"))).alias("all"))
    raw = F.array_join(F.transform("all", lambda p: p["value"]), '"')
    return g.select("file", "array", F.when(~F.col("is_key"), F.col("element")).alias("element"), plain(raw).alias("value"), "is_key")


def read_columns(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """``source_file, element`` (place in the arrays) and one string column a field; unequal arrays fail."""
    ship_package(spark)
    pieces = _pieces(spark, path)
    at = scratch_path(spark, "columnar-starts")
    _starts(pieces).write.parquet(at)
    starts = spark.read.parquet(at)
    n, crossing = starts.agg(F.count(F.lit(1)), F.max("open_end")).first()

    def placed(which: DataFrame, how: str = "left") -> DataFrame:
        which = which.drop("open_end", "named")
        if n <= MAX_BROADCAST_SPLITS:               # the scan's order of pieces stays
            out = pieces.join(F.broadcast(which), ["file", "block"], how)
        else:
            out = (pieces.withColumn("nth", F.monotonically_increasing_id()).join(which, ["file", "block"], how)
                   .repartition("file", "block").sortWithinPartitions("file", "block", "nth"))
        same = F.coalesce("inside", F.raise_error(F.lit("the files or their splits changed while they were read")))
        return out.select("file", "block", "value", same.cast("boolean").alias("inside"), "mid", "opened", "closed",
                          "passed", "owner")

    def walked(which: DataFrame, how: str, crosses: bool) -> DataFrame:
        found = placed(which, how).mapInArrow(_walker(crosses), _SCHEMA)
        return _whole_strings(found) if crosses else found.select("file", "array", "element", "value", "is_key")

    found, named = walked(starts, "left", False), walked(starts.filter("named"), "inner", False)
    if crossing:
        pieced = walked(starts.filter("mid OR open_end"), "inner", True)
        found, named = found.union(pieced), named.union(pieced)
    # names stand outside the arrays: a handful of rows from the few splits that have such places
    names = named.filter("is_key").groupBy("file").agg(F.map_from_entries(F.collect_list(
        F.struct("array", F.col("value").alias("name")))).alias("names"))
    values = found.filter("NOT is_key").join(names, "file").withColumn("name", F.col("names")[F.col("array")])
    wide = values.filter(F.col("name").isin(fields)).groupBy("file", "element").agg(
        F.count(F.lit(1)).alias("n"), *[F.max(F.when(F.col("name") == f, F.col("value"))).alias(f) for f in fields])
    whole = F.when(F.col("n") == len(fields), F.col("element")).otherwise(
        F.raise_error(F.lit("columnar JSON arrays have unequal sizes")))
    return wide.select(F.col("file").alias("source_file"), whole.cast("bigint").alias("element"), *fields)

"""Quoted tab-separated records, read in parallel splits.

A quoted cell may hold tabs, newlines and doubled quotes, so whether a line
begins a record depends on everything before it in its file.  A line is a
function of one bit, "begins inside a quoted cell", and functions compose.
One pass finds each split's function (a row a split); running over a file's
splits gives the bit that each begins with.  A second pass walks every split
with its bit and emits its records.  Only a record that crosses the border of
a split is put together afterwards, from one piece a split.

A quote opens a cell only where the cell begins; elsewhere in an unquoted
cell it is a letter, as in ``5" disk``.  What follows a closing quote up to
the next tab belongs to the cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from residua.session import scratch_path, ship_package

#: bytes of lines that are cut into cells at a time, whatever the size of an Arrow batch
PART_BYTES = 4 << 20
#: more splits than this are not broadcast: lines are then shuffled to their split and sorted
MAX_BROADCAST_SPLITS = 200_000


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a quoted cell is open at the end of ``line``, which begins inside one or at a cell's start."""
    at = 0
    if not inside and line.startswith('"'):
        inside, at = True, 1
    while True:
        if not inside:
            at = line.find('\t"', at)
            if at < 0:
                return False
            at += 2
        at = line.find('"', at)
        while at >= 0 and line.startswith('"', at + 1):
            at = line.find('"', at + 2)
        if at < 0:
            return True
        inside, at = False, at + 1


def cells(record: str) -> list[str | None]:
    """Values of a record; an unquoted cell with nothing in it is null."""
    record = record.removesuffix("\r")
    out: list[str | None] = []
    at = 0
    while True:
        if record.startswith('"', at):
            parts, at = [], at + 1
            while True:
                to = record.find('"', at)
                if to < 0:
                    raise ValueError(f"quote not closed: {record[:80]!r}")
                parts.append(record[at:to])
                at = to + 1
                if not record.startswith('"', at):
                    break
                parts.append('"')
                at += 1
            tab = record.find("\t", at)
            out.append("".join(parts) + (record[at:] if tab < 0 else record[at:tab]))
        else:
            tab = record.find("\t", at)
            out.append((record[at:] if tab < 0 else record[at:tab]) or None)
        if tab < 0:
            return out
        at = tab + 1


def _runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Cut a batch where its first two columns (file, block) change."""
    n = batch.num_rows
    if n == 0:
        return
    changed = pc.or_(pc.not_equal(batch.column(0).slice(1), batch.column(0).slice(0, n - 1)),
                     pc.not_equal(batch.column(1).slice(1), batch.column(1).slice(0, n - 1)))
    cuts = [0, *(i + 1 for i in pc.indices_nonzero(changed).to_pylist()), n]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.option("lineSep", "\n").text(path)
            .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value"))


def _split_functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per split: the bit at its end from either bit at its start, and whether a record begins in it from the bit 1."""
    key, out, inside, begins = None, [], [False, True], False

    def done():
        out.append((*key, *inside, begins))

    for whole in batches:
        for run in _runs(whole):
            here = (run.column(0)[0].as_py(), run.column(1)[0].as_py())
            if here != key:
                if key is not None:
                    done()
                key, inside, begins = here, [False, True], False
            lines = run.column(2)
            quoted = pc.indices_nonzero(pc.match_substring(lines, '"')).to_pylist()
            begins |= not inside[1]
            for i in quoted:
                line = lines[i].as_py()
                inside = [ends_inside(line, bit) for bit in inside]
                begins |= not inside[1] and i + 1 < run.num_rows
    if key is not None:
        done()
    kinds = (pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_())
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)],
                                     ["file", "block", "from0", "from1", "begins1"])


def _splits(lines: DataFrame) -> DataFrame:
    """``file, block, inside, ends, owner``: the bit at a split's start and end, and the last earlier split
    where a record begins."""
    found = lines.mapInArrow(_split_functions, "file string, block bigint, from0 boolean, from1 boolean, begins1 boolean")
    path = scratch_path(lines.sparkSession, "tsv-functions")
    found.write.parquet(path)
    found = lines.sparkSession.read.parquet(path)
    upto = Window.partitionBy("file").orderBy("block")
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    # a split either sets the bit, or keeps or flips it: the last one that sets it, and the flips since, decide
    fixed = F.col("from0") == F.col("from1")
    flips = F.sum((~fixed & F.col("from0")).cast("bigint")).over(upto)
    found = found.withColumn("flips", flips)
    last = F.last(F.when(fixed, F.struct("from0", "flips")), ignorenulls=True).over(before)
    found = found.withColumns({"last": last, "sofar": F.coalesce(F.max("flips").over(before), F.lit(0))})
    since = F.col("sofar") - F.coalesce(F.col("last.flips"), F.lit(0))
    start = F.coalesce(F.col("last.from0"), F.lit(False)).cast("bigint")
    found = found.withColumn("inside", F.pmod(start + since, F.lit(2)) == 1)
    starts = ~F.col("inside") | F.col("begins1")
    return found.select("file", "block", "inside", F.when(F.col("inside"), F.col("from1")).otherwise(F.col("from0")).alias("ends"),
                        F.last(F.when(starts, F.col("block")), ignorenulls=True).over(before).alias("owner"))


_RECORDS = "cells array<string>, head boolean, file string, owner bigint, block bigint, piece string"
_NAMES = ["cells", "head", "file", "owner", "block", "piece"]
_CELLS = pa.list_(pa.string())


def _parts(lines: pa.Array) -> Iterator[pa.Array]:
    """Cut lines so that a part holds ``PART_BYTES`` at most, or one line."""
    upto = np.cumsum(pc.binary_length(lines).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(lines):
        to = max(at + 1, int(np.searchsorted(upto, (int(upto[at - 1]) if at else 0) + PART_BYTES, side="right")))
        yield lines.slice(at, to - at)
        at = to


def _plain(lines: pa.Array) -> pa.Array:
    """Cells of lines without quotes."""
    if pc.any(pc.ends_with(lines, "\r")).as_py():
        lines = pc.replace_substring_regex(lines, "\r$", "")
    split = pc.split_pattern(lines, "\t")
    values = split.flatten()
    values = pc.if_else(pc.equal(values, ""), pa.scalar(None, pa.string()), values)
    return pa.ListArray.from_arrays(split.offsets if split.offset == 0 else
                                    pc.subtract(split.offsets, split.offsets[0]), values)


def _walker(pieces: bool):
    """Emits the records that lie in one split, or (``pieces``) those parts of records that do not."""
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, inside, owner, held, mine, first = None, False, None, [], True, False
        rows: list[tuple] = []                     # cells, head, file, owner, block, piece
        plain: list[pa.Array] = []
        size = 0                                   # characters in rows
        heads = 0                                  # 1: the first plain line is its file's first record

        def border():
            if held and pieces:
                rows.append((None, first and mine, key[0], key[1] if mine else owner, key[1], "\n".join(held)))

        def flush():
            nonlocal rows, plain, heads, size
            for lines in (part for held_lines in plain for part in _parts(held_lines)) if not pieces else ():
                n = len(lines)
                blank = pc.or_(pc.equal(pc.binary_length(lines), 0), pc.match_substring_regex(lines, r"^\r+$"))
                head = pa.array([i < heads for i in range(min(n, 1))] + [False] * (n - 1), pa.bool_())
                heads = 0
                none = [pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string())]
                found = pa.RecordBatch.from_arrays([_plain(lines), head, *none], _NAMES)
                yield found.filter(pc.invert(blank)) if pc.any(blank).as_py() else found
            if rows:
                kinds = (_CELLS, pa.bool_(), pa.string(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)],
                                                 _NAMES)
            rows, plain, heads, size = [], [], 0, 0

        for whole in batches:
            for run in _runs(whole):
                here = (run.column(0)[0].as_py(), run.column(1)[0].as_py())
                if here != key:
                    if key is not None:
                        border()
                    yield from flush()             # a split's first plain line comes first in its batch
                    key, inside, owner = here, run.column(3)[0].as_py(), run.column(4)[0].as_py()
                    held, mine, first = [], not inside, here[1] == 0
                lines, at = run.column(2), 0
                for i in [*pc.indices_nonzero(pc.match_substring(lines, '"')).to_pylist(), run.num_rows]:
                    if i > at:                     # lines without a quote
                        if inside:
                            held += lines.slice(at, i - at).to_pylist()
                        else:
                            if first and not plain:
                                heads, first = 1, False
                            plain.append(lines.slice(at, i - at))
                    if i == run.num_rows:
                        break
                    line, at = lines[i].as_py(), i + 1
                    if not inside:
                        held, mine = [], True
                    held.append(line)
                    inside = ends_inside(line, inside)
                    if not inside:
                        if not mine:
                            border()
                        elif not pieces:
                            rows.append((cells("\n".join(held)), first, None, None, None, None))
                        if mine:
                            first = False
                            size += sum(map(len, held))
                        held, mine = [], True
                        if size > PART_BYTES:
                            yield from flush()
            yield from flush()
        if key is not None:
            border()
        yield from flush()
    return walk


def _joined(pieces: DataFrame) -> DataFrame:
    """Records from their pieces, one a split."""
    def parse(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([cells(r) for r in b.column(0).to_pylist()], _CELLS), b.column(1)],
                                             ["cells", "head"])
    whole = pieces.groupBy("file", "owner").agg(F.sort_array(F.collect_list(F.struct("block", "piece"))).alias("all"),
                                                F.max("head").alias("head"))
    text = F.array_join(F.transform("all", lambda p: p["piece"]), "\n")
    return whole.select(text.alias("record"), "head").mapInArrow(parse, "cells array<string>, head boolean")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``cells array<string>, head boolean``: every record of the files, ``head`` marks each file's first."""
    ship_package(spark)
    lines = _lines(spark, path)
    at = scratch_path(spark, "tsv-splits")
    _splits(lines).write.parquet(at)
    splits = spark.read.parquet(at)
    n, crossing = splits.agg(F.count(F.lit(1)), F.max(F.col("inside") | F.col("ends"))).first()

    def placed(which: DataFrame, how: str = "left") -> DataFrame:
        which = which.select("file", "block", "inside", "owner")
        if n <= MAX_BROADCAST_SPLITS:              # the scan's order of lines stays
            out = lines.join(F.broadcast(which), ["file", "block"], how)
        else:
            numbered = lines.withColumn("nth", F.monotonically_increasing_id())
            out = (numbered.join(which, ["file", "block"], how).repartition("file", "block")
                   .sortWithinPartitions("file", "block", "nth"))
        same = F.coalesce("inside", F.raise_error(F.lit("the files or their splits changed while they were read")))
        return out.select("file", "block", "value", same.cast("boolean").alias("inside"), "owner")

    found = placed(splits).mapInArrow(_walker(False), _RECORDS).select("cells", "head")
    if crossing:
        pieces = placed(splits.filter("inside OR ends"), "inner").mapInArrow(_walker(True), _RECORDS)
        found = found.union(_joined(pieces))
    return found

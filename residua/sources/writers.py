"""Sinks K1-K3, FASTA/TSV export and the completion log.

Nothing here gathers a table into one row or one task: columnar and log
exports are cut into objects of at most ``chunk_rows`` items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.operators.ranking import rank_within
from residua.session import scratch_path


def write_json_rows(df: DataFrame, path: str, mode: str = "overwrite", partition_by=None) -> None:
    """K1 (row form) / K2 / K3: JSON Lines, one file per task."""
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.json(path)


def write_columnar_json(df: DataFrame, path: str, fields=("prompt", "completion"),
                        key: str = "row_id", chunk_rows: int = 1_000, chunk_bytes: int = 64 << 20,
                        mode: str = "overwrite") -> None:
    """K1 (columnar form): objects of parallel arrays, bounded in rows and bytes.

    Rows are staged as Parquet, so that they are computed once and only their
    keys and sizes are read for the borders of slices.  They are numbered in
    key order by the sliced ranking (slices bounded in bytes), with a running
    sum of their bytes, and cut into chunks; each chunk becomes one JSON object
    (one line) holding ``row_id`` plus one array per field.  A chunk has at
    most ``chunk_rows`` rows and ``chunk_bytes`` bytes of text; a row that
    crosses a multiple of ``chunk_bytes`` is an object of its own, so only a
    single row can be larger.
    """
    if chunk_rows < 1 or chunk_bytes < 1:
        raise ValueError("chunk_rows and chunk_bytes must be at least 1")
    fields = list(fields)
    size = sum((F.coalesce(F.octet_length(F.col(f).cast("string")), F.lit(0)) for f in fields), F.lit(0))
    spark, stage = df.sparkSession, scratch_path(df.sparkSession, "columnar-rows")
    x = df.select(key, *fields).withColumn("__cj_size", size.cast("bigint"))
    # Parquet has no type for a column that is null throughout
    x.withColumns({c: F.col(c).cast("string") for c, kind in x.dtypes if kind == "void"}).write.parquet(stage)
    size = F.col("__cj_size")
    x = rank_within(spark.read.parquet(stage), [], [key], "__cj_pos", running={"__cj_end": size}, weight=size)
    first, last = F.col("__cj_end") - size, F.greatest(F.col("__cj_end") - 1, F.col("__cj_end") - size)
    limit = F.lit(chunk_bytes)
    x = x.withColumn("__cj_chunk", F.struct(
        F.floor((F.col("__cj_pos") - 1) / F.lit(chunk_rows)).alias("rows"), F.floor(last / limit).alias("bytes"),
        F.when(F.floor(first / limit) < F.floor(last / limit), F.col("__cj_pos")).alias("alone")))
    g = x.groupBy("__cj_chunk").agg(
        F.sort_array(F.collect_list(F.struct("__cj_pos", key, *fields))).alias("__rows"))
    out = g.select(F.transform("__rows", lambda r: r[key]).alias("row_id"),
                   *[_field_of("__rows", f).alias(f) for f in fields])
    out.write.mode(mode).json(path)


def _field_of(arr: str, field: str):
    return F.transform(arr, lambda r: r[field])


def write_fasta(df: DataFrame, path: str, entry: str = "entry", seq: str = "sequence",
                width: int = 60, mode: str = "overwrite") -> None:
    """FASTA export (the S4 format): header line, sequence wrapped at ``width``."""
    wrapped = F.regexp_replace(F.col(seq), f"(.{{{width}}})(?!$)", "$1\n")
    rec = F.concat(F.lit(">"), F.col(entry).cast("string"), F.lit("\n"), wrapped)
    df.select(rec.alias("value")).write.mode(mode).option("lineSep", "\n").text(path)


def write_tsv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """TSV export with header (the S1 format).

    Blanks around values are kept; values with tabs, newlines or quotes are
    quoted, their quotes doubled; an empty string is written as ``""`` and a
    null as nothing, so all come back as they were.  (A row of one column
    that is null is a blank line, which readers skip.)
    """
    (df.write.mode(mode).option("sep", "\t").option("header", True)
     .option("quote", '"').option("escape", '"').option("lineSep", "\n")
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .option("emptyValue", '""').option("nullValue", "").csv(path))


def append_completion_log(df: DataFrame, path: str, partition_by=("run", "step"), replace: bool = False) -> None:
    """Add completions with their rewards to the log, partitioned for pruning.

    ``replace=True``: a call brings whole steps.  They are staged beside the
    log and take their places when the job commits; a step that the log
    already has (a repeat after a failure) is replaced, all others stay.
    ``False`` adds the rows to whatever is there.  The ``rebalance`` hint
    lets AQE cluster rows by the partition columns (few files per partition)
    while splitting a hot run/step across tasks.
    """
    out = df.hint("rebalance", *partition_by).write.partitionBy(*partition_by)
    if replace:
        out.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    else:
        out.mode("append").parquet(path)


def write_trainer_logs(entries: DataFrame, path: str, run: str = "run", step: str = "step",
                       chunk_entries: int = 10_000, mode: str = "overwrite", tie: str = "entry_no") -> None:
    """Trainer-log export: ``{run, part, log_history: [entries by step]}`` objects.

    Entries that share a step (a training and an evaluation entry, say)
    are ordered by ``tie``, if there is such a column.

    A long run is cut into parts of ``chunk_entries`` entries so no
    object (and no task) holds an unbounded run.
    """
    cols = [c for c in entries.columns if c != run]
    order = [step, tie] if tie in entries.columns else [step]
    x = rank_within(entries, [run], order, "__lg_pos")
    x = x.withColumn("part", F.floor((F.col("__lg_pos") - 1) / F.lit(chunk_entries)).cast("bigint"))
    g = x.groupBy(run, "part").agg(
        F.sort_array(F.collect_list(F.struct("__lg_pos", *cols))).alias("__e"))
    out = g.select(run, "part", F.transform("__e", lambda e: F.struct(*[e[c].alias(c) for c in cols]))
                   .alias("log_history"))
    out.write.mode(mode).json(path)

"""Sources S1-S6.  All lazy, splittable where the format allows."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from residua.sources.columnar import read_columns as read_columns_of_files
from residua.sources.quoted import read_records


def read_tsv(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Tab-separated text with a header, quoted as ``pandas.read_csv`` reads it.

    Quoted cells may hold tabs, newlines and doubled quotes; large files are
    read in parallel splits all the same (:mod:`residua.sources.quoted`; one
    pass over the files runs at once).  A cell with nothing in it is null, a
    quoted empty one is the empty string; blank lines are skipped, short
    records are filled with nulls, longer ones than the header (or schema)
    fail, and so does a quote that is never closed.  Records end with a
    newline, with or without a carriage return before it.

    ``schema`` names and types the columns by position; a value that does
    not fit its type is null.  Without it every column is a string, named by
    the header.  Every file has a header.
    """
    records = read_records(spark, path)
    if schema is None:
        head = records.filter("head").select("cells").first()
        schema = StructType([StructField((c or f"_c{i}").removeprefix("\ufeff"), StringType())
                             for i, c in enumerate(head[0] if head else [])])
    elif isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    n = len(schema.fields)
    found = F.when(F.size("cells") <= n, F.col("cells")).otherwise(
        F.raise_error(F.concat(F.lit(f"{n} columns, but a record of "), F.size("cells").cast("string"))))
    rows = records.filter("NOT head").select(found.alias("cells"))
    return rows.select(*[F.get("cells", F.lit(i)).try_cast(f.dataType).alias(f.name) for i, f in enumerate(schema.fields)])


def read_columns(spark: SparkSession, path: str, columns=("ogt", "taxid", "sequence")) -> DataFrame:
    """Parquet, only the named columns (pruned at the scan)."""
    return spark.read.parquet(path).select(*columns)


def read_parquet_shards(spark: SparkSession, path: str) -> DataFrame:
    """S3: a parquet file, a folder, or a ``train-*-of-*.parquet`` glob."""
    return spark.read.parquet(path)


def _fasta_records(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.option("lineSep", "\n>").text(path)
            .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")))


def read_fasta(spark: SparkSession, path: str, check: bool = False) -> DataFrame:
    """FASTA -> ``entry, sequence``.

    Records are split on ``"\\n>"`` by the text source, so large files
    are read in parallel splits.  Only a file's first record keeps its
    ``>``; a title that begins with another one keeps that.  ``entry`` is
    the first word of the header (empty for an empty title); ``sequence``
    is the rest with all whitespace (and ``\\r``) removed.  Every record is
    kept.  ``check`` runs a job first that fails on files whose first record
    does not begin with ``>``.
    """
    if check:
        check_fasta(spark, path)
    raw = _fasta_records(spark, path)
    # Records with a '>' in the first split of a file: the file's first one, and rarely odd titles.
    marked = F.col("value").startswith(">") & (F.col("block") == 0)
    turn = Window.partitionBy("file").orderBy("nth")
    heads = raw.filter(marked).withColumn("nth", F.monotonically_increasing_id())
    heads = heads.withColumn("value", F.when(F.row_number().over(turn) == 1, F.substring("value", 2, 2147483647))
                             .otherwise(F.col("value")))
    raw = raw.filter(~marked).select("value").union(heads.select("value"))
    body = F.col("value")
    nl = F.instr(body, "\n")
    header = F.when(nl > 0, F.left(body, nl - 1)).otherwise(body)
    rest = F.when(nl > 0, F.substr(body, nl + 1, F.lit(2147483647))).otherwise(F.lit(""))
    return raw.select(
        F.regexp_extract(header, r"^\s*(\S*)", 1).alias("entry"),
        F.regexp_replace(rest, r"\s", "").alias("sequence"),
    )


def check_fasta(spark: SparkSession, path: str) -> None:
    """``ValueError`` for files with text before their first ``>``.

    The first record of a file is the first one of its split that starts at
    byte 0; of the other records only flags are read.  The driver gets one
    name at most.
    """
    def first_flags(batches):
        key = None
        for b in batches:
            for file, block, ok in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (file, block) != key:
                    key = (file, block)
                    if not ok:
                        yield pa.RecordBatch.from_arrays([pa.array([file])], ["file"])

    flags = _fasta_records(spark, path).filter("block = 0").select("file", "block", F.startswith("value", F.lit(">")))
    bad = flags.mapInArrow(first_flags, "file string").first()
    if bad is not None:
        raise ValueError(f"text before the first '>' in {bad['file']}")


def columnar_schema(fields=("prompt", "completion"), with_row_id: bool = False) -> StructType:
    cols = [StructField(f, ArrayType(StringType())) for f in fields]
    if with_row_id:
        cols.insert(0, StructField("row_id", ArrayType(LongType())))
    return StructType(cols)


def read_columnar_json(spark: SparkSession, path: str, fields=("prompt", "completion"),
                       multi_line: bool = True, with_row_id: bool = False) -> DataFrame:
    """JSON objects of parallel arrays -> one row per position.

    ``multi_line=True`` reads files that are one object of any layout, in
    parallel splits (:mod:`residua.sources.columnar`; one pass over the files
    runs at once): values are strings, other scalars or null, and top-level
    values that are no arrays fail.  Exports of :func:`write_columnar_json`
    are one object per line and read with ``multi_line=False``.
    Arrays of unequal size fail the job (``arrays_zip`` would pad with
    null).  ``row_id`` is the stored id array when present, else the
    position inside the object.
    """
    fields = list(fields)
    if multi_line:
        found = read_columns_of_files(spark, path, (["row_id"] if with_row_id else []) + fields)
        return found.select(F.col("row_id").cast("bigint").alias("row_id") if with_row_id
                            else F.col("element").alias("row_id"), *fields, "source_file")
    df = spark.read.schema(columnar_schema(fields, with_row_id)).json(path)
    sizes = [F.size(f) for f in fields]
    same = sizes[0].isNotNull()
    for s in sizes[1:]:
        same = same & (s == sizes[0])
    # The check wraps the first array, so it stays on the data path
    # (an unused check column would be pruned away).
    first = F.when(same, F.col(fields[0])).otherwise(
        F.raise_error(F.lit("columnar JSON arrays have unequal sizes")))
    arrays = ([F.col("row_id")] if with_row_id else []) + [first.alias(fields[0])] + [F.col(f) for f in fields[1:]]
    ex = df.select(F.input_file_name().alias("source_file"),
                        F.posexplode(F.arrays_zip(*arrays)).alias("pos", "rec"))
    rid = F.col("rec.row_id") if with_row_id else F.col("pos").cast("bigint")
    return ex.select(rid.alias("row_id"), *[F.col(f"rec.{f}").alias(f) for f in fields], "source_file")


def columnar_json_to_parquet(spark: SparkSession, path: str, out: str, fields=("prompt", "completion"),
                             multi_line: bool = True, mode: str = "overwrite") -> None:
    """S5 convert-once: reading columnar JSON takes several passes; write it once as parquet for later jobs."""
    read_columnar_json(spark, path, fields, multi_line=multi_line).write.mode(mode).parquet(out)


def read_trainer_logs(spark: SparkSession, path: str, multi_line: bool = True,
                      schema=None) -> DataFrame:
    """Trainer logs -> one row per ``log_history`` entry.

    Many runs in one read; ``log_file`` tells them apart, ``entry_no``
    keeps the list order.  Extra top-level fields (e.g. ``run``) are kept.
    """
    r = spark.read.option("multiLine", multi_line)
    if schema is not None:
        r = r.schema(schema)
    df = r.json(path)
    top = [c for c in df.columns if c != "log_history"]
    ex = df.select(F.input_file_name().alias("log_file"), *top,
                   F.posexplode("log_history").alias("entry_no", "e"))
    return ex.select("log_file", *top, "entry_no", "e.*")


def first_entry_metrics(spark: SparkSession, path: str, multi_line: bool = True, run: str | None = None) -> DataFrame:
    """G8 key rule: the keys of the first ``log_history`` entry of each log,
    except ``step`` (JSON inference would union the keys of all entries).

    ``multi_line=True``: one pretty-printed object per file.
    ``multi_line=False``: one object per line, as ``write_trainer_logs``
    writes them; ``run`` names the field that tells the logs of a file
    apart, and only a run's first part counts.
    """
    txt = spark.read.text(path, wholetext=multi_line)
    if not multi_line and run:
        txt = txt.filter(F.coalesce(F.get_json_object("value", "$.part"), F.lit("0")) == "0")
    first = F.get_json_object(F.col("value"), "$.log_history[0]")
    named = [F.get_json_object("value", f"$.{run}").alias(run)] if run else []
    keys = txt.select(F.input_file_name().alias("log_file"), *named,
                      F.posexplode(F.json_object_keys(first)).alias("key_no", "metric"))
    return keys.filter(F.col("metric") != "step")

"""Adapters from the driver tables to the reference's data shapes.

The driver tables hold no proteins, so each fixture is derived from a
table by a fixed rule (documented in FIXTURES.md section 3).  Each
Spark adapter has a DuckDB twin (``*_SQL``) used by the oracle queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from residua.functions.hashing import keyed_hash_sql
from residua.functions.oracles import IONISABLE, KYTE_DOOLITTLE, PKA, POSITIVE
from residua.functions.text import to_sequence
from residua.operators.ranking import rank_within

# Adapter parameters (our choices, fixed for the driver queries).
LENGTH_BIN = 250          # proteins: length bin in letters
BATCH_SIZE = 8            # reference loader batch size
SEED = 42
ASSISTANT = "assistant"


#: Session setting: deal the text tables over this many partitions after the scan.  Unset: no exchange.
#: For tables stored as a single row group, which one task would otherwise read and work through alone.
SCAN_PARTITIONS = "spark.residua.scanPartitions"
UNIQUE_KEYS = {"documents": ["doc_id"], "conversations": ["conv_id", "turn"]}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; dealt by its unique key if the caller set ``SCAN_PARTITIONS``, whatever its size."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    n = spark.conf.get(SCAN_PARTITIONS, None)
    return df.repartition(int(n), *UNIQUE_KEYS[name]) if n and name in UNIQUE_KEYS else df


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents -> ``row_id, sequence, lang, source, n_chars``."""
    return sequences_of(table(spark, sf_dir, "documents"))


def sequences_of(d: DataFrame) -> DataFrame:
    return d.select(F.col("doc_id").alias("row_id"), to_sequence("text").alias("sequence"),
                    "lang", "source", "n_chars")


def proteins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sequences + ``taxid`` (digits of ``source``) and ``ogt`` = n_chars / 100."""
    return proteins_of(table(spark, sf_dir, "documents"))


def proteins_of(d: DataFrame) -> DataFrame:
    s = sequences_of(d)
    return s.select("row_id", "sequence",
                    F.regexp_extract("source", r"(\d+)", 1).cast("bigint").alias("taxid"),
                    (F.col("n_chars") / F.lit(100.0)).alias("ogt"))


def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """assistant turns -> ``conv_id, turn, text, completion``."""
    c = table(spark, sf_dir, "conversations").filter(F.col("role") == ASSISTANT)
    return c.select("conv_id", "turn", "text", to_sequence("text").alias("completion"))


def token_logits(spark: SparkSession, sf_dir: str, shift: int = 0) -> DataFrame:
    """embeddings as a token-score table ``seq_id, pos, token_id, logits``.

    ``shift`` k gives the vector of row ``(vec_id + k) mod n`` at each
    position (old policy k=1, reference k=2): an equi-join on a computed
    key, with ``n`` as a scalar subquery.
    """
    e = table(spark, sf_dir, "embeddings")
    vec = F.col("vec_id")
    coords = [F.expr("vec_id div 8").alias("seq_id"), F.pmod(vec, F.lit(8)).alias("pos"),
              F.pmod(vec, F.lit(64)).cast("int").alias("token_id")]
    if shift == 0:
        return e.select(*coords, F.col("embedding").alias("logits"))
    n = e.select(F.count(F.lit(1))).scalar()
    src = e.select(F.pmod(vec - F.lit(shift), n).alias("vec_id"), F.col("embedding").alias("logits"))
    return e.select(vec, *coords).join(src, "vec_id").drop("vec_id")


def gradients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings -> ``layer, grad``."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("label").cast("string").alias("layer"), F.col("embedding").alias("grad"))


def pair_logprobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem numbers as pair log-probabilities (arithmetic test only)."""
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber",
                     (-F.col("l_quantity") / 10).alias("policy_chosen"),
                     (-F.col("l_extendedprice") / 10000).alias("policy_rejected"),
                     (-F.col("l_discount") * 10).alias("ref_chosen"),
                     (-F.col("l_tax") * 10).alias("ref_rejected"))


def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a long training log ``run, step, metric, value``.

    ``step`` numbers each run's events by ``(ts, event_id)`` with the
    sliced ranking, so one very active run does not become one task.
    """
    ev = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run"), "ts", "event_id",
        F.col("event_type").alias("metric"), "value")
    ev = rank_within(ev, ["run"], ["ts", "event_id"], "step")
    return ev.select("run", "step", "metric", "value")


def preference_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents joined with labels: ``row_id, lang, source, quality, sequence``."""
    s = sequences(spark, sf_dir)
    lab = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("row_id"), "quality")
    return s.join(lab, "row_id", "inner").select("row_id", "lang", "source", "quality", "sequence")


# ---------------------------------------------------------------- SQL twins

def count_sql(seq: str, letter: str) -> str:
    return f"(length({seq}) - length(replace({seq}, '{letter}', '')))"


def hydro_sql(seq: str) -> str:
    terms = " + ".join(f"{count_sql(seq, a)} * {int(round(v * 10))}" for a, v in KYTE_DOOLITTLE.items())
    return f"(CAST(({terms}) AS DOUBLE) / 10.0::DOUBLE)"


def charge_sql(counts: dict[str, str], ph: str) -> str:
    q = [f"1.0 / (1.0 + pow(10.0, {ph} - {PKA['N_term']}))",
         f"- 1.0 / (1.0 + pow(10.0, {PKA['C_term']} - {ph}))"]
    for a in IONISABLE:
        if a in POSITIVE:
            q.append(f"+ {counts[a]} / (1.0 + pow(10.0, {ph} - {PKA[a]}))")
        else:
            q.append(f"- {counts[a]} / (1.0 + pow(10.0, {PKA[a]} - {ph}))")
    return "(CAST(" + " ".join(q) + " AS DOUBLE))"


def hash_sql(*parts: str) -> str:
    return keyed_hash_sql(*parts)


SEQ_SQL = ("seqs AS (SELECT doc_id AS row_id, upper(regexp_replace(text, '[^A-Za-z]+', '', 'g')) AS sequence, "
           "lang, source, n_chars FROM documents)")
PROTEIN_SQL = SEQ_SQL + (", prots AS (SELECT row_id, sequence, "
                         "CAST(regexp_extract(source, '(\\d+)', 1) AS BIGINT) AS taxid, "
                         "CAST(n_chars AS DOUBLE) / 100.0::DOUBLE AS ogt FROM seqs)")
COMPLETION_SQL = ("comps AS (SELECT conv_id, turn, text, upper(regexp_replace(text, '[^A-Za-z]+', '', 'g')) "
                  "AS completion FROM conversations WHERE role = 'assistant')")
EMB_SQL = ("emb AS (SELECT vec_id, embedding, label FROM embeddings), "
           "nemb AS (SELECT count(*) AS n FROM emb), "
           "tok AS (SELECT a.vec_id // 8 AS seq_id, a.vec_id % 8 AS pos, CAST(a.vec_id % 64 AS INTEGER) AS token_id, "
           "a.embedding AS logits, o.embedding AS old, r.embedding AS ref, a.label AS label FROM emb a "
           "JOIN emb o ON o.vec_id = (a.vec_id + 1) % (SELECT n FROM nemb) "
           "JOIN emb r ON r.vec_id = (a.vec_id + 2) % (SELECT n FROM nemb))")
PAIR_LP_SQL = ("lp AS (SELECT l_orderkey, l_linenumber, -l_quantity / 10 AS policy_chosen, "
               "-l_extendedprice / 10000 AS policy_rejected, -l_discount * 10 AS ref_chosen, "
               "-l_tax * 10 AS ref_rejected FROM lineitem)")
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")

LOG_SQL = ("logs AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, "
           "event_type AS metric, value FROM events)")
VARIANT_SQL = SEQ_SQL + (", variants AS (SELECT s.row_id, s.lang, s.source, l.quality, s.sequence FROM seqs s "
                         "JOIN labels l ON l.doc_id = s.row_id)")

"""Registered queries: one Spark job per operator group, each with the
equivalent DuckDB SQL where one exists.

Every query reads the driver tables (or data Spark derives from them)
in full.  Floating results are rounded to 6 decimals in both engines;
integers are BIGINT in both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from residua.functions.oracles import IONISABLE, hydrophobicity, isoelectric_point, net_charge
from residua.functions.rewards import hydrophobicity_reward, target_reward
from residua.functions.text import END_OF_TEXT, length_bin
from residua.operators import batching, datasets, grouping
from residua.operators._keys import join_on_keys
from residua.plans import adapters as A
from residua.sources import readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = " ".join(sql.split())
        return fn
    return deco


def r6(c) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# ------------------------------------------------------------ rewards, G1

@query("hydrophobicity_reward", f"""
WITH {A.SEQ_SQL}, h AS (SELECT row_id, {A.hydro_sql('sequence')} AS hydro FROM seqs)
SELECT row_id, round(hydro, 6) AS hydrophobicity, round(-abs(20.0::DOUBLE - hydro), 6) AS reward FROM h
""")
def q_hydrophobicity_reward(spark, d):
    """C4, C9 on documents: 20 native counts per row, no shuffle beyond the scan."""
    s = A.sequences(spark, d)
    return s.select("row_id", r6(hydrophobicity("sequence")).alias("hydrophobicity"),
                    r6(hydrophobicity_reward("sequence")).alias("reward"))


GROUP_ADVANTAGE_SQL = f"""
WITH {A.COMPLETION_SQL},
r AS (SELECT conv_id, turn, -abs(20.0::DOUBLE - {A.hydro_sql('completion')}) AS reward FROM comps),
s AS (SELECT conv_id, avg(reward) AS m, stddev_pop(reward) AS sd FROM r GROUP BY conv_id)
SELECT r.conv_id, r.turn, round(r.reward, 6) AS reward,
       round(CASE WHEN s.sd = 0 THEN NULL ELSE (r.reward - s.m) / s.sd END, 6) AS advantage
FROM r JOIN s ON r.conv_id IS NOT DISTINCT FROM s.conv_id
"""


@query("hydrophobicity_reward_arrow", ORACLE_SQL["hydrophobicity_reward"])
def q_hydrophobicity_reward_arrow(spark, d):
    """C4 alternative: one pass over the Arrow string buffer (the native form is faster here)."""
    s = A.sequences(spark, d)
    h = F.col("__h")
    x = s.select("row_id", hydrophobicity("sequence", method="arrow").alias("__h"))
    return x.select("row_id", r6(h).alias("hydrophobicity"),
                    r6(-F.abs(F.lit(20.0) - h)).alias("reward"))


@query("group_advantage", GROUP_ADVANTAGE_SQL)
def q_group_advantage(spark, d):
    """Flagship: completions -> hydrophobicity reward -> advantage per conversation."""
    c = A.completions(spark, d).withColumn("reward", hydrophobicity_reward("completion"))
    a = grouping.group_advantage(c, "reward", group="conv_id")
    return a.select("conv_id", "turn", r6("reward").alias("reward"), r6("advantage").alias("advantage"))


@query("target_reward_advantage", """
WITH r AS (SELECT l_orderkey, l_linenumber, l_quantity, -abs(l_quantity - 25.0::DOUBLE) AS reward FROM lineitem),
s AS (SELECT l_orderkey, avg(reward) AS m, stddev_pop(reward) AS sd FROM r GROUP BY l_orderkey)
SELECT r.l_orderkey, CAST(r.l_linenumber AS BIGINT) AS l_linenumber, r.l_quantity, round(r.reward, 6) AS reward,
       round(CASE WHEN s.sd = 0 THEN NULL ELSE (r.reward - s.m) / s.sd END, 6) AS advantage
FROM r JOIN s ON r.l_orderkey IS NOT DISTINCT FROM s.l_orderkey
""")
def q_target_reward_advantage(spark, d):
    """C10, G1 on lineitem grouped by order: partial aggregate + skew-safe join back."""
    li = A.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    r = li.withColumn("reward", target_reward("l_quantity", 25.0))
    a = grouping.group_advantage(r, "reward", group="l_orderkey")
    return a.select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "l_quantity",
                    r6("reward").alias("reward"), r6("advantage").alias("advantage"))


# ------------------------------------------------------------ C1, P7

_MARK = END_OF_TEXT


@query("clean_text", f"""
WITH raw AS (SELECT doc_id, '{_MARK}' || text || '<|endof' || chr(10) || 'text|>' AS raw FROM documents),
c AS (SELECT doc_id, raw, replace(replace(raw, chr(10), ''), '{_MARK}', '') AS clean FROM raw)
SELECT doc_id, clean, CAST(length(raw) - length(clean) AS BIGINT) AS n_removed FROM c
""")
def q_clean_text(spark, d):
    """Raw text with markers (one broken by a newline) and its cleaned form."""
    docs = A.table(spark, d, "documents")
    raw = F.concat(F.lit(_MARK), F.col("text"), F.lit("<|endof\ntext|>"))
    x = datasets.pair_raw_clean(docs.select("doc_id", raw.alias("raw")), "raw", "clean")
    return x.select("doc_id", "clean", (F.length("raw") - F.length("clean")).cast("bigint").alias("n_removed"))


# ------------------------------------------------------------ B1-B4, P1

_USABLE = "length(regexp_replace(sequence, '\\s', '', 'g')) > 0"
_H = A.hash_sql("'42'", "row_id")


def _cut_sql(cap: str, min_removals: int = 1) -> str:
    if min_removals == 1:
        k = f"CASE WHEN {cap} >= 1 THEN 1 + CAST(h % {cap} AS BIGINT) ELSE 0 END"
    else:
        k = f"CASE WHEN {cap} >= 1 THEN CAST(h % ({cap} + 1) AS BIGINT) ELSE 0 END"
    return f"CAST({k} AS BIGINT)"


PROMPT_COMPLETION_SQL = f"""
WITH {A.SEQ_SQL}, u AS (SELECT row_id, sequence AS s, length(sequence) AS n, {_H} AS h FROM seqs WHERE {_USABLE}),
c AS (SELECT row_id, s, n, {_cut_sql('(n - 1)')} AS k FROM u)
SELECT row_id, left(s, n - k) AS prompt, right(s, k) AS completion, k AS n_removed FROM c
"""


@query("prompt_completion", PROMPT_COMPLETION_SQL)
def q_prompt_completion(spark, d):
    """Keyed-random suffix cut of every usable sequence (map-only)."""
    s = A.sequences(spark, d)
    return datasets.prompt_completion(s, seq="sequence", key="row_id", mode="rows", seed=A.SEED)


@query("prompt_completion_latched", f"""
WITH {A.SEQ_SQL}, u AS (SELECT row_id, sequence AS s, length(sequence) AS n, {_H} AS h FROM seqs WHERE {_USABLE}),
cap AS (SELECT arg_min(n, row_id) - 1 AS cap FROM u),
c AS (SELECT row_id, s, n, {_cut_sql('least((SELECT cap FROM cap), n - 1)')} AS k FROM u)
SELECT row_id, left(s, n - k) AS prompt, right(s, k) AS completion, k AS n_removed FROM c
""")
def q_prompt_completion_latched(spark, d):
    """B3 with the latched cap: one scalar subquery (min_by) over the kept rows."""
    s = A.sequences(spark, d)
    return datasets.prompt_completion(s, seq="sequence", key="row_id", mode="rows", latch=True, seed=A.SEED)


@query("prompt_completion_tuple", f"""
WITH {A.SEQ_SQL}, u AS (SELECT row_id, sequence AS s, length(sequence) AS n, {_H} AS h FROM seqs WHERE {_USABLE}),
c AS (SELECT row_id, s, n, {_cut_sql('(n - 1)', 0)} AS k FROM u)
SELECT row_id, left(s, n - k) AS prompt_prefix, right(s, k) AS prompt_removed, s AS completion, k AS n_removed FROM c
""")
def q_prompt_completion_tuple(spark, d):
    """Cut that may remove nothing; prompt struct flattened to two columns."""
    s = A.sequences(spark, d)
    x = datasets.prompt_completion(s, seq="sequence", key="row_id", mode="tuple_full", min_removals=0,
                                   seed=A.SEED)
    return x.select("row_id", F.col("prompt.prefix").alias("prompt_prefix"),
                    F.col("prompt.removed").alias("prompt_removed"), "completion", "n_removed")


@query("identity_pairs", f"""
WITH {A.SEQ_SQL} SELECT row_id, sequence AS prompt, sequence AS completion FROM seqs
""")
def q_identity_pairs(spark, d):
    """prompt = completion = sequence."""
    return datasets.identity_pairs(A.sequences(spark, d), col="sequence", key="row_id")


@query("train_test_split", f"""
WITH {A.SEQ_SQL}
SELECT row_id, sequence, lang, source, n_chars,
       CASE WHEN CAST({_H} AS DOUBLE) / 4294967296.0::DOUBLE < 0.2::DOUBLE THEN 'test' ELSE 'train' END
       AS split FROM seqs
""")
def q_train_test_split(spark, d):
    """B4 hash split of whole rows: stable under any partitioning, no shuffle."""
    s = A.sequences(spark, d)
    return datasets.train_test_split(s, key="row_id", test_size=0.2, seed=A.SEED)


@query("train_test_split_exact", f"""
WITH {A.SEQ_SQL}, h AS (SELECT row_id, {_H} AS h FROM seqs),
r AS (SELECT row_id, row_number() OVER (ORDER BY h, row_id) AS rn FROM h)
SELECT row_id, sequence, lang, source, n_chars, CASE WHEN rn <= ceil(0.2::DOUBLE * (SELECT count(*) FROM seqs)) THEN 'test' ELSE 'train' END
       AS split FROM r JOIN seqs USING (row_id)
""")
def q_train_test_split_exact(spark, d):
    """B4 exact size: ceil(0.2 n) smallest (hash, id), the last of them selected first; whole rows stay in place."""
    s = A.sequences(spark, d)
    return datasets.train_test_split(s, key="row_id", test_size=0.2, seed=A.SEED, exact=True)


# ------------------------------------------------------------ S2, P2-P4

@query("protein_items", f"""
WITH {A.PROTEIN_SQL}
SELECT row_id, sequence, taxid AS taxon_id, ogt AS temp_g, length(sequence) AS length FROM prots
""")
def q_protein_items(spark, d):
    """Pruned projection to sequence, taxon_id, temp_g, length."""
    docs = readers.read_columns(spark, f"{d}/documents.parquet", ("doc_id", "text", "lang", "source", "n_chars"))
    x = datasets.protein_items(A.proteins_of(docs), key="row_id")
    return x.withColumn("length", F.col("length").cast("bigint"))


@query("protein_lookup", f"""
WITH {A.SEQ_SQL} SELECT row_id, sequence FROM seqs WHERE row_id IN (SELECT doc_id FROM labels)
""")
def q_protein_lookup(spark, d):
    """Keyed lookup of many ids as a left semi join."""
    s = A.sequences(spark, d).select("row_id", "sequence")
    keys = A.table(spark, d, "labels").select(F.col("doc_id").alias("row_id"))
    return datasets.lookup_rows(s, keys, "row_id")


# ------------------------------------------------------------ C5-C7

_COUNTS = {a: A.count_sql("sequence", a) for a in IONISABLE}


@query("net_charge_ph7", f"""
WITH {A.SEQ_SQL} SELECT row_id, round({A.charge_sql(_COUNTS, '7.0')}, 6) AS net_charge FROM seqs
""")
def q_net_charge_ph7(spark, d):
    """Henderson-Hasselbalch charge at pH 7 from native residue counts."""
    s = A.sequences(spark, d)
    return s.select("row_id", r6(net_charge("sequence", 7.0)).alias("net_charge"))


_CNT_COLS = {a: f"c_{a}" for a in IONISABLE}


@query("isoelectric_point", f"""
WITH RECURSIVE {A.SEQ_SQL},
cnt AS (SELECT row_id, {', '.join(f'{A.count_sql("sequence", a)} AS c_{a}' for a in IONISABLE)} FROM seqs),
bis(row_id, i, lo, hi) AS (
  SELECT row_id, 0, 0.0::DOUBLE, 14.0::DOUBLE FROM cnt
  UNION ALL
  SELECT b.row_id, b.i + 1,
         CASE WHEN {A.charge_sql(_CNT_COLS, '((b.lo + b.hi) / 2.0)')} > 0 THEN (b.lo + b.hi) / 2.0 ELSE b.lo END,
         CASE WHEN {A.charge_sql(_CNT_COLS, '((b.lo + b.hi) / 2.0)')} > 0 THEN b.hi ELSE (b.lo + b.hi) / 2.0 END
  FROM bis b JOIN cnt c ON c.row_id = b.row_id WHERE b.i < 100)
SELECT row_id, round((lo + hi) / 2.0, 2) AS isoelectric_point FROM bis WHERE i = 100
""")
def q_isoelectric_point(spark, d):
    """100 fixed bisection steps folded in the JVM, counts carried in the fold."""
    s = A.sequences(spark, d)
    return s.select("row_id", isoelectric_point("sequence").alias("isoelectric_point"))


def _pi_sql(source: str, keys: str, seq: str, more: str = "") -> str:
    """Recursive bisection over ``source`` as CTEs ``cnt`` and ``bis``; ``more`` are columns to carry."""
    on = " AND ".join(f"c.{k} = b.{k}" for k in keys.split(", "))
    mid = A.charge_sql(_CNT_COLS, "((b.lo + b.hi) / 2.0)")
    return f"""cnt AS (SELECT {keys}{more}, {', '.join(f'{A.count_sql(seq, a)} AS c_{a}' for a in IONISABLE)} FROM {source}),
bis AS (SELECT {keys}, 0 AS i, 0.0::DOUBLE AS lo, 14.0::DOUBLE AS hi FROM cnt
  UNION ALL SELECT {', '.join(f'b.{k}' for k in keys.split(', '))}, b.i + 1,
         CASE WHEN {mid} > 0 THEN (b.lo + b.hi) / 2.0 ELSE b.lo END, CASE WHEN {mid} > 0 THEN b.hi ELSE (b.lo + b.hi) / 2.0 END
  FROM bis b JOIN cnt c ON {on} WHERE b.i < 100)"""


@query("pi_reward_advantage", f"""
WITH RECURSIVE {A.COMPLETION_SQL}, {_pi_sql('comps', 'conv_id, turn', 'completion')},
r AS (SELECT conv_id, turn, -abs(round((lo + hi) / 2.0, 2) - 7.0::DOUBLE) AS reward FROM bis WHERE i = 100),
s AS (SELECT conv_id, avg(reward) AS m, stddev_pop(reward) AS sd, count(*) AS n, min(reward) AS lo, max(reward) AS hi
      FROM r GROUP BY conv_id)
SELECT r.conv_id, r.turn, round(r.reward, 6) AS reward,
       round(CASE WHEN s.lo = s.hi THEN NULL ELSE (r.reward - s.m) / s.sd END, 6) AS advantage
FROM r JOIN s USING (conv_id)
""")
def q_pi_reward_advantage(spark, d):
    """C1, C7, C10, G1, the reward path of a training step: marked text -> clean -> pI -> target 7 -> advantage."""
    from residua.functions.text import to_sequence
    from residua.streaming.scoring import score_completions
    raw = A.table(spark, d, "conversations").filter(F.col("role") == A.ASSISTANT).select(
        "conv_id", "turn", F.concat(F.lit(_MARK), F.col("text"), F.lit(_MARK)).alias("raw"))
    clean = datasets.pair_raw_clean(raw, "raw", "cleaned").select("conv_id", "turn", to_sequence("cleaned").alias("raw"))
    scored = score_completions(clean, "raw", ph_target=7.0).select("conv_id", "turn", F.col("pI_reward").alias("reward"))
    a = grouping.group_advantage(scored, "reward", group="conv_id", checkpoint=True)
    # equal rewards have no spread, whatever rounding leaves of their standard deviation
    a = grouping.with_group_stats(a, "conv_id", {"__lo": F.min("reward"), "__hi": F.max("reward")})
    adv = F.when(F.col("__lo") < F.col("__hi"), r6("advantage"))
    return a.select("conv_id", "turn", r6("reward").alias("reward"), adv.alias("advantage"))


@query("isoelectric_by_composition", ORACLE_SQL["isoelectric_point"])
def q_isoelectric_by_composition(spark, d):
    """C7 solved once per distinct ionisable composition, joined back."""
    s = A.sequences(spark, d).select("row_id", "sequence")
    return datasets.isoelectric_by_composition(s, "sequence").select("row_id", "isoelectric_point")


@query("isoelectric_point_numpy", ORACLE_SQL["isoelectric_point"])
def q_isoelectric_point_numpy(spark, d):
    """C7 alternative: the same bisection on Arrow batches of the seven counts."""
    s = A.sequences(spark, d)
    return s.select("row_id", isoelectric_point("sequence", method="numpy").alias("isoelectric_point"))


# ------------------------------------------------------------ T1-T8, L2, U3

def _binned(spark, d):
    p = A.proteins(spark, d)
    return p.select("row_id", "taxid", length_bin("sequence", A.LENGTH_BIN).cast("bigint").alias("length_bin"),
                    F.length("sequence").cast("bigint").alias("length"))


_BINNED_SQL = A.PROTEIN_SQL + (f", binned AS (SELECT row_id, taxid, CAST(floor(length(sequence) / {A.LENGTH_BIN}) "
                               f"* {A.LENGTH_BIN} AS BIGINT) AS length_bin, length(sequence) AS length FROM prots)")
_SHUFFLED_SQL = _BINNED_SQL + f""", ranked AS (SELECT *, row_number() OVER (PARTITION BY taxid, length_bin
  ORDER BY {_H}, row_id) AS rn FROM binned),
batched AS (SELECT row_id, taxid, length_bin, length, CAST((rn - 1) // {A.BATCH_SIZE} AS BIGINT) AS batch_no,
  CAST((rn - 1) % {A.BATCH_SIZE} + 1 AS BIGINT) AS pos_in_batch FROM ranked),
keyed AS (SELECT *, CAST({A.hash_sql("'42'", 'taxid', 'length_bin', 'batch_no')} AS BIGINT) AS batch_key FROM batched)"""


def _shuffled(spark, d):
    b = batching.assign_batches(_binned(spark, d), ("taxid", "length_bin"), A.BATCH_SIZE, shuffle=True,
                                seed=A.SEED, key="row_id")
    return b.withColumn("pos_in_batch", F.col("pos_in_batch").cast("bigint"))


@query("length_batches", f"""
WITH {_SHUFFLED_SQL} SELECT row_id, taxid, length_bin, batch_no, pos_in_batch, batch_key FROM keyed
""")
def q_length_batches(spark, d):
    """taxon/length batches in keyed-random order, hot groups sliced."""
    return _shuffled(spark, d).select("row_id", "taxid", "length_bin", "batch_no", "pos_in_batch", "batch_key")


@query("length_batches_unshuffled", f"""
WITH {_BINNED_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY taxid, length_bin ORDER BY row_id) AS rn,
  min(row_id) OVER (PARTITION BY taxid) AS taxon_first,
  min(row_id) OVER (PARTITION BY taxid, length_bin) AS bin_first FROM binned)
SELECT row_id, taxid, length_bin, CAST((rn - 1) // {A.BATCH_SIZE} AS BIGINT) AS batch_no,
  CAST((rn - 1) % {A.BATCH_SIZE} + 1 AS BIGINT) AS pos_in_batch, taxon_first, bin_first FROM ranked
""")
def q_length_batches_unshuffled(spark, d):
    """T5: batches in reference order (groups by first appearance, rows by id)."""
    b = batching.assign_batches(_binned(spark, d), ("taxid", "length_bin"), A.BATCH_SIZE, shuffle=False,
                                key="row_id")
    return b.select("row_id", "taxid", "length_bin", "batch_no",
                    F.col("pos_in_batch").cast("bigint").alias("pos_in_batch"), "taxon_first", "bin_first")


@query("batch_count", f"""
WITH {_BINNED_SQL}, g AS (SELECT taxid, length_bin, count(*) AS n FROM binned GROUP BY ALL)
SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(ceil(n / {A.BATCH_SIZE})) AS BIGINT) AS n_batches FROM g
""")
def q_batch_count(spark, d):
    """Row and batch counts from per-group partial aggregates."""
    return batching.batch_count(_binned(spark, d), ("taxid", "length_bin"), A.BATCH_SIZE)


@query("first_batches", f"""
WITH {_SHUFFLED_SQL}, heads AS (SELECT DISTINCT batch_key, taxid, length_bin, batch_no FROM keyed
  ORDER BY batch_key, taxid, length_bin, batch_no LIMIT 6)
SELECT k.row_id, k.taxid, k.length_bin, k.batch_no, k.pos_in_batch FROM keyed k
JOIN heads h ON h.taxid = k.taxid AND h.length_bin = k.length_bin AND h.batch_no = k.batch_no
""")
def q_first_batches(spark, d):
    """L2: rows of the first six batches: a top-n of batches, then their rows."""
    return (batching.first_batches(_shuffled(spark, d), n=6)
            .select("row_id", "taxid", "length_bin", "batch_no", "pos_in_batch"))


@query("batch_rows", f"""
WITH {_SHUFFLED_SQL}
SELECT taxid, length_bin, batch_no, count(*) AS n_items,
       string_agg(CAST(row_id AS VARCHAR), ',' ORDER BY pos_in_batch) AS item_ids FROM keyed GROUP BY ALL
""")
def q_batch_rows(spark, d):
    """One row per batch with its items in order (bounded by the batch size)."""
    rows = batching.batch_rows(_shuffled(spark, d))
    return rows.select("taxid", "length_bin", "batch_no", F.col("n_items").cast("bigint").alias("n_items"),
                       "item_ids")


@query("serving_batches", f"""
WITH {_SHUFFLED_SQL}
SELECT taxid, length_bin, batch_no, count(*) AS n_rows, min(row_id) AS first_row, max(row_id) AS last_row,
       true AS in_order FROM keyed GROUP BY ALL
""")
def q_serving_batches(spark, d):
    """Batches counted inside ``mapInPandas`` over the serving order.  A batch cut between two
    partitions or out of order would show as a second row or ``in_order`` false."""
    cols = ["batch_key", "taxid", "length_bin", "batch_no", "pos_in_batch", "row_id"]
    served = batching.serving_order(_shuffled(spark, d).select(*cols))

    def count(chunks):
        import pandas as pd
        seen = {}
        for pdf in chunks:
            for row in pdf.itertuples(index=False):
                key = row[1:4]
                if key not in seen:
                    seen[key] = [0, row[5], row[5], True]
                s = seen[key]
                s[3] &= row[4] == s[0] + 1
                s[0], s[1], s[2] = s[0] + 1, min(s[1], row[5]), max(s[2], row[5])
                if len(seen) > 1 and next(iter(seen)) != key:       # the batch before this one has ended
                    done = next(iter(seen))
                    yield pd.DataFrame([[*done, *seen.pop(done)]])
        for key, s in seen.items():
            yield pd.DataFrame([[*key, *s]])

    return served.mapInPandas(count, "taxid long, length_bin long, batch_no long, n_rows long, first_row long, "
                                     "last_row long, in_order boolean")


def _pad_collate(pdf):
    """A caller's collate function: pad a batch to its longest sequence."""
    import pandas as pd
    longest = int(pdf["length"].max())
    return pd.DataFrame({
        "taxid": [int(pdf["taxid"].iloc[0])], "length_bin": [int(pdf["length_bin"].iloc[0])],
        "batch_no": [int(pdf["batch_no"].iloc[0])], "n_items": [len(pdf)],
        "max_length": [longest], "n_padding": [int((longest - pdf["length"]).sum())],
    })


@query("custom_collate", f"""
WITH {_SHUFFLED_SQL}
SELECT taxid, length_bin, batch_no, count(*) AS n_items, max(length) AS max_length,
       CAST(sum(m - length) AS BIGINT) AS n_padding
FROM (SELECT *, max(length) OVER (PARTITION BY taxid, length_bin, batch_no) AS m FROM keyed) GROUP BY ALL
""")
def q_custom_collate(spark, d):
    """A caller's pandas collate function once per batch (one mapInPandas pass)."""
    b = _shuffled(spark, d).select("taxid", "length_bin", "batch_no", "length")
    schema = ("taxid long, length_bin long, batch_no long, n_items long, max_length long, n_padding long")
    return batching.collate_batches(b, _pad_collate, schema)


@query("generation_groups", f"""
WITH {A.COMPLETION_SQL}
SELECT conv_id, count(*) AS n_generations, CAST(count(*) = 2 AS INTEGER) AS complete FROM comps GROUP BY conv_id
""")
def q_generation_groups(spark, d):
    """Completions per prompt against num_generations."""
    c = A.completions(spark, d)
    return batching.check_generation_groups(c, "conv_id", num_generations=2, batch_size=8)


# ------------------------------------------------------------ C12-C15, J1, J2, G2-G5, X4

from residua.operators import objective as obj  # noqa: E402


def _aligned(spark, d):
    pol = A.token_logits(spark, d, 0)
    old = A.token_logits(spark, d, 1)
    ref = A.token_logits(spark, d, 2)
    return obj.align_scores(pol, old, ref, ("seq_id", "pos"), "logits")


@query("kl_estimate", f"""
WITH {A.EMB_SQL}, u AS (SELECT seq_id, pos, CAST(unnest(logits) AS DOUBLE) AS p, CAST(unnest(ref) AS DOUBLE) AS r FROM tok)
SELECT seq_id, pos, round(avg(exp(r - p) - (r - p) - 1.0::DOUBLE), 6) AS kl_mean FROM u GROUP BY seq_id, pos
""")
def q_kl_estimate(spark, d):
    """k3 KL per token, vocabulary reduced inside the row."""
    k = obj.kl_per_token(_aligned(spark, d))
    return k.select("seq_id", "pos", r6("kl_mean").alias("kl_mean"))


@query("grpo_loss", f"""
WITH {A.EMB_SQL},
rw AS (SELECT vec_id // 8 AS seq_id, -abs(avg(label) - 4.5::DOUBLE) AS reward FROM emb GROUP BY 1),
adv AS (SELECT seq_id, (reward - avg(reward) OVER ()) / stddev_pop(reward) OVER () AS a FROM rw),
u AS (SELECT t.seq_id, CAST(unnest(t.logits) AS DOUBLE) AS p, CAST(unnest(t.old) AS DOUBLE) AS o,
             CAST(unnest(t.ref) AS DOUBLE) AS r, adv.a FROM tok t
      JOIN adv ON adv.seq_id = t.seq_id),
v AS (SELECT exp(p - o) AS ratio, r - p AS dd, a FROM u)
SELECT round(-avg(least(ratio * a, greatest(0.99::DOUBLE, least(1.01::DOUBLE, ratio)) * a)
             - 0.1::DOUBLE * (exp(dd) - dd - 1.0::DOUBLE)), 6) AS grpo_loss,
       (SELECT count(*) FROM tok) AS n_tokens, CAST(count(*) AS BIGINT) AS n_elements FROM v
""")
def q_grpo_loss(spark, d):
    """Clipped GRPO objective over tokens x vocabulary.  After J2 each token row is
    reduced to four numbers, so J1 moves no vocabulary."""
    tokens = _aligned(spark, d)
    labels = A.table(spark, d, "embeddings").select(F.expr("vec_id div 8").alias("seq_id"), "label")
    rewards = labels.groupBy("seq_id").agg(target_reward(F.avg("label"), 4.5).alias("reward"))
    adv = grouping.group_advantage(rewards, "reward", group=None)
    j = obj.attach_advantages(obj.grpo_sums(tokens, epsilon=0.01), adv, "seq_id", "advantage")
    g = obj.grpo_objective(j, "advantage", beta=0.1, epsilon=0.01)
    return g.select(r6("grpo_loss").alias("grpo_loss"), "n_tokens", "n_elements")


UPDATES = (1.0, 0.95, 0.9)       # stand-in policies of a step's updates: the logits times this


def _times(array, factor: float):
    return F.transform(array, lambda x: x * factor)


@query("grpo_loss_updates", f"""
WITH {A.EMB_SQL},
rw AS (SELECT vec_id // 8 AS seq_id, -abs(avg(label) - 4.5::DOUBLE) AS reward FROM emb GROUP BY 1),
adv AS (SELECT seq_id, (reward - avg(reward) OVER ()) / stddev_pop(reward) OVER () AS a FROM rw),
ups AS (SELECT unnest([1, 2, 3]) AS up, unnest([{', '.join(f'{x}::DOUBLE' for x in UPDATES)}]) AS f),
u AS (SELECT up, f, a, CAST(unnest(t.logits) AS DOUBLE) AS p, CAST(unnest(t.old) AS DOUBLE) AS o,
             CAST(unnest(t.ref) AS DOUBLE) AS r FROM ups, tok t JOIN adv ON adv.seq_id = t.seq_id),
v AS (SELECT up, exp(p * f - o) AS ratio, r - p * f AS dd, a FROM u)
SELECT CAST(up AS BIGINT) AS step_update, round(-avg(least(ratio * a, greatest(0.99::DOUBLE, least(1.01::DOUBLE, ratio)) * a)
             - 0.1::DOUBLE * (exp(dd) - dd - 1.0::DOUBLE)), 6) AS grpo_loss, CAST(count(*) AS BIGINT) AS n_elements
FROM v GROUP BY up
""")
def q_grpo_loss_updates(spark, d):
    """J2, G3 for the updates of one step: old policy and reference are kept once as bucketed tables, and every
    update's policy scores meet them without an exchange."""
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def keep(what, scores):
        path = scratch_path(spark, f"scores-{what}")
        return obj.write_score_table(scores, "scores_" + path[-32:], path, buckets)

    old, ref = (keep(w, A.token_logits(spark, d, k)) for w, k in (("old", 1), ("ref", 2)))
    labels = A.table(spark, d, "embeddings").select(F.expr("vec_id div 8").alias("seq_id"), "label")
    rewards = labels.groupBy("seq_id").agg(target_reward(F.avg("label"), 4.5).alias("reward"))
    adv = grouping.group_advantage(rewards, "reward", group=None)
    losses = None
    for n, f in enumerate(UPDATES, 1):
        new = A.token_logits(spark, d, 0).withColumn("logits", _times(F.col("logits").cast("array<double>"), f))
        sums = obj.grpo_sums(obj.align_score_tables(keep(f"policy{n}", new), old, ref), epsilon=0.01)
        loss = obj.grpo_objective(obj.attach_advantages(sums, adv), "advantage", beta=0.1, epsilon=0.01)
        loss = loss.select(F.lit(n).cast("bigint").alias("step_update"), r6("grpo_loss").alias("grpo_loss"), "n_elements")
        losses = loss if losses is None else losses.union(loss)
    return losses


@query("grpo_loss_one_pass", """
WITH t AS (SELECT vec_id // 8 AS seq_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS p, label FROM embeddings),
a AS (SELECT *, list_transform(p, lambda x: x * 0.75::DOUBLE) AS o, list_reverse(p) AS r FROM t),
rw AS (SELECT seq_id, -abs(avg(label) - 4.5::DOUBLE) AS reward FROM t GROUP BY 1),
adv AS (SELECT seq_id, (reward - avg(reward) OVER ()) / stddev_pop(reward) OVER () AS a FROM rw),
u AS (SELECT unnest(p) AS p, unnest(o) AS o, unnest(r) AS r, adv.a FROM a JOIN adv USING (seq_id)),
v AS (SELECT exp(p - o) AS ratio, r - p AS dd, a FROM u)
SELECT round(-avg(least(ratio * a, greatest(0.99::DOUBLE, least(1.01::DOUBLE, ratio)) * a)
             - 0.1::DOUBLE * (exp(dd) - dd - 1.0::DOUBLE)), 6) AS grpo_loss,
       (SELECT count(*) FROM t) AS n_tokens, CAST(count(*) AS BIGINT) AS n_elements FROM v
""")
def q_grpo_loss_one_pass(spark, d):
    """G3 on rows that carry all three score arrays (a scorer that runs the three models itself): no array
    is shuffled at all."""
    e = A.table(spark, d, "embeddings")
    p = F.col("embedding").cast("array<double>")
    tokens = e.select(F.expr("vec_id div 8").alias("seq_id"), p.alias("policy"),
                      F.transform(p, lambda x: x * 0.75).alias("old"), F.reverse(p).alias("ref"))
    rewards = (e.groupBy(F.expr("vec_id div 8").alias("seq_id"))
               .agg(target_reward(F.avg("label"), 4.5).alias("reward")))
    adv = grouping.group_advantage(rewards, "reward", group=None)
    j = obj.attach_advantages(obj.grpo_sums(tokens, epsilon=0.01), adv)
    g = obj.grpo_objective(j, "advantage", beta=0.1, epsilon=0.01)
    return g.select(r6("grpo_loss").alias("grpo_loss"), "n_tokens", "n_elements")


@query("grpo_loss_by_conversation", f"""
WITH {A.COMPLETION_SQL},
r AS (SELECT conv_id, -abs(20.0::DOUBLE - {A.hydro_sql('completion')}) AS reward,
             -(length(text) % 97) / 97.0::DOUBLE AS p, -(length(text) % 89) / 89.0::DOUBLE AS o,
             -(length(text) % 83) / 83.0::DOUBLE AS f FROM comps),
s AS (SELECT conv_id, avg(reward) AS m, stddev_pop(reward) AS sd FROM r GROUP BY conv_id),
j AS (SELECT p, o, f, CASE WHEN s.sd = 0 THEN 0.0::DOUBLE ELSE (r.reward - s.m) / s.sd END AS a
      FROM r JOIN s ON r.conv_id IS NOT DISTINCT FROM s.conv_id),
v AS (SELECT exp(p - o) AS ratio, f - p AS dd, a FROM j)
SELECT round(-avg(least(ratio * a, greatest(0.99::DOUBLE, least(1.01::DOUBLE, ratio)) * a)
             - 0.1::DOUBLE * (exp(dd) - dd - 1.0::DOUBLE)), 6) AS grpo_loss,
       count(*) AS n_tokens, count(*) AS n_elements FROM v
""")
def q_grpo_loss_by_conversation(spark, d):
    """Conversations as groups.  Those without spread have no advantage; the rule ``zero`` keeps
    their rows, and so their KL terms, in both sums."""
    c = A.completions(spark, d).withColumn("reward", hydrophobicity_reward("completion"))
    a = grouping.group_advantage(c, "reward", group="conv_id")
    n = F.length("text")
    t = a.select("advantage", *[(-F.pmod(n, F.lit(k)) / F.lit(float(k))).alias(name)
                                for name, k in (("policy", 97), ("old", 89), ("ref", 83))])
    g = obj.grpo_objective(t, level="token", beta=0.1, epsilon=0.01, null_advantage="zero")
    return g.select(r6("grpo_loss").alias("grpo_loss"), "n_tokens", "n_elements")


_NLL_SQL = """
tk AS (SELECT vec_id // 8 AS seq_id, vec_id % 8 AS pos, vec_id % 64 AS token_id, embedding AS l FROM embeddings),
j AS (SELECT a.seq_id, a.pos, a.l, b.token_id AS nxt FROM tk a JOIN tk b ON b.seq_id = a.seq_id AND b.pos = a.pos + 1),
x AS (SELECT seq_id, pos, l, nxt, CAST(list_max(l) AS DOUBLE) AS m FROM j),
nll AS (SELECT seq_id, pos, m + ln(list_sum(list_transform(l, lambda v: exp(CAST(v AS DOUBLE) - m)))) - l[nxt + 1] AS nll FROM x)
"""


@query("perplexity", f"""
WITH {_NLL_SQL} SELECT seq_id, count(*) AS n_tokens, round(exp(avg(nll)), 6) AS perplexity FROM nll GROUP BY seq_id
""")
def q_perplexity(spark, d):
    """Next-token NLL via an equi-join on (seq_id, pos + 1), exp(mean) per sequence."""
    nll = obj.token_nll(A.token_logits(spark, d, 0))
    return obj.perplexity(nll).select("seq_id", "n_tokens", r6("perplexity").alias("perplexity"))


@query("sequence_logprob", f"""
WITH {_NLL_SQL} SELECT seq_id, round(-sum(nll), 6) AS logprob FROM nll GROUP BY seq_id
""")
def q_sequence_logprob(spark, d):
    """Sequence log-probability = -sum of token NLL."""
    nll = obj.token_nll(A.token_logits(spark, d, 0))
    return obj.sequence_logprob(nll).select("seq_id", r6("logprob").alias("logprob"))


@query("tokens_per_sequence", """
SELECT vec_id // 8 AS seq_id, count(*) AS n_tokens FROM embeddings GROUP BY 1
""")
def q_tokens_per_sequence(spark, d):
    """Tokens per sequence."""
    return obj.tokens_per_sequence(A.token_logits(spark, d, 0))


# ------------------------------------------------------------ G6

from residua.operators import logs  # noqa: E402


@query("gradient_norm", """
WITH u AS (SELECT CAST(label AS VARCHAR) AS layer, CAST(unnest(embedding) AS DOUBLE) AS g FROM embeddings),
l AS (SELECT layer, sqrt(sum(g * g)) AS n FROM u GROUP BY layer)
SELECT layer, round(n, 6) AS layer_norm, round((SELECT sqrt(sum(n * n)) FROM l), 6) AS total_norm FROM l
""")
def q_gradient_norm(spark, d):
    """Per-layer and global L2 gradient norms."""
    g = logs.gradient_norms(A.gradients(spark, d), norm_type=2)
    return g.select("layer", r6("layer_norm").alias("layer_norm"), r6("total_norm").alias("total_norm"))


@query("gradient_norm_max", """
WITH u AS (SELECT CAST(label AS VARCHAR) AS layer, CAST(unnest(embedding) AS DOUBLE) AS g FROM embeddings),
l AS (SELECT layer, max(abs(g)) AS n FROM u GROUP BY layer)
SELECT layer, round(n, 6) AS layer_norm, round((SELECT sum(n) FROM l), 6) AS total_norm FROM l
""")
def q_gradient_norm_max(spark, d):
    """G6 'max': per-layer max |g|, total = sum of layer maxima (reference behaviour)."""
    g = logs.gradient_norms(A.gradients(spark, d), norm_type="max", total="sum")
    return g.select("layer", r6("layer_norm").alias("layer_norm"), r6("total_norm").alias("total_norm"))


# ------------------------------------------------------------ X1-X3

_DPO_SQL = A.PAIR_LP_SQL + """, m AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
  0.1::DOUBLE * (policy_chosen - ref_chosen) AS reward_chosen,
  0.1::DOUBLE * (policy_rejected - ref_rejected) AS reward_rejected FROM lp),
mm AS (SELECT *, reward_chosen - reward_rejected AS margin FROM m),
ml AS (SELECT *, greatest(-margin, 0.0::DOUBLE) + ln(1.0::DOUBLE + exp(-abs(margin))) AS loss FROM mm)"""


def _dpo(spark, d):
    m = obj.dpo_pair_metrics(A.pair_logprobs(spark, d), beta=0.1)
    return m.withColumn("l_linenumber", F.col("l_linenumber").cast("bigint"))


@query("dpo_metrics", f"""
WITH {_DPO_SQL} SELECT l_orderkey, l_linenumber, reward_chosen, reward_rejected, margin,
  round(loss, 6) AS loss FROM ml
""")
def q_dpo_metrics(spark, d):
    # Elementwise IEEE arithmetic is identical in both engines, so only
    # the transcendental loss is rounded.
    """Implicit rewards, margin and softplus loss per pair."""
    return _dpo(spark, d).select("l_orderkey", "l_linenumber", "reward_chosen", "reward_rejected", "margin",
                                 r6("loss").alias("loss"))


_SUMMARY_COLS = ("eval_loss", "rewards_chosen", "rewards_rejected", "rewards_accuracy", "rewards_margin")


@query("dpo_summary", f"""
WITH {_DPO_SQL} SELECT round(avg(loss), 6) AS eval_loss, round(avg(reward_chosen), 6) AS rewards_chosen,
  round(avg(reward_rejected), 6) AS rewards_rejected,
  round(avg(CAST(reward_chosen > reward_rejected AS DOUBLE)), 6) AS rewards_accuracy,
  round(avg(margin), 6) AS rewards_margin, count(*) AS n_pairs FROM ml
""")
def q_dpo_summary(spark, d):
    """Evaluation summary in one global aggregate."""
    s = obj.dpo_summary(_dpo(spark, d))
    return s.select(*[r6(c).alias(c) for c in _SUMMARY_COLS], "n_pairs")


# ------------------------------------------------------------ G7-G9, C16, L3, X7, X8

_LABEL_SQL = ("CASE WHEN metric = 'reward' THEN 'Reward' WHEN metric = 'loss' THEN 'Loss' "
              "ELSE upper(left(metric, 1)) || lower(substr(metric, 2)) END")


@query("metric_series", f"""
WITH {A.LOG_SQL} SELECT run, step, metric, value, {_LABEL_SQL} AS label FROM logs
""")
def q_metric_series(spark, d):
    """Long metric series with labels; steps from the sliced per-run ranking."""
    from residua.functions.text import metric_label
    ev = A.log_events(spark, d)
    return ev.select("run", "step", "metric", "value", metric_label("metric").alias("label"))


@query("metric_select", f"""
WITH {A.LOG_SQL}, e AS (SELECT *, CAST(step AS DOUBLE) / count(*) OVER (PARTITION BY run) AS epoch FROM logs)
SELECT run, step, epoch, metric, value FROM e WHERE metric IN ('purchase', 'click')
""")
def q_metric_select(spark, d):
    """Chosen series against epoch (step / run length via group stats)."""
    ev = A.log_events(spark, d)
    ev = grouping.with_group_stats(ev, "run", {"__n": F.count(F.lit(1))})
    ev = ev.withColumn("epoch", F.col("step") / F.col("__n")).drop("__n")
    return logs.select_series(ev, ["purchase", "click"], x="epoch")


@query("reward_history", f"""
WITH {A.LOG_SQL} SELECT step, count(value) AS n, round(avg(value), 6) AS mean_reward,
  round(stddev_pop(value), 6) AS std_reward, round(min(value), 6) AS min_reward, round(max(value), 6) AS max_reward
FROM logs GROUP BY step
""")
def q_reward_history(spark, d):
    """Per-step count, mean, std, min and max."""
    h = grouping.reward_history(A.log_events(spark, d), "step", "value")
    return h.select("step", "n", *[r6(c).alias(c) for c in
                                   ("mean_reward", "std_reward", "min_reward", "max_reward")])


@query("reward_history_exact", ORACLE_SQL["reward_history"])
def q_reward_history_exact(spark, d):
    """G7 with sums that do not depend on the order of the rows."""
    h = grouping.reward_history(A.log_events(spark, d), "step", "value", exact=True)
    return h.select("step", "n", *[r6(c).alias(c) for c in
                                   ("mean_reward", "std_reward", "min_reward", "max_reward")])


@query("logged_steps", f"""
WITH {A.LOG_SQL} SELECT run, step, metric, value FROM logs WHERE step % 5 = 0
""")
def q_logged_steps(spark, d):
    """Consumer columns only, every fifth step."""
    return logs.every_k_steps(A.log_events(spark, d), k=5)


# ------------------------------------------------------------ Q1-Q6

def _pairs(spark, d):
    v = A.preference_variants(spark, d)
    return datasets.preference_pairs(v, ["lang", "source"], "quality", "row_id", chosen_min=1,
                                     rejected_max=0, threshold=1.0, seed=A.SEED)


_PAIRS_SQL = A.VARIANT_SQL + f""",
vh AS (SELECT *, {_H} AS h FROM variants),
c AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY h, row_id) AS pos FROM vh WHERE quality >= 1),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY h, row_id) AS pos FROM vh WHERE quality <= 0),
nr AS (SELECT lang, source, count(*) AS nr FROM r GROUP BY ALL),
pairs AS (SELECT c.lang, c.source, c.row_id AS chosen_id, r.row_id AS rejected_id,
                 c.sequence AS chosen, r.sequence AS rejected
  FROM c JOIN nr ON nr.lang IS NOT DISTINCT FROM c.lang AND nr.source IS NOT DISTINCT FROM c.source
  JOIN r ON r.lang IS NOT DISTINCT FROM c.lang AND r.source IS NOT DISTINCT FROM c.source
        AND r.pos = (c.pos - 1) % nr.nr + 1
  WHERE c.quality - r.quality >= 1)"""


@query("preference_pairs", f"""
WITH {_PAIRS_SQL} SELECT lang, source, chosen_id, rejected_id FROM pairs
""")
def q_preference_pairs(spark, d):
    """Q5: linear chosen/rejected pairing per prompt (no cross product)."""
    return _pairs(spark, d).select("lang", "source", "chosen_id", "rejected_id")


def _pairs_with_text(spark, d):
    v = A.preference_variants(spark, d)
    p = datasets.preference_pairs(v, ["lang", "source"], "quality", "row_id", chosen_min=1,
                                  rejected_max=0, threshold=1.0, seed=A.SEED, carry=["sequence"])
    return (p.withColumnRenamed("chosen_sequence", "chosen")
             .withColumnRenamed("rejected_sequence", "rejected"))


_MARGIN_SQL = A.SEQ_SQL + f""",
vh AS (SELECT *, {_H} AS h FROM seqs),
c AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY h, row_id) AS turn FROM vh WHERE n_chars >= 1500),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars, h, row_id) AS pos FROM vh WHERE n_chars <= 2500),
m AS (SELECT c.lang, c.row_id, c.n_chars, c.turn, count(*) AS m FROM c
      JOIN r ON r.lang IS NOT DISTINCT FROM c.lang AND r.n_chars <= c.n_chars - 1000 GROUP BY ALL),
p AS (SELECT *, unnest(range(least(2, m))) AS j FROM m)"""


@query("preference_pairs_margin", f"""
WITH {_MARGIN_SQL}
SELECT p.lang, p.row_id AS chosen_id, p.n_chars AS chosen_score, r.row_id AS rejected_id, r.n_chars AS rejected_score
FROM p JOIN r ON r.lang IS NOT DISTINCT FROM p.lang AND r.pos = (p.turn - 1 + p.j) % p.m + 1
""")
def q_preference_pairs_margin(spark, d):
    """Q5 where the threshold binds: two partners per chosen row, each at least 1,000 shorter; four hot prompts."""
    s = A.sequences(spark, d).select("row_id", "lang", "n_chars")
    return datasets.preference_pairs(s, "lang", "n_chars", "row_id", chosen_min=1500, rejected_max=2500,
                                     threshold=1000, seed=A.SEED, partners=2)


@query("pair_distance", f"""
WITH {_PAIRS_SQL} SELECT chosen_id, rejected_id,
  CAST(len(list_filter(list_zip(string_split(chosen, ''), string_split(rejected, '')),
       lambda z: z[1] IS DISTINCT FROM z[2])) AS BIGINT) AS distance,
  length(chosen) AS chosen_length, length(rejected) AS rejected_length FROM pairs
""")
def q_pair_distance(spark, d):
    """Q6: Hamming distance over whole texts of each pair."""
    p = datasets.pair_distance(_pairs_with_text(spark, d), "chosen", "rejected")
    return p.select("chosen_id", "rejected_id", "distance",
                    F.length("chosen").cast("bigint").alias("chosen_length"),
                    F.length("rejected").cast("bigint").alias("rejected_length"))


@query("degenerate_pairs", f"""
WITH {_PAIRS_SQL} SELECT lang, source, count(*) AS n_pairs,
  CAST(sum(CAST(chosen IS NOT DISTINCT FROM rejected AS INTEGER)) AS BIGINT) AS n_degenerate FROM pairs GROUP BY ALL
""")
def q_degenerate_pairs(spark, d):
    """Q2: pairs whose chosen equals rejected, per prompt."""
    return datasets.degenerate_pairs(_pairs_with_text(spark, d), "chosen", "rejected", group=["lang", "source"])


@query("split_overlap", f"""
WITH {A.SEQ_SQL}, sp AS (SELECT row_id, sequence,
  CASE WHEN CAST({_H} AS DOUBLE) / 4294967296.0::DOUBLE < 0.2::DOUBLE THEN 'test' ELSE 'train' END AS split FROM seqs)
SELECT row_id, sequence FROM sp WHERE split = 'test'
  AND sequence IN (SELECT sequence FROM sp WHERE split = 'train')
""")
def q_split_overlap(spark, d):
    """Q1: test rows whose sequence also occurs in train (semi join on digests)."""
    s = datasets.train_test_split(A.sequences(spark, d).select("row_id", "sequence"), "row_id", 0.2, A.SEED)
    test = s.filter(F.col("split") == "test").drop("split")
    train = s.filter(F.col("split") == "train")
    return datasets.split_overlap(test, train, "sequence")


_RESIDUE_PICK = ("substr('ACDEFGHIKLMNPQRSTVWY', CAST(('0x' || substr(md5(concat_ws('|', '42', row_id, i // 8)), "
                 "CAST((i % 8) * 4 + 1 AS INTEGER), 4))::UBIGINT % 20 AS INTEGER) + 1, 1)")


@query("fixed_prefix_negatives", f"""
WITH {A.SEQ_SQL}, f AS (SELECT row_id, left(sequence, 3) AS prompt, substr(sequence, 4) AS chosen FROM seqs)
SELECT row_id, prompt, chosen,
  array_to_string(list_transform(range(length(chosen)), lambda i: {_RESIDUE_PICK}), '') AS rejected FROM f
""")
def q_fixed_prefix_negatives(spark, d):
    """Q3, Q4: 3-letter prompt, rest as chosen, keyed-random residues as rejected."""
    s = A.sequences(spark, d)
    return datasets.fixed_prefix_pairs(s, "sequence", "row_id", k=3, seed=A.SEED)


# ------------------------------------------------------------ S1, S3-S6, K1-K3, L1, X5

from residua.session import scratch_path  # noqa: E402
from residua.sources import writers  # noqa: E402


@query("fasta_round_trip", f"""
WITH {A.SEQ_SQL} SELECT CAST(row_id AS VARCHAR) AS entry, sequence FROM seqs
""")
def q_fasta_round_trip(spark, d):
    """FASTA written (wrapped at 60) to the shared scratch folder and read back."""
    s = A.sequences(spark, d)
    path = scratch_path(spark, "fasta")
    writers.write_fasta(s.select(F.col("row_id").alias("entry"), "sequence"), path)
    return readers.read_fasta(spark, path, check=True)


@query("tsv_round_trip", f"""
WITH {A.SEQ_SQL} SELECT row_id, sequence AS "Sequence" FROM seqs WHERE {_USABLE}
""")
def q_tsv_round_trip(spark, d):
    """TSV with header written and read back with an explicit schema."""
    s = A.sequences(spark, d).select("row_id", F.col("sequence").alias("Sequence"))
    path = scratch_path(spark, "tsv")
    writers.write_tsv(s, path)
    back = readers.read_tsv(spark, path, schema="row_id bigint, Sequence string")
    return datasets.usable_sequences(back, "Sequence")


@query("tsv_quoted_round_trip", """
SELECT doc_id, text, '"' || source || '"' AS quoted,
       CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN lang END AS sparse FROM documents
""")
def q_tsv_quoted_round_trip(spark, d):
    """Whole texts with their newlines, quotes, empty strings and nulls through a TSV folder read in splits."""
    sparse = F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, F.col("lang"))
    docs = A.table(spark, d, "documents").select(
        "doc_id", "text", F.concat(F.lit('"'), "source", F.lit('"')).alias("quoted"), sparse.alias("sparse"))
    path = scratch_path(spark, "tsv-quoted")
    writers.write_tsv(docs, path)
    return readers.read_tsv(spark, path, schema="doc_id bigint, text string, quoted string, sparse string")


@query("columnar_json_round_trip", f"""
WITH {A.SEQ_SQL}, u AS (SELECT row_id, sequence AS s, length(sequence) AS n, {_H} AS h FROM seqs WHERE {_USABLE}),
c AS (SELECT row_id, s, n, {_cut_sql('(n - 1)')} AS k FROM u)
SELECT row_id, left(s, n - k) AS prompt, right(s, k) AS completion FROM c
""")
def q_columnar_json_round_trip(spark, d):
    """Chunked dict-of-lists JSON written and read back in parallel."""
    pc = datasets.prompt_completion(A.sequences(spark, d), seq="sequence", key="row_id", seed=A.SEED)
    path = scratch_path(spark, "columnar")
    writers.write_columnar_json(pc, path, ("prompt", "completion"), key="row_id", chunk_rows=250)
    back = readers.read_columnar_json(spark, path, ("prompt", "completion"), multi_line=False, with_row_id=True)
    return back.select("row_id", "prompt", "completion")


@query("columnar_json_one_object", ORACLE_SQL["columnar_json_round_trip"])
def q_columnar_json_one_object(spark, d):
    """S5 in the shipped layout, one object a file: chunks written one to a file, each read in splits."""
    pc = datasets.prompt_completion(A.sequences(spark, d), seq="sequence", key="row_id", seed=A.SEED)
    path = scratch_path(spark, "columnar-objects")
    writers.write_columnar_json(pc, path + "-lines", ("prompt", "completion"), key="row_id", chunk_rows=2_500)
    lines = spark.read.text(path + "-lines")
    lines.write.option("lineSep", "\n").option("maxRecordsPerFile", 1).text(path)
    back = readers.read_columnar_json(spark, path, ("prompt", "completion"), with_row_id=True)
    return back.select("row_id", "prompt", "completion")


def _written_logs(spark, d):
    """The event log as trainer logs, one JSON object per run and part: what is read back, and the folder."""
    ev = A.log_events(spark, d)
    ev = grouping.with_group_stats(ev, "run", {"__n": F.count(F.lit(1))})
    ev = ev.withColumn("epoch", F.col("step") / F.col("__n")).drop("__n")
    wide = ev.groupBy("run", "step", "epoch").pivot("metric", list(A.EVENT_TYPES)).agg(F.first("value"))
    path = scratch_path(spark, "logs")
    writers.write_trainer_logs(wide, path, run="run", step="step", chunk_entries=50)
    # The schema is known from the pivot, so the read skips JSON inference.
    entry = ", ".join(["step: bigint", "epoch: double"] + [f"`{m}`: double" for m in A.EVENT_TYPES])
    schema = f"run bigint, part bigint, log_history array<struct<{entry}>>"
    return readers.read_trainer_logs(spark, path, multi_line=False, schema=schema), path


@query("first_entry_series", f"""
WITH {A.LOG_SQL}, e AS (SELECT *, CAST(step AS DOUBLE) / count(*) OVER (PARTITION BY run) AS epoch FROM logs),
k AS (SELECT run, metric FROM e WHERE step = 1 AND value IS NOT NULL
      UNION ALL SELECT run, 'epoch' FROM e WHERE step = 1)
SELECT e.run, e.step, k.metric, CASE WHEN k.metric = 'epoch' THEN e.epoch WHEN k.metric = e.metric THEN e.value END
       AS value, row_number() OVER (PARTITION BY e.run, k.metric ORDER BY e.step) AS order_no
FROM e JOIN k ON k.run IS NOT DISTINCT FROM e.run
""")
def q_first_entry_series(spark, d):
    """Each run's series are the keys of its first log entry, ``epoch`` included, in step order."""
    back, path = _written_logs(spark, d)
    back = back.withColumn("entry_no", F.col("part") * 50 + F.col("entry_no"))
    series = logs.metric_series(back, metrics=["epoch", *A.EVENT_TYPES], ids=("run", "step", "entry_no"), label=False)
    keys = readers.first_entry_metrics(spark, path, multi_line=False, run="run")
    keys = keys.select(F.col("run").cast("bigint").alias("run"), "metric")
    out = logs.in_step_order(join_on_keys(series, keys, ["run", "metric"], "left_semi"))
    return out.select("run", "step", "metric", "value", "order_no")


@query("log_round_trip", f"""
WITH {A.LOG_SQL}, e AS (SELECT *, CAST(step AS DOUBLE) / count(*) OVER (PARTITION BY run) AS epoch FROM logs),
x AS (SELECT e.run, e.step, e.epoch, m.metric, CASE WHEN e.metric = m.metric THEN e.value END AS value
      FROM e, (SELECT unnest({list(A.EVENT_TYPES)}) AS metric) m)
SELECT run, step, epoch, metric, value, {_LABEL_SQL} AS label FROM x
""")
def q_log_round_trip(spark, d):
    """Trainer-style logs (chunked per run) written, read back and unpivoted; a value that an entry
    lacks is null."""
    back, _ = _written_logs(spark, d)
    series = logs.metric_series(back.drop("log_file", "entry_no", "part"), ids=("run", "step", "epoch"))
    return series.select("run", "step", "epoch", "metric", "value", "label")


@query("data_preparation", f"""
WITH {A.SEQ_SQL}, h AS (SELECT row_id, sequence AS s, length(sequence) AS n, {_H} AS h FROM seqs),
o AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY h, row_id) <= ceil(0.2::DOUBLE * (SELECT count(*) FROM seqs))
                     THEN 'test' ELSE 'train' END AS split FROM h),
u AS (SELECT * FROM o WHERE length(regexp_replace(s, '\\s', '', 'g')) > 0),
cap AS (SELECT split, arg_min(n, row_id) - 1 AS cap FROM u GROUP BY split),
c AS (SELECT u.row_id, u.split, s, n, {_cut_sql('least(cap, n - 1)')} AS k FROM u JOIN cap USING (split))
SELECT row_id, split, left(s, n - k) AS prompt, right(s, k) AS completion, k AS n_removed FROM c
""")
def q_data_preparation(spark, d):
    """S1, B4, P6, B3, K1 as one job: TSV in, exact split, a cap latched per split, JSON out per split, read back."""
    tsv = scratch_path(spark, "prep-tsv")
    writers.write_tsv(A.sequences(spark, d).select("row_id", F.col("sequence").alias("Sequence")), tsv)
    raw = readers.read_tsv(spark, tsv, schema="row_id bigint, Sequence string")
    split = datasets.train_test_split(raw, "row_id", 0.2, A.SEED, exact=True)
    pairs = datasets.prompt_completion(split, key="row_id", seed=A.SEED, latch_by="split")
    out = scratch_path(spark, "prep-json")
    writers.write_json_rows(pairs, out, partition_by=["split"])
    back = spark.read.schema("row_id bigint, prompt string, completion string, n_removed bigint, split string").json(out)
    return back.select("row_id", "split", "prompt", "completion", "n_removed")


@query("json_export", f"""
WITH {A.SEQ_SQL} SELECT row_id, sequence, lang, source, n_chars FROM seqs
""")
def q_json_export(spark, d):
    """K1, K2: JSON Lines export of the whole table and read back."""
    s = A.sequences(spark, d)
    path = scratch_path(spark, "json")
    writers.write_json_rows(s, path)
    return spark.read.schema("row_id bigint, sequence string, lang string, source string, n_chars bigint").json(path)


@query("metrics_export", f"""
WITH {_DPO_SQL} SELECT round(avg(loss), 6) AS eval_loss, round(avg(reward_chosen), 6) AS rewards_chosen,
  round(avg(reward_rejected), 6) AS rewards_rejected,
  round(avg(CAST(reward_chosen > reward_rejected AS DOUBLE)), 6) AS rewards_accuracy,
  round(avg(margin), 6) AS rewards_margin, count(*) AS n_pairs FROM ml
""")
def q_metrics_export(spark, d):
    """K3: evaluation metrics written as JSON and read back."""
    s = q_dpo_summary(spark, d)
    path = scratch_path(spark, "metrics")
    writers.write_json_rows(s, path)
    schema = ", ".join(f"{c} double" for c in _SUMMARY_COLS) + ", n_pairs bigint"
    return spark.read.schema(schema).json(path)


@query("parquet_shards", """
SELECT doc_id, text, lang, source, n_chars FROM documents
""")
def q_parquet_shards(spark, d):
    """S3: parquet file / folder / glob read."""
    return readers.read_parquet_shards(spark, f"{d}/documents.parquet").select("doc_id", "text", "lang", "source",
                                                                               "n_chars")


@query("preview", """
SELECT doc_id, text, lang, source, n_chars FROM documents ORDER BY doc_id LIMIT 5
""")
def q_preview(spark, d):
    """L1: first five documents by id (the limit is the feature)."""
    return (A.table(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars")
            .orderBy("doc_id").limit(5))


@query("completion_log", f"""
WITH {A.COMPLETION_SQL} SELECT 'grpo' AS run, turn AS step, conv_id, completion,
  round(-abs(20.0::DOUBLE - {A.hydro_sql('completion')}), 6) AS reward FROM comps
""")
def q_completion_log(spark, d):
    """Completions with rewards appended, partitioned by run/step, read back."""
    c = A.completions(spark, d)
    rows = c.select(F.lit("grpo").alias("run"), F.col("turn").alias("step"), "conv_id", "completion",
                    r6(hydrophobicity_reward("completion")).alias("reward"))
    path = scratch_path(spark, "completion-log")
    writers.append_completion_log(rows, path, ("run", "step"))
    back = spark.read.parquet(path)
    return back.select("run", F.col("step").cast("bigint").alias("step"), "conv_id", "completion", "reward")


@query("completion_log_replay", ORACLE_SQL["completion_log"])
def q_completion_log_replay(spark, d):
    """X5 after a failure: a step is logged in part, then all steps whole; each step is read once."""
    c = A.completions(spark, d)
    rows = c.select(F.lit("grpo").alias("run"), F.col("turn").alias("step"), "conv_id", "completion",
                    r6(hydrophobicity_reward("completion")).alias("reward"))
    path = scratch_path(spark, "completion-replay")
    writers.append_completion_log(rows.filter("step = 1 AND conv_id % 2 = 0"), path, replace=True)
    writers.append_completion_log(rows, path, replace=True)
    back = spark.read.parquet(path)
    return back.select("run", F.col("step").cast("bigint").alias("step"), "conv_id", "completion", "reward")


# ------------------------------------------------------------ U1, U2, P8, X6

def _user_reward(completions, **kwargs):
    """A caller's plain-Python reward: hydrophobic letters minus half the acidic ones."""
    out = []
    for seq in completions:
        if seq is None:
            out.append(None)
            continue
        out.append(sum(ch in "AILMFVW" for ch in seq) - 0.5 * sum(ch in "DE" for ch in seq))
    return out


@query("custom_reward", f"""
WITH {A.COMPLETION_SQL} SELECT conv_id, turn,
  CAST(length(completion) - length(regexp_replace(completion, '[AILMFVW]', '', 'g')) AS DOUBLE)
  - 0.5::DOUBLE * (length(completion) - length(regexp_replace(completion, '[DE]', '', 'g'))) AS reward FROM comps
""")
def q_custom_reward(spark, d):
    """A caller's plain-Python reward on Arrow batches."""
    from residua.operators.udf import reward_column
    c = A.completions(spark, d)
    return c.select("conv_id", "turn", reward_column(_user_reward, "completion").alias("reward"))


@query("truncate_tokens", f"""
WITH {A.COMPLETION_SQL}, t AS (SELECT conv_id, turn, string_split_regex(text, '\\s+') AS toks FROM comps)
SELECT conv_id, turn, CAST(len(toks) AS BIGINT) AS n_tokens, array_to_string(toks[1:32], ' ') AS truncated FROM t
""")
def q_truncate_tokens(spark, d):
    """Whitespace tokens cut to 32."""
    c = A.completions(spark, d).select("conv_id", "turn", F.split("text", r"\s+").alias("toks"))
    t = obj.truncate_tokens(c, "toks", 32, out="__short")
    return t.select("conv_id", "turn", F.size("toks").cast("bigint").alias("n_tokens"),
                    F.array_join("__short", " ").alias("truncated"))


def _toy_scorer_factory(part_tokens: int = 1 << 16):
    """Deterministic stand-in for a model: letter tokens, logits -(v - t)^2 / 256.

    Values are multiples of 1/256, exact in float32, so the oracle can
    recompute them.  Vectorised over ``part_tokens`` tokens at a time, so
    that a long text needs no more memory than short ones.
    """
    import numpy as np
    import pyarrow as pa
    vocab = np.arange(26, dtype=np.float32)

    def score(ids, texts):
        lens = np.fromiter((len(t) if t else 0 for t in texts), dtype=np.int64, count=len(texts))
        joined = "".join(t for t in texts if t).encode("ascii")
        toks = np.frombuffer(joined, dtype=np.uint8).astype(np.int32) - 65
        n = len(toks)
        seq = np.repeat(np.asarray(ids, dtype=np.int64), lens)
        starts = np.repeat(np.cumsum(lens) - lens, lens)
        pos = (np.arange(n, dtype=np.int64) - starts).astype(np.int32)
        ends = np.cumsum(lens)[lens > 0] - 1          # last position of each sequence
        nxt = np.empty(n, dtype=np.int32)
        nxt[:-1] = toks[1:]
        last = np.zeros(n, dtype=bool)
        last[ends] = True
        for a in range(0, n, part_tokens):
            here = slice(a, a + part_tokens)
            some = toks[here]
            logits = (-((vocab[None, :] - some[:, None].astype(np.float32)) ** 2) / np.float32(256.0)).ravel()
            offsets = pa.array(np.arange(0, 26 * len(some) + 1, 26, dtype=np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(logits, type=pa.float32()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(seq[here]), pa.array(pos[here]), pa.array(some), pa.array(nxt[here], mask=last[here]), lists],
                names=["seq_id", "pos", "token_id", "next_token_id", "logits"])

    return score


@query("batch_scoring", f"""
WITH {A.COMPLETION_SQL}, s AS (SELECT conv_id * 1000 + turn AS seq_id, completion AS c FROM comps WHERE length(completion) > 1),
p AS (SELECT seq_id, unnest(range(length(c) - 1)) AS i, c FROM s),
t AS (SELECT seq_id, ascii(substr(c, CAST(i + 1 AS INTEGER), 1)) - 65 AS tok,
             ascii(substr(c, CAST(i + 2 AS INTEGER), 1)) - 65 AS nxt FROM p),
l AS (SELECT seq_id, list_transform(range(26), lambda v: -((v - tok) * (v - tok)) / 256.0::DOUBLE) AS lg, nxt FROM t),
nll AS (SELECT seq_id, list_max(lg) + ln(list_sum(list_transform(lg, lambda x: exp(x - list_max(lg)))))
               - lg[nxt + 1] AS nll FROM l)
SELECT seq_id, count(*) AS n_tokens, round(exp(avg(nll)), 6) AS perplexity FROM nll GROUP BY seq_id
""")
def q_batch_scoring(spark, d):
    """A caller's scorer (mapInArrow) -> per-token table -> G4 perplexity."""
    from residua.operators.udf import score_sequences
    c = A.completions(spark, d).select((F.col("conv_id") * 1000 + F.col("turn")).alias("seq_id"), "completion")
    tokens = score_sequences(c, _toy_scorer_factory, text="completion", key="seq_id")
    nll = obj.token_nll(tokens)
    return obj.perplexity(nll).select("seq_id", "n_tokens", r6("perplexity").alias("perplexity"))



# ------------------------------------------------------------ streaming (2.10)

@query("stream_group_advantage", GROUP_ADVANTAGE_SQL)
def q_stream_group_advantage(spark, d):
    """The flagship through Structured Streaming: conversations read as a
    file stream, scored by the stateless Column functions, advantages per
    micro-batch in ``foreachBatch`` (each trainer step's generations
    arrive together), drained with ``availableNow`` and read back."""
    from residua.functions.text import to_sequence
    from residua.streaming.scoring import run_advantage_stream
    src = f"{d}/conversations.parquet"
    schema = spark.read.parquet(src).schema
    # The file source watches a folder or a glob; a one-name brace glob
    # selects exactly this file.
    stream = (spark.readStream.schema(schema).parquet(f"{d}/{{conversations}}.parquet")
              .filter(F.col("role") == A.ASSISTANT)
              .select("conv_id", "turn", hydrophobicity_reward(to_sequence("text")).alias("reward")))
    out = scratch_path(spark, "stream-adv")
    run_advantage_stream(stream, out, scratch_path(spark, "stream-ckpt"), group="conv_id")
    back = spark.read.parquet(out)
    return back.select("conv_id", "turn", r6("reward").alias("reward"), r6("advantage").alias("advantage"))


@query("stream_held_groups", GROUP_ADVANTAGE_SQL)
def q_stream_held_groups(spark, d):
    """G1, T8 on a stream that cuts groups: a conversation's turns arrive in three micro-batches, keyed state
    holds them until all that the trainer announced have come."""
    from residua.functions.text import to_sequence
    from residua.streaming.groups import run_held_advantages
    c = A.table(spark, d, "conversations").filter(F.col("role") == A.ASSISTANT).select("conv_id", "turn", "text")
    size = c.groupBy("conv_id").agg(F.count(F.lit(1)).cast("int").alias("num_generations"))
    src = scratch_path(spark, "stream-cut")
    (join_on_keys(c, size, ["conv_id"]).withColumn("part", F.pmod("turn", F.lit(3)))
     .repartitionByRange(3, "part").write.parquet(src))
    stream = (spark.readStream.schema("conv_id bigint, turn bigint, text string, num_generations int, part bigint")
              .option("maxFilesPerTrigger", 1).parquet(src)
              .select("conv_id", "turn", hydrophobicity_reward(to_sequence("text")).alias("reward"), "num_generations"))
    out = scratch_path(spark, "stream-held")
    run_held_advantages(stream, out, scratch_path(spark, "stream-ckpt"), group="conv_id")
    back = spark.read.parquet(out).filter("status = 'complete'")
    return back.select("conv_id", "turn", r6("reward").alias("reward"), r6("advantage").alias("advantage"))

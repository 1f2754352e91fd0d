"""The registered queries against SQL and brute force, and the pipeline."""

import hashlib
import math
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry_mod
import corpus_pipeline
from residua.llm import near_dedup, queries
from residua.llm.frames import table

FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def test_registry():
    q, o = entry_mod.queries(), entry_mod.oracle_sql()
    names = [n for n in q if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in q and set(queries.ORACLE_SQL) <= set(o)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, sf_small, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    df = queries.QUERIES[name](spark, sf_small)
    cur = con.execute(queries.ORACLE_SQL[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert Counter(tuple(r[c] for c in cols) for r in df.collect()) == Counter(cur.fetchall())


def test_near_query_loses_no_link(spark, sf_small):
    rows = {r["doc_id"]: r["text"] for r in table(spark, sf_small, "documents").collect()}
    sets = {}
    for i, t in rows.items():
        w = t.translate(FOLD).encode().split()
        sets[i] = {tuple(w[k:k + 4]) for k in range(len(w) - 3)} if len(w) > 3 else {tuple(w)} if w else set()
    root = {i: i for i in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in rows:
        for b in rows:
            if b < a and (both := len(sets[a] & sets[b])) and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = queries.QUERIES["op4_near_dedup"](spark, sf_small).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got} == \
        {(i, len(sets[i]), find(i), find(i) == i) for i in rows}


def test_bpe_query(spark, sf_small):
    tokenizers = pytest.importorskip("tokenizers")
    lib = tokenizers.Tokenizer.from_file(queries.word_bpe())
    got = {r["doc_id"]: r for r in queries.QUERIES["op9_bpe"](spark, sf_small).collect()}
    for r in table(spark, sf_small, "documents").collect():
        ids = lib.encode(r["text"], add_special_tokens=False).ids
        g = got[r["doc_id"]]
        assert (g["n_tokens"], g["ids_sha256"], g["decoded_sha256"]) == (
            len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
            hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest())


def test_stages(spark, sf_small):
    """Each stage against a plain computation on its own input."""
    docs = table(spark, sf_small, "documents")
    columns = docs.columns
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = stage(spark, docs, sf_small)
        after = {r["doc_id"]: r for r in docs.collect()}
        assert len(after) == docs.count() and set(after) <= set(before)
        left[name] = after
        if name != "encode":
            assert docs.columns == columns
            assert all(after[i] == before[i] for i in after)
        if name == "quality":
            for i, r in before.items():
                if len(r["text"].encode().split()) < 50:
                    assert i not in after
        if name == "exact":
            best = {}
            for i, r in before.items():
                best[r["text"].translate(FOLD)] = max(i, best.get(r["text"].translate(FOLD), i))
            assert set(after) == set(best.values())
        if name == "near":
            sets = {i: set(zip(*[r["text"].translate(FOLD).split()[k:] for k in range(5)], strict=False))
                    for i, r in before.items()}
            for a in after:
                assert not any(len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for b in after if b < a)
            groups = defaultdict(list)
            for r in near_dedup.near_dedup(spark.createDataFrame(list(before.values()))).collect():
                groups[r["component_id"]].append(r["id"])
            assert {min(g) for g in groups.values()} == set(after)
        if name == "mix":
            n = {i: len(r["text"].encode().split()) for i, r in before.items()}
            share = sum(n[i] for i in after) / sum(n.values())
            assert corpus_pipeline.MIX.budget_percent / 100 <= share <= 1.0 or math.isclose(share, 0.8, abs_tol=0.1)
    assert set(left["encode"]) == set(left["mix"])


def test_run_equals_the_stages(spark, sf_small):
    got = corpus_pipeline.run(spark, sf_small)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert got.count() > 0


def test_stages_on_messy_and_empty_tables(spark, messy, empty, sf_small, tmp_path):
    extra = [c for c in messy.columns if c not in corpus_pipeline.COLUMNS]
    for frame in (messy, empty):
        docs = frame.withColumn("n_chars", frame["doc_id"])
        for name, stage in corpus_pipeline.STAGES:
            path = f"{tmp_path}/{name}-{len(list(tmp_path.iterdir()))}"
            stage(spark, docs, sf_small).write.parquet(path)
            docs = spark.read.parquet(path)
            if name != "encode":
                assert docs.columns == list(corpus_pipeline.COLUMNS) and not set(extra) & set(docs.columns)
        if frame is empty:
            assert docs.count() == 0

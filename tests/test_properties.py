"""Property tests: random inputs against plain-Python renderings of the rules."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from residua.functions.oracles import KYTE_DOOLITTLE, hydrophobicity
from residua.functions.text import RESIDUES, clean_generated, hamming, suffix_cut

ALPHABET = RESIDUES + "Xab\n é<|>"
texts = st.text(alphabet=ALPHABET, max_size=40)
SETTINGS = settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))


def py_hamming(a, b):
    n = max(len(a), len(b))
    return sum((a[i] if i < len(a) else None) != (b[i] if i < len(b) else None) for i in range(n))


@SETTINGS
@given(st.lists(st.tuples(texts, texts), min_size=1, max_size=30))
def test_hamming_property(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r.d for r in df.select(hamming("a", "b").alias("d")).collect()]
    assert got == [py_hamming(a, b) for a, b in pairs]


@SETTINGS
@given(st.lists(texts, min_size=1, max_size=30), st.one_of(st.none(), st.integers(1, 10)))
def test_suffix_cut_property(spark, seqs, cap):
    df = spark.createDataFrame(list(enumerate(seqs)), "id long, s string")
    for r in df.select("s", suffix_cut("s", F.col("id"), max_removals=cap).alias("c")).collect():
        assert r.c.prefix + r.c.removed == r.s
        limit = len(r.s) - 1 if cap is None else min(cap, len(r.s) - 1)
        assert (r.c.n_removed == 0) if limit < 1 else (1 <= r.c.n_removed <= limit)


@SETTINGS
@given(st.lists(texts, min_size=1, max_size=30))
def test_hydrophobicity_and_clean_property(spark, seqs):
    df = spark.createDataFrame([(s,) for s in seqs], "s string")
    out = df.select("s", hydrophobicity("s").alias("h"), hydrophobicity("s", "arrow").alias("ha"),
                    clean_generated("s").alias("c")).collect()
    for r in out:
        want = sum(KYTE_DOOLITTLE.get(a, 0.0) for a in r.s)
        assert abs(r.h - want) < 1e-9 and r.h == r.ha
        assert r.c == r.s.replace("\n", "").replace("<|endoftext|>", "")

"""TSV with quoted cells: records as pandas reads them, whatever the splits."""

import io
import random

import pandas as pd
import pytest

from residua.sources import quoted, readers, writers

RAW = ('Entry\tSequence\n1\t"a""b"\n2\t"line\nbreak"\n3\tAC"D\n4\t5" disk\n5\t"x"y\n\n6\t"tab\there"\r\n7\t""\n8\n'
       '"9\n\n"\t"q"\n10\t"""\n"""\n11\t""""')


@pytest.fixture
def split_bytes(spark):
    def put(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
    yield put
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def as_pandas(raw):
    df = pd.read_csv(io.StringIO(raw, newline=""), sep="\t", dtype=str, keep_default_na=False)
    return sorted(tuple(r) for r in df.values.tolist())


@pytest.mark.parametrize("size", [40, 64, 10_000])
def test_read_as_pandas(spark, tmp_path, split_bytes, size):
    p = tmp_path / "a.tsv"
    p.write_bytes(RAW.encode())
    split_bytes(size)
    df = readers.read_tsv(spark, str(p))
    assert df.columns == ["Entry", "Sequence"]
    got = sorted(tuple(v or "" for v in r) for r in df.collect())
    assert got == as_pandas(RAW)


def test_random_files_as_pandas(spark, tmp_path, split_bytes):
    rng = random.Random(3)
    letters = ["a", "bc", '"', '""', "\t", "\n", "\r\n", "é", " "]

    def cell():
        value = "".join(rng.choice(letters) for _ in range(rng.randrange(6)))
        if rng.random() < .6:
            return '"' + value.replace('"', '""') + '"'
        return "".join(c for c in value if c not in "\t\n\r").lstrip('"') or "z"

    for k in range(4):
        raw = "a\tb\tc\n" + "".join("\t".join(cell() for _ in range(3)) + "\n" for _ in range(60))
        p = tmp_path / f"{k}.tsv"
        p.write_bytes(raw.encode())
        split_bytes(50 + 37 * k)
        assert sorted(tuple(v or "" for v in r) for r in readers.read_tsv(spark, str(p)).collect()) == as_pandas(raw)


@pytest.mark.parametrize("broadcast", [True, False])
def test_round_trip_in_splits(spark, tmp_path, split_bytes, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(quoted, "MAX_BROADCAST_SPLITS", 0)
    rng = random.Random(1)
    parts = ["a", '"', "\t", "\n", "\r", "é", " ", '""', "x\ny", "\r\n", ",", "\\"]

    def value():
        return None if rng.random() < .1 else "".join(rng.choice(parts) for _ in range(rng.randrange(20)))
    data = [(i, value(), value()) for i in range(120)] + [(120, "long\n" * 300, '"' * 301)]
    path = str(tmp_path / "t")
    writers.write_tsv(spark.createDataFrame(data, "id long, a string, b string").coalesce(2), path)
    split_bytes(400)
    assert quoted._lines(spark, path).rdd.getNumPartitions() > 3
    back = readers.read_tsv(spark, path, "id bigint, a string, b string")
    assert sorted(map(tuple, back.collect())) == data


def test_malformed(spark, tmp_path):
    def read(raw, **kw):
        p = tmp_path / f"{abs(hash(raw))}.tsv"
        p.write_text(raw)
        return readers.read_tsv(spark, str(p), **kw)
    assert [tuple(r) for r in read("a\tb\n1\n").collect()] == [("1", None)]
    assert [tuple(r) for r in read("a\tb\nx\t2.5\n", schema="a int, b double").collect()] == [(None, 2.5)]
    with pytest.raises(Exception, match="2 columns, but a record of 3"):
        read("a\tb\n1\t2\t3\n").collect()
    with pytest.raises(Exception, match="quote not closed"):
        read('a\tb\n1\t"x\n').collect()
    assert read("a\tb\n").count() == 0


def test_line_functions():
    for line in ('a\tb', '"a', 'a"\tb', '"a"\t"b', '"a""', '"a"""', '""\t"', 'x\t"y"z"', '"'):
        for inside in (False, True):
            state, start, i = inside, not inside, 0
            while i < len(line):
                c = line[i]
                if state:
                    if c == '"' and line[i + 1:i + 2] == '"':
                        i += 1
                    elif c == '"':
                        state = False
                    start = False
                elif c == '"' and start:
                    state, start = True, False
                else:
                    start = c == "\t"
                i += 1
            assert quoted.ends_inside(line, inside) == state, (line, inside)


def test_fasta_first_record(spark, tmp_path):
    (tmp_path / "bad.fasta").write_text("junk\n>>x\nAC\n>b\nDD\n")
    with pytest.raises(ValueError, match="bad.fasta"):
        readers.read_fasta(spark, str(tmp_path / "bad.fasta"), check=True)
    (tmp_path / "good.fasta").write_text(">>a\nMK\n>>x\nAC\n>b\nDD\n")
    got = sorted(map(tuple, readers.read_fasta(spark, str(tmp_path / "good.fasta"), check=True).collect()))
    assert got == [(">a", "MK"), (">x", "AC"), ("b", "DD")]

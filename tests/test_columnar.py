"""Columnar JSON read in splits equals the parsed file, whatever layout and split size."""

import json
import random

import pytest

from residua.sources import columnar, readers


@pytest.fixture
def split_bytes(spark):
    def put(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
    yield put
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def values(rng, n):
    parts = ["AC", "x y", '"', "\\", "\\\"", "[", "]", "{", "}", ",", ":", "\n", "é", "\t", "null", "\U0001F600"]
    return [None if rng.random() < .1 else "".join(rng.choice(parts) for _ in range(rng.randrange(6))) for _ in range(n)]


def read(spark, path, fields=("prompt", "completion"), **kw):
    return readers.read_columnar_json(spark, str(path), fields, **kw)


@pytest.mark.parametrize("size", [70, 251, 100_000])
@pytest.mark.parametrize("layout", [{"indent": 4}, {}, {"separators": (",", ":"), "ensure_ascii": False}])
def test_any_layout_and_split(spark, tmp_path, split_bytes, size, layout):
    rng = random.Random(size)
    want = []
    for k in range(2):
        prompt, completion = values(rng, 60), values(rng, 60)
        order = {"other": [1, 2.5, True, None], "completion": completion, "prompt": prompt}
        if k:
            order = {"prompt": prompt, 'odd "name"\\': [], "completion": completion}
        (tmp_path / f"{k}.json").write_text(json.dumps(order, **layout), encoding="utf-8")
        want += [(i, p, c) for i, (p, c) in enumerate(zip(prompt, completion, strict=True))]
    split_bytes(size)
    if size < 1000:
        assert columnar._pieces(spark, str(tmp_path)).rdd.getNumPartitions() > 8
    got = read(spark, tmp_path).drop("source_file").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_long_strings_cross_splits(spark, tmp_path, split_bytes):
    prompt = ['"' * 200, "\\" * 300, 'a"' * 150, "plain" * 100, ""]
    (tmp_path / "a.json").write_text(json.dumps({"prompt": prompt, "completion": prompt[::-1]}, indent=2))
    split_bytes(64)
    got = sorted(map(tuple, read(spark, tmp_path).drop("source_file").collect()))
    assert got == [(i, p, c) for i, (p, c) in enumerate(zip(prompt, prompt[::-1], strict=True))]


def test_scalars_ids_and_shuffled_splits(spark, tmp_path, split_bytes, monkeypatch):
    monkeypatch.setattr(columnar, "MAX_BROADCAST_SPLITS", 0)
    ids = list(range(100, 160))
    (tmp_path / "a.json").write_text(json.dumps({"row_id": ids, "prompt": [str(i) for i in ids], "completion": ids}, indent=4))
    split_bytes(90)
    got = sorted(map(tuple, read(spark, tmp_path, with_row_id=True).drop("source_file").collect()))
    assert got == [(i, str(i), str(i)) for i in ids]


@pytest.mark.parametrize("bad", [
    {"prompt": ["a", "b"], "completion": ["c"]}, {"prompt": ["a"]}, {"prompt": ["a"], "completion": [["b"]]},
    {"prompt": ["a"], "completion": [{"b": "c"}]}, {"prompt": ["a"], "completion": "b"}, {"prompt": ["a"], "completion": 3}])
def test_other_shapes_fail(spark, tmp_path, bad):
    (tmp_path / "a.json").write_text(json.dumps(bad))
    with pytest.raises(Exception, match="unequal sizes|no object of parallel arrays"):
        read(spark, tmp_path).collect()


def test_empty_arrays(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"prompt": [], "completion": [ ]}')
    assert read(spark, tmp_path).count() == 0

"""User-function surfaces: pluggable rewards (U1) and batch scoring.

Both run on Arrow batches, never row at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from residua.functions.rewards import hydrophobicity_reward, target_reward

# Built-in rewards by name (Column -> Column).
REWARDS: dict[str, Callable[..., Column]] = {
    "hydrophobicity": hydrophobicity_reward,
    "target": target_reward,
}


def reward_column(name_or_fn, col, **kwargs) -> Column:
    """A reward column from a registered name or a user function.

    A user function follows the trainer contract
    ``f(completions: list[str], **kwargs) -> list[float]`` and is called
    once per Arrow batch.
    """
    if isinstance(name_or_fn, str):
        if name_or_fn not in REWARDS:
            raise ValueError(f"unknown reward {name_or_fn!r}")
        return REWARDS[name_or_fn](col, **kwargs)
    fn = name_or_fn

    @F.arrow_udf(DoubleType())
    def _reward(s: pa.Array) -> pa.Array:
        vals = fn(s.to_pylist(), **kwargs)
        if len(vals) != len(s):
            raise ValueError("reward function must return one value per completion")
        # None is null; NaN stays NaN (a pandas round trip would merge the two)
        return pa.array([None if v is None else float(v) for v in vals], pa.float64())

    return _reward(F.col(col) if isinstance(col, str) else col)


def with_rewards(df: DataFrame, rewards: dict, col: str, **kwargs) -> DataFrame:
    """U1, several rewards: one column per entry of ``{name: reward}``
    (a registered name or a user function)."""
    for name, fn in rewards.items():
        df = df.withColumn(name, reward_column(fn, col, **kwargs))
    return df


TOKEN_SCHEMA = "seq_id long, pos int, token_id int, next_token_id int, logits array<float>"
#: For a scorer that runs the three models itself: no join has to line their arrays up.
ALIGNED_SCHEMA = "seq_id long, pos int, token_id int, policy array<float>, old array<float>, ref array<float>"


#: Bytes of text that a scorer gets in a call: an answer is many times as large (a vector a token)
CALL_BYTES = 1 << 16


def _calls(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch ``key, text`` so that a slice holds at most ``most`` bytes of text, or one row."""
    text, n = batch.column(1), batch.num_rows
    sized = (pc.list_value_length if pa.types.is_list(text.type) or pa.types.is_large_list(text.type)
             else pc.binary_length if pa.types.is_string(text.type) or pa.types.is_large_string(text.type)
             or pa.types.is_binary(text.type) or pa.types.is_large_binary(text.type) else None)
    if sized is None:
        yield batch
        return
    upto = np.cumsum(pc.fill_null(sized(text), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < n:
        before = int(upto[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(upto, before + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def score_sequences(df: DataFrame, factory: Callable[[], Callable], text: str = "text",
                    key: str = "seq_id", schema: str = TOKEN_SCHEMA, call_bytes: int = CALL_BYTES) -> DataFrame:
    """Run a caller's scorer over text and emit the per-token table.

    ``factory()`` is called once per task (load a model there); the
    scorer it returns maps ``(ids, texts)`` (numpy / lists of a part of an
    Arrow batch: at most ``call_bytes`` bytes of text, or one row) to a
    ``pyarrow.RecordBatch`` or a pandas frame with the columns of
    ``schema``, or to an iterator of them, so that not even a very long
    text needs its whole answer in memory.  Batches move as Arrow
    (``mapInArrow``).
    ``next_token_id`` (null at a sequence's last position) lets
    :func:`token_nll` skip the shift join.
    """
    if call_bytes < 1:
        raise ValueError("call_bytes must be at least 1")
    cols = df.select(F.col(key).alias("__k"), F.col(text).alias("__t"))

    def run(batches):
        scorer = factory()
        for rb in batches:
            for part in _calls(rb, call_bytes):
                found = scorer(part.column(0).to_numpy(zero_copy_only=False), part.column(1).to_pylist())
                for out in [found] if isinstance(found, (pa.RecordBatch, pd.DataFrame)) else found:
                    if isinstance(out, pd.DataFrame):
                        out = pa.RecordBatch.from_pandas(out, preserve_index=False)
                    if out.num_rows:
                        yield out

    return cols.mapInArrow(run, schema)

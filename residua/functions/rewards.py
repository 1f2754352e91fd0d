"""Reward columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from residua.functions.oracles import hydrophobicity

# Fixed value (reference default): hydrophobicity target.
HYDROPHOBICITY_TARGET = 20.0


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hydrophobicity_reward(seq, target: float = HYDROPHOBICITY_TARGET) -> Column:
    """``-|target - hydrophobicity(seq)|``; the text is used as is."""
    return -F.abs(F.lit(float(target)) - hydrophobicity(seq))


def target_reward(metric, reference: float) -> Column:
    """``-|metric - reference|``."""
    return -F.abs(_col(metric) - F.lit(float(reference)))

"""Sequence text functions: cleaning, cutting, binning, pairing.

All are Column expressions that stay in the JVM, but for :func:`residues`,
which Arrow batches call.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from residua.functions.hashing import keyed_hash

# Fixed values (must equal the reference for identical output):
# the end-of-text marker removed from generated text, and the twenty
# standard residues used for random negatives.
END_OF_TEXT = "<|endoftext|>"
RESIDUES = "ACDEFGHIKLMNPQRSTVWY"

# Python's str.strip() also treats the ASCII separators 0x1c-0x1f as
# whitespace; (?U) makes \s the Unicode White_Space class.  A value is
# usable if it has one character outside that set (``rlike`` stops at
# the first one instead of rewriting the string).
_NOT_BLANK = r"(?U)[^\s\x{1c}-\x{1f}]"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_generated(c) -> Column:
    """Drop every newline, then every end-of-text marker (in that order)."""
    c = _col(c)
    return F.replace(F.replace(c, F.lit("\n"), F.lit("")), F.lit(END_OF_TEXT), F.lit(""))


def to_sequence(c) -> Column:
    """Adapter: keep ASCII letters only, upper-cased."""
    return F.upper(F.regexp_replace(_col(c), "[^A-Za-z]+", ""))


def is_usable_sequence(c) -> Column:
    """Not null and not blank (blank = only whitespace)."""
    c = _col(c)
    return c.isNotNull() & c.rlike(_NOT_BLANK)


def length_bin(c, size: int = 5) -> Column:
    """C11: ``(len // size) * size``."""
    if size < 1:
        raise ValueError("size must be >= 1")
    return (F.floor(F.length(_col(c)) / F.lit(size)) * F.lit(size)).cast("int")


def _cap(length: Column, max_removals) -> Column:
    cap = length - 1
    if max_removals is not None:
        m = max_removals if isinstance(max_removals, Column) else F.lit(int(max_removals))
        cap = F.least(m.cast("bigint"), cap)
    return cap


def suffix_cut(seq, key, seed: int = 42, max_removals=None,
               min_removals: int = 1) -> Column:
    """Cut a keyed-random number of characters from the end.

    Returns ``struct(prefix, removed, n_removed)``.  With
    ``min_removals=1`` (C2) ``n`` is uniform in ``1..min(max, len-1)``;
    a sequence of length <= 1 comes back whole with an empty removed
    part.  With ``min_removals=0`` (the older C3 form) ``n`` may be 0.
    ``max_removals`` may be an int or a Column (the latched cap of B3).
    """
    if min_removals not in (0, 1):
        raise ValueError("min_removals must be 0 or 1")
    seq = _col(seq)
    n_len = F.length(seq).cast("bigint")
    cap = _cap(n_len, max_removals)
    h = keyed_hash(seed, key)
    if min_removals == 1:
        n = F.when(cap >= 1, F.lit(1) + F.pmod(h, cap)).otherwise(F.lit(0))
    else:
        n = F.when(cap >= 1, F.pmod(h, cap + 1)).otherwise(F.lit(0))
    n = n.cast("bigint")
    return F.struct(
        F.left(seq, n_len - n).alias("prefix"),
        F.right(seq, n).alias("removed"),
        n.alias("n_removed"),
    )


def fixed_prefix(seq, k: int = 3) -> Column:
    """Q3: ``struct(prompt = first k chars, rest = remainder)``."""
    seq = _col(seq)
    return F.struct(F.left(seq, F.lit(k)).alias("prompt"),
                    F.substring(seq, k + 1, 2147483647).alias("rest"))


def random_residues(length, key, seed: int = 42, alphabet: str = RESIDUES) -> Column:
    """Q4: a keyed-random string of ``length`` letters from ``alphabet``.

    Letter ``i`` is read from 4 hex digits of ``md5(seed|key|i div 8)``,
    so one digest feeds eight positions; the modulo bias of 65536 over
    20 letters is below 0.03 %.  Each digest is computed once (the
    letters of a block are a nested transform over that block's digest).
    """
    length = _col(length).cast("int")
    n_blocks = F.floor((length + F.lit(7)) / F.lit(8)).cast("int")
    letters = F.split(F.lit(alphabet), "")
    size = len(alphabet)
    key_s = _col(key).cast("string")
    # Digests first (one md5 per block), then letters from each digest as a
    # lambda variable: an outer expression inside a lambda would be
    # re-evaluated for every element.
    digests = F.transform(F.sequence(F.lit(0), n_blocks - 1),
                          lambda b: F.md5(F.concat_ws("|", F.lit(str(seed)), key_s, b.cast("string"))))

    def block(digest):
        return F.transform(
            F.sequence(F.lit(0), F.lit(7)),
            lambda j: F.element_at(letters, F.pmod(
                F.conv(F.substr(digest, j * 4 + 1, F.lit(4)), 16, 10).cast("int"), F.lit(size)) + 1))

    chars = F.flatten(F.transform(digests, block))
    return F.when(length > 0, F.array_join(F.slice(chars, 1, length), "")).otherwise(F.lit(""))


def residues(length: int | None, key: str | None, seed: int = 42, alphabet: str = RESIDUES) -> str:
    """Q4 on one value: what :func:`random_residues` gives, without an expression per letter."""
    if not length or length < 0:
        return ""
    # concat_ws leaves a null key out
    head = hashlib.md5((f"{seed}|" if key is None else f"{seed}|{key}|").encode(), usedforsecurity=False)
    digests = []
    for block in range(-(-length // 8)):
        d = head.copy()
        d.update(b"%d" % block)
        digests.append(d.digest())
    at = np.frombuffer(b"".join(digests), ">u2")[:length] % len(alphabet)
    if alphabet.isascii():
        return np.frombuffer(alphabet.encode(), np.uint8)[at].tobytes().decode()
    return "".join(np.array(list(alphabet))[at])


def hamming(a, b) -> Column:
    """Q6: positions that differ, with the longer tail counted as differences."""
    a, b = _col(a), _col(b)
    diffs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.coalesce(x != y, F.lit(True)))
    # split of '' is [''], which pairs with the other side's first letter
    # and so still counts the length difference exactly.
    return F.size(F.filter(diffs, lambda z: z)).cast("bigint")


def metric_label(c) -> Column:
    """C16: 'Reward' / 'Loss' for the two styled metrics, else capitalised."""
    c = _col(c)
    cap = F.concat(F.upper(F.left(c, F.lit(1))), F.lower(F.substring(c, 2, 2147483647)))
    return (F.when(c == "reward", F.lit("Reward"))
             .when(c == "loss", F.lit("Loss"))
             .otherwise(cap))


__all__ = ["clean_generated", "to_sequence", "is_usable_sequence", "length_bin",
           "suffix_cut", "fixed_prefix", "random_residues", "residues", "hamming",
           "metric_label", "END_OF_TEXT", "RESIDUES"]

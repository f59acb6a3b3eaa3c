"""64-bit hashes of many stretches of one array of code points at once, without an object for each.

Three code points at a time are packed into one number and mixed into the state by a bijection, so stretches of up to three have hashes of
their own; longer ones agree by chance alone (2^-64 a pair). Unlike a polynomial modulo 2^64 the state isn't a sum, so that
no sequence whose differences cancel hashes alike.
"""

from __future__ import annotations

import hashlib

import numpy as np

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Stretches beyond this length are hashed one by one.
LONG = 96


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads each bit (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hashed(codes: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The hash of each stretch codes[start : start + len]."""
    out = mixed(lens.astype(np.uint64) * MULTIPLIER + np.uint64(1))
    wide = np.concatenate((codes, np.zeros(2, codes.dtype))).astype(np.uint64)
    far = np.flatnonzero(lens > LONG)
    for i in far.tolist():
        data = codes[starts[i] : starts[i] + lens[i]].astype("<u4").tobytes()
        out[i] = int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little")
    left, at, which = np.where(lens > LONG, 0, lens), starts, None
    while True:
        go = np.flatnonzero(left > 0)
        if not len(go):
            return out
        if len(go) < len(left):
            left, at, which = left[go], at[go], go if which is None else which[go]
        chunk = wide[at] | (wide[at + 1] << np.uint64(21)) * (left > 1) | (wide[at + 2] << np.uint64(42)) * (left > 2)
        if which is None:
            out = mixed((out ^ chunk) * MULTIPLIER)
        else:
            out[which] = mixed((out[which] ^ chunk) * MULTIPLIER)
        left, at = left - 3, at + 3

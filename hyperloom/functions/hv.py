"""Hypervectors as columns: arrays of 32-bit words held in longs, bit p of the vector in word p / 32 at place p % 32.

All are built-in array functions, evaluated in the JVM without Python.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = 32
ONES = (1 << WORD) - 1


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def hv_xor(a, b) -> Column:
    """Binding of binary vectors; of bipolar ones too, with 1 where they differ."""
    return F.zip_with(_c(a), _c(b), lambda x, y: x.bitwiseXOR(y))


hv_bind_bipolar = hv_xor


def hv_and(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x.bitwiseAND(y))


def hv_flip(a, d: int) -> Column:
    """All d bits inverted; padding bits stay 0."""
    last = (1 << (d - 1) % WORD + 1) - 1
    return F.transform(_c(a), lambda x, i: x.bitwiseXOR(F.when(i == (d - 1) // WORD, F.lit(last)).otherwise(F.lit(ONES))))


def hv_count(a) -> Column:
    return F.aggregate(_c(a), F.lit(0), lambda s, x: s + F.bit_count(x))


def hv_distance(a, b) -> Column:
    """Number of different bits."""
    return hv_count(hv_xor(a, b))


def hv_hamming(a, b, d: int) -> Column:
    return hv_distance(a, b) / F.lit(d)


def hv_cosine(a, b) -> Column:
    """Cosine distance of 0/1 vectors; 1 where one is zero."""
    norm = F.sqrt(hv_count(a) * hv_count(b).cast("double"))
    return F.when(norm == 0, F.lit(1.0)).otherwise(1 - hv_count(hv_and(a, b)) / norm)


def hv_unpack(a, d: int) -> Column:
    """Array of d bits."""
    return F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda p: F.get(_c(a), F.floor(p / WORD).cast("int")).bitwiseAND(F.pow(F.lit(2.0), p % WORD).cast("long")).cast("boolean").cast("int"))


def hv_pack(bits, d: int) -> Column:
    """Words of an array of d bits."""
    n = math.ceil(d / WORD)
    word = lambda w: F.aggregate(F.transform(F.slice(_c(bits), w * WORD + 1, WORD), lambda b, i: b.cast("long") * F.pow(F.lit(2.0), i).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), word)


def hv_rotate(a, n, d: int) -> Column:
    """Rotated left by n (a number or column): bit p of the result is bit (p + n) mod d; right for negative n."""
    bits, n = hv_unpack(a, d), F.pmod(_c(n) if not isinstance(n, int) else F.lit(n), F.lit(d)).cast("int")
    return hv_pack(F.concat(F.slice(bits, n + 1, F.lit(d) - n), F.slice(bits, F.lit(1), n)), d)


def softabs(x, s: float = 20.0) -> Column:
    sig = lambda v: 1 / (1 + F.exp(-v))
    return sig(s * (_c(x) - 0.5)) + sig(s * (-_c(x) - 0.5))


def softstep(x, s: float = 20.0) -> Column:
    return 1 / (1 + F.exp(-s * (_c(x) - 0.5)))


def sigmoid(x) -> Column:
    return 1 / (1 + F.exp(-_c(x)))


def softrelu(x, s: float = 20.0) -> Column:
    return F.log(1 + F.exp(s * _c(x))) / s


def tanhx(x, s: float = 1.0) -> Column:
    return F.tanh(s * _c(x))


def step(x, at: float = 0.0) -> Column:
    return F.when(_c(x) > at, 1.0).otherwise(0.0)

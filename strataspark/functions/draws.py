"""Seeded draws as pure column expressions.

A draw is a function of ``md5(seed|part|part...)``: it depends on the row's own keys only, so
it is the same for every partitioning, after a lost executor and in SQL.
"""
from __future__ import annotations

from hashlib import md5
from math import sin

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def draw_key(seed, *parts) -> Column:
    """32 hex digits, uniform over the hash range, of (seed, parts)."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[_col(p).cast("string") for p in parts]))


def _number(key: Column) -> Column:
    return F.conv(F.substring(key, 1, 13), 16, 10).cast("double") / F.lit(4503599627370496.0)


def uniform(seed, *parts) -> Column:
    """Uniform in [0, 1): the first 13 hex digits over 2^52, which a double holds exactly."""
    return _number(draw_key(seed, *parts))


def _head(seed, *parts) -> Column:
    """The text of a draw in front of its last part."""
    return F.concat_ws("|", F.lit(str(seed)), *[_col(p).cast("string") for p in parts], F.lit(""))


def _edge(p: Column) -> Column:
    """A text that the key of a draw is less than just when its uniform is less than ``p``: the 13 hex digits of ceil(p * 2^52).
    Every key is less than "g" and none than "" or than its own beginning."""
    digits = F.lpad(F.lower(F.hex(F.ceil(p * F.lit(4503599627370496.0)).cast("long"))), 13, "0")
    return F.when(p > F.lit(1.0 - 2.0 ** -52), "g").when(p <= 0, "").otherwise(digits)


def _bound(value: Column, f) -> Column:
    """f(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def slot(n, seed, *parts) -> Column:
    """Uniform integer 1..n."""
    return (F.floor(uniform(seed, *parts) * _col(n)) + 1).cast("long")


_SINES = [int(abs(sin(i + 1)) * 2 ** 32) for i in range(64)]
_TURNS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_WORDS = [*range(16), *((5 * i + 1) % 16 for i in range(16)), *((3 * i + 5) % 16 for i in range(16)), *((7 * i) % 16 for i in range(16))]
_TENS = 10 ** np.arange(1, 19)
_TILE = 16384       # keys that are hashed at once


def _first52(words: list, n: int) -> np.ndarray:
    """The first 52 bits of the md5 of ``n`` texts of one block each; a word that all texts share is a number."""
    u32 = np.uint32
    a, b, c, d = (np.full(n, x, u32) for x in (0x67452301, 0xefcdab89, 0x98badcfe, 0x10325476))
    t = np.empty(n, u32)
    for i in range(64):
        if i < 32:
            x, y, z = (c, d, b) if i < 16 else (b, c, d)
            np.bitwise_xor(x, y, out=t)
            t &= z
            t ^= y
        elif i < 48:
            np.bitwise_xor(b, c, out=t)
            t ^= d
        else:
            np.bitwise_not(d, out=t)
            t |= b
            t ^= c
        w = words[_WORDS[i]]
        t += a
        if isinstance(w, int):
            t += u32((w + _SINES[i]) & 0xffffffff)
        else:
            t += w
            t += u32(_SINES[i])
        np.left_shift(t, u32(_TURNS[i]), out=a)
        t >>= u32(32 - _TURNS[i])
        a |= t
        a += b
        a, b, c, d = d, a, b, c
    a += u32(0x67452301)
    b += u32(0xefcdab89)
    return ((a.byteswap().astype(np.uint64) << np.uint64(32)) | b.byteswap()) >> np.uint64(12)


def _words(parts: list, digits: list[int]) -> list:
    """The md5 block of texts made of ``parts``: bytes, and numbers of so many digits each."""
    words, at, digits = [0] * 16, 0, iter(digits)

    def put(x):
        nonlocal at
        w, shift = words[at >> 2], 8 * (at & 3)
        words[at >> 2] = w + (x << shift) if isinstance(x, int) and isinstance(w, int) else w + np.uint32(x << shift) if isinstance(x, int) else (x << np.uint32(shift)) + (np.uint32(w) if isinstance(w, int) else w)
        at += 1
    for x in parts:
        if isinstance(x, bytes):
            for c in x:
                put(c)
            continue
        n = next(digits)
        x = x.astype(np.uint32 if n < 10 else np.uint64)
        found = []
        for _ in range(n):
            q = x // x.dtype.type(10)
            found.append((x - q * x.dtype.type(10)).astype(np.uint32) + np.uint32(48))
            x = q
        for x in reversed(found):
            put(x)
    length = at
    put(128)
    words[14] = length * 8
    return words


def uniforms(*parts) -> np.ndarray:
    """``uniform`` of very many keys, whose texts are ``parts`` one after the other: strings, and arrays of numbers from 0 on."""
    parts = [x.encode() if isinstance(x, str) else x for x in parts]
    numbers = [x for x in parts if not isinstance(x, bytes)]
    fixed = sum(len(x) for x in parts if isinstance(x, bytes))
    out = np.empty(len(numbers[0]))
    digits = [np.searchsorted(_TENS, x, side="right") + 1 for x in numbers]
    kind = sum(d * 32 ** m for m, d in enumerate(digits))
    for k in np.unique(kind):
        every = np.flatnonzero(kind == k)
        size = [int(d[every[0]]) for d in digits]
        for s in range(0, len(every), _TILE):
            at = every[s:s + _TILE]
            part = [x if isinstance(x, bytes) else x[at] for x in parts]
            if fixed + sum(size) > 55:      # more than one block
                texts = zip(*[[x] * len(at) if isinstance(x, bytes) else [b"%d" % v for v in x.tolist()] for x in part])
                bits = np.frombuffer(b"".join([md5(b"".join(t)).digest()[:8] for t in texts]), ">u8") >> np.uint64(12)
            else:
                bits = _first52(_words(part, size), len(at))
            out[at] = bits.astype(float) / 2.0 ** 52
    return out


def _places(head: str, first: int, last: int, size: int) -> np.ndarray:
    """floor(uniform * size) of the draws ``head``first to ``head``last: ``uniform`` for very many keys that differ in their last part."""
    if last - first >= 256:
        return np.floor(uniforms(head, np.arange(first, last + 1)) * size).astype(np.int64)
    text = head.encode()
    keys = b"".join([md5(b"%b%d" % (text, k)).digest()[:8] for k in range(first, last + 1)])
    return np.floor((np.frombuffer(keys, ">u8") >> np.uint64(12)).astype(float) / 2.0 ** 52 * size).astype(np.int64)


def places(head: Column, first: Column, last: Column, size: Column) -> Column:
    """Array of the places 0..size-1 of the draws numbered first to last, in order (``head``: ``_head`` of what they share)."""
    @F.pandas_udf("array<long>")
    def run(h: pd.Series, a: pd.Series, b: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([_places(*x) for x in zip(h, a.tolist(), b.tolist(), n.tolist())])
    return run(head, first.cast("long"), last.cast("long"), size.cast("long"))


def place_counts(head: Column, n: Column, size: Column) -> Column:
    """Array of ``size`` counts: how many of the draws 1..n fall in each place."""
    @F.pandas_udf("array<long>")
    def run(h: pd.Series, b: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([np.bincount(_places(x, 1, y, z), minlength=z) for x, y, z in zip(h, b.tolist(), n.tolist())])
    return run(head, n.cast("long"), size.cast("long"))


def poisson1(u: Column, tail: int = 12) -> Column:
    """Poisson(1) count of a uniform by inversion (exact up to 2^-52, the draw's own resolution)."""
    p, c, out = 0.36787944117144233, 0.0, F.lit(0)
    for k in range(tail):
        c += p
        out = out + F.when(u >= F.lit(c), 1).otherwise(0)
        p /= k + 1
    return out


ITEMS = 32          # of so many items each has a draw of its own
TRIES = 6           # a try fails with a chance below 1 %, so six fail with one below 1e-12


def _gamma(shape: Column, seed, *parts) -> Column:
    """Gamma(shape) for shapes of 16 and more: the first accepted try of a cubed normal (rejection against the exact density)."""
    d = shape - F.lit(1.0 / 3.0)
    head = _head(seed, *parts)

    def attempt(got: Column, t: Column) -> Column:
        u = [_number(F.md5(F.concat(head, F.lit(f"{k}|"), t.cast("string")))) + F.lit(2.0 ** -53) for k in range(3)]
        x = F.sqrt(F.lit(-2.0) * F.log(u[0])) * F.cos(F.lit(6.283185307179586) * u[1])
        tried = _bound(_bound(x, lambda x: F.struct(x.alias("x"), F.pow(F.lit(1.0) + x / F.sqrt(F.lit(9.0) * d), F.lit(3.0)).alias("v"), F.log(u[2]).alias("lu"))), lambda s: F.when(
            (s["v"] > 0) & (s["lu"] < F.lit(0.5) * s["x"] * s["x"] + d - d * s["v"] + d * F.log(F.greatest(s["v"], F.lit(1e-300)))), d * s["v"]))
        return F.when(got.isNotNull(), got).otherwise(tried)
    return F.coalesce(F.aggregate(F.sequence(F.lit(1), F.lit(TRIES)), F.lit(None).cast("double"), attempt), d)


def binomial(n, p: float, seed, *parts) -> Column:
    """Binomial(n, p) of a row, exact in distribution, in O(log n) steps and without an array as long as n.

    The middle one of n uniforms in order is a Beta draw; whether it lies below p decides for half of the items at once
    and leaves the same question for the other half. The last ``ITEMS`` items have a draw each."""
    n = _col(n).cast("long")
    half = lambda s: F.floor((s["n"] + 1) / 2).cast("long")

    def step(s: Column, level: Column) -> Column:
        i = half(s).cast("double")
        a, b = _gamma(i, seed, *parts, F.lit("a"), level), _gamma(s["n"].cast("double") + 1 - i, seed, *parts, F.lit("b"), level)
        split = _bound(_bound(F.struct(a.alias("a"), b.alias("b")), lambda g: g["a"] / (g["a"] + g["b"])), lambda y: F.when(
            y <= s["p"], F.struct((s["n"] - half(s)).alias("n"), ((s["p"] - y) / (F.lit(1.0) - y)).alias("p"), (s["k"] + half(s)).alias("k"))).otherwise(
            F.struct((half(s) - 1).alias("n"), (s["p"] / y).alias("p"), s["k"].alias("k"))))
        return F.when(s["n"] > ITEMS, split).otherwise(s)
    start = F.struct(n.alias("n"), F.lit(float(p)).alias("p"), F.lit(0).cast("long").alias("k"))
    levels = F.when(n > ITEMS, F.sequence(F.lit(1), F.ceil(F.log2(n.cast("double"))).cast("int") - 4)).otherwise(F.array().cast("array<int>"))
    rest = F.aggregate(levels, start, step)
    # the items that are left, each with its own draw; what their draws share is made once
    items = lambda s: F.when(s["n"] > 0, F.aggregate(F.sequence(F.lit(1).cast("long"), s["n"]), s["k"], lambda acc, j: acc + F.when(F.md5(F.concat(s["head"], j.cast("string"))) < s["edge"], 1).otherwise(0))).otherwise(s["k"])
    return _bound(_bound(rest, lambda s: F.struct(s["n"].alias("n"), s["k"].alias("k"), _edge(s["p"]).alias("edge"), _head(seed, *parts).alias("head"))), items)

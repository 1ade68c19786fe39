"""Constant lookup tables inside Spark expressions.

A long array literal is sent as one string that the optimizer folds into an array, and holds a two-place hash table
(each key sits at key mod p or at key mod q), so that a lookup costs two array accesses however many keys there are;
Spark's own map literals are searched from the front.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _primes(least: int) -> tuple[int, int]:
    found, n = [], max(11, least) | 1
    while len(found) < 2:
        if all(n % d for d in range(3, int(n**0.5) + 1, 2)):
            found.append(n)
        n += 2
    return found[0], found[1]


def two_place(keys: list[int]) -> tuple[int, int, list[int | None], list[int | None]]:
    """(p, q, first table, second table) with the index of each key at key mod p or key mod q."""
    size = int(1.3 * len(keys)) + 11
    while True:
        p, q = _primes(size)
        tables: tuple[list[int | None], list[int | None]] = ([None] * p, [None] * q)
        for i in range(len(keys)):
            held, side = i, 0
            for _ in range(500):
                at = keys[held] % (p, q)[side]
                held, tables[side][at] = tables[side][at], held
                if held is None:
                    break
                side ^= 1
            if held is not None:
                break
        else:
            return p, q, *tables
        size = int(size * 1.3)


def displaced(values: dict[tuple[int, int], int], size: int) -> tuple[list[int], list[int]]:
    """(d, r) such that r[d[a] + b] ^ (a + 1 << 20) is the value of (a, b), and at least 2**20 if there is none.

    The sparse rows of the table of all pairs (a, b < size, values below 2**20, a never size - 1) are laid over each
    other, each moved by d[a] to where its entries meet free places; an entry names its row.
    """
    rows: dict[int, list[int]] = {}
    for a, b in values:
        rows.setdefault(a, []).append(b)
    free = np.ones(4 * (size + len(values)), bool)
    d = [0] * size
    at, last = 0, 0
    for a in sorted(rows, key=lambda a: (-len(rows[a]), a)):
        b = np.array(rows[a])
        if len(b) != last:  # rows of one length look on from where the one before found its place
            at, last = 0, len(b)
        while True:
            fits = free[(at + np.arange(512))[:, None] + b].all(axis=1)
            if fits.any():
                break
            at += 512
        d[a] = at = at + int(fits.argmax())
        free[at + b] = False
    r = [0] * (max(d) + size)  # short as text, since plans are described in full
    for (a, b), value in values.items():
        r[d[a] + b] = a + 1 << 20 | value
    return d, r


def longs(values: list[int]) -> Column:
    """An array<bigint> literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")

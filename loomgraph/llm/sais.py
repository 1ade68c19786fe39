"""Suffix arrays by induced sorting, and permuted common prefixes."""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: list[int], top: int) -> list[int]:
    """The suffix array of `symbols` (values 0..top) in linear time.

    Suffixes are classified as smaller (S) or larger (L) than their right neighbour; the leftmost-S substrings are
    sorted by induction and named; if names repeat, the string of names is sorted recursively; the order of all other
    suffixes is induced from that of the leftmost-S ones.
    """
    n = len(symbols)
    if n < 2:
        return list(range(n))
    small = bytearray(n + 1)
    small[n] = 1
    for i in range(n - 2, -1, -1):
        a, b = symbols[i], symbols[i + 1]
        small[i] = a < b or (a == b and small[i + 1])
    count = [0] * (top + 2)
    for c in symbols:
        count[c + 1] += 1
    for c in range(top + 1):
        count[c + 1] += count[c]
    leftmost = [i for i in range(1, n) if small[i] and not small[i - 1]]

    def induce(order: list[int]) -> list[int]:
        out = [-1] * n
        end = count[1:]
        for i in reversed(order):
            c = symbols[i]
            end[c] -= 1
            out[end[c]] = i
        head = count[:-1]
        c = symbols[n - 1]  # the last suffix follows the end of the string, the least of all
        out[head[c]] = n - 1
        head[c] += 1
        for k in range(n):
            j = out[k] - 1
            if j >= 0 and not small[j]:
                c = symbols[j]
                out[head[c]] = j
                head[c] += 1
        end = count[1:]
        for k in range(n - 1, -1, -1):
            j = out[k] - 1
            if j >= 0 and small[j]:
                c = symbols[j]
                end[c] -= 1
                out[end[c]] = j
        return out

    order = [i for i in induce(leftmost) if i > 0 and small[i] and not small[i - 1]]
    if len(order) > 1:
        follows = dict(zip(leftmost, leftmost[1:] + [n - 1]))
        name, names = 0, {order[0]: 0}
        for a, b in zip(order, order[1:]):
            x, y = symbols[a : follows[a] + 1], symbols[b : follows[b] + 1]
            name += x != y or follows[a] == n - 1 or follows[b] == n - 1
            names[b] = name
        if name + 1 < len(order):
            order = [leftmost[i] for i in suffix_array([names[i] for i in leftmost], name)]
    return induce(order)


def permuted_common_prefixes(data: bytes | list[int], order: list[int]) -> list[int]:
    """For each position of `data`, the common prefix of its suffix with the suffix before it in `order`."""
    n = len(data)
    before = [-1] * n
    for a, b in zip(order, order[1:]):
        before[b] = a
    out, h = [0] * n, 0
    for i in range(n):
        j = before[i]
        if j < 0:
            h = 0
            continue
        while i + h < n and j + h < n and data[i + h] == data[j + h]:
            h += 1
        out[i] = h
        h = max(0, h - 1)
    return out


def repeated_starts(texts: list[bytes], length: int, origins: list[tuple] | None = None) -> list[np.ndarray]:
    """For each text, a flag per byte: does the string of `length` bytes from there also start anywhere else?

    All texts form one string in which the k-th is followed by a separator of its own (symbols above 255), so that no
    common prefix crosses a text.  `origins` gives (owner, position) of each text where texts may overlap in their
    owners: starts at the same place of the same owner are one start.
    """
    symbols: list[int] = []
    place: list[tuple] = []
    for k, t in enumerate(texts):
        owner, at = origins[k] if origins else (k, 0)
        symbols.extend(t)
        symbols.append(256 + k)
        place.extend((owner, at + i) for i in range(len(t) + 1))
    order = suffix_array(symbols, 255 + max(1, len(texts)))
    common = permuted_common_prefixes(symbols, order)
    flags = np.zeros(len(symbols), bool)
    run: list[int] = []
    for i in [*order, -1]:
        if i >= 0 and run and common[i] >= length:
            run.append(i)
            continue
        if len(run) > 1 and len({place[j] for j in run}) > 1:
            flags[run] = True
        run = [i]
    out, at = [], 0
    for t in texts:
        out.append(flags[at : at + len(t)])
        at += len(t) + 1
    return out

"""Suffix arrays by the difference cover modulo three, on numpy arrays.

Suffixes that start at positions 1 and 2 modulo three are the sample. Their triples are sorted and
named; where names repeat, the string of names is ranked by recursion. The remaining suffixes sort
by their first symbol and the rank behind it, and both merge, since any two suffixes meet a pair of
sampled ones one or two symbols on. Recursion ends early once a name spans the prefix that is asked.
"""

from __future__ import annotations

import numpy as np


def _keys(*columns: np.ndarray) -> np.ndarray:
    """One number a row that orders rows as their columns, in turn, do."""
    key, bits = columns[0].astype(np.uint64), int(columns[0].max(initial=0)).bit_length()
    for column in columns[1:]:
        more = int(column.max(initial=0)).bit_length()
        if bits + more > 64:  # too wide side by side: names in order take the place of what is there
            key = np.unique(key, return_inverse=True)[1].astype(np.uint64)
            bits = int(key.max(initial=0)).bit_length()
        key = (key << np.uint64(more)) | column.astype(np.uint64)
        bits += more
    return key


def _below(keys: np.ndarray, others: np.ndarray) -> np.ndarray:
    """For each of ``keys``, how many of ``others`` are less."""
    order = np.argsort(keys, kind="stable")
    counts = np.empty(len(keys), np.int64)
    counts[order] = np.searchsorted(np.sort(others), keys[order], "left")
    return counts


def suffix_ranks(symbols: np.ndarray, prefix: int, reach: int = 1) -> np.ndarray:
    """A rank for the suffix at each position, in lexicographic order.

    Symbols are positive. Suffixes of different first ``prefix`` units never share a rank, and rank
    as those prefixes do; a symbol stands for ``reach`` units.
    """
    n = len(symbols)
    if n < 3 or reach >= prefix:
        if n < 3 and reach < prefix:
            tails = [tuple(symbols[i:].tolist()) for i in range(n)]
            return np.array([sorted(tails).index(t) + 1 for t in tails], np.int64)
        return np.unique(symbols, return_inverse=True)[1].astype(np.int64) + 1
    padded = np.concatenate([symbols.astype(np.int64), np.zeros(4, np.int64)])

    # Names of the sampled triples; an extra sample at the end keeps both halves apart.
    ones = np.arange(1, n + 1 if n % 3 == 1 else n, 3)
    twos = np.arange(2, n, 3)
    sample = np.concatenate([ones, twos])
    names = np.unique(_keys(padded[sample], padded[sample + 1], padded[sample + 2]),
                      return_inverse=True)[1].astype(np.int64) + 1
    if names.max() < len(sample):
        names = suffix_ranks(names, prefix, reach * 3)
    rank = np.zeros(n + 4, np.int64)
    rank[sample] = names

    # Merge: the rest meet positions 1 one symbol on, positions 2 two symbols on.
    rest = np.arange(0, n, 3)
    ones = ones[ones < n]
    with_ones, with_twos = np.concatenate([rest, ones]), np.concatenate([rest, twos])
    near = _keys(padded[with_ones], rank[with_ones + 1])
    far = _keys(padded[with_twos], padded[with_twos + 1], rank[with_twos + 2])
    k = len(rest)
    result = np.empty(n, np.int64)
    result[rest] = _below(near[:k], near) + _below(far[:k], far[k:])
    inside = np.concatenate([ones, twos])
    among = _below(rank[inside], rank[inside])
    result[ones] = among[:len(ones)] + _below(near[k:], near[:k])
    result[twos] = among[len(ones):] + _below(far[k:], far[:k])
    return result + 1


def words_at(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number; the text must be padded by seven."""
    word = text[:-7].astype(np.uint64)
    for i in range(1, 8):
        word = (word << np.uint64(8)) | text[i:len(text) - 7 + i]
    return word


def first_starts(text: bytes, starts: np.ndarray, length: int) -> np.ndarray:
    """For each start, the least start of ``starts`` whose next ``length`` bytes are the same.

    Every start has ``length`` bytes left in the text. Starts are put in suffix order and each is
    compared with its neighbour.
    """
    if not len(starts):
        return starts
    raw = np.frombuffer(text, np.uint8)
    ranks = suffix_ranks(raw.astype(np.int64) + 1, length)
    order = starts[np.lexsort((starts, ranks[starts]))]
    words = words_at(np.concatenate([raw, np.zeros(8, np.uint8)]))
    same = np.ones(len(order) - 1, bool)
    offsets = [*range(0, length - 7, 8), length - 8] if length >= 8 else []
    for offset in offsets:
        i = np.flatnonzero(same)
        same[i] = words[order[i] + offset] == words[order[i + 1] + offset]
    if length < 8:
        mask = np.uint64(64 - 8 * length)
        same = (words[order[:-1]] >> mask) == (words[order[1:]] >> mask)
    heads = np.concatenate([[0], np.flatnonzero(~same) + 1])
    least = np.minimum.reduceat(order, heads)
    found = np.empty(len(raw), np.int64)
    found[order] = np.repeat(least, np.diff(np.append(heads, len(order))))
    return found[starts]

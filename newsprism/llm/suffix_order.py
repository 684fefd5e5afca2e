"""Suffix order of a sequence of numbers by prefix doubling (Manber and Myers),
sorting only suffixes that are not yet alone."""

from __future__ import annotations

import numpy as np


def suffix_order(values: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes of ``values`` in lexicographic order.

    ``values`` are non-negative and end with one that occurs nowhere else.
    Values that occur once (separators, say) end every comparison, so sequences
    laid end to end with a separator of its own after each never run over."""
    n = len(values)
    if n == 0:
        return np.zeros(0, np.int64)
    values = values.astype(np.int64)
    bits = max(1, int(values.max()).bit_length())
    h = max(1, min(4, 63 // bits, n))
    key = values.copy()
    for k in range(1, h):
        key <<= bits
        key[:n - k] |= values[k:]
    order = np.argsort(key)
    key = key[order]
    slots = np.arange(n)
    rank = np.empty(n, np.int64)
    while True:
        new = np.ones(len(slots), bool)
        new[1:] = key[1:] != key[:-1]
        at = order[slots]
        rank[at] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        alone = new.copy()
        alone[:-1] &= new[1:]
        slots = slots[~alone]
        if not len(slots):
            return order
        at = order[slots]
        # a suffix that is not alone has no single value among its first h, so at + h exists
        key = rank[at] * n + rank[at + h]
        by = np.argsort(key)
        order[slots], key = at[by], key[by]
        h *= 2

"""Byte-pair merging with a heap of candidate pairs and a linked list of symbols."""

from __future__ import annotations

from collections.abc import Callable
from heapq import heapify, heappop, heappush

Priority = Callable[[str, str], float | None]


def merge(symbols: list[str], priority: Priority) -> list[str]:
    """Merge adjacent symbols, the lowest priority value first and the leftmost of equals, until no pair has one."""
    n = len(symbols)
    if n < 2:
        return symbols
    symbols = list(symbols)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = []
    for i in range(n - 1):
        value = priority(symbols[i], symbols[i + 1])
        if value is not None:
            heap.append((value, i, symbols[i], symbols[i + 1]))
    heapify(heap)
    while heap:
        _, i, left, right = heappop(heap)
        j = after[i] if symbols[i] else n
        # Out of date if either symbol has been merged since.
        if j >= n or symbols[i] != left or symbols[j] != right:
            continue
        symbols[i], symbols[j] = left + right, ""
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            value = priority(symbols[i], symbols[k])
            if value is not None:
                heappush(heap, (value, i, symbols[i], symbols[k]))
        h = before[i]
        if h >= 0:
            value = priority(symbols[h], symbols[i])
            if value is not None:
                heappush(heap, (value, h, symbols[h], symbols[i]))
    return [symbol for symbol in symbols if symbol]


def count_merges(symbols: list[str], priority: Priority) -> int:
    return len(symbols) - len(merge(symbols, priority))

"""Shortest join paths over declared foreign keys, on the driver: the graph has one edge per key."""

from __future__ import annotations

import heapq

from quillstone.sources.tables import FOREIGN_KEYS, ForeignKey

#: A key whose column names its target is the likelier way.
NAMED, OTHER = 0.75, 1.25


def weight(key: ForeignKey) -> float:
    return NAMED if key.target.rstrip("s")[:4] in key.column.lower() else OTHER


def join_path(start: str, end: str, keys: tuple[ForeignKey, ...] = FOREIGN_KEYS) -> list[ForeignKey]:
    """Keys to follow, in either direction, from start to end. Raises if there is no way."""
    if start == end:
        return []
    heap: list[tuple[float, int, str, list[ForeignKey]]] = [(0.0, 0, start, [])]
    done, n = set(), 0
    while heap:
        cost, _, at, path = heapq.heappop(heap)
        if at == end:
            return path
        if at in done:
            continue
        done.add(at)
        for k in keys:
            for here, there in ((k.table, k.target), (k.target, k.table)):
                if here == at and there not in done:
                    n += 1
                    heapq.heappush(heap, (cost + weight(k), n, there, [*path, k]))
    raise ValueError(f"no join path from {start} to {end}")


def closure(tables: set[str], hops: int = 4, keys: tuple[ForeignKey, ...] = FOREIGN_KEYS) -> set[str]:
    """The tables and those on the shortest paths of at most `hops` keys between them."""
    out, names = set(tables), sorted(tables)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            try:
                path = join_path(a, b, keys)
            except ValueError:
                continue
            if len(path) <= hops:
                out |= {t for k in path for t in (k.table, k.target)}
    return out

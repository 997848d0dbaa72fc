"""Minimum cuts of small graphs with terminals, by augmenting along shortest paths with level graphs."""

from __future__ import annotations

from collections import deque

TINY = 1e-9


def minimum_cut(to_source: list[float], to_sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """For each node whether it lies on the source side of a minimum cut.

    to_source[i] is paid if node i is cut from the source, to_sink[i] if it is cut from the sink, and an edge's capacity if its
    ends are parted.
    """
    n = len(to_source)
    source, sink = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[float] = []

    def link(a: int, b: int, there: float, back: float) -> None:
        head[a].append(len(to))
        to.append(b)
        room.append(there)
        head[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, (s, t) in enumerate(zip(to_source, to_sink, strict=True)):
        if s > t:  # what both terminals take is paid in any cut
            link(source, i, s - t, 0.0)
        elif t > s:
            link(i, sink, t - s, 0.0)
    for a, b, c in edges:
        if c > 0 and a != b:
            link(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            v = queue.popleft()
            for e in head[v]:
                if room[e] > TINY and level[to[e]] < 0:
                    level[to[e]] = level[v] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        at = [0] * (n + 2)
        path: list[int] = []
        v = source
        while True:
            if v == sink:
                least = min(room[e] for e in path)
                cut = 0
                for k, e in enumerate(path):
                    room[e] -= least
                    room[e ^ 1] += least
                    if room[e] <= TINY and not cut:
                        cut = k + 1
                v = to[path[cut - 1] ^ 1]
                del path[cut - 1 :]
                continue
            while at[v] < len(head[v]):
                e = head[v][at[v]]
                if room[e] > TINY and level[to[e]] == level[v] + 1:
                    break
                at[v] += 1
            if at[v] < len(head[v]):
                path.append(head[v][at[v]])
                v = to[path[-1]]
            elif path:
                level[v] = -1
                e = path.pop()
                v = to[e ^ 1]
                at[v] += 1
            else:
                break

"""One-to-one assignment: of the rows of a small cost matrix, or of lists of the pairs that may be made."""

from __future__ import annotations

import heapq

import numpy as np


SMALL = 64  # entries up to which plain numbers are faster than arrays


def optimal(cost) -> list[tuple[int, int]]:
    """Pairs (row, column) of least total cost, as many as the shorter side has: shortest augmenting paths."""
    cost = np.asarray(cost, float)
    if not cost.size:
        return []
    if min(cost.shape) == 1:
        return [divmod(int(cost.argmin()), cost.shape[1])]
    if cost.size <= SMALL and not np.isnan(cost).any():
        return optimal_of(cost.tolist())
    turned = cost.shape[0] > cost.shape[1]
    c = cost.T if turned else cost
    n, m = c.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while match[j0]:
            used[j0] = True
            i0 = match[j0]
            free = np.flatnonzero(~used[1:]) + 1
            now = c[i0 - 1, free - 1] - u[i0] - v[free]
            better = now < least[free]
            least[free[better]], way[free[better]] = now[better], j0
            j1 = int(free[np.argmin(least[free])])
            d = least[j1]
            u[match[used]] += d
            v[used] -= d
            least[~used] -= d
            j0 = j1
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    pairs = [(match[j] - 1, j - 1) for j in range(1, m + 1) if match[j]]
    return sorted((b, a) if turned else (a, b) for a, b in pairs)


def optimal_of(cost: list[list[float]]) -> list[tuple[int, int]]:
    """`optimal` of a small matrix without NaN, as lists: the same steps with plain numbers."""
    n, m = len(cost), len(cost[0])
    if n == 1 or m == 1:
        _, i, j = min((x, i, j) for i, row in enumerate(cost) for j, x in enumerate(row))
        return [(i, j)]
    turned = n > m
    if turned:
        cost, n, m = [list(x) for x in zip(*cost, strict=True)], m, n
    best = [row.index(min(row)) for row in cost]
    if len(set(best)) == n and all(row.count(row[j]) == 1 for row, j in zip(cost, best, strict=True)):  # no other assignment is as cheap
        return sorted((j, i) if turned else (i, j) for i, j in enumerate(best))
    u, v, match = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, way, used = [_INF] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while match[j0]:
            used[j0] = True
            i0 = match[j0]
            row, off, d, j1 = cost[i0 - 1], u[i0], _INF, 0
            for j in range(1, m + 1):
                if not used[j]:
                    now = row[j - 1] - off - v[j]
                    if now < least[j]:
                        least[j], way[j] = now, j0
                    if least[j] < d or not j1:
                        d, j1 = least[j], j
            for j in range(m + 1):
                if used[j]:
                    u[match[j]] += d
                    v[j] -= d
                else:
                    least[j] -= d
            j0 = j1
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    return sorted((j - 1, match[j] - 1) if turned else (match[j] - 1, j - 1) for j in range(1, m + 1) if match[j])


_INF = float("inf")


def plain(cost: list[list[float]]) -> bool:
    """Whether a matrix of lists is a small one without NaN."""
    return len(cost) * len(cost[0]) <= SMALL and all(x == x for row in cost for x in row)


def within(cost, limit: float) -> list[tuple[int, int]]:
    """The optimal assignment where leaving both sides alone costs `limit`: pairs over it are never made."""
    if isinstance(cost, list):
        if cost and cost[0] and plain(cost):
            return _within_of(cost, limit)
    cost = np.asarray(cost, float)
    if not cost.size:
        return []
    n, m = cost.shape
    if min(n, m) == 1:
        i, j = divmod(int(cost.argmin()), m)
        return [(i, j)] if cost[i, j] <= limit else []
    wide = np.full((n + m, n + m), limit / 2)
    wide[n:, m:] = 0
    wide[:n, :m] = cost
    return [(i, j) for i, j in optimal(wide) if i < n and j < m and cost[i, j] <= limit]


def _within_of(cost: list[list[float]], limit: float) -> list[tuple[int, int]]:
    n, m = len(cost), len(cost[0])
    if n == 1 or m == 1:
        (i, j), *_ = optimal_of(cost)
        return [(i, j)] if cost[i][j] <= limit else []
    half = limit / 2
    wide = [row + [half] * n for row in cost] + [[half] * m + [0.0] * n for _ in range(m)]
    return [(i, j) for i, j in optimal_of(wide) if i < n and j < m and cost[i][j] <= limit]


def greedy(cost, limit: float) -> list[tuple[int, int]]:
    """Again and again the least entry under `limit` (row by row on ties), then without its row and column."""
    out = []
    if isinstance(cost, list) and cost and cost[0] and plain(cost):
        rows, columns = set(), set()
        for _, i, j in sorted((x, i, j) for i, row in enumerate(cost) for j, x in enumerate(row) if x < limit):
            if i not in rows and j not in columns:
                rows.add(i)
                columns.add(j)
                out.append((i, j))
        return out
    cost = np.array(cost, float)
    while cost.size and cost.min() < limit:
        i, j = divmod(int(cost.argmin()), cost.shape[1])
        out.append((i, j))
        cost[i, :] = cost[:, j] = np.inf
    return out


def parts_of(rows: list[int], columns: list[int]) -> list[int]:
    """For each pair, which connected part of the graph of all pairs it is in."""
    up: dict = {}

    def root(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i, j in zip(rows, columns, strict=True):
        up[root((0, i))] = root((1, j))
    number: dict = {}
    return [number.setdefault(root((0, i)), len(number)) for i in rows]


def sparse(rows: list[int], columns: list[int], costs: list[float], limit: float) -> list[tuple[int, int, float]]:
    """`within` for listed pairs: row, column and cost of those that are made. Pairs that aren't listed are never made.

    Each connected part is solved by itself, by shortest augmenting paths over the rows' lists; a row may end such a path by
    staying alone, at the price of `limit`. Of a pair that is listed twice the cheaper one counts.
    """
    parts: dict[int, dict] = {}
    for part, i, j, c in zip(parts_of(rows, columns), rows, columns, costs, strict=True):
        if c <= limit:
            own = parts.setdefault(part, {}).setdefault(i, {})
            own[j] = min(c, own.get(j, c))
    out = []
    for part in parts.values():
        out += _augmented(part, limit)
    return sorted(out)


def _augmented(near: dict[int, dict[int, float]], limit: float) -> list[tuple[int, int, float]]:
    u = {i: min(own.values()) for i, own in near.items()}
    v: dict[int, float] = {}
    by_row: dict[int, int] = {}
    by_column: dict[int, int] = {}
    for start in near:
        dist, before, done, seen, heap = {}, {}, {}, [(start, 0.0)], []
        row, so_far, best, end, alone = start, 0.0, float("inf"), None, None
        while True:
            stay = so_far + limit - u[row]
            if stay < best:
                best, alone = stay, row
            for j, c in near[row].items():
                if j not in done:
                    d = so_far + c - u[row] - v.get(j, 0.0)
                    if d <= best and d < dist.get(j, float("inf")):
                        dist[j], before[j] = d, row
                        heapq.heappush(heap, (d, j))
            while heap and (heap[0][1] in done or heap[0][0] > dist[heap[0][1]]):
                heapq.heappop(heap)
            if not heap or heap[0][0] > best:
                break
            so_far, j = heapq.heappop(heap)
            done[j] = so_far
            if j not in by_column:
                best, end = so_far, j
                break
            row = by_column[j]
            seen.append((row, so_far))
        for i, d in seen:
            u[i] += max(0.0, best - d)
        for j, d in done.items():
            v[j] = v.get(j, 0.0) - max(0.0, best - d)
        j = end if end is not None else by_row.pop(alone, None)
        while j is not None:  # along the path, each row takes the column it was found by
            i = before[j]
            j_next = by_row.get(i)
            by_row[i], by_column[j] = j, i
            j = j_next
    return [(i, j, near[i][j]) for i, j in by_row.items()]

"""Numpy kernels of the sequential steps: greedy selection and exact assignment."""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np


def farthest_first(row: Callable[[int], np.ndarray], n: int, seed: int, m: int, stop: Callable[[list[int], float], bool] | None = None) -> tuple[list[int], list[float]]:
    """Picks (the seed first, then the place farthest from all picks, ties to the lower) and each pick's distance when picked."""
    picks, radii = [seed], [np.inf]
    gap = row(seed).astype(float).copy()
    gap[seed] = -1.0
    while len(picks) < min(m, n):
        at = int(gap.argmax())
        if stop and stop(picks, float(gap[at])):
            break
        picks.append(at)
        radii.append(float(gap[at]))
        np.minimum(gap, row(at), out=gap)
        gap[picks] = -1.0
    return picks, radii


def weighted_first(row: Callable[[int], np.ndarray], n: int, seed: int, m: int, random_state: int) -> list[int]:
    """D-squared picks: each drawn with a chance proportional to its squared distance from the picks."""
    rng = np.random.RandomState(random_state + 1337)
    picks, gap = [seed], row(seed).astype(float) ** 2
    while len(picks) < min(m, n):
        gap[picks] = 0.0
        total = gap.sum()
        if total > 0:
            at = int(rng.choice(n, p=gap / total))
        else:
            at = int(rng.choice(np.setdiff1d(np.arange(n), picks)))
        picks.append(at)
        gap = np.minimum(gap, row(at).astype(float) ** 2)
    return picks


def assign(cost: np.ndarray) -> np.ndarray:
    """For each row its column in an assignment of least total cost (rows <= columns): shortest augmenting paths."""
    n, m = cost.shape
    if n > m:
        raise ValueError("more rows than columns")
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    owner = np.zeros(m + 1, int)  # row of each column, from 1; column 0 holds the row being placed
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        least, came, done = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while True:
            done[j0] = True
            gap = cost[owner[j0] - 1] - u[owner[j0]] - v[1:]
            open_ = ~done[1:]
            better = open_ & (gap < least[1:])
            least[1:][better] = gap[better]
            came[1:][better] = j0
            j1 = int(np.where(open_, least[1:], np.inf).argmin()) + 1
            step = least[j1]
            u[owner[done]] += step
            v[done] -= step
            least[1:][open_] -= step
            j0 = j1
            if owner[j0] == 0:
                break
        while j0:
            owner[j0] = owner[came[j0]]
            j0 = came[j0]
    out = np.empty(n, int)
    taken = owner[1:] > 0
    out[owner[1:][taken] - 1] = np.flatnonzero(taken)
    return out


def match(cost: np.ndarray, ratio: int = 1, capacity: int = 1) -> list[tuple[int, int]]:
    """(row, column) pairs of least total cost: each row has ``ratio`` different columns, a column serves ``capacity`` rows at most.

    Successive shortest paths over unit arcs (Bellman-Ford on the residual network, in numpy).
    """
    n, m = cost.shape
    if ratio == 1 and capacity == 1:
        return list(enumerate(assign(cost).tolist()))
    if n * ratio > m * capacity or ratio > m:
        raise ValueError("not enough columns")
    used, load = np.zeros((n, m), bool), np.zeros(m, int)
    for i in [r for _ in range(ratio) for r in range(n)]:
        far_row, far_col = np.full(n, np.inf), np.full(m, np.inf)
        from_row, from_col = np.full(m, -1), np.full(n, -1)
        far_row[i] = 0.0
        for _ in range(2 * (n + m)):
            reach = np.where(used, np.inf, far_row[:, None] + cost)
            best = reach.argmin(0)
            new = reach[best, np.arange(m)]
            better = new < far_col - 1e-12
            far_col[better], from_row[better] = new[better], best[better]
            back = np.where(used, far_col[None] - cost, np.inf)
            best = back.argmin(1)
            new = back[np.arange(n), best]
            moved = new < far_row - 1e-12
            far_row[moved], from_col[moved] = new[moved], best[moved]
            if not better.any() and not moved.any():
                break
        free = np.where(load < capacity, far_col, np.inf)
        j = int(free.argmin())
        if not np.isfinite(free[j]):
            raise ValueError("no feasible match")
        load[j] += 1
        while True:
            r = from_row[j]
            used[r, j] = True
            if r == i and far_row[r] == 0.0 and from_col[r] < 0:
                break
            j = from_col[r]
            used[r, j] = False
    return [(int(a), int(b)) for a, b in zip(*np.nonzero(used), strict=True)]


#: Bids of a row on average, before it is left to a search.
BIDS = 40


def match_edges(i: np.ndarray, j: np.ndarray, cost: np.ndarray, n: int, m: int, ratio: int = 1, capacity: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, set[int]]:
    """(chosen edges, row prices u, column prices v, rows that found no column) of a least-cost match over given edges.

    Edges are sorted by row, each once.  Successive shortest paths with prices (Dijkstra on the residual network):
    cost - u - v >= 0 off the match, <= 0 on it, v <= 0, and v = 0 for columns with room.  So an edge that was not
    given can improve the match only if its cost is below u + v.  Ends at the first row that finds no column.
    Where each row takes one column of its own, rows bid for columns first (BIDS a row, the bidden price being what makes
    the row's second choice as good), which leaves few of them to the searches.
    """
    start = np.searchsorted(i, np.arange(n + 1))
    u = np.array([cost[s:e].min() if e > s else 0.0 for s, e in zip(start[:-1], start[1:], strict=True)])
    v, load = np.zeros(m), np.zeros(m, int)
    used, into = np.zeros(len(i), bool), [[] for _ in range(m)]
    far, via, closed = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
    if ratio == capacity == 1:
        waiting, owned = list(range(n))[::-1], np.full(m, -1)
        for _ in range(BIDS * n):
            if not waiting:
                break
            row = waiting.pop()
            s, e = start[row], start[row + 1]
            if e - s < 2:  # these are left to the searches
                continue
            price = cost[s:e] - v[j[s:e]]
            at = int(price.argmin())
            least = price[at]
            price[at] = np.inf
            second, column, before = price.min(), j[s + at], owned[j[s + at]]
            if second <= least and before >= 0:
                continue
            u[row] = second
            v[column] -= second - least
            owned[column] = s + at
            if before >= 0:
                waiting.append(int(i[before]))
        chosen = owned[owned >= 0]
        used[chosen], load = True, (owned >= 0).astype(int)
        for edge in chosen.tolist():
            into[j[edge]].append(edge)
    placed = np.bincount(i[used], minlength=n)
    for row in [r for k in range(ratio) for r in range(n) if placed[r] <= k]:
        heap, row_far, row_via, opened, touched, order = [(0.0, 1, row)], {row: 0.0}, {}, {}, [], []
        best, end = np.inf, -1
        while heap:
            d, is_row, x = heapq.heappop(heap)
            if d >= best:
                break
            if is_row:
                if x in opened or d > row_far[x]:
                    continue
                opened[x] = d
                s, e = start[x], start[x + 1]
                to = j[s:e]
                new = d + np.maximum(cost[s:e] - u[x] - v[to], 0.0)
                at = np.flatnonzero((new < far[to]) & (new < best) & ~used[s:e] & ~closed[to])
                to, new = to[at], new[at]
                far[to], via[to] = new, at + s
                touched.append(to)
                room = load[to] < capacity
                if room.any():
                    k = int(np.where(room, new, np.inf).argmin())
                    best, end = float(new[k]), int(to[k])
                for y, dy in zip(to[~room].tolist(), new[~room].tolist(), strict=True):
                    if dy < best:
                        heapq.heappush(heap, (dy, 0, y))
            elif not closed[x] and d <= far[x]:
                closed[x] = True
                order.append(x)
                for edge in into[x]:
                    r = int(i[edge])
                    dr = d + max(0.0, float(u[r] + v[x] - cost[edge]))
                    if r not in opened and dr < row_far.get(r, np.inf):
                        row_far[r], row_via[r] = dr, edge
                        heapq.heappush(heap, (dr, 1, r))
        if end >= 0:
            for r, d in opened.items():
                u[r] += best - d
            if order:
                v[order] -= best - far[order]
            load[end] += 1
            while True:
                edge = int(via[end])
                used[edge] = True
                into[end].append(edge)
                r = int(i[edge])
                if r == row:
                    break
                edge = row_via[r]
                end = int(j[edge])
                used[edge] = False
                into[end].remove(edge)
        closed[order] = False
        for to in touched:
            far[to] = np.inf
        if not np.isfinite(best):
            return np.flatnonzero(used), u, v, set(opened)
    return np.flatnonzero(used), u, v, set()


#: Candidates that farthest_lazy takes at a time.
AHEAD = 2048


def foremost(ids: np.ndarray, x: np.ndarray, gap: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k rows of largest gap, ties to the lower id, in the order of ids (which are sorted)."""
    if len(ids) > k:
        least = np.partition(gap, len(gap) - k)[len(gap) - k]
        sure = np.flatnonzero(gap > least)
        at = np.sort(np.concatenate([sure, np.flatnonzero(gap == least)[: k - len(sure)]]))
        ids, x, gap = ids[at], x[at], gap[at]
    return ids, x, gap


def farthest_lazy(refill: Callable, dist: Callable, n: int, seed: int, vector: np.ndarray, m: int, stop: Callable[[list[np.ndarray], float], bool] | None = None) -> tuple[list[int], list[float]]:
    """The picks of farthest_first (ids and radii), with all rows visited once for many picks.

    refill(ids, vectors) takes the new picks into account and gives the AHEAD + 1 foremost rows.  Gaps only shrink, so
    picks among them hold for as long as the best of them is ahead of the last one's gap, which bounds all other rows.
    """
    picks, radii, vectors, new = [seed], [np.inf], [vector], 1
    while len(picks) < min(m, n):
        ids, x, gap = refill(picks[-new:], np.stack(vectors[-new:]))
        order = np.lexsort((ids, -gap))
        bound = (gap[order[-1]], ids[order[-1]]) if len(ids) > AHEAD else (-np.inf, 0)
        gap, new = gap.copy(), 0
        while len(picks) < min(m, n):
            at = int(gap.argmax())
            if new and (gap[at] < bound[0] or (gap[at] == bound[0] and ids[at] > bound[1])):
                break
            if stop and stop(vectors, float(gap[at])):
                return picks, radii
            picks.append(int(ids[at]))
            radii.append(float(gap[at]))
            vectors.append(x[at])
            new += 1
            np.minimum(gap, dist(x[at : at + 1], x)[0], out=gap, where=gap >= 0)
            gap[at] = -1.0
    return picks, radii


def held_refill(ids: np.ndarray, x: np.ndarray, dist: Callable, step: int = 1 << 20) -> Callable:
    """refill for rows (sorted by id) that are all in memory."""
    gap = np.full(len(ids), np.inf)

    def refill(picked, vectors):
        rows = max(1, step // len(vectors))
        for s in range(0, len(ids), rows):
            np.minimum(gap[s : s + rows], dist(x[s : s + rows], vectors).min(1), out=gap[s : s + rows])
        gap[np.searchsorted(ids, picked)] = -1.0
        return foremost(ids, x, gap, AHEAD + 1)

    return refill

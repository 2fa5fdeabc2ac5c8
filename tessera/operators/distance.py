"""Distances between rows, nearest neighbours and their diagnostics.

Vectors are arrays of double.  Where one of the two sets is of up to BLOCK_BYTES, it is broadcast and meets
all rows of the other set once, in Arrow batches.  Beyond that both sets are cut into tiles by the hash of
their ids, and every pair of tiles meets in one task.  Within a task no step makes more than STEP distances.
So nothing large passes through the driver, and no pair is shuffled unless it is part of the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of vectors that are broadcast at most, and about as many in a tile.
BLOCK_BYTES, TILE_BYTES = 32 << 20, 8 << 20
#: Distances that one numpy step makes, and rows of the second set in it at most; distances of a task at least, where rows are dealt anew.
STEP, WIDE, TASK = 1 << 21, 1024, 100_000_000
#: Rows of results that a task piles up before it merges them.
PILE = 200_000
#: Rows of both sets whose gaps are summed at once, so that they stay in the processor's cache.
CELL = (64, 1024)
METRICS = ("euclidean", "manhattan", "chebyshev", "cosine", "jaccard", "hamming", "gower")


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda s, x: s + x)


def distance(a: str | Column, b: str | Column, metric: str = "euclidean") -> Column:
    """The distance of two array columns as an expression, for pairs that stand in one row."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    a, b = col(a), col(b)
    gap = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    if metric == "euclidean":
        return F.sqrt(_sum(F.transform(gap, lambda x: x * x)))
    if metric == "manhattan":
        return _sum(gap)
    if metric == "chebyshev":
        return F.coalesce(F.array_max(gap), F.lit(0.0))
    if metric == "gower":
        return F.try_divide(_sum(gap), F.size(a))
    if metric == "cosine":
        dot = _sum(F.zip_with(a, b, lambda x, y: x * y))
        norm = lambda v: F.sqrt(_sum(F.transform(v, lambda x: x * x)))
        return 1 - F.coalesce(F.try_divide(dot, norm(a) * norm(b)), F.lit(0.0))
    if metric == "hamming":
        return F.try_divide(_sum(F.transform(gap, lambda x: (x != 0).cast("double"))), F.size(a))
    if metric == "jaccard":
        either = _sum(F.zip_with(a, b, lambda x, y: ((x != 0) | (y != 0)).cast("double")))
        differ = _sum(F.zip_with(a, b, lambda x, y: ((x != 0) != (y != 0)).cast("double")))
        return F.coalesce(F.try_divide(differ, either), F.lit(0.0))
    raise ValueError(f"unknown metric: {metric}")


def kernel(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """All distances of two matrices' rows."""
    if metric == "euclidean":
        square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T
        return np.sqrt(np.maximum(square, 0))
    if metric == "cosine":
        na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
        scale = na[:, None] * nb[None]
        return 1 - np.divide(a @ b.T, scale, out=np.zeros_like(scale), where=scale > 0)
    if metric == "jaccard":
        x, y = (a != 0).astype(float), (b != 0).astype(float)
        both = x @ y.T
        either = x.sum(1)[:, None] + y.sum(1)[None] - both
        return np.divide(either - both, either, out=np.zeros_like(either), where=either > 0)
    if metric not in ("manhattan", "chebyshev", "hamming", "gower"):
        raise ValueError(f"unknown metric: {metric}")
    out, across = np.zeros((len(a), len(b))), np.ascontiguousarray(b.T)
    for s in range(0, len(a), CELL[0]):
        for t in range(0, len(b), CELL[1]):
            cell = out[s : s + CELL[0], t : t + CELL[1]]
            total, gap = np.zeros(cell.shape), np.empty(cell.shape)
            for j in range(a.shape[1]):
                np.subtract(a[s : s + CELL[0], j, None], across[None, j, t : t + CELL[1]], out=gap)
                if metric == "hamming":
                    total += gap != 0
                    continue
                np.abs(gap, out=gap)
                (np.maximum if metric == "chebyshev" else np.add)(total, gap, out=total)
            cell[:] = total
    if metric in ("hamming", "gower"):
        out /= max(1, a.shape[1])
    return out


def coarse(a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
    """Manhattan distances in steps of one grid over both matrices, each off by less than a step a column; None where 16 bits do not hold them.

    Integers of 16 bits take a fifth of the time of doubles.
    """
    columns = a.shape[1]
    low, high = min(a.min(initial=np.inf), b.min(initial=np.inf)), max(a.max(initial=-np.inf), b.max(initial=-np.inf))
    levels = min(32_000, 65_000 // max(1, columns))
    if levels < 64 or not 1e-300 < high - low < np.inf:
        return None
    x, across = (np.rint((m - low) * (levels / (high - low))).astype(np.int16) for m in (a, b))
    across = np.ascontiguousarray(across.T)
    out = np.empty((len(a), len(b)), np.uint16)
    for s in range(0, len(a), CELL[0]):
        for t in range(0, len(b), CELL[1]):
            cell = out[s : s + CELL[0], t : t + CELL[1]]
            total, gap = np.zeros(cell.shape, np.uint16), np.empty(cell.shape, np.int16)
            for j in range(columns):
                np.subtract(x[s : s + CELL[0], j, None], across[None, j, t : t + CELL[1]], out=gap)
                np.abs(gap, out=gap)
                np.add(total, gap.view(np.uint16), out=total)
            cell[:] = total
    return out


def near_pairs(a_ids: np.ndarray, a: np.ndarray, b_ids: np.ndarray, b: np.ndarray, k: int, metric: str, skip_self: bool, farthest: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of a, rows of b, distances): of each row of a the k nearest (or farthest) rows of b, those that tie with the k-th, and maybe more."""
    sign = -1.0 if farthest else 1.0
    rough = coarse(a, b) if metric in ("manhattan", "gower") and len(b) > 4 * k else None
    if rough is None:
        d = sign * kernel(a, b, metric)
        if skip_self:
            d[a_ids[:, None] == b_ids[None]] = np.inf
        last = np.partition(d, k - 1, axis=1)[:, k - 1] if k < len(b) else np.full(len(d), np.inf)
        q, i = np.nonzero((d <= last[:, None]) & np.isfinite(d))  # all that tie with the k-th are in
        return q, i, sign * d[q, i]
    if farthest:
        np.subtract(np.uint16(65_535), rough, out=rough)
    if skip_self and len(np.intersect1d(a_ids, b_ids)):
        rough[a_ids[:, None] == b_ids[None]] = 65_535
    # The k-th of the least of some groups is no less than the k-th of all, and neither is off by more than a step a column.
    wide = max(64, 2 * k)
    deep = len(b) // wide
    least = rough[:, : deep * wide].reshape(len(a), deep, wide).min(1) if deep > 1 else rough
    last = np.partition(least, k - 1, axis=1)[:, k - 1].astype(np.int64) + 2 * a.shape[1] + 2
    q, i = np.nonzero(rough <= np.minimum(last, 65_535).astype(np.uint16)[:, None])
    if skip_self:
        other = a_ids[q] != b_ids[i]
        q, i = q[other], i[other]
    d = np.zeros(len(q))
    for x, y in zip(np.ascontiguousarray(a.T), np.ascontiguousarray(b.T), strict=True):
        d += np.abs(x[q] - y[i])
    return q, i, d / max(1, a.shape[1]) if metric == "gower" else d


#: Values that stand for a column of the queries, columns in a table, queries that are looked up at once, and pairs that are measured at once.
LEVELS, TOGETHER, LOOKED_UP, MEASURED = 16, 2, 2048, 2048


def _measured(a, b, q, i) -> np.ndarray:
    """Manhattan distances of pairs, summed column by column as the kernel does."""
    d = np.zeros(len(q))
    for s in range(0, len(q), MEASURED):
        gap = np.abs(a[q[s : s + MEASURED]] - b[i[s : s + MEASURED]])
        for column in np.ascontiguousarray(gap.T):
            d[s : s + MEASURED] += column
    return d


def _about(a, b, q, i) -> np.ndarray:
    """The same in floats of 32 bits, for matrices of these."""
    d, one = np.empty(len(q), np.float32), np.ones(a.shape[1], np.float32)
    for s in range(0, len(q), MEASURED):
        gap = a[q[s : s + MEASURED]]
        gap -= b[i[s : s + MEASURED]]
        np.abs(gap, out=gap)
        np.dot(gap, one, out=d[s : s + MEASURED])
    return d


#: Rows that the first bound of each query is looked for in.
SEEDS = 8192


def _reached(a_ids, a, b_ids, b, k: int, own: bool) -> np.ndarray:
    """A distance by manhattan that k rows of b (not of the query's id, where ``own``) do not exceed, for each row of a: the k-th of the rows that are nearest by euclidean in 4 k pieces of b."""
    pieces, n = 4 * k, min(len(b), SEEDS)
    wide, out = n // pieces, np.empty(len(a))
    n = wide * pieces
    middle = b[:n].mean(0)
    x, y = (a - middle).astype(np.float32), (b[:n] - middle).astype(np.float32)
    square, across = (y * y).sum(1), np.ascontiguousarray(-2 * y.T)
    tall = max(1, STEP // n)
    for s in range(0, len(a), tall):
        far = x[s : s + tall] @ across
        far += square
        if own:
            far[a_ids[s : s + tall, None] == b_ids[None, :n]] = np.inf
        i = (far.reshape(-1, pieces, wide).argmin(2) + np.arange(0, n, wide)).ravel()
        q = np.repeat(np.arange(len(far)), pieces)
        d = _measured(a[s : s + tall], b, q, i)
        if own:
            d[a_ids[s : s + tall][q] == b_ids[i]] = np.inf
        out[s : s + tall] = np.partition(d.reshape(-1, pieces), k - 1, axis=1)[:, k - 1]
    return out


def near_cells(a_ids: np.ndarray, a: np.ndarray, b_ids: np.ndarray, b: np.ndarray, k: int, metric: str, skip_self: bool, both: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of a, rows of b, distances) as near_pairs gives them for the nearest by manhattan or gower, for large sets.

    Each column of a row of a stands on one of few levels, so the gaps of two columns to all rows of a block of b are looked
    up and added up in 16 bits.  The sum is off by no more than the row's own distance to its levels, and pairs that
    may be nearer than the k nearest so far, and than k rows that are near by euclidean, are measured.
    With ``both`` the k nearest rows of a for each row of b are among the pairs, too (no id may be in both sets then).
    """
    columns = a.shape[1]
    block = max(64, min(512, 32_768 // max(1, columns)))
    spans = np.maximum(a.max(0, initial=-np.inf), b.max(0, initial=-np.inf)) - np.minimum(a.min(0, initial=np.inf), b.min(0, initial=np.inf))
    unit = float(spans.sum()) / 64_000
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def in_doubles(start):
        for s in range(0, len(a), STEP // WIDE):
            for t in range(start, len(b), WIDE):
                q, i, d = near_pairs(a_ids[s : s + STEP // WIDE], a[s : s + STEP // WIDE], b_ids[t : t + WIDE], b[t : t + WIDE], k, metric, skip_self, False)
                held.append((q + s, i + t, d))
        for t in range(start, len(b) if both else 0, STEP // WIDE):
            for s in range(0, len(a), WIDE):
                i, q, d = near_pairs(b_ids[t : t + STEP // WIDE], b[t : t + STEP // WIDE], a_ids[s : s + WIDE], a[s : s + WIDE], k, metric, skip_self, False)
                held.append((q + s, i + t, d))

    def kept(best, q, d):
        order = np.lexsort((d, q))
        q, d = q[order], d[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        new = np.full(best.shape, np.inf)
        new[q[place < k], place[place < k]] = d[place < k]
        return np.sort(np.concatenate([best, new], axis=1), axis=1)[:, :k]

    if not len(a) or not len(b) or not 0 < columns <= 1000 or 4 * k > min(block, len(b), len(a) if both else block) or not 1e-30 < unit < 1e30:
        in_doubles(0)
    else:
        levels = np.quantile(a, (np.arange(LEVELS) + 0.5) / LEVELS, axis=0)
        code = np.stack([np.searchsorted((x[1:] + x[:-1]) / 2, y) for x, y in zip(levels.T, a.T, strict=True)], axis=1)
        off = np.abs(a - np.take_along_axis(levels, code, 0)).sum(1) + (columns / 2 + 1) * unit
        groups = [range(j, min(columns, j + TOGETHER)) for j in range(0, columns, TOGETHER)]
        codes = [sum(code[:, j] * LEVELS ** (len(g) - 1 - n) for n, j in enumerate(g)) for g in groups]
        middle = a.mean(0)
        rough_a, rough_b = ((x - middle).astype(np.float32) for x in (a, b))
        blur = 1e-7 * (columns + 4) * 2 * (columns * max(np.abs(rough_a).max(), np.abs(rough_b).max()) + 1e-30)
        best, own = np.full((len(a), k), np.inf), skip_self and len(np.intersect1d(a_ids, b_ids)) > 0
        reached = _reached(a_ids, a, b_ids, b, k, own)
        back, back_reached = np.full((len(b), k), np.inf), _reached(b_ids, b, a_ids, a, k, own) if both else np.full(len(b), -np.inf)
        steps_off = np.minimum(np.ceil(off / unit), 65_535).astype(np.uint16)
        for t in range(0, len(b), block):
            tables, some = [], np.ascontiguousarray(b[t : t + block].T)
            for g in groups:
                table = np.zeros((1, some.shape[1]), np.uint16)
                for j in g:
                    table = (table[:, None] + np.rint(np.abs(levels[:, j, None] - some[j]) / unit).astype(np.uint16)).reshape(-1, some.shape[1])
                tables.append(table)
            passed = 0
            for s in range(0, len(a), LOOKED_UP):
                e = min(s + LOOKED_UP, len(a))
                total = np.take(tables[0], codes[0][s:e], axis=0)
                gap = np.empty_like(total)
                for table, c in zip(tables[1:], codes[1:], strict=True):
                    np.take(table, c[s:e], axis=0, out=gap, mode="clip")
                    np.add(total, gap, out=total)
                most = np.minimum(best[s:e, -1], reached[s:e])
                limit = np.minimum((most + off[s:e]) / unit + 1, 65_535).astype(np.uint16)[:, None]
                if both:
                    back_most = np.minimum(back[t : t + block, -1], back_reached[t : t + block])
                    steps = np.minimum(back_most / unit + 2, 65_535).astype(np.uint16)
                    if int(steps.max()) + int(steps_off.max()) > 65_535:
                        wide = np.minimum(steps.astype(np.uint32) + steps_off[s:e, None], 65_535).astype(np.uint16)
                    else:
                        wide = steps + steps_off[s:e, None]
                    limit = np.maximum(wide, limit, out=wide)
                q, i = np.divmod(np.flatnonzero(total <= limit), total.shape[1])
                passed += len(q)
                if own:
                    other = a_ids[s:e][q] != b_ids[t : t + block][i]
                    q, i = q[other], i[other]
                near = _about(rough_a[s:e], rough_b[t : t + block], q, i) <= (np.maximum(most[q], back_most[i]) if both else most[q]) + blur
                q, i = q[near], i[near]
                d = _measured(a[s:e], b[t : t + block], q, i)
                best[s:e] = kept(best[s:e], q, d)
                if both:
                    back[t : t + block] = kept(back[t : t + block], i, d)
                held.append((q + s, i + t, d / columns if metric == "gower" else d))
            if t and passed > 0.15 * len(a) * some.shape[1]:  # levels say little about these rows
                in_doubles(t + block)
                break
        limit, back_limit = ((x[:, -1] / columns if metric == "gower" else x[:, -1]) if x is best or both else np.full(len(b), -np.inf) for x in (best, back))
        within = [d <= np.maximum(limit[q], back_limit[i]) for q, i, d in held]
        held = [(q[x], i[x], d[x]) for x, (q, i, d) in zip(within, held, strict=True)]
    q, i, d = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return q, i, d


def gower_kernel(xb, xv, yb, yv, atol: float = 1e-8, rtol: float = 1e-5) -> np.ndarray:
    """Gower distances of (binary, scaled) parts: absolute gaps plus mismatches, over the number of columns."""
    for m in (xb, yb):
        if m.size and not np.isin(m, (0.0, 1.0)).all():
            raise ValueError("a binary column holds something other than 0 and 1")
    out = np.zeros((len(xb), len(yb)))
    for j in range(xv.shape[1]):
        out += np.abs(xv[:, j, None] - yv[None, :, j])
    if xb.shape[1]:
        out += xb @ (1 - yb).T + (1 - xb) @ yb.T
    return out / max(1, xb.shape[1] + xv.shape[1])


def _matrix(vectors) -> np.ndarray:
    return np.stack(vectors).astype(float) if len(vectors) else np.zeros((0, 0))


def _bytes(df: DataFrame, key: str) -> tuple[int, int]:
    """Rows, and bytes of their vectors and ids."""
    return df.agg(F.count("*"), F.coalesce(F.sum(8 * F.size("v") + 64), F.lit(0))).first()


def _whole(df: DataFrame, key: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids, matrix) of a set of at most BLOCK_BYTES, in the order of ids."""
    got = df.select(key, "v").toArrow().sort_by(key).combine_chunks()
    v = got.column("v").combine_chunks()
    v = v if isinstance(v, pa.Array) else pa.concat_arrays(v.chunks)
    return got.column(key).to_numpy(), v.flatten().to_numpy().astype(float).reshape(got.num_rows, -1)


def _steps(ids, m, other_ids, others, work: Callable) -> Iterator[pd.DataFrame]:
    """work over pieces of both sets, none of over STEP distances."""
    tall = max(1, STEP // max(1, min(WIDE, len(other_ids))))
    for s in range(0, len(ids), tall):
        for t in range(0, len(other_ids), WIDE):
            yield work(ids[s : s + tall], m[s : s + tall], other_ids[t : t + WIDE], others[t : t + WIDE])


def _at_once(ids, m, other_ids, others, work: Callable) -> Iterator[pd.DataFrame]:
    """work over both sets, for work that cuts them itself."""
    yield work(ids, m, other_ids, others)


def _merged(parts: Iterable[pd.DataFrame], merge: Callable | None) -> Iterator[pd.DataFrame]:
    """The frames of a task: each by itself, or merged as they pile up."""
    held, n, most = [], 0, PILE
    for out in parts:
        if merge is None:
            yield out
            continue
        held.append(out)
        n += len(out)
        if n > most:
            held = [merge(pd.concat(held))]
            n, most = len(held[0]), max(PILE, 2 * len(held[0]))
    if held:
        yield merge(pd.concat(held)) if len(held) > 1 else held[0]


def _mapped(rows: DataFrame, others: DataFrame, key: str, work: Callable, schema: str, merge: Callable | None = None, steps: Callable = _steps) -> DataFrame:
    """work(ids, matrix, other ids, their matrix) -> frame, over parts of both sets so that each pair is in one of them; ``merge`` thins what a task has so far, ``steps`` cuts what meets."""
    spark = rows.sparkSession
    (n, size), (n_rows, rows_size) = _bytes(others, key), _bytes(rows, key)
    if not n or not n_rows:
        return spark.createDataFrame([], schema)
    if min(size, rows_size) <= BLOCK_BYTES:
        others_sent = size <= BLOCK_BYTES
        sent = spark.sparkContext.broadcast(_whole(others if others_sent else rows, key))

        def met_in(batches):
            ids, block = sent.value
            for b in batches:
                own = b[key].to_numpy(), _matrix(b["v"].to_numpy())
                if len(b):
                    yield from steps(*own, ids, block, work) if others_sent else steps(ids, block, *own, work)

        met = (rows if others_sent else others).select(key, "v")
        if n * n_rows > TASK:
            met = met.repartition(min(2000, -(-n * n_rows // TASK)), key)
        return met.mapInPandas(lambda batches: _merged(met_in(batches), merge), schema)

    n_own, n_met = -(-rows_size // TILE_BYTES), -(-size // TILE_BYTES)

    def dealt(df, is_row, own, n_own, met, n_met):
        tile = F.pmod(F.xxhash64(key), F.lit(n_own)).cast("int").alias(own)
        return df.select(key, "v", F.lit(is_row).alias("is_row"), tile, F.explode(F.sequence(F.lit(0), F.lit(n_met - 1))).alias(met))

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, parts = {True: [], False: []}, {True: [], False: []}
        for b in batches:
            for is_row in (True, False):
                some = b[b["is_row"] == is_row]
                if len(some):
                    ids[is_row].append(some[key].to_numpy())
                    parts[is_row].append(_matrix(some["v"].to_numpy()))
        if ids[True] and ids[False]:
            sides = [x for is_row in (True, False) for x in (np.concatenate(ids[is_row]), np.concatenate(parts[is_row]))]
            parts.clear()
            yield from _merged(steps(*sides, work), merge)

    # One table in place of a cogroup: where both sets come from one table, a cogroup confuses their columns.
    both = dealt(rows, True, "i", n_own, "j", n_met).unionByName(dealt(others, False, "j", n_met, "i", n_own))
    # Pairs of tiles take about the same time: with more partitions than pairs few of them share one.
    return both.repartition(min(2000, 4 * n_own * n_met), "i", "j").groupBy("i", "j").applyInPandas(meet, schema)


def pairwise(rows: DataFrame, others: DataFrame, metric: str = "euclidean", key: str = "vec_id") -> DataFrame:
    """a_id, b_id, dist: the full table of distances, for results that are wanted whole."""

    def work(ids, m, block_ids, block):
        d = kernel(m, block, metric)
        return pd.DataFrame({"a_id": np.repeat(ids, len(block_ids)), "b_id": np.tile(block_ids, len(ids)), "dist": d.ravel()})

    return _mapped(rows, others, key, work, "a_id bigint, b_id bigint, dist double")


def distance_rows(rows: DataFrame, others: DataFrame, metric: str = "euclidean", key: str = "vec_id") -> DataFrame:
    """id, others (ids) and dist (as many): the table by rows, one array a row and part of the others, compact to store."""

    def work(ids, m, block_ids, block):
        return pd.DataFrame({"id": ids, "others": [block_ids] * len(ids), "dist": list(kernel(m, block, metric))})

    return _mapped(rows, others, key, work, "id bigint, others array<bigint>, dist array<double>")


def summaries(rows: DataFrame, others: DataFrame, metric: str = "euclidean", key: str = "vec_id", skip_self: bool = False, under: float | None = None) -> DataFrame:
    """a_id, n, total, least, largest and near (distances above 0 and below ``under``) over each row's distances to the others; no pair leaves its task."""

    def work(ids, m, block_ids, block):
        d = kernel(m, block, metric)
        own = block_ids[None] == ids[:, None] if skip_self else np.zeros(d.shape, bool)
        near = ((d > 0) & (d < under) & ~own).sum(1) if under is not None else np.zeros(len(ids), np.int64)
        return pd.DataFrame({"a_id": ids, "n": (~own).sum(1), "total": np.where(own, 0, d).sum(1), "least": np.where(own, np.inf, d).min(1, initial=np.inf), "largest": np.where(own, -np.inf, d).max(1, initial=-np.inf), "near": near})

    def merge(x):
        return x.groupby("a_id", as_index=False).agg({"n": "sum", "total": "sum", "least": "min", "largest": "max", "near": "sum"})

    part = _mapped(rows, others, key, work, "a_id bigint, n bigint, total double, least double, largest double, near bigint", merge)
    return part.groupBy("a_id").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("largest").alias("largest"), F.sum("near").alias("near"))


#: Bins of a histogram of distances, and distances that are collected to read a quantile off.
BINS, READ = 4096, 100_000
#: Ranges of keys that are numbered side by side.
PARTS = 64


def distance_quantile(rows: DataFrame, others: DataFrame, share: float, metric: str = "euclidean", key: str = "vec_id", skip_self: bool = True) -> float | None:
    """The exact quantile (linear interpolation) of all distances."""
    return distance_quantiles(rows, others, [share], metric, key, skip_self)[1][0]


def distance_quantiles(rows: DataFrame, others: DataFrame, shares: Sequence[float], metric: str = "euclidean", key: str = "vec_id", skip_self: bool = True) -> tuple[dict, list[float | None]]:
    """(n, total, low and high of all distances, their exact quantiles by linear interpolation): histograms narrow these down to few values, which are read."""

    def passed(ranges, what, schema):
        def work(ids, m, block_ids, block):
            d = kernel(m, block, metric)
            d = d[block_ids[None] != ids[:, None]] if skip_self else d.ravel()
            return pd.concat([what(d[(d >= low) & (d <= high)], low, high).assign(part=i) for i, (low, high) in enumerate(ranges)])

        return work, f"{schema}, part int"

    def histogram(d, low, high):
        bins = np.minimum(BINS - 1, ((d - low) / (high - low) * BINS).astype(np.int64))
        count = np.bincount(bins, minlength=BINS)
        some = np.flatnonzero(count)
        lows, highs = np.full(BINS, np.inf), np.full(BINS, -np.inf)
        np.minimum.at(lows, bins, d)
        np.maximum.at(highs, bins, d)
        return pd.DataFrame({"bin": some, "n": count[some], "low": lows[some], "high": highs[some]})

    def merged(x):
        return x.groupby(["part", "bin"], as_index=False).agg({"n": "sum", "low": "min", "high": "max"})[["bin", "n", "low", "high", "part"]]

    every = summaries(rows, others, metric, key, skip_self).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("low"), F.max("largest").alias("high")).first().asDict()
    if not every["n"]:
        return every, [None] * len(shares)
    places = [s * (every["n"] - 1) for s in shares]
    found, held = {}, {r: (every["low"], every["high"], 0, every["n"]) for p in places for r in (int(np.floor(p)), int(np.ceil(p)))}
    while held:
        found |= {r: low for r, (low, high, _, _) in held.items() if low == high}
        held = {r: x for r, x in held.items() if r not in found}
        wide = sorted({x[:2] for x in held.values() if x[3] > READ})
        few = sorted({x[:2] for x in held.values() if x[3] <= READ})
        if wide:
            work, schema = passed(wide, histogram, "bin bigint, n bigint, low double, high double")
            part = _mapped(rows, others, key, work, schema, merged).groupBy("part", "bin").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
            bins: list[list] = [[] for _ in wide]
            for b in part.orderBy("part", "bin").collect():
                bins[b["part"]].append(b)
            for r, (low, high, before, n) in held.items():
                if n > READ:
                    for b in bins[wide.index((low, high))]:
                        if r < before + b["n"]:
                            break
                        before += b["n"]
                    held[r] = (b["low"], b["high"], before, b["n"])
        elif few:
            work, schema = passed(few, lambda d, low, high: pd.DataFrame({"d": d}), "d double")
            got = _mapped(rows, others, key, work, schema).toPandas()
            for r, (low, high, before, _) in held.items():
                found[r] = float(np.sort(got["d"].to_numpy()[got["part"] == few.index((low, high))])[r - before])
            held = {}
    low = lambda p: float(found[int(np.floor(p))])
    return every, [low(p) + float(p - np.floor(p)) * (float(found[int(np.ceil(p))]) - low(p)) for p in places]


#: Bins of the histogram that brackets a quantile of distances within one set, and pairs in the bracket that are measured singly at most.
FINE, FEW = 1 << 16, 1_000_000


def _halved(rows: DataFrame, key: str, size: int, work: Callable, schema: str) -> DataFrame:
    """work(ids, matrix, other ids, their matrix) -> frames, over pairs of tiles of one set so that each two rows meet once; the matrices are the same object where a tile meets itself."""
    tiles = max(1, -(-size // TILE_BYTES))
    tile = F.pmod(F.xxhash64(key), F.lit(tiles)).cast("int").alias("own")
    met = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("met")
    dealt = rows.select(key, "v", tile).select("*", met).select(key, "v", "own", F.least("own", "met").alias("i"), F.greatest("own", "met").alias("j"))

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sides: dict[int, list] = {}
        for b in batches:
            for own, some in b.groupby("own"):
                sides.setdefault(own, []).append((some[key].to_numpy(), _matrix(some["v"].to_numpy())))
            pair = {int(b["i"].iloc[0]), int(b["j"].iloc[0])} if len(b) else set()
        if len(sides) < len(pair):
            return
        held = []
        for own in sorted(sides):
            ids, m = (np.concatenate(x) for x in zip(*sides.pop(own), strict=True))
            order = np.argsort(ids, kind="stable")
            held.append((ids[order], m[order]))
        yield from work(*held[0], *held[-1])

    return dealt.repartition(min(2000, 2 * tiles * (tiles + 1)), "i", "j").groupBy("i", "j").applyInPandas(meet, schema)


def _each_two(ids, m, other_ids, others, metric: str) -> Iterator[tuple[slice, slice, np.ndarray, np.ndarray | None]]:
    """(rows, others, their measures, pairs to leave out): each two rows once. A measure grows with the distance; it is its square for euclidean."""
    same, tall = m is others, 256
    apart = same and len(np.unique(ids)) < len(ids)
    if metric == "euclidean":
        one = np.ones((len(m), 1))
        m = np.hstack([-2 * m, (m * m).sum(1)[:, None], one])
        others = np.hstack([others, np.ones((len(others), 1)), (others * others).sum(1)[:, None]])
    for s in range(0, len(ids), tall):
        for t in range(s if same else 0, len(other_ids), WIDE):
            a, b = slice(s, min(s + tall, len(ids))), slice(t, min(t + WIDE, len(other_ids)))
            d = m[a] @ others[b].T if metric == "euclidean" else kernel(m[a], others[b], metric)
            out = None
            if same and t < a.stop:
                out = np.arange(t, b.stop)[None] <= np.arange(s, a.stop)[:, None]
            if apart:
                alike = ids[a][:, None] == other_ids[b][None]
                out = alike if out is None else out | alike
            yield a, b, d, out


def _exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows side by side, the same for a pair wherever it stands."""
    total = np.zeros(len(x))
    for p, q in zip(np.ascontiguousarray(x.T), np.ascontiguousarray(y.T), strict=True):
        total += (p - q) ** 2
    return np.sqrt(total)


def near_counts(rows: DataFrame, share: float, metric: str = "euclidean", key: str = "vec_id") -> DataFrame:
    """a_id, near: each row's others at a distance above 0 and under the exact ``share`` quantile (linear interpolation) of the distances between different rows.

    Each two rows are measured once a pass. The first pass brackets the quantile by a histogram (more passes narrow it
    down), the last counts what is below the bracket and measures the pairs within it singly.
    """
    n_rows, size = _bytes(rows, key)

    def reach(batches):
        for b in batches:
            if len(b):
                m = _matrix(b["v"].to_numpy())
                yield pd.DataFrame({"low": [m.min(0)], "high": [m.max(0)], "norm": [(m * m).sum(1).max()]})

    ends = rows.select("v").mapInPandas(reach, "low array<double>, high array<double>, norm double").collect() if n_rows else []
    if not ends:
        return rows.select(F.col(key).alias("a_id"), F.lit(0).cast("bigint").alias("near"))
    span, norm = np.max([r["high"] for r in ends], 0) - np.min([r["low"] for r in ends], 0), max(r["norm"] for r in ends)
    top = {"euclidean": min(float((span**2).sum()), 4 * norm), "manhattan": span.sum(), "chebyshev": span.max(initial=0.0), "gower": span.sum() / max(1, len(span)), "cosine": 2.0}.get(metric, 1.0)
    slack = 1e-15 * (len(span) + 8) * (4 * norm if metric == "euclidean" else 4 * max(top, 1.0))  # how far off measures are at most

    def histogram(low, high):
        def work(ids, m, other_ids, others):
            bins = np.zeros(FINE + 2, np.int64)
            for _, _, d, out in _each_two(ids, m, other_ids, others, metric):
                d -= low
                d *= FINE / (high - low)
                np.clip(d, -1, FINE, out=d)
                np.floor(d, out=d)
                place = d.astype(np.int32)
                place += 1
                bins += np.bincount(place.ravel() if out is None else place[~out], minlength=FINE + 2)
            some = np.flatnonzero(bins)
            yield pd.DataFrame({"bin": some, "n": bins[some]})

        return _halved(rows, key, size, work, "bin bigint, n bigint").groupBy("bin").agg(F.sum("n").alias("n")).toArrow().to_pandas()

    low, high = 0.0, float(top) * (1 + 1e-9) + slack
    while True:
        got, counts = histogram(low, high), np.zeros(FINE + 2, np.int64)
        counts[got["bin"].to_numpy()] = got["n"].to_numpy()
        if not counts.sum():
            return rows.select(F.col(key).alias("a_id"), F.lit(0).cast("bigint").alias("near"))
        # Each pair stands for two distances.
        ends, place = 2 * np.cumsum(counts), share * (2 * int(counts.sum()) - 1)
        first, last = (max(0, int(np.searchsorted(ends, rank, side="right")) - 1 + step) for rank, step in ((int(np.floor(place)), -1), (int(np.ceil(place)), 2)))
        wide = (high - low) / FINE
        inside = counts[first + 1 : last + 1].sum()
        low, high = low + max(0, first) * wide, low + min(FINE, last) * wide
        if inside <= FEW or high - low <= 64 * slack or wide <= 1e-13 * max(1e-300, high):
            break

    def counted(low, high):
        low, high = low - 2 * slack, high + 2 * slack
        if low <= 4 * slack:
            low = -np.inf  # rows alike are measured singly

        def work(ids, m, other_ids, others):
            sure, none = ([np.zeros(len(x), np.int64) for x in (ids, other_ids)] for _ in range(2))
            n, held = 0, []

            def merged(parts):
                return pd.concat(parts).groupby(["a_id", "dist"], as_index=False)["n"].sum()

            if metric == "euclidean" and low > 0:
                codes = np.unique(np.concatenate([m, others]) + 0.0, axis=0, return_inverse=True)[1].ravel()
                mine, theirs = codes[: len(m)], codes[len(m) :]
                if m is others:
                    none[0] += np.bincount(mine, minlength=codes.max() + 1)[mine] - 1
                else:
                    none[0] += np.bincount(theirs, minlength=codes.max() + 1)[mine]
                    none[1] += np.bincount(mine, minlength=codes.max() + 1)[theirs]
            for a, b, d, out in _each_two(ids, m, other_ids, others, metric):
                if out is not None:
                    d[out] = np.inf
                under = d < low
                sure[0][a] += under.sum(1)
                sure[1][b] += under.sum(0)
                if metric != "euclidean":
                    under &= d <= 0
                    none[0][a] += under.sum(1)
                    none[1][b] += under.sum(0)
                i, j = np.nonzero((d >= low) & (d <= high))
                if len(i):
                    dist = _exact(m[a][i], others[b][j]) if metric == "euclidean" else d[i, j]
                    held.append(pd.DataFrame({"a_id": np.concatenate([ids[a][i], other_ids[b][j]]), "dist": np.tile(dist, 2), "n": 1}))
                    n += len(held[-1])
                    if n > PILE:
                        held = [merged(held)]
                        n = len(held[0]) // 2
            if m is others:
                sure, none, sides = [sure[0] + sure[1]], [none[0] + none[1]], [ids]
            else:
                sides = [ids, other_ids]
            for x, s, z in zip(sides, sure, none, strict=True):
                yield pd.DataFrame({"a_id": x, "dist": -1.0, "n": s, "none": z})
            if held:
                yield merged(held).assign(none=0)

        return _halved(rows, key, size, work, "a_id bigint, dist double, n bigint, none bigint")

    from ..sources import writers

    while True:
        path = writers.scratch(rows.sparkSession, "near")
        writers.write_parquet(counted(low, high), path)
        parts = rows.sparkSession.read.parquet(path)
        by = parts.groupBy("dist").agg(F.sum("n").alias("n")).orderBy("dist").toArrow()
        dist, n = by.column("dist").to_numpy(), np.cumsum(by.column("n").to_numpy())
        value = [float(dist[np.searchsorted(n, r, side="right")]) if r < n[-1] else None for r in (int(np.floor(place)), int(np.ceil(place)))]
        if None not in value and -1.0 not in value:
            break
        low, high = low - (high - low) - slack, high + (high - low) + slack
    eps = value[0] + float(place - np.floor(place)) * (value[1] - value[0])
    near = F.when(F.col("dist") < 0, F.col("n") - F.col("none")).when((F.col("dist") > 0) & (F.col("dist") < eps), F.col("n")).otherwise(0)
    return parts.groupBy("a_id").agg(F.sum(near).alias("near"))


def nearest(queries: DataFrame, rows: DataFrame, k: int, metric: str = "euclidean", key: str = "vec_id", skip_self: bool = True, farthest: bool = False) -> DataFrame:
    """a_id (query), b_id, dist, rank: the k nearest (or farthest) rows of each query, ties by id.

    Every part keeps its best k a query, so what is shuffled is k a query and part.  Where a large set's own rows are looked for
    by manhattan or gower, two tiles meet once and serve each other's rows.
    """
    sign = -1.0 if farthest else 1.0
    looked_up = metric in ("manhattan", "gower") and not farthest

    def work(ids, m, block_ids, block):  # ids: rows, block: queries
        q, i, d = near_cells(block_ids, block, ids, m, k, metric, skip_self) if looked_up else near_pairs(block_ids, block, ids, m, k, metric, skip_self, farthest)
        return best(pd.DataFrame({"a_id": block_ids[q], "b_id": ids[i], "dist": sign * d}))

    def work_both(ids, m, other_ids, others):
        if m is others:
            yield work(ids, m, ids, m)
        else:
            q, i, d = near_cells(ids, m, other_ids, others, k, metric, skip_self, True)
            yield best(pd.DataFrame({"a_id": np.concatenate([ids[q], other_ids[i]]), "b_id": np.concatenate([other_ids[i], ids[q]]), "dist": np.tile(d, 2)}))

    best = lambda x: x.sort_values(["a_id", "dist", "b_id"]).groupby("a_id", sort=False).head(k)
    schema = "a_id bigint, b_id bigint, dist double"
    size = _bytes(rows, key)[1] if looked_up and queries is rows else 0
    if size > BLOCK_BYTES:
        near = _halved(rows, key, size, work_both, schema)
    else:
        near = _mapped(rows, queries, key, work, schema, best, _at_once if looked_up else _steps)
    ranked = near.groupBy("a_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("dist", "b_id"))), 1, k).alias("best"))
    return ranked.select("a_id", F.posexplode("best").alias("pos", "x")).select("a_id", F.col("x.b_id").alias("b_id"), (F.lit(sign) * F.col("x.dist")).alias("dist"), (F.col("pos") + 1).alias("rank"))


def tie_diagnostics(distances: DataFrame, unique_least: int = 200, top_most: float = 0.05) -> DataFrame:
    """n, n_unique, top5_mass and whether the distances are degenerate (few values, or much mass on five)."""
    n = distances.groupBy("dist").agg(F.count("*").alias("n"))
    top = n.orderBy(F.desc("n"), "dist").limit(5).agg(F.sum("n").alias("top"))
    every = n.agg(F.sum("n").alias("n"), F.count("*").alias("n_unique"))
    mass = F.col("top") / F.col("n")
    return every.crossJoin(top).select("n", "n_unique", mass.alias("top5_mass"), ((F.col("n_unique") < unique_least) | (mass > top_most)).alias("degenerate"))


def numbered(df: DataFrame, key: str) -> tuple[DataFrame, int]:
    """(the rows with their place, from 0 in the order of the key; their number): ranges of keys are numbered side by side."""
    cuts = sorted(set(df.approxQuantile(key, [i / PARTS for i in range(1, PARTS)], 0.001)))
    held = df.withColumn("range", F.size(F.filter(F.array(*map(F.lit, cuts)), lambda x: x <= F.col(key))) if cuts else F.lit(0))
    sizes = {r["range"]: r["count"] for r in held.groupBy("range").count().collect()}
    before, starts = 0, []
    for r in sorted(sizes):
        starts.append((r, before))
        before += sizes[r]
    if not starts:
        return df.withColumn("place", F.lit(0).cast("bigint")), 0
    first = F.element_at(F.create_map(*(F.lit(x) for pair in starts for x in pair)), F.col("range"))
    place = F.row_number().over(Window.partitionBy("range").orderBy(key)) - 1 + first
    return held.withColumn("place", place.cast("bigint")).drop("range"), before


def sampled_gaps(rows: DataFrame, others: DataFrame, key: str = "vec_id") -> DataFrame:
    """a_id, b_id, gaps: each row with one of the others (its id modulo their number, in the order of ids)."""
    placed, n = numbered(others.select(F.col(key).alias("b_id"), F.col("v").alias("w")), "b_id")
    own = rows.select(F.col(key).alias("a_id"), "v", F.pmod(F.col(key), F.lit(max(1, n))).alias("place"))
    return own.join(placed, "place").select("a_id", "b_id", F.zip_with("v", "w", lambda a, b: F.abs(a - b)).alias("gaps"))


def feature_contributions(pairs: DataFrame) -> DataFrame:
    """feature (place from 0), mean and median of the absolute gap over pairs with gaps."""
    gaps = pairs.select(F.posexplode("gaps").alias("feature", "gap"))
    return gaps.groupBy("feature").agg(F.avg("gap").alias("mean_gap"), F.percentile("gap", 0.5).alias("median_gap"))


#: Ranges of a feature's values that are gone through side by side.
RANGES = 16


def mean_gaps(rows: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """feature (place from 0) and mean_gap: its mean absolute gap over all pairs of a row and one of the others, or of two different rows.

    The step from a value to the next is part of the gaps of all pairs with one end on either side, so counts of the values
    up to each do in place of pairs.  Nulls have no gaps.
    """
    from ..sources import writers

    spark = rows.sparkSession
    one = lambda df, a, b: df.select(F.posexplode("v").alias("feature", "x"), F.lit(a).alias("a"), F.lit(b).alias("b"))
    values = one(rows, 1, 1) if others is None else one(rows, 1, 0).unionByName(one(others, 0, 1))
    path = writers.scratch(spark, "values")
    writers.write_parquet(values.where("x IS NOT NULL").groupBy("feature", "x").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), path)
    values = spark.read.parquet(path)

    cuts = values.groupBy("feature").agg(F.percentile_approx("x", [i / RANGES for i in range(1, RANGES)], 1000).alias("cuts"))
    values = values.join(F.broadcast(cuts), "feature").withColumn("range", F.size(F.filter("cuts", lambda c: c <= F.col("x")))).drop("cuts")
    whole = Window.partitionBy("feature")
    before = whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = values.groupBy("feature", "range").agg(F.sum("a").alias("sum_a"), F.sum("b").alias("sum_b"), F.min("x").alias("low"))
    ranges = ranges.select(
        "feature",
        "range",
        F.lead("low").over(whole.orderBy("range")).alias("next_low"),
        *(x for c in "ab" for x in (F.coalesce(F.sum(f"sum_{c}").over(before), F.lit(0)).alias(f"before_{c}"), F.sum(f"sum_{c}").over(whole).cast("double").alias(f"n_{c}"))),
    )
    order = Window.partitionBy("feature", "range").orderBy("x")
    upto = {c: (F.col(f"before_{c}") + F.sum(c).over(order.rowsBetween(Window.unboundedPreceding, 0))).cast("double").alias(f"upto_{c}") for c in "ab"}
    steps = values.join(F.broadcast(ranges), ["feature", "range"]).select("feature", "n_a", "n_b", *upto.values(), (F.coalesce(F.lead("x").over(order), "next_low") - F.col("x")).alias("step"))
    across = F.col("upto_a") * (F.col("n_b") - F.col("upto_b")) + F.col("upto_b") * (F.col("n_a") - F.col("upto_a"))
    pairs = F.col("n_a") * F.col("n_b") - (F.col("n_a") if others is None else F.lit(0.0))
    gaps = steps.groupBy("feature", pairs.alias("pairs")).agg(F.coalesce(F.sum(F.col("step") * across), F.lit(0.0)).alias("total"))
    return gaps.select("feature", F.try_divide("total", "pairs").alias("mean_gap"))


def alignment(distances: DataFrame) -> DataFrame:
    """n_ids, square, diagonal and asymmetry (largest gap of d(a, b) and d(b, a)) of a square distance table."""
    swapped = distances.select(F.col("b_id").alias("a_id"), F.col("a_id").alias("b_id"), F.col("dist").alias("back"))
    both = distances.join(swapped, ["a_id", "b_id"], "left")
    return both.agg(
        F.count_distinct("a_id").alias("n_ids"),
        (F.count("*") == F.count_distinct("a_id") * F.count_distinct("b_id")).alias("square"),
        F.max(F.when(F.col("a_id") == F.col("b_id"), F.abs("dist"))).alias("diagonal"),
        F.max(F.abs(F.col("dist") - F.col("back"))).alias("asymmetry"),
    )

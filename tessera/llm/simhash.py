"""SimHash fingerprints linked through vantage-point trees.

Two fingerprints that differ in at most r bits differ in at most ``r // b`` bits in one of b blocks.
One vantage-point tree per block splits the fingerprints by their Hamming distance to vantage
fingerprints; the triangle bound tells which shards a query has to visit, so a fingerprint is owned
by one shard and copied to those whose boundary it overlaps.  Where a block cannot separate a shard
(many fingerprints alike in it) the tree goes on with the whole fingerprint and radius r.  Within a
shard the same recursion goes on in memory until few enough are left to compare outright.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .textkit import LOWER, byte_lists, fresh, map_texts, mix, raw, rolling, stored, word_hashes, words_of

#: Fingerprints that a shard owns on average, and most that the driver reads to place the trees (8 MB); 24 of them place a leaf, so
#: shards begin to grow beyond 43,690 of them, which is 262 million different fingerprints; a shard of ten times as many takes 0.5 MB and its copies.
SHARD, SAMPLE = 6_000, 1 << 20
#: Comparisons that are made outright.
OUTRIGHT = 1 << 20
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: bytes, k: int, seed: int) -> list[int]:
    """XXH64 of each k-word shingle of the lower-cased text, repeats included; of all words if there are fewer."""
    words = text.lower().split()
    if not words:
        return []
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= k:
        return [digest(line, seed)]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    stops = np.cumsum(sizes + 1) - 1
    starts = (stops - sizes)[: len(words) - k + 1].tolist()
    return [digest(line[a:b], seed) for a, b in zip(starts, stops[k - 1 :].tolist(), strict=True)]


def fold(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Fingerprints of runs of hashes: bits set in over half of a run (run without hashes: 0). ``at``: n + 1 offsets."""
    n = np.diff(at)
    out = np.zeros(len(n), np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        count = np.add.reduceat(bits, at[some], axis=0, dtype=np.int32)
        out[some] = np.packbits(2 * count > n[some, None], axis=1).view(">u8").ravel().astype(np.uint64)
    return out


def fingerprints(docs: DataFrame, shingle_words: int = 3, seed: int = 42, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and fp, the fingerprint as a signed long."""
    types = dict(docs.dtypes)

    def kernel(piece):
        lists = [shingle_hashes(t, shingle_words, seed) for t in byte_lists(piece.column("text"))]
        at = np.concatenate([[0], np.cumsum([len(x) for x in lists], dtype=np.int64)])
        fp = fold(np.array([h for x in lists for h in x], np.uint64), at)
        return pa.RecordBatch.from_arrays([piece.column(c) for c in keep] + [pa.array(fp.view(np.int64))], [*keep, "fp"])

    return map_texts(docs.select(*dict.fromkeys([*keep, "text"])), kernel, ", ".join(f"`{c}` {types[c]}" for c in keep) + ", fp bigint")


def blocks_of(radius: int) -> list[tuple[np.uint64, int]]:
    """(mask, radius) of the fewest blocks of 64 bits that leave radius 1 or less to each."""
    n = (radius + 2) // 2
    cut = [64 * i // n for i in range(n + 1)]
    return [(np.uint64(((1 << (b - a)) - 1) << a), radius // n) for a, b in zip(cut, cut[1:], strict=False)]


def _split(own: np.ndarray, tries: tuple[tuple[np.uint64, int], ...], rng) -> tuple | None:
    """(vantage, mask, radius, mu): own splits at distance mu; the cheapest of a few vantage fingerprints."""
    for mask, radius in tries:
        best = None
        for v in own[rng.integers(0, len(own), 6)]:
            d = np.bitwise_count((own ^ v) & mask).astype(np.int64)
            count = np.bincount(d, minlength=65)
            below = np.cumsum(count)
            for mu in np.unique(np.quantile(d, (0.35, 0.5, 0.65)).astype(int)):
                inside, n = below[mu], len(own)
                cost = inside * below[min(64, mu + radius)] + (n - inside) * (n - (below[mu - radius] if mu >= radius else 0))
                if inside and inside < n and (best is None or cost < best[0]):
                    best = (cost, v, mask, radius, int(mu))
        if best and best[0] < 0.8 * len(own) ** 2:
            return best[1:]
    return None


def plan(sample: np.ndarray, tries, leaf: int) -> list:
    """A tree as nested lists: [vantage, mask, radius, mu, inside, outside] or a leaf's number."""
    rng, count = np.random.default_rng(7), [0]

    def node(own):
        at = _split(own, tries, rng) if len(own) > leaf else None
        if at is None:
            count[0] += 1
            return count[0] - 1
        d = np.bitwise_count((own ^ at[0]) & at[1])
        return [*at, node(own[d <= at[3]]), node(own[d > at[3]])]

    return [node(sample), count[0]]


def route(tree, fp: np.ndarray, out: list, index=None, mine=None) -> None:
    """Appends (leaf, rows, owned) for every shard that rows of fp belong to or overlap."""
    if index is None:
        index, mine = np.arange(len(fp)), np.ones(len(fp), bool)
    if not len(index):
        return
    if not isinstance(tree, list):
        out.append((tree, index, mine))
        return
    v, mask, radius, mu, inside, outside = tree
    d = np.bitwise_count((fp[index] ^ v) & mask).astype(np.int64)
    near, far = d <= mu + radius, d > mu - radius
    route(inside, fp, out, index[near], mine[near] & (d[near] <= mu))
    route(outside, fp, out, index[far], mine[far] & (d[far] > mu))


def linked(fp: np.ndarray, mine: np.ndarray, tries, radius: int, found) -> None:
    """Calls found(i, j, hit) with two arrays of rows and which pairs of them are linked, i > j and j owned.  Rows have the same order in every shard."""
    rng = np.random.default_rng(11)

    def join(own, ask):
        if not len(own) or not len(ask):
            return
        if len(own) * len(ask) > OUTRIGHT and len(own) > 64:
            at = _split(fp[own], tries, rng)
            if at is not None:
                v, mask, r, mu = at
                a = np.bitwise_count((fp[own] ^ v) & mask)
                b = np.bitwise_count((fp[ask] ^ v) & mask).astype(np.int64)
                join(own[a <= mu], ask[b <= mu + r])
                join(own[a > mu], ask[b > mu - r])
                return
        step = max(1, OUTRIGHT // len(own))
        for k in range(0, len(ask), step):
            q = ask[k : k + step]
            hit = (np.bitwise_count(fp[q][:, None] ^ fp[own][None, :]) <= radius) & (q[:, None] > own[None, :])
            if hit.any():
                found(q, own, hit)

    join(np.flatnonzero(mine), np.arange(len(fp)))


class Forest:
    """Labels that fall to the smallest row linked."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add_hits(self, i: np.ndarray, j: np.ndarray, hit: np.ndarray) -> None:
        a, b = np.nonzero(hit)
        self.add(i[a], j[b])

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        label = self.label
        while True:
            a, b = label[i], label[j]
            open_ = a != b
            if not open_.any():
                return
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label[:] = up


def shards(distinct: DataFrame, radius: int, block: int, extra: tuple[str, ...] = (), n: int | None = None) -> DataFrame:
    """(shard, mine, fp, extra): each fingerprint of ``distinct`` in the shard that owns it and in those it overlaps."""
    n = distinct.count() if n is None else n
    mask, r = blocks_of(radius)[block]
    tries = ((mask, r), (_ALL, radius))
    leaves = min(SAMPLE // 24, max(1, n // SHARD))
    want = min(SAMPLE, 24 * leaves)
    part = distinct.where(F.pmod(F.xxhash64("fp"), F.lit(max(1, n // want))) == 0).select("fp") if leaves > 1 else distinct.select("fp").limit(0)
    sample = np.array([x[0] for x in part.limit(2 * SAMPLE).collect()], np.int64).view(np.uint64)
    tree = plan(np.sort(sample), tries, max(16, len(sample) // leaves))[0]

    def spread(batches):
        for b in batches:
            fp = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            out: list = []
            route(tree, fp, out)
            for leaf, index, mine in out:
                rows = b.take(pa.array(index))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(index), leaf, np.int32)), pa.array(mine), *(rows.column(c) for c in ("fp", *extra))], ["shard", "mine", "fp", *extra])

    types = dict(distinct.dtypes)
    schema = "shard int, mine boolean, fp bigint" + "".join(f", {c} {types[c]}" for c in extra)
    return distinct.select("fp", *extra).mapInArrow(spread, schema)


def links(distinct: DataFrame, radius: int, n: int | None = None) -> DataFrame:
    """Edges (u, v) that connect every two fingerprints at ``radius`` or fewer bits, at most one a fingerprint and shard."""
    n = distinct.count() if n is None else n
    blocks, every = blocks_of(radius), None

    def local(tries):
        def run(t: pa.Table) -> pa.Table:
            fp, mine = t.column("fp").to_numpy().view(np.uint64), t.column("mine").to_numpy()
            order = np.argsort(fp, kind="stable")
            fp, mine = fp[order], mine[order]
            forest = Forest(len(fp))
            linked(fp, mine, tries, radius, forest.add_hits)
            bound = np.flatnonzero(forest.label != np.arange(len(fp)))
            return pa.table({"u": fp[bound].view(np.int64), "v": fp[forest.label[bound]].view(np.int64)})

        return run

    for k, (mask, r) in enumerate(blocks):
        part = shards(distinct, radius, k, n=n).groupBy("shard").applyInArrow(local(((mask, r), (_ALL, radius))), "u bigint, v bigint")
        every = part if every is None else every.unionByName(part)
    return every


def simhash_components(docs: DataFrame, shingle_words: int = 3, seed: int = 42, radius: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, one row for each row of ``docs``.

    Rows whose fingerprints differ in at most ``radius`` bits are linked; component_id is the smallest
    doc_id of the component.  Null and empty texts have fingerprint 0 and are linked like any other.
    Repeated rows each stay.  A null doc_id stays and counts for no component_id unless it is alone
    (then component_id is null).  Texts are read whole, however long; other columns are not read, so their names
    may clash.  An empty table gives an empty result.
    """
    prints = stored(fingerprints(docs, shingle_words, seed))
    reps = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    comps = components(links(reps.select("fp"), radius))
    rooted = reps.join(comps.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = stored(rooted)
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = rooted.select("fp", "root").join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Bits that fingerprints of likely near duplicates differ in at most; nodes whose texts are picked by a broadcast, more by a shuffle.
NEAR, PICKED = 3, 500_000


def _sets(col: pa.Array, k: int):
    """Hashes of each row's distinct words and distinct k-word shingles (fewer words: one of all), with offsets; a hash of all words."""
    data, ends = raw(col)
    data = LOWER[data]
    starts, stops, at = words_of(data, ends)
    words = word_hashes(data, starts, stops)
    n = np.diff(at)

    def distinct(row, h):
        order = np.lexsort((h, row))
        row, h = row[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        return h[new], np.concatenate([[0], np.cumsum(np.bincount(row[new], minlength=len(n)))])

    rows = np.arange(len(n))
    full = np.maximum(0, n - k + 1)
    place = np.arange(full.sum()) - np.repeat(np.cumsum(full) - full - at[:-1], full)
    roll = rolling(words, k)
    short = np.flatnonzero((n > 0) & (n < k))
    some = [mix(np.array([int(rolling(words[at[r] : at[r + 1]], n[r])[0]) ^ int(n[r])], np.uint64)) for r in short]
    shingles = np.concatenate([roll[place], *some]) if len(place) or some else np.empty(0, np.uint64)
    owner = np.concatenate([np.repeat(rows, full), short]).astype(np.int64)
    place_in = np.arange(len(words)) - np.repeat(at[:-1], n)
    salted = mix(words ^ (place_in.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(salted, dtype=np.uint64)])
    return distinct(np.repeat(rows, n), words), distinct(owner, shingles), mix(total[at[1:]] - total[at[:-1]] + n.astype(np.uint64))


#: Bits of the map of a text's shingles.
MAP = 1024


def _maps(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each run of hashes MAP bits, each telling whether an odd number of them fall to it: two maps differ in at most as many bits as shingles are in one text alone."""
    out = np.zeros((len(at) - 1, MAP // 8), np.uint8)
    for s in range(0, len(out), 512):
        e = min(len(out), s + 512)
        row = np.repeat(np.arange(e - s), np.diff(at[s : e + 1]))
        spot = row * MAP + ((h[at[s] : at[e]] >> np.uint64(20)) & np.uint64(MAP - 1)).astype(np.int64)
        out[s:e] = np.packbits((np.bincount(spot, minlength=(e - s) * MAP) & 1).astype(np.uint8).reshape(e - s, MAP), axis=1)
    return out


def _wide_map(h: np.ndarray) -> bytes | None:
    """A map of as many bits as there are shingles (the next power of 2) where those are over MAP; folded, it is the map of MAP bits."""
    if len(h) <= MAP:
        return None
    bits = 1 << (len(h) - 1).bit_length()
    return np.packbits(np.bincount(((h >> np.uint64(20)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def _folded(a: bytes, b: bytes) -> int:
    """Bits in which two maps differ, the wider one folded to the other's width."""
    a, b = sorted((np.frombuffer(x, np.uint64) for x in (a, b)), key=len)
    return int(np.bitwise_count(a ^ np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)).sum(dtype=np.int64))


def _prints(docs: DataFrame, k: int) -> DataFrame:
    """key, doc_id, node (hash of the word sequence), fp, the fingerprint of the distinct words, map, wide and size, those of the distinct shingles."""

    def kernel(piece):
        (h, at), (grams, its), node = _sets(piece.column("text"), k)
        wide = pa.array([_wide_map(grams[a:b]) for a, b in zip(its, its[1:], strict=False)], pa.binary())
        maps = pa.FixedSizeBinaryArray.from_buffers(pa.binary(MAP // 8), len(node), [None, pa.py_buffer(_maps(grams, its).tobytes())]).cast(pa.binary())
        return pa.RecordBatch.from_arrays([piece.column("key"), piece.column("doc_id"), *(pa.array(x.view(np.int64)) for x in (node, fold(mix(h), at))), maps, wide, pa.array(np.diff(its))], ["key", "doc_id", "node", "fp", "map", "wide", "size"])

    types = dict(docs.dtypes)
    return map_texts(docs.select("key", "doc_id", "text"), kernel, f"key bigint, doc_id {types['doc_id']}, node bigint, fp bigint, map binary, wide binary, size bigint")


def _alike(nodes: DataFrame) -> DataFrame:
    """Edges (u, v) between nodes of linked fingerprints: each with the first of its fingerprint, and the firsts of fingerprints that link."""
    firsts = stored(nodes.groupBy("fp").agg(F.min("node").alias("first")), small=True)
    same = nodes.join(firsts, "fp").select(F.col("node").alias("u"), F.col("first").alias("v"))
    far = links(firsts.select("fp"), NEAR).join(firsts.select(F.col("fp").alias("u"), F.col("first").alias("a")), "u").join(firsts.select(F.col("fp").alias("v"), F.col("first").alias("b")), "v")
    return same.unionByName(far.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))).where("u != v").distinct()


#: Texts whose shingles are counted to put frequent ones last, and frequent shingles at most.
COUNTED, FREQUENT = 20_000, 65_536


def _frequent(docs: DataFrame, k: int, n: int) -> np.ndarray:
    """Shingles found most often in a sample of about COUNTED texts, the most frequent last."""

    def kernel(piece):
        return pa.RecordBatch.from_arrays([pa.array(_sets(piece.column("text"), k)[1][0].view(np.int64))], ["gram"])

    some = docs.where(F.pmod("key", F.lit(1_000_003)) < int(1_000_003 * min(1.0, COUNTED / max(1, n))))
    counts = map_texts(some.select("text"), kernel, "gram bigint").groupBy("gram").count().where("count > 4")
    rows = counts.orderBy(F.desc("count"), "gram").limit(FREQUENT).collect()
    return np.array([r["gram"] for r in reversed(rows)], np.int64).view(np.uint64)


def _prefixes(docs: DataFrame, k: int, similarity: float, frequent: np.ndarray) -> DataFrame:
    """gram, meta and node: the shingles of each text that another text of that similarity must share one of.

    With n shingles in a fixed order (rare ones first), two texts of the similarity share one of the
    first n - ceil(similarity * n) + 1.  meta holds n and, below it, how many shingles follow, this one included.
    """
    order = np.argsort(frequent)
    keys, ranks = frequent[order], order + 1

    def kernel(piece):
        _, (h, at), node = _sets(piece.column("text"), k)
        n = np.diff(at)
        row = np.repeat(np.arange(len(n)), n)
        if len(keys) and len(h):
            spot = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            h = h[np.lexsort((h, np.where(keys[spot] == h, ranks[spot], 0), row))]
        place = np.arange(len(h)) - at[row]
        first = place <= (n - np.ceil(similarity * n - 1e-9))[row]
        size = n[row[first]].astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array((size << 32) | (size - place[first])), pa.array(node[row[first]].view(np.int64))], ["gram", "meta", "node"])

    return map_texts(docs.select("text"), kernel, "gram bigint, meta bigint, node bigint")


def _runs(rows: DataFrame, kernel, schema: str) -> DataFrame:
    """``kernel`` (columns as arrays to batches of columns) over whole runs of one gram, sorted by gram, meta and node."""
    names = rows.columns
    out_names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        tail = None
        for b in batches:
            cols = [np.frombuffer(raw(b.column(c))[0].tobytes(), np.uint64).reshape(b.num_rows, -1) if c == "map" else b.column(c).to_numpy(zero_copy_only=False) for c in names]
            if tail is not None:
                cols = [np.concatenate(x) for x in zip(tail, cols, strict=True)]
            last = int(np.searchsorted(cols[0], cols[0][-1])) if len(cols[0]) else 0
            tail = [c[last:] for c in cols]
            if last:
                for out in kernel(*(c[:last] for c in cols)):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], out_names)
        if tail is not None and len(tail[0]):
            for out in kernel(*tail):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], out_names)

    return rows.repartition("gram").sortWithinPartitions("gram", "meta", "node").mapInArrow(run, schema)


def _meeting(prefixes: DataFrame, similarity: float) -> DataFrame:
    """The rows of ``prefixes`` whose shingle another node of a size that allows the similarity has, too; repeated rows once."""

    def kernel(gram, meta, node):
        new = np.ones(len(gram), bool)
        new[1:] = (gram[1:] != gram[:-1]) | (meta[1:] != meta[:-1]) | (node[1:] != node[:-1])
        gram, meta, node = gram[new], meta[new], node[new]
        size = meta >> 32
        near = (gram[1:] == gram[:-1]) & (size[:-1] >= similarity * size[1:] - 1e-9)
        keep = np.zeros(len(gram), bool)
        keep[1:] |= near
        keep[:-1] |= near
        if keep.any():
            yield gram[keep], meta[keep], node[keep]

    return _runs(prefixes, kernel, "gram bigint, meta bigint, node bigint")


def _may(a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether two texts may be that similar, by their sizes and by what follows a shingle that they share first."""
    x, y = a >> 32, b >> 32
    rest = np.minimum(a & 0xFFFFFFFF, b & 0xFFFFFFFF)
    return (np.minimum(x, y) >= similarity * np.maximum(x, y) - 1e-9) & (rest >= similarity / (1 + similarity) * (x + y) - 1e-9)


def _hubs(meeting: DataFrame, similarity: float) -> DataFrame:
    """Edges (u, v) of each node with that node of its shingles which meets others in most shingles, such as the original of many copies.

    Only pairs that may reach the similarity and that meet in several shingles.
    """

    def kernel(gram, meta, node, many):
        order = np.lexsort((node, -many, gram))
        first = np.concatenate([[True], gram[1:] != gram[:-1]])  # gram is sorted already
        at = order[np.flatnonzero(first)[np.cumsum(first) - 1]]
        hub = node[at]
        other = (hub != node) & _may(meta, meta[at], similarity)
        yield np.maximum(hub, node)[other], np.minimum(hub, node)[other]

    many = meeting.groupBy("node").agg(F.count("*").alias("many"))
    pairs = _runs(meeting.join(many, "node").select("gram", "meta", "node", "many"), kernel, "u bigint, v bigint")
    return pairs.groupBy("u", "v").count().where("count > 2").select("u", "v")


#: Rows of one shingle beyond which its pairs are compared by the maps of their shingles before they are given on; rows compared with all others at once.
FEW, BLOCK = 16, 256


def _crowds(meeting: DataFrame, similarity: float) -> DataFrame:
    """u and v of pairs of different groups that share a shingle of few rows and may reach the similarity; and the rows of other shingles (meta set)."""

    def kernel(gram, meta, node, group):
        first = np.concatenate([[True], gram[1:] != gram[:-1]])
        starts = np.flatnonzero(first)
        run = np.cumsum(first) - 1
        mixed = np.minimum.reduceat(group, starts) != np.maximum.reduceat(group, starts)
        many = np.diff(np.append(starts, len(gram))) > FEW
        crowd = (mixed & many)[run]
        if crowd.any():
            yield gram[crowd], node[crowd], meta[crowd], group[crowd]
        own = (mixed & ~many)[run]
        gram, meta, node, group = gram[own], meta[own], node[own], group[own]
        parts = []
        for s in range(1, FEW):
            k = np.arange(max(0, len(gram) - s))
            k = k[(gram[k] == gram[k + s]) & (group[k] != group[k + s]) & _may(meta[k], meta[k + s], similarity)]
            parts.append(np.stack([np.maximum(node[k], node[k + s]), np.minimum(node[k], node[k + s])]))
        u, v = np.concatenate(parts, axis=1)
        none = np.zeros(len(u), np.int64)
        yield u, v, none, none

    return _runs(meeting.select("gram", "meta", "node", "group"), kernel, "u bigint, v bigint, meta bigint, grp bigint")


def _close(crowds: DataFrame, maps: DataFrame, similarity: float, nearest: bool) -> DataFrame:
    """Edges (u, v) of nodes of different groups in one crowd whose maps allow the similarity: all, or for each row the one of the most alike map."""
    apart = (1 - similarity) / (1 + similarity)

    def kernel(gram, meta, node, group, map_):
        ends = np.append(np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])), len(gram))
        for a, b in zip(ends, ends[1:], strict=False):
            size = meta[a:b] >> 32
            for s in range(a, b, BLOCK):
                e = min(b, s + BLOCK)
                ok = (group[s:e, None] != group[None, a:b]) & _may(meta[s:e, None], meta[None, a:b], similarity)
                if not nearest:
                    ok &= np.arange(a, b)[None] > np.arange(s, e)[:, None]
                some, cols = np.flatnonzero(ok.any(1)), np.flatnonzero(ok.any(0))
                if not len(some):
                    continue
                ok, own, other = ok[np.ix_(some, cols)], map_[s:e][some], map_[a:b][cols]
                gap = np.zeros(ok.shape, np.uint16)
                for w in range(map_.shape[1]):
                    gap += np.bitwise_count(own[:, w, None] ^ other[None, :, w])
                ok &= gap <= apart * (size[s - a : e - a][some][:, None] + size[cols][None]) + 1e-9
                if nearest:
                    gap[~ok] = 60_000
                    j = gap.argmin(1)
                    i = np.flatnonzero(ok[np.arange(len(j)), j])
                    j = j[i]
                else:
                    i, j = np.nonzero(ok)
                if len(i):
                    x, y = node[s:e][some][i], node[a:b][cols][j]
                    yield np.maximum(x, y), np.minimum(x, y)

    rows = crowds.where("meta != 0").select(F.col("u").alias("gram"), "meta", F.col("v").alias("node"), F.col("grp").alias("group"))
    return _runs(rows.join(maps, "node").select("gram", "meta", "node", "group", "map"), kernel, "u bigint, v bigint").distinct()


def _allowed(pairs: DataFrame, maps: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose maps allow the similarity."""
    apart = (1 - similarity) / (1 + similarity)

    def run(batches):
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(raw(b.column(c))[0].tobytes(), np.uint64).reshape(b.num_rows, -1) for c in ("a", "b"))
                gap = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
                both_wide = np.flatnonzero(b.column("wide_a").is_valid().to_numpy(zero_copy_only=False) & b.column("wide_b").is_valid().to_numpy(zero_copy_only=False))
                for k in both_wide:
                    gap[k] = _folded(b.column("wide_a")[int(k)].as_py(), b.column("wide_b")[int(k)].as_py())
                yield b.select(["u", "v"]).filter(pa.array(gap <= apart * b.column("both").to_numpy() + 1e-9))

    both = pairs.join(maps.toDF("u", "a", "wide_a", "n"), "u").join(maps.toDF("v", "b", "wide_b", "m"), "v")
    return both.select("u", "v", "a", "b", "wide_a", "wide_b", (F.col("n") + F.col("m")).alias("both")).mapInArrow(run, "u bigint, v bigint")


def near_duplicate_groups(docs: DataFrame, shingle_words: int = 5, similarity: float = 0.8) -> DataFrame:
    """key (xxhash64 of doc_id and text), doc_id, node and group, for each row of ``docs`` (doc_id, text).

    Texts of equal words are one node.  Two nodes are linked where the Jaccard similarity of their
    distinct shingles, computed from the shingles themselves, is ``similarity`` or more; links make the
    groups.  First come the likely pairs: nodes of word fingerprints that the vantage-point trees link, and
    nodes with the hubs of their shingles; then, in shingles of many rows, each node with the one most alike.
    Then every other pair of different groups that shares a shingle of its prefixes (as any two texts of the
    similarity do) and that the maps of its shingles allow is verified.
    """
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))
    prints = stored(_prints(keyed, shingle_words))
    nodes = stored(prints.groupBy("node").agg(*(F.min(c).alias(c) for c in ("fp", "key", "map", "wide", "size"))))
    meeting = stored(_meeting(_prefixes(keyed, shingle_words, similarity, _frequent(keyed, shingle_words, nodes.count())), similarity))
    met = meeting.select("node").distinct()

    def kernel(piece):
        node, (_, (h, at), _) = piece.column("node"), _sets(piece.column("text"), shingle_words)
        return pa.RecordBatch.from_arrays([node, pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(h.view(np.int64)))], ["node", "shingles"])

    def verified(pairs):
        pairs = stored(_allowed(pairs, nodes.select("node", "map", "wide", "size"), similarity), small=True)
        ends = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
        picked = stored(nodes.join(ends, "node", "left_semi").select("key", "node"), small=True)
        picked = F.broadcast(picked) if picked.count() <= PICKED else picked
        sets = stored(map_texts(keyed.join(picked, "key").select("node", "text"), kernel, "node bigint, shingles array<bigint>").dropDuplicates(["node"]))
        both = pairs.join(sets.withColumnsRenamed({"node": "u", "shingles": "a"}), "u").join(sets.withColumnsRenamed({"node": "v", "shingles": "b"}), "v")
        shared = F.size(F.array_intersect("a", "b"))
        return both.where(shared >= F.lit(similarity) * (F.size("a") + F.size("b") - shared) - 1e-9).select("u", "v")

    def regrouped(links_):
        found = stored(components(links_), small=True)
        rooted = meeting.join(found.withColumnRenamed("root", "group"), "node", "left").withColumn("group", F.coalesce("group", "node"))
        return found.select(F.col("node").alias("u"), F.col("root").alias("v")), stored(_crowds(rooted, similarity), small=True)

    likely = _alike(nodes.select("node", "fp")).join(met.withColumnRenamed("node", "u"), "u", "left_semi").join(met.withColumnRenamed("node", "v"), "v", "left_semi")
    maps = nodes.select("node", "map")
    links_, crowds = regrouped(verified(likely.unionByName(_hubs(meeting, similarity)).distinct()))
    links_, crowds = regrouped(links_.unionByName(verified(_close(crowds, maps, similarity, True))))
    pairs = crowds.where("meta = 0").select("u", "v").unionByName(_close(crowds, maps, similarity, False)).distinct()
    links_ = links_.unionByName(verified(pairs))
    comps = components(links_).withColumnsRenamed({"root": "group"})
    return prints.select("key", "doc_id", "node").join(comps, "node", "left").withColumn("group", F.coalesce("group", "node"))


def one_of_each(docs: DataFrame, shingle_words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one document of each group of near duplicates: that of the smallest doc_id (null last).

    Rows alike in doc_id and text are one document and stay or go together; null and empty texts are
    near duplicates of each other.  All columns stay.
    """
    groups = stored(near_duplicate_groups(docs, shingle_words, similarity))
    first = groups.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first")).select("first.key")
    (named,) = fresh(docs.columns, "row_key")
    return docs.withColumn(named, F.xxhash64("doc_id", "text")).join(first.withColumnRenamed("key", named), named, "left_semi").drop(named)

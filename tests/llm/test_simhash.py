import itertools
import random

import numpy as np
import pytest
import xxhash

from tessera.llm.graph import components
from tessera.llm.simhash import simhash_components

SCHEMA = "doc_id bigint, text string, fp string"


def brute(rows):
    def fp(text):
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
        if not w:
            return 0
        sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
        hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    fps = [fp(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if bin(fps[i] ^ fps[j]).count("1") <= 3:
            up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [(d, f"{fps[i]:016x}", least.get(root(i))) for i, (d, _) in enumerate(rows)]


def check(spark, rows):
    df = spark.createDataFrame([(d, t, "clash") for d, t in rows], SCHEMA)
    got = [tuple(r) for r in simhash_components(df).collect()]
    key = lambda x: tuple(str(v) for v in x)
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_against_brute_force(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(120):
        words = [rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 50, 300]))]
        rows.append((i, " ".join(words)))
        for _ in range(rng.randrange(3)):
            copy = list(words)
            copy[rng.randrange(len(copy))] = "Changed"
            rows.append((1000 + len(rows), "\t".join(copy)))
    rows += [(5, rows[0][1]), (5, rows[0][1]), (7001, None), (7002, ""), (None, rows[3][1]), (None, "alone here now"), (7003, "a " * 50000)]
    check(spark, rows)


def test_empty(spark):
    assert simhash_components(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("shape", ["chain", "star", "random"])
def test_components(spark, shape):
    rng = np.random.default_rng(1)
    edges = {"chain": [(i, i + 1) for i in range(60)], "star": [(500, i) for i in range(40)], "random": [tuple(map(int, rng.integers(0, 90, 2))) for _ in range(60)]}[shape]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    up = {n: n for e in edges for n in e if e[0] != e[1]}
    for _ in up:
        for a, b in edges:
            if a != b:
                up[a] = up[b] = min(up[a], up[b])
    assert got == up


def test_trees_find_every_pair():
    from tessera.llm.simhash import Forest, blocks_of, linked, plan, route

    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    near = base[rng.integers(0, 3000, 3000)]
    for _ in range(3):
        near = near ^ (np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64))
    fp = np.unique(np.concatenate([base, near, np.uint64(1) << np.arange(64, dtype=np.uint64)]))
    want = Forest(len(fp))
    for k in range(len(fp)):
        j = np.flatnonzero(np.bitwise_count(fp ^ fp[k]) <= 3)
        want.add(np.full(len(j), k), j)
    got = Forest(len(fp))
    for mask, r in blocks_of(3):
        tries = ((mask, r), (np.uint64(0xFFFFFFFFFFFFFFFF), 3))
        out = []
        route(plan(fp[::7], tries, 100)[0], fp, out)
        assert len({leaf for leaf, _, _ in out}) > 4
        for leaf in {x[0] for x in out}:
            at = np.concatenate([i for n, i, _ in out if n == leaf])
            mine = np.concatenate([m for n, _, m in out if n == leaf])[np.argsort(at)]
            at = np.sort(at)
            linked(fp[at], mine, tries, 3, lambda i, j, hit, at=at: got.add_hits(at[i], at[j], hit))
    assert (got.label == want.label).all()


def test_maps_bound_the_difference():
    from tessera.llm.simhash import MAP, _folded, _maps, _wide_map

    rng = np.random.default_rng(7)
    sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (0, 1, 30, 900, 1024, 1025, 3000, 9000)]
    sets += [np.unique(np.concatenate([s[: len(s) // 2], rng.integers(0, 1 << 63, len(s) // 3, dtype=np.uint64)])) for s in sets]
    maps = _maps(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])]))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            apart = len(np.setxor1d(a, b))
            x, y = (_wide_map(s) or maps[k].tobytes() for s, k in ((a, i), (b, j)))
            narrow = int(np.bitwise_count(maps[i] ^ maps[j]).sum())
            assert narrow <= _folded(x, y) <= apart and (narrow - apart) % 2 == 0
    assert len(_wide_map(sets[5])) * 8 == 2 * MAP and _wide_map(sets[4]) is None

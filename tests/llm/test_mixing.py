from collections import defaultdict

from tessera.llm.mixing import mix_report, mixed


def targets(sizes, weights=(5, 2, 1), most=3):
    """The shares by repeated capping."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        open_ = [s for s in order if s not in capped]
        rest = total - sum(capped.values())
        share = {s: rest * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > most * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: most * sizes[s] for s in over}


def test_targets_and_budgets(frame, rng, odd):
    rows = [(i, "w " * rng.randrange(0, 60), None, rng.choice(["a", "a", "a", "b", "c", "d", None]), 0) for i in range(600)] + odd
    got = mix_report(frame(rows)).collect()
    assert len(got) == len(rows)
    by_id = {(r[0], r[1]): r[3] for r in rows}
    sizes, taken, target, largest = defaultdict(int), defaultdict(int), {}, defaultdict(int)
    text = {r[0]: r for r in rows}
    for r in got:
        source = text[r.doc_id][3]
        sizes[source] += r["size"]
        taken[source] += r.taken
        target[source] = r.target
        largest[source] = max(largest[source], r["size"])
        assert r["size"] == len((text[r.doc_id][1] or "").encode().split())
        assert 0 <= r.taken <= 3 * r["size"]
    want = targets(dict(sizes))
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6
        assert abs(taken[s] - target[s]) <= largest[s]
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mix_report(frame(rows).repartition(7)).collect()), key=str)
    assert by_id


def test_no_row_is_taken_too_often(frame):
    rows = [(i, "w w" if i % 3 else "", None, "z" if i < 30 else "a", 0) for i in range(33)] + [(100, "w " * 4000, None, "b", 0)]
    df = frame(rows)
    got = mixed(df).collect()
    assert len(got) == len(rows) and max(r.copies for r in got) == 3
    assert set(df.columns) - {"size", "source_size", "target"} <= set(mixed(df).columns)


def test_empty_and_wordless(frame):
    assert mix_report(frame([])).collect() == []
    got = mix_report(frame([(1, None, None, "a", None), (2, "", None, None, None)])).collect()
    assert [(r["size"], r.taken) for r in got] == [(0, 0), (0, 0)]
    assert "copies" in mixed(frame([])).columns

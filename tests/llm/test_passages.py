import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import substrings
from tessera.llm.decontam import Block, contaminated, without_contaminated

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def shingles(text, k):
    w = WORD.findall(lower(text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def test_containment_against_brute_force(frame, spark, rng, odd):
    vocab = [f"w{i}" for i in range(400)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, prose(rng.choice([2, 4, 5, 12, 30, 60])), "x") for i in range(40)] + [(7, "", "x"), (8, None, "x"), (9, "...", "x"), (None, "null item of six words here", "x")]
    rows = list(odd)
    for i in range(120):
        words = prose(rng.randrange(400)).split()
        for _ in range(rng.randrange(3)):
            part = rng.choice(items[:40])[1].upper().split()
            for _ in range(rng.randrange(3)):
                part[rng.randrange(len(part))] = "CHANGED"
            words[(at := rng.randrange(len(words) + 1)) : at] = part
        rows.append((i, ", ".join(words), None, None, 0))
    bench = spark.createDataFrame(items, "item_id bigint, text string, containment string")
    got = contaminated(frame(rows), bench).collect()
    want = []
    for d, text, *_ in rows:
        for i, item, _ in items:
            n = len(WORD.findall(lower(item or "")))
            s = shingles(item, min(5, n)) if n else set()
            if s and len(s & shingles(text, min(5, n))) >= 0.8 * len(s) - 1e-9:
                want.append((d, i, round(len(s & shingles(text, min(5, n))) / len(s), 9)))
    assert len(want) > 30
    assert sorted(((r.doc_id, r.item_id, round(r.containment, 9)) for r in got), key=str) == sorted(want, key=str)
    bad = {d for d, _, _ in want}
    kept = without_contaminated(frame(rows), bench)
    assert kept.columns == frame(rows).columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((r[0] for r in rows if r[0] not in bad), key=str)
    assert contaminated(frame([]), bench).collect() == [] and contaminated(frame(rows), bench.limit(0)).collect() == []


def test_a_prompt_that_all_items_share(frame, spark, rng):
    prompt = " ".join(f"p{i}" for i in range(12))
    items = [(i, prompt + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 60)))) for i in range(300)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    rows = [(i, f"{prompt} {prompt} x{i}", None, None, 0) for i in range(50)] + [(100 + i, f"a b {items[i][1]} c", None, None, 0) for i in range(0, 300, 7)]
    got = {(r.doc_id, r.item_id) for r in contaminated(frame(rows), bench).collect()}
    want = {(d, i) for d, t, *_ in rows for i, x in items if len(shingles(x, 5) & shingles(t, 5)) >= 0.8 * len(shingles(x, 5)) - 1e-9}
    assert got == want and len(want) > 43
    texts = pa.table({"text": [x for _, x in items]})
    index = Block.of(texts, 5, 0.8).lengths[5]
    assert len(index.parts) > 2 and max(np.unique(index.keys, return_counts=True)[1]) == 1
    long = [i for i, (_, x) in enumerate(items) if len(x.split()) > 40]
    common = set(np.intersect1d(*[index.hashes[index.owner == i] for i in long[:2]]).tolist())
    assert all(not common & set(part.keys[np.isin(part.owner, long)].tolist()) for part in index.parts)


def remove(rows, window=20):
    """Words that go, by brute force; rows alike in id and text are one."""
    seen, out = {}, {}
    for d, t in sorted({(d, t) for d, t in rows}, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen.setdefault(tuple(w[i : i + window]), (d, t, i)) != (d, t, i):
                gone[i : i + window] = [True] * window
        out[d, t] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("group", [20_000, 1])
def test_windows_against_brute_force(frame, rng, odd, monkeypatch, group):
    monkeypatch.setattr(substrings, "GROUP", group)
    vocab = [f"w{i}" for i in range(3000)]
    prose = lambda n: [rng.choice(vocab) for _ in range(n)]
    passages = [prose(n) for n in (19, 20, 21, 25, 60)]
    rows = [(r[0], r[1]) for r in odd]
    for i in range(120):
        words = []
        for _ in range(rng.randrange(1, 5)):
            words += prose(rng.randrange(60))
            p = rng.choice(passages)
            words += p[rng.randrange(3) :] if rng.random() < 0.7 else ["again"] * rng.randrange(50)
        rows.append((i, rng.choice([" ", "\n"]).join(words)))
        if rng.random() < 0.2:
            rows.append((1000 + i, rows[-1][1]))
    rows.append(rows[20])
    got = substrings.substring_report(frame([(d, t, None, None, 0) for d, t in rows]).repartition(5)).collect()
    want = remove(rows)
    assert sorted(map(tuple, got), key=str) == sorted(((d, *want[d, t]) for d, t in rows), key=str)


def test_removal_keeps_the_rest(frame, rng):
    shared = [f"s{i}" for i in range(30)]
    rows = [(1, "a\n" + " ".join(shared) + "\n b", "en", "x", 5), (2, "c  d\n" + " ".join(shared) + "\te\nf", "en", "x", 5), (3, " ".join(shared), "en", "x", 5), (4, None, "en", "x", None)]
    got = {r.doc_id: r for r in substrings.without_repeats(frame(rows)).collect()}
    assert got[1].text == rows[0][1] and got[2].text.split() == ["c", "d", "e", "f"] and got[2].text.startswith("c  d\n") and 3 not in got and got[4].text is None
    assert got[2].n_chars == len(got[2].text) and got[2].k == "x"
    assert substrings.substring_report(frame([])).collect() == []

import sys

import corpus_pipeline
from tessera.llm.simhash import near_duplicate_groups, one_of_each

assert "tessera.llm" in sys.modules


def jaccard(a, b):
    s = lambda t: {tuple(t.lower().split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))}
    return len(s(a) & s(b)) / len(s(a) | s(b))


def test_near_duplicates(frame, rng, odd):
    vocab = [f"w{i}" for i in range(2000)]
    rows, truth = list(odd), {}
    for i in range(150):
        words = [rng.choice(vocab) for _ in range(rng.randrange(60, 400))]
        rows.append((i, " ".join(words), None, None, 0))
        for j in range(rng.randrange(3)):
            copy = list(words)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = "changed"
            rows.append((1000 + 10 * i + j, " ".join(copy).upper(), None, None, 0))
            if jaccard(rows[-1][1], " ".join(words)) >= 0.8:
                truth[1000 + 10 * i + j] = i
    got = {r.doc_id: r.group for r in near_duplicate_groups(frame(rows)).collect()}
    found = sum(got[a] == got[b] for a, b in truth.items())
    assert len(truth) > 80 and found / len(truth) > 0.97
    assert len({got[i] for i in range(150)}) == 150
    kept = one_of_each(frame(rows))
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None and r.doc_id < 9000)
    assert ids == sorted(i for i in range(150)) + [i for i in ids if i >= 1000]
    assert kept.columns == frame(rows).columns
    assert one_of_each(frame([])).collect() == []


def test_stages_in_order(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "substring_dedup", "decontamination", "mixing"]
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert set(docs.columns) < set(out.columns) and 0 < out.select("doc_id").distinct().count() < docs.count()


def groups_by_force(texts, least=0.8):
    s = [{tuple(t.lower().split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in texts]
    label = list(range(len(s)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(s)):
        for j in range(i):
            if min(len(s[i]), len(s[j])) >= least * max(len(s[i]), len(s[j])):
                both = len(s[i] & s[j])
                if both >= least * (len(s[i]) + len(s[j]) - both):
                    a, b = sorted((root(i), root(j)))
                    label[b] = a
    return [root(i) for i in range(len(s))]


def check_groups(frame, texts):
    truth = groups_by_force(texts)
    rows = near_duplicate_groups(frame([(i, t, None, None, 0) for i, t in enumerate(texts)])).collect()
    got = {r.doc_id: r.group for r in rows}
    first = {}
    for i in range(len(texts)):
        first.setdefault(got[i], i)
    assert len(rows) == len(texts)
    assert [first[got[i]] for i in range(len(texts))] == truth
    return truth


def test_star_of_copies(frame, rng):
    words = [f"w{rng.randrange(5000)}" for _ in range(200)]
    texts = []
    for _ in range(1000):
        copy = list(words)
        for at in rng.sample(range(200), 4):
            copy[at] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    texts.insert(500, " ".join(words))
    assert len(set(check_groups(frame, texts))) < 400


def test_kinds_of_copies(frame, rng):
    texts = []
    for i in range(60):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(60, 200))]
        n = len(words) // 6
        texts += [" ".join(words), " ".join(words + [f"y{rng.randrange(10**6)}" for _ in range(n)]), " ".join(words[:-n])]
        short = [f"w{rng.randrange(3000)}" for _ in range(13)]
        texts += [" ".join(short), " ".join([*short, "more"]), " ".join(short[:8]), " ".join([*short[:8], "one"])]
    truth = check_groups(frame, texts)
    assert all(truth[7 * i] == truth[7 * i + k] for i in range(60) for k in (1, 2)) and len(set(truth)) < 200

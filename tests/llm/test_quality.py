import re
from collections import Counter

from tessera.llm.quality import Rule, learn, quality_report, verdict


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(grams)
    covered = {j for i, g in enumerate(grams) if n[g] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_against_brute_force(frame, spark, rng, odd):
    vocab = ["a", "b", "é#", "c|d", "WORD", "$$"]
    rows = [(i, "".join(rng.choice(vocab) + rng.choice([" ", "  ", "\n", "\t", "\x0b"]) for _ in range(rng.randrange(120))), None, None, 0) for i in range(150)] + odd
    rows.append((800, " ".join(f"w{i}" for i in range(60)), None, None, 0))
    labels = spark.createDataFrame([(1, 0, 0)], "doc_id bigint, quality int, toxic int").limit(0)
    got = quality_report(frame(rows), labels).collect()
    want = [(r[0], *brute(r[1]), not brute(r[1])[-1]) for r in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert quality_report(frame([]), labels).collect() == []


def test_learned_list_separates(frame, spark, rng):
    good = [(i, " ".join(f"w{rng.randrange(9999)}" for _ in range(80)), None, None, 0) for i in range(200)]
    bad = [(i, " ".join(f"w{rng.randrange(9999)}$$$" for _ in range(80)), None, None, 0) for i in range(200, 300)]
    labels = spark.createDataFrame([(i, int(i < 200), 0) for i in range(300)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r.kept for r in quality_report(frame(good + bad), labels).collect()}
    assert all(got[i] == (i < 200) for i in range(300))


def test_learner_on_conjunctions(rng):
    rows = []
    for i in range(600):
        r = {"a": rng.random(), "b": rng.random(), "prune": int(i % 3 == 0)}
        rows.append(r | {"bad": int(r["a"] > 0.6 and r["b"] <= 0.3)})
    rules = learn(rows, ("a", "b"))
    assert rules and all(any(x.holds(r) for x in rules) == bool(r["bad"]) for r in rows if abs(r["a"] - 0.6) > 0.05 and abs(r["b"] - 0.3) > 0.05)
    assert "CASE WHEN" in str(verdict([Rule((("a", ">", 0.5),))]))

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from tessera.llm import hmm, langid, toxicity

SYLLABLES = {"en": "th er on an re he in ed".split(), "de": "sch ei ung ü ich ß ver".split(), "fr": "eau é è ou que oi ç".split()}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def documents(rng, n):
    return [(i, text(rng, (lang := rng.choice(list(SYLLABLES))), rng.randrange(3, 120)), lang, "s", 0) for i in range(n)]


def test_language_held_out(frame, rng, odd):
    rows = documents(rng, 400) + odd
    got = langid.language_report(frame(rows)).collect()
    assert len(got) == len(rows)
    truth = {r[0]: r[2] for r in rows[:400]}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 50 and sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.98
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (9001, 9002, 9003))
    assert all(r.lang_pred in SYLLABLES or r.lang_pred == "und" for r in got) and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    assert langid.language_report(frame([])).collect() == []
    assert {r.lang_pred for r in langid.language_report(frame([(1, "abc", None, None, 0)])).collect()} == {"und"}


def test_language_model_is_a_distribution(rng):
    model = langid.train([text(rng, "en", 200) for _ in range(10)] + [text(rng, "fr", 200) for _ in range(10)], ["en"] * 10 + ["fr"] * 10)
    size = 1 << langid.BITS
    for context in (0, 5, 5 * size + 3, (1 * size + 2) * size + 3, 7777):
        code = (np.uint32(context) << np.uint32(langid.BITS)) + np.arange(size, dtype=np.uint32)
        assert np.allclose(np.exp(model.log_probabilities(code).astype(float)).sum(0), 1, atol=1e-3)


def test_languages_of_many_letters(rng):
    def words(first, n):  # two languages of one script: the same letters in another order
        pairs = [chr(first + i) + chr(0x4E00 + (i * 37 + first) % 900) for i in range(300)]
        return " ".join("".join(rng.choices(pairs, k=3)) for _ in range(n))

    make = {"a": lambda n: words(0x4E00, n), "b": lambda n: words(0x4F00, n), "en": lambda n: text(rng, "en", n), "ru": lambda n: " ".join("".join(chr(rng.randrange(0x430, 0x450)) for _ in range(5)) for _ in range(n))}
    langs = [x for x in make for _ in range(60)]
    model = langid.train([make[x](80) for x in langs], langs)
    assert model.bits > langid.BITS and len(set(model.numbers[[ord(c) for c in "th\u0436\u4e00\u4e01\u4f05"]])) == 6
    asked = [x for x in make for _ in range(50)]
    entropy, _ = model.entropies([make[x](6) for x in asked])
    assert np.mean([model.languages[k] == x for k, x in zip(entropy.argmin(1), asked, strict=True)]) > 0.97
    code = (np.uint64(5) << np.uint64(model.bits)) + np.arange(len(model.single), dtype=np.uint64)
    assert np.allclose(np.exp(model.log_probabilities(code).astype(float)).sum(0), 1, atol=1e-3)


def test_learning_texts_are_bounded_by_bytes(frame, monkeypatch):
    monkeypatch.setattr(langid, "LABELLED_BYTES", 2_000)
    rows = [(i, f"word{i} " * 50, "en", None, 0) for i in range(200)] + [(1000, "ein langer text " * 2000, "de", None, 0)]
    seen = []
    monkeypatch.setattr(langid, "train", lambda texts, langs: seen.append((texts, langs)))
    langid.learn(frame(rows), held=None)
    texts, langs = seen[0]
    assert set(langs) == {"en", "de"} and 0 < langs.count("en") < 40 and langs.count("de") == 1


def test_six_scripts(rng):
    blocks = {"en": (0x61, 26), "ru": (0x430, 32), "el": (0x3B1, 24), "hy": (0x561, 38), "he": (0x5D0, 27), "ka": (0x10D0, 33)}
    word = lambda lang: "".join(chr(blocks[lang][0] + rng.randrange(blocks[lang][1])) for _ in range(5))
    make = lambda lang: " ".join(word(lang) for _ in range(30))
    langs = [x for x in blocks for _ in range(40)]
    model = langid.train([make(x) for x in langs], langs)
    asked = [x for x in blocks for _ in range(30)]
    entropy, _ = model.entropies([make(x) for x in asked])
    assert [model.languages[k] for k in entropy.argmin(1)] == asked


def test_all_languages_are_learned(frame):
    rows = [(6 * k + i, f"lang{k} word " * 3, f"l{k}", None, 0) for k in range(300) for i in range(6)]
    assert len(langid.learn(frame(rows), held=None).languages) == 300


def test_toxicity_held_out(frame, spark, rng, odd):
    rows = []
    for i in range(800):
        words = text(rng, "en", 60).split()
        if i % 4 == 0:
            for w in rng.sample(["vile", "foulest", "foulness"], 2):
                words.insert(rng.randrange(len(words)), w)
        rows.append((i, " ".join(words), None, None, 0))
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(800)] + [(None, 1, 1), (9001, 0, None)], "doc_id bigint, quality int, toxic int")
    got = toxicity.toxicity_report(frame(rows + odd), labels).collect()
    assert len(got) == 807 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 800]
    assert len(held) > 100 and sum(r.predicted == int(r.doc_id % 4 == 0) for r in held) / len(held) > 0.97
    assert toxicity.toxicity_report(frame([]), labels).collect() == []
    none = toxicity.toxicity_report(frame(odd), labels.limit(0)).collect()
    assert len(none) == len(odd) and all(r.predicted == 0 for r in none)


def test_toxicity_gradients():
    rng = np.random.default_rng(4)
    t = toxicity
    texts = pa.array(["one two three four five", "two two six", "seven", "", "one six seven eight nine ten"])
    rows, ends, _ = t.encode(texts)
    hidden = t.SIDES * t.DIM
    model = t.Model([rng.normal(0, 0.5, (t.BUCKETS, t.DIM)) for _ in range(t.SIDES)], [[rng.normal(0, 0.5, (hidden, t.FILTERS)) for _ in range(w)] for w in t.WIDTHS], [rng.normal(0, 0.1, t.FILTERS) for _ in t.WIDTHS], rng.normal(0, 0.5, t.FILTERS * len(t.WIDTHS)), 0.2, np.zeros((1, t.SHORT + t.LEADS)), np.zeros(1))
    toxic, weight = np.array([1, 0, 1, 0, 1]), np.array([1.0, 2.0, 0.5, 1.0, 1.5])
    loss = lambda: t.gradients(model, rows, ends, toxic, weight)[0]
    _, found, where, grad = t.gradients(model, rows, ends, toxic, weight)

    def slope(array, at, e=1e-6):
        old = array[at]
        array[at] = old + e
        up = loss()
        array[at] = old - e
        down = loss()
        array[at] = old
        return (up - down) / (2 * e)

    for wi, w in enumerate(t.WIDTHS):
        for j in range(w):
            for at in [(0, 0), (7, 3), (19, 5)]:
                assert abs(slope(model.filters[wi][j], at) - found["f", wi, j][at]) < 1e-6
        assert abs(slope(model.bias[wi], 2) - found["b", wi][2]) < 1e-6
    assert all(abs(slope(model.out, k) - found["out"][k]) < 1e-6 for k in range(len(model.out)))
    for side in (0, 3):
        for bucket in np.unique(rows[side])[1:5]:
            want = grad[rows[side][where] == bucket][:, side * t.DIM : (side + 1) * t.DIM].sum(0)
            assert all(abs(slope(model.tables[side], (bucket, k)) - want[k]) < 1e-6 for k in range(t.DIM))


def test_toxicity_thresholds_by_language():
    rng = np.random.default_rng(6)
    cluster = rng.integers(0, 3, 900)
    toxic = rng.integers(0, 2, 900)
    z = toxic * 2.0 - 1 + np.array([0.0, 5.0, -5.0])[cluster] + rng.uniform(-0.3, 0.3, 900)
    cuts = toxicity.calibrated(z, toxic, cluster, 4)
    assert np.allclose(cuts[:3], [0, 5, -5], atol=0.5)
    few = toxicity.calibrated(np.array([0.0, 1, 2, 3]), np.array([0, 0, 1, 1]), np.zeros(4, int), 2)
    assert few.tolist() == [1.5, 1.5]
    words = {"en": "the of and to in is it on as at", "ru": "и в не на что он я с", "el": "και το να του η της", "zh": "的一是不了"}
    texts = [" ".join(rng.choice(w.split(), 40)) + " " + str(i) for i, w in enumerate(words.values()) for _ in range(1)] * 5
    profile = toxicity.encode(pa.array(texts))[2]
    near = toxicity._nearest(profile, toxicity._clusters(profile, 4))
    assert len(set(near.tolist())) == 4 and (near.reshape(5, 4) == near[:4]).all()


def test_hidden_markov_scores(frame, rng, odd):
    rows = documents(rng, 300) + odd
    got = hmm.hmm_scores(frame(rows), top=100, states=3, rounds=1).collect()
    assert len(got) == len(rows)
    words = lambda t: (t or "").encode().lower().split() + [b"\0end"]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    count = Counter()
    for r in rows:
        if not held(r[0]):
            count.update(words(r[1]))
    n, v = sum(count.values()), len(count)
    want = sorted(((r[0], held(r[0]), len(words(r[1])), sum(count[w] > 0 for w in words(r[1])), n, round(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words(r[1])), 5)) for r in rows), key=str)
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got), key=str) == want
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    few = hmm.hmm_scores(frame(rows), top=100, states=3, rounds=1, known=150).collect()  # the other words' counts come by a join
    show = lambda rows: sorted(((r.doc_id, r.n_known, round(r.base_score, 6), round(r.score, 3)) for r in rows), key=str)
    assert show(few) == show(got)
    assert hmm.hmm_scores(frame([])).collect() == []


def test_forward_recursion_and_counts():
    rng = np.random.default_rng(2)
    k, classes = 3, 5
    norm = lambda x, axis: x / x.sum(axis, keepdims=True)
    model = hmm.Model(norm(rng.random(k), 0), norm(rng.random((k, k)), 1), norm(rng.random((classes, k)), 0))
    size = np.array([1, 4, 2, 6])
    offsets = np.concatenate([[0], np.cumsum(size)])
    sym = rng.integers(0, classes, offsets[-1])
    logs, first, moved, seen = model.forward(sym, offsets, True)

    def paths(s):
        import itertools

        for z in itertools.product(range(k), repeat=len(s)):
            p = model.initial[z[0]] * model.emits[s[0], z[0]]
            for a, b, x in zip(z, z[1:], s[1:], strict=False):
                p *= model.moves[a, b] * model.emits[x, b]
            yield z, p

    want_first, want_moved, want_seen, at = np.zeros(k), np.zeros((k, k)), np.zeros((classes, k)), 0
    for i, n in enumerate(size):
        s = sym[at : at + n]
        every = list(paths(s))
        total = sum(p for _, p in every)
        assert abs(logs[i] - math.log10(total)) < 1e-5
        gamma = np.zeros((n, k))
        for z, p in every:
            want_first[z[0]] += p / total
            for a, b in zip(z, z[1:], strict=False):
                want_moved[a, b] += p / total
            gamma[np.arange(n), list(z)] += p / total
        for t, x in enumerate(s):
            want_seen[x] += gamma[t]
        at += n
    assert np.allclose(seen, want_seen, atol=1e-5)
    assert np.allclose(first, want_first, atol=1e-5) and np.allclose(moved, want_moved, atol=1e-5)
    assert np.allclose(model.forward(sym, offsets), logs, atol=1e-5)


def test_stretches_of_long_texts(monkeypatch):
    rng = np.random.default_rng(3)
    norm = lambda x, axis: x / x.sum(axis, keepdims=True)
    model = hmm.Model(norm(rng.random(4), 0), norm(rng.random((4, 4)) ** 4, 1), norm(rng.random((9, 4)) ** 3, 0))
    offsets = np.concatenate([[0], np.cumsum([3, 70, 1, 16, 33, 8])])
    sym = rng.integers(0, 9, offsets[-1])
    whole = model.forward(sym, offsets), *model.forward(sym, offsets, True)
    monkeypatch.setattr(hmm, "STRETCH", 8)
    cut = model.forward(sym, offsets), *model.forward(sym, offsets, True)
    assert np.allclose(whole[0], cut[0], atol=1e-9)
    assert all(np.allclose(a, b, rtol=1e-4, atol=1e-5) for a, b in zip(whole[1:], cut[1:], strict=True))


def test_tokens():
    w, at = hmm.tokens(pa.array(["A b\x0ba", None, "é"]))
    assert at.tolist() == [0, 4, 5, 7] and w[0] == w[2] != w[1] and (w[[3, 4, 6]] == hmm.END).all()

import math
import re

import duckdb

from tessera.llm.licenses import BASE, ENOUGH, STEP, TEMPLATES, licenses_sql, scan_licenses, scan_spans

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    spots = [(i, label) for p, label in BASE for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), len(spots), min((i for i, _ in spots), default=None), max((i for i, _ in spots), default=None), ",".join(sorted({x for _, x in spots}))


def test_base_against_brute_force(frame, rng, odd):
    vocab = "gnu general public license apache cc by mit the of é9 under".split()
    rows = [(i, " ".join(rng.choice(vocab) + rng.choice(["", ",", ".\n", "!"]) for _ in range(rng.randrange(80))), None, None, 0) for i in range(150)]
    rows += odd + [(500, "MIT-License; CC by.\tmit license MIT LICENSE", None, None, 0), (501, "gnu general public", None, None, 0)]
    got = scan_licenses(frame(rows)).collect()
    want = [(r[0], *brute(r[1])) for r in rows]
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=str) == sorted(want, key=str)
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(filter(None, r["labels"].split(","))) for r in got)


def test_longer_templates_survive_small_changes(frame):
    text = "foo Permission is hereby granted, free of all charge, to any person obtaining a copy of this software and its associated documentation files bar"
    broken = "permission granted to any person " * 3
    got = {r.doc_id: r for r in scan_licenses(frame([(1, text, None, None, 0), (2, broken, None, None, 0)])).collect()}
    assert got[1]["labels"] == "mit" and got[1].base_labels == "" and 0.7 <= got[1].score < 1
    assert got[2]["labels"] == "" and got[2].score == 0


def aligned(text):
    """Labels and best cover of the longer templates, place by place."""
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    labels, best = set(), 0.0
    for template, label in TEMPLATES:
        t = template.split()
        for d in range(-len(t), len(words)):
            last, n = -1, 0
            for j in range(len(t) - 1):
                spots = [e for e in sorted(range(d - STEP, d + STEP + 1), key=lambda e: (abs(e - d), e)) if e + j >= 0 and words[e + j : e + j + 2] == t[j : j + 2]]
                if spots and spots[0] + j > last:
                    last, n = spots[0] + j, n + 1
            if n >= math.ceil(ENOUGH * (len(t) - 1) - 1e-9):
                labels.add(label)
                best = max(best, n / (len(t) - 1))
    return labels, best


MIT = TEMPLATES[0][0]
REPEATED = ["creative commons " * 6, "public domain " * 7, "documentation files " * 14, MIT + " documentation files" * 10, "documentation files " * 10 + MIT, MIT + " " + MIT]


def test_spans_are_verified(frame, rng):
    rows = [(i, t, None, None, 0) for i, t in enumerate(REPEATED)]
    got = {r.doc_id: r for r in scan_licenses(frame(rows)).collect()}
    assert [got[i]["labels"] for i in range(6)] == ["", "", "", "mit", "mit", "mit"]
    assert [got[i].score for i in range(6)] == [0, 0, 0, 1, 1, 1]
    spans = sorted((r.start, r.stop) for r in scan_spans(frame(rows)).where("doc_id = 5 AND label = 'mit'").collect())
    n = len(MIT.split())
    assert spans == [(0, n), (n, 2 * n)]
    for i in range(100, 160):
        words = (" ".join(rng.choice(TEMPLATES)[0] for _ in range(rng.randrange(1, 3)))).split()
        for _ in range(rng.randrange(12)):
            at = rng.randrange(len(words))
            if rng.random() < 0.5:
                words[at : at + rng.randrange(3)] = []
            else:
                words[at:at] = rng.choice(["of", "the", "software", "x y", "documentation files"]).split()
        rows.append((i, " ".join(words), None, None, 0))
    got = {r.doc_id: r for r in scan_licenses(frame(rows)).collect()}
    for i, text, *_ in rows:
        labels, best = aligned(text)
        base = set(filter(None, got[i].base_labels.split(",")))
        assert set(filter(None, got[i]["labels"].split(","))) == labels | base and abs(got[i].score - (1.0 if base else best)) < 1e-12
    documents = frame(rows, extra=False).toPandas()  # noqa: F841
    want = duckdb.sql(licenses_sql()).fetchall()
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r["labels"], r.score)) for r in got.values())


def test_only_ascii_is_lower_cased(frame):
    got = scan_licenses(frame([(1, "MIT LICEN\u017fE apache \u212aicense MIT license", None, None, 0)])).first()
    assert (got.n_words, got.n_base, got.first_word) == (6, 1, 4)


def test_empty(frame):
    assert scan_licenses(frame([])).collect() == []

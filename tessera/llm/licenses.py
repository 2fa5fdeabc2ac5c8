"""Licence scans by diagonal voting, in DataFrame operations alone.

The hashes of all rolling word pairs of all texts are joined with those of the templates; a match at
word i of a text and word j of a template votes for the diagonal i - j.  A base phrase stands where a
diagonal has the votes of all its pairs.  For a longer template each diagonal is merged with its neighbours
(a word more or less between), and the span is verified: every place of the template takes its nearest vote,
only votes whose words follow one another in the text count, and enough of the template's pairs have to.
So a place counts once however often its words are repeated.
"""

from __future__ import annotations

import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .columns import inner, n_inner, split_words

APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Base phrases and their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Opening words of well-known licence texts and notices.
TEMPLATES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "lgpl"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache"),
    ("this work is licensed under a creative commons attribution", "cc-by"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("the person who associated a work with this deed has dedicated the work to the public domain", "cc0"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
)
#: Share of a template's word pairs that a span has to hold in order, and diagonals to either side that are merged.
ENOUGH, STEP = 0.7, 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _pairs(base, templates) -> list[tuple]:
    """One row a word pair of a template: tid, label, base, pairs, j, a, b, h (what ``xxhash64(a, b)`` gives)."""
    rows = []
    for tid, (text, label, is_base) in enumerate([(*x, True) for x in base] + [(*x, False) for x in templates]):
        words = text.split()
        for j, (a, b) in enumerate(zip(words, words[1:], strict=False)):
            h = xxhash.xxh64_intdigest(b.encode(), xxhash.xxh64_intdigest(a.encode(), 42))
            rows.append((tid, label, is_base, len(words) - 1, j, a, b, h - (1 << 64) if h >> 63 else h))
    return rows


def _grams(spark: SparkSession, pairs: list[tuple]) -> DataFrame:
    """As many rows as the templates have words."""
    return spark.createDataFrame(pairs, "tid int, label string, base boolean, pairs int, j int, a string, b string, h bigint")


def scan_spans(docs: DataFrame, base=BASE, templates=TEMPLATES, enough: float = ENOUGH, step: int = STEP) -> DataFrame:
    """rid, doc_id, n_words and, for each span found, label, base, start, stop (words) and cover (0 to 1).

    Every row of ``docs`` has at least one row here; one without a span has nulls in the rest.  rid
    tells rows of ``docs`` apart, so repeated rows stay apart too.  Of spans of one template that lie within
    twice ``step`` diagonals the best covered is given.
    """
    pairs = _pairs(base, templates)
    parts = docs.select("doc_id", F.monotonically_increasing_id().alias("rid"), split_words(F.translate("text", UPPER, LOWER), APART).alias("parts"))
    words = parts.select("doc_id", "rid", n_inner("parts").cast("bigint").alias("n_words"), inner("parts").alias("w"))
    every = F.transform(
        F.when(F.col("n_words") > 1, F.sequence(F.lit(0), (F.col("n_words") - 2).cast("int"))).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(i.alias("i"), F.xxhash64(F.get("w", i), F.get("w", i + 1)).alias("h")),
    )
    known = F.filter(every, lambda g: g.h.isin(sorted({r[-1] for r in pairs})))
    met = words.select("doc_id", "rid", "n_words", F.transform(known, lambda g: F.struct(g.i.alias("i"), g.h.alias("gh"), F.get("w", g.i).alias("x"), F.get("w", g.i + 1).alias("y"))).alias("met"))
    rolled = met.select("doc_id", "rid", "n_words", F.explode_outer("met").alias("g")).select("doc_id", "rid", "n_words", "g.*")
    hits = rolled.join(F.broadcast(_grams(docs.sparkSession, pairs)), F.expr("gh = h AND x = a AND y = b"), "left").repartition("rid")
    diag = (F.col("i") - F.col("j")).alias("diag")
    votes = hits.groupBy("rid", "doc_id", "n_words", "tid", "label", "base", "pairs", diag).agg(F.collect_list("j").alias("js"))
    along = Window.partitionBy("rid", "tid").orderBy("diag")
    merged = F.flatten(F.collect_list(F.transform("js", lambda j: F.struct(j.alias("j"), F.col("diag").alias("diag")))).over(along.rangeBetween(-step, step)))
    least = F.ceil(F.lit(enough) * F.col("pairs") - 1e-9)
    by_place = F.array_sort(F.transform("merged", lambda x: F.struct(x.j.alias("j"), F.abs(x.diag - F.col("diag")).alias("off"), x.diag.alias("diag"))))
    none = F.lit(-1)
    walk = F.aggregate(
        by_place,
        F.struct(none.alias("j"), none.alias("i"), F.lit(0).alias("n"), none.alias("lo")),
        lambda s, x: F.when(x.j == s.j, s)
        .when(x.j + x.diag > s.i, F.struct(x.j.alias("j"), (x.j + x.diag).alias("i"), (s.n + 1).alias("n"), F.when(s.n == 0, x.j + x.diag).otherwise(s.lo).alias("lo")))
        .otherwise(F.struct(x.j.alias("j"), s.i.alias("i"), s.n.alias("n"), s.lo.alias("lo"))),
    )
    whole = F.col("base") & (F.size("js") == F.col("pairs"))
    places = F.size(F.array_distinct(F.transform("merged", lambda x: x.j)))
    first = F.struct(F.col("diag").alias("lo"), (F.col("diag") + F.col("pairs") - 1).alias("i"), F.col("pairs").alias("n"))
    span = F.when(whole, first).when(~F.col("base") & (places >= least), F.transform(F.array(walk), lambda s: F.struct(s.lo.alias("lo"), s.i.alias("i"), s.n.alias("n")))[0])
    found = votes.withColumn("merged", merged).withColumn("span", span)
    better = F.max(F.struct(F.col("span.n"), F.size("js"), -F.col("diag"))).over(along.rangeBetween(-2 * step, 2 * step))
    found = found.withColumn("better", better)
    best = F.col("base") | (F.col("better") == F.struct(F.col("span.n"), F.size("js"), -F.col("diag")))
    real = F.coalesce((F.col("span.n") >= least) & best, F.lit(False))
    given = lambda c: F.when(real, c)
    return found.select(
        "rid",
        "doc_id",
        "n_words",
        given(F.col("label")).alias("label"),
        given(F.col("base")).alias("base"),
        given(F.col("span.lo")).cast("bigint").alias("start"),
        given(F.col("span.i") + 2).cast("bigint").alias("stop"),
        given(F.col("span.n") / F.col("pairs")).alias("cover"),
    )


def scan_licenses(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score, one row for each row of ``docs``.

    n_base counts the places of base phrases; first_word and last_word are their smallest and largest
    start (null without any).  Labels are distinct, sorted and comma-joined, the empty string without
    any; score is the best cover of a span, 0 without one.  Null and empty texts have no words.
    Repeated rows and null ids each keep their row; other columns are not read, so their names may clash;
    texts of any length are scanned whole.  Only A-Z are lower-cased.  An empty table gives an empty result.
    """
    spans = scan_spans(docs, **how)
    base = F.coalesce(F.col("base"), F.lit(False))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return (
        spans.groupBy("rid", "doc_id", "n_words")
        .agg(
            F.count_if(base).alias("n_base"),
            F.min(F.when(base, F.col("start"))).alias("first_word"),
            F.max(F.when(base, F.col("start"))).alias("last_word"),
            joined(F.when(base, F.col("label"))).alias("base_labels"),
            joined("label").alias("labels"),
            F.coalesce(F.max("cover"), F.lit(0.0)).alias("score"),
        )
        .drop("rid")
    )


def licenses_sql(base=BASE, templates=TEMPLATES, enough: float = ENOUGH, step: int = STEP) -> str:
    """:func:`scan_licenses` as SQL over a table named documents; spans are put together place by place, by joins."""
    rows = [f"({tid}, '{label}', {str(is_base).lower()}, {n}, {j}, '{a}', '{b}')" for tid, label, is_base, n, j, a, b, _ in _pairs(base, templates)]
    return f"""
WITH t(tid, label, base, pairs, j, a, b) AS (VALUES {", ".join(rows)}), d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), g AS (
  SELECT rid, unnest(range(1, len(w))) AS i, w FROM d
), v AS (
  SELECT rid, tid, label, base, pairs, i - 1 AS i, j, i - 1 - j AS diag FROM g JOIN t ON w[i] = a AND w[i + 1] = b
), c AS (
  SELECT DISTINCT rid, tid, label, pairs, diag FROM v WHERE NOT base
), near AS (
  SELECT c.rid, c.tid, c.label, c.pairs, c.diag, v.j, v.j + arg_min(v.diag, abs(v.diag - c.diag) * 2 + CAST(v.diag > c.diag AS INT)) AS i
  FROM c JOIN v ON v.rid = c.rid AND v.tid = c.tid AND abs(v.diag - c.diag) <= {step} GROUP BY c.rid, c.tid, c.label, c.pairs, c.diag, v.j
), o AS (
  SELECT *, i > coalesce(max(i) OVER (PARTITION BY rid, tid, diag ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS fits FROM near
), e AS (
  SELECT rid, label, false AS base, NULL AS start, CAST(count(*) FILTER (fits) AS DOUBLE) / pairs AS cover FROM o GROUP BY rid, tid, label, pairs, diag
  HAVING count(*) FILTER (fits) >= ceil({enough} * pairs - 1e-9)
  UNION ALL
  SELECT rid, label, true, diag, 1.0::DOUBLE FROM v WHERE base GROUP BY rid, tid, label, pairs, diag HAVING count(*) = pairs
), m AS (
  SELECT rid, count(*) FILTER (base) AS n_base, min(start) AS first_word, max(start) AS last_word,
         array_to_string(list_sort(list(DISTINCT label) FILTER (base)), ',') AS base_labels, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(cover) AS score
  FROM e GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score
FROM d LEFT JOIN m USING (rid)
"""

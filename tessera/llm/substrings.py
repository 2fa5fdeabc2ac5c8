"""Removal of repeated word windows by hashes of windows at anchors.

This stands in place of prefix-partitioned suffix trees: suffixes are not ordered, and maximal repeats are
not produced.  The anchor of a window of WINDOW words is its leftmost GRAM-word piece of least hash, so
equal windows have equal anchors.  Windows whose anchor's piece occurs once in the corpus drop out early.
The others are dealt out by a longer piece around the anchor, lengthened to a whole window where more than
GROUP rows share it.  Within a group equal 64-bit window hashes are sorted together, and of each the
occurrence that comes first stays; the words themselves are not compared.

Whatever a task can settle among its own texts it settles there: of equal pieces or windows one goes on
from each task, so a passage that a third of all texts share makes no large group.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import fresh, map_texts, pieces, raw, rolling, stored, whole_runs, word_hashes, words_of

WINDOW, GRAM = 20, 6
#: Suffixes that may share a prefix before it is lengthened.
GROUP = 20_000
#: Prefixes to be lengthened that are broadcast at most; more are joined by a shuffle.
BROADCAST = 100_000
_LOW = np.uint64((1 << 31) - 1)


def _key():
    """Tells rows apart; rows alike in id and text are one document."""
    return F.xxhash64("doc_id", "text")


def runs_of(data: np.ndarray, ends: np.ndarray, window: int, gram: int):
    """Words of all rows and the runs of windows that share an anchor.

    Gives (words, at, starts, stops), and for each run: row, anchor and first window (places among all
    words) and the number of windows; None without a window.
    """
    starts, stops, at = words_of(data, ends)
    words = word_hashes(data, starts, stops)
    n = np.diff(at)
    full = np.maximum(0, n - window + 1)
    base = (words, at, starts, stops)
    if not full.sum():
        return base, None
    grams = rolling(words, gram)
    key = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
    width, span = 1, window - gram + 1
    least = key
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if span > width:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    row = np.repeat(np.arange(len(n)), full)
    offsets = np.concatenate([[0], np.cumsum(full)])
    first = np.arange(offsets[-1]) - offsets[row] + at[row]
    anchor = (least[first] & _LOW).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    return base, (row[new], anchor[new], first[new], np.diff(np.concatenate([new, [len(anchor)]])), grams)


def _repeated_anchors(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(k, spots): for each text the places of its anchors whose piece occurs twice or more."""

    def local(batches):
        got = []
        for batch in batches:
            for piece in pieces(batch, "text"):
                (_, at, _, _), runs = runs_of(*raw(piece.column("text")), window, gram)
                if runs is not None:
                    row, anchor, _, _, grams = runs
                    k = piece.column("k").to_numpy(zero_copy_only=False)
                    got.append((grams[anchor], k[row], (anchor - at[row]).astype(np.int32)))
        if got:
            a, k, spot = (np.concatenate(x) for x in zip(*got, strict=True))
            _, first, inverse, count = np.unique(a, return_index=True, return_inverse=True, return_counts=True)
            known = count[inverse] > 1
            a = a.copy()
            rest = known.copy()
            rest[first] = False  # one of each goes on; the others only pass through, anywhere
            a[rest] = np.arange(rest.sum(), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            for s in range(0, len(a), 100_000):
                e = slice(s, s + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(a[e].view(np.int64)), pa.array(k[e]), pa.array(spot[e]), pa.array(known[e]), pa.array(rest[e])], ["a", "k", "spot", "known", "rest"])

    def gather(batches):
        for t in whole_runs(batches, "a"):
            a, k, spot, known, rest = (t.column(c).to_numpy() for c in ("a", "k", "spot", "known", "rest"))
            real = np.flatnonzero(~rest)
            _, inverse, count = np.unique(a[real], return_inverse=True, return_counts=True)
            keep = known.copy()
            keep[real] |= count[inverse] > 1
            for s in range(0, keep.sum(), 100_000):
                some = np.flatnonzero(keep)[s : s + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(k[some]), pa.array(spot[some])], ["k", "spot"])

    seen = docs.select("k", "text").mapInArrow(local, "a bigint, k bigint, spot int, known boolean, rest boolean").repartition("a").sortWithinPartitions("a")
    return seen.mapInArrow(gather, "k bigint, spot int").groupBy("k").agg(F.collect_set("spot").alias("spots"))


def _firsts(w: np.ndarray, ids: np.ndarray, null: np.ndarray, k: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Whether each window is the first of its kind by (id, null last, then k, then place); rows alike in all of it are one."""
    order = np.lexsort((p, k, ids, null, w))
    w, ids, null, k, p = (x[order] for x in (w, ids, null, k, p))
    head = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
    lead = np.repeat(head, np.diff(np.concatenate([head, [len(w)]])))
    out = np.empty(len(w), bool)
    out[order] = (null == null[lead]) & (ids == ids[lead]) & (k == k[lead]) & (p == p[lead])
    return out


_PENDING = "key bigint, doc_id bigint, k bigint, places array<int>, ws array<bigint>, gone boolean"


def _batches(key, ids, null, k, places, ws, offsets, gone):
    step = 50_000
    for s in range(0, len(k), step):
        e = min(len(k), s + step)
        cut = slice(offsets[s], offsets[e])
        at = pa.array((offsets[s : e + 1] - offsets[s]).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(key[s:e]),
                pa.array(ids[s:e], mask=null[s:e]),
                pa.array(k[s:e]),
                pa.ListArray.from_arrays(at, pa.array(places[cut])),
                pa.ListArray.from_arrays(at, pa.array(ws[cut] if not gone else ws[cut] * 0)),
                pa.array(np.full(e - s, gone)),
            ],
            ["key", "doc_id", "k", "places", "ws", "gone"],
        )


def _windows(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """Windows at repeated anchors, by half run: those that a task finds not to be first are ``gone``, the others go on with their hashes."""
    low = (window - gram + 1) // 2
    right, left = window - low + 1, gram + low  # words from the anchor on, or up to the anchor's end, that all windows of a half hold

    def local(batches):
        got = []
        for batch in batches:
            for piece in pieces(batch, "text"):
                (words, at, _, _), runs = runs_of(*raw(piece.column("text")), window, gram)
                if runs is None:
                    continue
                row, anchor, first, count, _ = runs
                marks = piece.column("spots")
                n_marks = np.diff(marks.offsets.to_numpy())
                marked = np.repeat(np.arange(piece.num_rows), n_marks) * (1 << 31) + marks.flatten().to_numpy()
                on = np.isin(row * (1 << 31) + anchor - at[row], marked)
                row, anchor, first, count = row[on], anchor[on], first[on], count[on]
                if not len(row):
                    continue
                run = np.repeat(np.arange(len(row)), count)
                p = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count) + first[run]
                near = anchor[run] - p < low
                roll_r, roll_l = rolling(words, right), rolling(words, left)
                key = np.where(near, roll_r[np.minimum(anchor[run], len(roll_r) - 1)], roll_l[np.maximum(0, np.minimum(anchor[run] - low, len(roll_l) - 1))] + np.uint64(1))
                ids = piece.column("doc_id")
                null = ids.is_null().to_numpy(zero_copy_only=False)
                ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
                k = piece.column("k").to_numpy(zero_copy_only=False)
                r = row[run]
                got.append((rolling(words, window)[p].view(np.int64), ids[r], null[r], k[r], (p - at[r]).astype(np.int32), key.view(np.int64)))
        if not got:
            return
        w, ids, null, k, p, key = (np.concatenate(x) for x in zip(*got, strict=True))
        first = _firsts(w, ids, null, k, p)
        for gone in (True, False):
            some = np.flatnonzero(first != gone)
            if len(some):
                a, b = k[some], key[some]
                head = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
                lead = some[head]
                yield from _batches(key[lead], ids[lead], null[lead], k[lead], p[some], w[some], np.concatenate([head, [len(some)]]), gone)

    return docs.mapInArrow(local, _PENDING)


def _judged(pending: DataFrame) -> DataFrame:
    """(k, places): windows of pending rows that are not the first of their kind anywhere."""

    def gather(batches):
        for t in whole_runs(batches, "key", 50_000):
            t = t.combine_chunks()
            places, ws = t.column("places").combine_chunks(), t.column("ws").combine_chunks()
            size = np.diff(places.offsets.to_numpy())
            owner = np.repeat(np.arange(t.num_rows), size)
            ids = t.column("doc_id")
            null = ids.is_null().to_numpy()
            ids, k = ids.fill_null(0).to_numpy(), t.column("k").to_numpy()
            p = places.flatten().to_numpy()
            gone = ~_firsts(ws.flatten().to_numpy(), ids[owner], null[owner], k[owner], p)
            row = owner[gone]
            if len(row):
                head = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                ends = np.concatenate([head, [len(row)]])
                at = pa.array(ends.astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(k[row[head]]), pa.ListArray.from_arrays(at, pa.array(p[gone]))], ["k", "places"])

    return pending.mapInArrow(gather, "k bigint, places array<int>")


def repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(k, places): for each text with any, the starts (words from 0) of windows whose words also start earlier.

    ``docs``: doc_id (bigint), text and k, the xxhash64 of both.
    """
    anchors = _repeated_anchors(docs, window, gram)
    found = stored(_windows(docs.select("doc_id", "k", "text").join(anchors, "k"), window, gram))
    open_ = found.where("NOT gone")
    crowded = stored(open_.groupBy("key").count().where(F.col("count") > GROUP).select("key"))
    n = crowded.count()
    dealt = open_.select("key", "doc_id", "k", "places", "ws")
    if n:
        crowded = F.broadcast(crowded) if n <= BROADCAST else crowded
        many = dealt.join(crowded, "key", "left_semi").select("doc_id", "k", F.explode(F.arrays_zip("places", "ws")).alias("x"))
        many = many.select(F.col("x.ws").alias("key"), "doc_id", "k", F.array("x.places").alias("places"), F.array("x.ws").alias("ws"))
        dealt = dealt.join(crowded, "key", "left_anti").unionByName(many)
    judged = _judged(dealt.repartition("key").sortWithinPartitions("key"))
    return found.where("gone").select("k", "places").unionByName(judged).groupBy("k").agg(F.flatten(F.collect_list("places")).alias("places"))


def _covered(places: np.ndarray, n: int, window: int) -> np.ndarray:
    """Whether each of n words lies in a window that starts at one of the places."""
    edge = np.bincount(places, minlength=n + 1)[: n + 1] - np.bincount(np.minimum(places + window, n), minlength=n + 1)[: n + 1]
    return np.cumsum(edge)[:n] > 0


def _with_repeats(docs: DataFrame, window: int, gram: int) -> tuple[DataFrame, str]:
    """``docs`` and the places of its repeated windows, in a column whose name is returned too."""
    key, places = fresh(docs.columns, "row_key", "row_places")
    keyed = docs.withColumn(key, _key())
    ids = keyed.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.col(key).alias("k"))
    return keyed.join(repeats(ids, window, gram).withColumnsRenamed({"k": key, "places": places}), key, "left").select(*docs.columns, places), places


def _rows(piece, window, places):
    """For each row: its text's bytes, its words, and which of them go."""
    data, ends = raw(piece.column("text"))
    starts, stops, at = words_of(data, ends)
    marks = piece.column(places)
    flat, offsets = marks.values.to_numpy() if len(marks.values) else np.empty(0, np.int32), marks.offsets.to_numpy()
    lengths = np.where(marks.is_null().to_numpy(zero_copy_only=False), 0, np.diff(offsets))
    for r in range(piece.num_rows):
        n = at[r + 1] - at[r]
        own = flat[offsets[r] : offsets[r] + lengths[r]]
        gone = _covered(own, n, window) if len(own) else None
        yield data[ends[r] : ends[r + 1]].tobytes(), starts[at[r] : at[r + 1]] - ends[r], stops[at[r] : at[r + 1]] - ends[r], gone


def substring_report(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (of the kept words joined by one space), one row for each row of ``docs``.

    A word goes if it lies in a window of ``window`` words whose sequence also starts earlier: in a text
    of a smaller doc_id, or before in the same text.  Null ids come last; among equal ids a fixed hash
    decides, and rows alike in id and text are one document, each row of which gets the same result.
    Null, empty and short texts lose nothing.  Other columns are not read.
    """

    rows, places = _with_repeats(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), window, gram)

    def kernel(piece):
        n, removed, sha = [], [], []
        for text, starts, _, gone in _rows(piece, window, places):
            words = text.split()
            n.append(len(words))
            removed.append(0 if gone is None else int(gone.sum()))
            if gone is not None:
                words = [words[i] for i in np.flatnonzero(~gone)]
            sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
        return pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return map_texts(rows, kernel, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``docs`` without the words that :func:`substring_report` removes; what stands between kept words stays, n_chars is renewed.

    Rows that lose their every word go; texts without words, null ones included, stay as they are.  Texts of any
    length are whole; all other columns stay, whatever their names; an empty table stays empty.
    """
    schema = docs.schema
    rows, places = _with_repeats(docs, window, gram)

    def kernel(piece):
        texts, keep = piece.column("text").to_pylist(), np.ones(piece.num_rows, bool)
        for r, (text, starts, stops, gone) in enumerate(_rows(piece, window, places)):
            if gone is None or not gone.any():
                continue
            if gone.all():
                keep[r] = False
                continue
            edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
            out, at = [], 0
            for a, b in edge.reshape(-1, 2):
                out.append(text[at : starts[a]])
                at = starts[b] if b < len(starts) else stops[b - 1]
            out.append(text[at:])
            texts[r] = b"".join(out).decode("utf-8", "replace")
        cols = [pa.array(texts, pa.string()) if c == "text" else piece.column(c) for c in schema.names]
        return pa.RecordBatch.from_arrays(cols, schema.names).filter(pa.array(keep))

    out = map_texts(rows, kernel, schema)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out


SUBSTRING_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), p AS (
  SELECT rid, doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d
), k AS (
  SELECT rid, doc_id, i, w[i] AS word, CASE WHEN i + 19 <= len(w) THEN array_to_string(w[i:i + 19], ' ') END AS grams FROM p
), f AS (
  SELECT *, grams IS NOT NULL AND row_number() OVER (PARTITION BY grams ORDER BY doc_id, i) > 1 AS again FROM k
), c AS (
  SELECT *, sum(CAST(again AS INT)) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) > 0 AS gone FROM f
), s AS (
  SELECT rid, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN s USING (rid)
"""

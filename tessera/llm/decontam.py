"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

An item is a set of n word shingles.  A text that holds a share t of them misses at most (1 - t) n, so it
holds at least one of any floor((1 - t) n) + 1 of them: the item's sketch.  The sketch takes the shingles of
least hash, those first that few items share, so that a prompt which all items begin with is in no sketch that
can do without it.  Items are partitioned by size (powers of two); a text is searched only for partitions whose
least item it can hold a share t of, and every text that reaches t is found, however long it is; the
shingles of candidates are then counted exactly.  Texts are not sketched themselves: a sketch of a long text
says little about a short item in it.  Items come in blocks of a fixed number of bytes, each searched in all texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import LOWER, map_texts, raw, rolling, word_hashes, words_of

#: Bytes of item texts in a block: what one broadcast holds at most, unless a single item is longer.
BLOCK_BYTES = 16 << 20
#: Bytes that keep words apart: ASCII other than letters and digits.
APART = np.zeros(256, bool)
APART[:128] = True
APART[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False


def shingles(col: pa.Array, k: int, also: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Hashes of each row's k-word shingles and their n + 1 offsets; a row of fewer words has one of them all.

    ``also``: shorter lengths whose shingles are given for every row too, by length.
    """
    data, ends = raw(col)
    data = LOWER[data]
    starts, stops, at = words_of(data, ends, APART)
    words = word_hashes(data, starts, stops)
    n = np.diff(at)
    out = {}
    for size in (k, *also):
        roll = rolling(words, size)
        full = np.maximum(0, n - size + 1)
        offsets = np.concatenate([[0], np.cumsum(full)])
        index = np.arange(offsets[-1]) + np.repeat(at[:-1] - offsets[:-1], full)
        out[size] = (roll[index] if len(index) else np.empty(0, np.uint64), offsets)
    hashes, offsets = out.pop(k)
    return hashes, offsets, out | {0: (words, at)}


@dataclass
class Sized:
    """Sketches of items of one shingle length whose sizes lie between two powers of two."""

    smallest: int  # shingles that its items have at least
    keys: np.ndarray  # sketch hashes, sorted
    owner: np.ndarray  # and their items


@dataclass
class Index:
    """Items of one shingle length."""

    keys: np.ndarray  # all sketch hashes, sorted and distinct
    parts: list[Sized]
    hashes: np.ndarray  # all shingles, sorted, and their items
    owner: np.ndarray
    total: np.ndarray  # shingles of each item


def _sketched(place: np.ndarray, hashes: np.ndarray, items: int, least: float) -> Index:
    """``place``, ``hashes``: the distinct shingles of some items, sorted by hash."""
    total = np.bincount(place, minlength=items)
    head = np.concatenate([[True], hashes[1:] != hashes[:-1]])
    shared = np.diff(np.append(np.flatnonzero(head), len(hashes)))[np.cumsum(head) - 1]
    order = np.lexsort((hashes, np.log2(shared).astype(np.int64), place))
    first = np.cumsum(total) - total
    rank = np.arange(len(order)) - first[place[order]]
    chosen = np.zeros(len(hashes), bool)
    chosen[order] = rank <= np.floor((1 - least) * total[place[order]] + 1e-9)
    keys, owner = hashes[chosen], place[chosen]
    part = np.log2(total[owner]).astype(np.int64)
    parts = [Sized(1 << int(p), keys[part == p], owner[part == p]) for p in np.unique(part)]
    return Index(np.unique(keys), parts, hashes, place, total)


@dataclass
class Block:
    """Items of one block, by shingle length (k words, or fewer for shorter items)."""

    items: int
    lengths: dict[int, Index]

    @classmethod
    def of(cls, items: pa.Table, k: int, least: float) -> Block:
        texts = items.column("text").combine_chunks()
        texts = texts if isinstance(texts, pa.Array) else pa.concat_arrays(texts.chunks)
        _, _, other = shingles(texts, k)
        words, at = other[0]
        n = np.diff(at)
        lengths = {}
        for size in range(1, k + 1):
            own = np.flatnonzero(n >= k if size == k else n == size)
            if not len(own):
                continue
            full = n[own] - size + 1
            place = np.repeat(own, full)
            spot = np.arange(full.sum()) - np.repeat(np.cumsum(full) - full, full) + at[place]
            hashes = rolling(words, size)[spot]
            order = np.lexsort((place, hashes))
            place, hashes = place[order], hashes[order]
            new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (place[1:] != place[:-1])])
            lengths[size] = _sketched(place[new], hashes[new], len(n), least)
        return cls(len(n), lengths)

    def search(self, col: pa.Array, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, item place, containment) of all pairs that reach ``least``."""
        hashes, offsets, other = shingles(col, k, tuple(s for s in self.lengths if s != k))
        rows, places, shares = [], [], []
        for size, index in self.lengths.items():
            h, at = (hashes, offsets) if size == k else other[size]
            spot = _hits(h, index.keys)
            if not len(spot):
                continue
            row, met = np.searchsorted(at, spot, "right") - 1, h[spot]
            room, pairs = np.diff(at)[row], []
            for part in index.parts:
                some = np.flatnonzero(room >= least * part.smallest - 1e-9)
                pairs += [row[some[i]] * self.items + part.owner[j] for i, j in _matches(met[some], part.keys)]
            pair = np.unique(np.concatenate(pairs)) if pairs else np.empty(0, np.int64)
            for r in np.unique(pair // self.items):  # rows with a candidate: count their shingles
                own = np.unique(h[at[r] : at[r + 1]])
                a, b = np.searchsorted(index.hashes, own), np.searchsorted(index.hashes, own, "right")
                held = np.concatenate([index.owner[x:y] for x, y in zip(a[b > a], b[b > a], strict=True)])
                count = np.bincount(held, minlength=self.items)
                some = pair[pair // self.items == r] % self.items
                share = count[some] / index.total[some]
                good = share >= least - 1e-12
                rows.append(np.full(good.sum(), r))
                places.append(some[good])
                shares.append(share[good])
        join = lambda x, t: np.concatenate(x).astype(t) if x else np.empty(0, t)
        return join(rows, np.int64), join(places, np.int64), join(shares, np.float64)


def _hits(h: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of ``h`` whose value is among the sorted ``keys``; a bit table sorts out most of the rest."""
    if not len(h) or not len(keys):
        return np.empty(0, np.int64)
    bits = max(16, int(len(keys) * 16).bit_length())
    shift = np.uint64(64 - bits)
    table = np.zeros(1 << bits, bool)
    table[(keys >> shift).astype(np.int64)] = True
    maybe = np.flatnonzero(table[(h >> shift).astype(np.int64)])
    at = np.minimum(np.searchsorted(keys, h[maybe]), len(keys) - 1)
    return maybe[keys[at] == h[maybe]]


def _matches(h: np.ndarray, keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) with h[i] = keys[j], all of them; one round for each repeat of a key."""
    a, b = np.searchsorted(keys, h), np.searchsorted(keys, h, "right")
    i = np.arange(len(h))
    while len(i):
        i = i[a[i] < b[i]]
        if len(i):
            yield i, a[i]
        a = a + 1


def _blocks(items: DataFrame) -> Iterator[pa.Table]:
    """The items in blocks of BLOCK_BYTES, one at a time on the driver."""
    rows, size = [], 0
    for r in items.select("item_id", "text").where("text IS NOT NULL").toLocalIterator():
        rows.append((r["item_id"], r["text"]))
        size += len(r["text"]) + 64
        if size > BLOCK_BYTES:
            yield _table(items, rows)
            rows, size = [], 0
    if rows:
        yield _table(items, rows)


def _table(items: DataFrame, rows: list) -> pa.Table:
    return pa.table({"item_id": pa.array([x for x, _ in rows]), "text": pa.array([t for _, t in rows], pa.string())})


def contaminated(docs: DataFrame, items: DataFrame, keep: tuple[str, ...] = ("doc_id",), shingle_words: int = 5, least: float = 0.8) -> DataFrame:
    """``keep``, item_id and containment (share of the item's distinct shingles that the text holds), where ``least`` or more.

    Words are runs of ASCII letters, digits and other characters beyond ASCII, A-Z lower-cased; an item
    of fewer than ``shingle_words`` words is one shingle of all its words.  Null or wordless items match
    nothing, null and empty texts hold nothing.  Repeated rows of either table, null ids included, give
    a row each.  Whole texts are searched, however long; other columns are not read, so their names may clash.
    """
    types = dict(docs.dtypes) | {"item_id": dict(items.dtypes)["item_id"]}
    schema = ", ".join(f"`{c}` {types[c]}" for c in (*keep, "item_id")) + ", containment double"
    out = None
    for table in _blocks(items):
        sent = docs.sparkSession.sparkContext.broadcast((Block.of(table, shingle_words, least), table.column("item_id").combine_chunks()))

        def kernel(piece, sent=sent):
            block, ids = sent.value
            row, place, share = block.search(piece.column("text"), shingle_words, least)
            if not len(row):
                return None
            rows = pa.array(row)
            return pa.RecordBatch.from_arrays([*(piece.column(c).take(rows) for c in keep), ids.take(pa.array(place)), pa.array(share)], [*keep, "item_id", "containment"])

        part = map_texts(docs.select(*dict.fromkeys([*keep, "text"])), kernel, schema)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def without_contaminated(docs: DataFrame, items: DataFrame, shingle_words: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that hold no item (see :func:`contaminated`); all columns kept whatever their names, nothing shuffled.

    Null and empty texts hold nothing and stay, repeated rows stay or go together, empty tables on either side change nothing.
    """
    out = docs
    for table in _blocks(items):
        sent = docs.sparkSession.sparkContext.broadcast(Block.of(table, shingle_words, least))

        def kernel(piece, sent=sent):
            bad = np.unique(sent.value.search(piece.column("text"), shingle_words, least)[0])
            good = np.ones(piece.num_rows, bool)
            good[bad] = False
            return piece.filter(pa.array(good))

        out = map_texts(out, kernel, out.schema)
    return out


CONTAMINATED_SQL = """
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents
), iw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL
), isz AS (
  SELECT item_id, w, least(5, len(w)) AS k FROM iw WHERE len(w) > 0
), ish AS (
  SELECT DISTINCT item_id, k, unnest([array_to_string(w[i:i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS s FROM isz
), dsh AS (
  SELECT DISTINCT doc_id, k, unnest([array_to_string(w[i:i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS s
  FROM dw, (SELECT DISTINCT k FROM isz)
), n AS (
  SELECT item_id, count(*) AS n FROM ish GROUP BY item_id
)
SELECT doc_id, item_id, CAST(count(*) AS DOUBLE) / any_value(n) AS containment
FROM dsh JOIN ish USING (k, s) JOIN n USING (item_id)
GROUP BY doc_id, item_id HAVING count(*) >= 0.8 * any_value(n)
"""

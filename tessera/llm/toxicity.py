"""A convolutional text classifier: hashed word embeddings, three filter widths, max pooling; trained in numpy.

A word's embedding is made of rows of several hashed tables, for the whole word and for its opening bytes,
so inflected forms share rows and words that meet in one table are told apart by the others.  Rows that
too few training texts hold are zero.  A text's language is not given: it is read off the text, from the
scripts that its bytes belong to and from its short words (articles, prepositions), by clusters of the
training texts.  Each cluster has a threshold of its own, at which the score is 0.5, from texts that the
network was not trained on; the fewer of them there are, the more it leans to the threshold of all.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import LOWER, first_hashed, kept_out, map_texts, pieces, raw, tidy, word_hashes, words_of

#: Labelled rows of either class that are learned from at most: those whose hashed ids come first.
LABELLED = 2_000
#: Bytes of text that are encoded, and table rows that are scored, at once while learning.
PIECE, ROWS = 1 << 20, 200_000
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 17, 4, 6, (1, 2, 3)
#: Opening bytes of a word that have a table each, beside the whole word.
OPENINGS = (4, 5, 6, 7)
SIDES = 1 + len(OPENINGS)
EPOCHS, BATCH, RATE, MIN_TEXTS = 6, 64, 0.05, 5
#: Set-aside toxic texts that a language cluster takes, clusters at most, and set-aside texts that the threshold of all counts as.
PER_CLUSTER, CLUSTERS, LEAN = 15, 64, 20
#: Buckets of a profile: short words, and lead bytes of letters beyond ASCII.
SHORT, LEADS = 64, 64
#: Bytes that keep words apart: ASCII other than letters and digits.
APART = np.zeros(256, bool)
APART[:128] = True
APART[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False


def encode(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in each table of all texts' words, each text followed by two pads (0) and holding three entries at least; its offsets; its profile of short words and scripts."""
    data, ends = raw(col)
    data = LOWER[data]
    starts, stops, at = words_of(data, ends, APART)
    n = len(ends) - 1
    count = np.diff(at)
    size = np.maximum(count, 1) + 2
    offsets = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros((SIDES, offsets[-1]), np.int32)
    row = np.repeat(np.arange(n), count)
    place = offsets[row] + np.arange(len(starts)) - at[row]
    hashed = word_hashes(data, np.concatenate([starts] * SIDES), np.concatenate([stops, *(np.minimum(starts + k, stops) for k in OPENINGS)]))
    out[:, place] = (hashed % np.uint64(BUCKETS - 1)).astype(np.int32).reshape(SIDES, -1) + 1
    short = np.flatnonzero(stops - starts <= 3)
    words = np.bincount(row[short] * SHORT + (hashed[short] >> np.uint64(40)).astype(np.int64) % SHORT, minlength=SHORT * n).reshape(n, SHORT)
    lead = np.flatnonzero(data >= 0xC2)
    scripts = np.bincount((np.searchsorted(ends, lead, "right") - 1) * LEADS + (data[lead] & (LEADS - 1)), minlength=LEADS * n).reshape(n, LEADS)
    share = lambda x, of: (x / np.maximum(1, of)[:, None]).astype(np.float32)
    return out, offsets, np.concatenate([share(words, words.sum(1)), 4 * share(scripts, np.diff(ends))], 1)


@dataclass
class Model:
    tables: list[np.ndarray]  # BUCKETS x DIM each; row 0 is the pad
    filters: list[list[np.ndarray]]  # by width, by place: SIDES DIM x FILTERS
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    centres: np.ndarray
    thresholds: np.ndarray
    slope: float = 1.0

    def embedded(self, rows: np.ndarray) -> np.ndarray:
        return np.concatenate([t[r] for t, r in zip(self.tables, rows, strict=True)], 1)

    def activations(self, x: np.ndarray) -> list[np.ndarray]:
        got = []
        for w, parts, b in zip(WIDTHS, self.filters, self.bias, strict=True):
            y = x @ parts[0] + b
            for j in range(1, w):
                y[:-j] += x[j:] @ parts[j]
            got.append(y)
        return got

    def pooled(self, x: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        y = np.concatenate(self.activations(x), 1)
        y[offsets[1:] - 1] = -1e9
        y[offsets[1:] - 2] = -1e9
        return np.maximum.reduceat(y, offsets[:-1], axis=0), y

    def logits(self, rows: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        top, _ = self.pooled(self.embedded(rows), offsets)
        return np.maximum(top, 0) @ self.out + self.out_bias

    def scores(self, col: pa.Array) -> np.ndarray:
        rows, offsets, profile = encode(col)
        z = self.logits(rows, offsets).astype(np.float64) - self.thresholds[self.cluster(profile)]
        return 1 / (1 + np.exp(-np.clip(self.slope * z, -500, 500)))

    def cluster(self, profile: np.ndarray) -> np.ndarray:
        return _nearest(profile, self.centres)


def _clusters(profile: np.ndarray, k: int) -> np.ndarray:
    """k-means; the first centres are drawn one by one, by squared distance from those before."""
    rng, picks = np.random.default_rng(9), [profile.mean(0)]
    gap = ((profile - picks[0]) ** 2).sum(1).astype(np.float64)
    while len(picks) < k and gap.sum() > 0:
        picks.append(profile[rng.choice(len(profile), p=gap / gap.sum())])
        gap = np.minimum(gap, ((profile - picks[-1]) ** 2).sum(1))
    centres = np.array(picks)
    for _ in range(12):
        near = _nearest(profile, centres)
        centres = np.array([profile[near == c].mean(0) if (near == c).any() else centres[c] for c in range(len(centres))])
    return centres


def _nearest(profile: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1)[None] - 2 * profile @ centres.T).argmin(1)


def gradients(model: Model, rows: np.ndarray, ends: np.ndarray, toxic: np.ndarray, weight: np.ndarray):
    """Of the weighted mean log loss of some texts: its value, the gradients of filters, biases and output, and those of the table rows (places, values)."""
    x = model.embedded(rows)
    hidden = x.shape[1]
    top, y = model.pooled(x, ends)
    act = np.maximum(top, 0)
    z = np.clip(act @ model.out + model.out_bias, -30, 30)
    loss = float((weight * (np.logaddexp(0, z) - toxic * z)).mean())
    d = ((1 / (1 + np.exp(-z)) - toxic) * weight / len(toxic)).astype(x.dtype)
    d_top = d[:, None] * model.out[None] * (top > 0)
    owner = np.repeat(np.arange(len(toxic)), np.diff(ends))
    hit = y == top[owner]
    place = np.zeros(top.shape, np.int64)
    for f in range(y.shape[1]):
        spots = np.flatnonzero(hit[:, f])[::-1]
        place[owner[spots], f] = spots  # the first of equals stays
    found: dict = {"out": act.T @ d, "bias": d.sum()}
    spots, values = [], []
    for wi, w in enumerate(WIDTHS):
        cols = slice(wi * FILTERS, (wi + 1) * FILTERS)
        spot, g = place[:, cols], d_top[:, cols]
        for j in range(w):
            inputs = x[(spot + j).ravel()].reshape(*spot.shape, hidden)
            spots.append((spot + j).ravel())
            values.append((g[:, :, None] * model.filters[wi][j].T[None]).reshape(-1, hidden))
            found["f", wi, j] = np.einsum("nf,nfh->hf", g, inputs)
        found["b", wi] = g.sum(0)
    return loss, found, np.concatenate(spots), np.concatenate(values)


def train(texts: pa.Array, toxic: np.ndarray, seed: int = 5) -> Model:
    """A model of the given texts (whole) and labels; a fifth of them only sets the thresholds."""
    rng = np.random.default_rng(seed)
    parts = [encode(b.column(0)) for b in pieces(pa.record_batch([texts], ["text"]), "text", PIECE)]
    at = np.concatenate([p[0] for p in parts], 1) if parts else np.zeros((SIDES, 0), np.int32)
    offsets = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p[1]) for p in parts]) if parts else [])]).astype(np.int64)
    profile = np.concatenate([p[2] for p in parts]) if parts else np.zeros((0, SHORT + LEADS), np.float32)
    del parts
    n = len(toxic)
    fit = np.arange(n) % 5 != 0
    clusters = max(1, min(CLUSTERS, int((toxic[~fit] == 1).sum()) // PER_CLUSTER))
    centres = _clusters(profile, clusters) if n else np.zeros((1, SHORT + LEADS), np.float32)
    hidden = SIDES * DIM
    model = Model(
        [rng.normal(0, 0.02, (BUCKETS, DIM)).astype(np.float32) for _ in range(SIDES)],
        [[rng.normal(0, 0.3, (hidden, FILTERS)).astype(np.float32) for _ in range(w)] for w in WIDTHS],
        [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32),
        0.0,
        centres,
        np.zeros(len(centres)),
    )
    both = len(set(toxic[fit].tolist())) == 2
    if not both:  # nothing to tell apart: the rate known so far
        model.out[:] = 0
        model.out_bias = 4.0 if n and toxic.mean() > 0.5 else -4.0
        return model
    text = np.repeat(np.arange(n), np.diff(offsets))
    of_fit = fit[text] & (at[0] != 0)
    for side in range(SIDES):  # rows start at the log-odds of the texts that hold them
        pair = np.unique(at[side][of_fit] * n + text[of_fit])
        bucket, label = pair // n, toxic[pair % n] == 1
        bad, good = np.bincount(bucket[label], minlength=BUCKETS), np.bincount(bucket[~label], minlength=BUCKETS)
        n_bad, n_good = (toxic[fit] == 1).sum(), (toxic[fit] != 1).sum()
        odds = np.log((bad + 1) / (n_bad + 2)) - np.log((good + 1) / (n_good + 2))
        model.tables[side][:, 0] = np.clip(odds, -3, 3) / 3
        model.tables[side][(bad + good < MIN_TEXTS)] = 0
        model.tables[side][0] = 0
    live = [np.any(t != 0, axis=1) for t in model.tables]
    for parts in model.filters:
        for part in parts:
            part[::DIM, : FILTERS // 2] = 1.0 / len(parts)
    model.out[:] = np.abs(model.out)
    grads = {}

    def step(name, value, grad):
        total = grads.setdefault(name, np.zeros_like(value))
        total += grad * grad
        value -= RATE * grad / (np.sqrt(total) + 1e-6)

    squares = [np.zeros((BUCKETS, DIM), np.float32) for _ in range(SIDES)]
    weight = np.where(toxic == 1, 0.5 / max(1, (toxic[fit] == 1).sum()), 0.5 / max(1, (toxic[fit] != 1).sum())) * fit.sum()
    bias = np.zeros(1, np.float32)
    for _ in range(EPOCHS):
        order = rng.permutation(np.flatnonzero(fit))
        for k in range(0, len(order), BATCH):
            some = order[k : k + BATCH]
            index = np.concatenate([np.arange(offsets[i], offsets[i + 1]) for i in some])
            ends = np.concatenate([[0], np.cumsum(offsets[some + 1] - offsets[some])])
            rows = at[:, index]
            _, found, where, grad = gradients(model, rows, ends, toxic[some], weight[some])
            for wi, w in enumerate(WIDTHS):
                for j in range(w):
                    step(("f", wi, j), model.filters[wi][j], found["f", wi, j])
                step(("b", wi), model.bias[wi], found["b", wi])
            step("out", model.out, found["out"])
            step("bias", bias, np.array([found["bias"]], np.float32))
            model.out_bias = float(bias[0])
            for side in range(SIDES):
                bucket, inverse = np.unique(rows[side][where], return_inverse=True)
                g = np.zeros((len(bucket), DIM), np.float32)
                np.add.at(g, inverse, grad[:, side * DIM : (side + 1) * DIM])
                g *= live[side][bucket][:, None]
                squares[side][bucket] += g * g
                model.tables[side][bucket] -= RATE * g / (np.sqrt(squares[side][bucket]) + 1e-6)
    cuts = np.unique(np.searchsorted(offsets, np.arange(0, offsets[-1] + ROWS, ROWS)).clip(0, n))
    z = np.concatenate([model.logits(at[:, offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in zip(cuts, cuts[1:], strict=False)])
    del at
    aside = ~fit if len(set(toxic[~fit].tolist())) == 2 else np.ones(n, bool)
    model.thresholds = calibrated(z[aside], toxic[aside], model.cluster(profile)[aside], len(centres))
    return model


def calibrated(z: np.ndarray, toxic: np.ndarray, cluster: np.ndarray, clusters: int) -> np.ndarray:
    """Each cluster's threshold: the middle of the widest range of cuts with fewest errors, those of all texts counting as LEAN of its own."""
    order = np.argsort(z, kind="stable")
    z, bad, cluster = z[order].astype(np.float64), toxic[order] == 1, cluster[order]

    def errors(own):  # at each cut: toxic texts below and others above
        return np.concatenate([[0], np.cumsum(bad & own)]) + np.concatenate([np.cumsum((~bad & own)[::-1])[::-1], [0]])

    every = errors(np.ones(len(z), bool)) * (LEAN / len(z))
    edges = np.concatenate([[z[0] - 1], z, [z[-1] + 1]])
    out = np.empty(clusters)
    for c in range(clusters):
        total = errors(cluster == c) + every
        low = total <= total.min() + 1e-9
        begins, ends = np.flatnonzero(low & ~np.concatenate([[False], low[:-1]])), np.flatnonzero(low & ~np.concatenate([low[1:], [False]]))
        widest = (edges[ends + 1] - edges[begins]).argmax()
        out[c] = (edges[begins[widest]] + edges[ends[widest] + 1]) / 2
    return out


def learn(docs: DataFrame, labels: DataFrame, held: int | None = 0, modulus: int = 5, most: int = LABELLED) -> Model:
    """A model of at most ``most`` labelled rows of either class, none with crc32(doc_id) mod ``modulus`` equal to ``held``; of repeated ids the least text."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if held is not None:
        known = known.where(~kept_out(held, modulus))
    some = first_hashed(known.where("toxic = 1"), most).unionByName(first_hashed(known.where("toxic != 1"), most))
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    got = rows.toArrow().sort_by("doc_id")
    texts = got.column("text").combine_chunks()
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    model = train(texts, np.array(got.column("toxic").to_pylist(), np.int64))
    del got, texts
    tidy()
    return model


def scored(docs: DataFrame, model: Model, *keep: str, name: str = "score") -> DataFrame:
    """``keep`` and ``name``, the score (0 to 1) of each whole text; null texts count as empty.  The model's size is fixed by its tables."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    types = dict(docs.dtypes)

    def kernel(piece):
        return pa.RecordBatch.from_arrays([*(piece.column(c) for c in keep), pa.array(sent.value.scores(piece.column("text")))], [*keep, name])

    return map_texts(docs.select(*dict.fromkeys([*keep, "text"])), kernel, ", ".join(f"`{c}` {types[c]}" for c in keep) + f", `{name}` double")


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if the score is 0.5 or more), one row for each row of ``docs``.

    Only rows that are not held out (crc32 of the id mod 5 is 0) are learned from; scores come from
    the whole text alone, however long.  Null and empty texts get the score of no words.  Null ids are not
    held out; repeated rows keep their rows and tie; without labels of both classes every score leans to the
    one known.  Other columns are not read, so their names may clash; an empty table gives an empty result.
    """
    out = scored(docs, learn(docs, labels), "doc_id")
    return out.select("doc_id", kept_out(0, 5).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

"""Scoring of texts by a hidden Markov language model.

States emit word classes: each of the at most about TOP most frequent training words is a class of its own, any
other word belongs to the class of its last bytes.  Baum-Welch counts of transitions and classes are summed
over all partitions.  Within a class of rare words a word w is drawn with probability (1 - e) c(w) / C, and
the rest e (Good-Turing: the share of words met once) goes to words never met.  That factor depends on the
word, not on the state, so the scaled forward recursion runs over the classes alone.

Texts are cut into tokens twice: once for the counts, once to be written down as classes, which is what every
round and the scoring read.  Counts of the KNOWN most frequent words are broadcast; the tokens beyond them
are joined with the corpus counts by word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import LOWER, kept_out, pieces, raw, stored, word_hashes, words_of

#: Words with a class of their own, words whose counts are broadcast, classes of other words (a power of 2), bytes that tell those, states.
TOP, KNOWN, ENDINGS, TAIL, STATES = 1 << 15, 1 << 18, 4096, 3, 6
#: Tokens of the texts that the first parameters come from (about; none of a text of over START_LONGEST tokens), rounds over them, and rounds over all texts.
START_TOKENS, START_LONGEST, START_ROUNDS, ROUNDS = 600_000, 65_536, 10, 2
#: Weight of the class frequencies in each state's emissions, and of an even start in transitions.
PRIOR, EVEN = 50.0, 5.0
#: Stands for the end of a text; bytes of text that are cut into tokens at once; tokens that the recursion runs over
#: side by side (whole texts); bytes of classes that a task sorts by length at once; tokens after which a long text is cut into stretches.
END, PIECE, SIDE_BY_SIDE, HELD, STRETCH = 1, 1 << 19, 1_000_000, 24 << 20, 1 << 14
_TAILS = np.uint64(ENDINGS - 1)


def tokens(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all rows' tokens, each row's last being END, and the n + 1 offsets.  A key is a word's hash with its ending's class as lowest bits."""
    data, ends = raw(col)
    data = LOWER[data]
    starts, stops, at = words_of(data, ends)
    n = np.diff(at)
    offsets = np.concatenate([[0], np.cumsum(n + 1)])
    both = word_hashes(data, np.concatenate([starts, np.maximum(starts, stops - TAIL)]), np.concatenate([stops, stops]))
    out = np.full(offsets[-1], END, np.uint64)
    place = np.arange(len(starts)) + np.repeat(np.arange(len(n)), n)
    out[place] = (both[: len(starts)] & ~_TAILS) | (both[len(starts) :] & _TAILS)
    return out, offsets


def word_counts(docs: DataFrame) -> DataFrame:
    """(w, c): how often each key stands in the rows that are not held; END counts the rows.  A task adds up its own first."""

    def local(batches):
        kept = []
        for batch in batches:
            for piece in pieces(batch, "text", PIECE):
                kept.append(np.unique(tokens(piece.column("text"))[0], return_counts=True))
                if len(kept) > 8:
                    kept = [_merged(kept)]
        if kept:
            u, n = _merged(kept)
            for s in range(0, len(u), 100_000):
                e = slice(s, s + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(u[e].view(np.int64)), pa.array(n[e])], ["w", "c"])

    part = docs.where("NOT held").select("text").mapInArrow(local, "w bigint, c bigint")
    return part.groupBy("w").agg(F.sum("c").alias("c"))


def _merged(kept):
    w, n = (np.concatenate(x) for x in zip(*kept, strict=True))
    u, inverse = np.unique(w, return_inverse=True)
    return u, np.bincount(inverse, n, len(u)).astype(np.int64)


class Lookup:
    """Places of keys in a sorted array: the leading bits name the few entries that a key is compared with."""

    def __init__(self, keys: np.ndarray):
        bits = max(8, int(2 * len(keys)).bit_length())
        self.keys, self.shift = keys, np.uint64(64 - bits)
        self.first = np.searchsorted(keys >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)

    def __call__(self, w: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        out = np.full(len(w), -1, np.int32)
        lead = (w >> self.shift).astype(np.int64)
        at, end = self.first[lead], self.first[lead + 1]
        left = np.flatnonzero(at < end)
        at, end = at[left], end[left]
        while len(left):
            same = self.keys[at] == w[left]
            out[left[same]] = at[same]
            at = at + 1
            on = ~same & (at < end)
            left, at, end = left[on], at[on], end[on]
        return out


@dataclass
class Vocabulary:
    keys: np.ndarray  # sorted, of the words whose counts are broadcast
    counts: np.ndarray  # their counts
    own: np.ndarray  # the class of each, or -1 where its ending tells it
    top: int  # classes of single words
    end_count: int

    @property
    def classes(self) -> int:
        return self.top + ENDINGS + 1

    def lookup(self) -> Lookup:
        if not hasattr(self, "_lookup"):
            self._lookup = Lookup(self.keys)
        return self._lookup

    def classified(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class of each token, and the place of its word among ``keys``, or -1."""
        at = self.lookup()(w)
        out = (w & _TAILS).astype(np.int64) + self.top
        if len(self.keys):
            own = np.where(at >= 0, self.own[at], -1)
            out = np.where(own >= 0, own, out)
        out[w == END] = self.top + ENDINGS
        return out, at


@dataclass
class Model:
    initial: np.ndarray
    moves: np.ndarray  # STATES x STATES
    emits: np.ndarray  # classes x STATES

    def forward(self, sym: np.ndarray, offsets: np.ndarray, back: bool = False):
        """Log10 likelihood of each sequence; with ``back`` the expected counts: first states, moves, and states by class.

        All sequences advance together, one token a step.  A long one is cut into stretches that advance
        side by side: each stretch's transfer from every state comes first, which tells the states that the
        stretches begin and end in; the result is that of the whole recursion.
        """
        kind = np.float32 if back else np.float64
        states, size = len(self.initial), np.diff(offsets)
        pieces_of = np.maximum(1, -(-size // STRETCH))
        text = np.repeat(np.arange(len(size)), pieces_of)
        number = np.arange(len(text)) - np.repeat(np.cumsum(pieces_of) - pieces_of, pieces_of)
        starts = offsets[:-1][text] + number * STRETCH
        size = np.minimum(STRETCH, offsets[1:][text] - starts)
        begin = np.repeat(self.initial[:, None], len(text), 1).astype(kind)
        long = np.flatnonzero(pieces_of[text] > 1)
        if len(long):
            lanes, unit = _Lanes(np.repeat(starts[long], states), np.repeat(size[long], states)), np.tile(np.eye(states), len(long))
            scales, ends, _ = self._ahead(lanes, sym, unit, np.float64)
            scales, ends = scales.reshape(-1, states), ends.reshape(states, -1, states)
            most = scales.max(1, keepdims=True)
            transfer = ends * 10.0 ** (scales - most)[None]  # to state, stretch, from state
            for at, one in enumerate(long[:-1]):
                if text[one] == text[one + 1]:
                    now = transfer[:, at] @ begin[:, one].astype(np.float64)
                    begin[:, one + 1] = (now / now.sum()) @ self.moves
        lanes = _Lanes(starts, size)
        logs, ends, kept = self._ahead(lanes, sym, begin, kind, back)
        logs = np.bincount(text, logs, len(offsets) - 1)
        if not back:
            return logs
        emit, alpha, scale = kept
        last = np.ones((states, len(text)), kind)
        for at in range(len(long) - 2, -1, -1):
            one = long[at]
            if text[one] == text[one + 1]:
                now = self.moves @ (transfer[:, at + 1].T @ last[:, one + 1].astype(np.float64))
                last[:, one] = now / (now @ ends[:, one])
        beta, moves = np.empty_like(alpha), self.moves.astype(kind)
        moved = np.zeros((states, states))
        active, begins, order = lanes.active, lanes.begins, lanes.order
        for t in range(len(active) - 1, -1, -1):
            n, s = active[t], begins[t]
            m = active[t + 1] if t + 1 < len(active) else 0
            if m:
                e = slice(begins[t + 1], begins[t + 1] + m)
                after = beta[:, e] * emit[:, e] / scale[e]
                moved += alpha[:, s : s + m] @ after.T
                beta[:, s : s + m] = moves @ after
            beta[:, s + m : s + n] = last[:, order[m:n]]
        head = np.empty(len(text), np.int64)  # where the first token of each stretch lies
        head[order] = np.arange(len(order))
        for one in long[:-1]:
            if text[one] == text[one + 1]:
                h = head[one + 1]
                moved += np.outer(ends[:, one], beta[:, h] * emit[:, h] / scale[h])
        beta *= alpha
        by_class = np.stack([np.bincount(sym[lanes.source], beta[k], len(self.emits)) for k in range(states)], 1)
        return logs, beta[:, head[number == 0]].sum(1, dtype=np.float64), moved * self.moves, by_class

    def _ahead(self, lanes, sym, begin, kind, keep=False):
        """Log10 of the scales of each lane, the states that each ends in, and with ``keep`` emissions, states and scales of all tokens."""
        emits, moves = np.ascontiguousarray(self.emits.T.astype(kind)), np.ascontiguousarray(self.moves.T.astype(kind))
        order, active, begins = lanes.order, lanes.active, lanes.begins
        ends = np.empty((len(self.initial), len(order)))
        scale = np.empty(len(lanes.source), kind)
        emit = np.take(emits, sym[lanes.source], axis=1) if keep else None
        alpha = np.empty_like(emit) if keep else None
        now = np.ascontiguousarray(begin[:, order], kind)
        for t, n in enumerate(active):
            s = slice(begins[t], begins[t] + n)
            if t:
                if n < now.shape[1]:
                    ends[:, order[n : now.shape[1]]] = now[:, n:]
                now = moves @ now[:, :n]
            now = now * (emit[:, s] if keep else np.take(emits, sym[lanes.source[s]], axis=1))
            scale[s] = now.sum(0)
            now /= scale[s]
            if keep:
                alpha[:, s] = now
        if len(active):
            ends[:, order[: now.shape[1]]] = now
        logs = np.bincount(lanes.lane, np.log10(scale.astype(np.float64)), len(order))
        return logs, ends, (emit, alpha, scale)


class _Lanes:
    """Sequences that advance together: the longest first; tokens lie step by step."""

    def __init__(self, starts: np.ndarray, size: np.ndarray):
        self.order = np.argsort(-size, kind="stable")
        size = size[self.order]
        self.active = np.searchsorted(-size, -np.arange(1, size[0] + 1), "right").tolist() if len(size) else []
        at = np.concatenate([[0], np.cumsum(self.active, dtype=np.int64)]).astype(np.int64)
        self.begins = at.tolist()
        rank = np.arange(at[-1]) - np.repeat(at[:-1], self.active)
        self.source = starts[self.order][rank] + np.repeat(np.arange(len(self.active)), self.active)
        self.lane = self.order[rank]


def _maximised(first, moved, emitted, prior: np.ndarray) -> Model:
    even = lambda x: (x + EVEN / len(x)) / (x + EVEN / len(x)).sum(-1, keepdims=True)
    emits = emitted + PRIOR * prior[:, None]
    return Model(even(first), even(moved), emits / emits.sum(0))


def _codes(vocabulary: Vocabulary) -> type:
    return np.uint16 if vocabulary.classes <= 1 << 16 else np.uint32


def _sequences(col: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all rows' tokens, and the lengths."""
    data, ends = raw(col)
    return np.frombuffer(data.tobytes(), kind).astype(np.int64), np.diff(ends) // np.dtype(kind).itemsize


def _together(batches, kind):
    """(classes, offsets, rows) of as many whole texts as advance side by side, texts of like lengths together."""
    hold, n = [], 0
    for batch in batches:
        hold.append(batch)
        n += pc.sum(pc.binary_length(batch.column("sym"))).as_py() or 0
        if n > HELD:
            yield from _by_length(hold, kind)
            hold, n = [], 0
    yield from _by_length(hold, kind)


def _by_length(hold, kind):
    hold = [x for x in hold if x.num_rows]
    if not hold:
        return
    rows = pa.Table.from_batches(hold)
    size = pc.binary_length(rows.column("sym")).to_numpy() // np.dtype(kind).itemsize
    order = np.argsort(-size, kind="stable")
    group = (np.cumsum(size[order]) - size[order]) // SIDE_BY_SIDE
    for some in np.split(order, np.flatnonzero(np.diff(group)) + 1):
        part = rows.take(pa.array(some)).combine_chunks().to_batches()[0]
        sym, sizes = _sequences(part.column("sym"), kind)
        yield sym, np.concatenate([[0], np.cumsum(sizes)]), part


def _expected(encoded: DataFrame, model: Model, kind: type):
    """Baum-Welch counts of all rows that are not held: summed in each task, then over all."""
    sent = encoded.sparkSession.sparkContext.broadcast(model)
    states = len(model.initial)

    def local(batches):
        model = sent.value
        first, moved, emitted = np.zeros(states), np.zeros((states, states)), np.zeros(model.emits.shape)
        for sym, offsets, _ in _together(batches, kind):
            _, a, b, seen = model.forward(sym, offsets, True)
            first += a
            moved += b
            emitted += seen
        some = np.flatnonzero(emitted.any(1))
        ids = np.concatenate([some, [-1], -2 - np.arange(states)]).astype(np.int32)
        rows = np.concatenate([emitted[some], first[None], moved])
        yield pa.RecordBatch.from_arrays([pa.array(ids), *(pa.array(np.ascontiguousarray(rows[:, k])) for k in range(states))], ["id", *(f"s{k}" for k in range(states))])

    cols = [f"s{k}" for k in range(states)]
    part = encoded.where("NOT held").select("sym").mapInArrow(local, "id int, " + ", ".join(f"{c} double" for c in cols))
    got = part.groupBy("id").agg(*(F.sum(c).alias(c) for c in cols)).toArrow()
    ids, rows = got.column("id").to_numpy(), np.stack([got.column(c).to_numpy() for c in cols], 1)
    emitted = np.zeros(model.emits.shape)
    emitted[ids[ids >= 0]] = rows[ids >= 0]
    moved = np.zeros((states, states))
    for k in range(states):
        moved[k] = rows[ids == -2 - k].sum(0)
    return rows[ids == -1].sum(0), moved, emitted


def _first_model(encoded: DataFrame, n_tokens: int, kind: type, states: int, prior: np.ndarray, seed: int = 1) -> Model:
    """Parameters after a few rounds over texts of about START_TOKENS tokens, from a random start."""
    share = int(1e6 * min(1.0, START_TOKENS / max(1, n_tokens)))
    some = encoded.where("NOT held").where(F.col("n_tokens") <= START_LONGEST).where(F.pmod(F.xxhash64("sym"), F.lit(1_000_000)) < share)
    got = some.select("sym").distinct().toArrow().sort_by("sym").combine_chunks().to_batches()
    rng = np.random.default_rng(seed)
    model = _maximised(np.ones(states), np.eye(states) * 40.0 + 1, prior[:, None] * rng.gamma(1.0, 1.0, (len(prior), states)) * 1e4, prior)
    hold = list(_together(got, kind))
    for _ in range(START_ROUNDS if hold else 0):
        sums = [model.forward(sym, offsets, True)[1:] for sym, offsets, _ in hold]
        model = _maximised(*(sum(x) for x in zip(*sums, strict=True)), prior)
    return model


def _vocabulary(counts: DataFrame, ends: int, top: int, known: int) -> Vocabulary:
    """The about ``known`` most frequent words, the first ``top`` of them with classes of their own.

    The least count of each comes from a histogram of the counts (steps of one part in 2,048); of the words at the step where the
    room ends a share goes by hash, so no task orders its words.
    """
    own = counts.where(F.col("w") != END)
    step = F.expr("shiftleft(shiftright(c, greatest(0, cast(floor(log2(c)) AS INT) - 11)), greatest(0, cast(floor(log2(c)) AS INT) - 11))")
    room, least, share = known, 0, 0
    for at, n in sorted(((r["at"], r["n"]) for r in own.groupBy(step.alias("at")).agg(F.count("*").alias("n")).collect()), reverse=True):
        least, share = at, int(1_000_000 * min(1.0, room / n))
        room -= n
        if room <= 0:
            break
    some = own.where((step > least) | ((step == least) & (F.pmod(F.xxhash64("w"), F.lit(1_000_000)) < share))).toArrow()
    w, c = some.column("w").to_numpy().view(np.uint64), some.column("c").to_numpy()
    order = np.argsort(w)
    w, c = w[order], c[order]
    single = np.sort(np.lexsort((w, -c))[:top])
    classes = np.full(len(w), -1, np.int32)
    classes[single] = np.arange(len(single))
    return Vocabulary(w, c, classes, len(single), ends)


def hmm_scores(docs: DataFrame, held: int = 0, modulus: int = 10, top: int = TOP, states: int = STATES, rounds: int = ROUNDS, known: int = KNOWN) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score, one row for each row of ``docs``.

    Learns from the rows whose crc32 of the id mod ``modulus`` is not ``held`` (a null id is learned
    from).  Null texts count as empty: their one token is the end.  base_score is the add-0.1 unigram
    score, score the model's log10 probability of the text, both over all tokens of the whole text, however
    long.  Without a row to learn from all counts are 0.  Repeated rows keep their rows and tie; other
    columns are not read, so their names may clash; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), kept_out(held, modulus).alias("held"))
    counts = stored(word_counts(rows))
    n, v, ends = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("w") == END, F.col("c"))), F.lit(0))).first()
    words = _vocabulary(counts, int(ends), top, known)
    kind = _codes(words)
    met = np.zeros((ENDINGS, 2))  # of the words that share a class: how many tokens, and how many words met once
    ending = F.col("w").bitwiseAND(ENDINGS - 1)
    for r in counts.where(F.col("w") != END).groupBy(ending.alias("ending")).agg(F.sum("c").alias("total"), F.count_if(F.col("c") == 1).alias("once")).collect():
        met[r["ending"]] = r["total"], r["once"]
    single = words.own >= 0
    its = (words.keys[single] & _TAILS).astype(np.int64)
    met[:, 0] -= np.bincount(its, words.counts[single], ENDINGS)
    met[:, 1] -= np.bincount(its, words.counts[single] == 1, ENDINGS)
    c_of = np.concatenate([words.counts[single], met[:, 0], [ends]])
    prior = (c_of + 0.5) / (c_of + 0.5).sum()
    unseen = np.where(met[:, 0] > 0, np.clip((met[:, 1] + 0.5) / (met[:, 0] + 1), 1e-4, 0.9), 1.0)
    z = float(n) + 0.1 * (v + 1)
    old_log = np.where(met[:, 0] > 0, np.log10(np.maximum(1e-300, 1 - unseen)) - np.log10(np.maximum(1, met[:, 0])), 0.0)
    base_of = np.log10((words.counts + 0.1) / z) if len(words.counts) else np.zeros(0)
    within = np.where(single, 0.0, np.log10(np.maximum(1, words.counts)) + old_log[(words.keys & _TAILS).astype(np.int64)])
    sent_words = spark.sparkContext.broadcast((words, base_of, within))

    def encode(batches):
        words, base_of, within = sent_words.value
        end_base = np.log10((words.end_count + 0.1) / z)
        for batch in batches:
            for piece in pieces(batch, "text", PIECE):
                w, offsets = tokens(piece.column("text"))
                sym, at = words.classified(w)
                is_end = w == END
                found, open_ = at >= 0, (at < 0) & ~is_end
                pick = lambda x: np.where(found, x[at], 0.0) if len(x) else np.zeros(len(w))  # noqa: E731, B023
                add = lambda x: np.add.reduceat(x, offsets[:-1])  # noqa: E731, B023
                spot = np.concatenate([[0], np.cumsum(open_)])[offsets].astype(np.int32)
                blob = sym.astype(kind).tobytes()
                edges = pa.array(offsets * np.dtype(kind).itemsize, pa.int64())
                syms = pa.LargeBinaryArray.from_buffers(pa.large_binary(), piece.num_rows, [None, edges.buffers()[1], pa.py_buffer(blob)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [
                        *(piece.column(c) for c in ("doc_id", "held", "k")),
                        pa.array(np.diff(offsets)),
                        pa.array(add((found | (is_end & (words.end_count > 0))).astype(np.int64))),
                        pa.array(add(pick(base_of) + np.where(is_end, end_base, 0.0))),
                        pa.array(add(pick(within))),
                        syms,
                        pa.ListArray.from_arrays(pa.array(spot), pa.array(w[open_].view(np.int64))),
                    ],
                    ["doc_id", "held", "k", "n_tokens", "known", "base", "within", "sym", "rest"],
                )

    keyed = rows.withColumn("k", F.monotonically_increasing_id())
    encoded = stored(keyed.mapInArrow(encode, "doc_id bigint, held boolean, k bigint, n_tokens bigint, known bigint, base double, within double, sym binary, rest array<bigint>"))
    model = _first_model(encoded, int(n), kind, states, prior)
    for _ in range(rounds):
        model = _maximised(*_expected(encoded, model, kind), prior)
    sent = spark.sparkContext.broadcast(model)
    names = ["doc_id", "held", "k", "n_tokens", "known", "base", "within"]

    def score(batches):
        for sym, offsets, part in _together(batches, kind):
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(sent.value.forward(sym, offsets))], [*names, "ahead"])

    parts = encoded.select(*names, "sym").mapInArrow(score, "doc_id bigint, held boolean, k bigint, n_tokens bigint, known bigint, base double, within double, ahead double")
    logs = spark.createDataFrame([(t, float(np.log10(e)), float(o)) for t, (e, o) in enumerate(zip(unseen, old_log, strict=True))], "ending int, new_log double, old_log double")
    sums = (
        encoded.select("k", F.explode("rest").alias("w"))
        .join(counts, "w", "left")
        .withColumn("ending", ending.cast("int"))
        .join(F.broadcast(logs), "ending")
        .groupBy("k")
        .agg(
            F.count("c").alias("rest_known"),
            F.sum(F.log10((F.coalesce("c", F.lit(0)) + 0.1) / F.lit(z))).alias("rest_base"),
            F.sum(F.when(F.col("c").isNull(), F.col("new_log")).otherwise(F.log10("c") + F.col("old_log"))).alias("rest_score"),
        )
    )
    none = F.lit(0.0)
    return parts.join(sums, "k", "left").select(
        "doc_id",
        F.col("held").alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("rest_known", F.lit(0))).alias("n_known"),
        F.lit(int(n)).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest_base", none)).alias("base_score"),
        (F.col("ahead") + F.col("within") + F.coalesce("rest_score", none)).alias("score"),
    )

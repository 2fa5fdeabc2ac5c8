"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays.

Every letter of the learning texts has a number of its own (those never seen there share one), anything
else is a boundary and runs of boundaries are one.  An n-gram of up to four numbers packs into 6 bits a
character, or as many as the letters take, up to 16; each order keeps one sorted array of the hashes seen in any language and, beside it,
the log-probabilities in all languages.  The language with the lowest cross-entropy a character wins.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import kept_out, pieces

#: Labelled texts of each language that are learned from (about as many, those with the lowest hashes, the first always), and bytes of them (about).
LABELLED, LABELLED_BYTES = 1_000, 8 << 20
#: Bits of a number: at least, and at most (four of them fill 64).
ORDER, BITS, MOST_BITS = 4, 6, 16
#: Bytes of text that are scored at once; share of a language's own texts that the rejection bound lets pass.
PIECE, PASS = 1 << 20, 0.995


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.array([chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in range(0x110000)]))
    return _LETTERS[0]


_LETTERS: list[np.ndarray] = []


def code_points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code points of all texts, each after ORDER - 1 zeros, and the offsets of the texts (zeros included)."""
    gap = "\0" * (ORDER - 1)
    low = [(t or "").replace("\0", " ").lower() for t in texts]
    points = np.frombuffer((gap + gap.join(low)).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, low), np.int64, len(low)) + ORDER - 1
    return points, np.concatenate([[0], np.cumsum(sizes)])


def code_type(bits: int) -> type:
    return np.uint32 if ORDER * bits <= 32 else np.uint64


def grams(points: np.ndarray, offsets: np.ndarray, numbers: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed ORDER-grams of all texts, and the n + 1 offsets of each text's."""
    sym = numbers[points]
    keep = sym != 0
    keep[1:] |= sym[:-1] != 0
    keep |= points == 0
    at = np.concatenate([[0], np.cumsum(keep)])[offsets]
    kind = code_type(bits)
    sym, real = sym[keep].astype(kind), points[keep] != 0
    code = sym.copy()
    for j in range(1, ORDER):
        code[j:] |= sym[:-j] << kind(bits * j)
    return code[real], np.concatenate([[0], np.cumsum(real)])[at]


@dataclass
class Model:
    languages: list[str]
    numbers: np.ndarray
    bits: int = BITS
    keys: list[np.ndarray] = field(default_factory=list)  # by order from 2: sorted hashes
    logs: list[np.ndarray] = field(default_factory=list)  # beside them: log probabilities, one column a language
    contexts: list[np.ndarray] = field(default_factory=list)  # by order from 2: sorted contexts
    weights: list[np.ndarray] = field(default_factory=list)  # beside them: log weight of the order below
    single: np.ndarray | None = None
    temperature: float = 1.0
    bounds: np.ndarray | None = None

    def log_probabilities(self, code: np.ndarray) -> np.ndarray:
        """One row a gram, one column a language."""
        return self._order(code, ORDER)

    def _order(self, code: np.ndarray, n: int) -> np.ndarray:
        kind = code_type(self.bits)
        if n == 1:
            return self.single[code & kind((1 << self.bits) - 1)]
        keys, logs = self.keys[n - 2], self.logs[n - 2]
        own = code & kind((1 << (self.bits * n)) - 1)
        at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
        out = logs[at]
        missing = np.flatnonzero(keys[at] != own)
        if len(missing):
            context = own[missing] >> kind(self.bits)
            contexts, weights = self.contexts[n - 2], self.weights[n - 2]
            at = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
            back = np.where((contexts[at] == context)[:, None], weights[at], np.float32(0))
            out[missing] = back + self._order(code[missing], n - 1)
        return out

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy (nats a character) of each text in each language; whether the text has a letter."""
        points, offsets = code_points(texts)
        code, at = grams(points, offsets, self.numbers, self.bits)
        lettered = np.concatenate([[0], np.cumsum(letters()[points])])
        has = np.diff(lettered[offsets]) > 0
        n = np.diff(at)
        out = np.zeros((len(texts), len(self.languages)))
        some = np.flatnonzero(n)
        if len(some):
            out[some] = -np.add.reduceat(self.log_probabilities(code), at[some], axis=0, dtype=np.float64) / n[some, None]
        return out, has


def _tables(code: np.ndarray, bits: int) -> list[tuple]:
    """Of one language, by order from ORDER down to 1: hashes and their (continuation) counts."""
    out, (keys, counts) = [], np.unique(code, return_counts=True)
    for n in range(ORDER, 0, -1):
        out.append((n, keys, counts.astype(np.float64)))
        if n > 1:  # how many characters come before each shorter gram
            keys, counts = np.unique(keys & keys.dtype.type((1 << (bits * (n - 1))) - 1), return_counts=True)
    return out


def train(texts: list[str], langs: list[str]) -> Model:
    """Models of the given whole texts; a tenth of them sets temperature and rejection bounds alone."""
    known = sorted(set(langs))
    seen: dict[str, int] = {}
    for t in texts:
        for c in set(t.lower()):
            if c.isalpha():
                seen[c] = seen.get(c, 0) + 1
    alphabet = sorted(seen, key=lambda c: (-seen[c], c))
    bits = max(BITS, (len(alphabet) + 1).bit_length())
    if bits > MOST_BITS:
        raise ValueError(f"{len(alphabet)} different letters to learn from, over {(1 << MOST_BITS) - 2}")
    numbers = np.where(letters(), np.uint16(len(alphabet) + 1), np.uint16(0))
    for k, c in enumerate(alphabet):
        numbers[ord(c)] = k + 1
    model = Model(known, numbers, bits)
    spare = np.arange(len(texts)) % 10 == 9
    by_lang = []
    for lang in known:
        own = [t for t, x, s in zip(texts, langs, spare, strict=True) if x == lang and not s] or [t for t, x in zip(texts, langs, strict=True) if x == lang]
        points, offsets = code_points(own)
        by_lang.append({n: (k, c) for n, k, c in _tables(grams(points, offsets, numbers, bits)[0], bits)})
    size = max(1 << BITS, len(alphabet) + 2)
    single = np.empty((size, len(known)), np.float64)
    for col, t in enumerate(by_lang):
        keys, counts = t[1]
        p = np.zeros(size)
        p[keys] = counts
        single[:, col] = (p + 0.5) / (p.sum() + 0.5 * size)
    model.single = np.log(single).astype(np.float32)
    for n in range(2, ORDER + 1):
        keys = np.unique(np.concatenate([t[n][0] for t in by_lang] or [np.empty(0, code_type(bits))]))
        context = keys >> code_type(bits)(bits)
        contexts = np.unique(context)
        below = np.exp(model._order(keys, n - 1).astype(np.float64))
        logs, weights = np.empty((len(keys), len(known))), np.empty((len(contexts), len(known)))
        for col, t in enumerate(by_lang):
            count = np.zeros(len(keys))
            count[np.searchsorted(keys, t[n][0])] = t[n][1]
            ones, twos = (count == 1).sum(), (count == 2).sum()
            discount = ones / (ones + 2 * twos) if ones and twos else 0.5
            spot = np.searchsorted(contexts, context)
            total = np.bincount(spot, count, len(contexts))
            kinds = np.bincount(spot, count > 0, len(contexts))
            weight = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
            logs[:, col] = np.log(np.maximum(count - discount, 0) / np.maximum(total[spot], 1) + weight[spot] * below[:, col])
            weights[:, col] = np.log(weight)
        model.keys.append(keys)
        model.logs.append(logs.astype(np.float32))
        model.contexts.append(contexts)
        model.weights.append(weights.astype(np.float32))
    check = [i for i in np.flatnonzero(spare)] or list(range(len(texts)))
    entropy, has = model.entropies([texts[i] for i in check])
    truth = np.array([known.index(langs[i]) for i in check])
    entropy, truth = entropy[has], truth[has]
    best = None
    for t in (1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0):
        p = _softmax(-t * entropy)
        loss = -np.log(np.maximum(p[np.arange(len(truth)), truth], 1e-12)).mean() if len(truth) else 0.0
        if best is None or loss < best[0]:
            best = (loss, t)
    model.temperature = best[1]
    model.bounds = np.array([np.quantile(entropy[truth == k, k], PASS) * 1.05 if (truth == k).any() else np.inf for k in range(len(known))])
    return model


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True, initial=-1e300))
    return e / e.sum(1, keepdims=True)


def learn(docs: DataFrame, held: int | None = 1, modulus: int = 3, most: int = LABELLED) -> Model | None:
    """A model of about ``most`` texts of each language, or None where none is labelled."""
    known = docs.select("doc_id", "text", "lang").where("lang IS NOT NULL AND text IS NOT NULL")
    if held is not None:
        known = known.where(~kept_out(held, modulus))
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000))
    counts = known.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size"), F.min(place).alias("first")).collect()
    if not counts:
        return None
    share = lambda r: int(1e6 * min(1.0, most / r["n"], LABELLED_BYTES / max(1, r["size"])))
    shares = docs.sparkSession.createDataFrame([(r["lang"], max(share(r), r["first"] + 1)) for r in counts], "lang string, share bigint")
    some = known.join(F.broadcast(shares), "lang").where(place < F.col("share"))
    rows = some.select("text", "lang").toArrow().sort_by([("lang", "ascending"), ("text", "ascending")])
    order = np.random.default_rng(3).permutation(rows.num_rows)
    texts, langs = rows.column("text").to_pylist(), rows.column("lang").to_pylist()
    return train([texts[i] for i in order], [langs[i] for i in order]) if len(order) else None


def predicted(docs: DataFrame, model: Model | None, *keep: str) -> DataFrame:
    """``keep``, lang_pred, score and rejected of each whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    types = dict(docs.dtypes)

    def run(batches):
        model = sent.value
        for batch in batches:
            for piece in pieces(batch, "text", PIECE):
                texts = piece.column("text").to_pylist()
                if model is None:
                    lang, score, rejected = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
                else:
                    entropy, has = model.entropies(texts)
                    first = entropy.argmin(1)
                    score = np.where(has, _softmax(-model.temperature * entropy)[np.arange(len(texts)), first], 0.0)
                    rejected = ~has | (entropy[np.arange(len(texts)), first] > model.bounds[first])
                    lang = [model.languages[k] if h else "und" for k, h in zip(first, has, strict=True)]
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in keep), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], [*keep, "lang_pred", "score", "rejected"])

    schema = "".join(f"`{c}` {types[c]}, " for c in keep) + "lang_pred string, score double, rejected boolean"
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def language_report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected, one row for each row of ``docs``.

    Only rows with text and lang that are not held out (crc32 of the id mod 3 is 1) are learned from.
    lang_pred is ``und``, with score 0, for null texts and texts without a letter; otherwise a learned
    language.  rejected marks texts whose cross-entropy is beyond what that language's own texts reach.
    Null ids are not held out, repeated rows keep their rows and tie; without labels all is ``und``.  Texts are read
    whole, however long; other columns are not read, so their names may clash; an empty table gives an empty result.
    """
    out = predicted(docs, learn(docs), "doc_id")
    return out.select("doc_id", kept_out(1, 3).alias("held_out"), "lang_pred", "score", "rejected")

"""Quality rules as a learned decision list, in DataFrame operations alone.

Statistics of each text are column expressions.  From the statistics of a bounded sample of labelled
rows, sequential covering grows conjunctions of thresholds that single out the bad rows, prunes each on
rows set aside, and stops when no rule is precise enough.  The list becomes one ordered chain of WHENs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import SPACE, inner, n_inner, split_words
from .textkit import first_hashed

#: Labelled rows that the rules are learned from at most: those whose hashed ids come first.
LABELLED = 8_000
#: Share of bad rows among those that a rule covers, and covered bad rows: as many of all growing rows, and at least.
PRECISE, COVER_SHARE, COVERS = 0.97, 0.002, 4
FEATURES = ("symbol_rate", "upper_rate", "bang_rate", "dup_line_rate", "repeat_rate", "word_length", "n_words")


def text_stats(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper, n_bangs, n_lines (all long).

    Null texts count as empty ones.  A word is repeated if it lies in a window of three words that the
    text holds twice or more; windows are told apart by 64-bit hashes.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    removed = lambda p: (F.length(text) - F.length(F.regexp_replace(text, p, ""))).cast("bigint")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    base = docs.select(
        *keep,
        split_words(F.col("text")).alias("__p"),
        F.length(F.regexp_replace(text, SPACE + "+", "")).cast("bigint").alias("word_chars"),
        removed(r"[#*$%&|<>]+").alias("n_symbols"),
        removed(r"[A-Z]+").alias("n_upper"),
        removed(r"!+").alias("n_bangs"),
        lines.alias("__l"),
    )
    rest = ("word_chars", "n_symbols", "n_upper", "n_bangs")
    cut = base.select(
        *keep,
        *rest,
        F.size("__l").cast("bigint").alias("n_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("bigint").alias("n_dup_lines"),
        n_inner(F.col("__p")).alias("__n"),
        inner(F.col("__p")).alias("__w"),
    )
    rest += ("n_lines", "n_dup_lines")
    gram = lambda i: F.struct(F.xxhash64(F.get("__w", i), F.get("__w", i + 1), F.get("__w", i + 2)).alias("h"), i.alias("i"))
    spots = F.when(F.col("__n") > 2, F.sequence(F.lit(0), F.col("__n") - 3)).otherwise(F.array().cast("array<int>"))
    grams = cut.select(*keep, *rest, "__n", F.sort_array(F.transform(spots, gram)).alias("__g"))
    alike = lambda x, k: (F.get("__g", k - 1)["h"] == x["h"]) | (F.get("__g", k + 1)["h"] == x["h"])
    found = grams.select(*keep, *rest, "__n", F.sort_array(F.transform(F.filter("__g", lambda x, k: F.coalesce(alike(x, k), F.lit(False))), lambda x: x["i"])).alias("__i"))
    step = lambda s, i: F.struct((s["c"] + F.least(F.lit(3), i - s["last"])).alias("c"), i.alias("last"))
    covered = F.aggregate("__i", F.struct(F.lit(0).alias("c"), F.lit(-3).alias("last")), step, lambda s: s["c"].cast("bigint"))
    return found.select(*keep, F.col("__n").cast("bigint").alias("n_words"), *rest, covered.alias("n_repeat_words"))


def with_features(stats: DataFrame) -> DataFrame:
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return stats.withColumns(
        {
            "symbol_rate": share("n_symbols", "word_chars"),
            "upper_rate": share("n_upper", "word_chars"),
            "bang_rate": share("n_bangs", "word_chars"),
            "dup_line_rate": share("n_dup_lines", "n_lines"),
            "repeat_rate": share("n_repeat_words", "n_words"),
            "word_length": share("word_chars", "n_words"),
        }
    )


@dataclass(frozen=True)
class Rule:
    """Rows that meet every (feature, '>' or '<=', threshold) are bad."""

    tests: tuple[tuple[str, str, float], ...]

    def holds(self, row) -> bool:
        return all((row[f] > t) if op == ">" else (row[f] <= t) for f, op, t in self.tests)

    def column(self) -> Column:
        out = F.lit(True)
        for f, op, t in self.tests:
            out &= (F.col(f) > t) if op == ">" else (F.col(f) <= t)
        return out


def _precision(rule: Rule, rows: list[dict]) -> tuple[float, int]:
    """Share of bad rows among those covered (1 if none is), and their number."""
    met = [r["bad"] for r in rows if rule.holds(r)]
    return (sum(met) / len(met) if met else 1.0), sum(met)


def _grow(rows: list[dict], features) -> Rule:
    """Adds the threshold of the best FOIL gain until the rule is pure."""
    from math import log2

    tests: tuple = ()
    pool = rows
    while pool and not all(r["bad"] for r in pool) and len(tests) < 4:
        p0, n0 = sum(r["bad"] for r in pool), len(pool)
        best = None
        for f in features:
            order = sorted(pool, key=lambda r: r[f])
            below_bad = below = 0
            for a, b in zip(order, order[1:], strict=False):
                below += 1
                below_bad += a["bad"]
                if a[f] == b[f]:
                    continue
                cut = (a[f] + b[f]) / 2
                for op, p, n in (("<=", below_bad, below), (">", p0 - below_bad, n0 - below)):
                    if p:
                        gain = p * (log2(p / n) - log2(p0 / n0))
                        if best is None or gain > best[0]:
                            best = (gain, (f, op, cut))
        if best is None or best[0] <= 0:
            break
        tests += (best[1],)
        pool = [r for r in pool if Rule((best[1],)).holds(r)]
    return Rule(tests)


def learn(rows: list[dict], features=FEATURES, precise: float = PRECISE) -> list[Rule]:
    """Ordered rules for the bad rows.  ``rows``: features, bad (0 or 1) and prune (whether set aside for pruning)."""
    grow, prune, out = [r for r in rows if not r["prune"]], [r for r in rows if r["prune"]], []
    covers = max(COVERS, COVER_SHARE * len(grow))
    while sum(r["bad"] for r in grow) >= covers:
        rule = _grow(grow, features)
        if not rule.tests:
            break
        while len(rule.tests) > 1:  # drop last tests while the set-aside rows don't mind
            shorter = Rule(rule.tests[:-1])
            if _precision(shorter, prune)[0] < max(precise, _precision(rule, prune)[0]):
                break
            rule = shorter
        share, hits = _precision(rule, grow)
        if hits < covers or min(share, _precision(rule, prune)[0]) < precise:
            break
        out.append(rule)
        grow, prune = [r for r in grow if not rule.holds(r)], [r for r in prune if not rule.holds(r)]
    return out


def learn_rules(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> list[Rule]:
    """Rules from the at most ``most`` labelled rows whose hashed doc_id comes first; statistics of whole texts, of repeated ids the least."""
    some = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = docs.select("doc_id", "text").join(F.broadcast(first_hashed(some, most)), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("quality").alias("quality"))
    stats = with_features(text_stats(known, "doc_id", "quality"))
    rows = stats.select(*FEATURES, (F.col("quality") == 0).cast("int").alias("bad"), (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("prune")).collect()
    return learn([r.asDict() for r in rows])


def verdict(rules: list[Rule]) -> Column:
    """True where no rule holds: the ordered list as one conditional expression."""
    if not rules:
        return F.lit(True)
    chain = F.when(rules[0].column(), False)
    for rule in rules[1:]:
        chain = chain.when(rule.column(), False)
    return chain.otherwise(True)


def quality_report(docs: DataFrame, labels: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept: one row for each row of ``docs``.

    base_failed: under 50 words, or over half of the words repeated.  kept is false there, and where a
    learned rule holds.  Null and empty texts have no words and fail.  Repeated rows, null ids and
    ties each keep their row; without labels there are no rules.  Other columns are not read.
    """
    rules = learn_rules(docs, labels) if rules is None else rules
    stats = with_features(text_stats(docs, "doc_id"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & verdict(rules)).alias("kept"))

"""Quality rules as a learned decision list, in DataFrame functions alone.

Statistics of each text are array and string functions. A bounded sample of labelled statistics goes
to the driver, where sequential covering learns the list: a rule for one class grows by the threshold
that gains most information until it covers no other class, is pruned on rows kept aside, and what it
covers is taken out before the next rule. The list becomes one ordered conditional expression.

Behaviour at the edges: a null text has no words and all counts 0; without labels of both classes the
list is empty and keeps everything that passes the base rules; rows with a null id or label teach
nothing; several labels of one id count by their mean; repeated rows have equal results; columns
named as the statistics are replaced, others pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from planmark.llm.common import spare, text_of

#: Labelled documents of each class whose statistics may go to the driver.
SAMPLE_PER_CLASS = 1_500
WINDOW = 8
LEAST_WORDS, MOST_REPEATED_PERCENT = 20, 30
BLANKS = " \t\n\x0b\f\r"
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks")


def _paired(column: str, gap: int) -> Column:
    """Digest of each element and the one ``gap`` places on."""
    shifted = F.slice(F.col(column), gap + 1, F.greatest(F.size(column), F.lit(1)))
    return F.slice(
        F.zip_with(F.col(column), shifted, lambda a, b: F.xxhash64(a, b)),
        1, F.greatest(F.size(column) - gap, F.lit(0)),
    )


def statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the columns of ``STATISTICS`` (long).

    Windows of eight words are compared by 64-bit digests, doubled up from words to pairs, fours and
    eights. Only a text with a repeated digest is sorted to find the places that repeats cover.
    """
    out = df.drop(*STATISTICS)
    body, words, w1, w2, w4, w8, placed, starts = spare(
        out, "t_body", "t_words", "t_w1", "t_w2", "t_w4", "t_w8", "t_placed", "t_starts"
    )
    lines = F.filter(F.split(F.col(body), "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    bare = F.btrim(F.col(body), F.lit(BLANKS))
    out = (
        out.withColumn(body, text_of(text))
        .withColumn(words, F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[\\x20\\x09-\\x0D]+")))
        .withColumn(w1, F.transform(words, lambda x: F.xxhash64(x)))
        .withColumns({
            "n_words": F.size(words).cast("long"),
            "word_chars": F.length(F.array_join(words, "")).cast("long"),
            "n_symbols": F.regexp_count(body, F.lit("[#*$%&|<>]")).cast("long"),
            "n_upper": F.regexp_count(body, F.lit("\\p{Lu}")).cast("long"),
            "n_marks": F.regexp_count(body, F.lit("[!|]")).cast("long"),
            placed: lines,
        })
        .withColumn("n_dup_lines", (F.size(placed) - F.size(F.array_distinct(placed))).cast("long"))
        .drop(placed, words, body)
        .withColumn(w2, _paired(w1, 1)).drop(w1)
        .withColumn(w4, _paired(w2, 2)).drop(w2)
        .withColumn(w8, _paired(w4, 4)).drop(w4)
    )
    repeated = F.size(F.array_distinct(w8)) < F.size(w8)
    pair = "array<struct<h:bigint,i:int>>"
    out = out.withColumn(
        placed,
        F.when(repeated, F.sort_array(F.transform(w8, lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
        .otherwise(F.array().cast(pair)),
    ).drop(w8)
    last = F.size(placed) - 1

    def twice(x: Column, k: Column) -> Column:
        before = F.get(F.col(placed), k - 1)["h"]
        after = F.get(F.col(placed), k + 1)["h"]
        return ((k > 0) & (before == x["h"])) | ((k < last) & (after == x["h"]))

    out = out.withColumn(
        starts, F.sort_array(F.transform(F.filter(placed, twice), lambda x: x["i"]))
    ).drop(placed)
    steps = F.zip_with(
        F.col(starts), F.slice(F.col(starts), 2, F.greatest(F.size(starts), F.lit(1))),
        lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)),
    )
    total = F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x)
    out = out.withColumn("n_repeat_words", F.coalesce(total, F.lit(0).cast("long"))).drop(starts)
    # one row out of each row: no later filter is pushed into the statistics and computes them over and over
    kept = [F.col(f"`{c}`") for c in out.columns if c not in STATISTICS]
    return out.select(*kept, F.inline(F.array(F.struct(*STATISTICS))))


def base_failed() -> Column:
    """The fixed rules that come before the learned ones."""
    n = F.col("n_words")
    return (n < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > n * MOST_REPEATED_PERCENT)


def features() -> dict[str, Column]:
    """What thresholds may be set on, from the statistics."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    letters = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    return {
        "words": F.col("n_words").cast("double"),
        "letters per word": F.col("word_chars") / words,
        "symbols per word": F.col("n_symbols") / words,
        "marks per word": F.col("n_marks") / words,
        "capitals per letter": F.col("n_upper") / letters,
        "repeated lines per word": F.col("n_dup_lines") / words,
        "repeated words": F.col("n_repeat_words") / words,
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # at or above the threshold, else below it
    threshold: float

    def holds(self, values: dict[str, np.ndarray]) -> np.ndarray:
        return (values[self.feature] >= self.threshold) == self.above

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    keep: bool

    def covers(self, values: dict[str, np.ndarray]) -> np.ndarray:
        size = len(next(iter(values.values())))
        out = np.ones(size, dtype=bool)
        for c in self.conditions:
            out &= c.holds(values)
        return out

    def __str__(self) -> str:
        return f"{'keep' if self.keep else 'drop'} if {' and '.join(map(str, self.conditions))}"


def _grow(values: dict, target: np.ndarray, weight: np.ndarray, most: int = 4) -> tuple[Condition, ...]:
    """Add thresholds by information gain until nothing else is covered."""
    chosen: list[Condition] = []
    covered = np.ones(len(target), dtype=bool)
    while len(chosen) < most and (weight * (covered & ~target)).sum() > 0:
        hit, miss = (weight * (covered & target)).sum(), (weight * (covered & ~target)).sum()
        base = np.log2(hit / (hit + miss))
        best = (0.0, None, None)
        for name, column in values.items():
            inside = np.unique(column[covered])
            if len(inside) < 2:
                continue
            cuts = (inside[:-1] + inside[1:]) / 2
            if len(cuts) > 200:
                cuts = cuts[np.linspace(0, len(cuts) - 1, 200).astype(int)]
            for cut in cuts:
                for above in (True, False):
                    condition = Condition(name, above, float(cut))
                    now = covered & condition.holds(values)
                    p, n = (weight * (now & target)).sum(), (weight * (now & ~target)).sum()
                    if p <= 0:
                        continue
                    gain = p * (np.log2(p / (p + n)) - base)
                    if gain > best[0] + 1e-12:
                        best = (gain, condition, now)
        if best[1] is None:
            break
        chosen.append(best[1])
        covered = best[2]
    return tuple(chosen)


def _prune(rule: Rule, values: dict, target: np.ndarray, weight: np.ndarray) -> Rule:
    """Drop last conditions while the rule is worth as much on rows kept aside."""
    def worth(r: Rule) -> float:
        covered = r.covers(values)
        p, n = (weight * (covered & target)).sum(), (weight * (covered & ~target)).sum()
        return (p - n) / (p + n) if p + n else -1.0

    best = rule
    for size in range(len(rule.conditions) - 1, 0, -1):
        shorter = Rule(rule.conditions[:size], rule.keep)
        if worth(shorter) >= worth(best):
            best = shorter
    return best


def learn(values: dict[str, np.ndarray], good: np.ndarray, weight: np.ndarray, seed: int = 5, most_rules: int = 12,
          least_precision: float = 0.9) -> list[Rule]:
    """An ordered list of rules that drop; what none covers is kept."""
    if not len(good) or good.all() or not good.any():
        return []
    draw = np.random.default_rng(seed)
    aside = draw.random(len(good)) < 1 / 3
    left = np.ones(len(good), dtype=bool)
    rules: list[Rule] = []
    while len(rules) < most_rules and (left & ~good & ~aside).any():
        grow, prune = left & ~aside, left & aside
        part = {k: v[grow] for k, v in values.items()}
        conditions = _grow(part, ~good[grow], weight[grow])
        if not conditions:
            break
        kept_aside = {k: v[prune] for k, v in values.items()}
        rule = _prune(Rule(conditions, False), kept_aside, ~good[prune], weight[prune])
        covered = rule.covers(values) & left
        hit, miss = (weight * (covered & ~good)).sum(), (weight * (covered & good)).sum()
        if hit <= 0 or hit / (hit + miss) < least_precision:
            break
        rules.append(rule)
        left &= ~covered
    return rules


def verdict(rules: list[Rule], columns: dict[str, Column]) -> Column:
    """The list as one conditional: the first rule that covers a row decides; else it is kept."""
    out = None
    for rule in rules:
        condition = F.lit(True)
        for c in rule.conditions:
            column = columns[c.feature]
            condition = condition & ((column >= c.threshold) if c.above else (column < c.threshold))
        out = F.when(condition, F.lit(rule.keep)) if out is None else out.when(condition, F.lit(rule.keep))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def train(
    documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", quality: str = "quality",
    per_class: int = SAMPLE_PER_CLASS,
) -> list[Rule]:
    """Learn from the statistics of at most ``per_class`` labelled documents of each class, the first
    by a digest of the id. Rows that the base rules drop anyway teach nothing."""
    marked = (
        labels.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{quality}`").alias("quality"))
        .filter("doc_id is not null and quality is not null")
        .groupBy("doc_id").agg((F.avg("quality") >= 0.5).alias("good"))
    )
    shares = {r["good"]: r["n"] for r in marked.groupBy("good").agg(F.count("*").alias("n")).collect()}
    if len(shares) < 2:
        return []
    order = F.xxhash64(F.lit("rules"), "doc_id")
    parts = [marked.filter(F.col("good") == g).orderBy(order, "doc_id").limit(per_class) for g in (False, True)]
    sample = parts[0].union(parts[1])
    texts = documents.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    counted = statistics(texts.join(F.broadcast(sample), "doc_id"))
    named = [c.alias(f"f{i}") for i, c in enumerate(features().values())]
    rows = (
        counted.filter(~base_failed()).select("doc_id", "good", *named)
        .groupBy("doc_id", "good").agg(*[F.min(f"f{i}").alias(f"f{i}") for i in range(len(named))]).collect()
    )
    rows.sort(key=lambda r: r["doc_id"])
    good = np.array([r["good"] for r in rows], dtype=bool)
    values = {name: np.array([r[f"f{i}"] for r in rows], dtype=float) for i, name in enumerate(features())}
    seen = {g: max(1, int((good == g).sum())) for g in (False, True)}
    weight = np.array([shares[bool(g)] / seen[bool(g)] for g in good])
    return learn(values, good, weight)


def judge(df: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """Adds the statistics, ``base_failed`` and ``kept``."""
    counted = statistics(df.drop("base_failed", "kept"), text).withColumn("base_failed", base_failed())
    return counted.withColumn("kept", ~F.col("base_failed") & verdict(rules, features()))

"""Language identification: averaged hashed subword embeddings and a linear softmax.

Subwords are the 2-, 3- and 4-grams of the lower-cased text in which every run of non-letters is one
boundary. Each falls into one of ``BUCKETS`` embedding rows; a text is the mean of its rows, and a
linear layer with softmax gives the language. Trained by stochastic gradient descent in numpy, on
pieces of a bounded sample of labelled documents. At prediction the embedding and the linear layer
are multiplied out, so a subword adds one short row of logits. A temperature and a rejection
threshold are fitted on pieces kept out of training.

Behaviour at the edges: a null text, and one without letters, is ``und`` with score 0; documents
without a language teach nothing; a language with one labelled document is learned from it; without any, or
on an empty table, everything is ``und``; very long texts are counted in slices of a batch of their own; ties between
languages go to the first by code point; repeated rows have equal results; other columns pass
through, columns named as the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from planmark.llm.common import bound_batches, slices

#: Labelled documents that training uses, one of each language at least, and the characters of each.
SAMPLE, STRETCH = 6_000, 2_000
DIGESTS = 1 << 40
BUCKETS, WIDTH = 1 << 16, 12
GRAMS = (2, 3, 4)
#: Of the pieces kept out of training that are accepted, so many must be right.
PRECISION = 0.99
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which of the code points are letters."""
    return np.array([chr(i).isalpha() for i in range(0x110000)], dtype=bool)


def subwords(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length: the buckets of all subwords, text after text, and how many each text has."""
    lowered = [f"\n{x.lower()}\n" for x in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), "<u4")
    lengths = np.array([len(x) for x in lowered], np.int64)
    owner = np.repeat(np.arange(len(texts)), lengths)
    letter = _letters()[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of a run of non-letters
    keep[np.cumsum(lengths) - lengths] = True
    codes, owner = np.where(letter, codes, 32).astype(np.uint32)[keep], owner[keep]
    out = []
    for n in GRAMS:
        size = max(0, len(codes) - n + 1)
        mixed = np.full(size, n, np.uint32)
        for i in range(n):
            mixed = (mixed ^ codes[i : i + size]) * np.uint32(0x9E3779B1)
            mixed ^= mixed >> np.uint32(15)
        inside = owner[:size] == owner[n - 1 : n - 1 + size]
        bucket = (mixed[inside] * np.uint32(0x85EBCA6B)) >> np.uint32(16)
        out.append((bucket.astype(np.int64), np.bincount(owner[:size][inside], minlength=len(texts))))
    return out


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # logits of each bucket
    bias: np.ndarray
    temperature: float
    threshold: float

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        total, seen = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        for bucket, counts in subwords(texts):
            some = np.flatnonzero(counts)
            if len(some):
                begins = (np.cumsum(counts) - counts)[some]
                total[some] += np.add.reduceat(self.table[bucket], begins, axis=0)
            seen += counts
        return total / np.maximum(seen, 1)[:, None] + self.bias, seen

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        filled = [x or "" for x in texts]
        if not self.languages or not filled:
            return [UNKNOWN] * len(filled), np.zeros(len(filled))
        logit, _ = self.logits(filled)
        share = softmax(logit / self.temperature)
        best = share.argmax(axis=1)
        lettered = np.array([bool(_LETTER.search(x)) for x in filled])
        names = [self.languages[i] if ok else UNKNOWN for i, ok in zip(best, lettered)]
        return names, np.where(lettered, share[np.arange(len(best)), best], 0.0)


def softmax(logit: np.ndarray) -> np.ndarray:
    power = np.exp(logit - logit.max(axis=1, keepdims=True))
    return power / power.sum(axis=1, keepdims=True)


def _pieces(texts: list[str], labels: np.ndarray, draw: np.random.Generator) -> tuple[list[str], np.ndarray]:
    """Some stretches of each text, short and long."""
    out, of = [], []
    for text, label in zip(texts, labels):
        for size in (30, 120, 400):
            at = int(draw.integers(0, max(1, len(text) - size + 1)))
            out.append(text[at : at + size])
            of.append(label)
    return out, np.array(of, np.int64)


def fit(texts: list[str], names: list[str], seed: int = 11, epochs: int = 4, rate: float = 0.5) -> Model:
    languages = sorted(set(names))
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 1.0)
    draw = np.random.default_rng(seed)
    label = np.array([languages.index(n) for n in names], np.int64)
    order = draw.permutation(len(texts))
    held = order[: len(texts) // 5] if len(texts) >= 10 else order[:0]
    used = order[len(held) :]
    pieces, target = _pieces([texts[i] for i in used], label[used], draw)
    split = [np.split(bucket, np.cumsum(counts)[:-1]) for bucket, counts in subwords(pieces)]
    rows = [np.concatenate(parts) for parts in zip(*split)]
    embed = draw.normal(0, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    linear, bias = np.zeros((WIDTH, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    batch = 16
    steps = max(1, epochs * len(rows) // batch)
    for step in range(steps):
        slow = rate * (1 - step / steps) + 1e-3
        chosen = draw.integers(0, len(rows), batch)
        size = np.array([len(rows[i]) for i in chosen])
        if not size.all():
            chosen, size = chosen[size > 0], size[size > 0]
            if not len(chosen):
                continue
        flat = np.concatenate([rows[i] for i in chosen])
        mean = np.add.reduceat(embed[flat], np.cumsum(size) - size, axis=0) / size[:, None]
        error = softmax(mean @ linear + bias)
        error[np.arange(len(chosen)), target[chosen]] -= 1
        back = (error @ linear.T) / size[:, None]
        linear -= slow * (mean.T @ error)
        bias -= slow * 0.1 * error.sum(axis=0)
        np.subtract.at(embed, flat, (slow * WIDTH * np.repeat(back, size, axis=0)).astype(np.float32))
    model = Model(languages, (embed @ linear).astype(np.float32), bias.astype(np.float64), 1.0, 0.0)
    if len(held):
        pieces, target = _pieces([texts[i] for i in held], label[held], draw)
        logit, counts = model.logits(pieces)
        logit, target = logit[counts > 0], target[counts > 0]
        if len(target):
            row = np.arange(len(target))
            losses = [
                (float(-np.log(np.maximum(softmax(logit / t)[row, target], 1e-12)).mean()), float(t))
                for t in np.exp(np.linspace(-3, 2, 101))
            ]
            model.temperature = min(losses)[1]
            share = softmax(logit / model.temperature)
            top, right = share.max(axis=1), share.argmax(axis=1) == target
            down = np.argsort(-top, kind="stable")
            good = np.flatnonzero(np.cumsum(right[down]) / (row + 1) >= PRECISION)
            model.threshold = float(top[down][good[-1]]) if len(good) else 1.0
    return model


def train(
    df: DataFrame, learnable: Column | None = None, doc_id: str = "doc_id", text: str = "text",
    lang: str = "lang", sample: int = SAMPLE,
) -> Model:
    """Fit from at most ``sample`` documents with text and language, shared evenly among the languages and
    chosen by a digest of id; every language has one at least.

    A stretch of ``STRETCH`` characters at a place drawn from the id stands for a document. Languages
    are never sorted: the count of each gives a bound below which about twice the wanted digests lie,
    and the driver, which gathers those, keeps the smallest.
    """
    known = df.select(
        F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{lang}`").cast("string").alias("lang"),
        F.col(f"`{text}`").cast("string").alias("text"),
    ).filter("text is not null and lang is not null and doc_id is not null")
    if learnable is not None:
        known = known.filter(learnable)
    digest = F.pmod(F.xxhash64(F.lit("lang"), "doc_id"), F.lit(DIGESTS))
    known = known.withColumn("digest", digest)
    counted = known.groupBy("lang").agg(F.count("*").alias("n"), F.min("digest").alias("least")).collect()
    if not counted:
        return fit([], [])
    each = max(1, sample // len(counted))
    bounds = [(r["lang"], max(r["least"], min(DIGESTS, 2 * (each + 50) * DIGESTS // r["n"]))) for r in counted]
    bound = df.sparkSession.createDataFrame(bounds, "lang string, bound long")  # a row per language, as gathered above
    place = F.pmod(F.xxhash64(F.lit("at"), "doc_id"), F.greatest(F.length("text") - STRETCH, F.lit(0)) + 1) + 1
    near = known.join(F.broadcast(bound), "lang").filter("digest <= bound").groupBy("lang", "digest", "doc_id").agg(
        F.min(F.substring(F.col("text"), place.cast("int"), F.lit(STRETCH))).alias("text")
    )
    ahead = sorted(near.collect(), key=lambda r: (r["lang"], r["digest"], r["doc_id"]))
    rows = [r for _, same in groupby(ahead, lambda r: r["lang"]) for r in islice(same, each)]
    rows.sort(key=lambda r: (r["doc_id"], r["lang"]))
    return fit([r["text"] for r in rows], [r["lang"] for r in rows])


def predict(
    df: DataFrame, model: Model, text: str = "text", lang: str = "lang_pred", score: str = "score",
    accepted: str = "accepted", reject: bool = True,
) -> DataFrame:
    """Adds the predicted language, its calibrated probability, and whether that reaches the threshold.

    With ``reject``, a text below the threshold is ``und`` in ``lang``.
    """
    bound_batches(df)
    shared = df.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows of a float per language

    @F.arrow_udf("lang string, score double")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        worker = shared.value
        for batch in batches:
            texts = batch.to_pylist()
            names, scores = [], [np.zeros(0)]
            for a, b in slices([x or "" for x in texts], 300_000):
                name, share = worker.predict(texts[a:b])
                names += name
                scores.append(share)
            yield pa.StructArray.from_arrays(
                [pa.array(names, pa.string()), pa.array(np.concatenate(scores), pa.float64())], names=["lang", "score"]
            )

    out = df.withColumn("l_found", found.asNondeterministic()(F.col(f"`{text}`").cast("string")))
    enough = F.col("l_found.score") >= model.threshold
    name = F.when(enough, F.col("l_found.lang")).otherwise(F.lit(UNKNOWN)) if reject else F.col("l_found.lang")
    return out.withColumns({lang: name, score: F.col("l_found.score"), accepted: enough}).drop("l_found")

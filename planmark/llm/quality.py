"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

A term is a word that the labelled sample knows, the shape of any other word (lower, capital, upper,
mixed, digits), or a run of symbols. Each term has a sparse random index vector, drawn from a digest
of the term; its context vector is its own index vector and those of its neighbours, summed over the
sample. A document is the mean context vector of its terms. The network is trained in numpy on the
driver from a bounded sample; its temperature is fitted on rows kept out of training, weighted back
to the classes' true shares. Scoring is one narrow pass over whole texts.

Behaviour at the edges: a null or empty text has the zero vector and the score the network gives to
it; rows without a label, with a null id or a null quality teach nothing; several labels of one id
count by their mean; without two classes to learn from, every score is the share of label 1 (0.5 if
there is no label at all); repeated rows have equal scores; other columns pass through, columns
named as the results are replaced.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from planmark.llm.common import bound_batches, slices

#: Labelled documents of each class that training may gather on the driver.
SAMPLE_PER_CLASS = 2_000
TERMS, WIDTH, NONZERO, REACH, HIDDEN = 2_048, 64, 8, 2, 24
#: Terms whose number a worker remembers.
REMEMBERED = 200_000
_TOKEN = re.compile(r"[^\W_]+|[^\w\s]+|_+")
SHAPES = ("<lower>", "<Capital>", "<UPPER>", "<miXed>", "<digits>", "<symbols>")


def shape(token: str) -> int:
    if not token[0].isalnum():
        return 5
    if token.islower():
        return 0
    if token.isupper():
        return 2 if len(token) > 1 else 1
    if token[0].isupper() and token[1:].islower():
        return 1
    return 4 if token.isdigit() else 3


def index_vector(term: str) -> np.ndarray:
    """A few positions of plus or minus one, the same on every machine."""
    draw = np.random.default_rng(zlib.crc32(term.encode("utf-8", "surrogatepass")))
    vector = np.zeros(WIDTH, np.float32)
    vector[draw.choice(WIDTH, NONZERO, replace=False)] = draw.choice([-1.0, 1.0], NONZERO)
    return vector


@dataclass
class Network:
    terms: dict[str, int]  # known words; shapes come first
    vectors: np.ndarray
    first: np.ndarray
    first_bias: np.ndarray
    second: np.ndarray
    second_bias: float
    temperature: float
    constant: float | None = None

    def numbers(self, text: str, known: dict[str, int]) -> np.ndarray:
        out = []
        for token in _TOKEN.findall(text):
            number = known.get(token)
            if number is None:
                number = self.terms.get(token)
                if number is None:
                    number = shape(token)
                known[token] = number
            out.append(number)
        return np.array(out, np.int64)

    def pool(self, texts: list[str], known: dict[str, int]) -> np.ndarray:
        size = len(self.vectors)
        out = np.zeros((len(texts), WIDTH), np.float32)
        for at in range(0, len(texts), 64):
            rows = [self.numbers(x, known) for x in texts[at : at + 64]]
            flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
            lengths = np.array([len(r) for r in rows])
            flat = flat + np.repeat(np.arange(len(rows)), lengths) * size
            counts = np.bincount(flat, minlength=len(rows) * size).reshape(len(rows), size).astype(np.float32)
            out[at : at + 64] = counts @ self.vectors / np.maximum(lengths, 1)[:, None]
        return out

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return np.tanh(pooled @ self.first + self.first_bias) @ self.second + self.second_bias

    def scores(self, texts: list[str], known: dict[str, int]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        logit = self.logits(self.pool(texts, known)).astype(np.float64) / self.temperature
        return 1 / (1 + np.exp(-np.clip(logit, -60, 60)))


def _vocabulary(texts: list[str]) -> dict[str, int]:
    """The shapes and the terms of most documents, by count and then by name."""
    seen: Counter = Counter()
    for text in texts:
        seen.update(set(_TOKEN.findall(text)))
    ranked = sorted(((t, n) for t, n in seen.items() if n >= 5), key=lambda x: (-x[1], x[0]))
    names = [*SHAPES, *(t for t, _ in ranked if t not in SHAPES)][:TERMS]
    return {t: i for i, t in enumerate(names)}


def context_vectors(rows: list[np.ndarray], terms: dict[str, int]) -> np.ndarray:
    """Random indexing: neighbours' index vectors summed per term, nearer ones weighing more."""
    index = np.stack([index_vector(t) for t in terms])
    near = np.zeros((len(terms), len(terms)), np.float32)
    for numbers in rows:
        for gap in range(1, REACH + 1):
            pairs = numbers[:-gap] * len(terms) + numbers[gap:]
            np.add.at(near.ravel(), pairs, np.float32(1 / gap))
    near += near.T
    share = near / np.maximum(near.sum(axis=1, keepdims=True), 1)
    return index + share @ index


def fit(texts: list[str], labels: np.ndarray, share_of_one: float, seed: int = 7) -> Network:
    """Train on ``texts``; ``share_of_one`` is the share of label 1 among all labelled rows."""
    blank = Network({}, np.zeros((0, WIDTH)), np.zeros(0), np.zeros(0), np.zeros(0), 0.0, 1.0)
    if len(set(labels.tolist())) < 2:
        blank.constant = float(share_of_one)
        return blank
    draw = np.random.default_rng(seed)
    terms = _vocabulary(texts)
    net = Network(terms, np.zeros((len(terms), WIDTH), np.float32), *[np.zeros(0)] * 3, 0.0, 1.0)
    known: dict[str, int] = {}
    net.vectors = context_vectors([net.numbers(x, known) for x in texts], terms)
    pooled = net.pool(texts, known)
    label = labels.astype(np.float32)
    balance = np.where(label == 1, share_of_one / label.mean(), (1 - share_of_one) / (1 - label.mean())).astype(np.float32)
    order = draw.permutation(len(texts))
    held, used = order[: max(1, len(texts) // 5)], order[max(1, len(texts) // 5) :]
    center, spread = pooled[used].mean(axis=0), pooled[used].std(axis=0)
    spread = np.maximum(spread, 0.1 * spread.mean() + 1e-6)  # what hardly varies here may vary elsewhere
    inputs = (pooled - center) / spread
    weights = [
        draw.normal(0, WIDTH**-0.5, (WIDTH, HIDDEN)).astype(np.float32), np.zeros(HIDDEN, np.float32),
        draw.normal(0, HIDDEN**-0.5, HIDDEN).astype(np.float32), np.zeros(1, np.float32),
    ]
    speed, drift = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    step = 0
    for _ in range(60):
        for at in range(0, len(used), 64):
            rows = draw.choice(used, 64)
            x, y = inputs[rows], label[rows]
            inner = np.tanh(x @ weights[0] + weights[1])
            guess = 1 / (1 + np.exp(-(inner @ weights[2] + weights[3][0])))
            error = (guess - y) * balance[rows] / len(rows)
            back = np.outer(error, weights[2]) * (1 - inner**2)
            slopes = [x.T @ back, back.sum(axis=0), inner.T @ error, np.array([error.sum()])]
            step += 1
            for i, slope in enumerate(slopes):
                slope = slope + 1e-4 * weights[i]
                speed[i] = 0.9 * speed[i] + 0.1 * slope
                drift[i] = 0.999 * drift[i] + 0.001 * slope**2
                weights[i] -= 0.003 * (speed[i] / (1 - 0.9**step)) / (np.sqrt(drift[i] / (1 - 0.999**step)) + 1e-8)
    net.first = (weights[0] / spread[:, None]).astype(np.float32)
    net.first_bias = (weights[1] - (center / spread) @ weights[0]).astype(np.float32)
    net.second, net.second_bias = weights[2].astype(np.float32), float(weights[3][0])
    logit = net.logits(pooled[held]).astype(np.float64)
    best = (np.inf, 1.0)
    for temperature in np.exp(np.linspace(-1.5, 2.5, 81)):
        guess = np.clip(1 / (1 + np.exp(-np.clip(logit / temperature, -60, 60))), 1e-9, 1 - 1e-9)
        loss = -(balance[held] * np.where(label[held] == 1, np.log(guess), np.log(1 - guess))).mean()
        best = min(best, (float(loss), float(temperature)))
    net.temperature = best[1]
    return net


def train(
    documents: DataFrame, labels: DataFrame, learnable: Column | None = None, doc_id: str = "doc_id",
    text: str = "text", quality: str = "quality", per_class: int = SAMPLE_PER_CLASS,
) -> Network:
    """Fit from at most ``per_class`` labelled documents of each class, the first by a digest of the id.

    ``learnable`` is a condition on the column ``doc_id`` of the labels. The sample is the only thing
    that comes to the driver, and the only thing broadcast.
    """
    marked = (
        labels.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{quality}`").alias("quality"))
        .filter("doc_id is not null and quality is not null")
    )
    if learnable is not None:
        marked = marked.filter(learnable)
    marked = marked.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
    shares = {r["quality"]: r["n"] for r in marked.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    total = sum(shares.values())
    if not total:
        return fit([], np.zeros(0), 0.5)
    order = F.xxhash64(F.lit("quality"), "doc_id")
    parts = [marked.filter(F.col("quality") == q).orderBy(order, "doc_id").limit(per_class) for q in (0, 1)]
    sample = parts[0].union(parts[1])
    texts = documents.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    rows = (
        texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "quality")
        .agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).collect()
    )
    rows.sort(key=lambda r: r["doc_id"])
    return fit([r["text"] for r in rows], np.array([r["quality"] for r in rows]), shares.get(1, 0) / total)


def score(df: DataFrame, net: Network, text: str = "text", out: str = "score") -> DataFrame:
    """Adds ``out``, the calibrated probability of label 1, from the text alone."""
    bound_batches(df)
    shared = df.sparkSession.sparkContext.broadcast(net)  # under 1 MB: TERMS vectors of WIDTH

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model, known = shared.value, {}
        for batch in batches:
            texts = [x or "" for x in batch.to_pylist()]
            found = []
            for a, b in slices(texts):
                if len(known) > REMEMBERED:
                    known.clear()
                found.append(model.scores(texts[a:b], known))
            yield pa.array(np.concatenate(found) if found else np.zeros(0), pa.float64())

    return df.withColumn(out, scored.asNondeterministic()(F.col(f"`{text}`").cast("string")))

"""Quality classifier on supervised subword embeddings.

A word's vector is the mean of learned vectors: one for the hashed word itself and one for each hashed
character n-gram. A document is the mean over its words, plus one further item for every word that
repeats the word before it (the word pair "same again"). A softmax over two classes reads the document vector.
All vectors are trained together by plain stochastic gradient descent in numpy.

The training sample is bounded: at most ``SAMPLE_ROWS`` labelled rows, half of each class, chosen by a digest
of the id. Features are extracted where the documents are; the driver receives those rows' sparse features only.
The classes' true shares, counted over all training labels, then correct the bias.

Once trained, a feature matters only through its difference between the classes, so scoring adds
up one number per word.

Defined results: a null or empty text, and a text of white space, scores the bias alone; without labels of both
classes the score is the share of label 1 (0.5 without labels); equal texts score the same.
The columns of the input stay; columns of the names written here are replaced.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from earmark.llm.common import small_batches, text_slices

BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
DIMENSIONS = 8
NGRAMS = (2, 3, 4)
SAMPLE_ROWS = 4_000
EPOCHS = 4
LEARNING_RATE = 2.0
SEED = 5
# words and characters of one of a worker's two tables
MAX_WORDS = 150_000
MAX_WORD_CHARS = 6_000_000
# characters of a word that its n-grams cover; longer words are read in parts of that length
WORD_CHARS = 64
# new words hashed at once
WORDS_AT_ONCE = 20_000
# odd factors of the places of a word
PLACES = np.random.default_rng(11).integers(0, 1 << 63, WORD_CHARS + 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
REPEAT = BUCKETS  # the item for a repeated word has a vector of its own


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, word of each): every word itself and the character n-grams of its padded form, hashed all at once."""
    owner, number, parts = [], [], []
    for i, w in enumerate(words):
        for j in range(0, len(w), WORD_CHARS):
            owner.append(i)
            number.append(j // WORD_CHARS)
            parts.append(f"<{w[j : j + WORD_CHARS]}>")
    owner, number = np.array(owner, dtype=np.int64), np.array(number, dtype=np.uint64)
    codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes)
    part = np.repeat(np.arange(len(parts)), sizes)
    place = np.arange(len(codes)) - np.repeat(ends - sizes, sizes)
    whole = np.zeros(len(words), dtype=np.uint64)
    if len(parts):
        sums = np.add.reduceat(codes * PLACES[place], ends - sizes)
        np.add.at(whole, owner, _mixed(sums + number))
    found, of = [_mixed(whole) >> np.uint64(64 - BUCKET_BITS)], [np.arange(len(words))]
    for n in NGRAMS:
        starts = np.flatnonzero(place + n <= sizes[part])
        grams = np.full(len(starts), n, dtype=np.uint64)
        for k in range(n):
            grams += codes[starts + k] * PLACES[k]
        found.append(_mixed(grams) >> np.uint64(64 - BUCKET_BITS))
        of.append(owner[part[starts]])
    return np.concatenate(found).astype(np.int64), np.concatenate(of)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of a 64-bit number spread over the high ones."""
    x = (x ^ (x >> np.uint64(31))) * PLACES[0]
    return (x ^ (x >> np.uint64(29))) * PLACES[1]


def sparse(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(features, weights): the mean over items of the mean over each item's features."""
    words = text.split()
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    items = max(1, len(words) + repeats)
    counted = Counter(words)
    buckets, of = features(list(counted))
    share = np.fromiter(counted.values(), np.float64, len(counted)) / np.bincount(of, minlength=len(counted)) / items
    weights = np.bincount(buckets, share[of], BUCKETS + 1)
    weights[REPEAT] = repeats / items
    at = np.flatnonzero(weights)
    return at.astype(np.int32), weights[at].astype(np.float32)


@dataclass
class QualityModel:
    """Difference of the classes per feature, and the bias; ``known`` and ``older`` are a worker's word tables."""

    difference: np.ndarray
    bias: float
    known: dict[str, float] = field(default_factory=dict)
    older: dict[str, float] = field(default_factory=dict)
    chars: int = 0

    def __getstate__(self):
        return {"difference": self.difference, "bias": self.bias, "known": {}, "older": {}, "chars": 0}

    def _learn(self, words: set[str]) -> None:
        """Values of all these words, each the mean over the word's features."""
        if len(self.known) > MAX_WORDS or self.chars > MAX_WORD_CHARS:
            self.older, self.known, self.chars = self.known, {}, 0
        known, older = self.known, self.older
        missing = [w for w in words if w not in known]
        again = [w for w in missing if w in older]
        known.update((w, older[w]) for w in again)
        new = [w for w in missing if w not in known] if again else missing
        self.chars += sum(map(len, missing))
        for i in range(0, len(new), WORDS_AT_ONCE):
            part = new[i : i + WORDS_AT_ONCE]
            buckets, of = features(part)
            sums = np.bincount(of, self.difference[buckets].astype(np.float64), len(part))
            known.update(zip(part, (sums / np.bincount(of, minlength=len(part))).tolist()))

    def scores(self, texts: list[str | None]) -> list[float]:
        parts = [(t or "").split() for t in texts]
        self._learn(set().union(*parts) if parts else set())
        get, repeat = self.known.__getitem__, float(self.difference[REPEAT])
        out = []
        for words in parts:
            repeats = sum(map(str.__eq__, words, words[1:]))
            total = math.fsum(map(get, words)) + repeats * repeat
            x = total / max(1, len(words) + repeats) + self.bias
            out.append(1 / (1 + math.exp(-max(-500.0, min(500.0, x)))))
        return out


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, share: float) -> QualityModel:
    """Train on sparse rows by stochastic gradient descent; ``share`` is the true share of label 1."""
    share = min(max(share, 1e-6), 1 - 1e-6)
    prior = math.log(share / (1 - share))
    if not len(rows) or labels.min() == labels.max():
        return QualityModel(np.zeros(BUCKETS + 1, np.float32), prior)
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS + 1, DIMENSIONS)).astype(np.float32)
    softmax = rng.uniform(-0.5, 0.5, (DIMENSIONS, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    step, steps = 0, EPOCHS * len(rows)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            rate = LEARNING_RATE * (1 - step / steps)
            at, weight = rows[i]
            mean = weight @ vectors[at]
            z = mean @ softmax + bias
            p = np.exp(z - z.max())
            gradient = p / p.sum()
            gradient[labels[i]] -= 1
            back = softmax @ gradient
            softmax -= rate * np.outer(mean, gradient)
            bias -= rate * 0.1 * gradient
            vectors[at] -= rate * np.outer(weight, back)
            step += 1
    drawn = labels.mean()
    difference = vectors @ (softmax[:, 1] - softmax[:, 0])
    return QualityModel(difference.astype(np.float32), float(bias[1] - bias[0]) + prior - math.log(drawn / (1 - drawn)))


def train(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "quality", sample_rows: int = SAMPLE_ROWS,
) -> QualityModel:
    """A model from the labelled documents; ``labels`` holds the training rows only."""
    small_batches(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    known = known.filter("id IS NOT NULL AND label IN (0, 1)")
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    picked = [
        known.filter(F.col("label") == c).orderBy(F.xxhash64("id"), "id").limit(sample_rows // 2) for c in (0, 1)
    ]

    @F.arrow_udf("struct<at: binary, weight: binary>")
    def extract(texts: pa.Array) -> pa.Array:
        rows = [sparse(t or "") for t in texts.to_pylist()]
        return pa.StructArray.from_arrays(
            [pa.array([a.tobytes() for a, _ in rows], type=pa.binary()), pa.array([w.tobytes() for _, w in rows], type=pa.binary())],
            ["at", "weight"],
        )

    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    # at most ``sample_rows`` ids by the limits above
    sample = texts.join(F.broadcast(picked[0].unionByName(picked[1])), "id")
    rows = sample.select("id", "label", extract("text").alias("f")).limit(2 * sample_rows).collect()
    rows.sort(key=lambda r: (r["id"], r["label"]))
    return fit(
        [(np.frombuffer(r["f"]["at"], np.int32), np.frombuffer(r["f"]["weight"], np.float32)) for r in rows],
        np.array([r["label"] for r in rows], dtype=np.int64),
        counts.get(1, 0) / total if total else 0.5,
    )


def score_of(docs: DataFrame, model: QualityModel, text: Column) -> Column:
    """Probability of label 1 for a text column."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array([s for part in text_slices(texts) for s in shared.value.scores(part)], type=pa.float64())

    return score(text)


def classify(docs: DataFrame, model: QualityModel, *, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The table with ``score`` and ``predicted`` (1 at ``threshold`` or above)."""
    out = docs.withColumn("score", score_of(docs, model, F.col(f"`{text_col}`")))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))

"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A three-letter run is bound into one vector: the first
letter's vector rotated twice, times the second's rotated once, times the third's. A document is the sum of the
vectors of its runs (words padded by a boundary mark); a language prototype is the sum over the
documents of that language. A document gets the language whose prototype has the largest cosine.

Vectors of letters follow from the letter and a seed, so every worker draws the same ones. Prototypes are
sums over all training documents: each task adds up its own, Spark adds those, and only
languages x dimensions numbers reach the driver.

Defined results: a text that is null, empty or without letters is ``und`` with score 0; ties go to
the language first in alphabetical order; rows with a null language or
the language ``und`` teach nothing; without any language to learn every text is ``und``; equal rows get equal results; the columns of the input stay,
columns of the names written here are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from earmark.llm.common import free_name, kept, quoted, small_batches, text_slices

DIMENSIONS = 1024
SEED = 11
UNKNOWN = "und"
# characters of a text that are worked on at once, and runs a table may hold before it is emptied
CHUNK_CHARS = 32_768
MAX_RUNS = 50_000
BOUNDARY = 32
_LETTER: list[np.ndarray] = []


def is_letter() -> np.ndarray:
    """For every code point whether it is a letter (numbers of any kind and marks are none)."""
    if not _LETTER:
        _LETTER.append(np.char.isalpha(np.arange(0x110000, dtype="<u4").view("<U1")))
    return _LETTER[0]


class RunTable:
    """Numbers and vectors of three-letter runs, bounded."""

    def __init__(self, dimensions: int):
        self.dimensions = dimensions
        self.letters: dict[int, np.ndarray] = {}
        self.clear()

    def clear(self) -> None:
        self.runs: dict[int, int] = {}
        self.vectors = np.zeros((1024, self.dimensions), dtype=np.int8)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            if len(self.letters) > 20_000:
                self.letters = {}
            bits = np.random.default_rng([SEED, code]).integers(0, 2, self.dimensions, dtype=np.int8)
            self.letters[code] = 2 * bits - 1
        return self.letters[code]

    def run(self, key: int) -> int:
        """The number of a run; its key holds three code points of 21 bits."""
        n = self.runs.get(key)
        if n is None:
            n = self.runs[key] = len(self.runs)
            if n >= len(self.vectors):
                self.vectors = np.concatenate([self.vectors, np.zeros_like(self.vectors)])
            a, b, c = (self.letter(key >> shift & 0x1FFFFF) for shift in (42, 21, 0))
            self.vectors[n] = np.roll(a, 2) * np.roll(b, 1) * c
        return n

    def full(self) -> bool:
        return len(self.runs) > MAX_RUNS

    def chunks(self, text: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(numbers, counts) of the distinct runs of a text, a bounded number of characters at a time."""
        codes = np.frombuffer(text.lower().encode("utf-32-le"), dtype="<u4")
        for start in range(0, len(codes), CHUNK_CHARS):
            # a letter's run is the letter between its neighbours; what is no letter is a boundary
            own = codes[max(0, start - 1) : start + CHUNK_CHARS + 1]
            letter = is_letter()[own]
            padded = np.full(len(own) + 2, BOUNDARY, dtype=np.int64)
            padded[1:-1][letter] = own[letter]
            middle = np.flatnonzero(letter)
            first = min(start, 1)
            middle = middle[(middle >= first) & (middle < first + CHUNK_CHARS)]
            keys = padded[middle] << 42 | padded[middle + 1] << 21 | padded[middle + 2]
            distinct, counts = np.unique(keys, return_counts=True)
            if len(distinct):
                yield np.fromiter(map(self.run, distinct.tolist()), np.int64, len(distinct)), counts

    def bundle(self, numbers: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Sum of the runs' vectors times their counts."""
        total = np.zeros(self.dimensions)
        for i in range(0, len(numbers), 4096):
            part = numbers[i : i + 4096]
            total += counts[i : i + 4096].astype(np.float32) @ self.vectors[part].astype(np.float32)
        return total

    def bundle_of(self, text: str) -> np.ndarray | None:
        """The bundle of a text, or None where it has no letter."""
        total = None
        for numbers, counts in self.chunks(text):
            own = self.bundle(numbers, counts)
            total = own if total is None else total + own
            if self.full():
                self.clear()
        return total


def _table(dimensions: int) -> RunTable:
    return kept(f"language {dimensions}", lambda: RunTable(dimensions))


def train_prototypes(
    docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", dimensions: int = DIMENSIONS
) -> tuple[list[str], np.ndarray]:
    """(languages, prototypes of length 1) from all rows with a text and a known language."""
    small_batches(docs.sparkSession)

    def bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(dimensions)
        counts: dict[str, np.ndarray] = {}

        def sums() -> pa.RecordBatch:
            used = [np.flatnonzero(c) for c in counts.values()]
            rows = [np.rint(table.bundle(at, c[at])).astype(np.int64) for at, c in zip(used, counts.values())]
            return pa.RecordBatch.from_arrays(
                [pa.array(list(counts), type=pa.string()), pa.array(rows, type=pa.list_(pa.int64()))], ["lang", "sums"]
            )

        def add(lang: str, numbers: np.ndarray, own: np.ndarray) -> None:
            have = counts.get(lang, np.zeros(0, np.int64))
            if len(have) < len(table.runs):
                have = np.concatenate([have, np.zeros(2 * len(table.runs) - len(have), np.int64)])
            have[numbers] += own
            counts[lang] = have

        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                counts.setdefault(lang, np.zeros(0, np.int64))
                for numbers, own in table.chunks(text):
                    add(lang, numbers, own)
                    if table.full():
                        yield sums()
                        counts.clear()
                        table.clear()
        yield sums()

    learn = docs.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"))
    learn = learn.filter(F.col("text").isNotNull() & (F.col("lang") != UNKNOWN))
    summed = (
        learn.mapInArrow(bundles, "lang string, sums array<long>")
        .select("lang", F.posexplode("sums").alias("pos", "x"))
        .groupBy("lang", "pos").agg(F.sum("x").alias("x")).collect()  # languages x dimensions
    )
    languages = sorted({r["lang"] for r in summed})
    prototypes = np.zeros((len(languages), dimensions))
    for r in summed:
        prototypes[languages.index(r["lang"]), r["pos"]] = r["x"]
    norms = np.linalg.norm(prototypes, axis=1, keepdims=True)
    return languages, prototypes / np.where(norms > 0, norms, 1)


def predicted(docs: DataFrame, model: tuple[list[str], np.ndarray], text: Column) -> Column:
    """A struct (lang_pred, score) for a text column; score is the cosine, at least 0."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def predict(texts: pa.Array) -> pa.Array:
        languages, prototypes = shared.value
        table = _table(prototypes.shape[1])
        names, scores = [], []
        for part in text_slices(texts):
            for t in part:
                v = table.bundle_of(t) if t and languages else None
                if v is None:
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                cosines = prototypes @ v / max(np.linalg.norm(v), 1e-12)
                best = int(np.argmax(cosines))
                names.append(languages[best])
                scores.append(float(min(1.0, max(0.0, cosines[best]))))
        return pa.StructArray.from_arrays(
            [pa.array(names, type=pa.string()), pa.array(scores, type=pa.float64())], ["lang_pred", "score"]
        )

    return predict(text)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], *, text_col: str = "text") -> DataFrame:
    """The table with ``lang_pred`` and ``score``."""
    new = free_name(docs.columns, "_lang")
    out = docs.withColumn(new, predicted(docs, model, *quoted([text_col])))
    others = quoted([c for c in docs.columns if c not in ("lang_pred", "score")])
    return out.select(*others, F.col(f"{new}.lang_pred").alias("lang_pred"), F.col(f"{new}.score").alias("score"))

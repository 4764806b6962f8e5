"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

Texts are lower-cased, everything that is no letter becomes a space, and all n-grams of one to three characters are hashed
to 2**15 features. Document frequencies are counted over all documents that may be learned from. The weights are fitted
by follow-the-regularised-leader with elastic-net penalties on a bounded sample of labelled rows, chosen by a hash of doc_id:
all rows of rare languages and about equally many of each other one, at most ``sample_per_language`` of each and
``sample_rows`` in all. Only the ``languages`` most frequent values of lang are learned and can be predicted, since the
weights of every class lie on the driver and in each task; a warning names how many values are left out. A fifth of each
language's sample, by another hash, is held back to calibrate the temperature of the probabilities. Every whole text is then predicted in its own task.

A document may be learned from if its lang is not null and ``crc32(doc_id as text) mod 4`` is not 2; the others are held
out. A prediction reads the text alone.

Defined cases: a null text, or one without a letter, is ``und`` with score 0, as is every text if nothing can be learned
from. A null doc_id is not held out, but is not learned from either. Repeated rows are predicted one by one.
"""

from __future__ import annotations

import warnings
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillstone.llm.arrow import mixed, steps, texts_of

BITS = 15
FEATURES = 1 << BITS
UNKNOWN = "und"
_SPACE = 0x20


@dataclass(frozen=True)
class Learning:
    """``languages``: so many of the most frequent values of lang are learned."""

    languages: int = 200
    sample_per_language: int = 800
    sample_rows: int = 20_000
    epochs: int = 3
    rate: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.1
    held_back: float = 0.2


class Grams:
    """Hashed n-gram counts of texts."""

    def __init__(self):
        self.letter = np.fromiter((chr(code).isalpha() for code in range(0x110000)), bool, 0x110000)

    def counts(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Features and how often each occurs; None if there is no letter."""
        codes = np.frombuffer((text or b"").decode().lower().encode("utf-32-le"), np.uint32)
        letters = self.letter[codes]
        if not letters.any():
            return None
        codes = np.where(letters, codes, np.uint32(_SPACE))
        kept = letters.copy()
        kept[1:] |= letters[:-1]  # one space after a word
        codes = np.concatenate([[_SPACE], codes[kept], [_SPACE]]).astype(np.uint64)
        key, features = codes, []
        for size in (1, 2, 3):
            if size > 1:
                key = key[:-1] << np.uint64(21) | codes[size - 1 :]
            features.append((mixed(key + np.uint64(size << 57)) >> np.uint64(64 - BITS)).astype(np.int64))
        found = np.bincount(np.concatenate(features), minlength=FEATURES)
        at = np.flatnonzero(found)
        return at, found[at]


def crc(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(crc(doc_id) == 2, F.lit(False))


def learnable(documents: DataFrame) -> DataFrame:
    return documents.filter((crc(F.col("doc_id")) != 2) & F.col("lang").isNotNull())


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grams, seen, documents = Grams(), np.zeros(FEATURES + 1, np.int64), 0
    for batch in steps(batches):
        for text in texts_of(batch):
            found = grams.counts(text)
            if found is not None:
                seen[found[0]] += 1
                seen[FEATURES] += 1
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_pydict({"feature": pa.array(at, pa.int64()), "n": pa.array(seen[at], pa.int64())})


def inverse_frequencies(documents: DataFrame) -> np.ndarray:
    """Weight of every feature by the number of documents that hold it; the driver gets one count per feature."""
    counted = documents.select("text").mapInArrow(_frequencies, schema="feature bigint, n bigint")
    seen = np.zeros(FEATURES + 1)
    for row in counted.groupBy("feature").agg(F.sum("n").alias("n")).collect():
        seen[row["feature"]] = row["n"]
    return np.log((1 + seen[FEATURES]) / (1 + seen[:FEATURES])) + 1


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grams = Grams()
    for batch in steps(batches):
        found = [grams.counts(text) for text in texts_of(batch)]
        yield pa.RecordBatch.from_pydict(
            {
                "lang": batch.column("lang"),
                "rank": batch.column("rank"),
                "turn": batch.column("turn"),
                "at": pa.array([None if one is None else one[0].astype("<u2").tobytes() for one in found], pa.binary()),
                "n": pa.array([None if one is None else one[1].astype("<u4").tobytes() for one in found], pa.binary()),
            }
        )


def quota(counts: list[int], options: Learning) -> int:
    """The most rows of a language with which all samples together stay within ``sample_rows``."""
    left, sizes = options.sample_rows, sorted(min(count, options.sample_per_language) for count in counts)
    for at, size in enumerate(sizes):
        fair = left // (len(sizes) - at)
        if size > fair:
            return max(1, fair)
        left -= size
    return options.sample_per_language


def sampled(documents: DataFrame, options: Learning) -> list:
    """At most ``sample_rows`` rows of counted features, balanced by language, chosen by a hash of doc_id; ``turn`` is another hash."""
    counted = documents.groupBy("lang").count()
    sizes = counted.orderBy(F.desc("count"), "lang").limit(options.languages).collect()
    if not sizes:
        return []
    if len(sizes) == options.languages and (more := counted.count() - len(sizes)):
        warnings.warn(f"{more} values of lang beyond the {len(sizes)} most frequent are not learned", stacklevel=2)
    most = quota([row["count"] for row in sizes], options)
    shares = [(F.lit(row["lang"]), F.lit(min(1.0, most / row["count"]))) for row in sizes]
    share = F.create_map(*(part for pair in shares for part in pair))[F.col("lang")]
    place, turn = F.xxhash64("doc_id"), F.xxhash64("doc_id", F.lit("turn"))
    part = place / F.lit(2.0**64) + 0.5
    # a few rows above the bound go from the languages that are not taken whole, the same part of each
    rank = F.when(share < 1, part / share).otherwise(0.0)
    chosen = documents.filter(part < share).select("lang", "text", rank.alias("rank"), turn.alias("turn"))
    rows = chosen.mapInArrow(_features, schema="lang string, rank double, turn bigint, at binary, n binary").filter("at is not null")
    return rows.orderBy("rank", "lang", "turn").limit(options.sample_rows).collect()


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    inverse: np.ndarray
    temperature: float = 1.0

    def vector(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        values = (1 + np.log(n)) * self.inverse[at]
        return values / np.sqrt(values @ values)

    def logits(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        return self.weights[:, at] @ self.vector(at, n) + self.bias

    def probabilities(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        return softmax(self.logits(at, n) / self.temperature)


def softmax(logits: np.ndarray) -> np.ndarray:
    raised = np.exp(logits - logits.max())
    return raised / raised.sum()


class Leader:
    """Follow-the-regularised-leader: per-coordinate rates, weights in closed form from the sums."""

    def __init__(self, classes: int, size: int, options: Learning):
        self.sums, self.squares, self.options = np.zeros((classes, size)), np.zeros((classes, size)), options

    def weights(self, at) -> np.ndarray:
        sums, o = self.sums[:, at], self.options
        rate = (o.beta + np.sqrt(self.squares[:, at])) / o.rate + o.l2
        return np.where(np.abs(sums) <= o.l1, 0.0, (np.sign(sums) * o.l1 - sums) / rate)

    def learn(self, at, weights: np.ndarray, gradient: np.ndarray) -> None:
        squares = self.squares[:, at]
        grown = squares + gradient**2
        self.sums[:, at] += gradient - (np.sqrt(grown) - np.sqrt(squares)) / self.options.rate * weights
        self.squares[:, at] = grown


def parted(rows: list, options: Learning) -> tuple[list, list]:
    """The rows held back, ``held_back`` of each language, and those to learn from, in turn: frequent languages are mixed in."""
    rows = sorted(rows, key=lambda row: (row["turn"], row["lang"], row["at"], row["n"]))
    left = Counter(row["lang"] for row in rows)
    if len(rows) <= 4 * len(left):
        return [], rows
    left = {lang: int(n * options.held_back) for lang, n in left.items()}
    held, learned_from = [], []
    for row in rows:
        left[row["lang"]] -= 1
        (held if left[row["lang"]] >= 0 else learned_from).append(row)
    return held, learned_from


def fitted(rows: list, inverse: np.ndarray, options: Learning) -> Model | None:
    """The model of a sample of rows (lang, turn, at, n); None if there is none."""
    languages = sorted({row["lang"] for row in rows})
    if not languages:
        return None
    model = Model(languages, np.zeros((len(languages), FEATURES)), np.zeros(len(languages)), inverse)
    held, examples = (
        [(np.frombuffer(row["at"], "<u2").astype(int), np.frombuffer(row["n"], "<u4"), languages.index(row["lang"])) for row in part]
        for part in parted(rows, options)
    )
    leader = Leader(len(languages), FEATURES + 1, options)
    for _ in range(options.epochs):
        for at, n, label in examples:
            places, values = np.append(at, FEATURES), np.append(model.vector(at, n), 1.0)
            weights = leader.weights(places)
            error = softmax(weights @ values)
            error[label] -= 1
            leader.learn(places, weights, np.outer(error, values))
    weights = leader.weights(slice(None))
    model.weights, model.bias = weights[:, :FEATURES], weights[:, FEATURES]
    if held:
        model.temperature = calibrated([(model.logits(at, n), label) for at, n, label in held])
    return model


def calibrated(scored: list[tuple[np.ndarray, int]]) -> float:
    """The temperature with the least log loss, between 1/16 and 16."""
    def loss(temperature: float) -> float:
        return -sum(np.log(max(softmax(logits / temperature)[label], 1e-300)) for logits, label in scored)

    return min((2.0 ** (power / 8) for power in range(-32, 33)), key=loss)


def _predict(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for batch in steps(batches):
            languages, scores = [], []
            for text in texts_of(batch):
                found = grams.counts(text) if model else None
                if found is None:
                    languages.append(UNKNOWN), scores.append(0.0)
                    continue
                chances = model.probabilities(*found)
                best = int(chances.argmax())
                languages.append(model.languages[best]), scores.append(float(chances[best]))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "held_out": batch.column("held_out"),
                    "lang_pred": pa.array(languages, pa.string()),
                    "score": pa.array(scores, pa.float64()),
                }
            )

    return run


def learned(documents: DataFrame, options: Learning = Learning()) -> Model | None:
    known = learnable(documents.select("doc_id", "text", "lang"))
    rows = sampled(known, options)
    return fitted(rows, inverse_frequencies(known), options) if rows else None


def predicted(documents: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of ``documents`` (doc_id, text)."""
    texts = documents.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(_predict(model), schema=f"doc_id {kind}, held_out boolean, lang_pred string, score double")

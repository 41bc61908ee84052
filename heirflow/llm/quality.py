"""Text quality by supervised subword embeddings.

Every feature of a text has a learned vector: its words, its pairs of neighbouring words (a word that
repeats itself is one feature, whatever the word) and the character n-grams of its words, blank
borders included. Features are hashed into ``BUCKETS`` rows of one table. The text is the average of the
vectors of all its features, counted as often as they occur; a linear layer and softmax turn the average into the
chances of the two labels. Vectors and layer are trained together by stochastic gradient descent.

Training reads a bounded sample of the labelled rows, as many of each label, reduces it to feature
counts and runs in one task, which Spark repeats with the same result if it is lost. Scoring reads every
character of every text: vectors and layer are linear, so the score needs one number of each feature.

Defined cases: a null, empty or blank text has no features and gets the chance of the layer's bias; without labelled
rows every score is 0.5, with rows of one label the model learns that label; a label other than
0 and 1 or null is none; a document that is labelled twice is two examples, each with the least of its texts;
repeated rows get equal scores; an empty table gives an empty result; other columns are ignored or carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heirflow.llm.bytescan import mix

BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
DIMENSIONS = 16
#: Lengths of the character n-grams.
GRAMS = (2, 3, 4)
#: Examples that training looks at, one after another, over as many rounds as that takes.
STEPS = 16_000
RATE = 0.5
#: Most labelled rows that are used for training, half of them of each label.
MAX_TRAINING_ROWS = 2_000
#: Characters that one vectorised step looks at (one text at least).
STEP_CHARACTERS = 1 << 17

_PRIME = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(64 - BUCKET_BITS)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels training never sees: remainder 1 of the CRC of the id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _bucket(code: np.ndarray, kind: int) -> np.ndarray:
    return (mix(code + np.uint64(kind << 56)) >> _SHIFT).astype(np.int64)


def _joined_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, index of the text) of every feature of a few texts."""
    joined = " ".join(["", *texts, ""])
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    blank = (c == 32) | ((c >= 9) & (c <= 13))
    c[blank] = 32
    borders = np.cumsum([1, *[len(t) + 1 for t in texts]])
    owner = np.searchsorted(borders, np.arange(len(c)), "right") - 1
    code, inner = c + np.uint64(1), np.ones(len(c), bool)
    buckets, owners = [], []
    for n in range(2, max(GRAMS) + 1):
        # the n-gram at a place grows by one character; only its ends may be blank
        if n > 2:
            inner = inner[: len(c) - n + 1] & ~blank[n - 2 : len(c) - 1]
        code = mix(code[: len(c) - n + 1] * _PRIME + c[n - 1 :])
        if n in GRAMS:
            good = np.flatnonzero(inner[: len(c) - n + 1] & ~(blank[: len(c) - n + 1] & blank[n - 1 :]) if n == 2 else inner)
            buckets.append(_bucket(code[good], n))
            # an n-gram that begins with the blank before a text belongs to that text
            owners.append(owner[np.minimum(good + 1, len(c) - 1)])
    begin = np.flatnonzero(~blank[1:] & blank[:-1]) + 1
    end = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
    if len(begin):
        # sums of mixed characters at their places, made independent of where the word stands
        power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(c), _PRIME, np.uint64)]))
        inverse = np.uint64(pow(int(_PRIME), -1, 1 << 64))
        back = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(c), inverse, np.uint64)]))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(c + np.uint64(1)) * power[:-1])])
        words = mix((sums[end] - sums[begin]) * back[begin])
        buckets.append(_bucket(words, 1))
        owners.append(owner[begin])
        pair = np.flatnonzero(owner[begin[1:]] == owner[begin[:-1]])
        both = np.where(words[pair] == words[pair + 1], np.uint64(0), words[pair] * _PRIME + words[pair + 1])
        buckets.append(_bucket(both, 0))
        owners.append(owner[begin[pair]])
    return np.concatenate(buckets), np.concatenate(owners)


def features(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """(bucket and text of every feature, first text, number of texts), a few texts at a time."""
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size + len(texts[stop] or "") <= STEP_CHARACTERS):
            size += len(texts[stop] or "")
            stop += 1
        bucket, owner = _joined_features([t or "" for t in texts[at:stop]])
        yield bucket, owner, at, stop - at
        at = stop


@dataclass(frozen=True)
class QualityModel:
    """Vector of every bucket, weights and bias of the two labels."""

    vectors: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def embed(self, texts: list[str | None]) -> np.ndarray:
        """Average vector of each text."""
        out = np.zeros((len(texts), self.vectors.shape[1]))
        for bucket, owner, at, count in features(texts):
            n = np.maximum(np.bincount(owner, minlength=count), 1)
            for d in range(out.shape[1]):
                out[at : at + count, d] = np.bincount(owner, self.vectors[bucket, d], count) / n
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Chance of label 1."""
        margin = self.vectors @ (self.weights[1] - self.weights[0])
        out = np.zeros(len(texts))
        for bucket, owner, at, count in features(texts):
            total = np.bincount(owner, margin[bucket], count)
            out[at : at + count] = total / np.maximum(np.bincount(owner, minlength=count), 1)
        return 1 / (1 + np.exp(-np.clip(out + self.bias[1] - self.bias[0], -500, 500)))


def fit(texts: list[str | None], labels: np.ndarray, steps: int = STEPS, rate: float = RATE) -> QualityModel:
    """Stochastic gradient descent over the texts in a fixed random order, with a falling rate."""
    random = np.random.default_rng(5)
    vectors = random.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS))
    weights, bias = np.zeros((2, DIMENSIONS)), np.zeros(2)
    rows = []
    for bucket, owner, _, count in features(texts):
        order = np.argsort(owner, kind="stable")
        ends = np.cumsum(np.bincount(owner, minlength=count))
        for part in np.split(bucket[order], ends[:-1]):
            found, times = np.unique(part, return_counts=True)
            rows.append((found, times / max(1, len(part))))
    rounds = -(-steps // max(1, len(rows)))
    steps, done = rounds * len(rows), 0
    for _ in range(rounds):
        for i in random.permutation(len(rows)):
            found, share = rows[i]
            hidden = share @ vectors[found]
            logits = weights @ hidden + bias
            chance = np.exp(logits - logits.max())
            chance /= chance.sum()
            chance[labels[i]] -= 1
            step = rate * (1 - done / steps)
            back = chance @ weights
            weights -= step * np.outer(chance, hidden)
            bias -= 0.1 * step * chance
            # the average spreads the gradient thinly over the features, so their rate is that of a feature
            vectors[found] -= step * np.outer(share / np.sqrt(share @ share) if len(share) else share, back)
            done += 1
    return QualityModel(vectors, weights, bias)


def training_sample(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """At most ``max_rows`` examples (text, label) outside the held-out rows, as many of each label.

    The labelled ids with the smallest hashes; only ids and labels are ranked, and about eight times the
    rows wanted at most, so the ranking doesn't grow with the table.
    """
    known = labels.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
    known = known.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    counts = dict(known.groupBy("label").count().collect())
    each = max(1, max_rows // 2)
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / F.lit(float(1 << 53))
    some = F.lit(False)
    for label, count in sorted(counts.items()):
        some |= (F.col("label") == label) & (place <= min(1.0, 8 * each / count))
    order = Window.partitionBy("label").orderBy(place, "doc_id")
    ranked = known.where(some).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= each)
    chosen = [(r[0], r[1]) for r in ranked.select("doc_id", "label").collect()]  # max_rows pairs at most
    wanted = docs.sparkSession.createDataFrame(chosen, "doc_id long, label int")
    ids = sorted({key for key, _ in chosen})
    texts = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isin(ids))
        .groupBy("doc_id").agg(F.min("text").alias("text"))
    )
    return texts.join(F.broadcast(wanted), "doc_id").select("doc_id", "text", "label")


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> QualityModel | None:
    """Model of the bounded sample, fitted in one task; None where nothing is labelled."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b.to_pandas() for b in batches]
        found = pd.concat(parts) if parts else pd.DataFrame({"doc_id": [], "text": [], "label": []})
        if not len(found):
            return
        found = found.sort_values(["doc_id", "label"])
        model = fit(found["text"].tolist(), found["label"].to_numpy(np.int64))
        yield pa.record_batch(
            [pa.array([x.astype("<f4").tobytes()], pa.binary()) for x in (model.vectors, model.weights, model.bias)],
            ["vectors", "weights", "bias"],
        )

    sample = training_sample(docs, labels, max_rows).repartition(1)
    row = sample.mapInArrow(learn, "vectors binary, weights binary, bias binary").first()
    if row is None:
        return None
    vectors, weights, bias = (np.frombuffer(x, "<f4").astype(float) for x in row)
    return QualityModel(vectors.reshape(BUCKETS, DIMENSIONS), weights.reshape(2, DIMENSIONS), bias)


def _scorer(docs: DataFrame, model: QualityModel | None):
    """Function of a text column, with the model shared as one number a bucket."""
    if model is None:
        return lambda texts: np.full(len(texts), 0.5)
    one = np.stack([model.vectors @ (model.weights[1] - model.weights[0])], 1).astype(np.float32)
    small = QualityModel(one, np.array([[0.0], [1.0]]), model.bias)
    shared = docs.sparkSession.sparkContext.broadcast(small)
    return lambda texts: shared.value.score(texts.to_pylist())


def quality_report(docs: DataFrame, model: QualityModel | None) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row; the text alone decides the score."""
    score = _scorer(docs, model)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chance = score(batch["text"])
            yield pa.record_batch(
                [batch["doc_id"], batch["held_out"], pa.array(chance), pa.array(chance >= 0.5).cast(pa.int32())],
                ["doc_id", "held_out", "score", "predicted"],
            )

    given = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return given.mapInArrow(label, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: QualityModel | None, least: float = 0.5) -> DataFrame:
    """All columns of the rows that score ``least`` or more."""
    score, at = _scorer(docs, model), docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(score(batch.column(at)) >= least))

    return docs.mapInArrow(keep, docs.schema)

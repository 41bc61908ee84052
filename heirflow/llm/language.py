"""Language identification in two steps: the family first, then the language within the family.

A text is the frequencies of its hashed byte trigrams (ASCII letters in lower case, runs of other
ASCII bytes as one gap). Linear support vector machines, one against another, vote: first between
families, then between the languages of the winning family, which are closely related. Training
reads a bounded sample of labelled rows; prediction reads every byte of every text.

Defined cases: null texts and texts without a letter get ``und`` with score 0. Where no labelled
row exists, everything is ``und``; with one known language every lettered text gets it. Ties go to
the first language in alphabetical order. Repeated rows get equal predictions.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heirflow.llm.bytescan import steps

#: Families of languages (fixed values); a language that is not listed is a family of its own.
FAMILIES = {
    "da": "germanic", "de": "germanic", "en": "germanic", "nl": "germanic", "no": "germanic", "sv": "germanic",
    "ca": "romance", "es": "romance", "fr": "romance", "it": "romance", "pt": "romance", "ro": "romance",
    "bg": "slavic", "cs": "slavic", "pl": "slavic", "ru": "slavic", "sk": "slavic", "uk": "slavic",
}
UNKNOWN = "und"
BUCKET_BITS = 12
BUCKETS = 1 << BUCKET_BITS
#: Most labelled rows that are used for training, over all languages.
MAX_TRAINING_ROWS = 1_200

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def held_out(doc_id: Column) -> Column:
    """Rows that training never sees: remainder 2 of the CRC of the id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _trigrams(data: np.ndarray) -> np.ndarray:
    """Bucket of the trigram that starts at each byte but the last two."""
    folded = _FOLD[data]
    code = (folded[:-2] << 16) | (folded[1:-1] << 8) | folded[2:]
    return (code * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)


def _counted(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each trigram within one text, text of each, number of trigrams of each text)."""
    sizes = np.diff(offsets)
    grams = np.maximum(sizes - 2, 0)
    if len(data) < 3 or not grams.any():
        return np.zeros(0, np.uint32), np.zeros(0, np.int64), grams
    owner = np.repeat(np.arange(len(sizes)), sizes)
    inside = owner[:-2] == owner[2:]
    return _trigrams(data)[inside], owner[:-2][inside], grams


def features(texts: pa.Array) -> np.ndarray:
    """Root frequencies of the trigram buckets, one row a text; for the training sample."""
    out = np.zeros((len(texts), BUCKETS), np.float32)
    for data, offsets, row in steps(texts):
        bucket, owner, grams = _counted(data, offsets)
        np.add.at(out, (owner + row, bucket), 1)
        out[row : row + len(grams)] /= np.maximum(grams, 1)[:, None]
    return out


def _svm(x: np.ndarray, sign: np.ndarray, cost: float = 10.0, rounds: int = 30) -> np.ndarray:
    """Weights and bias of a linear SVM by dual coordinate descent; the same for the same rows."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    square = np.einsum("ij,ij->i", x, x) + 1e-12
    alpha, w = np.zeros(len(x)), np.zeros(x.shape[1])
    random = np.random.default_rng(11)
    for _ in range(rounds):
        for i in random.permutation(len(x)):
            step = np.clip(alpha[i] + (1 - sign[i] * (x[i] @ w)) / square[i], 0, cost) - alpha[i]
            if step:
                alpha[i] += step
                w += step * sign[i] * x[i]
    return w


@dataclass(frozen=True)
class LanguageModel:
    """Pairs of groups of languages with one separating weight row each, family pairs first."""

    languages: tuple[str, ...]
    families: tuple[str, ...]
    pairs: tuple[tuple[str, str], ...]
    weights: np.ndarray

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Margin of every pair for every text: the weights of its trigrams, averaged."""
        out = np.zeros((len(texts), len(self.pairs)))
        for data, offsets, row in steps(texts):
            bucket, owner, grams = _counted(data, offsets)
            for k, w in enumerate(self.weights):
                total = np.bincount(owner, w[bucket], len(grams)) if len(bucket) else np.zeros(len(grams))
                out[row : row + len(grams), k] = total / np.maximum(grams, 1) + w[-1]
        return out

    def _vote(self, margins: np.ndarray, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Winner (index into ``names``) and its mean probability over the pairs it is in."""
        chance = np.zeros((len(margins), len(names)))
        for k, (a, b) in enumerate(self.pairs):
            if a in names and b in names:
                p = 1 / (1 + np.exp(np.clip(-4 * margins[:, k], -50, 50)))
                chance[:, names.index(a)] += p
                chance[:, names.index(b)] += 1 - p
        chance /= max(1, len(names) - 1)
        if len(names) == 1:
            chance[:] = 1
        best = chance.argmax(1)
        return best, chance[np.arange(len(best)), best]

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        lang = np.full(len(texts), UNKNOWN, object)
        score = np.zeros(len(texts))
        lettered = np.flatnonzero(has_letter(texts))
        if self.languages and len(lettered):
            margins = self.scores(texts)[lettered]
            family, sure = self._vote(margins, list(self.families))
            for f, name in enumerate(self.families):
                mine = np.flatnonzero(family == f)
                inside = [x for x in self.languages if family_of(x) == name]
                best, p = self._vote(margins[mine], inside)
                lang[lettered[mine]] = np.array(inside, object)[best]
                score[lettered[mine]] = sure[mine] * p
        return lang.tolist(), score


def family_of(language: str) -> str:
    return "family " + FAMILIES.get(language, language)


def has_letter(texts: pa.Array) -> np.ndarray:
    """Whether each text holds a letter of any script."""
    out = np.zeros(len(texts), bool)
    for data, offsets, row in steps(texts):
        letters = np.concatenate([[0], np.cumsum((_FOLD[data] > 32) & (data < 128))])
        out[row : row + len(offsets) - 1] = letters[offsets[1:]] > letters[offsets[:-1]]
    for i in np.flatnonzero(~out):
        text = texts[i].as_py()
        out[i] = text is not None and any(map(str.isalpha, text))
    return out


def training_sample(docs: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """At most ``max_rows`` labelled rows (text, lang) outside the held-out ones, as many of each language.

    The rows of a language with small hashes of their ids; ties by id. Only ids and labels are ranked.
    """
    known = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r[0]: r[1] for r in known.groupBy("lang").count().collect()}
    each = max(1, max_rows // max(1, len(counts)))
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / F.lit(float(1 << 53))
    # about 8 times the rows wanted of each language are ranked, so the ranking doesn't grow with the table
    some = F.lit(False)
    for lang, count in sorted(counts.items()):
        some |= (F.col("lang") == lang) & (place <= min(1.0, 8 * each / count))
    order = Window.partitionBy("lang").orderBy(place, "doc_id")
    ranked = known.select("doc_id", "lang").where(some).withColumn("rank", F.row_number().over(order))
    chosen = [r[0] for r in ranked.where(F.col("rank") <= each).select("doc_id").collect()]
    return known.where(F.col("doc_id").isin(chosen)).select("text", "lang").limit(2 * max_rows)


def train(docs: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> LanguageModel:
    """Fit the family and language separators on the bounded sample, in one task; the driver sees only their weights."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(batch["lang"].to_pylist(), features(batch["text"])) for batch in batches]
        if not parts:
            return
        lang = np.array([a for names, _ in parts for a in names], object)
        x = np.concatenate([rows for _, rows in parts])
        order = sorted(range(len(lang)), key=lambda i: (lang[i], x[i].tobytes()))
        model = fit(lang[order], x[order])
        yield pa.record_batch(
            [pa.array([list(model.languages)]), pa.array([[list(pair) for pair in model.pairs]], pa.list_(pa.list_(pa.string()))),
             pa.array([model.weights.astype("<f8").tobytes()], pa.binary())],
            ["languages", "pairs", "weights"],
        )

    schema = "languages array<string>, pairs array<array<string>>, weights binary"
    row = training_sample(docs, max_rows).repartition(1).mapInArrow(learn, schema).first()
    if row is None:
        return LanguageModel((), (), (), np.zeros((0, BUCKETS + 1)))
    families = tuple(sorted({family_of(a) for a in row["languages"]}))
    weights = np.frombuffer(row["weights"], "<f8").reshape(len(row["pairs"]), BUCKETS + 1)
    return LanguageModel(tuple(row["languages"]), families, tuple((a, b) for a, b in row["pairs"]), weights)


def fit(lang: np.ndarray, x: np.ndarray) -> LanguageModel:
    """Separators of the families and of the languages of each family, from labels and features."""
    languages = tuple(sorted(set(lang)))
    families = tuple(sorted({family_of(a) for a in languages}))
    family = np.array([family_of(a) for a in lang], object)
    pairs, weights = [], []
    within = [[a for a in languages if family_of(a) == f] for f in families]
    for names, label in [(families, family)] + [(group, lang) for group in within]:
        for a, b in itertools.combinations(names, 2):
            mine = (label == a) | (label == b)
            pairs.append((a, b))
            weights.append(_svm(x[mine] * np.float32(100), np.where(label[mine] == a, 1.0, -1.0)))
    table = np.array(weights).reshape(len(pairs), BUCKETS + 1)
    table[:, :-1] *= 100
    return LanguageModel(languages, families, tuple(pairs), table)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row; the text alone decides the prediction."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, held_out boolean, lang_pred string, score double"

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = shared.value.predict(batch["text"])
            yield pa.record_batch(
                [batch["doc_id"], batch["held_out"], pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    given = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return given.mapInArrow(label, schema)


def keep_identified(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """All columns of the rows whose language is not ``und``; where nothing was learned, of those with a letter."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if shared.value.languages:
                lang, _ = shared.value.predict(batch["text"])
                known = [x != UNKNOWN for x in lang]
            else:
                known = has_letter(batch["text"])
            yield batch.filter(pa.array(known, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)

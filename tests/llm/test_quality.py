import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from heirflow.llm import quality
from heirflow.llm.queries import op12_quality
from tests.llm.conftest import SCHEMA, prose


def plain_features(text):
    """Features of one text as words, pairs and character n-grams."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    out = Counter(("word", w) for w in words)
    out.update(("pair", None if a == b else (a, b)) for a, b in zip(words, words[1:]))
    for w in words:
        whole = f" {w} "
        out.update(("gram", whole[k : k + n]) for n in quality.GRAMS for k in range(len(whole) - n + 1))
    return out


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(4)
    texts, labels = [], []
    for i in range(300):
        text, good = prose(r, ["en", "de", "fr"][i % 3], r.randint(8, 80)), i % 4 != 0
        if not good:
            text = [text.upper().replace(" ", "!! "), " ".join([text.split()[0]] * 30), text.replace(" ", " | ")][i % 3]
        texts.append((i, text, "en", "src", len(text)))
        labels.append((i, int(good), 0))
    texts += [(900, "", None, None, None), (901, None, None, None, None), (902, " \n", None, None, None), (None, "null id", None, None, None)]
    texts += [texts[7], texts[8], (903, texts[7][1], None, None, None), (904, "x" * 200_000, None, None, None)]
    docs = spark.createDataFrame(texts, SCHEMA).repartition(5)
    given = labels + [(3, None, 0), (900, 7, 0), (None, 1, 0), (5_000, 1, 0)]
    return docs, spark.createDataFrame(given, "doc_id long, quality int, toxic int"), texts, labels


def test_features_against_plain_version():
    texts = ["", "a", "the the  cat\tsat", None, "Ünï x", "\n", "x" * 30, "to \U0001F600 be"]
    names = {}
    for bucket, owner, at, count in quality.features(texts):
        for i in range(count):
            found = sorted(Counter(bucket[owner == i].tolist()).values())
            want = plain_features(texts[at + i])
            assert sum(found) == sum(want.values())
            names[texts[at + i]] = Counter(bucket[owner == i].tolist())
            # buckets are shared by chance only
            assert found == sorted(want.values())
    # the same text has the same features wherever it stands in a step
    for text in texts:
        for bucket, *_ in quality.features([text]):
            assert Counter(bucket.tolist()) == names[text]


def test_held_out_accuracy_and_cases(labelled):
    docs, labels, texts, marks = labelled
    model = quality.train(docs, labels)
    found = quality.quality_report(docs, model).collect()
    assert len(found) == len(texts)
    truth = {key: q for key, q, _ in marks}
    for r in found:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    judged = [(r.predicted, truth[r.doc_id]) for r in found if r.held_out and r.doc_id in truth]
    assert sum(a == b for a, b in judged) / len(judged) > 0.9
    by_id = {r.doc_id: r.score for r in found}
    assert by_id[900] == by_id[901] == by_id[902] and by_id[903] == by_id[7]
    texts_ = ["one two", "ONE!! TWO!!"]
    assert np.allclose(model.score(texts_), 1 / (1 + np.exp(-(model.embed(texts_) @ (model.weights[1] - model.weights[0]) + model.bias[1] - model.bias[0]))))
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in found)


def test_held_out_labels_do_not_matter(labelled):
    from pyspark.sql import functions as F

    docs, labels, *_ = labelled
    other = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert (quality.train(docs, labels).vectors == quality.train(docs, other.repartition(3)).vectors).all()


def test_bound_no_labels_one_label_and_empty(spark, labelled, clashing, no_docs, tmp_path):
    docs, labels, *_ = labelled
    assert quality.training_sample(docs, labels, 20).groupBy("label").count().where("count > 10").count() == 0
    assert quality.train(docs, labels.limit(0)) is None and quality.train(no_docs, labels) is None
    assert {r.score for r in quality.quality_report(docs, None).collect()} == {0.5}
    assert quality.quality_report(no_docs, None).count() == 0
    one = quality.train(docs, labels.where("quality = 1"))
    assert (one.score(["any text", ""]) > 0.5).all()
    path = str(tmp_path)
    clashing.write.parquet(path + "/documents.parquet")
    labels.write.parquet(path + "/labels.parquet")
    assert op12_quality(spark, path).count() == clashing.count()

"""The pipeline's stages one after the other, against plain versions of them."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from heirflow.llm import byte_bpe
from tests.llm import brute
from tests.llm.conftest import SCHEMA


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    unique = {r[0]: r for r in rows if r[0] is not None}
    given = list(unique.values()) + [(None, "no id at all here", "en", None, 3), (None, None, None, None, None)]
    items = [(1, " ".join(unique[30][1].split(" ")[3:18])), (2, "words that nobody wrote in any of these texts at all")]
    spark.createDataFrame(given, SCHEMA).repartition(4).write.parquet(str(root / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(root / "benchmark.parquet"))
    return str(root), given, items


def expected(given, items):
    rows = [r for r in given if r[1] and any(map(str.isalpha, r[1]))]
    joined, sets = brute.Sets(), [brute.shingles(r[1], 5) for r in rows]
    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                joined.join(i, j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(joined.find(i), []).append(r)
    rows = [min(g, key=lambda r: brute.BIG if r[0] is None else r[0]) for g in groups.values()]
    marks = brute.leaks([(r[0], r[1]) for r in rows], items, 10)
    rows = [r for r, m in zip(rows, marks) if not m[5]]
    coder, out = byte_bpe.encoding(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), Counter()
    names = [name for name, _ in brute.PATTERNS] + ["term"]
    for r, terms in zip(rows, brute.term_spans([(r[0], r[1]) for r in rows])):
        text, end, parts = r[1], 0, []
        for a, kind, b in sorted(brute.personal(text) + terms):
            if a >= end:
                parts += [text[end:a], f"[{names[kind].upper()}]"]
            end = max(end, b)
        text = "".join([*parts, text[end:]])
        ids = coder.encode_ordinary(text)
        digest = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        out[r[0], len(ids), digest, hashlib.sha256(text.encode()).hexdigest()] += 1
    return out


def test_run(spark, folder):
    root, given, items = folder
    found = corpus_pipeline.run(spark, root)
    assert Counter(map(tuple, found.collect())) == expected(given, items)


def test_stages_keep_the_columns_of_documents(spark, folder):
    root, given, _ = folder
    docs = spark.read.parquet(f"{root}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard", "decontamination", "personal_data", "byte_bpe"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, root).schema.simpleString() == docs.schema.simpleString()
        assert stage(spark, docs.limit(0), root).count() == 0
    masked = corpus_pipeline.personal_data(spark, docs, root)
    assert masked.count() == len(given)
    assert masked.where("n_chars IS NOT NULL AND text IS NOT NULL AND n_chars <> char_length(text)").count() == 0

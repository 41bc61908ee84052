import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from heirflow.llm import byte_bpe

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def expected(rows):
    coder = byte_bpe.encoding(RANKS)
    out = Counter()
    for r in rows:
        ids = coder.encode_ordinary(r[1] or "")
        packed = np.array(ids, "<u4").tobytes()
        out[r[0], len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("chunk, overlap", [(1 << 16, 1 << 11), (97, 40), (300, 60)])
def test_chunks_give_whole_text_ids(docs, rows, chunk, overlap):
    found = byte_bpe.bpe_report(docs, RANKS, chunk, overlap).collect()
    assert Counter(map(tuple, found)) == expected(rows)


def test_columns_round_trip(docs):
    from pyspark.sql import functions as F

    ids = byte_bpe.encode_column(F.col("text"), RANKS)
    back = docs.select("text", byte_bpe.decode_column(ids, RANKS).alias("bytes"))
    assert all(bytes(r.bytes) == (r.text or "").encode() for r in back.collect())


def test_cuts_and_empty(no_docs, clashing):
    assert byte_bpe.cut_points([(1, [90, 95, 101], []), (0, [0, 4], [93, 95, 101]), (2, [205], [])]) == [0, 95]
    assert byte_bpe.bpe_report(no_docs, RANKS).count() == 0
    assert byte_bpe.bpe_report(clashing, RANKS).count() == clashing.count()

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from heirflow.llm import periodic
from heirflow.llm.queries import op11_periodic_runs


def plain_runs(x, exponent=4, least_length=6):
    """All stretches that agree with themselves some words on, the smallest period of each."""
    out, seen = [], set()
    for q in range(1, len(x) // exponent + 1):
        i = 0
        while i < len(x) - q:
            j = i
            while j < len(x) - q and x[j] == x[j + q]:
                j += 1
            if j > i and j - i + q >= max(least_length, exponent * q) and (i, j + q) not in seen:
                seen.add((i, j + q))
                out.append((i, j - i + q, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_report(key, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = 1 if key is None else zlib.crc32(str(key).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {i for a, length, q in runs for i in range(a + q, a + length)}
    best = sorted(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))[:1]
    first = (*best[0], 1000 * best[0][1] // best[0][2]) if best else (None,) * 4
    return (
        key, len(runs), *first, hashlib.sha256("".join("%d,%d,%d\n" % r for r in runs).encode()).hexdigest(),
        hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest(),
    )


def pieces(random_, letters):
    x = []
    for _ in range(random_.randint(0, 4)):
        unit = [random_.randrange(letters) for _ in range(random_.randint(1, 30))]
        times = random_.randint(1, 9)
        x += (unit * (times + 1))[: len(unit) * times + random_.randint(0, len(unit))]
        x += [random_.randrange(letters) for _ in range(random_.randint(0, 4))]
    return x


@pytest.mark.parametrize("chunk", [7, 64, 1 << 15])
@pytest.mark.parametrize("exponent, least", [(4, 6), (2, 1), (3, 6)])
def test_catchers_against_brute_force(monkeypatch, chunk, exponent, least):
    monkeypatch.setattr(periodic, "CHUNK_WORDS", chunk)
    r = random.Random(chunk + exponent)
    for _ in range(120):
        docs = [pieces(r, r.choice([1, 2, 3, 20])) for _ in range(r.randint(1, 4))]
        found = periodic.find_runs([np.array(d, np.int64) for d in docs], exponent, least)
        assert found == [plain_runs(d, exponent, least) for d in docs]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=90), st.integers(1, 20))
def test_reports_as_words_come(words, step):
    """Whatever is appended at once, the runs are the same; one that ended long ago is already reported."""
    catcher = periodic.SquareCatcher(len(words), 2, 2)
    found = []
    for k in range(0, len(words), step):
        found += catcher.append(np.array(words[k : k + step]))
        ended = [r for r in plain_runs(words, 2, 2) if r[0] + r[1] + 8 * r[2] + 8 < k]
        assert set(ended) <= set(found)
    assert sorted(found + catcher.finish(), key=lambda r: (r[0], r[2])) == plain_runs(words, 2, 2)


def test_long_texts_in_bounded_work():
    n = 300_000
    assert periodic.find_runs([np.zeros(n, np.int64)]) == [[(0, n, 1)]]
    assert periodic.find_runs([np.arange(n) % 70_001]) == [[(0, n, 70_001)]]
    assert len(periodic.find_runs([np.arange(n) % 19 % 2 + 5 * (np.arange(n) % 19 == 18)])[0]) == 1 + -(-n // 19) - (n % 19 < 8)


def test_report(spark, docs, rows, clashing, no_docs, tmp_path):
    found = periodic.run_report(docs).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[7])
    assert sorted(map(tuple, found), key=key) == sorted((plain_report(r[0], r[1]) for r in rows), key=key)
    assert any(r.n_runs for r in found)
    assert periodic.run_report(no_docs).count() == 0
    path = str(tmp_path)
    clashing.write.parquet(path + "/documents.parquet")
    assert op11_periodic_runs(spark, path).count() == clashing.count()


def test_own_interface(spark, docs, clashing, no_docs):
    text = "x " + "a b c " * 5 + "y\n" + "z " * 7
    df = spark.createDataFrame([(1, text), (2, "a  b\n"), (3, None), (1, text)], "doc_id long, text string")
    runs = {r.doc_id: [tuple(x) for x in r.runs] for r in periodic.with_runs(df).collect()}
    assert runs == {1: [(1, 15, 3), (17, 7, 1)], 2: [], 3: []}
    short = sorted(((r.doc_id, r.text) for r in periodic.collapse_runs(df).collect()), key=str)
    assert short == [(1, "x a b c y z"), (1, "x a b c y z"), (2, "a  b\n"), (3, None)]
    for given_ in (clashing, no_docs):
        assert periodic.collapse_runs(given_).schema == given_.schema and periodic.collapse_runs(given_).count() == given_.count()

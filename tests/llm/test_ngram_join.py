import random
from collections import Counter

import numpy as np
import pytest

from heirflow.llm import graphs, ngram_join
from tests.llm import brute


@pytest.mark.parametrize("percent", [60, 80, 90, 100])
def test_similar_sets_share_a_signature(percent):
    random_ = np.random.default_rng(percent)
    for n in [1, 2, 3, 5, 9, 10, 20, 33, 100, 400]:
        for _ in range(20):
            a = np.unique(random_.integers(0, 1 << 62, n).astype(np.uint64))
            for lost in range(len(a) + 1):
                b = a[lost:]
                if len(b) and 100 * len(b) >= percent * len(a):
                    assert keys(a, percent) & keys(b, percent)
                else:
                    break
            extra = np.unique(random_.integers(0, 1 << 62, max(1, n // 12)).astype(np.uint64))
            c = np.union1d(a[len(extra) :], extra)
            both = len(np.intersect1d(a, c))
            if 100 * both >= percent * (len(a) + len(c) - both):
                assert keys(a, percent) & keys(c, percent)


def keys(elements, percent):
    table = ngram_join.bands(percent, 2 * len(elements) + 2)
    band = next(i for i, (_, high) in enumerate(table) if len(elements) <= high)
    return {
        s for i in (band, band + 1) for s in ngram_join._signatures(elements, i, table[i][1], percent).tolist()
    }


@pytest.mark.parametrize("size, percent", [(3, 90), (5, 80), (1, 60), (2, 100)])
def test_report_against_brute_force(docs, rows, size, percent):
    want, kept = brute.jaccard([(r[0], r[1]) for r in rows], size, percent)
    assert Counter(map(tuple, ngram_join.jaccard_report(docs, size, percent).collect())) == want
    result = ngram_join.keep_one(docs, size, percent)
    assert result.columns == docs.columns and result.count() == kept


def test_groups_of_near_copies(spark):
    """Chains of copies whose ends aren't similar, around a base that isn't the first."""
    r = random.Random(9)
    base = [f"w{r.randint(0, 10**6)}" for _ in range(150)]
    given = []
    for i in range(60):
        words = list(base)
        for _ in range(r.choice([0, 1, 1, 2, 4, 8])):
            words[r.randrange(len(words))] = f"x{r.randint(0, 10**6)}"
        given.append((i, " ".join(words)))
    chain = [f"c{k}" for k in range(100)]
    for i in range(40):
        given.append((100 + i, " ".join(chain)))
        chain[r.randrange(100)] = f"d{i}"
    df = spark.createDataFrame(given, "doc_id long, text string").repartition(6)
    for size, percent in ((3, 90), (5, 80)):
        want, _ = brute.jaccard(given, size, percent)
        assert Counter(map(tuple, ngram_join.jaccard_report(df, size, percent).collect())) == want


def test_sketch_bounds_the_difference():
    random_ = np.random.default_rng(2)
    a = np.unique(random_.integers(0, 1 << 62, 300).astype(np.uint64))
    b = np.union1d(a[20:], random_.integers(0, 1 << 62, 5).astype(np.uint64))
    words = ngram_join.sketch_words(300, 80)
    differ = ngram_join._sketch(a, words) ^ ngram_join._sketch(b, words)
    assert sum(bin(int(x) & (1 << 64) - 1).count("1") for x in differ) <= len(np.setxor1d(a, b))


def test_empty_and_clashing(no_docs, clashing):
    assert ngram_join.jaccard_report(no_docs).count() == 0
    assert ngram_join.keep_one(no_docs).count() == 0
    assert ngram_join.keep_one(clashing).columns == clashing.columns
    assert ngram_join.jaccard_report(clashing).count() == clashing.count()


def test_components_and_filter(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 101), (7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    found = {r.node: r.label for r in graphs.components(df).collect()}
    assert found == {**{i: 0 for i in range(41)}, 90: 90, 100: 90, 101: 90}
    assert graphs.components(df.limit(0)).count() == 0
    keys = spark.range(0, 3000, 3).selectExpr("xxhash64(id) AS k")
    rows = spark.range(3000).selectExpr("id", "xxhash64(id) AS k")
    inside = graphs.probably_in(rows, "k", keys)
    assert inside.where("id % 3 = 0").count() == 1000 and inside.count() < 1300
    assert graphs.maybe_in(rows, "k", keys).where("maybe").count() == inside.count()
    assert graphs.probably_in(rows, "k", keys.limit(0)).count() == 0


def test_sets_of_one_short_reference(monkeypatch, spark):
    """Links are whole however few bits of the identity travel with the signatures."""
    monkeypatch.setattr(ngram_join, "REF_BITS", 4)
    r = random.Random(12)
    given = []
    for i in range(60):
        words = [f"w{r.randint(0, 10**6)}" for _ in range(60)]
        given += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words, "end"]))]
    df = spark.createDataFrame(given, "doc_id long, text string").repartition(2)
    found = {x.doc_id: x.component_id for x in ngram_join.jaccard_report(df, 3, 90).collect()}
    assert found == {i: i - i % 2 for i in range(120)}


def test_hot_keys_are_joined_apart(spark):
    left = spark.createDataFrame([(i, 7 if i % 3 else i) for i in range(6_000)] + [(-1, None)], "x long, k long").repartition(4)
    right = spark.createDataFrame([(i, f"v{i}") for i in range(0, 9_000, 2)] + [(7, "hot")], "k long, v string")
    found = {(r.x, r.k): r.v for r in graphs.spread_join(left, right, "k").collect()}
    assert len(found) == 6_001
    assert all(v == ("hot" if k == 7 else f"v{k}" if k is not None and k % 2 == 0 else None) for (_, k), v in found.items())

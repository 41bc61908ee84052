from collections import Counter

import numpy as np
import pytest

from heirflow.llm import suffixes
from tests.llm import brute


@pytest.mark.parametrize("letters, size, shallow", [(2, 400, 16), (3, 2_000, 8), (26, 500, 32)])
def test_suffixes_are_ordered_and_classed(letters, size, shallow):
    random = np.random.default_rng(size)
    data = random.integers(97, 97 + letters, size).astype(np.uint8)
    data[size // 2 : size // 2 + 150] = data[:150]
    length = 48
    starts = random.permutation(size - length)
    order, classes = suffixes.sorted_suffixes(data, starts, length, shallow)
    found = [data[s : s + length].tobytes() for s in starts[order]]
    assert found == sorted(found)
    assert [a == b for a, b in zip(classes, classes[1:])] == [a == b for a, b in zip(found, found[1:])]


def test_blind_trie_orders_and_merges():
    random = np.random.default_rng(5)
    texts = [bytes(random.integers(97, 99, 12).astype(np.uint8)) for _ in range(300)]
    trie = suffixes.BlindTrie(texts[0], 0)
    for k, text in enumerate(texts[1:], 1):
        trie.insert(text, k)
    leaves = list(trie.leaves())
    assert [texts[v[0]] for v in leaves] == sorted(set(texts))
    assert all(len({texts[i] for i in v}) == 1 for v in leaves)


def check(found, rows, length=100):
    hashes = {r[1]: r[0] for r in found_hashes(rows)}
    ordered = sorted(
        ((suffixes.NO_ID if i is None else i, (t or "").encode()) for i, t in rows),
        key=lambda r: (r[0], hashes.get(r[1], 0), r[1]),
    )
    want = brute.removal(ordered, length)
    expected = Counter((i, *want[suffixes.NO_ID if i is None else i, (t or "").encode()]) for i, t in rows)
    assert Counter(map(tuple, found)) == expected


def found_hashes(rows):
    """The hash that orders texts of one id, as Spark computes it."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    texts = sorted({t for _, t in rows if t is not None})
    df = spark.createDataFrame([(t,) for t in texts], "text string").select(suffixes.text_hash().alias("h"), "text")
    return [(r.h, r.text.encode()) for r in df.collect()]


def test_report_against_brute_force(docs, rows):
    given = [(r[0], r[1]) for r in rows]
    check(suffixes.removal_report(docs).collect(), given)


def test_periodic_and_overlapping_repeats(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "CHUNK_STARTS", 50)
    unit = "".join(chr(97 + k % 7 + k % 5) for k in range(140))
    given = [
        (3, "ab" * 200), (1, "ab" * 90 + "x"), (2, "a" * 99), (4, "a" * 100), (5, "a" * 100), (6, unit + "q" + unit),
        (7, "z" + unit[:120] + "é" + unit[5:]), (8, unit[:99]), (9, unit * 3), (0, "q" * 300),
    ]
    df = spark.createDataFrame(given, "doc_id long, text string").repartition(4)
    check(suffixes.removal_report(df).collect(), given)
    small = [(i, t[:40]) for i, t in given]
    df = spark.createDataFrame(small, "doc_id long, text string").repartition(3)
    check(suffixes.removal_report(df, 20, 8).collect(), small, 20)


def test_hot_passage_is_split(spark, monkeypatch):
    """A passage with other text around it in most documents: no task sorts all starts of one anchor."""
    monkeypatch.setattr(suffixes, "CHUNK_STARTS", 300)
    random = np.random.default_rng(8)
    text = lambda n: "".join(map(chr, random.integers(97, 123, n)))
    passage = text(300)
    given = [(i, f"{text(60 + i % 9)}{passage[i % 4 :]}{text(70)}") for i in range(60)] + [(3, passage), (70, text(200)), (None, passage)]
    df = spark.createDataFrame(given, "doc_id long, text string").repartition(6)
    check(suffixes.removal_report(df).collect(), given)
    undecided = suffixes.judged_runs(df, 100, suffixes.GRAM).where("NOT known").select("gram", "id", "spot").localCheckpoint()
    hot = suffixes.hot_grams(undecided, 300)
    bodies = suffixes.stretches(df, undecided, 100)
    dealt = suffixes.split_hot(bodies, hot, 100, 300).where("body IS NOT NULL").groupBy("gram").agg({"spot": "count"})
    most = undecided.groupBy("gram").agg({"spot": "count"}).selectExpr("max(`count(spot)`)").first()[0]
    assert hot and most > 30 and dealt.selectExpr("max(`count(spot)`)").first()[0] <= 25


def test_empty_and_clashing(no_docs, clashing):
    assert suffixes.removal_report(no_docs).count() == 0
    assert suffixes.removal_report(clashing).count() == clashing.count()

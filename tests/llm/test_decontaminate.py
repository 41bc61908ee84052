from collections import Counter

import pytest

from heirflow.llm import decontaminate
from tests.llm import brute

SCHEMA = "item_id long, text string"


@pytest.fixture(scope="module")
def items(rows):
    texts = [r[1] for r in rows if r[1]]
    words = texts[30].split(" ")
    out = [(1, " ".join(words[2:20])), (2, "the And, ING"), (3, ""), (4, None), (5, texts[7].upper()), (6, "...")]
    out += [(7, "unrelated words that nobody wrote in any of these texts at all"), (None, texts[41]), (1, " ".join(words[2:20]))]
    return out + [(10, texts[30]), (11, "Ünï Ç漢字"), (12, "ünï ç漢字")]


@pytest.mark.parametrize("window", [1, 3, 10])
def test_report_against_brute_force(spark, docs, rows, items, window):
    bench = spark.createDataFrame(items, SCHEMA)
    want = Counter(brute.leaks([(r[0], r[1]) for r in rows], items, window))
    assert Counter(map(tuple, decontaminate.leak_report(docs, bench, window).collect())) == want


@pytest.mark.parametrize("bound", ["MAX_WINDOWS", "MAX_BYTES"])
def test_large_benchmark_is_not_broadcast(spark, docs, rows, items, monkeypatch, bound):
    bench = spark.createDataFrame(items, SCHEMA)
    monkeypatch.setattr(decontaminate, bound, 3)
    want = Counter(brute.leaks([(r[0], r[1]) for r in rows], items, 10))
    assert Counter(map(tuple, decontaminate.leak_report(docs, bench).collect())) == want


def test_native_plan(spark, docs, items):
    bench = spark.createDataFrame(items, SCHEMA)
    plan = decontaminate.leak_report(docs, bench)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_documents_and_spans_go(spark, docs, rows, items, clashing):
    bench = spark.createDataFrame(items, SCHEMA)
    marks = brute.leaks([(r[0], r[1]) for r in rows], items, 10)
    clean = decontaminate.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns
    assert Counter(r.doc_id for r in clean.collect()) == Counter(m[0] for m in marks if not m[5])
    cut = decontaminate.cut_contaminated(docs, bench)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    again = {r.doc_id: r.n_words for r in decontaminate.leak_report(cut, bench).collect()}
    for key, n, hit, *_ in marks:
        if key is not None and key != 5:
            assert again[key] == n - hit
    assert decontaminate.drop_contaminated(clashing, bench).columns == clashing.columns


def test_empty(spark, docs, no_docs, items):
    bench = spark.createDataFrame(items, SCHEMA)
    assert decontaminate.leak_report(no_docs, bench).count() == 0
    nothing = decontaminate.leak_report(docs, bench.limit(0))
    assert nothing.count() == docs.count() and nothing.where("contaminated").count() == 0

import numpy as np
import pytest

from heirflow.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int"


def cluster(random, size, noise, n, length=32):
    base = random.standard_normal(length)
    return [(base + noise * random.standard_normal(length)).astype(np.float32).tolist() for _ in range(n)]


@pytest.fixture(scope="module")
def given():
    random = np.random.default_rng(4)
    out = [random.standard_normal(32).astype(np.float32).tolist() for _ in range(300)]
    for _ in range(20):
        out += cluster(random, 32, 0.15, 2)
    out += cluster(random, 32, 0.1, 150) + cluster(random, 32, 0.3, 60)
    out += [out[0], out[0], [2 * x for x in out[0]]]
    return [(i, v, 0) for i, v in enumerate(out)]


def plain(rows):
    units = []
    for _, v, _ in rows:
        ok = v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
        units.append(np.array(v, float) / np.linalg.norm(v) if ok else None)
    n = len(rows)
    near = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            if i != j and units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]):
                near[i, j] = units[i] @ units[j] >= 0.9
    return near


def test_recall_and_no_false_link(spark, given):
    near = plain(given)
    found = {r.vec_id: r for r in vectors.vector_report(spark.createDataFrame(given, SCHEMA).repartition(5)).collect()}
    counts = np.array([found[i].n_links for i in range(len(given))])
    assert (counts <= near.sum(1)).all()
    assert counts.sum() >= 0.97 * near.sum()
    for i in range(len(given)):
        assert found[i].component_id <= i and found[i].kept == (found[i].component_id == i)
        assert (found[i].n_links == 0) == (i == found[i].component_id and not any(r.component_id == i for k, r in found.items() if k != i))


def test_small_windows_and_blocks_count_all_links(spark, given):
    """Dense groups are counted whole although a window sees few of their pairs."""
    scaled = vectors.units(spark.createDataFrame(given[300:], SCHEMA).repartition(3))
    from heirflow.llm.graphs import components
    from heirflow.llm.tables import stored

    links = stored(vectors.window_links(scaled, 0.9, 16, 4, block=16), "t")
    labels = components(links).selectExpr("node AS row", "label")
    counted = {r.row: r.n for r in vectors.member_counts(scaled, labels, 0.9, block=16).collect()}
    ids = {r.row: r.vec_id - 300 for r in scaled.collect()}
    near, group = plain(given[300:]), {ids[r.row]: r.label for r in labels.collect()}
    for row, n in counted.items():
        i = ids[row]
        assert n == sum(near[i, j] for j in group if group[j] == group[i])


@pytest.mark.parametrize("passes, window", [(1, 1), (16, 2)])
def test_links_that_no_window_saw(spark, passes, window):
    """Pairs in a dense topic, few passes and small windows: all links, components and copies are found."""
    random = np.random.default_rng(9)
    topic = 1.8 * random.standard_normal(32)
    rows = []
    for _ in range(250):
        base = topic + random.standard_normal(32)
        rows += [(base + 0.35 * random.standard_normal(32)).tolist() for _ in range(2)]
    rows += [random.standard_normal(16).tolist() for _ in range(20)]
    rows = [(i, v, 0) for i, v in enumerate(rows)]
    near = plain(rows)
    found = {r.vec_id: r for r in vectors.vector_report(spark.createDataFrame(rows, SCHEMA).repartition(5), passes=passes, window=window).collect()}
    assert [found[i].n_links for i in range(len(rows))] == near.sum(1).tolist() and near.sum() > 200
    least = list(range(len(rows)))
    for _ in rows:
        least = [min([least[i], *(least[j] for j in np.flatnonzero(near[i]))]) for i in range(len(rows))]
    assert [found[i].component_id for i in range(len(rows))] == least
    scaled = vectors.units(spark.createDataFrame(rows, SCHEMA).repartition(3))
    none = spark.createDataFrame([], "row long, label long")
    small = vectors.missed_links(scaled, none, 0.9, pack=7, packs=3).collect()
    ids = {r.row: r.vec_id for r in scaled.collect()}
    assert all(near[ids[r.a], ids[r.b]] for r in small) and len({x for r in small for x in r}) == (near.sum(1) > 0).sum()


def test_odd_vectors(spark):
    a = [1.0, 2.0, 3.0]
    odd = [
        (1, None, 0), (2, [], 0), (3, [0.0, 0.0, 0.0], 0), (4, [1.0, None, 3.0], 0), (5, [1.0, float("nan"), 1.0], 0),
        (6, [float("inf"), 1.0, 1.0], 0), (7, a, 0), (8, a, 1), (9, a + [0.0], 0), (10, [1e-30, 2e-30, 3e-30], 0),
        (11, [-x for x in a], 0), (7, a, 0), (None, a, 0), (None, [5.0, -1.0, 0.0], 0),
    ]
    found = sorted(map(tuple, vectors.vector_report(spark.createDataFrame(odd, SCHEMA)).collect()), key=str)
    linked = [(7, 4, 7, True), (7, 4, 7, True), (8, 4, 7, False), (10, 4, 7, False), (None, 4, 7, False)]
    alone = [(i, 0, i, True) for i in (1, 2, 3, 4, 5, 6, 9, 11)] + [(None, 0, None, True)]
    assert found == sorted(linked + alone, key=str)
    assert vectors.vector_report(spark.createDataFrame([], SCHEMA)).count() == 0

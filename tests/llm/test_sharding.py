import zlib
from collections import Counter, defaultdict

import numpy as np

from heirflow.llm import sharding


def plain_jump(key, shards):
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_is_that_of_plain_integers():
    keys = np.array([0, 1, -1, 7, 1 << 62, 123456789], np.int64)
    for shards in (1, 2, 8, 9, 1000):
        assert sharding.jump(keys.view(np.uint64), shards).tolist() == [plain_jump(int(k), shards) for k in keys]


def test_report(docs, rows):
    found = sharding.shard_report(docs).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == Counter(
        (r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows
    )
    slots = defaultdict(list)
    for r in found:
        assert r.law == "key" and r.shard == plain_jump(-1 if r.doc_id is None else r.doc_id, 8)
        assert r.grown_shard in (r.shard, 8) and r.grown_shard == plain_jump(-1 if r.doc_id is None else r.doc_id, 9)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_many_buckets_clashing_names_and_empty(docs, no_docs, clashing, monkeypatch, spark, tmp_path):
    monkeypatch.setattr(sharding, "ROWS_PER_BUCKET", 3)
    slots = defaultdict(list)
    for r in sharding.shard_documents(clashing).collect():
        slots[r.shard].append(r.slot)
    assert sum(map(len, slots.values())) == docs.count()
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(sharding.shard_documents(clashing).columns) == {*clashing.columns, "grown_shard"}
    assert sharding.shard_report(no_docs).count() == 0
    sharding.write_shards(docs, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == docs.count()

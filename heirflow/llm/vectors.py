"""Near-duplicate vectors by sorted projection passes.

Each pass draws fresh random hyperplanes, orders the vectors lexicographically by their concatenated
sign bits and compares every vector with the next ``window`` in that order; a cosine of ``threshold``
or more, in double precision, is a link. The union of the passes gives components.

A window bounds what a pass compares, so a large or dense table holds links that no pass has seen. All
blocks of ``BLOCK`` vectors are therefore multiplied with each other once, and components that a link joins
become one: the passes only save rows, no link is missed. Only joins of components leave a task, a
spanning tree for each pair of blocks. This takes time with the square of the number of vectors.

Links are counted within components: each component is compared within itself. Members within half the threshold's angle
of the component's mean direction all link with each other and are counted, not compared; the others
are compared in blocks with every member, and only counts leave a task.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with
nothing and are their own component; vectors of different lengths don't link; equal vectors link;
rows of equal ``vec_id`` are rows of their own with one id; a null ``vec_id`` is larger than all
others and stays null where nothing else is linked; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heirflow.llm.graphs import components
from heirflow.llm.tables import stored

THRESHOLD = 0.9
PASSES = 16
WINDOW = 16
CODE_BITS = 62
#: Vectors that one task compares at once.
BLOCK = 512
#: Vectors in a packed block, and blocks in a partition, of the comparison of all with all.
PACK, PACKS = 1024, 8
NO_ID = (1 << 63) - 1


def unit_rows(values: list) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors in double precision, whether each can link) of vectors of one length."""
    rows = np.array([[np.nan if x is None else x for x in v] for v in values], np.float64)
    good = np.isfinite(rows).all(1)
    rows[~good] = 0
    top = np.abs(rows).max(1)
    good &= top > 0
    rows /= np.where(top > 0, top, 1)[:, None]
    rows /= np.where(good, np.sqrt((rows * rows).sum(1)), 1)[:, None]
    return rows, good


def planes(number: int, size: int) -> np.ndarray:
    """Hyperplanes of one pass; the same on every executor."""
    return np.random.default_rng([7, number, size]).standard_normal((size, CODE_BITS))


def units(vectors: DataFrame) -> DataFrame:
    """``row, vec_id, size, unit`` with unique row numbers and packed doubles, null where nothing can link; stored."""

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = [v or [] for v in batch["embedding"].to_pylist()]
            sizes = np.array([len(v) for v in given], np.int32)
            packed: list[bytes | None] = [None] * len(given)
            for size in np.unique(sizes[sizes > 0]):
                mine = np.flatnonzero(sizes == size)
                rows, good = unit_rows([given[i] for i in mine])
                for i, row in zip(mine[good], rows[good]):
                    packed[i] = row.tobytes()
            yield pa.record_batch(
                [batch["row"], batch["vec_id"], pa.array(sizes), pa.array(packed, pa.binary())], ["row", "vec_id", "size", "unit"]
            )

    given = vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return stored(given.mapInArrow(scale, "row long, vec_id long, size int, unit binary"), "vectors")


def _codes(scaled: DataFrame, passes: int) -> DataFrame:
    """``pass, size, code, row`` of every vector that can link, for every pass."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(CODE_BITS - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            rows, sizes = batch["row"].to_numpy(), batch["size"].to_numpy()
            packed = batch["unit"].to_pylist()
            for size in np.unique(sizes):
                mine = np.flatnonzero(sizes == size)
                stack = np.array([np.frombuffer(packed[i]) for i in mine])
                for number in range(passes):
                    codes = ((stack @ planes(number, int(size))) > 0).astype(np.int64) @ weights
                    yield pa.record_batch(
                        [pa.array(np.full(len(mine), number, np.int32)), pa.array(np.full(len(mine), size, np.int32)),
                         pa.array(codes), pa.array(rows[mine])],
                        ["pass", "size", "code", "row"],
                    )

    return scaled.where("unit IS NOT NULL").select("row", "size", "unit").mapInArrow(code, "pass int, size int, code long, row long")


def window_links(scaled: DataFrame, threshold: float, passes: int, window: int, block: int = BLOCK) -> DataFrame:
    """Distinct verified pairs ``a < b`` of rows within ``window`` places of each other in some pass.

    Only codes are sorted; the sizes of the sorted parts give every row its place in the whole order.
    Places are cut into blocks, each with the first ``window`` places of the next one as guests.
    """
    ordered = _codes(scaled, passes).repartitionByRange("pass", "size", "code", "row").sortWithinPartitions("pass", "size", "code", "row")
    ordered = stored(ordered.withColumn("at", F.monotonically_increasing_id()), "passes")
    ordered = ordered.withColumn("part", F.shiftright("at", 33).cast("int"))
    sizes = dict(ordered.groupBy("part").count().collect())
    parts = sorted(sizes)
    base = F.create_map(*[F.lit(x) for p in zip(parts, accumulate([0, *(sizes[p] for p in parts)])) for x in p]) if parts else F.lit(None)
    place = F.try_element_at(base, "part") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) if parts else F.lit(0)
    placed = ordered.withColumn("place", place.cast("long"))
    home = F.floor(F.col("place") / block)
    blocks = F.when(
        (F.col("place") % block < window) & (home > 0), F.array(home, home - 1)
    ).otherwise(F.array(home))
    spread = placed.select("pass", "row", "place", F.explode(blocks).alias("block"))
    filled = spread.join(scaled.select("row", "unit"), "row")

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        number, rows = table["pass"].to_numpy(), table["row"].to_numpy()
        packed = table["unit"].to_pylist()
        lengths = np.array([len(b) for b in packed])
        width = lengths.max()
        stack = np.array([np.frombuffer(b.ljust(width, b"\0")) for b in packed])
        left, right = [], []
        for step in range(1, min(window, len(rows) - 1) + 1):
            near = (stack[:-step] * stack[step:]).sum(1) >= threshold
            near &= (number[:-step] == number[step:]) & (lengths[:-step] == lengths[step:])
            left.append(rows[:-step][near])
            right.append(rows[step:][near])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        return pa.table([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

    return filled.groupBy("block").applyInArrow(compare, "a long, b long").distinct()


def _spanning(pairs: np.ndarray) -> np.ndarray:
    """Those of the pairs of labels that join what the ones before left apart."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := above.get(x, x)) != x:
            above[x] = x = above.get(up, up)
        return x

    kept = []
    for x, y in pairs.tolist():
        a, b = top(x), top(y)
        if a != b:
            above[max(a, b)] = min(a, b)
            kept.append((x, y))
    return np.array(kept, np.int64).reshape(-1, 2)


def missed_links(scaled: DataFrame, labels: DataFrame, threshold: float, pack: int = PACK, packs: int = PACKS) -> DataFrame:
    """``a, b``: labels of components that a link joins; a vector outside of all has its row as label.

    Every block of vectors meets every other one, single precision finds what may be a link, double
    precision decides.
    """
    labelled = scaled.where("unit IS NOT NULL").join(labels, "row", "left").select("size", F.coalesce("label", "row").alias("label"), "unit")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, bytes]]] = {}

        def out(size: int) -> pa.RecordBatch:
            own, packed = zip(*held.pop(size))
            columns = [pa.array([size], pa.int32()), pa.array([np.array(own, np.int64).tobytes()], pa.binary()), pa.array([b"".join(packed)], pa.binary())]
            return pa.record_batch(columns, ["size", "labels", "units"])

        for batch in batches:
            for size, label, unit in zip(*(batch[c].to_pylist() for c in ("size", "label", "unit"))):
                held.setdefault(size, []).append((label, unit))
                if len(held[size]) == pack:
                    yield out(size)
        for size in list(held):
            yield out(size)

    blocks = labelled.mapInArrow(gather, "size int, labels binary, units binary").withColumn("block", F.monotonically_increasing_id())
    blocks = stored(blocks, "blocks")
    dealt = blocks.repartition(max(1, -(-blocks.count() // packs)))
    right = dealt.select(F.col("block").alias("block2"), F.col("size").alias("size2"), F.col("labels").alias("labels2"), F.col("units").alias("units2"))
    # sizes are compared in a sum, as an equal key would send all blocks of a size to one task
    met = dealt.join(right.hint("shuffle_replicate_nl"), (F.col("block") <= F.col("block2")) & (F.abs(F.col("size") - F.col("size2")) < 1))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                size = batch["size"][at].as_py()
                la, lb = (np.frombuffer(batch[c][at].as_buffer(), np.int64) for c in ("labels", "labels2"))
                a, b = (np.frombuffer(batch[c][at].as_buffer()).reshape(-1, size) for c in ("units", "units2"))
                # the error of single precision is below size * 2 ** -22 for unit vectors
                close = a.astype(np.float32) @ b.astype(np.float32).T >= np.float32(threshold - size * 2.0**-22 - 1e-6)
                if not close.any():
                    continue
                i, j = np.nonzero(close & (la[:, None] != lb[None]))
                found = [np.zeros((0, 2), np.int64)]
                for k in range(0, len(i), 1 << 15):
                    p, q = i[k : k + (1 << 15)], j[k : k + (1 << 15)]
                    near = (a[p] * b[q]).sum(1) >= threshold
                    found.append(np.unique(np.stack([la[p[near]], lb[q[near]]], 1), axis=0))
                joins = _spanning(np.concatenate(found))
                if len(joins):
                    yield pa.record_batch([pa.array(joins[:, 0].copy()), pa.array(joins[:, 1].copy())], ["a", "b"])

    return met.select("size", "labels", "labels2", "units", "units2").mapInArrow(compare, "a long, b long").distinct()


def all_labels(scaled: DataFrame, links: DataFrame, threshold: float) -> DataFrame:
    """``row, label`` of every vector that links with another, in whole components."""
    labels = stored(components(links).select(F.col("node").alias("row"), "label"), "vector-labels")
    missed = stored(missed_links(scaled, labels, threshold), "vector-missed")
    if missed.isEmpty():
        return labels
    joined = components(missed).select(F.col("node").alias("own"), F.col("label").alias("whole"))
    alone = joined.join(labels, F.col("own") == F.col("row"), "left_anti").select(F.col("own").alias("row"), F.col("whole").alias("label"))
    moved = labels.join(joined, F.col("label") == F.col("own"), "left").select("row", F.coalesce("whole", "label").alias("label"))
    return stored(moved.union(alone), "vector-labels")


def _means(members: DataFrame) -> DataFrame:
    """``label, mean`` direction of each component; summed in the tasks before shuffling."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, place = np.unique(batch["label"].to_numpy(), return_inverse=True)
            packed = batch["unit"].to_pylist()
            width = max(map(len, packed), default=0)
            sums = np.zeros((len(labels), width // 8))
            np.add.at(sums, place, np.array([np.frombuffer(b.ljust(width, b"\0")) for b in packed]).reshape(len(packed), -1))
            yield pa.record_batch([pa.array(labels), pa.array([s.tobytes() for s in sums], pa.binary())], ["label", "part"])

    def total(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(b) for b in table["part"].to_pylist()]
        width = max(map(len, parts))
        whole = sum(np.pad(p, (0, width - len(p))) for p in parts)
        size = np.sqrt((whole * whole).sum())
        return pa.table([table["label"].slice(0, 1), pa.array([(whole / size if size else whole).tobytes()], pa.binary())], ["label", "mean"])

    return members.select("label", "unit").mapInArrow(add, "label long, part binary").groupBy("label").applyInArrow(total, "label long, mean binary")


def member_counts(scaled: DataFrame, labels: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """``row, n``: links of every member with all other members of its component."""
    members = stored(scaled.join(labels, "row").select("row", "label", "unit"), "members")
    half = np.cos(np.arccos(threshold) / 2) + 1e-9

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for unit, mean in zip(batch["unit"].to_pylist(), batch["mean"].to_pylist()):
                u, m = np.frombuffer(unit), np.frombuffer(mean)
                near.append(len(u) == len(m) and float(u @ m) >= half)
            yield pa.record_batch([batch["row"], batch["label"], batch["unit"], pa.array(near, pa.bool_())], ["row", "label", "unit", "core"])

    judged = members.join(_means(members), "label").select("row", "label", "unit", "mean").mapInArrow(
        judge, "row long, label long, unit binary, core boolean"
    )
    judged = stored(judged, "judged")
    sizes = judged.groupBy("label").agg(F.count(F.lit(1)).alias("m"), F.count_if("core").alias("cores"))
    sized = judged.join(sizes, "label")
    sure = sized.where("core").select("row", (F.col("cores") - 1).alias("n"))
    # components with members off the core, in blocks of about ``block`` rows
    open_ = sized.where("cores < m").withColumn("block", F.pmod(F.xxhash64("row"), F.ceil(F.col("m") / block)))
    body = F.collect_list(F.struct("row", "core", "unit"))
    everyone = open_.groupBy("label", "block").agg(body.alias("right"))
    off = open_.where("NOT core").groupBy("label", "block").agg(body.alias("left")).select("label", "left")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right in zip(batch["left"], batch["right"]):
                left, right = left.as_py(), right.as_py()
                a, b = ([np.frombuffer(x["unit"]) for x in side] for side in (left, right))
                width = max(map(len, a + b))
                a, b = (np.array([np.pad(v, (0, width - len(v))) for v in side]) for side in (a, b))
                ra, rb = (np.array([x["row"] for x in side]) for side in (left, right))
                la, lb = (np.array([len(x["unit"]) for x in side]) for side in (left, right))
                near = np.vstack([(a[i : i + 64, None, :] * b[None]).sum(2) for i in range(0, len(a), 64)]) >= threshold
                near &= (ra[:, None] != rb[None]) & (la[:, None] == lb[None])
                core = np.array([x["core"] for x in right])
                yield pa.record_batch(
                    [pa.array(np.concatenate([ra, rb[core]])), pa.array(np.concatenate([near.sum(1), near.sum(0)[core]]))], ["row", "n"]
                )

    compared = off.join(everyone, "label").select("left", "right").mapInArrow(count, "row long, n long")
    return sure.union(compared).groupBy("row").agg(F.sum("n").alias("n"))


def vector_report(
    vectors: DataFrame, threshold: float = THRESHOLD, passes: int = PASSES, window: int = WINDOW
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row."""
    scaled = units(vectors)
    links = stored(window_links(scaled, threshold, passes, window), "vector-links")
    labels = all_labels(scaled, links, threshold)
    counts = member_counts(scaled, labels, threshold)
    ids = scaled.select("row", "vec_id")
    least = (
        labels.join(ids, "row").groupBy("label")
        .agg(F.nullif(F.min(F.coalesce("vec_id", F.lit(NO_ID))), F.lit(NO_ID)).alias("least"), F.lit(True).alias("grouped"))
    )
    known = labels.join(counts, "row").join(least, "label").select("row", "n", "least", "grouped")
    component = F.when(F.col("grouped"), F.col("least")).otherwise(F.col("vec_id"))
    return ids.join(known, "row", "left").select(
        "vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )

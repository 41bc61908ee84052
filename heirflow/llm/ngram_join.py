"""Jaccard self-join of word shingle sets by PartEnum signatures.

Two sets of sizes a and b with similarity t or more differ in at most (1-t)/(1+t) * (a+b) elements.
Sizes fall into bands whose ends grow by 1/t, so that similar sets are in one band or neighbouring
ones; each pair of neighbouring bands is an instance with one distance bound k. An instance hashes
the domain into n1 first-level parts, each into n2 second-level parts, with n1 * (k2 + 1) > k: in one
first-level part at most k2 second-level parts differ, so the two sets share the signature of the
other n2 - k2. Every subset of n2 - k2 parts is enumerated. (n1, n2, k2) is the choice with the
fewest signatures whose expected set has ``MIN_ELEMENTS`` elements. Where k2 is 0 there are ``spare``
more first-level parts than needed, so that at least spare + 1 of them agree; a set with no more
than ``spare`` empty parts then has an agreeing part that isn't empty, and sends no empty ones.

Sets that are equal are one class before anything is compared. Within the classes of a signature the
one that shares the most signatures in all is compared with the others first; components found so
far then leave only pairs of different components to compare. A parity sketch of each set gives a
lower bound of the difference, which drops pairs before their texts are read; every link is proven
on the shingles of the whole texts. Texts are shuffled only for classes that survive.

Defined cases: null texts and texts without words have no shingles and link with nothing; rows with
equal sets are linked; rows of equal ``doc_id`` are rows of their own with one id; a null ``doc_id`` is larger than
all others and stays null where nothing else is linked; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heirflow.llm.bytescan import mix, shingle_sets, steps
from heirflow.llm.graphs import components, maybe_in, probably_in, spread_join
from heirflow.llm.tables import forget, packed, stored, unpacked

#: Elements that a signature covers on average where the size of the sets allows it.
MIN_ELEMENTS = 4
#: Bits of a set's identity that travel with its signatures; the whole identity is joined to them later.
REF_BITS = 40
SETS_SCHEMA = "doc_id long, h long, len int, n int, f long, c binary, sketch array<long>"
#: Rows of one signature that are held to judge them together; a larger one weighs as much as this.
MAX_HELD = 200_000
#: Pairs of texts that are compared at once.
PROOF_ROWS = 256
#: Sets whose signatures a task has sent are sent once; so many are remembered.
MAX_REMEMBERED = 200_000


@lru_cache(maxsize=None)
def bands(percent: int, up_to: int) -> tuple[tuple[int, int], ...]:
    """(least, largest) size of the bands, the last one beyond ``up_to``."""
    out, low = [], 1
    while low <= up_to or len(out) < 2:
        high = max(low, low * 100 // percent)
        out.append((low, high))
        low = high + 1
    return tuple(out)


@lru_cache(maxsize=None)
def plan(largest: int, percent: int) -> tuple[int, int, int, int]:
    """(n1, n2, k2, spare) of the instance whose larger sets have up to ``largest`` elements."""
    k = (100 - percent) * 2 * largest // (100 + percent)
    best = None
    for k2 in range(4):
        n1 = -(-(k + 1) // (k2 + 1))
        for n2 in range(k2 + 1, 3 * k2 + 2):
            covered = largest / n1 * (n2 - k2) / n2
            rank = (covered < MIN_ELEMENTS, n1 * math.comb(n2, k2) if covered >= MIN_ELEMENTS else -covered)
            if best is None or rank < best[0]:
                best = rank, (n1, n2, k2)
    n1, n2, k2 = best[1]
    spare = max(1, n1 // 10) if k2 == 0 and n1 > 1 else 0
    return n1 + spare, n2, k2, spare


def sketch_words(n: int, percent: int) -> int:
    """64-bit words of the parity sketch of sets in the band of ``n``; neighbouring bands fold to the smaller.

    Eight bits or more for each element that may differ: sets that have little in common differ in so many bits
    that they are told apart with room to spare.
    """
    k = (100 - percent) * 2 * n // (100 + percent) + 1
    return 1 << max(0, min(5, math.ceil(math.log2(max(1, 8 * k / 64)))))


def _sketch(elements: np.ndarray, words: int) -> np.ndarray:
    odd = np.bincount((mix(elements + np.uint64(77)) >> np.uint64(20)).astype(np.int64) & (64 * words - 1), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _identity(elements: np.ndarray) -> bytes:
    """16 bytes that tell sets apart."""
    n = np.uint64(len(elements))
    pair = np.array([mix(elements).sum() + n, mix(elements ^ np.uint64(0x5851F42D4C957F2D)).sum() ^ n], np.uint64)
    return mix(pair).tobytes()


def shingle_table(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Of every row: key of the text, size of its set, identity ``c`` of the set, its first half ``f``, sketch."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, c, sketches = [], [], []
            for data, offsets, _ in steps(batch["text"]):
                for one in shingle_sets(data, offsets, size):
                    n.append(len(one))
                    c.append(_identity(one))
                    sketches.append(_sketch(one, sketch_words(len(one), percent)))
            f = np.frombuffer(b"".join(c), np.int64)[::2] & (1 << REF_BITS) - 2
            yield pa.record_batch(
                [batch["doc_id"], batch["h"], batch["len"], pa.array(n, pa.int32()), pa.array(f, pa.int64()),
                 pa.array(c, pa.binary()), pa.array(sketches, pa.list_(pa.int64()))],
                ["doc_id", "h", "len", "n", "f", "c", "sketch"],
            )

    return _keyed(docs).mapInArrow(describe, SETS_SCHEMA)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long"), F.xxhash64("text").alias("h"),
        F.coalesce(F.octet_length("text"), F.lit(-1)).alias("len"), "text",
    )


def _signatures(elements: np.ndarray, instance: int, largest: int, percent: int) -> np.ndarray:
    n1, n2, k2, spare = plan(largest, percent)
    seed = np.uint64(instance * 1_000_003 + 17)
    spread = mix(elements + seed)
    cell = (spread >> np.uint64(33)).astype(np.int64) % n1 * n2 + (spread & np.uint64(0x7FFFFFFF)).astype(np.int64) % n2
    sums = np.zeros(n1 * n2, np.uint64)
    np.add.at(sums, cell, mix(spread))
    sums = sums.reshape(n1, n2)
    first = np.arange(n1, dtype=np.uint64) * np.uint64(64)
    if spare:
        filled = np.bincount(cell, minlength=n1) > 0
        if n1 - filled.sum() <= spare:
            sums, first = sums[filled], first[filled]
    return np.concatenate([
        mix(sums[:, list(some)].sum(1) + mix((first + np.uint64(number)) * np.uint64(0x9E3779B97F4A7C15) + seed))
        for number, some in enumerate(combinations(range(n2), n2 - k2))
    ])


def signature_rows(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """``sig, f`` of every set, in the instance of its band and in that of the next band.

    The last bit of ``f`` says whether the set is of the larger band of the instance. Two sets of
    the smaller band are compared in the instance before.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()
        for batch in batches:
            for data, offsets, _ in steps(batch["text"]):
                sigs, refs, counts = [], [], []
                for one in shingle_sets(data, offsets, size):
                    c = _identity(one)
                    if not len(one) or c in sent:
                        continue
                    if len(sent) < MAX_REMEMBERED:
                        sent.add(c)
                    f = int.from_bytes(c[:8], "little", signed=True) & (1 << REF_BITS) - 2
                    table = bands(percent, 1 << (len(one)).bit_length())
                    band = next(i for i, (_, high) in enumerate(table) if len(one) <= high)
                    for i in (band, band + 1):
                        high = table[i][1] if i < len(table) else (table[-1][1] + 1) * 100 // percent
                        sigs.append(_signatures(one, i, high, percent))
                        refs.append(f | (i == band))
                        counts.append(len(sigs[-1]))
                if sigs:
                    yield pa.record_batch(
                        [pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.repeat(np.array(refs, np.int64), counts))],
                        ["sig", "f"],
                    )

    return docs.select("text").mapInArrow(emit, "sig long, f long")


def _shared(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """``sig, f, m`` of the signatures that ``m`` different sets have, one of them of the larger band."""
    rows = signature_rows(docs, size, percent).repartition("sig").sortWithinPartitions("sig", "f")

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows arrive sorted. The last signature of a batch is held until it is whole; one of more than
        ``MAX_HELD`` rows is passed on as it comes."""
        sig, f = np.zeros(0, np.int64), np.zeros(0, np.int64)
        flowing = None

        def out(sig: np.ndarray, f: np.ndarray, m: np.ndarray | None = None) -> pa.RecordBatch:
            m = np.full(len(sig), MAX_HELD) if m is None else m
            return pa.record_batch([pa.array(sig), pa.array(f), pa.array(m.astype(np.int32))], ["sig", "f", "m"])

        def judged(sig: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            m = np.zeros(len(sig))
            if len(sig):
                fresh = np.concatenate([[True], (sig[1:] != sig[:-1]) | (f[1:] != f[:-1])])
                sig, f = sig[fresh], f[fresh]
                heads = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
                counts = np.diff(np.append(heads, len(sig)))
                good = np.repeat((counts > 1) & (np.maximum.reduceat(f & 1, heads) == 1), counts)
                sig, f, m = sig[good], f[good], np.repeat(counts, counts)[good]
            return out(sig, f, m)

        for batch in batches:
            sig = np.concatenate([sig, batch["sig"].to_numpy()])
            f = np.concatenate([f, batch["f"].to_numpy()])
            if flowing is not None:
                cut = int(np.searchsorted(sig, flowing, "right"))
                yield out(sig[:cut], f[:cut])
                sig, f = sig[cut:], f[cut:]
            if not len(sig):
                continue
            flowing = None
            cut = int(np.searchsorted(sig, sig[-1]))
            yield judged(sig[:cut], f[:cut])
            sig, f = sig[cut:], f[cut:]
            if len(sig) > MAX_HELD:
                flowing = int(sig[0])
                yield out(sig, f)
                sig, f = sig[:0], f[:0]
        yield judged(sig, f)

    return rows.mapInArrow(several, "sig long, f long, m int")


def grows(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the corpus: never broadcast, so that the plan is the same at every size."""
    return df.hint("merge")


def _close(a: str, b: str, percent: int):
    """Sizes and sketches that don't rule the pair out; sketches fold to the shorter by parity."""
    size = (100 * F.least(f"{a}.n", f"{b}.n") >= percent * F.greatest(f"{a}.n", f"{b}.n"))
    limit = F.floor((100 - percent) * (F.col(f"{a}.n") + F.col(f"{b}.n")) / (100 + percent) + 1e-9)
    fold = lambda s, w: (
        f"transform(sequence(0, {w} - 1), i_ -> aggregate(sequence(i_, size({s}) - 1, {w}), 0L, (acc_, j_) -> acc_ ^ {s}[j_]))"
    )
    w = f"least(size({a}.sketch), size({b}.sketch))"
    differ = F.expr(
        f"CASE WHEN size({a}.sketch) = size({b}.sketch) THEN "
        f"aggregate(zip_with({a}.sketch, {b}.sketch, (p_, q_) -> bit_count(p_ ^ q_)), 0, (p_, q_) -> p_ + q_) ELSE "
        f"aggregate(zip_with({fold(a + '.sketch', w)}, {fold(b + '.sketch', w)}, (p_, q_) -> bit_count(p_ ^ q_)), 0, (p_, q_) -> p_ + q_) END"
    )
    return size & (differ <= limit)


def _proven(pairs: DataFrame, docs: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` of classes whose sets reach the similarity, by their whole texts; no other texts are shuffled."""
    if pairs.isEmpty():
        return pairs
    ends = pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct()
    texts = _texts(docs, stored(classes.select("c", "at").join(ends, "c", "left_semi"), "jaccard-ends"))
    left = texts.select(F.col("c").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("c").alias("b"), F.col("text").alias("text_b"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for at in range(0, batch.num_rows, PROOF_ROWS):
                left, right = (
                    [s for data, offsets, _ in steps(batch[side].slice(at, PROOF_ROWS)) for s in shingle_sets(data, offsets, size)]
                    for side in ("text_a", "text_b")
                )
                for x, y in zip(left, right):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(grows(left), "a").join(grows(right), "b").select("a", "b", "text_a", "text_b")
    links = stored(joined.mapInArrow(compare, "a binary, b binary"), "jaccard-links")
    forget(texts)
    return links


def linked(docs: DataFrame, size: int = 3, percent: int = 90) -> tuple[DataFrame, DataFrame]:
    """(:func:`shingle_table` stored, ``c, label`` of the classes that link with another class)."""
    sets = stored(shingle_table(docs, size, percent), "jaccard-sets")
    kept = stored(_shared(docs, size, percent), "jaccard-shared")
    shared = kept.select("sig", F.col("f").bitwiseAND(F.lit(-2)).alias("f"), (F.col("f") % 2 != 0).alias("upper"), "m")
    several = sets.where("n > 0").join(grows(shared.select("f").distinct()), "f", "left_semi")
    classes = several.groupBy("f", "c").agg(
        F.min(F.struct("doc_id", "h", "len")).alias("at"), F.first("n").alias("n"), F.first("sketch").alias("sketch")
    )
    classes = stored(classes, "jaccard-classes")
    weight = shared.groupBy("f").agg(F.sum("m").alias("weight"))
    weighed = stored(shared.join(grows(weight), "f").select("sig", "f", "upper", "weight"), "jaccard-weighed")
    forget(kept)
    leaders = weighed.groupBy("sig").agg(F.max(F.struct("weight", "f"))["f"].alias("y"))
    members = weighed.select("sig", "f", "upper")
    # the few sets whose f is not theirs alone are all compared, also with each other
    sketched = classes.select("f", F.struct("c", "n", "sketch").alias("x"))
    ends = F.least("x.c", "y.c").alias("a"), F.greatest("x.c", "y.c").alias("b")
    stars = (
        members.join(grows(leaders), "sig").where("f <> y").select(F.least("f", "y").alias("a"), F.greatest("f", "y").alias("b")).distinct()
        .join(grows(sketched.withColumnsRenamed({"f": "a"})), "a").join(grows(sketched.withColumnsRenamed({"f": "b", "x": "y"})), "b")
        .where(_close("x", "y", percent)).select(*ends)
    )
    same = sketched.join(sketched.groupBy("f").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("f"), "f", "left_semi")
    namesakes = same.join(same.withColumnsRenamed({"x": "y"}), "f").where((F.col("x.c") < F.col("y.c")) & _close("x", "y", percent))
    tried = stars.union(namesakes.select(*ends)).distinct()
    tried = stored(tried, "jaccard-stars")
    links = _proven(tried, docs, classes, size, percent)
    labels = components(links)
    named = classes.select("f", "c").join(labels.withColumnRenamed("node", "c"), "c", "left")
    label = F.when(F.count(F.lit(1)) == 1, F.min(F.coalesce("label", "c"))).otherwise(F.col("f").cast("string").cast("binary"))
    left = stored(members.join(grows(named.groupBy("f").agg(label.alias("label"))), "f"), "jaccard-named")
    forget(weighed)
    mixed = left.groupBy("sig").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.max("upper").alias("any"))
    open_ = left.join(grows(mixed.where("any AND least <> most").select("sig")), "sig", "left_semi")
    open_ = stored(open_.join(grows(sketched), "f").drop("f"), "jaccard-open")
    forget(left)
    one, other = open_.alias("one"), open_.alias("other")
    # all conditions are of the join itself, which so makes only the pairs that may be links
    pair = (
        (F.col("one.sig") == F.col("other.sig")) & (F.col("one.label") != F.col("other.label"))
        & (F.col("one.x.c") < F.col("other.x.c")) & (F.col("one.upper") | F.col("other.upper")) & _close("one.x", "other.x", percent)
    )
    rest = one.join(grows(other), pair).select(F.col("one.x.c").alias("a"), F.col("other.x.c").alias("b")).distinct()
    rest = stored(rest.join(tried, ["a", "b"], "left_anti"), "jaccard-rest")
    forget(open_)
    more = _proven(rest, docs, classes, size, percent)
    return sets, _joined(labels, more)


def _joined(labels: DataFrame, more: DataFrame) -> DataFrame:
    """``c, label`` after more links: only the components they join are labelled again."""
    labels = labels.select(F.col("node").alias("c"), "label")
    if more.isEmpty():
        return labels
    ends = stored(more.select(F.explode(F.array("a", "b")).alias("c")).distinct().join(labels, "c", "left_anti"), "jaccard-ends")
    labels = stored(labels.union(ends.select("c", F.col("c").alias("label"))), "jaccard-labels")
    of_a, of_b = (labels.select(F.col("c").alias(x), F.col("label").alias(f"label_{x}")) for x in "ab")
    joined = more.join(of_a, "a").join(of_b, "b").select(F.col("label_a").alias("a"), F.col("label_b").alias("b"))
    again = components(joined).select(F.col("node").alias("label"), F.col("label").alias("lower"))
    return spread_join(labels, again, "label").select("c", F.coalesce("lower", "label").alias("label"))


def _texts(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """``c, text`` of each class, from the row that stands for it."""
    keyed = probably_in(_keyed(docs), "h", classes.select("at.h"))
    at = classes.select("c", F.col("at.doc_id").alias("d"), F.col("at.h").alias("k"), F.col("at.len").alias("m"))
    same = keyed.doc_id.eqNullSafe(F.col("d")) & (keyed.h == F.col("k")) & (keyed.len == F.col("m"))
    return stored(keyed.join(grows(at), same).select("c", "text"), "jaccard-texts")


def _grouped(sets: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``sets`` with ``component_id`` and ``first``, the least (id, text) of the component."""
    big = F.lit((1 << 63) - 1)
    rows = spread_join(sets.select("doc_id", "h", "len", "n", "c"), labels, "c")
    rows = stored(rows.select("doc_id", "h", "len", "n", F.coalesce("label", "c").alias("g")), "jaccard-rows")
    least = F.struct(F.coalesce("doc_id", big).alias("id"), F.col("h"), F.col("len"))
    heads = rows.where("n > 0").groupBy("g").agg(F.min(least).alias("first"))
    joined = spread_join(rows.where("n > 0"), heads, "g").select(
        "doc_id", "h", "len", "n", F.nullif(F.col("first.id"), big).alias("component_id"), "first"
    )
    alone = rows.where("n = 0").select("doc_id", "h", "len", "n", F.col("doc_id").alias("component_id"), least.alias("first"))
    return joined.union(alone)


def jaccard_report(docs: DataFrame, size: int = 3, percent: int = 90) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row."""
    sets, labels = linked(docs, size, percent)
    return _grouped(sets, labels).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """All columns of one row of each component, the least (id, text); rows without words all stay.

    Rows that certainly stay aren't shuffled: the keys of the others are sent as a bounded filter,
    and only rows it may hold are joined.
    """
    sets, labels = linked(docs, size, percent)
    grouped = _grouped(sets, labels).where("n > 0")
    own = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("id"), F.col("h"), F.col("len"))
    counted = grouped.groupBy("doc_id", "h", "len", (own == F.col("first")).alias("head")).count()
    # rows to drop whole, and heads that repeat as equal rows, of which one stays
    touched = stored(counted.where("NOT head OR count > 1").select("doc_id", "h", "len", "head"), "jaccard-drop")
    keyed = docs.select(
        packed(docs), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"),
        F.coalesce(F.octet_length("text"), F.lit(-1)).alias("len"),
    )
    key = F.xxhash64("doc_id", "h", "len")
    marked = keyed.withColumn("key", key)
    may = maybe_in(marked, "key", touched.select(key.alias("key")))
    sure = may.where("NOT maybe").select(*unpacked(docs, []))
    t = touched.select(F.col("doc_id").alias("d"), F.col("h").alias("k"), F.col("len").alias("m"), "head")
    unsure = may.where("maybe")
    same = unsure.doc_id.eqNullSafe(F.col("d")) & (unsure.h == F.col("k")) & (unsure.len == F.col("m"))
    checked = unsure.join(t, same, "left")
    free = checked.where("head IS NULL").select(*unpacked(docs, []))
    once = checked.where("head").groupBy("doc_id", "h", "len").agg(F.first("row").alias("row")).select(*unpacked(docs, []))
    return sure.unionByName(free).unionByName(once)

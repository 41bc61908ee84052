"""Removal of repeated byte strings with suffixes ordered by deep-shallow sorting.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier: in a smaller
``doc_id``, or before it in the same document. No suffix of the whole corpus is shuffled. Each string
of ``LENGTH`` bytes is owned by its anchor, the place of the ``GRAM`` bytes in it with the smallest
hash (the leftmost one); equal strings have equal anchors at equal offsets. So

1. every text is cut into runs of starts with one anchor, and one narrow row a run (hashes of the
   anchor's bytes and of the whole stretch, place) is shuffled by the anchor's hash. Runs whose
   stretch occurred earlier are repeated as a whole; runs that share an anchor but not a stretch
   are undecided, all others are unique;
2. the bytes of undecided runs alone are fetched and shuffled by anchor; the suffixes at all their
   starts are sorted: a multikey quicksort on words of eight bytes orders them to ``SHALLOW`` bytes, and
   blind tries order the groups that still share their prefix. Leaves of a trie that agree to
   ``LENGTH`` bytes are equal strings, of which the earliest stays. An anchor with more than
   ``CHUNK_STARTS`` undecided starts is sorted in pieces where its bytes were fetched; of each piece only
   the earliest start of every string is shuffled, by a hash of the string, and sorted again;
3. repeated starts of each document become spans, and the rest is hashed.

Copies in one Arrow batch are settled before the shuffle. Texts are shuffled only where a document
has undecided or repeated runs, behind a bounded filter.

Defined cases: a null text is empty; a null ``doc_id`` is larger than all others; rows of equal
``doc_id`` and different text are ordered by a hash of the text; rows equal in both are one document
and get the same result each; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heirflow.llm.bytescan import mix, prefix_sums, range_hash, steps
from heirflow.llm.graphs import maybe_in, probably_in
from heirflow.llm.tables import stored

LENGTH = 100
GRAM = 24
SHALLOW = 32
#: Starts that one sort takes, where whole groups of an anchor allow it.
CHUNK_STARTS = 400_000
NO_ID = (1 << 63) - 1
#: Layout of ``spot``: start of the run, number of starts, hash of the text.
_RUN_BITS, _HASH_BITS = 7, 24

RUN_SCHEMA = "gram long, stretch long, id long, spot long"
FOUND_SCHEMA = "gram long, id long, spot long, known boolean"


# ---------------------------------------------------------------- sorting


def _words_at(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Eight bytes at each place as one big-endian number; ``data`` is padded."""
    view = np.lib.stride_tricks.sliding_window_view(data, 8)[places]
    return np.ascontiguousarray(view).view(">u8").ravel().astype(np.uint64)


def multikey_order(data: np.ndarray, starts: np.ndarray, shallow: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of the suffixes by their first ``shallow`` bytes, where groups of equal prefixes begin).

    All open groups are split at once, around the word of their middle suffix: smaller, equal and
    greater words. Only the equal part moves on by a word.
    """
    order = np.arange(len(starts))
    begins = np.zeros(1, np.int64)
    depths = np.zeros(1, np.int64)
    final_begin = []
    places = np.arange(len(starts))
    while len(places):
        sizes = np.diff(np.append(begins, len(places)))
        group = np.repeat(np.arange(len(begins)), sizes)
        word = _words_at(data, starts[order[places]] + depths[group])
        pivot = word[begins + sizes // 2][group]
        side = np.where(word < pivot, 0, np.where(word == pivot, 1, 2))
        sorted_ = np.argsort(group * 3 + side, kind="stable")
        order[places] = order[places[sorted_]]
        part = (group * 3 + side)[sorted_]
        heads = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        counts = np.diff(np.append(heads, len(part)))
        depth = depths[part[heads] // 3] + 8 * (part[heads] % 3 == 1)
        open_ = (counts > 1) & (depth < shallow)
        closed_equal = (counts > 1) & (depth >= shallow)
        for h, c in zip(heads[closed_equal].tolist(), counts[closed_equal].tolist()):
            final_begin.append((int(places[h]), c))
        keep = np.repeat(open_, counts)
        places = places[keep]
        counts = counts[open_]
        begins = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64) if len(counts) else np.zeros(0, np.int64)
        depths = depth[open_]
    return order, np.array(sorted(final_begin), np.int64).reshape(-1, 2)


class BlindTrie:
    """Strings of one length; inner nodes hold only how deep their children part and by which byte."""

    __slots__ = ("root", "size")

    def __init__(self, first: bytes, value: int):
        self.size = len(first)
        self.root: list = [self.size, first, [value]]

    def insert(self, text: bytes, value: int) -> None:
        node = self.root
        while node[0] < self.size:
            child = node[1].get(text[node[0]])
            node = child if child is not None else next(iter(node[1].values()))
        leaf = node
        differ = int.from_bytes(leaf[1], "big") ^ int.from_bytes(text, "big")
        if not differ:
            leaf[2].append(value)
            return
        common = self.size - 1 - (differ.bit_length() - 1) // 8
        node, parent, edge = self.root, None, 0
        while node[0] < common:
            parent, edge = node, text[node[0]]
            node = node[1][edge]
        fresh = [self.size, text, [value]]
        if node[0] == common:
            node[1][text[common]] = fresh
            return
        split = [common, {leaf[1][common]: node, text[common]: fresh}]
        if parent is None:
            self.root = split
        else:
            parent[1][edge] = split

    def leaves(self) -> Iterator[list[int]]:
        """The values of equal strings, in the order of the strings."""
        stack = [self.root]
        while stack:
            node = stack.pop()
            if node[0] == self.size:
                yield node[2]
            else:
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]


def sorted_suffixes(data: np.ndarray, starts: np.ndarray, length: int = LENGTH, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """(order of the suffixes by ``length`` bytes, class of each place: equal strings share one)."""
    padded = np.concatenate([data, np.zeros(length + 8, np.uint8)])
    shallow = min(shallow, length // 8 * 8)
    order, deep = multikey_order(padded, starts, shallow)
    classes = np.arange(len(starts))
    whole = padded.tobytes()
    for begin, count in deep.tolist():
        group = order[begin : begin + count].tolist()
        at = starts[group].tolist()
        trie = BlindTrie(whole[at[0] + shallow : at[0] + length], group[0])
        for value, a in zip(group[1:], at[1:]):
            trie.insert(whole[a + shallow : a + length], value)
        place = begin
        for values in trie.leaves():
            order[place : place + len(values)] = values
            classes[place : place + len(values)] = place
            place += len(values)
    return order, classes


# ---------------------------------------------------------------- runs


def text_hash(column: str = "text"):
    """Some bits of the hash of a text, to tell rows of one ``doc_id`` apart."""
    return F.coalesce(F.xxhash64(column), F.lit(0)).bitwiseAND(F.lit((1 << _HASH_BITS) - 1))


def _spot(start: np.ndarray, count: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return (hashes.astype(np.int64) << (31 + _RUN_BITS)) | (start.astype(np.int64) << _RUN_BITS) | count.astype(np.int64)


def spot_parts(spot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, number of starts, hash of the text)."""
    return (spot >> _RUN_BITS) & ((1 << 31) - 1), spot & ((1 << _RUN_BITS) - 1), spot >> (31 + _RUN_BITS)


def runs(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(hash of the anchor, hash of the stretch, text, first start in it, number of starts) of every run."""
    window = length - gram + 1
    n = len(data)
    none = tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    if n < length:
        return none
    sums = prefix_sums(data)
    at = np.arange(n - gram + 1)
    grams = range_hash(sums, at, at + gram)
    least = ((grams >> np.uint64(32)) << np.uint64(32)) | at.astype(np.uint64)
    reach = 1
    while 2 * reach <= window:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < window:
        least = np.minimum(least[: len(least) - (window - reach)], least[window - reach :])
    owner = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    sizes = np.diff(offsets)
    text = np.repeat(np.arange(len(sizes)), sizes)[: len(owner)]
    inside = np.arange(len(owner)) + length <= offsets[text + 1]
    change = np.ones(len(owner), bool)
    change[1:] = (owner[1:] != owner[:-1]) | (inside[1:] != inside[:-1]) | (text[1:] != text[:-1])
    heads = np.flatnonzero(change)
    counts = np.diff(np.append(heads, len(owner)))
    mine = inside[heads]
    heads, counts = heads[mine], counts[mine]
    anchor = owner[heads]
    stretch = range_hash(sums, heads, heads + counts - 1 + length)
    stretch = mix(stretch ^ mix((anchor - heads).astype(np.uint64) * np.uint64(128) + counts.astype(np.uint64)))
    return grams[anchor], stretch, text[heads], heads - offsets[text[heads]], counts


def _same_before(*keys: np.ndarray) -> np.ndarray:
    same = np.ones(len(keys[0]), bool)
    same[:1] = False
    for k in keys:
        same[1:] &= k[1:] == k[:-1]
    return same


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), text_hash().alias("th"), "text")


def run_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """One row of every run; runs that a smaller row of the batch repeats are settled: they have a
    negative ``spot`` and a ``gram`` that only spreads them."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = batch["id"].to_numpy(), batch["th"].to_numpy()
            parts = []
            for data, offsets, row in steps(batch["text"]):
                g, s, text, start, count = runs(data, offsets, length, gram)
                parts.append((g.view(np.int64), s.view(np.int64), ids[text + row], _spot(start, count, hashes[text + row])))
            if not parts:
                continue
            g, s, i, spot = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((spot, i, s, g))
            g, s, i, spot = g[order], s[order], i[order], spot[order]
            again = _same_before(g, s) & ~_same_before(g, s, i, spot)
            spot = np.where(again, -1 - spot, spot)
            g = np.where(again, mix(i.view(np.uint64)).view(np.int64), g)
            yield pa.record_batch([pa.array(g), pa.array(s), pa.array(i), pa.array(spot)], ["gram", "stretch", "id", "spot"])

    return _keyed(docs).select("id", "th", "text").mapInArrow(emit, RUN_SCHEMA)


def judged_runs(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Runs that are repeated as a whole (``known``) or share an anchor with another stretch (not known yet)."""
    rows = run_rows(docs, length, gram).repartition("gram").sortWithinPartitions("gram", "stretch", "id", "spot")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows arrive in order; the last stretch of a batch is held until what follows is seen."""
        held: dict | None = None

        def out(g, i, spot, known):
            return pa.record_batch([pa.array(g), pa.array(i), pa.array(spot), pa.array(known)], ["gram", "id", "spot", "known"])

        for batch in batches:
            g, s, i, spot = (batch[c].to_numpy() for c in ("gram", "stretch", "id", "spot"))
            settled = spot < 0
            if settled.any():
                yield out(g[settled], i[settled], -1 - spot[settled], np.ones(settled.sum(), bool))
                g, s, i, spot = g[~settled], s[~settled], i[~settled], spot[~settled]
            if not len(g):
                continue
            shared = False
            first_is_held = held is not None
            if first_is_held:
                g, s, i, spot = (np.concatenate([[held[c]], x]) for c, x in zip("gsix", (g, s, i, spot)))
                shared = held["shared"]
            repeat = _same_before(g, s)
            equal_row = _same_before(g, s, i, spot)
            yield out(g[repeat & ~equal_row], i[repeat & ~equal_row], spot[repeat & ~equal_row], np.ones((repeat & ~equal_row).sum(), bool))
            heads = np.flatnonzero(~repeat)
            gh = g[heads]
            open_ = np.zeros(len(heads), bool)
            open_[1:] |= gh[1:] == gh[:-1]
            open_[:-1] |= gh[1:] == gh[:-1]
            if first_is_held:
                open_[0] |= shared
            some = heads[:-1][open_[:-1]]
            yield out(g[some], i[some], spot[some], np.zeros(len(some), bool))
            last = heads[-1]
            held = {"g": g[last], "s": s[last], "i": i[last], "x": spot[last], "shared": bool(open_[-1])}
        if held is not None and held["shared"]:
            yield out(*(np.array([held[c]]) for c in "gix"), np.zeros(1, bool))

    return rows.mapInArrow(judge, FOUND_SCHEMA)


def stretches(docs: DataFrame, undecided: DataFrame, length: int) -> DataFrame:
    """``gram, id, spot, body``: the bytes of the undecided runs."""
    wanted = undecided.groupBy("id", F.shiftright("spot", 31 + _RUN_BITS).alias("th")).agg(
        F.collect_list(F.struct("gram", "spot")).alias("runs")
    )
    texts = probably_in(_keyed(docs).where("text IS NOT NULL"), "id", undecided.select("id").distinct())
    joined = texts.join(wanted, ["id", "th"]).select("id", "text", "runs")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                data = batch["text"][at].as_py().encode()
                found = batch["runs"][at].values
                g, spot = found.field("gram"), found.field("spot")
                start, count, _ = spot_parts(spot.to_numpy())
                body = [data[a : a + c - 1 + length] for a, c in zip(start.tolist(), count.tolist())]
                yield pa.record_batch(
                    [g, pa.array(np.full(len(body), batch["id"][at].as_py(), np.int64)), spot, pa.array(body, pa.binary())],
                    ["gram", "id", "spot", "body"],
                )

    return joined.mapInArrow(cut, "gram long, id long, spot long, body binary")


def judged_starts(bodies: list[bytes], ids: np.ndarray, spots: np.ndarray, length: int = LENGTH, first_too: bool = False):
    """(id, spot, all bytes, place in them) of the earliest start of every string of the given runs if
    ``first_too``, and (id, spot) of the stretches of starts whose string occurs earlier among them."""
    start, count, hashes = spot_parts(spots)
    data = np.frombuffer(b"".join(bodies), np.uint8)
    base = np.concatenate([[0], np.cumsum([len(b) for b in bodies])[:-1]]).astype(np.int64)
    owner = np.repeat(np.arange(len(bodies)), count)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    order, classes = sorted_suffixes(data, base[owner] + inner, length)
    who, at = owner[order], start[owner[order]] + inner[order]
    rank = np.lexsort((at, hashes[who], ids[who], classes))
    first = ~_same_before(classes[rank])
    # rows that are equal in all keys are one string
    group_first = rank[first][np.cumsum(first) - 1]
    same_row = (ids[who[rank]] == ids[who[group_first]]) & (hashes[who[rank]] == hashes[who[group_first]]) & (at[rank] == at[group_first])
    leads = None
    if first_too:
        lead = rank[first]
        own = who[lead]
        leads = ids[own], _spot(at[lead], np.ones(len(lead), np.int64), hashes[own]), data, base[own] + at[lead] - start[own]
    gone = rank[~same_row]
    i, h, a = ids[who[gone]], hashes[who[gone]], at[gone]
    order = np.lexsort((a, h, i))
    i, h, a = i[order], h[order], a[order]
    new = np.ones(len(a), bool)
    new[1:] = (i[1:] != i[:-1]) | (h[1:] != h[:-1]) | (a[1:] > a[:-1] + 1)
    heads = np.flatnonzero(new)
    ends = np.append(heads[1:], len(a)) - 1
    first_at, total = a[heads], (a[ends] - a[heads] + 1) if len(heads) else a[heads]
    # a spot holds up to 127 starts
    pieces = -(-total // 127) if len(heads) else total
    k = np.repeat(np.arange(len(heads)), pieces)
    nth = np.arange(len(k)) - np.repeat(np.cumsum(pieces) - pieces, pieces) if len(k) else k
    size = np.minimum(127, total[k] - 127 * nth)
    return leads, (i[heads][k], _spot(first_at[k] + 127 * nth, size, h[heads][k]))


def hot_grams(undecided: DataFrame, chunk: int) -> frozenset[int]:
    """Anchors with more than ``chunk`` undecided starts; there is at most one for every ``chunk`` starts."""
    starts = F.sum(F.col("spot").bitwiseAND(F.lit((1 << _RUN_BITS) - 1)))
    return frozenset(r[0] for r in undecided.groupBy("gram").agg(starts.alias("n")).where(F.col("n") > chunk).select("gram").collect())


def split_hot(bodies: DataFrame, hot: frozenset[int], length: int, chunk: int) -> DataFrame:
    """``bodies``; runs of a hot anchor as the earliest start of each of their strings in a piece of about
    ``chunk`` starts, under a hash of the string for ``gram``. Repeated starts of a piece have no body."""
    shared = bodies.sparkSession.sparkContext.broadcast(np.array(sorted(hot), np.int64))
    names = ["gram", "id", "spot", "body"]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        waiting = 0

        def settle() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held)
            (i, spot, data, places), (gone, gone_spot) = judged_starts(
                rows["body"].to_pylist(), rows["id"].to_numpy(), rows["spot"].to_numpy(), length, True
            )
            spread = mix(gone.view(np.uint64)).view(np.int64)
            yield pa.record_batch([pa.array(spread), pa.array(gone), pa.array(gone_spot), pa.nulls(len(gone), pa.binary())], names)
            for k in range(0, len(places), 10_000):
                text = [data[p : p + length].tobytes() for p in places[k : k + 10_000].tolist()]
                gram = np.array([int.from_bytes(hashlib.blake2b(t, digest_size=8).digest(), "little", signed=True) for t in text], np.int64)
                yield pa.record_batch([pa.array(gram), pa.array(i[k : k + 10_000]), pa.array(spot[k : k + 10_000]), pa.array(text, pa.binary())], names)

        for batch in batches:
            is_hot = np.isin(batch["gram"].to_numpy(), shared.value)
            if not is_hot.all():
                yield batch.filter(pa.array(~is_hot))
            if is_hot.any():
                held.append(batch.filter(pa.array(is_hot)))
                waiting += int((held[-1]["spot"].to_numpy() & ((1 << _RUN_BITS) - 1)).sum())
                if waiting >= chunk:
                    yield from settle()
                    held, waiting = [], 0
        if held:
            yield from settle()

    return bodies.mapInArrow(split, "gram long, id long, spot long, body binary")


def sorted_repeats(bodies: DataFrame, length: int, chunk: int = CHUNK_STARTS) -> DataFrame:
    """``id, spot`` of repeated starts of undecided runs; runs of one anchor are sorted together.

    Rows without a body are repeated already."""
    dealt = bodies.repartition("gram").sortWithinPartitions("gram", "id", "spot")

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        waiting = 0

        def settle(rows: pa.Table) -> pa.RecordBatch:
            _, (i, spot) = judged_starts(rows["body"].to_pylist(), rows["id"].to_numpy(), rows["spot"].to_numpy(), length)
            return pa.record_batch([pa.array(i), pa.array(spot)], ["id", "spot"])

        for batch in batches:
            if batch["body"].null_count:
                done = batch.filter(batch["body"].is_null())
                yield pa.record_batch([done["id"], done["spot"]], ["id", "spot"])
                batch = batch.filter(batch["body"].is_valid())
            if not batch.num_rows:
                continue
            held.append(batch)
            waiting += int((batch["spot"].to_numpy() & ((1 << _RUN_BITS) - 1)).sum())
            if waiting >= chunk:
                rows = pa.Table.from_batches(held)
                gram = rows["gram"].to_numpy()
                cut = int(np.searchsorted(gram, gram[-1]))
                if cut:
                    yield settle(rows.slice(0, cut))
                    held = rows.slice(cut).combine_chunks().to_batches()
                    waiting = sum(int((b["spot"].to_numpy() & ((1 << _RUN_BITS) - 1)).sum()) for b in held)
        if held:
            yield settle(pa.Table.from_batches(held))

    return dealt.mapInArrow(sort, "id long, spot long")


# ---------------------------------------------------------------- documents


def spans_of(spots: np.ndarray, length: int) -> np.ndarray:
    """Maximal removed runs, as rows of (start, end), of one document."""
    start, count, _ = spot_parts(spots)
    order = np.argsort(start, kind="stable")
    start, end = start[order], (start + count - 1 + length)[order]
    reach = np.maximum.accumulate(end)
    new = np.concatenate([[True], start[1:] > reach[:-1]])
    heads = np.flatnonzero(new)
    return np.stack([start[heads], reach[np.append(heads[1:], len(start)) - 1]], 1)


def removal_report(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row."""
    found = stored(judged_runs(docs, length, gram), "suffix-runs")
    undecided = found.where("NOT known").select("gram", "id", "spot")
    bodies = stretches(docs, undecided, length)
    hot = hot_grams(undecided, CHUNK_STARTS)
    if hot:
        bodies = split_hot(bodies, hot, length, CHUNK_STARTS)
    sorted_ = stored(sorted_repeats(bodies, length), "suffix-repeats")
    gone = found.where("known").select("id", "spot").union(sorted_)
    by_doc = gone.groupBy("id", F.shiftright("spot", 31 + _RUN_BITS).alias("th")).agg(F.collect_list("spot").alias("spots"))
    keyed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"),
        text_hash().alias("th"), F.coalesce("text", F.lit("")).alias("text"),
    )
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    # texts shorter than ``length`` can't lose a byte
    short = F.octet_length("text") < length
    long_ = maybe_in(keyed.where(~short), "id", gone.select("id").distinct())
    whole = keyed.where(short).unionByName(long_.where("NOT maybe").drop("maybe")).select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"),
    )
    cut = long_.where("maybe").join(by_doc, ["id", "th"], "left").select("doc_id", "text", "spots")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spots in zip(batch["text"].to_pylist(), batch["spots"]):
                data = text.encode()
                spans = spans_of(spots.values.to_numpy(), length) if spots.is_valid else np.zeros((0, 2), np.int64)
                kept, at = hashlib.sha256(), 0
                for a, b in spans.tolist():
                    kept.update(data[at:a])
                    at = b
                kept.update(data[at:])
                out.append((len(data), int((spans[:, 1] - spans[:, 0]).sum()), len(spans), kept.hexdigest()))
            n, gone_, count, sha = zip(*out) if out else ((), (), (), ())
            yield pa.record_batch(
                [batch["doc_id"], pa.array(n, pa.int64()), pa.array(gone_, pa.int64()), pa.array(count, pa.int64()), pa.array(sha, pa.string())],
                names,
            )

    digested = cut.mapInArrow(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return whole.unionByName(digested)

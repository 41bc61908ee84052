"""Token ids as segments: one packed id array and Elias-Fano coded document boundaries.

Documents are range-partitioned by ``doc_id`` and encoded in that order. Each task cuts its run of
documents into segments of about ``SEGMENT_IDS`` ids and writes them as Parquet rows (the commit
protocol of Spark makes the files whole after lost executors). A segment holds

``part, seg``     the place in the order
``before``        ids of the same part before this segment
``n_docs, n_ids`` sizes
``doc_ids``       the document ids, little-endian 64 bits, null ids by a bitmap in ``null_ids``
``ids``           all ids, little-endian, 16 or 32 bits as ``width`` says
``low, high, hints`` the ``n_docs`` ends of documents, coded by :func:`encode_bounds`

The ends need about 2 + log2(ids per document) bits each instead of 64. Select finds the k-th end
from a hint every 256 set bits and a scan of a few bytes.

Encoding: the byte-level split never joins a non-blank with a blank that follows, so words between
single blanks are encoded once by the tokenizers library and kept in a bounded table; texts in
which two blanks meet or that hold the literal of an added token go to the library whole. Arrow splits
a round of texts into words, finds those that the table lacks and joins the ids, so that Python handles
no single known word. Tests hold all of it against whole texts.

Defined cases: a null text is an empty one (the end id alone); null ``doc_id`` rows come first;
rows with equal ``doc_id`` are ordered by their text; an empty table gives no segment.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

END_ID = 2
SEGMENT_IDS = 1 << 20
HINT_EVERY = 256
#: A worker keeps at most so many words (and bytes of them) besides those of its last round of texts.
MAX_WORDS = 1_000_000
MAX_WORD_BYTES = 1 << 25
#: How byte-level vocabularies write a blank.
BLANK = "\u0120"
#: Unknown words that are encoded as one text.
JOINED_WORDS = 250
#: Bytes of text that are split into words at once; a longer text is a round of its own.
ROUND_BYTES = 1 << 23
SEGMENT_SCHEMA = (
    "part int, seg int, before long, n_docs int, n_ids long, width int, doc_ids binary, null_ids binary, "
    "ids binary, low_bits int, low binary, high binary, hints binary"
)
#: What Python takes for white space, for Arrow's expressions.
_SPACE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_BLANKS_MEET = f"{_SPACE} (?:{_SPACE}|$)"
_ODD_WORD = f"^(?:{_SPACE}|$)|{_SPACE}$"
_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def encode_bounds(ends: np.ndarray, universe: int) -> tuple[int, bytes, bytes, bytes]:
    """(low bits, packed low parts, unary high parts, select hints) of non-decreasing ends up to ``universe``."""
    n = len(ends)
    low_bits = max(0, int(universe // max(1, n)).bit_length() - 1)
    ends = ends.astype(np.uint64)
    low = (ends[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
    ones = (ends >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
    bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
    bits[ones] = 1
    return (
        low_bits,
        np.packbits(low.astype(np.uint8).ravel(), bitorder="little").tobytes(),
        np.packbits(bits, bitorder="little").tobytes(),
        ones[::HINT_EVERY].astype("<u4").tobytes(),
    )


class Bounds:
    """Select over coded ends."""

    def __init__(self, low_bits: int, low: bytes, high: bytes, hints: bytes, n: int):
        self.low_bits, self.n = low_bits, n
        self.low = np.frombuffer(low, np.uint8)
        self.high = np.frombuffer(high, np.uint8)
        self.hints = np.frombuffer(hints, "<u4")

    def select(self, k: int) -> int:
        """The k-th end, from the nearest hint before it."""
        if not 0 <= k < self.n:
            raise IndexError(k)
        place = int(self.hints[k // HINT_EVERY])
        wanted = k % HINT_EVERY + 1
        byte = place >> 3
        seen = -int(_POPCOUNT[self.high[byte] & ((1 << (place & 7)) - 1)])
        while seen + int(_POPCOUNT[self.high[byte]]) < wanted:
            seen += int(_POPCOUNT[self.high[byte]])
            byte += 1
        inside = np.flatnonzero(np.unpackbits(self.high[byte : byte + 1], bitorder="little"))
        place = byte * 8 + int(inside[wanted - seen - 1])
        first = k * self.low_bits
        span = np.unpackbits(self.low[first >> 3 : (first + self.low_bits + 7) >> 3], bitorder="little")
        value = span[first & 7 : (first & 7) + self.low_bits]
        return ((place - k) << self.low_bits) | int(value.astype(np.int64) @ (1 << np.arange(self.low_bits)))

    def all(self) -> np.ndarray:
        """Every end, in one vectorised step."""
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n] - np.arange(self.n)
        bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
        return (places << self.low_bits) | (bits.astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64)))


class WordEncoder:
    """Ids of whole texts, packed; words that come again are looked up.

    ``words`` holds distinct words and ``ids`` the ids of each after a blank. Once there are too many,
    only the words of the last round are kept, so the frequent ones stay.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        literals = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = "|".join([_BLANKS_MEET, *("".join(f"\\x{{{ord(c):x}}}" for c in x) for x in literals if x)])
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        tokens = self.tokenizer.get_vocab(with_added_tokens=True)
        self.opens = np.zeros(max(tokens.values()) + 1, bool)
        self.opens[[i for token, i in tokens.items() if token.startswith(BLANK)]] = True
        self.words, self.ids = pa.array([], pa.string()), pa.array([], pa.binary())

    def _library(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)

    def _learn(self, fresh: pa.Array) -> pa.Array:
        """Ids of distinct words. Many are encoded as one text, as a word begins at each token that begins
        with a blank; words with blanks of their own are encoded alone."""
        odd = pc.match_substring_regex(fresh, _ODD_WORD).to_numpy(zero_copy_only=False)
        plain = fresh.filter(pa.array(~odd))
        cuts = np.append(np.arange(0, len(plain), JOINED_WORDS), len(plain))
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), plain), " ").to_pylist()
        found: list[np.ndarray] = []
        sizes: list[np.ndarray] = []

        def alone(words: list[str]) -> None:
            ids = [self._library(" " + w) for w in words]
            found.extend(ids)
            sizes.append(np.array([len(i) for i in ids], np.int64))

        for text, n in zip(texts, np.diff(cuts).tolist()):
            ids = self._library(" " + text)
            begins = np.flatnonzero(self.opens[ids])
            if len(begins) == n:
                found.append(ids)
                sizes.append(np.diff(begins, append=len(ids)))
            else:
                alone(text.split(" "))
        alone(fresh.filter(pa.array(odd)).to_pylist())
        ends = np.cumsum(np.concatenate([[0], *sizes])) * self.kind.itemsize
        data = np.concatenate([np.empty(0, self.kind), *found]).tobytes()
        learned = pa.BinaryArray.from_buffers(
            pa.binary(), len(fresh), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)]
        )
        back = np.empty(len(fresh), np.int64)
        back[np.argsort(odd, kind="stable")] = np.arange(len(fresh))
        return learned.take(pa.array(back))

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Packed ids of each text."""
        texts = (pa.array(texts, pa.string()) if isinstance(texts, list) else texts).cast(pa.string())
        whole = pc.match_substring_regex(texts, self.whole)
        split = pc.split_pattern(pc.if_else(whole, "", texts), " ")
        begins, words = split.offsets.to_numpy(), split.flatten()
        # the first word of a text has no blank before it; whole texts take its place
        first = np.zeros(len(words), bool)
        first[begins[:-1]] = True
        heads = pc.if_else(whole, texts, words.filter(pa.array(first))).to_pylist()
        n = len(self.words)
        coded = pa.concat_arrays([self.words, words.filter(pa.array(~first))]).dictionary_encode()
        later = coded.indices.to_numpy()[n:]
        self.words, self.ids = coded.dictionary, pa.concat_arrays([self.ids, self._learn(coded.dictionary.slice(n))])
        place = np.empty(len(words), np.int64)
        place[~first] = later
        place[first] = len(self.ids) + np.arange(len(heads))
        apart = pa.array([self._library(h).tobytes() for h in heads], pa.binary())
        ids = pa.concat_arrays([self.ids, apart]).take(pa.array(place))
        if len(self.words) > MAX_WORDS or self.words.nbytes > MAX_WORD_BYTES:
            last = pa.array(np.flatnonzero(np.bincount(later, minlength=len(self.words))))
            self.words, self.ids = self.words.take(last), self.ids.take(last)
        return pc.binary_join(pa.ListArray.from_arrays(split.offsets, ids), b"").to_pylist()


def rounds(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Where runs of about ``ROUND_BYTES`` of texts begin, and how many texts each has."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(ends // ROUND_BYTES)) + 1).tolist(), len(texts)]
    return ((a, b - a) for a, b in zip(cuts, cuts[1:]) if b > a)


_ENCODERS: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    """The encoder of a tokenizer file, kept for the life of the worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _segment(part: int, seg: int, before: int, keys: list[int | None], docs: list[bytes], kind: np.dtype) -> dict:
    ends = np.cumsum([len(d) // kind.itemsize for d in docs])
    low_bits, low, high, hints = encode_bounds(ends, int(ends[-1]))
    return {
        "part": part, "seg": seg, "before": before, "n_docs": len(docs), "n_ids": int(ends[-1]),
        "width": kind.itemsize, "doc_ids": np.array([k or 0 for k in keys], "<i8").tobytes(),
        "null_ids": np.packbits([k is None for k in keys]).tobytes() if None in keys else b"",
        "ids": b"".join(docs), "low_bits": low_bits, "low": low, "high": high, "hints": hints,
    }


def _schema() -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in SEGMENT_SCHEMA.split(", "))])


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, segment_ids: int = SEGMENT_IDS
) -> None:
    """Encode ``doc_id, text`` and write the segments under ``path`` in ascending order of ``doc_id``."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        part, end = TaskContext.get().partitionId(), np.array([end_id], encoder.kind).tobytes()
        seg = before = held = 0
        keys: list[int | None] = []
        done: list[bytes] = []

        def close() -> pa.RecordBatch:
            nonlocal seg, before, held, keys, done
            row = _segment(part, seg, before, keys, done, encoder.kind)
            seg, before, held, keys, done = seg + 1, before + row["n_ids"], 0, [], []
            return pa.RecordBatch.from_pylist([row], _schema())

        for batch in batches:
            texts = pc.fill_null(batch["text"], "")
            for at, n in rounds(texts):
                ids = encoder.encode(texts.slice(at, n))
                for key, packed in zip(batch["doc_id"].slice(at, n).to_pylist(), ids):
                    keys.append(key)
                    done.append(packed + end)
                    held += len(packed) // encoder.kind.itemsize + 1
                    if held >= segment_ids:
                        yield close()
        if keys:
            yield close()

    (
        docs.select(F.col("doc_id").cast("long"), "text")
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(encode, SEGMENT_SCHEMA)
        .write.option("compression", "zstd").parquet(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, ids`` (little-endian, 32 bits) of every document in the files at ``path``.

    Starts add up the sizes of the parts before (one number a part passes through the driver), of
    the segments before and of the documents before.
    """
    stored = spark.read.parquet(path)
    sizes = dict(stored.groupBy("part").agg(F.sum("n_ids")).collect())
    parts = sorted(sizes)
    base = dict(zip(parts, accumulate([0, *(sizes[p] for p in parts)])))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n = row["n_docs"]
                ends = Bounds(row["low_bits"], row["low"], row["high"], row["hints"], n).all()
                ids = np.frombuffer(row["ids"], f"<u{row['width']}").astype("<u4").tobytes()
                cuts = [0, *ends.tolist()]
                keys = np.frombuffer(row["doc_ids"], "<i8")
                null = np.unpackbits(np.frombuffer(row["null_ids"], np.uint8))[:n].astype(bool) if row["null_ids"] else None
                start = base[row["part"]] + row["before"]
                yield pa.record_batch(
                    [
                        pa.array(keys, pa.int64(), mask=null),
                        pa.array(start + np.array(cuts[:-1], np.int64)),
                        pa.array([ids[4 * a : 4 * b] for a, b in zip(cuts, cuts[1:])], pa.binary()),
                    ],
                    ["doc_id", "start", "ids"],
                )

    return stored.mapInArrow(unpack, "doc_id long, start long, ids binary")


def token_report(docs: DataFrame, path: str, tokenizer: str) -> DataFrame:
    """Write the files, read them back, and digest each document: start, number of ids, CRC of the ids."""
    write_tokens(docs, path, tokenizer)
    back = read_tokens(docs.sparkSession, path)
    return back.select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").cast("long").alias("ids_crc32"),
    )


def crc_of(ids: list[int]) -> int:
    """CRC of ids as little-endian 32-bit numbers."""
    return zlib.crc32(np.array(ids, "<u4").tobytes())

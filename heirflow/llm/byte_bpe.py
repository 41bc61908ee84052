"""Byte-level BPE over ranks, with long texts cut into overlapping chunks.

A text up to ``CHUNK_BYTES`` is one piece. A longer one is cut into chunks that overlap by
``OVERLAP_BYTES`` and are split into pre-tokens in parallel, each from its own start. A split only
looks ahead, so two splits that share one boundary agree from there on: the first boundary that two
neighbouring chunks share in their overlap is where the text is cut (the last pre-tokens of a chunk
don't count, as its end may cut them short). Where no boundary is shared, the two chunks stay one
piece. The pieces are then encoded in parallel and their ids joined in order. Decoding joins the
bytes of the ids.

Defined cases: null and empty texts have no ids; a ``doc_id`` may repeat (pieces are joined by id,
hash and length of the text, and equal rows are counted); an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

CHUNK_BYTES = 1 << 16
OVERLAP_BYTES = 1 << 11
#: Boundaries this near to the end of a chunk may come from cutting it there.
END_BYTES = 1 << 9

_ENCODINGS: dict[str, tiktoken.Encoding] = {}


def encoding(path: str, pattern: str = public_tokenizers.PATTERN) -> tiktoken.Encoding:
    """The encoding of a rank file, kept for the life of the process."""
    if path not in _ENCODINGS:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _ENCODINGS[path] = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def boundaries(chunk: bytes, pattern: str = public_tokenizers.PATTERN) -> np.ndarray:
    """Byte offsets in ``chunk`` where pre-tokens start when it is split from its first whole character."""
    head = next((i for i, b in enumerate(chunk[:4]) if b & 0xC0 != 0x80), 0)
    text = chunk[head:].decode("utf-8", "ignore")
    starts = np.fromiter((m.start() for m in regex.compile(pattern).finditer(text)), np.int64)
    if text.isascii():
        return starts + head
    width = np.fromiter((len(c.encode()) for c in text), np.int64, len(text))
    return (np.cumsum(width) - width)[starts] + head


def cut_points(chunks: list[tuple[int, list[int], list[int]]]) -> list[int]:
    """Where the chunks of one text are cut: ``(number, boundaries near its start, near its end)``, as text offsets.

    The cut between two chunks is the first boundary both have in their overlap.
    """
    ordered = sorted(chunks)
    cuts = [0]
    for (_, _, tail), (_, head, _) in zip(ordered, ordered[1:]):
        shared = sorted(set(tail) & set(head))
        if shared:
            cuts.append(shared[0])
    return cuts


def _digest(text: str | None, coder: tiktoken.Encoding) -> tuple[int, str, str]:
    """One text at a time, as ids in Python take many times the bytes of the text."""
    ids = coder.encode_ordinary(text or "")
    packed = np.array(ids, "<u4").tobytes()
    return len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(coder.decode_bytes(ids)).hexdigest()


def encode_column(text: Column, ranks: str) -> Column:
    """Ids of each whole text as an array of ints; for texts of one piece."""

    @pandas_udf("array<int>")
    def encode(texts: pd.Series) -> pd.Series:
        coder = encoding(ranks)
        return pd.Series([coder.encode_ordinary(t or "") for t in texts])

    return encode(text)


def decode_column(ids: Column, ranks: str) -> Column:
    """Bytes of each array of ids."""

    @pandas_udf("binary")
    def decode(arrays: pd.Series) -> pd.Series:
        coder = encoding(ranks)
        return pd.Series([coder.decode_bytes([int(i) for i in a]) for a in arrays])

    return decode(ids)


def _pieces(long_texts: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """``doc_id, key, piece, body`` of each distinct long text, cut where neighbouring chunks resynchronise."""
    body = F.col("text").cast("binary")
    keyed = long_texts.select("doc_id", "key", body.alias("body"))
    last = F.ceil(F.octet_length("body") / chunk).cast("int") - 1
    chunks = keyed.withColumn("number", F.explode(F.sequence(F.lit(0), last))).select(
        "doc_id", "key", "number", F.octet_length("body").alias("size"),
        F.expr(f"substring(body, number * {chunk} + 1, {chunk + overlap})").alias("body"),
    )
    schema = "doc_id long, key struct<h: long, n: int>, number int, head array<long>, tail array<long>"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, tails = [], []
            for number, size, data in zip(*(batch[c].to_pylist() for c in ("number", "size", "body"))):
                at = boundaries(data)
                sure = at if number * chunk + len(data) >= size else at[at < len(data) - min(END_BYTES, overlap // 4)]
                heads.append((at[at < overlap] + number * chunk).tolist())
                tails.append((sure[sure >= chunk] + number * chunk).tolist())
            columns = [batch["doc_id"], batch["key"], batch["number"], pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))]
            yield pa.record_batch(columns, ["doc_id", "key", "number", "head", "tail"])

    @pandas_udf("array<long>")
    def cuts(marks: pd.Series) -> pd.Series:
        return pd.Series([cut_points([(m["number"], list(m["head"]), list(m["tail"])) for m in one]) for one in marks])

    found = (
        chunks.repartition("doc_id", "number").mapInArrow(scan, schema)
        .groupBy("doc_id", "key").agg(F.collect_list(F.struct("number", "head", "tail")).alias("marks"))
        .select(F.col("doc_id").alias("d"), F.col("key").alias("k"), cuts("marks").alias("cuts"))
    )
    placed = keyed.join(found, keyed.doc_id.eqNullSafe(F.col("d")) & (keyed.key == F.col("k")))
    return placed.select("doc_id", "key", "body", "cuts", F.posexplode("cuts").alias("piece", "cut")).select(
        "doc_id", "key", "piece",
        F.expr("substring(body, cast(cut + 1 AS int), cast(coalesce(get(cuts, piece + 1), octet_length(body)) - cut AS int))").alias("body"),
    )


def bpe_report(docs: DataFrame, ranks: str, chunk: int = CHUNK_BYTES, overlap: int = OVERLAP_BYTES) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row: encoded, joined and decoded again."""
    given = docs.select(
        F.col("doc_id").cast("long"), "text",
        F.struct(F.xxhash64("text").alias("h"), F.coalesce(F.octet_length("text"), F.lit(-1)).alias("n")).alias("key"),
    )
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(ranks)
        for batch in batches:
            found = [_digest(t.as_py(), coder) for t in batch["text"]]
            n, ids, decoded = zip(*found) if found else ((), (), ())
            yield pa.record_batch([batch["doc_id"], pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names)

    short = given.where(F.col("key.n") <= chunk).select("doc_id", "text").mapInArrow(whole, schema)

    def by_piece(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(ranks)
        for batch in batches:
            packed, decoded = [], []
            for body in batch["body"]:
                ids = coder.encode_ordinary(body.as_py().decode())
                packed.append(np.array(ids, "<u4").tobytes())
                decoded.append(coder.decode_bytes(ids))
            columns = [batch["doc_id"], batch["key"], batch["piece"], pa.array(packed, pa.binary()), pa.array(decoded, pa.binary())]
            yield pa.record_batch(columns, ["doc_id", "key", "piece", "ids", "bytes"])

    long_rows = given.where(F.col("key.n") > chunk)
    texts = long_rows.dropDuplicates(["doc_id", "key"])
    coded = _pieces(texts, chunk, overlap).repartition("doc_id", "piece").mapInArrow(
        by_piece, "doc_id long, key struct<h: long, n: int>, piece int, ids binary, bytes binary"
    )
    joined = coded.groupBy("doc_id", "key").agg(F.sort_array(F.collect_list(F.struct("piece", "ids", "bytes"))).alias("p"))
    ids = F.expr("aggregate(p.ids, cast('' AS binary), (a, x) -> concat(a, x))")
    decoded = F.expr("aggregate(p.bytes, cast('' AS binary), (a, x) -> concat(a, x))")
    times = long_rows.groupBy("doc_id", "key").count().select(F.col("doc_id").alias("d"), F.col("key").alias("k"), "count")
    digests = joined.select("doc_id", "key", ids.alias("ids"), decoded.alias("bytes")).select(
        "doc_id", "key", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"),
    )
    again = digests.join(times, digests.doc_id.eqNullSafe(F.col("d")) & (digests.key == F.col("k")))
    repeated = again.withColumn("_", F.explode(F.expr("array_repeat(0, cast(count AS int))"))).select(*names)
    return short.unionByName(repeated)

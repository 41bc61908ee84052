"""Personal data: fixed patterns, and terms whose company in the corpus gives a protected value away.

Base spans are emails, IPv4 addresses, payment cards and phone numbers. Each value names protected
entities: the value itself, and what recurs in several values (the name and the domain of an email, the
network of an address, the issuer of a card, the first digits of a phone number). Terms (words of ``MIN_LETTERS`` letters
or more) within ``CONTEXT_WORDS`` words of a value are judged by information theory over the whole corpus:

    disclosure(term, entity) = PMI(term; entity) / -log2 p(entity) = 1 + log2 p(entity | term) / -log2 p(entity)

with p(entity) the share of documents that hold the entity, and p(entity | term) the share of the
documents with the term in which it stands near the entity. A part of a value is judged once more among the
documents that hold a value of its kind, so that a word that only announces an address does not count as
telling its domain. A term at ``THRESHOLD`` or more whose company is proven is a span of kind ``term`` wherever it
stands near that entity; masking generalises it to a placeholder. Terms only add spans, base spans stay.

One document proves nothing: the word was picked because it stands there. With k the number of different
contexts (copies of a text are one) or of different documents, whichever is less, k must be 2 at least and beyond chance: if each
of the ``df`` documents with the term held the entity with p(entity), k or more of them would do so with a
probability of at most exp(-df KL(k / df || p(entity))) (Chernoff), and this bound times the number of all pairs of an
entity and a term near it must not exceed ``CHANCE``. The bound is least where df = k, so pairs that fail even there are left out before
terms are counted, and none of them is lost.

The text is read once for spans and contexts; those narrow rows are stored, counted and joined by
Spark. A second pass counts documents for the candidate terms alone: up to ``MAX_TERMS`` of them are
broadcast, more are counted by shuffling all terms, with the same counts.

Defined cases: a null text has no spans; offsets are code points; repeated rows keep a result each
and count as documents but not as contexts; empty tables give empty results; other columns are
ignored, or carried along by :func:`mask`.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heirflow.llm.tables import stored

KINDS = ("email", "ip", "card", "phone", "term")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
TERM = re.compile(r"[^\W\d_]+")

CONTEXT_WORDS = 8
MIN_LETTERS = 3
MIN_CONTEXTS = 2
CHANCE = 0.05
THRESHOLD = 0.75
MAX_TERMS = 200_000

FOUND_SCHEMA = (
    "doc_id long, h long, n int, base array<struct<start: int, kind: int, stop: int>>, "
    "near array<struct<value: string, term: string, context: long, start: int, stop: int>>"
)


def _luhn(digits: list[int]) -> bool:
    doubled = (d if k % 2 == 0 else 2 * d - 9 * (d > 4) for k, d in enumerate(reversed(digits)))
    return sum(doubled) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the fixed patterns, sorted; leftmost matches that don't overlap in a kind."""
    spans = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL_CHARS:
            start -= 1
        rest = DOMAIN.match(text, at) if start < at else None
        if rest:
            last = rest.end()
            spans.append((start, 0, last))
        at = text.find("@", at + 1)
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                spans.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = [ord(c) - 48 for c in m[0] if c not in " -"]
                if 14 <= len(digits) <= 19 and _luhn(digits):
                    spans.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= len(DIGIT.findall(m[0])) <= 15:
                    spans.append((m.start(), 3, m.end()))
    spans.sort()
    return spans


def near_terms(text: str, spans: list[tuple[int, int, int]]) -> list[dict]:
    """Terms around each span: value, term, hash of the whole context, place."""
    out = []
    found = [(m.start(), m.end()) for m in TERM.finditer(text)]
    starts, ends = [a for a, _ in found], [b for _, b in found]
    for start, kind, stop in spans:
        value = f"{KINDS[kind]}:{text[start:stop].lower()}"
        before, after = bisect_left(starts, start), bisect_right(ends, stop)
        # a word that reaches into the span ends or begins at its edge
        places = [(a, min(b, start)) for a, b in found[max(0, before - CONTEXT_WORDS) : before]]
        places += [(max(a, stop), b) for a, b in found[after : after + CONTEXT_WORDS]]
        words = [(text[a:b].lower(), a, b) for a, b in places]
        context = int.from_bytes(_hash8(" ".join(w for w, _, _ in words)), "little", signed=True)
        for word, a, b in words:
            if len(word) >= MIN_LETTERS and not any(s < b and a < e for s, _, e in spans):
                out.append({"value": value, "term": word, "context": context, "start": a, "stop": b})
    return out


def _hash8(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest()


def scan(docs: DataFrame) -> DataFrame:
    """Base spans and the terms near them of every row, with a key of the text instead of the text."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([
            ("base", pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("stop", pa.int32())]))),
            ("near", pa.list_(pa.struct([
                ("value", pa.string()), ("term", pa.string()), ("context", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()),
            ]))),
        ])
        for batch in batches:
            base, near = [], []
            for text in batch["text"].to_pylist():
                spans = base_spans(text) if text else []
                base.append([{"start": a, "kind": k, "stop": b} for a, k, b in spans])
                near.append(near_terms(text, spans) if spans else [])
            columns = [batch["doc_id"], batch["h"], batch["n"], pa.array(base, kinds.field("base").type), pa.array(near, kinds.field("near").type)]
            yield pa.record_batch(columns, ["doc_id", "h", "n", "base", "near"])

    keyed = docs.select(
        F.col("doc_id").cast("long"), F.xxhash64("text").alias("h"),
        F.coalesce(F.octet_length("text"), F.lit(-1)).alias("n"), "text",
    )
    return keyed.mapInArrow(find, FOUND_SCHEMA)


def document_frequency(docs: DataFrame, terms: DataFrame, max_terms: int = MAX_TERMS) -> DataFrame:
    """``term, df``: documents that hold each of ``terms`` as a word, over all ``docs``."""
    some = [r[0] for r in terms.limit(max_terms + 1).collect()]
    wanted = docs.sparkSession.sparkContext.broadcast(frozenset(some)) if len(some) <= max_terms else None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter[str] = Counter()
            for text in batch["text"].to_pylist():
                words = TERM.findall(text.lower()) if text else []
                seen.update(wanted.value.intersection(words) if wanted else set(words))
            yield pa.record_batch([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["term", "c"])

    counted = docs.select("text").mapInArrow(count, "term string, c long").groupBy("term").agg(F.sum("c").alias("df"))
    return counted if wanted else counted.join(terms, "term", "left_semi")


def entities() -> Column:
    """The entities that the ``value`` of a span names, itself first."""
    value = F.col("value")
    kind, rest = F.split_part(value, F.lit(":"), F.lit(1)), F.substring_index(value, ":", -1)
    digits = F.regexp_replace(rest, "[^0-9]", "")
    parts = {
        "email": F.array(
            F.concat(F.lit("email-name:"), F.substring_index(rest, "@", 1)), F.concat(F.lit("email-domain:"), F.substring_index(rest, "@", -1))
        ),
        "ip": F.array(F.concat(F.lit("ip-net:"), F.substring_index(rest, ".", 3))),
        "card": F.array(F.concat(F.lit("card-issuer:"), F.left(digits, F.lit(6)))),
        "phone": F.array(F.concat(F.lit("phone-area:"), F.left(digits, F.lit(6)))),
    }
    some = F.array().cast("array<string>")
    for name, found in parts.items():
        some = F.when(kind == name, found).otherwise(some)
    return F.concat(F.array(value), some)


def _near(found: DataFrame, *extra: str) -> DataFrame:
    """One row a term and entity near each other, with ``kind`` of the value and whether the entity is it ``whole``."""
    near = found.select(*extra, "doc_id", "h", F.explode("near").alias("x")).select(
        *extra, "doc_id", "h", "x.value", "x.term", "x.context", "x.start", "x.stop"
    )
    return near.withColumn("entity", F.explode(entities())).select(
        *extra, "doc_id", "h", F.split_part("value", F.lit(":"), F.lit(1)).alias("kind"), "entity", "term", "context", "start", "stop",
        (F.col("entity") == F.col("value")).alias("whole"),
    )


def _chance(k: Column, n: Column, share: Column) -> Column:
    """Log of the bound on the chance that k or more of n documents hold what a share of all does; 0 where k is no more than expected."""
    rest = F.when(n > k, (n - k) * F.log((n - k) / (n * (1 - share)))).otherwise(0.0)
    return F.when(k > n * share, -(k * F.log(k / (n * share)) + rest)).otherwise(0.0)


def disclosing(docs: DataFrame, found: DataFrame, threshold: float = THRESHOLD, max_terms: int = MAX_TERMS) -> DataFrame:
    """``value, term, disclosure`` of the pairs of an entity and a term at or over the threshold."""
    near = _near(found)
    rows = found.count()
    one = F.count(F.lit(1))
    documents = near.select("kind", "entity", "whole", "term", "doc_id", "h").distinct()
    together = documents.groupBy("kind", "entity", "whole", "term").agg(one.alias("both"))
    contexts = near.select("entity", "term", "context").distinct().groupBy("entity", "term").agg(one.alias("contexts"))
    holders = near.select("entity", "doc_id", "h").distinct().groupBy("entity").agg(one.alias("holders"))
    tested = together.count()
    chance = F.log(F.lit(CHANCE / max(tested, 1)))
    share = F.col("holders") / F.lit(rows)
    counted = together.join(contexts, ["entity", "term"]).join(holders, "entity").withColumn("k", F.least("contexts", "both"))
    pairs = stored(counted.where((F.col("k") >= MIN_CONTEXTS) & (F.col("k") * F.log(share) <= chance)), "pii-pairs")
    if pairs.isEmpty():
        return pairs.select(F.col("entity").alias("value"), "term", F.lit(0.0).alias("disclosure"))
    frequency = document_frequency(docs, pairs.select("term").distinct(), max_terms)
    # the same question among the documents with a value of the kind, for parts of values
    of_kind = near.select("kind", "doc_id", "h").distinct().groupBy("kind").agg(one.alias("kind_holders"))
    near_kind = near.select("kind", "term", "doc_id", "h").distinct().groupBy("kind", "term").agg(one.alias("kind_both"))

    def told(both: Column, n: Column, p: Column) -> Column:
        return 1 + F.log2(F.least(both / n, F.lit(1.0))) / -F.log2(p)

    k, df, both = F.col("k"), F.greatest("df", "k"), F.col("both")
    part_share, among = F.col("holders") / F.col("kind_holders"), F.greatest("kind_both", "k")
    of_part = (part_share < 1) & (told(both, among, part_share) >= threshold) & (_chance(k, among, part_share) <= chance)
    return (
        pairs.join(frequency, "term").join(F.broadcast(of_kind), "kind").join(near_kind, ["kind", "term"])
        .where((share < 1) & (_chance(k, df, share) <= chance)).where(F.col("whole") | of_part)
        .withColumn("disclosure", told(both, F.col("df"), share))
        .where(F.col("disclosure") >= threshold).select(F.col("entity").alias("value"), "term", "disclosure")
    )


def with_terms(docs: DataFrame, threshold: float = THRESHOLD, max_terms: int = MAX_TERMS) -> DataFrame:
    """``doc_id, h, n, base, spans`` of every row, spans sorted by start, then kind."""
    found = stored(scan(docs), "pii-found")
    pairs = stored(disclosing(docs, found, threshold, max_terms), "pii-disclosing")
    keyed = found.withColumn("row", F.monotonically_increasing_id())
    near = _near(keyed, "row").withColumnRenamed("entity", "value")
    spans = (
        near.join(pairs, ["value", "term"], "left_semi")
        .groupBy("row").agg(F.collect_set(F.struct("start", F.lit(4).alias("kind"), "stop")).alias("terms"))
    )
    none = F.array().cast("array<struct<start: int, kind: int, stop: int>>")
    return keyed.join(spans, "row", "left").select(
        "doc_id", "h", "n", "base", F.sort_array(F.concat("base", F.coalesce("terms", none))).alias("spans")
    )


def _written(spans: str):
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ","
    )


def pii_report(docs: DataFrame) -> DataFrame:
    """Counts, digest of base spans, and all spans of every row."""
    found = with_terms(docs)
    counts = [
        F.expr(f"cast(size(filter(base, s -> s.kind = {k})) AS long) AS n_{name}") for k, name in enumerate(KINDS[:4])
    ]
    return found.select(
        "doc_id", *counts, F.sha2(_written("base").cast("binary"), 256).alias("base_sha256"), _written("spans").alias("spans")
    )


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with each span, or run of overlapping spans, as the placeholder of its first kind."""
    out, end = [], 0
    for start, kind, stop in spans:
        if start >= end:
            out += [text[end:start], f"[{KINDS[kind].upper()}]"]
        end = max(end, stop)
    return "".join([*out, text[end:]])


def mask(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs``; spans in ``text`` are generalised to their kind.

    Base spans are found again in place; only the spans of terms are looked up, by id and text.
    """
    found = with_terms(docs).select(
        F.col("doc_id").alias("d"), F.col("h").alias("k"), F.col("n").alias("m"),
        F.filter("spans", lambda s: s["kind"] == 4).alias("terms"),
    )
    terms = stored(found.where(F.size("terms") > 0).dropDuplicates(["d", "k", "m"]), "pii-terms")
    keyed = docs.select(
        F.struct(*[docs[f"`{c}`"].alias(c) for c in docs.columns]).alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"),
        F.coalesce(F.octet_length("text"), F.lit(-1)).alias("n"),
    )
    same = keyed.doc_id.eqNullSafe(F.col("d")) & (F.col("h") == F.col("k")) & (F.col("n") == F.col("m"))
    joined = keyed.join(terms, same, "left").select(*[F.col("row")[c].alias(c) for c in docs.columns], F.col("terms").alias("_pii_terms"))
    at = docs.columns.index("text")

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, extra in zip(batch.column(at).to_pylist(), batch.column(len(docs_columns)).to_pylist()):
                spans = base_spans(text) if text else []
                spans = sorted(spans + [(s["start"], s["kind"], s["stop"]) for s in extra or []])
                texts.append(masked(text, spans) if spans else text)
            columns = [pa.array(texts, pa.string()) if k == at else batch.column(k) for k in range(len(docs_columns))]
            yield pa.record_batch(columns, docs_columns)

    docs_columns = docs.columns
    return joined.mapInArrow(replace, docs.schema)

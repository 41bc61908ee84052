"""Benchmark decontamination: a broadcast hash set of benchmark windows against all training windows.

Words are runs of ``WORD`` after A-Z are lowered. A window is ``window`` consecutive words of an
item; an item with fewer words, but some, is one window. The scan stays in generated code: each text
becomes one array of word hashes, each position one hash of the next words, probed in the broadcast
set. Hits are then verified on the words themselves, and only hits leave the scan.

The broadcast set has checked bounds, ``MAX_WINDOWS`` and ``MAX_BYTES`` of words and item names; a larger
benchmark is joined by shuffling the probes instead, which gives the same rows.

Defined cases: null texts have no words and are clean; items with null text or no word give no
window; a null ``item_id`` counts as the empty string in the digest; repeated items count once;
equal rows (same ``doc_id`` and text) get one result each; empty tables give no hit or no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heirflow.llm.tables import packed, stored, unpacked

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words before A-Z are lowered.
CASED_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10
#: Most windows that are broadcast, and most bytes of their words and items.
MAX_WINDOWS = 200_000
MAX_BYTES = 128 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    """A-Z in lower case and nothing else; texts of ASCII alone take the quicker way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, _UPPER, _LOWER)
    )


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(lowered(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def benchmark_windows(bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows: ``hash, size, window`` (its words) and ``items``, the items it occurs in."""
    split = bench.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("w"))
    size = F.least(F.size("w"), F.lit(window))
    starts = split.where(F.size("w") > 0).select(
        "item", "w", size.alias("size"), F.explode(F.sequence(F.lit(1), F.size("w") - size + 1)).alias("at")
    )
    return (
        starts.select("item", "size", F.slice("w", F.col("at"), F.col("size")).alias("window"))
        .groupBy("window", "size").agg(F.collect_set("item").alias("items"))
        .select(hash_of_hashes("window").alias("hash"), "size", "window", "items")
    )


def broadcast_bytes() -> Column:
    """Size of a window's row in the broadcast: words and item names with eight bytes of place each, and fixed columns."""
    return F.expr("64 + aggregate(concat(window, items), 0L, (a, x) -> a + octet_length(x) + 16)")


def hash_of_hashes(window: str) -> Column:
    """The hash that :func:`_probe` gives to the same words."""
    return F.expr(f"aggregate({window}, 42L, (a, x) -> xxhash64(a, xxhash64(x)))")


def _probe(hashes: str, at: str, size: int) -> Column:
    """Hash of ``size`` word hashes from position ``at``; nested, so that generated code has no loop."""
    value = F.lit(42).cast("long")
    for k in range(size):
        value = F.xxhash64(value, F.expr(f"get({hashes}, {at} + {k})"))
    return value


def hits(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row for each distinct (``doc_id``, text): ``n_words, spans`` (start and size of windows), ``items, rows``.

    The scan keeps its hits and one row for each text, so that texts without a hit come out too and
    the text is read once.
    """
    found = benchmark_windows(bench, window)
    totals = found.groupBy("size").agg(F.count(F.lit(1)), F.sum(broadcast_bytes())).collect()
    sizes = sorted(r[0] for r in totals) or [window]
    small = sum(r[1] for r in totals) <= MAX_WINDOWS and sum(r[2] for r in totals) <= MAX_BYTES
    split = docs.select(
        F.col("doc_id"), F.xxhash64("text").alias("h"), F.coalesce(F.octet_length("text"), F.lit(-1)).alias("n"),
        words(F.col("text")).alias("w"),
    )
    hashed = split.select("doc_id", "h", "n", "w", F.transform("w", lambda x: F.xxhash64(x)).alias("hs"))
    # -1 stands for the text itself; explode gives its row and one for each word
    placed = hashed.select("doc_id", "h", "n", "w", "hs", F.explode(F.sequence(F.lit(-1), F.size("hs") - 1)).alias("at"))
    if len(sizes) > 1:
        placed = placed.select("*", F.explode(F.array(*map(F.lit, sizes))).alias("size"))
    else:
        placed = placed.select("*", F.lit(sizes[0]).alias("size"))
    value = F.lit(None).cast("long")
    for s in sizes:
        fits = (F.col("size") == s) & (F.col("at") >= 0) & (F.col("at") + s <= F.size("hs"))
        value = F.when(fits, _probe("hs", "at", s)).otherwise(value)
    right = found.select(F.col("hash").alias("b_hash"), F.col("size").alias("b_size"), "window", "items")
    same = (F.col("hash") == F.col("b_hash")) & (F.col("size") == F.col("b_size"))
    key = ["doc_id", "h", "n"]
    if not small:
        # probes are shuffled without the words they stand for; hits go back to the words to be proven
        narrow = placed.where("at >= 0").select(*key, "at", "size", value.alias("hash")).where("hash IS NOT NULL").distinct()
        met = narrow.join(right, same).groupBy(*key).agg(F.collect_list(F.struct("at", "size", "window", "items")).alias("met"))
        met = met.withColumnsRenamed({c: f"m_{c}" for c in key})
        both = split.join(met, F.col("doc_id").eqNullSafe(F.col("m_doc_id")) & (F.col("h") == F.col("m_h")) & (F.col("n") == F.col("m_n")), "left")
        true = F.filter("met", lambda x: F.slice("w", x["at"] + 1, x["size"]) == x["window"])
        true = F.coalesce(true, F.array().cast("array<struct<at:int,size:int,window:array<string>,items:array<string>>>"))
        rows = both.select(*key, F.size("w").alias("words"), true.alias("met"))
        narrow = rows.select(
            *key, "words", F.explode_outer("met").alias("x")
        ).select(*key, "words", F.when(F.col("x").isNotNull(), F.struct("x.at", "x.size")).alias("span"), F.col("x.items").alias("items"))
        times = split.groupBy(*key).agg(F.count(F.lit(1)).alias("rows")).withColumnsRenamed({c: f"t_{c}" for c in key})
        grouped = narrow.groupBy(*key).agg(
            F.max("words").cast("long").alias("n_words"), F.sort_array(F.collect_set("span")).alias("spans"), F.collect_set("items").alias("item_sets")
        ).join(times, F.col("doc_id").eqNullSafe(F.col("t_doc_id")) & (F.col("h") == F.col("t_h")) & (F.col("n") == F.col("t_n")))
    else:
        probes = placed.select(*key, "w", "at", "size", value.alias("hash"))
        first = F.col("at") == -1 if len(sizes) == 1 else (F.col("at") == -1) & (F.col("size") == sizes[0])
        kept = probes.join(F.broadcast(right), same, "left").where(first | F.col("window").isNotNull())
        proven = F.col("window").isNotNull() & (F.slice("w", F.col("at") + 1, F.col("size")) == F.col("window"))
        narrow = kept.select(
            *key, F.when(first, F.size("w")).alias("words"),
            F.when(proven, F.struct("at", "size")).alias("span"), F.when(proven, F.col("items")).alias("items"),
        )
        grouped = narrow.groupBy(*key).agg(
            F.max("words").cast("long").alias("n_words"), F.sort_array(F.collect_set("span")).alias("spans"),
            F.collect_set("items").alias("item_sets"), F.count("words").alias("rows"),
        )
    items = F.array_sort(F.array_distinct(F.flatten("item_sets")))
    return grouped.select(*key, "n_words", "spans", items.alias("items"), "rows")


def covered(spans: str = "spans") -> Column:
    """Words inside any of the sorted spans, by their ends so far."""
    return F.expr(
        f"aggregate({spans}, named_struct('n', 0L, 'end', 0), (a, s) -> named_struct("
        "'n', a.n + greatest(0, s.at + s.size - greatest(a.end, s.at)), 'end', greatest(a.end, s.at + s.size))).n"
    )


def leak_report(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """Digest of the hits of every row."""
    found = hits(docs, bench, window).withColumn("n_hit", covered())
    return found.withColumn("_", F.explode(F.expr("array_repeat(0, cast(rows AS int))"))).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """All columns of the rows without a hit.

    The keys of texts with a hit are stored, so that Spark knows their size and shuffles the texts
    only if the keys are too many to broadcast.
    """
    keyed, found, same = _keyed_hits(docs, bench, window)
    return keyed.join(found.drop("spans"), same, "left_anti").select(*unpacked(docs, []))


def cut_contaminated(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """All rows; the hit words are taken out of ``text``, the rest stays as it is."""
    joined = _with_hits(docs, bench, window)
    own = F.regexp_extract_all(F.col("row.text"), F.lit(CASED_WORD), F.lit(0))
    gaps = F.split(F.col("row.text"), CASED_WORD, -1)
    kept = F.transform(
        F.col("own"),
        lambda x, i: F.when(
            F.exists("spans", lambda s: (s["at"] <= i) & (i < s["at"] + s["size"])), F.lit("")
        ).otherwise(x),
    )
    text = F.array_join(F.zip_with("gaps", kept, lambda g, w: F.concat(g, F.coalesce(w, F.lit("")))), "")
    cut = joined.select("row", "spans", own.alias("own"), gaps.alias("gaps")).select("row", "spans", text.alias("cut"))
    new = F.when(F.size("spans") == 0, F.col("row.text")).otherwise(F.col("cut"))
    return cut.select(*[new.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def _keyed_hits(docs: DataFrame, bench: DataFrame, window: int) -> tuple[DataFrame, DataFrame, Column]:
    """Rows with their key, stored spans of the texts with a hit, and the condition that joins them."""
    found = hits(docs, bench, window).where(F.size("spans") > 0).select(
        F.col("doc_id").alias("d"), F.col("h").alias("k"), F.col("n").alias("m"), "spans"
    )
    found = stored(found, "leaks")
    keyed = docs.select(
        packed(docs), F.col("doc_id"), F.xxhash64("text").alias("h"), F.coalesce(F.octet_length("text"), F.lit(-1)).alias("n")
    )
    return keyed, found, keyed.doc_id.eqNullSafe(F.col("d")) & (F.col("h") == F.col("k")) & (F.col("n") == F.col("m"))


def _with_hits(docs: DataFrame, bench: DataFrame, window: int) -> DataFrame:
    """``row, spans`` of every row; only texts with a hit are looked up."""
    keyed, found, same = _keyed_hits(docs, bench, window)
    none = F.array().cast("array<struct<at: int, size: int>>")
    return keyed.join(found, same, "left").select("row", F.coalesce("spans", none).alias("spans"))

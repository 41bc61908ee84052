"""Operators over a global order: running weights, ranks, weighted quantiles, resampling.

Spark's unpartitioned window puts every row into one task. Here rows first fall
into coarse buckets that follow the order and hold about equally many rows each.
Bucket totals are small, their running sum gives each bucket its offset, and the
exact work happens inside buckets. A value that many rows share is a bucket of
its own, split further by a digest of the record key, so a hot value spreads
over as many tasks as its share of the rows calls for.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heirflow.functions.arrays import count_below, doubles, integers
from heirflow.functions.draws import uniform
from heirflow.functions.nulls import required
from heirflow.operators.lookup import lookup_join, refuse_repeats, settle
from heirflow.sources.shared import materialise

MAX_BUCKETS = 10_000
#: Bits of a value that the first counting pass looks at (sign, exponent and four of the mantissa), and each later one.
FIRST_DIGITS, NEXT_DIGITS = 16, 6
ROWS_PER_BUCKET = 200
#: Draws of a resample that are broadcast to the rows, and their bytes.
MAX_SENT_DRAWS = 1_000_000
MAX_SENT_BYTES = 128 << 20
#: Rows, and draws, that meet in one bucket of a large resample, about.
DRAWS_PER_BUCKET = 100_000
DRAWN_FROM = "the table to draw from"

# Probabilities of the income breaks and labels of the bins between them.
RANK_PROBS = [i / 100 for i in range(100)] + [0.991, 0.993, 0.995, 0.997, 0.999]
RANK_LABELS = [i / 100 for i in range(1, 100)] + [0.992, 0.994, 0.996, 0.998, 1.0]


def bucket_count(spark: SparkSession, wanted: int = 0, rows: int | None = None) -> int:
    """Buckets for a table: enough for the shuffle partitions and for ``wanted`` places, none below
    ``ROWS_PER_BUCKET`` rows on average, within bounds that keep bucket tables small."""
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    most = max(4 * partitions, wanted)
    if rows is not None:
        most = min(most, rows // ROWS_PER_BUCKET)
    return max(32, min(MAX_BUCKETS, most))


@dataclass(frozen=True)
class Cuts:
    """Bucket limits: bucket i holds values in [limits[i], limits[i + 1])."""

    limits: list[float]
    parts: list[int]  # how many parts bucket i is split into; above 1 only for one repeated value

    @property
    def first_part(self) -> list[int]:
        return [0, *np.cumsum(self.parts[:-1]).tolist()]


def cuts_from_percentiles(percentiles: Sequence[float]) -> Cuts:
    """A percentile that comes up r times marks a value with about r bucketfuls of rows."""
    parts = {-np.inf: 1}
    values, repeats = np.unique(np.asarray(percentiles, dtype=float) + 0.0, return_counts=True)
    for value, repeat in zip(values.tolist(), repeats.tolist()):
        parts[value] = repeat
        if repeat > 1:
            parts[float(np.nextafter(value, np.inf))] = 1
    starts = sorted(parts)
    return Cuts([*starts, np.inf], [parts[s] for s in starts])


def with_bits(df: DataFrame, value: str, out: str) -> DataFrame:
    """Add a long that is ordered like the double ``value``: its IEEE bits, negated for negative numbers; null for NaN.

    Exponent and mantissa by exact arithmetic: a logarithm corrected by comparison, and division by a power of 2.
    """
    power = lambda e: F.pow(F.lit(2.0), e)
    size = F.when(~F.isnan(value), F.abs(F.col(value)))
    df = df.withColumn("_size", size).withColumn("_e", F.floor(F.log2("_size")).cast("double"))
    down, up = power(F.col("_e")) > F.col("_size"), power(F.col("_e") + 1) <= F.col("_size")
    df = df.withColumn("_e", F.greatest(F.col("_e") - down.cast("int") + up.cast("int"), F.lit(-1022.0)))
    mantissa = (F.col("_size") / power(F.col("_e")) * F.lit(float(1 << 52))).cast("long")
    bits = (F.col("_e") + 1022).cast("long") * F.lit(1 << 52) + mantissa
    bits = F.when(F.col("_size") == 0, F.lit(0).cast("long")).when(F.col("_size") == float("inf"), F.lit(0x7FF << 52)).otherwise(bits)
    return df.withColumn(out, F.when(F.col(value) < 0, -bits).otherwise(bits)).drop("_size", "_e")


def value_of_bits(bits: int) -> float:
    """The double that :func:`with_bits` gives these bits."""
    size = float(np.array([abs(bits)], np.int64).view(np.float64)[0])
    return -size if bits < 0 else size


def value_cuts(df: DataFrame, value: str, wanted: int = 0, buckets: int | None = None) -> Cuts:
    """Limits of buckets of about equally many rows, by counting digits; results do not depend on them.

    Rows are counted by the leading ``FIRST_DIGITS`` bits of their value. What holds more than a bucketful is
    counted again by ``NEXT_DIGITS`` more bits, until it is small or a single value: a fixed number of narrow passes over
    one column, exact for every distribution, without a sample. A pass brings at most one number for every bucket and digit
    to the driver. Read ``df`` from storage if it is expensive to compute.
    """
    spark = df.sparkSession
    bits = with_bits(df.select(F.col(value).cast("double").alias("v")).where("v IS NOT NULL"), "v", "_bits")
    shift = 64 - FIRST_DIGITS
    found = [F.count(F.lit(1)).alias("n"), F.min("_bits").alias("least"), F.max("_bits").alias("most"), F.count_if(F.isnan("v")).alias("nan")]

    def counted(rows: DataFrame) -> list:
        return rows.groupBy(F.shiftright("_bits", shift).alias("digit")).agg(*found).collect()

    parts = counted(bits)
    if sum(p["nan"] for p in parts):
        raise ValueError(f"{sum(p['nan'] for p in parts)} values of {value} are NaN")
    rows = sum(p["n"] for p in parts)
    buckets = buckets or bucket_count(spark, wanted, rows)
    full = max(1.0, rows / buckets)
    settled, heavy = [], parts
    while True:
        settled += [p for p in heavy if p["n"] <= full or p["least"] == p["most"]]
        heavy = [p for p in heavy if p["n"] > full and p["least"] < p["most"]]  # fewer than there are buckets
        if not heavy:
            break
        inside = spark.createDataFrame([(p["digit"],) for p in heavy], "digit long")
        before, shift = shift, max(0, shift - NEXT_DIGITS)
        heavy = counted(bits.join(F.broadcast(inside), F.shiftright("_bits", before) == F.col("digit"), "left_semi"))
    # neighbours are put together up to a bucketful; a value with r bucketfuls of rows comes r times
    marks, held = [], 0
    for p in sorted(settled, key=lambda p: p["least"]):
        hot = int(p["n"] // full) if p["least"] == p["most"] else 0
        if hot > 1:
            marks += [value_of_bits(p["least"])] * hot
            held = 0
        elif held and held + p["n"] > full:
            marks.append(value_of_bits(p["least"]))
            held = p["n"]
        else:
            held += p["n"]
    return cuts_from_percentiles(marks if marks else [0.0])


def _locate(df: DataFrame, value: str, limits: Sequence[float], out: str) -> DataFrame:
    return (
        Bucketizer(splits=list(limits), inputCol=value, outputCol=out)
        .transform(df)
        .withColumn(out, F.col(out).cast("int"))
    )


def _tie(key: Sequence[str]) -> Column:
    return uniform(*[F.col(k) for k in key], seed=0, draw="tie")


def _in_parts(df: DataFrame, value: str | None, cuts: Cuts | None, buckets: int) -> DataFrame:
    """Add ``_bucket``; expects ``_tie``."""
    if value is None:
        return df.withColumn("_bucket", F.floor(F.col("_tie") * F.lit(float(buckets))).cast("int"))
    df = df.withColumn("_value", F.col(value).cast("double"))
    df = _locate(df, "_value", cuts.limits, "_bucket").drop("_value")
    if max(cuts.parts) == 1:
        return df
    first = F.get(integers(cuts.first_part), F.col("_bucket"))
    parts = F.get(integers(cuts.parts), F.col("_bucket"))
    return df.withColumn("_bucket", (first + F.floor(F.col("_tie") * parts)).cast("int"))


@dataclass(frozen=True)
class Running:
    """Rows with ``cum_weight`` (inclusive), the weight of all rows, and bucket start weights."""

    rows: DataFrame
    total: float
    starts: list[float]


def running_weight(
    df: DataFrame,
    weight: str,
    key: Sequence[str],
    value: str | None = None,
    buckets: int | None = None,
) -> Running:
    """Running sum of ``weight`` in the order of ``value``, ties in digest order of ``key``.

    Without ``value`` the order is the digest order alone. Two passes over ``df``,
    and with ``value`` two more over that column; store an input that is expensive
    to compute.
    """
    cuts = value_cuts(df, value, buckets=buckets) if value else None
    buckets = buckets or bucket_count(df.sparkSession)
    df = df.withColumn("_w", required(F.col(weight).cast("double"), weight))
    if value:
        df = df.withColumn(value, required(F.col(value), value))
    df = _in_parts(df.withColumn("_tie", _tie(key)), value, cuts, buckets)

    # At most one number per bucket reaches the driver.
    sums = {r["_bucket"]: r["w"] for r in df.groupBy("_bucket").agg(F.sum("_w").alias("w")).collect()}
    sizes = [sums.get(b, 0.0) for b in range(max(sums, default=0) + 1)]
    ends = np.cumsum(sizes)
    starts = [0.0, *ends[:-1].tolist()]

    order = [value] if value else []
    within = (
        Window.partitionBy("_bucket")
        .orderBy(*order, "_tie", *key)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    start = F.get(doubles(starts), F.col("_bucket"))
    rows = df.withColumn("cum_weight", start + F.sum("_w").over(within))
    return Running(rows.drop("_w", "_tie", "_bucket"), float(ends[-1]), starts)


def weighted_rank(
    df: DataFrame,
    value: str,
    weight: str,
    key: Sequence[str],
    steps: int = 1000,
    out: str = "rank",
    buckets: int | None = None,
) -> DataFrame:
    """Cumulative weight share of each row in the order of ``value``, rounded to 1/steps.

    ``out`` is the integer numerator, so a join on it never compares doubles. The rank changes at
    no more than ``steps`` rows. Only value, weight and key of the buckets that hold such a row are
    shuffled; those rows come back as a constant array, in which every other row finds its rank by
    binary search, where it stands.
    """
    narrow = df.select(
        required(F.col(value), value).alias("_v"), required(F.col(weight).cast("double"), weight).alias("_w"),
        *[F.col(k) for k in key], _tie(key).alias("_tie"),
    )
    narrow = materialise(narrow)  # every later pass reads these columns alone
    cuts = value_cuts(narrow, "_v", 10 * steps, buckets)
    buckets = sum(cuts.parts)
    narrow = _in_parts(narrow, "_v", cuts, buckets)
    sums = {r["_bucket"]: r["w"] for r in narrow.groupBy("_bucket").agg(F.sum("_w").alias("w")).collect()}
    ends = np.cumsum([sums.get(b, 0.0) for b in range(max(sums, default=0) + 1)])
    starts, total = [0.0, *ends[:-1].tolist()], float(ends[-1])
    if not sums:
        return df.withColumn(out, F.lit(None).cast("int"))
    ranks = np.floor((2.0 * steps * ends + total) / (2.0 * total)) if total else np.zeros(len(ends))
    changes = np.diff(ranks, prepend=0.0) > 0

    within = Window.partitionBy("_bucket").orderBy("_v", "_tie", *key)
    so_far = F.sum("_w").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    start = F.get(doubles(starts), F.col("_bucket"))

    def rank_of(cum: Column) -> Column:
        return F.floor((F.lit(2.0 * steps) * cum + F.lit(total)) / F.lit(2.0 * total)).cast("int")

    placed = (
        narrow.where(F.get(integers(changes.tolist()), F.col("_bucket")) == 1)
        .withColumn("_cum", start + so_far)
        .withColumn("_before", F.coalesce(F.lag("_cum").over(within), start))
        .withColumn("_rank", rank_of(F.col("_cum")))
        .where(F.col("_rank") > rank_of(F.col("_before")))
    )
    found = sorted(
        (tuple(r) for r in placed.select("_v", "_tie", *key, "_rank").collect()), key=lambda r: r[-1]
    )
    kinds = [df.schema[c].dataType.simpleString() for c in (value, *key)]
    kinds.insert(1, "double")
    # one array a field, each of at most ``steps`` entries, searched together
    arrays = [_typed_array([r[i] for r in found], kind) for i, kind in enumerate(kinds)]
    row = [F.col(value), F.col("_tie"), *[F.col(k) for k in key]]
    df = df.withColumn("_tie", _tie(key)).withColumn("_place", F.lit(0))
    step = 1 << max(0, len(found).bit_length() - 1)
    while step and found:
        at = F.col("_place") + F.lit(step - 1)
        reached = F.lit(True)
        for array, own in reversed(list(zip(arrays, row))):
            entry = F.get(array, at)
            reached = (entry < own) | ((entry == own) & reached)
        df = df.withColumn("_place", F.col("_place") + F.when(reached, F.lit(step)).otherwise(F.lit(0)))
        step >>= 1
    label = F.get(integers([0, *[r[-1] for r in found]]), F.col("_place"))
    return df.withColumn(out, label).drop("_tie", "_place")


def _typed_array(values: Sequence, kind: str) -> Column:
    """Constant array of one type, parsed from text."""
    if kind == "double":
        return doubles(values)
    entries = ", ".join("'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values)
    return F.expr(f"cast(array({entries}) AS array<{kind}>)")


def weighted_quantiles(
    df: DataFrame,
    value: str,
    weight: str,
    probs: Sequence[float],
    by: Sequence[str] = (),
    buckets: int | None = None,
) -> DataFrame:
    """Quantiles with weights as repetition counts, all ``probs`` at once.

    With n = sum of weights and position 1 + (n - 1) p, interpolates between the
    values at the floor of the position and one further. Returns ``by``,
    ``prob_index``, ``prob``, ``quantile``. There are about ten buckets for each
    probability where the table is large enough for that, so that most rows lie
    outside the buckets with a wanted position and aren't shuffled.
    """
    by = list(by)
    df = materialise(df.select(
        *by,
        F.col(value).cast("double").alias("_value"),
        required(F.col(weight).cast("double"), weight).alias("_w"),
    ).where(F.col("_value").isNotNull() & (F.col("_w") > 0)))
    cuts = value_cuts(df, "_value", 10 * len(probs), buckets)
    bucketed = _locate(df, "_value", cuts.limits, "_bucket")

    ordered = Window.partitionBy(*by).orderBy("_bucket")
    limits = (
        bucketed.groupBy(*by, "_bucket")
        .agg(F.sum("_w").alias("_w"), F.max("_value").alias("_most"))
        .withColumn("_end", F.sum("_w").over(ordered))
        .withColumn("_start", F.coalesce(F.lag("_end").over(ordered), F.lit(0.0)))
        .withColumn("_n", F.max("_end").over(Window.partitionBy(*by)))
    )

    def two_positions(p: Column, i: Column) -> Column:
        position = F.lit(1.0) + (F.col("_n") - F.lit(1.0)) * p
        low = F.greatest(F.floor(position).cast("double"), F.lit(1.0))
        share = position - F.floor(position)
        return F.array(
            F.struct(
                i.alias("i"), p.alias("p"), F.least(low, F.col("_n")).alias("at"),
                (F.lit(1.0) - share).alias("share"),
            ),
            F.struct(
                i.alias("i"), p.alias("p"), F.least(low + F.lit(1.0), F.col("_n")).alias("at"),
                share.alias("share"),
            ),
        )

    # Only probabilities that can come near the bucket are looked at: positions follow them, and a position is off by 2 at most.
    near = {"_from": F.col("_start") - F.lit(3.0), "_to": F.col("_end") + F.lit(3.0)}
    for name, position in near.items():
        share = F.try_divide(position - F.lit(1.0), F.col("_n") - F.lit(1.0))
        limits = count_below(limits, share, doubles(probs), len(probs), name)
    every = (F.col("_n") <= F.lit(1.0)) | F.lit(any(a > b for a, b in zip(probs, probs[1:])))
    first = F.when(every, F.lit(0)).otherwise(F.greatest(F.col("_from") - 1, F.lit(0)))
    length = F.when(every, F.lit(len(probs))).otherwise(F.col("_to") + 1 - first)
    nearby = F.slice(doubles(probs), first + 1, length)
    wanted = F.flatten(F.transform(nearby, lambda p, i: two_positions(p, (first + i).cast("int"))))
    here = F.filter(wanted, lambda m: (m["at"] > F.col("_start")) & (m["at"] <= F.col("_end")))
    marks = limits.select(*by, "_bucket", "_start", "_most", F.explode(here).alias("_mark"))
    small = settle(marks)
    marks = materialise(marks) if small is None else small
    needed = marks.select(*by, "_bucket", "_start").distinct()
    needed = needed if small is None else F.broadcast(needed)
    place = [*by, "_bucket"]
    in_bucket = Window.partitionBy(*place)
    values = (
        bucketed.join(needed, place)
        .groupBy(*place, "_value")
        .agg(F.sum("_w").alias("_w"), F.first("_start").alias("_start"))
        .withColumn("_at", F.col("_start") + F.sum("_w").over(in_bucket.orderBy("_value")))
    )
    # One descending pass: the last value seen at or above a position is the answer there.
    lines = values.select(*place, "_at", F.lit(0).alias("_kind"), "_value").unionByName(
        marks.select(*place, F.col("_mark.at").alias("_at"), F.lit(1).alias("_kind"), "_mark", "_most"),
        allowMissingColumns=True,
    )
    from_top = in_bucket.orderBy(F.desc("_at"), "_kind").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    found = F.coalesce(F.last("_value", ignorenulls=True).over(from_top), F.col("_most"))
    return (
        lines.withColumn("_found", found)
        .where(F.col("_kind") == 1)
        .groupBy(*by, F.col("_mark.i").alias("prob_index"), F.col("_mark.p").alias("prob"))
        .agg(F.sum(F.col("_found") * F.col("_mark.share")).alias("quantile"))
    )


def rank_breaks(
    df: DataFrame,
    value: str,
    weight: str,
    seed: int,
    by: Sequence[str] = (),
    probs: Sequence[float] = RANK_PROBS,
    buckets: int | None = None,
) -> DataFrame:
    """One ascending array ``breaks`` per group: quantiles of positive values plus a uniform each.

    The uniform, keyed by group and position, keeps equal quantiles apart.
    """
    quantiles = weighted_quantiles(
        df.where(F.col(value) > 0), value, weight, probs, by, buckets
    )
    jitter = uniform(*[F.col(c) for c in (*by, "prob_index")], seed=seed, draw="break")
    return quantiles.groupBy(*by).agg(
        F.sort_array(F.collect_list(F.col("quantile") + jitter)).alias("breaks")
    )


def rank_bins(
    df: DataFrame,
    value: str,
    weight: str,
    seed: int,
    floor: float,
    by: Sequence[str] = (),
    out: str = "income_pctile",
    probs: Sequence[float] = RANK_PROBS,
    labels: Sequence[float] = RANK_LABELS,
    buckets: int | None = None,
) -> DataFrame:
    """Label each row with the bin (break k - 1, break k] of its value.

    Outside all bins the label is 0 below ``floor`` and 1 otherwise; that also
    gives 1 to a value at or under the lowest break. A null value has no label.
    """
    breaks = rank_breaks(df, value, weight, seed, by, probs, buckets)
    if by:
        df = lookup_join(df, breaks, by)
    else:
        one = breaks.first()  # one array of len(probs) numbers
        df = df.withColumn("breaks", doubles(one["breaks"] if one else []))
    df = count_below(df, F.col(value), F.col("breaks"), len(probs), "_below")
    inside = F.col("_below").between(1, len(labels)) & (F.size("breaks") > F.col("_below"))
    label = F.get(doubles(labels), F.col("_below") - 1)
    outside = F.when(F.col(value) < F.lit(floor), F.lit(0.0)).when(F.col(value) >= F.lit(floor), F.lit(1.0))
    return df.withColumn(out, F.when(inside, label).otherwise(outside)).drop("breaks", "_below")


def weighted_resample(
    df: DataFrame,
    weight: str,
    key: Sequence[str],
    n: int,
    seed: int,
    buckets: int | None = None,
    out: str = "draw_id",
    most_sent: int = MAX_SENT_DRAWS,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Exactly ``n`` draws with replacement, chance proportional to ``weight``.

    Every draw carries the row it hit, its number ``out`` and the constant weight
    total / n; with ``columns``, those of them that are read later, so that no others are taken along. A draw is a point on the axis of running weights. ``df`` is read twice: store an input that is expensive to compute.
    More than ``most_sent`` draws meet the rows bucket by bucket: rows and points are shuffled once by bucket, and a search among
    the running weights of the bucket gives every point its row (:func:`_draw_in_buckets`).
    For fewer draws, and where some buckets would get far more points than others, only keys and weights are put in
    order: keys and points meet in segments that are bounded both in rows and in points, and one sorted
    pass per segment carries the last row start forward to the points behind it. The (draw, key) pairs, as
    many as there are draws, then come to the rows: up to ``most_sent`` pairs and ``MAX_SENT_BYTES`` are broadcast, so that rows are
    repeated where they stand; beyond that both sides are shuffled by key. Repeated keys stop the job.
    """
    spark = df.sparkSession
    df = df.where(F.col(weight).isNull() | (F.col(weight) > 0))
    if n > most_sent:
        found = _draw_in_buckets(df, weight, key, n, seed, out, columns=columns)
        if found is not None:
            return found
    keyed = materialise(df.select(*key, weight))
    refuse_repeats(keyed, key, DRAWN_FROM)
    buckets = buckets or bucket_count(spark)
    running = running_weight(keyed, weight, key, buckets=buckets)
    total = running.total
    even = np.linspace(0.0, total, buckets + 1)[1:-1].tolist()
    inner = sorted({s for s in [*running.starts, *even] if 0.0 < s < total}) or [total]
    limits = [-np.inf, *inner, np.inf]

    start = F.col("cum_weight") - F.col(weight)
    # Reaching slightly past the row's end only adds a row that a later start overrides.
    reach = F.col("cum_weight") + F.lit(total * 1e-9)
    rows = running.rows.withColumn("_at", start).withColumn("_end", reach)
    rows = _locate(_locate(rows, "_at", limits, "_first"), "_end", limits, "_last")
    rows = rows.select(
        F.explode(F.sequence("_first", "_last")).alias("_segment"),
        "_at",
        F.lit(0).alias("_kind"),
        F.struct(*key).alias("_key"),
    )
    points = draw_points(spark, n, seed, out, total)
    points = _locate(points, "_at", limits, "_segment").withColumn("_kind", F.lit(1))

    so_far = (
        Window.partitionBy("_segment")
        .orderBy("_at", "_kind")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    drawn = materialise(
        rows.unionByName(points, allowMissingColumns=True)
        .withColumn("_key", F.last("_key", ignorenulls=True).over(so_far))
        .where(F.col("_kind") == 1)
        .select(out, *[F.col("_key")[k].alias(f"_drawn_{k}") for k in key])
    )
    size = F.sum(sum((F.octet_length(F.col(f"_drawn_{k}").cast("string")) + 16 for k in key), F.lit(16)))
    small = n <= most_sent and (drawn.agg(size).first()[0] or 0) <= MAX_SENT_BYTES
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_drawn_{k}")) for k in key])
    hit = df.join(F.broadcast(drawn) if small else drawn.hint("merge"), same)
    return hit.select(out, *df.columns).withColumn(weight, F.lit(total / n)).select(*(columns or [out, *df.columns]))


def _draw_in_buckets(
    df: DataFrame, weight: str, key: Sequence[str], n: int, seed: int, out: str, per_bucket: int = DRAWS_PER_BUCKET,
    *, columns: Sequence[str] | None = None,
) -> DataFrame | None:
    """The draws of :func:`weighted_resample`, or None if one bucket gets far more rows or points than ``per_bucket``.

    The digest orders rows into ``MAX_BUCKETS`` buckets, whose sums come first; neighbours are then put together up to ``per_bucket``
    rows or points. Repeated keys, which are neighbours in that order, stop the job.
    """
    wanted, keys = list(columns or [out, *df.columns]), list(key)
    names = [c for c in wanted if c not in (out, weight)]
    sent = [out] if out in wanted or not names else []
    moved = list(dict.fromkeys([*names, *keys]))
    placed = df.select(*moved, required(F.col(weight).cast("double"), weight).alias("_w"), _tie(key).alias("_tie"))
    placed = _in_parts(placed, None, None, MAX_BUCKETS)
    # At most two numbers per bucket reach the driver.
    sums = {r["_bucket"]: r for r in placed.groupBy("_bucket").agg(F.sum("_w").alias("w"), F.count(F.lit(1)).alias("n")).collect()}
    if not sums:
        return None
    starts = np.append(0.0, np.cumsum([sums[b]["w"] if b in sums else 0.0 for b in range(MAX_BUCKETS)]))
    total = float(starts[-1])
    own, begins, held_rows, points_held = [0] * MAX_BUCKETS, [], per_bucket, 0.0
    for b in range(MAX_BUCKETS):
        if b in sums:
            rows, points = sums[b]["n"], sums[b]["w"] / total * n
            if rows > 8 * per_bucket or points > 8 * per_bucket:
                return None
            if held_rows + rows > per_bucket or points_held + points > per_bucket:
                # two that begin at the same double stay together
                if not begins or starts[b] > begins[-1]:
                    begins.append(float(starts[b]))
                    held_rows = points_held = 0
            held_rows, points_held = held_rows + rows, points_held + points
        own[b] = max(0, len(begins) - 1)
    placed = placed.withColumn("_bucket", F.get(integers(own), F.col("_bucket")))
    points = draw_points(df.sparkSession, n, seed, out, total)
    points = _locate(points, "_at", [-np.inf, *(begins[1:] or [total]), np.inf], "_bucket")
    points = points if begins[1:] else points.withColumn("_bucket", F.lit(0))
    points = points.select("_bucket", "_at", *sent)
    schema = df.select(*[F.lit(0).cast("long").alias(c) for c in sent], *names).schema

    def place(given: tuple, held: pa.Table, asked: pa.Table) -> pa.Table:
        tie = held["_tie"].to_numpy()
        order = np.argsort(tie, kind="stable")
        if (np.diff(tie[order]) == 0).any():
            order = pc.sort_indices(
                held, sort_keys=[(c, "ascending") for c in ("_tie", *keys)], null_placement="at_start"
            ).to_numpy()
            again = np.flatnonzero(np.diff(tie[order]) == 0)
            ahead, behind = (held.select(keys).take(order[again + i]).to_pylist() for i in (0, 1))
            for one in (x for x, y in zip(ahead, behind) if x == y):
                raise ValueError(f"{DRAWN_FROM} has several rows for " + ", ".join(f"{k} {v}" for k, v in one.items()))
        w = held["_w"].to_numpy()[order]
        ends_at = begins[given[0].as_py()] + np.cumsum(w)
        at = np.maximum.accumulate(ends_at - w)
        hit = np.maximum(np.searchsorted(at, asked["_at"].to_numpy(), side="right") - 1, 0)
        taken = held.select(names).take(order[hit])
        return pa.table([*(asked[c] for c in sent), *taken.columns], [*sent, *names])

    found = placed.groupBy("_bucket").cogroup(points.groupBy("_bucket")).applyInArrow(place, schema)
    return found.withColumn(weight, F.lit(total / n)).select(*wanted)


def draw_points(spark: SparkSession, n: int, seed: int, out: str, total: float) -> DataFrame:
    """``out`` from 0 to n - 1, and a keyed uniform point ``_at`` between 0 and ``total`` for each."""
    points = spark.range(n).withColumnRenamed("id", out)
    return points.withColumn("_at", uniform(F.col(out), seed=seed, draw="resample") * F.lit(total))

"""Regression and quantile forests grown on counted cells.

Training rows with the same features are one cell, so a forest reads the rows once, however many trees
it has. A tree sees the cells with weights, tries every split between neighbouring values by running sums
over cells, and keeps no rows. Trees are grown apart from each other, one group of cells a tree.

The bootstrap draws how often each (features, target) comes: for n rows a Poisson number with mean n, keyed
by the cell, the tree and the seed, which is what n independent draws with mean 1 add up to. It
doesn't depend on partitions or order, and SQL can draw the same. Above ``EXACT_COUNT`` rows the number
is the quantile of the normal with a skewness correction, rounded.

A leaf stands for the training rows in it. :func:`forest_mean` averages their target; :func:`forest_distribution`
answers quantiles and shares of any value that the training rows carry.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heirflow.functions.arrays import count_below, double_literal, doubles
from heirflow.functions.draws import normal, uniform
from heirflow.functions.nulls import required
from heirflow.operators.lookup import lookup_join
from heirflow.sources.shared import materialise

#: Distinct cells of features that one tree takes into a task.
MAX_CELLS = 200_000
#: Largest count whose Poisson number is drawn from its exact distribution.
EXACT_COUNT = 16
#: Gains that differ by less are ties; the first feature and the lowest cut win them.
GAIN_DIGITS = 14

NODES = "tree int, node long, feature int, cut double, weight double, mean double"


def poisson_limits(count: int) -> list[float]:
    """Distribution function of the Poisson number with mean ``count`` at 0, 1, ... up to 1."""
    term, total, out = math.exp(-count), 0.0, []
    k = 0
    while total < 1 - 1e-13 and k < 20 * count + 40:
        total += term
        out.append(min(total, 1.0))
        k += 1
        term *= count / k
    return out


def with_poisson(df: DataFrame, count: str, key: Sequence[str], seed: int, out: str) -> DataFrame:
    """Add a Poisson number with mean ``count`` (a whole number from 1), keyed."""
    columns = [F.col(k) for k in key]
    limits = [poisson_limits(n) for n in range(1, EXACT_COUNT + 1)]
    table = F.array(*[doubles(x) for x in limits])
    df = df.withColumn("_u", uniform(*columns, seed=seed, draw="bootstrap"))
    df = df.withColumn("_limits", F.get(table, F.least(F.col(count), F.lit(EXACT_COUNT)).cast("int") - 1))
    df = count_below(df, F.col("_u"), F.col("_limits"), max(map(len, limits)), "_below")
    z, n = normal(*columns, seed=seed, draw="bootstrap"), F.col(count).cast("double")
    wide = F.greatest(F.floor(n + F.sqrt(n) * z + (z * z - F.lit(1.0)) / F.lit(6.0) + F.lit(0.5)), F.lit(0))
    number = F.when(F.col(count) <= EXACT_COUNT, F.col("_below")).otherwise(wide)
    return df.withColumn(out, number.cast("long")).drop("_u", "_limits", "_below")


@dataclass(frozen=True)
class Forest:
    """``nodes``: one row a node, root 1, children 2k (up to the cut) and 2k + 1; leaves have no feature."""

    nodes: DataFrame
    features: tuple[str, ...]
    seed: int
    bootstrap: bool

    @property
    def getNumTrees(self) -> int:
        """Number of trees, called as in Spark's own models."""
        return self.nodes.where("node = 1").count()


def _weights(counted: DataFrame, key: Sequence[str], trees: int, seed: int, bootstrap: bool) -> DataFrame:
    """``counted`` (column ``_n``; ``key`` is the features, then the target) once a tree, with its weight ``_w`` there."""
    each = counted.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    if not bootstrap:
        return each.withColumn("_w", F.col("_n"))
    # few stored cells are many (cell, tree): dealt out before anything is drawn, as they are grouped afterwards
    each = each.repartition("tree", *key[:-1])
    return with_poisson(each, "_n", [*key, "tree"], seed, "_w")


def _grown(
    codes: np.ndarray, cuts: list[np.ndarray], sums: np.ndarray, depth: int, min_leaf: int, scale: float
) -> pd.DataFrame:
    """Nodes of a tree, a level at a time; ``sums`` has the weight, sum and sum of squares of every cell,
    ``codes`` the place of its features among all values."""

    def impurity(n, s, q):
        return q / n - (s / n) ** 2

    out = []
    cells, node = np.arange(sums.shape[1]), np.ones(sums.shape[1], np.int64)
    for level in range(depth + 1):
        ids, inside = np.unique(node, return_inverse=True)
        total = np.array([np.bincount(inside, x[cells]) for x in sums])
        best, feature, place = np.full(len(ids), 1e-15), np.full(len(ids), -1), np.zeros(len(ids), int)
        for f in range(len(codes)) if level < depth else ():
            # sums of each value in each node, running within the node
            order = np.argsort(inside * (len(cuts[f]) + 1) + codes[f, cells], kind="stable")
            owner, code = inside[order], codes[f, cells][order]
            last = np.append((owner[1:] != owner[:-1]) | (code[1:] != code[:-1]), True)
            running = np.cumsum(sums[:, cells[order]], axis=1)[:, last]
            owner, code = owner[last], code[last]
            heads = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            before = np.concatenate([np.zeros((3, 1)), running[:, heads[1:] - 1]], axis=1)
            nl, sl, ql = running - before[:, owner]
            n, s, q = total[:, owner]
            fits = (nl >= min_leaf) & (n - nl >= min_leaf) & (code < len(cuts[f]))
            gain = np.full(len(owner), -np.inf)
            n, s, q, nl, sl, ql = (x[fits] for x in (n, s, q, nl, sl, ql))
            gain[fits] = np.round(
                (impurity(n, s, q) - nl / n * impurity(nl, sl, ql) - (n - nl) / n * impurity(n - nl, s - sl, q - ql)) / scale,
                GAIN_DIGITS,
            )
            most = np.maximum.reduceat(gain, heads)
            first = np.flatnonzero(gain == most[owner])
            first = first[np.unique(owner[first], return_index=True)[1]]
            better = most > best
            best[better], feature[better], place[better] = most[better], f, code[first][better]
        split = feature >= 0
        cut = np.array([cuts[f][k] if f >= 0 else np.nan for f, k in zip(feature.tolist(), place.tolist())])
        mean = np.divide(total[1], total[0], out=np.zeros(len(ids)), where=total[0] > 0)
        out.append(pd.DataFrame({
            "node": ids, "feature": pd.array(np.where(split, feature, 0), "Int32"), "cut": cut, "weight": total[0], "mean": mean,
        }).assign(feature=lambda x: x["feature"].mask(~split)))
        going = split[inside]
        cells, node, inside = cells[going], node[going], inside[going]
        if not len(cells):
            break
        node = 2 * node + (codes[feature[inside], cells] > place[inside])
    return pd.concat(out)


def fit_forest(
    df: DataFrame,
    seed: int,
    target: str = "has_inheritance",
    features: Sequence[str] = ("age", "married", "income_pctile"),
    trees: int = 100,
    depth: int = 30,
    min_leaf: int = 50,
    bootstrap: bool = True,
    max_cells: int = MAX_CELLS,
) -> Forest:
    """Forest that looks at all features at each split and lowers the variance of the target most.

    For a target of 0 and 1 that is the split by Gini impurity. Cuts lie half way between neighbouring values of
    all rows; both sides weigh ``min_leaf`` at least. Rows with a missing target stop the job; so do more than
    ``max_cells`` distinct cells, since features are meant to be ranks or classes (:func:`rank_bins`).
    """
    features = list(features)
    named = [required(F.col(f).cast("double"), f).alias(f) for f in features]
    counted = materialise(
        df.select(*named, required(F.col(target).cast("double"), target).alias("_y"))
        .groupBy(*features, "_y").agg(F.count(F.lit(1)).alias("_n"))
    )
    cells = counted.select(*features).distinct().limit(max_cells + 1).count()
    if cells > max_cells:
        raise ValueError(f"more than {max_cells} different values of {features}: bin them first")
    places = {f: sorted(r[0] for r in counted.select(f).distinct().collect()) for f in features}  # max_cells at most
    cuts = [(np.array(v[:-1]) + np.array(v[1:])) / 2 for v in places.values()]
    total = counted.agg(F.sum("_n"), F.sum(F.col("_n") * F.col("_y")), F.sum(F.col("_n") * F.col("_y") * F.col("_y"))).first()
    if not total[0]:
        raise ValueError("no rows to learn from")
    binary = counted.where("_y NOT IN (0, 1)").isEmpty()
    scale = 1.0 if binary else max(total[2] / total[0] - (total[1] / total[0]) ** 2, 1e-300)
    sums = (
        _weights(counted, [*features, "_y"], trees, seed, bootstrap).groupBy("tree", *features)
        .agg(F.sum("_w").alias("w"), F.sum(F.col("_w") * F.col("_y")).alias("s"), F.sum(F.col("_w") * F.col("_y") * F.col("_y")).alias("q"))
    )

    def grow(key: tuple, found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values(features)
        codes = np.array([np.searchsorted(places[f], found[f].to_numpy()) for f in features])
        nodes = _grown(codes, cuts, found[["w", "s", "q"]].to_numpy(float).T, depth, min_leaf, scale)
        return nodes.assign(tree=np.int32(key[0]))[["tree", "node", "feature", "cut", "weight", "mean"]]

    nodes = sums.groupBy("tree").applyInPandas(grow, NODES)
    return Forest(materialise(nodes), tuple(features), seed, bootstrap)


def save_forest(forest: Forest, path: str) -> None:
    """Store the nodes, with what the training weights depend on."""
    forest.nodes.select(
        "*", F.lit(forest.seed).alias("seed"), F.lit(forest.bootstrap).alias("bootstrap"), F.lit(",".join(forest.features)).alias("features")
    ).write.mode("overwrite").parquet(path)


def load_forest(spark: SparkSession, path: str) -> Forest:
    table = spark.read.parquet(path)
    one = table.select("seed", "bootstrap", "features").first()
    return Forest(table.drop("seed", "bootstrap", "features"), tuple(one["features"].split(",")), one["seed"], one["bootstrap"])


def saved_forest(df: DataFrame, path: str, estimate: bool, seed: int, **options) -> Forest:
    """Fit and store the forest, or reuse the stored one."""
    if estimate:
        save_forest(fit_forest(df, seed, **options), path)
    return load_forest(df.sparkSession, path)


def leaves(cells: DataFrame, forest: Forest) -> DataFrame:
    """``cells`` once a tree, with ``tree``, ``leaf`` and the leaf's ``mean``; missing features stop the job.

    Cells are dealt in blocks of ``MAX_CELLS``, each block with one tree a task.
    """
    features = list(forest.features)
    cells = materialise(cells.select(*[required(F.col(f).cast("double"), f).alias(f) for f in features]).distinct())
    blocks = 1 + cells.count() // MAX_CELLS
    block = F.pmod(F.xxhash64(*features), F.lit(blocks)).cast("int").alias("block")
    trees = [r[0] for r in forest.nodes.select("tree").distinct().collect()]
    each = cells.select(*features, block, F.explode(F.lit(trees).cast("array<int>")).alias("tree"))
    nodes = forest.nodes.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def walk(key: tuple, own: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("node")
        ids, feature = own["node"].to_numpy(), own["feature"].fillna(-1).to_numpy(int)
        cut, mean = own["cut"].to_numpy(float), own["mean"].to_numpy(float)
        values = given[features].to_numpy(float)
        at = np.zeros(len(given), int)  # the root is the first node
        going = np.flatnonzero(feature[at] >= 0)
        while len(going):
            here = at[going]
            right = values[going, feature[here]] > cut[here]
            at[going] = np.searchsorted(ids, 2 * ids[here] + right)
            going = going[feature[at[going]] >= 0]
        return given[features].assign(tree=key[1], leaf=ids[at], mean=mean[at])

    schema = ", ".join(f"`{f}` double" for f in features) + ", tree int, leaf long, mean double"
    grouped = nodes.groupBy("block", "tree"), each.groupBy("block", "tree")
    return grouped[0].cogroup(grouped[1]).applyInPandas(walk, schema)


def _joined(df: DataFrame, found: DataFrame, features: Sequence[str]) -> DataFrame:
    """The columns of ``found``, one row a cell, beside the rows of ``df``."""
    keys = [f"_cell{i}" for i in range(len(features))]
    with_keys = df.withColumns({k: F.col(f).cast("double") for k, f in zip(keys, features)})
    joined = lookup_join(with_keys, found.withColumnsRenamed(dict(zip(features, keys))), keys, MAX_CELLS)
    return joined.select(*df.columns, *[c for c in found.columns if c not in features])


def forest_mean(df: DataFrame, forest: Forest, out: str = "p_inheritance") -> DataFrame:
    """Mean over trees of the mean target of the leaf a record falls into. Only distinct cells walk the trees."""
    found = leaves(df, forest).groupBy(*forest.features).agg(F.avg("mean").alias(out))
    return _joined(df, found, forest.features)


def members(training: DataFrame, forest: Forest, target: str, value: str) -> DataFrame:
    """``tree, leaf, value, share``: the values of the training rows in every leaf, shares of a leaf adding up to 1.

    Rows of equal features and target share their bootstrap weight evenly.
    """
    features = list(forest.features)
    rows = training.select(
        *[F.col(f).cast("double").alias(f) for f in features], F.col(target).cast("double").alias("_y"),
        required(F.col(value).cast("double"), value).alias("value"),
    )
    counted = rows.groupBy(*features, "_y").agg(F.count(F.lit(1)).alias("_n"))
    drawn = _weights(counted, [*features, "_y"], forest.getNumTrees, forest.seed, forest.bootstrap).where("_w > 0")
    placed = leaves(rows, forest).drop("mean").join(drawn, [*features, "tree"])
    values = rows.groupBy(*features, "_y", "value").agg(F.count(F.lit(1)).alias("_m"))
    weighed = (
        placed.join(values, [*features, "_y"]).groupBy("tree", "leaf", "value")
        .agg(F.sum(F.col("_w") * F.col("_m") / F.col("_n")).alias("weight"))
    )
    total = weighed.groupBy("tree", "leaf").agg(F.sum("weight").alias("total"))
    return weighed.join(total, ["tree", "leaf"]).select("tree", "leaf", "value", (F.col("weight") / F.col("total")).alias("share"))


def forest_distribution(
    df: DataFrame,
    forest: Forest,
    training: DataFrame,
    target: str,
    value: str,
    probs: Sequence[float] = (0.1, 0.5, 0.9),
    above: Sequence[float] = (),
) -> DataFrame:
    """Add functions of the conditional distribution of ``value`` given the features.

    The distribution of a record is the mean over trees of that of its leaf. ``mean``, the quantiles ``q<i>`` (the least
    value with a cumulative share of ``probs[i]``) and the shares ``above<i>`` over a bound. Cells that fall into
    the same leaves of all trees are one, and their distribution is found once.
    """
    features = list(forest.features)
    walked = materialise(leaves(df, forest))
    cells = materialise(
        walked.groupBy(*features).agg(F.sort_array(F.collect_list(F.struct("tree", "leaf"))).alias("leaves"))
        .select(*features, "leaves", F.sha2(F.to_json("leaves"), 256).alias("cell"))
    )
    kinds = cells.select("cell", "leaves").dropDuplicates(["cell"]).select("cell", F.explode("leaves").alias("x"))
    shares = (
        kinds.select("cell", "x.tree", "x.leaf").join(members(training, forest, target, value), ["tree", "leaf"])
        .groupBy("cell", "value").agg((F.sum("share") / F.lit(float(forest.getNumTrees))).alias("share"))
    )
    so_far = Window.partitionBy("cell").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # shares are sums of doubles: what is short of a probability by rounding only reaches it
    cumulative = shares.withColumn("cum", F.sum("share").over(so_far) + F.lit(1e-12))
    found = [F.sum(F.col("value") * F.col("share")).alias("mean")]
    found += [F.min(F.when(F.col("cum") >= F.expr(double_literal(p)), F.col("value"))).alias(f"q{i}") for i, p in enumerate(probs)]
    found += [
        F.sum(F.when(F.col("value") > F.expr(double_literal(b)), F.col("share")).otherwise(0.0)).alias(f"above{i}")
        for i, b in enumerate(above)
    ]
    answers = cells.drop("leaves").join(cumulative.groupBy("cell").agg(*found), "cell").drop("cell")
    return _joined(df, answers, features)

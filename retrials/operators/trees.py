"""Boosted trees and forests over cells of binned features.

A tree sees a feature by its bin alone, so rows are counted by cell, a bin of each feature: no more than ``BINS`` to
the power of the number of features, however many rows there are.  Bagging draws a cell's count once, as the sum of its rows'
draws has a law of its own.  The table of up to ``CELLS`` cells is sent to the tasks; they grow the trees and give each
cell its score, and rows are joined to the scores.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retrials.functions.lineage import materialize
from retrials.functions.ordered import running_sum, value_counts
from retrials.operators.aggregates import melt

BINS, CELLS, CELL = 32, 1 << 20, "__cell"


def thresholds(rows: DataFrame, features: Sequence[str]) -> dict[str, list[float]]:
    """Cuts of each feature: between all its values if there are at most ``BINS``, else next to its quantiles."""
    counts = materialize(value_counts(melt(rows, [], features, "feature"), ["feature"], "value"))
    placed = running_sum(counts, ["feature"], ["value"], {"upto": F.col("n")}, totals={"rows": "upto"})
    before = (F.col("upto") - F.col("n")) * BINS
    cuts = []
    for k in range(1, BINS):
        left = before < F.col("rows") * k
        cuts.append((F.max(F.when(left, F.col("value"))) + F.min(F.when(~left, F.col("value")))) / 2)
    found = placed.groupBy("feature").agg(F.count(F.lit(1)).alias("values"), F.array(*cuts).alias("cuts")).collect()
    few = [r.feature for r in found if r["values"] <= BINS]
    out = {r.feature: sorted({c for c in r.cuts if c is not None}) for r in found}
    listed = counts.where(F.col("feature").isin(few)).select("feature", "value").collect() if few else []  # at most BINS values of each
    for f in few:
        values = sorted(r["value"] for r in listed if r.feature == f)
        out[f] = [(a + b) / 2 for a, b in zip(values, values[1:], strict=False)]
    return {f: out.get(f, []) for f in features}


def with_cell(rows: DataFrame, cuts: Mapping[str, Sequence[float]]) -> DataFrame:
    """Rows with the number of their cell."""
    several = {f: at for f, at in cuts.items() if at}
    if not several:
        return rows.withColumn(CELL, F.lit(0).cast("long"))
    kept, size, number = rows.columns, 1, F.lit(0).cast("long")
    binned = Bucketizer(splitsArray=[[-math.inf, *at, math.inf] for at in several.values()], inputCols=list(several), outputCols=[f"{f}__k" for f in several]).transform(rows)
    for f, at in several.items():
        number = number + F.col(f"{f}__k").cast("long") * F.lit(size).cast("long")
        size *= len(at) + 1
    return binned.select(*kept, number.alias(CELL))


def _bins(cell: np.ndarray, widths: Sequence[int]) -> np.ndarray:
    """Bins by feature and cell."""
    out = np.empty((len(widths), len(cell)), np.int64)
    for f, w in enumerate(widths):
        cell, out[f] = np.divmod(cell, w)
    return out


def _grown(bins: np.ndarray, widths: Sequence[int], sums: Sequence[np.ndarray], weight: np.ndarray, rows: np.ndarray, depth: int, least: int,
           allowed: Callable[[int], np.ndarray] | None = None) -> np.ndarray:
    """Of one tree, the means of ``sums`` by ``weight`` in each cell's leaf, all nodes of a level at once.

    A split adds most to the squares of the sums over the weight: least variance of one sum, Gini impurity of the weights by
    class.  Both sides have ``least`` rows; ``allowed`` gives the features that each of so many nodes may use."""
    k, cells = len(sums), len(weight)
    stats = [*sums, weight, rows]
    out, node, live, size = np.zeros((k, cells)), np.zeros(cells, np.int64), np.arange(cells), 1
    for level in range(depth + 1):
        held = live[rows[live] > 0]
        of, mine = node[held], [s[held] for s in stats]
        total = np.stack([np.bincount(of, s, size) for s in mine])
        best, feature, place = 1e-13 * total[k], np.zeros(size, np.int64), np.zeros(size, np.int64)
        start = best.copy()
        usable = allowed(size) if allowed is not None and level < depth else None
        for f, width in enumerate(widths if level < depth else ()):
            if width < 2:
                continue
            key = of * width + bins[f, held]
            left = np.stack([np.bincount(key, s, size * width).reshape(size, width)[:, :-1].cumsum(axis=1) for s in mine])
            right = total[:, :, None] - left
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = (left[:k] ** 2).sum(axis=0) / left[k] + (right[:k] ** 2).sum(axis=0) / right[k] - ((total[:k] ** 2).sum(axis=0) / total[k])[:, None]
            gain[(left[-1] < least) | (right[-1] < least)] = 0.0
            if usable is not None:
                gain[~usable[:, f]] = 0.0
            at = gain.argmax(axis=1)
            value = gain[np.arange(size), at]
            better = value > best
            best[better], feature[better], place[better] = value[better], f, at[better]
        split = best > start
        ends = ~split[node[live]]
        out[:, live[ends]] = (total[:k] / total[k])[:, node[live[ends]]]
        live = live[~ends]
        if not len(live):
            break
        n = node[live]
        node[live] = 2 * (np.cumsum(split) - 1)[n] + (bins[feature[n], live] > place[n])
        size = 2 * int(split.sum())
    return out


def boosted(cell: np.ndarray, n: np.ndarray, ones: np.ndarray, widths: Sequence[int], rounds: int = 300, step: float = 0.05, depth: int = 5) -> np.ndarray:
    """Each cell's probability by boosted trees: the first fits the labels -1 and 1, each later one the log-loss's gradient."""
    bins, margin = _bins(cell, widths), np.zeros(len(cell))
    n, ones = n.astype(float), ones.astype(float)
    for m in range(rounds):
        rest = ones * 4 / (1 + np.exp(2 * margin)) - (n - ones) * 4 / (1 + np.exp(-2 * margin)) if m else 2 * ones - n
        margin += (step if m else 1.0) * _grown(bins, widths, [rest], n, n, depth, 1)[0]
    return 1 / (1 + np.exp(-2 * margin))


def forest_tree(cell: np.ndarray, n: np.ndarray, ones: np.ndarray, widths: Sequence[int], seed: int, tree: int, depth: int = 12, least: int = 5) -> np.ndarray:
    """Each cell's probability by one tree of a forest: classes balanced, rows bagged, the root of the number of features tried at a node."""
    rng = np.random.default_rng([seed, tree])
    tried, all_rows, all_ones = int(np.ceil(len(widths) ** 0.5)), n.sum(), ones.sum()
    bagged = [rng.poisson(n - ones), rng.poisson(ones)]
    sums = [bagged[0] * (all_rows / (2 * (all_rows - all_ones))), bagged[1] * (all_rows / (2 * all_ones))]
    return _grown(_bins(cell, widths), widths, sums, sums[0] + sums[1], (bagged[0] + bagged[1]).astype(float), depth, least,
                  lambda nodes: rng.random((nodes, len(widths))).argsort(axis=1).argsort(axis=1) < tried)[1]


def cell_scores(train: DataFrame, apply: DataFrame, label: str, widths: Sequence[int], kinds: Mapping[str, Mapping]) -> DataFrame | None:
    """(cell, a score per kind) for the cells of ``apply``; None if there are over ``CELLS`` cells."""
    spark = train.sparkSession
    learnt = train.groupBy(CELL).agg(F.count(label).alias("n"), F.sum(F.col(label).cast("long")).alias("ones"))
    asked = apply.groupBy(CELL).agg(F.lit(True).alias("asked"))
    table = materialize(learnt.join(asked, CELL, "full").select(
        CELL, F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce("ones", F.lit(0).cast("long")).alias("ones"), F.col("asked").isNotNull().alias("asked")))
    if table.count() > CELLS:
        return None
    got = table.toArrow()
    cell, n, ones, wanted = (got.column(c).to_numpy() for c in (CELL, "n", "ones", "asked"))
    if not 0 < ones.sum() < n.sum():
        raise ValueError("training rows hold a single class")
    order = np.lexsort((cell, n == 0))  # cells to learn from first, so that the draws don't depend on the rows to score
    held, shown = spark.sparkContext.broadcast([x[order] for x in (cell, n, ones)]), spark.sparkContext.broadcast(wanted[order])
    out = None
    for kind, how in kinds.items():
        how = dict(how)
        each = how.pop("trees", 500) if kind == "forest" else 1
        seed = how.pop("seed", 7)

        def run(batches: Iterator[pa.RecordBatch], kind=kind, how=how, seed=seed) -> Iterator[pa.RecordBatch]:
            total = 0.0
            for b in batches:
                for t in b.column(0).to_pylist():
                    total = total + (forest_tree(*held.value, widths, seed, t, **how) if kind == "forest" else boosted(*held.value, widths, **how))
            if np.ndim(total):
                kept = shown.value
                yield pa.RecordBatch.from_arrays([pa.array(held.value[0][kept]), pa.array(total[kept])], names=[CELL, "total"])

        deal = spark.range(0, each, 1, min(each, 2 * spark.sparkContext.defaultParallelism))
        part = materialize(deal.mapInArrow(run, f"{CELL} bigint, total double").groupBy(CELL).agg((F.sum("total") / F.lit(float(each))).alias(kind)))
        out = part if out is None else out.join(part, CELL)
    return out

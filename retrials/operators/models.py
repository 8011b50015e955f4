"""Predictors, calibration, cross-fitting and probes on spark.ml."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import PCA, Normalizer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retrials.functions.lineage import materialize, shared_folder
from retrials.functions.numeric import finite
from retrials.functions.ordered import quantiles
from retrials.operators import discrimination as D
from retrials.operators import resampling as B
from retrials.operators import trees as R
from retrials.operators.aggregates import melt, power_gate
from retrials.operators.contracts import require, split_overlap
from retrials.operators.sampling import problem_folds

X, Y, W, P = "__x", "__y", "__w", "probability_1"


def numeric_statistics(train: DataFrame, features: Sequence[str]) -> DataFrame:
    """Per feature: median of the finite train values, then mean and population sd after filling."""
    long = melt(train.select(*[finite(F.col(f)).alias(f) for f in features]), [], features, "feature")
    med = quantiles(long, ["feature"], "value", {"median": 0.5})
    # one small map, not a join: a handful of features would leave as many tasks with all the rows
    by_name = med.agg(F.map_from_entries(F.collect_list(F.struct("feature", "median")))).scalar()
    filled = long.withColumn("median", F.coalesce(F.try_element_at(by_name, F.col("feature")), F.lit(0.0))).withColumn("v", F.coalesce("value", "median"))
    return filled.groupBy("feature").agg(F.max("median").alias("median"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"))


def scaled(df: DataFrame, statistics: Mapping[str, tuple[float, float, float]], suffix: str = "") -> DataFrame:
    """Fill with the train median and standardise; a constant feature stays centred at 0."""
    return df.withColumns({
        f + suffix: (F.coalesce(finite(F.col(f)), F.lit(m)) - F.lit(mu)) / F.lit(sd if sd > 0 else 1.0)
        for f, (m, mu, sd) in statistics.items()
    })


def prepare(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = ()) -> Callable[[DataFrame], DataFrame]:
    """A transformation fitted on train rows that adds the feature vector.

    Only one row of statistics per feature comes to the driver.
    """
    stats = {r.feature: (r.median, r.mean, r.sd) for r in numeric_statistics(train, numeric).collect()} if numeric else {}
    top = {c: train.where(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c).limit(1).collect() for c in categorical}
    fill = {c: rows[0][0] for c, rows in top.items() if rows}
    stages: list = []
    for c in categorical:
        stages += [StringIndexer(inputCol=c, outputCol=f"__i_{c}", handleInvalid="keep"), OneHotEncoder(inputCol=f"__i_{c}", outputCol=f"__h_{c}", dropLast=True)]
    stages.append(VectorAssembler(inputCols=[f"{f}__s" for f in numeric] + [f"__h_{c}" for c in categorical], outputCol=X))

    def filled(df: DataFrame) -> DataFrame:
        return scaled(df.fillna(fill) if fill else df, stats, "__s")

    model = Pipeline(stages=stages).fit(filled(train))
    extra = [f"{f}__s" for f in numeric] + [f"__{k}_{c}" for c in categorical for k in "ih"]
    return lambda df: model.transform(filled(df)).drop(*extra)


def balanced_weights(df: DataFrame, label: str) -> tuple[DataFrame, float]:
    """Rows with weight n / (2 n_class), and the total weight."""
    counts = {int(r[0]): r[1] for r in df.groupBy(F.col(label).cast("int")).count().collect()}
    n = sum(counts.values())
    if len(counts) < 2:
        raise ValueError("training rows hold a single class")
    w = F.when(F.col(label).cast("int") == 1, n / (2 * counts[1])).otherwise(n / (2 * counts[0]))
    return df.withColumn(W, w), float(n)


def logistic(train: DataFrame, label: str, c: float = 0.1, features: str = X, max_iter: int = 200):
    """L2 logistic regression with balanced classes; regParam = 1 / (C * total weight)."""
    rows, total = balanced_weights(train, label)
    return LogisticRegression(
        featuresCol=features, labelCol=Y, weightCol=W, regParam=1.0 / (c * total), elasticNetParam=0.0,
        standardization=False, maxIter=max_iter, tol=1e-6, probabilityCol="__prob", rawPredictionCol="__raw", predictionCol="__hat",
    ).fit(rows.withColumn(Y, F.col(label).cast("double")))


def _spread(rows: DataFrame) -> DataFrame:
    """At least one partition a core: a small written table comes back as one."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def boosted_trees(train: DataFrame, label: str, rounds: int = 300, seed: int = 7):
    """Boosting; every tenth round's predictions are written to the shared folder, so that lineage stays short."""
    context = train.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(train.sparkSession))
    rows = train.withColumn(Y, F.col(label).cast("double"))
    model = GBTClassifier(featuresCol=X, labelCol=Y, maxIter=rounds, stepSize=0.05, maxDepth=5, seed=seed, predictionCol="__hat").fit(rows)
    return model.setProbabilityCol("__prob").setRawPredictionCol("__raw")


def random_forest(train: DataFrame, label: str, trees: int = 500, seed: int = 7):
    rows, _ = balanced_weights(_spread(train), label)
    return RandomForestClassifier(featuresCol=X, labelCol=Y, weightCol=W, numTrees=trees, maxDepth=12, minInstancesPerNode=5, seed=seed,
                                  probabilityCol="__prob", rawPredictionCol="__raw", predictionCol="__hat").fit(
        rows.withColumn(Y, F.col(label).cast("double")))


def predict(model, df: DataFrame, name: str = P) -> DataFrame:
    out = model.transform(df).withColumn(name, vector_to_array(F.col("__prob"))[1])
    return out.drop("__prob", "__raw", "__hat")


def fit_predict(
    train: DataFrame, apply: DataFrame, label: str, numeric: Sequence[str], categorical: Sequence[str] = (), kind: str = "logistic", **how
) -> DataFrame:
    """Fit on ``train`` and add probability_1 to ``apply``."""
    if kind == "prior":
        return apply.withColumn(P, F.lit(train.agg(F.avg(F.col(label).cast("double"))).first()[0]))
    if kind in TREES:
        return tree_predictions(train, apply, label, numeric, {kind: how}, categorical).withColumnRenamed(kind, P)
    shape = prepare(train, numeric, categorical)
    return predict(logistic(materialize(shape(train)), label, **how), shape(apply)).drop(X)


TREES = {"boosted": boosted_trees, "forest": random_forest}


def tree_predictions(
    train: DataFrame, apply: DataFrame, label: str, numeric: Sequence[str], kinds: Mapping[str, Mapping] | None = None, categorical: Sequence[str] = ()
) -> DataFrame:
    """Adds the probability by each kind of trees.

    Numeric features alone make few cells of bins, and trees are grown over their counts; with categories, or more
    cells than ``trees.CELLS``, Spark's trees are fitted on the rows."""
    kinds = {k: {} for k in TREES} if kinds is None else kinds
    if not categorical:
        fill = {r.feature: r.median for r in numeric_statistics(train, numeric).collect()}
        named = {f: f"{f}__b" for f in numeric}

        def filled(df: DataFrame) -> DataFrame:
            return df.withColumns({named[f]: F.coalesce(finite(F.col(f).cast("double")), F.lit(fill.get(f, 0.0))) for f in numeric})

        cuts = R.thresholds(filled(train), list(named.values()))
        known, asked = (R.with_cell(filled(df), cuts).drop(*named.values()) for df in (train, apply))
        scores = R.cell_scores(known, asked, label, [len(c) + 1 for c in cuts.values()], kinds)
        if scores is not None:
            return asked.join(scores, R.CELL).drop(R.CELL)
    shape = prepare(train, numeric, categorical)
    rows, out = materialize(shape(train)), shape(apply)
    for kind, how in kinds.items():
        out = predict(TREES[kind](rows, label, **how), out, kind)
    return out.drop(X)


#: Bound of probabilities before the logit, inverse penalty of the recalibration.
CLIP, PLATT_C = 1e-6, 0.1


def logit(p: Column) -> Column:
    finite = F.when(F.isnan(p) | (F.abs(p) == float("inf")), F.lit(0.5)).otherwise(p)
    q = F.least(F.greatest(finite, F.lit(CLIP)), F.lit(1 - CLIP))
    return F.ln(q / (1 - q))


def platt(calibration: DataFrame, apply: DataFrame, label: str, score: str = P) -> DataFrame:
    """One-feature logistic recalibration fitted on other rows only; adds calibrated and was_nan.

    The penalty is that of inverse strength ``PLATT_C`` on the summed loss.  Where the calibration
    rows have one class, or all one score (a constant model), scores stay as they are."""
    ready = apply.withColumn("was_nan", F.isnan(score))
    seen = calibration.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.col(label).cast("int")).alias("classes"), (F.min(score) < F.max(score)).alias("varies")).first()
    if seen["classes"] < 2 or not seen["varies"]:
        return ready.withColumn("calibrated", F.col(score))
    rows = calibration.withColumn(X, array_to_vector(F.array(logit(F.col(score))))).withColumn(Y, F.col(label).cast("double"))
    model = LogisticRegression(featuresCol=X, labelCol=Y, regParam=1.0 / (PLATT_C * seen["n"]), standardization=False, maxIter=200, tol=1e-8,
                               probabilityCol="__prob", rawPredictionCol="__raw", predictionCol="__hat").fit(rows)
    return predict(model, ready.withColumn(X, array_to_vector(F.array(logit(F.col(score))))), "calibrated").drop(X)


def metric_report(scored: DataFrame, score: str, label: str, draws: int = B.DRAWS, picked: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """AUROC with clustered interval, average precision, Brier, log-loss and ECE in one row.

    Every part is written by itself, and so is the row: one plan of all of them, of all reports of a grid even, would
    hold hundreds of stages, threads and their metrics on the driver at a time."""
    s = materialize(scored.select("problem_id", F.col(score).alias("s"), F.col(label).cast("long").alias("y")))
    parts = [D.auroc(s, "s", "y").select("auroc"), D.average_precision(s, "s", "y"), D.proper_scores(s, "s", "y"),
             D.calibration_error(s, "s", "y"), B.metric_interval(s, "s", "y", draws=draws, picked=picked)]
    return materialize(reduce(lambda a, b: a.join(b, F.lit(True)), [materialize(p) for p in parts]))


def evaluate(
    df: DataFrame, label: str, numeric: Sequence[str], categorical: Sequence[str] = (), kind: str = "logistic", draws: int = B.DRAWS, **how
) -> DataFrame:
    """Train/validation/test run: leak check, fit, Platt on validation, metrics on test."""
    return _evaluated(_checked(df), label, numeric, categorical, kind, draws, **how)


def _checked(df: DataFrame) -> DataFrame:
    """``df``, written, once no problem is in two splits."""
    leak = split_overlap(df).agg((F.coalesce(F.sum("shared_problems"), F.lit(0)) == 0).alias("ok"))
    return materialize(require(df, leak, "a problem is in two splits"))


def _evaluated(
    rows: DataFrame, label: str, numeric: Sequence[str], categorical: Sequence[str] = (), kind: str = "logistic", draws: int = B.DRAWS,
    picked: tuple[DataFrame, DataFrame] | None = None, **how
) -> DataFrame:
    """``evaluate`` of checked rows; ``picked`` are picks of the test rows."""
    part = {s: rows.where(F.col("research_split") == s) for s in ("train", "validation", "test")}
    scored = materialize(fit_predict(part["train"], rows.where("research_split <> 'train'"), label, numeric, categorical, kind, **how))
    if kind == "prior":
        final = scored.where("research_split = 'test'").withColumn("calibrated", F.col(P))
    else:
        final = platt(scored.where("research_split = 'validation'"), scored.where("research_split = 'test'"), label)
    return metric_report(final, "calibrated", label, draws, picked)


def _stack(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def ablation_grid(df: DataFrame, label: str, feature_sets: Mapping[str, Sequence[str]], kinds: Mapping[str, dict], draws: int = B.DRAWS) -> DataFrame:
    """One evaluation per feature set and model kind; rows are checked, and the test rows' picks hashed, once.  A prior knows no features."""
    rows = _checked(df)
    picked = B.shared_picks(rows.where("research_split = 'test'"), [label], draws=draws)
    out, prior = [], None
    for name, fs in feature_sets.items():
        for k, how in kinds.items():
            got = prior if k == "prior" and prior is not None else _evaluated(rows, label, fs, kind=k, draws=draws, picked=picked, **how)
            prior = got if k == "prior" else prior
            out.append(got.withColumns({"feature_set": F.lit(name), "model": F.lit(k)}))
    return _stack(out)


def viable(df: DataFrame, label: str) -> bool:
    """Do train, validation and test all hold both classes (a handful of counts)."""
    got = df.groupBy("research_split").agg(F.countDistinct(F.col(label).cast("int")).alias("k")).collect()
    return {r[0] for r in got if r[1] == 2} >= {"train", "validation", "test"}


def grid(
    cells: Mapping[tuple, DataFrame], names: Sequence[str], label: str, features: Sequence[str], draws: int = B.DRAWS
) -> DataFrame:
    """Evaluations over keyed subsets; an underpowered subset is recorded, not fitted."""
    out = []
    for key, rows in cells.items():
        tags = {n: F.lit(k) for n, k in zip(names, key)}
        rows = materialize(rows)
        if viable(rows, label):
            out.append(evaluate(rows, label, features, draws=draws).withColumns(tags).withColumn("status", F.lit("fitted")))
        else:
            out.append(rows.agg(F.count(F.lit(1)).alias("n")).withColumns(tags).withColumn("status", F.lit("underpowered")))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), out)


#: Metrics of a paired contrast, and the point value of each.
CONTRASTED = ("auroc", "average_precision", "brier", "ece")


def contrast_grid(
    cells: Mapping[tuple, DataFrame], names: Sequence[str], label: str, feature_sets: Mapping[str, Sequence[str]], baseline: str,
    draws: int = B.DRAWS, metrics: Sequence[str] = CONTRASTED,
) -> DataFrame:
    """Named feature sets against one of them on the same test rows, in keyed subsets.

    Per (cell, feature_set, metric): the interval of the set's metric minus the baseline's, problems
    resampled; an underpowered cell is one row with that status and nulls.  A set with a column
    that the rows lack is an error."""
    out = []
    for key, rows in cells.items():
        missing = sorted({c for fs in feature_sets.values() for c in fs} - set(rows.columns))
        if missing:
            raise ValueError(f"feature sets name missing columns: {missing}")
        tags = {n: F.lit(k) for n, k in zip(names, key)}
        rows = materialize(rows)
        if not viable(rows, label):
            empty = {"feature_set": "string", "metric": "string", "ci_low": "double", "ci_high": "double", "used_draws": "bigint", "skipped_draws": "bigint"}
            out.append(rows.agg(F.lit("underpowered").alias("status")).withColumns({c: F.lit(None).cast(t) for c, t in empty.items()} | tags))
            continue
        part = {s: rows.where(F.col("research_split") == s) for s in ("train", "validation", "test")}
        both = part["test"].select("run_id", "problem_id", label)
        for name, fs in feature_sets.items():
            raw = materialize(fit_predict(part["train"], rows.where("research_split <> 'train'"), label, fs))
            final = platt(raw.where("research_split = 'validation'"), raw.where("research_split = 'test'"), label)
            both = both.join(final.select("run_id", F.col("calibrated").alias(f"p_{name}")), "run_id")
        both = materialize(both)
        # the picks are hashed once, and a set's values of a metric are worked out once
        picked = B.shared_picks(both, [label, *(f"p_{name}" for name in feature_sets)], draws=draws)
        value = {(name, m): materialize(B.replicate_metric(both, f"p_{name}", label, m, draws=draws, picked=picked)) for name in feature_sets for m in metrics}
        for name in feature_sets:
            for metric in metrics if name != baseline else ():
                gain = B.difference_interval(value[baseline, metric], value[name, metric])
                out.append(gain.withColumns({"feature_set": F.lit(name), "metric": F.lit(metric), "status": F.lit("fitted")} | tags))
    return _stack(out)


def out_of_fold(
    df: DataFrame, label: str, fit: Callable[[DataFrame, DataFrame], DataFrame], folds: int = 5, seed: str = "oof"
) -> DataFrame:
    """Predictions for every row from models that never saw its problem."""
    assign = problem_folds(df, seed, folds, target=label).select("problem_id", "fold")
    rows = materialize(df.join(assign, "problem_id"))
    return _stack([fit(rows.where(F.col("fold") != k), rows.where(F.col("fold") == k)) for k in range(folds)])


def group_oof(df: DataFrame, label: str, numeric: Sequence[str], categorical: Sequence[str] = (), folds: int = 5, seed: str = "oof") -> DataFrame:
    return out_of_fold(df, label, lambda tr, te: fit_predict(tr, te, label, numeric, categorical), folds, seed)


def nested_platt(df: DataFrame, label: str, numeric: Sequence[str], folds: int = 4, seed: str = "nested") -> DataFrame:
    """Cross-fitted and cross-calibrated forecasts: neither model nor calibrator saw the row's problem.

    One base model a fold scores the rows left out; each fold's calibrator learns from the other folds' scores."""
    oof = materialize(group_oof(df, label, numeric, folds=folds, seed=seed))
    return _stack([platt(oof.where(F.col("fold") != k), oof.where(F.col("fold") == k), label) for k in range(folds)])


def vector_probe(train: DataFrame, test: DataFrame, label: str, vec: str, components: int) -> DataFrame:
    """StandardScaler -> PCA -> balanced logistic regression (C = 1) on array vectors."""
    v = train.withColumn("__v", array_to_vector(F.col(vec)))
    pipe = Pipeline(stages=[
        StandardScaler(inputCol="__v", outputCol="__z", withMean=True, withStd=True), PCA(k=components, inputCol="__z", outputCol=X)
    ]).fit(v)
    model = logistic(pipe.transform(v), label, c=1.0, max_iter=500)
    return predict(model, pipe.transform(test.withColumn("__v", array_to_vector(F.col(vec))))).drop("__v", "__z", X)


def probe_oof(df: DataFrame, label: str, vec: str, components: int = 128, folds: int = 5, seed: str = "probe") -> DataFrame:
    """Problem-disjoint out-of-fold predictions of a vector probe."""
    size = len(df.select(vec).first()[0])
    return out_of_fold(df, label, lambda tr, te: vector_probe(tr, te, label, vec, min(components, size)), folds, seed)


def _summed(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sums of the arrays ``v`` by key and place.  Each place is a row, so that partial sums leave little of a hot key."""
    cells = parts.select(*keys, F.posexplode("v").alias("i", "x")).groupBy(*keys, "i").agg(F.sum("x").alias("x"))
    return cells.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda c: c["x"]).alias("v"))


def _with_one(vec: pd.Series) -> np.ndarray:
    x = np.stack(vec.to_numpy()).astype(float)
    return np.column_stack([np.ones(len(x)), x])


def _part_sums(rows: DataFrame, by: Sequence[str], kernel, held_kind: str | None = None) -> DataFrame:
    """Arrays of sums for each run of rows of one problem in a batch; ``kernel`` yields (key, array) for such a run."""
    name = "held" if held_kind else by[1]
    kind = dict(rows.dtypes)

    def run(batches):
        for pdf in batches:
            out = []
            for ident, g in pdf.groupby(list(by) if not held_kind else by[0], sort=False):
                problem = ident[0] if isinstance(ident, tuple) else ident
                out += [(problem, key, v) for key, v in kernel(g)]
                if len(out) >= 64:
                    yield pd.DataFrame(out, columns=["problem_id", name, "v"])
                    out = []
            if out:
                yield pd.DataFrame(out, columns=["problem_id", name, "v"])

    return rows.mapInPandas(run, f"problem_id {kind['problem_id']}, {name} {held_kind or kind[name]}, v array<double>")


def _moments(g: pd.DataFrame):
    a = _with_one(g["vec"])
    yield g["fold"].iloc[0], np.append((a.T @ a).ravel(), g["y"].sum())


def _newton_sums(g: pd.DataFrame):
    """Gradient and curvature of the balanced loss in the raw space, for the model of each held-out fold."""
    a, y, fold = _with_one(g["vec"]), g["y"].to_numpy(float), g["fold"].to_numpy()
    for m in g["models"].iloc[0]:
        train = fold != m["held"]
        if not train.any():
            continue
        b, t = a[train], y[train]
        p = 1 / (1 + np.exp(-np.clip(b @ np.asarray(m["lin"], float), -30, 30)))
        w = np.where(t == 1, m["w1"], m["w0"])
        yield m["held"], np.concatenate([b.T @ (w * (p - t)), ((b * (w * p * (1 - p))[:, None]).T @ b).ravel()])


def _components(pdf: pd.DataFrame, components: int) -> pd.DataFrame:
    """For each fold of one problem: the map from (1, vector) to (1, scores) that the other folds' moments give."""
    v = np.stack(pdf["v"].to_numpy())
    size = int(round((v.shape[1] - 1) ** 0.5))
    out = []
    for i, fold in enumerate(pdf["fold"]):
        rest = v.sum(0) - v[i]
        n, ones, second = rest[0], rest[-1], rest[:-1].reshape(size, size)
        mu = second[0, 1:] / n
        cov = second[1:, 1:] / n - np.outer(mu, mu)
        var = np.diag(cov)
        sd = np.sqrt(np.where(var > 1e-12 * np.maximum(np.diag(second)[1:] / n, 1e-300), var, 1.0))
        _, vectors = np.linalg.eigh(cov / np.outer(sd, sd))
        keep = vectors[:, ::-1][:, : int(min(components, size - 1, n - 1))].T / sd
        t = np.zeros((len(keep) + 1, size))
        t[0, 0], t[1:, 0], t[1:, 1:] = 1.0, -keep @ mu, keep
        out.append((pdf["problem_id"].iloc[0], fold, t.ravel(), n / (2 * (n - ones)), n / (2 * ones), np.zeros(len(t)), np.zeros(size), np.inf))
    return pd.DataFrame(out, columns=["problem_id", "held", "t", "w0", "w1", "beta", "lin", "move"])


def _newton_step(batches, c: float):
    for pdf in batches:
        beta, lin, move = [], [], []
        for t, old, v in zip(pdf["t"], pdf["beta"], pdf["v"], strict=True):
            t, old = np.asarray(t, float).reshape(len(old), -1), np.asarray(old, float)
            size = t.shape[1]
            ridge = np.eye(len(old)) / c
            ridge[0, 0] = 0.0
            step = np.linalg.solve(t @ np.reshape(v[size:], (size, size)) @ t.T + ridge + 1e-10 * np.eye(len(old)), t @ v[:size] + ridge @ old)
            beta.append(old - step)
            lin.append(t.T @ (old - step))
            move.append(float(np.abs(step).max()))
        yield pdf.drop(columns="v").assign(beta=beta, lin=lin, move=move)


def problem_scores(
    df: DataFrame, label: str = "correct", ident: str = "vec_id", components: int = 32, folds: int = 5,
    per_class: int = 5, c: float = 1.0, steps: int = 50, seed: str = "oracle",
) -> DataFrame:
    """Out-of-fold scores p of a probe for each problem with ``per_class`` rows of each class: problem_id, ident, y, fold, p.

    Standardised vectors, their first ``components`` components, then balanced logistic regression with an L2
    penalty 1 / ``c`` on all but the intercept.  One rule at any size: components come from moments
    summed by (problem, fold), and every Newton step sums gradient and curvature over all problems' rows at once
    until no coefficient moves by 1e-8.  Tasks hold sums of (size + 1)^2 numbers, never a problem's rows."""
    from retrials.operators.sampling import sample_folds
    sizes = materialize(df.groupBy("problem_id").agg(
        F.sum(F.col(label).cast("long")).alias("s"), F.sum(1 - F.col(label).cast("long")).alias("f")
    ).where((F.col("s") >= per_class) & (F.col("f") >= per_class)))
    rows = sample_folds(df.join(sizes.select("problem_id"), "problem_id", "left_semi"), seed, folds, target=label, ident=ident)
    rows = rows.select("problem_id", ident, "vec", F.col("fold").cast("int").alias("fold"), F.col(label).cast("long").alias("y"))
    # a problem's rows stand together, and a large problem spans several ranges
    rows = materialize(rows.repartitionByRange("problem_id", "fold", ident).sortWithinPartitions("problem_id", "fold"))
    kind = dict(rows.dtypes)["problem_id"]
    state = f"problem_id {kind}, held int, t array<double>, w0 double, w1 double, beta array<double>, lin array<double>, move double"
    sums = _summed(_part_sums(rows.select("problem_id", "fold", "vec", "y"), ["problem_id", "fold"], _moments), ["problem_id", "fold"])
    models = materialize(sums.groupBy("problem_id").applyInPandas(lambda pdf: _components(pdf, components), state))
    by_problem = lambda: models.groupBy("problem_id").agg(F.collect_list(F.struct("held", "lin", "w0", "w1")).alias("models"))
    for _ in range(steps):
        parts = _part_sums(rows.join(by_problem(), "problem_id").select("problem_id", "fold", "vec", "y", "models"), ["problem_id"], _newton_sums, "int")
        models = materialize(models.join(_summed(parts, ["problem_id", "held"]), ["problem_id", "held"]).select(
            "problem_id", "held", "t", "w0", "w1", "beta", "lin", "move", "v").mapInPandas(lambda b: _newton_step(b, c), state))
        if (models.agg(F.max("move")).first()[0] or 0.0) < 1e-8:
            break
    scored = rows.join(models.select("problem_id", F.col("held").alias("fold"), "lin"), ["problem_id", "fold"])
    z = F.get("lin", F.lit(0)) + F.aggregate(F.zip_with(F.slice("lin", F.lit(2), F.size("vec")), "vec", lambda b, x: b * x), F.lit(0.0), lambda s, x: s + x)
    p = 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))
    return scored.select("problem_id", ident, "y", "fold", p.alias("p"))


def problem_oracle(df: DataFrame, **how) -> DataFrame:
    """Per-problem probe with sample-disjoint folds: AUROC within each problem of ``problem_scores``."""
    return D.within_problem(materialize(problem_scores(df, **how)), "p", "y")


def plane_coordinates(states: DataFrame, train: Column, vec: str = "vec") -> DataFrame:
    """Two principal coordinates of unit-normalised states; the plane is fitted on train rows."""
    unit = Normalizer(inputCol="__v", outputCol="__u").transform(states.withColumn("__v", array_to_vector(F.col(vec))))
    model = PCA(k=2, inputCol="__u", outputCol="__c").fit(unit.where(train))
    c = vector_to_array(F.col("__c"))
    # The sign of a component is arbitrary: make its largest loading positive.
    load = np.array(model.pc.toArray())
    flip = [float(np.sign(load[np.abs(load[:, k]).argmax(), k])) for k in range(2)]
    return model.transform(unit).select(*states.columns, (c[0] * flip[0]).alias("x"), (c[1] * flip[1]).alias("y"))


def transfer(df: DataFrame, group: str, label: str, numeric: Sequence[str], draws: int = B.DRAWS) -> DataFrame:
    """Fit on one group's train rows, calibrate on its validation rows, evaluate on another's test rows, all ordered pairs."""
    rows = materialize(df)
    groups = sorted(r[0] for r in rows.select(group).distinct().collect())
    out = []
    for a in groups:
        split = F.col("research_split")
        raw = materialize(fit_predict(rows.where((F.col(group) == a) & (split == "train")), rows.where(
            (F.col(group) == a) & (split == "validation") | (F.col(group) != a) & (split == "test")), label, numeric))
        scored = materialize(platt(raw.where(split == "validation"), raw.where(split == "test"), label))
        for b in groups:
            if b != a:
                out.append(metric_report(scored.where(F.col(group) == b), "calibrated", label, draws).withColumns({"source": F.lit(a), "target": F.lit(b)}))
    return _stack(out)


def coefficients(df: DataFrame, label: str, numeric: Sequence[str], top: int = 25) -> DataFrame:
    """Signed logistic coefficients of standardised features, largest magnitude first."""
    shape = prepare(df, numeric)
    model = logistic(shape(df), label)
    rows = [(f, float(c)) for f, c in zip(numeric, model.coefficients.toArray())]
    table = df.sparkSession.createDataFrame(rows, "feature string, coefficient double")
    return table.orderBy(F.desc(F.abs("coefficient")), "feature").limit(top)


def confirmatory(
    df: DataFrame, label: str, base: Sequence[str], extra: Sequence[str], folds: int = 5, draws: int = B.DRAWS
) -> DataFrame:
    """Power gate, out-of-fold checks, one test run, and the clustered gain of ``extra``.

    Models learn from train and validation rows.  An endpoint that fails the gate isn't fitted: its
    row has the gate's verdict and nulls."""
    rows = materialize(df)
    train, test = rows.where("research_split in ('train', 'validation')"), rows.where("research_split = 'test'")
    gate = materialize(power_gate(train, [], label, folds).select("powered", F.col("rows").alias("train_rows")))
    if not gate.where("powered").count():
        missing = {c: "double" for c in ("ci_low", "ci_high", "estimate", "base_oof_auroc", "oof_auroc")}
        missing |= {"used_draws": "bigint", "skipped_draws": "bigint", "excludes_zero": "boolean", "outcome": "string", "meets_criterion": "boolean"}
        return gate.withColumns({c: F.lit(None).cast(t) for c, t in missing.items()})
    a = fit_predict(train, test, label, base).select("run_id", F.col(P).alias("p_base"))
    b = fit_predict(train, test, label, [*base, *extra]).select("run_id", F.col(P).alias("p_full"))
    both = materialize(test.select("run_id", "problem_id", label).join(a, "run_id").join(b, "run_id"))

    def oof(features: Sequence[str], name: str) -> DataFrame:
        return D.auroc(materialize(group_oof(train, label, features, folds=folds)), P, label).select(F.col("auroc").alias(name))

    delta = D.auroc(both, "p_full", label).select("auroc").scalar() - D.auroc(both, "p_base", label).select("auroc").scalar()
    ci = B.decision_flags(B.paired_metric_difference(both, "p_base", "p_full", label, draws=draws).withColumn("estimate", delta))
    return ci.join(gate, F.lit(True)).join(oof(base, "base_oof_auroc"), F.lit(True)).join(oof([*base, *extra], "oof_auroc"), F.lit(True))


def arm_responses(train: DataFrame, apply: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = ("model_key",)) -> DataFrame:
    """Probability of a correct answer under each compute arm."""
    from retrials.operators.aggregates import ARMS
    shape = prepare(train, numeric, categorical)
    tr, out = materialize(shape(train)), shape(apply)
    for arm in ARMS:
        out = predict(logistic(tr, f"{arm}_correct"), out, f"p_{arm}")
    return out.drop(X)


def cross_fitted_arms(df: DataFrame, numeric: Sequence[str], folds: int = 3, seed: str = "arms") -> DataFrame:
    """Arm responses for every branch from models that never saw its problem."""
    return out_of_fold(df, "long_correct", lambda tr, te: arm_responses(tr, te, numeric), folds, seed)

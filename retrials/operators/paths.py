"""Vector-sequence geometry with JVM-side array expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retrials.functions.lineage import materialize
from retrials.functions.ordered import position, quantiles, running_sum, with_previous
from retrials.operators.sampling import with_count


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))


def _clip(c: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))


def step_signals(states: DataFrame, vec: str = "vec") -> DataFrame:
    """Norm, relative step and cosine drift against the previous state of the run."""
    rows = with_previous(states, ["run_id"], "token_index", {"__p": (vec, 1)})
    v, p = F.col(vec), F.col("__p")
    tiny = F.lit(1e-12)
    rel = norm(minus(v, p)) / F.greatest(norm(p), tiny)
    cos = dot(v, p) / (F.greatest(norm(v), tiny) * F.greatest(norm(p), tiny))
    return rows.select(
        *states.columns, norm(v).alias("hidden_norm"), F.when(p.isNotNull(), rel).alias("relative_step"),
        F.when(p.isNotNull(), 1 - _clip(cos)).alias("cosine_drift"),
    )


def _turns(states: DataFrame, index: str, vec: str) -> DataFrame:
    """States with their relative step ``r`` and the turning angle ``a`` that ends in them."""
    rows = with_previous(states, ["run_id"], index, {"__p": (vec, 1), "__pp": (vec, 2)})
    v, p, pp = F.col(vec), F.col("__p"), F.col("__pp")
    tiny = F.lit(1e-12)
    rel = F.when(p.isNotNull(), norm(minus(v, p)) / F.greatest(norm(p), tiny))
    a, b = minus(p, pp), minus(v, p)
    angle = F.when(pp.isNotNull(), F.acos(_clip(dot(a, b) / F.greatest(norm(a) * norm(b), tiny))))
    return rows.select(*states.columns, rel.alias("r"), angle.alias("a"))


def _geometry(turns: DataFrame, keys: Sequence[str], index: str, vec: str, net_name: str) -> DataFrame:
    g = turns.groupBy(*keys).agg(
        F.sum("r").alias("sparse_path_length"), F.avg("a").alias("turning_angle_mean"), F.var_pop("a").alias("turning_angle_variance"),
        F.min_by(vec, index).alias("first"), F.max_by(vec, index).alias("last"), F.count(F.lit(1)).alias("states"),
    )
    net = norm(minus(F.col("last"), F.col("first"))) / F.greatest(norm(F.col("first")), F.lit(1e-12))
    g = g.withColumn(net_name, F.when(F.col("states") >= 2, net))
    return g.withColumn(
        "trajectory_efficiency", F.when(F.col("sparse_path_length") > 0, F.col(net_name) / F.col("sparse_path_length"))
    ).drop("first", "last")


def path_geometry(states: DataFrame, vec: str = "vec") -> DataFrame:
    """Sparse path length, net displacement, efficiency and turning angles per run."""
    return _geometry(_turns(states.select("run_id", "token_index", vec), "token_index", vec), ["run_id"], "token_index", vec, "net_displacement")


def prefix_geometry(states: DataFrame, scoped: DataFrame, prefixes: Sequence[int], vec: str = "vec") -> DataFrame:
    """Path geometry of the states that fall on tokens of the analysis window, per run and reached prefix, and with
    a null prefix_length for the whole window.

    A prefix holds the window's first tokens, so a state's predecessor is the same in every prefix:
    steps and angles are worked out once and only then fan out.  States off the window and null
    vectors are left out; with fewer than two states all but their count is null, without any there is no row.
    """
    given = materialize(states.where(F.col(vec).isNotNull()).select("run_id", "token_index", vec))
    kept = materialize(given.join(scoped.select("run_id", "token_index", "rn", "n").hint("merge"), ["run_id", "token_index"]))
    placed = materialize(position(kept, ["run_id"], ["rn"], "__i").withColumn("__i", F.col("__i") - 1))
    reached = F.filter(F.array(*[F.lit(p).cast("long") for p in prefixes], F.lit(None).cast("long")),
                       lambda p: p.isNull() | ((p >= F.col("rn")) & (p <= F.col("n"))))
    fan = materialize(_turns(placed, "__i", vec)).withColumn("prefix_length", F.explode(reached))
    return _geometry(fan, ["run_id", "prefix_length"], "rn", vec, "normalized_net_displacement")


def mean_vector(rows: DataFrame, keys: Sequence[str], vec: str = "vec", name: str = "mean_vec") -> DataFrame:
    """Element-wise mean per key; map-side combined per (key, element)."""
    cells = rows.select(*keys, F.posexplode(vec).alias("e", "x")).groupBy(*keys, "e").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return cells.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("e", "x"))), lambda s: s.x).alias(name)
    )


def anchor_pooled(states: DataFrame, anchors: Sequence[int], pool: int = 4) -> DataFrame:
    """Mean of the last ``pool`` states before each reached anchor."""
    n = with_count(states, ["run_id"], "__n")
    reach = F.filter(
        F.array(*[F.lit(a).cast("long") for a in anchors]),
        lambda a: (F.col("token_index") < a) & (F.col("token_index") >= a - pool) & (F.col("__n") >= a),
    )
    return mean_vector(n.withColumn("anchor", F.explode(reach)), ["run_id", "anchor"])


def centred(rows: DataFrame, key: str = "problem_id", vec: str = "vec") -> DataFrame:
    """Vectors minus the mean vector of their problem."""
    return rows.join(mean_vector(rows, [key], vec, "__m"), key).withColumn("centred", minus(F.col(vec), F.col("__m"))).drop("__m")


def at_landmarks(path: DataFrame, landmarks: int, coords: Sequence[str] = ("x", "y")) -> DataFrame:
    """Linear interpolation of each path at evenly spaced relative progress.

    Every segment emits the landmarks it covers; the last state also emits progress 1.
    """
    ends = path.groupBy("run_id").agg(F.min("token_index").alias("__a"), F.max("token_index").alias("__b"))
    nxt = {"__t": ("token_index", -1), **{f"__{c}": (c, -1) for c in coords}}
    rows = with_previous(path, ["run_id"], "token_index", nxt).join(ends, "run_id")
    span = F.greatest(F.col("__b") - F.col("__a"), F.lit(1))
    p0 = (F.col("token_index") - F.col("__a")) / span
    p1 = (F.col("__t") - F.col("__a")) / span
    single = F.col("__a") == F.col("__b")
    marks = F.transform(F.sequence(F.lit(0), F.lit(landmarks - 1)), lambda k: F.struct(k.cast("long").alias("k"), (k / (landmarks - 1)).alias("g")))
    inside = F.filter(marks, lambda m: F.when(p1.isNull(), single | (m.g >= p0)).otherwise((m.g >= p0) & (m.g < p1)))
    fan = rows.select("*", F.explode(inside).alias("m")).select(
        "*", F.col("m.k").alias("landmark"), F.coalesce((F.col("m.g") - p0) / (p1 - p0), F.lit(0.0)).alias("__f")
    )
    at = [(F.col(c) + F.col("__f") * F.coalesce(F.col(f"__{c}") - F.col(c), F.lit(0.0))).alias(c) for c in coords]
    ids = [c for c in path.columns if c not in ("token_index", *coords)]
    return fan.select(*ids, "landmark", *at)


def kinematics(marks: DataFrame) -> DataFrame:
    """Displacement from the start and cumulative length at each landmark."""
    from pyspark.sql import Window
    w = Window.partitionBy("run_id").orderBy("landmark")   # one row per landmark: bounded
    first_x, first_y = F.first("x").over(w), F.first("y").over(w)
    step = F.sqrt(F.pow(F.col("x") - F.lag("x").over(w), 2) + F.pow(F.col("y") - F.lag("y").over(w), 2))
    staged = marks.withColumn("displacement", F.sqrt(F.pow(F.col("x") - first_x, 2) + F.pow(F.col("y") - first_y, 2))).withColumn("__s", F.coalesce(step, F.lit(0.0)))
    return staged.withColumn("cumulative", F.sum("__s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__s")


def kinematic_bands(kin: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Median and quartiles of both distances per group and landmark."""
    long = kin.unpivot([*groups, "landmark"], ["displacement", "cumulative"], "measure", "value")
    return quantiles(long, [*groups, "landmark", "measure"], "value", {"median": 0.5, "q25": 0.25, "q75": 0.75})

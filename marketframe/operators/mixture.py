"""Mixture-density models on tables: scoring, fitting, k-fold evaluation, ensembles.

A model maps a feature array to the parameters of a mixture of normal or Poisson
distributions: three stacked linear layers, tanh, and a linear head for each
parameter (softplus keeps scales and rates positive).

Fitting is data-parallel, by local steps and averaging. A pass is one Spark job:
rows are dealt evenly to tasks, each of which makes a step for every mini-batch
of its rows from the model it was given; the models and Adam's moments that the
tasks arrive at are averaged in the cluster, and the driver holds nothing but
parameters. One task makes plain mini-batch descent; more make as many steps a
pass as one task's rows allow. The k models of a k-fold evaluation are fitted in
the same passes: a row counts for every model but its own fold's, which it
validates.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from marketframe.functions.math import log_factorial, log_sum_exp

# -- distributions, as columns of arrays


def weights(logits: Column) -> Column:
    """softmax"""
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def mixture_mean(logits: Column, means: Column) -> Column:
    return F.aggregate(F.zip_with(weights(logits), means, lambda w, m: w * m), F.lit(0.0), lambda s, x: s + x)


def mixture_log_prob(y: Column, logits: Column, means: Column, scales: Column | None = None) -> Column:
    """log density of ``y`` under normal components, or log probability under Poisson ones if there are no scales."""
    if scales is None:
        parts = F.transform(means, lambda r: y * F.log(r) - r - log_factorial(y))
    else:
        one = lambda m, s: -(y - m) * (y - m) / (2 * s * s) - F.log(s) - 0.5 * math.log(2 * math.pi)
        parts = F.zip_with(means, scales, one)
    return log_sum_exp(F.zip_with(logits, parts, lambda a, b: a + b)) - log_sum_exp(logits)


def as_normal(df: DataFrame, means: str = "means", to: str = "scales") -> DataFrame:
    """Poisson components with the scales of normal ones of the same moments."""
    return df.withColumn(to, F.transform(means, lambda r: F.sqrt(r)))


# -- evaluation


def folds(df: DataFrame, key: str, k: int, seed: int = 42, to: str = "fold") -> DataFrame:
    """A fold from 0 to k - 1 by a hash of the key: stable, and equal in size but for chance."""
    digest = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), 1, 8)
    return df.withColumn(to, F.pmod(F.conv(digest, 16, 10).cast("bigint"), F.lit(k)).cast("int"))


def fold_metrics(df: DataFrame, y: str, pred: str, log_prob: str, fold: str = "fold") -> DataFrame:
    """Mean absolute error and mean negative log likelihood by fold."""
    return df.groupBy(fold).agg(F.avg(F.abs(F.col(y) - F.col(pred))).alias("mae"), (-F.avg(log_prob)).alias("nll"))


def averaged_metrics(metrics: DataFrame) -> DataFrame:
    return metrics.agg(F.avg("mae").alias("mae"), F.avg("nll").alias("nll"))


def ensemble(df: DataFrame, key: str, arrays: tuple[str, ...] = ("logits", "means", "scales"), pred: str | None = "pred") -> DataFrame:
    """Means over models: of predictions, and element by element of parameter arrays. Rows are (model, key)."""
    parts = F.arrays_zip(*arrays)
    by = df.select(key, *([pred] if pred else []), F.posexplode(parts).alias("i", "p"))
    one = by.groupBy(key, "i").agg(*[F.avg(F.col("p")[a]).alias(a) for a in arrays], *([F.avg(pred).alias(pred)] if pred else []))
    listed = one.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("i", *arrays))).alias("all"), *([F.first(pred).alias(pred)] if pred else []))
    out = [F.col(f"all.{a}").alias(a) for a in arrays]
    return listed.select(key, *([pred] if pred else []), *out)


# -- the network

TRUNK = ("1", "2", "3")


@dataclass(frozen=True)
class Shape:
    features: int
    hidden: int
    components: int
    family: str = "normal"

    @property
    def heads(self) -> tuple[str, ...]:
        return ("logits", "means", "scales") if self.family == "normal" else ("logits", "means")

    def layers(self) -> dict[str, tuple[int, int]]:
        sizes = {"1": (self.features, self.hidden), "2": (self.hidden, self.hidden), "3": (self.hidden, self.hidden)}
        return sizes | {h: (self.hidden, self.components) for h in self.heads}

    def size(self) -> int:
        return sum((a + 1) * b for a, b in self.layers().values())

    def first(self, seed: int) -> np.ndarray:
        """Uniform within 1 / sqrt(inputs), as linear layers are usually begun."""
        rng = np.random.default_rng(seed)
        return np.concatenate([rng.uniform(-1, 1, (a + 1) * b) / math.sqrt(a) for a, b in self.layers().values()])

    def unpack(self, theta: np.ndarray) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        """Layer -> (weights, bias), as views of ``theta``."""
        out, at = {}, 0
        for name, (a, b) in self.layers().items():
            out[name] = (theta[at : at + a * b].reshape(a, b), theta[at + a * b : at + (a + 1) * b])
            at += (a + 1) * b
        return out


def _softplus(x):
    return np.logaddexp(0, x) + 1e-6


def forward(shape: Shape, theta: np.ndarray, x: np.ndarray) -> dict[str, np.ndarray]:
    """The mixture's parameters for rows of ``x``, and what the gradient needs."""
    p, out, h = shape.unpack(theta), {}, x
    for name in TRUNK:
        out[f"in{name}"] = h
        h = h @ p[name][0] + p[name][1]
    z = out["z"] = np.tanh(h)
    for name in shape.heads:
        out[f"raw_{name}"] = z @ p[name][0] + p[name][1]
    out["logits"] = out["raw_logits"]
    out["means"] = out["raw_means"] if shape.family == "normal" else _softplus(out["raw_means"])
    if shape.family == "normal":
        out["scales"] = _softplus(out["raw_scales"])
    return out


def _log_parts(shape: Shape, out: dict, y: np.ndarray) -> np.ndarray:
    y = y[:, None]
    if shape.family == "normal":
        return -((y - out["means"]) ** 2) / (2 * out["scales"] ** 2) - np.log(out["scales"]) - 0.5 * math.log(2 * math.pi)
    log_fact = np.array([math.lgamma(v + 1) for v in y[:, 0]])[:, None]
    return y * np.log(out["means"]) - out["means"] - log_fact


def loss_and_gradient(shape: Shape, theta: np.ndarray, x: np.ndarray, y: np.ndarray, gradient: bool = True) -> tuple[float, np.ndarray]:
    """Sums over rows of the negative log likelihood and of its gradient."""
    out = forward(shape, theta, x)
    lse = lambda a: np.log(np.exp(a - a.max(1, keepdims=True)).sum(1, keepdims=True)) + a.max(1, keepdims=True)
    log_w = out["logits"] - lse(out["logits"])
    joint = log_w + _log_parts(shape, out, y)
    total = lse(joint)
    if not gradient:
        return float(-total.sum()), np.zeros(0)
    r, yc = np.exp(joint - total), y[:, None]
    sigmoid = lambda a: 1 / (1 + np.exp(-np.clip(a, -60, 60)))
    d = {"logits": np.exp(log_w) - r}
    if shape.family == "normal":
        d["means"] = -r * (yc - out["means"]) / out["scales"] ** 2
        d["scales"] = -r * ((yc - out["means"]) ** 2 / out["scales"] ** 3 - 1 / out["scales"]) * sigmoid(out["raw_scales"])
    else:
        d["means"] = -r * (yc / out["means"] - 1) * sigmoid(out["raw_means"])
    p, grad = shape.unpack(theta), np.zeros_like(theta)
    g = shape.unpack(grad)
    back = np.zeros_like(out["z"])
    for name in shape.heads:
        g[name][0][:], g[name][1][:] = out["z"].T @ d[name], d[name].sum(0)
        back += d[name] @ p[name][0].T
    back = back * (1 - out["z"] ** 2)
    for name in reversed(TRUNK):
        g[name][0][:], g[name][1][:] = out[f"in{name}"].T @ back, back.sum(0)
        back = back @ p[name][0].T
    return float(-total.sum()), grad


@dataclass
class Fitted:
    """Parameters of one model per fold (a single fit has one), and the losses of each epoch."""

    shape: Shape
    thetas: list[np.ndarray]
    history: list[dict] = field(default_factory=list)


#: Groups that partial sums are added up in before they reach the driver.
ADDERS = 8
#: Rows that one task holds and steps over in a pass.
ROWS = 100_000
#: Rows of a step.
BATCH = 64


@dataclass
class Learner:
    """A model being fitted: its parameters, Adam's moments, and how many steps it has made."""

    theta: np.ndarray
    m: np.ndarray
    v: np.ndarray
    t: int = 0

    @classmethod
    def new(cls, theta: np.ndarray) -> Learner:
        return cls(theta, np.zeros_like(theta), np.zeros_like(theta))

    def step(self, g: np.ndarray, rate: float) -> None:
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * g
        self.v = 0.999 * self.v + 0.001 * g * g
        self.theta = self.theta - rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)

    def sweep(self, shape: Shape, x: np.ndarray, y: np.ndarray, order: np.ndarray, batch: int, rate: float, l2: float) -> float:
        """One step for each ``batch`` rows in ``order``; the sum of the losses that the rows had when they were used."""
        total = 0.0
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            loss, g = loss_and_gradient(shape, self.theta, x[rows], y[rows])
            self.step(g / len(rows) + l2 * self.theta, rate)
            total += loss
        return total


@dataclass(frozen=True)
class Schedule:
    """How a fit steps: rows a step, sweeps of a task over its rows in a pass, rates of the sweeps of a pass, and whether it only measures."""

    batch: int
    rates: tuple[float, ...]
    l2: float
    seed: int


def _pass(data: DataFrame, shape: Shape, learners: dict[int, Learner], how: Schedule) -> dict[int, tuple[Learner, np.ndarray]]:
    """For each model: the average of what the tasks made of it, weighted by their rows, and
    [rows, train loss, rows stepped over, validation loss, validation rows, steps].

    The validation loss is that of the model the pass began with.
    """
    shared = data.sparkSession.sparkContext.broadcast(learners)
    size = shape.size()

    def local(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part, parts = TaskContext.get().partitionId(), [b for b in batches if b.num_rows]
        adder, rows = part % ADDERS, []
        if parts:
            x = np.concatenate([np.stack(b.column("features").to_numpy(zero_copy_only=False)).astype(float) for b in parts])
            y, fold = (np.concatenate([b.column(c).to_numpy() for b in parts]) for c in ("y", "fold"))
        for j, given in shared.value.items() if parts else ():
            own, learner = fold == j, Learner(given.theta, given.m, given.v, given.t)
            held = loss_and_gradient(shape, given.theta, x[own], y[own], gradient=False)[0] if own.any() else 0.0
            mine, train = np.flatnonzero(~own), 0.0
            for i, rate in enumerate(how.rates if len(mine) else ()):
                order = mine[np.random.default_rng([how.seed, given.t, part, i]).permutation(len(mine))]
                train += learner.sweep(shape, x, y, order, how.batch, rate, how.l2)
            n = len(mine)
            facts = [n, train, n * len(how.rates), held, own.sum(), learner.t - given.t]
            rows.append((j, np.concatenate([n * learner.theta, n * learner.m, n * learner.v, [n * learner.t], facts])))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([adder] * len(rows), pa.int32()), pa.array([r[1].tolist() for r in rows], pa.list_(pa.float64()))], ["model", "adder", "sums"])

    def add(table):
        import pyarrow as pa

        total = np.sum(np.stack(table.column("sums").to_numpy()), axis=0)
        return pa.table({"model": pa.array([table.column("model")[0].as_py()], pa.int32()), "sums": pa.array([total.tolist()], pa.list_(pa.float64()))})

    parts = data.mapInArrow(local, "model int, adder int, sums array<double>")
    # ADDERS rows per model reach the driver, whatever the number of partitions
    added = parts.groupBy("model", "adder").applyInArrow(add, "model int, sums array<double>").collect()
    shared.unpersist()
    out = {}
    for j, given in learners.items():
        total = np.sum([np.zeros(3 * size + 7), *(np.array(r.sums) for r in added if r.model == j)], axis=0)
        facts, n = total[-6:], total[-6]
        if n and how.rates:
            mean = total[:-6] / n
            given = Learner(mean[:size], mean[size : 2 * size], mean[2 * size : 3 * size], round(mean[-1]))
        out[j] = given, facts
    return out


def _dealt(df: DataFrame, features: str, y: str, fold: str | None) -> DataFrame:
    """The rows of a fit, dealt evenly to tasks of at most about ``ROWS`` rows, whatever is in them."""
    data = df.select(F.col(features).cast("array<double>").alias("features"), F.col(y).cast("double").alias("y"), (F.col(fold) if fold else F.lit(-1)).cast("int").alias("fold")).dropna()
    data = data.where(~F.exists("features", lambda x: x.isNull()))
    return data.repartition(max(1, -(-data.count() // ROWS))).persist(StorageLevel.MEMORY_AND_DISK)


def fit(
    df: DataFrame, shape: Shape, features: str = "features", y: str = "y", fold: str | None = None, models: int = 1, epochs: int = 100, rate: float = 0.01,
    l2: float = 0.0, patience: int | None = None, seed: int = 42, batch: int = BATCH, sweeps: int = 1, anneal: bool = False,
) -> Fitted:
    """Fit one model per fold. Model j learns from rows whose ``fold`` isn't j and is validated on those whose is.

    Without ``fold`` one model learns from all rows. An epoch is a pass over the
    rows in one Spark job: each task makes an Adam step for each ``batch`` of its
    rows, ``sweeps`` times over, and the tasks' models are averaged. With
    ``anneal`` the rate falls evenly to 0. With ``patience`` a model whose
    validation loss (of the averaged model) hasn't improved for that many epochs
    stops; the best parameters seen are kept. A last pass validates what the last
    epoch made. Rows with a null feature or target are left out.
    """
    data = _dealt(df, features, y, fold)
    try:
        learners = {j: Learner.new(shape.first(seed + j)) for j in range(models)}
        thetas = [x.theta for x in learners.values()]
        best, best_loss, waited, history = list(thetas), [math.inf] * models, [0] * models, []
        for epoch in range(epochs + (fold is not None)):
            falls = lambda i, epoch=epoch: 1 - (epoch * sweeps + i) / (epochs * sweeps) if anneal else 1.0
            rates = tuple(rate * falls(i) for i in range(sweeps)) if epoch < epochs else ()
            got = _pass(data, shape, learners, Schedule(batch, rates, l2, seed))
            row, still = {"epoch": epoch, "train": {}, "validation": {}, "steps": {}}, {}
            for j, (after, (_, train, seen, held, m, steps)) in got.items():
                row["train"][j], row["validation"][j], row["steps"][j] = (train / seen if seen else math.nan), (held / m if m else math.nan), int(steps)
                if m and held / m < best_loss[j]:
                    best_loss[j], best[j], waited[j] = held / m, learners[j].theta, 0
                elif m:
                    waited[j] += 1
                if patience is not None and waited[j] >= patience:
                    continue
                thetas[j], still[j] = after.theta, after
            history.append(row)
            if not (learners := still):
                break
        kept = [best[j] if patience is not None and best_loss[j] < math.inf else thetas[j] for j in range(models)]
        return Fitted(shape, kept, history)
    finally:
        data.unpersist()


def scored(df: DataFrame, fitted: Fitted, features: str = "features", model: int | None = None) -> DataFrame:
    """``df`` with ``logits``, ``means``, ``scales`` (null for Poisson) and ``pred``, for one model or (with ``model``) for each."""
    if not fitted.thetas:
        raise ValueError("the model isn't fitted")
    shape, chosen = fitted.shape, list(range(len(fitted.thetas))) if model is None else [model]
    shared = df.sparkSession.sparkContext.broadcast(fitted.thetas)
    heads = ("logits", "means", "scales")

    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array(batch.column(features).to_pylist(), dtype=float)
            for j in chosen:
                out = forward(shape, shared.value[j], x)
                arrays = [pa.array(out[h].tolist(), pa.list_(pa.float64())) if h in out else pa.nulls(len(x), pa.list_(pa.float64())) for h in heads]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([j] * len(x), pa.int32()), *arrays], [*batch.schema.names, "model", *heads])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    out = df.mapInArrow(rows, f"{fields}, model int, logits array<double>, means array<double>, scales array<double>")
    return out.withColumn("pred", mixture_mean(F.col("logits"), F.col("means")))


def log_prob(df: DataFrame, shape: Shape, y: str = "y", to: str = "log_prob") -> DataFrame:
    scales = F.col("scales") if shape.family == "normal" else None
    return df.withColumn(to, mixture_log_prob(F.col(y).cast("double"), F.col("logits"), F.col("means"), scales))


def kfold(df: DataFrame, shape: Shape, key: str, k: int = 5, epochs: int = 20, patience: int = 5, seed: int = 42, features: str = "features", y: str = "y", **how) -> tuple[Fitted, DataFrame]:
    """The models of a k-fold evaluation, and the error and likelihood of each on its own fold."""
    split = folds(df, key, k, seed)
    fitted = fit(split, shape, features, y, "fold", k, epochs, patience=patience, seed=seed, **how)
    own = scored(split, fitted, features).where("model = fold")
    return fitted, fold_metrics(log_prob(own, shape, y), y, "pred", "log_prob")


def ensemble_scores(df: DataFrame, fitted: Fitted, key: str, features: str = "features") -> DataFrame:
    """``key, pred, logits, means`` (and ``scales``) averaged over the models."""
    arrays = fitted.shape.heads
    return ensemble(scored(df, fitted, features), key, arrays)


def parameters(spark: SparkSession, fitted: Fitted) -> DataFrame:
    """The parameters as a table ``model, layer, row, col, value``; the bias is the row after the last."""
    rows = []
    for j, theta in enumerate(fitted.thetas):
        for layer, (w, b) in fitted.shape.unpack(theta).items():
            rows += [(j, layer, i, c, float(v)) for i, r in enumerate([*w, b]) for c, v in enumerate(r)]
    return spark.createDataFrame(rows, "model int, layer string, row int, col int, value double")


def save(spark: SparkSession, fitted: Fitted, path: str) -> None:
    parameters(spark, fitted).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Fitted:
    """The model saved at ``path``; FileNotFoundError if there is none. The table is a model's size."""
    from pyspark.errors import AnalysisException

    try:
        table = spark.read.parquet(path).toPandas()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(path) from e
        raise
    one = {n: (g["row"].max(), g["col"].max() + 1) for n, g in table[table.model == 0].groupby("layer")}
    shape = Shape(int(one["1"][0]), int(one["1"][1]), int(one["logits"][1]), "normal" if "scales" in one else "poisson")
    thetas = []
    for j in sorted(table.model.unique()):
        own = table[table.model == j]
        thetas.append(np.concatenate([own[own.layer == n].sort_values(["row", "col"])["value"].to_numpy() for n in shape.layers()]))
    return Fitted(shape, thetas)
